import random
import time

import pytest
from echolattice.llm import line_dedup
from hypothesis import given, settings
from hypothesis import strategies as st
from test_components import components


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abé", max_size=14), st.text("abé", max_size=14), st.integers(0, 5))
def test_banded_distance(a, b, edits):
    assert line_dedup.within(a, b, edits) == (distance(a, b) <= edits)


def brute(rows, edits=2, least=12, per=20):
    lines = sorted({x for _, t in rows if t is not None for x in t.split("\n")})
    most = lambda a, b: min(edits, min(len(a), len(b)) // per)
    comp = components([(a, b) for i, a in enumerate(lines) for b in lines[:i] if abs(len(a) - len(b)) <= most(a, b) and distance(a, b) <= most(a, b)])
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}):
        kept = []
        for x in t.split("\n"):
            c = comp.get(x, x)
            if len(x) >= least and x.strip(" \t\n\v\f\r") and c in seen:
                continue
            if len(x) >= least and x.strip(" \t\n\v\f\r"):
                seen.add(c)
            kept.append(x)
        out[i, t] = ("\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept))
    return sorted(((i, *(out[i, t] if t is not None else (None, 0, 0))) for i, t in rows), key=str)


ROWS = [
    (1, "The quick brown fox jumps over the lazy dog today\nshort\nA line that is unlike the others, at some length"),
    (2, "The quick brown fox jumps over the lazy dogs today\nshort\n\n  \nexactly twelv"),
    (3, "The quick brwn fox jumps over the lazy dogs todayy\nexactly twelv\nA line that is unlike the others, at some length"),
    (4, "The quick brown cat jumps over the lazy dog today"),
    (5, "Die schnelle Füchsin sprang über den faulen Hünd\nDie schnelle Fuchsin sprang über den faulen Hund"),
    (6, None),
    (7, ""),
    (8, "x" * 20_000 + "\n" + "x" * 20_001),
    (8, "x" * 20_000 + "\n" + "x" * 20_001),
    (9, "The quick brown fox jumps over the lazy dog today\nThe quick brown fox jumps over the lazy dog today"),
]


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_against_all_pairs(spark, scratch, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rows = [r for r in ROWS if r[0] != 8]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as class", "2 as at", "'y' as line").repartition(4)
    got = line_dedup.dedup_lines(df, scratch)
    assert got.columns == ["doc_id", "text", "class", "at", "line", "_lines", "_removed"]
    assert sorted(((r["doc_id"], r["text"], r["_lines"], r["_removed"]) for r in got.collect()), key=str) == brute(rows)


def test_long_and_repeated_rows(spark, scratch):
    got = line_dedup.dedup_lines(spark.createDataFrame([r for r in ROWS if r[0] in (6, 7, 8)], "doc_id long, text string"), scratch).collect()
    assert sorted((r["doc_id"], -1 if r["text"] is None else len(r["text"]), r["_removed"]) for r in got) == [(6, -1, 0), (7, 0, 0), (8, 20_000, 1), (8, 20_000, 1)]


@pytest.mark.parametrize("block", [2_000_000, 100])
def test_one_law_at_any_length(spark, scratch, monkeypatch, block):
    """Lines about the lengths at which another edit is allowed, each with copies of one to three edits."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng, rows = random.Random(4), []
    for n in (11, 12, 18, 19, 20, 21, 22, 38, 39, 40, 41, 42, 59, 60, 61, 90):
        for _ in range(3):
            line = "".join(rng.choice("abcdefgh ") for _ in range(n - 1)) + "x"
            for edits in range(4):
                one = list(line)
                for _ in range(edits):
                    k = rng.randrange(len(one))
                    one[k : k + 1] = rng.choice([[], ["Q"], ["Q", one[k]]])
                rows.append((len(rows), "".join(one) + "\n" + line))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scratch).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, t, n, k) for i, t, n, k in brute(rows)), key=str)


def test_lines_that_no_probe_hits_are_not_verified():
    rng = random.Random(5)
    unlike = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(400)]
    count = [0]
    assert not list(line_dedup.linked_lines(unlike, 2, count=count)) and count[0] < 20
    near = [unlike[0][:k] + "Z" + unlike[0][k + 1 :] for k in range(60)] * 5
    count = [0]
    assert len(list(line_dedup.linked_lines(near, 2, count=count))) == len(near) - 1
    assert count[0] < 2 * len(near)


def test_removal_is_linear(spark, scratch):
    """As many lines that go as a document has: one pass, whatever their number."""
    took = []
    for n in (20_000, 160_000):
        df = spark.createDataFrame([(1, "\n".join(["the same line again"] * n) + "\nend")], "doc_id long, text string")
        began = time.time()
        assert [(r["text"], r["_removed"]) for r in line_dedup.dedup_lines(df, scratch).collect()] == [("the same line again\nend", n - 1)]
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 5


def test_any_columns(spark, scratch):
    """Every name that is used inside, on columns of the caller's."""
    names = ["_lines", "_REMOVED", "row", "gone", "d", "t", "at", "line", "line2", "class", "c0", "c1", "c2", "first", "key", "new", "lines", "a.b", "back`tick"]
    df = spark.createDataFrame([(1, "a line of some length", *names), (2, "a line of some length\nmore", *names)], ["doc_id", "text", *names])
    out = line_dedup.dedup_lines(df, scratch)
    assert out.columns == [*df.columns, "__lines", "__removed"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a line of some length", *names, 1, 0), (2, "more", *names, 2, 1)]


def test_empty(no_docs, scratch):
    assert line_dedup.dedup_lines(no_docs, scratch).count() == 0
