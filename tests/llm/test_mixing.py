import re
from collections import Counter, defaultdict

from echolattice.llm import mixing
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10_000), st.lists(st.tuples(st.integers(0, 9), st.integers(0, 3_000)), min_size=1, max_size=8))
def test_split_budget(budget, nodes):
    w, room = [a for a, _ in nodes], [b for _, b in nodes]
    got = mixing.split_budget(budget, w, room)
    assert sum(got) == min(budget, sum(room))
    assert all(0 <= g <= r for g, r in zip(got, room, strict=True))
    # what isn't full has its share by weight, to a token
    free = [i for i in range(len(nodes)) if got[i] < room[i] and w[i]]
    for i in free:
        for j in free:
            assert abs(got[i] * w[j] - got[j] * w[i]) <= w[i] + w[j]


def test_siblings_before_ancestors():
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "3"): 1000, ("b", "x", "4"): 1000}
    got = mixing.leaf_budgets(leaves, 800, 1, {})
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 190, ("a", "y", "3"): 200, ("b", "x", "4"): 400}
    leaves["a", "x", "2"] = 20
    assert mixing.leaf_budgets(leaves, 800, 1, {}) == {("a", "x", "1"): 10, ("a", "x", "2"): 20, ("a", "y", "3"): 370, ("b", "x", "4"): 400}


def test_against_plain_prefixes(spark, docs, corpus, scratch, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 10)
    rows = docs.dropDuplicates(["doc_id", "text"])
    got = mixing.mix(rows, scratch, mixing.domain_of(F.col("source")), share=90, epochs=3).collect()
    assert set(got[0].asDict()) >= set(docs.columns)
    seed = 23
    info = rows.withColumn("d", mixing.domain_of(F.col("source")))
    for e in range(4):
        info = info.withColumn(f"k{e}", mixing.place_key(seed, F.lit(e), F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    leaves = defaultdict(list)
    for r in info.collect():
        leaves[r["d"], r["lang"] or "(none)", r["source"] or "(none)"].append(r)
    n = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    sizes = {k: sum(map(n, v)) for k, v in leaves.items()}
    budgets = mixing.leaf_budgets(sizes, sum(sizes.values()) * 90 // 100, 3, mixing.WEIGHTS)
    want = Counter()
    for leaf, own in leaves.items():
        whole, rest = divmod(budgets[leaf], sizes[leaf]) if sizes[leaf] else (1, 0)
        for e in range(whole):
            want.update((r["doc_id"], r["text"], e) for r in own)
        run = 0
        for r in sorted(own, key=lambda r: (r[f"k{whole}"], r["doc_id"] is not None, r["doc_id"] or 0)):
            run += n(r)
            if rest and run <= rest:
                want[r["doc_id"], r["text"], whole] += 1
    assert Counter((r["doc_id"], r["text"], r["_epoch"]) for r in got) == want


def test_any_columns(spark, scratch):
    """Every name that is used inside, on columns of the caller's."""
    names = ["_row", "_epoch", "_Tokens", "_domain", "_lang", "_source", "_text", "_bucket", "_place", "_whole", "_rest", "_buckets", "_end", "_before", "_n", "_run", "n", "e", "before", "a.b"]
    df = spark.createDataFrame([(k, "x " * 5, "en", "src0", *names) for k in range(40)], ["doc_id", "text", "lang", "source", *names])
    out = mixing.mix(df, scratch, mixing.domain_of(F.col("source")), share=50, epochs=1)
    assert out.columns == [*df.columns, "__epoch", "__tokens", "__domain", "__lang", "__source"]
    assert len(rows := out.collect()) == 20 and all(tuple(r)[4:24] == tuple(names) for r in rows)


def plain_shares(budget, nodes):
    """Tokens of each name from {name: (weight, room)}: the water level at which all of the budget is given, by fractions."""
    from fractions import Fraction

    budget = min(budget, sum(room for _, room in nodes.values()))
    names, used, out = sorted(nodes, key=lambda n: (Fraction(nodes[n][1], nodes[n][0]), n)), 0, {}
    while names and (level := Fraction(budget - used, sum(nodes[n][0] for n in names))) * nodes[names[0]][0] >= nodes[names[0]][1]:
        out[names[0]] = nodes[names[0]][1]
        used += out[names.pop(0)]
    if names:
        exact = {n: level * nodes[n][0] for n in names}
        out |= {n: int(x) for n, x in exact.items()}
        for n in sorted(names, key=lambda n: (-(exact[n] - int(exact[n])), n))[: budget - used - sum(int(x) for x in exact.values())]:
            out[n] += 1
    return out


def plain_mix(rows, share, epochs, seed=23):
    """(doc_id, epoch) of rows (doc_id, text, lang, source), with budgets, places and prefixes worked out here."""
    from hashlib import md5

    def leaf(r):
        m = re.search("([0-9]{1,9})$", r[3] or "")
        return f"domain{int(m[1]) % 4 if m else 0}", r[2] or "(none)", r[3] or "(none)"

    count = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    own, budgets = defaultdict(list), {}
    for r in rows:
        own[leaf(r)].append(r)
    sizes = {k: sum(map(count, v)) for k, v in own.items()}

    def down(path, tokens):
        if len(path) == 3:
            budgets[path] = tokens
            return
        below = {x[len(path)] for x in sizes if x[: len(path)] == path}
        weights = mixing.WEIGHTS.get(("domain", "lang", "source")[len(path)], {})
        nodes = {n: (weights.get(n, 1), epochs * sum(z for x, z in sizes.items() if x[: len(path) + 1] == (*path, n))) for n in below}
        for n, t in plain_shares(tokens, nodes).items():
            down((*path, n), t)

    down((), sum(sizes.values()) * share // 100)
    out = Counter()
    for k, docs in own.items():
        whole, rest = divmod(budgets[k], sizes[k]) if sizes[k] else (1, 0)
        out.update((r[0], e) for e in range(whole) for r in docs)
        place = lambda r: int(md5(f"{seed}:{whole}:{'null' if r[0] is None else r[0]}:{md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()[:8], 16) >> 1  # noqa: E731, B023
        run = 0
        for r in sorted(docs, key=lambda r: (place(r), r[0] is not None, r[0] or 0)):
            run += count(r)
            if rest and run <= rest:
                out[r[0], whole] += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10_000), st.lists(st.tuples(st.integers(1, 9), st.integers(1, 3_000)), min_size=1, max_size=8))
def test_split_like_a_water_level(budget, nodes):
    want = plain_shares(budget, {f"{k}": n for k, n in enumerate(nodes)})
    assert mixing.split_budget(budget, [a for a, _ in nodes], [b for _, b in nodes]) == [want[f"{k}"] for k in range(len(nodes))]


def test_against_a_plain_version(spark, docs, scratch):
    rows = docs.dropDuplicates(["doc_id", "text"])
    held = [tuple(r) for r in rows.select("doc_id", "text", "lang", "source").collect()]
    for share, epochs in ((90, 1), (60, 2), (250, 3), (0, 1)):
        got = mixing.mix(rows, scratch, mixing.domain_of(F.col("source")), share=share, epochs=epochs).collect()
        assert Counter((r["doc_id"], r["_epoch"]) for r in got) == plain_mix(held, share, epochs)


def test_no_rows(no_docs, scratch):
    assert mixing.mix(no_docs, scratch, mixing.domain_of(F.col("source"))).count() == 0


def test_domains(spark):
    rows = spark.createDataFrame([("src0",), ("src7",), ("x",), (None,), ("s99999999999999",)], "s string")
    assert [r[0] for r in rows.select(mixing.domain_of(F.col("s"))).collect()] == ["domain0", "domain3", "domain0", "domain0", "domain3"]
