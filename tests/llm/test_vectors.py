import math

import numpy as np
import pytest
from echolattice.llm import vectors
from test_components import components

ROWS = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, cosine):
    links, ids = {}, {r[0] for r in rows}
    good = {(i, tuple(e), l) for i, e, l, *_ in rows if i is not None and l is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)}
    good = sorted(good)
    edges = []
    x = [np.array(e, np.float64) for _, e, _ in good]
    for a in range(len(good)):
        for b in range(len(good)):
            if a != b and good[a][2] == good[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] / (np.linalg.norm(x[a]) * np.linalg.norm(x[b])) >= cosine:
                links[good[a][0]] = links.get(good[a][0], 0) + 1
                edges.append((good[a][0], good[b][0]))
    comp = components(edges)
    return {(i, links.get(i, 0), comp.get(i, i), comp.get(i, i) == i) for i in ids if i is not None}


@pytest.fixture
def rows():
    rng = np.random.default_rng(4)
    out = []
    for k in range(500):
        label = [1, 1, 1, 2, 3, None][k % 6]
        v = rng.normal(size=16)
        if k % 3 == 0:
            v = np.eye(16)[k % 5] + rng.normal(size=16) * 0.02
        out.append((k, np.float32(v).tolist(), label, "x"))
    base = rng.normal(size=16)
    out += [(1000 + k, np.float32(base + rng.normal(size=16) * 0.05).tolist(), 1, "x") for k in range(200)]
    out += [(2000, None, 1, "x"), (2001, [], 1, "x"), (2002, [0.0] * 16, 1, "x"), (2003, [float("nan")] + [1.0] * 15, 1, "x"), (2004, [float("inf")] * 16, 1, "x"), (2005, [None] + [1.0] * 15, 1, "x"), (2006, [1.0] * 4, 1, "x"), (2007, [2.0] * 4, 1, "x")]
    return [*out, out[3], out[3], out[500], (None, [1.0] * 4, 1, "x")]


@pytest.mark.parametrize(("cell", "block"), [(16_384, 1024), (16_384, 40), (60, 20), (9, 4)])
def test_against_all_pairs(spark, scratch, rows, monkeypatch, cell, block):
    """One block a label, several, and several levels of cells."""
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "FANOUT", 64 if cell > 10 else 3)
    monkeypatch.setattr(vectors, "PIVOT_BYTES", 32 << 20 if cell != 60 else 1000)
    got = vectors.near_duplicates(spark.createDataFrame(rows, ROWS).repartition(6), scratch).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None} == brute(rows, 0.98)
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, True)]
    assert len(got) == len({r[0] for r in rows})


@pytest.mark.parametrize("cell", [16_384, 30])
def test_copies_and_multiples(spark, scratch, monkeypatch, cell):
    """Equal vectors under many ids, multiples of one, which no nearest tells apart, and ids that have vectors of two groups."""
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(11)
    u, v, w = (np.float32(rng.normal(size=8)) for _ in range(3))
    rows = [(k, u.tolist(), 1, "x") for k in range(100, 200)] + [(k, (v * (k - 199)).tolist(), 1, "x") for k in range(200, 300)]
    rows += [(k, (w + np.float32(rng.normal(size=8) * 0.001)).tolist(), 1, "x") for k in range(300, 400)] + [(k, w.tolist(), 2, "x") for k in range(400, 420)]
    rows += [(150, v.tolist(), 1, "y"), (5, u.tolist(), 1, "y"), (5, w.tolist(), 2, "y"), (410, w.tolist(), 2, "z")]
    got = vectors.near_duplicates(spark.createDataFrame(rows, ROWS).repartition(6), scratch).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got} == brute(rows, 0.98)


def test_repeated_rows_keep_their_links(spark, scratch):
    """Few different vectors in very many rows: each label has a pivot, or is one cell."""
    rng = np.random.default_rng(6)
    rows = []
    for label in range(20):
        v = rng.normal(size=8)
        rows += [(10 * label + k, np.float32(v + 0.001 * k).tolist(), label, "x") for k in range(2)] * 500
    got = vectors.near_duplicates(spark.createDataFrame(rows, ROWS), scratch).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(10 * label + k, 1, 10 * label) for label in range(20) for k in range(2)}


def test_cell_without_pivot(spark, scratch, monkeypatch):
    """A cell of whose vectors none is drawn is cut by hash."""
    monkeypatch.setattr(vectors, "CELL", 2)
    for ids in ([0, 1, 2], list(range(40))):
        got = vectors.near_duplicates(spark.createDataFrame([(k, [1.0, 0.0001 * k], 1, "x") for k in ids], ROWS), scratch).collect()
        assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(k, len(ids) - 1, 0) for k in ids}


def test_empty(spark, scratch):
    assert vectors.near_duplicates(spark.createDataFrame([], ROWS), scratch).count() == 0


def mixture():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 8)), np.eye(8)[rng.integers(0, 8, 300)] + rng.normal(size=(300, 8)) * 0.01])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_tree_bounds():
    """Every row is below the root once, inside each radius above it; no close pair is pruned, no far one is taken."""
    x = mixture()
    t = vectors.CoverTree.build(x)
    assert sorted(t.order.tolist()) == list(range(600))
    for k in range(len(t.centre)):
        below = t.order[t.begin[k] : t.end[k]]
        assert np.sqrt(np.maximum(2 - 2 * x[below] @ x[t.centre[k]], 0)).max() <= t.radius[k] + 1e-7
        assert t.centre[k] in below
        if t.many[k]:
            children = range(t.first[k], t.first[k] + t.many[k])
            assert [t.begin[c] for c in children] == [t.begin[k], *(t.end[c] for c in children)][:-1] and t.end[children[-1]] == t.end[k]
            assert t.centre[children[0]] == t.centre[k]
            apart = 2 - 2 * x[t.centre[list(children)]] @ x[t.centre[list(children)]].T
            assert np.sqrt(np.maximum(apart[~np.eye(len(children), dtype=bool)], 0)).min() * 2 > t.radius[k] / 2
    again = vectors.CoverTree.unpacked(t.packed())
    assert all(np.array_equal(getattr(t, n), getattr(again, n)) for n in t.NAMES)
    near, met = x[t.order] @ x[t.order].T >= 0.98, np.zeros((600, 600), int)
    for i, j, k, m, sure in vectors.meetings(t, x[t.order], t, x[t.order], 0.2):
        met[i:j, k:m] += 1
        if i != k:
            met[k:m, i:j] += 1
        assert not sure or near[i:j, k:m].all()
    assert met.max() == 1 and met[near].all()
    assert met.mean() < 0.2


def test_work_is_less_than_all_pairs():
    """Distances of the build and comparisons of the traversal, on unlike vectors, on copies of one with small changes, and on a mixture."""
    rng = np.random.default_rng(12)
    unlike = rng.normal(size=(1024, 64))
    copies = rng.normal(size=64) + rng.normal(size=(1024, 64)) * 0.005
    for x, most in ((unlike, 0.51), (copies, 0.01), (mixture(), 0.35)):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        built, compared = [0], [0]
        t = vectors.CoverTree.build(unit, 0.2, built)
        own = x[t.order]
        n, _, _ = vectors.block_links(own, np.ones(len(x), np.int64), t, None, None, None, 0.98, compared)
        assert np.array_equal(n, (unit[t.order] @ unit[t.order].T >= 0.98).sum(axis=1) - 1)
        assert built[0] + compared[0] < most * len(x) * len(x), (built, compared, len(x))


def test_divide():
    x = mixture()
    parts = list(vectors.divide(x, 50))
    assert sorted(np.concatenate(parts).tolist()) == list(range(600)) and max(map(len, parts)) <= 50
    same = np.repeat(x[:1], 130, axis=0)
    assert sorted(map(len, vectors.divide(same, 50))) == [30, 50, 50]
