import math
from collections import defaultdict

import numpy as np
import pytest
from echolattice.operators import evaluation as ev
from echolattice.operators import similarity

PAIRS = "query_idx long, item_idx long, query_label string, item_label string, distance double"


def table(spark, matrix, labels, queries=None):
    queries = range(len(matrix)) if queries is None else queries
    return spark.createDataFrame([(q, j, labels[q], labels[j], float(d)) for q, row in zip(queries, matrix, strict=True) for j, d in enumerate(row)], PAIRS)


def test_nonfinite_last_by_index(spark):
    inf, nan = math.inf, math.nan
    got = ev.rank_pairs(table(spark, [[0, nan, 1, inf], [nan, 0, 1, 1], [1, 1, 0, 1], [inf, 1, -inf, 0]], "AAAA")).collect()
    order = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        order[r["query_idx"]].append(r["item_idx"])
    assert order == {0: [2, 1, 3], 1: [2, 3, 0], 2: [0, 1, 3], 3: [1, 0, 2]}


def test_self_is_left_out(spark):
    r = ev.evaluate(table(spark, [[99, 0, 5, 6], [0, 99, 5, 6], [5, 5, 99, 0], [6, 6, 0, 99]], "AABB")).first()
    assert r["map"] == 1


def test_singleton_query_raises(spark):
    with pytest.raises(Exception, match="no relevant item"):
        ev.evaluate(table(spark, [[0, 1, 2], [1, 0, 2], [2, 2, 0]], "AAB")).collect()
    with pytest.raises(ValueError, match="no relevant item"):
        ev.score_block(np.array([[0.0, 1, 2]]), np.array([0]), np.array([0, 1, 2]), 10)


@pytest.mark.parametrize("chunk", [1, 7, 60, 5000])
def test_chunks_change_nothing(spark, chunk):
    rng = np.random.default_rng(1)
    d = rng.integers(0, 9, (30, 30)).astype(float)
    pairs = table(spark, d + d.T, [str(i % 5) for i in range(30)])
    whole, parts = ev.evaluate(pairs, 7).first(), ev.evaluate_chunked(pairs, chunk, 7).first()
    assert all(abs(whole[c] - parts[c]) < 1e-9 for c in whole.asDict())


def test_random_floor(spark):
    rng = np.random.default_rng(0)
    d = rng.random((100, 100))
    r = ev.evaluate(table(spark, (d + d.T) / 2, [str(i % 10) for i in range(100)])).first()
    assert abs(r["map"] - 0.1303) < 0.03 and abs(r["p_at_k"] - 0.09) < 0.05


def test_block_and_window_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 6)) if i % 9 else None, rng.normal(size=5).round(1).tolist()) for i in range(80)]
    items = spark.createDataFrame(rows, "item_idx long, label int, vec array<double>").where("label is not null")
    a = sorted(ev.score_vectors(items, similarity.cosine_pairs, 5).collect())
    monkeypatch.setattr(ev, "BROADCAST_BYTES", 0)
    b = sorted(ev.score_vectors(items, similarity.cosine_pairs, 5).collect())
    assert [r["query_idx"] for r in a] == [r["query_idx"] for r in b]
    assert np.allclose([list(r)[1:] for r in a], [list(r)[1:] for r in b])


def test_curve(spark):
    scores = spark.createDataFrame([(0, 1), (1, 1), (2, 3), (3, 9)], "query_idx long, r1 long")
    assert [r["share"] for r in sorted(ev.rank_curve(scores, 11).collect())] == [0.5, 0.5, 0.75, 0.75, 0.75, 0.75, 0.75, 0.75, 1, 1]


def test_cosine_pairs(spark):
    items = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "a", [2.0, 0.0]), (2, "b", [0.0, 1.0]), (3, "b", [-1.0, 0.0]), (4, "b", [0.0, 0.0])], "item_idx long, label string, vec array<double>")
    for groups in (None, 1, 3):
        d = {(r["query_idx"], r["item_idx"]): r["distance"] for r in similarity.cosine_pairs(items, groups=groups).collect()}
        assert len(d) == 20 and all(d[i, j] == d[j, i] for i, j in d)
        assert (d[0, 1], d[0, 2], d[0, 3], d[0, 4]) == (0, 1, 2, 1)
        near = similarity.nearest(similarity.cosine_pairs(items, top=2, groups=groups), 2).collect()
        assert {r["item_idx"] for r in near if r["query_idx"] == 0} == {1, 2}
    r = similarity.cosine_pairs(items, queries=items.where("item_idx < 2"))
    assert r.count() == 10


def test_random_pairs_are_symmetric(spark):
    items = spark.range(40).selectExpr("id as item_idx", "id % 4 as label")
    d = {(r["query_idx"], r["item_idx"]): r["distance"] for r in similarity.random_pairs(items, 5).collect()}
    assert len(d) == 40 * 39 and all(d[i, j] == d[j, i] and 0 <= d[i, j] < 1 for i, j in d)


def test_pairs_meet_once_whatever_the_groups(spark, monkeypatch):
    """Of any number of items, groups and rows of a block: each unordered pair once, each ordered pair once, queries against items."""
    import numpy as np

    monkeypatch.setattr(similarity, "BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(k * 7 % 41, "ab"[k % 2], rng.normal(size=12).tolist()) for k in range(23)]
    items = spark.createDataFrame(rows, "item_idx long, label string, vec array<double>").repartition(3)
    ids = sorted(r[0] for r in rows)
    for groups in (1, 2, 5, 60):
        half = [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in similarity.upper_pairs(items, "vec", groups=groups).collect()]
        assert sorted((q, i) for q, i, *_ in half) == [(q, i) for q in ids for i in ids if q < i]
        about = {r[0]: r for r in rows}
        assert all((a, b, v, w) == (about[q][1], about[i][1], about[q][2], about[i][2]) for q, i, a, v, b, w in half)
        every = similarity.cosine_pairs(items, groups=groups).collect()
        assert sorted((r["query_idx"], r["item_idx"]) for r in every) == [(q, i) for q in ids for i in ids if q != i]
        some = similarity.cosine_pairs(items, items.where("item_idx < 9"), groups=groups).collect()
        assert sorted((r["query_idx"], r["item_idx"]) for r in some) == [(q, i) for q in ids if q < 9 for i in ids]
        steps = {(r["query_idx"], r["item_idx"]): r["steps"] for r in similarity.transposition_pairs(items, groups=groups).collect()}
        assert steps == {(q, i): int(np.argmax([np.round(np.dot(about[q][2], np.roll(about[i][2], s)), 9) for s in range(12)])) for q in ids for i in ids if q < i}


def test_plans_of_pairs_have_no_nested_loop(spark):
    items = spark.range(1000).selectExpr("id as item_idx", "id % 7 as label", "array(cast(id as double)) as vec", "id as n_frames")
    for pairs in (similarity.duration_pairs(items), similarity.random_pairs(items), similarity.cosine_pairs(items), similarity.transposition_pairs(items)):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scores_with_and_without_a_pair_table(spark):
    rows = [(k, k % 9, [float(k * k % 17)]) for k in range(80)]
    items = spark.createDataFrame(rows, "item_idx long, label long, vec array<double>")
    table = {r["query_idx"]: r for r in ev.score_queries(similarity.random_pairs(items, 3)).collect()}
    fused = {r["query_idx"]: r for r in ev.score_vectors(items, None, decimals=12, distance=ev.random_distance(3)).collect()}
    assert set(table) == set(fused) and all(table[q][c] == fused[q][c] for q in table for c in ("r1", "n_relevant", "ties", "p_at_k"))
    lengths = items.withColumn("n_frames", items["vec"][0])
    table = {r["query_idx"]: r for r in ev.score_queries(similarity.duration_pairs(lengths)).collect()}
    fused = {r["query_idx"]: r for r in ev.score_vectors(items, None, distance=ev.length_distance).collect()}
    assert all(abs(table[q]["ap"] - fused[q]["ap"]) < 1e-12 and table[q]["ties"] == fused[q]["ties"] for q in table)
