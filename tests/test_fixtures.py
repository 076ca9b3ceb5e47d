import datetime as dt
import random

import pytest
from echolattice.plans import catalog, fixtures
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
START = dt.datetime(1995, 1, 2)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A few suppliers' shipments: nulls, weeks before the first, negative part numbers, cells of several files."""
    folder, draw = str(tmp_path_factory.mktemp("odd")), random.Random(3)
    rows = [(draw.randrange(5), draw.randrange(-30, 40), float(draw.randrange(9)), START + dt.timedelta(draw.randrange(-20, 60))) for _ in range(400)]
    rows += [(None, 3, 1.0, START), (0, None, 1.0, START), (1, 2, None, START), (2, 2, 5.0, None), (70, 1, None, None), (71, 1, 2.0, START), (72, None, 2.0, START), (73, -1, 3.0, START)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double, l_shipdate timestamp").repartition(7).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, k % 2) for k in (*range(5), 70, 71, 99)] + [(None, 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    want = {}
    for s, p, x, day in rows:
        f = want.setdefault(s, [[0.0] * 12 for _ in range(9)])
        if s is not None and p is not None and p % 12 == abs(p) % 12 * (1 if p >= 0 else -1) and x is not None and day is not None and day >= START:
            f[(day - START).days // 7][p % 12] += x
    return folder, want


@pytest.mark.parametrize("rows", [3, 64])
def test_frames(spark, monkeypatch, odd, rows):
    folder, want = odd
    monkeypatch.setattr(fixtures, "GATHERED", 50)
    monkeypatch.setattr(fixtures, "ROWS", rows)
    got = [tuple(r) for r in fixtures.frames(spark, folder).collect()]
    assert len(got) == len(want) and dict(got) == want
    both = {r["item_idx"]: (r["label"], r["frames"]) for r in fixtures.performances(spark, folder).collect()}
    assert both == {k: (k % 2, want[k]) for k in (*range(5), 70, 71)}
    assert {r["item_idx"]: (r["label"], r["frames"]) for r in fixtures.performances(spark, folder, [3, 99]).collect()} == {3: both[3]}
    assert fixtures.performances(spark, folder, []).count() == 0


def test_frames_are_made_after_the_shuffle(spark):
    """A grid of all weeks was joined with all cells: it, the cells and the frames were shuffled and sorted."""
    plan = fixtures.frames(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    done = fixtures.performances(spark, SF)
    executed = done._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") <= 2


def test_invariance_needs_one_performance(spark, monkeypatch):
    """The frames of all were made a second time for the one pair."""
    asked, whole = [], fixtures.performances
    monkeypatch.setattr(fixtures, "performances", lambda spark, sf_dir, only=None: asked.append(only) or whole(spark, sf_dir, only))
    row = catalog.queries()["invariance_pair"](spark, SF).first()
    assert [len(x) for x in asked if x is not None] == [1] and asked[-1] == [row["query_idx"]]


def test_no_relevant_pair(spark, odd, tmp_path):
    folder, _ = odd
    spark.read.parquet(f"{folder}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{folder}/supplier.parquet").withColumn("s_nationkey", F.col("s_suppkey").cast("int")).write.parquet(f"{tmp_path}/supplier.parquet")
    pairs = catalog.queries()["invariance_pair"](spark, str(tmp_path))
    assert pairs.columns == ["query_idx", "item_idx", "drift", "distance"] and pairs.count() == 0
