import time

import numpy as np
import pytest
from echolattice.llm import common
from echolattice.llm.common import candidates, connected_components, keyed, min_labels


def components(edges):
    at = {}

    def root(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(at)}


def test_min_labels():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 300, (250, 2))
    nodes, label = min_labels(e[:, 0], e[:, 1])
    assert dict(zip(nodes.tolist(), label.tolist(), strict=True)) == components(e.tolist())


@pytest.mark.parametrize("run", [500_000, 100])
def test_components(spark, scratch, monkeypatch, run):
    """With one run, and with star rounds over many."""
    monkeypatch.setattr(common, "RUN", run)
    rng = np.random.default_rng(2)
    chain = [(i, i + 1) for i in range(1000, 1400)]
    star = [(5000, 5001 + i) for i in range(500)]
    e = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2)) if a != b] + chain + star + [(9, 9)]
    rng.shuffle(e)
    df = spark.createDataFrame([tuple(map(int, x)) for x in e], "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in connected_components(df, scratch).collect()}
    assert got == components([x for x in e if x[0] != x[1]])
    assert connected_components(df.where("a < 0"), scratch).count() == 0


def test_candidates(spark, scratch):
    """Ids that share a key are in one part, over any partitions and runs; ids of their own aren't there."""
    rng = np.random.default_rng(3)
    keys = {i: rng.integers(0, 4000, 3).tolist() for i in range(600)} | {i: [77_777] for i in range(700, 900)}
    df = spark.createDataFrame([(i, ",".join(map(str, k))) for i, k in keys.items()], "id long, keys string").repartition(9)

    def run(batches):
        for b in batches:
            yield from keyed(((np.array(k.split(","), np.int64), np.full(k.count(",") + 1, i), np.ones(k.count(",") + 1, np.int64)) for i, k in zip(*(c.to_pylist() for c in b.columns), strict=True)), most=50)

    got = {r["node"]: r["component"] for r in candidates(df, run, scratch)[0].collect()}
    by = {}
    for i, ks in keys.items():
        for k in ks:
            by.setdefault(k, set()).add(i)
    want = components([(min(v), x) for v in by.values() for x in v if len(v) > 1 and x != min(v)])
    assert got == want


def test_long_writes_give_their_shuffle_files_back(spark, scratch, monkeypatch):
    """Without a collection of the driver's garbage, the files of every shuffle stay until the driver ends; the last one's may."""
    monkeypatch.setattr(common, "RELEASE_S", -1)
    blocks = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    before = blocks.shuffleStatuses().size()
    for _ in range(6):
        scratch.write(spark.range(1000).repartition(4, "id"))
    for _ in range(100):
        if blocks.shuffleStatuses().size() <= before + 1:
            break
        time.sleep(0.1)
    assert blocks.shuffleStatuses().size() <= before + 1
