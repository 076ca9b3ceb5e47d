import zlib
from collections import Counter

import numpy as np
import pytest
from echolattice.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, 3)
    assert sorted(p.tolist()) == list(range(n))
    assert np.array_equal(sharding.unpermute(p, n, 3), np.arange(n))
    if n > 100:
        assert not np.array_equal(p, sharding.permute(np.arange(n), n, 4))
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.15
    for r in (0, n // 2, n - 1):
        shard, slot = sharding.locate(r, n, 7, 3)
        assert sharding.row_at(shard, slot, n, 7, 3) == r


def test_large_domain():
    n = (1 << 40) + 12345
    r = np.array([0, 1, 2, n - 1, n // 3])
    assert np.array_equal(sharding.unpermute(sharding.permute(r, n, 1), n, 1), r)


def test_shards(spark, scratch, docs, corpus):
    slim = docs.select("doc_id", "text")
    a = sharding.shard_rows(slim, ["doc_id"], 7, scratch).collect()
    b = sharding.shard_rows(slim.repartition(1), ["doc_id"], 7, scratch).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))
    assert sorted(r["row_number"] for r in a) == list(range(len(corpus)))
    keys = [r["doc_id"] for r in sorted(a, key=lambda r: r["row_number"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    sizes = Counter(r["shard"] for r in a)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in a if r["shard"] == s) == list(range(n))
    for r in a[:20]:
        assert sharding.locate(r["row_number"], len(corpus), 7) == (r["shard"], r["slot"])


def test_any_columns(spark, scratch):
    """Every name that is used inside, on columns of the caller's."""
    names = ["row", "number", "part", "at", "n", "start", "place", "Shard", "slot", "row_number", "_part", "_at", "_n", "_position", "a.b"]
    df = spark.createDataFrame([(k, *names) for k in range(20)], ["doc_id", *names])
    out = sharding.shard_rows(df, ["doc_id"], 3, scratch)
    assert out.columns == [*df.columns, "_row_number", "_shard", "_slot"]
    assert sorted(r[:-3] for r in map(tuple, out.collect())) == [(k, *names) for k in range(20)]
    assert sorted((r["doc_id"], r["_row_number"]) for r in out.collect()) == [(k, k) for k in range(20)]
    assert sharding.number_rows(df, ["doc_id"], scratch).columns == [*df.columns, "_row_number"]


def test_empty(scratch, no_docs):
    assert sharding.shard_rows(no_docs.select("doc_id"), ["doc_id"], 5, scratch).count() == 0


def test_query(spark, tmp_path, docs, corpus):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.op3_feistel_shards(spark, str(tmp_path)).collect())
    assert got == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
