"""Shared plumbing of the corpus operators: scratch tables, bounded broadcasts, connected components, tokenizers."""

from __future__ import annotations

import atexit
import contextlib
import gc
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolattice.functions import workers

#: Rows of (at most) three numbers; a broadcast table of that many stays near 50 MB on an executor.
BROADCAST_ROWS = 200_000

#: Bytes of an Arrow batch, about: texts and blocks are long, and a batch is held by the executor and by its worker.
BATCH_BYTES = 8 << 20

_LEFT: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Make workers ready for this package's functions, and the session's Arrow batches small if they are at their default."""
    workers.ship(spark)
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, f"{64 << 20}b") == f"{64 << 20}b":
        spark.conf.set(size, f"{BATCH_BYTES}b")


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _LEFT:
        with contextlib.suppress(Exception):  # the session may be gone at exit; nothing depends on the folder any more
            _delete(spark, path)


#: Seconds of a write after which what it shuffled is given back at once.
RELEASE_S = 5


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are over: it does so when the driver's garbage is collected, which may be never in a long run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables in the shared folder. They cut lineage, so that a lost executor costs its tasks and not the plan."""

    def __init__(self, spark: SparkSession, what: str):
        ship(spark)
        self.spark, self.path = spark, f"{workers.shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.n = 0
        _LEFT.append((spark, self.path))

    def folder(self) -> str:
        self.n += 1
        return f"{self.path}/{self.n}"

    def write(self, df: DataFrame) -> DataFrame:
        path, began = self.folder(), time.monotonic()
        df.write.parquet(path)
        if time.monotonic() - began > RELEASE_S:
            release(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """For tables that no later step reads."""
        _delete(self.spark, df._scratch_path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialised table for broadcast if it has at most so many rows; else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bits of a member filter: 16 to 32 a key, up to 2**28 (32 MB on every executor).
FILTER_BITS = 28


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in a table of so many bits."""
    h = mix64(keys.astype(np.int64).view(np.uint64))
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def member_filter(keys: DataFrame, count: int):
    """A test column for columns of longs: true for every key (one column of longs) and for few others, false for null. Keys are seen by executors alone."""
    ship(keys.sparkSession)
    bits = min(max(count, 1).bit_length() + 4, FILTER_BITS)

    def marks(batches):
        held = np.zeros(1 << bits - 3, np.uint8)
        for b in batches:
            own = b.column(0).drop_null().to_numpy()
            for at in _places(own, bits):
                np.bitwise_or.at(held, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())], names=["marks"])

    table = np.zeros(1 << bits - 3, np.uint8)
    for r in keys.coalesce(4).mapInArrow(marks, "marks binary").toLocalIterator():
        table |= np.frombuffer(zlib.decompress(r["marks"]), np.uint8)
    sent = keys.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def held(x):
        import pandas as pd

        one, two = _places(x.to_numpy(), bits)
        t = sent.value
        return pd.Series((t[one >> 3] >> (one & 7) & t[two >> 3] >> (two & 7) & 1).astype(bool))

    return lambda c: c.isNotNull() & held(F.coalesce(c.cast("long"), F.lit(0)))


def with_partner(wide: DataFrame, key: str, keys: DataFrame, rows: int | None = None) -> DataFrame:
    """wide joined with the materialised keys on key. If keys is too large to broadcast, only rows that pass its member filter are shuffled: wide has texts."""
    if (count := keys.count()) <= (BROADCAST_ROWS if rows is None else rows):
        return wide.join(F.broadcast(keys), key)
    return wide.where(member_filter(keys.select(key), count)(F.col(key))).join(keys, key)


def without(wide: DataFrame, key: str, gone: DataFrame, gone_key: str, on: Column | str, rows: int | None = None) -> DataFrame:
    """wide without the rows that the materialised gone has by the condition on, which asks for equal keys. Only rows that pass gone's member filter are shuffled, if any are."""
    if (count := gone.count()) <= (BROADCAST_ROWS if rows is None else rows):
        return wide.join(F.broadcast(gone), on, "left_anti")
    maybe = member_filter(gone.select(gone_key), count)(F.col(key))
    return wide.where(~maybe).unionByName(wide.where(maybe).join(gone, on, "left_anti"))


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores ahead where a column (whatever its case) has the name already."""
    used, out = {c.lower() for c in taken}, []
    for n in wanted:
        while n.lower() in used:
            n = "_" + n
        used.add(n.lower())
        out.append(n)
    return out


def quoted(names: list[str]) -> list[Column]:
    """Columns by names that may hold dots or back-ticks."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


# ---- connected components -------------------------------------------------------------------------------------


#: Edges that one task contracts at once, about: 8 MB, and some 100 MB while it does.
RUN = 500_000


def min_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and the smallest node each can reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    lab = np.arange(len(nodes))
    while True:
        new = lab.copy()
        m = np.minimum(lab[a], lab[b])
        for side in (a, b, lab[a], lab[b]):
            np.minimum.at(new, side, m)
        while not np.array_equal(nxt := new[new], new):
            new = nxt
        if np.array_equal(new, lab):
            return nodes, nodes[lab]
        lab = new


def _contract(run: int):
    """Replace the edges of each run of batches by a star on each component's smallest node: never more edges than came in."""

    def stars(batches):
        held, n = [], 0

        def flush():
            t = pa.Table.from_batches(held)
            nodes, lab = min_labels(t.column(0).to_numpy(), t.column(1).to_numpy())
            keep = nodes != lab
            return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(lab[keep])], names=["u", "v"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= run:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return stars


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 200) -> DataFrame:
    """(node, component) for every node that an edge (a, b: long, not null) touches; component is the smallest reachable node.

    Runs of edges of bounded size are contracted in tasks of their own; if there is more than one run, alternating large-star
    and small-star rounds follow, each written to the shared folder. Nodes without edges aren't returned.
    Edges, nodes and components stay on the executors; the driver sees one count and one checksum a round. A node that is
    the hub of most edges is a minimum under partial aggregation, and its join is one that adaptive execution can split.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    e = scratch.write(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"))
    count = e.count()
    one = e.coalesce(max(1, -(-count // RUN))).mapInArrow(_contract(2 * RUN), "u long, v long")
    cur = scratch.write(one if count <= RUN else one.distinct())
    scratch.drop(e)
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = mark(cur)
    for _ in range(rounds if count > RUN else 0):  # what one run has contracted is done
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        nxt = big.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = scratch.write(nxt.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(cur)
        now, cur = mark(nxt), nxt
        if now == seen:
            break
        seen = now
    else:
        if count > RUN:
            raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


# ---- hashes over Arrow's text buffers -------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(salt: int = 1) -> np.ndarray:
    """A random 64-bit word for every byte value."""
    return mix64(np.arange(256, dtype=np.uint64) + np.uint64(salt << 32) + np.uint64(0x9E3779B97F4A7C15))


_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_STEP), -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64; the longest run asked for is kept."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 20), base, np.uint64)
        held[0] = 1
        _POWERS[int(base)] = held = np.multiply.accumulate(held)
    return held[:n]


class Rolling:
    """Hashes of any substring, from prefix sums of a polynomial modulo 2**64 over a random 64-bit word for each character."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers(n, _STEP), out=self.sums[1:])
        self.back = powers(n + 1, _INV)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_slices(col: pa.Array, most: int = 1 << 20):
    """Runs of a string column as (first row, byte offsets, bytes); a run has about so many bytes, or one text. Nulls are empty."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, off[i : j + 1] - off[i], data[off[i] : off[j]]
        i = j


# ---- candidates by shared keys --------------------------------------------------------------------------------


#: A row of keyed(): one id of a key in its run, the same where the run has others, and those others.
_ALONE, _FIRST, _OTHER = 0, 1, 2
_KEYED = "spread long, key long, id long, need int, role int"


def _combined(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A run's different (key, id), of which one id a key is dealt out by the key; others are known to share it and spread by id."""
    keys, ids, need = (np.concatenate([x[k] for x in held]) for k in range(3))
    order = np.lexsort((ids, keys))
    keys, ids, need = keys[order], ids[order], need[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
    keys, ids, need = keys[new], ids[new], need[new]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    more = first & np.concatenate([~first[1:], [False]])
    role = np.where(more, _FIRST, np.where(first, _ALONE, _OTHER)).astype(np.int32)
    spread = np.where(first, keys, ids)
    return pa.RecordBatch.from_arrays([pa.array(spread), pa.array(keys), pa.array(ids), pa.array(need.astype(np.int32)), pa.array(role)], names=["spread", "key", "id", "need", "role"])


def _shared(batches):
    """(key, id, need) of keys with several ids, from rows sorted by spread, key and id. A key's first row waits for a second id."""
    last, waits = None, None  # key and id of the row before; the row, if it hasn't been given out
    for b in batches:
        keys, ids, need, role = (b.column(k).to_numpy() for k in (1, 2, 3, 4))
        other = role == _OTHER
        out = [(keys[other], ids[other], need[other])]
        keys, ids, need, role = keys[~other], ids[~other], need[~other], role[~other]
        if len(keys):
            if last is not None and last[0] == keys[0]:
                if waits is not None:
                    keys, ids, need, role = (np.concatenate([[x], y]) for x, y in zip(waits, (keys, ids, need, role), strict=True))
                elif last[1] != ids[0]:  # the key is known to be shared
                    role = role.copy()
                    role[keys == keys[0]] = _FIRST
            run = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            end = np.concatenate([begin[1:], [len(keys)]]) - 1
            many = (ids[begin] != ids[end]) | (np.add.reduceat(role, begin) > 0)
            give = many[run]
            out.append((keys[give], ids[give], need[give]))
            last, waits = (keys[-1], ids[-1]), None if give[-1] else (keys[-1], ids[-1], need[-1], role[-1])
        k, i, n = (np.concatenate([x[c] for x in out]) for c in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(i, pa.int64()), pa.array(n, pa.int32())], names=["key", "id", "need"])


def keyed(items, most: int = 500_000):
    """Rows for candidates() from (keys, id, need) of one item each; what a task has gathered is combined before it is dealt out."""
    held, n = [], 0
    for keys, ids, need in items:
        held.append((keys, ids, need))
        n += len(keys)
        if n >= most:
            yield _combined(held)
            held, n = [], 0
    if n:
        yield _combined(held)


def candidates(items: DataFrame, run, scratch: Scratch, prune: int = 0) -> tuple[DataFrame, DataFrame]:
    """(node, component): parts of ids such that any two ids that share as many keys as either needs are in one; and (key, id, need) of the shared keys.

    run(batches of items) yields keyed() rows. A key that any number of ids has sends one row from each combined run, so no
    task gathers its ids; keys of one id aren't written. Then, so many times, ids that share fewer keys than they need are
    left out, and keys of one id again. Parts are the components of the graph that joins a key's ids to the least of them.
    """
    dealt = items.mapInArrow(run, _KEYED).repartition("spread").sortWithinPartitions("spread", "key", "id")
    held = scratch.write(dealt.mapInArrow(_shared, "key long, id long, need int"))
    for _ in range(prune):  # rows that two runs gave are counted twice: that keeps an id, and loses none
        enough = scratch.write(held.groupBy("id").agg(F.count("*").alias("n"), F.max("need").alias("least")).where("n >= least").select("id"))
        left = held.join(small(enough), "id", "left_semi")
        several = left.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
        nxt = scratch.write(left.join(several, "key", "left_semi"))
        scratch.drop(held)
        held = nxt
    heads = held.groupBy("key").agg(F.min("id").alias("head"))
    edges = scratch.write(held.join(heads, "key").where("id <> head").select("id", "head").distinct())
    return connected_components(edges, scratch), held


# ---- blocks of bounded size -----------------------------------------------------------------------------------


def runs(batches, column: int = 0):
    """The rows of sorted batches as one table for each run of equal values of a column; holds one run at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(column)
        codes = keys.dictionary_encode().indices.to_numpy() if not pa.types.is_integer(keys.type) else keys.to_numpy()
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = keys[i].as_py()
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over a block's rows whose labels are an array, so that all rows of other trees are one comparison away."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        self.label[self.label == max(a, b)] = min(a, b)


# ---- tokenizers -----------------------------------------------------------------------------------------------


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
