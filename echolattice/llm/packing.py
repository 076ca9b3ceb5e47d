"""Packing: sequences of 2048 tokens as a cutting-stock problem, solved by column generation.

A document is cut at every 2048 of its ids; what remains has a length class, its length in steps of GRAIN, rounded up. The
histogram of classes is a demand, a sequence a roll of 2048 / GRAIN steps. A linear program over patterns (how many pieces
of each class a sequence takes) is solved by the revised simplex method; a knapsack by dynamic programming prices the next
column. Rounded-down pattern counts, and first-fit patterns for what the rounding leaves, are dealt to the pieces by their
rank in their class. The driver has the histogram and the patterns, whose sizes depend on 2048 and GRAIN alone.

Lengths that go badly with all others, such as very many of just over half a sequence, are cut once more, into binary parts:
1024, 512, 256, 128 and 64 tokens where they are in the length, and what is under 64. Which classes are cut follows from the
patterns' waste; the parts' checksums come from the one pass over the texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolattice.llm.common import Scratch, ship, text_slices, tokenizer_path
from echolattice.llm.tokens import ByteLevel, encoder

LENGTH, GRAIN, END_ID = 2048, 8, 1
#: Pieces of a class that one task ranks, about.
RANKED = 1_000
#: Binary parts in steps of PART tokens, largest first; share of padding at which no more classes are cut.
PART, BITS, WASTE = 64, (16, 8, 4, 2, 1), 0.004


def part_lengths(length: int) -> list[int]:
    """Binary parts of a length under 2048."""
    return [PART * b for b in BITS if length // PART & b] + ([length % PART] if length % PART else [])


def price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the greatest total value of sizes that fit in room, and how often each is taken."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for j in range(1, room + 1):
        fit = sizes <= j
        gain = np.where(fit, best[np.maximum(j - sizes, 0)] + values, -1.0)
        k = int(gain.argmax())
        best[j], took[j] = best[j - 1], -2
        if gain[k] > best[j - 1] + 1e-12:
            best[j], took[j] = gain[k], k
    out, j = np.zeros(len(sizes), np.int64), room
    while j > 0 and took[j] != -1:
        if took[j] == -2:
            j -= 1
        else:
            out[took[j]] += 1
            j -= int(sizes[took[j]])
    return float(best[room]), out


def relaxed(sizes: np.ndarray, demand: np.ndarray, room: int, most: int = 5_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often each is used in the linear program's solution; any round's basis is feasible."""
    m = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    use = inverse @ demand
    for step in range(most):
        if use.sum() - sizes @ demand / room < 0.5:  # the volume's bound: no whole sequence to save
            break
        dual = inverse.sum(axis=0)
        value, column = price(np.maximum(dual, 0), sizes, room)
        if value <= 1 + 1e-7 or use.sum() * (1 - 1 / value) < 0.5:  # use.sum() / value bounds the optimum: no whole sequence to save
            break
        way = inverse @ column
        ratio = np.where(way > 1e-9, use / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        use = use - ratio[out] * way
        use[out] = ratio[out]
        pivot = inverse[out] / way[out]
        inverse = inverse - np.outer(way, pivot)
        inverse[out] = pivot
        basis[:, out] = column
        if step % 200 == 199:
            # a Newton step against rounding; einsum stays in this thread, where a solver's threads could outlive a fork
            inverse = 2 * inverse - np.einsum("ij,jk->ik", inverse, np.einsum("ij,jk->ik", basis, inverse))
            use = inverse @ demand
    return basis.astype(np.int64), np.maximum(use, 0)


def fill(sizes: np.ndarray, left: np.ndarray, room: int, order: list[int]) -> np.ndarray:
    """The largest piece left and, of the others, those that leave least room: subset sums as bits, smaller pieces first found last."""
    column = np.zeros(len(sizes), np.int64)
    order = [k for k in order if left[k]]
    column[order[0]] = 1
    free, reach, steps = room - int(sizes[order[0]]), 1, []
    for k in order:
        n, part = min(int(left[k] - column[k]), free // int(sizes[k])), 1
        while n > 0:
            c = min(part, n)
            steps.append((reach, k, c))
            reach |= (reach << (c * int(sizes[k]))) & ((2 << free) - 1)
            n, part = n - c, part * 2
    at = reach.bit_length() - 1
    for before, k, c in reversed(steps):
        if not before >> at & 1:
            column[k] += c
            at -= c * int(sizes[k])
    return column


def plan(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """(pieces of each class, sequences) patterns that meet the demand exactly."""
    if not len(sizes):
        return []
    patterns, use = relaxed(sizes, demand.astype(float), room)
    left, out = demand.copy(), []
    for k in np.argsort(-use, kind="stable"):
        n = int(np.floor(use[k] + 1e-9))
        column = patterns[:, k]
        if column.any():
            n = min(n, int((left[column > 0] // column[column > 0]).min()))
            if n > 0:
                out.append((column, n))
                left = left - n * column
    order = [int(k) for k in np.argsort(-sizes, kind="stable")]
    while left.any():
        column = fill(sizes, left, room, order)
        n = int((left[column > 0] // column[column > 0]).min())
        out.append((column, n))
        left = left - n * column
    return out


def plan_with_cuts(sizes: np.ndarray, demand: np.ndarray, room: int, grain: int, waste: float = WASTE) -> tuple[list[int], np.ndarray, list[tuple[np.ndarray, int]]]:
    """Classes that are cut into binary parts, all classes after that, and the patterns for them.

    In each round the classes that stand for most of the unfilled steps of patterns, half of them in all, are cut.
    """
    cut: list[int] = []
    while True:
        want: dict[int, int] = {}
        for c, n in zip(sizes.tolist(), demand.tolist(), strict=True):
            for x in part_lengths(c * grain) if c in cut else [c * grain]:
                want[x // grain] = want.get(x // grain, 0) + n
        own = np.array(sorted(want), np.int64)
        patterns = plan(own, np.array([want[c] for c in own.tolist()], np.int64), room)
        total = int(sizes @ demand)
        spare = {}
        for column, n in patterns[:-1]:  # the last may be what nothing is left to fill
            free = room - int(own @ column)
            for k in np.flatnonzero(column):
                c = int(own[k])
                if c not in cut and c in sizes and c < room and len(part_lengths(c * grain)) > 1:
                    spare[c] = spare.get(c, 0) + free * n * int(column[k]) * c / room
        if sum(n * (room - int(own @ x)) for x, n in patterns) <= waste * total + room or not spare:
            return cut, own, patterns
        most, part = sum(spare.values()), 0.0
        for c in sorted(spare, key=lambda c: -spare[c]):
            cut.append(c)
            part += spare[c]
            if part >= most / 2:
                break


class Places:
    """Sequence of the piece of a rank in its class, by the intervals of ranks that each pattern takes."""

    def __init__(self, sizes: np.ndarray, patterns: list[tuple[np.ndarray, int]]):
        rows, base = {int(s): [] for s in sizes}, 0
        for column, n in patterns:
            for k in np.flatnonzero(column):
                rows[int(sizes[k])].append((int(column[k]), n, base))
            base += n
        self.sequences = base
        self.by = {}
        for s, x in rows.items():
            each, n, first = (np.array(v, np.int64) for v in zip(*x, strict=True)) if x else (np.zeros(0, np.int64),) * 3
            self.by[s] = (np.concatenate([[0], np.cumsum(each * n)]), n, first)

    def __call__(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(size), np.int64)
        for s in np.unique(size):
            own = np.flatnonzero(size == s)
            lo, n, first = self.by[int(s)]
            k = np.searchsorted(lo, rank[own], "right") - 1
            # neighbours in rank go to different sequences, so that a sequence mixes documents
            out[own] = first[k] + (rank[own] - lo[k]) % n[k]
        return out


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, and parts, the checksums of its binary parts (none of a full one).

    One pass over docs(doc_id, text); a null text is empty.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches):
        enc = encoder(ByteLevel, path)
        for b in batches:
            text, keys = b.column(1).fill_null(""), b.column(0)
            for i, off, _ in text_slices(text):
                rows = len(off) - 1
                flat, ends = enc(text.slice(i, rows).to_pylist())
                n = np.diff(ends) + 1
                each = -(-n // length)
                doc = np.repeat(np.arange(rows), each)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * length
                size = np.minimum(n[doc] - start, length)
                raw, tail = memoryview(flat.astype("<u4").tobytes()), np.array([end_id], "<u4").tobytes()

                def checksum(a: int, z: int, last: bool) -> int:
                    c = zlib.crc32(raw[4 * a : 4 * (z - last)])
                    return zlib.crc32(tail, c) if last else c

                crc, parts = [], []
                for a, k, last in zip((ends[doc] + start).tolist(), size.tolist(), (start + size == n[doc]).tolist(), strict=True):
                    crc.append(checksum(a, a + k, last))
                    own = []
                    if k < length:
                        at = a
                        for x in part_lengths(k):
                            own.append(checksum(at, at + x, last and at + x == a + k))
                            at += x
                    parts.append(own)
                ids = keys.slice(i, rows).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (start, size, crc, n[doc])), pa.array(parts, pa.list_(pa.int64()))], names=[*names, "parts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, ", ".join(f"{x} long" for x in names) + ", parts array<long>")


def pack(docs: DataFrame, path: str, scratch: Scratch, length: int = LENGTH, grain: int = GRAIN, end_id: int = END_ID) -> DataFrame:
    """Every piece of docs(doc_id, text) with sequence_id and offset; offsets of a sequence are gapless from 0.

    Null and empty texts are the end id alone; rows that repeat a doc_id are documents of their own; an empty table gives
    no rows; other columns of docs are ignored.
    """
    steps = F.ceil(F.col("length") / grain).cast("int")
    whole = scratch.write(pieces(docs, path, length, end_id).withColumn("_class", steps))
    sizes = whole.groupBy("_class").agg(F.count("*").alias("n")).orderBy("_class").collect()  # at most length / grain rows
    room = length // grain
    cut, size, patterns = plan_with_cuts(np.array([r["_class"] for r in sizes], np.int64), np.array([r["n"] for r in sizes], np.int64), room, grain)
    places = Places(size, patterns)
    bits = F.filter(F.array(*map(F.lit, BITS)), lambda b: F.floor(F.col("length") / PART).bitwiseAND(b) > 0)
    rest = F.col("length") % PART
    binary = F.concat(F.transform(bits, lambda b: (b * PART).cast("long")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    parts = whole.where(F.col("_class").isin(cut)).withColumn("_binary", binary)
    parts = parts.select("*", F.posexplode("_binary").alias("_k", "_size"))
    ahead = F.aggregate(F.slice("_binary", 1, F.col("_k")), F.lit(0).cast("long"), lambda a, x: a + x)
    parts = parts.select("doc_id", (F.col("start") + ahead).alias("start"), F.col("_size").alias("length"), F.get("parts", F.col("_k")).alias("ids_crc32"), "doc_tokens").withColumn("_class", steps)
    held = whole.where(~F.col("_class").isin(cut)).drop("parts").unionByName(parts) if cut else whole.drop("parts")
    demand = {c: sum(int(x[k]) * n for x, n in patterns) for k, c in enumerate(size.tolist())}
    # Ranks in a class: by bucket, then in the bucket, so that a class of any size is ranked by many tasks.
    buckets = max(1, -(-max(demand.values(), default=1) // RANKED))
    order = ["doc_id", "start", "doc_tokens", "ids_crc32"]
    dealt = held.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    own = Window.partitionBy("_class", "_bucket")
    counts = dealt.groupBy("_class", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = scratch.write(counts.select("_class", "_bucket", F.coalesce(before, F.lit(0)).alias("_before")))
    ranked = dealt.withColumn("_in", F.row_number().over(own.orderBy(F.desc("length"), *order)) - 1)
    ranked = ranked.join(starts, ["_class", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_in"))

    @F.pandas_udf("long")
    def sequence(size, rank):
        import pandas as pd

        return pd.Series(places(size.to_numpy(), rank.to_numpy()))

    placed = ranked.withColumn("sequence_id", sequence("_class", "_rank"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), Scratch(spark, "packing"))
