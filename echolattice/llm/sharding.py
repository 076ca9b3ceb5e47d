"""Sharding: a Feistel permutation with cycle walking over global row numbers gives a reproducible shuffle.

Row r of n (rows in key order, counted from 0) goes to position p = permute(r, n, seed); its shard is p mod shards and its
slot p div shards. Both can be computed for any row, and the row for any shard and slot, without a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolattice.llm.common import Scratch, fresh, quoted, ship

ROUNDS = 6
#: Multipliers of the round function. Products with a half of at most 31 bits stay inside a signed 64-bit word.
M1, M2, LOW31 = 2654435761, 1103515245, (1 << 31) - 1


def round_keys(seed: int) -> list[int]:
    out, x = [], (seed * 2 + 1) & LOW31
    for _ in range(ROUNDS):
        x = (x * M2 + 12345) & LOW31
        out.append(x)
    return out


def half_bits(n: int) -> int:
    """Bits of each half of the smallest balanced Feistel domain that holds n rows."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(r: np.ndarray, key: int, w: int) -> np.ndarray:
    x = r * M1 + key
    x = (x ^ (x >> 15)) & LOW31
    x = x * M2 + key
    return ((x ^ (x >> 17)) >> 7) & ((1 << w) - 1)


def _once(x: np.ndarray, keys: list[int], w: int) -> np.ndarray:
    left, right = x >> w, x & ((1 << w) - 1)
    for k in keys:
        left, right = right, left ^ _round(right, k, w)
    return (left << w) | right


def _back(x: np.ndarray, keys: list[int], w: int) -> np.ndarray:
    left, right = x >> w, x & ((1 << w) - 1)
    for k in reversed(keys):
        left, right = right ^ _round(left, k, w), left
    return (left << w) | right


def _walk(step, x: np.ndarray, n: int, seed: int) -> np.ndarray:
    if n > 1 << 62:
        raise ValueError("more rows than a 62-bit domain holds")
    w, keys = half_bits(n), round_keys(seed)
    out = step(np.asarray(x, np.int64), keys, w)
    while (far := out >= n).any():  # cycle walking: the domain is under 4 n, so a walk has under 4 steps on average
        out[far] = step(out[far], keys, w)
    return out


def permute(rows, n: int, seed: int = 0) -> np.ndarray:
    """Positions of row numbers 0 <= r < n under the permutation."""
    return _walk(_once, rows, n, seed)


def unpermute(positions, n: int, seed: int = 0) -> np.ndarray:
    """Row numbers of positions: the inverse of permute."""
    return _walk(_back, positions, n, seed)


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = int(permute([row], n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """Row number at a shard's slot."""
    return int(unpermute([slot * shards + shard], n, seed)[0])


def _numbered(df: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """(row, number): the rows of df as structs, numbered from 0 in the order of keys, then of the other columns."""
    names = df.columns
    by = [F.col("row").getField(c) for c in (*keys, *(c for c in names if c not in keys))]
    ranged = df.select(F.struct(*quoted(names)).alias("row")).repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    held = scratch.write(ranged.select("row", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("at")))
    sizes = held.groupBy("part").agg(F.count("*").alias("n"))  # as many rows as partitions
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    return held.join(F.broadcast(starts), "part").select("row", (F.col("start") + F.col("at")).alias("number"))


def number_rows(df: DataFrame, keys: list[str], scratch: Scratch, name: str = "row_number") -> DataFrame:
    """df and, as its last column, dense numbers from 0 in the order of keys. No task sorts more than its range; ties are ordered by the other columns.

    Where df has a column of that name, the numbers' has underscores ahead.
    """
    own = [F.col("row").getField(c).alias(c) for c in df.columns]
    return _numbered(df, keys, scratch).select(*own, F.col("number").alias(fresh(df.columns, name)[0]))


def shard_rows(df: DataFrame, keys: list[str], shards: int, scratch: Scratch, seed: int = 0) -> DataFrame:
    """df and, as its last columns, row_number, shard and slot. Shards' row counts differ by one at most; slots are gapless from 0.

    The result depends on the rows, the key order, the number of rows, shards and seed, and not on how df is partitioned.
    Nulls sort first; rows that are equal in every column are interchangeable; an empty table stays empty. Where df has a
    column of one of the three names, the added one has underscores ahead.
    """
    ship(df.sparkSession)
    numbered = _numbered(df, keys, scratch)
    n = numbered.count()

    @F.pandas_udf("long")
    def position(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    placed = numbered.select("row", "number", position("number").alias("place"))
    own = [F.col("row").getField(c).alias(c) for c in df.columns]
    number, shard, slot = fresh(df.columns, "row_number", "shard", "slot")
    return placed.select(*own, F.col("number").alias(number), (F.col("place") % shards).cast("int").alias(shard), F.expr(f"place div {shards}").alias(slot))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def op3_feistel_shards(spark: SparkSession, sf_dir: str, shards: int = 40, seed: int = 17) -> DataFrame:
    """All documents in shards 0 to 39 under the law "rows".

    Null texts have size 16 and the checksum of no bytes (0). Rows that repeat a doc_id are numbered one after the other.
    Only the keys, sizes and checksums are moved; texts are read once and stay where they are.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = scratch.write(docs.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    out = shard_rows(slim, ["doc_id"], shards, scratch, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def oracle() -> str:
    """The same table in DuckDB's SQL: byte-wise CRC-32 over a table made by its rule, and the permutation as a recursive walk."""

    def feistel(x: str) -> str:
        # nested scalar subqueries would repeat the halves, so the rounds fold over a list of keys
        keys = "[" + ", ".join(f"{k}::BIGINT" for k in round_keys(17)) + "]"
        a = f"(s.r * {M1} + k)"
        b = f"((xor({a}, {a} >> 15) & {LOW31}) * {M2} + k)"
        f = f"((xor({b}, {b} >> 17) >> 7) & ((1::BIGINT << w) - 1))"
        start = f"{{'l': ({x}) >> w, 'r': ({x}) & ((1::BIGINT << w) - 1), 'k': 0::BIGINT}}"
        listed = f"list_concat([{start}], list_transform({keys}, lambda k: {{'l': 0::BIGINT, 'r': 0::BIGINT, 'k': k}}))"
        step = f"list_reduce({listed}, lambda s, t: {{'l': s.r, 'r': xor(s.l, {f.replace('+ k', '+ t.k')}), 'k': 0::BIGINT}})"
        return step

    return f"""
WITH RECURSIVE
crc_table AS (
  SELECT list(list_reduce(list_concat([i::BIGINT], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
numbered AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 16 AS size, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS row_number,
         xor(list_reduce(list_concat([4294967295::BIGINT],
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM documents, crc_table),
dom AS (
  SELECT n, greatest(1, (len(bin(greatest(n - 1, 1))) + 1) // 2)::BIGINT AS w FROM (SELECT count(*) AS n FROM documents)),
walk AS (
  SELECT row_number, row_number::BIGINT AS p, 0 AS steps FROM numbered
  UNION ALL
  SELECT row_number, (x.l << w) | x.r, steps + 1
  FROM (SELECT row_number, steps, w, {feistel("p")} AS x FROM walk, dom WHERE steps = 0 OR p >= n)),
place AS (SELECT row_number, arg_max(p, steps) AS p FROM walk GROUP BY row_number)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % 40)::INTEGER AS shard, p // 40 AS slot,
       NULL::INTEGER AS grown_shard, row_number
FROM numbered JOIN place USING (row_number)
"""
