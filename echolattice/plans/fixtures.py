"""The tables that the queries read as collections: embeddings as items, suppliers' weekly shipments as sequences of frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolattice.functions.sequences import PITCHES
from echolattice.functions.workers import ship

EPOCH = "1995-01-02"
#: Rows that are combined at once before a shuffle, and performances whose frames are made at once.
GATHERED, ROWS = 1 << 20, 64


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (item_idx, label, vec)."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_idx"), "label", F.col("embedding").cast("array<double>").alias("vec"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(perf_id, frame, pitch, x): a supplier's shipped quantity by week and part number modulo 12."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    week = F.floor(F.datediff(F.to_date("l_shipdate"), F.lit(EPOCH)) / 7).cast("int")
    return rows.groupBy(F.col("l_suppkey").alias("perf_id"), week.alias("frame"), (F.col("l_partkey") % PITCHES).cast("int").alias("pitch")).agg(F.sum("l_quantity").alias("x"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as performances of their nation; n_frames is their number of weeks with shipments."""
    shipped = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    week = F.floor(F.datediff(F.to_date("l_shipdate"), F.lit(EPOCH)) / 7)
    weeks = shipped.groupBy(F.col("l_suppkey").alias("perf_id")).agg(F.countDistinct(week).alias("n_frames"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("perf_id"), F.col("s_nationkey").alias("clique_id"))
    return rows.join(weeks, "perf_id", "left")


def _gathered(batches):
    """Sums by cell of each performance's rows (perf_id, cell, x), as lists; a row without a cell counts as a silent performance's."""
    held: list[pa.RecordBatch] = []

    def lists():
        t = pa.Table.from_batches(held).combine_chunks()
        known = t.column("perf_id").is_valid().to_numpy()
        ids = t.column("perf_id").fill_null(0).to_numpy()[known]
        cell, x = (t.column(c).fill_null(v).to_numpy()[known] for c, v in (("cell", -1), ("x", 0.0)))
        order = np.lexsort((cell, ids))
        ids, cell, x = ids[order], cell[order], x[order]
        at = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (cell[1:] != cell[:-1]))[: len(ids)])
        x = np.add.reduceat(x, at) if len(at) else x
        ids, cell = ids[at], cell[at]
        own = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
        cuts = pa.array(np.append(own, len(ids)), pa.int32())
        kind = t.schema.field("perf_id").type
        made = [pa.array(ids[own], kind), *(pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (cell, x))]
        if not known.all():
            made = [pa.concat_arrays([a, b]) for a, b in zip(made, (pa.nulls(1, kind), pa.array([[]], made[1].type), pa.array([[]], made[2].type)), strict=True)]
        for k in range(0, len(made[0]), ROWS):
            yield pa.RecordBatch.from_arrays([a.slice(k, ROWS) for a in made], names=["perf_id", "cells", "xs"])

    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= GATHERED:
            yield from lists()
            held = []
    if held:
        yield from lists()


def _dense(last: int):
    """Frames 0 to last of rows that end in lists of cells and of their sums."""
    size = (last + 1) * PITCHES

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                cells, xs = b.column("cells"), b.column("xs")
                row = np.repeat(np.arange(b.num_rows), cells.value_lengths().fill_null(0).to_numpy())
                cell = cells.flatten().to_numpy()
                some = cell >= 0
                flat = np.bincount(row[some] * size + cell[some], xs.flatten().to_numpy()[some], minlength=b.num_rows * size).astype(np.float64)  # whole numbers if there is no cell
                cuts = [pa.array(np.arange(0, n + 1, step), pa.int32()) for n, step in ((len(flat), PITCHES), (b.num_rows * (last + 1), last + 1))]
                frames = pa.ListArray.from_arrays(cuts[1], pa.ListArray.from_arrays(cuts[0], pa.array(flat)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], frames], names=[*b.schema.names[:-2], "frames"])

    return run


def frames(spark: SparkSession, sf_dir: str, names: DataFrame | None = None, only: list | None = None) -> DataFrame:
    """(perf_id, frames): all weeks up to the last of any supplier, missing cells 0.

    names: a table with perf_id whose columns come too, of performances that it has. only: of these performances. What is
    shuffled is the cells that there are, combined before; frames are made after the last shuffle.
    """
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    week = F.floor(F.datediff(F.to_date("l_shipdate"), F.lit(EPOCH)) / 7).cast("int")
    pitch = (F.col("l_partkey") % PITCHES).cast("int")
    last = max(rows.agg(F.max(week)).first()[0] or 0, 0)
    slim = rows.select(F.col("l_suppkey").alias("perf_id"), F.when((week >= 0) & (pitch >= 0), week * PITCHES + pitch).alias("cell"), F.col("l_quantity").cast("double").alias("x"))
    if only is not None:
        slim = slim.where(F.col("perf_id").isin(only))
    kind = T.StructType([slim.schema["perf_id"], T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("xs", T.ArrayType(T.DoubleType()))])
    each = slim.mapInArrow(_gathered, kind).groupBy("perf_id").agg(F.collect_list(F.struct("cells", "xs")).alias("p"))
    if names is not None:
        each = each.join(names, "perf_id")
    each = each.select(*(c for c in each.columns if c != "p"), F.flatten("p.cells").alias("cells"), F.flatten("p.xs").alias("xs"))
    return each.mapInArrow(_dense(last), T.StructType([*each.schema.fields[:-2], T.StructField("frames", T.ArrayType(T.ArrayType(T.DoubleType())))]))


def performances(spark: SparkSession, sf_dir: str, only: list | None = None) -> DataFrame:
    """(item_idx, label, frames) of all suppliers; only: of these."""
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("perf_id"), F.col("s_nationkey").alias("label"))
    return frames(spark, sf_dir, names, only).select(F.col("perf_id").alias("item_idx"), "label", "frames")
