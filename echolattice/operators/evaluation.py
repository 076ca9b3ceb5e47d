"""Ranking and its scores: mean average precision, first hit, precision at k, ties.

Pairs are rows (query_idx, item_idx, query_label, item_label, distance). Ties go by item_idx, a query never ranks itself, and
distances that aren't finite share the end. A query without a relevant item is an error, never a score of 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolattice.functions.sequences import is_finite, rank_key
from echolattice.functions.workers import ship
from echolattice.operators import rankings

#: A matrix of at most so many bytes is sent to every executor; a larger one goes through the pair table.
BROADCAST_BYTES = 128 << 20
SCORES = "map double, mr1 double, p_at_k double, n_queries long, tie_fraction double"


def rank_pairs(pairs: DataFrame) -> DataFrame:
    """Adds rank (from 1), rel, hits so far, and whether the distance before is as finite, or equal. One shuffle, by query."""
    own = Window.partitionBy("query_idx").orderBy(rank_key(F.col("distance")), "item_idx")
    before = F.lag("distance").over(own)
    valid = is_finite(F.col("distance")) & is_finite(before)
    rel = (F.col("query_label") == F.col("item_label")).cast("int")
    ranked = pairs.where("query_idx <> item_idx").withColumns({"rank": F.row_number().over(own), "rel": rel, "valid": F.coalesce(valid, F.lit(False)).cast("int")})
    ranked = ranked.withColumn("tie", F.when(F.col("valid") == 1, (F.col("distance") == before).cast("int")).otherwise(0))
    return ranked.withColumn("hits", F.sum("rel").over(own.rowsBetween(Window.unboundedPreceding, 0)))


def score_queries(pairs: DataFrame, k: int = 10) -> DataFrame:
    """query_idx, ap, r1, p_at_k, n_relevant, ties, valid_pairs."""
    n = F.sum("rel")
    relevant = F.when(n > 0, n).otherwise(F.raise_error(F.concat(F.lit("no relevant item for query "), F.first("query_idx").cast("string"), F.lit(" of "), F.first("query_label").cast("string"))).cast("long"))
    out = rank_pairs(pairs).groupBy("query_idx").agg(
        (F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)) / relevant).alias("ap"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).cast("long").alias("r1"),
        (F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)) / F.least(F.lit(k), F.count("*"))).alias("p_at_k"),
        n.alias("n_relevant"),
        F.sum("tie").alias("ties"),
        F.sum("valid").alias("valid_pairs"),
    )
    return out


def summarize(scores: DataFrame, *by: str) -> DataFrame:
    """One row (a group) of scores: means over queries, ties pooled over all adjacent finite pairs."""
    r = lambda c: F.round(c, 6)
    ties = F.when(F.sum("valid_pairs") > 0, F.sum("ties") / F.sum("valid_pairs")).otherwise(0.0)
    return scores.groupBy(*by).agg(r(F.avg("ap")).alias("map"), r(F.avg("r1")).alias("mr1"), r(F.avg("p_at_k")).alias("p_at_k"), F.count("*").alias("n_queries"), r(ties).alias("tie_fraction"))


def evaluate(pairs: DataFrame, k: int = 10) -> DataFrame:
    return summarize(score_queries(pairs, k))


def evaluate_chunked(pairs: DataFrame, chunk: int, k: int = 10) -> DataFrame:
    """summarize_chunked() of the scores of pairs."""
    return summarize_chunked(score_queries(pairs, k), chunk)


def summarize_chunked(scores: DataFrame, chunk: int) -> DataFrame:
    """Scores of chunks of queries, put together again: sums and counts are kept, so that any chunk gives the whole's scores."""
    scores = scores.withColumn("chunk", F.floor(F.col("query_idx") / chunk))
    parts = scores.groupBy("chunk").agg(*(F.sum(c).alias(c) for c in ("ap", "r1", "p_at_k", "ties", "valid_pairs")), F.count("*").alias("n"))
    n, r = F.sum("n"), lambda c: F.round(c, 6)
    ties = F.when(F.sum("valid_pairs") > 0, F.sum("ties") / F.sum("valid_pairs")).otherwise(0.0)
    return parts.agg(r(F.sum("ap") / n).alias("map"), r(F.sum("r1") / n).alias("mr1"), r(F.sum("p_at_k") / n).alias("p_at_k"), n.alias("n_queries"), r(ties).alias("tie_fraction"), F.count("*").alias("n_chunks"))


def rank_curve(scores: DataFrame, n_items: int) -> DataFrame:
    """rank, share: of the queries, those whose first hit is at that rank or before, for every rank up to n_items - 1."""
    hist = scores.groupBy(F.col("r1").alias("rank")).agg(F.count("*").alias("n"))
    ranks = scores.sparkSession.range(1, n_items).select(F.col("id").alias("rank"))
    run = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # a row for each rank, n_items - 1 in all
    both = ranks.join(hist, "rank", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = scores.agg(F.count("*").alias("total"))
    return both.withColumn("upto", F.sum("n").over(run)).crossJoin(F.broadcast(total)).select("rank", F.round(F.col("upto") / F.col("total"), 6).alias("share"))


def score_block(distance: np.ndarray, own: np.ndarray, labels: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Scores of a block of queries from their distances to all items in ascending item order; own: each query's column."""
    q, n = distance.shape
    key = np.where(np.isfinite(distance), distance, np.inf)
    order = np.argsort(key, axis=1, kind="stable")
    order = order[order != own[:, None]].reshape(q, n - 1)
    rel = labels[order] == labels[own][:, None]
    hits, rank = np.cumsum(rel, axis=1), np.arange(1, n)
    found = rel.sum(axis=1)
    if (found == 0).any():
        raise ValueError(f"no relevant item for the query in column {int(own[np.argmin(found)])}")
    d = np.take_along_axis(distance, order, axis=1)
    fin = np.isfinite(d)
    valid = fin[:, 1:] & fin[:, :-1]
    kk = min(k, n - 1)
    return {
        "ap": (rel * hits / rank).sum(axis=1) / found,
        "r1": rel.argmax(axis=1) + 1,
        "p_at_k": rel[:, :kk].sum(axis=1) / kk,
        "n_relevant": found,
        "ties": (valid & (d[:, 1:] == d[:, :-1])).sum(axis=1),
        "valid_pairs": valid.sum(axis=1),
    }


def score_vectors(items: DataFrame, pairs, k: int = 10, decimals: int | None = 6, block: int = 256, distance=None) -> DataFrame:
    """score_queries for the distances of items(item_idx, label, vec) without a pair table; by default cosine distances.

    Every item whose label another item has is a query. If the matrix fits BROADCAST_BYTES it is sent to the executors, and a
    task scores blocks of queries by one matrix each; nothing is shuffled but the queries' ids. Else pairs(items)
    makes the pair table. decimals: distances are rounded to so many before they are ranked; None takes them as float32.
    distance(ids, rows, all ids, all rows): another distance, of a block of items from all, new at every call; long if whole numbers say its
    order exactly, all less than rankings.LAST.
    """
    ship(items.sparkSession)
    items = items.select("item_idx", "label", "vec").persist()  # vectors may be costly, and are asked for twice
    n, dims = items.agg(F.count("*"), F.max(F.size("vec"))).first()
    if n * ((dims or 0) + 2) * 8 > BROADCAST_BYTES:
        items.unpersist()
        return score_queries(pairs(items), k)
    t = items.orderBy("item_idx").toArrow()
    items.unpersist()
    labels = np.asarray(t.column("label").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False))
    ids, x = t.column("item_idx").to_numpy(), np.asarray(t.column("vec").combine_chunks().flatten(), np.float64).reshape(n, -1 if n and dims else 0)
    if distance is None:
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        x = x / np.maximum(norm, 1e-9)[:, None]
    held = items.sparkSession.sparkContext.broadcast((ids, labels, x))
    size = np.bincount(labels[labels >= 0], minlength=1)
    queries = np.flatnonzero((labels >= 0) & (size[np.maximum(labels, 0)] > 1))
    fields = [("ap", pa.float64()), ("r1", pa.int64()), ("p_at_k", pa.float64()), ("n_relevant", pa.int64()), ("ties", pa.int64()), ("valid_pairs", pa.int64())]

    def run(batches):
        ids, labels, x = held.value
        for b in batches:
            own = b.column(0).to_numpy()
            step = max(1, min(block, rankings.CELLS // len(ids)))
            for i in range(0, len(own), step):
                q = own[i : i + step]
                d = 1 - x[q] @ x.T if distance is None else distance(ids[q], x[q], ids, x)
                if d.dtype == np.int64:
                    s = rankings.score_distances(d, q, labels, k)
                elif decimals is not None and len(ids) > 1 and np.abs(d).max(initial=0, where=np.isfinite(d)) * 10.0**decimals < rankings.LAST:
                    s = rankings.score_distances(rankings.decimal_codes(d, 10.0**decimals), q, labels, k)
                else:
                    d = np.round(d, decimals) if decimals is not None else d.astype(np.float32).astype(np.float64)
                    s = score_block(d, q, labels, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), *(pa.array(s[f], t) for f, t in fields)], names=["query_idx", *(f for f, _ in fields)])

    spark = items.sparkSession
    at = spark.createDataFrame(pa.table({"at": pa.array(queries, pa.int64())})) if len(queries) else spark.createDataFrame([], "at long")
    parts = max(1, min(12 * spark.sparkContext.defaultParallelism, -(-len(queries) // block)))  # small ones, for the last to end together
    return at.repartition(parts).mapInArrow(run, "query_idx long, ap double, r1 long, p_at_k double, n_relevant long, ties long, valid_pairs long")


def length_distance(_, own: np.ndarray, __, every: np.ndarray) -> np.ndarray:
    """Differences of the one number that the rows have."""
    return np.abs(own[:, :1] - every[:, 0][None, :])


def random_distance(seed: int):
    """The draw of similarity.random_pairs, by the same digest, as the whole number that it is a share of 2^32 of."""

    def draw(own: np.ndarray, _, every: np.ndarray, __) -> np.ndarray:
        if held.get("ids") is not every:
            held.update(ids=every, draws=rankings.Draws(seed, every))
        return held["draws"].block(own)

    held: dict = {}
    return draw
