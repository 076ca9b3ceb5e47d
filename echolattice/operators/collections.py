"""Collections of a catalog: catalog rows (perf_id, clique_id, ...), cliques as ground truth, all draws by a reproducible key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolattice.functions.sequences import md5_key


def clique_sizes(catalog: DataFrame) -> DataFrame:
    """clique_id, n; rows without a clique are in none."""
    return catalog.where("clique_id is not null").groupBy("clique_id").agg(F.count("*").alias("n"))


def with_query_mask(catalog: DataFrame) -> DataFrame:
    """Adds clique_size and is_query: another row of this very table has the clique. Without a clique neither holds."""
    sizes = clique_sizes(catalog)
    out = catalog.join(sizes, "clique_id", "left").withColumnRenamed("n", "clique_size")
    return out.withColumn("clique_size", F.coalesce("clique_size", F.lit(0).cast("long"))).withColumn("is_query", F.col("clique_size") > 1).select(*catalog.columns, "clique_size", "is_query")


def numbered(catalog: DataFrame) -> DataFrame:
    """Adds item_idx from 0, by clique_id (nulls first) and perf_id: identity is the place in the selected collection.

    Places are worked out on the keys alone: cliques are added up, the running total goes over a row for each clique, and a
    clique's members are placed among themselves; frames and other columns come by a join.
    """
    keys = catalog.select("clique_id", "perf_id")
    sizes = keys.groupBy("clique_id").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.col("clique_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("clique_id", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("clique_id").orderBy("perf_id")) - 1
    placed = keys.withColumn("at", inside).alias("k").join(starts.alias("s"), F.col("k.clique_id").eqNullSafe(F.col("s.clique_id")))
    places = placed.select(F.col("k.perf_id").alias("perf_id"), (F.col("start") + F.col("at")).cast("long").alias("item_idx"))
    return catalog.join(places, "perf_id").select(*catalog.columns, "item_idx")


def select_cliques(catalog: DataFrame, cliques: DataFrame | None = None, with_distractors: bool = True) -> DataFrame:
    """Rows of the cliques (default: all that aren't singletons, rows without a clique among them), and singletons if wanted.

    Whether a clique is a singleton is judged on the whole table.
    """
    sizes = clique_sizes(catalog)
    flagged = catalog.join(sizes.where("n = 1").select("clique_id", F.lit(True).alias("_one")), "clique_id", "left")
    one = F.coalesce("_one", F.lit(False))
    if cliques is None:
        return flagged.where(~one | F.lit(with_distractors)).select(*catalog.columns)
    marked = flagged.join(cliques.select("clique_id", F.lit(True).alias("_in")).distinct(), "clique_id", "left")
    return marked.where(F.coalesce("_in", F.lit(False)) | (one & F.lit(with_distractors))).select(*catalog.columns)


def multi_cliques(catalog: DataFrame) -> DataFrame:
    return clique_sizes(catalog).where("n > 1").select("clique_id")


def split_cliques(catalog: DataFrame, fractions: tuple[float, float, float] = (0.7, 0.1, 0.2), seed: int = 0) -> DataFrame:
    """(clique_id, split): whole cliques of two or more in train, val and test. Cuts are rounded with halves to even; test has the rest."""
    if abs(sum(fractions) - 1) > 1e-8:
        raise ValueError(f"fractions must sum to 1, not {sum(fractions)}")
    drawn = multi_cliques(catalog).withColumn("place", F.row_number().over(Window.orderBy(md5_key(F.lit(seed), F.col("clique_id")), "clique_id")))
    sized = drawn.crossJoin(F.broadcast(drawn.agg(F.count("*").alias("n"))))
    cut = [F.bround(F.lit(f) * F.col("n"), 0) for f in fractions[:2]]
    split = F.when(F.col("place") <= cut[0], "train").when(F.col("place") <= cut[0] + cut[1], "val").otherwise("test")
    return sized.select("clique_id", split.alias("split"))


def subsample_cliques(catalog: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n whole cliques of two or more, drawn without replacement; asking for more than there are is an error."""
    multi = multi_cliques(catalog)
    if (have := multi.count()) < n:
        raise ValueError(f"asked for {n} cliques of {have}")
    return multi.orderBy(md5_key(F.lit(seed), F.col("clique_id")), "clique_id").limit(n)


def select_collection(catalog: DataFrame, spec: dict) -> DataFrame:
    """A collection by its spec: kind full, subsample (n_cliques, seed) or split (split: a name or a list, seed), distractors."""
    kind, distractors = spec.get("kind", "full"), spec.get("distractors", True)
    if kind == "full":
        return select_cliques(catalog, None, distractors)
    if kind == "subsample":
        return select_cliques(catalog, subsample_cliques(catalog, spec["n_cliques"], spec.get("seed", 0)), spec.get("distractors", False))
    if kind == "split":
        wanted = [spec["split"]] if isinstance(spec["split"], str) else list(spec["split"])
        splits = split_cliques(catalog, tuple(spec.get("fractions", (0.7, 0.1, 0.2))), spec.get("seed", 0))
        return select_cliques(catalog, splits.where(F.col("split").isin(wanted)), distractors)
    raise ValueError(f"unknown collection kind {kind!r}")
