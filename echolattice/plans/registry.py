"""Methods by name, and runs of them: collection, pair distances, scores, result."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolattice.functions.sequences import NATIVE_RATE
from echolattice.operators import collections as col
from echolattice.operators import evaluation, ftm2d, qmax, similarity
from echolattice.sources import archive, results

METHODS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}
#: Names that a method's parameters go by, and the library's own for them.
PARAMETERS: dict[str, dict[str, str]] = {}
#: Parameters that say how, not what: accepted by every method, without effect on its distances.
IGNORED = ("seed", "n_jobs")


def register(name: str, **parameters: str):
    """A method takes items(item_idx, label, n_frames, frames) and parameters, and returns their pairs. parameters: names, and what they are called inside."""

    def keep(f):
        METHODS[name], PARAMETERS[name] = f, parameters | {v: v for v in parameters.values()}
        return f

    return keep


def build(name: str) -> Callable[[DataFrame, dict], DataFrame]:
    """The method, which refuses parameters that it doesn't know."""
    if name not in METHODS:
        raise KeyError(f"unknown method {name!r}: {', '.join(sorted(METHODS))}")
    return lambda items, params: METHODS[name](items, known(name, params) | {"seed": params.get("seed", 0)})


def known(name: str, params: dict) -> dict:
    """A method's parameters under the library's names; an unknown one, or one given under both its names, is an error."""
    out = {}
    for k, v in params.items():
        if k in IGNORED:
            continue
        if k not in PARAMETERS[name]:
            raise ValueError(f"unknown parameter {k!r} of {name}: {', '.join(sorted(PARAMETERS[name])) or 'it has none'}")
        if (own := PARAMETERS[name][k]) in out:
            raise ValueError(f"{name} is given {own!r} twice")
        out[own] = v
    return out


_RATES = {"source_hz": "source_hz", "target_hz": "target_hz"}
_DECIMALS = {"decimals": "decimals"}


@register("random")
def random_method(items: DataFrame, params: dict) -> DataFrame:
    return similarity.random_pairs(items, params["seed"])


@register("duration")
def duration_method(items: DataFrame, params: dict) -> DataFrame:
    return similarity.duration_pairs(items)


def ftm2d_items(items: DataFrame, params: dict) -> DataFrame:
    """items with their descriptors; how patches are put together isn't a parameter of the method: always their median."""
    how = {k: params[k] for k in ("length", "hop", "coefficients", "compress", "drop_dc") if k in params}
    frames = ftm2d.method_input(F.col("frames"), params.get("source_hz", NATIVE_RATE), params.get("target_hz", 5.0), params.get("normalize", "max"))
    return ftm2d.descriptors(items, frames, **how).select("item_idx", "label", "vec")


@register("ftm2d", patch_frames="length", patch_hop="hop", n_time_coeffs="coefficients", compress="compress", drop_dc="drop_dc", normalize="normalize", **_RATES, **_DECIMALS)
def ftm2d_method(items: DataFrame, params: dict) -> DataFrame:
    return similarity.cosine_pairs(ftm2d_items(items, params), decimals=params.get("decimals", 6))


@register("qmax", m="m", tau="tau", kappa="kappa", gap_open="gap_open", gap_extend="gap_extend", symmetrize="symmetric", **_RATES, **_DECIMALS)
def qmax_method(items: DataFrame, params: dict) -> DataFrame:
    states, mean = qmax.prepare(F.col("frames"), params.get("source_hz", NATIVE_RATE), params.get("target_hz", 2.0), params.get("m", 9), params.get("tau", 1))
    how = {k: params[k] for k in ("kappa", "gap_open", "gap_extend", "symmetric") if k in params}
    return qmax.qmax_pairs(items.select("item_idx", "label", states.alias("states"), mean.alias("profile")), decimals=params.get("decimals", 6), **how)


@register("learned", checkpoint="checkpoint", normalize="normalize", **_RATES, **_DECIMALS)
def learned_method(items: DataFrame, params: dict) -> DataFrame:
    """Embeddings by a checkpoint, or the column vec if items have one."""
    if "vec" not in items.columns:
        from echolattice.functions.sequences import downsample, normalize_frames, rate_factor
        from echolattice.operators import learned

        parameters, about = learned.load(params["checkpoint"])
        frames = downsample(F.col("frames"), rate_factor(params.get("source_hz", NATIVE_RATE), params.get("target_hz", about.get("target_hz", 2.0))))
        items = learned.embed(items, normalize_frames(frames, params.get("normalize", "max")), parameters)
    return similarity.cosine_pairs(items.select("item_idx", "label", "vec"), decimals=params.get("decimals", 6))


def query_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of queries that have another item of their label among the items; pairs are made once, and dealt by query as ranking needs them."""
    own = (F.col("query_idx") != F.col("item_idx")) & (F.col("query_label") == F.col("item_label"))
    marked = pairs.withColumn("any_relevant", F.max(F.coalesce(own, F.lit(False)).cast("int")).over(Window.partitionBy("query_idx")))
    return marked.where("any_relevant = 1").drop("any_relevant")


def saved_pairs(spark: SparkSession, path: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A run's pair table: what was written under its name, to its end, else made and written there."""
    place = f"{path.rstrip('/')}/{name}"
    if not archive.exists(spark, place):
        make().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def run(config: dict, catalog: DataFrame, frames: DataFrame | None = None, k: int = 10, folder: str | None = None, distances: str | None = None) -> dict:
    """One run: a collection of the catalog, a method's pairs, their scores; the result as a dict, and as JSON in folder.

    distances: a folder of pair tables; of a run whose configuration says save_distances, the table is read from there if a
    run of its name wrote it, and written there if not. save_distances may be such a folder itself. Times are those of the
    collection, of the distances (where a table is written, else they are made while they are scored) and of the scores.
    """
    spark, clock = catalog.sparkSession, [time.time()]
    chosen = col.numbered(col.with_query_mask(col.select_collection(catalog, config["collection"])))
    counts = chosen.agg(F.count("*"), F.countDistinct("clique_id"), F.sum(F.col("is_query").cast("int"))).first()
    if not counts[2]:
        raise ValueError("no query: every clique of the collection has one performance")
    clock.append(time.time())
    items = chosen.withColumnRenamed("clique_id", "label")
    items = items if frames is None else items.join(frames.drop("n_frames"), "perf_id")
    make = lambda: build(config["method"])(items, {"seed": config.get("seed", 0)} | config.get("params", {}))
    place = config.get("save_distances")
    place = place if isinstance(place, str) else distances if place else None
    pairs = saved_pairs(spark, place, config["name"], make) if place else make()
    clock.append(time.time())
    queries = chosen.where("is_query").select(F.col("item_idx").alias("query_idx"))
    scored = evaluation.evaluate(pairs.join(queries, "query_idx", "left_semi"), k).first()
    clock.append(time.time())
    payload = {
        "run_name": config["name"],
        "method": config["method"],
        "seed": config.get("seed", 0),
        "git": results.provenance(),
        "config": json.dumps(config, sort_keys=True),
        "collection": {"kind": config["collection"].get("kind", "full"), "n_items": counts[0], "n_cliques": counts[1], "n_queries": counts[2], "spec": json.dumps(config["collection"], sort_keys=True)},
        "timings_sec": {n: b - a for n, a, b in zip(("collection", "distances", "scores"), clock[:-1], clock[1:], strict=True)} | {"total": clock[-1] - clock[0]},
        "metrics": {"map": scored["map"], "mr1": scored["mr1"], "precision_at_10": scored["p_at_k"], "n_queries": scored["n_queries"], "tie_fraction": scored["tie_fraction"]},
        "env": results.environment(spark),
    }
    if folder:
        results.write_result(folder, payload)
    return payload


def run_synthetic(spark: SparkSession, methods: tuple[str, ...] = ("random", "duration", "ftm2d"), **how) -> list[dict]:
    """All methods over a synthetic collection."""
    from echolattice.sources.archive import synthetic

    rows = synthetic(spark, **how).persist()
    try:
        catalog, frames = rows.drop("frames"), rows.select("perf_id", "frames")
        return [run({"name": f"{m}_full", "method": m, "collection": {"kind": "full"}, "params": {}}, catalog, frames) for m in methods]
    finally:
        rows.unpersist()
