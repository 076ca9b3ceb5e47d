"""Runs, reports and training from a shell.

    python -m echolattice run NAME --configs runs.json --catalog CATALOG --frames FRAMES --out results
    python -m echolattice all --configs runs.json --catalog CATALOG --frames FRAMES --out results [--group NAME] [--skip METHOD ...]
    python -m echolattice report --out results
    python -m echolattice train --catalog CATALOG --frames FRAMES --checkpoint results/cnn.npz
    python -m echolattice cache --raw FOLDER --metadata FILE --feature hpcp --catalog CATALOG --frames FRAMES
    python -m echolattice synthetic

CATALOG and FRAMES are Parquet tables (perf_id, clique_id, ..., n_frames) and (perf_id, frames); cache makes them from an archive.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="echolattice", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    what = out.add_subparsers(dest="command", required=True)
    run, every, report, train, cache, made = (what.add_parser(c) for c in ("run", "all", "report", "train", "cache", "synthetic"))
    run.add_argument("name")
    for p in (run, every):
        p.add_argument("--configs", default="configs/runs.json")
    for p in (run, every, train, cache):
        p.add_argument("--catalog", required=True)
        p.add_argument("--frames", required=True)
    for p in (run, every, report):
        p.add_argument("--out", default="results")
    every.add_argument("--group", help="only the runs of this group of configurations")
    every.add_argument("--skip", nargs="*", default=[], help="methods to pass over, such as those that take hours")
    made.add_argument("--methods", nargs="*", default=["random", "duration", "ftm2d"])
    for name, kind, value in (("epochs", int, 40), ("batch-size", int, 48), ("lr", float, 1e-3), ("dim", int, 256), ("width", int, 32), ("crop", int, 400), ("seed", int, 0), ("target-hz", float, 5.0), ("shards", int, 1)):
        train.add_argument(f"--{name}", type=kind, default=value)
    train.add_argument("--checkpoint", default="results/cnn.npz")
    cache.add_argument("--raw", required=True)
    cache.add_argument("--metadata", required=True)
    cache.add_argument("--feature", default="hpcp")
    return out


def _line(p: dict) -> str:
    m, c = p["metrics"], p["collection"]
    return f"{p['run_name']}  ({p['method']}, {c['n_items']} items, {c['n_queries']} queries)  MAP {m['map']:.4f}  MR1 {m['mr1']:.1f}  P@10 {m['precision_at_10']:.4f}  ties {m['tie_fraction']:.2%}  {p['timings_sec']['total']:.0f} s"


def _report(spark: SparkSession, folder: str) -> str:
    from echolattice.sources import files, results

    flat = results.read_results(spark, folder).select("run_name", "method", F.col("collection.kind").alias("kind"), F.col("collection.n_items").alias("n_items"), F.col("collection.n_queries").alias("n_queries"), F.col("metrics.map").alias("map"), F.col("metrics.mr1").alias("mr1"), F.col("metrics.precision_at_10").alias("p_at_k"), F.col("metrics.tie_fraction").alias("tie_fraction"))
    text = results.markdown(results.report(flat).collect())  # a row a run
    files.write_bytes(f"{folder.rstrip('/')}/summary.md", text.encode(), spark)
    return text


def _train(spark: SparkSession, a: argparse.Namespace) -> None:
    from echolattice.functions.sequences import NATIVE_RATE, downsample, normalize_frames, rate_factor
    from echolattice.operators import collections, training

    catalog = spark.read.parquet(a.catalog)
    frames = normalize_frames(downsample(F.col("frames"), rate_factor(NATIVE_RATE, a.target_hz)), "max")
    held = spark.read.parquet(a.frames).select("perf_id", frames.alias("frames"))
    part = lambda name: collections.select_collection(catalog, {"kind": "split", "split": name, "seed": a.seed, "distractors": False})
    rows = part("train").select("perf_id", "clique_id").join(held, "perf_id").select("clique_id", "frames")
    val = collections.numbered(part("val").select("perf_id", "clique_id")).withColumnRenamed("clique_id", "label").join(held, "perf_id")
    how = {"dim": a.dim, "width": a.width, "length": a.crop, "epochs": a.epochs, "batch": a.batch_size, "rate": a.lr, "shards": a.shards, "seed": a.seed}
    training.train(rows, val.select("item_idx", "label", "frames"), **how, checkpoint=a.checkpoint, target_rate=a.target_hz, log=print)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from echolattice.plans import registry
    from echolattice.sources import archive, results

    spark = SparkSession.builder.appName("echolattice").getOrCreate()
    if a.command == "report":
        print(_report(spark, a.out))
        return 0
    if a.command == "synthetic":
        for p in registry.run_synthetic(spark, tuple(a.methods)):
            print(_line(p))
        return 0
    if a.command == "train":
        _train(spark, a)
        return 0
    if a.command == "cache":
        spark.dataSource.register(archive.FeatureFiles)
        found = archive.list_files(spark, a.raw, a.feature)
        paths = "\n".join(r["path"] for r in found.select("path").orderBy("path").collect())  # a path a file
        read = spark.read.format("feature_files").option("paths", paths).option("feature", a.feature).load()
        named = found.join(read, "path")
        archive.build_cache(named.select("perf_id", "frames"), a.frames)
        counted = named.select("clique_id", "perf_id", "path").join(archive.load_cache(spark, a.frames).select("perf_id", "n_frames"), "perf_id")
        archive.catalog(counted, archive.read_metadata(spark, a.metadata)).write.mode("overwrite").parquet(a.catalog)
        return 0
    configs = results.load_runs(a.configs, spark)
    if a.command == "run" and a.name not in configs:
        print(f"unknown run {a.name!r}; have: {', '.join(sorted(configs))}")
        return 1
    wanted = [a.name] if a.command == "run" else results.load_groups(a.configs, spark).get(a.group, []) if a.group else list(configs)
    catalog, frames = spark.read.parquet(a.catalog), spark.read.parquet(a.frames)
    for name in wanted:
        if a.command == "all" and configs[name]["method"] in a.skip:
            continue
        print(_line(registry.run(configs[name], catalog, frames, folder=a.out, distances=f"{a.out}/distances")))
    if a.command == "all":
        print(_report(spark, a.out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
