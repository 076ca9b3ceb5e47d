"""Runs, their results, splits and reports as files and tables."""

from __future__ import annotations

import json
import platform
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolattice.sources import files

RESULT = (
    "run_name string, method string, seed long, git struct<sha: string, dirty: boolean>, config string, "
    "collection struct<kind: string, n_items: long, n_cliques: long, n_queries: long, spec: string>, timings_sec map<string, double>, "
    "metrics struct<map: double, mr1: double, precision_at_10: double, n_queries: long, tie_fraction: double>, "
    "env struct<python: string, spark: string, platform: string>"
)


def _groups(path: str, spark: SparkSession | None) -> dict[str, list[dict]]:
    return {k: group for k, group in json.loads(files.read_bytes(path, spark)).items() if not k.startswith("_")}


def load_runs(path: str, spark: SparkSession | None = None) -> dict[str, dict]:
    """Configurations by name: the groups of a JSON file in a row, keys that begin with _ passed over."""
    return {c["name"]: c for group in _groups(path, spark).values() for c in group}


def load_groups(path: str, spark: SparkSession | None = None) -> dict[str, list[str]]:
    """Names of the configurations of each group."""
    return {k: [c["name"] for c in group] for k, group in _groups(path, spark).items()}


def provenance(root: str = ".") -> dict:
    """The commit, and whether anything differs from it; empty outside a repository."""
    git = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True)
    sha = git("rev-parse", "HEAD")
    return {"sha": sha.stdout.strip() if sha.returncode == 0 else None, "dirty": bool(git("status", "--porcelain").stdout.strip())}


def environment(spark: SparkSession) -> dict:
    return {"python": platform.python_version(), "spark": spark.version, "platform": platform.platform()}


def write_result(folder: str, payload: dict, spark: SparkSession | None = None) -> str:
    """One JSON file a run, through Spark's file systems if folder has a scheme."""
    path = f"{folder.rstrip('/')}/{payload['run_name']}.json"
    files.write_bytes(path, json.dumps(payload, indent=2, sort_keys=True).encode(), spark)
    return path


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """All runs' results but a summary; an empty folder is Spark's error."""
    flat = spark.read.option("multiLine", True).schema(RESULT).json(f"{folder}/*.json", pathGlobFilter="*.json")
    return flat.where(~F.input_file_name().endswith("/summary.json")).where("run_name is not null")


def write_split(split: DataFrame, folder: str, seed: int) -> None:
    split.withColumn("seed", F.lit(seed)).write.mode("overwrite").json(folder)


def read_split(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("clique_id string, split string, seed long").json(folder)


def method_label(name: Column) -> Column:
    """A run's name without the ending that says its collection."""
    return F.regexp_replace(name, "(_full|_sub50|_test)$", "")


def report(results: DataFrame) -> DataFrame:
    """Rows (collection, run_name, method, label, map, mr1, p_at_k, tie_fraction, floor, at_floor), best first in each collection.

    floor is the score of the group's first random run by name; at_floor marks other runs that don't beat it.
    """
    group = F.format_string("%s (%,d items, %,d queries)", F.col("kind"), F.col("n_items"), F.col("n_queries"))
    named = results.withColumn("collection", group).withColumn("label", method_label(F.col("run_name")))
    own = Window.partitionBy("collection")
    first = F.min(F.when(F.col("method") == "random", F.struct("run_name", "map"))).over(own)["map"]
    named = named.withColumn("floor", first)
    at_floor = (F.col("method") != "random") & F.coalesce(F.col("map") <= F.col("floor"), F.lit(False))
    return named.withColumn("at_floor", at_floor).select("collection", "run_name", "method", "label", "map", "mr1", "p_at_k", "tie_fraction", "floor", "at_floor").orderBy("collection", F.desc("map"), "run_name")


#: Panels of a report, in this order; other kinds come last.
COLLECTION_ORDER = ("full", "split", "subsample")


def bars(results: DataFrame) -> DataFrame:
    """(panel, kind, bar, label, map, floor): runs by the fixed order of collections, from the lowest score up; floor as in report()."""
    own = Window.partitionBy("kind")
    floor = F.min(F.when(F.col("method") == "random", F.struct("run_name", "map"))).over(own)["map"]
    place = F.array_position(F.array(*map(F.lit, COLLECTION_ORDER)), F.col("kind"))
    panel = F.when(place > 0, place).otherwise(len(COLLECTION_ORDER) + 1).cast("int")
    bar = F.row_number().over(own.orderBy("map", "run_name"))
    return results.select(panel.alias("panel"), "kind", bar.alias("bar"), method_label(F.col("run_name")).alias("label"), "map", floor.alias("floor")).orderBy("panel", "bar")


def markdown(rows: list) -> str:
    """A table for each collection."""
    out, last = [], None
    for r in rows:
        if r["collection"] != last:
            out += ["", f"### {r['collection']}", "", "| method | MAP | MR1 | P@10 | ties |", "|---|---:|---:|---:|---:|"]
            last = r["collection"]
        out.append(f"| {r['label']}{' (at the floor: a bug?)' if r['at_floor'] else ''} | {r['map']:.4f} | {r['mr1']:.1f} | {r['p_at_k']:.4f} | {r['tie_fraction']:.2%} |")
    return "\n".join(out).strip() + "\n"
