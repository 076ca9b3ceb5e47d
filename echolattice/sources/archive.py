"""Sources: metadata, feature files, the catalog, the columnar cache of frames, and a generator of synthetic collections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from echolattice.functions.sequences import PITCHES, downsample, md5_key, normalize_frames, rate_factor, roll
from echolattice.sources import files

#: Features and the names of their directories and files; fixed by the archive's layout.
FEATURES = {"hpcp": "hpcp", "crema": "crema", "cens": "cens"}
CATALOG = "perf_id string, clique_id string, path string, work_title string, perf_artist string, n_frames long"
_WORK = "map<string, map<string, struct<work_title: string, perf_artist: string, work_id: string, perf_id: string>>>"


def feature_folder(raw: str, feature: str) -> str:
    if feature not in FEATURES:
        raise KeyError(f"unknown feature {feature!r}: {', '.join(FEATURES)}")
    return f"{raw}/{FEATURES[feature]}"


def parse_metadata(texts: DataFrame, column: str = "value") -> DataFrame:
    """clique_id, perf_id, work_title, perf_artist of {clique: {performance: {...}}} texts."""
    cliques = texts.select(F.explode(F.from_json(column, _WORK)).alias("clique_id", "perfs"))
    perfs = cliques.select("clique_id", F.explode("perfs").alias("perf_id", "m"))
    return perfs.select("clique_id", "perf_id", "m.work_title", "m.perf_artist")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A missing file is Spark's error when the plan is made."""
    return parse_metadata(spark.read.text(path, wholetext=True))


def parse_ids(path: Column, feature: str) -> tuple[Column, Column]:
    """(clique, performance) of <clique>_<feature>/<performance>_<feature>.h5."""
    pattern = rf"([^/]+)_{feature}/([^/]+)_{feature}\.h5$"
    return F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)


def list_files(spark: SparkSession, raw: str, feature: str) -> DataFrame:
    """clique_id, perf_id, path of the files two levels down; none is an error. Contents aren't read."""
    found = spark.read.format("binaryFile").load(f"{feature_folder(raw, feature)}/*/*.h5").select("path")
    if found.isEmpty():
        raise FileNotFoundError(f"no {feature} files under {raw}")
    clique, perf = parse_ids(F.col("path"), feature)
    return found.select(clique.alias("clique_id"), perf.alias("perf_id"), "path")


def catalog(found: DataFrame, metadata: DataFrame, check: bool = True) -> DataFrame:
    """Files with their metadata, missing titles and artists as "". check: a file or a performance without the other is an error."""
    key = ["clique_id", "perf_id"]
    if check:
        for a, b, what in ((found, metadata, "files without metadata"), (metadata, found, "metadata without file")):
            if left := a.join(b, key, "left_anti").select(*key).limit(3).collect():
                raise ValueError(f"{what}: {[tuple(r) for r in left]}")
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("work_title", "perf_artist")]
    own = [F.col("n_frames")] if "n_frames" in found.columns else []
    return found.join(metadata, key).select("perf_id", "clique_id", "path", *blank, *own)


def cached_catalog(spark: SparkSession, path: str, build) -> DataFrame:
    """The catalog at path, written there first if there is none; its schema is stored with it."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to the end."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def check_frames(x: np.ndarray, where: str) -> np.ndarray:
    """Frames as (n, 12) float32: a transposed array is turned, anything else that isn't frames raises."""
    if x.ndim != 2:
        raise ValueError(f"{where}: {x.ndim} axes, not 2")
    if x.shape[1] != PITCHES:
        if x.shape[0] != PITCHES:
            raise ValueError(f"{where}: no axis of {PITCHES} in {x.shape}")
        x = x.T
    if not len(x):
        raise ValueError(f"{where}: no frames")
    x = np.ascontiguousarray(x, np.float32)
    if not np.isfinite(x).all():
        raise ValueError(f"{where}: values that aren't finite")
    return x


def open_feature_file(path: str):
    """An HDF5 file on this machine by its plain path or file: URI; another by its bytes, from the file system that its scheme names."""
    import io

    import h5py

    if (own := files.local(path)) is not None:
        return h5py.File(own, "r")
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    with system.open_input_file(inside) as f:
        return h5py.File(io.BytesIO(f.read()), "r")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.feature, self.counts = options["paths"].split("\n"), options.get("feature", "hpcp"), options.get("counts", "false") == "true"

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with open_feature_file(partition.path) as f:
            if self.feature not in f:
                raise KeyError(f"{partition.path}: no dataset {self.feature}")
            if self.counts:
                shape = f[self.feature].shape
                yield partition.path, int(shape[0] if shape[1] == PITCHES else shape[1]), None
            else:
                x = check_frames(f[self.feature][()], partition.path)
                yield partition.path, len(x), x.astype(float).tolist()


class FeatureFiles(DataSource):
    """spark.read.format("feature_files"): path, n_frames, frames of HDF5 files; counts=true reads their headers alone. Needs h5py."""

    @classmethod
    def name(cls):
        return "feature_files"

    def schema(self):
        return "path string, n_frames long, frames array<array<double>>"

    def reader(self, schema):
        return _Reader(self.options)


# ---- cache of frames ------------------------------------------------------------------------------------------


def build_cache(frames: DataFrame, path: str, source_rate: float | None = None, target_rate: float | None = None, normalize: str = "none") -> None:
    """Write frames(perf_id, frames), at a rate and normalised if wanted, with n_frames. Parquet's row groups are its offsets."""
    col = F.col("frames")
    if target_rate is not None:
        col = downsample(col, rate_factor(source_rate, target_rate))
    out = frames.select("perf_id", normalize_frames(col, normalize).alias("frames"))
    out.withColumn("n_frames", F.size("frames").cast("long")).write.parquet(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---- synthetic collections ------------------------------------------------------------------------------------


def synthetic(spark: SparkSession, n_cliques: int = 8, per_clique: int = 4, n_singletons: int = 6, noise: float = 0.15, seed: int = 0) -> DataFrame:
    """perf_id, clique_id, path, work_title, perf_artist, n_frames, frames of a made-up collection.

    Performances of a clique share a progression of 8 major triads and differ in key, tempo, length, beginning and noise;
    singletons have progressions of their own. All draws are hashes of the seed, the performance and the place.
    """
    both = spark.range(n_cliques * per_clique + n_singletons).withColumn("one", F.col("id") >= n_cliques * per_clique)
    k = F.col("id") - n_cliques * per_clique
    clique = F.when(F.col("one"), F.format_string("S_%d", k)).otherwise(F.format_string("W_%d", F.floor(F.col("id") / per_clique)))
    perf = F.when(F.col("one"), F.format_string("P_s_%d", k)).otherwise(F.format_string("P_%d_%d", F.floor(F.col("id") / per_clique), F.col("id") % per_clique))
    named = both.select(perf.alias("perf_id"), clique.alias("clique_id"))
    draw = lambda n, *parts: F.pmod(md5_key(F.lit(seed), *parts), F.lit(n)).cast("int")
    roots = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: draw(PITCHES, F.col("clique_id"), i))
    drawn = named.withColumns({"roots": roots, "hold": 120 + draw(160, F.col("perf_id"), F.lit("hold")), "repeats": 8 + draw(8, F.col("perf_id"), F.lit("repeats")), "key": draw(PITCHES, F.col("perf_id"), F.lit("key"))})
    drawn = drawn.withColumn("total", F.col("hold") * F.col("repeats") * 8).withColumn("skip", F.floor(F.col("total") * draw(250, F.col("perf_id"), F.lit("skip")) / 1000).cast("int"))

    def triad(root: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(PITCHES - 1)), lambda p: F.when(F.pmod(p - root, F.lit(PITCHES)).isin(0, 4, 7), 1.0).otherwise(0.0))

    chords = F.transform("roots", lambda r: roll(triad(r), F.col("key")))
    drawn = drawn.withColumn("chords", chords)
    frame = lambda t: F.get(F.col("chords"), F.pmod(F.floor(t / F.col("hold")), F.lit(8)).cast("int"))

    def noisy(t: Column) -> Column:
        u = lambda p, w: (F.pmod(F.xxhash64(F.lit(seed), F.col("perf_id"), t, p, F.lit(w)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
        gauss = lambda p: F.sqrt(-2 * F.log(u(p, 0))) * F.cos(u(p, 1) * 2 * np.pi)
        return F.transform(frame(t), lambda x, p: F.greatest(F.lit(0.0), x + noise * gauss(p)))

    out = drawn.withColumn("frames", F.transform(F.sequence(F.col("skip"), F.col("total") - 1), noisy))
    return out.select("perf_id", "clique_id", F.col("perf_id").alias("path"), F.lit("").alias("work_title"), F.lit("").alias("perf_artist"), F.size("frames").cast("long").alias("n_frames"), "frames")


def with_clique_number(rows: DataFrame) -> DataFrame:
    """Classes for training: cliques in order, from 0."""
    cliques = rows.select("clique_id").distinct().withColumn("class", (F.row_number().over(Window.orderBy("clique_id")) - 1).cast("int"))
    return rows.join(cliques, "clique_id")
