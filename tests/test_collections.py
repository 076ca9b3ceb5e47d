import json

import numpy as np
import pytest
from echolattice.operators import collections as col
from echolattice.operators import learned
from echolattice.plans import registry
from echolattice.sources import archive, results
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def corpus(spark):
    return archive.synthetic(spark).persist()


def test_synthetic(corpus):
    rows = corpus.drop("frames").collect()
    assert len(rows) == 38 and len({r["perf_id"] for r in rows}) == 38
    assert corpus.where("size(frames) <> n_frames or exists(frames, f -> size(f) <> 12 or exists(f, x -> x < 0))").count() == 0
    assert all(8 * 8 * 120 * 0.75 <= r["n_frames"] <= 8 * 15 * 279 for r in rows)


def test_query_mask(spark, corpus):
    assert col.with_query_mask(corpus).where("is_query").count() == 32
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "b")], "perf_id long, clique_id string")
    assert {r["perf_id"] for r in col.with_query_mask(rows).where("is_query").collect()} == {3, 4}
    assert {r["perf_id"] for r in col.select_cliques(rows, None, False).collect()} == {1, 2, 3, 4}


def test_split(spark, corpus):
    split = {r["clique_id"]: r["split"] for r in col.split_cliques(corpus).collect()}
    assert sorted(split.values()) == ["test", "train", "train", "train", "train", "train", "train", "val"]
    assert split == {r["clique_id"]: r["split"] for r in col.split_cliques(corpus).collect()}
    with pytest.raises(ValueError):
        col.split_cliques(corpus, (0.5, 0.1, 0.1))
    test = col.select_collection(corpus, {"kind": "split", "split": "test"})
    assert test.where("clique_id like 'W%'").count() == 4 and test.where("clique_id like 'S%'").count() == 6


def test_subsample(corpus):
    some = col.select_collection(corpus, {"kind": "subsample", "n_cliques": 3, "seed": 1})
    assert some.count() == 12 and col.with_query_mask(some).where("is_query").count() == 12
    with pytest.raises(ValueError):
        col.subsample_cliques(corpus, 99)
    with pytest.raises(ValueError):
        col.select_collection(corpus, {"kind": "half"})


def test_methods_by_name():
    assert {"random", "duration", "ftm2d", "qmax", "learned"} <= set(registry.METHODS)
    with pytest.raises(KeyError, match="random"):
        registry.build("none")


def test_runs_on_synthetic(spark, corpus, tmp_path):
    catalog, frames = corpus.drop("frames"), corpus.select("perf_id", "frames")
    got = {}
    for method in ("random", "ftm2d"):
        got[method] = registry.run({"name": f"{method}_full", "method": method, "seed": 0, "collection": {"kind": "full"}, "params": {}}, catalog, frames, folder=str(tmp_path))
    assert got["ftm2d"]["metrics"]["map"] > 0.3 and got["ftm2d"]["metrics"]["map"] > 2 * got["random"]["metrics"]["map"]
    assert got["ftm2d"]["collection"] | {"spec": ""} == {"kind": "full", "n_items": 38, "n_cliques": 14, "n_queries": 32, "spec": ""}
    read = results.read_results(spark, str(tmp_path)).select("run_name", "metrics.map", "collection.n_queries").collect()
    assert {r["run_name"]: r["map"] for r in read} == {f"{m}_full": p["metrics"]["map"] for m, p in got.items()}


def test_alignment_run(spark):
    rows = archive.synthetic(spark, n_cliques=2, per_clique=2, n_singletons=0, seed=3)
    got = registry.run({"name": "q", "method": "qmax", "collection": {"kind": "full"}, "params": {"target_hz": 0.5}}, rows.drop("frames"), rows.select("perf_id", "frames"))
    assert got["metrics"]["n_queries"] == 4 and got["metrics"]["map"] > 0.5


def test_cache(spark, corpus, tmp_path):
    path = f"file://{tmp_path}/cache"
    assert not archive.exists(spark, path)
    archive.build_cache(corpus, path)
    assert archive.exists(spark, path)
    a = {r["perf_id"]: r["frames"] for r in corpus.limit(3).collect()}
    b = {r["perf_id"]: r["frames"] for r in archive.load_cache(spark, path).collect()}
    assert all(b[k] == v for k, v in a.items()) and len(b) == 38


def test_splits_and_reports(spark, corpus, tmp_path):
    split = col.split_cliques(corpus)
    results.write_split(split, f"{tmp_path}/split", 7)
    assert {(r["clique_id"], r["split"], r["seed"]) for r in results.read_split(spark, f"{tmp_path}/split").collect()} == {(r["clique_id"], r["split"], 7) for r in split.collect()}
    (tmp_path / "runs.json").write_text(json.dumps({"_about": [{"name": "no"}], "a": [{"name": "x", "method": "random"}], "b": [{"name": "y"}]}))
    assert set(results.load_runs(str(tmp_path / "runs.json"))) == {"x", "y"}
    from echolattice.plans import catalog

    rows = catalog.queries()["method_report"](spark, "").collect()
    text = results.markdown(rows)
    assert "a bug?" in text and text.count("###") == 2 and text.index("ftm2d |") < text.index("random |")


def test_catalog_checks(spark):
    files = spark.createDataFrame([("W_1", "P_1", "p")], "clique_id string, perf_id string, path string")
    meta = spark.createDataFrame([("W_1", "P_1", None, "a"), ("W_1", "P_2", "t", "b")], "clique_id string, perf_id string, work_title string, perf_artist string")
    with pytest.raises(ValueError, match="metadata without file"):
        archive.catalog(files, meta)
    with pytest.raises(ValueError, match="files without metadata"):
        archive.catalog(files, meta.where("perf_id = 'P_2'"))
    assert archive.catalog(files, meta.where("perf_id = 'P_1'")).first()["work_title"] == ""
    with pytest.raises(KeyError):
        archive.feature_folder("/raw", "mfcc")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|no hpcp"):
        archive.list_files(spark, "/nowhere", "hpcp").count()


def test_frames_are_checked():
    assert archive.check_frames(np.ones((12, 30)), "x").shape == (30, 12)
    assert archive.check_frames(np.ones((12, 12)), "x").shape == (12, 12)
    bad = np.ones((5, 12))
    bad[3, 3] = np.nan
    for x in (bad, np.ones((0, 12)), np.ones((10, 7)), np.ones(5)):
        with pytest.raises(ValueError):
            archive.check_frames(x, "x")


def test_network(spark, tmp_path):
    p = learned.initial(16, 4)
    x = np.random.default_rng(0).random((90, 12))
    a = learned.embed_one(p, x)
    assert a.shape == (16,) and abs(np.linalg.norm(a) - 1) < 1e-12
    assert np.allclose(a, learned.embed_one(p, np.roll(x, 5, axis=1)))
    with pytest.raises(ValueError):
        learned.embed_one(p, x[:20])
    learned.save(f"{tmp_path}/m.npz", p, dim=16, target_hz=2.0)
    q, about = learned.load(f"{tmp_path}/m.npz")
    assert about == {"dim": 16, "target_hz": 2.0} and all(np.array_equal(p[k], q[k]) for k in p)
    items = spark.createDataFrame([(0, "a", x.tolist())], "item_idx long, label string, frames array<array<double>>")
    assert np.allclose(learned.embed(items, F.col("frames"), q).first()["vec"], a)
    assert learned.cosine_logits(a[None], np.stack([a * 3, -a])).round(6).tolist() == [[30, -30]]
    assert learned.crop(x, 100).shape == (12, 100) and learned.crop(x, 40, np.random.default_rng(1)).shape == (12, 40)
    with pytest.raises(FileNotFoundError):
        learned.load(f"{tmp_path}/none.npz")
