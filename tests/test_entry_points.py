"""Configurations, parameters and commands."""

import json

import pytest
from echolattice import __main__ as shell
from echolattice.operators import ftm2d
from echolattice.plans import registry
from echolattice.sources import archive, files, results

FTM = {"target_hz": 5.0, "patch_frames": 180, "patch_hop": 60, "n_time_coeffs": 32, "compress": "sqrt"}
QMAX = {"target_hz": 2.0, "m": 9, "tau": 1, "kappa": 0.095, "gap_open": 0.5, "gap_extend": 0.5, "symmetrize": True, "n_jobs": 12}
COLLECTIONS = {"full": {"kind": "full"}, "sub50": {"kind": "subsample", "n_cliques": 50, "seed": 0}, "test": {"kind": "split", "split": "test", "seed": 0}}


def configurations():
    """The published runs: four methods on three collections, one alignment and one learned."""
    out = {}
    for name, collection in COLLECTIONS.items():
        methods = [("random", "random", {}), ("duration", "duration", {}), ("ftm2d", "ftm2d", FTM), ("ftm2d_nodc", "ftm2d", FTM | {"drop_dc": True})]
        methods += [("qmax", "qmax", QMAX)] * (name == "sub50") + [("learned", "learned", {"checkpoint": "results/cnn.pt"})] * (name == "test")
        out[name] = [{"name": f"{n}_{name}", "method": m, "seed": 0, "collection": collection, "params": p} | ({"save_distances": True} if n == "qmax" else {}) for n, m, p in methods]
    return out


def test_all_configurations_are_accepted():
    every = [c for g in configurations().values() for c in g]
    assert len(every) == 14
    for c in every:
        got = registry.known(c["method"], c["params"])
        assert len(got) == len([k for k in c["params"] if k not in registry.IGNORED])
    assert registry.known("ftm2d", FTM) == {"target_hz": 5.0, "length": 180, "hop": 60, "coefficients": 32, "compress": "sqrt"}
    assert registry.known("qmax", {"symmetrize": False}) == {"symmetric": False}


def test_unknown_parameters_raise(spark):
    items = spark.createDataFrame([], "item_idx long, label string, n_frames long, frames array<array<double>>")
    for method, params in (("ftm2d", {"patch_length": 90}), ("qmax", {"patch_frames": 90}), ("random", {"kappa": 1}), ("duration", {"hop": 1}), ("ftm2d", {"hop": 1, "patch_hop": 2})):
        with pytest.raises(ValueError, match="parameter|twice"):
            registry.build(method)(items, params)
    with pytest.raises(ValueError, match="compression"):
        ftm2d.descriptor(__import__("numpy").ones((4, 12)), compress="root")


def test_parameters_change_the_distances(spark):
    rows = archive.synthetic(spark, 3, 2, 1).withColumnRenamed("clique_id", "label").withColumn("item_idx", __import__("pyspark").sql.functions.monotonically_increasing_id()).persist()
    pairs = lambda method, **p: {(r["query_idx"], r["item_idx"]): r["distance"] for r in registry.build(method)(rows, p).collect()}
    plain = pairs("ftm2d", target_hz=1.0, patch_frames=60, patch_hop=20)
    for other in ({"patch_frames": 40}, {"patch_hop": 60}, {"n_time_coeffs": 8}, {"compress": "log"}, {"drop_dc": True}, {"target_hz": 2.0}, {"normalize": "l2"}):
        assert pairs("ftm2d", **{"target_hz": 1.0, "patch_frames": 60, "patch_hop": 20} | other) != plain, other
    plain = pairs("qmax", target_hz=0.5)
    for other in ({"kappa": 0.2}, {"m": 4}, {"tau": 2}, {"gap_open": 1.5}, {"gap_extend": 1.5}, {"symmetrize": False}):
        assert pairs("qmax", **{"target_hz": 0.5} | other) != plain, other
    rows.unpersist()


def test_shell(spark, tmp_path, capsys, monkeypatch):
    """A named run, all runs of a group, the report, and training, on a made-up collection."""
    rows = archive.synthetic(spark, 6, 3, 2)
    rows.drop("frames").write.parquet(f"{tmp_path}/catalog")
    archive.build_cache(rows.select("perf_id", "frames"), f"{tmp_path}/frames")
    runs = {"_comment": "x", "one": [{"name": f"{m}_full", "method": m, "collection": {"kind": "full"}, "params": p} | ({"save_distances": True} if m == "duration" else {}) for m, p in (("random", {}), ("duration", {}), ("ftm2d", {"target_hz": 1.0, "patch_frames": 60}))]}
    runs["two"] = [{"name": "learned_test", "method": "learned", "collection": {"kind": "full"}, "params": {"checkpoint": f"{tmp_path}/cnn.npz", "target_hz": 1.0}}]
    (tmp_path / "runs.json").write_text(json.dumps(runs))
    where = ["--catalog", f"{tmp_path}/catalog", "--frames", f"{tmp_path}/frames"]
    also = ["--configs", f"{tmp_path}/runs.json", "--out", f"{tmp_path}/out"]
    assert shell.main(["run", "nothing", *where, *also]) == 1 and "have: duration_full" in capsys.readouterr().out
    assert shell.main(["all", "--group", "one", *where, *also]) == 0
    assert "| ftm2d |" in capsys.readouterr().out and (tmp_path / "out" / "summary.md").exists()
    got = {r["run_name"]: r for r in results.read_results(spark, f"{tmp_path}/out").collect()}
    assert set(got) == {"random_full", "duration_full", "ftm2d_full"}
    assert set(got["ftm2d_full"]["timings_sec"]) == {"collection", "distances", "scores", "total"}
    assert archive.exists(spark, f"{tmp_path}/out/distances/duration_full")
    # the saved table is what a second run reads
    monkeypatch.setitem(registry.METHODS, "duration", None)
    assert shell.main(["run", "duration_full", *where, *also]) == 0
    assert shell.main(["train", *where, "--epochs", "1", "--dim", "4", "--width", "1", "--crop", "32", "--batch-size", "4", "--target-hz", "1.0", "--checkpoint", f"{tmp_path}/cnn.npz"]) == 0
    assert shell.main(["run", "learned_test", *where, *also]) == 0
    assert "learned_test" in capsys.readouterr().out


def test_files_by_scheme(spark, tmp_path):
    for path in (f"{tmp_path}/a/b.bin", f"file://{tmp_path}/c d/e.bin", f"file:{tmp_path}/f.bin"):
        files.write_bytes(path, b"\x00\xffx", spark)
        assert files.read_bytes(path, spark) == b"\x00\xffx"
    assert files.local("file:///x/y%20z") == "/x/y z" and files.local("hdfs://h/x") is None and files.local("/x") == "/x"
    # as a path that isn't local would be read and written
    import unittest.mock

    with unittest.mock.patch.object(files, "local", lambda _: None):
        files.write_bytes(f"file://{tmp_path}/g.bin", b"\x80\x00", spark)
        assert files.read_bytes(f"file://{tmp_path}/g.bin", spark) == b"\x80\x00"


def test_workers_import_the_package_from_what_they_are_sent(tmp_path):
    """A session whose workers can't see the folder that the driver imported the package from: it is gone before they start."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    shutil.copytree(Path(shell.__file__).parent, tmp_path / "lib" / "echolattice")
    code = f"""
import shutil, sys
sys.path.insert(0, {str(tmp_path / "lib")!r})
from pyspark.sql import SparkSession, functions as F
from echolattice.operators import ftm2d, similarity
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
items = spark.createDataFrame([(k, "a", [[float(k + p) for p in range(12)]] * 9) for k in range(4)], "item_idx long, label string, frames array<array<double>>")
out = similarity.cosine_pairs(ftm2d.descriptors(items, F.col("frames"), length=4, hop=2, coefficients=2).select("item_idx", "label", "vec"))
shutil.rmtree({str(tmp_path / "lib")!r})
print("pairs", out.count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=240)
    assert "pairs 12" in done.stdout, done.stderr[-2000:]
