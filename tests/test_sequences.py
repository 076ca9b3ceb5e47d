import numpy as np
import pytest
from echolattice.functions import sequences as seq
from echolattice.operators import ftm2d, qmax
from pyspark.sql import functions as F


def run(spark, frames, f):
    return spark.createDataFrame([(np.asarray(frames, float).tolist(),)], "x array<array<double>>").select(f(F.col("x"))).first()[0]


def rand(n, seed=0):
    return np.random.default_rng(seed).random((n, 12))


def test_downsample(spark):
    ramp = np.repeat(np.arange(5.0)[:, None], 12, axis=1)
    assert np.allclose(np.array(run(spark, ramp[:4], lambda x: seq.downsample(x, 2)))[:, 0], [0.5, 2.5])
    assert len(run(spark, ramp, lambda x: seq.downsample(x, 2))) == 2
    x = rand(10)
    for how in ("mean", "median", "max"):
        assert np.allclose(run(spark, x, lambda c, how=how: seq.downsample(c, 3, how)), getattr(np, how)(x[:9].reshape(3, 3, 12), axis=1))
        assert np.allclose(run(spark, x[:2], lambda c, how=how: seq.downsample(c, 3, how)), x[:2].mean(axis=0, keepdims=True))
    assert np.allclose(run(spark, x, lambda c: seq.downsample(c, 1)), x)
    with pytest.raises(KeyError):
        seq.downsample(F.col("x"), 2, "mode")


def test_rates():
    assert [seq.rate_factor(seq.NATIVE_RATE, r) for r in (5, 2, 1000)] == [17, 43, 1]
    assert seq.rate_factor(5, 2) == 2 and seq.rate_factor(7, 2) == 4


def test_normalize(spark):
    x = np.zeros((3, 12))
    x[0, 2], x[2] = 4.0, -1.0
    out = np.array(run(spark, x, lambda c: seq.normalize_frames(c, "max")))
    assert out[0, 2] == 1 and not out[1].any() and not out[2].any()
    y = rand(4)
    assert np.allclose(run(spark, y, lambda c: seq.normalize_frames(c, "l2")), y / np.linalg.norm(y, axis=1, keepdims=True))
    assert np.allclose(run(spark, y, lambda c: seq.normalize_frames(c, "l1")), y / y.sum(axis=1, keepdims=True))
    assert np.allclose(run(spark, y, lambda c: seq.normalize_frames(c, "none")), y)
    with pytest.raises(ValueError):
        seq.normalize_frames(F.col("x"), "l3")


def test_transposition(spark):
    x = rand(20)
    assert np.allclose(run(spark, x, lambda c: seq.transpose(c, 12)), x)
    assert np.allclose(run(spark, x, lambda c: seq.transpose(c, 5)), np.roll(x, 5, axis=1))
    assert run(spark, x, lambda c: seq.optimal_transposition(seq.profile(c), seq.profile(seq.transpose(c, 5)))) == 7
    p = np.array(run(spark, x, seq.profile))
    assert abs(np.linalg.norm(p) - 1) < 1e-12
    assert not np.any(run(spark, np.zeros((3, 12)), seq.profile))


def test_patches_and_embedding(spark):
    x = np.arange(60.0).reshape(5, 12)
    got = np.array(run(spark, x, lambda c: seq.delay_embed(c, 3)))
    assert got.shape == (3, 36) and np.array_equal(got[0], np.arange(36))
    with pytest.raises(Exception, match="too short"):
        run(spark, x[:4], lambda c: seq.delay_embed(c, 9))
    assert np.array(run(spark, x, lambda c: seq.patches(c, 2, 2))).shape == (2, 2, 12)
    padded = np.array(run(spark, x, lambda c: seq.patches(c, 8, 2)))
    assert padded.shape == (1, 8, 12) and not padded[0, 5:].any()
    y = rand(40)
    idx = 3 + np.linspace(0, 19, 7).round().astype(int)
    assert np.allclose(run(spark, y, lambda c: seq.resample(c, 3, 20, 7)), y[idx])


def test_descriptor(spark):
    x = rand(600, 1)
    d = ftm2d.descriptor(x)
    assert d.shape == (224,) and abs(np.linalg.norm(d) - 1) < 1e-12
    assert np.allclose(d, ftm2d.descriptor(np.roll(x, 3, axis=1)), atol=1e-6)
    assert 1 - d @ ftm2d.descriptor(x[10:]) < 0.05
    assert ftm2d.descriptor(rand(20)).shape == (224,)
    assert ftm2d.descriptor(x, drop_dc=True)[0] == 0
    assert ftm2d.descriptor(x, length=16, coefficients=32).shape == (16 * 7,)
    assert not ftm2d.descriptor(np.zeros((200, 12))).any()
    for bad in ({"compress": "cube"}, {"aggregate": "mode"}):
        with pytest.raises((ValueError, KeyError)):
            ftm2d.descriptor(x, **bad)
    with pytest.raises(ValueError):
        ftm2d.descriptor(np.zeros((5, 11)))
    items = spark.createDataFrame([(1, "a", x.tolist())], "item_idx long, label string, frames array<array<double>>")
    assert np.allclose(ftm2d.descriptors(items, F.col("frames"), length=64).first()["vec"], ftm2d.descriptor(x, length=64))


def plain_score(plot, go, ge):
    n, m = plot.shape
    if n < 3 or m < 3:
        return 0.0
    q = np.zeros((n + 2, m + 2))
    r = np.zeros((n + 2, m + 2), bool)
    r[2:, 2:] = plot
    for i in range(2, n + 2):
        for j in range(2, m + 2):
            prev = [(i - 1, j - 1), (i - 2, j - 1), (i - 1, j - 2)]
            q[i, j] = max(q[p] for p in prev) + 1 if r[i, j] else max(0, *(q[p] - (go if r[p] else ge) for p in prev))
    return q.max()


def test_alignment_score(spark):
    rng = np.random.default_rng(5)
    plots = [rng.random((int(rng.integers(1, 14)), int(rng.integers(1, 14)))) < 0.3 for _ in range(25)]
    for go, ge in ((0.5, 0.5), (0.5, 0.7), (1.0, 0.2)):
        rows = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(plots)], "k int, p array<array<boolean>>")
        fold = {r[0]: r[1] for r in rows.select("k", qmax.score_expression(F.col("p"), go, ge)).collect()}
        for k, p in enumerate(plots):
            assert abs(qmax.score(p, go, ge) - plain_score(p, go, ge)) < 1e-9
            assert abs(fold[k] - plain_score(p, go, ge)) < 1e-9


def test_recurrence():
    rng = np.random.default_rng(2)
    x, y = rng.random((30, 8)), rng.random((25, 8))
    assert np.array_equal(qmax.recurrence(x, y), qmax.recurrence(y, x).T)
    assert qmax.recurrence(x, x).diagonal().all()


def test_pairs_of_all_shapes_at_once(monkeypatch):
    rng = np.random.default_rng(11)
    # Few different values, so that profiles tie and cells meet the bound; sides of 1 to 14 states, some of them equal.
    sequences = [(rng.integers(0, 3, (int(n), 24)) / 2, rng.integers(0, 2, 12) / 2.0) for n in rng.choice([1, 2, 5, 9, 14], 16)]
    sequences += [(sequences[3][0], np.ones(12)), (np.zeros((6, 24)), np.zeros(12)), (np.zeros((0, 24)), np.zeros(12))]
    pairs = [(a, b) for a in sequences for b in sequences]

    def one_way(a, b):
        if not len(a[0]) or not len(b[0]):
            return np.inf
        steps = int(np.argmax(np.round([a[1] @ np.roll(b[1], k) for k in range(12)], 9)))
        rolled = np.concatenate([np.roll(f, steps, axis=1) for f in np.split(b[0], 2, axis=1)], axis=1)
        d = np.sqrt(((a[0][:, None] - rolled[None]) ** 2).sum(axis=2)).round(9)
        cut = 1e-9 + np.minimum.outer(np.quantile(d, 0.2, axis=1), np.quantile(d, 0.2, axis=0))
        plot = d <= cut
        found = plain_score(plot, 0.5, 0.7) if min(plot.shape) > 2 else 0
        return np.sqrt(len(b[0])) / found if found else np.inf

    how = {"kappa": 0.2, "gap_open": 0.5, "gap_extend": 0.7}
    for cells in (1, 3000, qmax.CELLS):
        monkeypatch.setattr(qmax, "CELLS", cells)
        ahead = qmax.distances(pairs, symmetric=False, **how)
        both = qmax.distances(pairs, **how)
        alone = np.array([qmax.distance(*a, *b, **how) for a, b in pairs])
        assert np.array_equal(both, alone)
        want = np.array([one_way(a, b) for a, b in pairs])
        back = np.array([one_way(b, a) for a, b in pairs])
        assert np.allclose(ahead, want) and np.allclose(both, np.minimum(want, back))
        assert np.array_equal(np.isnan(qmax.densities([(a[0], b[0]) for a, b in pairs])), [not len(a[0]) or not len(b[0]) for a, b in pairs])


def test_alignment_distance(spark):
    x = rand(60, 4)
    a = (x, np.ones(12) / np.sqrt(12))
    s = qmax.distance(np.tile(x, (1, 1)), a[1], x, a[1])
    assert s < qmax.distance(x, a[1], rand(60, 9), a[1])
    one, two = (qmax.distance(x, a[1], rand(50, 8), a[1], symmetric=False), qmax.distance(rand(50, 8), a[1], x, a[1], symmetric=False))
    assert qmax.distance(x, a[1], rand(50, 8), a[1]) == min(one, two)
    assert qmax.distance(x[:2], a[1], x[:2], a[1]) == np.inf
    assert np.allclose(qmax.transpose_states(rand(5).repeat(2, axis=1), 0), rand(5).repeat(2, axis=1))
