import hashlib

import numpy as np
import pytest
from echolattice.operators import evaluation as ev
from echolattice.operators import rankings


def drawn(i, j, seed=0):
    return int(hashlib.md5(f"{seed}:{min(i, j)}:{max(i, j)}".encode(), usedforsecurity=False).hexdigest()[:8], 16)


@pytest.mark.parametrize("digests", [7, 100, 1 << 15])
@pytest.mark.parametrize("seed", [0, 123456])
def test_draws_across_forms(monkeypatch, digests, seed):
    """Stretches of one form and of several, ids in any order, of all lengths."""
    monkeypatch.setattr(rankings, "DIGESTS", digests)
    rng = np.random.default_rng(2)
    for ids in (np.arange(120), np.array([-(10**17), -20, 5, 10**9, 10**17, 2**62]), rng.permutation(300) - 50, np.array([3]), np.array([], np.int64)):
        draws = rankings.Draws(seed, ids)
        for i in (*ids[:9].tolist(), *ids[-3:].tolist()):
            assert draws(i).tolist() == [drawn(i, j, seed) for j in ids.tolist()]
        assert draws.block(ids[:2]).tolist() == [[drawn(i, j, seed) for j in ids.tolist()] for i in ids[:2].tolist()]


def test_few_digests_by_themselves(monkeypatch):
    """A call of a digest costs as much as thousands of messages: it was called for each length of an id and each side."""
    calls, one = [], rankings.md5_words
    monkeypatch.setattr(rankings, "md5_words", lambda *a: calls.append(1) or one(*a))
    rankings.Draws(0, np.arange(12_000))(700)
    assert len(calls) == 1


def test_a_block_holds_few_cells(spark):
    """256 queries' distances from 120,000 items took 2.4 GB in an executor."""
    n, labelled = 20_000, 300
    items = spark.range(n).selectExpr("id as item_idx", f"if(id % {n // labelled} = 0 and id < {n - n % labelled}, id % 7, null) as label", "cast(array() as array<double>) as vec")

    def distance(own, _, every, __):
        if len(own) * len(every) > 1 << 21:
            raise ValueError("too many at once")
        return (own[:, None] * 7919 + every * 104729) % 1000003

    got = {r["query_idx"]: r for r in ev.score_vectors(items, None, distance=distance).collect()}
    labels = np.array([-1 if r["label"] is None else r["label"] for r in items.orderBy("item_idx").collect()])
    own = np.flatnonzero(labels >= 0)[::50]
    want = ev.score_block(distance(own, None, np.arange(n), None).astype(float), own, labels, 10)
    assert len(got) > 290
    assert all(abs(got[q][c] - want[c][k]) < 1e-9 for k, q in enumerate(own.tolist()) for c in want)


def test_scores_of_distances():
    """Relevance as a bit of what is sorted: ties, distances that aren't finite, items without a label."""
    rng = np.random.default_rng(5)
    for most in (3, 50, 1 << 33):
        codes = rng.integers(0, most, (12, 40))
        codes[rng.random(codes.shape) < 0.1] = rankings.LAST
        labels = np.append(rng.integers(0, 4, 36), [-1] * 4)
        own = np.arange(12)
        d = np.where(codes == rankings.LAST, np.inf, codes.astype(float))
        want = ev.score_block(d, own, labels, 5)
        for got in (rankings.score_distances(codes.copy(), own, labels, 5), rankings.score_codes(*rankings.order_codes(codes.copy(), own), own, labels, 5)):
            assert all(np.allclose(got[c], want[c], rtol=0, atol=1e-12) for c in want)
