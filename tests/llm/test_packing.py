import zlib
from collections import defaultdict

import numpy as np
from echolattice.llm import packing
from echolattice.llm.common import tokenizer_path
from echolattice.llm.tokens import _Library
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = tokenizer_path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), min_size=1, max_size=20))
def test_plan_meets_demand(demand):
    size = np.array(sorted(demand))
    want = np.array([demand[s] for s in sorted(demand)])
    plan = packing.plan(size, want, 64)
    assert (sum(c * n for c, n in plan) == want).all()
    assert all(size @ c <= 64 and n > 0 for c, n in plan)
    used = sum(n for _, n in plan)
    largest_alone = int(want[size > 32].sum())
    assert used >= max(-(-int(size @ want) // 64), largest_alone)
    assert used <= 2 * max(-(-int(size @ want) // 64), largest_alone) + 1


def test_linear_program_fills_sequences():
    size = np.arange(1, 65)
    want = np.full(64, 500)
    assert sum(n for _, n in packing.plan(size, want, 64)) <= int(size @ want) / 64 * 1.01


def test_awkward_lengths_are_cut():
    """Very many pieces of just over half a sequence go into binary parts, and little is left free."""
    size, want = np.array([9, 138, 200, 256]), np.array([100, 5000, 300, 50])
    cut, own, plan = packing.plan_with_cuts(size, want, 256, 8)
    assert 138 in cut
    parts = {}
    for c, n in zip(size.tolist(), want.tolist(), strict=True):
        for x in packing.part_lengths(c * 8) if c in cut else [c * 8]:
            parts[x // 8] = parts.get(x // 8, 0) + n
    assert {int(c): int(sum(x[k] * n for x, n in plan)) for k, c in enumerate(own)} == parts
    assert sum(n for _, n in plan) <= int(size @ want) / 256 * 1.01 + 1
    assert packing.part_lengths(2047) == [1024, 512, 256, 128, 64, 63] and packing.part_lengths(64) == [64]


def test_knapsack():
    value, column = packing.price(np.array([3.0, 4.0, 5.1]), np.array([3, 4, 5]), 11)
    assert abs(value - 11.1) < 1e-9 and column.tolist() == [2, 0, 1]


def test_pieces_and_sequences(docs, corpus, scratch):
    got = packing.pack(docs, PATH, scratch).collect()
    lib, by, seqs = _Library(PATH), defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for i, t, *_ in corpus:
        ids = np.append(lib(t or ""), 1).astype("<u4")
        want[i].append(ids)
    for i, texts in want.items():
        rows = sorted(by[i], key=lambda r: (r["doc_tokens"], r["start"]))
        for ids in sorted(texts, key=len):
            at = 0
            while at < len(ids):  # texts that share an id are equal here, so any of their pieces will do
                r = next(r for r in rows if r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()))
                rows.remove(r)
                at += r["length"]
            assert at == len(ids)
        assert not rows
    total = 0
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
    assert sorted(seqs) == list(range(len(seqs)))
    assert len(seqs) <= total / 2048 * 1.05 + 2


def test_empty(no_docs, scratch):
    assert packing.pack(no_docs, PATH, scratch).count() == 0
