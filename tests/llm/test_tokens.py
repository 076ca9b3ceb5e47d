import zlib

import numpy as np
import pytest
from echolattice.llm import simple8b, token_files
from echolattice.llm.common import tokenizer_path
from echolattice.llm.tokens import ByteLevel, WordLevel, _Library
from hypothesis import example, given, settings
from hypothesis import strategies as st

KINDS = {ByteLevel: tokenizer_path("byte_bpe_50k.json"), WordLevel: tokenizer_path("word_bpe_49k.json")}
HELD = {k: (k(p), _Library(p)) for k, p in KINDS.items()}


@pytest.mark.parametrize("kind", list(KINDS))
@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("abIm' .,!?éßÅ0123\n\t", max_size=60)), max_size=5))
@example(["I'm we'll THE's 'S", "<|endoftext|> <|startoftext|>", "a\x1cb \x00 c\x00d", "é Å ΣΑΣ İ ﬁ ½ x² ª", "", " ", "日本 語", "\U0001f642\U0001f642"])
def test_like_the_library(kind, texts):
    own, library = HELD[kind]
    ids, off = own(texts)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == [library(t).tolist() for t in texts]


@pytest.mark.parametrize("kind", list(KINDS))
def test_added_tokens(kind):
    """Against the library as it comes from the file."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(KINDS[kind])
    texts = ["one <|endoftext|> two", "plain", "<|startoftext|>x", "a<|endoftext|>b<|endoftext|>", "<|ENDOFTEXT|> <|endof text|>", "<|endoftext|>\x1c", "one"]
    ids, off = HELD[kind][0](texts)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert plain.token_to_id("<|endoftext|>") in ids


def test_added_tokens_through_the_queries(spark, tmp_path):
    """Both queries on documents with the strings of added tokens, against the library as it comes from the file."""
    from echolattice.llm import packing
    from tokenizers import Tokenizer

    texts = ["<|endoftext|>", "a<|startoftext|>b", "x <|endoftext|> <|endoftext|>y\n<|endoftext|>", "<|endoftext", "plain text", " <|startoftext|> ", "w<|endoftext|>" * 2000, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for kind, end, query in ((ByteLevel, 1, packing.op6_cutting_stock), (WordLevel, 2, token_files.op7_simple8b_files)):
        plain = Tokenizer.from_file(KINDS[kind])
        ids = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]
        assert any(plain.token_to_id("<|endoftext|>") in x for x in ids)
        rows = query(spark, str(tmp_path)).collect()
        if kind is WordLevel:
            start = np.cumsum([0, *map(len, ids)])
            assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows) == [(i, start[i], len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)]
            continue
        assert sum(r["length"] for r in rows) == sum(map(len, ids))
        for r in rows:
            own = ids[r["doc_id"]]
            assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())


@pytest.mark.parametrize("kind", list(KINDS))
def test_long_words(kind):
    own, library = HELD[kind]
    for t in ("a" * 20_000, "ab1" * 5_000, "\n" * 5_000 + "x", "é" * 3_000):
        assert own([t])[0].tolist() == library(t).tolist()


IDS = st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300)


@settings(max_examples=200, deadline=None)
@given(IDS, st.integers(0, 600), st.integers(1, 40))
def test_simple8b(ids, zeros, times):
    x = np.array((ids + [0] * zeros) * times, np.uint64)
    words, first = simple8b.encode(x)
    assert np.array_equal(simple8b.decode(words), x)
    for k in range(len(first)):
        assert np.array_equal(simple8b.decode_block(words, first, k), x[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK])


def test_simple8b_is_small():
    x = np.random.default_rng(1).integers(0, 1 << 15, 100_000)
    assert len(simple8b.encode(x)[0]) <= len(x) / 4 * 1.01
    assert len(simple8b.encode(np.zeros(4096 * 3))[0]) == 3 * (17 + 2)


def test_file_format():
    data = token_files.pack([None, 5, 5], np.array([2, 0, 3]), np.array([7, 2, 50_000, 1, 2]))
    docs, counts, ids = token_files.unpack(data)
    assert docs == [None, 5, 5] and counts.tolist() == [2, 0, 3] and ids.tolist() == [7, 2, 50_000, 1, 2]
    for bad in (data[:-1], data[:20] + bytes([data[20] ^ 1]) + data[21:], b""):
        with pytest.raises(ValueError):
            token_files.unpack(bad)


@pytest.mark.parametrize("file_ids", [2_000_000, 700])
def test_files_query(spark, tmp_path, docs, corpus, monkeypatch, file_ids):
    monkeypatch.setattr(token_files, "FILE_IDS", file_ids)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r for r in token_files.op7_simple8b_files(spark, str(tmp_path)).collect()), key=lambda r: r["start"])
    library, at, want = HELD[WordLevel][1], 0, {}
    keys = [r["doc_id"] for r in got]
    assert keys == sorted((r[0] for r in corpus), key=lambda k: (k is not None, k or 0))
    for i, t, *_ in corpus:
        ids = np.append(library(t or ""), 2).astype("<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(want.values())


def test_no_files(spark, tmp_path, no_docs):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert token_files.op7_simple8b_files(spark, str(tmp_path)).count() == 0
