import re

import pytest
from conftest import DOCS
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    """Every stage on what the one before kept: columns stay, and its decisions are those of its operator."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in cp.STAGES] == ["quality", "lines", "jaccard", "mixing", "packing"]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        docs, last = spark.read.parquet(f"{tmp_path}/{name}"), docs
        if name != "packing":
            assert docs.columns == columns and [t for _, t in docs.dtypes] == [t for _, t in last.dtypes]
            assert 0 < docs.count() <= before
            assert docs.join(last, "doc_id", "left_anti").count() == 0
            before = docs.count()
    assert docs.agg(F.sum("length")).first()[0] == docs.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
    lines = [x for r in spark.read.parquet(f"{tmp_path}/lines").collect() for x in (r["text"] or "").split("\n") if len(x) >= 40 and re.search(r"\S", x)]
    assert len(lines) == len(set(lines))
    first = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1")
    assert first.join(spark.read.parquet(f"{tmp_path}/quality"), "doc_id", "left_anti").count() <= 1


def test_run_is_all_stages(spark):
    import corpus_pipeline as cp

    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, None, None, None, None), (None, "x y", "en", "src1", 3), (2, "", "", "", 0)]])
def test_odd_tables(spark, tmp_path, rows):
    import corpus_pipeline as cp

    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    # of two words in all, a budget of 90 % takes no document of two; those without words cost nothing
    assert sorted((r["doc_id"], r["length"]) for r in got) == ([(1, 1), (1, 1), (2, 1)] if rows else [])


def test_lines_and_jaccard_against_plain_versions(spark):
    """The two stages on the smallest table, held against all pairs."""
    import corpus_pipeline as cp
    from echolattice.llm import line_dedup
    from test_components import components
    from test_jaccard_join import brute

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    lines = sorted({x for _, t in rows for x in t.split("\n") if len(x) >= line_dedup.PER}, key=len)
    near = []
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if len(b) > len(a) + (most := min(line_dedup.EDITS, len(a) // line_dedup.PER)):
                break
            if line_dedup.within(a, b, most):
                near.append((a, b))
    comp, seen, want = components(near), set(), {}
    for i, t in rows:
        kept = []
        for x in t.split("\n"):
            if len(x) >= line_dedup.LEAST and re.search(r"[^\x20\x09-\x0D]", x):
                if (c := comp.get(x, x)) in seen:
                    continue
                seen.add(c)
            kept.append(x)
        if len(kept) == t.count("\n") + 1 or re.search(r"[^\x20\x09-\x0D]", "\n".join(kept)):
            want[i] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in cp.lines(spark, docs, sf).collect()} == want
    alone = {i for i, _, c in brute(rows) if i == c}
    assert {r["doc_id"] for r in cp.jaccard(spark, docs, sf).collect()} == alone


#: Names that the stages and their operators use inside.
INSIDE = """_text _doc _row row doc key id text_hash _removed _lines _tokens _domain _epoch _lang _source d t at line line2 class gone new lines removed
sig sig2 n rep component component_id node part task side tasks text_key y t_upper m_lang score kept _class _bucket length start offset _n _before a.b""".split()


def test_any_columns(spark, tmp_path):
    """Every stage on a table whose other columns have the names that are used inside: their values stay."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in INSIDE))
    plain, wide = docs, more
    for name, stage in cp.STAGES:
        (plain_, wide_) = stage(spark, plain, sf), stage(spark, wide, sf)
        plain_.write.parquet(f"{tmp_path}/plain/{name}")
        wide_.write.parquet(f"{tmp_path}/wide/{name}")
        plain, wide = spark.read.parquet(f"{tmp_path}/plain/{name}"), spark.read.parquet(f"{tmp_path}/wide/{name}")
        if name == "packing":
            assert plain.count() == wide.count()
            continue
        assert wide.columns == more.columns
        rows = wide.collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in plain.collect())
        assert all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in INSIDE)


def test_quality_mixing_and_packing_against_plain_versions(spark, tmp_path):
    """The three stages on the smallest tables: a classifier in NumPy, prefixes worked out by hand, and the plain tokenizer's ids."""
    import zlib
    from collections import defaultdict

    import corpus_pipeline as cp
    import numpy as np
    from echolattice.llm import quality_classifier as qc
    from echolattice.llm.common import tokenizer_path
    from test_mixing import plain_mix
    from test_quality import plain_scores
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    table = qc.views(docs).collect()
    scores = plain_scores(table, {r["doc_id"]: r["quality"] for r in labels.collect()})
    want = {r["doc_id"] for r, s in zip(table, scores, strict=True) if s >= qc.KEEP}
    near = {r["doc_id"] for r, s in zip(table, scores, strict=True) if abs(s - qc.KEEP) < 0.005}
    got = {r["doc_id"] for r in cp.quality(spark, docs, sf).collect()}
    assert (got ^ want) <= near and got

    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    mixed = cp.mixture(spark, docs, sf)
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(i for (i, _), n in plain_mix(rows, cp.MIX_SHARE, cp.MIX_EPOCHS).items() for _ in range(n))

    plain, pieces, sequences = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), defaultdict(list), defaultdict(list)
    for r in cp.pack(spark, docs, sf).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == {i for i, *_ in rows}
    for i, t, *_ in rows:
        ids, at = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
