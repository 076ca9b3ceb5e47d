"""The corpus pipeline: documents to packed sequences, in five stages of the corpus operators.

Null and empty texts are judged by the classifier like others, pass the line and the Jaccard stage, cost nothing where sources
are mixed, and are packed as their end id. Rows without doc_id have no near-duplicates. Rows that repeat a doc_id and a text
are one document to the first three stages and are kept or dropped alike. Other columns are carried to the last stage. An
empty table stays empty; without labels of both kinds no document is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolattice.llm import jaccard_join, line_dedup, mixing, packing, quality_classifier
from echolattice.llm.common import Scratch, quoted, tokenizer_path, without

#: The stages aren't expressible in SQL; tests hold them against plain versions.
ORACLE_SQL = None
#: Tokens kept by the mixing stage, in hundredths; a document is taken once at most.
MIX_SHARE, MIX_EPOCHS = 90, 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scratch = Scratch(spark, "stage-quality")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdict = quality_classifier.classify(docs, labels, scratch)
    gone = scratch.write(verdict.where("not kept").select(F.col("doc_id").alias("doc"), F.col("text_key").alias("key")).distinct())
    held = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    left = without(held, "text_hash", gone, "key", F.col("id").eqNullSafe(F.col("doc")) & (F.col("text_hash") == F.col("key")))
    return left.select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that have an earlier occurrence go, and documents of which only white space is left by that."""
    names = docs.columns
    out = line_dedup.dedup_lines(docs, Scratch(spark, "stage-lines"))
    removed = F.col(out.columns[-1])
    out = out.where((removed == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"n_chars": F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in names else {}
    return out.withColumns(changed).select(*quoted(names))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id stays of each group of near-duplicates."""
    scratch = Scratch(spark, "stage-jaccard")
    found = jaccard_join.jaccard_components(docs, scratch)
    gone = scratch.write(found.where("doc_id <> component_id").select("doc_id").distinct())
    return without(docs, "doc_id", gone, "doc_id", "doc_id").select(*quoted(docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's prefix under the target weights."""
    out = mixing.mix(docs, Scratch(spark, "stage-mixing"), mixing.domain_of(F.col("source")), share=MIX_SHARE, epochs=MIX_EPOCHS)
    return out.select(*quoted(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), Scratch(spark, "stage-packing"))


STAGES = [("quality", quality), ("lines", lines), ("jaccard", jaccard), ("mixing", mixture), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again before the next."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
