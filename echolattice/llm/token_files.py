"""Token ids in binary files: Simple-8b blocks, with an index of the blocks and of the documents.

A file, all little-endian: 8 bytes MAGIC; the words, 8 bytes each; for each block the number of its first word; for each
document its id and its number of ids, 8 bytes each, and a byte that says whether the id is null; then words, blocks,
documents, ids, the first four fields' CRC-32, and MAGIC again, 8 bytes each. Files are in ascending doc_id order by their
numbers (part, then file of the part); a part's last attempt alone is in the table of files.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolattice.llm import simple8b
from echolattice.llm.common import Scratch, ship, small, text_slices, tokenizer_path
from echolattice.llm.tokens import WordLevel, encoder

MAGIC = b"S8BIDS01"
#: Ids after which a file is closed: some 6 MB, so that a reader holds one file at a time.
FILE_IDS = 2_000_000
END_ID = 2


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes."""
    words, first = simple8b.encode(ids)
    body = b"".join(
        [
            words.astype("<u8").tobytes(),
            first.astype("<i8").tobytes(),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.asarray(counts, "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        ]
    )
    tail = np.array([len(words), len(first), len(doc_ids), len(ids), zlib.crc32(body)], "<i8").tobytes()
    return MAGIC + body + tail + MAGIC


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids of a file; a damaged file raises."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a file of token ids, or cut short")
    n_words, n_blocks, n_docs, n_ids, crc = np.frombuffer(data[-48:-8], "<i8").tolist()
    body = memoryview(data)[8:-48]
    if zlib.crc32(body) != crc:
        raise ValueError("damaged file of token ids")
    cut = np.cumsum([8 * n_words, 8 * n_blocks, 8 * n_docs, 8 * n_docs])
    ids = simple8b.decode(np.frombuffer(body[: cut[0]], "<u8"))
    if len(ids) != n_ids:
        raise ValueError("damaged file of token ids")
    docs = np.frombuffer(body[cut[1] : cut[2]], "<i8").tolist()
    null = np.frombuffer(body[cut[3] :], np.uint8)
    return [None if z else d for d, z in zip(docs, null, strict=True)], np.frombuffer(body[cut[2] : cut[3]], "<i8"), ids


def write_token_files(docs: DataFrame, folder: str, path: str, scratch: Scratch, end_id: int = END_ID) -> DataFrame:
    """Write docs(doc_id, text) into files in folder, by ascending doc_id (nulls first; repeated ids by their texts).

    Returns the table of files: part, file, name, docs, ids. A lost executor's tasks run again and write files of other
    names; the table has those of the attempts that ended, and readers go by it.
    """
    ship(docs.sparkSession)
    # An equal share of documents a part, by key alone; a key that many rows have is dealt out by its texts' hashes.
    ranged = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    ranged = ranged.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").drop("_h")

    def write(batches):
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://"))
        fs.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        enc, held, n, file = encoder(WordLevel, path), [], 0, 0

        def close():
            nonlocal held, n, file
            name = f"part-{part:06d}-{file:05d}-{attempt}.s8b"
            doc_ids = [x for h in held for x in h[0]]
            ids, counts = np.concatenate([h[2] for h in held]), np.concatenate([h[1] for h in held])
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(pack(doc_ids, counts, ids))
            out = pa.RecordBatch.from_pydict({"part": [part], "file": [file], "name": [name], "docs": [len(doc_ids)], "ids": [len(ids)]}, schema=files)
            held, n, file = [], 0, file + 1
            return out

        for b in batches:
            text, keys = b.column(1), b.column(0).to_pylist()
            for i, off, _ in text_slices(text):
                rows = len(off) - 1
                ids, ends = enc(text.slice(i, rows).to_pylist())
                counts = np.diff(ends) + 1
                out = np.full(int(counts.sum()), end_id, np.uint32)
                to = np.ones(len(out), bool)
                to[np.cumsum(counts) - 1] = False
                out[to] = ids
                held.append((keys[i : i + rows], counts, out))
                n += len(out)
                if n >= FILE_IDS:
                    yield close()
        if held:
            yield close()

    files = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
    return scratch.write(ranged.mapInArrow(write, "part int, file int, name string, docs long, ids long"))


def read_token_files(spark: SparkSession, folder: str, files: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids themselves, from the files."""
    ship(spark)
    starts = files.groupBy("part").agg(F.sum("ids").alias("n"))
    parts = starts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = files.withColumn("own", own).join(F.broadcast(parts), "part").select("name", (F.col("before") + F.col("own")).alias("start"))

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def read(batches):
        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                docs, counts, ids = unpack(data.as_buffer().to_pybytes())
                ids, ends = ids.astype("<u4"), np.cumsum(counts)
                begins = ends - counts
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
                for i in range(0, len(docs), 2000):
                    j = min(i + 2000, len(docs))
                    own = [pa.array(docs[i:j], pa.int64()), pa.array(begins[i:j] + start, pa.int64()), pa.array(counts[i:j], pa.int64()), pa.array(crc[i:j], pa.int64())]
                    if not with_ids:
                        yield pa.RecordBatch.from_arrays(own, names=names)
                        continue
                    at = np.concatenate([begins[i:j], ends[j - 1 : j]]) - begins[i]
                    tokens = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids[begins[i] : ends[j - 1]].astype(np.int32), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*own, tokens], names=[*names, "ids"])

    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    held = found.join(small(listed), "name").select("start", "content")
    return held.mapInArrow(read, ", ".join(f"{x} long" for x in names) + ", ids array<int>" * with_ids)


def op7_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through files: written in ascending doc_id order, read back, and described by what was read.

    Null and empty texts have the end id alone. Rows that repeat a doc_id are separate documents. An empty table has no files.
    """
    scratch = Scratch(spark, "token-files")
    folder = scratch.folder()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_token_files(docs, folder, tokenizer_path("word_bpe_49k.json"), scratch)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, folder, files, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
