"""Single files: plain paths on the driver, those with a scheme through Spark's own file systems."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import SparkSession


def local(path: str) -> str | None:
    """The path on this machine that a plain path or a file: URI names; None for other schemes."""
    if path.startswith("file:"):
        return unquote("/" + path[5:].lstrip("/"))
    return None if "://" in path else path


def _fs(path: str, spark: SparkSession | None):
    sc = (spark or SparkSession.getActiveSession()).sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return sc, p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def write_bytes(path: str, data: bytes, spark: SparkSession | None = None) -> None:
    """Folders are made as needed; an old file is replaced."""
    if (own := local(path)) is not None:
        Path(own).parent.mkdir(parents=True, exist_ok=True)
        Path(own).write_bytes(data)
        return
    _, p, fs = _fs(path, spark)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(path: str, spark: SparkSession | None = None) -> bytes:
    """A missing file raises."""
    if (own := local(path)) is not None:
        return Path(own).read_bytes()
    sc, p, fs = _fs(path, spark)
    opened = fs.open(p)
    try:
        return bytes(sc._jvm.org.apache.commons.io.IOUtils.toByteArray(opened))
    finally:
        opened.close()
