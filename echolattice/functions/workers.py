"""What Python workers need before they run this package's functions."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Applications that have the package.
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application; it needn't be installed where they run.

    The archive is made in a folder of the driver and goes out over Spark's own file server, as any added file does.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="echolattice-")) / "echolattice.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent).as_posix())
    sc.addPyFile(str(archive))
    _SENT.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and the master is local, one of this process."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _OWN:
            _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="echolattice-")
        d = _OWN[sc.applicationId]
    return d.rstrip("/")


_OWN: dict[str, str] = {}
