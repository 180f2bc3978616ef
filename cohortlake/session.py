"""What every job with Python workers needs from its session."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where it is unset, a folder of our own if the master is
    local, so that driver and tasks are one process on one machine; on a cluster an error, as executors would write to their own disks."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError(f"spark.checkpoint.dir is not set; with master {context.master} it must name a folder that driver and executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="cohortlake-")
    return _own_dirs[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, so that they can import it wherever it lies on the driver."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).parent
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='cohortlake-')}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(made)
    _shipped.add(app)
