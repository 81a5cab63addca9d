"""Sessions, and this package on the executors of any session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).parent
    handle, path = tempfile.mkstemp(prefix=f"{package.name}-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which ``spark.checkpoint.dir`` names.

    A session on one machine without that setting (tests) gets a folder of its
    own, once; on a cluster a local folder would be no use, so it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = context.getCheckpointDir()
        if at is None:
            at = tempfile.mkdtemp(prefix="lanewright-")
            context.setCheckpointDir(at)
    return at.rstrip("/")
