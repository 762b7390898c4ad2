"""Session helpers. On a cluster the session is given; these defaults serve local runs and tests."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench rely on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablewright")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only on one machine (a local master, as in tests) a folder is made where the setting is absent; on a cluster that
    is an error, as no folder of one machine would do.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not configured:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tablewright_")
        spark.conf.set("spark.checkpoint.dir", configured)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared place, whatever file system it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of the session, once per context."""
    context = spark.sparkContext
    if getattr(context, "_tablewright_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tablewright_ship_")
    archive = shutil.make_archive(f"{folder}/tablewright_package", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._tablewright_shipped = True
