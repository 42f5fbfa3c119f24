"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(app: str = "cytolith", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and Arrow on; a cluster's own settings (master, memory) are left alone."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.config(map=conf).getOrCreate() if conf else builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for each context.

    Spark's file server sends the archive; the executors don't need the driver's folder.
    """
    # rows are texts, pages or sets: where the session leaves it open, fewer of them go to Python at a time
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "2000")
    context = spark.sparkContext
    if getattr(context, "_cytolith_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "cytolith.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._cytolith_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local session may have one of our own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not configured and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoints"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return (configured or str(current.get())).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
