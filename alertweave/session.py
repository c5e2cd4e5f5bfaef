"""Session helpers: settings the plans rely on, and lineage cuts in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Session settings that can be changed on a running session. AQE coalesces small and splits
# skewed shuffle partitions; UTC keeps event times comparable.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

OCCURRENCE = ["raw_sarif_sha256", "run_index", "result_index"]


def apply_settings(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("alertweave")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # call sites of column calls are costly to record and only help debugging
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("ALERTWEAVE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return apply_settings(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, and its own only on one machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        # the setting is fixed once a session runs, so the folder is named to the context and read back from it
        context.setCheckpointDir(tempfile.mkdtemp(prefix="alertweave-checkpoint-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are made and run inside are removed when each ends, and not when the driver
    happens to collect its garbage. For results that are written or fetched once: rounds of many small steps
    would otherwise keep the shuffles of all steps before on the executors' disks."""
    before = spark.conf.get(_REMOVE_SHUFFLES, "false")
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVE_SHUFFLES, before)


def stored(frame: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes a frame once as Parquet into the shared folder and reads it back: later steps, and
    tasks run again after a lost executor, start from the files. Wide rows take a fraction of the
    disk that a checkpoint takes, and each reader reads the columns it needs."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        frame.write.option("compression", codec).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def by_occurrence(**parts: DataFrame) -> DataFrame:
    """One row per occurrence with a list of structs per part, in no order; a list is empty where a part has no row.

    The rows are dealt once, by document: rows of one document repeat its text and hashes and lie together,
    so they are compressed well, and what is grouped by occurrence or joined by document next stays there.
    """
    kinds = {
        name: rows.select(F.struct(*[column for column in rows.columns if column not in OCCURRENCE])).schema[0].dataType
        for name, rows in parts.items()
    }
    united = None
    for name, rows in parts.items():
        own = [column for column in rows.columns if column not in OCCURRENCE]
        frame = rows.select(
            *OCCURRENCE,
            *[(F.struct(*own) if other == name else F.lit(None).cast(kind)).alias(other) for other, kind in kinds.items()],
        )
        united = frame if united is None else united.union(frame)
    return (
        united.repartition("raw_sarif_sha256")
        .groupBy(*OCCURRENCE)
        .agg(*[F.collect_list(name).alias(name) for name in parts])
    )


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    with shuffles_removed(frame.sparkSession):
        # a query of its own: the frame's own one may run again
        return frame.select("*").checkpoint(eager=True)
