"""What several operators need: word counts, row carrying, seeded order, tables in the shared folder."""

from __future__ import annotations

import math
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertweave.session import stored  # noqa: F401 - steps take it from here

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_SHIPPED: set[str] = set()
# rows that reach a Python worker at once: texts are long, and a worker holds a batch several times
ROWS_AT_ONCE = 2500


def prepare(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, as they need not have it, and
    keeps the batches of Python workers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="alertweave-"), "alertweave_package.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, source.relative_to(root.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def seeded(seed: int, *columns: Column) -> Column:
    """A hash that orders rows at random but alike in every run."""
    return F.xxhash64(F.lit(seed), *columns)


def likely_first(order: Column, wanted: int, rows: int) -> Column:
    """Holds for the rows that can be among the first ``wanted`` of ``rows`` by a uniform hash, and
    for few others: what is then sorted and cut does not grow with the number of tasks. Four times
    as many are let through as are wanted on average, and at least 64 more."""
    share = min(1.0, (4 * wanted + 64) / max(1, rows))
    return order <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1)


def shard_count(rows: int) -> int:
    """Shards so that both the rows of a shard and the number of shards stay near the root."""
    return max(1, math.ceil(math.sqrt(rows) / 2))


def rank_within(frame: DataFrame, group: str, shard: str, order: list[Column], out: str) -> DataFrame:
    """Numbers the rows of each group from 0 without gathering a group in one task: rows are
    numbered inside ``(group, shard)`` and shifted by the counts of the shards before."""
    before = (
        frame.groupBy(group, shard)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            F.col(group).alias("_group"),
            F.col(shard).alias("_shard"),
            F.coalesce(
                F.sum("_rows").over(
                    Window.partitionBy(group).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_before"),
        )
    )
    inside = Window.partitionBy(group, shard).orderBy(*order)
    return (
        frame.join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col(shard) == F.col("_shard")))
        .withColumn(out, F.row_number().over(inside) - 1 + F.col("_before"))
        .drop("_group", "_shard", "_before")
    )
