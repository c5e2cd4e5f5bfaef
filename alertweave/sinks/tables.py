"""Writers: stage tables, text artifacts, checksum inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Stage tables are partitioned by a prefix of the document hash: even, bounded, prunable.
_BUCKET = "bucket"

# Fixed part: which stage artifact has which role and media type.
_ROLES = [
    (r"^input/", "input"),
    (r"^normalized/", "normalized"),
    (r"^context/", "context"),
    (r"^evidence/", "evidence"),
    (r"^model/", "model"),
    (r"^decision/", "decision"),
    (r"^report/", "report"),
]


def write_stage(rows: DataFrame, location: str, key: str = "raw_sarif_sha256") -> None:
    """A stage table never overwrites another; variants are stored as they are."""
    bucketed = rows.withColumn(_BUCKET, F.substring(key, 1, 2))
    bucketed.write.mode("errorifexists").partitionBy(_BUCKET).parquet(location)


def read_stage(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.parquet(location).drop(_BUCKET)


def write_lines(lines: DataFrame, location: str, order: list[str] | None = None) -> None:
    """Column ``value`` as text. With ``order`` the files are ranges in that order."""
    if order:
        lines = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("value").write.mode("errorifexists").text(location)


def write_dot(lines: DataFrame, location: str) -> None:
    """One folder per document, lines of one document in one sorted file."""
    (
        lines.repartition("raw_sarif_sha256")
        .sortWithinPartitions("raw_sarif_sha256", "part", "run_index", "result_index", "ord")
        .select("raw_sarif_sha256", F.col("line").alias("value"))
        .write.mode("errorifexists")
        .partitionBy("raw_sarif_sha256")
        .text(location)
    )


def inventory(spark: SparkSession, location: str) -> DataFrame:
    """``relative_path, sha256, size_bytes, role, media_type`` of the files below a folder."""
    root = location.rstrip("/")
    path = F.regexp_replace("path", rf"^.*?\Q{root}\E/", "")
    role = F.lit("metadata")
    for pattern, name in reversed(_ROLES):
        role = F.when(F.col("relative_path").rlike(pattern), name).otherwise(role)
    media = (
        F.when(F.col("relative_path").endswith(".html"), "text/html")
        .when(F.col("relative_path").endswith(".jsonl"), "application/x-ndjson")
        .when(F.col("relative_path").endswith(".json"), "application/json")
        .when(F.col("relative_path").endswith(".sarif"), "application/sarif+json")
        .otherwise("application/octet-stream")
    )
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(location)
        .select(
            path.alias("relative_path"),
            F.sha2("content", 256).alias("sha256"),
            F.col("length").alias("size_bytes"),
        )
        .withColumn("role", role)
        .withColumn("media_type", media)
    )


def checksum_lines(files: DataFrame) -> DataFrame:
    """``name, value`` of a checksum list: hash, two blanks, name."""
    return files.select(
        F.col("relative_path").alias("name"),
        F.concat_ws("  ", "sha256", "relative_path").alias("value"),
    )


def write_checksums(files: DataFrame, location: str) -> None:
    write_lines(checksum_lines(files), location, ["name"])
