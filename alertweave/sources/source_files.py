"""Source trees: one row per file with its status, exact hash and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave import fixed_values as fixed
from alertweave.functions.expressions import sha256, split_lines
from alertweave.sources.documents import decode_utf8


def scan_sources(
    spark: SparkSession,
    location: str,
    repository_identity: str,
    pattern: str = "*",
    maximum_bytes: int | None = None,
) -> DataFrame:
    """All files of one tree, classified. Paths are relative to ``location``. Every file is hashed,
    whatever its size; a bound only leaves out the text of larger ones, with that status."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(location)
    )
    root = location.rstrip("/")
    relative = F.regexp_replace(F.col("path"), rf"^.*?\Q{root}\E/", "")
    return classify_sources(
        files.select(
            F.lit(repository_identity).alias("repository_identity"),
            relative.alias("path"),
            F.col("length").alias("size"),
            "content",
        ),
        maximum_bytes,
    )


def classify_sources(files: DataFrame, maximum_bytes: int | None = None) -> DataFrame:
    """``repository_identity, path, artifact_sha256, size, status, detail, text``.

    The hash covers the exact bytes; the text drops a leading mark, as SARIF columns do.
    """
    text = decode_utf8(F.col("content"))
    status = (
        F.when(F.lit(False) if maximum_bytes is None else F.col("size") > maximum_bytes, "source_too_large")
        .when(F.position(F.unhex(F.lit("00")), F.col("content")) > 0, "binary_source")
        .when(F.col("content").isNull(), "source_not_regular")
        .when(F.col("text").isNull(), "unsupported_encoding")
        .otherwise("ok")
    )
    detail = (
        F.when(
            F.col("status") == "source_too_large",
            F.format_string(f"source size %d exceeds {maximum_bytes} bytes", "size"),
        )
        .when(F.col("status") == "binary_source", "NUL byte marks source as binary")
        .when(F.col("status") == "source_not_regular", "referenced source is not a regular file")
        .when(F.col("status") == "unsupported_encoding", "only UTF-8 source text is accepted")
    )
    return (
        files.withColumn("text", text)
        .withColumn("status", status)
        .select(
            "repository_identity",
            "path",
            F.sha2("content", 256).alias("artifact_sha256"),
            "size",
            "status",
            detail.alias("detail"),
            F.when(F.col("status") == "ok", F.col("text")).alias("text"),
        )
    )


def text_sources(files: DataFrame) -> DataFrame:
    """The same table from rows that already hold text: ``repository_identity, path, text``."""
    return files.select(
        "repository_identity",
        "path",
        sha256(F.col("text")).alias("artifact_sha256"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("detail"),
        "text",
    )


def source_lines(source_files: DataFrame) -> DataFrame:
    """One row per line with its 1-based number; an empty file has one empty line."""
    return source_files.where("status = 'ok'").select(
        "repository_identity",
        "path",
        F.posexplode(file_lines()).alias("position", "line"),
    ).select("repository_identity", "path", (F.col("position") + 1).alias("line_no"), "line")


def file_lines(text: str = "text"):
    lines = split_lines(F.col(text))
    return F.when(F.col(text) == "", F.array(F.lit(""))).otherwise(lines)


def tree_identity(source_files: DataFrame) -> DataFrame:
    """Per repository: entry count, bytes, largest file, depth, verdict and one digest.

    The digest is a three-level hash tree over ``path, hash, size``. Files fall into 65,536
    leaves by the hash of their path, leaves into 256 branches, branches into the root, so a
    repository that holds most of all files still never gathers them in one place.
    """
    line = F.concat_ws("\0", "path", "artifact_sha256", F.col("size").cast("string"))
    keyed = source_files.select(
        "repository_identity",
        F.substring(sha256(F.col("path")), 1, 4).alias("leaf"),
        line.alias("entry"),
        F.col("size"),
        (F.size(F.split("path", "/")) - 1).alias("depth"),
    )

    def digest(column: str):
        return sha256(F.array_join(F.array_sort(F.collect_list(column)), "\n"))

    leaves = keyed.groupBy("repository_identity", "leaf").agg(
        digest("entry").alias("entry"),
        F.count("*").alias("entries"),
        F.sum("size").alias("bytes"),
        F.max("size").alias("largest"),
        F.max("depth").alias("depth"),
    )
    totals = [
        F.sum("entries").alias("entries"),
        F.sum("bytes").alias("bytes"),
        F.max("largest").alias("largest"),
        F.max("depth").alias("depth"),
    ]
    named = F.concat_ws(":", "leaf", "entry").alias("entry")
    branches = (
        leaves.select("repository_identity", "leaf", named, "entries", "bytes", "largest", "depth")
        .groupBy("repository_identity", F.substring("leaf", 1, 2).alias("leaf"))
        .agg(digest("entry").alias("entry"), *totals)
    )
    return (
        branches.select(
            "repository_identity", named, "entries", "bytes", "largest", "depth"
        )
        .groupBy("repository_identity")
        .agg(digest("entry").alias("tree_sha256"), *totals)
        .withColumn(
            "within_limits",
            (F.col("entries") <= fixed.MAXIMUM_TREE_ENTRIES)
            & (F.col("bytes") <= fixed.MAXIMUM_TREE_BYTES)
            & (F.col("depth") <= fixed.MAXIMUM_TREE_DEPTH),
        )
    )
