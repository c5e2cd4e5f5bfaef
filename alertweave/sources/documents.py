"""Raw SARIF documents: scan, exact-byte digest, one row per document, strict JSON gate.

No size or count is bounded unless a bound is passed; the published ones are in ``fixed_values``.
What a bound leaves out, and every further copy of a document, has a reject row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave import fixed_values as fixed
from alertweave import schemas
from alertweave.functions.expressions import first_reason, keep_rows


def scan_documents(
    spark: SparkSession, location: str, pattern: str = "*.sarif", maximum_bytes: int | None = None
) -> DataFrame:
    """All files below a folder: ``path, length, content, raw_sarif_sha256``.

    A size bound filters on ``length``, which the file source pushes down, so oversized files are
    never read; ``oversized_documents`` with the same bound lists them.
    """
    files = _files(spark, location, pattern)
    if maximum_bytes is not None:
        files = files.where(F.col("length") <= maximum_bytes)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("raw_sarif_sha256"))


def oversized_documents(
    spark: SparkSession, location: str, pattern: str = "*.sarif", maximum_bytes: int = fixed.MAXIMUM_DOCUMENT_BYTES
) -> DataFrame:
    """A reject row for each file that a scan with this bound leaves out."""
    return (
        _files(spark, location, pattern)
        .where(F.col("length") > maximum_bytes)
        .select(
            "path",
            "length",
            F.lit("ingest").alias("stage"),
            F.lit(fixed.INVALID_SARIF).alias("error_code"),
            F.lit("document exceeds the size bound").alias("detail"),
        )
    )


def _files(spark: SparkSession, location: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(location)
    )


def decode_utf8(content: Column) -> Column:
    """Text of valid UTF-8 bytes without a leading mark, else null."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), r"^\uFEFF", "")


def is_strict_json(text: Column) -> Column:
    """One JSON value, no duplicate keys, no NaN or Infinity, nothing after the root.

    Variant parsing refuses duplicates and non-finite numbers but ignores trailing text, so
    the text is parsed inside an array that must then hold exactly one element.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce(
        F.size(F.try_variant_get(wrapped, "$", "array<variant>")) == 1, F.lit(False)
    )


_COPY = ["repository_identity", "commit_sha"]


def unique_documents(documents: DataFrame) -> DataFrame:
    """One row per document hash: the copy with the first repository and commit.

    Occurrences are keyed by that hash, so a batch holds each document once. Copies have reject
    rows (``repeated_documents``) and can be run for their own repository in another batch.
    """
    return (
        documents.groupBy("raw_sarif_sha256")
        .agg(F.min_by(F.struct(*documents.columns), F.struct(*_COPY)).alias("document"))
        .select("document.*")
    )


def repeated_documents(documents: DataFrame) -> DataFrame:
    """A reject row for each copy that ``unique_documents`` leaves out."""
    per_place = documents.groupBy("raw_sarif_sha256", *_COPY).agg(F.count(F.lit(1)).alias("copies"))
    kept = per_place.groupBy("raw_sarif_sha256").agg(F.min(F.struct(*_COPY)).alias("kept"))
    left_out = F.col("copies") - F.struct(*_COPY).eqNullSafe(F.col("kept")).cast("int")
    return (
        per_place.join(kept, "raw_sarif_sha256")
        .where(left_out > 0)
        .select(
            "raw_sarif_sha256",
            F.lit(None).cast("int").alias("run_index"),
            F.lit(None).cast("int").alias("result_index"),
            F.lit("ingest").alias("stage"),
            F.lit(fixed.INVALID_SARIF).alias("error_code"),
            F.concat(F.lit("repeated document of "), F.coalesce("repository_identity", F.lit("no repository"))).alias("detail"),
            F.explode(F.sequence(F.lit(1).cast("long"), left_out)).alias("copy"),
        )
        .drop("copy")
    )


def gate_documents(
    documents: DataFrame, maximum_results: int | None = None, maximum_path_steps: int | None = None
) -> DataFrame:
    """Adds ``sarif`` (typed tree) and ``reason`` (null when accepted); other columns stay.

    Counts for the optional bounds are taken here, before anything is exploded.
    """
    parsed = (
        documents.withColumn("text", decode_utf8(F.col("content")))
        .withColumn("strict", is_strict_json(F.col("text")))
        .withColumn(
            "sarif",
            F.when(
                F.col("strict"),
                F.from_json(
                    "text", schemas.SARIF, {"columnNameOfCorruptRecord": "_corrupt"}
                ),
            ),
        )
    )
    runs = F.col("sarif.runs")
    results = F.aggregate(
        runs,
        F.lit(0),
        lambda total, run: total + F.coalesce(F.size(run["results"]), F.lit(0)),
    )
    steps = F.aggregate(
        runs,
        F.lit(0),
        lambda total, run: total
        + F.aggregate(
            F.coalesce(run["results"], F.array()),
            F.lit(0),
            lambda inner, result: inner + _step_count(result),
        ),
    )
    kinds = fixed.COLUMN_KINDS
    reason = first_reason(
        (F.col("text").isNull(), "not valid UTF-8"),
        (~F.col("strict"), "not strict JSON"),
        (F.col("sarif._corrupt").isNotNull(), "unexpected JSON type"),
        (~F.col("sarif.version").eqNullSafe("2.1.0"), "version is not 2.1.0"),
        (runs.isNull(), "runs are missing"),
        (
            F.exists(runs, lambda run: run["tool"]["driver"]["name"].isNull()),
            "tool driver name is missing",
        ),
        (
            F.exists(
                runs,
                lambda run: (F.size(run["results"]) > 0) & run["columnKind"].isNull(),
            ),
            "run with results requires columnKind",
        ),
        (
            F.exists(
                runs, lambda run: run["columnKind"].isNotNull() & ~run["columnKind"].isin(kinds)
            ),
            "unknown columnKind",
        ),
        (
            F.exists(
                runs,
                lambda run: F.exists(
                    F.coalesce(run["tool"]["driver"]["rules"], F.array()),
                    lambda rule: rule["id"].isNull(),
                ),
            ),
            "rule id is missing",
        ),
        (
            F.exists(
                runs,
                lambda run: _ids(run) > F.size(F.array_distinct(_rule_ids(run))),
            ),
            "duplicate rule id",
        ),
        *([] if maximum_results is None else [(results > maximum_results, "too many results")]),
        *([] if maximum_path_steps is None else [(steps > maximum_path_steps, "too many path steps")]),
    )
    return parsed.withColumn("reason", reason).drop("strict", "text")


def _rule_ids(run: Column) -> Column:
    return F.transform(
        F.coalesce(run["tool"]["driver"]["rules"], F.array()), lambda rule: rule["id"]
    )


def _ids(run: Column) -> Column:
    return F.coalesce(F.size(run["tool"]["driver"]["rules"]), F.lit(0))


def _step_count(result: Column) -> Column:
    flows = F.coalesce(result["codeFlows"], F.array())
    return F.aggregate(
        flows,
        F.lit(0),
        lambda total, flow: total
        + F.aggregate(
            F.coalesce(flow["threadFlows"], F.array()),
            F.lit(0),
            lambda inner, thread: inner + F.coalesce(F.size(thread["locations"]), F.lit(0)),
        ),
    )


def document_rejects(gated: DataFrame) -> DataFrame:
    return keep_rows(gated, F.col("reason").isNotNull()).select(
        "raw_sarif_sha256",
        F.lit(None).cast("int").alias("run_index"),
        F.lit(None).cast("int").alias("result_index"),
        F.lit("ingest").alias("stage"),
        F.lit(fixed.INVALID_SARIF).alias("error_code"),
        F.col("reason").alias("detail"),
    )
