"""Strict readers of everything that is not SARIF or source: one table each, plus rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave import fixed_values as fixed
from alertweave import schemas
from alertweave.functions.expressions import all_reasons, is_unique, strip
from alertweave.functions.strict import strict_struct
from alertweave.sources.documents import decode_utf8, is_strict_json


def _whole_files(spark: SparkSession, location: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(location)
    )


# --- supplements --------------------------------------------------------------------------------


def read_supplements(
    spark: SparkSession, location: str, pattern: str = "*.json", maximum_bytes: int | None = None
) -> DataFrame:
    """One row per supplement file: hash, typed fields and ``issues`` (empty when accepted). A file
    over a given bound is an issue as well, and so a reject."""
    return check_supplements(
        _whole_files(spark, location, pattern).select(
            "path",
            F.sha2("content", 256).alias("supplement_sha256"),
            decode_utf8(F.col("content")).alias("text"),
            F.col("length").alias("size_bytes"),
        ),
        maximum_bytes,
    )


def check_supplements(texts: DataFrame, maximum_bytes: int | None = None) -> DataFrame:
    parsed = texts.withColumn("value", strict_struct(F.col("text"), f"struct<{_ddl(schemas.SUPPLEMENT)}>"))
    entries = F.col("value.entries")

    def trimmed(text: Column) -> Column:
        return (strip(text) == text) & ~text.rlike(r"[\x00-\x08\x0b-\x1f]")

    issues = all_reasons(
        *([] if maximum_bytes is None else [(F.col("size_bytes") > maximum_bytes, "supplement exceeds the size bound")]),
        (F.col("value").isNull(), "not a strict supplement object"),
        (~F.col("value.kind").isin(list(fixed.SUPPLEMENT_ORIGINS)), "unknown kind"),
        (~F.col("value.project_id").rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$"), "invalid project id"),
        (~F.col("value.repository_identity").rlike(fixed.SHA256_PATTERN), "invalid repository"),
        (~F.col("value.raw_sarif_sha256").rlike(fixed.SHA256_PATTERN), "invalid document hash"),
        (~F.length("value.producer").between(1, 200), "invalid producer"),
        (~F.length("value.purpose").between(1, 1000), "invalid purpose"),
        (~trimmed(F.col("value.producer")) | ~trimmed(F.col("value.purpose")), "untrimmed text"),
        (F.coalesce(F.size(entries), F.lit(0)) < 1, "no entries"),
        (~is_unique(entries), "duplicate entries"),
        (
            F.exists(
                entries,
                lambda e: (e["run_index"] < 0)
                | (e["result_index"] < 0)
                | ~e["type"].isin(fixed.EVIDENCE_TYPES)
                | ~e["polarity"].isin(fixed.POLARITIES)
                | ~e["strength"].isin(fixed.STRENGTHS)
                | ~F.length(e["summary"]).between(1, 10_000)
                | ~trimmed(e["summary"])
                | e["summary"].isNull()
                | ((e["polarity"] == "neutral") & (e["strength"] == "decisive")),
            ),
            "invalid entry",
        ),
    )
    return parsed.select("supplement_sha256", "value.*", issues.alias("issues"))


def bind_supplements(supplements: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Supplements whose project, tree and document exist together, and the rest as rejects."""
    keys = ["project_id", "repository_identity", "raw_sarif_sha256"]
    well_formed = supplements.where(F.size("issues") == 0)
    known = documents.select(*keys).distinct()
    bound = well_formed.join(known, keys, "left_semi")
    unbound = well_formed.join(known, keys, "left_anti").withColumn(
        "issues", F.array(F.lit("project, tree or document does not match a run"))
    )
    rejects = supplements.where(F.size("issues") > 0).unionByName(unbound).select(
        "supplement_sha256",
        F.lit("supplement").alias("stage"),
        F.lit(fixed.POLICY_REJECTED).alias("error_code"),
        F.array_join("issues", "; ").alias("detail"),
    )
    return bound, rejects


def _ddl(columns: str) -> str:
    """``name type`` column DDL as struct fields."""
    depth, fields, current = 0, [], ""
    for char in columns:
        depth += char == "<"
        depth -= char == ">"
        if char == "," and depth == 0:
            fields.append(current.strip())
            current = ""
        else:
            current += char
    fields.append(current.strip())
    return ",".join(field.replace(" ", ":", 1) for field in fields)


# --- recorded responses ---------------------------------------------------------------------------


def read_responses(spark: SparkSession, location: str, maximum_bytes: int | None = None) -> DataFrame:
    """``request_sha256, raw_json, response_sha256``; the file name is the request hash.

    Under a bound, a larger response stays as a row whose text is empty, so that its call is an
    invalid response and not a missing one.
    """
    files = _whole_files(spark, location, "*.json")
    whole = F.lit(True) if maximum_bytes is None else F.col("length") <= maximum_bytes
    name = F.regexp_extract("path", r"([0-9a-f]{64})\.json$", 1)
    return files.select(
        name.alias("request_sha256"),
        F.when(whole, decode_utf8(F.col("content"))).otherwise(F.lit("")).alias("raw_json"),
        F.sha2("content", 256).alias("response_sha256"),
    ).where("request_sha256 <> ''")


# --- decisions and baselines -------------------------------------------------------------------------

DECISION_LINE = (
    "struct<alert:struct<primary_location:struct<path:string,start_line:int>,"
    "raw_result_reference:struct<raw_sarif_sha256:string,result_index:int,run_index:int>,"
    "rule:struct<rule_id:string>>,"
    "triage:struct<final_decision:struct<auto_dismiss:boolean,label:string>>>"
)


def read_decisions(spark: SparkSession, location: str) -> DataFrame:
    """Decision rows of report JSONL; ``valid`` is false where a line is not strict JSON or lacks
    its occurrence or label."""
    lines = spark.read.text(location)
    value = F.when(is_strict_json(F.col("value")), F.from_json("value", DECISION_LINE))
    parsed = lines.select(value.alias("row"))
    reference = F.col("row.alert.raw_result_reference")
    return parsed.select(
        reference["raw_sarif_sha256"].alias("raw_sarif_sha256"),
        reference["run_index"].alias("run_index"),
        reference["result_index"].alias("result_index"),
        F.col("row.alert.rule.rule_id").alias("rule_id"),
        F.col("row.alert.primary_location.path").alias("path"),
        F.col("row.alert.primary_location.start_line").alias("start_line"),
        F.col("row.triage.final_decision.label").alias("label"),
        F.coalesce(
            reference["raw_sarif_sha256"].rlike(fixed.SHA256_PATTERN)
            & (reference["run_index"] >= 0)
            & (reference["result_index"] >= 0)
            & F.col("row.triage.final_decision.label").isin(fixed.LABELS),
            F.lit(False),
        ).alias("valid"),
    )


def read_legacy_baseline(spark: SparkSession, location: str) -> DataFrame:
    """Human review rows; ``valid`` is false where a field breaks the nine-field contract."""
    lines = spark.read.text(location)
    parsed = lines.select(
        strict_struct(F.col("value"), f"struct<{_ddl(schemas.BASELINE_ROW)}>").alias("row")
    )
    return parsed.select("row.*", check_baseline_row("row.").alias("valid"))


def check_baseline_row(prefix: str = "") -> Column:
    def col(name: str) -> Column:
        return F.col(prefix + name)

    return F.coalesce(
        col("id").rlike(r"^[A-Z]-[0-9]+$")
        & F.length(col("query")).between(1, 512)
        & F.length(col("file")).between(1, 4096)
        & (col("line") >= 1)
        & F.length(col("method")).between(1, 512)
        & F.length(col("scope")).between(1, 64)
        & col("label").isin(fixed.LABELS)
        & (col("label_basis") == "human_evidence_review")
        & F.length(col("evidence")).between(1, 100_000),
        F.lit(False),
    )


# --- experiment cases, ground truth, checksum lists ------------------------------------------------------


def read_cases(spark: SparkSession, location: str) -> DataFrame:
    """Experiment cases, one strict object per line; ``valid`` is false for any other line."""
    rows = spark.read.text(location).select(
        strict_struct(F.col("value"), f"struct<{_ddl(schemas.EXPERIMENT_CASE)}>").alias("row")
    )
    return rows.select("row.*", F.col("row").isNotNull().alias("valid"))


def read_ground_truth(spark: SparkSession, location: str) -> DataFrame:
    """Ground truth, one strict object per file; ``valid`` is false for any other file."""
    rows = _whole_files(spark, location, "*.json").select(
        strict_struct(
            decode_utf8(F.col("content")), f"struct<{_ddl(schemas.GROUND_TRUTH_CASE)}>"
        ).alias("row")
    )
    return rows.select("row.*", F.col("row").isNotNull().alias("valid"))


def parse_checksums(lines: DataFrame) -> DataFrame:
    """``sha256, name, valid`` from lines of the form ``<sha256>  <name>`` in column ``value``."""
    pattern = r"^([0-9a-f]{64})  (.*)$"
    name = F.regexp_extract("value", pattern, 2)
    return lines.select(
        F.regexp_extract("value", pattern, 1).alias("sha256"),
        name.alias("name"),
        (
            F.col("value").rlike(pattern)
            & (name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") | (name == ".gitignore"))
        ).alias("valid"),
    )


def read_checksums(spark: SparkSession, location: str) -> DataFrame:
    return parse_checksums(spark.read.text(location))


def duplicate_names(checksums: DataFrame) -> DataFrame:
    return checksums.groupBy("name").count().where("count > 1").select("name", "count")
