"""Comparison of committed decisions with a separate human baseline.

Nothing here imports from triage: the baseline is read only against a finished table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave import fixed_values as fixed
from alertweave.session import OCCURRENCE


def duplicate_occurrences(rows: DataFrame, keys: list[str] = OCCURRENCE) -> DataFrame:
    """Keys seen more than once; partial counts keep a hot key from travelling row by row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def evaluation_rows(
    automatic: DataFrame, baseline: DataFrame, keys: list[str] = OCCURRENCE
) -> DataFrame:
    """Full outer alignment on the exact occurrence; agreement is null when a side is absent."""
    left = automatic.select(*keys, F.col("label").alias("automatic_label"))
    right = baseline.select(*keys, F.col("label").alias("baseline_label"))
    return left.join(right, keys, "full_outer").withColumn(
        "agreement", F.col("automatic_label") == F.col("baseline_label")
    )


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """Zero-filled three by three counts over aligned rows: ``baseline_label, TP, FP, NMC``.

    One pass computes all nine counts, so the matrix needs no pivot and no second scan.
    """
    cells = [
        F.count_if(
            (F.col("baseline_label") == expected) & (F.col("automatic_label") == actual)
        ).alias(f"{expected}_{actual}")
        for expected in fixed.LABELS
        for actual in fixed.LABELS
    ]
    counted = rows.where("agreement is not null").agg(*cells)
    lines = [
        F.struct(
            F.lit(expected).alias("baseline_label"),
            *[F.col(f"{expected}_{actual}").alias(actual) for actual in fixed.LABELS],
        )
        for expected in fixed.LABELS
    ]
    return counted.select(F.inline(F.array(*lines)))


def class_metrics(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 where a denominator is empty."""
    sums = [
        F.sum(F.when(F.col("baseline_label") == label, F.col(label))).alias(f"hit_{label}")
        for label in fixed.LABELS
    ]
    predicted = [F.sum(label).alias(f"predicted_{label}") for label in fixed.LABELS]
    actual = [
        F.sum(
            F.when(
                F.col("baseline_label") == label,
                reduce(Column.__add__, [F.col(name) for name in fixed.LABELS]),
            )
        ).alias(f"actual_{label}")
        for label in fixed.LABELS
    ]
    lines = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.col(f"hit_{label}").alias("hit"),
                F.col(f"predicted_{label}").alias("predicted"),
                F.col(f"actual_{label}").alias("support"),
            )
            for label in fixed.LABELS
        ]
    )
    table = confusion.agg(*sums, *predicted, *actual).select(F.inline(lines))
    precision = ratio(F.col("hit"), F.col("predicted"))
    recall = ratio(F.col("hit"), F.col("support"))
    return table.select(
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
        "support",
    )


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """Rates over the aligned cohort; baseline counts cover every baseline row."""
    aligned = F.col("agreement").isNotNull()

    def counts(column: str, scope: Column, prefix: str) -> list[Column]:
        return [
            F.count_if(scope & (F.col(column) == label)).alias(f"{prefix}_{label}")
            for label in fixed.LABELS
        ]

    totals = rows.agg(
        F.count_if(aligned).alias("aligned_count"),
        F.count_if(F.col("automatic_label").isNull()).alias("missing_automatic"),
        F.count_if(F.col("baseline_label").isNull()).alias("missing_baseline"),
        F.count_if(F.col("agreement")).alias("agreed"),
        *counts("automatic_label", aligned, "automatic"),
        *counts("baseline_label", F.lit(True), "baseline"),
    )
    total = F.col("aligned_count")
    return totals.select(
        "aligned_count",
        "missing_automatic",
        "missing_baseline",
        *[f"automatic_{label}" for label in fixed.LABELS],
        *[f"baseline_{label}" for label in fixed.LABELS],
        ratio(F.col("agreed"), total).alias("agreement"),
        ratio(F.col("automatic_TP") + F.col("automatic_FP"), total).alias("determined_rate"),
        ratio(F.col("automatic_NMC"), total).alias("nmc_rate"),
    )


def bind_legacy_baseline(
    rows: DataFrame, bindings: DataFrame, decision_rows: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Legacy ids to occurrences: prefix names the document, suffix the result.

    ``bindings``: ``id_prefix, raw_sarif_sha256, rule_id``, one row per experiment case and so
    small. Query, file and line only cross-check; they never choose a label. The second frame
    holds the rows that do not bind, with the reason.
    """
    bound = (
        rows.withColumn("id_prefix", F.split_part("id", F.lit("-"), F.lit(1)))
        .withColumn("result_index", F.split_part("id", F.lit("-"), F.lit(2)).cast("int"))
        .withColumn("run_index", F.lit(0))
        .join(bindings.withColumnRenamed("rule_id", "bound_rule"), "id_prefix", "left")
        .join(
            decision_rows.select(
                *OCCURRENCE,
                F.col("rule_id").alias("decided_rule"),
                F.col("path").alias("decided_path"),
                F.col("start_line").alias("decided_line"),
            ),
            OCCURRENCE,
            "left",
        )
    )
    reason = (
        F.when(F.col("raw_sarif_sha256").isNull(), "no exact binding for the prefix")
        .when(F.col("decided_rule").isNull(), "no finalized decision")
        .when(
            (F.col("decided_rule") != F.col("bound_rule"))
            | (F.col("query") != F.col("bound_rule"))
            | (F.col("file") != F.col("decided_path"))
            | (F.col("line") != F.col("decided_line")),
            "cross-check disagrees with the bound occurrence",
        )
    )
    checked = bound.withColumn("reason", reason)
    return (
        checked.where("reason is null").select(*OCCURRENCE, "label"),
        checked.where("reason is not null").select("id", "reason"),
    )
