"""Batches of cases over many documents: preflight, roll-up, history, ground truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave import fixed_values as fixed
from alertweave.functions.expressions import first_reason
from alertweave.operators.normalize import query_family


def manifest_faults(cases: DataFrame) -> DataFrame:
    """``case_id, detail`` for cases that break a manifest rule, and for repeated ids or prefixes."""
    single = cases.select(
        F.col("id").alias("case_id"),
        first_reason(
            (~F.col("id").rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$"), "invalid case id"),
            (~F.col("source_commit").rlike(fixed.COMMIT_PATTERN), "invalid commit"),
            (~F.col("sarif_sha256").rlike(fixed.SHA256_PATTERN), "invalid document hash"),
            (F.col("expected_result_count") < 0, "invalid result count"),
            (~F.col("mode").isin("triage", "audit_only"), "unknown mode"),
            (
                (F.col("mode") == "triage") & (F.col("expected_query_family") == "mixed_audit"),
                "triage cases require one query family",
            ),
            (
                (F.col("mode") == "audit_only") & (F.col("expected_query_family") != "mixed_audit"),
                "audit-only cases must declare mixed_audit",
            ),
            (
                F.col("baseline_id_prefix").isNotNull()
                & ((F.col("mode") != "triage") | (F.col("expected_result_count") == 0)),
                "baseline prefix on a case without triaged results",
            ),
            (
                F.col("baseline_id_prefix").isNotNull()
                & ~F.col("baseline_id_prefix").rlike("^[A-Z]$"),
                "invalid baseline prefix",
            ),
        ).alias("detail"),
    ).where("detail is not null")

    def repeated(column: str, text: str) -> DataFrame:
        return (
            cases.where(F.col(column).isNotNull())
            .groupBy(column)
            .agg(F.count("*").alias("n"), F.min("id").alias("case_id"))
            .where("n > 1")
            .select("case_id", F.lit(text).alias("detail"))
        )

    return reduce(
        DataFrame.unionByName,
        [
            single,
            repeated("id", "case id is not unique"),
            repeated("baseline_id_prefix", "baseline prefix is not unique"),
        ],
    )


def rule_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    """Results per rule; ``results`` has ``keys`` and ``rule_id``."""
    return results.groupBy(*keys, "rule_id").agg(F.count("*").alias("result_count"))


def preflight(cases: DataFrame, results: DataFrame, documents: DataFrame) -> DataFrame:
    """Per case: observed counts and the first thing that does not match its declaration.

    ``results``: ``raw_sarif_sha256, rule_id`` per result; ``documents``: known hashes. Counts
    are combined per document before they meet the cases.
    """
    per_document = rule_counts(results, ["raw_sarif_sha256"]).groupBy("raw_sarif_sha256").agg(
        F.sum("result_count").alias("result_count"),
        F.collect_set(query_family(F.col("rule_id"))).alias("families"),
        F.count("*").alias("rules"),
    )
    known = documents.select(F.col("raw_sarif_sha256")).distinct().withColumn("known", F.lit(True))
    joined = (
        cases.withColumnRenamed("sarif_sha256", "raw_sarif_sha256")
        .join(known, "raw_sarif_sha256", "left")
        .join(per_document, "raw_sarif_sha256", "left")
        .withColumn("result_count", F.coalesce("result_count", F.lit(0)))
        .withColumn("families", F.coalesce("families", F.array().cast("array<string>")))
    )
    unexpected = F.exists("families", lambda family: family != F.col("expected_query_family"))
    return joined.select(
        F.col("id").alias("case_id"),
        "raw_sarif_sha256",
        "mode",
        "result_count",
        first_reason(
            (F.col("known").isNull(), "document hash does not match the manifest"),
            (
                F.col("result_count") != F.col("expected_result_count"),
                "result count does not match the manifest",
            ),
            ((F.col("mode") == "triage") & unexpected, "unexpected query family"),
        ).alias("reason"),
    )


def call_forecast(checked: DataFrame) -> DataFrame:
    """Triage alerts and the least and most reviewer calls they can take."""
    alerts = F.coalesce(
        F.sum(F.when(F.col("mode") == "triage", F.col("result_count")).otherwise(0)), F.lit(0)
    )
    return checked.agg(alerts.alias("triage_alert_count")).select(
        "triage_alert_count",
        (F.col("triage_alert_count") * fixed.MINIMUM_CALLS_PER_ALERT).alias("minimum_model_calls"),
        (F.col("triage_alert_count") * fixed.MAXIMUM_CALLS_PER_ALERT).alias("maximum_model_calls"),
    )


def label_counts(decision_rows: DataFrame, keys: list[str]) -> DataFrame:
    return decision_rows.groupBy(*keys).agg(
        F.count("*").alias("alert_count"),
        *[F.count_if(F.col("label") == label).alias(f"{label.lower()}_count") for label in fixed.LABELS],
    )


def case_results(
    checked: DataFrame,
    decision_rows: DataFrame,
    rejects: DataFrame,
    invocations: DataFrame | None = None,
    dry_run: bool = False,
) -> DataFrame:
    """One outcome per case. A failed case stays failed and adds no labels.

    A triage case without results completes with zero alerts; audit-only cases are skipped.
    """
    document = "raw_sarif_sha256"
    counts = label_counts(decision_rows, [document])
    failed = rejects.groupBy(document).agg(F.min("error_code").alias("error_code"))
    frame = checked.join(counts, document, "left").join(failed, document, "left")
    if invocations is not None:
        frame = frame.join(
            invocations.groupBy(document).agg(F.count("*").alias("calls")), document, "left"
        )
    else:
        frame = frame.withColumn("calls", F.lit(None).cast("bigint"))
    undecided = F.coalesce("alert_count", F.lit(0)) != F.col("result_count")
    status = (
        F.when(F.lit(dry_run), "preflight_only")
        .when(F.col("mode") == "audit_only", "audit_only")
        .when(F.col("reason").isNotNull() | F.col("error_code").isNotNull() | undecided, "failed")
        .otherwise("completed")
    )
    done = F.col("status") == "completed"

    def if_done(name: str) -> Column:
        return F.when(done, F.coalesce(name, F.lit(0))).otherwise(0).alias(name)

    return frame.withColumn("status", status).select(
        "case_id",
        "status",
        document,
        F.col("result_count").alias("alert_count"),
        if_done("tp_count"),
        if_done("fp_count"),
        if_done("nmc_count"),
        F.when(done, F.coalesce("calls", F.lit(0))).otherwise(0).alias("invocation_count"),
        F.when(
            F.col("status") == "failed",
            F.coalesce(
                "error_code", F.when(F.col("reason").isNotNull(), fixed.POLICY_REJECTED),
                F.lit(fixed.MODEL_FAILED),
            ),
        ).alias("error_code"),
        F.when(F.col("status") == "preflight_only", "dry_run_no_model_calls").alias("skip_reason"),
    )


def experiment_summary(results: DataFrame, checked: DataFrame) -> DataFrame:
    """One row: batch status, decided of total, labels, calls."""
    rolled = results.agg(
        F.bool_or(F.col("status") == "failed").alias("any_failed"),
        F.bool_or(F.col("status") == "preflight_only").alias("dry"),
        F.coalesce(
            F.sum(F.when(F.col("status") == "completed", F.col("alert_count"))), F.lit(0)
        ).alias("decided_alert_count"),
        *[F.sum(f"{label.lower()}_count").alias(f"{label.lower()}_count") for label in fixed.LABELS],
        F.sum("invocation_count").alias("invocation_count"),
    )
    total = call_forecast(checked).select("triage_alert_count")
    return side_by_side(rolled, total).select(
        F.when(F.col("dry"), "dry_run").when(F.col("any_failed"), "incomplete").otherwise("completed").alias("status"),
        "triage_alert_count",
        "decided_alert_count",
        "tp_count",
        "fp_count",
        "nmc_count",
        "invocation_count",
    )


def aggregate_decisions(decision_rows: DataFrame, results: DataFrame) -> DataFrame:
    """Decisions of completed cases only; successes survive a failed sibling."""
    completed = results.where("status = 'completed'").select("raw_sarif_sha256").distinct()
    return decision_rows.join(completed, "raw_sarif_sha256", "left_semi")


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row aggregates as one row, by an equal key."""
    one = F.lit(1).alias("one")
    return left.select("*", one).join(right.select("*", one), "one").drop("one")


# --- history ------------------------------------------------------------------------------------------


def vanished(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Targets present before and absent after."""
    return before.join(after.select(*keys).distinct(), keys, "left_anti")


def is_target(rule_id: str, path: str, symbol: str) -> Column:
    """An alert of the target rule and file with a slice of the target callable."""
    return (
        (F.col("rule_id") == rule_id)
        & (F.col("path") == path)
        & F.exists("symbols", lambda item: item == symbol)
    )


def before_after(
    reports: DataFrame, documents: dict[str, str], target: dict[str, str], counts: DataFrame
) -> DataFrame:
    """Whether the target was found once before a fix and not at all after it.

    ``reports``: occurrence, ``rule_id, path, symbols, label``; ``documents`` names the hashes
    of ``before, after, full_before, full_after``; ``counts``: results per document.
    """
    hit = is_target(target["rule_id"], target["source_path"], target["enclosing_symbol"])

    def in_document(name: str) -> Column:
        return F.col("raw_sarif_sha256") == documents[name]

    found = reports.where(hit).agg(
        F.count_if(in_document("before")).alias("before_targets"),
        F.count_if(in_document("after")).alias("after_targets"),
        F.min(F.when(in_document("before"), F.col("label"))).alias("before_label"),
    )
    sizes = counts.agg(
        *[
            F.coalesce(F.sum(F.when(in_document(name), F.col("result_count"))), F.lit(0)).alias(
                f"{name}_count"
            )
            for name in ("before", "after", "full_before", "full_after")
        ]
    )
    confirmed = (F.col("before_targets") == 1) & (F.col("after_targets") == 0)
    return side_by_side(found, sizes).select(
        F.when(confirmed, "confirmed").otherwise("rejected").alias("status"), "*"
    )


# --- ground truth ----------------------------------------------------------------------------------------


def ground_truth_verdicts(cases: DataFrame, reports: DataFrame) -> DataFrame:
    """Every case against its report, closed on both sides; ``reason`` is null when it holds.

    ``reports``: ``run_index, result_index, cwe_ids, artifact_sha256, label, auto_dismiss`` and
    the text of the first slice as ``slice_content``.
    """
    expected = cases.select(
        "case_id",
        "matrix_role",
        "schema_version",
        "cwe_id",
        F.col("sarif.run_index").alias("run_index"),
        F.col("sarif.result_index").alias("result_index"),
        F.col("source.sha256").alias("source_sha256"),
        F.col("ground_truth.label").alias("expected_label"),
        F.col("security_expectation.injection_text").alias("injection_text"),
        F.col("security_expectation.expected_effect").alias("security_expectation"),
    )
    joined = expected.join(reports, ["run_index", "result_index"], "full_outer")
    reason = first_reason(
        (F.col("case_id").isNull(), "report without a case"),
        (F.col("label").isNull(), "case without a report"),
        (
            (F.col("schema_version") != "1.0") | (F.col("case_id") != F.col("matrix_role")),
            "case contract mismatch",
        ),
        (~(F.col("cwe_ids") == F.array("cwe_id")), "CWE differs"),
        (~F.col("artifact_sha256").eqNullSafe(F.col("source_sha256")), "source hash differs"),
        (F.col("label") != F.col("expected_label"), "label differs"),
        (F.col("auto_dismiss"), "alert was dismissed"),
        (
            F.col("injection_text").isNotNull()
            & ~F.contains(F.col("slice_content"), F.col("injection_text")),
            "injection text is absent from its slice",
        ),
    )
    return joined.select(
        "case_id", "run_index", "result_index", "cwe_id", "expected_label",
        F.col("label").alias("actual_label"), "security_expectation", reason.alias("reason"),
    )


# --- run summaries ---------------------------------------------------------------------------------------


def context_run_summary(alert_rows: DataFrame, context: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per document: alerts, paths, pathless, complete and partial contexts, evidence."""
    document = "raw_sarif_sha256"
    alerts = alert_rows.groupBy(document).agg(
        F.count("*").alias("alert_count"),
        F.sum(F.size("paths")).alias("path_count"),
        F.count_if(~F.col("has_code_flows")).alias("no_path_alert_count"),
    )
    contexts = context.groupBy(document).agg(
        F.count_if(F.col("completeness") == "complete").alias("complete_context_count"),
        F.count_if(F.col("completeness") == "partial").alias("partial_context_count"),
    )
    items = evidence.groupBy(document).agg(F.count("*").alias("evidence_count"))
    return alerts.join(contexts, document, "left").join(items, document, "left")


def summary_faults(summary: DataFrame) -> DataFrame:
    return summary.where(
        "no_path_alert_count > alert_count "
        "or complete_context_count + partial_context_count <> alert_count"
    )


def triage_run_summary(
    alert_rows: DataFrame, evidence: DataFrame, claims: DataFrame, invocations: DataFrame, decision_rows: DataFrame
) -> DataFrame:
    document = "raw_sarif_sha256"

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(document).agg(F.count("*").alias(name))

    alerts = alert_rows.groupBy(document).agg(
        F.count("*").alias("alert_count"), F.sum(F.size("paths")).alias("path_count")
    )
    labels = label_counts(decision_rows, [document]).drop("alert_count")
    parts = [
        counted(evidence, "evidence_count"), counted(claims, "claim_count"),
        counted(invocations, "invocation_count"), labels,
    ]
    joined = reduce(lambda left, right: left.join(right, document, "left"), parts, alerts)
    return joined.na.fill(0).withColumn(
        "counts_agree",
        F.col("tp_count") + F.col("fp_count") + F.col("nmc_count") == F.col("alert_count"),
    )
