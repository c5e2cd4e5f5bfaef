"""Whole runs: documents and sources to decisions and reports, one stage table after another.

Stages are written and read back. A written table is both the contract between stages and the
lineage cut: a lost executor repeats its tasks of one stage and never the run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from alertweave import fixed_values as fixed
from alertweave.operators import audit, context, evidence, normalize, report, triage
from alertweave.sinks.tables import read_stage, write_lines, write_stage
from alertweave.sources.documents import document_rejects, gate_documents, repeated_documents, unique_documents


@dataclass(frozen=True)
class Options:
    context_policy: str = "path_function_slice"
    window_radius: int = fixed.WINDOW_RADIUS
    token_budget: int = fixed.MAXIMUM_TOKEN_BUDGET
    callee_bound: int | None = None
    source_root: str | None = None


def stage(spark: SparkSession, rows: DataFrame, folder: str, name: str) -> DataFrame:
    location = f"{folder}/{name}"
    write_stage(rows, location)
    return read_stage(spark, location)


def build_context_tables(
    spark: SparkSession, documents: DataFrame, sources: DataFrame, folder: str, options: Options = Options()
) -> dict[str, DataFrame]:
    """Documents to context and evidence. ``documents`` needs content, hash, repository, commit."""
    gated = gate_documents(unique_documents(documents))
    normalized = stage(
        spark,
        normalize.normalize(gated, sources, options.source_root),
        folder,
        "normalized",
    )
    alert_rows = normalize.alerts(normalized)
    contexts = stage(
        spark,
        context.build_context(
            alert_rows, sources, options.context_policy, options.window_radius, options.token_budget, options.callee_bound
        ),
        folder,
        "context",
    )
    graph = stage(spark, evidence.build_graph(alert_rows, contexts), folder, "graph")
    return {
        "normalized": normalized,
        "alerts": alert_rows,
        "context": contexts,
        "graph": graph,
        "evidence": evidence.evidence_table(graph),
        "edges": evidence.edges_table(graph),
        "artifacts": evidence.artifacts_of_graph(graph),
        "rejects": audit.rejects_with_state(
            repeated_documents(documents), document_rejects(gated), normalize.normalization_rejects(normalized)
        ),
    }


def decide(
    spark: SparkSession, tables: dict[str, DataFrame], responses: DataFrame, settings: triage.Settings, folder: str
) -> dict[str, DataFrame]:
    """Adds decisions, claims and calls to the tables of ``build_context_tables``."""
    triaged = stage(
        spark,
        triage.triage(tables["alerts"], tables["evidence"], responses, settings),
        folder,
        "triaged",
    )
    return {
        **tables,
        "triaged": triaged,
        "decisions": triage.decisions(triaged),
        "claims": triage.claims_table(triaged),
        "invocations": triage.invocations_table(triaged),
        "rejects": tables["rejects"].unionByName(
            audit.rejects_with_state(triage.triage_rejects(triaged))
        ),
    }


def publish(tables: dict[str, DataFrame], runs: DataFrame, folder: str) -> DataFrame:
    """Report rows, as JSON lines and as escaped HTML fragments in occurrence order."""
    reports = report.build_reports(
        tables["alerts"], tables["context"], tables["evidence"], tables["triaged"], runs
    )
    order = ["raw_sarif_sha256", "run_index", "result_index"]
    write_lines(report.report_json(reports), f"{folder}/report/decisions.jsonl", order)
    write_lines(report.alert_html(reports), f"{folder}/report/alerts.html", order)
    return reports
