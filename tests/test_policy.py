"""Policies as tables: one scenario per rule, in order."""

import pytest
from pyspark.sql import functions as F

from alertweave.operators.policy import resource_outcome, security_outcome

SECURITY = dict(
    has_considered=True, has_unknowns=False, has_unresolved=False, high_tp=False, high_fp=False,
    decisive_rebuttal=False, tp_supported=False,
)
RESOURCE = dict(
    context_incomplete=False, conflicting=False, has_unknowns=False, has_unresolved=False,
    unknown_assessment=False, acquired=True, exit_confirmed=True, ownership_or_release=False,
    tp_claims=True, fp_basis=False, fp_claim=False, release_confirmed=False,
)


def decide(spark, outcome, requested, base, changes):
    facts = {name: F.lit(value) for name, value in {**base, **changes}.items()}
    facts["requested_label"] = F.lit(requested)
    row = spark.range(1).select(outcome(facts).alias("o")).first().o
    assert row.policy_flags[0] == "auto_dismiss_disabled"
    return row.label, row.policy_flags[1:]


@pytest.mark.parametrize(
    "requested, changes, label, flag",
    [
        ("NMC", {}, "NMC", "judge_requested_nmc"),
        ("TP", {"has_considered": False}, "NMC", "critical_evidence_missing"),
        ("TP", {"has_unknowns": True, "tp_supported": True}, "NMC", "unknown_or_unresolved"),
        ("FP", {"has_unresolved": True, "decisive_rebuttal": True}, "NMC", "unknown_or_unresolved"),
        ("TP", {"high_tp": True, "high_fp": True}, "NMC", "conflicting_high_strength_evidence"),
        ("TP", {"high_fp": True, "tp_supported": True}, "NMC", "high_strength_fp_blocks_tp"),
        ("FP", {"high_fp": True, "decisive_rebuttal": True}, "FP", "judge_label_accepted"),
        ("FP", {"high_fp": True}, "NMC", "fp_missing_decisive_rebuttal"),
        ("TP", {"tp_supported": True}, "TP", "judge_label_accepted"),
        ("TP", {}, "NMC", "tp_support_missing"),
    ],
)
def test_security(spark, requested, changes, label, flag):
    got, flags = decide(spark, security_outcome, requested, SECURITY, changes)
    assert (got, flags[-1]) == (label, flag)


@pytest.mark.parametrize(
    "requested, changes, label, flags",
    [
        ("NMC", {}, "NMC", ["judge_requested_nmc"]),
        ("TP", {"context_incomplete": True, "conflicting": True}, "NMC", ["resource_context_incomplete"]),
        ("TP", {"conflicting": True}, "NMC", ["resource_evidence_conflict"]),
        ("TP", {"unknown_assessment": True}, "NMC", ["unknown_or_unresolved"]),
        ("TP", {"acquired": False}, "NMC", ["resource_acquisition_missing"]),
        ("TP", {"exit_confirmed": False}, "NMC", ["resource_unreleased_exit_missing"]),
        ("TP", {"ownership_or_release": True}, "NMC", ["resource_evidence_conflict"]),
        ("TP", {"tp_claims": False}, "NMC", ["tp_support_missing"]),
        ("TP", {}, "TP", ["resource_tp_basis_confirmed", "judge_label_accepted"]),
        ("FP", {"fp_basis": True, "fp_claim": True, "release_confirmed": True}, "FP",
         ["resource_release_coverage_confirmed", "judge_label_accepted"]),
        ("FP", {"fp_basis": True, "fp_claim": True}, "FP", ["resource_ownership_confirmed", "judge_label_accepted"]),
        ("FP", {"fp_basis": True}, "NMC", ["resource_fp_basis_missing"]),
    ],
)
def test_resource(spark, requested, changes, label, flags):
    assert decide(spark, resource_outcome, requested, RESOURCE, changes) == (label, flags)
