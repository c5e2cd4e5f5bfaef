"""Decision policies: boolean facts in, one ordered chain out. First match wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertweave import fixed_values as fixed
from alertweave.functions.expressions import let, record


def _outcome(label: str, *flags: str) -> Column:
    """Label and flags; every decision states that nothing was dismissed."""
    return record(
        label=F.lit(label),
        policy_flags=F.array(F.lit("auto_dismiss_disabled"), *[F.lit(flag) for flag in flags]),
    )


def security_outcome(facts: dict[str, Column]) -> Column:
    """``STRUCT<label, policy_flags>`` from the facts named below."""
    requested = facts["requested_label"]
    return (
        F.when(requested == "NMC", _outcome("NMC", "judge_requested_nmc"))
        .when(~facts["has_considered"], _outcome("NMC", "critical_evidence_missing"))
        .when(
            facts["has_unknowns"] | facts["has_unresolved"],
            _outcome("NMC", "unknown_or_unresolved"),
        )
        .when(
            facts["high_tp"] & facts["high_fp"],
            _outcome("NMC", "conflicting_high_strength_evidence"),
        )
        .when(
            (requested == "TP") & facts["high_fp"],
            _outcome("NMC", "high_strength_fp_blocks_tp"),
        )
        .when(
            (requested == "FP") & facts["decisive_rebuttal"],
            _outcome("FP", "fp_decisive_rebuttal_present", "judge_label_accepted"),
        )
        .when(requested == "FP", _outcome("NMC", "fp_missing_decisive_rebuttal"))
        .when(facts["tp_supported"], _outcome("TP", "judge_label_accepted"))
        .otherwise(_outcome("NMC", "tp_support_missing"))
    )


def resource_outcome(facts: dict[str, Column]) -> Column:
    requested = facts["requested_label"]
    is_tp, is_fp = requested == "TP", requested == "FP"
    fp_accepted = is_fp & facts["fp_basis"] & facts["fp_claim"]
    return (
        F.when(requested == "NMC", _outcome("NMC", "judge_requested_nmc"))
        .when(facts["context_incomplete"], _outcome("NMC", "resource_context_incomplete"))
        .when(facts["conflicting"], _outcome("NMC", "resource_evidence_conflict"))
        .when(
            facts["has_unknowns"] | facts["has_unresolved"] | facts["unknown_assessment"],
            _outcome("NMC", "unknown_or_unresolved"),
        )
        .when(is_tp & ~facts["acquired"], _outcome("NMC", "resource_acquisition_missing"))
        .when(is_tp & ~facts["exit_confirmed"], _outcome("NMC", "resource_unreleased_exit_missing"))
        .when(is_tp & facts["ownership_or_release"], _outcome("NMC", "resource_evidence_conflict"))
        .when(is_tp & ~facts["tp_claims"], _outcome("NMC", "tp_support_missing"))
        .when(is_tp, _outcome("TP", "resource_tp_basis_confirmed", "judge_label_accepted"))
        .when(
            fp_accepted & facts["release_confirmed"],
            _outcome("FP", "resource_release_coverage_confirmed", "judge_label_accepted"),
        )
        .when(fp_accepted, _outcome("FP", "resource_ownership_confirmed", "judge_label_accepted"))
        .otherwise(_outcome("NMC", "resource_fp_basis_missing"))
    )


# --- facts from one alert's row ---------------------------------------------------------------------


def considered_ids(critical_evidence_ids: Column, critical_claims: Column) -> Column:
    """Evidence the judge cites, directly or through critical claims."""
    return F.array_union(
        critical_evidence_ids,
        F.flatten(F.transform(critical_claims, lambda claim: claim["evidence_ids"])),
    )


def _cited(evidence: Column, ids: Column) -> Column:
    return F.filter(evidence, lambda item: F.array_contains(ids, item["evidence_id"]))


def high_polarity(evidence: Column, polarity: str) -> Column:
    return F.exists(
        evidence,
        lambda item: (item["polarity"] == polarity) & item["strength"].isin("high", "decisive"),
    )


def decisive_rebuttal(critical_claims: Column, evidence: Column) -> Column:
    return F.exists(
        critical_claims,
        lambda claim: (claim["produced_by"] == "rebuttal")
        & (claim["status"] == "rebutted")
        & F.exists(
            _cited(evidence, claim["evidence_ids"]),
            lambda item: (item["polarity"] == "supports_fp") & (item["strength"] == "decisive"),
        ),
    )


def tp_supported(critical_claims: Column, evidence: Column) -> Column:
    """A decisive verification, or all three kinds of support at medium or better."""

    def backed(kind: str, accepts: Callable[[Column], Column]) -> Column:
        return F.exists(
            critical_claims,
            lambda claim: (claim["produced_by"] == "analyst")
            & (claim["status"] == "supported")
            & (claim["kind"] == kind)
            & F.exists(
                _cited(evidence, claim["evidence_ids"]),
                lambda item: (item["polarity"] == "supports_tp") & accepts(item),
            ),
        )

    verified = backed(
        "exploit_succeeds",
        lambda item: (item["type"] == "verification") & (item["strength"] == "decisive"),
    )
    complete = F.lit(True)
    for kind, evidence_type in fixed.TP_CLAIM_TO_EVIDENCE.items():
        complete = complete & backed(
            kind,
            lambda item, wanted=evidence_type: (item["type"] == wanted)
            & item["strength"].isin("medium", "high", "decisive"),
        )
    return verified | complete


def has_claim_kinds(claims: Column, kinds: list[str], statuses: list[str]) -> Column:
    """All of ``kinds`` appear among evidenced claims of the given statuses."""
    found = F.transform(
        F.filter(
            claims,
            lambda claim: claim["status"].isin(statuses) & (F.size(claim["evidence_ids"]) > 0),
        ),
        lambda claim: claim["kind"],
    )
    wanted = F.array(*[F.lit(kind) for kind in kinds])
    return F.size(F.array_except(wanted, found)) == 0


def has_any_claim_kind(claims: Column, kinds: list[str], statuses: list[str]) -> Column:
    return F.exists(
        claims,
        lambda claim: claim["kind"].isin(kinds)
        & claim["status"].isin(statuses)
        & (F.size(claim["evidence_ids"]) > 0),
    )


def any_status(assessments: list[Column], status: str) -> Column:
    return F.exists(F.array(*[item["status"] for item in assessments]), lambda s: s == status)


def _common_facts(critical: Column, unknowns: Column, judge: Column) -> dict[str, Column]:
    return {
        "requested_label": judge["label"],
        "has_unknowns": F.size(unknowns) > 0,
        "has_unresolved": F.exists(critical, lambda claim: claim["status"] == "unresolved"),
    }


def security_facts(judge: Column, critical: Column, evidence: Column, unknowns: Column) -> dict[str, Column]:
    considered = _cited(evidence, considered_ids(judge["critical_evidence_ids"], critical))
    return {
        **_common_facts(critical, unknowns, judge),
        "has_considered": F.size(considered) > 0,
        "high_tp": high_polarity(considered, "supports_tp"),
        "high_fp": high_polarity(considered, "supports_fp"),
        "decisive_rebuttal": decisive_rebuttal(critical, evidence),
        "tp_supported": tp_supported(critical, evidence),
    }


_SHARED = ["release_coverage", "ownership_transfer", "resource_escape", "callee_release_behavior", "lifecycle_contract"]
_POSITIVE = ["release_coverage", "ownership_transfer", "callee_release_behavior", "lifecycle_contract"]


def resource_facts(
    analyst: Column, rebuttal: Column, judge: Column, critical: Column, evidence: Column, unknowns: Column
) -> dict[str, Column]:
    both = [analyst[name] for name in [*_SHARED, "feasible_unreleased_exit"]] + [
        rebuttal[name] for name in _SHARED
    ]
    basis = [rebuttal[name] for name in _POSITIVE]
    gaps = (F.size(analyst["context_gaps"]) > 0) | (F.size(rebuttal["context_gaps"]) > 0)
    return {
        **_common_facts(critical, unknowns, judge),
        "context_incomplete": gaps | F.exists(evidence, lambda item: item["type"] == "context_gap"),
        "conflicting": any_status(both, "conflicting"),
        "unknown_assessment": any_status(both, "unknown"),
        "acquired": analyst["acquisition_succeeds"] == "yes",
        "exit_confirmed": analyst["feasible_unreleased_exit"]["status"] == "confirmed",
        "ownership_or_release": any_status(
            [analyst[name] for name in _POSITIVE] + basis, "confirmed"
        ),
        "tp_claims": has_claim_kinds(critical, fixed.RESOURCE_TP_CLAIMS, ["supported"]),
        "fp_basis": any_status(basis, "confirmed"),
        "fp_claim": has_any_claim_kind(
            critical, fixed.RESOURCE_FP_CLAIMS, ["supported", "rebutted"]
        ),
        "release_confirmed": rebuttal["release_coverage"]["status"] == "confirmed",
    }


def critical_claims(claims: Column, critical_claim_ids: Column) -> Column:
    return F.filter(claims, lambda claim: F.array_contains(critical_claim_ids, claim["claim_id"]))


def decide_security(row: dict[str, Column]) -> Column:
    return let(
        critical_claims(row["claims"], row["judge"]["critical_claim_ids"]),
        lambda critical: security_outcome(
            security_facts(row["judge"], critical, row["evidence"], row["unknowns"])
        ),
    )


def decide_resource(row: dict[str, Column]) -> Column:
    return let(
        critical_claims(row["claims"], row["judge"]["critical_claim_ids"]),
        lambda critical: resource_outcome(
            resource_facts(
                row["analyst"], row["rebuttal"], row["judge"], critical, row["evidence"],
                row["unknowns"],
            )
        ),
    )


# A policy reads one row of role outputs, claims, evidence facts and unknowns.
POLICIES: dict[str, Callable[[dict[str, Column]], Column]] = {
    "security": decide_security,
    "resource": decide_resource,
}
