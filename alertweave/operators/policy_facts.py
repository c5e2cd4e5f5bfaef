"""Policy facts from tables of claims and evidence, one row per alert.

A claim that the judge relies on wants certain evidence, and a piece of evidence can give certain
proofs; both are bits of one mask. The wants of all claims that cite a piece are or-ed, and what it
also gives is proven. Masks of an alert are or-ed as well, and "all kinds are there" is a comparison
with a full mask. The or combines before each shuffle, and joins are on the alert and a claim or an
evidence id, so an alert with very many claims is spread and never gathered.

Nulls in ids meet nothing, null kinds, statuses, types and strengths suit nothing, repeated rows
change nothing, and an alert without claims or evidence has every fact false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave import fixed_values as fixed

_ENOUGH = ("medium", "high", "decisive")
_STRONG = ("high", "decisive")
_NAMES = (
    "has_unresolved", "has_considered", "high_tp", "high_fp", "decisive_rebuttal", "verified",
    *fixed.TP_CLAIM_TO_EVIDENCE, *fixed.RESOURCE_TP_CLAIMS, "fp_claim", "context_gap",
)
_BIT = {name: 1 << at for at, name in enumerate(_NAMES)}


def _mask(**suits: Column) -> Column:
    """The bits whose condition holds; an unknown condition does not."""
    bits = [F.when(holds, F.lit(_BIT[name])).otherwise(0) for name, holds in suits.items()]
    return reduce(lambda left, right: left.bitwiseOR(right), bits).cast("long")


def _all_of(mask: Column, names: list[str]) -> Column:
    full = sum(_BIT[name] for name in names)
    return mask.bitwiseAND(F.lit(full)) == full


def _claim_proves() -> Column:
    """What a critical claim shows by itself."""
    evidenced = F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0
    supported = F.col("status") == "supported"
    return _mask(
        has_unresolved=F.col("status") == "unresolved",
        fp_claim=F.col("kind").isin(fixed.RESOURCE_FP_CLAIMS) & F.col("status").isin("supported", "rebutted") & evidenced,
        **{kind: (F.col("kind") == kind) & supported & evidenced for kind in fixed.RESOURCE_TP_CLAIMS},
    )


def _claim_wants() -> Column:
    """What a critical claim would prove with evidence that suits."""
    backed = (F.col("produced_by") == "analyst") & (F.col("status") == "supported")
    return _mask(
        decisive_rebuttal=(F.col("produced_by") == "rebuttal") & (F.col("status") == "rebutted"),
        verified=backed & (F.col("kind") == "exploit_succeeds"),
        **{kind: backed & (F.col("kind") == kind) for kind in fixed.TP_CLAIM_TO_EVIDENCE},
    )


def _evidence_gives() -> Column:
    """What a piece of evidence can prove if a claim wants it."""
    for_tp, for_fp = F.col("polarity") == "supports_tp", F.col("polarity") == "supports_fp"
    decisive = F.col("strength") == "decisive"
    return _mask(
        decisive_rebuttal=for_fp & decisive,
        verified=for_tp & decisive & (F.col("type") == "verification"),
        **{
            kind: for_tp & F.col("strength").isin(*_ENOUGH) & (F.col("type") == wanted)
            for kind, wanted in fixed.TP_CLAIM_TO_EVIDENCE.items()
        },
    )


def _evidence_shows() -> Column:
    """What a considered piece of evidence shows whoever cites it."""
    strong = F.col("strength").isin(*_STRONG)
    return _mask(
        has_considered=F.lit(True),
        high_tp=(F.col("polarity") == "supports_tp") & strong,
        high_fp=(F.col("polarity") == "supports_fp") & strong,
    )


def policy_facts(judged: DataFrame, claims: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """``judged`` with ``has_unresolved, has_considered, high_tp, high_fp, decisive_rebuttal,
    tp_supported, tp_claims, fp_claim, context_gap`` for each of its rows.

    ``judged``: keys, ``critical_claim_ids``, ``critical_evidence_ids``, one row per alert. ``claims``: keys, ``claim_id,
    kind, status, produced_by, evidence_ids``. ``evidence``: keys, ``evidence_id, type, polarity, strength``.
    """
    named = judged.select(*keys, F.explode("critical_claim_ids").alias("claim_id")).distinct()
    critical = claims.select(*keys, "claim_id", "kind", "status", "produced_by", "evidence_ids").join(
        named, [*keys, "claim_id"]
    )
    by_claims = critical.select(*keys, _claim_proves().alias("mask"))
    cited = (
        critical.select(*keys, F.explode("evidence_ids").alias("evidence_id"), _claim_wants().alias("wants"))
        .unionByName(
            judged.select(
                *keys, F.explode("critical_evidence_ids").alias("evidence_id"), F.lit(0).cast("long").alias("wants")
            )
        )
        .groupBy(*keys, "evidence_id")
        .agg(F.bit_or("wants").alias("wants"))
    )
    facts_of = evidence.select(
        *keys,
        "evidence_id",
        _evidence_gives().alias("gives"),
        _evidence_shows().alias("shows"),
        _mask(context_gap=F.col("type") == "context_gap").alias("gap"),
    )
    by_evidence = facts_of.join(cited, [*keys, "evidence_id"], "left").select(
        *keys,
        F.when(F.col("wants").isNotNull(), F.col("gives").bitwiseAND(F.col("wants")).bitwiseOR(F.col("shows")))
        .otherwise(0)
        .bitwiseOR(F.col("gap"))
        .alias("mask"),
    )
    masks = by_claims.unionByName(by_evidence).groupBy(*keys).agg(F.bit_or("mask").alias("_mask"))
    mask = F.coalesce("_mask", F.lit(0).cast("long"))
    single = ("has_unresolved", "has_considered", "high_tp", "high_fp", "decisive_rebuttal", "fp_claim", "context_gap")
    return (
        judged.join(masks, keys, "left")
        .withColumns(
            {
                **{name: _all_of(mask, [name]) for name in single},
                "tp_supported": _all_of(mask, ["verified"]) | _all_of(mask, list(fixed.TP_CLAIM_TO_EVIDENCE)),
                "tp_claims": _all_of(mask, fixed.RESOURCE_TP_CLAIMS),
            }
        )
        .drop("_mask")
    )
