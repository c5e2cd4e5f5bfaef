"""Facts from tables agree with the facts the run takes from one alert's row."""

import random

import pytest
from pyspark.sql import functions as F

from alertweave import fixed_values as fixed
from alertweave.operators import policy
from alertweave.operators.policy_facts import policy_facts

KINDS = [*fixed.TP_CLAIM_TO_EVIDENCE, "exploit_succeeds", *fixed.RESOURCE_TP_CLAIMS, *fixed.RESOURCE_FP_CLAIMS, None]
TYPES = [*fixed.TP_CLAIM_TO_EVIDENCE.values(), "verification", "context_gap", None]
SECURITY = ["has_unresolved", "has_considered", "high_tp", "high_fp", "decisive_rebuttal", "tp_supported"]


def tables(spark, alerts):
    rng = random.Random(7)
    judged, claims, evidence = [], [], []
    for alert in range(alerts):
        full = alert % 2
        for at in range(rng.choice([0, 3, 8])):
            ids = [f"e{rng.randrange(9)}" for _ in range(rng.randrange(6 if full else 4))]
            status = "supported" if full else rng.choice(["supported", "rebutted", "unresolved", None])
            claims.append((alert, f"c{at}", KINDS[at % 3] if full else rng.choice(KINDS), status, rng.choice(["analyst"] * (9 if full else 2) + ["rebuttal"]), ids))
        for at in range(rng.choice([0, 4, 8])):
            evidence.append((alert, f"e{at}", TYPES[at % 3] if full else rng.choice(TYPES), rng.choice(["supports_tp"] * (9 if full else 2) + ["supports_fp", "neutral"]), rng.choice(["weak", "medium", "high", "decisive"])))
        judged.append((alert, [f"c{k}" for k in range(9) if rng.random() < 0.8], [f"e{k}" for k in range(9) if rng.random() < 0.1]))
    # rows that belong to no alert, and a repeated one
    claims += [(None, "c1", KINDS[0], "supported", "analyst", ["e1"]), *claims[:1]]
    evidence += [(-1, "e1", TYPES[0], "supports_tp", "decisive"), *evidence[:1]]
    return (
        spark.createDataFrame(judged, "alert long, critical_claim_ids array<string>, critical_evidence_ids array<string>"),
        spark.createDataFrame(claims, "alert long, claim_id string, kind string, status string, produced_by string, evidence_ids array<string>"),
        spark.createDataFrame(evidence, "alert long, evidence_id string, type string, polarity string, strength string"),
    )


def test_tables_and_rows_agree(spark):
    judged, claims, evidence = tables(spark, 300)
    got = policy_facts(judged, claims, evidence, ["alert"])
    assert got.count() == 300
    packed = lambda rows, name: rows.groupBy("alert").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "alert"])).alias(name))
    rows = (
        judged.join(packed(claims, "claims"), "alert", "left")
        .join(packed(evidence, "evidence"), "alert", "left")
        .withColumns({"claims": F.coalesce("claims", F.array()), "evidence": F.coalesce("evidence", F.array())})
    )
    critical = policy.critical_claims(F.col("claims"), F.col("critical_claim_ids"))
    judge = {"label": F.lit("TP"), "critical_evidence_ids": F.col("critical_evidence_ids")}
    facts = policy.security_facts(judge, critical, F.col("evidence"), F.array())
    wanted = rows.select(
        "alert",
        *[F.coalesce(facts[name], F.lit(False)).alias(name) for name in SECURITY],
        policy.has_claim_kinds(critical, fixed.RESOURCE_TP_CLAIMS, ["supported"]).alias("tp_claims"),
        F.coalesce(policy.has_any_claim_kind(critical, fixed.RESOURCE_FP_CLAIMS, ["supported", "rebutted"]), F.lit(False)).alias("fp_claim"),
        F.coalesce(F.exists("evidence", lambda item: item["type"] == "context_gap"), F.lit(False)).alias("context_gap"),
    )
    found = {row["alert"]: row.asDict() for row in got.select(*wanted.columns).collect()}
    assert found == {row["alert"]: row.asDict() for row in wanted.collect()}
    for name in [*SECURITY, "tp_claims", "fp_claim", "context_gap"]:
        assert {row[name] for row in found.values()} == {True, False}, name


@pytest.mark.parametrize("keep", ["judged", "nothing"])
def test_empty_tables(spark, keep):
    judged, claims, evidence = tables(spark, 4)
    judged = judged if keep == "judged" else judged.limit(0)
    got = policy_facts(judged, claims.limit(0), evidence.limit(0), ["alert"]).collect()
    assert len(got) == (4 if keep == "judged" else 0)
    assert not any(row[name] for row in got for name in SECURITY)
