"""Recorded reviewer outputs to decisions: requests, lookups, strict checks, claims, policy.

Reviewer calls are a table keyed by request hash. One row per alert carries its evidence
facts through three roles; each role adds two equal-key lookups (first call and repair).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave import fixed_values as fixed
from alertweave import schemas
from alertweave.functions.expressions import (
    all_reasons,
    canonical_json,
    content_id,
    is_unique,
    let,
    record,
    redact_value,
    sha256,
    stable_unique,
    struct_of,
)
from alertweave.functions.strict import parse_type, strict_struct
from alertweave.operators.normalize import query_family, resource_kind
from alertweave.operators.policy import POLICIES
from alertweave.session import OCCURRENCE

_REPAIR = (
    "\nSchema repair attempt: the previous object was invalid. Return a fresh object "
    "conforming exactly to the response schema and evidence boundary."
)
_SHA_ID = {"evidence": r"^ev_[0-9a-f]{64}$", "claim": r"^cl_[0-9a-f]{64}$"}
_ASSESSMENTS = ["release_coverage", "ownership_transfer", "resource_escape", "callee_release_behavior", "lifecycle_contract"]


@dataclass(frozen=True)
class Profile:
    """Model identity that takes part in every request hash."""

    id: str
    model_id: str
    provider: str = "replay"
    data_policy: str = "offline_only"
    maximum_output_tokens: int = 8192
    temperature: float = 0.0

    def column(self) -> Column:
        return struct_of(
            data_policy=F.lit(self.data_policy),
            id=F.lit(self.id),
            maximum_output_tokens=F.lit(self.maximum_output_tokens),
            model_id=F.lit(self.model_id),
            provider=F.lit(self.provider),
            schema_version=F.lit("1.0"),
            temperature=F.lit(self.temperature),
        )


@dataclass(frozen=True)
class Settings:
    profile: Profile
    prompts: dict[str, str] = field(
        default_factory=lambda: {role: f"{role} instructions" for role in fixed.ROLES}
    )
    maximum_request_bytes: int = fixed.MAXIMUM_REQUEST_BYTES
    maximum_calls: int = fixed.MAXIMUM_CALLS_PER_ALERT


def _strings() -> Column:
    return F.array().cast("array<string>")


# --- requests -----------------------------------------------------------------------------------------


def gather_evidence(alert_rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per alert: its evidence sorted by id. An alert without evidence is an error, not NMC."""
    names = [
        "alert_fingerprint", "artifact_sha256", "evidence_id", "excerpt", "extractor",
        "location", "origin", "path_fingerprint", "polarity", "source_anchor", "strength",
        "summary", "type",
    ]
    reference = struct_of(**{name: F.col(name) for name in OCCURRENCE})
    item = struct_of(raw_result_reference=reference, **{name: F.col(name) for name in names})
    keys = [*OCCURRENCE, "alert_fingerprint"]
    per_alert = evidence.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.struct("evidence_id", item.alias("item"))),
        ).alias("pairs")
    )
    return alert_rows.join(
        per_alert.select(*keys, F.transform("pairs", lambda p: p["item"]).alias("evidence_items")),
        keys,
        "left",
    )


def redacted(frame: DataFrame, name: str) -> Column:
    """The column with every string inside it redacted."""
    return redact_value(F.col(name), frame.schema[name].dataType)


def request_sha256(role: str, settings: Settings, schema: str, prompt: str, payload: Column) -> Column:
    return sha256(
        canonical_json(
            struct_of(
                agent_role=F.lit(role),
                profile=settings.profile.column(),
                response_schema=F.lit(schema),
                system_prompt=F.lit(prompt),
                user_payload=payload,
            )
        )
    )


def role_payload(kind: str, role: str) -> dict[str, Column]:
    """Fields of one request, from the columns the earlier roles have added."""
    payload = {
        "target": struct_of(
            alert_fingerprint=F.col("alert_fingerprint"),
            raw_result_reference=struct_of(**{name: F.col(name) for name in OCCURRENCE}),
        ),
        "untrusted_code_data": struct_of(evidence_items=F.col("evidence_redacted")),
    }
    if kind == "resource":
        payload["resource_kind"] = F.col("resource_kind")
        if role != "analyst":
            payload["analyst_output"] = F.col("analyst_redacted")
        if role == "judge":
            payload["rebuttal_output"] = F.col("rebuttal_redacted")
    if role == "rebuttal":
        payload["analyst_claims"] = F.col("analyst_claims_redacted")
    if role == "judge":
        payload["candidate_claims"] = F.concat(
            "analyst_claims_redacted", "rebuttal_claims_redacted"
        )
    return payload


# --- strict role outputs ----------------------------------------------------------------------------------


def _bad_text(text: Column, maximum: int) -> Column:
    return F.coalesce(~F.length(text).between(1, maximum), F.lit(True))


def _bad_texts(items: Column, maximum: int = 64) -> Column:
    return (
        (F.size(items) > maximum)
        | ~is_unique(items)
        | F.exists(items, lambda text: _bad_text(text, 10_000))
    )


def _bad_ids(ids: Column, kind: str, maximum: int | None = None, minimum: int = 0) -> Column:
    bad = ~is_unique(ids) | F.exists(ids, lambda item: ~item.rlike(_SHA_ID[kind]) | item.isNull())
    bad = bad | (F.size(ids) < minimum)
    return bad if maximum is None else bad | (F.size(ids) > maximum)


def _bad_claims(claims: Column, kind: str) -> Column:
    allowed = fixed.SECURITY_CLAIM_KINDS if kind == "security" else fixed.RESOURCE_CLAIM_KINDS
    needs = 1 if kind == "resource" else 0

    def bad(claim: Column) -> Column:
        ids = F.coalesce(claim["evidence_ids"], _strings())
        return (
            F.coalesce(~claim["kind"].isin(allowed), F.lit(True))
            | F.coalesce(~claim["status"].isin(fixed.CLAIM_STATUSES), F.lit(True))
            | _bad_text(claim["statement"], 20_000)
            | _bad_ids(ids, "evidence", minimum=needs)
            | ((claim["status"] != "unresolved") & (F.size(ids) == 0))
        )

    return claims.isNull() | (F.size(claims) > 64) | F.exists(claims, bad)


def _bad_assessment(item: Column) -> Column:
    return F.coalesce(
        ~item["status"].isin(fixed.ASSESSMENT_STATUSES)
        | _bad_text(item["detail"], 10_000)
        | _bad_ids(item["evidence_ids"], "evidence", minimum=1),
        F.lit(True),
    )


def _bad_gaps(gaps: Column) -> Column:
    return (F.size(gaps) > 64) | F.exists(
        gaps,
        lambda gap: F.coalesce(
            ~gap["kind"].isin(fixed.CONTEXT_GAP_KINDS)
            | _bad_text(gap["detail"], 10_000)
            | _bad_ids(gap["evidence_ids"], "evidence", minimum=1),
            F.lit(True),
        ),
    )


def shape_issues(output: Column, kind: str, role: str) -> list[tuple[Column, str]]:
    """What a typed role output breaks on its own, before any reference is followed."""
    checks = [
        (output["schema_version"] != "1.0", "schema_version"),
        (_bad_texts(output["unknowns"]), "unknowns"),
    ]
    if role != "judge":
        checks.append((_bad_claims(output["claims"], kind), "claims"))
    if role == "rebuttal":
        checks.append((_bad_ids(output["rebutted_claim_ids"], "claim", 64), "rebutted_claim_ids"))
    if role == "judge":
        checks += [
            (F.coalesce(~output["label"].isin(fixed.LABELS), F.lit(True)), "label"),
            (F.coalesce(~output["raw_confidence"].between(0, 1), F.lit(True)), "raw_confidence"),
            (_bad_ids(output["critical_claim_ids"], "claim", 128), "critical_claim_ids"),
            (_bad_ids(output["critical_evidence_ids"], "evidence", 128), "critical_evidence_ids"),
            (_bad_text(output["reasoning_summary"], 20_000), "reasoning_summary"),
            (_bad_texts(output["next_actions"]), "next_actions"),
            (_bad_texts(output["fix_guidance"]), "fix_guidance"),
        ]
    if kind == "resource":
        kinds = list(fixed.RESOURCE_KINDS.values())
        checks.append((F.coalesce(~output["resource_kind"].isin(kinds), F.lit(True)), "resource_kind"))
        if role != "judge":
            checks += [(_bad_assessment(output[name]), name) for name in _ASSESSMENTS]
            checks.append((_bad_gaps(output["context_gaps"]), "context_gaps"))
        if role == "analyst":
            exits = output["feasible_unreleased_exit"]
            checks += [
                (
                    F.coalesce(~output["acquisition_succeeds"].isin("yes", "no", "unknown"), F.lit(True)),
                    "acquisition_succeeds",
                ),
                (_bad_text(output["acquisition_condition"], 10_000), "acquisition_condition"),
                (
                    F.coalesce(_bad_ids(output["acquisition_evidence_ids"], "evidence", minimum=1), F.lit(True)),
                    "acquisition_evidence_ids",
                ),
                (
                    _bad_assessment(exits)
                    | F.coalesce(~exits["exit_kind"].isin(fixed.EXIT_KINDS), F.lit(False))
                    | ((exits["status"] == "confirmed") & exits["exit_kind"].isNull()),
                    "feasible_unreleased_exit",
                ),
                (
                    (F.size(output["release_sites"]) > 64)
                    | F.exists(
                        output["release_sites"],
                        lambda site: _bad_text(site["resource_identity"], 10_000)
                        | _bad_text(site["operation"], 10_000)
                        | _bad_text(site["condition"], 10_000)
                        | F.coalesce(_bad_ids(site["evidence_ids"], "evidence", minimum=1), F.lit(True)),
                    ),
                    "release_sites",
                ),
            ]
    return checks


def cited_evidence(output: Column, kind: str, role: str) -> Column:
    """Every evidence id a role output names, at any depth."""
    if role == "judge":
        return output["critical_evidence_ids"]
    parts = [F.flatten(F.transform(output["claims"], lambda claim: claim["evidence_ids"]))]
    if kind == "resource":
        parts += [output[name]["evidence_ids"] for name in _ASSESSMENTS]
        parts.append(F.flatten(F.transform(output["context_gaps"], lambda gap: gap["evidence_ids"])))
        if role == "analyst":
            parts += [
                output["acquisition_evidence_ids"],
                output["feasible_unreleased_exit"]["evidence_ids"],
                F.flatten(F.transform(output["release_sites"], lambda site: site["evidence_ids"])),
            ]
    return F.array_distinct(F.concat(*parts))


def is_subset(items: Column, known: Column) -> Column:
    return F.size(F.array_except(items, known)) == 0


def materialize_claims(claims: Column, role: str) -> Column:
    """Drafts with their content-derived ids; alphabetical, as they enter later requests."""

    def one(claim: Column) -> Column:
        content = {
            "evidence_ids": F.coalesce(claim["evidence_ids"], _strings()),
            "kind": claim["kind"],
            "produced_by": F.lit(role),
            "schema_version": F.lit("1.0"),
            "statement": claim["statement"],
            "status": claim["status"],
        }
        return struct_of(claim_id=content_id("cl_", struct_of(**content)), **content)

    return F.transform(claims, one)


def reference_issues(output: Column, kind: str, role: str) -> list[tuple[Column, str]]:
    """What a well-formed output breaks against its own alert's evidence and trace."""
    checks = [
        (
            ~is_subset(cited_evidence(output, kind, role), F.col("evidence_ids")),
            "cites evidence outside the exact alert occurrence",
        )
    ]
    if role == "analyst":
        checks.append(
            (
                F.exists(output["claims"], lambda claim: claim["status"] == "rebutted"),
                "analyst cannot author rebutted claims",
            )
        )
    if role != "judge":
        ids = F.transform(materialize_claims(output["claims"], role), lambda claim: claim["claim_id"])
        checks.append((~is_unique(ids), "duplicate claims"))
    if role == "rebuttal":
        known = F.transform("analyst_claims", lambda claim: claim["claim_id"])
        checks.append((~is_subset(output["rebutted_claim_ids"], known), "cites an unknown analyst claim"))
    if role == "judge":
        known = F.transform(F.concat("analyst_claims", "rebuttal_claims"), lambda c: c["claim_id"])
        checks.append((~is_subset(output["critical_claim_ids"], known), "cites an unknown candidate claim"))
    if kind == "resource":
        checks.append((output["resource_kind"] != F.col("resource_kind"), "wrong resource kind"))
    return checks


def _with_defaults(value: Column, ddl: str) -> Column:
    """Absent top-level lists become empty and an absent version becomes 1.0."""
    fields = {}
    for entry in parse_type(ddl).fields:
        item = value[entry.name]
        if entry.name == "schema_version":
            item = F.coalesce(item, F.lit("1.0"))
        elif entry.dataType.typeName() == "array" and entry.name != "claims":
            item = F.coalesce(item, F.array())
        fields[entry.name] = item
    return F.when(value.isNotNull(), struct_of(**fields))


def check_response(raw: Column, kind: str, role: str) -> Column:
    """``STRUCT<output, issues>``; no issues means the response may be used."""
    ddl = schemas.ROLE_OUTPUTS[(kind, role)]

    def judged(output: Column) -> Column:
        shape = all_reasons(*shape_issues(output, kind, role))
        return let(
            F.when(output.isNull(), F.array(F.lit("not a strict object of the response schema")))
            .otherwise(shape),
            lambda issues: record(
                output=output,
                issues=F.when(F.size(issues) > 0, issues).otherwise(
                    all_reasons(*reference_issues(output, kind, role))
                ),
            ),
        )

    return let(let(strict_struct(raw, ddl), lambda value: _with_defaults(value, ddl)), judged)


# --- roles -----------------------------------------------------------------------------------------------


def run_role(frame: DataFrame, role: str, kind: str, settings: Settings, responses: DataFrame) -> DataFrame:
    """Adds the accepted output of one role, its claims, its calls and any failure.

    The first call counts if it is valid; otherwise one repair. A missing recording fails the
    alert: it is never guessed and never becomes NMC.
    """
    payload = role_payload(kind, role)
    schema = f"{kind}-{role}"
    prompt = settings.prompts[role]
    repair_prompt = prompt + _REPAIR
    lookup = responses.select("request_sha256", "raw_json", "response_sha256")

    def recorded(rows: DataFrame, attempt: int) -> DataFrame:
        names = {
            "request_sha256": f"sha{attempt}", "raw_json": f"raw{attempt}",
            "response_sha256": f"response{attempt}",
        }
        # a call that is not made looks for its own occurrence, which no recording has: as nulls,
        # nearly all repairs would meet in one task
        sought = F.coalesce(F.col(f"sha{attempt}"), F.concat_ws("/", *OCCURRENCE))
        return (
            rows.withColumn("_sought", sought)
            .join(lookup.withColumnsRenamed(names | {"request_sha256": "_sought"}), "_sought", "left")
            .drop("_sought")
        )

    first = recorded(
        frame.withColumn(
            "sha0", request_sha256(role, settings, schema, prompt, struct_of(**payload))
        ).withColumn(
            "request_bytes",
            F.octet_length(canonical_json(struct_of(**payload))) + F.octet_length(F.lit(prompt)),
        ),
        0,
    ).withColumn("check0", F.when(F.col("raw0").isNotNull(), check_response(F.col("raw0"), kind, role)))
    repair = {"attempt": F.lit(1), "previous_error_code": F.lit(fixed.RESPONSE_INVALID)}
    if kind == "resource":
        repair["previous_issues"] = F.col("check0.issues")
    needs_repair = F.size("check0.issues") > 0
    second = recorded(
        first.withColumn(
            "sha1",
            F.when(
                needs_repair,
                request_sha256(
                    role, settings, schema, repair_prompt,
                    struct_of(**payload, schema_repair=struct_of(**repair)),
                ),
            ),
        ),
        1,
    ).withColumn("check1", F.when(F.col("raw1").isNotNull(), check_response(F.col("raw1"), kind, role)))
    accepted0 = F.size("check0.issues") == 0
    accepted1 = F.size("check1.issues") == 0
    missed = F.col("check0").isNull() | (needs_repair & F.col("check1").isNull())
    failure = (
        F.when(F.col("failure").isNotNull(), F.col("failure"))
        .when(F.col("request_bytes") > settings.maximum_request_bytes, fixed.MODEL_FAILED)
        .when(missed, fixed.REPLAY_MISS)
        .when(~accepted0 & ~F.coalesce(accepted1, F.lit(False)), fixed.RESPONSE_INVALID)
    )

    def call(attempt: int, accepted: Column, check: str) -> Column:
        text = prompt if attempt == 0 else repair_prompt
        return F.when(
            F.col(f"sha{attempt}").isNotNull() & F.col(check).isNotNull(),
            record(
                agent_role=F.lit(role),
                attempt=F.lit(attempt),
                request_sha256=F.col(f"sha{attempt}"),
                prompt_sha256=sha256(F.lit(text)),
                response_sha256=F.when(
                    F.col(f"{check}.output").isNotNull(),
                    sha256(canonical_json(F.col(f"{check}.output"))),
                ).otherwise(F.col(f"response{attempt}")),
                response_schema=F.lit(schema),
                profile_id=F.lit(settings.profile.id),
                model_id=F.lit(settings.profile.model_id),
                status=F.when(accepted, "accepted").otherwise("invalid"),
                error_code=F.when(~accepted, F.lit(fixed.RESPONSE_INVALID)),
            ),
        )

    absent = F.when(
        F.col("failure").isNull() & missed,
        record(
            agent_role=F.lit(role),
            request_sha256=F.when(needs_repair, F.col("sha1")).otherwise(F.col("sha0")),
        ),
    )
    done = (
        second.withColumn("missing_request", F.coalesce("missing_request", absent))
        .withColumn("failure", failure)
        .withColumn(
            role,
            F.when(accepted0, F.col("check0.output")).when(accepted1, F.col("check1.output")),
        )
        .withColumn(
            "invocations",
            F.concat(
                "invocations",
                F.array_compact(F.array(call(0, accepted0, "check0"), call(1, accepted1, "check1"))),
            ),
        )
        .drop("sha0", "sha1", "raw0", "raw1", "response0", "response1", "check0", "check1", "request_bytes")
    )
    if role != "judge":
        done = done.withColumn(
            f"{role}_claims", materialize_claims(F.col(f"{role}.claims"), role)
        )
        done = done.withColumn(f"{role}_claims_redacted", redacted(done, f"{role}_claims"))
        done = done.withColumn(f"{role}_redacted", redacted(done, role))
    return done


_CALLS = (
    "array<struct<agent_role:string,attempt:int,request_sha256:string,prompt_sha256:string,"
    "response_sha256:string,response_schema:string,profile_id:string,model_id:string,"
    "status:string,error_code:string>>"
)


def triage_family(targets: DataFrame, kind: str, settings: Settings, responses: DataFrame) -> DataFrame:
    """One query family through its three roles and its policy.

    ``targets``: occurrence, ``alert_fingerprint``, ``family`` and ``evidence_items``.
    """
    frame = (
        targets.withColumn("evidence_redacted", redacted(targets, "evidence_items"))
        .withColumn("resource_kind", resource_kind(F.col("family")))
        .withColumn("evidence_ids", F.transform("evidence_items", lambda item: item["evidence_id"]))
        .withColumn(
            "failure",
            F.when(F.coalesce(F.size("evidence_items"), F.lit(0)) < 1, fixed.POLICY_REJECTED),
        )
        .withColumn("invocations", F.array().cast(_CALLS))
        .withColumn(
            "missing_request",
            F.lit(None).cast("struct<agent_role:string,request_sha256:string>"),
        )
    )
    for role in fixed.ROLES:
        frame = run_role(frame, role, kind, settings, responses)
    over = F.size("invocations") > settings.maximum_calls
    frame = frame.withColumn("failure", F.coalesce("failure", F.when(over, fixed.MODEL_FAILED)))
    row = {
        "analyst": F.col("analyst"),
        "rebuttal": F.col("rebuttal"),
        "judge": F.col("judge"),
        "claims": F.concat("analyst_claims", "rebuttal_claims"),
        "evidence": F.col("evidence_items"),
        "unknowns": F.col("unknowns"),
    }
    judge = F.col("judge")
    return (
        frame.withColumn(
            "unknowns",
            stable_unique(
                F.col("analyst.unknowns"), F.col("rebuttal.unknowns"), F.col("judge.unknowns")
            ),
        )
        .withColumn("outcome", POLICIES[kind](row))
        .select(
            *OCCURRENCE,
            "alert_fingerprint",
            "family",
            "failure",
            "missing_request",
            "invocations",
            F.to_json("analyst").alias("analyst_json"),
            F.to_json("rebuttal").alias("rebuttal_json"),
            F.to_json("judge").alias("judge_json"),
            "analyst_claims",
            "rebuttal_claims",
            F.col("rebuttal.rebutted_claim_ids").alias("rebutted_claim_ids"),
            F.col("analyst.unknowns").alias("analyst_unknowns"),
            F.col("rebuttal.unknowns").alias("rebuttal_unknowns"),
            F.col("judge.unknowns").alias("judge_unknowns"),
            F.when(
                F.col("failure").isNull(),
                record(
                    label=F.col("outcome.label"),
                    requested_label=judge["label"],
                    raw_confidence=judge["raw_confidence"],
                    calibrated_probabilities=F.lit(None).cast("string"),
                    critical_claim_ids=judge["critical_claim_ids"],
                    critical_evidence_ids=judge["critical_evidence_ids"],
                    unknowns=F.col("unknowns"),
                    reasoning_summary=judge["reasoning_summary"],
                    next_actions=judge["next_actions"],
                    fix_guidance=judge["fix_guidance"],
                    policy_flags=F.col("outcome.policy_flags"),
                    auto_dismiss=F.lit(False),
                ),
            ).alias("decision"),
        )
    )


def triage(alert_rows: DataFrame, evidence: DataFrame, responses: DataFrame, settings: Settings) -> DataFrame:
    """All alerts, each through the workflow of its family. Adds the verdict on its document.

    ``document_failure`` is null when every alert of the document was decided.
    """
    targets = gather_evidence(
        alert_rows.select(
            *OCCURRENCE,
            "alert_fingerprint",
            query_family(F.col("rule.rule_id")).alias("family"),
        ),
        evidence,
    )
    default = F.col("family") == fixed.DEFAULT_FAMILY
    both = triage_family(targets.where(default), "security", settings, responses).unionByName(
        triage_family(targets.where(~default), "resource", settings, responses)
    )
    by_document = Window.partitionBy("raw_sarif_sha256")
    return both.withColumn(
        "document_failure",
        F.min(
            F.when(F.col("failure").isNotNull(), F.struct("run_index", "result_index", "failure"))
        ).over(by_document),
    )


def decisions(triaged: DataFrame) -> DataFrame:
    """Final decisions of documents that were decided as a whole."""
    return triaged.where("document_failure is null").select(
        *OCCURRENCE, "alert_fingerprint", "family", "decision.*"
    )


def triage_rejects(triaged: DataFrame) -> DataFrame:
    return triaged.where(
        "document_failure.run_index = run_index and document_failure.result_index = result_index"
    ).select(
        *OCCURRENCE,
        F.lit("triage").alias("stage"),
        F.col("document_failure.failure").alias("error_code"),
        F.lit("reviewer output is missing or invalid").alias("detail"),
    )


def claims_table(triaged: DataFrame) -> DataFrame:
    both = F.concat("analyst_claims", "rebuttal_claims")
    return triaged.where("document_failure is null").select(
        *OCCURRENCE, F.posexplode(both).alias("claim_ord", "claim")
    ).select(*OCCURRENCE, "claim_ord", "claim.*")


def invocations_table(triaged: DataFrame) -> DataFrame:
    return triaged.select(
        *OCCURRENCE, F.posexplode("invocations").alias("call_ord", "call")
    ).select(*OCCURRENCE, "call_ord", "call.*")


def role_order_faults(invocations: DataFrame) -> DataFrame:
    """Alerts whose accepted calls are not exactly analyst, rebuttal, judge, or number 3 to 6.

    Order is checked with minima and maxima per role, so nothing is collected.
    """
    return role_order_check(invocations, OCCURRENCE)


def role_order_check(invocations: DataFrame, keys: list[str]) -> DataFrame:
    accepted = F.col("status") == "accepted"

    def position(role: str) -> Column:
        return F.when(accepted & (F.col("agent_role") == role), F.col("call_ord"))

    facts = invocations.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.count_if(accepted).alias("accepted"),
        *[F.count(position(role)).alias(f"{role}_count") for role in fixed.ROLES],
        *[F.max(position(role)).alias(f"{role}_at") for role in fixed.ROLES],
    )
    in_order = (
        (F.col("accepted") == 3)
        & (F.col("analyst_count") == 1)
        & (F.col("rebuttal_count") == 1)
        & (F.col("judge_count") == 1)
        & (F.col("analyst_at") < F.col("rebuttal_at"))
        & (F.col("rebuttal_at") < F.col("judge_at"))
    )
    bounded = F.col("calls").between(fixed.MINIMUM_CALLS_PER_ALERT, fixed.MAXIMUM_CALLS_PER_ALERT)
    return facts.where(~F.coalesce(in_order, F.lit(False)) | ~bounded).select(*keys, "calls")


def first_valid_attempts(attempts: DataFrame, keys: list[str], order: str, valid: str) -> DataFrame:
    """Earliest valid attempt per key with how many were made; combines before it shuffles."""
    others = [name for name in attempts.columns if name not in (*keys, order, valid)]
    return (
        attempts.groupBy(*keys)
        .agg(
            F.count("*").alias("attempts"),
            F.min(F.when(F.col(valid), F.struct(order, *others))).alias("first"),
        )
        .select(*keys, "attempts", "first.*")
    )


def invocation_counts(invocations: DataFrame) -> DataFrame:
    return invocations.groupBy("agent_role", "status").count()


def responses_found(requests: DataFrame, responses: DataFrame) -> DataFrame:
    return requests.join(responses, "request_sha256")


def responses_missing(requests: DataFrame, responses: DataFrame) -> DataFrame:
    return requests.join(responses, "request_sha256", "left_anti")


def profile_faults(projects: DataFrame, profile: Profile) -> DataFrame:
    """Projects whose profile or data policy does not match the trusted runtime profile."""
    detail = F.when(
        F.col("llm_profile") != profile.id, "profile does not match the runtime profile"
    ).when(
        F.col("source_upload_policy") != profile.data_policy,
        "source-upload policy does not match the profile",
    )
    return projects.select(
        "project_id",
        F.lit("profile").alias("stage"),
        F.lit(fixed.POLICY_REJECTED).alias("error_code"),
        detail.alias("detail"),
    ).where("detail is not null")
