"""Results of gated documents as alerts keyed by their exact occurrence.

Everything one result needs from its run (rules, artifacts, URI bases) is looked up in the
run's row, before its results become rows of their own: a result then carries its own rule and
artifacts and not those of its siblings, so the work grows with the document and normalization
itself never shuffles. Only observed file hashes are joined in, and only the document-level
verdict groups by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave import fixed_values as fixed
from alertweave.functions.expressions import (
    canonical_json,
    domain_sha256,
    first_reason,
    has_control,
    is_safe_relative_path,
    let,
    record,
    sha256,
    sorted_map,
    struct_of,
)
from alertweave.functions.uri import canonicalize_uri, join_uri, relative_path
from alertweave.operators.uri_bases import look_up_base, resolve_declared
from alertweave.session import OCCURRENCE

_NO_STRINGS = "array<string>"
_INVALID, _UNSAFE = fixed.INVALID_SARIF, fixed.UNSAFE_URI


def message_text(message: Column) -> Column:
    return F.coalesce(message["text"], message["markdown"])


def normalize_commit(commit: Column) -> Column:
    return F.lower(commit)


def query_family(rule_id: Column) -> Column:
    """Exact rule id to query family; four entries, so a literal map and no join."""
    families = F.create_map(
        *[F.lit(item) for pair in fixed.QUERY_FAMILIES.items() for item in pair]
    )
    return F.coalesce(families[rule_id], F.lit(fixed.DEFAULT_FAMILY))


def resource_kind(family: Column) -> Column:
    kinds = F.create_map(
        *[F.lit(item) for pair in fixed.RESOURCE_KINDS.items() for item in pair]
    )
    return kinds[family]


def family_rule_id(family: Column) -> Column:
    rules = F.create_map(
        *[F.lit(item) for rule, name in fixed.QUERY_FAMILIES.items() for item in (name, rule)]
    )
    return rules[family]


def analysis_id(raw_sarif_sha256: Column, repository: Column, commit: Column) -> Column:
    """Identity of an analysis, the same for every run over the same inputs."""
    return F.concat(
        F.lit("analysis-"),
        sha256(
            canonical_json(
                struct_of(
                    commit_sha=commit,
                    normalizer_version=F.lit(fixed.NORMALIZER_VERSION),
                    raw_sarif_sha256=raw_sarif_sha256,
                    repository_identity=repository,
                )
            )
        ),
    )


def explode_results(gated: DataFrame) -> DataFrame:
    """One row per result of every accepted document, with what it names in its run; equal results
    stay separate rows. Adds ``picked`` (rule) and ``located_lists`` (see ``locate_all``)."""
    # Outer explodes: the others add a size filter on their input, which is pushed down to
    # the scan and parses every document once more.
    runs = (
        gated.select(
            "raw_sarif_sha256",
            "repository_identity",
            "commit_sha",
            F.posexplode_outer(F.when(F.col("reason").isNull(), F.col("sarif.runs"))).alias(
                "run_index", "run"
            ),
        )
        .where("run_index is not null")
    )
    # Run-level values are made below the second explode. Made beside it, the optimizer would
    # fold them into the per-location lambdas and walk the base chains once per location.
    rules = F.coalesce("run.tool.driver.rules", F.array())
    prepared = runs.select(
        "raw_sarif_sha256",
        "repository_identity",
        "commit_sha",
        "run_index",
        F.col("run.columnKind").alias("column_kind"),
        rules.alias("rules"),
        order_by_id(rules).alias("rule_order"),
        F.transform(F.coalesce("run.artifacts", F.array()), named_artifact).alias("artifacts"),
        resolve_declared(F.col("run.originalUriBaseIds")).alias("bases"),
        F.col("run.results").alias("results"),
    )
    found = F.transform(
        "results",
        lambda result: record(
            result=result,
            picked=resolve_rule(result, F.col("rules"), F.col("rule_order")),
            located_lists=locate_all(result, F.col("artifacts"), F.col("bases")),
        ),
    )
    run_level = ("rules", "rule_order", "artifacts", "bases", "results")
    return prepared.select(
        *[name for name in prepared.columns if name not in run_level],
        F.posexplode_outer(found).alias("result_index", "found"),
    ).where("result_index is not null").select("*", "found.*").drop("found")


# --- rules ----------------------------------------------------------------------------------


def order_by_id(rules: Column) -> Column:
    """``ARRAY<STRUCT<id, at>>``: ids in order with their positions, made once per run."""
    return F.array_sort(F.transform(rules, lambda rule, at: record(id=rule["id"], at=at)))


def position_of(wanted: Column, order: Column) -> Column:
    """Position of the first rule with this id, else null; halves the ordered ids at each step."""

    def halve(span: Column, _: Column) -> Column:
        middle = F.shiftright(span["low"] + span["high"], 1)
        below = F.get(order, middle)["id"] < wanted
        return F.when(span["low"] >= span["high"], span).otherwise(
            record(
                low=F.when(below, middle + 1).otherwise(span["low"]),
                high=F.when(below, span["high"]).otherwise(middle),
            )
        )

    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size(order))))
    return let(
        F.aggregate(halvings, record(low=F.lit(0), high=F.size(order)), halve),
        lambda span: let(
            F.get(order, span["low"]), lambda entry: F.when(entry["id"] == wanted, entry["at"])
        ),
    )


def resolve_rule(result: Column, rules: Column, order: Column) -> Column:
    """``STRUCT<reason, rule_id, rule>`` from the rule id, the rule index or both; ``order`` comes
    from ``order_by_id``."""
    indexed = F.get(rules, result["ruleIndex"])
    named = F.get(rules, position_of(result["ruleId"], order))

    def pick(pair: Column) -> Column:
        by_index, by_name = pair["indexed"], pair["named"]
        reason = first_reason(
            (result["ruleIndex"] < 0, "ruleIndex is negative"),
            (result["ruleIndex"].isNotNull() & by_index.isNull(), "ruleIndex is out of range"),
            (
                result["ruleId"].isNotNull() & (by_index["id"] != result["ruleId"]),
                "ruleId and ruleIndex name different rules",
            ),
            (
                result["ruleId"].isNull() & result["ruleIndex"].isNull(),
                "ruleId or ruleIndex is required",
            ),
        )
        return record(
            reason=reason,
            rule_id=F.coalesce(result["ruleId"], by_index["id"]),
            rule=F.when(result["ruleId"].isNotNull(), by_name).otherwise(by_index),
        )

    return let(record(indexed=indexed, named=named), pick)


def rule_metadata(rule_id: Column, rule: Column, result: Column) -> Column:
    """Alphabetical rule struct; a rule the driver does not declare keeps only its id."""
    properties = rule["properties"]
    tags = F.transform(
        F.filter(
            F.coalesce(
                F.try_variant_get(properties, "$.tags", "array<variant>"),
                F.array().cast("array<variant>"),
            ),
            lambda tag: F.schema_of_variant(tag) == "STRING",
        ),
        lambda tag: F.try_variant_get(tag, "$", "string"),
    )
    raw_security = F.try_variant_get(properties, "$['security-severity']", "variant")
    security_text = F.try_variant_get(raw_security, "$", "string")
    security = F.when(
        (F.schema_of_variant(raw_security) != "BOOLEAN")
        & F.trim(security_text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
        F.trim(security_text).try_cast("double"),
    )
    raw_problem = F.try_variant_get(properties, "$['problem.severity']", "variant")
    problem = F.when(
        F.schema_of_variant(raw_problem) == "STRING",
        F.nullif(F.try_variant_get(raw_problem, "$", "string"), F.lit("")),
    )
    none = F.lit(None).cast("string")
    return let(
        tags,
        lambda names: struct_of(
            cwe_ids=cwe_ids(names),
            description=F.coalesce(
                F.nullif(message_text(rule["fullDescription"]), F.lit("")),
                message_text(rule["shortDescription"]),
            ),
            name=rule["name"],
            query_help_uri=rule["helpUri"],
            query_pack=none,
            query_pack_version=none,
            rule_id=rule_id,
            security_severity=F.when((security >= 0) & (security <= 10), security),
            severity=F.coalesce(result["level"], rule["defaultConfiguration"]["level"], problem),
            tags=F.array_sort(F.array_distinct(names)),
        ),
    )


def cwe_ids(tags: Column) -> Column:
    """CWE ids named by tags, without leading zeros, in numeric order."""
    numbers = F.filter(
        F.transform(
            tags,
            lambda tag: F.regexp_extract(
                F.concat(F.lit("/"), tag, F.lit("/")), fixed.CWE_PATTERN, 1
            ),
        ),
        lambda number: number != "",
    )
    ordered = F.array_sort(
        F.array_distinct(F.transform(numbers, lambda n: record(size=F.length(n), n=n)))
    )
    return F.transform(ordered, lambda item: F.concat(F.lit("CWE-"), item["n"]))


# --- locations --------------------------------------------------------------------------------


def asserted_sha256(hashes: Column) -> Column:
    """The SHA-256 an artifact claims, under any accepted spelling of the key."""
    entries = F.filter(
        F.map_entries(hashes),
        lambda entry: F.replace(F.lower(entry["key"]), F.lit("_"), F.lit("-")).isin(
            "sha-256", "sha256"
        )
        & F.lower(entry["value"]).rlike(fixed.SHA256_PATTERN),
    )
    return F.lower(F.get(entries, F.lit(0))["value"])


def named_artifact(artifact: Column) -> Column:
    """What locations take from an artifact; its hashes are read once a run, not for each location."""
    return F.when(
        artifact.isNotNull(), record(location=artifact["location"], asserted=asserted_sha256(artifact["hashes"]))
    )


def locate(location: Column, related: Column, artifacts: Column, bases: Column) -> Column:
    """``STRUCT<physical, indexed, asserted, uri, base>``: what one raw location names in its run.

    A location without a physical one borrows that of the related location with its id; a missing
    uri or base comes from the artifact it points at.
    """
    stand_in = F.get(F.filter(related, lambda item: item["id"] == location["id"]), F.lit(0))

    def with_artifact(physical: Column) -> Column:
        declared = physical["artifactLocation"]
        return let(
            F.get(artifacts, declared["index"]),
            lambda artifact: with_names(physical, declared, artifact),
        )

    def with_names(physical: Column, declared: Column, artifact: Column) -> Column:
        base_id = F.when(declared["uri"].isNotNull(), declared["uriBaseId"]).otherwise(
            F.coalesce(
                F.nullif(declared["uriBaseId"], F.lit("")), artifact["location"]["uriBaseId"]
            )
        )
        return record(
            physical=physical,
            indexed=artifact.isNotNull(),
            asserted=artifact["asserted"],
            uri=F.coalesce(declared["uri"], artifact["location"]["uri"]),
            base=F.when(base_id.isNotNull(), look_up_base(base_id, bases)),
        )

    return let(F.coalesce(location["physicalLocation"], stand_in["physicalLocation"]), with_artifact)


def locate_all(result: Column, artifacts: Column, bases: Column) -> Column:
    """Lists of named locations: primary and additional, related, then one list per thread."""
    related = F.coalesce(result["relatedLocations"], F.array())
    threads = F.flatten(
        F.transform(
            F.coalesce(result["codeFlows"], F.array()),
            lambda flow: F.coalesce(flow["threadFlows"], F.array()),
        )
    )
    # all lists in one pass, so the expression of one location is planned once
    lists = F.concat(
        F.array(F.coalesce(result["locations"], F.array()), related),
        F.transform(
            threads,
            lambda thread: F.transform(
                F.coalesce(thread["locations"], F.array()), lambda step: step["location"]
            ),
        ),
    )
    return F.transform(
        lists,
        lambda items: F.transform(
            items, lambda location: locate(location, related, artifacts, bases)
        ),
    )


def resolve_location(named: Column, column_kind: Column, source_root: Column | None) -> Column:
    """``STRUCT<code, reason, asserted, location>`` for one location of ``locate``."""
    physical = named["physical"]

    def with_physical(phys: Column) -> Column:
        item = {
            "declared": phys["artifactLocation"],
            "region": phys["region"],
            "snippet": F.coalesce(phys["region"]["snippet"], phys["contextRegion"]["snippet"]),
        }
        return let(
            record(child=canonicalize_uri(named["uri"]), base=named["base"]),
            lambda found: with_path(item, found),
        )

    def with_path(item: dict[str, Column], found: Column) -> Column:
        base = found["base"]
        joined = F.when(base.isNull(), found["child"]).otherwise(
            join_uri(base["path"], found["child"])
        )
        return let(
            let(joined, lambda path: relative_path(path, base["anchor"], source_root)),
            lambda relative: finish(item, found, relative),
        )

    def finish(item: dict[str, Column], found: Column, relative: Column) -> Column:
        region, declared = item["region"], item["declared"]
        end_line = F.coalesce(
            region["endLine"], F.when(region["endColumn"].isNotNull(), region["startLine"])
        )
        start_column = F.coalesce(region["startColumn"], F.lit(1))
        out_of_range = reduce(
            lambda left, right: left | right,
            [
                F.coalesce(region[name] < 1, F.lit(False))
                for name in ("startLine", "startColumn", "endLine", "endColumn")
            ],
        )
        invalid = first_reason(
            (physical.isNull(), "location has no physicalLocation"),
            (declared.isNull(), "physicalLocation has no artifactLocation"),
            (region["startLine"].isNull(), "region requires startLine"),
            (out_of_range, "region coordinate is below one"),
            (
                declared["index"].isNotNull() & ~named["indexed"],
                "artifact index is out of range",
            ),
            (named["uri"].isNull(), "artifactLocation requires uri or a valid index"),
            (found["base"]["reason"].isNotNull(), found["base"]["reason"]),
        )
        unsafe = first_reason((relative["reason"].isNotNull(), relative["reason"]))
        order = first_reason(
            (end_line < region["startLine"], "endLine precedes startLine"),
            (
                (end_line == region["startLine"]) & (region["endColumn"] < start_column),
                "endColumn precedes startColumn",
            ),
            (~is_safe_relative_path(relative["path"]), "path is not a safe relative path"),
        )
        return record(
            code=F.when(invalid.isNotNull(), F.lit(_INVALID))
            .when(unsafe.isNotNull(), F.lit(_UNSAFE))
            .otherwise(F.lit(_INVALID)),
            reason=F.coalesce(invalid, unsafe, order),
            asserted=named["asserted"],
            location=struct_of(
                artifact_sha256=F.lit(None).cast("string"),
                column_kind=column_kind,
                end_column=region["endColumn"],
                end_line=end_line,
                path=relative["path"],
                snippet=message_text(item["snippet"]),
                start_column=start_column,
                start_line=region["startLine"],
            ),
        )

    return let(physical, with_physical)


def step_kind(kinds: Column, index: Column, last: Column) -> Column:
    """Declared source or sink first, then position."""
    declared = F.transform(F.coalesce(kinds, F.array().cast(_NO_STRINGS)), F.lower)
    return (
        F.when(F.array_contains(declared, "source"), "source")
        .when(F.array_contains(declared, "sink"), "sink")
        .when(index == 0, "source")
        .when(index == last, "sink")
        .otherwise("intermediate")
    )


def path_completeness(steps: Column) -> Column:
    return F.when(F.size(steps) >= 2, "complete").otherwise("partial")


# --- whole results ------------------------------------------------------------------------------


def _bad_fingerprints(values: Column, label: str) -> list[tuple[Column, str]]:
    entries = F.map_entries(values)
    return [
        (
            F.exists(entries, lambda e: (e["key"] == "") | (F.coalesce(e["value"], F.lit("")) == "")),
            f"{label} keys and values must be non-empty",
        ),
        (
            F.exists(entries, lambda e: has_control(F.concat(e["key"], e["value"]))),
            f"{label} contains control characters",
        ),
    ]


def resolve_results(results: DataFrame, source_root: str | None = None) -> DataFrame:
    """Rule, locations and paths of each result, plus the first thing wrong with it."""
    root = canonicalize_uri(F.lit(source_root)) if source_root is not None else None
    result = F.col("result")
    related = F.coalesce(result["relatedLocations"], F.array())
    flows = F.coalesce(result["codeFlows"], F.array())

    threads = F.flatten(
        F.transform(
            flows,
            lambda flow: F.transform(
                F.coalesce(flow["threadFlows"], F.array()),
                lambda thread: record(
                    message=F.coalesce(
                        F.nullif(message_text(thread["message"]), F.lit("")),
                        message_text(flow["message"]),
                    ),
                    steps=thread["locations"],
                ),
            ),
        )
    )

    def thread_steps(thread: Column) -> Column:
        last = F.size(thread["steps"]) - 1
        return F.transform(
            thread["steps"],
            lambda step, index: record(
                index=index,
                message=message_text(step["location"]["message"]),
                step_kind=step_kind(step["kinds"], index, last),
                kinds=F.coalesce(step["kinds"], F.array().cast(_NO_STRINGS)),
                nesting_level=step["nestingLevel"],
                execution_order=step["executionOrder"],
                importance=step["importance"],
            ),
        )

    related_ids = F.filter(
        F.transform(related, lambda item: item["id"]), lambda number: number.isNotNull()
    )
    frame = (
        results.withColumn("rule", rule_metadata(F.col("picked.rule_id"), F.col("picked.rule"), result))
        .withColumn("raw_threads", threads)
        .withColumn(
            "resolved",
            F.transform(
                "located_lists",
                lambda items: F.transform(
                    items, lambda named: resolve_location(named, F.col("column_kind"), root)
                ),
            ),
        )
        .withColumn(
            "threads",
            F.transform(
                "raw_threads",
                lambda thread: record(
                    message=thread["message"], steps=thread_steps(thread)
                ),
            ),
        )
    )
    failing = F.get(
        F.filter(F.flatten("resolved"), lambda item: item["reason"].isNotNull()), F.lit(0)
    )
    invalid = first_reason(
        (F.col("picked.reason").isNotNull(), F.col("picked.reason")),
        (
            F.size(related_ids) > F.size(F.array_distinct(related_ids)),
            "duplicate related location id",
        ),
    )
    located = failing
    message = message_text(result["message"])
    late = first_reason(
        (F.coalesce(F.size(result["locations"]), F.lit(0)) == 0, "result has no physical location"),
        (
            F.exists(flows, lambda flow: F.coalesce(F.size(flow["threadFlows"]), F.lit(0)) < 1),
            "codeFlow contains no threadFlows",
        ),
        (
            F.exists("threads", lambda thread: F.coalesce(F.size(thread["steps"]), F.lit(0)) < 1),
            "threadFlow contains no locations",
        ),
        (
            F.exists(
                "threads",
                lambda thread: F.exists(
                    thread["steps"],
                    lambda step: ~F.coalesce(
                        step["importance"].isin(fixed.IMPORTANCE), F.lit(True)
                    )
                    | F.coalesce(step["nesting_level"] < 0, F.lit(False))
                    | F.coalesce(step["execution_order"] < 0, F.lit(False))
                    | F.exists(step["kinds"], lambda kind: F.length(kind) < 1),
                ),
            ),
            "invalid path step",
        ),
        *_bad_fingerprints(result["fingerprints"], "fingerprint"),
        *_bad_fingerprints(result["partialFingerprints"], "partial fingerprint"),
        (~F.length("rule.rule_id").between(1, 512), "invalid rule id"),
        (~F.length("rule.severity").between(1, 64), "invalid severity"),
        (F.exists("rule.tags", lambda tag: ~F.length(tag).between(1, 512)), "invalid tag"),
        (F.coalesce(message, F.lit("")) == "", "result has an empty message"),
        (
            F.col("commit_sha").isNotNull()
            & ~normalize_commit(F.col("commit_sha")).rlike(fixed.COMMIT_PATTERN),
            "commit is not a full SHA",
        ),
    )
    return frame.select(
        *OCCURRENCE,
        "repository_identity",
        normalize_commit(F.col("commit_sha")).alias("commit_sha"),
        "rule",
        message.alias("message"),
        F.coalesce(F.nullif(result["level"], F.lit("")), F.col("rule.severity")).alias("level"),
        "resolved",
        "threads",
        (F.size(flows) > 0).alias("has_code_flows"),
        sorted_map(
            F.coalesce(result["fingerprints"], F.create_map().cast("map<string,string>"))
        ).alias("fingerprints"),
        sorted_map(
            F.coalesce(result["partialFingerprints"], F.create_map().cast("map<string,string>"))
        ).alias("partial_fingerprints"),
        result["properties"].alias("result_properties"),
        F.when(invalid.isNotNull(), record(code=F.lit(_INVALID), detail=invalid))
        .when(
            located.isNotNull(),
            record(code=located["code"], detail=located["reason"]),
        )
        .when(late.isNotNull(), record(code=F.lit(_INVALID), detail=late))
        .alias("fault"),
    )


def observe_hashes(resolved: DataFrame, source_files: DataFrame) -> DataFrame:
    """Adds ``observed``: path to the hash of the file found there.

    One pass: an alert becomes one row per distinct path, its data riding on the first, meets
    the files and is put together again. Joining hashes back to ``resolved`` would parse every
    document twice. A file cited by very many alerts is split by the adaptive skew join.
    """
    data = [name for name in resolved.columns if name not in OCCURRENCE]
    spread = resolved.select(
        *OCCURRENCE,
        F.struct(*data).alias("data"),
        F.posexplode_outer(
            F.array_distinct(
                F.transform(F.flatten("resolved"), lambda item: item["location"]["path"])
            )
        ).alias("position", "path"),
    ).select(
        *OCCURRENCE,
        F.col("data.repository_identity").alias("repository_identity"),
        "path",
        F.when(F.coalesce("position", F.lit(0)) == 0, F.col("data")).alias("data"),
    )
    # a path that a source table names twice, with different bytes, has no one hash to observe
    files = (
        source_files.groupBy("repository_identity", "path")
        .agg(F.min("artifact_sha256").alias("artifact_sha256"), F.max("artifact_sha256").alias("other_sha256"))
        .where("artifact_sha256 = other_sha256")
        .drop("other_sha256")
    )
    found = F.when(
        F.col("artifact_sha256").isNotNull(), F.struct("path", "artifact_sha256")
    )
    # dealt by document, as the verdict on a document needs its alerts together next; its rows repeat much
    # of its bytes and are compressed best where they lie together
    return (
        spread.join(files, ["repository_identity", "path"], "left")
        .repartition("raw_sarif_sha256")
        .groupBy(*OCCURRENCE)
        .agg(
            F.first("data", ignorenulls=True).alias("data"),
            F.map_from_entries(F.collect_set(found)).alias("observed"),
        )
        .select(*OCCURRENCE, "data.*", "observed")
    )


def normalize(
    gated: DataFrame,
    source_files: DataFrame | None = None,
    source_root: str | None = None,
) -> DataFrame:
    """Every result of every accepted document, with the verdict on its document.

    ``document_fault`` is null when the whole document normalizes; use ``alerts`` and
    ``normalization_rejects`` to split. A document fails as a whole, as one bad result makes
    the identities of its siblings untrustworthy.
    """
    resolved = resolve_results(explode_results(gated), source_root)
    if source_files is None:
        resolved = resolved.withColumn("observed", F.lit(None).cast("map<string,string>"))
    else:
        resolved = observe_hashes(resolved, source_files)
    observed = F.coalesce("observed", F.create_map().cast("map<string,string>"))

    def hashed(item: Column) -> Column:
        return item["location"].withField("artifact_sha256", observed[item["location"]["path"]])

    conflict = F.exists(
        F.flatten("resolved"),
        lambda item: item["asserted"] != observed[item["location"]["path"]],
    )
    paths = F.transform(
        "threads",
        lambda thread, ordinal: let(
            F.zip_with(
                thread["steps"],
                F.get("hashed", ordinal + 2),
                lambda step, location: struct_of(
                    execution_order=step["execution_order"],
                    importance=step["importance"],
                    index=step["index"],
                    kinds=step["kinds"],
                    location=location,
                    message=step["message"],
                    nesting_level=step["nesting_level"],
                    provenance=F.lit("sarif.codeFlows"),
                    step_kind=step["step_kind"],
                ),
            ),
            lambda steps: struct_of(
                completeness=path_completeness(steps),
                message=thread["message"],
                ordinal=ordinal,
                path_fingerprint=path_fingerprint(steps),
                steps=steps,
                unresolved_edges=F.array().cast(_NO_STRINGS),
            ),
        ),
    )
    by_document = Window.partitionBy("raw_sarif_sha256")
    located = (
        resolved.withColumn(
            "hashed", F.transform("resolved", lambda items: F.transform(items, hashed))
        )
        .withColumn("locations", F.get("hashed", F.lit(0)))
        .withColumn("paths", paths)
    )
    shaped = located.select(
        *OCCURRENCE,
        analysis_id(
            F.col("raw_sarif_sha256"), F.col("repository_identity"), F.col("commit_sha")
        ).alias("analysis_id"),
        "repository_identity",
        "commit_sha",
        "rule",
        "message",
        "level",
        F.get("locations", F.lit(0)).alias("primary_location"),
        F.slice("locations", F.lit(2), F.greatest(F.size("locations") - 1, F.lit(0))).alias(
            "additional_locations"
        ),
        F.get("hashed", F.lit(1)).alias("related_locations"),
        "paths",
        "has_code_flows",
        "fingerprints",
        "partial_fingerprints",
        "result_properties",
        F.coalesce(
            "fault",
            F.when(
                conflict,
                record(
                    code=F.lit(_INVALID),
                    detail=F.lit("artifact SHA-256 does not match the source"),
                ),
            ),
        ).alias("fault"),
    )
    return shaped.withColumn(
        "alert_fingerprint",
        alert_fingerprint(
            F.col("rule.rule_id"),
            F.col("message"),
            F.col("primary_location"),
            F.col("fingerprints"),
            F.col("partial_fingerprints"),
            F.transform("paths", lambda path: path["path_fingerprint"]),
        ),
    ).withColumn(
        "document_fault",
        F.min(
            F.when(F.col("fault").isNotNull(), F.struct("run_index", "result_index", "fault"))
        ).over(by_document),
    )


def path_fingerprint(steps: Column) -> Column:
    return domain_sha256(
        fixed.PATH_DOMAIN,
        F.transform(
            steps,
            lambda step: struct_of(
                kinds=step["kinds"],
                location=step["location"],
                message=step["message"],
                step_kind=step["step_kind"],
            ),
        ),
    )


def alert_fingerprint(
    rule_id: Column,
    message: Column,
    primary_location: Column,
    fingerprints: Column,
    partial_fingerprints: Column,
    path_fingerprints: Column,
) -> Column:
    return domain_sha256(
        fixed.ALERT_DOMAIN,
        struct_of(
            fingerprints=fingerprints,
            message=message,
            partial_fingerprints=partial_fingerprints,
            path_fingerprints=path_fingerprints,
            primary_location=primary_location,
            rule_id=rule_id,
        ),
    )


def alerts(normalized: DataFrame) -> DataFrame:
    return normalized.where("document_fault is null").drop("fault", "document_fault")


def normalization_rejects(normalized: DataFrame) -> DataFrame:
    """One reject per failed document: its first failing result."""
    return normalized.where(
        "document_fault.run_index = run_index and document_fault.result_index = result_index"
    ).select(
        *OCCURRENCE,
        F.lit("normalize").alias("stage"),
        F.col("document_fault.fault.code").alias("error_code"),
        F.col("document_fault.fault.detail").alias("detail"),
    )


def paths_table(alert_rows: DataFrame) -> DataFrame:
    return alert_rows.select(*OCCURRENCE, F.explode("paths").alias("path")).select(
        *OCCURRENCE,
        "path.ordinal",
        "path.path_fingerprint",
        "path.completeness",
        "path.message",
        F.size("path.steps").alias("n_steps"),
        F.get("path.steps", F.lit(0))["location"].alias("source_location"),
        "path.steps",
    )


def path_steps_table(path_rows: DataFrame) -> DataFrame:
    return path_rows.select(
        *OCCURRENCE, "ordinal", F.posexplode("steps").alias("step_index", "step")
    ).select(
        *OCCURRENCE,
        "ordinal",
        "step_index",
        "step.location",
        "step.message",
        "step.step_kind",
        "step.kinds",
        "step.nesting_level",
        "step.execution_order",
        "step.importance",
    )


def provenance_faults(alert_rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Alerts whose provenance disagrees with their document, or that share an occurrence."""
    known = documents.select(
        "raw_sarif_sha256",
        F.col("repository_identity").alias("known_repository"),
        normalize_commit(F.col("commit_sha")).alias("known_commit"),
    )
    wrong = (
        alert_rows.join(known, "raw_sarif_sha256", "left")
        .where(
            F.col("known_repository").isNull()
            | (F.col("known_repository") != F.col("repository_identity"))
            | ~F.col("known_commit").eqNullSafe(F.col("commit_sha"))
        )
        .select(*OCCURRENCE, F.lit("provenance does not match its document").alias("detail"))
    )
    shared = (
        alert_rows.groupBy(*OCCURRENCE)
        .count()
        .where("count > 1")
        .select(*OCCURRENCE, F.lit("occurrence is not unique").alias("detail"))
    )
    return wrong.unionByName(shared)
