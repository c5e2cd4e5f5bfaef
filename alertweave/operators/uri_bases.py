"""Chains of URI bases, walked inside the row that declares them.

A run declares a handful of bases, so each chain is followed with array functions where it
lies: no shuffle, and the depth bound of the contract bounds the walk.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertweave import fixed_values as fixed
from alertweave.functions.expressions import first_reason, let, record
from alertweave.functions.uri import URI_TYPE, canonicalize_uri, empty_root, join_uri

_STATE = f"struct<next:string,visited:array<string>,path:{URI_TYPE},anchor:{URI_TYPE},reason:string>"


def declared_bases(declared: Column) -> Column:
    """Entries of a ``MAP<id, STRUCT<uri, uriBaseId>>`` with each URI parsed once."""
    return F.transform(
        F.coalesce(F.map_entries(declared), F.array()),
        lambda entry: record(
            base_id=entry["key"],
            has_uri=entry["value"]["uri"].isNotNull(),
            parent=entry["value"]["uriBaseId"],
            uri=canonicalize_uri(entry["value"]["uri"]),
        ),
    )


def resolve_base(base_id: Column, bases: Column) -> Column:
    """``STRUCT<reason, path, anchor>`` of one base; ``bases`` comes from ``declared_bases``."""
    start = record(
        next=base_id,
        visited=F.array().cast("array<string>"),
        path=empty_root(),
        anchor=F.lit(None).cast(URI_TYPE),
        reason=F.lit(None).cast("string"),
    ).cast(_STATE)
    # A chain longer than the declared bases must repeat one, which the walk reports.
    hops = F.sequence(
        F.lit(1), F.least(F.size(bases) + 2, F.lit(fixed.MAXIMUM_URI_BASE_DEPTH + 1))
    )

    def step(state: Column, hop: Column) -> Column:
        found = F.get(F.filter(bases, lambda base: base["base_id"] == state["next"]), F.lit(0))
        return F.when(state["next"].isNull() | state["reason"].isNotNull(), state).otherwise(
            let(found, lambda base: visit(state, base))
        )

    def visit(state: Column, base: Column) -> Column:
        implicit = base.isNull() & (F.lower(state["next"]) == "%srcroot%")
        reason = first_reason(
            (
                F.size(state["visited"]) >= fixed.MAXIMUM_URI_BASE_DEPTH,
                "URI base chain is too deep",
            ),
            (F.array_contains(state["visited"], state["next"]), "URI base chain is cyclic"),
            (base.isNull() & ~implicit, "unknown URI base"),
            (~implicit & ~base["has_uri"], "URI base has no uri"),
            (base["uri"]["reason"].isNotNull(), base["uri"]["reason"]),
        )
        own = F.when(implicit, empty_root()).otherwise(base["uri"])
        is_root = base["parent"].isNull()
        return record(
            next=F.when(~implicit, base["parent"]),
            visited=F.concat(state["visited"], F.array(state["next"])),
            path=join_uri(own, state["path"]),
            anchor=F.when(~implicit & is_root & base["uri"]["absolute"], base["uri"])
            .otherwise(state["anchor"]),
            reason=reason,
        ).cast(_STATE)

    return let(
        F.aggregate(hops, start, step),
        lambda state: record(
            reason=state["reason"],
            path=state["path"],
            anchor=state["anchor"],
        ),
    )


def resolve_declared(declared: Column) -> Column:
    """``ARRAY<STRUCT<base_id, reason, path, anchor>>``: every declared base, walked once."""
    return let(
        declared_bases(declared),
        lambda bases: F.transform(
            bases,
            lambda base: let(
                resolve_base(base["base_id"], bases),
                lambda found: record(
                    base_id=base["base_id"],
                    reason=found["reason"],
                    path=found["path"],
                    anchor=found["anchor"],
                ),
            ),
        ),
    )


def look_up_base(base_id: Column, resolved: Column) -> Column:
    """The resolved base a location names; the source root needs no declaration."""
    found = F.get(F.filter(resolved, lambda base: base["base_id"] == base_id), F.lit(0))
    return let(
        found,
        lambda base: F.when(base.isNotNull(), base).otherwise(
            record(
                base_id=base_id,
                reason=F.when(F.lower(base_id) != "%srcroot%", F.lit("unknown URI base")),
                path=empty_root(),
                anchor=F.lit(None).cast(URI_TYPE),
            )
        ),
    )
