"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets come from the weights by water filling: a source stops at ``cap`` times its own words and
the excess goes to the others by weight. Blocks of equal numbers of words are then apportioned to
sources by the highest quotients ``target / (2 seats + 1)``, and a source's blocks to its shards in
the same way. A shard lays its documents in a seeded order on a ring and takes its quota of blocks
from a seeded starting word on, going round again when the quota is larger than the ring; so a
document is taken in whole passes, but for the two ends of the run.

Only DataFrame operations are used. Rows meet by ``(source, shard)`` with about the root of the row
count as number of shards, so a source with a third of all rows is still spread over many tasks.

Null or blank texts have size 0 and nothing of them is taken. Null sources form one source, last in
order. Repeated rows are separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.llm.shared import seeded, shard_count, word_count
from alertweave.session import cut_lineage

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 20
BLOCK_WORDS = 256
# a source's target holds at least so many blocks, and a group of shards so many
BLOCKS_PER_TARGET = 128
BLOCKS_PER_SHARD = 1024


def apportion(frame: DataFrame, parent: list[str], item: list[Column], weight: str, seats: str) -> DataFrame:
    """Adds ``quota``: the parent's ``seats`` dealt to its items by Sainte-Laguë.

    Only seats near each item's share can be in doubt: rounding with a divisor so large that at
    most ``seats`` come out gives every item's sure seats, and the rest are ranked by quotient.
    """
    whole = Window.partitionBy(*parent)
    share = F.col(weight) / F.nullif(F.col("_all"), F.lit(0.0))
    sure = F.when(
        F.col(seats) > F.col("_items"),
        F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("_items") / 2) + 0.5) - 1),
    ).otherwise(F.lit(0))
    most = F.ceil(share * (F.col(seats) + F.col("_items") / 2) + 1.5)
    known = (
        frame.withColumn("_all", F.sum(F.col(weight).cast("double")).over(whole))
        .withColumn("_items", F.count(F.lit(1)).over(whole))
        .withColumn("_sure", F.coalesce(sure, F.lit(0)).cast("long"))
        .withColumn("_most", F.coalesce(most, F.lit(0)).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(whole))
    )
    kept = [name for name in frame.columns]
    quotients = known.select(
        *kept, "_sure", "_open", F.explode(F.sequence(F.col("_sure"), F.greatest("_sure", "_most"))).alias("_seat")
    ).withColumn("_quotient", F.col(weight) / (2 * F.col("_seat") + 1))
    ranked = quotients.withColumn(
        "_rank", F.row_number().over(whole.orderBy(F.col("_quotient").desc(), *item, F.col("_seat")))
    )
    won = (F.col("_rank") <= F.col("_open")) & (F.col(weight) > 0)
    return (
        ranked.groupBy(*kept)
        .agg((F.max("_sure") + F.sum(won.cast("long"))).alias("quota"))
    )


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, source_size`` to targets, block size and the number of blocks of the whole mix."""
    everything = Window.partitionBy("_mix")
    by_source = everything.orderBy(F.col("source").asc_nulls_last())
    by_ratio = everything.orderBy("_ratio", F.col("source").asc_nulls_last())
    dealt = F.array(*[F.lit(float(weight)) for weight in weights])
    filled = (
        sources.withColumn("_mix", F.lit(0))
        .withColumn("_at", F.row_number().over(by_source) - 1)
        .withColumn("_weight", F.get(dealt, (F.col("_at") % len(weights)).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn(
            "_capped",
            F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        )
        .withColumn("_free", F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_free"))
        # the first source in this order that the level of all later ones does not push over its cap
        .withColumn(
            "_level",
            F.min_by(F.col("_level"), F.when(F.col("_level") <= F.col("_ratio"), F.col("_ratio"))).over(everything),
        )
        .withColumn("target", F.coalesce(F.least(F.col("_weight") * F.col("_level"), F.col("_cap")), F.col("_cap")))
    )
    least_target = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    block = F.greatest(
        F.lit(1), F.least(F.lit(BLOCK_WORDS), F.coalesce(F.floor(least_target / BLOCKS_PER_TARGET), F.lit(1)))
    )
    return (
        filled.withColumn("block", block.cast("long"))
        .withColumn("blocks", F.round(F.sum("target").over(everything) / F.col("block")).cast("long"))
        .select("_mix", "source", "source_size", "target", "block", "blocks")
    )


def shard_plan(sized: DataFrame, weights: tuple[int, ...], cap: float, seed: int) -> DataFrame:
    """A row per ``(source, shard)``: where the shard lies on its ring and what the ring's run is."""
    shards = sized.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    sources = shards.groupBy("source").agg(F.sum("shard_size").alias("source_size"))
    quotas = apportion(
        source_targets(sources, weights, cap), ["_mix"], [F.col("source").asc_nulls_last()], "target", "blocks"
    ).select(F.col("source").alias("_source"), "source_size", "target", "block", F.col("quota").alias("source_quota"))
    laid = (
        shards.join(quotas, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn(
            "before",
            F.coalesce(
                F.sum("shard_size").over(
                    Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        # small neighbouring shards share a ring, else rounding to blocks would tell
        .withColumn("ring", F.floor(F.col("before") / (F.col("block") * BLOCKS_PER_SHARD)).cast("long"))
    )
    rings = laid.groupBy("source", "ring", "source_quota", "block").agg(
        F.sum("shard_size").alias("ring_size"), F.min("before").alias("ring_start")
    )
    runs = apportion(rings, ["source"], [F.col("ring")], "ring_size", "source_quota").select(
        F.col("source").alias("_source"),
        F.col("ring").alias("_ring"),
        "ring_size",
        "ring_start",
        F.col("quota").alias("ring_quota"),
        F.least(F.col("quota") * F.col("block"), F.floor(F.col("ring_size") * F.lit(float(cap)))).cast("long").alias("run"),
        F.pmod(seeded(seed, F.col("source"), F.col("ring")), F.greatest("ring_size", F.lit(1))).alias("run_start"),
    )
    return laid.join(
        runs, F.col("source").eqNullSafe(F.col("_source")) & (F.col("ring") == F.col("_ring"))
    ).select(
        F.col("source").alias("plan_source"),
        F.col("shard").alias("plan_shard"),
        "source_size",
        "target",
        "block",
        "ring",
        "ring_quota",
        "ring_size",
        "run",
        "run_start",
        (F.col("before") - F.col("ring_start")).alias("shard_start"),
    )


def overlap(start: Column, end: Column, run_start: Column, run_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end, run_end) - F.greatest(start, run_start))


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: float = CAP,
    seed: int = SEED,
    carry: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target, taken`` and the run it is
    part of (``ring, ring_quota, block``); with ``carry`` also the whole input row as ``row``."""
    shards = shard_count(documents.count())
    order = seeded(seed, F.col("doc_id"), F.col("text"))
    chosen = [
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        order.alias("order"),
        F.pmod(order, F.lit(shards)).alias("shard"),
    ]
    sized = cut_lineage(documents.select(*chosen))
    plan = shard_plan(sized, weights, cap, seed)
    rows = documents.select(*chosen, F.struct("*").alias("row")) if carry else sized
    inside = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size")
    start = F.col("shard_start") + F.sum("size").over(inside) - F.col("size")
    ring = F.greatest("ring_size", F.lit(1))
    placed = (
        rows.join(
            plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("shard") == F.col("plan_shard"))
        )
        .withColumn("start", start)
        .withColumn("end", F.col("start") + F.col("size"))
        .withColumn("passes", F.floor(F.col("run") / ring).cast("long"))
        .withColumn("run_end", F.col("run_start") + F.pmod(F.col("run"), ring))
    )
    taken = (
        F.col("passes") * F.col("size")
        + overlap(F.col("start"), F.col("end"), F.col("run_start"), F.col("run_end"))
        + overlap(F.col("start"), F.col("end"), F.col("run_start") - ring, F.col("run_end") - ring)
    )
    return placed.select(
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        "ring",
        "ring_quota",
        "block",
        *(["row"] if carry else []),
    )


def mixed_documents(documents: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as whole passes take it, to the nearest, with the
    columns it came with."""
    copies = F.floor((F.col("taken") + F.col("size") / 2) / F.col("size")).cast("int")
    return (
        mix(documents, carry=True, **settings)
        .filter((F.col("size") > 0) & (2 * F.col("taken") >= F.col("size")))
        .select("row", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
        .select("row.*")
    )
