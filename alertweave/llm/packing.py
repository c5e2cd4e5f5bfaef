"""Packing by optimal length buckets.

The histogram of document lengths over the whole table decides ``buckets`` upper lengths by dynamic
programming, so that padding every document to its bucket's length costs the fewest tokens. Inside
a bucket, documents in a seeded order form batches of as many rows as the token budget holds.

The histogram is exact to 16,384 and above that holds bins of 1/8192 of their length, each with its
own longest length, so that what reaches the driver is bounded whatever the table. Batches are
numbered inside ``(bucket, shard)`` and shifted, so a bucket with most rows is still many tasks.

Null and blank texts have length 0 and are packed like any other. A document longer than the budget
is a batch of its own. Repeated rows take a slot each. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.llm.shared import rank_within, seeded, shard_count, word_count

BUCKETS = 16
BUDGET = 65_536
SEED = 8
EXACT_BITS = 14


def length_bin(length: Column) -> Column:
    """Lengths below 2**EXACT_BITS as they are; longer ones without their low bits."""
    bits = F.greatest(F.lit(0), F.length(F.bin(length)) - EXACT_BITS)
    return length - F.pmod(length, F.pow(F.lit(2.0), bits).cast("long"))


def histogram(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """``(longest, documents, tokens)`` per bin, in order of length."""
    bins = (
        lengths.groupBy(length_bin(F.col("length")).alias("bin"))
        .agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"))
        .collect()
    )
    return sorted((row.longest, row.n, row.tokens) for row in bins)


def best_bounds(bins: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padded size.

    ``cost[j]`` is the least padded size of the first ``j`` bins in ``b`` buckets. The last bucket
    from bin ``i`` on costs ``longest[j] * (count[j] - count[i])``: for fixed ``i`` a line in
    ``longest[j]``, so the best ``i`` comes from a lower envelope of lines and a layer takes linear
    time.
    """
    if not bins:
        return []
    longest = [top for top, _, _ in bins]
    count = [0]
    for _, n, _ in bins:
        count.append(count[-1] + n)
    size = len(bins)
    unreachable = longest[-1] * count[-1] + 1
    cost: list[int] = [0] + [unreachable] * size
    choices: list[list[int]] = []
    for _ in range(min(buckets, size)):
        nxt, chosen = [unreachable] * (size + 1), [0] * (size + 1)
        nxt[0] = 0
        lines: list[int] = []
        head = 0

        def worse(a: int, b: int, c: int) -> bool:
            # line b is nowhere below both a and c
            return (cost[c] - cost[a]) * (count[b] - count[a]) <= (cost[b] - cost[a]) * (count[c] - count[a])

        for j in range(1, size + 1):
            i = j - 1
            if cost[i] < unreachable:
                while len(lines) - head >= 2 and worse(lines[-2], lines[-1], i):
                    lines.pop()
                lines.append(i)
            top = longest[j - 1]
            while len(lines) - head >= 2 and (
                cost[lines[head + 1]] - top * count[lines[head + 1]] <= cost[lines[head]] - top * count[lines[head]]
            ):
                head += 1
            best = lines[head]
            nxt[j], chosen[j] = cost[best] + top * (count[j] - count[best]), best
        choices.append(chosen)
        cost = nxt
    bounds, j = [], size
    for chosen in reversed(choices):
        if j == 0:
            break
        bounds.append(longest[j - 1])
        j = chosen[j]
    return bounds[::-1]


def pack(
    documents: DataFrame,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    seed: int = SEED,
    length: Column | None = None,
    carry: bool = False,
) -> DataFrame:
    """``doc_id, length, bucket, bucket_length, padding, batch, slot`` per document: batches are
    numbered from 0 in their bucket and slots in their batch. With ``carry`` also ``row``."""
    length = word_count(F.col("text")) if length is None else length
    bounds = best_bounds(histogram(documents.select(length.alias("length"))), buckets)
    shards = shard_count(documents.count())
    order = seeded(seed, F.col("doc_id"), F.col("text"))
    rows = documents.select(
        "doc_id",
        length.alias("length"),
        order.alias("order"),
        F.pmod(order, F.lit(shards)).alias("shard"),
        *([F.struct("*").alias("row")] if carry else []),
    )
    bucket = sum((F.when(F.col("length") > bound, 1).otherwise(0) for bound in bounds[:-1]), F.lit(0))
    tops = F.array(*[F.lit(bound).cast("long") for bound in bounds or [0]])
    placed = (
        rows.withColumn("bucket", bucket)
        .withColumn("bucket_length", F.get(tops, F.col("bucket")))
        .withColumn("batch_rows", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1)))).cast("long"))
    )
    ranked = rank_within(placed, "bucket", "shard", [F.col("order"), F.col("doc_id"), F.col("length")], "rank")
    return ranked.select(
        "doc_id",
        "length",
        "bucket",
        "bucket_length",
        (F.col("bucket_length") - F.col("length")).alias("padding"),
        F.floor(F.col("rank") / F.col("batch_rows")).cast("long").alias("batch"),
        F.pmod(F.col("rank"), F.col("batch_rows")).cast("int").alias("slot"),
        *(["row"] if carry else []),
    )
