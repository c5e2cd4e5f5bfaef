"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of the table, drawn by a hash of their id. A vector is represented by its
``PREFIX`` nearest pivots in order of nearness, and posted with its place in that order to each of
these pivots' inverted files. A query walks the files of its own nearest pivots and sums, per vector,
how far each pivot's two places agree; that gives the footrule distance of the two orders, with
pivots beyond the prefix at its end. The ``RERANK`` share of least distance, ties included, is ranked
again by the cosine of the original vectors.

The index is dealt into shards of bounded size, each with its own inverted files, and the queries
into blocks; each pair of a shard and a block is one group. A group keeps its best ``k`` for each
query, and the best of all shards are chosen by rank. The pivots are the only data that all tasks see.

Vectors that are null, empty or zero, or hold a null or non-finite component, take no part, nor do
rows with a null id. Of several rows with one id, one is used. Vectors of different lengths are not
compared; a length with too few pivots for a permutation is searched in full. A query without
candidates has no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.llm.shared import likely_first
from alertweave.session import cut_lineage

PIVOTS = 512
PREFIX = 64
RERANK = 0.25
# a shard reranks at least so many, and fewer pivots than this make no permutation
LEAST_RERANK = 64
LEAST_PIVOTS = 16
LEAST_SHARD, LARGEST_SHARD = 1024, 65_536
QUERY_BLOCK = 1024
SEED = 4
FOUND = "query_id bigint, vec_id bigint, score double"


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, vector, dimension`` of the rows that take part, one per id."""
    vector = F.col("embedding").cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (
        embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .filter(~F.coalesce(odd, F.lit(True)) & F.exists(vector, lambda x: x != 0))
        .groupBy("vec_id")
        .agg(F.min_by(vector, F.xxhash64("embedding")).alias("vector"))
        .withColumn("dimension", F.size("vector"))
    )


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each vector's nearest pivots in order; equal ones by number."""
    prefix = min(PREFIX, len(pivots))
    return np.argsort(-(unit(vectors) @ pivots.T), axis=1, kind="stable")[:, :prefix]


class Postings:
    """The inverted files of one shard: per pivot, the rows posted there and their places."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray) -> None:
        order = nearest_pivots(vectors, pivots)
        self.rows, self.prefix = order.shape
        by_pivot = np.argsort(order, axis=None, kind="stable")
        self.row, self.place = by_pivot // self.prefix, by_pivot % self.prefix
        self.ends = np.cumsum(np.bincount(order.ravel(), minlength=len(pivots)))

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """What the footrule distance to each row falls short of its largest value, halved: a pivot
        at places ``a`` and ``b`` of the two orders takes off ``prefix - max(a, b)``."""
        ends = self.ends[order]
        starts = np.where(order > 0, self.ends[order - 1], 0)
        sizes = ends - starts
        own = np.repeat(np.arange(len(order)), sizes)
        at = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        gain = self.prefix - np.maximum(own, self.place[at])
        return np.bincount(self.row[at], weights=gain, minlength=self.rows)


def search_shard(
    index: tuple[np.ndarray, np.ndarray],
    queries: tuple[np.ndarray, np.ndarray],
    pivots: np.ndarray | None,
    k: int,
    rerank: float,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: its id, and ids and cosines of its best in this shard. Both sides: ids, vectors."""
    ids, vectors = index
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    depth = max(LEAST_RERANK, math.ceil(rerank * len(ids)))
    postings = None if pivots is None or depth >= len(ids) else Postings(vectors, pivots)
    orders = None if postings is None else nearest_pivots(queries[1], pivots)
    for at, (query_id, query) in enumerate(zip(queries[0].tolist(), queries[1], strict=True)):
        chosen = np.arange(len(ids))
        if postings is not None:
            agreed = postings.agreement(orders[at])
            least = np.partition(agreed, len(agreed) - depth)[len(agreed) - depth]
            chosen = np.flatnonzero(agreed >= least)
        chosen = chosen[ids[chosen] != query_id]
        dots = (vectors[chosen] * query).sum(axis=1)
        scores = dots / (norms[chosen] * math.sqrt((query * query).sum()))
        best = np.lexsort((ids[chosen], -scores))[:k]
        yield query_id, ids[chosen[best]], scores[best]


def neighbours(
    embeddings: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS, rerank: float = RERANK
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for each query row."""
    vectors = cut_lineage(usable(embeddings))
    rows, asked = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    shard_rows = min(LARGEST_SHARD, max(LEAST_SHARD, math.ceil(8 * math.sqrt(rows))))
    shards, blocks = max(1, math.ceil(rows / shard_rows)), max(1, math.ceil(asked / QUERY_BLOCK))
    drawn = F.xxhash64(F.lit(SEED), "vec_id")
    sample: dict[int, list[list[float]]] = {}
    for row in vectors.filter(likely_first(drawn, pivots, rows)).orderBy(drawn, "vec_id").limit(pivots).collect():
        sample.setdefault(row["dimension"], []).append(row["vector"])
    shared = vectors.sparkSession.sparkContext.broadcast(
        {size: unit(np.array(some)) for size, some in sample.items() if len(some) >= LEAST_PIVOTS}
    )
    shard = F.pmod(F.xxhash64(F.lit(SEED + 1), "vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64(F.lit(SEED + 2), "vec_id"), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = vectors.select("vec_id", "vector", "dimension", shard.alias("shard"), every(blocks).alias("block"))
    queries = vectors.filter(is_query).select(
        "vec_id", "vector", "dimension", every(shards).alias("shard"), block.alias("block")
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64"}
            )
        sides = [(side["vec_id"].to_numpy(), np.array(side["vector"].tolist())) for side in (left, right)]
        near = shared.value.get(int(left["dimension"].iloc[0]))
        found = list(search_shard(*sides, near, k, rerank))
        return pd.DataFrame(
            {
                "query_id": np.repeat([query for query, _, _ in found], [len(ids) for _, ids, _ in found]),
                "vec_id": np.concatenate([ids for _, ids, _ in found]),
                "score": np.concatenate([scores for _, _, scores in found]),
            }
        )

    keys = ["dimension", "shard", "block"]
    best = index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(search, FOUND)
    nearest_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (
        best.withColumn("rank", F.row_number().over(nearest_first))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
