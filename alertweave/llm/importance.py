"""Quality classification by importance resampling.

Two generative models over hashed words and word pairs, one of target text (labelled as good) and
one of all text, give each document its importance: the sum of the log ratios of its
words and pairs. Gumbel noise is added and the ``k`` documents with the largest sums are kept, which
draws them without replacement in proportion to their importance. ``k`` is the share of good
documents among the labelled ones, times a small allowance, of all rows.

Counts of the raw model cover every document. The target model is fitted on at most
``TARGET_DOCUMENTS`` labelled documents, drawn by a hash of their id, so their ids can be sent to all
tasks. The ``k``-th largest sum is found by counting rows in ever finer bins; rows equal to it all stay.

A null text, and one without words, has importance 0 and takes part in the draw. Rows with a null id
draw their noise by their text. Repeated rows draw alike and stay or go together. Of several labels
of a document the worst counts. Without labels all is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.llm.shared import likely_first, seeded
from alertweave.session import cut_lineage

BUCKET_BITS = 16
TARGET_DOCUMENTS = 20_000
SMOOTHING = 1.0
SEED = 9
ALLOWANCE = 1.02
BINS = 1 << 16
BATCH_BYTES = 1 << 19
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def powers(factor: int, size: int) -> np.ndarray:
    factors = np.full(size, factor, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def stirred(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of some texts, and how many each text has."""
    joined = np.frombuffer(b"\n".join([*texts, b""]).lower(), dtype=np.uint8)
    if not len(joined):
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    written = ~BLANK[joined]
    change = np.diff(written.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    of_text = np.searchsorted(np.cumsum([len(text) + 1 for text in texts]), starts, side="right")
    # a word's hash is a polynomial in its bytes, cut out of running sums
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(joined * powers(FACTOR, len(joined)), out=sums[1:])
    words = stirred((sums[ends] - sums[starts]) * powers(INVERSE, len(joined))[starts])
    pairs = stirred(words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:])
    same = of_text[:-1] == of_text[1:]
    owner = np.concatenate((of_text, of_text[:-1][same]))
    buckets = (np.concatenate((words, pairs[same])) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.bincount(owner, minlength=len(texts))


def pieces(texts: pd.Series) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.encode() if text else b""
        if held and size + len(raw) > BATCH_BYTES:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield held


def bucket_counts(documents: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            for texts in pieces(batch["text"]):
                total += np.bincount(features(texts)[0], minlength=len(total))
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    counted = (
        documents.select("text")
        .mapInPandas(count, "bucket bigint, n bigint")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    total = np.zeros(1 << BUCKET_BITS)
    total[counted["bucket"].to_numpy(dtype=int)] = counted["n"].to_numpy()
    return total


def good_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, good``: by the worst of a document's labels."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg((F.min("quality") >= 1).alias("good"))
    )


def log_ratios(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """Per bucket, the log of its share in target text over its share in all text."""
    good = good_labels(labels).filter("good").select("doc_id", seeded(SEED, F.col("doc_id")).alias("order"))
    target = (
        good.filter(likely_first(F.col("order"), TARGET_DOCUMENTS, good.count()))
        .orderBy("order", "doc_id")
        .limit(TARGET_DOCUMENTS)
        .select("doc_id")
    )
    # at most TARGET_DOCUMENTS ids
    wanted = documents.join(F.broadcast(target), "doc_id", "left_semi")
    aimed, raw = bucket_counts(wanted), bucket_counts(documents)
    if not aimed.sum():
        return np.zeros(1 << BUCKET_BITS)
    # both models smoothed with the raw one, so that rare buckets say little
    share = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw))
    weight = SMOOTHING * len(raw)
    return np.log((aimed + weight * share) / (aimed.sum() + weight)) - np.log(share)


def importance(documents: DataFrame, ratios: Broadcast[np.ndarray], *carried: Column) -> DataFrame:
    """The carried columns with ``log_weight``, ``n_features`` and the noisy ``key``."""

    def weigh(texts: pd.Series) -> pd.DataFrame:
        sums, sizes = [], []
        for piece in pieces(texts):
            buckets, n = features(piece)
            running = np.concatenate(([0.0], np.cumsum(ratios.value[buckets])))
            ends = np.cumsum(n)
            sums.append(running[ends] - running[ends - n])
            sizes.append(n)
        if not sums:
            return pd.DataFrame({"log_weight": [], "n_features": []}).astype({"n_features": "int64"})
        return pd.DataFrame({"log_weight": np.concatenate(sums), "n_features": np.concatenate(sizes)})

    weighed = F.pandas_udf(weigh, "log_weight double, n_features bigint")
    # uniform in (0, 1), from the id or else the text
    drawn = (F.pmod(seeded(SEED, F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(1 << 52)) + 0.5) / (1 << 52)
    noise = -F.log(-F.log(drawn))
    rows = documents.select(*carried, noise.alias("noise"), weighed(F.col("text")).alias("weighed"))
    names = rows.columns[:-2]
    return rows.select(
        *names,
        "weighed.log_weight",
        "weighed.n_features",
        (F.col("weighed.log_weight") + F.col("noise")).alias("key"),
    )


def kth_largest(keys: DataFrame, k: int) -> float:
    """The ``k``-th largest value of ``key``: the bin that holds it is cut into bins again."""
    low, high, total = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not total or k >= total:
        return -math.inf
    if k < 1:
        return math.inf
    above = 0
    while low < high:
        width = (high - low) / BINS
        if width == 0 or low + width == low:
            break
        at = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        inside = keys.filter((F.col("key") >= F.lit(low)) & (F.col("key") <= F.lit(high)))
        bins = (
            inside.groupBy(at.alias("at"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
            .collect()
        )
        for one in sorted(bins, key=lambda row: -row["at"]):
            if above + one["n"] >= k:
                low, high = one["low"], one["high"]
                break
            above += one["n"]
    return low


def kept_share(ids: DataFrame, labels: DataFrame, allowance: float = ALLOWANCE) -> float:
    """Share of rows to keep: that of good ones among the labelled, and a little more."""
    good, known = (
        ids.join(good_labels(labels), "doc_id").agg(F.sum(F.col("good").cast("long")), F.count(F.lit(1))).first()
    )
    return min(1.0, allowance * good / known) if known else 1.0


def weigh_all(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, float, Broadcast[np.ndarray]]:
    """Every document's weight, the least key that is kept, and the ratios."""
    ratios = documents.sparkSession.sparkContext.broadcast(log_ratios(documents, labels))
    weighed = cut_lineage(importance(documents, ratios, F.col("doc_id")))
    keys = weighed.select("doc_id", "key")
    k = math.ceil(kept_share(keys.select("doc_id"), labels) * keys.count())
    return weighed, kth_largest(keys, k), ratios


def quality_classifier(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, log_weight, n_features, key, kept`` for every document."""
    weighed, least, _ = weigh_all(documents, labels)
    return weighed.withColumn("kept", F.col("key") >= F.lit(least))


def kept_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents drawn, with the columns they came with. Texts are weighed again where they
    lie: that is cheaper than to move or keep them."""
    _, least, ratios = weigh_all(documents, labels)
    return importance(documents, ratios, F.struct("*").alias("row")).filter(F.col("key") >= F.lit(least)).select("row.*")
