"""SimHash near-duplicates found by multi-index hashing, grouped into connected components.

A fingerprint has a bit set where over half the shingle hashes have it. Two fingerprints link at
``radius`` or fewer differing bits. The 64 bits are cut into two segments; if two fingerprints are
within the radius, their first segments differ in at most ``radius // 2`` bits or their second ones
in at most ``(radius + 1) // 2 - 1``. So each fingerprint is entered in one table per segment, each
one enumerates the small Hamming ball around its own segment, fetches the entries there, and the
whole distance is checked inside the join: only true links come out, each of them once. Of two
segments that differ, one has the lowest differing bit set, and only that one asks for the other:
half the ball is enough, and half as many probes move.

Only distinct fingerprints are linked, so exact copies cost nothing beyond a minimum per
fingerprint. Components come from rounds of hooking and shortcutting in which every step is a join
with one row per node or a minimum; each round is kept as a small Parquet table, whose size Spark knows
before it plans the next one. Nothing is gathered.

Texts without words (null and blank ones too) have fingerprint zero and link like any other. Rows
with a null ``doc_id`` take part; a component of such rows only has a null id. Repeated rows get
equal results. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.session import cut_lineage, shuffles_removed, stored

RADIUS = 2
SHINGLE = 3
HASH_SEED = 42
SEGMENT_BITS = 32
# shingles whose bits are counted at once
CHUNK = 1 << 16


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """A hash per shingle; a text with fewer words is one shingle, and one without words has none."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[start:end], HASH_SEED) for start, end in spans], dtype="<u8")


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def simhashes(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(text) for text in texts], dtype="int64")


def fingerprint(text: Column) -> Column:
    return F.pandas_udf(simhashes, "long")(text)


def segments(print_: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(print_, SEGMENT_BITS), print_.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def ball(segment: Column, radius: int) -> Column:
    """Of all segment values within the radius, this one and those that lack the lowest bit that differs."""
    masks = [sum(1 << bit for bit in bits) for r in range(radius + 1) for bits in combinations(range(SEGMENT_BITS), r)]
    lowest = lambda mask: mask.bitwiseAND(F.negate(mask))
    asked = F.filter(
        F.array(*[F.lit(mask).cast("long") for mask in masks]),
        lambda mask: lowest(mask).bitwiseAND(segment) == lowest(mask),
    )
    return F.transform(asked, lambda mask: mask.bitwiseXOR(segment))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct ``print`` values to links ``low < high`` within the radius."""
    near_first, near_second = radius // 2, (radius + 1) // 2 - 1
    own, other = F.col("own"), F.col("other")
    apart = F.bit_count(own.bitwiseXOR(other))

    def found(at: int, near: int, beyond: Column | None) -> DataFrame:
        segment_of = lambda print_: segments(print_)[at]
        segment = segment_of(F.col("print"))
        probes = prints.select(F.col("print").alias("own"), F.explode(ball(segment, near)).alias("probe"))
        entries = prints.select(F.col("print").alias("other"), segment.alias("entry"))
        # equal segments ask for each other, others only one way
        once = (own < other) | (segment_of(own) != segment_of(other))
        on = (F.col("probe") == F.col("entry")) & once & (apart <= radius)
        return probes.join(entries, on if beyond is None else on & beyond).select(
            F.least(own, other).alias("low"), F.greatest(own, other).alias("high")
        )

    by_first = found(0, near_first, None)
    if near_second < 0:
        return by_first
    own_first, _ = segments(own)
    other_first, _ = segments(other)
    # those with near first segments are known already
    return by_first.union(found(1, near_second, F.bit_count(own_first.bitwiseXOR(other_first)) > near_first))


def components(edges: DataFrame) -> DataFrame:
    """``low, high`` edges to ``node, root`` with the smallest node of each component as root."""
    # the edges are made once, and each goes both ways where it lies
    ways = F.array(
        F.struct(F.col("low").alias("node"), F.col("high").alias("peer")),
        F.struct(F.col("high").alias("node"), F.col("low").alias("peer")),
    )
    both = stored(edges.select(F.explode(ways).alias("way")).select("way.*"), "graph-edges")
    parents = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("peer")).alias("root")), "graph-roots")
    before = None
    while True:
        grand = parents.join(
            parents.select(F.col("node").alias("root"), F.col("root").alias("grand")), "root"
        ).select("node", "root", "grand")
        near = (
            both.join(grand.select(F.col("node").alias("peer"), "grand"), "peer")
            .groupBy("node")
            .agg(F.min("grand").alias("near"))
        )
        offers = grand.join(near, "node").select(
            F.explode(
                F.array(
                    F.struct(F.col("node"), F.least("root", "grand", "near").alias("root")),
                    F.struct(F.col("root").alias("node"), F.least("grand", "near").alias("root")),
                )
            ).alias("offer")
        )
        parents = stored(offers.select("offer.*").groupBy("node").agg(F.min("root").alias("root")), "graph-roots")
        with shuffles_removed(parents.sparkSession):
            now = parents.agg(F.count(F.lit(1)), F.sum(F.col("root").cast("decimal(38,0)"))).first()
        if now == before:
            return parents
        before = now


def classes(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, print`` rows to one row per fingerprint: ``print, root, component_id``."""
    prints = cut_lineage(marked.groupBy("print").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(prints.select("print"), radius))
    rooted = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "first_id", F.coalesce("root", "print").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return cut_lineage(rooted.join(least, "root").select("print", "root", "component_id"))


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    marked = cut_lineage(documents.select("doc_id", fingerprint(F.col("text")).alias("print")))
    return marked.join(classes(marked, radius), "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The document with the smallest ``doc_id`` of each component, with the columns it came with."""
    text_hash = F.xxhash64("text").alias("text_hash")
    marked = cut_lineage(documents.select("doc_id", text_hash, fingerprint(F.col("text")).alias("print")))
    return first_of_each(documents, marked, classes(marked.select("doc_id", "print"), radius))


def first_of_each(documents: DataFrame, marked: DataFrame, groups: DataFrame) -> DataFrame:
    """One document per root of ``groups`` (``print, root, component_id``), by the ``doc_id, text_hash, print`` of all."""
    text_hash = F.xxhash64("text").alias("text_hash")
    # of the texts that share the smallest id, one
    stays = (
        marked.join(groups, "print")
        .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min(F.struct("text_hash", "doc_id")).alias("stay"))
        .select(F.col("stay.doc_id").alias("stay_id"), F.col("stay.text_hash").alias("stay_hash"))
    )
    # and of rows that repeat it, one
    first = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("doc_id"))
    return (
        documents.select(F.struct("*").alias("row"), "doc_id", text_hash)
        .join(stays, F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("text_hash") == F.col("stay_hash")))
        .withColumn("copy", first)
        .filter(F.col("copy") == 1)
        .select("row.*")
    )
