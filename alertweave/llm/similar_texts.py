"""Near-duplicates by the Jaccard similarity of word shingles, by an exact set-similarity join.

A text is the set of its shingles' hashes, and texts with equal sets are one node. Two nodes link if
they share at least ``SIMILARITY`` of all shingles that either has. Shingles are in one order for all
texts: a sample, one of ``SAMPLE`` by hash, comes first, in it those of one node only and then the
common ones, all by the counts of the fullest of ``BUCKETS`` hash buckets. Any order gives the same
links; in this one a text that mostly is its own has no common shingle in its prefix, whatever passages it shares. Of ``n`` shingles a link must share ``need``, so linked nodes
share one of the first ``n - need + 1`` of each (prefix filter); sizes must be near (length filter).
Each node has a signature with a bit for every bucket that one of its shingles falls into: a bit that
only one of two nodes has stands for a shingle that the other lacks, which bounds what they can share
from above (signature filter). Pairs that pass are held against each other again by signatures that
grow with the set (``FINE`` bits a shingle, folded to the smaller one's length). What is left is
verified on the whole sets. No link is lost.

Shingles that the very same nodes have in their prefixes say the same, and one of them stays. Only
components are wanted, so SimHash comes first: nodes with near fingerprints are found by multi-index hashing
(``near_duplicates``) and verified like all others. Nodes that share a prefix shingle are then held against leaders of
theirs, those they share most with, in ``ROUNDS`` rounds of a few pairs per node. All pairs are
at last formed only between nodes of different components; both signature filters are part of that join, so that
only pairs that are to be verified come out of it.

Texts are hashed where they lie and never move to be compared. Bitmaps of fixed size tell the workers
which prefix shingles more than one node has (``COMMON_BITS``), and which nodes are in a pair that is to be
verified (``WANTED_BITS``): only these entries and sets move. What falls into their bits by chance
costs some work and changes nothing.

Texts without words, null ones too, are equal to each other and to nothing else. Of documents that
share the smallest id of a group one stays, and of rows that repeat it one; if all ids of a group are null,
one of its rows stays. Very long texts are hashed whole, a batch of texts at a time. Other columns are
carried, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.llm import near_duplicates
from alertweave.llm.near_duplicates import components, first_of_each
from alertweave.llm.shared import prepare, stored
from alertweave.session import shuffles_removed

SHINGLE = 5
SIMILARITY = Fraction(4, 5)
BUCKETS = 1 << 18
# the fullest buckets, whose counts reach the driver; the others count as equally rare
FULLEST = 1 << 14
# rounds in which nodes are held against leaders, and how many a node meets in the later ones
ROUNDS = 3
LEADERS = 4
# 64-bit words of a signature, and bits per shingle of a fine one
SIGNATURE = 16
FINE = 4
WANTED_BITS = 23
COMMON_BITS = 26
# one shingle of so many is counted in all texts, more than a prefix takes
SAMPLE = 3
ENTRIES_AT_ONCE = 1 << 16
WORDS_AT_ONCE = 1 << 20
# odd numbers that tell the words of a shingle apart, and mix the sum
PLACES = np.array([(2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(1, SHINGLE + 2)], dtype=np.uint64)
SIGNS = [f"sign{k}" for k in range(SIGNATURE)]


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(31))) * PLACES[0]
    return hashes ^ (hashes >> np.uint64(29))


def shingle_sets(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The sorted hashes of each text's shingles, texts given as lower-case words; a text with fewer
    words than a shingle is one shingle, and one without words has none."""
    lookup: dict[bytes, int] = {}
    numbers = np.array([lookup.setdefault(word, len(lookup)) for text in texts for word in text], dtype=np.int64)
    known = np.array([xxhash.xxh64_intdigest(word) for word in lookup], dtype=np.uint64)
    words = known[numbers] if len(numbers) else np.zeros(0, dtype=np.uint64)
    whole = np.zeros(max(0, len(words) - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE):
        whole += words[k : k + len(whole)] * PLACES[k]
    whole = mixed(whole)
    sets, at = [], 0
    for text in texts:
        n = len(text)
        if n >= SHINGLE:
            sets.append(np.unique(whole[at : at + n - SHINGLE + 1]))
        elif n:
            # the last factor takes the number of words in
            short = (words[at : at + n] * PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n) * PLACES[SHINGLE]
            sets.append(mixed(short))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
        at += n
    return sets


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text of a column, in order."""

    def parts() -> Iterator[list[list[bytes]]]:
        held: list[list[bytes]] = []
        size = 0
        for text in texts.cast(pa.binary()):
            held.append(text.as_py().lower().split() if text.is_valid else [])
            size += len(held[-1])
            if size >= WORDS_AT_ONCE:
                yield held
                held, size = [], 0
        if held:
            yield held

    for part in parts():
        yield from shingle_sets(part)


def set_key(hashes: np.ndarray) -> int:
    """One hash for the whole set; zero for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64)) if len(hashes) else 0


def signature(hashes: np.ndarray, words: int = SIGNATURE) -> np.ndarray:
    """A bit for each bucket that a shingle falls into, in 64-bit words. Buckets of half as many words
    are the sums of a bucket and the one half the words on."""
    bits = np.zeros(words * 64, dtype=np.uint8)
    bits[(hashes >> np.uint64(20)) % np.uint64(len(bits))] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def fine_words(size: int) -> int:
    return 1 << max(0, FINE * size - 1).bit_length() >> 6 or 1


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash, print, size, simhash``, the words of the signature and the ``fine`` one, a row per document."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (set_key(one), len(one), near_duplicates.majority(one), signature(one), signature(one, fine_words(len(one))))
                for one in sets_of(batch.column(2))
            ]
            keys, sizes, near, signs, fine = zip(*found, strict=True) if found else ((), (), (), (), ())
            words = np.array(signs, dtype=np.int64).reshape(-1, SIGNATURE)
            columns = [pa.array(values, pa.int64()) for values in (keys, sizes, near)]
            columns += [pa.array(words[:, k]) for k in range(SIGNATURE)]
            columns.append(pa.array(fine, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns],
                ["doc_id", "text_hash", "print", "size", "simhash", *SIGNS, "fine"],
            )

    signs = ", ".join(f"{name} bigint" for name in SIGNS) + ", fine array<bigint>"
    return documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        read, f"doc_id {kind}, text_hash bigint, print bigint, size bigint, simhash bigint, {signs}"
    )


def bucket_counts(documents: DataFrame) -> np.ndarray:
    """How many texts' shingles fall into each of the fullest buckets; zero for the others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for one in sets_of(batch.column(0)):
                np.add.at(total, (one % np.uint64(BUCKETS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    found = documents.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, dtype=np.int64)
    with shuffles_removed(documents.sparkSession):
        for row in found.orderBy(F.desc("n"), "bucket").limit(FULLEST).collect():
            counts[row["bucket"]] = row["n"]
    return counts


def bitmap_of(values: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``2 ** bits`` bits in which those of a column's values are set."""
    (name,) = values.columns
    bit = F.pmod(name, F.lit(1 << bits))
    words = values.groupBy(F.shiftright(bit, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({name}, {1 << bits}) % 64 AS int))")).alias("bits")
    )
    with shuffles_removed(values.sparkSession):
        found = words.select("*").toArrow()
    bitmap = np.zeros((1 << bits) // 64, dtype=np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bitmap


def marked_in(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bits of 64-bit values are set."""
    at = values.astype(np.uint64) % np.uint64(64 * len(bitmap))
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.int64)) & 1 == 1


def sampled(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(8)) % np.uint64(SAMPLE) == 0


def prefix_entries(documents: DataFrame, counts: np.ndarray, common: np.ndarray | None = None) -> DataFrame:
    """``shingle, node`` of all shingles that can be in a prefix; with the bitmap of ``common`` ones, of
    the common ones in the prefix, and ``own_share``, how many thousandths of the prefix are others. Texts with equal
    sets may repeat them."""
    shared = documents.sparkSession.sparkContext.broadcast((counts, common))
    marked = common is not None
    names = ["shingle", "node"] + ["own_share"] * marked

    def chosen(hashes: np.ndarray, known: np.ndarray, marks: np.ndarray | None) -> tuple[np.ndarray, int]:
        size = len(hashes)
        length = size - -(-SIMILARITY.numerator * size // SIMILARITY.denominator) + 1
        often = known[(hashes % np.uint64(BUCKETS)).astype(np.int64)]
        later = ~sampled(hashes)
        if marks is None:
            # whichever of the sampled ones turn out to be common, the prefix is among these
            return hashes[np.lexsort((hashes, often, later))[: max(length, size - int(later.sum()))]], 0
        told = marked_in(marks, hashes)
        first = hashes[np.lexsort((hashes, often, told & ~later, later))[:length]]
        kept = first[marked_in(marks, first)]
        return kept, 1000 - 1000 * len(kept) // length

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marks = shared.value
        held: list[tuple[np.ndarray, int, int]] = []
        n_held = 0

        def rows() -> pa.RecordBatch:
            sizes = [len(first) for first, _, _ in held]
            columns = [pa.array(np.concatenate([first for first, _, _ in held]))]
            columns.append(pa.array(np.repeat([node for _, node, _ in held], sizes), pa.int64()))
            if marked:
                columns.append(pa.array(np.repeat([share for _, _, share in held], sizes), pa.int16()))
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            done: set[int] = set()
            for hashes in sets_of(batch.column(0)):
                node = set_key(hashes)
                if not len(hashes) or node in done:
                    continue
                done.add(node)
                first, share = chosen(hashes, known, marks)
                held.append((first.astype(np.int64), node, share))
                n_held += len(held[-1][0])
                if n_held >= ENTRIES_AT_ONCE:
                    yield rows()
                    held, n_held = [], 0
        if n_held:
            yield rows()

    kind = "shingle bigint, node bigint" + ", own_share smallint" * marked
    return documents.select("text").mapInArrow(entries, kind)


def enough(common: Column, left: Column, right: Column) -> Column:
    """Whether sets of these sizes with so many common shingles are similar."""
    most = SIMILARITY.numerator + SIMILARITY.denominator
    return common * most >= (left + right) * SIMILARITY.numerator


def may_link(own: str, other: str) -> Column:
    """Length and signature filter of two structs with ``size`` and the signature."""
    lacks = lambda a, b: reduce(
        Column.__add__, [F.bit_count(F.col(f"{a}.{s}").bitwiseAND(F.bitwise_not(F.col(f"{b}.{s}")))) for s in SIGNS]
    )
    sizes = F.col(f"{own}.size"), F.col(f"{other}.size")
    return enough(F.least(*sizes), *sizes) & enough(
        F.least(sizes[0] - lacks(own, other), sizes[1] - lacks(other, own)), *sizes
    )


def may_link_finely(own: str, other: str) -> Column:
    """Whether the fine signatures of two structs leave room for a link."""

    def folded(bits: Column, words: Column) -> Column:
        halves = F.transform(F.slice(bits, 1, words), lambda word, at: word.bitwiseOR(F.get(bits, at + words)))
        return F.when(F.size(bits) == words, bits).when(F.size(bits) == 2 * words, halves)

    def lacks(one: Column, other: Column) -> Column:
        missing = F.zip_with(one, other, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b))))
        return F.aggregate(missing, F.lit(0), lambda total, bits: total + bits)

    fine = F.col(f"{own}.fine"), F.col(f"{other}.fine")
    sizes = F.col(f"{own}.size"), F.col(f"{other}.size")
    words = F.least(F.size(fine[0]), F.size(fine[1]))
    a, b = folded(fine[0], words), folded(fine[1], words)
    most = F.least(sizes[0] - lacks(a, b), sizes[1] - lacks(b, a))
    # sets whose sizes pass the length filter have fine signatures of one length or of half the other's
    return ~F.coalesce(~enough(most, *sizes), F.lit(False))


def ordered_pair(own: str, other: str) -> list[Column]:
    """``low, high, low_size, high_size`` of two structs."""
    nodes = [F.struct(F.col(f"{side}.node"), F.col(f"{side}.size")) for side in (own, other)]
    low, high = F.least(*nodes), F.greatest(*nodes)
    return [low["node"].alias("low"), high["node"].alias("high"), low["size"].alias("low_size"), high["size"].alias("high_size")]


def whole_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``print, hashes`` of the wanted ``print``s, each read from its own document ``doc_id, text_hash``."""
    row = F.xxhash64("doc_id", "text_hash")
    asked_rows = wanted.select(row.alias("row"))
    shared = documents.sparkSession.sparkContext.broadcast(bitmap_of(asked_rows, WANTED_BITS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            rows = batch.column(0).to_numpy()
            here = np.flatnonzero(marked_in(asked, rows))
            if len(here):
                sets = [one.astype(np.int64) for one in sets_of(batch.column(1).take(pa.array(here)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[here]), pa.array(sets, pa.list_(pa.int64()))], ["row", "hashes"]
                )

    found = (
        documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        .select(row.alias("row"), "text")
        .mapInArrow(read, "row bigint, hashes array<bigint>")
    )
    # rows that repeat a document give their set once
    return found.join(wanted.select(row.alias("row"), "print"), "row").groupBy("print").agg(F.first("hashes").alias("hashes"))


def verified(pairs: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs ``low, high, low_size, high_size`` those that are similar, as ``low, high``."""
    asked = pairs.select(F.explode(F.array("low", "high")).alias("node")).distinct()
    wanted = stored(nodes.select("node", "doc_id", "text_hash").join(asked, "node").withColumnRenamed("node", "print"), "shingle-wanted")
    whole = stored(whole_sets(documents, wanted), "shingle-sets")
    common = F.size(F.array_intersect("low_hashes", "high_hashes"))
    return stored(
        pairs.join(whole.select(F.col("print").alias("low"), F.col("hashes").alias("low_hashes")), "low")
        .join(whole.select(F.col("print").alias("high"), F.col("hashes").alias("high_hashes")), "high")
        .filter(enough(common, F.col("low_size"), F.col("high_size")))
        .select("low", "high"),
        "shingle-links",
    )


def open_entries(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries ``shingle, node, own_share, root`` of the shingles whose nodes are not all of one component yet."""
    rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return stored(rooted.join(several(rooted, "root"), "shingle"), "shingle-open")


def several(entries: DataFrame, name: str) -> DataFrame:
    """The shingles with more than one value of a column."""
    ends = entries.groupBy("shingle").agg(F.min(name).alias("least"), F.max(name).alias("most"))
    return ends.filter(F.col("least") < F.col("most")).select("shingle")


def one_per_group(entries: DataFrame) -> DataFrame:
    """The distinct ``shingle, node`` entries of one shingle of all that the very same nodes have: a
    passage that some texts share gives one group and not one for each of its shingles. Groups are told apart by 128 bits."""
    held = [F.bit_xor(F.xxhash64(F.lit(seed), "node")) for seed in (1, 2)]
    groups = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), held[0].alias("first"), held[1].alias("second"))
    kept = groups.groupBy("n", "first", "second").agg(F.min("shingle").alias("shingle")).select("shingle")
    return stored(entries.join(kept, "shingle"), "shingle-shared")


def about(nodes: DataFrame, out: str, *more: str) -> DataFrame:
    return nodes.select(F.col("node").alias(f"{out}_node"), F.struct("node", "size", *SIGNS, *more).alias(out))


def alike(pairs: DataFrame, nodes: DataFrame, own: str, other: str) -> DataFrame:
    """Of pairs of nodes, in columns ``own``_node and ``other``_node, those that pass the filters, as structs.
    Fine signatures move only to pairs that pass the first filter."""
    told = pairs.join(about(nodes, own), f"{own}_node").join(about(nodes, other), f"{other}_node")
    near = told.filter(may_link(own, other)).drop(own, other)
    told = near.join(about(nodes, own, "fine"), f"{own}_node").join(about(nodes, other, "fine"), f"{other}_node")
    return told.filter(may_link_finely(own, other))


def near_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes with near fingerprints: each node with the first one of its fingerprint, and first ones of linked fingerprints."""
    first = nodes.groupBy(F.col("simhash").alias("print")).agg(F.min("node").alias("first_node"))
    firsts = stored(first, "shingle-firsts")
    equal = nodes.join(firsts, nodes["simhash"] == firsts["print"]).filter(F.col("node") != F.col("first_node"))
    linked = near_duplicates.links(firsts.select("print"))
    low = firsts.select(F.col("print").alias("low"), F.col("first_node").alias("own_node"))
    high = firsts.select(F.col("print").alias("high"), F.col("first_node").alias("other_node"))
    pairs = equal.select(F.col("node").alias("own_node"), F.col("first_node").alias("other_node")).union(
        linked.join(low, "low").join(high, "high").select("own_node", "other_node")
    )
    return stored(alike(pairs, nodes, "own", "other").select(*ordered_pair("own", "other")), "shingle-pairs")


def leader_pairs(entries: DataFrame, nodes: DataFrame, order: int) -> DataFrame:
    """For each node pairs with those leaders of its shingles that it shares most with: one in the first round, ``LEADERS`` later.
    A shingle's leader is the node with least of its own: of near copies, the one that most of them come from. Of equal
    ones it is drawn, anew in each round and for each of ``LEADERS`` parts of the shingles."""
    drawn = F.xxhash64(F.lit(order), F.pmod("shingle", F.lit(LEADERS)), "node")
    rank = F.struct(F.col("own_share"), drawn, F.col("node"))
    leaders = entries.groupBy("shingle").agg(F.min_by(F.struct("node", "root"), rank).alias("leader"))
    met = (
        entries.join(leaders, "shingle")
        .filter(F.col("root") != F.col("leader.root"))
        .groupBy(F.col("node").alias("own_node"), F.col("leader.node").alias("leader_node"))
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    near = alike(met, nodes, "own", "leader").select("own_node", "leader_node", "shared", *ordered_pair("own", "leader"))
    # a node has at most as many leaders as shingles in its prefix
    told = F.struct("shared", "leader_node", F.struct("low", "high", "low_size", "high_size").alias("pair"))
    most = F.slice(F.sort_array(F.collect_list(told), asc=False), 1, LEADERS if order else 1)
    return stored(
        near.groupBy("own_node").agg(most.alias("most")).select(F.explode("most.pair").alias("pair")).select("pair.*").distinct(),
        "shingle-pairs",
    )


def all_pairs(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs of different components that share a prefix shingle and pass the filters."""
    own = entries.select("shingle", "root", F.col("node").alias("own_node")).join(about(nodes, "own", "fine"), "own_node").select("shingle", "root", "own")
    other = own.select(F.col("shingle").alias("other_shingle"), F.col("root").alias("other_root"), F.col("own").alias("other"))
    apart = (F.col("own.node") < F.col("other.node")) & (F.col("root") != F.col("other_root"))
    met = apart & may_link("own", "other") & may_link_finely("own", "other")
    near = own.join(other, (F.col("shingle") == F.col("other_shingle")) & met).select(*ordered_pair("own", "other")).distinct()
    return stored(near, "shingle-pairs")


def links(documents: DataFrame, marked: DataFrame) -> DataFrame:
    """Links ``low < high`` whose components are those of all similar pairs of the ``marked`` prints."""
    counts = bucket_counts(documents)
    common = stored(several(prefix_entries(documents, counts), "node"), "shingle-common")
    again = prefix_entries(documents, counts, bitmap_of(common, COMMON_BITS))
    shared = one_per_group(stored(again.join(common, "shingle").distinct(), "shingle-entries"))
    told = F.struct("doc_id", "text_hash", "size", "simhash", *SIGNS, "fine")
    nodes = (
        marked.withColumnRenamed("print", "node")
        .join(shared.select("node").distinct(), "node")
        .groupBy("node")
        .agg(F.min_by(told, F.struct("doc_id", "text_hash")).alias("told"))
        .select("node", "told.*")
    )
    nodes = stored(nodes, "shingle-nodes")
    found = verified(near_pairs(nodes), documents, nodes)
    roots = components(found)
    for order in range(ROUNDS + 1):
        entries = open_entries(shared, roots)
        pairs = leader_pairs(entries, nodes, order) if order < ROUNDS else all_pairs(entries, nodes)
        new = verified(pairs, documents, nodes)
        found = found.union(new)
        roots = components(found) if order < ROUNDS else None
    return found


def one_of_each(documents: DataFrame) -> DataFrame:
    """The document with the smallest ``doc_id`` of each group of similar texts, with the columns it came with."""
    prepare(documents.sparkSession)
    fingers = stored(fingerprints(documents), "shingle-prints")
    marked = fingers.select("doc_id", "text_hash", "print")
    prints = marked.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(documents, fingers))
    rooted = stored(
        prints.join(roots.withColumnRenamed("node", "print"), "print", "left").select(
            "print", "first_id", F.coalesce("root", "print").alias("root")
        ),
        "shingle-roots",
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = stored(rooted.join(least, "root").select("print", "root", "component_id"), "shingle-groups")
    return first_of_each(documents, marked, groups)
