"""Benchmark decontamination: Wu-Manber multi-pattern search of item windows in documents.

A window is ``WINDOW`` consecutive words of an item (an item of fewer words is one window). Texts are
brought to one form, words in lower case with single blanks around them, so a window is a byte string
that starts and ends with a blank and can only match whole words.

The search works on blocks of ``BLOCK`` bytes. For every block a shift table holds how far the search
may go on, as no pattern can end its first ``least`` bytes sooner. Where the shift is zero, the block
ends some pattern's first ``least`` bytes: a bucket of the suffix's hash names these patterns, the
first bytes rule most of them out, and a direct comparison of all bytes confirms the rest. Short
patterns would make all shifts short, so patterns are searched in classes of similar length. Many
places of a batch of texts advance at once as lanes, which changes no shift.

The windows are read by Spark and dealt into parts of at most about ``PART_BYTES``; documents are
searched for one part after the other, so neither the driver nor a worker ever holds more windows than
that. With one part nothing is shuffled but the windows. Hits of further parts are narrow rows,
combined per document by its id and text hash.

A null or wordless text has no words and no hits; a null or wordless item no windows. Items without an
id hit words but are not listed. Rows with one ``item_id`` are one item. Repeated documents get equal
rows, rows with a null ``doc_id`` are told apart by their text. Other columns are not read. Without
items or documents the result is without hits or empty. Texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.llm.shared import prepare, stored
from alertweave.session import cut_lineage

WINDOW = 10
BLOCK = 8
# windows that are searched for at once, in bytes of their text
PART_BYTES = 8 << 20
# pattern lengths at which a class of patterns starts
CLASSES = (0, 12, 24, 48, 96)
SHIFT_BITS = 20
# text that one lane goes through, and texts that are searched at once
LANE = 2048
BYTES_AT_ONCE = 4 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPANS = "array<struct<first_word bigint, last_word bigint>>"
# A-Z in lower case, all else below 0x80 that is no letter or digit as a blank
CLEAR = bytes(code if code >= 0x80 or chr(code).isalnum() else 0x20 for code in range(256)).lower()


def cleared(texts: pa.Array) -> Iterator[bytes]:
    """The words of each text in lower case with one blank between them; empty for null."""
    for text in texts.cast(pa.binary()):
        raw = text.as_buffer() if text.is_valid else None
        yield b" ".join(raw.to_pybytes().translate(CLEAR).split()) if raw is not None else b""


def pieces(texts: Iterable[bytes], most: int = BYTES_AT_ONCE) -> Iterator[list[bytes]]:
    """Runs of texts that are not much longer together than a bound, or one longer text."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def merged(ranges: Iterable[tuple[int, int]]) -> list[dict[str, int]]:
    """Ranges of words, both ends included, that overlap or touch as one, in order."""
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(last, out[-1][1])
        else:
            out.append([first, last])
    return [{"first_word": first, "last_word": last} for first, last in out]


class PatternClass:
    """Shift table and suffix buckets of patterns of similar length."""

    def __init__(self, patterns: list[tuple[int, bytes]]) -> None:
        patterns = sorted(patterns, key=lambda pattern: pattern[1])
        self.numbers = [number for number, _ in patterns]
        self.patterns = [pattern for _, pattern in patterns]
        self.least = min(map(len, self.patterns))
        self.block = min(BLOCK, self.least)
        heads = np.frombuffer(b"".join(p[: self.least] for p in self.patterns), dtype=np.uint8)
        heads = np.concatenate((heads, np.zeros(BLOCK, dtype=np.uint8)))
        starts = np.arange(len(self.patterns)) * self.least
        furthest = self.least - self.block + 1
        self.shifts = np.full(1 << SHIFT_BITS, min(furthest, 65535), dtype=np.uint16)
        for at in range(self.least - self.block + 1):
            left = min(self.least - self.block - at, 65535)
            np.minimum.at(self.shifts, self.hashes(heads, starts + at), np.uint16(left))
        suffixes = self.hashes(heads, starts + self.least - self.block)
        order = np.argsort(suffixes, kind="stable")
        self.suffixes, self.order = suffixes[order], order
        self.prefixes = self.blocks(heads, starts)

    def blocks(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The block of bytes from each place on, as a number; ``text`` has ``BLOCK`` bytes to spare."""
        every = np.ndarray((len(text) - 7,), dtype="<u8", buffer=text, strides=(1,))
        found = every[at]
        return found if self.block == 8 else found & np.uint64((1 << (8 * self.block)) - 1)

    def hashes(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((self.blocks(text, at) * MULTIPLIER) >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)

    def suspects(self, text: np.ndarray, size: int) -> np.ndarray:
        """Starts of the places where the shift is zero, in the first ``size`` bytes."""
        last = size - self.least
        if last < 0:
            return np.zeros(0, dtype=np.int64)
        at = np.arange(0, last + 1, LANE, dtype=np.int64)
        ends = np.minimum(at + LANE, last + 1)
        tail = self.least - self.block
        found = []
        while len(at):
            shift = self.shifts[self.hashes(text, at + tail)]
            here = shift == 0
            if here.any():
                found.append(at[here])
            at = at + np.maximum(shift, 1)
            going = at < ends
            if not going.all():
                at, ends = at[going], ends[going]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)

    def occurrences(self, joined: bytes, text: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(first byte, last byte + 1, pattern number)`` of every occurrence; ``text`` holds the same
        bytes and ``BLOCK`` more."""
        starts = self.suspects(text, len(joined))
        if not len(starts):
            return
        keys = self.hashes(text, starts + self.least - self.block)
        low, high = np.searchsorted(self.suffixes, keys), np.searchsorted(self.suffixes, keys, side="right")
        # a bucket can be long: pairs of a place and a pattern are made for some places at a time
        ahead = np.cumsum(high - low)
        cut = 0
        while cut < len(starts):
            done = int(ahead[cut - 1]) if cut else 0
            until = max(cut + 1, int(np.searchsorted(ahead, done + (1 << 20))))
            many = (high - low)[cut:until]
            place = np.repeat(np.arange(cut, until), many)
            nth = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
            pattern = self.order[low[place] + nth]
            same = self.blocks(text, starts[place]) == self.prefixes[pattern]
            for start, number in zip(starts[place[same]].tolist(), pattern[same].tolist(), strict=True):
                wanted = self.patterns[number]
                if joined.startswith(wanted, start):
                    yield start, start + len(wanted), self.numbers[number]
            cut = until


class Windows:
    """All windows of a part, and the items each of them belongs to."""

    def __init__(self, windows: list[bytes], items: list[list[int | str]], item_kind: str = "bigint") -> None:
        self.items, self.item_kind = items, item_kind
        self.item_type = pa.string() if item_kind == "string" else pa.int64()
        classes: dict[int, list[tuple[int, bytes]]] = {}
        for number, window in enumerate(windows):
            pattern = b" " + window + b" "
            classes.setdefault(int(np.searchsorted(CLASSES, len(pattern), side="right")), []).append((number, pattern))
        self.classes = [PatternClass(patterns) for _, patterns in sorted(classes.items())]

    def search(self, texts: list[bytes]) -> dict[int, tuple[list[tuple[int, int]], set[int | str]]]:
        """Word ranges of all occurrences and the items that occur, by number of the text."""
        joined = b"\0".join(b" " + text + b" " for text in texts)
        buffer = np.frombuffer(joined + bytes(BLOCK), dtype=np.uint8)
        places = [place for one in self.classes for place in one.occurrences(joined, buffer)]
        if not places:
            return {}
        starts, ends, numbers = np.array(places).T
        offsets = np.cumsum([0] + [len(text) + 3 for text in texts[:-1]])
        own = np.searchsorted(offsets, starts, side="right") - 1
        # the blank before a text's word k is its blank k
        blanks = np.flatnonzero(buffer == 0x20)
        before = np.searchsorted(blanks, offsets[own])
        first, last = np.searchsorted(blanks, starts) - before, np.searchsorted(blanks, ends - 1) - before - 1
        hits: dict[int, tuple[list[tuple[int, int]], set[int | str]]] = {}
        for text, at, to, number in zip(own.tolist(), first.tolist(), last.tolist(), numbers.tolist(), strict=True):
            ranges, items = hits.setdefault(text, ([], set()))
            ranges.append((at, to))
            items.update(self.items[number])
        return hits


def item_kind(benchmark: DataFrame) -> str:
    return "string" if benchmark.schema["item_id"].dataType.simpleString() == "string" else "bigint"


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct ``window`` strings with the ids of their ``items``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), cleared(batch.column(1)), strict=True):
                words = text.split()
                width = min(window, len(words))
                own = {b" ".join(words[at : at + width]) for at in range(len(words) - width + 1)} if words else set()
                ids += [item] * len(own)
                found += sorted(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema[0].type), pa.array(found, pa.binary())], ["item", "window"])

    kind = item_kind(benchmark)
    return (
        benchmark.select(F.col("item_id").cast(kind).alias("item"), "text")
        .mapInArrow(cut, f"item {kind}, window binary")
        .groupBy("window")
        # items that share a window: at most the items of the benchmark
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def scan(documents: DataFrame, windows: Windows) -> DataFrame:
    """``doc_id, text_hash, n_words, spans, items`` of each row: merged word ranges that are hit, and
    the items that occur."""
    shared = documents.sparkSession.sparkContext.broadcast(windows)
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64())]))
    names = ["doc_id", "text_hash", "n_words", "spans", "items"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in pieces(cleared(batch.column(2))):
                hits = shared.value.search(texts)
                none: tuple[list, set] = ([], set())
                found = [hits.get(k, none) for k in range(len(texts))]
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    batch.column(1).slice(at, len(texts)),
                    pa.array([text.count(b" ") + 1 if text else 0 for text in texts], pa.int64()),
                    pa.array([merged(ranges) for ranges, _ in found], span),
                    pa.array([sorted(items) for _, items in found], pa.list_(shared.value.item_type)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(texts)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        search, f"doc_id {kind}, text_hash bigint, n_words bigint, spans {SPANS}, items array<{windows.item_kind}>"
    )


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES
) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, n_hit, items`` with the word ranges inside any
    occurrence of a window, how many words they hold, and the sorted ids of the items that occur."""
    prepare(documents.sparkSession)
    windows = stored(item_windows(benchmark, window), "benchmark-windows")
    size = windows.agg(F.sum(F.length("window") + 8 * F.size("items"))).first()[0] or 0
    n_parts = -(-size // part_bytes) or 1

    def part(at: int) -> Windows:
        rows = windows.filter(F.pmod(F.xxhash64("window"), F.lit(n_parts)) == at).collect()
        return Windows([bytes(row["window"]) for row in rows], [list(row["items"]) for row in rows], item_kind(benchmark))

    found = scan(documents, part(0))
    if n_parts > 1:
        more = stored(scan(documents, part(1)).filter(F.size("spans") > 0).drop("n_words"), "benchmark-hits")
        for at in range(2, n_parts):
            next_hits = scan(documents, part(at)).filter(F.size("spans") > 0).drop("n_words")
            more = more.union(stored(next_hits, "benchmark-hits"))
        added = (
            more.groupBy("doc_id", "text_hash")
            .agg(F.flatten(F.collect_set("spans")).alias("more_spans"), F.flatten(F.collect_set("items")).alias("more_items"))
            .select(F.col("doc_id").alias("more_id"), F.col("text_hash").alias("more_hash"), "more_spans", "more_items")
        )
        joined = cut_lineage(
            found.join(
                added, F.col("doc_id").eqNullSafe(F.col("more_id")) & F.col("text_hash").eqNullSafe(F.col("more_hash")), "left"
            )
        )
        found = joined.select(
            "doc_id",
            "n_words",
            F.pandas_udf(
                lambda rows: rows.map(lambda row: merged((r["first_word"], r["last_word"]) for r in row)), SPANS
            )(F.concat("spans", F.coalesce("more_spans", F.array()))).alias("spans"),
            F.array_sort(F.array_union("items", F.coalesce("more_items", F.array()))).alias("items"),
        )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["last_word"] - span["first_word"] + 1)
    return found.select("doc_id", "n_words", "spans", n_hit.alias("n_hit"), "items")
