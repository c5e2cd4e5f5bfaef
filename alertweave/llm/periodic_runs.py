"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives.

A run is a stretch of consecutive words whose smallest period is ``q`` (words ``q`` apart are equal),
at least ``max(least, 2 q)`` words long, that no neighbouring word extends with the same period. Every
word of a run occurs in it twice or more. So a word that occurs once in its segment is in no run: it
splits the segment, which makes other words too rare in the parts, and so on until nothing changes.
Segments shorter than ``least`` go too. In most texts little survives.

The surviving segments are scanned by lag. Lags below ``2 * BLOCK`` are compared at every place. A run
of a longer period ``q`` in ``[2 b, 4 b)`` repeats one of the blocks of ``b`` words that start at
multiples of ``b`` just ``q`` words on; equal blocks have equal numbers, made by doubling from those of
half the length, so only lags at which a whole block returns are scanned, and from there the stretch
grows both ways by blocks of halving length. For ``n`` words that survive this takes about
``n log n`` steps, whatever they repeat. Of the periods found for one stretch the smallest counts.

Texts are judged whole and alone, many of them at once in arrays; neither shuffles anything. A null or
wordless text has no runs and an empty rest. Repeated rows and rows with null ids are judged like any
others; other columns are carried only if asked for. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.functions.expressions import let
from alertweave.llm.shared import prepare

LEAST = 12
# words of a block that must return for a lag to be scanned; all lags below twice as many are
BLOCK = 8
# words whose texts are judged at once, and levels of splitting over all of them together
WORDS_AT_ONCE = 1 << 20
LEVELS_AT_ONCE = 32
RUNS = "array<struct<start bigint, length bigint, period bigint>>"


def neighbours_alike(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the places before and behind it with the same word, -1 and ``len`` for none."""
    order = np.argsort(words, kind="stable")
    same = words[order[1:]] == words[order[:-1]]
    before, behind = np.full(len(words), -1), np.full(len(words), len(words))
    before[order[1:][same]] = order[:-1][same]
    behind[order[:-1][same]] = order[1:][same]
    return before, behind


def split_by_frequency(words: np.ndarray, starts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Which places survive: those of segments in which every word occurs twice or more and that are
    at least ``least`` long. ``starts`` are the first places of texts."""
    n = len(words)
    before, behind = neighbours_alike(words)
    low = np.repeat(starts, np.diff(np.append(starts, n)))
    high = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    places = np.arange(n)
    for _ in range(LEVELS_AT_ONCE):
        gone = (before[places] < low) & (behind[places] >= high)
        gone |= high - low < least
        if not gone.any():
            break
        # what stays, cut where a place is missing or a segment began
        stay = ~gone
        places, low, high = places[stay], low[stay], high[stay]
        if not len(places):
            break
        first = np.concatenate(([True], (np.diff(places) > 1) | (low[1:] != low[:-1])))
        at = np.flatnonzero(first)
        sizes = np.diff(np.append(at, len(places)))
        low = np.repeat(places[at], sizes)
        high = low + np.repeat(sizes, sizes)
    alive = np.zeros(n, dtype=bool)
    alive[places] = True
    if len(places):
        gone = (before[places] < low) & (behind[places] >= high)
        if gone.any() or (high - low < least).any():
            split_one_by_one(places, low, high, places[gone], before, behind, alive, least)
    return alive


def split_one_by_one(
    places: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    gone: np.ndarray,
    before: np.ndarray,
    behind: np.ndarray,
    alive: np.ndarray,
    least: int,
) -> None:
    """Goes on splitting, a place at a time. A split looks only through its smaller part, for words
    whose like is now on the other side, so the whole takes ``n log n`` steps however deep it goes."""
    owner = np.full(len(alive) + 1, -1)  # segment of each place; the last entry stands for no place
    owner[places] = low
    begins, first = np.unique(low, return_index=True)
    segments = dict(zip(begins.tolist(), zip(begins.tolist(), high[first].tolist(), strict=True), strict=True))
    for name, (start, end) in list(segments.items()):
        if end - start < least:
            owner[start:end] = -1
            del segments[name]
    fresh = len(alive)
    todo = gone.tolist()
    while todo:
        cut = todo.pop()
        name = int(owner[cut])
        if name < 0:
            continue
        start, end = segments.pop(name)
        owner[cut] = -1
        small, large = sorted(((start, cut), (cut + 1, end)), key=lambda part: part[1] - part[0])
        for (first_place, behind_last), label in ((small, fresh), (large, name)):
            if behind_last - first_place < least:
                owner[first_place:behind_last] = -1
            else:
                segments[label] = (first_place, behind_last)
                if label == fresh:
                    owner[first_place:behind_last] = fresh
        fresh += 1
        own = np.arange(*small)
        near = np.unique(np.concatenate((own, before[own], behind[own])))
        near = near[(near >= 0) & (near < len(alive))]
        near = near[owner[near] >= 0]
        alone = (owner[before[near]] != owner[near]) & (owner[behind[near]] != owner[near])
        todo += near[alone].tolist()
    alive[:] = owner[:-1] >= 0


def stretches(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of consecutive numbers in ascending ``places``."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(places) > 1))) if len(places) else np.zeros(0, dtype=np.int64)
    return places[first], np.diff(np.append(first, len(places)))


def block_numbers(words: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... words: a number for each place whose block of that many words occurs twice or
    more, equal for equal blocks, and -1 for the others and behind the end."""
    levels = []
    numbers = words
    places = np.arange(len(words))
    length = 1
    while len(places):
        _, inverse, times = np.unique(numbers, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        level = np.full(len(words) + 1, -1)
        level[places[again]] = inverse[again]
        levels.append(level)
        places = places[again]
        behind = level[np.minimum(places + length, len(words))]
        places, behind = places[behind >= 0], behind[behind >= 0]
        numbers = level[places] * (len(words) + 1) + behind
        length *= 2
    return levels


def grown(levels: list[np.ndarray], at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words are equal before the places ``at`` and ``to``, and from them on."""
    end = len(levels[0]) - 1
    left, right = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    for level, numbers in reversed(list(enumerate(levels))):
        length = 1 << level
        own, other = numbers[np.maximum(at - left - length, -1)], numbers[np.maximum(to - left - length, -1)]
        left += np.where((own >= 0) & (own == other), length, 0)
        own, other = numbers[np.minimum(at + right, end)], numbers[np.minimum(to + right, end)]
        right += np.where((own >= 0) & (own == other), length, 0)
    return left, right


def lag_scan(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows ``start, length, period`` of all runs, by start and period, in words between which segments
    are set apart by numbers that occur once."""
    found = []
    for lag in range(1, min(2 * BLOCK, len(words))):
        start, length = stretches(np.flatnonzero(words[:-lag] == words[lag:]))
        long = length >= max(least - lag, lag)
        found.append(np.stack((start[long], length[long] + lag, np.full(long.sum(), lag))))
    levels = block_numbers(words)
    n = len(words)
    for level in range(BLOCK.bit_length() - 1, len(levels)):
        length = 1 << level
        places = np.flatnonzero(levels[level][:n] >= 0)
        keys = np.sort(levels[level][places] * n + places)
        at = places[places % length == 0]
        base = levels[level][at] * n
        low = np.searchsorted(keys, base + np.minimum(at + 2 * length, n))
        many = np.searchsorted(keys, base + np.minimum(at + 4 * length, n)) - low
        own = np.repeat(at, many)
        to = keys[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)] % n
        # a lag that the block before has too leads to the same stretch
        code = (to - own) * n + own
        first = ~np.isin(code - length, code) | (own < length)
        own, to = own[first], to[first]
        left, right = grown(levels, own, to)
        lag = to - own
        long = left + right >= np.maximum(least - lag, lag)
        found.append(np.stack(((own - left)[long], (left + right + lag)[long], lag[long])))
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
    order = np.lexsort((period, length, start))
    runs = np.stack((start, length, period), axis=1)[order]
    if len(runs):
        runs = runs[np.concatenate(([True], (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)))]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """The runs ``start, length, period`` of each text, given as its words."""
    lookup: dict[bytes, int] = {}
    words = np.array([lookup.setdefault(word, len(lookup)) for text in texts for word in text], dtype=np.int64)
    sizes = np.array([len(text) for text in texts])
    texts_at = np.cumsum(sizes) - sizes
    none = np.zeros((0, 3), dtype=np.int64)
    if not len(words):
        return [none] * len(texts)
    alive = split_by_frequency(words, texts_at[sizes > 0], least)
    places = np.flatnonzero(alive)
    # segments are set apart; none reaches over the end of a text
    parted = np.diff(places) > 1
    begins = np.zeros(len(words) + 1, dtype=bool)
    begins[texts_at] = True
    parted |= begins[places[1:]]
    segment = np.concatenate(([0], np.cumsum(parted))) if len(places) else places
    spread = np.full(len(places) + int(segment[-1] if len(places) else 0), -1)
    spread[np.arange(len(places)) + segment] = words[places]
    apart = np.flatnonzero(spread < 0)
    spread[apart] = len(lookup) + np.arange(len(apart))
    place = np.zeros(len(spread), dtype=np.int64)
    place[np.arange(len(places)) + segment] = places
    runs = lag_scan(spread, least) if len(spread) else none
    start = place[runs[:, 0]]
    # empty texts begin where the next one does: the last that begins here has the words
    own = np.searchsorted(texts_at, start, side="right") - 1
    found = np.stack((start - texts_at[own], runs[:, 1], runs[:, 2]), axis=1)
    cuts = np.searchsorted(own, np.arange(len(texts) + 1))
    return [found[cuts[k] : cuts[k + 1]] for k in range(len(texts))]


def dropped(n_words: int, runs: np.ndarray) -> np.ndarray:
    """Words inside a run but behind its first period."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def pieces(texts: Iterable[list[bytes]], most: int = WORDS_AT_ONCE) -> Iterator[list[list[bytes]]]:
    """Runs of texts that have not many more words together than a bound, or one longer text."""
    held: list[list[bytes]] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def periodic_runs(documents: DataFrame, *carried: str, least: int = LEAST) -> DataFrame:
    """The carried columns, ``n_words``, the ``runs`` by start and period, and the ``collapsed`` text:
    the words that are not dropped, with one blank between them."""
    prepare(documents.sparkSession)
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in documents.select(*carried).schema)
    run = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def words_of(texts: pa.Array) -> Iterator[list[bytes]]:
        for text in texts.cast(pa.binary()):
            yield text.as_py().split() if text.is_valid else []

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in pieces(words_of(batch.column(batch.num_columns - 1))):
                found = runs_of(texts, least)
                rest = []
                for words, runs in zip(texts, found, strict=True):
                    if len(runs):
                        gone = dropped(len(words), runs).tolist()
                        words = [word for word, out in zip(words, gone, strict=True) if not out]
                    rest.append(b" ".join(words))
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()] for runs in found]
                columns = [batch.column(k).slice(at, len(texts)) for k in range(batch.num_columns - 1)]
                columns += [pa.array(map(len, texts), pa.int64()), pa.array(rows, run), pa.array(rest, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*carried, "n_words", "runs", "collapsed"])
                at += len(texts)

    return documents.select(*carried, "text").mapInArrow(
        judge, f"{schema}, n_words bigint, runs {RUNS}, collapsed string"
    )


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """Texts in which the ids choose a place from which on the words repeat, for a tenth of the rows
    with an id: by ``h``, the crc32 of the id, words from ``h / 10 % n`` on repeat the first of them."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    step = F.floor(number / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != "")

    def repeated(own: Column) -> Column:
        n = F.size(own).cast("long")
        first = step % n
        period = 1 + F.floor((n - first) / (3 + step % 8))
        at = lambda i: F.when(i < first, i).otherwise(first + (i - first) % period)
        text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(own, at(i).cast("int"))), " ")
        return F.when(n > 0, text).otherwise(F.lit(""))

    planted = F.coalesce(number % 10 == 0, F.lit(False)) & F.col("text").isNotNull()
    return documents.withColumn("text", F.when(planted, let(words, repeated)).otherwise(F.col("text")))


def run_digests(documents: DataFrame) -> DataFrame:
    """A row per document: ``n_runs``, the longest run and digests of all runs and of the collapsed text."""
    found = periodic_runs(documents, "doc_id")
    longest = F.reduce(
        "runs", F.get("runs", F.lit(0)), lambda best, run: F.when(run["length"] > best["length"], run).otherwise(best)
    )
    lines = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    return found.select("*", longest.alias("longest")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        F.col("longest.length").alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(1000 * F.col("longest.length") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
