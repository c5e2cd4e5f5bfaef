"""Language identification of mixed text: script ranges, word scores, and Viterbi over the words.

A word's letters give hashed letter trigrams, and each language's smoothed trigram frequencies give
the word a score. The script of a word's first letter narrows the languages to those that use this
script in the training texts. Viterbi then labels all words of a text at once: staying in a language
is free and switching costs ``SWITCH`` nats, so short stretches of look-alike words do not break a
span, and a real change of language does. A text's language is the one with most letters.

The model is fitted on about ``FIT_DOCUMENTS`` texts of each language, drawn by a hash of the id; its
size depends on the number of buckets and languages only. Prediction reads the text alone, the whole
of it, and runs over all texts of a batch in step, so its memory follows the batch.

A null text, and one without a letter, is ``und`` with score 0. Rows with a null ``doc_id`` are judged
but not learned from. Repeated rows get equal results. Empty tables give empty results, and without
any training text all is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_DOCUMENTS = 5000
BUCKET_BITS = 16
SMOOTHING = 0.1
SWITCH = 12.0
# a language uses a script if so many of its letters are of it
SCRIPT_SHARE = 0.01
SEED = 2
UNKNOWN = "und"
BATCH_CHARS = 1 << 21
# first code points of script ranges, and the script from there on (fixed values of the standard)
SCRIPT_RANGES = [
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0900, "Devanagari"),
    (0x0980, "Bengali"),
    (0x0A00, "Other"),
    (0x0E00, "Thai"),
    (0x0E80, "Other"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Other"),
    (0x1C80, "Cyrillic"),
    (0x1C90, "Georgian"),
    (0x1CC0, "Other"),
    (0x1D00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x2C60, "Latin"),
    (0x2C80, "Other"),
    (0x3040, "Kana"),
    (0x3100, "Han"),
    (0x3130, "Hangul"),
    (0x3190, "Han"),
    (0xA000, "Other"),
    (0xA720, "Latin"),
    (0xA800, "Other"),
    (0xAC00, "Hangul"),
    (0xD7FC, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Other"),
    (0x20000, "Han"),
    (0x32000, "Other"),
]
SCRIPTS = sorted({script for _, script in SCRIPT_RANGES})


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    return np.fromiter((chr(point).isalpha() for point in range(0x110000)), dtype=bool, count=0x110000)


class Words:
    """The words (runs of letters) of some texts: where they start, and their trigram buckets."""

    def __init__(self, texts: list[str | None]) -> None:
        lowered = [(text or "").lower() for text in texts]
        sizes = np.array([len(text) + 1 for text in lowered], dtype=np.int64)
        joined = "\0".join([*lowered, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = is_letter()[points]
        at = np.flatnonzero(letter)
        masked = np.where(letter, points, 0).astype(np.uint64)
        before = np.concatenate((masked[:1] * 0, masked[:-1]))[at]
        after = np.concatenate((masked[1:], masked[:1] * 0))[at]
        mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (masked[at] * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (after * np.uint64(0x165667B19E3779F9))) * np.uint64(0xD6E8FEB86659FD93)
        self.buckets = (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        #: position among all letters where each word starts
        self.starts = np.flatnonzero(before == 0)
        self.letters = np.diff(np.append(self.starts, len(at)))
        edges = np.array([start for start, _ in SCRIPT_RANGES])
        numbers = np.array([SCRIPTS.index(script) for _, script in SCRIPT_RANGES])
        first = points[at[self.starts]].astype(np.int64)
        self.scripts = numbers[np.searchsorted(edges, first, side="right") - 1]
        texts_end = np.cumsum(sizes)
        of_text = np.searchsorted(texts_end, at[self.starts], side="right")
        self.per_text = np.bincount(of_text, minlength=len(texts))


def batches_of(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Cuts a list of texts so that a piece holds a bounded number of characters or one text."""
    start, held = 0, 0
    for at, text in enumerate(texts):
        size = len(text) if text else 0
        if held and held + size > BATCH_CHARS:
            yield texts[start:at]
            start, held = at, 0
        held += size + 1
    if start < len(texts):
        yield texts[start:]


class LanguageModel:
    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        """``counts``: languages x buckets; ``scripts``: letters of languages x scripts."""
        self.languages = languages
        smooth = counts + SMOOTHING
        self.scores = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        usual = (share >= SCRIPT_SHARE).T
        # a script no language was seen in narrows nothing
        self.allowed = usual | ~usual.any(axis=1, keepdims=True)

    def word_scores(self, words: Words) -> np.ndarray:
        scores = np.add.reduceat(self.scores[words.buckets], words.starts, axis=0)
        return np.where(self.allowed[words.scripts], scores, scores - np.float32(1e6))

    def label(self, scores: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Viterbi labels of all words, for all texts in step; ``scores`` holds text after text."""
        first = np.cumsum(per_text) - per_text
        order = np.argsort(-per_text, kind="stable")
        order = order[per_text[order] > 0]
        first, sizes = first[order], per_text[order]
        if not len(order):
            return np.zeros(0, dtype=np.int64)
        longest = int(sizes[0])
        # how many texts still have a word at each step
        active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
        came = np.empty(scores.shape, dtype=np.uint16)
        own = np.arange(scores.shape[1], dtype=np.uint16)
        state = scores[first].astype(np.float64)
        for step in range(1, longest):
            n = active[step]
            held = state[:n]
            best = held.argmax(axis=1)
            jump = (held[np.arange(n), best] - SWITCH)[:, None]
            at = first[:n] + step
            came[at] = np.where(jump > held, best[:, None], own)
            state[:n] = np.maximum(held, jump) + scores[at]
        labels = np.empty(len(scores), dtype=np.int64)
        now = state.argmax(axis=1)
        for step in range(longest - 1, -1, -1):
            n = active[step]
            at = first[:n] + step
            labels[at] = now[:n]
            if step:
                now[:n] = came[at, now[:n]]
        return labels

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]]]:
        """Language, score and spans ``(first word, last word, language)`` of each text."""
        scored, letters, per_text = [], [], []
        for piece in batches_of(texts):
            words = Words(piece)
            per_text.append(words.per_text)
            if len(words.starts):
                scored.append(self.word_scores(words))
                letters.append(words.letters)
        sizes = np.concatenate(per_text) if per_text else np.zeros(0, dtype=np.int64)
        n_languages = len(self.languages)
        if not scored or not n_languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        labels = self.label(np.concatenate(scored), sizes)
        weight = np.bincount(
            np.repeat(np.arange(len(texts)), sizes) * n_languages + labels,
            weights=np.concatenate(letters),
            minlength=len(texts) * n_languages,
        ).reshape(len(texts), n_languages)
        best = weight.argmax(axis=1)
        whole = weight.sum(axis=1)
        score = np.divide(weight.max(axis=1), whole, out=np.zeros(len(texts)), where=whole > 0)
        starts = np.cumsum(sizes) - sizes
        changes = np.flatnonzero(np.diff(labels, prepend=-1)).tolist()
        spans: list[list[tuple[int, int, str]]] = []
        for at, size in zip(starts.tolist(), sizes.tolist(), strict=True):
            own: list[tuple[int, int, str]] = []
            if size:
                low, high = np.searchsorted(changes, [at + 1, at + size]) if len(changes) > 1 else (0, 0)
                cuts = [at, *[c for c in changes[low:high] if at < c < at + size], at + size]
                own = [
                    (a - at, b - at - 1, self.languages[labels[a]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)
                ]
            spans.append(own)
        names = [self.languages[k] if n else UNKNOWN for k, n in zip(best, sizes, strict=True)]
        return names, score.tolist(), spans


def fit(documents: DataFrame, learnable: Column, fit_documents: int = FIT_DOCUMENTS) -> LanguageModel:
    """The model of the ``lang`` values in rows for which ``learnable`` holds."""
    rows = documents.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {row["lang"]: row["count"] for row in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, fit_documents / sizes[name]))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = (1 << BUCKET_BITS) + len(SCRIPTS)
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, group in batch.groupby("lang"):
                total = totals.setdefault(name, np.zeros(size, dtype=np.int64))
                for piece in batches_of(group["text"].tolist()):
                    words = Words(piece)
                    total += np.bincount(words.buckets, minlength=size)
                    total += np.bincount(
                        words.scripts + (1 << BUCKET_BITS), weights=words.letters, minlength=size
                    ).astype(np.int64)
        for name, total in totals.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"lang": name, "bucket": used, "n": total[used]})

    counted = (
        rows.filter(drawn)
        .select("lang", "text")
        .mapInPandas(count, "lang string, bucket bigint, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    table = np.zeros((len(languages), (1 << BUCKET_BITS) + len(SCRIPTS)))
    if len(counted):
        known = np.array([languages.index(name) for name in counted["lang"]])
        table[known, counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return LanguageModel(languages, table[:, : 1 << BUCKET_BITS], table[:, 1 << BUCKET_BITS :])


def identify(documents: DataFrame, model: LanguageModel, *carried: Column | str) -> DataFrame:
    """Adds ``lang_pred, score, spans`` to the carried columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judge(texts: pd.Series) -> pd.DataFrame:
        names, scores, spans = shared.value.judge(texts.tolist())
        return pd.DataFrame(
            {
                "lang_pred": names,
                "score": scores,
                "spans": [[{"first_word": a, "last_word": b, "lang": name} for a, b, name in own] for own in spans],
            }
        )

    judged = F.pandas_udf(
        judge, "lang_pred string, score double, spans array<struct<first_word int, last_word int, lang string>>"
    )
    return documents.select(*carried, judged(F.col("text")).alias("judged")).select(
        *documents.select(*carried).columns, "judged.*"
    )


def held_out() -> Column:
    """The rows whose id is kept from learning; rows without an id are neither."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(F.pmod(number, F.lit(4)) == 2, F.lit(False))


def language_id(documents: DataFrame, **settings) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans`` with the model fitted on the other rows."""
    model = fit(documents, F.col("doc_id").isNotNull() & ~held_out(), **settings)
    return identify(documents, model, "doc_id", held_out().alias("held_out"))
