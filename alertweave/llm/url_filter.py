"""URL filter: rules first, then naive Bayes over the words of hosts and paths.

A rule decides the pages of its host and subdomains whose path begins with the rule's; the longest
one wins. The other pages are judged by a multinomial naive Bayes model fitted on all pages that a
rule decides. Its tokens are words: a host label of run-together words is segmented by Viterbi over
unigram word probabilities, with word counts taken from the text of all pages; so a site is known by
its words, also where its name is new. Path pieces are segmented alike, and numbers stand for their
number of digits.

The dictionary is a table of all words of the pages and never leaves Spark: the distinct pieces of
urls are cut into their substrings of up to ``LONGEST_WORD`` letters, the words among them are found
by a join, and a piece is segmented once with just its own words, however many urls hold it. A word
is a run of letters of any script in lower case, of at most ``LONGEST_WORD`` letters; longer runs are no words, and
no segment is longer. Tokens are hashed to ``1 << TOKEN_BITS`` buckets, so what the driver gets and tasks share has a
fixed bound. Odds are whole multiples of ``1 / SCALE``, so their sums agree in every order.

A null url, and one without ``://``, has an empty host and path and is judged by the classes' shares
alone; so is any url if no rule decides a page (then it is allowed). Repeated rows are judged alike.
Null pages give no words. A very long url or name costs time and rows in proportion to its length.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.llm.shared import UPPER, prepare, stored

TOKEN_BITS = 16
SMOOTHING = 1.0
LONGEST_WORD = 24
SCALE = 1 << 32
LETTERS = r"[\p{L}\p{M}]+"
PIECE = rf"{LETTERS}|[0-9]+"
# starts of substrings that a task holds at once
_STARTS_AT_ONCE = 4096
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda one: len(one[0] + one[1])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame) -> DataFrame:
    """``word, count``: all words in the visible text of all pages."""
    text = F.regexp_replace(F.lower("html"), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(LETTERS), 0)).alias("word"))
    return words.filter(F.length("word") <= LONGEST_WORD).groupBy("word").count()


class Segmenter:
    """Splits a name of run-together words into the most probable words."""

    def __init__(self, counts: dict[str, int], total: int) -> None:
        self.total = total or 1
        self.cost = {word: math.log(self.total) - math.log(count) for word, count in counts.items()}

    def unknown(self, size: int) -> float:
        """An unseen word gets less than one occurrence, and much less with every letter."""
        return math.log(self.total) + math.log(10.0) * size

    def split(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - LONGEST_WORD), end):
                word = name[start:end]
                cost = self.cost.get(word)
                options.append((best[start] + (self.unknown(len(word)) if cost is None else cost), start))
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


def places_of(host: Column, path: Column) -> Column:
    """``ARRAY<STRUCT<place, piece>>``: the top-level name, and runs of letters or digits of the other
    host labels and the path, in lower case."""
    labels = F.split(F.lower(host), r"\.")
    names = F.array_join(F.slice(labels, F.lit(1), F.size(labels) - 1), ".")

    def at(place: str, pieces: Column) -> Column:
        return F.transform(pieces, lambda piece: F.struct(F.lit(place).alias("place"), piece.alias("piece")))

    return F.concat(
        at("top", F.when(host != "", F.slice(labels, -1, 1)).otherwise(F.array().cast("array<string>"))),
        at("host", F.regexp_extract_all(names, F.lit(PIECE), 0)),
        at("path", F.regexp_extract_all(F.lower(path), F.lit(PIECE), 0)),
    )


def _substrings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for key, piece in zip(batch["key"], batch["piece"], strict=True):
            for first in range(0, len(piece), _STARTS_AT_ONCE):
                found = {
                    piece[start : start + size]
                    for start in range(first, min(first + _STARTS_AT_ONCE, len(piece)))
                    for size in range(1, min(LONGEST_WORD, len(piece) - start) + 1)
                }
                yield pd.DataFrame({"key": key, "word": sorted(found)})


def segments(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """``piece, words`` of distinct ``piece`` rows of letters. Each is cut with the words it holds,
    found by a join; words that very many pieces hold are split by the adaptive skew join."""
    total = words.agg(F.sum("count")).first()[0] or 0
    keyed = pieces.select("piece", F.md5(F.col("piece").cast("binary")).alias("key"))
    held = (
        keyed.mapInPandas(_substrings, "key string, word string")
        .join(words, "word")
        .groupBy("key")
        .agg(F.collect_list("word").alias("known"), F.collect_list("count").alias("counts"))
    )

    @F.pandas_udf("array<string>")
    def split(names: pd.Series, known: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series(
            [
                Segmenter({} if some is None else dict(zip(some, of, strict=True)), total).split(name)
                for name, some, of in zip(names, known, counts, strict=True)
            ],
            dtype="object",
        )

    return keyed.join(held, "key", "left").select("piece", split("piece", "known", "counts").alias("words"))


def bucket(token: Column) -> Column:
    return F.shiftright(F.crc32(token.cast("binary")), 32 - TOKEN_BITS).cast("int")


def fit(parts: DataFrame, urls: DataFrame) -> tuple[int, np.ndarray]:
    """Log odds of block against allow, of the classes and of each bucket, in parts of ``SCALE``.

    ``parts``: ``ruled, n, buckets`` of what the urls that rules decide hold; ``urls``: ``ruled, n``.
    """
    counted = (
        parts.filter("ruled is not null")
        .select((F.col("ruled") == "block").cast("int").alias("kind"), F.explode("buckets").alias("bucket"), "n")
        .groupBy("kind", "bucket")
        .agg(F.sum("n").alias("n"))
    ).toPandas()
    tokens = np.zeros((2, 1 << TOKEN_BITS))
    tokens[counted["kind"].to_numpy(dtype=int), counted["bucket"].to_numpy(dtype=int)] = counted["n"].to_numpy()
    of_class = {row["ruled"]: row["n"] for row in urls.filter("ruled is not null").groupBy("ruled").agg(F.sum("n").alias("n")).collect()}
    if not of_class:
        return -SCALE, np.zeros(1 << TOKEN_BITS, dtype=np.int64)
    used = max(1, int((tokens.sum(axis=0) > 0).sum()))
    likely = np.log((tokens + SMOOTHING) / (tokens.sum(axis=1, keepdims=True) + SMOOTHING * (used + 1)))
    prior = math.log(of_class.get("block", 0) + SMOOTHING) - math.log(of_class.get("allow", 0) + SMOOTHING)
    return round(prior * SCALE), np.rint((likely[1] - likely[0]) * SCALE).astype(np.int64)


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_odds`` for every page; odds only without a rule."""
    spark = pages.sparkSession
    prepare(spark)
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    placed = (
        pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .withColumn("rule", rule)
        .withColumn("ruled", ruled)
    )
    # a host holds no slash and a path starts with one or is empty, so both together name the url
    url = F.md5(F.concat("host", "path").cast("binary"))
    urls = stored(placed.groupBy("host", "path", "ruled").agg(F.count(F.lit(1)).alias("n")), "op6-urls")
    held = urls.select(
        url.alias("url_key"), "ruled", "n", F.inline(places_of(F.col("host"), F.col("path")))
    )
    pieces = stored(held.groupBy("place", "piece", "ruled").agg(F.sum("n").alias("n")), "op6-pieces")
    digits = F.col("piece").rlike("^[0-9]+$")
    letters = pieces.filter((F.col("place") != "top") & ~digits).select("piece").distinct()
    cut = segments(letters, stored(word_counts(pages), "op6-words"))
    words = (
        F.when(F.col("place") == "top", F.array("piece"))
        .when(digits, F.array(F.concat(F.lit("#"), F.length("piece"))))
        .otherwise(F.col("words"))
    )
    tokens = F.transform(words, lambda word: bucket(F.concat("place", F.lit(" "), word)))
    parts = stored(
        pieces.join(cut, "piece", "left").select("place", "piece", "ruled", "n", tokens.alias("buckets")), "op6-parts"
    )
    prior, odds = fit(parts, urls)
    shared = spark.sparkContext.broadcast(odds)

    @F.pandas_udf("long")
    def odds_of(buckets: pd.Series) -> pd.Series:
        return pd.Series([int(shared.value[at].sum()) for at in buckets], dtype="int64")

    open_parts = parts.filter("ruled is null").select("place", "piece", odds_of("buckets").alias("odds"))
    judged = (
        held.filter("ruled is null")
        .join(open_parts, ["place", "piece"])
        .groupBy("url_key")
        .agg(F.sum("odds").alias("odds"))
    )
    block_odds = F.when(F.col("ruled").isNull(), (F.coalesce("odds", F.lit(0)) + F.lit(prior)) / F.lit(float(SCALE)))
    return (
        placed.withColumn("url_key", url)
        .join(judged, "url_key", "left")
        .withColumn("block_odds", block_odds)
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("ruled", F.when(F.col("block_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
            "block_odds",
        )
    )
