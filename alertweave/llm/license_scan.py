"""License scan: base phrases, and an exact set-similarity join of text blocks with templates.

A template is a license notice of ``m`` words, and a block a window of ``REACH * m`` consecutive words
of a text; line ends and comment signs are no words, so a wrapped notice is in one block, and words far
apart are not. Both are sets of words. A block meets a template if it holds at least ``threshold`` of the
template's words. Words are ordered by how often they occur in all texts, rarest first. A template of ``n``
different words of which ``need`` must be held has one of its first ``n - need + 1`` in every block that
meets it: only these words, where they stand in a text, are joined on (prefix filter). With such a word as a
block's rarest, the words around it must hold ``need`` of the template's words from its place in the order on:
fewer words (length filter) or too many of them rarer (positional filter) drop the pair. What is left is
verified block by block. No block that meets a template is lost, whatever the text's length.

Only DataFrame operations are used. Long texts are cut into overlapping pieces of ``PIECE`` words, so a row stays
small. The word counts that reach the driver are those of the templates' own words, so their number is fixed, and
so is the index that is joined on: a row for each template and prefix word. Label rows come back to the documents
by id and text hash, one row for each pair.

A null text counts as empty. Repeated rows get equal results; rows with a null id are told apart by
their text. An empty table gives an empty result. Other columns are not used.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertweave.functions.expressions import let
from alertweave.llm.shared import UPPER, lower_ascii

THRESHOLD = 0.9
# words of a block for each word of the template
REACH = 1.25
# words of a long text in one row
PIECE = 4096
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# notices by label, in the licenses' own words
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("all-rights-reserved", "All rights reserved."),
]


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(WORD, text.lower())))


def block_words(text: str) -> int:
    """Words of a block for this template."""
    return math.ceil(REACH * len(re.findall(WORD, text.lower())))


def spaced(text: Column) -> Column:
    """The words of a text with a blank on either side of each: cheap to search for whole words."""
    other = "".join(chr(point) for point in range(0x80) if not re.match(WORD, chr(point)) and chr(point) not in UPPER)
    return F.concat(F.lit(" "), F.translate(text, UPPER + other, UPPER.lower() + " " * len(other)), F.lit(" "))


def word_frequencies(documents: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each template word occurs in all texts."""
    counts = (
        documents.select(
            F.explode(
                F.filter(F.split(lower_ascii(F.col("text")), BETWEEN), lambda word: word.isin(vocabulary))
            ).alias("word")
        )
        .groupBy("word")
        .count()
        .collect()
    )
    return {row["word"]: row["count"] for row in counts}


INDEX = "prefix_word string, template int, label string, need int, reach int, wanted array<string>, later array<string>"


def template_index(templates: list[tuple[str, str]], threshold: float, rank: dict[str, int]) -> list[tuple]:
    """An ``INDEX`` row for each template and word of its prefix: ``later`` holds the template's words from
    this one on in the order of rarity."""
    rows = []
    for at, (label, text) in enumerate(templates):
        ordered = sorted(template_words(text), key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
        for position, word in enumerate(ordered[: len(ordered) - need + 1]):
            rows.append((word, at, label, need, block_words(text), ordered, ordered[position:]))
    return rows


def may_meet(text: Column, rows: list[tuple]) -> Column:
    """Whether the text as a whole holds a prefix word and ``need`` words of one template, which is so
    if one of its blocks does. Most texts do not, and are searched but not cut into words."""
    prefixes: dict[tuple, list[str]] = {}
    for word, _, _, need, _, wanted, _ in rows:
        prefixes.setdefault((need, tuple(wanted)), []).append(word)
    whole = lambda words: F.array(*[F.lit(f" {word} ") for word in words])

    def held(words: Column) -> Column:
        met = F.lit(False)
        for (need, wanted), prefix in prefixes.items():
            some = F.exists(whole(prefix), lambda word: F.contains(words, word))
            met = met | (some & (F.size(F.filter(whole(wanted), lambda word: F.contains(words, word))) >= need))
        return met

    return let(spaced(text), held)


def prefix_hits(documents: DataFrame, vocabulary: list[str], rows: list[tuple], widest: int) -> DataFrame:
    """``doc_id, text_hash, word_no, prefix_word, around``: every place of a prefix word, in texts that may
    meet a template, with the ``widest - 1`` words on either side; words of no template are empty there."""
    edge = widest - 1
    pad = F.array_repeat(F.lit(""), edge)
    prefix = sorted({row[0] for row in rows})
    words = F.filter(F.split(spaced(F.col("text")), " "), lambda word: word != "")
    known = F.transform(words, lambda word: F.when(word.isin(vocabulary), word).otherwise(F.lit("")))

    def pieces(padded: Column) -> Column:
        # n words have n + 2 * edge entries; a piece overlaps its neighbours by an edge on either side
        starts = F.sequence(F.lit(0), F.floor((F.size(padded) - 2 * edge - 1) / PIECE).cast("int"))
        return F.transform(
            starts,
            lambda at: F.struct((at * PIECE).alias("base"), F.slice(padded, at * PIECE + 1, PIECE + 2 * edge).alias("part")),
        )

    def hits(base: Column, part: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(1), F.size(part) - 2 * edge), lambda at: F.get(part, at + (edge - 1)).isin(prefix)
        )
        return F.transform(
            places,
            lambda at: F.struct(
                (base + at - 1).alias("word_no"),
                F.get(part, at + (edge - 1)).alias("prefix_word"),
                F.slice(part, at, 2 * edge + 1).alias("around"),
            ),
        )

    return (
        documents.filter(may_meet(F.col("text"), rows))
        .select(
            "doc_id",
            F.xxhash64("text").alias("text_hash"),
            F.explode(let(F.concat(pad, known, pad), pieces)).alias("piece"),
        )
        .select("doc_id", "text_hash", F.explode(hits(F.col("piece.base"), F.col("piece.part"))).alias("hit"))
        .select("doc_id", "text_hash", "hit.*")
    )


def license_labels(
    documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, text_hash, labels, containment, blocks`` of the texts with a block that meets a template.
    ``blocks`` names, for each template met, its label and the first word (from 0) of the first of its
    best blocks, which begins with a word of the template."""
    vocabulary = sorted({word for _, text in templates for word in template_words(text)})
    counts = word_frequencies(documents, vocabulary)
    rank = {word: at for at, word in enumerate(sorted(vocabulary, key=lambda word: (counts.get(word, 0), word)))}
    rows = template_index(templates, threshold, rank)
    index = documents.sparkSession.createDataFrame(rows, INDEX)
    widest = max(block_words(text) for _, text in templates)
    reach, start = F.col("reach"), F.lit(widest) - F.col("reach") + 1

    def verified(near: Column) -> Column:
        """The most words that a block around the hit holds, and minus the first such block's offset."""
        blocks = F.filter(
            F.sequence(F.lit(1), reach), lambda at: F.array_contains(F.col("wanted"), F.get(near, at - 1))
        )
        return F.array_max(
            F.transform(
                blocks,
                lambda at: F.struct(
                    F.size(F.array_intersect(F.slice(near, at, reach), F.col("wanted"))).alias("held"),
                    (reach - at - F.col("word_no")).alias("before"),
                ),
            )
        )

    met = (
        prefix_hits(documents, vocabulary, rows, widest)
        # a fixed number of rows: the templates' prefix words
        .join(F.broadcast(index), "prefix_word")
        .withColumn("near", F.slice("around", start, 2 * reach - 1))
        .filter(F.size(F.array_intersect("near", "later")) >= F.col("need"))
        .withColumn("best", verified(F.col("near")))
        .filter(F.col("best.held") >= F.col("need"))
        .groupBy("doc_id", "text_hash", "template", "label", F.size("wanted").alias("of"))
        .agg(F.max("best").alias("best"))
    )
    return met.groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("labels"),
        F.max(F.col("best.held") / F.col("of")).alias("containment"),
        F.sort_array(F.collect_list(F.struct((-F.col("best.before")).cast("long").alias("word_no"), "label"))).alias("blocks"),
    )


def phrase_places(words: Column) -> Column:
    """``start, label`` of every place where a phrase's words stand consecutively."""

    def places(phrase: str, label: str) -> Column:
        parts = phrase.split(" ")

        def here(at: Column) -> Column:
            matches = [F.get(words, at + k) == part for k, part in enumerate(parts)]
            together = matches[0]
            for match in matches[1:]:
                together = together & match
            return F.coalesce(together, F.lit(False))

        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
        return F.transform(starts, lambda at: F.struct(at.cast("long").alias("start"), F.lit(label).alias("label")))

    return F.concat(*[places(phrase, label) for phrase, label in PHRASES.items()])


def license_scan(documents: DataFrame, **settings) -> DataFrame:
    """A row per document: places of base phrases, base labels, all labels and a score, which is 1
    with a base label and else the largest share of a template that a block holds."""
    lower = F.coalesce(lower_ascii(F.col("text")), F.lit(""))
    none = F.array().cast(
        T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("label", T.StringType())]))
    )
    based = documents.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.regexp_count(lower, F.lit(WORD)).cast("long").alias("n_words"),
        # a phrase ends in this word, and most texts do not hold it
        F.when(F.contains(lower, F.lit("license")), let(F.regexp_extract_all(lower, F.lit(WORD), 0), phrase_places))
        .otherwise(none)
        .alias("places"),
    )
    found = license_labels(documents, **settings).select(
        F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "labels", "containment", "blocks"
    )
    base = F.array_distinct(F.transform("places", lambda place: place["label"]))
    joined = based.join(
        found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left"
    ).withColumn("base", base)
    starts = F.transform("places", lambda place: place["start"])
    every = F.array_union("base", F.coalesce("labels", F.array().cast("array<string>")))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(every), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
        F.coalesce("blocks", F.array()).alias("blocks"),
    )
