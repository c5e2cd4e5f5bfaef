import math
import re
from collections import Counter

from pyspark.sql import functions as F

from alertweave.llm import license_scan as ls

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_hand(text):
    words = re.findall(WORD, lower(text))
    starts, base = [], set()
    for phrase, label in ls.PHRASES.items():
        parts = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        starts += here
        base |= {label} if here else set()
    labels, best, blocks = set(base), 0.0, []
    for label, notice in ls.TEMPLATES:
        sequence = re.findall(WORD, lower(notice))
        wanted, reach = set(sequence), math.ceil(ls.REACH * len(sequence))
        held, first = max(((len(wanted & set(words[i : i + reach])), -i) for i in range(len(words)) if words[i] in wanted), default=(0, 0))
        if held >= math.ceil(ls.THRESHOLD * len(wanted) - 1e-9):
            labels.add(label)
            best = max(best, held / len(wanted))
            blocks.append((-first, label))
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if starts else best, tuple(sorted(blocks))


NEAR = [
    "this work licensed under the gnu general public license version 3 it is",
    "work licensed under the gnu general public license version",
    "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated files",
    "MIT License MIT license the Apache-License; General\nPublic License",
    "rights reserved, all of them. All rights, not reserved by all",
    "licensed under cc by nc 4\n0",
    "Redistribution and use in source or binary forms, with or without modification, are permitted",
    # wrapped, and behind comment signs
    " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided",
    "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated\ndocumentation files",
    "subject to the terms of the Mozilla Public\r\nLicense, v. 2.0. This Source Code Form is",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
    # words far apart, in any order, repeated, at both ends
    "kept all the books and rights to them; seats were reserved",
    "reserved rights all",
    "all all rights rights reserved reserved",
    "x " * 9000 + "All rights\nreserved.",
    "All rights reserved." + " y" * 9000,
    "all rights reserved " * 3000,
    "reserved " * 20000,
    # across the border of two pieces
    *["x " * (ls.PIECE - k) + "licensed under cc by\nsa 4.0 " + "z " * 50 for k in range(12)],
    None,
    "",
    " \n ",
]
WRAPPED = {"bsd": 7, "isc": 8, "mit": 9, "mpl": 11}


def flat(row):
    return (*row[:-1], tuple(tuple(block) for block in row[-1]))


def test_all_documents_against_every_window_and_template(spark, documents, no_documents):
    more = spark.createDataFrame([(9100 + k, text) for k, text in enumerate(NEAR)] * 2, "doc_id bigint, text string")
    rows = documents.select("doc_id", "text", "words", "size").unionByName(more, allowMissingColumns=True)
    got = ls.license_scan(rows).collect()
    want = Counter((r.doc_id, *by_hand(r.text)) for r in rows.select("doc_id", "text").collect())
    assert Counter(map(flat, got)) == want
    assert ls.license_scan(no_documents).count() == 0


def test_wrapped_notices_are_found_and_scattered_words_are_not(spark):
    rows = spark.createDataFrame(list(enumerate(NEAR)), "doc_id bigint, text string")
    labels = {row.doc_id: row.labels.split(",") for row in ls.license_scan(rows).collect()}
    for label, at in WRAPPED.items():
        assert label in labels[at], label
    assert labels[12] == [""]


def test_blocks_name_the_first_word(spark):
    rows = spark.createDataFrame([(1, "x\nReleased under the MIT License.\nAll rights reserved.")], "doc_id bigint, text string")
    (row,) = ls.license_scan(rows).select(F.col("blocks")).collect()
    assert [tuple(block) for block in row.blocks] == [(1, "mit"), (6, "all-rights-reserved")]


def test_null_ids_and_rows_of_one_text(spark):
    rows = spark.createDataFrame([(None, "All rights reserved"), (None, "no"), (3, "All rights reserved"), (3, "no")], "doc_id bigint, text string")
    got = Counter((row.doc_id, row.labels) for row in ls.license_scan(rows).collect())
    assert got == Counter([(None, "all-rights-reserved"), (None, ""), (3, "all-rights-reserved"), (3, "")])
