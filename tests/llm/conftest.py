"""Awkward rows that every operator must survive."""

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names that operators use inside
CLASHES = ("row", "size", "shard", "print", "order", "length", "bucket", "key", "kept", "stratum", "words", "measures")

LONG = " ".join(f"wort{i % 977} und so{i % 13}." for i in range(12_000))
ODD = [
    (9001, None, "en", "src0", None),
    (9002, "", "en", "src0", 0),
    (9003, " \n\t ", None, None, 4),
    (9004, "one", "de", None, 3),
    (9005, "Twice the same text, Twice the same text.\n\nTwice the same text.", "en", "alone", 60),
    (9005, "Twice the same text, Twice the same text.\n\nTwice the same text.", "en", "alone", 60),
    (None, "Released under the MIT License.\nA text without an id.", None, "src1", 50),
    (None, None, None, None, None),
    (9006, LONG, "de", "ünïcode", len(LONG)),
    (9007, "été über ñandú   x　y 中文 текст 😀 100% <b>", "fr", "", 30),
    (9008, "licensed under CC BY-NC 4.0. All rights\nreserved. general public license", "xx", "src2", 70),
]


def clashing(frame):
    return frame.withColumns({name: F.lit(f"extra {name}") for name in CLASHES})


@pytest.fixture(scope="session")
def odd_documents(spark):
    return clashing(spark.createDataFrame(ODD, SCHEMA)).repartition(3)


@pytest.fixture(scope="session")
def real_documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def documents(spark, odd_documents, real_documents):
    return clashing(real_documents).unionByName(odd_documents).repartition(4).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return clashing(spark.createDataFrame([], SCHEMA))


@pytest.fixture(scope="session")
def labels(spark):
    known = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality", "toxic")
    extra = [(9001, None, 1), (None, 1, 0), (9005, 1, 0), (9005, 0, None), (424242, 1, 1)]
    return known.unionByName(spark.createDataFrame(extra, known.schema))


@pytest.fixture(scope="session")
def no_labels(labels):
    return labels.limit(0)
