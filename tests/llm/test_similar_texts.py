import random
import re
from collections import defaultdict

import numpy as np

import corpus_pipeline
from alertweave.llm import near_duplicates
from alertweave.llm import similar_texts as st
from pyspark.sql import functions as F


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def groups_by_pairs(rows):
    """Smallest id of each component over the Jaccard similarity of all pairs."""
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    def ascii_lower(text):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")

    sets = [shingles(ascii_lower(text)) for _, text in rows]
    for i in range(len(rows)):
        for j in range(i):
            common, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * common >= 4 * either:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        least[root(k)].append(doc_id)
    return sorted((min((x for x in found if x is not None), default=None) for found in least.values()), key=repr)


def edited_texts():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    passage = rng.choices(words, k=40)
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice((6, 30, 90, 200))) + passage
        texts.append(base)
        for edits in (0, 1, 2, 3, 5, 8):
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(edits, len(copy))):
                copy[at] = rng.choice(words)
            texts.append(copy)
        # a chain whose ends are not similar
        for _ in range(5):
            base = base[4:] + rng.choices(words, k=4)
            texts.append(base)
    # 9 of 10 and 8 of 10 shingles: on either side of and at the bound
    line = [f"x{k}" for k in range(13)]
    texts += [line, line[:-1], line[:-2], ["a", "b"], ["A", "b"], ["a", "c"], [], []]
    rows = [(k, " ".join(text)) for k, text in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def test_stage_against_all_pairs(spark):
    rows = edited_texts()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, frame, "")
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == groups_by_pairs(rows)


def test_copies_and_no_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, text) for k in range(30)] + [(30, None), (31, " ")]
    kept = st.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 30]
    assert st.one_of_each(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_awkward_rows(documents, no_documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    kept = st.one_of_each(documents)
    assert kept.columns == documents.columns
    found = kept.collect()
    assert sorted((r.doc_id for r in found), key=repr) == groups_by_pairs(rows)
    assert {(r.doc_id, r.text) for r in found} <= set(rows)
    assert st.one_of_each(no_documents).count() == 0


def test_many_near_copies_of_one_text(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(500)]
    base = rng.choices(words, k=120)
    texts = []
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(len(copy)), rng.randint(0, 5)):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted((r.doc_id for r in st.one_of_each(frame).collect()), key=repr) == groups_by_pairs(rows)


def test_signatures_never_undercount():
    rng = random.Random(10)
    for _ in range(200):
        a = [b"%d" % rng.randrange(60) for _ in range(rng.randint(1, 90))]
        b = a[: rng.randint(0, len(a))] + [b"%d" % rng.randrange(60) for _ in range(rng.randint(0, 30))]
        one, other = st.shingle_sets([a, b])
        common = len(np.intersect1d(one, other))
        first, second = st.signature(one), st.signature(other)
        lacks = lambda x, y: sum(int(v).bit_count() for v in (x & ~y).view("<u8"))
        assert common <= min(len(one) - lacks(first, second), len(other) - lacks(second, first))


def test_near_fingerprints_are_paired_first(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(900)]
    texts = []
    for _ in range(30):
        base = rng.choices(words, k=400)
        texts.append(base)
        for _ in range(5):
            copy = list(base)
            copy[rng.randrange(400)] = rng.choice(words)
            texts.append(copy)
    rows = [(k, " ".join(text)) for k, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    nodes = st.fingerprints(frame).withColumnRenamed("print", "node").cache()
    sets = {st.set_key(one): one for one in st.shingle_sets([text.lower().encode().split() for _, text in rows])}
    prints = {node: near_duplicates.majority(one) for node, one in sets.items()}
    assert {r.node: r.simhash for r in nodes.collect()} == prints
    first = {}
    for node in sorted(prints):
        first.setdefault(prints[node], node)
    near = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= near_duplicates.RADIUS
    want = {tuple(sorted((first[p], node))) for node, p in prints.items() if first[p] != node}
    want |= {tuple(sorted((first[a], first[b]))) for a in first for b in first if a < b and near(a, b)}
    alike = lambda a, b: 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))
    got = {(r.low, r.high) for r in st.near_pairs(nodes).collect()}
    assert got <= want and {pair for pair in want if alike(*pair)} <= got and len(got) > 30


def test_long_texts_that_fill_their_signatures_are_told_apart(spark):
    rng = random.Random(13)
    one, other = ([f"w{rng.randrange(9000)}" for _ in range(4000)] for _ in range(2))
    copy = one[:3900] + other[:100]
    rows = [(k, " ".join(text)) for k, text in enumerate((one, other, copy))]
    nodes = st.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"))
    told = nodes.select("doc_id", F.struct(F.col("print").alias("node"), "size", *st.SIGNS, "fine").alias("own"))
    pairs = told.join(told.select(F.col("doc_id").alias("other_id"), F.col("own").alias("other")), F.col("doc_id") < F.col("other_id"))
    found = {
        (r.doc_id, r.other_id): (r.coarse, r.fine)
        for r in pairs.select(
            "doc_id", "other_id", st.may_link("own", "other").alias("coarse"), st.may_link_finely("own", "other").alias("fine")
        ).collect()
    }
    assert found == {(0, 1): (True, False), (0, 2): (True, True), (1, 2): (True, False)}


def test_near_copies_meet_the_text_that_they_come_from(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(140)]
    texts = [" ".join(base)]
    for copy in range(60):
        words = list(base)
        # each copy is near the base, and most are not near each other
        for at in rng.sample(range(8, 132, 4), 3):
            words[at] = f"x{copy}y{at}"
        texts.append(" ".join(words))
    sets = [(st.set_key(one), one) for one in st.shingle_sets([[w.encode() for w in text.split()] for text in texts])]
    nodes = spark.createDataFrame(
        [(key, k, k, len(one), *st.signature(one).tolist(), st.signature(one, st.fine_words(len(one))).tolist()) for k, (key, one) in enumerate(sets)],
        "node bigint, doc_id bigint, text_hash bigint, size bigint, " + ", ".join(f"{s} bigint" for s in st.SIGNS) + ", fine array<bigint>",
    )
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    counts = st.bucket_counts(documents)
    common = st.several(st.prefix_entries(documents, counts), "node")
    again = st.prefix_entries(documents, counts, st.bitmap_of(common, st.COMMON_BITS))
    shared = st.one_per_group(again.join(common, "shingle").distinct())
    roots = spark.createDataFrame([], "node bigint, root bigint")
    pairs = st.leader_pairs(st.open_entries(shared, roots), nodes, 0).collect()
    met = {row["low"] for row in pairs if row["high"] == sets[0][0]} | {row["high"] for row in pairs if row["low"] == sets[0][0]}
    assert met == {key for key, _ in sets[1:]}
