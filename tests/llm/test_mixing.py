import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from alertweave.llm import mixing


def targets_by_turns(sizes, weights=(1, 2, 3), cap=3):
    """Shares by weight; whoever is above its cap is set to it and the excess is dealt again."""
    names = sorted(sizes, key=lambda name: (name is None, name or ""))
    weight = {name: weights[at % len(weights)] for at, name in enumerate(names)}
    target, capped, total = {}, set(), sum(sizes.values())
    while True:
        free = [name for name in names if name not in capped]
        left = total - sum(cap * sizes[name] for name in capped)
        for name in free:
            target[name] = left * weight[name] / sum(weight[other] for other in free)
        over = {name for name in free if target[name] > cap * sizes[name]}
        if not over:
            return target
        capped |= over
        target |= {name: cap * sizes[name] for name in over}


def by_highest_quotient(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda k: (weights[k] / (2 * won[k] + 1), -k))
        won[best] += 1
    return won


def test_apportionment_is_that_of_highest_quotients(spark):
    rng = random.Random(5)
    cases = {k: [rng.choice([0, 1, 5, rng.random() * 1000]) for _ in range(rng.randint(1, 9))] for k in range(25)}
    seats = {k: rng.choice([0, 1, 3, 40, 300]) for k in cases}
    rows = [(k, at, float(w), seats[k]) for k, ws in cases.items() for at, w in enumerate(ws) if sum(ws)]
    frame = spark.createDataFrame(rows, "parent int, item int, weight double, seats bigint")
    got = defaultdict(dict)
    for row in mixing.apportion(frame, ["parent"], [F.col("item")], "weight", "seats").collect():
        got[row.parent][row.item] = row.quota
    for k, dealt in got.items():
        assert [dealt[at] for at in sorted(dealt)] == by_highest_quotient(cases[k], seats[k]), (cases[k], seats[k])


def test_mix_of_all_documents(documents):
    source = documents.select("doc_id", "text", "source", "size")
    rows = mixing.mix(source).collect()
    texts = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in source.collect()]
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter(texts)
    sizes = Counter()
    for _, name, size in texts:
        sizes[name] += size
    wanted = targets_by_turns(sizes)
    taken, block = Counter(), rows[0].block
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
        assert r.source_size == sizes[r.source]
        assert abs(r.target - wanted[r.source]) < 1e-6 * max(1, wanted[r.source])
    for name, target in wanted.items():
        assert abs(taken[name] - target) <= max(block, 0.02 * target), name
    again = mixing.mix(source.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_mixed_documents_keep_their_columns(documents, no_documents):
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns
    counts = Counter(r.doc_id for r in mixed.collect())
    assert counts and not set(counts) & {9001, 9002, 9003}
    assert mixing.mix(no_documents).count() == 0 == mixing.mixed_documents(no_documents).count()
