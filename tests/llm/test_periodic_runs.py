import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from alertweave.llm import periodic_runs as pr

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def runs_by_hand(words, least=12):
    found = {}
    numbers = {word: k for k, word in enumerate(dict.fromkeys(words))}
    words = np.array([numbers[word] for word in words])
    for period in range(1, len(words) // 2 + 1):
        unequal = np.flatnonzero(words[:-period] != words[period:])
        at = np.concatenate(([0], unequal + 1))
        end = np.append(unequal, len(words) - period)
        for k in np.flatnonzero(end - at >= max(least - period, period)).tolist():
            found.setdefault((int(at[k]), int(end[k] - at[k] + period)), period)
    return sorted(((start, length, period) for (start, length), period in found.items()), key=lambda r: (r[0], r[2]))


def digests_by_hand(doc_id, text):
    words = [w for w in BLANK.split(text or "") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_hand(words)
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def repetitive(rng):
    words = [b"w%d" % k for k in range(rng.choice((1, 2, 4, 60, 600)))]
    text = rng.choices(words, k=rng.choice((0, 1, 11, 12, 40, 250)))
    for _ in range(rng.randint(0, 4)):
        part = rng.choices(words, k=rng.randint(1, 50)) * rng.randint(2, 5)
        at = rng.randint(0, len(text))
        text[at:at] = part[: rng.randint(1, len(part))]
    return text


@pytest.mark.parametrize("levels", [pr.LEVELS_AT_ONCE, 1, 0])
def test_runs_against_all_lags(levels, monkeypatch):
    monkeypatch.setattr(pr, "LEVELS_AT_ONCE", levels)
    rng = random.Random(levels)
    for _ in range(120):
        texts = [repetitive(rng) for _ in range(rng.randint(0, 6))]
        assert [[tuple(r) for r in runs.tolist()] for runs in pr.runs_of(texts)] == [runs_by_hand(t) for t in texts]


def test_splitting_is_the_same_at_once_and_one_by_one(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(60):
        words = rng.integers(0, rng.integers(2, 90), 400)
        starts = np.unique(np.append(0, rng.integers(0, 400, 3)))
        want = pr.split_by_frequency(words, starts)
        monkeypatch.setattr(pr, "LEVELS_AT_ONCE", 0)
        assert (pr.split_by_frequency(words, starts) == want).all()
        monkeypatch.undo()
        # nothing that survives is too rare in its segment or in a short one
        for low, high in zip(starts, np.append(starts[1:], 400), strict=True):
            for at, length in zip(*pr.stretches(np.flatnonzero(want[low:high])), strict=True):
                own = words[low + at : low + at + length].tolist()
                assert length >= pr.LEAST and min(map(own.count, own)) > 1


def test_a_deep_recursion_ends():
    # every split makes the next pair rare, from the outside in
    words = [b"%d" % (k // 2) for k in range(1, 60_001)]
    assert not len(pr.runs_of([words])[0])


def test_query_on_all_rows(spark, documents, no_documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    looped = [(k, " ".join(("a b c " * (k % 7) + f"x{k} ").split() * (1 + k % 3))) for k in range(10_000, 10_040)]
    more = spark.createDataFrame(looped, "doc_id bigint, text string")
    every = documents.select("doc_id", "text").union(more)
    got = pr.run_digests(pr.with_planted_runs(every)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((digests_by_hand(*row) for row in rows + looped), key=repr)
    assert any(r.n_runs > 1 for r in got)
    assert pr.run_digests(pr.with_planted_runs(no_documents)).count() == 0


def test_carried_columns_and_kept_words(spark):
    text = "so it goes " * 6 + "and on"
    frame = spark.createDataFrame([(1, text, "x")], "doc_id bigint, text string, runs string")
    row = pr.periodic_runs(frame.withColumnRenamed("runs", "source"), "doc_id", "source").first()
    assert (row.source, row.n_words, [tuple(r) for r in row.runs]) == ("x", 20, [(0, 18, 3)])
    assert row.collapsed == "so it goes and on"
