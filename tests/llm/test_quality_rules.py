import math
import re
from collections import Counter

from pyspark.sql import functions as F

from alertweave.llm import quality_rules as qr


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    n = len(words)
    failed = n < 50 or 100 * len(marked) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked), failed


def test_base_counts(documents, labels, no_documents, no_labels):
    got = qr.quality_rules(documents, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
    want = Counter((r.doc_id, *base(r.text)) for r in documents.select("doc_id", "text").collect())
    rows = got.collect()
    assert Counter(tuple(r)[:-1] for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)
    assert qr.quality_rules(no_documents, labels).count() == 0
    unlabelled = qr.quality_rules(documents, no_labels).collect()
    assert all(r.kept != r.base_failed for r in unlabelled)
    kept = qr.kept_documents(documents, labels)
    assert kept.columns == documents.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(r.doc_id for r in rows if r.kept)


def test_tail_is_the_exact_binomial_one(spark):
    cases = [(k, n) for n in (1, 30, 400) for k in (0, 1, 2, 7) if k <= n]
    frame = spark.createDataFrame(cases, "k bigint, n bigint")
    for risk in (0.01, 0.2):
        for r in frame.select("k", "n", qr.tail_probability(F.col("k"), F.col("n"), risk).alias("p")).collect():
            want = sum(math.comb(r.n, j) * risk**j * (1 - risk) ** (r.n - j) for j in range(r.k + 1))
            assert r.p == 1 if r.k >= r.n * risk else abs(r.p - want) < 1e-12


def cutoffs_by_hand(rows, risk, error):
    """Level after level for each stratum and rule, until one is not certified."""
    strata = sorted({s for s, _, _ in rows})
    out = {}
    for s in strata:
        good = [m for t, g, m in rows if t == s and g]
        bad = [m for t, g, m in rows if t == s and not g]
        for at, rule in enumerate(qr.RULES):
            best = None
            for level, cut in enumerate(qr.grid(rule)):
                lost, caught = sum(m[at] > cut for m in good), sum(m[at] > cut for m in bad)
                p = risk / len(qr.RULES)
                tail = sum(math.comb(len(good), j) * p**j * (1 - p) ** (len(good) - j) for j in range(lost + 1))
                if lost >= len(good) * p or tail > error / (len(strata) * len(qr.RULES)):
                    break
                gain = caught - qr.CLEAN_WEIGHT * lost
                if caught and gain > 0 and (best is None or gain > best[0]):
                    best = (gain, level, cut)
            out[s, at] = best and best[2]
    return out


def test_cutoffs_by_hand(spark):
    import random

    rng = random.Random(6)
    rows = []
    for s, n in (("a", 500), ("b", 40), ("c", 900)):
        for _ in range(n):
            good = rng.random() < 0.8
            rows.append((s, good, [min(1.0, rng.random() ** 6 * (0.4 if good else 3)) for _ in qr.RULES]))
    frame = spark.createDataFrame(rows, "stratum string, good boolean, measures array<double>")
    got = {r.stratum: r.cutoffs for r in qr.cutoffs(frame, risk=0.3).collect()}
    want = cutoffs_by_hand(rows, 0.3, qr.ERROR)
    assert any(cut is not None for cut in want.values())
    for (s, at), cut in want.items():
        found = got.get(s, [None] * len(qr.RULES))[at]
        assert (found is None) == (cut is None) and (cut is None or abs(found - cut) < 1e-12), (s, at)


def test_junk_goes_and_good_text_stays(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    text = lambda k: " ".join(words[(k * 7 + i * i) % 8] + str((k * i) % 89) for i in range(60))
    rows = [(k, text(k), "en", "s", 0) for k in range(1500)]
    rows += [(k, text(k).replace(" ", "### "), "en", "s", 0) for k in range(1500, 1600)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = documents.select("doc_id", (F.col("doc_id") < 1500).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    kept = {r.doc_id for r in qr.kept_documents(documents, labels).collect()}
    assert kept == set(range(1500)) - {r[0] for r in rows if base(r[1])[-1]}
