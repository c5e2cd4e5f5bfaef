import random

import numpy as np
from pyspark.sql import functions as F

from alertweave.llm import language


def test_held_out_accuracy(documents, real_documents):
    got = language.language_id(documents, fit_documents=200)
    rows = {r.doc_id: r for r in got.collect() if r.doc_id is not None and r.doc_id < 9000}
    right, n = 0, 0
    for r in real_documents.select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("c")).collect():
        assert rows[r.doc_id].held_out == (r.c % 4 == 2)
        assert 0 <= rows[r.doc_id].score <= 1
        if r.c % 4 == 2:
            n += 1
            right += rows[r.doc_id].lang_pred == r.lang
    assert n > 20 and right / n >= 0.95


def test_texts_without_letters(spark, documents, no_documents):
    got = language.language_id(documents, fit_documents=200).filter("doc_id in (9001, 9002, 9003)").collect()
    assert [(r.lang_pred, r.score, r.spans) for r in got] == [("und", 0.0, [])] * 3
    assert language.language_id(no_documents).count() == 0
    unlearned = language.language_id(documents.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}


def small_model(scripts=None):
    rng = np.random.default_rng(2)
    counts = rng.pareto(0.5, (3, 1 << language.BUCKET_BITS)) * 3
    seen = np.zeros((3, len(language.SCRIPTS)))
    seen[:2, language.SCRIPTS.index("Latin")] = 5
    seen[2, language.SCRIPTS.index("Cyrillic")] = 5
    return language.LanguageModel(["aa", "bb", "cc"], counts, seen)


def test_viterbi_in_step_is_viterbi_per_text():
    rng = random.Random(4)
    model = small_model()
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    words = language.Words(texts)
    scores = model.word_scores(words)
    labels = model.label(scores, words.per_text)
    at = 0
    for size in words.per_text.tolist():
        own = scores[at : at + size].astype(float)
        if size:
            best = own[0].copy()
            for step in range(1, size):
                best = np.maximum(best, best.max() - language.SWITCH) + own[step]
            path = labels[at : at + size]
            cost = own[np.arange(size), path].sum() - language.SWITCH * (np.diff(path) != 0).sum()
            assert abs(cost - best.max()) < 1e-6 * max(1, abs(cost))
        at += size


def test_scripts_narrow_and_spans_cover():
    model = small_model()
    names, scores, spans = model.judge(["слово и ещё слово", "abc ab", "12 %", None])
    assert names[0] == "cc" and names[1] in ("aa", "bb") and names[2:] == ["und", "und"]
    assert scores[:1] == [1.0] and spans[0] == [(0, 3, "cc")] and spans[2:] == [[], []]
    _, _, (mixed,) = model.judge(["abc ab слово слово слово abcd"])
    assert mixed[0][0] == 0 and mixed[-1][1] == 5
    assert all(a[1] + 1 == b[0] and a[2] != b[2] for a, b in zip(mixed[:-1], mixed[1:], strict=True))
    assert "cc" in [span[2] for span in mixed]
