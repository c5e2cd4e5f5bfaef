import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from alertweave.llm import importance as im


def grams(text):
    words = (text or "").encode().lower().split()
    return Counter(words) + Counter(zip(words, words[1:], strict=False))


def test_features_are_words_and_pairs():
    texts = ["A b a\tB", "", "x", " one  two\n", "a b", "ü ü"]
    buckets, sizes = im.features([t.encode() for t in texts])
    assert sizes.tolist() == [grams(t).total() for t in texts]
    per_text = [Counter(b.tolist()) for b in np.split(buckets, np.cumsum(sizes)[:-1])]
    # equal grams meet in one bucket wherever they stand
    assert per_text[0] - per_text[4] == Counter(per_text[0]) - Counter(per_text[4])
    assert all(bucket in per_text[0] for bucket in per_text[4])
    assert sorted(per_text[5].values()) == [1, 2]
    alone = im.features([texts[3].encode()])[0].tolist()
    assert Counter(alone) == per_text[3]


def test_weights_are_log_ratios_of_smoothed_models(documents, labels):
    rows = documents.select("doc_id", "text").collect()
    clean = {r.doc_id for r in im.good_labels(labels).filter("good").collect()}
    raw, aimed = Counter(), Counter()
    mine = {}
    for r in rows:
        own = Counter(im.features([(r.text or "").encode()])[0].tolist())
        mine[r.doc_id, r.text] = own
        raw += own
        if r.doc_id in clean:
            aimed += own
    heavy = im.SMOOTHING * (1 << im.BUCKET_BITS)
    all_raw, all_aimed = raw.total(), aimed.total()
    ratios = {}
    for b in raw:
        share = (raw[b] + im.SMOOTHING) / (all_raw + heavy)
        ratios[b] = math.log((aimed[b] + heavy * share) / (all_aimed + heavy)) - math.log(share)
    ratios_of_all = documents.sparkSession.sparkContext.broadcast(im.log_ratios(documents, labels))
    got = im.importance(documents, ratios_of_all, F.col("doc_id"), F.col("text")).collect()
    assert len(got) == len(rows)
    for r in got:
        own = mine[r.doc_id, r.text]
        assert r.n_features == own.total()
        assert abs(r.log_weight - sum(n * ratios[b] for b, n in own.items())) < 1e-6 * (1 + own.total())
        assert math.isfinite(r.key)


def test_kth_largest(spark):
    rng = random.Random(4)
    for values in ([rng.gauss(0, 1) for _ in range(400)], [1.0] * 50 + [2.0, -1e12, 1e-9], [3.0], []):
        frame = spark.createDataFrame([(v,) for v in values], "key double").repartition(3)
        ordered = sorted(values, reverse=True)
        for k in {1, 2, len(values) // 2, len(values) - 1}:
            if 1 <= k < len(values):
                assert im.kth_largest(frame, k) == ordered[k - 1]
        assert im.kth_largest(frame, len(values)) == -math.inf
        if values:
            assert im.kth_largest(frame, 0) == math.inf


def test_noise_is_gumbel_and_repeatable(documents, labels):
    ratios = documents.sparkSession.sparkContext.broadcast(im.log_ratios(documents, labels))
    noisy = im.importance(documents, ratios, F.col("doc_id"), F.col("text")).select("doc_id", "text", F.col("key") - F.col("log_weight"))
    rows = noisy.collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, noisy.collect()))
    assert len({tuple(r) for r in rows}) < len(rows)  # the repeated rows draw alike
    noise = np.array([r[2] for r in rows])
    assert abs(noise.mean() - 0.5772) < 0.4 and abs(noise.std() - 1.2825) < 0.4


def test_junk_goes_and_clean_text_stays(documents, labels, no_documents, no_labels):
    judged = im.quality_classifier(documents, labels)
    known = judged.join(im.good_labels(labels), "doc_id").collect()
    good = [r.kept for r in known if r.good]
    junk = [r.kept for r in known if not r.good]
    assert sum(good) >= 0.99 * len(good) and sum(junk) <= 0.6 * len(junk)
    k = math.ceil(im.kept_share(documents, labels) * documents.count())
    kept = im.kept_documents(documents, labels)
    assert kept.columns == documents.columns
    assert k <= kept.count() <= k + 2
    assert im.quality_classifier(no_documents, labels).count() == 0
    assert im.quality_classifier(documents, no_labels).filter("NOT kept").count() == 0
