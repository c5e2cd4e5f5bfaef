import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from alertweave.llm import packing


def least_padded_size(bins, buckets):
    best = {(0, 0): 0}
    for j in range(1, len(bins) + 1):
        for b in range(1, buckets + 1):
            options = [
                best[i, b - 1] + bins[j - 1][0] * sum(n for _, n, _ in bins[i:j])
                for i in range(j)
                if (i, b - 1) in best
            ]
            if options:
                best[j, b] = min(options)
    return min(best[len(bins), b] for b in range(1, buckets + 1) if (len(bins), b) in best)


def test_bounds_are_optimal():
    rng = random.Random(8)
    for _ in range(120):
        tops = sorted(rng.sample(range(rng.choice([15, 400])), rng.randint(1, 14)))
        bins = [(top, rng.randint(1, 30), 0) for top in tops]
        buckets = rng.randint(1, 6)
        bounds = packing.best_bounds(bins, buckets)
        assert len(bounds) <= buckets and bounds[-1] == tops[-1] and bounds == sorted(set(bounds))
        padded = sum(n * min(b for b in bounds if b >= top) for top, n, _ in bins)
        assert padded == least_padded_size(bins, buckets)
    assert packing.best_bounds([], 4) == []


def test_length_bins_are_bounded_and_ordered(spark):
    rows = spark.range(0, 3_000_000, 7).select("id", packing.length_bin(F.col("id")).alias("bin"))
    assert rows.filter((F.col("id") < 16_384) & (F.col("bin") != F.col("id"))).count() == 0
    assert rows.filter((F.col("bin") > F.col("id")) | (F.col("id") - F.col("bin") > F.col("id") / 8192)).count() == 0


def test_batches(documents, no_documents):
    rows = packing.pack(documents, buckets=5, budget=4000).collect()
    lengths = Counter(
        (r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in documents.select("doc_id", "text").collect()
    )
    assert Counter((r.doc_id, r.length) for r in rows) == lengths
    batches, tops = defaultdict(list), {}
    for r in rows:
        batches[r.bucket, r.batch].append(r.slot)
        tops[r.bucket] = r.bucket_length
        assert r.padding == r.bucket_length - r.length >= 0
    bounds = packing.best_bounds(packing.histogram(documents.select(F.lit(1).alias("x"), "text").select(packing.word_count(F.col("text")).alias("length"))), 5)
    assert [tops[b] for b in sorted(tops)] == bounds
    for (bucket, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots)))
        assert len(slots) == 1 or len(slots) * tops[bucket] <= 4000
        # all but the last batch of a bucket are full
        if (bucket, batch + 1) in batches:
            assert len(slots) == max(1, 4000 // max(1, tops[bucket]))
    assert Counter(map(tuple, packing.pack(documents.repartition(2), buckets=5, budget=4000).collect())) == Counter(map(tuple, rows))
    assert packing.pack(no_documents).count() == 0
