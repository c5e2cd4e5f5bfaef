import random
from collections import defaultdict

import xxhash

from alertweave.llm import near_duplicates as nd


def fingerprint_by_bits(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    width = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_pairs(rows):
    """Smallest id reachable over links of all pairs."""
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        least[root(k)].append(doc_id)
    ids = {r: min((x for x in found if x is not None), default=None) for r, found in least.items()}
    return sorted(((rows[k][0], f"{rows[k][1]:016x}", ids[root(k)]) for k in range(len(rows))), key=repr)


def test_all_documents_against_all_pairs(documents, no_documents):
    rows = [(r.doc_id, fingerprint_by_bits(r.text)) for r in documents.select("doc_id", "text").collect()]
    got = sorted(map(tuple, nd.near_duplicates(documents).collect()), key=repr)
    assert got == groups_by_pairs(rows)
    assert nd.near_duplicates(no_documents).count() == 0


def test_links_at_every_distance(spark):
    rng = random.Random(7)
    prints = {0}
    for _ in range(150):
        base = rng.getrandbits(64)
        prints.add(base)
        for flips in (1, 1, 2, 2, 2, 3, 4):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), flips)))
    prints |= {(1 << 63) | 1, 1 << 63, 3}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in prints], "print bigint")
    for radius in (0, 1, 2, 3):
        want = {
            tuple(sorted((signed(a), signed(b)))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= radius
        }
        got = [tuple(r) for r in nd.links(frame, radius).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_long_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(0, 300)]
    star = [(1000, k) for k in range(1001, 1400)]
    rng = random.Random(1)
    edges = chain + star + [(5000, 5001)]
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges, "low bigint, high bigint")
    got = {r.node: r.root for r in nd.components(frame).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1400)} | {5000: 5000, 5001: 5000}


def test_one_of_each_stays(documents, no_documents):
    kept = nd.one_of_each(documents)
    assert kept.columns == documents.columns
    rows = [(r.doc_id, fingerprint_by_bits(r.text)) for r in documents.select("doc_id", "text").collect()]
    groups = groups_by_pairs(rows)
    want = sorted({(component,) for _, _, component in groups}, key=repr)
    assert sorted([(r.doc_id,) for r in kept.collect()], key=repr) == want
    assert nd.one_of_each(no_documents).count() == 0


def test_probes_are_half_the_ball(spark):
    rng = random.Random(3)
    values = [0, 1, (1 << 32) - 1, *(rng.getrandbits(32) for _ in range(50))]
    frame = spark.createDataFrame([(v,) for v in values], "v bigint")
    for radius in (0, 1, 2):
        for r in frame.select("v", nd.ball(frame["v"], radius).alias("probes")).collect():
            lacks = lambda x, v=r.v: x == v or v & ((x ^ v) & -(x ^ v))
            assert r.probes[0] == r.v and len(set(r.probes)) == len(r.probes)
            assert all(lacks(x) and (x ^ r.v).bit_count() <= radius for x in r.probes)
        if radius == 1:
            assert sum(len(r.probes) for r in frame.select(nd.ball(frame["v"], 1).alias("probes")).collect()) == sum(
                1 + v.bit_count() for v in values
            )


def test_edges_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "low bigint, high bigint").mapInArrow(count, "low bigint, high bigint")
    assert {r.node: r.root for r in nd.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7}
    assert made.value == 3
