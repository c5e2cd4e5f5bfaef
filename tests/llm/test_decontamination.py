import random
import re

import pyarrow as pa

from alertweave.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(documents, items, window=10):
    """``doc_id, n_words, hit words, item ids`` with every window held against every place."""
    windows = set()
    for item, text in items:
        words = words_of(text)
        width = min(window, len(words))
        windows |= {(item, tuple(words[at : at + width])) for at in range(len(words) - width + 1) if width}
    widths, holders = {len(wanted) for _, wanted in windows}, {}
    for item, wanted in windows:
        holders.setdefault(wanted, []).append(item)
    rows = []
    for doc_id, text in documents:
        words = words_of(text)
        hit, found = set(), set()
        for width in widths:
            for at in range(len(words) - width + 1):
                for item in holders.get(tuple(words[at : at + width]), ()):
                    hit |= set(range(at, at + width))
                    found |= {item} - {None}
        rows.append((doc_id, len(words), sorted(hit), sorted(found)))
    return sorted(rows, key=repr)


def collected(frame):
    rows = []
    for r in frame.collect():
        hit = [w for span in r.spans for w in range(span.first_word, span.last_word + 1)]
        assert len(hit) == r.n_hit == len(set(hit))
        rows.append((r.doc_id, r.n_words, hit, list(r["items"])))
    return sorted(rows, key=repr)


def mixed(seed=4):
    rng = random.Random(seed)
    words = [rng.choice(("a", "be", "Été", "x9", "größe", "q")) * rng.randint(1, 4) for _ in range(40)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice((1, 3, 9, 10, 11, 40))))) for k in range(12)]
    items += [(12, None), (13, " ,;"), (3, "a second row of item three, which has more than ten words in it"), (None, "no id but five words")]
    documents = []
    for k in range(40):
        text = rng.choices(words, k=rng.choice((0, 1, 20, 200)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text[at:at] = (rng.choice(items)[1] or "").split()
        documents.append((k, rng.choice((" ", "\n", " -- ", "\t.")).join(text).upper() if k % 3 else " ".join(text)))
    documents += [(None, items[0][1]), (None, items[0][1]), (77, "no id, but five words!"), (78, ("x " * 30_000) + items[1][1])]
    return documents, items


def test_search_by_parts_and_at_once(spark, documents, no_documents):
    rows, items = mixed()
    frame = spark.createDataFrame([(*row, "n") for row in rows], "doc_id bigint, text string, n_words string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = by_hand(rows, items)
    assert collected(dc.contamination(frame, benchmark)) == want
    assert collected(dc.contamination(frame, benchmark, part_bytes=1500)) == want
    assert dc.contamination(no_documents, benchmark).count() == 0
    clean = dc.contamination(documents, benchmark.limit(0)).collect()
    assert len(clean) == documents.count() and not any(r.n_hit or r["items"] for r in clean)


def test_real_tables(spark, documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    want = by_hand(rows, items)
    assert any(hit for _, _, hit, _ in want)
    assert collected(dc.contamination(documents, benchmark)) == want


def test_shifts_pass_over_no_occurrence():
    rng = random.Random(8)
    for _ in range(40):
        letters = rng.choice(("ab", "abcdefgh"))
        text = " ".join("".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(rng.choice((3, 60, 2500))))
        words = text.split()
        patterns = set()
        for _ in range(20):
            at = rng.randrange(len(words))
            patterns.add(" ".join(words[at : at + rng.randint(1, 8)]).encode())
        found = dc.Windows(sorted(patterns), [[k] for k in range(len(patterns))]).search([text.encode()])
        want = set()
        for pattern in patterns:
            parts = pattern.decode().split()
            want |= {(at, at + len(parts) - 1) for at in range(len(words)) if words[at : at + len(parts)] == parts}
        assert set(found[0][0]) == want


def test_cleared_texts_and_pieces():
    texts = ["A-b  Ç!", None, "", "\x00\x7f", "ÄÖ 1_2"]
    assert list(dc.cleared(pa.array(texts))) == [b"a b \xc3\x87", b"", b"", b"", "ÄÖ 1 2".encode()]
    assert list(dc.pieces([b"aa", b"bbb", b"c"], 4)) == [[b"aa", b"bbb"], [b"c"]]
