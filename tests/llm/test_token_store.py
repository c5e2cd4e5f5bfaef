import heapq
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from alertweave.llm import token_store as ts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(text or "", add_special_tokens=False).ids for text in texts]


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(3)
    texts = ["", None, "a", "a b", " a", " a  b\n\nc", "it's 's don't\nx 12ab <|endoftext|> z", "été über\tx", "a\n b", "x \n y"]
    texts += ["Hi.\nYou, 'tis", "\n", "é²x½ ³", "tail ", "a b c d", "a\x1cb c"]
    texts += ["".join(rng.choice("ab1 .,'\n\té²— s") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    coder = ts.PieceTokenizer(PATH)
    for _ in range(2):  # with an empty and a filled cache
        got = [np.frombuffer(raw, dtype=coder.kind).tolist() for raw in coder.encode(texts)]
        assert got == plain_ids(texts)


def test_a_full_cache_stays_as_it_is(monkeypatch):
    monkeypatch.setattr(ts, "CACHE_PIECES", 40)
    coder = ts.PieceTokenizer(PATH)
    texts = [" ".join(f"w{k}x{j}" for j in range(10)) + "\nnext line" for k in range(30)]
    held = coder.pieces
    for at in range(0, len(texts), 3):
        got = [np.frombuffer(raw, dtype=coder.kind).tolist() for raw in coder.encode(texts[at : at + 3])]
        assert got == plain_ids(texts[at : at + 3])
        # missing pieces do not cause a copy and do not stay
        assert coder.pieces is held and 0 < len(held) <= 40


def test_tokenizer_runs_on_the_core_of_its_task(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    ts.PieceTokenizer(PATH)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


@pytest.mark.parametrize("limit", [6, 16, 40])
def test_code_lengths_are_optimal_within_the_limit(limit):
    rng = np.random.default_rng(limit)
    for size in (1, 2, 3, 17, 60):
        counts = (rng.pareto(0.6, size) * 3 + 1).astype(np.int64)
        lengths = ts.code_lengths(counts, limit)
        assert lengths.max() <= limit and (0.5**lengths).sum() <= 1 + 1e-12
        heap, cost = counts.tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            pair = heapq.heappop(heap) + heapq.heappop(heap)
            cost += pair
            heapq.heappush(heap, pair)
        if limit == 40 and size > 1:
            assert (lengths * counts).sum() == cost
        elif size > 1:
            assert (lengths * counts).sum() >= cost


def test_blocks_decode_to_what_was_coded():
    rng = np.random.default_rng(1)
    counts = (rng.pareto(0.5, 3000) * 2 + 1).astype(np.int64)
    ids = np.arange(3000) * 3 + 5
    book = ts.Codebook(ids, ts.code_lengths(counts, 16))
    for n in (1, 63, 64, 65, 10_001):
        drawn = rng.choice(ids, size=n, p=counts / counts.sum())
        assert (book.decode(*book.encode(drawn), n) == drawn).all()


def test_store_holds_every_document_in_order(spark, documents, no_documents, tmp_path):
    ts.write_store(documents, str(tmp_path / "store"), PATH)
    rows = sorted(ts.read_store(spark, str(tmp_path / "store")).collect(), key=lambda r: r.start)
    texts = documents.select("doc_id", "text").collect()
    want = sorted(
        (
            (-1 if r.doc_id is None else r.doc_id, len(ids) + 1, zlib.crc32(np.array([*ids, 2], dtype="<u4").tobytes()))
            for r, ids in zip(texts, plain_ids([r.text for r in texts]), strict=True)
        )
    )
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    order = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert order == sorted(order)
    assert ts.token_store(no_documents, PATH).count() == 0


def test_store_codes_added_tokens_as_the_library_does(spark, tmp_path):
    texts = ["end <|endoftext|> next", "a b", "<|endoftext|>", "x<|endoftext|>\ny z", "< |endoftext|>"]
    library = Tokenizer.from_file(PATH)
    want = [[*library.encode(text, add_special_tokens=False).ids, 2] for text in texts]
    assert want[0] == [437, 220, 50256, 1306, 2]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ts.write_store(frame, str(tmp_path / "store"), PATH)
    rows = sorted(ts.read_store(spark, str(tmp_path / "store")).collect(), key=lambda r: r.start)
    crcs = [zlib.crc32(np.array(ids, dtype="<u4").tobytes()) for ids in want]
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(i), c) for i, c in zip(want, crcs)]
