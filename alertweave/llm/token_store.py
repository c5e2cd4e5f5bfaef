"""Token ids in a compact file format: canonical length-limited Huffman codes in blocks.

Texts are brought into ``doc_id`` order by range partitioning and tokenized once; the ids are kept in
an intermediate table. How often each id occurs in it gives, by package-merge, code lengths under a
limit, and lengths alone fix the canonical codes. A second pass over the ids writes them as blocks
of whole documents. Every ``CHECKPOINT`` ids, a block notes the bit offset; these are independent starting
points, so that decoding looks up one id of each of them at a time in a table over the next
``limit`` bits, and any part of a block can be read alone.

The store has two Parquet tables: ``codebook`` (id, code length) and ``blocks`` (range part, first
id's place in it, the documents' ids and lengths, bits, bit offsets). Spark writes and reads them, so they can be on any
file system. Nothing but the counts of the ids, at most one per vocabulary entry, reaches the driver.

Tokenizing works on pieces between single blanks or line ends, each encoded by the tokenizer once
per worker and kept in a bounded cache; a byte-level pre-tokenizer never joins over such a blank.
A text with any other white space (doubled, at its ends, tabs) goes to the tokenizer as a whole, and
so does one with the string of an added token, which the store codes as that token.

A null text is an empty one and consists of the end id alone. Rows with a null ``doc_id`` come first.
Repeated rows are kept, in a fixed order. An empty table gives an empty store and an empty result.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertweave.llm.shared import stored
from alertweave.session import shared_folder

END_ID = 2
BLOCK_TOKENS = 1 << 18
CHECKPOINT = 64
CACHE_PIECES = 1_000_000
TEXTS_AT_ONCE = 500
PIECES_AT_ONCE = 500
LEAST_LIMIT = 16

# ids of rows without one are 0, with a mark: arrays and columns with nulls would turn to doubles
IDS = "part int, within bigint, doc_id bigint, has_id boolean, n_tokens bigint, ids binary"
BLOCKS = (
    "part int, within bigint, doc_ids array<bigint>, has_ids array<boolean>, doc_tokens array<bigint>,"
    " n_tokens bigint, bits binary, offsets binary"
)
#: white space other than blanks and line ends
OTHER_SPACE = [chr(point) for point in range(0x110000) if chr(point).isspace() and chr(point) not in " \n"]


# ------------------------------------------------------------------------------------- tokenizing


class PieceTokenizer:
    """Texts to arrays of ids, with a cache of pieces. Strings of added tokens in a text are ordinary
    text, or these tokens with ``added_tokens``, which is the tokenizer's own way."""

    def __init__(self, path: str, added_tokens: bool = False) -> None:
        # a task has one core; threads of the library would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        made = json.loads(self.tokenizer.to_str())
        self.added = [token["content"] for token in made["added_tokens"]] if added_tokens else []
        step = made["pre_tokenizer"] or {}
        self.by_pieces = (
            made["normalizer"] is None
            and step.get("type") == "ByteLevel"
            and step.get("use_regex")
            and not step.get("add_prefix_space")
            # pieces are joined by blanks to be learnt
            and not any(char.isspace() for token in self.added for char in token)
        )
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # ids whose text begins with a blank or line end, in the spelling of byte-level vocabularies
        self.begins = np.zeros(size, dtype=bool)
        for token, at in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.begins[at] = token[:1] in ("Ġ", "Ċ")
        self.pieces: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, dtype=self.kind) for one in coded]

    def learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of pieces; a piece begins with its line end, or else with a blank not written."""
        found: dict[str, bytes] = {}
        groups = [missing[at : at + PIECES_AT_ONCE] for at in range(0, len(missing), PIECES_AT_ONCE)]
        joined = ["".join(piece if piece[0] == "\n" else " " + piece for piece in group) for group in groups]
        for group, ids in zip(groups, self.whole(joined), strict=True):
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(group):
                ids_of = self.whole([piece if piece[0] == "\n" else " " + piece for piece in group])
                found.update((piece, one.tobytes()) for piece, one in zip(group, ids_of, strict=True))
                continue
            raw, width = ids.tobytes(), self.kind.itemsize
            edges = [*(starts * width).tolist(), len(raw)]
            found.update((piece, raw[edges[k] : edges[k + 1]]) for k, piece in enumerate(group))
        return found

    @staticmethod
    def is_odd(text: str) -> bool:
        """Has white space that is not one blank or line end between two other characters."""
        pairs = "  " in text or " \n" in text or "\n " in text or "\n\n" in text
        return pairs or text[0] in " \n" or text[-1] in " \n" or any(space in text for space in OTHER_SPACE)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian bytes."""
        out: list[bytes] = [b""] * len(texts)
        odd, cut = [], []
        for at, text in enumerate(texts):
            if text:
                whole = self.is_odd(text) or any(token in text for token in self.added)
                (cut if self.by_pieces and not whole else odd).append(at)
        for at, ids in zip(odd, self.whole([texts[at] for at in odd]), strict=True):
            out[at] = ids.tobytes()
        # the first piece is looked up behind a line end, whose own id is then dropped
        parts = {at: ("\n" + texts[at]).replace("\n", " \n").split(" ")[1:] for at in cut}
        known = self.pieces
        missing = set().union(*parts.values()).difference(known)
        full = len(known) + len(missing) > CACHE_PIECES
        if missing:
            known.update(self.learn(list(missing)))
        look_up, width = known.__getitem__, self.kind.itemsize
        for at, pieces in parts.items():
            out[at] = b"".join(map(look_up, pieces))[width:]
        if full:
            for piece in missing:
                del known[piece]
        return out


_TOKENIZERS: dict[str, PieceTokenizer] = {}


def tokenizer_of(path: str) -> PieceTokenizer:
    """One per worker process, so that its cache lasts over tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PieceTokenizer(path, added_tokens=True)
    return _TOKENIZERS[path]


def tokenized(texts: pd.Series, path: str, end_id: int) -> Iterator[np.ndarray]:
    """Ids of each text with the end id, a few thousand texts at a time."""
    tokenizer = tokenizer_of(path)
    end = np.array([end_id], dtype=tokenizer.kind).tobytes()
    values = texts.tolist()
    for at in range(0, len(values), TEXTS_AT_ONCE):
        for raw in tokenizer.encode(values[at : at + TEXTS_AT_ONCE]):
            yield np.frombuffer(raw + end, dtype=tokenizer.kind)


# ---------------------------------------------------------------------------------------- coding


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code for positive counts with no length over the limit
    (package-merge: ``limit`` rounds of pairing the cheapest and merging with the leaves)."""
    size = len(counts)
    if size < 2:
        return np.ones(size, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    merged, leaf_marks = leaves, []
    for _ in range(limit - 1):
        paired = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, paired))
        rank = np.argsort(both, kind="stable")
        leaf_marks.append(rank < size)
        merged = both[rank]
    # going back down, a leaf is one bit longer in each round that it is chosen in
    lengths = np.zeros(size, dtype=np.int64)
    take = 2 * size - 2
    for marks in reversed([np.ones(size, dtype=bool), *leaf_marks]):
        chosen = int(marks[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (min(take, len(marks)) - chosen)
    out = np.empty(size, dtype=np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes from ``(id, length)``: shorter codes first, equal lengths by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.limit = int(lengths[-1]) if len(lengths) else 1
        spans = np.int64(1) << (self.limit - lengths)
        starts = np.cumsum(spans) - spans
        size = int(ids.max()) + 1 if len(ids) else 1
        self.code = np.zeros(size, dtype=np.uint64)
        self.length = np.zeros(size, dtype=np.int64)
        self.code[ids] = (starts >> (self.limit - lengths)).astype(np.uint64)
        self.length[ids] = lengths
        # by the next ``limit`` bits: which id, and how many bits it takes
        self.next_id = np.zeros(1 << self.limit, dtype=np.uint32)
        self.next_length = np.ones(1 << self.limit, dtype=np.int64)
        filled = int(spans.sum())
        self.next_id[:filled] = np.repeat(ids, spans)
        self.next_length[:filled] = np.repeat(lengths, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Bits, most significant first, and the bit offset of every ``CHECKPOINT``-th id."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        word, within = starts >> 5, starts & 31
        placed = self.code[ids] << (64 - within - lengths).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
        words[word[first]] = np.add.reduceat(placed >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), first)
        bits = words.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8]
        return bits, starts[::CHECKPOINT].astype("<u4").tobytes()

    def decode(self, bits: bytes, offsets: bytes, n: int) -> np.ndarray:
        raw = np.frombuffer(bits + b"\0" * 8, dtype=np.uint8).astype(np.uint64)
        window = (raw[:-4] << np.uint64(32)) | (raw[1:-3] << np.uint64(24)) | (raw[2:-2] << np.uint64(16))
        window |= (raw[3:-1] << np.uint64(8)) | raw[4:]
        at = np.frombuffer(offsets, dtype="<u4").astype(np.int64)
        out = np.zeros((len(at), CHECKPOINT), dtype=np.uint32)
        mask = np.uint64((1 << self.limit) - 1)
        for step in range(CHECKPOINT):
            lanes = len(at) if step < n - (len(at) - 1) * CHECKPOINT else len(at) - 1
            here = at[:lanes]
            shift = (40 - self.limit - (here & 7)).astype(np.uint64)
            ahead = ((window[here >> 3] >> shift) & mask).astype(np.int64)
            out[:lanes, step] = self.next_id[ahead]
            at[:lanes] = here + self.next_length[ahead]
        return out.reshape(-1)[:n]


# ------------------------------------------------------------------------------------ Spark steps


def token_ids(documents: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """The ids of all documents by ``part`` and place in it, both in ascending ``doc_id``."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        within = 0
        for batch in batches:
            coded = list(tokenized(batch["text"], path, end_id))
            sizes = np.array([len(ids) for ids in coded], dtype=np.int64)
            ends = within + np.cumsum(sizes)
            yield pd.DataFrame(
                {
                    "part": batch["part"],
                    "within": ends - sizes,
                    "doc_id": batch["doc_id"],
                    "has_id": batch["has_id"],
                    "n_tokens": sizes,
                    "ids": [ids.tobytes() for ids in coded],
                }
            )
            within = int(ends[-1]) if len(ends) else within

    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        documents.select("doc_id", "text")
        .repartitionByRange(partitions, "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .select(
            F.spark_partition_id().alias("part"),
            F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"),
            F.col("doc_id").isNotNull().alias("has_id"),
            "text",
        )
        .mapInPandas(encode, IDS)
    )


def ids_of(row_ids: bytes, n_tokens: int) -> np.ndarray:
    return np.frombuffer(row_ids, dtype="<u2" if len(row_ids) == 2 * n_tokens else "<u4")


def id_counts(coded: DataFrame) -> DataFrame:
    """How often each id occurs in all documents: ``id, n``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            if len(batch):
                ids = np.concatenate(list(map(ids_of, batch["ids"], batch["n_tokens"])))
                more = np.bincount(ids, minlength=len(total))
                more[: len(total)] += total
                total = more
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    counts = coded.select("n_tokens", "ids").mapInPandas(count, "id bigint, n bigint")
    return counts.groupBy("id").agg(F.sum("n").alias("n"))


def write_store(documents: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """Writes the store of all documents, in ascending ``doc_id``, into a new folder."""
    spark = documents.sparkSession
    coded = stored(token_ids(documents, path, end_id), "ids")
    counts = id_counts(coded).toPandas().sort_values("id")
    ids, n = counts["id"].to_numpy(), counts["n"].to_numpy()
    limit = max(LEAST_LIMIT, int(np.ceil(np.log2(max(2, len(ids))))) + 2)
    lengths = code_lengths(n, limit)
    book = pd.DataFrame({"id": ids.astype("int64"), "length": lengths.astype("int64")})
    spark.createDataFrame(book, "id bigint, length bigint").coalesce(1).write.parquet(f"{folder}/codebook")
    codebook = spark.sparkContext.broadcast((ids, lengths))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Codebook(*codebook.value)
        held: list[tuple[int, bool, np.ndarray]] = []
        place, n_held = (0, 0), 0

        def block() -> pd.DataFrame:
            bits, offsets = coder.encode(np.concatenate([tokens for _, _, tokens in held]))
            return pd.DataFrame(
                {
                    "part": [place[0]],
                    "within": [place[1]],
                    "doc_ids": [[name for name, _, _ in held]],
                    "has_ids": [[has_id for _, has_id, _ in held]],
                    "doc_tokens": [[len(tokens) for _, _, tokens in held]],
                    "n_tokens": [n_held],
                    "bits": [bits],
                    "offsets": [offsets],
                }
            )

        for batch in batches:
            for row in batch.itertuples(index=False):
                # a block ends when it is full, or where the rows do not go on in its part
                if held and (n_held >= BLOCK_TOKENS or (row.part, row.within) != (place[0], place[1] + n_held)):
                    yield block()
                    held, n_held = [], 0
                if not held:
                    place = (row.part, row.within)
                held.append((row.doc_id, row.has_id, ids_of(row.ids, row.n_tokens)))
                n_held += row.n_tokens
        if held:
            yield block()

    coded.mapInPandas(blocks, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document read back from the blocks: ``doc_id, start, n_tokens, ids_crc32``."""
    book = spark.read.parquet(f"{folder}/codebook").toPandas()
    codebook = spark.sparkContext.broadcast((book["id"].to_numpy(), book["length"].to_numpy()))
    stored_blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Codebook(*codebook.value)
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = coder.decode(row.bits, row.offsets, row.n_tokens)
                sizes = np.asarray(row.doc_tokens, dtype=np.int64)
                ends = np.cumsum(sizes)
                checks = [zlib.crc32(ids[end - size : end].tobytes()) for size, end in zip(sizes, ends, strict=True)]
                yield pd.DataFrame(
                    {
                        "part": row.part,
                        "doc_id": row.doc_ids,
                        "has_id": row.has_ids,
                        "within": row.within + ends - sizes,
                        "n_tokens": sizes,
                        "ids_crc32": checks,
                    }
                )

    rows = stored_blocks.mapInPandas(
        documents, "part int, doc_id bigint, has_id boolean, within bigint, n_tokens bigint, ids_crc32 bigint"
    )
    # one row per range part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        stored_blocks.groupBy("part")
        .agg(F.sum("n_tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    )
    return rows.join(parts, "part").select(
        F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"),
        (F.col("part_start") + F.col("within")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def token_store(documents: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the store into the shared folder and reads it back."""
    spark = documents.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_store(documents, folder, path, end_id)
    return read_store(spark, folder)
