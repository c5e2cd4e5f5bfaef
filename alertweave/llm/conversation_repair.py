"""Conversation structure repair: bidirectional Dijkstra over the edit lattice of each conversation.

A conversation's roles should read ``(s?(ua)+)?`` by their initials. The lattice has a node for each
number of rows read and each state of that pattern. An edit leads to another node: Keep a row (0),
Rerole it to user or assistant (2), Delete it (3), Insert a user or assistant row without text (2).
Blank and duplicate rows can only be deleted; a truncated row that is not deleted adds 1. Two heaps
search from the start and from the accepting ends. Once the two radii together exceed the best
crossing, every cheapest path crosses from one settled side to the other: all crossings of that cost
are taken, and the audit, the initials of the edits in order, is the ASCII-least concatenation.

Two cheapest audits that lead to one node are never prefixes of each other (they could differ by
inserts alone, which cost), so the least audit to a node and the least one from it make the least
through it; from a node the edits have different initials, so the least first letter decides.

Spark deals conversations out and sorts their rows; a worker reads them as a stream. The search gets
three flags and an initial per row, no texts, and its state grows with the nodes it settles, for most
conversations one per row. Repaired rows are made in a second stream, in which the audit comes before its rows and
a row's text is held no longer than the row. A conversation is searched and written by one task, as
its edits depend on all of its rows.

Rows go by turn, nulls first; rows of one turn by role, then by the digest of role and text, and a repeated row
follows the one it repeats. Null roles and texts count as one space. Rows with a null ``conv_id`` are a conversation
of their own. Very long texts are not cut. Other columns are not read. No rows give no conversations.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.llm.shared import BLANKS, prepare
from alertweave.session import cut_lineage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
# states of the pattern: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
ACCEPTING = (START, ASSISTANT)
# the role that a rerole or an insert gives in each state, and the state after it
GIVEN = [("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER)]
MARKS = ".!?"
PAIRS = {"su", "ua", "au"}


@dataclass
class Row:
    """What the search needs of a row."""

    initial: str
    must_go: bool = False
    truncated: bool = False


def edits(rows: list[Row], at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """Letter, cost and node after each edit at a node."""
    if at < len(rows):
        row = rows[at]
        yield DELETE, COSTS[DELETE], at + 1, state
        if not row.must_go:
            extra = TRUNCATED_COST if row.truncated else 0
            if row.initial in NEXT[state]:
                yield KEEP, COSTS[KEEP] + extra, at + 1, NEXT[state][row.initial]
            yield REROLE, COSTS[REROLE] + extra, at + 1, GIVEN[state][1]
    yield INSERT, COSTS[INSERT], at, GIVEN[state][1]


def edits_back(rows: list[Row], at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """Letter, cost and node before each edit that leads to a node."""
    for before in range(4):
        for start in (at, at - 1):
            if start >= 0 and (start < at or state == GIVEN[before][1]):
                for letter, cost, to, after in edits(rows, start, before):
                    if to == at and after == state:
                        yield letter, cost, start, before


class Prefixes:
    """The least audit of least cost to each settled node, as a tree of letters."""

    def __init__(self) -> None:
        self.came: dict[tuple[int, int], tuple[tuple[int, int], str, int] | None] = {}

    def depth(self, node: tuple[int, int]) -> int:
        came = self.came[node]
        return 0 if came is None else came[2]

    def less(self, one: tuple[tuple[int, int], str], other: tuple[tuple[int, int], str]) -> bool:
        """Whether the audit of one ``(node, letter)`` comes before the other's: they are walked back
        to where they part."""
        (a, x), (b, y) = one, other
        first, second = x, y
        while a != b:
            if self.depth(a) >= self.depth(b):
                a, first, _ = self.came[a]
            else:
                b, second, _ = self.came[b]
        return first < second

    def audit(self, node: tuple[int, int]) -> str:
        letters = []
        while (came := self.came[node]) is not None:
            node, letter, _ = came
            letters.append(letter)
        return "".join(reversed(letters))


def cheapest_audit(rows: list[Row]) -> tuple[int, str]:
    """The least cost, and the ASCII-least audit of that cost."""
    n = len(rows)
    ahead: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    prefixes = Prefixes()
    suffix: dict[tuple[int, int], tuple[str, tuple[int, int]] | None] = {}
    # costs first; then by rows read, as an edit without cost reads one: all that lead to a node are settled before it
    heap_ahead = [(0, 0, START)]
    heap_back = [(0, -n, state) for state in ACCEPTING]
    cost_ahead, cost_back = {(0, START): 0}, {(n, state): 0 for state in ACCEPTING}
    offers: dict[tuple[int, int], list[tuple[tuple[int, int], str]]] = {(0, START): []}
    best = None

    def settle_ahead() -> None:
        nonlocal best
        cost, at, state = heapq.heappop(heap_ahead)
        node = (at, state)
        if node in ahead or cost_ahead[node] < cost:
            return
        ahead[node] = cost
        chosen = None
        for offer in offers.pop(node):
            if chosen is None or prefixes.less(offer, chosen):
                chosen = offer
        prefixes.came[node] = None if chosen is None else (*chosen, prefixes.depth(chosen[0]) + 1)
        if node in cost_back:
            best = min(cost + cost_back[node], best) if best is not None else cost + cost_back[node]
        for letter, more, to, after in edits(rows, at, state):
            next_node, total = (to, after), cost + more
            known = cost_ahead.get(next_node)
            if known is None or total < known:
                cost_ahead[next_node] = total
                offers[next_node] = [(node, letter)]
                heapq.heappush(heap_ahead, (total, to, after))
            elif total == known and next_node not in ahead:
                offers[next_node].append((node, letter))

    def settle_back() -> None:
        nonlocal best
        cost, at, state = heapq.heappop(heap_back)
        node = (-at, state)
        if node in back or cost_back[node] < cost:
            return
        back[node] = cost
        suffix.setdefault(node, None)
        if node in cost_ahead:
            best = min(cost + cost_ahead[node], best) if best is not None else cost + cost_ahead[node]
        for letter, more, start, before in edits_back(rows, *node):
            last_node, total = (start, before), cost + more
            known = cost_back.get(last_node)
            if known is None or total < known:
                cost_back[last_node] = total
                suffix[last_node] = (letter, node)
                heapq.heappush(heap_back, (total, -start, before))
            elif total == known and last_node not in back:
                came = suffix.get(last_node)
                # an accepting end needs nothing more, which comes before anything
                if came is not None and letter < came[0]:
                    suffix[last_node] = (letter, node)

    # ends once nothing as cheap as the best crossing can be unsettled on both sides; the ends are settled in any case
    while heap_ahead and heap_back:
        radii = heap_ahead[0][0], heap_back[0][0]
        if best is not None and sum(radii) > best and min(radii) > 0:
            break
        if radii[0] <= radii[1]:
            settle_ahead()
        else:
            settle_back()

    def rest(node: tuple[int, int]) -> str:
        letters = []
        while (came := suffix[node]) is not None:
            letters.append(came[0])
            node = came[1]
        return "".join(letters)

    audits = []
    for node, cost in ahead.items():
        if node in back and cost + back[node] == best and node == (0, START):
            audits.append(rest(node))
        if node not in back or back[node] + cost != best or node == (0, START):
            # where a cheapest path enters the part that the reverse search has settled
            for letter, more, to, after in edits(rows, *node):
                if (to, after) in back and cost + more + back[(to, after)] == best:
                    audits.append(prefixes.audit(node) + letter + rest((to, after)))
    return best, min(audits)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy`` after the damage that a hash of id and turn chooses: drop the
    row, empty its text, take its end marks out, repeat it, make it the user's."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(harm == 4, F.lit("user")).otherwise(blank("role")).alias("role"),
        F.when(harm == 1, F.lit(""))
        .when(harm == 2, F.translate(blank("text"), MARKS, ""))
        .otherwise(blank("text"))
        .alias("text"),
        harm.alias("harm"),
    ).filter("harm != 0")
    copies = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy"))


def ordered(rows: DataFrame) -> DataFrame:
    """Fills null roles and texts and adds the digest by which rows of one turn and role are ordered."""
    filled = rows.withColumns({name: F.coalesce(F.col(name), F.lit(" ")) for name in ("role", "text")})
    if "copy" not in rows.columns:
        filled = filled.withColumn("copy", F.lit(0))
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return filled.select("conv_id", "turn", "role", "text", "copy", F.unhex(F.sha2(said, 256)).alias("said"))


ORDER = ["turn", "role", "said", "copy"]


def flagged(rows: DataFrame) -> DataFrame:
    """Rows without their texts: initial, blank, cut off, and whether an earlier turn said the same."""
    said_by = rows.groupBy("conv_id", "said").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))).alias("first")
    )
    firsts = said_by.select(F.col("conv_id").alias("first_conv"), F.col("said").alias("first_said"), "first")
    ends = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    narrow = rows.select(
        "conv_id",
        *ORDER,
        F.substring("role", 1, 1).alias("initial"),
        (~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).alias("blank"),
        (~ends.isin(*MARKS)).alias("truncated"),
    )
    earlier = ~F.col("first.turn").eqNullSafe(F.col("turn"))
    joined = narrow.join(
        firsts, F.col("conv_id").eqNullSafe(F.col("first_conv")) & (F.col("said") == F.col("first_said"))
    )
    return joined.select("conv_id", *ORDER, "initial", "blank", "truncated", earlier.alias("earlier"))


class Conversation:
    """Counts and flags of a conversation's rows, as they come."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None
        self.said = None

    def add(self, turn: int | None, said: bytes, initial: str, blank: bool, truncated: bool, earlier: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        duplicate = not blank and (earlier or said == self.said)
        truncated = truncated and not blank and not duplicate
        if self.rows and self.rows[-1].initial + initial not in PAIRS:
            self.illegal += 1
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.said = said
        self.rows.append(Row(initial, blank or duplicate, truncated))

    def judged(self) -> list[int | str]:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest_audit(self.rows)]


def repairs(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, now = None, [], None
        out: list[list[int | str]] = []

        def flush(id_type: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array(column, pa.int64()) for column in list(zip(*out, strict=True))[:-1]]
            columns += [pa.array([row[-1] for row in out], pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *columns], ["conv_id", *names])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            columns = ["conv_id", "turn", "said", "initial", "blank", "truncated", "earlier"]
            for conv_id, *row in zip(*[batch.column(name).to_pylist() for name in columns], strict=True):
                if own is None or conv_id != now:
                    if own is not None:
                        ids.append(now)
                        out.append(own.judged())
                    own, now = Conversation(), conv_id
                own.add(*row)
            if out:
                yield flush(id_type)
                ids, out = [], []
        if own is not None:
            ids.append(now)
            out.append(own.judged())
            yield flush(id_type)

    sorted_rows = flagged(ordered(rows)).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    schema = ", ".join(f"{name} {'string' if name == 'audit' else 'bigint'}" for name in names)
    return sorted_rows.mapInArrow(judge, f"conv_id {kind}, {schema}")


def repaired(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """The repaired rows ``conv_id, at, edit, role, text``, conversation by conversation and in order
    within the partitions that come out."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "at", "edit", "role", "text"]
    of_rows = ordered(rows).select("conv_id", *ORDER, "text", F.lit(None).cast("string").alias("audit"))
    first = judged.select(
        "conv_id", *[F.lit(None).cast(of_rows.schema[name].dataType).alias(name) for name in (*ORDER, "text")], "audit"
    )
    # the audit of a conversation comes before its rows
    both = of_rows.union(first).withColumn("later", F.col("audit").isNull())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, read, at, state = None, "", 0, 0, START
        out: list[tuple] = []

        def inserts() -> None:
            nonlocal read, at, state
            while read < len(audit) and audit[read] == INSERT:
                role, state = GIVEN[state]
                out.append((now, at, INSERT, role, ""))
                read, at = read + 1, at + 1

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("conv_id", "role", "text", "audit")]
            for conv_id, role, text, known in zip(*columns, strict=True):
                if known is not None:
                    inserts()
                    now, audit, read, at, state = conv_id, known, 0, 0, START
                    continue
                inserts()
                letter = audit[read]
                read += 1
                if letter == DELETE:
                    continue
                if letter == REROLE:
                    role, state = GIVEN[state]
                else:
                    state = NEXT[state][role[:1]]
                out.append((now, at, letter, role, text))
                at += 1
            id_type = batch.schema.field("conv_id").type
            types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string()]
            if out:
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                out.clear()
                yield pa.RecordBatch.from_arrays(arrays, names)
        inserts()
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names
            )

    return (
        both.repartition("conv_id")
        .sortWithinPartitions("conv_id", "later", *ORDER)
        .mapInArrow(write, f"conv_id {kind}, at bigint, edit string, role string, text string")
    )


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of repaired rows that come in order, as ``repaired`` leaves them:
    ``role:text`` with line feeds between them."""
    import hashlib

    kind = rows.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, id_type = None, None, None
        ids: list = []
        done: list[str] = []
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv_id, role, text in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "role", "text")], strict=True):
                if state is None or conv_id != now:
                    if state is not None:
                        ids.append(now)
                        done.append(state.hexdigest())
                    now, state = conv_id, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(done)], ["conv_id", "repaired_sha256"])
                ids, done = [], []
        if state is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([now], id_type), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"]
            )

    return rows.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def conversation_repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repairs of all conversations, and the repaired rows."""
    prepare(conversations.sparkSession)
    judged = cut_lineage(repairs(conversations))
    return judged, repaired(conversations, judged)


def repair_digests(conversations: DataFrame) -> DataFrame:
    """The conversations after damage: a row per original ``conv_id`` with counts, audit and digest."""
    judged, rows = conversation_repair(damaged(conversations))
    digest = digests(rows).select(F.col("conv_id").alias("digest_conv"), "repaired_sha256")
    known = judged.withColumnRenamed("conv_id", "known_conv")
    every = conversations.select("conv_id").distinct()
    count = lambda name: F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)
    return (
        every.join(known, F.col("conv_id").eqNullSafe(F.col("known_conv")), "left")
        .join(digest, F.col("conv_id").eqNullSafe(F.col("digest_conv")), "left")
        .select(
            "conv_id",
            *[count(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )
