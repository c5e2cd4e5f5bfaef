import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from alertweave.llm import conversation_repair as cr

SOMETHING = re.compile(r"[^\x20\x09-\x0D]")
NAMES = {"u": "user", "a": "assistant"}


def scripts(rows, longest_insert=2):
    """Every audit with a few inserts between rows, its cost and what it makes."""
    def choices(row):
        _, _, must_go, truncated = row
        yield "D", 3, []
        if not must_go:
            yield "K", int(truncated), [row[:2]]
            for initial in "ua":
                yield "R", 2 + int(truncated), [(NAMES[initial], row[1])]

    inserts = [p for n in range(longest_insert + 1) for p in itertools.product("ua", repeat=n)]
    slots = [[("I" * len(p), 2 * len(p), [(NAMES[i], "") for i in p]) for p in inserts]]
    parts = slots + [x for row in rows for x in (list(choices(row)), *slots)]
    for script in itertools.product(*parts):
        made = [one for part in script for one in part[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(role[:1] or "-" for role, _ in made)):
            yield sum(part[1] for part in script), "".join(part[0] for part in script), made


def damage(rows):
    for conv, turn, role, text in rows:
        blank = lambda value: " " if value is None else value
        h = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        for copy in range(0 if h == 0 else 2 if h == 3 else 1):
            yield conv, turn, role, text, copy


def in_order(row):
    _, turn, role, text, copy = row
    said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    return (turn is not None, turn or 0, role.encode(), said, copy)


def repaired_by_hand(conv, rows, best=None):
    rows = sorted(rows, key=in_order)
    seen, faults, plain = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, _, role, text, _ in rows:
        something = SOMETHING.findall(text)
        fault = None
        if not something:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif something[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        plain.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [row[1] for row in rows if row[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = zip(plain, plain[1:], strict=False)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs)
    cost, audit, made = (best or cheapest_by_hand)(plain)
    sha = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in made).encode()).hexdigest()
    return (conv, gaps, *faults.values(), illegal, cost, audit, sha)


def cheapest_by_hand(plain):
    """Least cost, audit and rows, by trying all scripts in turn from the front."""
    best = {("", None): (0, "", [])}  # by state: made rows' pattern so far
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def insert(states):
        states = dict(states)
        for _ in range(4):
            for state, (cost, audit, made) in list(states.items()):
                for initial, to in after[state].items():
                    if initial in NAMES:
                        offer = (cost + 2, audit + "I", [*made, (NAMES[initial], "")])
                        if to not in states or offer[:2] < states[to][:2]:
                            states[to] = offer
        return states

    states = insert({"": best[("", None)]})
    for role, text, must_go, truncated in plain:
        new = {}

        def offer(state, value):
            if state not in new or value[:2] < new[state][:2]:
                new[state] = value

        for state, (cost, audit, made) in states.items():
            offer(state, (cost + 3, audit + "D", made))
            if not must_go:
                if role[:1] in after[state]:
                    offer(after[state][role[:1]], (cost + truncated, audit + "K", [*made, (role, text)]))
                for initial in "ua":
                    if initial in after[state]:
                        offer(after[state][initial], (cost + 2 + truncated, audit + "R", [*made, (NAMES[initial], text)]))
        states = insert(new)
    cost, audit, made = min((states[s] for s in ("", "a") if s in states), key=lambda v: v[:2])
    return int(cost), audit, made


def rows_for(initials, rng):
    names = {"s": "system", "u": "user", "a": "assistant", "x": "xenon", "-": ""}
    return [(names[i], f"t{k}", rng.random() < 0.2, rng.random() < 0.25) for k, i in enumerate(initials)]


def test_the_reference_of_these_tests_against_all_scripts():
    rng = random.Random(1)
    for _ in range(60):
        plain = rows_for([rng.choice("suax") for _ in range(rng.randint(0, 3))], rng)
        cost, audit, made = min(scripts(plain), key=lambda one: one[:2])
        assert cheapest_by_hand(plain) == (cost, audit, made)


def test_search_against_plain_relaxation():
    rng = random.Random(2)
    for _ in range(1500):
        plain = rows_for([rng.choice("suauax-") for _ in range(rng.randint(0, 12))], rng)
        rows = [cr.Row(role[:1], must_go, truncated) for role, _, must_go, truncated in plain]
        assert cr.cheapest_audit(rows) == cheapest_by_hand(plain)[:2]
    long = [cr.Row("ua"[k % 2]) for k in range(50_000)]
    assert cr.cheapest_audit(long) == (0, "K" * 50_000)
    assert cr.cheapest_audit([]) == (0, "")


ODD = [
    (None, 0, "user", "Who am I?"), (None, 1, "assistant", "Nobody."),
    (900, None, "user", "No turn?"), (900, None, None, None), (900, 3, "assistant", "Three."), (900, 7, "assistant", ""),
    (901, 1, "user", "Same?"), (901, 1, "user", "Same?"), (901, 1, "assistant", "Same?"), (901, 2, "assistant", "Yes. \n\t"),
    (902, 5, "tool", "x" * 300_000), (902, 6, "", "no role."), (903, 0, "system", "Only this."), (904, None, None, None),
    (905, 1, "user", "été ü 中文"), (905, 2, "assistant", "日本語!"), (905, 9_000_000_000, "user", "Late."),
]


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(6)
    known = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    long = [(910, k, "ua"[k % 2] == "u" and "user" or "assistant", rng.choice(("One.", "Two", f"{k}!", " "))) for k in range(900)]
    odd = spark.createDataFrame(ODD + long, known.schema)
    return known.union(odd).withColumns({"said": F.lit(1), "audit": F.lit("x")}).repartition(3)


def test_query_on_all_rows(spark, conversations):
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    by_conv = {row[0]: [] for row in rows}
    for row in damage(rows):
        by_conv[row[0]].append(row)
    want = sorted((repaired_by_hand(conv, own) for conv, own in by_conv.items()), key=repr)
    got = sorted(map(tuple, cr.repair_digests(conversations).collect()), key=repr)
    assert got == want
    assert {letter for row in want for letter in row[7]} == set("KRDI")
    assert cr.repair_digests(conversations.limit(0)).count() == 0


def test_repaired_rows_without_damage(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (1, 2, "assistant", "Yes"), (1, 3, "assistant", " ")]
    judged, repaired = cr.conversation_repair(spark.createDataFrame(rows, "conv_id int, turn bigint, role string, text string"))
    assert [(r.cost, r.audit) for r in judged.collect()] == [(6, "KIKKD")]
    assert [(r["at"], r.edit, r.role, r.text) for r in repaired.orderBy("at").collect()] == [
        (0, "K", "user", "Hi."), (1, "I", "assistant", ""), (2, "K", "user", "Still there?"), (3, "K", "assistant", "Yes")
    ]
