"""The interval join against a search through all ranges, and the graph's plan."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from alertweave.operators.intervals import covers_of_rows, outermost_covers
from alertweave.plans import queries

POINTS = "doc string, path string, at int, note int"
RANGES = "doc string, path string, low int, high int, range_ord int"


def by_hand(points, ranges):
    rows = []
    for doc, path, at, note in points:
        held = [
            r[4] for r in ranges
            if None not in (doc, path, at, *r[:4]) and r[:2] == (doc, path) and r[2] <= at <= r[3]
        ]
        rows.append((doc, path, at, note, min(held, default=None), max(held, default=None)))
    return sorted(rows, key=repr)


def joined(spark, points, ranges, **settings):
    got = outermost_covers(
        spark.createDataFrame(points, POINTS), spark.createDataFrame(ranges, RANGES), ["doc", "path"], **settings
    )
    return sorted(map(tuple, got.select("doc", "path", "at", "note", "first_cover", "last_cover").collect()), key=repr)


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_against_a_search(spark, width):
    dice = random.Random(5)
    points = [(dice.choice("ab"), dice.choice("xy"), dice.randint(-20, 300), n % 40) for n in range(200)]
    points += points[:5] + [(None, "x", 3, 0), ("a", None, 3, 0), ("a", "x", None, 0), ("c", "x", 3, 0)]
    ranges = []
    for n in range(60):
        low = dice.randint(-20, 280)
        ranges.append((dice.choice("ab"), dice.choice("xy"), low, low + dice.choice([0, 1, 6, 63, 64, 200]), n))
    # repeated, reversed, edges of bins, nulls
    ranges += [ranges[0], ("a", "x", 90, 80, 99), ("a", "x", 63, 64, 98), ("b", "y", 0, 0, 97)]
    ranges += [(None, "x", 1, 9, 96), ("a", None, 1, 9, 95), ("a", "x", None, 9, 94), ("a", "x", 1, None, 93)]
    assert joined(spark, points, ranges, width=width) == by_hand(points, ranges)


def test_empty_sides(spark):
    point, span = ("a", "x", 3, 0), ("a", "x", 1, 5, 0)
    assert joined(spark, [], [span]) == []
    assert joined(spark, [point], []) == [("a", "x", 3, 0, None, None)]


def test_a_line_of_many_points_meets_each_range_once(spark):
    """A hot line: the join yields pairs of distinct lines and ranges, not of points and ranges."""
    points = spark.range(20_000).selectExpr("'a' AS doc", "'x' AS path", "int(id % 2) AS at", "int(id) AS note")
    ranges = spark.range(5_000).selectExpr("'a' AS doc", "'x' AS path", "0 AS low", "70 AS high", "int(id) AS range_ord")
    got = outermost_covers(points, ranges, ["doc", "path"])
    row = got.agg(F.count("*"), F.min("first_cover"), F.max("first_cover"), F.min("last_cover"), F.max("last_cover")).first()
    assert tuple(row) == (20_000, 0, 0, 4_999, 4_999)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables here")
def test_no_slice_is_searched_for_a_node(spark):
    """In the graph's plan, slices are held by an equal-key join on line bins; none is filtered by line."""
    alert_rows, contexts = queries._order_evidence(spark, "/root/testdata/sf0.001")
    plan = queries.evidence.build_graph(alert_rows, contexts)._jdf.queryExecution().optimizedPlan().toString()
    assert "line_bin" in plan and "array_min(" not in plan and "reverse(" not in plan


def test_covers_of_rows_against_the_join(spark):
    """The same covers where points and ranges lie in a row, with nulls, reversed ranges and a hot line."""
    dice = random.Random(9)
    rows = []
    for doc in range(30):
        points = [(n % 3, n, dice.choice(["x", "y", None]), dice.choice([5, None, dice.randint(-20, 300)])) for n in range(dice.randint(1, 40))]
        ranges = []
        for n in range(dice.randint(0, 30)):
            low = dice.choice([None, dice.randint(-20, 280), dice.randint(-20, 280)])
            ranges.append((n, dice.choice(["x", "y", None]), low, dice.choice([None, 10, 90, 400, 64])))
        rows.append((doc, "kept", points, ranges))
    frame = spark.createDataFrame(
        rows,
        "doc int, other string, points array<struct<part:int,ord:int,path:string,at:int>>,"
        "ranges array<struct<range_ord:int,path:string,low:int,high:int>>",
    )
    for width in (1, 64):
        got = covers_of_rows(frame, ["doc"], F.col("points"), F.col("ranges"), width).collect()
        assert {r.doc for r in got} == set(range(30)) and {r.other for r in got} == {"kept"}
        for row in got:
            want = []
            for part, ord_, path, at in rows[row.doc][2]:
                held = [
                    r[0] for r in rows[row.doc][3]
                    if None not in (path, at, r[2], r[3]) and r[1] == path and r[2] <= at <= r[3]
                ]
                want.append((part, ord_, min(held, default=None), max(held, default=None)))
            assert [tuple(c) for c in row.covers] == sorted(want, key=lambda one: one[:2])


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables here")
@pytest.mark.parametrize("query", ["evidence_nodes", "evidence_edges"])
def test_only_narrow_rows_are_dealt_for_the_graph(spark, query):
    """Lines, orders and the digests' rows are dealt once each, by document; what is derived from them is not,
    and no stage is kept on disk."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 3 and all("hashpartitioning(raw_sarif_sha256#" in line for line in dealt)
    assert "Scan ExistingRDD" not in plan


def test_covers_of_rows_moves_sorts_and_groups_nothing(spark):
    """A row that is carried through a sort or a grouping for its covers spills with all its slices."""
    frame = spark.createDataFrame(
        [(1, [(0, 0, "x", 70)], [(0, "x", 60, 70), (1, "x", 65, 200)])],
        "doc int, points array<struct<part:int,ord:int,path:string,at:int>>,"
        "ranges array<struct<range_ord:int,path:string,low:int,high:int>>",
    )
    got = covers_of_rows(frame, ["doc"], F.col("points"), F.col("ranges"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in ("Exchange", "Sort ", "Aggregate") if word in plan]
    assert [tuple(one) for one in got.first().covers] == [(0, 0, 0, 1)]
    # rows with equal keys are rows of their own
    assert covers_of_rows(frame.union(frame), ["doc"], F.col("points"), F.col("ranges")).count() == 2


def test_few_pairs_are_searched_and_many_are_halved_alike(spark):
    """Both ways of finding covers give the same, whatever the order of the ranges; a null list of ranges covers nothing."""
    dice = random.Random(13)
    rows = []
    for doc in range(40):
        points = [(n % 3, n, dice.choice(["x", "y", None]), dice.choice([None, dice.randint(0, 200)])) for n in range(dice.randint(0, 9))]
        ranges = [
            (n, dice.choice(["x", "y", None]), dice.choice([None, dice.randint(0, 150)]), dice.choice([None, 90, 200]))
            for n in range(dice.randint(0, 9))
        ]
        dice.shuffle(ranges)
        rows.append((doc, points, ranges))
    rows.append((40, [(0, 0, "x", 3)], None))
    frame = spark.createDataFrame(
        rows,
        "doc int, points array<struct<part:int,ord:int,path:string,at:int>>,"
        "ranges array<struct<range_ord:int,path:string,low:int,high:int>>",
    )
    found = [
        {r.doc: r.covers for r in covers_of_rows(frame, ["doc"], F.col("points"), F.col("ranges"), few=few).collect()}
        for few in (-1, 5, 1024)
    ]
    assert found[0] == found[1] == found[2] and len(found[0]) == 41
    assert any(one.first_cover is not None for covers in found[0].values() for one in covers)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables here")
@pytest.mark.parametrize("query", ["evidence_nodes", "evidence_edges"])
def test_the_graph_is_made_once_a_row(spark, query):
    """No filter below the explode makes the graph once more to count it, and the plan writes each of the six kinds of
    node as JSON once: an id is not made again for each edge that names it."""
    plan = queries.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not [line for line in filters if "size(" in line]
    assert plan.count("StructField(source_anchor") == 5
