"""Interval join: the ranges of lines that cover a line, by equal keys of line bins.

A range is put into each bin it touches and a line into its own, so they meet in an equal-key join
and a residual comparison. Lines are made distinct first: a bin of ``width`` lines then yields at
most ``width`` pairs for each range in it, however many points share a line.

Where points and ranges lie in the same row, ``covers_of_rows`` finds the same by the bins inside the row:
nothing is moved, sorted or grouped, so nothing can spill.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.functions.expressions import let, record

BIN_LINES = 64
# Up to so many pairs of a row's points and ranges, holding each point against each range costs less than bins and halving.
FEW_PAIRS = 1024


def bin_of(line: Column, width: int) -> Column:
    return F.floor(line / F.lit(width)).cast("bigint")


def outermost_covers(points: DataFrame, ranges: DataFrame, keys: list[str], width: int = BIN_LINES) -> DataFrame:
    """``points`` with ``first_cover`` and ``last_cover``: the least and greatest ``range_ord`` of the
    ranges ``low`` to ``high`` (both included) that have the same keys and cover ``at``.

    Every row of ``points`` is kept, repeated rows too; both are null where nothing covers a point,
    and for a null key, ``at``, ``low`` or ``high``. A range with ``low`` above ``high`` covers nothing.
    """
    lines = points.select(*keys, "at", bin_of(F.col("at"), width).alias("line_bin")).distinct()
    binned = ranges.where("low <= high").select(
        *keys,
        "low",
        "high",
        "range_ord",
        F.explode(F.sequence(bin_of(F.col("low"), width), bin_of(F.col("high"), width))).alias("line_bin"),
    )
    # the bin follows from the line; grouped by too, the join's partitioning serves the grouping
    covers = (
        lines.join(binned, [*keys, "line_bin"])
        .where(F.col("at").between(F.col("low"), F.col("high")))
        .groupBy(*keys, "line_bin", "at")
        .agg(F.min("range_ord").alias("first_cover"), F.max("range_ord").alias("last_cover"))
        .drop("line_bin")
    )
    return points.join(covers, [*keys, "at"], "left")


def first_from(ordered: Column, before: Callable[[Column], Column]) -> Column:
    """Position of the first element that is not ``before`` the wanted place; halves the ordered elements at each step."""

    def halve(span: Column, _: Column) -> Column:
        middle = F.shiftright(span["low"] + span["high"], 1)
        earlier = before(F.get(ordered, middle))
        return F.when(span["low"] >= span["high"], span).otherwise(
            record(
                low=F.when(earlier, middle + 1).otherwise(span["low"]),
                high=F.when(earlier, span["high"]).otherwise(middle),
            )
        )

    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size(ordered))))
    return F.aggregate(halvings, record(low=F.lit(0), high=F.size(ordered)), halve)["low"]


def covers_of_rows(
    rows: DataFrame, keys: list[str], points: Column, ranges: Column, width: int = BIN_LINES, few: int = FEW_PAIRS
) -> DataFrame:
    """``rows``, ``keys`` first, with ``covers``: per element of ``points`` (structs ``part, ord, path, at``) the
    ``first_cover`` and ``last_cover`` among ``ranges`` (structs ``range_ord, path, low, high``) of the same
    row and path, ordered by ``part`` and ``ord``; null rules are those of ``outermost_covers``.

    The row's ranges are ordered by path and line bin once. Each line of the row, however many points share it, finds
    its bin there by halving and is held against the ranges of that bin; each point finds its line in the same way.
    Rows of no more than ``few`` pairs are searched as they are.
    """
    own = [name for name in rows.columns if name not in keys]
    rows = rows.select(*keys, *own, points.alias("_points"), F.sort_array(ranges).alias("_ranges"))
    points, ranges = F.col("_points"), F.col("_ranges")

    def searched(point: Column) -> Column:
        here = F.filter(ranges, lambda one: (one["path"] == point["path"]) & point["at"].between(one["low"], one["high"]))
        return let(
            here,
            lambda held: record(
                part=point["part"],
                ord=point["ord"],
                first_cover=F.get(held, F.lit(0))["range_ord"],
                last_cover=F.get(held, F.size(held) - 1)["range_ord"],
            ),
        )

    def in_bins(span: Column) -> Column:
        return F.transform(
            F.sequence(bin_of(span["low"], width), bin_of(span["high"], width)),
            lambda line_bin: record(
                path=span["path"], line_bin=line_bin, range_ord=span["range_ord"], low=span["low"], high=span["high"]
            ),
        )

    def of_line(binned: Column) -> Callable[[Column], Column]:
        def covered(line: Column) -> Column:
            own = bin_of(line["at"], width)
            start = first_from(
                binned, lambda one: (one["path"] < line["path"]) | ((one["path"] == line["path"]) & (one["line_bin"] < own))
            )
            end = first_from(
                binned, lambda one: (one["path"] < line["path"]) | ((one["path"] == line["path"]) & (one["line_bin"] <= own))
            )
            here = let(
                record(start=start, end=end),
                lambda span: F.filter(
                    F.slice(binned, span["start"] + 1, span["end"] - span["start"]),
                    lambda one: line["at"].between(one["low"], one["high"]),
                ),
            )
            return let(
                here,
                lambda held: record(
                    path=line["path"],
                    at=line["at"],
                    first_cover=F.get(held, F.lit(0))["range_ord"],
                    last_cover=F.get(held, F.size(held) - 1)["range_ord"],
                ),
            )

        return covered

    def of_point(lines: Column) -> Callable[[Column], Column]:
        def covered(point: Column) -> Column:
            place = first_from(
                lines, lambda one: (one["path"] < point["path"]) | ((one["path"] == point["path"]) & (one["at"] < point["at"]))
            )
            return let(
                F.get(lines, place),
                lambda line: let(
                    (line["path"] == point["path"]) & (line["at"] == point["at"]),
                    lambda found: record(
                        part=point["part"],
                        ord=point["ord"],
                        first_cover=F.when(found, line["first_cover"]),
                        last_cover=F.when(found, line["last_cover"]),
                    ),
                ),
            )

        return covered

    held = F.filter(ranges, lambda span: span["path"].isNotNull() & (span["low"] <= span["high"]))
    binned = F.sort_array(F.flatten(F.transform(held, in_bins)))
    whole = F.filter(points, lambda point: point["path"].isNotNull() & point["at"].isNotNull())
    lines = let(
        F.sort_array(F.transform(whole, lambda point: record(path=point["path"], at=point["at"]))),
        lambda every: F.filter(every, lambda line, at: (at == 0) | (line != F.get(every, at - 1))),
    )
    outer = let(binned, lambda ordered: F.transform(lines, of_line(ordered)))
    halved = let(outer, lambda told: F.transform(points, of_point(told)))
    pairs = F.size(points).cast("bigint") * F.size(ranges)
    covers = F.sort_array(F.when(pairs <= few, F.transform(points, searched)).otherwise(halved))
    # a one-element explode, so that what reads the covers later does not find them again
    return rows.select(*keys, *own, F.explode_outer(F.array(covers)).alias("covers"))
