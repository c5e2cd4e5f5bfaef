"""Lexical callables of source files, from matched braces.

Each file is blanked and cut at its braces in the row; only small per-brace facts travel.
Brace matching is a running sum per file, so no text and no stack ever leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave import fixed_values as fixed
from alertweave.functions.expressions import (
    blank_comments_and_literals,
    count_newlines,
    let,
    record,
    strip,
)

FILE = ["repository_identity", "path"]
_NAME_BEFORE_PARENTHESIS = r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\("
_CALL = r"(?U)\b([A-Za-z_$][A-Za-z0-9_$]*)(\s*)\("
_MARKED = r"([A-Za-z_$][A-Za-z0-9_$]*)\x01"


def callable_symbol(header: Column) -> Column:
    """Name of the callable a brace header opens, else null."""
    names = F.regexp_extract_all(header, F.lit(_NAME_BEFORE_PARENTHESIS), F.lit(1))
    last = F.get(names, F.size(names) - 1)
    refused = (
        header.rlike(fixed.CONTROL_HEADER_PATTERN)
        | last.isin(fixed.CONTROL_KEYWORDS)
        | header.contains("->")
        | header.rlike(fixed.TYPE_HEADER_PATTERN)
    )
    return F.when(~refused, last)


def brace_facts(source_files: DataFrame) -> DataFrame:
    """Per brace: its order, kind, newline counts and the symbol its header names."""
    # Cut behind each brace. A pattern that searches for the next brace would scan a text
    # without braces once per character.
    pieces = (
        source_files.where(F.col("text").contains("{"))
        .select(*FILE, blank_comments_and_literals(F.col("text")).alias("blanked"))
        .select(*FILE, F.posexplode(F.split("blanked", r"(?<=[{}])")).alias("brace", "piece"))
        .where(F.endswith("piece", F.lit("{")) | F.endswith("piece", F.lit("}")))
    )
    body = F.expr("left(piece, length(piece) - 1)")
    header = F.substring_index("body", ";", -1)
    return (
        pieces.withColumn("body", body)
        .withColumn("header", header)
        .withColumn("lead", F.regexp_extract("header", r"(?U)^\s*", 0))
        .select(
            *FILE,
            "brace",
            F.when(F.endswith("piece", F.lit("{")), 1).otherwise(-1).alias("turn"),
            count_newlines(F.col("piece")).alias("newlines"),
            (
                count_newlines(F.col("body"))
                - count_newlines(F.col("header"))
                + count_newlines(F.col("lead"))
            ).alias("newlines_to_header"),
            F.when(
                F.endswith("piece", F.lit("{")),
                callable_symbol(F.regexp_replace(strip(F.col("header")), r"(?U)\s+", " ")),
            ).alias("symbol"),
        )
    )


def index_callables(source_files: DataFrame) -> DataFrame:
    """``repository_identity, path, start_line, end_line, symbol`` of every lexical callable."""
    order = Window.partitionBy(*FILE).orderBy("brace")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    # A closing brace with nothing open is ignored: depth never falls below its running low.
    depths = (
        brace_facts(source_files)
        .withColumn("net", F.sum("turn").over(so_far))
        .withColumn("lines_before", F.coalesce(F.sum("newlines").over(before), zero))
        .withColumn("low", F.least(zero, F.min("net").over(so_far)))
        .withColumn(
            "low_before", F.least(zero, F.coalesce(F.min("net").over(before), zero))
        )
        .withColumn(
            "level",
            F.when(F.col("turn") == 1, F.col("net") - F.col("low")).otherwise(
                F.col("net") + 1 - F.col("low_before")
            ),
        )
        .where("level > 0")
    )
    same_level = Window.partitionBy(*FILE, "level").orderBy("brace")
    return (
        depths.withColumn("end_line", 1 + F.col("lines_before") + F.col("newlines"))
        .withColumn("closing", F.lead(F.struct("turn", "end_line")).over(same_level))
        .where("turn = 1 and symbol is not null and closing.turn = -1")
        .select(
            *FILE,
            (1 + F.col("lines_before") + F.col("newlines_to_header")).cast("int").alias("start_line"),
            F.col("closing.end_line").cast("int").alias("end_line"),
            "symbol",
        )
    )


def smallest_callable_by_line(callables: DataFrame) -> DataFrame:
    """Per line: the smallest callable around it; ties by start line, then symbol.

    A lookup by exact line replaces the range join of references with callables, so a file
    cited by very many alerts costs its own lines once and each alert one equal-key match.
    """
    return (
        callables.select(
            *FILE,
            F.explode(F.sequence("start_line", "end_line")).alias("line_no"),
            F.struct(
                (F.col("end_line") - F.col("start_line")).alias("span"),
                "start_line",
                "symbol",
                "end_line",
            ).alias("callable"),
        )
        .groupBy(*FILE, "line_no")
        .agg(F.min("callable").alias("callable"))
        .select(
            *FILE,
            "line_no",
            F.col("callable.start_line").alias("callable_start"),
            F.col("callable.end_line").alias("callable_end"),
            F.col("callable.symbol").alias("callable_symbol"),
        )
    )


def call_sites(text: Column) -> Column:
    """``ARRAY<STRUCT<name, offset>>``: names followed by a parenthesis in blanked text.

    A mark is put after each name before the text is cut into lines, so a name and its
    parenthesis may stand on different lines.
    """

    def marked(text: Column) -> Column:
        return F.regexp_replace(F.translate(text, "\x01", " "), _CALL, "$1\x01$2(")

    def names_of(line: Column) -> Column:
        return F.when(
            line.contains("\x01"), F.array_distinct(F.regexp_extract_all(line, F.lit(_MARKED), F.lit(1)))
        ).otherwise(F.array().cast("array<string>"))

    def sites(text: Column) -> Column:
        return F.flatten(
            F.transform(
                F.split(marked(text), "\n"),
                lambda line, offset: F.transform(names_of(line), lambda name: record(name=name, offset=offset)),
            )
        )

    # a text without a parenthesis calls nothing
    none = F.array().cast("array<struct<name:string,offset:int>>")
    return let(text, lambda whole: F.when(~whole.contains("("), none).otherwise(sites(whole)))


def index_definitions(source_files: DataFrame, by_line: DataFrame) -> DataFrame:
    """Per file and name: how many callables of that name a call could mean, and one range."""
    sites = (
        source_files.where(F.col("text").contains("("))
        .select(
            *FILE,
            F.explode(call_sites(blank_comments_and_literals(F.col("text")))).alias("site"),
        )
        .select(
            *FILE,
            F.col("site.name").alias("name"),
            (F.col("site.offset") + 1).alias("line_no"),
        )
    )
    return (
        sites.join(by_line, [*FILE, "line_no"])
        .where("callable_symbol = name")
        .groupBy(*FILE, "name", "callable_start", "callable_end")
        .agg(F.count("*").alias("sites"))
        .groupBy(*FILE, "name")
        .agg(
            F.count("*").alias("definitions"),
            F.min(F.struct("callable_start", "callable_end")).alias("range"),
        )
        .select(
            *FILE,
            "name",
            "definitions",
            F.col("range.callable_start").alias("callable_start"),
            F.col("range.callable_end").alias("callable_end"),
        )
    )


def ambiguous_names(definitions: DataFrame) -> DataFrame:
    return definitions.where("definitions > 1")
