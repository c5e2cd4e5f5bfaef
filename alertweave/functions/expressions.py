"""Column helpers shared by every operator: let-binding, canonical JSON, content ids, text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertweave import fixed_values as fixed

# Every character Python and SARIF tools treat as a line end.
_TERMINATORS = r"\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029"
# The places between lines: behind a terminator, but not inside CR LF and not at the end of the text.
_BETWEEN_LINES = r"(?:(?<=[\n\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029])|(?<=\r)(?!\n))(?!\z)"
_OTHER_TERMINATOR = r"[\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
_BLANK_TOKEN = (
    r"//[^\n]*+"
    r"|/\*[\s\S]*?(?:\*/|\z)"
    r'|"""[\s\S]*?(?:"""|\z)'
    r'|"(?:[^"\\]|\\[\s\S])*+(?:"|\\?\z)'
    r"|'(?:[^'\\]|\\[\s\S])*+(?:'|\\?\z)"
    r"|[^/\"']++|/"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use many times in ``body``; lambdas have no CSE of their own."""
    return F.element_at(F.transform(F.array(value), body), 1)


def record(**fields: Column) -> Column:
    """A struct with explicit names; aliases inside lambdas can lose theirs."""
    return F.named_struct(*[part for name, value in fields.items() for part in (F.lit(name), value)])


def struct_of(**fields: Column) -> Column:
    """A struct with alphabetical fields, so that its JSON is canonical."""
    return record(**{name: fields[name] for name in sorted(fields)})


def canonical_json(value: Column) -> Column:
    """Nulls kept, compact, fields in struct order (alphabetical by construction)."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def domain_sha256(domain: str, value: Column) -> Column:
    """Hash of ``domain`` + NUL + canonical JSON."""
    return sha256(F.concat(F.lit(domain + "\0"), canonical_json(value)))


def content_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), sha256(canonical_json(value)))


def sorted_map(value: Column) -> Column:
    """Map with keys in order; JSON of a map follows entry order."""
    return F.map_from_entries(F.array_sort(F.map_entries(value)))


def first_reason(*checks: tuple[Column, str | Column]) -> Column:
    """Text of the first check that holds, else null. An unknown check does not hold."""
    chain = None
    for condition, text in checks:
        text = text if isinstance(text, Column) else F.lit(text)
        chain = F.when(condition, text) if chain is None else chain.when(condition, text)
    return chain.otherwise(F.lit(None).cast("string"))


def all_reasons(*checks: tuple[Column, str]) -> Column:
    """Array of the texts of all checks that hold."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in checks]))


def split_lines(text: Column, keep_ends: bool = True) -> Column:
    """Lines of a text as an array; an empty text has no line. A text whose only terminator is the newline is cut at
    that, as the pattern looks around at every character."""

    def at_newlines(pieces: Column) -> Column:
        behind = F.size(pieces) - 1
        if keep_ends:
            ended = F.transform(pieces, lambda piece, at: F.when(at < behind, F.concat(piece, F.lit("\n"))).otherwise(piece))
            return F.filter(ended, lambda line: line != "")
        return F.filter(pieces, lambda piece, at: (piece != "") | (at < behind))

    def cut(text: Column) -> Column:
        lines = F.filter(F.split(text, _BETWEEN_LINES), lambda line: line != "")
        lines = lines if keep_ends else F.transform(lines, strip_line_end)
        return F.when(text.rlike(_OTHER_TERMINATOR), lines).otherwise(let(F.split(text, "\n"), at_newlines))

    return let(text, cut)


def strip_line_end(line: Column) -> Column:
    return F.regexp_replace(line, rf"(?:\r\n|[{_TERMINATORS}])\z", "")


def strip_newline(line: Column) -> Column:
    """Only CR and LF at the end, as column checks count the other terminators."""
    return F.rtrim(line, F.lit("\r\n"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def has_text(text: Column) -> Column:
    """Whether ``strip`` leaves anything."""
    return text.rlike(r"(?U)[^\s\x1c-\x1f]")


def count_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def column_length(text: Column, column_kind: Column) -> Column:
    utf16 = F.shiftright(F.octet_length(F.encode(text, "UTF-16LE")), 1)
    return F.when(column_kind == "utf16CodeUnits", utf16).otherwise(F.length(text))


def token_estimate(text: Column) -> Column:
    """ceil(UTF-8 bytes / 4); an empty text costs nothing."""
    return F.shiftright(F.octet_length(text) + F.lit(3), 2)


def blank_comments_and_literals(text: Column) -> Column:
    """Same length and newlines, with comments and literals turned to spaces."""

    def blanked(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(_BLANK_TOKEN), F.lit(0))
        return F.array_join(
            F.transform(
                pieces,
                lambda piece: F.when(
                    piece.rlike(r"^(?://|/\*|[\"'])"), F.regexp_replace(piece, r"[^\n]", " ")
                ).otherwise(piece),
            ),
            "",
        )

    # without any of these characters there is nothing to blank
    return let(text, lambda whole: F.when(whole.rlike("[/\"']"), blanked(whole)).otherwise(whole))


def html_escape(text: Column) -> Column:
    for raw, escaped in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
    ):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def dot_escape(text: Column) -> Column:
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def redact(text: Column) -> Column:
    """Bearer values, ``key = value`` secrets, then user info inside URLs."""
    for pattern, replacement in (
        (fixed.BEARER_PATTERN, "Bearer [REDACTED]"),
        (fixed.INLINE_SECRET_PATTERN, "$1[REDACTED]"),
        (fixed.USERINFO_PATTERN, "$1[REDACTED]@"),
    ):
        # blanks and letter case follow Unicode, as the patterns assume
        text = F.regexp_replace(text, "(?U)" + pattern, replacement)
    return text


def redact_map(value: Column) -> Column:
    return F.transform_values(
        value,
        lambda key, item: F.when(
            key.rlike(fixed.SECRET_KEY_PATTERN), F.lit("[REDACTED]")
        ).otherwise(redact(item)),
    )


def redact_value(value: Column, kind: T.DataType) -> Column:
    """Redaction of every string inside a nested value, guided by its type."""
    if isinstance(kind, T.StringType):
        return redact(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: redact_value(item, kind.elementType))
    if isinstance(kind, T.MapType):
        return redact_map(value)
    if isinstance(kind, T.StructType):
        fields = [
            (
                F.lit("[REDACTED]")
                if re.search(fixed.SECRET_KEY_PATTERN, field.name)
                else redact_value(value.getField(field.name), field.dataType)
            ).alias(field.name)
            for field in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def stable_unique(*arrays: Column) -> Column:
    """First-seen order, nulls treated as empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(item, empty) for item in arrays]))


def is_unique(items: Column) -> Column:
    return F.size(F.array_distinct(items)) == F.size(items)


def has_control(text: Column) -> Column:
    return text.rlike(r"[\x00-\x1f\x7f]")


def is_safe_relative_path(path: Column) -> Column:
    """Relative POSIX path with no empty, dot or dot-dot part and no control character."""
    return ~(
        path.startswith("/")
        | path.contains("\\")
        | path.rlike(r"(?:^|/)(?:\.{0,2})(?:/|$)")
        | has_control(path)
    )


def keep_rows(frame: DataFrame, condition: Column) -> DataFrame:
    """``where`` for a condition that is costly to compute.

    A plain filter is pushed below the columns it reads and repeats their expressions, parsing
    a document once per mention. A one-element explode stands in its way: the filter on its
    output stays above it, and each column is computed once.
    """
    marked = frame.withColumn("_kept", F.explode_outer(F.when(condition, F.array(F.lit(1)))))
    return marked.where("_kept is not null").drop("_kept")
