"""Strict typed parsing of small JSON objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertweave.functions.expressions import let
from alertweave.sources.documents import is_strict_json

# Numbers may be written 1, 1.0 or 1e0, and an optional field may be null or absent. Neither
# pattern can match inside a string value, where every quote carries a backslash.
_NUMBER = r'("(?:raw_confidence)":)-?[0-9][0-9.eE+-]*'
_NULL_FIELD = r'"[a-z_]+":null,|,"[a-z_]+":null'


def alphabetical(kind: T.DataType) -> T.DataType:
    """The same type with struct fields in name order, so that its JSON is canonical."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda field: field.name)
        return T.StructType(
            [T.StructField(field.name, alphabetical(field.dataType), True) for field in fields]
        )
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(alphabetical(kind.elementType), True)
    return kind


def parse_type(ddl: str) -> T.StructType:
    return alphabetical(T.DataType.fromDDL(ddl))


def _comparable(text: Column) -> Column:
    normal = F.to_json(F.try_parse_json(text))
    return F.regexp_replace(F.regexp_replace(normal, _NUMBER, "$10"), _NULL_FIELD, "")


def strict_struct(text: Column, ddl: str) -> Column:
    """Typed struct of a strict JSON object with no unknown field and no coerced value.

    The typed value is written back and compared with the normalized original, so a field the
    schema does not know, or a number where text belongs, shows as a difference.
    """
    kind = parse_type(ddl)
    typed = F.when(is_strict_json(text) & F.trim(text).startswith("{"), F.from_json(text, kind))
    return let(
        typed,
        lambda value: F.when(_comparable(F.to_json(value)) == _comparable(text), value),
    )
