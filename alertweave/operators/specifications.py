"""Digests of project specifications that do not depend on the order of what has none.

The canonical form has the fields of every struct by name, at every level. A list is a set unless its
dotted field path is named as ordered: repeats go and the elements are sorted by their own canonical
form. A map is the set of its entries. Nulls stay, so a missing value and an empty list differ. Two
specifications that say the same in another order share a digest, which makes it fit to be the
``source_fingerprint`` of ``audit.identity_conflicts``.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertweave.functions.expressions import canonical_json, sha256


def canonical(value: Column, kind: T.DataType, ordered: Collection[str] = (), path: str = "") -> Column:
    """A value in canonical form; ``ordered`` has the dotted paths of lists whose order counts."""
    if isinstance(kind, T.StructType):
        fields = [
            canonical(value[field.name], field.dataType, ordered, f"{path}.{field.name}" if path else field.name).alias(field.name)
            for field in sorted(kind.fields, key=lambda field: field.name)
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        elements = F.transform(value, lambda element: canonical(element, kind.elementType, ordered, path))
        return elements if path in ordered else as_set(elements)
    if isinstance(kind, T.MapType):
        entry = lambda one: F.struct(
            one["key"].alias("key"), canonical(one["value"], kind.valueType, ordered, path).alias("value")
        )
        return as_set(F.transform(F.map_entries(value), entry))
    return value


def as_set(elements: Column) -> Column:
    """Distinct elements by their JSON, which also orders elements that have no order of their own."""
    keyed = F.transform(elements, lambda one: F.struct(canonical_json(F.struct(one.alias("one"))).alias("json"), one.alias("one")))
    return F.transform(F.array_sort(F.array_distinct(keyed)), lambda pair: pair["one"])


def with_digest(rows: DataFrame, name: str, ordered: Collection[str] = ()) -> DataFrame:
    """Adds the ``digest`` of the struct column ``name``; null for a null specification."""
    form = canonical(F.col(name), rows.schema[name].dataType, ordered)
    return rows.withColumn("digest", F.when(F.col(name).isNotNull(), sha256(canonical_json(form))))
