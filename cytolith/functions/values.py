"""Column functions on values of any type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trimmed(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_missing(value: Column, kind: T.DataType) -> Column:
    """Whether nothing is there: null, an empty list, or a list, map or struct all of whose parts are missing."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.forall(value, lambda x: is_missing(x, kind.elementType)), F.lit(True))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.forall(F.map_values(value), lambda x: is_missing(x, kind.valueType)), F.lit(True))
    if isinstance(kind, T.StructType):
        parts = [is_missing(value.getField(f.name), f.dataType) for f in kind.fields]
        found = F.lit(True)
        for p in parts:
            found = found & p
        return value.isNull() | found
    return value.isNull()
