"""Canonical JSON of any nested column as an expression made from its type.

Keys are sorted, nulls stay, nothing is blank, and non-ASCII letters stay as they
are, as ``json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))``
writes it.  Floating-point numbers have no canonical text here and are refused.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAMED = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_OTHERS = {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in _NAMED}


def quoted(text: Column) -> Column:
    """A JSON string."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, name in _NAMED.items():
        plain = F.replace(plain, F.lit(c), F.lit(name))
    rare = plain
    for c, name in _OTHERS.items():
        rare = F.replace(rare, F.lit(c), F.lit(name))
    odd = "[" + "".join(f"\\x{ord(c):02x}" for c in _OTHERS) + "]"
    body = F.when(~text.rlike(r'[\x00-\x1f"\\]'), text).when(~text.rlike(odd), plain).otherwise(rare)
    return F.concat(F.lit('"'), body, F.lit('"'))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """The canonical JSON of ``value``, a column of type ``kind``; never null."""
    if isinstance(kind, T.StringType):
        made = quoted(value)
    elif isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        made = value.cast("string")
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    elif isinstance(kind, T.ArrayType):
        made = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entry = lambda k: F.concat(quoted(k), F.lit(":"), canonical_json(F.element_at(value, k), kind.valueType))
        made = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(value)), entry), ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        parts = []
        for f in sorted(kind.fields, key=lambda f: f.name):
            parts += [F.lit(("," if parts else "{") + json.dumps(f.name, ensure_ascii=False) + ":"), canonical_json(value.getField(f.name), f.dataType)]
        made = F.concat(*parts, F.lit("}")) if parts else F.lit("{}")
        return F.when(value.isNull(), F.lit("null")).otherwise(made)
    else:
        raise TypeError(f"no canonical JSON for {kind.simpleString()}")
    return F.coalesce(made, F.lit("null"))


def row_json(df: DataFrame, *columns: str) -> Column:
    """Canonical JSON of each row of ``df`` as an object of ``columns`` (all of them by default)."""
    parts = []
    for name in sorted(columns or df.columns):
        parts += [F.lit(("," if parts else "{") + json.dumps(name, ensure_ascii=False) + ":"), canonical_json(F.col(name), df.schema[name].dataType)]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def row_digest(df: DataFrame, *columns: str) -> Column:
    """SHA-256 of :func:`row_json`."""
    return F.sha2(row_json(df, *columns), 256)
