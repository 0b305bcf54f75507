"""Masks for nested columns, made from their type: no value leaves the JVM.

Strings lose what looks private, map keys too, and what stands under a sensitive
name becomes one mask.  The same as ``text.mask_tree`` on the value as JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.text import REDACTED, SENSITIVE_KEY, mask_private


def masked(value: Column, kind: T.DataType, secrets: tuple[str, ...] = ()) -> Column:
    """``value`` of type ``kind`` with its strings masked; a field with a sensitive name is a masked string."""
    if isinstance(kind, T.StringType):
        return mask_private(value, secrets)
    if isinstance(kind, T.StructType):
        fields = [F.lit(REDACTED).alias(f.name) if SENSITIVE_KEY.search(f.name) else masked(value.getField(f.name), f.dataType, secrets).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, T.ArrayType) and _has_text(kind.elementType):
        return F.transform(value, lambda x: masked(x, kind.elementType, secrets))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        if not isinstance(kind.valueType, T.StringType):
            raise TypeError("a map's values can be masked where they are strings, as a sensitive key's value becomes one")
        hide = lambda k: k.rlike(SENSITIVE_KEY.pattern)
        entry = lambda e: F.struct(mask_private(e["key"], secrets), F.when(hide(e["key"]), F.lit(REDACTED)).otherwise(mask_private(e["value"], secrets)))
        return F.map_from_entries(F.transform(F.map_entries(value), entry))
    return value


def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_text(kind.elementType)
    return isinstance(kind, (T.StringType, T.StructType, T.MapType))
