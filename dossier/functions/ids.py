"""Content-addressed identifiers: SHA-256 of canonical JSON."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical(value) -> str:
    """Sorted keys, no blanks, no NaN."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def _quoted(text: Column) -> Column:
    """A JSON string; to_json escapes as JSON does and leaves non-ASCII letters."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def record_digest(strings: dict[str, Column] | None = None, numbers: dict[str, Column] | None = None) -> Column:
    """Digest of a flat record: a fixed template with its keys in order."""
    parts = {k: _quoted(v) for k, v in (strings or {}).items()} | {k: v.cast("string") for k, v in (numbers or {}).items()}
    out = []
    for i, k in enumerate(sorted(parts)):
        out += [F.lit(("," if i else "{") + json.dumps(k) + ":"), F.coalesce(parts[k], F.lit("null"))]
    return F.sha2(F.concat(*out, F.lit("}")), 256)


@F.pandas_udf(StringType())
def nested_digest(raw: pd.Series) -> pd.Series:
    """Digest of nested JSON documents given as text."""
    return raw.map(lambda r: None if r is None else digest(json.loads(r)))


def pad_cik(cik: Column) -> Column:
    """Ten digits; longer values stay as they are."""
    c = F.trim(cik.cast("string"))
    return F.when(F.length(c) >= 10, c).otherwise(F.lpad(c, 10, "0"))
