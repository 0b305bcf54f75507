"""Text expressions: white space, retrieval and answer tokens, overlap F1, redaction.

All are Catalyst expressions; :func:`fold_exact` is the Arrow fallback for text
whose compatibility normal form differs from itself.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# They must equal the published tokenisers and masks for equal results.
RETRIEVAL_TOKEN = r"\p{Nd}{1,3}(?:,\p{Nd}{3})+(?:\.\p{Nd}+)?%?|[\p{L}\p{N}_]+(?:[.\-'’][\p{L}\p{N}_]+)*%?"
ANSWER_TOKEN = r"[a-z0-9]+(?:[.$%][a-z0-9]+)?"
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
INVISIBLE = "​﻿­"
SECRET_KEY = r"sk-[A-Za-z0-9_-]{12,}"
PRIVATE_MASKS = (
    r"(?i)\b(?:sk-|sk_)[a-z0-9_-]+",
    r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}",
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"(?<!\d)(?:\+1[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)",
)
#: Part of whatever one of the masks finds, so that most texts are looked at once.
PRIVATE_HINT = r"@|\d{3}\)?[ .-]\d|[sS][kK][_-]"
SENSITIVE_KEY = re.compile(
    r"(?i)(secret|password|authorization|user.agent|api.key|environment|prompt|raw.model|email|phone|ssn|personal|address|full.name|birth.date)"
)
REDACTED = "[REDACTED]"


def collapse_space(text: Column) -> Column:
    """Drop invisible characters, make every run of white space one blank, strip."""
    shown = F.translate(text, INVISIBLE, "")
    return F.trim(F.regexp_replace(shown, SPACE + "+", " "))


def nonspace_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def strip_right(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + r"+\z", "")


#: A character for which lower case is not the compatibility form with full case folding: all but ASCII,
#: the accented letters of Latin-1, and common dashes, quotes and signs.  Sharp s, which folds to ss, is in it.
NEEDS_FOLDING = "(?=[^\\x00-\\x7F])[^\\x00-\\x7F\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u00ff\u2010\u2012-\u2015\u2018-\u201e\u2020-\u2022\u20ac]"


def retrieval_tokens(text: Column, folded: bool = False) -> Column:
    """Tokens for ranking; numbers lose their commas.  ``folded``: the text is in folded form already."""
    plain = F.coalesce(text, F.lit(""))
    if not folded:
        plain = F.replace(F.lower(plain), F.lit("ß"), F.lit("ss"))
    signs = F.contains(plain, F.lit("’")) | F.contains(plain, F.lit("‐")) | F.contains(plain, F.lit("‑"))
    found = F.regexp_extract_all(F.when(signs, F.translate(plain, "’‐‑", "'--")).otherwise(plain), F.lit(RETRIEVAL_TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.replace(t, F.lit(","), F.lit("")))  # only numbers hold commas


@F.pandas_udf(StringType())
def fold_exact(text: pd.Series) -> pd.Series:
    """Compatibility composition and full case folding, for text outside the common case."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def answer_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({ANSWER_TOKEN})"), F.lit(1))


def _overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    def least(t: Column) -> Column:
        return F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t)))

    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, t: s + least(t))


def token_f1(answer: Column, expected: Column) -> Column:
    """Multiset F1 of answer tokens; 0 without overlap."""
    a, b = answer_tokens(answer), answer_tokens(expected)
    common = _overlap(a, b)
    return F.when(common == 0, F.lit(0.0)).otherwise(2.0 * common / (F.size(a) + F.size(b)))


def mask_private(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Known secrets (longest first), keys, e-mail, social-security and phone numbers."""
    for s in sorted({s for s in secrets if s}, key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit(REDACTED))
    hidden = text
    for mask in PRIVATE_MASKS:
        hidden = F.regexp_replace(hidden, mask, REDACTED.replace("[", r"\[").replace("]", r"\]"))
    return F.when(text.rlike(PRIVATE_HINT), hidden).otherwise(text)


def mask_keys(text: Column, secret: str | None = None) -> Column:
    """Mask one known secret and anything that looks like a provider key."""
    if secret:
        text = F.replace(text, F.lit(secret), F.lit(REDACTED))
    return F.regexp_replace(text, SECRET_KEY, REDACTED.replace("[", r"\[").replace("]", r"\]"))


def mask_tree(value, secrets: tuple[str, ...] = ()):
    """A copy of a parsed JSON value whose strings and keys are masked; values under sensitive keys go whole."""
    known = sorted(filter(None, set(secrets)), key=len, reverse=True)
    patterns = [re.compile(mask.replace(r"\p{L}\p{N}_", r"\w")) for mask in PRIVATE_MASKS]

    def masked(text: str) -> str:
        for s in known:
            text = text.replace(s, REDACTED)
        for one in patterns:
            text = one.sub(REDACTED, text)
        return text

    top: list = [None]
    todo = [(top, 0, value)]  # (container, place in it, value)
    while todo:
        into, at, v = todo.pop()
        if isinstance(v, str):
            into[at] = masked(v)
        elif isinstance(v, dict):
            into[at] = made = {}
            for name, x in ((str(k), x) for k, x in v.items()):
                hide = SENSITIVE_KEY.search(name)
                name = masked(name)
                made[name] = REDACTED
                if not hide:
                    todo.append((made, name, x))
        elif isinstance(v, (list, tuple)):
            into[at] = [None] * len(v)
            todo += [(into[at], i, x) for i, x in enumerate(v)]
        else:
            into[at] = v
    return top[0]


def mask_json(column: Column, secrets: tuple[str, ...] = ()) -> Column:
    """:func:`mask_tree` over a column of JSON documents, in Arrow batches."""
    import json

    @F.pandas_udf(StringType())
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: None if r is None else json.dumps(mask_tree(json.loads(r), secrets), ensure_ascii=False, sort_keys=True))

    return run(column)
