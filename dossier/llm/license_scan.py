"""License scans by ordered signature rules, with column expressions only.

A text is taken as its words (lower-cased a-z, digits, characters beyond ASCII),
so rules see one spelling of punctuation and line breaks.  Every rule has

* an anchor, the word that its regex begins with: rules are tried only where it stands,
* a keyword that every match holds: a prefilter of the regex on the window of
  ``WINDOW`` words from the anchor, and through its stem of the whole text,
* a regex over the words of the window, a label, a priority and a weight.

A detection is the words that a rule's regex takes.  It is suppressed where the
interval of a detection of better rank contains its own: rank is the priority,
then the longer match, then the rule's place in the table.  Windows are short, so
only detections that begin within ``WINDOW`` words before can contain another one;
texts with many detections are resolved piece by piece.  Everything happens in
the row of the text: nothing is shuffled.

Base phrases are rules as well, of priority 0: nothing suppresses them.

Defined results
* null or empty text: no words, no labels ('' and score 0), null positions
* every row is scanned by itself; repeated rows repeat; other columns are ignored
* an empty table gives an empty table
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.durable import fresh

WINDOW = 24
#: Fixed phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Rule(NamedTuple):
    anchor: str
    keyword: str
    pattern: str  # over the words of a window, a space after each
    label: str
    priority: int
    weight: int  # hundredths
    sample: str  # words that it takes


#: Families: label; keyword; names as regexes over words; a sample name; ids as regexes and a sample id (both may be missing).
#: A name never begins with an optional word.
FAMILIES = (
    ("apache-2.0", "apache", r"apache (?:software )?license (?:version )?v?2(?: 0)?", "apache license version 2 0", r"apache 2 0", "apache 2 0"),
    ("apache-1.1", "apache", r"apache (?:software )?license (?:version )?v?1 1", "apache license version 1 1", r"apache 1 1", "apache 1 1"),
    ("mit", "mit", r"mit(?: expat)? licen[cs]e", "mit license", r"mit", "mit"),
    ("mit-0", "mit", r"mit no attribution licen[cs]e", "mit no attribution license", r"mit 0", "mit 0"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd 2 clause|two clause bsd|2 clause bsd) licen[cs]e", "bsd 2 clause license", r"bsd 2 clause", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|three clause bsd|3 clause bsd) licen[cs]e", "bsd 3 clause license", r"bsd 3 clause", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|old bsd|bsd 4 clause|four clause bsd) licen[cs]e", "original bsd license", r"bsd 4 clause", "bsd 4 clause"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", "bsd license", None, None),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause) licen[cs]e", "bsd zero clause license", r"0bsd", "0bsd"),
    ("isc", "isc", r"isc licen[cs]e", "isc license", r"isc", "isc"),
    ("gpl-1.0", "general", r"gnu general public licen[cs]e (?:version |v)1(?: 0)?", "gnu general public license version 1", None, None),
    ("gpl-2.0", "general", r"gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v)2(?: 0)?", "gnu general public license version 2", None, None),
    ("gpl-3.0", "general", r"gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v)3(?: 0)?", "gnu general public license version 3", None, None),
    ("gpl", "general", r"gnu general public licen[cs]e", "gnu general public license", None, None),
    ("gpl-2.0", "gpl", r"(?:gpl v?2|gplv2|gpl2)(?: 0)?(?: only| or later)?", "gpl 2 0", r"gpl 2 0(?: only| or later)?", "gpl 2 0 only"),
    ("gpl-3.0", "gpl", r"(?:gpl v?3|gplv3|gpl3)(?: 0)?(?: only| or later)?", "gpl 3 0", r"gpl 3 0(?: only| or later)?", "gpl 3 0 or later"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[cs]e (?:version |v)2 1", "gnu lesser general public license version 2 1", None, None),
    ("lgpl-3.0", "lesser", r"gnu lesser general public licen[cs]e (?:version |v)3(?: 0)?", "gnu lesser general public license version 3", None, None),
    ("lgpl", "general", r"gnu (?:lesser|library) general public licen[cs]e", "gnu lesser general public license", None, None),
    ("lgpl-2.1", "lgpl", r"(?:lgpl v?2|lgplv2|lgpl2) 1(?: only| or later)?", "lgpl 2 1", r"lgpl 2 1(?: only| or later)?", "lgpl 2 1 only"),
    ("lgpl-3.0", "lgpl", r"(?:lgpl v?3|lgplv3|lgpl3)(?: 0)?(?: only| or later)?", "lgpl 3 0", r"lgpl 3 0(?: only| or later)?", "lgpl 3 0 only"),
    ("agpl-3.0", "affero", r"gnu affero general public licen[cs]e (?:version |v)3(?: 0)?", "gnu affero general public license version 3", None, None),
    ("agpl", "affero", r"gnu affero general public licen[cs]e", "gnu affero general public license", None, None),
    ("agpl-3.0", "agpl", r"(?:agpl v?3|agplv3|agpl3)(?: 0)?(?: only| or later)?", "agpl 3 0", r"agpl 3 0(?: only| or later)?", "agpl 3 0 only"),
    ("gfdl", "documentation", r"gnu free documentation licen[cs]e", "gnu free documentation license", r"gfdl 1 [1-3](?: only| or later)?", "gfdl 1 3 only"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v)?1 1", "mozilla public license 1 1", r"mpl 1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e (?:version |v)?2 0", "mozilla public license 2 0", r"mpl 2 0", "mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e (?:version |v)?1 0", "eclipse public license 1 0", r"epl 1 0", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e (?:version |v)?2 0", "eclipse public license 2 0", r"epl 2 0", "epl 2 0"),
    ("eupl", "european", r"european union public licen[cs]e", "european union public license", r"eupl 1 [0-2]", "eupl 1 2"),
    ("cddl", "development", r"common development and distribution licen[cs]e", "common development and distribution license", r"cddl 1 [01]", "cddl 1 0"),
    ("cpl", "common", r"common public licen[cs]e", "common public license", r"cpl 1 0", "cpl 1 0"),
    ("artistic", "artistic", r"artistic licen[cs]e(?: (?:version )?[12] 0)?", "artistic license 2 0", r"artistic [12] 0", "artistic 2 0"),
    ("boost", "boost", r"boost software licen[cs]e", "boost software license", r"bsl 1 0", "bsl 1 0"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "zlib license", r"zlib", "zlib"),
    ("unlicense", "unlicense", r"unlicense", "unlicense", r"unlicense", "unlicense"),
    ("wtfpl", "want", r"do what the f\w+ you want to public licen[cs]e", "do what the fork you want to public license", r"wtfpl", "wtfpl"),
    ("psf", "python", r"python software foundation licen[cs]e", "python software foundation license", r"psf 2 0", "psf 2 0"),
    ("ofl", "font", r"sil open font licen[cs]e", "sil open font license", r"ofl 1 [01]", "ofl 1 1"),
    ("odbl", "database", r"open (?:data commons open )?database licen[cs]e", "open database license", r"odbl 1 0", "odbl 1 0"),
    ("odc-by", "attribution", r"open data commons attribution licen[cs]e", "open data commons attribution license", r"odc by 1 0", "odc by 1 0"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0 universal", r"cc0 1 0", "cc0 1 0"),
    ("cc-by", "by", r"cc by(?: [1-4] [05])?", "cc by 4 0", r"cc by [1-4] [05]", "cc by 4 0"),
    ("cc-by-sa", "sa", r"cc by sa(?: [1-4] [05])?", "cc by sa 4 0", r"cc by sa [1-4] [05]", "cc by sa 3 0"),
    ("cc-by-nc", "nc", r"cc by nc(?: [1-4] [05])?", "cc by nc 4 0", r"cc by nc [1-4] [05]", "cc by nc 4 0"),
    ("cc-by-nd", "nd", r"cc by nd(?: [1-4] [05])?", "cc by nd 4 0", r"cc by nd [1-4] [05]", "cc by nd 4 0"),
    ("cc-by-nc-sa", "sa", r"cc by nc sa(?: [1-4] [05])?", "cc by nc sa 4 0", r"cc by nc sa [1-4] [05]", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "nd", r"cc by nc nd(?: [1-4] [05])?", "cc by nc nd 4 0", r"cc by nc nd [1-4] [05]", "cc by nc nd 4 0"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", "creative commons attribution 4 0 international license", None, None),
    ("cc-by-sa", "sharealike", r"creative commons attribution sharealike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", "creative commons attribution sharealike 3 0 unported license", None, None),
    ("cc-by-nc", "noncommercial", r"creative commons attribution noncommercial(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", "creative commons attribution noncommercial 4 0 license", None, None),
    ("cc-by-nd", "noderivatives", r"creative commons attribution no ?derivatives(?: [1-4] [05])?", "creative commons attribution noderivatives 4 0", None, None),
    ("cc-by-nc-sa", "sharealike", r"creative commons attribution noncommercial sharealike(?: [1-4] [05])?", "creative commons attribution noncommercial sharealike 4 0", None, None),
    ("proprietary", "proprietary", r"(?:proprietary|commercial proprietary) licen[cs]e", "proprietary license", None, None),
)
#: Words that come before a name: their regex, a sample, the priority (1 best) and the weight.
FORMS = (
    (r"licen[cs]ed (?:to you )?(?:only )?under (?:the )?(?:terms of )?(?:the )?", "licensed under the", 2, 95),
    (r"released (?:\w+ )?under (?:the )?(?:terms of )?(?:the )?", "released under the", 2, 92),
    (r"distributed under (?:the )?(?:terms of )?(?:the )?", "distributed under the terms of the", 2, 90),
    (r"available under (?:the )?(?:terms of )?(?:the )?", "available under the", 2, 85),
    (r"redistribute (?:it )?and or modify (?:it )?under (?:the )?terms of (?:the )?", "redistribute it and or modify it under the terms of the", 2, 95),
    (r"under (?:the )?(?:terms of )?(?:the )?", "under the", 3, 70),
    ("", "", 4, 50),
)
#: Rules of their own: regex, keyword, label, priority, weight, sample.
CLAUSES = (
    (r"permission is hereby granted free of charge to any person obtaining a copy", "permission", "mit", 1, 98, None),
    (r"permission to use copy modify and or distribute this software for any purpose", "permission", "isc", 1, 96, None),
    (r"redistribution and use in source and binary forms", "redistribution", "bsd", 1, 96, None),
    (r"neither the name of (?:\w+ ){1,6}nor the names of its contributors", "contributors", "bsd-3-clause", 1, 97, "neither the name of acme nor the names of its contributors"),
    (r"all advertising materials mentioning features or use of this software", "advertising", "bsd-4-clause", 1, 97, None),
    (r"this program is free software you can redistribute it", "redistribute", "gpl", 1, 90, None),
    (r"this library is free software you can redistribute it", "redistribute", "lgpl", 1, 90, None),
    (r"you may not use this file except in compliance with the license", "compliance", "apache-2.0", 1, 93, None),
    (r"this source code form is subject to the terms of the mozilla public licen[cs]e", "mozilla", "mpl-2.0", 1, 98, "this source code form is subject to the terms of the mozilla public license"),
    (r"this is free and unencumbered software released into the public domain", "unencumbered", "unlicense", 1, 98, None),
    (r"released into the public domain", "domain", "public-domain", 2, 80, None),
    (r"dedicated to the public domain", "domain", "public-domain", 2, 80, None),
    (r"public domain", "domain", "public-domain", 3, 60, None),
    (r"software is provided as is without warranty of any kind", "warranty", "no-warranty", 3, 55, None),
    (r"creativecommons org publicdomain zero", "creativecommons", "cc0", 1, 95, None),
    (r"creativecommons org licenses by(?: [1-4] [05])?", "creativecommons", "cc-by", 2, 90, "creativecommons org licenses by 4 0"),
    (r"creativecommons org licenses by sa", "creativecommons", "cc-by-sa", 1, 95, None),
    (r"creativecommons org licenses by nc", "creativecommons", "cc-by-nc", 1, 95, None),
    (r"creativecommons org licenses by nd", "creativecommons", "cc-by-nd", 1, 95, None),
    (r"apache org licenses licen[cs]e 2 0", "apache", "apache-2.0", 1, 95, "apache org licenses license 2 0"),
    (r"opensource org licenses mit", "opensource", "mit", 1, 95, None),
    (r"www gnu org licenses", "gnu", "gpl", 3, 60, None),
    (r"all rights reserved", "rights", "reserved", 3, 70, None),
    (r"no part of this (?:\w+ ){1,3}may be reproduced", "reproduced", "reserved", 2, 85, "no part of this book may be reproduced"),
    (r"may not be (?:copied|reproduced|redistributed) without (?:prior )?(?:written )?(?:permission|consent)", "may", "reserved", 2, 80, "may not be reproduced without prior written permission"),
    (r"copyright c (?:19|20)\d\d", "copyright", "copyright", 4, 40, "copyright c 2020"),
    (r"copyright (?:19|20)\d\d", "copyright", "copyright", 4, 40, "copyright 2020"),
    (r"unauthorized (?:copying|distribution|use) (?:\w+ ){0,6}prohibited", "prohibited", "proprietary", 2, 80, "unauthorized copying of this file is strictly prohibited"),
    (r"confidential and proprietary", "proprietary", "proprietary", 2, 75, None),
)


def _anchors(pattern: str) -> list[tuple[str, str]]:
    """(first word, pattern with that word alone in front) for each word that a pattern can begin with."""
    if pattern.startswith("(?:"):
        inside, rest = pattern[3:].split(")", 1)
        return [a for one in inside.split("|") for a in _anchors(one + rest)]
    head, _, rest = pattern.partition(" ")
    if "(" in head:  # the first word has optional ones glued to it
        head = pattern[: pattern.index("(")]
        rest = pattern[len(head) :]
        return [(h, h + rest) for h in _spelled(head)]
    return [(h, f"{h} {rest}" if rest else h) for h in _spelled(head)]


def _spelled(word: str) -> list[str]:
    """The spellings of a word with a character class or an optional version letter."""
    if "[cs]" in word:
        return [word.replace("[cs]", c) for c in "cs"]
    if "?" in word or "[" in word:
        raise ValueError(f"a rule begins with {word!r}")
    return [word]


def rules() -> list[Rule]:
    """The ordered table: base phrases, clauses, ids, and every family in every form."""
    return list(_rules())


def _rules() -> Iterator[Rule]:
    for phrase, label in BASE.items():
        yield Rule(phrase.split(" ")[0], phrase.split(" ")[1], phrase, label, 0, 70, phrase)
    for pattern, keyword, label, priority, weight, sample in CLAUSES:
        for anchor, own in _anchors(pattern):
            yield Rule(anchor, keyword, own, label, priority, weight, sample or pattern)
    for label, keyword, name, sample, code, code_sample in FAMILIES:
        if code:
            yield Rule("spdx", "spdx", f"spdx license identifier {code}", label, 1, 99, f"spdx license identifier {code_sample}")
            yield Rule("license", "license", f"license {code}", label, 3, 65, f"license {code_sample}")
        for before, words, priority, weight in FORMS:
            for anchor, own in _anchors(before + name):
                yield Rule(anchor, keyword, own, label, priority, weight, f"{words} {sample}".strip())


#: Few strings of which every match of every rule holds one: a text without them has nothing to detect.
STEMS = ("cc", "public", "rights", "licen", "gpl", "spdx", "permission", "consent", "redistribut", "contributors", "advertising", "compliance", "warranty",
         "reproduced", "copyright", "prohibited", "proprietary", "opensource", "creativ", "gnu")


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


_RULE = "struct<keyword:string,pattern:string,label:string,priority:int,weight:int,order:int>"


def _by_anchor() -> Column:
    """anchor -> its rules in order, as one literal map."""
    by: dict[str, list[dict]] = {}
    for order, r in enumerate(rules()):
        by.setdefault(r.anchor, []).append({"keyword": r.keyword, "pattern": f"^(?:{r.pattern}) ", "label": r.label, "priority": r.priority, "weight": r.weight, "order": order})
    return F.from_json(F.lit(json.dumps(by)), f"map<string,array<{_RULE}>>")


def _better(y: Column, x: Column) -> Column:
    """Whether detection ``y`` contains ``x`` and ranks before it."""
    longer, shorter = y.end - y.start, x.end - x.start
    contains = (y.start <= x.start) & (y.end >= x.end)
    return contains & ((y.priority < x.priority) | (y.priority == x.priority) & ((longer > shorter) | (longer == shorter) & (y.order < x.order)))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with two columns of fresh names: the number of words and the detections by the place they begin at.

    The second is an array with one array for each place where a rule matches; a detection has start and end (in
    words), label, priority, weight and order.  Both are named by :func:`names`.
    """
    n_words, found = names(docs)
    low, gate, words, at = fresh(docs, "low", "gate", "words", "windows")
    raw = F.coalesce(F.col(text), F.lit(""))
    anchors = sorted({r.anchor for r in rules()})
    split = F.filter(F.split(F.translate(raw, UPPER, LOWER), GAP), lambda w: w != "")
    out = docs.withColumn(low, F.lower(raw))  # holds the stems that the text has once A-Z are lower-cased
    out = out.withColumn(gate, reduce(lambda a, b: a | b, [F.col(low).contains(s) for s in STEMS])).drop(low)
    out = out.withColumn(n_words, F.regexp_count(raw, F.lit(WORD)).cast("long")).withColumn(words, F.when(F.col(gate), split).otherwise(F.array().cast("array<string>")))
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())
    out = out.withColumn(at, F.transform(places, lambda i: F.struct(
        i.alias("start"), F.element_at(F.col(words), i + 1).alias("anchor"), F.concat(F.array_join(F.slice(F.col(words), i + 1, F.lit(WINDOW)), " "), F.lit(" ")).alias("text"))))
    table = _by_anchor()
    tried = lambda w: F.filter(F.element_at(table, w.anchor), lambda r: w.text.contains(r.keyword) & F.regexp_like(w.text, r.pattern))
    taken = lambda w, r: F.size(F.split(F.call_function("regexp_extract", w.text, r.pattern, F.lit(0)), " ")) - 1
    one = lambda w, r: F.struct(w.start.alias("start"), (w.start + taken(w, r)).alias("end"), r.label.alias("label"), r.priority.alias("priority"), r.weight.alias("weight"), r.order.alias("order"))
    out = out.withColumn(found, F.filter(F.transform(at, lambda w: F.transform(tried(w), lambda r: one(w, r))), lambda d: F.size(d) > 0))
    return out.drop(gate, words, at)


def names(docs: DataFrame) -> tuple[str, str]:
    """The names of the columns that :func:`detect` adds to ``docs``."""
    n_words, found = fresh(docs, "n_words", "found")
    return n_words, found


def kept(found: Column) -> Column:
    """The detections of :func:`detect` that nothing suppresses, as one array by start."""

    def near(k: Column) -> Column:  # only what begins within WINDOW words before can contain; those are WINDOW places at most
        return F.flatten(F.slice(found, F.greatest(k - WINDOW, F.lit(0)) + 1, F.least(k, F.lit(WINDOW)) + 1))

    return F.flatten(F.transform(found, lambda own, k: F.filter(own, lambda x: (x.priority == 0) | ~F.exists(near(k), lambda y: _better(y, x)))))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the detections kept."""
    own = docs.select("doc_id", "text")
    n_words, found = names(own)
    own = detect(own).withColumn("detections", kept(F.col(found)))
    base = F.filter("detections", lambda d: d.priority == 0)
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(F.transform(c, lambda d: d.label))), ",")
    start = F.transform("base", lambda d: d.start)
    labels = F.size(F.array_distinct(F.transform("detections", lambda d: d.label)))
    points = F.least(F.array_max(F.transform("detections", lambda d: d.weight)) + 2 * (labels - 1), F.lit(100))
    return own.withColumn("base", base).select(
        "doc_id", F.col(n_words).alias("n_words"), F.size("base").cast("long").alias("n_base"), F.array_min(start).cast("long").alias("first_word"), F.array_max(start).cast("long").alias("last_word"),
        joined("base").alias("base_labels"), joined("detections").alias("labels"), F.when(labels == 0, 0.0).otherwise(points / 100.0).alias("score"),
        F.transform("detections", lambda d: F.struct(d.start.alias("start"), d.end.alias("end"), d.label.alias("label"), d.weight.alias("weight"))).alias("detections"),
    )
