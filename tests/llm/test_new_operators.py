"""License scans, token alignment and vector codes against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from dossier.llm import license_scan, mixing, quality, queries, token_align, vector_codes
from tests.llm import corpus

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
_LOWER = str.maketrans(license_scan.UPPER, license_scan.LOWER)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ---- license scans


def plain_scan(text):
    words = _WORD.findall((text or "").translate(_LOWER))
    found = []
    for i in range(len(words)):
        window = " ".join(words[i : i + license_scan.WINDOW]) + " "
        for k, r in enumerate(license_scan.rules()):
            if r.anchor == words[i] and (m := re.match(f"(?:{r.pattern}) ", window)):
                found.append((i, i + m[0].count(" "), r.label, r.priority, r.weight, k))
    beats = lambda y, x: y[0] <= x[0] and y[1] >= x[1] and (y[3], y[0] - y[1], y[5]) < (x[3], x[0] - x[1], x[5])
    kept = [x for x in found if x[3] == 0 or not any(beats(y, x) for y in found)]
    starts = [x[0] for x in kept if x[3] == 0]
    labels = sorted({x[2] for x in kept})
    score = min(100, max(x[4] for x in kept) + 2 * (len(labels) - 1)) / 100 if kept else 0.0
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x[2] for x in kept if x[3] == 0})), ",".join(labels), score


LICENSED = [
    "Licensed under CC BY-NC 4.0.", "CC\n\tby cc-BY; Cc  By", "GNU General Public License, version 3. All rights reserved, ALL RIGHTS RESERVED!", "SPDX-License-Identifier: GPL-2.0-only",
    "released under the MIT License", "You may redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1", "ccé by cc byK licenİse mit", "accord by all right",
    "Copyright (c) 2020 Acme. Redistribution and use in source and binary forms", "http://creativecommons.org/licenses/by-sa/4.0/", "GPLv3 or LGPL v2.1 or AGPL-3.0", "cc", "by", "cc by", "all rights reserved " * 700, "x" * 5000 + " cc by",
    "the work " * 4000 + "is licensed under the Apache License, Version 2.0", "general public\x00license general\x7fpublic/license", "Unauthorized copying of this file, via any medium, is strictly prohibited",
]


def test_license_scan_against_plain(spark):
    texts = [r[1] for r in corpus.rows(5, 20)] + LICENSED
    rows = [(i if i else None, t, "clash", i) for i, t in enumerate(texts)] + [(3, texts[3], "clash", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, n_words int")
    out = license_scan.scan_licenses(df).drop("detections")
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted([(r[0], *plain_scan(r[1])) for r in rows], key=repr)
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_rules_take_their_samples_and_pass_their_gates():
    rules = license_scan.rules()
    assert len(rules) > 300 and len({r.label for r in rules}) > 30
    by = defaultdict(list)
    for r in rules:
        assert r.keyword in r.sample and any(s in r.sample for s in license_scan.STEMS) and len(r.sample.split()) <= license_scan.WINDOW, r
        assert r.pattern.startswith(r.anchor), r
        by[r.sample, r.label].append(r)
    for (sample, label), own in by.items():
        assert any(re.match(f"(?:{r.pattern}) ", sample + " ") for r in own), (sample, label)


def test_license_scan_stays_in_columns(spark):
    docs = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")
    plan = license_scan.scan_licenses(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "Join" not in plan and "Exchange" not in license_scan.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()


# ---- token alignment


def plain_alignment(rows):
    c = token_align.SegmentPairs(A, B)
    name = lambda table, i: bytes(table.joined(np.array([i])))
    docs, total = [], Counter()
    for doc_id, text in rows:
        if not text:
            docs.append((doc_id, None))
            continue
        raw = (" " + text).encode()
        a, b = c.a.encode(" " + text, add_special_tokens=False).ids, c.b.encode(text)
        ab, bb = [name(c.a_bytes, i) for i in a], [name(c.b_bytes, i) for i in b]
        if b"".join(ab) != raw or b"".join(bb) != raw:
            docs.append((doc_id, None))
            continue
        ae, be = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if max(ae[i] - len(ab[i]), be[j] - len(bb[j])) < min(ae[i], be[j])] if len(a) < 600 else _swept(a, b, ae, be, ab, bb)
        total.update(links)
        groups, i, j = [], 0, 0
        for cut in sorted(set(ae) & set(be)):
            m, n = ae.index(cut, i) + 1, be.index(cut, j) + 1
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            i, j = m, n
        docs.append((doc_id, (len(a), len(b), len(groups), links, ";".join(groups))))
    top = defaultdict(int)
    for (_, y), n in total.items():
        top[y] = max(top[y], n)
    return [(d, 0, 0, 0, 0, 0, 0, "") if x is None else (d, *x[:3], len(x[3]), sum(total[k] == top[k[1]] for k in x[3]), sum(total[k] for k in x[3]), hashlib.sha256(x[4].encode()).hexdigest()) for d, x in docs]


def _swept(a, b, ae, be, ab, bb):
    out, j = [], 0
    for i, x in enumerate(a):
        s = ae[i] - len(ab[i])
        while be[j] <= s:
            j += 1
        k = j
        while k < len(b) and be[k] - len(bb[k]) < ae[i]:
            out.append((x, b[k]))
            k += 1
    return out


ODD = ["a  b", "  ", " ", "a ", " a", "x\n  y\t z", "<|endoftext|> it", "a▁b and more", "<s> é ①\x00 日本語", "   \n   x    y", "don't  we're", "  x  y", "<0x41> <unk>", "z" * 3000, "tail \n", "​👩‍👩‍👧 ok"]


def test_alignment_against_plain(spark, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK_BYTES", 4000)
    rows = [(r[0], r[1]) for r in corpus.rows(3, 30)] + [(500 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, block int, pair int").repartition(3)
    out = token_align.align_documents(df, A, B)
    assert [f.name for f in out.schema] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(plain_alignment(rows), key=repr)
    assert token_align.align_documents(df.limit(0), A, B).count() == 0


def test_segments_beyond_the_memory_are_encoded_again():
    few, many = token_align.SegmentPairs(A, B, most=5), token_align.SegmentPairs(A, B)
    texts = [r[1] for r in corpus.rows(9, 12)] + ODD
    for part in (texts[:9], texts[9:], texts):
        one, two = few.block(part), many.block(part)
        assert one[1] == two[1] and {k: v.tolist() for k, v in one[0].items()} == {k: v.tolist() for k, v in two[0].items()}


def test_segments_are_encoded_and_aligned_in_small_groups(monkeypatch):
    texts = ["".join(f"w{i * k % 97} x{i}  y\u2581{'z' * (i % 4)}\n" for i in range(40)) for k in range(1, 6)] + ["", None, " ", "plain text"]
    whole = token_align.SegmentPairs(A, B).block(texts)
    monkeypatch.setattr(token_align, "SEGMENTS", 7, raising=False)
    c, sizes = token_align.SegmentPairs(A, B), []
    learn, aligned = c._learn, c.aligned
    monkeypatch.setattr(c, "_learn", lambda new: (sizes.append(len(new)), learn(new))[1])
    monkeypatch.setattr(c, "aligned", lambda own: (sizes.append(len(own)), aligned(own))[1])
    for a, b in zip(c.block(texts), whole):
        assert a.keys() == b.keys() and all(map(np.array_equal, a.values(), b.values())) if isinstance(a, dict) else np.array_equal(a, b)
    assert len(sizes) > 2 and max(sizes) <= 7


def test_bitset_rank_and_select():
    r = random.Random(1)
    for size in (1, 63, 64, 65, 1000):
        at = sorted(r.sample(range(size), max(1, size // 3)))
        bits = token_align.Bits(np.array(at), size)
        assert bits.select().tolist() == at
        assert bits.rank(np.arange(size + 1)).tolist() == [sum(x < i for x in at) for i in range(size + 1)]


# ---- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, _, v in kept) // parts)
    kept = [(i, label, v + [0] * (parts * width - len(v))) for i, label, v in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda x: (x[0] is None, x[0] or 0, x[2]))[:entries]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    apart = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x, book: min((apart(x, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, _, v in kept:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    coded = [(i, label, [near(cut(v, p), books[p]) for p in range(parts)]) for i, label, v in kept]
    sums = defaultdict(int)
    for _, label, best in coded:
        sums[label] += sum(d for d, _ in best)
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), sums[label], sha) for i, label, best in coded]


@pytest.mark.parametrize("n, dims", [(150, 64), (40, 32), (90, 20)])
def test_codes_against_plain(spark, n, dims):
    r = np.random.default_rng(n)
    x = (r.normal(size=(n, dims)) * 0.2).astype(np.float32)
    x[10:40] = x[5]  # repeated vectors, hence ties among the first entries
    x[50:60] = np.round(x[50:60] * 4) / 4
    rows = [(int(i), v.tolist(), None if i % 7 == 0 else int(i % 3)) for i, v in zip(r.permutation(n), x)]
    rows += [(900, None, 1), (901, [float("nan")] * dims, 1), (902, [1.0, None], 2), (903, [float("inf")] + [0.0] * (dims - 1), 1), (None, x[0].tolist(), 1), (4, x[1].tolist(), 2), (905, [0.5] * (dims - 3), 0), (906, [], 0)]
    df = spark.createDataFrame([(*q, "c") for q in rows], "vec_id long, embedding array<float>, label int, v string").repartition(3)
    out = vector_codes.compress(df)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(plain_codes(rows), key=repr)
    assert vector_codes.compress(df.limit(0)).count() == 0


def test_screening_is_exact_where_entries_are_close():
    r = np.random.default_rng(3)
    for scale in (3, 1000, 1 << 20, 1 << 25):
        book = r.integers(-scale, scale + 1, (64, 4))
        book[32:] = book[:32] + r.integers(-1, 2, (32, 4))
        x = np.concatenate([r.integers(-scale, scale + 1, (500, 4)), book, (book[:1] + book[1:2]) // 2])
        code, error, again = vector_codes.nearest(x, book)
        all_ = ((x[:, None] - book) ** 2).sum(axis=2)
        assert (code == all_.argmin(axis=1)).all() and (error == all_.min(axis=1)).all()
        assert again < x.shape[0] * 64


def test_rare_labels_meet_their_sums_in_a_join(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 3)
    rows = [(i, "x" if i % 2 else f"l{i % 10}", "00", i) for i in range(60)] + [(60, None, "00", 5), (61, None, "00", 6)]
    got = {q.vec_id: q.label_error for q in vector_codes.with_label_error(spark.createDataFrame(rows, "vec_id long, label string, code string, error long")).collect()}
    sums = Counter()
    for _, label, _, e in rows:
        sums[label] += e
    assert got == {i: sums[label] for i, label, _, _ in rows}


def test_new_queries_over_given_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(map(tuple, queries.op12_token_alignment(spark, sf).collect()), key=repr)
    assert got == sorted(plain_alignment([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op13_vector_codes(spark, sf).collect()), key=repr) == sorted(plain_codes(rows), key=repr)


# ---- changed operators


def test_mixes_agree_for_rows_of_one_id(spark):
    rows = [(i // 8, f"w{i} " * (5 + i % 2), "s", {"k": i}) for i in range(80)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more map<string,int>")
    texts = [sorted(str(r.text) for r in mixing.apply_mix(docs.repartition(n, "text")).collect()) for n in (1, 3, 7)]
    assert texts[0] == texts[1] == texts[2]


def test_the_knapsack_table_is_bounded(monkeypatch):
    monkeypatch.setattr(mixing, "MOST_TABLE", 1 << 18)
    lengths, counts, budget = [99_991, 100_003], [2000, 2000], 100_000_005
    take = mixing.fit_counts(lengths, counts, budget, [0, 1])
    have = sum(a * b for a, b in zip(lengths, take))
    assert 0 <= budget - have <= 100_003 and all(0 <= t <= c for t, c in zip(take, counts))


def test_one_row_of_a_labelled_id_reaches_the_fit(spark):
    texts = ["good words here " * 8, "bad junk spam " * 8]
    rows = [(i % 20, texts[i % 2] + str(i % 20), "s", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    once, many = (quality._fit(d, labels, 100, quality.BINS) for d in (docs.dropDuplicates(["doc_id"]), docs))
    for t in quality.TARGETS:
        assert np.array_equal(once[t][0], many[t][0]) and once[t][1] == many[t][1]
