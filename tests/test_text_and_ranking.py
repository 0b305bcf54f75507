"""Tokens, BM25, fusion, cosine, evidence and reranking: golden values and plain models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.functions import ids, text
from dossier.operators import dense, evidence, lexical, rerank


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("raw, want", [
    ("$133,749", ["133749"]), ("71.1%", ["71.1%"]), ("U.S.", ["u.s"]), ("NVIDIA’s NON‑GAAP", ["nvidia's", "non-gaap"]), ("", []), (None, []), ("a-b, c", ["a-b", "c"]), ("STRAßE", ["strasse"]),
])
def test_retrieval_tokens(spark, raw, want):
    assert one(spark, raw, text.retrieval_tokens) == want


def test_exact_fold(spark):
    got = spark.createDataFrame([("２０２６",), ("ﬁx",)], "t string").select(text.retrieval_tokens(text.fold_exact("t")).alias("x")).collect()
    assert [r.x for r in got] == [["2026"], ["fix"]]


@pytest.mark.parametrize("a, b, want", [("Revenue was $100", "revenue was 100", 1.0), ("a", "b", 0.0), ("", "x", 0.0), ("x x y", "x y y", 2 / 3), ("71%", "71", 1.0)])
def test_token_f1(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(text.token_f1(F.col("a"), F.col("b")).alias("x")).first().x
    assert got == pytest.approx(want)


def test_space_and_masks(spark):
    assert one(spark, "﻿ a  b​ \n c ", text.collapse_space) == "a b c"
    assert one(spark, " a\tb  ", text.nonspace_length) == 2
    masked = one(spark, "mail a.b@c.org ssn 123-45-6789 tel (212) 555-1234 key sk-abcDEF123456 top secret7", lambda c: text.mask_private(c, ("secret7",)))
    assert masked.count(text.REDACTED) == 5 and "555" not in masked
    assert text.mask_tree({"Email": "x", "v": ["a@b.co", 3]}) == {"Email": text.REDACTED, "v": [text.REDACTED, 3]}


def test_digests(spark):
    row = spark.createDataFrame([("é\"x", 3)], "a string, n int").select(ids.record_digest({"a": F.col("a")}, {"n": F.col("n")}).alias("d")).first()
    assert row.d == ids.digest({"a": "é\"x", "n": 3})
    assert [r.c for r in spark.createDataFrame([("12",), ("12345678901",)], "c string").select(ids.pad_cik(F.col("c")).alias("c")).collect()] == ["0000000012", "12345678901"]


def _tokens(spark, texts):
    return lexical.document_tokens(spark.createDataFrame(texts, "doc_id string, text string"))


def _questions(spark, *texts):
    return lexical.as_questions(spark.createDataFrame(list(enumerate(texts)), "qid int, t string"), F.col("qid"), F.col("t"))


def test_bm25_golden(spark):
    t = _tokens(spark, [("a", "revenue revenue"), ("b", "revenue"), ("c", "cloud")])
    q = _questions(spark, "revenue", "revenue revenue")
    got = {(r.qid, r.id): r.score for r in lexical.full_ranking(lexical.bm25_scores(t, q), t, q).collect()}
    want = math.log(1 + 1.5 / 2.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 2 / (4 / 3)))
    assert got[0, "a"] == pytest.approx(want, abs=1e-6) and got[0, "c"] == 0 and got[1, "a"] == got[0, "a"]


def test_ranks_and_ties(spark):
    texts = [("b", ""), ("a", ""), ("d", "x y"), ("c", "x"), ("e", "x")]
    t, q = _tokens(spark, texts), _questions(spark, "x", "nothing")
    s = lexical.bm25_scores(t, q)
    full = lexical.full_ranking(s, t, q).collect()
    order = lambda k: [r.id for r in sorted((r for r in full if r.qid == k), key=lambda r: r["rank"])]
    assert order(0) == ["c", "e", "d", "a", "b"] and order(1) == ["a", "b", "c", "d", "e"]
    top = {(r.qid, r.id): r["rank"] for r in lexical.top_ranked(s, t, q, 4).collect()}
    assert top == {(r.qid, r.id): r["rank"] for r in full if r["rank"] <= 4}
    every = q.select("qid").join(t.select("id"))
    assert {(r.qid, r.id): r["rank"] for r in lexical.rank_within(s, t, every).collect()} == {(r.qid, r.id): r["rank"] for r in full}


@pytest.mark.parametrize("k1, b", [(0, 0.5), (float("nan"), 0.5), (1.2, 1.5)])
def test_bm25_rejects_parameters(k1, b):
    with pytest.raises(ValueError):
        lexical.check_bm25(k1, b)


def test_fusion(spark):
    r = lambda xs: spark.createDataFrame([(0, x, i) for i, x in enumerate(xs, 1)], "qid int, id string, rank int")
    got = lexical.fuse_rankings([r("abc"), r("bca")], 60).orderBy("rank").collect()
    assert [g.id for g in got] == ["b", "a", "c"] and got[0].score == pytest.approx(1 / 62 + 1 / 61)
    assert [g.id for g in lexical.fuse_rankings([r("ab"), r("ba")], 0).orderBy("rank").collect()] == ["a", "b"]
    assert [g.id for g in lexical.fuse_rankings([r("abc"), r("bca")], 60, 1).orderBy("rank").collect()] == ["a", "b"]
    for bad in ({"constant": -1}, {"depth": 0}, {"depth": True}):
        with pytest.raises(ValueError):
            lexical.fuse_rankings([r("a")], **bad)


def test_cosine(spark):
    v = spark.createDataFrame([("d", [0.0, 2.0]), ("b", [3.0, 0.0]), ("a", [1.0, 0.0]), ("c", [-1.0, 0.0])], "id string, vector array<float>")
    q = spark.createDataFrame([(0, [2.0, 0.0])], "qid int, vector array<float>")
    got = dense.cosine_top(v, q, 4).orderBy("rank").collect()
    assert [(g.id, g.score) for g in got] == [("a", 1.0), ("b", 1.0), ("d", 0.0), ("c", -1.0)]
    with pytest.raises(ValueError):
        dense.cosine_top(v, spark.createDataFrame([(0, [0.0, 0.0])], q.schema), 1)


def test_encoder_cache(spark):
    e = dense.HashingEncoder(8)
    rec = spark.createDataFrame([("x", "some words"), ("y", "other words")], "id string, text string")
    first = dense.encode_cached(rec, spark.createDataFrame([], "key string, vector array<float>"), e, "v1")
    assert {r.hit for r in first.collect()} == {False}
    cache = first.select(dense.cache_key("v1", "document", F.col("id"), F.col("text")).alias("key"), "vector")
    changed = spark.createDataFrame([("x", "some words"), ("y", "new words")], rec.schema)
    assert {r.id: r.hit for r in dense.encode_cached(changed, cache, e, "v1").collect()} == {"x": True, "y": False}
    assert {r.hit for r in dense.encode_cached(rec, cache, e, "v2").collect()} == {False}


def _spans(spark, rows):
    return spark.createDataFrame([("d", f"c{i}", a, b, "x" * (b - a)) for i, (a, b) in enumerate(rows)], "document_id string, chunk_id string, start_char int, end_char int, text string")


def _gold(spark, t="x" * 100):
    return spark.createDataFrame([("e", 0, "d", 0, len(t), t)], "evidence_id string, qid int, document_id string, start_char int, end_char int, text string")


def test_evidence_match_policy(spark):
    o = evidence.overlaps(_spans(spark, [(0, 50), (80, 100), (0, 40)]), _gold(spark))
    assert sorted(r.chunk_id for r in evidence.matches(o).collect()) == ["c0"]
    short = evidence.overlaps(_spans(spark, [(0, 5)]).withColumn("text", F.lit("None.")), _gold(spark, "None."))
    assert evidence.matches(short).count() == 1
    assert evidence.overlaps(_spans(spark, [(0, 5)]).withColumn("text", F.lit("     ")), _gold(spark, "     ")).count() == 0


@pytest.mark.parametrize("spans, want", [([(0, 40), (20, 60), (60, 100)], 1.0), ([(0, 40), (0, 40)], 0.4)])
def test_union_coverage(spark, spans, want):
    o = evidence.overlaps(_spans(spark, spans), _gold(spark))
    assert evidence.union_coverage(o, _gold(spark), ["evidence_id"]).first().covered == pytest.approx(want)


def test_union_coverage_against_sets(spark):
    r = random.Random(4)
    spans = [(a, a + r.randint(1, 30)) for a in (r.randint(0, 70) for _ in range(12))]
    covered = set().union(*[set(range(a, b)) for a, b in spans])
    o = evidence.overlaps(_spans(spark, spans), _gold(spark))
    assert evidence.union_coverage(o, _gold(spark), ["evidence_id"]).first().covered == pytest.approx(len(covered) / 100)


def test_two_document_question(spark):
    text_ = "x" * 50
    chunks = spark.createDataFrame([(d, d.upper(), 0, 50, text_) for d in "abc"], "document_id string, chunk_id string, start_char int, end_char int, text string")
    gold = spark.createDataFrame([("ea", 1, "a", 0, 50, text_), ("eb", 1, "b", 0, 50, text_)], "evidence_id string, qid int, document_id string, start_char int, end_char int, text string")
    ranked = spark.createDataFrame([("s", 1, c, i) for i, c in enumerate("CAXB", 1)], "system string, qid int, chunk_id string, rank int")
    q = spark.createDataFrame([(1, True, True), (2, False, False)], "qid int, answerable boolean, multi boolean")
    rows = evidence.question_metrics(ranked, evidence.overlaps(chunks, gold), gold, q).collect()
    m = rows[0]
    assert len(rows) == 1 and (m.reciprocal_rank, m.recall_1, m.recall_3, m.recall_5, m.multi_3, m.multi_5, m.union_5) == (0.5, 0, 0.5, 1, 0, 1, 1)


def test_complementarity(spark):
    recall = {"one": (1.0, 0.0, 0.5), "two": (0.0, 1.0, 1.0), "three": (0.5, 0.5, 1.0), "four": (0.0, 0.0, 0.0)}
    rows = [(s, q, v[i]) for q, v in recall.items() for i, s in enumerate(("dense", "bm25", "hybrid"))]
    got = {}
    for r in evidence.complementarity(spark.createDataFrame(rows, "system string, qid string, recall_10 double"), "dense", "bm25", "hybrid").collect():
        got.setdefault(r.grp, set()).add(r.qid)
    assert got == {"a_not_b": {"one"}, "b_not_a": {"two"}, "only_both": {"three"}, "missed_by_all": {"four"}, "a": {"one"}, "b": {"two"}, "both": {"two", "three"}, "standalone_lost": {"one"}, "nothing_found": {"four"}}


def test_rerank(spark):
    c = spark.createDataFrame([("s", 0, "b", 1), ("s", 0, "a", 2), ("s", 0, "c", 3)], "system string, qid int, chunk_id string, rank int")
    s = spark.createDataFrame([(0, "a", 1.0), (0, "b", 1.0), (0, "c", 2.0)], "qid int, chunk_id string, score double")
    order = lambda d: [r.chunk_id for r in rerank.reorder(rerank.pool(c, d), s).orderBy("rank").collect()]
    assert order(2) == ["a", "b"] and order(3) == ["c", "a", "b"]
    with pytest.raises(ValueError):
        rerank.pool(c, 0)
    arr = spark.createDataFrame([(["x", "y"], ["x"], []), (["x"], [], []), (["x"], ["x"], []), (["x"], ["x"], ["x"])], "r array<string>, a array<string>, g array<string>")
    assert [x.f for x in arr.select(rerank.failure_class(F.col("r"), F.col("a"), F.col("g")).alias("f")).collect()] == ["both", "candidate_generation", "reranking", "complete"]


def test_hashing_encoder_is_unit():
    v = dense.HashingEncoder(16).encode(["", "a b", None])
    assert np.allclose(np.linalg.norm(v, axis=1), 1)
