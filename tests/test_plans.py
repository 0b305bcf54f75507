"""Plans that replace a direct computation, against the direct one on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.functions.text import mask_tree
from dossier.operators import chunking, dense, evidence, lexical, postings, rerank, retrieval
from dossier.sources import files
from dossier.sources.stored import release, stored


def _words(r, n):
    return " ".join(r.choice(["red", "fox", "ran", "the", "den", "old", "sun", "Ärger", "1,234", "x-y"]) for _ in range(n))


def test_passages_meet_by_word_keys_as_by_search(spark):
    r = random.Random(1)
    docs = [(i, _words(r, r.randint(0, 40)).replace("the red", "the  red")) for i in range(150)] + [(900, None), (901, "")]
    passages = [(i, _words(r, n)) for i, n in enumerate([1, 2, 3, 4, 5, 5, 6, 6, 7])] + [(50, docs[3][1]), (51, None), (52, "ox ran the old su"), (53, "")]
    got = evidence.find_passages(spark.createDataFrame(docs, "document_id long, text string"), spark.createDataFrame(passages, "qid long, passage string")).collect()
    want = {(q, i, t.index(p), p) for q, p in passages if p is not None for i, t in docs if t is not None and p in t}
    assert {(g.qid, g.document_id, g.start_char, g.text) for g in got} == want and len(got) == len(want)


@pytest.mark.parametrize("block", [1, 1 << 22])
def test_long_passages_meet_by_bytes_of_their_middle(spark, monkeypatch, block):
    monkeypatch.setattr(evidence, "PASSAGE_BLOCK", block, raising=False)
    r = random.Random(7)
    word = lambda: r.choice(["Ärger", "über", "the", "den", "日本", "😀", "of", "x", "\n", " " * 30])
    passages = [(i, "".join(word() + " " for _ in range(r.randint(4, 14)))) for i in range(12)]
    passages += [(20, passages[0][1]), (21, passages[0][1][:-1] + "?"), (22, " " * 40), (None, passages[1][1]), (23, None), (24, "a" * 23), (25, "a" * 24)]
    docs = [(i, "".join(word() + " " for _ in range(r.randint(0, 30))) + r.choice(["", r.choice(passages[:12])[1] * 2]) + word()) for i in range(120)]
    docs += [(900, None), (901, ""), (902, passages[2][1]), (903, passages[2][1][:-1]), (904, passages[2][1][1:]), (905, "b" + "a" * 23), (906, "a" * 30), (907, passages[3][1][:9]), (908, passages[3][1][9:])]
    got = evidence.find_passages(spark.createDataFrame(docs, "document_id long, text string").repartition(3), spark.createDataFrame(passages, "qid int, passage string"))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row for each word of a text
    got = got.collect()
    want = {(q, i, t.index(p), t.index(p) + len(p), p) for q, p in passages if None not in (q, p) for i, t in docs if t is not None and p in t}
    assert {tuple(g) for g in got} == want and len(got) == len(want) > 60


@pytest.mark.parametrize("kind", ["long", "string"])
def test_counted_places_equal_the_full_ranking(spark, monkeypatch, kind):
    monkeypatch.setattr(lexical, "STRETCHES", 7)
    monkeypatch.setattr(lexical, "QUESTION_BLOCK", 2)
    monkeypatch.setattr(lexical, "DOCUMENT_BLOCK", 16)
    r = random.Random(2)
    name = (lambda i: i * i) if kind == "long" else (lambda i: f"{i % 7}{i:03d}")
    docs = spark.createDataFrame([(name(i), _words(r, r.randint(0, 12))) for i in range(120)], f"doc_id {kind}, text string")
    q = lexical.as_questions(spark.createDataFrame([(0, "fox ran"), (1, "1234"), (2, "nothing"), (3, "the the sun"), (4, None)], "qid int, t string"), F.col("qid"), F.col("t"))
    t = lexical.document_tokens(docs)
    scores = stored(lexical.bm25_scores(t, q), "scores")
    full = {(x.qid, x.id): x.rank for x in lexical.full_ranking(scores, t, q).collect()}
    ids = [x.id for x in t.collect()]
    wanted = spark.createDataFrame([(k, i) for k in (0, 1, 2, 3) for i in ids[::5]], f"qid int, id {kind}")
    assert {(x.qid, x.id): x.rank for x in lexical.rank_within(scores, t, wanted).collect()} == {(k, i): full[k, i] for k in (0, 1, 2, 3) for i in ids[::5]}
    for s in (scores, lexical.bm25_scores(t, q, best=9)):
        assert {(x.qid, x.id): x.rank for x in lexical.top_ranked(s, t, q, 9).collect()} == {k: v for k, v in full.items() if v <= 9}


def test_folding_follows_compatibility_forms(spark):
    texts = [("ﬁle Ⅸ", ["file", "ix"]), ("ＡＢＣ", ["abc"]), ("ſtraße STRASSE", ["strasse", "strasse"]), ("ÄRGER école", ["ärger", "école"]), ("été", ["été"]), ("ǅ", ["dž"]), (None, []), ("1,234.5% 12,34", ["1234.5%", "12", "34"])]
    got = {r.id: r.tokens for r in lexical.document_tokens(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id int, text string")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(texts)}


def test_cosine_keeps_ties_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
    r = np.random.default_rng(3)
    x = np.concatenate([r.integers(-1, 2, (80, 3)).astype(float), r.normal(size=(20, 3))])
    x[np.abs(x).sum(axis=1) == 0] = 1.0
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "qid long, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for own in (False, True):
        got = {(g.qid, g.rank): (g.id, g.score) for g in dense.cosine_top(index, q, 7, own).collect()}
        for i in range(5):
            s = np.round(np.clip(unit @ unit[i], -1, 1), dense.SCORE_DIGITS)
            order = [j for j in sorted(range(100), key=lambda j: (-s[j], j)) if not (own and j == i)]
            for k in range(7):
                assert got[i, k + 1][0] == order[k] and abs(got[i, k + 1][1] - s[order[k]]) < 1e-6
    assert dense.cosine_top(index, q.limit(0), 3).count() == 0


def test_counted_overlaps_equal_token_f1(spark):
    from dossier.functions.text import token_f1

    r = random.Random(4)
    q = spark.createDataFrame([(i, _words(r, i)) for i in range(6)] + [(9, None)], "qid int, question string")
    p = spark.createDataFrame([(str(i), _words(r, 3 * i)) for i in range(8)] + [("n", None)], "chunk_id string, text string")
    pairs = q.select("qid").crossJoin(p.select("chunk_id"))
    got = {(x.qid, x.chunk_id): x.score for x in rerank.overlap_scores(pairs, q, p).collect()}
    want = pairs.join(q, "qid").join(p, "chunk_id").select("qid", "chunk_id", F.round(token_f1(F.col("question"), F.col("text")), 6).alias("score"))
    assert got == {(x.qid, x.chunk_id): x.score for x in want.collect()}


def test_retrieval_modes_and_their_errors(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "old den"), (3, "red sun")], "doc_id long, text string")
    t, q = postings.build_index(docs), lexical.as_questions(spark.createDataFrame([(0, "red")], "qid int, t string"), F.col("qid"), F.col("t"))
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "id long, vector array<double>")
    asked = spark.createDataFrame([(0, [0.0, 1.0])], "qid int, vector array<double>")
    chunks = docs.withColumnRenamed("doc_id", "chunk_id")
    got = {m: [(r.chunk_id, r.score_type, r.text) for r in retrieval.retrieve(m, 2, chunks, q, t, v, asked).orderBy("rank").collect()] for m in retrieval.MODES}
    assert got == {"bm25": [(1, "bm25", "red fox"), (3, "bm25", "red sun")], "dense": [(2, "cosine", "old den"), (3, "cosine", "red sun")], "hybrid": [(1, "rrf", "red fox"), (2, "rrf", "old den")]}
    for bad in (("other", 2), ("bm25", 0), ("bm25", True), ("hybrid", 2)):
        with pytest.raises(ValueError):
            retrieval.retrieve(*bad, chunks, q, t)


def test_chunks_are_the_slices_of_their_text(spark):
    r = random.Random(5)
    texts = [(i, "".join(r.choice(["ab", "é", "😀", ". ", "\n", "\n\n", " "]) for _ in range(r.randint(0, 300)))) for i in range(40)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(texts, "document_id long, text string")
    for name in ("fixed_size", "recursive"):
        c = chunking.ChunkingConfig(name, 37, 9, 12)
        rows = chunking.chunk_documents(docs, c).collect()
        own = dict(texts)
        last = {}
        for x in sorted(rows, key=lambda x: (x.document_id, x.chunk_index)):
            assert x.text == own[x.document_id][x.start_char : x.end_char] and x.end_char - x.start_char == x.character_count <= 37 + 12
            before = last.get(x.document_id)
            assert x.overlap_with_previous == (max(0, before.end_char - x.start_char) if before else 0)
            assert x.start_char == 0 if before is None else x.start_char <= before.end_char
            last[x.document_id] = x
        assert {k: x.end_char for k, x in last.items()} == {i: len(t) for i, t in texts if t}
        spans = {tuple(x) for x in chunking.chunk_spans(docs, c).select("document_id", "chunk_index", "start_char", "end_char").collect()}
        assert spans == {(x.document_id, x.chunk_index, x.start_char, x.end_char) for x in rows}


def test_masks_reach_every_depth():
    value = {"a": ["x a@b.co", {"password": 1, "b": ["sk-abcdef", 2, None, True]}], "Email": [1], "t": ("sekret", {})}
    assert mask_tree(value, ("sekret", "")) == {"a": ["x [REDACTED]", {"password": "[REDACTED]", "b": ["[REDACTED]", 2, None, True]}], "Email": "[REDACTED]", "t": ["[REDACTED]", {}]}
    assert mask_tree("sekret", ("sekret",)) == "[REDACTED]" and mask_tree(3) == 3


def test_small_scans_are_dealt_to_all_cores(spark, sf, tmp_path):
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    dealt = files.spread(plain)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
    assert files.spread(plain, most_bytes=1).rdd.getNumPartitions() == plain.rdd.getNumPartitions()
    kept = stored(plain.select("doc_id"), "kept")
    assert kept.count() == plain.count()
    release(kept)
    with pytest.raises(Exception):
        spark.read.parquet(kept._dossier_path)
