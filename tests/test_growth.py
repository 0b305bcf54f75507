"""Memory and work that follow a piece or the input: small Arrow pieces, places by bisection."""

import json
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from dossier.functions import text
from dossier.functions.arrow import small
from dossier.operators import chunking, dense, html, json_rules, lexical, postings
from dossier.plans import frames
from tests.test_stores import plain_rules


def test_pieces_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * 500] * 1000)], names=["i", "t"])
    got = list(small(iter([batch, batch.slice(0, 0), batch.slice(7, 5)]), 10_000))
    assert max(b.nbytes for b in got) <= 10_000 and [i for b in got for i in b.column("i").to_pylist()] == [*range(1000), *range(7, 12)]
    assert max(b.num_rows for b in small(iter([batch]), rows=16)) == 16


def _sizes(monkeypatch, module, most):
    """Hold the pieces of ``module`` small, whatever they are by default."""
    monkeypatch.setattr(module, "small", lambda batches, *_, **__: small(batches, most))


def test_python_steps_work_in_pieces(spark, monkeypatch):
    rows = [(i, f"Word{i % 7} and w{i}. " * (i % 40)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    c = chunking.ChunkingConfig("recursive", 80, 10, 20)
    asked = lexical.as_questions(spark.createDataFrame([(0, "word1 and w8"), (1, "w9")], "qid int, t string"), F.col("qid"), F.col("t"))
    pages = docs.select("doc_id", F.concat(F.lit("<body><p>"), "text", F.lit("</p><table><tr><td>a</td></tr></table></body>")).alias("html"))

    def run():
        tokens = lexical.document_tokens(docs)
        return (
            sorted(map(tuple, chunking.chunk_documents(docs.withColumnRenamed("doc_id", "document_id"), c).select("document_id", "chunk_index", "start_char", "end_char", "text").collect())),
            sorted(map(tuple, lexical.bm25_scores(tokens, asked, best=3).groupBy("qid").agg(F.count("id"), F.max("score")).collect())),
            sorted(map(tuple, postings.top_k(postings.ask(postings.build_index(docs), asked), 5).collect())),
            sorted(map(str, html.extract_blocks(pages, "doc_id", "html").collect())),
        )

    whole = run()
    for module in (chunking, lexical, postings, html):
        _sizes(monkeypatch, module, 2000)
    assert run() == whole


def test_cosine_blocks_hold_few_rows(spark, monkeypatch):
    r = np.random.default_rng(3)
    v = spark.createDataFrame([(i, [float(x) for x in r.normal(size=4)]) for i in range(90)], "id long, vector array<float>").coalesce(1)
    q = v.where("id % 30 = 0").withColumnRenamed("id", "qid")
    whole = sorted(map(tuple, dense.cosine_top(v, q, 7).collect()))
    monkeypatch.setattr(dense, "INDEX_ROWS", 4)
    assert sorted(map(tuple, dense.cosine_top(v, q, 7).collect())) == whole and len(whole) == 21


def test_places_make_no_row_for_a_document_and_a_pair(spark, monkeypatch):
    scores = spark.createDataFrame([(q, i, float(i * 7 % 5)) for q in range(3) for i in range(60)], "qid int, id long, score double")
    ids = spark.range(70).select("id")
    wanted = spark.createDataFrame([(q, i) for q in range(3) for i in range(0, 70, 3)], "qid int, id long")
    full = {(x.qid, x.id): x.rank for x in lexical.full_ranking(scores, ids, wanted.select("qid").distinct()).collect()}
    for block in (1, 1 << 18):
        monkeypatch.setattr(lexical, "WANTED_BLOCK", block, raising=False)
        placed = lexical.rank_within(scores, ids, wanted)
        assert {(x.qid, x.id): x.rank for x in placed.collect()} == {(x.qid, x.id): full[x.qid, x.id] for x in wanted.collect()}
        assert "MapInArrow" in placed._jdf.queryExecution().optimizedPlan().toString()  # not a join of scores and pairs


def test_no_scores_but_the_best_and_the_wanted_are_written(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 23}" for j in range(1, 9))) for i in range(300)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(q, f"w{q} w{q + 5} w3") for q in range(7)], "item_id long, text string")
    tables = {"documents": docs, "benchmark": bench}
    monkeypatch.setattr(frames, "table", lambda spark, d, name: tables[name])
    asked, tokens, ids = frames.questions(spark, ""), frames.tokens(spark, ""), docs.select(F.col("doc_id").alias("id"))
    gold = spark.createDataFrame([(q, i) for q in range(7) for i in range(q, 300, 17)], "qid long, document_id long")
    written = {}

    def stored(df, name):
        out = keep(df, name)
        written[name] = max(out.count(), written.get(name, 0))
        return out

    keep = frames.stored
    monkeypatch.setattr(frames, "stored", stored)
    got = {(r.system, r.qid, int(r.chunk_id)): r["rank"] for r in frames.ranked(spark, "", gold, 4).where("system <> 'rrf'").collect()}
    assert written["scores"] <= 3 * 4 * 7  # at most the best of each task, not every document and question
    wanted = {(r.qid, r.document_id) for r in gold.collect()}
    for name, (k1, b) in frames.SYSTEMS.items():
        full = {(r.qid, r.id): r["rank"] for r in lexical.full_ranking(lexical.bm25_scores(tokens, asked, k1, b), ids, asked).collect()}
        assert {k[1:]: r for k, r in got.items() if k[0] == name} == {k: r for k, r in full.items() if r <= 4 or k in wanted}


NESTED = {
    "type": "object", "additionalProperties": False, "required": ["o", "free"],
    "properties": {
        "o": {"type": ["object", "null"], "required": ["x", "only here"], "properties": {"x": {"type": "integer"}, "in`ner": {"type": "object", "required": ["y", "l"], "properties": {"y": {"enum": [None, "a", True]}, "l": {"type": "array"}}}}},
        "free": {"required": ["z"]}, "flat": {"type": "array", "items": {"type": "object", "required": ["n", "m"], "properties": {"n": {"type": ["string", "null"]}}}},
        "deep": {"type": "array", "uniqueItems": True, "items": {"type": "object", "properties": {"o": {"type": "object", "required": ["q"]}, "l": {"type": "array", "items": {"type": "integer", "minimum": 2}}}}},
        "either": {"type": ["object", "array", "null"], "required": ["w"], "properties": {"w": {"type": "boolean"}}, "items": {"type": "string"}}, "lists": {"type": "array", "items": {"type": "array", "items": {"const": 1}}},
        "closed": {"type": "object", "additionalProperties": False, "required": ["c"], "properties": {"c": {}, "d": {"type": "number"}}},
    },
}


def test_schema_rules_of_nested_shapes_equal_the_plain_ones(spark):
    values = {
        "o": [None, {}, [], 1, "{}", {"x": 1, "only here": None}, {"x": None, "in`ner": None}, {"x": 2.5, "only here": [], "in`ner": {}}, {"x": "1", "in`ner": {"y": "b", "l": None}}, {"in`ner": {"y": None, "l": [{}]}}, {"in`ner": [1], "x": {"x": 1}}, {"in`ner": {"y": True, "l": {}}}],
        "free": [{}, {"z": None}, None, [], "z", {"z": {"z": [1, {"a": None}]}}],
        "flat": [[], {}, None, [None], [{}], [1, "a"], [{"n": 1, "m": None}, {"n": None, "m": 1}], [{"m": []}, {"n": {"n": 1}}], [{"n": "x", "m": 0}, [], {}]],
        "deep": [[], [{}, {}], [{"o": {}}, {"o": {"q": None}}], [{"o": None}, {"l": [1, 2, "3"]}], [{"o": []}, 3, 3], [{"l": {}}, {"l": None}], {"o": {}}, None],
        "either": [None, {}, [], {"w": 1}, {"w": True}, ["a", 1], 3, [None], {"w": None}], "lists": [[], [[]], [[1], [2]], [1], [None, [1]], None, {}], "closed": [{}, {"c": None}, {"c": [[True], {"a": "no"}], "d": "1"}, {"d": 1.5, "e": "true"}, {"e": None, "f": [1]}, [], None],
    }
    good = {"o": {"x": 1, "only here": 0}, "free": {"z": 0}}
    texts = [json.dumps(good | {k: v}) for k, vs in values.items() for v in vs] + [json.dumps(x) for x in ({}, {"o": None, "more": "yes"}, {"o": good["o"], "x": [[1]], "y": None}, [good], None, "o", 1, good)]
    texts += [json.dumps({k: vs[i % len(vs)] for k, vs in values.items()}) for i in range(40)]
    df = spark.createDataFrame([*enumerate(texts), (900, '{"o":'), (901, None), (902, '{"o":1,"o":2}')], "id int, j string").repartition(4)
    got = sorted(map(tuple, json_rules.json_violations(df, "id", "j", NESTED).collect()))
    assert got == sorted((i, *r) for i, t in enumerate(texts) for r in plain_rules(NESTED, json.loads(t))) + [(i, "$", "json") for i in (900, 901, 902)]


def test_lookups_and_texts_do_not_grow_with_fields_and_values(spark):
    df = spark.createDataFrame([(1, "{}")], "id int, j string")

    def plan(fields: int, values: int) -> str:
        inner = {"type": "object", "required": [f"f{i}" for i in range(fields)], "properties": {"e": {"enum": [f"v{i}" for i in range(values)]}}}
        return json_rules.json_violations(df, "id", "j", {"type": "object", "properties": {"o": inner}})._jdf.queryExecution().optimizedPlan().toString()

    small_one, large_one = plan(3, 2), plan(12, 9)
    for name in ("variant_get", "schemaOfVariant", "StructsToJson"):
        assert small_one.count(name) == large_one.count(name) > 0


def test_texts_without_a_hint_hold_nothing_private(spark):
    r = random.Random(5)
    parts = ["sk-", "SK_", "Sk-a1", "a@b.cc", "@", "é@ü.de", "123-45-6789", "123", "-", "45", "6789", "(555)", "555", " ", ".", "+1", "+1 ", "555-123-4567", "555.123.4567", "x", "task-", "ſk-q", "٣", "[", "]", "(", ")", "e-1000", "2024-01-01"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 7))) for _ in range(6000)] + parts
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, t string").repartition(4)
    plain = F.col("t")
    for mask in text.PRIVATE_MASKS:
        plain = F.regexp_replace(plain, mask, r"\[REDACTED\]")
    rows = df.select("t", text.mask_private(F.col("t")).alias("got"), plain.alias("want")).collect()
    assert [x for x in rows if x.got != x.want] == [] and sum(x.want != x.t for x in rows) > 1000 and sum(x.t is None for x in rows) == 1
