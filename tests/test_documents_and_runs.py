"""Parsing, chunking, facts, routing, answer contract, traces, sources, streaming, service, plans."""

import json
import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import answers, benchmark, chunking, dense, facts, grounding, html, router, sections, traces
from dossier.sources import files, filings
from dossier.streaming import events


def test_blocks():
    page = """<html><head><title>t</title></head><body><style>x</style><p hidden>no</p><p style="display:none">no</p><div style="visibility: hidden">no</div>
    <ix:header>no</ix:header><!-- c --><p>Revenue <span>was</span>&nbsp;<ix:nonfraction>1,234</ix:nonfraction>.</p>Next paragraph<br>Another line</body></html>"""
    blocks, removed = html.parse_blocks(page)
    assert [b["text"] for b in blocks] == ["Revenue was 1,234.", "Next paragraph", "Another line"] and removed == 6
    table, _ = html.parse_blocks('<table><tr><td rowspan="2">Revenue</td><td>2025</td></tr><tr><td></td></tr><tr><td>$<p>1,234</p></td><td>(50)</td></tr></table>')
    assert table[0]["text"] == "Revenue | 2025\n$ 1,234 | (50)" and table[0]["rows"][0][0]["rowspan"] == "2"
    assert [b["text"] for b in html.parse_blocks("<p>a<b>b<p>c</p>d")[0]] == ["abcd"]
    assert html.parse_blocks("</p></x>")[0] == []


def test_sections_from_pages(spark):
    page = "<p>Item 1. Business</p><p>" + "b " * 400 + '</p><p><a href="#x">Item 1A. Risk Factors</a></p><p>Item 1A. Risk Factors</p><p>r</p><p>Item 1. Business</p><p>Item 7. Something else</p><table><tr><td>Item 2. Properties</td></tr></table>'
    parsed = html.extract_blocks(spark.createDataFrame([(1, page)], "page_id int, html string"), "page_id", "html")
    chosen = sections.select_headings(sections.heading_candidates(html.place_blocks(parsed)))
    texts = parsed.select("id", html.joined_text(F.col("blocks")).alias("full_text"))
    out = sections.section_spans(chosen, texts).orderBy("start_char").collect()
    assert [(r["item"], r["text"][:8]) for r in out] == [("1", "Item 1. "), ("1A", "Item 1A.")] and out[0].start_char == 0
    whole = texts.first().full_text
    assert all(whole[r.start_char : r.end_char] == r["text"] for r in out)
    assert sections.heading_warnings(chosen).count() == 1
    assert {r["item"] for r in sections.core_warnings(sections.section_spans(chosen, texts), parsed).collect()} == {"1A", "7", "8"}
    stats = html.document_statistics(parsed).first()
    assert stats.table_count == 1 and stats.normalized_characters == len(whole)


def _chunks(spark, text, **k):
    c = chunking.ChunkingConfig(**({"size": 100, "overlap": 0, "minimum": 30} | k))
    d = spark.createDataFrame([("d", text)], "document_id string, text string")
    return [(r.start_char, r.end_char) for r in chunking.chunk_spans(d, c).orderBy("chunk_index").collect()]


@pytest.mark.parametrize("n, minimum, want", [(105, 30, [75, 30]), (205, 90, [100, 53, 52]), (100, 30, [100]), (0, 30, [])])
def test_fixed_golden(spark, n, minimum, want):
    assert [b - a for a, b in _chunks(spark, "x" * n, minimum=minimum)] == want


@pytest.mark.parametrize("text, end", [("A" * 58 + "\n\n" + "B" * 60 + "\n\n" + "C" * 60, 60), ("A" * 57 + ". " + "B" * 100, 59)])
def test_natural_boundaries(text, end):
    assert chunking.natural_spans(text, 0, len(text), chunking.ChunkingConfig("recursive", 100, 0, 30))[0] == (0, end)


def test_fixed_closed_form_equals_the_sequential_rule(spark):
    r = random.Random(5)
    for _ in range(6):
        size = r.randint(5, 60)
        c = chunking.ChunkingConfig("fixed_size", size, r.randint(0, size - 1), r.randint(1, size))
        lengths = [r.randint(0, 300) for _ in range(60)]
        d = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(lengths)], "document_id int, text string")
        got = {}
        for x in chunking.chunk_spans(d, c).orderBy("document_id", "chunk_index").collect():
            got.setdefault(x.document_id, []).append((x.start_char, x.end_char))
        for i, n in enumerate(lengths):
            want, at = [], 0
            while at < n:
                stop = limit = min(at + c.size, n)
                if limit < n and n - stop + c.overlap < c.minimum:
                    even = n - min(c.minimum, (n - at + c.overlap) // 2) + c.overlap
                    stop = even if at + c.overlap < even <= limit else stop
                want.append((at, stop))
                if stop == n:
                    break
                at = stop - c.overlap
            assert got.get(i, []) == want


def test_chunk_sections_and_tables(spark):
    sec = "array<struct<section_id:string,item:string,name:string,start_char:int,end_char:int>>"
    con = "array<struct<type:string,start_char:int,end_char:int>>"
    d = spark.createDataFrame([("d", "x" * 150, [("s1", "1", "a", 0, 60), ("s6", "6", "b", 60, 150)], [("table", 90, 120)])], f"document_id string, text string, sections {sec}, content {con}")
    rows = chunking.chunk_documents(d, chunking.ChunkingConfig("fixed_size", 100, 0, 30)).orderBy("chunk_index").collect()
    assert [(r.section_scope, r["item"], r.unsectioned_characters) for r in rows] == [("mixed", None, 0), ("single", "6", 0)]
    assert [r.table_fragments[0].is_partial for r in rows] == [True, True] and len({r.chunk_id for r in rows}) == 2
    by_section = chunking.chunk_documents(d, chunking.ChunkingConfig("sections", 100, 0, 30)).orderBy("chunk_index").collect()
    assert [(r["item"], r.character_count) for r in by_section] == [("1", 60), ("6", 90)]
    assert chunking.item_distribution(chunking.chunk_documents(d, chunking.ChunkingConfig("fixed_size", 100, 0, 30))).orderBy("item").collect()[1].chunks == 2


@pytest.mark.parametrize("bad", [{"overlap": 100}, {"minimum": 0}, {"boundary_fraction": 0}, {"strategy": "x"}, {"size": True}])
def test_chunk_config(bad):
    with pytest.raises(ValueError):
        chunking.ChunkingConfig(**({"size": 100, "overlap": 0, "minimum": 30} | bad))


ROW = {"fy": 2024, "fp": "FY", "form": "10-K", "filed": "2024-11-01", "accn": "old", "val": 90.0, "start": "2023-10-01", "end": "2024-09-28"}
NEW = ROW | {"form": "10-K/A", "filed": "2025-01-01", "accn": "new", "val": 100.0}


def _facts(spark, rows, assets=(ROW, NEW), unit="USD"):
    strip = [{k: v for k, v in a.items() if k != "start"} for a in assets]
    doc = {"cik": 1, "facts": {"us-gaap": {"SalesRevenueNet": {"units": {unit: rows}}, **({"Assets": {"units": {"USD": strip}}} if assets else {})}}}
    raw = facts.explode_payload(spark.createDataFrame([("T", "Co", json.dumps(doc))], "ticker string, company string, json string"))
    return facts.normalize_facts(raw).where("metric = 'revenue'").collect(), raw


def test_facts(spark):
    got, raw = _facts(spark, [ROW, NEW])
    assert [(r.value, r.concept, r.accession_number) for r in got] == [(100.0, "SalesRevenueNet", "new")]
    assert facts.verify_pointers(facts.normalize_facts(raw), raw).count() == 0
    assert _facts(spark, [ROW, NEW, NEW])[0][0].duplicate_rows_resolved == 1
    assert _facts(spark, [ROW, NEW, NEW | {"val": 101.0}])[0] == []
    assert _facts(spark, [ROW, NEW, NEW | {"end": "2023-09-28", "start": "2022-10-01"}, NEW | {"start": "2024-07-01"}])[0][0].value == 100.0
    assert _facts(spark, [ROW, NEW], assets=())[0] == [] and _facts(spark, [ROW, NEW], unit="EUR")[0] == []
    assert _facts(spark, [ROW, NEW, NEW | {"start": "2023-10-02"}])[0] == []


@pytest.mark.parametrize("q, route", [
    ("What was AAPL revenue in 2025 and why did it change?", "document_retrieval+financial_data"), ("Explain Apple business strategy", "document_retrieval"),
    ("Tell me a stock price", "abstain"), ("Apple revenue 2025", "financial_data"), ("cash", "abstain"), ("", "abstain"), (None, "abstain"), ("revenue FY2025", "abstain"),
])
def test_routes(spark, q, route):
    assert spark.createDataFrame([(q,)], "q string").select(router.route(F.col("q")).alias("r")).first().r == route


GOOD = {"answer": "Revenue was $100 million [C001].", "citations": ["C001"], "abstained": False}


@pytest.mark.parametrize("raw, error", [
    (json.dumps(GOOD), None), (json.dumps({"answer": grounding.ABSTENTION, "citations": [], "abstained": True}), None), ("no", "Malformed structured output"),
    ("[]", "Unexpected structured output fields"), ('{"answer": "a", "answer": "b", "citations": [], "abstained": false}', "Malformed structured output"),
    (json.dumps(GOOD | {"answer": " "}), "Answer and abstention types are invalid"), (json.dumps(GOOD | {"citations": ["C999"]}), "Citation references nonexistent context"),
    (json.dumps(GOOD | {"answer": "x [C999]"}), "Inline citations and citation list differ"), (json.dumps(GOOD | {"citations": ["C001", "C001"]}), "Invalid or duplicate citations"),
    (json.dumps(GOOD | {"abstained": "no"}), "Answer and abstention types are invalid"), (json.dumps(GOOD | {"abstained": True}), "Abstention requires canonical answer and no citations"),
    (json.dumps(GOOD | {"x": 1}), "Unexpected structured output fields"), (json.dumps({"answer": "claim", "citations": [], "abstained": False}), "Non-abstaining answer requires supporting citations"),
    ('{"answer": NaN, "citations": [], "abstained": false}', "Malformed structured output"),
])
def test_output_contract(spark, raw, error):
    assert grounding.check_output(raw, {"C001"})[1] == error
    row = grounding.validate_outputs(spark.createDataFrame([(1, raw, ["C001"])], "id int, raw string, allowed array<string>")).first()
    assert row.error == error and row.output_contract_valid == (error is None)


def test_generation_retries():
    class Fake:
        def __init__(self, *steps):
            self.steps = list(steps)

        def generate(self, instructions, prompt):
            s = self.steps.pop(0)
            if isinstance(s, Exception):
                raise s
            return s

    timeout, denied, ok = grounding.ProviderError("timeout", None, True), grounding.ProviderError("denied", 401), grounding.Reply(json.dumps(GOOD))
    for steps, status, n in (([timeout, ok], "success", 2), ([timeout] * 3, "provider_error", 3), ([denied], "provider_error", 1), ([grounding.Reply("x")], "invalid_output", 1), ([ValueError()], "provider_error", 1), ([grounding.Reply("x", None, "incomplete")], "provider_error", 1)):
        waits = []
        g = grounding.generate_once(Fake(*steps), "", "", {"C001"}, 2, 0.5, waits.append)
        assert (g.status, len(g.attempts)) == (status, n) and waits == [0.5 * 2**i for i in range(n - 1)]


def test_attribution_ladder(spark):
    q = spark.createDataFrame([(i, i != 3, "revenue was 100", ["e"] if i != 3 else []) for i in range(6)], "qid int, answerable boolean, expected string, evidence_ids array<string>")
    ok, none = "Revenue was 100", "nothing alike"
    t = spark.createDataFrame([(0, "success", ok, ["C001"], False), (1, "success", ok, ["C001"], False), (2, "success", none, ["C001"], False), (3, "success", "x", [], True), (4, "invalid_output", "", [], None), (5, "success", ok, ["C002"], False)], "qid int, status string, answer string, citations array<string>, abstained boolean")
    ctx = spark.createDataFrame([(i, c, "Revenue was 100") for i in range(6) for c in ("C001", "C002")], "qid int, context_id string, text string")
    hit = spark.createDataFrame([(i, "C001", "e") for i in (0, 2, 4, 5)], "qid int, context_id string, evidence_id string")
    got = {r.qid: r.attribution for r in answers.evaluate_answers(t, ctx, hit, q).collect()}
    assert got == {0: "successful_grounded_answer", 1: "retrieval_failure", 2: "generation_failure", 3: "expected_abstention", 4: "invalid_structured_output", 5: "citation_failure"}


def test_trace_figures(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)] + [(None,), (float("nan"),), (-1.0,)], "v double")
    r = d.agg(*traces.distribution("v", "x")).first()
    assert (r.x_count, r.x_unavailable, r.x_mean, r.x_median, r.x_p95) == (5, 3, 22, 3, 100)
    u = "struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>"
    rows = spark.createDataFrame([((2, 3, None),), ((2, 3, 9),), ((-1, 3, 4),)], f"u {u}").select(traces.usage(F.col("u")).alias("u")).collect()
    assert [x.u.total_tokens for x in rows] == [5, None, 4] and rows[2].u.input_tokens is None
    two = spark.createDataFrame([([(10, 5, None), (2, 3, None)],), ([(1, 1, None), (None, 1, None)],)], f"a array<{u}>").select(traces.attempts_usage(F.col("a")).alias("u")).collect()
    assert two[0].u.total_tokens == 20 and two[1].u.input_tokens is None and two[1].u.output_tokens == 2
    ok, bad = traces.unique_traces(spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "trace_id string, v int"))
    assert [x.trace_id for x in ok.collect()] == ["a"] and [x.trace_id for x in bad.collect()] == ["b"]
    links = spark.createDataFrame([("https://www.sec.gov/a?b=1#c",), ("http://www.sec.gov/a",), ("https://evil.org/a",), ("https://u:p@www.sec.gov/",)], "u string")
    assert [x.l for x in links.select(traces.public_link(F.col("u")).alias("l")).collect()] == ["https://www.sec.gov/a", None, None, None]


def test_sources(spark, tmp_path):
    sub = spark.createDataFrame([("c", ["10-K", "8-K", "10-K", "10-K"], ["a", "b", "c", "d"], ["1"] * 4, ["2"] * 4, ["x"] * 3)], "cik string, form array<string>, accession_number array<string>, filing_date array<string>, report_date array<string>, primary_document array<string>")
    assert [r.accession_number for r in filings.select_filings(sub, "10-K", 5).orderBy("n").collect()] == ["a", "c"]
    old = spark.createDataFrame([("1", "n1", "t1"), ("2", "n2", "t2")], "k string, name string, seen string")
    new = spark.createDataFrame([("1", "N1", "T1"), ("3", "n3", "t3")], old.schema)
    assert sorted(map(tuple, filings.upsert(old, new, ["k"], ("seen",)).collect())) == [("1", "N1", "t1"), ("2", "n2", "t2"), ("3", "n3", "t3")]
    root = f"file://{tmp_path}"
    first = files.write_once(old, root, "t")
    assert files.write_once(old.orderBy("name"), root, "t") == first and spark.read.parquet(first).count() == 2
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.bin").write_bytes(b"abc")
    row = files.read_binary(spark, f"file://{tmp_path}/b").first()
    assert row.sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_question_rules(spark):
    from dossier.plans import catalog

    out = catalog.queries()["benchmark_constraint_violations"](spark, "/root/testdata/sf0.001").collect()
    assert {r.rule for r in out} <= {"difficulty", "review_notes", "no_leak"} and out
    assert benchmark.duplicates(spark.createDataFrame([("a", "X  y"), ("b", "x y")], "question_id string, question string")).first().kind == "text"


def test_stream_equals_batch(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet")
    src.limit(500).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = events.parsed(spark.readStream.schema(src.schema).parquet(f"file://{tmp_path}/in"))
    q = events.tumbling(stream).writeStream.format("memory").queryName("tumbling_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = events.tumbling(events.parsed(spark.read.parquet(f"file://{tmp_path}/in")))
    assert sorted(map(tuple, spark.table("tumbling_test").collect())) == sorted(map(tuple, batch.collect()))


def test_service(spark):
    from dossier import service

    docs = spark.createDataFrame([(1, "apple pie"), (2, "cloud revenue"), (3, "apple revenue")], "doc_id int, text string")
    s = service.Service(spark, docs, service.Settings(top_k=2))
    assert s.ready()["ready"] and [r["doc_id"] for r in s.retrieve("apple revenue")] == [3, 1]
    with pytest.raises(service.InvalidRequest):
        service.Service(spark, docs, service.Settings("hybrid"))
    encoder = dense.HashingEncoder(16)
    vectors = dense.encode_texts(docs.select(F.col("doc_id").alias("id"), "text"), encoder).select("id", "vector")
    h = service.Service(spark, docs, service.Settings("hybrid", top_k=3), vectors=vectors, encoder=encoder)
    assert [r["doc_id"] for r in h.retrieve("apple revenue")][0] == 3 and len(h.retrieve("apple revenue")) == 3
    with pytest.raises(service.InvalidRequest):
        s.retrieve(" ")
    with pytest.raises(service.NotFound):
        s.get_trace("x")
    run = service.run_question(s, "Explain the apple business", {"document_retrieval": service.document_tool(s)})
    assert run["status"] == "success" and run["selected_tools"] == ["document_retrieval"]
    for bad in ({"DOSSIER_TOP_K": "0"}, {"DOSSIER_TIMEOUT_SECONDS": "x"}, {"DOSSIER_RETRIEVAL_MODE": "y"}):
        with pytest.raises(service.InvalidRequest):
            service.Settings.from_env(bad)


def test_plans_have_no_nested_loops(spark, sf):
    from dossier.operators import evidence
    from dossier.plans import frames

    o = evidence.overlaps(frames.fixed_chunks(spark, sf), spark.createDataFrame([("e", 0, 1, 0, 5, "x")], "evidence_id string, qid int, document_id long, start_char int, end_char int, text string"))
    assert "BroadcastNestedLoopJoin" not in o._jdf.queryExecution().executedPlan().toString()


def test_registry_is_consistent():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "bm25_top10" in e.queries()
