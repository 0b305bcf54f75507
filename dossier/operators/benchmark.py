"""Constraint checks of question sets: one boolean per rule, one row per broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The allowed labels of a question record.
CATEGORIES = (
    "direct_factual", "section_specific", "numerical", "temporal", "cross_document",
    "comparative", "multi_hop", "table_oriented", "unanswerable", "ambiguous_adversarial",
)
DIFFICULTIES = ("easy", "medium", "hard")
REVIEWS = ("source_checked", "manual_review_recommended")


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _plain(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")))


def _broken(rules: dict[str, Column]) -> Column:
    return F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])))


def _unknown_names(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """question_id and how many required documents, audited documents and tickers of its scope no document has."""
    named = lambda kind, values: questions.select("question_id", F.lit(kind).alias("kind"), F.explode(values).alias("name"))
    asked = named("document", F.transform("required_documents", lambda r: r["document_id"])).unionByName(named("audited", F.col("absence_audit.document_ids")))
    unknown = asked.join(documents.select(F.col("document_id").alias("name")).distinct(), "name", "left_anti")
    tickers = named("ticker", F.col("query_scope.tickers")).join(documents.select(F.col("ticker").alias("name")).distinct(), "name", "left_anti")
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(f"no_{kind}")
    return unknown.unionByName(tickers).groupBy("question_id").agg(*map(count, ("document", "audited", "ticker")))


def question_violations(questions: DataFrame, documents: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """question_id, rule.

    ``questions`` has the question record's columns; ``documents``: document_id, ticker, report_date.
    """
    q = questions.join(_unknown_names(questions, documents), "question_id", "left")
    own = questions.select("question_id", F.explode("required_documents").alias("r")).select("question_id", F.col("r.document_id").alias("document_id"))
    facts = own.join(documents, "document_id").groupBy("question_id").agg(F.collect_set("ticker").alias("doc_tickers"), F.collect_set(F.substring("report_date", 1, 4).cast("int")).alias("doc_years"))
    q = q.join(facts, "question_id", "left")
    ids = F.transform("required_documents", lambda r: r["document_id"])
    ev_docs = F.transform("evidence", lambda e: e["document_id"])
    ev_ids = F.transform("evidence", lambda e: e["evidence_id"])
    yes, no = F.col("answerable"), ~F.col("answerable")
    same = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    answer = F.regexp_replace(_plain(F.col("expected_answer")), r"\.+$", "")
    tickers, years = F.col("query_scope.tickers"), F.col("query_scope.report_years")
    outside = F.col("query_scope.outside_corpus_company")
    blocks = F.array_distinct(F.flatten(F.transform("evidence", lambda e: F.transform(e["content_block_indices"], lambda i: F.struct(e["document_id"], i)))))
    rules = {
        "id_format": F.col("question_id").rlike(r"^SEC-\d{3}\z"), "question_text": _filled(F.col("question")),
        "category": F.col("category").isin(*categories), "difficulty": F.col("difficulty").isin(*DIFFICULTIES),
        "answerable_flag": yes.isNotNull(), "variants": _filled(F.col("acceptable_answer_variants")),
        "review_status": F.col("review_status").isin(*REVIEWS), "review_notes": _filled(F.col("review_notes")),
        "unique_documents": F.size(F.array_distinct(ids)) == F.size(ids), "known_documents": F.coalesce("no_document", F.lit(0)) == 0,
        "multi_label": F.col("multiple_documents_required") == (F.size(ids) > 1), "scope_tickers": tickers.isNotNull() & (F.coalesce("no_ticker", F.lit(0)) == 0),
        "scope_years": (F.size(years) > 0) & F.forall(years, lambda y: y.between(1900, 2200)),
        "answer_present": no | _filled(F.col("expected_answer")), "support_present": no | ((F.size(ids) > 0) & (F.size("evidence") > 0)),
        "no_absence_notes": no | (F.col("unanswerable_reason").isNull() & F.col("absence_audit").isNull()),
        "category_agrees": (F.col("category") == "unanswerable") == no,
        "tickers_agree": no | same(tickers, F.coalesce("doc_tickers", F.array().cast("array<string>"))),
        "years_agree": no | same(years, F.coalesce("doc_years", F.array().cast("array<int>"))), "no_outside_company": no | outside.isNull(),
        "no_leak": no | (F.length(answer) < 8) | ~F.contains(_plain(F.col("question")), answer),
        "null_answer": yes | F.col("expected_answer").isNull(), "no_support": yes | ((F.size(ids) == 0) & (F.size("evidence") == 0)),
        "reason_present": yes | _filled(F.col("unanswerable_reason")), "target_present": yes | (F.size(tickers) > 0) | _filled(outside),
        "audit": yes | ((F.size("absence_audit.document_ids") > 0) & (F.coalesce("no_audited", F.lit(0)) == 0)
                        & (F.size("absence_audit.search_terms") > 0) & F.forall("absence_audit.search_terms", _filled) & _filled(F.col("absence_audit.inspection_notes"))),
        "unique_evidence": F.size(F.array_distinct(ev_ids)) == F.size(ev_ids), "evidence_documents": same(F.array_distinct(ids), F.array_distinct(ev_docs)),
        "several_documents": ~F.col("category").isin("cross_document", "comparative") | (F.size(ids) >= 2),
        "several_blocks": (F.col("category") != "multi_hop") | (F.size(blocks) >= 2),
        "table_evidence": (F.col("category") != "table_oriented") | F.exists("evidence", lambda e: e["contains_table"]),
    }
    return q.select("question_id", _broken(rules).alias("rule"))


def reference_violations(questions: DataFrame, documents: DataFrame, metadata: tuple[str, ...]) -> DataFrame:
    """question_id, rule: required-document entries that differ from the documents, their years or Items."""
    r = questions.select("question_id", "evidence", F.explode("required_documents").alias("r"))
    d = documents.select(*[F.col(c).alias(f"d_{c}") for c in dict.fromkeys(("document_id", "filing_date", "report_date", *metadata))])
    m = r.join(d, F.col("r.document_id") == F.col("d_document_id"))
    items = F.transform(F.filter("evidence", lambda e: e["document_id"] == F.col("r.document_id")), lambda e: e["item"])
    want = F.col("r.items")
    rules = {f"reference:{c}": F.col(f"r.{c}").eqNullSafe(F.col(f"d_{c}")) for c in metadata} | {
        "filing_year": F.col("r.filing_year") == F.substring("d_filing_date", 1, 4).cast("int"),
        "report_year": F.col("r.report_year") == F.substring("d_report_date", 1, 4).cast("int"),
        "items": (F.size(want) > 0) & (F.size(F.array_except(want, items)) == 0) & (F.size(F.array_except(items, want)) == 0),
    }
    return m.select("question_id", _broken(rules).alias("rule")).distinct()


def evidence_violations(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """question_id, evidence_id, rule: offsets, slices, sections, blocks and table flags.

    ``documents``: document_id, text, sections and content arrays, and the provenance columns.
    """
    e = questions.select("question_id", F.explode("evidence").alias("e"))
    carried = [c for c in ("accession_number", "ticker", "company", "source_url") if c in documents.columns]
    d = documents.select(F.col("document_id").alias("d_id"), F.col("text").alias("d_text"), F.col("sections").alias("d_sections"), F.col("content").alias("d_content"), *[F.col(c).alias(f"d_{c}") for c in carried])
    m = e.join(d, F.col("e.document_id") == F.col("d_id"))
    own = F.filter("d_sections", lambda s: s["section_id"] == F.col("e.section_id"))
    idx = F.col("e.content_block_indices")
    first, last = F.try_element_at(idx, F.lit(1)), F.try_element_at(idx, F.lit(-1))
    inside = (F.size(idx) > 0) & F.forall(idx, lambda i: (i >= 0) & (i < F.size("d_content")))
    run = F.when(inside, F.concat_ws(",", F.transform(F.sequence(first, last), lambda i: i.cast("string"))) == F.concat_ws(",", F.transform(idx, lambda i: i.cast("string"))))
    block = lambda i: F.get(F.col("d_content"), i)
    section = F.get(own, F.lit(0))
    rules = {f"evidence:{c}": F.col(f"e.{c}").eqNullSafe(F.col(f"d_{c}")) for c in carried} | {
        "evidence_id": _filled(F.col("e.evidence_id")),
        "offsets": (F.col("e.start_char") >= 0) & (F.col("e.start_char") < F.col("e.end_char")) & (F.col("e.end_char") <= F.length("d_text")),
        "slice": _filled(F.col("e.text")) & (F.substring(F.col("d_text"), F.col("e.start_char") + 1, F.col("e.end_char") - F.col("e.start_char")) == F.col("e.text")),
        "section": (F.size(own) == 1) & (section["item"] == F.col("e.item")) & (section["name"] == F.col("e.section_name")),
        "inside_section": (section["start_char"] <= F.col("e.start_char")) & (F.col("e.end_char") <= section["end_char"]),
        "block_indices": inside, "consecutive_blocks": run,
        "block_edges": (block(first)["start_char"] == F.col("e.start_char")) & (block(last)["end_char"] == F.col("e.end_char")),
        "table_flag": F.col("e.contains_table") == F.exists(idx, lambda i: block(i)["type"] == "table"),
    }
    return m.select("question_id", F.col("e.evidence_id").alias("evidence_id"), _broken(rules).alias("rule"))


def duplicates(questions: DataFrame) -> DataFrame:
    """kind (id or text), value for ids and normalised texts that occur twice."""
    both = questions.select(F.lit("id").alias("kind"), F.col("question_id").alias("value")).unionByName(questions.select(F.lit("text").alias("kind"), _plain(F.col("question")).alias("value")))
    return both.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def corpus_mismatches(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """document_id, problem: missing or unexpected documents and texts whose hash moved."""
    d = documents.select("document_id", F.sha2("text", 256).alias("found"))
    m = d.join(manifest.select("document_id", F.col("text_sha256").alias("wanted")), "document_id", "full_outer")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("found") != F.col("wanted"), "changed")
    return m.withColumn("problem", problem).where("problem is not null").select("document_id", "problem")


def distribution_errors(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """Categories whose number of questions is not the target's."""
    have = questions.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return have.join(targets, "category", "full_outer").where(~F.col("n").eqNullSafe(F.col("target")))


def uncovered_documents(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents that no question requires."""
    used = questions.select(F.explode("required_documents").alias("r")).select(F.col("r.document_id").alias("document_id"))
    return documents.select("document_id").join(used, "document_id", "left_anti")


def summary(questions: DataFrame) -> DataFrame:
    """Counts per category and difficulty and over all (grouping sets)."""
    n_docs = F.size("required_documents")
    return questions.groupingSets([[F.col("category")], [F.col("difficulty")], []], "category", "difficulty").agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("answerable").alias("answerable"), F.count_if(n_docs == 1).alias("single_document"),
        F.count_if("multiple_documents_required").alias("multi_document"), F.count_if(n_docs == 0).alias("no_document"),
        F.count_if(F.exists("evidence", lambda e: e["contains_table"])).alias("with_table"), F.sum(F.size("evidence")).alias("evidence_spans"),
    )
