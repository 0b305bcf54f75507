"""Scoring of generated answers: citations, correctness, groundedness, where a run failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import token_f1

CORRECT_F1, GROUNDED_F1 = 0.5, 0.35


def attribution(answerable: Column, status: Column, abstained: Column, citation_valid: Column, available: Column, cited: Column, precision: Column, correct: Column, grounded: Column) -> Column:
    """Where a run succeeded or failed.  The order of the rules is their meaning.

    available: evidence was retrieved; cited: the answer has citations.
    """
    return (
        F.when(~citation_valid & (status == "invalid_output"), "invalid_structured_output")
        .when(~answerable & abstained & citation_valid, "expected_abstention")
        .when(answerable & ~available, "retrieval_failure")
        .when(answerable & abstained, "generation_failure")
        .when(answerable & cited & (precision == 0), "citation_failure")
        .when(answerable & F.coalesce(~correct, F.lit(False)), "generation_failure")
        .when(answerable & ~citation_valid, "citation_failure")
        .when(answerable & ~abstained, F.when(F.coalesce(grounded, F.lit(False)), "successful_grounded_answer").otherwise("generation_failure"))
        .otherwise("invalid_structured_output")
    )


def evaluate_answers(traces: DataFrame, contexts: DataFrame, matched: DataFrame, questions: DataFrame) -> DataFrame:
    """One scored row per trace.

    ``traces``: qid, status, answer, citations, abstained; ``contexts``: qid,
    context_id, text; ``matched``: qid, context_id, evidence_id; ``questions``: qid,
    answerable, expected, evidence_ids.
    """
    ids = contexts.groupBy("qid").agg(F.collect_set("context_id").alias("ids"))
    found = matched.groupBy("qid").agg(F.array_sort(F.collect_set("evidence_id")).alias("available"))
    t = traces.join(questions, "qid").join(ids, "qid", "left").join(found, "qid", "left")
    none = F.array().cast("array<string>")
    t = t.withColumns({
        "citations": F.coalesce("citations", none), "ids": F.coalesce("ids", none), "available": F.coalesce("available", none),
        "abstained": F.coalesce("abstained", F.lit(False)),
    })
    cited = t.select("qid", F.posexplode("citations").alias("at", "context_id"))
    hit = matched.groupBy("qid", "context_id").agg(F.collect_set("evidence_id").alias("e"))
    c = cited.join(contexts.select("qid", "context_id", "text"), ["qid", "context_id"], "left").join(hit, ["qid", "context_id"], "left").groupBy("qid").agg(
        F.count_if(F.col("e").isNotNull()).alias("supported"), F.array_distinct(F.flatten(F.collect_list("e"))).alias("cited_evidence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text")))), lambda x: x["text"]), " ").alias("cited_text"),
    )
    t = t.join(c, "qid", "left")
    has = F.size("citations") > 0
    answered = F.coalesce(F.col("answer"), F.lit("")) != ""
    f1 = F.when(F.col("answerable") & answered, F.round(token_f1(F.col("answer"), F.col("expected")), 6))
    t = t.withColumns({
        "citation_valid": (F.col("status") == "success") & (F.size(F.array_except("citations", "ids")) == 0),
        "precision": F.when(has, F.col("supported") / F.size("citations")),
        "recall": F.when(has, F.try_divide(F.size(F.array_intersect(F.coalesce("cited_evidence", none), "evidence_ids")), F.size("evidence_ids"))),
        "answer_f1": f1,
        "grounded": F.when(answered & has, token_f1(F.col("answer"), F.coalesce("cited_text", F.lit(""))) >= GROUNDED_F1),
    })
    t = t.withColumn("correct", F.when(F.col("answerable") & answered & ~F.col("abstained"), F.col("answer_f1") >= CORRECT_F1))
    label = attribution(*[F.col(x) for x in ("answerable", "status", "abstained", "citation_valid")], F.size("available") > 0, has, *[F.col(x) for x in ("precision", "correct", "grounded")])
    keep = [x for x in ("latency_seconds", "input_tokens", "output_tokens", "total_tokens", "category", "difficulty") if x in t.columns]
    return t.select(
        "qid", "answerable", "status", label.alias("attribution"), (F.size("available") > 0).alias("evidence_present"), "answer_f1", "correct", "grounded",
        "citation_valid", F.col("precision").alias("citation_precision"), F.col("recall").alias("citation_recall"), "abstained",
        (~F.col("answerable") & F.col("abstained") & F.col("citation_valid")).alias("expected_abstention"), *keep,
    )


def aggregate_answers(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Figures per grouping set of ``sets`` (use [] for all rows).  Missing token counts add 0 here."""
    pos, neg, ok = F.col("answerable"), ~F.col("answerable"), F.col("status") == "success"
    b = lambda c: c.cast("double")
    measures = {
        "questions": F.count(F.lit(1)), "answerable_questions": F.count_if(pos),
        "output_validity": F.avg(b(ok)), "false_abstention": F.avg(F.when(pos, b(F.col("abstained")))),
        "unanswerable_abstention": F.avg(F.when(neg, b(F.col("expected_abstention")))), "accepted": F.avg(F.when(pos, b(ok & ~F.col("abstained")))),
        "citation_validity": F.avg(F.when(ok, b(F.col("citation_valid")))), "citation_precision": F.avg(F.when(ok, F.col("citation_precision"))),
        "citation_recall": F.avg(F.when(ok, F.col("citation_recall"))), "groundedness": F.avg(F.when(pos, b(F.col("grounded")))),
    }
    if "latency_seconds" in rows.columns:
        measures |= {"mean_latency": F.avg("latency_seconds"), "median_latency": F.median("latency_seconds")}
    out = [F.round(m, 6).alias(n) if n not in ("questions", "answerable_questions") else m.alias(n) for n, m in measures.items()]
    out += [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens") if c in rows.columns]
    names = sorted({c for s in sets for c in s})
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(*out) if names else rows.agg(*out)


def attribution_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("attribution").agg(F.count(F.lit(1)).alias("n"))


def stratified_subset(questions: DataFrame, per_category: int = 2, order: tuple[str, ...] = ("easy", "medium", "hard")) -> DataFrame:
    """Per category the lowest id of each difficulty, filled up to ``per_category`` where there are more questions."""
    w = Window.partitionBy("category", "difficulty").orderBy("qid")
    marked = questions.withColumn("first", (F.row_number().over(w) == 1) & F.col("difficulty").isin(*order))
    rest = Window.partitionBy("category").orderBy("first", "qid")
    short = F.lit(per_category) - F.count_if("first").over(Window.partitionBy("category"))
    # One more at most: a category short of the number gets its lowest remaining id.
    topped = marked.withColumn("short", short).withColumn("n", F.row_number().over(rest))
    return topped.where(F.col("first") | ((F.col("short") > 0) & (F.col("n") == 1) & ~F.col("first"))).select("category", "difficulty", "qid")


def first_of_categories(questions: DataFrame, categories: list[str]) -> DataFrame:
    """The first question (by position) of each category."""
    w = Window.partitionBy("category").orderBy("position")
    return questions.where(F.col("category").isin(*categories)).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").orderBy("position")
