"""Item headings and section spans: a running maximum instead of a greedy loop.

A heading is accepted when its Item comes after every accepted one.  Rejected
headings never raise the maximum, so "greater than all before" is the same as
"greater than the last accepted", which a window computes without iterating.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions.text import strip_right

# The Items of the annual form in order, each with the start its title must have.
ITEMS = (
    ("1", "Business"), ("1A", "Risk Factors"), ("1B", "Unresolved Staff Comments"), ("1C", "Cybersecurity"), ("2", "Properties"),
    ("3", "Legal Proceedings"), ("4", "Mine Safety"), ("5", "Market for Registrant"), ("6", r"\[Reserved\]|Reserved|Selected Financial Data"),
    ("7", "Management"), ("7A", "Quantitative"), ("8", "Financial Statements"), ("9", "Changes in and Disagreements"),
    ("9A", "Controls and Procedures"), ("9B", "Other Information"), ("9C", "Disclosure Regarding Foreign"), ("10", "Directors"),
    ("11", "Executive Compensation"), ("12", "Security Ownership"), ("13", "Certain Relationships"), ("14", "Principal Accountant"),
    ("15", "Exhibits?|Exhibit and Financial"), ("16", "Form 10-K Summary"),
)
HEADING = r"(?i)^item[\s\p{Z}]+(\p{Nd}{1,2}[ABC]?)[\s\p{Z}]*[.\-–—:]?[\s\p{Z}]+(.+)$"
MAX_HEADING = 220
CORE_ITEMS, CORE_CHARS = ("1", "1A", "7", "8"), 500


def item_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(ITEMS)], "item string, ord int, title_pattern string")


def heading_candidates(blocks: DataFrame) -> DataFrame:
    """Paragraph blocks without a link that read as an Item heading: + item, ord, title."""
    item = F.upper(F.regexp_extract("text", HEADING, 1))
    title = F.trim(F.regexp_extract("text", HEADING, 2))
    found = blocks.where((F.col("type") != "table") & ~F.col("linked") & (F.length("text") <= MAX_HEADING) & F.col("text").rlike(HEADING))
    named = found.withColumn("item", item).withColumn("title", title)
    known = named.join(F.broadcast(item_table(blocks.sparkSession)), "item")
    return known.where(F.expr("title rlike concat('(?i)^(?:', title_pattern, ')')")).drop("title_pattern")


def select_headings(candidates: DataFrame) -> DataFrame:
    """``candidates`` (id, pos, ord) + accepted."""
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("ord").over(w)
    return candidates.withColumn("accepted", before.isNull() | (F.col("ord") > before))


def section_spans(selected: DataFrame, texts: DataFrame) -> DataFrame:
    """Sections of accepted headings, each up to the next one: id, item, name, start_char, end_char, text.

    ``texts``: id, full_text.
    """
    w = Window.partitionBy("id").orderBy("pos")
    kept = selected.where("accepted").withColumn("next", F.lead("start_char").over(w)).join(texts, "id")
    raw = F.substring(F.col("full_text"), F.col("start_char") + 1, F.coalesce(F.col("next"), F.length("full_text")) - F.col("start_char"))
    body = strip_right(raw)
    return kept.select(
        "id", "item", "ord", F.concat(F.col("id").cast("string"), F.lit(":item_"), "item").alias("section_id"), F.col("title").alias("name"), F.col("text").alias("heading"),
        "start_char", (F.col("start_char") + F.length(body)).alias("end_char"), body.alias("text"),
    )


def heading_warnings(selected: DataFrame) -> DataFrame:
    return selected.where("not accepted").select("id", F.format_string("Ignored duplicate or out-of-order heading: Item %s at block %d", "item", "pos").alias("warning"))


def core_warnings(sections: DataFrame, ids: DataFrame) -> DataFrame:
    """id, item for core Items that are missing or short."""
    core = ids.sparkSession.createDataFrame([(i,) for i in CORE_ITEMS], "item string")
    have = sections.where(F.length("text") >= CORE_CHARS).select("id", "item")
    return ids.select("id").join(F.broadcast(core)).join(have, ["id", "item"], "left_anti")
