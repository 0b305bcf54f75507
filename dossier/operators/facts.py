"""Structured annual facts: eligibility, newest filing, concept priority, identical or dropped.

``raw`` rows: cik, ticker, company, concept, unit, idx, start, end, val, fy, fp, form, filed, accn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions.ids import pad_cik

# Metrics with their concepts in order of priority, forms and the bounds of a year.
CONCEPTS = (
    ("revenue", 0, "RevenueFromContractWithCustomerExcludingAssessedTax"), ("revenue", 1, "SalesRevenueNet"), ("revenue", 2, "Revenues"),
    ("net_income", 0, "NetIncomeLoss"), ("operating_income", 0, "OperatingIncomeLoss"), ("total_assets", 0, "Assets"),
    ("total_liabilities", 0, "Liabilities"), ("cash_and_cash_equivalents", 0, "CashAndCashEquivalentsAtCarryingValue"),
)
FLOW_METRICS = ("revenue", "net_income", "operating_income")
ANNUAL_FORMS = ("10-K", "10-K/A")
YEAR_DAYS = (350, 380)
FACTS_URL = "https://data.sec.gov/api/xbrl/companyfacts/CIK%s.json"
RAW_UNITS = "map<string,struct<units:map<string,array<struct<fy:int,fp:string,form:string,filed:string,accn:string,val:double,start:string,end:string>>>>>"


def concept_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONCEPTS), "metric string, priority int, concept string")


def explode_payload(payloads: DataFrame) -> DataFrame:
    """Raw rows of JSON payloads (ticker, company, json)."""
    doc = payloads.select("ticker", "company", F.get_json_object("json", "$.cik").alias("cik"), F.from_json(F.get_json_object("json", "$.facts.us-gaap"), RAW_UNITS).alias("f"))
    by_concept = doc.select("ticker", "company", pad_cik(F.col("cik")).alias("cik"), F.explode("f").alias("concept", "c"))
    by_unit = by_concept.select("ticker", "company", "cik", "concept", F.explode("c.units").alias("unit", "rows"))
    return by_unit.select("ticker", "company", "cik", "concept", "unit", F.posexplode("rows").alias("idx", "r")).select("ticker", "company", "cik", "concept", "unit", "idx", "r.*")


def flatten_cache(files: DataFrame) -> DataFrame:
    """Fact rows of cached company files (ticker, company, facts: array of records), one table over all companies."""
    return files.select("ticker", "company", F.explode("facts").alias("f")).select("ticker", "company", "f.*")


def payload_violations(payloads: DataFrame, companies: DataFrame) -> DataFrame:
    """ticker, rule for payloads that lack a facts or us-gaap object, units, or the company's cik."""
    c = companies.select("ticker", pad_cik(F.col("cik")).alias("want"))
    p = payloads.join(c, "ticker")
    facts, gaap = F.get_json_object("json", "$.facts"), F.get_json_object("json", "$.facts.us-gaap")
    parsed = F.from_json(gaap, "map<string,struct<units:map<string,array<string>>>>")
    rules = F.array_compact(F.array(
        F.when(facts.isNull(), "facts"), F.when(~F.coalesce(pad_cik(F.get_json_object("json", "$.cik")) == F.col("want"), F.lit(False)), "cik"),
        F.when(gaap.isNull(), "us-gaap"),
        F.when(F.exists(F.map_values(parsed), lambda v: v["units"].isNull() | F.exists(F.map_values(v["units"]), lambda u: u.isNull())), "units"),
    ))
    return p.select("ticker", F.explode(rules).alias("rule"))


def iso_date(text: Column) -> Column:
    """A padded ISO day, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def annual_error(row: str = "") -> Column:
    """The first reason why a row is no annual row, or null."""
    c = lambda n: F.col(row + n)
    end, filed = iso_date(c("end")), iso_date(c("filed"))
    return (
        F.when(~F.coalesce(c("form").isin(*ANNUAL_FORMS), F.lit(False)), "form_filter")
        .when(~F.coalesce(c("fy").between(1900, 2100), F.lit(False)), "fiscal_year_filter")
        .when(~F.coalesce(c("fp") == "FY", F.lit(False)), "fiscal_period_filter")
        .when(F.coalesce(F.trim(c("accn")), F.lit("")) == "", "missing_accession")
        .when(end.isNull() | filed.isNull() | (end > filed), "invalid_dates")
    )


def annual_anchors(raw: DataFrame) -> DataFrame:
    """cik, fy, filed, accn, form, anchor_end: the latest instant Assets end of every annual filing."""
    a = raw.where((F.col("concept") == "Assets") & (F.col("unit") == "USD") & (F.coalesce("start", F.lit("")) == "")).where(annual_error().isNull())
    return a.groupBy("cik", "fy", "filed", "accn", "form").agg(F.max("end").alias("anchor_end"))


def classify_rows(raw: DataFrame) -> DataFrame:
    """Every raw row of a mapped concept with metric, priority and its first failing reason (null: eligible)."""
    anchors = annual_anchors(raw)
    mapped = raw.join(F.broadcast(concept_table(raw.sparkSession)), "concept")
    met = mapped.join(anchors, ["cik", "fy", "filed", "accn", "form"], "left")
    flow = F.col("metric").isin(*FLOW_METRICS)
    days = F.datediff(iso_date(F.col("end")), iso_date(F.col("start"))) + 1
    first = F.when(F.col("unit") != "USD", "unit_filter").otherwise(annual_error())
    reason = F.coalesce(
        first,
        F.when(F.col("val").isNull() | F.isnan("val") | (F.abs("val") == float("inf")), "invalid_value"),
        F.when(F.col("anchor_end").isNull(), "missing_annual_period_anchor").when(F.col("end") != F.col("anchor_end"), "comparative_period"),
        F.when(flow & days.isNull(), "invalid_duration").when(flow & ~days.between(*YEAR_DAYS), "nonannual_duration").when(~flow & (F.coalesce("start", F.lit("")) != ""), "instant_metric_has_start"),
    )
    return met.withColumn("reason", reason)


def reason_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("metric", F.coalesce("reason", F.lit("period_eligible")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def select_facts(classified: DataFrame, anchors: DataFrame) -> DataFrame:
    """One fact per cik, year and metric, with every year's outcome.

    outcome: ok, ambiguous_current_period, no_eligible_fact_in_latest_annual_filing or
    ambiguous_same_period_values_or_durations.  Nothing is tried after an ambiguity.
    """
    newest = Window.partitionBy("cik", "fy")
    a = anchors.withColumn("newest", F.max("filed").over(newest)).where("filed = newest").groupBy("cik", "fy").agg(F.first("newest").alias("newest"), F.count_distinct("anchor_end").alias("ends"))
    metrics = concept_table(anchors.sparkSession).select("metric").distinct()
    years = a.join(F.broadcast(metrics))
    ok = classified.where("reason is null")
    near = years.join(ok, ["cik", "fy", "metric"], "left").where("filed = newest")
    w = Window.partitionBy("cik", "fy", "metric")
    best = near.withColumn("top", F.min("priority").over(w)).where("priority = top")
    same = F.struct("start", "end", "val", "unit", "concept")
    pick = best.groupBy("cik", "fy", "metric").agg(
        F.size(F.collect_set(F.struct(F.coalesce("start", F.lit("\u0000")).alias("s"), "end", "val", "unit", "concept"))).alias("kinds"), F.count(F.lit(1)).alias("rows"),
        F.min_by(F.struct(same.alias("v"), "form", "filed", "accn", "idx", "ticker", "company"), F.struct("accn", "idx")).alias("r"),
    )
    met = years.join(pick, ["cik", "fy", "metric"], "left")
    outcome = (
        F.when(F.col("ends") > 1, "ambiguous_current_period").when(F.col("rows").isNull(), "no_eligible_fact_in_latest_annual_filing")
        .when(F.col("kinds") > 1, "ambiguous_same_period_values_or_durations").otherwise("ok")
    )
    good = F.col("outcome") == "ok"
    keep = lambda c: F.when(good, c)
    return met.withColumn("outcome", outcome).select(
        "cik", F.col("fy").alias("fiscal_year"), "metric", "outcome", keep(F.col("r.ticker")).alias("ticker"), keep(F.col("r.company")).alias("company"),
        keep(F.col("r.v.concept")).alias("concept"), keep(F.col("r.v.val")).alias("value"), keep(F.col("r.v.unit")).alias("unit"),
        keep(F.col("r.form")).alias("form"), keep(F.col("r.filed")).alias("filing_date"), keep(F.col("r.accn")).alias("accession_number"),
        keep(F.col("r.v.start")).alias("start"), keep(F.col("r.v.end")).alias("end"), keep(F.col("rows") - 1).alias("duplicate_rows_resolved"),
        keep(F.concat(F.lit("/facts/us-gaap/"), F.col("r.v.concept"), F.lit("/units/"), F.col("r.v.unit"), F.lit("/"), F.col("r.idx").cast("string"))).alias("raw_fact_pointer"),
        keep(F.format_string(FACTS_URL, "cik")).alias("source_url"),
    )


def normalize_facts(raw: DataFrame) -> DataFrame:
    """Accepted facts of raw rows."""
    return select_facts(classify_rows(raw), annual_anchors(raw)).where("outcome = 'ok'").drop("outcome")


def concept_inventory(raw: DataFrame) -> DataFrame:
    """Per mapped concept: whether it occurs, its counts, units, forms, years and annual candidates."""
    g = raw.groupBy("concept").agg(
        F.count(F.lit(1)).alias("raw_fact_count"), F.array_sort(F.collect_set("unit")).alias("units"), F.array_sort(F.collect_set("form")).alias("forms"),
        F.array_sort(F.collect_set("fy")).alias("fiscal_years"), F.count_if(annual_error().isNull()).alias("annual_candidate_count"),
    )
    t = concept_table(raw.sparkSession)
    return t.join(g, "concept", "left").select("metric", "priority", "concept", F.col("raw_fact_count").isNotNull().alias("exists"), F.coalesce("raw_fact_count", F.lit(0)).alias("raw_fact_count"), "units", "forms", "fiscal_years", F.coalesce("annual_candidate_count", F.lit(0)).alias("annual_candidate_count"))


def lookup(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (ticker, fiscal_year, metric) with status and value.

    success: exactly one row of a mapped concept; invalid_input: unknown metric or
    missing argument; unavailable: anything else.
    """
    table = concept_table(facts.sparkSession)
    known = table.select("metric").distinct().withColumn("known", F.lit(True))
    own = facts.groupBy("ticker", "fiscal_year", "metric").agg(F.count(F.lit(1)).alias("rows"), F.first("value").alias("value"), F.first("unit").alias("unit"), F.first("concept").alias("concept"))
    r = requests.withColumn("ticker", F.upper("ticker")).join(F.broadcast(known), "metric", "left").join(own, ["ticker", "fiscal_year", "metric"], "left")
    r = r.join(F.broadcast(table.select("metric", "concept").withColumn("mapped", F.lit(True))), ["metric", "concept"], "left")
    status = F.when(F.col("known").isNull() | F.col("ticker").isNull() | F.col("fiscal_year").isNull(), "invalid_input").when((F.col("rows") == 1) & F.col("mapped"), "success").otherwise("unavailable")
    good = status == "success"
    return r.select("ticker", "fiscal_year", "metric", status.alias("status"), F.when(good, F.col("value")).alias("value"), F.when(good, F.col("unit")).alias("unit"), F.when(good, F.col("concept")).alias("concept"))


def verify_pointers(facts: DataFrame, raw: DataFrame) -> DataFrame:
    """Facts whose pointer does not lead to a raw row with the same value."""
    at = F.concat(F.lit("/facts/us-gaap/"), "concept", F.lit("/units/"), "unit", F.lit("/"), F.col("idx").cast("string"))
    r = raw.select("cik", at.alias("raw_fact_pointer"), F.col("val").alias("found"))
    return facts.join(r, ["cik", "raw_fact_pointer"], "left").where(~F.col("value").eqNullSafe(F.col("found")))


def fact_contexts(facts: DataFrame) -> DataFrame:
    """Facts as text contexts with defaults for what a fact does not have."""
    day = F.concat(F.col("fiscal_year").cast("string"), F.lit("-01-01"))
    value = F.when(F.col("value") == F.floor("value"), F.format_string("%.0f", "value")).otherwise(F.col("value").cast("string"))
    text = F.concat_ws(" ", "ticker", F.lit("fiscal"), F.col("fiscal_year").cast("string"), F.concat("metric", F.lit(":")), value, "unit")
    return facts.select(
        F.concat_ws(":", F.lit("financial"), "ticker", F.col("fiscal_year").cast("string"), "metric").alias("chunk_id"), F.lit("financial_data").alias("document_id"),
        F.coalesce("company", "ticker").alias("company"), "ticker", F.coalesce("cik", F.lit("")).alias("cik"), F.lit("10-K").alias("form"),
        F.coalesce("filing_date", day).alias("filing_date"), F.coalesce("end", day).alias("report_date"), F.coalesce("accession_number", F.lit("")).alias("accession_number"),
        F.lit("financial_data").alias("section_id"), F.lit("Structured SEC financial data").alias("section_name"), F.coalesce("source_url", F.lit("")).alias("source_url"),
        F.lit(0).alias("start_char"), F.length(text).alias("end_char"), text.alias("text"),
    )
