"""Rule routing of questions, argument slots, and the status of a routed run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Routing vocabularies, companies and metrics in their order of preference.
FINANCIAL = r"(?i)\b(revenue|net income|operating income|total assets|total liabilities|cash|cash equivalents)\b"
NARRATIVE = r"(?i)\b(risk|risks|business|strategy|cybersecurity|properties|legal proceedings|why|how|describe|explain|drove|change|products|services)\b"
YEAR = r"\b(20\d{2})\b"
COMPANIES = (("Apple", "AAPL"), ("Microsoft", "MSFT"), ("NVIDIA", "NVDA"))
METRICS = ("revenue", "net_income", "operating_income", "total_assets", "total_liabilities", "cash_and_cash_equivalents")

REASONS = {
    "empty": "empty query", "document_retrieval+financial_data": "financial fact requested with narrative explanation",
    "financial_data": "standardized financial metric and fiscal year detected", "document_retrieval": "SEC narrative or section language detected",
    "abstain": "no supported source pattern detected",
}


def route(query: Column) -> Column:
    """document_retrieval, financial_data, both joined by +, or abstain."""
    financial, narrative, year = query.rlike(FINANCIAL), query.rlike(NARRATIVE), query.rlike(YEAR)
    return (
        F.when(F.coalesce(F.trim(query), F.lit("")) == "", "abstain").when(financial & narrative, "document_retrieval+financial_data")
        .when(financial & year, "financial_data").when(narrative, "document_retrieval").otherwise("abstain")
    )


def reason(query: Column) -> Column:
    r = route(query)
    named = F.when(F.coalesce(F.trim(query), F.lit("")) == "", REASONS["empty"])
    for name in ("document_retrieval+financial_data", "financial_data", "document_retrieval"):
        named = named.when(r == name, REASONS[name])
    return named.otherwise(REASONS["abstain"])


def ticker_slot(query: Column) -> Column:
    """Symbols in fixed order, then company names in fixed order; empty without either."""
    c = None
    for word, symbol in [(s, s) for _, s in COMPANIES] + list(COMPANIES):
        test = query.rlike(rf"(?i)\b{word}\b")
        c = F.when(test, symbol) if c is None else c.when(test, symbol)
    return c.otherwise("")


def year_slot(query: Column) -> Column:
    y = F.regexp_extract(query, YEAR, 1)
    return F.when(y == "", 0).otherwise(F.try_to_number(y, F.lit("9999")).cast("int"))


def metric_slot(query: Column) -> Column:
    c = None
    for m in METRICS:
        test = query.rlike("(?i)" + m.replace("_", r"\s+"))
        c = F.when(test, m) if c is None else c.when(test, m)
    return c.otherwise("")


def fold_status(decision: Column, statuses: Column) -> Column:
    """Status of a run from its tools' statuses (an array)."""
    return (
        F.when(decision == "abstain", "unsupported").when(F.array_contains(statuses, "success"), "success")
        .when(F.array_contains(statuses, "invalid_input"), "tool_input_error").otherwise("insufficient_evidence")
    )
