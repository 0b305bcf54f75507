"""Execution traces: token use, failure labels, tri-state rates, distributions, import checks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.masking import masked
from dossier.functions.text import REDACTED
from dossier.operators.json_rules import json_violations
from dossier.operators.quantiles import with_quantiles

# Failure labels in reporting order and in order of precedence; hosts whose links may be kept.
TAXONOMY = (
    "success", "expected_abstention", "unsupported_query", "retrieval_failure", "tool_failure", "routing_failure",
    "generation_failure", "citation_failure", "invalid_output", "partial_evidence",
)
PRECEDENCE = (
    "routing_failure", "tool_failure", "retrieval_failure", "partial_evidence", "generation_failure", "citation_failure",
    "invalid_output", "unsupported_query", "expected_abstention", "success",
)
#: Runs of this kind always search documents, whatever their route.
RETRIEVAL_SOURCE = "phase4b"
LINK_HOSTS = ("www.sec.gov", "data.sec.gov")
TOKENS = ("input_tokens", "output_tokens", "total_tokens")
RETRIEVAL_FIELDS = ("mode", "top_k")
PROVIDER_FIELDS = ("model_digest", "num_ctx", "seed")
PROMPT_FIELDS = ("version", "max_context_characters")
EVIDENCE_FIELDS = (
    "context_id", "chunk_id", "document_id", "source_document_id", "ticker", "cik", "form", "filing_date", "report_date", "accession_number", "item", "section_id",
    "start_char", "end_char", "metric", "concept", "unit", "value", "fiscal_year", "start", "end", "raw_fact_pointer", "raw_sha256",
)
CONFIG_FIELDS = ("mode", "top_k", "provider", "model", "temperature", "max_output_tokens", "timeout_seconds", "max_retries")
SAFE_DETAILS = (
    "Malformed structured output", "Unexpected structured output fields", "Answer and abstention types are invalid", "Invalid or duplicate citations",
    "Citation references nonexistent context", "Inline citations and citation list differ", "Abstention requires canonical answer and no citations",
    "Non-abstaining answer requires supporting citations", "Context text/provenance differs from retrieved chunks", "Citation was not retrieved for this question",
)


def valid_number(c: Column) -> Column:
    """``c`` where it is finite and not negative, else null."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (c < float("inf")) & (c >= 0), c)


def usage(given: Column) -> Column:
    """struct of token counts: negatives are unknown, a missing total is derived, a conflicting one unknown."""
    i, o, t = (F.when(given[n] >= 0, given[n]) for n in TOKENS)
    total = F.when(i.isNotNull() & o.isNotNull(), F.when(t.isNull() | (t == i + o), i + o)).otherwise(t)
    return F.struct(i.alias("input_tokens"), o.alias("output_tokens"), total.alias("total_tokens"))


def attempts_usage(attempts: Column) -> Column:
    """Sum of :func:`usage` over an array of attempts; null where any attempt's count is unknown."""
    each = F.transform(attempts, usage)

    def add(n: str) -> Column:
        return F.aggregate(each, F.lit(0).cast("long"), lambda s, a: s + a[n])

    return F.struct(*[add(n).alias(n) for n in TOKENS])


def public_query(text: Column, reviewed: Column) -> Column:
    """The reviewed wording where there is one, else a mask."""
    return F.struct(
        F.coalesce(reviewed, F.lit(REDACTED)).alias("text"),
        F.when(reviewed.isNotNull(), "reviewed_public_text").otherwise("unreviewed_text_withheld").alias("policy"),
    )


def public_link(url: Column) -> Column:
    """An https link to an allowed host without user, query or fragment, else null."""
    host, scheme = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PROTOCOL"))
    ok = (scheme == "https") & host.isin(*LINK_HOSTS) & F.try_parse_url(url, F.lit("USERINFO")).isNull()
    return F.when(ok, F.concat(F.lit("https://"), F.try_parse_url(url, F.lit("AUTHORITY")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))))


def public_config(config: DataFrame) -> DataFrame:
    """Only the allowed operational fields."""
    return config.select(*[c for c in CONFIG_FIELDS if c in config.columns])


def _only(parent: Column, kind: T.DataType | None, names: tuple[str, ...]) -> Column:
    """A struct of ``names``; those that ``kind`` lacks are null."""
    have = {f.name for f in kind.fields} if isinstance(kind, T.StructType) else set()
    return F.struct(*[(parent[n] if n in have else F.lit(None).cast("string")).alias(n) for n in names])


def _kind(kind: T.DataType | None, name: str) -> T.DataType | None:
    return next((f.dataType for f in kind.fields if f.name == name), None) if isinstance(kind, T.StructType) else None


def nested_config(config: Column, kind: T.StructType) -> Column:
    """struct retrieval, generation (with provider_options and prompt): the allowed fields of a nested configuration."""
    llm = _kind(kind, "llm")
    generation = ("provider", "model", "temperature", "max_output_tokens", "timeout_seconds", "max_retries")
    have = {f.name for f in llm.fields} if isinstance(llm, T.StructType) else set()
    own = [(config["llm"][n] if n in have else F.lit(None).cast("string")).alias(n) for n in generation]
    options = _only(config["llm"]["provider_options"], _kind(llm, "provider_options"), PROVIDER_FIELDS) if _kind(llm, "provider_options") else _only(config, None, PROVIDER_FIELDS)
    prompt = _only(config["prompt"], _kind(kind, "prompt"), PROMPT_FIELDS) if _kind(kind, "prompt") else _only(config, None, PROMPT_FIELDS)
    retrieval = _only(config["retrieval"], _kind(kind, "retrieval"), RETRIEVAL_FIELDS) if _kind(kind, "retrieval") else _only(config, None, RETRIEVAL_FIELDS)
    return F.struct(retrieval.alias("retrieval"), F.struct(*own, options.alias("provider_options"), prompt.alias("prompt")).alias("generation"))


def evidence_references(rows: Column, kind: T.ArrayType) -> Column:
    """Evidence with the allowed fields that it has, and its link where that may be shown."""
    have = [f.name for f in kind.elementType.fields]
    keep = [n for n in EVIDENCE_FIELDS if n in have]

    def one(e: Column) -> Column:
        link = [public_link(e["source_url"]).alias("source_url")] if "source_url" in have else []
        return F.struct(*[e[n].alias(n) for n in keep], *link)

    return F.transform(rows, one)


def public_error(code: Column, detail: Column) -> Column:
    return F.struct(code.alias("code"), F.when(detail.isNull() | detail.isin(*SAFE_DETAILS), detail).otherwise(REDACTED).alias("detail"))


def failure_flags(t: DataFrame) -> dict[str, Column]:
    """A flag per label but success, in the order of the taxonomy's rules.

    Columns: errors, routing_correct, routing_error, route, tools (array of name,
    status), generation_status, evidence_sufficient, result_sufficient,
    expected_abstention, abstained, contract_valid, and those of :func:`_tool_flags`;
    source_kind where there is one.  Every label that stands among the errors counts.
    """
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    searched = yes(F.contains(c("route"), F.lit("document_retrieval")))
    if "source_kind" in t.columns:
        searched = searched | yes(c("source_kind") == RETRIEVAL_SOURCE)
    insufficient = searched & yes(~c("evidence_sufficient"))
    money, observed, expected = c("__money"), c("abstained"), c("expected_abstention")
    rules = {
        "routing_failure": yes(~c("routing_correct")) | yes(c("routing_error")),
        "tool_failure": c("__tool_failed"),
        "retrieval_failure": c("__retrieval_failed") | (insufficient & ~money),
        "partial_evidence": (insufficient & money) | (yes(~c("result_sufficient")) & money & (F.size("tools") > 1)) | c("__partly"),
        "generation_failure": yes(c("generation_status").isin("provider_error", "incomplete_output", "generation_error")) | yes(expected & ~observed)
        | (yes(~expected & observed) & yes(c("result_sufficient"))),
        "invalid_output": yes(c("generation_status").isin("preparation_error", "invalid_output")),
        "citation_failure": F.lit(False),
        "unsupported_query": yes(c("route") == "abstain"),
        "expected_abstention": yes(expected & observed & c("contract_valid")),
    }
    return {n: flag | yes(F.array_contains("errors", n)) for n, flag in rules.items()}


def _tool_flags() -> dict[str, Column]:
    """What the statuses of a run's tools say."""
    tool = lambda test: F.exists("tools", test)
    bad = lambda x: x["status"].isin("error", "invalid_input")
    return {
        "__money": tool(lambda x: (x["name"] == "financial_data") & (x["status"] == "success")),
        "__tool_failed": tool(lambda x: bad(x) & (x["name"] != "document_retrieval")),
        "__retrieval_failed": tool(lambda x: bad(x) & (x["name"] == "document_retrieval")),
        "__partly": tool(lambda x: x["status"] == "unavailable") & tool(lambda x: x["status"] == "success"),
    }


def classify(traces: DataFrame) -> DataFrame:
    """``traces`` plus categories (all labels, in reporting order) and primary (the first by precedence).

    Flags are columns, computed once; labels and precedence only read them.
    """
    own = traces.columns
    flagged = traces.withColumns(_tool_flags())
    rules = failure_flags(flagged)
    flagged = flagged.withColumns({f"__{n}": flag for n, flag in rules.items()})
    any_flag = functools.reduce(lambda a, b: a | b, [F.col(f"__{n}") for n in rules])
    clean = ~any_flag & (F.coalesce(F.size("errors"), F.lit(0)) <= 0) & F.coalesce("contract_valid", F.lit(False))
    flagged = flagged.withColumn("__success", clean | F.coalesce(F.array_contains("errors", "success"), F.lit(False)))
    labels = F.array_compact(F.array(*[F.when(F.col(f"__{n}"), F.lit(n)) for n in TAXONOMY]))
    first = F.coalesce(*[F.when(F.col(f"__{n}"), F.lit(n)) for n in PRECEDENCE])
    return flagged.select(*own, labels.alias("categories"), first.alias("primary"))


def build_traces(runs: DataFrame) -> DataFrame:
    """Classified runs with a deterministic trace_id where none is given, and no private text."""
    known = F.col("trace_id") if "trace_id" in runs.columns else F.lit(None).cast("string")
    name = F.sha2(F.concat_ws("\u0001", F.lit("6.1"), "source_kind", F.col("source_id").cast("string")), 256)
    out = runs.withColumn("trace_id", F.coalesce(known, name)).withColumn("schema_version", F.lit("6.1"))
    return classify(out)


def trace_violations(traces: DataFrame) -> DataFrame:
    """trace_id, rule for every broken rule of a built trace."""
    rules = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("schema_version") == "6.1", F.lit(False)), "schema_version"),
        F.when(~F.coalesce(F.col("trace_id").rlike(r"^[A-Za-z0-9_-]{1,128}\z"), F.lit(False)), "trace_id"),
        F.when(F.size(F.array_except("categories", F.array(*map(F.lit, TAXONOMY)))) > 0, "categories"),
        F.when(F.col("primary").isNotNull() & ~F.array_contains("categories", F.col("primary")), "primary"),
        *[F.when(F.col(n) < 0, n) for n in TOKENS if n in traces.columns],
    ))
    return traces.select("trace_id", F.explode(rules).alias("rule"))


def _object(fields: str, **properties: dict) -> dict:
    return {"type": "object", "required": fields.split(), "properties": properties}


_SECONDS, _COUNT, _FLAG = {"type": ["number", "null"], "minimum": 0}, {"type": ["integer", "null"], "minimum": 0}, {"type": ["boolean", "null"]}
# The fields that a stored trace must have, and what they may hold.
_TRACE_FIELDS = {
    "source": _object("kind id"), "query": _object("id text policy"), "routing": _object("decision reason tools_selected correct latency_seconds", latency_seconds=_SECONDS),
    "retrieval": _object("configuration evidence latency_seconds latency_source evidence_sufficient sufficiency_basis", latency_seconds=_SECONDS),
    "generation": _object("configuration status latency_seconds token_usage", token_usage=_object(" ".join(TOKENS), **dict.fromkeys(TOKENS, _COUNT)), latency_seconds=_SECONDS),
    "validation": _object("json_schema_valid output_contract_valid citation_valid errors details latency_seconds", latency_seconds=_SECONDS),
    "abstention": _object("observed expected correct", observed=_FLAG, expected=_FLAG, correct=_FLAG),
    "result": _object("orchestration_status validation_status evidence_sufficient claims_supported answer citations"),
    "latency": _object("end_to_end_seconds recorded_seconds recorded_scope orchestration_seconds tool_seconds"),
    "lower_level": _object("orchestration_status generation_status error legacy_attribution attempts"),
    "schema_version": {"const": "6.1"}, "trace_id": {"type": "string", "minLength": 1, "pattern": "^[A-Za-z0-9_-]{1,128}$"}, "timestamp": {"type": ["string", "null"], "format": "date-time"},
    "tools": {"type": "array", "items": _object("name status latency_seconds error evidence")},
    "failure_attribution": _object("primary categories", primary={"enum": [None, *TAXONOMY]}, categories={"type": "array", "uniqueItems": True, "items": {"enum": list(TAXONOMY)}}),
}
TRACE_SCHEMA = {"type": "object", "additionalProperties": False, "required": list(_TRACE_FIELDS), "properties": _TRACE_FIELDS}


def stored_trace_violations(stored: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, rule for every rule of the trace schema that a stored JSON trace breaks, and a primary label that is not among its categories."""

    def apart(v: Column) -> list[tuple[str, str, Column]]:
        primary, labels = F.try_variant_get(v, "$.failure_attribution.primary", "string"), F.try_variant_get(v, "$.failure_attribution.categories", "array<string>")
        return [("$.failure_attribution", "primary", primary.isNotNull() & labels.isNotNull() & ~F.array_contains(labels, primary))]

    return json_violations(stored, key, text, TRACE_SCHEMA, apart)


def unified_traces(runs: DataFrame, secrets: tuple[str, ...] = ()) -> DataFrame:
    """trace_id and trace, the whole public record of each run as JSON without private text or the ``secrets``.

    ``runs``: the columns of :func:`classify` and source_kind, source_id, query, reviewed (its public wording), reason,
    tools_selected, timestamp, latencies (struct of retrieval, generation, recorded, orchestration), usage (struct of
    token counts), citations, has_output, and config (nested); evidence (array) where there is one.
    """
    c, none = F.col, F.lit(None).cast("string")
    q, given = public_query(c("query"), c("reviewed")), c("trace_id") if "trace_id" in runs.columns else none
    built = classify(runs)
    kind = runs.schema["config"].dataType
    safe = nested_config(c("config"), kind)
    evidence = evidence_references(c("evidence"), runs.schema["evidence"].dataType) if "evidence" in runs.columns else F.array().cast("array<struct<context_id:string>>")
    name = F.coalesce(given, F.sha2(F.concat_ws("\u0001", F.lit("6.1"), "source_kind", c("source_id").cast("string")), 256))
    seconds = {n: valid_number(c("latencies")[n]) for n in ("retrieval", "generation", "recorded", "orchestration")}
    selected = c("tools_selected")
    decision = F.when(selected.isNull(), none).when(F.size(selected) == 0, F.lit("abstain")).otherwise(F.array_join(selected, "+"))
    checked = F.when(c("contract_valid"), "passed").when(~c("contract_valid"), "failed").otherwise("unavailable")
    tool = lambda t: F.struct(t["name"].alias("name"), t["status"].alias("status"), F.lit(None).cast("double").alias("latency_seconds"), none.alias("error"), F.array().cast("array<string>").alias("evidence"))
    agree = c("expected_abstention") == c("abstained")
    trace = F.struct(
        F.lit("6.1").alias("schema_version"), name.alias("trace_id"), c("timestamp"), F.struct(c("source_kind").alias("kind"), c("source_id").cast("string").alias("id")).alias("source"),
        F.struct(name.alias("id"), q["text"].alias("text"), q["policy"].alias("policy")).alias("query"),
        F.struct(decision.alias("decision"), c("reason"), selected.alias("tools_selected"), c("routing_correct").alias("correct"), F.lit(None).cast("double").alias("latency_seconds")).alias("routing"),
        F.transform("tools", tool).alias("tools"),
        F.struct(safe["retrieval"].alias("configuration"), evidence.alias("evidence"), seconds["retrieval"].alias("latency_seconds"),
                 F.when(seconds["retrieval"].isNotNull(), "recorded_retrieval_stage").alias("latency_source"), c("evidence_sufficient"), none.alias("sufficiency_basis")).alias("retrieval"),
        F.struct(safe["generation"].alias("configuration"), c("generation_status").alias("status"), seconds["generation"].alias("latency_seconds"), usage(c("usage")).alias("token_usage")).alias("generation"),
        F.struct(none.alias("json_schema_valid"), c("contract_valid").alias("output_contract_valid"), none.alias("citation_valid"), c("errors"), F.array().cast("array<string>").alias("details"), F.lit(None).cast("double").alias("latency_seconds")).alias("validation"),
        F.struct(c("abstained").alias("observed"), c("expected_abstention").alias("expected"), agree.alias("correct")).alias("abstention"),
        F.struct(F.coalesce("primary", F.lit("unavailable")).alias("orchestration_status"), checked.alias("validation_status"), c("result_sufficient").alias("evidence_sufficient"), none.alias("claims_supported"),
                 F.when(c("has_output"), REDACTED).alias("answer"), c("citations")).alias("result"),
        F.struct(F.lit(None).cast("double").alias("end_to_end_seconds"), seconds["recorded"].alias("recorded_seconds"), F.when(c("source_kind") != "runtime", "historical_generation_pipeline").alias("recorded_scope"),
                 seconds["orchestration"].alias("orchestration_seconds"), F.lit(None).cast("double").alias("tool_seconds")).alias("latency"),
        F.struct(none.alias("orchestration_status"), c("generation_status"), none.alias("error"), none.alias("legacy_attribution"), F.array().cast("array<string>").alias("attempts")).alias("lower_level"),
        F.struct(c("primary"), c("categories")).alias("failure_attribution"),
    )
    whole = built.select(name.alias("trace_id"), trace.alias("trace"))
    return whole.select("trace_id", F.to_json(masked(F.col("trace"), whole.schema["trace"].dataType, secrets), {"ignoreNullFields": "false"}).alias("trace"))


def unique_traces(traces: DataFrame, key: str = "trace_id") -> tuple[DataFrame, DataFrame]:
    """(one row per id, ids whose rows differ).  Equal repeats collapse."""
    rest = [c for c in traces.columns if c != key]
    w = Window.partitionBy(key)
    marked = traces.dropDuplicates().withColumn("versions", F.count(F.lit(1)).over(w))
    return marked.where("versions = 1").select(key, *rest), marked.where("versions > 1").select(key).distinct()


def rate(c: Column, prefix: str) -> list[Column]:
    """value, numerator, denominator, unavailable of a tri-state column."""
    return [
        F.round(F.try_divide(F.count_if(c), F.count(c)), 6).alias(f"{prefix}_value"), F.count_if(c).alias(f"{prefix}_numerator"),
        F.count(c).alias(f"{prefix}_denominator"), F.count_if(c.isNull()).alias(f"{prefix}_unavailable"),
    ]


def distribution(name: str, prefix: str) -> list[Column]:
    """count, unavailable, mean, median and nearest-rank p95 of the valid values of a double column.

    percentile_disc takes the smallest value whose rank reaches ceil(0.95 n).
    """
    text = f"CASE WHEN NOT isnan({name}) AND {name} < double('Infinity') AND {name} >= 0 THEN {name} END"
    v = F.expr(text)
    disc = F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {text})")
    return [
        F.count(v).alias(f"{prefix}_count"), F.count_if(v.isNull()).alias(f"{prefix}_unavailable"), F.round(F.avg(v), 6).alias(f"{prefix}_mean"),
        F.round(F.median(v), 6).alias(f"{prefix}_median"), disc.alias(f"{prefix}_p95"),
    ]


def distribution_by(df: DataFrame, by: list[str], name: str, prefix: str) -> DataFrame:
    """The figures of :func:`distribution` for each group, with quantiles that need no buffer of a whole group."""
    v = valid_number(F.col(name))
    figures = df.groupBy(*by).agg(F.count(v).alias(f"{prefix}_count"), F.count_if(v.isNull()).alias(f"{prefix}_unavailable"), F.round(F.avg(v), 6).alias(f"{prefix}_mean"))
    out = with_quantiles(figures, df, by, v, {f"{prefix}_median": "median", f"{prefix}_p95": 0.95})
    return out.withColumn(f"{prefix}_median", F.round(f"{prefix}_median", 6))


def token_figures(n: str) -> list[Column]:
    """Known sum and mean, and the total and average that exist only when every run has a count."""
    c = F.col(n)
    full = F.count(c) == F.count(F.lit(1))
    return [
        F.sum(c).alias(f"{n}_known_sum"), F.round(F.avg(c), 6).alias(f"{n}_known_mean"), F.when(full, F.sum(c)).alias(f"{n}_total"),
        F.when(full, F.round(F.avg(c), 6)).alias(f"{n}_average"), F.count_if(c.isNull()).alias(f"{n}_unavailable"),
    ]


def failure_counts(classified: DataFrame) -> DataFrame:
    """label, primary_count (exclusive), all_count (overlapping), zero-filled over the taxonomy."""
    names = classified.sparkSession.createDataFrame([(n,) for n in TAXONOMY], "label string")
    first = classified.groupBy(F.col("primary").alias("label")).agg(F.count(F.lit(1)).alias("primary_count"))
    every = classified.select(F.explode("categories").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("all_count"))
    return names.join(first, "label", "left").join(every, "label", "left").na.fill({"primary_count": 0, "all_count": 0})


def match_results(results: DataFrame, traces: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(results with the one trace that agrees on ``keys``, results without exactly one)."""
    t = traces.select(*[F.col(k).alias(f"t_{k}") for k in keys], "trace_id")
    on = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"t_{k}"))
        on = test if on is None else on & test
    met = results.join(t, on, "left").drop(*[f"t_{k}" for k in keys])
    many = met.withColumn("found", F.count("trace_id").over(Window.partitionBy(*keys)))
    return many.where("found = 1").drop("found"), many.where("found <> 1").select(*keys).distinct()


def hash_mismatches(files: DataFrame, expected: DataFrame) -> DataFrame:
    """path whose content hash is not the expected one.  ``files``: path, content; ``expected``: path, sha256."""
    return files.select("path", F.sha2("content", 256).alias("found")).join(expected, "path").where("found <> sha256").select("path")


def stage_timer():
    """A driver-side timer: ``with timer("name"): ...`` collects seconds by stage."""
    import contextlib
    import time

    class Timer:
        def __init__(self):
            self.seconds: dict[str, float] = {}

        @contextlib.contextmanager
        def __call__(self, name: str):
            began = time.perf_counter()
            try:
                yield
            finally:
                self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    return Timer()


def report(rates: dict[str, dict], counts: DataFrame) -> str:
    """A short Markdown report of rates and failure counts."""
    lines = ["# Trace report", "", "| metric | value | known | unavailable |", "|---|---|---|---|"]
    for name, r in rates.items():
        value = "unavailable" if r["value"] is None else f"{r['value']:.2%}"
        lines.append(f"| {name} | {value} | {r['denominator']} | {r['unavailable']} |")
    lines += ["", "| label | primary | all |", "|---|---|---|"]
    for row in counts.orderBy("label").collect():  # one row per label of the taxonomy
        lines.append(f"| {row['label']} | {row['primary_count']} | {row['all_count']} |")
    return "\n".join(lines) + "\n"
