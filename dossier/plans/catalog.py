"""All queries over the test tables, with the DuckDB SQL that checks them.

A query takes (spark, sf_dir) and reads whole tables.  The SQL is written on its
own, from the operators' definitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions.text import PRIVATE_MASKS, SECRET_KEY, mask_keys, retrieval_tokens, token_f1
from dossier.operators import answers, benchmark, chunking, dense, evidence, facts, grounding, html, lexical, postings, rerank, router, sections, traces
from dossier.plans import frames
from dossier.plans.frames import table
from dossier.sources import files, filings
from dossier.sources.stored import stored
from dossier.streaming import events as event_plans

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- shared SQL

_TOKEN = r"\p{Nd}{1,3}(?:,\p{Nd}{3})+(?:\.\p{Nd}+)?%?|[\p{L}\p{N}_]+(?:[.\-''’][\p{L}\p{N}_]+)*%?"


def _tok(x: str) -> str:
    found = f"regexp_extract_all(translate(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '’‐‑', '''--'), '{_TOKEN}')"
    return rf"list_transform({found}, lambda t: CASE WHEN regexp_matches(t, '^\p{{Nd}}') THEN replace(t, ',', '') ELSE t END)"


_BASE = f"""
tok AS (SELECT doc_id AS id, lang, {_tok('text')} AS tokens FROM documents),
docs AS (SELECT id, lang, tokens, len(tokens) AS length FROM tok),
q AS (SELECT item_id AS qid, {_tok('text')} AS tokens FROM benchmark),
terms AS (SELECT DISTINCT qid, unnest(tokens) AS token FROM q),
stat AS (SELECT count(*) AS n, avg(length) AS mean FROM docs),
post AS (SELECT token, id, length, count(*) AS tf FROM (SELECT id, length, unnest(tokens) AS token FROM docs) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token)"""


def _bm25(name: str) -> str:
    k1, b = frames.SYSTEMS[name]
    return f"""
s_{name} AS (
  SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * length / mean))), 6) AS score
  FROM post JOIN df USING (token) JOIN terms USING (token), stat GROUP BY qid, id),
r_{name} AS (
  SELECT q.qid, docs.id, coalesce(s.score, 0) AS score,
    row_number() OVER (PARTITION BY q.qid ORDER BY coalesce(s.score, 0) DESC, docs.id) AS rank
  FROM q CROSS JOIN docs LEFT JOIN s_{name} s ON s.qid = q.qid AND s.id = docs.id)"""


_FUSED = f"""
f AS (
  SELECT qid, id, round(sum(1.0::DOUBLE / (60.0 + rank)), 12) AS score
  FROM (SELECT qid, id, rank FROM r_bm25 UNION ALL SELECT qid, id, rank FROM r_flat) WHERE rank <= {frames.DEPTH} GROUP BY qid, id),
r_rrf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f)"""

_RANKED = f"WITH {_BASE}, {_bm25('bm25')}, {_bm25('flat')}, {_FUSED}"

_GOLD = """
gold AS (
  SELECT item_id || ':' || doc_id AS evidence_id, item_id AS qid, doc_id AS document_id,
    instr(d.text, b.text) - 1 AS start_char, instr(d.text, b.text) - 1 + length(b.text) AS end_char, b.text AS text
  FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
label AS (
  SELECT item_id AS qid, n IS NOT NULL AS answerable, coalesce(n > 1, false) AS multi,
    CASE WHEN length(text) < 160 THEN 'short' WHEN length(text) < 260 THEN 'medium' ELSE 'long' END AS category,
    CASE item_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty
  FROM benchmark LEFT JOIN (SELECT qid, count(DISTINCT document_id) AS n FROM gold GROUP BY qid) g ON g.qid = item_id)"""


def _metrics() -> str:
    """Per system and answerable question; a whole document is a chunk, so a found item is covered whole."""
    cols = []
    for k in evidence.KS:
        cols.append(
            f"coalesce(count(*) FILTER (WHERE rank <= {k}), 0) / n::DOUBLE AS recall_{k}, (count(*) FILTER (WHERE rank <= {k}) > 0)::INT AS hit_{k}, "
            f"(count(*) FILTER (WHERE rank <= {k}) = n)::INT AS complete_{k}, "
            f"CASE WHEN multi THEN (count(*) FILTER (WHERE rank <= {k}) = n)::INT END AS multi_{k}, coalesce(count(*) FILTER (WHERE rank <= {k}), 0) / n::DOUBLE AS union_{k}"
        )
    return f"""
allr AS (
  SELECT 'bm25' AS system, qid, id, rank FROM r_bm25 UNION ALL SELECT 'flat', qid, id, rank FROM r_flat
  UNION ALL SELECT 'rrf', qid, id, rank FROM r_rrf),
need AS (SELECT qid, count(*) AS n FROM gold GROUP BY qid),
pq AS (
  SELECT s.system, l.qid, l.multi, l.category, l.difficulty, need.n, coalesce(1.0::DOUBLE / min(rank), 0) AS reciprocal_rank, min(rank) AS first_rank,
    coalesce(list_sort(list(evidence_id) FILTER (WHERE rank <= 10)), []) AS recovered_10, {', '.join(cols)}
  FROM label l JOIN need USING (qid) CROSS JOIN (SELECT DISTINCT system FROM allr) s JOIN gold ON gold.qid = l.qid
  LEFT JOIN allr ON allr.system = s.system AND allr.qid = l.qid AND allr.id = gold.document_id
  WHERE l.answerable GROUP BY s.system, l.qid, l.multi, l.category, l.difficulty, need.n)"""


_PER_QUESTION = f"{_RANKED}, {_GOLD}, {_metrics()}"


def _macro(by: str) -> str:
    cols = ", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for k in evidence.KS for m in ("recall", "hit", "complete", "multi", "union"))
    return f"SELECT {by}, count(*) AS questions, count(*) FILTER (WHERE multi) AS multi_questions, round(avg(reciprocal_rank), 6) AS mrr, {cols} FROM pq GROUP BY {by}"


def _spans_sql() -> str:
    c = frames.CHUNKS
    step = c.size - c.overlap
    return f"""
len AS (SELECT doc_id, lang, text, length(text) AS n, greatest(0, CAST(ceil((length(text) - {c.size}) / {step}.0) AS BIGINT)) AS last FROM documents WHERE length(text) > 0),
cutp AS (SELECT *, n - least({c.minimum}, (n - (last - 1) * {step} + {c.overlap}) // 2) + {c.overlap} AS cut FROM len),
mv AS (SELECT *, last > 0 AND n - last * {step} < {c.minimum} AND (last - 1) * {step} + {c.overlap} < cut AND cut <= (last - 1) * {step} + {c.size} AS moved FROM cutp),
span AS (
  SELECT doc_id, lang, text, k AS chunk_index,
    CASE WHEN moved AND k = last THEN cut - {c.overlap} ELSE k * {step} END AS start_char,
    CASE WHEN k = last THEN n WHEN moved AND k = last - 1 THEN cut ELSE least(k * {step} + {c.size}, n) END AS end_char
  FROM mv, unnest(generate_series(0, last)) AS g(k))"""


# ---------------------------------------------------------------- lexical and dense ranking

@_register(f"""
SELECT lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS mean_length, max(n) AS longest
FROM (SELECT lang, len({_tok('text')}) AS n FROM documents) GROUP BY lang""")
def tokenize_stats(spark, d):
    t = frames.documents(spark, d).select("lang", F.size(retrieval_tokens(F.col("text"))).cast("long").alias("n"))
    return t.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 6).alias("mean_length"), F.max("n").alias("longest"))


@_register(f"""
WITH {_BASE} SELECT token, df, CAST(sum(tf) AS BIGINT) AS occurrences, round(ln(1 + (any_value(n) - df + 0.5) / (df + 0.5)), 6) AS idf
FROM post JOIN df USING (token), stat GROUP BY token, df ORDER BY df DESC, token LIMIT 50""")
def posting_list_top_terms(spark, d):
    docs = frames.documents(spark, d)
    n = F.lit(docs.count())
    g = lexical.postings(lexical.document_tokens(docs)).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences")).orderBy(F.desc("df"), "token").limit(50)
    return g.select("token", "df", "occurrences", F.round(F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@_register(f"WITH {_BASE}, {_bm25('bm25')} SELECT qid, id, score, rank FROM r_bm25 WHERE rank <= 10")
def bm25_top10(spark, d):
    return frames.bm25_top(spark, d, 10).withColumn("rank", F.col("rank").cast("long"))


@_register(f"WITH {_BASE}, {_bm25('bm25')} SELECT qid, id, score, rank FROM r_bm25 WHERE rank <= 10")
def postings_top10(spark, d):
    """The ten best documents of every item from the stored, pruned postings."""
    return postings.top_k(frames.asked(spark, d), 10).withColumn("rank", F.col("rank").cast("long"))


@_register(f"WITH {_BASE}, {_bm25('flat')}, {_GOLD} SELECT DISTINCT g.qid, r.id, r.rank FROM gold g JOIN r_flat r ON r.qid = g.qid AND r.id = g.document_id")
def postings_places(spark, d):
    """The place of every relevant document in the full ranking, from counts of the documents above it."""
    gold = frames.evidence(spark, d).select("qid", F.col("document_id").alias("id"))
    return postings.ranks(frames.asked(spark, d, "flat"), gold)


@_register(f"""
WITH {_BASE}, {_bm25('bm25')},
pos AS (SELECT qid, count(*) AS n FROM s_bm25 WHERE score <> 0 GROUP BY qid)
SELECT qid, coalesce(any_value(pos.n), 0) AS n_positive, bool_or(score = 0) AS zero_in_top
FROM r_bm25 LEFT JOIN pos USING (qid) WHERE rank <= 10 GROUP BY qid""")
def zero_score_diagnostics(spark, d):
    ids = frames.documents(spark, d).select(F.col("doc_id").alias("id"))
    s = frames.scores(spark, d, "bm25")
    many = s.where("score <> 0").groupBy("qid").agg(F.count(F.lit(1)).alias("n_positive"))
    return lexical.zero_score_diagnostics(lexical.top_ranked(s, ids, frames.questions(spark, d), 10), many)


@_register("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
s AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(greatest(-1, least(1, list_dot_product(a.e, b.e) / (a.norm * b.norm))), 6) AS score
  FROM n a, n b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
SELECT qid, id, score, rank FROM r WHERE rank <= 10""")
def dense_cosine_top10(spark, d):
    """The stated queries, every hundredth vector, against all vectors."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    q = v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid")
    return dense.cosine_top(v.withColumnRenamed("vec_id", "id"), q, 10).withColumn("rank", F.col("rank").cast("long"))


@_register("SELECT label, count(*) AS vectors, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm, 0::BIGINT AS unsound FROM embeddings GROUP BY label")
def vector_norms(spark, d):
    v = table(spark, d, "embeddings")
    e = F.col("embedding")
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.round(F.avg(F.sqrt(dense.squared_norm(e))), 6).alias("mean_norm"), F.count_if(~dense.is_sound(e)).alias("unsound"))


_DENSE = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), vn AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
sd AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(greatest(-1, least(1, list_dot_product(a.e, b.e) / (a.norm * b.norm))), 6) AS score
  FROM vn a JOIN benchmark ON item_id = a.vec_id, vn b),
r_dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sd)"""


@_register(f"""
WITH {_BASE}, {_bm25('bm25')}, {_DENSE},
h AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60.0 + rank)), 12) AS score
  FROM (SELECT qid, id, rank FROM r_bm25 UNION ALL SELECT qid, id, rank FROM r_dense) WHERE rank <= {frames.DEPTH} GROUP BY qid, id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM h)
SELECT qid, id, score, rank FROM r WHERE rank <= 10""")
def rrf_hybrid_top10(spark, d):
    """BM25 fused with the cosine ranking of the vectors."""
    out = lexical.fuse_rankings([frames.bm25_top(spark, d, frames.DEPTH), frames.dense_top(spark, d)], 60.0, frames.DEPTH)
    return out.where("rank <= 10").withColumn("rank", F.col("rank").cast("long"))


@_register("SELECT lang, count(*) AS misses FROM documents WHERE source <> 'src0' GROUP BY lang")
def cache_miss_plan(spark, d):
    """Documents to encode when one source is cached already."""
    docs = frames.documents(spark, d)
    records = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    unit = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == 0, 1.0).otherwise(0.0).cast("float"))
    cache = docs.where("source = 'src0'").select(dense.cache_key("hashed-4", "document", F.col("doc_id"), F.col("text")).alias("key"), unit.alias("vector"))
    return dense.cache_plan(records, cache, "hashed-4")[1].groupBy("lang").agg(F.count(F.lit(1)).alias("misses"))


# ---------------------------------------------------------------- chunking

@_register(f"""
WITH {_spans_sql()} SELECT doc_id AS document_id, chunk_index, start_char, end_char,
  greatest(0, coalesce(lag(end_char) OVER (PARTITION BY doc_id ORDER BY chunk_index), start_char) - start_char) AS overlap,
  md5(substr(text, start_char + 1, end_char - start_char)) AS text_md5 FROM span""")
def chunk_fixed_size(spark, d):
    c = frames.fixed_chunks(spark, d)
    long_ = [F.col(x).cast("long").alias(x) for x in ("chunk_index", "start_char", "end_char")]
    return c.select("document_id", *long_, F.col("overlap_with_previous").cast("long").alias("overlap"), F.md5("text").alias("text_md5"))


@_register(f"""
WITH {_spans_sql()}, n AS (SELECT lang, end_char - start_char AS n FROM span)
SELECT lang, count(*) AS chunks, round(avg(n), 2) AS mean_chars, median(n) AS median_chars, min(n) AS min_chars, max(n) AS max_chars,
  count(*) FILTER (WHERE n < {frames.CHUNKS.minimum}) AS small, CAST(sum(n) AS BIGINT) AS total_chars
FROM n GROUP BY GROUPING SETS ((lang), ())""")
def chunk_fixed_stats(spark, d):
    docs = frames.documents(spark, d)
    spans = chunking.chunk_spans(docs.select(F.col("doc_id").alias("document_id"), "text", "lang"), frames.CHUNKS, ("lang",))
    c = spans.withColumn("character_count", F.col("end_char") - F.col("start_char"))
    out = chunking.chunk_statistics(c, ["lang"], frames.CHUNKS.minimum)
    return out.withColumns({x: F.col(x).cast("long") for x in ("min_chars", "max_chars")})


_LINES = r"""
line AS (
  SELECT doc_id, i, l, CAST(coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
par AS (SELECT doc_id, i, a, a + length(l) AS b FROM line WHERE length(l) > 0)"""


@_register(f"""
WITH {_spans_sql()}, {_LINES},
x AS (SELECT s.doc_id, s.chunk_index, s.start_char, s.end_char, greatest(p.a, s.start_char) AS lo, least(p.b, s.end_char) AS hi
  FROM span s LEFT JOIN par p ON p.doc_id = s.doc_id AND p.a < s.end_char AND p.b > s.start_char)
SELECT doc_id AS document_id, chunk_index, count(lo) AS paragraphs, CAST(any_value(end_char - start_char) - coalesce(sum(hi - lo), 0) AS BIGINT) AS unsectioned,
  CASE WHEN count(lo) = 1 AND any_value(end_char - start_char) = sum(hi - lo) THEN 'single' WHEN count(lo) > 0 THEN 'mixed' ELSE 'unsectioned' END AS scope
FROM x GROUP BY doc_id, chunk_index""")
def section_interval_overlap(spark, d):
    """Chunks against the paragraphs (lines) of their documents, as clipped sections."""
    docs = frames.documents(spark, d)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("a", F.coalesce(F.sum(F.length("l") + 1).over(w), F.lit(0)).cast("int")).where(F.length("l") > 0)
    one = F.struct(F.col("i").cast("string").alias("section_id"), F.lit("p").alias("item"), F.lit("p").alias("name"), F.col("a").alias("start_char"), (F.col("a") + F.length("l")).alias("end_char"))
    own = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("i"), one.alias("s")))).alias("p")).select("doc_id", F.transform("p", lambda x: x["s"]).alias("sections"))
    empty = F.array().cast("array<struct<section_id:string,item:string,name:string,start_char:int,end_char:int>>")
    full = docs.select("doc_id", "text").join(own, "doc_id", "left").select(F.col("doc_id").alias("document_id"), "text", F.coalesce("sections", empty).alias("sections"))
    c = chunking.chunk_documents(full, frames.CHUNKS)
    return c.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.size("sections").cast("long").alias("paragraphs"), F.col("unsectioned_characters").cast("long").alias("unsectioned"), F.col("section_scope").alias("scope"))


# ---------------------------------------------------------------- evidence and metrics

_OVERLAP = rf"""
{_spans_sql()}, {_GOLD},
ov AS (
  SELECT g.evidence_id, g.qid, g.text AS etext, g.start_char AS e0, s.doc_id, s.doc_id || '#' || s.chunk_index AS chunk_id, greatest(s.start_char, g.start_char) AS lo, least(s.end_char, g.end_char) AS hi
  FROM span s JOIN gold g ON g.document_id = s.doc_id AND s.start_char < g.end_char AND g.start_char < s.end_char),
cnt AS (
  SELECT *, length(regexp_replace(substr(etext, lo - e0 + 1, hi - lo), '[\s\x0B\x1C-\x1F\p{{Z}}]', '', 'g')) AS shared,
    length(regexp_replace(etext, '[\s\x0B\x1C-\x1F\p{{Z}}]', '', 'g')) AS total FROM ov)"""


@_register(f"WITH {_OVERLAP} SELECT evidence_id, chunk_id, shared, total, total > 0 AND shared >= greatest(least(32, total), 0.5 * total) AS matched FROM cnt WHERE shared > 0")
def evidence_match(spark, d):
    o = evidence.overlaps(frames.fixed_chunks(spark, d), frames.evidence(spark, d))
    return o.select("evidence_id", "chunk_id", F.col("shared").cast("long").alias("shared"), F.col("total").cast("long").alias("total"), evidence.is_match(F.col("shared"), F.col("total")).alias("matched"))


@_register(rf"""
WITH {_OVERLAP},
p AS (SELECT *, max(hi) OVER (PARTITION BY evidence_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM cnt WHERE shared > 0),
f AS (SELECT *, greatest(lo, coalesce(past, lo)) AS fr FROM p)
SELECT evidence_id, round(sum(length(regexp_replace(substr(etext, fr - e0 + 1, greatest(hi - fr, 0)), '[\s\x0B\x1C-\x1F\p{{Z}}]', '', 'g'))) / any_value(total)::DOUBLE, 6) AS covered
FROM f GROUP BY evidence_id""")
def evidence_union_coverage(spark, d):
    e = frames.evidence(spark, d)
    o = evidence.overlaps(frames.fixed_chunks(spark, d), e)
    return evidence.union_coverage(o, e, ["evidence_id"]).withColumn("covered", F.round("covered", 6))


def _per_question(spark, d):
    # Small results that several branches of the plan read.
    e = stored(frames.evidence(spark, d), "evidence")
    o = stored(evidence.overlaps(frames.whole_chunks(spark, d), e), "overlaps")
    labels = stored(frames.question_labels(spark, d, e), "questions")
    per = evidence.question_metrics(stored(frames.ranked(spark, d, e), "ranked"), o, e, labels)
    return per.join(labels.select("qid", "category", "difficulty"), "qid")


@_register(f"{_PER_QUESTION} {_macro('system')}")
def retrieval_metrics_macro(spark, d):
    return evidence.macro_metrics(_per_question(spark, d), ["system"])


@_register(f"""{_PER_QUESTION},
g AS (SELECT 'category' AS kind, category AS grp, pq.* FROM pq UNION ALL SELECT 'difficulty', difficulty, pq.* FROM pq)
{_macro('system, kind, grp').replace('FROM pq', 'FROM g')}""")
def retrieval_metrics_grouped(spark, d):
    per = _per_question(spark, d)
    kinds = F.explode(F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("grp")), F.struct(F.lit("difficulty").alias("kind"), F.col("difficulty").alias("grp"))))
    return evidence.macro_metrics(per.withColumn("k", kinds).select("*", "k.kind", "k.grp"), ["system", "kind", "grp"])


@_register(f"{_PER_QUESTION}, m AS ({_macro('system')}) SELECT system, mrr, recall_10 FROM m ORDER BY recall_10 DESC, mrr DESC, system LIMIT 1")
def best_system(spark, d):
    return evidence.best_system(evidence.macro_metrics(_per_question(spark, d), ["system"])).select("system", "mrr", "recall_10")


@_register(f"{_PER_QUESTION} SELECT qid, round(recall_10, 6) AS recall_10, round(reciprocal_rank, 6) AS reciprocal_rank FROM pq WHERE system = 'bm25' ORDER BY pq.recall_10, pq.reciprocal_rank, qid LIMIT 10")
def worst_questions(spark, d):
    per = _per_question(spark, d).where("system = 'bm25'")
    return evidence.worst_questions(per).select("qid", F.round("recall_10", 6).alias("recall_10"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@_register(f"""{_PER_QUESTION},
a AS (SELECT qid FROM pq WHERE system = 'bm25' AND recall_10 = 1), b AS (SELECT qid FROM pq WHERE system = 'flat' AND recall_10 = 1),
c AS (SELECT qid FROM pq WHERE system = 'rrf' AND recall_10 = 1), u AS (SELECT qid FROM pq WHERE system = 'bm25')
SELECT 'a_not_b' AS grp, qid FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'b_not_a', qid FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT 'only_both', qid FROM (SELECT * FROM c EXCEPT SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'missed_by_all', qid FROM (SELECT * FROM u EXCEPT SELECT * FROM a EXCEPT SELECT * FROM b EXCEPT SELECT * FROM c)
UNION ALL SELECT 'a', qid FROM a UNION ALL SELECT 'b', qid FROM b UNION ALL SELECT 'both', qid FROM c
UNION ALL SELECT 'a_and_b', qid FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'standalone_lost', qid FROM ((SELECT * FROM a UNION SELECT * FROM b) EXCEPT SELECT * FROM c)
UNION ALL SELECT 'nothing_found', qid FROM (SELECT * FROM u EXCEPT SELECT qid FROM pq WHERE recall_10 > 0)""")
def system_complementarity(spark, d):
    return evidence.complementarity(_per_question(spark, d), "bm25", "flat", "rrf")


# ---------------------------------------------------------------- reranking

_F1_TOKEN = "regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+(?:[.$%][a-z0-9]+)?')"


def _f1_sql(a: str, b: str) -> str:
    x, y = _F1_TOKEN.format(x=a), _F1_TOKEN.format(x=b)
    common = f"list_sum(list_transform(list_intersect({x}, {y}), lambda t: least(len(list_filter({x}, lambda u: u = t)), len(list_filter({y}, lambda u: u = t)))))"
    return f"CASE WHEN coalesce({common}, 0) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {common} / (len({x}) + len({y})) END"


_RERANK = f"""
WITH {_BASE}, {_bm25('bm25')}, {_GOLD},
pool AS (SELECT qid, id, rank AS old_rank FROM r_bm25 WHERE rank <= 20),
sc AS (SELECT p.qid, p.id, p.old_rank, round({_f1_sql('b.text', 'd.text')}, 6) AS score FROM pool p JOIN benchmark b ON b.item_id = p.qid JOIN documents d ON d.doc_id = p.id),
rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CAST(id AS VARCHAR)) AS rank FROM sc)"""


def _reranked(spark, d):
    top = frames.bm25_top(spark, d, 20)
    pools = stored(rerank.pool(top.select(F.lit("bm25").alias("system"), "qid", F.col("id").cast("string").alias("chunk_id"), F.col("rank").cast("long").alias("rank")), 20), "pools")
    texts = frames.documents(spark, d).select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return pools, rerank.reorder(pools, rerank.overlap_scores(rerank.pairs_to_score(pools), asked, texts))


@_register(f"{_RERANK} SELECT qid, CAST(id AS VARCHAR) AS chunk_id, old_rank, score, rank FROM rr WHERE rank <= 10")
def rerank_topk_token_f1(spark, d):
    out = _reranked(spark, d)[1].where("rank <= 10")
    return out.select("qid", "chunk_id", "old_rank", "score", F.col("rank").cast("long").alias("rank"))


@_register(f"""{_RERANK}, rel AS (SELECT rr.* FROM rr JOIN (SELECT DISTINCT qid, document_id FROM gold) g ON g.qid = rr.qid AND g.document_id = rr.id)
SELECT 'bm25' AS system, count(*) FILTER (WHERE old_rank > 1 AND rank <= 1) AS into_top1, count(*) FILTER (WHERE old_rank > 3 AND rank <= 3) AS into_top3,
  count(*) FILTER (WHERE old_rank > 5 AND rank <= 5) AS into_top5, count(*) FILTER (WHERE old_rank <= 5 AND rank > 5) AS out_of_top5 FROM rel HAVING count(*) > 0""")
def rerank_movement(spark, d):
    rel = frames.evidence(spark, d).select("qid", F.col("document_id").cast("string").alias("chunk_id"))
    return rerank.movement(_reranked(spark, d)[1], rel)


@_register(f"""{_RERANK},
x AS (SELECT g.qid, count(*) AS n, count(rr.id) AS available, count(*) FILTER (WHERE rr.rank <= 10) AS kept, count(*) FILTER (WHERE rr.old_rank <= 10) AS kept_before FROM gold g LEFT JOIN rr ON rr.qid = g.qid AND rr.id = g.document_id GROUP BY g.qid)
SELECT 'bm25' AS system, qid, round(available / n::DOUBLE, 6) AS oracle_recall,
  CASE WHEN available < n AND kept < available THEN 'both' WHEN available < n THEN 'candidate_generation' WHEN kept < available THEN 'reranking' ELSE 'complete' END AS failure_class,
  round((kept - kept_before) / n::DOUBLE, 6) AS recall_delta FROM x""")
def rerank_failure_class(spark, d):
    a = rerank_analysis(spark, d)
    return a.select("system", "qid", F.round("oracle_recall", 6).alias("oracle_recall"), "failure_class", F.round("recall_delta", 6).alias("recall_delta"))


def rerank_analysis(spark, d):
    """What reranking the BM25 pools changes, per question."""
    pools, after = _reranked(spark, d)
    after = stored(after, "reranked")
    e = stored(frames.evidence(spark, d), "evidence")
    o = stored(evidence.overlaps(frames.whole_chunks(spark, d), e), "overlaps")
    q = frames.question_labels(spark, d, e)
    need = e.groupBy("qid").agg(F.collect_set("evidence_id").alias("required"))
    return rerank.analyze(evidence.question_metrics(pools, o, e, q), evidence.question_metrics(after.select("system", "qid", "chunk_id", "rank"), o, e, q), need)


# ---------------------------------------------------------------- parsing

@_register()
def page_text_extract(spark, d):
    """Text statistics of raw pages; tests check blocks and offsets on hand-made pages."""
    return html.document_statistics(html.extract_blocks(table(spark, d, "pages"), "page_id", "html"))


_HEADS = """
h AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey % 23 AS ord FROM orders),
s AS (SELECT *, max(ord) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM h)"""


@_register(f"""
WITH {_HEADS}, k AS (SELECT id, pos, ord, pos * 40 AS start_char, lead(pos * 40) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM s WHERE past IS NULL OR ord > past),
n AS (SELECT id, count(*) * 40 AS total FROM h GROUP BY id)
SELECT id, ord, start_char, coalesce(nxt, total) - 1 AS end_char FROM k JOIN n USING (id)""")
def item_section_spans(spark, d):
    """Section spans over headings derived from each customer's orders, 40 characters apart."""
    o = table(spark, d, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    heads = o.select(F.col("o_custkey").alias("id"), pos.alias("pos"), (F.col("o_orderkey") % 23).cast("int").alias("ord"))
    names = sections.item_table(spark).select("ord", "item")
    c = heads.join(F.broadcast(names), "ord").withColumns({"start_char": (F.col("pos") * 40).cast("int"), "text": F.concat(F.lit("Item "), "item"), "title": F.lit("t")})
    texts = heads.groupBy("id").agg(F.repeat(F.concat(F.repeat(F.lit("x"), 39), F.lit(" ")), F.count(F.lit(1)).cast("int")).alias("full_text"))
    out = sections.section_spans(sections.select_headings(c), texts)
    return out.select("id", F.col("ord").cast("long").alias("ord"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))


# ---------------------------------------------------------------- facts

_FACTS = """
raw AS (
  SELECT CAST(o_custkey AS VARCHAR) AS cik,
    CASE o_orderstatus WHEN 'F' THEN 'Assets' WHEN 'O' THEN 'NetIncomeLoss' ELSE 'Revenues' END AS concept,
    CASE o_orderstatus WHEN 'F' THEN 'total_assets' WHEN 'O' THEN 'net_income' ELSE 'revenue' END AS metric,
    CASE WHEN o_orderkey % 10 = 0 THEN 'EUR' ELSE 'USD' END AS unit, o_orderkey AS idx, o_totalprice AS val, year(o_orderdate) AS fy,
    CASE WHEN o_orderpriority LIKE '1%' THEN '10-K/A' WHEN o_orderpriority LIKE '5%' THEN '10-Q' ELSE '10-K' END AS form,
    o_orderkey % 4 = 0 AS short FROM orders),
anchor AS (SELECT DISTINCT cik, fy, form FROM raw WHERE concept = 'Assets' AND unit = 'USD' AND form <> '10-Q'),
cls AS (
  SELECT raw.*, CASE WHEN unit <> 'USD' THEN 'unit_filter' WHEN raw.form = '10-Q' THEN 'form_filter' WHEN anchor.cik IS NULL THEN 'missing_annual_period_anchor'
    WHEN metric <> 'total_assets' AND short THEN 'nonannual_duration' END AS reason
  FROM raw LEFT JOIN anchor ON anchor.cik = raw.cik AND anchor.fy = raw.fy AND anchor.form = raw.form),
yr AS (SELECT DISTINCT cik, fy FROM anchor),
sel AS (
  SELECT yr.cik, yr.fy, m.metric, count(DISTINCT c.val) AS kinds, count(c.val) AS rows, min(c.val) AS val, arg_min(c.idx, c.idx) AS idx
  FROM yr CROSS JOIN (VALUES ('revenue'), ('net_income'), ('operating_income'), ('total_assets'), ('total_liabilities'), ('cash_and_cash_equivalents')) m(metric)
  LEFT JOIN cls c ON c.cik = yr.cik AND c.fy = yr.fy AND c.metric = m.metric AND c.reason IS NULL GROUP BY yr.cik, yr.fy, m.metric)"""


@_register(f"WITH {_FACTS} SELECT metric, coalesce(reason, 'period_eligible') AS stage, count(*) AS n FROM cls GROUP BY ALL")
def facts_annual_eligibility(spark, d):
    return facts.reason_counts(facts.classify_rows(frames.raw_facts(spark, d)))


@_register(f"""
WITH {_FACTS} SELECT cik, fy AS fiscal_year, metric,
  CASE WHEN rows = 0 THEN 'no_eligible_fact_in_latest_annual_filing' WHEN kinds > 1 THEN 'ambiguous_same_period_values_or_durations' ELSE 'ok' END AS outcome,
  CASE WHEN rows > 0 AND kinds = 1 THEN round(val, 2) END AS value, CASE WHEN rows > 0 AND kinds = 1 THEN rows - 1 END AS duplicate_rows_resolved FROM sel""")
def facts_normalized(spark, d):
    raw = frames.raw_facts(spark, d)
    out = facts.select_facts(facts.classify_rows(raw), facts.annual_anchors(raw))
    return out.select("cik", F.col("fiscal_year").cast("long").alias("fiscal_year"), "metric", "outcome", F.round("value", 2).alias("value"), "duplicate_rows_resolved")


@_register(f"""
WITH {_FACTS}, ok AS (SELECT 'T' || cik AS ticker, fy, metric, round(val, 2) AS val FROM sel WHERE rows > 0 AND kinds = 1),
req AS (SELECT 'T' || c_custkey AS ticker, 1995 + c_custkey % 5 AS fiscal_year, CASE c_custkey % 3 WHEN 0 THEN 'total_assets' WHEN 1 THEN 'net_income' ELSE 'margin' END AS metric FROM customer)
SELECT req.*, CASE WHEN req.metric = 'margin' THEN 'invalid_input' WHEN ok.ticker IS NOT NULL THEN 'success' ELSE 'unavailable' END AS status, ok.val AS value
FROM req LEFT JOIN ok ON ok.ticker = req.ticker AND ok.fy = req.fiscal_year AND ok.metric = req.metric""")
def fact_lookup_unique(spark, d):
    k = F.col("c_custkey")
    req = table(spark, d, "customer").select(
        F.concat(F.lit("t"), k.cast("string")).alias("ticker"), (1995 + k % 5).cast("int").alias("fiscal_year"),
        F.when(k % 3 == 0, "total_assets").when(k % 3 == 1, "net_income").otherwise("margin").alias("metric"),
    )
    out = facts.lookup(facts.normalize_facts(frames.raw_facts(spark, d)), req)
    return out.select("ticker", F.col("fiscal_year").cast("long").alias("fiscal_year"), "metric", "status", F.round("value", 2).alias("value"))


@_register(f"""
WITH {_FACTS}, c(metric, priority, concept) AS (VALUES ('revenue', 0, 'RevenueFromContractWithCustomerExcludingAssessedTax'), ('revenue', 1, 'SalesRevenueNet'), ('revenue', 2, 'Revenues'),
  ('net_income', 0, 'NetIncomeLoss'), ('operating_income', 0, 'OperatingIncomeLoss'), ('total_assets', 0, 'Assets'), ('total_liabilities', 0, 'Liabilities'), ('cash_and_cash_equivalents', 0, 'CashAndCashEquivalentsAtCarryingValue'))
SELECT c.metric, c.priority, c.concept, count(raw.idx) > 0 AS "exists", count(raw.idx) AS raw_fact_count, count(raw.idx) FILTER (WHERE form <> '10-Q') AS annual_candidate_count
FROM c LEFT JOIN raw ON raw.concept = c.concept GROUP BY ALL""")
def concept_inventory(spark, d):
    return facts.concept_inventory(frames.raw_facts(spark, d)).select("metric", "priority", "concept", "exists", "raw_fact_count", "annual_candidate_count")


# ---------------------------------------------------------------- routing, contexts, answers

_ROUTED = r"""
r AS (SELECT c_custkey, 'What was ' || CASE c_custkey % 4 WHEN 0 THEN 'Apple' WHEN 1 THEN 'msft' WHEN 2 THEN 'NVIDIA' ELSE 'Contoso' END || ' ' ||
    CASE c_custkey % 5 WHEN 0 THEN 'revenue' WHEN 1 THEN 'net  income' WHEN 2 THEN 'cash' WHEN 3 THEN 'strategy' ELSE 'stock price' END ||
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' in ' || (2015 + c_custkey % 10) END || CASE WHEN c_custkey % 7 = 0 THEN ' and why did it change?' ELSE '?' END AS q FROM customer),
t AS (SELECT *, regexp_matches(q, '(?i)\b(revenue|net income|operating income|total assets|total liabilities|cash|cash equivalents)\b') AS fin,
    regexp_matches(q, '(?i)\b(risk|risks|business|strategy|cybersecurity|properties|legal proceedings|why|how|describe|explain|drove|change|products|services)\b') AS nar, regexp_matches(q, '\b20\d{2}\b') AS yr FROM r)"""


@_register(rf"""
WITH {_ROUTED} SELECT c_custkey, CASE WHEN fin AND nar THEN 'document_retrieval+financial_data' WHEN fin AND yr THEN 'financial_data' WHEN nar THEN 'document_retrieval' ELSE 'abstain' END AS route,
  CASE c_custkey % 4 WHEN 0 THEN 'AAPL' WHEN 1 THEN 'MSFT' WHEN 2 THEN 'NVDA' ELSE '' END AS ticker,
  CASE WHEN yr THEN CAST(regexp_extract(q, '\b(20\d{{2}})\b', 1) AS BIGINT) ELSE 0 END AS fiscal_year,
  CASE WHEN regexp_matches(q, '(?i)revenue') THEN 'revenue' WHEN regexp_matches(q, '(?i)net\s+income') THEN 'net_income' ELSE '' END AS metric FROM t""")
def route_questions(spark, d):
    q = F.col("q")
    return frames.routed_questions(spark, d).select("c_custkey", router.route(q).alias("route"), router.ticker_slot(q).alias("ticker"), router.year_slot(q).cast("long").alias("fiscal_year"), router.metric_slot(q).alias("metric"))


@_register(rf"""
WITH {_ROUTED}, x AS (SELECT CASE WHEN fin AND nar THEN 'both' WHEN fin AND yr THEN 'financial_data' WHEN nar THEN 'document_retrieval' ELSE 'abstain' END AS route,
  regexp_matches(q, '(?i)revenue') OR regexp_matches(q, '(?i)net\s+income') AS has_metric FROM t)
SELECT CASE WHEN route = 'abstain' THEN 'unsupported' WHEN route = 'document_retrieval' OR has_metric THEN 'success' WHEN route = 'both' THEN 'success' ELSE 'tool_input_error' END AS status, count(*) AS n FROM x GROUP BY 1""")
def run_status(spark, d):
    """Statuses of routed runs in which retrieval always succeeds and lookups succeed when they know the metric."""
    q = F.col("q")
    r = router.route(q)
    doc = F.when(F.contains(r, F.lit("document_retrieval")), F.lit("success"))
    fin = F.when(F.contains(r, F.lit("financial_data")), F.when(router.metric_slot(q) == "", "invalid_input").otherwise("success"))
    status = router.fold_status(r, F.array_compact(F.array(doc, fin)))
    return frames.routed_questions(spark, d).select(status.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@_register(f"WITH {_BASE}, {_bm25('bm25')} SELECT r.qid, format('C{{:03d}}', rank) AS context_id, rank AS retrieval_rank, CAST(r.id AS VARCHAR) AS chunk_id, length(d.text) AS characters FROM r_bm25 r JOIN documents d ON d.doc_id = r.id WHERE rank <= 5")
def context_assembly(spark, d):
    top = bm25_top10(spark, d).select("qid", F.col("id").cast("string").alias("chunk_id"), "rank")
    out = grounding.build_contexts(top, frames.whole_chunks(spark, d), 5)
    return out.select("qid", "context_id", "retrieval_rank", "chunk_id", F.length("text").cast("long").alias("characters"))


@_register(rf"""
WITH o AS (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN text || ' [C001]' WHEN 3 THEN text || ' [C001] [C009]' ELSE 'Insufficient evidence in the supplied SEC context.' END AS answer,
  CASE turn % 4 WHEN 1 THEN ['C001'] WHEN 3 THEN ['C001', 'C009'] ELSE [] END AS citations, turn % 8 = 0 AS abstained FROM conversations)
SELECT conv_id, turn, CASE WHEN trim(answer) = '' THEN 'Answer and abstention types are invalid' WHEN turn % 4 = 3 THEN 'Citation references nonexistent context' WHEN turn % 4 = 1 THEN NULL
  WHEN abstained THEN NULL ELSE 'Non-abstaining answer requires supporting citations' END AS error FROM o""")
def output_contract_validation(spark, d):
    c = table(spark, d, "conversations")
    kind = F.col("turn") % 4
    none = F.array().cast("array<string>")
    answer = F.when(kind == 1, F.concat("text", F.lit(" [C001]"))).when(kind == 3, F.concat("text", F.lit(" [C001] [C009]"))).otherwise(grounding.ABSTENTION)
    cited = F.when(kind == 1, F.array(F.lit("C001"))).when(kind == 3, F.array(F.lit("C001"), F.lit("C009"))).otherwise(none)
    return c.select("conv_id", "turn", grounding.contract_columns(answer, cited, F.col("turn") % 8 == 0, F.array(F.lit("C001"), F.lit("C002"))).alias("error"))


_PAIRS = "pr AS (SELECT a.conv_id, a.turn, a.text AS answer, u.text AS question FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' WHERE a.role = 'assistant')"


@_register(f"WITH {_PAIRS}, f AS (SELECT conv_id, turn, round({_f1_sql('answer', 'question')}, 6) AS f1 FROM pr) SELECT conv_id, turn, f1, f1 >= 0.35 AS grounded FROM f")
def answer_f1_groundedness(spark, d):
    f1 = F.round(token_f1(F.col("answer"), F.col("question")), 6)
    return frames.answer_pairs(spark, d).select("conv_id", "turn", f1.alias("f1"), (f1 >= answers.GROUNDED_F1).alias("grounded"))


_SCORED = """
x AS (SELECT *, conv_id % 3 <> 0 AS answerable, CASE turn % 4 WHEN 1 THEN 'success' ELSE 'invalid_output' END AS status, conv_id % 5 = 0 AS abstained, length(text)::DOUBLE AS latency,
  CASE WHEN conv_id % 7 <> 0 THEN turn END AS input_tokens FROM conversations WHERE role = 'assistant')"""


@_register(f"""
WITH {_SCORED} SELECT answerable AS category, count(*) AS questions, round(avg((status = 'success')::INT), 6) AS output_validity, round(avg(CASE WHEN answerable THEN abstained::INT END), 6) AS false_abstention,
  round(avg(latency), 6) AS mean_latency, round(median(latency), 6) AS median_latency, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens FROM x GROUP BY GROUPING SETS ((answerable), ())""")
def generation_aggregate(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'")
    ok = F.col("turn") % 4 == 1
    rows = c.select(
        (F.col("conv_id") % 3 != 0).alias("answerable"), (F.col("conv_id") % 3 != 0).alias("category"), F.when(ok, "success").otherwise("invalid_output").alias("status"),
        (F.col("conv_id") % 5 == 0).alias("abstained"), F.lit(False).alias("expected_abstention"), ok.alias("citation_valid"), F.lit(None).cast("double").alias("citation_precision"),
        F.lit(None).cast("double").alias("citation_recall"), F.lit(None).cast("boolean").alias("grounded"), F.length("text").cast("double").alias("latency_seconds"),
        F.when(F.col("conv_id") % 7 != 0, F.col("turn")).alias("input_tokens"),
    )
    out = answers.aggregate_answers(rows, [["category"], []])
    return out.select("category", "questions", "output_validity", "false_abstention", "mean_latency", "median_latency", "input_tokens")


@_register(rf"""
SELECT source, CAST(sum(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}'))) AS BIGINT) AS emails,
  CAST(sum(len(regexp_extract_all(text, '\b\d{{3}}-\d{{2}}-\d{{4}}\b'))) AS BIGINT) AS ssns,
  CAST(sum(length(regexp_replace(text, '{SECRET_KEY}', '[REDACTED]', 'g'))) AS BIGINT) AS masked_chars FROM documents GROUP BY source""")
def pii_redaction_counts(spark, d):
    t = F.col("text")
    return frames.documents(spark, d).groupBy("source").agg(
        F.sum(F.regexp_count(t, F.lit(PRIVATE_MASKS[1]))).alias("emails"), F.sum(F.regexp_count(t, F.lit(PRIVATE_MASKS[2]))).alias("ssns"), F.sum(F.length(mask_keys(t))).alias("masked_chars"),
    )


# ---------------------------------------------------------------- traces

def _rate_sql(c: str, p: str) -> str:
    return f"round(count(*) FILTER (WHERE {c}) / nullif(count({c}), 0)::DOUBLE, 6) AS {p}_value, count(*) FILTER (WHERE {c}) AS {p}_numerator, count({c}) AS {p}_denominator, count(*) FILTER (WHERE {c} IS NULL) AS {p}_unavailable"


@_register(f"WITH x AS (SELECT lang, quality = 1 AS good, toxic = 1 AS bad FROM documents LEFT JOIN labels USING (doc_id)) SELECT lang, {_rate_sql('good', 'quality')}, {_rate_sql('bad', 'toxic')} FROM x GROUP BY lang")
def trace_rates_tristate(spark, d):
    l = table(spark, d, "labels")
    x = frames.documents(spark, d).select("doc_id", "lang").join(l, "doc_id", "left")
    return x.groupBy("lang").agg(*traces.rate(F.col("quality") == 1, "quality"), *traces.rate(F.col("toxic") == 1, "toxic"))


@_register("""
WITH x AS (SELECT event_type, CASE WHEN event_type <> 'signup' THEN value - 5 END AS v FROM events), y AS (SELECT event_type, CASE WHEN v >= 0 THEN v END AS v FROM x)
SELECT event_type, count(v) AS latency_count, count(*) FILTER (WHERE v IS NULL) AS latency_unavailable, round(avg(v), 6) AS latency_mean, round(median(v), 6) AS latency_median, quantile_disc(v, 0.95) AS latency_p95 FROM y GROUP BY event_type""")
def latency_distribution_p95(spark, d):
    e = table(spark, d, "events").select("event_type", F.when(F.col("event_type") != "signup", F.col("value") - 5).alias("v"))
    return traces.distribution_by(e, ["event_type"], "v", "latency")


@_register("""
WITH x AS (SELECT event_type, CAST(props->>'$.k' AS BIGINT) AS k, event_id FROM events), u AS (SELECT event_type, CASE WHEN k > 1 OR event_type = 'view' THEN k END AS i, k + 1 AS o FROM x),
t AS (SELECT event_type, i, i + o AS total FROM u)
SELECT event_type, CAST(sum(i) AS BIGINT) AS input_tokens_known_sum, round(avg(i), 6) AS input_tokens_known_mean, CAST(CASE WHEN count(i) = count(*) THEN sum(i) END AS BIGINT) AS input_tokens_total,
  CASE WHEN count(i) = count(*) THEN round(avg(i), 6) END AS input_tokens_average, count(*) FILTER (WHERE i IS NULL) AS input_tokens_unavailable,
  CAST(sum(total) AS BIGINT) AS total_tokens_known_sum, round(avg(total), 6) AS total_tokens_known_mean, CAST(CASE WHEN count(total) = count(*) THEN sum(total) END AS BIGINT) AS total_tokens_total,
  CASE WHEN count(total) = count(*) THEN round(avg(total), 6) END AS total_tokens_average, count(*) FILTER (WHERE total IS NULL) AS total_tokens_unavailable FROM t GROUP BY event_type""")
def token_usage_all_or_null(spark, d):
    e = event_plans.parsed(table(spark, d, "events"))
    given = F.struct(F.when((F.col("k") > 1) | (F.col("event_type") == "view"), F.col("k")).alias("input_tokens"), (F.col("k") + 1).alias("output_tokens"), F.lit(None).cast("long").alias("total_tokens"))
    u = e.select("event_type", traces.usage(given).alias("u")).select("event_type", "u.*")
    return u.groupBy("event_type").agg(*traces.token_figures("input_tokens"), *traces.token_figures("total_tokens"))


def _event_runs(spark, d):
    e = event_plans.parsed(table(spark, d, "events"))
    k, kind = F.col("k"), F.col("event_type")
    tools = F.array(F.struct(F.lit("document_retrieval").alias("name"), F.when(kind == "error", "error").otherwise("success").alias("status")))
    return e.select(
        "event_id", F.when(kind == "signup", F.array(F.lit("citation_failure"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.when(k % 5 == 0, F.lit(None).cast("boolean")).otherwise(k % 5 != 1).alias("routing_correct"), F.lit(False).alias("routing_error"),
        F.when(kind == "view", "abstain").otherwise("document_retrieval").alias("route"), tools.alias("tools"),
        F.when(kind == "click", "provider_error").otherwise("success").alias("generation_status"), F.when(k % 3 == 0, F.lit(None).cast("boolean")).otherwise(k % 3 == 1).alias("evidence_sufficient"),
        F.lit(None).cast("boolean").alias("result_sufficient"), (k % 2 == 0).alias("expected_abstention"), (k % 4 == 0).alias("abstained"), (kind != "signup").alias("contract_valid"),
    )


@_register("""
WITH e AS (SELECT event_id, event_type AS t, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
f AS (SELECT event_id, k % 5 = 1 AS routing_failure, false AS tool_failure, t = 'error' OR (t <> 'view' AND k % 3 = 2) AS retrieval_failure, false AS partial_evidence,
  t = 'click' OR (k % 2 = 0 AND k % 4 <> 0) AS generation_failure, t = 'signup' AS citation_failure, false AS invalid_output, t = 'view' AS unsupported_query, k % 4 = 0 AND t <> 'signup' AS expected_abstention, t <> 'signup' AS ok FROM e),
g AS (SELECT *, ok AND NOT (routing_failure OR tool_failure OR retrieval_failure OR partial_evidence OR generation_failure OR citation_failure OR invalid_output OR unsupported_query OR expected_abstention) AS success FROM f),
p AS (SELECT *, CASE WHEN routing_failure THEN 'routing_failure' WHEN retrieval_failure THEN 'retrieval_failure' WHEN generation_failure THEN 'generation_failure' WHEN citation_failure THEN 'citation_failure'
  WHEN unsupported_query THEN 'unsupported_query' WHEN expected_abstention THEN 'expected_abstention' WHEN success THEN 'success' END AS prim FROM g),
l(label) AS (VALUES ('success'), ('expected_abstention'), ('unsupported_query'), ('retrieval_failure'), ('tool_failure'), ('routing_failure'), ('generation_failure'), ('citation_failure'), ('invalid_output'), ('partial_evidence'))
SELECT label, (SELECT count(*) FROM p WHERE prim = label) AS primary_count,
  (SELECT count(*) FROM p WHERE CASE label WHEN 'success' THEN success WHEN 'expected_abstention' THEN expected_abstention WHEN 'unsupported_query' THEN unsupported_query WHEN 'retrieval_failure' THEN retrieval_failure
    WHEN 'routing_failure' THEN routing_failure WHEN 'generation_failure' THEN generation_failure WHEN 'citation_failure' THEN citation_failure ELSE false END) AS all_count FROM l""")
def failure_taxonomy_counts(spark, d):
    return traces.failure_counts(traces.classify(_event_runs(spark, d)))


@_register("""
WITH x AS (SELECT DISTINCT event_type || '-' || user_id AS trace_id, props FROM events), g AS (SELECT trace_id, count(*) AS n FROM x GROUP BY trace_id)
SELECT CASE WHEN n = 1 THEN 'unique' ELSE 'conflict' END AS kind, count(*) AS traces FROM g GROUP BY 1""")
def trace_dedup_conflicts(spark, d):
    e = table(spark, d, "events").select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("trace_id"), "props")
    good, bad = traces.unique_traces(e)
    return good.select(F.lit("unique").alias("kind")).unionByName(bad.select(F.lit("conflict").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("traces"))


@_register("""
WITH t AS (SELECT 'e' || event_id AS trace_id, event_type, user_id, value FROM events), r AS (SELECT DISTINCT event_type, user_id FROM events)
SELECT n, count(*) AS keys FROM (SELECT least(count(*), 2) AS n FROM t GROUP BY event_type, user_id) GROUP BY n""")
def historical_match(spark, d):
    """How many stored results have exactly one trace that agrees with them (1) and how many have more (2)."""
    e = table(spark, d, "events")
    t = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("trace_id"), "event_type", "user_id")
    one, other = traces.match_results(e.select("event_type", "user_id").distinct(), t, ("event_type", "user_id"))
    return one.select(F.lit(1).cast("long").alias("n")).unionByName(other.select(F.lit(2).cast("long").alias("n"))).groupBy("n").agg(F.count(F.lit(1)).alias("keys"))


# ---------------------------------------------------------------- question sets and sources

@_register("""
WITH q AS (SELECT item_id, 'SEC-' || lpad(CAST(item_id AS VARCHAR), 3, '0') AS question_id, item_id % 4 = 3 AS no_difficulty, item_id % 5 = 2 AS no_notes, item_id % 7 = 4 AS leaks FROM benchmark)
SELECT question_id, 'difficulty' AS rule FROM q WHERE no_difficulty UNION ALL SELECT question_id, 'review_notes' FROM q WHERE no_notes UNION ALL SELECT question_id, 'no_leak' FROM q WHERE leaks
UNION ALL SELECT question_id, 'id_format' FROM q WHERE item_id > 999""")
def benchmark_constraint_violations(spark, d):
    """Question records made from the benchmark, some with a blanked field or a leaked answer."""
    b = table(spark, d, "benchmark")
    k = F.col("item_id")
    doc = F.struct(F.lit("D1").alias("document_id"))
    ev = F.struct(F.lit("E1").alias("evidence_id"), F.lit("D1").alias("document_id"), F.array(F.lit(0)).alias("content_block_indices"), F.lit(False).alias("contains_table"))
    q = b.select(
        F.concat(F.lit("SEC-"), F.when(k < 1000, F.lpad(k.cast("string"), 3, "0")).otherwise(k.cast("string"))).alias("question_id"),
        F.when(k % 7 == 4, F.concat(F.lit("Is it the full text of the answer "), k.cast("string"))).otherwise("What is it").alias("question"),
        F.lit("direct_factual").alias("category"), F.when(k % 4 != 3, "easy").alias("difficulty"), F.lit(True).alias("answerable"), F.lit(False).alias("multiple_documents_required"),
        F.lit("v").alias("acceptable_answer_variants"), F.lit("source_checked").alias("review_status"), F.when(k % 5 == 2, " ").otherwise("ok").alias("review_notes"),
        F.array(doc).alias("required_documents"), F.array(ev).alias("evidence"), F.concat(F.lit("the full text of the answer "), k.cast("string"), F.lit(".")).alias("expected_answer"),
        F.struct(F.array(F.lit("T1")).alias("tickers"), F.array(F.lit(2024)).alias("report_years"), F.lit(None).cast("string").alias("outside_corpus_company")).alias("query_scope"),
        F.lit(None).cast("string").alias("unanswerable_reason"),
        F.lit(None).cast("struct<document_ids:array<string>,search_terms:array<string>,inspection_notes:string>").alias("absence_audit"),
    )
    docs = spark.range(1).select(F.lit("D1").alias("document_id"), F.lit("T1").alias("ticker"), F.lit("2024-12-31").alias("report_date"))
    return benchmark.question_violations(q, docs)


_SUBSET = """
q AS (SELECT doc_id AS qid, source AS category, CASE WHEN n_chars < 800 THEN 'easy' WHEN n_chars < 2500 THEN 'medium' ELSE 'hard' END AS difficulty FROM documents),
m AS (SELECT *, row_number() OVER (PARTITION BY category, difficulty ORDER BY qid) = 1 AS first FROM q),
t AS (SELECT *, 2 - count(*) FILTER (WHERE first) OVER (PARTITION BY category) AS short, row_number() OVER (PARTITION BY category ORDER BY first, qid) AS n FROM m)"""


@_register(f"WITH {_SUBSET} SELECT category, difficulty, qid FROM t WHERE first OR (short > 0 AND n = 1 AND NOT first)")
def stratified_subset(spark, d):
    n = F.col("n_chars")
    q = frames.documents(spark, d).select(F.col("doc_id").alias("qid"), F.col("source").alias("category"), F.when(n < 800, "easy").when(n < 2500, "medium").otherwise("hard").alias("difficulty"))
    return answers.stratified_subset(q)


@_register("""
WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS accession_number, pos AS n FROM x WHERE pos <= 2""")
def latest_filings_per_company(spark, d):
    """The first two filings of one form per company, over parallel arrays."""
    o = table(spark, d, "orders")
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").cast("string").alias("day")))).alias("r"))
    arrays = rows.select(
        "o_custkey", F.transform("r", lambda x: x["o_orderstatus"]).alias("form"), F.transform("r", lambda x: x["o_orderkey"].cast("string")).alias("accession_number"),
        F.transform("r", lambda x: x["day"]).alias("filing_date"), F.transform("r", lambda x: x["day"]).alias("report_date"), F.transform("r", lambda x: x["day"]).alias("primary_document"),
    )
    return filings.select_filings(arrays, "F", 2).select("o_custkey", "accession_number", F.col("n").cast("long").alias("n"))


@_register("""
SELECT lpad(CAST(coalesce(c.c_custkey, s.s_suppkey) AS VARCHAR), 10, '0') AS cik, CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_name ELSE c.c_name END AS name, coalesce(c.c_acctbal, s.s_acctbal) AS first_seen
FROM customer c FULL JOIN supplier s ON s.s_suppkey = c.c_custkey""")
def metadata_upsert(spark, d):
    """Suppliers upserted over customers by padded key; the first value of one column stays."""
    from dossier.functions.ids import pad_cik

    old = table(spark, d, "customer").select(pad_cik(F.col("c_custkey")).alias("cik"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("first_seen"))
    new = table(spark, d, "supplier").select(pad_cik(F.col("s_suppkey")).alias("cik"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("first_seen"))
    return filings.upsert(old, new, ["cik"], ("first_seen",))


@_register("""
SELECT CAST(doc_id AS VARCHAR) AS path, CASE lang WHEN 'de' THEN 'changed' WHEN 'es' THEN 'unexpected' ELSE 'missing' END AS problem FROM documents
WHERE (lang = 'de' AND sha256(text) <> sha256(upper(text))) OR lang = 'es' OR lang = 'fr'""")
def integrity_manifest_diff(spark, d):
    """A manifest in which one language changed, one is new and one is gone."""
    docs = frames.documents(spark, d).select(F.col("doc_id").cast("string").alias("path"), "lang", "text")
    found = docs.where("lang <> 'fr'").select("path", F.sha2("text", 256).alias("sha256"))
    want = docs.where("lang <> 'es'").select("path", F.sha2(F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text")), 256).alias("sha256"))
    return files.manifest_differences(found, want)


# ---------------------------------------------------------------- events

@_register("""
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL""")
def events_tumbling_window(spark, d):
    out = event_plans.tumbling(event_plans.parsed(table(spark, d, "events")))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_register("""
WITH x AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM x)
SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, sid""")
def events_sessionize(spark, d):
    out = event_plans.sessions(event_plans.parsed(table(spark, d, "events")))
    return out.withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
