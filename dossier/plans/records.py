"""Queries over records made from the test tables: files, pages, parsed documents, question sets, contexts and traces.

Each builds its records with known faults and known contents, so that SQL can
say from the definitions what an operator must return.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.canonical import row_digest
from dossier.functions.text import collapse_space, mask_json, nonspace_length, strip_right
from dossier.operators import answers, benchmark, chunking, dense, evidence, facts, grounding, html, rerank, retrieval, sections, traces
from dossier.plans import catalog, frames
from dossier.plans.frames import table
from dossier.sources import files, filings, snapshots
from dossier.sources.caches import CacheTable
from dossier.sources.stored import shared_root, stored
from dossier.streaming import events as event_plans

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/dossier/{name}-{uuid.uuid4().hex}"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").withColumnRenamed("c_custkey", "k")


def _string(c: str) -> Column:
    return F.col(c).cast("string")


# ---------------------------------------------------------------- files

@_register("""
SELECT c_custkey AS k, 'https://www.sec.gov/Archives/edgar/data/' || c_custkey || '/' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') || '24000001/d' || c_custkey || '.htm' AS url,
  'T' || c_custkey || '_' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') || '24000001' AS document_id FROM customer""")
def filing_links(spark, d):
    accession = F.concat(F.lpad(_string("k"), 10, "0"), F.lit("-24-000001"))
    return _customers(spark, d).select("k", filings.filing_url(F.col("k"), accession, F.concat(F.lit("d"), _string("k"), F.lit(".htm"))).alias("url"), filings.document_id(F.concat(F.lit("T"), _string("k")), accession).alias("document_id"))


@_register("SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(strlen(n_name) + 4 AS BIGINT) AS bytes, sha256(n_name || ' é' || chr(10)) AS sha256 FROM nation")
def binary_file_scan(spark, d):
    """One file a nation, read back as bytes."""
    root = _folder(spark, "binary")
    table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(" é"))).write.partitionBy("n_nationkey").text(root)
    f = files.read_binary(spark, root, "*.txt")
    return f.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("long").alias("k"), F.col("length").alias("bytes"), "sha256")


@_register("SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name || '!' END AS note FROM nation")
def json_file_scan(spark, d):
    """One JSON file a nation, some without a field, read with a fixed schema."""
    root = _folder(spark, "json")
    note = F.when(F.col("n_nationkey") % 3 != 0, F.concat("n_name", F.lit("!")))
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey", note.alias("note")).write.partitionBy("n_nationkey").json(root)
    return files.read_json(spark, f"{root}/*", "n_name string, n_regionkey long, note string")


@_register("SELECT vec_id AS id, len(embedding) AS dims, round(embedding[1]::DOUBLE, 6) AS head, 1::BIGINT AS folders FROM embeddings")
def vector_store(spark, d):
    """Vectors written twice under the name of their content: one folder, whose rows come back."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    root = _folder(spark, "vectors")
    paths = {files.write_vectors(v, root, "v"), files.write_vectors(v.orderBy(F.desc("id")), root, "v")}
    got = spark.read.parquet(*paths)
    return got.select("id", F.size("vector").cast("long").alias("dims"), F.round(F.col("vector")[0].cast("double"), 6).alias("head"), F.lit(len(paths)).cast("long").alias("folders"))


@_register("""
SELECT 'T' || c_custkey AS ticker, sha256(j) AS sha256, j AS kept, true AS whole
FROM (SELECT c_custkey, '{"cik":' || c_custkey || ',' || chr(10) || ' "name":"' || c_name || '"}' AS j FROM customer)""")
def payload_retention(spark, d):
    """Payloads of two lines stored under their hash before use, twice, and read back from there."""
    json = F.concat(F.lit('{"cik":'), _string("k"), F.lit(',\n "name":"'), "c_name", F.lit('"}'))
    p = _customers(spark, d).select(F.concat(F.lit("T"), _string("k")).alias("ticker"), json.alias("json"))
    root = _folder(spark, "payloads")
    files.retain_payloads(p, root)
    named = files.retain_payloads(p.unionByName(p), root)  # adds nothing
    return named.join(files.kept_payloads(spark, root), ["ticker", "sha256"]).select("ticker", "sha256", F.col("json").alias("kept"), "whole")


@_register("""
WITH e AS (SELECT event_type || '-' || event_id AS trace_id, event_type, event_id FROM events)
SELECT trace_id, event_type AS source_kind, event_id % 7 = 0 AS stale, 2::BIGINT AS versions FROM e WHERE event_type IN ('view', 'error')""")
def trace_store(spark, d):
    """Traces stored by kind; a second set replaces them, while a reader of the first keeps its rows and learns which ids went."""
    e = table(spark, d, "events").select(F.concat_ws("-", "event_type", _string("event_id")).alias("trace_id"), F.col("event_type").alias("source_kind"), "event_id")
    root = _folder(spark, "traces")
    files.save_traces(e, root)
    old = snapshots.read(spark, root).where("source_kind in ('view', 'error')")
    stale = files.save_traces(e.where("event_id % 7 <> 0"), root).withColumn("stale", F.lit(True))
    many = len(snapshots.versions(spark, root))
    return old.join(stale, "trace_id", "left").select("trace_id", "source_kind", F.coalesce("stale", F.lit(False)).alias("stale"), F.lit(many).cast("long").alias("versions"))


@_register("""
SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'second' WHEN c_custkey % 3 = 1 THEN 'first' END AS source, 3::BIGINT AS version
FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT -c_custkey, 'second', 3 FROM customer WHERE c_custkey % 3 = 0""")
def snapshot_table(spark, d):
    """A table of three versions: all customers, an upsert of a third of them with new ones, and a deletion of another third."""
    root = _folder(spark, "snapshots")
    c = _customers(spark, d).select(F.col("k").cast("long").alias("k"))
    snapshots.publish(c.withColumn("source", F.lit("first")), root)
    third = c.where("k % 3 = 0")
    snapshots.upsert(third.unionByName(third.select((-F.col("k")).alias("k"))).withColumn("source", F.lit("second")), root, ["k"])
    version = snapshots.delete(spark, root, c.where("k % 3 = 2"), ["k"])
    snapshots.vacuum(spark, root, 1)
    return snapshots.read(spark, root).withColumn("version", F.lit(version).cast("long"))


@_register("""
SELECT 'T' || c_custkey AS ticker, c_name AS company, m AS metric, round(c_acctbal * i, 2) AS value
FROM customer, (VALUES ('net_income', 1), ('total_assets', 2)) AS t(m, i) WHERE i = 1 OR c_custkey % 40 = 1""")
def cached_fact_files(spark, d):
    """Fact files of all companies, merged into one table."""
    k = F.col("k")
    fact = lambda name, i: F.struct(F.lit(name).alias("metric"), F.round(F.col("c_acctbal") * i, 2).alias("value"))
    both = F.when(k % 40 == 1, F.array(fact("net_income", 1), fact("total_assets", 2))).otherwise(F.array(fact("net_income", 1)))
    root = _folder(spark, "companies")
    _customers(spark, d).select(F.concat(F.lit("T"), _string("k")).alias("ticker"), F.col("c_name").alias("company"), both.alias("facts")).write.json(root)
    schema = "ticker string, company string, facts array<struct<metric:string,value:double>>"
    return facts.flatten_cache(spark.read.schema(schema).json(root))


# ---------------------------------------------------------------- text and pages

_WHITE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


@_register(rf"""
SELECT doc_id, md5(trim(regexp_replace(translate(x, chr(8203) || chr(65279) || chr(173), ''), '{_WHITE}+', ' ', 'g'))) AS collapsed,
  length(regexp_replace(x, '{_WHITE}', '', 'g')) AS visible, length(regexp_replace(x, '{_WHITE}+$', '')) AS stripped
FROM (SELECT doc_id, chr(8203) || ' ' || text || chr(160) || chr(11) || chr(173) || chr(10) || chr(8195) AS x FROM documents)""")
def white_space(spark, d):
    """Texts with odd white space around them, collapsed, counted and stripped."""
    x = F.concat(F.lit("​ "), F.col("text"), F.lit(" \u000b­\n "))
    return frames.documents(spark, d).select("doc_id", F.md5(collapse_space(x)).alias("collapsed"), nonspace_length(x).cast("long").alias("visible"), F.length(strip_right(x)).cast("long").alias("stripped"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page per customer: hidden elements, inline facts, links, a table with an empty row and a nested table, a list."""
    k = _string("k")
    return _customers(spark, d).select(F.col("k"), F.concat(
        F.lit('<html><head><title>t</title></head><body id="b">lead '), k, F.lit('<div hidden>no</div><p id="p'), k, F.lit('">Name  <b>'), F.col("c_name"),
        F.lit("</b><ix:nonfraction> "), F.col("c_mktsegment"), F.lit(' </ix:nonfraction><span style="a:b; display : none">x</span></p>'),
        F.when(F.col("k") % 2 == 0, '<a href="u">link</a><br>after').otherwise(""),
        F.lit('<table id="t"><tr><th>A</th><td colspan="2">'), k,
        F.lit("</td></tr><tr><td> </td></tr><tr><td>x<table><tr><td>in</td></tr></table></td></tr></table><ul><li>one &amp; 1</li>two</ul></body></html>"),
    ).alias("html"))


_BLOCKS = """
pg AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS linked, c_name AS name, c_mktsegment AS seg, c_custkey AS k FROM customer),
b0 AS (
  SELECT id, 1 AS n, 'paragraph' AS type, 'lead ' || k AS text, 'b' AS html_id, linked FROM pg
  UNION ALL SELECT id, 2, 'paragraph', 'Name ' || name || ' ' || seg, 'p' || k, false FROM pg
  UNION ALL SELECT id, 3, 'paragraph', 'link', 'b', true FROM pg WHERE linked
  UNION ALL SELECT id, 4, 'paragraph', 'after', 'b', true FROM pg WHERE linked
  UNION ALL SELECT id, 5, 'table', 'A | ' || k || chr(10) || 'x in', 't', false FROM pg
  UNION ALL SELECT id, 6, 'paragraph', 'one & 1', NULL, false FROM pg
  UNION ALL SELECT id, 7, 'paragraph', 'two', NULL, false FROM pg),
blk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS pos, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM b0)"""


@_register(f"WITH {_BLOCKS} SELECT id, pos, type, text, html_id, linked, a AS start_char, a + length(text) AS end_char FROM blk")
def html_blocks(spark, d):
    placed = html.place_blocks(html.extract_blocks(_pages(spark, d), "k", "html"))
    return placed.select("id", F.col("pos").cast("long").alias("pos"), "type", "text", "html_id", "linked", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))


@_register(f"""
WITH {_BLOCKS}, t AS (SELECT id, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text, count(*) AS blocks, count(*) FILTER (WHERE type = 'table') AS tables, any_value(linked) FILTER (WHERE n = 1) AS linked FROM blk GROUP BY id)
SELECT id, length(text) AS normalized_characters, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word_count, blocks AS block_count, tables AS table_count, 3::BIGINT AS removed_element_count,
  CAST(strlen('<html><head><title>t</title></head><body id="b">lead ' || id || '<div hidden>no</div><p id="p' || id || '">Name  <b>' || c_name || '</b><ix:nonfraction> ' || c_mktsegment
    || ' </ix:nonfraction><span style="a:b; display : none">x</span></p>' || CASE WHEN id % 2 = 0 THEN '<a href="u">link</a><br>after' ELSE '' END || '<table id="t"><tr><th>A</th><td colspan="2">' || id
    || '</td></tr><tr><td> </td></tr><tr><td>x<table><tr><td>in</td></tr></table></td></tr></table><ul><li>one &amp; 1</li>two</ul></body></html>') AS BIGINT) AS source_bytes
FROM t JOIN customer ON c_custkey = id""")
def html_statistics(spark, d):
    s = html.document_statistics(html.extract_blocks(_pages(spark, d), "k", "html"))
    return s.select("id", *[F.col(c).cast("long").alias(c) for c in ("source_bytes", "normalized_characters", "word_count", "block_count", "table_count", "removed_element_count")])


@_register("""
SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN '1A' WHEN 1 THEN '7' ELSE '9A' END AS item, CASE c_custkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 9 ELSE 13 END::BIGINT AS ord,
  CASE c_custkey % 8 WHEN 0 THEN 'Risk Factors' WHEN 1 THEN 'Management’s view' ELSE 'controls and procedures' END AS title FROM customer WHERE c_custkey % 8 IN (0, 1, 7)""")
def item_headings(spark, d):
    """Blocks that read as headings of known Items; wrong titles, links, tables, long blocks and unknown Items do not."""
    k = F.col("k") % 8
    text = (
        F.when(k == 0, "Item 1A. Risk Factors").when(k == 1, "ITEM 7 – Management’s view").when(k == 2, "Item 1A. Something else").when(k == 5, F.concat(F.lit("Item 1A. Risk Factors "), F.repeat(F.lit("x"), 220)))
        .when(k == 6, "Item 99. Risk Factors").when(k == 7, "item 9a: controls and procedures").otherwise("Item 1A. Risk Factors")
    )
    blocks = _customers(spark, d).select(F.col("k").alias("id"), F.lit(0).alias("pos"), F.when(k == 4, "table").otherwise("paragraph").alias("type"), (k == 3).alias("linked"), text.alias("text"))
    return sections.heading_candidates(blocks).select("id", "item", F.col("ord").cast("long").alias("ord"), "title")


@_register("""
WITH have AS (SELECT c_custkey AS id, item FROM customer, (VALUES ('1', 0), ('1A', 1), ('7', 2), ('8', 3)) t(item, n) WHERE (c_custkey + n) % 3 = 0)
SELECT c_custkey AS id, item FROM customer, (VALUES ('1'), ('1A'), ('7'), ('8')) t(item) WHERE (c_custkey, item) NOT IN (SELECT id, item FROM have)""")
def core_item_warnings(spark, d):
    """Core Items that are missing or too short: Item n is long where (k + n) % 3 = 0, short where it is 1, absent where it is 2."""
    items = F.array(*[F.struct(F.lit(i).alias("item"), F.lit(n).alias("n")) for n, i in enumerate(("1", "1A", "7", "8"))])
    c = _customers(spark, d).select(F.col("k").alias("id"), F.explode(items).alias("x"))
    which = (F.col("id") + F.col("x.n")) % 3
    s = c.where(which < 2).select("id", "x.item", F.repeat(F.lit("y"), F.when(which == 0, 500).otherwise(499)).alias("text"))
    return sections.core_warnings(s, c.select("id").distinct())


# ---------------------------------------------------------------- chunks

def _walk_sql(c: chunking.ChunkingConfig) -> str:
    """Every text walked chunk by chunk: walk(doc_id, k, a, b, n), k from 1."""
    least = max(c.overlap + 1, int(c.size * c.boundary_fraction))
    return rf"""
d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
walk(doc_id, k, a, b, n) AS (
  SELECT doc_id, 0, 0, 0, n FROM d
  UNION ALL
  SELECT doc_id, k + 1, a2, CASE WHEN stop < n AND n - stop + {c.overlap} < {c.minimum} AND a2 + {c.overlap} < even AND even <= l THEN even ELSE stop END, n
  FROM (
    SELECT *, n - least({c.minimum}, (n - a2 + {c.overlap}) // 2) + {c.overlap} AS even,
      CASE WHEN l = n THEN n WHEN e1 >= {least} THEN a2 + e1 WHEN e2 >= {least} THEN a2 + e2 WHEN e3 >= {least} THEN a2 + e3 WHEN e4 >= {least} THEN a2 + e4 ELSE l END AS stop
    FROM (
      SELECT *, length(regexp_extract(w, '^((?s:.*)\n\s*\n)', 1)) AS e1, length(regexp_extract(w, '^((?s:.*)\n)', 1)) AS e2,
        length(regexp_extract(w, '^((?s:.*)[.!?][”’"'')]*\s+)', 1)) AS e3, length(regexp_extract(w, '^((?s:.*)\s+)', 1)) AS e4
      FROM (
        SELECT walk.doc_id, k, a2, walk.n, least(a2 + {c.size}, walk.n) AS l, substr(d.text, a2 + 1, {c.size}) AS w
        FROM (SELECT *, CASE WHEN k = 0 THEN 0 ELSE b - {c.overlap} END AS a2 FROM walk WHERE k = 0 OR b < n) walk JOIN d ON d.doc_id = walk.doc_id))))"""


_NATURAL = chunking.ChunkingConfig("recursive", 400, 50, 60)


@_register(f"""
WITH RECURSIVE {_walk_sql(_NATURAL)}
SELECT w.doc_id AS document_id, k - 1 AS chunk_index, a AS start_char, b AS end_char, md5(substr(text, a + 1, b - a)) AS text_md5,
  sha256('{{"chunk_index":' || (k - 1) || ',"document_id":"' || w.doc_id || '","end_char":' || b || ',"experiment_id":"{_NATURAL.experiment_id}","parsed_document_sha256":"' || sha256('{{"document_id":' || w.doc_id || ',"text":' || to_json(text) || '}}') || '","start_char":' || a || ',"version":"1"}}') AS chunk_id
FROM walk w JOIN d ON d.doc_id = w.doc_id WHERE k > 0""")
def chunk_natural(spark, d):
    """Chunks at natural boundaries with their content-addressed ids; SQL walks every text step by step."""
    docs = frames.documents(spark, d).select(F.col("doc_id").alias("document_id"), "text")
    c = chunking.chunk_documents(docs, _NATURAL)
    return c.select("document_id", *[F.col(x).cast("long").alias(x) for x in ("chunk_index", "start_char", "end_char")], F.md5("text").alias("text_md5"), "chunk_id")


def _sectioned(spark: SparkSession, d: str) -> DataFrame:
    """Documents of 8 characters or more, their second and last quarters being sections, their middle third a table."""
    n = F.length("text")
    q = lambda i: F.floor(n * i / 4).cast("int")
    third = lambda i: F.floor(n * i / 3).cast("int")
    section = lambda name, item, a, b: F.struct(F.lit(name).alias("section_id"), F.lit(item).alias("item"), F.lit(name).alias("name"), a.alias("start_char"), b.alias("end_char"), F.substring(F.col("text"), a + 1, b - a).alias("text"))
    block = lambda kind, a, b: F.struct(F.lit(kind).alias("type"), a.alias("start_char"), b.alias("end_char"))
    return frames.documents(spark, d).where(n >= 8).select(
        F.col("doc_id").alias("document_id"), "text", "source", F.array(section("s1", "1", q(1), q(2)), section("s2", "1A", q(3), n)).alias("sections"),
        F.array(block("paragraph", F.lit(0), third(1)), block("table", third(1), third(2))).alias("content"))


_QUARTERS = r"""
dq AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 8),
cut AS (SELECT doc_id, text, unnest([{'i': 0, 'a': 0, 'b': n // 4}, {'i': 1, 'a': n // 4, 'b': n * 2 // 4}, {'i': 2, 'a': n * 2 // 4, 'b': n * 3 // 4}, {'i': 3, 'a': n * 3 // 4, 'b': n}], recursive := true) FROM dq),
unit AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS u FROM cut WHERE i % 2 = 1 OR regexp_matches(substr(text, a + 1, b - a), '[^\s\x0B\x1C-\x1F\p{Z}]'))"""


@_register(f"""WITH {_QUARTERS}
SELECT doc_id AS document_id, u AS unit_index, u AS chunk_index, a AS start_char, b AS end_char, CASE WHEN i % 2 = 1 THEN 'single' ELSE 'unsectioned' END AS scope, CASE i WHEN 1 THEN '1' WHEN 3 THEN '1A' END AS item FROM unit""")
def chunk_by_section(spark, d):
    """Sections and the gaps between them as units; the size lets each be one chunk."""
    c = chunking.chunk_documents(_sectioned(spark, d), chunking.ChunkingConfig("sections", 10_000_000, 0, 1))
    return c.select("document_id", *[F.col(x).cast("long").alias(x) for x in ("unit_index", "chunk_index", "start_char", "end_char")], F.col("section_scope").alias("scope"), "item")


@_register(f"""
WITH {catalog._spans_sql()}
SELECT s.doc_id AS document_id, chunk_index, greatest(start_char, n // 3) AS start_char, least(end_char, n * 2 // 3) AS end_char, start_char > n // 3 OR end_char < n * 2 // 3 AS is_partial
FROM span s JOIN (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 8) t ON t.doc_id = s.doc_id WHERE n // 3 < end_char AND n * 2 // 3 > start_char""")
def chunk_tables(spark, d):
    """Table blocks clipped to the fixed-size chunks that they meet."""
    c = chunking.chunk_documents(_sectioned(spark, d), frames.CHUNKS).select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.explode("table_fragments").alias("t"))
    return c.select("document_id", "chunk_index", F.col("t.start_char").cast("long").alias("start_char"), F.col("t.end_char").cast("long").alias("end_char"), "t.is_partial")


@_register(f"""
WITH {catalog._spans_sql()}, t AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 8),
x AS (SELECT s.doc_id, chunk_index, greatest(least(end_char, n * 2 // 4) - greatest(start_char, n // 4), 0) AS c1, greatest(least(end_char, n) - greatest(start_char, n * 3 // 4), 0) AS c2, end_char - start_char AS c FROM span s JOIN t USING (doc_id))
SELECT item, count(*) AS chunks FROM (SELECT '1' AS item FROM x WHERE c1 > 0 UNION ALL SELECT '1A' FROM x WHERE c2 > 0 UNION ALL SELECT 'unsectioned' FROM x WHERE c1 + c2 < c) GROUP BY item""")
def chunk_item_distribution(spark, d):
    return chunking.item_distribution(chunking.chunk_documents(_sectioned(spark, d), frames.CHUNKS))


@_register("""
WITH t AS (SELECT doc_id, doc_id % 6 AS m, source = 'src1' AS blank FROM documents WHERE length(text) >= 8)
SELECT CASE WHEN m = 5 THEN 'bad ' ELSE '' END || doc_id AS document_id, unnest(list_filter([CASE WHEN blank THEN 'provenance:source' END, CASE m WHEN 1 THEN 'sections:order' WHEN 2 THEN 'sections:slice' WHEN 3 THEN 'sections:offsets' WHEN 4 THEN 'sections:unique' WHEN 5 THEN 'document_id' END], lambda r: r IS NOT NULL)) AS rule FROM t""")
def document_rules(spark, d):
    """Parsed documents of which five in six break one rule, and one source leaves its provenance blank."""
    m = F.col("id") % 6
    two = _sectioned(spark, d).withColumn("id", F.col("document_id"))
    a, b = F.col("sections")[0], F.col("sections")[1]
    start = F.when(m == 1, a["end_char"] - 1).otherwise(b["start_char"])
    end = F.when(m == 3, F.length("text") + 5).otherwise(b["end_char"])
    kind = "struct<section_id:string,start_char:int,end_char:int,text:string>"
    made = F.array(
        F.struct(a["section_id"], a["start_char"], a["end_char"], F.when(m == 2, F.concat(F.lit("x"), a["text"])).otherwise(a["text"])).cast(kind),
        F.struct(F.when(m == 4, "s1").otherwise("s2"), start, end, F.substring(F.col("text"), start + 1, end - start)).cast(kind))
    docs = two.select(F.concat(F.when(m == 5, "bad ").otherwise(""), _string("id")).alias("document_id"), "text", F.when(F.col("source") != "src1", F.col("source")).otherwise("").alias("source"), made.alias("sections"))
    return chunking.document_violations(docs, ("source",))


@_register(f"""
WITH {catalog._spans_sql()}, c AS (SELECT doc_id, chunk_index, doc_id || '#' || chunk_index AS chunk_id FROM span WHERE doc_id % 11 <> 0)
SELECT chunk_id, 'slice' AS rule FROM c WHERE chunk_index % 7 = 3 UNION ALL SELECT chunk_id, 'offsets' FROM c WHERE chunk_index % 7 = 5 UNION ALL SELECT chunk_id, 'slice' FROM c WHERE chunk_index % 7 = 5
UNION ALL SELECT chunk_id, 'repeated_id' FROM c WHERE doc_id % 13 = 0 AND chunk_index = 0 UNION ALL SELECT DISTINCT CAST(doc_id AS VARCHAR), 'uncovered_document' FROM span WHERE doc_id % 11 = 0
UNION ALL SELECT 'lost#0', 'unknown_document'""")
def chunk_rules(spark, d):
    """Stored chunks with changed texts, wrong lengths, repeated ids, uncovered and unknown documents."""
    docs = frames.documents(spark, d).select(F.col("doc_id").cast("string").alias("document_id"), "text")
    k = F.col("chunk_index") % 7
    text = F.when(k == 3, F.concat(F.lit("☃"), F.expr("substring(text, 2)"))).when(k == 5, F.concat("text", F.lit("☃"))).otherwise(F.col("text"))
    own = frames.fixed_chunks(spark, d).where("document_id % 11 <> 0")
    c = own.unionByName(own.where("document_id % 13 = 0 and chunk_index = 0")).select(F.col("document_id").cast("string").alias("document_id"), "chunk_id", "start_char", "end_char", text.alias("text"))
    lost = spark.range(1).select(F.lit("lost").alias("document_id"), F.lit("lost#0").alias("chunk_id"), F.lit(0).alias("start_char"), F.lit(1).alias("end_char"), F.lit("x").alias("text"))
    return files.chunk_violations(c.unionByName(lost), docs)


# ---------------------------------------------------------------- vectors, scorers, retrieval

class _LengthEncoder:
    """Unit vectors of (characters, 1); enough to follow a text through cache and encoder."""

    signature = {"implementation": "length"}
    dimensions = 2

    def encode(self, texts, role):
        x = np.array([[float(len(t or "")), 1.0] for t in texts])
        return x / np.linalg.norm(x, axis=1, keepdims=True)


@_register("SELECT doc_id AS id, source = 'src0' AS hit, CASE WHEN source = 'src0' THEN 0.6 ELSE round(length(text) / sqrt(length(text)::DOUBLE ** 2 + 1), 5) END::DOUBLE AS head FROM documents")
def encode_with_cache(spark, d):
    """Cached unit vectors where they hold; one source's cached vectors are not of unit norm and are made anew."""
    docs = frames.documents(spark, d)
    scale = F.when(F.col("source") == "src0", 1.0).otherwise(2.0)
    vector = F.array(scale * 0.6, scale * 0.8).cast("array<float>")
    cache = docs.where("source in ('src0', 'src1')").select(dense.cache_key("length", "document", F.col("doc_id"), F.col("text")).alias("key"), vector.alias("vector"))
    got = dense.encode_cached(docs.select(F.col("doc_id").alias("id"), "text"), cache, _LengthEncoder(), "length")
    return got.select("id", "hit", F.round(F.col("vector")[0].cast("double"), 5).alias("head"))


@_register("SELECT c_custkey AS id, c_custkey % 3 <> 0 AS in_manifest FROM customer WHERE (c_custkey % 3 <> 0) <> (c_custkey % 4 <> 0)")
def row_alignment(spark, d):
    c = _customers(spark, d).select(F.col("k").alias("id"))
    return dense.misaligned(c.where("id % 3 <> 0"), c.where("id % 4 <> 0"))


class _LengthScorer:
    signature = "length"

    def score(self, questions, passages):
        return [float(len(p) - len(q)) for q, p in zip(questions, passages)]


@_register("SELECT item_id AS qid, CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN -1.5 ELSE length(d.text) - length(b.text) END::DOUBLE AS score FROM benchmark b JOIN documents d ON d.doc_id % 50 = item_id % 50")
def pair_scores(spark, d):
    """Pairs of questions and passages from the score cache (even passages) and the scorer (odd ones)."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), (F.col("item_id") % 50).alias("m"))
    docs = frames.documents(spark, d).select(F.col("doc_id").cast("string").alias("chunk_id"), "text", "doc_id", (F.col("doc_id") % 50).alias("m"))
    pairs = b.join(docs, "m").select("qid", "chunk_id", "question", "text", "doc_id")
    key = F.sha2(F.concat_ws("\u0001", F.lit("length"), "question", "chunk_id", F.sha2("text", 256)), 256)
    bad = F.when(F.col("doc_id") % 4 == 1, F.lit(float("nan"))).otherwise(-1.5)
    cache = pairs.where("doc_id % 2 = 0 or doc_id % 4 = 1").select(key.alias("key"), bad.alias("score"))
    return rerank.cached_scores(pairs.drop("doc_id"), cache, _LengthScorer())


@_register(f"""{catalog._RERANK},
x AS (SELECT g.qid, count(*) AS n, count(rr.id) AS available, count(*) FILTER (WHERE rr.rank <= 10) AS kept, count(*) FILTER (WHERE rr.old_rank <= 10) AS kept_before FROM gold g LEFT JOIN rr ON rr.qid = g.qid AND rr.id = g.document_id GROUP BY g.qid)
SELECT 'bm25' AS system, round(avg(available / n::DOUBLE), 6) AS oracle_recall, count(*) FILTER (WHERE available < n AND kept < available) AS "both", count(*) FILTER (WHERE available < n AND kept >= available) AS candidate_generation,
  count(*) FILTER (WHERE available >= n AND kept < available) AS reranking, count(*) FILTER (WHERE available >= n AND kept >= available) AS complete,
  count(*) FILTER (WHERE kept > kept_before) AS improved, count(*) FILTER (WHERE kept < kept_before) AS harmed, count(*) FILTER (WHERE kept = kept_before) AS unchanged FROM x HAVING count(*) > 0""")
def rerank_change_summary(spark, d):
    return rerank.change_summary(catalog.rerank_analysis(spark, d))


@_register(f"{catalog._PER_QUESTION} SELECT system, qid, CAST(first_rank AS BIGINT) AS first_rank, array_to_string(recovered_10, ',') AS recovered FROM pq")
def recovered_evidence(spark, d):
    return catalog._per_question(spark, d).select("system", "qid", F.col("first_rank").cast("long").alias("first_rank"), F.array_join("recovered_10", ",").alias("recovered"))


@_register(f"""{catalog._PER_QUESTION}, w AS (SELECT a.qid, a.recovered_10 AS a, b.recovered_10 AS b, c.recovered_10 AS c FROM pq a JOIN pq b USING (qid) JOIN pq c USING (qid) WHERE a.system = 'bm25' AND b.system = 'flat' AND c.system = 'rrf')
SELECT qid, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS b_not_a, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS a_not_b,
  array_to_string(list_sort(list_filter(c, lambda x: NOT list_contains(a, x) AND NOT list_contains(b, x))), ',') AS only_both FROM w""")
def evidence_differences(spark, d):
    out = evidence.evidence_differences(catalog._per_question(spark, d), "bm25", "flat", "rrf")
    return out.select("qid", *[F.array_join(c, ",").alias(c) for c in ("b_not_a", "a_not_b", "only_both")])


@_register("SELECT count(*) FILTER (WHERE n_chars > 2000) AS truncated, max(least(n_chars, 2000)) AS most_tokens FROM documents")
def encoding_limits(spark, d):
    n = F.col("n_chars")
    return evidence.encoding_diagnostics(frames.documents(spark, d).select(F.least(n, F.lit(2000)).alias("token_count"), (n > 2000).alias("truncated")))


@_register(f"""
WITH {catalog._BASE}, {catalog._bm25('bm25')}, {catalog._DENSE},
h AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60.0 + rank)), 12) AS score FROM (SELECT qid, id, rank FROM r_bm25 UNION ALL SELECT qid, id, rank FROM r_dense) WHERE rank <= 50 GROUP BY qid, id),
r_h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM h),
a AS (SELECT 'bm25' AS score_type, qid, id, score, rank FROM r_bm25 UNION ALL SELECT 'cosine', qid, id, score, rank FROM r_dense UNION ALL SELECT 'rrf', qid, id, score, rank FROM r_h)
SELECT score_type, qid, a.id AS chunk_id, rank, score, length(text) AS characters FROM a JOIN documents ON doc_id = a.id WHERE rank <= 5""")
def retrieval_modes(spark, d):
    """The five best chunks of every item by each mode."""
    index, q = frames.index(spark, d), frames.questions(spark, d)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = v.join(q.select("qid"), F.col("id") == F.col("qid")).select("qid", "vector")
    chunks = frames.documents(spark, d).select(F.col("doc_id").alias("chunk_id"), F.length("text").cast("long").alias("characters"))
    out = None
    for mode in retrieval.MODES:
        part = retrieval.retrieve(mode, 5, chunks, q, index, v, asked).select("score_type", "qid", "chunk_id", F.col("rank").cast("long").alias("rank"), "score", "characters")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- facts

@_register("""
WITH raw AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CASE o_orderstatus WHEN 'F' THEN 'Assets' WHEN 'O' THEN 'NetIncomeLoss' ELSE 'Revenues' END AS concept,
  CASE WHEN o_orderkey % 10 = 0 THEN 'EUR' ELSE 'USD' END AS unit, o_orderkey, year(o_orderdate) AS fy, round(o_totalprice, 2) AS val FROM orders)
SELECT cik, concept, unit, row_number() OVER (PARTITION BY cik, concept, unit ORDER BY o_orderkey) - 1 AS idx, fy, val FROM raw""")
def payload_rows(spark, d):
    """Fact payloads as nested JSON, one per company, exploded to raw rows."""
    r = frames.raw_facts(spark, d)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", *[F.col(c) for c in ("fy", "fp", "form", "filed", "accn", "val", "start", "end")]))), lambda x: x.dropFields("idx"))
    by_unit = r.groupBy("cik", "ticker", "company", "concept", "unit").agg(rows.alias("rows"))
    by_concept = by_unit.groupBy("cik", "ticker", "company", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", "rows"))).alias("units"))
    gaap = F.map_from_entries(F.collect_list(F.struct(F.col("concept"), F.struct("units"))))
    grouped = by_concept.groupBy("cik", "ticker", "company").agg(gaap.alias("gaap"))
    p = grouped.select("ticker", "company", F.to_json(F.struct("cik", F.struct(F.col("gaap").alias("us-gaap")).alias("facts"))).alias("json"))
    return facts.explode_payload(p).select("cik", "concept", "unit", F.col("idx").cast("long").alias("idx"), F.col("fy").cast("long").alias("fy"), F.round("val", 2).alias("val"))


@_register("""
SELECT 'S' || s_suppkey AS ticker, unnest(CASE s_suppkey % 5 WHEN 1 THEN ['facts', 'us-gaap'] WHEN 2 THEN ['cik'] WHEN 3 THEN ['us-gaap'] WHEN 4 THEN ['units'] ELSE [] END) AS rule FROM supplier""")
def payload_rules(spark, d):
    """Payloads without facts, of another company, without the taxonomy, or without units."""
    s = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "k")
    m, k = F.col("k") % 5, _string("k")
    body = F.when(m == 1, "").when(m == 3, ',"facts":{}').when(m == 4, ',"facts":{"us-gaap":{"Assets":{}}}').otherwise(',"facts":{"us-gaap":{"Assets":{"units":{"USD":[]}}}}')
    cik = F.when(m == 2, F.col("k") + 1).otherwise(F.col("k")).cast("string")
    p = s.select(F.concat(F.lit("S"), k).alias("ticker"), F.lit("c").alias("company"), F.concat(F.lit('{"cik":'), cik, body, F.lit("}")).alias("json"))
    return facts.payload_violations(p, s.select(F.concat(F.lit("S"), k).alias("ticker"), F.col("k").alias("cik")))


@_register(f"WITH {catalog._FACTS} SELECT cik, fy AS fiscal_year, metric FROM sel WHERE rows > 0 AND kinds = 1 AND CAST(cik AS BIGINT) % 3 = 0")
def pointer_mismatches(spark, d):
    """Facts of every third company moved by one: their pointers lead to another value."""
    raw = frames.raw_facts(spark, d)
    moved = facts.normalize_facts(raw).withColumn("value", F.when(F.col("cik").cast("long") % 3 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return facts.verify_pointers(moved, raw).select("cik", F.col("fiscal_year").cast("long").alias("fiscal_year"), "metric")


@_register(f"""
WITH {catalog._FACTS} SELECT 'financial:T' || cik || ':' || fy || ':' || metric AS chunk_id, 'Company ' || cik AS company, fy || '-02-01' AS filing_date, (fy - 1) || '-12-31' AS report_date, cik || '-' || fy AS accession_number,
  'https://data.sec.gov/api/xbrl/companyfacts/CIK' || cik || '.json' AS source_url FROM sel WHERE rows > 0 AND kinds = 1""")
def fact_text_contexts(spark, d):
    return facts.fact_contexts(facts.normalize_facts(frames.raw_facts(spark, d))).select("chunk_id", "company", "filing_date", "report_date", "accession_number", "source_url")


_FILINGS = """
raw AS (
  SELECT CAST(o_custkey AS VARCHAR) AS cik, CASE o_orderstatus WHEN 'F' THEN 'Assets' WHEN 'O' THEN 'NetIncomeLoss' ELSE 'Revenues' END AS concept, CASE o_orderstatus WHEN 'F' THEN 'total_assets' WHEN 'O' THEN 'net_income' ELSE 'revenue' END AS metric,
    CASE WHEN o_orderkey % 10 = 0 THEN 'EUR' ELSE 'USD' END AS unit, o_orderkey AS idx, o_totalprice AS val, year(o_orderdate) // 2 AS fy, o_orderkey % 3 AS m, o_orderkey % 4 = 0 AS short, o_orderkey % 11 = 0 AS quarter,
    CASE WHEN o_orderpriority LIKE '1%' THEN '10-K/A' WHEN o_orderpriority LIKE '5%' THEN '10-Q' ELSE '10-K' END AS form FROM orders),
cls AS (
  SELECT raw.*, CASE WHEN unit <> 'USD' THEN 'unit_filter' WHEN raw.form = '10-Q' THEN 'form_filter' WHEN fy NOT BETWEEN 994 AND 999 THEN 'fiscal_year_filter' WHEN quarter THEN 'fiscal_period_filter' END AS annual FROM raw),
anchor AS (SELECT DISTINCT cik, fy, form, m FROM cls WHERE concept = 'Assets' AND annual IS NULL),
fin AS (SELECT c.*, CASE WHEN annual IS NOT NULL THEN annual WHEN a.cik IS NULL THEN 'missing_annual_period_anchor' WHEN metric <> 'total_assets' AND short THEN 'nonannual_duration' END AS reason
  FROM cls c LEFT JOIN anchor a ON a.cik = c.cik AND a.fy = c.fy AND a.form = c.form AND a.m = c.m),
yr AS (SELECT cik, fy, max(m) AS newest FROM anchor GROUP BY cik, fy),
sel AS (SELECT yr.cik, yr.fy, k.metric, newest, count(DISTINCT val) AS kinds, count(val) AS rows, min(val) AS val FROM yr CROSS JOIN (VALUES ('revenue'), ('net_income'), ('total_assets')) k(metric)
  LEFT JOIN fin ON fin.cik = yr.cik AND fin.fy = yr.fy AND fin.metric = k.metric AND fin.m = newest AND reason IS NULL GROUP BY ALL)"""


@_register(f"""
WITH {_FILINGS} SELECT cik, fy + 1000 AS fiscal_year, metric, CASE WHEN rows = 0 THEN 'no_eligible_fact_in_latest_annual_filing' WHEN kinds > 1 THEN 'ambiguous_same_period_values_or_durations' ELSE 'ok' END AS outcome,
  CASE WHEN rows > 0 AND kinds = 1 THEN (fy + 1000) || '-0' || (newest + 1) || '-01' END AS filing_date, CASE WHEN rows > 0 AND kinds = 1 THEN round(val, 2) END AS value FROM sel""")
def facts_newest_filing(spark, d):
    """Up to three filings a year: only the newest counts, and quarterly periods and other years do not."""
    k = F.col("idx")
    o = frames.raw_facts(spark, d).withColumn("half", F.floor(F.col("fy") / 2).cast("int"))
    year = F.when(F.col("half").between(994, 999), F.col("half") + 1000).otherwise(1800)
    last = F.concat((F.col("half") + 999).cast("string"), F.lit("-12-31"))
    filed = F.concat((F.col("half") + 1000).cast("string"), F.lit("-0"), (k % 3 + 1).cast("string"), F.lit("-01"))
    begin = F.when(F.col("concept") != "Assets", F.concat((F.col("half") + 999).cast("string"), F.when(k % 4 == 0, "-07-01").otherwise("-01-01")))
    raw = o.withColumns({"fy": year, "end": last, "filed": filed, "start": begin, "fp": F.when(k % 11 == 0, "Q1").otherwise("FY"), "accn": F.concat_ws("-", "cik", _string("half"), (k % 3).cast("string"))}).drop("half")
    out = facts.select_facts(facts.classify_rows(raw), facts.annual_anchors(raw)).where("metric in ('revenue', 'net_income', 'total_assets')")
    return out.select("cik", F.col("fiscal_year").cast("long").alias("fiscal_year"), "metric", "outcome", "filing_date", F.round("value", 2).alias("value"))


# ---------------------------------------------------------------- question sets

def _question_set(spark: SparkSession, d: str) -> DataFrame:
    """A question per item about document item % 100, whose third block is its evidence; some entries are wrong."""
    b = table(spark, d, "benchmark").withColumnRenamed("item_id", "k")
    k, doc = F.col("k"), F.concat(F.lit("D"), (F.col("k") % 100).cast("string"))
    ev = F.struct(
        F.concat(F.lit("E"), _string("k")).alias("evidence_id"), doc.alias("document_id"), F.lit("1A").alias("item"), F.lit("s2").alias("section_id"), F.when(k % 8 == 1, "wrong").otherwise("Risk").alias("section_name"),
        F.when(k % 8 == 2, 31).otherwise(30).alias("start_char"), F.lit(40).alias("end_char"), F.when(k % 8 == 3, "other").otherwise("3333333333").alias("text"),
        F.when(k % 8 == 4, F.array(F.lit(3), F.lit(9))).otherwise(F.array(F.lit(3))).alias("content_block_indices"), (k % 8 == 5).alias("contains_table"))
    need = F.struct(doc.alias("document_id"), F.when(k % 8 == 6, "XX").otherwise("T").alias("ticker"), F.lit(2024).alias("filing_year"), F.when(k % 8 == 7, 2022).otherwise(2023).alias("report_year"), F.array(F.when(k % 16 == 0, "7").otherwise("1A")).alias("items"))
    return b.select(
        F.concat(F.lit("Q"), _string("k")).alias("question_id"), "k", F.concat(F.lit("What  is "), (k % 30).cast("string")).alias("question"), 
        F.concat(F.lit("c"), (k % 3).cast("string")).alias("category"), F.concat(F.lit("d"), (k % 2).cast("string")).alias("difficulty"), (k % 4 != 0).alias("answerable"),
        (k % 5 == 0).alias("multiple_documents_required"), F.when(k % 4 == 0, F.array().cast("array<struct<document_id:string,ticker:string,filing_year:int,report_year:int,items:array<string>>>")).otherwise(F.array(need)).alias("required_documents"),
        F.array(ev).alias("evidence"), k.alias("position"))


def _reference_documents(spark: SparkSession) -> DataFrame:
    """Documents D0 to D99: four blocks of ten characters, the last two of which are a section."""
    texts = F.concat(*[F.repeat(F.lit(str(i)), 10) for i in range(4)])
    block = lambda i: F.struct(F.lit("paragraph").alias("type"), F.lit(10 * i).alias("start_char"), F.lit(10 * i + 10).alias("end_char"))
    section = F.struct(F.lit("s2").alias("section_id"), F.lit("1A").alias("item"), F.lit("Risk").alias("name"), F.lit(20).alias("start_char"), F.lit(40).alias("end_char"))
    return spark.range(100).select(
        F.concat(F.lit("D"), _string("id")).alias("document_id"), texts.alias("text"), F.array(section).alias("sections"), F.array(*map(block, range(4))).alias("content"),
        F.lit("T").alias("ticker"), F.lit("2024-02-01").alias("filing_date"), F.lit("2023-12-31").alias("report_date"))


@_register("""
SELECT 'Q' || item_id AS question_id, unnest(list_filter([CASE WHEN item_id % 8 = 6 THEN 'reference:ticker' END, CASE WHEN item_id % 8 = 7 THEN 'report_year' END, CASE WHEN item_id % 16 = 0 THEN 'items' END], lambda r: r IS NOT NULL)) AS rule
FROM benchmark WHERE item_id % 4 <> 0""")
def question_references(spark, d):
    return benchmark.reference_violations(_question_set(spark, d), _reference_documents(spark), ("ticker",))


@_register("""
SELECT 'Q' || item_id AS question_id, 'E' || item_id AS evidence_id, unnest(CASE item_id % 8 WHEN 1 THEN ['section'] WHEN 2 THEN ['slice', 'block_edges'] WHEN 3 THEN ['slice'] WHEN 4 THEN ['block_indices', 'consecutive_blocks', 'block_edges', 'table_flag'] WHEN 5 THEN ['table_flag'] ELSE [] END) AS rule FROM benchmark""")
def question_evidence(spark, d):
    """Evidence with a wrong section, offset, text, block or table flag."""
    return benchmark.evidence_violations(_question_set(spark, d), _reference_documents(spark).drop("ticker"))


@_register("""
SELECT 'D' || doc_id AS document_id, CASE doc_id % 10 WHEN 1 THEN 'missing' WHEN 2 THEN 'unexpected' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 10 IN (1, 2, 3)""")
def corpus_manifest(spark, d):
    """The documents against a manifest of their text hashes: a tenth is missing, one unexpected, one changed."""
    docs = frames.documents(spark, d).select(F.concat(F.lit("D"), _string("doc_id")).alias("document_id"), "text", (F.col("doc_id") % 10).alias("n"))
    wanted = docs.where("n <> 2").select("document_id", F.sha2(F.when(F.col("n") == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("text_sha256"))
    return benchmark.corpus_mismatches(docs.where("n <> 1"), wanted)


@_register("""
SELECT 'duplicate' AS kind, 'what is ' || item_id % 30 AS name, count(*) AS n FROM benchmark GROUP BY item_id % 30 HAVING count(*) > 1
UNION ALL SELECT 'target', 'c' || item_id % 3, count(*) FROM benchmark GROUP BY item_id % 3 HAVING item_id % 3 <> 1
UNION ALL SELECT 'uncovered', 'D' || i, 0 FROM range(100) t(i) WHERE i NOT IN (SELECT item_id % 100 FROM benchmark WHERE item_id % 4 <> 0)""")
def question_set_balance(spark, d):
    """Repeated wordings, categories off their targets and documents without a question."""
    q = _question_set(spark, d)
    twice = benchmark.duplicates(q).where("kind = 'text'").select(F.lit("duplicate").alias("kind"), F.col("value").alias("name"), "n")
    right = q.where("category = 'c1'").groupBy("category").agg(F.count(F.lit(1)).alias("target"))
    off = benchmark.distribution_errors(q, right).select(F.lit("target").alias("kind"), F.col("category").alias("name"), "n")
    bare = benchmark.uncovered_documents(q, _reference_documents(spark)).select(F.lit("uncovered").alias("kind"), F.col("document_id").alias("name"), F.lit(0).cast("long").alias("n"))
    return twice.unionByName(off).unionByName(bare)


@_register("""
WITH q AS (SELECT 'c' || item_id % 3 AS category, 'd' || item_id % 2 AS difficulty, item_id AS k FROM benchmark)
SELECT category, difficulty, count(*) AS questions, count(*) FILTER (WHERE k % 4 <> 0) AS answerable, count(*) FILTER (WHERE k % 4 <> 0) AS single_document, count(*) FILTER (WHERE k % 5 = 0) AS multi_document,
  count(*) FILTER (WHERE k % 4 = 0) AS no_document, count(*) FILTER (WHERE k % 8 = 5) AS with_table, count(*) AS evidence_spans FROM q GROUP BY GROUPING SETS ((category), (difficulty), ())""")
def question_summary(spark, d):
    return benchmark.summary(_question_set(spark, d))


@_register("SELECT 'c' || item_id % 3 AS category, 'Q' || min(item_id) AS question_id FROM benchmark WHERE item_id % 3 <> 1 GROUP BY item_id % 3")
def first_questions(spark, d):
    return answers.first_of_categories(_question_set(spark, d), ["c0", "c2"]).select("category", "question_id")


# ---------------------------------------------------------------- contexts, prompts, answers

_CONTEXTS = """
cx AS (SELECT c_custkey AS qid, i + 1 AS rank, 'N' || (c_custkey * 3 + i) % 25 AS chunk_id, 'NATION_' || (c_custkey * 3 + i) % 25 AS text FROM customer, range(4) t(i))"""


def _ranked_nations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Four nations a customer as a ranking, and the nations as chunks."""
    r = _customers(spark, d).select(F.col("k").alias("qid"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    ranked = r.select("qid", F.concat(F.lit("N"), ((F.col("qid") * 3 + F.col("i")) % 25).cast("string")).alias("chunk_id"), (F.col("i") + 1).alias("rank"))
    n = table(spark, d, "nation")
    return ranked, n.select(F.concat(F.lit("N"), _string("n_nationkey")).alias("chunk_id"), F.lit(0).alias("start_char"), F.length("n_name").alias("end_char"), F.col("n_name").alias("text"))


@_register(rf"""
WITH {_CONTEXTS}, p AS (SELECT qid, string_agg('{{"chunk_id":"' || chunk_id || '","context_id":"C00' || rank || '","text":"' || text || '"}}', ',' ORDER BY rank) AS e, sum(length(text)) AS n FROM cx WHERE rank <= 3 GROUP BY qid),
x AS (SELECT qid, '{{"evidence":[' || e || '],"question":"Was \"' || c_name || '\" é?"}}' AS input FROM p JOIN customer ON c_custkey = qid WHERE n <= 26)
SELECT qid, input, sha256('{grounding.INSTRUCTIONS.replace("'", "''")}' || chr(10) || input) AS prompt_sha256 FROM x""")
def prompts_in_budget(spark, d):
    """Prompts of the questions whose contexts fit; the others are refused whole."""
    ranked, chunks = _ranked_nations(spark, d)
    q = _customers(spark, d).select(F.col("k").alias("qid"), F.concat(F.lit('Was "'), "c_name", F.lit('" é?')).alias("question"))
    return grounding.build_prompts(q, grounding.build_contexts(ranked, chunks, 3), 26).select("qid", "input", "prompt_sha256")


@_register(f"""
WITH {_CONTEXTS} SELECT qid, 'blank_text' AS rule FROM cx WHERE rank <= 3 AND chunk_id = 'N7' UNION SELECT qid, 'length' FROM cx WHERE rank <= 3 AND chunk_id IN ('N7', 'N9')
UNION SELECT qid, 'duplicate_chunk' FROM cx WHERE rank = 1 AND qid % 5 = 0""")
def context_rules(spark, d):
    """Contexts with a blank text, a length that differs from the offsets, or a repeated chunk."""
    ranked, chunks = _ranked_nations(spark, d)
    text = F.when(F.col("chunk_id") == "N7", "  ").when(F.col("chunk_id") == "N9", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    c = grounding.build_contexts(ranked, chunks, 3).withColumn("text", text)
    return grounding.context_violations(c.unionByName(c.where("qid % 5 = 0 and retrieval_rank = 1")))


@_register(f"WITH {_CONTEXTS} SELECT DISTINCT qid FROM cx WHERE rank <= 3 AND (chunk_id = 'N9' OR (qid % 5 = 0 AND rank = 1))")
def ungrounded_contexts(spark, d):
    """Questions whose stored contexts are not those of their ranking: a changed text, a lost context."""
    ranked, chunks = _ranked_nations(spark, d)
    text = F.when(F.col("chunk_id") == "N9", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    stored_ones = grounding.build_contexts(ranked, chunks, 3).withColumn("text", text).where("not (qid % 5 = 0 and retrieval_rank = 1)")
    return grounding.ungrounded(stored_ones, ranked, chunks, 3)


#: Raw outputs with the first rule that they break, and whether schema, contract and citations hold.
_OUTPUTS = (
    ('{"answer":"It is so [C1].","citations":["C1"],"abstained":false}', None, True, True, True, False),
    ('{"answer":"It is so [C1]","citations":["C1"]', "Malformed structured output", False, False, None, None),
    ('{"answer":"a","citations":[],"abstained":false,"note":1}', "Unexpected structured output fields", False, False, None, None),
    ('{"answer":" ","citations":[],"abstained":false}', "Answer and abstention types are invalid", False, False, None, None),
    ('{"answer":"x [C1]","citations":["C1","C1"],"abstained":false}', "Invalid or duplicate citations", True, False, False, False),
    ('{"answer":"x [C9]","citations":["C9"],"abstained":false}', "Citation references nonexistent context", True, False, False, False),
    ('{"answer":"x","citations":["C1"],"abstained":false}', "Inline citations and citation list differ", True, False, False, False),
    ('{"answer":"x","citations":[],"abstained":true}', "Abstention requires canonical answer and no citations", True, False, True, True),
    ('{"answer":"x","citations":[],"abstained":false}', "Non-abstaining answer requires supporting citations", True, False, False, False),
    ('{"answer":"' + grounding.ABSTENTION + '","citations":[],"abstained":true}', None, True, True, True, True),
    ('{"answer":"x","answer":"x","citations":[],"abstained":true}', "Malformed structured output", False, False, None, None),
    ('{"answer":"x","citations":[3],"abstained":false}', "Invalid or duplicate citations", False, False, None, None),
    (None, None, None, None, None, None),
)


def _sql_value(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"


_OUTPUT_ROWS = ", ".join(f"({i}, {', '.join(map(_sql_value, o[1:]))})" for i, o in enumerate(_OUTPUTS))


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(o[0]) for o in _OUTPUTS]), (F.col("k") % len(_OUTPUTS) + 1).cast("int"))
    return _customers(spark, d).select(F.col("k").alias("id"), raw.alias("raw"), F.array(F.lit("C1"), F.lit("C2")).alias("allowed"))


@_register(f"""
SELECT c_custkey AS id, error, json_schema_valid, output_contract_valid, citation_valid, abstained FROM customer
JOIN (VALUES {_OUTPUT_ROWS}) o(i, error, json_schema_valid, output_contract_valid, citation_valid, abstained) ON i = c_custkey % {len(_OUTPUTS)}""")
def model_output_validation(spark, d):
    return grounding.validate_outputs(_outputs(spark, d)).select("id", "error", "json_schema_valid", "output_contract_valid", "citation_valid", "abstained")


class _ScriptedProvider:
    """Answers by the question's number: a good answer, a bad one, a passing failure, a lasting one, a refusal."""

    def __init__(self):
        self.tried: dict[str, int] = {}

    def generate(self, instructions: str, prompt: str) -> grounding.Reply:
        n = self.tried[prompt] = self.tried.get(prompt, 0) + 1
        kind = int(prompt) % 5
        if kind == 2 and n == 1 or kind == 3:
            raise grounding.ProviderError("rate_limited", 429, True)
        if kind == 4:
            raise grounding.ProviderError("refused", 400, False)
        return grounding.Reply(_OUTPUTS[6 if kind == 1 else 0][0])


@_register("""
SELECT c_custkey AS qid, CASE c_custkey % 5 WHEN 1 THEN 'invalid_output' WHEN 3 THEN 'provider_error' WHEN 4 THEN 'provider_error' ELSE 'success' END AS status,
  CASE c_custkey % 5 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END::BIGINT AS attempts, c_custkey % 5 < 3 AS has_output FROM customer""")
def generation_retries(spark, d):
    """Generation with two retries: only passing failures are tried again."""
    p = _customers(spark, d).select(F.col("k").alias("qid"), F.lit("i").alias("instructions"), _string("k").alias("input"), F.array(F.lit("C1")).alias("allowed"))
    g = grounding.generate_answers(p, _ScriptedProvider(), 2)
    return g.select("qid", "status", F.col("attempts").cast("long").alias("attempts"), F.col("raw").isNotNull().alias("has_output"))


_EVALUATED = """
t AS (SELECT c_custkey AS qid, c_custkey % 8 AS m, c_custkey % 3 <> 0 AS answerable FROM customer),
v AS (SELECT *, CASE WHEN m = 1 THEN 'invalid_output' ELSE 'success' END AS status, m = 2 AS abstained, m IN (0, 3, 4, 5) AS cites, m IN (0, 3, 7) AS found, m = 5 AS foreign_id FROM t),
w AS (SELECT *, status = 'success' AND NOT foreign_id AS citation_valid, CASE WHEN cites THEN (m IN (0, 3))::INT::DOUBLE END AS citation_precision, CASE WHEN cites THEN (m IN (0, 3))::INT::DOUBLE END AS citation_recall,
  CASE WHEN answerable AND m <> 2 THEN CASE WHEN m = 3 THEN 0.0 ELSE 1.0 END END AS answer_f1, CASE WHEN m <> 2 AND cites THEN m IN (0, 4) END AS grounded FROM v)"""


@_register(f"""
WITH {_EVALUATED}, y AS (SELECT *, CASE WHEN answerable AND m <> 2 THEN answer_f1 >= 0.5 END AS correct FROM w)
SELECT qid, CASE WHEN NOT citation_valid AND status = 'invalid_output' THEN 'invalid_structured_output' WHEN NOT answerable AND abstained AND citation_valid THEN 'expected_abstention' WHEN answerable AND NOT found THEN 'retrieval_failure'
    WHEN answerable AND abstained THEN 'generation_failure' WHEN answerable AND cites AND citation_precision = 0 THEN 'citation_failure' WHEN answerable AND NOT correct THEN 'generation_failure' WHEN answerable AND NOT citation_valid THEN 'citation_failure'
    WHEN answerable AND NOT abstained AND grounded THEN 'successful_grounded_answer' WHEN answerable AND NOT abstained THEN 'generation_failure' ELSE 'invalid_structured_output' END AS attribution,
  answer_f1::DOUBLE AS answer_f1, correct, grounded, citation_valid, citation_precision, citation_recall FROM y""")
def answer_evaluation(spark, d):
    """Answers scored against contexts and evidence, and what each run's outcome is put down to."""
    c = _customers(spark, d)
    qid, m = F.col("k").alias("qid"), F.col("k") % 8
    none = F.array().cast("array<string>")
    answer = F.when(m == 2, "").when(m == 3, "unlike words").otherwise("the red fox")
    cited = F.when(m.isin(0, 3, 4), F.array(F.lit("C1"))).when(m == 5, F.array(F.lit("C9"))).otherwise(none)
    t = c.select(qid, F.when(m == 1, "invalid_output").otherwise("success").alias("status"), answer.alias("answer"), cited.alias("citations"), (m == 2).alias("abstained"))
    contexts = c.select(qid, F.lit("C1").alias("context_id"), F.lit("The red fox ran").alias("text"))
    matched = c.where(m.isin(0, 3, 7)).select(qid, F.lit("C1").alias("context_id"), F.lit("E1").alias("evidence_id"))
    q = c.select(qid, (F.col("k") % 3 != 0).alias("answerable"), F.lit("The red fox").alias("expected"), F.array(F.lit("E1")).alias("evidence_ids"))
    return answers.evaluate_answers(t, contexts, matched, q).select("qid", "attribution", "answer_f1", "correct", "grounded", "citation_valid", "citation_precision", "citation_recall")


# ---------------------------------------------------------------- traces

@_register("""
SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '[REDACTED]' END AS query, CASE WHEN c_custkey % 2 = 0 THEN 'reviewed_public_text' ELSE 'unreviewed_text_withheld' END AS policy,
  CASE c_custkey % 5 WHEN 0 THEN 'https://www.sec.gov/a/' || c_custkey END AS link, CASE c_custkey % 3 WHEN 0 THEN 'Malformed structured output' WHEN 1 THEN '[REDACTED]' END AS detail,
  '{"nested": ["at [REDACTED]", {"password": "[REDACTED]"}], "q": "call [REDACTED]"}' AS masked FROM customer""")
def public_fields(spark, d):
    """What of a run may be shown: reviewed wording, links to allowed hosts, known error texts, masked JSON."""
    c = _customers(spark, d)
    k = F.col("k")
    url = (
        F.when(k % 5 == 0, F.concat(F.lit("https://www.sec.gov/a/"), _string("k"), F.lit("?x=1#f"))).when(k % 5 == 1, "http://www.sec.gov/a").when(k % 5 == 2, "https://example.com/a")
        .when(k % 5 == 3, "https://u:p@www.sec.gov/a").otherwise(F.lit("not a link"))
    )
    q = traces.public_query(F.col("c_name"), F.when(k % 2 == 0, F.col("c_name")))
    e = traces.public_error(F.lit("x"), F.when(k % 3 == 0, "Malformed structured output").when(k % 3 == 1, "secret text"))
    raw = F.concat(F.lit('{"q":"call 555-123-4567","nested":["at a.b@c.org",{"password":"'), "c_name", F.lit('"}]}'))
    return c.select("k", q["text"].alias("query"), q["policy"].alias("policy"), traces.public_link(url).alias("link"), e["detail"].alias("detail"), mask_json(raw).alias("masked"))


@_register("""
WITH e AS (SELECT event_id, event_type AS t, event_id % 9 AS m, CAST(props->>'$.k' AS BIGINT) AS k FROM events)
SELECT CASE m WHEN 1 THEN 'bad id!' WHEN 8 THEN 'given-' || event_id ELSE sha256('6.1' || chr(1) || 'event' || chr(1) || event_id) END AS trace_id, unnest(CASE m WHEN 1 THEN ['trace_id'] WHEN 2 THEN ['schema_version'] WHEN 3 THEN ['categories'] WHEN 4 THEN ['primary'] WHEN 5 THEN ['input_tokens'] ELSE [] END) AS rule FROM e""")
def trace_rules(spark, d):
    """Built traces, some with a given id, and the rules that damaged ones break."""
    m = F.col("source_id") % 9
    e = catalog._event_runs(spark, d).withColumn("source_id", F.col("event_id")).withColumn("source_kind", F.lit("event"))
    given = F.when(m == 8, F.concat(F.lit("given-"), _string("source_id")))
    built = traces.build_traces(e.withColumn("trace_id", given)).withColumn("input_tokens", F.when(m == 5, -1).otherwise(1))
    broken = built.withColumns({
        "trace_id": F.when(m == 1, "bad id!").otherwise(F.col("trace_id")), "schema_version": F.when(m == 2, "5").otherwise(F.col("schema_version")),
        "categories": F.when(m == 3, F.array_append("categories", F.lit("nonsense"))).otherwise(F.col("categories")), "primary": F.when(m == 4, "other").otherwise(F.col("primary")),
    })
    return traces.trace_violations(broken)


@_register("""
SELECT event_type, CAST(sum(k + (k + 1)) FILTER (WHERE k % 2 = 0) AS BIGINT) AS input_tokens, count(*) FILTER (WHERE k % 2 = 1) AS unknown FROM (SELECT event_type, CAST(props->>'$.k' AS BIGINT) AS k FROM events) GROUP BY event_type""")
def attempt_usage(spark, d):
    """Token use summed over a run's attempts; one attempt without a count leaves the run without."""
    k = F.col("k")
    none = F.lit(None).cast("long")
    tries = F.array(*[F.struct(i.alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), none.alias("total_tokens")) for i in (k, F.when(k % 2 == 0, k + 1).otherwise(F.lit(-1)))])
    u = event_plans.parsed(table(spark, d, "events")).select("event_type", traces.attempts_usage(tries)["input_tokens"].alias("n"))
    return u.groupBy("event_type").agg(F.sum("n").alias("input_tokens"), F.count_if(F.col("n").isNull()).alias("unknown"))


_BRANCHES = """
x AS (SELECT event_id, event_id % 12 AS m, event_id // 12 % 2 AS n FROM events),
r AS (SELECT event_id, m, n, [CASE WHEN n = 1 AND m < 10 THEN list_extract(['success', 'expected_abstention', 'unsupported_query', 'retrieval_failure', 'tool_failure', 'routing_failure', 'generation_failure', 'citation_failure', 'invalid_output', 'partial_evidence'], m + 1)
    WHEN n = 1 AND m = 10 THEN 'strange' END] AS errors,
  n = 0 AND m = 0 AS insufficient_by_kind, n = 0 AND m = 1 AS insufficient_by_route, n = 0 AND m = 2 AS tool_bad, n = 0 AND m = 3 AS search_bad, n = 0 AND m = 4 AS partly, n = 0 AND m = 5 AS wrong_route,
  n = 0 AND m = 6 AS provider, n = 0 AND m = 7 AS prepared, n = 0 AND m = 8 AS over_abstained, n = 0 AND m = 9 AS abstains, n = 0 AND m = 10 AS money_partial FROM x),
f AS (SELECT event_id, list_distinct(list_filter(errors || [
    CASE WHEN insufficient_by_kind OR insufficient_by_route OR search_bad THEN 'retrieval_failure' END, CASE WHEN tool_bad THEN 'tool_failure' END, CASE WHEN partly OR money_partial THEN 'partial_evidence' END,
    CASE WHEN wrong_route THEN 'routing_failure' END, CASE WHEN provider OR over_abstained THEN 'generation_failure' END, CASE WHEN prepared THEN 'invalid_output' END, CASE WHEN abstains THEN 'unsupported_query' END,
    CASE WHEN n = 0 AND m = 11 OR n = 1 AND m = 11 THEN 'success' END], lambda e: e IS NOT NULL)) AS found FROM r)"""


def _branch_runs(spark: SparkSession, d: str) -> DataFrame:
    """A run per event; each number modulo 12 meets one rule of the classifier, in the second half through a label among the errors."""
    m, n = F.col("event_id") % 12, F.floor(F.col("event_id") / 12) % 2
    only = lambda *k: (n == 0) & m.isin(*k)
    none = F.lit(None).cast("boolean")
    error = F.element_at(F.array(*map(F.lit, (*traces.TAXONOMY, "strange"))), (m + 1).cast("int"))
    search = F.struct(F.lit("document_retrieval").alias("name"), F.when(only(3), "error").otherwise("success").alias("status"))
    money = F.struct(F.lit("financial_data").alias("name"), F.when(only(2), "invalid_input").when(only(4), "unavailable").otherwise("success").alias("status"))
    tools = F.when(only(2, 4, 10), F.array(search, money)).when(only(0, 9), F.array().cast("array<struct<name:string,status:string>>")).otherwise(F.array(search))
    return table(spark, d, "events").select(
        "event_id", F.col("event_id").alias("source_id"), F.when((n == 1) & (m < 11), F.array(error)).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.when(only(5), False).otherwise(none).alias("routing_correct"), F.lit(False).alias("routing_error"), F.when(only(9), "abstain").when(only(0), F.lit(None).cast("string")).otherwise("document_retrieval").alias("route"),
        tools.alias("tools"), F.when(only(6), "incomplete_output").when(only(7), "preparation_error").otherwise("success").alias("generation_status"), (~only(0, 1, 10)).alias("evidence_sufficient"),
        F.when(only(8), True).when(only(10), False).otherwise(none).alias("result_sufficient"), F.when(only(8), False).otherwise(none).alias("expected_abstention"), only(8).alias("abstained"), F.lit(True).alias("contract_valid"),
        F.when(only(0), traces.RETRIEVAL_SOURCE).otherwise("runtime").alias("source_kind"),
    )


@_register(f"""
WITH {_BRANCHES}
SELECT event_id, array_to_string(list_filter(['success', 'expected_abstention', 'unsupported_query', 'retrieval_failure', 'tool_failure', 'routing_failure', 'generation_failure', 'citation_failure', 'invalid_output', 'partial_evidence'], lambda l: list_contains(found, l)), ',') AS categories,
  list_extract(list_filter(['routing_failure', 'tool_failure', 'retrieval_failure', 'partial_evidence', 'generation_failure', 'citation_failure', 'invalid_output', 'unsupported_query', 'expected_abstention', 'success'], lambda l: list_contains(found, l)), 1) AS primary_label
FROM f""")
def failure_branches(spark, d):
    """Every branch of the failure classifier, labels among the errors and the source kind included."""
    out = traces.classify(_branch_runs(spark, d))
    return out.select("event_id", F.array_join("categories", ",").alias("categories"), F.col("primary").alias("primary_label"))


_DAMAGES = (
    (1, '"schema_version":"6.1"', '"schema_version":"5"', (("$.schema_version", "const"),)), (2, '"latency":\\{', '"latencies":{', (("$", "required:latency"), ("$", "additionalProperties"))),
    (3, '"input_tokens":\\d+', '"input_tokens":-1', (("$.generation.token_usage.input_tokens", "minimum"),)), (4, '"timestamp":null', '"timestamp":"yesterday"', (("$.timestamp", "format"),)),
    (5, '"observed":(true|false|null)', '"observed":"no"', (("$.abstention.observed", "type"),)), (6, '"primary":("[a-z_]+"|null)', '"primary":"other"', (("$.failure_attribution.primary", "enum"), ("$.failure_attribution", "primary"))),
    (7, '"primary":("[a-z_]+"|null),"categories":\\[[^\\]]*\\]', '"primary":"success","categories":["success","success"]', (("$.failure_attribution.categories", "uniqueItems"),)),
    (8, '\\}$', "", (("$", "json"),)), (9, '"trace_id":"', '"trace_id":"bad id! ', (("$.trace_id", "pattern"),)),
    (10, '"tools":\\[.*\\],"retrieval"', '"tools":[{},{}],"retrieval"', tuple(("$.tools[]", f"required:{f}") for f in "name status latency_seconds error evidence".split())),
    (11, '"total_tokens":\\d+', '"total_tokens":1.5', (("$.generation.token_usage.total_tokens", "type"),)), (12, '"errors":', '"mistakes":', (("$.validation", "required:errors"),)),
)
_DAMAGE_ROWS = ", ".join(f"({m}, '{path}', '{rule}')" for m, _, _, broken in _DAMAGES for path, rule in broken)


@_register(f"SELECT event_id, path, rule FROM events JOIN (VALUES {_DAMAGE_ROWS}) t(m, path, rule) ON event_id % 14 = m")
def stored_trace_rules(spark, d):
    """A whole public trace per event as stored JSON, most of them damaged in one way, against the trace schema."""
    runs = _branch_runs(spark, d)
    k, none = F.col("event_id"), F.lit(None).cast("string")
    config = F.struct(
        F.struct(F.lit("hybrid").alias("mode"), F.lit(5).alias("top_k"), F.lit("x").alias("private")).alias("retrieval"),
        F.struct(F.lit("p").alias("provider"), F.lit("m").alias("model"), F.struct(F.lit(1).alias("seed"), F.lit("y").alias("host")).alias("provider_options")).alias("llm"))
    evidence = F.array(F.struct(F.concat(F.lit("C"), k).alias("context_id"), F.lit("private").alias("text"), F.lit("https://www.sec.gov/a?b=1").alias("source_url")))
    more = {
        "query": F.lit("q"), "reviewed": none, "reason": F.lit("r"), "tools_selected": F.array(F.lit("document_retrieval")), "timestamp": none, "has_output": F.lit(True), "citations": F.array(F.lit("C1")), "config": config, "evidence": evidence,
        "latencies": F.struct(*[(F.col("event_id") % 5).cast("double").alias(n) for n in ("retrieval", "generation", "recorded", "orchestration")]),
        "usage": F.struct(k.cast("long").alias("input_tokens"), F.lit(2).cast("long").alias("output_tokens"), F.lit(None).cast("long").alias("total_tokens")),
    }
    # the event's number stands beside the trace, whose id is a hash
    built = traces.unified_traces(runs.withColumns(more).withColumn("trace_id", F.concat(F.lit("e-"), k.cast("string"))))
    text = F.col("trace")
    numbered = built.select(F.regexp_extract("trace_id", r"(\d+)", 1).cast("long").alias("event_id"), "trace")
    for at, pattern, new, _ in _DAMAGES:
        text = F.when(F.col("event_id") % 14 == at, F.regexp_replace(F.col("trace"), pattern, new)).otherwise(text)
    return traces.stored_trace_violations(numbered.select("event_id", text.alias("trace")), "event_id", "trace")


@_register("""
WITH l AS (SELECT doc_id, i, l, CAST(coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
s AS (SELECT doc_id, string_agg('{"end_char":' || (a + length(l)) || ',"start_char":' || a || ',"text":' || to_json(l) || '}', ',' ORDER BY i) AS j FROM l GROUP BY doc_id)
SELECT doc_id AS document_id, sha256('{"document_id":' || doc_id || ',"lang":' || to_json(lang) || ',"notes":{"characters":' || length(text) || ',"é":null},"sections":[' || j || '],"text":' || to_json(text) || '}') AS digest FROM documents JOIN s USING (doc_id)""")
def parsed_document_digests(spark, d):
    """Digests of whole parsed documents with nested sections and a map."""
    docs = frames.documents(spark, d)
    lines = F.split("text", "\n")
    ends = F.transform(lines, lambda x, i: F.aggregate(F.slice(lines, 1, i + 1), F.lit(0), lambda s, y: s + F.length(y) + 1) - 1)
    sections = F.zip_with(lines, ends, lambda x, e: F.struct(x.alias("text"), (e - F.length(x)).alias("start_char"), e.alias("end_char")))
    notes = F.create_map(F.lit("é"), F.lit(None).cast("int"), F.lit("characters"), F.length("text"))
    parsed = docs.select(F.col("doc_id").alias("document_id"), "lang", "text", sections.alias("sections"), notes.alias("notes"))
    return parsed.select("document_id", row_digest(parsed).alias("digest"))


@_register(f"""
WITH {catalog._spans_sql()}, t AS (SELECT doc_id, length(text) AS n, text, doc_id % 12 AS m FROM documents WHERE length(text) >= 8),
h AS (SELECT t.*, s.end_char AS e FROM span s JOIN t USING (doc_id) WHERE chunk_index = 0),
r AS (
  SELECT 'experiment' AS rule FROM h WHERE m = 1 UNION ALL SELECT 'chunk_id' FROM h WHERE m IN (1, 3, 4, 6) UNION ALL SELECT 'strategy' FROM h WHERE m = 2 UNION ALL SELECT 'parsed_document' FROM h WHERE m = 3
  UNION ALL SELECT 'offsets' FROM h WHERE m = 4 UNION ALL SELECT 'slice' FROM h WHERE m = 4 AND e < n UNION ALL SELECT 'slice' FROM h WHERE m = 5 UNION ALL SELECT 'provenance:source' FROM h WHERE m = 7
  UNION ALL SELECT 'sections' FROM h WHERE m = 8 AND n // 4 < e UNION ALL SELECT 'repeated_id' FROM h WHERE m = 9 UNION ALL SELECT 'uncovered_document' FROM h WHERE m = 10 UNION ALL SELECT 'unknown_document' FROM h WHERE m = 11
  UNION ALL SELECT 'chunk_id' FROM h WHERE m = 11 UNION ALL SELECT 'uncovered_document' FROM (SELECT doc_id FROM span JOIN t USING (doc_id) WHERE m = 11 GROUP BY doc_id HAVING count(*) = 1) UNION ALL SELECT 'total_chunks')
SELECT rule, count(*) AS chunks FROM r GROUP BY rule""")
def chunk_validation(spark, d):
    """Stored chunks of all documents against their manifest and parsed documents; the first chunk of a document is damaged by the document's number."""
    docs = _sectioned(spark, d).drop("content")
    made = stored(chunking.chunk_documents(docs, frames.CHUNKS, ("source",)), "chunks")  # read by every rule below
    manifest = chunking.manifest_of(made, docs.select("document_id", "text", "source", "sections"), frames.CHUNKS)
    m, first, c = F.col("document_id") % 12, F.col("chunk_index") == 0, F.col
    hit = lambda k: first & (m == k)
    changed = made.where(m != 10).withColumns({
        "experiment_id": F.when(hit(1), "x").otherwise(c("experiment_id")), "strategy": F.when(hit(2), "x").otherwise(c("strategy")), "parsed_document_sha256": F.when(hit(3), "x").otherwise(c("parsed_document_sha256")),
        "start_char": F.when(hit(4), -1).otherwise(c("start_char")), "text": F.when(hit(5), F.concat(F.lit("☃"), F.expr("substring(text, 2)"))).otherwise(c("text")), "chunk_id": F.when(hit(6), F.concat(F.lit("bad"), _string("document_id"))).otherwise(c("chunk_id")),
        "source": F.when(hit(7), "elsewhere").otherwise(c("source")), "sections": F.when(hit(8), F.slice("sections", 1, 0)).otherwise(c("sections")), "document_id": F.when(hit(11), -c("document_id") - 1).otherwise(c("document_id")),
    })
    twice = changed.where((c("document_id") >= 0) & (F.col("chunk_index") == 0) & (c("document_id") % 12 == 9))
    return files.validate_chunks(changed.unionByName(twice), docs, manifest, ("source",)).groupBy("rule").agg(F.count(F.lit(1)).alias("chunks"))


@_register("SELECT vec_id AS id, len(embedding) AS dims, 'first' AS made FROM embeddings WHERE vec_id % 10 <> 0 UNION ALL SELECT vec_id, len(embedding), 'again' FROM embeddings WHERE vec_id % 10 = 0")
def vector_cache(spark, d):
    """A vector cache that is filled, loses a tenth of its rows to damage and makes just those anew."""
    root, name = _folder(spark, "cache"), f"vectors_{uuid.uuid4().hex[:12]}"
    cache = CacheTable(spark, name, root, "array<float>", 8)
    v = table(spark, d, "embeddings").select(dense.cache_key("m", "document", F.col("vec_id"), _string("vec_id")).alias("key"), F.col("vec_id").alias("id"), "embedding")
    copy = lambda rows: rows.select("key", F.col("embedding").alias("value"))
    cache.fill(v, copy)
    lost = v.where("id % 10 = 0")
    cache.forget(lost)
    lost.select("key", F.col("embedding").alias("value"), F.lit(1).cast("long").alias("checksum"), F.lit(0.0).alias("made")).write.insertInto(name)  # rows whose checksum does not fit
    spark.catalog.refreshTable(name)
    again = cache.damaged().withColumn("again", F.lit("again"))
    again = stored(again, "cache-damaged")
    out, many = cache.fill(v, copy)
    if many != again.count() or cache.fill(v, copy)[1]:
        raise AssertionError("the cache computed other rows than the damaged ones")
    return out.join(again, "key", "left").select("id", F.size("value").cast("long").alias("dims"), F.coalesce("again", F.lit("first")).alias("made"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
