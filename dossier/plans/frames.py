"""Frames that map the test tables onto the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import chunking, dense, lexical, postings
from dossier.operators.evidence import find_passages
from dossier.sources.files import read_table as table
from dossier.sources.stored import stored

CHUNKS = chunking.ChunkingConfig("fixed_size", 400, 50, 60)
SYSTEMS = {"bm25": (1.2, 0.75), "flat": (0.9, 0.4)}
DEPTH = 50


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """qid, tokens: the words of every benchmark item."""
    return lexical.as_questions(table(spark, d, "benchmark"), F.col("item_id"), F.col("text"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every document that holds an item: evidence_id, qid, document_id, start_char, end_char, text."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    found = find_passages(documents(spark, d).select(F.col("doc_id").alias("document_id"), "text"), b)
    return found.select(F.concat_ws(":", F.col("qid").cast("string"), F.col("document_id").cast("string")).alias("evidence_id"), "*")


def question_labels(spark: SparkSession, d: str, gold: DataFrame | None = None) -> DataFrame:
    """qid, answerable, multi, category, difficulty; ``gold`` is the evidence, where it is there already."""
    b = table(spark, d, "benchmark")
    n = (evidence(spark, d) if gold is None else gold).groupBy("qid").agg(F.count_distinct("document_id").alias("n"))
    m = b.select(F.col("item_id").alias("qid"), F.length("text").alias("chars")).join(n, "qid", "left")
    return m.select(
        "qid", F.col("n").isNotNull().alias("answerable"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("multi"),
        F.when(F.col("chars") < 160, "short").when(F.col("chars") < 260, "medium").otherwise("long").alias("category"),
        F.when(F.col("qid") % 3 == 0, "easy").when(F.col("qid") % 3 == 1, "medium").otherwise("hard").alias("difficulty"),
    )


def whole_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every document as one chunk."""
    return documents(spark, d).select(F.col("doc_id").alias("document_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit(0).alias("start_char"), F.length("text").alias("end_char"), "text")


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Fixed-size chunks with readable ids."""
    docs = documents(spark, d).select(F.col("doc_id").alias("document_id"), "text", "lang")
    c = chunking.chunk_documents(docs, CHUNKS, ("lang",))
    return c.withColumn("chunk_id", F.concat_ws("#", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """The tokenised documents."""
    return lexical.document_tokens(documents(spark, d))


_INDEXES: dict[tuple, postings.Index] = {}


def index(spark: SparkSession, d: str) -> postings.Index:
    """The stored postings of the documents, built once for the files that are there in an application."""
    files = documents(spark, d).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*files.columns)).alias("h")).first()
    key = (spark.sparkContext.applicationId, d, state.n, state.h)
    if key not in _INDEXES:
        _INDEXES[key] = postings.build_index(documents(spark, d))
    return _INDEXES[key]


def asked(spark: SparkSession, d: str, system: str = "bm25") -> postings.Asked:
    """The benchmark items as questions to the index."""
    return postings.ask(index(spark, d), questions(spark, d), *SYSTEMS[system])


def scores(spark: SparkSession, d: str, system: str, t: DataFrame | None = None, best: int | None = None) -> DataFrame:
    """Scores, written once."""
    k1, b = SYSTEMS[system]
    return stored(lexical.bm25_scores(tokens(spark, d) if t is None else t, questions(spark, d), k1, b, best), "scores")


def bm25_top(spark: SparkSession, d: str, k: int) -> DataFrame:
    """qid, id, score, rank <= k."""
    ids = documents(spark, d).select(F.col("doc_id").alias("id"))
    return lexical.top_ranked(scores(spark, d, "bm25", best=k), ids, questions(spark, d), k)


def dense_top(spark: SparkSession, d: str, k: int = DEPTH) -> DataFrame:
    """qid, id, rank <= k: the vectors nearest to the one that has an item's number."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"))
    return dense.cosine_top(v, v.join(items, F.col("id") == F.col("qid")).select("qid", "vector"), k)


def ranked(spark: SparkSession, d: str, gold: DataFrame, k: int = DEPTH) -> DataFrame:
    """system, qid, chunk_id, rank <= k for both settings and their fusion, plus the full-ranking places of relevant documents."""
    t, ids = tokens(spark, d), documents(spark, d).select(F.col("doc_id").alias("id"))
    q = stored(questions(spark, d), "asked")
    figures = lexical.term_figures(t, q)
    tops, out = [], None
    rel = gold.select("qid", F.col("document_id").alias("id")).distinct()
    for name in SYSTEMS:
        best = stored(lexical.bm25_scores(t, q, *SYSTEMS[name], k, figures=figures), "scores")
        top = stored(lexical.top_ranked(best, ids, q, k), "top")
        tops.append(top)
        far = lexical.bm25_ranks(t, q, ids, rel, *SYSTEMS[name], figures).where(F.col("rank") > k)
        part = top.select("qid", "id", F.col("rank").cast("long")).unionByName(far).withColumn("system", F.lit(name))
        out = part if out is None else out.unionByName(part)
    both = lexical.fuse_rankings(tops, 60.0, k).select("qid", "id", F.col("rank").cast("long"), F.lit("rrf").alias("system"))
    return out.unionByName(both).select("system", "qid", F.col("id").cast("string").alias("chunk_id"), "rank")


def raw_facts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as annual fact rows: the customer is the company, the order status the concept."""
    o = table(spark, d, "orders")
    fy = F.year("o_orderdate")
    concept = F.when(F.col("o_orderstatus") == "F", "Assets").when(F.col("o_orderstatus") == "O", "NetIncomeLoss").otherwise("Revenues")
    form = F.when(F.col("o_orderpriority").startswith("1"), "10-K/A").when(F.col("o_orderpriority").startswith("5"), "10-Q").otherwise("10-K")
    last = F.concat((fy - 1).cast("string"), F.lit("-12-31"))
    flow = F.col("o_orderstatus") != "F"
    short = F.col("o_orderkey") % 4 == 0
    return o.select(
        F.col("o_custkey").cast("string").alias("cik"), F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ticker"), F.concat(F.lit("Company "), F.col("o_custkey").cast("string")).alias("company"),
        concept.alias("concept"), F.when(F.col("o_orderkey") % 10 == 0, "EUR").otherwise("USD").alias("unit"), F.col("o_orderkey").cast("int").alias("idx"),
        F.when(flow, F.concat((fy - 1).cast("string"), F.when(short, "-07-01").otherwise("-01-01"))).alias("start"), last.alias("end"),
        F.col("o_totalprice").alias("val"), fy.alias("fy"), F.lit("FY").alias("fp"), form.alias("form"),
        F.concat(fy.cast("string"), F.lit("-02-01")).alias("filed"), F.concat_ws("-", F.col("o_custkey").cast("string"), fy.cast("string")).alias("accn"),
    )


def routed_questions(spark: SparkSession, d: str) -> DataFrame:
    """A question per customer."""
    k = F.col("c_custkey")
    name = F.element_at(F.array(*map(F.lit, ("Apple", "msft", "NVIDIA", "Contoso"))), (k % 4 + 1).cast("int"))
    what = F.element_at(F.array(*map(F.lit, ("revenue", "net  income", "cash", "strategy", "stock price"))), (k % 5 + 1).cast("int"))
    when = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" in "), (F.lit(2015) + k % 10).cast("string")))
    why = F.when(k % 7 == 0, " and why did it change?").otherwise("?")
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("What was "), name, F.lit(" "), what, when, why).alias("q"))


def answer_pairs(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, answer, question: each assistant turn with the user turn before it."""
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return a.join(u, ["conv_id", "turn"])
