"""Offset-exact chunking: fixed size in closed form, natural boundaries in Arrow batches.

Chunks are array expressions over their document's row: the text is read once,
cut where it is read and then exploded, so chunking shuffles nothing.

``documents``: document_id, text, and optionally sections and content (arrays of
structs with start_char and end_char).  Offsets are code points, 0-based, end
exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import asdict, dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.arrow import small
from dossier.functions.canonical import row_digest
from dossier.functions.ids import digest, record_digest
from dossier.operators.quantiles import exact_quantiles

VERSION = "1"
STRATEGIES = ("fixed_size", "recursive", "sections")
# The boundary classes in order of preference are blank lines, line ends, sentence ends and white space.
SENTENCE_END = re.compile(r"[.!?][”’\"')]*\s+")
_SPACE = re.compile(r"\s+")
_SPANS = "array<struct<unit_index:int,unit_chunk_index:int,chunk_index:int,start_char:int,end_char:int,text:string>>"


@dataclass(frozen=True)
class ChunkingConfig:
    strategy: str = "fixed_size"
    size: int = 2000
    overlap: int = 200
    minimum: int = 200
    boundary_fraction: float = 0.5

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        whole = (self.size, self.overlap, self.minimum)
        if any(type(v) is not int for v in whole):
            raise ValueError("size, overlap and minimum must be integers")
        if not 0 <= self.overlap < self.size or not 1 <= self.minimum <= self.size:
            raise ValueError("need 0 <= overlap < size and 1 <= minimum <= size")
        f = self.boundary_fraction
        if isinstance(f, bool) or not isinstance(f, (int, float)) or not 0 < f <= 1:
            raise ValueError("boundary_fraction must be in (0, 1]")

    @property
    def experiment_id(self) -> str:
        return digest({"version": VERSION, "config": asdict(self)})


def fixed_spans(length: Column, c: ChunkingConfig) -> Column:
    """array<struct<chunk_index, start_char, end_char>> of a text of ``length`` code points.

    Chunk k starts at k * step.  Only the last boundary may move: a tail shorter
    than the minimum shares the last two chunks' text with its predecessor.
    """
    step = c.size - c.overlap
    last = F.greatest(F.lit(0), F.ceil((length - c.size) / F.lit(step))).cast("int")
    before = (last - 1) * step
    tail = length - last * step
    target = F.least(F.lit(c.minimum), F.floor((length - before + c.overlap) / F.lit(2))).cast("int")
    cut = length - target + c.overlap
    moved = (last > 0) & (tail < c.minimum) & (before + c.overlap < cut) & (cut <= before + c.size)

    def span(k: Column) -> Column:
        start = F.when(moved & (k == last), cut - c.overlap).otherwise(k * step)
        end = F.when(moved & (k == last - 1), cut).otherwise(F.least(k * step + c.size, length))
        return F.struct(k.cast("int").alias("chunk_index"), start.cast("int").alias("start_char"), F.when(k == last, length).otherwise(end).cast("int").alias("end_char"))

    return F.when(length > 0, F.transform(F.sequence(F.lit(0), last), span)).otherwise(F.array().cast("array<struct<chunk_index:int,start_char:int,end_char:int>>"))


class Boundaries:
    """Where a text may be cut, found in one pass and searched by position."""

    def __init__(self, text: str):
        runs = [m.span() for m in _SPACE.finditer(text)]
        self.starts, self.ends = [a for a, _ in runs], [b for _, b in runs]
        self.lines = [i for a, b in runs for i in range(a, b) if text[i] == "\n"]
        #: Where the mark before a run of white space stands, by the end of the run.
        self.marks = {m.end(): m.start() for m in SENTENCE_END.finditer(text)}

    def last(self, at: int, limit: int, least: int) -> int:
        """The rightmost boundary of the best class within [least, limit] of the stretch [at, limit), or limit."""
        sentence = space = None
        k = bisect_left(self.starts, limit) - 1
        while k >= 0 and min(self.ends[k], limit) >= least:
            a, b = max(self.starts[k], at), min(self.ends[k], limit)
            x, y = bisect_left(self.lines, a), bisect_left(self.lines, b)
            if y - x > 1 and self.lines[y - 1] >= least - 1:
                return self.lines[y - 1] + 1
            space = b if space is None else space
            if sentence is None and self.marks.get(self.ends[k], -1) >= at:
                sentence = b
            k -= 1
        y = bisect_left(self.lines, limit)
        if y and self.lines[y - 1] >= least - 1:
            return self.lines[y - 1] + 1
        return sentence or space or limit


def natural_spans(text: str, begin: int, end: int, c: ChunkingConfig, bounds: Boundaries | None = None) -> list[tuple[int, int]]:
    """Spans of [begin, end) that stop at natural boundaries; a short tail is evened out with its predecessor."""
    bounds = bounds or Boundaries(text)
    reach = max(c.overlap + 1, int(c.size * c.boundary_fraction))
    cuts = [(begin, begin)] if begin < end else []
    while cuts and cuts[-1][1] < end:
        at = cuts[-1][1] - (c.overlap if cuts[-1][1] > begin else 0)
        limit = min(at + c.size, end)
        stop = limit if limit == end else bounds.last(at, limit, at + reach)
        if stop < end and end - stop + c.overlap < c.minimum:
            shared = end + c.overlap - min(c.minimum, (end - at + c.overlap) // 2)
            stop = shared if at + c.overlap < shared <= limit else stop
        cuts.append((at, stop))
    return cuts[1:]


def regions(text: str, sections: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sections, which are in order and apart, and the stretches between them that show something."""
    edges = [0, *chain.from_iterable(sections), len(text)]
    between = list(zip(edges, edges[1:]))
    return [(a, b) for k, (a, b) in enumerate(between) if k % 2 or text[a:b].strip()]


def _natural(documents: DataFrame, c: ChunkingConfig) -> DataFrame:
    """``documents`` plus __spans, the chunks of each text with their pieces, in Arrow batches."""
    by_section = c.strategy == "sections"
    own = documents.columns

    def run(batches):
        import pyarrow as pa

        for batch in small(batches):
            ends, at, pieces = [0], [], []
            bounds_of = batch.column("__bounds").to_pylist()
            for text, sections in zip(batch.column("text").to_pylist(), bounds_of):
                text = text or ""
                bounds, n = Boundaries(text), len(at)
                units = regions(text, sorted((s["start_char"], s["end_char"]) for s in sections)) if by_section else [(0, len(text))]
                for u, (a, b) in enumerate(units):
                    for k, (x, y) in enumerate(natural_spans(text, a, b, c, bounds)):
                        at.append((u, k, len(at) - n, x, y))
                        pieces.append(text[x:y])
                ends.append(len(at))
            columns = [pa.array(v, pa.int32()) for v in (zip(*at) if at else [[]] * 5)] + [pa.array(pieces, pa.string())]
            spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["unit_index", "unit_chunk_index", "chunk_index", "start_char", "end_char", "text"]))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in own], spans], names=[*own, "__spans"])

    ends = F.transform("sections", lambda s: F.struct(s["start_char"].alias("start_char"), s["end_char"].alias("end_char"))) if by_section else F.array().cast("array<struct<start_char:int,end_char:int>>")
    schema = documents.limit(0).withColumn("__spans", F.lit(None).cast(_SPANS)).schema
    return documents.withColumn("__bounds", ends).mapInArrow(run, schema)


def _spread(documents: DataFrame, c: ChunkingConfig, cut: bool) -> DataFrame:
    """``documents`` with one row per chunk: ``chunk`` holds its place and, if ``cut``, its text."""
    if c.strategy != "fixed_size":
        return _natural(documents, c).withColumn("chunk", F.explode("__spans"))
    unit = [F.lit(0).alias("unit_index")]
    if not cut:  # the length is a column of its own, or every chunk would measure the text again
        d = documents.withColumn("__length", F.length("text")).withColumn("s", F.explode(fixed_spans(F.col("__length"), c)))
        return d.withColumn("chunk", F.struct(*unit, F.col("s.chunk_index").alias("unit_chunk_index"), "s.chunk_index", "s.start_char", "s.end_char"))
    step = c.size - c.overlap
    # The text in blocks of one step: a chunk joins the few blocks it meets, so that cutting is linear in the text.
    d = documents.withColumn("__blocks", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1)))
    whole = F.when(F.size("__blocks") > 0, (F.size("__blocks") - 1) * step + F.length(F.element_at("__blocks", -1))).otherwise(0)
    d = d.withColumn("__length", whole).withColumn("__spans", fixed_spans(F.col("__length"), c))

    def piece(s: Column) -> Column:
        first = F.floor(s["start_char"] / step).cast("int")
        many = F.ceil(s["end_char"] / step).cast("int") - first
        return F.substring(F.array_join(F.slice("__blocks", first + 1, many), ""), s["start_char"] - first * step + 1, s["end_char"] - s["start_char"])

    chunks = F.transform("__spans", lambda s: F.struct(*unit, s["chunk_index"].alias("unit_chunk_index"), s["chunk_index"].alias("chunk_index"), s["start_char"].alias("start_char"), s["end_char"].alias("end_char"), piece(s).alias("text")))
    return d.withColumn("chunk", F.explode(chunks))


def chunk_spans(documents: DataFrame, c: ChunkingConfig, carry: tuple[str, ...] = ()) -> DataFrame:
    """document_id, ``carry``, unit_index, unit_chunk_index, chunk_index, start_char, end_char."""
    place = [f"chunk.{x}" for x in ("unit_index", "unit_chunk_index", "chunk_index", "start_char", "end_char")]
    return _spread(documents, c, False).select("document_id", *carry, *place)


def clip_sections(sections: Column, start: Column, end: Column) -> Column:
    """The sections that meet [start, end), clipped to it (an array expression, no join)."""
    inside = F.filter(sections, lambda s: (s["start_char"] < end) & (s["end_char"] > start))
    return F.transform(inside, lambda s: F.struct(
        s["section_id"].alias("section_id"), s["item"].alias("item"), s["name"].alias("section_name"),
        F.greatest(s["start_char"], start).alias("start_char"), F.least(s["end_char"], end).alias("end_char")))


def clip_tables(content: Column, start: Column, end: Column) -> Column:
    """Table blocks that meet [start, end): index, own span, clipped span, is_partial."""
    marked = F.transform(content, lambda b, i: F.struct(i.alias("i"), b["type"].alias("type"), b["start_char"].alias("a"), b["end_char"].alias("b")))
    inside = F.filter(marked, lambda t: (t["type"] == "table") & (t["a"] < end) & (t["b"] > start))
    return F.transform(inside, lambda t: F.struct(
        t["i"].alias("block_index"), t["a"].alias("block_start_char"), t["b"].alias("block_end_char"),
        F.greatest(t["a"], start).alias("start_char"), F.least(t["b"], end).alias("end_char"),
        ((start > t["a"]) | (end < t["b"])).alias("is_partial")))


def chunk_documents(documents: DataFrame, c: ChunkingConfig, carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks with text, section references, scope, tables, overlap and content-addressed ids."""
    keep = ["document_id", "text", *carry] + [x for x in ("sections", "content") if x in documents.columns]
    d = documents.select(*keep)
    d = d.withColumn("parsed_document_sha256", row_digest(d, *digest_columns(d)))
    spread = _spread(d, c, True)
    before = F.when(F.col("chunk.chunk_index") > 0, F.element_at("__spans", F.col("chunk.chunk_index"))["end_char"])
    overlap = F.coalesce(F.greatest(F.lit(0), before - F.col("chunk.start_char")), F.lit(0))
    kept = [x for x in d.columns if x != "text"]
    out = spread.select(*kept, "chunk.*", overlap.alias("overlap_with_previous"))
    out = out.withColumn("character_count", F.col("end_char") - F.col("start_char"))
    if "sections" in documents.columns:
        out = out.withColumn("sections", clip_sections(F.col("sections"), F.col("start_char"), F.col("end_char")))
        covered = F.aggregate("sections", F.lit(0), lambda s, x: s + x["end_char"] - x["start_char"])
        out = out.withColumn("unsectioned_characters", F.col("character_count") - covered)
        single = (F.size("sections") == 1) & (F.col("unsectioned_characters") == 0)
        out = out.withColumns({
            "section_scope": F.when(single, "single").when(F.size("sections") > 0, "mixed").otherwise("unsectioned"),
            "item": F.when(single, F.col("sections")[0]["item"]), "section_id": F.when(single, F.col("sections")[0]["section_id"]),
            "section_name": F.when(single, F.col("sections")[0]["section_name"]),
        })
    if "content" in documents.columns:
        out = out.withColumn("table_fragments", clip_tables(F.col("content"), F.col("start_char"), F.col("end_char"))).drop("content")
    name = record_digest(
        {"version": F.lit(VERSION), "experiment_id": F.lit(c.experiment_id), "parsed_document_sha256": F.col("parsed_document_sha256"), "document_id": F.col("document_id").cast("string")},
        {"chunk_index": F.col("chunk_index"), "start_char": F.col("start_char"), "end_char": F.col("end_char")},
    )
    return out.withColumns({"chunk_id": name, "version": F.lit(VERSION), "experiment_id": F.lit(c.experiment_id), "strategy": F.lit(c.strategy)})


def digest_columns(documents: DataFrame) -> list[str]:
    """The columns of parsed documents that their digest covers: all that have a canonical text."""
    floats = re.compile(r"\b(float|double|decimal|date|timestamp|binary)")
    return [f.name for f in documents.schema.fields if not floats.search(f.dataType.simpleString())]


def manifest_of(chunks: DataFrame, documents: DataFrame, c: ChunkingConfig) -> dict:
    """What ``files.validate_chunks`` checks stored chunks against."""
    return {"version": VERSION, "experiment_id": c.experiment_id, "strategy": c.strategy, "digest": digest_columns(documents), "total_chunks": chunks.count()}


def document_violations(documents: DataFrame, provenance: tuple[str, ...]) -> DataFrame:
    """document_id, rule for every broken rule of a parsed document (all of them, not the first)."""
    rules = {f"provenance:{p}": F.coalesce(F.col(p) != "", F.lit(False)) for p in provenance}
    rules["document_id"] = F.col("document_id").rlike(r"^[A-Za-z0-9_-]+\z")
    rules["text"] = F.col("text").isNotNull()
    for name in ("sections", "content"):
        if name in documents.columns:
            pairs = F.arrays_zip(F.slice(F.col(name), 1, F.greatest(F.size(name) - 1, F.lit(0))).alias("p"), F.slice(F.col(name), 2, F.greatest(F.size(name) - 1, F.lit(0))).alias("n"))
            rules[f"{name}:order"] = F.forall(pairs, lambda x: x["p"]["end_char"] <= x["n"]["start_char"])
            rules[f"{name}:offsets"] = F.forall(name, lambda s: (s["start_char"] >= 0) & (s["start_char"] < s["end_char"]) & (s["end_char"] <= F.length("text")))
            rules[f"{name}:slice"] = F.forall(name, lambda s: F.substring(F.col("text"), s["start_char"] + 1, s["end_char"] - s["start_char"]) == s["text"])
    if "sections" in documents.columns:
        ids = F.transform("sections", lambda s: s["section_id"])
        rules["sections:unique"] = F.size(F.array_distinct(ids)) == F.size(ids)
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return documents.select("document_id", F.explode(broken).alias("rule"))


def chunk_statistics(chunks: DataFrame, by: list[str], minimum: int) -> DataFrame:
    """Corpus and per-group figures in one pass (grouping sets (by), ()); medians by selection, without a buffer of a group."""
    n = F.col("character_count")
    measures = [
        F.count(n).alias("chunks"), F.round(F.avg(n), 2).alias("mean_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.count_if(n < minimum).alias("small"),
        F.sum(n).alias("total_chars"), F.grouping_id().alias("level"),
    ]
    if "sections" in chunks.columns:
        measures.append(F.count_if(F.size("sections") > 1).alias("mixed"))
    if "table_fragments" in chunks.columns:
        measures += [F.count_if(F.size("table_fragments") > 0).alias("with_tables"), F.count_if(F.exists("table_fragments", lambda t: t["is_partial"])).alias("with_partial_tables")]
    figures = chunks.groupingSets([[F.col(c) for c in by], []], *by).agg(*measures)
    whole = (1 << len(by)) - 1
    each = exact_quantiles(chunks, by, n, {"median_chars": "median"}).withColumn("level", F.lit(0))
    every = exact_quantiles(chunks, [], n, {"median_chars": "median"}).withColumn("level", F.lit(whole))
    medians = each.unionByName(every, allowMissingColumns=True)
    on = F.col("l.level") == F.col("r.level")
    for c in by:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return figures.alias("l").join(medians.alias("r"), on, "left").select("l.*", "r.median_chars").drop("level")


def item_distribution(chunks: DataFrame) -> DataFrame:
    """item, chunks: every chunk once per distinct item it meets, and once as unsectioned."""
    items = F.array_distinct(F.transform("sections", lambda s: s["item"]))
    marked = F.when(F.col("unsectioned_characters") > 0, F.concat(items, F.array(F.lit("unsectioned")))).otherwise(items)
    return chunks.select(F.explode(marked).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("chunks"))
