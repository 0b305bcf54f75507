"""N-gram Jaccard join over sets of 5-word shingles, exact at ``PERCENT``.

Two sets that reach the threshold share one of their first
``n - ceil(0.75 n) + 1`` shingles under any common order (prefix filter), so
documents meet in tiles keyed by those shingles.  The order puts shingles that a
counting sketch finds frequent last, which keeps common passages out of the
tiles; large tiles with the same least document, as those of one passage are, become
one.  Inside a tile documents lie in size bands (a partner has at most 4/3 of
the size), and the parity bitmaps of two sets bound their overlap from above:
the set bits of the XOR never exceed the symmetric difference.  Pairs that pass
are decided by intersecting the sorted shingle arrays.

Copies collapse first: equal sets are one node.  Then few rounds compare a node with
the seeded pivot of one tile, another of its ``PIVOTS`` lowest shingles each round, those
that the fewest nodes have first, and only while their groups differ, until a round
joins almost nothing: a round makes at most one pair a node, and a near-copy group
grows together through few pairs.  Tiles afterwards compare only nodes of different groups, so a group's own
pairs are not emitted again; links between groups stay exact.  A tile of at most
``SMALL`` nodes names its pairs at once; larger ones are compared with their
bitmaps, those above ``TILE_NODES`` in cells: pairs of blocks of one or two
neighbouring size bands.  The rounds only save work; ``PIVOTS``, ``ROUNDS``,
``SMALL``, ``HOMES`` and ``TILE_NODES`` shift work between equal ways and lose no pair.

Every link lies inside one component, so the links of a node can be counted
over all pairs of its component, each pair once, in pairs of blocks of at most
about ``BLOCK_NODES`` nodes and ``BLOCK_SHINGLES`` shingles.  That count grows with
the square of a component's different texts; ``count_links=False`` leaves it out.

Defined results
* null or empty text: no shingles, linked with nothing
* 1 to 4 words: one shingle of the whole sequence
* equal doc_ids are one document: its rows share a component; every row is returned
* n_links: other documents with an equal or linked set; a doc_id with several texts counts with each
* a null doc_id is linked with nothing
* an empty table gives an empty table; extra columns are ignored
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm import textcore
from dossier.llm.components import components
from dossier.llm.durable import durable, release, settle

PERCENT = 75
PIVOTS = 4
SKETCH_BITS = 18
SKETCH_PARTS = 16
FILTER_BITS = 1 << 26
SMALL = 6
ROUNDS = 4
HOMES = 24
TILE_NODES = 1024
BLOCK_NODES = 1024
BLOCK_SHINGLES = 1 << 19
_BLOCK = 512
_RARE = 48


def bitmap_width(n: int) -> int:
    """Bits of the parity bitmap of a set of ``n``: the power of two from 2n on."""
    return 1 << max(6, (2 * n - 1).bit_length()) if n else 64


def parity_bitmap(s: np.ndarray) -> np.ndarray:
    """uint64 words; bit k tells whether an odd number of elements hash to k."""
    width = bitmap_width(len(s))
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _fold(words: np.ndarray, width: int) -> np.ndarray:
    """A wider bitmap folded to ``width`` words; parities add up."""
    while len(words) > width:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def need(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Least intersection of sets of sizes a and b at the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def _digest(s: np.ndarray) -> int:
    """A 63-bit name of a set."""
    return int((textcore.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))) >> np.uint64(1))


def _ranks(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Indexes of a sorted set in tile order: rare class first, then hash."""
    c = classes[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return np.argsort(c, kind="stable") if c.any() else np.arange(len(s))


def _blobs(pa, bucket: np.ndarray, *columns: np.ndarray):
    """(buckets, one binary per column) of rows grouped by bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    cut = np.append(at, len(b))
    out = [pa.array(b[at].astype(np.int32))]
    for c in columns:
        c = c[order]
        out.append(pa.array([c[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary()))
    return out


def _scan(docs: DataFrame) -> DataFrame:
    """Durable: one row per document (doc_id, n, node, low, bitmap) and sketch rows (part, sketch)."""

    def run(batches):
        import pyarrow as pa

        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch, i, j, data, offsets in textcore.text_pieces(batches):
            sets = textcore.shingle_sets(*textcore.words(data, offsets))
            sketch += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            k = j - i
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, k), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.int64()),
                    pa.array([s[:PIVOTS].astype(np.int64).tolist() for s in sets], pa.list_(pa.int64())),
                    pa.array([parity_bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()),
                ],
                names=names,
            )
        p = sketch.reshape(SKETCH_PARTS, -1)
        k = SKETCH_PARTS
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64())] * 3 + [pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.binary()), pa.array(np.arange(k, dtype=np.int32)), pa.array([x.tobytes() for x in p], pa.binary())],
            names=names,
        )

    names = ["doc_id", "n", "node", "low", "bitmap", "part", "sketch"]
    return durable(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long, low array<long>, bitmap binary, part int, sketch binary"), "jaccard-docs")


def _classes(scan: DataFrame) -> np.ndarray:
    """Frequency class of every sketch bin: 0 up to the usual load, then one more per doubling."""

    def add(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, s in zip(batch.column("part").to_pylist(), batch.column("sketch").to_pylist()):
                x = np.frombuffer(s, np.int64)
                total[p] = total[p] + x if p in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "sketch"])

    rows = scan.where("part is not null").select("part", "sketch").repartition(SKETCH_PARTS, "part").mapInArrow(add, "part int, sketch binary").collect()  # 2^18 counters
    sketch = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.int64)
    for r in rows:
        sketch[r.part] += np.frombuffer(r.sketch, np.int64)
    load = sketch.ravel().astype(float)
    usual = np.median(load)
    over = (load - usual) / (8 * np.sqrt(usual) + 8)
    return np.where(over > 1, np.ceil(np.log2(np.maximum(over, 1))) + 1, 0).astype(np.int8)


def _slot(name: str) -> str:
    """SQL of the bit of a 64-bit id in the filters of FILTER_BITS bits."""
    return f"pmod(xxhash64({name}), {FILTER_BITS})"


def _filter_words(ids: DataFrame, name: str) -> DataFrame:
    """(w, m): the words, of 64 bits each, of a bit filter over the ids; at most FILTER_BITS / 64 rows."""
    slots = ids.select(F.expr(f"cast(shiftright({_slot(name)}, 6) as int)").alias("w"), F.expr(f"shiftleft(1L, cast({_slot(name)} % 64 as int))").alias("m"))
    return slots.groupBy("w").agg(F.bit_or("m").alias("m"))


def _arrays(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Durable (node, s): sorted shingle arrays of the ``wanted`` (node, rep).

    A bit filter of fixed size over the wanted doc_ids keeps the other texts out
    of the hashing; it may let some through and the join then drops them.
    """
    spark = docs.sparkSession
    got = _filter_words(wanted, "rep").toArrow()  # at most 2^20 words
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[got["w"].to_numpy()] = got["m"].to_numpy()
    shared = spark.sparkContext.broadcast(table.view(np.uint64))

    def arrays(batches):
        import pyarrow as pa

        bits = shared.value
        for batch in batches:
            slots = batch.column("slot").to_numpy(zero_copy_only=False)
            keep = (bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1
            if not keep.any():
                continue
            part = batch.filter(pa.array(keep))
            for piece, i, j, data, offsets in textcore.text_pieces([part]):
                sets = textcore.shingle_sets(*textcore.words(data, offsets))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").slice(i, j - i), pa.array([_digest(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "made", "s"])

    texts = docs.where("doc_id is not null").select("doc_id", "text", F.expr(_slot("doc_id")).alias("slot"))
    made = texts.mapInArrow(arrays, "doc_id long, made long, s binary")
    # rep is the least doc_id of its node, so "at most rep" means rep; an equality would become a join key, and the
    # rows then lie by both keys and move once more to drop the repeated ones
    met = made.join(wanted, made.made == wanted.node).where("doc_id <= rep").select("node", "s")
    return durable(met.dropDuplicates(["node"]), "jaccard-arrays")


def _asked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Durable: the ``rows`` whose node a pair names, and few others, so that joins with few pairs do not move all rows.

    A bit filter of fixed size picks them where they lie; the joins that follow drop those it lets through.
    ``pairs`` must be stored.
    """
    words = _filter_words(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node")  # at most 2^20 rows of 12 bytes
    met = rows.join(F.broadcast(words), F.expr(f"cast(shiftright({_slot('node')}, 6) as int)") == F.col("w"))
    return durable(met.where(F.expr(f"getbit(m, cast({_slot('node')} % 64 as int)) = 1")).select(*rows.columns), "jaccard-asked")


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Durable pairs (a, b) whose bitmaps allow the threshold."""

    def bound(batches):
        import pyarrow as pa

        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            differ = np.zeros(batch.num_rows, np.int64)
            for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                w = min(len(x), len(y))
                differ[k] = np.bitwise_count(_fold(x, w) ^ _fold(y, w)).sum()
            part = batch.filter(pa.array((na + nb - differ) // 2 >= need(na, nb)))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"])

    pairs = durable(pairs, "jaccard-named")
    some = _asked(pairs, nodes.select("node", "n", "bitmap"))
    left = some.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("x"))
    right = some.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("y"))
    out = durable(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(bound, "a long, b long"), "jaccard-possible")
    release(pairs, some)
    return out


def _decide(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Durable pairs that reach the threshold, by intersecting the sorted shingle arrays; ``pairs`` must be stored."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                keep[k] = np.count_nonzero(both[1:] == both[:-1]) >= need(len(x), len(y))
            part = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"])

    some = _asked(pairs, sets)
    left = some.select(F.col("node").alias("a"), F.col("s").alias("x"))
    right = some.select(F.col("node").alias("b"), F.col("s").alias("y"))
    out = durable(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "jaccard-pairs")
    release(some)
    return out


def _compatible(a, b):
    return (a * 100 >= b * PERCENT) & (b * 100 >= a * PERCENT)


def _low_tiles(nodes: DataFrame) -> DataFrame:
    """Durable (t, node, n, place, many): the lowest shingles that more than one node has, numbered by node, rare ones first."""
    low = nodes.select("node", "n", F.explode("low").alias("t"))
    several = low.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    own = Window.partitionBy("node")  # at most PIVOTS rows
    placed = low.join(several, "t").withColumn("place", F.row_number().over(own.orderBy("c", "t")) - 1).withColumn("many", F.count(F.lit(1)).over(own))
    return durable(placed.select("t", "node", "n", "place", "many"), "jaccard-low")


def _pivot_pairs(low: DataFrame, groups: DataFrame | None, turn: int) -> DataFrame:
    """Each node with the pivot of one of its tiles, another one each turn, unless their groups agree."""
    tiles = low.withColumn("g", F.col("node")) if groups is None else low.join(groups, "node", "left").withColumn("g", F.coalesce("component", "node")).drop("component")
    choice = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "g", "node", "n")
    pivot = tiles.groupBy("t").agg(F.min(choice).alias("p"), F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select("t", "p")
    met = tiles.where(F.lit(turn) % F.col("many") == F.col("place")).join(pivot, "t").where((F.col("g") != F.col("p.g")) & _compatible(F.col("n"), F.col("p.n")))
    return met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _postings(docs: DataFrame, classes: np.ndarray, buckets: int) -> DataFrame:
    """Durable rows of prefix shingles that different sets share.

    A tile of at most SMALL nodes gives its pairs (a, b) of compatible size.  Larger
    ones with the same least node (by hash) are merged, as the tiles of one common
    passage are, and give their rows (node, n, t), where t names the merged tile.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(classes)
    row = np.dtype([("t", np.uint64), ("d", np.int64), ("n", np.int32)])

    def emit(batches):
        import pyarrow as pa

        held, size = [], 0

        def flush():
            rows = np.concatenate(held)
            _, at = np.unique(rows[["t", "d"]], return_index=True) if len(rows) < 1 << 12 else (None, np.arange(len(rows)))
            rows = rows[at]
            bucket = (textcore.mix(rows["t"]) % np.uint64(buckets)).astype(np.int64)
            return pa.RecordBatch.from_arrays(_blobs(pa, bucket, rows), names=["bucket", "rows"])

        seen: set[int] = set()
        for batch, i, j, data, offsets in textcore.text_pieces(batches):
            for s in textcore.shingle_sets(*textcore.words(data, offsets)):
                n = len(s)
                if not n:
                    continue
                name = _digest(s)
                if name in seen:  # a copy met in this partition already
                    continue
                if len(seen) < 1 << 20:
                    seen.add(name)
                first = s[_ranks(s, shared.value)[: n - int(-(-PERCENT * n // 100)) + 1]]
                part = np.empty(len(first), row)
                part["t"], part["d"], part["n"] = first, name, n
                held.append(part)
                size += len(first)
            if size >= 1 << 20:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def shared_only(batches):
        import pyarrow as pa

        parts: dict[int, list] = {}
        for batch in batches:
            for b, r in zip(batch.column("bucket").to_pylist(), batch.column("rows").to_pylist()):
                parts.setdefault(b, []).append(r)
        for b in list(parts):
            rows = np.frombuffer(b"".join(parts.pop(b)), row)
            order = np.lexsort((rows["d"], rows["t"]))
            t, d, n = rows["t"][order], rows["d"][order], rows["n"][order]
            first = np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])
            t, d, n = t[first], d[first], n[first]
            same = t[1:] == t[:-1]
            keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            if not keep.any():
                continue
            t, d, n = t[keep], d[keep], n[keep].astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            many = np.diff(np.append(edge, len(t)))
            large = np.repeat(many > SMALL, many)
            pairs = [np.zeros((0, 2), np.int64)]
            for m in range(2, SMALL + 1):
                at = edge[many == m]
                for x in range(m):
                    for y in range(x + 1, m):
                        i, j = at + x, at + y
                        fit = _compatible(n[i], n[j])
                        pairs.append(np.stack([d[i][fit], d[j][fit]], axis=1))
            pairs = np.unique(np.concatenate(pairs), axis=0)
            # large tiles of one passage hold nearly the same nodes: those with the same least node (by hash) are one tile
            least = np.minimum.reduceat(textcore.mix(d.astype(np.uint64)), edge).astype(np.int64)
            t, d, n = np.repeat(least, many)[large], d[large], n[large]
            order = np.lexsort((d, t))
            t, d, n = t[order], d[order], n[order]
            once = np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])[: len(t)]
            t, d, n = t[once], d[once], n[once]
            k, q = len(t), len(pairs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(d), pa.nulls(q, pa.int64())]), pa.concat_arrays([pa.array(n), pa.nulls(q, pa.int64())]),
                    pa.concat_arrays([pa.array(t), pa.nulls(q, pa.int64())]),
                    pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(pairs[:, 0].copy())]), pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(pairs[:, 1].copy())]),
                ],
                names=["node", "n", "t", "a", "b"],
            )

    blobs = docs.select("text").mapInArrow(emit, "bucket int, rows binary").repartition(buckets, "bucket")
    return durable(blobs.mapInArrow(shared_only, "node long, n long, t long, a long, b long"), "jaccard-postings")


def _cells(rows: DataFrame) -> DataFrame:
    """``rows`` (t, node, n, ...) with the cell (t, u, v, i, j) in which a row meets others, and its side.

    A tile of at most TILE_NODES rows is one cell.  A larger one has bands of
    sizes, so wide that compatible sizes lie in one or two neighbouring ones, and
    every band has blocks: each pair of blocks of such bands is a cell.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT + 1e-9))).cast("int")
    large = rows.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > TILE_NODES).select("t")
    plain = rows.join(large, "t", "left_anti").select("*", *[F.lit(0).alias(x) for x in ("u", "v", "i", "j", "side")])
    banded = rows.join(large, "t").withColumn("band", band)
    size = banded.groupBy("t", "band").agg(F.ceil(F.count(F.lit(1)) / TILE_NODES).cast("int").alias("blocks"))
    near = [size.select("t", (F.col("band") - s).alias("band"), F.col("blocks").alias(f"blocks{s + 1}")) for s in (-1, 0, 1)]
    met = banded.join(near[1], ["t", "band"]).join(near[0], ["t", "band"], "left").join(near[2], ["t", "band"], "left")
    met = met.withColumn("b", F.expr("cast(pmod(xxhash64(node), blocks1) as int)"))
    cell = lambda u, v, i, j, side: F.struct(u.alias("u"), v.alias("v"), i.alias("i"), j.alias("j"), side.alias("side"))
    others = lambda blocks: F.when(F.coalesce(F.col(blocks), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(blocks) - 1)).otherwise(F.array().cast("array<int>"))
    here, b = F.col("band"), F.col("b")
    spread = F.concat(
        F.transform(others("blocks1"), lambda o: cell(here, here, F.least(b, o), F.greatest(b, o), F.when(b <= o, 0).otherwise(1))),
        F.transform(others("blocks2"), lambda o: cell(here, here + 1, b, o, F.lit(0))),
        F.transform(others("blocks0"), lambda o: cell(here - 1, here, o, b, F.lit(1))),
    )
    return plain.unionByName(met.withColumn("cell", F.explode(spread)).select(*rows.columns, "cell.*"))


def _tile_pairs(rows: DataFrame, parts: int) -> DataFrame:
    """Pairs of large tiles whose bitmaps allow the threshold.  ``rows``: those of :func:`_cells` with bitmap and tiles.

    ``tiles`` lists the HOMES least tiles of a node.  A pair that meets in several is
    named in the least of them, which both lists hold as soon as they share any;
    without a shared one it is named wherever it meets.
    """

    def tile(t, apart, g, node, n, maps, homes, side):
        """Nodes of different groups, in size bands, smallest groups against all; ``apart``: of different sides only."""
        if len(node) < 2 or (g == g[0]).all() or apart and (side == side[0]).all():
            return None
        _, at, many = np.unique(g, return_inverse=True, return_counts=True)
        order = np.lexsort((n, at, many[at]))
        g, node, n, maps = g[order], node[order], n[order], [maps[k] for k in order]
        homes, side = [homes[k] for k in order], side[order]
        width = np.array([len(m) for m in maps])
        last = int(np.flatnonzero(g != g[-1])[-1])  # from here on all rows are one group
        out = []
        for x in range(0, last + 1, _BLOCK):
            rows_x = np.arange(x, min(x + _BLOCK, last + 1))
            for y in range(x, len(node), _BLOCK):
                rows_y = np.arange(y, min(y + _BLOCK, len(node)))
                nx, ny = n[rows_x][:, None], n[rows_y][None, :]
                ok = (g[rows_x][:, None] != g[rows_y][None, :]) & _compatible(nx, ny) & (rows_x[:, None] < rows_y[None, :])
                if apart:
                    ok &= side[rows_x][:, None] != side[rows_y][None, :]
                a, b = np.nonzero(ok)
                if not len(a):
                    continue
                a, b = rows_x[a], rows_y[b]
                w = np.minimum(width[a], width[b])
                for one in np.unique(w):
                    pick = np.flatnonzero(w == one)
                    folded = {k: _fold(maps[k], int(one)) for k in np.unique(np.concatenate([a[pick], b[pick]]))}
                    names = np.array(list(folded))
                    table = np.stack(list(folded.values()))
                    step = max(1, (1 << 20) // int(one))
                    for z in range(0, len(pick), step):
                        p = pick[z : z + step]
                        differ = np.bitwise_count(table[np.searchsorted(names, a[p])] ^ table[np.searchsorted(names, b[p])]).sum(axis=1, dtype=np.int64)
                        both = n[a[p]] + n[b[p]]
                        can = (both - differ) // 2 >= need(n[a[p]], n[b[p]])
                        i, j = a[p][can], b[p][can]
                        here = np.fromiter((min(homes[x] & homes[y], default=t) == t for x, y in zip(i.tolist(), j.tolist())), bool, len(i))
                        out.append(np.stack([node[i[here]], node[j[here]]], axis=1))
        return np.concatenate(out) if out else None

    def run(batches):
        import pyarrow as pa

        key, held = None, []

        def done():
            if len(held) < 2:
                return None
            g, node, n, side = (np.array([h[k] for h in held]) for k in (0, 1, 2, 5))
            pairs = tile(key[0], key[1] != key[2] or key[3] != key[4], g, node, n, [np.frombuffer(h[3], np.uint64) for h in held], [set(h[4]) for h in held], side)
            if pairs is None or not len(pairs):
                return None
            return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("t", "u", "v", "i", "j", "g", "node", "n", "bitmap", "tiles", "side")]
            for t, u, v, i, j, *rest in zip(*columns):
                if (t, u, v, i, j) != key:
                    if (out := done()) is not None:
                        yield out
                    key, held = (t, u, v, i, j), []
                held.append(rest)
        if (out := done()) is not None:
            yield out

    cell = ["t", "u", "v", "i", "j"]
    return rows.repartition(parts, *cell).sortWithinPartitions(*cell, "n").mapInArrow(run, "a long, b long").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection size of every set of ``left`` with every one of ``right``.

    Shingles that few sets hold are counted pair by pair, the others by products of 0/1 matrices.
    """
    k, m = len(left), len(right)
    size = [len(s) for s in left + right]
    s, r = np.concatenate(left + right), np.repeat(np.arange(k + m), size)
    order = np.argsort(s, kind="stable")  # rows stay in order inside a shingle
    s, r = s[order], r[order]
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    many = np.diff(np.append(edge, len(s)))
    count = np.repeat(many, many)
    out = np.zeros(k * m, np.int64)
    rare = (count > 1) & (count <= _RARE)
    t, row = s[rare], r[rare]
    for step in range(1, min(_RARE, len(t))):
        same = np.flatnonzero(t[step:] == t[:-step])
        if not len(same):
            break
        a, b = row[same], row[same + step]
        cross = (a < k) & (b >= k)
        out += np.bincount(a[cross] * m + b[cross] - k, minlength=k * m)
    out = out.reshape(k, m)
    row, column = r[count > _RARE], np.repeat(np.arange(len(many)), many)[count > _RARE]
    if len(row):
        column = np.unique(column, return_inverse=True)[1]
        for first in range(0, int(column[-1]) + 1, 4096):
            a, b = np.searchsorted(column, (first, first + 4096))
            x = np.zeros((k + m, 4096), np.float32)
            x[row[a:b], column[a:b] - first] = 1
            out += np.rint(x[:k] @ x[k:].T).astype(np.int64)
    return out


def _count_links(members: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """(node, linked): documents of all other nodes linked with a node.  ``members``: node, component, copies, n."""

    def count(batches):
        import pyarrow as pa

        key, held = None, []

        def done():
            own = [h for h in held if h[0] == key[1]]
            other = own if key[1] == key[2] else [h for h in held if h[0] == key[2]]
            if not own or not other:
                return None
            x, y = ([np.frombuffer(h[3], np.uint64) for h in side] for side in (own, other))
            n, m = np.array([len(s) for s in x]), np.array([len(s) for s in y])
            link = overlaps(x, y) >= need(n[:, None], m[None, :])
            if own is other:
                np.fill_diagonal(link, False)
            sides = [(own, link @ np.array([h[2] for h in other]))] + ([] if own is other else [(other, link.T @ np.array([h[2] for h in own]))])
            return pa.RecordBatch.from_arrays([pa.array([h[1] for side, _ in sides for h in side], pa.int64()), pa.array(np.concatenate([c for _, c in sides]), pa.int64())], names=["node", "linked"])

        for batch in batches:
            for c, i, j, *rest in zip(*[batch.column(c).to_pylist() for c in ("component", "i", "j", "block", "node", "copies", "s")]):
                if (c, i, j) != key:
                    if key is not None and (out := done()) is not None:
                        yield out
                    key, held = (c, i, j), []
                held.append(rest)
            textcore.tidy()
        if key is not None and (out := done()) is not None:
            yield out

    size = members.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(size, "component").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    spread = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "copies")
    rows = spread.join(sets, "node").select("component", "i", "j", "block", "node", "copies", "s")
    tiles = rows.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return tiles.mapInArrow(count, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def _same_document(rows: DataFrame) -> DataFrame:
    """(a, b): nodes that rows of one doc_id hold."""
    several = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    return rows.join(several, "doc_id").where("node > a").select("a", F.col("node").alias("b")).distinct()


def link_documents(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and, if asked for, n_links (documents linked with it)."""
    parts = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scan = _scan(docs)
    rows = scan.where("part is null").select("doc_id", "n", "node", "low", "bitmap")
    full = rows.where("n > 0 and doc_id is not null")
    nodes = durable(full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("copies"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("bitmap").alias("bitmap")), "jaccard-nodes")
    classes = _classes(scan)
    low = _low_tiles(nodes)
    sets = _arrays(docs, durable(low.select("node").distinct().join(nodes.select("node", "rep"), "node"), "jaccard-wanted"))
    total, links = nodes.count(), durable(_same_document(full.select("doc_id", "node")), "jaccard-pairs")
    groups = None
    for turn in range(ROUNDS):
        possible = _possible(_pivot_pairs(low, groups, turn), nodes)
        found = _decide(possible, sets)
        release(possible)
        links = links.unionByName(found)
        groups = components(links)
        settle(docs.sparkSession)
        if found.count() * 2000 <= total:
            break
    groups = components(links) if groups is None else groups
    kept = durable(sets.join(groups.select("node"), "node", "left_semi"), "jaccard-arrays")  # arrays of the others are made again if a tile asks for them
    release(low, sets)
    settle(docs.sparkSession)
    postings = _postings(docs, classes, parts)
    settle(docs.sparkSession)
    named = postings.where("node is not null").select("node", "n", "t").distinct().join(groups, "node", "left").select("node", "n", "t", F.coalesce("component", "node").alias("g"))
    mixed = named.groupBy("t").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select("t")
    large = durable(named.join(mixed, "t").select("t", "g", "node", "n"), "jaccard-tiles")
    homes = large.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("t")), 1, HOMES).alias("tiles"))
    cells = _cells(large).join(homes, "node").join(nodes.select("node", "bitmap"), "node")
    ga, gb = (groups.select(F.col("node").alias(x), F.col("component").alias(f"g{x}")) for x in ("a", "b"))
    small = postings.where("a is not null").select("a", "b").distinct().join(ga, "a", "left").join(gb, "b", "left")
    small = _possible(small.where(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("a", "b"), nodes)
    pairs = durable(small.unionByName(_tile_pairs(cells, parts)).distinct(), "jaccard-candidates")
    release(small, postings, large)
    settle(docs.sparkSession)
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    new = durable(asked.join(kept.select("node"), "node", "left_anti").join(nodes.select("node", "rep"), "node"), "jaccard-wanted")
    made = _arrays(docs, new)
    links = links.unionByName(_decide(pairs, kept.unionByName(made)))
    comp = components(links)
    settle(docs.sparkSession)
    joined, more = nodes.select("node", "rep", "copies"), []
    if count_links:
        members = comp.join(nodes.select("node", "copies", "n"), "node")
        linked = durable(_count_links(members, kept.unionByName(made), parts), "jaccard-linked")
        joined = joined.join(linked, "node", "left").withColumn("n_links", F.coalesce("linked", F.lit(0)) + F.col("copies") - 1)
        more = ["n_links"]
    release(kept, made)
    settle(docs.sparkSession)
    joined = joined.join(comp, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"), *more)
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = joined.join(least, "component").select("node", "component_id", *more)
    own = full.select("doc_id", "n", "node").join(of_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", *more)
    rest = rows.where("not (n > 0 and doc_id is not null)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *[F.lit(0).cast("long").alias(x) for x in more])
    out = durable(own.unionByName(rest), "jaccard-result")
    release(scan, nodes, pairs, *([linked] if count_links else []))
    return out
