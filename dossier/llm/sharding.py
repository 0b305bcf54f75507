"""Sharding by extendible hashing, native DataFrame code only.

A document's 60-bit key is the head of an MD5 digest.  A directory maps hash
prefixes to shards: only a bucket over the byte limit splits on another bit.
One grouped pass over the documents sums bytes per cell (a prefix of ``step``
bits); every shorter prefix is summed from the cells, so all splits of a round
come from one small table.  Cells that stay too large go on to the next
``step`` bits.

Defined results
* null text: 0 bytes; null id: hashed as the empty string
* equal ids hash alike; rows of one bucket that the key cannot part get a next
  key from a hash of all their columns, and equal rows one from a written row number
* a single document above the limit gets a shard of its own
* an empty table gives an empty table; extra columns stay, whatever their names, but for the five that are returned
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.durable import durable, fresh, numbered

KEY_BITS = 60


def _key(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def _directory(cells: DataFrame, base: int, step: int, limit: int) -> DataFrame:
    """One row per cell (a prefix of base+step bits): its leaf and whether that fits.

    The leaf is the cell's shortest prefix within the limit, or the cell itself.
    """
    levels = F.explode(F.sequence(F.lit(base), F.lit(base + step)))
    spread = cells.select("lead", "cell", "bytes", "n", levels.alias("depth")).withColumn(
        "prefix", F.expr(f"shiftrightunsigned(cell, {base + step} - depth)")
    )
    sums = spread.groupBy("lead", "depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    within = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
    fit = sums.where(within | (F.col("depth") == base + step))
    best = spread.select("lead", "cell", "depth", "prefix").join(fit, ["lead", "depth", "prefix"]).groupBy("lead", "cell").agg(
        F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("b")
    )
    return best.select(
        "lead", "cell", "b.depth", "b.prefix", "b.shard_bytes", "b.shard_rows",
        ((F.col("b.shard_bytes") <= limit) | (F.col("b.shard_rows") == 1)).alias("fits"),
    )


def assign_shards(docs: DataFrame, limit: int = 1 << 20, step: int = 15) -> DataFrame:
    """``docs`` (doc_id, text, ...) plus n_bytes, shard_id, shard_depth, shard_bytes, shard_rows.

    ``shard_id`` is the shard's hash prefix in binary digits ("" when all
    documents fit one shard).  A round's directory table has at most 2^step rows
    for every bucket that it splits, and only buckets over the limit go on.
    """
    own = [c for c in docs.columns if c not in ("n_bytes", "shard_id", "shard_depth", "shard_bytes", "shard_rows")]
    key, lead, cell, depth, prefix, fits, size, rows_in = fresh(docs, "key", "lead", "cell", "depth", "prefix", "fits", "bytes_in", "rows_in")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select(*own, n_bytes.alias("n_bytes"), _key(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(key), F.lit("").alias(lead))
    out, base, exhausted = None, 0, 0
    while True:
        bits = base + step
        of_row = F.shiftrightunsigned(key, KEY_BITS - bits)
        cells = rows.groupBy(F.col(lead).alias("lead"), of_row.alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        table = durable(_directory(cells, base, step, limit), "shard-directory")
        named = table.toDF(lead, cell, depth, prefix, size, rows_in, fits)
        joined = rows.withColumn(cell, of_row).join(named, [lead, cell])
        digits = F.when(F.col(depth) == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), F.col(depth), F.lit("0")))
        part = joined.where(F.col(fits)).select(
            *own, "n_bytes", F.concat(lead, digits).alias("shard_id"), (F.length(lead) + F.col(depth)).cast("int").alias("shard_depth"),
            F.col(size).alias("shard_bytes"), F.col(rows_in).alias("shard_rows"),
        )
        out = part if out is None else out.unionByName(part)
        if table.where("not fits").isEmpty():
            return out
        left = joined.where(~F.col(fits)).select(*own, "n_bytes", key, lead)
        if bits < KEY_BITS:
            rows, base = left, bits
            continue
        # The key is used up: equal ids.  Their columns, then their row numbers, give the next key.
        further, number = numbered(left, "shard-equals")
        told = F.xxhash64(*own) if not exhausted else F.col(number)
        spelled = F.concat_ws(":", F.col(key).cast("string"), told.cast("string"), F.lit(str(exhausted)))
        rows = further.select(*own, "n_bytes", F.concat(lead, F.lpad(F.bin(key), KEY_BITS, F.lit("0"))).alias(lead), _key(spelled).alias(key))
        base, exhausted = 0, exhausted + 1
