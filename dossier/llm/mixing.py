"""Mixing sources to target weights by subset-sum budget fitting.

Every source takes its documents a whole number of times and then a subset
whose word counts sum to the rest of its target.  Documents are counted by exact
length; a proportional share of each length count is taken first, and a bounded
knapsack over the remaining counts fits what is left of the budget, with larger
tables until the budget is met, all of it is covered or a table has ``MOST_TABLE``
words.  Which documents of a length are taken follows from a seeded hash of their
id; rows of one id, source and size are ordered by a hash of all they hold.

Defined results
* size: words ``[^\\x20\\x09-\\x0D]+``; null text: 0
* a null source is a source of its own, last in order
* a document of size 0 fills no budget and is taken as often as its whole source
* an empty table gives an empty table; repeated rows count each
* sources are few: their totals, one row each, are shared out in one task
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.durable import durable, fresh, numbered, row_hash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Budget in words that the first knapsack table covers; larger rests are cut down by whole lengths first.
#: Where it misses the budget, tables of twice the size follow, up to one of MOST_TABLE words or the whole budget.
KNAPSACK_WORDS = 1 << 14
#: Largest table: some five bytes a word, and about as much again while it is filled.  A budget above it may be missed
#: by what the remaining lengths cannot sum to within such a table.
MOST_TABLE = 1 << 24
_SPLIT = 256


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target.  ``sizes``: source, size.

    The excess over ``most`` times a source's size is shared again by weight;
    the capped sources are those with the smallest size per weight, so running
    sums in that order give the fixed point at once.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy((F.col("cap") / F.col("w")), F.col("rank"))
    everything = Window.partitionBy()
    t = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    t = t.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("source_size").over(everything) * float(share)).withColumn("weights", F.sum("w").over(everything))
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    t = t.withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("rank")))).over(everything)
    t = t.withColumn("fill", level)
    return t.select("source", "source_size", F.coalesce(F.least("cap", F.col("fill") * F.col("w")), F.col("cap")).alias("target"))


def fit_counts(lengths: list[int], counts: list[int], budget: int, order: list[int], table: int = KNAPSACK_WORDS) -> list[int]:
    """How many documents of each length sum to ``budget`` as nearly as can be from below.

    ``order`` lists indexes in the seeded order in which lengths are tried.
    """
    total = sum(a * b for a, b in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    unit = math.gcd(*lengths)
    lengths, budget, total = [a // unit for a in lengths], max(budget, 0) // unit, total // unit
    best, most = [], -1
    while True:
        take = _fit(lengths, counts, budget, total, order, table)
        have = sum(a * b for a, b in zip(lengths, take))
        if have > most:
            best, most = take, have
        if table >= min(budget, MOST_TABLE) or have == budget:
            return best
        table *= 2


def _fit(lengths: list[int], counts: list[int], budget: int, total: int, order: list[int], table: int) -> list[int]:
    """The fit of one table; the best one where the table covers the budget."""
    if budget <= table:
        return _cover(lengths, counts, budget, order)
    take = [c * budget // total for c in counts]
    rest = budget - sum(a * b for a, b in zip(lengths, take))
    for i in order:
        if rest <= table:
            break
        n = min(counts[i] - take[i], (rest - table // 2) // lengths[i])
        if n > 0:
            take[i] += n
            rest -= n * lengths[i]
    more = _cover(lengths, [c - n for c, n in zip(counts, take)], min(rest, table), order)
    return [a + b for a, b in zip(take, more)]


def _cover(lengths: list[int], counts: list[int], left: int, order: list[int]) -> list[int]:
    """The counts of the largest reachable sum up to ``left``; each sum remembers the part that reached it first."""
    take, parts = [0] * len(lengths), []
    reach, via = np.zeros(left + 1, bool), np.zeros(left + 1, np.int32)
    reach[0] = True
    for i in order:
        room = min(counts[i], left // lengths[i])
        part = 1
        while room > 0 and not reach[left]:
            n = min(part, room)
            x = n * lengths[i]
            new = np.flatnonzero(reach[: left + 1 - x] & ~reach[x:]) + x
            reach[new], via[new] = True, len(parts)
            parts.append((i, n))
            room -= n
            part *= 2
        if reach[left]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, n = parts[via[at]]
        take[i] += n
        at -= n * lengths[i]
    return take


def mix_sources(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, times (copies taken), taken (words)."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    none = F.lit(0).cast("long")
    return _plan(docs.select("doc_id", "source", size.alias("size"), none.alias("row"), none.alias("tie")), seed).drop("row")


def _plan(sizes: DataFrame, seed: int) -> DataFrame:
    """The mix of ``sizes`` (doc_id, source, size, row, tie); ``row`` passes through, ``tie`` orders rows alike in the rest."""
    sized = durable(sizes, "mix-sizes")
    targets = source_targets(sized)
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    plan = counts.join(t, counts.source.eqNullSafe(t.s)).drop("s")

    def fit(pdf):
        import hashlib

        target, have = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
        whole = int(target // have) if have else 0
        part = pdf[pdf["size"] > 0].sort_values("size")
        lengths, n = [int(x) for x in part["size"]], [int(x) for x in part["n"]]
        key = {i: hashlib.sha256(f"{seed}:{x}".encode()).digest() for i, x in enumerate(lengths)}
        more = fit_counts(lengths, n, round(target - whole * have), sorted(key, key=lambda i: (-lengths[i].bit_length(), key[i])))
        out = pdf[["source", "size", "n", "source_size", "target"]].copy()
        out["whole"] = whole
        extra = dict(zip(lengths, more))
        out["more"] = [extra.get(int(x), 0) for x in out["size"]]
        return out

    fitted = plan.groupBy("source").applyInPandas(fit, "source string, size long, n long, source_size long, target double, whole int, more long")
    slot = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(_SPLIT))
    rows = sized.withColumn("order", F.xxhash64("doc_id", F.lit(seed + 1))).withColumn("slot", slot)
    upto = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = rows.groupBy("source", "size", "slot").agg(F.count(F.lit(1)).alias("here")).withColumn("before", F.coalesce(F.sum("here").over(upto), F.lit(0)))
    f = fitted.select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "whole", "more")
    cut = slots.join(f, slots.source.eqNullSafe(f.s) & (slots["size"] == f.z)).select(
        "s", "z", F.col("slot").alias("sl"), "source_size", "target", "whole",
        F.greatest(F.lit(0), F.least(F.col("here"), F.col("more") - F.col("before"))).alias("quota"), "here",
    )
    met = rows.join(cut, rows.source.eqNullSafe(cut.s) & (rows["size"] == cut.z) & (rows.slot == cut.sl)).drop("s", "z", "sl")
    sure = met.where((F.col("quota") == 0) | (F.col("quota") == F.col("here"))).withColumn("extra", (F.col("quota") > 0).cast("int"))
    among = Window.partitionBy("source", "size", "slot").orderBy("order", "doc_id", "tie", "row")
    torn = met.where((F.col("quota") > 0) & (F.col("quota") < F.col("here"))).withColumn("extra", (F.row_number().over(among) <= F.col("quota")).cast("int"))
    times = F.col("whole") + F.col("extra")
    return sure.unionByName(torn).select("row", "doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it; extra columns stay."""
    placed, row = numbered(docs, "mix-rows")
    times, copy = fresh(placed, "times", "copy")
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    plan = _plan(placed.select("doc_id", "source", size.alias("size"), F.col(row).alias("row"), row_hash(docs).alias("tie")), seed)
    taken = plan.where("times > 0").select(F.col("row").alias(row), F.col("times").alias(times))
    return placed.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
