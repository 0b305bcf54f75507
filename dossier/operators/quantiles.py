"""Exact quantiles of large groups by distributed selection.

``percentile`` and ``median`` hold every distinct value of a group in one buffer.
Here a group of at most ``SMALL`` values is sorted in its row.  In a larger one each
wanted rank keeps an open interval that its value lies in: a sketch of fixed size
proposes two bounds around the rank, one pass counts the values below, at, between
and above them, and the rank moves to the part that holds it.  The counts decide,
so the result is exact whatever the sketch says; the sketch only makes the part
small.  A rank is found when its part is one value or has at most ``SMALL`` values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.sources.stored import release, stored

SMALL = 100_000
GRID = 256
ACCURACY = 8 * GRID


def rank_of(kind: str | float, n: Column) -> list[Column]:
    """The ranks (from 1) that a figure over ``n`` values needs: "median", or a share for the nearest rank above it."""
    if kind == "median":
        return [F.floor((n + 1) / 2), F.floor(n / 2) + 1]
    # as a fraction of integers: 0.95 * 20 is 19 and not a little more
    share = round(float(kind) * 10_000)
    return [F.greatest(F.floor((n * share + 9_999) / 10_000), F.lit(1))]


def _on(by: list[str], left: str = "l", right: str = "r") -> Column:
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return on


def _inside(values: DataFrame, live: DataFrame, by: list[str], *more: str) -> DataFrame:
    """by, rank and x of the values in the open interval of each rank that is looked for."""
    low = F.col("r.lo").isNull() | (F.col("l.x") > F.col("r.lo"))
    high = F.col("r.hi").isNull() | (F.col("l.x") < F.col("r.hi"))
    met = values.alias("l").join(live.alias("r"), _on(by) & low & high)
    return met.select(*[F.col(f"r.{c}").alias(c) for c in (*by, "at", "rank", "lo", "hi", *more)], F.col("l.x").alias("x"))


def _narrowed(values: DataFrame, live: DataFrame, by: list[str]) -> DataFrame:
    """``live`` after one round: by, at, rank, n, lo, hi, found."""
    key = [*by, "at", "rank", "n", "lo", "hi"]
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    points = _inside(values, live, by, "n").groupBy(*key).agg(F.percentile_approx("x", grid, F.lit(ACCURACY)).alias("p"))
    below, above = F.floor((F.col("rank") - 1) / F.col("n") * GRID) - 1, F.ceil(F.col("rank") / F.col("n") * GRID) + 1
    bounds = points.select(*key, F.element_at("p", F.greatest(below + 1, F.lit(1)).cast("int")).alias("a"), F.element_at("p", F.least(above + 1, F.lit(GRID + 1)).cast("int")).alias("b"))
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    counted = _inside(values, bounds, by, "n", "a", "b").groupBy(*key, "a", "b").agg(
        F.count_if(x < a).alias("c0"), F.count_if(x == a).alias("c1"), F.count_if((x > a) & (x < b)).alias("c2"), F.count_if((x == b) & (b > a)).alias("c3"), F.count_if(x > b).alias("c4"))
    r = F.col("rank")
    to = [F.col("c0")]
    for i in range(1, 5):
        to.append(to[-1] + F.col(f"c{i}"))
    part = F.when(r <= to[0], 0).when(r <= to[1], 1).when(r <= to[2], 2).when(r <= to[3], 3).otherwise(4)
    p = counted.withColumn("part", part)
    pick = lambda *x: F.element_at(F.array(*x), F.col("part") + 1)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("double")
    return p.select(
        *by, "at", (r - pick(zero, *to[:4])).cast("long").alias("rank"), pick(*[F.col(f"c{i}") for i in range(5)]).cast("long").alias("n"),
        pick(F.col("lo"), none, a, none, b).alias("lo"), pick(a, none, b, none, F.col("hi")).alias("hi"), pick(none, a, none, b, none).alias("found"))


def values_at(values: DataFrame, by: list[str], ranks: DataFrame) -> DataFrame:
    """by, at, x: the value of each rank of ``ranks`` (by, at, rank, n) among those of ``values`` (by, x), n of them in its group."""
    values = stored(values.select(*by, "x"), "quantile-values")
    none = F.lit(None).cast("double")
    live = stored(ranks.select(*by, "at", F.col("rank").cast("long").alias("rank"), F.col("n").cast("long").alias("n"), none.alias("lo"), none.alias("hi"), none.alias("found")), "quantile-ranks")
    done = [live.where(F.col("n") <= SMALL)]
    large = live.where(F.col("n") > SMALL)
    while not large.isEmpty():
        live = stored(_narrowed(values, large, by), "quantile-ranks")
        done.append(live.where(F.col("found").isNotNull() | (F.col("n") <= SMALL)))
        large = live.where(F.col("found").isNull() & (F.col("n") > SMALL))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    last = _inside(values, every.where("found is null"), by).groupBy(*by, "at", "rank").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # at most SMALL each
    out = last.select(*by, "at", F.element_at("xs", F.col("rank").cast("int")).alias("x")).unionByName(every.where("found is not null").select(*by, "at", F.col("found").alias("x")))
    out = stored(out, "quantile-found")
    release(values)
    return out


def exact_quantiles(df: DataFrame, by: list[str], column: Column, wanted: dict[str, str | float]) -> DataFrame:
    """by and one column for each entry of ``wanted``: "median" or a share, whose nearest rank from above is taken.

    Null values are left out; a group without others has no row.
    """
    values = df.select(*by, column.cast("double").alias("x")).where("x is not null")
    values = stored(values, "quantile-input")
    n = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    asked = [(f"{name}:{i}", rank) for name, kind in wanted.items() for i, rank in enumerate(rank_of(kind, F.col("n")))]
    ranks = n.select(*by, "n", F.explode(F.array(*[F.struct(F.lit(name).alias("at"), rank.cast("long").alias("rank")) for name, rank in asked])).alias("a")).select(*by, "n", "a.at", "a.rank")
    got = values_at(values, by, ranks).groupBy(*by)
    at = lambda name: F.max(F.when(F.col("at") == name, F.col("x")))
    out = got.agg(*[((at(f"{name}:0") + at(f"{name}:1")) / 2 if kind == "median" else at(f"{name}:0")).alias(name) for name, kind in wanted.items()])
    out = stored(out, "quantiles")
    release(values)
    return out


def with_quantiles(figures: DataFrame, df: DataFrame, by: list[str], column: Column, wanted: dict[str, str | float]) -> DataFrame:
    """``figures`` (one row for each group ``by``) with the quantiles of ``column`` over ``df``."""
    q = exact_quantiles(df, by, column, wanted)
    return figures.alias("l").join(q.alias("r"), _on(by), "left").select("l.*", *[F.col(f"r.{name}").alias(name) for name in wanted])
