"""Exact order statistics of groups of any size: histograms narrow down where a rank is, until few values are left there."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from .stage import cut

METHODS = ("linear", "lower", "higher", "midpoint", "nearest")
#: Bins of a histogram, and values among which a rank is looked up directly.
BINS, FEW = 1 << 12, 1 << 16


def _same(a: str, b: str, by: list[str]) -> Column:
    """Equal keys of two aliased tables; null is a key like any other."""
    return fold(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by], F.lit(True))


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """0 to BINS - 1 between the bounds; infinities and NaN, which sorts last, have bins of their own."""
    part = F.when(hi > lo, (v / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS).otherwise(0.0)
    inside = F.least(F.greatest(F.floor(part), F.lit(0)), F.lit(BINS - 1))
    return F.when(F.isnan(v), BINS + 1).when(v == ew.INF, BINS).when(v == -ew.INF, -1).otherwise(inside).cast("int")


def _combined(q: float, method: str, n: Column, low: Column, high: Column) -> Column:
    place = (n - 1) * F.lit(float(q))
    part = place - F.floor(place)
    return {
        "linear": F.when(low == high, low).otherwise(low * (1 - part) + high * part),
        "lower": low,
        "higher": high,
        "midpoint": (low + high) / 2,
        "nearest": F.when(part <= 0.5, low).otherwise(high),
    }[method]


def quantiles(df: DataFrame, by: list[str], value: Column | str, asked: dict[str, tuple[float, str]], skip_nan: bool = False) -> DataFrame:
    """(``by``..., a column for each of ``asked``: name to (q, method)): exact, one row a group; NaN for a group without values.

    A first pass counts a group's values and takes their extremes, a second counts them in BINS bins between those; only rows of the
    bins where asked ranks are go on, until such a bin has FEW values or a single one. Then those are put in order. So no
    group's values meet in one task, whatever their number; what is shuffled are counts, BINS a group and task at most.
    """
    for q, method in asked.values():
        if not 0 <= q <= 1:
            raise ValueError(f"quantile {q} is outside [0, 1]")
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}")
    keys = [f"__g{k}" for k in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], ew.num(value).alias("v"))
    finite = F.when(~F.isnan("v") & (F.abs("v") != ew.INF), F.col("v"))
    known = ~F.isnan("v") if skip_nan else F.lit(True)
    groups = cut(rows.groupBy(*keys).agg(F.count(F.when(known, 1)).alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi")))
    rows = rows.where(known)
    qs = sorted({q for q, _ in asked.values()})
    places = F.array(*[f((F.col("n") - 1) * F.lit(q)).cast("long") for q in qs for f in (F.floor, F.ceil)])
    ranks = cut(groups.where("n > 0").select(*keys, F.explode(F.array_distinct(places)).alias("k")))
    # Where each rank is: between lo and hi, of inside values there, with below ones before.
    counts = rows.alias("r").join(groups.alias("g"), _same("r", "g", keys)).select(*[f"r.{k}" for k in keys], "v", _bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin"))
    bins = cut(counts.groupBy(*keys, "bin").agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    before = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("below", F.coalesce(F.sum("inside").over(before), F.lit(0)))
    within = (F.col("k") >= F.col("below")) & (F.col("k") < F.col("below") + F.col("inside"))
    state = cut(ranks.alias("a").join(bins.alias("b"), _same("a", "b", keys) & within).select(*[f"a.{k}" for k in keys], "k", "lo", "hi", "inside", "below"))
    while not state.where(F.col("inside") > FEW).where("lo < hi").isEmpty():
        wide = (F.col("inside") > FEW) & (F.col("lo") < F.col("hi"))
        both = rows.alias("r").join(state.where(wide).alias("s"), _same("r", "s", keys) & F.col("v").between(F.col("lo"), F.col("hi")))
        counts = both.select(*[f"s.{k}" for k in keys], "k", "v", "below", _bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin"))
        bins = counts.groupBy(*keys, "k", "bin").agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("below").alias("start"))
        before = Window.partitionBy(*keys, "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("below", F.col("start") + F.coalesce(F.sum("inside").over(before), F.lit(0)))
        state = cut(state.where(~wide).unionByName(bins.where(within).select(*state.columns)))
    single = state.where(~(F.col("lo") < F.col("hi")) | F.col("lo").isNull()).select(*keys, "k", F.col("lo").alias("v"))
    few = state.where("lo < hi")
    both = rows.alias("r").join(few.alias("s"), _same("r", "s", keys) & F.col("v").between(F.col("lo"), F.col("hi")))
    tied = both.select(*[f"s.{k}" for k in keys], "k", "below", "v").groupBy(*keys, "k", "below", "v").agg(F.count("*").alias("inside"))
    before = Window.partitionBy(*keys, "k").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("below", F.col("below") + F.coalesce(F.sum("inside").over(before), F.lit(0)))
    found = single.unionByName(tied.where(within).select(*keys, "k", "v"))
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("at"))
    whole = groups.alias("g").join(values.alias("f"), _same("g", "f", keys), "left") if keys else groups.crossJoin(values)
    at = lambda q, f: F.element_at("at", f((F.col("n") - 1) * F.lit(q)).cast("long"))
    out = [F.coalesce(F.when(F.col("n") > 0, _combined(q, method, F.col("n"), at(q, F.floor), at(q, F.ceil))), F.lit(ew.NAN)).alias(name) for name, (q, method) in asked.items()]
    return whole.select(*[F.col(f"g.{k}" if keys else k).alias(c) for c, k in zip(by, keys, strict=True)], *out)
