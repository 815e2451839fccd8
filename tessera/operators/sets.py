"""Sets of values. NaN is one value, and 0 and -0 are one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.order import ranked
from ..plans.tensor import Tensor


def _values(t: Tensor):
    return t.df.groupBy("v").agg(F.lit(1).alias("x")).select("v")


def _sorted(df) -> Tensor:
    out = ranked(df, ["v"])
    return Tensor(out.df.select((F.col("rank") - 1).alias("i0"), "v"), (out.count,))


def union1d(a: Tensor, b: Tensor) -> Tensor:
    """Distinct values of either, ascending."""
    return _sorted(a.df.select("v").unionByName(b.df.select("v")).groupBy("v").agg(F.lit(1).alias("x")).select("v"))


def intersect1d(a: Tensor, b: Tensor) -> Tensor:
    return _sorted(_values(a).join(_values(b), "v", "left_semi"))


def setdiff1d(a: Tensor, b: Tensor) -> Tensor:
    return _sorted(_values(a).join(_values(b), "v", "left_anti"))


def isin(t: Tensor, test: Tensor) -> Tensor:
    """1 where an element is among the test values. A join on the value: both sides may be large."""
    found = t.df.join(_values(test).withColumn("hit", F.lit(1.0)), "v", "left")
    return Tensor(found.select(*t.index, F.coalesce("hit", F.lit(0.0)).alias("v")), t.shape)
