"""Aggregates over columns with IEEE semantics: NaN propagates unless the name says otherwise, and no rows give the identity.

Each takes a double column and is an aggregate expression, for groupBy().agg() or agg().
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elementwise import INF, NAN, ColumnLike, num


def _some_nan(x: Column) -> Column:
    return F.coalesce(F.bool_or(F.isnan(x)), F.lit(False))


def _known(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def sum(x: ColumnLike) -> Column:
    return F.coalesce(F.sum(num(x)), F.lit(0.0))


def prod(x: ColumnLike) -> Column:
    return F.coalesce(F.product(num(x)), F.lit(1.0))


def mean(x: ColumnLike) -> Column:
    return F.coalesce(F.avg(num(x)), F.lit(NAN))


def average(x: ColumnLike, weight: ColumnLike | None = None) -> Column:
    if weight is None:
        return mean(x)
    top, w = F.sum(num(x) * num(weight)), F.sum(num(weight))
    return F.coalesce(F.when(w != 0, F.try_divide(top, w)).otherwise(F.when(top == 0, NAN).otherwise(F.signum(top) * INF)), F.lit(NAN))


def _ddof(pop: Column, n: Column, ddof: float) -> Column:
    if ddof == 0:
        return F.coalesce(pop, F.lit(NAN))
    left = n - ddof
    return F.coalesce(F.when(left > 0, pop * n / F.when(left > 0, left).otherwise(1)).when(left == 0, F.when(pop > 0, INF).otherwise(NAN)).otherwise(NAN), F.lit(NAN))


def var(x: ColumnLike, ddof: float = 0) -> Column:
    return _ddof(F.var_pop(num(x)), F.count(num(x)), ddof)


def std(x: ColumnLike, ddof: float = 0) -> Column:
    return F.sqrt(var(x, ddof))


def min(x: ColumnLike) -> Column:
    """Null without rows."""
    return F.when(_some_nan(num(x)), NAN).otherwise(F.min(num(x)))


def max(x: ColumnLike) -> Column:
    return F.max(num(x))


def ptp(x: ColumnLike) -> Column:
    return max(x) - min(x)


def _arg(best, at: ColumnLike, x: Column, order: Column) -> Column:
    return best(at if isinstance(at, Column) else F.col(at), order)


def argmin(x: ColumnLike, at: str) -> Column:
    """``at`` of the first least; a NaN is passed over, but for one in the first place, which nothing is less than."""
    x, at_ = num(x), F.col(at)
    first_nan = F.isnan(F.min_by(x, at_))
    return F.when(first_nan, F.min(at_)).otherwise(F.min_by(at_, F.when(~F.isnan(x), F.struct(x.alias("v"), at_.alias("i")))))


def argmax(x: ColumnLike, at: str) -> Column:
    x, at_ = num(x), F.col(at)
    first_nan = F.isnan(F.min_by(x, at_))
    return F.when(first_nan, F.min(at_)).otherwise(F.max_by(at_, F.when(~F.isnan(x), F.struct(x.alias("v"), (-at_).alias("i")))))


def all(x: ColumnLike) -> Column:
    return F.coalesce(F.bool_and(num(x) != 0), F.lit(True))


def any(x: ColumnLike) -> Column:
    return F.coalesce(F.bool_or(num(x) != 0), F.lit(False))


def countNonzero(x: ColumnLike) -> Column:
    return F.count_if(num(x) != 0)


def nansum(x: ColumnLike) -> Column:
    return F.coalesce(F.sum(_known(num(x))), F.lit(0.0))


def nanprod(x: ColumnLike) -> Column:
    return F.coalesce(F.product(_known(num(x))), F.lit(1.0))


def nanmean(x: ColumnLike) -> Column:
    return F.coalesce(F.avg(_known(num(x))), F.lit(NAN))


def nanvar(x: ColumnLike, ddof: float = 0) -> Column:
    """NaN for no more than ``ddof`` values."""
    known = _known(num(x))
    return F.when(F.count(known) > ddof, _ddof(F.var_pop(known), F.count(known), ddof)).otherwise(NAN)


def nanstd(x: ColumnLike, ddof: float = 0) -> Column:
    return F.sqrt(nanvar(x, ddof))


def nanmin(x: ColumnLike) -> Column:
    return F.coalesce(F.min(_known(num(x))), F.lit(NAN))


def nanmax(x: ColumnLike) -> Column:
    return F.coalesce(F.max(_known(num(x))), F.lit(NAN))


def nanargmin(x: ColumnLike, at: str) -> Column:
    """-1 if all are NaN."""
    x = num(x)
    return F.coalesce(F.min_by(F.col(at), F.when(~F.isnan(x), F.struct(x.alias("v"), F.col(at).alias("i")))), F.lit(-1))


def nanargmax(x: ColumnLike, at: str) -> Column:
    x = num(x)
    return F.coalesce(F.max_by(F.col(at), F.when(~F.isnan(x), F.struct(x.alias("v"), (-F.col(at)).alias("i")))), F.lit(-1))


METHODS = ("linear", "lower", "higher", "midpoint", "nearest")


def _quantile(x: Column, q: float, method: str) -> Column:
    if not 0 <= q <= 1:
        raise ValueError(f"quantile {q} is outside [0, 1]")
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method == "linear":
        return F.coalesce(F.percentile(x, q), F.lit(NAN))
    # Exact counts by value are merged map-side; the values themselves are needed once, in order.
    values = F.array_sort(F.collect_list(x))
    place = (F.size(values) - 1) * F.lit(q)
    low, high = F.floor(place), F.ceil(place)
    at = lambda i: F.get(values, i.cast("int"))
    found = {"lower": at(low), "higher": at(high), "midpoint": (at(low) + at(high)) / 2, "nearest": at(F.when(place - low <= 0.5, low).otherwise(high))}[method]
    return F.coalesce(found, F.lit(NAN))


def quantile(x: ColumnLike, q: float, method: str = "linear") -> Column:
    """By interpolation (linear), or the order statistic below, above, nearest (the lower of equals) or between both.

    Linear keeps counts by value; the others gather a group's values in order. For very large groups Tensor's sort() gives order
    statistics by rank without gathering.
    """
    return _quantile(num(x), q, method)


def percentile(x: ColumnLike, q: float, method: str = "linear") -> Column:
    return quantile(x, q / 100, method)


def median(x: ColumnLike) -> Column:
    return quantile(x, 0.5)


def nanquantile(x: ColumnLike, q: float, method: str = "linear") -> Column:
    return _quantile(_known(num(x)), q, method)


def nanpercentile(x: ColumnLike, q: float, method: str = "linear") -> Column:
    return nanquantile(x, q / 100, method)


def nanmedian(x: ColumnLike) -> Column:
    return nanquantile(x, 0.5)


def cov(x: ColumnLike, y: ColumnLike, ddof: int = 1) -> Column:
    x, y = num(x), num(y)
    n = F.count("*")
    return _ddof(F.covar_pop(x, y), n, ddof)


def corr(x: ColumnLike, y: ColumnLike) -> Column:
    """NaN if either is constant."""
    return F.coalesce(F.corr(num(x), num(y)), F.lit(NAN))


def norm(x: ColumnLike, ord: float | str = 2) -> Column:
    """Of a vector: the 2-norm, sums and extremes of absolute values (1, inf, -inf), or any order."""
    x = F.abs(num(x))
    if ord in (2, "fro"):
        return F.sqrt(sum(x * x))
    if ord == 1:
        return sum(x)
    if ord == INF:
        return F.coalesce(F.max(x), F.lit(0.0))
    if ord == -INF:
        return F.coalesce(min(x), F.lit(0.0))
    if ord == 0:
        return F.count_if(x != 0).cast("double")
    return F.pow(sum(F.pow(x, F.lit(float(ord)))), F.lit(1.0 / ord))


def logsumexp(x: ColumnLike, top: ColumnLike) -> Column:
    """Of values with their maximum in ``top``."""
    return F.first(num(top)) + F.ln(F.sum(F.exp(num(x) - num(top))))
