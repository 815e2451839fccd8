"""Reductions of tensors along an axis or altogether."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import elementwise as ew
from ..plans.quantiles import FEW, quantiles
from ..plans.tensor import Tensor, axis_of, flat_index, scalar
from .algebra import broadcastTo


def along(t: Tensor, f: Callable[[], Column], axis: int | None = None, keepdims: bool = False, empty: float | None = None) -> Tensor:
    """The aggregate ``f()`` over column v (and the index columns): a group for each place of the other axes, added up map-side first."""
    if axis is None:
        df = t.df.withColumn("at", flat_index(t.shape)).agg(f().cast("double").alias("v"))
        out = scalar(df)
        return Tensor(df.select(*[F.lit(0).cast("long").alias(c) for c in t.index], "v"), (1,) * t.ndim) if keepdims else out
    axis = axis_of(axis, t.ndim)
    shape = t.shape[:axis] + t.shape[axis + 1 :]
    if t.shape[axis] == 0 and empty is not None:
        out = Tensor.grid(t.spark, shape, empty)
    elif t.ndim == 1:
        return along(t, f, None, keepdims)
    else:
        groups = t.df.withColumn("at", F.col(f"i{axis}")).groupBy(*t.others(axis)).agg(f().cast("double").alias("v"))
        out = Tensor(groups.select(*[F.col(c).alias(f"i{k}") for k, c in enumerate(t.others(axis))], "v"), shape)
    if not keepdims:
        return out
    index = [F.lit(0) if k == axis else F.col(f"i{k - (k > axis)}") for k in range(t.ndim)]
    return out.reindexed(index, [1 if k == axis else n for k, n in enumerate(t.shape)])


def _reduction(f: Callable[..., Column], empty: float | None, doc: str) -> Callable:
    def op(t: Tensor, axis: int | None = None, keepdims: bool = False, **how) -> Tensor:
        if empty is None and t.size == 0:
            raise ValueError("no elements to reduce")
        return along(t, lambda: f("v", **how), axis, keepdims, empty)

    op.__doc__ = doc
    return op


NAN = ew.NAN
sum = _reduction(agg.sum, 0.0, "0 for no elements.")
prod = product = _reduction(agg.prod, 1.0, "1 for no elements.")
mean = _reduction(agg.mean, NAN, "NaN for no elements.")
var = _reduction(agg.var, NAN, "Of the population unless ddof says otherwise.")
std = _reduction(agg.std, NAN, "Square root of var.")
min = _reduction(agg.min, None, "NaN if any is; no elements are an error.")
max = _reduction(agg.max, None, "NaN if any is; no elements are an error.")
ptp = _reduction(agg.ptp, None, "Greatest less least.")
all = alltrue = _reduction(lambda v: ew.flag(agg.all(v)), 1.0, "1 if no element is 0.")
any = sometrue = _reduction(lambda v: ew.flag(agg.any(v)), 0.0, "1 if some element isn't 0.")
countNonzero = _reduction(agg.countNonzero, 0.0, "NaN counts.")
argmin = _reduction(lambda v: agg.argmin(v, "at"), None, "Place of the first least, along the axis or row-major.")
argmax = _reduction(lambda v: agg.argmax(v, "at"), None, "Place of the first greatest.")
nansum = _reduction(agg.nansum, 0.0, "Without NaN; 0 if nothing is left.")
nanprod = _reduction(agg.nanprod, 1.0, "Without NaN; 1 if nothing is left.")
nanmean = _reduction(agg.nanmean, NAN, "Without NaN; NaN if nothing is left.")
nanvar = _reduction(agg.nanvar, NAN, "Without NaN; NaN if no more than ddof are left.")
nanstd = _reduction(agg.nanstd, NAN, "Square root of nanvar.")
nanmin = _reduction(agg.nanmin, NAN, "Without NaN; NaN if nothing is left.")
nanmax = _reduction(agg.nanmax, NAN, "Without NaN; NaN if nothing is left.")
nanargmin = _reduction(lambda v: agg.nanargmin(v, "at"), -1.0, "-1 if all are NaN.")
nanargmax = _reduction(lambda v: agg.nanargmax(v, "at"), -1.0, "-1 if all are NaN.")
def _selected(t: Tensor, q: float, axis: int | None, keepdims: bool, method: str, skip_nan: bool) -> Tensor:
    """Order statistics: of an aggregate's values up to FEW of them, beyond that by exact selection without gathering any."""
    axis = None if axis is None else axis_of(axis, t.ndim)
    if (t.size if axis is None or t.ndim == 1 else t.shape[axis]) <= FEW:
        return along(t, lambda: (agg.nanquantile if skip_nan else agg.quantile)("v", q, method), axis, keepdims, NAN)
    by = [] if axis is None else t.others(axis)
    found = quantiles(t.df, by, "v", {"v": (q, method)}, skip_nan)
    out = Tensor(found.select(*[F.col(c).alias(f"i{k}") for k, c in enumerate(by)], "v"), [n for k, n in enumerate(t.shape) if f"i{k}" in by])
    if not keepdims:
        return out
    return out.reindexed([F.col(f"i{by.index(c)}") if c in by else F.lit(0) for c in t.index], [n if f"i{k}" in by else 1 for k, n in enumerate(t.shape)])


def median(t: Tensor, axis: int | None = None, keepdims: bool = False) -> Tensor:
    """Midpoint of the middle two."""
    return _selected(t, 0.5, axis, keepdims, "linear", False)


def nanmedian(t: Tensor, axis: int | None = None, keepdims: bool = False) -> Tensor:
    """Without NaN."""
    return _selected(t, 0.5, axis, keepdims, "linear", True)


def quantile(t: Tensor, q: float, axis: int | None = None, keepdims: bool = False, method: str = "linear") -> Tensor:
    return _selected(t, q, axis, keepdims, method, False)


def percentile(t: Tensor, q: float, axis: int | None = None, keepdims: bool = False, method: str = "linear") -> Tensor:
    return quantile(t, q / 100, axis, keepdims, method)


def nanquantile(t: Tensor, q: float, axis: int | None = None, keepdims: bool = False, method: str = "linear") -> Tensor:
    return _selected(t, q, axis, keepdims, method, True)


def nanpercentile(t: Tensor, q: float, axis: int | None = None, keepdims: bool = False, method: str = "linear") -> Tensor:
    return nanquantile(t, q / 100, axis, keepdims, method)


sumAxis, meanAxis, minAxis, maxAxis, argminAxis, argmaxAxis = sum, mean, min, max, argmin, argmax
varAxis, stdAxis, prodAxis, allAxis, anyAxis = var, std, prod, all, any


def average(t: Tensor, weights: Tensor | None = None, axis: int | None = None, keepdims: bool = False) -> Tensor:
    """Weighted by ``weights``, which are broadcast, or along the axis if they are a vector of its size."""
    if weights is None:
        return mean(t, axis, keepdims)
    if weights.ndim == 1 and axis is not None and t.ndim > 1:
        k = axis_of(axis, t.ndim)
        weights = weights.reindexed([F.col("i0") if j == k else F.lit(0) for j in range(t.ndim)], [t.shape[j] if j == k else 1 for j in range(t.ndim)])
    both = t.df.join(broadcastTo(weights, t.shape).df.withColumnRenamed("v", "w"), t.index)
    return along(Tensor(both, t.shape), lambda: agg.average("v", "w"), axis, keepdims, NAN)


def norm(t: Tensor, ord: float | str = 2, axis: int | None = None) -> Tensor:
    """Vector norms of all elements or along an axis; of matrices also 'fro' and 'nuc', and 2 as the greatest singular value."""
    if ord == "nuc" or (ord == 2 and axis is None and t.ndim == 2):
        from .linalg import singular_values

        s = singular_values(t)
        return (sum if ord == "nuc" else max)(s)
    return along(t, lambda: agg.norm("v", ord), axis)


def trace(t: Tensor) -> Tensor:
    """Sum of the main diagonal of a matrix."""
    if t.ndim != 2:
        raise ValueError("trace takes a matrix")
    return scalar(t.df.where("i0 = i1").agg(agg.sum("v").alias("v")))


def checksum(t: Tensor) -> Tensor:
    return sum(t)


def cov(x: Tensor, y: Tensor | None = None, rowvar: bool = True, bias: bool = False, ddof: int | None = None) -> Tensor:
    """Covariances of variables: the rows (columns unless ``rowvar``) of a matrix, or two vectors. A vector alone gives its variance.

    Pairs of variables meet by a join on the observation: centred in a first pass, so no digits cancel.
    """
    if y is not None:
        from .shape import stack

        x = stack([x.vector(), y.vector()])
    elif x.ndim < 2:
        x = x.vector().reindexed([F.lit(0), F.col("i0")], (1, x.size))
    if not rowvar and y is None and x.ndim == 2 and x.shape[0] != 1:
        x = x.reindexed([F.col("i1"), F.col("i0")], x.shape[::-1])
    m, n = x.shape
    means = x.df.groupBy("i0").agg(F.avg("v").alias("m"))
    centred = Tensor(x.df.join(means, "i0").select("i0", "i1", (F.col("v") - F.col("m")).alias("v")), x.shape)
    left = n - (ddof if ddof is not None else 0 if bias else 1)
    from .algebra import matmul

    gram = matmul(centred, centred.reindexed([F.col("i1"), F.col("i0")], (n, m)))
    return gram.map(lambda v: v / float(left) if left > 0 else ew.divide(v, 0.0))


def covOfColumns(df: DataFrame, columns: list[str], ddof: int = 1) -> Tensor:
    """Covariances of columns as a matrix, rows being observations in no order: one aggregation of means, one of products about them.

    Of few columns (their pairs are expressions of one aggregate); matrices with many go to cov().
    """
    means = df.agg(*[F.avg(ew.num(c)).alias(f"m{k}") for k, c in enumerate(columns)])
    m = means.first()
    x = [ew.num(c) - F.lit(NAN if m[k] is None else m[k]) for k, c in enumerate(columns)]
    every = [(i, j) for i, _ in enumerate(columns) for j, _ in enumerate(columns)]
    pairs = [(i, j) for i, j in every if i <= j]
    sums = df.agg(F.count("*").alias("n"), *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs])
    cell = lambda i, j: F.struct(F.lit(i).cast("long").alias("i0"), F.lit(j).cast("long").alias("i1"), ew.divide(F.col("s{}_{}".format(*sorted((i, j)))), F.greatest(F.col("n") - ddof, F.lit(0)).cast("double")).alias("v"))
    return Tensor(sums.select(F.inline(F.array(*[cell(i, j) for i, j in every]))), (len(columns), len(columns)))


def corrOfColumns(df: DataFrame, columns: list[str]) -> Tensor:
    """Correlations of columns as a matrix; NaN for a constant one."""
    return _correlated(covOfColumns(df, columns, 0))


def corrcoef(x: Tensor, y: Tensor | None = None, rowvar: bool = True) -> Tensor:
    """Covariances over standard deviations; NaN for a constant variable."""
    return _correlated(cov(x, y, rowvar, bias=True))


def _correlated(c: Tensor) -> Tensor:
    spread = c.df.where("i0 = i1").select("i0", F.sqrt("v").alias("s"))
    df = c.df.join(spread, "i0").join(spread.select(F.col("i0").alias("i1"), F.col("s").alias("s1")), "i1")
    return Tensor(df.select("i0", "i1", ew.divide(F.col("v"), F.col("s") * F.col("s1")).alias("v")), c.shape)


def trapezoid(y: Tensor, x: Tensor | None = None, dx: float = 1.0) -> Tensor:
    """Integral by trapezoids. Neighbours meet by their index, not in one sorted task."""
    own = y.df.select("i0", "v").unionByName(y.df.select((F.col("i0") - 1).alias("i0"), F.col("v").alias("v")).where("i0 >= 0"))
    height = own.groupBy("i0").agg(F.sum("v").alias("h"), F.count("*").alias("n")).where("n = 2")
    if x is None:
        return scalar(height.agg((agg.sum("h") * float(dx) / 2).alias("v")))
    step = x.df.select("i0", (-F.col("v")).alias("v")).unionByName(x.df.select((F.col("i0") - 1).alias("i0"), "v").where("i0 >= 0")).groupBy("i0").agg(F.sum("v").alias("w"))
    return scalar(height.join(step, "i0").agg((agg.sum(F.col("h") * F.col("w")) / 2).alias("v")))


trapz = trapezoid


def unique(t: Tensor) -> Tensor:
    """Distinct values, ascending, NaN last and once; 0 and -0 are one value."""
    from ..plans.order import ranked

    out = ranked(t.df.groupBy("v").agg(F.lit(1).alias("x")).select("v"), ["v"])
    return Tensor(out.df.select((F.col("rank") - 1).alias("i0"), "v"), (out.count,))


def uniqueTable(t: Tensor):
    """(place, value, index of the first, count) of distinct values in ascending order."""
    from ..plans.order import ranked

    groups = t.flat().groupBy("v").agg(F.min("flat").alias("index"), F.count("*").alias("count"))
    return ranked(groups, ["v"]).df.select((F.col("rank") - 1).alias("place"), F.col("v").alias("value"), "index", "count")


def uniqueCounts(t: Tensor):
    return uniqueTable(t).select("place", "value", "count")


def uniqueInverse(t: Tensor) -> tuple:
    """The distinct values, and for each element the place of its value."""
    table = uniqueTable(t)
    inverse = t.flat().join(table.select(F.col("value").alias("v"), "place"), "v").select(F.col("flat").alias("i0"), F.col("place").cast("double").alias("v"))
    return unique(t), Tensor(inverse, (t.size,))


def bincount(x: Tensor, weights: Tensor | None = None, minlength: int = 0) -> Tensor:
    """How many elements (or how much weight) have each whole part 0, 1, ...; negative ones are an error."""
    df = x.flat()
    if weights is not None:
        df = df.join(weights.flat().withColumnRenamed("v", "w"), "flat")
    bins = df.select(F.floor("v").alias("i0"), (F.col("w") if weights is not None else F.lit(1.0)).alias("w"))
    sums = bins.groupBy("i0").agg(F.sum("w").alias("v"))
    ends = bins.agg(F.min("i0").alias("a"), F.max("i0").alias("b")).first()
    if ends.a is not None and ends.a < 0:
        raise ValueError("negative values can't be counted")
    n = (ends.b + 1) if ends.b is not None else 0
    return Tensor(sums, (n if n > minlength else minlength,)).filled()


def digitize(x: Tensor, bins: Tensor, right: bool = False) -> Tensor:
    """How many ``bins`` are at or below each element (below, if ``right``), for ascending bins; the other way for descending ones."""
    from .ordered import searchsorted

    edges = bins.numpy()
    if len(edges) > 1 and edges[0] > edges[-1]:
        turned = searchsorted(Tensor.of(bins.spark, edges[::-1].copy()), x, "right" if right else "left")
        return turned.map(lambda v: len(edges) - v)
    return searchsorted(bins, x, "left" if right else "right")


STRATEGIES = ("auto", "fd", "sturges", "rice", "sqrt", "scott", "doane")


def _bins(t: Tensor, strategy: str, low: float, high: float) -> int:
    import math

    stats = t.df.where(~F.isnan("v")).agg(F.count("*").alias("n"), F.stddev_pop("v").alias("s"), F.skewness("v").alias("g"), F.percentile("v", 0.25).alias("a"), F.percentile("v", 0.75).alias("b")).first()
    n, width = stats.n, None
    if n == 0 or high == low:
        return 1
    sturges = (high - low) / (math.log2(n) + 1)
    if strategy == "sqrt":
        width = (high - low) / math.sqrt(n)
    elif strategy == "sturges":
        width = sturges
    elif strategy == "rice":
        width = (high - low) / (2 * n ** (1 / 3))
    elif strategy == "scott":
        width = (24 * math.sqrt(math.pi) / n) ** (1 / 3) * stats.s
    elif strategy == "doane":
        spread = math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3))) if n > 2 else 0
        width = (high - low) / (1 + math.log2(n) + math.log2(1 + abs(stats.g or 0) / spread)) if spread else high - low
    elif strategy in ("fd", "auto"):
        fd = 2 * (stats.b - stats.a) / n ** (1 / 3)
        width = fd if strategy == "fd" or not fd else fd if fd < sturges else sturges
        width = width or (sturges if strategy == "auto" else 0)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return math.ceil((high - low) / width) if width else 1


def histogramBinEdges(t: Tensor, bins=10, range=None) -> list[float]:
    """Edges of equal bins between the extremes (or of ``range``); given ones; or as many as a strategy says. All-equal data get a width of 1."""
    if isinstance(bins, (list, tuple)):
        return [float(x) for x in bins]
    if range is None:
        ends = t.df.where(~F.isnan("v")).agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
        low, high = (0.0, 1.0) if ends.a is None else (ends.a, ends.b)
    else:
        low, high = map(float, range)
    n = _bins(t, bins, low, high) if isinstance(bins, str) else int(bins)
    if n < 1:
        raise ValueError("at least one bin is needed")
    high = high if high > low else low + 1.0
    step = (high - low) / n
    return [low + step * k for k in builtins_range(n)] + [high]


def builtins_range(n: int):
    import builtins

    return builtins.range(n)


def _bin_of(v: Column, edges: list[float], even: bool) -> Column:
    """The bin of ``v`` in which the last edge counts too; null outside."""
    n = len(edges) - 1
    if even:
        k = F.least(F.floor((v - edges[0]) / ((edges[-1] - edges[0]) / n)), F.lit(n - 1))
        # Rounding may have crossed an edge.
        array = F.array(*[F.lit(e) for e in edges])
        k = F.when(v < F.get(array, k.cast("int")), k - 1).when((k < n - 1) & (v >= F.get(array, (k + 1).cast("int"))), k + 1).otherwise(k)
    else:
        k = F.least(F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= v)) - 1, F.lit(n - 1))
    return F.when((v >= edges[0]) & (v <= edges[-1]) & ~F.isnan(v), k).cast("long")


def histogram(t: Tensor, bins=10, range=None, density: bool = False, weights: Tensor | None = None) -> tuple[Tensor, list[float]]:
    """Counts (weights, densities) by bin, and the edges. NaN and what lies outside isn't counted."""
    edges = histogramBinEdges(t, bins, range)
    df = t.flat()
    if weights is not None:
        df = df.join(weights.flat().withColumnRenamed("v", "w"), "flat")
    df = df.select(_bin_of(F.col("v"), edges, not isinstance(bins, (list, tuple))).alias("i0"), (F.col("w") if weights is not None else F.lit(1.0)).alias("w")).where("i0 is not null")
    hist = Tensor(df.groupBy("i0").agg(F.sum("w").alias("v")), (len(edges) - 1,)).filled()
    if density:
        widths = F.array(*[F.lit(b - a) for a, b in zip(edges, edges[1:], strict=False)])
        total = hist.df.agg(F.sum("v").alias("t"))
        hist = Tensor(hist.df.crossJoin(F.broadcast(total)).select("i0", ew.divide(F.col("v"), F.col("t") * F.get(widths, F.col("i0").cast("int"))).alias("v")), hist.shape)
    return hist, edges


def histogram2d(x: Tensor, y: Tensor, bins: int = 10, range=None, density: bool = False, weights: Tensor | None = None) -> tuple[Tensor, list[float], list[float]]:
    ex, ey = histogramBinEdges(x, bins, range and range[0]), histogramBinEdges(y, bins, range and range[1])
    df = x.flat().withColumnRenamed("v", "x").join(y.flat().withColumnRenamed("v", "y"), "flat")
    if weights is not None:
        df = df.join(weights.flat().withColumnRenamed("v", "w"), "flat")
    df = df.select(_bin_of(F.col("x"), ex, True).alias("i0"), _bin_of(F.col("y"), ey, True).alias("i1"), (F.col("w") if weights is not None else F.lit(1.0)).alias("w")).where("i0 is not null and i1 is not null")
    hist = Tensor(df.groupBy("i0", "i1").agg(F.sum("w").alias("v")), (bins, bins)).filled()
    if density:
        area = (ex[1] - ex[0]) * (ey[1] - ey[0])
        total = hist.df.agg(F.sum("v").alias("t"))
        hist = Tensor(hist.df.crossJoin(F.broadcast(total)).select("i0", "i1", ew.divide(F.col("v"), F.col("t") * area).alias("v")), hist.shape)
    return hist, ex, ey


def grouped(t: Tensor, axes: list[int]) -> Window | None:
    """A window over the given axes, where their elements are few enough to meet in a task: one shuffle, no join. Else None."""
    if math.prod(t.shape[k] for k in axes) > FEW or len(axes) == t.ndim:
        return None
    return Window.partitionBy(*[c for k, c in enumerate(t.index) if k not in axes])


def softmax(t: Tensor, axis: int = -1, log: bool = False) -> Tensor:
    """exp(x - max) over its sum along an axis (or the logarithm of that); a long axis' maxima and sums are joined."""
    k = axis_of(axis, t.ndim)
    if (here := grouped(t, [k])) is not None:
        shifted = t.df.withColumn("s", F.col("v") - F.max("v").over(here))
        total = F.sum(F.exp("s")).over(here)
        return Tensor(shifted.select(*t.index, (F.col("s") - F.ln(total) if log else F.exp("s") / total).alias("v")), t.shape)
    by = t.others(k)
    shifted = _with(t.df, t.df.groupBy(*by).agg(F.max("v").alias("m")), by).withColumn("s", F.col("v") - F.col("m"))
    both = _with(shifted, shifted.groupBy(*by).agg(F.sum(F.exp("s")).alias("t")), by)
    return Tensor(both.select(*t.index, (F.col("s") - F.ln("t") if log else F.exp("s") / F.col("t")).alias("v")), t.shape)


def _with(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``df`` joined with what was aggregated of it; of the whole that is one row."""
    return df.join(groups, by) if by else df.crossJoin(F.broadcast(groups))


def logSoftmax(t: Tensor, axis: int = -1) -> Tensor:
    return softmax(t, axis, log=True)


def logsumexp(t: Tensor, axis: int = -1, keepdims: bool = False) -> Tensor:
    """max + ln(sum(exp(x - max))) along an axis; an infinite maximum is the result."""
    k = axis_of(axis, t.ndim)
    by, here = t.others(k), grouped(t, [k])
    both = _with(t.df, t.df.groupBy(*by).agg(F.max("v").alias("m")), by) if here is None else t.df.withColumn("m", F.max("v").over(here))
    tops = F.first("m")
    f = lambda: F.when(F.abs(tops) == ew.INF, tops).otherwise(tops + F.ln(F.sum(F.exp(F.col("v") - F.col("m")))))
    return along(Tensor(both, t.shape), f, k, keepdims)


def apply_along_axis(f: Callable, axis: int, t: Tensor) -> Tensor:
    """``f`` of every vector along an axis (NumPy arrays in and out): one group a vector. What a result's axes are, follows the others."""
    import numpy as np
    import pandas as pd

    k = axis_of(axis, t.ndim)
    others, n = t.others(k), t.shape[k]
    probe = np.asarray(f(np.zeros(n)), dtype=np.float64)
    width = len(others)
    schema = ", ".join([f"i{j} long" for j in builtins_range(width + probe.ndim)] + ["v double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(n)
        x[pdf[f"i{k}"].to_numpy()] = pdf["v"].to_numpy()
        y = np.asarray(f(x), dtype=np.float64)
        out = {f"i{j}": np.full(y.size, pdf[c].iloc[0]) for j, c in enumerate(others)}
        out |= {f"i{width + j}": c.ravel() for j, c in enumerate(np.indices(y.shape))}
        return pd.DataFrame(out | {"v": y.ravel()})

    df = t.df.groupBy(*others).applyInPandas(run, schema) if others else t.df.groupBy(F.lit(0)).applyInPandas(run, schema)
    return Tensor(df, tuple(t.shape[j] for j in builtins_range(t.ndim) if j != k) + probe.shape)
