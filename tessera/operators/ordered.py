"""Running, neighbouring and sorted: operations for which the order of elements counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..plans.order import ranked, running
from ..plans.tensor import Tensor, axis_of, coordinates

#: Sorted vectors of up to so many elements go to every task; longer ones are joined by range.
LOOKUP = 1 << 20
#: Elements of a kernel that is part of the query, and of the blocks in which longer ones are convolved.
KERNEL, SPAN = 1 << 10, 1 << 16


def _running(t: Tensor, axis: int | None, how: str) -> Tensor:
    """Flat without an axis (then a vector); inside blocks and over their totals."""
    if axis is None:
        t, axis = t.vector(), 0
    axis = axis_of(axis, t.ndim)
    return Tensor(running(t.df, f"i{axis}", "v", t.others(axis), how).select(*t.index, "v"), t.shape)


def cumsum(t: Tensor, axis: int | None = None) -> Tensor:
    return _running(t, axis, "sum")


def cumprod(t: Tensor, axis: int | None = None) -> Tensor:
    return _running(t, axis, "prod")


cumproduct, cumsumAxis, cumprodAxis = cumprod, cumsum, cumprod


def nancumsum(t: Tensor, axis: int | None = None) -> Tensor:
    """NaN counts as 0."""
    return cumsum(t.map(lambda v: F.nanvl(v, F.lit(0.0))), axis)


def nancumprod(t: Tensor, axis: int | None = None) -> Tensor:
    return cumprod(t.map(lambda v: F.nanvl(v, F.lit(1.0))), axis)


def stencil(t: Tensor, axis: int, terms: list[tuple[int, float]], size: int, first: int = 0) -> Tensor:
    """out[i] = sum of weight * t[i + first + offset] over ``terms`` (offset, weight), for i in 0, ..., size - 1.

    Every element is sent to the places that use it, and added up there: one shuffle with map-side sums, no sort.
    """
    i = F.col(f"i{axis}")
    uses = F.array(*[F.struct((i - first - o).cast("long").alias("to"), (F.col("v") * float(w)).alias("w")) for o, w in terms])
    sent = t.df.select(*[c for c in t.index if c != f"i{axis}"], F.inline(uses)).where((F.col("to") >= 0) & (F.col("to") < size))
    others = t.others(axis)
    df = sent.groupBy(*others, "to").agg(F.sum("w").alias("v")).withColumnRenamed("to", f"i{axis}")
    return Tensor(df.select(*t.index, "v"), [size if k == axis else n for k, n in enumerate(t.shape)])


def diff(t: Tensor, n: int = 1, axis: int = -1, prepend=None, append=None) -> Tensor:
    """Differences of neighbours, ``n`` times; numbers or tensors may be put before and after."""
    from .shape import concatenate

    axis = axis_of(axis, t.ndim)
    edge = lambda x: x if isinstance(x, Tensor) else Tensor.grid(t.spark, [1 if k == axis else m for k, m in enumerate(t.shape)], float(x))
    parts = [t if x is t else edge(x) for x in (prepend, t, append) if x is not None]
    t = concatenate(parts, axis) if len(parts) > 1 else t
    for _ in range(n):
        if t.shape[axis] < 2:
            raise ValueError("a difference takes two elements")
        t = stencil(t, axis, [(1, 1.0), (0, -1.0)], t.shape[axis] - 1)
    return t


def ediff1d(t: Tensor) -> Tensor:
    return diff(t.vector())


def gradient(t: Tensor, axis: int = -1, edgeOrder: int = 1) -> Tensor:
    """Central differences at unit steps, one-sided ones of order 1 or 2 at the ends."""
    axis, n = axis_of(axis, t.ndim), t.shape[axis_of(axis, t.ndim)]
    if n < edgeOrder + 1:
        raise ValueError("too few elements")
    ends = {1: [(0, -1.0), (1, 1.0)], 2: [(0, -1.5), (1, 2.0), (2, -0.5)]}[edgeOrder]
    parts = [stencil(t, axis, ends, 1)]
    if n > 2:
        parts.append(stencil(t, axis, [(2, 0.5), (0, -0.5)], n - 2))
    parts.append(stencil(t, axis, [(-o, -w) for o, w in ends], 1, n - 1))
    from .shape import concatenate

    return concatenate(parts, axis)


def _span(n: int, m: int, mode: str) -> tuple[int, int]:
    """First place and number of places of a convolution's part."""
    if mode == "full":
        return 0, n + m - 1
    if mode == "same":
        return (m - 1) // 2, n
    if mode == "valid":
        return min(n, m) - 1, max(n, m) - min(n, m) + 1
    raise ValueError(f"unknown mode {mode!r}")


def convolve(a: Tensor, v: Tensor, mode: str = "full") -> Tensor:
    """Of vectors. A kernel of up to KERNEL elements is part of the query, a longer one meets blocks of the other block by block, each
    pair in one product of transforms; a block's results that overlap the next one's are added up by place."""
    if not a.size or not v.size:
        raise ValueError("empty vectors can't be convolved")
    first, size = _span(a.size, v.size, mode)
    if v.size <= KERNEL:
        kernel = v.numpy().tolist()
        return stencil(a.vector(), 0, [(-j, w) for j, w in enumerate(kernel)], size, first)

    def blocks(t: Tensor, name: str) -> DataFrame:
        rows = t.vector().df.withColumn("at", F.floor(F.col("i0") / SPAN) * SPAN)
        return rows.groupBy(F.col("at").alias(f"{name}_at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i0", "v"))), lambda x: x["v"]).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                x, y = (batch.column(c)[row].values.to_numpy() for c in (1, 3))
                n = len(x) + len(y) - 1
                wide = 1 << (n - 1).bit_length()
                out = np.fft.irfft(np.fft.rfft(x, wide) * np.fft.rfft(y, wide), wide)[:n]
                at = batch.column(0)[row].as_py() + batch.column(2)[row].as_py() + np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out)], names=["at", "v"])

    pairs = blocks(a, "x").crossJoin(blocks(v, "y")).select("x_at", "x", "y_at", "y").repartition(F.col("x_at"), F.col("y_at"))
    sums = pairs.mapInArrow(run, "at long, v double").groupBy((F.col("at") - first).alias("i0")).agg(F.sum("v").alias("v"))
    return Tensor(sums.where((F.col("i0") >= 0) & (F.col("i0") < size)), (size,))


def correlate(a: Tensor, v: Tensor, mode: str = "valid") -> Tensor:
    from .shape import flip

    return convolve(a, flip(v.vector()), mode)


def _ranks(t: Tensor, axis: int, descending: bool = False):
    """Elements with ``rank`` (0, 1, ...) in their vector along an axis, NaN last, equals in their order."""
    i = F.col(f"i{axis}")
    v = F.col("v").desc() if descending else F.col("v").asc()
    # NaN is above all numbers for Spark; descending it goes last by itself being sorted first.
    order = [F.isnan("v").asc(), v, i.asc()]
    if t.ndim == 1:
        return ranked(t.df, order).df.withColumn("rank", F.col("rank") - 1)
    return t.df.withColumn("rank", F.row_number().over(Window.partitionBy(*t.others(axis)).orderBy(*order)).cast("long") - 1)


def sort(t: Tensor, axis: int = -1, kind: str | None = None) -> Tensor:
    """Ascending, NaN last. A single vector is sorted by range partitions."""
    axis = axis_of(axis, t.ndim)
    df = _ranks(t, axis).drop(f"i{axis}").withColumnRenamed("rank", f"i{axis}")
    return Tensor(df.select(*t.index, "v"), t.shape)


def argsort(t: Tensor, axis: int = -1, kind: str | None = None) -> Tensor:
    """Where the elements of the sorted vector were; equals in their order."""
    axis = axis_of(axis, t.ndim)
    df = _ranks(t, axis).withColumn("v", F.col(f"i{axis}").cast("double")).drop(f"i{axis}").withColumnRenamed("rank", f"i{axis}")
    return Tensor(df.select(*t.index, "v"), t.shape)


def msort(t: Tensor) -> Tensor:
    return sort(t, 0)


def lexsort(keys: list[Tensor]) -> Tensor:
    """Places in the order of the last key, equals by the one before, and so on."""
    df = keys[0].df.withColumnRenamed("v", "k0")
    for j, k in enumerate(keys[1:], 1):
        df = df.join(k.df.withColumnRenamed("v", f"k{j}"), "i0")
    out = ranked(df, [f"k{j}" for j in range(len(keys))][::-1] + ["i0"]).df
    return Tensor(out.select((F.col("rank") - 1).alias("to"), F.col("i0").cast("double").alias("v")).withColumnRenamed("to", "i0"), keys[0].shape)


def _kth(t: Tensor, kth: int, axis: int) -> None:
    n = t.shape[axis_of(axis, t.ndim)]
    if not -n <= kth < n:
        raise ValueError(f"kth {kth} is out of bounds for {n} elements")


def partition(t: Tensor, kth: int, axis: int = -1) -> Tensor:
    """The kth element in its sorted place, none greater before and none less after: the sorted vector is one such order."""
    _kth(t, kth, axis)
    return sort(t, axis)


def argpartition(t: Tensor, kth: int, axis: int = -1) -> Tensor:
    _kth(t, kth, axis)
    return argsort(t, axis)


def topk(t: Tensor, k: int, axis: int = -1, sorted: bool = True) -> tuple[Tensor, Tensor]:
    """The greatest ``k`` elements along an axis, descending, and where they are; of equals the earlier first."""
    axis = axis_of(axis, t.ndim)
    if not 0 <= k <= t.shape[axis]:
        raise ValueError("k is out of bounds")
    shape = [k if j == axis else n for j, n in enumerate(t.shape)]
    i = f"i{axis}"
    if t.ndim == 1:
        rows = t.df.orderBy(F.isnan("v").asc(), F.col("v").desc(), F.col(i)).limit(k)  # a heap in each task
        best = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.isnan("v").asc(), F.col("v").desc(), F.col(i))).cast("long") - 1)
    else:
        best = _ranks(t, axis, True).where(F.col("rank") < k)
    values = best.drop(i).withColumnRenamed("rank", i).select(*t.index, "v")
    places = best.withColumn("v", F.col(i).cast("double")).drop(i).withColumnRenamed("rank", i).select(*t.index, "v")
    return Tensor(values, shape), Tensor(places, shape)


def _looked_up(arr: Tensor, x: Column, f) -> Column:
    """``f(sorted array, elements)`` by NumPy on Arrow batches; the array goes to the tasks once."""
    values = arr.numpy()
    shared = arr.spark.sparkContext.broadcast(values)

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(f(shared.value, v.to_numpy()), np.float64))

    return run(x)


def searchsorted(arr: Tensor, v, side: str = "left", sorter: Tensor | None = None) -> Tensor | int:
    """How many elements of the ascending ``arr`` are less than (left) or at most (right) each of ``v``; a number gives a number.

    An array of up to LOOKUP elements is looked up by every task. A longer one is merged: both sides in one range-partitioned
    order, in which a value's place less the values before it is how many elements precede it.
    """
    if side not in ("left", "right"):
        raise ValueError(f"unknown side {side!r}")
    if sorter is not None:
        arr = Tensor(sorter.df.select("i0", F.col("v").cast("long").alias("at")).join(arr.df.select(F.col("i0").alias("at"), "v"), "at").select("i0", "v"), arr.shape)
    if not isinstance(v, Tensor):
        x = float(v)
        below = F.col("v") < x if side == "left" else F.col("v") <= x
        return int(arr.df.agg(F.count_if(below).alias("n")).first().n)
    if arr.size <= LOOKUP:
        return v.map(lambda x: _looked_up(arr, x, lambda a, y: np.searchsorted(a, y, side)))
    both = arr.df.select("v", F.lit(1).alias("own"), F.lit(0).cast("long").alias("flat")).unionByName(v.flat().select("v", F.lit(0).alias("own"), "flat"))
    # Of equals, the values asked for come first (left) or last (right).
    first = F.col("own") if side == "left" else -F.col("own")
    merged = ranked(both, ["v", first, "flat"], "all").df
    asked = ranked(merged.where("own = 0"), ["all"], "asked").df
    return Tensor(asked.select(*coordinates(F.col("flat"), v.shape), (F.col("all") - F.col("asked")).cast("double").alias("v")), v.shape)


def interp(x: Tensor, xp: Tensor, fp: Tensor) -> Tensor:
    """Piecewise linear through (xp, fp), constant beyond the ends; for any number of knots.

    Knots are joined to the segment each x falls in: its number by searchsorted, then an equi-join on it.
    """
    n = xp.size
    if n == 0:
        raise ValueError("no knots")
    at = searchsorted(xp, x, "right").df.select(*x.index, F.col("v").cast("long").alias("k"))
    knots = xp.df.join(fp.df.withColumnRenamed("v", "f"), "i0")
    low = knots.select((F.col("i0") + 1).alias("k"), F.col("v").alias("x0"), F.col("f").alias("f0"))
    high = knots.select(F.col("i0").alias("k"), F.col("v").alias("x1"), F.col("f").alias("f1"))
    segments = low.join(high, "k", "full")
    df = x.df.join(at, x.index).join(segments, "k")
    slope = ew.divide(F.col("f1") - F.col("f0"), F.col("x1") - F.col("x0"))
    v = F.when(F.isnan("v"), ew.NAN).when(F.col("x0").isNull(), F.col("f1")).when(F.col("x1").isNull() | (F.col("v") == F.col("x0")), F.col("f0")).otherwise(F.col("f0") + slope * (F.col("v") - F.col("x0")))
    return Tensor(df.select(*x.index, v.alias("v")), x.shape)


#: Rows of a block of queries, and of a block of the rows that they are compared with.
ASKED, COMPARED = 1 << 10, 1 << 12


def nearestRows(asked: DataFrame, df: DataFrame, key: str, column: str, k: int, digits: int = 12) -> DataFrame:
    """(q_id, ``key``, score, rank): for each row of ``asked`` the ``k`` others of ``df`` with the greatest cosine of the array ``column``.

    Scores are rounded to ``digits``; ties go to the least key. Blocks of queries meet blocks of rows, each pair of blocks in one
    matrix product that leaves its own best k; a query's best of all blocks are put in order then. Nothing is broadcast, and no
    pair of rows is a row of any table. Rows that are null, or without a direction, are near nothing.
    """

    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        rows = rows.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x")).where("id is not null and x is not null")
        count = F.greatest(F.lit(1), F.ceil(F.lit(rows.count()) / size)).cast("int")
        return rows.groupBy(F.pmod(F.xxhash64("id"), count).alias("block")).agg(F.collect_list("id").alias(f"{name}_ids"), F.flatten(F.collect_list("x")).alias(name)).drop("block")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ids, x, other, y = (batch.column(c)[row].values.to_numpy() for c in range(4))
                x, y = x.reshape(len(ids), -1), y.reshape(len(other), -1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
                    scores = np.round(x @ y.T, digits)
                scores[(ids[:, None] == other[None, :]) | ~np.isfinite(scores)] = -np.inf
                # Columns in the order of their keys, so that a stable order by score breaks ties by key.
                by_key = np.argsort(other, kind="stable")
                place = np.argsort(-scores[:, by_key], axis=1, kind="stable")[:, :k]
                found = np.take_along_axis(scores[:, by_key], place, axis=1)
                q, near, found = np.repeat(ids, place.shape[1]), other[by_key][place].ravel(), found.ravel()
                some = np.isfinite(found)
                yield pa.RecordBatch.from_arrays([pa.array(q[some]), pa.array(near[some]), pa.array(found[some])], names=["q_id", "near", "score"])

    pairs = blocks(asked, ASKED, "q").crossJoin(blocks(df, COMPARED, "v")).select("q_ids", "q", "v_ids", "v")
    each = pairs.repartition(F.hash("q_ids", "v_ids")).mapInArrow(best, "q_id long, near long, score double")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "near"))
    return each.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("q_id", F.col("near").alias(key), "score", "rank")
