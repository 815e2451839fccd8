"""Gathering, scattering, masks and places of elements."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..plans.order import ranked
from ..plans.tensor import Tensor, axis_of, coordinates, elementwise, strides
from .algebra import broadcastTo


def extract(condition: Tensor, t: Tensor) -> Tensor:
    """Elements where the condition isn't 0, as a vector in row-major order. Runs a job for their number."""
    chosen = t.flat().join(condition.flat().where("v != 0").select("flat"), "flat", "left_semi")
    out = ranked(chosen, ["flat"])
    return Tensor(out.df.select((F.col("rank") - 1).alias("i0"), "v"), (out.count,))


getByMask = lambda t, mask: extract(mask, t)


def setByMask(t: Tensor, mask: Tensor, value: float) -> Tensor:
    return elementwise(lambda x, m: F.when(m != 0, float(value)).otherwise(x), t, mask)


def compress(condition: Tensor, t: Tensor, axis: int | None = None) -> Tensor:
    """Slices where a vector, maybe shorter than the axis, isn't 0."""
    if axis is None:
        t, axis = t.vector(), 0
    axis = axis_of(axis, t.ndim)
    places = ranked(condition.df.where("v != 0").select("i0").where(F.col("i0") < t.shape[axis]), ["i0"])
    at = places.df.select(F.col("i0").alias(f"i{axis}"), (F.col("rank") - 1).alias("to"))
    df = t.df.join(at, f"i{axis}").drop(f"i{axis}").withColumnRenamed("to", f"i{axis}")
    return Tensor(df.select(*t.index, "v"), [places.count if k == axis else n for k, n in enumerate(t.shape)])


def where(condition: Tensor, x=None, y=None) -> Tensor | list[Tensor]:
    """``x`` where the condition isn't 0, else ``y``, all broadcast; of the condition alone, nonzero()."""
    if x is None and y is None:
        return nonzero(condition)
    return elementwise(ew.where, condition, x, y)


def select(conditions: list[Tensor], choices: list, default: float = 0.0) -> Tensor:
    n = len(conditions)
    return elementwise(lambda *a: ew.select(list(a[:n]), list(a[n:]), default), *conditions, *choices)


def choose(index: Tensor, choices: list, mode: str = "raise") -> Tensor:
    return elementwise(lambda i, *c: ew.choose(i, list(c), mode), index, *choices)


def piecewise(x: Tensor, conditions: list[Tensor], functions: list, default: float = 0.0) -> Tensor:
    return elementwise(lambda v, *c: ew.piecewise(v, list(c), functions, default), x, *conditions)


def take(t: Tensor, indices: Tensor, axis: int | None = None) -> Tensor:
    """Slices at indices (counted from the end if negative), flat without an axis; NaN where there is none.

    The result has the indices' shape in place of the axis.
    """
    if axis is None:
        t, axis = t.vector(), 0
    axis, n = axis_of(axis, t.ndim), t.shape[axis_of(axis, t.ndim)]
    at = F.col("v").cast("long")
    asked = indices.df.select(*[F.col(c).alias(f"j{k}") for k, c in enumerate(indices.index)], F.when(at < 0, at + n).otherwise(at).alias(f"i{axis}"))
    out_shape = [*t.shape[:axis], *indices.shape, *t.shape[axis + 1 :]]
    missing = asked.where((F.col(f"i{axis}") < 0) | (F.col(f"i{axis}") >= n))
    df = asked.join(t.df, f"i{axis}")
    order = [*[f"i{k}" for k in range(axis)], *[f"j{k}" for k in range(indices.ndim)], *[f"i{k}" for k in range(axis + 1, t.ndim)]]
    out = df.select(*[F.col(c).alias(f"r{k}") for k, c in enumerate(order)], "v")
    rest = missing
    for k in range(t.ndim):
        if k != axis:
            rest = rest.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(t.shape[k] - 1).cast("long")))) if t.shape[k] else rest.limit(0).withColumn(f"i{k}", F.lit(0).cast("long"))
    out = out.unionByName(rest.select(*[F.col(c).cast("long").alias(f"r{k}") for k, c in enumerate(order)], F.lit(ew.NAN).alias("v")))
    return Tensor(out.select(*[F.col(f"r{k}").alias(f"i{k}") for k in range(len(order))], "v"), out_shape)


gather = take


def takeAlongAxis(t: Tensor, indices: Tensor, axis: int) -> Tensor:
    """out[..., k, ...] = t[..., indices[..., k, ...], ...]."""
    axis, n = axis_of(axis, t.ndim), t.shape[axis_of(axis, t.ndim)]
    at = F.col("v").cast("long")
    asked = indices.df.select(*indices.others(axis), F.col(f"i{axis}").alias("to"), F.when(at < 0, at + n).otherwise(at).alias(f"i{axis}"))
    df = asked.join(t.df, t.index, "left").drop(f"i{axis}").withColumnRenamed("to", f"i{axis}")
    return Tensor(df.select(*t.index, F.coalesce("v", F.lit(ew.NAN)).alias("v")), indices.shape)


def _put(t: Tensor, new) -> Tensor:
    """``t`` with the rows of ``new`` (indices, w) in place of its own."""
    df = t.df.join(new, t.index, "left")
    return Tensor(df.select(*t.index, F.coalesce("w", "v").alias("v")), t.shape)


def putAlongAxis(t: Tensor, indices: Tensor, values, axis: int) -> Tensor:
    """A copy with values at indices; of several for one place, that of the last index."""
    axis, n = axis_of(axis, t.ndim), t.shape[axis_of(axis, t.ndim)]
    values = Tensor.grid(t.spark, indices.shape, float(values)) if not isinstance(values, Tensor) else broadcastTo(values, indices.shape)
    at = F.col("v").cast("long")
    asked = indices.df.select(*indices.others(axis), F.col(f"i{axis}").alias("k"), F.when(at < 0, at + n).otherwise(at).alias("at"))
    given = values.df.withColumnRenamed(f"i{axis}", "k").withColumnRenamed("v", "w")
    new = asked.join(given, [*indices.others(axis), "k"]).groupBy(*indices.others(axis), "at").agg(F.max_by("w", "k").alias("w"))
    return _put(t, new.withColumnRenamed("at", f"i{axis}"))


def scatter(t: Tensor, axis: int, indices: Tensor, source: Tensor) -> Tensor:
    return putAlongAxis(t, indices, source, axis)


def indexCopy(t: Tensor, axis: int, indices: Tensor, source: Tensor) -> Tensor:
    """A copy with whole slices of ``source`` at the places that a vector names; of several the last."""
    axis = axis_of(axis, t.ndim)
    last = indices.df.groupBy(F.col("v").cast("long").alias("at")).agg(F.max("i0").alias(f"i{axis}"))
    new = source.df.join(last, f"i{axis}").drop(f"i{axis}").withColumnRenamed("at", f"i{axis}").withColumnRenamed("v", "w")
    return _put(t, new.select(*t.index, "w"))


def put(t: Tensor, indices, values) -> Tensor:
    """A copy with values, over and over if they are fewer, at flat indices; negative ones count from the end, of equal ones the last counts."""
    indices = [indices] if isinstance(indices, (int, float)) else indices
    ind = indices if isinstance(indices, Tensor) else Tensor.of(t.spark, indices)
    val = values if isinstance(values, Tensor) else Tensor.of(t.spark, [values] if isinstance(values, (int, float)) else values)
    at = F.col("v").cast("long")
    asked = ind.flat().select(F.col("flat").alias("n"), F.when(at < 0, at + t.size).otherwise(at).alias("flat"), (F.col("flat") % val.size).alias("m"))
    new = asked.join(val.flat().select(F.col("flat").alias("m"), F.col("v").alias("w")), "m").groupBy("flat").agg(F.max_by("w", "n").alias("w"))
    df = t.flat().join(new, "flat", "left").select("flat", F.coalesce("w", "v").alias("v"))
    return Tensor(df.select(*coordinates(F.col("flat"), t.shape), "v"), t.shape, t.dtype)


def place(t: Tensor, mask: Tensor, values) -> Tensor:
    """A copy with values, over and over, where the mask isn't 0, in row-major order."""
    val = values if isinstance(values, Tensor) else Tensor.of(t.spark, values)
    chosen = ranked(mask.flat().where("v != 0").select("flat"), ["flat"]).df.select("flat", ((F.col("rank") - 1) % val.size).alias("m"))
    new = chosen.join(val.flat().select(F.col("flat").alias("m"), F.col("v").alias("w")), "m").select("flat", "w")
    df = t.flat().join(new, "flat", "left").select("flat", F.coalesce("w", "v").alias("v"))
    return Tensor(df.select(*coordinates(F.col("flat"), t.shape), "v"), t.shape, t.dtype)


def insert(t: Tensor, index: int, values, axis: int | None = None) -> Tensor:
    """With values before a place of the flat vector, or slices before one of an axis."""
    from .shape import concatenate, slice_axis

    if axis is None:
        t, axis = t.vector(), 0
        values = values.vector() if isinstance(values, Tensor) else Tensor.of(t.spark, [values])
    axis, n = axis_of(axis, t.ndim), t.shape[axis_of(axis, t.ndim)]
    if not isinstance(values, Tensor):
        values = Tensor.grid(t.spark, [1 if k == axis else m for k, m in enumerate(t.shape)], float(values))
    elif values.ndim < t.ndim:
        values = broadcastTo(values, [1 if k == axis else m for k, m in enumerate(t.shape)])
    at = index + n if index < 0 else index
    if not 0 <= at <= n:
        raise ValueError("index is out of bounds")
    return concatenate([slice_axis(t, axis, 0, at), values, slice_axis(t, axis, at, n)], axis)


def deleteArr(t: Tensor, index, axis: int | None = None) -> Tensor:
    """Without places of the flat vector, or slices of an axis."""
    if axis is None:
        t, axis = t.vector(), 0
    axis, n = axis_of(axis, t.ndim), t.shape[axis_of(axis, t.ndim)]
    gone = sorted({i + n if i < 0 else i for i in ([index] if isinstance(index, int) else index) if -n <= i < n})
    i = F.col(f"i{axis}")
    moved = i - F.size(F.filter(F.array(*[F.lit(g) for g in gone]).cast("array<long>"), lambda g: g < i))
    return t.reindexed([moved if k == axis else F.col(f"i{k}") for k in range(t.ndim)], [m - len(gone) if k == axis else m for k, m in enumerate(t.shape)], ~i.isin(gone) if gone else F.lit(True))


def append(t: Tensor, values: Tensor, axis: int | None = None) -> Tensor:
    from .shape import concatenate

    return concatenate([t, values], axis)


def _found(t: Tensor):
    return ranked(t.df.where("v != 0"), t.index)


def nonzero(t: Tensor) -> list[Tensor]:
    """For each axis the indices of elements that aren't 0, in row-major order. NaN counts."""
    out = _found(t)
    return [Tensor(out.df.select((F.col("rank") - 1).alias("at"), F.col(c).cast("double").alias("x")).toDF("i0", "v"), (out.count,)) for c in t.index]


def argwhere(t: Tensor) -> Tensor:
    """A row of indices for each element that isn't 0."""
    out = _found(t)
    each = F.array(*[F.struct(F.lit(k).cast("long").alias("i1"), F.col(c).cast("double").alias("w")) for k, c in enumerate(t.index)])
    return Tensor(out.df.select((F.col("rank") - 1).alias("r"), F.inline(each)).toDF("i0", "i1", "v"), (out.count, t.ndim))


def flatnonzero(t: Tensor) -> Tensor:
    return nonzero(t.vector())[0]


nonzeroFlat = flatnonzero


def unravelIndex(flat: Tensor | int, shape) -> list[Tensor] | list[int]:
    """Coordinates of row-major positions."""
    if isinstance(flat, int):
        return [flat // s % n for s, n in zip(strides(shape), shape, strict=True)]
    return [flat.map(lambda v, s=s, n=n: F.floor(v / s) % n) for s, n in zip(strides(shape), shape, strict=True)]


def ravelMultiIndex(indices: list[Tensor], shape) -> Tensor:
    """Row-major positions of coordinates."""
    steps = strides(shape)
    return elementwise(lambda *c: sum((x * s for x, s in zip(c, steps, strict=True)), F.lit(0.0)), *indices)


def fillDiagonal(t: Tensor, value: float, wrap: bool = False) -> Tensor:
    """A copy with a value where all indices are equal; with ``wrap`` the diagonal of a tall matrix starts anew after each square."""
    if t.ndim < 2:
        raise ValueError("at least two dimensions are needed")
    on = F.col("i0") == F.col("i1")
    if wrap and t.ndim == 2:
        on = (F.col("i0") % (t.shape[1] + 1)) == F.col("i1")
    for k in range(2, t.ndim):
        on = on & (F.col(f"i{k}") == F.col("i0"))
    return Tensor(t.df.select(*t.index, F.when(on, float(value)).otherwise(F.col("v")).alias("v")), t.shape, t.dtype)


def _half(t: Tensor, keep: Column) -> Tensor:
    if t.ndim < 2:
        raise ValueError("a matrix is needed")
    return Tensor(t.df.select(*t.index, F.when(keep, F.col("v")).otherwise(0.0).alias("v")), t.shape, t.dtype)


def tril(t: Tensor, k: int = 0) -> Tensor:
    return _half(t, F.col(f"i{t.ndim - 1}") <= F.col(f"i{t.ndim - 2}") + k)


def triu(t: Tensor, k: int = 0) -> Tensor:
    return _half(t, F.col(f"i{t.ndim - 1}") >= F.col(f"i{t.ndim - 2}") + k)


def packbits(t: Tensor, axis: int | None = None, bitorder: str = "big") -> Tensor:
    """Eight elements, 1 if not 0, as a byte; zeros fill the last. Always flat."""
    bit = (F.col("flat") % 8).cast("int")
    weight = F.pow(F.lit(2.0), 7 - bit if bitorder == "big" else bit)
    df = t.flat().groupBy(F.floor(F.col("flat") / 8).alias("i0")).agg(F.sum(F.when(F.col("v") != 0, weight).otherwise(0.0)).alias("v"))
    return Tensor(df, (math.ceil(t.size / 8),), "uint8")


def unpackbits(t: Tensor, axis: int | None = None, count: int | None = None, bitorder: str = "big") -> Tensor:
    """Each byte as eight elements of 0 or 1, the first ``count`` of them."""
    n = t.size * 8 if count is None else min(count, t.size * 8) if count >= 0 else t.size * 8 + count
    df = t.flat().select("flat", F.col("v").cast("long").alias("byte"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b"))
    shift = 7 - F.col("b") if bitorder == "big" else F.col("b")
    value = F.floor(F.col("byte") / F.pow(F.lit(2.0), shift)) % 2
    out = df.select((F.col("flat") * 8 + F.col("b")).alias("i0"), value.cast("double").alias("v"))
    return Tensor(out.where(F.col("i0") < n), (n,), "uint8")

