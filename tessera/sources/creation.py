"""Tensors from nothing: constants, ranges, grids, tapers. Rows are generated by the executors, from their position alone."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from itertools import islice

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..plans.tensor import Tensor, normal_shape


def zeros(spark: SparkSession, shape, dtype: str = "float64") -> Tensor:
    return Tensor.grid(spark, shape, 0.0, dtype)


#: Not left uninitialised: zeros.
empty = zeros


def ones(spark: SparkSession, shape, dtype: str = "float64") -> Tensor:
    return Tensor.grid(spark, shape, 1.0, dtype)


def full(spark: SparkSession, shape, value: float, dtype: str = "float64") -> Tensor:
    return Tensor.grid(spark, shape, value, dtype)


def _like(value: float) -> Callable[..., Tensor]:
    def f(t: Tensor, dtype: str | None = None) -> Tensor:
        return t.map(lambda _: F.lit(value), dtype or t.dtype)

    f.__doc__ = f"{value:g} everywhere, in the shape (and type, unless given) of a tensor."
    return f


zerosLike = emptyLike = _like(0.0)
onesLike = _like(1.0)


def fullLike(t: Tensor, value: float, dtype: str | None = None) -> Tensor:
    return _like(float(value))(t, dtype)


def arange(spark: SparkSession, start: float, stop: float | None = None, step: float = 1.0, dtype: str = "float64") -> Tensor:
    """start + i * step below ``stop`` (above it for a negative step); each from its position, so that errors don't add up."""
    if stop is None:
        start, stop = 0.0, start
    if step == 0:
        raise ValueError("step can't be 0")
    n = max(0, math.ceil((stop - start) / step))
    return Tensor.grid(spark, n, lambda i: start + i * float(step), dtype)


def _spread(start: float, stop: float, num: int, endpoint: bool) -> tuple[int, float]:
    """Zero places are taken as one."""
    n = max(1, num)
    return n, (stop - start) / max(1, n - 1 if endpoint else n)


def linspace(spark: SparkSession, start: float, stop: float, num: int, endpoint: bool = True, dtype: str = "float64") -> Tensor:
    n, step = _spread(start, stop, num, endpoint)
    return Tensor.grid(spark, n, lambda i: start + i * step, dtype)


def logspace(spark: SparkSession, start: float, stop: float, num: int, base: float = 10.0, endpoint: bool = True, dtype: str = "float64") -> Tensor:
    n, step = _spread(start, stop, num, endpoint)
    return Tensor.grid(spark, n, lambda i: F.pow(F.lit(float(base)), start + i * step), dtype)


def geomspace(spark: SparkSession, start: float, stop: float, num: int, endpoint: bool = True, dtype: str = "float64") -> Tensor:
    if start * stop <= 0:
        raise ValueError("ends must be of one sign and not 0")
    sign, a = math.copysign(1.0, start), math.log(abs(start))
    n, step = _spread(a, math.log(abs(stop)), num, endpoint)
    return Tensor.grid(spark, n, lambda i: sign * F.exp(a + i * step), dtype)


def eye(spark: SparkSession, n: int, m: int | None = None, k: int = 0, dtype: str = "float64") -> Tensor:
    return Tensor.grid(spark, (n, n if m is None else m), lambda i, j: ew.flag(j == i + k), dtype)


def identity(spark: SparkSession, n: int, dtype: str = "float64") -> Tensor:
    return eye(spark, n, dtype=dtype)


def tri(spark: SparkSession, n: int, m: int | None = None, k: int = 0, dtype: str = "float64") -> Tensor:
    return Tensor.grid(spark, (n, n if m is None else m), lambda i, j: ew.flag(j <= i + k), dtype)


def causalMask(spark: SparkSession, n: int) -> Tensor:
    """0 on and below the diagonal, -inf above."""
    return Tensor.grid(spark, (n, n), lambda i, j: F.when(j <= i, 0.0).otherwise(-ew.INF))


def vander(x: Tensor, n: int | None = None, increasing: bool = False) -> Tensor:
    """Powers of a vector's elements, the highest first unless ``increasing``."""
    n = x.shape[0] if n is None else n
    powers = F.array(*[F.struct(F.lit(j).cast("long").alias("i1"), F.pow(F.col("v"), F.lit(float(j if increasing else n - 1 - j))).alias("w")) for j in range(n)])
    return Tensor(x.df.select("i0", F.inline(powers)).select("i0", "i1", F.col("w").alias("v")), (x.shape[0], n))


def array(spark: SparkSession, data, shape: Sequence[int] | None = None, dtype: str = "float64") -> Tensor:
    return Tensor.of(spark, data, shape, dtype)


createArray = tensor = array


def asarray(spark: SparkSession, data, dtype: str | None = None) -> Tensor:
    """A tensor as it is, or cast; anything else as array() has it, a number without dimensions."""
    if isinstance(data, Tensor):
        return data if dtype in (None, data.dtype) else data.map(lambda v: v, dtype)
    return Tensor.of(spark, data, None, dtype or "float64")


def copy(t: Tensor, dtype: str | None = None) -> Tensor:
    """Tensors don't change, so the same unless cast."""
    return t if dtype in (None, t.dtype) else t.map(lambda v: v, dtype)


def astype(t: Tensor, dtype: str) -> Tensor:
    return t.map(lambda v: v, dtype)


def fromfunction(spark: SparkSession, f: Callable[..., Column | float], shape, dtype: str = "float64") -> Tensor:
    """``f(i0, i1, ...)`` of every cell's indices; column operations make it part of the query, other functions run through vectorize()."""
    try:
        return Tensor.grid(spark, shape, lambda *i: ew.num(f(*[c.cast("double") for c in i])), dtype)
    except Exception:  # a function of numbers only
        return Tensor.grid(spark, shape, ew.vectorize(f), dtype)


def fromiter(spark: SparkSession, items: Iterable[float], count: int | None = None, dtype: str = "float64") -> Tensor:
    return Tensor.of(spark, list(islice(items, count)), None, dtype)


def meshgrid(*vectors: Tensor, indexing: str = "xy") -> list[Tensor]:
    """Coordinates of the grid that vectors span; with "xy" the first two axes are swapped."""
    if indexing not in ("xy", "ij"):
        raise ValueError(f"unknown indexing {indexing!r}")
    n = len(vectors)
    place = list(range(n))
    if indexing == "xy" and n > 1:
        place[0], place[1] = 1, 0
    shape = [0] * n
    for k, v in enumerate(vectors):
        shape[place[k]] = v.size
    from ..operators.algebra import broadcastTo

    out = []
    for k, v in enumerate(vectors):
        own = [F.col("i0") if j == place[k] else F.lit(0) for j in range(n)]
        out.append(broadcastTo(v.reindexed(own, [v.size if j == place[k] else 1 for j in range(n)]), shape))
    return out


def indices(spark: SparkSession, shape) -> list[Tensor]:
    shape = normal_shape(shape)
    return [Tensor.grid(spark, shape, lambda *i, k=k: i[k]) for k in range(len(shape))]


def diagIndices(spark: SparkSession, n: int, ndim: int = 2) -> list[Tensor]:
    return [Tensor.grid(spark, n, lambda i: i) for _ in range(ndim)]


def _triangle(spark: SparkSession, n: int, m: int, lower: bool, k: int) -> list[Tensor]:
    """Rows and columns of a triangle in row-major order. How many cells are before a row follows from its number."""
    width = lambda r: max(0, min(m, r + k + 1)) if lower else max(0, m - max(0, r + k))
    total = sum(width(r) for r in range(n))
    i = F.col("id")
    count = F.greatest(F.lit(0), F.least(F.lit(m), i + k + 1)) if lower else F.greatest(F.lit(0), m - F.greatest(F.lit(0), i + k))
    # Sum of the rows before: a straight part between two constant ones.
    if lower:
        ramp_from, ramp_to = max(0, -k), max(0, min(n, m - k - 1))
        r = F.least(F.greatest(i - ramp_from, F.lit(0)), F.lit(max(0, ramp_to - ramp_from)))
        before = r * (ramp_from + k + 1) + r * (r - 1) / 2 + F.greatest(i - max(ramp_to, ramp_from), F.lit(0)) * m
    else:
        flat_to, ramp_to = max(0, min(n, -k)), max(0, min(n, m - k))
        r = F.least(F.greatest(i - flat_to, F.lit(0)), F.lit(max(0, ramp_to - flat_to)))
        before = F.least(i, F.lit(flat_to)) * m + r * (m - flat_to - k) - r * (r - 1) / 2
    first = F.lit(0) if lower else F.greatest(F.lit(0), i + k)
    rows = spark.range(n).select("id", before.cast("long").alias("before"), first.cast("long").alias("first"), count.cast("long").alias("count")).where("count > 0")
    cells = rows.select("id", "before", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("c"))
    at = (F.col("before") + F.col("c")).alias("i0")
    return [Tensor(cells.select(at, v.cast("double").alias("v")), (total,)) for v in (F.col("id"), F.col("first") + F.col("c"))]


def trilIndices(spark: SparkSession, n: int, k: int = 0, m: int | None = None) -> list[Tensor]:
    return _triangle(spark, n, n if m is None else m, True, k)


def triuIndices(spark: SparkSession, n: int, k: int = 0, m: int | None = None) -> list[Tensor]:
    return _triangle(spark, n, n if m is None else m, False, k)


def ix_(*vectors: Tensor) -> list[Tensor]:
    """Vectors as axes of an open mesh: each of size 1 along the others' axes."""
    n = len(vectors)
    return [v.reindexed([F.col("i0") if j == k else F.lit(0) for j in range(n)], [v.size if j == k else 1 for j in range(n)]) for k, v in enumerate(vectors)]


def _taper(f: Callable[[Column, int], Column]) -> Callable[[SparkSession, int], Tensor]:
    def window(spark: SparkSession, m: int) -> Tensor:
        return Tensor.grid(spark, max(0, m), (lambda i: f(i, m)) if m > 1 else 1.0)

    return window


def _turn(i: Column, m: int, times: int = 1) -> Column:
    return F.cos(2 * math.pi * times * i / (m - 1))


bartlett = _taper(lambda i, m: 1 - F.abs(2 * i / (m - 1) - 1))
blackman = _taper(lambda i, m: 0.42 - 0.5 * _turn(i, m) + 0.08 * _turn(i, m, 2))
hamming = _taper(lambda i, m: 0.54 - 0.46 * _turn(i, m))
hanning = _taper(lambda i, m: 0.5 - 0.5 * _turn(i, m))


def _bessel_i0(x: Column) -> Column:
    """Sum of ((x / 2)**k / k!)**2; its terms rise up to k = x / 2 and vanish soon after."""
    step = lambda s, k: F.struct((s["t"] * (x / 2 / k) * (x / 2 / k)).alias("t"), (s["s"] + s["t"] * (x / 2 / k) * (x / 2 / k)).alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step, lambda s: s["s"])


def kaiser(spark: SparkSession, m: int, beta: float) -> Tensor:
    return _taper(lambda i, m: _bessel_i0(beta * F.sqrt(F.greatest(F.lit(0.0), 1 - (2 * i / (m - 1) - 1) * (2 * i / (m - 1) - 1)))) / _bessel_i0(F.lit(float(beta))))(spark, m)


def fftfreq(spark: SparkSession, n: int, d: float = 1.0) -> Tensor:
    return Tensor.grid(spark, n, lambda i: F.when(i < (n + 1) // 2, i).otherwise(i - n) / (n * float(d)))


def rfftfreq(spark: SparkSession, n: int, d: float = 1.0) -> Tensor:
    return Tensor.grid(spark, n // 2 + 1, lambda i: i / (n * float(d)))


