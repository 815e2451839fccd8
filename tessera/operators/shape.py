"""Shape and structure: new indices from old ones. Nothing here shuffles but what re-reads elements several times."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..plans.tensor import Tensor, axis_of, coordinates, names, normal_shape


def _i(k: int) -> Column:
    return F.col(f"i{k}")


def infer(shape, size: int) -> tuple[int, ...]:
    """``shape`` with its one -1 replaced so that it holds ``size`` elements."""
    shape = (shape,) if isinstance(shape, int) else tuple(shape)
    if shape.count(-1) > 1:
        raise ValueError("only one dimension can be -1")
    if -1 in shape:
        rest = math.prod(n for n in shape if n != -1)
        if rest == 0 or size % rest:
            raise ValueError(f"{size} elements don't fit {shape}")
        shape = tuple(size // rest if n == -1 else n for n in shape)
    if math.prod(shape) != size:
        raise ValueError(f"{size} elements don't fit {shape}")
    return normal_shape(shape)


def reshape(t: Tensor, shape) -> Tensor:
    shape = infer(shape, t.size)
    df = t.flat()
    return Tensor(df.select(*coordinates(F.col("flat"), shape), "v"), shape, t.dtype)


def flatten(t: Tensor) -> Tensor:
    return t.vector()


ravel = flatten


def resize(t: Tensor, shape) -> Tensor:
    """Elements over and over until ``shape`` is full."""
    shape = normal_shape(shape)
    n = math.prod(shape)
    if t.size == 0 or n == 0:
        return Tensor.grid(t.spark, shape, 0.0, t.dtype)
    times = F.sequence(F.lit(0), F.floor((F.lit(n - 1) - F.col("flat")) / t.size))
    df = t.flat().where(F.col("flat") < n).select("flat", F.explode(times).alias("k"), "v").select((F.col("k") * t.size + F.col("flat")).alias("flat"), "v")
    return Tensor(df.select(*coordinates(F.col("flat"), shape), "v"), shape, t.dtype)


def transpose(t: Tensor, axes: Sequence[int] | None = None) -> Tensor:
    axes = list(range(t.ndim))[::-1] if axes is None else [axis_of(a, t.ndim) for a in axes]
    if sorted(axes) != list(range(t.ndim)):
        raise ValueError(f"{axes} isn't a permutation of {t.ndim} axes")
    return t.reindexed([_i(a) for a in axes], [t.shape[a] for a in axes])


permute = transpose


def swapaxes(t: Tensor, a: int, b: int) -> Tensor:
    axes = list(range(t.ndim))
    a, b = axis_of(a, t.ndim), axis_of(b, t.ndim)
    axes[a], axes[b] = axes[b], axes[a]
    return transpose(t, axes)


def moveaxis(t: Tensor, source, destination) -> Tensor:
    s = [axis_of(a, t.ndim) for a in ([source] if isinstance(source, int) else source)]
    d = [axis_of(a, t.ndim) for a in ([destination] if isinstance(destination, int) else destination)]
    rest = iter(a for a in range(t.ndim) if a not in s)
    return transpose(t, [s[d.index(k)] if k in d else next(rest) for k in range(t.ndim)])


def squeeze(t: Tensor, axis=None) -> Tensor:
    """Without all axes of size 1, or the given ones."""
    gone = [k for k, n in enumerate(t.shape) if n == 1] if axis is None else [axis_of(a, t.ndim) for a in ([axis] if isinstance(axis, int) else axis)]
    if any(t.shape[k] != 1 for k in gone):
        raise ValueError("only axes of size 1 can go")
    left = [k for k in range(t.ndim) if k not in gone]
    return t.reindexed([_i(k) for k in left], [t.shape[k] for k in left])


def expandDims(t: Tensor, axis: int) -> Tensor:
    axis = axis_of(axis, t.ndim + 1)
    old = list(range(t.ndim))
    return t.reindexed([*map(_i, old[:axis]), F.lit(0), *map(_i, old[axis:])], [*t.shape[:axis], 1, *t.shape[axis:]])


def atleast1d(t: Tensor) -> Tensor:
    return expandDims(t, 0) if t.ndim == 0 else t


def atleast2d(t: Tensor) -> Tensor:
    return expandDims(atleast1d(t), 0) if t.ndim < 2 else t


def atleast3d(t: Tensor) -> Tensor:
    """A vector in the middle axis, a matrix in the first two."""
    return expandDims(atleast2d(t), 2) if t.ndim < 3 else t


def concatenate(tensors: Sequence[Tensor], axis: int | None = 0) -> Tensor:
    """Along an axis, or all flat: a union with moved indices."""
    if not tensors:
        raise ValueError("nothing to concatenate")
    if axis is None:
        return concatenate([t.vector() for t in tensors], 0)
    axis, first = axis_of(axis, tensors[0].ndim), tensors[0]
    for t in tensors:
        if t.ndim != first.ndim or any(a != b for k, (a, b) in enumerate(zip(t.shape, first.shape, strict=True)) if k != axis):
            raise ValueError("shapes differ beyond the axis")
    moved, at = [], 0
    for t in tensors:
        moved.append(t.reindexed([_i(k) + (at if k == axis else 0) for k in range(t.ndim)], t.shape).df)
        at += t.shape[axis]
    return Tensor(fold(lambda a, b: a.unionByName(b), moved), [at if k == axis else n for k, n in enumerate(first.shape)])


def stack(tensors: Sequence[Tensor], axis: int = 0) -> Tensor:
    if len({t.shape for t in tensors}) != 1:
        raise ValueError("shapes differ")
    return concatenate([expandDims(t, axis) for t in tensors], axis)


def vstack(tensors: Sequence[Tensor]) -> Tensor:
    return concatenate([atleast2d(t) for t in tensors], 0)


rowStack = vstack


def hstack(tensors: Sequence[Tensor]) -> Tensor:
    tensors = [atleast1d(t) for t in tensors]
    return concatenate(tensors, 0 if tensors[0].ndim == 1 else 1)


def dstack(tensors: Sequence[Tensor]) -> Tensor:
    return concatenate([atleast3d(t) for t in tensors], 2)


def columnStack(tensors: Sequence[Tensor]) -> Tensor:
    return concatenate([expandDims(t, 1) if t.ndim == 1 else t for t in tensors], 1)


def block(parts) -> Tensor:
    """A list is joined along the last axis, a list of lists also row by row."""
    if isinstance(parts[0], (list, tuple)):
        return vstack([hstack(list(p)) for p in parts])
    return concatenate(list(parts), -1)


def slice_axis(t: Tensor, axis: int, start: int, stop: int, step: int = 1) -> Tensor:
    """Python's slice of one axis; negative places count from the end."""
    axis = axis_of(axis, t.ndim)
    at = range(*slice(start, stop, step).indices(t.shape[axis]))
    i = _i(axis)
    inside = F.lit(False) if not len(at) else (((i - at.start) % at.step == 0) & (i >= min(at)) & (i <= max(at)))
    new = ((i - at.start) / at.step).cast("long") if step != 1 else i - at.start
    return t.reindexed([new if k == axis else _i(k) for k in range(t.ndim)], [len(at) if k == axis else n for k, n in enumerate(t.shape)], inside)


def slice_(t: Tensor, starts: Sequence[int], stops: Sequence[int | None], steps: Sequence[int] | None = None) -> Tensor:
    for k, (a, b) in enumerate(zip(starts, stops, strict=True)):
        t = slice_axis(t, k, a, b, steps[k] if steps else 1)
    return t


def split(t: Tensor, parts, axis: int = 0) -> list[Tensor]:
    """Equal parts (their number must divide the axis), or cuts before given places."""
    n = t.shape[axis_of(axis, t.ndim)]
    if isinstance(parts, int):
        if parts < 1 or n % parts:
            raise ValueError(f"{n} can't be split in {parts} equal parts")
        parts = [n // parts * k for k in range(1, parts)]
    ends = [0, *parts, n]
    return [slice_axis(t, axis, a, max(a, b)) for a, b in zip(ends, ends[1:], strict=False)]


def arraySplit(t: Tensor, parts, axis: int = 0) -> list[Tensor]:
    """As split, but parts may differ by one: the first ones are longer."""
    if isinstance(parts, int):
        n = t.shape[axis_of(axis, t.ndim)]
        parts = [n // parts * k + min(k, n % parts) for k in range(1, parts)]
    return split(t, parts, axis)


def chunk(t: Tensor, size: int, axis: int = 0) -> list[Tensor]:
    """Parts of a fixed size, the last maybe shorter."""
    return split(t, list(range(size, t.shape[axis_of(axis, t.ndim)], size)), axis)


def _split_at(axis: int, least: int):
    def f(t: Tensor, parts) -> list[Tensor]:
        if t.ndim < least:
            raise ValueError(f"at least {least} dimensions are needed")
        return split(t, parts, axis if t.ndim > axis else 0)

    return f


vsplit, hsplit, dsplit = _split_at(0, 2), _split_at(1, 1), _split_at(2, 3)


def tile(t: Tensor, reps) -> Tensor:
    """Copies side by side along each axis; every row is multiplied where it is."""
    reps = [reps] if isinstance(reps, int) else list(reps)
    n = max(t.ndim, len(reps))
    reps = [1] * (n - len(reps)) + reps
    while t.ndim < n:
        t = expandDims(t, 0)
    df = t.df

    def copies(k: int, r: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(r - 1)), lambda c: c * t.shape[k] + _i(k)) if r else F.array().cast("array<long>")

    for k, r in enumerate(reps):
        if r != 1:
            df = df.withColumn(f"i{k}", F.explode(copies(k, r)))
    return Tensor(df.select(*names(n), "v"), [a * b for a, b in zip(t.shape, reps, strict=True)], t.dtype)


def repeat(t: Tensor, repeats: int, axis: int | None = None) -> Tensor:
    """Every element (or slice along the axis) several times in a row."""
    if axis is None:
        t, axis = t.vector(), 0
    axis = axis_of(axis, t.ndim)
    copies = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda c: _i(axis) * repeats + c) if repeats else F.array().cast("array<long>")
    return Tensor(t.df.withColumn(f"i{axis}", F.explode(copies)).select(*t.index, "v"), [n * repeats if k == axis else n for k, n in enumerate(t.shape)], t.dtype)


def roll(t: Tensor, shift, axis=None) -> Tensor:
    """Elements moved on along axes, those that leave coming in again; flat without an axis."""
    if axis is None:
        by = shift if isinstance(shift, int) else sum(shift)
        moved = t.flat().select(F.pmod(F.col("flat") + by, F.lit(max(1, t.size))).alias("flat"), "v")
        return Tensor(moved.select(*coordinates(F.col("flat"), t.shape), "v"), t.shape, t.dtype)
    shifts, axes = ([x] if isinstance(x, int) else list(x) for x in (shift, axis))
    total: dict[int, int] = {}
    for s, a in zip(shifts * (len(axes) if len(shifts) == 1 else 1), axes, strict=True):
        total[axis_of(a, t.ndim)] = total.get(axis_of(a, t.ndim), 0) + s
    return t.reindexed([F.pmod(_i(k) + total.get(k, 0), F.lit(max(1, n))) for k, n in enumerate(t.shape)], t.shape)


def flip(t: Tensor, axis=None) -> Tensor:
    axes = range(t.ndim) if axis is None else [axis_of(a, t.ndim) for a in ([axis] if isinstance(axis, int) else axis)]
    return t.reindexed([n - 1 - _i(k) if k in axes else _i(k) for k, n in enumerate(t.shape)], t.shape)


def fliplr(t: Tensor) -> Tensor:
    return flip(t, 1)


def flipud(t: Tensor) -> Tensor:
    return flip(t, 0)


def rot90(t: Tensor, k: int = 1, axes: tuple[int, int] = (0, 1)) -> Tensor:
    a, b = (axis_of(x, t.ndim) for x in axes)
    for _ in range(k % 4):
        t = swapaxes(flip(t, b), a, b)
    return t


def _sources(n: int, before: int, after: int, mode: str) -> Column:
    """For each place of a padded axis (column p) the place that it copies; null for none."""
    i = F.col("p") - before
    if mode == "edge":
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), i))
    if mode == "wrap":
        return F.pmod(i, F.lit(n))
    if mode == "reflect":
        period = max(1, 2 * (n - 1))
        m = F.pmod(i, F.lit(period))
        return F.when(m < n, m).otherwise(period - m)
    if mode == "symmetric":
        m = F.pmod(i, F.lit(2 * n))
        return F.when(m < n, m).otherwise(2 * n - 1 - m)
    return F.when((i >= 0) & (i < n), i)


def pad(t: Tensor, width, mode: str = "constant", value: float = 0.0) -> Tensor:
    """Axes widened by (before, after), one pair for all or one for each. Modes: constant, edge, reflect, wrap, symmetric, and
    linear_ramp (to ``value``), mean, minimum and maximum of the axis' vectors. Axes are padded one after the other."""
    pairs = [(width, width)] * t.ndim if isinstance(width, int) else [tuple(width)] * t.ndim if isinstance(width[0], int) else [tuple(w) for w in width]
    if mode not in ("constant", "edge", "reflect", "wrap", "symmetric", "linear_ramp", "mean", "minimum", "maximum"):
        raise ValueError(f"unknown mode {mode!r}")
    for k, (before, after) in enumerate(pairs):
        n, others = t.shape[k], t.others(k)
        if not before and not after:
            continue
        shape = [m + before + after if j == k else m for j, m in enumerate(t.shape)]
        inner = t.df.withColumn(f"i{k}", _i(k) + before)
        if mode in ("edge", "reflect", "wrap", "symmetric"):
            if not n:
                raise ValueError("an empty axis has nothing to copy")
            source = t.spark.range(n + before + after).select(F.col("id").alias("p")).select("p", _sources(n, before, after, mode).alias(f"i{k}"))
            df = t.df.join(source, f"i{k}").select(*others, F.col("p").alias(f"i{k}"), "v")
        else:
            rim = F.array(*[F.lit(p).cast("long") for p in [*range(before), *range(n + before, n + before + after)]])
            ends = t.df.groupBy(*others).agg(F.max(F.when(_i(k) == 0, F.col("v"))).alias("first"), F.max(F.when(_i(k) == n - 1, F.col("v"))).alias("last"), F.avg("v").alias("mean"), F.min("v").alias("minimum"), F.max("v").alias("maximum"))
            ends = ends.withColumn("p", F.explode(rim))
            steps = F.when(F.col("p") < before, value + (F.col("first") - value) * F.col("p") / max(1, before)).otherwise(value + (F.col("last") - value) * (n + before + after - 1 - F.col("p")) / max(1, after))
            v = F.lit(float(value)) if mode == "constant" else steps if mode == "linear_ramp" else F.col(mode)
            df = inner.select(*t.index, "v").unionByName(ends.select(*others, F.col("p").alias(f"i{k}"), v.cast("double").alias("v")))
            if mode == "constant" and not n:
                df = Tensor.grid(t.spark, shape, value).df
        t = Tensor(df.select(*t.index, "v"), shape)
    return t


def ndim(t: Tensor) -> int:
    return t.ndim


def shape(t: Tensor) -> tuple[int, ...]:
    return t.shape


def size(t: Tensor) -> int:
    return t.size


def array2string(t: Tensor, separator: str = ", ", precision: int | None = None) -> str:
    """Nested brackets; numbers at ``precision`` places, or as short as they read back the same."""

    def show(x) -> str:
        if isinstance(x, list):
            return "[" + separator.join(map(show, x)) + "]"
        return f"{x:.{precision}f}" if precision is not None else repr(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)

    def plain(x) -> str:
        if isinstance(x, list):
            return "[" + separator.join(map(plain, x)) + "]"
        return repr(x) if x != x or x in (ew.INF, -ew.INF) else show(x)

    return plain(t.toArray())


def materializeAll(*tensors: Tensor) -> list[Tensor]:
    """Tensors as written tables: what follows starts from their results."""
    from ..plans.stage import cut

    return [Tensor(cut(t.df), t.shape, t.dtype) for t in tensors]


def diag(t: Tensor, k: int = 0) -> Tensor:
    """A matrix with a vector on its ``k``-th diagonal, or that diagonal of a matrix."""
    if t.ndim == 1:
        n = t.shape[0] + abs(k)
        return t.reindexed([_i(0) + max(0, -k), _i(0) + max(0, k)], (n, n)).filled()
    if t.ndim != 2:
        raise ValueError("diag takes vectors and matrices")
    m, n = t.shape
    count = max(0, min(m - max(0, -k), n - max(0, k)))
    return t.reindexed([_i(0) - max(0, -k)], (count,), _i(1) == _i(0) + k)


diagonal = diag


def diagflat(t: Tensor, k: int = 0) -> Tensor:
    return diag(t.vector(), k)
