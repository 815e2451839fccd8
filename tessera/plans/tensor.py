"""n-dimensional arrays as tables: one row for each element, with its indices and value."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce as fold

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dtype as kinds
from ..functions import elementwise as ew

#: Elements that dense routines (factorizations, transforms) may gather in one task, and that the driver may collect.
DENSE = 1 << 26


def strides(shape: Sequence[int]) -> list[int]:
    """Distance in row-major order of neighbours along each axis."""
    return [math.prod(shape[k + 1 :]) for k in range(len(shape))]


def names(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


def flat_index(shape: Sequence[int], prefix: str = "i") -> Column:
    """Row-major position of an element."""
    return fold(lambda a, b: a + b, [F.col(f"{prefix}{k}") * s for k, s in enumerate(strides(shape))], F.lit(0).cast("long"))


def coordinates(flat: Column, shape: Sequence[int]) -> list[Column]:
    """Indices of the element at row-major position ``flat``."""
    out = []
    for k, (n, s) in enumerate(zip(shape, strides(shape), strict=True)):
        # flat - flat % s is a multiple of s, so the quotient is whole; below 2**53 the double is exact.
        x = ((flat - flat % s) / s).cast("long") if s > 1 else flat
        out.append((x if k == 0 else x % max(1, n)).cast("long").alias(f"i{k}"))
    return out


def axis_of(axis: int, n: int) -> int:
    if not -n <= axis < n:
        raise ValueError(f"axis {axis} is out of bounds for {n} dimensions")
    return axis % n


def normal_shape(shape: int | Sequence[int]) -> tuple[int, ...]:
    shape = (shape,) if isinstance(shape, int) else tuple(int(n) for n in shape)
    if any(n < 0 for n in shape):
        raise ValueError(f"negative dimensions in {shape}")
    return shape


class Tensor:
    """A dense array: ``df`` has a row (i0, i1, ..., v) for each element of ``shape``; v is a double without nulls.

    Nothing is computed until an action. Every operation returns a new tensor, also those that array packages do in place.
    """

    def __init__(self, df: DataFrame, shape: Sequence[int], dtype: str = "float64"):
        self.df, self.shape, self.dtype = df, normal_shape(shape), dtype

    def __repr__(self) -> str:
        return f"Tensor(shape={self.shape}, dtype={self.dtype!r})"

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def index(self) -> list[str]:
        return names(self.ndim)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def T(self) -> Tensor:
        from ..operators.shape import transpose

        return transpose(self)

    def others(self, axis: int) -> list[str]:
        return [c for k, c in enumerate(self.index) if k != axis]

    @classmethod
    def grid(cls, spark: SparkSession, shape: int | Sequence[int], value: Callable[..., Column] | float, dtype: str = "float64") -> Tensor:
        """Elements from their indices: ``value(i0, i1, ...)``, or a constant. Rows are generated by the executors."""
        shape = normal_shape(shape)
        df = spark.range(math.prod(shape)).select(F.col("id").alias("flat"), *coordinates(F.col("id"), shape))
        v = value(*[F.col(c) for c in names(len(shape))]) if callable(value) else F.lit(float(value))
        return cls(df.select(*names(len(shape)), typed(v, dtype).alias("v")), shape, dtype)

    @classmethod
    def of(cls, spark: SparkSession, data, shape: Sequence[int] | None = None, dtype: str = "float64") -> Tensor:
        """From nested lists or a NumPy array on the driver."""
        a = np.asarray(data, dtype=np.float64)
        a = a.reshape(shape) if shape is not None else a
        import pandas as pd

        flat = spark.createDataFrame(pd.DataFrame({"flat": np.arange(a.size), "v": a.ravel()}), "flat long, v double")
        return cls(flat.select(*coordinates(F.col("flat"), a.shape), typed(F.col("v"), dtype).alias("v")), a.shape, dtype)

    @classmethod
    def from_table(cls, df: DataFrame, value: str, key: str | Sequence[str]) -> Tensor:
        """A column as a vector in the order of ``key``, which must tell rows apart. Runs a job for the number of rows."""
        from .order import ranked

        keys = [key] if isinstance(key, str) else list(key)
        out = ranked(df.select(*[F.col(k).alias(f"k{j}") for j, k in enumerate(keys)], ew.num(F.col(value)).alias("v")), [f"k{j}" for j in range(len(keys))])
        return cls(out.df.select((F.col("rank") - 1).alias("i0"), "v"), (out.count,))

    @classmethod
    def from_features(cls, df: DataFrame, columns: Sequence[str], key: str | Sequence[str]) -> Tensor:
        """Columns as a matrix, a row for each row of ``df`` in the order of ``key``."""
        from .order import ranked

        keys = [key] if isinstance(key, str) else list(key)
        each = F.array(*[F.struct(F.lit(j).cast("long").alias("i1"), ew.num(F.col(c)).alias("v")) for j, c in enumerate(columns)])
        out = ranked(df.select(*[F.col(k).alias(f"k{j}") for j, k in enumerate(keys)], each.alias("each")), [f"k{j}" for j in range(len(keys))])
        return cls(out.df.select((F.col("rank") - 1).alias("i0"), F.inline("each")), (out.count, len(columns)))

    @classmethod
    def from_arrays(cls, df: DataFrame, column: str, key: str | Sequence[str], width: int) -> Tensor:
        """An array column of ``width`` numbers as a matrix, a row for each row of ``df`` in the order of ``key``."""
        from .order import ranked

        keys = [key] if isinstance(key, str) else list(key)
        out = ranked(df.select(*[F.col(k).alias(f"k{j}") for j, k in enumerate(keys)], F.col(column).alias("each")), [f"k{j}" for j in range(len(keys))])
        cells = out.df.select((F.col("rank") - 1).alias("i0"), F.posexplode("each"))
        return cls(cells.select("i0", F.col("pos").cast("long").alias("i1"), ew.num(F.col("col")).alias("v")), (out.count, width))

    def map(self, f: Callable[[Column], Column], dtype: str = "float64") -> Tensor:
        """``f`` of each element."""
        return Tensor(self.df.select(*self.index, typed(f(F.col("v")), dtype).alias("v")), self.shape, dtype)

    def reindexed(self, index: Sequence[Column], shape: Sequence[int], where: Column | None = None) -> Tensor:
        """Elements at new indices, computed from the old ones, that satisfy ``where``: no shuffle."""
        df = self.df if where is None else self.df.where(where)
        return Tensor(df.select(*[c.cast("long").alias(f"i{k}") for k, c in enumerate(index)], "v"), shape, self.dtype)

    def flat(self) -> DataFrame:
        """(flat, v): elements by row-major position."""
        return self.df.select(flat_index(self.shape).alias("flat"), "v")

    def vector(self) -> Tensor:
        return Tensor(self.df.select(flat_index(self.shape).alias("i0"), "v"), (self.size,), self.dtype)

    def filled(self, value: float = 0.0) -> Tensor:
        """The tensor with ``value`` at indices that have no row."""
        every = Tensor.grid(self.spark, self.shape, value)
        here = self.df.withColumnRenamed("v", "here")
        df = every.df.join(here, self.index, "left") if self.index else every.df.crossJoin(here)
        return Tensor(df.select(*self.index, F.coalesce("here", "v").alias("v")), self.shape, self.dtype)

    def numpy(self) -> np.ndarray:
        """The elements on the driver; refused beyond DENSE of them."""
        if self.size > DENSE:
            raise ValueError(f"{self.size} elements don't fit the driver; the bound is {DENSE}")
        rows = self.flat().toPandas()
        out = np.zeros(self.size)
        out[rows["flat"].to_numpy(np.int64)] = rows["v"].to_numpy(np.float64)
        return out.reshape(self.shape)

    def item(self) -> float:
        if self.size != 1:
            raise ValueError("only a single element is an item")
        return float(self.df.first()["v"])

    def toArray(self) -> list:
        return self.numpy().tolist()


def typed(v: Column, dtype: str) -> Column:
    return ew.num(v) if dtype == "float64" else kinds.wrap(v, dtype).cast("double")


def scalar(df: DataFrame, dtype: str = "float64") -> Tensor:
    """A one-row table (v) as a tensor without dimensions."""
    return Tensor(df, (), dtype)


def elementwise(f: Callable[..., Column], *operands) -> Tensor:
    """``f`` of elements that stand at the same place once shapes are broadcast; numbers are constants.

    Operands are joined on the axes they share with the result's; an axis of size 1 isn't a key, so a row vector meets a
    matrix by its column only.
    """
    from ..operators.algebra import aligned

    tensors = [x for x in operands if isinstance(x, Tensor)]
    if not tensors:
        raise ValueError("a tensor is needed")
    df, shape, index = aligned(tensors)
    values = iter(range(len(tensors)))
    args = [F.col(f"v{next(values)}") if isinstance(x, Tensor) else F.lit(float(x)) for x in operands]
    return Tensor(df.select(*index, ew.num(f(*args)).alias("v")), shape)
