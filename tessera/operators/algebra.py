"""Broadcasting, products and contractions as joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import elementwise as ew
from ..plans import einsum as plan
from ..plans.tensor import Tensor, axis_of, elementwise, names, scalar

#: Side of the dense blocks in which matrices are multiplied.
BLOCK = 256


def broadcast_shape(*shapes) -> tuple[int, ...]:
    n = max(map(len, shapes), default=0)
    out = []
    for sizes in zip(*[(1,) * (n - len(s)) + tuple(s) for s in shapes], strict=True):
        wide = {x for x in sizes if x != 1}
        if len(wide) > 1:
            raise ValueError(f"shapes {shapes} can't be broadcast")
        out.append(wide.pop() if wide else 1)
    return tuple(out)


def aligned(tensors: list[Tensor]) -> tuple[DataFrame, tuple[int, ...], list[str]]:
    """A table (i0, ..., v0, v1, ...) with a row for each element of the broadcast shape; the shape; the index columns.

    Tensors are joined on axes that both have at more than one place. A tensor of one element is a broadcast row; two that share
    no axis give the outer product that is asked for.
    """
    shape = broadcast_shape(*[t.shape for t in tensors])
    n, df, have = len(shape), None, set()
    for j, t in enumerate(tensors):
        off = n - t.ndim
        own = {off + k for k in range(t.ndim) if t.shape[k] != 1}
        part = t.df.select(*[F.col(f"i{k - off}").alias(f"i{k}") for k in sorted(own)], F.col("v").alias(f"v{j}"))
        if df is None:
            df = part
        elif own & have:
            df = df.join(part, [f"i{k}" for k in sorted(own & have)])
        else:
            df = df.crossJoin(F.broadcast(part) if t.size == 1 else part)
        have |= own
    for k in range(n):
        if k not in have:
            df = df.withColumn(f"i{k}", F.lit(0).cast("long"))
    return df, shape, names(n)


def broadcastTo(t: Tensor, shape) -> Tensor:
    """Axes of size 1, and absent leading ones, repeated: every row is multiplied by the missing indices where it is."""
    shape = tuple(shape)
    if broadcast_shape(t.shape, shape) != shape:
        raise ValueError(f"{t.shape} can't be broadcast to {shape}")
    off, df = len(shape) - t.ndim, t.df.select(*[F.col(f"i{k}").alias(f"i{k + len(shape) - t.ndim}") for k in range(t.ndim)], "v")
    for k, size in enumerate(shape):
        if k < off or (t.shape[k - off] == 1 and size != 1):
            df = df.drop(f"i{k}").withColumn(f"i{k}", F.explode(F.sequence(F.lit(0), F.lit(size - 1).cast("long"))) if size else F.explode(F.array().cast("array<long>")))
    return Tensor(df.select(*names(len(shape)), "v"), shape, t.dtype)


def broadcastArrays(*tensors: Tensor) -> list[Tensor]:
    shape = broadcast_shape(*[t.shape for t in tensors])
    return [broadcastTo(t, shape) for t in tensors]


def outer(a: Tensor, b: Tensor) -> Tensor:
    x, y = a.vector(), b.vector()
    df = x.df.withColumnRenamed("v", "x").crossJoin(y.df.select(F.col("i0").alias("i1"), F.col("v").alias("y")))
    return Tensor(df.select("i0", "i1", (F.col("x") * F.col("y")).alias("v")), (a.size, b.size))


def _dot(a: Tensor, b: Tensor) -> DataFrame:
    if a.size != b.size:
        raise ValueError(f"sizes {a.size} and {b.size} differ")
    both = a.flat().withColumnRenamed("v", "x").join(b.flat().withColumnRenamed("v", "y"), "flat")
    return both.agg(agg.sum(F.col("x") * F.col("y")).alias("v"))


def inner(a: Tensor, b: Tensor) -> Tensor:
    """Sum of products over the last axes; of vectors a single number."""
    if a.ndim <= 1 and b.ndim <= 1:
        return scalar(_dot(a, b))
    letters = "abcdefghij"
    x, y = letters[: a.ndim - 1], letters[a.ndim : a.ndim + b.ndim - 1]
    return einsum(f"{x}z,{y}z->{x}{y}", a, b)


def dot(a: Tensor, b: Tensor) -> Tensor:
    """Of vectors a tensor of shape (1,), else the matrix product."""
    if a.ndim == 1 and b.ndim == 1:
        return Tensor(_dot(a, b).select(F.lit(0).cast("long").alias("i0"), "v"), (1,))
    return matmul(a, b)


def vdot(a: Tensor, b: Tensor) -> Tensor:
    return scalar(_dot(a, b))


def _blocks(df: DataFrame, row: str, col: str, at: str) -> DataFrame:
    """(a, b, cells): dense blocks of a matrix, each gathered from at most BLOCK squared rows."""
    cell = F.struct((F.col(row) % BLOCK).cast("int").alias("r"), (F.col(col) % BLOCK).cast("int").alias("c"), F.col("v"))
    return df.groupBy((F.col(row) / BLOCK).cast("long").alias(f"{at}_row"), (F.col(col) / BLOCK).cast("long").alias(f"{at}_col")).agg(F.collect_list(cell).alias(at))


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def dense(cells: pa.ListScalar) -> np.ndarray:
        out, x = np.zeros((BLOCK, BLOCK)), cells.values
        r, c, v = (x.field(k).to_numpy(zero_copy_only=False) for k in ("r", "c", "v"))
        out[r, c] = v
        return out[: r.max() + 1, : c.max() + 1]

    for b in batches:
        top, left = b.column(0).to_numpy(), b.column(1).to_numpy()
        for k in range(len(b)):
            x, y = dense(b.column(2)[k]), dense(b.column(3)[k])
            n = min(x.shape[1], y.shape[0])
            p = x[:, :n] @ y[:n]
            i, j = np.indices(p.shape)
            yield pa.RecordBatch.from_arrays([pa.array((i + top[k] * BLOCK).ravel()), pa.array((j + left[k] * BLOCK).ravel()), pa.array(p.ravel())], names=["i0", "i1", "v"])


def matmul(a: Tensor, b: Tensor) -> Tensor:
    """Of matrices. Blocks are gathered, joined where they meet, multiplied densely, and the partial products added: a shuffle
    moves m * n * ceil(k / BLOCK) numbers rather than m * n * k."""
    if a.ndim != 2 or b.ndim != 2:
        raise ValueError("matmul takes matrices; batchedMatmul takes more dimensions")
    if a.shape[1] != b.shape[0]:
        raise ValueError(f"shapes {a.shape} and {b.shape} don't match")
    x, y = _blocks(a.df, "i0", "i1", "x"), _blocks(b.df, "i0", "i1", "y")
    pairs = x.join(y, x["x_col"] == y["y_row"]).select(F.col("x_row"), F.col("y_col"), "x", "y")
    parts = pairs.mapInArrow(_multiplied, "i0 long, i1 long, v double")
    if a.shape[1] > BLOCK:
        parts = parts.groupBy("i0", "i1").agg(F.sum("v").alias("v"))
    out = Tensor(parts, (a.shape[0], b.shape[1]))
    return out if a.shape[1] else out.filled()


def batchedMatmul(a: Tensor, b: Tensor) -> Tensor:
    """Matrix products over the last two axes; the axes before are broadcast."""
    if a.ndim < 2 or b.ndim < 2:
        raise ValueError("at least two dimensions are needed")
    return einsum("...ij,...jk->...ik", a, b)


def multiDot(tensors: list[Tensor]) -> Tensor:
    """The product of matrices, multiplied in the order with the fewest operations."""
    if not tensors:
        raise ValueError("no matrices")
    d = [t.shape[0] for t in tensors] + [tensors[-1].shape[-1]]
    best: dict = {(i, i): (0, i) for i in range(len(tensors))}
    for span in range(1, len(tensors)):
        for i in range(len(tensors) - span):
            j = i + span
            best[i, j] = min((best[i, k][0] + best[k + 1, j][0] + d[i] * d[k + 1] * d[j + 1], k) for k in range(i, j))

    def product(i: int, j: int) -> Tensor:
        k = best[i, j][1]
        return tensors[i] if i == j else matmul(product(i, k), product(k + 1, j))

    return product(0, len(tensors) - 1)


def kron(a: Tensor, b: Tensor) -> Tensor:
    """Of matrices, or of vectors as columns."""
    as_matrix = lambda t: t if t.ndim == 2 else Tensor(t.df.select("i0", F.lit(0).cast("long").alias("i1"), "v"), (t.size, 1))
    x, y = as_matrix(a), as_matrix(b)
    df = x.df.crossJoin(y.df.select(F.col("i0").alias("j0"), F.col("i1").alias("j1"), F.col("v").alias("w")))
    return Tensor(df.select(*[(F.col(f"i{k}") * y.shape[k] + F.col(f"j{k}")).alias(f"i{k}") for k in (0, 1)], (F.col("v") * F.col("w")).alias("v")), (x.shape[0] * y.shape[0], x.shape[1] * y.shape[1]))


def tensordot(a: Tensor, b: Tensor, axes: int | tuple = 2) -> Tensor:
    """Contraction of the last axes of ``a`` with the first of ``b`` (a number), or of two lists of axes."""
    if isinstance(axes, int):
        left, right = list(range(a.ndim - axes, a.ndim)), list(range(axes))
    else:
        left, right = ([x] if isinstance(x, int) else list(x) for x in axes)
    left, right = [axis_of(k, a.ndim) for k in left], [axis_of(k, b.ndim) for k in right]
    if [a.shape[k] for k in left] != [b.shape[k] for k in right]:
        raise ValueError("sizes of contracted axes differ")
    letters = iter("abcdefghijklmnopqrstuvwxyz")
    x = [next(letters) for _ in range(a.ndim)]
    y = [x[left[right.index(k)]] if k in right else next(letters) for k in range(b.ndim)]
    out = [c for k, c in enumerate(x) if k not in left] + [c for k, c in enumerate(y) if k not in right]
    return einsum(f"{''.join(x)},{''.join(y)}->{''.join(out)}", a, b)


def einsum(subscripts: str, *tensors: Tensor) -> Tensor:
    """Einstein summation over any number of tensors; a repeated label in one is its diagonal. A full contraction has no dimensions.

    Operands are contracted two by two in the order that needs the fewest products, each a join on common labels and a sum by
    those that are still needed.
    """
    terms, out, sizes = plan.read(subscripts, [t.shape for t in tensors])
    parts = []
    for term, t in zip(terms, tensors, strict=True):
        df = t.df.select(*[F.col(f"i{k}").alias(f"{c}{k}") for k, c in enumerate(term)], "v")
        keep = {}
        for k, c in enumerate(term):
            if t.shape[k] == 1 and sizes[c] != 1:
                continue  # broadcast: it meets every place of the label
            if c in keep:
                df = df.where(F.col(keep[c]) == F.col(f"{c}{k}"))
            else:
                keep[c] = f"{c}{k}"
        parts.append(("".join(keep), df.select(*[F.col(x).alias(f"l_{c}") for c, x in keep.items()], "v")))
    # Labels that one operand alone has are summed before any join.
    for n, (term, df) in enumerate(parts):
        needed = set(out).union(*(t for k, (t, _) in enumerate(parts) if k != n))
        if set(term) - needed:
            kept = "".join(c for c in term if c in needed)
            parts[n] = (kept, df.groupBy(*[f"l_{c}" for c in kept]).agg(agg.sum("v").alias("v")) if kept else df.agg(agg.sum("v").alias("v")))
    for i, j, kept in plan.order([t for t, _ in parts], out, sizes):
        (x, left), (y, right) = parts[i], parts[j]
        shared = [f"l_{c}" for c in x if c in y]
        right = right.withColumnRenamed("v", "w")
        both = left.join(right, shared) if shared else left.crossJoin(right)
        both = both.select(*[f"l_{c}" for c in kept], (F.col("v") * F.col("w")).alias("v"))
        if set(x) | set(y) != set(kept):
            both = both.groupBy(*[f"l_{c}" for c in kept]).agg(agg.sum("v").alias("v")) if kept else both.agg(agg.sum("v").alias("v"))
        parts = [p for k, p in enumerate(parts) if k not in (i, j)] + [(kept, both)]
    term, df = parts[0]
    if set(term) != set(out):
        raise ValueError("an output label is met at size 1 only")
    result = Tensor(df.select(*[F.col(f"l_{c}").alias(f"i{k}") for k, c in enumerate(out)], "v"), [sizes[c] for c in out])
    summed = [sizes[c] for c in sizes if c not in out]
    return result if all(summed) or not out else result.filled()


def cross(a: Tensor, b: Tensor) -> Tensor:
    """Of 3-vectors."""
    if a.shape != (3,) or b.shape != (3,):
        raise ValueError("cross takes vectors of 3 elements")
    both = a.df.withColumnRenamed("v", "x").join(b.df.withColumnRenamed("v", "y"), "i0")
    at = lambda c, k: F.max(F.when(F.col("i0") == k, F.col(c)))
    row = both.agg(*[at(c, k).alias(f"{c}{k}") for c in "xy" for k in range(3)])
    term = lambda i, j: F.col(f"x{i}") * F.col(f"y{j}") - F.col(f"x{j}") * F.col(f"y{i}")
    cells = F.array(*[F.struct(F.lit(k).cast("long").alias("i0"), term((k + 1) % 3, (k + 2) % 3).alias("v")) for k in range(3)])
    return Tensor(row.select(F.inline(cells)), (3,))


def array_equiv(a: Tensor, b: Tensor) -> bool:
    """Whether all elements are equal once broadcast."""
    try:
        broadcast_shape(a.shape, b.shape)
    except ValueError:
        return False
    return bool(elementwise(ew.equal, a, b).df.agg(agg.all("v").alias("x")).first().x)


def arrayEqual(a: Tensor, b: Tensor, equal_nan: bool = False) -> bool:
    if a.shape != b.shape:
        return False
    same = (lambda x, y: F.when(F.isnan(x) & F.isnan(y), 1.0).otherwise(ew.equal(x, y))) if equal_nan else ew.equal
    return bool(elementwise(same, a, b).df.agg(agg.all("v").alias("x")).first().x)


def allclose(a: Tensor, b: Tensor, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
    if a.shape != b.shape:
        raise ValueError("shapes differ")
    return bool(elementwise(lambda x, y: ew.isclose(x, y, rtol, atol), a, b).df.agg(agg.all("v").alias("x")).first().x)


def maxAbsDiff(a: Tensor, b: Tensor) -> Tensor:
    return scalar(elementwise(lambda x, y: F.abs(x - y), a, b).df.agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("v")))
