"""Dense linear algebra. Tall matrices are reduced to small ones by sums of products first; small ones are factored in one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..plans.tensor import Tensor
from .algebra import matmul
from .dense import dense
from .shape import transpose


def _square(t: Tensor) -> int:
    if t.ndim != 2 or t.shape[0] != t.shape[1]:
        raise ValueError("a square matrix is needed")
    return t.shape[0]


def _matrix(t: Tensor) -> tuple[int, int]:
    if t.ndim != 2:
        raise ValueError("a matrix is needed")
    return t.shape


def det(t: Tensor) -> Tensor:
    _square(t)
    return dense(t, lambda a: {"v": np.linalg.det(a)}, {"v": ()})["v"]


def slogdet(t: Tensor) -> dict[str, Tensor]:
    """Sign and logarithm of the absolute value, which doesn't overflow."""
    _square(t)

    def f(a):
        sign, log = np.linalg.slogdet(a)
        return {"sign": sign, "logabsdet": log}

    return dense(t, f, {"sign": (), "logabsdet": ()})


def _checked_inverse(a: np.ndarray) -> np.ndarray:
    if a.size and np.linalg.cond(a) > 1e15:
        raise ValueError("singular matrix")
    return np.linalg.inv(a)


def inv(t: Tensor) -> Tensor:
    """A singular matrix is an error."""
    n = _square(t)
    return dense(t, lambda a: {"v": _checked_inverse(a)}, {"v": (n, n)})["v"]


def solve(a: Tensor, b: Tensor) -> Tensor:
    _square(a)
    return dense([a, b], lambda x, y: {"v": np.linalg.solve(x, y)}, {"v": b.shape})["v"]


def gram(t: Tensor) -> Tensor:
    """The products of all pairs of columns: summed over blocks of rows, so the number of rows doesn't matter."""
    _matrix(t)
    return matmul(transpose(t), t)


def lstsq(a: Tensor, b: Tensor, rcond: float | None = None) -> dict[str, Tensor]:
    """x with least squares of a x - b, their sum, rank and singular values of ``a``; by the normal equations of distributed sums.

    Ranks and solutions come from the eigenvalues of the small matrix; those below ``rcond`` times the greatest count as 0.
    """
    m, n = _matrix(a)
    column = b if b.ndim == 2 else b.reindexed([F.col("i0"), F.lit(0)], (b.shape[0], 1))
    right, total = matmul(transpose(a), column), column.df.groupBy("i1").agg(F.sum(F.col("v") * F.col("v")).alias("v")).withColumnRenamed("i1", "i0")
    k = column.shape[1]
    eps, flat = 1e-12 if rcond is None else rcond * rcond, b.ndim != 2

    def f(g, r, t):
        w, v = np.linalg.eigh((g + g.T) / 2)
        keep = w > eps * max(w.max(initial=0), 0)
        x = v[:, keep] @ ((v[:, keep].T @ r) / w[keep, None])
        residual = np.maximum(0, t - 2 * (x * r).sum(axis=0) + (x * (g @ x)).sum(axis=0))
        return {"x": x[:, 0] if flat else x, "residuals": residual, "rank": keep.sum(), "singularValues": np.sqrt(np.maximum(0, w[::-1]))}

    return dense([gram(a), right, Tensor(total, (k,))], f, {"x": (n, k) if b.ndim == 2 else (n,), "residuals": (k,), "rank": (), "singularValues": (n,)})


def pinv(t: Tensor) -> Tensor:
    m, n = _matrix(t)
    return dense(t, lambda a: {"v": np.linalg.pinv(a, 1e-10)}, {"v": (n, m)})["v"]


def singular_values(t: Tensor) -> Tensor:
    """Descending. A matrix that is much longer than wide (or the other way) is reduced to its triangular factor by blocks of rows."""
    m, n = _matrix(t)
    if n > m:
        return singular_values(transpose(t))
    reduced = _triangular(t) if m > 4 * max(1, n) else t
    return dense(reduced, lambda a: {"v": np.linalg.svd(a, compute_uv=False)}, {"v": (min(m, n),)})["v"]


def _triangular(t: Tensor, rows: int = 1 << 12) -> Tensor:
    """The R of a tall matrix: factors of blocks of rows are stacked and factored again."""
    import pandas as pd

    n = t.shape[1]
    rows = max(rows, 2 * n)

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        block, row = int(pdf["block"].iloc[0]), pdf["i0"].to_numpy()
        at, place = np.unique(row, return_inverse=True)
        a = np.zeros((len(at), n))
        a[place, pdf["i1"].to_numpy()] = pdf["v"].to_numpy()
        r = np.linalg.qr(a, mode="r")
        i, j = np.indices(r.shape)
        return pd.DataFrame({"i0": block * n + i.ravel(), "i1": j.ravel(), "v": r.ravel()})

    df, height = t.df, t.shape[0]
    while height > rows:
        blocks = -(-height // rows)
        df = df.withColumn("block", F.floor(F.col("i0") / rows).cast("long")).groupBy("block").applyInPandas(factor, "i0 long, i1 long, v double")
        height = blocks * n
        if blocks == 1:
            break
    return Tensor(df, (height, n))


def matrixRank(t: Tensor, tol: float | None = None) -> Tensor:
    """Singular values above ``tol``, or 1e-10 times the greatest."""
    s = singular_values(t)
    return dense(s, lambda v: {"v": (v > (tol if tol is not None else 1e-10 * v.max(initial=0))).sum()}, {"v": ()})["v"]


rank = matrixRank


def matrixPower(t: Tensor, n: int) -> Tensor:
    """By squaring; negative powers of the inverse."""
    size = _square(t)
    if n == 0:
        return Tensor.grid(t.spark, (size, size), lambda i, j: F.when(i == j, 1.0).otherwise(0.0))
    base, out, n = inv(t) if n < 0 else t, None, abs(n)
    while n:
        if n & 1:
            out = base if out is None else matmul(out, base)
        n >>= 1
        base = matmul(base, base) if n else base
    return out


def cond(t: Tensor, p=2) -> Tensor:
    """Condition number: the ratio of extreme singular values (2, -2), or the norm times the inverse's (1, -1, inf, -inf, 'fro')."""
    if p in (2, -2, None):
        return dense(singular_values(t), lambda s: {"v": (s[0] / s[-1] if s[-1] else np.inf) if p != -2 else s[-1] / s[0]}, {"v": ()})["v"]
    _square(t)
    return dense(t, lambda a: {"v": np.linalg.norm(a, p) * np.linalg.norm(_checked_inverse(a), p)}, {"v": ()})["v"]


def qr(t: Tensor, mode: str = "reduced") -> dict[str, Tensor]:
    m, n = _matrix(t)
    if mode not in ("reduced", "complete"):
        raise ValueError(f"unknown mode {mode!r}")
    k = min(m, n)

    def f(a):
        q, r = np.linalg.qr(a, mode)
        return {"q": q, "r": r}

    return dense(t, f, {"q": (m, m if mode == "complete" else k), "r": (m if mode == "complete" else k, n)})


def svd(t: Tensor, fullMatrices: bool = True) -> dict[str, Tensor]:
    m, n = _matrix(t)
    k = min(m, n)

    def f(a):
        u, s, vt = np.linalg.svd(a, full_matrices=fullMatrices)
        return {"u": u, "s": s, "vt": vt}

    return dense(t, f, {"u": (m, m if fullMatrices else k), "s": (k,), "vt": (n if fullMatrices else k, n)})


def _real(a: np.ndarray, what: str) -> np.ndarray:
    if np.iscomplexobj(a) and np.abs(a.imag).max(initial=0) > 1e-9 * max(1.0, np.abs(a).max(initial=0)):
        raise ValueError(f"{what} are complex; only real ones can be tensors")
    return np.real(a)


def eig(t: Tensor) -> dict[str, Tensor]:
    """Real eigenvalues and eigenvectors (columns); complex ones are an error."""
    n = _square(t)

    def f(a):
        w, v = np.linalg.eig(a)
        return {"values": _real(w, "eigenvalues"), "vectors": _real(v, "eigenvectors")}

    return dense(t, f, {"values": (n,), "vectors": (n, n)})


def eigh(t: Tensor) -> dict[str, Tensor]:
    """Of a symmetric matrix, ascending."""
    n = _square(t)

    def f(a):
        w, v = np.linalg.eigh((a + a.T) / 2)
        return {"values": w, "vectors": v}

    return dense(t, f, {"values": (n,), "vectors": (n, n)})


def eigvals(t: Tensor) -> Tensor:
    n = _square(t)
    return dense(t, lambda a: {"v": _real(np.linalg.eigvals(a), "eigenvalues")}, {"v": (n,)})["v"]


def eigvalsh(t: Tensor) -> Tensor:
    n = _square(t)
    return dense(t, lambda a: {"v": np.linalg.eigvalsh((a + a.T) / 2)}, {"v": (n,)})["v"]


def cholesky(t: Tensor) -> Tensor:
    """The lower factor; a matrix that isn't positive definite is an error."""
    n = _square(t)
    return dense(t, lambda a: {"v": np.linalg.cholesky(a)}, {"v": (n, n)})["v"]


def lu(t: Tensor) -> dict[str, Tensor]:
    """p, l, u with t = p l u, by partial pivoting."""
    m, n = _matrix(t)
    k = min(m, n)

    def f(a):
        u, order, low = a.copy(), np.arange(m), np.zeros((m, k))
        for j in range(k):
            best = j + int(np.abs(u[j:, j]).argmax())
            for x in (u, low):
                x[[j, best]] = x[[best, j]]
            order[[j, best]] = order[[best, j]]
            if u[j, j]:
                low[j + 1 :, j] = u[j + 1 :, j] / u[j, j]
                u[j + 1 :] -= np.outer(low[j + 1 :, j], u[j])
        return {"p": np.eye(m)[order].T, "l": low + np.eye(m, k), "u": np.triu(u[:k])}

    return dense(t, f, {"p": (m, m), "l": (m, k), "u": (k, n)})
