"""Polynomials: coefficients with the highest degree first, as tensors; degrees are small, so coefficients are handled on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..plans.tensor import Tensor


def _same(t: Tensor, coefficients) -> Tensor:
    return Tensor.of(t.spark, np.atleast_1d(np.asarray(coefficients, np.float64)))


def polyval(p: Tensor, x: Tensor) -> Tensor:
    """Horner's scheme as a column expression of every element."""
    coefficients = p.numpy().tolist()
    return x.map(lambda v: ew.polyval(v, coefficients))


def polyadd(a: Tensor, b: Tensor) -> Tensor:
    return _same(a, _aligned(a, b).sum(axis=0))


def polysub(a: Tensor, b: Tensor) -> Tensor:
    x = _aligned(a, b)
    return _same(a, x[0] - x[1])


def _aligned(a: Tensor, b: Tensor) -> np.ndarray:
    n = max(a.size, b.size)
    return np.stack([np.concatenate((np.zeros(n - t.size), t.numpy())) for t in (a, b)])


def polymul(a: Tensor, b: Tensor) -> Tensor:
    return _same(a, np.convolve(a.numpy(), b.numpy()))


def polydiv(u: Tensor, v: Tensor) -> dict[str, Tensor]:
    """Quotient and remainder; a shorter dividend has the quotient 0."""
    a, b = u.numpy(), v.numpy()
    if len(a) < len(b):
        return {"q": _same(u, [0.0]), "r": u}
    q, rest = np.zeros(len(a) - len(b) + 1), a.copy()
    for k in range(len(q)):
        q[k] = rest[k] / b[0]
        rest[k : k + len(b)] -= q[k] * b
    left = np.trim_zeros(np.where(np.abs(rest) > 1e-14, rest, 0.0), "f")
    return {"q": _same(u, q), "r": _same(u, left if len(left) else [0.0])}


def polyder(p: Tensor, m: int = 1) -> Tensor:
    c = p.numpy()
    for _ in range(m):
        c = c[:-1] * np.arange(len(c) - 1, 0, -1) if len(c) > 1 else np.zeros(1)
    return _same(p, c)


def polyint(p: Tensor, m: int = 1, k: float = 0.0) -> Tensor:
    c = p.numpy()
    for _ in range(m):
        c = np.append(c / np.arange(len(c), 0, -1), k)
    return _same(p, c)


def polyfit(x: Tensor, y: Tensor, deg: int) -> Tensor:
    """Least squares: sums of powers in two passes, of x moved and scaled to [-1, 1], so that high degrees keep their digits; the
    coefficients of x itself are expanded on the driver."""
    both = x.flat().withColumnRenamed("v", "x").join(y.flat().withColumnRenamed("v", "y"), "flat")
    ends = both.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    if ends.a is None:
        raise ValueError("nothing to fit")
    middle, scale = (ends.a + ends.b) / 2, ((ends.b - ends.a) / 2) or 1.0
    z = (F.col("x") - middle) / scale
    powers = [F.lit(1.0)]
    for _ in range(2 * deg):
        powers.append(powers[-1] * z)
    row = both.agg(*[F.sum(p).alias(f"s{k}") for k, p in enumerate(powers)], *[F.sum(powers[k] * F.col("y")).alias(f"t{k}") for k in range(deg + 1)]).first()
    g = np.array([[row[f"s{i + j}"] for j in range(deg + 1)] for i in range(deg + 1)])
    c = np.linalg.lstsq(g, np.array([row[f"t{k}"] for k in range(deg + 1)]), rcond=1e-13)[0]
    out = np.zeros(1)
    for a in c[::-1]:
        out = np.convolve(out, [1 / scale, -middle / scale])
        out[-1] += a
    return _same(x, out[-(deg + 1) :])


def roots(p: Tensor) -> list[complex]:
    """All roots, real and complex ones, by decreasing real part."""
    return sorted(np.roots(p.numpy()).tolist(), key=lambda z: (-complex(z).real, -complex(z).imag))
