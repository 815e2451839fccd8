"""Discrete Fourier transforms of real and complex tensors, complex ones as {real, imag}; and polynomials' roots have their own module."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..plans.tensor import Tensor
from .dense import dense
from .shape import roll


def _pair(inputs: list[Tensor], f, shape) -> dict[str, Tensor]:
    def run(*arrays):
        z = f(arrays[0] if len(arrays) == 1 else arrays[0] + 1j * arrays[1])
        return {"real": z.real, "imag": z.imag}

    return dense(inputs, run, {"real": shape, "imag": shape})


def _vector(t: Tensor) -> Tensor:
    if t.ndim != 1:
        raise ValueError("a vector is needed")
    return t


def fft(t: Tensor) -> dict[str, Tensor]:
    return _pair([_vector(t)], np.fft.fft, t.shape)


def ifft(real: Tensor, imag: Tensor) -> dict[str, Tensor]:
    return _pair([_vector(real), imag], np.fft.ifft, real.shape)


def fft2(t: Tensor) -> dict[str, Tensor]:
    if t.ndim != 2:
        raise ValueError("a matrix is needed")
    return _pair([t], np.fft.fft2, t.shape)


def ifft2(real: Tensor, imag: Tensor) -> dict[str, Tensor]:
    return _pair([real, imag], np.fft.ifft2, real.shape)


def fftn(t: Tensor) -> dict[str, Tensor]:
    return _pair([t], np.fft.fftn, t.shape)


def ifftn(real: Tensor, imag: Tensor) -> dict[str, Tensor]:
    return _pair([real, imag], np.fft.ifftn, real.shape)


def rfft(t: Tensor) -> dict[str, Tensor]:
    return _pair([_vector(t)], np.fft.rfft, (t.size // 2 + 1,))


def irfft(real: Tensor, imag: Tensor, n: int | None = None) -> Tensor:
    n = 2 * (real.size - 1) if n is None else n
    return dense([real, imag], lambda a, b: {"v": np.fft.irfft(a + 1j * b, n)}, {"v": (n,)})["v"]


def fftshift(t: Tensor) -> Tensor:
    """Zero frequency to the middle of every axis."""
    return roll(t, [n // 2 for n in t.shape], list(range(t.ndim)))


def ifftshift(t: Tensor) -> Tensor:
    return roll(t, [-(n // 2) for n in t.shape], list(range(t.ndim)))


def power(t: Tensor, frequencies: list[int]) -> Tensor:
    """|X[k]|**2 of a vector at a few frequencies: sums of products with sines and cosines in one pass, for vectors of any length."""
    n = t.size
    angle = lambda k: F.lit(2 * np.pi / n) * ((F.col("i0") * k) % n)
    sums = [s for k in frequencies for s in (F.sum(F.col("v") * F.cos(angle(k))).alias(f"c{k}"), F.sum(F.col("v") * F.sin(angle(k))).alias(f"s{k}"))]
    row = t.df.agg(*sums)
    cells = F.array(*[F.struct(F.lit(j).cast("long").alias("i0"), (F.col(f"c{k}") * F.col(f"c{k}") + F.col(f"s{k}") * F.col(f"s{k}")).alias("v")) for j, k in enumerate(frequencies)])
    return Tensor(row.select(F.inline(cells)), (len(frequencies),))
