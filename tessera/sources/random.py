"""Seeded random tensors. Every element is drawn from hashes of its position and the seed: the same whatever the partitions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..plans.order import ranked
from ..plans.tensor import Tensor, coordinates, normal_shape
from . import xorshift

_state = {"seed": 0, "draws": 0, "sequence": False}


def seed(s: int, sequence: bool = False) -> None:
    """The seed of draws that are given none; draw after draw they use the numbers that follow.

    With ``sequence``, rand, uniform, randint, randn and normal (and their other names) take them from the 32-bit xorshift sequence of
    the seed, one after the other: the same numbers as array packages that step through it. Its period is 2^32 - 1, which is too
    short for very large tensors; so hashes of positions are the default, and what other draws use in any case.
    """
    _state.update(seed=int(s), draws=0, sequence=sequence)


def _stepped(spark: SparkSession, shape, value: Callable[[Callable[[Column], Column], Column], Column], dtype: str, per: int = 1) -> Tensor:
    """A tensor of the sequence: ``value`` gets the numbers by position and the element's position; the sequence moves on by what was used."""
    shape, first, s = normal_shape(shape), _state["draws"], _state["seed"]
    size = math.prod(shape)
    _state["draws"] = first + (size + per - 1) // per * per
    df = spark.range(size).select(*coordinates(F.col("id"), shape), ew.num(value(lambda p: xorshift.unit(p + first, s), F.col("id"))).alias("v"))
    out = Tensor(df, shape)
    return out if dtype == "float64" else out.map(lambda v: v, dtype)


def _pairs(u: Callable[[Column], Column], i: Column) -> Column:
    """Standard normal by Box and Muller: an even element and the odd one after it are cosine and sine of one pair of numbers."""
    even = i - i % 2
    first = u(even)
    size = F.sqrt(-2 * F.ln(F.when(first == 0, 1e-10).otherwise(first)))
    turn = 2 * math.pi * u(even + 1)
    return size * F.when(i % 2 == 0, F.cos(turn)).otherwise(F.sin(turn))


randomSeed = seed


def _next(given: int | None) -> int:
    if given is not None:
        return given
    _state["draws"] += 1
    return _state["seed"] * 1_000_003 + _state["draws"]


def unit(position: Column, s: int, stream: int = 0) -> Column:
    """Uniform in (0, 1): the upper 52 bits of a hash, half a step from either end."""
    return (F.shiftrightunsigned(F.xxhash64(position, F.lit(s).cast("long"), F.lit(stream)), 12) + 0.5) * 2.0**-52


def gauss(position: Column, s: int, stream: int = 0) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(-2 * F.ln(unit(position, s, stream))) * F.cos(2 * math.pi * unit(position, s, stream + 1))


def _drawn(spark: SparkSession, shape, value: Callable[[Column, int], Column], given: int | None, dtype: str = "float64") -> Tensor:
    shape, s = normal_shape(shape), _next(given)
    df = spark.range(math.prod(shape)).select(*coordinates(F.col("id"), shape), ew.num(value(F.col("id"), s)).alias("v"))
    out = Tensor(df, shape)
    return out if dtype == "float64" else out.map(lambda v: v, dtype)


def _in_sequence(seed: int | None) -> bool:
    return seed is None and _state["sequence"]


def rand(spark: SparkSession, shape, dtype: str = "float64", seed: int | None = None) -> Tensor:
    if _in_sequence(seed):
        return _stepped(spark, shape, lambda u, i: u(i), dtype)
    return _drawn(spark, shape, unit, seed, dtype)


random = rand


def randn(spark: SparkSession, shape, dtype: str = "float64", seed: int | None = None) -> Tensor:
    if _in_sequence(seed):
        return _stepped(spark, shape, _pairs, dtype, 2)
    return _drawn(spark, shape, gauss, seed, dtype)


standardNormal = randn


def normal(spark, loc: float, scale: float, shape, dtype: str = "float64", seed: int | None = None) -> Tensor:
    if _in_sequence(seed):
        return _stepped(spark, shape, lambda u, i: _pairs(u, i) * scale + loc, dtype, 2)
    return _drawn(spark, shape, lambda i, s: loc + scale * gauss(i, s), seed, dtype)


def randint(spark, low: int, high: int, shape, dtype: str = "float64", seed: int | None = None) -> Tensor:
    """Whole numbers from ``low`` up to, not including, ``high``; in a sequence, ``high`` itself once in 2^32 draws."""
    if _in_sequence(seed):
        return _stepped(spark, shape, lambda u, i: F.floor(u(i) * (high - low)) + low, dtype)
    return _drawn(spark, shape, lambda i, s: F.floor(unit(i, s) * (high - low)) + low, seed, dtype)


def uniform(spark, low: float, high: float, shape, dtype: str = "float64", seed: int | None = None) -> Tensor:
    if _in_sequence(seed):
        return _stepped(spark, shape, lambda u, i: u(i) * (high - low) + low, dtype)
    return _drawn(spark, shape, lambda i, s: low + (high - low) * unit(i, s), seed, dtype)


def exponential(spark, scale: float, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, lambda i, s: -scale * F.ln(unit(i, s)), seed)


def geometric(spark, p: float, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, lambda i, s: F.greatest(F.lit(1.0), F.ceil(F.ln(unit(i, s)) / math.log1p(-p))) if p < 1 else F.lit(1.0), seed)


def lognormal(spark, mean: float, sigma: float, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, lambda i, s: F.exp(mean + sigma * gauss(i, s)), seed)


def weibull(spark, a: float, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, lambda i, s: F.pow(-F.ln(unit(i, s)), F.lit(1.0 / a)), seed)


def pareto(spark, a: float, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, lambda i, s: F.pow(unit(i, s), F.lit(-1.0 / a)) - 1, seed)


def rayleigh(spark, scale: float, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, lambda i, s: scale * F.sqrt(-2 * F.ln(unit(i, s))), seed)


def standardCauchy(spark, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, lambda i, s: F.tan(math.pi * (unit(i, s) - 0.5)), seed)


def triangular(spark, left: float, mode: float, right: float, shape, seed: int | None = None) -> Tensor:
    c = (mode - left) / (right - left)
    return _drawn(spark, shape, lambda i, s: F.when(unit(i, s) < c, left + F.sqrt(unit(i, s) * (right - left) * (mode - left))).otherwise(right - F.sqrt((1 - unit(i, s)) * (right - left) * (right - mode))), seed)


def wald(spark, mean: float, scale: float, shape, seed: int | None = None) -> Tensor:
    """The smaller root of a chi-square's equation, or the other one by chance."""

    def value(i: Column, s: int) -> Column:
        y = mean * gauss(i, s) * gauss(i, s)
        x = mean + mean / (2 * scale) * (y - F.sqrt(4 * scale * y + y * y))
        return F.when(unit(i, s, 7) <= mean / (mean + x), x).otherwise(mean * mean / x)

    return _drawn(spark, shape, value, seed)


#: Elements that one generator draws together.
BLOCK = 1 << 12


def _by_numpy(draw: Callable[[np.random.Generator, int], np.ndarray]) -> Callable[[Column, int], Column]:
    """Draws without a closed form: a generator for each block of positions, on Arrow batches. A block is drawn whole wherever a part
    of it is asked for, so partitions don't matter."""

    def value(position: Column, s: int) -> Column:
        @F.pandas_udf("double")
        def run(places: pd.Series) -> pd.Series:
            at = places.to_numpy(np.int64)
            out = np.empty(len(at))
            blocks, which = np.unique(at // BLOCK, return_inverse=True)
            for k, block in enumerate(blocks.tolist()):
                mine = which == k
                drawn = draw(np.random.Generator(np.random.PCG64([s & (2**64 - 1), block])), BLOCK)
                out[mine] = drawn[at[mine] % BLOCK]
            return pd.Series(out)

        return run(position)

    return value


def poisson(spark, lam: float, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, _by_numpy(lambda g, count: g.poisson(lam, count)), seed)


def binomial(spark, n: int, p: float, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, _by_numpy(lambda g, count: g.binomial(n, p, count)), seed)


def negativeBinomial(spark, n: float, p: float, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, _by_numpy(lambda g, count: g.negative_binomial(n, p, count)), seed)


def hypergeometric(spark, ngood: int, nbad: int, nsample: int, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, _by_numpy(lambda g, count: g.hypergeometric(ngood, nbad, nsample, count)), seed)


def beta(spark, a: float, b: float, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, _by_numpy(lambda g, count: g.beta(a, b, count)), seed)


def gamma(spark, shape_param: float, scale: float, size, seed: int | None = None) -> Tensor:
    return _drawn(spark, size, _by_numpy(lambda g, count: g.gamma(shape_param, scale, count)), seed)


def chisquare(spark, df: float, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, _by_numpy(lambda g, count: g.chisquare(df, count)), seed)


def standardT(spark, df: float, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, _by_numpy(lambda g, count: g.standard_t(df, count)), seed)


def f(spark, dfnum: float, dfden: float, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, _by_numpy(lambda g, count: g.f(dfnum, dfden, count)), seed)


def vonmises(spark, mu: float, kappa: float, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, _by_numpy(lambda g, count: g.vonmises(mu, kappa, count)), seed)


def zipf(spark, a: float, shape, seed: int | None = None) -> Tensor:
    return _drawn(spark, shape, _by_numpy(lambda g, count: g.zipf(a, count)), seed)


def _vectors(spark, size: int, width: int, draw: Callable[[np.random.Generator], np.ndarray], given: int | None) -> Tensor:
    """``size`` vectors of ``width`` numbers, each from a generator of its own."""

    @F.pandas_udf("array<double>")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(draw(np.random.Generator(np.random.PCG64(k & (2**64 - 1)))), np.float64) for k in keys.tolist()])

    rows = spark.range(size).select(F.col("id").alias("i0"), F.posexplode(run(F.xxhash64("id", F.lit(_next(given)).cast("long")))))
    return Tensor(rows.select("i0", F.col("pos").cast("long").alias("i1"), F.col("col").alias("v")), (size, width))


def multinomial(spark, n: int, pvals, size: int = 1, seed: int | None = None) -> Tensor:
    return _vectors(spark, size, len(pvals), lambda g: g.multinomial(n, pvals), seed)


def dirichlet(spark, alpha, size: int = 1, seed: int | None = None) -> Tensor:
    return _vectors(spark, size, len(alpha), lambda g: g.dirichlet(alpha), seed)


def multivariateNormal(mean: Tensor, cov: Tensor, size: int = 1, seed: int | None = None) -> Tensor:
    """mean + L z with the Cholesky factor L of ``cov`` and standard normal z."""
    m, low = mean.numpy(), np.linalg.cholesky(cov.numpy())
    return _vectors(mean.spark, size, len(m), lambda g: m + low @ g.standard_normal(len(m)), seed)


def permutation(x: int | Tensor, spark: SparkSession | None = None, seed: int | None = None) -> Tensor:
    """0, ..., n - 1, or the slices of a tensor along its first axis, in random order."""
    s = _next(seed)
    if isinstance(x, int):
        x = Tensor.grid(spark, x, lambda i: i)
    places = ranked(x.spark.range(x.shape[0]).select(F.col("id").alias("i0"), F.xxhash64("id", F.lit(s).cast("long")).alias("h")), ["h", "i0"]).df
    moved = x.df.join(places.select("i0", (F.col("rank") - 1).alias("to")), "i0")
    return Tensor(moved.select(F.col("to").alias("i0"), *x.index[1:], "v"), x.shape, x.dtype)


def shuffle(t: Tensor, seed: int | None = None) -> Tensor:
    """Slices along the first axis in random order, as a new tensor."""
    return permutation(t, seed=seed)


def choice(t: Tensor, size: int, replace: bool = True, p: list[float] | Tensor | None = None, seed: int | None = None) -> Tensor:
    """``size`` elements of a vector, by weights ``p``, with or without putting them back.

    With: a draw looks its number up in the running totals of weights. Without: the ``size`` least of exponential keys over weights.
    """
    s, spark = _next(seed), t.spark
    n = t.size
    weights = None if p is None else (p if isinstance(p, Tensor) else Tensor.of(spark, p))
    if not replace:
        if size > n:
            raise ValueError("more draws than elements")
        df = t.flat()
        w = F.lit(1.0)
        if weights is not None:
            df, w = df.join(weights.flat().withColumnRenamed("v", "w"), "flat"), F.col("w")
        keyed = df.select("flat", "v", F.when(w > 0, -F.ln(unit(F.col("flat"), s)) / F.when(w > 0, w).otherwise(1.0)).otherwise(ew.INF).alias("key"))
        out = ranked(keyed, ["key", "flat"]).df
        return Tensor(out.where(F.col("rank") <= size).select((F.col("rank") - 1).alias("i0"), "v"), (size,))
    draws = spark.range(size).select(F.col("id").alias("i0"), unit(F.col("id"), s).alias("u"))
    if weights is None:
        draws = draws.select("i0", F.floor(F.col("u") * n).alias("flat"))
    else:
        from ..operators.ordered import cumsum, searchsorted

        totals = cumsum(weights.vector())
        whole = weights.df.agg(F.sum("v").alias("t"))
        wanted = Tensor(draws.crossJoin(F.broadcast(whole)).select("i0", (F.col("u") * F.col("t")).alias("v")), (size,))
        draws = searchsorted(totals, wanted, "right").df.select("i0", F.least(F.col("v").cast("long"), F.lit(n - 1)).alias("flat"))
    return Tensor(draws.join(t.flat(), "flat").select("i0", "v"), (size,))
