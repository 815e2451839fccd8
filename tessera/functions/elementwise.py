"""Element-wise operations on columns, with IEEE semantics whatever spark.sql.ansi.enabled says.

Arguments are columns, names of columns, or numbers; everything is computed as double, and predicates give 0.0 or 1.0. A null is
taken as NaN, the only mark of a missing value.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dtype

NAN, INF = float("nan"), float("inf")
pi, e, inf, nan = math.pi, math.e, INF, NAN
newaxis = None

ColumnLike = Column | str | int | float | bool


def num(x: ColumnLike) -> Column:
    """``x`` as a double column without nulls."""
    if isinstance(x, Column):
        return F.coalesce(x.cast("double"), F.lit(NAN))
    return F.coalesce(F.col(x).cast("double"), F.lit(NAN)) if isinstance(x, str) else F.lit(float(x))


def flag(x: Column) -> Column:
    return F.when(x, 1.0).otherwise(0.0)


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != INF)


def _on(n: int) -> Callable:
    """The first ``n`` arguments of the function become double columns."""

    def wrapped(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args, **kwargs):
            return f(*[num(a) for a in args[:n]], *args[n:], **kwargs)

        return call

    return wrapped


def _plain(name: str) -> Callable:
    @_on(1)
    def f(x: Column) -> Column:
        return getattr(F, name)(x)

    f.__name__ = name
    f.__doc__ = f"{name} of each element; NaN out of its domain."
    return f


sin, cos, tan = _plain("sin"), _plain("cos"), _plain("tan")
arcsin, arccos, arctan = _plain("asin"), _plain("acos"), _plain("atan")
sinh, cosh, tanh = _plain("sinh"), _plain("cosh"), _plain("tanh")
arccosh, arctanh = _plain("acosh"), _plain("atanh")
exp, expm1, sqrt, cbrt = _plain("exp"), _plain("expm1"), _plain("sqrt"), _plain("cbrt")
absolute = abs = _plain("abs")
sign, deg2rad, rad2deg, rint = _plain("signum"), _plain("radians"), _plain("degrees"), _plain("rint")


@_on(1)
def arcsinh(x):
    """With the digits of small arguments, which ln(x + sqrt(x * x + 1)) loses, and without the overflow of squares."""
    a = F.abs(x)
    size = F.when(a > 1e8, F.ln(a) + math.log(2)).otherwise(F.log1p(a + a * a / (1 + F.sqrt(a * a + 1))))
    return F.when(x == 0, x).when(x < 0, -size).otherwise(size)


def _log(name: str, zero: float = 0.0) -> Callable:
    @_on(1)
    def f(x: Column) -> Column:
        return F.when(x > zero, getattr(F, name)(x)).when(x == zero, -INF).otherwise(NAN)

    f.__doc__ = f"{name}: -inf at {zero:g}, NaN below."
    return f


log, log2, log10, log1p = _log("ln"), _log("log2"), _log("log10"), _log("log1p", -1.0)


@_on(1)
def exp2(x):
    return F.pow(F.lit(2.0), x)


@_on(1)
def floor(x):
    # Beyond 2**52 every double is whole; within, the long that floor gives is exact.
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


@_on(1)
def ceil(x):
    return F.when(F.abs(x) < 2.0**52, F.ceil(x).cast("double")).otherwise(x)


@_on(1)
def trunc(x):
    """Toward zero."""
    return F.when(x >= 0, floor(x)).otherwise(ceil(x))


fix = trunc


@_on(1)
def around(x, decimals: int = 0):
    """Half to even at ``decimals`` places."""
    p = 10.0**decimals
    return F.rint(x * p) / p if decimals else F.rint(x)


round = around


@_on(1)
def negative(x):
    return -x


neg = negative


@_on(1)
def reciprocal(x):
    return F.pow(x, F.lit(-1.0))


@_on(1)
def square(x):
    return x * x


@_on(1)
def sinc(x):
    return F.when(x == 0, 1.0).otherwise(divide(F.sin(x * math.pi), x * math.pi))


@_on(1)
def heaviside(x, h0: ColumnLike):
    """0, ``h0`` or 1 below, at or above 0; NaN counts as above."""
    return F.when(x < 0, 0.0).when(x == 0, num(h0)).otherwise(1.0)


@_on(1)
def _negative_bit(x):
    return (x < 0) | ((x == 0) & (F.pow(x, F.lit(-1.0)) < 0))


@_on(1)
def signbit(x):
    """1 for negative numbers and -0, 0 for NaN."""
    return flag(_negative_bit(x))


@_on(1)
def modf(x):
    """(frac, integ); the fraction of an infinity is NaN."""
    return F.struct((x - trunc(x)).alias("frac"), trunc(x).alias("integ"))


@_on(1)
def frexp(x):
    """(mantissa, exponent) with the mantissa in [0.5, 1); what has none (0, NaN, infinities) is its own mantissa with exponent 0."""
    plain = _finite(x) & (x != 0)
    first = F.floor(F.log2(F.abs(x))).cast("double") + 1
    # log2 may round across a power of 2; two factors keep the scaling finite at either end of the range.
    half = floor(first / 2)
    m = x / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), first - half)
    up = F.abs(m) >= 1
    m, n = F.when(up, m / 2).when(F.abs(m) < 0.5, m * 2).otherwise(m), F.when(up, first + 1).when(F.abs(m) < 0.5, first - 1).otherwise(first)
    return F.struct(F.when(plain, m).otherwise(x).alias("mantissa"), F.when(plain, n).otherwise(0.0).alias("exponent"))


@_on(1)
def nanToNum(x, nan: float = 0.0, posInf: float | None = None, negInf: float | None = None):
    top = 1.7976931348623157e308
    return F.when(F.isnan(x), float(nan)).when(x == INF, top if posInf is None else float(posInf)).when(x == -INF, -top if negInf is None else float(negInf)).otherwise(x)


@_on(1)
def real(x):
    return x


conj = real


@_on(1)
def imag(x):
    return F.lit(0.0)


@_on(1)
def clip(x, min: ColumnLike | None = None, max: ColumnLike | None = None):
    """Within bounds, an absent one being open; NaN stays."""
    out = x if min is None else F.greatest(x, num(min))
    out = out if max is None else F.least(out, num(max))
    return F.when(F.isnan(x), x).otherwise(out)


def astype(x: ColumnLike, kind: str) -> Column:
    return dtype.wrap(num(x), kind)


@_on(2)
def add(a, b):
    return a + b


@_on(2)
def subtract(a, b):
    return a - b


@_on(2)
def multiply(a, b):
    return a * b


@_on(2)
def divide(a, b):
    """IEEE quotient: x/0 is an infinity of the signs' product, 0/0 is NaN."""
    return F.when(b != 0, F.try_divide(a, b)).when((a == 0) | F.isnan(a), NAN).otherwise(F.signum(a) * F.pow(b, F.lit(-1.0)))


@_on(2)
def power(a, b):
    return F.pow(a, b)


sub, mul, div, pow = subtract, multiply, divide, power
addScalar, subScalar, mulScalar, divScalar, powScalar = add, subtract, multiply, divide, power


@_on(2)
def floorDivide(a, b):
    """The quotient's floor; a zero keeps its sign."""
    q = divide(a, b)
    return F.when(q == 0, q).otherwise(floor(q))


def _either_nan(a: Column, b: Column) -> Column:
    return F.isnan(a) | F.isnan(b)


@_on(2)
def maximum(a, b):
    return F.when(_either_nan(a, b), NAN).otherwise(F.greatest(a, b))


@_on(2)
def minimum(a, b):
    return F.when(_either_nan(a, b), NAN).otherwise(F.least(a, b))


@_on(2)
def fmax(a, b):
    """The greater; NaN only if both are."""
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


@_on(2)
def fmin(a, b):
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))


@_on(2)
def fmod(a, b):
    """Remainder with the dividend's sign; NaN for a divisor of 0."""
    return F.when(b != 0, a % F.when(b != 0, b).otherwise(1.0)).otherwise(NAN)


@_on(2)
def mod(a, b):
    """Remainder with the divisor's sign, zeros too; NaN for a divisor of 0."""
    r = fmod(a, b)
    return F.when(r == 0, F.signum(b) * 0.0).when((r != 0) & ~F.isnan(r) & ((r < 0) != (b < 0)), r + b).otherwise(r)


remainder = mod


def divmod(a: ColumnLike, b: ColumnLike) -> Column:
    return F.struct(floorDivide(a, b).alias("quotient"), mod(a, b).alias("remainder"))


@_on(2)
def copysign(a, b):
    return F.when(_negative_bit(b), -F.abs(a)).otherwise(F.abs(a))


@_on(2)
def hypot(a, b):
    return F.hypot(a, b)


@_on(2)
def arctan2(a, b):
    """The angle of (b, a); signs of zeros tell its side, which F.atan2 doesn't look at."""
    turn = F.when(_negative_bit(b), math.pi).otherwise(0.0)
    return F.when((a == 0) & ~F.isnan(b), F.when(_negative_bit(a), -turn).otherwise(turn)).otherwise(F.atan2(a, b))


def _add_logs(a: Column, b: Column, raised: Callable, logged: Callable) -> Column:
    m = F.greatest(a, b)
    return F.when(_either_nan(a, b), NAN).when(F.abs(m) == INF, m).otherwise(m + logged(raised(a - m) + raised(b - m)))


@_on(2)
def logaddexp(a, b):
    return _add_logs(a, b, F.exp, F.ln)


@_on(2)
def logaddexp2(a, b):
    return _add_logs(a, b, lambda x: F.pow(F.lit(2.0), x), F.log2)


@_on(2)
def ldexp(a, n):
    # In two steps, as 2**n alone may overflow where the product doesn't.
    half = floor(n / 2)
    return a * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), n - half)


def nextafter(x: ColumnLike, y: ColumnLike) -> Column:
    """The next double from ``x`` toward ``y``; no built-in has it, so it is computed on Arrow batches."""
    @F.pandas_udf("double")
    def after(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.nextafter(a, b))

    return num(after(num(x), num(y)))  # Arrow makes NaN a null


def _euclid(a: Column, b: Column) -> Column:
    """At most 90 steps: remainders of doubles below 2**53 shrink at least as fast as Fibonacci numbers."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1.0).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(a.alias("a"), b.alias("b")), step, lambda s: s["a"])


@_on(2)
def gcd(a, b):
    return _euclid(F.abs(F.rint(a)), F.abs(F.rint(b)))


@_on(2)
def lcm(a, b):
    """0 if either is 0."""
    return F.when((F.rint(a) == 0) | (F.rint(b) == 0), 0.0).otherwise(divide(F.abs(F.rint(a)), gcd(a, b)) * F.abs(F.rint(b)))


@_on(2)
def equal(a, b):
    return flag((a == b) & ~_either_nan(a, b))


@_on(2)
def notEqual(a, b):
    return flag((a != b) | _either_nan(a, b))


@_on(2)
def less(a, b):
    return flag((a < b) & ~_either_nan(a, b))


@_on(2)
def lessEqual(a, b):
    return flag((a <= b) & ~_either_nan(a, b))


@_on(2)
def greater(a, b):
    return flag((a > b) & ~_either_nan(a, b))


@_on(2)
def greaterEqual(a, b):
    return flag((a >= b) & ~_either_nan(a, b))


@_on(1)
def isnan(x):
    return flag(F.isnan(x))


@_on(1)
def isinf(x):
    return flag(F.abs(x) == INF)


@_on(1)
def isfinite(x):
    return flag(_finite(x))


@_on(1)
def isneginf(x):
    return flag(x == -INF)


@_on(1)
def isposinf(x):
    return flag(x == INF)


@_on(1)
def isreal(x):
    return F.lit(1.0)


def isscalar(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


@_on(2)
def logicalAnd(a, b):
    return flag((a != 0) & (b != 0))


@_on(2)
def logicalOr(a, b):
    return flag((a != 0) | (b != 0))


@_on(2)
def logicalXor(a, b):
    return flag((a != 0) != (b != 0))


@_on(1)
def logicalNot(x):
    return flag(x == 0)


def _close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    near = F.abs(a - b) <= atol + rtol * F.abs(b)
    return F.when(_either_nan(a, b), False).when(a == b, True).when((F.abs(a) == INF) | (F.abs(b) == INF), False).otherwise(near)


@_on(2)
def isclose(a, b, rtol: float = 1e-5, atol: float = 1e-8):
    """|a - b| <= atol + rtol |b|; equal infinities are close, NaN is close to nothing."""
    return flag(_close(a, b, rtol, atol))


def _int(x: Column) -> Column:
    return dtype.wrap(x, "int32")


@_on(2)
def bitwiseAnd(a, b):
    return _int(a).bitwiseAND(_int(b)).cast("double")


@_on(2)
def bitwiseOr(a, b):
    return _int(a).bitwiseOR(_int(b)).cast("double")


@_on(2)
def bitwiseXor(a, b):
    return _int(a).bitwiseXOR(_int(b)).cast("double")


@_on(1)
def bitwiseNot(x):
    return F.bitwise_not(_int(x)).cast("double")


def _shift(name: str) -> Callable:
    @_on(2)
    def f(a, b):
        return F.call_function(name, _int(a), _int(b)).cast("double")

    f.__doc__ = f"{name} of 32-bit integers by the count modulo 32."
    return f


leftShift, rightShift = _shift("shiftleft"), _shift("shiftright")


@_on(1)
def where(condition, x: ColumnLike, y: ColumnLike):
    return F.when(condition != 0, num(x)).otherwise(num(y))


def select(conditions: list[ColumnLike], choices: list[ColumnLike], default: float = 0.0) -> Column:
    """The choice of the first condition that isn't 0."""
    if len(conditions) != len(choices):
        raise ValueError("as many choices as conditions are needed")
    out = None
    for c, x in zip(conditions, choices, strict=True):
        out = F.when(num(c) != 0, num(x)) if out is None else out.when(num(c) != 0, num(x))
    return F.lit(float(default)) if out is None else out.otherwise(float(default))


def choose(index: ColumnLike, choices: list[ColumnLike], mode: str = "raise") -> Column:
    """The choice at ``index``; beyond them an error, the index modulo their number (wrap), or the nearest one (clip)."""
    n, i = len(choices), trunc(num(index))
    if mode == "wrap":
        i = mod(i, n)
    elif mode == "clip":
        i = clip(i, 0, n - 1)
    elif mode != "raise":
        raise ValueError(f"unknown mode {mode!r}")
    found = F.get(F.array(*[num(c) for c in choices]), F.when((i >= 0) & (i < n), i).cast("int"))
    return F.when((i >= 0) & (i < n), found).otherwise(F.raise_error(F.lit("index out of bounds of the choices")).cast("double"))


def piecewise(x: ColumnLike, conditions: list[ColumnLike], functions: list, default: float = 0.0) -> Column:
    """The first true condition's function of ``x``; a function more than conditions is for the rest. Numbers are constants."""
    x = num(x)
    value = lambda f: num(f(x)) if callable(f) else num(f)
    if len(functions) not in (len(conditions), len(conditions) + 1):
        raise ValueError("a function for each condition, and one more at most, is needed")
    rest = value(functions[-1]) if len(functions) > len(conditions) else F.lit(float(default))
    out = None
    for c, f in zip(conditions, functions, strict=False):
        out = F.when(num(c) != 0, value(f)) if out is None else out.when(num(c) != 0, value(f))
    return rest if out is None else out.otherwise(rest)


def vectorize(function: Callable[..., float]) -> Callable[..., Column]:
    """A function of numbers as one of columns, run on Arrow batches; one written in column operations needs no such step."""
    def call(*columns: ColumnLike) -> Column:
        @F.pandas_udf("double")
        def run(*parts: pd.Series) -> pd.Series:
            return pd.Series(np.fromiter((float(function(*row)) for row in zip(*parts, strict=True)), np.float64, len(parts[0])))

        return num(run(*[num(c) for c in columns]))

    return call


# Activations and the like of tensor inference.


@_on(1)
def relu(x):
    """max(0, x); NaN stays."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(x, F.lit(0.0)))


@_on(1)
def relu6(x):
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(6.0)))


@_on(1)
def leakyRelu(x, slope: float = 0.01):
    return F.when((x > 0) & ~F.isnan(x), x).otherwise(x * slope)


@_on(1)
def gelu(x):
    """By the tanh approximation."""
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


@_on(1)
def sigmoid(x):
    return 1 / (1 + F.exp(-x))


@_on(1)
def silu(x):
    return x * sigmoid(x)


@_on(1)
def rsqrt(x):
    return F.pow(x, F.lit(-0.5))


@_on(1)
def dequantizeLinear(x, scale: float, zero_point: float):
    return (x - zero_point) * scale


@_on(2)
def addRelu(a, b):
    return relu(a + b)


@_on(1)
def polyval(x, coefficients: list[float]):
    """Horner's scheme, the highest degree first; 0 without coefficients."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + float(c)
    return out
