"""Everything on tensors under one roof: ``from tessera import api as np``.

Functions that create tensors take the session first; all others take tensors (and numbers, where elements are meant). The same
operations on columns of any DataFrame are in tessera.functions, estimators and metrics in tessera.operators.ml.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import SparkSession

from .functions import dtype as _dtype
from .functions import elementwise as _ew
from .functions.dtype import promote, result_type  # noqa: F401
from .functions.elementwise import e, inf, isscalar, nan, newaxis, pi  # noqa: F401
from .operators import algebra as _algebra
from .operators import fft as _fft
from .operators import index as _index
from .operators import linalg as _linalg
from .operators import nn as _nn
from .operators import ordered as _ordered
from .operators import poly as _poly
from .operators import reduce as _reduce
from .operators import sets as _sets
from .operators import shape as _shape
from .operators.ml.cluster import KMeans
from .operators.ml.linear import LinearRegression, LogisticRegression
from .operators.ml.mlp import MLPClassifier, MLPRegressor
from .operators.ml.preprocess import MinMaxScaler, StandardScaler
from .plans.tensor import Tensor, elementwise
from .sources import creation as _creation
from .sources import random as _random

UNARY = (
    "sin", "cos", "tan", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "arcsinh", "arccosh", "arctanh", "exp",
    "exp2", "expm1", "log", "log2", "log10", "log1p", "sqrt", "cbrt", "abs", "absolute", "sign", "floor", "ceil",
    "trunc", "fix", "rint", "round", "around", "negative", "neg", "reciprocal", "square", "sinc", "deg2rad",
    "rad2deg", "heaviside", "signbit", "nanToNum", "real", "imag", "conj", "clip", "isnan", "isinf", "isfinite",
    "isneginf", "isposinf", "isreal", "logicalNot", "bitwiseNot",
)
BINARY = (
    "add", "subtract", "sub", "multiply", "mul", "divide", "div", "power", "pow", "floorDivide", "maximum", "minimum",
    "fmax", "fmin", "mod", "remainder", "fmod", "copysign", "hypot", "arctan2", "logaddexp", "logaddexp2", "ldexp",
    "nextafter", "gcd", "lcm", "addScalar", "subScalar", "mulScalar", "divScalar", "powScalar", "equal", "notEqual",
    "less", "lessEqual", "greater", "greaterEqual", "logicalAnd", "logicalOr", "logicalXor", "isclose", "bitwiseAnd",
    "bitwiseOr", "bitwiseXor", "leftShift", "rightShift",
)


def _one(f: Callable) -> Callable:
    @functools.wraps(f)
    def call(t: Tensor, *args, **kwargs) -> Tensor:
        return t.map(lambda v: f(v, *args, **kwargs))

    return call


def _two(f: Callable) -> Callable:
    @functools.wraps(f)
    def call(a, b, *args, **kwargs) -> Tensor:
        return elementwise(lambda x, y: f(x, y, *args, **kwargs), a, b)

    return call


def _parts(f: Callable, names: tuple[str, ...], operands: int) -> Callable:
    @functools.wraps(f)
    def call(*args) -> dict[str, Tensor]:
        return {n: elementwise(lambda *x, n=n: f(*x)[n], *args[:operands]) for n in names}

    return call


modf = _parts(_ew.modf, ("frac", "integ"), 1)
frexp = _parts(_ew.frexp, ("mantissa", "exponent"), 1)
divmod = _parts(_ew.divmod, ("quotient", "remainder"), 2)


def vectorize(f: Callable[..., float]) -> Callable[..., Tensor]:
    """A function of numbers as one of tensors, broadcast; run on Arrow batches."""
    columns = _ew.vectorize(f)
    return lambda *tensors: elementwise(columns, *tensors)


_session: dict[str, SparkSession] = {}


def createBackend(spark: SparkSession | None = None) -> SparkSession:
    """The session that computes; there is one kind."""
    return spark or SparkSession.builder.getOrCreate()


def setBackend(spark: SparkSession) -> None:
    _session["now"] = spark


def getBackend() -> SparkSession:
    """The session that was set, or the active one."""
    return _session.get("now") or createBackend()


def beginBatch() -> None:
    """Nothing: operations are recorded until an action anyway."""


def endBatch(*tensors: Tensor) -> list[Tensor]:
    """Tensors computed and written."""
    return _shape.materializeAll(*tensors)


def withBatch(f: Callable[[], Tensor]) -> Tensor:
    """What ``f`` returns, computed as one query and written."""
    return endBatch(f())[0]


for _name in UNARY:
    globals()[_name] = _one(getattr(_ew, _name))
for _name in BINARY:
    globals()[_name] = _two(getattr(_ew, _name))
for _module in (_creation, _random, _shape, _index, _reduce, _ordered, _sets, _algebra, _linalg, _poly, _fft):
    for _name, _value in list(vars(_module).items()):
        if callable(_value) and not _name.startswith("_") and getattr(_value, "__module__", "").startswith("tessera.") and not isinstance(_value, type) and _name not in globals():
            globals()[_name] = _value

#: Names of the inventory that aren't Python identifiers of their own, or are written otherwise here.
ALIASES = {
    "slice": _shape.slice_,
    "get_by_mask": _index.getByMask,
    "set_by_mask": _index.setByMask,
    "where_op": _index.where,
    "where_cond": _index.where,
    "reshape_infer": _shape.reshape,
    "log_softmax": _reduce.logSoftmax,
    "index_copy": _index.indexCopy,
    "sort_axis": _ordered.sort,
    "argsort_axis": _ordered.argsort,
    "causal_mask": _creation.causalMask,
    "as_type": _creation.astype,
    "nonzero_flat": _index.flatnonzero,
    "repeat_elements": _shape.repeat,
    "random_seed": _random.seed,
    "matmul_f32_auto": _algebra.matmul,
    "max_abs_diff": _algebra.maxAbsDiff,
    "takeAlongAxis": _index.takeAlongAxis,
}
for _name in ("eq", "ne", "lt", "le", "gt", "ge"):
    _full = {"eq": "equal", "ne": "notEqual", "lt": "less", "le": "lessEqual", "gt": "greater", "ge": "greaterEqual"}[_name]
    ALIASES[_name] = ALIASES[f"{_name}_scalar"] = globals()[_full]
for _name in ("maximum", "minimum", "fmax", "fmin"):
    ALIASES[f"{_name}_scalar"] = globals()[_name]


def lookup(name: str):
    """The implementation of an operation by its name in the inventory."""
    for scope in (globals(), ALIASES, vars(_nn), _ml()):
        if name in scope:
            return scope[name]
    raise KeyError(name)


def _ml() -> dict:
    from .operators.ml import cluster, linear, metrics, mlp, preprocess, split

    out: dict = {}
    for module in (cluster, linear, metrics, mlp, preprocess, split):
        out |= {k: v for k, v in vars(module).items() if not k.startswith("_")}
    return out


ESTIMATORS = (StandardScaler, MinMaxScaler, LinearRegression, LogisticRegression, KMeans, MLPClassifier, MLPRegressor)
wrap = _dtype.wrap
