"""Queries over the standard tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, listings
from .functions import aggregates as agg
from .functions import elementwise as ew
from .operators import nn
from .operators.fft import power as dft_power_of
from .operators.ml import metrics
from .operators.ml.cluster import KMeans
from .operators.ml.linear import LinearRegression, LogisticRegression
from .operators.ml.preprocess import MinMaxScaler, StandardScaler
from .operators.ml.split import trainTestSplit
from .plans.quantiles import quantiles
from .plans.tensor import Tensor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column, n: int = 6) -> Column:
    return F.round(x, n)


def rounded(t: Tensor | DataFrame, n: int = 6) -> DataFrame:
    df = t.df if isinstance(t, Tensor) else t
    return df.withColumn("v", r(F.col("v"), n))


def signed(x: Column, n: int = 9) -> Column:
    """Rounded as SQL over doubles does it: the nearest whole number of 10**-n, halves away from zero, in binary; signs of zeros stay.

    F.round takes the shortest decimal of a double instead, which may fall on the other side, and drops the sign of zeros.
    """
    y = x * 10.0**n
    even = F.rint(y)
    nearest = F.when(F.abs(y - even) == 0.5, y + F.signum(y) * 0.5).otherwise(even)
    return F.when(F.abs(y) == ew.INF, x).otherwise(nearest / 10.0**n)


def _listing(df: DataFrame, keys: list[str], exprs: dict[str, Column], n: int | None = 9) -> DataFrame:
    return df.select(*keys, *[(r(e, n) if n is not None else e).alias(k) for k, e in exprs.items()])


def _sql_list(exprs: dict[str, str], n: int | None = 9) -> str:
    return ", ".join(f"round({e}, {n}) AS {k}" if n is not None else f"{e} AS {k}" for k, e in exprs.items())


# Aggregations.

_STATS = {"sum": "sum(x)", "mean": "avg(x)", "var": "var_pop(x)", "std": "stddev_pop(x)", "min": "min(x)", "max": "max(x)", "ptp": "max(x) - min(x)", "median": "median(x)", "q90": "quantile_cont(x, 0.9)"}


@query(f"SELECT l_returnflag, l_linestatus, {_sql_list(_STATS, 4)} FROM (SELECT *, l_extendedprice AS x FROM lineitem) GROUP BY ALL")
def stats_by_flag(spark, sf_dir):
    """One aggregation, and exact order statistics by selection, joined on the few groups."""
    x, by = "l_extendedprice", ["l_returnflag", "l_linestatus"]
    df = read(spark, sf_dir, "lineitem")
    exprs = {"sum": agg.sum(x), "mean": agg.mean(x), "var": agg.var(x), "std": agg.std(x), "min": agg.min(x), "max": agg.max(x), "ptp": agg.ptp(x)}
    order = quantiles(df, by, x, {"median": (0.5, "linear"), "q90": (0.9, "linear")})
    return df.groupBy(*by).agg(*[r(e, 4).alias(k) for k, e in exprs.items()]).join(order.select(*by, r(F.col("median"), 4).alias("median"), r(F.col("q90"), 4).alias("q90")), by)


@query("""SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, round(product(1 + o_totalprice / 1e9::DOUBLE), 8) AS prod, bool_and(o_totalprice <> 0)::INT AS all_nonzero, bool_or(o_totalprice > 499000)::INT AS any_big,
count_if(o_totalprice > 250000)::BIGINT AS nonzero, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS argmin, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS argmax, round(sum(o_totalprice * o_custkey) / sum(o_custkey), 4) AS average, round(var_samp(o_totalprice), 2) AS var1
FROM orders GROUP BY o_orderstatus""")
def reductions(spark, sf_dir):
    x = "o_totalprice"
    big = F.col(x) > 250000
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(r(agg.sum(x), 2).alias("total"), r(agg.prod(1 + F.col(x) / 1e9), 8).alias("prod"), agg.all(x).cast("int").alias("all_nonzero"), agg.any(F.col(x) > 499000).cast("int").alias("any_big"), agg.countNonzero(big).alias("nonzero"), agg.argmin(x, "o_orderkey").alias("argmin"), agg.argmax(x, "o_orderkey").alias("argmax"), r(agg.average(x, "o_custkey"), 4).alias("average"), r(agg.var(x, 1), 2).alias("var1"))


@query("""WITH c AS (SELECT *, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS x FROM customer)
SELECT c_nationkey, round(coalesce(sum(x), 0), 4) AS nansum, round(avg(x), 4) AS nanmean, round(var_pop(x), 3) AS nanvar, round(stddev_pop(x), 4) AS nanstd, min(x) AS nanmin, max(x) AS nanmax, arg_min(c_custkey, (x, c_custkey)) FILTER (x IS NOT NULL) AS nanargmin,
arg_max(c_custkey, (x, -c_custkey)) FILTER (x IS NOT NULL) AS nanargmax, round(median(x), 4) AS nanmedian, round(quantile_cont(x, 0.25), 4) AS nanq25, round(product(1 + x / 1e9::DOUBLE), 10) AS nanprod FROM c GROUP BY c_nationkey""")
def nan_reductions(spark, sf_dir):
    x = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).otherwise(ew.NAN)
    df = read(spark, sf_dir, "customer").withColumn("x", x)
    order = quantiles(df, ["c_nationkey"], "x", {"nanmedian": (0.5, "linear"), "nanq25": (0.25, "linear")}, skip_nan=True)
    rest = df.groupBy("c_nationkey").agg(r(agg.nansum("x"), 4).alias("nansum"), r(agg.nanmean("x"), 4).alias("nanmean"), r(agg.nanvar("x"), 3).alias("nanvar"), r(agg.nanstd("x"), 4).alias("nanstd"), agg.nanmin("x").alias("nanmin"), agg.nanmax("x").alias("nanmax"), agg.nanargmin("x", "c_custkey").alias("nanargmin"), agg.nanargmax("x", "c_custkey").alias("nanargmax"), r(agg.nanprod(F.col("x") / 1e9 + 1), 10).alias("nanprod"))
    return rest.join(order.select("c_nationkey", r(F.col("nanmedian"), 4).alias("nanmedian"), r(F.col("nanq25"), 4).alias("nanq25")), "c_nationkey")


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v, (count(*) - 1) * 0.37::DOUBLE AS p FROM events GROUP BY event_type)
SELECT event_type, round(v[floor(p)::INT + 1], 6) AS lower, round(v[ceil(p)::INT + 1], 6) AS higher, round((v[floor(p)::INT + 1] + v[ceil(p)::INT + 1]) / 2, 6) AS midpoint,
round(CASE WHEN p - floor(p) <= 0.5 THEN v[floor(p)::INT + 1] ELSE v[ceil(p)::INT + 1] END, 6) AS nearest, round(v[floor(p)::INT + 1] * (1 - (p - floor(p))) + v[ceil(p)::INT + 1] * (p - floor(p)), 6) AS linear FROM s""")
def quantile_methods(spark, sf_dir):
    found = quantiles(read(spark, sf_dir, "events"), ["event_type"], "value", {m: (0.37, m) for m in agg.METHODS})
    return found.select("event_type", *[r(F.col(m)).alias(m) for m in agg.METHODS])


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = " UNION ALL ".join(f"SELECT {i}::BIGINT AS i0, {j}::BIGINT AS i1, round(covar_samp({a}, {b}), 4) AS cov, round(corr({a}, {b}), 8) AS corr FROM lineitem" for i, a in enumerate(_FEATURES) for j, b in enumerate(_FEATURES))


@query(_PAIRS)
def cov_corr(spark, sf_dir):
    """Observations are rows in no order, so nothing is ranked or shuffled: sums about the means, in two passes."""
    df = read(spark, sf_dir, "lineitem")
    cov, corr = api.covOfColumns(df, _FEATURES), api.corrOfColumns(df, _FEATURES)
    return cov.df.select("i0", "i1", r(F.col("v"), 4).alias("cov")).join(corr.df.select("i0", "i1", r(F.col("v"), 8).alias("corr")), ["i0", "i1"])


# Element-wise.

_UNARY = {"sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "arcsin": "asin(x)", "arccos": "acos(x)", "arctan": "atan(x)", "sinh": "sinh(x)", "cosh": "cosh(x)", "tanh": "tanh(x)", "arcsinh": "asinh(x)", "arctanh": "atanh(x)", "exp": "exp(x)", "expm1": "exp(x) - 1", "exp2": "pow(2::DOUBLE, x)", "sqrt": "sqrt(x)", "cbrt": "cbrt(x)", "abs": "abs(x)", "sign": "sign(x)::DOUBLE", "negative": "-x", "reciprocal": "1 / x", "square": "x * x", "sinc": "sin(pi() * x) / (pi() * x)", "deg2rad": "radians(x)", "rad2deg": "degrees(x)", "real": "x", "imag": "0::DOUBLE", "conj": "x"}


@query(f"SELECT o_orderkey, {_sql_list(_UNARY)}, round(acosh(1 + x), 9) AS arccosh FROM (SELECT o_orderkey, o_totalprice / 500001 AS x FROM orders)")
def unary_math(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 500001).alias("x"))
    return _listing(df, ["o_orderkey"], {k: getattr(ew, k)("x") for k in _UNARY} | {"arccosh": ew.arccosh(F.col("x") + 1)})


@query("""SELECT c_custkey, round(CASE WHEN x > 0 THEN ln(x) WHEN x = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END, 9) AS log, round(CASE WHEN x > 0 THEN log2(x) WHEN x = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END, 9) AS log2,
round(CASE WHEN x > 0 THEN log10(x) WHEN x = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END, 9) AS log10, round(CASE WHEN x > -1 THEN ln(1 + x) WHEN x = -1 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END, 9) AS log1p FROM (SELECT c_custkey, c_acctbal AS x FROM customer)""")
def ieee_logs(spark, sf_dir):
    return _listing(read(spark, sf_dir, "customer"), ["c_custkey"], {k: getattr(ew, k)("c_acctbal") for k in ("log", "log2", "log10", "log1p")})


@query("""SELECT p_partkey, round_even(x, 0) AS rint, round_even(x * 100, 0) / 100 AS around, floor(x) AS floor, ceil(x) AS ceil, trunc(x) AS trunc, trunc(x) AS fix, CASE WHEN x < 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS signbit, CASE WHEN x < 0 THEN 0.0 WHEN x = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS heaviside FROM (SELECT p_partkey, (p_retailprice - 950) / 7 AS x FROM part)""")
def rounding(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", ((F.col("p_retailprice") - 950) / 7).alias("x"))
    return _listing(df, ["p_partkey"], {"rint": ew.rint("x"), "around": ew.around("x", 2), "floor": ew.floor("x"), "ceil": ew.ceil("x"), "trunc": ew.trunc("x"), "fix": ew.fix("x"), "signbit": ew.signbit("x"), "heaviside": ew.heaviside("x", 0.5)}, None)


_BINARY = {"add": "a + b", "subtract": "a - b", "multiply": "a * b", "divide": "CASE WHEN b = 0 THEN (CASE WHEN a = 0 THEN 'nan'::DOUBLE ELSE sign(a) * 'inf'::DOUBLE END) ELSE a / b END", "power": "pow(abs(a), abs(b))", "floorDivide": "CASE WHEN b = 0 THEN (CASE WHEN a = 0 THEN 'nan'::DOUBLE ELSE sign(a) * 'inf'::DOUBLE END) ELSE floor(a / b) END", "maximum": "greatest(a, b)", "minimum": "least(a, b)", "fmax": "greatest(a, b)", "fmin": "least(a, b)", "mod": "fmod(a, 7::DOUBLE)", "fmod": "a % 7::DOUBLE", "copysign": "CASE WHEN b < 0 THEN -abs(a) ELSE abs(a) END", "hypot": "sqrt(a * a + b * b)", "arctan2": "atan2(a, b)", "logaddexp": "greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b)))", "logaddexp2": "greatest(a, b) + log2(pow(2::DOUBLE, a - greatest(a, b)) + pow(2::DOUBLE, b - greatest(a, b)))", "ldexp": "a * 8"}


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {_sql_list(_BINARY)} FROM (SELECT *, l_quantity - 25 AS a, l_discount * 100 - 5 AS b0, round(l_discount * 100 - 5) AS b FROM lineitem)")
def binary_math(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(*LINE, (F.col("l_quantity") - 25).alias("a"), signed(F.col("l_discount") * 100 - 5, 0).alias("b"))
    # The SQL asks for b = 0 and b < 0 there, so a zero's sign isn't seen.
    unsigned = F.when(F.col("b") == 0, 0.0).otherwise(F.col("b"))
    exprs = {k: getattr(ew, k)("a", unsigned if k in ("divide", "floorDivide", "copysign") else "b") for k in _BINARY} | {"power": ew.power(F.abs("a"), F.abs("b")), "mod": ew.mod("a", 7), "fmod": ew.fmod("a", 7), "ldexp": ew.ldexp("a", 3)}
    # First the columns, as signed() uses each several times.
    return _listing(_listing(df, LINE, exprs, None), LINE, {k: signed(F.col(k)) for k in exprs}, None)


_PREDICATES = {"equal": "a = b", "notEqual": "a <> b", "less": "a < b", "lessEqual": "a <= b", "greater": "a > b", "greaterEqual": "a >= b", "logicalAnd": "a <> 0 AND b <> 0", "logicalOr": "a <> 0 OR b <> 0", "logicalXor": "(a <> 0) <> (b <> 0)"}


@query("SELECT c_custkey, " + ", ".join(f"({e})::INT::DOUBLE AS {k}" for k, e in _PREDICATES.items()) + ", (a = 0)::INT::DOUBLE AS logicalNot, (abs(a - b) <= 1e-8::DOUBLE + 0.5::DOUBLE * abs(b))::INT::DOUBLE AS isclose, (n IS NULL)::INT::DOUBLE AS isnan, (n IS NOT NULL AND NOT isinf(n))::INT::DOUBLE AS isfinite, coalesce(n = 'inf'::DOUBLE, false)::INT::DOUBLE AS isposinf, coalesce(n = '-inf'::DOUBLE, false)::INT::DOUBLE AS isneginf, coalesce(isinf(n), false)::INT::DOUBLE AS isinf FROM (SELECT c_custkey, floor(c_acctbal / 1000) AS a, c_nationkey::DOUBLE - 2 AS b, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal > 9000 THEN 'inf'::DOUBLE WHEN c_acctbal > 8000 THEN '-inf'::DOUBLE ELSE c_acctbal END AS n FROM customer)")
def predicates(spark, sf_dir):
    bal = F.col("c_acctbal")
    df = read(spark, sf_dir, "customer").select("c_custkey", ew.floor(bal / 1000).alias("a"), (F.col("c_nationkey").cast("double") - 2).alias("b"), F.when(bal < 0, ew.NAN).when(bal > 9000, ew.INF).when(bal > 8000, -ew.INF).otherwise(bal).alias("n"))
    exprs = {k: getattr(ew, k)("a", "b") for k in _PREDICATES} | {"logicalNot": ew.logicalNot("a"), "isclose": ew.isclose("a", "b", 0.5)} | {k: getattr(ew, k)("n") for k in ("isnan", "isfinite", "isposinf", "isneginf", "isinf")}
    return _listing(df, ["c_custkey"], exprs, None)


_BITS = {"bitwiseAnd": "(a & b)::DOUBLE", "bitwiseOr": "(a | b)::DOUBLE", "bitwiseXor": "xor(a, b)::DOUBLE", "gcd": "gcd(a, b)::DOUBLE", "lcm": "lcm(a, b)::DOUBLE"}


@query(f"SELECT p_partkey, {_sql_list(_BITS, None)}, (~a)::DOUBLE AS bitwiseNot, (a << 3)::DOUBLE AS leftShift, (a >> 2)::DOUBLE AS rightShift FROM (SELECT p_partkey, p_partkey AS a, p_size::BIGINT AS b FROM part)")
def bitwise_ops(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("a"), F.col("p_size").alias("b"))
    return _listing(df, ["p_partkey"], {k: getattr(ew, k)("a", "b") for k in _BITS} | {"bitwiseNot": ew.bitwiseNot("a"), "leftShift": ew.leftShift("a", 3), "rightShift": ew.rightShift("a", 2)}, None)


@query("""SELECT p_partkey, CASE WHEN x > 0 THEN x ELSE -1 END::DOUBLE AS where_, CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN p_size * 2 ELSE 0 END::DOUBLE AS select_, CASE p_size % 3 WHEN 0 THEN x WHEN 1 THEN 5 ELSE p_size END::DOUBLE AS choose,
CASE WHEN x < 0 THEN -x WHEN x > 20 THEN x * x ELSE 7 END::DOUBLE AS piecewise, least(greatest(x, -10), 20)::DOUBLE AS clip, CASE WHEN p_size > 40 THEN 0 WHEN p_size > 30 THEN 9 ELSE x END::DOUBLE AS nan_to_num, CASE WHEN x > 0 THEN x ELSE 0 END::DOUBLE AS relu, round(1 / (1 + exp(-x)), 9) AS sigmoid, round(x / (1 + exp(-x)), 9) AS silu,
round(0.5::DOUBLE * x * (1 + tanh(0.7978845608028654::DOUBLE * (x + 0.044715::DOUBLE * x * x * x))), 9) AS gelu, round(CASE WHEN x > 0 THEN x ELSE 0.01::DOUBLE * x END, 9) AS leaky, least(greatest(x, 0), 6)::DOUBLE AS relu6 FROM (SELECT p_partkey, p_size, p_retailprice - 950 AS x FROM part)""")
def conditionals(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_retailprice") - 950).alias("x"))
    odd = F.when(F.col("p_size") > 40, ew.NAN).when(F.col("p_size") > 30, ew.INF).otherwise(F.col("x"))
    exact = {"where_": ew.where(F.col("x") > 0, "x", -1), "select_": ew.select([F.col("p_size") < 10, F.col("p_size") < 30], [1, F.col("p_size") * 2]), "choose": ew.choose("p_size", ["x", 5, "p_size"], "wrap"), "piecewise": ew.piecewise("x", [F.col("x") < 0, F.col("x") > 20], [lambda x: -x, lambda x: x * x, 7]), "clip": ew.clip("x", -10, 20), "nan_to_num": ew.nanToNum(odd, 0, 9), "relu": ew.relu("x"), "relu6": ew.relu6("x")}
    near = {"sigmoid": ew.sigmoid("x"), "silu": ew.silu("x"), "gelu": ew.gelu("x"), "leaky": ew.leakyRelu("x")}
    return df.select("p_partkey", *[e.alias(k) for k, e in exact.items()], *[r(e, 9).alias(k) for k, e in near.items()])


@query("""SELECT o_orderkey, round(x - trunc(x), 6) AS frac, trunc(x) AS integ, floor(x / 37) AS quotient, round(fmod(x, 37::DOUBLE), 6) AS remainder, x / pow(2::DOUBLE, floor(log2(x)) + 1) AS mantissa, floor(log2(x)) + 1 AS exponent,
CASE WHEN (trunc(x)::BIGINT % 256 + 256) % 256 >= 128 THEN (trunc(x)::BIGINT % 256 + 256) % 256 - 256 ELSE (trunc(x)::BIGINT % 256 + 256) % 256 END::DOUBLE AS int8, ((trunc(x)::BIGINT % 256 + 256) % 256)::DOUBLE AS uint8,
CASE WHEN (trunc(x)::BIGINT % 65536 + 65536) % 65536 >= 32768 THEN (trunc(x)::BIGINT % 65536 + 65536) % 65536 - 65536 ELSE (trunc(x)::BIGINT % 65536 + 65536) % 65536 END::DOUBLE AS int16, trunc(x) AS int32, x::FLOAT::DOUBLE AS float32 FROM (SELECT o_orderkey, o_totalprice AS x FROM orders)""")
def parts_and_casts(spark, sf_dir):
    x = "o_totalprice"
    m, d, f = ew.modf(x), ew.divmod(x, 37), ew.frexp(x)
    kinds = [ew.astype(x, k).cast("double").alias(k) for k in ("int8", "uint8", "int16", "int32", "float32")]
    return read(spark, sf_dir, "orders").select("o_orderkey", r(m["frac"]).alias("frac"), m["integ"].alias("integ"), d["quotient"].alias("quotient"), r(d["remainder"]).alias("remainder"), f["mantissa"].alias("mantissa"), f["exponent"].alias("exponent"), *kinds)


# Counting.


@query("""WITH e AS (SELECT min(l_extendedprice) AS a, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem),
c AS (SELECT least(floor((l_extendedprice - a) / w), 19)::BIGINT AS i0, count(*)::DOUBLE AS v FROM lineitem, e GROUP BY 1) SELECT g.i0, coalesce(v, 0)::DOUBLE AS v FROM (SELECT unnest(range(20))::BIGINT AS i0) g LEFT JOIN c USING (i0)""")
def histogram_price(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return api.histogram(Tensor(df.select(F.lit(0).cast("long").alias("i0"), ew.num("l_extendedprice").alias("v")), (0,)), 20)[0].df


@query("""WITH c AS (SELECT least(floor((l_quantity - 1) / 4.9::DOUBLE), 9)::BIGINT AS i0, least(floor(l_tax / 0.008::DOUBLE), 9)::BIGINT AS i1, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1, 2)
SELECT a.i0, b.i1, coalesce(v, 0)::DOUBLE AS v FROM (SELECT unnest(range(10))::BIGINT AS i0) a CROSS JOIN (SELECT unnest(range(10))::BIGINT AS i1) b LEFT JOIN c ON a.i0 = c.i0 AND b.i1 = c.i1""")
def histogram2d_lines(spark, sf_dir):
    t = Tensor.from_features(read(spark, sf_dir, "lineitem").withColumn("tax", F.col("l_tax") + 0.0), ["l_quantity", "tax"], LINE)
    x, y = (Tensor(t.df.where(F.col("i1") == k).select("i0", "v"), (t.shape[0],)) for k in (0, 1))
    edges = ((1.0, 50.0), (0.0, 0.08))
    return api.histogram2d(x, y, 10, edges)[0].df


def _vector(spark, sf_dir, name: str, value: str, key: str) -> Tensor:
    return Tensor.from_table(read(spark, sf_dir, name), value, key)


@query("WITH c AS (SELECT p_size::BIGINT AS i0, count(*)::DOUBLE AS n, sum(p_retailprice) AS w FROM part GROUP BY 1) SELECT g.i0, coalesce(n, 0)::DOUBLE AS n, round(coalesce(w, 0), 4)::DOUBLE AS w FROM (SELECT unnest(range(60))::BIGINT AS i0) g LEFT JOIN c USING (i0)")
def bincount_size(spark, sf_dir):
    size, price = _vector(spark, sf_dir, "part", "p_size", "p_partkey"), _vector(spark, sf_dir, "part", "p_retailprice", "p_partkey")
    return api.bincount(size, minlength=60).df.withColumnRenamed("v", "n").join(api.bincount(size, price, 60).df.select("i0", r(F.col("v"), 4).alias("w")), "i0")


_EDGES = [1000.0, 20000.0, 50000.0, 90000.0]


@query("SELECT bin, count(*)::BIGINT AS n FROM (SELECT (" + " + ".join(f"(l_extendedprice >= {e})::INT" for e in _EDGES) + ")::DOUBLE AS bin FROM lineitem) GROUP BY bin")
def digitize_price(spark, sf_dir):
    x = Tensor(read(spark, sf_dir, "lineitem").select(F.lit(0).cast("long").alias("i0"), ew.num("l_extendedprice").alias("v")), (1,))
    return api.digitize(x, api.array(spark, _EDGES)).df.groupBy(F.col("v").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY p_size) - 1 AS place, p_size::DOUBLE AS value, min(i) AS index, count(*)::BIGINT AS count FROM (SELECT p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) GROUP BY p_size")
def unique_counts(spark, sf_dir):
    return api.uniqueTable(_vector(spark, sf_dir, "part", "p_size", "p_partkey"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i0, (dense_rank() OVER (ORDER BY p_size) - 1)::DOUBLE AS v FROM part")
def unique_inverse(spark, sf_dir):
    return api.uniqueInverse(_vector(spark, sf_dir, "part", "p_size", "p_partkey"))[1].df


@query("""WITH a AS (SELECT o_custkey::DOUBLE AS v FROM orders WHERE o_totalprice > 300000), b AS (SELECT c_custkey::DOUBLE AS v FROM customer WHERE c_acctbal > 5000),
s AS (SELECT 'union' AS op, v FROM (SELECT v FROM a UNION SELECT v FROM b) UNION ALL SELECT 'intersect', v FROM (SELECT v FROM a INTERSECT SELECT v FROM b) UNION ALL SELECT 'difference', v FROM (SELECT v FROM a EXCEPT SELECT v FROM b))
SELECT op, row_number() OVER (PARTITION BY op ORDER BY v) - 1 AS i0, v FROM s""")
def set_ops(spark, sf_dir):
    flat = lambda df, c: Tensor(df.select(F.lit(0).cast("long").alias("i0"), ew.num(c).alias("v")), (1,))
    a = flat(read(spark, sf_dir, "orders").where("o_totalprice > 300000"), "o_custkey")
    b = flat(read(spark, sf_dir, "customer").where("c_acctbal > 5000"), "c_custkey")
    parts = {"union": api.union1d, "intersect": api.intersect1d, "difference": api.setdiff1d}
    frames = [f(a, b).df.select(F.lit(k).alias("op"), "i0", "v") for k, f in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i0, (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000))::INT::DOUBLE AS v FROM orders")
def isin_customers(spark, sf_dir):
    t = _vector(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.lit(0).cast("long").alias("i0"), ew.num("c_custkey").alias("v"))
    return api.isin(t, Tensor(rich, (1,))).df


# Ordered.

_E = "(SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n, value AS x FROM events)"


def _events(spark, sf_dir) -> Tensor:
    return _vector(spark, sf_dir, "events", "value", "event_id")


@query(f"SELECT i AS i0, round(sum(x) OVER (ORDER BY i), 4) AS cumsum, round(product(1 + x / 1e7::DOUBLE) OVER (ORDER BY i), 9) AS cumprod FROM {_E}")
def event_cumsum(spark, sf_dir):
    t = _events(spark, sf_dir)
    return api.cumsum(t).df.select("i0", r(F.col("v"), 4).alias("cumsum")).join(api.cumprod(t.map(lambda v: 1 + v / 1e7)).df.select("i0", r(F.col("v"), 9).alias("cumprod")), "i0")


@query(f"SELECT i AS i0, round(lead(x) OVER w - x, 6) AS d1, round(lead(x, 2) OVER w - 2 * lead(x) OVER w + x, 6) AS d2 FROM {_E} WINDOW w AS (ORDER BY i) QUALIFY lead(x, 2) OVER w IS NOT NULL")
def event_diff(spark, sf_dir):
    t = _events(spark, sf_dir)
    return api.diff(t).df.select("i0", r(F.col("v")).alias("d1")).join(api.diff(t, 2).df.select("i0", r(F.col("v")).alias("d2")), "i0")


@query(f"SELECT i AS i0, round(CASE WHEN i = 0 THEN lead(x) OVER w - x WHEN i = n - 1 THEN x - lag(x) OVER w ELSE 0.5::DOUBLE * lead(x) OVER w - 0.5::DOUBLE * lag(x) OVER w END, 6) AS v FROM {_E} WINDOW w AS (ORDER BY i)")
def event_gradient(spark, sf_dir):
    return rounded(api.gradient(_events(spark, sf_dir)))


_TAPER = [0.0, 0.5, 1.0, 0.5, 0.0]


@query(f"SELECT i AS i0, round(0.5::DOUBLE * lag(x, 1, 0) OVER w + x + 0.5::DOUBLE * lead(x, 1, 0) OVER w, 6) AS v FROM {_E} WINDOW w AS (ORDER BY i)")
def event_convolve(spark, sf_dir):
    return rounded(api.convolve(_events(spark, sf_dir), api.hanning(spark, 5), "same"))


@query(f"SELECT i AS i0, round(x + 2 * lead(x) OVER w + 3 * lead(x, 2) OVER w, 6) AS v FROM {_E} WINDOW w AS (ORDER BY i) QUALIFY lead(x, 2) OVER w IS NOT NULL")
def event_correlate(spark, sf_dir):
    return rounded(api.correlate(_events(spark, sf_dir), api.array(spark, [1.0, 2.0, 3.0])))


@query(f"SELECT 'roll' AS op, (i + 100) % n AS i0, x AS v FROM {_E} UNION ALL SELECT 'flip', n - 1 - i, x FROM {_E} UNION ALL SELECT 'pad', i, x FROM (SELECT i + 2 AS i, x FROM {_E} UNION ALL SELECT 2 - i, x FROM {_E} WHERE i IN (1, 2)) UNION ALL SELECT 'repeat', 2 * i + k, x FROM {_E}, (SELECT unnest([0, 1]) AS k) UNION ALL SELECT 'tile', i + n * k, x FROM {_E}, (SELECT unnest([0, 1]) AS k)")
def event_moves(spark, sf_dir):
    t = _events(spark, sf_dir)
    moves = {"roll": api.roll(t, 100), "flip": api.flip(t), "pad": api.pad(t, ((2, 0),), "reflect"), "repeat": api.repeat(t, 2), "tile": api.tile(t, 2)}
    frames = [m.df.select(F.lit(k).alias("op"), "i0", "v") for k, m in moves.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query(f"""WITH k AS (SELECT i * 100.0::DOUBLE AS xp, x AS fp FROM {_E} WHERE i < 50), q AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i0, o_totalprice / 100 AS x FROM orders)
SELECT i0, round(CASE WHEN a.xp IS NULL THEN (SELECT arg_min(fp, xp) FROM k) WHEN b.xp IS NULL THEN a.fp ELSE a.fp + (b.fp - a.fp) / (b.xp - a.xp) * (x - a.xp) END, 8) AS v FROM q ASOF LEFT JOIN k a ON q.x >= a.xp LEFT JOIN k b ON b.xp = a.xp + 100""")
def interp_series(spark, sf_dir):
    knots = api.slice_axis(_events(spark, sf_dir), 0, 0, 50)
    x = _vector(spark, sf_dir, "orders", "o_totalprice", "o_orderkey").map(lambda v: v / 100)
    return rounded(api.interp(x, api.arange(spark, 0, 5000, 100), knots), 8)


@query("""WITH s AS (SELECT list(c_acctbal) AS l FROM customer), q AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i0, s_acctbal AS x FROM supplier)
SELECT i0, len(list_filter(l, lambda e: e < x))::DOUBLE AS left_, len(list_filter(l, lambda e: e <= x))::DOUBLE AS right_ FROM q, s""")
def searchsorted_balances(spark, sf_dir):
    arr = api.sort(_vector(spark, sf_dir, "customer", "c_acctbal", "c_custkey"))
    x = _vector(spark, sf_dir, "supplier", "s_acctbal", "s_suppkey")
    return api.searchsorted(arr, x, "left").df.withColumnRenamed("v", "left_").join(api.searchsorted(arr, x, "right").df.withColumnRenamed("v", "right_"), "i0")


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i0, o_totalprice AS v FROM orders ORDER BY 1 LIMIT 100")
def topk_orders(spark, sf_dir):
    return api.topk(_vector(spark, sf_dir, "orders", "o_totalprice", "o_orderkey"), 100)[0].df


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i0, (row_number() OVER (ORDER BY o_orderkey) - 1)::DOUBLE AS place, o_totalprice AS v FROM orders")
def sort_argsort(spark, sf_dir):
    t = _vector(spark, sf_dir, "orders", "o_totalprice", "o_orderkey")
    return api.argsort(t).df.withColumnRenamed("v", "place").join(api.sort(t).df, "i0")


@query("SELECT row_number() OVER (ORDER BY p_size, p_retailprice, p_partkey) - 1 AS i0, (row_number() OVER (ORDER BY p_partkey) - 1)::DOUBLE AS v FROM part")
def lexsort_parts(spark, sf_dir):
    return api.lexsort([_vector(spark, sf_dir, "part", c, "p_partkey") for c in ("p_retailprice", "p_size")]).df


@query(f"SELECT round(sum((x + y) / 2), 4) AS v FROM (SELECT x, lead(x) OVER (ORDER BY i) AS y FROM {_E}) WHERE y IS NOT NULL")
def event_trapezoid(spark, sf_dir):
    return rounded(api.trapezoid(_events(spark, sf_dir)), 4)


# Matrices: embeddings, one row a vector.

_M = "(SELECT dense_rank() OVER (ORDER BY vec_id) - 1 AS i0, j AS i1, v FROM (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings))"


def _matrix(spark, sf_dir) -> Tensor:
    return Tensor.from_arrays(read(spark, sf_dir, "embeddings"), "embedding", "vec_id", 64)


@query(f"WITH m AS {_M} SELECT a.i1 AS i0, b.i1, round(sum(a.v * b.v), 6) AS v FROM m a JOIN m b USING (i0) GROUP BY ALL")
def gram_matrix(spark, sf_dir):
    t = _matrix(spark, sf_dir)
    return rounded(api.matmul(t.T, t))


@query(f"WITH m AS {_M} SELECT a.i1 AS i0, b.i1, round(sum(a.v * b.v), 6) AS v FROM m a JOIN m b USING (i0) WHERE a.i1 < 8 AND b.i1 >= 60 GROUP BY ALL")
def einsum_columns(spark, sf_dir):
    t = _matrix(spark, sf_dir)
    part = api.einsum("ni,nj->ij", api.slice_axis(t, 1, 0, 8), api.slice_axis(t, 1, 60, 64))
    return rounded(part.reindexed([F.col("i0"), F.col("i1") + 60], (8, 64)))


@query(f"WITH m AS {_M} SELECT round(sum(v * v), 5) AS v FROM m")
def trace_of_gram(spark, sf_dir):
    t = _matrix(spark, sf_dir)
    return rounded(api.trace(api.matmul(t.T, t)), 5)


@query("""WITH e AS (SELECT *, embedding::DOUBLE[] AS x FROM embeddings), q AS (SELECT vec_id AS q_id, x AS y FROM e WHERE vec_id % 50 = 0)
SELECT q_id, vec_id, round(list_cosine_similarity(x, y), 8) AS score, row_number() OVER (PARTITION BY q_id ORDER BY round(list_cosine_similarity(x, y), 8) DESC, vec_id) AS rank FROM e JOIN q ON vec_id <> q_id QUALIFY rank <= 10""")
def cosine_topk(spark, sf_dir):
    """The ten nearest of all vectors for every fiftieth, in blocks: see nearestRows()."""
    df = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    found = api.nearestRows(df.where("vec_id % 50 = 0"), df, "vec_id", "x", 10, digits=8)
    return found.select("q_id", "vec_id", "score", "rank")


@query(f"WITH m AS {_M}, t AS (SELECT *, max(v) OVER (PARTITION BY i0) AS t FROM m) SELECT i0, i1, round(exp(v - t) / sum(exp(v - t)) OVER (PARTITION BY i0), 9) AS v FROM t")
def softmax_rows(spark, sf_dir):
    return rounded(api.softmax(_matrix(spark, sf_dir), 1), 9)


@query(f"WITH m AS {_M} SELECT i0, round(ln(sum(exp(v))), 9) AS logsumexp, round(sqrt(sum(v * v)), 9) AS norm2, round(sum(abs(v)), 7) AS norm1, round(max(abs(v)), 9) AS norminf, round(max(v) - min(v), 9) AS ptp FROM m GROUP BY i0")
def row_norms(spark, sf_dir):
    t = _matrix(spark, sf_dir)
    df = t.df.groupBy("i0").agg(r(agg.norm("v"), 9).alias("norm2"), r(agg.norm("v", 1), 7).alias("norm1"), r(agg.norm("v", ew.INF), 9).alias("norminf"), r(agg.ptp("v"), 9).alias("ptp"))
    return api.logsumexp(t, 1).df.select("i0", r(F.col("v"), 9).alias("logsumexp")).join(df, "i0")


@query(f"WITH m AS {_M}, s AS (SELECT *, avg(v) OVER w AS m, var_pop(v) OVER w AS s, avg(v * v) OVER w AS q FROM m WINDOW w AS (PARTITION BY i0)) SELECT i0, i1, round((v - m) / sqrt(s + 1e-5::DOUBLE), 8) AS layer, round(v / sqrt(q + 1e-5::DOUBLE), 8) AS rms FROM s")
def norm_layers(spark, sf_dir):
    t = _matrix(spark, sf_dir)
    return nn.layer_norm(t, (64,)).df.select("i0", "i1", r(F.col("v"), 8).alias("layer")).join(nn.rms_norm(t).df.select("i0", "i1", r(F.col("v"), 8).alias("rms")), ["i0", "i1"])


@query(f"WITH m AS {_M}, c AS (SELECT i1, avg(v) AS m FROM m GROUP BY i1) SELECT i0, i1, round(v - m, 9) AS v FROM m JOIN c USING (i1)")
def centred_columns(spark, sf_dir):
    t = _matrix(spark, sf_dir)
    return rounded(api.subtract(t, api.mean(t, 0)), 9)


@query(f"WITH m AS {_M} SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, i1::DOUBLE AS place, v FROM m")
def sorted_rows(spark, sf_dir):
    t = _matrix(spark, sf_dir)
    return api.argsort(t, 1).df.withColumnRenamed("v", "place").join(api.sort(t, 1).df, ["i0", "i1"])


@query(f"WITH m AS {_M} SELECT i0, round(sum(v) OVER (PARTITION BY i0 ORDER BY i1), 8) AS v, i1 FROM m")
def row_cumsum(spark, sf_dir):
    return rounded(api.cumsum(_matrix(spark, sf_dir), 1), 8)


@query(f"WITH m AS {_M} SELECT (i0 * 64 + i1) // 32 AS i0, (i0 * 64 + i1) % 32 AS i1, v FROM m")
def reshaped(spark, sf_dir):
    return api.reshape(_matrix(spark, sf_dir), (-1, 32)).df


@query(f"WITH m AS {_M} SELECT i1 AS i0, i0 AS i1, v FROM m WHERE i1 < 10 UNION ALL SELECT i1 - 44, i0, v FROM m WHERE i1 >= 54")
def transposed_slices(spark, sf_dir):
    t = _matrix(spark, sf_dir).T
    return api.concatenate([api.slice_axis(t, 0, 0, 10), api.slice_axis(t, 0, 54, 64)], 0).df


@query(f"WITH m AS {_M} SELECT i0, CASE i1 WHEN 63 THEN 0 WHEN 0 THEN 1 ELSE 2 END::BIGINT AS i1, v FROM m WHERE i1 IN (63, 0, 5)")
def taken_columns(spark, sf_dir):
    return api.take(_matrix(spark, sf_dir), api.array(spark, [-1.0, 0.0, 5.0]), 1).df


@query(f"WITH m AS {_M} SELECT row_number() OVER (ORDER BY i0, i1) - 1 AS at, i0::DOUBLE AS a, i1::DOUBLE AS b, v FROM m WHERE v > 0.3")
def masked_elements(spark, sf_dir):
    t = _matrix(spark, sf_dir)
    mask = api.greater(t, 0.3)
    a, b = api.nonzero(mask)
    out = api.extract(mask, t).df.withColumnRenamed("i0", "at")
    return a.df.toDF("at", "a").join(b.df.toDF("at", "b"), "at").join(out, "at")


@query(f"WITH m AS {_M} SELECT i0, i1, CASE WHEN i1 <= i0 + 2 THEN v ELSE 0 END::DOUBLE AS lower, CASE WHEN i1 >= i0 - 1 THEN v ELSE 0 END::DOUBLE AS upper, CASE WHEN i0 = i1 THEN 9 ELSE v END::DOUBLE AS filled FROM m")
def triangles(spark, sf_dir):
    t = _matrix(spark, sf_dir)
    return api.tril(t, 2).df.withColumnRenamed("v", "lower").join(api.triu(t, -1).df.withColumnRenamed("v", "upper"), ["i0", "i1"]).join(api.fillDiagonal(t, 9.0).df.withColumnRenamed("v", "filled"), ["i0", "i1"])


@query(f"WITH m AS {_M}, b AS (SELECT i0 * 64 + i1 AS f, (v > 0)::INT AS b FROM m) SELECT f // 8 AS i0, sum(b << (7 - f % 8)::INT)::DOUBLE AS v FROM b GROUP BY 1")
def packed_signs(spark, sf_dir):
    return api.packbits(api.greater(_matrix(spark, sf_dir), 0)).df


@query("SELECT a.i AS i0, b.i AS i1, round(a.x * b.x, 6) AS v FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_nationkey::DOUBLE + 0.5 AS x FROM nation) a, (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS i, r_regionkey::DOUBLE - 1 AS x FROM region) b")
def outer_product(spark, sf_dir):
    a = _vector(spark, sf_dir, "nation", "n_nationkey", "n_nationkey").map(lambda v: v + 0.5)
    return rounded(api.outer(a, _vector(spark, sf_dir, "region", "r_regionkey", "r_regionkey").map(lambda v: v - 1)))


@query("SELECT a.r * 5 + b.i AS i0, a.c AS i1, round((a.r * 2 + a.c + 1) * b.x, 6) AS v FROM (SELECT r, c FROM (SELECT unnest(range(3)) AS r), (SELECT unnest(range(2)) AS c)) a, (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS i, r_regionkey::DOUBLE AS x FROM region) b")
def kron_product(spark, sf_dir):
    a = Tensor.grid(spark, (3, 2), lambda i, j: i * 2 + j + 1)
    return rounded(api.kron(a, _vector(spark, sf_dir, "region", "r_regionkey", "r_regionkey")))


@query(f"WITH e AS {_E}, k AS (SELECT unnest(range(1, 9)) AS k) SELECT k - 1 AS i0, round(pow(sum(x * cos(2 * pi() / n * ((i * k) % n))), 2) + pow(sum(x * sin(2 * pi() / n * ((i * k) % n))), 2), 0) AS v FROM e, k GROUP BY k")
def dft_power(spark, sf_dir):
    return rounded(dft_power_of(_events(spark, sf_dir), list(range(1, 9))), 0)


# Sources.


@query("""SELECT 'arange' AS op, i AS i0, 3 + i * 0.5::DOUBLE AS v FROM (SELECT unnest(range(14)) AS i) UNION ALL SELECT 'linspace', i, i * 0.125::DOUBLE FROM (SELECT unnest(range(9)) AS i) UNION ALL SELECT 'logspace', i, pow(2::DOUBLE, i::DOUBLE) FROM (SELECT unnest(range(6)) AS i)
UNION ALL SELECT 'hanning', i, round(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 10), 9) FROM (SELECT unnest(range(11)) AS i) UNION ALL SELECT 'hamming', i, round(0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * i / 10), 9) FROM (SELECT unnest(range(11)) AS i)
UNION ALL SELECT 'bartlett', i, round(1 - abs(2 * i / 10::DOUBLE - 1), 9) FROM (SELECT unnest(range(11)) AS i) UNION ALL SELECT 'blackman', i, round(0.42::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 10) + 0.08::DOUBLE * cos(4 * pi() * i / 10), 9) FROM (SELECT unnest(range(11)) AS i)
UNION ALL SELECT 'fftfreq', i, round(CASE WHEN i < 4 THEN i ELSE i - 7 END / 7::DOUBLE, 9) FROM (SELECT unnest(range(7)) AS i)""")
def vectors(spark, sf_dir):
    made = {"arange": api.arange(spark, 3, 10, 0.5), "linspace": api.linspace(spark, 0, 1, 9), "logspace": api.logspace(spark, 0, 5, 6, 2.0)}
    near = {"hanning": api.hanning(spark, 11), "hamming": api.hamming(spark, 11), "bartlett": api.bartlett(spark, 11), "blackman": api.blackman(spark, 11), "fftfreq": api.fftfreq(spark, 7)}
    frames = [t.df.select(F.lit(k).alias("op"), "i0", "v") for k, t in made.items()] + [rounded(t, 9).select(F.lit(k).alias("op"), "i0", F.col("v") + 0.0).toDF("op", "i0", "v") for k, t in near.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn("v", F.when(F.col("v") == 0, 0.0).otherwise(F.col("v")))


@query("""WITH g AS (SELECT i AS i0, j AS i1 FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(range(8)) AS j)) SELECT i0, i1, (i1 = i0 + 1)::INT::DOUBLE AS eye, (i1 <= i0 + 1)::INT::DOUBLE AS tri, CASE WHEN i1 <= i0 THEN 0 ELSE '-inf'::DOUBLE END AS mask, i1 * 10::DOUBLE AS mesh, (i0 * 100 + i1)::DOUBLE AS fn FROM g""")
def matrices(spark, sf_dir):
    mask = Tensor(api.causalMask(spark, 8).df.where("i0 < 6"), (6, 8))
    x, _ = api.meshgrid(api.arange(spark, 0, 80, 10), api.arange(spark, 6))
    parts = {"eye": api.eye(spark, 6, 8, 1), "tri": api.tri(spark, 6, 8, 1), "mask": mask, "mesh": x, "fn": api.fromfunction(spark, lambda i, j: i * 100 + j, (6, 8))}
    out = None
    for k, t in parts.items():
        df = t.df.withColumnRenamed("v", k)
        out = df if out is None else out.join(df, ["i0", "i1"])
    return out


# Estimators.

_SCALED = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS s_{c}, round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 9) AS m_{c}" for c in _FEATURES)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_SCALED} FROM lineitem")
def scale_features(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_FEATURES, *[F.col(c).alias(f"m_{c}") for c in _FEATURES], *[F.col(c).alias(f"s_{c}") for c in _FEATURES])
    out = StandardScaler().fitTransform(df, [f"s_{c}" for c in _FEATURES])
    out = MinMaxScaler().fitTransform(out, [f"m_{c}" for c in _FEATURES]).drop(*_FEATURES)
    return out.withColumns({f"s_{c}": r(F.col(f"s_{c}")) for c in _FEATURES} | {f"m_{c}": r(F.col(f"m_{c}"), 9) for c in _FEATURES})


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def ols_fit(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    m = LinearRegression().fit(df, ["l_quantity"], "l_extendedprice")
    return m.predict(df).agg(F.lit(round(m.coef_[0], 4)).alias("slope"), F.lit(round(m.intercept_, 2)).alias("intercept"), r(metrics.r2Score("l_extendedprice", "prediction"), 8).alias("r2"))


@query("""WITH p AS (SELECT (p_size - 25.5) / 24.5::DOUBLE AS x, p_retailprice AS y FROM part), s AS (SELECT count(*)::DOUBLE AS s0, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2 FROM p),
d AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS d FROM s), c AS (SELECT (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / d AS c0, (s0*(t1*s4-t2*s3) - t0*(s1*s4-s2*s3) + s2*(s1*t2-t1*s2)) / d AS c1, (s0*(s2*t2-s3*t1) - s1*(s1*t2-s2*t1) + t0*(s1*s3-s2*s2)) / d AS c2 FROM d)
SELECT p_partkey, round(c0 + c1 * (p_size - 25.5) / 24.5 + c2 * pow((p_size - 25.5) / 24.5, 2), 3) AS fitted FROM part, c""")
def polyfit_2(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    p = api.polyfit(_vector(spark, sf_dir, "part", "p_size", "p_partkey"), _vector(spark, sf_dir, "part", "p_retailprice", "p_partkey"), 2).numpy().tolist()
    return df.select("p_partkey", r(ew.polyval("p_size", p), 3).alias("fitted"))


_K = 4


@query(f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), c AS (SELECT vec_id AS c, x AS y FROM e WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT {_K})), k AS (SELECT row_number() OVER (ORDER BY c) - 1 AS c, y FROM c),
d AS (SELECT vec_id, arg_min(c, (list_sum(list_transform(range(1, 65), lambda i: pow(x[i] - y[i], 2))), c)) AS c, min(list_sum(list_transform(range(1, 65), lambda i: pow(x[i] - y[i], 2)))) AS d FROM e, k GROUP BY vec_id)
SELECT c::INT AS c, count(*)::BIGINT AS n, round(sum(d), 5) AS inertia FROM d GROUP BY c""")
def kmeans_step(spark, sf_dir):
    """Assignment to fixed centres, the first vectors: what every round of the algorithm does."""
    import numpy as np

    from .operators.ml.cluster import nearest

    df = read(spark, sf_dir, "embeddings")
    centres = np.array([list(x.embedding) for x in df.orderBy("vec_id").limit(_K).collect()], float)
    near = df.select(nearest(F.transform("embedding", lambda v: v.cast("double")), centres).alias("near"))
    return near.groupBy("near.c").agg(F.count("*").alias("n"), r(F.sum("near.d"), 5).alias("inertia"))


@query("""SELECT round(avg((quality = toxic)::INT), 9) AS accuracy, round(count_if(quality = 1 AND toxic = 1) / count_if(toxic = 1), 9) AS precision_, round(count_if(quality = 1 AND toxic = 1) / count_if(quality = 1), 9) AS recall,
round(2 * count_if(quality = 1 AND toxic = 1) / (count_if(toxic = 1) + count_if(quality = 1)), 9) AS f1 FROM labels""")
def class_metrics(spark, sf_dir):
    return read(spark, sf_dir, "labels").agg(r(metrics.accuracyScore("quality", "toxic"), 9).alias("accuracy"), r(metrics.precisionScore("quality", "toxic"), 9).alias("precision_"), r(metrics.recallScore("quality", "toxic"), 9).alias("recall"), r(metrics.f1Score("quality", "toxic"), 9).alias("f1"))


@query("SELECT a.x AS actual, b.x AS predicted, count(l.doc_id)::BIGINT AS count FROM (SELECT unnest([0, 1])::INT AS x) a CROSS JOIN (SELECT unnest([0, 1])::INT AS x) b LEFT JOIN labels l ON l.quality = a.x AND l.toxic = b.x GROUP BY ALL")
def confusion(spark, sf_dir):
    df = read(spark, sf_dir, "labels").select(F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    return metrics.confusionMatrix(df, "quality", "toxic").withColumn("count", F.col("count").cast("long"))


@query("""WITH p AS (SELECT l_extendedprice / 1000 AS t, l_quantity * 1.5 AS p, l_tax + 1 AS w FROM lineitem) SELECT round(avg(pow(t - p, 2)), 6) AS mse, round(sqrt(avg(pow(t - p, 2))), 6) AS rmse, round(sum(w * abs(t - p)) / sum(w), 6) AS mae, round(avg(abs(t - p) / (abs(t) + 1e-15::DOUBLE)), 6) AS mape,
round(1 - sum(pow(t - p, 2)) / (var_pop(t) * count(*)), 6) AS r2, round(1 - var_pop(t - p) / var_pop(t), 6) AS explained FROM p""")
def regression_metrics(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("t"), (F.col("l_quantity") * 1.5).alias("p"), (F.col("l_tax") + 1).alias("w"))
    return df.agg(r(metrics.meanSquaredError("t", "p")).alias("mse"), r(metrics.rootMeanSquaredError("t", "p")).alias("rmse"), r(metrics.meanAbsoluteError("t", "p", "w")).alias("mae"), r(metrics.meanAbsolutePercentageError("t", "p")).alias("mape"), r(metrics.r2Score("t", "p")).alias("r2"), r(metrics.explainedVarianceScore("t", "p")).alias("explained"))


# Images: embeddings as 8 x 8 pictures.

_I = "(SELECT dense_rank() OVER (ORDER BY vec_id) - 1 AS n, j // 8 AS h, j % 8 AS w, v FROM (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings))"


def _images(spark, sf_dir) -> Tensor:
    t = _matrix(spark, sf_dir)
    return api.reshape(t, (t.shape[0], 1, 8, 8))


@query(f"WITH i AS {_I}, k AS (SELECT a, b, (a * 3 + b - 4) * 0.25::DOUBLE AS k FROM (SELECT unnest(range(3)) AS a), (SELECT unnest(range(3)) AS b)) SELECT n AS i0, 0::BIGINT AS i1, h - a AS i2, w - b AS i3, round(greatest(0, sum(v * k) + 0.1), 8) AS v FROM i, k WHERE h - a BETWEEN 0 AND 5 AND w - b BETWEEN 0 AND 5 GROUP BY ALL")
def conv_relu(spark, sf_dir):
    kernel = Tensor.grid(spark, (1, 1, 3, 3), lambda o, c, a, b: (a * 3 + b - 4) * 0.25)
    return rounded(nn.conv2dFused(_images(spark, sf_dir), kernel, api.array(spark, [0.1]), activation="relu"), 8)


@query(f"WITH i AS {_I} SELECT n AS i0, h // 2 AS i2, w // 2 AS i3, max(v) AS max_, round(avg(v), 9) AS avg_ FROM i GROUP BY ALL")
def pools(spark, sf_dir):
    t = _images(spark, sf_dir)
    return nn.maxPool2d(t, 2).df.withColumnRenamed("v", "max_").join(nn.avgPool2d(t, 2).df.select("i0", "i1", "i2", "i3", r(F.col("v"), 9).alias("avg_")), ["i0", "i1", "i2", "i3"]).drop("i1")


@query(f"WITH i AS {_I}, s AS (SELECT o, greatest(0, (o + 0.5::DOUBLE) * 2 - 0.5::DOUBLE) AS z FROM (SELECT unnest(range(4)) AS o)), m AS (SELECT o, floor(z)::BIGINT + k AS f, CASE k WHEN 0 THEN 1 - (z - floor(z)) ELSE z - floor(z) END AS w FROM s, (SELECT unnest([0, 1]) AS k)) SELECT n AS i0, 0::BIGINT AS i1, a.o AS i2, b.o AS i3, round(sum(v * a.w * b.w), 9) AS v FROM i JOIN m a ON i.h = a.f JOIN m b ON i.w = b.f GROUP BY ALL")
def resized(spark, sf_dir):
    return rounded(nn.resizeBilinear(_images(spark, sf_dir), (4, 4)), 9)


@query(f"WITH i AS {_I} SELECT n AS i0, round((avg(v) - 0.01::DOUBLE) / sqrt(0.04::DOUBLE + 1e-5::DOUBLE) * 2 + 1, 8) AS v FROM i GROUP BY n")
def pooled_batch_norm(spark, sf_dir):
    one = lambda x: api.array(spark, [x])
    out = nn.batchNorm(nn.globalAvgPool2d(_images(spark, sf_dir)), one(2.0), one(1.0), one(0.01), one(0.04))
    return rounded(api.squeeze(out, (1, 2, 3)), 8)


# Without SQL: factorizations, transforms, draws and iterative fits; their tests hold them against NumPy.


@query(f"WITH m AS {_M}, g AS (SELECT a.i1, b.i1 AS j, sum(a.v * b.v) AS v FROM m a JOIN m b USING (i0) GROUP BY ALL) SELECT round((SELECT sum(v * v) FROM m), 5) AS squares, round((SELECT sum(v * v) FROM g), 4) AS fourths, 64::BIGINT AS n")
def svd_values(spark, sf_dir):
    """Sums of the singular values' second and fourth powers, which are sums of squares of the matrix and of its products."""
    s2 = F.col("v") * F.col("v")
    return api.singular_values(_matrix(spark, sf_dir)).df.agg(r(F.sum(s2), 5).alias("squares"), r(F.sum(s2 * s2), 4).alias("fourths"), F.count("*").alias("n"))


@query(f"""WITH e AS {_E}, k AS (SELECT unnest(range(0, (SELECT count(*) // 2 + 1 FROM events))) AS k) SELECT k::BIGINT AS i0, round(sum(x * cos(2 * pi() / n * ((i * k) % n))), 1) + 0 AS re, round(-sum(x * sin(2 * pi() / n * ((i * k) % n))), 1) + 0 AS im FROM e, k GROUP BY k""")
def fft_events(spark, sf_dir):
    z = api.rfft(_events(spark, sf_dir))
    return z["real"].df.select("i0", (r(F.col("v"), 1) + 0.0).alias("re")).join(z["imag"].df.select("i0", (r(F.col("v"), 1) + 0.0).alias("im")), "i0")


_LSQ = """WITH s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(a * y) AS ay, sum(b * y) AS by_, sum(c * y) AS cy FROM (SELECT l_quantity AS a, l_discount AS b, l_tax AS c, l_extendedprice AS y FROM lineitem)),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s)
SELECT unnest([0, 1, 2])::BIGINT AS i0, round(unnest([(ay * (bb * cc - bc * bc) + by_ * (ac * bc - ab * cc) + cy * (ab * bc - ac * bb)) / det, (ay * (ac * bc - ab * cc) + by_ * (aa * cc - ac * ac) + cy * (ab * ac - aa * bc)) / det, (ay * (ab * bc - ac * bb) + by_ * (ab * ac - aa * bc) + cy * (aa * bb - ab * ab)) / det]), 3) AS v FROM d"""


@query(_LSQ)
def least_squares(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    a = Tensor.from_features(df, ["l_quantity", "l_discount", "l_tax"], LINE)
    return rounded(api.lstsq(a, Tensor.from_table(df, "l_extendedprice", LINE))["x"], 3)


@query()
def random_stats(spark, sf_dir):
    parts = {"uniform": api.rand(spark, (20000,), seed=1), "normal": api.randn(spark, (20000,), seed=1), "gamma": api.gamma(spark, 2.0, 1.5, (20000,), seed=1), "poisson": api.poisson(spark, 3.0, (20000,), seed=1)}
    frames = [t.df.agg(F.lit(k).alias("name"), r(F.avg("v"), 4).alias("mean"), r(F.var_pop("v"), 4).alias("var")) for k, t in parts.items()]
    return frames[0].union(frames[1]).union(frames[2]).union(frames[3])


@query("SELECT o_orderstatus, 'test' AS part, floor(count(*) * 0.2 + 0.5)::BIGINT AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT o_orderstatus, 'train', (count(*) - floor(count(*) * 0.2 + 0.5))::BIGINT FROM orders GROUP BY o_orderstatus")
def split_sizes(spark, sf_dir):
    train, test = trainTestSplit(read(spark, sf_dir, "orders"), "o_orderkey", 0.2, randomState=3, stratify="o_orderstatus")
    return train.groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("part", F.lit("train")).unionByName(test.groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("part", F.lit("test")))


@query()
def kmeans_fit(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings").select("vec_id", *[F.get("embedding", j).cast("double").alias(f"f{j}") for j in range(64)])
    return KMeans(nClusters=5, nInit=1, maxIter=10, randomState=1).fitPredict(df, [f"f{j}" for j in range(64)]).groupBy("label").agg(F.count("*").alias("n"))


@query()
def logistic_fit(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("k", (F.col("l_extendedprice") > 40000).cast("double")).withColumn("q", F.col("l_quantity") / 50)
    m = LogisticRegression(C=1000.0).fit(df, ["q", "l_discount"], "k")
    return m.predict(df).agg(r(metrics.accuracyScore("k", "prediction"), 6).alias("accuracy"), F.lit(round(m.intercept_[0], 4)).alias("intercept"))


for _name, _query in listings.QUERIES.items():
    QUERIES[_name], SQL[_name] = _query, listings.SQL[_name]

FLAGSHIP = "stats_by_flag"
