"""Column functions against NumPy, on all pairs of edge values in one query."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import dtype
from tessera.functions import elementwise as ew

EDGE = [0.0, -0.0, 1.0, -1.0, 0.5, -2.5, 2.5, 3.0, -7.0, 7.0, 1e-8, 1e308, -1e308, 5e-324, math.inf, -math.inf, math.nan, 123456.789]
NP1 = {n: getattr(np, n) for n in "sin cos tan arcsin arccos arctan sinh cosh tanh arcsinh arccosh arctanh exp exp2 expm1 log log2 log10 log1p sqrt cbrt abs sign floor ceil trunc fix rint negative reciprocal square sinc deg2rad rad2deg signbit isnan isinf isfinite isneginf isposinf real imag".split()} | {"logicalNot": np.logical_not, "isreal": np.isreal, "around": np.round}
NP2 = {"add": np.add, "subtract": np.subtract, "multiply": np.multiply, "divide": np.divide, "power": np.power, "maximum": np.maximum, "minimum": np.minimum, "fmax": np.fmax, "fmin": np.fmin, "mod": np.mod, "fmod": np.fmod, "copysign": np.copysign, "hypot": np.hypot, "arctan2": np.arctan2, "logaddexp": np.logaddexp, "logaddexp2": np.logaddexp2, "nextafter": np.nextafter, "equal": np.equal, "notEqual": np.not_equal, "less": np.less, "lessEqual": np.less_equal, "greater": np.greater, "greaterEqual": np.greater_equal, "logicalAnd": np.logical_and, "logicalOr": np.logical_or, "logicalXor": np.logical_xor, "isclose": np.isclose}


def same(got, want, rtol=1e-12):
    want = np.asarray(want, np.float64)
    got = np.asarray(got, np.float64)
    ok = (np.isnan(got) & np.isnan(want)) | (got == want) | (np.abs(got - want) <= rtol * np.maximum(np.abs(want), 1e-300))
    assert ok.all(), [(i, got[i], want[i]) for i in np.flatnonzero(~ok)[:5]]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i * len(EDGE) + j, a, b) for i, a in enumerate(EDGE) for j, b in enumerate(EDGE)]
    return spark.createDataFrame(rows, "i int, a double, b double")


@pytest.fixture(scope="module")
def arrays():
    return np.repeat(EDGE, len(EDGE)), np.tile(EDGE, len(EDGE))


def test_unary(pairs, arrays):
    got = pairs.where("b = 0.5").select("i", *[getattr(ew, n)("a").alias(n) for n in NP1]).orderBy("i").toPandas()
    with np.errstate(all="ignore"):
        for n, f in NP1.items():
            # Spark's tangent of 1e308 and the like differ by argument reduction only.
            same(got[n], f(np.array(EDGE)), 1e-11)


@pytest.mark.parametrize("chunk", range(3))
def test_binary(pairs, arrays, chunk):
    names = sorted(NP2)[chunk::3]
    got = pairs.select("i", *[getattr(ew, n)("a", "b").alias(n) for n in names]).orderBy("i").toPandas()
    a, b = arrays
    with np.errstate(all="ignore"):
        for n in names:
            want = NP2[n](a, b)
            mask = np.ones(len(a), bool)
            if n == "power":  # IEEE and C differ where the base is 1 or -1 and the exponent isn't finite
                mask = ~((np.abs(a) == 1) & ~np.isfinite(b))
            if n in ("mod", "fmod"):
                mask = np.isfinite(a) & np.isfinite(b) & (np.abs(a) < 1e300) & (np.abs(b) > 1e-300)
            same(got[n].to_numpy()[mask], want[mask], 1e-9)


def test_parts_and_choices(spark):
    v = [2.75, -2.75, 0.0, 8.0, 1e300, 0.1, -1.0, math.inf, math.nan]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x double")
    got = df.select("i", ew.modf("x").alias("m"), ew.frexp("x").alias("f"), ew.heaviside("x", 0.25).alias("h"), ew.nanToNum("x").alias("n"), ew.clip("x", -1, None).alias("c"), ew.where("x", 1.0, 2.0).alias("w"), ew.select([F.col("x") > 5, F.col("x") < 0], [10.0, 20.0], 30.0).alias("s"), ew.piecewise("x", [F.col("x") < 0], [lambda x: -x, 7.0]).alias("p"), ew.polyval("x", [1.0, 0.0, -1.0]).alias("q"), ew.choose(F.lit(5.0), ["x", 1.0], "wrap").alias("o"), ew.ldexp("x", 3).alias("l")).orderBy("i").collect()
    for x, r in zip(v, got, strict=True):
        if math.isfinite(x):
            same([r.m.frac, r.m.integ], np.modf(x))
            same([r.f.mantissa, r.f.exponent], np.frexp(x))
            same([r.l, r.q], [x * 8, x * x - 1])
        same([r.h, r.c], [np.heaviside(x, 0.25) if x == x else 1.0, np.clip(x, -1, None)])
    assert [r.s for r in got] == [30, 20, 30, 10, 10, 30, 20, 10, 10] and got[1].p == 2.75 and got[0].p == 7.0 and got[3].o == 1.0
    assert got[8].n == 0 and got[7].n == np.finfo(float).max and [r.w for r in got][:3] == [1, 1, 2]


def test_integers(spark):
    rows = [(a, b) for a in (-7, -1, 0, 5, 12, 1000, 2**31 - 1) for b in (0, 1, 3, 5, 18, 31)]
    got = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "a double, b double").select(ew.bitwiseAnd("a", "b").alias("n"), ew.bitwiseOr("a", "b").alias("o"), ew.bitwiseXor("a", "b").alias("x"), ew.bitwiseNot("a").alias("t"), ew.leftShift("a", "b").alias("l"), ew.rightShift("a", "b").alias("r"), ew.gcd("a", "b").alias("g"), ew.lcm("a", "b").alias("m"), ew.floorDivide("a", "b").alias("f")).collect()
    for (a, b), r in zip(rows, got, strict=True):
        i, j = np.int32(a), np.int32(b)
        want = [i & j, i | j, i ^ j, ~i, np.left_shift(i, j), np.right_shift(i, j), math.gcd(a, b), math.lcm(a, b)]
        assert [r.n, r.o, r.x, r.t, r.l, r.r, r.g, r.m] == [float(w) for w in want]
        same([r.f], [a // b if b else (math.nan if a == 0 else math.copysign(math.inf, a))])


def test_wrapping_casts(spark):
    v = [0.0, -1.5, 1.9, 127.0, 128.0, -129.0, 255.0, 256.0, 300.7, 70000.0, -70000.0, 2.0**31, -(2.0**31) - 1, 2.0**40 + 5, math.nan, math.inf, 2.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x double")
    got = df.select("i", *[ew.astype("x", k).alias(k) for k in dtype.SPARK]).orderBy("i").collect()
    for x, r in zip(v, got, strict=True):
        whole = int(x) if math.isfinite(x) else 0
        for k, bits in dtype.BITS.items():
            w = whole % 2**bits
            assert r[k] == (w - 2**bits if k not in ("uint8", "bool") and w >= 2 ** (bits - 1) else w), (x, k)
    assert dtype.result_type("int8", "uint8") == "int8" and dtype.result_type("bool", "float32", "int32") == "float32" and dtype.result_type() == "float64"


def test_activations(spark):
    x = np.array([-3.0, -0.5, 0.0, 0.5, 7.0])
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select(*[getattr(ew, n)("x").alias(n) for n in "relu relu6 leakyRelu gelu sigmoid silu".split()]).toPandas()
    sig = 1 / (1 + np.exp(-x))
    want = {"relu": np.maximum(x, 0), "relu6": np.clip(x, 0, 6), "leakyRelu": np.where(x > 0, x, 0.01 * x), "gelu": 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3))), "sigmoid": sig, "silu": x * sig}
    for n, w in want.items():
        same(got[n], w)


def test_vectorize_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    got = [r.y for r in df.select(ew.vectorize(lambda v: v + 1)("x").alias("y")).collect()]
    assert got[0] == 2.0 and math.isnan(got[1])
    assert math.isnan(df.where("x is null").select(ew.add("x", 1).alias("y")).first().y)


def test_signs_of_zeros_in_binary_math(spark, tmp_path):
    """Every row as text, which tells -0 from 0, against the query's SQL; and remainders against NumPy."""
    import duckdb

    from tessera import queries

    rows = [(i, i % 7, i, i, 1.0 * i, float(q), d / 100) for i, (q, d) in enumerate((q, d) for q in range(1, 51) for d in range(11))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = db.execute(queries.SQL["binary_math"])
    columns = [c[0] for c in want.description]
    got = queries.binary_math(spark, str(tmp_path)).select(*columns).collect()
    texts = lambda found: sorted(tuple("nan" if v != v else str(v) for v in x) for x in found)
    assert texts(got) == texts(want.fetchall())
    zeros = spark.createDataFrame([(-7.0, 7.0), (7.0, -7.0), (-0.0, 7.0), (0.0, -7.0)], "a double, b double").select(ew.mod("a", "b").alias("v"))
    assert [math.copysign(1, x.v) for x in zeros.collect()] == [1, -1, 1, -1]


def test_binary_math_of_other_doubles(spark, tmp_path):
    """Discounts that round to -0, and products whose binary and decimal roundings differ, against the query's SQL as text; powers, which
    libraries give to the last bit or one beside it, to a few units of it."""
    import random

    import duckdb

    from tessera import queries

    r = random.Random(1)
    pairs = [(25.0, d) for d in (0.0451, 0.0499, 0.05, 0.0501, 0.045, 0.055)] + [(q, d) for q in (24.0, 26.0, 24.99, 25.01) for d in (0.0451, 0.0499, 0.0, 0.1)]
    pairs += [(round(r.uniform(1, 51), 2), r.uniform(0, 0.1)) for _ in range(3000)]
    rows = [(i, i % 7, i, i, 1.0 * i, q, d) for i, (q, d) in enumerate(pairs)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = db.execute(queries.SQL["binary_math"])
    columns = [c[0] for c in want.description]
    got, want = sorted(queries.binary_math(spark, str(tmp_path)).select(*columns).collect()), sorted(want.fetchall())
    k = columns.index("power")
    texts = lambda found: [tuple("nan" if v != v else str(v) for v in (*x[:k], *x[k + 1 :])) for x in found]
    assert texts(got) == texts(want)
    assert all(abs(x[k] - y[k]) <= 2e-15 * abs(y[k]) + 1e-9 for x, y in zip(got, want, strict=True))


def test_signed_rounds_in_binary(spark):
    from tessera import queries

    rows = [(0.4999999999999999, 0.0), (0.5, 1.0), (-0.5, -1.0), (2.5, 3.0), (-0.3, -0.0), (-0.0, -0.0), (0.0, 0.0), (1e300, 1e300), (-1e18, -1e18), (math.inf, math.inf), (-math.inf, -math.inf), (4503599627370497.0, 4503599627370497.0)]
    got = spark.createDataFrame(rows, "x double, y double").select(queries.signed(F.col("x"), 0).alias("v"), "y").collect()
    assert [(x.v, math.copysign(1, x.v)) for x in got] == [(x.y, math.copysign(1, x.y)) for x in got]
    nan, huge = spark.createDataFrame([(math.nan,), (1e308,)], "x double").select(queries.signed(F.col("x")).alias("v")).collect()
    assert math.isnan(nan.v) and huge.v == 1e308
