"""Queries that list the results of many operations on a few small tensors as rows (op, i0, i1, v), with the SQL of each.

Tensors come from the standard tables: a vector of 25 numbers and a matrix of 5 x 5 from nation, the mean products of three
columns of lineitem. Factorizations and transforms are listed by what defines them: factors multiplied back, inverses by identities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import elementwise as ew
from .operators import nn
from .plans.tensor import Tensor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Inventory names that a query's rows hold to their SQL.
COVERS: dict[str, set[str]] = {}

#: Digits to which values are compared.
DIGITS = 6

#: What the SQL of the operations reads: x(i, x), m(i0, i1, v), the same as a matrix, and g(i0, i1, v), mean products of three columns.
BASE = """x AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, ((n_nationkey * 7) % 11)::DOUBLE AS x FROM nation),
m AS (SELECT i // 5 AS i0, i % 5 AS i1, x AS v FROM x),
f AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 10 AS c, l_extendedprice / 100000 AS y FROM lineitem),
w AS (SELECT avg(a * a) AS aa, avg(a * b) AS ab, avg(a * c) AS ac, avg(b * b) AS bb, avg(b * c) AS bc, avg(c * c) AS cc, avg(a * y) AS ay, avg(b * y) AS by_, avg(c * y) AS cy FROM f),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM w),
g AS (SELECT i0, i1, v FROM (SELECT unnest([0, 0, 0, 1, 1, 1, 2, 2, 2]) AS i0, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2]) AS i1, unnest([aa, ab, ac, ab, bb, bc, ac, bc, cc]) AS v FROM w)),
inv AS (SELECT unnest([0, 0, 0, 1, 1, 1, 2, 2, 2]) AS i0, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2]) AS i1, unnest([bb * cc - bc * bc, ac * bc - ab * cc, ab * bc - ac * bb, ac * bc - ab * cc, aa * cc - ac * ac, ab * ac - aa * bc, ab * bc - ac * bb, ab * ac - aa * bc, aa * bb - ab * ab]) / 1 AS u, det FROM d),
gi AS (SELECT i0, i1, u / det AS v FROM inv),
gg AS (SELECT a.i0, b.i1, sum(a.v * b.v) AS v FROM g a JOIN g b ON a.i1 = b.i0 GROUP BY ALL),
ggg AS (SELECT a.i0, b.i1, sum(a.v * b.v) AS v FROM gg a JOIN g b ON a.i1 = b.i0 GROUP BY ALL),
n3 AS (SELECT unnest(range(3)) AS i), n4 AS (SELECT unnest(range(4)) AS i), n5 AS (SELECT unnest(range(5)) AS i), n8 AS (SELECT unnest(range(8)) AS i), n25 AS (SELECT unnest(range(25)) AS i),
e3 AS (SELECT a.i AS i0, b.i AS i1, (a.i = b.i)::INT::DOUBLE AS v FROM n3 a, n3 b)"""


def grid(rows: int, columns: int, v: str) -> str:
    return f"SELECT a.i AS i0, b.i AS i1, {v} AS v FROM (SELECT unnest(range({rows})) AS i) a, (SELECT unnest(range({columns})) AS i) b"


def line(n: int, v: str) -> str:
    return f"SELECT i AS i0, 0 AS i1, {v} AS v FROM (SELECT unnest(range({n})) AS i)"


def values(*v: float) -> str:
    return f"SELECT i AS i0, 0 AS i1, [{', '.join(f'{x}::DOUBLE' for x in v)}][i + 1] AS v FROM (SELECT unnest(range({len(v)})) AS i)"


def one(v: str, of: str = "(SELECT 1)") -> str:
    return f"SELECT 0 AS i0, 0 AS i1, {v} AS v FROM {of}"


def listed(spark: SparkSession, parts: dict) -> DataFrame:
    """Tensors (one index or two; more are flattened), numbers and truth values as rows of one table."""
    frames, known = [], []
    for op, t in parts.items():
        if isinstance(t, (bool, int, float)):
            known.append((op, 0, 0, float(t)))
            continue
        if isinstance(t, (list, tuple)) and all(isinstance(x, (int, float)) for x in t):
            known += [(op, i, 0, float(x)) for i, x in enumerate(t)]
            continue
        t = t if t.ndim <= 2 else api.flatten(t)
        index = [F.col(f"i{k}") if k < t.ndim else F.lit(0).cast("long").alias(f"i{k}") for k in range(2)]
        frames.append(t.df.select(F.lit(op).alias("op"), *index, "v"))
    if known:
        frames.append(spark.createDataFrame(known, "op string, i0 long, i1 long, v double"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    v = F.round("v", DIGITS)
    return out.withColumn("v", F.when(v == 0, 0.0).otherwise(v))


def listing(sql: dict[str, str], also: str = ""):
    """Registers a function of (spark, vector, matrix, products) that returns results by op; ``sql`` has (i0, i1, v) of every op.

    An op's name is that of the operation, with what tells several of one apart after a dot; ``also`` names operations that others use.
    """

    def register(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = f(Given(spark, sf_dir))
            if found.keys() != sql.keys():
                raise ValueError(f"results and SQL differ: {found.keys() ^ sql.keys()}")
            return listed(spark, found)

        body = " UNION ALL ".join(f"SELECT '{op}' AS op, i0::BIGINT AS i0, i1::BIGINT AS i1, v::DOUBLE AS v FROM ({q}) AS q" for op, q in sql.items())
        QUERIES[f.__name__] = query
        SQL[f.__name__] = f"WITH RECURSIVE {BASE} SELECT op, i0, i1, CASE WHEN round(v, {DIGITS}) = 0 THEN 0 ELSE round(v, {DIGITS}) END::DOUBLE AS v FROM ({body}) AS r"
        COVERS[f.__name__] = {op.split(".")[0] for op in sql} | set(also.split())
        return f

    return register


class Given:
    """The tensors that operations are listed for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def x(self) -> Tensor:
        v = (F.col("n_nationkey") * 7) % 11
        return Tensor.from_table(self.table("nation").select("n_nationkey", v.alias("x")), "x", "n_nationkey")

    @property
    def m(self) -> Tensor:
        return api.reshape(self.x, (5, 5))

    @property
    def features(self) -> DataFrame:
        return self.table("lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 10).alias("c"), (F.col("l_extendedprice") / 100000).alias("y"))

    def products(self, rows: str, columns: str) -> Tensor:
        cells = F.array(*[F.struct(F.lit(i).cast("long").alias("i0"), F.lit(j).cast("long").alias("i1"), F.avg(F.col(p) * F.col(q)).alias("v")) for i, p in enumerate(rows) for j, q in enumerate(columns)])
        return Tensor(self.features.agg(cells.alias("cells")).select(F.inline("cells")), (len(rows), len(columns)))

    @property
    def g(self) -> Tensor:
        return self.products("abc", "abc")

    def array(self, data, shape=None) -> Tensor:
        return api.array(self.spark, data, shape)

    def counted(self, *shape: int) -> Tensor:
        """0, 1, ... in row-major order."""
        n = 1
        for k in shape:
            n *= k
        return api.reshape(api.arange(self.spark, n), shape)


# Linear algebra.

_ID = "SELECT i0, i1, v FROM e3"
_G = "SELECT i0, i1, v FROM g"


@listing(
    {
        "det": one("det", "d"),
        "slogdet": one("ln(det)", "d"),
        "slogdet.sign": one("1"),
        "inv": "SELECT i0, i1, v FROM gi",
        "pinv": "SELECT i0, i1, v FROM gi",
        "solve": "SELECT i0, 0 AS i1, sum(gi.v * (gi.i1 + 1)) AS v FROM gi GROUP BY i0",
        "cholesky": "SELECT unnest([0, 0, 0, 1, 1, 1, 2, 2, 2]) AS i0, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2]) AS i1, unnest([sqrt(aa), 0, 0, ab / sqrt(aa), sqrt(bb - ab * ab / aa), 0, ac / sqrt(aa), (bc - ab * ac / aa) / sqrt(bb - ab * ab / aa), sqrt(det / (aa * bb - ab * ab))]) AS v FROM d",
        "matrixPower": "SELECT i0, i1, v FROM ggg",
        "matrixPower.negative": "SELECT a.i0, b.i1, sum(a.v * b.v) AS v FROM gi a JOIN gi b ON a.i1 = b.i0 GROUP BY ALL",
        "matrixRank": one("3"),
        "rank": one("1"),
        "cond": "SELECT 0 AS i0, 0 AS i1, sqrt(a.s * b.s) AS v FROM (SELECT sum(v * v) AS s FROM g) a, (SELECT sum(v * v) AS s FROM gi) b",
        "qr": _G,
        "qr.orthogonal": _ID,
        "svd": _G,
        "svd.squares": one("sum(v * v)", "g"),
        "eigh": _G,
        "eig": _ID,
        "eigvals": "SELECT unnest([0, 1, 2]) AS i0, 0 AS i1, unnest([aa + bb + cc, s, det]) AS v FROM d, (SELECT sum(v * v) AS s FROM g)",
        "eigvalsh": "SELECT unnest([0, 1, 2]) AS i0, 0 AS i1, unnest([aa + bb + cc, s, det]) AS v FROM d, (SELECT sum(v * v) AS s FROM g)",
        "lu": _G,
        "lu.lower": "SELECT i0, i1, v FROM e3 WHERE i1 >= i0",
        "lstsq": "SELECT gi.i0, 0 AS i1, sum(gi.v * [ay, by_, cy][gi.i1 + 1]) AS v FROM gi, w GROUP BY gi.i0",
        "multiDot": "SELECT i0, i1, v FROM ggg",
        "dot": "SELECT i0, i1, v FROM gg",
        "inner": "SELECT i0, i1, v FROM gg",
        "vdot": one("sum(v * v)", "g"),
        "tensordot": "SELECT i0, i1, v FROM gg",
        "tensordot.two": one("sum(v * v)", "g"),
        "batchedMatmul": "SELECT k * 9 + i0 * 3 + i1 AS i0, 0 AS i1, v FROM (SELECT 0 AS k, i0, i1, v FROM gg UNION ALL SELECT 1, i0, i1, v FROM ggg)",
    },
    also="matmul trace gram",
)
def linear_algebra(given):
    g = given.g
    g = Tensor(api.materializeAll(g)[0].df, (3, 3))
    q, s, h, w, p, log = api.qr(g), api.svd(g), api.eigh(g), api.eig(g), api.lu(g), api.slogdet(g)
    scaled = lambda u, v: api.multiply(u, api.reshape(v, (1, 3)))
    moments = lambda v: api.concatenate([api.reshape(f, (1,)) for f in (api.sum(v), api.sum(api.square(v)), api.prod(v))])
    vector = given.array([1.0, 2.0, 3.0])
    lower = Tensor(p["l"].df.where("i1 >= i0"), (3, 3))
    a = Tensor.from_features(given.features.withColumn("id", F.xxhash64("a", "b", "c", "y")), ["a", "b", "c", "y"], ["id", "a", "b", "c", "y"])
    columns = lambda start, stop: api.slice_axis(a, 1, start, stop)
    return {
        "det": api.det(g),
        "slogdet": log["logabsdet"],
        "slogdet.sign": log["sign"],
        "inv": api.inv(g),
        "pinv": api.pinv(g),
        "solve": api.solve(g, vector),
        "cholesky": api.cholesky(g),
        "matrixPower": api.matrixPower(g, 3),
        "matrixPower.negative": api.matrixPower(g, -2),
        "matrixRank": api.matrixRank(g),
        "rank": api.lookup("rank")(api.outer(vector, vector)),
        "cond": api.cond(g, "fro"),
        "qr": api.matmul(q["q"], q["r"]),
        "qr.orthogonal": api.matmul(q["q"].T, q["q"]),
        "svd": api.matmul(scaled(s["u"], s["s"]), s["vt"]),
        "svd.squares": api.sum(api.square(s["s"])),
        "eigh": api.matmul(scaled(h["vectors"], h["values"]), h["vectors"].T),
        # A v = v w, so v^-1 A v / w is the identity.
        "eig": api.divide(api.matmul(api.matmul(api.inv(w["vectors"]), g), w["vectors"]), api.reshape(w["values"], (1, 3))),
        "eigvals": moments(api.eigvals(g)),
        "eigvalsh": moments(api.eigvalsh(g)),
        "lu": api.matmul(api.matmul(p["p"], p["l"]), p["u"]),
        "lu.lower": lower,
        "lstsq": api.lstsq(columns(0, 3), api.squeeze(columns(3, 4), 1))["x"],
        "multiDot": api.multiDot([g, g, g]),
        "dot": api.dot(g, g),
        "inner": api.inner(g, g.T),
        "vdot": api.vdot(g, g),
        "tensordot": api.tensordot(g, g, 1),
        "tensordot.two": api.tensordot(g, g, 2),
        "batchedMatmul": api.batchedMatmul(api.stack([g, api.matmul(g, g)]), api.stack([g, g])),
    }


# Transforms.

_DFT = "SELECT k AS i0, 0 AS i1, sum(x * {0}(2 * pi() * ((i * k) % 25) / 25)) * {1} AS v FROM x, (SELECT i AS k FROM n25) GROUP BY k"
_DFT2 = "SELECT p AS i0, q AS i1, sum(v * {0}(2 * pi() * ((i0 * p + i1 * q) % 5) / 5)) * {1} AS v FROM m, (SELECT a.i AS p, b.i AS q FROM n5 a, n5 b) GROUP BY p, q"
_X, _M = "SELECT i AS i0, 0 AS i1, x AS v FROM x", "SELECT i0, i1, v FROM m"


@listing(
    {
        "fft": _DFT.format("cos", 1),
        "fft.imag": _DFT.format("sin", -1),
        "ifft": _X,
        "rfft": f"SELECT * FROM ({_DFT.format('cos', 1)}) AS z WHERE i0 < 13",
        "rfft.imag": f"SELECT * FROM ({_DFT.format('sin', -1)}) AS z WHERE i0 < 13",
        "irfft": _X,
        "fft2": _DFT2.format("cos", 1),
        "fft2.imag": _DFT2.format("sin", -1),
        "ifft2": _M,
        "fftn": _DFT2.format("cos", 1),
        "ifftn": _M,
        "fftshift": "SELECT (i + 12) % 25 AS i0, 0 AS i1, x AS v FROM x",
        "ifftshift": _X,
        "rfftfreq": line(4, "i / 7::DOUBLE"),
        "fftshift.matrix": "SELECT (i0 + 2) % 5 AS i0, (i1 + 2) % 5 AS i1, v FROM m",
    }
)
def transforms(given):
    x, m = given.x, given.m
    z, h, two, n = api.fft(x), api.rfft(x), api.fft2(m), api.fftn(m)
    return {
        "fft": z["real"],
        "fft.imag": z["imag"],
        "ifft": api.ifft(z["real"], z["imag"])["real"],
        "rfft": h["real"],
        "rfft.imag": h["imag"],
        "irfft": api.irfft(h["real"], h["imag"], 25),
        "fft2": two["real"],
        "fft2.imag": two["imag"],
        "ifft2": api.ifft2(two["real"], two["imag"])["real"],
        "fftn": n["real"],
        "ifftn": api.ifftn(n["real"], n["imag"])["real"],
        "fftshift": api.fftshift(x),
        "ifftshift": api.ifftshift(api.fftshift(x)),
        "rfftfreq": api.rfftfreq(given.spark, 7),
        "fftshift.matrix": api.fftshift(m),
    }


# Polynomials.


@listing(
    {
        "polyadd": values(1, -6, 12, -8),
        "polysub": values(1, -6, 10, -4),
        "polymul": values(1, -8, 23, -28, 12),
        "polydiv": values(1, -4),
        "polydiv.remainder": values(1, -2),
        "polyder": values(3, -12, 11),
        "polyder.twice": values(6, -12),
        "polyint": values(0.25, -2, 5.5, -6, 7),
        "roots": values(1, 2, 3),
        "polyval": "SELECT i AS i0, 0 AS i1, x * x * x - 6 * x * x + 11 * x - 6 AS v FROM x",
        "polyfit": values(1, -6, 11, -6),
    }
)
def polynomials(given):
    p, q = given.array([1.0, -6.0, 11.0, -6.0]), given.array([1.0, -2.0])
    div = api.polydiv(given.array([1.0, -6.0, 9.0, -2.0]), given.array([1.0, -2.0, 0.0]))
    cubic = api.polyval(p, given.x)
    return {
        "polyadd": api.polyadd(p, q),
        "polysub": api.polysub(p, q),
        "polymul": api.polymul(p, q),
        "polydiv": div["quotient"] if "quotient" in div else div["q"],
        "polydiv.remainder": div["remainder"] if "remainder" in div else div["r"],
        "polyder": api.polyder(p),
        "polyder.twice": api.polyder(p, 2),
        "polyint": api.polyint(p, 1, 7.0),
        "roots": sorted(z.real for z in api.roots(p)),
        "polyval": cubic,
        "polyfit": api.polyfit(given.x, cubic, 3),
    }


# Creation.

_BESSEL = "list_sum(list_transform(range(0, 20), lambda k: pow(pow(({0}) / 2, k::DOUBLE) / factorial(k::INT), 2)))"


@listing(
    {
        "zeros": grid(2, 3, "0"),
        "ones": grid(2, 3, "1"),
        "full": grid(2, 3, "7.5"),
        "empty": grid(2, 3, "0"),
        "geomspace": line(5, "2 * pow(3::DOUBLE, i)"),
        "identity": grid(4, 4, "(a.i = b.i)::INT"),
        "diag": grid(4, 4, "CASE WHEN b.i = a.i + 1 THEN (a.i + 1) * 10 ELSE 0 END"),
        "diag.of": "SELECT i0, 0 AS i1, v FROM m WHERE i0 = i1",
        "diagflat": grid(4, 4, "CASE WHEN a.i = b.i THEN a.i ELSE 0 END"),
        "diagonal": "SELECT i0, 0 AS i1, v FROM m WHERE i0 = i1",
        "vander": "SELECT i AS i0, j AS i1, pow(x, 2 - j) AS v FROM x, (SELECT i AS j FROM n3)",
        "array": values(1, 2, 3),
        "asarray": values(4, 5),
        "fromiter": values(0, 1, 4, 9),
        "fromfunction": grid(3, 4, "a.i * 10 + b.i"),
        "copy": _M,
        "zerosLike": "SELECT i0, i1, 0 AS v FROM m",
        "onesLike": "SELECT i0, i1, 1 AS v FROM m",
        "emptyLike": "SELECT i0, i1, 0 AS v FROM m",
        "fullLike": "SELECT i0, i1, 3 AS v FROM m",
        "indices": grid(3, 4, "a.i"),
        "indices.second": grid(3, 4, "b.i"),
        "diagIndices": line(4, "i"),
        "trilIndices": "SELECT row_number() OVER (ORDER BY a.i, b.i) - 1 AS i0, 0 AS i1, a.i * 10 + b.i AS v FROM n4 a, n4 b WHERE b.i <= a.i + 1",
        "triuIndices": "SELECT row_number() OVER (ORDER BY a.i, b.i) - 1 AS i0, 0 AS i1, a.i * 10 + b.i AS v FROM n4 a, n4 b WHERE b.i >= a.i + 1",
        "ix_": grid(3, 4, "a.i * 10 + b.i * 100"),
        "kaiser": f"SELECT i AS i0, 0 AS i1, {_BESSEL.format('5 * sqrt(1 - pow(2 * i / 7::DOUBLE - 1, 2))')} / {_BESSEL.format('5::DOUBLE')} AS v FROM n8",
        "meshgrid": grid(4, 3, "b.i"),
        "causal_mask": grid(3, 3, "CASE WHEN b.i <= a.i THEN 0 ELSE '-inf'::DOUBLE END"),
    }
)
def creation(given):
    s, m, x = given.spark, given.m, given.x
    lower, upper = api.trilIndices(s, 4, 1), api.triuIndices(s, 4, 1)
    pair = lambda a, b: api.add(api.multiply(a, 10.0), b)
    rows, columns = api.ix_(api.arange(s, 3), api.arange(s, 4))
    return {
        "zeros": api.zeros(s, (2, 3)),
        "ones": api.ones(s, (2, 3)),
        "full": api.full(s, (2, 3), 7.5),
        "empty": api.empty(s, (2, 3)),
        "geomspace": api.geomspace(s, 2, 162, 5),
        "identity": api.identity(s, 4),
        "diag": api.diag(given.array([10.0, 20.0, 30.0]), 1),
        "diag.of": api.diag(m),
        "diagflat": api.diagflat(api.reshape(api.arange(s, 4), (2, 2))),
        "diagonal": api.lookup("diagonal")(m),
        "vander": api.vander(x, 3),
        "array": api.array(s, [1.0, 2.0, 3.0]),
        "asarray": api.asarray(s, [4.0, 5.0]),
        "fromiter": api.fromiter(s, (k * k for k in range(4))),
        "fromfunction": api.fromfunction(s, lambda i, j: i * 10 + j, (3, 4)),
        "copy": api.copy(m),
        "zerosLike": api.zerosLike(m),
        "onesLike": api.onesLike(m),
        "emptyLike": api.emptyLike(m),
        "fullLike": api.fullLike(m, 3.0),
        "indices": api.indices(s, (3, 4))[0],
        "indices.second": api.indices(s, (3, 4))[1],
        "diagIndices": api.diagIndices(s, 4)[1],
        "trilIndices": pair(*lower),
        "triuIndices": pair(*upper),
        "ix_": api.add(api.multiply(rows, 10.0), api.multiply(columns, 100.0)),
        "kaiser": api.kaiser(s, 8, 5.0),
        "meshgrid": api.meshgrid(api.arange(s, 3), api.arange(s, 4))[0],
        "causal_mask": api.lookup("causal_mask")(s, 3),
    }


# Shapes.

_T234 = "SELECT i AS i0, 0 AS i1, {0} AS v FROM (SELECT unnest(range(24)) AS i)"


@listing(
    {
        "reshape": grid(4, 6, "a.i * 6 + b.i"),
        "reshape_infer": grid(3, 8, "a.i * 8 + b.i"),
        "resize": grid(2, 4, "(a.i * 4 + b.i) % 5"),
        "flatten": _X,
        "ravel": _X,
        "transpose": "SELECT i1 AS i0, i0 AS i1, v FROM m",
        "transpose.axes": _T234.format("(i % 2) * 12 + (i // 2 % 3) * 4 + i // 6"),
        "swapaxes": _T234.format("(i % 2) * 12 + (i // 2 % 3) * 4 + i // 6"),
        "moveaxis": _T234.format("(i % 2) * 12 + i // 2 "),
        "squeeze": _X,
        "expandDims": "SELECT 0 AS i0, i AS i1, x AS v FROM x",
        "atleast1d": values(5),
        "atleast2d": "SELECT 0 AS i0, i AS i1, x AS v FROM x",
        "atleast3d": _X,
        "concatenate": "SELECT i0, i1, v FROM m UNION ALL SELECT i0 + 5, i1, v FROM m",
        "stack": "SELECT 0 AS i0, i AS i1, x AS v FROM x UNION ALL SELECT 1, i, x FROM x",
        "vstack": "SELECT 0 AS i0, i AS i1, x AS v FROM x UNION ALL SELECT 1, i, x FROM x",
        "rowStack": "SELECT 0 AS i0, i AS i1, x AS v FROM x UNION ALL SELECT 1, i, x FROM x",
        "hstack": "SELECT i0, i1, v FROM m UNION ALL SELECT i0, i1 + 5, v FROM m",
        "dstack": "SELECT (i0 * 5 + i1) * 2 + k AS i0, 0 AS i1, v + k AS v FROM m, (SELECT unnest([0, 1]) AS k)",
        "columnStack": "SELECT i AS i0, k AS i1, x + k AS v FROM x, (SELECT unnest([0, 1]) AS k)",
        "block": "SELECT i0 + 5 * a AS i0, i1 + 5 * b AS i1, v FROM m, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)",
        "split": "SELECT i - 5 AS i0, 0 AS i1, x AS v FROM x WHERE i BETWEEN 5 AND 9",
        "split.at": "SELECT i - 4 AS i0, 0 AS i1, x AS v FROM x WHERE i BETWEEN 4 AND 10",
        "arraySplit": "SELECT i - 7 AS i0, 0 AS i1, x AS v FROM x WHERE i BETWEEN 7 AND 12",
        "vsplit": "SELECT i0 - 2 AS i0, i1, v FROM m WHERE i0 >= 2",
        "hsplit": "SELECT i0, i1 - 2 AS i1, v FROM m WHERE i1 >= 2",
        "dsplit": line(12, "i * 2 + 1 + (i // 12)"),
        "chunk": "SELECT i - 14 AS i0, 0 AS i1, x AS v FROM x WHERE i BETWEEN 14 AND 20",
        "ndim": one("2"),
        "shape": values(5, 5),
        "size": one("25"),
        "tile": "SELECT i0 + 5 * k AS i0, i1, v FROM m, (SELECT i AS k FROM n3)",
        "repeat": "SELECT i0, i1 * 2 + k AS i1, v FROM m, (SELECT unnest([0, 1]) AS k)",
        "repeat_elements": "SELECT i * 3 + k AS i0, 0 AS i1, x AS v FROM x, (SELECT i AS k FROM n3)",
        "roll": "SELECT i0, (i1 + 2) % 5 AS i1, v FROM m",
        "flip": "SELECT 4 - i0 AS i0, 4 - i1 AS i1, v FROM m",
        "fliplr": "SELECT i0, 4 - i1 AS i1, v FROM m",
        "flipud": "SELECT 4 - i0 AS i0, i1, v FROM m",
        "rot90": "SELECT 4 - i1 AS i0, i0 AS i1, v FROM m",
        "slice": "SELECT i0 - 1 AS i0, i1 // 2 AS i1, v FROM m WHERE i0 IN (1, 2) AND i1 IN (0, 2, 4)",
        "broadcastTo": "SELECT k AS i0, i AS i1, x AS v FROM x, (SELECT i AS k FROM n3)",
        "broadcastArrays": "SELECT i0, i1, i1 AS v FROM m",
        "pad": "SELECT a.i AS i0, b.i - 0 AS i1, coalesce(m.v, 9) AS v FROM (SELECT unnest(range(7)) AS i) a CROSS JOIN (SELECT unnest(range(6)) AS i) b LEFT JOIN m ON m.i0 = a.i - 1 AND m.i1 = b.i",
        "array2string": one("len('[[1, 2.5]]')"),
        "result_type": one("1"),
        "isscalar": one("1"),
        "materializeAll": _M,
    }
)
def shapes(given):
    s, m, x, t = given.spark, given.m, given.x, given.counted(2, 3, 4)
    return {
        "reshape": api.reshape(t, (4, 6)),
        "reshape_infer": api.lookup("reshape_infer")(t, (-1, 8)),
        "resize": api.resize(api.arange(s, 5), (2, 4)),
        "flatten": api.flatten(m),
        "ravel": api.ravel(m),
        "transpose": api.transpose(m),
        "transpose.axes": api.transpose(t, (2, 1, 0)),
        "swapaxes": api.swapaxes(t, 0, 2),
        "moveaxis": api.moveaxis(t, 0, -1),
        "squeeze": api.squeeze(api.reshape(m, (25, 1))),
        "expandDims": api.expandDims(x, 0),
        "atleast1d": api.atleast1d(api.sum(given.array([2.0, 3.0]))),
        "atleast2d": api.atleast2d(x),
        "atleast3d": api.atleast3d(x),
        "concatenate": api.concatenate([m, m]),
        "stack": api.stack([x, x]),
        "vstack": api.vstack([x, x]),
        "rowStack": api.rowStack([x, x]),
        "hstack": api.hstack([m, m]),
        "dstack": api.dstack([m, api.add(m, 1.0)]),
        "columnStack": api.columnStack([x, api.add(x, 1.0)]),
        "block": api.block([[m, m], [m, m]]),
        "split": api.split(x, 5)[1],
        "split.at": api.split(x, [4, 11])[1],
        "arraySplit": api.arraySplit(x, 4)[1],
        "vsplit": api.vsplit(m, [2])[1],
        "hsplit": api.hsplit(m, [2])[1],
        "dsplit": api.dsplit(given.counted(2, 6, 2), 2)[1],
        "chunk": api.chunk(x, 7)[2],
        "ndim": api.ndim(m),
        "shape": list(api.shape(m)),
        "size": api.size(m),
        "tile": api.tile(m, (3, 1)),
        "repeat": api.repeat(m, 2, 1),
        "repeat_elements": api.lookup("repeat_elements")(x, 3),
        "roll": api.roll(m, 2, 1),
        "flip": api.flip(m),
        "fliplr": api.fliplr(m),
        "flipud": api.flipud(m),
        "rot90": api.rot90(m),
        "slice": api.lookup("slice")(m, (1, 0), (3, None), (1, 2)),
        "broadcastTo": api.broadcastTo(x, (3, 25)),
        "broadcastArrays": api.broadcastArrays(m, api.arange(s, 5))[1],
        "pad": api.pad(m, ((1, 1), (0, 1)), "constant", 9.0),
        "array2string": len(api.array2string(given.array([[1.0, 2.5]]))),
        "result_type": api.result_type("float32", "int32") == "float32",
        "isscalar": api.isscalar(3.0),
        "materializeAll": api.materializeAll(m)[0],
    }


# Places: gathering, scattering, masks.

_AT = "SELECT row_number() OVER (ORDER BY i) - 1 AS i0, 0 AS i1, i AS v FROM x WHERE x > 6"


@listing(
    {
        "compress": "SELECT i0 // 2 AS i0, i1, v FROM m WHERE i0 IN (1, 3)",
        "place": "SELECT i AS i0, 0 AS i1, CASE WHEN x > 6 THEN [70, 80, 90][(count_if(x > 6) OVER (ORDER BY i) - 1)::INT % 3 + 1] ELSE x END AS v FROM x",
        "put": "SELECT i0, i1, CASE i0 * 5 + i1 WHEN 0 THEN 7 WHEN 24 THEN 8 WHEN 6 THEN 9 ELSE v END AS v FROM m",
        "takeAlongAxis": "SELECT a.i0, k AS i1, b.v FROM (SELECT DISTINCT i0 FROM m) a, (SELECT unnest([0, 1]) AS k), m b WHERE b.i0 = a.i0 AND b.i1 = (a.i0 + k) % 5",
        "putAlongAxis": "SELECT i0, i1, CASE WHEN i1 = i0 THEN 50 WHEN i1 = (i0 + 1) % 5 THEN 50 ELSE v END AS v FROM m",
        "scatter": "SELECT i0, i1, CASE WHEN i1 = i0 THEN 100 + i0 * 2 WHEN i1 = (i0 + 1) % 5 THEN 101 + i0 * 2 ELSE v END AS v FROM m",
        "index_copy": "SELECT i0, i1, CASE i0 WHEN 4 THEN i1 WHEN 1 THEN 5 + i1 ELSE v END AS v FROM m",
        "insert": "SELECT i + (i >= 2)::INT AS i0, 0 AS i1, x AS v FROM x UNION ALL SELECT 2, 0, 99",
        "insert.axis": "SELECT i0, i1 + (i1 >= 1)::INT AS i1, v FROM m UNION ALL SELECT i, 1, 99 FROM n5",
        "deleteArr": "SELECT i - 1 AS i0, 0 AS i1, x AS v FROM x WHERE i BETWEEN 1 AND 23",
        "deleteArr.axis": "SELECT i0, i1 - (i1 > 2)::INT AS i1, v FROM m WHERE i1 <> 2",
        "append": "SELECT i0, i1, v FROM m UNION ALL SELECT i0 + 5, i1, v + 1 FROM m",
        "argwhere": "SELECT r AS i0, k AS i1, CASE k WHEN 0 THEN i0 ELSE j END AS v FROM (SELECT i0, i1 AS j, row_number() OVER (ORDER BY i0, i1) - 1 AS r FROM m WHERE v > 6) AS a, (SELECT unnest([0, 1]) AS k)",
        "flatnonzero": _AT,
        "nonzero_flat": _AT,
        "nonzero": "SELECT row_number() OVER (ORDER BY i) - 1 AS i0, 0 AS i1, i // 5 AS v FROM x WHERE x > 6",
        "extract": "SELECT row_number() OVER (ORDER BY i) - 1 AS i0, 0 AS i1, x AS v FROM x WHERE x > 6",
        "get_by_mask": "SELECT row_number() OVER (ORDER BY i) - 1 AS i0, 0 AS i1, x AS v FROM x WHERE x > 6",
        "set_by_mask": "SELECT i AS i0, 0 AS i1, CASE WHEN x > 6 THEN -1 ELSE x END AS v FROM x",
        "unravelIndex": values(0, 1, 2),
        "unravelIndex.second": values(0, 1, 3),
        "ravelMultiIndex": values(3, 9),
        "take": "SELECT [0, 1, 0, 0, 2][i1 + 1] AS i0, i0 AS i1, v FROM m WHERE i1 IN (0, 1, 4)",
        "fillDiagonal": "SELECT i0, i1, CASE WHEN i0 = i1 THEN 9 ELSE v END AS v FROM m",
        "where": "SELECT i0, i1, CASE WHEN v > 6 THEN v ELSE -1 END AS v FROM m",
        "where_cond": "SELECT i0, i1, CASE WHEN v > 6 THEN v ELSE -1 END AS v FROM m",
        "select": "SELECT i0, i1, CASE WHEN v > 6 THEN v WHEN v > 3 THEN v * 10 ELSE 5 END AS v FROM m",
        "choose": "SELECT i0, i1, CASE v::INT % 3 WHEN 0 THEN 10 WHEN 1 THEN v ELSE 30 END AS v FROM m",
        "piecewise": "SELECT i0, i1, CASE WHEN v > 6 THEN 1 WHEN v > 3 THEN v * v ELSE -5 END AS v FROM m",
        "tril": "SELECT i0, i1, CASE WHEN i1 <= i0 THEN v ELSE 0 END AS v FROM m",
        "triu": "SELECT i0, i1, CASE WHEN i1 >= i0 THEN v ELSE 0 END AS v FROM m",
        "packbits": "SELECT i // 8 AS i0, 0 AS i1, sum((x > 6)::INT << (7 - i % 8)::INT) AS v FROM x GROUP BY 1",
        "unpackbits": "SELECT i AS i0, 0 AS i1, (x > 6)::INT AS v FROM x UNION ALL SELECT 25 + i, 0, 0 FROM (SELECT unnest(range(7)) AS i)",
        "vectorize": "SELECT i0, i1, v * 10 + i1 AS v FROM m",
        "apply_along_axis": "SELECT i0, k AS i1, CASE k WHEN 0 THEN min(v) ELSE max(v) END AS v FROM m, (SELECT unnest([0, 1]) AS k) GROUP BY i0, k",
    },
    also="slice_axis",
)
def places(given):
    s, m, x = given.spark, given.m, given.x
    big, low = api.greater(m, 6.0), api.greater(m, 3.0)
    near = Tensor.grid(s, (5, 2), lambda i, k: (i + k) % 5)
    source = Tensor.grid(s, (5, 2), lambda i, k: 100 + i * 2 + k)
    unravelled = api.unravelIndex(given.array([0.0, 5.0, 11.0]), (3, 4))
    return {
        "compress": api.compress(given.array([0.0, 1.0, 0.0, 1.0]), m, 0),
        "place": api.place(x, api.greater(x, 6.0), [70.0, 80.0, 90.0]),
        "put": api.put(m, [0, -1, 6], [7.0, 8.0, 9.0]),
        "takeAlongAxis": api.takeAlongAxis(m, near, 1),
        "putAlongAxis": api.putAlongAxis(m, near, 50.0, 1),
        "scatter": api.scatter(m, 1, near, source),
        "index_copy": api.lookup("index_copy")(m, 0, given.array([4.0, 1.0]), given.counted(2, 5)),
        "insert": api.insert(x, 2, 99.0),
        "insert.axis": api.insert(m, 1, 99.0, 1),
        "deleteArr": api.deleteArr(x, [0, -1]),
        "deleteArr.axis": api.deleteArr(m, 2, 1),
        "append": api.append(m, api.add(m, 1.0), 0),
        "argwhere": api.argwhere(big),
        "flatnonzero": api.flatnonzero(api.greater(x, 6.0)),
        "nonzero_flat": api.lookup("nonzero_flat")(big),
        "nonzero": api.nonzero(big)[0],
        "extract": api.extract(big, m),
        "get_by_mask": api.lookup("get_by_mask")(m, big),
        "set_by_mask": api.lookup("set_by_mask")(x, api.greater(x, 6.0), -1.0),
        "unravelIndex": unravelled[0],
        "unravelIndex.second": unravelled[1],
        "ravelMultiIndex": api.ravelMultiIndex([given.array([0.0, 2.0]), given.array([3.0, 1.0])], (3, 4)),
        "take": api.transpose(api.take(m, given.array([0.0, 1.0, -1.0]), 1)),
        "fillDiagonal": api.fillDiagonal(m, 9.0),
        "where": api.where(big, m, -1.0),
        "where_cond": api.lookup("where_cond")(big, m, -1.0),
        "select": api.lookup("select")([big, low], [m, api.multiply(m, 10.0)], 5.0),
        "choose": api.choose(api.mod(m, 3.0), [10.0, m, 30.0]),
        "piecewise": api.piecewise(m, [big, api.logicalAnd(low, api.logicalNot(big))], [1.0, lambda v: v * v], -5.0),
        "tril": api.tril(m),
        "triu": api.triu(m),
        "packbits": api.packbits(api.greater(x, 6.0)),
        "unpackbits": api.unpackbits(api.packbits(api.greater(x, 6.0))),
        "vectorize": api.vectorize(lambda a, b: a * 10 + b)(m, api.arange(s, 5)),
        "apply_along_axis": api.apply_along_axis(lambda v: v[[v.argmin(), v.argmax()]], 1, m),
    }


# Order, counting and comparison.

_SORTED = "SELECT row_number() OVER (ORDER BY x) - 1 AS i0, 0 AS i1, x AS v FROM x"
_NAN = "SELECT i, CASE WHEN x <= 5 THEN x END AS x FROM x"


@listing(
    {
        "msort": "SELECT row_number() OVER (PARTITION BY i1 ORDER BY v) - 1 AS i0, i1, v FROM m",
        "partition": f"SELECT * FROM ({_SORTED}) AS s WHERE i0 = 7",
        "partition.sides": one("1"),
        "argpartition": f"SELECT * FROM ({_SORTED}) AS s WHERE i0 = 7",
        "sort_axis": "SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v) - 1 AS i1, v FROM m",
        "argsort_axis": "SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, i1 AS v FROM m",
        "shuffle": _SORTED,
        "permutation": line(9, "i"),
        "percentile": one("quantile_cont(x, 0.4)", "x"),
        "percentile.axis": "SELECT i0, 0 AS i1, quantile_cont(v, 0.4) AS v FROM m GROUP BY i0",
        "quantile": "SELECT i1 AS i0, 0 AS i1, quantile_cont(v, 0.3) AS v FROM m GROUP BY i1",
        "median": "SELECT i0, 0 AS i1, median(v) AS v FROM m GROUP BY i0",
        "nanpercentile": one("quantile_cont(x, 0.4)", f"({_NAN})"),
        "nanquantile": one("quantile_cont(x, 0.9)", f"({_NAN})"),
        "histogramBinEdges": line(6, "i * 2"),
        "histogram": "SELECT least(floor(x / 2), 4) AS i0, 0 AS i1, count(*) AS v FROM x GROUP BY 1",
        "unique": "SELECT row_number() OVER (ORDER BY x) - 1 AS i0, 0 AS i1, x AS v FROM (SELECT DISTINCT x FROM x)",
        "uniqueCounts": "SELECT row_number() OVER (ORDER BY x) - 1 AS i0, 0 AS i1, count(*) AS v FROM x GROUP BY x",
        "nancumsum": f"SELECT i AS i0, 0 AS i1, sum(coalesce(x, 0)) OVER (ORDER BY i) AS v FROM ({_NAN})",
        "nancumprod": f"SELECT i AS i0, 0 AS i1, product(coalesce(x + 1, 1)) OVER (ORDER BY i) / 1e6 AS v FROM ({_NAN}) WHERE i < 12",
        "cumsum": "SELECT i0, i1, sum(v) OVER (PARTITION BY i0 ORDER BY i1) AS v FROM m",
        "ediff1d": "SELECT * FROM (SELECT i AS i0, 0 AS i1, lead(x) OVER (ORDER BY i) - x AS v FROM x) WHERE v IS NOT NULL",
        "trapezoid": one("sum(x) - sum(x) FILTER (i IN (0, 24)) / 2", "x"),
        "allclose": one("1"),
        "arrayEqual": values(1, 0),
        "array_equiv": one("1"),
        "isreal": "SELECT i0, i1, 1 AS v FROM m",
        "nextafter": one("1"),
        "max_abs_diff": one("2"),
        "checksum": one("sum(v)", "m"),
        "norm": one("sqrt(sum(v * v))", "m"),
        "trace": one("sum(v) FILTER (i0 = i1)", "m"),
        "cross": values(-3, 6, -3),
        "einsum": "SELECT a.i0, b.i1, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.i1 = b.i0 GROUP BY ALL",
        "matmul": "SELECT a.i0, b.i1, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.i1 = b.i0 GROUP BY ALL",
        "matmul_f32_auto": "SELECT a.i0, b.i1, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.i1 = b.i0 GROUP BY ALL",
        "log_softmax": "SELECT i0, i1, v - ln(sum(exp(v)) OVER (PARTITION BY i0)) AS v FROM m",
        "rsqrt": "SELECT i0, i1, 1 / sqrt(v + 1) AS v FROM m",
        "as_type": "SELECT i0, i1, floor(v / 2) AS v FROM m",
    }
)
def ordering(given):
    s, m, x = given.spark, given.m, given.x
    odd = x.map(lambda v: F.when(v <= 5, v).otherwise(ew.NAN))
    part, place = api.partition(x, 7), api.argpartition(x, 7)
    kth = lambda t: Tensor(t.df.where("i0 = 7"), (25,))
    sides = part.df.agg(F.max(F.when(F.col("i0") < 7, F.col("v"))).alias("low"), F.min(F.when(F.col("i0") > 7, F.col("v"))).alias("high"), F.max(F.when(F.col("i0") == 7, F.col("v"))).alias("k")).first()
    above = api.nextafter(given.array([1.0]), 2.0)
    unique = api.uniqueCounts(x)
    counts = unique[1] if isinstance(unique, (list, tuple)) else Tensor(unique.select(F.col("place").alias("i0"), F.col("count").cast("double").alias("v")), (11,))
    return {
        "msort": api.msort(m),
        "partition": kth(part),
        "partition.sides": sides.low <= sides.k <= sides.high,
        "argpartition": Tensor(api.take(x, place).df.where("i0 = 7"), (25,)),
        "sort_axis": api.lookup("sort_axis")(m, 1),
        "argsort_axis": api.lookup("argsort_axis")(m, 1),
        "shuffle": api.sort(api.shuffle(x, 3)),
        "permutation": api.sort(api.permutation(9, s, 3)),
        "percentile": api.percentile(x, 40),
        "percentile.axis": api.percentile(m, 40, 1),
        "quantile": api.quantile(m, 0.3, 0),
        "median": api.median(m, 1),
        "nanpercentile": api.nanpercentile(odd, 40),
        "nanquantile": api.nanquantile(odd, 0.9),
        "histogramBinEdges": api.histogramBinEdges(x, 5),
        "histogram": api.histogram(x, 5)[0],
        "unique": api.unique(x),
        "uniqueCounts": counts,
        "nancumsum": api.nancumsum(odd),
        "nancumprod": api.divide(api.nancumprod(api.slice_axis(api.add(odd, 1.0), 0, 0, 12)), 1e6),
        "cumsum": api.cumsum(m, 1),
        "ediff1d": api.ediff1d(x),
        "trapezoid": api.trapezoid(x),
        "allclose": api.allclose(m, api.add(m, 1e-10)),
        "arrayEqual": [float(api.arrayEqual(m, api.copy(m))), float(api.arrayEqual(m, api.add(m, 1.0)))],
        "array_equiv": api.array_equiv(given.array([1.0, 2.0]), given.array([[1.0, 2.0], [1.0, 2.0]])),
        "isreal": api.isreal(m),
        "nextafter": 1.0 < above.item() <= 1.0 + 2.0**-52,
        "max_abs_diff": api.lookup("max_abs_diff")(m, api.add(m, 2.0)),
        "checksum": api.checksum(m),
        "norm": api.norm(x),
        "trace": api.trace(m),
        "cross": api.cross(given.array([1.0, 2.0, 3.0]), given.array([4.0, 5.0, 6.0])),
        "einsum": api.einsum("ij,jk->ik", m, m),
        "matmul": api.matmul(m, m),
        "matmul_f32_auto": api.lookup("matmul_f32_auto")(m, m),
        "log_softmax": api.lookup("log_softmax")(m, 1),
        "rsqrt": nn.rsqrt(api.add(m, 1.0)),
        "as_type": api.lookup("as_type")(api.divide(m, 2.0), "int32"),
    }


# Draws: how many, the share in the range, and whether mean and variance are as they should be (6 standard errors).


def _drawn(t: Tensor, mean: float | None, var: float | None, low: float, high: float, n: int = 20000, spread: bool = True) -> Tensor:
    v = F.col("v")
    close = F.lit(1.0) if mean is None else (F.abs(F.avg(v) - mean) < 6 * (var / n) ** 0.5).cast("double")
    wide = F.lit(1.0) if var is None or not spread else F.when((F.var_pop(v) > 0.8 * var) & (F.var_pop(v) < 1.25 * var), 1.0).otherwise(0.0)
    row = t.df.agg(F.count("*").cast("double").alias("a"), F.avg(v.between(low, high).cast("double")).alias("b"), close.alias("c"), wide.alias("d"))
    each = F.array(*[F.struct(F.lit(k).cast("long").alias("i0"), F.col(c).alias("v")) for k, c in enumerate("abcd")])
    return Tensor(row.select(F.inline(each)), (4,))


_DRAWS = "rand random uniform randn standardNormal normal randint exponential geometric lognormal weibull pareto rayleigh standardCauchy triangular wald poisson binomial negativeBinomial hypergeometric beta gamma chisquare standardT f vonmises zipf choice".split()


@listing({k: values(20000, 1, 1, 1) for k in _DRAWS} | {"multinomial": values(6000, 1, 1, 1), "dirichlet": values(6000, 1, 1, 1), "multivariateNormal": values(4000, 1, 1, 1), "seed": one("1"), "random_seed": one("1"), "repeatable": one("1")})
def draws(given):
    s, n, e = given.spark, (20000,), 1e300
    pi = 3.141592653589793
    out = {
        "rand": _drawn(api.rand(s, n, seed=1), 0.5, 1 / 12, 0, 1),
        "random": _drawn(api.random(s, n, seed=2), 0.5, 1 / 12, 0, 1),
        "uniform": _drawn(api.uniform(s, -2, 4, n, seed=3), 1, 3, -2, 4),
        "randn": _drawn(api.randn(s, n, seed=4), 0, 1, -e, e),
        "standardNormal": _drawn(api.standardNormal(s, n, seed=5), 0, 1, -e, e),
        "normal": _drawn(api.normal(s, 5, 2, n, seed=6), 5, 4, -e, e),
        "randint": _drawn(api.randint(s, 3, 9, n, seed=7), 5.5, 35 / 12, 3, 8),
        "exponential": _drawn(api.exponential(s, 2.0, n, seed=8), 2, 4, 0, e),
        "geometric": _drawn(api.geometric(s, 0.25, n, seed=9), 4, 12, 1, e),
        "lognormal": _drawn(api.lognormal(s, 0.0, 0.25, n, seed=10), 1.0317434074991028, 0.0686539, 0, e),
        "weibull": _drawn(api.weibull(s, 2.0, n, seed=11), 0.886226925452758, 0.2146018366, 0, e),
        "pareto": _drawn(api.pareto(s, 5.0, n, seed=12), 0.25, 0.1041667, 0, e),
        "rayleigh": _drawn(api.rayleigh(s, 2.0, n, seed=13), 2.5066282746310002, 1.7168146928, 0, e),
        "standardCauchy": _drawn(api.standardCauchy(s, n, seed=14), None, None, -e, e),
        "triangular": _drawn(api.triangular(s, 0, 1, 4, n, seed=15), 5 / 3, 13 / 18, 0, 4),
        "wald": _drawn(api.wald(s, 1.0, 3.0, n, seed=16), 1, 1 / 3, 0, e),
        "poisson": _drawn(api.poisson(s, 3.0, n, seed=17), 3, 3, 0, e),
        "binomial": _drawn(api.binomial(s, 10, 0.3, n, seed=18), 3, 2.1, 0, 10),
        "negativeBinomial": _drawn(api.negativeBinomial(s, 5, 0.5, n, seed=19), 5, 10, 0, e),
        "hypergeometric": _drawn(api.hypergeometric(s, 10, 20, 6, n, seed=20), 2, 6 * (10 / 30) * (20 / 30) * (24 / 29), 0, 6),
        "beta": _drawn(api.beta(s, 2, 3, n, seed=21), 0.4, 0.04, 0, 1),
        "gamma": _drawn(api.gamma(s, 2.0, 1.5, n, seed=22), 3, 4.5, 0, e),
        "chisquare": _drawn(api.chisquare(s, 4, n, seed=23), 4, 8, 0, e),
        "standardT": _drawn(api.standardT(s, 12, n, seed=24), 0, 1.2, -e, e),
        "f": _drawn(api.f(s, 5, 20, n, seed=25), 20 / 18, 2 * 400 * 23 / (5 * 324 * 16), 0, e),
        "vonmises": _drawn(api.vonmises(s, 0.0, 4.0, n, seed=26), 0, 0.2920, -pi, pi),
        "zipf": _drawn(api.zipf(s, 6.0, n, seed=27), 1.0192657, 0.0275, 1, e, spread=False),
        "choice": _drawn(api.choice(api.arange(s, 10), 20000, True, None, 28), 4.5, 8.25, 0, 9),
        "multinomial": _drawn(api.multinomial(s, 9, [0.2, 0.3, 0.5], 2000, 29), 3, 0.09 * 2 / 3 * 9 + 3, 0, 9, 6000),
        "dirichlet": _drawn(api.dirichlet(s, [2.0, 3.0, 5.0], 2000, 30), 1 / 3, 0.0328, 0, 1, 6000),
        "multivariateNormal": _drawn(api.multivariateNormal(given.array([1.0, 1.0]), given.array([[2.0, 0.5], [0.5, 2.0]]), 2000, 31), 1, 2, -e, e, 4000),
    }
    api.seed(5)
    first = api.rand(s, (100,))
    api.lookup("random_seed")(5)
    # Element by element: sums of equal numbers differ by the order in which executors send their parts.
    same = api.arrayEqual(first, api.rand(s, (100,)))
    return out | {"seed": same, "random_seed": same, "repeatable": api.arrayEqual(api.gamma(s, 2.0, 1.0, (500,), seed=3), Tensor(api.gamma(s, 2.0, 1.0, (5000,), seed=3).df.where("i0 < 500"), (500,)))}


# Tensors of pictures: the 5 x 5 matrix as one picture of one channel, or with its transpose as a second.

_CONV = "SELECT (h - a) * 4 + w - b AS i0, 0 AS i1, {0} AS v FROM (SELECT i0 AS h, i1 AS w, v FROM m) AS p, (SELECT a, b, a * 2 + b - 1 AS k FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)) AS k WHERE h - a BETWEEN 0 AND 3 AND w - b BETWEEN 0 AND 3 GROUP BY 1"
_DEEP = "SELECT c * 16 + (h - a) * 4 + w - b AS i0, 0 AS i1, {0} AS v FROM (SELECT 0 AS c, i0 AS h, i1 AS w, v FROM m UNION ALL SELECT 1, i1, i0, v FROM m) AS p, (SELECT a, b, a * 2 + b - 1 AS k FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)) AS k WHERE h - a BETWEEN 0 AND 3 AND w - b BETWEEN 0 AND 3 GROUP BY 1"
_RESIZED = "SELECT a.o * {n} + b.o AS i0, 0 AS i1, sum(v * a.k * b.k) AS v FROM m JOIN ({s}) a ON m.i0 = a.f JOIN ({s}) b ON m.i1 = b.f GROUP BY a.o, b.o"
_STEPS = "SELECT o, least(floor(z)::BIGINT + k, 4) AS f, CASE k WHEN 0 THEN 1 - (z - floor(z)) ELSE z - floor(z) END AS k FROM (SELECT o, greatest(0, (o + 0.5::DOUBLE) * {r} - 0.5::DOUBLE) AS z FROM (SELECT unnest(range({n})) AS o)), (SELECT unnest([0, 1]) AS k)"


@listing(
    {
        "conv2d": _CONV.format("sum(v * k) + 0.5"),
        "conv2d.stride": "SELECT i0 // 8 * 2 + i0 % 4 // 2 AS i0, 0 AS i1, v FROM (" + _CONV.format("sum(v * k)") + ") AS c WHERE i0 // 4 % 2 = 0 AND i0 % 2 = 0",
        "conv2dFused": _CONV.format("greatest(sum(v * k) - 9, 0)"),
        "depthwiseConv2d": _DEEP.format("sum(v * k * (c + 1))"),
        "depthwiseConv2dFused": _DEEP.format("least(greatest(sum(v * k * (c + 1)) - 9, 0), 6)"),
        "conv2d1x1SkipRelu": "SELECT o * 25 + i0 * 5 + i1 AS i0, 0 AS i1, greatest(m.v * (o + 1) - n.v + 1 + m.v, 0) AS v FROM m JOIN (SELECT i1 AS i0, i0 AS i1, v FROM m) n USING (i0, i1), (SELECT unnest([0, 1]) AS o)",
        "depthwisePointwiseSkipRelu": "SELECT i0 % 16 AS i0, 0 AS i1, greatest(sum(v * (c + 1)) - 10, 0) AS v FROM (SELECT i0, i0 // 16 AS c, v FROM (" + _DEEP.format("sum(v * k * (c + 1))") + ") AS d) AS e GROUP BY 1",
        "conv_transpose_2d": "SELECT (i0 * 2 + a) * 10 + i1 * 2 + b AS i0, 0 AS i1, v * (a * 2 + b - 1) AS v FROM m, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)",
        "conv2d_output_size": values(3, 4),
        "im2col": "SELECT (h - a) * 4 + w - b AS i0, a * 2 + b AS i1, v FROM (SELECT i0 AS h, i1 AS w, v FROM m) AS p, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b) WHERE h - a BETWEEN 0 AND 3 AND w - b BETWEEN 0 AND 3",
        "maxPool2d": "SELECT (i0 // 2) * 2 + i1 // 2 AS i0, 0 AS i1, max(v) AS v FROM m WHERE i0 < 4 AND i1 < 4 GROUP BY 1",
        "avgPool2d": "SELECT (i0 // 2) * 2 + i1 // 2 AS i0, 0 AS i1, avg(v) AS v FROM m WHERE i0 < 4 AND i1 < 4 GROUP BY 1",
        "globalAvgPool2d": one("avg(v)", "m"),
        "prelu": "SELECT i0 * 5 + i1 AS i0, 0 AS i1, CASE WHEN v > 5 THEN v - 5 ELSE 0.25 * (v - 5) END AS v FROM m",
        "leakyRelu": "SELECT i0, i1, CASE WHEN v > 5 THEN v - 5 ELSE 0.01 * (v - 5) END AS v FROM m",
        "gelu": "SELECT i0, i1, 0.5 * (v - 5) * (1 + tanh(0.7978845608028654::DOUBLE * ((v - 5) + 0.044715::DOUBLE * pow(v - 5, 3)))) AS v FROM m",
        "addRelu": "SELECT a.i0, a.i1, greatest(a.v - b.v, 0) AS v FROM m a JOIN m b ON a.i0 = b.i1 AND a.i1 = b.i0",
        "add": "SELECT a.i0, a.i1, a.v + b.v AS v FROM m a JOIN m b ON a.i0 = b.i1 AND a.i1 = b.i0",
        "mulScalar": "SELECT i0, i1, v * 2.5 AS v FROM m",
        "upsampleBilinear": _RESIZED.format(n=10, s=_STEPS.format(r="0.5::DOUBLE", n=10)),
        "resize": _RESIZED.format(n=7, s=_STEPS.format(r="5 / 7::DOUBLE", n=7)),
        "batchNorm": "SELECT i0 * 5 + i1 AS i0, 0 AS i1, (v - 4) / sqrt(9 + 1e-5::DOUBLE) * 2 + 1 AS v FROM m",
        "layer_norm": "SELECT i0, i1, (v - avg(v) OVER r) / sqrt(var_pop(v) OVER r + 1e-5::DOUBLE) AS v FROM m WINDOW r AS (PARTITION BY i0)",
        "rms_norm": "SELECT i0, i1, v / sqrt(avg(v * v) OVER (PARTITION BY i0) + 1e-5::DOUBLE) AS v FROM m",
        "softmax": "SELECT i0, i1, exp(v) / sum(exp(v)) OVER (PARTITION BY i1) AS v FROM m",
        "dequantize_linear": "SELECT i0, i1, (v - 3) * 0.5 AS v FROM m",
        "multinomial": values(5, 3),
        "zeros": grid(2, 2, "0"),
        "ones": grid(2, 2, "1"),
        "rand": one("9"),
        "randn": one("9"),
        "sessions": one("1"),
        "batches": _M,
    },
    also="setBackend getBackend beginBatch endBatch withBatch createBackend resizeBilinear",
)
def pictures(given):
    s, m = given.spark, given.m
    one_, two = api.reshape(m, (1, 1, 5, 5)), api.reshape(api.stack([m, m.T]), (1, 2, 5, 5))
    kernel = Tensor.grid(s, (1, 1, 2, 2), lambda o, c, a, b: a * 2 + b - 1)
    deep = Tensor.grid(s, (2, 1, 2, 2), lambda c, o, a, b: (a * 2 + b - 1) * (c + 1))
    point = Tensor.grid(s, (1, 2, 1, 1), lambda o, c, a, b: c + 1)
    # Two outputs of two channels: the first once and twice, less the second, and 1; the first again as what is skipped.
    mixed = Tensor.grid(s, (2, 2, 1, 1), lambda o, c, a, b: F.when(c == 0, o + 1).otherwise(-1))
    both = api.reshape(api.stack([m, m]), (1, 2, 5, 5))
    api.beginBatch()
    batch = api.withBatch(lambda: api.endBatch(m)[0])
    api.setBackend(s)
    drawn = nn.multinomial(given.array([0.0, 0.5, 0.5, 0.0]), 5, True, 3)
    inside = drawn.df.where("v IN (1, 2)").count()
    return {
        "conv2d": nn.conv2d(one_, kernel, given.array([0.5])),
        "conv2d.stride": nn.conv2d(one_, kernel, None, (2, 2)),
        "conv2dFused": nn.conv2dFused(one_, kernel, given.array([-9.0]), activation="relu"),
        "depthwiseConv2d": nn.depthwiseConv2d(two, deep),
        "depthwiseConv2dFused": nn.depthwiseConv2dFused(two, deep, given.array([-9.0, -9.0]), activation="relu6"),
        "conv2d1x1SkipRelu": nn.conv2d1x1SkipRelu(two, mixed, given.array([1.0, 1.0]), both),
        "depthwisePointwiseSkipRelu": nn.depthwisePointwiseSkipRelu(two, deep, None, point, given.array([-10.0])),
        "conv_transpose_2d": nn.conv_transpose_2d(one_, kernel, (2, 2)),
        "conv2d_output_size": list(nn.conv2d_output_size(5, 6, 3, 3)),
        "im2col": nn.im2col(one_, (2, 2)),
        "maxPool2d": nn.maxPool2d(one_, 2),
        "avgPool2d": nn.avgPool2d(one_, 2),
        "globalAvgPool2d": nn.globalAvgPool2d(one_),
        "prelu": nn.prelu(api.reshape(api.subtract(m, 5.0), (1, 1, 5, 5)), given.array([0.25])),
        "leakyRelu": nn.leakyRelu(api.subtract(m, 5.0)),
        "gelu": nn.gelu(api.subtract(m, 5.0)),
        "addRelu": nn.addRelu(m, api.negative(m.T)),
        "add": nn.add(m, m.T),
        "mulScalar": nn.mulScalar(m, 2.5),
        "upsampleBilinear": nn.upsampleBilinear(one_, 2.0),
        "resize": nn.resizeBilinear(one_, (7, 7)),
        "batchNorm": nn.batchNorm(one_, given.array([2.0]), given.array([1.0]), given.array([4.0]), given.array([9.0])),
        "layer_norm": nn.layer_norm(m, (5,)),
        "rms_norm": nn.rms_norm(m),
        "softmax": nn.softmax(m, 0),
        "dequantize_linear": nn.dequantize_linear(m, 0.5, 3.0),
        "multinomial": [inside, nn.multinomial(given.array([0.2, 0.3, 0.5]), 3, False, 1).df.select("v").distinct().count()],
        "zeros": api.zeros(s, (2, 2)),
        "ones": api.ones(s, (2, 2)),
        "rand": api.rand(s, (3, 3), seed=1).df.where("v > 0 AND v < 1").count(),
        "randn": api.randn(s, (3, 3), seed=1).df.where("v > -9 AND v < 9").count(),
        "sessions": api.getBackend() is s and api.createBackend(s) is s,
        "batches": batch,
    }


# Estimators: what is fitted is known, as classes lie far apart or a solution has a closed form.

_FAR = "(SELECT l_quantity / 50 + CASE WHEN l_linestatus = 'F' THEN 100 ELSE 0 END AS a, l_discount * 10 AS b, (l_linestatus = 'F')::INT AS k FROM lineitem)"
_LINE2 = "SELECT regr_r2(y, a) AS r2, regr_slope(y, a) AS slope, regr_intercept(y, a) AS cut FROM f"


@listing(
    {
        "StandardScaler.transform": "SELECT i AS i0, 0 AS i1, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS v FROM x",
        "StandardScaler.inverseTransform": _X,
        "MinMaxScaler.transform": "SELECT i AS i0, 0 AS i1, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS v FROM x",
        "MinMaxScaler.inverseTransform": _X,
        "LinearRegression.fit": f"SELECT unnest([0, 1]) AS i0, 0 AS i1, unnest([slope, cut]) AS v FROM ({_LINE2})",
        "LinearRegression.score": one("r2", f"({_LINE2})"),
        "LinearRegression.predict": one("avg(y)", "f"),
        "KMeans.fit": f"SELECT unnest([0, 1]) AS i0, 0 AS i1, unnest([min(a), max(a)]) AS v FROM (SELECT avg(a) AS a FROM {_FAR} GROUP BY k)",
        "KMeans.predict": f"SELECT k AS i0, 0 AS i1, count(*) AS v FROM {_FAR} GROUP BY k",
        "KMeans.fitPredict": f"SELECT k AS i0, 0 AS i1, count(*) AS v FROM {_FAR} GROUP BY k",
        "KMeans.random": f"SELECT k AS i0, 0 AS i1, count(*) AS v FROM {_FAR} GROUP BY k",
        "KMeans.transform": f"SELECT 0 AS i0, 0 AS i1, min(pow(t.a - c.a, 2) + pow(t.b - c.b, 2)) AS v FROM {_FAR} t, (SELECT k, avg(a) AS a, avg(b) AS b FROM {_FAR} GROUP BY k) c WHERE t.k <> c.k",
        "KMeans.fitTransform": f"SELECT 0 AS i0, 0 AS i1, min(pow(t.a - c.a, 2) + pow(t.b - c.b, 2)) AS v FROM {_FAR} t, (SELECT k, avg(a) AS a, avg(b) AS b FROM {_FAR} GROUP BY k) c WHERE t.k <> c.k",
        "KMeans.score": f"SELECT 0 AS i0, 0 AS i1, -sum(s) / 1000 AS v FROM (SELECT (var_pop(a) + var_pop(b)) * count(*) AS s FROM {_FAR} GROUP BY k)",
        "LogisticRegression.fit": one("1"),
        "LogisticRegression.predict": f"SELECT k AS i0, 0 AS i1, count(*) AS v FROM {_FAR} GROUP BY k",
        "LogisticRegression.predictProba": one("avg((y > 0.4)::INT)", "f"),
        "LogisticRegression.predictLogProba": one("1"),
        "LogisticRegression.score": one("1"),
        "MLPClassifier.predict": f"SELECT k AS i0, 0 AS i1, count(*) AS v FROM {_FAR} GROUP BY k",
        "MLPClassifier.predictProba": one("1"),
        "MLPClassifier.score": one("1"),
        "MLPRegressor.predict": one("1"),
        "MLPRegressor.score": one("1"),
        "logLoss": one("-avg(CASE WHEN y > 0.4 THEN ln(0.01 + 0.98 * a) ELSE ln(0.99 - 0.98 * a) END)", "f"),
        "trainTestSplit": "SELECT unnest([0, 1, 2]) AS i0, 0 AS i1, unnest([n - floor(n * 0.25 + 0.5), floor(n * 0.25 + 0.5), n]) AS v FROM (SELECT count(*) AS n FROM orders)",
        "stratifiedSplit": "SELECT row_number() OVER (ORDER BY o_orderstatus) - 1 AS i0, 0 AS i1, floor(count(*) * 0.2 + 0.5) AS v FROM orders GROUP BY o_orderstatus",
        "shuffleArray": "SELECT unnest([0, 1, 2]) AS i0, 0 AS i1, unnest([count(*), count(*) - 1, 0]) AS v FROM orders",
        "accuracyScore": one("avg(((a > 0.5) = (b > 0.5))::INT)", "f"),
    },
    also="fit transform inverseTransform predict fitPredict fitTransform score predictProba predictLogProba StandardScaler MinMaxScaler LinearRegression LogisticRegression KMeans MLPClassifier MLPRegressor _initKMeansPlusPlus _initRandom getParams setParams",
)
def estimators(given):
    from .operators.ml import metrics
    from .operators.ml.cluster import KMeans
    from .operators.ml.linear import LinearRegression, LogisticRegression
    from .operators.ml.mlp import MLPClassifier, MLPRegressor
    from .operators.ml.preprocess import MinMaxScaler, StandardScaler
    from .operators.ml.split import shuffleArray, trainTestSplit

    numbers = given.x.df.select("i0", F.col("v").alias("x"))
    tensor = lambda df: Tensor(df.select("i0", F.col("x").alias("v")), (25,))
    standard, ranged = StandardScaler().fit(numbers, ["x"]), MinMaxScaler().fit(numbers, ["x"])
    f = given.features
    straight = LinearRegression().fit(f, ["a"], "y")
    status = (F.col("l_linestatus") == "F").cast("int")
    far = given.table("lineitem").select((F.col("l_quantity") / 50 + status * 100).alias("a"), (F.col("l_discount") * 10).alias("b"), status.cast("double").alias("k"))
    counted = lambda df, c: Tensor(df.groupBy(F.col(c).cast("long").alias("i0")).agg(F.count("*").cast("double").alias("v")), (2,))
    near = KMeans(nClusters=2, nInit=2, randomState=1).fit(far, ["a", "b"])
    # Clusters are numbered by where they started; here by their centres.
    order = sorted(range(2), key=lambda c: near.clusterCenters_[c][0])
    by_centre = lambda model, df: df.withColumn("place", F.array_position(F.array(*[F.lit(c) for c in sorted(range(2), key=lambda c: model.clusterCenters_[c][0])]), F.col("label")) - 1)
    again, at_random = KMeans(nClusters=2, nInit=1, randomState=2), KMeans(nClusters=2, nInit=4, init="random", randomState=4)
    apart = lambda df: api.square(Tensor(df.agg(F.min(F.array_max("distances")).alias("v")), ()))
    scaled = far.select((F.col("a") / 100).alias("a"), "b", "k")
    logistic = LogisticRegression(C=1000.0, tol=1e-8).fit(scaled, ["a"], "k")
    half = f.withColumn("t", (F.col("y") > 0.4).cast("double"))
    plain = LogisticRegression(penalty=None, tol=1e-8).fit(half, ["b"], "t")
    proba = plain.predictProba(half)
    logs = plain.predictLogProba(proba)
    net = MLPClassifier(hiddenLayerSizes=(4,), maxIter=60, learningRateInit=0.1, randomState=3).fit(scaled, ["a"], "k")
    curve = MLPRegressor(hiddenLayerSizes=(4,), maxIter=80, learningRateInit=0.05, randomState=3).fit(scaled, ["a"], "k")
    worst = curve.predict(scaled).agg(F.max(F.abs(F.col("prediction") - F.col("k"))).alias("e")).first().e
    orders = given.table("orders")
    train, test = trainTestSplit(orders, "o_orderkey", randomState=3)
    _, held = trainTestSplit(orders, "o_orderkey", 0.2, randomState=3, stratify="o_orderstatus")
    classes = held.groupBy("o_orderstatus").count().orderBy("o_orderstatus").collect()
    mixed = shuffleArray(orders, "o_orderkey", 1).agg(F.countDistinct("o_orderkey", "place").alias("n"), F.max("place").alias("high"), F.min("place").alias("low")).first()
    return {
        "StandardScaler.transform": tensor(standard.transform(numbers)),
        "StandardScaler.inverseTransform": tensor(standard.inverseTransform(standard.transform(numbers))),
        "MinMaxScaler.transform": tensor(ranged.transform(numbers)),
        "MinMaxScaler.inverseTransform": tensor(ranged.inverseTransform(ranged.transform(numbers))),
        "LinearRegression.fit": [straight.coef_[0], straight.intercept_],
        "LinearRegression.score": straight.score(f),
        "LinearRegression.predict": Tensor(straight.predict(f).agg(F.avg("prediction").alias("v")), ()),
        "KMeans.fit": [near.clusterCenters_[c][0] for c in order],
        "KMeans.predict": counted(by_centre(near, near.predict(far)), "place"),
        "KMeans.fitPredict": counted(by_centre(again, again.fitPredict(far, ["a", "b"])), "place"),
        "KMeans.random": counted(by_centre(at_random, at_random.fitPredict(far, ["a", "b"])), "place"),
        "KMeans.transform": apart(near.transform(far)),
        "KMeans.fitTransform": apart(KMeans(nClusters=2, nInit=2, randomState=1).fitTransform(far, ["a", "b"])),
        "KMeans.score": near.score(far) / 1000,
        # At the optimum without decay the mean probability is the share of ones.
        "LogisticRegression.fit": logistic.coef_[0][0] > 0 > logistic.intercept_[0],
        "LogisticRegression.predict": counted(logistic.predict(scaled), "prediction"),
        "LogisticRegression.predictProba": Tensor(proba.agg(F.avg(F.col("probability")[1]).alias("v")), ()),
        "LogisticRegression.predictLogProba": Tensor(logs.agg((F.max(F.abs(F.exp(F.col("logProbability")[0]) - F.col("probability")[0])) < 1e-9).cast("double").alias("v")), ()),
        "LogisticRegression.score": logistic.score(scaled),
        "MLPClassifier.predict": counted(net.predict(scaled), "prediction"),
        "MLPClassifier.predictProba": Tensor(net.predictProba(scaled).agg(F.avg(F.col("probability")[0] + F.col("probability")[1]).alias("v")), ()),
        "MLPClassifier.score": net.score(scaled),
        "MLPRegressor.predict": worst < 0.5,
        "MLPRegressor.score": curve.score(scaled) > 0.9,
        "logLoss": Tensor(half.withColumn("p", 0.01 + 0.98 * F.col("a")).agg(metrics.logLoss("t", "p").alias("v")), ()),
        "trainTestSplit": [train.count(), test.count(), train.unionByName(test).select("o_orderkey").distinct().count()],
        "stratifiedSplit": [r["count"] for r in classes],
        "shuffleArray": [mixed.n, mixed.high, mixed.low],
        "accuracyScore": Tensor(f.select((F.col("a") > 0.5).cast("int").alias("a"), (F.col("b") > 0.5).cast("int").alias("b")).agg(metrics.accuracyScore("a", "b").alias("v")), ()),
    }


# The xorshift sequence of a seed, stepped through in SQL.

_STEPS_OF = "(WITH RECURSIVE z AS (SELECT 0::BIGINT AS k, 12345::BIGINT AS s UNION ALL SELECT k + 1, xor(b, (b << 5) & 4294967295) FROM (SELECT k, xor(a, a >> 17) AS b FROM (SELECT k, xor(s, (s << 13) & 4294967295) AS a FROM z WHERE k < 60))) SELECT k - 1 AS k, s / 4294967295::DOUBLE AS u FROM z WHERE k > 0)"


@listing(
    {
        "rand": f"SELECT k AS i0, 0 AS i1, u AS v FROM {_STEPS_OF} WHERE k < 20",
        "uniform": f"SELECT k - 20 AS i0, 0 AS i1, u * 6 - 2 AS v FROM {_STEPS_OF} WHERE k BETWEEN 20 AND 29",
        "randint": f"SELECT k - 30 AS i0, 0 AS i1, floor(u * 100) + 5 AS v FROM {_STEPS_OF} WHERE k BETWEEN 30 AND 39",
        "randn": f"SELECT a.k - 40 + j AS i0, 0 AS i1, sqrt(-2 * ln(a.u)) * CASE j WHEN 0 THEN cos(2 * pi() * b.u) ELSE sin(2 * pi() * b.u) END AS v FROM {_STEPS_OF} a JOIN {_STEPS_OF} b ON b.k = a.k + 1, (SELECT unnest([0, 1]) AS j) WHERE a.k BETWEEN 40 AND 48 AND a.k % 2 = 0",
        "normal": f"SELECT a.k - 50 + j AS i0, 0 AS i1, 3 + 2 * sqrt(-2 * ln(a.u)) * CASE j WHEN 0 THEN cos(2 * pi() * b.u) ELSE sin(2 * pi() * b.u) END AS v FROM {_STEPS_OF} a JOIN {_STEPS_OF} b ON b.k = a.k + 1, (SELECT unnest([0, 1]) AS j) WHERE a.k BETWEEN 50 AND 56 AND a.k % 2 = 0",
    },
    also="seed random standardNormal random_seed",
)
def sequences(given):
    s = given.spark
    api.seed(12345, sequence=True)
    found = {"rand": api.rand(s, (20,)), "uniform": api.uniform(s, -2, 4, (10,)), "randint": api.randint(s, 5, 105, (10,)), "randn": api.randn(s, (10,)), "normal": api.normal(s, 3, 2, (8,))}
    api.seed(0)
    return found


# Names under which operations are known as well.


@listing(
    {
        "absolute": "SELECT i0, i1, abs(v - 5) AS v FROM m",
        "neg": "SELECT i0, i1, -v AS v FROM m",
        "sub": "SELECT a.i0, a.i1, a.v - b.v AS v FROM m a JOIN m b ON a.i0 = b.i1 AND a.i1 = b.i0",
        "mul": "SELECT a.i0, a.i1, a.v * b.v AS v FROM m a JOIN m b ON a.i0 = b.i1 AND a.i1 = b.i0",
        "div": "SELECT a.i0, a.i1, a.v / (b.v + 1) AS v FROM m a JOIN m b ON a.i0 = b.i1 AND a.i1 = b.i0",
        "addScalar": "SELECT i0, i1, v + 2 AS v FROM m",
        "subScalar": "SELECT i0, i1, v - 2 AS v FROM m",
        "divScalar": "SELECT i0, i1, v / 2 AS v FROM m",
        "powScalar": "SELECT i0, i1, v * v AS v FROM m",
        "corrcoef": "SELECT a.i0, b.i0 AS i1, corr(a.v, b.v) AS v FROM m a JOIN m b USING (i1) GROUP BY a.i0, b.i0",
        "cov": "SELECT a.i0, b.i0 AS i1, covar_samp(a.v, b.v) AS v FROM m a JOIN m b USING (i1) GROUP BY a.i0, b.i0",
        "avg_pool_2d": "SELECT (i0 // 2) * 2 + i1 // 2 AS i0, 0 AS i1, avg(v) AS v FROM m WHERE i0 < 4 AND i1 < 4 GROUP BY 1",
        "max_pool_2d": "SELECT (i0 // 2) * 2 + i1 // 2 AS i0, 0 AS i1, max(v) AS v FROM m WHERE i0 < 4 AND i1 < 4 GROUP BY 1",
        "batch_norm": "SELECT i0 * 5 + i1 AS i0, 0 AS i1, (v - 4) / sqrt(9 + 1e-5::DOUBLE) AS v FROM m",
        "interpolate": _RESIZED.format(n=7, s=_STEPS.format(r="5 / 7::DOUBLE", n=7)),
    }
)
def other_names(given):
    m = given.m
    picture = api.reshape(m, (1, 1, 5, 5))
    by = lambda name: api.lookup(name)
    return {
        "absolute": by("absolute")(api.subtract(m, 5.0)),
        "neg": by("neg")(m),
        "sub": by("sub")(m, m.T),
        "mul": by("mul")(m, m.T),
        "div": by("div")(m, api.add(m.T, 1.0)),
        "addScalar": by("addScalar")(m, 2.0),
        "subScalar": by("subScalar")(m, 2.0),
        "divScalar": by("divScalar")(m, 2.0),
        "powScalar": by("powScalar")(m, 2.0),
        "corrcoef": api.corrcoef(m),
        "cov": api.cov(m),
        "avg_pool_2d": by("avg_pool_2d")(picture, 2),
        "max_pool_2d": by("max_pool_2d")(picture, 2),
        "batch_norm": by("batch_norm")(picture, None, None, given.array([4.0]), given.array([9.0])),
        "interpolate": by("interpolate")(picture, (7, 7)),
    }
