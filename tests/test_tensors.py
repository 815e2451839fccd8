"""Tensor operations against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.plans import order

R = np.random.default_rng(0)
V = R.normal(size=7)
M = R.normal(size=(3, 4))
T = R.normal(size=(2, 3, 4))
N = np.array([3.0, np.nan, 1.0, np.inf, 2.0, np.nan, 1.0])
NM = np.array([[1.0, np.nan, 3.0], [np.nan, np.nan, np.nan], [0.0, -2.0, 5.0]])


@pytest.fixture(scope="module")
def mk(spark):
    return lambda a: api.array(spark, np.asarray(a, float))


def check(got, want, tol=1e-9):
    want = np.asarray(want, float)
    got = got.numpy() if hasattr(got, "numpy") else np.asarray(got, float)
    assert got.shape == want.shape
    np.testing.assert_allclose(got, want, rtol=tol, atol=tol)


SIMPLE = "sum prod mean var std min max ptp argmin argmax median all any".split()


@pytest.mark.parametrize("name", SIMPLE)
def test_reductions(mk, name):
    f = getattr(np, name)
    check(getattr(api, name)(mk(T)), f(T))
    check(getattr(api, name)(mk(T), axis=1), f(T, axis=1))
    check(getattr(api, name)(mk(M), axis=-1, keepdims=True), f(M, axis=-1, keepdims=True))


@pytest.mark.parametrize("name", "nansum nanprod nanmean nanvar nanstd nanmin nanmax nanmedian".split())
@pytest.mark.filterwarnings("ignore")
def test_reductions_without_nan(mk, name):
    check(getattr(api, name)(mk(NM), axis=1), getattr(np, name)(NM, axis=1))
    check(getattr(api, name)(mk(NM)), getattr(np, name)(NM))


def test_nan_in_reductions(mk):
    assert np.isnan(api.min(mk(N)).item()) and np.isnan(api.max(mk(N)).item()) and np.isnan(api.sum(mk(N)).item())
    check(api.nanargmin(mk(NM), 1), [0, -1, 1])
    check(api.nanargmax(mk(NM), 1), [2, -1, 2])
    assert api.argmin(mk(N)).item() == 2 and api.argmax(mk(N)).item() == 3


def test_no_elements(mk, spark):
    none = api.zeros(spark, (0,))
    assert api.sum(none).item() == 0 and api.prod(none).item() == 1 and np.isnan(api.mean(none).item()) and api.all(none).item() == 1
    with pytest.raises(ValueError):
        api.min(none)
    check(api.sum(api.zeros(spark, (2, 0)), 1), [0, 0])


@pytest.mark.parametrize("method", ["linear", "lower", "higher", "midpoint", "nearest"])
def test_quantiles(mk, method):
    x = np.array([4.0, 1.0, 3.0, 2.0, 7.0])
    check(api.quantile(mk(x), 0.4, method=method), np.quantile(x, 0.4, method=method))
    check(api.percentile(mk(M), 30, axis=0, method=method), np.percentile(M, 30, axis=0, method=method))
    check(api.nanquantile(mk([1, np.nan, 2, 9.0]), 0.8, method=method), np.nanquantile([1, np.nan, 2, 9.0], 0.8, method=method))


def test_statistics(mk):
    check(api.cov(mk(M)), np.cov(M))
    check(api.cov(mk(M[0]), mk(M[1])), np.cov(M[0], M[1]))
    check(api.cov(mk(M), rowvar=False, bias=True), np.cov(M, rowvar=False, bias=True))
    check(api.corrcoef(mk(M)), np.corrcoef(M))
    check(api.average(mk(M), mk([1.0, 2, 3]), axis=0), np.average(M, axis=0, weights=[1, 2, 3]))
    check(api.trace(mk(M)), np.trace(M))
    for o in (1, 2, np.inf, -np.inf, 3):
        check(api.norm(mk(V), o), np.linalg.norm(V, o))
    check(api.norm(mk(M), "fro"), np.linalg.norm(M))
    check(api.norm(mk(M), 2), np.linalg.norm(M, 2))
    check(api.norm(mk(M), "nuc"), np.linalg.norm(M, "nuc"))
    check(api.norm(mk(M), 2, axis=1), np.linalg.norm(M, 2, axis=1))
    check(api.trapezoid(mk(V), dx=0.5), np.trapezoid(V, dx=0.5))
    check(api.trapezoid(mk(V), mk(np.sort(M.ravel())[:7])), np.trapezoid(V, np.sort(M.ravel())[:7]))
    check(api.apply_along_axis(lambda x: np.sort(x)[:2], 1, mk(M)), np.apply_along_axis(lambda x: np.sort(x)[:2], 1, M))


@pytest.mark.parametrize("bins", [5, "auto", "fd", "sturges", "rice", "sqrt", "scott", "doane", [-1.0, 0.0, 0.25, 2.0]])
def test_histograms(mk, bins):
    x = R.normal(size=300)
    hist, edges = api.histogram(mk(x), bins)
    want, want_edges = np.histogram(x, bins)
    check(edges, want_edges)
    check(hist, want)


def test_histogram_options(mk):
    x = np.array([1.0, 2, 2, 3, 9, np.nan])
    hist, _ = api.histogram(mk(x), 4, (0, 4), density=True)
    check(hist, np.histogram(x[:5], 4, (0, 4), density=True)[0])
    hist, _ = api.histogram(mk([5.0, 5.0]), 2)
    assert hist.numpy().sum() == 2
    a, b = R.normal(size=50), R.normal(size=50)
    check(api.histogram2d(mk(a), mk(b), 3)[0], np.histogram2d(a, b, 3)[0])
    check(api.bincount(mk([0, 1, 1, 5.0]), minlength=8), np.bincount([0, 1, 1, 5], minlength=8))
    check(api.bincount(mk([0, 1, 1.0]), mk([0.5, 1, 2.0])), np.bincount([0, 1, 1], [0.5, 1, 2]))
    with pytest.raises(ValueError):
        api.bincount(mk([-1.0]))
    check(api.digitize(mk(V), mk([-1.0, 0, 1])), np.digitize(V, [-1.0, 0, 1]))
    check(api.digitize(mk(V), mk([1.0, 0, -1]), right=True), np.digitize(V, [1.0, 0, -1], right=True))


def test_unique_and_sets(mk):
    x = np.array([3.0, 1, 2, 3, np.nan, 1, -0.0, 0.0, np.nan])
    want, index, counts = np.unique(x, return_index=True, return_counts=True)
    check(api.unique(mk(x)), want)
    table = api.uniqueTable(mk(x)).orderBy("place").toPandas()
    assert table["index"].tolist() == index.tolist() and table["count"].tolist() == counts.tolist()
    values, inverse = api.uniqueInverse(mk(x))
    np.testing.assert_array_equal(values.numpy()[inverse.numpy().astype(int)], np.where(x == 0, 0.0, x))
    a, b = np.array([1.0, 2, 2, 5]), np.array([2.0, 5, 7])
    check(api.union1d(mk(a), mk(b)), np.union1d(a, b))
    check(api.intersect1d(mk(a), mk(b)), np.intersect1d(a, b))
    check(api.setdiff1d(mk(a), mk(b)), np.setdiff1d(a, b))
    check(api.isin(mk(M), mk([M[0, 0], M[2, 1]])), np.isin(M, [M[0, 0], M[2, 1]]))


@pytest.mark.parametrize("block", [2, 1 << 15])
def test_running(mk, monkeypatch, block):
    monkeypatch.setattr(order, "BLOCK", block)
    for name in ("cumsum", "cumprod"):
        check(getattr(api, name)(mk(T)), getattr(np, name)(T))
        check(getattr(api, name)(mk(T), 1), getattr(np, name)(T, 1))
    x = np.array([1.0, np.nan, 3, 4])
    check(api.nancumsum(mk(x)), np.nancumsum(x))
    check(api.nancumprod(mk(x)), np.nancumprod(x))


def test_neighbours(mk):
    check(api.diff(mk(T), 2, axis=2), np.diff(T, 2, axis=2))
    check(api.diff(mk(V), prepend=1.0, append=2.0), np.diff(V, prepend=1.0, append=2.0))
    check(api.ediff1d(mk(M)), np.ediff1d(M))
    for order_ in (1, 2):
        check(api.gradient(mk(T), 1, order_), np.gradient(T, axis=1, edge_order=order_))
        check(api.gradient(mk(V), edgeOrder=order_), np.gradient(V, edge_order=order_))
    for mode in ("full", "same", "valid"):
        check(api.convolve(mk(V), mk([1.0, 2, -1]), mode), np.convolve(V, [1, 2, -1], mode))
        check(api.correlate(mk(V), mk([1.0, 2, -1, 3]), mode), np.correlate(V, [1, 2, -1, 3], mode))
    xp, fp, x = [0.0, 1, 3, 4], [1.0, 5, -1, 2], [-1.0, 0, 0.5, 1, 2.9, 4, 9]
    check(api.interp(mk(x), mk(xp), mk(fp)), np.interp(x, xp, fp))


def test_sorting(mk, monkeypatch):
    for a, axis in ((N, 0), (T, 1), (M, -1)):
        check(api.sort(mk(a), axis), np.sort(a, axis))
        check(api.argsort(mk(a), axis), np.argsort(a, axis, kind="stable"))
    check(api.msort(mk(M)), np.sort(M, 0))
    check(api.partition(mk(V), 3), np.sort(V))
    check(api.lexsort([mk([3.0, 1, 2, 1]), mk([1.0, 1, 0, 0])]), np.lexsort([[3, 1, 2, 1], [1, 1, 0, 0]]))
    values, places = api.topk(mk(M), 2, 1)
    check(values, -np.sort(-M, 1)[:, :2])
    check(places, np.argsort(-M, 1)[:, :2])
    check(api.topk(mk(V), 3)[0], -np.sort(-V)[:3])
    arr = np.array([1.0, 2, 2, 3, 8])
    for side in ("left", "right"):
        check(api.searchsorted(mk(arr), mk([[0.0, 2, 9], [2.5, 1, 8]]), side), np.searchsorted(arr, [[0.0, 2, 9], [2.5, 1, 8]], side))
        assert api.searchsorted(mk(arr), 2.0, side) == np.searchsorted(arr, 2.0, side)
    from tessera.operators import ordered

    monkeypatch.setattr(ordered, "LOOKUP", 2)
    for side in ("left", "right"):
        check(api.searchsorted(mk(arr), mk([[0.0, 2, 9], [2.5, 1, 8]]), side), np.searchsorted(arr, [[0.0, 2, 9], [2.5, 1, 8]], side))
    unsorted, sorter = arr[[4, 0, 3, 1, 2]], np.argsort(arr[[4, 0, 3, 1, 2]])
    check(api.searchsorted(mk(unsorted), mk([2.0]), sorter=mk(sorter)), np.searchsorted(unsorted, [2.0], sorter=sorter))


def test_shapes(mk):
    t = mk(T)
    for got, want in [
        (api.reshape(t, (4, -1)), T.reshape(4, -1)),
        (api.transpose(t), T.T),
        (api.transpose(t, (1, 2, 0)), T.transpose(1, 2, 0)),
        (api.swapaxes(t, 0, 2), T.swapaxes(0, 2)),
        (api.moveaxis(t, [0, 1], [-1, 0]), np.moveaxis(T, [0, 1], [-1, 0])),
        (api.squeeze(api.expandDims(t, 1)), T),
        (api.expandDims(t, -1), np.expand_dims(T, -1)),
        (api.flatten(t), T.ravel()),
        (api.resize(mk(V), (3, 5)), np.resize(V, (3, 5))),
        (api.atleast3d(mk(V)), np.atleast_3d(V)),
        (api.atleast2d(mk(V)), np.atleast_2d(V)),
        (api.concatenate([t, t], 1), np.concatenate([T, T], 1)),
        (api.concatenate([t, mk(V)], None), np.concatenate([T, V], None)),
        (api.stack([mk(M), mk(M)], 2), np.stack([M, M], 2)),
        (api.vstack([mk(V), mk(V)]), np.vstack([V, V])),
        (api.hstack([mk(M), mk(M)]), np.hstack([M, M])),
        (api.dstack([mk(M), mk(M)]), np.dstack([M, M])),
        (api.columnStack([mk(V), mk(V)]), np.column_stack([V, V])),
        (api.block([[mk(M), mk(M)], [mk(M), mk(M)]]), np.block([[M, M], [M, M]])),
        (api.tile(mk(M), (2, 1, 3)), np.tile(M, (2, 1, 3))),
        (api.repeat(mk(M), 2, 1), np.repeat(M, 2, 1)),
        (api.repeat(mk(M), 3), np.repeat(M, 3)),
        (api.roll(t, 5), np.roll(T, 5)),
        (api.roll(t, (1, -1), (0, 2)), np.roll(T, (1, -1), (0, 2))),
        (api.flip(t), np.flip(T)),
        (api.fliplr(t), np.fliplr(T)),
        (api.rot90(mk(M), 3), np.rot90(M, 3)),
        (api.rot90(t, 1, (1, 2)), np.rot90(T, 1, (1, 2))),
        (api.slice_(t, [0, 1, -1], [None, 3, None], [1, 1, -2]), T[0:, 1:3, -1::-2]),
        (api.diag(mk(V[:3]), -1), np.diag(V[:3], -1)),
        (api.diag(mk(M), 1), np.diag(M, 1)),
        (api.diagflat(mk(M[:2, :2])), np.diagflat(M[:2, :2])),
        (api.broadcastTo(mk(V), (2, 7)), np.broadcast_to(V, (2, 7))),
        (api.broadcastTo(mk(M[:, :1]), (2, 3, 4)), np.broadcast_to(M[:, :1], (2, 3, 4))),
    ]:
        check(got, want)


@pytest.mark.parametrize("mode", ["constant", "edge", "reflect", "wrap", "symmetric", "linear_ramp", "mean", "minimum", "maximum"])
def test_padding(mk, mode):
    check(api.pad(mk(M), (2, 1), mode), np.pad(M, (2, 1), mode))
    check(api.pad(mk(V), ((1, 3),), mode), np.pad(V, ((1, 3),), mode))


def test_splits(mk):
    for got, want in [(api.split(mk(M), 2, 1), np.split(M, 2, 1)), (api.split(mk(V), [2, 5]), np.split(V, [2, 5])), (api.arraySplit(mk(V), 3), np.array_split(V, 3)), (api.hsplit(mk(M), 2), np.hsplit(M, 2)), (api.vsplit(mk(M), 3), np.vsplit(M, 3)), (api.dsplit(mk(T), 2), np.dsplit(T, 2)), (api.chunk(mk(V), 3), [V[:3], V[3:6], V[6:]])]:
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            check(a, b)
    with pytest.raises(ValueError):
        api.split(mk(V), 2)


def test_gather_and_scatter(mk):
    i = np.array([[0, 2], [-1, 1]])
    check(api.take(mk(M), mk(i)), np.take(M, i))
    check(api.take(mk(T), mk([2, 0]), 1), np.take(T, [2, 0], 1))
    assert np.isnan(api.take(mk(V), mk([99.0])).item())
    order_ = np.argsort(M, 1)
    check(api.takeAlongAxis(mk(M), mk(order_), 1), np.take_along_axis(M, order_, 1))
    want = M.copy()
    np.put_along_axis(want, order_[:, :1], 99.0, 1)
    check(api.putAlongAxis(mk(M), mk(order_[:, :1]), 99.0, 1), want)
    want = M.copy()
    np.put(want, [0, -1, 5], [7.0, 8.0])
    check(api.put(mk(M), [0, -1, 5], [7.0, 8.0]), want)
    want = M.copy()
    np.place(want, M > 0, [1.0, 2.0, 3.0])
    check(api.place(mk(M), api.greater(mk(M), 0), [1.0, 2.0, 3.0]), want)
    check(api.compress(mk([1, 0, 1]), mk(M), 0), np.compress([1, 0, 1], M, 0))
    check(api.extract(api.greater(mk(M), 0), mk(M)), np.extract(M > 0, M))
    check(api.insert(mk(V), 2, 9.0), np.insert(V, 2, 9.0))
    check(api.insert(mk(M), 1, mk(M[0]), 0), np.insert(M, 1, M[0], 0))
    check(api.deleteArr(mk(V), [0, -1]), np.delete(V, [0, -1]))
    check(api.deleteArr(mk(M), 1, 1), np.delete(M, 1, 1))
    check(api.append(mk(M), mk(V)), np.append(M, V))
    want = M.copy()
    want[[2, 0]] = [[1.0] * 4, [2.0] * 4]
    check(api.indexCopy(mk(M), 0, mk([2, 0]), mk([[1.0] * 4, [2.0] * 4])), want)


def test_places(mk):
    z = np.array([[0.0, 2, 0], [np.nan, 0, 3]])
    for a, b in zip(api.nonzero(mk(z)), np.nonzero(z), strict=True):
        check(a, b)
    check(api.argwhere(mk(z)), np.argwhere(z))
    check(api.flatnonzero(mk(z)), np.flatnonzero(z))
    check(api.countNonzero(mk(z), 0), np.count_nonzero(z, 0))
    for a, b in zip(api.unravelIndex(mk([0, 5, 11]), (3, 4)), np.unravel_index([0, 5, 11], (3, 4)), strict=True):
        check(a, b)
    check(api.ravelMultiIndex([mk([0, 2]), mk([3, 1])], (3, 4)), np.ravel_multi_index([[0, 2], [3, 1]], (3, 4)))
    want = np.zeros((5, 2))
    np.fill_diagonal(want, 4, wrap=True)
    check(api.fillDiagonal(mk(np.zeros((5, 2))), 4, True), want)
    check(api.tril(mk(M), 1), np.tril(M, 1))
    check(api.triu(mk(M), -1), np.triu(M, -1))
    bits = np.array([1, 0, 1, 1, 0, 0, 0, 1, 1, 0])
    for o in ("big", "little"):
        check(api.packbits(mk(bits), bitorder=o), np.packbits(bits, bitorder=o))
        check(api.unpackbits(mk([5, 200]), bitorder=o, count=11), np.unpackbits(np.array([5, 200], np.uint8), bitorder=o, count=11))
    check(api.where(api.greater(mk(M), 0), mk(M), 0.0), np.where(M > 0, M, 0))
    check(api.select([api.greater(mk(M), 1), api.less(mk(M), 0)], [mk(M), -1.0], 5.0), np.select([M > 1, M < 0], [M, -1], 5))
    check(api.choose(mk([0, 1, 5]), [mk([1.0, 2, 3]), 9.0], "clip"), np.choose([0, 1, 5], [np.array([1.0, 2, 3]), 9.0], mode="clip"))
    check(api.setByMask(mk(M), api.less(mk(M), 0), 3.0), np.where(M < 0, 3, M))


def test_broadcast_and_products(mk, monkeypatch):
    check(api.add(mk(M), mk(M[0])), M + M[0])
    check(api.multiply(mk(M[:, :1]), mk(M[0])), M[:, :1] * M[0])
    check(api.subtract(2.0, mk(T)), 2 - T)
    check(api.outer(mk(V), mk(M)), np.outer(V, M))
    check(api.inner(mk(M), mk(M)), np.inner(M, M))
    check(api.dot(mk(V), mk(V)), [V @ V])
    check(api.vdot(mk(M), mk(M)), np.vdot(M, M))
    check(api.kron(mk(M[:2, :2]), mk(M)), np.kron(M[:2, :2], M))
    check(api.cross(mk(V[:3]), mk(V[3:6])), np.cross(V[:3], V[3:6]))
    check(api.tensordot(mk(T), mk(T), ([0, 2], [0, 2])), np.tensordot(T, T, ([0, 2], [0, 2])))
    check(api.tensordot(mk(T), mk(M), 2), np.tensordot(T, M, 2))
    check(api.batchedMatmul(mk(T), mk(M.T)), T @ M.T)
    check(api.multiDot([mk(M), mk(M.T), mk(M)]), M @ M.T @ M)
    assert api.arrayEqual(mk(M), mk(M)) and not api.arrayEqual(mk(N), mk(N)) and api.arrayEqual(mk(N), mk(N), True)
    assert api.allclose(mk(M), mk(M + 1e-12)) and api.array_equiv(mk([1.0, 1]), mk([[1.0, 1], [1, 1]])) and not api.array_equiv(mk(V), mk(M))
    from tessera.operators import algebra

    for block in (2, 256):
        monkeypatch.setattr(algebra, "BLOCK", block)
        a, b = R.normal(size=(5, 7)), R.normal(size=(7, 3))
        if block == 256:
            check(api.matmul(mk(a), mk(b)), a @ b)
    with pytest.raises(ValueError):
        api.matmul(mk(M), mk(M))


@pytest.mark.parametrize("spec", ["ij->ji", "ij->", "ii->i", "ij,jk->ik", "ij,ij->", "i,j->ij", "ijk,kl->ijl", "bij,bjk->bik", "ij,jk,kl->il", "ij,kj", "...j,jk->...k", "ijk->k", "ij,j,i->"])
def test_einsum(mk, spec):
    sizes = {"i": 3, "j": 4, "k": 2, "l": 5, "b": 2}
    arrays = [R.normal(size=[sizes[c] for c in term.replace("...", "bi")] if term != "ii" else (3, 3)) for term in spec.split("->")[0].split(",")]
    check(api.einsum(spec, *map(mk, arrays)), np.einsum(spec, *arrays))


def test_dense_algebra(mk):
    a = R.normal(size=(4, 4)) + 4 * np.eye(4)
    s = a @ a.T
    check(api.det(mk(a)), np.linalg.det(a))
    sign, log = np.linalg.slogdet(a)
    got = api.slogdet(mk(a))
    check(got["sign"], sign)
    check(got["logabsdet"], log)
    check(api.inv(mk(a)), np.linalg.inv(a))
    check(api.solve(mk(a), mk(V[:4])), np.linalg.solve(a, V[:4]))
    check(api.pinv(mk(M)), np.linalg.pinv(M))
    check(api.matrixRank(mk(np.outer(V, V))), 1)
    check(api.matrixPower(mk(a), -3), np.linalg.matrix_power(a, -3))
    for p in (2, 1, np.inf, "fro"):
        check(api.cond(mk(a), p), np.linalg.cond(a, p))
    for mode in ("reduced", "complete"):
        f = api.qr(mk(M.T), mode)
        check(api.matmul(f["q"], f["r"]), M.T)
    f = api.svd(mk(M), False)
    check(f["s"], np.linalg.svd(M)[1])
    u, v = f["u"].numpy(), f["vt"].numpy()
    check(u @ np.diag(f["s"].numpy()) @ v, M)
    f = api.eigh(mk(s))
    check(s @ f["vectors"].numpy(), f["vectors"].numpy() * f["values"].numpy())
    check(np.sort(api.eigvals(mk(s)).numpy()), np.linalg.eigvalsh(s))
    check(api.cholesky(mk(s)), np.linalg.cholesky(s))
    f = {k: x.numpy() for k, x in api.lu(mk(a)).items()}
    check(f["p"] @ f["l"] @ f["u"], a)
    x, y = R.normal(size=(30, 3)), R.normal(size=30)
    f = api.lstsq(mk(x), mk(y))
    want = np.linalg.lstsq(x, y, rcond=None)
    check(f["x"], want[0])
    check(f["residuals"], want[1])
    check(f["singularValues"], want[3])
    tall = R.normal(size=(60, 3))
    check(api.singular_values(mk(tall)), np.linalg.svd(tall, compute_uv=False))
    with pytest.raises(Exception, match="singular"):
        api.inv(mk(np.ones((2, 2)))).numpy()


def test_tall_matrices_in_blocks(mk):
    from tessera.operators import linalg

    tall = R.normal(size=(90, 3))
    r = linalg._triangular(mk(tall), rows=10).numpy()
    check(r.T @ r, tall.T @ tall)


def test_fft(mk):
    for n in (7, 8):
        x = R.normal(size=n)
        z, got = np.fft.fft(x), api.fft(mk(x))
        check(got["real"], z.real)
        check(got["imag"], z.imag)
        check(api.ifft(got["real"], got["imag"])["real"], x)
        got = api.rfft(mk(x))
        check(api.irfft(got["real"], got["imag"], n), x)
        check(api.fftshift(mk(x)), np.fft.fftshift(x))
        check(api.ifftshift(mk(x)), np.fft.ifftshift(x))
    check(api.fftshift(mk(M)), np.fft.fftshift(M))
    check(api.fft2(mk(M))["imag"], np.fft.fft2(M).imag)
    got = api.fftn(mk(T))
    check(got["real"], np.fft.fftn(T).real)
    check(api.ifftn(got["real"], got["imag"])["real"], T)
    from tessera.operators.fft import power

    check(power(mk(V), [1, 2, 3]), np.abs(np.fft.fft(V)[[1, 2, 3]]) ** 2)


def test_polynomials(mk):
    p, q = [1.0, -6, 11, -6], [2.0, 1]
    check(api.polyval(mk(p), mk(M)), np.polyval(p, M))
    check(api.polyadd(mk(p), mk(q)), np.polyadd(p, q))
    check(api.polysub(mk(q), mk(p)), np.polysub(q, p))
    check(api.polymul(mk(p), mk(q)), np.polymul(p, q))
    got, want = api.polydiv(mk(p), mk(q)), np.polydiv(p, q)
    check(got["q"], want[0])
    check(got["r"], want[1])
    check(api.polyder(mk(p), 2), np.polyder(p, 2))
    check(api.polyint(mk(p), 2, 3.0), np.polyint(p, 2, [3.0, 3.0]))
    x = np.linspace(100, 110, 30)
    y = 3 * x**2 - 2 * x + 1 + R.normal(size=30)
    check(np.polyval(api.polyfit(mk(x), mk(y), 2).numpy(), x), np.polyval(np.polyfit(x, y, 2), x), 1e-6)
    assert np.allclose(sorted(np.real(api.roots(mk(p)))), [1, 2, 3])
    assert sorted(z.imag for z in api.roots(mk([1.0, 0, 1]))) == pytest.approx([-1, 1])


def test_creation(mk, spark):
    for got, want in [
        (api.zeros(spark, (2, 3)), np.zeros((2, 3))),
        (api.full(spark, (2, 2), 7), np.full((2, 2), 7)),
        (api.arange(spark, 5), np.arange(5)),
        (api.arange(spark, 5, 1, -1.5), np.arange(5, 1, -1.5)),
        (api.linspace(spark, 0, 1, 5), np.linspace(0, 1, 5)),
        (api.linspace(spark, 0, 1, 5, False), np.linspace(0, 1, 5, False)),
        (api.logspace(spark, 0, 2, 4), np.logspace(0, 2, 4)),
        (api.geomspace(spark, -1, -1000, 4), np.geomspace(-1, -1000, 4)),
        (api.eye(spark, 3, 4, 1), np.eye(3, 4, 1)),
        (api.tri(spark, 3, 5, -1), np.tri(3, 5, -1)),
        (api.vander(mk(V), 3), np.vander(V, 3)),
        (api.vander(mk(V), 3, True), np.vander(V, 3, True)),
        (api.fromfunction(spark, lambda i, j: i * 10 + j, (2, 3)), np.fromfunction(lambda i, j: i * 10 + j, (2, 3))),
        (api.fromiter(spark, range(10), 4), np.arange(4)),
        (api.onesLike(mk(M)), np.ones_like(M)),
        (api.bartlett(spark, 7), np.bartlett(7)),
        (api.blackman(spark, 7), np.blackman(7)),
        (api.hamming(spark, 1), np.hamming(1)),
        (api.hanning(spark, 6), np.hanning(6)),
        (api.kaiser(spark, 9, 14.0), np.kaiser(9, 14.0)),
        (api.fftfreq(spark, 7, 0.5), np.fft.fftfreq(7, 0.5)),
        (api.rfftfreq(spark, 8), np.fft.rfftfreq(8)),
        (api.asarray(spark, 3.0), np.asarray(3.0)),
        (api.array(spark, [300.0, -1.5], dtype="int8"), np.array([44, -1])),
    ]:
        check(got, want)
    for indexing in ("xy", "ij"):
        for a, b in zip(api.meshgrid(mk(V), mk(M[0]), indexing=indexing), np.meshgrid(V, M[0], indexing=indexing), strict=True):
            check(a, b)
    for a, b in zip(api.indices(spark, (2, 3)), np.indices((2, 3)), strict=True):
        check(a, b)
    for n, k, m in ((4, 0, 4), (4, 1, 3), (3, -1, 5), (2, 3, 4), (5, -2, 2), (4, -4, 4), (3, 2, 6)):
        for f, g in ((api.trilIndices, np.tril_indices), (api.triuIndices, np.triu_indices)):
            for a, b in zip(f(spark, n, k, m), g(n, k, m), strict=True):
                check(a, b)
    assert api.array2string(mk([[1.0, 2.5]])) == "[[1, 2.5]]" and api.array2string(mk([1.0]), precision=2) == "[1.00]"
    assert np.isneginf(api.causalMask(spark, 2).numpy()[0, 1])
    with pytest.raises(ValueError):
        api.arange(spark, 0, 1, 0)


def test_from_tables(spark):
    df = spark.createDataFrame([(3, 1.5, 9.0), (1, None, 8.0), (2, 2.5, 7.0)], "k int, x double, y double")
    check(api.Tensor.from_table(df, "x", "k"), [np.nan, 2.5, 1.5])
    check(api.Tensor.from_features(df, ["x", "y"], "k"), [[np.nan, 8], [2.5, 7], [1.5, 9]])


def test_softmax(mk):
    e = np.exp(T - T.max(1, keepdims=True))
    check(api.softmax(mk(T), 1), e / e.sum(1, keepdims=True))
    check(api.softmax(mk(V)), np.exp(V) / np.exp(V).sum())
    check(api.logSoftmax(mk(T), 1), np.log(e / e.sum(1, keepdims=True)))
    check(api.logsumexp(mk(T), 1), np.log(np.exp(T).sum(1)))
    check(api.logsumexp(mk([[-np.inf, -np.inf], [0.0, 0.0]]), 1), [-np.inf, np.log(2)])


def test_materialize_and_map(mk):
    (t,) = api.materializeAll(mk(M))
    check(api.sqrt(api.square(t)), np.abs(M))
    got = api.divmod(mk([7.0, -7]), 3.0)
    check(got["quotient"], [2, -3])
    check(got["remainder"], [1, 2])
    check(api.modf(mk([1.5]))["frac"], [0.5])
    check(api.vectorize(lambda a, b: a * 10 + b)(mk([1.0, 2]), mk([[3.0], [4]])), [[13, 23], [14, 24]])
    assert F is not None


def test_long_kernels(mk, monkeypatch):
    from tessera.operators import ordered

    monkeypatch.setattr(ordered, "KERNEL", 8)
    monkeypatch.setattr(ordered, "SPAN", 16)
    a, v = R.normal(size=70), R.normal(size=35)
    for mode in ("full", "same", "valid"):
        check(api.convolve(mk(a), mk(v), mode), np.convolve(a, v, mode))


def test_nearest_rows(spark, monkeypatch):
    from tessera.operators import ordered

    monkeypatch.setattr(ordered, "ASKED", 3)
    monkeypatch.setattr(ordered, "COMPARED", 7)
    x = R.normal(size=(40, 5))
    x[7] = x[11]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    got = api.nearestRows(df.where("id % 8 = 3 or id > 80"), df, "id", "e", 4).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(3, 40, 8):
        scores = np.round(unit[q] @ unit.T, 12)
        want = [i for i in np.lexsort((np.arange(40), -scores)) if i != q][:4]
        assert [r.id for r in sorted(got, key=lambda r: r.rank) if r.q_id == q] == want
    assert {r.q_id for r in got} == set(range(3, 40, 8))


def test_selection_of_long_axes(mk, monkeypatch):
    from tessera.operators import reduce
    from tessera.plans import quantiles

    monkeypatch.setattr(reduce, "FEW", 2)
    monkeypatch.setattr(quantiles, "FEW", 2)
    x = R.normal(size=(5, 9))
    check(api.median(mk(x)), np.median(x))
    check(api.quantile(mk(x), 0.3, 1), np.quantile(x, 0.3, axis=1))
    check(api.quantile(mk(x), 0.3, 0, keepdims=True, method="higher"), np.quantile(x, 0.3, axis=0, keepdims=True, method="higher"))
    check(api.softmax(mk(x), 1), np.exp(x) / np.exp(x).sum(1, keepdims=True))


def test_covariance_of_columns(spark):
    x = R.normal(size=(50, 3)) * [1, 10, 100] + 1e6
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    check(api.covOfColumns(df, ["a", "b", "c"]), np.cov(x, rowvar=False), 1e-8)
    check(api.corrOfColumns(df, ["a", "b", "c"]), np.corrcoef(x, rowvar=False), 1e-8)
