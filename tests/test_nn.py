"""Tensor inference against direct loops."""

import numpy as np
import pytest

from tessera import api
from tessera.operators import nn

R = np.random.default_rng(1)
X = R.normal(size=(2, 3, 5, 6))
W = R.normal(size=(4, 3, 3, 2))
B = R.normal(size=4)


def conv(x, w, b, stride, pad):
    x = np.pad(x, ((0, 0), (0, 0), (pad[0],) * 2, (pad[1],) * 2))
    oh, ow = ((x.shape[2 + k] - w.shape[2 + k]) // stride[k] + 1 for k in (0, 1))
    out = np.zeros((len(x), len(w), oh, ow))
    for i in range(oh):
        for j in range(ow):
            part = x[:, :, i * stride[0] : i * stride[0] + w.shape[2], j * stride[1] : j * stride[1] + w.shape[3]]
            out[:, :, i, j] = np.einsum("nchw,ochw->no", part, w) + b
    return out


@pytest.fixture(scope="module")
def mk(spark):
    return lambda a: api.array(spark, a)


def check(got, want):
    assert got.shape == np.shape(want)
    np.testing.assert_allclose(got.numpy(), want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize(("stride", "pad"), [((1, 1), (0, 0)), ((2, 1), (1, 0)), ((3, 3), (2, 2))])
def test_convolutions(mk, stride, pad):
    check(nn.conv2d(mk(X), mk(W), mk(B), stride, pad), conv(X, W, B, stride, pad))
    d = W[:3, :1]
    want = np.concatenate([conv(X[:, c : c + 1], d[c : c + 1], 0, stride, pad) for c in range(3)], 1)
    check(nn.depthwiseConv2d(mk(X), mk(d), None, stride, pad), want)
    assert nn.conv2d_output_size(5, 6, 3, 2, stride, pad) == want.shape[2:]


def test_fused(mk):
    check(nn.conv2dFused(mk(X), mk(W), mk(B), activation="relu"), np.maximum(conv(X, W, B, (1, 1), (0, 0)), 0))
    p = W[:, :, :1, :1]
    check(nn.conv2d1x1SkipRelu(mk(X), mk(p), mk(B)), np.maximum(conv(X, p, B, (1, 1), (0, 0)), 0))
    d = W[:3, :1, :, :]
    mid = np.concatenate([conv(X[:, c : c + 1], d[c : c + 1], 0, (1, 1), (0, 0)) for c in range(3)], 1)
    skip = R.normal(size=(2, 4, 3, 5))
    check(nn.depthwisePointwiseSkipRelu(mk(X), mk(d), None, mk(p), mk(B), mk(skip)), np.maximum(conv(mid, p, B, (1, 1), (0, 0)) + skip, 0))


def test_transposed(mk):
    w = R.normal(size=(3, 2, 3, 3))
    got = nn.conv_transpose_2d(mk(X), mk(w), (2, 2), (1, 1), (1, 1))
    out = np.zeros((2, 2, 5 * 2 + 3, 6 * 2 + 3))
    for i in range(5):
        for j in range(6):
            out[:, :, 2 * i : 2 * i + 3, 2 * j : 2 * j + 3] += np.einsum("nc,cohw->nohw", X[:, :, i, j], w)
    check(got, out[:, :, 1 : 1 + got.shape[2], 1 : 1 + got.shape[3]])


def test_pools(mk):
    def pooled(f, k, s, p):
        x = np.pad(X, ((0, 0), (0, 0), (p, p), (p, p)), constant_values=np.nan)
        oh, ow = (x.shape[2] - k) // s + 1, (x.shape[3] - k) // s + 1
        return np.array([[[[f(x[n, c, i * s : i * s + k, j * s : j * s + k]) for j in range(ow)] for i in range(oh)] for c in range(3)] for n in range(2)])

    check(nn.maxPool2d(mk(X), 2), pooled(np.nanmax, 2, 2, 0))
    check(nn.avgPool2d(mk(X), 3, 2, 1), pooled(np.nanmean, 3, 2, 1))
    check(nn.globalAvgPool2d(mk(X)), X.mean((2, 3), keepdims=True))
    check(nn.im2col(mk(X), (2, 2), (1, 1)), np.array([X[n, :, i : i + 2, j : j + 2].ravel() for n in range(2) for i in range(4) for j in range(5)]))


def test_norms(mk):
    g, b, m, v = R.normal(size=3), R.normal(size=3), R.normal(size=3), R.uniform(1, 2, 3)
    s = (1, 3, 1, 1)
    check(nn.batchNorm(mk(X), mk(g), mk(b), mk(m), mk(v)), (X - m.reshape(s)) / np.sqrt(v.reshape(s) + 1e-5) * g.reshape(s) + b.reshape(s))
    w = R.normal(size=(5, 6))
    check(nn.layer_norm(mk(X), (5, 6), mk(w)), (X - X.mean((2, 3), keepdims=True)) / np.sqrt(X.var((2, 3), keepdims=True) + 1e-5) * w)
    check(nn.rms_norm(mk(X), mk(w[0])), X / np.sqrt((X**2).mean(-1, keepdims=True) + 1e-5) * w[0])


def test_resizing(mk):
    def axis(n, size):
        at = np.maximum(0, (np.arange(size) + 0.5) * n / size - 0.5)
        low = np.minimum(np.floor(at).astype(int), n - 1)
        part = np.where(low >= n - 1, 0, at - low)
        m = np.zeros((size, n))
        m[np.arange(size), low] += 1 - part
        m[np.arange(size), np.minimum(low + 1, n - 1)] += part
        return m

    want = np.einsum("oh,nchw,pw->ncop", axis(5, 8), X, axis(6, 3))
    check(nn.resizeBilinear(mk(X), (8, 3)), want)
    assert nn.upsampleBilinear(mk(X), 1.5).shape == (2, 3, 7, 9)


def test_the_rest(mk):
    check(nn.pad(mk(X), (1, 2, 0, 1), value=9.0), np.pad(X, ((0, 0), (0, 0), (0, 1), (1, 2)), constant_values=9))
    w = np.array([0.1, 0.2, 0.3])
    check(nn.prelu(mk(X), mk(w)), np.where(X > 0, X, X * w.reshape(1, 3, 1, 1)))
    check(nn.addRelu(mk(X), mk(-X / 2)), np.maximum(X / 2, 0))
    check(nn.mulScalar(nn.relu6(mk(X * 9)), 2), 2 * np.clip(X * 9, 0, 6))
    check(nn.dequantize_linear(mk(B), 0.5, 3.0), (B - 3) * 0.5)
    e = np.exp(X)
    check(nn.softmax(mk(X), 1), e / e.sum(1, keepdims=True))
