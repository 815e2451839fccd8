"""Inference on tensors: convolution, pooling, normalisation, resizing. Images are (n, c, h, w)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..plans.tensor import Tensor, axis_of, elementwise
from .algebra import einsum
from .reduce import grouped
from .reduce import softmax as _softmax
from .shape import expandDims, squeeze
from .shape import pad as _pad


def _pair(x: int | Sequence[int]) -> tuple[int, int]:
    return (x, x) if isinstance(x, int) else (int(x[0]), int(x[1]))


def conv2d_output_size(h: int, w: int, kh: int, kw: int, stride=(1, 1), padding=(0, 0)) -> tuple[int, int]:
    (sh, sw), (ph, pw) = _pair(stride), _pair(padding)
    return (h + 2 * ph - kh) // sh + 1, (w + 2 * pw - kw) // sw + 1


def _images(t: Tensor) -> tuple[int, int, int, int]:
    if t.ndim != 4:
        raise ValueError("images have four dimensions: n, c, h, w")
    return t.shape


def _windows(t: Tensor, kernel: tuple[int, int], stride: tuple[int, int], padding: tuple[int, int]) -> tuple[DataFrame, int, int]:
    """(i0, i1, v, oh, ow, kh, kw): every pixel at each place of each window that covers it. Rows are multiplied where they are."""
    _, _, h, w = _images(t)
    oh, ow = conv2d_output_size(h, w, *kernel, stride, padding)
    places = []
    for a in range(kernel[0]):
        for b in range(kernel[1]):
            y, x = F.col("i2") + padding[0] - a, F.col("i3") + padding[1] - b
            inside = (y >= 0) & (x >= 0) & (y % stride[0] == 0) & (x % stride[1] == 0) & (y < oh * stride[0]) & (x < ow * stride[1])
            places.append(F.when(inside, F.struct((y / stride[0]).cast("long").alias("oh"), (x / stride[1]).cast("long").alias("ow"), F.lit(a).cast("long").alias("kh"), F.lit(b).cast("long").alias("kw"))))
    return t.df.select("i0", "i1", "v", F.inline(F.array_compact(F.array(*places)))), oh, ow


def _with_bias(out: Tensor, bias: Tensor | None) -> Tensor:
    if bias is None:
        return out
    return elementwise(ew.add, out, bias.vector().reindexed([F.lit(0), F.col("i0"), F.lit(0), F.lit(0)], (1, bias.size, 1, 1)))


#: Elements of weights that are sent with the query, of pictures that a task holds at a time, and of a picture that a task may hold.
WEIGHTS, HELD, PICTURE = 1 << 16, 1 << 18, 1 << 22


def _convolved(t: Tensor, w: np.ndarray, stride: tuple[int, int], padding: tuple[int, int], deep: bool) -> Tensor:
    """By products of windows with weights, whole pictures at a time: pixels are shuffled once, by picture, and nothing is repeated."""
    n, c, h, wide = t.shape
    kh, kw = w.shape[-2:]
    oh, ow = conv2d_output_size(h, wide, kh, kw, stride, padding)
    outputs, many = w.shape[0], max(1, HELD // max(1, c * h * wide))

    def run(rows: pa.Table) -> pa.Table:
        i0, *at = (rows.column(k).to_numpy() for k in ("i0", "i1", "i2", "i3"))
        pictures, place = np.unique(i0, return_inverse=True)
        x = np.zeros((len(pictures), c, h + 2 * padding[0], wide + 2 * padding[1]))
        x[place, at[0], at[1] + padding[0], at[2] + padding[1]] = rows.column("v").to_numpy()
        windows = np.lib.stride_tricks.sliding_window_view(x, (kh, kw), axis=(2, 3))[:, :, :: stride[0], :: stride[1]]
        y = np.einsum("nchwab,cab->nchw", windows, w) if deep else np.einsum("nchwab,ocab->nohw", windows, w, optimize=True)
        index = np.indices(y.shape).reshape(4, -1)
        columns = [pictures[index[0]], *index[1:], y.ravel()]
        return pa.table({k: pa.array(x) for k, x in zip(("i0", "i1", "i2", "i3", "v"), columns, strict=True)})

    blocks = t.df.withColumn("block", F.floor(F.col("i0") / many)).groupBy("block")
    return Tensor(blocks.applyInArrow(run, "i0 long, i1 long, i2 long, i3 long, v double"), (n, outputs, oh, ow))


def _small(t: Tensor, weight: Tensor) -> bool:
    return weight.size <= WEIGHTS and t.size // max(1, t.shape[0]) <= PICTURE


def conv2d(t: Tensor, weight: Tensor, bias: Tensor | None = None, stride=(1, 1), padding=(0, 0)) -> Tensor:
    """Cross-correlation with (out, in, kh, kw) weights and zeros around.

    Few weights are sent to tasks that hold whole pictures. Else pixels at their places in windows meet the weights by channel and
    place, and are added up by window.
    """
    n, c, _, _ = _images(t)
    oc, ic, kh, kw = weight.shape
    if ic != c:
        raise ValueError(f"{c} channels don't fit weights for {ic}")
    if _small(t, weight):
        return _with_bias(_convolved(t, weight.numpy(), _pair(stride), _pair(padding), False), bias)
    rows, oh, ow = _windows(t, (kh, kw), _pair(stride), _pair(padding))
    w = weight.df.select(F.col("i0").alias("oc"), F.col("i1"), F.col("i2").alias("kh"), F.col("i3").alias("kw"), F.col("v").alias("w"))
    sums = rows.join(w, ["i1", "kh", "kw"]).groupBy("i0", "oc", "oh", "ow").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    out = Tensor(sums.toDF("i0", "i1", "i2", "i3", "v"), (n, oc, oh, ow))
    return _with_bias(out.filled() if any(_pair(padding)) else out, bias)


def depthwiseConv2d(t: Tensor, weight: Tensor, bias: Tensor | None = None, stride=(1, 1), padding=(0, 0)) -> Tensor:
    """One (1, kh, kw) filter for each channel; as conv2d()."""
    n, c, _, _ = _images(t)
    if weight.shape[0] != c:
        raise ValueError("as many filters as channels are needed")
    kh, kw = weight.shape[-2:]
    if _small(t, weight):
        return _with_bias(_convolved(t, weight.numpy().reshape(c, kh, kw), _pair(stride), _pair(padding), True), bias)
    rows, oh, ow = _windows(t, (kh, kw), _pair(stride), _pair(padding))
    w = weight.df.select(F.col("i0").alias("i1"), F.col(f"i{weight.ndim - 2}").alias("kh"), F.col(f"i{weight.ndim - 1}").alias("kw"), F.col("v").alias("w"))
    sums = rows.join(w, ["i1", "kh", "kw"]).groupBy("i0", "i1", "oh", "ow").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    out = Tensor(sums.toDF("i0", "i1", "i2", "i3", "v"), (n, c, oh, ow))
    return _with_bias(out.filled() if any(_pair(padding)) else out, bias)


def conv_transpose_2d(t: Tensor, weight: Tensor, stride=(1, 1), padding=(0, 0), output_padding=(0, 0)) -> Tensor:
    """The transposed operation, with (in, out, kh, kw) weights: every pixel adds its multiple of the kernel to the output."""
    n, c, h, w = _images(t)
    _, oc, kh, kw = weight.shape
    (sh, sw), (ph, pw), (qh, qw) = _pair(stride), _pair(padding), _pair(output_padding)
    oh, ow = (h - 1) * sh - 2 * ph + kh + qh, (w - 1) * sw - 2 * pw + kw + qw
    k = weight.df.select(F.col("i0").alias("i1"), F.col("i1").alias("oc"), F.col("i2").alias("kh"), F.col("i3").alias("kw"), F.col("v").alias("w"))
    placed = t.df.join(k, "i1").select("i0", "oc", (F.col("i2") * sh - ph + F.col("kh")).alias("oh"), (F.col("i3") * sw - pw + F.col("kw")).alias("ow"), (F.col("v") * F.col("w")).alias("v"))
    placed = placed.where((F.col("oh") >= 0) & (F.col("oh") < oh) & (F.col("ow") >= 0) & (F.col("ow") < ow))
    return Tensor(placed.groupBy("i0", "oc", "oh", "ow").agg(F.sum("v").alias("v")).toDF("i0", "i1", "i2", "i3", "v"), (n, oc, oh, ow)).filled()


def im2col(t: Tensor, kernel, stride=(1, 1), padding=(0, 0)) -> Tensor:
    """Windows as rows, (n * oh * ow, c * kh * kw), zeros where they pass the edge."""
    n, c, _, _ = _images(t)
    kh, kw = _pair(kernel)
    rows, oh, ow = _windows(t, (kh, kw), _pair(stride), _pair(padding))
    row = F.col("i0") * (oh * ow) + F.col("oh") * ow + F.col("ow")
    col = F.col("i1") * (kh * kw) + F.col("kh") * kw + F.col("kw")
    return Tensor(rows.select(row.alias("a"), col.alias("b"), "v").toDF("i0", "i1", "v"), (n * oh * ow, c * kh * kw)).filled()


def _pool(f: Callable[[], Column]) -> Callable[..., Tensor]:
    def pool(t: Tensor, kernel, stride=None, padding=(0, 0)) -> Tensor:
        n, c, _, _ = _images(t)
        rows, oh, ow = _windows(t, _pair(kernel), _pair(kernel if stride is None else stride), _pair(padding))
        out = Tensor(rows.groupBy("i0", "i1", "oh", "ow").agg(f().alias("v")).toDF("i0", "i1", "i2", "i3", "v"), (n, c, oh, ow))
        return out.filled() if any(_pair(padding)) else out

    pool.__doc__ = "Over windows, which move by their own size unless ``stride`` is given; what is padded doesn't count, a window without pixels gives 0."
    return pool


maxPool2d = max_pool_2d = _pool(lambda: F.max("v"))
avgPool2d = avg_pool_2d = _pool(lambda: F.avg("v"))


def globalAvgPool2d(t: Tensor) -> Tensor:
    n, c, _, _ = _images(t)
    df = t.df.groupBy("i0", "i1").agg(F.avg("v").alias("v"))
    return Tensor(df.select("i0", "i1", F.lit(0).cast("long").alias("i2"), F.lit(0).cast("long").alias("i3"), "v"), (n, c, 1, 1))


def batchNorm(t: Tensor, gamma: Tensor | None, beta: Tensor | None, mean: Tensor, var: Tensor, eps: float = 1e-5) -> Tensor:
    """(x - mean) / sqrt(var + eps) * gamma + beta, by channel (axis 1)."""
    table = mean.df.withColumnRenamed("v", "m").join(var.df.withColumnRenamed("v", "s"), "i0")
    for name, x in (("g", gamma), ("b", beta)):
        table = table.join(x.df.withColumnRenamed("v", name), "i0") if x is not None else table.withColumn(name, F.lit(1.0 if name == "g" else 0.0))
    df = t.df.join(table.withColumnRenamed("i0", "i1"), "i1")
    return Tensor(df.select(*t.index, ((F.col("v") - F.col("m")) / F.sqrt(F.col("s") + eps) * F.col("g") + F.col("b")).alias("v")), t.shape)


batch_norm = batchNorm


def _scaled(df: DataFrame, t: Tensor, last: int, gamma: Tensor | None, beta: Tensor | None) -> DataFrame:
    keys = t.index[t.ndim - last :]
    for name, x in (("g", gamma), ("b", beta)):
        if x is None:
            df = df.withColumn(name, F.lit(1.0 if name == "g" else 0.0))
        else:
            df = df.join(x.df.select(*[F.col(c).alias(k) for c, k in zip(x.index, keys, strict=True)], F.col("v").alias(name)), keys)
    return df


def _with_stats(t: Tensor, last: int, stats: dict[str, Column]) -> DataFrame:
    """Elements with aggregates over the last axes: by a window where those are short, else joined."""
    here = grouped(t, list(range(t.ndim - last, t.ndim)))
    if here is not None:
        return t.df.withColumns({k: e.over(here) for k, e in stats.items()})
    by = t.index[: t.ndim - last]
    groups = t.df.groupBy(*by).agg(*[e.alias(k) for k, e in stats.items()])
    return t.df.join(groups, by) if by else t.df.crossJoin(F.broadcast(groups))


def layer_norm(t: Tensor, normalized_shape: Sequence[int], gamma: Tensor | None = None, beta: Tensor | None = None, eps: float = 1e-5) -> Tensor:
    """To mean 0 and variance 1 over the last axes, then scaled and moved."""
    last = len(normalized_shape)
    if tuple(t.shape[t.ndim - last :]) != tuple(normalized_shape):
        raise ValueError("the last axes differ from the normalised shape")
    both = _with_stats(t, last, {"m": F.avg("v"), "s": F.var_pop("v")})
    df = _scaled(both, t, last, gamma, beta)
    return Tensor(df.select(*t.index, ((F.col("v") - F.col("m")) / F.sqrt(F.col("s") + eps) * F.col("g") + F.col("b")).alias("v")), t.shape)


def rms_norm(t: Tensor, gamma: Tensor | None = None, eps: float = 1e-5) -> Tensor:
    """x / sqrt(mean of squares over the last axis + eps), scaled."""
    both = _with_stats(t, 1, {"s": F.avg(F.col("v") * F.col("v"))})
    df = _scaled(both, t, 1, gamma, None)
    return Tensor(df.select(*t.index, (F.col("v") / F.sqrt(F.col("s") + eps) * F.col("g")).alias("v")), t.shape)


def softmax(t: Tensor, dim: int = -1) -> Tensor:
    """Along any axis."""
    return _softmax(t, dim)


def _unary(f: Callable[..., Column]) -> Callable[..., Tensor]:
    return lambda t, *a, **k: t.map(lambda v: f(v, *a, **k))


relu, relu6, leakyRelu, gelu, sigmoid, silu, rsqrt = map(_unary, (ew.relu, ew.relu6, ew.leakyRelu, ew.gelu, ew.sigmoid, ew.silu, ew.rsqrt))
dequantize_linear = _unary(ew.dequantizeLinear)


def mulScalar(t: Tensor, s: float) -> Tensor:
    return t.map(lambda v: v * float(s))


def prelu(t: Tensor, weight: Tensor) -> Tensor:
    """Below 0 times the weight of the channel (axis 1); one weight is for all."""
    if weight.size == 1:
        return elementwise(lambda x, w: F.when(x > 0, x).otherwise(x * w), t, weight.vector())
    axis = 1 if t.ndim > 1 else 0
    by_channel = weight.vector().reindexed([F.col("i0") if k == axis else F.lit(0) for k in range(t.ndim)], [weight.size if k == axis else 1 for k in range(t.ndim)])
    return elementwise(lambda x, w: F.when((x > 0) & ~F.isnan(x), x).otherwise(x * w), t, by_channel)


def add(a: Tensor, b: Tensor) -> Tensor:
    if a.shape != b.shape:
        raise ValueError("shapes differ")
    return elementwise(ew.add, a, b)


def addRelu(a: Tensor, b: Tensor) -> Tensor:
    return elementwise(ew.addRelu, a, b)


def _resampled(t: Tensor, axis: int, size: int) -> Tensor:
    """Linear interpolation along an axis at half-pixel centres, clamped: two places and weights for each new one."""
    axis, n = axis_of(axis, t.ndim), t.shape[axis_of(axis, t.ndim)]
    at = F.greatest(F.lit(0.0), (F.col("id") + 0.5) * (n / size) - 0.5)
    low = F.least(F.floor(at), F.lit(n - 1))
    part = F.when(low >= n - 1, 0.0).otherwise(at - low)
    table = t.spark.range(size).select(F.col("id").alias("to"), F.inline(F.array(F.struct(low.cast("long").alias("from"), (1 - part).alias("w")), F.struct(F.least(low + 1, F.lit(n - 1)).cast("long").alias("from"), part.alias("w")))))
    df = t.df.join(table, t.df[f"i{axis}"] == table["from"]).groupBy(*t.others(axis), "to").agg(F.sum(F.when(F.col("w") != 0, F.col("v") * F.col("w")).otherwise(0.0)).alias("v"))
    return Tensor(df.withColumnRenamed("to", f"i{axis}").select(*t.index, "v"), [size if k == axis else m for k, m in enumerate(t.shape)])


def resizeBilinear(t: Tensor, size) -> Tensor:
    """The last two axes to a new size; what is interpolated along one axis is interpolated along the other."""
    h, w = _pair(size)
    return _resampled(_resampled(t, -2, h), -1, w)


interpolate = resize = resizeBilinear


def upsampleBilinear(t: Tensor, scale: float) -> Tensor:
    return resizeBilinear(t, (int(t.shape[-2] * scale), int(t.shape[-1] * scale)))


def pad(t: Tensor, padding: Sequence[int], mode: str = "constant", value: float = 0.0) -> Tensor:
    """Last axis first: (left, right, top, bottom, ...). Mode `replicate` is edge, `circular` is wrap."""
    widths = [(0, 0)] * t.ndim
    for k in range(len(padding) // 2):
        widths[t.ndim - 1 - k] = (padding[2 * k], padding[2 * k + 1])
    return _pad(t, widths, {"replicate": "edge", "circular": "wrap"}.get(mode, mode), value)


ACTIVATIONS = {"none": lambda t: t, "relu": relu, "relu6": relu6}


def conv2dFused(t, weight, bias=None, stride=(1, 1), padding=(0, 0), activation: str = "none") -> Tensor:
    return ACTIVATIONS[activation](conv2d(t, weight, bias, stride, padding))


def depthwiseConv2dFused(t, weight, bias=None, stride=(1, 1), padding=(0, 0), activation: str = "none") -> Tensor:
    return ACTIVATIONS[activation](depthwiseConv2d(t, weight, bias, stride, padding))


def conv2d1x1SkipRelu(t: Tensor, weight: Tensor, bias: Tensor | None = None, skip: Tensor | None = None) -> Tensor:
    """A convolution of single pixels is a product over channels."""
    w = weight if weight.ndim == 2 else squeeze(weight, (2, 3))
    out = _with_bias(einsum("nchw,oc->nohw", t, w), bias)
    return addRelu(out, skip) if skip is not None else relu(out)


def depthwisePointwiseSkipRelu(t, dw_weight, dw_bias, pw_weight, pw_bias, skip: Tensor | None = None, padding=(0, 0)) -> Tensor:
    return conv2d1x1SkipRelu(depthwiseConv2d(t, dw_weight, dw_bias, (1, 1), padding), pw_weight, pw_bias, skip)


def multinomial(t: Tensor, num_samples: int, replacement: bool, seed: int | None = None) -> Tensor:
    """Places drawn by the weights in a vector, or in each row of a matrix: least exponential keys, one key a place and draw."""
    from ..sources import random as rnd

    s = rnd._next(seed)
    rows = t if t.ndim == 2 else expandDims(t, 0)
    if not replacement and num_samples > rows.shape[1]:
        raise ValueError("more draws than places")
    key = lambda p: F.when(F.col("v") > 0, -F.ln(rnd.unit(p, s)) / F.when(F.col("v") > 0, F.col("v")).otherwise(1.0)).otherwise(ew.INF)
    if replacement:
        each = rows.df.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(num_samples - 1).cast("long"))))
        place = (F.col("i0") * rows.shape[1] + F.col("i1")) * num_samples + F.col("draw")
        out = each.groupBy("i0", "draw").agg(F.min_by("i1", key(place)).alias("v")).select("i0", F.col("draw").alias("i1"), F.col("v").cast("double").alias("v"))
        result = Tensor(out, (rows.shape[0], num_samples))
    else:
        from .ordered import topk

        keyed = Tensor(rows.df.select("i0", "i1", (-key(F.col("i0") * rows.shape[1] + F.col("i1"))).alias("v")), rows.shape)
        result = topk(keyed, num_samples, 1)[1]
    return result if t.ndim == 2 else squeeze(result, 0)

