"""Small feed-forward networks: full-batch gradients over the different rows, each with its number, summed over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import elementwise as ew
from ...plans.stage import cut
from .base import Estimator
from .metrics import accuracyScore, r2Score

ACTIVATE = {"identity": lambda z: z, "relu": lambda z: np.maximum(z, 0), "tanh": np.tanh, "logistic": lambda z: 1 / (1 + np.exp(-z))}
SLOPE = {"identity": lambda a: np.ones_like(a), "relu": lambda a: (a > 0).astype(float), "tanh": lambda a: 1 - a * a, "logistic": lambda a: a * (1 - a)}


#: Different rows up to which gradients are computed where the weights are; more stay with the executors.
FEW = 1 << 16


class _Mlp(Estimator):
    defaults = {"hiddenLayerSizes": (100,), "activation": "relu", "solver": "adam", "alpha": 1e-4, "batchSize": None, "learningRate": "constant", "learningRateInit": 0.001, "maxIter": 200, "tol": 1e-4, "momentum": 0.9, "earlyStopping": False, "nIterNoChange": 10, "shuffle": True, "randomState": 0, "validationFraction": 0.1, "verbose": False}

    def _fit(self, df: DataFrame, features: list[str], y, outputs: int):
        """Adam or gradient descent on the mean loss plus alpha / 2 |W|^2; every step one pass, of which a gradient a partition comes back."""
        self.features_ = list(features)
        rows = cut(df.select(F.array(*[ew.num(c) for c in features]).alias("x"), y.alias("y")).groupBy("x", "y").agg(F.count("*").alias("n")))
        different, n = rows.agg(F.count("*"), F.sum("n")).first()
        if not n:
            raise ValueError("no rows to fit")
        few = rows.orderBy("x", "y").toPandas() if different * len(features) <= FEW else None
        rng, sizes = np.random.default_rng(self.randomState), [len(features), *self.hiddenLayerSizes, outputs]
        bound = lambda a, b: np.sqrt((2.0 if self.activation == "logistic" else 6.0) / (a + b))
        self.weights_ = [(rng.uniform(-1, 1, (a, b)) * bound(a, b), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        shapes = [w.shape for layer in self.weights_ for w in layer]
        vector = np.concatenate([w.ravel() for layer in self.weights_ for w in layer])
        decayed = np.concatenate([np.full(w.size, float(w.ndim == 2)) for layer in self.weights_ for w in layer])
        first, second, best, stale, self.lossCurve_ = np.zeros_like(vector), np.zeros_like(vector), np.inf, 0, []
        for step in range(1, self.maxIter + 1):
            self._set(vector, shapes)
            loss, grad = self._pass(rows) if few is None else self._gradient(few)
            loss, grad = loss / n + self.alpha / 2 * float(((vector * decayed) ** 2).sum()), grad / n + self.alpha * vector * decayed
            self.lossCurve_.append(loss)
            stale = 0 if loss < best - self.tol else stale + 1
            best = min(best, loss)
            self.nIter_, self.loss_ = step, loss
            if stale >= self.nIterNoChange:
                break
            if self.solver == "adam":
                first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
                vector = vector - self.learningRateInit * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            else:
                first = self.momentum * first - self.learningRateInit * grad
                vector = vector + first
        self._set(vector, shapes)
        return self

    def _set(self, vector: np.ndarray, shapes: list) -> None:
        parts, at = [], 0
        for s in shapes:
            parts.append(vector[at : at + int(np.prod(s))].reshape(s))
            at += int(np.prod(s))
        self.weights_ = list(zip(parts[::2], parts[1::2], strict=True))

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        layers = [x]
        for k, (w, b) in enumerate(self.weights_):
            z = layers[-1] @ w + b
            layers.append(ACTIVATE[self.params["activation"]](z) if k < len(self.weights_) - 1 else self._output(z))
        return layers

    def _gradient(self, b: pd.DataFrame) -> tuple[float, np.ndarray]:
        x, y = np.stack(b["x"].to_list()), b["y"].to_numpy()
        n = b["n"].to_numpy(np.float64) if "n" in b else np.ones(len(y))
        layers = self._forward(x)
        losses, delta = self._loss(layers[-1], y)
        delta = delta * n[:, None]
        parts = []
        for k in range(len(self.weights_) - 1, -1, -1):
            parts = [(layers[k].T @ delta).ravel(), delta.sum(axis=0), *parts]
            if k:
                delta = (delta @ self.weights_[k][0].T) * SLOPE[self.params["activation"]](layers[k])
        return float((losses * n).sum()), np.concatenate(parts)

    def _pass(self, rows: DataFrame) -> tuple[float, np.ndarray]:
        me = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, grad = 0.0, None
            for b in batches:
                loss, g = me._gradient(b)
                total, grad = total + loss, g if grad is None else grad + g
            if grad is not None:
                yield pd.DataFrame({"loss": [total], "g": [grad]})

        sums = rows.mapInPandas(run, "loss double, g array<double>").collect()
        return sum(r.loss for r in sums), np.sum([r.g for r in sums], axis=0)

    def _outputs(self, df: DataFrame, to: str) -> DataFrame:
        me = self

        @F.arrow_udf("array<double>")
        def run(*x: pa.Array) -> pa.Array:
            # Arrow may hand over NaN as null.
            out = me._forward(np.column_stack([v.to_numpy(zero_copy_only=False).astype(np.float64) for v in x]))[-1]
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32()), pa.array(out.ravel()))

        return df.withColumn(to, run(*[ew.num(c) for c in self.features_]))


class MLPClassifier(_Mlp):
    """Softmax over the classes in ascending order, log loss."""

    def fit(self, df: DataFrame, features: list[str], target: str) -> MLPClassifier:
        self.target_ = target
        self.classes_ = sorted(r[0] for r in df.select(ew.num(target)).distinct().limit(1001).collect())
        if len(self.classes_) > 1000:
            raise ValueError("at most 1000 classes are possible")
        place = F.array_position(F.array(*[F.lit(float(c)) for c in self.classes_]), ew.num(target)).cast("double") - 1
        return self._fit(df, features, place, max(1, len(self.classes_)))

    @staticmethod
    def _output(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    @staticmethod
    def _loss(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hot = np.eye(p.shape[1])[y.astype(int)]
        return -np.log(np.maximum(1e-15, p[np.arange(len(y)), y.astype(int)])), p - hot

    def predictProba(self, df: DataFrame, to: str = "probability") -> DataFrame:
        return self._outputs(df, to)

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        classes = F.array(*[F.lit(float(c)) for c in self.classes_])
        return self._outputs(df, "__p").withColumn(to, F.get(classes, (F.array_position("__p", F.array_max("__p")) - 1).cast("int"))).drop("__p")

    def score(self, df: DataFrame) -> float:
        return self.predict(df, "__score").agg(accuracyScore(self.target_, "__score").alias("s")).first().s


class MLPRegressor(_Mlp):
    """One linear output, half the squared error."""

    def fit(self, df: DataFrame, features: list[str], target: str) -> MLPRegressor:
        self.target_ = target
        return self._fit(df, features, ew.num(target), 1)

    @staticmethod
    def _output(z: np.ndarray) -> np.ndarray:
        return z

    @staticmethod
    def _loss(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = p - y[:, None]
        return (d * d).sum(axis=1) / 2, d

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        return self._outputs(df, "__p").withColumn(to, F.get("__p", 0)).drop("__p")

    def score(self, df: DataFrame) -> float:
        return self.predict(df, "__score").agg(r2Score(self.target_, "__score").alias("s")).first().s
