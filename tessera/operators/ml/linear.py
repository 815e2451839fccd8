"""Linear and logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import elementwise as ew
from ...plans.stage import cut, discard
from .base import Estimator
from .metrics import accuracyScore, r2Score


def _weighted(features: list[str], coef, intercept: float) -> Column:
    out = F.lit(float(intercept))
    for c, w in zip(features, coef, strict=True):
        out = out + ew.num(c) * float(w)
    return out


class LinearRegression(Estimator):
    """Ordinary least squares: sums of products about the means, in two passes, and a small system on the driver."""

    defaults = {"fitIntercept": True, "copyX": True, "nJobs": None, "positive": False}

    def fit(self, df: DataFrame, features: list[str], target: str) -> LinearRegression:
        f, columns = len(features), [*features, target]
        means = [0.0] * (f + 1)
        if self.fitIntercept:
            row = df.agg(*[F.avg(ew.num(c)).alias(f"m{j}") for j, c in enumerate(columns)]).first()
            if row.m0 is None:
                raise ValueError("no rows to fit")
            means = [row[f"m{j}"] for j in range(f + 1)]
        x = [ew.num(c) - m for c, m in zip(columns, means, strict=True)]
        pairs = [(i, j) for i in range(f) for j in range(i, f + 1)]
        row = df.agg(*[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
        g = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(f)] for i in range(f)])
        scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
        right = np.array([row[f"s{i}_{f}"] for i in range(f)])
        coef = np.linalg.lstsq(g / np.outer(scale, scale), right / scale, rcond=1e-13)[0] / scale
        self.features_, self.target_, self.coef_ = list(features), target, coef.tolist()
        self.intercept_ = float(means[f] - np.dot(coef, means[:f])) if self.fitIntercept else 0.0
        return self

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        return df.withColumn(to, _weighted(self.features_, self.coef_, self.intercept_))

    def score(self, df: DataFrame) -> float:
        return self.predict(df, "__score").agg(r2Score(self.target_, "__score").alias("s")).first().s


class LogisticRegression(Estimator):
    """Mean log loss plus |w|^2 / (2 C), minimised by Newton's method: every step is one aggregation of gradient and curvature
    over the different rows, each with its number.

    More than two classes are separated one against the rest; their probabilities are the softmax of the scores. Labels are any
    numbers; of two the greater is the positive one.
    """

    defaults = {"C": 1.0, "fitIntercept": True, "maxIter": 100, "tol": 1e-4, "penalty": "l2", "solver": "newton", "multiClass": "ovr", "classWeight": None, "randomState": None}

    def fit(self, df: DataFrame, features: list[str], target: str) -> LogisticRegression:
        self.features_, self.target_ = list(features), target
        self.classes_ = sorted(r[0] for r in df.select(ew.num(target)).distinct().limit(1001).collect())
        if not self.classes_ or len(self.classes_) > 1000:
            raise ValueError("between 1 and 1000 classes are needed")
        positive = self.classes_[1:] if len(self.classes_) == 2 else self.classes_
        rows = cut(df.select(*[ew.num(c).alias(f"x{i}") for i, c in enumerate(features)], ew.num(target).alias("y")).groupBy(*[f"x{i}" for i in range(len(features))], "y").agg(F.count("*").alias("n")))
        total = rows.agg(F.sum("n")).first()[0]
        self.weights_ = [self._binary(rows, total, c) for c in positive]
        discard(rows)
        self.coef_, self.intercept_ = [w[:-1] for w in self.weights_], [w[-1] for w in self.weights_]
        return self

    def _binary(self, given: DataFrame, total: int, positive: float) -> list[float]:
        f, decay = len(self.features_), 0.0 if self.penalty in (None, "none") else 1.0 / self.C
        x = [F.col(f"x{i}") for i in range(f)] + [F.lit(1.0)]
        y = F.when(F.col("y") == positive, 1.0).otherwise(0.0)
        mean = lambda v: F.sum(v * F.col("n")) / float(total)
        live = range(f + 1) if self.fitIntercept else range(f)
        w = np.zeros(f + 1)
        for _ in range(self.maxIter):
            p = ew.sigmoid(_weighted([f"x{i}" for i in range(f)], w[:f], w[f]))
            rows = given.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], p.alias("p"), y.alias("y"), "n")
            curve = F.col("p") * (1 - F.col("p"))
            sums = rows.agg(*[mean((F.col("p") - F.col("y")) * F.col(f"x{i}")).alias(f"g{i}") for i in live], *[mean(curve * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in live for j in live if i <= j]).first()
            g = np.array([sums[f"g{i}"] + (decay * w[i] if i < f else 0.0) for i in live])
            h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in live] for i in live]) + np.diag([decay if i < f else 0.0 for i in live])
            step = np.linalg.lstsq(h + 1e-12 * np.eye(len(g)), g, rcond=None)[0]
            step *= min(1.0, 10.0 / max(1e-300, np.abs(step).max()))
            w[list(live)] -= step
            if np.abs(step).max() < self.tol * 1e-2:
                break
        return w.tolist()

    def predictProba(self, df: DataFrame, to: str = "probability") -> DataFrame:
        """An array in the order of classes_."""
        scores = [_weighted(self.features_, w[:-1], w[-1]) for w in self.weights_]
        if len(self.classes_) == 2:
            p = ew.sigmoid(scores[0])
            return df.withColumn(to, F.array(1 - p, p))
        raised = F.transform(F.array(*scores), lambda s: F.exp(s - F.array_max(F.array(*scores))))
        return df.withColumn(to, raised).withColumn(to, F.transform(to, lambda e: e / F.aggregate(to, F.lit(0.0), lambda a, b: a + b)))

    def predictLogProba(self, df: DataFrame, to: str = "logProbability") -> DataFrame:
        return self.predictProba(df, to).withColumn(to, F.transform(to, lambda p: F.ln(F.greatest(p, F.lit(1e-15)))))

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        classes = F.array(*[F.lit(float(c)) for c in self.classes_])
        best = F.array_position(F.col("__p"), F.array_max("__p")) - 1
        return self.predictProba(df, "__p").withColumn(to, F.get(classes, best.cast("int"))).drop("__p")

    def score(self, df: DataFrame) -> float:
        return self.predict(df, "__score").agg(accuracyScore(self.target_, "__score").alias("s")).first().s
