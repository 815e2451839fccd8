"""Scalers: one aggregation to fit, a projection to transform."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import elementwise as ew
from .base import Estimator


class _Scaler(Estimator):
    def _aggregate(self, df: DataFrame, features: list[str], *fs):
        if not features:
            raise ValueError("no features")
        row = df.agg(F.count("*").alias("n"), *[f(ew.num(c)).alias(f"x{k}_{j}") for j, c in enumerate(features) for k, f in enumerate(fs)]).first()
        if not row.n:
            raise ValueError("no rows to fit")
        self.features_, self.nFeaturesIn_, self.nSamplesSeen_ = list(features), len(features), row.n
        return [[row[f"x{k}_{j}"] for j in range(len(features))] for k in range(len(fs))]

    def _project(self, df: DataFrame, f) -> DataFrame:
        missing = [c for c in self.features_ if c not in df.columns]
        if missing:
            raise ValueError(f"features {missing} are missing")
        return df.withColumns({c: f(j, ew.num(c)) for j, c in enumerate(self.features_)})

    def fitTransform(self, df: DataFrame, features: list[str]) -> DataFrame:
        return self.fit(df, features).transform(df)


class StandardScaler(_Scaler):
    """(x - mean) / standard deviation of the population; a constant column is divided by 1."""

    defaults = {"withMean": True, "withStd": True}

    def fit(self, df: DataFrame, features: list[str]) -> StandardScaler:
        self.mean_, self.var_ = self._aggregate(df, features, F.avg, F.var_pop)
        self.scale_ = [v**0.5 or 1.0 for v in self.var_]
        return self

    def _terms(self, j: int) -> tuple[float, float]:
        return self.mean_[j] if self.withMean else 0.0, self.scale_[j] if self.withStd else 1.0

    def transform(self, df: DataFrame) -> DataFrame:
        return self._project(df, lambda j, x: (x - self._terms(j)[0]) / self._terms(j)[1])

    def inverseTransform(self, df: DataFrame) -> DataFrame:
        return self._project(df, lambda j, x: x * self._terms(j)[1] + self._terms(j)[0])


class MinMaxScaler(_Scaler):
    """To a range; a constant column goes to its lower end (and back to its value)."""

    defaults = {"featureRange": (0.0, 1.0)}

    def fit(self, df: DataFrame, features: list[str]) -> MinMaxScaler:
        low, high = self.featureRange
        if low >= high:
            raise ValueError("the range is empty")
        self.dataMin_, self.dataMax_ = self._aggregate(df, features, F.min, F.max)
        self.dataRange_ = [b - a for a, b in zip(self.dataMin_, self.dataMax_, strict=True)]
        self.scale_ = [(high - low) / r if r else 0.0 for r in self.dataRange_]
        self.min_ = [low - a * s for a, s in zip(self.dataMin_, self.scale_, strict=True)]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self._project(df, lambda j, x: x * self.scale_[j] + self.min_[j])

    def inverseTransform(self, df: DataFrame) -> DataFrame:
        return self._project(df, lambda j, x: (x - self.min_[j]) / self.scale_[j] if self.scale_[j] else F.lit(float(self.dataMin_[j])))
