"""k-means by Lloyd's algorithm: every round is one aggregation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import elementwise as ew
from ...plans.stage import cut
from .base import Estimator


class KMeans(Estimator):
    """Centres with the least sum of squared distances of ``nInit`` runs. Start: k-means++ or random rows, drawn from all rows, or
    given centres. An empty cluster keeps its centre. Ties go to the lower number."""

    defaults = {"nClusters": 8, "init": "k-means++", "nInit": 10, "maxIter": 300, "tol": 1e-4, "randomState": 0, "algorithm": "lloyd", "verbose": False}

    def fit(self, df: DataFrame, features: list[str]) -> KMeans:
        self.features_ = list(features)
        # Equal rows are one with their number: sums, and the chances of being drawn, are those of all rows.
        rows = cut(df.select(F.array(*[ew.num(c) for c in features]).alias("x")).groupBy("x").agg(F.count("*").alias("n")))
        if (rows.agg(F.sum("n")).first()[0] or 0) < self.nClusters:
            raise ValueError("fewer rows than clusters")
        best = None
        given = not isinstance(self.init, str)
        for run in range(1 if given else self.nInit):
            centres = np.array(self.init, float) if given else self._start(rows, self.randomState + run)
            found = self._lloyd(rows, centres)
            if best is None or found[1] < best[1]:
                best = found
        self.clusterCenters_, self.inertia_, self.nIter_ = best
        return self

    def _start(self, rows: DataFrame, seed: int) -> np.ndarray:
        """Rows drawn by the least exponential keys, -ln(u) / weight: one pass over all rows for each centre, a few rows come back.
        The least of n keys is one over n times the weight; the next ones of as many copies follow it by one over n - 1 times, and so on.

        Weights are even for random starts (all centres in one pass), and squared distances to the nearest centre so far for k-means++;
        where all of those are 0, even again.
        """
        if self.init not in ("random", "k-means++"):
            raise ValueError(f"unknown start {self.init!r}")

        def key(step: Column) -> Column:
            return -F.ln((F.shiftrightunsigned(F.xxhash64("x", F.lit(seed), step), 12) + 0.5) * 2.0**-52)

        if self.init == "random":
            copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(self.nClusters)).cast("int"))))
            keys = F.aggregate(F.sequence(F.lit(1), F.col("copy")), F.lit(0.0), lambda total, i: total + key(i) / (F.col("n") - i + 1))
            return np.array([r.x for r in copies.orderBy(keys, "x").limit(self.nClusters).collect()], float)
        chosen = [rows.agg(F.min_by("x", F.struct(key(F.lit(0)) / F.col("n"), F.col("x"))).alias("x")).first().x]
        while len(chosen) < self.nClusters:
            far = rows.withColumn("d", nearest(F.col("x"), np.array(chosen, float))["d"])
            even = key(F.lit(len(chosen))) / F.col("n")
            place = F.struct(F.when(F.col("d") > 0, even / F.col("d")).otherwise(ew.INF), even, F.col("x"))
            chosen.append(far.agg(F.min_by("x", place).alias("x")).first().x)
        return np.array(chosen, float)

    def _lloyd(self, rows: DataFrame, centres: np.ndarray) -> tuple[list, float, int]:
        before, f = None, centres.shape[1]
        for done in range(1, self.maxIter + 1):
            near = rows.select("x", "n", nearest(F.col("x"), centres).alias("near")).select("x", "n", "near.d", "near.c")
            sums = near.groupBy("c").agg(F.sum("n").alias("n"), F.sum(F.col("d") * F.col("n")).alias("d"), *[F.sum(F.get("x", j) * F.col("n")).alias(f"s{j}") for j in range(f)]).collect()
            inertia = sum(r.d for r in sums)
            if before is not None and abs(before - inertia) < self.tol:
                return centres.tolist(), inertia, done
            before = inertia
            for r in sums:
                centres[r.c] = [r[f"s{j}"] / r.n for j in range(f)]
        return centres.tolist(), inertia, self.maxIter

    def _x(self) -> Column:
        return F.array(*[ew.num(c) for c in self.features_])

    def predict(self, df: DataFrame, to: str = "label") -> DataFrame:
        return df.withColumn(to, nearest(self._x(), np.array(self.clusterCenters_))["c"])

    def fitPredict(self, df: DataFrame, features: list[str], to: str = "label") -> DataFrame:
        return self.fit(df, features).predict(df, to)

    def transform(self, df: DataFrame, to: str = "distances") -> DataFrame:
        """Distances to all centres."""
        return df.withColumn(to, F.transform(squares(self._x(), np.array(self.clusterCenters_)), F.sqrt))

    def fitTransform(self, df: DataFrame, features: list[str], to: str = "distances") -> DataFrame:
        return self.fit(df, features).transform(df, to)

    def score(self, df: DataFrame) -> float:
        """The negative sum of squared distances."""
        return -(df.agg(F.coalesce(F.sum(nearest(self._x(), np.array(self.clusterCenters_))["d"]), F.lit(0.0)).alias("s")).first().s)


#: Differences that are written out, for which Spark makes code; more are computed in loops.
UNROLLED = 256


def squares(x: Column, centres: np.ndarray) -> Column:
    """Squared distances to centres, which are few and constant: no join."""
    if centres.size <= UNROLLED:
        return F.array(*[sum(((F.get(x, j) - float(v)) * (F.get(x, j) - float(v)) for j, v in enumerate(c)), F.lit(0.0)) for c in centres])
    each = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    return F.transform(each, lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))


def nearest(x: Column, centres: np.ndarray) -> Column:
    """(d, c): the least squared distance and the centre's number."""
    if centres.size <= UNROLLED:
        return F.array_min(F.array(*[F.struct(squares(x, centres[i : i + 1])[0].alias("d"), F.lit(i).alias("c")) for i in range(len(centres))]))
    return F.array_min(F.transform(squares(x, centres), lambda d, i: F.struct(d.alias("d"), i.alias("c"))))
