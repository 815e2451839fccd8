"""Estimators, metrics and splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.ml import metrics
from tessera.operators.ml.cluster import KMeans
from tessera.operators.ml.linear import LinearRegression, LogisticRegression
from tessera.operators.ml.mlp import MLPClassifier, MLPRegressor
from tessera.operators.ml.preprocess import MinMaxScaler, StandardScaler
from tessera.operators.ml.split import shuffleArray, trainTestSplit

R = np.random.default_rng(2)
X = R.normal(size=(200, 3)) * [1, 5, 0.1] + [0, 100, 3]


@pytest.fixture(scope="module")
def frame(spark):
    y = 2 * X[:, 0] - 0.5 * X[:, 1] + 7 * X[:, 2] + 1
    return spark.createDataFrame([(i, *map(float, x), float(v), float(x[0] + (x[1] - 100) / 5 > 0)) for i, (x, v) in enumerate(zip(X, y, strict=True))], "id long, a double, b double, c double, y double, k double")


def matrix(df, columns=("a", "b", "c")):
    return df.orderBy("id").select(*columns).toPandas().to_numpy()


def test_scalers(frame, spark):
    s = StandardScaler()
    out = s.fitTransform(frame, ["a", "b", "c"])
    np.testing.assert_allclose(matrix(out), (X - X.mean(0)) / X.std(0))
    np.testing.assert_allclose(matrix(s.inverseTransform(out)), X)
    m = MinMaxScaler(featureRange=(-1, 1))
    out = m.fitTransform(frame, ["a", "b", "c"])
    np.testing.assert_allclose(matrix(out), 2 * (X - X.min(0)) / (X.max(0) - X.min(0)) - 1, atol=1e-12)
    np.testing.assert_allclose(matrix(m.inverseTransform(out)), X)
    flat = spark.createDataFrame([(1, 4.0), (2, 4.0)], "id int, a double")
    assert [r.a for r in StandardScaler().fitTransform(flat, ["a"]).collect()] == [0, 0]
    c = MinMaxScaler()
    assert [r.a for r in c.inverseTransform(c.fitTransform(flat, ["a"])).collect()] == [4, 4]
    assert s.getParams() == {"withMean": True, "withStd": True} and s.setParams(withMean=False).withMean is False
    with pytest.raises(TypeError):
        StandardScaler(nothing=1)


def test_linear(frame):
    m = LinearRegression().fit(frame, ["a", "b", "c"], "y")
    np.testing.assert_allclose([*m.coef_, m.intercept_], [2, -0.5, 7, 1], rtol=1e-6)
    assert m.score(frame) == pytest.approx(1)
    x = np.hstack([X, X[:, :1]])
    assert x.shape == (200, 4)
    m = LinearRegression(fitIntercept=False).fit(frame, ["a", "b"], "y")
    np.testing.assert_allclose(m.coef_, np.linalg.lstsq(X[:, :2], matrix(frame, ["y"])[:, 0], rcond=None)[0])


def test_logistic(frame, spark):
    out = StandardScaler().fitTransform(frame, ["a", "b", "c"])
    m = LogisticRegression(C=100.0).fit(out, ["a", "b", "c"], "k")
    assert m.score(out) > 0.97
    x, y, w = matrix(out), matrix(out, ["k"])[:, 0], np.array([*m.coef_[0], m.intercept_[0]])
    p = 1 / (1 + np.exp(-(x @ w[:3] + w[3])))
    grad = np.append((x * (p - y)[:, None]).mean(0) + w[:3] / 100, (p - y).mean())
    assert np.abs(grad).max() < 1e-4
    rows = [(i, float(v), float(int(v > 1) + int(v > 2))) for i, v in enumerate(np.linspace(0, 3, 90))]
    three = spark.createDataFrame(rows, "id long, a double, k double").withColumn("b", F.col("a") * F.col("a"))
    m = LogisticRegression(C=1e4).fit(three, ["a", "b"], "k")
    assert m.classes_ == [0, 1, 2] and m.score(three) > 0.9
    p = np.stack(m.predictProba(three).toPandas()["probability"].to_list())
    np.testing.assert_allclose(p.sum(1), 1)


def test_kmeans(spark):
    points = [[1, 2], [1.5, 1.8], [5, 8], [8, 8], [1, 0.6], [9, 11], [2, 2], [2.5, 2.5]]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, a double, b double")
    m = KMeans(nClusters=2, randomState=42, nInit=3).fit(df, ["a", "b"])
    labels = np.array([r.label for r in m.predict(df).orderBy("id").collect()])
    assert len(set(labels[[0, 1, 4, 6, 7]])) == 1 == len(set(labels[[2, 3, 5]])) and labels[0] != labels[2]
    assert m.score(df) == pytest.approx(-m.inertia_)
    d = np.stack(m.transform(df).orderBy("id").toPandas()["distances"].to_list())
    assert (d.argmin(1) == labels).all()
    fixed = KMeans(nClusters=2, init=[[1.0, 1.0], [8.0, 8.0]]).fit(df, ["a", "b"])
    np.testing.assert_allclose(fixed.clusterCenters_, [np.mean([points[i] for i in (0, 1, 4, 6, 7)], 0), np.mean([points[i] for i in (2, 3, 5)], 0)])


@pytest.mark.parametrize("init", ["k-means++", "random"])
def test_starts_are_drawn_from_all_rows(spark, init):
    """One vector has most of the rows; still the far ones are found, and a random start draws copies for themselves."""
    rows = [(0.0, 0.0)] * 3000 + [(50.0 + i % 3, 50.0) for i in range(30)] + [(-50.0, 50.0 + i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(4)
    m = KMeans(nClusters=3, nInit=1 if init == "k-means++" else 2, init=init, randomState=1, maxIter=5).fit(df, ["a", "b"])
    if init == "k-means++":
        assert sorted(round(c[0]) for c in m.clusterCenters_) == [-50, 0, 51]
    else:
        assert m.inertia_ > 0 and [0.0, 0.0] in m.clusterCenters_


def test_networks(frame):
    out = StandardScaler().fitTransform(frame, ["a", "b", "c"])
    m = MLPClassifier(hiddenLayerSizes=(8,), learningRateInit=0.05, maxIter=60).fit(out, ["a", "b", "c"], "k")
    assert m.score(out) > 0.9 and m.lossCurve_[-1] < m.lossCurve_[0]
    y = out.withColumn("y", F.col("a") * 2 - F.col("b"))
    r = MLPRegressor(hiddenLayerSizes=(8,), activation="tanh", learningRateInit=0.05, maxIter=100).fit(y, ["a", "b", "c"], "y")
    assert r.score(y) > 0.9


def test_gradients_of_networks(frame):
    """Back-propagation against finite differences."""
    df = frame.limit(6).select(F.array("a", F.col("b") / 100, "c").alias("x"), F.col("k").alias("y"))
    for cls, act, outputs in ((MLPClassifier, "tanh", 2), (MLPRegressor, "logistic", 1)):
        m = cls(hiddenLayerSizes=(4,), activation=act)
        rng = np.random.default_rng(0)
        m.weights_ = [(rng.normal(size=(3, 4)), rng.normal(size=4)), (rng.normal(size=(4, outputs)), rng.normal(size=outputs))]
        shapes = [w.shape for layer in m.weights_ for w in layer]
        v = np.concatenate([w.ravel() for layer in m.weights_ for w in layer])
        _, grad = m._pass(df)
        for i in (0, 5, 13, len(v) - 1):
            loss = []
            for h in (1e-5, -1e-5):
                u = v.copy()
                u[i] += h
                m._set(u, shapes)
                loss.append(m._pass(df)[0])
            assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(grad[i], rel=1e-3, abs=1e-6)
            m._set(v, shapes)


def test_metrics(spark):
    rows = [(1, 1, 0.9, 2.0), (0, 1, 0.6, 1.0), (1, 0, 0.4, 1.0), (0, 0, 0.1, 3.0), (1, 1, 0.8, 1.0)]
    df = spark.createDataFrame([(float(t), float(p), q, w) for t, p, q, w in rows], "t double, p double, q double, w double")
    t, p, q, w = (np.array(c, float) for c in zip(*rows, strict=True))
    got = df.agg(*[f.alias(n) for n, f in {"acc": metrics.accuracyScore("t", "p"), "accw": metrics.accuracyScore("t", "p", sampleWeight="w"), "hits": metrics.accuracyScore("t", "p", False), "prec": metrics.precisionScore("t", "p"), "rec": metrics.recallScore("t", "p"), "f1": metrics.f1Score("t", "p"), "loss": metrics.logLoss("t", "q"), "mse": metrics.meanSquaredError("t", "q"), "rmse": metrics.rootMeanSquaredError("t", "q"), "mae": metrics.meanAbsoluteError("t", "q", "w"), "mape": metrics.meanAbsolutePercentageError("q", "t"), "r2": metrics.r2Score("t", "q"), "r2w": metrics.r2Score("t", "q", "w"), "ev": metrics.explainedVarianceScore("t", "q")}.items()]).first()
    ybar = np.average(t, weights=w)
    want = {"acc": 0.6, "accw": 6 / 8, "hits": 3, "prec": 2 / 3, "rec": 2 / 3, "f1": 2 / 3, "loss": -np.mean(np.where(t == 1, np.log(q), np.log(1 - q))), "mse": ((t - q) ** 2).mean(), "rmse": np.sqrt(((t - q) ** 2).mean()), "mae": np.average(np.abs(t - q), weights=w), "mape": np.mean(np.abs(q - t) / q), "r2": 1 - ((t - q) ** 2).sum() / ((t - t.mean()) ** 2).sum(), "r2w": 1 - (w * (t - q) ** 2).sum() / (w * (t - ybar) ** 2).sum(), "ev": 1 - (t - q).var() / t.var()}
    for n, x in want.items():
        assert got[n] == pytest.approx(x), n
    table = {(r.actual, r.predicted): r["count"] for r in metrics.confusionMatrix(df, "t", "p").collect()}
    assert table == {(1, 1): 2, (1, 0): 1, (0, 1): 1, (0, 0): 1}
    assert {(r.actual, r.predicted): r["count"] for r in metrics.confusionMatrix(df, "t", "p", [1.0, 5.0]).collect()} == {(1, 1): 2, (1, 5): 0, (5, 1): 0, (5, 5): 0}
    none = df.limit(0).agg(metrics.accuracyScore("t", "p").alias("a"), metrics.precisionScore("t", "p").alias("b")).first()
    assert none.a == 0 and none.b == 0


def test_splits(frame):
    train, test = trainTestSplit(frame, "id", 0.3, randomState=1)
    a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
    assert len(a) == 140 and len(b) == 60 and not a & b and train.columns == frame.columns
    assert b == {r.id for r in trainTestSplit(frame.repartition(7), "id", 0.3, randomState=1)[1].collect()} != {r.id for r in trainTestSplit(frame, "id", 0.3, randomState=2)[1].collect()}
    train, test = trainTestSplit(frame, "id", 0.25, stratify="k")
    n = {r.k: r["count"] for r in frame.groupBy("k").count().collect()}
    assert {r.k: r["count"] for r in test.groupBy("k").count().collect()} == {k: int(np.floor(v * 0.25 + 0.5)) for k, v in n.items()}
    assert train.count() + test.count() == 200
    first, last = trainTestSplit(frame, "id", 0.25, shuffle=False)
    assert max(r.id for r in first.collect()) == 149 and min(r.id for r in last.collect()) == 150
    assert sorted(r.place for r in shuffleArray(frame, "id").collect()) == list(range(200))
    with pytest.raises(ValueError):
        trainTestSplit(frame, "id", 0.6, trainSize=0.6)


def test_mlp_of_too_many_classes(spark):
    with pytest.raises(ValueError, match="1000 classes"):
        MLPClassifier(maxIter=1, hiddenLayerSizes=(1,)).fit(spark.range(1002).selectExpr("double(id) as a", "double(id) as k"), ["a"], "k")


def test_passes_over_different_rows(spark, monkeypatch):
    """3,000 rows of 5 kinds: what is passed over again and again has a row for each kind, and the fit is that of all rows."""
    from tessera.operators.ml import cluster, linear, mlp
    from tessera.plans.stage import cut

    rows = [(float(i % 3), float(i % 3 > 0 if i % 10 else i % 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, k double").repartition(4)
    seen = []

    def counted(frame):
        out = cut(frame)
        seen.append(out.count())
        return out

    for module in (cluster, linear, mlp):
        monkeypatch.setattr(module, "cut", counted, raising=False)
    m = KMeans(nClusters=3, nInit=3, randomState=1).fit(df, ["a"])
    assert sorted(c[0] for c in m.clusterCenters_) == [0.0, 1.0, 2.0] and m.inertia_ == 0
    fitted = LogisticRegression(penalty=None, tol=1e-8).fit(df, ["a"], "k")
    # At the optimum the probabilities add up to the ones.
    assert fitted.predictProba(df).agg(F.sum(F.col("probability")[1])).first()[0] == pytest.approx(sum(k for _, k in rows), abs=1e-3)
    net = MLPClassifier(hiddenLayerSizes=(4,), learningRateInit=0.05, maxIter=40, randomState=2).fit(df, ["a"], "k")
    few = net.lossCurve_
    assert seen == [3, len(set(rows)), len(set(rows))]
    monkeypatch.setattr(mlp, "FEW", 0)
    assert np.allclose(MLPClassifier(hiddenLayerSizes=(4,), learningRateInit=0.05, maxIter=5, randomState=2).fit(df, ["a"], "k").lossCurve_, few[:5], rtol=1e-12)
