"""Metrics as aggregate expressions of columns, for agg() or groupBy().agg(); weights are columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import elementwise as ew
from ...functions.elementwise import ColumnLike, num


def _ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b != 0, F.try_divide(a, b)).otherwise(otherwise)


def _weight(w: ColumnLike | None) -> Column:
    return F.lit(1.0) if w is None else num(w)


def accuracyScore(t: ColumnLike, p: ColumnLike, normalize: bool = True, sampleWeight: ColumnLike | None = None) -> Column:
    w = _weight(sampleWeight)
    hits = F.sum(F.when(num(t) == num(p), w).otherwise(0.0))
    return F.coalesce(_ratio(hits, F.sum(w)) if normalize else hits, F.lit(0.0))


def _counts(t: ColumnLike, p: ColumnLike, pos: float) -> tuple[Column, Column, Column]:
    t, p = num(t) == float(pos), num(p) == float(pos)
    return F.count_if(t & p).cast("double"), F.count_if(~t & p).cast("double"), F.count_if(t & ~p).cast("double")


def precisionScore(t: ColumnLike, p: ColumnLike, posLabel: float = 1) -> Column:
    """0 if nothing is predicted."""
    tp, fp, _ = _counts(t, p, posLabel)
    return _ratio(tp, tp + fp)


def recallScore(t: ColumnLike, p: ColumnLike, posLabel: float = 1) -> Column:
    tp, _, fn = _counts(t, p, posLabel)
    return _ratio(tp, tp + fn)


def f1Score(t: ColumnLike, p: ColumnLike, posLabel: float = 1) -> Column:
    tp, fp, fn = _counts(t, p, posLabel)
    return _ratio(2 * tp, 2 * tp + fp + fn)


def confusionMatrix(df: DataFrame, t: str, p: str, labels: list | None = None) -> DataFrame:
    """(actual, predicted, count) for all pairs of labels, those that occur unless given; others aren't counted."""
    pairs = df.select(F.col(t).alias("actual"), F.col(p).alias("predicted"))
    if labels is None:
        every = pairs.select(F.col("actual").alias("x")).union(pairs.select("predicted")).where("x is not null").distinct()
    else:
        every = df.sparkSession.createDataFrame([(x,) for x in labels], pairs.schema["actual"].dataType.simpleString().join(("x ", "")))
    grid = every.select(F.col("x").alias("actual")).crossJoin(every.select(F.col("x").alias("predicted")))
    return grid.join(pairs.groupBy("actual", "predicted").count(), ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("count", F.lit(0)).alias("count"))


def logLoss(t: ColumnLike, prob: ColumnLike, eps: float = 1e-15) -> Column:
    p = ew.clip(prob, eps, 1 - eps)
    return F.avg(-F.when(num(t) == 1, F.ln(p)).otherwise(F.ln(1 - p)))


def meanSquaredError(t: ColumnLike, p: ColumnLike, sampleWeight: ColumnLike | None = None, squared: bool = True) -> Column:
    w, d = _weight(sampleWeight), num(t) - num(p)
    out = _ratio(F.sum(w * d * d), F.sum(w))
    return out if squared else F.sqrt(out)


def rootMeanSquaredError(t: ColumnLike, p: ColumnLike, sampleWeight: ColumnLike | None = None) -> Column:
    return meanSquaredError(t, p, sampleWeight, squared=False)


def meanAbsoluteError(t: ColumnLike, p: ColumnLike, sampleWeight: ColumnLike | None = None) -> Column:
    w = _weight(sampleWeight)
    return _ratio(F.sum(w * F.abs(num(t) - num(p))), F.sum(w))


def meanAbsolutePercentageError(t: ColumnLike, p: ColumnLike, sampleWeight: ColumnLike | None = None) -> Column:
    w = _weight(sampleWeight)
    return _ratio(F.sum(w * F.abs(num(t) - num(p)) / (F.abs(num(t)) + 1e-15)), F.sum(w))


def _explained(residual: Column, spread: Column) -> Column:
    return F.when(spread > 0, 1 - F.try_divide(residual, spread)).when(residual == 0, 1.0).otherwise(0.0)


def r2Score(t: ColumnLike, p: ColumnLike, sampleWeight: ColumnLike | None = None) -> Column:
    """1 less squares of residuals over squares about the mean; without spread 1 for no residuals, else 0."""
    t, d = num(t), num(t) - num(p)
    if sampleWeight is None:
        return _explained(F.sum(d * d), F.var_pop(t) * F.count("*"))
    w = num(sampleWeight)
    return _explained(F.sum(w * d * d), F.sum(w * t * t) - _ratio(F.sum(w * t) * F.sum(w * t), F.sum(w)))


def explainedVarianceScore(t: ColumnLike, p: ColumnLike, sampleWeight: ColumnLike | None = None) -> Column:
    t, d = num(t), num(t) - num(p)
    if sampleWeight is None:
        return _explained(F.var_pop(d), F.var_pop(t))
    w = num(sampleWeight)
    var = lambda x: _ratio(F.sum(w * x * x), F.sum(w)) - _ratio(F.sum(w * x), F.sum(w)) * _ratio(F.sum(w * x), F.sum(w))
    return _explained(var(d), var(t))
