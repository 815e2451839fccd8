"""Exact random splits into training and test rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...plans.order import ranked


def _sizes(n: int, testSize: float, trainSize: float | None) -> tuple[int, int]:
    test = math.floor(n * testSize) if 0 < testSize < 1 else int(testSize)
    train = n - test if trainSize is None else math.floor(n * trainSize) if 0 < trainSize < 1 else int(trainSize)
    if test < 0 or train < 0 or train + test > n:
        raise ValueError("sizes of training and test add up to more than there is")
    return train, test


def trainTestSplit(df: DataFrame, key: str | list[str], testSize: float = 0.25, trainSize: float | None = None, randomState: int = 0, shuffle: bool = True, stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(training, test): the first rows of an order, by hashes of ``key`` and the state unless ``shuffle`` is off, and the next.

    With ``stratify`` every class is split by itself, its test part rounded. ``key`` tells rows apart.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if trainSize is not None and testSize == 0.25 and trainSize > 0.75:
        testSize = 1 - trainSize
    order = [F.xxhash64(*keys, F.lit(randomState)), *map(F.col, keys)] if shuffle else list(map(F.col, keys))
    if stratify is None:
        out = ranked(df, order, "__rank")
        train, test = _sizes(out.count, testSize, trainSize)
        rank = F.col("__rank")
        return out.df.where(rank <= train).drop("__rank"), out.df.where((rank > train) & (rank <= train + test)).drop("__rank")
    return stratifiedSplit(df, keys, stratify, testSize, order)


def stratifiedSplit(df: DataFrame, keys: list[str], stratify: str, testSize: float, order: list) -> tuple[DataFrame, DataFrame]:
    """Classes one after the other in one order; where each begins follows from their sizes."""
    out = ranked(df, [F.col(stratify), *order], "__rank").df
    classes = df.groupBy(stratify).agg(F.count("*").alias("__n"))
    first = out.groupBy(stratify).agg((F.min("__rank") - 1).alias("__before"))
    both = classes.join(first, classes[stratify].eqNullSafe(first[stratify])).select(classes[stratify].alias("__class"), "__n", "__before")
    rows = out.join(both, out[stratify].eqNullSafe(both["__class"]))
    test = F.floor(F.col("__n") * testSize + 0.5)
    is_test = F.col("__rank") - F.col("__before") > F.col("__n") - test
    return tuple(rows.where(c).drop("__rank", "__class", "__n", "__before") for c in (~is_test, is_test))


def shuffleArray(df: DataFrame, key: str | list[str], randomState: int = 0) -> DataFrame:
    """Rows with their place (0, 1, ...) in a random order."""
    keys = [key] if isinstance(key, str) else list(key)
    out = ranked(df, [F.xxhash64(*keys, F.lit(randomState)), *map(F.col, keys)], "place").df
    return out.withColumn("place", F.col("place") - 1)
