"""What dense routines share: a bounded tensor gathered in one task, NumPy there, rows back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..plans.tensor import DENSE, Tensor, flat_index


def dense(t: Tensor | list[Tensor], f: Callable, outputs: dict[str, tuple]) -> dict[str, Tensor]:
    """``f(arrays...) -> {name: array}`` run on executors, with the shape of each output known beforehand.

    The inputs' elements meet in one task, which is why their number is bounded by DENSE: routines without an algorithm over
    parts are for matrices that fit a machine. Outputs are tables and may be read in any order.
    """
    tensors = [t] if isinstance(t, Tensor) else t
    if sum(x.size for x in tensors) > DENSE:
        raise ValueError(f"dense routines take up to {DENSE} elements")
    shapes = [x.shape for x in tensors]
    parts = [x.df.select(F.lit(k).alias("part"), flat_index(x.shape).alias("flat"), "v") for k, x in enumerate(tensors)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = [np.zeros(int(np.prod(s))) for s in shapes]
        for b in batches:
            for k, rows in b.groupby("part"):
                arrays[k][rows["flat"].to_numpy()] = rows["v"].to_numpy()
        result = f(*[a.reshape(s) for a, s in zip(arrays, shapes, strict=True)])
        for name, value in result.items():
            v = np.ascontiguousarray(value, dtype=np.float64).ravel()
            yield pd.DataFrame({"name": name, "flat": np.arange(len(v)), "v": v})

    # Only the gathered rows meet; what makes them stays spread over tasks.
    rows = both.repartition(1).mapInPandas(run, "name string, flat long, v double")
    if len(outputs) > 1:
        from ..plans.stage import cut

        rows = cut(rows)  # once for all outputs
    from ..plans.tensor import coordinates

    return {name: Tensor(rows.where(F.col("name") == name).select(*coordinates(F.col("flat"), shape), "v"), shape) for name, shape in outputs.items()}
