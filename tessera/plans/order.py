"""Positions in a total order and running totals without gathering rows in one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import cut


@dataclass
class Ranked:
    df: DataFrame
    count: int


def _columns(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def ranked(df: DataFrame, order: list, keep: str = "rank") -> Ranked:
    """``df`` with ``keep``: 1, 2, ... in the order of columns; and the number of rows. Ties are put in order arbitrarily.

    Rows are range-partitioned, numbered inside the partitions, and moved on by the sizes of the partitions before: one row for each
    partition is all that meets.
    """
    order = _columns(order)
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n")).collect()
    start, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["__part"]):
        start[r["__part"]] = total
        total += r.n
    if not sizes:
        return Ranked(parts.drop("__part").withColumn(keep, F.lit(0).cast("long")), 0)
    before = F.element_at(F.create_map(*[F.lit(x) for k, v in start.items() for x in (k, v)]), F.col("__part"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return Ranked(parts.withColumn(keep, (before + inside).cast("long")).drop("__part"), total)


#: Positions in a block of a running total.
BLOCK = 1 << 15


def running(df: DataFrame, position: str, value: str, by: list[str], how: str = "sum", to: str | None = None) -> DataFrame:
    """``df`` with the running sum or product of ``value`` along ``position`` (0, 1, ...) for each ``by``.

    In two levels: inside blocks of positions, then over the blocks' totals. So a single long vector is spread over tasks.
    """
    whole = F.sum if how == "sum" else F.product
    join = (lambda a, b: a + b) if how == "sum" else (lambda a, b: a * b)
    df = df.withColumn("__block", (F.col(position) / BLOCK).cast("long"))
    inside = Window.partitionBy(*by, "__block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*by, "__block").agg(whole(value).alias("__t"))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(whole("__t").over(before), F.lit(0.0 if how == "sum" else 1.0))).drop("__t")
    out = df.withColumn("__in", whole(value).over(inside)).join(totals, [*by, "__block"])
    return out.withColumn(to or value, join(F.col("__before"), F.col("__in"))).drop("__block", "__in", "__before")
