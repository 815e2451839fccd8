"""What the operators of this subpackage share: table access, held-out rows and connected components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stage import cut, discard

#: ASCII white space separates words; everything else, other Unicode spaces included, belongs to words.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 on division by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda's variable isn't inlined as a column's expression is."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Bits of a row of a bitmap, and its most rows.
SLOT, SLOTS = 1 << 15, 1 << 12


def among(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with a column ``among``: true for every row whose hash ``key`` is one of ``keys``', and for one in 16 of the others or fewer.

    The hashes' bitmap is broadcast, two bytes a hash and 16 MB at most (beyond that more others pass), so that a join with ``keys``
    shuffles little but the rows that it keeps.
    """
    slots = min(SLOTS, 1 << max(0, math.ceil(math.log2(max(1, keys.count()) * 16 / SLOT))))
    slot, bit = F.pmod(F.col(key), F.lit(slots)), F.pmod(F.shiftright(key, 32), F.lit(SLOT))
    bitmap = keys.select(slot.alias("slot"), bit.alias("bit")).repartition("slot").groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return df.withColumn("slot", slot).join(F.broadcast(bitmap), "slot", "left").withColumn("among", found).drop("slot", "bits")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (u, v: long) as (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps until nothing changes, so O(log^2) rounds whatever the shape. Each step groups
    by node with map-side minima and joins the minima back to the edges; both sides of that join are tables, so that a hub with
    a third of all edges is split by skew-join handling. Nodes without edges don't appear. Null ends and loops are ignored.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # Large-star: neighbours above a node go to its least neighbour.
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        discard(now, least)
        # Small-star: a node and its lower neighbours go to the least of them.
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        linked = large.join(least, "u")
        now = cut(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(large, least)
