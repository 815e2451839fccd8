"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, table

#: Shingles hashed at a time, so that one very long text needs bounded memory for its bits.
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of ``text``: A-Z lower-cased, words between ASCII white space, ``width``-word shingles with repeats.

    A text of fewer words is one shingle; a null text or one without words has fingerprint 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    wide = min(width, len(words))
    starts, ends = starts[: len(words) - wide + 1], ends[wide - 1 :]
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), BLOCK):
        at, to = starts[i : i + BLOCK].tolist(), ends[i : i + BLOCK].tolist()
        h = np.fromiter((digest(flat[a:b], 42) for a, b in zip(at, to, strict=True)), np.uint64, len(at))
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", width: int = 3, to: str = "fp") -> DataFrame:
    """``df`` with the fingerprint of ``text`` as a long (the same 64 bits, signed) in column ``to``."""

    @F.pandas_udf("long")
    def of(texts):
        import pandas as pd

        return pd.Series(np.fromiter((fingerprint(x, width) for x in texts), np.uint64, len(texts)).view(np.int64))

    return df.withColumn(to, of(F.col(text)))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


HALF, MASK = 32, (1 << 32) - 1


def _flips(n: int) -> Column:
    """No bit, and each of the lowest ``n`` bits, as an array of longs."""
    return F.array(*[F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in (0, *(1 << i for i in range(n)))])


def _ball(value: str, n: int) -> Column:
    return F.explode(F.transform(_flips(n), lambda x: F.col(value).bitwiseXOR(x)))


def near_links(fps: DataFrame, distance: int = 2, bucket: int = 64) -> DataFrame:
    """Links (u, v: long, u != v) that connect the distinct, non-null fingerprints ``fps`` (fp: long) as all pairs within ``distance`` do.

    Multi-index hashing with two segments of 32 bits: of two fingerprints within 2 bits, one segment differs in at most one bit.
    Every fingerprint is filed under either segment and looks up the ball of radius 1 around its own; where segments differ, only
    the fingerprint with the bit unset looks up. Matches are verified on the whole fingerprint.

    A segment value that more than ``bucket`` fingerprints share would give pairs by the square. Its members, and whatever has it
    in the ball around its own segment, are filed under their whole fingerprint with each one bit flipped in either segment, or
    none, instead. At most 65 fingerprints meet under one such key, any two of them within 2 bits, and any two within 2 bits meet;
    each is linked to the least. So no link is lost and no group grows, whatever the fingerprints are.
    """
    if distance != 2:
        raise ValueError("segments and balls are laid out for a distance of 2")
    segments = F.array(*[F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("fp", HALF * s).bitwiseAND(F.lit(MASK)).alias("seg")) for s in (0, 1)])
    filed = fps.select("fp", F.inline(segments))
    hot = cut(filed.groupBy("s", "seg").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("s", "seg"))
    crowded = not hot.isEmpty()
    cold = filed.join(hot, ["s", "seg"], "left_anti") if crowded else filed
    unset = F.filter(_flips(HALF), lambda x: F.col("seg").bitwiseAND(x) == 0)
    looks = filed.select(F.col("fp").alias("u"), "s", F.explode(F.transform(unset, lambda x: F.col("seg").bitwiseXOR(x))).alias("seg"))
    found = looks.join(cold.withColumnRenamed("fp", "v"), ["s", "seg"]).where("u != v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).select("u", "v")
    if not crowded:
        return found
    around = filed.select("fp", "s", _ball("seg", HALF).alias("seg")).join(hot, ["s", "seg"], "left_semi").select("fp").distinct()
    keyed = cut(around.select("fp", _ball("fp", 2 * HALF).alias("key")))
    least = cut(keyed.groupBy("key").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v"))
    return found.unionByName(keyed.join(least, "key").select(F.col("fp").alias("u"), "v").where("u != v"))


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(``key``, fp, component_id) for every row of ``df``; component_id is the least ``key`` reachable over near fingerprints.

    Null texts, empty ones and ones of white space alone have fingerprint 0 and are linked like any other. Rows with equal
    fingerprints are one node, so copies cost no pairs; rows with a null ``key`` are kept and lend no id, their component_id is
    that of the rest of their component (null if it has no other row). Repeated rows are kept. Extra columns are ignored.
    """
    rows = cut(fingerprints(df.select(F.col(key).alias("id"), F.col(text).alias("text")), "text", width).select("id", "fp"))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(near_links(nodes.select("fp")))
    # Only fingerprints that have a near one are in roots; the ids of a component are taken over its nodes.
    joined = cut(nodes.join(cut(roots.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = cut(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(joined.join(ids, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select(F.col("id").alias(key), "fp", "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with the least ``key`` of each group of near copies, all columns as they were.

    Rows with a null ``key`` are kept: nothing tells them apart. Of rows that repeat a kept ``key``, all stay.
    """
    groups = near_groups(df, key, text)
    gone = cut(groups.where((F.col(key) != F.col("component_id"))).select(F.col(key).alias("__gone")).distinct())
    return df.join(gone, df[key] == gone["__gone"], "left_anti")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints in hexadecimal and components of near_groups() of all documents."""
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
