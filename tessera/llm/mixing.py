"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, table

#: Places in the seeded order: the leading 20 bits of a hash, in two steps of BITS.
BITS = 10


def words_in(text: str | Column) -> Column:
    """Number of words (long) between ASCII white space; 0 for null."""
    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.size(F.array_remove(F.split(body, SPACE), "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with target: ``share`` of all words, dealt by weight, at most ``epochs`` times a source's size.

    Sources by code point, null last, get ``weights`` over and over. Water-filling clamps every source whose share by weight
    exceeds its cap, redistributes the excess over the others by weight, and repeats until none exceeds it. A source is clamped
    iff its cap per weight is at most the level reached when those with lower caps per weight are clamped; so with sources in
    order of cap per weight, sums of caps before and of weights after give each round's level. Levels rise up to the first that
    the source at hand can hold, which is final, and fall after it. All of them are clamped if the caps add up to less than is dealt.

    One row for each source is put in order, not the documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("__w", weight).withColumn("__cap", epochs * F.col("source_size"))
    fill = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = caps.withColumn("__level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after))
    level = F.max(F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__level"))).over(everything)
    return levels.withColumn("target", F.least(F.col("__cap"), F.coalesce(level * F.col("__w"), F.col("__cap")))).drop("__w", "__cap", "__level")


def _edge(rows: DataFrame, place: str) -> DataFrame:
    """(k, ``place``, left): for each k the place at which the words wanted are used up, and how many are left there; none if all are wanted."""
    sums = rows.groupBy("k", place).agg(F.sum("size").alias("s"), F.first("want").alias("want"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("k").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("before", before).where("before <= want and want < before + s").select("k", place, (F.col("want") - F.col("before")).alias("left"))


def mix(df: DataFrame, size: Column, key: str = "doc_id", source: str = "source", seed: int = 7, split_last: bool = True, **how) -> DataFrame:
    """All rows of ``df`` in a struct ``row``, with ``size`` (null: 0), source_size, target and taken (long; words the mix takes, repeats counted).

    A source repeats all its rows floor(target / size) times. What its target lacks then is met by one more repetition of rows in
    a seeded order, md5 of seed and ``key``, until it is used up: by a part of the row at which that happens if ``split_last`` (so
    the sum over a source is its rounded target), else by the whole of that row iff at least half of it is wanted.

    A row's place depends on nothing but its source, ``key`` and size, so reruns agree; rows that repeat a ``key`` are neighbours,
    by size. Null keys are one key, null sources one source; rows of size 0 are never taken. An empty table gives an
    empty one. ``how`` goes to targets(). The words before a row are summed by leading bits of the order, twice, and row by row
    only inside the one place of each source where its target is used up, a millionth of its rows.
    """
    rows = df.select(F.struct(*df.columns).alias("row"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("k"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("h"))
    rows = rows.withColumn("p", F.conv(F.substring("h", 1, 2 * BITS // 4), 16, 10).cast("int")).withColumns({"p1": F.shiftright("p", BITS), "p2": F.col("p").bitwiseAND(F.lit((1 << BITS) - 1))})
    light = cut(rows.select("k", "size", "p1", "p2"))
    sizes = light.groupBy("k").agg(F.sum("size").alias("source_size")).withColumn("source", F.when(F.col("k") != "", F.substring("k", 2, 1 << 30)))
    dealt = targets(sizes, **how).drop("source")
    dealt = dealt.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    # Written, so that its size is known: few sources are broadcast, many are joined by shuffle.
    dealt = cut(dealt.withColumn("want", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long")))
    first = cut(_edge(light.join(dealt.select("k", "want"), "k"), "p1"))
    second = cut(_edge(light.join(first.withColumnRenamed("left", "want"), ["k", "p1"]), "p2"))
    plan = cut(dealt.join(first.drop("left").withColumnRenamed("p1", "e1"), "k", "left").join(second.withColumnRenamed("p2", "e2"), "k", "left"))
    rows = rows.join(plan, "k")
    at = F.coalesce(F.col("e1"), F.lit(1 << BITS)) * (1 << BITS) + F.coalesce(F.col("e2"), F.lit(0))
    out = lambda x, extra: x.select("row", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).alias("taken"))
    sure = out(rows.where(F.col("p") != at), F.when(F.col("p") < at, F.col("size")).otherwise(0))
    here = Window.partitionBy("k").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("left") - F.coalesce(F.sum("size").over(here), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), room)) if split_last else F.when((room > 0) & (2 * room >= F.col("size")), F.col("size")).otherwise(0)
    return sure.unionByName(out(rows.where(F.col("p") == at), extra))


def repeated(df: DataFrame, text: str = "text", **how) -> DataFrame:
    """``df`` mixed: every row as many times as mix() takes it, whole rows only, all columns as they were. Rows without words go."""
    taken = mix(df, words_in(text), split_last=False, **how).where("taken > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select("row.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What mix() takes of every document, by words."""
    # Written first: the texts are read once.
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", words_in("text").alias("size")))
    return mix(docs, F.col("size")).select("row.doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
c AS (SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT *, least(cap, coalesce(max(CASE WHEN level * w <= cap THEN level END) OVER () * w, cap)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
q AS (SELECT *, floor(target - whole * source_size + 0.5)::BIGINT AS want FROM p)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, want - coalesce(sum(size) OVER (PARTITION BY q.rn ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""
