"""Counts for quality rules, and cutoffs whose false rejections are bounded on labelled holdouts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, let, table

WINDOW = 8
SYMBOLS = r"[^#*$%&|<>]+"

#: What a rule measures, from 0 (clean) to 1: parts of a text.
RULES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share")
#: How much a share counts: the cutoff of a rule is a stratum's level divided by this.
SCALES = {"symbol_share": 3.0, "dup_line_share": 1.0, "repeat_share": 1.0, "upper_share": 1.5, "bang_share": 1.0}


def _repeated(words: Column) -> Column:
    """Number of words in windows of 8 words that occur twice or more; windows are compared by 64-bit hashes, in n log n steps."""

    def covered(h: Column) -> Column:
        def marked(s: Column) -> Column:
            same = F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
            steps = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(WINDOW), lambda n, k: n + F.least(F.lit(WINDOW), F.get(p, k) - F.get(p, k - 1)))
            return let(F.array_sort(F.transform(same, lambda x: x["i"])), steps)

        return let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), marked)

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(found)


def _letters(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, ""))


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and a share for each of RULES.

    A null text counts as an empty one, which has no words, shares of 0, and fails.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    whole = let(F.array_remove(F.split(body, SPACE), ""), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated(w).alias("repeated")))
    lines = let(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    df = df.withColumns({"__w": whole, "__l": lines, "__s": _letters(body, SYMBOLS), "__u": _letters(body, "[^A-Z]+"), "__b": _letters(body, "[^!]+")})
    df = df.withColumns({"n_words": F.col("__w.n").cast("long"), "word_chars": F.col("__w.chars").cast("long"), "n_symbols": F.col("__s").cast("long"), "n_dup_lines": F.col("__l.dup").cast("long"), "n_repeat_words": F.col("__w.repeated").cast("long")})
    share = lambda x, y: F.when(F.col(y) > 0, F.least(F.lit(1.0), F.col(x) / F.col(y))).otherwise(0.0)
    shares = {"symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "__l.n"), "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("__u", "word_chars"), "bang_share": ("__b", "n_words")}
    df = df.withColumns({k: share(*shares[k]) for k in RULES} | {"base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))})
    return df.drop("__w", "__l", "__s", "__u", "__b")


def most_allowed(n: Column, alpha: float, delta: Column) -> Column:
    """The largest k with P(X <= k) <= ``delta`` for X of the binomial distribution (n, ``alpha``); -1 if there is none.

    With at most that many false rejections among n, the exact (Clopper-Pearson) upper bound of their rate at confidence
    1 - delta is ``alpha`` or less. The terms are summed one by one from logarithms; k is below alpha * n for every delta < 1/2.
    """
    import math

    odds = math.log(alpha / (1 - alpha))
    start = F.struct(F.lit(0.0).alias("log_term"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("k"))

    def step(x: Column, i: Column) -> Column:
        log_term = F.when(i == 0, n * math.log1p(-alpha)).otherwise(x["log_term"] + F.ln((n - i + 1) / F.greatest(i, F.lit(1))) + odds)
        return let(log_term, lambda t: let(x["cdf"] + F.exp(t), lambda c: F.struct(t.alias("log_term"), c.alias("cdf"), F.when(c <= delta, i.cast("long")).otherwise(x["k"]).alias("k"))))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(n * alpha).cast("int")), start, step, lambda x: x["k"])


def badness() -> Column:
    """The greatest of the shares by SCALES, at most 1: the level of the strictest joint cutoffs that reject the text."""
    return F.least(F.lit(1.0), F.greatest(*[F.col(r) * SCALES[r] for r in RULES]))


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "stratum", alpha: float = 0.02, delta: float = 0.05, grid: int = 50, weight: float = 20.0) -> DataFrame:
    """(stratum, level: the least badness() that is rejected, null for none): risk-controlled on the labelled holdout.

    ``labels`` (doc_id, quality 0/1) marks good (1) and bad texts; of contradicting labels of one id, 1 counts, and rows with a
    null id or label don't. The holdout is every labelled row of ``measured`` that the base rules pass. Candidate levels are fixed
    beforehand: j / ``grid``; a level sets the cutoffs of all rules together. One is certified if the exact binomial bound shows
    that it rejects at most ``alpha`` of the good texts in the stratum. Levels are tested from the strictest down to the
    first failure (fixed sequence, so rules and levels need no correction), at ``delta`` / strata (Bonferroni). So with probability
    1 - ``delta`` at most ``alpha`` of good texts are rejected in every stratum. Of the certified ones, the level that rejects most
    bad texts is taken, a good one weighing as ``weight`` bad ones; the higher of equals; none if no bad text is gained.
    A stratum with few labels certifies nothing and rejects nothing: with 5 strata that takes ln(0.01) / ln(0.98), 228 good texts at
    least. No rows come out for strata without labels.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = measured.where("not base_failed").join(cut(known), "doc_id").select(stratum, "quality", F.floor(badness() * grid).cast("int").alias("bin"))
    tallies = held.groupBy(stratum, "bin").agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") != 1).cast("long")).alias("bad"))
    at_least = lambda what: F.array(*[F.sum(F.when(F.col("bin") >= j, F.col(what)).otherwise(0)) for j in range(1, grid + 1)]).alias(f"{what}_at")
    tested = cut(tallies.groupBy(stratum).agg(F.sum("good").alias("n"), at_least("good"), at_least("bad")))
    tested = tested.withColumn("most", most_allowed(F.col("n"), alpha, F.lit(delta / max(1, tested.count()))))
    gain = lambda j: F.get("bad_at", j - 1) - weight * F.get("good_at", j - 1)
    # Rejections only grow as levels fall: all that are certified are above the first failure.
    best = F.array_max(F.transform(F.filter(F.sequence(F.lit(1), F.lit(grid)), lambda j: (F.get("good_at", j - 1) <= F.col("most")) & (gain(j) > 0)), lambda j: F.struct(gain(j).alias("gain"), j.alias("j"))))["j"]
    return tested.select(stratum, (best / grid).alias("level"))


def _measured(df: DataFrame, text: str, stratum: str, *more: Column) -> DataFrame:
    """Counts of each row; nothing of ``df`` comes along but ``more``, so that its columns' names can't clash with the counts'."""
    return counts(df.select(*more, F.col(text).alias("text"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))).drop("text")


def _verdict(measured: DataFrame, limits: DataFrame) -> DataFrame:
    kept = ~F.col("base_failed") & ~F.coalesce(badness() >= F.col("level"), F.lit(False))
    return measured.join(limits, "stratum", "left").withColumn("kept", kept).drop("level")


def judge(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(``key``, counts, shares, stratum, base_failed, kept) for every row of ``df``: base rules, then the cutoffs of its stratum.

    The stratum of a null is the empty string's. A null ``key`` has no label; its row is judged like any other. Repeated rows
    stay. An empty table gives an empty one; without labels only the base rules reject.
    """
    measured = cut(_measured(df, text, stratum, F.col(key).alias("doc_id")))
    # Limits are written first, so that their size is known: small ones are broadcast, others joined by shuffle.
    return _verdict(measured, cut(cutoffs(measured, labels))).withColumnRenamed("doc_id", key)


def keep(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of ``df`` that judge() keeps, all columns as they were, whatever their names. Rows are written with what was measured of
    them, as measuring costs far more than writing."""
    measured = _measured(df, text, stratum, F.col(key).alias("doc_id"), F.struct(*df.columns).alias("row"))
    measured = cut(measured.select("doc_id", "row", "stratum", "base_failed", *RULES))
    return _verdict(measured, cut(cutoffs(measured, labels))).where("kept").select("row.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of judge() for every document, labels being the holdout."""
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: SQL for op5; the terms of the binomial distribution come from the logarithm of the gamma function.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT rid, i, w[i:i + 7] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8)),
r AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1) GROUP BY rid),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
c AS (SELECT rid, doc_id, stratum, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, len(regexp_replace(t, '[^!]+', '', 'g')) AS n_bang FROM l LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN least(1.0::DOUBLE, n_symbols / word_chars) ELSE 0 END AS symbol_share, CASE WHEN n_lines > 0 THEN least(1.0::DOUBLE, n_dup_lines / n_lines) ELSE 0 END AS dup_line_share,
  CASE WHEN n_words > 0 THEN least(1.0::DOUBLE, n_repeat_words / n_words) ELSE 0 END AS repeat_share, CASE WHEN word_chars > 0 THEN least(1.0::DOUBLE, n_upper / word_chars) ELSE 0 END AS upper_share, CASE WHEN n_words > 0 THEN least(1.0::DOUBLE, n_bang / n_words) ELSE 0 END AS bang_share FROM c),
u AS (SELECT rid, doc_id, stratum, base_failed, least(1.0::DOUBLE, greatest(symbol_share * 3.0::DOUBLE, dup_line_share, repeat_share, upper_share * 1.5::DOUBLE, bang_share)) AS share FROM f),
h AS (SELECT u.*, k.quality, floor(share * 50)::INT AS bin FROM u JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) k USING (doc_id) WHERE NOT base_failed),
n AS (SELECT stratum, count_if(quality = 1)::DOUBLE AS n FROM h GROUP BY ALL),
j AS (SELECT stratum, n, j, coalesce((SELECT count_if(quality = 1) FROM h WHERE h.stratum = n.stratum AND bin >= j), 0) AS good, coalesce((SELECT count_if(quality <> 1) FROM h WHERE h.stratum = n.stratum AND bin >= j), 0) AS bad FROM n, (SELECT unnest(range(1, 51)) AS j)),
p AS (SELECT *, CASE WHEN n = 0 THEN 1 ELSE list_sum(list_transform(range(0, good::BIGINT + 1), lambda k: exp(lgamma(n + 1) - (CASE WHEN k = 0 THEN 0 ELSE lgamma((k + 1)::DOUBLE) END) - (CASE WHEN k = n THEN 0 ELSE lgamma((n - k + 1)::DOUBLE) END) + k * ln(0.02::DOUBLE) + (n - k) * ln(0.98::DOUBLE)))) END AS cdf FROM j WHERE bad - 20 * good > 0),
b AS (SELECT stratum, arg_max(j, (bad - 20 * good, j)) / 50 AS level FROM p WHERE cdf <= 0.05 / (SELECT count(*) FROM n) GROUP BY ALL),
x AS (SELECT DISTINCT rid FROM u JOIN b ON u.stratum = b.stratum WHERE share >= level)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x.rid IS NULL AS kept FROM f LEFT JOIN x USING (rid)
"""
