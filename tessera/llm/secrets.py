"""Secrets in texts by a trigram inverted index: postings, candidates by Boolean trigram queries, verification. DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, table


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` (of a form that Java and Python read alike) whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base kinds.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Public formats of keys, whose spans are added to the base ones.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

#: Ways through a pattern that are told apart, and characters of a class that are tried one by one.
WAYS, WIDE = 64, 5


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of lower-case trigrams, one of which every match of ``pattern`` has in full; None if some match may have no trigram.

    The pattern is walked once, keeping for each way through it the last two characters, where they are known, and the trigrams
    met. Alternatives, options and small classes branch; wide classes and repetitions make what follows unknown. Sets that
    contain another are left out: the disjunction over the rest is implied.
    """
    ways = _walk(re._parser.parse(pattern), {("", frozenset())})
    sets = {t for _, t in ways}
    if frozenset() in sets:
        return None
    return sorted((t for t in sets if not any(u < t for u in sets)), key=sorted)


def _walk(nodes, ways: set) -> set:
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            ways = {_put(w, chr(arg)) for w in ways}
        elif name == "IN" and (chars := _small(arg)):
            ways = {_put(w, c) for w in ways for c in chars}
        elif name == "SUBPATTERN":
            ways = _walk(arg[3], ways)
        elif name == "BRANCH":
            ways = set().union(*(_walk(x, ways) for x in arg[1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            for _ in range(min(low, 3)):
                ways = _walk(inner, ways)
            if (low, high) == (0, 1):
                ways = ways | _walk(inner, ways)
            elif high > low or low > 3:
                ways = {("", t) for _, t in ways}
        elif name not in ("AT", "ASSERT", "ASSERT_NOT"):
            ways = {("", t) for _, t in ways}
        if len(ways) > WAYS:  # what all of them share is still mandatory
            ways = {("", frozenset.intersection(*(t for _, t in ways)))}
    return ways


def _put(way: tuple, char: str) -> tuple:
    last, met = way
    last += char.lower() if char.isascii() else char
    return last[-2:], met | {last} if len(last) == 3 else met


def _small(items) -> set[str]:
    chars: set[str] = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            chars.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < WIDE:
            chars |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return set()
    return chars if len(chars) <= WIDE else set()


def _before(lengths: Column, block: int = 256) -> Column:
    """For each of ``lengths`` (array<int>) the sum of those before it; by blocks, so that many don't take quadratic time."""
    none = F.array().cast("array<int>")

    def sums(a: Column, base: Column) -> Column:
        return F.aggregate(a, F.struct(base.cast("int").alias("s"), none.alias("out")), lambda x, n: F.struct((x["s"] + n).alias("s"), F.concat(x["out"], F.array(x["s"])).alias("out")), lambda x: x["out"])

    def blocks(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / block).cast("int")), lambda i: F.slice(a, i * block + 1, block))
        total = lambda p: F.aggregate(p, F.lit(0), lambda s, n: s + n)
        return let(parts, lambda p: let(sums(F.transform(p, total), F.lit(0)), lambda bases: F.flatten(F.zip_with(p, bases, sums))))

    return F.when(F.size(lengths) == 0, none).otherwise(let(lengths, blocks))


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of ``rule`` in ``text`` as an array of (start, rank, end), in code points, end exclusive."""
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    pattern = F.lit(rule.pattern)
    found = F.struct(lengths(F.split(text, rule.pattern)).alias("gaps"), lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("whole"), lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("part"))

    def placed(f: Column) -> Column:
        # A match starts after all gaps and matches before it and the gap at hand.
        steps = F.transform(f["whole"], lambda n, i: F.get(f["gaps"], i) + n)
        starts = F.zip_with(_before(steps), F.slice(f["gaps"], 1, F.size(f["whole"])), lambda b, g: b + g)
        each = F.arrays_zip(starts.alias("start"), f["whole"].alias("n"), f["part"].alias("part"))
        return F.transform(F.filter(each, lambda x: x["part"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + x["n"]).alias("end")))

    return let(found, placed)


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): for texts (key: xxhash64 of the text, text) the bits of the rules whose trigram queries they meet.

    Postings of every trigram that some query names go into an inverted index, (trigram, key), which is written. A clause's
    postings intersect at the keys that have as many of its trigrams as it has. Equal texts are one entry. Texts whose keys
    collide share their bits, so candidates are never lost, and verification tells them apart.
    """
    clauses = [(1 << i, c) for i, r in enumerate(rules) for c in trigram_query(r.pattern) or []]
    vocabulary = sorted({t for _, c in clauses for t in c})
    if not vocabulary:
        return texts.select("key", F.lit(0).cast("long").alias("rules")).where("false")
    # Lower case may turn further characters into ASCII ones, which adds candidates; it loses none.
    folded = texts.select("key", F.lower("text").alias("text"))
    named = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary)]))
    index = cut(folded.select("key", F.explode(named).alias("trigram")).distinct())
    asked = F.array(*[F.array(*[F.lit(i) for i, (_, c) in enumerate(clauses) if t in c]) for t in vocabulary])
    met = index.select("key", F.explode(F.get(asked, F.col("trigram"))).alias("clause")).groupBy("key", "clause").agg(F.count("*").alias("n"))
    whole = met.where(F.col("n") == F.get(F.array(*[F.lit(len(c)) for _, c in clauses]), F.col("clause")))
    return whole.groupBy("key").agg(F.bit_or(F.get(F.array(*[F.lit(b).cast("long") for b, _ in clauses]), F.col("clause"))).alias("rules"))


def _scanned(df: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(row: what ``df`` has, spans): nothing of ``df`` stands beside what the scan adds, so names can't clash."""
    rows = df.select(F.struct(*df.columns).alias("row"))
    body = F.coalesce(F.col("row")[text], F.lit(""))
    # Written, so that its size is known: few candidates are broadcast; for many, texts and candidates are joined by shuffle.
    found = cut(candidates(rows.select(F.xxhash64(body).alias("key"), body.alias("text")), rules))
    joined = rows.join(found, F.xxhash64(body) == F.col("key"), "left")
    none = F.array().cast("array<struct<start: int, rank: int, end: int>>")
    each = []
    for i, rule in enumerate(rules):
        asked = F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0 if trigram_query(rule.pattern) else body.rlike(rule.pattern)
        each.append(F.when(asked, spans(body, rule, i)).otherwise(none))
    return joined.select("row", F.array_sort(F.concat(*each)).alias("spans"))


def scan(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE, to: str = "spans") -> DataFrame:
    """``df`` with ``to``: array of (start, rank, end) of all rules' spans in ``text``, by start, then by the rule's rank.

    Rules with a trigram query are matched against its candidates only, the others against every text. A null text has no
    spans, nor has an empty one. Rows may repeat; other columns stay as they are, but one named ``to`` is replaced.
    """
    return _scanned(df, text, rules).select(*[F.col("row")[c].alias(c) for c in df.columns if c != to], F.col("spans").alias(to))


def listed(found: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"], x["end"])), ",")


def redacted(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """``df`` with every span in ``text`` replaced by its kind in brackets, one mask for each stretch of overlapping spans. Null stays null."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.col("row")[text]

    def step(x: Column, s: Column) -> Column:
        mask = F.when(s["start"] >= x["at"], F.concat(F.substring(whole, x["at"] + 1, s["start"] - x["at"]), F.lit("["), F.get(kinds, s["rank"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(x["at"], s["end"]).alias("at"), F.concat(x["out"], mask).alias("out"))

    masked = F.aggregate(F.col("spans"), start, step, lambda x: F.concat(x["out"], F.substring(whole, x["at"] + 1, F.lit(2**31 - 1))))
    new = F.when(F.size("spans") > 0, masked).otherwise(whole)
    return _scanned(df, text, rules).select(*[(new if c == text else F.col("row")[c]).alias(c) for c in df.columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base rules, a digest of their spans, and the spans of all rules, for every document."""
    rules, base = BASE + MORE, len(BASE)
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), rules=rules)
    number = lambda i: F.size(F.filter("spans", lambda x: x["rank"] == i)).cast("long")
    counts = [number(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(F.filter("spans", lambda x: x["rank"] < base), rules), 256).alias("base_sha256"), listed(F.col("spans"), rules).alias("spans"))


def op4_sql() -> str:
    """SQL for op4: gaps and matches of each rule, places by sums of their lengths."""
    each = []
    for i, r in enumerate(BASE + MORE):
        pattern = r.pattern.replace("'", "''")
        start = "list_sum(list_transform(g[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)::BIGINT"
        each.append(f"SELECT rid, {i} AS rank, '{r.kind}' AS kind, {start} AS s, {start} + len(m[i]) AS e FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS p FROM d WHERE regexp_matches(t, '{pattern}'))) WHERE len(p[i]) >= {r.least}")
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(each)}),
a AS (SELECT rid, {", ".join(f"count_if(rank = {i})::BIGINT AS n_{r.kind}" for i, r in enumerate(BASE))}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""
