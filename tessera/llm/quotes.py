"""Chat formatting by quotation linking: replies found by what they quote, conversations in reply order without quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.order import ranked
from ..plans.stage import discard
from .common import cut, let, table

MARK = r"^((?:[ \t]*>)+)[ \t]?"
WROTE = r"(?i)^(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
#: Characters of a passage, once normalised, from which it decides; shorter ones and excerpts tell where no such passage links.
SHORT = 12
#: What a passage is that links: an excerpt of one, a whole one that is shorter than SHORT, a whole one.
EXCERPT, BRIEF, WHOLE = 0, 1, 2
#: Characters by which excerpts are looked up, and those of words between spaces.
GRAM = 4
ALPHABET = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{N}]"
#: Messages of a thread that meet in one row of conversations().
PART = 10_000
#: Turns looked through at a time for the last one with a passage.
STEP = 256


def parsed(text: Column) -> Column:
    """Lines of ``text`` as an array of (level, line): the number of leading > signs, spaces between them allowed, and what follows."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARK, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, MARK, "").alias("line")))


def _at(lines: Column, level: Column | int) -> Column:
    """The lines of one level as a text; lines of other levels are blank in it."""
    return F.array_join(F.transform(lines, lambda x: F.when(x["level"] == level, x["line"]).otherwise("")), "\n")


def body(lines: Column) -> Column:
    """What isn't quoted, without the lines that announce a quotation right before it, and without blank lines at either end."""

    def own(a: Column) -> Column:
        def keep(x: Column, i: Column) -> Column:
            return (x["level"] == 0) & ~(x["line"].rlike(WROTE) & F.coalesce(F.get(a, i + 1)["level"] > 0, F.lit(False)))

        return F.array_join(F.transform(F.filter(a, keep), lambda x: x["line"]), "\n")

    return F.regexp_replace(let(lines, own), r"^\s+|\s+$", "")


def _normal(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def units(text: Column) -> Column:
    """Normalised passages of ``text``: its paragraphs, whatever their line breaks, and its lines; those that aren't empty, each once."""
    paragraphs = F.transform(F.split(text, r"\n\s*\n"), _normal)
    lines = F.transform(F.split(text, "\n"), _normal)
    return F.array_distinct(F.filter(F.concat(paragraphs, lines), lambda x: F.length(x) > 0))


def _each(df: DataFrame, array: Column, *more: Column) -> DataFrame:
    each = df.select("conv", "turn", *more, F.explode(array).alias("unit"))
    return each.select("conv", "turn", *[c for c in each.columns if c not in ("conv", "turn", "unit")], F.xxhash64("unit").alias("h"), F.hash("unit").alias("g"), F.length("unit").alias("n"), "unit")


def _last_before(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """``quoted`` (conv, turn, h, g, ...) with ``source``: the last turn of ``said`` before it with the passage; rows without one go.

    In steps of STEP turns: inside the step by a window over its turns, else from the steps before by a window over steps. So a
    passage that a third of all messages have takes no task that all of them go to.
    """
    on = ["conv", "h", "g"]
    step = lambda x: F.floor(F.col(x) / STEP)
    said = said.select(*on, F.col("turn").alias("said")).distinct().withColumn("step", step("said"))
    steps = said.groupBy(*on, "step").agg(F.max("said").alias("top"))
    asked = quoted.select(*on, "turn").distinct().withColumn("step", step("turn"))
    both = said.select(*on, "step", F.col("said").alias("turn"), F.lit(0).alias("asks"), F.col("said").alias("own")).unionByName(asked.select(*on, "step", "turn", F.lit(1).alias("asks"), F.lit(None).cast("long").alias("own")))
    inside = Window.partitionBy(*on, "step").orderBy("turn", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("own").over(inside)).where("asks = 1").select(*on, "step", "turn", "near")
    over = Window.partitionBy(*on).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    known = asked.select(*on, "step").distinct().join(steps, [*on, "step"], "full").withColumn("far", F.max("top").over(over)).select(*on, "step", "far")
    source = near.join(cut(known), [*on, "step"], "left").select(*on, "turn", F.coalesce("near", "far").alias("source")).where("source is not null")
    return quoted.join(cut(source), [*on, "turn"])


def _excerpts(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Which messages have a passage of ``asked`` (conv, unit, h, g) as a part: (conv, turn, h, g).

    Texts meet by the hashed characters that begin a passage, GRAM or all it has, at every place of a text, and the whole is compared
    then. A part neither begins nor ends inside a word of an alphabet.
    """
    gram = lambda k: lambda i: F.xxhash64(F.substring(F.col("said"), i, F.lit(k)))
    grams = F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.length("said") - k + 1, F.lit(1))), gram(k)) for k in range(1, GRAM + 1)]))
    asked = asked.select("conv", "unit", "h", "g", F.xxhash64(F.substring("unit", 1, GRAM)).alias("gram")).distinct()
    said = rows.join(asked.select("conv").distinct(), "conv", "left_semi").select("conv", "turn", _normal(F.col("own")).alias("said"))
    each = said.select("conv", "turn", "said", F.explode(F.array_distinct(grams)).alias("gram"))
    # Units are in lower case, so that none has the \\E that ends a quotation.
    part = F.rlike("said", F.concat(F.lit(rf"(?<!{ALPHABET})\Q"), "unit", F.lit(rf"\E(?!{ALPHABET})")))
    return each.join(asked, ["conv", "gram"]).where(F.contains("said", "unit") & part).select("conv", "turn", "h", "g").distinct()


def _elsewhere(quoted: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, turn, reply_conv, reply_to) of messages that quote nothing of their own conversation, but SHORT characters or more of a
    message of an earlier one: of all that say the passage, the first in the order of conversations and turns."""
    asked = cut(quoted.where(F.col("n") >= SHORT).join(found.select("conv", "turn").distinct(), ["conv", "turn"], "left_anti"))
    said = _each(rows, units(F.col("own"))).join(cut(asked.select("h", "g").distinct()), ["h", "g"], "left_semi")
    origin = cut(said.groupBy("h", "g").agg(F.min(F.struct("conv", "turn")).alias("source")))
    known = asked.join(origin, ["h", "g"]).where(F.col("source.conv") < F.col("conv"))
    tally = known.groupBy("conv", "turn", "level", "source").agg(F.sum("n").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("level"), "n", "source"))["source"]
    return tally.groupBy("conv", "turn").agg(best.alias("source")).select("conv", "turn", F.col("source.conv").alias("reply_conv"), F.col("source.turn").alias("reply_to"))


def replies(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, reply_conv, reply_to): the earlier message that a message quotes most of, in characters; the later of equals.

    Quoted lines are parsed into levels. Passages at the least level that has a source tell: level 1 quotes the message that is
    answered, deeper ones what that one quoted. Every passage goes to the last message of the conversation before that says it
    itself, outside quotes, by hashes of the normalised text (96 bits). At a level, passages of SHORT characters decide, then
    shorter ones, then parts of what a message says. If nothing of the conversation is quoted, passages of SHORT characters go
    to the first message of an earlier conversation that says them. Messages with a null conversation or turn have no reply.
    """
    rows = messages.where(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), parsed(F.col(text)).alias("lines")).withColumn("own", body(F.col("lines")))
    quoting = rows.where(F.exists("lines", lambda x: x["level"] > 0))
    levels = quoting.select("conv", "turn", "lines", F.explode(F.array_distinct(F.filter(F.transform("lines", lambda x: x["level"]), lambda x: x > 0))).alias("level"))
    quoted = cut(_each(levels, units(_at(F.col("lines"), F.col("level"))), F.col("level")))
    # Only passages that some message quotes are looked for.
    said = _each(rows, units(F.col("own"))).join(cut(quoted.select("conv", "h", "g").distinct()), ["conv", "h", "g"], "left_semi")
    found = cut(_last_before(quoted, cut(said.select("conv", "turn", "h", "g"))).withColumn("kind", F.when(F.col("n") >= SHORT, WHOLE).otherwise(BRIEF)))
    # Levels none of whose passages some message says as a whole: they may be parts of one.
    part = cut(quoted.join(found.select("conv", "turn", "level").distinct(), ["conv", "turn", "level"], "left_anti"))
    if not part.isEmpty():
        found = found.unionByName(_last_before(part, cut(_excerpts(part, rows))).withColumn("kind", F.lit(EXCERPT)))
    tally = found.groupBy("conv", "turn", "level", "kind", "source").agg(F.sum("n").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("level"), "kind", "n", "source"))
    inside = cut(tally.groupBy("conv", "turn").agg(best["source"].alias("reply_to")).select("conv", "turn", F.col("conv").alias("reply_conv"), "reply_to"))
    return inside if part.isEmpty() else inside.unionByName(_elsewhere(quoted, rows, inside))


def threads(links: DataFrame) -> DataFrame:
    """(conv, turn, reply_conv, reply_to, root_conv, root, depth) from replies to earlier messages: pointers are doubled until all reach
    a root, in log(depth) rounds."""
    links = links.select("conv", "turn", "reply_conv", "reply_to")
    now = cut(links.select("*", F.col("reply_conv").alias("root_conv"), F.col("reply_to").alias("root"), F.lit(1).alias("depth"), F.lit(False).alias("done")))
    while True:
        jump = now.select(F.col("conv").alias("root_conv"), F.col("turn").alias("root"), F.col("root_conv").alias("next_conv"), F.col("root").alias("next"), F.col("depth").alias("more"))
        far = now.join(jump, ["root_conv", "root"], "left")
        after = cut(far.select(*links.columns, F.coalesce("next_conv", "root_conv").alias("root_conv"), F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNull().alias("done")))
        discard(now)
        now = after
        if now.where("not done").isEmpty():
            return now.drop("done")


def positions(tree: DataFrame) -> DataFrame:
    """(conv, turn, position) of all messages of threads(): 0 for a root, then every message right after the one it answers and what was
    said below that, answers to one message in the order of conversations and turns.

    A thread is walked down into every message and up again; where each step leads is known from a message's first answer, the next
    answer to the same message, and the message above. Steps are doubled until all end, in log(messages of a thread) rounds, so
    neither a long chain nor a message with very many answers meets in one task.
    """
    parents = tree.select(F.col("reply_conv").alias("conv"), F.col("reply_to").alias("turn"))
    nodes = cut(ranked(tree.select("conv", "turn").unionByName(parents).distinct(), ["conv", "turn"], "id").df.select("conv", "turn", F.col("id").cast("long").alias("id")))
    child = nodes.select(F.col("conv"), F.col("turn"), F.col("id").alias("child"))
    parent = nodes.select(F.col("conv").alias("reply_conv"), F.col("turn").alias("reply_to"), F.col("id").alias("parent"))
    edges = cut(tree.select("conv", "turn", "reply_conv", "reply_to").join(child, ["conv", "turn"]).join(parent, ["reply_conv", "reply_to"]).select("parent", "child"))
    row = cut(ranked(edges, ["parent", "child"], "place").df.select("parent", "child", "place"))
    beside = row.select(F.col("parent"), (F.col("place") - 1).alias("place"), F.col("child").alias("beside"))
    first = edges.groupBy("parent").agg(F.min("child").alias("first"))
    # Steps 2 id (down into a message) and 2 id + 1 (up from it).
    down = nodes.join(first.withColumnRenamed("parent", "id"), "id", "left").select((2 * F.col("id")).alias("step"), F.coalesce(2 * F.col("first"), 2 * F.col("id") + 1).alias("next"), F.lit(1).cast("long").alias("left"))
    up = row.join(beside, ["parent", "place"], "left").select((2 * F.col("child") + 1).alias("step"), F.coalesce(2 * F.col("beside"), 2 * F.col("parent") + 1).alias("next"), F.lit(0).cast("long").alias("left"))
    now = cut(down.unionByName(up))
    while True:
        jump = now.select(F.col("step").alias("next"), F.col("next").alias("far"), F.col("left").alias("more"))
        after = cut(now.join(jump, "next", "left").select("step", F.col("far").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
        discard(now)
        now = after
        if now.where("next is not null").isEmpty():
            break
    # What is left from a message on, itself included; a root has all of its thread before it.
    left = cut(now.where("step % 2 = 0").select((F.col("step") / 2).cast("long").alias("id"), "left").join(nodes, "id").select("conv", "turn", "left"))
    whole = left.select(F.col("conv").alias("root_conv"), F.col("turn").alias("root"), F.col("left").alias("all"))
    below = tree.select("conv", "turn", "root_conv", "root").join(left, ["conv", "turn"]).join(whole, ["root_conv", "root"])
    roots = tree.select(F.col("root_conv").alias("conv"), F.col("root").alias("turn")).distinct().select("conv", "turn", F.lit(0).cast("long").alias("position"))
    return below.select("conv", "turn", (F.col("all") - F.col("left")).alias("position")).unionByName(roots)


def formatted(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every message as (``conv``, ``turn``, ``role``, reply_conv, reply_to, root_conv, root, depth, position, content, formatted): in reply
    order by root_conv, root and position, every answer below what it answers.

    content is the text without quotes, formatted the same after a line that names the role; a null text gives empty content, a
    null role `user`. A message that quotes nothing known is a root: its own root, depth and position 0. Rows that repeat a
    turn are all kept and share reply, root and position. Other columns of ``messages`` don't matter, whatever their names.
    """
    links = cut(replies(messages, conv, turn, text))
    own = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), body(parsed(F.col(text))).alias("content"))
    if links.isEmpty():
        kind = dict(links.dtypes)["conv"]
        nothing = {"reply_conv": kind, "reply_to": "long", "root_conv": kind, "root": "long", "depth": "int", "position": "long"}
        joined = own.withColumns({k: F.lit(None).cast(t) for k, t in nothing.items()})
    else:
        tree = cut(threads(links))
        joined = own.join(tree, ["conv", "turn"], "left").join(cut(positions(tree)), ["conv", "turn"], "left")
    shown = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("content"))
    place = [F.coalesce("root_conv", "conv").alias("root_conv"), F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("position", F.lit(0).cast("long")).alias("position")]
    return joined.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), "reply_conv", "reply_to", *place, "content", shown.alias("formatted"))


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(root_conv, root, part, messages): threads as arrays of (position, role, content) in reply order, PART places a row, so that no thread
    is too long for a row. Messages without a conversation or turn aren't in any."""
    rows = formatted(messages, conv, turn, role, text).where(F.col(conv).isNotNull() & F.col(turn).isNotNull())
    said = F.array_sort(F.collect_list(F.struct("position", F.coalesce(role, F.lit("user")).alias("role"), "content")))
    return rows.groupBy("root_conv", "root", F.floor(F.col("position") / PART).alias("part")).agg(said.alias("messages"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As formatted(), with -1 for no reply."""
    none = F.lit(-1).cast("long")
    return formatted(table(spark, sf_dir, "conversations")).withColumns({c: F.coalesce(c, none) for c in ("reply_conv", "reply_to")})


_NORMAL = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_UNITS = rf"list_distinct(list_filter(list_concat(list_transform(string_split_regex({{0}}, '\n\s*\n'), lambda x: {_NORMAL.format('x')}), list_transform(string_split({{0}}, chr(10)), lambda x: {_NORMAL.format('x')})), lambda x: len(x) > 0))"
_OTHER = r"[^\p{Latin}\p{Cyrillic}\p{Greek}\p{N}]"

#: SQL for op1: passages are compared themselves, threads walked link by link.
OP1_SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn::BIGINT AS turn, role, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM conversations),
l AS (SELECT rid, conv_id, turn, i, len(regexp_replace(regexp_extract(ls[i], '{MARK}', 1), '[^>]', '', 'g')) AS level, regexp_replace(ls[i], '{MARK}', '') AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM m)),
k AS (SELECT *, lead(level) OVER (PARTITION BY rid ORDER BY i) AS next FROM l),
b AS (SELECT rid, regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (regexp_matches(line, '{WROTE}') AND coalesce(next, 0) > 0)), ''), '^\s+', ''), '\s+$', '') AS content FROM k GROUP BY rid),
v AS (SELECT a.rid, a.conv_id, a.turn, a.level, string_agg(CASE WHEN l.level = a.level THEN l.line ELSE '' END, chr(10) ORDER BY l.i) AS t FROM (SELECT DISTINCT rid, conv_id, turn, level FROM l WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL) a JOIN l USING (rid) GROUP BY ALL),
q AS (SELECT conv_id, turn, level, unnest({_UNITS.format("t")}) AS unit FROM v),
s AS (SELECT DISTINCT conv_id, turn, unnest({_UNITS.format("content")}) AS unit FROM b JOIN m USING (rid) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
f AS (SELECT q.conv_id, q.turn, q.level, q.unit, max(s.turn) AS source, CASE WHEN len(q.unit) >= {SHORT} THEN {WHOLE} ELSE {BRIEF} END AS kind, count(DISTINCT s.turn) AS d FROM q JOIN s ON q.conv_id = s.conv_id AND q.unit = s.unit AND s.turn < q.turn GROUP BY ALL),
y AS (SELECT conv_id, turn, {_NORMAL.format("content")} AS said FROM b JOIN m USING (rid)),
x AS (SELECT q.conv_id, q.turn, q.level, q.unit, max(y.turn) AS source, {EXCERPT} AS kind, 0 AS d FROM q ANTI JOIN f ON q.conv_id = f.conv_id AND q.turn = f.turn AND q.level = f.level
JOIN y ON q.conv_id = y.conv_id AND y.turn < q.turn AND contains(y.said, q.unit) AND regexp_matches(y.said, '(^|{_OTHER})' || regexp_escape(q.unit) || '($|{_OTHER})') GROUP BY ALL),
p0 AS (SELECT conv_id, turn, arg_max(source, (-level, kind, n, source)) AS reply_to FROM (SELECT conv_id, turn, level, kind, source, sum(len(unit)) AS n FROM (SELECT * FROM f UNION ALL SELECT * FROM x) GROUP BY ALL) GROUP BY ALL),
o AS (SELECT unit, min((conv_id, turn)) AS source FROM s GROUP BY unit),
p1 AS (SELECT conv_id, turn, arg_max(source, (-level, n, source)) AS source FROM (SELECT q.conv_id, q.turn, level, o.source, sum(len(q.unit)) AS n FROM q ANTI JOIN p0 ON q.conv_id = p0.conv_id AND q.turn = p0.turn JOIN o USING (unit) WHERE len(q.unit) >= {SHORT} AND o.source[1] < q.conv_id GROUP BY ALL) GROUP BY ALL),
p AS (SELECT conv_id, turn, conv_id AS reply_conv, reply_to FROM p0 UNION ALL SELECT conv_id, turn, source[1], source[2] FROM p1),
r AS (SELECT conv_id, turn, reply_conv AS root_conv, reply_to AS root, 1 AS depth, [(conv_id, turn)] AS path FROM p UNION ALL SELECT r.conv_id, r.turn, p.reply_conv, p.reply_to, depth + 1, list_concat([(p.conv_id, p.turn)], path) FROM r JOIN p ON p.conv_id = r.root_conv AND p.turn = r.root),
t AS (SELECT *, row_number() OVER (PARTITION BY root_conv, root ORDER BY path) AS position FROM (SELECT conv_id, turn, arg_max(root_conv, depth) AS root_conv, arg_max(root, depth) AS root, max(depth)::INT AS depth, arg_max(path, depth) AS path FROM r GROUP BY conv_id, turn))
SELECT conv_id, turn, role, coalesce(reply_conv, -1)::BIGINT AS reply_conv, coalesce(reply_to, -1)::BIGINT AS reply_to, coalesce(root_conv, conv_id) AS root_conv, coalesce(root, turn) AS root, coalesce(depth, 0)::INT AS depth, coalesce(position, 0)::BIGINT AS position,
content, '<|' || coalesce(role, 'user') || '|>' || chr(10) || content AS formatted FROM m JOIN b USING (rid) LEFT JOIN p USING (conv_id, turn) LEFT JOIN t USING (conv_id, turn)
"""
