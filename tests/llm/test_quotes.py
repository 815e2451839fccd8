import random

from pyspark.sql import functions as F

from tessera.llm import quotes

KIND = "conv_id long, turn int, role string, text string"


def test_parsing(spark):
    text = "Hello\n> one\n>> two\n> > three\n  > four\nOn Monday Ann wrote:\n> five\nOn Monday nobody wrote:\n\nbye\n"
    row = spark.createDataFrame([(text,)], "t string").select(quotes.parsed(F.col("t")).alias("lines"), quotes.body(quotes.parsed(F.col("t"))).alias("body")).first()
    assert [(x.level, x.line) for x in row.lines if x.level] == [(1, "one"), (2, "two"), (2, "three"), (1, "four"), (1, "five")]
    assert row.body == "Hello\nOn Monday nobody wrote:\n\nbye"


def quote(text, level=1):
    return "\n".join(">" * level + " " + x for x in text.split("\n"))


def test_replies_in_order(spark):
    a, b, c = "Where shall we meet tomorrow?", "At the station, I should think.\nOr at the bridge.", "The bridge is closed this week."
    rows = [
        (1, 0, "user", a),
        (1, 1, "assistant", f"{quote(a)}\n{b}"),
        (1, 2, "user", f"{quote(quote(a))}\n{quote(b)}\n\n{c}"),
        (1, 3, "user", f"> WHERE shall we\n>   meet tomorrow?\nOn time, anyway."),  # another line break and case
        (1, 4, "user", f">> {a}\nNo quote of level 1."),
        (1, 5, None, None),
        (1, 6, "user", "> something nobody said before\nYes."),
        (2, 0, "user", f"> {a}\nOther conversation."),
        (None, 1, "user", f"> {a}\nx"),
        (1, None, "user", "y"),
        (1, 1, "assistant", f"{quote(a)}\n{b}"),  # repeated row
    ]
    got = quotes.formatted(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == len(rows)
    at = {(x.conv_id, x.turn): x for x in got}
    assert {k[1]: (v.reply_to, v.root, v.depth) for k, v in at.items() if k[0] == 1 and k[1] is not None} == {0: (None, 0, 0), 1: (0, 0, 1), 2: (1, 0, 2), 3: (0, 0, 1), 4: (0, 0, 1), 5: (None, 5, 0), 6: (None, 6, 0)}
    # Said in no earlier message of its conversation, but in an earlier conversation.
    assert (at[2, 0].reply_conv, at[2, 0].reply_to, at[2, 0].root_conv, at[2, 0].root, at[2, 0].depth) == (1, 0, 1, 0, 1) and at[None, 1].reply_to is None
    assert [k for k, v in sorted(at.items(), key=lambda x: x[1].position) if (v.root_conv, v.root) == (1, 0)] == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0)]
    assert at[1, 2].content == c and at[1, 2].formatted == f"<|user|>\n{c}" and at[1, 5].formatted == "<|user|>\n"
    assert not any(line.startswith(">") for x in got for line in x.content.split("\n"))


def test_short_passages_and_excerpts(spark):
    long = "The bridge is closed this week."
    rows = [
        (1, 0, "user", "Sounds good"),
        (1, 1, "user", f"ok\n{long}"),
        (1, 2, "user", "我们明天见面吧。"),
        (1, 3, "user", "> Sounds good\na"),
        (1, 4, "user", "> ok\nb"),
        (1, 5, "user", "> 我们明天见面吧。\nc"),
        (1, 6, "user", "> The bridge is closed\nd"),
        (1, 7, "user", "> ok\nHere it is."),
        (1, 8, "user", f"> ok\n> {long}\ne"),
        (1, 9, "user", "> here\nf"),
        (1, 10, "user", "> The bridge is open\ng"),
        (1, 11, "user", "> is\nh"),  # of words, not of what is in "this"
        (1, 12, "user", "> his\ni"),
        (1, 13, "user", "> 明天\nj"),
    ]
    got = {x.turn: x.reply_to for x in quotes.replies(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {3: 0, 4: 1, 5: 2, 6: 1, 7: 1, 8: 1, 9: 7, 11: 7, 13: 2}


def test_last_source_before_against_brute_force(spark):
    r = random.Random(2)
    lines = [f"passage number {i} of all" for i in range(6)]
    rows = []
    for conv in range(3):
        for turn in r.sample(range(2000), 150):
            own, cited = r.choice(lines), r.choice([None, *lines])
            rows.append((conv, turn, "user", f"{'> ' + cited + chr(10) if cited else ''}{own}"))
    got = {(x.conv, x.turn): (x.reply_conv, x.reply_to) for x in quotes.replies(spark.createDataFrame(rows, KIND)).collect()}
    for conv, turn, _, text in rows:
        said = [(c, t) for c, t, _, x in rows if text.startswith("> " + x.split("\n")[-1] + "\n")]
        inside, elsewhere = [k for k in said if k[0] == conv and k[1] < turn], [k for k in said if k[0] < conv]
        assert got.get((conv, turn)) == (max(inside) if inside else min(elsewhere, default=None))


def test_long_chain(spark):
    say = [f"This is message number {i}." for i in range(70)]
    rows = [(1, i, "user", (f"> {say[i - 1]}\n" if i else "") + say[i]) for i in range(70)]
    got = quotes.formatted(spark.createDataFrame(rows, KIND)).collect()
    assert {x.turn: (x.root, x.depth, x.position) for x in got} == {i: (0, i, i) for i in range(70)}


def test_empty(spark):
    assert quotes.formatted(spark.createDataFrame([], KIND + ", depth string")).count() == 0


def test_reply_order_against_recursion(spark):
    """Random trees over conversations: positions are those of a walk, and conversations() has the messages in that order."""
    r = random.Random(8)
    parent = {}
    for conv in range(4):
        for turn in range(25):
            before = [k for k in parent if k[0] == conv] + ([(r.randrange(conv), 3)] if conv else [])
            parent[conv, turn] = r.choice(before) if before and r.random() < 0.85 else None
    say = {k: f"This is what {k[0]} says at turn {k[1]} here." for k in parent}
    rows = [(*k, "user", (f"> {say[p]}\n" if p else "") + say[k]) for k, p in parent.items()]
    df = spark.createDataFrame(rows, KIND + "").repartition(3)
    got = {(x.conv_id, x.turn): x for x in quotes.formatted(df.withColumn("position", F.lit("x")).withColumn("root", F.lit(1))).collect()}
    assert {k: (x.reply_conv, x.reply_to) if x.reply_to is not None else None for k, x in got.items()} == parent
    walked = []

    def walk(k, top):
        walked.append((top, k))
        for child in sorted(c for c, p in parent.items() if p == k):
            walk(child, top)

    for k in sorted(k for k, p in parent.items() if p is None):
        walk(k, k)
    order = sorted(got, key=lambda k: (got[k].root_conv, got[k].root, got[k].position))
    assert [((got[k].root_conv, got[k].root), k) for k in order] == walked
    threads = quotes.conversations(df).orderBy("root_conv", "root").collect()
    assert [m.content for t in threads for m in t.messages] == [say[k] for _, k in walked]


def test_very_long_texts_and_ties(spark):
    """Of equal sources the last; a quoted text of 100,000 lines is one."""
    long = "\n".join(f"line {i} of a very long message" for i in range(100_000))
    rows = [(1, 0, "user", long), (1, 1, "user", "Twice the same sentence."), (1, 2, "user", "Twice the same sentence."), (1, 3, "user", quote(long) + "\nyes"), (1, 4, "user", "> Twice the same sentence.\nno")]
    assert {x.turn: x.reply_to for x in quotes.replies(spark.createDataFrame(rows, KIND)).collect()} == {3: 0, 4: 2}
