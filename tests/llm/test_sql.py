"""The queries against their SQL, on fixtures that the standard tables don't have."""

import random

import duckdb
import pytest

from tessera.llm.queries import QUERIES, SQL

A, B, C = "Where shall we meet tomorrow?", "At the station, I should think.\nOr at the bridge.", "The bridge is closed this week."


def quote(text):
    return "\n".join("> " + x for x in text.split("\n"))


def conversations(r):
    rows = [(1, 0, "user", A), (1, 1, "assistant", f"{quote(A)}\n{B}"), (1, 2, "user", f"{quote(quote(A))}\n{quote(B)}\n\n{C}"), (1, 3, "user", "> WHERE shall we\n>   meet tomorrow?\nOn time."), (1, 4, "user", f">> {A}\nDeeper."), (1, 5, None, None), (2, 0, "user", f"> {A}\nElsewhere.")]
    # Short passages, parts of lines, other scripts, deeper levels, chains and other conversations.
    rows += [(3, 0, "user", "Sounds good"), (3, 1, "user", f"ok\n{C}"), (3, 2, None, "我们明天见面吧。"), (3, 3, "user", "> Sounds good\na"), (3, 4, "user", "> ok\nb"), (3, 5, "user", "> 我们明天见面吧。\nc"), (3, 6, "user", "> The bridge is closed\nd"), (3, 7, "user", "> is\n>> Sounds good\ne"), (3, 8, "user", "> his (a+b)*\nf"), (3, 9, "user", ">>> Sounds good\n>> ok\n> b\n\nlast (a+b)* one"), (3, 10, "user", "> last (a+b)*\ng")]
    say = [f"This is sentence number {i} of all." for i in range(30)]
    for conv in (4, 5):
        rows += [(conv, i, "user", f"> {say[r.randrange(30)]}\n> > {say[r.randrange(30)]}\n{say[(i * 7 + conv) % 30]}") for i in range(40)]
    return [("conversations", "conv_id long, turn int, role string, text string", rows)]


def documents(r):
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    plain = [" ".join(word() for _ in range(30)) for _ in range(2600)]
    junk = [" ".join(word() + "***" for _ in range(30)) for _ in range(60)]
    line = " ".join(word() for _ in range(12))
    odd = [None, "", "short", f"{line}\n{line}\n \n{line} x", "token=" + "f" * 30 + " AKIA" + "B" * 16 + " é xoxb-1234567890ab", " ".join([line] * 3), "-----BEGIN RSA PRIVATE KEY----- token: abc password='secret9'"]
    texts = plain + junk + odd
    rows = [(i, t, r.choice(["en", "en", None])) for i, t in enumerate(texts)]
    labels = [(i, int(i < len(plain))) for i in range(len(plain) + len(junk))] + [(None, 1), (1, 0), (2, None)]
    return [("documents", "doc_id long, text string, lang string", rows), ("labels", "doc_id long, quality int", labels)]


def embeddings(r):
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.08) for x in base[i % 12]], i % 3) for i in range(90)]
    rows += [(90, None, 0), (91, [0.0] * 8, 0), (92, base[0], None), (93, rows[0][1], 0), (94, [float("inf")] + [1.0] * 7, 0)]
    return [("embeddings", "vec_id long, embedding array<float>, label int", rows)]


@pytest.mark.parametrize(("name", "tables"), [("op1_quote_linking", conversations), ("op4_trigram_secrets", documents), ("op5_quality_rules", documents), ("op7_epsilon_grid", embeddings)])
def test_query_and_sql_agree(spark, tmp_path, name, tables):
    db = duckdb.connect()
    for table, kind, rows in tables(random.Random(3)):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{table}.parquet")
        db.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = QUERIES[name](spark, str(tmp_path))
    want = db.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(x) for x in got.select(*columns).collect()]
    order = lambda row: tuple((v is None, v) for v in row)
    assert sorted(rows, key=order) == sorted(want.fetchall(), key=order)
    if name == "op5_quality_rules":
        kept = {x["doc_id"]: x["kept"] for x in got.collect()}
        # All good texts stay; bad ones go in the language that has labels enough to certify a cutoff.
        assert all(kept[i] for i in range(2600)) and sum(not kept[i] for i in range(2600, 2660)) > 25
