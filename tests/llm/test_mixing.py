import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.llm.queries import SQL


def filled(sizes, weights=(3.0, 1.0, 2.0), share=1.5, epochs=2.0):
    """Round by round: deal what is left by weight, clamp what exceeds its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > epochs * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_targets_are_those_of_rounds(spark):
    r = random.Random(1)
    for n in (1, 2, 7, 30):
        sizes = {f"s{i}" if i else None: r.choice([0, 1, 50, r.randint(1, 10_000)]) for i in range(n)}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = filled(sizes)
        assert {x.source: x.target for x in got} == pytest.approx(want)


def rows(n, r):
    return [(i, " ".join(["w"] * r.choice([0, 1, 5, 30, 200])) if r.random() < 0.95 else None, r.choice(["a", "b", "B", "é", "", None])) for i in range(n)]


def test_taken(spark):
    r = random.Random(2)
    data = [*rows(500, r), (None, "x y", "a"), (3, "a b c", "a"), (3, "a b c", "a")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    light = df.select("doc_id", "source", mixing.words_in("text").alias("size"))
    got = mixing.mix(light, F.col("size")).select("row.*", "size", "source_size", "target", "taken").collect()
    again = mixing.mix(light.repartition(7), F.col("size")).select("row.doc_id", "taken").collect()
    assert len(got) == len(data) and sorted((x.doc_id or -1, x.taken) for x in got) == sorted((x.doc_id or -1, x.taken) for x in again)
    by: dict = {}
    for x in got:
        assert 0 <= x.taken <= 2 * x[2]
        by.setdefault(x.source, []).append(x)
    for x in by.values():
        assert sum(y.taken for y in x) == pytest.approx(x[0].target, abs=1)
    assert sum(x[0].target for x in by.values()) == pytest.approx(1.5 * sum(x[0].source_size for x in by.values()))


def test_whole_rows_only(spark):
    r = random.Random(3)
    data = rows(400, r)
    df = spark.createDataFrame([(*x, "k") for x in data], "doc_id long, text string, source string, size string")
    out = mixing.repeated(df)
    assert out.columns == df.columns
    counts: dict = {}
    for x in out.collect():
        counts[x.doc_id] = counts.get(x.doc_id, 0) + 1
    assert max(counts.values()) <= 2 and all(data[i][1] for i in counts)
    sizes: dict = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = filled(sizes)
    for s in sizes:
        taken = sum(counts.get(i, 0) * len((t or "").split()) for i, t, x in data if x == s)
        assert abs(taken - want[s]) <= 200


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.repeated(df).count() == 0


def test_sql(spark, tmp_path):
    data = rows(300, random.Random(5))
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    df.write.parquet(os.path.join(tmp_path, "documents.parquet"))
    got = mixing.op6(spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = c.execute(SQL["op6_mixture"]).fetchall()
    assert sorted((x.doc_id, x.size, x.source_size, x.target, x.taken) for x in got) == sorted(want)
