import random

import corpus_pipeline
from tessera.llm import simhash
from tessera.llm.bpe import Bpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(r):
    word = lambda: "".join(r.choices("abcdefghijk", k=5))
    rows = [(i, " ".join(word() for _ in range(60)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1") for i in range(5)]
    rows += [(200, "too short", "en", "s1"), (201, None, None, None), (202, "", "en", "s2"), (203, rows[9][1] + " AKIA" + "Q" * 16, "en", "s0")]
    return [(*x, None if x[1] is None else len(x[1])) for x in rows]


def test_stages(spark, tmp_path):
    rows = documents(random.Random(1))
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scans", "mixing", "bpe"]
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [sorted(x.doc_id for x in d.collect()) for d in seen]
    assert ids[0] == [*range(60), *range(100, 105), 203]
    fps = {i: simhash.fingerprint(t) for i, t, *_ in rows}
    assert ids[1] == [i for i in ids[0] if not any(j < i and (fps[i] ^ fps[j]).bit_count() <= 2 for j in ids[0])]
    assert ids[2] == ids[1]
    for x in seen[2].collect():
        assert "AKIA" not in x.text and x.n_chars == len(x.text)
    assert set(ids[3]) <= set(ids[2]) and max(map(ids[3].count, ids[3])) <= 2
    bpe, texts = Bpe(), {x.doc_id: x.text for x in seen[3].collect()}
    for x in seen[4].collect():
        assert list(x.ids) == bpe.tokenizer.encode(texts[x.doc_id], add_special_tokens=False).ids and x.n_tokens == len(x.ids) and x.intact


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_and_repeated_rows(spark, tmp_path):
    """What documents have besides passes through the stages but the last as it is, whatever its name; nulls in any column, too."""
    names = ["row", "kept", "level", "__gone", "spans", "__spans", "size", "k", "p", "base_failed", "stratum", "id", "fp", "rules", "__key"]
    rows = [(*x, *[f"{n}{x[0]}" for n in names]) for x in documents(random.Random(2))]
    rows += [rows[3], rows[3], (None, rows[5][1], None, None, None, *[None] * len(names))]
    df = spark.createDataFrame(rows, COLUMNS + "".join(f", {n} string" for n in names))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == df.columns
        for x in docs.collect():
            assert all(x[n] == (None if x.doc_id is None else f"{n}{x.doc_id}") for n in names)
        if name == "near_dedup":
            ids = [x.doc_id for x in docs.collect()]
            assert ids.count(3) == 3 and ids.count(None) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
