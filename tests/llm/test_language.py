import random
import zlib

from tessera.llm import language
from tessera.llm.common import held_out

SYLLABLES = {"en": "the ing th er on", "de": "sch ung ein ver ich", "fr": "eau oi ent que é", "es": "ción ado ll mente o", "xx": "zq zk qq"}


def text_of(lang, r, n=40):
    return " ".join("".join(r.choices(SYLLABLES[lang].split(), k=3)) for _ in range(n))


def test_held_out_accuracy_and_contract(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, text_of(lang, r), lang) for i, lang in enumerate(r.choices(list(SYLLABLES), k=600))]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !!", "fr"), (1003, text_of("fr", r), None), (None, text_of("de", r), "de"), (1004, text_of("es", r, 20_000), "es"), (7, rows[7][1], rows[7][2])]
    spark.createDataFrame([(*x, "s", "k") for x in rows], "doc_id long, text string, lang string, source string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    got = language.op8(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    truth = {i: lang for i, _, lang in rows}
    for x in got:
        assert 0 <= x.score <= 1
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
    held = [x for x in got if x.held_out and x.doc_id < 1000]
    assert len(held) > 80 and sum(x.lang_pred == truth[x.doc_id] for x in held) >= 0.98 * len(held)
    pred = {x.doc_id: x.lang_pred for x in got}
    assert pred[1000] == pred[1001] == pred[1002] == "und" and pred[1003] == "fr" and pred[1004] == "es"


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert language.fit(df) is None
    assert {x.lang_pred for x in language.identified(df, None).collect()} == {"und"}
    assert df.where(held_out("doc_id")).count() <= 2


def test_chunks_of_long_texts_count_the_same(monkeypatch):
    text = text_of("de", random.Random(3), 500) + " Ж😀"
    whole = language.features(text)
    monkeypatch.setattr(language, "CHUNK", 37)
    assert abs(language.features(text) - whole).max() < 1e-12


def test_every_language_is_learned(spark, monkeypatch):
    """Few rows altogether: each of many languages gives LEAST_ROWS or all it has, whatever the most frequent one has."""
    monkeypatch.setattr(language, "LEAST_ROWS", 3)
    r = random.Random(5)
    own = {f"l{k}": [f"{chr(97 + k)}{c}" for c in "aeiou"] for k in range(12)}
    rows = [(i, " ".join(r.choices(own["l0"], k=30)), "l0") for i in range(1500)]
    rows += [(10_000 + 10 * k + j, " ".join(r.choices(own[f"l{k}"], k=30)), f"l{k}") for k in range(1, 12) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, most=12)
    assert set(model.within["other"].classes) == set(own)
    got = language.identified(df.where("doc_id >= 10000").withColumn("lang_pred", df["doc_id"]), model).collect()
    assert sum(x.lang_pred == x.lang for x in got) >= 20
    assert language.identified(df.limit(0), model).count() == 0
