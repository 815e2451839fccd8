import random

import numpy as np

from tessera.llm import toxicity

CLEAN = "lamp river stone cloud table window garden bread paper music road light".split()
STEMS = "grubbish snarlow".split()


def doc(r, toxic, n=60):
    words = r.choices(CLEAN, k=n)
    for _ in range(4 if toxic else 0):
        words[r.randrange(n)] = r.choice(["idiot", r.choice(STEMS) + r.choice(["er", "ing", "ly"])])
    return " ".join(words)


def test_held_out_documents(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, doc(r, i % 6 == 0)) for i in range(900)]
    extra = [(5000, None), (5001, ""), (5002, "%%% !!!"), (None, doc(r, True)), (5003, doc(r, False, 30_000))]
    spark.createDataFrame([(*x, "k") for x in rows + extra], "doc_id long, text string, predicted string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 6 == 0)) for i, _ in rows] + [(None, 1), (5, None), (6, 1), (6, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.op10(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 900]
    assert np.mean([x.predicted == int(x.doc_id % 6 == 0) for x in held]) > 0.97
    assert not any(x.predicted for x in got if x.doc_id in (5000, 5001, 5002, 5003))


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")) is None
    assert toxicity.scored(docs, None).first().score == 0.0


def test_isotonic_is_the_best_monotone_fit():
    r = np.random.default_rng(0)
    x, w = np.sort(r.normal(size=40)), r.uniform(0.5, 2, 40)
    y = (r.uniform(size=40) < 1 / (1 + np.exp(-2 * x))).astype(float)
    knots, values = toxicity.isotonic(x, y, w)
    fit = np.interp(x, knots, values)
    assert (np.diff(fit) >= -1e-12).all()
    # Min-max formula of isotonic regression.
    for i in range(40):
        best = max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 40)) for a in range(i + 1))
        assert abs(best - fit[i]) < 1e-9


def test_boosting_finds_an_interaction():
    r = np.random.default_rng(1)
    x = r.uniform(size=(2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = toxicity.Boosted().fit(x[:1500], y[:1500], np.ones(1500))
    assert ((model.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_features():
    lexicon = toxicity.Lexicon({"snar*": 2.0})
    row = dict(zip(toxicity.NAMES, toxicity.features("You IDIOT! snarlow id1ot ok", lexicon), strict=True))
    assert row["seed"] > 0 and row["learned"] > 0 and row["near_you"] > 0 and row["shouts"] > 0 and row["hidden"] > 0
    assert set(toxicity.features(None, lexicon)) == {0.0}


def test_clashing_columns_ties_and_empty_tables(spark):
    learned = toxicity.Lexicon({"snarl*": 2.0})
    model = toxicity.Model(learned, toxicity.Boosted(), (np.array([-1.0, 1.0]), np.array([0.2, 0.8])))
    df = spark.createDataFrame([(1, "you snarler", 9.0, "x"), (1, "you snarler", 9.0, "x"), (2, None, 9.0, "x")], "doc_id long, text string, score double, predicted string")
    got = toxicity.scored(df, model).orderBy("doc_id").collect()
    assert [(x.doc_id, x.predicted) for x in got] == [(1, 1), (1, 1), (2, 1)] and len({x.score for x in got}) == 1
    assert toxicity.scored(df.limit(0), model).count() == 0


def test_features_are_the_same_however_many_words_are_known(monkeypatch):
    learned = toxicity.Lexicon({"snarl*": 2.0, "grub": 3.0})
    text = "You snarling IDIOT, you gr4b! " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)) + " grub you"
    first = toxicity.features(text, learned)
    monkeypatch.setattr(toxicity._Kinds, "MOST", 10)
    assert toxicity.features(text, learned) == first == toxicity.features(text, toxicity.Lexicon(dict(learned)))
