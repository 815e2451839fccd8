import collections
import random
import re
from math import comb

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = collections.Counter(windows)
    marked = {j for i, x in enumerate(windows) if twice[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked), len(w) < 20 or 100 * len(marked) > 30 * len(w)


def test_counts_against_brute_force(spark):
    r = random.Random(2)
    texts = [None, "", "\n\n", " ", "a\n a\na\n\na", "ü#*$%&|<> x", "w " * 8, "w " * 9, "a b c d e f g h a b c d e f g h", "line one\r\nline one\r\n"]
    for _ in range(60):
        texts.append("".join(r.choice(["a", "b", "cc", "d"]) + r.choice([" ", " ", "\n", "\t"]) for _ in range(r.randint(1, 60))))
    words = [str(i) for i in range(40)]
    texts += [" ".join(words + words[5:20] + words), " ".join(map(str, range(30000))) + " x " + " ".join(map(str, range(100, 200)))]
    got = quality.counts(spark.createDataFrame(list(enumerate(texts)), "i long, text string")).collect()
    for x in got:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == plain(texts[x.i])


@pytest.mark.parametrize(("n", "alpha", "delta"), [(0, 0.1, 0.05), (10, 0.1, 0.05), (50, 0.1, 0.05), (400, 0.02, 0.01), (300, 0.3, 0.4)])
def test_most_allowed_is_the_exact_binomial_bound(spark, n, alpha, delta):
    got = spark.range(1).select(quality.most_allowed(F.lit(n).cast("long"), alpha, F.lit(delta))).first()[0]
    cdf = lambda k: sum(comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1))
    assert got == max((k for k in range(n + 1) if cdf(k) <= delta), default=-1)


def _texts(n, bad, r):
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    return [" ".join(word() + ("***" if bad else "") for _ in range(30)) for _ in range(n)]


def test_cutoffs_reject_bad_texts_and_bound_false_rejections(spark):
    r = random.Random(4)
    good, bad = _texts(3000, False, r), _texts(60, True, r)
    few = _texts(5, True, r)
    rows = [(i, t, "en") for i, t in enumerate(good + bad)] + [(10_000 + i, t, "xx") for i, t in enumerate(few)] + [(None, bad[0], "en"), (20_000, None, None)]
    labels = [(i, int(i < len(good))) for i in range(len(good) + len(bad))] + [(10_000 + i, 0) for i in range(5)] + [(None, 1), (3, None), (4, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.judge(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    kept = {x.doc_id: x.kept for x in got if x.doc_id is not None}
    assert len(got) == len(rows)
    assert sum(not kept[i] for i in range(len(good))) <= 0.02 * len(good)
    assert not any(kept[len(good) + i] for i in range(len(bad)))
    assert all(kept[10_000 + i] for i in range(5)), "too few labels to certify a cutoff"
    assert not kept[20_000] and not next(x.kept for x in got if x.doc_id is None)


def test_edges_of_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, n_words string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(none, labels).count() == 0
    df = spark.createDataFrame([(1, " ".join(map(str, range(30))), None, "clash"), (1, "short", "en", "clash")], none.schema)
    kept = quality.keep(df, labels)
    assert kept.columns == df.columns and [(x.doc_id, x.n_words) for x in kept.collect()] == [(1, "clash")]
