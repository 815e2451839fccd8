"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held_out, table

# Words of abuse and of address to start from; more of the former are learned.
ABUSE = frozenset((
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "fool", "loser", "losers", "pathetic", "worthless",
    "clown", "scum", "trash", "garbage", "disgusting", "jerk", "imbecile", "ugly", "hate", "shut", "dumm", "dummkopf",
    "trottel", "blöd", "idiota", "estúpido", "estúpida", "imbécil", "tonto", "idiote", "stupide", "imbécile", "crétin",
))
YOU = frozenset((
    "you", "your", "you're", "youre", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr",
    "sie", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "vosotros",
))
# Characters written for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
MIXED = re.compile(r"[^\W\d_][^\s]*[0-9@$*!|_#][^\s]*[^\W\d_]")
ODD = re.compile(r"[0-9@$*!|_#]")
SHOUT, MARKS = re.compile(r"\b[A-Z]{3,}\b"), re.compile(r"[!?]")
NAMES = ("seed", "learned", "both_log", "distinct_log", "share_of_hits", "near_you", "you", "capitals", "shouts", "marks", "mixed", "hidden", "length_log")
#: Words around a word of abuse within which one of address counts.
NEAR = 5

#: Bounds of the training sample: rows of either label. Learned stems, and the labelled documents that must have one.
TRAIN_ROWS, LEARNED, SUPPORT = 4000, 400, 6


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def stems(word: str) -> list[str]:
    """What is learned of a word: itself and its beginnings of 4 to 8 letters, with a star, as abuse is inflected and compounded."""
    return [word, *(word[:k] + "*" for k in range(4, min(9, len(word))))]


class Lexicon(dict):
    """Learned stems with their log-odds; a word weighs as its heaviest stem, 0 if none is known.

    ``kinds`` has a number for every word met so far: 0 for most, else a row of ``traits`` (seed, weight, address). So what a word is
    is found out once, and looked up from then on.
    """

    def __init__(self, known: dict[str, float]):
        super().__init__(known)
        self.begins = {k[:4] for k in known}
        self.kinds, self.traits, self.rows = _Kinds(self), [(0.0, 0.0, 0.0)], {(0.0, 0.0, 0.0): 0}

    def __reduce__(self):
        return Lexicon, (dict(self),)

    def weight(self, word: str) -> float:
        return max(map(self.get, stems(word), [0.0] * 6), default=0.0) if word[:4] in self.begins else 0.0

    def row(self, word: str) -> int:
        traits = (float(word in ABUSE), self.weight(word), float(word in YOU))
        if traits not in self.rows:
            self.rows[traits] = len(self.traits)
            self.traits.append(traits)
        return self.rows[traits]


class _Kinds(dict):
    """Fills itself; starts anew when it has grown, as a corpus has any number of words."""

    MOST = 1 << 18

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        found = self[word] = self.lexicon.row(word)
        return found


def features(text: str | None, learned: Lexicon) -> tuple[float, ...]:
    """NAMES of a whole text: densities by word or character, counts as logarithms. All 0 for a text without words or characters."""
    text = text or ""
    words = words_of(text)
    n, chars = max(1, len(words)), max(1, len(text))
    kinds = np.fromiter(map(learned.kinds.__getitem__, words), np.int64, len(words))
    marked = np.flatnonzero(kinds)
    seed, weight, you = np.array(learned.traits)[kinds[marked]].T if len(marked) else np.zeros((3, 0))
    hits, at = marked[(seed > 0) | (weight > 0)], marked[you > 0]
    near = int((np.searchsorted(at, hits + NEAR, "right") > np.searchsorted(at, hits - NEAR)).sum()) if len(hits) and len(at) else 0
    # Only what stands between spaces and has an odd character is looked at closely.
    mixed = [m[0] for x in text.split() if not x.isalpha() and ODD.search(x) and (m := MIXED.search(x))] if ODD.search(text) else []
    hidden = 0
    for x in mixed:
        plain = x.lower().translate(LEET)
        hidden += any(w in ABUSE or learned.weight(w) for w in (*WORD.findall(plain), re.sub(r"[\W\d_]", "", plain)))
    upper = sum(map(len, SHOUT.findall(text)))
    return (seed.sum() / n, weight.sum() / n, float(np.log1p(len(hits) + hidden)), float(np.log1p(len({words[i] for i in hits.tolist()}))), len(hits) / n, near / n, len(at) / n, sum(map(str.isupper, text)) / chars if upper else 0.0, upper / chars, len(MARKS.findall(text)) / n, len(mixed) / n, hidden / n, float(np.log1p(len(words))))


@dataclass
class Boosted:
    """Logistic gradient boosting of complete trees: splits at quantiles, leaves by Newton steps."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.1
    bins: int = 64
    smooth: float = 1.0
    base: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        mean = float(np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4))
        self.base = float(np.log(mean / (1 - mean)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, edges, weight * (p - y), weight * p * (1 - p))
            self.trees.append(tree)
            f += self._apply(tree, x)
        return self

    def _grow(self, binned, edges, g, h):
        size = 1 << self.depth
        feature, split = np.zeros(size, int), np.full(size, np.inf)
        node = np.ones(len(g), int)
        for k in range(1, size):
            own = node == k
            total_g, total_h = g[own].sum(), h[own].sum()
            best = (1e-9, 0, np.inf, None)
            for j, e in enumerate(edges):
                if own.any() and len(e):
                    b = binned[own, j]
                    left_g = np.cumsum(np.bincount(b, g[own], len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(b, h[own], len(e) + 1))[:-1]
                    gain = left_g**2 / (left_h + self.smooth) + (total_g - left_g) ** 2 / (total_h - left_h + self.smooth) - total_g**2 / (total_h + self.smooth)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], j, e[i], b > i)
            _, feature[k], split[k], right = best
            node[own] = 2 * k + (right if right is not None else 0)
        leaf = node - size
        value = -self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.smooth)
        return feature, split, value

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        feature, split, value = tree
        node = np.ones(len(x), int)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), feature[node]] > split[node])
        return value[node - len(feature)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function of ``score`` closest to ``y`` by weighted squares: pooled adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, lowest and highest score
    for s, t, w in zip(score[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([t, w, s, s])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, v, _, hi = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + m * v) / (b[1] + v), b[1] + v, hi
    return np.array([v for b in blocks for v in b[2:]]), np.array([b[0] for b in blocks for _ in range(2)])


@dataclass
class Model:
    learned: Lexicon
    boosted: Boosted
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts) -> np.ndarray:
        x = np.array([features(t, self.learned) for t in texts]).reshape(-1, len(NAMES))
        return np.clip(np.interp(self.boosted.margin(x), *self.knots), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model | None:
    """A model of labelled documents (doc_id, text; doc_id, toxic), at most about ``most`` of either label, drawn by a hash of doc_id.

    Contradicting labels of one id count as toxic; rows with a null id or label aren't used. A third of the sample gives the
    learned stems (those in SUPPORT documents or more, by log-odds), a third the trees, a third the calibration, in which rows
    weigh as many as they were drawn from. None without rows of both labels.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not all(sizes.get(k) for k in (0, 1)):
        return None
    share = {k: min(1.0, most / sizes[k]) for k in (0, 1)}
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(2)), 11) * 2.0**-53  # uniform in [0, 1)
    drawn = known.where(place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # At most a few thousand ids, written so that the planner knows.
    drawn = cut(drawn.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3))))
    texts = docs.select("doc_id", "text").join(drawn, "doc_id")

    @F.pandas_udf("array<string>")
    def distinct_stems(x: pd.Series) -> pd.Series:
        return pd.Series([sorted({s for w in {*words_of(t)} for s in stems(w)}) for t in x])

    both = {r.toxic: r["count"] for r in drawn.where("part = 0").groupBy("toxic").count().collect()}
    per_word = texts.where("part = 0").select("toxic", F.explode(distinct_stems("text")).alias("word")).groupBy("word").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    odds = F.ln((F.col("pos") + 0.5) / (both.get(1, 0) + 1)) - F.ln((F.col("n") - F.col("pos") + 0.5) / (both.get(0, 0) + 1))
    learned = Lexicon({r.word: r.odds for r in per_word.select("word", odds.alias("odds")).where("odds > 1.5").orderBy(F.desc("odds"), "word").limit(LEARNED).collect()})

    @F.pandas_udf("array<double>")
    def dense(x: pd.Series) -> pd.Series:
        return pd.Series([list(features(t, learned)) for t in x])

    rows = texts.where("part > 0").select("doc_id", "part", "toxic", dense("text").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    if rows.empty:
        return None
    x, y, part = np.stack(rows["x"].to_list()), rows["toxic"].to_numpy(float), rows["part"].to_numpy()
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    own, rest = part == 1, part == 2
    if not (0 < y[own].mean() < 1 and rest.any()):  # too few for parts: all rows for both
        own = rest = np.ones(len(y), bool)
    boosted = Boosted().fit(x[own], y[own], weight[own])
    return Model(learned, boosted, isotonic(boosted.margin(x[rest]), y[rest], weight[rest]))


def scored(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 from a score of 0.5); null texts score as empty ones; 0 without a model.

    Columns of these names that ``df`` has are replaced; all others stay. Repeated rows stay, an empty table gives an empty one.
    """

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts) if model else np.zeros(len(texts)))

    return df.withColumn("score", of(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model of labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return scored(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model).drop("text")
