"""Language identification: language family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held_out, table

# Families of ISO 639-1 codes. Other codes are a family together.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi bn ur pa gu mr ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "sinitic": "zh",
    "austronesian": "id ms tl jv mg",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Hashed character n-grams of 1 to 3, and characters hashed at a time.
FEATURES, CHUNK = 4096, 1 << 20
#: Bounds of the training sample: rows altogether, dealt evenly to the languages, but so many for each at least.
TRAIN_ROWS, LEAST_ROWS = 4000, 20


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)


def letters(text: str | None) -> np.ndarray:
    """Code points of ``text`` in lower case, all but letters as spaces. What is beyond the basic plane counts as letters if the library says so."""
    at = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
    low = at < (1 << 16)
    keep = np.zeros(len(at), bool)
    keep[low] = _is_letter()[at[low]]
    if not low.all():
        keep[~low] = [chr(i).isalpha() for i in at[~low].tolist()]
    return np.where(keep, at, np.uint32(32))


def features(text: str | None) -> np.ndarray | None:
    """Square roots of hashed n-gram counts of the whole text, at length 1; None if it has no letter."""
    a = letters(text)
    if not (a != 32).any():
        return None
    total, a = np.zeros(FEATURES), np.concatenate((np.full(2, 32, np.uint32), a)).astype(np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(a) - 2, CHUNK):
        x = a[i : i + CHUNK + 2]
        code = x[2:]
        for n, before in enumerate((None, x[1:-1], x[:-2])):
            code = code if before is None else code * mix + before
            total += np.bincount((((code + np.uint64(n + 1)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(52)).astype(np.int64), minlength=FEATURES)
    total = np.sqrt(total)
    return total / np.sqrt((total * total).sum())


def machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights, bias last, of the linear machine with squared hinge loss for y in {-1, 1}: accelerated gradient, classes weighted evenly."""
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    v, t, rate = w.copy(), 1.0, 1 / (4 + penalty)
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * each * y
        grad = np.append(-2 * (gap @ x), -2 * gap.sum()) + penalty * np.append(v[:-1], 0)
        new, t_new = v - rate * grad.astype(np.float32), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w


@dataclass
class OneVersusOne:
    """A machine for every two of ``classes``; the class with most soft votes wins, the earlier of equals."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, names: np.ndarray) -> OneVersusOne:
        classes = sorted(set(names.tolist()))
        pairs, found = list(combinations(range(len(classes)), 2)), []
        for i, j in pairs:
            of = (names == classes[i]) | (names == classes[j])
            found.append(machine(x[of], np.where(names[of] == classes[i], 1, -1).astype(np.float32)))
        return cls(classes, pairs, np.array(found, np.float32).reshape(len(pairs), x.shape[1] + 1))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.pairs:
            return self.classes[0], 1.0
        p = 1 / (1 + np.exp(-4 * (self.weights[:, :-1] @ x + self.weights[:, -1])))
        votes = np.zeros(len(self.classes))
        for (i, j), v in zip(self.pairs, p, strict=True):
            votes[i] += v
            votes[j] += 1 - v
        best = int(votes.argmax())
        return self.classes[best], float(votes[best] / (len(self.classes) - 1))


@dataclass
class Hierarchy:
    family: OneVersusOne
    within: dict[str, OneVersusOne]

    @classmethod
    def fit(cls, x: np.ndarray, langs: np.ndarray) -> Hierarchy:
        of = np.array([FAMILY.get(s, "other") for s in langs.tolist()], object)
        return cls(OneVersusOne.fit(x, of), {f: OneVersusOne.fit(x[of == f], langs[of == f]) for f in set(of.tolist())})

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None:
            return "und", 0.0
        family, sure = self.family.predict(x)
        lang, own = self.within[family].predict(x)
        return lang, min(1.0, max(0.0, sure * own))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = TRAIN_ROWS) -> Hierarchy | None:
    """A model of at most about ``most`` rows of ``rows`` with a text that has letters and a language, drawn by a hash of ``key``.

    Every language that has rows is learned: each gives an even part of ``most``, or LEAST_ROWS if that is more, and rare ones all
    they have. So the sample has at most about max(``most``, LEAST_ROWS * languages) rows. None if there is nothing to
    learn from.
    """
    rows = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = cut(sizes)
    langs = sizes.count()
    if not langs:
        return None
    wanted = max(most / langs, LEAST_ROWS)
    # Draws vary: three standard deviations more, so that no language is left out by chance.
    rate = F.lit(float(wanted + 3 * wanted**0.5)) / F.col("n")
    draw = F.shiftrightunsigned(F.xxhash64("key", F.lit(1)), 11) * 2.0**-53  # uniform in [0, 1)

    @F.pandas_udf("binary")  # half precision: the sample is what the driver holds
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else x.astype(np.float16).tobytes() for x in map(features, texts)])

    drawn = rows.join(sizes, "lang").where(draw < rate).select("lang", of("text").alias("x")).where("x is not null").collect()
    if not drawn:
        return None
    x = np.stack([np.frombuffer(r.x, np.float16) for r in drawn]).astype(np.float32)
    return Hierarchy.fit(x, np.array([r.lang for r in drawn], object))


def identified(df: DataFrame, model: Hierarchy | None, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score (0 to 1): `und` and 0 for texts that are null or have no letter, or if there is no model.

    Columns of these names that ``df`` has are replaced; all others stay. Repeated rows stay, an empty table gives an empty one.
    """

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(x) if model else ("und", 0.0) for x in texts], columns=["lang_pred", "score"])

    kept = [F.col(c) for c in df.columns if c not in ("lang_pred", "score")]
    return df.select(F.struct(*kept).alias("row"), of(F.col(text)).alias("found")).select("row.*", "found.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id")))
    return identified(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model).drop("text")
