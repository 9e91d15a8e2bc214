"""Quality by pairwise ranking (Bradley-Terry): scores whose differences explain which of two documents is preferred."""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import sigmoid
from .common import fresh, held_out, labelled_sample

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
SYMBOLS = b"*#$%&@^~=<>{}[]\\_+"
#: Numbers that describe a text.
WIDTH = 32
MARKS = b".,;:?'\"()-"


def features(text: str | None) -> list[float]:
    """Shares of letters, marks and repeats in a whole text; no words. Zeros for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = raw.split()
    n = len(found)
    if not n:
        return [0.0] * WIDTH

    def count(of: bytes) -> int:
        return len(raw) - len(raw.translate(None, of))

    size = len(raw)
    upper, lower = count(UPPER), count(LOWER)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = [
        upper / max(1, upper + lower), count(DIGITS) / size, count(SYMBOLS) / size, count(b"!") / n, count(b"|") / n,
        count(MARKS) / size, sum(map(eq, found, found[1:])) / n, 1 - len(set(found)) / n,
        1 - len(set(lines)) / max(1, len(lines)), sum(w.isupper() for w in found) / n,
        sum(w[-1] in SYMBOLS or w[-1] == 33 for w in found) / n, sum(len(w) > 30 for w in found) / n,
        sum(len(w) == 1 for w in found) / n, len(lines) / n,
    ]
    long_ = [math.log1p(n), size / n / 10, min(1.0, len(found) / 5), math.log1p(n / max(1, len(lines)))]
    return [*shares, *(min(1.0, 10 * s) for s in shares), *long_]


@dataclass(frozen=True)
class Ranking:
    """A linear score of standardised features, the threshold among scores, and how steeply it turns to a probability."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    steep: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.steep * (self.scores(x) - self.threshold))


def learn_ranking(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, ridge: float = 1e-3, seed: int = 11) -> Ranking:
    """Weights by logistic loss on feature differences of preference pairs (a 1 is preferred to a 0).

    The threshold is the score quantile that rejects the share of zeros. With one class
    only there is no pair: every score is 0 and every probability 1/2.
    """
    width = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    centre, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - centre) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    better = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(width)
    for _ in range(25):
        p = sigmoid(better @ w)
        gradient = better.T @ (1 - p) / pairs - ridge * w
        curve = (better * (p * (1 - p))[:, None]).T @ better / pairs + ridge * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        w += step
        if abs(step).max() < 1e-6:
            break
    s = z @ w
    threshold = float(np.quantile(s, len(bad) / len(y)))
    steeps = 2.0 ** np.arange(-4, 5)
    loss = [-np.mean(np.log(np.clip(np.where(y == 1, q := sigmoid(k * (s - threshold)), 1 - q), 1e-9, 1))) for k in steeps]
    return Ranking(centre, scale, w, threshold, float(steeps[int(np.argmin(loss))]))


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = 20_000, parts: int = 3, part: int = 1,
                id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking:
    """Learn from at most ``bound`` labelled rows outside the held-out fold."""
    @F.pandas_udf("array<double>")
    def described(text: pd.Series) -> pd.Series:
        return text.map(features)

    sample = labelled_sample(docs, labels, label_col, bound, ~held_out(F.col(id_col), parts, part), id_col, text_col)
    rows = sample.select("_id", "label", described("text").alias("x")).toPandas().sort_values("_id", kind="stable")
    x = np.array(rows.x.tolist(), float).reshape(len(rows), WIDTH)
    return learn_ranking(x, rows.label.to_numpy())


def quality_score(model: Ranking, text: Column) -> Column:
    """Probability of preference of a whole text; null and empty texts are scored as texts without words."""
    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.array([features(t) for t in text]).reshape(len(text), WIDTH)))

    return scored(text)


def classify_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Scores depend on the text alone. Repeated rows score alike. A null id is not held out.
    Labels other than 0 and 1 are not learnt from; without both classes every score is 1/2.
    Other columns are not read; an empty table gives no rows.
    """
    model = fit_quality(docs, labels, **options)
    return docs.select(
        F.col("doc_id"), held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        quality_score(model, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with their columns, whose score reaches the threshold."""
    model = fit_quality(docs, labels, **options)
    name = fresh(docs, "_score")
    return docs.withColumn(name, quality_score(model, F.col("text"))).filter(F.col(name) >= 0.5).drop(name)
