"""Toxicity by a factorization machine over hashed terms: single terms and pairs of terms that occur together."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .boosting import sigmoid
from .common import Scratch, held_out, labelled_sample

LETTERS = re.compile(r"[^\W\d_]+")
SPACE = (1 << 30) - 1


def word_terms(word: str, again: bool) -> list[int]:
    """Hashes of a word, of its first four and five letters (inflected forms share them), and of its repetition."""
    def term(part: str, kind: int) -> int:
        return xxh32_intdigest(part.encode("utf-8", "surrogatepass"), kind) & SPACE

    out = [term(word, 0)]
    if len(word) >= 5:
        out.append(term(word[:4], 4))
    if len(word) >= 6:
        out.append(term(word[:5], 5))
    if again:
        out.append(term(word, 2))
    return out


def words_seen(text: str | None) -> list[tuple[str, bool]]:
    """Every distinct word of a text, and whether it comes more than once."""
    return [(w, n > 1) for w, n in Counter(LETTERS.findall(text.lower())).items()] if text else []


@dataclass(frozen=True)
class Machine:
    """bias + sum of the terms' weights + sum over pairs of the products of their factors."""

    bias: float
    place: dict[int, int]
    weights: np.ndarray
    factors: np.ndarray

    def probability(self, texts: list[list[int]]) -> np.ndarray:
        """``texts``: the places of each text's terms, each once."""
        counts = np.array([len(t) for t in texts], np.int64)
        rows = np.repeat(np.arange(len(texts)), counts)
        at = np.fromiter((i for t in texts for i in t), np.int64, int(counts.sum()))
        return sigmoid(_raw(self.bias, self.weights, self.factors, rows, at, len(texts))[0])


def _raw(bias: float, weights: np.ndarray, factors: np.ndarray, rows: np.ndarray, at: np.ndarray, n: int):
    """Scores before the logistic, and the summed factors per row that the gradient needs too."""
    line = np.bincount(rows, weights[at], n)
    sums = np.stack([np.bincount(rows, factors[at, k], n) for k in range(factors.shape[1])], 1)
    squares = np.bincount(rows, (factors[at] ** 2).sum(1), n)
    return bias + line + 0.5 * ((sums ** 2).sum(1) - squares), sums


def learn_machine(terms: np.ndarray, texts: list[np.ndarray], y: np.ndarray, factors: int = 4, rounds: int = 200,
                  rate: float = 0.05, ridge: float = 1e-4, seed: int = 3) -> Machine:
    """Adam on the logistic loss over all rows. ``texts`` hold places in ``terms``."""
    share = (y.sum() + 1) / (len(y) + 2)
    rng = np.random.default_rng(seed)
    state = [np.array([np.log(share / (1 - share))]), np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), factors))]
    if len(terms) and 0 < y.sum() < len(y):
        counts = np.array([len(t) for t in texts])
        rows, at = np.repeat(np.arange(len(texts)), counts), np.concatenate(texts).astype(np.int64)
        means, powers = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
        for turn in range(1, rounds + 1):
            raw, sums = _raw(state[0][0], state[1], state[2], rows, at, len(y))
            error = (sigmoid(raw) - y) / len(y)
            own = error[rows]
            by_factor = np.stack([np.bincount(at, own * (sums[rows, k] - state[2][at, k]), len(terms)) for k in range(factors)], 1)
            slopes = [np.array([error.sum()]), np.bincount(at, own, len(terms)) + ridge * state[1] / 10, by_factor + ridge * state[2]]
            for s, slope, mean, power in zip(state, slopes, means, powers, strict=True):
                mean += 0.1 * (slope - mean)
                power += 0.01 * (slope ** 2 - power)
                s -= rate * (mean / (1 - 0.9 ** turn)) / (np.sqrt(power / (1 - 0.99 ** turn)) + 1e-8)
    return Machine(float(state[0][0]), {int(t): i for i, t in enumerate(terms)}, state[1], state[2])


def interactions(together: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds ratios of all pairs of terms in ``n`` rows, and their variances, from how often two occur together."""
    own = np.diag(together)
    cells = [together, own[:, None] - together, own[None, :] - together, n - own[:, None] - own[None, :] + together]
    cells = [np.maximum(c, 0) + 0.5 for c in cells]
    return np.log(cells[0]) + np.log(cells[3]) - np.log(cells[1]) - np.log(cells[2]), sum(1 / c for c in cells)


def paired_terms(sample: DataFrame, terms: np.ndarray, toxic: int, other: int, least: float = 7.0) -> list[int]:
    """Those of ``terms`` that belong to a pair whose occurring together differs between toxic and other rows, the clearest first.

    The statistic is the difference of log odds ratios by its standard error; ``least`` is beyond
    what half a million pairs reach by chance. Tasks send counts of pairs, ``len(terms)`` squared.
    """
    if len(terms) < 2:
        return []

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, len(terms), len(terms)), np.float32)
        for part in parts:
            for label in (0, 1):
                rows = np.stack([np.isin(terms, np.asarray(t, np.int64)) for t in part.terms[part.label == label]] or [np.zeros(len(terms), bool)])
                rows = rows.astype(np.float32)
                sums[label] += rows.T @ rows
        yield pd.DataFrame({"label": [0, 1], "counts": [s.astype("<f4").tobytes() for s in sums]})

    together = np.zeros((2, len(terms), len(terms)), np.float64)
    for r in sample.select("label", "terms").coalesce(4).mapInPandas(count, "label int, counts binary").toLocalIterator():
        together[r.label] += np.frombuffer(r.counts, "<f4").reshape(len(terms), -1)
    (one, one_var), (two, two_var) = (interactions(t, n) for t, n in zip(together, (other, toxic), strict=True))
    z = np.abs(one - two) / np.sqrt(one_var + two_var)
    np.fill_diagonal(z, 0)
    # Forms of one word come and go together; their cells hold no more than rounding.
    z[(together.sum(0) > 0.9 * np.minimum.outer(*[np.diag(together.sum(0))] * 2))] = 0
    best = z.max(1)
    return [int(terms[i]) for i in np.argsort(-best, kind="stable") if best[i] >= least]


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = 20_000, most_terms: int = 4096, most_paired: int = 512, parts: int = 4, part: int = 2,
                 id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Learn from at most ``bound`` labelled rows outside the held-out fold.

    Terms whose share among toxic and other rows differs significantly (4 standard errors,
    5 rows at least) are kept, and those that say nothing alone but something with another term: of the
    ``most_paired`` terms whose presence varies most, those of significant pairs. ``most_terms`` bounds the model's size.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")

    @F.pandas_udf("array<int>")
    def hashed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sorted({h for w in words_seen(t) for h in word_terms(*w)}))

    sample = labelled_sample(docs, labels, label_col, bound, ~held_out(F.col(id_col), parts, part), id_col, text_col)
    sample = scratch.keep(sample.select("_id", "label", hashed("text").alias("terms")), "terms")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    other = n - toxic
    if not toxic or not other:
        return learn_machine(np.zeros(0, np.int64), [], np.array([1] * toxic + [0] * other))
    ones, all_ = F.col("ones"), F.col("n")
    gap = ones / toxic - (all_ - ones) / other
    spread = F.sqrt(all_ / n * (1 - all_ / n) * (1 / toxic + 1 / other))
    counted = scratch.keep(
        sample.select("label", F.explode("terms").alias("term")).groupBy("term")
        .agg(F.count("*").alias("n"), F.sum("label").alias("ones")).filter((all_ >= 5) & (all_ < n))
        .select("term", "n", F.abs(gap / spread).alias("z")), "counted")
    strong = counted.filter("z >= 4").orderBy(F.desc("z"), "term").limit(most_terms).collect()
    often = counted.orderBy(F.desc(F.least(all_, n - all_)), "term").limit(most_paired).collect()
    paired = paired_terms(sample, np.array(sorted(r.term for r in often), np.int64), int(toxic), int(other))
    chosen = list(dict.fromkeys([r.term for r in strong] + paired))[:most_terms]
    terms = np.array(sorted(chosen), np.int64)

    @F.pandas_udf("array<int>")
    def places(found: pd.Series) -> pd.Series:
        return found.map(lambda t: np.flatnonzero(np.isin(terms, np.asarray(t, np.int64))).tolist())

    rows = sample.select("_id", "label", places("terms").alias("at")).toPandas().sort_values("_id", kind="stable")
    return learn_machine(terms, [np.asarray(a, np.int64) for a in rows["at"]], rows.label.to_numpy())


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Scores depend on the whole text alone; null and empty texts get the score of a text
    without terms. Repeated rows score alike. A null id is not held out. Labels other than 0
    and 1 are not learnt from; with one class only every score is the smoothed share of ones.
    Other columns are not read; an empty table gives no rows.
    """
    model = fit_toxicity(docs, labels, **options)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[tuple[str, bool], tuple[int, ...]] = {}
        for part in parts:
            if len(known) > 200_000:
                known.clear()
            texts = []
            for text in part:
                at: set[int] = set()
                for w in words_seen(text):
                    if (found := known.get(w)) is None:
                        found = known[w] = tuple(model.place[h] for h in word_terms(*w) if h in model.place)
                    at.update(found)
                texts.append(sorted(at))
            yield pd.Series(model.probability(texts))

    return docs.select(
        F.col("doc_id"), held_out(F.col("doc_id"), 4, 2).alias("held_out"), scored("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
