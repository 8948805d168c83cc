"""Quality classifier by Bradley-Terry pairwise ranking.

From labelled documents come preference pairs, a good one over a poor one; the logistic loss on the
difference of their features, which is the likelihood of the Bradley-Terry model, gives a linear score.
The cut is a quantile of the scores of the labelled documents: the share of poor ones among them.  The
reported score is a logistic curve around that cut.

Labels are read from a hash sample of about ``max_labelled`` rows, balanced weights come from drawing
every poor document equally often; the model is a vector of fixed length.

Defined results: null and empty texts have zero features; repeated rows give repeated rows; without labels
of both kinds every score is 1; extra columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of
from .op3_toxicity import bounded_sample

NAMES = ("log_words", "word_length", "distinct", "distinct_pairs", "symbols", "marks", "upper", "digits", "capitals", "dup_lines", "short_words", "run_on")


def features(text: str | None) -> list[float]:
    """Shares and means of a whole text; zeros for none."""
    w = text.split() if text else []
    if not w:
        return [0.0] * len(NAMES)
    n, chars = len(w), len(text)
    lines = [x for x in text.split("\n") if x]
    count = text.count
    distinct = len(set(w))
    return [
        np.log1p(n) / 10,
        min(chars / n, 40.0) / 10,
        # repetition shows against what texts of this length have
        distinct / n,
        len(set(zip(w, w[1:]))) / max(n - 1, 1),
        min(1.0, sum(map(count, "#*$%&|<>")) / n),
        min(1.0, (count("!") + count("?")) / n),
        sum(map(str.isupper, w)) / n,
        min(1.0, sum(map(count, "0123456789")) / n),
        sum(map(str.istitle, w)) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(1 for x in w if len(x) <= 3) / n,
        min(1.0, max(map(len, lines), default=0) / max(chars, 1)),
    ]


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features and their squares, each kept within bounds."""
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([z, z * z / 8])


@dataclass
class Ranking:
    mean: list[float] = field(default_factory=lambda: [0.0] * len(NAMES))
    scale: list[float] = field(default_factory=lambda: [1.0] * len(NAMES))
    weights: list[float] = field(default_factory=lambda: [0.0] * 2 * len(NAMES))
    cut: float = -10.0
    width: float = 1.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        """Bradley-Terry strength of feature rows."""
        return expand(x, np.array(self.mean), np.array(self.scale)) @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.cut) / self.width, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs_each: int = 8, ridge: float = 1e-3, seed: int = 3) -> Ranking:
    """Fit strengths to preference pairs (good over poor) of labelled feature rows."""
    good, poor = x[y == 1], x[y == 0]
    if not len(good) or not len(poor):
        return Ranking()
    mean, scale = good.mean(axis=0), good.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    # every poor document meets several good ones, every good one is met about equally often
    repeats = max(pairs_each, -(-len(good) // len(poor)))
    left = np.resize(rng.permutation(len(good)), repeats * len(poor))
    diff = expand(good[left], mean, scale) - np.repeat(expand(poor, mean, scale), repeats, axis=0)
    w = np.zeros(diff.shape[1])
    reg = ridge * len(diff) * np.eye(len(w))
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))  # of the wrong order
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff + reg, diff.T @ p - reg @ w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    out = Ranking(mean.tolist(), scale.tolist(), w.tolist())
    s = out.strength(x)
    # the quantile at the share of poor ones, midway to the next score
    k = int((y == 0).sum())
    ranked = np.sort(s)
    # among the quantiles near that share, the one that parts the labels best
    spots = np.unique(np.clip(np.round(np.linspace(0.5, 1.3, 81) * k).astype(int), 1, len(s) - 1))
    labels = y[np.argsort(s, kind="stable")]
    wrong = [(labels[:i] == 1).sum() + (labels[i:] == 0).sum() for i in spots]
    i = int(spots[int(np.argmin(wrong))])
    out.cut = float((ranked[i - 1] + ranked[i]) / 2)
    out.width = float(max(1e-3, np.abs(s - out.cut).mean() / 4))
    return out


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 30_000) -> Ranking:
    """Learn from docs (doc_id, text) and labels (doc_id, quality)."""
    known = bounded_sample(labels.filter("quality is not null").select("doc_id", F.col("quality").cast("int").alias("y")).dropDuplicates(["doc_id"]), max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])

    @F.pandas_udf("array<double>")
    def feats(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    got = rows.select("doc_id", feats("text").alias("x"), "y").orderBy("doc_id").collect()
    if not got:
        return Ranking()
    return fit(np.array([r["x"] for r in got], dtype=float), np.array([r["y"] for r in got]))


def quality(text: Column, model: Ranking) -> Column:
    """Score in [0, 1] of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], dtype=float).reshape(-1, len(NAMES))))

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    held_out = fold_of(F.col("doc_id"), 3) == 1
    model = learn(docs.filter(~held_out), labels, **options)
    d = docs.select("doc_id", held_out.alias("held_out"), quality(F.col("text"), model).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
