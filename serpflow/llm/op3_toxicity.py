"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts and digit substitutions to Latin
letters.  The lexicon is learned from labelled texts: words, and stems of several words, that occur in several
toxic texts and in hardly any other, each weighted by its log odds.  Both sides count different texts, so
copies of one text do not make its words toxic.  Two-word phrases in which a
lexicon word occurs in other texts become exception phrases: a hit inside one does not count.  A text's
hits, their weight and their weight per length go through a logistic curve.  It is fitted on each half of the texts by
a lexicon learned from the other half, so that words that are toxic by chance weigh as little as they should.

Labels are read from a sample of labelled rows, by a hash of the id, of about ``max_labelled``, so model and
automaton are of bounded size.

Defined results: null and empty texts have no hits and the score of such; repeated rows give repeated
rows; of several labels of one id the highest counts, as of several labels of one text; without labels of both
kinds, as with empty tables, every score is 0; extra columns are left alone.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, table

#: Look-alikes of Latin letters, then digits and signs that stand for letters.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁɡһӏαβεικνορτυχ", "abekmhopctyxijsdghlabeikvoptux")) | dict(zip("0134579@$", "oieastgas"))
FOLD = {ord(k): ord(v) for k, v in LOOKALIKES.items()} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
FOREIGN = re.compile("[" + re.escape("".join(LOOKALIKES)) + "­​-‍⁠﻿！-～]").search
TOKEN = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case with look-alikes and digit substitutions undone; full-width forms made plain."""
    text = text.lower()
    if FOREIGN(text):
        if any("！" <= c <= "～" for c in text):
            text = unicodedata.normalize("NFKC", text)
        text = text.translate(FOLD)
    return text


def entries(word: str) -> list[str]:
    """A word and its stems of four to eight letters, marked by a star, as a lexicon may list them."""
    return [word] + [word[:k] + "*" for k in range(4, min(8, len(word) - 1) + 1)]


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    #: Logistic curve over measures().
    curve: list[float] = field(default_factory=lambda: [-30.0, 0.0, 0.0, 0.0, 0.0])

    def automaton(self):
        auto = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for w, v in self.weights.items():
            entries.setdefault(w.rstrip("*"), [None, None])[w.endswith("*")] = v
        for w, (word, stem) in entries.items():
            auto.add_word(w, (len(w), word, stem))
        for p in self.exceptions:
            auto.add_word(p, (len(p), None, None))
        auto.make_automaton()
        return auto


def hit_weight(auto, text: str) -> tuple[float, int]:
    """Summed weight and number of hits outside exception phrases: whole words, and words with a stem; of
    several entries at one place the heaviest counts."""
    hits, shields = {}, []
    for end, (n, word, stem) in auto.iter(text):
        start = end - n + 1
        if start and text[start - 1].isalnum():
            continue
        if end + 1 < len(text) and text[end + 1].isalnum():
            weight = stem
        elif word is None and stem is None:
            shields.append((start, end))
            continue
        else:
            weight = max(word or 0.0, stem or 0.0)
        if weight is not None and weight > hits.get(start, (0, 0.0))[1]:
            hits[start] = (end, weight)
    hits = [(s, e, w) for s, (e, w) in hits.items()]
    if shields and hits:
        shields.sort()
        out, k, reach = [], 0, -1
        for h in sorted(hits):
            while k < len(shields) and shields[k][0] <= h[0]:
                reach = max(reach, shields[k][1])
                k += 1
            if h[1] > reach:
                out.append(h)
        hits = out
    # an entry said again and again is one
    said = {text[s : e + 1]: w for s, e, w in hits}
    return sum(said.values()), len(said)


def measures(auto, text: str | None) -> tuple[float, float, float, float, float]:
    """1, whether there is a hit, whether there are two different ones, log of the hit weight, log of the hit
    weight per 100 words or so."""
    if not text or not len(auto):
        return 1.0, 0.0, 0.0, 0.0, 0.0
    folded = fold(text)
    weight, hits = hit_weight(auto, folded)
    return 1.0, float(hits > 0), float(hits > 1), math.log1p(weight), math.log1p(weight * 600 / (len(folded) + 100))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    reg = ridge * np.eye(x.shape[1]) * max(len(y), 1) / 100

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + w @ reg @ w / 2)

    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + reg
        step = np.linalg.solve(h + 1e-9 * np.eye(len(w)), x.T @ (y - p) - reg @ w)
        now = loss(w)
        while loss(w + step) > now and np.abs(step).max() > 1e-10:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def bounded_sample(rows: DataFrame, bound: int) -> DataFrame:
    """All rows if there are at most bound, else about bound of them by a hash of doc_id."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * bound / n))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 30_000, min_texts: int = 4, min_share: float = 0.004, min_precision: float = 0.8, min_completions: int = 5) -> Lexicon:
    """Learn a lexicon from docs (doc_id, text) and labels (doc_id, toxic).

    An entry has to occur in min_texts toxic texts and in a share of min_share of them, and toxic texts have to be
    min_precision of the labelled texts it occurs in; a stem must have that many completions too.
    """
    known = bounded_sample(labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")), max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").filter("text is not null")
    # copies are one text; the halves are for the curve, which is fitted on texts its lexicon was not learned from
    rows = table(rows.groupBy("text").agg(F.max("y").alias("y")).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")), "labelled")
    texts = {(r["y"], r["half"]): r["count"] for r in rows.groupBy("y", "half").count().collect()}
    size = {y: sum(n for (z, _), n in texts.items() if z == y) for y in (0, 1)}
    if not size[0] or not size[1]:
        return Lexicon()
    least = max(min_texts, math.ceil(min_share * size[1]))

    def toxic_entries(batches):
        """Entries of every toxic text, each once, with the words they came from."""
        for pdf in batches:
            out = []
            for t, half in zip(pdf.loc[pdf["y"] == 1, "text"], pdf.loc[pdf["y"] == 1, "half"]):
                first = {}
                for w in sorted(set(TOKEN.findall(fold(t)))):
                    for e in entries(w):
                        first.setdefault(e, w)
                out += [(e, w, half) for e, w in first.items()]
            yield pd.DataFrame(out, columns=["w", "full", "half"])

    toxic = rows.mapInPandas(toxic_entries, "w string, full string, half int").filter(F.length("w") >= 3)
    toxic = toxic.groupBy("w").agg(F.count_if(F.col("half") == 0).alias("n0"), F.count_if(F.col("half") == 1).alias("n1"), F.approx_count_distinct("full").alias("fulls"))
    toxic = toxic.filter(F.col("n0") + F.col("n1") >= least).filter(~F.col("w").endswith("*") | (F.col("fulls") >= min_completions))
    found = {r["w"]: (r["n0"], r["n1"]) for r in toxic.collect()}  # words of a bounded sample
    names = set(found)

    def other_texts(batches):
        """In how many other texts those entries occur."""
        for pdf in batches:
            n: Counter = Counter()
            for t, half in zip(pdf.loc[pdf["y"] == 0, "text"], pdf.loc[pdf["y"] == 0, "half"]):
                n.update((e, half) for e in names.intersection(e for x in set(TOKEN.findall(fold(t))) for e in entries(x)))
            yield pd.DataFrame([(w, half, k) for (w, half), k in n.items()], columns=["w", "half", "n"])

    clean = {(r["w"], r["half"]): r["n"] for r in rows.mapInPandas(other_texts, "w string, half int, n long").groupBy("w", "half").agg(F.sum("n").alias("n")).collect()}

    def weighted(halves: tuple[int, ...], least: int) -> dict[str, float]:
        """Entries that the texts of some halves bear out, by their log odds."""
        of = {y: sum(texts.get((y, h), 0) for h in halves) for y in (0, 1)}
        out = {}
        for w, n in found.items():
            a, b = sum(n[h] for h in halves), sum(clean.get((w, h), 0) for h in halves)
            if a >= least and a >= min_precision * (a + b):
                out[w] = math.log((a + 0.5) / (of[1] + 1)) - math.log((b + 0.5) / (of[0] + 1))
        return {w: v for w, v in sorted(out.items(), key=lambda x: (-x[1], x[0])) if v > 0}

    lexicon = Lexicon(weighted((0, 1), least))
    suspects = {w for w in lexicon.weights if sum(clean.get((w, h), 0) for h in (0, 1)) >= 3 and w[-1] != "*"}
    if suspects:

        def phrases(batches):
            for pdf in batches:
                seen: Counter = Counter()
                for t, y in zip(pdf["text"], pdf["y"]):
                    w = TOKEN.findall(fold(t))
                    pairs = {f"{a} {b}" for a, b in zip(w, w[1:]) if a in suspects or b in suspects}
                    seen.update((p, int(y)) for p in pairs)
                yield pd.DataFrame([(p, y, n) for (p, y), n in seen.items()], columns=["p", "y", "n"])

        around = rows.mapInPandas(phrases, "p string, y int, n long").groupBy("p").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 1, 0).otherwise(F.col("n"))).alias("b"))
        lexicon.exceptions = sorted(r["p"] for r in around.filter("a = 0 and b >= 3").collect())
    halves = [Lexicon(weighted((1 - h,), max(2, least // 2)), lexicon.exceptions) for h in (0, 1)]

    def measured(batches):
        autos = [x.automaton() for x in halves]
        for pdf in batches:
            yield pd.DataFrame([(*measures(autos[h], t), y) for t, y, h in zip(pdf["text"], pdf["y"], pdf["half"])], columns=["a", "b", "c", "d", "e", "y"])

    fit = rows.mapInPandas(measured, "a double, b double, c double, d double, e double, y int").groupBy("a", "b", "c", F.round("d", 1).alias("d"), F.round("e", 1).alias("e"), "y").count().collect()
    m = np.array([(r["a"], r["b"], r["c"], r["d"], r["e"], r["y"], r["count"]) for r in sorted(fit)], dtype=float)
    lexicon.curve = logistic(np.repeat(m[:, :5], m[:, 6].astype(int), axis=0), np.repeat(m[:, 5], m[:, 6].astype(int))).tolist()
    return lexicon


@lru_cache(maxsize=4)
def _automaton(words: tuple, exceptions: tuple):
    return Lexicon(dict(words), list(exceptions)).automaton()


def toxicity(text: Column, lexicon: Lexicon) -> Column:
    """Score in [0, 1] of a text column."""
    words, exceptions, curve = tuple(lexicon.weights.items()), tuple(lexicon.exceptions), list(lexicon.curve)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        auto = _automaton(words, exceptions)
        z = np.array([measures(auto, t) for t in texts], dtype=float).reshape(-1, 5) @ np.array(curve)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return score(text)


def train_rows(docs: DataFrame) -> DataFrame:
    """Documents whose labels may be learned from."""
    return docs.filter(fold_of(F.col("doc_id"), 3) != 1)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    lexicon = learn(train_rows(docs), labels, **options)
    d = docs.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), toxicity(F.col("text"), lexicon).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
