"""Character n-grams as numbers give what strings do."""

import collections
import random

import pytest

from serpflow import chargrams, neardup, text, tfidf

WIDE = "".join(map(chr, range(0x4E00, 0x4E00 + 9000)))
TEXTS = ["Red  tea", "red tea, RED tea", "", None, "a", "茶 \U0001f375\U0001f375 Émile", "red  tea"]


@pytest.mark.parametrize("texts", [TEXTS, [WIDE * 2, WIDE[::-1]], [], [None]])
@pytest.mark.parametrize("lo, hi", [(2, 4), (1, 1), (1, 9)])
def test_counts_equal_counted_strings(texts, lo, hi):
    want = collections.Counter(t[i : i + n] for t in texts if t for n in range(lo, hi + 1) for i in range(len(t) - n + 1))
    names, n = chargrams.counted(texts, lo, hi)
    assert dict(zip(names, n.tolist())) == want and names == sorted(names)


def test_totals_by_numbers_equal_totals_by_strings(spark):
    rows = [(g, t) for g in (1, 2, None, 2**53 + 1) for t in TEXTS]
    texts = spark.createDataFrame(rows, "g long, text string")
    got = lambda df: collections.Counter(map(tuple, df.collect()))
    small = tfidf.char_totals(texts, ["g"], 2, 4)
    assert "FlatMapGroupsInArrow" in small._jdf.queryExecution().executedPlan().toString()
    want = got(tfidf.totals(texts, ["g"], lambda t: text.char_ngrams(t, 2, 4)))
    assert got(small) == want == got(tfidf.char_totals(texts, ["g"], 2, 4, chars=5))


@pytest.mark.parametrize("a", [tfidf.Analyzer("char", 2, 4, cap=9, sublinear=True), tfidf.Analyzer("char", 1, 3), tfidf.WORDS, tfidf.Analyzer("word", 1, 3, stop=("red",), cap=2, sublinear=True)])
def test_cosines_by_numbers_equal_those_of_large_groups(spark, monkeypatch, a):
    rnd = random.Random(3)
    rows = [(g, k % 9 if k else None, rnd.choice(TEXTS + ["tea  of　　red stone", " "])) for g in (1, 2, None) for k in range(12)]
    items = spark.createDataFrame(rows, "g long, item long, text string")
    asked = spark.createDataFrame([(1, "red tea"), (2, "?"), (3, "x")], "g long, text string")
    def got():
        df = tfidf.cosine_to_query(items, asked, ["g"], a, digits=9)
        return df._jdf.queryExecution().executedPlan().toString(), collections.Counter((r["g"], r["item"], round(r["score"], 6)) for r in df.collect())

    plan, small = got()
    assert "FlatMapGroupsInArrow" in plan and any(k[2] for k in small)
    monkeypatch.setattr(tfidf, "TASK_CHARS", 2)  # every group is large
    plan, large = got()
    assert small == large


@pytest.mark.parametrize("a", [tfidf.WORDS, tfidf.Analyzer("char", 2, 3, cap=30)])
def test_unit_vectors_by_numbers_equal_those_of_large_groups(spark, monkeypatch, a):
    rnd = random.Random(5)
    rows = [(g, 100 * (g or 0) + k, rnd.choice(TEXTS + ["tea of  red stone", "stone red of tea", " "])) for g in (1, 2, None) for k in range(14)]
    items = spark.createDataFrame(rows, "g long, item long, text string")

    def got():
        df = neardup._vectors(items, 0.85, a, ["g"])
        # terms of a small group are numbers in the terms' order
        each = sorted((r["g"], r["item"], r["term"] if large else int(r["term"]), round(r["u"], 9), r["head"]) for r in df.collect())
        return [(g, i, u, h) for g, i, _, u, h in each]

    large = False
    small = got()
    monkeypatch.setattr(tfidf, "TASK_CHARS", 2)
    large = True
    assert small and got() == small
