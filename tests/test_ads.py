"""The advertising model against a plain solver, and entity decoding against the standard library."""

import html
import re
from collections import Counter
from dataclasses import replace

import numpy as np
from pyspark.sql import Observation
from pyspark.sql import functions as F

from serpflow import ads, text
from serpflow.ranking import DEFAULT, SPACED, UNSPACED
from serpflow.tfidf import Analyzer

ROWS = [("buy cheap shoes now", 1), ("cheap offer buy today", 1), ("sale of shoes", 1), ("history of tea", 0), ("tea leaves and water", 0), ("how water is kept", 0), ("the history of shoes", 0)]


def _weights():
    docs = [Counter(re.findall(r"\w\w+", t)) for t, _ in ROWS]
    vocab = sorted(set().union(*docs))
    idf = {w: np.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) + 1 for w in vocab}
    vector = lambda d: (lambda v: v / (np.linalg.norm(v) or 1))(np.array([d[w] * idf[w] for w in vocab]))
    x, y = np.array([[*vector(d), 1.0] for d in docs]), np.array([l for _, l in ROWS], float)
    s = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    penalty, b = np.diag([1.0] * len(vocab) + [0.0]), np.zeros(len(vocab) + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (s * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (s * (p - y)) + penalty @ b)
    return lambda t: 1 / (1 + np.exp(-(np.append(vector(Counter(re.findall(r"\w\w+", t))), 1.0) @ b)))


def test_same_probabilities_as_a_plain_solver(spark):
    model = ads.train_ad_model(spark.createDataFrame([*ROWS, ("no label", None)], "text string, label int"), Analyzer(hi=1))
    asked = ["buy tea now", "history", "words never met", "", None, "cheap cheap shoes"]
    want = _weights()
    for r in ads.score_ads(spark.createDataFrame([(t,) for t in asked], "text string"), model).collect():
        assert abs(r["probability"] - want(r["text"] or "")) < 1e-5, r
    rows = spark.createDataFrame([("cheap offer", "https://promo.example/", "buy now"), ("", "https://promo.example/adclick", ""), ("history of tea", "https://t.example", "water")], "title string, url string, snippet string")
    assert [r["ad"] for r in ads.ad_score(rows, model).collect()] == [True, False, False]
    assert ads.drop_ads(rows, model).count() == 2


def test_entities_like_the_standard_library(spark):
    texts = ["a &amp;&lt;b&gt; &quot;", "&notit; &not &notin; &copyx &amp", "&#65;&#x42;&#X43 &#0; &#x80;&#129;&#xD800;&#x110000;&#99999999999;", "&#x1F600; &#20013; &#xFFFE;|&#11;|&#13;", "& && &; &# &#; &#x; &#xg", "&CounterClockwiseContourIntegral; &acE; &unknown; &frac12 &frac12x", "", "plain", "&#128;&#150;&#00065;", None]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.html_unescape(F.col("t")).alias("u")).collect():
        assert r["u"] == (None if r["t"] is None else html.unescape(r["t"])), r


def test_profiles_weigh_parts_their_own_way(spark):
    rows = spark.createDataFrame([("now sale", "https://x.example", "tea"), ("now here sale", "https://x.example", ""), ("tea", "https://promo.example", "")], "title string, url string, snippet string")
    points = {name: [(r["score"], r["ad"]) for r in ads.ad_score(rows, None, p).collect()] for name, p in (("spaced", SPACED), ("unspaced", UNSPACED))}
    assert points == {"spaced": [(3, False), (4, True), (2, False)], "unspaced": [(4, True), (4, True), (2, False)]}
    probability = spark.createDataFrame([(0.3,), (0.4,), (0.55,), (0.7,)], "q double")
    assert [[r[0] for r in probability.select(ads.model_score(F.col("q"), p)).collect()] for p in (SPACED, UNSPACED)] == [[0, 1, 3, 3], [0, 0, 0, 4]]


def test_saved_model_scores_the_same(spark, tmp_path):
    pairs = ads.labelled_union(*(spark.createDataFrame([(t,) for t, y in ROWS if y == k], "text string") for k in (1, 0)))
    for a in (Analyzer("char", 2, 3, cap=50, sublinear=True), Analyzer(stop=("of", "the"), cap=20)):
        model = ads.train_ad_model(pairs, a)
        model.save(str(tmp_path / a.kind))
        again = ads.AdModel.load(str(tmp_path / a.kind))
        rows = spark.createDataFrame([(t,) for t, _ in ROWS] + [("",), (None,)], "text string")
        got = [[r["probability"] for r in ads.score_ads(rows, m).collect()] for m in (model, again)]
        assert got[0] == got[1] and again.a == a and sum((p > 0.5) == bool(y) for p, (_, y) in zip(got[0], ROWS)) >= 6


def test_models_trained_after_an_observation_go_to_tasks(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get["n"] == 3
    model = ads.train_ad_model(spark.createDataFrame(ROWS, "text string, label int"), Analyzer(cap=20))
    got = ads.score_ads(spark.createDataFrame(ROWS, "text string, label int").repartition(2), model).collect()
    assert len(got) == len(ROWS) and all((r["probability"] > 0.5) == bool(r["label"]) for r in got)


def test_texts_are_made_once_for_all_words_looked_for(spark):
    made = lambda c: F.regexp_replace(c, r"\s+", " ")
    rows = spark.createDataFrame([("now\tsale", "https://site3.example", "tea"), (None, None, None)], "title string, url string, snippet string")
    out = ads.drop_ads(rows.select(made("title").alias("title"), "url", made("snippet").alias("snippet")), None)
    assert out._jdf.queryExecution().executedPlan().toString().count("regexp_replace") < 20 and out.count() == 1


def test_words_inside_words(spark):
    rows = spark.createDataFrame([("Download the reader", "https://site3.example", ""), ("An ad, here", "https://site3.example", "")], "title string, url string, snippet string")
    assert [[r["ad"] for r in ads.ad_score(rows, None, p).collect()] for p in (DEFAULT, replace(DEFAULT, whole_words=True))] == [[True, True], [False, True]]
