"""Relevance filter, ranking, result-likeness, post-filter and first-per-URL rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import authority, clean_title, contains_any, let, resolve_redirect
from .tfidf import Analyzer


@dataclass(frozen=True)
class Profile:
    """What the two built-in variants set differently; every list is a parameter with short defaults of our own."""

    noise_phrases: tuple[str, ...] = ("all rights reserved", "cookie policy", "released under")
    noise_titles: tuple[str, ...] = ("home", "next", "more")
    bad_urls: tuple[str, ...] = ("/profile/", "adclick", "/d/13")
    inner_urls: tuple[str, ...] = ("/profile/", "adclick", "/d/13")
    blocked_hosts: tuple[str, ...] = ("site6.example.org",)
    redirect_ads: tuple[str, ...] = ("adclick",)
    page_title: str = r"^\s*(page\s*)?\d+\s*$"
    #: A title that holds a licence number; None for no such rule.
    licence: str | None = None
    #: Host and script of redirect links that are taken apart; None for none.
    redirect_host: str | None = None
    redirect_path: str = "/link"
    #: Rows whose selectors give no URL take any link of their container.
    any_link: bool = False
    ad_labels: tuple[str, ...] = ("ad", "sponsored")
    ad_words: tuple[str, ...] = ("ad", "sale", "offer")
    #: Whether an advertising word has to stand alone; else it counts inside longer words too.
    whole_words: bool = False
    ad_urls: tuple[str, ...] = ("site3", "promo", "adclick")
    urgency: tuple[str, ...] = ("now", "only", "last", "here")
    major: tuple[str, ...] = ("src0", "src1", "src2", "src3")
    middle: tuple[str, ...] = ("src4", "src5")
    tiers: tuple[float, float, float] = (0.02, 0.04, 0.08)
    least_group_max: float = 0.05
    #: Points of the advertising score: a word, the URL, urgency, and by the model's probability, highest first.
    rule_points: int = 3
    link_points: int = 2
    urgency_points: int = 1
    model_points: tuple[tuple[float, int], ...] = ((0.5, 3), (0.35, 1))
    ad_cut: int = 4
    #: How candidates, results, advertisements, and then unique and ranked rows are weighed.
    candidates: Analyzer = Analyzer()
    relevance: Analyzer = Analyzer()
    ads: Analyzer = Analyzer()
    unique: Analyzer = Analyzer()


DEFAULT = Profile()
_STOP = ("the", "of", "and", "to", "in", "is", "for", "on", "with", "by")
#: Texts whose words are separated, and texts of a script that writes words together.
SPACED = replace(
    DEFAULT, any_link=True, candidates=Analyzer("word", 1, 3, _STOP, 1000, True), relevance=Analyzer("word", 1, 2, _STOP, 800, True),
    ads=Analyzer("word", 1, 3, _STOP, 1000, True), unique=Analyzer("word", 1, 2, _STOP),
)
UNSPACED = replace(
    DEFAULT, ad_labels=(), licence=r"[a-z]{2}[a-z]?\d{6,}", redirect_host="go.example", tiers=(0.02, 0.02, 0.08), middle=(), rule_points=4, urgency_points=0, model_points=((0.6, 4),),
    candidates=Analyzer("char", 2, 5, cap=1000, sublinear=True), relevance=Analyzer("char", 2, 4, cap=800, sublinear=True), ads=Analyzer("char", 2, 5, cap=800, sublinear=True),
)
PROFILES = {"spaced": SPACED, "unspaced": UNSPACED}


def furniture(title: Column, url: Column, snippet: Column, p: Profile = DEFAULT) -> Column:
    """Whether a row's texts alone make it page furniture: rejected, and short (rejected too if it scores low).  Where
    scores come later, this goes with a row in its texts' place."""
    low = F.lower(url)
    reject = (
        (F.length(title) < 3)
        | (contains_any(low, p.bad_urls) & contains_any(low, p.inner_urls))
        | contains_any(F.lower(F.concat(title, F.lit(" "), snippet)), p.noise_phrases)
        | F.lower(F.trim(title)).isin(*p.noise_titles)
        | F.lower(title).rlike(p.page_title)
    )
    if p.licence:
        reject = reject | F.lower(title).rlike(p.licence)
    return F.struct(reject.alias("rejected"), (F.length(snippet) < 8).alias("short"))


def is_like(found: Column, score: Column) -> Column:
    """Whether a row of that furniture() and score looks like a search result."""
    return ~F.coalesce(found["rejected"] | (found["short"] & (score < 0.1)), F.lit(True))


def is_result_like(title: Column, url: Column, snippet: Column, score: Column, p: Profile = DEFAULT) -> Column:
    """Whether a row looks like a search result rather than page furniture."""
    return is_like(furniture(title, url, snippet, p), score)


def first_then_filter(rows: DataFrame, keep: Column) -> DataFrame:
    """First row of each URL of a query and engine in order, and only then the filter: a URL whose first row
    fails stays blocked.  Rows without a URL are all tested."""
    w = Window.partitionBy("query_id", "engine", "url").orderBy("pos")
    first = rows.withColumn("_k", F.row_number().over(w)).filter((F.col("_k") == 1) | (F.coalesce("url", F.lit("")) == "")).drop("_k")
    return first.filter(keep)


def filter_then_best(rows: DataFrame, keep: Column) -> DataFrame:
    """The filter first, then the best-scored row of each URL."""
    w = Window.partitionBy("query_id", "engine", "url").orderBy(F.desc("score"), "pos")
    return rows.filter(keep).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def post_filter(rows: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    """Clean titles again, take redirects apart where the profile has them, first row per URL, then title length, fragment and script URLs, redirects, hosts."""
    t = rows.withColumn("title", clean_title(F.col("title"), p.ad_labels))
    if p.redirect_host:
        t = t.withColumn("url", resolve_redirect(F.col("url"), p.redirect_host, path=p.redirect_path))
    host = authority(F.col("url"))
    ok = (F.length("title") >= 3) & ~F.col("url").startswith("#") & ~F.col("url").startswith("javascript:") & ~contains_any(F.lower("url"), p.redirect_ads) & ~host.isin(*p.blocked_hosts)
    return first_then_filter(t, ok)


def tier_threshold(engine: Column, p: Profile = DEFAULT) -> Column:
    major, middle, other = p.tiers
    return F.when(engine.isin(*p.major), major).when(engine.isin(*p.middle), middle).otherwise(other)


def filter_by_relevance(rows: DataFrame, p: Profile = DEFAULT, min_rows: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows (query_id, engine, pos, score) at or above their engine's tier; a group of the lowest tier whose
    best score is too low goes whole.  Off unless set: groups of at most min_rows stay; only limit rows stay."""
    gid = ["query_id", "engine"]
    best = rows.groupBy(*gid).agg(F.max("score").alias("_best"), F.count("*").alias("_n"))
    x = rows.join(best, gid).withColumn("_least", tier_threshold(F.col("engine"), p))
    good = (F.col("score") >= F.col("_least")) & ((F.col("_least") < p.tiers[2]) | (F.col("_best") >= p.least_group_max))
    x = x.filter(good if min_rows is None else good | (F.col("_n") <= min_rows)).drop("_best", "_n", "_least")
    return x if limit is None else top_k(x, limit)


def top_k(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "engine").orderBy(F.desc("score"), "pos")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rank_by_relevance(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id", "engine").orderBy(F.desc("score"), "pos")
    return rows.withColumn("rank", F.row_number().over(w))


def ad_rule_score(title: Column, snippet: Column, url: Column, p: Profile = DEFAULT) -> dict[str, Column]:
    """Parts of the advertising score: words in the text, words in the URL, urgency in the title."""
    text = F.lower(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(snippet, F.lit(""))))
    # each text worked out once, not again for every word looked for in it
    urgency = let(F.lower(title), lambda t: sum((t.contains(w).cast("int") for w in p.urgency), F.lit(0)))
    hit = text.rlike(r"(?U)(?<!\w)(?:" + "|".join(map(re.escape, p.ad_words)) + r")(?!\w)") if p.whole_words else let(text, lambda t: contains_any(t, p.ad_words))
    return {
        "rule": F.when(hit, p.rule_points).otherwise(0), "link": F.when(contains_any(F.lower(url), p.ad_urls), p.link_points).otherwise(0),
        "urgency": F.when(urgency >= 2, p.urgency_points).otherwise(0), "urgency_hits": urgency,
    }


def model_score(probability: Column, p: Profile = DEFAULT) -> Column:
    """Points for a model's probability."""
    points = F.lit(0)
    for above, value in reversed(p.model_points):
        points = F.when(probability > above, value).otherwise(points)
    return points
