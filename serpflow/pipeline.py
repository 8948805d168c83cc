"""The two composites after extraction: washing rows, and a run from registry to washed rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import ads, neardup, selectors, sources, tfidf
from .ranking import DEFAULT, Profile
from .store import table
from .text import join_item

ROWS = "query_id long, engine string, pos long, title string, url string, snippet string"
RANKED = ROWS + ", score double, rank int"


@dataclass(frozen=True)
class Washed:
    """Rows ranked within their engine, the engines asked, and how many rows there were after each step."""

    rows: DataFrame
    engines: DataFrame
    unfiltered: DataFrame
    after_ads: int
    after_duplicates: int

    @property
    def removed(self) -> int:
        """Rows that went as near duplicates; advertisements don't count."""
        return self.after_ads - self.after_duplicates

    def bundles(self) -> DataFrame:
        """One row per engine asked with its rows by rank; engines that lost all their rows stay."""
        return sources.bundles(self.rows.withColumn("pos", F.col("rank").cast("long")), self.engines)

    def removed_by_query(self) -> DataFrame:
        """query_id, after_ads, kept, removed for every query asked."""
        n = lambda d, name: d.groupBy("query_id").agg(F.count("*").alias(name))
        out = self.engines.select("query_id").distinct().join(n(self.unfiltered, "after_ads"), "query_id", "left").join(n(self.rows, "kept"), "query_id", "left").fillna(0, ["after_ads", "kept"])
        return out.withColumn("removed", F.col("after_ads") - F.col("kept"))


def wash(rows: DataFrame, engines: DataFrame, asked: DataFrame, model: ads.AdModel | None = None, p: Profile = DEFAULT, threshold: float = 0.85) -> Washed:
    """Drop advertisements, then near duplicates among all rows of a query, then rank each engine's rows by their
    likeness to the query.

    rows: query_id, engine, pos, title, url, snippet; engines: query_id, engine; asked: query_id, query.  Rows are written
    once after each of both steps, and counted by the same pass that writes them.
    """
    before, after = Observation(), Observation()
    kept = ads.drop_ads(rows.select("query_id", "engine", "pos", "title", "url", "snippet"), model, p)
    # a number of every row, for good once written; pos is unique only within a query and engine
    kept = table(kept.withColumn("item", F.monotonically_increasing_id()).observe(before, F.count(F.lit(1)).alias("n")), "without_ads")
    items = kept.withColumn("text", join_item(F.col("title"), F.col("snippet")))
    gone = neardup.near_duplicates(items, ["engine", "pos"], ["query_id"], threshold, p.unique)
    left = kept.join(gone, "item", "left_anti")
    unique = table(left.observe(after, F.count(F.lit(1)).alias("n")), "unique")
    items = unique.select("query_id", "engine", "item", join_item(F.col("title"), F.col("snippet")).alias("text"))
    queries = unique.select("query_id", "engine").distinct().join(asked, "query_id").select("query_id", "engine", F.col("query").alias("text"))
    score = tfidf.cosine_to_query(items, queries, ["query_id", "engine"], p.unique)
    # one engine's rows for one query, ranked without their texts
    w = Window.partitionBy("query_id", "engine").orderBy(F.desc("score"), "pos")
    ranks = unique.select("query_id", "engine", "item", "pos").join(score, ["query_id", "engine", "item"]).withColumn("rank", F.row_number().over(w)).select("item", "score", "rank")
    # texts are joined again where they are asked for
    out = unique.join(table(ranks, "ranks"), "item").select("query_id", "engine", "pos", "title", "url", "snippet", "score", "rank")
    count = lambda o: int(o.get["n"])
    return Washed(out, engines, kept.drop("item"), count(before), count(after))


@dataclass(frozen=True)
class Run:
    """What a run gives; parts it did not come to are empty, with their columns."""

    requests: DataFrame
    failures: DataFrame
    rows: DataFrame
    engines: DataFrame
    washed: Washed | None
    ended: str

    def bundles(self) -> DataFrame:
        """Washed bundles, else extracted ones; engines with a usable page and no rows stay."""
        return self.washed.bundles() if self.washed else sources.bundles(self.rows, self.engines)


def run(registry: DataFrame, queries: DataFrame, crawl, strategies, templates: dict[str, str] | None = None, skip: tuple[str, ...] = (), model: ads.AdModel | None = None, p: Profile = DEFAULT,
        min_speed: int = 5, do_extract: bool = True, do_wash: bool = True) -> Run:
    """From a registry (ord, name, url, speed) and queries (query_id, query) to washed rows.

    crawl gives the fetched pages (page_id, query_id, engine, url, html, status, error): a DataFrame, or a function
    of the requests (query_id, name, request) that a fetcher was handed.  Pages count for requests that
    were made.  An empty registry, no query but blank ones, and no usable page each end the run early; with
    do_extract off every engine has no rows, with do_wash off rows stay as extracted.
    """
    spark = registry.sparkSession
    empty = lambda ddl: spark.createDataFrame([], ddl)
    asked = queries.withColumn("query", F.trim("query")).filter("query <> ''")
    kept = sources.filter_speed(registry, min_speed)
    nothing = lambda why, requests=None, failed=None: Run(requests or empty("query_id long, ord int, name string, request string"), failed or empty("page_id long, engine string, status string, detail string"), empty(ROWS), empty("query_id long, engine string"), None, why)
    if registry.isEmpty():
        return nothing("no source")
    if asked.isEmpty():
        return nothing("no query")
    requests = sources.build_requests(asked, kept, templates or {}, skip)
    made = requests.filter("request is not null").select("query_id", F.col("name").alias("engine"), "request")
    fetched = crawl(made) if callable(crawl) else crawl
    fetched = fetched.join(made.select("query_id", "engine"), ["query_id", "engine"], "left_semi")
    failed = sources.failures(fetched).select("page_id", "engine", "status", "detail")
    pages = table(fetched.filter("status = 'success' and html <> ''").select("page_id", "query_id", "engine", "url", "html"), "pages")
    if pages.isEmpty():
        return nothing("no usable page", requests, failed)
    engines = pages.select("query_id", "engine").distinct()
    if not do_extract:
        rows = empty(ROWS)
    else:
        of = pages.select("page_id", "query_id").join(asked, "query_id").select("page_id", F.col("query").alias("text"))
        rows = table(selectors.extract(pages, of, strategies, p), "extracted")
    if not do_wash:
        return Run(requests, failed, rows, engines, None, "not washed")
    return Run(requests, failed, rows, engines, wash(rows, engines, asked, model, p), "washed")
