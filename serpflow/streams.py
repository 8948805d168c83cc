"""Extraction and washing on a stream of fetched pages.

Rows of a page depend on that page alone, so they are made one by one as pages come, with a model trained before.
What looks at a whole query (relevance, near duplicates, ranks) works on the queries of one micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ads, dom, pipeline, selectors
from .ranking import DEFAULT, Profile
from .text import authority, clean_text, clean_title, resolve_url


def page_rows(crawl: DataFrame, model: ads.AdModel | None = None, p: Profile = DEFAULT) -> DataFrame:
    """query_id, engine, page_id, fetched_at, pos, title, url, snippet, score, ad of crawl records, batch or stream: the
    links of usable pages that lead to other hosts (dom.link_candidates()), with their advertising score.

    Nothing here looks beyond a row's page: nodes are parsed where the record lies, and what joins a link to the
    text near it happens inside the page's own rows.
    """
    pages = crawl.filter("status = 'success' and html <> ''").select("query_id", "engine", "page_id", "fetched_at", "url", "html")
    links = pages.select("query_id", "engine", "page_id", "fetched_at", F.explode(page_links(F.col("url"), F.col("html"))).alias("l")).select("query_id", "engine", "page_id", "fetched_at", "l.*")
    target, words = resolve_url(F.col("href"), F.col("base")), clean_text(F.col("link_text"))
    rows = links.withColumn("target", target).withColumn("link_text", words).filter(F.col("target").rlike("^https?://") & (authority(F.col("target")) != authority(F.col("base"))))
    rows = rows.withColumn("title", clean_title(F.col("link_text"))).filter(F.length("title") >= 3)
    rows = rows.select("query_id", "engine", "page_id", "fetched_at", "pos", "title", F.col("target").alias("url"), dom.near(F.col("link_text"), F.col("up"), F.col("beside")).alias("snippet"))
    return ads.ad_score(rows, model, p).drop("probability")


LINKS = "array<struct<pos:int,base:string,href:string,link_text:string,up:array<string>,beside:array<string>>>"


def page_links(url, html):
    """The free links of each page with the text of their ancestors and of what follows them."""

    @F.arrow_udf(LINKS)
    def links(urls: pa.Array, pages: pa.Array) -> pa.Array:
        return pa.array([dom.links_of(u, h) for u, h in zip(urls.to_pylist(), pages.to_pylist())], dom.LINKS)

    return links(url, html)


def first_per_url(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row to come of each URL of a query, on a stream with fetched_at.  A URL is remembered until the
    watermark passes it, so the state is that of so much time; rows later than that are dropped.  Rows without a URL all
    stay as long as they differ in page and place."""
    key = F.when(F.coalesce("url", F.lit("")) == "", F.concat_ws("#", F.lit(""), F.col("page_id").cast("string"), F.col("pos").cast("string"))).otherwise(F.col("url"))
    keyed = rows.withColumn("_key", key)
    if not rows.isStreaming:
        w = keyed.groupBy("query_id", "_key").agg(F.min_by(F.struct(*rows.columns), F.struct("fetched_at", "page_id", "pos")).alias("r"))
        return w.select("r.*")
    return keyed.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["query_id", "_key"]).drop("_key")


def by_batch(path: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch() that writes work(batch) below path in a folder of the batch's own number: a batch that
    is run again replaces what it wrote, so a restart changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            work(held).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            held.unpersist()

    return run


def wash_batches(path: str, asked: DataFrame, model: ads.AdModel | None = None, p: Profile = DEFAULT) -> Callable[[DataFrame, int], None]:
    """by_batch() of pipeline.wash(): rows of a batch's queries without advertisements and near duplicates, ranked.  Rows
    of one query that come in different batches are not compared."""

    def work(batch: DataFrame) -> DataFrame:
        rows = batch.select("query_id", "engine", F.col("pos").cast("long").alias("pos"), "title", "url", "snippet")
        return pipeline.wash(rows, rows.select("query_id", "engine").distinct(), asked, model, p).rows

    return by_batch(path, work)


def extract_batches(path: str, asked: DataFrame, strategies: DataFrame, p: Profile = DEFAULT) -> Callable[[DataFrame, int], None]:
    """by_batch() of selectors.extract(): both routes over the usable pages of a batch."""

    def work(batch: DataFrame) -> DataFrame:
        pages = batch.filter("status = 'success' and html <> ''").select("page_id", "query_id", "engine", "url", "html")
        of = pages.select("page_id", "query_id").join(asked, "query_id").select("page_id", F.col("query").alias("text"))
        return selectors.extract(pages, of, strategies, p)

    return by_batch(path, work)
