"""Registry and crawl input, request building, statistics of a crawl, and the sinks' frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import percent_quote

CRAWL = "engine string, url string, query string, html string, status string, error string"


def parse_registry(raw: DataFrame) -> DataFrame:
    """ord, name, url, speed from registry texts (value): a dict by name, or the older array form.  A dict
    entry without url or speed has "" and 5; text that is no JSON gives no rows."""
    entry = "struct<url:string,speed:int>"
    r = raw.select(F.trim("value").alias("v"))
    d = r.filter(F.col("v").startswith("{")).select(F.posexplode(F.map_entries(F.from_json("v", f"map<string,{entry}>"))).alias("ord", "e")).select("ord", F.col("e.key").alias("name"), F.coalesce("e.value.url", F.lit("")).alias("url"), F.coalesce("e.value.speed", F.lit(5)).alias("speed"))
    a = r.filter(F.col("v").startswith("[")).select(F.posexplode(F.from_json("v", "array<struct<name:string,url:string,speed:int>>")).alias("ord", "e")).select("ord", "e.name", F.coalesce("e.url", F.lit("")).alias("url"), "e.speed")
    return d.unionByName(a)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    return parse_registry(spark.read.text(path, wholetext=True))


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CRAWL).json(path)


def filter_speed(sources: DataFrame, least: int = 5) -> DataFrame:
    return sources.filter(F.coalesce("speed", F.lit(0)) >= least)


def normalize_name(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Names by an alias table; others as they are."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    return df.withColumn("name", F.coalesce(F.try_element_at(table, F.col("name")), F.col("name"))) if aliases else df


def by_speed(sources: DataFrame) -> DataFrame:
    """The registry in order of falling speed, sources of equal speed as they were; ord is the new place.  A
    registry is one document, and is sorted as one array."""
    order = F.struct(-F.coalesce("speed", F.lit(0)), "ord", "name", "url", "speed")
    one = sources.agg(F.sort_array(F.collect_list(order)).alias("all"))
    return one.select(F.posexplode("all").alias("ord", "s")).select("ord", "s.name", "s.url", "s.speed")


#: Sources that go to every task as they are; longer registries are joined in blocks of this size.
SOURCE_BLOCK = 10_000


def build_requests(queries: DataFrame, sources: DataFrame, templates: dict[str, str], skip: tuple[str, ...] = (), block: int = SOURCE_BLOCK) -> DataFrame:
    """query_id, ord, name, request for every query and source.  A registry of at most one block, by its count,
    is broadcast; of a longer one each block meets the queries in a join on the block's number."""
    given = F.create_map(*[F.lit(x) for kv in templates.items() for x in kv]) if templates else None
    rows = sources.select("ord", "name", "url").withColumn("template", F.try_element_at(given, F.col("name")) if templates else F.lit(None).cast("string"))
    blocks = max(1, -(-rows.count() // block))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("name", "ord"), F.lit(blocks)).cast("int"))
    x = queries.select("query_id", percent_quote(F.col("query")).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    x = x.join(F.broadcast(rows) if blocks == 1 else rows, "_block")
    put = lambda c: F.replace(c, F.lit("{query}"), F.col("q"))
    url = F.when(F.col("name").isin(*skip), F.lit(None)) if skip else F.when(F.lit(False), F.lit(None).cast("string"))
    url = url.when(F.col("url").contains("{query}"), put(F.col("url"))).when(F.col("template").isNotNull(), put(F.col("template"))).otherwise(F.concat(F.rtrim(F.col("url"), F.lit("/")), F.lit("/search?q="), F.col("q")))
    return x.select("query_id", "ord", "name", url.alias("request"))


def usable_pages(crawl: DataFrame) -> DataFrame:
    return crawl.filter("status = 'success' and html <> ''").select("engine", "url", "query", "html")


def clean_queries(df: DataFrame) -> DataFrame:
    """Trimmed queries without empty ones; a speed that is no integer becomes 5."""
    return df.withColumn("query", F.trim("query")).filter("query <> ''").withColumn("speed", F.coalesce(F.expr("try_cast(speed as int)"), F.lit(5)))


def status_counts(crawl: DataFrame, by: list[str]) -> DataFrame:
    ok, skipped = F.col("status") == "success", F.col("status") == "skipped"
    return crawl.groupBy(*by).agg(F.count_if(ok).alias("success"), F.count_if(~ok & ~skipped).alias("failed"), F.count_if(skipped).alias("skipped"))


def failures(crawl: DataFrame, length: int = 100) -> DataFrame:
    short = F.substring("error", 1, length)
    return crawl.filter("status not in ('success', 'skipped')").withColumn("detail", F.when(short == "", "-").otherwise(short))


def numbered(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """1-based index of the rows of each query and engine."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy("query_id", "engine").orderBy(*order)))


def bundles(rows: DataFrame, engines: DataFrame) -> DataFrame:
    """One row per engine asked (query_id, engine) with its rows in order; engines without rows stay."""
    made = rows.groupBy("query_id", "engine").agg(F.sort_array(F.collect_list(F.struct("pos", "title", "url", "snippet"))).alias("results"))
    return engines.join(made, ["query_id", "engine"], "left").withColumn("results", F.coalesce("results", F.array().cast(made.schema["results"].dataType)))


def write_json(rows: DataFrame, engines: DataFrame, path: str, exported: str) -> None:
    """Bundles as JSON lines, and a one-row manifest beside them."""
    b = bundles(rows, engines)
    b.write.json(f"{path}/data")
    b.agg(F.count("*").alias("total_engines"), F.coalesce(F.sum(F.size("results")), F.lit(0)).alias("total_results")).withColumn("export_time", F.lit(exported)).write.json(f"{path}/manifest")


def write_csv(rows: DataFrame, path: str) -> None:
    """Numbered rows as CSV that spreadsheet programs read: byte order mark, doubled quotes, CRLF."""
    out = numbered(rows, ["pos"]).select(F.col("engine").alias("﻿Engine"), F.col("index").alias("Index"), F.col("title").alias("Title"), F.col("url").alias("URL"), F.col("snippet").alias("Snippet"))
    out.write.option("header", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n").csv(path)


STREAMED = CRAWL + ", page_id long, query_id long, fetched_at timestamp"


def stream_crawl(spark: SparkSession, path: str) -> DataFrame:
    """Crawl records, with the time they were fetched, as a stream of JSON files."""
    return spark.readStream.schema(STREAMED).json(path)


def status_per_window(crawl: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Status counts per tumbling window, on a batch or a stream with fetched_at."""
    marked = crawl.withWatermark("fetched_at", late) if crawl.isStreaming else crawl
    out = status_counts(marked.withColumn("w", F.window("fetched_at", length)), ["w"])
    return out.select(F.col("w.start").alias("window_start"), "success", "failed", "skipped")
