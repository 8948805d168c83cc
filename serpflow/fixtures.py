"""Views of the given tables that the registered queries run on: result rows, queries, sources, crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_QUERY = 400


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, engine, pos, title, url, snippet: each document as a row of a result page.  Twenty engines
    and up to twenty rows for each query, so groups grow in number with the table, not in size."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_replace("text", r"\s+", " ").alias("t"))
    k = F.expr("20 * (doc_id DIV 40) + doc_id % 20")
    return d.select(
        F.expr(f"doc_id DIV {PER_QUERY}").alias("query_id"),
        F.col("source").alias("engine"),
        F.col("doc_id").alias("pos"),
        F.trim(F.substring("t", 1, 60)).alias("title"),
        F.concat(F.lit("https://site"), k % 7, F.lit(".example.org/d/"), k).alias("url"),
        F.trim(F.expr("substring(t, 61)")).alias("snippet"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: the whole text of a benchmark item for every query id of results()."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("query"))
    ids = read(spark, sf_dir, "documents").select(F.expr(f"doc_id DIV {PER_QUERY}").alias("query_id")).distinct()
    n = items.agg(F.count("*").alias("n_items"))
    return ids.join(F.broadcast(n)).withColumn("item_id", F.expr("query_id % n_items")).join(items, "item_id").select("query_id", "query")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, name, url, speed: a registry made of the nations; every third url lacks the query's place."""
    n = read(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("int").alias("ord"),
        F.lower("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/"))).otherwise(F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/find?q={query}&again={query}"))).alias("url"),
        F.when(F.col("n_nationkey") % 5 == 4, F.lit(None)).otherwise(F.col("n_nationkey") % 10).cast("int").alias("speed"),
    )


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """engine, url, query, html, status, error, page_id: pages as crawl records, some failed."""
    p = read(spark, sf_dir, "pages")
    k = F.col("page_id") % 7
    return p.select(
        F.concat(F.lit("src"), F.col("page_id") % 20).alias("engine"), "url", F.lit("q").alias("query"),
        F.when(k == 3, "").otherwise(F.col("html")).alias("html"),
        F.when(k == 1, "http_error").when(k == 2, "timeout").when(k == 4, "skipped").otherwise("success").alias("status"),
        F.when(k.isin(1, 2), F.concat(F.lit("failed: "), F.col("html"))).otherwise("").alias("error"), "page_id",
    )


RESULTS_SQL = f"""results AS (SELECT doc_id // {PER_QUERY} AS query_id, source AS engine, doc_id AS pos, trim(substring(t, 1, 60)) AS title,
  'https://site' || (k % 7) || '.example.org/d/' || k AS url, trim(substring(t, 61)) AS snippet
  FROM (SELECT *, regexp_replace(text, '\\s+', ' ', 'g') AS t, 20 * (doc_id // 40) + doc_id % 20 AS k FROM documents))"""
QUERIES_SQL = f"""queries AS (SELECT query_id, trim(regexp_replace(b.text, '\\s+', ' ', 'g')) AS query FROM (SELECT DISTINCT doc_id // {PER_QUERY} AS query_id FROM documents) i
  JOIN benchmark b ON b.item_id = i.query_id % (SELECT count(*) FROM benchmark))"""
SOURCES_SQL = """sources AS (SELECT CAST(n_nationkey AS INT) AS ord, lower(n_name) AS name,
  CASE WHEN n_nationkey % 3 = 0 THEN 'https://' || lower(n_name) || '.example/' ELSE 'https://' || lower(n_name) || '.example/find?q={query}&again={query}' END AS url,
  CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE CAST(n_nationkey % 10 AS INT) END AS speed FROM nation)"""
CRAWL_SQL = """crawl AS (SELECT 'src' || (page_id % 20) AS engine, url, 'q' AS query, CASE WHEN page_id % 7 = 3 THEN '' ELSE html END AS html,
  CASE page_id % 7 WHEN 1 THEN 'http_error' WHEN 2 THEN 'timeout' WHEN 4 THEN 'skipped' ELSE 'success' END AS status,
  CASE WHEN page_id % 7 IN (1, 2) THEN 'failed: ' || html ELSE '' END AS error, page_id FROM pages)"""
