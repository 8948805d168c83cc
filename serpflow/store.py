"""Intermediate tables in the folder that all executors share, and what is worked out over them in rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a session of one machine without it, a folder below the warehouse."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: the plan before it runs a single time, and lost executors cost none of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._serpflow_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove what was written under a path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(df: DataFrame) -> None:
    """Remove a table() that no later plan reads."""
    path = getattr(df, "_serpflow_path", None)
    if path:
        drop_path(df.sparkSession, path)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (smallest node reachable) of an undirected edge list (a, b); nodes without an edge don't
    appear.

    Rounds of large and small stars until no edge changes, each a grouped minimum that is combined map-side
    and a join; only a count and a checksum come to the driver.
    """
    current, seen = table(edges.select("a", "b").filter("a <> b").distinct(), name), None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.withColumnRenamed("m", "b"))
        after = table(small.filter("a <> b").distinct(), name)
        drop_table(current)
        current = after
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
