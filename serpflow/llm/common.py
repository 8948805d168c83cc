"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serpflow.store import drop_table, shared_dir, table  # noqa: F401 - the operators take them from here

#: A word, wherever an operator counts words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def fold_of(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % k, F.lit(0))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable from each node of an undirected edge list (a, b).

    Alternates the large-star and small-star steps of the published MapReduce algorithm until no edge
    changes.  Each step is a grouped minimum and a join on the node, so a node of very high degree is
    reduced map-side and its edges may be split among tasks; nothing is collected but two sums a round.
    Nodes without edges do not appear.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        j = both.join(low, "a")
        if large:
            out = j.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    current = table(edges.select("a", "b").filter("a <> b").distinct(), name)
    seen = None
    while True:
        nxt = table(star(star(current, True), False), name)
        drop_table(current)
        current = nxt
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
