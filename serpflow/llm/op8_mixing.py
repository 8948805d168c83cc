"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document gets the exponential key -ln(u) / w with u a hash of its id in (0, 1) and w a quality weight.
A source's budget is filled by whole epochs first; what is left of it goes to the documents of smallest key,
by a prefix sum of their sizes.  The prefix sum has two levels: keys fall into buckets in key order, the
buckets' totals are summed per source, and only the bucket in which a budget ends is put in order row by
row.  A source of n rows has about sqrt(n) buckets of about sqrt(n) rows, so no task orders more than that.

Defined results: a null or blank text has size 0 and is taken 0 times; null is a source of its own, the
last; a source without words has target 0; repeated rows are sampled as rows of their own, with ties in key
broken by doc_id and size; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, words


def quality_weight(text: Column) -> Column:
    """In [0.05, 1]: falls with the share of symbols that prose does not have."""
    symbols = F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    share = symbols / F.greatest(F.char_length(text), F.lit(1))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(10.0) * F.coalesce(share, F.lit(0.0)))


def targets(sources: DataFrame, weights: list[float], cap: float = 3.0) -> DataFrame:
    """Add target to one row per source (source, source_size).

    Weights go round by code point of the source, null last.  The shares sum to all sizes; a target above
    cap times its source's size stops there and the excess is shared again by weight.  That is the level L
    with target = min(cap * size, L * weight): sources are capped in order of cap * size / weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    s = s.withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source whose share at its level fits sets the level of all
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.row_number().over(order).alias("k"), F.col("level").alias("v")))).over(everything)["v"])
    return s.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).cast("double").alias("target"))


def mix(docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), cap: float = 3.0, seed: int = 11, bucket: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken for every document (doc_id, source, text).
    bucket: about so many rows in a bucket of keys; without it, the square root of the source's rows."""
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    d = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), (-F.log(u) / quality_weight(F.coalesce("text", F.lit("")))).alias("key"))
    d = table(d, "sizes")
    sources = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(sources.drop("n"), list(weights), cap).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = goal.join(sources.select(F.col("source").alias("_s"), "n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    goal = goal.withColumn("buckets", F.ceil(F.col("n") / bucket if bucket else F.sqrt("n"))).withColumnRenamed("source", "_s")
    goal = table(goal, "goals")
    d = d.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # monotone in the key and about even: the key is exponential
    d = d.withColumn("b", F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")).cast("long"))
    sums = d.groupBy("source", "b").agg(F.sum("size").alias("bucket_size"), F.first("rest").alias("bucket_rest"))
    run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(run), F.lit(0)))
    sums = sums.withColumn("whole", F.col("before") + F.col("bucket_size") <= F.col("bucket_rest")).withColumn("none", F.col("before") >= F.col("bucket_rest"))
    sums = sums.select(F.col("source").alias("_s"), F.col("b").alias("_b"), "before", "whole", "none")
    d = d.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("b") == F.col("_b"))).drop("_s", "_b")
    within = Window.partitionBy("source", "b").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = d.filter("not whole and not none").withColumn("sum_before", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    # the document in which the budget ends is taken if that ends nearer to it
    edge = edge.withColumn("extra", (F.col("sum_before") + F.col("size") / 2 <= F.col("rest")).cast("long")).drop("sum_before")
    clear = d.filter("whole or none").withColumn("extra", F.col("whole").cast("long"))
    out = clear.unionByName(edge)
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("size") * (F.col("epochs") + F.col("extra"))).alias("taken"))
