"""Corpus preparation: toxicity, quality, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
their input.  A stage works on all rows its predecessor kept.  Null, empty and repeated rows pass through
the stages as the operators define it; columns with any other names are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serpflow.llm import op3_toxicity, op4_preference, op5_jaccard_join, op8_mixing, op10_packing
from serpflow.llm.common import fresh, read, shared_dir

WEIGHTS, CAP, SEQUENCE = (5.0, 2.0, 1.0), 3.0, 2048


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon does not call toxic."""
    lexicon = op3_toxicity.learn(op3_toxicity.train_rows(docs), read(spark, sf_dir, "labels"))
    return docs.filter(op3_toxicity.toxicity(F.col("text"), lexicon) < 0.7)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking puts above its cut."""
    model = op4_preference.learn(op3_toxicity.train_rows(docs), read(spark, sf_dir, "labels"))
    return docs.filter(op4_preference.quality(F.col("text"), model) >= 0.5)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near duplicates (five-word shingles, Jaccard
    0.8).  Rows repeated under one id are one document; rows without an id stay."""
    classes = op5_jaccard_join.jaccard_classes(docs, k=5, num=80, den=100)
    gone = classes.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.dropDuplicates(["doc_id"]).filter("doc_id is not null").join(gone, "doc_id", "left_anti").select(docs.columns).unionByName(docs.filter("doc_id is null"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows without an id can't be told apart and stay once."""
    times, key, size = (fresh(docs, k) for k in ("times", "key", "size"))
    mix = op8_mixing.mix(docs, list(WEIGHTS), CAP)
    # rows of one id have come to be one in the stage before
    taken = mix.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)).cast("int").alias(times))
    taken = taken.filter(F.col(times) > 0).withColumnRenamed("doc_id", key)
    out = docs.join(taken, F.col("doc_id") == F.col(key)).withColumn(size, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training sequence."""
    return op10_packing.pack_documents(docs, size=SEQUENCE)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", one_of_each_group), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    import uuid

    out, at = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, out, sf_dir).write.parquet(f"{at}/{name}")
        out = spark.read.parquet(f"{at}/{name}")
    return out


#: Verdicts of trained models can't be put in SQL; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None
