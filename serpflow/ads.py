"""Advertising score: a trained text model beside the rules, and the filter that joins both."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import DEFAULT, Profile, ad_rule_score, model_score
from .store import drop_path, drop_table, shared_dir, table
from .text import join_item
from .tfidf import WORDS, Analyzer

#: CountVectorizer wants a number; this one leaves no term out.
ALL_TERMS = (1 << 31) - 1


@dataclass(frozen=True)
class AdModel:
    """A trained model, frozen: it can be saved, loaded, and put to use on a stream."""

    count: CountVectorizerModel
    rest: PipelineModel
    a: Analyzer

    def save(self, path: str) -> None:
        """Write the model below a folder that all executors share; one already there is replaced."""
        self.count.write().overwrite().save(f"{path}/count")
        self.rest.write().overwrite().save(f"{path}/rest")
        SparkSession.active().createDataFrame([(json.dumps(asdict(self.a)),)], "analyzer string").coalesce(1).write.mode("overwrite").json(f"{path}/analyzer")

    @staticmethod
    def load(path: str) -> AdModel:
        given = json.loads(SparkSession.active().read.schema("analyzer string").json(f"{path}/analyzer").first()[0])
        return AdModel(CountVectorizerModel.load(f"{path}/count"), PipelineModel.load(f"{path}/rest"), Analyzer(**given | {"stop": tuple(given["stop"])}))

    def vectors(self, rows: DataFrame) -> DataFrame:
        """Add _tf, the counts of text's terms as they weigh."""
        x = self.count.transform(rows.withColumn("_grams", self.a.terms(F.coalesce("text", F.lit("")))))
        if not self.a.sublinear:
            return x
        return x.withColumn("_tf", array_to_vector(F.transform(vector_to_array("_tf"), lambda n: F.when(n > 0, 1 + F.log(n)).otherwise(0.0))))


def _frozen(model: PipelineModel) -> PipelineModel:
    """The model as it is when loaded.  A model just trained holds a summary with the session, goes to every task with
    it, and can't once the session has observed a DataFrame."""
    spark = SparkSession.active()
    path = f"{shared_dir(spark)}/ad_model-{uuid.uuid4().hex}"
    model.write().save(path)
    out = PipelineModel.load(path)
    drop_path(spark, path)
    return out


def train_ad_model(labelled: DataFrame, a: Analyzer = WORDS, c: float = 1.0, iterations: int = 1000) -> AdModel:
    """Logistic regression with an L2 penalty and balanced classes on unit TF-IDF vectors of labelled rows
    (text, label 0 or 1; rows without a label are left out).  Both classes must occur.  Counts are written
    once, and all that is learned from them reads those."""
    rows = labelled.filter("label is not null")
    counts = {r["label"]: r["count"] for r in rows.groupBy(F.col("label").cast("int").alias("label")).count().collect()}
    if set(counts) != {0, 1}:
        raise ValueError(f"both classes are needed, got {counts}")
    n = sum(counts.values())
    rows = rows.withColumn("label", F.col("label").cast("double")).withColumn("_weight", F.when(F.col("label") == 1, n / 2 / counts[1]).otherwise(n / 2 / counts[0]))
    grams = rows.withColumn("_grams", a.terms(F.coalesce("text", F.lit(""))))
    count = CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=a.cap or ALL_TERMS, minDF=1).fit(grams)
    tf = table(AdModel(count, None, a).vectors(rows).select("label", "_weight", "_tf"), "counts")
    idf = IDF(inputCol="_tf", outputCol="_x").fit(tf).idf.toArray() + 1
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_weighed")
    unit = Normalizer(p=2.0, inputCol="_weighed", outputCol="_unit")
    fit = LogisticRegression(featuresCol="_unit", labelCol="label", weightCol="_weight", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_y", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-9)
    rest = _frozen(Pipeline(stages=[scale, unit, fit]).fit(tf))
    drop_table(tf)
    return AdModel(count, rest, a)


def labelled_union(ads: DataFrame, normal: DataFrame) -> DataFrame:
    """text, label of two corpora (text): advertising and not."""
    return ads.select("text", F.lit(1).alias("label")).unionByName(normal.select("text", F.lit(0).alias("label")))


def score_ads(rows: DataFrame, model: AdModel) -> DataFrame:
    """Add probability, that a row's text is advertising; terms not met in training count for nothing."""
    scored = model.rest.transform(model.vectors(rows))
    return scored.select(*rows.columns, vector_to_array("_p")[1].alias("probability"))


def ad_score(rows: DataFrame, model: AdModel | None, p: Profile = DEFAULT) -> DataFrame:
    """Add probability, score and ad to rows (title, url, snippet): the profile's points for words, the URL, urgency
    and the model's probability; enough of them make an advertisement.  An empty text never is one.  Without a model
    the rules alone decide and probability is null."""
    parts = ad_rule_score(F.col("title"), F.col("snippet"), F.col("url"), p)
    x = rows.withColumn("text", join_item(F.col("title"), F.col("snippet")))
    x = score_ads(x, model) if model else x.withColumn("probability", F.lit(None).cast("double"))
    points = parts["rule"] + parts["link"] + parts["urgency"] + F.when(F.col("probability").isNull(), 0).otherwise(model_score(F.col("probability"), p))
    x = x.withColumn("score", F.when(F.trim("text") == "", 0).otherwise(points))
    return x.drop("text").withColumn("ad", F.col("score") >= p.ad_cut)


def drop_ads(rows: DataFrame, model: AdModel | None, p: Profile = DEFAULT) -> DataFrame:
    """Rows that are no advertising; sources.bundles() keeps engines that lose all their rows."""
    return ad_score(rows, model, p).filter("not ad").select(rows.columns)
