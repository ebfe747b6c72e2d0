"""ML-1: two-class text classifier with spark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.sql import Column, DataFrame, functions as F


def split_train_test(df: DataFrame, key: str, train_share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Stable split by a hash of the key: reruns and lost executors give the same rows."""
    held = held_out(key, train_share)
    return df.filter(~held), df.filter(held)


def held_out(key: str, train_share: float = 0.8) -> Column:
    """Whether a key falls into the test part, by 32 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(bits, F.lit(1000)) >= int(train_share * 1000)


def evaluate(predicted: DataFrame, key: str, label: str = "label", train_share: float = 0.8) -> DataFrame:
    """ML-1: rows, accuracy and the share of the commonest label, for the training and the held-out part."""
    right = (F.col(label) == F.col("prediction")).cast("double")
    by_label = predicted.groupBy(held_out(key, train_share).alias("held_out"), label).agg(
        F.count(F.lit(1)).alias("n"), F.sum(right).alias("right"))
    return by_label.groupBy("held_out").agg(
        F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("accuracy"), (F.max("n") / F.sum("n")).alias("majority"))


def train(examples: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16) -> PipelineModel:
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features)
    weights = IDF(inputCol="_counts", outputCol="features")
    model = LogisticRegression(labelCol=label, featuresCol="features", maxIter=20, regParam=0.01)
    return Pipeline(stages=[words, counts, weights, model]).fit(examples)


def predict(model: PipelineModel, examples: DataFrame) -> DataFrame:
    scored = model.transform(examples)
    return scored.drop("_words", "_counts", "features", "rawPrediction", "probability")
