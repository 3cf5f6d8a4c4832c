"""A text classifier trained on labelled rows: hashed words and logistic regression, all in Spark."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F


def train_classifier(records: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14, rounds: int = 10):
    """A fitted pipeline; plug a larger model in with detect.register_scorer."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+", minTokenLength=1)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features)
    fit = LogisticRegression(featuresCol="_counts", labelCol=label, maxIter=rounds, regParam=0.01)
    return Pipeline(stages=[words, counts, fit]).fit(records.where(F.col(text).isNotNull() & F.col(label).isin(0, 1)))


def classify(model, records: DataFrame) -> DataFrame:
    """records with probability (of label 1) and prediction at 0.5."""
    out = model.transform(records).withColumn("_p", vector_to_array("probability")[1])
    return out.drop("_words", "_counts", "rawPrediction", "probability", "prediction").withColumn("prediction", (F.col("_p") >= 0.5).cast("int")).withColumnRenamed("_p", "probability")
