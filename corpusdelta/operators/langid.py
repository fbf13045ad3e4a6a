"""Language identification (M18, P24), re-aimed onto MLlib: character
trigram hashing features and a multinomial Naive Bayes trained on documents
with a known language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _chars(col):
    # lowercase characters with spaces marked, as an array for NGram
    return F.split(F.regexp_replace(F.lower(col), r"\s+", "_"), "")


def train_language_id(docs: DataFrame, text: str = "text", lang: str = "lang", num_features: int = 1 << 16):
    """Fit the pipeline; returns (model, label names)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import HashingTF, NGram, StringIndexer
    d = docs.select(_chars(F.col(text)).alias("_c"), F.col(lang).alias("_lang"))
    pipe = Pipeline(stages=[StringIndexer(inputCol="_lang", outputCol="_y"),
                            NGram(n=3, inputCol="_c", outputCol="_g"),
                            HashingTF(inputCol="_g", outputCol="_x", numFeatures=num_features),
                            NaiveBayes(featuresCol="_x", labelCol="_y", modelType="multinomial")])
    model = pipe.fit(d)
    return model, model.stages[0].labels


def predict_language(model, labels, df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``pred_lang``."""
    d = df.withColumn("_c", _chars(F.col(text)))
    out = model.transform(d.withColumn("_lang", F.lit(labels[0])))
    names = F.array(*[F.lit(x) for x in labels])
    return out.withColumn("pred_lang", F.element_at(names, F.col("prediction").cast("int") + 1)) \
        .drop("_c", "_lang", "_y", "_g", "_x", "rawPrediction", "probability", "prediction")


def english_sentences(model, labels, sentences: DataFrame, text: str = "sentence", keep: str = "en") -> DataFrame:
    """Keep sentences predicted as ``keep``."""
    return predict_language(model, labels, sentences, text).filter(F.col("pred_lang") == keep)
