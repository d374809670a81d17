"""Text to vector: a hashed TF-IDF pipeline, and a hook for a user's own model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashed_pipeline(text: str, width: int, ngram: int = 2) -> Pipeline:
    """Words and word n-grams hashed to ``width`` weights, IDF-weighted, unit length."""
    both = "SELECT *, concat(_words, _grams) AS _terms FROM __THIS__"
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{M}\p{N}]+"),
            NGram(n=ngram, inputCol="_words", outputCol="_grams"),
            SQLTransformer(statement=both),
            HashingTF(numFeatures=width, inputCol="_terms", outputCol="_tf"),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="_unit"),
        ]
    )


def fit_hashed(df: DataFrame, text: str, width: int, ngram: int = 2) -> PipelineModel:
    return hashed_pipeline(text, width, ngram).fit(df)


def encode_hashed(df: DataFrame, model: PipelineModel, out: str = "vector") -> DataFrame:
    coded = model.transform(df).withColumn(out, vector_to_array("_unit", "float32"))
    return coded.drop(*[c for c in coded.columns if c.startswith("_")])


def encode_with(
    df: DataFrame,
    text: str,
    make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
    batch_size: int = 32,
    out: str = "vector",
) -> DataFrame:
    """Vectors from a user's model; it is loaded once per Python worker.

    ``make_predict_fn`` returns a function from a batch of texts to a matrix with
    one row per text.
    """
    encode = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    return df.withColumn(out, encode(F.col(text)))

