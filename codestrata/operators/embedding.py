"""Embedding a text column with every distinct text embedded once, and not again when it is known from before."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from codestrata.functions.vectors import EmbedBatch, bounded_batches

from .ranking import cut, union_all


def text_hash(text: Column, prefix: str = "") -> Column:
    return F.sha2(F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))), 256)


def embed_once(df: DataFrame, text_col: str, load: Callable[[], EmbedBatch], known: DataFrame | None = None, prefix: str = "",
               batch_size: int = 64) -> DataFrame:
    """`df` without its text, with text_hash and a unit-length `embedding`; every distinct text is embedded once.

    `load` makes the model and is called once in a Python worker, not once a task.  `known`(text_hash, embedding) are vectors
    of an earlier run with the same model and prefix: texts whose hash is there are not embedded again.
    """
    def make() -> Callable[[np.ndarray], np.ndarray]:
        batch = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            matrix = np.asarray(batch([prefix + t for t in texts.tolist()]), dtype=float)
            length = np.linalg.norm(matrix, axis=1, keepdims=True)
            return (matrix / np.where(length == 0, 1.0, length)).astype("float32")

        return predict

    model = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch_size)
    hashed = bounded_batches(df).withColumn("text_hash", text_hash(F.col(text_col), prefix))
    texts = hashed.groupBy("text_hash").agg(F.first(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    if known is None:
        made = cut(texts.select("text_hash", model("text").alias("embedding")))
    else:
        known = known.select("text_hash", "embedding").dropDuplicates(["text_hash"])
        new = cut(texts.join(known, "text_hash", "left_anti").select("text_hash", model("text").alias("embedding")))
        made = union_all(known.join(hashed.select("text_hash").distinct(), "text_hash", "left_semi"), new)
    return hashed.drop(text_col).join(made, "text_hash")
