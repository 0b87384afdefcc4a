"""Column functions and batch functions over dense vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import constants as C

EmbedBatch = Callable[[list[str]], np.ndarray]
# Bytes of a batch of texts that goes to a worker, which holds it several times and a matrix of its rows.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, with the session's limit of a batch at BATCH_BYTES: rows of whole files would be 64 MB a batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(vector: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays zero."""
    length = norm(vector)
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def cosine(left: Column, right: Column) -> Column:
    return F.try_divide(dot(left, right), norm(left) * norm(right))


def hashed_terms(dimensions: int = C.EMBEDDING_DIMENSIONS) -> EmbedBatch:
    """Batch function: signed feature hashing of the lower-case words of each text. Deterministic, no model needed."""

    known: dict[str, tuple[int, float]] = {}  # places of words this task has met, some 25 MB at most

    def place(word: str) -> tuple[int, float]:
        digest = hashlib.md5(word.encode()).hexdigest()
        return int(digest[:7], 16) % dimensions, 1.0 if digest[7] < "8" else -1.0

    def embed(texts: list[str]) -> np.ndarray:
        rows, columns, signs = [], [], []
        for row, text in enumerate(texts):
            for word in re.findall(r"[a-z0-9]+", text.lower()):
                at = known.get(word)
                if at is None:
                    if len(known) >= 100_000:
                        known.clear()
                    at = known[word] = place(word)
                rows.append(row)
                columns.append(at[0])
                signs.append(at[1])
        out = np.zeros((len(texts), dimensions))
        np.add.at(out, (rows, columns), signs)
        return out

    return embed


def embed(df: DataFrame, text_col: str, embed_batch: EmbedBatch | None = None, out_col: str = "embedding",
          prefix: str = "", batch_size: int = 64) -> DataFrame:
    """Adds a unit-length vector of `text_col`. `embed_batch` turns a list of texts into a matrix.

    The function runs in Arrow batches inside the tasks; a model it closes over is loaded once per worker.
    """
    batch = embed_batch or hashed_terms()

    @F.pandas_udf("array<float>")
    def run(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in chunks:
            rows: list[np.ndarray] = []
            for at in range(0, len(texts), batch_size):
                part = [prefix + (t or "") for t in texts.iloc[at:at + batch_size]]
                matrix = np.asarray(batch(part), dtype=float)
                length = np.linalg.norm(matrix, axis=1, keepdims=True)
                rows.extend((matrix / np.where(length == 0, 1.0, length)).astype("float32"))
            yield pd.Series(rows, index=texts.index)

    return bounded_batches(df).withColumn(out_col, run(F.col(text_col)))


def embed_questions(df: DataFrame, text_col: str, embed_batch: EmbedBatch | None = None, out_col: str = "embedding",
                    prefix: str = C.QUERY_PREFIX) -> DataFrame:
    return embed(df, text_col, embed_batch, out_col, prefix)
