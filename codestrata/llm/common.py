"""Helpers the operators of this folder share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ranking import scratch_folder

Batches = Iterator[pa.RecordBatch]


def slices(batches: Batches, rows: int = 1000) -> Batches:
    """The same rows in smaller batches: texts become Python objects a few megabytes at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker has made under `key` in this or an earlier task: tables that depend on a file, not on the rows.

    Functions reach the workers by value, and their globals with them anew for every task; a module of its own stays.
    """
    own = sys.modules.setdefault("_codestrata_kept", ModuleType("_codestrata_kept")).__dict__
    if key not in own:
        own[key] = make()
    return own[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str = "llm") -> DataFrame:
    """Writes `df` as column files beside the checkpoints and reads it back.

    Cuts the lineage, so a lost executor costs no more than the tasks it ran.  The folder goes when the session ends.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, name)
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def whole(text: str) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


#: Bytes of a batch that goes to a task's Python, at most: texts are long, and the default of 64 MB is held several times.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, with the session's limit of a batch set to BATCH_BYTES."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Only what an operator reads, under its own names: other columns of the input can't clash."""
    return bounded_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; rows without an id count as remainder 0 of their empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def known_labels(labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    """doc_id and label of all labels of 0 or 1 whose id has another remainder than `held_out`; the largest of an id's."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
            .where((F.col("label").isin(0, 1)) & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held_out))
            .groupBy("doc_id").agg(F.max("label").alias("label")))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, label of at most `rows` labelled documents whose id has another remainder than `held_out`.

    Drawn evenly by a hash of the id, so only the ids of about `rows` rows are ever sorted, and only texts of the drawn
    documents leave the scan.  Repeated labels of a document count once, by the largest.
    """
    known = known_labels(labels, label, modulus, held_out)
    share = min(1.0, 1.1 * rows / max(1, labels.count()))
    drawn = (known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    sample = documents(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id")  # at most `rows` ids
    return stored(sample.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label").dropDuplicates(["doc_id"]), "sample")
