"""Ranking within groups, and lineage cuts for results that several branches reuse."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Above this, Spark's partial group limit is not planned by default.
PARTIAL_LIMIT = 1000
# Input of a partition that `place` makes, partitions at most, and estimates that say nothing.
PARTITION_BYTES, MOST_PARTITIONS, UNKNOWN_BYTES = 64 << 20, 100_000, 1 << 60
# Stored bytes up to which `small` rows go to every task.
SMALL_BYTES = 4 << 20
# Rows of a task that `spread` and `fan_join` plan for.
SPREAD_ROWS, FAN_ROWS = 200_000, 2_000_000


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Keeps the first `k` rows of each group and numbers them from 1.

    Small `k`: Spark cuts every input partition to `k` rows per group before the shuffle, so a hot group never meets
    in one task. Large `k`: the same is done by hand, first within salted parts of a group.
    """
    final = Window.partitionBy(*keys).orderBy(*order)
    if k >= PARTIAL_LIMIT:
        part = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(64)))
            .withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k).drop("_r", "_part")
        )
    return df.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= k)


def place(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffles by `keys` into the configured number of partitions, or more where the input is large.

    The explicit count keeps adaptive execution from merging partitions by size: the stages that follow are heavy on
    work per byte (regular expressions, matrix products), so small partitions are wanted.
    """
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(configured, min(MOST_PARTITIONS, -(-input_bytes(df) // PARTITION_BYTES))), *keys)


def _partitions(df: DataFrame, rows: int, of: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, -(-rows // of)))


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Shuffles by `keys` into partitions of some SPREAD_ROWS rows, which adaptive execution does not merge.

    For rows that are few bytes at rest and many in memory: a table of five megabytes may hold a million of them, one task for
    its scan and for all that follows. `rows` are counted if not given, so what is spread should be stored.
    """
    return df.repartition(_partitions(df, df.count() if rows is None else rows, SPREAD_ROWS), *keys)


def fan_join(many: DataFrame, few: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Equi-join on `keys` that many rows of both sides share, in tasks that make some FAN_ROWS rows each.

    Rows of `many` are dealt by a hash of the column `by` into as many parts of their key as its result needs, and rows of `few`
    are sent to all of them; the result is not shuffled. Both sides are read twice.
    """
    count = F.count("*")
    sizes = small(many.groupBy(*keys).agg(count.alias("_many")).join(few.groupBy(*keys).agg(count.alias("_few")), keys)
                  .select(*keys, (F.col("_many") * F.col("_few")).alias("_made")))
    parts = _partitions(many, sizes.agg(F.sum("_made")).first()[0] or 0, FAN_ROWS)
    of_key = F.ceil(F.col("_made") / FAN_ROWS)
    dealt = many.join(sizes, keys).withColumn("_part", F.pmod(F.xxhash64(by), of_key).cast("int")).drop("_made")
    sent = few.join(sizes, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), of_key.cast("int") - 1))).drop("_made")
    cell = [*keys, "_part"]
    return dealt.repartition(parts, *cell).join(sent.repartition(parts, *cell).hint("merge"), cell).drop("_part")


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables `df` reads, as far as the optimizer knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN_BYTES)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name.

    Spark 4.1 may plan a union over inputs with one partitioning as a partition-wise merge; with adaptive execution the
    inputs can then differ in partition count, which fails or repeats rows. The setting is turned off for the session.
    """
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for other in others:
        first = first.unionByName(other)
    return first


def broadcasts_by_measure(spark: SparkSession) -> None:
    """Leaves automatic broadcasts to adaptive execution, which knows the bytes a stage wrote.

    A planned size rests on the bytes of compressed files and on twenty bytes a string: the text of a million files that is
    made from a table of five megabytes would be gathered by the driver.
    """
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")  # Spark's default is "10485760b"
    if not limit.startswith("-"):
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def checkpoint_location(spark: SparkSession) -> None:
    """Makes sure stored rows have a folder: the session's own, or a temporary one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="codestrata-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, which every executor can reach."""
    checkpoint_location(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes `df` as column files beside the checkpoints and reads it from there.

    Reused branches start from the stored rows and read only the columns they need. The files go when the session ends.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, "cut")
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def small(df: DataFrame) -> DataFrame:
    """Stored rows that a join sends to every task, unless more than SMALL_BYTES of them were stored.

    For tables with a row per repository or asked word. A shuffle by a few keys would put all rows of a key into one task, and
    adaptive execution keeps it: it takes no side for a broadcast of which most partitions are empty.
    """
    rows = cut(df)
    return F.broadcast(rows) if input_bytes(rows) <= SMALL_BYTES else rows


def dense_ids(df: DataFrame, order: list[str], start: int = 1, id_col: str = "id") -> DataFrame:
    """Consecutive ids in `order`, without a single-task sort.

    Rows are range-partitioned and numbered inside each partition; partition offsets come from one row per partition.
    The numbered rows are stored, so both uses see the same ranges even if an executor is lost.
    """
    placed = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    numbered = cut(
        placed.withColumn("_pid", F.spark_partition_id()).withColumn(
            "_row", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33)
        )
    )
    sizes = numbered.groupBy("_pid").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_pid", F.coalesce(before, F.lit(0)).alias("_offset"))
    return (
        numbered.join(F.broadcast(offsets), "_pid")  # one row per partition of this job
        .withColumn(id_col, F.col("_offset") + F.col("_row") + F.lit(start))
        .drop("_pid", "_row", "_offset")
    )


def stable_id(*columns: str) -> Column:
    """64-bit id from natural keys: needs no shuffle and survives re-indexing."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
