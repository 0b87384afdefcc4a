"""A store of index tables whose repositories are replaced and deleted by one visible switch.

    <root>/<generation>/<table>/bucket=<hash part>/version=<batch>/…   rows of all versions of all repositories
    <root>/pointers/…                                                  (repository_id, version, deleted), a file a batch
    <root>/generations/…                                               (generation), a file each

A batch writes its rows under a version of its own into every table, and last one file of pointers: readers, who join the
newest pointer of each repository, see all of it or nothing.  Rows that no pointer names stay unseen, whether they were
replaced, deleted, or left by a batch that failed, until `compact` copies the visible rows to a new generation.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from codestrata.operators.ranking import cut

KEY = "repository_id"
# Folders of a table: repositories fall into buckets by a hash, so that their number does not grow with the repositories'.
BUCKETS = 64
POINTER, GENERATION, SCHEMA = f"{KEY} string, version string, deleted boolean", "generation string", "table_name string, json string"


def _rows(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of a folder, none if it is not there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _append(rows: DataFrame, path: str) -> None:
    """Adds one file: its rename is the moment at which readers begin to see it."""
    rows.coalesce(1).write.mode("append").parquet(path)


def _newest(spark: SparkSession, path: str, schema: str, column: str) -> str | None:
    return _rows(spark, path, schema).agg(F.max(column)).first()[0]


def _next(last: str | None) -> str:
    """A name that comes after `last` and that no other batch, even one that fails, has."""
    return f"{int((last or '0').split('-')[0]) + 1:012d}-{uuid.uuid4().hex}"


def _generation(spark: SparkSession, root: str) -> str:
    return _newest(spark, f"{root}/generations", GENERATION, "generation") or "first"


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """(repository_id, version, deleted): the newest pointer of every repository."""
    newest = F.max(F.struct("version", "deleted")).alias("p")
    return _rows(spark, f"{root}/pointers", POINTER).groupBy(KEY).agg(newest).select(KEY, "p.version", "p.deleted")


def _write(df: DataFrame, path: str, version: str | None = None) -> None:
    placed = df.withColumn("bucket", F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int"))
    placed = placed if version is None else placed.withColumn("version", F.lit(version))
    placed.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket", "version").parquet(path)


def write_tables(tables: dict[str, DataFrame], root: str, indexed: DataFrame) -> str:
    """Replaces the `indexed` repositories (column repository_id) in all `tables` at once, and returns the version.

    Every table needs the column repository_id, and none a column called bucket or version.  A repository that is indexed but has
    no rows in a table has none there afterwards; a table that is not given keeps none of its rows either.  One batch writes a
    root at a time; if it fails at any point, readers go on seeing what was there before.
    """
    spark = indexed.sparkSession
    version = _next(_newest(spark, f"{root}/pointers", POINTER, "version"))
    named = cut(indexed.select(KEY).distinct())
    generation = _generation(spark, root)
    known = {r.table_name: r.json for r in _rows(spark, f"{root}/schemas", SCHEMA).collect()}  # a row for each table
    new = [(name, df.schema.json()) for name, df in tables.items() if name not in known]
    if new:
        _append(spark.createDataFrame(new, SCHEMA), f"{root}/schemas")
    for name, df in tables.items():
        _write(df.join(named, KEY, "left_semi"), f"{root}/{generation}/{name}", version)
    _append(named.select(KEY, F.lit(version).alias("version"), F.lit(False).alias("deleted")), f"{root}/pointers")
    return version


def delete_repositories(deleted: DataFrame, root: str) -> None:
    """Hides all rows of the deleted repositories (column repository_id) in every table at once: one file of pointers."""
    spark = deleted.sparkSession
    version = _next(_newest(spark, f"{root}/pointers", POINTER, "version"))
    _append(deleted.select(KEY).distinct().select(KEY, F.lit(version).alias("version"), F.lit(True).alias("deleted")), f"{root}/pointers")


def table_names(spark: SparkSession, root: str) -> list[str]:
    return sorted(r.table_name for r in _rows(spark, f"{root}/schemas", SCHEMA).collect())


def _visible(spark: SparkSession, root: str, name: str, live: DataFrame, generation: str) -> DataFrame:
    own = _rows(spark, f"{root}/schemas", SCHEMA).where(F.col("table_name") == name).first()
    schema = StructType.fromJson(json.loads(own.json)).add("bucket", "integer").add("version", "string")
    every = _rows(spark, f"{root}/{generation}/{name}", schema)
    return every.join(live, [KEY, "version"], "left_semi")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The visible rows of one table."""
    return read_tables(spark, root, [name])[name]


def read_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The visible rows of several tables, all as of one moment: pointers are read once."""
    generation = _generation(spark, root)
    live = cut(pointers(spark, root).where("not deleted").select(KEY, "version"))
    return {name: _visible(spark, root, name, live, generation).drop("bucket", "version") for name in names or table_names(spark, root)}


def compact(spark: SparkSession, root: str) -> None:
    """Copies the visible rows of all tables to a new generation and drops the others, in jobs over all repositories.

    Readers that have begun see the old generation, which stays until the next call; older ones go, a folder each.
    """
    before = _generation(spark, root)
    after = _next(None if before == "first" else before)
    live = cut(pointers(spark, root).where("not deleted").select(KEY, "version"))
    for name in table_names(spark, root):
        _write(_visible(spark, root, name, live, before).drop("bucket"), f"{root}/{after}/{name}")
    _append(spark.createDataFrame([(after,)], GENERATION), f"{root}/generations")
    keep = {before, after, "pointers", "generations", "schemas"}
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in system.listStatus(top):
        if folder.getPath().getName() not in keep:
            system.delete(folder.getPath(), True)
