"""Writing, replacing and deleting the tables of repositories: a folder per table, a partition per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = "repository_id"


def _partition(spark: SparkSession, path: str, repository: str | None):
    """(file system, path) of a repository's partition."""
    jvm = spark._jvm
    names = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    value = names.DEFAULT_PARTITION_NAME() if repository in (None, "") else names.escapePathName(repository)
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/{KEY}={value}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def replace_repositories(df: DataFrame, path: str, indexed: DataFrame | None = None, rows_per_file: int = 1_000_000) -> None:
    """Replaces the partitions of the `indexed` repositories (column repository_id) by the rows of `df`; others stay.

    Without `indexed`, the repositories in `df` are meant. One that has no rows any more loses its partition, after the
    new rows are in place. Rebalancing splits a large repository over many tasks and joins small ones.
    """
    (
        df.hint("rebalance", KEY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file).partitionBy(KEY).parquet(path)
    )
    if indexed is not None:
        emptied = indexed.select(KEY).distinct().join(df.select(KEY).distinct(), KEY, "left_anti")
        delete_repositories(df.sparkSession, [path], emptied)


def delete_repositories(spark: SparkSession, paths: list[str], deleted: DataFrame) -> None:
    """Removes the partitions of the deleted repositories (column repository_id) from every table in `paths`.

    One folder a repository and table: ids come to the driver one by one, rows never do.
    """
    for row in deleted.select(KEY).distinct().toLocalIterator():
        for path in paths:
            system, where = _partition(spark, path, row[KEY])
            system.delete(where, True)


def tables_under(spark: SparkSession, root: str) -> list[str]:
    """The folders of the tables stored under `root`."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    return [str(s.getPath().toString()) for s in top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top) if s.isDirectory()]


def without_repositories(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted repositories (column repository_id)."""
    gone = deleted.select("repository_id").distinct()
    return {
        name: df.join(gone.withColumnRenamed(KEY, "id"), "id", "left_anti") if name == "repositories"
        else df.join(gone, "repository_id", "left_anti")
        for name, df in tables.items()
    }
