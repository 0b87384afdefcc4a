"""Corpus scans and file tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codestrata.functions import constants as C
from codestrata.functions.paths import is_ignored, is_source_language, language_of, module_of
from codestrata.operators.ranking import MOST_PARTITIONS, PARTITION_BYTES, cut, place, top_k, union_all

# Files that a task opens, at most on average.
FILES_AT_ONCE = 20_000


def _folder(root: str) -> tuple[FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return FileSystem.from_uri(root)
    return LocalFileSystem(), root


def _below(base: str, *names: str) -> str:
    return "/".join(x for x in (base.rstrip("/"), *names) if x)


def _children(root: str):
    """Rows of folders (path below the root) → rows of the folders in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _folder(root)
        for batch in batches:
            found = []
            for folder in batch.column(0).to_pylist():
                inside = system.get_file_info(FileSelector(_below(base, folder)))
                found += [_below(folder, i.base_name).lstrip("/") for i in inside if i.type == FileType.Directory]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["repository_id"])

    return run


ENTRY = "repository_id string, path string, size long"


def _entries(root: str, whole: bool):
    """Rows of folders (repository, path in it) → a row for every file in them, whatever its name, and for every folder, without a
    size; with `whole`, rows of the files of all folders below instead.  A task holds the entries of one folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _folder(root)
        for batch in batches:
            for repository, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting = [first]
                while waiting:
                    folder = waiting.pop()
                    inside = system.get_file_info(FileSelector(_below(base, repository, folder)))
                    folders = [_below(folder, i.base_name).lstrip("/") for i in inside if i.type == FileType.Directory]
                    files = [(_below(folder, i.base_name).lstrip("/"), i.size) for i in inside if i.type == FileType.File]
                    if whole:
                        waiting += folders
                    else:
                        files += [(name, None) for name in folders]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([repository] * len(files), pa.string()), pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64())],
                        ["repository_id", "path", "size"])

    return run


def _opened(root: str):
    """Adds the text of every file, one file a batch: a task holds one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _folder(root)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                with system.open_input_stream(_below(base, row.column(0)[0].as_py(), row.column(1)[0].as_py())) as file:
                    text = file.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([text], pa.string())], ["repository_id", "path", "size", "content"])

    return run


def folders_below(spark: SparkSession, root: str, depth: int, spread: int) -> tuple[DataFrame, DataFrame]:
    """The files met on the way, and the folders `spread` levels below the repositories: rows (repository_id, path), dealt out."""
    repositories = spark.createDataFrame([("",)], "repository_id string")
    for _ in range(depth):
        repositories = place(repositories.mapInArrow(_children(root), "repository_id string"), "repository_id")
    folders, files = repositories.select("repository_id", F.lit("").alias("path")), spark.createDataFrame([], ENTRY)
    for _ in range(spread):
        entries = cut(folders.mapInArrow(_entries(root, False), ENTRY))
        files = union_all(files, entries.where(F.col("size").isNotNull()))
        folders = place(entries.where(F.col("size").isNull()).select("repository_id", "path"), "repository_id", "path")
    return files, folders


def list_corpus(spark: SparkSession, root: str, depth: int = 1, spread: int = 2) -> DataFrame:
    """(repository_id, path, size) of every file under `root`, whose first `depth` directory levels name the repository.

    Folders are listed in tasks, one folder a row down to `spread` levels below a repository, so that a large repository is
    many rows. Names that begin with a dot or an underscore count like others.
    """
    files, folders = folders_below(spark, root, depth, spread)
    return union_all(files, folders.mapInArrow(_entries(root, True), ENTRY))


def scan_corpus(spark: SparkSession, root: str, depth: int = 1, max_bytes: int | None = None, where: Column | str | None = None,
                content: bool = True, spread: int = 2) -> DataFrame:
    """Raw files under `root`: (repository_id, path, size, content), `depth` and `spread` as in `list_corpus`.

    The listing is stored; `where`, a condition on repository_id, path and size, and `max_bytes` are pushed into its scan, and
    files that don't meet them are not opened; without `content` none is. Files are opened in tasks of PARTITION_BYTES or
    FILES_AT_ONCE files. Bytes that are not UTF-8 become replacement characters.
    """
    files = cut(list_corpus(spark, root, depth, spread))
    if max_bytes is not None:
        files = files.where(F.col("size") <= max_bytes)
    if where is not None:
        files = files.where(where)
    if not content:
        return files
    count, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(configured, min(MOST_PARTITIONS, max(-(-size // PARTITION_BYTES), -(-count // FILES_AT_ONCE))))
    return files.repartition(tasks, "repository_id", "path").mapInArrow(_opened(root), "repository_id string, path string, size long, content string")


def write_corpus(files: DataFrame, root: str) -> int:
    """Writes files(repository_id, path, content) under `root`/repository_id/path; returns their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _folder(root)
        for batch in batches:
            for repository, path, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                where = f"{base}/{repository}/{path}"
                system.create_dir(where.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(where) as file:
                    file.write((content or "").encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("repository_id", "path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def discover(raw: DataFrame, max_bytes: int | None = None, max_files: int | None = None) -> DataFrame:
    """Keeps files of a known language outside ignored places; adds language, is_source and module.

    raw(repository_id, path, size, …). `max_bytes` leaves out larger files, `max_files` keeps the first files of each
    repository in path order.
    """
    kept = raw.where(~is_ignored(F.col("path"))).withColumn("language", language_of(F.col("path")))
    kept = kept.where(F.col("language").isNotNull() & (F.col("size") > 0))
    if max_bytes is not None:
        kept = kept.where(F.col("size") <= max_bytes)
    if max_files is not None:
        slim = top_k(kept.select("repository_id", "path"), ["repository_id"], [F.asc("path")], max_files, "_r").drop("_r")
        kept = kept.join(slim, ["repository_id", "path"], "left_semi")
    return kept.withColumn("is_source", is_source_language(F.col("language"))).withColumn("module", module_of(F.col("path")))


def file_table(discovered: DataFrame) -> DataFrame:
    """The `files` table of discovered files that carry content."""
    return discovered.select(
        "repository_id", "path", "language", "module", F.col("size").cast("long").alias("size"),
        F.size(F.split("content", "\n")).cast("long").alias("line_count"),
    )


def file_outline(wanted: DataFrame, file_text: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Content of the wanted (repository_id, path), and their entities by line without chunks, docs and config."""
    key = ["repository_id", "path"]
    content = file_text.join(wanted.select(*key).distinct(), key, "left_semi")
    listed = entities.where(~F.col("symbol_type").isin(*C.NON_OUTLINE_TYPES)).select(
        "repository_id", F.col("file_path").alias("path"), "id", "symbol_name", "symbol_type", "start_line", "end_line",
        "parent", "route",
    )
    outline = listed.join(wanted.select(*key).distinct(), key, "left_semi").orderBy(*key, "start_line", "id")
    return content, outline
