"""Indexing a corpus: raw files to the tables every question is asked of."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codestrata.functions import constants as C
from codestrata.functions.paths import is_ignored_folder
from codestrata.operators import architecture, chunks, extract, resolve, search, stats
from codestrata.operators.ranking import broadcasts_by_measure, cut, stable_id, union_all
from codestrata.sources import files as file_source, versions

from .search import embed_entities

STAGING = ["repository_id", "file_path", "symbol_name", "symbol_type", "language", "start_line", "end_line", "content", "parent",
           "exported", "route", "calls", "handler"]


def staging_entities(texts: DataFrame) -> DataFrame:
    """Definitions and module code of parsed languages, chunks of all other files.

    texts(repository_id, path, language, content).
    """
    parsed_files = texts.where(F.col("language").isin(*extract.PARSED))
    parsed = cut(extract.extract_entities(parsed_files))  # rows of its own, ranges and counts for the module code
    modules = chunks.module_entities(parsed_files, parsed)
    cut_files = chunks.chunk_files(texts.where(~F.col("language").isin(*extract.PARSED)))
    none = F.lit(None).cast("string")
    pieces = cut_files.withColumn("parent", none).withColumn("exported", F.lit(False)).withColumn("route", none).withColumn(
        "calls", F.array().cast("array<string>")).withColumn("handler", none)
    return union_all(parsed.select(*STAGING), modules.select(*STAGING), pieces.select(*STAGING))


def index_corpus(raw: DataFrame, embed_batch=None, max_files: int | None = None, stem: str | None = C.TEXT_LANGUAGE, load=None,
                 known: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of the repositories in raw(repository_id, path, size, content).

    A model is given as `embed_batch`, or as `load`, which makes it: then equal texts are embedded once, and not at all if
    `known`, the stored embeddings of an earlier run with that model, holds them.

    Entities and specifiers are stored once at the checkpoint folder, since every later table starts from them.
    """
    broadcasts_by_measure(raw.sparkSession)
    found = file_source.discover(raw, max_files=max_files)
    texts = found.select("repository_id", "path", "language", "module", "size", "content")
    files = file_source.file_table(texts)

    specs = cut(extract.extract_imports(texts))
    paths = files.select("repository_id", "path")
    file_imports = resolve.resolve_imports(specs, paths)

    per_file = specs.groupBy("repository_id", "file_path").agg(F.sort_array(F.collect_set("spec")).alias("imports"))  # one file's
    modules = files.select("repository_id", F.col("path").alias("file_path"), "module")
    staged = staging_entities(texts).withColumn("id", stable_id("repository_id", "file_path", "start_line", "symbol_name", "symbol_type"))
    staged = staged.join(modules, ["repository_id", "file_path"]).join(per_file, ["repository_id", "file_path"], "left")
    staged = cut(staged)
    entities = staged.drop("calls", "handler")
    relationships = resolve.resolve_calls(resolve.call_sites(staged), entities, file_imports)
    return {
        "files": files, "file_text": texts.select("repository_id", "path", "content"), "code_entities": entities,
        "relationships": relationships, "file_imports": file_imports, "embeddings": embed_entities(entities, embed_batch, load, known),
        "postings": search.postings(entities, stem),
    }


def repository_facts(tables: dict[str, DataFrame], raw: DataFrame) -> dict[str, DataFrame]:
    """Statistics of indexed repositories, one table per kind of fact.

    Files are counted outside ignored places, whatever their size or kind; frameworks come from the indexed texts.
    """
    files, entities = tables["files"], tables["code_entities"]
    seen = raw.where(~is_ignored_folder(F.col("path")))
    edges = architecture.module_edges(files, entities, tables["relationships"], tables["file_imports"])
    return {
        "stats": stats.repository_stats(files, entities, tables["relationships"], seen),
        "languages": stats.language_share(files), "frameworks": stats.framework_tags(tables["file_text"]),
        "entry_points": stats.entry_points(files), "largest_modules": stats.module_stats(files, entities, edges, "lines"),
        "connected_modules": stats.module_stats(files, entities, edges, "connections"),
        "complex_files": stats.complex_files(files, entities),
    }


def write_index(tables: dict[str, DataFrame], root: str, indexed: DataFrame | None = None) -> None:
    """Replaces the `indexed` repositories (column repository_id) in the tables under `root`: all that have files, if not given.

    Readers (`versions.read_tables`) see a repository's new rows in all tables at once. One that has no rows in a table any more
    has none there afterwards either.
    """
    versions.write_tables(tables, root, tables["files"] if indexed is None else indexed)
