"""Repository statistics, rankings and starter questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codestrata.functions import constants as C
from codestrata.functions.paths import is_entry_point, is_manifest

from .ranking import top_k

FUNCTION_TYPES = ("function", "method", "component")
CLASS_TYPES = ("class", "model", "interface")


def _is_type(*names: str):
    return F.col("symbol_type").isin(*names)


def repository_stats(files: DataFrame, entities: DataFrame, relationships: DataFrame, seen_files: DataFrame | None = None) -> DataFrame:
    """One row of counts per repository.

    `seen_files` is the whole corpus listing; without it, files seen and files indexed are the same.
    """
    by_file = files.groupBy("repository_id").agg(
        F.count("*").alias("indexed_files"),
        F.count_if(~F.col("language").isin(*C.NON_SOURCE_LANGUAGES)).alias("source_files"),
        F.sum("line_count").cast("long").alias("lines"),
        F.countDistinct("module").alias("modules"),
    )
    by_entity = entities.groupBy("repository_id").agg(
        F.count_if(_is_type("function", "method")).alias("functions"),
        F.count_if(_is_type("component")).alias("components"),
        F.count_if(_is_type("class")).alias("classes"),
        F.count_if(_is_type("interface")).alias("interfaces"),
        F.count_if(_is_type("model")).alias("models"),
        F.count_if(F.col("route").isNotNull()).alias("routes"),
        F.count("*").alias("entities"),
    )
    by_edge = relationships.groupBy("repository_id").agg(F.count("*").alias("relationships"))
    stats = by_file.join(by_entity, "repository_id", "left").join(by_edge, "repository_id", "left")
    if seen_files is None:
        stats = stats.withColumn("files", F.col("indexed_files"))
    else:
        seen = seen_files.groupBy("repository_id").agg(F.count("*").alias("files"))
        stats = stats.join(seen, "repository_id", "left")
    return stats.na.fill(0)


def language_share(files: DataFrame) -> DataFrame:
    """Lines per language of a repository, and their share in percent."""
    by_language = files.groupBy("repository_id", "language").agg(F.sum("line_count").cast("long").alias("lines"))
    total = by_language.groupBy("repository_id").agg(F.sum("lines").alias("total"))
    return by_language.join(total, "repository_id").select(
        "repository_id", "language", "lines",
        F.round(F.try_divide(F.col("lines") * 100.0, F.col("total")), 1).alias("percent"),
    )


def module_nodes(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Modules of code files: files, lines, sorted distinct languages; the largest `limit` of each repository, all of them if not given."""
    code = files.where(~F.col("language").isin(*C.NON_SOURCE_LANGUAGES))
    nodes = code.groupBy("repository_id", "module").agg(
        F.count("*").alias("files"), F.sum("line_count").cast("long").alias("lines"),
        F.array_sort(F.collect_set("language")).alias("languages"),  # at most one entry per known language
    )
    if limit is None:
        return nodes
    return top_k(nodes, ["repository_id"], [F.desc("lines"), F.asc("module")], limit, "_r").drop("_r")


def module_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("repository_id", "module").agg(
        F.count_if(_is_type(*FUNCTION_TYPES)).alias("functions"),
        F.count_if(_is_type(*CLASS_TYPES)).alias("classes"),
        F.count_if(F.col("route").isNotNull()).alias("routes"),
    )


def module_stats(files: DataFrame, entities: DataFrame, edges: DataFrame, by: str = "lines", limit: int = 8) -> DataFrame:
    """Largest (`by='lines'`) or most connected (`by='connections'`) modules.

    `edges` are module edges with weights; a module's connections are the weights of edges in both directions.
    """
    nodes = module_nodes(files, None).select("repository_id", "module", "files", "lines")
    counted = entities.groupBy("repository_id", "module").agg(F.count("*").alias("entities"))
    ends = edges.select(
        "repository_id", "weight", F.explode(F.array("source", "target")).alias("module")
    ).groupBy("repository_id", "module").agg(F.sum("weight").cast("long").alias("connections"))
    keys = ["repository_id", "module"]
    joined = nodes.join(counted, keys, "left").join(ends, keys, "left").na.fill(0, ["entities", "connections"])
    return top_k(joined, ["repository_id"], [F.desc(by), F.asc("module")], limit)


def complex_files(files: DataFrame, entities: DataFrame, limit: int = 10) -> DataFrame:
    """Files with most entities, then most lines."""
    counted = entities.groupBy("repository_id", F.col("file_path").alias("path")).agg(F.count("*").alias("entities"))
    joined = files.select("repository_id", "path", F.col("line_count").alias("lines")).join(counted, ["repository_id", "path"])
    return top_k(joined, ["repository_id"], [F.desc("entities"), F.desc("lines"), F.asc("path")], limit)


def most_referenced(entities: DataFrame, degrees: DataFrame, types: tuple[str, ...] = C.LINKABLE_TYPES, limit: int = 15,
                    min_name_length: int = 0) -> DataFrame:
    """Entities of the given types with most incoming edges, per repository."""
    wanted = entities.where(F.col("symbol_type").isin(*types) & (F.length("symbol_name") > min_name_length))
    joined = degrees.join(wanted.select("repository_id", "id", "symbol_name", "symbol_type", "file_path"), ["repository_id", "id"])
    return top_k(joined, ["repository_id"], [F.desc("refs"), F.asc("id")], limit)


def starter_questions(entities: DataFrame, degrees: DataFrame) -> DataFrame:
    """(repository_id, suggestions): questions that fit what a repository holds."""
    name = F.lower("symbol_name")
    flags = entities.groupBy("repository_id").agg(
        *[F.bool_or(name.rlike(p)).alias(k) for k, p in C.STARTER_PATTERNS.items()],
        F.bool_or(F.col("route").isNotNull()).alias("routes"),
    )
    top = most_referenced(entities, degrees, ("function", "method", "class"), 1, 3).select(
        "repository_id", F.col("symbol_name").alias("top_name")
    )
    asked = [F.array(*[F.lit(q) for q in C.OVERVIEW_QUESTIONS])]
    empty = F.array().cast("array<string>")
    for key, questions in C.STARTER_QUESTIONS.items():
        asked.append(F.when(F.col(key), F.array(*[F.lit(q) for q in questions])).otherwise(empty))
    impact = F.concat(F.lit("What would be affected if I changed "), F.col("top_name"), F.lit("?"))
    asked.append(F.when(F.col("top_name").isNotNull(), F.array(impact)).otherwise(empty))
    return flags.join(top, "repository_id", "left").select(
        "repository_id", F.slice(F.concat(*asked), 1, C.MAX_SUGGESTIONS).alias("suggestions")
    )


def framework_tags(manifests: DataFrame, max_manifests: int | None = None) -> DataFrame:
    """(repository_id, framework) found in manifest texts (of the first `max_manifests` in path order). Input columns: repository_id, path, content."""
    files = manifests.where(is_manifest(F.col("path")))
    if max_manifests is not None:
        files = top_k(files, ["repository_id"], [F.asc("path")], max_manifests, "_r")
    hits = F.array_compact(F.array(*[F.when(F.col("content").rlike(p), F.lit(tag)) for p, tag in C.FRAMEWORK_PATTERNS]))
    return files.select("repository_id", F.explode(hits).alias("framework")).distinct()


def entry_points(files: DataFrame, limit: int = 8) -> DataFrame:
    """Likely entry files, shallow paths first."""
    found = files.where(is_entry_point(F.col("path"))).select(
        "repository_id", "path", F.size(F.split("path", "/")).alias("depth")
    )
    return top_k(found, ["repository_id"], [F.asc("depth"), F.asc("path")], limit)
