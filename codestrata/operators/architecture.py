"""Module and file graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codestrata.functions import constants as C

from .ranking import top_k, union_all
from .stats import module_counts, module_nodes

PAIR = ["repository_id", "source", "target"]


def _call_ends(relationships: DataFrame, entities: DataFrame, column: str) -> DataFrame:
    """Edges with `column` of both ends; only three columns of the entity table take part."""
    place = entities.select("repository_id", "id", column)
    source = place.select("repository_id", F.col("id").alias("source_entity_id"), F.col(column).alias("source"))
    target = place.select("repository_id", F.col("id").alias("target_entity_id"), F.col(column).alias("target"))
    return (
        relationships.select("repository_id", "source_entity_id", "target_entity_id")
        .join(source, ["repository_id", "source_entity_id"])
        .join(target, ["repository_id", "target_entity_id"])
        .where(F.col("source") != F.col("target"))
        .select(*PAIR)
    )


def module_edges(files: DataFrame, entities: DataFrame, relationships: DataFrame, file_imports: DataFrame) -> DataFrame:
    """Weighted module-to-module edges from file imports and from calls."""
    place = files.select("repository_id", "path", "module")
    source = place.select("repository_id", F.col("path").alias("source_file"), F.col("module").alias("source"))
    target = place.select("repository_id", F.col("path").alias("target_file"), F.col("module").alias("target"))
    imports = (
        file_imports.join(source, ["repository_id", "source_file"]).join(target, ["repository_id", "target_file"])
        .where(F.col("source") != F.col("target")).select(*PAIR)
    )
    calls = _call_ends(relationships, entities, "module")
    return union_all(imports, calls).groupBy(*PAIR).agg(F.count("*").alias("weight"))


def module_graph(files, entities, relationships, file_imports, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the largest modules with their counts, and the edges between those modules."""
    top = module_nodes(files, limit)
    nodes = top.join(module_counts(entities), ["repository_id", "module"], "left").na.fill(0, ["functions", "classes", "routes"])
    kept = top.select("repository_id", "module")
    edges = (
        module_edges(files, entities, relationships, file_imports)
        .join(kept.withColumnRenamed("module", "source"), ["repository_id", "source"], "left_semi")
        .join(kept.withColumnRenamed("module", "target"), ["repository_id", "target"], "left_semi")
    )
    return nodes, edges


def file_edges(entities: DataFrame, relationships: DataFrame, file_imports: DataFrame) -> DataFrame:
    """Weighted file-to-file edges: one per import, one per call between two files."""
    imports = file_imports.select("repository_id", F.col("source_file").alias("source"), F.col("target_file").alias("target"))
    calls = _call_ends(relationships, entities, "file_path")
    return union_all(imports, calls).groupBy(*PAIR).agg(F.count("*").alias("weight"))


def file_graph(files: DataFrame, entities: DataFrame, relationships: DataFrame, file_imports: DataFrame,
               modules: DataFrame | None = None, max_files: int | None = None, max_edges: int | None = None,
               max_external: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the file graph of each wanted (repository_id, module), or of every module.

    Edges are built once for all modules and given to the modules of their two ends; files outside the module come in
    as external nodes. The cuts of a drawing (files, edges, external files of a module) are in path order.
    """
    code = files.where(~F.col("language").isin(*C.NON_SOURCE_LANGUAGES))
    if modules is not None:
        code = code.join(modules.select("repository_id", "module").distinct(), ["repository_id", "module"], "left_semi")
    key = ["repository_id", "module"]
    members = code.select("repository_id", "module", "path", F.col("line_count").alias("lines"), "language")
    if max_files is not None:
        members = top_k(members, key, [F.asc("path")], max_files, "_r").drop("_r")
    inside = members.select("repository_id", "module", "path")

    weighted = file_edges(entities, relationships, file_imports)
    sides = [
        weighted.join(inside.withColumnRenamed("path", end), ["repository_id", end]).select(*key, "source", "target", "weight")
        for end in ("source", "target")
    ]
    edges = union_all(*sides).distinct()
    if max_edges is not None:
        edges = top_k(edges, key, [F.asc("source"), F.asc("target")], max_edges, "_r").drop("_r")

    ends = edges.select(*key, F.explode(F.array("source", "target")).alias("path")).distinct()
    outside = ends.join(inside, [*key, "path"], "left_anti")
    if max_external is not None:
        outside = top_k(outside, key, [F.asc("path")], max_external, "_r").drop("_r")
    described = files.select("repository_id", "path", F.col("line_count").alias("lines"), "language",
                             F.col("module").alias("own_module"))
    external = outside.join(described, ["repository_id", "path"]).withColumn("external", F.lit(True))
    nodes = union_all(members.withColumn("own_module", F.col("module")).withColumn("external", F.lit(False)), external)

    known = nodes.select(*key, "path")
    edges = edges.join(known.withColumnRenamed("path", "source"), [*key, "source"], "left_semi").join(
        known.withColumnRenamed("path", "target"), [*key, "target"], "left_semi"
    )
    return nodes, edges


def edges_of_node(edges: DataFrame) -> DataFrame:
    """Every edge listed at both its ends, for 'what does X depend on / what depends on X' ordered by weight."""
    side = lambda node, other, direction: edges.select(
        "repository_id", F.col(node).alias("node"), F.col(other).alias("other"), F.lit(direction).alias("direction"), "weight"
    )
    return union_all(side("source", "target", "out"), side("target", "source", "in"))
