"""Entity graph: neighbours, dependency cards, in-degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranking import fan_join, spread, union_all

EDGE = ["repository_id", "source_entity_id", "target_entity_id", "relationship_type"]


def _meet(left: DataFrame, right: DataFrame, keys: list[str], rows: int | None, how: str = "inner") -> DataFrame:
    """A join, for many `rows` in partitions of bounded rows: else few tasks sort them all, since they are few bytes when shuffled."""
    if rows is None:
        return left.join(right, keys, how)
    return spread(left, *keys, rows=rows).join(spread(right, *keys, rows=rows).hint("merge"), keys, how)


def neighbour_edges(anchors: DataFrame, relationships: DataFrame, set_col: str = "set_id", rows: int | None = None) -> DataFrame:
    """Edges that touch a set of entities: (set, repository_id, anchor, id, relationship_type, direction).

    An edge with both ends in one set appears once, outgoing. Two equi-joins take the place of an OR join. `rows` is the number of
    edges, where most of them are wanted.
    """
    anchors = anchors.select(set_col, "repository_id", F.col("id").alias("anchor")).distinct()
    key = ["repository_id", "anchor"]
    outgoing = _meet(relationships.withColumnRenamed("source_entity_id", "anchor"), anchors, key, rows).select(
        set_col, "repository_id", "anchor", F.col("target_entity_id").alias("id"), "relationship_type",
        F.lit("out").alias("direction"),
    )
    incoming = _meet(relationships.withColumnRenamed("target_entity_id", "anchor"), anchors, key, rows).select(
        set_col, "repository_id", "anchor", F.col("source_entity_id").alias("id"), "relationship_type",
        F.lit("in").alias("direction"),
    )
    inside = anchors.select(set_col, "repository_id", F.col("anchor").alias("id"))
    return union_all(outgoing, _meet(incoming, inside, [set_col, "repository_id", "id"], rows, "left_anti"))


def with_entities(rows: DataFrame, entities: DataFrame, columns: list[str], expected: int | None = None) -> DataFrame:
    """Adds entity columns by id; only the wanted columns take part in the join. `expected` is the number of `rows`, where they are many."""
    return _meet(rows, entities.select("repository_id", "id", *columns), ["repository_id", "id"], expected)


def in_degrees(relationships: DataFrame) -> DataFrame:
    return relationships.groupBy("repository_id", F.col("target_entity_id").alias("id")).agg(F.count("*").alias("refs"))


def class_members(owners: DataFrame, entities: DataFrame, owner_col: str = "owner_id") -> DataFrame:
    """(owner, repository_id, id) of entities whose parent is the owner's name in the owner's file."""
    named = owners.select(F.col("id").alias(owner_col), "repository_id", "file_path", F.col("symbol_name").alias("parent"))
    children = entities.where(F.col("parent").isNotNull()).select("repository_id", "file_path", "parent", "id")
    return named.join(children, ["repository_id", "file_path", "parent"]).select(owner_col, "repository_id", "id")


def dependency_cards(targets: DataFrame, entities: DataFrame, relationships: DataFrame, file_imports: DataFrame) -> DataFrame:
    """One row per fact about a target: its callees, callers, external imports, file imports and importing files.

    Columns: target_id, repository_id, section, id, name, file_path, relationship_type. Long form keeps a target with
    very many callers spread over the cluster; nothing is collected per target. Edges and imports are read twice and should be
    stored. A file's imports are many rows of each of its entities: they are made in tasks of bounded rows.
    """
    from codestrata.functions.text import external_imports

    anchors = targets.select(F.col("id").alias("target_id"), "repository_id", "id")
    edges = relationships.count()
    near = with_entities(
        neighbour_edges(anchors, relationships, "target_id", edges), entities, ["symbol_name", "file_path"], 2 * edges
    ).select(
        "target_id", "repository_id",
        F.when(F.col("direction") == "out", "depends_on").otherwise("used_by").alias("section"),
        "id", F.col("symbol_name").alias("name"), "file_path", "relationship_type",
    )
    none = lambda kind: F.lit(None).cast(kind)
    owners = targets.select(F.col("id").alias("target_id"), "repository_id", "file_path")

    def file_side(own: str, other: str, section: str) -> DataFrame:
        edges = file_imports.select("repository_id", F.col(own).alias("file_path"), F.col(other).alias("other"))
        return fan_join(owners, edges, ["repository_id", "file_path"], "target_id").select(
            "target_id", "repository_id", F.lit(section).alias("section"), none("long").alias("id"),
            none("string").alias("name"), F.col("other").alias("file_path"), none("string").alias("relationship_type"),
        )

    external = targets.select(
        F.col("id").alias("target_id"), "repository_id", F.lit("external_import").alias("section"),
        none("long").alias("id"), F.explode(external_imports(F.col("imports"))).alias("name"),
        none("string").alias("file_path"), none("string").alias("relationship_type"),
    )
    return union_all(
        near, external, file_side("source_file", "target_file", "file_import"), file_side("target_file", "source_file", "imported_by")
    )
