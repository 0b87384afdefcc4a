"""The repository catalogue: flattening provider records, visibility, latest projects, project matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import constants as C
from codestrata.functions.urls import remote_full_name

RAW_REPOSITORY = (
    "id long, name string, full_name string, html_url string, description string, private boolean, "
    "owner struct<login: string, type: string>, stargazers_count long, forks_count long, language string, size long, "
    "default_branch string, pushed_at string, topics array<string>, archived boolean"
)


def flatten_metadata(records: DataFrame, raw: str = "raw", max_topics: int | None = None) -> DataFrame:
    """Provider API records (JSON text) as flat columns; topics cut to `max_topics` if wanted."""
    topics = F.coalesce("r.topics", F.array().cast("array<string>"))
    r = F.from_json(raw, RAW_REPOSITORY)
    return records.select(r.alias("r")).select(
        F.col("r.id").alias("id"), F.col("r.full_name").alias("full_name"), F.col("r.name").alias("name"),
        F.col("r.owner.login").alias("owner"),
        F.when(F.col("r.owner.type") == "Organization", "Organization").otherwise("User").alias("owner_type"),
        F.col("r.private").alias("private"), F.col("r.html_url").alias("url"), F.col("r.description").alias("description"),
        F.col("r.stargazers_count").alias("stars"), F.col("r.forks_count").alias("forks"), F.col("r.language").alias("language"),
        F.col("r.size").alias("size_kb"), F.col("r.default_branch").alias("default_branch"),
        F.col("r.pushed_at").alias("updated_at"),
        (topics if max_topics is None else F.slice(topics, 1, max_topics)).alias("topics"),
        F.col("r.archived").alias("archived"),
    )


def is_visible(viewer: Column) -> Column:
    """Public rows, and private rows of the viewer's own connection."""
    return ~F.col("private") | F.coalesce(F.col("owner_connection_id") == viewer, F.lit(False))


def visible_repositories(repositories: DataFrame, viewer: str | None) -> DataFrame:
    """What one viewer may list, newest first."""
    return repositories.where(is_visible(F.lit(viewer).cast("string"))).orderBy(F.desc("created_at"), F.asc("id"))


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by `order`; a running maximum, so a hot key is reduced before the shuffle."""
    others = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(key).agg(newest.alias("_row")).select(key, "_row.*")


def accessible_with_projects(accessible: DataFrame, repositories: DataFrame) -> DataFrame:
    """accessible(viewer, provider_repository_id) with the latest visible project of that repository, where there is one."""
    candidates = accessible.join(
        repositories.where(F.col("provider") == "github").select(
            "provider_repository_id", "id", "status", "indexed_at", "created_at", "private", "owner_connection_id"
        ),
        "provider_repository_id",
    ).where(is_visible(F.col("viewer")))
    newest = F.max_by(F.struct("id", "status", "indexed_at"), F.struct("created_at", "id"))
    latest = candidates.groupBy("viewer", "provider_repository_id").agg(newest.alias("project"))
    return accessible.join(latest, ["viewer", "provider_repository_id"], "left")


def match_projects(folders: DataFrame, repositories: DataFrame) -> DataFrame:
    """folders(folder, remote) to a project: same local path first, else same remote repository that has no error.

    Returns (folder, id). Two equi-joins, each reduced to the newest project per key beforehand.
    """
    local = repositories.where(F.col("url").rlike(C.LOCAL_PATH_PATTERN)).groupBy(F.col("url").alias("folder")).agg(
        F.max_by("id", F.struct("created_at", "id")).alias("local_id")
    )
    linked = repositories.where((F.col("status") != "error") & F.col("full_name").isNotNull()).groupBy(
        F.lower("full_name").alias("remote_name")
    ).agg(F.max_by("id", F.struct("created_at", "id")).alias("linked_id"))
    named = folders.withColumn("remote_name", F.lower(remote_full_name(F.col("remote"))))
    return named.join(local, "folder", "left").join(linked, "remote_name", "left").select(
        "folder", F.coalesce("local_id", "linked_id").alias("id")
    )
