"""Column functions over repository addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as C


def github_address(url: Column) -> Column:
    """struct(owner, repo, branch) of a GitHub https or ssh address; null for any other address."""
    text = F.trim(url)
    part = lambda i: F.regexp_extract(text, C.GITHUB_URL_PATTERN, i)
    return F.when(
        text.rlike(C.GITHUB_URL_PATTERN),
        F.struct(part(1).alias("owner"), part(2).alias("repo"), F.nullif(part(3), F.lit("")).alias("branch")),
    )


def remote_full_name(remote: Column) -> Column:
    """'owner/repo' of a GitHub remote in any of its forms, without credentials; null otherwise."""
    text = F.trim(remote)
    part = lambda i: F.regexp_extract(text, C.GIT_REMOTE_PATTERN, i)
    return F.when(text.rlike(C.GIT_REMOTE_PATTERN), F.concat_ws("/", part(1), part(2)))


def is_local_path(url: Column) -> Column:
    return url.rlike(C.LOCAL_PATH_PATTERN)


def source_kind(url: Column, provider: Column, connection: Column) -> Column:
    """'local', 'github' (linked to a connection) or 'git'."""
    linked = F.coalesce((provider == "github") & (F.coalesce(connection, F.lit("")) != ""), F.lit(False))
    return F.when(is_local_path(url), "local").when(linked, "github").otherwise("git")
