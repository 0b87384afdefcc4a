"""Checks of written answers: paths that do not exist, citations without a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import constants as C
from codestrata.functions.paths import suffixes
from codestrata.functions.text import code_reference

from .ranking import spread

ANSWER = ["repository_id", "question_id"]


def answer_paths(text: Column, limit: int | None = None) -> Column:
    """Distinct file-like tokens of an answer (of the first `limit`), those with a directory."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(C.ANSWER_PATH_PATTERN), F.lit(0)))
    return F.filter(found if limit is None else F.slice(found, 1, limit), lambda p: F.contains(p, F.lit("/")))


def unknown_paths(asked: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of asked(repository_id, path, …) whose path is neither a known path nor the tail of one.

    Known paths with a file name that is asked for are spread to their tails once, so that the test is an equi anti-join.
    """
    name = F.substring_index("path", "/", -1).alias("_name")
    named = files.select("repository_id", "path", name).join(asked.select("repository_id", name).distinct(), ["repository_id", "_name"], "left_semi")
    tails = named.select("repository_id", F.explode(suffixes(F.col("path"))).alias("path"))
    return asked.join(tails, ["repository_id", "path"], "left_anti")


def invalid_citations(text: Column, sources: Column) -> Column:
    """Distinct 'S#' marks with a number below 1 or above the number of sources."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(C.CITATION_PATTERN), F.lit(1)), lambda n: n.try_cast("long"))
    wrong = F.filter(F.array_distinct(numbers), lambda n: (n < 1) | (n > sources))
    return F.transform(wrong, lambda n: F.concat(F.lit("S"), n.cast("string")))


def verify_answers(answers: DataFrame, files: DataFrame) -> DataFrame:
    """answers(repository_id, question_id, text, n_sources) → the same keys with unverified_paths, invalid_citations."""
    asked = answers.select(*ANSWER, F.posexplode(answer_paths(F.col("text"))).alias("i", "path"))
    missing = unknown_paths(asked, files).groupBy(*ANSWER).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "path"))), lambda r: r["path"]).alias("unverified_paths")  # of one answer
    )
    cited = answers.select(*ANSWER, invalid_citations(F.col("text"), F.col("n_sources")).alias("invalid_citations"))
    none = F.array().cast("array<string>")
    return cited.join(missing, ANSWER, "left").select(
        *ANSWER, F.coalesce("unverified_paths", none).alias("unverified_paths"), "invalid_citations"
    )


def match_references(references: DataFrame, sources: DataFrame) -> DataFrame:
    """references(question_id, text) to the first source of the question with that path or path tail.

    sources(question_id, n, file, start_line, end_line) → (question_id, text, n, file, start_line, end_line).

    Sources are counted and spread before their tails are made, so that no task holds those of a whole file of a table, and no tails
    are sent to all tasks.
    """
    rows = sources.count()
    references, sources = (spread(df, "question_id", rows=rows) for df in (references, sources))
    parsed = references.select("question_id", "text", F.inline(F.array(F.struct(code_reference(F.col("text")).alias("r"))))).where(F.col("r").isNotNull())
    parsed = parsed.withColumn("tail", F.col("r.path"))
    tails = sources.select("question_id", "n", "file", "start_line", "end_line", F.explode(suffixes(F.col("file"))).alias("tail"))
    key = ["question_id", "tail"]
    joined = spread(parsed, *key, rows=rows).join(spread(tails, *key, rows=rows).hint("merge"), key).select(
        "question_id", "text", "n", "file",
        F.coalesce("r.start_line", "start_line").alias("start_line"),
        F.coalesce("r.end_line", "r.start_line", "end_line").alias("end_line"),
    )
    first = F.min(F.struct("n", "file", "start_line", "end_line"))
    return joined.groupBy("question_id", "text").agg(first.alias("s")).select("question_id", "text", "s.*")
