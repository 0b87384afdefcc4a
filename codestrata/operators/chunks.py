"""Text segmentation: windows, heading sections, line tables, uncovered lines. Files stay in their rows: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import constants as C
from codestrata.functions.paths import base_name
from codestrata.functions.text import chunk_type, is_blank, lines_of

from .extract import loose_calls

FILE = ["repository_id", "path"]


def _piece(name: Column, start: Column, end: Column, lines: Column) -> Column:
    return F.struct(
        name.alias("symbol_name"), start.cast("long").alias("start_line"), end.cast("long").alias("end_line"),
        F.array_join(F.slice(lines, start, end - start + 1), "\n").alias("content"),
    )


def with_lines(files: DataFrame) -> DataFrame:
    """Adds `lines` and, for Markdown, `starts`: the first lines of its sections.

    Both are columns of their own because a lambda evaluates what it encloses once per element.
    """
    i_heading = F.filter(
        F.transform("lines", lambda line, i: F.when((i == 0) | is_heading(line), i + 1)), lambda i: i.isNotNull()
    )
    once = F.inline(F.array(F.struct(lines_of(F.col("content")).alias("lines"))))
    return files.select("*", once).select("*", F.inline(F.array(F.struct(
        F.when(F.col("language") == "Markdown", i_heading).otherwise(F.array().cast("array<int>")).alias("starts")))))


def is_heading(line: Column) -> Column:
    return line.rlike(r"^#{1,3}" + C.JS_SPACE)


def window_pieces(size: int = C.CHUNK_LINES) -> Column:
    """Fixed windows of `size` lines over columns path and lines; blank windows are left out."""
    lines, base = F.col("lines"), base_name(F.col("path"))
    count = F.size(lines)

    def piece(start: Column) -> Column:
        end = F.least(start + size - 1, count)
        ranged = F.concat(base, F.lit(" (lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")"))
        return _piece(F.when(count > size, ranged).otherwise(base), start, end, lines)

    pieces = F.transform(F.sequence(F.lit(1), count, F.lit(size)), piece)
    return F.filter(pieces, lambda p: ~is_blank(p["content"]))


def heading_pieces(size: int = C.CHUNK_LINES, title_chars: int | None = None) -> Column:
    """Sections that begin at a level 1–3 heading, long ones cut each `size` lines; named 'file › heading'.

    Over columns path, lines and starts.
    """
    lines, starts, base = F.col("lines"), F.col("starts"), base_name(F.col("path"))

    def cuts(start: Column, i: Column) -> Column:
        first = F.get(lines, start - 1)
        end = F.coalesce(F.get(starts, i + 1) - 1, F.size(lines))
        heading = F.regexp_replace(first, "^#+" + C.JS_SPACE + "*", "")
        title = F.when(is_heading(first), heading if title_chars is None else F.substring(heading, 1, title_chars)).otherwise(base)
        name = F.concat(base, F.lit(" › "), title)
        return F.transform(F.sequence(start, end, F.lit(size)), lambda s: _piece(name, s, F.least(s + size - 1, end), lines))

    return F.filter(F.flatten(F.transform(starts, cuts)), lambda p: ~is_blank(p["content"]))


def chunk_files(files: DataFrame, size: int = C.CHUNK_LINES, max_windows: int | None = None, max_sections: int | None = None) -> DataFrame:
    """Chunk entities of files: Markdown by heading, others in windows.

    files(repository_id, path, language, content). All text is kept; `max_windows=20` and `max_sections=40` cut a file's
    chunks as a small index would.
    """
    cut = lambda pieces, limit: pieces if limit is None else F.slice(pieces, 1, limit)
    pieces = F.when(F.col("language") == "Markdown", cut(heading_pieces(size), max_sections)).otherwise(cut(window_pieces(size), max_windows))
    return with_lines(files.select("repository_id", "path", "language", "content")).select(
        "repository_id", F.col("path").alias("file_path"), "language", chunk_type(F.col("language")).alias("symbol_type"),
        F.inline(pieces),
    )


def line_table(files: DataFrame) -> DataFrame:
    """One row per line: (repository_id, path, n from 1, line)."""
    return files.select("repository_id", "path", F.posexplode(lines_of(F.col("content"))).alias("i", "line")).select(
        "repository_id", "path", (F.col("i") + 1).alias("n"), "line"
    )


def covered_ranges(entities: DataFrame) -> DataFrame:
    """Per file (repository_id, path): the number of entities, and the line ranges of all but routes as sorted (start, end)."""
    first, last = F.col("start_line").cast("int"), F.col("end_line").cast("int")
    ranges = F.when(F.col("symbol_type") != "route", F.struct(F.least(first, last).alias("start"), F.greatest(first, last).alias("end")))
    return entities.groupBy("repository_id", F.col("file_path").alias("path")).agg(
        F.count("*").alias("entities"), F.sort_array(F.collect_list(ranges)).alias("ranges"))  # one file's


def gaps(ranges: Column, n_lines: Column) -> Column:
    """The runs of lines (start, end) from 1 to `n_lines` that no range covers: ranges in order, swept with the furthest end so far."""
    run = "array<struct<start:int,end:int>>"
    begun = F.struct(F.lit(0).alias("reach"), F.array().cast(run).alias("found"))
    closing = F.array(F.struct((n_lines + 1).alias("start"), (n_lines + 1).alias("end")))

    def sweep(state: Column, r: Column) -> Column:
        free = F.struct((state["reach"] + 1).cast("int").alias("start"), F.least(r["start"] - 1, n_lines).cast("int").alias("end"))
        found = F.when(free["start"] <= free["end"], F.concat(state["found"], F.array(free))).otherwise(state["found"])
        return F.struct(F.greatest(state["reach"], r["end"]).cast("int").alias("reach"), found.alias("found"))

    every = F.concat(F.coalesce(ranges, F.array().cast(run)), closing)
    return F.aggregate(every, begun, sweep, lambda state: state["found"])


def with_uncovered(files: DataFrame, entities: DataFrame) -> DataFrame:
    """Files with `lines`, `entities` (their number) and `left`: the lines (n, line) in no entity but routes, without blank, import
    and comment lines.

    A file's ranges meet it as one row; its lines are cut where they lie and never move on their own.
    """
    met = files.join(covered_ranges(entities).hint("merge"), FILE, "left")  # texts, whatever size is expected of them
    lined = met.select("*", F.inline(F.array(F.struct(lines_of(F.col("content")).alias("lines")))))
    free = lined.select("*", F.inline(F.array(F.struct(gaps(F.col("ranges"), F.size("lines")).alias("free")))))
    row = lambda line, n: F.struct(n.alias("n"), line.alias("line"))
    cut = F.flatten(F.transform("free", lambda g: F.transform(F.slice("lines", g["start"], g["end"] - g["start"] + 1), lambda line, i: row(line, i + g["start"]))))
    code = lambda line: ~is_blank(line) & ~F.regexp_replace(line, f"^{C.JS_SPACE}+", "").rlike(C.IMPORT_OR_COMMENT)
    return free.select(*files.columns, "entities", "lines", F.inline(F.array(F.struct(F.filter(cut, lambda r: code(r["line"])).alias("left")))))


def uncovered_lines(files: DataFrame, entities: DataFrame) -> DataFrame:
    """Lines in no entity but routes, without blank, import and comment lines: (repository_id, path, n, line)."""
    return with_uncovered(files.select(*FILE, "content"), entities).select(*FILE, F.inline("left"))


def module_entities(files: DataFrame, entities: DataFrame, min_lines: int = 8, max_lines: int | None = None) -> DataFrame:
    """One `module` entity per file whose uncovered lines are at least `min_lines`, or any if it has no entity."""
    found = with_uncovered(files.select(*FILE, "language", "content"), entities)
    shown = F.col("left") if max_lines is None else F.slice("left", 1, max_lines)
    text = F.array_join(F.transform(shown, lambda r: F.concat(r["n"].cast("string"), F.lit(": "), r["line"])), "\n")
    enough = (F.size("left") >= min_lines) | (F.col("entities").isNull() & (F.size("left") > 0))
    return found.where(enough).select(
        "repository_id", F.col("path").alias("file_path"), base_name(F.col("path")).alias("symbol_name"),
        F.lit("module").alias("symbol_type"), "language", F.lit(1).cast("long").alias("start_line"),
        F.size("lines").cast("long").alias("end_line"), text.alias("content"),
        F.lit(None).cast("string").alias("parent"), F.lit(False).alias("exported"), F.lit(None).cast("string").alias("route"),
        loose_calls(F.col("content"), F.col("language")).alias("calls"), F.lit(None).cast("string").alias("handler"),
    )
