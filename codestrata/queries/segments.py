"""Queries that cut text into lines, windows and sections."""

from pyspark.sql import functions as F

from codestrata.functions import constants as C
from codestrata.operators import chunks

from . import query
from .views import Views, ctes

DOCS = ctes("doc_files")
LINES = """
, line AS MATERIALIZED (SELECT repository_id, path, language, regexp_extract(path, '[^/]*$') AS base, i AS n, l[i] AS line, len(l) AS total
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, string_split(content, chr(10)) AS l FROM doc_files)))"""
WINDOWS = """
, win AS (SELECT repository_id, path, language, base, max(total) AS total, min(n) AS start_line, max(n) AS end_line, string_agg(line, chr(10) ORDER BY n) AS content
  FROM line WHERE language <> 'Markdown' GROUP BY repository_id, path, language, base, (n - 1) // 60)"""
# A heading opens a section; a section is cut each 60 lines; the heading names all cuts.
SECTIONS = """
, sec AS (SELECT *, sum(CASE WHEN n = 1 OR regexp_matches(line, '^#{1,3}\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY repository_id, path ORDER BY n) AS s
  FROM line WHERE language = 'Markdown'),
titled AS (SELECT *, min(n) OVER p AS first_n, first_value(line) OVER (PARTITION BY repository_id, path, s ORDER BY n) AS head FROM sec WINDOW p AS (PARTITION BY repository_id, path, s)),
cut AS (SELECT repository_id, path, base, language, s, head, (n - first_n) // 60 AS c, min(n) AS start_line, max(n) AS end_line, string_agg(line, chr(10) ORDER BY n) AS content
  FROM titled GROUP BY ALL)"""


@query("text_windows_g1", DOCS + LINES + WINDOWS + """
SELECT repository_id, path, CASE WHEN total > 60 THEN concat(base, ' (lines ', start_line, '-', end_line, ')') ELSE base END AS symbol_name,
 start_line, end_line, md5(content) AS digest FROM win WHERE regexp_matches(content, '\\S')""")
def text_windows(v: Views):
    made = chunks.chunk_files(v.doc_files.where("language <> 'Markdown'"))
    return made.select("repository_id", F.col("file_path").alias("path"), "symbol_name", "start_line", "end_line", F.md5("content").alias("digest"))


@query("heading_sections_g2", DOCS + LINES + SECTIONS + """
SELECT repository_id, path, concat(base, ' › ', CASE WHEN regexp_matches(head, '^#{1,3}\\s') THEN regexp_replace(head, '^#+\\s*', '') ELSE base END) AS symbol_name,
 start_line, end_line, md5(content) AS digest FROM cut WHERE regexp_matches(content, '\\S')""")
def heading_sections(v: Views):
    made = chunks.chunk_files(v.doc_files.where("language = 'Markdown'"))
    return made.select("repository_id", F.col("file_path").alias("path"), "symbol_name", "start_line", "end_line", F.md5("content").alias("digest"))


@query("file_chunks_g1_g2_g3", DOCS + LINES + WINDOWS + SECTIONS + """
SELECT path AS file_path, symbol_type, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM (
 SELECT path, 'chunk' AS symbol_type, content FROM win UNION ALL SELECT path, 'doc', content FROM cut)
WHERE regexp_matches(content, '\\S') GROUP BY ALL""")
def file_chunks(v: Views):
    return chunks.chunk_files(v.doc_files).groupBy("file_path", "symbol_type").agg(
        F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars")
    )


# The cut a small index makes: 20 windows and 40 sections of a file.
@query("file_chunks_first_g1_g2", DOCS + LINES + WINDOWS + SECTIONS + """
SELECT path AS file_path, start_line, end_line FROM (
 SELECT path, start_line, end_line, row_number() OVER (PARTITION BY path ORDER BY start_line) AS r, 20 AS k FROM win WHERE regexp_matches(content, '\\S')
 UNION ALL SELECT path, start_line, end_line, row_number() OVER (PARTITION BY path ORDER BY start_line), 40 FROM cut WHERE regexp_matches(content, '\\S')) WHERE r <= k""")
def file_chunks_first(v: Views):
    cut = chunks.chunk_files(v.doc_files, max_windows=C.MAX_TEXT_CHUNKS, max_sections=C.MAX_HEADING_CHUNKS)
    return cut.select("file_path", "start_line", "end_line")


@query("line_table_g4", DOCS + LINES + "SELECT repository_id, path, n, line FROM line")
def line_table(v: Views):
    return chunks.line_table(v.doc_files)


# Every document has an entity over lines 3–6, and one in three a second one over lines 5–12.
RANGES = """select repository_id, path as file_path, 'function' as symbol_type, cast(3 as bigint) as start_line, cast(6 as bigint) as end_line from doc_files
union all select repository_id, path, 'class', 5, 12 from doc_files where length(content) % 3 = 0
union all select repository_id, path, 'route', 1, 40 from doc_files where length(content) % 2 = 0"""
LEFT = LINES + f"""
, ranges AS ({RANGES}),
uncovered AS (SELECT * FROM line l WHERE regexp_matches(line, '\\S') AND NOT regexp_matches(trim(line), '^(import |from \\S+ import|package |#include|//|\\*|/\\*)')
 AND NOT EXISTS (SELECT 1 FROM ranges r WHERE r.symbol_type <> 'route' AND r.repository_id = l.repository_id AND r.file_path = l.path AND l.n BETWEEN r.start_line AND r.end_line))"""


def _ranges(v: Views):
    v.doc_files.createOrReplaceTempView("doc_files")
    return v.spark.sql(RANGES)


@query("uncovered_lines_g5", DOCS + LEFT + " SELECT repository_id, path, n, line FROM uncovered")
def uncovered_lines(v: Views):
    return chunks.uncovered_lines(v.doc_files, _ranges(v))


@query("module_entities_g5", DOCS + LEFT + """
SELECT repository_id, path AS file_path, base AS symbol_name, 1 AS start_line, total AS end_line, md5(string_agg(concat(n, ': ', line), chr(10) ORDER BY n)) AS digest
FROM uncovered GROUP BY ALL HAVING count(*) >= 8""")
def module_entities(v: Views):
    made = chunks.module_entities(v.doc_files, _ranges(v), max_lines=None)
    return made.select("repository_id", "file_path", "symbol_name", "start_line", "end_line", F.md5("content").alias("digest"))
