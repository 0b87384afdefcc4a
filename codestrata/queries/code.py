"""Extraction and indexing of source files: one generated file per part, whose definitions are known."""

from pyspark.sql import functions as F

from codestrata.operators import extract
from codestrata.operators.ranking import union_all
from codestrata.plans import index

from . import query
from .views import BRAND, KEY, NEXT, SYMBOL, UPPER, Views, ctes

FILES = ctes("code_files")
# kind of file, name, type, first line, last line, parent, exported, route, calls, handler: as written into the files
EXPECTED = (
    (0, SYMBOL, "function", 4, 8, "NULL", True, "NULL", "load,format", "NULL"),
    (0, f"concat({UPPER}, 'Service')", "class", 10, 14, "NULL", True, "NULL", "", "NULL"),
    (0, "'find'", "method", 11, 13, f"concat({UPPER}, 'Service')", True, "NULL", "query", "NULL"),
    (0, f"concat('GET /', {BRAND}, '/', {KEY})", "route", 16, 16, "NULL", False, f"concat('GET /', {BRAND}, '/', {KEY})", "", SYMBOL),
    (1, SYMBOL, "function", 6, 11, "NULL", True, f"concat('POST /', {BRAND}, '/{{id}}')", "load", "NULL"),
    (1, f"concat({UPPER}, 'Model')", "model", 14, 16, "NULL", True, "NULL", "", "NULL"),
    (1, "'full'", "method", 15, 16, f"concat({UPPER}, 'Model')", True, "NULL", "join", "NULL"),
    (2, f"concat('F', {KEY})", "class", 5, 12, "NULL", True, "NULL", "", "NULL"),
    (2, SYMBOL, "method", 7, 11, f"concat('F', {KEY})", True, f"concat('GET /', {BRAND}, '/{{id}}')", "Missing,load", "NULL"),
    (3, "'Store'", "class", 5, 7, "NULL", True, "NULL", "", "NULL"),
    (3, UPPER, "method", 9, 11, "'Store'", True, "NULL", "load", "NULL"),
    (3, "'init'", "function", 13, 15, "NULL", False, "NULL", "GET", "NULL"),
    (3, f"concat('GET /', {BRAND}, '/', {KEY})", "route", 14, 14, "NULL", False, f"concat('GET /', {BRAND}, '/', {KEY})", "", SYMBOL),
)
PATH = (f"CASE p_size % 4 WHEN 0 THEN concat('src/', {BRAND}, '/f', {KEY}, '.ts') WHEN 1 THEN concat('app/', {BRAND}, '/f', {KEY}, '.py') "
        f"WHEN 2 THEN concat('src/main/java/com/acme/', {BRAND}, '/F', {KEY}, '.java') ELSE concat({BRAND}, '/f', {KEY}, '/code.go') END")
ENTITY_SQL = " UNION ALL ".join(
    f"SELECT concat('repo', CAST(p_partkey % 4 AS VARCHAR)) AS repository_id, {PATH} AS file_path, {name} AS symbol_name, '{kind}' AS symbol_type, {first} AS start_line, "
    f"{last} AS end_line, {parent} AS parent, {str(exported).lower()} AS exported, {route} AS route, '{calls}' AS calls, {handler} AS handler FROM part WHERE p_size % 4 = {form}"
    for form, name, kind, first, last, parent, exported, route, calls, handler in EXPECTED
)
COLUMNS = ["repository_id", "file_path", "symbol_name", "symbol_type", "start_line", "end_line", "parent", "exported", "route", "calls", "handler"]


@query("definitions_x1_to_x6_x9_to_x12_x14", ENTITY_SQL)
def definitions(v: Views):
    return extract.extract_entities(v.code_files).withColumn("calls", F.array_join("calls", ",")).select(*COLUMNS)


@query("definition_text_p13_x2_x3", FILES + f", e AS ({ENTITY_SQL})" + """
SELECT e.repository_id, e.file_path, e.symbol_name, md5(array_to_string(list_slice(string_split(f.content, chr(10)), e.start_line, e.end_line), chr(10))) AS digest
FROM e JOIN code_files f ON f.repository_id = e.repository_id AND f.path = e.file_path""")
def definition_text(v: Views):
    return extract.extract_entities(v.code_files).select("repository_id", "file_path", "symbol_name", F.md5("content").alias("digest"))


SPEC_SQL = f"""SELECT repository_id, file_path, unnest(specs) AS spec FROM (SELECT concat('repo', CAST(p_partkey % 4 AS VARCHAR)) AS repository_id, {PATH} AS file_path,
 CASE p_size % 4 WHEN 0 THEN [concat('../', {BRAND}, '/f', {NEXT}), 'react'] WHEN 1 THEN [concat('app.', {BRAND}), concat('app.', {BRAND}, '.f', {NEXT})]
  WHEN 2 THEN [concat('com.acme.', {BRAND}, '.F', {NEXT})] ELSE [concat('example.org/', {BRAND}, '/f', {NEXT})] END AS specs FROM part)"""


@query("import_specifiers_x7", SPEC_SQL)
def import_specifiers(v: Views):
    return extract.extract_imports(v.code_files)


IMPORTED_SQL = """
imp AS (SELECT DISTINCT s.repository_id, s.file_path AS source_file, f.path AS target_file FROM s JOIN code_files f ON f.repository_id = s.repository_id AND (
  (s.file_path LIKE 'src/%.ts' AND f.path = concat('src', substring(s.spec, 3), '.ts')) OR (s.file_path LIKE '%.py' AND f.path = concat(replace(s.spec, '.', '/'), '.py'))
  OR (s.file_path LIKE '%.java' AND f.path LIKE concat('%/', replace(s.spec, '.', '/'), '.java')) OR (s.file_path LIKE '%.go' AND f.path = concat(substring(s.spec, 13), '/code.go')))),
site AS (SELECT repository_id, file_path, symbol_name, start_line, unnest(list_append(string_split(calls, ','), handler)) AS name,
  unnest(list_append(list_transform(string_split(calls, ','), lambda c: 'calls'), 'handles')) AS kind FROM e),
cand AS (SELECT s.*, c.file_path AS target_file, c.start_line AS target_line, CASE WHEN c.file_path = s.file_path THEN 1
   WHEN EXISTS (SELECT 1 FROM imp i WHERE i.repository_id = s.repository_id AND i.source_file = s.file_path AND i.target_file = c.file_path) THEN 2 ELSE 3 END AS tier
  FROM site s JOIN e c ON c.repository_id = s.repository_id AND c.symbol_name = s.name AND (c.file_path <> s.file_path OR c.start_line <> s.start_line)
  WHERE c.symbol_type IN ('function', 'method', 'component', 'class', 'model')),
best AS (SELECT repository_id, file_path, start_line, name, kind, min(tier) AS tier, arg_min(held, tier) AS held FROM (
   SELECT repository_id, file_path, start_line, name, kind, tier, count(*) AS held FROM cand GROUP BY ALL) GROUP BY ALL)"""


# From raw files to all tables: rows of each, by repository.
@query("index_corpus_c1", FILES + f", e AS ({ENTITY_SQL}), s AS ({SPEC_SQL})," + IMPORTED_SQL + """
SELECT 'files' AS name, repository_id, count(*) AS n FROM code_files GROUP BY ALL
UNION ALL SELECT 'code_entities', repository_id, count(*) FROM e GROUP BY ALL
UNION ALL SELECT 'embeddings', repository_id, count(*) FROM e GROUP BY ALL
UNION ALL SELECT 'relationships', repository_id, CAST(sum(least(held, 3)) AS BIGINT) FROM best WHERE tier < 3 OR held <= 2 GROUP BY ALL
UNION ALL SELECT 'file_imports', repository_id, count(*) FROM imp GROUP BY ALL""")
def index_corpus(v: Views):
    raw = v.code_files.select("repository_id", "path", F.length("content").alias("size"), "content")
    tables = index.index_corpus(raw)
    out = None
    for name in ("files", "code_entities", "embeddings", "relationships", "file_imports"):
        counted = tables[name].groupBy("repository_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "repository_id", "n")
        out = counted if out is None else union_all(out, counted)
    return out


# Components, enums, types, a controller, a record, interfaces, and functions of 451 lines: kind of file, name, type, first
# line, last line, parent, exported, route, calls.
WIDE = (
    (0, f"concat({UPPER}, 'Kind')", "enum", 3, 3, "NULL", True, "NULL", ""), (0, f"concat({UPPER}, 'Props')", "interface", 5, 7, "NULL", True, "NULL", ""),
    (0, f"concat({UPPER}, 'Key')", "type", 9, 9, "NULL", True, "NULL", ""), (0, f"concat({UPPER}, 'Card')", "component", 11, 13, "NULL", True, "NULL", "load"),
    (0, f"concat({UPPER}, 'List')", "component", 15, 17, "NULL", True, "NULL", "show"), (0, f"concat({UPPER}, 'Controller')", "class", 19, 25, "NULL", True, "NULL", ""),
    (0, "'find'", "method", 22, 24, f"concat({UPPER}, 'Controller')", True, f"concat('GET /', {BRAND}, '/:id')", "query"),
    (1, SYMBOL, "function", 1, 451, "NULL", True, "NULL", "step"),
    (2, f"concat('R', {KEY})", "class", 3, 7, "NULL", True, "NULL", ""), (2, "'twice'", "method", 4, 6, f"concat('R', {KEY})", True, "NULL", "times"),
    (2, f"concat('I', {KEY})", "interface", 9, 11, "NULL", False, "NULL", ""), (2, "'find'", "method", 10, 10, f"concat('I', {KEY})", False, "NULL", ""),
    (3, "'Reader'", "interface", 3, 5, "NULL", True, "NULL", ""), (3, "'Key'", "type", 8, 8, "NULL", True, "NULL", ""),
)
WIDE_PATH = "concat('src/', CASE p_size % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'l' WHEN 2 THEN 'R' ELSE 'g' END, CAST(p_partkey AS VARCHAR), CASE p_size % 4 WHEN 0 THEN '.tsx' WHEN 1 THEN '.py' WHEN 2 THEN '.java' ELSE '.go' END)"
WIDE_SQL = " UNION ALL ".join(
    f"SELECT concat('repo', CAST(p_partkey % 4 AS VARCHAR)) AS repository_id, {WIDE_PATH} AS file_path, {name} AS symbol_name, '{kind}' AS symbol_type, {first} AS start_line, "
    f"{last} AS end_line, {parent} AS parent, {str(exported).lower()} AS exported, {route} AS route, '{calls}' AS calls FROM part WHERE p_size % 4 = {form}"
    for form, name, kind, first, last, parent, exported, route, calls in WIDE
)


@query("wide_definitions_x1_to_x6_x12_p13", ctes("wide_files") + f", e AS ({WIDE_SQL})" + """
SELECT e.*, md5(array_to_string(list_slice(string_split(f.content, chr(10)), e.start_line, e.end_line), chr(10))) AS digest
FROM e JOIN wide_files f ON f.repository_id = e.repository_id AND f.path = e.file_path""")
def wide_definitions(v: Views):
    found = extract.extract_entities(v.wide_files).withColumn("calls", F.array_join("calls", ","))
    return found.select("repository_id", "file_path", "symbol_name", "symbol_type", "start_line", "end_line", "parent", "exported", "route", "calls", F.md5("content").alias("digest"))


# The same run, edge by edge and entity by entity.
@query("indexed_imports_c1", FILES + f", s AS ({SPEC_SQL})," + IMPORTED_SQL.split(",\nsite AS")[0] + " SELECT repository_id, source_file, target_file FROM imp")
def indexed_imports(v: Views):
    raw = v.code_files.select("repository_id", "path", F.length("content").alias("size"), "content")
    return index.index_corpus(raw)["file_imports"].select("repository_id", "source_file", "target_file")


@query("indexed_entities_c1", f"WITH e AS ({ENTITY_SQL}) SELECT repository_id, file_path, symbol_name, symbol_type, start_line, end_line, parent, exported, route FROM e")
def indexed_entities(v: Views):
    raw = v.code_files.select("repository_id", "path", F.length("content").alias("size"), "content")
    return index.index_corpus(raw)["code_entities"].select(
        "repository_id", "file_path", "symbol_name", "symbol_type", "start_line", "end_line", "parent", "exported", "route")
