"""Queries over questions, identifiers, excerpts and entity text."""

from pyspark.sql import functions as F

from codestrata.functions import constants as C, text

from . import query
from .paths import any_of, lit
from .views import BRAND, CAMEL, Views, ctes

QUESTIONS = ctes("questions")


def words_sql(x: str) -> str:
    return (
        f"concat({x}, ' ', regexp_replace(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), "
        f"'([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[_\\-./\\\\:]+', ' ', 'g'))"
    )


# Distinct in first-seen order: keep a value whose first position is its own.
def ordered_distinct_sql(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


TOKEN_PARTS_SQL = (
    "flatten(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda t: "
    "list_concat([lower(t)], list_transform(string_split_regex(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[\\s_]+'), lambda p: lower(p)))))"
)
UNDERSTOOD = f"""
, understood AS MATERIALIZED (SELECT *, {ordered_distinct_sql('parts')} AS terms, {ordered_distinct_sql('named')} AS identifiers,
   CASE {' '.join(f"WHEN regexp_matches(lower(text), {lit(p)}) THEN '{k}'" for k, p in C.QUESTION_PATTERNS)} ELSE 'general' END AS query_type,
   regexp_matches(text, {lit(C.ABOUT_TESTS_PATTERN)}) AS about_tests
  FROM (SELECT *, list_filter({TOKEN_PARTS_SQL}, lambda w: length(w) >= 2 AND w NOT IN {any_of(C.STOP_WORDS)}) AS parts,
    list_concat(list_transform(regexp_extract_all(text, '`([^`]+)`', 1), lambda t: string_split(regexp_replace(t, '\\(\\)$', ''), '.')[-1]),
     regexp_extract_all(text, {lit(C.CALL_MENTION_PATTERN)}, 1), regexp_extract_all(text, {lit(C.IDENTIFIER_PATTERN)}, 1)) AS named
   FROM questions)),
candidates AS (SELECT *, {ordered_distinct_sql('wanted')} AS candidates FROM (
  SELECT *, list_transform(list_concat(identifiers, list_filter(terms, lambda t: length(t) >= 4)), lambda t: lower(t)) AS wanted FROM understood))"""


@query("question_class_p5_about_tests_p9", QUESTIONS + UNDERSTOOD + " SELECT question_id, query_type, about_tests FROM understood")
def question_class(v: Views):
    q = F.col("text")
    return v.questions.select("question_id", text.classify_question(q).alias("query_type"), text.is_about_tests(q).alias("about_tests"))


@query("question_terms_p3_p4_p6", QUESTIONS + UNDERSTOOD + """
 SELECT question_id, array_to_string(terms, ',') AS terms, array_to_string(identifiers, ',') AS identifiers, array_to_string(candidates, ',') AS candidates FROM candidates""")
def question_terms(v: Views):
    q = F.col("text")
    read = v.questions.select("question_id", text.keyword_terms(q).alias("terms"), text.code_identifiers(q).alias("identifiers"))
    joined = lambda c: F.array_join(c, ",")
    return read.select(
        "question_id", joined("terms").alias("terms"), joined("identifiers").alias("identifiers"),
        joined(text.symbol_candidates(F.col("identifiers"), F.col("terms"))).alias("candidates"),
    )


# Keyword terms of running prose: every document is read as a question.
@query("document_terms_p3", "WITH questions AS (SELECT doc_id AS question_id, text FROM documents)" + UNDERSTOOD + """
 SELECT question_id, array_to_string(terms, ',') AS terms FROM understood""")
def document_terms(v: Views):
    return v.documents.select(F.col("doc_id").alias("question_id"), F.array_join(text.keyword_terms(F.col("text")), ",").alias("terms"))


# The terms a small prompt would take.
@query("first_terms_p3", "WITH questions AS (SELECT doc_id AS question_id, text FROM documents)" + UNDERSTOOD + f"""
 SELECT question_id, array_to_string(list_slice(terms, 1, {C.MAX_KEYWORDS}), ',') AS terms FROM understood""")
def first_terms(v: Views):
    terms = text.keyword_terms(F.col("text"), C.MAX_KEYWORDS)
    return v.documents.select(F.col("doc_id").alias("question_id"), F.array_join(terms, ",").alias("terms"))


IDENTIFIERS = (f"concat('HTTPServer', {CAMEL}, '_', {BRAND}, '.get', upper(substring(p_name, 1, 1)), substring(p_type, 1, 3), '/x-', cast(p_partkey as string))")


@query("identifier_words_p2", f"SELECT p_partkey AS id, {words_sql('n')} AS words FROM (SELECT p_partkey, {IDENTIFIERS} AS n FROM part)")
def identifier_words(v: Views):
    return v.part.select(F.col("p_partkey").alias("id"), text.identifier_words(F.expr(IDENTIFIERS)).alias("words"))


IMPORTS = (f"concat('./', {BRAND})", f"concat('@scope/', {BRAND})", "'../up'", f"concat('pkg.', {BRAND})")


@query("external_imports_p10", f"SELECT p_partkey AS id, concat('@scope/', {BRAND}, ',pkg.', {BRAND}) AS external FROM part")
def external_imports(v: Views):
    specs = F.array(*[F.expr(e) for e in IMPORTS])
    return v.part.select(F.col("p_partkey").alias("id"), F.array_join(text.external_imports(specs), ",").alias("external"))


@query("numbered_excerpt_p11", """
SELECT doc_id, array_to_string(list_concat(list_transform(list_slice(l, 1, 8), lambda x, i: CASE WHEN regexp_matches(x, '^\\d+: ') THEN x ELSE concat(CAST(i + 4 AS VARCHAR), ': ', x) END),
 CASE WHEN len(l) > 8 THEN [concat('... (', CAST(len(l) - 8 AS VARCHAR), ' more lines)')] ELSE [] END), chr(10)) AS excerpt
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def numbered_excerpt(v: Views):
    return v.documents.select("doc_id", text.numbered(F.col("text"), F.lit(5), F.lit(8)).alias("excerpt"))


@query("evidence_header_p12", ctes("code_entities") + """
SELECT id, concat('[S', CAST(id AS VARCHAR), '] ', symbol_type, ' ', CASE WHEN parent IS NULL THEN '' ELSE concat(parent, '.') END, symbol_name,
 CASE WHEN route IS NULL THEN '' ELSE concat(' (route ', route, ')') END, ' — ', file_path, ':', CAST(start_line AS VARCHAR), '-', CAST(end_line AS VARCHAR),
 ' (module: ', module, '; ', 'API route', ')') AS header FROM code_entities""")
def evidence_header(v: Views):
    c = F.col
    header = text.evidence_header(
        c("id"), c("symbol_type"), c("parent"), c("symbol_name"), c("route"), c("file_path"), c("start_line"), c("end_line"),
        c("module"), F.lit("API route"),
    )
    return v.code_entities.select("id", header.alias("header"))


@query("clip_lines_p13", """
SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 3, 3 + least(10, 40) - 1), chr(10)) AS clipped FROM documents""")
def clip_lines(v: Views):
    return v.documents.select("doc_id", text.clip(text.lines_of(F.col("text")), F.lit(3), F.lit(42), 10).alias("clipped"))


@query("embedding_text_p14", ctes("entity_text") + f"""
SELECT id, md5(concat_ws(' ', symbol_type, symbol_name, parent, route, file_path, {words_sql('symbol_name')}, substring(content, 1, {C.EMBEDDING_CONTENT_CHARS}))) AS digest,
 md5(concat_ws(' ', symbol_type, symbol_name, parent, route, file_path, {words_sql('symbol_name')}, content)) AS whole_digest FROM entity_text""")
def embedding_text(v: Views):
    c = F.col
    args = [c("symbol_type"), c("symbol_name"), c("parent"), c("route"), c("file_path"), c("content")]
    return v.entity_text.select(
        "id", F.md5(text.embedding_text(*args, content_chars=C.EMBEDDING_CONTENT_CHARS)).alias("digest"), F.md5(text.embedding_text(*args)).alias("whole_digest")
    )


CODE_LINE = (f"concat('if (', {CAMEL}, '(x) && obj.', {BRAND}, 'Load(y)) {{ return new ', {CAMEL}, 'Error(', {BRAND}, '_id (z)); }} while (next()) {{ next(); }}')")


@query("call_names_x8", f"""
SELECT p_partkey AS id, concat({CAMEL}, ',', {BRAND}, 'Load,', {CAMEL}, 'Error,', {BRAND}, '_id,next') AS calls FROM part""")
def call_names(v: Views):
    return v.part.select(F.col("p_partkey").alias("id"), F.array_join(text.call_names(F.expr(CODE_LINE)), ",").alias("calls"))
