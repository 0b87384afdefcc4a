"""Queries over stems: the words of all documents, and full-text search whose terms and postings carry stems."""

from pyspark.sql import functions as F

from codestrata.functions import constants as C
from codestrata.functions.stems import stems
from codestrata.operators import search
from codestrata.operators.ranking import cut
from codestrata.plans import search as search_plan

from . import query
from .search import document_entities
from .text import UNDERSTOOD, words_sql
from .views import Views


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _exchanged(previous: str, name: str, endings: dict[str, str], region: str = "r1", special: dict[str, str] | None = None) -> str:
    """A step as a CTE: the longest ending, and what becomes of the word; `special` has conditions of their own."""
    every = "|".join(sorted({*endings, *(special or {})}, key=len, reverse=True))
    own = " ".join(f"WHEN e = '{e}' THEN {then}" for e, then in (special or {}).items())
    new = " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in endings.items())
    return f"""
{name}_e AS (SELECT *, regexp_extract(w, '(?:{every})$') AS e FROM {previous}),
{name} AS (SELECT word, r1, r2, CASE WHEN e = '' OR done THEN w {own}
  WHEN length(w) - length(e) >= {region} THEN concat(left(w, length(w) - length(e)), CASE e {new} END) ELSE w END AS w, done FROM {name}_e)"""


REGION = "'^[^aeiouy]*[aeiouy]+[^aeiouy]'"
SHORT = "'(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$'"


def stem_sql(source: str) -> str:
    """CTEs from `source`(word) to stemmed(word, stem): the rules as regular expressions; stop words have no stem."""
    past = f"'(?:{'eedly|ingly|edly|eed|ing|ed'})$'"
    prefix = f"'^(?:{'|'.join(C.STEM_PREFIXES)})'"
    exceptions = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in C.STEM_EXCEPTIONS.items())
    return f"""
plain AS (SELECT DISTINCT word FROM {source}),
marked AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM plain
  WHERE regexp_full_match(word, '[a-z]+') AND length(word) > 2 AND word NOT IN ({_names([*C.STEM_EXCEPTIONS, *sorted(C.ENGLISH_STOP_WORDS)])})),
first_region AS (SELECT *, CASE WHEN regexp_matches(w, {prefix}) THEN length(regexp_extract(w, {prefix})) WHEN regexp_matches(w, {REGION}) THEN length(regexp_extract(w, {REGION})) ELSE length(w) END AS r1 FROM marked),
regions AS (SELECT *, CASE WHEN regexp_matches(substring(w, r1 + 1), {REGION}) THEN r1 + length(regexp_extract(substring(w, r1 + 1), {REGION})) ELSE length(w) END AS r2 FROM first_region),
step1a AS (SELECT word, r1, r2, CASE WHEN ends_with(w, 'sses') THEN left(w, -2) WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, CASE WHEN length(w) > 4 THEN -2 ELSE -1 END)
  WHEN regexp_matches(w, '[us]s$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, -1) ELSE w END AS w FROM regions),
settled AS (SELECT *, w IN ({_names(C.STEM_SETTLED)}) AS done, regexp_extract(w, {past}) AS e FROM step1a),
cut_past AS (SELECT *, left(w, length(w) - length(e)) AS rest FROM settled),
step1b AS (SELECT word, r1, r2, done, CASE WHEN done OR e = '' THEN w WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(rest) >= r1 THEN concat(rest, 'ee') ELSE w END
  WHEN NOT regexp_matches(rest, '[aeiouy]') THEN w WHEN regexp_matches(rest, '(?:at|bl|iz)$') THEN concat(rest, 'e') WHEN regexp_matches(rest, '(?:{'|'.join(C.STEM_DOUBLES)})$') THEN left(rest, -1)
  WHEN length(rest) <= r1 AND regexp_matches(rest, {SHORT}) THEN concat(rest, 'e') ELSE rest END AS w FROM cut_past),
step1c AS (SELECT word, r1, r2, done, CASE WHEN NOT done AND regexp_matches(w, '.[^aeiouy][yY]$') THEN concat(left(w, -1), 'i') ELSE w END AS w FROM step1b),""" + ",".join((
        _exchanged("step1c", "step2", C.STEM_STEP_2, "r1", {
            "ogi": "CASE WHEN length(w) - 3 >= r1 AND ends_with(w, 'logi') THEN left(w, -1) ELSE w END",
            "li": f"CASE WHEN length(w) - 2 >= r1 AND regexp_matches(w, '[{''.join(C.STEM_BEFORE_LI)}]li$') THEN left(w, -2) ELSE w END"}),
        _exchanged("step2", "step3", C.STEM_STEP_3, "r1", {"ative": "CASE WHEN length(w) - 5 >= r2 THEN left(w, -5) ELSE w END"}),
        _exchanged("step3", "step4", dict.fromkeys(C.STEM_STEP_4, ""), "r2", {"ion": "CASE WHEN length(w) - 3 >= r2 AND regexp_matches(w, '[st]ion$') THEN left(w, -3) ELSE w END"}))) + f""",
step5 AS (SELECT word, CASE WHEN done THEN w WHEN ends_with(w, 'e') AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(left(w, -1), {SHORT}))) THEN left(w, -1)
  WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN left(w, -1) ELSE w END AS w FROM step4),
stemmed AS MATERIALIZED (SELECT p.word, CASE WHEN p.word IN ({_names(sorted(C.ENGLISH_STOP_WORDS))}) THEN NULL ELSE coalesce(CASE p.word {exceptions} END, replace(s.w, 'Y', 'y'), p.word) END AS stem
  FROM plain p LEFT JOIN step5 s ON s.word = p.word)"""


@query("word_stems_t2", "WITH spoken AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents)," + stem_sql("spoken") + " SELECT word, stem FROM stemmed")
def word_stems(v: Views):
    words = search.explode_array(v.documents, F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), "word").distinct()
    return words.select("word", stems(F.col("word")).alias("stem"))


DOCUMENT_TERMS = "WITH questions AS (SELECT item_id AS question_id, 'docs' AS repository_id, text FROM benchmark)" + UNDERSTOOD + f""",
term AS (SELECT DISTINCT question_id, regexp_replace(t, '[^a-z0-9]', '', 'g') AS word FROM (SELECT question_id, unnest(terms) AS t FROM understood)),
spoken AS (SELECT doc_id AS id, w AS word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower({words_sql('text')}), '[a-z0-9]+')) AS w FROM documents) GROUP BY ALL),
either AS (SELECT word FROM spoken UNION ALL SELECT word FROM term WHERE word <> ''),"""


# The same search as document_search_t2, by stems and without stop words.
@query("stemmed_search_t2", DOCUMENT_TERMS + stem_sql("either") + """,
asked AS (SELECT DISTINCT t.question_id, s.stem FROM term t JOIN stemmed s ON s.word = t.word WHERE s.stem IS NOT NULL),
held AS (SELECT p.id, s.stem, round(sum(0.1::DOUBLE * p.n), 6) AS weight FROM spoken p JOIN stemmed s ON s.word = p.word WHERE s.stem IS NOT NULL GROUP BY ALL)
SELECT question_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM (
 SELECT a.question_id, h.id, round(sum(h.weight), 6) AS score FROM asked a JOIN held h ON h.stem = a.stem GROUP BY ALL)) WHERE rank <= 40""")
def stemmed_search(v: Views):
    asked = search_plan.understand(v.benchmark.select(F.col("item_id").alias("question_id"), F.lit("docs").alias("repository_id"), "text"))
    return search.term_top_k(cut(asked), cut(search.postings(document_entities(v))), stem="english").drop("repository_id")
