"""Vector, term, symbol and hybrid search queries."""

from pyspark.sql import functions as F

from codestrata.functions import constants as C, vectors
from codestrata.operators import pruned, search
from codestrata.operators.ranking import broadcasts_by_measure, cut
from codestrata.plans import search as search_plan

from . import REGISTRY, query
from .text import UNDERSTOOD, words_sql
from .views import SYMBOL, Views, ctes

# Every vector is a question as well, all in one repository: the hot-group case.
@query("vector_neighbours_t1", """
SELECT q.vec_id AS question_id, e.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) DESC, e.vec_id) AS rank
FROM embeddings q, embeddings e QUALIFY rank <= 40""")
def vector_neighbours(v: Views):
    held = v.embeddings.select(F.lit("all").alias("repository_id"), F.col("vec_id").alias("id"), "embedding")
    asked = held.withColumnRenamed("id", "question_id")
    return search.vector_top_k(asked, held).drop("repository_id")


@query("pruned_neighbours_t1", REGISTRY["vector_neighbours_t1"].sql)
def pruned_neighbours(v: Views):
    held = v.embeddings.select(F.lit("all").alias("repository_id"), F.col("vec_id").alias("id"), "embedding")
    return pruned.vector_top_k_pruned(held.withColumnRenamed("id", "question_id"), *pruned.angle_rings(held))[0].drop("repository_id")


QUESTION_VECTOR = [((i * 37) % 11 - 5) / 10.0 for i in range(64)]


@query("nearest_vectors_t1", f"""
SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {QUESTION_VECTOR}::DOUBLE[]), 6) AS score
FROM embeddings ORDER BY score DESC, id LIMIT 40""")
def nearest_vectors(v: Views):
    return search.nearest(v.embeddings.withColumnRenamed("vec_id", "id"), F.array(*[F.lit(x) for x in QUESTION_VECTOR]))


@query("unit_vectors_f1", """
SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS length, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS unit_length,
 round(list_max(u), 6) AS largest FROM (SELECT *, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u
 FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * label + x) AS e FROM embeddings))""")
def unit_vectors(v: Views):
    scaled = v.embeddings.withColumn("e", F.transform("embedding", lambda x: x.cast("double") * F.col("label") + x.cast("double")))
    made = scaled.withColumn("u", vectors.unit(F.col("e")))
    return made.select(
        "vec_id", F.round(vectors.norm(F.col("e")), 6).alias("length"), F.round(vectors.norm(F.col("u")), 6).alias("unit_length"),
        F.round(F.array_max("u"), 6).alias("largest"),
    )


def embedded_sql(name: str, key: str, text: str, source: str) -> str:
    """Signed feature hashing by words, as (key, repository_id, bucket, x) with float32 unit components."""
    return f"""
{name}_word AS (SELECT {key}, repository_id, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {source}),
{name}_raw AS (SELECT {key}, repository_id, CAST(concat('0x', substring(md5(w), 1, 7)) AS BIGINT) % 384 AS bucket,
   CAST(sum(CASE WHEN substring(md5(w), 8, 1) < '8' THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM {name}_word GROUP BY ALL),
{name}_norm AS (SELECT {key}, sqrt(sum(x * x)) AS len FROM {name}_raw GROUP BY ALL),
{name} AS MATERIALIZED (SELECT r.{key}, r.repository_id, r.bucket, CAST(CAST(r.x / n.len AS FLOAT) AS DOUBLE) AS x FROM {name}_raw r JOIN {name}_norm n ON n.{key} = r.{key} WHERE n.len > 0)"""


EMBED_TEXT_SQL = f"concat_ws(' ', symbol_type, symbol_name, parent, route, file_path, {words_sql('symbol_name')}, content)"


@query("embedded_entities_f1_p14", ctes("entity_text") + "," + embedded_sql("ev", "id", EMBED_TEXT_SQL, "entity_text") + """
SELECT id, bucket, round(x, 6) AS x FROM ev WHERE x <> 0""")
def embedded_entities(v: Views):
    made = search_plan.embed_entities(v.entity_text)
    cells = made.select("id", F.posexplode("embedding").alias("bucket", "x")).where("x <> 0")
    return cells.select("id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("x").cast("double"), 6).alias("x"))


# Every second entity's vector is at hand from before; the others' texts are embedded once each.
@query("embedded_once_f1", REGISTRY["embedded_entities_f1_p14"].sql)
def embedded_once(v: Views):
    before = search_plan.embed_entities(v.entity_text.where("id % 2 = 0"), load=vectors.hashed_terms)
    made = search_plan.embed_entities(v.entity_text, load=vectors.hashed_terms, known=cut(before))
    cells = made.select("id", F.posexplode("embedding").alias("bucket", "x")).where("x <> 0")
    return cells.select("id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("x").cast("double"), 6).alias("x"))


POSTINGS_SQL = f"""
posting AS MATERIALIZED (SELECT repository_id, id, term, round(sum(weight), 6) AS weight, count(*) AS tf FROM (
  SELECT repository_id, id, unnest(regexp_extract_all(lower({words_sql('symbol_name')}), '[a-z0-9]+')) AS term, 1.0::DOUBLE AS weight FROM entity_text
  UNION ALL SELECT repository_id, id, unnest(regexp_extract_all(lower({words_sql('file_path')}), '[a-z0-9]+')), 0.4::DOUBLE FROM entity_text
  UNION ALL SELECT repository_id, id, unnest(regexp_extract_all(lower({words_sql('content')}), '[a-z0-9]+')), 0.1::DOUBLE FROM entity_text) GROUP BY ALL)"""


@query("postings_t2", ctes("entity_text") + "," + POSTINGS_SQL + " SELECT repository_id, id, term, weight, tf FROM posting")
def postings(v: Views):
    return search.postings(v.entity_text, stem=None)


# Benchmark passages are questions to the documents that hold them: one large repository.
@query("document_search_t2", "WITH questions AS (SELECT item_id AS question_id, 'docs' AS repository_id, text FROM benchmark)" + UNDERSTOOD + f""",
term AS (SELECT DISTINCT question_id, regexp_replace(t, '[^a-z0-9]', '', 'g') AS term FROM (SELECT question_id, unnest(terms) AS t FROM understood)),
word AS (SELECT doc_id AS id, w AS term, round(sum(0.1::DOUBLE), 6) AS weight FROM (SELECT doc_id, unnest(regexp_extract_all(lower({words_sql('text')}), '[a-z0-9]+')) AS w FROM documents) GROUP BY ALL)
SELECT question_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM (
 SELECT t.question_id, w.id, round(sum(w.weight), 6) AS score FROM term t JOIN word w ON w.term = t.term WHERE t.term <> '' GROUP BY ALL)) WHERE rank <= 40""")
def document_search(v: Views):
    return search.term_top_k(cut(document_questions(v)), cut(search.postings(document_entities(v), stem=None)), stem=None).drop("repository_id")


def document_questions(v: Views):
    return search_plan.understand(v.benchmark.select(F.col("item_id").alias("question_id"), F.lit("docs").alias("repository_id"), "text"))


def document_entities(v: Views):
    """Every document as an entity without a name."""
    return v.documents.select(F.lit("docs").alias("repository_id"), F.col("doc_id").alias("id"), F.col("text").alias("content"),
                              F.lit("").alias("symbol_name"), F.lit("").alias("file_path"))


@query("pruned_search_t2", REGISTRY["document_search_t2"].sql)
def pruned_search(v: Views):
    blocks = pruned.impact_blocks(cut(search.postings(document_entities(v), stem=None)))
    return pruned.term_top_k_pruned(cut(document_questions(v)), *blocks, stem=None)[0].drop("repository_id")


ASKED = ctes("questions", "entity_text") + UNDERSTOOD
SYMBOL_SQL = """
sym AS (SELECT * FROM (SELECT c.question_id, e.id, list_contains(list_transform(c.identifiers, lambda x: lower(x)), lower(e.symbol_name)) AS is_identifier,
   lower(e.symbol_name) AS name, row_number() OVER (PARTITION BY c.question_id ORDER BY e.id) AS rank
  FROM candidates c JOIN code_entities e ON e.repository_id = c.repository_id AND list_contains(c.candidates, lower(e.symbol_name))) WHERE rank <= 30)"""


@query("symbol_matches_j9", ASKED + "," + SYMBOL_SQL + " SELECT question_id, id, name, rank FROM sym")
def symbol_matches(v: Views):
    once, members = search_plan.asked_once(v.questions)
    found = search.symbol_matches(cut(search_plan.understand(once)), v.code_entities)
    return search_plan.given_to_all(found, members).select("question_id", "id", "name", "rank")


FUSED_SQL = "," + embedded_sql("ev", "id", EMBED_TEXT_SQL, "entity_text") + "," + embedded_sql(
    "qv", "question_id", f"concat('{C.QUERY_PREFIX}', text)", "questions") + "," + POSTINGS_SQL + "," + SYMBOL_SQL + """,
sim AS (SELECT p.question_id, p.id, round(coalesce(s.dot, 0) / p.lengths, 6) AS score FROM (
   SELECT q.question_id, e.id, q.len * e.len AS lengths FROM (SELECT question_id, any_value(repository_id) AS repository_id, sqrt(sum(x * x)) AS len FROM qv GROUP BY ALL) q
   JOIN (SELECT id, any_value(repository_id) AS repository_id, sqrt(sum(x * x)) AS len FROM ev GROUP BY ALL) e ON e.repository_id = q.repository_id) p
  LEFT JOIN (SELECT q.question_id, e.id, sum(q.x * e.x) AS dot FROM qv q JOIN ev e ON e.repository_id = q.repository_id AND e.bucket = q.bucket GROUP BY ALL) s
  ON s.question_id = p.question_id AND s.id = p.id),
sem AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM sim) WHERE rank <= 40),
term AS (SELECT DISTINCT question_id, repository_id, regexp_replace(t, '[^a-z0-9]', '', 'g') AS term FROM (SELECT question_id, repository_id, unnest(terms) AS t FROM understood)),
kw AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM (
   SELECT t.question_id, p.id, round(sum(p.weight), 6) AS score FROM term t JOIN posting p ON p.repository_id = t.repository_id AND p.term = t.term WHERE t.term <> '' GROUP BY ALL)) WHERE rank <= 40),
part AS (SELECT question_id, id, 1.0::DOUBLE / (60 + rank - 1) AS part, 1 AS src, score AS similarity FROM sem
  UNION ALL SELECT question_id, id, 0.8::DOUBLE / (60 + rank - 1), 2, NULL FROM kw
  UNION ALL SELECT question_id, id, CASE WHEN is_identifier THEN 3.0::DOUBLE / 60 ELSE 1.2::DOUBLE / 60 END, 3, NULL FROM sym),
fused AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM (
  SELECT question_id, id, round(sum(part), 9) AS score, max(similarity) AS similarity,
   array_to_string(list_transform(list_sort(list(DISTINCT src)), lambda s: ['semantic', 'keyword', 'symbol'][s]), ' + ') AS reasons FROM part GROUP BY ALL)) WHERE rank <= 30)"""
# "part" names a driver table too; inside these statements it is the list of partial scores.
FUSED_SQL = FUSED_SQL.replace("\npart AS", "\npiece AS").replace("FROM part GROUP BY ALL)) WHERE rank <= 30", "FROM piece GROUP BY ALL)) WHERE rank <= 30")


def _lists(v: Views, questions):
    asked = cut(search_plan.understand(questions))
    embedded = cut(search_plan.embed_entities(v.entity_text))
    asked_vectors = cut(vectors.embed_questions(asked.select("repository_id", "question_id", "search_text"), "search_text"))
    semantic = search.vector_top_k(asked_vectors, embedded)
    keyword = search.term_top_k(asked, cut(search.postings(v.entity_text, stem=None)), stem=None)
    lowered = asked.select("repository_id", "question_id", F.transform("identifiers", F.lower).alias("lowered"))
    symbol = search.symbol_matches(asked, v.code_entities).join(lowered, ["repository_id", "question_id"]).withColumn(
        "is_identifier", F.array_contains("lowered", F.col("name")))
    return semantic, keyword, symbol


@query("rank_fusion_w1", ASKED + FUSED_SQL + " SELECT question_id, id, score, similarity, reasons, rank FROM fused")
def rank_fusion(v: Views):
    once, members = search_plan.asked_once(v.questions)
    fused = search_plan.given_to_all(search.fuse(*_lists(v, once)), members)
    return fused.select("question_id", "id", "score", "similarity", F.array_join("reasons", " + ").alias("reasons"), "rank")


RETRIEVED_SQL = FUSED_SQL + f""",
scored AS (SELECT f.question_id, u.repository_id, f.id, f.similarity, f.reasons, u.query_type, e.symbol_type, e.symbol_name, e.route, round(f.score
  * CASE WHEN NOT u.about_tests AND regexp_matches(e.file_path, '{C.TEST_FILE_PATTERN}') THEN 0.5 ELSE 1 END
  * CASE WHEN regexp_matches(e.file_path, '{C.GENERATED_FILE_PATTERN}') THEN 0.5 ELSE 1 END
  * CASE WHEN u.query_type <> 'architecture' AND e.symbol_type IN ('doc', 'config') THEN 0.6 ELSE 1 END
  * CASE WHEN u.query_type = 'architecture' AND e.symbol_type IN ('doc', 'module') THEN 1.3 ELSE 1 END
  * CASE WHEN u.query_type = 'routes' AND e.route IS NOT NULL THEN 1.5 ELSE 1 END
  * CASE WHEN e.symbol_type = 'chunk' THEN 0.8 ELSE 1 END, 9) AS score
  FROM fused f JOIN understood u ON u.question_id = f.question_id JOIN code_entities e ON e.id = f.id),
retrieved AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM scored)
  WHERE rank <= CASE WHEN query_type = 'architecture' THEN 14 ELSE 10 END)"""


@query("hybrid_search_c2_w2", ASKED + RETRIEVED_SQL + " SELECT question_id, id, score, reasons, query_type, rank FROM retrieved")
def hybrid_search(v: Views):
    found = retrieved(v)
    return found.select("question_id", "id", "score", F.array_join("reasons", " + ").alias("reasons"), "query_type", "rank")


def retrieved(v: Views, questions=None):
    """Hits of every question, over embeddings and postings stored beforehand as an index would."""
    broadcasts_by_measure(v.spark)
    return search_plan.hybrid_search(
        v.questions if questions is None else questions, v.code_entities, cut(search_plan.embed_entities(v.entity_text)),
        cut(search.postings(v.entity_text, stem=None)), stem=None,
    )


# One needle of one to six letters for every part, in its repository.
NEEDLES = f"""
needles as (select p_partkey as needle_id, concat('repo', cast(p_partkey % 4 as string)) as repository_id,
 substring({SYMBOL}, cast(1 + p_partkey % 5 as int), cast(1 + p_partkey % 6 as int)) as needle from part)"""


@query("symbols_by_needle_p20_t3", ctes("code_entities") + "," + NEEDLES + f"""
SELECT needle_id, id, symbol_name, rank FROM (SELECT n.needle_id, e.id, e.symbol_name, row_number() OVER (
  PARTITION BY n.needle_id ORDER BY lower(e.symbol_name) = lower(n.needle) DESC, length(e.symbol_name), e.id) AS rank
 FROM needles n JOIN code_entities e ON e.repository_id = n.repository_id AND e.symbol_name ILIKE concat('%', n.needle, '%')
 WHERE e.symbol_type NOT IN ({", ".join(f"'{t}'" for t in C.NON_OUTLINE_TYPES)})) WHERE rank <= 50""")
def symbols_by_needle(v: Views):
    v.part.createOrReplaceTempView("part")
    needles = v.spark.sql("WITH " + NEEDLES + " SELECT * FROM needles")
    return search.find_symbols_of(needles, v.code_entities, cut(search.name_grams(v.code_entities))).select("needle_id", "id", "symbol_name", "rank")


# The same re-scoring over stand-in scores, with every entity type, tests, generated files and routes.
@query("rescore_w2", ctes("paths") + f"""
, hit AS (SELECT id, path AS file_path, 1.0::DOUBLE / (60 + id % 40) AS score, id % 2 = 0 AS about_tests,
  CASE id % 3 WHEN 0 THEN 'architecture' WHEN 1 THEN 'routes' ELSE 'flow' END AS query_type,
  CASE id % 5 WHEN 0 THEN 'doc' WHEN 1 THEN 'config' WHEN 2 THEN 'module' WHEN 3 THEN 'chunk' ELSE 'function' END AS symbol_type,
  CASE WHEN id % 4 = 0 THEN 'GET /x' END AS route FROM paths)
SELECT id, round(score * CASE WHEN NOT about_tests AND regexp_matches(file_path, '{C.TEST_FILE_PATTERN}') THEN 0.5 ELSE 1 END
 * CASE WHEN regexp_matches(file_path, '{C.GENERATED_FILE_PATTERN}') THEN 0.5 ELSE 1 END * CASE WHEN query_type <> 'architecture' AND symbol_type IN ('doc', 'config') THEN 0.6 ELSE 1 END
 * CASE WHEN query_type = 'architecture' AND symbol_type IN ('doc', 'module') THEN 1.3 ELSE 1 END * CASE WHEN query_type = 'routes' AND route IS NOT NULL THEN 1.5 ELSE 1 END
 * CASE WHEN symbol_type = 'chunk' THEN 0.8 ELSE 1 END, 9) AS score FROM hit""")
def rescore(v: Views):
    hits = v.paths.select(
        "id", F.col("path").alias("file_path"), (F.lit(1.0) / (F.lit(60) + F.col("id") % 40)).alias("score"), (F.col("id") % 2 == 0).alias("about_tests"),
        F.expr("case id % 3 when 0 then 'architecture' when 1 then 'routes' else 'flow' end").alias("query_type"),
        F.expr("case id % 5 when 0 then 'doc' when 1 then 'config' when 2 then 'module' when 3 then 'chunk' else 'function' end").alias("symbol_type"),
        F.expr("case when id % 4 = 0 then 'GET /x' end").alias("route"),
    )
    return hits.select("id", search.rescore(hits).alias("score"))
