"""Queries over the catalogue, conversations, and table maintenance."""

from contextlib import suppress

from pyspark.sql import functions as F

from codestrata.operators.ranking import scratch_folder, union_all
from codestrata.operators.verify import verify_answers, answer_paths, unknown_paths, invalid_citations
from codestrata.sources import catalog, events, files as file_source, store, versions
from codestrata.streaming import answers as folding

from . import REGISTRY, query
from .paths import lit
from .views import Views, ctes
from codestrata.functions import constants as C

# Orders stand for indexed repositories: the customer is the owner, status P is private.
REPOSITORIES = """select cast(o_orderkey as string) as id, concat('p', cast(o_custkey as string)) as provider_repository_id,
 case when o_orderkey % 7 = 0 then 'git' else 'github' end as provider, case o_orderstatus when 'F' then 'ready' when 'O' then 'indexing' else 'error' end as status,
 o_orderstatus = 'P' as private, cast(o_custkey % 10 as string) as owner_connection_id, o_orderdate as created_at, o_orderdate as indexed_at,
 case when o_orderkey % 5 = 0 then concat('/srv/c', cast(o_custkey as string)) else concat('https://github.com/acme/c', cast(o_custkey as string)) end as url,
 concat('Acme/c', cast(o_custkey as string)) as full_name from orders"""
REPOS = f"WITH repositories AS ({REPOSITORIES})"


def _repositories(v: Views):
    v.orders.createOrReplaceTempView("orders")
    return v.spark.sql(REPOSITORIES)


@query("visible_repositories_p21_t7", REPOS + " SELECT id, private, created_at FROM repositories WHERE private = false OR owner_connection_id = '3'")
def visible_repositories(v: Views):
    return catalog.visible_repositories(_repositories(v), "3").select("id", "private", "created_at")


@query("visible_without_viewer_p21", REPOS + " SELECT id, status FROM repositories WHERE private = false")
def visible_without_viewer(v: Views):
    return catalog.visible_repositories(_repositories(v), None).select("id", "status")


@query("latest_project_w6", REPOS + """
SELECT provider_repository_id, id, status, indexed_at FROM (SELECT *, row_number() OVER (PARTITION BY provider_repository_id ORDER BY created_at DESC, id DESC) AS r
 FROM repositories) WHERE r = 1""")
def latest_project(v: Views):
    rows = _repositories(v).select("provider_repository_id", "id", "status", "indexed_at", "created_at")
    return catalog.latest_per_key(rows, "provider_repository_id", ["created_at", "id"]).drop("created_at")


@query("accessible_projects_j10", REPOS + """
, accessible AS (SELECT CAST(c_nationkey % 10 AS VARCHAR) AS viewer, concat('p', CAST(c_custkey AS VARCHAR)) AS provider_repository_id FROM customer),
best AS (SELECT a.viewer, a.provider_repository_id, r.id, r.status, row_number() OVER (PARTITION BY a.viewer, a.provider_repository_id ORDER BY r.created_at DESC, r.id DESC) AS n
 FROM accessible a JOIN repositories r USING (provider_repository_id) WHERE r.provider = 'github' AND (r.private = false OR r.owner_connection_id = a.viewer))
SELECT a.viewer, a.provider_repository_id, b.id AS project_id, b.status AS project_status FROM accessible a
LEFT JOIN best b ON b.viewer = a.viewer AND b.provider_repository_id = a.provider_repository_id AND b.n = 1""")
def accessible_projects(v: Views):
    accessible = v.customer.select(
        (F.col("c_nationkey") % 10).cast("string").alias("viewer"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("provider_repository_id")
    )
    found = catalog.accessible_with_projects(accessible, _repositories(v))
    return found.select("viewer", "provider_repository_id", F.col("project.id").alias("project_id"), F.col("project.status").alias("project_status"))


@query("project_match_j11", REPOS + """
, folders AS (SELECT concat('/srv/c', CAST(c_custkey AS VARCHAR)) AS folder, concat('acme/C', CAST(c_custkey AS VARCHAR)) AS name FROM customer)
SELECT f.folder, coalesce((SELECT arg_max(id, (created_at, id)) FROM repositories r WHERE r.url = f.folder),
 (SELECT arg_max(id, (created_at, id)) FROM repositories r WHERE lower(r.full_name) = lower(f.name) AND r.status <> 'error')) AS id FROM folders f""")
def project_match(v: Views):
    key = F.col("c_custkey").cast("string")
    folders = v.customer.select(F.concat(F.lit("/srv/c"), key).alias("folder"), F.concat(F.lit("git@github.com:acme/C"), key, F.lit(".git")).alias("remote"))
    return catalog.match_projects(folders, _repositories(v))


TOPICS = "case when c_custkey % 3 = 0 then 'null' else concat('[\"a\",\"b\",\"c\",\"d\",\"e\",\"f\",\"', c_mktsegment, '\"]') end"
RECORD = f"""concat('{{"id":', cast(c_custkey as string), ',"name":"', c_name, '","full_name":"acme/', c_name, '","html_url":"https://github.com/acme/', c_name,
 '","private":', case when c_nationkey % 2 = 0 then 'true' else 'false' end, ',"owner":{{"login":"acme","type":"', case when c_nationkey % 3 = 0 then 'Organization' else 'Bot' end,
 '"}},"description":"about ', c_mktsegment, '","forks_count":', cast(c_nationkey + 1 as string), ',"language":"Go","pushed_at":"2024-01-02","stargazers_count":', cast(c_nationkey as string), ',"size":12,"default_branch":"main","topics":', {TOPICS}, ',"archived":false}}')"""


@query("repository_metadata_s15", """
SELECT c_custkey AS id, concat('acme/', c_name) AS full_name, c_name AS name, 'acme' AS owner, CASE WHEN c_nationkey % 3 = 0 THEN 'Organization' ELSE 'User' END AS owner_type,
 c_nationkey % 2 = 0 AS private, concat('https://github.com/acme/', c_name) AS url, concat('about ', c_mktsegment) AS description, c_nationkey AS stars, c_nationkey + 1 AS forks, 'Go' AS language, 12 AS size_kb,
 'main' AS default_branch, '2024-01-02' AS updated_at, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('a,b,c,d,e,f,', c_mktsegment) END AS topics, false AS archived FROM customer""")
def repository_metadata(v: Views):
    flat = catalog.flatten_metadata(v.customer.select(F.expr(RECORD).alias("raw")))
    return flat.withColumn("topics", F.array_join("topics", ","))


@query("file_outline_s7", ctes("code_entities") + """
SELECT repository_id, file_path AS path, id, symbol_name, symbol_type, start_line, end_line, parent, route FROM code_entities
WHERE symbol_type NOT IN ('doc', 'config', 'chunk')""")
def file_outline(v: Views):
    text = v.files.withColumn("content", F.col("path"))
    return file_source.file_outline(v.files, text, v.code_entities)[1]


@query("file_content_s7", ctes("doc_files") + " SELECT repository_id, path, md5(content) AS digest FROM doc_files WHERE path LIKE '%.md'")
def file_content(v: Views):
    wanted = v.doc_files.where(F.col("path").endswith(".md"))
    content, _ = file_source.file_outline(wanted, v.doc_files, v.code_entities)
    return content.select("repository_id", "path", F.md5("content").alias("digest"))


# The files of every repository are written; then two repositories are replaced, and a third is indexed to no rows.
@query("replaced_repositories_s8", ctes("files") + """
SELECT repository_id, path, language, line_count + CASE WHEN repository_id IN ('repo0', 'repo1') THEN 1 ELSE 0 END AS line_count FROM files
WHERE repository_id <> 'repo2'""")
def replaced_repositories(v: Views):
    folder = scratch_folder(v.spark, "files")
    store.replace_repositories(v.files, folder)
    changed = v.files.where(F.col("repository_id").isin("repo0", "repo1")).withColumn("line_count", F.col("line_count") + 1)
    indexed = v.spark.createDataFrame([("repo0",), ("repo1",), ("repo2",)], "repository_id string")
    store.replace_repositories(changed, folder, indexed)
    return v.spark.read.parquet(folder).select("repository_id", "path", "language", "line_count")


# The same through versions, with a batch of other rows that fails before its pointers are written, and a compaction.
@query("replaced_versions_s8", REGISTRY["replaced_repositories_s8"].sql)
def replaced_versions(v: Views):
    root = scratch_folder(v.spark, "versions")
    versions.write_tables({"files": v.files}, root, v.files)
    changed = v.files.where(F.col("repository_id").isin("repo0", "repo1")).withColumn("line_count", F.col("line_count") + 1)
    broken = changed.withColumn("line_count", F.raise_error(F.lit("failed")).cast("long"))
    with suppress(Exception):
        versions.write_tables({"files": changed, "other": broken}, root, changed)
    indexed = v.spark.createDataFrame([("repo0",), ("repo1",), ("repo2",)], "repository_id string")
    versions.write_tables({"files": changed}, root, indexed)
    versions.compact(v.spark, root)
    return versions.read_table(v.spark, root, "files").select("repository_id", "path", "language", "line_count")


# Every document is written as a file, many under names that file readers pass over, and scanned back.
CORPUS = """select concat('r', cast(doc_id % 7 as string)) as repository_id, text as content, concat(cast(doc_id as string),
 case doc_id % 6 when 0 then '/__init__.py' when 1 then '/_app.tsx' when 2 then '/.env.example' when 3 then '/__tests__/x.ts' when 4 then '/.github/a b.yml' else '/main.py' end) as path
 from documents"""


@query("corpus_scan_s1", f"WITH corpus AS ({CORPUS}) SELECT repository_id, path, strlen(content) AS size, md5(content) AS digest FROM corpus")
def corpus_scan(v: Views):
    v.documents.createOrReplaceTempView("documents")
    folder = scratch_folder(v.spark, "corpus")
    file_source.write_corpus(v.spark.sql(CORPUS), folder)
    return file_source.scan_corpus(v.spark, folder).select("repository_id", "path", "size", F.md5("content").alias("digest"))


# All tables are stored and two repositories deleted from the store; what is left of each table is counted.
@query("cascade_delete_s9", ctes("code_entities", "relationships", "files", "file_imports") + """
SELECT 'code_entities' AS name, repository_id, count(*) AS n FROM code_entities WHERE repository_id NOT IN ('repo1', 'repo2') GROUP BY ALL
UNION ALL SELECT 'relationships', repository_id, count(*) FROM relationships WHERE repository_id NOT IN ('repo1', 'repo2') GROUP BY ALL
UNION ALL SELECT 'files', repository_id, count(*) FROM files WHERE repository_id NOT IN ('repo1', 'repo2') GROUP BY ALL
UNION ALL SELECT 'file_imports', repository_id, count(*) FROM file_imports WHERE repository_id NOT IN ('repo1', 'repo2') GROUP BY ALL""")
def cascade_delete(v: Views):
    root = scratch_folder(v.spark, "store")
    names = ("code_entities", "relationships", "files", "file_imports")
    for name in names:
        store.replace_repositories(getattr(v, name), f"{root}/{name}")
    deleted = v.spark.createDataFrame([("repo1",), ("repo2",)], "repository_id string")
    store.delete_repositories(v.spark, store.tables_under(v.spark, root), deleted)
    out = None
    for name in names:
        counted = v.spark.read.parquet(f"{root}/{name}").groupBy("repository_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "repository_id", "n")
        out = counted if out is None else union_all(out, counted)
    return out


@query("deleted_versions_s9", REGISTRY["cascade_delete_s9"].sql)
def deleted_versions(v: Views):
    root = scratch_folder(v.spark, "versions")
    names = ("code_entities", "relationships", "files", "file_imports")
    versions.write_tables({name: getattr(v, name) for name in names}, root, v.files)
    versions.delete_repositories(v.spark.createDataFrame([("repo1",), ("repo2",)], "repository_id string"), root)
    counted = [df.groupBy("repository_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "repository_id", "n")
               for name, df in versions.read_tables(v.spark, root).items()]
    return union_all(*counted)


@query("dense_ids_s10", ctes("paths") + " SELECT path, row_number() OVER (ORDER BY repository_id, path) AS id FROM (SELECT repository_id, path FROM paths)")
def assigned_ids(v: Views):
    from codestrata.operators.ranking import dense_ids

    return dense_ids(v.paths.select("repository_id", "path"), ["repository_id", "path"]).select("path", "id")


@query("recent_history_w5", """
SELECT conv_id, turn, role, substring(text, 1, 2000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
FROM conversations WHERE role IN ('user', 'assistant')) WHERE r <= 6""")
def recent_history(v: Views):
    from codestrata.operators.evidence import recent_history as recent

    return recent(v.conversations)


# The turns of a conversation as the events of one answer.
EVENTS = """select conv_id as question_id, turn as seq, case when turn = 0 then 'meta' when turn % 7 = 6 then 'verification' when turn % 11 = 10 then 'error' else 'delta' end as type,
 text, concat('e', cast(turn as string)) as message, concat('{"n":', cast(turn as string), '}') as payload from conversations"""
FOLD = f"""WITH events AS ({EVENTS})
SELECT question_id, coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE type = 'delta'), '') AS answer,
 arg_max(payload, seq) FILTER (WHERE type = 'meta') AS meta, arg_max(payload, seq) FILTER (WHERE type = 'verification') AS verification,
 arg_max(message, seq) FILTER (WHERE type = 'error') AS error FROM events GROUP BY question_id"""


@query("answer_fold_a16", FOLD)
def answer_fold(v: Views):
    v.conversations.createOrReplaceTempView("conversations")
    return folding.fold_answers(v.spark.sql(EVENTS))


@query("event_files_s11", EVENTS.replace("select conv_id", "SELECT conv_id"))
def event_file_round_trip(v: Views):
    v.conversations.createOrReplaceTempView("conversations")
    folder = scratch_folder(v.spark, "events")
    events.write_events(v.spark.sql(EVENTS), folder)
    return events.read_events(v.spark, folder)


PATHS_SQL = f"""
, token AS (SELECT question_id, repository_id, p, i FROM (SELECT question_id, repository_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (
  SELECT *, list_filter(f, lambda x, j: list_position(f, x) = j) AS ps FROM (SELECT *, regexp_extract_all(text, {lit(C.ANSWER_PATH_PATTERN)}) AS f FROM answers)))
  WHERE contains(p, '/')),
missing AS (SELECT * FROM token t WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repository_id = t.repository_id AND (f.path = t.p OR suffix(f.path, concat('/', t.p))))),
wrong AS (SELECT question_id, list_filter(c, lambda x, j: (x < 1 OR x > 6) AND list_position(c, x) = j) AS c FROM (
  SELECT question_id, list_transform(regexp_extract_all(text, '\\[S(\\d+)\\]', 1), lambda x: CAST(x AS BIGINT)) AS c FROM answers))"""
ANSWERS = ctes("answers", "files")


@query("answer_paths_v1", ANSWERS + PATHS_SQL + " SELECT question_id, p AS path FROM token")
def answer_path_list(v: Views):
    return v.answers.select("question_id", F.explode(answer_paths(F.col("text"))).alias("path"))


# The paths a small check would take.
@query("first_answer_paths_v1", ANSWERS + PATHS_SQL + f" SELECT question_id, p AS path FROM token WHERE i <= {C.MAX_ANSWER_PATHS}")
def first_answer_paths(v: Views):
    return v.answers.select("question_id", F.explode(answer_paths(F.col("text"), C.MAX_ANSWER_PATHS)).alias("path"))


@query("unverified_paths_v2_j8", ANSWERS + PATHS_SQL + " SELECT question_id, p AS path FROM missing")
def unverified_paths(v: Views):
    asked = v.answers.select("repository_id", "question_id", F.explode(answer_paths(F.col("text"))).alias("path"))
    return unknown_paths(asked, v.files).select("question_id", "path")


@query("invalid_citations_v3", ANSWERS + PATHS_SQL + " SELECT question_id, array_to_string(list_transform(c, lambda x: concat('S', CAST(x AS VARCHAR))), ',') AS citations FROM wrong")
def invalid_citation_list(v: Views):
    wrong = invalid_citations(F.col("text"), F.col("n_sources"))
    return v.answers.select("question_id", F.array_join(wrong, ",").alias("citations"))


@query("verified_answers_c5", ANSWERS + PATHS_SQL + """
SELECT a.question_id, coalesce((SELECT string_agg(p, ',' ORDER BY i) FROM missing m WHERE m.question_id = a.question_id), '') AS unverified_paths,
 (SELECT array_to_string(list_transform(c, lambda x: concat('S', CAST(x AS VARCHAR))), ',') FROM wrong w WHERE w.question_id = a.question_id) AS invalid_citations FROM answers a""")
def verified_answers(v: Views):
    checked = verify_answers(v.answers, v.files)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return checked.select("question_id", joined("unverified_paths"), joined("invalid_citations"))
