"""Queries over file paths, repository addresses and import specifiers."""

from pyspark.sql import functions as F

from codestrata.functions import constants as C, paths, routes, text, urls
from codestrata.operators import resolve, stats, verify
from codestrata.sources import files as file_source

from . import query
from .views import BRAND, Views, ctes

PATHS = ctes("paths")


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def any_of(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def regex_any(values) -> str:
    return "|".join(v.replace(".", r"\.") for v in values)


IGNORED_SQL = (
    f"(regexp_matches(path, {lit('(^|/)(' + regex_any(C.IGNORED_DIRS) + ')/')}) OR regexp_matches(path, '(^|/)\\.[^/]*/')"
    f" OR regexp_extract(path, '[^/]*$') IN {any_of(C.IGNORED_FILES)} OR regexp_matches(path, {lit(C.IGNORED_NAME_PATTERN)}))"
)
NAME_SQL = "regexp_extract(path, '[^/]*$')"
LANGUAGE_SQL = (
    f"CASE {NAME_SQL} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in C.LANGUAGE_BY_NAME.items())
    + f" ELSE CASE lower(regexp_extract({NAME_SQL}, '^.+(\\.[^.]*)$', 1)) "
    + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in C.LANGUAGE_BY_EXT.items()) + " END END"
)


@query("ignore_filter_s2", PATHS + f"SELECT id, path, {IGNORED_SQL} AS ignored FROM paths")
def ignore_filter(v: Views):
    return v.paths.select("id", "path", paths.is_ignored(F.col("path")).alias("ignored"))


@query("size_and_count_caps_s3", PATHS + f"""
SELECT repository_id, path, size FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY path) AS r FROM paths
WHERE NOT {IGNORED_SQL} AND {LANGUAGE_SQL} IS NOT NULL AND size > 0 AND size <= 524288) WHERE r <= 6000""")
def size_and_count_caps(v: Views):
    return file_source.discover(v.paths, C.MAX_FILE_BYTES, C.MAX_FILES_PER_REPOSITORY).select("repository_id", "path", "size")


@query("discovered_files_s3", PATHS + f"""
SELECT repository_id, path, size FROM paths WHERE NOT {IGNORED_SQL} AND {LANGUAGE_SQL} IS NOT NULL AND size > 0""")
def discovered_files(v: Views):
    return file_source.discover(v.paths).select("repository_id", "path", "size")


@query("language_s4_source_flag_s5", PATHS + f"""
SELECT id, language, language NOT IN {any_of(C.NON_SOURCE_LANGUAGES)} AS is_source
FROM (SELECT id, {LANGUAGE_SQL} AS language FROM paths) WHERE language IS NOT NULL""")
def language_and_source_flag(v: Views):
    named = v.paths.select("id", paths.language_of(F.col("path")).alias("language")).where(F.col("language").isNotNull())
    return named.withColumn("is_source", paths.is_source_language(F.col("language")))


# The same steps one at a time, each in its own sub-query.
@query("module_of_path_p1", PATHS + f"""
, a AS (SELECT id, path, list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1) AS d FROM paths),
b AS (SELECT *, len(d) AS n, coalesce(list_position(list_transform(d, lambda x: x NOT IN {any_of(C.SOURCE_ROOTS)}), true), len(d) + 1) AS i FROM a),
c AS (SELECT *, i + CASE WHEN coalesce(d[i] IN {any_of(C.PACKAGE_ROOTS)}, false) THEN least(2, n - i) ELSE 0 END AS j FROM b),
e AS (SELECT *, j + CASE WHEN coalesce(d[j] IN {any_of(C.CONTAINER_DIRS)}, false) AND d[j + 1] IS NOT NULL THEN 1 ELSE 0 END AS k FROM c)
SELECT id, CASE WHEN n >= 2 AND d[1] IN {any_of(C.MONO_ROOTS)} THEN concat(d[1], '/', d[2]) ELSE coalesce(d[k], d[n], 'root') END AS module FROM e""")
def module_of_path(v: Views):
    return v.paths.select("id", paths.module_of(F.col("path")).alias("module"))


@query("test_and_generated_p7_p8", PATHS + f"""
SELECT id, regexp_matches(path, {lit(C.TEST_FILE_PATTERN)}) AS is_test, regexp_matches(path, {lit(C.GENERATED_FILE_PATTERN)}) AS is_generated FROM paths""")
def test_and_generated(v: Views):
    path = F.col("path")
    return v.paths.select("id", paths.is_test_file(path).alias("is_test"), paths.is_generated_file(path).alias("is_generated"))


@query("entry_points_x16", PATHS + f"""
SELECT repository_id, path, len(string_split(path, '/')) AS depth,
 row_number() OVER (PARTITION BY repository_id ORDER BY len(string_split(path, '/')), path) AS rank
FROM paths WHERE regexp_matches(path, {lit(C.ENTRY_POINT_PATTERN)}) QUALIFY rank <= 8""")
def entry_points(v: Views):
    return stats.entry_points(v.paths)


@query("file_path_routes_x13", PATHS + r"""
, named AS (SELECT id, path, CASE WHEN id % 3 = 0 THEN 'GET' WHEN id % 3 = 1 THEN 'default' ELSE 'helper' END AS name FROM paths)
SELECT id, route FROM (SELECT id, CASE
 WHEN regexp_matches(path, '(?:^|/)app/(.*?)/?route\.(?:t|j)sx?$') AND lower(name) IN ('get', 'post', 'put', 'patch', 'delete', 'all', 'options', 'head')
 THEN concat(upper(name), ' /', array_to_string(list_filter(string_split(regexp_extract(path, '(?:^|/)app/(.*?)/?route\.(?:t|j)sx?$', 1), '/'),
   lambda s: s <> '' AND NOT regexp_matches(s, '^\(.*\)$')), '/'))
 WHEN regexp_extract(path, '(?:^|/)pages/(api/.*?)(?:/index)?\.(?:t|j)sx?$', 1) <> '' AND name = 'default'
 THEN concat('ANY /', regexp_extract(path, '(?:^|/)pages/(api/.*?)(?:/index)?\.(?:t|j)sx?$', 1)) END AS route FROM named) WHERE route IS NOT NULL""")
def file_path_routes(v: Views):
    name = F.expr("case when id % 3 = 0 then 'GET' when id % 3 = 1 then 'default' else 'helper' end")
    return v.paths.select("id", paths.route_of_file(F.col("path"), name).alias("route")).where(F.col("route").isNotNull())


MESSY = ("case id % 4 when 0 then concat('./', path) when 1 then concat(path, '/../', cast(id as string)) "
         "when 2 then concat('../', path, '//x/./y') else concat('a/b/../../', path) end")


@query("normalize_path_p17", PATHS + f"""
SELECT id, coalesce(nullif(array_to_string(list_reduce(string_split(p, '/'), lambda acc, x: CASE WHEN x IN ('', '.') THEN acc
  WHEN x = '..' AND len(acc) > 0 AND acc[-1] <> '..' THEN list_slice(acc, 1, len(acc) - 1) ELSE list_append(acc, x) END, CAST([] AS VARCHAR[])), '/'), ''), '.') AS path
FROM (SELECT id, {MESSY} AS p FROM paths)""")
def normalize_path(v: Views):
    return v.paths.select("id", paths.normalize(F.expr(MESSY)).alias("path"))


DOTTED = (f"case p_partkey % 3 when 0 then concat('app.', {BRAND}, '.models') when 1 then concat('.', {BRAND}) "
          f"else concat('..core.', {BRAND}) end")


@query("dotted_path_p18", f"""
SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('app/', {BRAND}, '/models') WHEN 1 THEN concat('pkg/sub/', {BRAND})
 ELSE concat('pkg/core/', {BRAND}) END AS path FROM part""")
def dotted_path(v: Views):
    return v.part.select(F.col("p_partkey").alias("id"), paths.dotted_to_path(F.expr(DOTTED), F.lit("pkg/sub")).alias("path"))


@query("join_route_p19", f"""
SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('/', {BRAND}, '/items') WHEN 1 THEN concat('/', {BRAND}) ELSE '/' END AS route FROM part""")
def join_route(v: Views):
    prefix = F.expr(f"case p_partkey % 3 when 0 then concat('/', {BRAND}, '/') when 1 then {BRAND} else '' end")
    path = F.expr("case p_partkey % 3 when 0 then '//items/' when 1 then '' else '/' end")
    return v.part.select(F.col("p_partkey").alias("id"), paths.join_route(prefix, path).alias("route"))


# Page addresses carry a host and a path; both kinds of repository address are built from them.
HUB = ("case page_id % 5 when 0 then concat('https://github.com/', owner, '/', slug, '.git') "
       "when 1 then concat('git@github.com:', owner, '/', slug) when 2 then concat('https://www.github.com/', owner, '/', slug, '/tree/release/v', slug) "
       "when 3 then concat(' https://github.com/', owner, '?tab=', slug) else url end")
PAGE_PARTS = "select page_id, url, split_part(split_part(url, '/', 3), '.', 1) as owner, concat('r', cast(page_id as string), '.x') as slug from pages"


@query("github_url_s12", f"""
SELECT page_id, CASE WHEN page_id % 5 < 3 THEN owner END AS owner, CASE WHEN page_id % 5 < 3 THEN slug END AS repo,
 CASE WHEN page_id % 5 = 2 THEN concat('release/v', slug) END AS branch FROM ({PAGE_PARTS})""")
def github_url(v: Views):
    v.pages.createOrReplaceTempView("pages")
    return v.spark.sql(PAGE_PARTS).select("page_id", urls.github_address(F.expr(HUB)).alias("a")).select("page_id", "a.*")


REMOTE = ("case page_id % 6 when 0 then concat('git@github.com:', owner, '/', slug, '.git') "
          "when 1 then concat('ssh://git@github.com/', owner, '/', slug) when 2 then concat('https://user:secret@GitHub.com/', owner, '/', slug, '.git') "
          "when 3 then concat('git://github.com/', owner, '/', slug, '/') when 4 then concat('git@gitlab.com:', owner, '/', slug) else url end")


@query("git_remote_s13", f"SELECT page_id, CASE WHEN page_id % 6 < 4 THEN concat(owner, '/', slug) END AS full_name FROM ({PAGE_PARTS})")
def git_remote(v: Views):
    v.pages.createOrReplaceTempView("pages")
    return v.spark.sql(PAGE_PARTS).select("page_id", urls.remote_full_name(F.expr(REMOTE)).alias("full_name"))


PLACE = "case page_id % 3 when 0 then concat('/srv/', cast(page_id as string)) when 1 then concat('C:\\\\', cast(page_id as string)) else url end"


@query("source_kind_s14", """
SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'local' WHEN page_id % 4 = 0 THEN 'github' ELSE 'git' END AS kind FROM pages""")
def source_kind(v: Views):
    linked = F.when(F.col("page_id") % 4 == 0, F.lit("c1"))
    return v.pages.select("page_id", urls.source_kind(F.expr(PLACE), F.lit("github"), linked).alias("kind"))


@query("suffix_index_e1", PATHS + r"""
, p AS (SELECT repository_id, path, regexp_replace(regexp_replace(path, '\.py$', ''), '/__init__$', '') AS stem FROM paths WHERE path LIKE '%.py'),
k AS (SELECT repository_id, path, stem, array_to_string(list_slice(string_split(stem, '/'), i, 99), '/') AS key
  FROM (SELECT *, unnest(range(1, len(string_split(stem, '/')) + 1)) AS i FROM p))
SELECT repository_id, key, min(path) AS path FROM k WHERE key LIKE '%/%' OR key = stem GROUP BY ALL HAVING count(DISTINCT path) = 1""")
def suffix_index(v: Views):
    return resolve.suffix_index(v.paths, ".py")


# Import specifiers between files: every part is a file that imports the files of the next parts.
MODULE_FILES = f"""
select p_partkey as id, concat('repo', cast(p_partkey % 4 as string)) as repository_id,
 concat(case p_partkey % 5 when 0 then 'src/' when 1 then 'app/api/' when 2 then 'com/acme/' else '' end, {BRAND}, '/m', cast(p_partkey as string),
  case p_size % 6 when 0 then '.ts' when 1 then '/index.tsx' when 2 then '.py' when 3 then '/__init__.py' when 4 then '.java' else '/code.go' end) as path
from part"""
SPECS = f"""
select repository_id, file_path, case kind
  when 'ts' then case s % 4 when 0 then concat('@/', brand, '/m', cast(t as string)) when 1 then concat('../', brand, '/m', cast(t as string), '.js')
                 when 2 then concat(brand, '/m', cast(t as string)) else concat('@scope/m', cast(t as string)) end
  when 'py' then case s % 3 when 0 then concat(brand, '.m', cast(t as string)) when 1 then concat('acme.', brand, '.m', cast(t as string))
                 else concat('..', brand, '.m', cast(t as string)) end
  when 'java' then concat('com.acme.', brand, '.m', cast(t as string)) else concat('example.org/x/', brand, '/m', cast(t as string)) end as spec
from (select a.repository_id, a.path as file_path, a.id as s, b.id as t, split_part(b.path, '/m', 1) as prefix,
        case when a.path like '%.ts' or a.path like '%.tsx' then 'ts' when a.path like '%.py' then 'py' when a.path like '%.java' then 'java' else 'go' end as kind,
        regexp_extract(b.path, 'brand_[0-9]+', 0) as brand
      from module_files a join module_files b on b.id in (a.id + 4, a.id + 8, a.id + 12) and b.repository_id = a.repository_id) x"""
# In SQL: all candidate paths of a specifier in order of preference, first one that exists.
IMPORT_SQL = f"""WITH module_files AS ({MODULE_FILES}), specs AS (SELECT DISTINCT * FROM ({SPECS})),
base AS (SELECT *, regexp_replace(file_path, '/[^/]*$', '') AS dir FROM specs),
bases AS (SELECT *, CASE
   WHEN regexp_matches(file_path, '\\.tsx?$') THEN CASE
     WHEN spec LIKE '../%' THEN [concat(CASE WHEN dir LIKE '%/%' THEN concat(regexp_replace(dir, '/?[^/]*$', ''), '/') ELSE '' END, spec[4:])]
     WHEN spec LIKE '@/%' THEN [spec[3:], concat('src/', spec[3:])] WHEN spec NOT LIKE '@%' THEN [spec, concat('src/', spec)] ELSE [] END
   WHEN file_path LIKE '%.py' THEN CASE WHEN spec LIKE '..%'
     THEN [concat(CASE WHEN dir LIKE '%/%' THEN concat(regexp_replace(dir, '/?[^/]*$', ''), '/') ELSE '' END, replace(spec[3:], '.', '/'))]
     ELSE [replace(spec, '.', '/')] END
   WHEN file_path LIKE '%.java' THEN [replace(spec, '.', '/')] ELSE [] END AS b FROM base),
cand AS (
  SELECT repository_id, file_path, spec, concat(regexp_replace(x, CASE WHEN k = 1 THEN '\\.(js|jsx|mjs|cjs)$' ELSE '^$' END, ''), e) AS path, i * 100 + k * 50 + j AS pos
  FROM (SELECT *, unnest(b) AS x, unnest(range(len(b))) AS i FROM bases WHERE regexp_matches(file_path, '\\.tsx?$')), (SELECT unnest([0, 1]) AS k),
    (SELECT unnest([{', '.join(lit(s) for s in C.JS_CANDIDATE_SUFFIXES)}]) AS e, unnest(range({len(C.JS_CANDIDATE_SUFFIXES)})) AS j)
  UNION ALL SELECT repository_id, file_path, spec, concat(b[1], e), j FROM bases, (SELECT unnest(['.py', '/__init__.py']) AS e, unnest([0, 1]) AS j) WHERE file_path LIKE '%.py'
  UNION ALL SELECT s.repository_id, s.file_path, s.spec, x.path, 2 FROM bases s JOIN (
    SELECT repository_id, key, min(path) AS path, max(ext) AS ext FROM (
      SELECT m.repository_id, m.path, ext, stem, array_to_string(list_slice(string_split(stem, '/'), n, 99), '/') AS key FROM (
        SELECT *, unnest(range(1, len(string_split(stem, '/')) + 1)) AS n FROM (
          SELECT repository_id, path, regexp_extract(path, '\\.(py|java)$') AS ext,
            regexp_replace(regexp_replace(path, '\\.(py|java)$', ''), '/__init__$', '') AS stem FROM module_files WHERE regexp_matches(path, '\\.(py|java)$'))) m)
      WHERE key LIKE '%/%' OR key = stem GROUP BY repository_id, key, ext HAVING count(DISTINCT path) = 1) x
    ON x.repository_id = s.repository_id AND x.key = s.b[1] AND s.file_path LIKE concat('%', x.ext)),
hit AS (SELECT c.repository_id, c.file_path, c.spec, arg_min(c.path, c.pos) AS target_file FROM cand c
  JOIN module_files m ON m.repository_id = c.repository_id AND m.path = c.path GROUP BY ALL),
go AS (SELECT repository_id, file_path, spec, arg_max(dir, length(dir)) AS dir FROM (
   SELECT s.*, d.dir FROM specs s JOIN (SELECT DISTINCT repository_id, regexp_replace(path, '/[^/]*$', '') AS dir FROM module_files WHERE path LIKE '%.go') d
   ON d.repository_id = s.repository_id AND (s.spec = d.dir OR s.spec LIKE concat('%/', d.dir)) WHERE s.file_path LIKE '%.go') GROUP BY ALL)
"""


def _module_files(v: Views):
    v.part.createOrReplaceTempView("part")
    files = v.spark.sql(MODULE_FILES)
    files.createOrReplaceTempView("module_files")
    # The three following parts by key arithmetic: an equi-join, not a range join.
    text_of = SPECS.replace(
        "from module_files a join module_files b on b.id in (a.id + 4, a.id + 8, a.id + 12) and b.repository_id = a.repository_id",
        "from (select *, explode(array(id + 4, id + 8, id + 12)) as next from module_files) a join module_files b on b.id = a.next and b.repository_id = a.repository_id",
    )
    return files, v.spark.sql(text_of)


@query("import_targets_e2_e3_e4_e5", IMPORT_SQL + """
SELECT repository_id, file_path, spec, target_file FROM hit
UNION ALL SELECT g.repository_id, g.file_path, g.spec, m.path FROM go g JOIN module_files m ON m.repository_id = g.repository_id
 AND m.path LIKE '%.go' AND regexp_replace(m.path, '/[^/]*$', '') = g.dir""")
def import_targets(v: Views):
    files, specs = _module_files(v)
    return resolve.resolve_specs(specs, files)


@query("import_edges_e6", IMPORT_SQL + """
SELECT DISTINCT repository_id, file_path AS source_file, target_file FROM (SELECT repository_id, file_path, target_file FROM hit
UNION ALL SELECT g.repository_id, g.file_path, m.path FROM go g JOIN module_files m ON m.repository_id = g.repository_id
 AND m.path LIKE '%.go' AND regexp_replace(m.path, '/[^/]*$', '') = g.dir) WHERE file_path <> target_file""")
def import_edges(v: Views):
    files, specs = _module_files(v)
    return resolve.resolve_imports(specs, files)


REFERENCE = "case id % 4 when 0 then concat(path, ':12-30') when 1 then concat(path, ':7') when 2 then path else concat(path, ' is fine') end"


@query("code_reference_p16", PATHS + r"""
, ref AS (SELECT id, regexp_replace(path, '^[^/]*/', '') AS short, path FROM paths WHERE NOT contains(path, '('))
SELECT id AS question_id, text, 1 AS n, path AS file, CASE id % 4 WHEN 0 THEN 12 WHEN 1 THEN 7 ELSE 3 END AS start_line,
 CASE id % 4 WHEN 0 THEN 30 WHEN 1 THEN 7 ELSE 9 END AS end_line
FROM (SELECT id, path, CASE id % 4 WHEN 0 THEN concat(short, ':12-30') WHEN 1 THEN concat(short, ':7') WHEN 2 THEN short ELSE concat(short, ' is fine') END AS text FROM ref)
WHERE id % 4 < 3 AND NOT regexp_matches(path, '(Dockerfile)$')""")
def code_reference(v: Views):
    listed = v.paths.where(~F.contains(F.col("path"), F.lit("(")))
    sources = listed.select(F.col("id").alias("question_id"), F.lit(1).alias("n"), F.col("path").alias("file"),
                            F.lit(3).cast("long").alias("start_line"), F.lit(9).cast("long").alias("end_line"))
    short = listed.withColumn("path", F.regexp_replace("path", "^[^/]*/", ""))
    references = short.select(F.col("id").alias("question_id"), F.expr(REFERENCE).alias("text"))
    return verify.match_references(references, sources)


DECORATOR = f"""case p_partkey % 8
 when 0 then concat('@router.get("/', {BRAND}, '")') when 1 then concat('@app.route("/', {BRAND}, '", methods=["POST"])')
 when 2 then concat('@app.route("/', {BRAND}, '")') when 3 then concat('@GetMapping("/', {BRAND}, '")')
 when 4 then concat('@RequestMapping(value = "/', {BRAND}, '", method = RequestMethod.PUT)') when 5 then concat('@Post(', chr(39), {BRAND}, chr(39), ')')
 when 6 then '@Delete()' else '@Injectable()' end"""


@query("decorator_routes_x11", f"""
SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN concat('GET /v1/', {BRAND}) WHEN 1 THEN concat('POST /api/', {BRAND}) WHEN 2 THEN concat('GET /api/', {BRAND})
 WHEN 3 THEN concat('GET /api/', {BRAND}) WHEN 4 THEN concat('PUT /api/', {BRAND}) WHEN 5 THEN concat('POST /api/', {BRAND}) WHEN 6 THEN 'DELETE /api' END AS route FROM part""")
def decorator_routes(v: Views):
    prefixes = F.array(F.struct(F.lit("router").alias("key"), F.lit("/v1").alias("value")))
    return v.part.select(F.col("p_partkey").alias("id"), routes.decorator_route(F.expr(DECORATOR), F.lit("api"), prefixes).alias("route"))


@query("route_split_p15", ctes("code_entities") + """
SELECT id, split_part(route, ' ', 1) AS method, regexp_replace(route, '^[^ ]* ', '') AS path,
 contains(lower(concat(route, ' ', file_path, ' ', symbol_name)), 'brand_1') AS shown FROM code_entities WHERE route IS NOT NULL""")
def route_split(v: Views):
    route = F.col("route")
    return v.code_entities.where(route.isNotNull()).select(
        "id", text.route_method(route).alias("method"), text.route_path(route).alias("path"),
        text.route_matches(route, F.col("file_path"), F.col("symbol_name"), "BRAND_1").alias("shown"),
    )


MANIFEST = f"""select p_partkey as id, concat('repo', cast(p_partkey % 50 as string)) as repository_id,
 case p_size % 4 when 0 then concat({BRAND}, '/', cast(p_partkey as string), '/package.json') when 1 then concat(cast(p_partkey as string), '/requirements.txt')
  when 2 then concat(cast(p_partkey as string), '/go.mod') else concat(cast(p_partkey as string), '/notes.txt') end as path,
 case p_size % 7 when 0 then '{{"dependencies": {{"next": "1", "react" : "2"}}}}' when 1 then 'Flask==2' when 2 then 'require github.com/gin-gonic/gin v1'
  when 3 then 'fastapi, sqlalchemy' when 4 then '"@nestjs/core": "9", "passport"' when 5 then p_name else 'spring-boot "prisma"' end as content from part"""


RULES = f"""rule AS (SELECT unnest([{', '.join(lit(p) for p, _ in C.FRAMEWORK_PATTERNS)}]) AS pattern, unnest([{', '.join(lit(t) for _, t in C.FRAMEWORK_PATTERNS)}]) AS framework),
ordered AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY path) AS r FROM manifest WHERE regexp_matches(path, {lit(C.MANIFEST_PATTERN)}))"""
FEW_MANIFESTS = 20  # what a small index reads of a repository


@query("framework_tags_x15", f"WITH manifest AS ({MANIFEST}), {RULES} SELECT DISTINCT repository_id, framework FROM ordered, rule WHERE regexp_matches(content, pattern)")
def framework_tags(v: Views):
    v.part.createOrReplaceTempView("part")
    return stats.framework_tags(v.spark.sql(MANIFEST))


@query("first_manifests_x15", f"WITH manifest AS ({MANIFEST}), {RULES} SELECT DISTINCT repository_id, framework FROM ordered, rule WHERE r <= {FEW_MANIFESTS} AND regexp_matches(content, pattern)")
def first_manifests(v: Views):
    v.part.createOrReplaceTempView("part")
    return stats.framework_tags(v.spark.sql(MANIFEST), FEW_MANIFESTS)
