"""Code-repository tables derived from the driver tables: whole tables, the same SQL text in both engines.

Parts stand for code entities, consecutive parts of an order for calls, every part for one question, and every
assistant turn for one answer.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from codestrata.operators.ranking import cut

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

CAMEL = (
    "concat(split_part(p_name, ' ', 1), upper(substring(split_part(p_name, ' ', 2), 1, 1)), "
    "substring(split_part(p_name, ' ', 2), 2))"
)
# One name in three is unique in its repository; the others are shared by many entities.
SYMBOL = f"case when p_partkey % 3 = 0 then concat({CAMEL}, cast(p_partkey as string)) else {CAMEL} end"
BRAND = "lower(replace(p_brand, '#', '_'))"
LANGUAGE = "case p_size % 4 when 0 then 'TypeScript' when 1 then 'Python' when 2 then 'Java' else 'Go' end"
EXT = "case p_size % 4 when 0 then '.ts' when 1 then '.py' when 2 then '.java' else '.go' end"

UPPER = f"concat(upper(substring({SYMBOL}, 1, 1)), substring({SYMBOL}, 2))"
KEY = "cast(p_partkey as string)"
NEXT = "cast(p_partkey + 4 as string)"


def _lines(*rows: str) -> str:
    """Source text with {name}, {Name}, {brand}, {key} and {next} filled in, as a SQL expression."""
    text = "\n".join(rows).replace("'", "''")
    marks = {"{name}": SYMBOL, "{Name}": UPPER, "{brand}": BRAND, "{key}": KEY, "{next}": NEXT}
    for mark, expression in marks.items():
        text = text.replace(mark, f"', {expression}, '")
    return "concat(" + ", ".join(x for x in f"'{text}'".replace("\n", "', chr(10), '").split("\0")) + ")"


TS_CODE = _lines(
    "import { load } from '../{brand}/f{next}';", 'import React from "react";', "", "export function {name}(id: string) {",
    '  const text = "} not an end";', "  if (id) { return load(id); }", "  return format(text); // }", "}", "",
    "export class {Name}Service {", "  find(id: string) {", "    return this.query(id);", "  }", "}", "",
    "app.get('/{brand}/{key}', {name});")
PY_CODE = _lines(
    "from app.{brand} import f{next}", "", 'router = APIRouter(prefix="/{brand}")', "", "", '@router.post("/{id}")', "def {name}(id):",
    '    """Docs', "def fake():", '    """', "    return load(id)", "", "", "class {Name}Model(BaseModel):", "    def full(self):",
    "        return join(self.name)")
JAVA_CODE = _lines(
    "package com.acme.{brand};", "", "import com.acme.{brand}.F{next};", "", '@RequestMapping("/{brand}")', "public class F{key} {",
    '    @GetMapping("/{id}")', "    public String {name}(Long id) {", '        if (id == null) { throw new Missing("{"); }',
    "        return service.load(id);", "    }", "}")
GO_CODE = _lines(
    "package f{key}", "", 'import "example.org/{brand}/f{next}"', "", "type Store struct {", "    name string", "}", "",
    "func (s *Store) {Name}(id string) error {", "    return load(id)", "}", "", "func init() {", '    r.GET("/{brand}/{key}", {name})', "}")

TSX_CODE = _lines(
    'import React from "react";', "", "export enum {Name}Kind { A, B }", "", "export interface {Name}Props {", "  id: string;", "}", "",
    "export type {Name}Key = string;", "", "export function {Name}Card(props: {Name}Props) {", "  return <div>{load(props.id)}</div>;", "}", "",
    "export const {Name}List = (props: {Name}Props) => {", "  return <ul>{show(props.id)}</ul>;", "};", "", "@Controller('/{brand}')", "export class {Name}Controller {",
    "  @Get('/:id')", "  find(id: string) {", "    return this.query(id);", "  }", "}")
JAVA_MORE = _lines(
    "package com.acme.{brand};", "", "public record R{key}(Long id) {", "    public Long twice() {", "        return times(id);", "    }", "}", "", "interface I{key} {",
    "    Long find(Long id);", "}")
GO_MORE = _lines("package g{key}", "", "type Reader interface {", "    Read(id string) error", "}", "", "type (", "    Key string", ")")
LONG_CODE = _lines("def {name}(x):").rstrip(")") + ", repeat(concat(chr(10), '    step(x)'), 450))"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "code_entities": (("part",), f"""
select p_partkey as id, concat('repo', cast(p_partkey % 4 as string)) as repository_id,
 concat('src/', {BRAND}, '/mod', cast(p_size % 3 as string), {EXT}) as file_path,
 {SYMBOL} as symbol_name,
 case p_type when 'STANDARD' then 'function' when 'SMALL' then 'method' when 'LARGE' then 'class'
             when 'PROMO' then 'component' when 'ECONOMY' then 'model' else 'interface' end as symbol_type,
 {LANGUAGE} as language, cast(p_size as bigint) as start_line, cast(p_size + 10 as bigint) as end_line, {BRAND} as module,
 case when p_type = 'SMALL' then {CAMEL} end as parent, p_size % 2 = 0 as exported,
 case when p_size % 10 = 0 then concat('GET /', replace(p_name, ' ', '/')) end as route
from part"""),
    "relationships": (("lineitem",), """
select distinct concat('repo', cast(src % 4 as string)) as repository_id,
 src as source_entity_id, dst as target_entity_id,
 case when (src + dst) % 5 = 0 then 'handles' else 'calls' end as relationship_type
from (select l_partkey as src,
             lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as dst
      from lineitem) t
where dst is not null and src <> dst and src % 4 = dst % 4"""),
    "files": (("code_entities",), """
select repository_id, file_path as path, language, module,
 cast(sum(end_line) as bigint) * 40 as size, cast(sum(end_line) as bigint) as line_count
from code_entities group by repository_id, file_path, language, module"""),
    "file_imports": (("relationships", "code_entities"), """
select distinct r.repository_id, a.file_path as source_file, b.file_path as target_file
from relationships r join code_entities a on a.id = r.source_entity_id
 join code_entities b on b.id = r.target_entity_id
where a.file_path <> b.file_path and (r.source_entity_id + r.target_entity_id) % 3 = 0"""),
    "questions": (("part",), f"""
select p_partkey as question_id, concat('repo', cast(p_partkey % 4 as string)) as repository_id,
 case p_partkey % 9
  when 0 then concat('What would break if I rename ', {CAMEL}, '?')
  when 1 then concat('What depends on `', {CAMEL}, '()`?')
  when 2 then concat('Show me all API routes of ', p_name)
  when 3 then concat('Explain the architecture around ', {BRAND})
  when 4 then concat('Why does ', p_name, ' fail with 500?')
  when 5 then concat('How should I extend ', {SYMBOL}, '()?')
  when 6 then concat('How does ', replace(p_name, ' ', '_'), ' work in tests?')
  when 7 then concat('Where is ', p_name, ' created?')
  else concat('Tell me about ', {BRAND}, ' ', p_name) end as text
from part"""),
    "wide_files": (("part",), f"""
select concat('repo', cast(p_partkey % 4 as string)) as repository_id, concat('src/', case p_size % 4 when 0 then 'C' when 1 then 'l' when 2 then 'R' else 'g' end, cast(p_partkey as string),
 case p_size % 4 when 0 then '.tsx' when 1 then '.py' when 2 then '.java' else '.go' end) as path, {LANGUAGE} as language,
 case p_size % 4 when 0 then {TSX_CODE} when 1 then {LONG_CODE} when 2 then {JAVA_MORE} else {GO_MORE} end as content from part"""),
    "focused_questions": (("questions", "code_entities"), """
select q.question_id, q.repository_id, concat_ws(' ', q.text, e.symbol_name) as text, q.text as asked_text, e.id as focus_entity_id
from questions q left join code_entities e on e.repository_id = q.repository_id and e.id = q.question_id and q.question_id % 5 = 0"""),
    "overviews": (("files",), """
select repository_id, concat('Files in all: ', cast(count(*) as string), ', lines: ', cast(sum(line_count) as string)) as section from files group by repository_id"""),
    "answers": (("conversations",), """
select conv_id * 1000 + turn as question_id, concat('repo', cast(conv_id % 4 as string)) as repository_id,
 concat(text, ' See [S', cast(turn as string), '], [S', cast(conv_id % 12 as string),
 '] in src/brand_', cast(conv_id % 40 as string), '/mod', cast(turn % 3 as string), '.ts and brand_',
 cast(conv_id % 25 as string), '/mod1.py, not config.json.') as text, 6 as n_sources
from conversations where role = 'assistant'"""),
    # Every part names one file of its own; some are build output, lockfiles, tests or documentation.
    "paths": (("part",), f"""
select p_partkey as id, concat('repo', cast(p_partkey % 4 as string)) as repository_id,
 case p_size % 16
  when 0 then concat('node_modules/', {BRAND}, '/file', cast(p_partkey as string), '.js')
  when 1 then concat('packages/', {BRAND}, '/src/file', cast(p_partkey as string), '.ts')
  when 2 then concat('src/main/java/com/acme/', {BRAND}, '/File', cast(p_partkey as string), '.java')
  when 3 then concat('.github/', {BRAND}, '/file', cast(p_partkey as string), '.yml')
  when 4 then concat('src/', {BRAND}, '/', cast(p_partkey as string), '/package-lock.json')
  when 5 then concat('src/routes/', {BRAND}, '/test_file', cast(p_partkey as string), '.py')
  when 6 then concat('lib/', {BRAND}, '/file', cast(p_partkey as string), '.min.js')
  when 7 then concat('docs/', {BRAND}, '/', cast(p_partkey as string), '/README.md')
  when 8 then concat('services/', {BRAND}, '/', cast(p_partkey as string), '/Dockerfile')
  when 9 then concat('app/', {BRAND}, '/(group)/', cast(p_partkey as string), '/route.ts')
  when 10 then concat('pages/api/', {BRAND}, '/', cast(p_partkey as string), '/index.js')
  when 11 then concat('internal/', {BRAND}, '/file', cast(p_partkey as string), '_test.go')
  when 12 then concat('file', cast(p_partkey as string), '.rs')
  when 13 then concat('backend/generated/', {BRAND}, '/file', cast(p_partkey as string), '.pb.go')
  when 14 then concat('cmd/', {BRAND}, '/', cast(p_partkey as string), '/main.go')
  else concat('src/', {BRAND}, '/.hidden', cast(p_partkey as string), '.toml') end as path,
 cast(p_size as bigint) * 12000 * (p_partkey % 2) as size
from part"""),
    # One row per document as a file of a repository; every fifth line becomes a heading in the Markdown half.
    "doc_files": (("documents",), """
select concat('repo', cast(doc_id % 4 as string)) as repository_id, concat('docs/', source, '/doc', cast(doc_id as string),
 case when doc_id % 2 = 0 then '.md' else '.vue' end) as path, case when doc_id % 2 = 0 then 'Markdown' else 'Vue' end as language,
 case when doc_id % 2 = 0 then replace(text, concat('.', chr(10)), concat('.', chr(10), '## ')) else text end as content
from documents"""),
    # One source file per part, in one of four languages.
    "code_files": (("part",), f"""
select concat('repo', cast(p_partkey % 4 as string)) as repository_id,
 case p_size % 4 when 0 then concat('src/', {BRAND}, '/f', {KEY}, '.ts') when 1 then concat('app/', {BRAND}, '/f', {KEY}, '.py')
  when 2 then concat('src/main/java/com/acme/', {BRAND}, '/F', {KEY}, '.java') else concat({BRAND}, '/f', {KEY}, '/code.go') end as path,
 {LANGUAGE} as language,
 case p_size % 4 when 0 then {TS_CODE} when 1 then {PY_CODE} when 2 then {JAVA_CODE} else {GO_CODE} end as content
from part"""),
    # Entities with text: a document where one has the same number, else a line of code.
    "entity_text": (("code_entities", "documents"), """
select e.*, coalesce(d.text, concat('return ', e.symbol_name, '(', e.module, ');')) as content
from code_entities e left join documents d on d.doc_id = e.id"""),
}


def _needed(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for parent in VIEWS[name][0]:
                add(parent)
            order.append(name)

    for name in names:
        add(name)
    return order


def ctes(*names: str) -> str:
    """'WITH …' for the named views and those they rest on."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in _needed(names))


class Views:
    """The tables of one data folder as DataFrames; each is planned on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in BASE):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                parents, text = VIEWS[name]
                for parent in parents:
                    getattr(self, parent).createOrReplaceTempView(parent)
                self._made[name] = self.spark.sql(text)
        return self._made[name]

    def store(self, *names: str) -> "Views":
        """Stores tables, as an index would: they, and tables that rest on them, are read from there and not made again."""
        for name in names:
            self._made[name] = cut(getattr(self, name))
        return self

    @cached_property
    def targets(self) -> DataFrame:
        """Every entity as an impact target."""
        return self.code_entities.select("repository_id", "id", "symbol_name", "symbol_type", "file_path")
