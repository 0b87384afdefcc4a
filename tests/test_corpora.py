"""Extraction, resolution and indexing of hand-written repositories with known answers."""

import corpora
import pytest
from pyspark.sql import functions as F

from codestrata.functions.paths import language_of
from codestrata.operators import chunks, extract, resolve
from codestrata.plans import index
from codestrata.sources import files as file_source


@pytest.fixture(scope="module")
def texts(spark):
    return corpora.raw_files(spark).withColumn("language", language_of(F.col("path"))).cache()


@pytest.fixture(scope="module")
def found(texts):
    rows = extract.extract_entities(texts).collect()
    return {(r.repository_id, r.file_path, r.symbol_name, r.start_line): r for r in rows}


EXPECTED = [
    # repository, file, name, first, last, type, parent, exported, route
    ("ts", "src/app.ts", "start", 11, 15, "function", None, True, None),
    ("ts", "src/app.ts", "double", 17, 17, "function", None, True, None),
    ("ts", "src/app.ts", "build", 19, 24, "function", None, False, None),
    ("ts", "src/app.ts", "UserService", 26, 37, "class", None, True, None),
    ("ts", "src/app.ts", "constructor", 28, 30, "method", "UserService", True, None),
    ("ts", "src/app.ts", "find", 31, 33, "method", "UserService", True, None),
    ("ts", "src/app.ts", "save", 34, 36, "method", "UserService", True, None),
    ("ts", "src/app.ts", "Shape", 39, 41, "interface", None, True, None),
    ("ts", "src/app.ts", "Kind", 43, 45, "type", None, False, None),
    ("ts", "src/app.ts", "Color", 47, 47, "enum", None, False, None),
    ("ts", "src/app.ts", "UserModel", 49, 49, "model", None, False, None),
    ("ts", "src/app.ts", "GET /users/:id", 51, 51, "route", None, False, "GET /users/:id"),
    ("ts", "src/app.ts", "POST /users", 52, 54, "route", None, False, "POST /users"),
    ("ts", "src/users/service.ts", "getUser", 1, 3, "function", None, True, None),
    ("ts", "src/users/index.ts", "default", 1, 3, "function", None, True, None),
    ("ts", "src/models/user.ts", "User", 1, 1, "interface", None, True, None),
    ("ts", "src/util/helper.js", "helper", 1, 3, "function", None, True, None),
    ("ts", "old/legacy.js", "run", 1, 1, "function", None, True, None),
    ("ts", "src/Button.tsx", "Button", 1, 3, "component", None, True, None),
    ("ts", "src/Button.tsx", "Card", 4, 4, "component", None, True, None),
    ("ts", "app/api/(g)/users/route.ts", "GET", 1, 3, "function", None, True, "GET /api/users"),
    ("ts", "app/api/(g)/users/route.ts", "helper", 4, 6, "function", None, True, None),
    ("ts", "src/cats.controller.ts", "CatsController", 1, 7, "class", None, True, None),
    ("ts", "src/cats.controller.ts", "findOne", 4, 6, "method", "CatsController", True, "GET /cats/:id"),
    ("py", "app/main.py", "read_user", 12, 22, "function", None, True, "GET /users/{id}"),
    ("py", "app/main.py", "User", 25, 33, "model", None, True, None),
    ("py", "app/main.py", "full", 28, 29, "method", "User", True, None),
    ("py", "app/main.py", "Meta", 31, 33, "class", None, True, None),
    ("py", "app/main.py", "inner", 32, 33, "method", "Meta", True, None),
    ("py", "app/main.py", "_login", 36, 41, "function", None, False, "POST /login"),
    ("py", "app/main.py", "last", 45, 45, "function", None, True, None),
    ("py", "app/views.py", "show", 1, 2, "function", None, True, None),
    ("py", "core/db.py", "connect", 1, 2, "function", None, True, None),
    ("java", "src/main/java/com/acme/UserController.java", "UserController", 7, 27, "class", None, True, None),
    ("java", "src/main/java/com/acme/UserController.java", "UserController", 12, 14, "method", "UserController", True, None),
    ("java", "src/main/java/com/acme/UserController.java", "find", 16, 20, "method", "UserController", True, "GET /api/users/{id}"),
    ("java", "src/main/java/com/acme/UserController.java", "Inner", 22, 26, "class", "UserController", False, None),
    ("java", "src/main/java/com/acme/UserController.java", "run", 23, 25, "method", "Inner", False, None),
    ("java", "src/main/java/com/acme/model/User.java", "User", 3, 6, "model", None, True, None),
    ("java", "src/main/java/com/acme/model/User.java", "Named", 8, 10, "interface", None, False, None),
    ("java", "src/main/java/com/acme/model/User.java", "name", 9, 9, "method", "Named", False, None),
    ("java", "src/main/java/com/acme/model/User.java", "Role", 12, 12, "enum", None, False, None),
    ("go", "main.go", "Server", 10, 12, "class", None, True, None),
    ("go", "main.go", "Handler", 14, 16, "interface", None, True, None),
    ("go", "main.go", "ID", 19, 19, "type", None, True, None),
    ("go", "main.go", "Item", 20, 22, "class", None, True, None),
    ("go", "main.go", "Start", 25, 28, "method", "Server", True, None),
    ("go", "main.go", "main", 30, 35, "function", None, False, None),
    ("go", "main.go", "GET /items", 31, 31, "route", None, False, "GET /items"),
    ("go", "main.go", "ANY /health", 32, 34, "route", None, False, "ANY /health"),
    ("go", "internal/store/store.go", "Open", 3, 4, "function", None, True, None),
    ("go", "internal/store/store_test.go", "TestOpen", 3, 4, "function", None, True, None),
]


def test_definitions(found):
    for repo, path, name, first, last, kind, parent, exported, route in EXPECTED:
        row = found.get((repo, path, name, first))
        assert row is not None, (repo, path, name, first)
        assert (row.end_line, row.symbol_type, row.parent, row.exported, row.route) == (last, kind, parent, exported, route), row
    assert len(found) == len(EXPECTED)


def test_calls_and_handlers(found):
    at = lambda repo, path, name, line: found[(repo, path, name, line)]
    assert at("ts", "src/app.ts", "start", 11).calls == ["getUser", "listen"]
    assert at("ts", "src/app.ts", "find", 31).calls == ["query"]
    assert at("ts", "src/app.ts", "UserService", 26).calls == []
    assert at("ts", "src/app.ts", "GET /users/:id", 51).handler == "getUser"
    assert at("ts", "src/app.ts", "POST /users", 52).handler is None
    assert at("ts", "src/app.ts", "POST /users", 52).calls == ["create"]
    assert at("ts", "src/Button.tsx", "Button", 1).calls == ["go"]
    assert at("py", "app/main.py", "read_user", 12).calls == ["load"]
    assert at("py", "app/main.py", "_login", 36).calls == ["check"]
    assert at("java", "src/main/java/com/acme/UserController.java", "find", 16).calls == ["NotFound", "load"]
    assert at("go", "main.go", "Start", 25).calls == ["Println", "listen"]
    assert at("go", "main.go", "GET /items", 31).handler == "listItems"


def test_imports(texts):
    specs = extract.extract_imports(texts)
    edges = {(r.source_file, r.target_file) for r in resolve.resolve_imports(specs, texts).collect()}
    assert edges == {
        ("src/app.ts", "src/users/service.ts"), ("src/app.ts", "src/models/user.ts"), ("src/app.ts", "src/util/helper.js"),
        ("src/app.ts", "src/users/index.ts"), ("src/app.ts", "old/legacy.js"),
        ("app/main.py", "app/views.py"), ("app/main.py", "app/pkg/__init__.py"), ("app/main.py", "app/pkg/tool.py"),
        ("app/main.py", "core/db.py"), ("app/user.py", "app/pkg/tool.py"),
        ("src/main/java/com/acme/UserController.java", "src/main/java/com/acme/model/User.java"),
        ("main.go", "internal/store/store.go"),
    }


def test_index_has_no_loose_ends(spark):
    raw = corpora.raw_files(spark).withColumn("size", F.length("content"))
    tables = index.index_corpus(raw)
    ids = tables["code_entities"].select("repository_id", "id").cache()
    edges = tables["relationships"].cache()
    assert ids.count() == ids.distinct().count()
    for end in ("source_entity_id", "target_entity_id"):
        assert edges.join(ids.withColumnRenamed("id", end), ["repository_id", end], "left_anti").count() == 0
    assert edges.where("source_entity_id = target_entity_id").count() == 0
    named = tables["code_entities"].select("id", "symbol_name")
    pairs = {(r.s, r.t, r.k) for r in edges.join(named.toDF("source_entity_id", "s"), "source_entity_id").join(
        named.toDF("target_entity_id", "t"), "target_entity_id").select("s", "t", F.col("relationship_type").alias("k")).collect()}
    assert ("start", "getUser", "calls") in pairs and ("GET /users/:id", "getUser", "handles") in pairs and ("build", "helper", "calls") in pairs
    facts = index.repository_facts(tables, raw)
    assert {r.repository_id for r in facts["stats"].collect()} == {"ts", "py", "java", "go"}


DOCS = [
    ("d", "README.md", "intro\n# One\ntext\n" + "\n".join(f"line {i}" for i in range(100)) + "\n## Two\nlast"),
    ("d", "notes.vue", "\n".join(f"row {i}" for i in range(130))),
    ("d", "yarn.lock", "x"), ("d", "a.min.js", "x"), ("d", "types.d.ts", "x"), ("d", "empty.md", ""),
    ("d", ".git/config.json", "{}"), ("d", "src/.env.example", "A=1"), ("d", "big.json", "x" * (512 * 1024 + 1)),
]


def test_discovery_and_chunks(spark):
    raw = spark.createDataFrame(DOCS, "repository_id string, path string, content string").withColumn("size", F.length("content"))
    kept = file_source.discover(raw, 512 * 1024)
    assert {r.path for r in file_source.discover(raw).collect()} == {r.path for r in kept.collect()} | {"big.json"}
    assert {r.path for r in kept.collect()} == {"README.md", "notes.vue", "src/.env.example"}
    pieces = [(r.file_path, r.symbol_name, r.symbol_type, r.start_line, r.end_line) for r in chunks.chunk_files(kept).collect()]
    assert set(pieces) == {
        ("README.md", "README.md › README.md", "doc", 1, 1), ("README.md", "README.md › One", "doc", 2, 61),
        ("README.md", "README.md › One", "doc", 62, 103), ("README.md", "README.md › Two", "doc", 104, 105),
        ("notes.vue", "notes.vue (lines 1-60)", "chunk", 1, 60), ("notes.vue", "notes.vue (lines 61-120)", "chunk", 61, 120),
        ("notes.vue", "notes.vue (lines 121-130)", "chunk", 121, 130), ("src/.env.example", ".env.example", "config", 1, 1),
    }


def test_scan_corpus(spark, tmp_path):
    (tmp_path / "r1" / "src").mkdir(parents=True)
    (tmp_path / "r1" / "src" / "a.py").write_text("def f():\n    return 1\n")
    (tmp_path / "r2").mkdir()
    (tmp_path / "r2" / "b.md").write_text("# B\n")
    (tmp_path / "r2" / "empty.md").write_text("")
    hidden = ["pkg/__init__.py", "pkg/_util.py", ".env.example", "src/__tests__/x.ts", "pages/_app.tsx", ".git/config", "a b/ü.py"]
    for name in hidden:
        (tmp_path / "r3" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r3" / name).write_text(name)
    (tmp_path / "r3" / "latin.txt").write_bytes(b"\xe9")
    rows = {(r.repository_id, r.path, r.content) for r in file_source.scan_corpus(spark, str(tmp_path)).collect()}
    assert rows == {("r1", "src/a.py", "def f():\n    return 1\n"), ("r2", "b.md", "# B\n"), ("r2", "empty.md", ""), ("r3", "latin.txt", "\ufffd")} | {("r3", n, n) for n in hidden}
    small = {r.path for r in file_source.scan_corpus(spark, str(tmp_path), max_bytes=4).collect()}
    assert small == {"b.md", "empty.md", "latin.txt"}


def test_loose_calls(spark):
    """Only real calls of a whole file: no comments, strings or definitions."""
    files = [
        ("Python", "# helper(\nx = 'fake(x)'\ndef one(a):\n    pass\nclass Two(Base):\n    def m(self):\n        pass\nrun(load(1))\n", ["run", "load"]),
        ("TypeScript", "// helper(\nconst s = `fake(x)`;\nfunction one(a) { }\nclass A {\n  async find(id: string): Promise<B> {\n    return this.query(id);\n  }\n}\nstart(1);\n", ["query", "start"]),
        ("Java", "/* helper( */\npublic class A {\n  @Get(\"/x\")\n  public String find(Long id) {\n    return service.load(id);\n  }\n}\n", ["Get", "load"]),
        ("Go", "// helper(\nfunc (s *Store) Name(id string) error {\n\treturn load(id)\n}\nfunc init() {\n\tr.GET(\"/x\", h)\n}\n", ["load", "GET"]),
    ]
    df = spark.createDataFrame([(language, content) for language, content, _ in files], "language string, content string")
    got = {r.language: r.calls for r in df.select("language", extract.loose_calls(F.col("content"), F.col("language")).alias("calls")).collect()}
    assert {k: [c for c in v if c != "Get"] for k, v in got.items()} == {language: [c for c in calls if c != "Get"] for language, _, calls in files}
