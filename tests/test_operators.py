"""Golden cases, brute-force comparisons on small inputs, sinks and streams."""

import json

import numpy as np
from pyspark.sql import functions as F

from codestrata.functions import urls
from codestrata.operators import impact, resolve, search
from codestrata.operators.ranking import top_k
from codestrata.sources import events as event_files, store
from codestrata.streaming.answers import fold_answers, fold_stream


def one(spark, values, column):
    rows = spark.createDataFrame([(v,) for v in values], "x string").select("x", column.alias("y")).collect()
    return {r.x: (tuple(r.y) if r.y is not None and not isinstance(r.y, str) else r.y) for r in rows}


def test_github_addresses(spark):
    expected = {
        "https://github.com/acme/backend": ("acme", "backend", None), "https://github.com/acme/backend.git": ("acme", "backend", None),
        "https://github.com/acme/backend/tree/release/v2": ("acme", "backend", "release/v2"),
        "git@github.com:acme/my.repo.git": ("acme", "my.repo", None), "https://gitlab.com/acme/backend": None,
        "https://github.com/acme": None, "https://github.com.evil.com/acme/backend": None,
    }
    assert one(spark, expected, urls.github_address(F.col("x"))) == expected


def test_remotes(spark):
    good = ["git@github.com:acme/backend.git", "https://github.com/acme/backend", "https://github.com/acme/backend.git",
            "ssh://git@github.com/acme/backend.git", "https://user:x@github.com/acme/backend.git"]
    bad = ["git@gitlab.com:acme/backend.git", "/home/me/projects/backend"]
    assert one(spark, good + bad, urls.remote_full_name(F.col("x"))) == {**{g: "acme/backend" for g in good}, **{b: None for b in bad}}


def test_vector_top_k_over_many_blocks(spark):
    rng = np.random.default_rng(7)
    held = [("hot", i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(90)] + [("cold", i, [1.0, float(i), 0.0, 1.0]) for i in range(100, 105)]
    asked = [("hot", q, [float(x) for x in rng.integers(-3, 4, 4)]) for q in range(9)] + [("cold", 50, [1.0, 2.0, 0.0, 1.0]), ("none", 60, [1.0] * 4)]
    entities = spark.createDataFrame(held, "repository_id string, id long, embedding array<float>")
    questions = spark.createDataFrame(asked, "repository_id string, question_id long, embedding array<float>")
    got = {(r.question_id, r["rank"]): (r.id, r.score) for r in search.vector_top_k(questions, entities, 6, 10, 3).collect()}
    want = {}
    for repo, q, vector in asked:
        scored = []
        for other, i, e in held:
            if other == repo:
                a, b = np.array(vector), np.array(e)
                length = np.linalg.norm(a) * np.linalg.norm(b)
                scored.append((-round(float(a @ b / length), 6) if length else 0.0, i))
        for rank, (score, i) in enumerate(sorted(scored)[:6], 1):
            want[(q, rank)] = (i, -score)
    assert {k: (i, round(s, 6) + 0.0) for k, (i, s) in got.items()} == {k: (i, round(s, 6) + 0.0) for k, (i, s) in want.items()}


def test_term_top_k_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    index = [("hot", i, w, float(rng.integers(1, 5))) for i in range(60) for w in words if rng.random() < 0.3 or w == "w0"]
    asked = [("hot", q, [words[q % 12], "w0", words[(q * 5 + 1) % 12]]) for q in range(20)]
    df = spark.createDataFrame(index, "repository_id string, id long, term string, weight double")
    questions = spark.createDataFrame(asked, "repository_id string, question_id long, terms array<string>")
    got = {(r.question_id, r["rank"]): (r.id, r.score) for r in search.term_top_k(questions, df, 5, 7, 4).collect()}
    want = {}
    for _, q, terms in asked:
        total = {}
        for _, i, w, weight in index:
            if w in set(terms):
                total[i] = total.get(i, 0.0) + weight
        for rank, (i, score) in enumerate(sorted(total.items(), key=lambda p: (-p[1], p[0]))[:5], 1):
            want[(q, rank)] = (i, score)
    assert got == want


def test_large_top_k_is_exact(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    kept = top_k(df, ["g"], [F.desc("v")], 1500)
    assert kept.count() == 3000 and kept.agg(F.min("v")).first()[0] == 2000


CALLS = "repository_id string, id long, file_path string, symbol_name string, symbol_type string"


def edges_of(spark, entities, sites, imports=()):
    pool = spark.createDataFrame(entities, CALLS)
    asked = spark.createDataFrame(sites, "repository_id string, id long, file_path string, name string, relationship_type string")
    files = spark.createDataFrame(list(imports), "repository_id string, source_file string, target_file string")
    return {(r.source_entity_id, r.target_entity_id, r.relationship_type) for r in resolve.resolve_calls(asked, pool, files).collect()}


def test_call_tiers(spark):
    e = lambda i, path, name, kind="function": ("r", i, path, name, kind)
    pool = [e(1, "a.ts", "f"), e(2, "a.ts", "g"), e(3, "b.ts", "g"), e(4, "c.ts", "g"), e(5, "b.ts", "h"), e(6, "c.ts", "h"), e(7, "d.ts", "h"),
            e(8, "b.ts", "two"), e(9, "c.ts", "two"), e(10, "x.ts", "T", "type"), e(11, "a.ts", "f")]
    site = lambda name, kind="calls": ("r", 1, "a.ts", name, kind)
    assert edges_of(spark, pool, [site("g")]) == {(1, 2, "calls")}  # same file wins
    assert edges_of(spark, pool, [site("h")], [("r", "a.ts", "c.ts")]) == {(1, 6, "calls")}  # imported beats anywhere
    assert edges_of(spark, pool, [site("h")]) == set()  # three in all: none
    assert edges_of(spark, pool, [site("two"), site("two")]) == {(1, 8, "calls"), (1, 9, "calls")}  # two in all: both, once
    assert edges_of(spark, pool, [site("T")]) == set()  # a type cannot be called
    assert edges_of(spark, pool, [site("f", "handles")]) == {(1, 11, "handles")}  # never the caller itself


def test_impact_walk(spark):
    entities = spark.createDataFrame(
        [("r", i, "m.py" if i in (20, 21) else f"f{i}.py", f"n{i}", "class" if i == 20 else "function", "n20" if i == 21 else None) for i in (1, 2, 3, 4, 5, 6, 7, 20, 21, 22)],
        "repository_id string, id long, file_path string, symbol_name string, symbol_type string, parent string")
    # chain 5→4→3→2→1, a cycle 1→2, a diamond 6→2 and 6→3, a call 22→21 of a member of class 20
    edges = spark.createDataFrame([("r", s, t, "calls") for s, t in ((2, 1), (3, 2), (4, 3), (5, 4), (1, 2), (6, 2), (6, 3), (22, 21))],
                                  "repository_id string, source_entity_id long, target_entity_id long, relationship_type string")
    run = lambda **kw: {(r.target_id, r.id): (r.depth, r.via) for r in impact.change_impact(
        entities.where("id in (1, 20)"), entities, edges, **kw).collect()}
    assert run() == {(1, 2): (1, 1), (1, 3): (2, 2), (1, 6): (2, 2), (1, 4): (3, 3), (20, 22): (1, 21)}
    assert run(frontier_cap=1) == run()  # 3 comes before 6 in (via, id) order
    assert run(depth=1) == {(1, 2): (1, 1), (20, 22): (1, 21)}


EVENTS = [(1, 0, "meta", None, None, '{"n":1}'), (1, 1, "delta", "Hel", None, None), (1, 2, "delta", "lo", None, None),
          (1, 3, "verification", None, None, '{"ok":true}'), (2, 0, "delta", "x", None, None), (2, 1, "error", None, "broken", None)]
FOLDED = {(1, "Hello", '{"n":1}', '{"ok":true}', None), (2, "x", None, None, "broken")}


def test_event_files_and_stream(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, event_files.EVENT_SCHEMA)
    path = str(tmp_path / "events")
    event_files.write_events(events.repartition(1).sortWithinPartitions("question_id", "seq"), path)
    lines = [json.loads(line.value) for line in spark.read.text(path).collect()]
    assert {"question_id": 1, "seq": 1, "type": "delta", "text": "Hel"} in lines
    assert {tuple(r) for r in fold_answers(event_files.read_events(spark, path)).collect()} == FOLDED
    query = fold_stream(event_files.stream_events(spark, path), "complete").format("memory").queryName("folded").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("folded").collect()} == FOLDED


def test_replace_and_delete(spark, tmp_path):
    path = str(tmp_path / "files")
    make = lambda rows: spark.createDataFrame(rows, "repository_id string, path string, line_count long")
    store.replace_repositories(make([("a", "1", 1), ("a", "2", 2), ("b", "3", 3)]), path)
    store.replace_repositories(make([("a", "9", 9)]), path)
    rows = lambda df: {(r.repository_id, r.path) for r in df.collect()}
    assert rows(spark.read.parquet(path)) == {("a", "9"), ("b", "3")}
    left = store.without_repositories({"files": spark.read.parquet(path)}, spark.createDataFrame([("b",)], "repository_id string"))
    assert rows(left["files"]) == {("a", "9")}


def test_replace_to_nothing_and_delete_in_the_store(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "repository_id string, path string, line_count long")
    ids = lambda *values: spark.createDataFrame([(v,) for v in values], "repository_id string")
    files, edges = str(tmp_path / "files"), str(tmp_path / "edges")
    for path in (files, edges):
        store.replace_repositories(make([("a/x", "1", 1), ("b", "2", 2), ("c d", "3", 3)]), path)
    store.replace_repositories(make([("b", "9", 9)]), edges, ids("a/x", "b"))
    rows = lambda path: {(r.repository_id, r.path) for r in spark.read.parquet(path).collect()}
    assert rows(edges) == {("b", "9"), ("c d", "3")} and rows(files) == {("a/x", "1"), ("b", "2"), ("c d", "3")}
    store.delete_repositories(spark, store.tables_under(spark, str(tmp_path)), ids("b", "none", "c d"))
    assert rows(files) == {("a/x", "1")} and not list((tmp_path / "edges").glob("repository_id=*"))


def test_stream_state_is_released(spark, tmp_path):
    schema = event_files.EVENT_SCHEMA if isinstance(event_files.EVENT_SCHEMA, str) else event_files.EVENT_SCHEMA.simpleString()
    path = tmp_path / "timed"
    path.mkdir()

    def arrive(number, minute, rows):
        df = spark.createDataFrame(rows, schema).withColumn("at", F.lit(f"2024-01-01 00:{minute:02d}:00").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(path))

    arrive(0, 0, EVENTS)
    timed = spark.readStream.schema(spark.read.parquet(str(path)).schema).parquet(str(path))
    query = fold_stream(timed, "append", "at", "5 minutes", "1 minute").format("memory").queryName("timed").start()
    held = []
    for number, minute in enumerate((10, 20, 30), 1):
        query.processAllAvailable()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        arrive(number, minute, [(100 + number, 0, "delta", "later", None, None)])
    query.processAllAvailable()
    held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    query.stop()
    assert max(held) >= 2 and held[-1] == 1
    assert FOLDED <= {tuple(r) for r in spark.table("timed").collect()}


def test_impact_of_a_hub(spark):
    """An entity that 100,000 others call: all of them at depth 1, their one caller at depth 2."""
    n = 100_000
    entities = spark.range(n + 2).select(F.lit("r").alias("repository_id"), "id", F.lit("m.py").alias("file_path"), F.lit("n").alias("symbol_name"),
                                         F.lit("function").alias("symbol_type"), F.lit(None).cast("string").alias("parent"))
    calls = lambda source, target: spark.range(1, n + 1).select(F.lit("r").alias("repository_id"), source.alias("source_entity_id"), target.alias("target_entity_id"), F.lit("calls").alias("relationship_type"))
    edges = calls(F.col("id"), F.lit(0).cast("long")).union(calls(F.lit(n + 1).cast("long"), F.col("id")))
    found = impact.change_impact(entities.where("id = 0"), entities, edges).groupBy("depth").agg(F.count("*").alias("n"), F.min("via").alias("via")).collect()
    assert {(r.depth, r.n, r.via) for r in found} == {(1, n, 0), (2, 1, 1)}


def test_searches_of_one_large_repository(spark):
    """A third of all vectors and of all words in one repository, named by a constant: exact, and without nested loops."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(900, 8)).round(3)
    rows = [("big" if i % 3 == 0 else f"r{i % 50}", i, v.tolist()) for i, v in enumerate(vectors)]
    held = spark.createDataFrame(rows, "repository_id string, id long, embedding array<double>")
    asked = held.where("repository_id = 'big' and id % 30 = 0").select(F.lit("big").alias("repository_id"), F.col("id").alias("question_id"), "embedding")
    found = search.vector_top_k(asked, held, 5, entity_block=32, question_block=4)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    big = np.array([i for r, i, _ in rows if r == "big"])
    for q in {r.question_id for r in asked.collect()}:
        scores = np.round(unit[big] @ unit[q], 6)
        want = [int(big[i]) for i in np.lexsort((big, -scores))[:5]]
        assert [r.id for r in found.where(F.col("question_id") == q).orderBy("rank").collect()] == want
