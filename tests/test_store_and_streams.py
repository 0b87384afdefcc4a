"""Versioned tables with one visible switch, answers that leave the stream when they end, listings, and reused embeddings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.functions import vectors
from codestrata.functions.text import severity
from codestrata.operators import chunks, impact, reach
from codestrata.operators.embedding import embed_once
from codestrata.sources import events as event_files, files as file_source, versions
from codestrata.streaming import closing
from codestrata.streaming.answers import fold_answers

FILES = "repository_id string, path string, line_count long"


def _files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def _ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "repository_id string")


def _seen(spark, root):
    return {name: sorted(tuple(r) for r in df.collect()) for name, df in versions.read_tables(spark, root).items()}


def test_a_batch_that_fails_between_two_tables_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "index")
    old = {"files": _files(spark, [("a", "1", 1), ("b", "2", 2)]), "edges": _files(spark, [("a", "x", 10), ("b", "y", 20)])}
    versions.write_tables(old, root, _ids(spark, "a", "b"))
    before = _seen(spark, root)
    new = _files(spark, [("a", "9", 9)])
    with pytest.raises(Exception, match="broken"):
        versions.write_tables({"files": new, "edges": new.withColumn("line_count", F.raise_error(F.lit("broken")).cast("long"))}, root, _ids(spark, "a"))
    assert list((tmp_path / "index" / "first" / "files").glob("bucket=*/version=*2-*"))  # its first table was written
    assert _seen(spark, root) == before == {"files": [("a", "1", 1), ("b", "2", 2)], "edges": [("a", "x", 10), ("b", "y", 20)]}
    versions.write_tables({"files": new, "edges": new}, root, _ids(spark, "a"))
    assert _seen(spark, root) == {"files": [("a", "9", 9), ("b", "2", 2)], "edges": [("a", "9", 9), ("b", "y", 20)]}


def test_replacing_deleting_and_compacting(spark, tmp_path):
    root = str(tmp_path / "index")
    versions.write_tables({"files": _files(spark, [("a/x", "1", 1), ("b", "2", 2), ("c d", "3", 3)]), "edges": _files(spark, [("b", "e", 1)])}, root, _ids(spark, "a/x", "b", "c d"))
    versions.write_tables({"files": _files(spark, [("other", "not named", 0)]), "edges": _files(spark, [])}, root, _ids(spark, "b"))
    assert _seen(spark, root) == {"files": [("a/x", "1", 1), ("c d", "3", 3)], "edges": []}
    held = versions.read_table(spark, root, "files")  # a reader that began before
    versions.delete_repositories(_ids(spark, "c d", "never there"), root)
    assert _seen(spark, root)["files"] == [("a/x", "1", 1)]
    versions.compact(spark, root)
    assert _seen(spark, root) == {"files": [("a/x", "1", 1)], "edges": []}
    assert sorted(tuple(r) for r in held.collect()) == [("a/x", "1", 1), ("c d", "3", 3)]
    versions.write_tables({"files": _files(spark, [("c d", "4", 4)])}, root, _ids(spark, "c d"))
    versions.compact(spark, root)
    assert _seen(spark, root) == {"files": [("a/x", "1", 1), ("c d", "4", 4)], "edges": []}
    generations = [p.name for p in (tmp_path / "index").iterdir() if p.name not in ("pointers", "schemas", "generations")]
    assert len(generations) == 2 and "first" not in generations
    versions.delete_repositories(_ids(spark, "a/x", "c d"), root)
    versions.compact(spark, root)
    assert _seen(spark, root) == {"files": [], "edges": []}


def test_folders_do_not_grow_with_repositories(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = spark.range(2000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("repository_id"), F.lit("p").alias("path"), F.col("id").alias("line_count"))
    versions.write_tables({"files": rows}, root, rows)
    assert len(list((tmp_path / "index" / "first" / "files").glob("bucket=*"))) == versions.BUCKETS
    assert len(list((tmp_path / "index" / "pointers").glob("*.parquet"))) == 1
    assert versions.read_table(spark, root, "files").count() == 2000


def _event_rows(rng):
    """Answers in pieces; one has no end, one lacks an event, one ends with an error."""
    rows = []
    for q in range(12):
        n = rng.randrange(1, 8)
        rows.append((q, 0, "meta", None, None, f'{{"q":{q}}}'))
        rows += [(q, i, "delta", f"<{q}.{i}>", None, None) for i in range(1, n)]
        rows.append((q, n, "error", None, "failed", None) if q == 3 else (q, n, "verification", None, None, '{"ok":true}'))
    rows = [r for r in rows if not (r[0] == 5 and r[2] == "verification")]
    return rows + [(6, 20, "verification", None, None, "{}")]


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs batches of events through the closing stream, a file a batch, and returns the answers written.

    Timers make a stream run batches without data for ever; here each query ends with its data.
    """
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def run(batches, patience=3600):
        for batch in batches:
            spark.createDataFrame(batch, event_files.EVENT_SCHEMA).coalesce(1).write.mode("append").json(source)
            stream = closing.closing_answers(event_files.stream_events(spark, source, 1), patience)
            query = closing.write_stream(stream, out, state).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
        return [tuple(r) for r in closing.read_rows(spark, out).collect()]

    yield run
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_out_of_order_repeated_and_late_events_give_the_batch_fold(spark, streamed):
    rng = random.Random(8)
    rows = _event_rows(rng)
    mixed = rows + rng.sample(rows, 15)
    rng.shuffle(mixed)
    late = rng.sample([r for r in rows if r[0] < 3], 5)
    got = streamed([mixed[:20], mixed[20:45], mixed[45:], late])
    whole = [r for r in rows if r[0] not in (5, 6)]  # 5 has no end, 6 lacks what comes before its end
    expected = {tuple(r) + (True,) for r in fold_answers(spark.createDataFrame(whole, event_files.EVENT_SCHEMA)).collect()}
    assert len(got) == len(expected) and set(got) == expected


def test_an_answer_leaves_with_its_closing_event(spark, streamed):
    first = [(1, 0, "delta", "a", None, None), (2, 1, "verification", None, None, "{}")]
    assert streamed([first]) == []
    assert streamed([[(2, 0, "delta", "b", None, None)]]) == [(2, "b", None, "{}", None, True)]
    assert len(streamed([[(1, 1, "error", None, "x", None), (2, 0, "delta", "again", None, None)]])) == 2


def test_an_answer_without_an_end_leaves_by_its_timer(spark, streamed):
    streamed([[(1, 0, "delta", "a", None, None), (1, 2, "delta", "c", None, None)]], patience=0)
    got = streamed([[(9, 0, "delta", "z", None, None)]], patience=0)
    assert (1, "ac", None, None, None, False) in got


def test_a_batch_that_runs_again_writes_nothing_twice(spark, tmp_path):
    write = closing.once_per_batch(str(tmp_path / "out"))
    batch = spark.createDataFrame([(1, "a", None, None, None, True)], closing.ANSWER)
    for batch_id in (0, 0, 1, 0):
        write(batch, batch_id)
    assert closing.read_rows(spark, str(tmp_path / "out")).count() == 2
    assert closing.read_rows(spark, str(tmp_path / "none")).count() == 0


def test_each_text_is_embedded_once(spark, tmp_path):
    """A model that notes what it is given: every distinct text once, and none that is known."""
    notes = tmp_path / "seen"
    notes.mkdir()

    def load():
        import os
        import uuid

        def model(texts):
            with open(f"{notes}/{os.getpid()}-{uuid.uuid4().hex}", "w") as file:
                file.write("".join(f"{t}\n" for t in texts))
            return np.array([[len(t), 1.0] for t in texts])

        return model

    seen = lambda: sorted(line for p in notes.iterdir() for line in p.read_text().splitlines())
    rows = [(i, f"text {i % 7}" if i % 2 else "the same") for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "id long, t string").repartition(6)
    first = embed_once(df, "t", load, prefix="p:").collect()
    distinct = sorted({f"p:{t or ''}" for _, t in rows})
    assert seen() == distinct and len(first) == len(rows)
    plain = {r.id: [round(x, 6) for x in r.embedding] for r in vectors.embed(df, "t", load(), prefix="p:").collect()}
    assert {r.id: [round(x, 6) for x in r.embedding] for r in first} == plain
    for p in notes.iterdir():
        p.unlink()
    known = spark.createDataFrame(first).select("text_hash", "embedding")
    more = spark.createDataFrame([(1, "text 1"), (2, "new"), (3, "the same"), (4, "new")], "id long, t string")
    again = embed_once(more, "t", load, known, "p:").collect()
    assert seen() == ["p:new"] and {r.id for r in again} == {1, 2, 3, 4}


def _graph(spark, rng, nodes=150, edges=500):
    """Classes with members in their file, cycles, doubled calls, files that import each other and themselves."""
    rows = []
    for i in range(nodes):
        kind = rng.choice(["function", "method", "class", "interface"])
        rows.append((f"r{i % 2}", i, f"n{i % 40}", kind, f"f{i % 13}", f"n{rng.randrange(40)}" if kind == "method" else None))
    calls = [(s % 2, s, t) for s, t in ((rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)) if s % 2 == t % 2 and s != t]
    imports = [(f"r{rng.randrange(2)}", f"f{rng.randrange(15)}", f"f{rng.randrange(13)}") for _ in range(40)]
    entities = spark.createDataFrame(rows, "repository_id string, id long, symbol_name string, symbol_type string, file_path string, parent string")
    relationships = spark.createDataFrame([(f"r{r}", s, t, rng.choice(["calls", "handles"])) for r, s, t in calls],
                                          "repository_id string, source_entity_id long, target_entity_id long, relationship_type string")
    return entities, relationships, spark.createDataFrame(imports, "repository_id string, source_file string, target_file string").distinct()


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_over_words_are_the_summary(spark, seed):
    entities, relationships, file_imports = _graph(spark, random.Random(seed), edges=500 if seed == 1 else 120)
    wanted = impact.impact_summary(entities, entities, relationships, file_imports, frontier_cap=1 << 30)  # over rows, and cuts nothing
    got = reach.impact_counts(entities, entities, relationships, file_imports)
    assert got.columns == wanted.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize("seed", [3, 4])
def test_counts_with_vias_are_those_of_the_rows(spark, seed):
    entities, relationships, _ = _graph(spark, random.Random(seed), edges=500 if seed == 3 else 120)
    rows = impact.change_impact(entities, entities, relationships)
    ids = rows.select("repository_id", "target_id", F.explode(F.array("id", "via")).alias("id")).distinct()
    wanted = ids.groupBy("repository_id", "target_id").agg(F.count("*").alias("ids"))
    assert sorted(map(tuple, reach.impact_and_via_counts(entities, entities, relationships).collect())) == sorted(map(tuple, wanted.collect()))
    by_depth = rows.groupBy("repository_id", severity(F.col("depth")).alias("severity")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, reach.severity_counts(entities, entities, relationships).collect())) == sorted(map(tuple, by_depth.collect()))


def test_a_hubs_callers_are_combined_before_the_shuffle(spark):
    """100,000 callers of one entity in files of 50: counted exactly, over 2,000 words and not over 100,000 pairs."""
    n = 100_000
    entities = spark.range(n + 2).select(F.lit("r").alias("repository_id"), "id", F.concat(F.lit("f"), F.floor(F.col("id") / 50).cast("string")).alias("file_path"),
                                         F.lit("n").alias("symbol_name"), F.lit("function").alias("symbol_type"), F.lit(None).cast("string").alias("parent"))
    calls = lambda source, target: spark.range(1, n + 1).select(F.lit("r").alias("repository_id"), source.alias("source_entity_id"), target.alias("target_entity_id"), F.lit("calls").alias("relationship_type"))
    edges = calls(F.col("id"), F.lit(0).cast("long")).union(calls(F.lit(n + 1).cast("long"), F.col("id")))
    none = spark.createDataFrame([], "repository_id string, source_file string, target_file string")
    row = reach.impact_counts(entities.where("id = 0"), entities, edges, none).first()
    assert (row.high, row.medium, row.low, row.files, row.importing_files) == (n, 1, 0, 2001, 0)
    _, nodes = reach.numbered(entities, none)
    found = edges.join(nodes.toDF("repository_id", "source_entity_id", "u"), ["repository_id", "source_entity_id"]).join(nodes.toDF("repository_id", "target_entity_id", "v"), ["repository_id", "target_entity_id"])
    words = reach.reached_words(found.select("u", "v"), 1)[0]
    assert words.groupBy("v").count().agg(F.max("count")).first()[0] <= 2 * (n // 50 + 1)


def test_gaps_between_ranges(spark):
    rng = random.Random(9)
    cases = [(i, n, sorted({(a, a + rng.randrange(6)) for a in (rng.randrange(1, 25) for _ in range(rng.randrange(6)))})) for i, n in enumerate([1, 5, 20, 30] * 30)]
    df = spark.createDataFrame([(i, n, [{"start": a, "end": b} for a, b in r] or None) for i, n, r in cases], "i long, n int, ranges array<struct<start:int,end:int>>")
    got = {r.i: [k for g in r.g for k in range(g.start, g.end + 1)] for r in df.select("i", chunks.gaps(F.col("ranges"), F.col("n")).alias("g")).collect()}
    assert got == {i: [k for k in range(1, n + 1) if not any(a <= k <= b for a, b in r)] for i, n, r in cases}


def test_uncovered_lines_do_not_move(spark):
    """No line is a row before or in a shuffle: what is exchanged is files and their ranges."""
    files = spark.createDataFrame([("r", "a.py", "Python", "x = 1\n\ndef f():\n    pass\ny = 2")], "repository_id string, path string, language string, content string")
    entities = spark.createDataFrame([("r", "a.py", "function", 3, 4), ("r", "a.py", "route", 1, 5)], "repository_id string, file_path string, symbol_type string, start_line long, end_line long")
    found = chunks.uncovered_lines(files, entities)
    assert [(r.n, r.line) for r in found.orderBy("n").collect()] == [(1, "x = 1"), (5, "y = 2")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline(left") < plan.index("Join") and "explode" not in plan and plan.count("Aggregate") == 1


def test_one_large_repository_is_listed_and_opened_by_many_tasks(spark, tmp_path):
    """Folders are rows: a repository with nearly all files is dealt out by its folders; odd names and depths are found."""
    names = [f"pkg{i}/mod{j}/_f{k}.py" for i in range(12) for j in range(5) for k in range(4)] + ["top.py", ".env", "pkg0/__init__.py", "a/b/c/d/e/f/.deep", "pkg0/mod0/x y/ü.md"]
    for name in names:
        (tmp_path / "big" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "big" / name).write_text(name)
    (tmp_path / "big" / "empty folder").mkdir()
    (tmp_path / "small").mkdir()
    (tmp_path / "small" / "only.txt").write_text("é")
    listing = file_source.list_corpus(spark, str(tmp_path))
    assert sorted((r.repository_id, r.path, r.size) for r in listing.collect()) == sorted([("big", n, len(n.encode())) for n in names] + [("small", "only.txt", 2)])
    for spread in (0, 1, 9):
        assert file_source.list_corpus(spark, str(tmp_path), spread=spread).count() == len(names) + 1
    deep = file_source.folders_below(spark, str(tmp_path), 1, 2)[1].withColumn("task", F.spark_partition_id())
    assert deep.select("task").distinct().count() > 1 and deep.where("repository_id = 'big'").count() >= 60
    texts = file_source.scan_corpus(spark, str(tmp_path), where="size < 12 and repository_id = 'big'")
    assert {r.path for r in texts.collect()} == {"top.py", ".env"}
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(size,12)" in plan and "EqualTo(repository_id,big)" in plan  # in the scan of the stored listing
    listed = file_source.scan_corpus(spark, str(tmp_path), content=False)
    assert listed.columns == ["repository_id", "path", "size"] and "MapInArrow" not in listed._jdf.queryExecution().executedPlan().toString()


def test_failures_are_no_rows(spark, tmp_path):
    """A folder that is not there yet reads as empty; a folder that can't be read raises."""
    assert versions.pointers(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad" / "pointers").mkdir(parents=True)
    (tmp_path / "bad" / "pointers" / "x.parquet").write_text("not a table")
    with pytest.raises(Exception, match="x.parquet"):
        versions.pointers(spark, str(tmp_path / "bad")).collect()
