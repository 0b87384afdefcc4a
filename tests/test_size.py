"""What must hold for larger tables, seen on plans and small inputs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.functions import vectors
from codestrata.operators import chunks, evidence, extract, graph, impact, ranking, reach, search, verify
from codestrata.plans import search as plan
from codestrata.queries import load_all
from codestrata.queries.views import Views

SMALL = "/root/testdata/sf0.001"
THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def planned_broadcasts(spark):
    """Broadcasts by planned size, as sessions have them by default."""
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "10485760")
    yield
    spark.conf.set(THRESHOLD, before)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_files_are_not_broadcast(spark, planned_broadcasts):
    files = Views(spark, SMALL).wide_files
    found = extract.extract_entities(files)
    assert "Broadcast" not in _plan(found)
    assert "Broadcast" not in _plan(chunks.module_entities(files, found))


def test_an_index_broadcasts_by_measured_sizes_only(spark, planned_broadcasts):
    found = load_all()["indexed_imports_c1"].run(spark, SMALL)
    assert "Broadcast" not in _plan(found)
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "10485760"


def test_vectors_are_cut_into_few_blocks(spark):
    """A row goes to every block of the other side, so the number of blocks must not grow with the rows."""
    rows = spark.range(40_000).select(F.lit("r").alias("repository_id"), F.col("id").alias("question_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    assert search.questions_in_blocks(rows).agg(F.max("qbs")).first()[0] <= search.QUESTION_BLOCKS
    wide = rows.limit(2000).withColumn("embedding", F.array_repeat(F.lit(1.0), 200_000))  # 1.6 GB: more than few blocks hold
    assert search.questions_in_blocks(wide).agg(F.max("qbs")).first()[0] * search.BLOCK_BYTES >= 2000 * 200_000 * 4 * 0.9


def test_no_search_shuffles_a_repository_into_one_task(spark):
    """Sizes of repositories reach the rows without a shuffle by repository, which would put all rows of one into one task."""
    rows = spark.range(300).select(F.lit("r").alias("repository_id"), F.col("id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    words = rows.select("repository_id", "id", F.concat(F.lit("w"), F.col("id") % 7).alias("term"), F.lit(1.0).alias("weight"))
    asked = spark.createDataFrame([("r", i, [f"w{i}", "none"]) for i in range(9)], "repository_id string, question_id long, terms array<string>")
    found = search.term_top_k(asked, words, 3, stem=None)
    for df in (found, search.vector_top_k(rows.limit(9).withColumnRenamed("id", "question_id"), rows, 3)):
        assert not re.search(r"hashpartitioning\(repository_id#\d+, \d+\)", _plan(df))
    assert {(r.question_id, r.id) for r in found.collect()} == {(q, q + 7 * n) for q in range(7) for n in range(3)}


def test_tiles_move_the_smaller_table(spark):
    """Few questions go to many blocks, and the entities, thirty times as many, to few; equal tables are cut alike."""
    def numbers(questions, entities):
        rows = lambda n, c: spark.range(n).select(F.lit("r").alias("repository_id"), F.col("id").alias(c))
        return search.tile_numbers(rows(questions, "question_id"), rows(entities, "id"), F.lit(400)).first()
    few, alike = numbers(10_000, 300_000), numbers(200_000, 200_000)
    assert few.qbs <= 2 and few.qbs * few.ebs >= search.TILES
    assert alike.qbs == alike.ebs and 200_000 * 400 / alike.ebs <= search.BLOCK_BYTES
    assert numbers(5, 50).qbs == numbers(5, 50).ebs == 1


def test_equal_questions_are_searched_once(spark):
    asked = spark.createDataFrame([("r", i, f"what calls f{i % 3}?", None if i % 2 else "f") for i in range(60)] + [("s", 60, "what calls f0?", None)],
                                  "repository_id string, question_id long, text string, focus_name string")
    once, members = plan.asked_once(asked)
    assert sorted(r.question_id for r in once.collect()) == [0, 1, 2, 3, 4, 5, 60]
    hits = once.select("repository_id", "question_id", F.upper("text").alias("hit"), "focus_name")
    got = {(r.question_id, r.repository_id, r.hit, r.focus_name) for r in plan.given_to_all(hits, members).collect()}
    assert got == {(r.question_id, r.repository_id, r.text.upper(), r.focus_name) for r in asked.collect()}


def test_best_rows_over_many_parts():
    rng = np.random.default_rng(4)
    similar, ids = np.round(rng.random((7, 300)), 1), rng.permutation(300)  # many ties
    best = search.BestRows(7, 9)
    for at in range(0, 300, 23):
        of = np.arange(7) if at % 2 else np.array([5, 0, 1, 2, 3, 4, 6])
        best.add(of, similar[of, at:at + 23], ids[at:at + 23])
    for q in range(7):
        order = np.lexsort((ids, -similar[q]))[:9]
        assert best.ids[q].tolist() == ids[order].tolist() and best.scores[q].tolist() == similar[q][order].tolist()


def test_owners_of_one_name_share_their_members(spark):
    """40 owners and 30 members of one name in a file are 70 rows, not 1,200, and the counts are those of the single rows."""
    def entity(i):
        kind, name, parent = ("class", "Shop", None) if i < 40 else ("method", f"m{i}", "Shop") if i < 70 else ("function", f"f{i}", None)
        return ("r", i, name, kind, "a.ts" if i < 70 else f"f{i % 7}.ts", parent)
    entities = spark.createDataFrame([entity(i) for i in range(150)], "repository_id string, id long, symbol_name string, symbol_type string, file_path string, parent string")
    edges = spark.createDataFrame([("r", s, t, "calls") for s in range(150) for t in ((s * 7 + 3) % 150, (s * 11 + 41) % 150) if s != t],
                                  "repository_id string, source_entity_id long, target_entity_id long, relationship_type string")
    imports = spark.createDataFrame([("r", "f1.ts", "a.ts"), ("r", "x.ts", "a.ts"), ("r", "a.ts", "f2.ts")], "repository_id string, source_file string, target_file string")
    brought, members = reach.member_groups(entities.withColumn("t", F.col("id")), entities.withColumn("s", F.col("id")))
    assert (brought.count(), members.count()) == (40, 30)
    rows = lambda df: sorted(tuple(r[c] for c in ("target_id", "high", "medium", "low", "importing_files", "files")) for r in df.collect())
    assert rows(reach.impact_counts(entities, entities, edges, imports)) == rows(impact.impact_summary(entities, entities, edges, imports, frontier_cap=10_000))


def test_capped_rounds_are_walked_once(spark):
    """Rounds with a cap start from stored rows: one walk is left in the plan, and its rows are those of a plain search."""
    kinds = ("calls", "handles")
    edges = sorted({(s, t, kinds[(s + t) % 2]) for s in range(60) for t in ((s * 7 + 3) % 60, (s * 11 + 41) % 20, s % 5) if s != t})
    entities = spark.createDataFrame([("r", i, f"f{i}", "class" if i == 9 else "method", "a.ts", "f9" if i in (7, 30) else None) for i in range(60)],
                                     "repository_id string, id long, symbol_name string, symbol_type string, file_path string, parent string")
    rows = spark.createDataFrame([("r", *e) for e in edges], "repository_id string, source_entity_id long, target_entity_id long, relationship_type string")
    found = impact.change_impact(entities, entities, rows, frontier_cap=2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    expected = set()
    for target in range(60):
        seen = frontier = {target, 7, 30} if target == 9 else {target}
        for depth in (1, 2, 3):
            new = {}
            for s, t, kind in edges:
                if t in frontier and s not in seen:
                    new[s] = min(new.get(s, (t, kind)), (t, kind))
            expected |= {(target, i, depth, *via) for i, via in new.items()}
            seen, frontier = seen | set(new), set(sorted(new, key=lambda i: (new[i][0], i))[:2])
    got = [tuple(r[c] for c in ("target_id", "id", "depth", "via", "relationship")) for r in found.collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_texts_are_written_after_packing(spark):
    """What fits is found by lengths, so no text goes through the shuffle by question; the rows are those of packing texts."""
    picks = spark.createDataFrame([("r", q, i, 1, i, "named", 3 + i % 5, n + 1) for q in range(4) for n, i in enumerate(range(q, q + 12))],
                                  "repository_id string, question_id long, id long, tier int, pos int, reason string, max_lines int, n int")
    entities = spark.createDataFrame([("r", i, "function", None, f"f{i}", None, "a.py", i, i + 9, "m", "\n".join(["x" * i] * 9)) for i in range(20)],
                                     "repository_id string, id long, symbol_type string, parent string, symbol_name string, route string, file_path string, "
                                     "start_line long, end_line long, module string, content string")
    used = spark.createDataFrame([("r", 2, 700)], "repository_id string, question_id long, used int")
    packed = evidence.packed_blocks(picks, entities, 900, used)
    tree = packed._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("AS block") < tree.index("Window")
    rows = lambda df: sorted((r.question_id, r.n, r.id, r.block) for r in df.collect())
    assert rows(packed) == rows(evidence.pack(evidence.evidence_blocks(picks, entities), 900, used))


def test_embedding_bounds_its_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(64 << 20))
    vectors.embed(spark.createDataFrame([("a",)], "t string"), "t")
    assert int(spark.conf.get(name)) == vectors.BATCH_BYTES
    spark.conf.set(name, before)


def test_tails_of_sources_are_spread_and_not_broadcast(spark, planned_broadcasts, monkeypatch):
    monkeypatch.setattr(ranking, "SPREAD_ROWS", 10, raising=False)
    asked = spark.range(100).select(F.col("id").alias("question_id"), F.concat(F.lit("b/f"), F.col("id"), F.lit(".py:7")).alias("text"))
    sources = spark.range(100).select(F.col("id").alias("question_id"), F.lit(1).alias("n"), F.concat(F.lit("a/b/f"), F.col("id"), F.lit(".py")).alias("file"),
                                      F.lit(3).alias("start_line"), F.lit(9).alias("end_line"))
    found = verify.match_references(asked, sources)
    assert "Broadcast" not in _plan(found)
    assert re.search(r"hashpartitioning\(question_id#\d+L?, 10\)", _plan(found))
    assert {(r.question_id, r.file, r.start_line, r.end_line) for r in found.collect()} == {(i, f"a/b/f{i}.py", 7, 7) for i in range(100)}


def test_edges_meet_their_entities_in_partitions_of_bounded_rows(spark, planned_broadcasts, monkeypatch):
    monkeypatch.setattr(ranking, "SPREAD_ROWS", 100, raising=False)
    found = load_all()["neighbours_j1"].run(spark, SMALL)
    edges = Views(spark, SMALL).relationships.count()
    assert "Broadcast" not in _plan(found)
    assert re.search(rf"hashpartitioning\(repository_id#\d+, id#\d+L?, {-(-2 * edges // 100)}\)", _plan(found))


def test_imports_of_a_file_with_many_entities_are_many_tasks(spark, monkeypatch):
    """A row for each entity and import of a file: a few bytes that become very many rows."""
    monkeypatch.setattr(ranking, "FAN_ROWS", 500, raising=False)
    one = lambda name: F.concat(F.lit(name), F.col("id") % 1)  # noqa: E731  a constant would be moved out of the join
    entities = spark.range(300).select("id", one("r").alias("repository_id"), one("a").alias("file_path"), F.lit("n").alias("symbol_name"),
                                       F.array().cast("array<string>").alias("imports"))
    imports = spark.range(50).select(one("r").alias("repository_id"), one("a").alias("source_file"), F.concat(F.lit("b"), "id").alias("target_file"))
    none = spark.createDataFrame([], "repository_id string, source_entity_id long, target_entity_id long, relationship_type string")
    cards = graph.dependency_cards(entities, entities, none, imports)
    sizes = [r["count"] for r in cards.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == cards.distinct().count() == 300 * 50
    assert max(sizes) < 5000


def _owners(spark, copies=40):
    """Copies of a class and of its member in one file; a caller of each member, and callers of these."""
    kinds = [(i, f"m{i}" if i >= 2 * copies else ("c" if i < copies else "m"), "class" if i < copies else "method", "c" if copies <= i < 2 * copies else None) for i in range(4 * copies)]
    entities = spark.createDataFrame([(i, "r", "a.py", name, kind, parent) for i, name, kind, parent in kinds],
                                     "id long, repository_id string, file_path string, symbol_name string, symbol_type string, parent string")
    calls = [(2 * copies + i, copies + i, "calls") for i in range(copies)] + [(3 * copies + i, 2 * copies + i, "handles") for i in range(copies)]
    calls += [(3 * copies + i, i, "calls") for i in range(copies)] + [(i, (i + 1) % copies, "calls") for i in range(copies)]
    calls += [(2 * copies, copies, "handles"), (1, copies + 2, "calls"), (copies + 3, 3, "calls")]
    edges = spark.createDataFrame([("r", *c) for c in calls], "repository_id string, source_entity_id long, target_entity_id long, relationship_type string")
    return entities, edges, kinds, calls


def _brute_impact(kinds, calls):
    found = {}
    for target, name, kind, _ in kinds:
        seen = frontier = {target} | ({i for i, _, _, parent in kinds if parent == name} if kind == "class" else set())
        for depth in (1, 2, 3):
            hits = [(s, (depth, t, how)) for s, t, how in calls if t in frontier and s not in seen]
            for s, hit in hits:
                found[target, s] = min(hit, found.get((target, s), hit))
            frontier = {s for s, _ in hits}
            seen = seen | frontier
    return found


def _stored(monkeypatch):
    rows, store = [], impact.cut

    def counted(df):
        out = store(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(impact, "cut", counted)
    return rows


def test_members_are_walked_once_for_all_owners_of_one_name(spark, monkeypatch):
    entities, edges, kinds, calls = _owners(spark)
    rows = _stored(monkeypatch)
    found = impact.change_impact(entities, entities, edges).collect()
    assert {(r.target_id, r.id): (r.depth, r.via, r.relationship) for r in found} == _brute_impact(kinds, calls)
    assert len(found) == len(_brute_impact(kinds, calls)) > 40 * 80
    assert max(rows) < 40 * 20  # no row for a pair of an owner and a member


@pytest.mark.parametrize("k", [1, 3, 30, 200])
def test_first_impacts_are_those_of_all_impacts(spark, k):
    entities, edges, kinds, calls = _owners(spark)
    found = impact.first_impacts(entities, entities, edges, k).collect()
    best = {}
    for (target, i), (depth, via, how) in _brute_impact(kinds, calls).items():
        best.setdefault(target, []).append((depth, i, via, how))
    expected = {(t, n, *hit) for t, hits in best.items() for n, hit in enumerate(sorted(hits)[:k], 1)}
    assert {(r.target_id, r.rank, r.depth, r.id, r.via, r.relationship) for r in found} == expected


def test_targets_with_enough_impacts_go_no_further(spark, monkeypatch):
    edges = spark.createDataFrame([("r", 10 + i, 0, "calls") for i in range(50)] + [("r", 100 + i, 10 + i, "calls") for i in range(50)],
                                  "repository_id string, source_entity_id long, target_entity_id long, relationship_type string")
    entities = spark.createDataFrame([(0, "r", "a.py", "n", "function", None)], "id long, repository_id string, file_path string, symbol_name string, symbol_type string, parent string")
    rows = _stored(monkeypatch)
    assert impact.first_impacts(entities, entities, edges, 30).count() == 30
    assert sorted(rows)[-2:] == [50, 100]  # the first round and the edges


def test_neighbours_of_hits_are_lists_and_not_broadcast(spark, planned_broadcasts, monkeypatch):
    """Neighbours of a question's best hits, against the rows counted by hand; an entity with many of them has several lists."""
    monkeypatch.setattr(evidence, "NEAR_ROW", 3)
    kinds = {i: "doc" if i == 9 else "function" for i in range(40)}
    edges = [(1, i) for i in range(2, 20)] + [(i, 2) for i in range(20, 30)] + [(2, 1), (3, 1), (25, 1), (1, 25)]
    hits = [(q, i, r, "flow" if q == 2 else "general") for q in (1, 2, 3) for r, i in enumerate((1, 2, 30) if q < 3 else (2,), 1)]
    left_out = {1: {1, 2, 30}, 2: {4}, 3: set()}
    entities = spark.createDataFrame([("r", i, k) for i, k in kinds.items()], "repository_id string, id long, symbol_type string")
    relationships = spark.createDataFrame([("r", a, b, "calls") for a, b in edges], "repository_id string, source_entity_id long, target_entity_id long, relationship_type string")
    retrieved = spark.createDataFrame([("r", *h) for h in hits], "repository_id string, question_id long, id long, rank int, query_type string")
    picked = spark.createDataFrame([("r", q, i) for q, ids in left_out.items() for i in ids], "repository_id string, question_id long, id long")
    found = evidence.related_entities(retrieved, picked, entities, relationships)
    assert "Broadcast" not in _plan(found)
    want = set()
    for q in left_out:
        ranks = {i: r for a, i, r, _ in hits if a == q}
        near = [(b, ranks[a], 0, a) for a, b in edges if a in ranks] + [(a, ranks[b], 1, b) for a, b in edges if b in ranks and a not in ranks]
        near = [x for x in near if x[0] not in left_out[q] and kinds[x[0]] != "doc"]
        counted = sorted({i: [x[1:] for x in near if x[0] == i] for i, *_ in near}.items(), key=lambda c: (-len(c[1]), c[0]))
        want |= {(q, i, len(f), "in" if min(f)[1] else "out", min(f)[2], n) for n, (i, f) in enumerate(counted[:8 if q == 2 else 5], 1)}
    assert {tuple(r) for r in found.select("question_id", "id", "n", "direction", "anchor", "rank").collect()} == want
    lists = evidence._near_lists(entities, relationships)
    assert lists.agg(F.max(F.size("near"))).first()[0] == 3


@pytest.mark.parametrize("gathered", [1 << 20, 5])
def test_what_reaches_an_entity_is_one_row(spark, monkeypatch, gathered):
    """Lists of one, two and three steps against walks by hand, gathered whole or, for hubs, made distinct as rows first."""
    monkeypatch.setattr(reach, "GATHERED", gathered)
    calls = {(s, t) for s in range(60) for t in ((s * 7 + 3) % 60, (s * 5 + 1) % 60, 0) if s != t}
    edges = spark.createDataFrame(sorted(calls | {(n, n) for n in range(60)}), "u long, v long")
    found = {r["v"]: r for r in reach.reached_lists(edges).collect()}
    assert len(found) == 60
    callers = lambda ids: set(ids) | {s for s, t in calls if t in ids}
    for v, row in found.items():
        ids = {v}
        for name in reach.STEPS:
            ids = callers(ids)
            assert sorted(row[name]) == sorted(ids)
