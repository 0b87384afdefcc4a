"""Exact and near duplicates, repeated strings: against brute force, and on awkward rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from codestrata.llm import exact_dedup, simhash, suffixes


def test_exact_groups(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice(["a", "b", "", None, f"text {i}", f"text {i % 50}"])) for i in range(2000)]
    got = sorted(tuple(r) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect())
    groups: dict[str, list[int]] = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert got == want


def test_exact_groups_with_a_full_filter(spark):
    """A filter that is far too small sends every row the long way; the result is the same."""
    docs = spark.createDataFrame([(i, f"text {i % 3000}") for i in range(4000)], "doc_id long, text string")
    small = exact_dedup.exact_groups(docs, most_bits=64)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, exact_dedup.exact_groups(docs).collect()))


def test_exact_awkward(awkward, empty):
    rows = exact_dedup.exact_groups(awkward).collect()
    assert len(rows) == awkward.count()
    same = [r for r in rows if r.doc_id in (1, 2)]
    assert {r.keep_id for r in same} == {2} and {r.group_size for r in same} == {3} and sum(r.kept for r in same) == 1
    assert {r.keep_id for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()} == {4}
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.distinct_documents(awkward)
    assert kept.schema == awkward.schema
    texts = Counter(r.text or "" for r in kept.collect())
    assert set(texts.values()) == {1} and len(texts) == len({r.text or "" for r in awkward.collect()})
    assert exact_dedup.distinct_documents(empty).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, bits=3):
    roots = {i: i for i in fps}

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                roots[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_by_hand():
    for text in ["", None, "one", "one Two", "A b\x0bC d\te", "x " * 50, "É é É", "a\xa0b c\x1cd e f"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hashes_alike(spark):
    """The hash is the one Spark's SQL has for strings."""
    text = "a few words"
    assert spark.sql(f"select xxhash64('{text}')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_anchors_cover():
    """Halves one bit apart reach each other's home."""
    draw = np.random.default_rng(3)
    halves = draw.integers(1 << 32, size=500, dtype=np.uint32)
    for bit in [*range(32), None]:
        near = halves ^ np.uint32(1 << bit) if bit is not None else halves
        index, anchor = simhash.anchors(near)
        reached = set(zip(index.tolist(), anchor.tolist(), strict=True))
        assert all((i, h) in reached for i, h in enumerate(simhash.home(halves).tolist()))
    assert len(simhash.anchors(halves)[0]) <= 18 * len(halves)


def test_links_find_all_components(spark):
    draw = random.Random(5)
    fps = [draw.getrandbits(64) for _ in range(60)]
    for f in list(fps):  # chains of near fingerprints
        for _ in range(draw.randrange(6)):
            for bit in draw.sample(range(64), draw.randrange(1, 5)):
                f ^= 1 << bit
            fps.append(f)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    df = spark.createDataFrame([(f, f.to_bytes(8, "little", signed=True), f) for f in fps], "node long, check binary, sign long")
    found = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = plain_components({f: f % (1 << 64) for f in fps})
    smallest = {f: want[f] for f in fps}
    assert {f: found.get(f, f) for f in fps} == smallest


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 301)} | {i: 1000 for i in range(1001, 1400)}


def test_near_components(spark, awkward, empty):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        base = [draw.choice(words) for _ in range(150)]
        rows.append((3 * i, " ".join(base)))
        base[draw.randrange(150)] = "other"
        rows.append((3 * i + 1, " ".join(base)))
        rows.append((3 * i + 2, rows[-2][1].upper()))
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: g[0] for i, g in got.items()} == fps
    assert {i: g[1] for i, g in got.items()} == plain_components(fps)
    assert simhash.near_components(awkward).count() == awkward.count()
    assert simhash.near_components(empty).count() == 0


def test_one_of_each(spark, awkward, empty):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(60):
        base = [draw.choice(words) for _ in range(300)]
        rows.append((2 * i, " ".join(base)))
        for at in draw.sample(range(300), 4):
            base[at] = "new"
        rows.append((2 * i + 1, " ".join(base)))
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * i for i in range(60)}
    stay = simhash.one_of_each(awkward)
    assert stay.schema == awkward.schema
    ids = Counter(r.doc_id for r in stay.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[None] == 2 and ids[6] == 1 and ids[7] == 0 and ids[3] == ids[4] == 1
    assert simhash.one_of_each(empty).count() == 0


def plain_repeats(rows, length):
    seen, out = {}, []
    windows = sorted((d, i) for d, t in rows for i in range(len(t) - length + 1))
    texts = dict(rows)
    for d, i in windows:
        seen.setdefault(texts[d][i:i + length], (d, i))
    for d, t in sorted(rows):
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] < (d, i):
                mark[i:i + length] = b"\1" * length
        spans = [i for i in range(len(t)) if mark[i] and (i == 0 or not mark[i - 1])]
        out.append((d, len(t), sum(mark), len(spans), bytes(c for c, m in zip(t, mark, strict=True) if not m)))
    return out


@pytest.mark.parametrize("hot", [suffixes.HOT, 3])
def test_repeated_strings(spark, hot, monkeypatch):
    draw = random.Random(4)
    passages = ["".join(draw.choices("abcdé ", k=n)) for n in (99, 100, 101, 150, 400, 400)] + ["ab" * 200, "x" * 350]
    rows = []
    for i in range(150):
        parts = [draw.choice(passages) if draw.random() < 0.6 else "".join(draw.choices("efgh ", k=draw.randrange(120))) for _ in range(draw.randrange(6))]
        rows.append((draw.randrange(10_000) * 200 + i, "".join(parts)))
    monkeypatch.setattr(suffixes, "GROUP", 1 << 10)  # texts are cut into parts
    runs = suffixes.repeated_runs.__defaults__
    monkeypatch.setattr(suffixes.repeated_runs, "__defaults__", (*runs[:3], hot))
    got = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    mine = sorted((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got)
    assert mine == plain_repeats([(d, t.encode()) for d, t in rows], 100)


def test_repeated_strings_awkward(awkward, empty):
    rows = suffixes.without_repeats(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].n_bytes == by_id[4].n_bytes == 0 and bytes(by_id[3].kept) == b""
    assert bytes(by_id[7].kept) == b"x" and len(by_id[7].spans) == 1  # the words go round, so the blank before it has stood there too
    assert by_id[1].spans == [] and by_id[2].spans == []  # shorter than a string
    assert suffixes.without_repeats(empty).count() == 0


def plain_shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies_against_brute_force(spark):
    """Inserted and removed passages, scattered edits and borderline pairs: exactly the links of five-word similarity 0.8 count."""
    draw, rows = random.Random(12), []
    for i in range(150):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(20, 240))]
        at = draw.randrange(len(base))
        passage = [f"p{draw.randrange(5000)}" for _ in range(int(len(base) * draw.choice([0.1, 0.2, 0.24, 0.26, 0.35])))]
        rows.append((4 * i, " ".join(base)))
        rows.append((4 * i + 1, " ".join(base + passage)))
        rows.append((4 * i + 2, " ".join(base[:at] + passage + base[at:])))
        edited = [w if draw.random() > 0.025 else "new" for w in base]
        rows.append((4 * i + 3, " ".join(edited)))
    sets = {i: plain_shingles(t) for i, t in rows}
    roots = {i: i for i in sets}

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for a in sets:
        for b in range(a + 1, a - a % 4 + 4):  # bases share no shingles
            shared = len(sets[a] & sets[b])
            if shared / (len(sets[a]) + len(sets[b]) - shared) >= 0.8:
                x, y = find(a), find(b)
                roots[max(x, y)] = min(x, y)
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert kept == {i for i in sets if find(i) == i}
    assert 200 < len(kept) < 550


def test_refuted_links_hide_no_other(spark):
    """All pairs of a large group meet, at 0.7 to 0.9, in one cell or many: the same components as by brute force."""
    draw, rows = random.Random(13), []
    base = [f"w{i}" for i in range(200)]
    for i in range(80):
        rows.append((i, " ".join(base[:120] + [f"v{i}x{j}" if draw.random() < 0.025 else w for j, w in enumerate(base[120:])])))
    sets = {i: plain_shingles(t) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    roots = {i: i for i in sets}
    for _ in sets:
        for a, b in edges:
            roots[a] = roots[b] = min(roots[a], roots[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    nodes = simhash.signatures(docs).selectExpr("doc_id as low", "sketch", "bands")
    for cell, weight in ((1000, 1 << 22), (7, 1 << 22), (1000, 3000)):
        linked = {r.node: r.root for r in simhash.components(simhash.similar_links(nodes, docs, block=30, cell=cell, weight=weight)).collect()}
        assert {i: linked.get(i, i) for i in sets} == roots
    assert 1 < len(set(roots.values())) < 80


@pytest.mark.parametrize("family", [400, 2000])
def test_a_family_below_the_similarity_stays_linear(spark, family):
    """Members share 0.6 to 0.79 of their shingles with each other: no link, and few rows leave the tasks on the way."""
    draw, base = random.Random(15), [f"w{i}" for i in range(240)]
    rows = [(i, " ".join([*base[:draw.randrange(190, 215)], *(f"v{i}x{j}" for j in range(28))])) for i in range(family)]
    rows += [(family + i, rows[i][1] + " end") for i in range(5)]  # five true copies
    sets = [plain_shingles(t) for _, t in rows[:60]]
    similar = [len(a & b) / len(a | b) for a in sets for b in sets if a is not b]
    assert 0.6 < min(similar) and max(similar) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    nodes = simhash.signatures(docs).selectExpr("doc_id as low", "sketch", "bands")
    found = simhash.similar_links(nodes, docs, cell=300).collect()
    every = {i: plain_shingles(t) for i, t in rows}
    roots = plain_similar(every)
    linked = {r.node: r.root for r in simhash.components(spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")).collect()}
    assert {i: linked.get(i, i) for i in every} == roots and len(set(roots.values())) == family
    assert len(found) <= 2 * 5


def test_fingerprints_propose_links(spark):
    """Copies that share no anchor meet by their fingerprints; what fingerprints propose is compared like the rest."""
    draw = random.Random(5)
    base = [f"word{draw.randrange(4000)}" for _ in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(f"other{draw.randrange(4000)}" for _ in range(400)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = simhash.signatures(docs).selectExpr("doc_id as low", "sketch", "array(doc_id) as bands", "fp")
    assert [(r.a, r.b) for r in simhash.similar_links(nodes, docs).collect()] in ([(1, 2)], [(2, 1)])
    same = nodes.selectExpr("low", "sketch", "bands", "7L as fp")
    assert simhash.components(simhash.similar_links(same, docs)).where("node = 3 or root = 3").isEmpty()


def plain_similar(sets):
    """Roots of the sets by brute force, over counts of common shingles."""
    places = {s: i for i, s in enumerate(set().union(*sets.values()))}
    ids = sorted(sets)
    dense = np.zeros((len(ids), len(places)), np.float32)
    for row, i in enumerate(ids):
        dense[row, [places[s] for s in sets[i]]] = 1
    shared, size = dense @ dense.T, dense.sum(axis=1)
    alike = shared >= 0.8 * (size[:, None] + size[None, :] - shared).astype(float)
    roots = {i: i for i in ids}

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(alike, 1)), strict=True):
        x, y = find(ids[a]), find(ids[b])
        roots[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [8, 50])
def test_hot_anchors_are_dealt_in_blocks(spark, block):
    """A family around one fingerprint: no task's anchor holds more than its blocks, and no link is lost."""
    draw = random.Random(14)
    fps = {f for _ in range(150) for f in [sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 5)))]} | {draw.getrandbits(62) for _ in range(100)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f, f.to_bytes(8, "little", signed=True), f) for f in fps], "node long, check binary, sign long")
    placed = df.mapInArrow(simhash._replicas, "anchor long, node long, check binary, home boolean")
    most = lambda placed: max(r["count"] for r in placed.groupBy("anchor").count().collect())
    assert most(placed) > 100 and most(simhash.dealt(placed, placed, block)) <= max(4 * block, 40)
    found = {r.node: r.root for r in simhash.components(simhash.links(df, block=block)).collect()}
    want = plain_components({f: f % (1 << 64) for f in fps})
    assert {f: found.get(f, f) for f in fps} == want
