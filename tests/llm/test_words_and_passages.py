"""Words as hashes, benchmark passages by winnowing and ranked search by max-sketches, against plain code."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from codestrata.llm import max_sketch, winnowing
from codestrata.llm.common import stored
from codestrata.llm.words import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_contamination(docs, items):
    passages = {}
    for item, text in items:
        found = plain_words(text)
        n = min(10, len(found))
        for s in range(len(found) - n + 1 if n and item is not None else 0):
            passages.setdefault((n, *found[s:s + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        found, hit, named = plain_words(text), set(), set()
        for n in {p[0] for p in passages}:
            for s in range(len(found) - n + 1):
                if (n, *found[s:s + n]) in passages:
                    hit |= set(range(s, s + n))
                    named |= passages[(n, *found[s:s + n])]
        out.append((doc, len(found), len(hit), sorted(named)))
    return sorted(out, key=repr)


def contamination(spark, docs, items, **more):
    rows = winnowing.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), **more).collect()
    for r in rows:
        assert r.n_hit == sum(s.stop - s.start for s in r.spans) and all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in rows), key=repr)


def test_words_are_those_of_the_pattern():
    texts = ["", None, "A b", "c", "É é 日本 x9_y-Z", "a" * 5000 + " b", "\x00\x7f[`{@", "end", "word " * 400_000]
    found = words(pa.array(["cut off", *texts], pa.string()).slice(1))
    plain = [plain_words(t) for t in texts]
    assert np.diff(found.bounds).tolist() == list(map(len, plain))
    assert found.joined(0, 12) == " ".join([w for p in plain for w in p][:12])
    seen = {}
    for h, w in zip(found.hashes.tolist(), (w for p in plain for w in p), strict=True):
        assert seen.setdefault(h, w) == w
    assert len(seen) == len({w for p in plain for w in p})


def test_passages_of_few_words_and_many_repeats(spark):
    """Six words only: nearly every document shares windows with several items, ties in hashes and short items included."""
    rng = random.Random(3)
    text = lambda sizes: " ".join(rng.choice(["ab", "Cd", "é", "7", "x", "yz"]) for _ in range(rng.choice(sizes)))
    docs = [(i, text([0, 1, 3, 9, 10, 11, 30, 80])) for i in range(300)] + [(None, "ab ab AB"), (5, None), (5, "ab " * 300)]
    items = [(i, text([0, 4, 6, 8, 9, 10, 12, 20])) for i in range(90)] + [(3, "ab " * 40), (None, "ab"), (9, None)]
    found = contamination(spark, docs, items)
    assert found == plain_contamination(docs, items)
    assert sum(n for _, _, n, _ in found) > 300


def test_a_window_is_found_wherever_it_stands(spark):
    rng = random.Random(4)
    fresh = iter(range(10 ** 9))
    passage = [f"p{i}" for i in range(25)]
    docs = []
    for i in range(200):
        start, n = rng.randrange(0, 15), rng.choice([9, 10, 10, 11])
        before, after = ([f"f{next(fresh)}" for _ in range(rng.choice([0, 1, 40]))] for _ in range(2))
        docs.append((i, " ".join(before + passage[start:start + n] + after)))
    found = contamination(spark, docs, [(1, " ".join(passage)), (2, "nothing of this kind stands anywhere in those documents at all")])
    assert found == plain_contamination(docs, [(1, " ".join(passage))])
    assert {n for _, _, n, _ in found} == {0, 10, 11}


def test_a_passage_in_a_third_of_all_documents(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, f"a{i} {passage} b{i}" if i % 3 == 0 else " ".join(f"w{i}x{j}" for j in range(20))) for i in range(900)]
    items = [(i, passage if i < 40 else f"own item {i} with words of its own that are not in any document") for i in range(80)]
    assert contamination(spark, docs, items) == plain_contamination(docs, items)


def test_a_small_filter_loses_nothing(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(f"v{rng.randrange(50)}" for _ in range(60))) for i in range(100)]
    items = [(i, docs[i][1][30:120]) for i in range(0, 100, 7)]
    table = np.full(1, np.uint64(0xFFFFFFFFFFFFFFFF))  # says maybe to everything
    rows = winnowing.marked(spark.createDataFrame(docs, "doc_id long, text string"), table, []).collect()
    assert all(len(r.hits) >= (60 - 9) / 6 for r in rows)
    assert contamination(spark, docs, items) == plain_contamination(docs, items)


def test_passages_in_awkward_rows(spark, awkward, empty):
    items = awkward.selectExpr("doc_id as item_id", "text", "key", "kept")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in winnowing.contamination(awkward, items).collect()), key=repr)
    assert got == plain_contamination([tuple(r) for r in awkward.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert winnowing.contamination(empty, items).count() == 0
    assert winnowing.contamination(awkward, items.where("false")).where("n_hit > 0").count() == 0
    left = winnowing.clean_documents(awkward, items.where("item_id = 1"))
    assert left.columns == awkward.columns and {r.doc_id for r in left.collect()} == {None, 3, 4, 5, 6, 7, 8, 9, 10}


def plain_ranked(docs, items, k):
    held = [(d, c) for d, t in docs if (c := Counter(plain_words(t)))]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(plain_words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, c in held:
            m = 50 + (50 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out += [(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    """Words of very unequal frequency, long and short texts, exact copies, words that occur hundreds of times."""
    rng = random.Random(6)
    words_ = [f"w{int(rng.paretovariate(0.6))}" for _ in range(2000)]
    text = lambda sizes: " ".join(rng.choice(words_) for _ in range(rng.choice(sizes)))
    docs = [(i, text([0, 1, 5, 20, 80, 1200])) for i in range(900)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(None, "w1 w2"), (5, None), (5, "w1 " * 700), (6, "w1 " * 256 + "w2")]
    items = [(i, text([0, 3, 8, 20, 60])) for i in range(50)] + [(3, "w1 W1 w2"), (None, "w1"), (90, None), (91, "neverseen")]
    return docs, items


@pytest.mark.parametrize("k", [1, 7, 50])
def test_ranked_search(spark, corpus, k):
    docs, items = corpus
    rows = max_sketch.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"), k)
    assert sorted(map(tuple, rows.collect())) == plain_ranked(docs, items, k)


def test_ranked_search_in_batches_of_items(spark, corpus, monkeypatch):
    docs, items = corpus
    for name, value in (("ITEMS_AT_ONCE", 7), ("TERMS_AT_ONCE", 90), ("DOCUMENTS_AT_ONCE", 33), ("CELLS_AT_ONCE", 500)):
        monkeypatch.setattr(max_sketch, name, value)
    rows = max_sketch.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert sorted(map(tuple, rows.collect())) == plain_ranked(docs, items, 5)


def test_bounds_hold_and_prune(spark):
    """Every bound is at least the score, and most pairs of the driver's documents and items are never scored."""
    folder = "/root/testdata/sf0.01"
    index = stored(max_sketch.forward_index(spark.read.parquet(f"{folder}/documents.parquet")).where("n > 0"))
    asked = max_sketch.item_terms(spark.read.parquet(f"{folder}/benchmark.parquet")).withColumn("w", max_sketch.F.lit(100)).toArrow()
    queries = max_sketch.Queries.of(asked, {})
    block = max_sketch.Block(index.toArrow().combine_chunks().to_batches()[0], queries, 1000, 400_000)
    assert (block.exact(np.arange(len(block.ids))) <= block.bounds).all()
    _, scored, pairs = max_sketch.search(index, spark.read.parquet(f"{folder}/benchmark.parquet"), 10)
    assert 0 < scored < pairs / 4


def test_ranked_awkward_rows(spark, awkward, empty):
    items = awkward.selectExpr("doc_id as item_id", "text", "score", "bin")
    pairs = [[tuple(r) for r in df.select(*c).collect()] for df, c in ((awkward, ("doc_id", "text")), (items, ("item_id", "text")))]
    assert sorted(map(tuple, max_sketch.ranked(awkward, items).collect())) == plain_ranked(*pairs, 50)
    assert max_sketch.ranked(empty, items).count() == 0 and max_sketch.ranked(awkward, items.where("false")).count() == 0
