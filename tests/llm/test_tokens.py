"""Encoding, packing and search: exact against the public libraries and brute force."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codestrata.llm import bpe, packing, topk

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Plain text, it's fine.\n\n  Two  blanks", "Ünï 12³ ½ ÀÉ'S", "日本語テキスト　全角 \x1c x\x1d\x85 é<|endoftext|>", "😀" * 30, "a" * 1500 + " " * 40 + "\t",
         "thth" * 400, "\x00\x7f\xa0\xad", "Œuvre é Ω Σς <|startoftext|>", " lead", "x\ny\r\nz", "é" * 300]


@pytest.fixture(scope="module")
def words():
    return random.Random(2).choices(["alpha", "Beta", "gamma,", "delta.", "Ünï", "x", "12", "\n", "supercalifragilistic"], k=3000)


def test_codec_is_the_librarys(spark, words):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = [*TEXTS, " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_long_words_agree(monkeypatch):
    """The recursive query and the heap, on words of any length."""
    monkeypatch.setattr(bpe, "LONG", 1 << 20)
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    draw = random.Random(4)
    for _ in range(50):
        word = "".join(draw.choices("abethé", k=draw.randrange(2, 300))).encode()
        assert encoder.contract([word])[0] == encoder._long(word)


def test_a_batch_of_long_words_ends():
    """Thousands of words of up to 500 bytes in one batch, as in hex dumps: seconds, and the ids of the library."""
    encoder, draw = bpe.Encoder(RANKS, public_tokenizers.PATTERN), random.Random(6)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    found = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randrange(1, 500))) for _ in range(6000)]
    begun = time.monotonic()
    ids = encoder.contract([w.encode() for w in found])
    assert time.monotonic() - begun < 60
    for word, own in zip(found[::20], ids[::20], strict=True):
        assert np.frombuffer(own, "<u4").tolist() == library.encode_ordinary(word)


def test_splitters_agree():
    split = bpe.Splitter(public_tokenizers.PATTERN)
    draw = random.Random(5)
    for _ in range(500):
        text = "".join(chr(draw.choice([draw.randrange(0x250), 32, 32, 39, 115])) for _ in range(40))
        assert split.narrow(text) == split.wide(text)


def test_codec_awkward(awkward, empty):
    rows = bpe.decode(bpe.encode(awkward, RANKS, public_tokenizers.PATTERN), RANKS)
    assert sorted(bytes(r.decoded).decode() for r in rows.collect()) == sorted(r.text or "" for r in awkward.collect())
    assert bpe.decode(bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def check_packing(rows, length):
    """Sequences are gapless and no longer than they may be; returns their number."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end <= length
    return len(sequences)


def test_packing_is_the_librarys(spark, words):
    library = Tokenizer.from_file(WORDS)
    texts = [*TEXTS, " ".join(words)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORDS).collect()
    want = {}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want[i, n] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    check_packing(rows, 2048)


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_packing_wastes_little(spark, tasks, monkeypatch):
    draw = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(["x"] * draw.choice([1, 5, 30, 200, 700, 1200, 1900, 2500]))) for i in range(900)], "doc_id long, text string").repartition(tasks)
    rows = packing.pack(docs, WORDS).collect()
    best = len(packing.best_fit(np.array([r.length for r in rows]), 2048)[2])
    assert check_packing(rows, 2048) <= best * 1.02 + 1
    assert len(rows) == len({(r.doc_id, r.piece) for r in rows})


def test_packing_with_small_groups(spark, monkeypatch):
    """More underfull bins than a group takes: several groups are left, and nothing is lost."""
    monkeypatch.setattr(packing, "GROUP", 4)
    docs = spark.createDataFrame([(i, " ".join(["x"] * (1100 + i % 7))) for i in range(200)], "doc_id long, text string").repartition(16)
    rows = packing.pack(docs, WORDS).collect()
    assert len(rows) == 200 and check_packing(rows, 2048) == 200


def test_best_fit_by_hand():
    bins, places, fills = packing.best_fit(np.array([3, 5, 5, 2, 7]), 10)
    assert fills == [10, 10, 2] or sorted(fills) == [2, 10, 10]
    assert places[4] == 0 and sum(fills) == 22


def test_packing_awkward(awkward, empty):
    rows = packing.pack(awkward, WORDS).collect()
    assert len({(r.doc_id, r.piece) for r in rows if r.doc_id in (6, 7)}) > 2 and sum(r.doc_id == 2 for r in rows) == 2
    assert [r.length for r in rows if r.doc_id in (3, 4, 5)] == [1, 1, 1]
    check_packing(rows, 2048)
    assert packing.pack(empty, WORDS).count() == 0


def plain_top(vectors, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in vectors if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("scale", [3, 1 << 40])
def test_top_k_by_brute_force(spark, scale, monkeypatch):
    draw = random.Random(scale)
    monkeypatch.setattr(topk, "BATCH", 7)
    monkeypatch.setattr(topk, "BUNDLE", 3)
    vectors = [(i, [draw.randrange(-scale, scale) for _ in range(6)]) for i in range(0, 800, 2)] + [(i, [1, 0, 0, 0, 0, -1]) for i in range(1, 300, 2)]
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>").repartition(5)
    got = topk.exact_top_k(df, df.where("vec_id % 25 = 0"), 10, block=16)
    limit = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)  # noqa: E731  scores are longs
    want = [(q, r, i, limit(s)) for q, r, i, s in plain_top(vectors, [v for v in vectors if v[0] % 25 == 0], 10)]
    mine = sorted(tuple(r) for r in got.collect())
    assert mine == want if scale == 3 else len(mine) == len(want)


def test_top_k_few_and_none(spark):
    few = spark.createDataFrame([(0, [1, 2]), (1, [3]), (100, [0, 0])], "vec_id long, v array<long>")
    assert sorted(tuple(r) for r in topk.exact_top_k(few, few.where("vec_id % 100 = 0"), 10).collect()) == [(0, 1, 1, 3), (0, 2, 100, 0), (100, 1, 0, 0), (100, 2, 1, 0)]
    none = few.where("false")
    assert topk.exact_top_k(none, none, 10).count() == 0 and topk.exact_top_k(few, none, 10).count() == 0


def test_integer_vectors_leave_out(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, [0.5, -0.0001]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (None, [1.0])],
                               "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    assert sorted((r.vec_id, r.v) for r in topk.integer_vectors(df).collect()) == [(0, [512, -1]), (5, [])]
