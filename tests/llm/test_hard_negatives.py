"""Strassen's recursion, heaps, and hard negatives against plain code."""

import random

import numpy as np
import pytest

from codestrata.llm import hard_negatives
from codestrata.llm.hard_negatives import Heap, strassen


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (64, 64, 64), (37, 130, 65), (128, 64, 200), (0, 4, 4), (4, 4, 0), (5, 0, 3)])
def test_strassen(shape):
    rng = np.random.default_rng(1)
    n, m, p = shape
    a, b = rng.integers(-300, 300, (n, m)), rng.integers(-300, 300, (m, p))
    for leaf in (1, 2, 16, 64):
        assert (strassen(a, b, leaf) == a @ b).all()


def test_strassen_beyond_the_range_of_floats():
    """Products up to 2^62, sums of halves past 2^63: exact all the same."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(1 << 29), 1 << 29, (40, 16)), rng.integers(-(1 << 29), 1 << 29, (16, 24))
    assert strassen(a, b, 2).tolist() == [[sum(x * y for x, y in zip(r, c, strict=True)) for c in zip(*b.tolist(), strict=True)] for r in a.tolist()]
    large = np.full((4, 4), 1 << 30), np.full((4, 4), (1 << 31) - 1)
    assert (strassen(*large, 1) == large[0] @ large[1]).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(3)
    scores, ids = rng.integers(0, 9, 400), rng.permutation(400)
    best = sorted(zip((-scores).tolist(), ids.tolist(), strict=True))[:13]
    parts = []
    for at in range(0, 400, 37):
        parts.append(Heap(13))
        parts[-1].offer(scores[at:at + 37], ids[at:at + 37])
    random.Random(4).shuffle(parts)
    whole = Heap(13)
    for part in parts:
        whole.merge(part.kept)
    assert sorted((-s, -i) for s, i in whole.kept) == best


def plain(rows, anchors, n_positives=5, n_negatives=10, least=30, most=90):
    out, of_id = [], {}
    for a in sorted(anchors, key=lambda r: (r[0], r[1], r[2])):
        of_id.setdefault(a[0], a)
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=False))
    for anchor, label, v in of_id.values():
        scored = [(-dot(v, w), i, l) for i, l, w in rows if i != anchor]
        for s, i, _ in sorted(r for r in scored if r[2] == label)[:n_positives]:
            window = sorted(r for r in scored if r[2] != label and least * -s <= 100 * -r[0] <= most * -s)
            out += [(anchor, i, rank, other, -s, -t) for rank, (t, other, _) in enumerate(window[:n_negatives], 1)]
    return sorted(out)


def mined(spark, rows, anchors, **more):
    frame = lambda r: spark.createDataFrame(r, "vec_id long, label long, v array<long>")
    return sorted(map(tuple, hard_negatives.mine(frame(rows).repartition(5), frame(anchors), **more).collect()))


def test_hard_negatives_over_many_tiles(spark):
    """Few values, so that scores tie; one vector, and one label, hold a third of all rows."""
    rng = random.Random(5)
    hot = [3, -2, 1, 4, 0]
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(4), hot if i % 3 == 1 else [rng.randrange(-4, 5) for _ in range(5)]) for i in range(400)]
    anchors = [r for r in rows if r[0] % 20 == 0]
    expected = plain(rows, anchors)
    assert len(expected) > 300
    for tile, leaf in ((64, 2), (17, 64), (4096, 4)):
        assert mined(spark, rows, anchors, tile=tile, leaf=leaf) == expected


def test_heaps_that_are_handed_on_early(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), [rng.randrange(-4, 5) for _ in range(5)]) for i in range(200)]
    monkeypatch.setattr(hard_negatives, "HEAPS", 3)
    assert mined(spark, rows, rows[::10], tile=16) == plain(rows, rows[::10])


def test_repeated_rows_lengths_and_empty_tables(spark):
    rows = [(1, 0, [2, 2]), (1, 0, [2, 2]), (2, 0, [2, 2, 9]), (2, 0, [2, 2, 9]), (3, 1, [1, 1]), (3, 1, [1, 1]), (4, 1, []), (5, 2, [-5, 0])]
    for anchors in (rows, rows[:2], rows[6:]):
        assert mined(spark, rows, anchors) == plain(rows, anchors)
    assert mined(spark, [], []) == mined(spark, rows, []) == mined(spark, [], rows) == []


def test_rows_that_take_no_part(spark):
    rows = [(1, [0.5, 0.25], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [1.0, -0.001], None), (None, [1.0, 1.0], 1),
            (7, [0.999, -0.001], 2)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, label int, part string, width int")
    assert sorted(map(tuple, hard_negatives.labelled_vectors(df).collect())) == [(1, 1, [128, 64]), (7, 2, [255, -1])]
