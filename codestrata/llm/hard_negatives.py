"""Hard negatives by exact inner products of tiles, multiplied by Strassen's recursion, and mergeable heaps.

Anchors travel in packs, all rows in tiles.  Every pack meets every tile in some task, whose product of int64 matrices is
taken by seven half-sized ones, down to leaves; odd sizes are padded with zeros.  Additions are exact (modulo 2^64, as are the
products, so intermediate sums may pass the range).  A first pass keeps every anchor's positives in heaps, a second one the rows
within every positive's window; heaps of a task's tiles are merged there, those of different tasks by Spark.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import top_k
from .common import Batches, bounded_batches, stored
from .topk import _bytes, _matrix, _numbers

#: Side from which on a product is split, anchors of a pack, rows of a tile, full tiles that a task sees together.
LEAF, PACK, TILE, GROUP = 64, 512, 2048, 8
#: Heaps that a task holds, each of a few entries; more are handed on and merged with those to come by Spark.
HEAPS = 50_000
TILE_COLUMNS = "tile long, ids binary, labels binary, matrix binary, width int"


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By floats if every partial sum fits their 53 bits, else by integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0 ** 53:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a @ b


def _padded(a: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return np.pad(a, ((0, rows - a.shape[0]), (0, columns - a.shape[1])))


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices."""
    (n, m), p = a.shape, b.shape[1]
    if min(n, m, p) < leaf or min(n, m, p) < 2:
        return _leaf(a, b)
    n2, m2, p2 = -(-n // 2), -(-m // 2), -(-p // 2)
    if n % 2 or m % 2:
        a = _padded(a, 2 * n2, 2 * m2)
    if m % 2 or p % 2:
        b = _padded(b, 2 * m2, 2 * p2)
    a11, a12, a21, a22 = a[:n2, :m2], a[:n2, m2:], a[n2:, :m2], a[n2:, m2:]
    b11, b12, b21, b22 = b[:m2, :p2], b[:m2, p2:], b[m2:, :p2], b[m2:, p2:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2_, m3 = strassen(a21 + a22, b11, leaf), strassen(a11, b12 - b22, leaf)
    m4, m5 = strassen(a22, b21 - b11, leaf), strassen(a11 + a12, b22, leaf)
    m6, m7 = strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * n2, 2 * p2), np.int64)
    out[:n2, :p2], out[:n2, p2:] = m1 + m4 - m5 + m7, m3 + m5
    out[n2:, :p2], out[n2:, p2:] = m2_ + m4, m1 - m2_ + m3 + m6
    return out[:n, :p]


class Heap:
    """The k best of what was offered: higher scores first, smaller ids among equals.  The worst one kept is on top."""

    __slots__ = ("k", "kept")

    def __init__(self, k: int) -> None:
        self.k, self.kept = k, []

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Some rows; those that can't enter are left out first."""
        if len(self.kept) == self.k:
            use = scores >= self.kept[0][0]
            scores, ids = scores[use], ids[use]
        if len(scores) > self.k:  # ties at the k-th place stay
            use = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[use], ids[use]
            best = np.lexsort((ids, -scores))[:self.k]
            scores, ids = scores[best], ids[best]
        self.merge(zip(scores.tolist(), (-ids).tolist(), strict=True))

    def merge(self, others) -> None:
        """Entries (score, -id) of another heap."""
        for entry in others:
            if len(self.kept) < self.k:
                heapq.heappush(self.kept, entry)
            else:
                heapq.heappushpop(self.kept, entry)


def labelled_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """vec_id, label, v (floor(scale * x)); rows without an id or a label and vectors with null or non-finite components are left out."""
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("x"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
            .where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))))
            .select("vec_id", "label", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("v")))


def tiled(vectors: DataFrame, size: int) -> DataFrame:
    """One row per `size` rows in the order of ids: ids, labels and matrix.  Cut within range partitions."""

    def run(batches: Batches) -> Batches:
        held, n, part = [], 0, None

        def emit(rows: list) -> pa.RecordBatch:
            data, width = _bytes(_matrix([r[2] for r in rows]))
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 33) + n], pa.int64()), *(pa.array([np.array([r[i] for r in rows], "<i8").tobytes()], pa.binary()) for i in (0, 1)),
                 pa.array([data], pa.binary()), pa.array([width], pa.int32())], ["tile", "ids", "labels", "matrix", "width"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            held += zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)
            while len(held) >= size:
                yield emit(held[:size])
                held, n = held[size:], n + 1
        if held:
            yield emit(held)

    placed = bounded_batches(vectors).repartitionByRange(max(1, -(-vectors.count() // (8 * size))), "vec_id").sortWithinPartitions("vec_id")
    return placed.select(F.spark_partition_id().cast("long").alias("part"), "vec_id", "label", "v").mapInArrow(run, TILE_COLUMNS)


def _row(batch: pa.RecordBatch, i: int) -> dict:
    return {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _unpacked(r: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(r[prefix + "ids"], "<i8")
    return ids, np.frombuffer(r[prefix + "labels"], "<i8"), _numbers(r[prefix + "matrix"], r[prefix + "width"], len(ids))


def _products(q: np.ndarray, c: np.ndarray, leaf: int) -> np.ndarray:
    width = min(q.shape[1], c.shape[1])  # components that one side lacks count as zero
    return strassen(q[:, :width], np.ascontiguousarray(c[:, :width].T), leaf)


def _met(packs: DataFrame, tiles: DataFrame, run, schema: str) -> DataFrame:
    """`run` over every pack with every tile; the tiles of a group follow each other for a pack."""
    rows = tiles.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] // 8
    groups = max(1, -(-rows // (GROUP * TILE)))  # by rows: many small tiles don't make more groups
    grouped = tiles.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int"))
    asked = packs.withColumnsRenamed({c: f"q_{c}" for c in ("tile", "ids", "labels", "matrix", "width")}).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return asked.join(grouped, "part").drop("part").mapInArrow(run, schema)


def _heaped(k: int, leaf: int, offers, names: list[str]):
    """Runs over (pack, tile) rows in any order; heaps are merged over all tiles of a task, HEAPS of them at a time.

    offers(row, pack, tile, scores) → (key, scores, ids).
    """

    def run(batches: Batches) -> Batches:
        packs, heaps = {}, {}

        def emit() -> pa.RecordBatch:
            rows = [(*key, score, -other) for key, heap in heaps.items() for score, other in heap.kept]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)

        for batch in batches:
            for i in range(batch.num_rows):
                r = _row(batch, i)
                if r["q_tile"] not in packs:
                    packs = {r["q_tile"]: _unpacked(r, "q_"), **(packs if len(packs) < GROUP else {})}
                pack, tile = packs[r["q_tile"]], _unpacked(r, "")
                for key, scores, ids in offers(r, pack, tile, _products(pack[2], tile[2], leaf)):
                    if len(scores):
                        heaps.setdefault(key, Heap(k)).offer(scores, ids)
                if len(heaps) > HEAPS:
                    yield emit()
                    heaps = {}
        if heaps:
            yield emit()

    return run


def positives(packs: DataFrame, tiles: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """pack, anchor_id, positive_score, positive_id, rank: every anchor's best `k` other rows of its label."""

    def offers(r, pack, tile, scores):
        for anchor, label, row in zip(pack[0].tolist(), pack[1].tolist(), scores, strict=True):
            use = np.flatnonzero((tile[1] == label) & (tile[0] != anchor))
            yield (r["q_tile"], anchor), row[use], tile[0][use]

    names = ["pack", "anchor_id", "positive_score", "positive_id"]
    found = _met(packs, tiles, _heaped(k, leaf, offers, names), ", ".join(f"{n} long" for n in names))
    return top_k(found, ["pack", "anchor_id"], [F.desc("positive_score"), F.asc("positive_id")], k)


def windowed(packs: DataFrame, tiles: DataFrame, wanted: DataFrame, k: int, least: int, most: int, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_score, negative_score, negative_id, rank: for every positive score of an anchor, the best `k` rows of another
    label with least * positive_score <= 100 * negative_score <= most * positive_score.  `wanted`: pack, anchor_id, positive_score."""

    def offers(r, pack, tile, scores):
        windows: dict[int, list[int]] = {}
        for w in r["wanted"]:
            windows.setdefault(w["anchor_id"], []).append(w["positive_score"])
        for anchor, label, row in zip(pack[0].tolist(), pack[1].tolist(), scores, strict=True):
            if anchor in windows:
                other = np.flatnonzero(tile[1] != label)
                score, ids = row[other], tile[0][other]
                for p in windows[anchor]:
                    use = (100 * score >= least * p) & (100 * score <= most * p)
                    yield (anchor, p), score[use], ids[use]

    names = ["anchor_id", "positive_score", "negative_score", "negative_id"]
    of_pack = wanted.select("pack", "anchor_id", "positive_score").distinct().groupBy("pack").agg(F.collect_list(F.struct("anchor_id", "positive_score")).alias("wanted"))
    asked = packs.join(of_pack, F.col("tile") == F.col("pack")).drop("pack")
    found = _met(asked, tiles, _heaped(k, leaf, offers, names), ", ".join(f"{n} long" for n in names))
    return top_k(found, ["anchor_id", "positive_score"], [F.desc("negative_score"), F.asc("negative_id")], k)


def mine(vectors: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 10, least: int = 30, most: int = 90,
         leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors and anchors: vec_id, label, v (array<long>).  An anchor's positives are its `n_positives` best other rows (of another
    id) of its label by inner product; of each, the negatives are the `n_negatives` best rows of another label whose score is
    `least` to `most` hundredths of the positive's.  Higher scores come first, ties by the smaller id.  Repeated rows count one
    by one; of rows that repeat an anchor's id the least is the anchor.  Vectors of different lengths count as padded with
    zeros.  An anchor without a positive, and a positive without a negative, has no rows; an empty table has none either.
    """
    tiles = stored(tiled(vectors, tile), "tiles")
    distinct = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("one")).select("vec_id", "one.label", "one.v")
    packs = stored(tiled(distinct, min(PACK, tile)), "packs")
    found = stored(positives(packs, tiles, n_positives, leaf).drop("rank"), "positives")
    negatives = windowed(packs, tiles, found, n_negatives, least, most, leaf)
    return found.join(negatives, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
