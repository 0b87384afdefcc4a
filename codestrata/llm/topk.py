"""Exact top-k inner products, block at a time.

Candidates are cut into blocks of an id range; a block keeps its vectors (the forward index) and the maximum and minimum
of every component.  A query's bound on a block is the sum, over its components, of the product with whichever extreme is
larger.  Each query visits its blocks in the order of their bounds, a growing number a round; when its k-th score lies above
the bounds of the blocks that are left, it is done.  Equal bounds are still visited, so ties are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ranking import top_k, union_all
from .common import Batches, stored

#: Vectors of a block, queries that travel together, blocks whose extremes travel together, blocks a query visits in the
#: first round and how the number grows.
BLOCK, BATCH, BUNDLE, FIRST, GROWTH = 2048, 256, 256, 2, 4


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and v, the components floor(scale * x); vectors that are null or hold null or non-finite components are left out."""
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
            .where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))))
            .select("vec_id", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v")))


def _matrix(vectors: list) -> np.ndarray:
    """Rows of one length or shorter; missing components count as zero."""
    width = max(map(len, vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.array(vectors, np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _bytes(m: np.ndarray) -> tuple[bytes, int]:
    """The numbers in the fewest bytes each that hold them, and how many."""
    width = next(w for w in (2, 4, 8) if not m.size or w == 8 or np.abs(m).max() < 1 << (8 * w - 1))
    return m.astype(f"<i{width}").tobytes(), width


def _numbers(data: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def _grouped(batches: Batches):
    """Key and (id, vector) rows of each run of equal keys; columns key, id, vector, keys sorted."""
    now, ids, vectors = None, [], []
    for batch in batches:
        for key, i, v in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if key != now:
                if ids:
                    yield now, ids, vectors
                now, ids, vectors = key, [], []
            ids.append(i)
            vectors.append(v)
    if ids:
        yield now, ids, vectors


TILE = "tile long, ids binary, matrix binary, width int"


def _tiles(size: int, extremes: bool):
    """Packs runs of vectors into tiles of at most `size`, named by partition and number."""

    def run(batches: Batches) -> Batches:
        n = 0
        for key, ids, vectors in _grouped(batches):
            for at in range(0, len(ids), size):
                m = _matrix(vectors[at:at + size])
                data, width = _bytes(m)
                columns = [pa.array([(key << 33) + n], pa.int64()), pa.array([np.array(ids[at:at + size], "<i8").tobytes()], pa.binary()), pa.array([data], pa.binary()), pa.array([width], pa.int32())]
                if extremes:
                    columns += [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (m.max(axis=0), m.min(axis=0))]
                yield pa.RecordBatch.from_arrays(columns, ["tile", "ids", "matrix", "width", *(["most", "least"] if extremes else [])])
                n += 1

    return run


def tiles(vectors: DataFrame, size: int, extremes: bool = False) -> DataFrame:
    """One row per `size` vectors in the order of ids, with the extremes of every component if wanted.

    Cut within range partitions, so that no tile is larger however the ids are spread or repeated.
    """
    placed = vectors.repartitionByRange(max(1, -(-vectors.count() // (8 * size))), "vec_id").sortWithinPartitions("vec_id")
    return placed.select(F.spark_partition_id().cast("long").alias("key"), "vec_id", "v").mapInArrow(
        _tiles(size, extremes), TILE + ", most array<long>, least array<long>" * extremes)


def _both(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = min(a.shape[1], b.shape[1])  # components that one side lacks count as zero
    return a[:, :width], b[:, :width]


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact: by floats as long as every partial sum fits their 53 bits, else by integers."""
    q, c = _both(q, c)
    if q.size and c.size and float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0 ** 52:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    return q @ c.T


def _bounds(batches: Batches) -> Batches:
    """Bound of every query of a tile on a bundle of blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            names = np.frombuffer(r["ids"], "<i8")
            q = _numbers(r["matrix"], r["width"], len(names))
            most, least = _matrix([b["most"] for b in r["blocks"]]), _matrix([b["least"] for b in r["blocks"]])
            bound = _products(np.maximum(q, 0), most) + _products(np.minimum(q, 0), least)
            blocks, n = np.array([b["tile"] for b in r["blocks"]], np.int64), len(names)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, len(blocks))), pa.array(np.full(n * len(blocks), r["tile"])), pa.array(np.tile(blocks, n)), pa.array(bound.reshape(-1))],
                                             ["query_id", "tile", "block", "bound"])


def _score(k: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                names, ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                wanted = np.flatnonzero(np.isin(names, np.array(r["queries"], np.int64)))
                scores = _products(_numbers(r["q_matrix"], r["q_width"], len(names))[wanted], _numbers(r["matrix"], r["width"], len(ids)))
                out: list[list[np.ndarray]] = [[], [], []]
                for name, row in zip(names[wanted], scores, strict=True):
                    use = np.flatnonzero(ids != name)
                    if len(use) > k:
                        use = use[row[use] >= np.partition(row[use], len(use) - k)[len(use) - k]]
                    use = use[np.lexsort((ids[use], -row[use]))[:k]]
                    for o, x in zip(out, (np.full(len(use), name), ids[use], row[use]), strict=True):
                        o.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["query_id", "vec_id", "score"])

    return run


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of greatest inner product, never the query's own id.

    Both inputs have vec_id and v (array<long>); ties go to the smaller id.  A query without candidates has no rows;
    repeated candidate rows count one by one, repeated query ids once.
    """
    index = stored(tiles(candidates, block, True), "blocks")
    packs = stored(tiles(queries.dropDuplicates(["vec_id"]), BATCH), "queries")
    # extremes travel in bundles; every pack of queries meets every bundle, two numbers a component for a block
    bundles = max(1, -(-index.count() // BUNDLE))
    bundled = (index.select(F.pmod(F.xxhash64("tile"), F.lit(bundles)).cast("int").alias("bundle"), F.struct("tile", "most", "least").alias("b"))
               .groupBy("bundle").agg(F.collect_list("b").alias("blocks")))
    met = packs.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)))).join(bundled, "bundle").drop("bundle")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = stored(met.mapInArrow(_bounds, "query_id long, tile long, block long, bound long").withColumn("place", F.row_number().over(order)), "bounds")
    packs = packs.select("tile", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("width").alias("q_width"))
    blocks = index.select(F.col("tile").alias("block"), "ids", "matrix", "width")
    best, done, reach = None, 0, FIRST
    while True:
        due = bounds.where((F.col("place") > done) & (F.col("place") <= reach))
        visits = (due if best is None else _open(due, best, k)).groupBy("tile", "block").agg(F.collect_list("query_id").alias("queries"))  # BATCH at most
        found = visits.join(packs, "tile").join(blocks, "block").mapInArrow(_score(k), "query_id long, vec_id long, score long")
        best = stored(top_k(found if best is None else union_all(best.drop("rank"), found), ["query_id"], [F.desc("score"), F.col("vec_id")], k), "best")
        done, reach = reach, reach * GROWTH
        if _open(bounds.where(F.col("place") > done), best, k).isEmpty():
            return best.select("query_id", "rank", "vec_id", "score")


def _open(rows: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """The blocks whose bound is not below the query's k-th score so far."""
    kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    return rows.join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).drop("kth")
