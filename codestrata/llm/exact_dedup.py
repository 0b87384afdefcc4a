"""Exact duplicates by two Bloom passes.

Pass one counts, in a Bloom filter with two bit planes, which positions were hit once and which at least twice.  Pass two
looks every row up in the second plane: a row of which some position was hit only once is certainly unique and goes
straight through.  Only the others, the repeated rows and a few false alarms, are shuffled and grouped by their digest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import union_all
from .common import Batches, stored, whole

#: Bits of the filter: BITS_PER_ROW a row, within these bounds.  The upper bound (64 MB a plane) is what a task may hold
#: and what is broadcast at most; beyond it more unique rows are shuffled, and the result stays the same.
BITS_PER_ROW, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 29
HASHES = 3
SEGMENT = 1 << 20  # bits that are merged together
FLUSH = 1 << 19  # hashes a task holds before it writes
OFTEN = -1  # the segment number of rows that count frequent hashes


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """One row per hash function."""
    low, step = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * step) % np.uint64(bits) for i in range(HASHES)])


def _pack(positions: np.ndarray) -> bytes:
    """Sorted positions of one segment as compressed differences."""
    return zlib.compress(np.diff(positions.astype("<u4"), prepend=np.uint32(0)).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.uint32)


def repeated_filter(hashes: DataFrame, bits: int, often: int = FLUSH, total: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The plane of positions hit at least twice, as packed bits, and hashes that are very frequent.  `hashes`: one long column.

    Hashes that occur `often` among FLUSH of them are counted; those that come to `total` so are frequent (none, if 0).
    """

    def emit(values: list[np.ndarray]) -> pa.RecordBatch | None:
        if not values:
            return None
        keys = np.concatenate(values)
        unique, counts = np.unique(_positions(keys.view(np.uint64), bits), return_counts=True)
        unique = unique.astype(np.int64)
        cuts = np.flatnonzero(np.diff(unique // SEGMENT)) + 1
        rows = [(int(u[0] // SEGMENT), _pack(u % SEGMENT), _pack((u % SEGMENT)[c > 1]))
                for u, c in zip(np.split(unique, cuts), np.split(counts, cuts), strict=True) if len(u)]
        if total:
            keys, counts = np.unique(keys, return_counts=True)
            if (counts >= often).any():
                rows.append((OFTEN, keys[counts >= often].astype("<i8").tobytes(), counts[counts >= often].astype("<i8").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)],
                                          ["segment", "once", "twice"])

    def first(batches: Batches) -> Batches:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= FLUSH:
                yield emit(held)
                held, n = [], 0
        if (last := emit(held)) is not None:
            yield last

    def merge(batches: Batches) -> Batches:
        once, twice, now = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool), None
        counted: dict[int, int] = {}

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())],
                                              ["segment", "plane"])

        for batch in batches:
            for segment, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if segment == OFTEN:
                    for key, n in zip(np.frombuffer(a, "<i8").tolist(), np.frombuffer(b, "<i8").tolist(), strict=True):
                        counted[key] = counted.get(key, 0) + n
                    continue
                if segment != now:
                    if now is not None:
                        yield done()
                    once[:], twice[:], now = False, False, segment
                hit = _unpack(a)
                twice[hit[once[hit]]] = True
                twice[_unpack(b)] = True
                once[hit] = True
        if now is not None:
            yield done()
        if counted:
            keys = np.array([k for k, n in counted.items() if n >= total], "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([OFTEN], pa.int32()), pa.array([keys.tobytes()], pa.binary())], ["segment", "plane"])

    parts = hashes.mapInArrow(first, "segment int, once binary, twice binary")
    planes = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, plane binary")
    out = np.zeros(-(-bits // SEGMENT) * SEGMENT // 8, np.uint8)
    frequent = np.zeros(0, np.int64)
    for row in planes.toLocalIterator():  # the bits of the filter, and one hash for every `total` rows at most
        if row.segment == OFTEN:
            frequent = np.sort(np.frombuffer(row.plane, "<i8"))
            continue
        out[row.segment * SEGMENT // 8:(row.segment + 1) * SEGMENT // 8] = np.frombuffer(zlib.decompress(row.plane), np.uint8)
    return out, frequent


def possibly_repeated(df: DataFrame, key: str, most_bits: int = MOST_BITS) -> Column:
    """A condition on `df` that holds for every row whose long `key` occurs more than once, and for few others."""
    rows = df.count()
    bits = int(min(most_bits, max(LEAST_BITS, rows * BITS_PER_ROW)))
    plane = df.sparkSession.sparkContext.broadcast(repeated_filter(df.select(key), bits)[0])  # at most MOST_BITS bits

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        positions = _positions(keys.to_numpy(np.int64).view(np.uint64), bits)
        value = plane.value
        return pd.Series(((value[positions >> np.uint64(3)] >> (np.uint64(7) - (positions & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0))

    return hit(F.col(key))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty.  Of equal texts the row with the largest id stays; of rows that repeat the id as well, one
    stays.  Rows without an id lose against rows with one.  An empty table gives no rows.  Other columns are not read.
    """
    digests = stored(df.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(whole(text_col), 256).alias("text_sha256"))
                     .withColumn("key", F.xxhash64("text_sha256")), "exact")
    marked = digests.withColumn("again", possibly_repeated(digests, "key", most_bits))
    single = marked.where("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                              F.lit(True).alias("kept"), "text_sha256")
    rows = marked.where("again").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n"))
    # stored, so that the join deals both sides anew and can split a hot group
    groups = stored(rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "exact")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    several = (rows.join(groups, "text_sha256").select("*", copies.alias("copy"))
               .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"))
    return union_all(single, several)


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """The rows that stay, all columns as they were.

    Only possibly repeated rows are shuffled; each task first keeps one of its own copies, so a group that holds a third
    of all rows is one row per task by then.
    """
    names = docs.columns
    key = F.xxhash64(F.sha2(whole(text_col), 256))
    again = possibly_repeated(docs.select(key.alias("__key")), "__key", most_bits)
    marked = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("__row"), F.col(f"`{id_col}`").cast("long").alias("__id"),
                         F.sha2(whole(text_col), 256).alias("__sha")).withColumn("__key", F.xxhash64("__sha")).withColumn("__again", again)
    single = marked.where("not __again").select("__row")
    several = (marked.where("__again").groupBy("__sha")
               .agg(F.max_by("__row", F.coalesce(F.col("__id"), F.lit(-(1 << 63)))).alias("__row")).select("__row"))
    return union_all(single, several).select("__row.*")
