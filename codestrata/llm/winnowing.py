"""Benchmark passages in documents, by winnowing.

Of every passage of WINDOW words the gram of GRAM words with the least hash is its fingerprint.  A document keeps the
fingerprints of all its windows, so every passage it shares with a benchmark item has a fingerprint that both keep.
Fingerprints meet in a join; the windows around each that meet are then compared with the items' passages, word by word.
A bounded Bloom filter of the items' fingerprints keeps the others from leaving their task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ranking import union_all
from .common import Batches, bounded_batches, documents, slices, stored
from .words import Words, grams, lists, mixed, words

#: Words of a gram and of a window; a shared run of WINDOW words or more is never missed.
GRAM, WINDOW = 5, 10
#: Bits of the filter: 32 a fingerprint, within these bounds; the upper one is 64 MB.  Beyond it more rows meet in the join.
BITS_PER_PRINT, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 29
HASHES = 3
#: Bytes of a side that is broadcast on request; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20
ROWS = 1 << 16


def _least(hashes: np.ndarray, window: int) -> np.ndarray:
    """The least of every `window` neighbours."""
    out = hashes[:max(0, len(hashes) - window + 1)]
    for i in range(1, window):
        out = np.minimum(out, hashes[i:i + len(out)])
    return out


def _of_length(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of whole runs of `n` words, kept apart from those of other lengths."""
    return mixed(grams(hashes, n) ^ np.uint64(n))


def fingerprints(hashes: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """The fingerprint of every window of a text's word hashes: the least of its grams' hashes."""
    return _least(_of_length(hashes, gram), window - gram + 1)


def passages(items: DataFrame, id_col: str = "item_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """item_id (string), n, print, passage: every window of `window` words of every item; a shorter item is one window of n words."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches, 100):
            names, found = batch.column(0).to_pylist(), words(batch.column(1))
            for i, name in enumerate(names):
                first, last = int(found.bounds[i]), int(found.bounds[i + 1])
                n = min(window, last - first)
                if not n:
                    continue
                own = found.hashes[first:last]
                prints = (fingerprints(own, gram, window) if n == window else _of_length(own, n)).view(np.int64)
                for at in range(0, len(prints), ROWS):
                    upto = min(len(prints), at + ROWS)
                    texts = found.joined(first + at, first + upto + n - 1).split(" ")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (upto - at), pa.string()), pa.array(np.full(upto - at, n, np.int32)), pa.array(prints[at:upto]),
                         pa.array([" ".join(texts[j:j + n]) for j in range(upto - at)], pa.string())], ["item_id", "n", "print", "passage"])

    given = bounded_batches(items).select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return given.where("item_id is not null").mapInArrow(run, "item_id string, n int, print long, passage string")


def filter_of(prints: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """A Bloom filter, as 64-bit words, of the distinct longs in the column `print`; at most `most_bits` reach the driver."""
    bits = min(most_bits, max(LEAST_BITS, 1 << (prints.count() * BITS_PER_PRINT).bit_length()))
    low, step = F.col("print").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("print", 32).bitwiseOR(F.lit(1).cast("long"))
    place = F.explode(F.array(*[(low + F.lit(i).cast("long") * step) % F.lit(bits) for i in range(HASHES)]))
    set_words = (prints.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow())
    out = np.zeros(bits // 64, np.uint64)
    out[set_words.column("word").to_numpy()] = set_words.column("bits").to_numpy().view(np.uint64)
    return out


def possible(table: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether each print may be in the filter."""
    low, step, bits = prints & np.uint64(0xFFFFFFFF), (prints >> np.uint64(32)) | np.uint64(1), np.uint64(len(table) * 64)
    inside = np.ones(len(prints), bool)
    for i in range(HASHES):
        place = (low + np.uint64(i) * step) % bits
        inside &= (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return inside


def _kept(found: Words, gram: int, window: int, short: list[int], table: np.ndarray) -> tuple[np.ndarray, ...]:
    """Kept fingerprints of a batch of texts that may be an item's: hash, first word, words, first and end of the words around it."""
    out = []
    first_of, end_of = np.repeat(found.bounds[:-1], np.diff(found.bounds)), np.repeat(found.bounds[1:], np.diff(found.bounds))
    for n in [window, *short]:
        size = gram if n == window else n
        prints = _of_length(found.hashes, size)
        at = np.arange(len(prints))
        inside = at + size <= end_of[:len(prints)]  # a gram lies in one text
        if n == window:
            # kept is what is least in one of its windows; windows over two texts keep more, never less
            least, kept = _least(prints, window - gram + 1), np.zeros(len(prints), bool)
            for i in range(window - gram + 1):
                kept[i:i + len(least)] |= prints[i:i + len(least)] == least
            inside &= kept & (end_of[:len(prints)] - first_of[:len(prints)] >= window)
        at = at[inside]
        at = at[possible(table, prints[at])]
        around = window - gram if n == window else 0
        out.append((prints[at], at, np.full(len(at), n), np.maximum(at - around, first_of[at]), np.minimum(at + size + around, end_of[at])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def marked(docs: DataFrame, table: np.ndarray, short: list[int], id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM,
           window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hits (print, n, start, context) of every row; start is the place of the context's first word."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # at most MOST_BITS bits

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            found = words(batch.column(1))
            prints, at, n, first, last = _kept(found, gram, window, short, shared.value)
            order = np.argsort(at, kind="stable")
            prints, n, first, last = prints[order], n[order], first[order], last[order]
            doc = np.searchsorted(found.bounds, at[order], side="right") - 1
            hits = pa.StructArray.from_arrays([
                pa.array(prints.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(first - found.bounds[doc]),
                pa.array([found.joined(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.string())], ["print", "n", "start", "context"])
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(found.bounds)), lists(hits, bounds)], ["doc_id", "n_words", "hits"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, hits array<struct<print:long,n:int,start:long,context:string>>")


def _small(df: DataFrame, bytes_of_row: int) -> DataFrame:
    """`df`, broadcast if it is small by count; else Spark chooses, and splits hot keys of the other side."""
    return F.broadcast(df) if df.count() * bytes_of_row <= BROADCAST_BYTES else df


def shared_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                    item_text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: rows (row, doc_id, n_words, maybe), spans (row, start, n, passage) that occur in an item, and items (n, passage, item_id).

    `row` tells rows apart that repeat an id.  A row that is not `maybe` has no span.
    """
    tests = stored(passages(items, item_id_col, item_text_col, gram, window).distinct(), "tests")
    prints = stored(tests.select("print").distinct(), "prints")
    short = sorted(r.n for r in tests.select("n").distinct().collect() if r.n < window)  # window - 1 numbers at most
    rows = stored(marked(docs, filter_of(prints), short, id_col, text_col, gram, window).withColumn("row", F.monotonically_increasing_id()), "marked")
    hits = rows.where(F.size("hits") > 0).select("row", F.inline("hits"))
    met = hits.join(_small(prints, 16), "print", "left_semi")
    own = F.split("context", " ")
    around = F.transform(F.sequence(F.lit(0), F.size("own") - F.col("n")), lambda i: F.struct(
        (F.col("start") + i).alias("start"), F.array_join(F.slice("own", i + 1, F.col("n")), " ").alias("passage")))
    spans = met.withColumn("own", own).select("row", "n", F.explode(around).alias("w")).select("row", "n", "w.start", "w.passage").distinct()
    known = stored(tests.select("n", "passage").distinct(), "passages")
    found = stored(spans.join(_small(known, 24 * window), ["n", "passage"], "left_semi"), "spans")
    return rows.select("row", "doc_id", "n_words", (F.size("hits") > 0).alias("maybe")), found, tests.select("n", "passage", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, spans, item_ids.

    n_hit counts the words inside any occurrence of an item's window (`window` words; a shorter item is one window);
    spans holds the runs of such words as (start, stop) in order, item_ids the items as strings in order.  Null and empty
    texts have no words, items without words or without an id take no part, rows that repeat an item's id are one item.
    Repeated rows are repeated in the result, rows without an id stay.  An empty table gives no rows, a benchmark without
    words no hits.  Other columns are not read.
    """
    rows, found, tests = shared_passages(docs, items, id_col, text_col, item_id_col, item_text_col, gram, window)
    before = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "stop")
    merged = (found.select("row", "start", (F.col("start") + F.col("n")).alias("stop")).groupBy("row", "start").agg(F.max("stop").alias("stop"))
              .withColumn("reach", F.max("stop").over(before)).withColumn("opens", (F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int"))
              .withColumn("run", F.sum("opens").over(upto)).groupBy("row", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")))
    runs = merged.groupBy("row").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    of_row = (found.select("row", "n", "passage").distinct().join(_small(tests, 32 + 24 * window), ["n", "passage"]).select("row", "item_id").distinct()
              .groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids")))
    none = [F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")).alias("spans"),
            F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids")]
    hit = rows.where("maybe").join(runs, "row", "left").join(of_row, "row", "left").select("doc_id", "n_words", *none)
    clean = rows.where("not maybe").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans"),
                                           F.expr("cast(array() as array<string>)").alias("item_ids"))
    return union_all(hit, clean)


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kept: object) -> DataFrame:
    """The rows without a passage of an item, all columns as they were; rows that repeat an id go together, rows without one stay."""
    hit = contamination(docs, items, id_col, text_col, **kept).where("n_hit > 0").select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit, F.col(f"`{id_col}`").cast("long") == F.col("__hit"), "left_anti")
