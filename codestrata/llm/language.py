"""Language by rank-order profiles: out-of-place distance of a text's most frequent n-grams (Cavnar and Trenkle)."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ranking import PARTIAL_LIMIT, top_k
from .common import Batches, documents, kept, remainder, slices

#: n-grams of a profile, longest n-gram, training rows of a language at most.
PROFILE, LONGEST, SAMPLE_ROWS = 300, 3, 3000
MODULUS, HELD_OUT = 5, 0
_BITS = 21  # of a code point
PIECE = 1 << 20  # characters that are counted at once


class Letters:
    """Which code points are letters, all there are; made once a worker."""

    def __init__(self) -> None:
        self.table = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of a text, as numbers, and their counts.  Words are bounded by one blank each; no gram spans a blank inside."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        letter = self.table[codes]
        if not letter.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = np.where(letter, codes, 32)
        codes = np.concatenate([[32], codes[letter | np.concatenate([[False], letter[:-1]])], [32]])
        if codes[-2] == 32:
            codes = codes[:-1]
        parts = []
        for at in range(0, len(codes), PIECE):
            x = codes[at:at + PIECE + LONGEST - 1]
            blank = x == 32
            parts.append(x[:PIECE][~blank[:PIECE]])
            two = x[:-1] | (x[1:] << _BITS)
            parts.append(two[:PIECE])
            three = (two[:-1] | (x[2:] << (2 * _BITS)))[~blank[1:-1]]
            parts.append(three[:PIECE])
        return np.unique(np.concatenate(parts), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, by count, then by number."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))[:size]]


class Profiles:
    """Rank of every n-gram in every language; missing ones have rank PROFILE."""

    def __init__(self, profiles: dict[str, list[int]]) -> None:
        self.languages = sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), PROFILE, np.int32)
        for i, name in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[name], np.int64)), i] = np.arange(len(profiles[name]))

    def nearest(self, top: np.ndarray) -> tuple[str | None, float]:
        """Language and 1 - distance / greatest distance; ties go to the smaller name."""
        if not self.languages:
            return None, 0.0
        at = np.searchsorted(self.grams, top)
        at = np.where((at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == top), at, len(self.grams))
        ranks = self.ranks[at]
        place = np.arange(len(top), dtype=np.int32)[:, None]
        distance = np.where(ranks < PROFILE, np.abs(ranks - place), PROFILE).sum(axis=0)
        best = int(np.argmin(distance))
        return self.languages[best], float(1 - distance[best] / (PROFILE * len(top)))


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Profiles of all languages, from at most `rows` texts of each whose id isn't held out, drawn by a hash of the id.

    The result is bounded by the number of languages, and small: PROFILE numbers each.
    """
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", MODULUS) != HELD_OUT))
    # Of a language with many more rows only those of the smallest hashes are ranked, some more than are wanted.
    known = known.distinct().withColumn("draw", F.xxhash64("doc_id"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("size"))
    lot = (F.col("draw").cast("double") + 2.0 ** 63) / 2.0 ** 64
    likely = known.join(sizes, "lang").where(lot * F.col("size") <= F.lit(1.2 * rows + 200)).select("doc_id", "lang", "draw")
    drawn = top_k(likely, ["lang"], [F.asc("draw"), F.asc("doc_id")], max(rows, PARTIAL_LIMIT), "n").where(F.col("n") <= rows).select("doc_id", "lang")
    texts = documents(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id")  # `rows` ids a language

    def run(batches: Batches) -> Batches:
        letters = kept(("letters",), Letters)
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            texts = batch.column(0).to_pylist()
            for name in set(names):
                parts = [letters.grams(texts[i]) for i in np.flatnonzero(names == name)]
                grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    counts = texts.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PROFILE).collect():  # PROFILE rows a language
        profiles.setdefault(row.lang, []).append((row["rank"], row.gram))
    return {name: [g for _, g in sorted(rows)] for name, rows in profiles.items()}


def identify(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row; `und` and 0 for texts that are null or have no letter, or without profiles."""

    def run(batches: Batches) -> Batches:
        letters, known = kept(("letters",), Letters), Profiles(profiles)
        for batch in slices(batches):
            found = []
            for text in batch.column(1).to_pylist():
                top = ranked(*letters.grams(text))
                name, score = known.nearest(top) if len(top) else (None, 0.0)
                found.append((name or "und", score))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
