"""Exact ranked search by hashed max-sketches.

A document's forward index holds its distinct terms (as 64-bit hashes, in order) and how often each occurs.  Its sketch folds
the occurrences into two rows of cells, each cell the maximum of the terms that hash to it.  The smaller of a query term's two cells
bounds its occurrences, and with them, as a document's score grows with occurrences, its score.  Queries are looked up in
batches; a task visits each query's documents by descending bound and scores them exactly from the forward index, until the
next bound is below the query's k-th score.  A first small part of the documents gives every query a k-th score to start from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import top_k, union_all
from .common import Batches, bounded_batches, documents, slices, stored
from .words import lists, words

#: Cells of a row for each distinct term, at least; the fewest cells; occurrences from here on share one cell value.
CELLS_PER_TERM, LEAST_CELLS, MOST = 4, 64, 255
#: Items and terms of items that are looked up together, documents bounded together, bytes of cells looked up at once, and
#: the share of the documents that is searched first (1 in so many).
ITEMS_AT_ONCE, TERMS_AT_ONCE, DOCUMENTS_AT_ONCE, CELLS_AT_ONCE, FIRST = 1024, 1 << 18, 1024, 1 << 20, 16
#: Distinct query terms up to which they are broadcast to count them.
BROADCAST_TERMS = 1 << 20
#: Weight and impact, fixed values: a term weighs floor(WEIGHT * ln((2N + 2) / (2df + 1))); an impact is IMPACT * tf div
#: (SCALE * tf + SLOPE * m), with m = 100 - SHARE + (SHARE * n * N) div L.
WEIGHT, IMPACT, SCALE, SLOPE, SHARE = 1000.0, 10 ** 9, 1000, 20, 50


def _sketch(terms: np.ndarray, counts: np.ndarray) -> bytes:
    """Two rows of cells; the second one takes other bits of the hash."""
    width = max(LEAST_CELLS, 1 << (CELLS_PER_TERM * len(terms) - 1).bit_length())
    cells, order = np.zeros((2, width), np.uint8), np.argsort(counts, kind="stable")
    low, value = np.uint64(width - 1), np.minimum(counts[order], MOST).astype(np.uint8)
    for row, shift in enumerate((0, 32)):
        cells[row, (terms[order] >> np.uint64(shift)) & low] = value  # of the terms of a cell the last, largest one stays
    return cells.tobytes()


def forward_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms (hashes of the distinct ones, in unsigned order), counts, cells (the sketch)."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            found = words(batch.column(1))
            each = [np.unique(found.hashes[a:b], return_counts=True) for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True)]
            bounds = np.cumsum([0, *(len(t) for t, _ in each)])
            terms, counts = np.concatenate([t for t, _ in each]), np.concatenate([c for _, c in each])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(found.bounds)), lists(terms.view(np.int64), bounds), lists(counts.astype(np.int32), bounds),
                 pa.array([_sketch(t, c) for t, c in each], pa.binary())], ["doc_id", "n", "terms", "counts", "cells"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, terms array<long>, counts array<int>, cells binary")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term: the distinct terms of every item, as hashes."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches, 100):
            found = words(batch.column(1))
            each = [np.unique(found.hashes[a:b]) for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True)]
            sizes = np.array([len(t) for t in each])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.concatenate(each).view(np.int64))], ["item_id", "term"])

    given = bounded_batches(items).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return given.where("item_id is not null").mapInArrow(run, "item_id long, term long").distinct()


def weights(index: DataFrame, asked: DataFrame, n_documents: int) -> DataFrame:
    """term, w of every term in `asked` (term): counted over all documents of the index."""
    terms = stored(asked.select("term").distinct(), "terms")
    spread = index.select(F.explode("terms").alias("term"))
    if terms.count() <= BROADCAST_TERMS:
        counted = spread.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    else:  # counted in every task first: what is shuffled is a row for each term of a task
        counted = spread.groupBy("term").agg(F.count("*").alias("df"))
    df = F.coalesce("df", F.lit(0))
    w: Column = F.floor(F.lit(WEIGHT) * F.log(F.lit(float(2 * n_documents + 2)) / (2 * df + 1).cast("double"))).cast("long")
    return terms.join(counted, "term", "left").select("term", w.alias("w"))


@dataclass
class Queries:
    """A batch of items: distinct terms and their weights; the terms of each item, and the items of each term, as index runs."""

    items: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    of_term: np.ndarray
    term_bounds: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, best: dict[int, int]) -> Queries:
        """rows: item_id, term, w; best: the score that an item's results reach at least."""
        items, item = np.unique(rows.column("item_id").to_numpy(), return_inverse=True)
        terms, at, term = np.unique(rows.column("term").to_numpy().view(np.uint64), return_index=True, return_inverse=True)
        order = np.argsort(term, kind="stable")
        return cls(items, terms, rows.column("w").to_numpy()[at], item[order], np.searchsorted(term[order], np.arange(len(terms) + 1)),
                   np.array([max(1, best.get(i, 1)) for i in items.tolist()], np.int64))

    def spread(self, documents_: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int) -> np.ndarray:
        """Scores (rows x items) from rows' terms and impacts."""
        sizes = np.diff(self.term_bounds)[term]
        begins = np.cumsum(sizes) - sizes
        place = np.repeat(self.term_bounds[:-1][term] - begins, sizes) + np.arange(int(sizes.sum()))
        out = np.zeros(rows * len(self.items), np.int64)
        np.add.at(out, np.repeat(documents_ * len(self.items), sizes) + self.of_term[place], np.repeat(self.weights[term] * impact, sizes))
        return out.reshape(rows, len(self.items))


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (IMPACT * tf) // (SCALE * tf + SLOPE * m)


class Block:
    """Documents that are bounded and scored together."""

    def __init__(self, batch: pa.RecordBatch, queries: Queries, n_documents: int, n_terms: int) -> None:
        self.q = queries
        self.ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        self.m = (100 - SHARE) + (SHARE * n * n_documents) // n_terms
        terms, counts = batch.column(2), batch.column(3)
        self.at = np.asarray(terms.offsets) - terms.offsets[0].as_py()
        self.terms, self.counts = terms.flatten().to_numpy().view(np.uint64), counts.flatten().to_numpy()
        self.bounds = self._bounds([x.as_py() for x in batch.column(4)])

    def _bounds(self, cells: list[bytes]) -> np.ndarray:
        q, sizes = self.q, np.array([len(c) for c in cells])
        values = np.arange(MOST, dtype=np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []  # document and term of cells that aren't empty
        out = np.zeros((len(cells), len(q.items)), np.int64)
        at_once = max(1, CELLS_AT_ONCE // max(1, len(q.terms)))
        for size in np.unique(sizes).tolist():
            low = np.uint64(size // 2 - 1)
            first, second = (q.terms & low).astype(np.int64), ((q.terms >> np.uint64(32)) & low).astype(np.int64)
            own = np.flatnonzero(sizes == size)
            for at in range(0, len(own), at_once):
                rows = own[at:at + at_once]
                sketches = np.frombuffer(b"".join(cells[i] for i in rows.tolist()), np.uint8).reshape(len(rows), 2, size // 2)
                value = np.minimum(sketches[:, 0].take(first, axis=1), sketches[:, 1].take(second, axis=1))
                row, term = np.nonzero(value)
                table = np.concatenate([_impact(values, self.m[rows, None]), np.full((len(rows), 1), IMPACT // SCALE)], axis=1)
                out[rows] = q.spread(row, term, table[row, value[row, term]], len(rows))
                self.held.append((rows[row], term))
        row = np.concatenate([r for r, _ in self.held])
        order = np.argsort(row, kind="stable")
        self.held_term = np.concatenate([t for _, t in self.held])[order]
        self.held_at = np.searchsorted(row[order], np.arange(len(cells) + 1))
        return out

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """Scores of documents for every item."""
        of_row, of_term, impact = [], [], []
        for i, r in enumerate(rows.tolist()):
            own, term = self.terms[self.at[r]:self.at[r + 1]], self.held_term[self.held_at[r]:self.held_at[r + 1]]
            place = np.minimum(np.searchsorted(own, self.q.terms[term]), len(own) - 1)
            same = own[place] == self.q.terms[term]
            of_term.append(term[same])
            of_row.append(np.full(len(of_term[-1]), i))
            impact.append(_impact(self.counts[self.at[r]:self.at[r + 1]][place[same]].astype(np.int64), self.m[r]))
        return self.q.spread(np.concatenate(of_row), np.concatenate(of_term), np.concatenate(impact), len(rows))


class Best:
    """The k best documents of every item so far."""

    def __init__(self, queries: Queries, k: int) -> None:
        self.k, self.least = k, queries.least.copy()
        self.ids, self.scores = np.full((k, len(queries.items)), np.iinfo(np.int64).max), np.zeros((k, len(queries.items)), np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        all_ids = np.concatenate([self.ids, np.repeat(ids[:, None], scores.shape[1], axis=1)])
        all_scores = np.concatenate([self.scores, scores])
        order = np.lexsort((all_ids, -all_scores), axis=0)[:self.k]
        self.ids, self.scores = np.take_along_axis(all_ids, order, axis=0), np.take_along_axis(all_scores, order, axis=0)
        self.least = np.maximum(self.least, self.scores[-1])

    def visit(self, block: Block) -> int:
        """Scores the block's documents by descending bound; how many pairs with items the bounds left open.

        A document that is open for one item is scored for all items of the batch at once.
        """
        n, items = block.bounds.shape
        order, done, at, step, pairs = np.argsort(-block.bounds, axis=0, kind="stable"), np.zeros(n, bool), 0, self.k, 0
        while at < n:
            chunk = order[at:at + step]
            open_ = block.bounds[chunk, np.arange(items)] >= self.least  # an equal score may win by its id
            rows = np.unique(chunk[open_])
            if not len(rows):
                break
            pairs += int(open_.sum())
            rows = rows[~done[rows]]
            if len(rows):
                done[rows] = True
                self.add(block.ids[rows], block.exact(rows))
            at, step = at + step, 2 * step
        return pairs


def _searched(index: DataFrame, queries: Queries, k: int, n_documents: int, n_terms: int) -> DataFrame:
    """item_id, doc_id, score of each task's best; a row without an item has the pairs that were scored exactly, in `visited`."""
    shared = index.sparkSession.sparkContext.broadcast(queries)  # at most about TERMS_AT_ONCE terms

    def run(batches: Batches) -> Batches:
        q, visited = shared.value, 0
        best = Best(q, k)
        for batch in slices(batches, DOCUMENTS_AT_ONCE):
            if batch.num_rows:
                visited += best.visit(Block(batch, q, n_documents, n_terms))
        rank, item = np.nonzero((best.scores > 0) & (best.scores >= q.least))
        if visited:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 3 + [pa.array([visited], pa.int64())], ["item_id", "doc_id", "score", "visited"])
        yield pa.RecordBatch.from_arrays([pa.array(q.items[item]), pa.array(best.ids[rank, item]), pa.array(best.scores[rank, item]), pa.nulls(len(item), pa.int64())],
                                         ["item_id", "doc_id", "score", "visited"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long, visited long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the `k` documents of the highest score above 0 for every item, equal scores by the smaller id.

    Null and empty texts have no terms and are not counted as documents.  Rows without an id count in the statistics but are
    no results, items without an id or without terms have none; rows that repeat an item's id are one item with all their
    terms.  Repeated document rows count one by one.  An empty table gives no rows.  Other columns are not read.
    """
    index = stored(forward_index(docs, id_col, text_col).where("n > 0"), "forward")
    return search(index, items, k, item_id_col, item_text_col)[0]


def search(index: DataFrame, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """Results of ranked() over a stored forward index, how many pairs of a document and an item the bounds left open, and of how many."""
    n_documents, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = stored(item_terms(items, id_col, text_col), "asked")
    asked = stored(asked.join(weights(index, asked, n_documents), "term"), "asked")
    held = index.where("doc_id is not null")
    first = F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST)) == 0
    n_items, n_asked = asked.agg(F.count_distinct("item_id"), F.count("*")).first()
    blocks = max(1, -(-n_items // ITEMS_AT_ONCE), -(-n_asked // TERMS_AT_ONCE))
    parts, scored = [], 0
    for b in range(blocks if n_documents else 0):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "term", "w").toArrow()  # about TERMS_AT_ONCE rows
        if not rows.num_rows:
            continue
        begun = stored(_searched(held.where(first), Queries.of(rows, {}), k, n_documents, n_terms), "begun")
        head = top_k(begun.where("item_id is not null").drop("visited"), ["item_id"], [F.desc("score"), F.asc("doc_id")], k)
        least = {r.item_id: r.score for r in head.where(F.col("rank") == k).collect()}  # a row for each item of the batch
        rest = stored(_searched(held.where(~first), Queries.of(rows, least), k, n_documents, n_terms), "rest")
        both = union_all(begun, rest)
        scored += both.agg(F.coalesce(F.sum("visited"), F.lit(0))).first()[0]
        parts.append(both.where("item_id is not null").drop("visited"))
    if not parts:
        return index.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long"), 0, 0
    best = top_k(union_all(*parts), ["item_id"], [F.desc("score"), F.asc("doc_id")], k)
    return best.select("item_id", "rank", "doc_id", "score"), scored, n_items * n_documents
