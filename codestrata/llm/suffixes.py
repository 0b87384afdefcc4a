"""Repeated byte strings, found by bucket refinement over suffixes.

A suffix here is a document from some byte on, as far as `length` bytes.  The suffixes that need one bucket are told from
their content: each window of `length` bytes is led by its least q-gram (by a hash, leftmost on ties), so equal windows
are led by equal q-grams at equal offsets.  That q-gram is the initial bucket.  Pass one finds, by a Bloom filter, which
buckets may hold more than one lead; only those are shuffled.  Within a bucket, windows are refined by sorting on the
bucket identifiers of later offsets, piece after piece; identifiers that a round has made are the next round's buckets,
and windows that are alone in a bucket drop out.  What is left in one bucket after the last piece is equal, and all but
its earliest window start earlier elsewhere.

Hashes are 64 bits, and windows that count as equal agree in two independent ones: the lead's and the pieces'.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import Batches, documents, slices, stored
from .exact_dedup import LEAST_BITS, _positions, repeated_filter

#: Length of the strings and of the leading q-gram; bytes that are hashed together; bits of the filter for a
#: lead, and at most: beyond
#: them more leads are shuffled, and the result stays the same.
LENGTH, GRAM, GROUP, BITS_PER_LEAD, MOST_BITS = 100, 40, 1 << 20, 6, 1 << 30
#: Leads of a bucket from which its windows are dealt one by one, by their own hash, and leads a task has to see at once to
#: count one.  Only the balance of the work depends on them.
HOT, OFTEN = 8192, 128
PIECES = 4  # of a window
NO_ID = (1 << 63) - 1  # documents without an id come last, as one
_PLACE = 26  # bits of a place in a group


def _constants(name: str) -> tuple[np.ndarray, int]:
    """An odd number for every byte, and an odd base."""
    draw = np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))
    return draw.integers(1 << 62, size=256).astype(np.uint64) * np.uint64(2) + np.uint64(1), int(draw.integers(1 << 62)) * 2 + 1


class Rolling:
    """Hashes of substrings, by sums over powers of a base: equal strings have equal hashes wherever they stand."""

    def __init__(self, name: str) -> None:
        self.values, self.base = _constants(name)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if n > len(self.powers):
            size = max(n, 2 * GROUP)
            power = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
            self.powers, self.inverses = power(np.uint64(self.base)), power(np.uint64(pow(self.base, -1, 1 << 64)))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self.values[data] * self.inverses[:n - 1], out=self.sums[1:])

    def between(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.powers[start]

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.powers[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _groups(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts side by side, about GROUP bytes at a time: bytes, and of every part its text, place there and place here.

    Longer texts come in parts that share length - 1 bytes, so that every window lies in exactly one part.
    """
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, GROUP):
            part = text[at:at + GROUP + length - 1]
            held.append((row, at, part))
            size += len(part)
            if size >= GROUP:
                yield _side_by_side(held)
                held, size = [], 0
    if held:
        yield _side_by_side(held)


def _side_by_side(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for *_, p in held], np.int64)
    return (np.frombuffer(b"".join(p for *_, p in held), np.uint8), np.array([r for r, *_ in held], np.int64),
            np.array([a for _, a, _ in held], np.int64), np.concatenate([[0], np.cumsum(sizes)]))


def _leads(hashes: np.ndarray, cuts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leads of all windows: place, first window, number of windows, and part.  Windows that one q-gram leads are neighbours."""
    key = (_mix(hashes) >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(hashes), dtype=np.uint64)
    reach, width = 1, length - gram + 1
    while reach < width:  # minimum over `width` neighbours, by doubling
        step = min(reach, width - reach)
        key = np.minimum(key[:-step], key[step:])
        reach += step
    place = (key & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    sizes = np.diff(cuts)
    part = np.repeat(np.arange(len(sizes)), sizes)[:len(place)]
    inside = np.arange(len(place)) <= (cuts[1:] - length)[part]
    windows, place = np.flatnonzero(inside), place[inside]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (part[windows[1:]] != part[windows[:-1]])]))
    return place[first], windows[first], np.diff(np.append(first, len(windows))), part[windows[first]]


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def lead_hashes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The q-gram hash of every lead."""

    def run(batches: Batches) -> Batches:
        rolling = Rolling("lead")
        for batch in slices(batches):
            for data, _, _, cuts in _groups(_bytes(batch.column(0)), length):
                rolling.load(data)
                hashes = rolling.grams(gram)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[_leads(hashes, cuts, length, gram)[0]].view(np.int64))], ["lead"])

    return docs.select("text").mapInArrow(run, "lead long")


ROWS = "key long, doc long, start long, lead_at int, windows int, body binary"


def _row_batch(key, doc, start, lead_at, windows, body) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(lead_at, pa.int32()),
                                       pa.array(windows, pa.int32()), pa.array(body, pa.binary())], [c.split()[0] for c in ROWS.split(", ")])


def _bucket_rows(plane, bits: int, hot: np.ndarray, length: int, gram: int):
    """Leads that may not be alone, each with the bytes of its windows; of a hot bucket, its windows by their own hash.

    Of equal runs of windows in a group only the earliest is sent on; the others are decided and come as rows without body.
    """

    def run(batches: Batches) -> Batches:
        lead, body, value = Rolling("lead"), Rolling("body"), plane.value
        for batch in slices(batches):
            ids = np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            for data, rows, places, cuts in _groups(_bytes(batch.column(1)), length):
                lead.load(data)
                hashes = lead.grams(gram)
                place, first, count, part = _leads(hashes, cuts, length, gram)
                at = _positions(hashes[place], bits)
                keep = ((value[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)
                place, first, count, part = place[keep], first[keep], count[keep], part[keep]
                key = hashes[place].view(np.int64)
                burning = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
                body.load(data)
                text = data.tobytes()
                if burning.any():  # one row a window
                    n = count[burning]
                    window = np.repeat(first[burning], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    own = np.repeat(part[burning], n)
                    whole = body.between(window, window + length)
                    yield from _sent(_mix(whole ^ lead.between(window, window + length)).view(np.int64), whole, ids[rows[own]], places[own] + window - cuts[own],
                                     np.zeros(len(window), np.int64), np.ones(len(window), np.int64), whole.astype("<u8").tobytes(), np.arange(len(window)) * 8, np.full(len(window), 8), length)
                calm = ~burning
                place, first, count, part, key = place[calm], first[calm], count[calm], part[calm], key[calm]
                size = count + length - 1
                same = _mix(body.between(first, first + size) ^ _mix((place - first).astype(np.uint64) * np.uint64(4096) + count.astype(np.uint64)))
                yield from _sent(key, same, ids[rows[part]], places[part] + first - cuts[part], place - first, count, text, first, size, length)

    return run


def _sent(key, same, doc, start, lead_at, count, text: bytes, at, size, length: int) -> Batches:
    if not len(key):
        return
    order = np.lexsort((start, doc, same, key.view(np.uint64)))
    key, same, doc, start, lead_at, count, at, size = (x[order] for x in (key, same, doc, start, lead_at, count, at, size))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (same[1:] != same[:-1])])
    least = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc != doc[least]) | (start != start[least])
    yield _row_batch(key[new], doc[new], start[new], lead_at[new], count[new], [text[a:a + n] for a, n in zip(at[new].tolist(), size[new].tolist(), strict=True)])
    yield from _decided(doc[later], start[later], start[later] + count[later] + length - 1)


def _decided(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Batches:
    """Runs to remove, joined where they meet, as rows without body: start and lead_at (the run's length)."""
    if not len(doc):
        return
    order = np.lexsort((stop, start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    group = np.cumsum(np.concatenate([[False], doc[1:] != doc[:-1]]))
    far = np.maximum.accumulate(stop + group * np.int64(1 << 40)) - group * np.int64(1 << 40)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > far[:-1])])
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    doc, start, run = doc[new], start[new], far[last] - start[new]
    yield _row_batch(_mix(doc.view(np.uint64)).view(np.int64), doc, start, np.minimum(run, (1 << 31) - 1), np.zeros(len(doc), np.int32), [None] * len(doc))


def _refined(bucket: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Bucket numbers of windows after sorting by (bucket, identifier of a later piece); equal pairs share a number."""
    pair = _mix(pieces.astype(np.int64).view(np.uint64) + _mix(bucket.view(np.uint64) + np.uint64(1)))  # one number for both
    order = np.argsort(pair)
    pair = pair[order]
    out = np.empty(len(bucket), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], pair[1:] != pair[:-1]]))
    return out


def _repeats(length: int):
    """Runs of windows that start earlier elsewhere, of rows sorted by key: whole buckets at a time."""

    def decide(rows: pa.Table, rolling: Rolling) -> Batches:
        key, doc, start, lead_at, count = (rows.column(i).to_numpy() for i in range(5))
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        bucket = np.cumsum(starts) - 1
        shared = np.bincount(bucket)[bucket] > 1
        rows = rows.filter(pa.array(shared))
        if not rows.num_rows:
            return
        key, doc, start, lead_at, count, bucket = (x[shared] for x in (key, doc, start, lead_at, count, bucket))
        body = pa.concat_arrays(rows.column(5).chunks)
        offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset:body.offset + len(body) + 1].astype(np.int64)
        data = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        n = count.astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = offsets[:-1][row] + step
        given = np.diff(offsets)[row] == 8  # rows of hot buckets come with the hash of their one window
        rolling.load(data)
        # windows of a bucket compare only where their lead stands at the same offset
        alive = np.arange(len(row))
        now = _refined(bucket[row], lead_at[row].astype(np.int64) - step)
        for i in range(PIECES):
            several = np.bincount(now)[now] > 1
            alive, now = alive[several], now[several]
            if not len(alive):
                return
            where = at[alive]
            one = given[alive]
            a = where + np.where(one, 0, i * length // PIECES)
            b = where + np.where(one, 8, (i + 1) * length // PIECES)
            now = _refined(now, rolling.between(a, b).view(np.int64))
        doc, place = doc[row[alive]], start[row[alive]] + step[alive]
        order = np.argsort(now)
        now, doc, place = now[order], doc[order], place[order]
        new = np.concatenate([[True], now[1:] != now[:-1]])
        group, firsts = np.cumsum(new) - 1, np.flatnonzero(new)
        low = np.minimum.reduceat(doc, firsts)[group]
        later = (doc != low) | (place != np.minimum.reduceat(np.where(doc == low, place, NO_ID), firsts)[group])
        yield from _decided(doc[later], place[later], place[later] + length)

    def run(batches: Batches) -> Batches:
        rolling, held = Rolling("body"), []
        for batch in batches:
            none = batch.column(5).is_null()
            if none.true_count:
                yield batch.filter(none)
                batch = batch.filter(pc.invert(none))
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:  # the last bucket may go on in the next batch
                yield from decide(pa.Table.from_batches([*held, batch.slice(0, last)]), rolling)
                held = [batch.slice(last)]
            else:
                if held and held[-1].column(0)[0].as_py() != int(key[0]):
                    yield from decide(pa.Table.from_batches(held), rolling)
                    held = []
                held.append(batch)
        if held:
            yield from decide(pa.Table.from_batches(held), rolling)

    return run


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_bits: int = MOST_BITS, hot: int = HOT) -> DataFrame:
    """doc, start, stop: runs of bytes covered by strings of `length` bytes that also start earlier; runs may overlap.

    `docs`: doc_id, text.  Earlier is a smaller id, or the same and an earlier start; rows that share an id count as one
    document.
    """
    leads = lead_hashes(docs, length, gram)
    bytes_in_all = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    about = 2 * bytes_in_all // (length - gram + 2)  # leads of that much text
    bits = int(min(most_bits, max(LEAST_BITS, about * BITS_PER_LEAD)))
    twice, frequent = repeated_filter(leads, bits, min(OFTEN, hot), hot)
    plane = docs.sparkSession.sparkContext.broadcast(twice)  # most_bits at most
    rows = docs.mapInArrow(_bucket_rows(plane, bits, frequent, length, gram), ROWS)
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_repeats(length), ROWS)
    return found.select("doc", "start", (F.col("start") + F.col("lead_at")).alias("stop"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_bytes, spans (start, stop of every maximal removed run) and kept (the remaining bytes) of every row.

    Null and empty texts have no bytes.  Of repeated rows with one id none is earlier than the other; with different ids,
    all but the smallest id lose every string they share.  Rows without an id count as one document after all others.
    Texts shorter than `length` stay as they are.  Other columns aren't read.
    """
    rows = documents(docs, id_col, text_col)
    runs = repeated_runs(rows, length, most_bits=most_bits)
    lists = stored(runs.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("runs")), "runs")  # bounded by a text's length

    def run(batches: Batches) -> Batches:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in slices(batches):
            sizes, spans, kept = [], [], []
            for text, found in zip(_bytes(batch.column(1)), batch.column(2), strict=True):
                sizes.append(len(text))
                if not found.is_valid:
                    spans.append([])
                    kept.append(text)
                    continue
                start, stop = (found.values.field(i).to_numpy() for i in (0, 1))
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, np.minimum(stop, len(text)), -1)
                out = np.cumsum(edge[:-1]) > 0
                change = np.diff(np.concatenate([[False], out, [False]]).astype(np.int8))
                spans.append([{"start": a, "stop": b} for a, b in zip(np.flatnonzero(change > 0).tolist(), np.flatnonzero(change < 0).tolist(), strict=True)])
                kept.append(np.frombuffer(text, np.uint8)[~out].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                                             ["doc_id", "n_bytes", "spans", "kept"])

    joined = rows.join(lists, F.coalesce(F.col("doc_id"), F.lit(NO_ID)) == F.col("doc"), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")
