"""Words of whole columns of texts, as hashes and places, without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once.
CHUNK = 1 << 20
#: ASCII letters and digits, and every byte of a character beyond ASCII.
INSIDE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)  # A to Z only

_DRAWN = np.random.default_rng(5).integers(1 << 64, size=257, dtype=np.uint64)
_LETTER, _STEP = _DRAWN[:256], _DRAWN[256] | np.uint64(1)
_powers = np.ones(1, np.uint64)


def _steps(n: int) -> np.ndarray:
    """The first `n` powers of _STEP modulo 2^64."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 10), _STEP)]), dtype=np.uint64)
    return _powers[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of several texts in order: hash, first byte and end of each in `data`, and where each text's words begin (one more at the end)."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    bounds: np.ndarray

    def joined(self, first: int, last: int) -> str:
        """The words from `first` up to `last`, lower-cased, with a space between them."""
        return " ".join(LOWER[self.data[a:b]].tobytes().decode("utf-8", "replace") for a, b in zip(self.starts[first:last].tolist(), self.stops[first:last].tolist(), strict=True))


def _hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Of words in order: sums of a number drawn for each lower-case byte times a power for its place, spread."""
    sizes = stops - starts
    out = np.zeros(len(starts), np.uint64)
    done = 0
    ends = np.cumsum(sizes)
    while done < len(starts):  # some CHUNK bytes of words, one word at least
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + CHUNK, side="right")))
        own, first = sizes[done:upto], starts[done:upto]
        begins = np.cumsum(own) - own
        place = np.arange(int(own.sum())) - np.repeat(begins, own)
        letters = _LETTER[LOWER[data[place + np.repeat(first, own)]]]
        out[done:upto] = np.add.reduceat(letters * _steps(int(own.max()))[place], begins)
        done = upto
    return mixed(out)


def words(texts: pa.Array) -> Words:
    """Words of a column of texts: runs of ASCII letters, digits and characters beyond ASCII; A to Z count as a to z.  Null has none."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if texts.null_count:  # what lies below a null is not defined
        texts = texts.fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    ends = offsets - first
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, np.zeros(0, np.uint64), none, none, np.zeros(len(ends), np.int64))
    inside = INSIDE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = ends[(ends > 0) & (ends < len(data))]
    opens[edges] = inside[edges]  # a text's first byte opens a word, its last one closes one
    closes[edges - 1] = inside[edges - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, _hashes(data, starts, stops), starts, stops, np.searchsorted(starts, ends))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of `n` words, in order; fewer words give none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    count = len(hashes) - n + 1
    out = hashes[:count]
    for i in range(1, n):
        out = mixed(out) + hashes[i:i + count]
    return mixed(out)


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """Row i holds values from bounds[i] up to bounds[i + 1]."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
