"""Best-fit packing of token sequences, hierarchically.

Every task packs its own pieces best-fit, longest first.  Bins that are nearly full are final.  The others go up a tree as
items: groups of tasks pack the underfull bins they got best-fit again, emit what is nearly full, and pass on the rest,
until one group is left.  A group takes a bounded number of bins, so no task ever sees all of them at scale.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from .bpe import narrow_members
from .common import Batches, documents, slices, stored

#: Tokens of a sequence, end mark, free tokens a final bin may have, groups that meet at the next level, underfull bins
#: a group takes at most on average, distinct words a task keeps.
LENGTH, END, SLACK, FAN_IN, GROUP, CACHE = 2048, 0, 8, 8, 500_000, 400_000


class Words:
    """Token ids of texts, as little-endian unsigned 32-bit integers.

    The tokenizer lower-cases, splits at white space and between letters, digits and signs, and merges within such words.
    Texts of Latin-1 characters are split here by the same pattern (nothing composes or lower-cases beyond one character
    in them), so each distinct word goes through the merges once as long as it is kept.  Other texts, and those that may
    hold special tokens, go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.path, self.tokenizer, self.merges = path, None, Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters, numbers, blanks = narrow_members("L"), narrow_members("N"), r"\t-\r \x85\xa0"
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blanks}{letters}{numbers}]+").findall
        self.beyond = re.compile(r"[^\x00-\xff]").search
        self.known: dict[str, bytes] = {}

    def _merged(self, tokenizer: Tokenizer, texts: list[str]) -> list[bytes]:
        return [array("I", got.ids).tobytes() for got in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for at in range(0, len(texts), 1024):
            some = [t or "" for t in texts[at:at + 1024]]
            odd = [i for i, t in enumerate(some) if "<|" in t or not t.isascii() and self.beyond(t)]
            if odd and self.tokenizer is None:
                self.tokenizer = Tokenizer.from_file(self.path)
            whole = dict(zip(odd, self._merged(self.tokenizer, [some[i] for i in odd]), strict=True)) if odd else {}
            words = [[] if i in whole else self.split(t.lower()) for i, t in enumerate(some)]
            if len(self.known) > CACHE:
                self.known = {}
            new = list(set().union(*words) - self.known.keys())
            self.known.update(zip(new, self._merged(self.merges, new), strict=True))
            for i, found in enumerate(words):
                yield whole[i] if i in whole else b"".join(map(self.known.__getitem__, found))


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and place of every item, and the fill of every bin; longest first, each into the fullest bin that has room.

    Bins are kept by free room; a bit set of the rooms in use finds the least that suffices at once.
    """
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms, fills = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        able = rooms >> size
        if able:
            room = size + (able & -able).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = length, len(fills)
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += size
        room -= size
        if room:
            if not by_room[room]:
                rooms |= 1 << room
            by_room[room].append(b)
    return bins, places, fills


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill int"


def _pieces(path: str, length: int, end: int):
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Batches) -> Batches:
        words, base = Words(path), TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        for batch in slices(batches, 1024):
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            rows, piece, start, size, crc = [], [], [], [], []
            for r, data in enumerate(words.encode(texts)):
                data += mark
                for n, at in enumerate(range(0, len(data), 4 * length)):
                    part = data[at:at + 4 * length]
                    rows.append(r)
                    piece.append(n)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            held.append((ids.take(pa.array(rows, pa.int64())), np.array(piece, np.int32), np.array(start, np.int64), np.array(size, np.int64), np.array(crc, np.int64)))
        if not held:
            return
        columns = [np.concatenate([h[i] for h in held]) for i in range(1, 5)]
        bins, places, fills = best_fit(columns[2], length)
        fill = np.array(fills, np.int32)[bins]
        ids = pa.concat_arrays([h[0] for h in held])
        for at in range(0, len(ids), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([ids[cut], *(pa.array(c[cut]) for c in columns), pa.array(base + bins[cut]), pa.array(places[cut]), pa.array(fill[cut])],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "fill"])

    return run


def _merge(level: int, length: int):
    def run(batches: Batches) -> Batches:
        def done(group: int, bins: np.ndarray, fills: np.ndarray) -> pa.RecordBatch:
            parents, places, full = best_fit(fills.astype(np.int64), length)
            return pa.RecordBatch.from_arrays([pa.array(bins), pa.array((level << 56) + (group << 28) + parents), pa.array(places), pa.array(np.array(full, np.int32)[parents])],
                                              ["bin", "parent", "shift", "fill"])

        now, held = None, []
        for batch in batches:
            groups, bins, fills = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero(np.diff(groups)) + 1
            for g, b, f in zip(np.split(groups, cuts), np.split(bins, cuts), np.split(fills, cuts), strict=True):
                if len(g) and g[0] != now:
                    if held:
                        yield done(now, *map(np.concatenate, zip(*held, strict=True)))
                    now, held = int(g[0]), []
                if len(g):
                    held.append((b, f))
        if held:
            yield done(now, *map(np.concatenate, zip(*held, strict=True)))

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and the end mark; null and empty texts are the end mark alone.  Only documents longer than
    a sequence are cut.  Repeated rows are packed one by one.  An empty table gives no rows.  Other columns aren't read.
    """
    pieces = stored(documents(docs, id_col, text_col).mapInArrow(_pieces(path, length, end), PIECES), "pieces")
    # bins and tasks at the first level; the task is the group
    rest = stored(pieces.where(F.col("fill") < length - SLACK).groupBy("bin").agg(F.max("fill").alias("fill")), "bins")
    left, groups, moves = rest.count(), None, None
    for level in range(1, 16):
        tasks = rest.select(F.max(F.shiftright("bin", 32) + 1)).first()[0] or 0 if level == 1 else groups
        groups = max(-(-tasks // FAN_IN), -(-left // GROUP))
        if not left or level > 1 and groups >= tasks:
            break
        group = F.shiftright("bin", 32) if level == 1 else F.shiftright("bin", 28).bitwiseAND((1 << 28) - 1)
        dealt = rest.select((F.floor(group * groups / tasks) if groups > 1 else F.lit(0)).cast("long").alias("group"), "bin", "fill")
        made = stored(dealt.repartition("group").sortWithinPartitions("group", F.desc("fill"), "bin")
                      .mapInArrow(_merge(level, length), "bin long, parent long, shift long, fill int"), "bins")
        moves = made.select("bin", "parent", "shift") if moves is None else _follow(moves, made)
        rest = made.where(F.col("fill") < length - SLACK).groupBy("parent").agg(F.max("fill").alias("fill")).withColumnRenamed("parent", "bin")
        left = rest.count()
        if groups == 1:
            break
    if moves is None:
        moves = rest.select("bin", F.col("bin").alias("parent"), F.lit(0).cast("long").alias("shift"))
    placed = pieces.join(moves, "bin", "left")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("parent", "bin").alias("sequence_id"),
                         (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))


def _follow(moves: DataFrame, made: DataFrame) -> DataFrame:
    """First-level bins to the parents of this level, where their bin went up again."""
    up = made.select(F.col("bin").alias("parent"), F.col("parent").alias("next"), F.col("shift").alias("more"))
    return stored(moves.join(up, "parent", "left").select(
        "bin", F.coalesce("next", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), "moves")
