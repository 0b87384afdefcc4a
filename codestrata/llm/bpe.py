"""Byte-level BPE by recursive queries, run in each task by an embedded DuckDB over the rows Spark hands it.

Encoding splits texts into words, takes the distinct words of a batch that are no token themselves as token-position rows,
one per byte, and joins neighbouring tokens with the merge table.  A recursive query contracts each word's leftmost pair of
minimum rank until no pair is left; an ordered aggregation gives the ids of a word, and the words of a text give its ids.
Decoding joins token-position rows with the vocabulary and aggregates their bytes in order.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Batches, documents, kept, slices

#: Bytes of words encoded by one query, tokens decoded by one query, texts split at once, words a worker keeps, and bytes up to
#: which a word takes part in the query.  A word needs as many rounds as merges, and every round reads all its rows, so that work
#: grows with the square of its length; from about 64 bytes on a heap of its pairs is faster, and words are rarely that long.
BYTES_AT_ONCE, TOKENS_AT_ONCE, TEXTS_AT_ONCE, KEPT, LONG = 1 << 18, 400_000, 1200, 250_000, 64
#: Embedded databases hold one query's rows and a table of the file; they don't spill.
DUCK = {"threads": 1, "memory_limit": "300MB", "temp_directory": ""}
#: White space as Unicode has it.
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts without characters from here on are split by the faster engine, whose classes are spelled out below that.
NARROW = 0x250

CONTRACT = """
with recursive step(word, pos, tok, done) as (
  select word, pos, tok, false from start
  union all
  select word, pos, tok, done from (
    with pairs as (
      select word, pos, tok, lead(tok) over w as next_tok, lead(pos) over w as next_pos from step where not done
      window w as (partition by word order by pos)),
    best as (
      select pairs.word, min((merges.merged << 32) | (pairs.pos << 16) | pairs.next_pos) as pair
      from pairs join merges on merges.pair = (pairs.tok << 32) | pairs.next_tok group by pairs.word)
    select pairs.word, pairs.pos, case when pairs.pos = (best.pair >> 16) & 65535 then best.pair >> 32 else pairs.tok end as tok,
           best.pair is null as done
    from pairs left join best on best.word = pairs.word where best.pair is null or pairs.pos <> best.pair & 65535))
select word, list(tok order by pos) as ids from step where done group by word"""

DECODE = """
select tokens.doc, string_agg(vocabulary.hex, '' order by tokens.pos) as hex
from tokens join vocabulary on vocabulary.id = tokens.id group by tokens.doc"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def narrow_members(kind: str) -> str:
    """The narrow characters whose category starts with `kind`, as ranges of a character class."""
    inside = [unicodedata.category(chr(i))[0] == kind for i in range(NARROW)] + [False]
    starts = [i for i in range(NARROW) if inside[i] and not (i and inside[i - 1])]
    return "".join(f"\\u{i:04x}-\\u{inside.index(False, i) - 1:04x}" for i in starts)


class Splitter:
    """Words of a text by a pattern with Unicode classes."""

    def __init__(self, pattern: str) -> None:
        pattern = pattern.replace(r"[^\s", f"[^{BLANKS}").replace(r"\S", f"[^{BLANKS}]").replace(r"\s", f"[{BLANKS}]")
        self.wide = regex.compile(pattern).findall
        self.beyond = re.compile(f"[^\\u0000-\\u{NARROW - 1:04x}]").search
        letters, numbers = narrow_members("L"), narrow_members("N")
        narrow = pattern.replace(r"\p{L}\p{N}]", f"{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
        self.narrow = re.compile(narrow).findall if r"\p" not in narrow else self.wide

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self.wide(text) if self.beyond(text) else self.narrow(text)


class Encoder:
    """Merge table and words of one worker."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.split = Splitter(pattern)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.tokens = {self._text(t): np.array([r], "<u4").tobytes() for t, r in self.ranks.items() if self._text(t) is not None}
        self.known = dict(self.tokens)
        self.duck = duckdb.connect(config=DUCK)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        pair = np.array([a << 32 | b for a, b, _ in pairs], np.int64)
        self.duck.register("given", pa.table({"pair": pair, "merged": np.array([r for *_, r in pairs], np.int64)}))
        self.duck.execute("create table merges as select * from given")

    @staticmethod
    def _text(token: bytes) -> str | None:
        try:
            return token.decode()
        except UnicodeDecodeError:
            return None

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, each by the recursive query; words of like length, which need like numbers of rounds, go together."""
        out = [b""] * len(words)
        short = sorted((i for i, w in enumerate(words) if len(w) <= LONG), key=lambda i: len(words[i]))
        cuts_at = np.flatnonzero(np.diff(np.cumsum([0, *(len(words[i]) for i in short)]) // BYTES_AT_ONCE)) + 1
        for part in filter(None, (short[a:b] for a, b in zip([0, *cuts_at.tolist()], [*cuts_at.tolist(), len(short)], strict=True))):
            sizes = np.array([len(words[i]) for i in part], np.int64)
            ends = np.cumsum(sizes)
            start = pa.table({"word": np.repeat(np.array(part, np.int64), sizes), "pos": np.arange(ends[-1]) - np.repeat(ends - sizes, sizes),
                              "tok": self.bytes[np.frombuffer(b"".join(words[i] for i in part), np.uint8)]})
            self.duck.register("start", start)
            got = self.duck.sql(CONTRACT).to_arrow_table().combine_chunks()
            self.duck.unregister("start")
            ids = got.column("ids").chunk(0) if got.num_rows else None
            data = ids.flatten().to_numpy().astype("<u4").tobytes() if got.num_rows else b""
            cuts = (ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()) * 4 if got.num_rows else []
            for n, word in enumerate(got.column("word").to_pylist()):
                out[word] = data[cuts[n]:cuts[n + 1]]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._long(w)
        return out

    def _long(self, word: bytes) -> bytes:
        """The same contraction over a heap of pairs (rank, place)."""
        token: list[bytes | None] = [word[i:i + 1] for i in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        rank_of = lambda i: self.ranks.get(token[i] + token[after[i]]) if after[i] < len(word) else None
        heap = [(r, i) for i in range(len(word)) if (r := rank_of(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if token[i] is None or rank_of(i) != rank:
                continue
            j = after[i]
            token[i] += token[j]
            token[j], after[i] = None, after[j]
            if after[i] < len(word):
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (r := rank_of(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return np.array([self.ranks[t] for t in token if t is not None], "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts, as little-endian unsigned 32-bit integers."""
        out = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            words = [self.split(t) for t in texts[at:at + TEXTS_AT_ONCE]]
            new = list(set().union(*words) - self.known.keys())
            if len(self.known) + len(new) > KEPT:
                self.known = dict(self.tokens)
                new = list(set().union(*words) - self.known.keys())
            self.known.update(zip(new, self.contract([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
            out += [b"".join(map(self.known.__getitem__, w)) for w in words]
        return out



class Decoder:
    """Vocabulary of one worker."""

    def __init__(self, path: str) -> None:
        ranks = read_ranks(path)
        self.duck = duckdb.connect(config=DUCK)
        self.duck.register("given", pa.table({"id": np.array(list(ranks.values()), np.int64), "hex": pa.array([t.hex() for t in ranks])}))
        self.duck.execute("create table vocabulary as select * from given")

    def decode(self, ids: list[bytes]) -> Iterator[bytes]:
        """Bytes of id sequences, by ordered aggregation."""
        at = 0
        while at < len(ids):
            stop, size = at, 0
            while stop < len(ids) and (size == 0 or size + len(ids[stop]) // 4 <= TOKENS_AT_ONCE):
                size += len(ids[stop]) // 4
                stop += 1
            sizes = np.array([len(x) // 4 for x in ids[at:stop]], np.int64)
            out = [b""] * len(sizes)
            if size:
                tokens = pa.table({"doc": np.repeat(np.arange(len(sizes)), sizes), "pos": np.arange(size), "id": np.frombuffer(b"".join(ids[at:stop]), "<u4").astype(np.int64)})
                self.duck.register("tokens", tokens)
                got = self.duck.sql(DECODE).to_arrow_table()
                self.duck.unregister("tokens")
                for doc, text in zip(got.column("doc").to_pylist(), got.column("hex").to_pylist(), strict=True):
                    out[doc] = bytes.fromhex(text)
            yield from out
            at = stop


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of every row; null and empty texts have no ids.

    Texts are encoded whole, special tokens as ordinary text.  Repeated rows are repeated.  Other columns aren't read.
    """

    def run(batches: Batches) -> Batches:
        for batch in slices(batches, TEXTS_AT_ONCE):
            codec = kept(("encoder", path, pattern), lambda: Encoder(path, pattern))
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec.encode(texts), pa.binary())], ["doc_id", "ids"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded (the bytes the ids stand for) of every row of encode()'s form; null ids give null."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches, TEXTS_AT_ONCE):
            codec = kept(("decoder", path), lambda: Decoder(path))
            ids = batch.column(1).to_pylist()
            text = [t if i is not None else None for i, t in zip(ids, codec.decode([i or b"" for i in ids]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
