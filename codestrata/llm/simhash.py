"""Near duplicates by SimHash fingerprints, linked through anchor points of a covering code.

A link is three differing bits or fewer, so at least one half of the 64 bits differs in one bit at most.  Each half is
covered by the code {Hamming [31, 26] codeword, any last bit}: every half lies within radius 1 of exactly one anchor (its
home).  Of two halves one bit apart, each lies within radius 1 + threshold 1 of the other's home.  So fingerprints are
replicated to every anchor within that distance (at most 17 a half), and compared where one of them is at home.  An
anchor is 27 bits, the halves are kept apart by one more.

Near copies by five-word similarity meet at other anchors: BANDS groups of BAND least hashes of their shingles.  What hangs
together by what meets there is compared by the shingles themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import cut, union_all
from .common import Batches, documents, slices, stored

BITS = 3
#: For near copies: words of a shingle, the least similarity of two texts' shingles, and the number of their least hashes.
NEAR_WORDS, SIMILARITY, SKETCH = 5, 0.8, 256
#: Anchors of a text, and least hashes that make one: at similarity 0.8 all differ for 4 pairs in 10 million.  Deviations
#: that the bits of SKETCH may be off before a pair is left unchecked.
BANDS, BAND, DEVIATIONS = 28, 4, 6
#: Members and shingles of a family that are compared in one task, and shingles of a product of their matrices.
CELL, CELL_SHINGLES, COLUMNS = 2048, 1 << 22, 4096
WORDS = 3
SEED = 42
#: Rows above which an anchor is dealt in blocks of homes and blocks of all its rows, a task for two of them.
BLOCK = 4096
PAIRS_AT_ONCE = 1 << 20


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII only, both


def _majority(hashes: np.ndarray) -> int:
    """The number whose bit i is 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of a text: bit i is 1 if set in over half of the shingles' hashes; 0 without words."""
    tokens = _tokens(text)
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    hash_of = xxhash.xxh64_intdigest
    stops = ends[words - 1:] if len(tokens) >= words else ends[-1:]
    hashes = np.fromiter((hash_of(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)), "<u8", n)
    return _majority(hashes)


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Other hashes of the same things."""
    x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (turn + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_DRAW = np.random.default_rng(11).integers(1 << 32, size=(2, SKETCH), dtype=np.uint32) | np.array([[1], [0]], np.uint32)


def _least(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of SKETCH permutations: two texts agree in one for every share of shingles they share."""
    x = np.unique((hashes ^ (hashes >> np.uint64(32))).astype(np.uint32))
    least = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1 << 10):
        least = np.minimum(least, (x[at:at + (1 << 10), None] * _DRAW[0] + _DRAW[1]).min(axis=0))
    return least


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of NEAR_WORDS words, in order; a shorter text is one shingle, a text without words none."""
    tokens = _tokens(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    alone = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(tokens)}
    words = np.fromiter(map(alone.__getitem__, tokens), "<u8", len(tokens))
    wide = words[:len(tokens) - NEAR_WORDS + 1] if len(tokens) >= NEAR_WORDS else words[:1]
    for i in range(1, min(NEAR_WORDS, len(tokens))):
        wide = _mixed(wide, i) + words[i:i + len(wide)]
    return np.unique(_mixed(wide, NEAR_WORDS))


def signature(text: str | None) -> tuple[int, bytes, list[int]] | None:
    """A hash of the set of shingles, their sketch (a bit of each least hash) and anchors; None without words."""
    found = shingles(text)
    if not len(found):
        return None
    least = _least(found)
    bits = np.packbits((np.bitwise_count(least * np.uint32(0x9E3779B1) & np.uint32(0xFFFF0000)) & 1).astype(bool)).tobytes()
    bands = [xxhash.xxh64_intdigest(least[i * BAND:(i + 1) * BAND].tobytes(), i) for i in range(BANDS)]
    return xxhash.xxh64_intdigest(found.tobytes(), SEED), bits, bands


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and the fingerprint as a long."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            values = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


# syndromes of all values of 16 bits: the xor of the positions (from 1) of set bits
_LOW = np.zeros(1 << 16, np.uint8)
for _bit in range(16):
    _LOW[1 << _bit:2 << _bit] = _LOW[:1 << _bit] ^ (_bit + 1)


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Of the lower 31 bits."""
    high = (half >> np.uint32(16)) & np.uint32(0x7FFF)
    parity = np.bitwise_count(high).astype(np.uint8) & 1
    return _LOW[half & np.uint32(0xFFFF)] ^ _LOW[high] ^ (parity << 4)


def _flip(position: np.ndarray) -> np.ndarray:
    """The mask of a position from 1; 0 for position 0."""
    return np.where(position > 0, np.uint32(1) << (np.maximum(position, 1) - 1).astype(np.uint32), np.uint32(0)).astype(np.uint32)


def home(half: np.ndarray) -> np.ndarray:
    """The anchor within radius 1."""
    return half ^ _flip(_syndrome(half))


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the fingerprint and anchor, for every anchor within 2 (the last bit counts too), the home first."""
    syndrome = _syndrome(half).astype(np.int64)
    own = home(half)
    index, found = [np.arange(len(half)), np.arange(len(half))], [own, own ^ np.uint32(1 << 31)]
    for a in range(1, 32):
        b = a ^ syndrome
        use = np.flatnonzero((syndrome > 0) & (b > a))
        index.append(use)
        found.append(half[use] ^ np.uint32(1 << (a - 1)) ^ _flip(b[use]))
    return np.concatenate(index), np.concatenate(found)


def _replicas(batches: Batches) -> Batches:
    """Columns node, check and one or more fingerprints → a row for every anchor within reach of a half of one of them."""
    for batch in batches:
        node, check, signs = batch.column(0), batch.column(1), [c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]
        for at in range(0, len(node), 1 << 14):
            for number, sign in enumerate(signs):
                for side in (0, 1):
                    half = ((sign[at:at + (1 << 14)].view(np.uint64) >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    index, anchor = anchors(half)
                    use = pa.array(index + at)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64) | ((2 * number + side) << 32)), node.take(use), check.take(use),
                                                      pa.array(np.arange(len(index)) < len(half))], ["anchor", "node", "check", "home"])


class _Forest:
    """Union by smallest index, over one anchor's fingerprints."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of checks, rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _compare(nodes: np.ndarray, checks: np.ndarray, is_home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one anchor, reduced to a spanning forest: n fingerprints give fewer than n links."""
    homes, forest, a, b = np.flatnonzero(is_home), _Forest(len(nodes)), [], []
    step = max(1, PAIRS_AT_ONCE // len(nodes) // checks.shape[1])
    for at in range(0, len(homes), step):
        rows = homes[at:at + step]
        left, right = np.nonzero(_apart(checks[rows][:, None, :], checks[None, :, :]) <= bits)
        left = rows[left]
        for x, y in zip(left[left != right].tolist(), right[left != right].tolist(), strict=True):
            if forest.join(x, y):
                a.append(x)
                b.append(y)
        if len(a) == len(nodes) - 1:  # all are linked
            break
    return nodes[a], nodes[b]


def _words(column: pa.Array) -> np.ndarray:
    """Checks of one length as rows of 64-bit words."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, "<u8").reshape(len(column), -1)


def _links(bits: int):
    """Columns anchor, node, check, home, sorted by anchor → links of each anchor."""

    def emit(keys: np.ndarray, nodes: np.ndarray, homes: np.ndarray, checks: np.ndarray):
        """keys sorted; whole anchors."""
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        useful = (sizes > 1) & (np.add.reduceat(homes.astype(np.int64), starts) > 0)
        first = starts[useful & (sizes == 2)]
        first = first[_apart(checks[first], checks[first + 1]) <= bits]
        a, b = [nodes[first]], [nodes[first + 1]]
        for start, size in zip(starts[useful & (sizes > 2)].tolist(), sizes[useful & (sizes > 2)].tolist(), strict=True):
            x, y = _compare(*(c[start:start + size] for c in (nodes, checks, homes)), bits)
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches: Batches) -> Batches:
        held: list[list[np.ndarray]] = []  # rows of the last anchor so far, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3)), _words(batch.column(2))]
            if held and held[-1][0][0] != now[0][0]:
                yield emit(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            last = int(np.searchsorted(now[0], now[0][-1]))
            if last:
                yield emit(*map(np.concatenate, zip(*held, [x[:last] for x in now], strict=True)))
                held = []
            held.append([x[last:] for x in now])
        if held:
            yield emit(*map(np.concatenate, zip(*held, strict=True)))

    return run


def dealt(placed: DataFrame, counted: DataFrame, block: int | None = None) -> DataFrame:
    """`placed` with hot anchors (over `block` rows of `counted`: anchor, home) cut into new ones of about 2 x `block` rows.

    Every block of a hot anchor's homes meets every block of its rows in one of the new anchors, so no pair is lost; a row
    comes once for each block of homes, and a home once for each block of rows besides.
    """
    block = block or BLOCK
    hot = (counted.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("n_homes")).where(F.col("n") > block)
           .select("anchor", F.ceil(F.col("n") / block).cast("int").alias("__rows"), F.ceil(F.col("n_homes") / block).cast("int").alias("__homes")))
    hot = stored(hot, "simhash")
    if hot.isEmpty():
        return placed
    own = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    cell = lambda i, j, home: F.struct(F.xxhash64("anchor", i, j).alias("anchor"), F.lit(home).alias("home"))
    as_row = F.transform(F.sequence(F.lit(0), F.col("__homes") - 1), lambda i: cell(i, own(1, "__rows"), False))
    as_home = F.transform(F.sequence(F.lit(0), F.col("__rows") - 1), lambda j: cell(own(2, "__homes"), j, True))
    cells = (F.when(F.col("__rows").isNull(), F.array(F.struct("anchor", "home"))).when(F.col("__homes") == 0, F.expr("filter(array(struct(anchor, home)), e -> false)"))
             .when(F.col("home"), F.concat(as_row, as_home)).otherwise(as_row))
    others = [c for c in placed.columns if c not in ("anchor", "home")]
    met = placed.join(hot, "anchor", "left").select(*others, F.explode(cells).alias("__cell"))
    return met.select(*[F.col(f"__cell.{c}").alias(c) if c in ("anchor", "home") else c for c in placed.columns])


def _met(placed: DataFrame, bits: int) -> DataFrame:
    return placed.repartition("anchor").sortWithinPartitions("anchor", "node").mapInArrow(_links(bits), "a long, b long")


def links(fps: DataFrame, bits: int = BITS, block: int | None = None) -> DataFrame:
    """Links (a, b) that connect what all links connect.  `fps`: node (long), check (binary, one length) and fingerprints (long).

    Two nodes are linked if a half of one of their fingerprints differs in a bit at most, and their checks in `bits` bits or
    fewer.  With the one fingerprint as check, and `bits` of 3 or fewer, the first condition leaves nothing out.
    """
    placed = fps.mapInArrow(_replicas, "anchor long, node long, check binary, home boolean")
    return _met(dealt(placed, placed, block), bits).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that links reach, for nodes with links.

    Rounds of large and small stars: each rewires every node to the smallest node it knows, so a chain's length shrinks
    by a factor a round.  Hubs are aggregated before the shuffle, and joins with them can be split.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    while True:
        both = union_all(edges, edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("low"))
        # stored, so that the join deals both sides anew and can split a hub
        known = cut(low.select(F.col("node").alias("root"), "low"))
        ends = F.array(F.struct("node", F.col("low").alias("root")), F.struct(F.col("root").alias("node"), F.col("low").alias("root")))
        up = edges.join(known, "root").select(F.inline(F.filter(ends, lambda e: e["node"] > e["root"]))).distinct()
        least = up.groupBy("node").agg(F.min("root").alias("low"))
        small = union_all(least.select("node", F.col("low").alias("root")),
                          up.join(least, "node").where("root > low").select(F.col("root").alias("node"), F.col("low").alias("root")))
        new = cut(small.where("node <> root").distinct())
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            return new
        edges = new


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id, the smallest id reachable over links, itself included.

    Null and empty texts have fingerprint zero and link like any other.  Repeated rows are repeated in the result.  Ids
    that are null count as larger than all others.  An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "simhash")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash")
    linked = components(links(distinct.select("fp", F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("check"), F.col("fp").alias("sign")), bits))
    member = union_all(linked.select(F.col("node").alias("fp"), "root"), linked.select(F.col("root").alias("fp"), "root").distinct())
    tied = member.join(distinct, "fp")
    lowest = tied.groupBy("root").agg(F.min("low").alias("component_id"))
    # stored, so that the join deals both sides anew and can split a hot fingerprint
    by_fp = stored(distinct.join(tied.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "fp", "left")
                   .select("fp", F.coalesce("component_id", "low").alias("component_id")), "simhash")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the set of shingles as one hash, their sketch and anchors, the fingerprint; texts without words have none."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            found = [signature(t) for t in texts]
            use = [i for i, f in enumerate(found) if f]
            numbers = np.array([[found[i][0], *found[i][2]] for i in use], np.uint64).reshape(len(use), BANDS + 1).view(np.int64)
            anchors_of = pa.ListArray.from_arrays(pa.array(np.arange(len(use) + 1, dtype=np.int32) * BANDS), pa.array(numbers[:, 1:].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(use, pa.int64())), pa.array(numbers[:, 0]), pa.array([found[i][1] for i in use], pa.binary()), anchors_of,
                                              pa.array(np.array([fingerprint(texts[i]) for i in use], np.uint64).view(np.int64))],
                                             ["doc_id", "node", "sketch", "bands", "fp"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, node long, sketch binary, bands array<long>, fp long")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, shingles (array of long) of documents()."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            found = [shingles(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of the left sets shares with each of the right ones: products of 0-1 matrices, some columns at a time."""
    sizes = np.array([len(x) for x in (*left, *right)])
    values, column, held = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    use = held[column] > 1
    row, column = np.repeat(np.arange(len(sizes)), sizes)[use], (np.cumsum(held > 1) - 1)[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2^24, as sets are cut to cells by their size
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        dense = np.zeros((len(sizes), min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        dense[row[part], column[part] - at] = 1
        out += dense[:len(left)] @ dense[len(left):].T
    return out


def _alike(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which left sets share `similarity` of all their shingles with which right ones, or more."""
    x, y, shared = np.array([len(s) for s in left], float), np.array([len(s) for s in right], float), _shared(left, right)
    return np.stack([row / (n + y - row) >= similarity for n, row in zip(x, shared, strict=True)]) if len(left) else np.zeros((0, len(right)), bool)


def _tree(alike: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    out, waiting = [], np.ones(len(alike), bool)
    for start in range(len(alike)):
        if not waiting[start]:
            continue
        waiting[start], front = False, [start]
        while front:
            node = front.pop()
            new = np.flatnonzero(alike[node] & waiting)
            waiting[new] = False
            out += [(node, other) for other in new.tolist()]
            front += new.tolist()
    return out


def _cell(nodes: np.ndarray, sides: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of one cell that connect what is alike and not known to be connected: of all its members, or of one side with the other."""
    if sides.any():
        order = np.argsort(sides, kind="stable")
        nodes, roots, sets, n = nodes[order], roots[order], [sets[i] for i in order.tolist()], int((sides == 1).sum())
        alike = np.zeros((len(sets), len(sets)), bool)
        alike[:n, n:] = _alike(sets[:n], sets[n:], similarity)
        alike |= alike.T
    else:
        alike = _alike(sets, sets, similarity)
    place = {root: i for i, root in enumerate(np.unique(roots).tolist())}
    forest, own = _Forest(len(place)), [place[r] for r in roots.tolist()]
    return [(int(nodes[a]), int(nodes[b])) for a, b in _tree(alike) if forest.join(own[a], own[b])]


def _cells(similarity: float):
    """Columns cell, side, node, root, shingles, sorted by cell → links of each cell."""

    def run(batches: Batches) -> Batches:
        now, held = None, []

        def emit() -> pa.RecordBatch:
            nodes, sides, roots = (np.array([r[i] for r in held], np.int64) for i in range(3))
            found = _cell(nodes, sides, roots, [r[3] for r in held], similarity) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            sets, values = batch.column(4), batch.column(4).flatten().to_numpy()
            ends = np.asarray(sets.offsets) - (sets.offsets[0].as_py() if len(sets.offsets) else 0)
            for i, (cell, side, node, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if cell != now:
                    if held:
                        yield emit()
                    now, held = cell, []
                held.append((node, side, root, values[ends[i]:ends[i + 1]]))
        if held:
            yield emit()

    return run


def _compared(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links of rows (cell, side, node, root): each cell's sets meet in one task."""
    met = rows.join(sets, "node").select("cell", "side", "node", "root", "shingles")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    return met.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells(similarity), "a long, b long").select(*pair).distinct()


def _rooted(edges: DataFrame) -> DataFrame:
    """node, root of every node with links, the root itself included."""
    linked = components(edges)
    return union_all(linked, linked.select(F.col("root").alias("node"), "root").distinct())


def _with_roots(members: DataFrame, edges: DataFrame) -> DataFrame:
    return members.drop("root").join(_rooted(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))


def family_links(members: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, cell: int = CELL, weight: int = CELL_SHINGLES) -> DataFrame:
    """Links (a, b) of at least `similarity` that connect what all such links within families connect.

    members: family, node; sets: node, shingles.  A family is compared in cells of some `cell` members or `weight` shingles,
    whose sets meet in one task; only links of a spanning forest leave it.  What one cell holds is done then.  Of a larger
    family one member of every group found so is compared next; where more than one group is left, all pairs of its cells.
    """
    sized = members.join(sets.select("node", F.size("shingles").alias("size")), "node")
    families = sized.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / cell), F.ceil(F.sum("size") / weight)).cast("int").alias("parts"))
    placed = stored(members.join(families, "family").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "members")
    within = lambda rows: rows.select(F.xxhash64("family", "part").alias("cell"), F.lit(0).alias("side"), "node", "root")
    found = stored(_compared(within(placed.withColumn("root", F.col("node"))), sets, similarity), "links")
    large = placed.where("parts > 1")
    if large.isEmpty():
        return found
    rooted = stored(_with_roots(large, found), "rooted")
    heads = rooted.groupBy("family", F.col("root").alias("node")).agg(F.count("*").alias("n"))
    counted = heads.groupBy("family").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts"))
    heads = heads.join(counted, "family").select("family", "node", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("parts")).alias("part"), F.col("node").alias("root"))
    found = stored(union_all(found, _compared(within(heads), sets, similarity)), "links")
    rooted = stored(_with_roots(large, found), "rooted")
    several = rooted.groupBy("family").agg(F.count_distinct("root").alias("n")).where("n > 1").select("family")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: q != F.col("part")))
    pairs = rooted.join(several, "family", "left_semi").select("family", "node", "root", "part", other.alias("other"))
    cells = pairs.select(F.xxhash64("family", F.least("part", "other"), F.greatest("part", "other"), F.lit(2)).alias("cell"),
                         F.when(F.col("part") < F.col("other"), 1).otherwise(2).alias("side"), "node", "root")
    return union_all(found, _compared(cells, sets, similarity)).distinct()


def similar_links(nodes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, block: int | None = None, cell: int = CELL, weight: int = CELL_SHINGLES) -> DataFrame:
    """Links (a, b) of at least `similarity` that connect what all such links connect.  `nodes`: low, sketch, bands, fp if known; `docs`: doc_id, text.

    First fingerprints within BITS bits propose links, and every anchor gives a spanning forest of those its sketches propose,
    for copies too far apart for fingerprints; what hangs together by either is a family.
    Then the shingles of a family's members are compared with each other, whoever proposed them.
    """
    share = (1 - similarity) / 2  # of their bits, two sketches differ in this on average
    bits = int(SKETCH * share + DEVIATIONS * (SKETCH * share * (1 - share)) ** 0.5)
    placed = nodes.select(F.explode("bands").alias("anchor"), F.col("low").alias("node"), F.col("sketch").alias("check"), F.lit(True).alias("home"))
    met = _met(dealt(placed, placed, block), bits).where("a <> b")
    if "fp" in nodes.columns:
        signs = nodes.select(F.col("low").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("check"), F.col("fp").alias("sign"))
        met = union_all(links(signs, BITS, block), met)
    proposed = stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash")
    members = stored(_rooted(proposed).withColumnRenamed("root", "family"), "simhash")
    sets = stored(shingle_sets(docs.join(members.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")).withColumnRenamed("doc_id", "node")
                  .dropDuplicates(["node"]), "simhash")
    return family_links(members, sets, similarity, cell, weight)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows that stay: of each group of near copies the one with the smallest id, all columns as they were.

    Texts with equal sets of shingles are one node, so a group of copies is compared once.  Rows without an id and rows
    without words stay.  Rows that repeat an id stay or go together.  To decide, ids are shuffled, and the shingles of
    texts that met another; the ids to drop meet the texts in an anti-join that Spark may split.
    """
    rows = stored(signatures(docs, id_col, text_col).where("doc_id is not null"), "simhash")
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"),
                                             F.min_by("fp", "doc_id").alias("fp")), "simhash")
    linked = components(similar_links(nodes.select("low", "sketch", "bands", "fp"), documents(docs, id_col, text_col), similarity))
    lows = nodes.select("node", "low").join(linked.select(F.col("node").alias("low"), "root"), "low", "left").select("node", F.coalesce("root", "low").alias("keep"))
    # stored, so that the join deals both sides anew and can split a hot signature
    dropped = rows.select("doc_id", "node").join(stored(lows, "simhash"), "node").where("doc_id <> keep").select(F.col("doc_id").alias("__drop")).distinct()
    return docs.join(dropped, docs[f"`{id_col}`"].cast("long") == dropped["__drop"], "left_anti")
