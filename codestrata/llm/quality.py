"""Quality scores learned from preference pairs (Bradley and Terry).

A document is a vector of shape features.  Training puts every labelled document into pairs of a good and a bad one and
fits weights by logistic loss on the difference of their features, so that the good one is preferred.  The threshold is the
quantile of the scores of all labelled documents at the share of bad ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Batches, documents, known_labels, remainder, slices, stored

#: Training: partners of each row of the rarer class, ridge.
PARTNERS, RIDGE = 8, 1.0
#: Rows of the rarer class in a bucket of pairs, buckets at most, and values among which a rank is looked up at once.
BUCKET_ROWS, BUCKETS, RANKED = 512, 256, 50_000
MODULUS, HELD_OUT = 4, 2

_BYTES = np.arange(256)
_KINDS = np.stack([(_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 48) & (_BYTES <= 57), _BYTES >= 128,
                   np.isin(_BYTES, list(b"#%&$*@^~=+_<>\\")), _BYTES == 33, np.isin(_BYTES, list(b"|{}[]")), np.isin(_BYTES, list(b".?")),
                   np.isin(_BYTES, list(b",;:")), np.isin(_BYTES, list(b" \t")), _BYTES == 10]).astype(float).T
NAMES = ("upper", "lower", "digit", "wide", "symbol", "shout", "frame", "stop", "comma", "blank", "line",
         "words", "distinct", "top word", "same as before", "pair repeats", "repeated lines", "word length", "long words", "bytes of entropy", "squeeze")


def features(text: str | None) -> np.ndarray:
    """Shares and repetition measures of a text, whole; zeros for an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.zeros(len(NAMES))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, m = len(words), len(data)
    kinds = counts @ _KINDS / m
    share = counts[counts > 0] / m
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    before = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), float, n)
    rest = [np.log1p(n), np.log(len(seen)) / np.log(n + 1.0), max(seen.values()) / n, before / n, 1 - pairs / max(1, n - 1),
            1 - len(set(lines)) / len(lines), np.log(lengths.mean()), (lengths > 20).mean(), -(share * np.log(share)).sum(),
            len(zlib.compress(data[:m], 1)) / m if m < 1 << 12 else _squeeze(data)]
    return np.concatenate([np.sqrt(kinds), rest])


def _squeeze(data: bytes, piece: int = 1 << 12) -> float:
    """Compressed size over size, piece by piece, so that long and short texts compare."""
    return sum(len(zlib.compress(data[i:i + piece], 1)) for i in range(0, len(data), piece)) / len(data)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    threshold: float


def _fit(differences: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights that make the first of each pair preferred: logistic loss, Newton steps."""
    return _newton(differences.shape[1], lambda w: _sums(differences, w), ridge)


def _sums(differences: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the logistic loss of some pairs, in a row; those of several parts add up."""
    p = 1 / (1 + np.exp(np.clip(differences @ w, -35, 35)))
    return np.concatenate([differences.T @ p, ((differences * (p * (1 - p))[:, None]).T @ differences).ravel()])


def _newton(n: int, sums: Callable[[np.ndarray], np.ndarray], ridge: float) -> np.ndarray:
    w = np.zeros(n)
    for _ in range(40):
        total = sums(w)
        step = np.linalg.solve(total[n:].reshape(n, n) + ridge * np.eye(n), total[:n] - ridge * w)
        w = w + step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _partners(few: np.ndarray, many: np.ndarray, bucket: int) -> np.ndarray:
    """Differences of rows of the rarer class and of the other, which all take part: partners are drawn, the undrawn draw one."""
    draw = np.random.default_rng(7 + bucket)
    drawn = draw.choice(len(many), (len(few), PARTNERS))
    left = np.setdiff1d(np.arange(len(many)), drawn)
    pairs = (few[:, None, :] - many[drawn]).reshape(-1, few.shape[1])
    return np.concatenate([pairs, few[draw.choice(len(few), len(left))] - many[left]])


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label, x of all labelled documents that aren't held out; ids meet, texts stay in their tasks."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            values = [features(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "x"])

    texts = documents(docs).where(F.col("doc_id").isNotNull() & (remainder("doc_id", MODULUS) != HELD_OUT))
    return known_labels(labels, "quality", MODULUS, HELD_OUT).join(texts.mapInArrow(run, "doc_id long, x array<double>").dropDuplicates(["doc_id"]), "doc_id")


def train(rows: DataFrame) -> Model:
    """A model from all of `rows` (doc_id, label, x).

    Tasks hold rows; the driver sees moments, sums of at most BUCKETS parts, and the neighbours of the threshold.  Rows of
    both classes meet in buckets of a hash of the id, and every row is in a pair.
    """
    rows = stored(rows, "features")
    width, at = len(NAMES), range(len(NAMES))
    found = rows.agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"),
                     *[F.round(F.avg(F.col("x")[i]), 9).alias(f"m{i}") for i in at],  # rounded, whatever the order of the sums
                     *[F.round(F.stddev_pop(F.col("x")[i]), 9).alias(f"s{i}") for i in at]).first()
    n_good, n_bad = found["good"], found["bad"]
    some = n_good + n_bad > 0
    mean = np.array([found[f"m{i}"] for i in at]) if some else np.zeros(width)
    scale = np.maximum([found[f"s{i}"] for i in at], 1e-3) if some else np.ones(width)
    if not n_good or not n_bad:
        return Model(np.zeros(2 * width), mean, scale, 0.0 if n_good or not n_bad else 1.0)
    few_label = 0 if n_bad <= n_good else 1
    buckets = max(1, min(BUCKETS, min(n_good, n_bad) // BUCKET_ROWS))

    def pair(batches: Batches) -> Batches:
        got = list(batches)  # whole buckets, or none
        if not got:
            return
        held = pa.Table.from_batches(got)
        number = np.array(held.column("bucket").to_pylist(), int)
        label, x = np.array(held.column("label").to_pylist(), int), np.array(held.column("x").to_pylist(), float).reshape(-1, width)
        z = _squares((x - mean) / scale)
        for bucket in np.unique(number):
            few, many = z[(number == bucket) & (label == few_label)], z[(number == bucket) & (label != few_label)]
            if len(few) and len(many):
                pairs = _partners(few, many, int(bucket)) * (1 if few_label else -1)
                for i in range(0, len(pairs), 4096):
                    some_pairs = pa.array(pairs[i:i + 4096].tolist(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some_pairs), bucket), pa.int32()), some_pairs], ["bucket", "d"])

    placed = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"), "doc_id", "label", "x")
    placed = placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "doc_id")
    pairs = stored(placed.mapInArrow(pair, "bucket int, d array<double>"), "pairs")

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Batches) -> Batches:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                number, d = batch.column(0).to_numpy(), batch.column(1).values.to_numpy().reshape(batch.num_rows, -1)
                for bucket in np.unique(number):
                    total[bucket] = total.get(bucket, 0) + _sums(d[number == bucket], w)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))], ["bucket", "s"])

        parts = pairs.mapInArrow(run, "bucket int, s array<double>").collect()  # a row per bucket and file
        return np.sum([r.s for r in sorted(parts)], axis=0)

    weights = _newton(2 * width, sums, RIDGE)

    def value(batches: Batches) -> Batches:
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(_squares((x - mean) / scale) @ weights)], ["v"])

    values = stored(rows.select("x").mapInArrow(value, "v double"), "values")
    # the quantile lies in the gap between its two neighbours
    h = n_bad / (n_good + n_bad) * (n_good + n_bad - 1)
    return Model(weights, mean, scale, (nth(values, int(np.floor(h))) + nth(values, int(np.ceil(h)))) / 2)


def nth(values: DataFrame, n: int) -> float:
    """The value of rank n (from 0) of values(v), by counts of ever smaller ranges, until few enough rows are left."""
    while True:
        size, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
        if size <= RANKED or low == high:
            break
        place = F.least(F.lit(1023), F.floor((F.col("v") - low) / ((high - low) / 1024))).cast("int")
        for at, count in sorted(values.groupBy(place.alias("at")).count().collect()):  # 1,024 rows at most
            if n < count:
                break
            n -= count
        values = values.where(place == at)
    return low if low == high else sorted(r.v for r in values.collect())[n]


def _squares(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.concatenate([z, z * z / 6], axis=-1)


def score(model: Model, x: np.ndarray) -> np.ndarray:
    """Probability-like score: 0.7 at the threshold."""
    value = _squares((x - model.mean) / model.scale) @ model.weights - model.threshold
    return 1 / (1 + np.exp(-np.clip(value + np.log(0.7 / 0.3), -35, 35)))


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score in [0, 1] of every row; null and empty texts score as a text without features."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            x = np.array([features(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(model, x))], ["doc_id", "score"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    return train(labelled_features(docs, labels))
