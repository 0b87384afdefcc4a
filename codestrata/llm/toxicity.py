"""Toxic passages as maximum-scoring segments of token log-odds.

Training counts, for every token and every stem (first letters of a token), the labelled documents of either class it
occurs in, and takes the log-odds under an informative Dirichlet prior that is proportional to the token's share in all of
them.  Tokens whose log-odds lie above an offset score the difference; every other token scores a small loss.  The offset
is the one that predicts best from one half of the training rows to the other.  A linear
scan finds all maximal segments of positive score; the chance of a segment follows the extreme-value law of local scores,
E = K n exp(-lambda S).  The best segment's chance is calibrated to a probability on the training rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Batches, bounded_batches, documents, labelled_sample, slices, stored

WORD = re.compile(r"[^\W\d_]+")
STEMS = (6, 5, 4)
#: Training: labelled rows at most, mass of the prior in documents, toxic documents a token must occur in, share of toxic
#: ones among a stem's documents, tokens of a model at most, offsets of the log-odds that are tried.
SAMPLE_ROWS, PRIOR, LEAST_DOCS, STEM_PURITY, MOST_TOKENS = 20_000, 5.0, 2, 0.9, 50_000
OFFSETS = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5)
LOSS = 1.0  # of every token without a score
SIGNIFICANT = 0.01  # E-value of a reported passage
MOST_STRENGTH = 30.0  # -log chance beyond which nothing changes
CACHE = 500_000


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]  # tokens as they are, stems with a trailing *
    rate: float  # lambda
    scale: float  # K
    slope: float
    middle: float


def _tokens(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def document_counts(sample: DataFrame) -> DataFrame:
    """token, toxic, clean: labelled documents that hold the token.  Counted within a task first."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for token in {t for w in set(WORD.findall(text.lower())) for t in _tokens(w)}:
                    counts.setdefault(token, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()),
                                              pa.array([c[0] for c in counts.values()], pa.int64())], ["token", "toxic", "clean"])

    parts = sample.select("text", "label").mapInArrow(run, "token string, toxic long, clean long")
    return parts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame, toxic_docs: int, clean_docs: int, prior: float = PRIOR) -> DataFrame:
    """token, toxic, clean, delta: log-odds of the token between the classes.

    The Dirichlet prior's mean is the token's share in both classes together, so a rare token stays near zero.
    """
    n = float(toxic_docs + clean_docs)
    mass = 1 + prior * (F.col("toxic") + F.col("clean")) / n
    up, down = F.col("toxic") + mass * (toxic_docs / n), F.col("clean") + mass * (clean_docs / n)
    rest_up, rest_down = toxic_docs + 1 + prior - up, clean_docs + 1 + prior - down
    return counts.withColumn("delta", F.log(up / F.greatest(rest_up, F.lit(0.5))) - F.log(down / F.greatest(rest_down, F.lit(0.5))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in time linear in it.

    Candidates are kept with the sums before and after them; a new one joins the nearest earlier one that starts lower,
    if the sum has risen above that one's end.  Candidates that start higher in between can be skipped for good.
    """
    totals = np.cumsum(scores)
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest that starts lower
    for i in np.flatnonzero(scores > 0).tolist():
        start, low, high = i, float(totals[i] - scores[i]), float(totals[i])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((start, i + 1, low, high, j))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


class _Scores(dict):
    """Score of a word: its own, else that of its longest stem, else the loss."""

    def __init__(self, scores: dict[str, float]) -> None:
        super().__init__()
        self.known = scores

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = next((self.known[t] for t in _tokens(word) if t in self.known), -LOSS)
        return value


def _chance(model: Model, best: float, words: int) -> float:
    """-log of the chance that a clean text of so many words has such a segment."""
    if best <= 0:
        return 0.0
    expected = model.scale * max(1, words) * np.exp(-model.rate * best)
    return min(MOST_STRENGTH, float(-np.log(max(-np.expm1(-expected), 1e-300))))


def _scan(texts: list[str | None], model: Model, cache: _Scores, spans: bool):
    """-log chance of every text, and its significant passages as (start, end, score) in characters."""
    strength, passages = [], []
    for text in texts:
        words = WORD.findall((text or "").lower())
        scores = np.fromiter(map(cache.__getitem__, words), float, len(words))
        found = segments(scores) if len(words) and scores.max() > 0 else []
        strength.append(_chance(model, max((s for *_, s in found), default=0.0), len(words)))
        kept = [x for x in found if spans and model.scale * len(words) * np.exp(-model.rate * x[2]) <= SIGNIFICANT]
        if kept:
            at = [m.span() for m in WORD.finditer((text or "").lower())]
            kept = [{"start": at[a][0], "end": at[b - 1][1], "score": s} for a, b, s in kept]
        passages.append(kept)
    return np.array(strength), passages


def _extreme_value(toxic_scores: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """lambda and K of local scores where a token scores s with the given share in clean text, and else the loss.

    lambda solves E exp(lambda s) = 1.  For K the upper bound of Karlin and Altschul for lattice-free steps is taken, the
    drift times lambda: calibration takes up a constant factor.
    """
    rest = 1.0 - shares.sum()
    drift = rest * LOSS - float((shares * toxic_scores).sum())
    if drift <= 0 or not len(shares):
        return 1.0, 1.0
    low, high = 1e-6, 1.0
    value = lambda x: float((shares * np.exp(np.minimum(x * toxic_scores, 700))).sum() + rest * np.exp(-x * LOSS)) - 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high, min(1.0, high * drift)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by damped Newton steps; targets are drawn in as Platt's."""
    up, n = y.sum(), len(y)
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (n - up + 2))
    z = np.stack([x, np.ones(n)], axis=1)
    keep = np.array([ridge, 0.0])
    loss = lambda w: float(np.logaddexp(0, z @ w).sum() - target @ (z @ w) + (keep * w * w).sum() / 2)
    w = np.array([0.0, np.log((up + 1) / (n - up + 1))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9), z.T @ (target - p) - keep * w)
        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w + size * step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _strong(sample: DataFrame) -> tuple[list, int, int]:
    """Tokens with positive log-odds, MOST_TOKENS at most, and the number of documents of both classes."""
    sizes = dict(sample.groupBy("label").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return [], toxic, clean
    pure = ~F.col("token").endswith("*") | (F.col("toxic") >= STEM_PURITY * (F.col("toxic") + F.col("clean")))
    found = (log_odds(document_counts(sample), toxic, clean).where((F.col("toxic") >= min(LEAST_DOCS, toxic)) & (F.col("delta") > OFFSETS[0]) & pure)
             .orderBy(F.desc("delta"), "token").limit(MOST_TOKENS).collect())
    return found, toxic, clean


def _model(strong: list, clean: int, offset: float, slope: float = 1.0, middle: float = 0.0) -> Model:
    scores = {r.token: float(r.delta) - offset for r in strong if r.delta > offset}
    words = [r for r in strong if r.token in scores and not r.token.endswith("*")]
    shares = np.array([(r.clean + 1e-2) / (clean * 100.0) for r in words])  # a clean text has some hundred words
    rate, scale = _extreme_value(np.array([scores[r.token] for r in words]), shares)
    return Model(scores, rate, scale, slope, middle)


def train(sample: DataFrame) -> Model:
    """A model from `sample` (doc_id, text, label); see labelled_sample for its bound.  Equal texts count once."""
    sample = stored(sample.withColumn("key", F.xxhash64("text")).dropDuplicates(["key", "label"])
                    .withColumn("half", F.pmod(F.xxhash64("key"), F.lit(2))).select("text", "label", "half"), "toxicity")
    strong, toxic, clean = _strong(sample)
    if not toxic or not clean:
        return Model({}, 1.0, 1.0, 0.0, float(np.log((toxic + 1) / (clean + 1))))
    half = _strong(sample.where("half = 0"))
    models = [_model(half[0] or strong, half[2] or clean, offset) for offset in OFFSETS]

    def run(batches: Batches) -> Batches:
        caches = [_Scores(m.scores) for m in models]
        for batch in batches:
            x = np.stack([_scan(batch.column(0).to_pylist(), m, c, False)[0] for m, c in zip(models, caches, strict=True)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    other = sample.where("half = 1") if half[0] else sample
    seen = other.select("text", "label").mapInArrow(run, "x array<double>, label int").toPandas()  # rows of the sample
    x, y = np.array(seen.x.tolist(), float).reshape(len(seen), len(OFFSETS)), seen.label.to_numpy()
    fits = []
    for i, offset in enumerate(OFFSETS):
        slope, middle = logistic(x[:, i], y)
        p = 1 / (1 + np.exp(-np.clip(slope * x[:, i] + middle, -35, 35)))
        fits.append((float(-np.log(np.where(y > 0, p, 1 - p)).sum()), offset, slope, middle))
    _, offset, slope, middle = min(fits)
    return _model(strong, clean, offset, slope, middle)


def probability(model: Model, strength: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * strength + model.middle, -35, 35)))


def toxic_passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score in [0, 1] and passages (start, end, score; positions in the lower-cased text) of every row.

    Null and empty texts have no passage and the score of a text without one.  Repeated rows are scored alike.
    """

    def run(batches: Batches) -> Batches:
        cache = _Scores(model.scores)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in slices(batches):
            strength, passages = _scan(batch.column(1).to_pylist(), model, cache, True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(model, strength)), pa.array(passages, kind)],
                                             ["doc_id", "score", "passages"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, passages array<struct<start: int, end: int, score: double>>")


def clean_documents(docs: DataFrame, model: Model, most: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows that score below `most`, all columns as they were; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Batches) -> Batches:
        cache = _Scores(model.scores)
        for batch in slices(batches):
            strength, _ = _scan(batch.column(at).to_pylist(), model, cache, False)
            yield batch.filter(pa.array(probability(model, strength) < most))

    return bounded_batches(docs).mapInArrow(run, docs.schema)


#: Rows whose crc32 has this remainder are held out of training.
MODULUS, HELD_OUT = 3, 1


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    return train(labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT, rows))
