"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: of words, and of word shapes (runs of capitals, small
letters, digits; other characters as they are; whether a word repeats the one before). Each
indicator is scaled by the log of the ratio of its smoothed class counts, rows are brought to unit
length, and a linear hinge-loss model is fitted by dual coordinate descent. A logistic curve over
the fitted margins turns a margin into a score.

The fit uses at most ``max_rows`` labelled documents, those with the smallest hash of their id; that
bound is why their ids may be broadcast and their features may come to the driver. Every text is
scored whole, where it lies, and nothing is shuffled.

Edge cases. Null texts are empty; an empty text has one feature of its own. Labels that are null
are not used; of several labels of a document the mean counts, half rounding up. Without labels of
both classes every score is the share of label 1 (0.5 without labels). A null ``doc_id`` is not
held out. Of several texts with one labelled id the one with the smallest hash is learnt from;
repeated rows are scored one by one. Words and texts may have any length. A score of exactly 0.5 is predicted 1.
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, materialize, read, small_batches, text_of

#: Hashed features, labelled rows in a fit at most, words whose hashes a worker keeps.
BITS, MAX_ROWS, CACHED = 18, 4_000, 150_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUNS = ((re.compile(r"[^\W\d_]*[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "9"))


def _hash(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)


def shape(word: str) -> str:
    for pattern, mark in _RUNS:
        word = pattern.sub(mark, word)
    return word


class Features:
    """Indices of the n-gram indicators of a text."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.known: dict[str, tuple[int, int]] = {}

    def _learn(self, word: str) -> tuple[int, int]:
        if len(self.known) >= CACHED:
            self.known.clear()
        got = self.known[word] = (_hash(word.lower()), _hash("\x00" + shape(word)))
        return got

    def _grams(self, ids: np.ndarray, most: int, salt: int) -> list[np.ndarray]:
        out, gram = [], ids
        for n in range(most):
            if n:
                gram = gram[:-1] * _MIX + ids[n:]
            out.append((gram + np.uint64(salt + n)) * _MIX >> np.uint64(64 - self.bits))
        return out

    def of(self, text: str) -> np.ndarray:
        known, learn = self.known, self._learn
        pairs = [known.get(w) or learn(w) for w in text.split()]
        if not pairs:
            return np.zeros(1, np.int64)
        ids = np.array(pairs, np.uint64)
        words, shapes = ids[:, 0], ids[:, 1].copy()
        same = np.flatnonzero(words[1:] == words[:-1]) + 1
        shapes[same] ^= np.uint64(1)
        grams = self._grams(words, min(2, len(words)), 11) + self._grams(shapes, min(3, len(words)), 101)
        return np.unique(np.concatenate(grams)).astype(np.int64)


def _features(bits: int) -> Features:
    return held(("features", bits), lambda: Features(bits))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS) -> DataFrame:
    """``y, features`` of at most ``max_rows`` labelled documents that are not held out, one of each."""
    chosen = (
        labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The row with the smallest ``h`` of each document; a task meets ``max_rows`` at most."""
        own, best = _features(bits), {}
        for batch in batches:
            for doc, h, y, value in batch.itertuples(index=False):
                if doc not in best or h < best[doc][0]:
                    best[doc] = (h, y, own.of(value).astype(np.int32) if isinstance(value, str) else value)
        if best:
            yield pd.DataFrame([(doc, *x) for doc, x in best.items()], columns=["doc_id", "h", "y", "features"])

    schema = "doc_id long, h long, y int, features array<int>"
    found = docs.select("doc_id", F.xxhash64(text_of()).alias("h"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    each = found.select("doc_id", "h", "y", "text").mapInPandas(once, schema)
    return each.repartition("doc_id").mapInPandas(once, schema).select("y", "features")


def log_count_ratios(x: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """log of the ratio of smoothed shares of a feature in class 1 and in class 0."""
    counts = np.ones((2, size))
    for f, label in zip(x, y, strict=True):
        counts[label, f] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(x: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, c: float, epochs: int = 20) -> np.ndarray:
    """Weights (the last is the intercept's) of a hinge-loss linear model over sparse rows.

    Classes weigh the same in all, so a rare class is not given up.
    """
    rng = np.random.default_rng(7)
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.where(y == 1, (y == 1).mean(), (y == 0).mean())
    most = c * 0.5 / share
    w, alpha = np.zeros(size + 1), np.zeros(len(y))
    square = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, v = x[i], values[i]
            gradient = sign[i] * (w[f] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[f] += step * sign[i] * v
                w[-1] += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-3 * c:
            break
    return w


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve that fits labels to margins."""
    a, b = 1.0, 0.0
    target = np.where(y == 1, 1 - 1 / (2 + (y == 1).sum()), 1 / (2 + (y == 0).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


class Model:
    """Scores texts; fitted by ``fit``."""

    def __init__(self, weights: np.ndarray, ratios: np.ndarray, bias: float, slope: float, shift: float, bits: int):
        self.scaled = (weights * ratios).astype(np.float32)
        self.squares = (ratios**2).astype(np.float32)
        self.bias, self.slope, self.shift, self.bits = bias, slope, shift, bits

    def score(self, text: str) -> float:
        f = _features(self.bits).of(text)
        margin = float(self.scaled[f].sum()) / max(float(self.squares[f].sum()) ** 0.5, 1e-9) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, c: float = 1.0) -> Model:
    size = 1 << bits
    rows = materialize(training_rows(docs, labels, max_rows, bits), "labelled").toPandas()
    y = rows["y"].to_numpy(int)
    x = [np.asarray(f, np.int32) for f in rows["features"]]
    del rows
    order = sorted(range(len(x)), key=lambda i: (len(x[i]), x[i].tobytes(), y[i]))
    x, y = [x[i] for i in order], y[order]
    none = np.zeros(size)
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(none, none, 0.0, 1.0, float(np.log(share / (1 - share))), bits)
    ratios = log_count_ratios(x, y, size)
    values = []
    for f in x:
        v = ratios[f].astype(np.float32)
        values.append(v / max(float(np.sqrt(v @ v)), 1e-9))
    w = dual_coordinate_descent(x, values, y, size, c)
    margin = np.array([w[f] @ v + w[-1] for f, v in zip(x, values, strict=True)])
    return Model(w[:-1], ratios, float(w[-1]), *_curve(margin, y), bits)


def scorer(model: Model, spark: SparkSession):
    """A Pandas UDF from texts to scores."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([own.score(t) for t in texts], dtype="float64")

    return score


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    score = scorer(model, docs.sparkSession)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(text_of()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with the columns they had."""
    return docs.filter(scorer(model, docs.sparkSession)(text_of()) >= 0.5)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, read(spark, sf_dir, "labels")))
