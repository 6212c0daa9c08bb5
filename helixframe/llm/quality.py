"""Ordinal cumulative-link regression on graded ratings over hashed text.

P(grade > k) = sigmoid(score - threshold_k) with one score for all grades:
shared weights over hashed words and word shapes, and thresholds in order. The
score is the mean weight of a text's words, so it costs one cached lookup a word.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import held_out

LETTERS, DIGITS, MARKS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"([^\w\s])\1*")


def features(word: str, dims: int) -> tuple[int, int]:
    """Two hashed features of a word: itself and its shape (case, digits, marks)."""
    shape = "A" if word.isupper() else "Aa" if word[:1].isupper() else "a"
    if not word.isalpha():
        shape = MARKS.sub(r"\1", DIGITS.sub("0", LETTERS.sub(shape, word)))[:12]
    return zlib.crc32(b"w" + word.lower().encode("utf-8", "surrogatepass")) % dims, zlib.crc32(b"s" + shape.encode("utf-8", "surrogatepass")) % dims


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self._cache: dict[str, float] = {}

    def __getstate__(self):
        return self.weights, self.thresholds

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, text: str | None) -> float:
        words = text.split() if text else ()
        if not words:
            return 0.0
        cache, dims = self._cache, len(self.weights)
        if len(cache) > 400_000:
            cache.clear()
        for w in set(words).difference(cache):
            a, b = features(w, dims)
            cache[w] = float(self.weights[a] + self.weights[b])
        return sum(map(cache.__getitem__, words)) / len(words)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, as columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def cut_points(start: float, gaps: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, and the logarithms of the distances between them."""
    return start + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


def likelihood(weights: np.ndarray, start: float, gaps: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, decay: float):
    """Mean negative log-likelihood of the grades y with decay / 2 * weights ** 2, and its gradients by weights, start and gaps."""
    n, each = len(y), np.arange(len(y))
    thresholds = cut_points(start, gaps)
    s = np.bincount(rows, weights[cols] * values, n)
    above = 1 / (1 + np.exp(np.clip(thresholds[None, :] - s[:, None], -40, 40)))
    full = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), axis=1)
    p = np.maximum(full[each, y] - full[each, y + 1], 1e-9)
    slope = full * (1 - full)
    up, down = slope[each, y] / p, slope[each, y + 1] / p
    by_threshold = np.array([up[y == k + 1].sum() - down[y == k].sum() for k in range(len(thresholds))]) / n
    by_weight = np.bincount(cols, (down - up)[rows] * values, len(weights)) / n + decay * weights
    by_gap = np.array([by_threshold[k + 1 :].sum() for k in range(len(gaps))]) * np.exp(gaps)
    return -np.log(p).mean() + decay / 2 * (weights @ weights), by_weight, by_threshold.sum(), by_gap


def fit(texts: list[str], grades: list[int], levels: int = 3, dims: int = 1 << 16, steps: int = 150, decay: float = 1e-4, rate: float = 0.3) -> Model:
    """Full-batch AdaGrad on the likelihood; without rows every grade is alike."""
    cols, rows, values = [], [], []
    for i, t in enumerate(texts):
        words = t.split()
        f = np.array([features(w, dims) for w in words], np.int64).ravel()
        at, n = np.unique(f, return_counts=True)
        cols.append(at)
        rows.append(np.full(len(at), i))
        values.append(n / max(1, len(words)))
    y = np.array(grades, np.int64)
    if not len(y):
        return Model(np.zeros(dims), np.linspace(-1, 1, levels - 1))
    cols, rows, values = map(np.concatenate, (cols, rows, values))
    p = np.concatenate((np.zeros(dims), [-1.0], np.zeros(levels - 2)))
    seen = np.zeros(len(p))
    for _ in range(steps):
        _, gw, gs, gg = likelihood(p[:dims], p[dims], p[dims + 1 :], rows, cols, values, y, decay)
        g = np.concatenate((gw, [gs], gg))
        seen += g * g
        p -= rate * g / (np.sqrt(seen) + 1e-8)
    return Model(p[:dims].astype(np.float32), cut_points(p[dims], p[dims + 1 :]))


def training_rows(docs: DataFrame, graded: DataFrame, rows: int = 3000, chars: int = 12_000) -> list[tuple[str, int]]:
    """At most `rows` (text, grade) of rows not held out, of up to `chars` characters, by least hash of the text.

    Null texts and grades are left out; texts with several grades keep the lowest.
    """
    learn = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.length("text").between(1, chars)).withColumn("h", F.xxhash64("text"))
    both = learn.select("doc_id", "h").join(graded.where("grade is not null").select("doc_id", "grade"), "doc_id")
    least = both.groupBy("h").agg(F.min("grade").alias("grade")).orderBy("h").limit(rows)
    chosen = learn.select("h", "text").join(F.broadcast(least), "h").groupBy("h", "grade").agg(F.min("text").alias("text"))
    return [(r["text"], int(r["grade"])) for r in sorted(chosen.collect(), key=lambda r: r["h"])]


def classify(docs: DataFrame, model: Model, tail_grade: int = 1, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability (of `tail_grade` or better) and selected, for every row.

    Null and empty texts have score 0 like any other value; texts of any length are read whole. A tail that equals the
    threshold is selected. Repeated rows are kept, other columns ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for b in batches:
            tails = own.tails(np.array([own.score(t) for t in b.column("text").to_pylist()], np.float64))
            tail = tails[:, tail_grade - 1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(tails.sum(axis=1), pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= threshold, pa.bool_())], names=["doc_id", "held_out", "expected_grade", "tail_probability", "selected"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, expected_grade double, tail_probability double, selected boolean")
