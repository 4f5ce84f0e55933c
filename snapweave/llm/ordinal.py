"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector w over hashed text features is shared by all grades; ordered
thresholds t_1 < t_2 < ... give P(grade >= k) = sigmoid(w . x - t_k). A document
gets its expected grade (the sum of the tail probabilities) and the tail
probability of the grade asked for, which selects it.

Features are the distinct lower-cased words (64-bit hashes; those that occur in
at least ``MIN_DOCS`` different training documents whose share of some grade
or better is ``MIN_Z`` standard errors off) and coarse steps of ten measures of the whole text. Training reads at most ``SAMPLE_ROWS`` labelled rows, chosen by
a hash of their id; everything else covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textcore as T

SAMPLE_ROWS, MIN_DOCS, MIN_Z = 12_000, 5, 4.0
STEPS, LEARNING_RATE, RIDGE = 800, 0.1, 3e-5
#: Tail probability from which a document is selected.
CUT = 0.8

_UPPER, _LETTER, _DIGIT, _MARK, _STOP, _BAR, _LINE, _HIGH = (np.zeros(256, bool) for _ in range(8))
_UPPER[0x41:0x5B] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_DIGIT[0x30:0x3A] = True
_MARK[[ord(c) for c in "#$%&*@^~=+<>{}[]\\_"]] = True
_STOP[[ord(c) for c in ".,"]] = True
_BAR[[ord(c) for c in "|!?"]] = True
_LINE[0x0A] = True
_HIGH[0x80:] = True


def _measures(b: T.Block, h: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Rows x measures, each a step 0..15."""
    def per_row(table):
        total = np.concatenate([[0], np.cumsum(table[b.buf], dtype=np.int64)])
        return (total[b.offsets[1:]] - total[b.offsets[:-1]]).astype(float)

    size = np.maximum(np.diff(b.offsets), 1).astype(float)
    words = np.diff(b.row_words).astype(float)
    lines = per_row(_LINE) + 1
    step = lambda x: np.clip(np.floor(x), 0, 15).astype(np.int64)
    again = np.concatenate([[0], np.cumsum(np.concatenate([[False], h[1:] == h[:-1]])[:len(h)])])
    repeated = (again[b.row_words[1:]] - again[b.row_words[:-1]]) / np.maximum(words, 1)
    return np.stack([
        step(repeated * 30), step((1 - distinct / np.maximum(words, 1)) * 16),
        step(per_row(_UPPER) / size * 30), step(per_row(_MARK) / size * 60), step(per_row(_BAR) / size * 60),
        step(per_row(_STOP) / size * 100), step(per_row(_DIGIT) / size * 30), step(np.log2(words + 1)),
        step(size / np.maximum(words, 1)), step(np.log2(words / lines + 1)),
    ], axis=1)


def features(texts):
    """Per block: (first row, rows, row of each feature, feature hash); distinct per row."""
    for b in T.blocks(texts, T.PLAIN):
        raw, b.buf = b.buf, T.LOWER[b.buf]
        h = b.word_hashes()
        row = b.row_of_word()
        u, inverse = np.unique(h, return_inverse=True)
        pair = np.unique(row * np.int64(max(len(u), 1)) + inverse)
        b.buf = raw
        m = _measures(b, h, np.bincount(pair // max(len(u), 1), minlength=b.rows))
        # a measure of step k has the features "at least 1" ... "at least k"
        r, j, k = np.nonzero(m[:, :, None] >= np.arange(1, 16)[None, None, :])
        own = T.mix((j.astype(np.uint64) + np.uint64(1)) * np.uint64(1 << 40) + k.astype(np.uint64))
        yield (b.first_row, b.rows, np.concatenate([pair // max(len(u), 1), r]),
               np.concatenate([u[pair % max(len(u), 1)], own]) if len(u) else own)


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the ordered thresholds."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts) -> np.ndarray:
        """Rows x thresholds: P(grade >= k)."""
        out = []
        for _, rows, row, key in features(texts):
            score = np.zeros(rows)
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = self.keys[at] == key
                score = np.bincount(row[known], self.weights[at[known]], minlength=rows)
            out.append(1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500))))
        return np.concatenate(out) if out else np.zeros((0, len(self.thresholds)))


def fit_rows(rows: list[tuple[int, np.ndarray]], grades: int) -> Model:
    """Fits the weights and thresholds to (grade, feature hashes) rows by Adam steps on the penalised likelihood."""
    if not rows or len({g for g, _ in rows}) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(grades - 1, -20.0))
    y = np.array([g for g, _ in rows])
    size = np.array([len(x) for _, x in rows])
    flat = np.concatenate([x for _, x in rows])
    u, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    odd = np.zeros(len(u))
    for k in range(1, grades):
        share = (y >= k).mean()
        mean = np.bincount(inverse, np.repeat(y >= k, size)) / count
        odd = np.maximum(odd, np.abs(mean - share) / np.sqrt(share * (1 - share) / count + 1e-12))
    keep = ((count >= MIN_DOCS) & (odd >= MIN_Z))[inverse]
    keys, col = np.unique(inverse[keep], return_inverse=True)
    row = np.repeat(np.arange(len(rows)), size)[keep]
    keys = u[keys]
    w, m, v = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys))
    # thresholds as a first value and log gaps, so they stay ordered
    tail = np.array([max((y >= k).mean(), 1e-3) for k in range(1, grades)])
    start = np.log(np.clip(1 - tail, 1e-3, None) / tail)
    theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.5))])
    tm, tv = np.zeros_like(theta), np.zeros_like(theta)
    n = len(rows)
    for step in range(1, STEPS + 1):
        t = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        s = np.bincount(row, w[col], minlength=n)
        # P(y) = F(upper) - F(lower) with F(z) = sigmoid(threshold - score); lower bound of grade 0 is 0, of the last is 1
        cdf = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(s[:, None] - t[None, :], -500, 500))), np.ones((n, 1))], axis=1)
        slope = cdf * (1 - cdf)
        hi, lo = cdf[np.arange(n), y + 1], cdf[np.arange(n), y]
        p = np.maximum(hi - lo, 1e-12)
        ds = (slope[np.arange(n), y + 1] - slope[np.arange(n), y]) / p / n      # d(-log p)/d score
        gw = np.bincount(col, ds[row], minlength=len(w)) + RIDGE * w
        gt = np.zeros(len(t))
        for k in range(len(t)):
            gt[k] = (np.where(y == k, -slope[:, k + 1], 0) + np.where(y == k + 1, slope[:, k + 1], 0)).astype(float) @ (1 / p) / n
        grad = np.concatenate([[gt.sum()], [gt[k:].sum() * np.exp(theta[k]) for k in range(1, len(t))]])
        for a, b, c, g in ((w, m, v, gw), (theta, tm, tv, grad)):
            b *= 0.9
            b += 0.1 * g
            c *= 0.999
            c += 0.001 * g * g
            a -= LEARNING_RATE * (b / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
    return Model(keys, w, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def fit(docs: DataFrame, graded: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on at most SAMPLE_ROWS graded rows (id, grade); rows with a null id or grade are not used.

    Of several grades of one id the smallest counts. Null and empty texts are learned from by their
    measures alone; without any graded row nothing is learned, and every row is kept. Other columns
    are not read.
    """
    spark = docs.sparkSession
    sample = (graded.select(F.col("id").cast("long"), F.col("grade").cast("int")).where("id is not null and grade is not null")
              .groupBy("id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect())
    if not sample:
        return fit_rows([], grades)
    known = F.broadcast(spark.createDataFrame(sample, "id long, grade int"))  # at most SAMPLE_ROWS pairs
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(known, "id")

    def run(batches):
        for batch in batches:
            grade = batch.column("grade").to_pylist()
            for first, rows, row, key in features(batch.column("text")):
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(rows + 1))
                key = T.signed(key[order])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grade[first:first + rows], pa.int32()), T.list_array(key, np.diff(cut), pa.int64())], names=["grade", "keys"])

    got = d.mapInArrow(run, "grade int, keys array<long>").toArrow()
    # copies of a text count once, or their words would pass for evidence
    rows = sorted({(g.as_py(), np.sort(k.values.to_numpy()).tobytes()) for g, k in zip(got.column(0), got.column(1), strict=True)})
    return fit_rows([(g, np.frombuffer(x, np.uint64)) for g, x in rows], grades)


def score(docs: DataFrame, model: Model, grade: int, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, expected_grade, tail_probability (of ``grade`` or better), kept (tail probability of at least ``cut``).

    Null and empty texts are scored by their measures alone (no words). Rows with
    null or repeated ids are scored like any other. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            t = shared.value.tails(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(t.sum(axis=1).round(6)), pa.array(t[:, grade - 1].round(6)), pa.array(t[:, grade - 1] >= cut)],
                names=["doc_id", "expected_grade", "tail_probability", "kept"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def select(docs: DataFrame, model: Model, grade: int, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose tail probability is at least ``cut``.

    Null and empty texts are judged by their measures alone; ids are not looked at, so repeated
    rows are kept or rejected alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.tails(batch.column(at))[:, grade - 1] >= cut))

    return docs.mapInArrow(run, docs.schema)


GRADES, CLEAN = 3, 2


def grades_of(labels: DataFrame) -> DataFrame:
    """(id, grade) from (doc_id, quality, toxic): 0 low quality, 1 toxic, 2 clean."""
    return labels.select(F.col("doc_id").alias("id"),
                         F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1)
                         .when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
