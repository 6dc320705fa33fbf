"""Ordinal quality classifier: cumulative-link regression on hashed text.

A text has one score, a dot product of shared weights with hashed features; the
grades are cut from it by ordered thresholds: P(grade <= k) = sigmoid(t_k - score).
The model gives the expected grade and the tail probability P(grade >= good).

The model is fitted on a bounded sample of the graded texts (``max_rows``, those
with the smallest hash of the id); every text is scored whole, next to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .exchange import text_batches
from .words import ALNUM, LOWER, SPACED, Words, chunks, mix

FEATURES = 1 << 16
MAX_ROWS = 6000               # graded texts that a model is fitted on
RARE = 300                    # a feature of fewer than one in RARE texts of the sample (or 3) gets no weight
ROUNDS = 300
RIDGE = 3e-5


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray    # ascending, one less than there are grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. of each score, one column per threshold."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, value) triples and the number of words of each text.

    Features are hashed lower-case words, hashed shapes (classes of the first and
    last bytes of a word as it stands) and the repetition of the word before; a
    value is the root of its share of the words.
    """
    w = Words(texts, ALNUM)
    s = Words(texts, SPACED)
    kind = np.where(ALNUM, np.uint8(1), np.arange(256, dtype=np.uint8))       # punctuation as it is
    kind[65:91] = 2
    kind[48:58] = 3
    if len(s.begin):
        last2 = np.maximum(s.end - 2, s.begin)
        shape = (kind[s.raw[s.begin]].astype(np.uint64) << np.uint64(16)) | (kind[s.raw[last2]].astype(np.uint64) << np.uint64(8)) | kind[s.raw[s.end - 1]]
    else:
        shape = np.zeros(0, np.uint64)
    half = np.uint64(FEATURES // 2)
    again = np.zeros(len(s.hash), bool)                      # the word before it once more
    again[1:] = (s.hash[1:] == s.hash[:-1]) & (s.doc[1:] == s.doc[:-1])
    f = np.concatenate([w.hash % half, mix(shape + np.uint64(991)) % (half - np.uint64(1)) + half,
                        np.full(int(again.sum()), FEATURES - 1, np.uint64)]).astype(np.int64)
    code, count = np.unique(np.concatenate([w.doc, s.doc, s.doc[again]]) * FEATURES + f, return_counts=True)
    doc, f = code // FEATURES, code % FEATURES
    total = np.where(f < FEATURES // 2, w.per_doc[doc], s.per_doc[doc])
    return doc, f, np.sqrt(count / total), w.per_doc


def fit(doc: np.ndarray, f: np.ndarray, x: np.ndarray, grade: np.ndarray, grades: int, rounds: int = ROUNDS) -> OrdinalModel:
    """Maximum likelihood with a ridge by Adam steps on all rows.

    Features are scaled by the logarithm of their rarity, classes weigh by the root of their counts.
    """
    n = len(grade)
    seen_in = np.bincount(f, minlength=FEATURES)
    scale = np.where(seen_in >= max(3, n // RARE), np.log(np.maximum(n, 1) / np.maximum(seen_in, 1)) / 3, 0)
    x = x * scale[f]
    weights = np.zeros(FEATURES)
    seen = np.bincount(grade, minlength=grades).astype(float)
    below = np.clip(np.cumsum(seen)[:-1] / max(n, 1), 1e-3, 1 - 1e-3)
    first = np.log(below / (1 - below))
    gaps = np.log(np.maximum(np.diff(first), 0.1))           # thresholds stay ordered: sums of positive gaps
    base = first[:1].copy()
    cost = np.where(seen > 0, np.sqrt(n / (grades * np.maximum(seen, 1))), 0)[grade]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, base, gaps)]
    for step in range(1, rounds + 1):
        t = np.concatenate([base, base + np.cumsum(np.exp(gaps))])
        score = np.bincount(doc, weights=weights[f] * x, minlength=n)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        up = 1 / (1 + np.exp(-np.clip(edge[grade + 1] - score, -500, 500)))
        low = 1 / (1 + np.exp(-np.clip(edge[grade] - score, -500, 500)))
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p * cost, low * (1 - low) / p * cost
        slope = du - dl                                       # of the loss in the score
        g_w = np.bincount(f, weights=slope[doc] * x, minlength=FEATURES) / n + RIDGE * weights
        g_t = np.array([(dl[grade == k + 1].sum() - du[grade == k].sum()) / n for k in range(grades - 1)])
        g_gap = np.array([g_t[k + 1:].sum() * np.exp(gaps[k]) for k in range(len(gaps))])
        for param, grad, (m, v) in zip((weights, base, gaps), (g_w, g_t.sum(keepdims=True), g_gap), state):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= 0.3 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return OrdinalModel(weights * scale, np.concatenate([base, base + np.cumsum(np.exp(gaps))]))


def train(docs: DataFrame, graded: DataFrame, grades: int, max_rows: int = MAX_ROWS) -> OrdinalModel | None:
    """A model from ``graded(doc_id, grade)``; None where no graded text exists.

    Null ids and grades, and grades out of range, are left out; of several grades of one id the lowest counts,
    and of several texts of one id the smallest in byte order, so at most ``max_rows`` texts reach the driver.
    """
    picked = (graded.filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1))
              .groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))

    def rows(batches):
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                doc, f, x, n = features(part.column(1))
                ends = np.cumsum(np.bincount(doc, minlength=len(part)))
                starts = np.concatenate([[0], ends[:-1]])
                keep = n > 0
                yield pa.RecordBatch.from_arrays([
                    part.column(0).filter(pa.array(keep)), part.column(2).filter(pa.array(keep)),
                    pa.array([f[s:e].astype("<u2").tobytes() for s, e, k in zip(starts, ends, keep) if k], pa.binary()),
                    pa.array([x[s:e].astype("<f4").tobytes() for s, e, k in zip(starts, ends, keep) if k], pa.binary())],
                    names=["doc_id", "grade", "f", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")      # max_rows rows
    texts = texts.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))                 # partial minimums: a repeated id is no hot group
    got = texts.select("doc_id", "text", "grade").mapInArrow(rows, "doc_id long, grade int, f binary, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["doc_id"], bytes(r["f"]), bytes(r["x"])))
    doc = np.repeat(np.arange(len(got)), [len(r["f"]) // 2 for r in got])
    f = np.frombuffer(b"".join(bytes(r["f"]) for r in got), "<u2").astype(np.int64)
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), "<f4").astype(float)
    return fit(doc, f, x, np.array([r["grade"] for r in got]), grades)


def score(docs: DataFrame, model: OrdinalModel | None, good: int, min_tail: float = 0.5) -> DataFrame:
    """``docs`` with ``expected_grade``, ``p_good`` = P(grade >= good) and ``accepted`` (p_good >= min_tail).

    A null, empty or wordless text has null figures and is not accepted.  Without a model
    every text with a word is accepted, with null figures.  Columns of these names are replaced.
    """
    text_batches(docs.sparkSession)
    weights = None if model is None else model.weights.astype(np.float32)
    rest = docs.drop("expected_grade", "p_good", "accepted")
    at = rest.columns.index("text")

    def run(batches):
        for batch in batches:
            for a, b in chunks(batch.column(at)):
                part = batch.slice(a, b - a)
                doc, f, x, n = features(part.column(at))
                empty = n == 0
                if model is None:
                    none = pa.nulls(len(part), pa.float64())
                    extra = [none, none, pa.array(~empty)]
                else:
                    tails = model.tails(np.bincount(doc, weights=weights[f] * x, minlength=len(part)))
                    extra = [pa.array(tails.sum(1), mask=empty), pa.array(tails[:, good - 1], mask=empty), pa.array(~empty & (tails[:, good - 1] >= min_tail))]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, "expected_grade", "p_good", "accepted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, fields + ", expected_grade double, p_good double, accepted boolean")


def label_grades(labels: DataFrame) -> DataFrame:
    """Grades of the ``labels`` table: 0 toxic, 1 poor, 2 good."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality") + 1).cast("int").alias("grade"))
