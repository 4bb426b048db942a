"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of each document's text are standardised and mapped to random
Fourier features, whose inner products approximate a Gaussian kernel. Every
partition adds up its share of the normal equations; the sums are of fixed
size, whatever the corpus. A fold of the labelled rows that the regression
hasn't seen calibrates its scores by isotonic regression over equal bins.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import MARKS, added_up, bitmap, released, typed, written
from .quality_rules import Stats, _hashers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES, RIDGE, BINS, THRESHOLD = 192, 1e-2, 1024, 0.3
#: Bytes of text whose statistics are taken at a time.
SPAN = 4 * K.SLICE


def statistics(data: np.ndarray, offsets: np.ndarray, hashers: dict[str, K.Hasher]) -> np.ndarray:
    """One row for each text, of numbers that depend on nothing but the text; all are finite for empty ones too."""
    s = Stats(data, offsets, hashers)
    starts, ends, h, first = s["words"]
    n, chars = s["n_words"].astype(float), s["word_chars"].astype(float)
    text = K.text_of_words(first)
    length = (ends - starts).astype(float)
    per_word, per_char, per_line = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(s["n_lines"], 1)
    square = np.bincount(text, weights=length**2, minlength=len(n)) / per_word
    mean = np.bincount(text, weights=length, minlength=len(n)) / per_word
    letters = np.maximum(s["n_upper"] + s["n_lower"], 1)
    capital = s.part[starts - s.base] if len(starts) else s.part[:0]
    columns = [
        np.log1p(n), np.log1p(mean), np.sqrt(np.maximum(square - mean**2, 0)), np.log1p(s["n_symbols"]) - np.log1p(chars), s["n_symbols"] / per_char,
        s["n_upper"] / letters, s["n_dup_lines"] / per_line, s["n_repeat_words"] / per_word, np.log1p(s["n_lines"]) - np.log1p(n),
        1 - np.bincount(text[K.earlier(h, text)], minlength=len(n)) / per_word, s.count(s.part >= 0x80) / per_char,
        np.bincount(text, weights=(capital >= 0x41) & (capital <= 0x5A), minlength=len(n)) / per_word,
        *[s.count(np.isin(s.part, np.frombuffer(marks, dtype=np.uint8))) / per_char for marks in (b".", b",", b"!", b"|", b"#*$%&", b"0123456789", b"<>{}[]()=;:/")],
    ]
    return np.stack(columns, axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    values: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def fourier(self, x: np.ndarray) -> np.ndarray:
        random = np.random.default_rng(20)
        d = x.shape[1]
        w = random.standard_normal((d, FEATURES)) / np.sqrt(d)
        shift = random.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ w + shift), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights if self.weights is not None else np.full(len(x), 0.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1) if self.weights is not None else np.full(len(x), 0.5)


def described(docs: DataFrame, marks: np.ndarray | None = None) -> DataFrame:
    """(doc_id, x): the statistics of each text as packed doubles; with marks, only of rows whose doc_id has a marked place."""
    bits = None if marks is None else np.packbits(marks).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = _hashers()
        wanted = None if bits is None else np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
        for b in batches:
            if wanted is not None:
                b = b.filter(pa.array(wanted[np.asarray(b.column(2))]))
            data, offsets = K.column(b.column(1))
            for lo, hi in K.spans(offsets, SPAN):
                x = statistics(data, offsets[lo : hi + 1], hashers)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    rows = typed(docs, ("doc_id", "long"), ("text", "string"))
    return (rows if marks is None else rows.withColumn("place", place_of("doc_id"))).mapInArrow(run, "doc_id long, x binary")


def place_of(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(MARKS))


def _matrix(array: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype=float) for x in array.to_pylist()])


def summed(rows: DataFrame, terms) -> np.ndarray | None:
    """The sum of terms(x, y) over rows (x, y): added up by partition, then as added_up does."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                p = b.slice(lo, 4096)
                part = terms(_matrix(p.column(0)), np.asarray(p.column(1), dtype=float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return added_up(rows.select("x", F.col("y").cast("double")).mapInArrow(add, "total binary"))


def pool_adjacent(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The non-decreasing rates closest to positive / n, weighted by n."""
    blocks: list[list[float]] = []
    for a, b in zip(n, positive, strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            x = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], x, strict=True)]
    return np.concatenate([np.full(int(k), b / a) for a, b, k in blocks]) if blocks else np.zeros(0)


def fit(x: DataFrame, labels: DataFrame) -> Model:
    """From described rows and labels (doc_id, quality): rows whose crc32(doc_id as text) mod 5 is 0 are not looked at, those with 1 calibrate, the others fit the regression."""
    known = typed(labels, ("doc_id", "long"), ("quality", "int")).where("quality in (0, 1)").withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))).where("fold <> 0")
    rows = written(x.join(known, "doc_id").select("x", F.col("quality").alias("y"), "fold"), "labelled")
    learn, check = rows.where("fold <> 1"), rows.where("fold = 1")
    moments = summed(learn, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0), [y.sum()]]))
    if moments is None:
        return Model(np.zeros(1), np.ones(1), None)
    d = (len(moments) - 2) // 2
    n, mean = moments[0], moments[1 : d + 1] / moments[0]
    model = Model(mean, np.sqrt(np.maximum(moments[d + 1 : 2 * d + 1] / n - mean**2, 1e-6)), None)

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.fourier(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    total = summed(learn, equations)
    k = FEATURES + 1
    model.weights = np.linalg.solve(total[: k * k].reshape(k, k) + RIDGE * np.sqrt(n) * np.eye(k), total[k * k :])

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        place = np.clip(((model.raw(x) + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(place, minlength=BINS), np.bincount(place, weights=y, minlength=BINS)])

    counts = summed(check, binned)
    if counts is not None:
        n, positive = counts[:BINS], counts[BINS:]
        full = np.flatnonzero(n)
        model.knots = (full + 0.5) * 2 / BINS - 0.5
        model.values = pool_adjacent(n[full], positive[full])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    Null texts count as empty, and all texts get a score from 0 to 1; only the
    text decides about it, so that equal texts score alike. Labels are learnt as fit() says; null or other
    labels are left out, repeated ones count each time. Without any label to
    learn from, every score is 0.5. A null doc_id is held out from nothing
    (held_out is null) and learns nothing. Further columns aren't looked at.
    """
    x = written(described(docs), "described")
    with released(docs.sparkSession):
        model = fit(x, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                p = b.slice(lo, 4096)
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(model.score(_matrix(p.column(1))))], ["doc_id", "score"])

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return x.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with their columns as they are, that are predicted to be of quality; each row is judged by its own text.

    Null texts count as empty and are judged like any other; so are rows that
    repeat a doc_id or have none. Without any label to learn from all rows stay,
    and an empty table stays empty. For the fit, statistics are taken of texts
    with a label alone (of a few more, where doc_ids share a place in the map of
    those), so that each text's are taken once, and those of labelled ones twice.
    """
    with released(docs.sparkSession):
        marks = bitmap(typed(labels, ("doc_id", "long")).select(place_of("doc_id").alias("place")), MARKS)
        model = fit(described(docs, marks), labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = _hashers()
        for b in batches:
            data, offsets = K.column(b.column(at))
            for lo, hi in K.spans(offsets, SPAN):
                good = model.score(statistics(data, offsets[lo : hi + 1], hashers)) >= THRESHOLD
                yield b.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
