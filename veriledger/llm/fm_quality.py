"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

The pairwise term is taken by that sum-of-squares identity, so a text costs time linear in
its distinct words. The model is fitted in numpy on a bounded sample of labelled rows
(``max_train_rows``); scoring reads every whole text in Arrow batches.

Defined results: null and empty texts have only the bias and the structure features and get a
score like any other row; null ids are scored and are never held out unless crc32 of the empty
text says so; repeated rows (ties) are scored each, alike; very long texts are read whole, in memory that grows with
their words; in training, ids with several labels take the greatest, and of rows that share an id the text with
the least hash is read; extra input columns are ignored; an empty table
gives no rows; with no usable label the score is 0.5, with one class it is a smoothed prior.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, id_bucket, slices, text_bytes

WORD_BITS = 17
STRUCT_BINS = 16
#: Offsets of one-hot groups after the hashed words.
GROUPS = ("words", "word_length", "symbols", "upper", "digits", "distinct", "repeats", "bars", "dup_lines", "marks", "wide", "line_words", "meta_chars")
#: Most bytes of text that training reads.
MAX_TRAIN_BYTES = 64_000_000
N_FEATURES = (1 << WORD_BITS) + len(GROUPS) * STRUCT_BINS

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!?"
_ASCII = bytes(range(128))


def _log_bin(x: float) -> int:
    return min(STRUCT_BINS - 1, int(math.log2(x + 1)))


def _share_bin(part: float, whole: float) -> int:
    """0 for none, then finer bins near zero and coarser ones near one."""
    if not whole or part <= 0:
        return 0
    return max(1, min(STRUCT_BINS - 1, STRUCT_BINS - 1 + int(1.5 * math.log2(min(1.0, part / whole)))))


def features(data: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices and values of a whole text."""
    words = data.split()
    n, size = len(words), len(data)
    lowered = data.lower().split()
    distinct = set(lowered)
    count = lambda chars: size - len(data.translate(None, chars))
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = max(1, sum(map(len, words)))
    stats = (
        _log_bin(n),
        min(STRUCT_BINS - 1, round(letters / n)) if n else 0,
        _share_bin(count(_SYMBOLS), n),
        _share_bin(count(_UPPER), letters),
        _share_bin(count(_DIGITS), letters),
        _share_bin(n - len(distinct), n),
        _share_bin(sum(map(eq, lowered, lowered[1:])), n),
        _share_bin(data.count(b"|"), n),
        _share_bin(len(lines) - len(set(lines)), len(lines)),
        _share_bin(count(_MARKS), n),
        _share_bin(len(data.translate(None, _ASCII)), letters),
        _log_bin(n / max(1, len(lines))),
        0 if n_chars is None or n_chars < 0 else _log_bin(float(n_chars)),
    )
    mask = (1 << WORD_BITS) - 1
    ids = np.fromiter((crc32(w) & mask for w in distinct), np.int64, len(distinct))
    extra = np.array([(1 << WORD_BITS) + g * STRUCT_BINS + b for g, b in enumerate(stats)], np.int64)
    # Words together weigh as much as a text's structure does, whatever its length.
    values = np.concatenate([np.full(len(ids), 1.0 / math.sqrt(len(ids)) if len(ids) else 0.0), np.full(len(extra), 0.5)])
    return np.concatenate([ids, extra]), values.astype(np.float32)


@dataclass
class FactorisationMachine:
    """Bias, linear weights and ``rank`` latent factors a feature."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    @classmethod
    def constant(cls, p: float, rank: int = 8) -> FactorisationMachine:
        return cls(math.log(p / (1 - p)), np.zeros(N_FEATURES, np.float32), np.zeros((N_FEATURES, rank), np.float32))

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores before the logistic function, all rows at once, linear in their features."""
        if not rows:
            return np.zeros(0)
        idx, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        starts = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        xv = self.v[idx] * val[:, None]
        linear = np.add.reduceat(self.w[idx] * val, starts)
        sums = np.add.reduceat(xv, starts, axis=0)
        squares = np.add.reduceat((xv * xv).sum(axis=1), starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares)

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rank: int = 8, epochs: int = 6, rate: float = 0.15, decay: float = 2e-5, seed: int = 7) -> FactorisationMachine:
        """Logistic loss, AdaGrad, one row at a time in a seeded order. Features never seen stay zero."""
        good = sum(labels)
        prior = (good + 0.5) / (len(labels) + 1)
        model = cls.constant(prior, rank)
        if not labels or good in (0, len(labels)):
            return model
        rng = np.random.default_rng(seed)
        touched = np.zeros(N_FEATURES, bool)
        for idx, _ in rows:
            touched[idx] = True
        model.v[touched] = rng.normal(0, 0.05, (int(touched.sum()), rank))
        gw, gv, gb = np.full(N_FEATURES, 1e-2, np.float32), np.full((N_FEATURES, rank), 1e-2, np.float32), 1e-2
        w, v = model.w, model.v
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                idx, x = rows[k]
                vi = v[idx]
                s = x @ vi
                margin = model.bias + float(w[idx] @ x) + 0.5 * float(s @ s - ((vi * x[:, None]) ** 2).sum())
                err = 1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))) - labels[k]
                dw = err * x + decay * w[idx]
                dv = err * (x[:, None] * (s[None, :] - vi * x[:, None])) + decay * vi
                gw[idx] += dw * dw
                gv[idx] += dv * dv
                gb += err * err
                w[idx] -= rate * dw / np.sqrt(gw[idx])
                v[idx] -= rate * 0.5 * dv / np.sqrt(gv[idx])
                model.bias -= rate * err / math.sqrt(gb)
        return model


def train(docs: DataFrame, labels: DataFrame, learn: F.Column, label: str = "quality", max_train_rows: int = 12_000, max_train_bytes: int = MAX_TRAIN_BYTES) -> FactorisationMachine:
    """Fit on the executors' features of a sample of at most ``max_train_rows`` labelled ids and ``max_train_bytes`` of text; only hashed features come to the driver."""
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, size in slices(b, "text"):
                chars = b.column(b.schema.get_field_index("n_chars")).slice(start, size).to_pylist()
                rows = [features(t, c) for t, c in zip(text_bytes(b, "text", start, size), chars)]
                ids = b.column(b.schema.get_field_index("doc_id")).slice(start, size)
                y = b.column(b.schema.get_field_index("_y")).slice(start, size)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), y.cast(pa.int32()), pa.array([r[0].astype("<i4").tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<f4").tobytes() for r in rows], pa.binary())], ["doc_id", "y", "idx", "val"])

    sample = bounded_sample(docs.select("doc_id", "text", "n_chars"), picked, max_train_bytes).mapInArrow(extract, "doc_id long, y int, idx binary, val binary")
    got = sorted(((r.doc_id, r.y, bytes(r.idx), bytes(r.val)) for r in sample.toLocalIterator()))
    rows = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(x, "<f4")) for _, _, i, x in got]
    return FactorisationMachine.fit(rows, [y for _, y, _, _ in got])


def score(docs: DataFrame, model: FactorisationMachine, held_out: F.Column, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for start, size in slices(b, "text", 1_000_000):
                chars = b.column(b.schema.get_field_index("n_chars")).slice(start, size).to_pylist()
                z = m.margins([features(t, c) for t, c in zip(text_bytes(b, "text", start, size), chars)])
                p = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, size), b.column(1).slice(start, size), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select("doc_id", held_out.alias("held_out"), "text", F.col("n_chars").cast("long").alias("n_chars"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, max_train_rows: int = 12_000) -> DataFrame:
    """Learn from rows outside the held-out fold (crc32(doc_id) mod 4 = 2), score all rows."""
    held = id_bucket("doc_id", 4) == 2
    return score(docs, train(docs, labels, ~held, max_train_rows=max_train_rows), held)
