"""Toxicity: subword-bag embeddings averaged into a linear softmax, both trained together in numpy.

A word is the bag of its hashed character 3- to 5-grams and itself. A text is read in windows of
``WINDOW`` words, all of it, one beginning every half window; a window is the average of its distinct
words' vectors, a two-class linear softmax reads that average, and the text's score is that of its worst window. One abusive
sentence in a long text then weighs as much as in a short one, wherever it falls, and a word repeated hundreds of
times weighs once a window. Embeddings and softmax weights are learned jointly, each text by the
window that is worst at that moment, so a misspelling never seen shares the vectors of its n-grams.
Because every step after the lookup is linear, a word's share of the logit is a number that a task
computes once while it keeps the word and then adds up.

Defined results: null and empty texts get the bias alone; null ids are scored; repeated rows
are scored each; very long texts are scored whole, in memory that grows with their words; of windows that are equally bad (ties) any gives
the score; in training, ids with several labels count as toxic if one says so, and of rows that share an id the text with the
least hash is read; extra columns are ignored; an empty table gives no rows; with no usable label
the score is 0.5, with one class a smoothed prior.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, id_bucket, slices, text_bytes

BUCKET_BITS = 17
N_BUCKETS = 1 << BUCKET_BITS
_EDGE = b".,;:!?\"'()[]{}#*$%&|<>"
#: Averages of many words are small numbers; this fixed factor keeps their gradients in range.
SCALE = 8.0
#: Zero vectors added to every window's average, so that a few words alone make no strong case.
PAD = 8
#: Words of a window.
WINDOW = 32
#: Bytes of text scored at a time.
SLICE_BYTES = 800_000
#: Most bytes of text that training reads.
MAX_TRAIN_BYTES = 40_000_000


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Buckets of 32-bit hashes."""
    h = (h ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)) & np.uint32(N_BUCKETS - 1)


def gram_table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams each word has, and all words' buckets in a row.

    A word is taken in lower case, without punctuation at its edges and between boundary marks; it has its 3- to 5-grams and itself.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    text = b"\n".join([b"<" + w.lower().strip(_EDGE) + b">" for w in words]).decode("utf-8", "replace")
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
    gap = cp == 10
    word = np.cumsum(gap, dtype=np.int32)
    first = np.concatenate([[0], np.flatnonzero(gap) + 1])
    with np.errstate(over="ignore"):
        place = np.arange(len(cp)) - first[word]
        place[gap] = 0
        power = np.multiply.accumulate(np.full(int(place.max()) + 1, 0x01000193, np.uint32))
        term = cp * power[place]
        term[gap] = 0
        owners, buckets = [np.arange(len(words), dtype=np.int32)], [_mixed(np.add.reduceat(term, first, dtype=np.uint32), 1)]
        h = cp.copy()
        for n in range(2, 6):
            h = h[:-1] * np.uint32(0x01000193) ^ cp[n - 1 :]
            if n >= 3:
                inside = np.flatnonzero((word[: len(h)] == word[n - 1 :]) & ~gap[: len(h)])
                owners.append(word[inside])
                buckets.append(_mixed(h[inside], n))
    owner = np.concatenate(owners)
    return np.bincount(owner, minlength=len(words)), np.concatenate(buckets)[np.argsort(owner, kind="stable")].astype(np.int32)


def split(text: bytes) -> list[bytes]:
    return text.lower().split()


def window_means(logit: np.ndarray, number: np.ndarray, lengths: np.ndarray, offset: int) -> np.ndarray:
    """The greatest padded mean over the windows of each text, whose words are ``number`` with their ``logit``; windows begin ``offset`` words early. Texts have a word at least."""
    first = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    place = (np.arange(len(number)) - first[doc]).astype(np.int32)
    begin = (place + offset) // WINDOW * WINDOW - offset  # of the word's window, in its text
    # A word counts unless it stands in the same window before.
    order = np.lexsort((number, doc))
    same = (number[order[1:]] == number[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    before = np.full(len(number), -WINDOW - 1, np.int32)
    before[order[1:][same]] = place[order[:-1][same]]
    counts = before < begin
    cuts = np.flatnonzero((place == 0) | ((place + offset) % WINDOW == 0))
    means = np.add.reduceat(logit * counts, cuts) / (np.add.reduceat(counts.astype(np.int64), cuts) + PAD)
    return np.maximum.reduceat(means, np.searchsorted(cuts, first))


@dataclass
class SubwordModel:
    """``emb``: bucket vectors; ``out``: class weights (2 x dim); ``bias``: class biases."""

    emb: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def __post_init__(self) -> None:
        self._logit = self.emb @ (self.out[1] - self.out[0])  # each bucket's share of the difference of the two logits
        self.forget()

    @classmethod
    def constant(cls, p: float, dim: int = 12) -> SubwordModel:
        return cls(np.zeros((N_BUCKETS, dim), np.float32), np.zeros((2, dim), np.float32), np.array([0.0, math.log(p / (1 - p))]))

    def word_logits(self, words: list[bytes]) -> np.ndarray:
        """Each word's share of the logit: the mean over its n-grams."""
        sizes, flat = gram_table(words)
        return np.add.reduceat(self._logit[flat], np.cumsum(sizes) - sizes) / sizes

    def forget(self) -> None:
        """Let the words go that were met so far."""
        self._number, self._words = {}, np.zeros(0)

    def _numbers(self, texts: list[list[bytes]], most: int = 80_000) -> np.ndarray:
        """Numbers of all words in a row; words already met in this task are kept, up to a bound on memory."""
        if len(self._number) > most:
            self.forget()
        new = list(set().union(*texts).difference(self._number))
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            self._number.update(zip(part, range(len(self._number), len(self._number) + len(part))))
            self._words = np.concatenate([self._words, self.word_logits(part).astype(np.float32)])
        n = sum(map(len, texts))
        return np.fromiter((k for t in texts for k in map(self._number.__getitem__, t)), np.int32, n)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of the toxic class for each whole text."""
        words = [split(t) for t in texts]
        worst = np.zeros(len(texts))
        some = [k for k, ws in enumerate(words) if ws]
        if some:
            lengths = np.array([len(words[k]) for k in some])
            number = self._numbers([words[k] for k in some])
            logit = self._words[number]
            worst[some] = np.maximum(window_means(logit, number, lengths, 0), window_means(logit, number, lengths, WINDOW // 2))
        z = float(self.bias[1] - self.bias[0]) + SCALE * worst
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, docs: Iterable[list[bytes]], labels: list[int], prior: float, dim: int = 12, epochs: int = 8, rate: float = 1.0, batch: int = 64, min_docs: int = 5, floor: float = 1e-4, seed: int = 11) -> SubwordModel:
        """Softmax cross-entropy with AdaGrad steps on embeddings, weights and biases together. ``docs``: the words of each text, taken one text at a time.

        N-grams met in fewer than ``min_docs`` texts stay zero, and ``floor`` keeps AdaGrad from large steps on rare ones.
        Both classes weigh the same, as a missed toxic text costs more than a false alarm; ``prior``, the toxic share among all labels, serves only
        where the sample has one class. Windows are those that begin every ``WINDOW`` words.
        """
        bad = sum(labels)
        if not labels or bad in (0, len(labels)):
            return cls.constant((prior * len(labels) + 0.5) / (len(labels) + 1) if labels else 0.5, dim)
        rng = np.random.default_rng(seed)
        ids: dict[bytes, int] = {}
        rows = []  # for each text: its windows' distinct words in a row, and the windows' sizes
        for d in docs:
            wins = [list(dict.fromkeys(d[k : k + WINDOW])) for k in range(0, len(d), WINDOW)] or [[b""]]
            rows.append((np.array([ids.setdefault(w, len(ids)) for win in wins for w in win], np.int32), np.array([len(win) for win in wins], np.int32)))
        words = list(ids)
        del ids
        parts = [gram_table(words[at : at + 20_000]) for at in range(0, len(words), 20_000)]
        sizes, flat = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        offsets = np.cumsum(sizes) - sizes
        del words, parts

        def grams_of(vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Sizes, starts and buckets of some words."""
            n = sizes[vocab]
            starts = np.cumsum(n) - n
            return n, starts, flat[np.repeat(offsets[vocab] - starts, n) + np.arange(int(n.sum()))]

        met = np.zeros(N_BUCKETS, np.int64)
        for words_of, _ in rows:
            met[np.unique(grams_of(np.unique(words_of))[2])] += 1
        known = met >= min_docs
        emb = np.zeros((N_BUCKETS, dim), np.float32)
        emb[known] = rng.normal(0, 0.002, (int(known.sum()), dim))
        out, bias = rng.normal(0, 0.3, (2, dim)), np.zeros(2)
        g_emb, g_out, g_bias = np.full(N_BUCKETS, floor), np.full((2, dim), 1e-4), np.full(2, 1e-2)
        y = np.array(labels)
        class_weight = np.where(y == 1, (len(y) - bad) / bad, 1.0)  # both classes weigh the same
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                vocab, local = np.unique(np.concatenate([rows[k][0] for k in pick]), return_inverse=True)
                lengths = np.concatenate([rows[k][1] for k in pick])
                n_grams, starts, gram = grams_of(vocab)
                direction = out[1] - out[0]
                # The worst window of each text, by the model as it stands.
                logit = np.add.reduceat((emb @ direction)[gram], starts) / n_grams
                first = np.cumsum(lengths) - lengths
                window = np.add.reduceat(logit[local], first) / (lengths + PAD)
                per_doc = np.array([len(rows[k][1]) for k in pick])
                doc_first = np.cumsum(per_doc) - per_doc
                worst = np.array([f + int(window[f : f + n].argmax()) for f, n in zip(doc_first, per_doc)])
                chosen = np.concatenate([local[first[k] : first[k] + lengths[k]] for k in worst])
                doc_of = np.repeat(np.arange(len(pick)), lengths[worst])
                weight = SCALE / (lengths[worst] + PAD)[doc_of]
                used, chosen = np.unique(chosen, return_inverse=True)
                n_used, used_starts, used_gram = grams_of(vocab[used])
                vectors = np.add.reduceat(emb[used_gram], used_starts, axis=0) / n_used[:, None]
                mean = np.zeros((len(pick), dim))
                np.add.at(mean, doc_of, vectors[chosen] * weight[:, None])
                z = mean @ out.T + bias
                z -= z.max(axis=1, keepdims=True)
                err = np.exp(z)
                err /= err.sum(axis=1, keepdims=True)
                err[np.arange(len(pick)), y[pick]] -= 1
                err *= class_weight[pick][:, None] / len(pick)
                # Two classes: err[:, 0] = -err[:, 1], so every embedding moves along one direction.
                word_pull = np.bincount(chosen, err[doc_of, 1] * weight, len(used)) / n_used
                pull = np.bincount(used_gram, np.repeat(word_pull, n_used), N_BUCKETS)
                hit = np.nonzero(pull * known)[0]
                g_out_now, g_bias_now = err.T @ mean, err.sum(axis=0)
                g_emb[hit] += pull[hit] ** 2 * float(direction @ direction) / dim
                emb[hit] -= (rate * (pull[hit] / np.sqrt(g_emb[hit])))[:, None] * direction[None, :].astype(np.float32)
                g_out += g_out_now**2
                g_bias += g_bias_now**2
                out -= rate * g_out_now / np.sqrt(g_out)
                bias -= rate * g_bias_now / np.sqrt(g_bias)
        return cls(emb, out.astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, learn: F.Column, label: str = "toxic", max_train_rows: int = 9_000, max_train_bytes: int = MAX_TRAIN_BYTES) -> SubwordModel:
    """Fit on at most ``max_train_rows`` labelled texts of ``max_train_bytes`` together, taken in hash order, up to a third of them toxic."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_y"))
    totals = clean.agg(F.count("*").alias("n"), F.sum("_y").alias("bad")).first()
    third = max_train_rows // 3
    pick = lambda y, n: clean.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = bounded_sample(docs.select("doc_id", "text"), pick(1, third).unionByName(pick(0, max_train_rows - third)), max_train_bytes)
    got = sorted(((r[0], r[1], zlib.compress((r[2] or "").encode(), 1)) for r in sample.select("doc_id", "_y", "text").toLocalIterator()), reverse=True)
    labels_ = [y for _, y, _ in reversed(got)]
    prior = (totals["bad"] or 0) / totals["n"] if totals["n"] else 0.5

    def texts() -> Iterator[list[bytes]]:
        while got:  # each text is let go once it has been read
            yield split(zlib.decompress(got.pop()[2]))

    return SubwordModel.fit(texts(), labels_, prior)


def score(docs: DataFrame, model: SubwordModel, held_out: F.Column, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast((model.emb, model.out, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = SubwordModel(*shared.value)
        for b in batches:
            for start, size in slices(b, "text", SLICE_BYTES):
                p = m.score(text_bytes(b, "text", start, size))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, size), b.column(1).slice(start, size), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: SubwordModel, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is under the threshold, all columns as they came."""
    shared = docs.sparkSession.sparkContext.broadcast((model.emb, model.out, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = SubwordModel(*shared.value)
        for b in batches:
            for start, size in slices(b, "text", SLICE_BYTES):
                part = b.slice(start, size)
                yield part.filter(pa.array(m.score(text_bytes(b, "text", start, size)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_train_rows: int = 9_000) -> DataFrame:
    """Learn from rows outside the held-out fold (crc32(doc_id) mod 5 = 0), score all rows."""
    held = id_bucket("doc_id", 5) == 0
    return score(docs, train(docs, labels, ~held, max_train_rows=max_train_rows), held)
