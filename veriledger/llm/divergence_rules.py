"""Quality rules: Jensen-Shannon distance of a text's histograms from language references.

Two histograms are taken of each whole text: character classes and, for each reference
language, its common words (all other words share a last bin). The references are the corpus's
own, over all rows: a language tag with ``MIN_SUPPORT`` long enough documents gets the medians and means of
its documents; its common words are the fixed list below or, for other languages, the most frequent words of
all its documents. A listed language with less support keeps its round built-in reference. A text passes when
for some one language both distances are under their bounds. Texts under ``min_words`` words carry too
little mass for a distance and are judged by the base rules alone, and so are texts tagged with a
language that has no reference, as there is nothing to measure them against.

Defined results: null text has no words; null, empty and very short texts fail the base rule
(fewer than 50 words) and are not kept; null languages are compared with every
reference; very long texts are read whole (a text's words are held in memory, some fifty bytes each); among languages that fit
equally well (ties) the first by name is reported; repeated rows are judged each; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_bytes

#: Frequent function words.
COMMON_WORDS = {
    "en": "the of and to a in is that for it was on are with as be this by at from or an not have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "other_ascii", "beyond_ascii")
#: Which class an ASCII character has.
_CLASS_OF = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\n\v\f\r",
    "stop": b".,;:'\"()-", "mark": b"!?", "symbol": b"#*$%&|<>",
}
_SYMBOLS = _CLASS_OF["symbol"]
_SPACE = _CLASS_OF["space"]
_CONTINUATION = bytes(range(0x80, 0xC0))
_EDGE = b".,;:!?\"'()#*$%&|<>"
_FOLD = bytes.maketrans(_CLASS_OF["upper"] + _EDGE, _CLASS_OF["lower"] + b" " * len(_EDGE))
_FIRST = np.zeros(256, np.int64)
for _k, _name in enumerate(CLASSES):
    for _c in _CLASS_OF.get(_name, b""):
        _FIRST[_c] = _k
_named = set(b"".join(_CLASS_OF.values()))
for _c in range(256):
    if _c not in _named:
        _FIRST[_c] = 7 if _c < 128 else 8
_FIRST[0x80:0xC0] = 9  # continuation bytes belong to no character of their own

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_CHAR_DISTANCE = 0.14
MAX_WORD_DISTANCE = 0.42
#: Histograms of short texts wander: the bounds widen by this over the square root of the words.
SLACK = 0.5
#: Documents of ``MIN_WORDS`` words that a tag needs to have a reference, and the share of all rows that it needs (so tags are no more than its reciprocal).
MIN_SUPPORT, MIN_SHARE = 20, 1e-4
#: Common words learned for a language that has no list.
N_COMMON = 30
#: Shares of character classes are counted in this many bins, even in the square root, to find medians.
SHARE_BINS = 512


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a three-word window that occurs twice or more in the text."""
    grams = list(zip(words, words[1:], words[2:]))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    covered = bytearray(len(words))
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return sum(covered)


def base_counts(data: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    chars = len(data) - len(data.translate(None, _SPACE)) + len(data) - len(data.translate(None, _CONTINUATION))
    lines = [x for x in data.split(b"\n") if x.strip()] if b"\n" in data else []
    return len(data) - chars, len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def char_histogram(data: bytes) -> np.ndarray:
    """Characters by class."""
    return np.bincount(_FIRST[np.frombuffer(data, np.uint8)], minlength=10)[:9].astype(np.float64)


class Reference(NamedTuple):
    """Histograms of a language, and the common words that the second one counts."""

    chars: np.ndarray
    words: np.ndarray
    common: list[bytes]


def word_histogram(counts: Counter, total: int, common: list[bytes]) -> np.ndarray:
    """Counts of the common words and, last, of all other words."""
    h = np.fromiter((counts[w] for w in common), np.float64, len(common))
    return np.append(h, total - h.sum())


def folded_words(data: bytes) -> list[bytes]:
    """Words in lower case; punctuation parts words here."""
    return data.translate(_FOLD).split()


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the base-2 Jensen-Shannon divergence of two histograms, 0 to 1; empty ones are at 1."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def common_words(docs: DataFrame) -> dict[str, list[bytes]]:
    """The common words of each language: the lists above and, for other tags of enough rows, their most frequent words.

    Words are counted by Spark over all rows of such tags; the driver gets ``N_COMMON`` words a tag.
    """
    out = {x: [w.encode() for w in v] for x, v in COMMON_WORDS.items()}
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"))
    other = F.col("lang").isNotNull() & ~F.col("lang").isin(*COMMON_WORDS)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tags = [r.lang for r in sizes.where(other & (F.col("n") >= max(MIN_SUPPORT, MIN_SHARE * total))).collect()]  # at most 1 / MIN_SHARE
    if not tags:
        return out
    signs = (_EDGE + _CLASS_OF["upper"]).decode()
    plain = F.translate("text", signs, " " * len(_EDGE) + _CLASS_OF["lower"].decode())
    words = docs.where(F.col("lang").isin(*tags)).select("lang", F.explode(F.split(plain, r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    for r in counted.withColumn("place", place).where(F.col("place") <= N_COMMON).orderBy("lang", "place").collect():
        out.setdefault(r.lang, []).append(r.word.encode())
    return out


def references(docs: DataFrame) -> dict[str, Reference]:
    """Character-class and common-word histograms of each reference language, over all documents.

    Characters: the median of the documents' shares of each class, which junk does not move as it
    moves a mean. Words: the mean of their shares. Each task adds up its own rows to counts of
    fixed size, so a few numbers a language reach the driver.
    """
    common = common_words(docs)
    n = len(CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars: dict[str, np.ndarray] = {}
        shares: dict[str, np.ndarray] = {}
        for b in batches:
            for start, size in slices(b, "text"):
                tags = b.column(b.schema.get_field_index("lang")).slice(start, size).to_pylist()
                for t, lang in zip(text_bytes(b, "text", start, size), tags):
                    if lang in common and len(t.split(None, MIN_WORDS)) > MIN_WORDS:
                        if lang not in chars:
                            chars[lang], shares[lang] = np.zeros((n, SHARE_BINS)), np.zeros(len(common[lang]) + 1)
                        h = char_histogram(t)
                        chars[lang][np.arange(n), (np.sqrt(h / h.sum()) * (SHARE_BINS - 1)).astype(int)] += 1
                        words = folded_words(t)
                        shares[lang] += word_histogram(Counter(words), len(words), common[lang]) / max(1, len(words))
        out = [(x, int(k), float(flat[k])) for x in chars for flat in [np.concatenate([chars[x].ravel(), shares[x]])] for k in np.nonzero(flat)[0]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.float64()))], ["lang", "k", "x"])

    parts = docs.select("text", "lang").mapInArrow(run, "lang string, k int, x double")
    got = {(r.lang, r.k): r.x for r in parts.groupBy("lang", "k").agg(F.sum("x").alias("x")).collect()}  # at most languages x bins numbers
    out = {x: built_in(x) for x in COMMON_WORDS}
    for lang, words in common.items():
        counts = np.array([[got.get((lang, c * SHARE_BINS + k), 0.0) for k in range(SHARE_BINS)] for c in range(n)])
        w = np.array([got.get((lang, n * SHARE_BINS + k), 0.0) for k in range(len(words) + 1)])
        if counts[0].sum() >= MIN_SUPPORT:
            median = (np.cumsum(counts, axis=1) >= counts.sum(axis=1, keepdims=True) / 2).argmax(axis=1)
            out[lang] = Reference((median / (SHARE_BINS - 1)) ** 2, w, words)
    return out


def built_in(lang: str) -> Reference:
    """Where the corpus has too little tagged text: round shares of character classes, and common words at a third of all words, falling with rank."""
    n = len(COMMON_WORDS[lang])
    fall = 1 / np.arange(1, n + 1)
    return Reference(np.array([0.78, 0.03, 0.005, 0.16, 0.02, 0.001, 0.001, 0.001, 0.002]), np.append(fall / fall.sum() / 3, 2 / 3), [w.encode() for w in COMMON_WORDS[lang]])


def fit(data: bytes, refs: dict[str, Reference]) -> tuple[float, float, str]:
    """Distances of the language that fits best: characters, words, and its name."""
    chars, words = char_histogram(data), folded_words(data)
    counts = Counter(words)
    found = [(jensen_shannon(chars, r.chars), jensen_shannon(word_histogram(counts, len(words), r.common), r.words), x) for x, r in refs.items()]
    return min(found, key=lambda f: (max(f[0] / MAX_CHAR_DISTANCE, f[1] / MAX_WORD_DISTANCE), f[2]))


def judge(data: bytes, lang: str | None, refs: dict[str, Reference]) -> tuple:
    """n_words, the four base counts, base_failed, kept, char_distance, word_distance, fitted language."""
    words = data.split()
    n = len(words)
    base = base_counts(data, words)
    failed = n < MIN_WORDS or 100 * base[3] > MAX_REPEAT_PERCENT * n
    if n < MIN_WORDS:
        return n, *base, failed, False, None, None, None
    char, word, fitted = fit(data, refs)
    slack = SLACK / n**0.5
    near = char <= MAX_CHAR_DISTANCE + slack and word <= MAX_WORD_DISTANCE + slack
    return n, *base, failed, not failed and (near or lang is not None and lang not in refs), char, word, fitted


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double, fitted_lang string"


def quality_rules(docs: DataFrame) -> DataFrame:
    """One judged row for each document row."""
    refs = references(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2 + [pa.string()]
        for b in batches:
            for start, size in slices(b, "text"):
                tags = b.column(2).slice(start, size).to_pylist()
                rows = [judge(t, lang, refs) for t, lang in zip(text_bytes(b, "text", start, size), tags)]
                columns = [b.column(0).slice(start, size), *(pa.array([r[k] for r in rows], kinds[k + 1]) for k in range(10))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(run, SCHEMA)


def keep_passing(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, all columns as they came."""
    refs = references(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, size in slices(b, "text"):
                tags = b.column(b.schema.get_field_index("lang")).slice(start, size).to_pylist()
                yield b.slice(start, size).filter(pa.array([judge(t, lang, refs)[6] for t, lang in zip(text_bytes(b, "text", start, size), tags)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
