"""Packing: concatenate all documents' token ids and cut the stream into fixed windows.

Pass one tokenises each whole text and writes its ids with the task's number and the running
offset inside the task; from then on the order is fixed. Pass two adds up the tasks' token
totals into prefix sums (one row a task), which give every document its global offset, and
cuts each document at multiples of the window. A document that crosses a boundary leaves a
record on either side; every id lies in one piece, and only the last window can be short.

Defined results: null and empty texts are the end id alone; null ids are packed; repeated
rows (ties) are packed each; a very long text is encoded whole, in memory that grows with it, and cut into as many pieces as it needs;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, text_bytes

END_ID = 1
WINDOW = 2048
#: Bytes of text encoded at a time, and pieces of a generation of the cache: smaller ones take less memory and more time, and give the same ids.
SLICE_BYTES, CACHED = 8_000_000, 250_000


def default_tokenizer() -> str:
    """Where the public word-level BPE file lies; the path is a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII marks that close a word after an ASCII or Latin letter or a digit are one token's text wherever they stand. The dotted capital I is left out: lowered, it ends in a combining mark.
_CLOSING = re.compile("([!-/:-@\\[-`{-~](?<=[a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f].)[!-/:-@\\[-`{-~]*)(?=[\\x20\\x09-\\x0D]|\\Z)")


#: Runs of ASCII and Latin letters that lower-casing and composition leave as they are.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f]+")


def pieces(text: bytes) -> list[bytes]:
    """White-space words of a text, A-Z lower-cased and closing marks parted: what the tokenizer does itself, done first so that fewer distinct pieces are left.

    A text that may hold a special token's name is cut at white space alone, as such names are matched before letters are lowered.
    """
    return text.split() if b"<|" in text else _CLOSING.sub(r" \1", text.lower().decode("utf-8")).encode("utf-8").split()


def cuts_words(config: dict) -> bool:
    """Whether a tokenizer's file says what ``pieces`` relies on: case and composition are normalised, words are cut at white space and marks, white space is dropped, word ends are marked."""
    normalisers = [x.get("type") for x in (config.get("normalizer") or {}).get("normalizers", [])]
    cutters = (config.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    cut = cutters[0]
    return (
        normalisers == ["NFC", "Replace", "Lowercase"]
        and [x.get("type") for x in cutters] == ["Split", "ByteLevel"]
        and (cut.get("behavior"), cut.get("invert"), cutters[1].get("add_prefix_space")) == ("Removed", True, False)
        and (cut.get("pattern") or {}).get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and (config["model"].get("type"), config["model"].get("end_of_word_suffix"), config["model"].get("dropout")) == ("BPE", "</w>", None)
        and all(t["content"].startswith("<|") for t in config.get("added_tokens", []))
    )


class WordCache:
    """Ids of pieces, each encoded once while it stays in use; with a tokenizer that does not cut words, whole texts are encoded.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    pieces in order. Two generations of at most ``most`` pieces bound memory: when the young one
    is full it becomes the old one, and a piece found there moves back, so frequent pieces stay.
    """

    def __init__(self, path: str, most: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            self.by_pieces = cuts_words(json.load(f))
        self.ids: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a run of letters
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each whole text, without the end id."""
        if not self.by_pieces:
            return [np.array(x, "<u4").tobytes() for x in self._encode(texts)]
        split = [pieces(t) for t in texts]
        if len(self.ids) > self.most:
            self.ids, self.old = {}, self.ids
        new = set().union(*split).difference(self.ids)
        kept = new.intersection(self.old)
        self.ids.update((w, self.old[w]) for w in kept)
        unseen = new - kept
        plain = [w for w in unseen if _LETTERS.fullmatch(w.decode("utf-8"))]
        for at in range(0, len(plain), 1_000):
            part = plain[at : at + 1_000]
            # Runs of letters in one text: each ends in an id that closes it, so one call serves them all.
            ids = np.array(self._encode([b" ".join(part)])[0], "<u4")
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
            if len(ends) == len(part):
                data = ids.tobytes()
                self.ids.update(zip(part, (data[i:j] for i, j in zip([0, *ends], ends))))
        rest = list(unseen.difference(self.ids))
        for at in range(0, len(rest), 1_000):
            part = rest[at : at + 1_000]
            self.ids.update(zip(part, (np.array(x, "<u4").tobytes() for x in self._encode(part))))
        get = self.ids.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def _encode(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)]


_caches: dict[tuple[str, int], WordCache] = {}


def word_cache(path: str, most: int = CACHED) -> WordCache:
    """The cache of this Python worker, which serves many tasks; one at a time."""
    if (path, most) not in _caches:
        _caches.clear()
        _caches[path, most] = WordCache(path, most)
    return _caches[path, most]


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, slice_bytes: int = SLICE_BYTES, cached: int = CACHED) -> DataFrame:
    """(doc_id, ids, n, part, local): ids as bytes with the end id, the task and the offset inside it."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, local = word_cache(tokenizer_path, cached), TaskContext.get().partitionId(), 0
        for b in batches:
            for start, size in slices(b, "text", slice_bytes):
                ids = [x + end for x in cache.encode(text_bytes(b, "text", start, size))]
                n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                offsets = local + np.cumsum(n) - n
                local += int(n.sum())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, size), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(ids), part, np.int32)), pa.array(offsets)], ["doc_id", "ids", "n", "part", "local"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, n long, part int, local long")


def cut(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents with their ids as bytes (column ``piece``)."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))  # a row a task of pass one
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    at = tokens.join(F.broadcast(starts), "part").withColumn("first", F.col("base") + F.col("local"))
    windows = F.sequence(F.floor(F.col("first") / window), F.floor((F.col("first") + F.col("n") - 1) / window))
    pieces = at.withColumn("sequence_id", F.explode(windows)).withColumn("from", F.greatest(F.col("first"), F.col("sequence_id") * window))
    length = F.least(F.col("first") + F.col("n"), (F.col("sequence_id") + 1) * window) - F.col("from")
    return pieces.select(
        "doc_id", (F.col("from") - F.col("first")).alias("start"), length.alias("length"), F.col("n").alias("doc_tokens"), "sequence_id", (F.col("from") - F.col("sequence_id") * window).alias("offset"),
        F.substring("ids", ((F.col("from") - F.col("first")) * 4 + 1).cast("int"), (length * 4).cast("int")).alias("piece"),
    )


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, slice_bytes: int = SLICE_BYTES, cached: int = CACHED) -> DataFrame:
    """One row a piece, with the checksum of its ids."""
    tokens = materialise(token_table(docs, tokenizer_path or default_tokenizer(), slice_bytes=slice_bytes, cached=cached), "tokens")
    pieces = cut(tokens, window).withColumn("ids_crc32", F.crc32("piece"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Whole sequences: (sequence_id, ids array), the last one padded."""
    tokens = materialise(token_table(docs, tokenizer_path or default_tokenizer()), "tokens")

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("offset")
        ids = np.frombuffer(b"".join(rows.column("piece").to_pylist()), "<u4").astype(np.int32)
        ids = np.pad(ids, (0, window - len(ids)), constant_values=pad_id)
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids.tolist()], pa.list_(pa.int32()))})

    return cut(tokens, window).select("sequence_id", "offset", "piece").groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids array<int>")
