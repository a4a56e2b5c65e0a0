"""LM scoring: a weighted backoff automaton.

States are histories: the empty one, single words, and pairs of words, each where training has met
it. The arc (h, w) carries log10 p(w | h) for each n-gram h w seen in training and leads to the
longest history that ends h w; the failure arc of h carries the log10 of the mass that h leaves
and leads to h without its first word; the empty history has an arc for every word. One
left-to-right traversal carries the state from token to token, follows failure arcs until an arc
takes the token, and adds up log-probabilities.

    p(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | h) = (c(h w) + M p(w | h')) / (c(h) + M)      h' is h without its first word, M = MASS[length of h]

so an n-gram never seen costs exactly the failure arc M / (c(h) + M) and then p(w | h').

All counts are sums over all training rows, and grow with the corpus; none is held whole
anywhere. Documents are cut into blocks of about ``BLOCK_TOKENS`` tokens. A block asks for the
counts of its own distinct words, pairs and triples (hashes with its own training counts, packed as
bytes). Questions climb a tree of fixed fan: a node gathers the questions of at most about ``FAN`` blocks or nodes
on one range of the hash, adds up equal ones, and cuts its range for ``ranges`` nodes
above; the top answers, and answers go down the same way. Messages are thus ``ranges`` a block and level, the levels
the logarithm of the number of blocks, and a node's work is bounded; a frequent word is one
entry a child, so no key is hot. The block then builds the part of the automaton that its texts can
reach and traverses it.

Words are told apart by 64-bit hashes. Pairs and triples are told apart by ``SPARE_BITS`` bits more than number
the corpus's entries, so that fewer than one entry in 2^SPARE_BITS meets another's hash at any size.

Defined results: null and empty texts have the end token alone; null ids are scored, held out
by the crc32 of the empty text; repeated rows (ties) count and are scored each; a very long text is a block of
its own and is traversed whole; extra columns are ignored; an empty table gives no rows; with no training rows every token has the one
probability 0.5 / 0.5 = 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, materialise, slices, text_bytes

ORDER = 3
BLOCK_TOKENS = 1_500_000
#: Children that a node of the tree gathers, about; and the most ranges that it deals their entries to.
FAN = 256
#: Entries that a range of one level should get, all blocks together, before there are more of them.
RANGE_ENTRIES = 50_000
#: Pseudo-count of the shorter history, by the length of the history.
MASS = (0.0, 1000.0, 20.0)
SPARE_BITS = 24
#: Tokens that one step of runs reads: a long text is traversed in runs side by side.
RUN = 256
#: Hash of the end token; words never are this text, as it holds a blank.
END = np.uint64(xxhash.xxh64_intdigest(b" end "))
_START = np.uint64(xxhash.xxh64_intdigest(b" start "))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> np.ndarray:
    """Hashes of a whole text's words, A-Z lower-cased, and of the end token."""
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def gram_hashes(before: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each word put before an n-gram."""
    with np.errstate(over="ignore"):
        x = before * _ODD
        x ^= x >> np.uint64(29)
        x = (x + gram) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return x * np.uint64(0x94D049BB133111EB)


class Block:
    """Documents of one block. ``hashes[k]``: its sorted distinct n-grams of k + 1 words; ``grams[k]``: which of them each token ends."""

    def __init__(self, vocab: np.ndarray, ids: np.ndarray, lengths: np.ndarray, trains: np.ndarray, order: int = ORDER):
        self.lengths, self.trains, self.order = lengths, trains, order
        self.first = np.cumsum(lengths) - lengths
        self.token_trains = np.repeat(trains, lengths)
        self.hashes, self.grams = [vocab], [ids]
        before = gram = vocab[ids]
        for _ in range(1, order):
            before = self._behind(before, _START)
            gram = gram_hashes(before, gram)
            distinct, of = np.unique(gram, return_inverse=True)
            self.hashes.append(distinct)
            self.grams.append(of.astype(np.int32))

    def _behind(self, x: np.ndarray, start) -> np.ndarray:
        """What stands one token earlier in the document; ``start`` before its first token."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = start
        return out

    @classmethod
    def of(cls, docs: list[np.ndarray], trains: list[bool], order: int = ORDER) -> Block:
        vocab, ids = np.unique(np.concatenate(docs), return_inverse=True)
        return cls(vocab, ids.astype(np.int32), np.array([len(d) for d in docs]), np.array(trains, bool), order)

    def counts(self, k: int) -> np.ndarray:
        """The block's own training counts of its n-grams of k + 1 words."""
        return np.bincount(self.grams[k][self.token_trains], minlength=len(self.hashes[k]))

    def starts(self) -> int:
        return int(self.trains.sum())


class Automaton:
    """The part of the backoff automaton that a block's texts can reach.

    States are numbered by length of history: 0 is empty, then one for each of the block's words and one for the
    start, then one for each longer n-gram. ``arc[k]``, ``target[k]``: weight (NaN: not in the automaton) and next state
    of the arcs from histories of k words, by the number of the n-gram that history and token make.
    ``back``, ``fall``: weight and target of each state's failure arc.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], n: int, v: int, n_starts: int, mass: tuple[float, ...] = MASS):
        self.block, self.counts = block, counts
        top = block.order - 1  # words of the longest history
        sizes = [1, len(counts[0]) + 1, *map(len, counts[1:top])][: top + 1]
        self.base_of = np.cumsum([0, *sizes])  # first state of each length
        self.length = np.repeat(np.arange(top + 1), sizes)
        self.back, self.fall = np.zeros(self.base_of[-1]), np.zeros(self.base_of[-1], np.int32)
        self.start_state = self.base_of[1] + len(counts[0]) if top else 0
        p = (counts[0] + 0.5) / (n + 0.5 * (v + 1))
        self.arc = [np.log10(p)]
        # For each n-gram a token that ends it; its history and shorter forms are those of that token.
        for k in range(1, block.order):
            last = np.empty(len(counts[k]), np.int64)
            last[block.grams[k]] = np.arange(len(block.grams[k]))
            shorter = p[block.grams[k - 1][last]]
            history = self._history_counts(k, n_starts)[last]
            p = (counts[k] + mass[k] * shorter) / (history + mass[k])
            self.arc.append(np.where(counts[k] > 0, np.log10(p), np.nan))
            # The history of k words is itself an n-gram of order k: its failure arc.
            states = self._states(k)[last]
            inside = states > 0  # a first token has no longer history than the start
            self.back[states[inside]] = np.log10(mass[k] / (history + mass[k]))[inside]
            self.fall[states[inside]] = 0 if k == 1 else self._states(k - 1)[last][inside]
        self.target = [self._targets(k) for k in range(block.order)]

    def _history_counts(self, k: int, n_starts: int) -> np.ndarray:
        """How often training has the k words before each token, followed by any token."""
        b = self.block
        return b._behind(self.counts[k - 1][b.grams[k - 1]].astype(np.float64), n_starts if k == 1 else 0)

    def _states(self, k: int) -> np.ndarray:
        """The state of the k words before each token; a document's first token has the start alone before it."""
        b = self.block
        return b._behind(self.base_of[k] + b.grams[k - 1].astype(np.int32), self.start_state if k == 1 else 0)

    def _targets(self, k: int) -> np.ndarray:
        """The longest history that training has met among the ends of each n-gram of k + 1 words."""
        b, top = self.block, self.block.order - 1
        out = np.zeros(len(self.counts[k]), np.int32)
        last = np.empty(len(out), np.int64)
        last[b.grams[k]] = np.arange(len(b.grams[k]))
        for length in range(1, min(k + 1, top) + 1):
            gram = b.grams[length - 1][last]
            out = np.where(self.counts[length - 1][gram] > 0, self.base_of[length] + gram, out).astype(np.int32)
        return out

    def traverse(self, run: int = RUN) -> np.ndarray:
        """log10 probability of each document.

        Runs of ``run`` tokens move in step, each with its own state. A state remembers ``order`` - 1 words, so
        a run inside a document first reads that many tokens before it without adding them up.
        """
        b = self.block
        warm = b.order - 1
        pieces = -(-b.lengths // run)
        doc = np.repeat(np.arange(len(b.lengths)), pieces)
        begin = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * run
        end = np.minimum(begin + run, b.lengths[doc])
        lead = np.minimum(begin, warm)
        order = np.argsort(begin - lead - end, kind="stable")  # most tokens first, so that those still moving are a prefix
        doc, begin, end, lead = doc[order], begin[order], end[order], lead[order]
        # At a document's first token the state is the start; a run inside it starts from nothing and reads its way in.
        state = np.where(begin - lead == 0, self.start_state, 0).astype(np.int32)
        at = b.first[doc] + begin - lead
        left = end - begin + lead
        total = np.zeros(len(doc))
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, "left"))
            weight, state[:live] = self._step(state[:live], at[:live] + step)
            total[:live] += np.where(step >= lead[:live], weight, 0.0)
        return np.bincount(doc, total, len(b.lengths))

    def _step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight and next state of each run on its token: failure arcs until an arc takes it."""
        weight, after = np.zeros(len(state)), np.zeros(len(state), np.int32)
        todo = np.arange(len(state))
        here, token = state.copy(), token.copy()
        for k in range(self.block.order - 1, -1, -1):
            at = np.flatnonzero(self.length[here] == k)
            gram = self.block.grams[k][token[at]]
            arc = self.arc[k][gram]
            takes = ~np.isnan(arc)
            hit = at[takes]
            weight[todo[hit]] += arc[takes]
            after[todo[hit]] = self.target[k][gram[takes]]
            miss = at[~takes]
            weight[todo[miss]] += self.back[here[miss]]
            here[miss] = self.fall[here[miss]]
            rest = np.ones(len(here), bool)
            rest[hit] = False
            todo, here, token = todo[rest], here[rest], token[rest]
        return weight, after

    def base(self) -> np.ndarray:
        return np.add.reduceat(self.arc[0][self.block.grams[0]], self.block.first)

    def known(self) -> np.ndarray:
        return np.add.reduceat((self.counts[0] > 0)[self.block.grams[0]].astype(np.int64), self.block.first)


def _squeeze(x: np.ndarray) -> bytes:
    """Bytes of an array, byte planes together, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def _spread(data: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel()


def _gaps(sorted_hashes: np.ndarray) -> bytes:
    return _squeeze(np.diff(sorted_hashes, prepend=np.uint64(0)).astype("<u8"))


def _from_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(_spread(data, "<u8"), dtype=np.uint64)


def blocks(docs: DataFrame, learn: F.Column, block_tokens: int = BLOCK_TOKENS, order: int = ORDER) -> DataFrame:
    """One row a block: its documents' ids, lengths and folds, its distinct words and its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        folds: list[bool] = []
        docs_: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            b = Block.of(docs_, folds, order)
            row = [part << 32 | number, list(ids), list(folds), b.lengths.tolist(), _gaps(b.hashes[0]), _squeeze(b.grams[0].astype("<u4")), sum(map(len, b.hashes)), int(b.lengths[b.trains].sum())]
            number += 1
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["block", "ids", "trains", "lengths", "vocab", "tokens", "entries", "n"])

        for b in batches:
            for start, size in slices(b, "text"):
                got_ids, got_folds = b.column(0).slice(start, size).to_pylist(), b.column(1).slice(start, size).to_pylist()
                for i, fold, text in zip(got_ids, got_folds, text_bytes(b, "text", start, size)):
                    t = tokens(text)
                    ids.append(i)
                    folds.append(bool(fold))
                    docs_.append(t)
                    total += len(t)
                    if total >= block_tokens:
                        yield flush()
                        ids, folds, docs_, total = [], [], [], 0
        if docs_:
            yield flush()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), learn.alias("trains"), "text")
    return narrow.mapInArrow(run, "block long, ids array<long>, trains array<boolean>, lengths array<long>, vocab binary, tokens binary, entries long, n long")


def _block(row: dict, order: int) -> Block:
    return Block(_from_gaps(row["vocab"]), _spread(row["tokens"], "<u4").astype(np.int32), np.array(row["lengths"], np.int64), np.array(row["trains"], bool), order)


ASKS = "kind int, node long, child long, part int, hashes binary, counts binary"
TOTALS = "kind int, child long, part int, counts binary, v long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _deal(hashes: np.ndarray, counts: np.ndarray, path: int, cells: int, ranges: int, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Cut the sorted hashes of range ``path`` into its ``ranges`` parts, of ``cells`` in all on this level: (part, hashes, counts) of those that are not empty."""
    bounds = np.array([(k << bits) // cells for k in range(path * ranges + 1, (path + 1) * ranges)], np.uint64)
    cuts = [0, *np.searchsorted(hashes, bounds), len(hashes)]
    for part, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        if hi > lo:
            yield part, _gaps(hashes[lo:hi]), _squeeze(counts[lo:hi].astype("<u8"))


class Tree:
    """How questions climb: ``herds`` of blocks on the lowest level, the fan, ranges a node, and the bits of each kind's hashes."""

    def __init__(self, n_blocks: int, n_entries: int, order: int, fan: int, range_entries: int):
        self.fan, self.order = fan, order
        self.herds = max(1, -(-n_blocks // fan))
        self.ranges = min(fan, max(1, -(-n_entries // range_entries)))
        self.bits = [64] + [min(64, n_entries.bit_length() + SPARE_BITS)] * (order - 1)

    def of_block(self, block: int) -> int:
        return xxhash.xxh64_intdigest(block.to_bytes(8, "little")) % self.herds


def asks(table: DataFrame, tree: Tree) -> DataFrame:
    """What each block asks of the lowest nodes. Kind k: n-grams of k + 1 words; ``node`` is herd and range in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b, herd = _block(row, tree.order), tree.of_block(row["block"])
                for k in range(tree.order):
                    short = b.hashes[k] >> np.uint64(64 - tree.bits[k])
                    yield _batch([(k, herd * tree.ranges + part, row["block"], part, h, c) for part, h, c in _deal(short, b.counts(k), 0, tree.ranges, tree.ranges, tree.bits[k])], ASKS)

    return table.select("block", "ids", "trains", "lengths", "vocab", "tokens").mapInArrow(run, ASKS)


def _gathered(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of a node's questions: for each, where its entries are among the distinct ones; the distinct hashes; their sums."""
    hashes = [_from_gaps(x) for x in rows.column("hashes").to_pylist()]
    own = np.concatenate([_spread(x, "<u8") for x in rows.column("counts").to_pylist()])
    distinct, where = np.unique(np.concatenate(hashes), return_inverse=True)
    at = np.cumsum([0, *map(len, hashes)])
    return [where[a:b] for a, b in zip(at, at[1:])], distinct, np.bincount(where, own, len(distinct)).astype("<u8")


def _replies(rows: pa.Table, kind: int, where: list[np.ndarray], total: np.ndarray, v: int) -> pa.Table:
    """An answer to each question; ``v`` goes with the first."""
    children, parts = rows.column("child").to_pylist(), rows.column("part").to_pylist()
    out = [(kind, child, part, _squeeze(total[w]), 0 if i else v) for i, (child, part, w) in enumerate(zip(children, parts, where))]
    return pa.Table.from_batches([_batch(out, TOTALS)])


def totals(asked: DataFrame, tree: Tree, herds: int, level: int = 0) -> DataFrame:
    """(kind, child, part, counts, v): the corpus counts of each question's entries, in the order asked; ``v`` adds up to the distinct training words."""
    if herds == 1:

        def answer(key: tuple, rows: pa.Table) -> pa.Table:
            kind = key[0].as_py()
            where, _, total = _gathered(rows)
            return _replies(rows, kind, where, total, 0 if kind else int((total > 0).sum()))

        return asked.groupBy("kind", "node").applyInArrow(answer, TOTALS)
    asked = materialise(asked, "asks")
    cells, above = tree.ranges ** (level + 1), -(-herds // tree.fan)

    def climb(key: tuple, rows: pa.Table) -> pa.Table:
        kind, node = key[0].as_py(), key[1].as_py()
        herd, path = divmod(node, cells)
        _, distinct, total = _gathered(rows)
        up = [(kind, (herd % above) * cells * tree.ranges + path * tree.ranges + part, node, part, h, c) for part, h, c in _deal(distinct, total, path, cells * tree.ranges, tree.ranges, tree.bits[kind])]
        return pa.Table.from_batches([_batch(up, ASKS)])

    answered = totals(asked.groupBy("kind", "node").applyInArrow(climb, ASKS), tree, above, level + 1)

    def hand_down(key: tuple, rows: pa.Table, got: pa.Table) -> pa.Table:
        where, _, _ = _gathered(rows)
        got = got.sort_by("part")
        total = np.concatenate([_spread(x, "<u8") for x in got.column("counts").to_pylist()])
        return _replies(rows, key[0].as_py(), where, total, sum(got.column("v").to_pylist()))

    return asked.groupBy("kind", "node").cogroup(answered.groupBy("kind", "child")).applyInArrow(hand_down, TOTALS)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def backoff_scores(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, mass: tuple[float, ...] = MASS, order: int = ORDER, fan: int = FAN, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """Learn from rows outside the held-out fold (crc32(doc_id) mod 5 = 1), score all rows. ``mass`` has a number for each history length under ``order``."""
    table = materialise(blocks(docs, id_bucket("doc_id", 5) != 1, block_tokens, order), "blocks")
    shape = table.agg(F.count("*").alias("blocks"), F.sum("entries").alias("entries"), F.sum("n").alias("n"), F.sum(F.size(F.filter("trains", lambda t: t))).alias("starts")).first()
    tree = Tree(shape["blocks"], shape["entries"] or 0, order, fan, range_entries)
    replies = materialise(totals(asks(table, tree), tree, tree.herds), "counts")
    n, v, starts = shape["n"] or 0, replies.agg(F.sum("v").alias("v")).first()["v"] or 0, shape["starts"] or 0

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        b = _block(row, order)
        got = sorted(zip(*(right.column(x).to_pylist() for x in ("kind", "part", "counts"))))
        counts = [np.concatenate([_spread(c, "<u8") for kind, _, c in got if kind == k]).astype(np.float64) for k in range(order)]
        a = Automaton(b, counts, n, v, starts, mass)
        size = len(b.lengths)
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array((~b.trains).tolist()), "n_tokens": pa.array(b.lengths), "n_known": pa.array(a.known()), "train_tokens": pa.array(np.full(size, n, np.int64)), "base_score": pa.array(a.base()), "score": pa.array(a.traverse())})

    return table.select("block", "ids", "trains", "lengths", "vocab", "tokens").groupBy("block").cogroup(replies.select("child", "kind", "part", "counts").groupBy("child")).applyInArrow(run, SCHEMA)
