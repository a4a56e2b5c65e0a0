"""Each training-data operator against a brute-force version, on rows with every awkward case."""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from veriledger.llm import backoff_lm, common, decontaminate, divergence_rules, fm_quality, hilbert_shards, line_block_html, pack_concat, simhash_dedup, subword_toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, component_id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def corpus(n=160, seed=3):
    """Prose, copies, near copies, junk, empty and null texts, repeated rows, a null id, a very long text."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "and", "to", "a", "in", "Idiot", "é€", "x y"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(n)]
    texts += [texts[0]] * 40 + [texts[1] + " tail", texts[1].upper(), "", None, " \t\n", "one", "one two", "Orre " * 300, "### $$$ %%% " * 40, "a\x1cb c d. e, f"]
    base = rng.choices(words, k=400)
    for k in range(30):
        near = list(base)
        near[k * 13] = f"changed{k}"
        texts.append(" ".join(near))
    texts.append(" ".join(rng.choices(words, k=40_000)))
    rows = [(i, t, rng.choice(["en", "de", "fr", None]), rng.choice(["src0", "src0", "src1", None]), None if t is None else len(t), 1.0, 7, "clash") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "no id here", "en", "src0", 10, 1.0, 7, "clash"), (None, texts[0], "en", None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, rows, rule):
    return spark.createDataFrame([(r[0], rule(r[1] or ""), rule(r[1] or "")) for r in rows if r[0] is not None and r[0] % 2 == 0] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


# ---- op1, op5 -------------------------------------------------------------------------------


def test_fm_identity_is_the_pairwise_sum():
    rng = np.random.default_rng(0)
    m = fm_quality.FactorisationMachine(0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32))
    idx, x = np.array([3, 7, 20, 41]), np.array([0.5, 1.0, 2.0, 0.25], np.float32)
    pairs = sum(float(m.v[i] @ m.v[j]) * a * b for (i, a), (j, b) in itertools.combinations(zip(idx, x), 2))
    assert m.margins([(idx, x)])[0] == pytest.approx(0.3 + float(m.w[idx] @ x) + pairs, rel=1e-4)


@pytest.mark.parametrize("module", [fm_quality, subword_toxicity])
def test_classifiers_score_every_row(spark, docs, rows, nothing, module):
    run = fm_quality.quality_scores if module is fm_quality else subword_toxicity.toxicity_scores
    mod, fold, cut = (4, 2, 0.7) if module is fm_quality else (5, 0, 0.5)
    got = run(docs, labels_of(spark, rows, lambda t: int("w1" in t))).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % mod == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    assert run(nothing, labels_of(spark, rows, lambda t: 1)).count() == 0
    none = run(docs, labels_of(spark, [], lambda t: 1)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert run(docs, labels_of(spark, rows, lambda t: 1)).where("score <= 0.5").count() == 0  # one class alone


def test_quality_labels_do_not_reach_held_out_scores(spark, docs, rows):
    held = {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2}
    a = labels_of(spark, rows, lambda t: int("w1" in t))
    b = a.withColumn("quality", F.when(F.col("doc_id").isin(*held), 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda df: sorted((r.doc_id or -1, r.score) for r in fm_quality.quality_scores(docs, df).collect())
    assert key(a) == key(b)


def test_toxicity_labels_do_not_reach_held_out_scores(spark, docs, rows):
    held = {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0}
    a = labels_of(spark, rows, lambda t: int("w1" in t))
    b = a.withColumn("toxic", F.when(F.col("doc_id").isin(*held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: sorted((r.doc_id or -1, r.score) for r in subword_toxicity.toxicity_scores(docs, df).collect())
    assert key(a) == key(b)


def test_quality_scores_equal_brute_force(rows):
    """Features by plain counting over strings, scores by the sum over all pairs."""
    rng = np.random.default_rng(3)
    m = fm_quality.FactorisationMachine(0.2, rng.normal(size=fm_quality.N_FEATURES).astype(np.float32) / 9, rng.normal(size=(fm_quality.N_FEATURES, 3)).astype(np.float32) / 9)
    log_bin = lambda x: min(15, int(math.log2(x + 1)))
    share = lambda a, b: 0 if not b or a <= 0 else max(1, min(15, 15 + int(1.5 * math.log2(min(1.0, a / b)))))
    for _, t, _, _, chars, *_ in rows:
        t = t or ""
        if len(t) > 2_000:
            continue
        w = WORD.findall(t)
        low = [lower(x) for x in w]
        size = lambda x: len(x.encode())
        letters = max(1, sum(map(size, w)))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        bins = [
            log_bin(len(w)), min(15, round(letters / len(w))) if w else 0, share(sum(t.count(c) for c in "#*$%&|<>"), len(w)), share(len(re.findall("[A-Z]", t)), letters), share(len(re.findall("[0-9]", t)), letters),
            share(len(w) - len(set(low)), len(w)), share(sum(a == b for a, b in zip(low, low[1:])), len(w)), share(t.count("|"), len(w)), share(len(lines) - len(set(lines)), len(lines)), share(t.count("!") + t.count("?"), len(w)),
            share(size(re.sub(r"[\x00-\x7f]", "", t)), letters), log_bin(len(w) / max(1, len(lines))), 0 if chars is None else log_bin(chars),
        ]
        x = [(zlib.crc32(k.encode()) % (1 << 17), 1 / math.sqrt(len(set(low)))) for k in set(low)] + [((1 << 17) + 16 * g + b, 0.5) for g, b in enumerate(bins)]
        want = 0.2 + sum(float(m.w[i]) * a for i, a in x) + sum(float(m.v[i] @ m.v[j]) * a * b for (i, a), (j, b) in itertools.combinations(x, 2))
        assert m.margins([fm_quality.features(t.encode(), chars)])[0] == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_toxicity_scores_equal_brute_force(rows):
    """N-grams and windows word by word, over strings."""
    rng = np.random.default_rng(5)
    m = subword_toxicity.SubwordModel(rng.normal(size=(subword_toxicity.N_BUCKETS, 4)).astype(np.float32), rng.normal(size=(2, 4)).astype(np.float32), np.array([0.1, -0.3]))
    full = 0xFFFFFFFF

    def bucket(h, salt):
        h = (h ^ salt * 0x9E3779B1 & full) * 0x85EBCA6B & full
        h = (h ^ h >> 13) * 0xC2B2AE35 & full
        return (h ^ h >> 16) & subword_toxicity.N_BUCKETS - 1

    def logit(word):
        s = [ord(c) for c in f"<{word.strip('.,;:!?' + chr(34) + chr(39) + '()[]{}#*$%&|<>')}>"]
        grams = [bucket(sum(c * pow(0x01000193, k + 1, 1 << 32) for k, c in enumerate(s)) & full, 1)]
        for n in (3, 4, 5):
            for i in range(len(s) - n + 1):
                h = s[i]
                for c in s[i + 1 : i + n]:
                    h = h * 0x01000193 & full ^ c
                grams.append(bucket(h, n))
        return float(np.mean([m.emb[g] @ (m.out[1] - m.out[0]) for g in grams]))

    texts = [r[1] or "" for r in rows if len(r[1] or "") < 2_000]
    split = [[lower(x) for x in WORD.findall(t)] for t in texts]
    known = {x: logit(x) for x in set().union(*split)}
    for w, got in zip(split, m.score([t.encode() for t in texts])):
        wins = [set(w[max(0, begin) : begin + 32]) for begin in range(-16, len(w), 16)]
        worst = max((sum(map(known.get, win)) / (len(win) + 8) for win in wins if win), default=0.0)
        assert got == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, -0.4 + 8 * worst)))), rel=1e-4)


@pytest.mark.parametrize("bound", [0, 400, 10**9])
def test_training_sample_is_bounded(spark, docs, rows, bound):
    """Ids that stand on many rows give one, and text stops at the bound."""
    picked = spark.createDataFrame([(i, i % 2) for i in (0, 1, 2, 3, 4, 9, 77_777)], "doc_id long, _y int")
    got = common.bounded_sample(docs.select("doc_id", "text").unionByName(docs.select("doc_id", F.lit("other").alias("text")).where("doc_id = 3")), picked, bound).collect()
    sizes = [len((r.text or "").encode()) for r in got]
    assert len({r.doc_id for r in got}) == len(got) and all(r._y == r.doc_id % 2 for r in got)
    assert sum(sizes) <= bound or len(got) == 1
    assert bound < 10**9 or {r.doc_id for r in got} == {0, 1, 2, 3, 4, 9}


def test_toxicity_learns_stems(spark):
    rng = random.Random(1)
    plain, ends = [f"{a}{b}" for a in ("tar", "mol", "ven", "sud", "kir") for b in ("a", "on", "is", "um", "ek")], ["x", "ish", "on", "ful", "est", "ing", "y", "ed", "er", "o"]

    def text(bad, suffixes):
        w = rng.choices(plain, k=rng.randint(20, 200))
        for _ in range(max(1, len(w) // 25) if bad else 0):
            w.insert(rng.randrange(len(w)), "grombl" + rng.choice(suffixes))
        return " ".join(w)

    data = [(i, text(i % 5 == 0, ends[:6] if zlib.crc32(str(i).encode()) % 5 else ends[6:]), None, None, None, None, None, None) for i in range(900)]
    labels = spark.createDataFrame([(d[0], 1, int(d[0] % 5 == 0)) for d in data], "doc_id long, quality int, toxic int")
    got = subword_toxicity.toxicity_scores(spark.createDataFrame(data, SCHEMA), labels).where("held_out").collect()
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in got]) > 0.97  # suffixes of held-out rows were never seen


# ---- op2 --------------------------------------------------------------------------------------


def brute_backoff(rows, order, mass):
    """Probabilities straight from the formula, over dictionaries of words."""
    toks = [[lower(w) for w in WORD.findall(r[1] or "")] + ["\n"] for r in rows]
    train = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1 for r in rows]
    counts = [Counter() for _ in range(order + 1)]
    for t, ok in zip(toks, train):
        for i in range(len(t)) if ok else ():
            for k in range(1, order + 1):
                if k <= i + 2:
                    counts[k][tuple(["\t", *t][i + 2 - k : i + 2])] += 1
    counts[1]["\t",] = 0
    c, n = Counter({w[0]: x for w, x in counts[1].items() if x}), sum(counts[1].values())
    v = len(c)
    history = lambda h: sum(train) if h == ("\t",) else counts[len(h)][h]

    def p(h, w):
        if not h:
            return (c[w] + 0.5) / (n + 0.5 * (v + 1))
        m = mass[len(h)]
        return (counts[len(h) + 1][*h, w] + m * p(h[1:], w)) / (history(h) + m)

    for r, t, ok in zip(rows, toks, train):
        padded = ["\t", *t]
        model = sum(math.log10(p(tuple(padded[max(0, i + 1 - (order - 1)) : i + 1]), w)) for i, w in enumerate(t))
        yield r[0], not ok, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10(p((), w)) for w in t), 6), round(model, 6)


@pytest.mark.parametrize(("block", "fan", "order", "mass"), [(50, 3, 3, (0, 7.0, 2.0)), (300, 4, 4, (0, 7.0, 2.0, 0.5)), (2_000, 256, 2, (0, 400.0)), (1_500_000, 256, 3, backoff_lm.MASS), (2_000, 256, 1, (0,))])
def test_backoff_scores(docs, rows, block, fan, order, mass):
    got = backoff_lm.backoff_scores(docs, block, mass, order, fan, 500 if fan < 256 else 50_000)
    found = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got.collect())
    assert found == Counter(brute_backoff(rows, order, mass))


def small_automaton():
    texts = [b"a b a c", b"a b", b"c", b"a b c a"]
    b = backoff_lm.Block.of([backoff_lm.tokens(t) for t in texts], [True] * 4)
    counts = [b.counts(k).astype(float) for k in range(3)]
    return b, backoff_lm.Automaton(b, counts, int(counts[0].sum()), len(counts[0]), 4, (0, 3.0, 2.0))


def test_backoff_probabilities_sum_to_one():
    """Of each state, over its arcs and along its failure arcs."""
    b, a = small_automaton()
    unseen = 0.5 / (a.counts[0].sum() + 0.5 * (len(a.counts[0]) + 1))
    assert (10 ** a.arc[0]).sum() + unseen == pytest.approx(1)

    def spread(state):
        if state == 0:
            return dict(enumerate(10 ** a.arc[0])), unseen
        below, lost = spread(int(a.fall[state]))
        back, k = 10 ** a.back[state], int(a.length[state])
        out = {w: x * back for w, x in below.items()}
        at = a._states(k)
        for i in np.flatnonzero(at == state):
            out[int(b.grams[0][i])] = 10 ** a.arc[k][b.grams[k][i]]
        return out, lost * back

    ends = backoff_lm.END
    for state in {int(x) for k in (1, 2) for x in a._states(k)} - {0}:
        arcs, lost = spread(state)
        assert sum(arcs.values()) + lost == pytest.approx(1)
    assert ends in b.hashes[0]


@pytest.mark.parametrize("run", [1, 2, 3, 7, 256])
def test_runs_carry_the_state(docs, rows, run):
    """Runs that read their way in end in the states of one run over the whole text."""
    b, a = small_automaton()
    assert a.traverse(run) == pytest.approx(a.traverse(10_000))
    t = [backoff_lm.tokens((r[1] or "").encode()) for r in rows]
    big = backoff_lm.Block.of(t, [i % 3 > 0 for i in range(len(t))])
    counts = [big.counts(k).astype(float) for k in range(3)]
    a = backoff_lm.Automaton(big, counts, int(counts[0].sum()), int((counts[0] > 0).sum()), big.starts())
    assert a.traverse(run) == pytest.approx(a.traverse(100_000))


def test_messages_of_a_tree_follow_the_blocks(docs):
    """However many blocks there are, each asks one question a range and order at most."""
    for size in (5_000, 1_000, 200):
        table = backoff_lm.blocks(docs, F.lit(True), size).persist()
        n, entries = table.count(), table.agg(F.sum("entries")).first()[0]
        asked = backoff_lm.asks(table, backoff_lm.Tree(n, entries, 3, 8, 100)).groupBy("child").count().collect()
        assert len(asked) == n and max(r["count"] for r in asked) <= 8 * 3
        table.unpersist()


def test_backoff_empty(nothing):
    assert backoff_lm.backoff_scores(nothing).count() == 0


# ---- op3 --------------------------------------------------------------------------------------


CHARACTER_CLASSES = ("[a-z]", "[A-Z]", "[0-9]", r"[ \t\n\v\f\r]", r"""[.,;:'"()\-]""", "[!?]", r"[#*$%&|<>]", None, r"[^\x00-\x7f]")


def brute_classes(text):
    found = [len(re.findall(c, text)) if c else 0 for c in CHARACTER_CLASSES]
    found[7] = len(text) - sum(found)
    return found


def brute_distance(p, q):
    """From entropies: that of the mean less the mean of theirs."""
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    entropy = lambda d: -sum(x * math.log2(x) for x in d if x)
    return math.sqrt(max(0.0, entropy([(a + b) / 2 for a, b in zip(p, q)]) - (entropy(p) + entropy(q)) / 2))


def brute_verdicts(rows, listed):
    """(base counts, base_failed, kept) of each row, from texts as strings, without the library's histograms and references."""
    words = lambda t: WORD.findall(t or "")
    parted = lambda t: words(re.sub("[.,;:!?\"'()#*$%&|<>]", " ", lower(t or "")))
    refs = {}
    for lang in {r[2] for r in rows if r[2]} | set(listed):
        long = [r[1] for r in rows if r[2] == lang and len(words(r[1])) > 50]
        tagged = Counter(w for r in rows if r[2] == lang for w in parted(r[1]))
        common = listed.get(lang) or [w for w, _ in sorted(tagged.items(), key=lambda x: (-x[1], x[0].encode()))[:30]]
        if len(long) < 20:
            if lang in listed:
                fall = [1 / k for k in range(1, len(common) + 1)]
                refs[lang] = ([0.78, 0.03, 0.005, 0.16, 0.02, 0.001, 0.001, 0.001, 0.002], [x / sum(fall) / 3 for x in fall] + [2 / 3], common)
            continue
        shares = [[int(math.sqrt(x / len(t)) * 511) for x in brute_classes(t)] for t in long]
        medians = [(sorted(s[k] for s in shares)[(len(long) - 1) // 2] / 511) ** 2 for k in range(9)]
        means = [0.0] * (len(common) + 1)
        for t in long:
            ws = parted(t)
            hits = [ws.count(w) for w in common]
            for k, x in enumerate([*hits, len(ws) - sum(hits)]):
                means[k] += x / max(1, len(ws))
        refs[lang] = (medians, means, common)
    for r in rows:
        t, w = r[1] or "", words(r[1])
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) for k in range(3) if grams[tuple(w[i : i + 3])] > 1}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        kept = False
        if not failed:
            slack, ws = 0.5 / math.sqrt(len(w)), parted(t)
            best = None
            for lang, (chars, means, common) in refs.items():
                hits = [ws.count(x) for x in common]
                d = brute_distance(brute_classes(t), chars), brute_distance([*hits, len(ws) - sum(hits)], means) if ws else 1.0
                best = min(filter(None, [best, (max(d[0] / 0.14, d[1] / 0.42), lang, d)]))
            kept = best[2][0] <= 0.14 + slack and best[2][1] <= 0.42 + slack or r[2] is not None and r[2] not in refs
        yield r[0], len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(covered), failed, kept


def test_quality_rules(spark, docs, rows, nothing):
    rng = random.Random(8)
    other = [f"z{c}{d}" for c in "aeiou" for d in "bdg"]
    prose = lambda words, k: " ".join(rng.choices(words, k=k))
    more = [(1000 + i, prose(other, 80), "xx", None, None, 1.0, 7, "clash") for i in range(25)] + [(2000, prose(other, 90), "rare", None, None, 1.0, 7, "clash"), (2001, "### $$$ %%% @@@ ~~~ " * 5 + prose(other, 60), "xx", None, None, 1.0, 7, "clash")]
    more += [(3000 + i, prose(divergence_rules.COMMON_WORDS["es"], 12) + " " + prose(other, 60), "es", None, None, 1.0, 7, "clash") for i in range(3)]  # too few for a reference of their own
    rows = [*rows, *more]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = Counter(brute_verdicts(rows, divergence_rules.COMMON_WORDS))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in divergence_rules.quality_rules(df).collect())
    assert got == want
    kept = {k[0] for k in want if k[-1]}
    assert {1000 + i for i in range(25)} <= kept and 2000 in kept and any(k[1] > 50 and not k[6] and not k[7] for k in want)
    assert divergence_rules.quality_rules(nothing).count() == 0 and divergence_rules.keep_passing(nothing).count() == 0
    assert Counter(r.doc_id for r in divergence_rules.keep_passing(df).collect()) == Counter(k[0] for k in want.elements() if k[-1])
    assert divergence_rules.keep_passing(df).columns == docs.columns


def test_jensen_shannon_by_hand():
    p, q = np.array([1.0, 1.0, 0.0]), np.array([0.0, 2.0, 2.0])
    a, b = [0.5, 0.5, 0], [0, 0.5, 0.5]
    m = [(x + y) / 2 for x, y in zip(a, b)]
    kl = lambda u: sum(x * math.log2(x / z) for x, z in zip(u, m) if x)
    assert divergence_rules.jensen_shannon(p, q) == pytest.approx(math.sqrt((kl(a) + kl(b)) / 2))
    assert divergence_rules.jensen_shannon(p, p) == 0 and divergence_rules.jensen_shannon(p, np.zeros(3)) == 1


# ---- op4 --------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    html = ["<p>ä</p>", "same", "same", "", None, "x" * 300_000, "same", "twice", "twice"]
    ids = [5, 9, 2, 8, 11, 1, 4, 6, 6]
    pages = [(i, f"http://h/{i} b?q=\né" if i % 2 else None, h, "extra") for i, h in zip(ids, html)] + [(None, None, "same", "extra"), (None, None, "alone", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string").repartition(3)
    first = {}
    for i, _, h, _ in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want, seen = Counter(), set()
    for i, _, h, _ in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        b = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        lead = first.get(h or "", i)
        response = i == lead and (i, h or "") not in seen
        seen.add((i, h or ""))
        want[i, len(b), digest, "response" if response else "revisit", None if response else lead] += 1
    got = Counter(tuple(r)[:5] for r in warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == want
    payloads = warc.read_archives(warc.write_archives(df, archive_bytes=2_000), payloads=True).where("record_type = 'response'").collect()
    assert Counter(bytes(r.payload).decode() for r in payloads) == Counter([*first, "alone"])
    assert warc.round_trip(spark.createDataFrame([], df.schema)).count() == 0
    records = warc.round_trip(df)
    assert warc.unmatched_revisits(records).count() == 0
    assert {r.payload_digest for r in warc.unmatched_revisits(records.where("record_type = 'revisit' OR payload_digest <> '%s'" % warc.sha1_base32(b"same"))).collect()} == {warc.sha1_base32(b"same")}


def test_rows_of_one_page_leave_one_response(spark):
    """Alike and unlike urls, over many rows: the least url is written in full, once."""
    df = spark.createDataFrame([(7, u, "body") for u in [None, "b", "a", "a", "b"] * 40] + [(9, "z", "body")], "page_id long, url string, html string").repartition(6)
    got = warc.round_trip(df).collect()
    assert len(got) == 201 and Counter(r.record_type for r in got) == {"response": 1, "revisit": 200}
    assert [(r.page_id, r.target_uri) for r in got if r.record_type == "response"] == [(7, "urn:page:7")] and {r.refers_to for r in got} == {None, 7}


def test_warc_members_stand_alone_and_damage_is_seen():
    one, two = (warc.gzip_member(warc.record(i, "http://h/", b"payload %d" % i, False, None)) for i in (1, 2))
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(one + two))] == [1, 2]
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO((one + two)[:-9])))
    raw = warc.record(1, None, b"payload", False, None).replace(b"payload\r\n\r\n", b"pay1oad\r\n\r\n")
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(warc.gzip_member(raw))))
    assert [warc.page_of(warc.record_urn(x)) for x in (None, 0, -5, 2**62)] == [None, 0, -5, 2**62]


# ---- op6 --------------------------------------------------------------------------------------


def test_hilbert_steps_are_unit_steps(spark):
    df = spark.range(512).select((F.col("id") % 8).alias("a"), (F.floor(F.col("id") / 8) % 8).alias("b"), F.floor(F.col("id") / 64).alias("c"))
    path = sorted((r.h, r.a, r.b, r.c) for r in hilbert_shards.hilbert_index(df, ["a", "b", "c"], 3, "h").collect())
    assert [p[0] for p in path] == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(p[1:], q[1:])) == 1 for p, q in zip(path, path[1:]))


def test_shards(docs, rows, nothing):
    got = hilbert_shards.hilbert_shards(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert sorted(by) == list(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())
    curve = [r.curve for s in range(24) for r in sorted(by[s], key=lambda r: r.slot)]
    assert curve == sorted(curve) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert hilbert_shards.hilbert_shards(nothing).count() == 0


def test_steps_compare_whole_values(spark):
    """Equal depth, against sorted lists: strings that share a long prefix, hot and null values, numbers under and over zero, dates."""
    rng = random.Random(6)
    rows = [(rng.choice(["https://a.example/x", "https://z.example/", None] + [f"https://host{k:03d}.example" for k in range(60)] + ["https://hot.example"] * 40), rng.choice([-5.0, -1e9, 0.0, 3.0, 1e12, None]), datetime.date(2020, 1, 1) + datetime.timedelta(days=rng.randint(0, 900))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a string, b double, c date").repartition(5)
    df = df.select("a", "b", hilbert_shards.order_value("c", "date").alias("c"))
    got = hilbert_shards.quantised(df, ["a", "b", "c"]).collect()
    for name in ("a", "b", "c"):
        values = sorted(r[name] for r in got if r[name] is not None)
        step = {r[name]: r[f"{name}_q"] for r in got}
        assert step.get(None, 0) == 0 and all(r[f"{name}_q"] == step[r[name]] for r in got)
        distinct = sorted(set(values))
        assert [step[v] for v in distinct] == sorted(step[v] for v in distinct)
        if name == "a":
            bounds = {values[-(-k * len(values) // 16) - 1] for k in range(1, 16)}
            assert step == {**{v: sum(b < v for b in bounds) for v in distinct}, None: 0}
    by = {r.a: r.a_q for r in got}
    assert by["https://a.example/x"] < by["https://z.example/"]


def test_shards_prune_files(spark):
    """A shard's least and greatest values rule out most shards, in every dimension."""
    rng = random.Random(9)
    rows = [(i, f"text {i}", f"l{rng.randrange(8)}", f"https://common.example/{rng.randrange(40):02d}", rng.randrange(10_000), 1.0, 7, "clash") for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    placed = {r.doc_id: r.shard for r in hilbert_shards.hilbert_shards(df, 64).collect()}
    for k in (2, 3, 4):
        spans = defaultdict(list)
        for r in rows:
            spans[placed[r[0]]].append(r[k])
        hit = np.mean([sum(min(s) <= v <= max(s) for s in spans.values()) / 64 for v in {r[k] for r in rows[:300]}])
        assert hit < 0.5


# ---- op7 --------------------------------------------------------------------------------------


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pack_concat.default_tokenizer())
    got = pack_concat.pack(docs).collect()
    ids = [np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4") for r in rows]
    total = sum(map(len, ids))
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(-(-total // 2048)))
    for s, spans in by.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 2048 or s == len(by) - 1
    # Pieces of each document, by id: their checksums and lengths are those of its own ids, each id once.
    want = Counter((r[0], len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, ids))
    whole = Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in got if r.length == r.doc_tokens)
    assert not whole - want
    cut = [r for r in got if r.length < r.doc_tokens]
    for r in cut:
        assert any(k == r.doc_id and len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for (k, *_), x in zip(rows, ids))
    assert sum(r.length for r in got) == total
    assert sum(len(s.ids) for s in pack_concat.sequences(docs).collect()) == 2048 * len(by)
    assert pack_concat.pack(nothing).count() == 0


@pytest.mark.parametrize("text", ["it's. don't, A<|endoftext|>b <|ENDOFTEXT|> Straße. é, x.. y.,z İ.", "a.b. 3.5, 7. (x). \x1c y.　z,", "é. Å, ﬁ."])
def test_pieces_keep_the_tokenizers_ids(text):
    cache = pack_concat.WordCache(pack_concat.default_tokenizer(), most=2)
    for _ in range(3):
        assert np.frombuffer(cache.encode([text.encode()])[0], "<u4").tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_on_random_text():
    cache, rng = pack_concat.WordCache(pack_concat.default_tokenizer()), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices("aB9é.ß,!'\"_-—²½Ⅳ\u0301 \n\t\x1c\u3000\xa0<|>$%İΣςs tÀŉſ", k=rng.randint(1, 25)))
        assert np.frombuffer(cache.encode([text.encode()])[0], "<u4").tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizers_ids(docs, rows, name):
    """A tokenizer that keeps white space is not cut into words."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    want = Counter(tuple([*t.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows)
    tokens = pack_concat.token_table(docs, public_tokenizers.path(name)).collect()
    assert Counter(tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in tokens) == want
    # Sequences hold the very stream of the tasks' tokens, cut every 512 and padded at the end.
    stream = [i for r in sorted(tokens, key=lambda r: (r.part, r.local)) for i in np.frombuffer(r.ids, "<u4").tolist()]
    got = pack_concat.sequences(docs, public_tokenizers.path(name), 512, 3).orderBy("sequence_id").collect()
    assert [r.sequence_id for r in got] == list(range(-(-len(stream) // 512)))
    assert [i for r in got for i in r.ids] == stream + [3] * (-len(stream) % 512)


# ---- op8 --------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = [lower(x) for x in WORD.findall(text or "")]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_near_duplicates(docs, rows, nothing):
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(fps)
    ids = defaultdict(list)
    for r, k in zip(rows, roots):
        ids[k].append(r[0])
    name = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    want = Counter((r[0], f"{f:016x}", name[k]) for r, f, k in zip(rows, fps, roots))
    assert Counter(tuple(r) for r in simhash_dedup.near_duplicates(docs).collect()) == want
    kept = simhash_dedup.keep_one(docs)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(name.values()) and kept.columns == docs.columns
    assert simhash_dedup.near_duplicates(nothing).count() == 0 and simhash_dedup.keep_one(nothing).count() == 0


@pytest.mark.parametrize("limit", [3, 2_000])
def test_components_of_clusters(spark, limit, monkeypatch):
    """Chains and dense clusters of fingerprints, with keys listed again and without."""
    monkeypatch.setattr(simhash_dedup, "KEY_LIMIT", limit)
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
        for _ in range(40):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 3))))
    fps = sorted(fps)
    roots = brute_components(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.fp: r.root for r in simhash_dedup.components(simhash_dedup.star_edges(nodes)).collect()}
    groups = defaultdict(set)
    for x in fps:
        groups[got.get(signed(x), signed(x))].add(x)
    want = defaultdict(set)
    for x, k in zip(fps, roots):
        want[k].add(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()}


def test_flips_find_what_comparison_finds():
    rng = random.Random(2)
    free = sum(1 << b for b in rng.sample(range(64), 16))
    base = rng.getrandbits(64) & ~free
    bits = [b for b in range(64) if free >> b & 1]
    fp = np.array(sorted({base | sum(1 << b for b in bits if rng.random() < 0.5) for _ in range(3000)}), np.uint64)
    roots = simhash_dedup._roots(fp, free)
    want = brute_components([int(x) for x in fp])
    assert [int(x) for x in roots] == [int(fp[k]) for k in want]


# ---- op9 --------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li>Home</li></ul></nav>
<div class="ad">Buy now</div><div id="cookie-notice"><p>We use cookies</p></div><article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>
 three&nbsp;four<br>five<p>De.<ul><li>a</li><li>b</li></ul><aside>Side</aside><form><input value="x">Name</form><blockquote>Quote</blockquote></article>
<section class="comments"><p>A reader says a long thing about this article, as readers do.</p></section><footer>&copy; me</footer></body></html>"""


def test_extraction_of_a_page():
    assert line_block_html.main_text(PAGE) == "Head & line\nOne two three four five\nDe.\na\nb\nQuote"


@pytest.mark.parametrize(
    ("page", "text"),
    [(None, ""), ("", ""), ("<p", ""), ("<article><p>cut &am", "cut &am"), ("<article>plain &lt;b&gt; &#233; &#x41;</article>", "plain <b> é A"), ("<article><p>a</p><!-- <p>x</p> --><script>if (a<b) {}</script><p>b</article>", "a\nb"), ("<nav>only menus</nav>", "")],
)
def test_extraction_cases(page, text):
    assert line_block_html.main_text(page) == text


def test_surge_and_dive_without_a_container():
    long = "A long sentence that belongs to the story and goes on for quite a while, as stories do."
    page = f"<div>Menu</div><div><a>Home</a></div><nav>x</nav><nav>y</nav><nav>z</nav><p>{long}</p><p>Short.</p><p>{long}</p><nav>q</nav><nav>r</nav><nav>s</nav><p>Tail</p>"
    assert line_block_html.main_text(page) == f"{long}\nShort.\n{long}"


def test_surge_and_dive_beside_containers():
    long = "A long sentence that belongs to the story and goes on for quite a while, as stories do."
    teaser = "<article><p>More news</p></article>"
    gap = "<nav>x</nav><nav>y</nav><nav>z</nav>"
    for box in (teaser, '<div class="content">More news</div>'):
        assert line_block_html.main_text(f"<div><p>{long}</p><p>{long}</p></div>{gap}{box}") == f"{long}\n{long}"
    assert line_block_html.main_text(f"<article><p>{long}</p><p>{long}</p><p>End.</p></article><p>beside</p>{teaser}{teaser}") == f"{long}\n{long}\nEnd."
    assert line_block_html.main_text(f"<article><p>{long}</p></article><article><p>{long}</p></article><p>beside</p>") == f"{long}\n{long}"


@pytest.mark.parametrize(
    ("start", "text"),
    [
        ("<head><meta charset=utf-8><title>T</title><script>var t = '<p>no</p>'</script><body>", "a\nb"), ("<head><title>T<body>", "a\nb"), ("<button>Go", "a\nb"), ("<select><option>x<option>y", "a\nb"), ("<svg><title>t</title>", "a\nb"),
        ("<title>T<script>'<p>no</p>'</script>", "a\nb"), ("<script>var x", ""), ("<style>p{}", ""), ("<head><title>T</title></head><body>", "a\nb"),
    ],
)
def test_silent_elements_left_open(start, text):
    assert line_block_html.main_text(f"<html>{start}<article><p>a</p><p>b</p></article></html>") == text


def brute_runs(weight):
    """From the definition: a window without weight parts the lines, and a part counts if one of its windows reaches the threshold."""
    w, n = line_block_html.WINDOW, len(weight)
    sums = [sum(weight[i : i + w]) for i in range(n)]
    surge = min(line_block_html.SURGE, max(sums, default=0) / 2)
    alive = [k for k in range(n) if weight[k]]
    parts = []
    for k in alive:
        if parts and not any(sums[i] == 0 for i in range(parts[-1][-1], k)):
            parts[-1].append(k)
        else:
            parts.append([k])
    return [(p[0], p[-1] + 1) for p in parts if any(sums[i] >= surge for i in range(max(0, p[0] - w + 1), p[-1] + 1))]


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(3000):
        weight = [rng.choice([0, 0, 0, 1, 5, 30, 90]) if rng.random() < 0.7 else 0 for _ in range(rng.randint(0, 40))]
        assert line_block_html.runs(weight) == brute_runs(weight)


def test_short_pages_are_not_lost():
    assert line_block_html.main_text("<p>Short note.</p><p>Two.</p>") == "Short note.\nTwo."
    assert line_block_html.main_text("<div>Menu</div><nav>a</nav><nav>b</nav><nav>c</nav><p>Short note</p>") == "Short note"
    assert line_block_html.main_text("<ul><li><a>x</a><li><a>y</a></ul>") == "x\ny"
    items = "".join(f"<li>{c}" for c in "abcdefg")
    assert line_block_html.main_text(f"<article><ul>{items}</ul><p>{'word ' * 30}</p></article>").split("\n")[:7] == list("abcdefg")


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ('<script src="x.js"/>var z=1;</script>', ""), ('<div class="share-price">Price 5</div>', "Price 5"), ('<div class="share-buttons">Tweet</div>', ""), ('<div class="related-work">Others</div>', "Others"),
        ('<div id="relatedPosts">More</div>', ""), ('<div class="notice">Closed</div>', ""), ('<p class="notice-of-meeting">Meeting</p>', "Meeting"), ("<div><object>kept</object></div>", "kept"), ("<p><math><mi>x</mi></math></p>", "x"),
        ("<noscript><p>kept</p></noscript>", "kept"), ('<div class="entry-header">Own</div>', "Own"), ('<section id="user-comments"><p>Nice</p></section>', ""), ("<p title=it's>quoted</p>", "quoted"), ('<p title="a > b">marked</p>', "marked"),
    ],
)
def test_names_zero_a_line(inner, text):
    body = "Words of the article itself, which are many more than those of the case."
    assert line_block_html.main_text(f"<article><p>{body}</p>{inner}</article>") == "\n".join(filter(None, [body, text]))


class Article(HTMLParser):
    """Blocks of the article element, by another parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_extraction_equals_another_parsers():
    for p in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist():
        other = Article()
        other.feed(p)
        assert line_block_html.main_text(p) == "\n".join(t for t in (" ".join(b.split()) for b in other.blocks) if t)


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "x" + "</i>" * 100_000, "<div><p>" * 50_000 + "x", "<title>x<p>x" * 50_000, '<a href="x' * 50_000, "<a b='" * 50_000, "<!-- " * 50_000])
def test_open_markup_costs_linear_time(page):
    began = time.perf_counter()
    line_block_html.main_text(page)
    assert time.perf_counter() - began < 5


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = line_block_html.extract(df).collect()
    assert sorted((r.page_id or 0, r.n_chars == len(r.text)) for r in got) == [(0, True), (1, True), (1, True)]
    assert line_block_html.extract(df.limit(0)).count() == 0


# ---- op10 -------------------------------------------------------------------------------------


def brute_leaks(rows, items):
    cut = lambda t, k: {" ".join(t[i : i + k]) for i in range(len(t) - k + 1)}
    words = [(i, [lower(w) for w in WORD.findall(t or "")]) for i, t, *_ in rows]
    out = {}
    for item, text in items:
        w = [lower(x) for x in WORD.findall(text or "")]
        if item is None or not w:
            continue
        want = cut(w, min(5, len(w)))
        for i, t in words:
            shared = len(want & cut(t, min(5, len(w))))
            if shared >= 0.8 * len(want) - 1e-9:
                best = out.get((i, item), (0, 0))
                out[i, item] = (len(want), max(shared, best[1]))
    return Counter({(*k, *v) for k, v in out.items()})


@pytest.mark.parametrize("broadcast_rows", [1, 200_000])
def test_leaks(spark, docs, rows, nothing, broadcast_rows):
    items = [(1, " ".join((rows[2][1] or "").split()[:30])), (2, "one two"), (3, ""), (4, None), (5, "not in any text at all here"), (6, "one"), (None, "one"), (7, rows[-3][1]), (8, "w1 W2 w3 w4 w5 w6 w7 w8 w9 w10")]
    long = " ".join(rows[-5][1].split()[500:560])
    w = long.split()
    w[30] = "swapped"
    items += [(9, long), (10, " ".join(w))]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = decontaminate.leaks(docs, bench, broadcast_rows=broadcast_rows)
    assert Counter((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got.collect()) == brute_leaks(rows, items)
    bad = {r.doc_id for r in got.collect()}
    kept = decontaminate.drop_leaking(docs, bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in bad) and kept.columns == docs.columns
    assert decontaminate.leaks(nothing, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_items_of_one_id_and_of_none(spark):
    text = lambda k: " ".join(f"x{k}y{i}" for i in range(20))
    bench = spark.createDataFrame([(1, text(1)), (1, text(2)), (None, text(3)), (5, text(1))], "item_id long, text string")
    docs = spark.createDataFrame([(1, text(1)), (2, f"a {text(2)} b"), (3, text(3)), (None, text(3)), (None, "clean one"), (4, "clean two"), (4, text(1)), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared, r.containment) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {k: (16, 16, 1.0) for k in ((1, 1), (1, 5), (2, 1), (4, 1), (4, 5))}
    assert Counter(tuple(r) for r in decontaminate.drop_leaking(docs, bench).collect()) == Counter([(None, "clean one"), (4, "clean two"), (5, None)])


def test_sketch_misses_no_leak(spark):
    """Whichever shingles a document lacks, up to a fifth, one of the sketch is left."""
    bench = spark.createDataFrame([(n, " ".join(f"t{n}x{i}" for i in range(n))) for n in (3, 5, 9, 14, 104)], "item_id long, text string")
    items = decontaminate.item_shingles(bench)
    sizes = {r.item_id: (r.n, r.k) for r in items.groupBy("item_id", "n").count().select("item_id", "n", F.col("count").alias("k")).collect()}
    kept = {r.item_id: r["count"] for r in decontaminate.sketches(items).groupBy("item_id").count().collect()}
    for i, (n, k) in sizes.items():
        assert n == k and kept[i] == n - math.ceil(0.8 * n - 1e-9) + 1
