"""The pipeline's stages in order, against each other and the operators they call."""

from __future__ import annotations

import sys
import zlib
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402

from veriledger.llm import common, decontaminate, divergence_rules, pack_concat, simhash_dedup, subword_toxicity  # noqa: E402
from veriledger.llm.oracles import ORACLES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.table(spark, SF, "documents")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(common.materialise(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, stages):
    docs, ruled, clean, unique, safe, packed = stages
    assert [n for n, _ in P.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "decontamination", "packing"]
    for df in stages[:-1]:
        assert df.columns == docs.columns
    assert ids(ruled) == ids(divergence_rules.quality_rules(docs).where("kept"))
    # Toxicity, against a model of the same sample trained and applied row by row outside Spark.
    texts = {r.doc_id: (r.text or "").encode() for r in ruled.collect()}
    marks = {}
    for r in common.table(spark, SF, "labels").collect():
        if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            marks[r.doc_id] = max(r.toxic, marks.get(r.doc_id, 0))
    order = sorted(i for i in marks if i in texts)
    model = subword_toxicity.SubwordModel.fit((subword_toxicity.split(texts[i]) for i in order), [marks[i] for i in order], sum(marks.values()) / len(marks))
    assert ids(clean) == sorted(i for i, t in texts.items() if model.score([t])[0] < 0.5)
    assert 0 < clean.count() < ruled.count()
    assert ids(unique) == sorted({r.component_id for r in simhash_dedup.near_duplicates(clean).collect()})
    bad = {r.doc_id for r in decontaminate.leaks(unique, common.table(spark, SF, "benchmark")).collect()}
    assert ids(safe) == [i for i in ids(unique) if i not in bad]
    assert {r.doc_id for r in packed.collect()} == set(ids(safe))
    assert sum(r.length for r in packed.collect()) == sum(r.doc_tokens for r in pack_concat.pack(safe).where("start = 0").collect())


def test_run_gives_the_last_stage(spark, stages):
    assert P.run(spark, SF).count() == stages[-1].count()


def test_leaks_equal_the_oracle(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = c.execute(ORACLES["op10_minhash_containment"])
    names = [d[0] for d in cur.description]
    got = decontaminate.leaks(common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
