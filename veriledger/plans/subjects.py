"""Queries that resolve what a question is about and how it is looked up; guidance and replayed answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import retrieve as T
from ..operators import review as V
from ..operators import subjects as S
from . import recon
from .base import plain, query, table, view

QUESTIONS = """
SELECT c_custkey AS qid, CASE WHEN c_custkey % 5 = 0 THEN 'K-GAAP' END AS framework, CASE c_custkey % 12 WHEN 0 THEN '리스 부채는 어떻게 측정하나요?' WHEN 1 THEN '장부 금액이 왜 다른가요?' WHEN 2 THEN '금액은 얼마인가요?' WHEN 3 THEN '재고 자산의 감모와 FOB 조건' WHEN 4 THEN 'K-IFRS 수익 인식 기준' WHEN 5 THEN '일반기업회계기준 재고'
    WHEN 6 THEN '제 1115 호 문단 31' WHEN 7 THEN 'IFRS 1002 환율' WHEN 8 THEN '1115 paragraph 31' WHEN 9 THEN '영업권 손상과 합병' WHEN 10 THEN '거래일과 현금 흐름' ELSE c_name END AS question,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '매출 거래가격' ELSE '외화 환산' END AS planned
FROM {customer}
"""
_Q = f"WITH q AS ({plain(QUESTIONS)}), words(n, subject, word) AS (VALUES {', '.join(f'({n}, {k!r}, {w!r})' for n, (k, ws) in enumerate(S.DOMAINS.items()) for w in ws)}), lists(n, subject) AS (SELECT DISTINCT n, subject FROM words)"
_SUBJECTS = lambda c: f"coalesce((SELECT list(subject ORDER BY n) FROM lists l WHERE EXISTS (SELECT 1 FROM words w WHERE w.n = l.n AND contains(lower(regexp_replace({c}, '\\s+', '', 'g')), lower(w.word)))), [])"
_RESOLVED = f"""{_Q}, s AS (SELECT qid, question, planned, {_SUBJECTS('question')} AS explicit, {_SUBJECTS('planned')} AS named FROM q),
r AS (SELECT qid, question, planned, CASE WHEN len(list_filter(explicit, lambda x: x NOT IN ('amount', 'date'))) > 0 OR regexp_matches(question, '장부|송장|문서|증빙|비교') OR len(named) = 0 THEN explicit ELSE named END AS subjects FROM s)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, QUESTIONS, "customer").withColumn("queries", F.array("planned"))


@query(f"{_RESOLVED} SELECT qid, array_to_string(subjects, ',') AS subjects FROM r")
def retrieve_subjects(spark: SparkSession, sf: str) -> DataFrame:
    """RT-27."""
    return questions(spark, sf).select("qid", F.array_join(S.resolved(F.col("question"), F.col("queries")), ",").alias("subjects"))


_TERMS = ", ".join(f"({n}, {k!r}, {j}, {p!r})" for n, (k, ws) in enumerate(S.DOMAINS.items()) for j, p in enumerate(S.SEARCH_TERMS.get(k, (" ".join(ws[:2]),))))


@query(f"""{_RESOLVED}, terms(n, subject, j, phrase) AS (VALUES {_TERMS}),
p AS (SELECT qid, question AS phrase, [0, 0, 0] AS o FROM r UNION ALL SELECT qid, planned, [1, 0, 0] FROM r WHERE planned <> '' UNION ALL SELECT qid, phrase, [2, list_position(subjects, subject), j] FROM r JOIN terms ON list_contains(subjects, subject)),
d AS (SELECT qid, phrase, min(o) AS o FROM p GROUP BY qid, phrase), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o) AS n FROM d) SELECT qid, string_agg(phrase, '|' ORDER BY n) AS phrases FROM k WHERE n <= 4 GROUP BY qid""")
def retrieve_search_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """RT-18: a question, its planned queries and what its subjects are searched by, four at most."""
    return questions(spark, sf).select("qid", F.array_join(S.search_phrases(F.col("question"), F.col("queries")), "|").alias("phrases"))


@query("""WITH a AS (SELECT c_custkey AS qid, c_custkey % 12 AS m, CASE WHEN c_custkey % 5 = 0 THEN 'K-GAAP' ELSE 'K-IFRS' END AS given FROM customer),
b AS (SELECT qid, m, CASE m WHEN 4 THEN 'K-IFRS' WHEN 5 THEN 'K-GAAP' ELSE given END AS framework FROM a),
c AS (SELECT *, CASE WHEN m = 6 THEN '1115' WHEN m = 7 THEN '1002' WHEN m = 8 THEN '1115' WHEN framework <> 'K-IFRS' THEN '' WHEN m IN (3, 5) THEN '1002' WHEN m = 4 THEN '1115' ELSE '' END AS ids FROM b)
SELECT qid, CASE WHEN m = 8 THEN 'exact' WHEN framework = 'K-IFRS' AND ids IN ('', '1002') THEN 'official' ELSE 'remote' END AS route, framework, ids AS standard_ids, CASE WHEN m IN (6, 8) THEN '31' END AS paragraph FROM c""")
def retrieve_lookup_plan(spark: SparkSession, sf: str) -> DataFrame:
    """RT-13: exact lookup, official index or remote search, with the filters of each."""
    index = spark.createDataFrame([("1002",), ("1007",), ("1021",)], "standard_id string")
    return S.lookup_plan(questions(spark, sf).select("qid", "question", "framework"), index)


PASSAGES = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Intro\\n9\\nNine ' || p_name || '\\n10\\nTen\\nmore\\n11A\\nNext' WHEN 1 THEN 'A 관련 질의회신요약 x\\ny\\n 12 \\nKept ' || p_name WHEN 2 THEN repeat(p_name || ' ', 200) ELSE '관련 질의회신요약 to the end\\nof it' END AS text, CASE p_partkey % 3 WHEN 0 THEN '10' WHEN 1 THEN '99' END AS paragraph FROM {part}"
_PASS = PASSAGES.replace("'Intro\\n9\\nNine ' || p_name || '\\n10\\nTen\\nmore\\n11A\\nNext'", "E'Intro\\n9\\nNine ' || p_name || E'\\n10\\nTen\\nmore\\n11A\\nNext'").replace("'A 관련 질의회신요약 x\\ny\\n 12 \\nKept ' || p_name", "E'A 관련 질의회신요약 x\\ny\\n 12 \\nKept ' || p_name").replace("'관련 질의회신요약 to the end\\nof it'", "E'관련 질의회신요약 to the end\\nof it'")


@query(f"""WITH p AS ({plain(_PASS)}) SELECT id, sha256(substr(CASE WHEN id % 4 = 0 AND paragraph = '10' THEN '문단 10' || chr(10) || 'Ten' || chr(10) || 'more' WHEN id % 4 = 1 THEN 'A ' || substr(text, strpos(text, chr(10) || ' 12 ')) WHEN id % 4 = 3 THEN '' ELSE text END, 1, 1800)) AS passage FROM p""")
def retrieve_fallback_passages(spark: SparkSession, sf: str) -> DataFrame:
    """RT-28."""
    return view(spark, sf, PASSAGES, "part").select("id", F.sha2(S.fallback_passage(F.col("text"), F.col("paragraph")), 256).alias("passage"))


RANKED = "SELECT DISTINCT o_custkey AS question, CAST(o_orderkey AS BIGINT) AS id, CAST(o_orderkey % 10 AS INT) AS rank, 50 + (o_orderkey * 37) % 600 AS size FROM {orders}"


@query(f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY rank, id) AS n FROM ({plain(RANKED)})),
f AS (SELECT question, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS id FROM (SELECT DISTINCT question FROM r) UNION ALL SELECT f.question, r.n, CASE WHEN used + size <= 1200 THEN used + size ELSE used END, CASE WHEN used + size <= 1200 THEN r.id END FROM f JOIN r ON r.question = f.question AND r.n = f.n + 1)
SELECT question, CAST(row_number() OVER (PARTITION BY question ORDER BY n) - 1 AS INTEGER) AS place, id FROM f WHERE id IS NOT NULL""")
def retrieve_fitted_sources(spark: SparkSession, sf: str) -> DataFrame:
    """RT-17: the budget over a question's distinct sources. Its size here is a tenth, as the texts are."""
    r = view(spark, sf, RANKED, "orders")
    return T.fitted_sources(r.select("question", "rank", "id"), r.select("id", F.repeat(F.lit("x"), F.col("size").cast("int")).alias("text")), 1200)


PARTS = """
SELECT l_orderkey AS context, CASE WHEN l_linenumber <= 4 THEN 'group' WHEN l_linenumber <= 6 THEN 'passage' ELSE 'history' END AS kind, CASE WHEN l_linenumber <= 4 THEN l_linenumber % 2 ELSE 0 END AS grp, CASE WHEN l_linenumber <= 4 THEN (l_linenumber + 1) DIV 2 WHEN l_linenumber <= 6 THEN l_linenumber - 4 ELSE 1 END AS pos, CAST(sum(l_quantity) AS BIGINT) AS size
FROM {lineitem} GROUP BY l_orderkey, l_linenumber UNION ALL SELECT o_orderkey, 'evidence', 0, 1, 10 FROM {orders}
"""


@query(f"""WITH p AS ({plain(PARTS).replace('DIV', '//')}), t AS (SELECT context, sum(size) AS total FROM p GROUP BY context),
o AS (SELECT *, CASE kind WHEN 'group' THEN 100 - 10 * pos + grp WHEN 'passage' THEN 200 - pos ELSE 300 END AS step, kind = 'passage' AND pos = 1 AS stays FROM p)
SELECT context, kind, CAST(grp AS INTEGER) AS grp, CAST(pos AS INTEGER) AS pos, stays OR total - coalesce((SELECT sum(size) FROM o b WHERE b.context = a.context AND b.step < a.step AND NOT b.stays), 0) <= 60 AS kept FROM o a JOIN t USING (context)""")
def retrieve_context_budget(spark: SparkSession, sf: str) -> DataFrame:
    """RT-23: the largest group's tail first, then passages, then history and evidence."""
    parts = view(spark, sf, PARTS, "lineitem", "orders")
    return S.context_parts(parts, 60).select("context", "kind", F.col("grp").cast("int").alias("grp"), F.col("pos").cast("int").alias("pos"), "kept")


#: What may follow from a difference, by topic: the assertion it touches and what to look at.
GUIDANCE = (
    ("amount", "accuracy", "Agree the invoice total to the ledger, with taxes, freight and discounts"), ("quantity", "existence", "Agree item, unit and shipment, and the goods received notes"), ("date", "cut-off", "Tell issue, shipment and receipt apart under the delivery terms"),
    ("currency", "accuracy", "Find the rate and its source; never subtract across currencies"), ("identity", "occurrence", "Confirm the link by contract, order and common references"), ("other", "evidence", "Compare what the fields mean and what was compared"),
)


@query(f"""{recon.WITH}, g(topic, assertion, action) AS (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for a, b, c in GUIDANCE)}), c AS (SELECT transaction_id, check_id, {recon._TOPIC} AS topic FROM all_checks WHERE status IN ('flag', 'review')) SELECT * FROM c JOIN g USING (topic)""")
def review_insights(spark: SparkSession, sf: str) -> DataFrame:
    """RV-19: guidance for flags and reviews alone, tied to the check."""
    rows = recon.all_checks(spark, sf).where(F.col("status").isin("flag", "review"))
    topics = rows.select("transaction_id", "check_id", V.topic(F.col("type"), F.array_compact(F.array("left_field", "right_field"))).alias("topic"))
    return topics.join(F.broadcast(spark.createDataFrame(GUIDANCE, "topic string, assertion string, action string")), "topic")


SAVED = "SELECT o_orderkey AS doc_id, f AS field, CASE f WHEN 'total_amount' THEN CASE WHEN o_orderkey % 4 = 0 THEN '0' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END ELSE CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'USD' END END AS value, seen_at FROM {orders} CROSS JOIN (VALUES ('total_amount', 1), ('currency', 1), ('currency', 2)) AS v(f, seen_at) WHERE o_orderkey % 5 <> 0"
GOLD = "SELECT o_orderkey AS doc_id, f AS field, CASE f WHEN 'total_amount' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) ELSE CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'USD' END END AS value FROM {orders} CROSS JOIN (VALUES ('total_amount'), ('currency')) AS v(f)"


@query(f"""WITH s AS ({plain(SAVED)}), l AS (SELECT doc_id, field, arg_max(coalesce(value, chr(0)), seen_at) AS v FROM s GROUP BY ALL), g AS ({plain(GOLD)}),
j AS (SELECT g.doc_id, g.field, g.value AS gold, nullif(l.v, chr(0)) AS said, l.doc_id IS NOT NULL AS replayed FROM g LEFT JOIN l USING (doc_id, field))
SELECT doc_id, bool_or(replayed) AS replayed, count(*) FILTER (said = gold) AS tp, count(*) FILTER (said IS NOT NULL AND said IS DISTINCT FROM gold) AS fp, count(*) FILTER (gold IS NOT NULL AND said IS DISTINCT FROM gold) AS fn,
  sha256(coalesce(string_agg(field || '=' || said, chr(10) ORDER BY field) FILTER (said IS NOT NULL), '')) AS response_sha FROM j GROUP BY doc_id""")
def eval_replay(spark: SparkSession, sf: str) -> DataFrame:
    """EV-23: saved answers of a model scored again, with the digest of what was scored; documents without one are scored as empty."""
    return E.replayed(view(spark, sf, SAVED, "orders"), view(spark, sf, GOLD, "orders"))
