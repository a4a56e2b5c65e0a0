"""Lookup, validator, state and history queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import review as V
from ..operators import state as S
from . import recon
from .base import plain, query, table, view

ANSWERS = """
SELECT o_orderkey AS id, 'Ledger shows ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) || ' USD for T' || CAST(o_orderkey AS STRING) || ' under IFRS 15.' AS evidence,
  CASE o_orderkey % 8 WHEN 0 THEN 'The amount is ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) || ' USD.' WHEN 1 THEN 'The amount is 12,000.50 usd.' WHEN 2 THEN 'IAS 2 applies to T' || CAST(o_orderkey AS STRING) || '.' WHEN 3 THEN 'Confirmation was completed.'
    WHEN 4 THEN 'Fraud is proven here.' WHEN 5 THEN 'IFRS 15 applies; entities shall recognise revenue.' WHEN 6 THEN 'T999999 differs by 5 KG.' ELSE 'Nothing to add.' END AS text, CASE WHEN o_orderkey % 3 = 0 THEN 'IFRS' ELSE 'LOCAL' END AS framework,
  CASE o_orderkey % 5 WHEN 0 THEN 'What is the amount on the invoice?' WHEN 1 THEN 'Which standard applies?' WHEN 2 THEN 'Show the original page' WHEN 3 THEN 'amount and IFRS paragraph' ELSE 'the supplier''s terms?' END AS question
FROM {orders}
"""
_A = f"WITH a AS ({plain(ANSWERS)})"
_CL = lambda c: f"list_distinct(list_transform(list_zip(regexp_extract_all({c}, '(?i)(-?\\d[\\d,]*(\\.\\d+)?)\\s*(USD|KRW|EUR|JPY|GBP|CNY|PCS|KG|%)', 1), regexp_extract_all({c}, '(?i)(-?\\d[\\d,]*(\\.\\d+)?)\\s*(USD|KRW|EUR|JPY|GBP|CNY|PCS|KG|%)', 3)), lambda z: CAST(CAST(replace(z[1], ',', '') AS DOUBLE) AS VARCHAR) || ' ' || upper(z[2])))"
_STD = lambda c: f"list_distinct(regexp_extract_all({c}, '(?i)(IFRS|IAS|Standard)\\s*(\\d{{1,4}})', 2))"


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, ANSWERS, "orders")


@query(f"{_A} SELECT id, CAST(len(list_filter({_CL('text')}, lambda x: NOT list_contains({_CL('evidence')}, x))) AS INTEGER) AS n_unsupported FROM a")
def qa_numeric_claims(spark: SparkSession, sf: str) -> DataFrame:
    """QA-07."""
    return answers(spark, sf).select("id", F.size(A.unsupported_claims(F.col("text"), F.col("evidence"))).alias("n_unsupported"))


@query(f"""{_A}, r AS (SELECT id, [CASE WHEN len(list_filter({_CL('text')}, lambda x: NOT list_contains({_CL('evidence')}, x))) > 0 THEN 'number_not_in_source' END, CASE WHEN len(list_filter({_STD('text')}, lambda x: NOT list_contains({_STD('evidence')}, x))) > 0 THEN 'standard_not_in_source' END,
 CASE WHEN regexp_matches(text, '(?i)\\bIFRS\\b') AND framework <> 'IFRS' THEN 'framework_differs' END, CASE WHEN contains(text, 'Confirmation was completed') THEN 'procedure_claimed' END, CASE WHEN contains(text, 'Fraud is proven') THEN 'certainty_claimed' END] AS e FROM a) SELECT id, array_to_string(list_filter(e, lambda x: x IS NOT NULL), ',') AS errors FROM r""")
def qa_claim_errors(spark: SparkSession, sf: str) -> DataFrame:
    """QA-08."""
    return answers(spark, sf).select("id", F.array_join(A.claim_errors(F.col("text"), F.col("evidence"), F.array("framework")), ",").alias("errors"))


@query(f"""{_A}, x AS (SELECT id, text, evidence, regexp_extract_all(text, '\\d+(\\.\\d+)?') AS tn, regexp_extract_all(evidence, '\\d+(\\.\\d+)?') AS en, regexp_extract_all(text, 'T\\d+') AS ti, regexp_extract_all(evidence, 'T\\d+') AS ei FROM a)
SELECT id, len(list_filter(tn, lambda z: NOT list_contains(en, z))) = 0 AND len(list_filter(ti, lambda z: NOT list_contains(ei, z))) = 0 AND (NOT regexp_matches(text, '(?i)\\b(shall|must)\\b') OR contains(evidence, text)) AS grounded FROM x""")
def qa_sentence_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """QA-09."""
    return A.sentence_grounding(answers(spark, sf).withColumnRenamed("evidence", "corpus")).select("id", "grounded")


@query(f"""{_A}, r AS (SELECT id, [CASE WHEN len(regexp_extract_all(text, '\\S+')) < 5 THEN 'too_short' END, CASE WHEN regexp_matches(text, '\\d') THEN 'has_digits' END, CASE WHEN regexp_matches(text, '\\b(IFRS|IAS)\\b') THEN 'has_standard' END] AS e FROM a) SELECT id, array_to_string(list_filter(e, lambda x: x IS NOT NULL), ',') AS errors FROM r""")
def qa_analysis_errors(spark: SparkSession, sf: str) -> DataFrame:
    """QA-10."""
    return answers(spark, sf).select("id", F.array_join(A.analysis_errors(F.col("text"), 5), ",").alias("errors"))


@query(f"{_A} SELECT id, CAST(len(list_filter(list_distinct(regexp_extract_all(text || ' EUR', '\\b(USD|KRW|EUR|JPY|GBP|CNY)\\b')), lambda x: x <> 'USD')) AS INTEGER) AS n_foreign FROM a")
def qa_currencies(spark: SparkSession, sf: str) -> DataFrame:
    """QA-11."""
    return answers(spark, sf).select("id", F.size(A.foreign_currencies(F.concat("text", F.lit(" EUR")), F.array(F.lit("USD")))).alias("n_foreign"))


@query("""SELECT item_id, regexp_matches(CASE WHEN item_id % 3 = 0 THEN 'Deduct the cost. ' || text || ' Then also deduct it.' ELSE text END, '(?is)deduct\\w*.{0,40}cost.*(again|also|further).{0,40}deduct') AS twice FROM benchmark""")
def qa_double_deduction(spark: SparkSession, sf: str) -> DataFrame:
    """QA-12."""
    t = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Deduct the cost. "), "text", F.lit(" Then also deduct it."))).otherwise(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", A.double_deduction(t).alias("twice"))


BLOCKS = "SELECT o_custkey AS answer, o_orderstatus AS text, o_orderkey AS position, o_orderpriority AS citation FROM {orders}"


@query(f"WITH b AS ({plain(BLOCKS)}) SELECT answer, text, min(position) AS position, string_agg(DISTINCT citation, ',' ORDER BY citation) AS citations FROM b GROUP BY ALL")
def qa_merged_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """QA-13: equal blocks merged, citations united."""
    b = view(spark, sf, BLOCKS, "orders").withColumn("citations", F.array("citation"))
    return A.merged_blocks(b).withColumn("citations", F.array_join("citations", ","))


@query(f"WITH b AS ({plain(BLOCKS)}), r AS (SELECT DISTINCT answer, unnest(['1-URGENT', '2-HIGH', '5-LOW']) AS citation FROM b) SELECT answer, citation FROM r ANTI JOIN b USING (answer, citation)")
def qa_uncovered_sources(spark: SparkSession, sf: str) -> DataFrame:
    """QA-13: required citations that no block uses."""
    b = view(spark, sf, BLOCKS, "orders").withColumn("citations", F.array("citation"))
    need = b.select("answer").distinct().withColumn("citation", F.explode(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "5-LOW")))))
    return A.uncovered_sources(b, need)


@query(f"""{_A} SELECT id, CASE id % 5 WHEN 0 THEN 'transaction' WHEN 1 THEN 'accounting_standard' WHEN 2 THEN 'evidence' WHEN 3 THEN 'hybrid' ELSE 'general' END AS route FROM a""")
def qa_route(spark: SparkSession, sf: str) -> DataFrame:
    """QA-04 and QA-05's fallback."""
    return answers(spark, sf).select("id", A.route(F.col("question")).alias("route"))


@query(f"{_A} SELECT id, id % 5 <> 4 OR contains(lower(text), 'supplier') AS on_target FROM a")
def qa_target(spark: SparkSession, sf: str) -> DataFrame:
    """QA-16."""
    return answers(spark, sf).select("id", A.answers_target(F.col("question"), F.col("text")).alias("on_target"))


_MSG = "CASE WHEN turn % 3 = 2 THEN 'running' ELSE 'complete' END AS status, CASE WHEN turn % 2 = 0 THEN 'state ' || CAST(turn AS STRING) END AS state"


@query(f"WITH m AS (SELECT conv_id, turn, {_MSG} FROM conversations) SELECT conv_id, turn, last_value(CASE WHEN status = 'complete' THEN state END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_state FROM m")
def qa_last_state(spark: SparkSession, sf: str) -> DataFrame:
    """QA-06."""
    return A.last_state(table(spark, sf, "conversations").selectExpr("conv_id", "turn", *_MSG.split(", CASE", 1)[:1], "CASE" + _MSG.split(", CASE", 1)[1])).select("conv_id", "turn", "previous_state")


@query(f"{recon.WITH} SELECT transaction_id, check_id, status FROM all_checks WHERE transaction_id IN (SELECT 'T' || item_id FROM benchmark)")
def qa_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """QA-01: checks of the transactions that questions name."""
    named = table(spark, sf, "benchmark").select(F.concat(F.lit("T"), F.col("item_id").cast("string")).alias("transaction_id"))
    return recon.all_checks(spark, sf).join(named, "transaction_id", "left_semi").select("transaction_id", "check_id", "status")


@query(f"""{recon.WITH}, g AS (SELECT transaction_id, area, type, event, max(rk) AS rk FROM ruled JOIN ranks USING (rule_status) WHERE area <> 'unmapped' GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY rk DESC, type, event) AS place FROM g WHERE rk > 1)
SELECT transaction_id, area, type || ':' || event AS group_id, ['NOT_APPLICABLE', 'PASS', 'REVIEW', 'MISSING', 'FAIL'][rk + 1] AS status, CAST(place AS INTEGER) AS place FROM i WHERE place <= 8""")
def qa_transaction_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """QA-02: the issue groups of each transaction, eight at most, as shown to a reader."""
    ruled = recon.ruled(spark, sf)
    g = ruled.where(V.area() != "unmapped").groupBy("transaction_id", V.area().alias("area"), "type", "event").agg(V.combined().alias("status")).where("status NOT IN ('PASS', 'NOT_APPLICABLE')")
    worst = F.expr("array_position(array('FAIL','MISSING','REVIEW'), status)")
    return A.bounded(g, ["transaction_id"], [worst, F.col("type"), F.col("event")], 8).select("transaction_id", "area", F.concat_ws(":", "type", "event").alias("group_id"), "status", "place")


@query(f"""{recon.WITH}, c AS (SELECT tx, document_type, field, value, row_number() OVER (PARTITION BY tx, document_type ORDER BY field) AS place FROM cells WHERE document_type <> 'ledger' AND value IS NOT NULL AND field IN ('total_amount', 'currency')) SELECT tx, document_type, field, value, CAST(place AS INTEGER) AS place FROM c WHERE place <= 12""")
def qa_evidence_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """QA-03 and QA-19: cells of the fields asked for and their companions, twelve at most a document."""
    from ..operators import reconcile as R
    from ..sources import trade

    cells = R.cells(recon.documents(spark, sf), trade.DOCUMENT_FIELDS).where("value IS NOT NULL")
    wanted = A.companion_fields(F.array(F.lit("total_amount")))
    return A.bounded(cells.where(F.array_contains(wanted, F.col("field"))), ["tx", "document_type"], [F.col("field")], 12).select("tx", "document_type", "field", "value", "place")


@query(f"{recon.WITH} SELECT transaction_id, check_id FROM checks WHERE left_field IN ('gross_weight', 'net_weight') OR right_field IN ('gross_weight', 'net_weight')")
def qa_field_checks(spark: SparkSession, sf: str) -> DataFrame:
    """QA-17."""
    want = F.array(F.lit("gross_weight"), F.lit("net_weight"))
    return recon.checks(spark, sf).where(F.arrays_overlap(F.array("left_field", "right_field"), want)).select("transaction_id", "check_id")


@query(f"""{recon._FINDINGS} SELECT transaction_id, finding_id, CASE WHEN difference <> 0 THEN left_doc || ' ' || left_value || ', ' || right_doc || ' ' || right_value || ': ' || left_doc || ' is ' || CASE WHEN difference > 0 THEN 'higher' ELSE 'lower' END || ' by ' || CAST(abs(CAST(difference AS DECIMAL(20,2))) AS VARCHAR)
 ELSE coalesce(left_doc || ' ' || coalesce(left_value, 'not seen') || ' / ' || right_doc || ' ' || coalesce(right_value, 'not seen') || ': ' || lower(status)) END AS sentence FROM found""")
def qa_fact_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """QA-14 and QA-20."""
    f = recon.found(spark, sf)
    return f.select("transaction_id", "finding_id", A.fact_sentence(F.col("left_doc"), F.col("left_value"), F.col("right_doc"), F.col("right_value"), F.col("difference").cast("decimal(20,2)"), F.col("status")).alias("sentence"))


@query(f"""{recon._FINDINGS} SELECT transaction_id, finding_id, 'f' || (row_number() OVER (PARTITION BY transaction_id ORDER BY finding_id) - 1) AS fact_id FROM found""")
def qa_numbered_facts(spark: SparkSession, sf: str) -> DataFrame:
    """QA-21."""
    return A.numbered_facts(recon.found(spark, sf), "transaction_id", [F.col("finding_id")]).select("transaction_id", "finding_id", "fact_id")


@query(f"{recon.WITH} SELECT transaction_id, string_agg(DISTINCT type, ', ' ORDER BY type) AS missing_titles FROM ruled WHERE rule_status = 'MISSING' GROUP BY 1")
def qa_missing_guidance(spark: SparkSession, sf: str) -> DataFrame:
    """QA-22."""
    return recon.ruled(spark, sf).where("rule_status = 'MISSING'").groupBy("transaction_id").agg(F.array_join(F.array_sort(F.collect_set("type")), ", ").alias("missing_titles"))


PROGRAMME = (("amount", "Agree amounts to the signed invoice"), ("date", "Agree dates to shipping papers"), ("identity", "Agree references to the order"), ("quantity", "Agree quantities to the packing list"))


@query(f"""{recon.WITH}, w AS (SELECT transaction_id, {recon._TOPIC} AS topic, count(*) AS n_checks FROM ruled WHERE rule_status IN ('FAIL', 'REVIEW') GROUP BY ALL), p(topic, step) AS (VALUES {', '.join(f"('{t}', '{s}')" for t, s in PROGRAMME)})
SELECT transaction_id, topic, step, n_checks, CAST(row_number() OVER (PARTITION BY transaction_id ORDER BY topic) AS INTEGER) AS number FROM w JOIN p USING (topic)""")
def qa_review_actions(spark: SparkSession, sf: str) -> DataFrame:
    """QA-23 and QA-24: actionable checks by topic against a programme of fixed size."""
    w = V.workpapers(recon.ruled(spark, sf)).select("transaction_id", "topic", "n_checks")
    p = spark.createDataFrame(PROGRAMME, "topic string, step string")
    return w.join(F.broadcast(p), "topic").withColumn("number", F.row_number().over(Window.partitionBy("transaction_id").orderBy("topic")))


# ---- state --------------------------------------------------------------------------------

_STATUS = "CASE event_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'awaiting_review' WHEN 3 THEN 'complete' WHEN 4 THEN 'failed' ELSE 'cancelled' END"


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumns({"status": F.expr(_STATUS), "job": F.col("user_id")})


@query(f"SELECT user_id AS job, arg_max({_STATUS}, (ts, event_id)) AS status FROM events GROUP BY 1")
def state_job_latest(spark: SparkSession, sf: str) -> DataFrame:
    """ST-01."""
    return S.latest(job_events(spark, sf), "job", ["ts", "event_id"], "status")


@query(f"WITH l AS (SELECT user_id AS job, arg_max({_STATUS}, (ts, event_id)) AS status FROM events GROUP BY 1) SELECT job, CASE WHEN status IN ('complete', 'partial', 'failed', 'cancelled') THEN status ELSE 'failed' END AS status FROM l")
def state_recovered(spark: SparkSession, sf: str) -> DataFrame:
    """ST-02."""
    return S.recover(state_job_latest(spark, sf))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS ordinal FROM events")
def state_ordered_commit(spark: SparkSession, sf: str) -> DataFrame:
    """ST-03: results take the upload order, whatever order they end in."""
    return table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("ordinal"))


@query("""WITH n AS (SELECT *, round((epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6, 3) AS seconds FROM events) SELECT user_id, event_id, event_type, seconds FROM n WHERE seconds > CASE event_type WHEN 'click' THEN 300 WHEN 'view' THEN 900 WHEN 'error' THEN 60 END""")
def state_timeouts(spark: SparkSession, sf: str) -> DataFrame:
    """ST-04."""
    return S.timeouts(table(spark, sf, "events"), "user_id", {"click": 300, "view": 900, "error": 60}).select("user_id", "event_id", "event_type", "seconds")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) AS n_recent FROM events")
def state_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """ST-05, the window form."""
    return S.attempts_in_window(table(spark, sf, "events"), "user_id").select("event_id", "user_id", "n_recent")


@query()
def state_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """ST-05, exact: each verdict depends on the verdicts before it, so there is no SQL twin; a test walks the rows."""
    return S.rate_limit(table(spark, sf, "events"), "user_id", limit=3, seconds=86_400)


@query("SELECT event_id, user_id FROM events WHERE ts + INTERVAL 43200 SECOND > TIMESTAMP '2024-01-20 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
def state_sessions_open(spark: SparkSession, sf: str) -> DataFrame:
    """ST-06."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return S.sessions_open(table(spark, sf, "events").where(F.col("ts") <= now), now).select("event_id", "user_id")


@query()
def state_cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    """ST-07 and ST-16: each user's cache of 128 entries that live from their write; a test walks the rows."""
    return S.cache_hits(table(spark, sf, "events"), "event_type", 1800, owner="user_id")


@query("SELECT d.doc_id, sha256(d.text || '|settings|v1') AS cache_key, d.doc_id % 2 = 0 AS cached FROM documents d WHERE text IS NOT NULL")
def state_content_cache(spark: SparkSession, sf: str) -> DataFrame:
    """ST-08 and RV-28: identity of an input is the hash of its bytes, settings and version."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(F.concat("text", F.lit("|settings|v1")), 256).alias("cache_key"))
    stored = d.where("doc_id % 2 = 0").select("doc_id").withColumn("hit", F.lit(True))
    return d.join(stored, "doc_id", "left").select("doc_id", "cache_key", F.coalesce("hit", F.lit(False)).alias("cached"))


@query("WITH j AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) SELECT user_id, event_id, CAST(seq AS INTEGER) AS seq FROM j WHERE seq > 5")
def state_journal_after(spark: SparkSession, sf: str) -> DataFrame:
    """ST-09."""
    return S.read_after(S.journal(table(spark, sf, "events"), "user_id"), 5).select("user_id", "event_id", "seq")


@query(f"WITH m AS (SELECT conv_id, turn, {_MSG} FROM conversations) SELECT conv_id, count(*) AS n, CASE WHEN bool_or(status = 'running') THEN 'running' WHEN count(*) >= 100 THEN 'full' ELSE 'open' END AS admission FROM m GROUP BY 1")
def state_admission(spark: SparkSession, sf: str) -> DataFrame:
    """ST-10."""
    m = table(spark, sf, "conversations").withColumn("status", F.when(F.col("turn") % 3 == 2, "running").otherwise("complete"))
    return S.admission(m)


@query("SELECT e.event_id, e.user_id, s.conv_id FROM events e JOIN (SELECT DISTINCT conv_id, conv_id % 150 AS owner FROM conversations) s ON e.user_id = s.owner")
def state_owned(spark: SparkSession, sf: str) -> DataFrame:
    """ST-12: each session sees the rows of its owner and no others."""
    s = table(spark, sf, "conversations").select("conv_id", (F.col("conv_id") % 150).alias("user_id")).distinct()
    return table(spark, sf, "events").select("event_id", "user_id").join(s, "user_id").select("event_id", "user_id", "conv_id")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def state_newest(spark: SparkSession, sf: str) -> DataFrame:
    """ST-13: a top-k report."""
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts")


@query(f"""WITH l AS (SELECT user_id AS job, arg_max({_STATUS}, (ts, event_id)) AS status FROM events GROUP BY 1) SELECT job, status FROM l WHERE status IN ('complete', 'partial') AND job % 3 <> 0 AND job IN (SELECT user_id FROM events WHERE event_type = 'click')""")
def state_resumable(spark: SparkSession, sf: str) -> DataFrame:
    """ST-15."""
    jobs = state_job_latest(spark, sf)
    drafts = jobs.where("job % 3 = 0").select("job")
    tasks = table(spark, sf, "events").where("event_type = 'click'").select(F.col("user_id").alias("job"), F.lit("running").alias("task_status"))
    return S.resumable(jobs, drafts, tasks)


@query("""WITH w AS (SELECT event_id, user_id AS worker, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT event_id, worker, coalesce(event_type = p, FALSE) AS reused FROM w""")
def state_warm_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """ST-17."""
    return S.warm_reuse(table(spark, sf, "events").withColumn("worker", F.col("user_id")), ["event_type"]).select("event_id", "worker", "reused")


@query("""WITH l AS (SELECT user_id, event_id % 40 AS record, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM l) SELECT user_id, record, event_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10""")
def state_history(spark: SparkSession, sf: str) -> DataFrame:
    """ST-18: the newest of each owner, bounded as the feature asks."""
    e = table(spark, sf, "events").withColumn("record", F.col("event_id") % 40)
    return S.history(e, "user_id", "record", 10).select("user_id", "record", "event_id", "place")


@query("""WITH h AS (SELECT doc_id, text, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL) SELECT doc_id, min(doc_id) OVER (PARTITION BY content_hash) AS first_id, doc_id = min(doc_id) OVER (PARTITION BY content_hash) AS accepted FROM h""")
def review_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """RV-25: equal content, the first in order is accepted."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return V.first_of_duplicates(d, F.col("text"), "doc_id").select("doc_id", F.col("first_ordinal").alias("first_id"), "accepted")


@query("""SELECT doc_id, sha256(text) = CASE WHEN doc_id % 10 = 0 THEN sha256(text || '!') ELSE sha256(text) END AND doc_id % 3 <> 0 AS verified FROM documents WHERE text IS NOT NULL""")
def review_verified_set(spark: SparkSession, sf: str) -> DataFrame:
    """RV-31: verified, confident and with an unchanged hash."""
    stored = F.when(F.col("doc_id") % 10 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", ((F.sha2("text", 256) == stored) & (F.col("doc_id") % 3 != 0)).alias("verified"))


@query("""WITH e AS (SELECT DISTINCT 'dir/' || source || '.json' AS file, source FROM documents), u AS (SELECT DISTINCT source || '.json' AS name, lang FROM documents) SELECT source, lang FROM e JOIN u ON string_split(file, '/')[-1] = name""")
def review_upload_map(spark: SparkSession, sf: str) -> DataFrame:
    """RV-34: entities meet uploads by file name."""
    d = table(spark, sf, "documents")
    e = d.select("source").distinct().withColumn("file", F.concat(F.lit("dir/"), "source", F.lit(".json")))
    u = d.select(F.concat("source", F.lit(".json")).alias("name"), "lang").distinct()
    return e.join(u, F.element_at(F.split("file", "/"), -1) == F.col("name")).select("source", "lang")


ELIGIBLE = (("ledger_invoice_amount_comparison", "1115", "amount"), ("document_gross_weight_comparison", "1002", "quantity"), ("invoice_transaction_date_review", "1115", "date"), ("reference_booking_number", "1109", "identity"))


@query(f"""{recon.WITH}, el(type, standard, topic) AS (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for a, b, c in ELIGIBLE)}) SELECT transaction_id, standard, count(*) AS n_checks, min(check_id) AS first_check FROM ruled JOIN el USING (type) WHERE rule_status IN ('FAIL', 'REVIEW') GROUP BY ALL""")
def review_eligible_standards(spark: SparkSession, sf: str) -> DataFrame:
    """RV-22, RV-23 and RV-30: checks to the standards they may cite, by a dimension of fixed size."""
    el = spark.createDataFrame(ELIGIBLE, "type string, standard string, topic string")
    r = recon.ruled(spark, sf).where("rule_status IN ('FAIL', 'REVIEW')").join(F.broadcast(el), "type")
    return r.groupBy("transaction_id", "standard").agg(F.count("*").alias("n_checks"), F.min("check_id").alias("first_check"))
