"""Scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..operators import evaluate as E
from .base import plain, query, table, view

#: Gold and predicted fields made from orders: by modulus the prediction is right, wrong, missing or an answer where none was due.
FIELDS = """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'commercial_invoice' WHEN 1 THEN 'packing_list' ELSE 'bill_of_lading' END AS document_type, CASE WHEN o_orderkey % 2 = 0 THEN 'plain' ELSE 'dense' END AS family, f AS field,
  CASE WHEN (o_orderkey + n) % 7 = 0 THEN NULL ELSE f || CAST(o_orderkey AS STRING) END AS expected,
  CASE WHEN (o_orderkey + n) % 5 = 0 THEN NULL WHEN (o_orderkey + n) % 11 = 0 THEN 'wrong' WHEN (o_orderkey + n) % 7 = 0 THEN NULL ELSE f || CAST(o_orderkey AS STRING) END AS got,
  CASE WHEN (o_orderkey + n) % 13 = 0 THEN NULL WHEN (o_orderkey + n) % 5 = 0 THEN 'review' ELSE 'accepted' END AS status, (o_orderkey + n) % 17 = 0 AS expected_review,
  CASE WHEN (o_orderkey + n) % 3 = 0 THEN 'ambiguous_number_separator' ELSE '' END AS issue, (o_orderkey + n) % 19 = 0 AS row_missing
FROM {orders} CROSS JOIN (VALUES ('issue_date', 1), ('total_amount', 2), ('currency', 3), ('buyer', 4)) AS fields(f, n)
"""
_OK = "expected IS NOT DISTINCT FROM got"
_SUMS = f"CAST(count(*) FILTER ({_OK} AND expected IS NOT NULL) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT ({_OK}) AND got IS NOT NULL) AS BIGINT) AS fp, CAST(count(*) FILTER (NOT ({_OK}) AND expected IS NOT NULL) AS BIGINT) AS fn, CAST(count(*) FILTER ({_OK} AND expected IS NULL) AS BIGINT) AS tn"
_W = f"WITH f AS ({plain(FIELDS)})"


def fields(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, FIELDS, "orders")


def _counts(rows: DataFrame, *keys: str) -> DataFrame:
    ok = F.coalesce(N.equal_for_scoring(F.col("expected"), F.col("got"), F.lit("text")), F.lit(False))
    return rows.groupBy(*keys).agg(*(c.alias(n) for n, c in E.confusion(F.col("expected"), F.col("got"), ok).items()))


@query(f"{_W}, c AS (SELECT field, {_SUMS} FROM f GROUP BY 1) SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM c")
def eval_field_rates(spark: SparkSession, sf: str) -> DataFrame:
    """EV-02 and EV-03."""
    return E.with_rates(_counts(fields(spark, sf), "field"))


@query(f"{_W} SELECT document_type, family, field, {_SUMS} FROM f GROUP BY GROUPING SETS ((document_type), (document_type, family), (document_type, field), ())")
def eval_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """EV-04: document type, layout family, field and all, in one pass over pre-summed rows."""
    base = _counts(fields(spark, sf), "document_type", "family", "field")
    return E.rollup_counts(base, [["document_type"], ["document_type", "family"], ["document_type", "field"], []])


@query(f"{_W}, c AS (SELECT document_type, field, {_SUMS} FROM f GROUP BY ALL) SELECT document_type, field FROM c WHERE (tp + fp > 0 AND tp / (tp + fp) < 0.95) OR (tp + fn > 0 AND tp / (tp + fn) < 0.95)")
def eval_low_fields(spark: SparkSession, sf: str) -> DataFrame:
    """EV-08: fields under the target."""
    return E.with_rates(_counts(fields(spark, sf), "document_type", "field")).where("precision < 0.95 OR recall < 0.95").select("document_type", "field")


@query("SELECT event_type, median(value) AS median_value, max(value) AS max_value FROM events GROUP BY 1")
def eval_timings(spark: SparkSession, sf: str) -> DataFrame:
    """EV-08: median and maximum."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.median("value").alias("median_value"), F.max("value").alias("max_value"))


@query(f"""{_W} SELECT doc_id, field, CASE WHEN status IS NULL THEN 'missing_applicable_field_or_status' ELSE 'ambiguous_source_requires_null_and_review' END AS issue FROM f WHERE status IS NULL OR (expected_review AND (status <> 'review' OR got IS NOT NULL))""")
def eval_contract(spark: SparkSession, sf: str) -> DataFrame:
    """EV-06."""
    rows = fields(spark, sf).select("doc_id", "field", F.col("got").alias("value"), "status", "expected_review")
    return E.contract_issues(rows).select("doc_id", "field", "issue")


@query(f"""{_W} SELECT CASE WHEN row_missing THEN 'item_row_link' WHEN got IS NOT NULL THEN 'wrong_field_link' WHEN issue <> '' THEN 'normalization' WHEN status = 'review' THEN 'evidence_validation' ELSE 'model_nonproposal' END AS cause, count(*) AS n FROM f WHERE NOT ({_OK}) GROUP BY 1""")
def eval_causes(spark: SparkSession, sf: str) -> DataFrame:
    """EV-07."""
    wrong = fields(spark, sf).where("NOT (expected <=> got)").withColumn("value", F.col("got"))
    return wrong.groupBy(E.error_cause().alias("cause")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), p AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS row_id FROM lineitem),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_id) AS place FROM p) SELECT doc_id, row_id, CAST(place AS INTEGER) AS place FROM q LEFT JOIN g USING (doc_id) WHERE place > coalesce(n, 0)""")
def eval_extra_rows(spark: SparkSession, sf: str) -> DataFrame:
    """EV-05."""
    li = table(spark, sf, "lineitem")
    gold = li.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("doc_id"))
    return E.extra_rows(li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("row_id")).distinct(), gold)


@query("""SELECT o_orderkey AS doc_id, 'fields.' || k AS path, v AS value FROM (SELECT o_orderkey, unnest([{'k': 'status', 'v': o_orderstatus}, {'k': 'priority', 'v': o_orderpriority}], recursive := true) FROM orders)
UNION ALL SELECT l_orderkey, 'items.' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) - 1) || '.flag', l_returnflag FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey""")
def eval_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """EV-01."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    line = F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    rows = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.create_map(F.lit("flag"), x["l_returnflag"])).alias("items"))
    head = o.select(F.col("o_orderkey").alias("doc_id"), F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("fields"))
    return E.flatten_gold(head.join(rows, "doc_id", "left"))


@query("""WITH e AS (SELECT o_custkey AS k, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 3 <> 0),
f AS (SELECT o_custkey AS k, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 4 <> 0)
SELECT coalesce(e.k, f.k) AS k, coalesce(e.s, f.s) AS s, count(*) FILTER (e.k IS NOT NULL AND f.k IS NOT NULL) AS tp, count(*) FILTER (e.k IS NULL) AS fp, count(*) FILTER (f.k IS NULL) AS fn FROM e FULL OUTER JOIN f ON e.k = f.k AND e.s = f.s AND e.n = f.n GROUP BY 1, 2""")
def eval_greedy_points(spark: SparkSession, sf: str) -> DataFrame:
    """EV-15: audit points consumed one to one."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"), "o_orderkey")
    return E.greedy_matches(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 4 <> 0"), ["k", "s"], "o_orderkey", "o_orderkey")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS tx, l_returnflag AS kind, CASE WHEN l_orderkey % 2 = 0 THEN 'F' ELSE 'O' END AS status FROM lineitem), a AS (SELECT l_orderkey AS tx, l_returnflag AS kind, l_linestatus AS st FROM lineitem WHERE l_linenumber > 2)
SELECT tx, kind, status, count(st) AS n_candidates, coalesce(bool_and(st = status), FALSE) AS correct FROM e LEFT JOIN a USING (tx, kind) GROUP BY ALL""")
def eval_check_matching(spark: SparkSession, sf: str) -> DataFrame:
    """EV-14."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tx"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("status"), "l_linenumber")
    want = li.select("tx", "kind", F.when(F.col("tx") % 2 == 0, "F").otherwise("O").alias("status")).distinct()
    return E.check_matching(want, li.where("l_linenumber > 2"), ["tx", "kind"])


@query("""WITH l AS (SELECT l_orderkey AS tx, 'P' || l_partkey AS code, max(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL) SELECT tx, code, CASE WHEN n = 1 THEN CAST(q AS VARCHAR) END AS actual, n = 1 AS correct FROM l""")
def eval_truth_items(spark: SparkSession, sf: str) -> DataFrame:
    """EV-13: an item is found only if its product code names one row."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("tx"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("code")).agg(F.max("l_quantity").alias("q"), F.count("*").alias("n"))
    return li.select("tx", "code", F.when(F.col("n") == 1, F.col("q").cast("string")).alias("actual"), (F.col("n") == 1).alias("correct"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def eval_corpus_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """EV-17 and EV-09: documents without annotation."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("""WITH r AS (SELECT item_id, text, CASE WHEN item_id % 9 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS seal FROM benchmark) SELECT item_id, length(text) > 150 AS passed FROM r WHERE sha256(text) = seal""")
def eval_sealed(spark: SparkSession, sf: str) -> DataFrame:
    """EV-18: scored only while the seal holds."""
    own = F.sha2("text", 256)
    rows = table(spark, sf, "benchmark").withColumn("seal", F.when(F.col("item_id") % 9 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(own))
    return E.sealed(rows, "text", "seal").select("item_id", (F.length("text") > 150).alias("passed"))


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') AND NOT contains(lower(text), 'ou') THEN 'pass' ELSE 'fail' END AS outcome FROM conversations WHERE role = 'assistant'""")
def eval_chat_contains(spark: SparkSession, sf: str) -> DataFrame:
    """EV-19: must contain, must not contain."""
    low = F.lower("text")
    wanted, banned = F.array(F.lit("the")), F.array(F.lit("ou"))
    ok = F.forall(wanted, lambda w: low.contains(w)) & ~F.exists(banned, lambda w: low.contains(w))
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.when(ok, "pass").otherwise("fail").alias("outcome"))


@query("""WITH want AS (SELECT item_id, item_id % 7 AS tx, item_id % 5 AS paragraph FROM benchmark), have AS (SELECT DISTINCT o_orderkey % 6 AS tx, o_orderkey % 5 AS paragraph FROM orders) SELECT want.tx, bool_and(have.tx IS NOT NULL) AS complete FROM want LEFT JOIN have USING (tx, paragraph) GROUP BY 1""")
def eval_required_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """EV-20."""
    want = table(spark, sf, "benchmark").select((F.col("item_id") % 7).alias("tx"), (F.col("item_id") % 5).alias("paragraph"))
    have = table(spark, sf, "orders").select((F.col("o_orderkey") % 6).alias("tx"), (F.col("o_orderkey") % 5).alias("paragraph")).distinct().withColumn("found", F.lit(True))
    return want.join(have, ["tx", "paragraph"], "left").groupBy("tx").agg(F.bool_and(F.coalesce("found", F.lit(False))).alias("complete"))


@query(f"{_W} SELECT doc_id, field, got FROM f WHERE got IS NOT NULL AND expected IS NULL")
def eval_unannotated(spark: SparkSession, sf: str) -> DataFrame:
    """EV-21: predictions with no declared truth, kept out of recall."""
    f = fields(spark, sf)
    declared = f.where("expected IS NOT NULL").select("doc_id", "field")
    return f.where("got IS NOT NULL").join(declared, ["doc_id", "field"], "left_anti").select("doc_id", "field", "got")


@query(f"{_W}, s AS (SELECT document_type, {_SUMS} FROM f GROUP BY 1) SELECT document_type, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, fp AS false_non_null, tp + tn AS exact_matches FROM s")
def eval_benchmark_score(spark: SparkSession, sf: str) -> DataFrame:
    """EV-10 and EV-22."""
    return E.with_rates(_counts(fields(spark, sf), "document_type")).select("document_type", "precision", F.col("fp").alias("false_non_null"), (F.col("tp") + F.col("tn")).alias("exact_matches"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name) AS distance FROM n a JOIN n b ON a.p_name < b.p_name AND split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2)""")
def eval_edit_distance(spark: SparkSession, sf: str) -> DataFrame:
    """EV-11, between distinct names that share their last word."""
    n = table(spark, sf, "part").select("p_name", F.element_at(F.split("p_name", " "), 2).alias("w")).distinct()
    a, b = n.withColumnRenamed("p_name", "a"), n.withColumnRenamed("p_name", "b")
    return a.join(b, "w").where("a < b").select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"))


REGIONS = """
SELECT l_orderkey AS page, l_linenumber AS gold_id, 10.0 * l_linenumber + 5 AS cx, 5.0 AS cy, l_returnflag || l_linestatus AS text FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS x
"""
BOXES = """
SELECT l_orderkey AS page, b AS box_id, CASE WHEN b = 1 THEN 0.0 ELSE 40.0 END AS `left`, CASE WHEN b = 1 THEN 42.0 ELSE 60.0 END AS `right`, 0.0 AS top, 10.0 AS bottom, CASE WHEN b = 1 THEN 'AF NO' ELSE 'RF' END AS text FROM (SELECT DISTINCT l_orderkey FROM {lineitem}) AS x CROSS JOIN (VALUES (1), (2)) AS boxes(b)
"""


@query(f"""WITH t AS ({plain(REGIONS)}), b AS ({plain(BOXES)}), own AS (SELECT t.page, t.gold_id, t.cx, t.text, min(b.box_id) AS box_id FROM t JOIN b ON t.page = b.page AND cx BETWEEN "left" - 4 AND "right" + 4 AND cy BETWEEN top - 4 AND bottom + 4 GROUP BY ALL),
w AS (SELECT page, box_id, string_agg(text, ' ' ORDER BY cx, gold_id) AS want FROM own GROUP BY ALL), e AS (SELECT b.page, levenshtein(coalesce(want, ''), b.text) AS edits FROM b LEFT JOIN w USING (page, box_id) UNION ALL SELECT page, length(text) FROM t ANTI JOIN own USING (page, gold_id)),
n AS (SELECT page, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM t GROUP BY 1), s AS (SELECT page, CAST(sum(edits) AS BIGINT) AS edits FROM e GROUP BY 1) SELECT page, edits, n_chars, edits / n_chars AS cer FROM n JOIN s USING (page)""")
def eval_region_cer(spark: SparkSession, sf: str) -> DataFrame:
    """EV-12."""
    return E.region_errors(view(spark, sf, REGIONS, "lineitem"), view(spark, sf, BOXES, "lineitem"))


@query(r"""SELECT doc_id, 'assigned_secret' AS pattern FROM documents WHERE regexp_matches(text, '(?i)(api[_-]?key|secret|token|passwd|password)\s*[:=]\s*["''][^"'']{8,}["'']') UNION ALL SELECT doc_id, 'private_key' FROM documents WHERE regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----')
UNION ALL SELECT doc_id, 'cloud_key_id' FROM documents WHERE regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b') UNION ALL SELECT doc_id, 'bearer' FROM documents WHERE regexp_matches(text, '(?i)\bbearer\s+[a-z0-9._-]{20,}')""")
def eval_pattern_scan(spark: SparkSession, sf: str) -> DataFrame:
    """EV-24."""
    return E.pattern_scan(table(spark, sf, "documents"), "text").select("doc_id", "pattern")


@query(f"""{_W}, c AS (SELECT doc_id, count(*) FILTER (got IS NOT NULL AND status = 'accepted') AS n_linked, count(*) AS n FROM f GROUP BY 1) SELECT doc_id, n_linked = n AS linked FROM c""")
def eval_linking(spark: SparkSession, sf: str) -> DataFrame:
    """EV-16: right only if all that was submitted is linked."""
    return fields(spark, sf).groupBy("doc_id").agg((F.count(F.when(F.col("got").isNotNull() & (F.col("status") == "accepted"), 1)) == F.count("*")).alias("linked"))
