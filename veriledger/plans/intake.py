"""Intake, catalogue, reference and caption queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogues as C
from ..sources import pages as P
from . import grounded
from .base import plain, query, table, view


@query("""WITH g AS (SELECT l_orderkey AS upload_id, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT) * 300000) AS BIGINT) AS total, bool_or(l_partkey % 7 = 0) AS bad FROM lineitem GROUP BY 1)
SELECT upload_id, n, total, array_to_string(list_filter([CASE WHEN n > 5 THEN 'too_many_files' END, CASE WHEN total > 64000000 THEN 'too_large' END, CASE WHEN bad THEN 'suffix_not_taken' END], lambda x: x IS NOT NULL), ',') AS issues FROM g""")
def source_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """IO-07."""
    m = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("upload_id"), F.when(F.col("l_partkey") % 7 == 0, "a.exe").otherwise("a.JSON").alias("name"), (F.col("l_quantity").cast("long") * 300000).alias("bytes"))
    return C.upload_issues(m, most_files=5)


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS caption, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) AS n FROM pages)
SELECT page_id, href, arg_min(caption, n) AS caption FROM a GROUP BY ALL""")
def source_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """IO-13: list rows of a page by pattern."""
    return C.catalogue(table(spark, sf, "pages"))


@query("""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(html, '<html lang="(\\w+)"', 1), '') AS lang, CASE WHEN nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '') IS NULL THEN 'no_title' END AS error FROM pages""")
def source_page_heads(spark: SparkSession, sf: str) -> DataFrame:
    """IO-14 and RT-07."""
    return C.page_heads(table(spark, sf, "pages"))


@query("""WITH r AS (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id) AS n FROM documents) SELECT source, doc_id, lang FROM r WHERE n = 1 AND (SELECT count(DISTINCT source) FROM documents) >= 3""")
def source_preferred(spark: SparkSession, sf: str) -> DataFrame:
    """IO-13: one row a number, the preferred format first, nothing when the list looks broken."""
    d = table(spark, sf, "documents").select("source", "doc_id", "lang")
    return C.preferred(d, "source", [F.when(F.col("lang") == "en", 0).otherwise(1), F.col("doc_id")])


@query("""SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2')""")
def source_rights(spark: SparkSession, sf: str) -> DataFrame:
    """IO-17: three grants and a reference."""
    g = spark.createDataFrame([("src1", "r", True, True, True), ("src2", "x", True, True, True), ("src3", "", True, True, True), ("src4", "r", True, False, True)], "source string, reference string, store boolean, search boolean, show boolean")
    return C.with_rights(table(spark, sf, "documents").select("doc_id", "source"), g, "source")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS u, o_custkey % 40 + 100000 AS v FROM orders WHERE o_orderkey % 3 = 0), s AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT u AS node, u AS root FROM s UNION SELECT s.u, r.root FROM s JOIN r ON s.v = r.node) SELECT node, min(root) AS root FROM r GROUP BY 1""")
def recon_reference_chains(spark: SparkSession, sf: str) -> DataFrame:
    """RC-03: references joined through others."""
    pairs = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") % 40 + 100000).alias("b")).distinct()
    return C.reference_chains(pairs)


PORTS = "SELECT o_orderkey AS doc_id, 1 AS page, n AS tid, CASE WHEN n = 0 THEN 'POL' WHEN n = 1 THEN 'POD' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'POD' ELSE 'x' END END AS text, CASE WHEN n = 1 AND o_orderkey % 5 = 0 THEN 900.0 ELSE 100.0 + 20 * n END AS y, 18.0 AS h FROM {orders} CROSS JOIN (VALUES (0), (1), (2)) AS v(n)"


@query(f"""WITH p AS (SELECT * FROM ({plain(PORTS)}) WHERE text IN ('POL', 'POD')), n AS (SELECT a.doc_id, a.tid, a.text, count(*) AS n FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.text <> b.text AND abs(a.y - b.y) <= 8 * a.h GROUP BY ALL) SELECT doc_id, tid, CASE text WHEN 'POL' THEN 'port_of_loading' ELSE 'port_of_discharge' END AS field FROM n WHERE n = 1""")
def label_ports(spark: SparkSession, sf: str) -> DataFrame:
    """LB-26."""
    return C.port_pairs(view(spark, sf, PORTS, "orders")).select("doc_id", "tid", "field")


PARTIES = "SELECT o_orderkey AS doc_id, f AS field, CASE WHEN f = 'notify' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Same as consignee' ELSE 'Acme' END ELSE 'Buyer ' || CAST(o_custkey AS STRING) END AS value, CASE WHEN f = 'consignee' AND o_orderkey % 7 = 0 THEN 'review' ELSE 'accepted' END AS status FROM {orders} CROSS JOIN (VALUES ('notify'), ('consignee')) AS v(f)"


@query(f"""WITH c AS ({plain(PARTIES)}), x AS (SELECT *, nullif(regexp_extract(lower(value), '^same as (\\w+)$', 1), '') AS target FROM c) SELECT x.doc_id, x.field, CASE WHEN x.target IS NULL THEN x.value ELSE k.value END AS value, CASE WHEN x.target IS NOT NULL AND k.value IS NULL THEN 'review' ELSE x.status END AS status, x.target AS reference_field, CASE WHEN x.target IS NOT NULL AND k.value IS NULL THEN 'referenced_field_unresolved' END AS null_reason
FROM x LEFT JOIN c k ON k.doc_id = x.doc_id AND k.field = x.target AND k.status = 'accepted' AND NOT regexp_matches(lower(k.value), '^same as ')""")
def ground_party_reference(spark: SparkSession, sf: str) -> DataFrame:
    """GE-19."""
    return C.party_references(view(spark, sf, PARTIES, "orders"))


@query(f"WITH c AS ({plain(PARTIES)}) SELECT * FROM c UNION ALL SELECT doc_id, 'notify_party', value, status FROM c WHERE field = 'notify'")
def ground_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """GE-21."""
    return C.aliases(view(spark, sf, PARTIES, "orders"), {"notify": "notify_party"})


MONEY = "SELECT l_orderkey AS doc_id, 'amount' AS field, CAST(l_quantity AS STRING) || CASE WHEN l_orderkey % 5 = 0 AND l_linenumber % 2 = 0 THEN ' EUR' WHEN l_orderkey % 7 = 0 THEN '' ELSE ' USD' END AS text FROM {lineitem}"


@query(f"WITH m AS ({plain(MONEY)}), c AS (SELECT doc_id, regexp_extract(text, '\\b([A-Z]{{3}})\\b', 1) AS code FROM m) SELECT doc_id, CASE WHEN count(DISTINCT code) = 1 THEN min(code) END AS currency, CASE WHEN count(DISTINCT code) = 1 THEN 'accepted' ELSE 'review' END AS status FROM c WHERE code <> '' GROUP BY 1")
def ground_column_currency(spark: SparkSession, sf: str) -> DataFrame:
    """GE-24."""
    return C.column_currency(view(spark, sf, MONEY, "lineitem"))


@query("""WITH h AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS value FROM orders WHERE o_orderkey % 4 <> 0), t AS (SELECT o_orderkey AS doc_id, o_orderpriority AS total FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(h.doc_id, t.doc_id) AS doc_id, 'total_packages' AS field, coalesce(value, total) AS value, CASE WHEN value IS NOT NULL THEN 'header' ELSE 'total_row' END AS origin FROM h FULL OUTER JOIN t USING (doc_id)""")
def ground_totals(spark: SparkSession, sf: str) -> DataFrame:
    """GE-26 and LB-33."""
    o = table(spark, sf, "orders").withColumn("field", F.lit("total_packages"))
    h = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("doc_id"), "field", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("value"))
    return C.placed_totals(h, o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("doc_id"), "field", F.col("o_orderpriority").alias("value")))


@query(f"""WITH t AS ({plain(P.TOKENS)}), {grounded._VOC}, {grounded._LAB} SELECT doc_id, tid, text FROM t WHERE length(text) < 100 AND NOT regexp_matches(text, '^[\\d.,\\s%$€£-]+$') AND NOT EXISTS (SELECT 1 FROM lab WHERE lab.doc_id = t.doc_id AND lab.tid = t.tid)""")
def label_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """LB-14: what is left for a model to label."""
    return C.candidates(grounded.tokens(spark, sf), grounded.labels(spark, sf)).select("doc_id", "tid", "text")


@query(f"""WITH t AS ({plain(P.TOKENS)}) SELECT doc_id, tid, 'quantity' AS field FROM t WHERE tid = 8 AND doc_id % 3 <> 0""")
def label_responses(spark: SparkSession, sf: str) -> DataFrame:
    """LB-15: labels outside the candidates or with unknown fields are refused, null abstains."""
    t = grounded.tokens(spark, sf)
    said = t.where("tid IN (8, 9)").withColumn("field", F.when(F.col("tid") == 9, F.lit(None).cast("string")).when(F.col("doc_id") % 3 == 0, "made_up").otherwise("quantity"))
    fields = spark.createDataFrame([(f,) for f in sorted(set(P.VOCABULARY.values()))], "field string")
    return C.valid_responses(said.select("doc_id", "tid", "field"), t, fields).select("doc_id", "tid", "field")


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'attribution' WHEN 1 THEN 'structural' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'non_trade' END AS kind FROM part""")
def label_negative(spark: SparkSession, sf: str) -> DataFrame:
    """LB-06 and LB-23's classifiers."""
    text = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'Authorised Signature' WHEN 1 THEN 'Page 1 of 3' WHEN 2 THEN 'IMO Class 3' WHEN 3 THEN 'IBAN DE00' ELSE p_name END")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), C.negative_captions(text).alias("kind"))


#: Captions of three and of five lines beside captions of one.
STACKED = """SELECT o_orderkey AS doc_id, 1 AS page, n AS tid, CASE WHEN n = 9 THEN 'Quantity' WHEN o_orderkey % 7 = 0 THEN CASE n WHEN 0 THEN 'Place' WHEN 1 THEN 'and' WHEN 2 THEN 'Date' WHEN 3 THEN 'of' ELSE 'Issue' END
  ELSE CASE n WHEN 0 THEN 'Port' WHEN 1 THEN 'of' WHEN 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Loading' ELSE 'Discharge' END WHEN 3 THEN 'of' ELSE 'goods' END END AS text,
  20.0 AS x, CASE WHEN o_orderkey % 5 = 0 THEN 100.0 + 60 * n ELSE 100.0 + 20 * n END AS y, 18.0 AS h FROM {orders} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (9)) AS v(n)"""


@query("""SELECT o_orderkey AS doc_id, 0 AS "first", CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE 2 END AS last, CASE WHEN o_orderkey % 7 = 0 THEN 5 ELSE 3 END AS n, CASE WHEN o_orderkey % 7 = 0 THEN 'issue' WHEN o_orderkey % 3 = 0 THEN 'port_of_loading' ELSE 'port_of_discharge' END AS field
FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 9, 9, 1, 'quantity' FROM orders""")
def label_chains(spark: SparkSession, sf: str) -> DataFrame:
    """LB-20 and LB-21: captions over up to five lines."""
    voc = spark.createDataFrame([*P.VOCABULARY.items(), ("placeanddateofissue", "issue")], "term string, field string")
    return C.label_chains(view(spark, sf, STACKED, "orders"), voc).select("doc_id", "first", "last", "n", "field")
