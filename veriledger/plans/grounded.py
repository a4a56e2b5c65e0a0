"""Label, geometry and grounding queries over the page tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grounding as G
from ..sources import pages as P
from .base import plain, query, view

_T = f"WITH t AS ({plain(P.TOKENS)})"
_KEY = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
_VOC = f"voc(term, field) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in P.VOCABULARY.items())})"
_LAB = f"lab AS (SELECT t.*, field, trim(regexp_extract(text, ':\\s*(\\S.*)$', 1)) AS inline FROM t JOIN voc ON {_KEY('split_part(text, chr(58), 1)')} = term)"
_UNIT = "u AS (SELECT doc_id, median(greatest(h, 1)) AS unit FROM t GROUP BY 1)"


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, P.TOKENS, "orders").withColumns({"page": F.col("page").cast("int"), "tid": F.col("tid").cast("int"), **{c: F.col(c).cast("double") for c in ("x", "y", "w", "h", "confidence")}})


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return G.lexical_labels(tokens(spark, sf), P.VOCABULARY)


@query(f"{_T}, {_UNIT} SELECT doc_id, tid, CAST(x + w / 2 AS DOUBLE) AS cx, CAST(y + h AS DOUBLE) AS bottom, CAST(unit AS DOUBLE) AS unit FROM t JOIN u USING (doc_id)")
def ground_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """GE-01 and GE-02."""
    return G.with_units(tokens(spark, sf)).select("doc_id", "tid", "cx", "bottom", "unit")


@query(f"{_T} SELECT doc_id, 1 AS page, tid, CAST(round(x / 800.0, 4) AS DOUBLE) AS x, CAST(round(y / 1000.0, 4) AS DOUBLE) AS y, CAST(round(w / 800.0, 4) AS DOUBLE) AS w, CAST(round(h / 1000.0, 4) AS DOUBLE) AS h FROM t")
def ground_relative(spark: SparkSession, sf: str) -> DataFrame:
    """LB-27 and IO-02's rescaling."""
    t = tokens(spark, sf)
    return G.relative(t, t.select("doc_id", "page").distinct().withColumns({"width": F.lit(800.0), "height": F.lit(1000.0)}))


@query(f"{_T}, {_VOC}, {_LAB} SELECT doc_id, tid, field, inline FROM lab")
def label_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """LB-01 and LB-03: known captions, and values that stand in the same token."""
    return labels(spark, sf).select("doc_id", "tid", "field", "inline")


@query(f"""{_T}, {_VOC}, k AS (SELECT DISTINCT {_KEY('text')} AS key FROM t WHERE NOT regexp_matches(text, '\\d') AND length({_KEY('text')}) BETWEEN 8 AND 45), n AS (SELECT key, min(field) AS field FROM k, voc WHERE key NOT IN (SELECT term FROM voc) AND levenshtein(key, term) = 1 GROUP BY 1 HAVING count(DISTINCT field) = 1)
SELECT doc_id, tid, text, field FROM t JOIN n ON {_KEY('text')} = key""")
def label_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """LB-04: one edit from one field's term."""
    voc = spark.createDataFrame(list(P.VOCABULARY.items()), "term string, field string")
    return G.fuzzy_labels(tokens(spark, sf), voc).select("doc_id", "tid", "text", "field")


@query(f"""{_T}, h AS (SELECT doc_id, h, page, y, tid, CASE text WHEN 'COMMERCIAL INVOICE' THEN 'commercial_invoice' WHEN 'PACKING LIST' THEN 'packing_list' WHEN 'BILL OF LADING' THEN 'bill_of_lading' END AS d FROM t),
b AS (SELECT doc_id, d, row_number() OVER (PARTITION BY doc_id ORDER BY h DESC, page, y, tid) AS n FROM h WHERE d IS NOT NULL) SELECT DISTINCT t.doc_id, coalesce(d, 'unknown') AS document_type FROM t LEFT JOIN b ON b.doc_id = t.doc_id AND n = 1""")
def label_document_type(spark: SparkSession, sf: str) -> DataFrame:
    """LB-05, LB-12 and GE-17."""
    return G.document_type(tokens(spark, sf), P.HEADINGS)


_NEAR = f"""{_T}, {_VOC}, {_LAB}, {_UNIT}, c AS (SELECT l.doc_id, l.tid AS lid, l.field, v.tid, v.text, abs(v.y + v.h / 2 - (l.y + l.h / 2)) AS dy, greatest(0, v.x - (l.x + l.w)) AS dx, v.x < l.x + l.w AND v.x + v.w > l.x AS ov, unit, v.x >= l.x + l.w AS rightward, v.y > l.y AS lower_
  FROM lab l JOIN t v ON v.doc_id = l.doc_id JOIN u ON u.doc_id = l.doc_id ANTI JOIN lab x ON x.doc_id = v.doc_id AND x.tid = v.tid),
near AS (SELECT *, CAST(round(dy / unit + dx / (unit * 10) + CASE WHEN (dy < unit * 0.8 AND rightward) OR ov THEN 0 ELSE 2 END, 4) AS DOUBLE) AS cost FROM c WHERE (dy < unit * 0.8 AND rightward) OR (lower_ AND dy <= unit * 4 AND (ov OR dx < unit * 6))),
mine AS (SELECT doc_id, tid, arg_min(lid, (cost, lid)) AS lid FROM near GROUP BY ALL), best AS (SELECT doc_id, lid, field, arg_min(near.tid, (cost, near.tid)) AS tid, arg_min(text, (cost, near.tid)) AS text, min(cost) AS cost FROM near JOIN mine USING (doc_id, tid, lid) GROUP BY ALL)"""
_NEAR = _NEAR.replace("FROM lab l JOIN t v ON v.doc_id = l.doc_id JOIN u ON u.doc_id = l.doc_id ANTI JOIN lab x ON x.doc_id = v.doc_id AND x.tid = v.tid", "FROM lab l JOIN t v ON v.doc_id = l.doc_id JOIN u ON u.doc_id = l.doc_id WHERE NOT EXISTS (SELECT 1 FROM lab x WHERE x.doc_id = v.doc_id AND x.tid = v.tid)")


@query(f"{_NEAR} SELECT doc_id, field, lid, tid, text, cost FROM best")
def ground_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """GE-05: the cheapest value of each label, each value for one label."""
    return G.nearest_values(tokens(spark, sf), labels(spark, sf)).select("doc_id", "field", "lid", "tid", "text", "cost")


_KINDS = {"total_amount": "number", "gross_weight": "number", "net_weight": "number", "quantity": "number"}
_CELLS = f"""{_NEAR}, n AS (SELECT best.*, least(a.confidence, b.confidence) AS ocr, regexp_extract_all(best.text, '(-?\\d[\\d.,]*\\d|\\d)') AS nums FROM best JOIN t a ON a.doc_id = best.doc_id AND a.tid = best.tid JOIN t b ON b.doc_id = best.doc_id AND b.tid = best.lid),
v AS (SELECT *, CASE WHEN field IN ('total_amount', 'gross_weight', 'net_weight', 'quantity') THEN CASE WHEN len(nums) = 1 THEN nums[1] END ELSE text END AS val, round(1 - cost / 10, 4) AS score FROM n),
i AS (SELECT *, array_to_string(list_filter([CASE WHEN score < 0.85 THEN 'low_mapping_score' END, CASE WHEN ocr < 0.7 THEN 'low_ocr_confidence' END, CASE WHEN val IS NULL THEN 'value_span_not_resolved' END], lambda z: z IS NOT NULL), ',') AS issues FROM v),
cells AS (SELECT doc_id, field, text AS raw_text, CASE WHEN issues = '' THEN val END AS value, CAST(ocr AS DOUBLE) AS ocr_confidence, CAST(score AS DOUBLE) AS mapping_score, issues, CASE WHEN issues = '' THEN 'accepted' ELSE 'review' END AS status FROM i)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    t = tokens(spark, sf)
    return G.fields(G.nearest_values(t, labels(spark, sf)), t, _KINDS)


@query(f"{_CELLS} SELECT * FROM cells")
def ground_fields(spark: SparkSession, sf: str) -> DataFrame:
    """GE-03, GE-15 and GE-16: raw text, least confidence, issues; a value only without issues."""
    return cells(spark, sf)


@query(f"{_CELLS} SELECT doc_id, bool_or(status = 'review') AS human_review_required FROM cells GROUP BY 1")
def ground_review_flag(spark: SparkSession, sf: str) -> DataFrame:
    """GE-28."""
    return G.needs_review(cells(spark, sf))


@query(f"{_CELLS}, g AS (SELECT doc_id, field, count(DISTINCT value) AS n, min(value) AS v FROM cells GROUP BY ALL) SELECT doc_id, field, CASE WHEN n = 1 THEN v END AS value, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 0 THEN 'missing' ELSE 'accepted' END AS status FROM g")
def ground_competing(spark: SparkSession, sf: str) -> DataFrame:
    """GE-22 and GE-23."""
    return G.competing(cells(spark, sf))


CATALOG = [(d, f) for d in ("commercial_invoice", "packing_list", "bill_of_lading") for f in ("invoice_number", "total_amount", "gross_weight", "vessel")]
_CAT = ", ".join(f"('{d}', '{f}')" for d, f in CATALOG)


@query(f"""{_CELLS}, g AS (SELECT doc_id, field, count(DISTINCT value) AS n, min(value) AS v FROM cells GROUP BY ALL), h AS (SELECT DISTINCT doc_id, CASE text WHEN 'COMMERCIAL INVOICE' THEN 'commercial_invoice' WHEN 'PACKING LIST' THEN 'packing_list' ELSE 'bill_of_lading' END AS document_type FROM t WHERE tid = 0 AND text <> 'NOTICE'), cat(document_type, field) AS (VALUES {_CAT})
SELECT h.doc_id, h.document_type, cat.field, CASE WHEN n = 1 THEN v END AS value, CASE WHEN n IS NULL OR n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'accepted' END AS status, CASE WHEN n IS NULL THEN 'not_proposed' END AS null_reason FROM h JOIN cat USING (document_type) LEFT JOIN g ON g.doc_id = h.doc_id AND g.field = cat.field""")
def ground_materialised(spark: SparkSession, sf: str) -> DataFrame:
    """GE-18: every applicable field is present, missing or not."""
    cat = spark.createDataFrame(CATALOG, "document_type string, field string")
    return G.materialised(G.competing(cells(spark, sf)), G.document_type(tokens(spark, sf), P.HEADINGS), cat)


@query(f"""{_T}, n AS (SELECT doc_id, tid, text FROM t WHERE tid BETWEEN 10 AND 15) SELECT doc_id, tid, text, CASE WHEN tid IN (10, 13) THEN 'description' WHEN tid IN (11, 14) THEN 'quantity' ELSE 'net_weight' END AS field FROM n""")
def ground_columns(spark: SparkSession, sf: str) -> DataFrame:
    """GE-11: nearest column by left edge."""
    t = tokens(spark, sf)
    return G.columns(t.where("tid < 16"), labels(spark, sf).where("tid BETWEEN 7 AND 9")).select("doc_id", "tid", "text", "field")


@query(f"""{_T} SELECT doc_id, CASE WHEN tid < 13 THEN 0 ELSE 1 END AS "row", CASE WHEN tid IN (10, 13) THEN 'description' WHEN tid IN (11, 14) THEN 'quantity' ELSE 'net_weight' END AS field, text FROM t WHERE tid BETWEEN 10 AND 15""")
def ground_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    """GE-12 and GE-13: header band, rows and cells of the item table."""
    return G.table_rows(tokens(spark, sf), P.VOCABULARY).select("doc_id", "row", "field", "text")


@query(f"""{_T}, {_VOC}, {_LAB} SELECT doc_id, tid, field, CASE WHEN tid BETWEEN 7 AND 9 AND inline = '' THEN 'item' ELSE 'header' END AS scope FROM lab""")
def label_scope(spark: SparkSession, sf: str) -> DataFrame:
    """LB-22 and LB-24: captions that share a band are item columns."""
    from pyspark.sql import Window

    lab = labels(spark, sf)
    n = F.size(F.collect_set("field").over(Window.partitionBy("doc_id", "page", "line")))
    band = lab.select("doc_id", "page", "tid", "field").join(G.bands(tokens(spark, sf)), ["doc_id", "page", "tid"]).withColumn("n_in_band", n).select("doc_id", "page", "tid", "n_in_band")
    return G.scope(lab, band).select("doc_id", "tid", "field", "scope")


SPANS = """
SELECT k AS doc_id, tid, cell, s, CASE WHEN k % 50 = 0 THEN 400 ELSE e END AS e FROM (SELECT o_orderkey AS k, tid, cell, s, e + CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 0 END AS e FROM {orders} CROSS JOIN (VALUES (2, 'invoice_number', 0, 3), (2, 'reference', 3, 5), (3, 'total_amount', 0, 5), (3, 'currency', 5, 7), (99, 'ghost', 0, 1)) AS v(tid, cell, s, e) WHERE NOT (tid = 99 AND o_orderkey % 3 <> 0)) AS x
"""


@query(f"WITH sp AS ({plain(SPANS)}) SELECT DISTINCT a.doc_id, a.tid, a.cell AS a, b.cell AS b FROM sp a JOIN sp b ON a.doc_id = b.doc_id AND a.tid = b.tid AND a.cell < b.cell AND greatest(a.s, b.s) < least(a.e, b.e)")
def ground_span_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """GE-20: interval overlap within a token."""
    return G.span_conflicts(view(spark, sf, SPANS, "orders"))


@query(f"""WITH sp AS ({plain(SPANS)}), t AS ({plain(P.TOKENS)}) SELECT DISTINCT sp.doc_id, cell, sp.tid, s, e, CASE WHEN t.tid IS NULL THEN 'unknown_token' ELSE 'span_out_of_bounds' END AS issue FROM sp LEFT JOIN t ON t.doc_id = sp.doc_id AND t.tid = sp.tid WHERE t.tid IS NULL OR e > length(text) OR s >= e""")
def ground_invalid_spans(spark: SparkSession, sf: str) -> DataFrame:
    """GE-14."""
    return G.invalid_spans(view(spark, sf, SPANS, "orders"), tokens(spark, sf))


@query(f"""{_T}, q AS (SELECT doc_id, substr(text, 1, 3) AS quote, 4 AS hint FROM t WHERE tid = 4), h AS (SELECT q.*, t.tid, (length(text) - length(replace(text, quote, ''))) // length(quote) AS n FROM q JOIN t USING (doc_id)),
g AS (SELECT doc_id, quote, hint, max(CASE WHEN tid = hint AND n = 1 THEN tid END) AS hinted, count(*) AS k, min(tid) AS o, max(n) AS m FROM h WHERE n > 0 GROUP BY ALL) SELECT doc_id, quote, hint, coalesce(hinted, CASE WHEN k = 1 AND m = 1 THEN o END) AS tid FROM q LEFT JOIN g USING (doc_id, quote, hint)""")
def label_quote_spans(spark: SparkSession, sf: str) -> DataFrame:
    """LB-16 and LB-17."""
    t = tokens(spark, sf)
    q = t.where("tid = 4").select("doc_id", F.substring("text", 1, 3).alias("quote"), F.lit(4).alias("hint"))
    return G.quote_spans(q, t)


@query(f"""{_T}, {_VOC}, {_LAB}, m AS (SELECT doc_id, tid, CASE WHEN tid = 8 THEN 'package_count' ELSE 'misc' END AS field FROM t WHERE tid IN (8, 16)) SELECT coalesce(lab.doc_id, m.doc_id) AS doc_id, coalesce(lab.tid, m.tid) AS tid, coalesce(lab.field, m.field) AS field, CASE WHEN lab.field IS NULL THEN 'model' WHEN m.field IS NULL OR m.field = lab.field THEN 'vocabulary' ELSE 'vocabulary_veto' END AS origin FROM lab FULL OUTER JOIN m ON m.doc_id = lab.doc_id AND m.tid = lab.tid""")
def label_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """LB-18 and LB-25: the vocabulary's meaning over a model's; model labels arrive as data."""
    model = tokens(spark, sf).where("tid IN (8, 16)").withColumn("field", F.when(F.col("tid") == 8, "package_count").otherwise("misc"))
    return G.overlay(labels(spark, sf), model).select("doc_id", "tid", "field", "origin")


@query(f"{_T} SELECT doc_id, 'issue_date' AS field, text FROM t WHERE tid = 16 AND doc_id IN (SELECT doc_id FROM t WHERE tid = 0 AND text <> 'NOTICE')")
def label_title_date(spark: SparkSession, sf: str) -> DataFrame:
    """LB-19."""
    t = tokens(spark, sf)
    return G.date_beside_title(t, G.headings(t, P.HEADINGS), labels(spark, sf))


@query(f"{_T}, n AS (SELECT doc_id, CAST(sum(strlen(text)) AS BIGINT) * 40 AS need FROM t GROUP BY 1) SELECT doc_id, need, CASE WHEN need + 1024 <= 8192 THEN 8192 WHEN need + 1024 <= 16384 THEN 16384 END AS context FROM n")
def label_context_size(spark: SparkSession, sf: str) -> DataFrame:
    """LB-28 and LB-29: too long is null, never cut."""
    n = tokens(spark, sf).groupBy("doc_id").agg((F.sum(F.octet_length("text")) * 40).alias("need"))
    return n.withColumn("context", G.context_size(F.col("need")))


@query(f"""{_T}, s AS (SELECT doc_id, tid, CASE WHEN tid = 0 THEN '' ELSE upper(text) END AS t2, CASE WHEN tid % 2 = 0 THEN confidence + 0.2 ELSE confidence + 0.01 END AS c2 FROM t) SELECT doc_id, tid, CASE WHEN confidence < 0.95 AND trim(t2) <> '' AND c2 >= confidence + 0.05 THEN t2 ELSE text END AS text, confidence < 0.95 AND trim(t2) <> '' AND c2 >= confidence + 0.05 AS reread FROM t JOIN s USING (doc_id, tid)""")
def ground_reread(spark: SparkSession, sf: str) -> DataFrame:
    """IO-03."""
    t = tokens(spark, sf)
    again = t.withColumns({"text": F.when(F.col("tid") == 0, "").otherwise(F.upper("text")), "confidence": F.when(F.col("tid") % 2 == 0, F.col("confidence") + 0.2).otherwise(F.col("confidence") + 0.01)})
    return G.reread_choice(t, again).select("doc_id", "tid", "text", "reread")


@query(f"""{_T} SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 3 THEN 'document_type' WHEN o_orderkey % 10 = 0 THEN 'schema_version' ELSE 'cell' END AS reason FROM orders WHERE o_orderkey % 4 = 3 OR o_orderkey % 10 = 0 OR o_orderkey % 15 = 0""")
def source_contract(spark: SparkSession, sf: str) -> DataFrame:
    """GE-29 and IO-06: documents that break the contract go to a failure table."""
    from .base import table

    cell = F.struct(F.lit("1").alias("value"), F.when(F.col("o_orderkey") % 15 == 0, F.lit(None).cast("string")).otherwise("accepted").alias("status"))
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'commercial_invoice' WHEN 1 THEN 'packing_list' WHEN 2 THEN 'bill_of_lading' ELSE 'letter' END").alias("document_type"), F.when(F.col("o_orderkey") % 10 == 0, "1.0").otherwise("2.0").alias("schema_version"), F.create_map(F.lit("total_amount"), cell).alias("fields"))
    return G.contract_failures(d).select("doc_id", "reason")


@query(f"{_T} SELECT DISTINCT doc_id, 'duplicate_token' AS issue FROM t WHERE doc_id % 13 = 0 UNION SELECT DISTINCT doc_id, 'unknown_page' FROM t WHERE doc_id % 17 = 0")
def source_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """IO-04: unique ids, and a page for every token."""
    t = tokens(spark, sf)
    twice = t.unionByName(t.where("doc_id % 13 = 0 AND tid = 1"))
    return G.integrity_issues(twice, t.where("doc_id % 17 <> 0").select("doc_id", "page").distinct())
