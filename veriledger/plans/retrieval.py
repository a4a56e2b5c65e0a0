"""Retrieval queries: documents are passages, benchmark items and every fiftieth vector are queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieve as T
from .base import ORACLES, Query, plain, query, table, view

#: Paragraph texts made from orders, one document a customer: numbered lines, some repeated, some empty, some with none.
STANDARDS = """
SELECT o_custkey AS doc_id, CASE WHEN o_custkey % 7 = 0 THEN 'Scope' || chr(10) || 'no numbers here' WHEN o_custkey % 5 = 0 THEN 'Scope' || chr(10) || '1  first' || chr(10) || '1  again'
  WHEN o_custkey % 11 = 0 THEN '1  first' || chr(10) || '2' WHEN o_custkey % 3 = 0 THEN 'Title' || chr(10) || 'Scope' || chr(10) || '1  ' || repeat('Cost of goods. ', 200) || chr(10) || 'tail' || chr(10) || 'B2A  Revenue of ' || CAST(o_custkey AS STRING)
  ELSE 'Scope' || chr(10) || '10  Rule ' || CAST(n AS STRING) || chr(10) || 'more text' || chr(10) || 'Related questions' || chr(10) || '- link' || chr(10) || '11' || chr(10) || 'body of eleven (2024-01-31)' END AS text
FROM (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) AS o
"""
_SPLIT = f"""WITH d AS ({plain(STANDARDS)}), l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1000)[1:len(string_split(text, chr(10)))]) AS n FROM d), l AS (SELECT doc_id, n, trim(line) AS line FROM l0 WHERE trim(line) <> ''),
o AS (SELECT *, nullif(regexp_extract(line, '^([A-Z]{{0,2}}\\d{{1,3}}[A-Z]?)(\\s{{2,}}(\\S.*))?$', 1), '') AS number, regexp_extract(line, '^([A-Z]{{0,2}}\\d{{1,3}}[A-Z]?)(\\s{{2,}}(\\S.*))?$', 3) AS rest FROM l),
k AS (SELECT *, sum(CASE WHEN number IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM o),
p AS (SELECT doc_id, k, max(number) AS paragraph, trim(string_agg(CASE WHEN number IS NOT NULL THEN rest ELSE line END, chr(10) ORDER BY n), ' ' || chr(10)) AS body FROM k WHERE k > 0 GROUP BY ALL),
f AS (SELECT d.doc_id, CASE WHEN count(p.k) = 0 THEN 'no_unambiguous_numbered_paragraphs' WHEN count(p.k) > count(DISTINCT p.paragraph) THEN 'ambiguous_duplicate_paragraph' WHEN bool_or(p.body = '') THEN 'empty_paragraph' END AS reason FROM d LEFT JOIN p USING (doc_id) GROUP BY 1),
s AS (SELECT doc_id, max_by(line, n) AS section FROM k WHERE k = 0 AND length(line) < 60 GROUP BY 1),
c AS (SELECT p.doc_id, paragraph, coalesce(section, '') AS section, unnest(range(0, (length(body) - 1) // 1800 + 1)) AS chunk_index, body FROM p JOIN f ON f.doc_id = p.doc_id AND f.reason IS NULL LEFT JOIN s ON s.doc_id = p.doc_id),
chunks AS (SELECT doc_id, paragraph, section, chunk_index, substr(body, chunk_index * 1800 + 1, 1800) AS content FROM c)"""


def standards(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, STANDARDS, "orders")


@query(f"{_SPLIT} SELECT * FROM chunks")
def retrieve_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """RT-02."""
    return T.split_paragraphs(standards(spark, sf))[0]


@query(f"{_SPLIT} SELECT doc_id, reason FROM f WHERE reason IS NOT NULL")
def retrieve_split_failures(spark: SparkSession, sf: str) -> DataFrame:
    """RT-02, failed closed."""
    return T.split_paragraphs(standards(spark, sf))[1]


@query(f"{_SPLIT} SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT (doc_id, paragraph)) AS paragraphs, count(*) AS chunks FROM chunks")
def retrieve_store_counts(spark: SparkSession, sf: str) -> DataFrame:
    """RT-04."""
    c = T.split_paragraphs(standards(spark, sf))[0]
    return c.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("doc_id", "paragraph").alias("paragraphs"), F.count("*").alias("chunks"))


QUESTIONS = "SELECT o_orderkey AS qid, CASE o_orderkey % 4 WHEN 0 THEN 'what does ' || CAST(1000 + o_orderkey % 20 AS STRING) || ' paragraph 10 say' WHEN 1 THEN 'see 1115 para. b2a' WHEN 2 THEN 'order 123456 of 10' ELSE 'no reference' END AS question FROM {orders}"


@query(f"""WITH q AS ({plain(QUESTIONS)}), r AS (SELECT qid, regexp_extract(question, '(?i)(^|[^\\d])([12]\\d{{3}})(\\s+paragraph\\s+|\\s+para\\.?\\s+|\\s+)([A-Z]{{0,2}}\\d{{1,3}}[A-Z]?)($|[^\\d])', 2) AS n, upper(regexp_extract(question, '(?i)(^|[^\\d])([12]\\d{{3}})(\\s+paragraph\\s+|\\s+para\\.?\\s+|\\s+)([A-Z]{{0,2}}\\d{{1,3}}[A-Z]?)($|[^\\d])', 4)) AS p FROM q)
SELECT qid, nullif(n, '') AS number, nullif(p, '') AS paragraph FROM r""")
def retrieve_exact_reference(spark: SparkSession, sf: str) -> DataFrame:
    """RT-01."""
    number, paragraph = T.exact_reference(F.col("question"))
    return view(spark, sf, QUESTIONS, "orders").select("qid", number.alias("number"), paragraph.alias("paragraph"))


@query(_SPLIT.replace("WITH d AS", f"WITH q AS ({plain(QUESTIONS)}), r AS (SELECT qid, CAST(regexp_extract(question, '(1\\d{{3}}) paragraph (\\d+)', 1) AS INT) - 1000 AS doc_id, regexp_extract(question, '(1\\d{{3}}) paragraph (\\d+)', 2) AS paragraph FROM q WHERE qid % 4 = 0), d AS") + " SELECT qid, c.doc_id, paragraph, chunk_index, content FROM r JOIN chunks c USING (doc_id, paragraph)")
def retrieve_exact_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """RT-03: number and paragraph named in the question, equality alone."""
    asked = retrieve_exact_reference(spark, sf).where("qid % 4 = 0").select("qid", (F.col("number").cast("long") - 1000).alias("doc_id"), "paragraph")
    return asked.join(T.split_paragraphs(standards(spark, sf))[0], ["doc_id", "paragraph"]).select("qid", "doc_id", "paragraph", "chunk_index", "content")


@query(f"""WITH d AS ({plain(STANDARDS)}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1000)[1:len(string_split(text, chr(10)))]) AS n FROM d),
s AS (SELECT *, starts_with(trim(line), 'Related') AS h, trim(line) = '' OR regexp_matches(trim(line), '^[-–]') AS it FROM l), w AS (SELECT *, coalesce(last_value(CASE WHEN h THEN TRUE WHEN NOT it THEN FALSE END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n), FALSE) AS linked FROM s)
SELECT doc_id, trim(string_agg(line, chr(10) ORDER BY n), ' ') AS body FROM w WHERE NOT h AND NOT (linked AND it) AND NOT regexp_matches(line, '\\(\\d{{4}}-\\d\\d-\\d\\d\\)\\s*$') GROUP BY 1""")
def retrieve_clean_body(spark: SparkSession, sf: str) -> DataFrame:
    """RT-25."""
    return T.clean_body(standards(spark, sf))


# ---- scores -------------------------------------------------------------------------------

_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_BM = f"""p AS (SELECT doc_id AS id, {_TOK} AS t FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM p), q AS (SELECT item_id AS qid, unnest({_TOK}) AS term FROM benchmark WHERE item_id % 5 = 0), qt AS (SELECT qid, term, count(*) AS qtf FROM q GROUP BY ALL),
po AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM p) WHERE term IN (SELECT term FROM qt) GROUP BY ALL), i AS (SELECT term, ln((n + 1) / (count(*) + 0.5)) AS idf, avgdl FROM po, st GROUP BY term, n, avgdl),
co AS (SELECT qid, sum(round(qtf * idf * 2.5 * 0.5 / 2.0, 10)) AS c FROM qt JOIN i USING (term) GROUP BY 1),
bm AS (SELECT qid, id, round(sum(round(qtf * (idf * 2.5 * (x + 0.5) / (1.5 + x + 0.5) - idf * 2.5 * 0.5 / 2.0), 10)) + c, 6) AS score FROM (SELECT *, tf / (1 - 0.75 + 0.75 * dl / avgdl) AS x FROM qt JOIN i USING (term) JOIN po USING (term)) JOIN co USING (qid) GROUP BY qid, id, c)"""
_DENSE = """qv AS (SELECT vec_id / 50 * 5 AS qid, embedding AS qvec FROM embeddings WHERE vec_id % 50 = 0), de AS (SELECT CAST(qid AS BIGINT) AS qid, vec_id AS id, round(list_sum(list_transform(list_zip(embedding, qvec), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS score FROM embeddings, qv)"""
_RANKED = lambda t, k: f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {t} QUALIFY rank <= {k})"


def lexical(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """BM25L scores of every fifth benchmark row, as the twins' filter has it, or of every one."""
    items = table(spark, sf, "benchmark")
    passages = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    return T.bm25l(passages, (items if whole else items.where("item_id % 5 = 0")).select(F.col("item_id").alias("qid"), "text"))


def dense(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return T.dense_scores(v, v.where("id % 50 = 0").select((F.col("id") / 50 * 5).cast("long").alias("qid"), "vector"))


@query(f"WITH {_BM} SELECT qid, id, score FROM bm")
def retrieve_bm25l(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """RT-08: scores of every passage that holds a term of the query."""
    return lexical(spark, sf, whole)


@query(f"WITH {_DENSE} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM {_RANKED('de', 30)}")
def retrieve_dense_top(spark: SparkSession, sf: str) -> DataFrame:
    """RT-09: a top-k report."""
    return T.top(dense(spark, sf), 30)


@query(f"""WITH {_BM}, {_DENSE}, u AS (SELECT qid, id, 1.0 / (60 + rank) AS s FROM {_RANKED('bm', 30)} UNION ALL SELECT qid, id, 1.0 / (60 + rank) FROM {_RANKED('de', 30)}), r AS (SELECT qid, id, round(sum(CAST(s AS DOUBLE)), 8) AS score FROM u GROUP BY ALL)
SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM {_RANKED('r', 30)}""")
def retrieve_rrf(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """RT-10: a top-k report."""
    return T.rrf(lexical(spark, sf, whole), dense(spark, sf), k=30)


@query(f"""WITH {_BM}, c AS (SELECT qid, id FROM {_RANKED('bm', 30)}), x AS (SELECT c.qid, c.id, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS w, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS bt, regexp_extract_all(lower(split_part(d.text, chr(10), 1)), '[a-z0-9]+') AS tt FROM c JOIN benchmark b ON b.item_id = c.qid JOIN documents d ON d.doc_id = c.id),
s AS (SELECT qid, id, len(list_intersect(w, bt)) / greatest(len(w), 1) AS b, len(list_intersect(w, tt)) / greatest(len(w), 1) AS t FROM x), r AS (SELECT qid, id, round(b * 0.6 + t * 0.3, 6) AS score FROM s WHERE b > 0 OR t > 0) SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM {_RANKED('r', 4)}""")
def retrieve_rerank(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """RT-11: a top-k report."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.element_at(F.split("text", "\n"), 1).alias("title"))
    cand = T.top(lexical(spark, sf, whole), 30).select("qid", "id").join(docs, "id").join(F.broadcast(table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))), "qid")
    return T.rerank(cand.withColumn("cosine", F.lit(None).cast("double")), 4)


@query("SELECT doc_id, source, lang FROM documents WHERE lang = 'en' AND contains(lower(source), 'src1')")
def retrieve_metadata_filter(spark: SparkSession, sf: str) -> DataFrame:
    """RT-06: both predicates reach the scan."""
    return T.metadata_filter(table(spark, sf, "documents"), {"lang": "en"}, {"source": "src1"}).select("doc_id", "source", "lang")


@query("""WITH r AS (SELECT source, doc_id, length(text) AS size, row_number() OVER (PARTITION BY source ORDER BY length(text) % 7 DESC, length(text), doc_id) AS o FROM documents WHERE text IS NOT NULL),
g AS (SELECT source, list({'id': doc_id, 'size': size} ORDER BY o) AS xs FROM r GROUP BY 1),
f AS (SELECT source, list_reduce(list_prepend({'ids': CAST([] AS BIGINT[]), 'size': CAST(0 AS BIGINT)}, list_transform(xs, lambda x: {'ids': [x.id], 'size': x.size})), lambda a, x: CASE WHEN x.size <= 5000 AND a.size + x.size <= 6500 AND len(a.ids) < 3 THEN {'ids': list_concat(a.ids, x.ids), 'size': a.size + x.size} ELSE a END) AS a FROM g)
SELECT source, CAST(i - 1 AS INTEGER) AS place, a.ids[i] AS id FROM (SELECT source, a, unnest(range(1, len(a.ids) + 1)) AS i FROM f)""")
def retrieve_greedy_budget(spark: SparkSession, sf: str) -> DataFrame:
    """RT-15 and RT-17: skip what does not fit and go on."""
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select("source", F.col("doc_id").alias("id"), "text")
    return T.greedy_budget(rows, "source", [-(F.length("text") % 7), F.length("text"), F.col("id")], "text")


@query(f"""WITH {_BM}, h AS (SELECT qid // 10 AS question, qid % 10 // 5 AS query_no, id, rank FROM {_RANKED('bm', 30)}), b AS (SELECT question, id, min(rank) AS rank FROM h WHERE query_no < 4 AND rank <= 10 GROUP BY ALL),
k AS (SELECT question, sha256(regexp_replace(text, '[\\s\\x0B]+', '', 'g')) AS h, id, rank FROM b JOIN documents ON doc_id = id), m AS (SELECT *, row_number() OVER (PARTITION BY question, h ORDER BY rank, id) AS n FROM k) SELECT question, id, CAST(rank AS INTEGER) AS rank FROM m WHERE n = 1""")
def retrieve_multi_query(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """RT-17 and RT-18: several queries of a question, best rank, one of equal texts."""
    question, query_no = ("qid div 4", "qid % 4") if whole else ("qid div 10", "(qid % 10) div 5")
    hits = T.top(lexical(spark, sf, whole), 30).select(F.expr(question).alias("question"), F.expr(query_no).alias("query_no"), "id", "rank")
    return T.multi_query(hits, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(f"""WITH {_BM}, c AS (SELECT qid, id, d.text, b.text AS q FROM {_RANKED('bm', 30)} r JOIN documents d ON d.doc_id = r.id JOIN benchmark b ON b.item_id = r.qid WHERE length(d.text) BETWEEN 35 AND 1200 AND regexp_matches(trim(d.text), '[.!?]$')),
s AS (SELECT qid, text, min(id) AS id, max(len(list_intersect(list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+')), regexp_extract_all(lower(text), '[a-z0-9]+')))) AS score FROM c GROUP BY ALL) SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM {_RANKED('s', 2)}""")
def retrieve_excerpts(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """RT-22: a top-k report."""
    cand = T.top(lexical(spark, sf, whole), 30).select("qid", "id").join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return T.excerpts(cand.join(F.broadcast(table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))), "qid"))


VERDICTS = """
SELECT o_custkey % 50 AS qid, o_orderkey % 40 AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'direct' WHEN o_orderkey % 3 = 1 THEN 'conditional' ELSE 'direct' END AS relation, o_orderkey % 5 <> 0 AS answers, o_orderkey % 7 AS k FROM {orders} WHERE o_orderkey < 200
"""


@query(f"""WITH v0 AS ({plain(VERDICTS)}), v AS (SELECT v0.*, CASE WHEN k = 1 THEN 'short' WHEN k = 2 THEN 'this is not a quote of it' ELSE substr(b.text, 5, 20) END AS quote, CASE WHEN k = 3 THEN 1 ELSE 0 END AS n_missing, CASE WHEN k = 4 THEN 'f9' ELSE 'f1' END AS fact, b.text FROM v0 JOIN benchmark b ON b.item_id = v0.id)
SELECT qid, id, relation = 'direct' AND answers AND n_missing = 0 AND length(trim(quote)) >= 12 AND contains(text, quote) AND fact = 'f1' AS accepted FROM v WHERE qid NOT IN (SELECT qid FROM v GROUP BY qid, id HAVING count(*) > 1)""")
def retrieve_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """RT-21: verdicts arrive as data."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    v = view(spark, sf, VERDICTS, "orders").join(b, "id")
    v = v.select("qid", "id", "relation", "answers", F.when(F.col("k") == 3, 1).otherwise(0).alias("n_missing"), F.when(F.col("k") == 1, "short").when(F.col("k") == 2, "this is not a quote of it").otherwise(F.substring("text", 5, 20)).alias("quote"), F.array(F.when(F.col("k") == 4, "f9").otherwise("f1")).alias("fact_ids"))
    return T.accepted_verdicts(v, b, v.select("qid").distinct().withColumn("fact_id", F.lit("f1")))


_SUBJECT = "CASE WHEN contains(lower(text), 'that') THEN 'that' WHEN contains(lower(text), 'der ') THEN 'der' END"


@query(f"""WITH t AS (SELECT conv_id, turn, {_SUBJECT} AS subject FROM conversations) SELECT conv_id, turn, subject, coalesce(subject, last_value(subject IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) AS carried FROM t""")
def retrieve_follow_up(spark: SparkSession, sf: str) -> DataFrame:
    """RT-19."""
    return T.follow_up_subject(table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_SUBJECT).alias("subject")), "subject")


INCOMING = "SELECT o_custkey AS id, CAST(max(o_orderkey) AS STRING) AS content_hash, CAST(count(*) AS STRING) AS version FROM {orders} GROUP BY o_custkey"
STORED = "SELECT o_custkey AS id, CAST(max(o_orderkey) AS STRING) AS content_hash, CAST(count(*) AS STRING) AS version FROM {orders} WHERE o_orderkey % 11 <> 0 AND o_custkey % 4 <> 0 GROUP BY o_custkey"


@query(f"""WITH i AS ({plain(INCOMING)}), s AS ({plain(STORED)}) SELECT i.id, CASE WHEN s.id IS NULL THEN 'index' WHEN i.content_hash = s.content_hash AND i.version = s.version THEN 'skip' ELSE 'replace' END AS action FROM i LEFT JOIN s USING (id)""")
def source_incremental_sync(spark: SparkSession, sf: str) -> DataFrame:
    """IO-16."""
    return T.sync_plan(view(spark, sf, INCOMING, "orders"), view(spark, sf, STORED, "orders")).select("id", "action")


#: Documents with a paragraph a sentence.
_PARENTS = "SELECT doc_id, replace(replace(text, '. ', '.' || chr(10) || chr(10)), ', ', chr(10)) AS text FROM documents WHERE text IS NOT NULL"


@query(f"""WITH d AS ({_PARENTS}), h AS (SELECT doc_id AS hit_id, doc_id, length(text) // 2 AS s, length(substr(text, length(text) // 2 + 1, 80)) AS w, length(text) AS n, text FROM d WHERE doc_id % 3 = 0),
paras AS (SELECT doc_id, 0 AS bound FROM h UNION ALL SELECT doc_id, i + 1 FROM (SELECT doc_id, text, unnest(range(1, length(text))) AS i FROM h WHERE n > 2000) WHERE substr(text, i, 2) = chr(10) || chr(10)),
b AS (SELECT h.*, (SELECT max(bound) FROM paras p WHERE p.doc_id = h.doc_id AND bound <= greatest(s - 1200, 0)) AS l, (SELECT min(bound) - 2 FROM paras p WHERE p.doc_id = h.doc_id AND bound - 2 >= least(n, s + w + 1600)) AS r,
  (SELECT max(bound) FROM paras p WHERE p.doc_id = h.doc_id AND bound <= s) AS tl, (SELECT min(bound) - 2 FROM paras p WHERE p.doc_id = h.doc_id AND bound - 2 >= s + w) AS tr FROM h),
c AS (SELECT *, coalesce(r, n) - coalesce(l, 0) > 4000 AS tight FROM b)
SELECT hit_id, doc_id, sha256(CASE WHEN n <= 2000 THEN text WHEN tight THEN substr(text, coalesce(tl, 0) + 1, coalesce(tr, n) - coalesce(tl, 0)) ELSE substr(text, coalesce(l, 0) + 1, coalesce(r, n) - coalesce(l, 0)) END) AS context FROM c""")
def retrieve_parent_window(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """RT-14: the slice is verified before its surroundings are given, in whole paragraphs. The bounds are smaller than the operator's own, so that documents of this size pass them."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.replace(F.replace("text", F.lit(". "), F.lit(".\n\n")), F.lit(", "), F.lit("\n")).alias("text"))
    half = F.expr("length(text) div 2")
    hits = (d if whole else d.where("doc_id % 3 = 0")).select(F.col("doc_id").alias("hit_id"), "doc_id", half.cast("int").alias("start"), F.substr("text", (half + 1).cast("int"), F.lit(80)).alias("slice"))
    return T.parent_window(hits, d, whole=2000, cap=4000).withColumn("context", F.sha2("context", 256))


@query(f"""WITH {_BM}, r AS (SELECT * FROM {_RANKED('bm', 30)}) SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE d.source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END, score DESC, id) AS INTEGER) AS place FROM r JOIN documents d ON d.doc_id = r.id""")
def retrieve_authority(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """RT-12: after relevance, source type and then score."""
    from pyspark.sql import Window

    rows = T.top(lexical(spark, sf, whole), 30).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    kind = T.authority_order(F.when(F.col("source") == "src0", "standard").when(F.col("source") == "src1", "qna").otherwise("case"))
    return rows.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy(kind, F.desc("score"), "id")).alias("place"))


# ---- every benchmark row and every document -------------------------------------------------


def _over_every_row(f: Query, *filters: tuple[str, str]) -> None:
    """Register ``f`` without its row filter as ``f``_all; the twin is that of ``f`` without the filter."""
    sql = ORACLES[f.__name__]
    for old, new in filters:
        if old not in sql:
            raise ValueError(f"{f.__name__}: no {old!r} in its twin")
        sql = sql.replace(old, new)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return f(spark, sf, whole=True)

    run.__name__, run.__doc__ = f"{f.__name__}_all", f.__doc__
    query(sql)(run)


_ITEMS = (" WHERE item_id % 5 = 0", "")
for _f in (retrieve_bm25l, retrieve_rrf, retrieve_rerank, retrieve_excerpts, retrieve_authority):
    _over_every_row(_f, _ITEMS)
#: Four queries a question, the most that multi_query takes, so no item is left out.
_over_every_row(retrieve_multi_query, _ITEMS, ("qid // 10 AS question, qid % 10 // 5 AS query_no", "qid // 4 AS question, qid % 4 AS query_no"))
_over_every_row(retrieve_parent_window, (" WHERE doc_id % 3 = 0", ""))
