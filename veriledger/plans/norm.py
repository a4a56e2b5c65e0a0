"""Normalisation queries: raw strings made from keys by modulus, so that every outcome occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise as N
from .base import plain, query, view

NUMBERS = """
SELECT k, CASE k % 12 WHEN 0 THEN a || ',' || b || '.' || m WHEN 1 THEN a || '.' || b || ',' || m WHEN 2 THEN a || ' ' || b || ',' || m WHEN 3 THEN '(' || m || '.' || m || ')'
  WHEN 4 THEN m || ',' || b WHEN 5 THEN '$' || a || '.' || m WHEN 6 THEN m || ',' || m || '.00' WHEN 7 THEN 'abc' || m WHEN 8 THEN a || ',' || b || ',' || a WHEN 9 THEN '+' || a WHEN 10 THEN '  ' ELSE a || ' ' || m END AS raw
FROM (SELECT o_orderkey AS k, CAST(100 + o_orderkey % 900 AS STRING) AS a, CAST(100 + o_orderkey % 700 AS STRING) AS b, CAST(10 + o_orderkey % 90 AS STRING) AS m FROM {orders}) AS x
"""
#: d: day, m: month, y: year as text.
DATES = """
SELECT k, CASE k % 12 WHEN 0 THEN y || '-' || m || '-' || d WHEN 1 THEN d || ' Mar ' || y WHEN 2 THEN 'March ' || d || ', ' || y WHEN 3 THEN d || '/' || m || '/' || y WHEN 4 THEN y || '.' || m || '.' || d
  WHEN 5 THEN '2nd May ' || y WHEN 6 THEN '3th May ' || y WHEN 7 THEN y || '-02-31' WHEN 8 THEN 'Apr.' || d || '.' || y WHEN 9 THEN d || '-Jun-' || y WHEN 10 THEN 'May ' || d || ',' || y ELSE 'soon' END AS raw
FROM (SELECT o_orderkey AS k, lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0') AS d, lpad(CAST(1 + o_orderkey % 12 AS STRING), 2, '0') AS m, CAST(1990 + o_orderkey % 40 AS STRING) AS y FROM {orders}) AS x
"""
WORDS = """
SELECT k, element AS raw FROM (SELECT o_orderkey AS k, CASE o_orderkey % 16 WHEN 0 THEN 'KGS' WHEN 1 THEN 'Cartons' WHEN 2 THEN 'bundle' WHEN 3 THEN 'FOB Busan' WHEN 4 THEN 'cif rotterdam' WHEN 5 THEN 'Freight Prepaid'
  WHEN 6 THEN 'collect' WHEN 7 THEN '---' WHEN 8 THEN '304' WHEN 9 THEN 'US$' WHEN 10 THEN '$' WHEN 11 THEN '(eur)' WHEN 12 THEN 'KRW' WHEN 13 THEN 'XQX' WHEN 14 THEN 'The Netherlands' ELSE 'Busan,  Germany' END AS element FROM {orders}) AS x
"""

_CLEAN = "trim(regexp_replace(raw, '\\s+', ' ', 'g'))"


def _pair(col) -> list:
    return [col["value"].alias("value"), col["issue"].alias("issue")]


@query(f"""
WITH r AS ({plain(NUMBERS)}), s AS (SELECT k, raw, regexp_replace({_CLEAN}, '^\\$\\s*', '') AS b FROM r),
t AS (SELECT *, regexp_matches(b, '^\\(.*\\)$') AS neg, replace(regexp_replace(b, '^\\(|\\)$', '', 'g'), ' ', '') AS n, regexp_replace(b, '^\\(|\\)$', '', 'g') AS body FROM s),
u AS (SELECT *, len(n) - len(replace(n, ',', '')) AS c, len(n) - len(replace(n, '.', '')) AS d FROM t),
v AS (SELECT *, CASE WHEN c > 0 AND d > 0 THEN CASE WHEN strpos(reverse(n), ',') < strpos(reverse(n), '.') THEN ',' ELSE '.' END WHEN c + d = 1 THEN CASE WHEN c = 1 THEN ',' ELSE '.' END WHEN c > 1 THEN '.' WHEN d > 1 THEN ',' ELSE '.' END AS mark FROM u),
w AS (SELECT *, split_part(n, mark, 1) AS whole, CASE WHEN contains(n, mark) THEN split_part(n, mark, 2) END AS frac FROM v),
x AS (SELECT k, raw, CASE WHEN {_CLEAN} = '' THEN 'empty_value' WHEN NOT regexp_matches(body, '^[+-]?[0-9][0-9., ]*$') THEN 'invalid_number_span' WHEN contains(body, ' ') AND NOT regexp_matches(body, '^[+-]?\\d{{1,3}}( \\d{{3}})+([.,]\\d+)?$') THEN 'invalid_grouping'
  WHEN c + d = 1 AND regexp_matches(n, '[.,]\\d{{3}}$') THEN 'ambiguous_number_separator' WHEN regexp_matches(whole, '[.,]') AND NOT regexp_matches(whole, '^[+-]?\\d{{1,3}}([.,]\\d{{3}})+$') THEN 'invalid_grouping' END AS issue,
  CASE WHEN neg THEN '-' ELSE '' END || replace(regexp_replace(whole, '[.,]', '', 'g'), '+', '') || coalesce('.' || frac, '') AS value FROM w)
SELECT k, raw, CASE WHEN issue IS NULL THEN value END AS value, issue FROM x
""")
def norm_number(spark: SparkSession, sf: str) -> DataFrame:
    """NM-12 to NM-15."""
    return view(spark, sf, NUMBERS, "orders").select("k", "raw", *_pair(N.normalise(F.col("raw"), "number", spark)))


_PARSED = """coalesce(CASE WHEN regexp_matches(p, '^\\d{4}-\\d\\d-\\d\\d$') THEN try_strptime(p, '%Y-%m-%d') END, CASE WHEN regexp_matches(p, '^\\d{4}\\.\\d\\d\\.\\d\\d$') THEN try_strptime(p, '%Y.%m.%d') END,
  try_strptime(p, '%d %b %Y'), try_strptime(p, '%B %d, %Y'), try_strptime(p, '%b.%d.%Y'), try_strptime(p, '%d-%b-%Y'))"""


def _date_sql(extra: str) -> str:
    return f"""
WITH r AS ({plain(DATES)}), s AS (SELECT k, raw, regexp_extract(raw, '^(\\d+)(st|nd|rd|th) ', 1) AS od, regexp_extract(raw, '^(\\d+)(st|nd|rd|th) ', 2) AS os, regexp_replace(regexp_replace(raw, '^(\\d+)(st|nd|rd|th) ', '\\1 '), ',(\\d{{4}})', ', \\1') AS p FROM r),
t AS (SELECT *, try_strptime(p, '%d/%m/%Y') AS dmy, try_strptime(p, '%m/%d/%Y') AS mdy, {_PARSED} AS fixed FROM s),
u AS (SELECT k, raw, os <> '' AND os <> CASE WHEN CAST(od AS INT) % 10 = 2 THEN 'nd' WHEN CAST(od AS INT) % 10 = 3 THEN 'rd' ELSE 'th' END AS bad, coalesce(fixed, {extra}) AS d FROM t)
SELECT k, raw, CASE WHEN NOT coalesce(bad, FALSE) THEN strftime(d, '%Y-%m-%d') END AS value, CASE WHEN bad THEN 'invalid_day_ordinal' WHEN d IS NULL THEN 'ambiguous_or_invalid_date' END AS issue FROM u"""


@query(_date_sql("CASE WHEN dmy IS NULL THEN mdy WHEN mdy IS NULL THEN dmy WHEN dmy = mdy THEN dmy END").replace("CAST(od AS INT)", "TRY_CAST(od AS INT)"))
def norm_date(spark: SparkSession, sf: str) -> DataFrame:
    """NM-09 to NM-11, without a configured order."""
    return view(spark, sf, DATES, "orders").select("k", "raw", *_pair(N.normalise(F.col("raw"), "date", spark)))


@query(_date_sql("dmy").replace("CAST(od AS INT)", "TRY_CAST(od AS INT)"))
def norm_date_dmy(spark: SparkSession, sf: str) -> DataFrame:
    """NM-09 with day before month."""
    return view(spark, sf, DATES, "orders").select("k", "raw", *_pair(N.normalise(F.col("raw"), "date", spark, order="DMY")))


def _word(name: str, kind: str, value: str, issue: str, doc: str) -> None:
    sql = f"WITH r AS ({plain(WORDS)}), s AS (SELECT k, raw, {_CLEAN} AS c FROM r), t AS (SELECT k, raw, {value} AS value FROM s) SELECT k, raw, value, CASE WHEN value IS NULL THEN '{issue}' END AS issue FROM t"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return view(spark, sf, WORDS, "orders").select("k", "raw", *_pair(N.normalise(F.col("raw"), kind, spark)))

    run.__name__, run.__doc__ = name, doc
    query(sql)(run)


_word("norm_text", "text", "CASE WHEN regexp_matches(c, '[a-zA-Z0-9]') THEN c END", "punctuation_only_value", "NM-01 and NM-02.")
_word("norm_material", "material", "CASE WHEN regexp_matches(c, '[a-zA-Z]') THEN c END", "ambiguous_numeric_material_or_grade", "NM-03.")
_word("norm_incoterms", "incoterms", "CASE WHEN regexp_matches(c, '^(exw|fca|cpt|cip|dap|dpu|ddp|fas|fob|cfr|cif|dat|daf|des|deq|ddu)\\b', 'i') THEN c END", "unrecognized_trade_delivery_term", "NM-04.")
_word("norm_unit", "unit", "CASE lower(c) WHEN 'kgs' THEN 'kg' WHEN 'cartons' THEN 'ctn' ELSE c END", "", "NM-05: unknown units pass unchanged.")
_word("norm_freight", "freight_terms", "CASE WHEN regexp_matches(lower(c), '^(freight )?prepaid$') THEN 'PREPAID' WHEN regexp_matches(lower(c), '^(freight )?collect$') THEN 'COLLECT' END", "unrecognized_freight_terms", "NM-07.")
_word("norm_currency", "currency", "CASE c WHEN 'KGS' THEN 'KGS' WHEN 'US$' THEN 'USD' WHEN '(eur)' THEN 'EUR' WHEN 'KRW' THEN 'KRW' END", "ambiguous_or_unsupported_currency", "NM-08.")
_word("norm_country", "country", "CASE c WHEN 'The Netherlands' THEN 'NL' WHEN 'Busan, Germany' THEN 'DE' END", "unrecognized_or_ambiguous_country", "NM-06.")


@query("""SELECT doc_id, regexp_replace(lower(strip_accents(trim(regexp_replace(substr(text, 1, 40), '\\s+', ' ', 'g')))), '[^a-z0-9_]', '', 'g') AS key FROM documents WHERE text IS NOT NULL AND NOT contains(text, 'ß')""")
def norm_vocabulary_key(spark: SparkSession, sf: str) -> DataFrame:
    """NM-16, over the head line of each text. Letters with no decomposition (as ß) fold by case rules that DuckDB lacks, and are left to the tests."""
    from .base import table

    head = F.trim(F.regexp_replace(F.substring("text", 1, 40), r"\s+", " "))
    return table(spark, sf, "documents").where("text IS NOT NULL AND NOT contains(text, 'ß')").select("doc_id", N.vocabulary_key(head).alias("key"))


@query("""WITH r AS (SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS v FROM orders)
SELECT k, v, regexp_replace(regexp_replace(printf('%,d', CAST(split_part(v, '.', 1) AS BIGINT)) || '.' || split_part(v, '.', 2), '0+$', ''), '\\.$', '') AS shown FROM r""".replace("printf('%,d', CAST", "format('{:,}', CAST"))
def norm_display_number(spark: SparkSession, sf: str) -> DataFrame:
    """NM-17."""
    v = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    from .base import table

    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), v.alias("v"), N.display_number(v).alias("shown"))


CORRECTIONS = """
SELECT event_id AS seq, ts AS `at`, user_id AS batch, CASE event_id % 4 WHEN 0 THEN 'amount' WHEN 1 THEN 'issue_date' WHEN 2 THEN 'currency' ELSE 'buyer' END AS field,
  CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 100 = 0 THEN '12,34' ELSE '1,234.50' END WHEN 1 THEN CASE WHEN event_id % 99 = 0 THEN '2024-02-31' ELSE '2024-02-29' END WHEN 2 THEN CASE WHEN event_id % 150 = 0 THEN 'US' ELSE 'usd' END ELSE 'Buyer ' || CAST(event_id AS STRING) END AS new_value,
  event_id % 500 AS cell
FROM {events}
"""
_ISSUE = """CASE WHEN field = 'amount' AND NOT regexp_matches(new_value, '^[+-]?(\\d+|\\d{1,3}(,\\d{3})+)(\\.\\d+)?$') THEN 'not_a_number' WHEN field = 'issue_date' AND try_strptime(new_value, '%Y-%m-%d') IS NULL THEN 'no_such_date'
 WHEN field = 'currency' AND NOT regexp_matches(upper(new_value), '^[A-Z]{3}$') THEN 'not_a_currency_code' END"""


@query(f"WITH c AS ({plain(CORRECTIONS)}) SELECT seq, field, new_value, {_ISSUE} AS issue FROM c")
def norm_correction_issues(spark: SparkSession, sf: str) -> DataFrame:
    """NM-18."""
    return view(spark, sf, CORRECTIONS, "events").select("seq", "field", "new_value", N.correction_issue(F.col("field"), F.col("new_value")).alias("issue"))


@query(f"""WITH c AS ({plain(CORRECTIONS)}), j AS (SELECT *, {_ISSUE} AS issue FROM c), ok AS (SELECT * FROM j WHERE batch NOT IN (SELECT batch FROM j WHERE issue IS NOT NULL)),
l AS (SELECT cell, field, new_value FROM (SELECT *, row_number() OVER (PARTITION BY cell, field ORDER BY "at" DESC, seq DESC) AS n FROM ok) WHERE n = 1),
b AS (SELECT cell, field, 'extracted ' || cell AS value FROM (SELECT DISTINCT event_id % 500 AS cell FROM events), (VALUES ('amount'), ('issue_date'), ('currency'), ('buyer')) AS f(field))
SELECT cell, field, value AS original_value, coalesce(new_value, value) AS value, new_value IS NOT NULL AS corrected FROM b LEFT JOIN l USING (cell, field)""")
def review_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """RV-26: batches with an invalid entry fall whole; the latest valid correction covers the extracted value."""
    from ..operators import review as V

    c = view(spark, sf, CORRECTIONS, "events")
    ok = V.valid_batches(c, N.correction_issue(F.col("field"), F.col("new_value")))
    base = c.select("cell").distinct().withColumn("field", F.explode(F.array(*map(F.lit, ("amount", "issue_date", "currency", "buyer"))))).withColumn("value", F.concat(F.lit("extracted "), F.col("cell").cast("string")))
    return V.latest_overlay(base, ok, ["cell", "field"])


@query(r"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t[1:20], ' ') AS head FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+|[\x{AC00}-\x{D7A3}]+') AS t FROM documents WHERE text IS NOT NULL)""")
def norm_lexical_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """NM-19 (these texts hold no Hangul; its character pairs are tested on fixtures)."""
    from .base import table

    t = N.lexical_tokens(F.col("text"))
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.array_join(F.slice("t", 1, 20), " ").alias("head"))


_COMPACT_SQL = r"SELECT doc_id, sha256(regexp_replace(text, '[\s\x0B]+', '', 'g')) AS no_space, sha256(trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g'))) AS one_space FROM documents WHERE text IS NOT NULL"


@query(_COMPACT_SQL)
def norm_compact(spark: SparkSession, sf: str) -> DataFrame:
    """NM-20: both forms."""
    from .base import table

    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(N.compact(F.col("text")), 256).alias("no_space"), F.sha2(N.collapse(F.col("text")), 256).alias("one_space"))


PAIRS = """
SELECT k, CASE k % 8 WHEN 0 THEN '1,250.50' WHEN 1 THEN 'pc' WHEN 2 THEN 'Acme  Co' WHEN 3 THEN NULL WHEN 4 THEN '7.0' WHEN 5 THEN NULL WHEN 6 THEN 'KG' ELSE CAST(k % 5 AS STRING) END AS a,
  CASE k % 8 WHEN 0 THEN '1250.5' WHEN 1 THEN 'Pieces' WHEN 2 THEN 'acme co' WHEN 3 THEN NULL WHEN 4 THEN '7' WHEN 5 THEN 'x' WHEN 6 THEN 'kgs' ELSE CAST(k % 3 AS STRING) END AS b,
  CASE WHEN k % 8 IN (0, 4, 7) THEN 'number' ELSE 'text' END AS kind FROM (SELECT o_orderkey AS k FROM {orders}) AS o
"""
_N = lambda c: f"try_cast({c} AS DECIMAL(38,9))"
_SYN = lambda c: f"CASE trim(upper(regexp_replace({c}, '\\s+', ' ', 'g'))) WHEN 'PC' THEN 'PCS' WHEN 'PIECE' THEN 'PCS' WHEN 'PIECES' THEN 'PCS' WHEN 'KGS' THEN 'KG' WHEN 'CARTON' THEN 'CTN' WHEN 'CARTONS' THEN 'CTN' ELSE trim(upper(regexp_replace({c}, '\\s+', ' ', 'g'))) END"
_C = lambda c: f"replace({c}, ',', '')"


@query(f"""WITH p AS ({plain(PAIRS)}) SELECT k, CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL WHEN {_N(_C('a'))} IS NOT NULL AND {_N(_C('b'))} IS NOT NULL THEN {_N(_C('a'))} = {_N(_C('b'))} ELSE {_SYN('a')} = {_SYN('b')} END AS truth,
 CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL WHEN kind = 'number' THEN coalesce({_N('a')} = {_N('b')}, FALSE) ELSE trim(regexp_replace(a, '\\s+', ' ', 'g')) = trim(regexp_replace(b, '\\s+', ' ', 'g')) END AS scoring,
 CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL WHEN {_N('a')} IS NOT NULL AND {_N('b')} IS NOT NULL THEN {_N('a')} = {_N('b')} ELSE lower(a) = lower(b) END AS held_out FROM p""")
def norm_equality(spark: SparkSession, sf: str) -> DataFrame:
    """NM-22, NM-23 and NM-24: three equalities that differ on purpose."""
    a, b, kind = F.col("a"), F.col("b"), F.col("kind")
    return view(spark, sf, PAIRS, "orders").select("k", N.equal_to_truth(a, b).alias("truth"), N.equal_for_scoring(a, b, kind).alias("scoring"), N.equal_held_out(a, b).alias("held_out"))


@query("""SELECT o_orderkey AS k, regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '\\.$', '') AS amount, 'T' || o_orderkey AS name FROM orders""")
def norm_json_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """NM-21: numbers inside a nested value get one spelling."""
    from .base import table

    m = F.create_map(F.lit("amount"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("name"), F.concat(F.lit("T"), F.col("o_orderkey").cast("string")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), N.numbers_without_zeros(m).alias("m")).select("k", F.col("m")["amount"].alias("amount"), F.col("m")["name"].alias("name"))
