"""Intake: manifests, standards catalogues, rights, and chains of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise


def upload_issues(manifest: DataFrame, most_files: int = 30, most_bytes: int = 64_000_000, suffixes: tuple[str, ...] = ("json", "csv", "png", "jpg", "jpeg", "tif")) -> DataFrame:
    """What is wrong with each upload of files (upload_id, name, bytes): too many, too large, or a suffix that is not taken."""
    bad = ~F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*suffixes)
    g = manifest.groupBy("upload_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"), F.bool_or(bad).alias("bad"))
    issues = F.array_compact(F.array(F.when(F.col("n") > most_files, "too_many_files"), F.when(F.col("total") > most_bytes, "too_large"), F.when(F.col("bad"), "suffix_not_taken")))
    return g.select("upload_id", "n", "total", F.array_join(issues, ",").alias("issues"))


def catalogue(pages: DataFrame) -> DataFrame:
    """Links of each page as catalogue rows, one a target: attributes and captions by pattern, the first in page order kept."""
    link = r'<a href="([^"]*)">([^<]*)</a>'
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(link), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(link), F.lit(2)).alias("caption"))).alias("n", "a"))
    first = rows.groupBy("page_id", F.col("a.href").alias("href")).agg(F.min(F.struct("n", F.col("a.caption").alias("caption"))).alias("f"))
    return first.select("page_id", "href", "f.caption")


def page_heads(pages: DataFrame) -> DataFrame:
    """Title and language of a page; a page without a title is an error row, not a guess."""
    title = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)), F.lit(""))
    lang = F.nullif(F.regexp_extract("html", r'<html lang="(\w+)"', 1), F.lit(""))
    return pages.select("page_id", title.alias("title"), lang.alias("lang"), F.when(title.isNull(), "no_title").alias("error"))


def preferred(rows: DataFrame, key: str, order: list[Column], least: int = 3) -> DataFrame:
    """One row a key, the first in order; empty when fewer than ``least`` keys were found, as a broken list must not replace a store."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    enough = first.agg((F.count("*") >= least).alias("_enough"))  # one row
    return first.crossJoin(F.broadcast(enough)).where("_enough").drop("_enough")


def with_rights(documents: DataFrame, grants: DataFrame, kind: str = "source_type") -> DataFrame:
    """Documents whose source has a reference and all three grants."""
    ok = grants.where(F.col("reference").isNotNull() & (F.trim("reference") != "") & F.col("store") & F.col("search") & F.col("show")).select(kind)
    return documents.join(ok, kind, "left_semi")


def reference_chains(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): groups of references joined directly or through others, named by their smallest (inferred; no consumer shows it).

    Minimum labels are passed along pairs and through the labels reached so far, each round written
    to the shared folder, until nothing changes.
    """
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = materialise(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "chains")
    labels = materialise(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "chains")
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("root"))
        jump = step.join(labels.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("node", F.least("root", F.coalesce("far", F.col("root"))).alias("root"))
        after = materialise(jump, "chains")
        changed = after.join(labels.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        labels = after
        if not changed:
            return labels


def port_pairs(labels: DataFrame) -> DataFrame:
    """Abbreviations of loading and discharge ports stand only beside each other: exactly one opposite on the page within eight units."""
    p = labels.where(F.col("text").isin("POL", "POD"))
    q = p.select("doc_id", "page", F.col("tid").alias("other"), F.col("text").alias("other_text"), F.col("y").alias("oy"))
    near = p.join(q, ["doc_id", "page"]).where((F.col("text") != F.col("other_text")) & (F.abs(F.col("y") - F.col("oy")) <= 8 * F.col("h")))
    one = near.groupBy("doc_id", "page", "tid", "text").agg(F.count("*").alias("n")).where("n = 1")
    return one.select("doc_id", "page", "tid", F.when(F.col("text") == "POL", "port_of_loading").otherwise("port_of_discharge").alias("field"))


def party_references(cells: DataFrame) -> DataFrame:
    """'Same as X' takes the value of X in its document, if X is accepted; else it is unresolved."""
    target = F.regexp_extract(F.lower("value"), r"^same as (\w+)$", 1)
    asked = cells.withColumn("target", F.when(target != "", target))
    known = cells.where("status = 'accepted' AND NOT lower(value) RLIKE '^same as '").select("doc_id", F.col("field").alias("target"), F.col("value").alias("copied"))
    j = asked.join(known, ["doc_id", "target"], "left")
    gone = F.col("target").isNotNull() & F.col("copied").isNull()
    return j.select("doc_id", "field", F.when(F.col("target").isNull(), F.col("value")).otherwise(F.col("copied")).alias("value"), F.when(gone, "review").otherwise(F.col("status")).alias("status"), F.col("target").alias("reference_field"), F.when(gone, "referenced_field_unresolved").alias("null_reason"))


def aliases(cells: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Compatibility fields mirror the canonical ones."""
    old = F.try_element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), F.col("field"))
    return cells.unionByName(cells.withColumn("field", old).where("field IS NOT NULL"))


def column_currency(cells: DataFrame) -> DataFrame:
    """The currency of money columns: one code, else ambiguous."""
    codes = cells.where("field IN ('unit_price', 'amount')").select("doc_id", F.regexp_extract("text", r"\b([A-Z]{3})\b", 1).alias("code")).where("code <> ''")
    g = codes.groupBy("doc_id").agg(F.countDistinct("code").alias("n"), F.min("code").alias("code"))
    return g.select("doc_id", F.when(F.col("n") == 1, F.col("code")).alias("currency"), F.when(F.col("n") == 1, "accepted").otherwise("review").alias("status"))


def placed_totals(header: DataFrame, totals: DataFrame) -> DataFrame:
    """A table's total row fills header totals that are empty, and no others."""
    j = header.join(totals.withColumnRenamed("value", "total"), ["doc_id", "field"], "full")
    return j.select("doc_id", "field", F.coalesce("value", "total").alias("value"), F.when(F.col("value").isNotNull(), "header").otherwise("total_row").alias("origin"))


def valid_responses(labels: DataFrame, candidates: DataFrame, fields: DataFrame) -> DataFrame:
    """Labels of a model that name a candidate token and a known field; a null field is an abstention and is kept apart."""
    known = labels.join(candidates.select("doc_id", "tid"), ["doc_id", "tid"], "left_semi")
    return known.join(F.broadcast(fields.select("field")), "field", "left_semi")


def candidates(tokens: DataFrame, taken: DataFrame, longest: int = 100) -> DataFrame:
    """Tokens that a model may label: no scalars, no long prose, nothing the vocabulary has."""
    free = tokens.where((F.length("text") < longest) & ~F.col("text").rlike(r"^[\d.,\s%$€£-]+$"))
    return free.join(taken.select("doc_id", "tid"), ["doc_id", "tid"], "left_anti")


def negative_captions(text: Column) -> Column:
    """Kinds of caption that name no trade field: signatures, page marks, hazard classes, account details; null for all others."""
    return (
        F.when(text.rlike(r"(?i)^(?:authori[sz]ed )?signature|signed by"), "attribution").when(text.rlike(r"(?i)^page \d+(?: of \d+)?$"), "structural")
        .when(text.rlike(r"(?i)\b(?:un no|imo class|hazard)\b"), "unsupported").when(text.rlike(r"(?i)\b(?:iban|swift|account no)\b"), "non_trade")
    )


def label_chains(tokens: DataFrame, vocabulary: DataFrame, hops: int = 4) -> DataFrame:
    """Captions over up to five lines (``hops`` + 1, as the original): tokens below each other are joined while the phrase begins a known term; the longest known phrase of each first token stays.

    ``vocabulary`` (term, field) is a small dimension; each hop is a join within the page.
    """
    key = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", "")
    t = tokens.select("doc_id", "page", "tid", key.alias("key"), "x", "y", "h").where("key <> ''")
    begins = F.broadcast(vocabulary)
    chain = t.select("doc_id", "page", F.col("tid").alias("first"), F.col("tid").alias("last"), "key", "x", "y", "h", F.lit(1).alias("n"))
    found = chain.join(begins, chain["key"] == vocabulary["term"]).select("doc_id", "page", "first", "last", "n", "field")
    for _ in range(hops):
        nxt = t.select("doc_id", "page", F.col("tid").alias("tid2"), F.col("key").alias("key2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        j = chain.join(nxt, ["doc_id", "page"]).where((F.col("y2") > F.col("y")) & (F.col("y2") - F.col("y") <= 1.8 * F.col("h")) & (F.abs(F.col("x2") - F.col("x")) <= F.col("h")))
        longer = j.select("doc_id", "page", "first", F.col("tid2").alias("last"), F.concat("key", "key2").alias("key"), F.col("x2").alias("x"), F.col("y2").alias("y"), "h", (F.col("n") + 1).alias("n"))
        chain = longer.join(begins, vocabulary["term"].startswith(longer["key"]), "left_semi")
        found = found.unionByName(chain.join(begins, chain["key"] == vocabulary["term"]).select("doc_id", "page", "first", "last", "n", "field"))
    return found.groupBy("doc_id", "page", "first").agg(F.max(F.struct("n", "last", "field")).alias("b")).select("doc_id", "page", "first", "b.last", "b.n", "b.field")
