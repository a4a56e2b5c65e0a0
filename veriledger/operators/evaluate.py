"""Scoring of predictions against truth: confusion counts, rates, roll-ups, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(expected: Column, got: Column, correct: Column) -> dict[str, Column]:
    """Sums of tp, fp, fn, tn. A wrong value counts twice: as a false positive and, where one was expected, as a false negative."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return {
        "tp": one(correct & expected.isNotNull()), "tn": one(correct & expected.isNull()),
        "fp": one(~correct & got.isNotNull()), "fn": one(~correct & expected.isNotNull()),
    }


def with_rates(rows: DataFrame) -> DataFrame:
    """Precision and recall; null where there is nothing to divide by."""
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return rows.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})


def rollup_counts(scored: DataFrame, levels: list[list[str]]) -> DataFrame:
    """The same counts at several levels in one pass: grouping sets."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    return scored.groupingSets([[F.col(k) for k in level] for level in levels], *(F.col(k) for k in keys)).agg(*sums)


def flatten_gold(gold: DataFrame, header: str = "fields", items: str = "items") -> DataFrame:
    """Paths fields.X and items.N.X with their values, from maps and arrays of maps."""
    head = gold.select("doc_id", F.explode_outer(header).alias("k", "value")).where("k IS NOT NULL").select("doc_id", F.concat_ws(".", F.lit("fields"), "k").alias("path"), "value")
    rows = gold.select("doc_id", F.posexplode(items).alias("i", "row")).select("doc_id", "i", F.explode("row").alias("k", "value"))
    return head.unionByName(rows.select("doc_id", F.concat_ws(".", F.lit("items"), F.col("i").cast("string"), "k").alias("path"), "value"))


def extra_rows(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Predicted item rows beyond the gold rows of their document: false positives."""
    n = gold.groupBy("doc_id").agg(F.count("*").alias("n_gold"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("row_id"))
    return predicted.withColumn("place", place).join(n, "doc_id", "left").where(F.col("place") > F.coalesce("n_gold", F.lit(0))).drop("n_gold")


def contract_issues(fields: DataFrame) -> DataFrame:
    """Missing values or statuses, and ambiguous sources that were answered instead of left for review."""
    issue = F.when(F.col("status").isNull(), "missing_applicable_field_or_status").when(F.col("expected_review") & ((F.col("status") != "review") | F.col("value").isNotNull()), "ambiguous_source_requires_null_and_review")
    return fields.withColumn("issue", issue).where("issue IS NOT NULL")


def error_cause() -> Column:
    """The first cause that applies to a wrong field."""
    return (
        F.when(F.col("document_type") == "unknown", "document_classification").when(F.col("row_missing"), "item_row_link").when(F.col("value").isNotNull(), "wrong_field_link")
        .when(F.col("issue").rlike("invalid_date|ambiguous_number|invalid_number|unrecognized|numeric_material"), "normalization").when(F.col("status") == "review", "evidence_validation").otherwise("model_nonproposal")
    )


def greedy_matches(expected: DataFrame, found: DataFrame, keys: list[str], order_e: str, order_f: str) -> DataFrame:
    """One-to-one consumption of equal keys, first with first: a rank on either side, joined on it. Sums of tp, fp, fn by key."""
    number = lambda df, o, tag: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(o))).select(*keys, "_n", F.lit(1).alias(tag))
    both = number(expected, order_e, "e").join(number(found, order_f, "f"), [*keys, "_n"], "full")
    hit = F.col("e").isNotNull() & F.col("f").isNotNull()
    return both.groupBy(*keys).agg(F.count(F.when(hit, 1)).alias("tp"), F.count(F.when(F.col("e").isNull(), 1)).alias("fp"), F.count(F.when(F.col("f").isNull(), 1)).alias("fn"))


def check_matching(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """An expected check is right if some actual check matches it and all that match have its status."""
    joined = expected.join(actual.select(*keys, F.col("status").alias("actual_status")), keys, "left")
    return joined.groupBy(*keys, "status").agg(F.count("actual_status").alias("n_candidates"), F.coalesce(F.bool_and(F.col("actual_status") == F.col("status")), F.lit(False)).alias("correct"))


def region_errors(truth: DataFrame, boxes: DataFrame, margin: float = 4.0) -> DataFrame:
    """Character errors of regions on a page: each box takes the gold centres inside it that no earlier box took.

    A gold region goes to the first box in order that holds it, which is one aggregation over a
    join within the page; unequal text and regions left over count as edits.
    """
    inside = (F.col("cx").between(F.col("left") - margin, F.col("right") + margin)) & (F.col("cy").between(F.col("top") - margin, F.col("bottom") + margin))
    owned = truth.join(boxes.withColumnRenamed("text", "read"), "page").where(inside).groupBy("page", "gold_id", "cx", "text").agg(F.min("box_id").alias("box_id"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cx", "gold_id", "text"))), lambda g: g["text"]), " ")
    wanted = owned.groupBy("page", "box_id").agg(words.alias("want"))
    per_box = boxes.join(wanted, ["page", "box_id"], "left").select("page", F.levenshtein(F.coalesce("want", F.lit("")), "text").alias("edits"))
    lost = truth.join(owned.select("page", "gold_id"), ["page", "gold_id"], "left_anti").select("page", F.length("text").alias("edits"))
    length = truth.groupBy("page").agg(F.sum(F.length("text")).alias("n_chars"))
    total = per_box.unionByName(lost).groupBy("page").agg(F.sum("edits").alias("edits"))
    return length.join(total, "page", "left").select("page", F.coalesce("edits", F.lit(0)).alias("edits"), "n_chars", F.try_divide(F.coalesce("edits", F.lit(0)).cast("double"), F.col("n_chars")).alias("cer"))


def sealed(rows: DataFrame, content: str, seal: str) -> DataFrame:
    """Rows whose content still has the hash it was sealed with."""
    return rows.where(F.sha2(content, 256) == F.col(seal))


#: Patterns of things that must not be in a repository: key blocks, tokens, passwords in plain text.
SECRET_PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "assigned_secret": r"(?i)(?:api[_-]?key|secret|token|passwd|password)\s*[:=]\s*[\"'][^\"']{8,}[\"']",
    "cloud_key_id": r"\bAKIA[0-9A-Z]{16}\b", "bearer": r"(?i)\bbearer\s+[a-z0-9._-]{20,}",
}


def pattern_scan(rows: DataFrame, text: str) -> DataFrame:
    """One row a hit of a pattern."""
    hits = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(n)) for n, p in SECRET_PATTERNS.items())))
    return rows.withColumn("pattern", F.explode(hits))


def replayed(saved: DataFrame, gold: DataFrame) -> DataFrame:
    """Saved answers against gold: the last answer of each cell is replayed. A wrong value counts as false positive and false negative.

    ``saved``: doc_id, field, value, seen_at; ``gold``: doc_id, field, value. Cells are reduced to their last answer before they meet the gold.
    """
    last = saved.groupBy("doc_id", "field").agg(F.max_by(F.struct("value"), "seen_at").alias("s"))
    j = gold.withColumnRenamed("value", "gold").join(last, ["doc_id", "field"], "left").withColumn("said", F.col("s.value"))
    right, wrong = F.col("said") == F.col("gold"), ~F.col("said").eqNullSafe(F.col("gold"))
    line = F.when(F.col("said").isNotNull(), F.struct("field", "said"))
    agg = j.groupBy("doc_id").agg(
        F.max(F.col("s").isNotNull()).alias("replayed"), F.count(F.when(right, 1)).alias("tp"), F.count(F.when(F.col("said").isNotNull() & wrong, 1)).alias("fp"), F.count(F.when(F.col("gold").isNotNull() & wrong, 1)).alias("fn"), F.array_sort(F.collect_list(line)).alias("lines")
    )
    text = F.array_join(F.transform("lines", lambda r: F.concat(r["field"], F.lit("="), r["said"])), "\n")
    return agg.select("doc_id", "replayed", "tp", "fp", "fn", F.sha2(text, 256).alias("response_sha"))
