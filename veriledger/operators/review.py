"""Review of checks: waivers, statuses, area and transaction roll-ups, findings.

Input is one row a check (see ``reconcile.checks``): transaction_id, check_id, type, event,
left_doc, left_field, left_value, right_doc, right_field, right_value, left_unit, right_unit,
status, reason, has_review and, where they are known, ord (their order in the transaction), item, linked and alike. Two status lattices coexist on purpose: ``combined`` for areas and
transactions, ``transaction_states`` for presentation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Review areas, in their order.
AREAS = ("documents", "amount", "counterparty", "date", "references", "shipping", "logistics", "items")
#: The area of each check type.
AREA_OF = {
    "document_presence": "documents", "ledger_invoice_amount_comparison": "amount", "ledger_invoice_currency_comparison": "amount", "ledger_invoice_counterparty_comparison": "counterparty",
    "invoice_transaction_date_review": "date", "invoice_posting_date_review": "date", "cross_document_date_review": "shipping", "document_gross_weight_comparison": "logistics",
    "document_net_weight_comparison": "logistics", "document_package_count_comparison": "logistics", "item_table_unavailable": "items", "unmatched_item": "items",
    "reference_invoice_number": "references", "reference_bill_of_lading_number": "references", "reference_purchase_order_number": "references", "reference_packing_list_number": "references",
    "reference_buyer_reference": "references", "reference_document_reference": "references", "reference_booking_number": "references",
    "item_product_code_comparison": "items", "item_description_comparison": "items", "item_unit_comparison": "items", "item_quantity_comparison": "items",
    "item_package_count_comparison": "items", "item_gross_weight_comparison": "items", "item_net_weight_comparison": "items",
}
OPTIONAL_REFERENCES = ("packing_list_number", "buyer_reference", "document_reference", "booking_number")
OPTIONAL_ITEMS = ("item_gross_weight_comparison", "item_net_weight_comparison", "item_package_count_comparison")
RANK = {"NOT_APPLICABLE": 0, "PASS": 1, "REVIEW": 2, "MISSING": 3, "FAIL": 4}


def _lookup(pairs: dict, key: str | Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), F.col(key) if isinstance(key, str) else key)


def area() -> Column:
    return F.coalesce(_lookup(AREA_OF, "type"), F.lit("unmapped"))


def rule_catalog(spark) -> DataFrame:
    """The rule dimension: type, area, documents compared."""
    rows = [(t, a, ("ledger,commercial_invoice" if t.startswith(("ledger_", "invoice_")) else "packing_list,bill_of_lading" if t.startswith("document_") and t != "document_presence" else "commercial_invoice,packing_list,bill_of_lading")) for t, a in AREA_OF.items()]
    return spark.createDataFrame(rows, "type string, area string, documents string")


def with_scope(checks: DataFrame) -> DataFrame:
    """Add ``scope``: 'supplementary' for an absence that a transaction can do without, else 'required'.

    Only missing values are ever waived, never a flag and never a value under review. Whether some
    reference of the transaction agrees is told by ``linked``; checks without it cost one window over the transaction.
    Checks ``alike`` differ by their event alone, so those stay whose event is or is not waived as this one's is.
    """
    if "linked" in checks.columns:
        checks = checks.withColumnRenamed("linked", "_linked")
    else:
        agrees = (F.col("status") == "pass") & F.col("type").startswith("reference_")
        checks = checks.withColumn("_linked", F.max(F.when(agrees, True).otherwise(False)).over(Window.partitionBy("transaction_id")))
    gone_l, gone_r = F.col("left_value").isNull(), F.col("right_value").isNull()
    some, both = gone_l | gone_r, gone_l & gone_r
    absent_in = lambda docs: some & (~gone_l | F.col("left_doc").isin(*docs)) & (~gone_r | F.col("right_doc").isin(*docs))
    on_board = (F.col("type") == "cross_document_date_review") & absent_in(("commercial_invoice", "packing_list"))
    waived = (
        (F.col("_linked") & F.col("type").isin(*(f"reference_{r}" for r in OPTIONAL_REFERENCES)))
        | ((F.col("type") == "cross_document_date_review") & both)
        | (F.col("type").isin(*OPTIONAL_ITEMS) & (both | absent_in(("commercial_invoice",))))
    )
    may = (F.col("status") == "cannot_evaluate") & F.col("reason").isin("required_value_missing", "value_or_unit_missing") & ~F.col("has_review")
    extra = lambda event: may & (waived | on_board & (event == "on_board_date"))
    checks = checks.withColumn("scope", F.when(extra(F.col("event")), "supplementary").otherwise("required"))
    if "alike" in checks.columns:
        told_apart = F.coalesce(may & on_board & ~waived, F.lit(False))
        same_event = lambda a: a.isNotNull() & (~F.col("_apart") | ((a["event"] == "on_board_date") == (F.col("event") == "on_board_date")))
        checks = checks.withColumn("_apart", told_apart).withColumn("alike", F.filter("alike", same_event)).drop("_apart")
    return checks.drop("_linked")


def with_rule_status(checks: DataFrame) -> DataFrame:
    """Add ``rule_status``. The order matters: an unlinked document, then waivers, then unknown types, then the check's own status.

    Checks ``alike`` become one text of their ids, and ``first_alike``. All pass through a one-element array, so that filters on it are not rewritten down to the documents' columns, where their code outgrows what the JVM compiles.
    """
    own = F.coalesce(_lookup({"pass": "PASS", "flag": "FAIL", "review": "REVIEW", "cannot_evaluate": "MISSING"}, "status"), F.lit("REVIEW"))
    status = F.when(F.col("reason") == "required_document_not_linked", "MISSING").when(F.col("scope") == "supplementary", "NOT_APPLICABLE").when(area() == "unmapped", "REVIEW").otherwise(own)
    scoped = with_scope(checks)
    if "alike" not in scoped.columns:
        return scoped.select(*scoped.columns, F.explode_outer(F.array(status)).alias("rule_status"))
    made = F.struct(status.alias("rule_status"), F.col("alike")[0]["check_id"].alias("first_alike"), F.array_join("alike.check_id", ",").alias("alike"))
    return scoped.select(*(c for c in scoped.columns if c != "alike"), F.explode_outer(F.array(made)).alias("r")).select("*", "r.*").drop("r")


def combined(column: str = "rule_status") -> Column:
    """Worst status of a group: FAIL, MISSING, REVIEW, PASS, else NOT_APPLICABLE."""
    return F.coalesce(_lookup({v: k for k, v in RANK.items()}, F.max(_lookup(RANK, column))), F.lit("NOT_APPLICABLE"))


def groups(ruled: DataFrame) -> DataFrame:
    """Rule and event groups with their status, checks and distinct values in the order in which the transaction's checks show them."""
    place = "ord" if "ord" in ruled.columns else "check_id"
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place).alias("ord"), "check_id", "left_value", "right_value")))
    values = F.array_distinct(F.array_compact(F.flatten(F.transform(F.col("rows"), lambda r: F.array(r["left_value"], r["right_value"])))))
    grouped = ruled.where(area() != "unmapped").groupBy("transaction_id", area().alias("area"), "type", "event").agg(combined().alias("status"), ordered.alias("rows"))
    return grouped.select("transaction_id", "area", F.concat_ws(":", "type", "event").alias("group_id"), "status", F.size("rows").alias("n_checks"), F.array_join(F.transform("rows", lambda r: r["check_id"]), ",").alias("check_ids"), F.array_join(values, "|").alias("values"))


def areas(ruled: DataFrame) -> DataFrame:
    """Areas of each transaction; those without an applicable rule are left out, unknown rules make an area for review."""
    rolled = ruled.groupBy("transaction_id", area().alias("area")).agg(combined().alias("status"), F.sum(F.when(F.col("rule_status") != "NOT_APPLICABLE", 1).otherwise(0)).alias("n_checks"))
    return rolled.withColumn("status", F.when(F.col("area") == "unmapped", "REVIEW").otherwise(F.col("status"))).where("status <> 'NOT_APPLICABLE'")


def transactions(area_rows: DataFrame) -> DataFrame:
    """Overall status and area counts of each transaction."""
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s.lower()}") for s in ("PASS", "FAIL", "REVIEW", "MISSING")]
    return area_rows.groupBy("transaction_id").agg(combined("status").alias("overall_status"), *counts)


def missing_required(ruled: DataFrame) -> DataFrame:
    """Missing values, once each with all checks that want them; a MISSING check without an absent value stands for itself."""
    item = F.col("item") if "item" in ruled.columns else F.lit(None).cast("string")
    gone = ruled.where("rule_status = 'MISSING'")
    sides = F.array_compact(F.array(*(F.when(F.col(f"{s}_doc").isNotNull() & F.col(f"{s}_field").isNotNull() & F.col(f"{s}_value").isNull(), F.struct(F.col(f"{s}_doc").alias("document_type"), F.col(f"{s}_field").alias("field"))) for s in ("left", "right"))))
    own = F.array(F.struct(F.col("check_id").alias("document_type"), F.lit("").alias("field")))
    rows = gone.select("transaction_id", "check_id", item.alias("item"), F.explode(F.when(F.size(sides) > 0, sides).otherwise(own)).alias("m"))
    return rows.groupBy("transaction_id", "m.document_type", "m.field", "item").agg(F.count("*").alias("n_checks"), F.min("check_id").alias("first_check"))


def transaction_states(scoped: DataFrame, all_transactions: DataFrame) -> DataFrame:
    """Presentation state: any open flag or review, then anything missing or no check at all, then pass."""
    open_ = scoped.where("scope <> 'supplementary'").groupBy("transaction_id").agg(F.max(F.col("status").isin("flag", "review")).alias("bad"), F.max(F.col("status") == "cannot_evaluate").alias("gone"))
    state = F.when(F.col("bad"), "review").when(F.coalesce(F.col("gone"), F.lit(True)), "cannot_evaluate").otherwise("pass")
    return all_transactions.join(open_, "transaction_id", "left").select("transaction_id", state.alias("state"))


def findings(ruled: DataFrame, by_line: bool = False) -> DataFrame:
    """Facts for explanation: identical ones are one row that keeps all check ids; differences only of numbers in one known unit.

    Checks that come with those ``alike`` are not grouped: the first of them stands for all. Without them identical facts meet in a grouping, where its checks are.
    Facts about lines (``by_line``) name their line, no two are alike, and nothing is grouped.
    """
    d = F.when(F.col("left_unit") == F.col("right_unit"), (F.col("left_value").try_cast("decimal(20,4)") - F.col("right_value").try_cast("decimal(20,4)")).cast("decimal(20,4)"))
    kind = _lookup({"FAIL": "value_mismatch", "MISSING": "missing_evidence", "REVIEW": "unresolved_comparison", "PASS": "matched_values"}, "rule_status")
    item = F.col("item") if "item" in ruled.columns else F.lit(None).cast("string")
    ruled = ruled.where("rule_status <> 'NOT_APPLICABLE'")
    listed = "alike" in ruled.columns
    if listed:
        ruled = ruled.where("first_alike IS NULL OR first_alike = check_id")
    rows = ruled.select(
        "transaction_id", "check_id", area().alias("area"), "type", item.alias("item"), F.col("rule_status").alias("status"), kind.alias("finding_type"), "left_doc", "left_value", "right_doc", "right_value", d.alias("difference"),
        F.when(d > 0, "left_greater").when(d < 0, "left_less").when(d == 0, "equal").alias("direction"), *(["alike"] if listed else []),
    )
    if by_line or listed:
        ids = F.coalesce("alike", "check_id") if listed else F.col("check_id")
        return rows.withColumns({"finding_id": F.col("check_id"), "check_ids": ids}).drop("check_id", "alike")
    facts = [c for c in rows.columns if c not in ("transaction_id", "check_id")]
    return rows.groupBy("transaction_id", *facts).agg(F.min("check_id").alias("finding_id"), F.array_join(F.array_sort(F.collect_list("check_id")), ",").alias("check_ids"))


def _order() -> list[Column]:
    return [F.expr("array_position(array('FAIL','MISSING','REVIEW','PASS'), status)"), F.col("area"), F.col("finding_id")]


def top_findings(found: DataFrame, limit: int = 4) -> DataFrame:
    """The first findings of each transaction: issues if there are any, worst first.

    Issues come first in the order, so what is left of the first few after dropping matches beside an issue is the answer; each task sends on its own first few.
    """
    tx = Window.partitionBy("transaction_id")
    rows = found.withColumn("rank", F.row_number().over(tx.orderBy(*_order()))).where(F.col("rank") <= limit)
    return rows.withColumn("_issue", F.max(F.col("status") != "PASS").over(tx)).where("NOT _issue OR status <> 'PASS'").drop("_issue")


def summary_findings(found: DataFrame, limit: int = 16) -> DataFrame:
    """One finding a transaction and area, the worst, then the first of all."""
    first = F.row_number().over(Window.partitionBy("transaction_id", "area").orderBy(*_order()))
    return found.withColumn("_n", first).where("_n = 1").drop("_n").orderBy(_order()[0], "area", "transaction_id").limit(limit)


def topic(type_: Column, fields: Column) -> Column:
    """Subject of a check from its type and its evidence fields; the first that applies."""
    has = lambda *names: F.arrays_overlap(fields, F.array(*map(F.lit, names)))
    return (
        F.when(type_.contains("currency"), "currency").when(type_.contains("date") | F.exists(fields, lambda f: f.endswith("_date")), "date")
        .when(has("amount", "total_amount", "subtotal", "tax", "unit_price"), "amount").when(has("quantity", "gross_weight", "net_weight", "total_packages", "package_count", "volume"), "quantity")
        .when(F.exists(fields, lambda f: f.contains("number") | f.contains("reference")), "identity").otherwise("other")
    )


def workpapers(ruled: DataFrame) -> DataFrame:
    """Actionable checks of a transaction by topic, numbered WP-01 on."""
    rows = ruled.where("rule_status IN ('FAIL', 'REVIEW')").withColumn("topic", topic(F.col("type"), F.array_compact(F.array("left_field", "right_field"))))
    grouped = rows.groupBy("transaction_id", "topic").agg(F.count("*").alias("n_checks"), F.min("check_id").alias("first_check"))
    n = F.row_number().over(Window.partitionBy("transaction_id").orderBy("topic"))
    return grouped.withColumn("workpaper", F.concat(F.lit("WP-"), F.lpad(n.cast("string"), 2, "0")))


def content_id(*parts: Column) -> Column:
    """Content-addressed id: the first 24 hex digits of sha256 over the parts' canonical text."""
    return F.concat(F.lit("e-"), F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256), 1, 24))


def first_of_duplicates(rows: DataFrame, content: Column, ordinal: str) -> DataFrame:
    """Mark rows whose content came before: the first in order is accepted, later ones are duplicates of it.

    The first is found by aggregation, so content that a third of all rows share is no hot window.
    """
    keyed = rows.withColumn("content_hash", F.sha2(content, 256))
    first = keyed.groupBy("content_hash").agg(F.min(ordinal).alias("first_ordinal"))
    return keyed.join(first, "content_hash").withColumn("accepted", F.col(ordinal) == F.col("first_ordinal"))


def latest_overlay(base: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Latest valid correction of each cell over the extracted value; the original stays beside it."""
    last = corrections.groupBy(*keys).agg(F.max_by(F.struct("new_value"), F.struct("at", "seq")).alias("c"))
    joined = base.join(last, keys, "left")
    return joined.select(*keys, F.col("value").alias("original_value"), F.when(F.col("c").isNotNull(), F.col("c.new_value")).otherwise(F.col("value")).alias("value"), F.col("c").isNotNull().alias("corrected"))


def valid_batches(corrections: DataFrame, issue: Column) -> DataFrame:
    """All or nothing: a batch with one invalid entry is dropped whole."""
    bad = corrections.where(issue.isNotNull()).select("batch").distinct()
    return corrections.join(bad, "batch", "left_anti")
