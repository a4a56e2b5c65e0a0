"""Reconciliation of ledger rows with trade documents: linking, comparisons, statuses, audit points.

The comparison engine of the original is not visible; the rules here follow the contract that
its consumers show, and docstrings say where a rule is inferred. All comparisons of a
transaction are made from one grouping by transaction: its documents come onto one row, whether one of
its references agrees is read off that row, and the rule list is exploded against it. Rows stay where that grouping
put them, so statuses and roll-ups of a transaction need no further shuffle. Where all sources have ``tx``
beside the transaction's id, it is the key, so sources that were dealt out by it are
not shuffled again; the lines of a transaction are then in one task, which sorts them and holds few at a time.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PAIRS = (("commercial_invoice", "packing_list"), ("commercial_invoice", "bill_of_lading"), ("packing_list", "bill_of_lading"))
REFERENCES = ("invoice_number", "bill_of_lading_number", "purchase_order_number", "packing_list_number", "buyer_reference", "document_reference", "booking_number")
EVENTS = ("shipment_date", "on_board_date", "departure_date")
ITEM_MEASURES = ("product_code", "description", "unit", "quantity", "package_count", "gross_weight", "net_weight")
#: Documents whose lines are compared with each other.
ITEM_PAIRS = (("commercial_invoice", "packing_list"), ("packing_list", "bill_of_lading"))


def comparison_rules() -> list[tuple]:
    """(rule number, check type, event, left document, left field, right document, right field, left unit field, right unit field)."""
    rules = [
        ("ledger_invoice_amount_comparison", "", "ledger", "amount", "commercial_invoice", "total_amount", "currency", "currency"),
        ("ledger_invoice_currency_comparison", "", "ledger", "currency", "commercial_invoice", "currency", "", ""),
        ("ledger_invoice_counterparty_comparison", "buyer", "ledger", "counterparty", "commercial_invoice", "buyer", "", ""),
        ("ledger_invoice_counterparty_comparison", "seller", "ledger", "counterparty", "commercial_invoice", "seller", "", ""),
        ("invoice_transaction_date_review", "", "ledger", "transaction_date", "commercial_invoice", "issue_date", "", ""),
        ("invoice_posting_date_review", "", "ledger", "posting_date", "commercial_invoice", "issue_date", "", ""),
        ("document_gross_weight_comparison", "", "packing_list", "gross_weight", "bill_of_lading", "gross_weight", "gross_weight_unit", "gross_weight_unit"),
        ("document_net_weight_comparison", "", "packing_list", "net_weight", "bill_of_lading", "net_weight", "net_weight_unit", "net_weight_unit"),
        ("document_package_count_comparison", "", "packing_list", "total_packages", "bill_of_lading", "total_packages", "", ""),
    ]
    rules += [("cross_document_date_review", e, a, e, b, e, "", "") for e in EVENTS for a, b in _PAIRS]
    rules += [(f"reference_{r}", "", a, r, b, r, "", "") for r in REFERENCES for a, b in _PAIRS]
    return [(n, *r) for n, r in enumerate(rules, 1)]


def cells(documents: DataFrame, fields: list[str], status: Column | None = None) -> DataFrame:
    """Wide documents to one row a cell, in one pass over the documents."""
    keep = [c for c in ("tx", "document_type", "entity_id", "product_code") if c in documents.columns]
    status = status if status is not None else F.lit("accepted")
    pieces = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))
    return documents.select(*keep, status.alias("status"), F.explode(pieces).alias("c")).select(*keep, "status", "c.field", "c.value")


def links(ledger: DataFrame, documents: DataFrame) -> DataFrame:
    """Link documents to ledger rows by an explicit shared reference number (inferred rule).

    Both sides become (reference type, value) rows; a document that meets two transactions, or
    a transaction that meets two documents of a type, is not linked. Null references join nothing.
    """
    kinds = ("invoice_number", "purchase_order_number")
    as_rows = lambda df, *keys: df.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("ref_type"), F.col(k).alias("ref")) for k in kinds))).alias("r")).select(*keys, "r.*").where("ref IS NOT NULL")
    met = as_rows(ledger, "transaction_id").join(as_rows(documents, "entity_id", "document_type"), ["ref_type", "ref"])
    pairs = met.groupBy("entity_id", "document_type", "transaction_id").agg(F.count("*").alias("n_references"))
    torn = pairs.withColumn("_of_entity", F.count("*").over(Window.partitionBy("entity_id")))
    only = torn.groupBy("transaction_id", "document_type").agg(F.count("*").alias("_n"), F.first("entity_id").alias("entity_id"), F.first("n_references").alias("n_references"), F.max("_of_entity").alias("_of_entity"))
    return only.where("_n = 1 AND _of_entity = 1").select("transaction_id", "document_type", "entity_id", "n_references")


def unmatched_documents(documents: DataFrame, linked: DataFrame) -> DataFrame:
    return documents.join(linked.select("entity_id"), "entity_id", "left_anti")


#: What may be read as a number; only such text is cast, as a failing cast costs more than all the rest.
NUMERIC = r"^\s*[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\s*$"


def is_same(left: Column, right: Column) -> Column:
    """Numbers compare as numbers, everything else as text."""
    numbers = left.rlike(NUMERIC) & right.rlike(NUMERIC)
    return F.when(left == right, True).when(left.isNull() | right.isNull(), None).when(numbers, F.coalesce(left.try_cast("decimal(38,9)") == right.try_cast("decimal(38,9)"), F.lit(False))).otherwise(False)


def reason_of(left: Column, right: Column, unsure: Column, has_unit: Column, left_unit: Column, right_unit: Column) -> Column:
    """Why a comparison does not pass, null where it does: uncertain extraction, then a missing value or unit, then different values (inferred order)."""
    no_unit = has_unit & ~F.coalesce(left_unit == right_unit, F.lit(False))
    return F.when(unsure, "uncertain_extraction").when(left.isNull() | right.isNull(), "required_value_missing").when(no_unit, "value_or_unit_missing").when(~is_same(left, right), "different_values")


def status_of(reason: Column) -> Column:
    """A check's status by its reason: uncertain extraction and lines without counterpart are for review, absences cannot be evaluated."""
    return F.when(reason.isNull(), "pass").when(reason == "different_values", "flag").when(reason.isin("uncertain_extraction", "no_counterpart"), "review").otherwise("cannot_evaluate")


#: Columns of a check. ``ord`` orders the checks of a transaction; ``item`` names the line of an item check; ``linked``: some reference of the transaction agrees.
CHECK_COLUMNS = (
    "transaction_id check_id ord type event item left_doc left_field left_value right_doc right_field right_value left_unit right_unit status reason has_review linked"
).split()


def transaction_key(*sources: DataFrame) -> str:
    """What names a transaction in all of these sources, a number if there is one."""
    return "tx" if all("tx" in s.columns for s in sources) else "transaction_id"


def _sides(ledger: DataFrame, documents: DataFrame, extraction: str) -> tuple[DataFrame, list[str], list[str]]:
    """A row a transaction: its ledger row and each of its documents as structs; and the names of their fields."""
    kinds = sorted({d for r in comparison_rules() for d in (r[3], r[5])} - {"ledger"})
    names = sorted({f for r in comparison_rules() for f in (r[4], r[6], r[7], r[8]) if f and f in documents.columns})
    whole = F.struct(*(F.col(n) for n in names), F.col(extraction).alias("st"))
    key = transaction_key(ledger, documents)
    sides = documents.groupBy(key).agg(*(F.first(F.when(F.col("document_type") == k, whole), ignorenulls=True).alias(k) for k in kinds))
    ledger_names = [c for c in ledger.columns if c not in ("tx", "transaction_id")]
    return ledger.select(*{key: 0, "transaction_id": 0}, F.struct(*ledger_names, F.lit("accepted").alias("st")).alias("ledger")).join(sides, key, "left"), names, ledger_names


def checks(ledger: DataFrame, documents: DataFrame, expected: tuple[str, ...] = (), extraction: str = "extraction_status", alike: bool = False) -> DataFrame:
    """One row a transaction and rule whose two documents are there, and one for each ``expected`` document type: absent ones cannot be evaluated.

    Documents carry the transaction they are linked to. They are brought onto its row by one grouping (a struct a document type,
    reduced in the map tasks), the ledger is joined on the same key, and every rule is then a pair
    of plain column references, exploded from an array of fixed size. (The outer form of explode, as the
    plain one makes the optimiser test the array's size beforehand and so build it twice. Absent rules stay in the array as
    nulls until then, as a function with a lambda has all that it is given interpreted; one beside the array keeps its building
    out of whole-stage code, where it makes one method too long for the JVM to compile.)

    With ``alike`` a column of that name lists, in the order of their ids, the checks of the transaction that say the same (itself among them): their type,
    documents, values and units are equal, and so their reason, so that only id and event tell them apart; nulls stand for the others. It is null where no other check has that type and those documents.
    """
    wide, names, ledger_names = _sides(ledger, documents, extraction)
    none = F.lit(None).cast("string")

    def value(doc: str, field: str) -> Column:
        known = field in (ledger_names if doc == "ledger" else names)
        return F.col(f"{doc}.{field}").cast("string") if field and known else none

    def one(rule: tuple) -> tuple[Column, dict[str, Column]]:
        no, kind, event, ld, lf, rd, rf, lu, ru = rule
        there = F.col(ld).isNotNull() & F.col(rd).isNotNull()
        if event in ("buyer", "seller"):
            there = there & (F.col("ledger.counterparty_role") == event)
            event = ""
        row = {
            "check": F.lit(str(no)), "ord": F.lit(f"{no:04d}"), "type": F.lit(kind), "event": F.lit(event), "left_doc": F.lit(ld), "left_field": F.lit(lf), "left_value": value(ld, lf), "right_doc": F.lit(rd), "right_field": F.lit(rf), "right_value": value(rd, rf),
            "left_unit": value(ld, lu), "right_unit": value(rd, ru), "has_unit": F.lit(lu != ""), "has_review": (F.coalesce(F.col(f"{ld}.st"), F.lit("")) == "review") | (F.coalesce(F.col(f"{rd}.st"), F.lit("")) == "review"), "there": F.lit(True),
        }
        return there, row

    def presence(dt: str) -> tuple[Column, dict[str, Column]]:
        row = {
            "check": F.lit(dt), "ord": F.lit(f"1000:{dt}"), "type": F.lit("document_presence"), "event": F.lit(dt), **{c: none for c in ("left_doc", "left_field", "left_value", "right_doc", "right_field", "right_value", "left_unit", "right_unit")},
            "has_unit": F.lit(False), "has_review": F.lit(False), "there": F.col(dt).isNotNull(),
        }
        return F.lit(True), row

    made = [(r[0], (r[1], r[3], r[5]), *one(r)) for r in comparison_rules()] + [(dt, ("document_presence",), *presence(dt)) for dt in expected]

    def says(kind: tuple, row: dict) -> Column:
        """The checks that say what this one says."""
        kin = sorted(((str(no), there, other) for no, k, there, other in made if k == kind), key=lambda x: x[0])
        if len(kin) == 1:
            return F.lit(None).cast("array<struct<check_id:string,event:string>>")
        same = lambda other: reduce(and_, (row[c].eqNullSafe(other[c]) for c in ("left_value", "right_value", "left_unit", "right_unit", "has_unit", "there")))
        return F.array(*(F.when(there & same(other), F.struct(F.concat_ws(":", "transaction_id", other["check"]).alias("check_id"), other["event"].alias("event"))) for _, there, other in kin))

    def built(kind: tuple, there: Column, row: dict) -> Column:
        whole = row | ({"alike": says(kind, row)} if alike else {})
        return F.when(there, F.struct(*(c.alias(n) for n, c in whole.items())))

    agrees = lambda r: F.coalesce(r["type"].startswith("reference_") & ~r["has_review"] & is_same(r["left_value"], r["right_value"]), F.lit(False))
    equal = F.exists(F.array(*(F.coalesce(there & ~row["has_review"] & (row["left_value"] == row["right_value"]), F.lit(False)) for _, kind, there, row in made if kind[0].startswith("reference_"))), lambda x: x)
    rules = wide.select("transaction_id", equal.alias("equal"), F.array(*(built(*m[1:]) for m in made)).alias("rules"))
    linked = F.when(F.col("equal"), True).otherwise(F.exists("rules", agrees))
    rules = rules.select("transaction_id", linked.alias("linked"), "rules")  # before the array is exploded, or each of its rows carries all of it and looks through it again
    rows = rules.select("transaction_id", "linked", F.explode_outer("rules").alias("r")).where("r IS NOT NULL").select("transaction_id", "linked", "r.*")
    compared = reason_of(*(F.col(c) for c in ("left_value", "right_value", "has_review", "has_unit", "left_unit", "right_unit")))
    reason = F.when(F.col("type") == "document_presence", F.when(~F.col("there"), "required_document_not_linked")).otherwise(compared)
    rows = rows.withColumns({"check_id": F.concat_ws(":", "transaction_id", "check"), "item": none, "reason": reason})
    return rows.withColumn("status", status_of(F.col("reason"))).select(*CHECK_COLUMNS, *(["alike"] if alike else []))


def presence_checks(checked: DataFrame) -> DataFrame:
    return checked.where("type = 'document_presence'").select("transaction_id", F.col("event").alias("document_type"), "type", "status", "reason")


def lines_of(items: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """One row a transaction and ``line``, what a line is matched by, with the number of rows (``n_``) and the measures of each kind of document.

    A line is its product code; without one, the code that lines of the same description have in the
    transaction, if that is one code; else its description (fallback inferred). Rows of one code and description are
    one line in any case, so they are brought together first, and that order serves the look at their description too.
    """
    of_kind = lambda k, c: F.when(F.col("document_type") == k, c)
    named = items.withColumn("_told", F.lower(F.trim("description"))).withColumn("_code", F.col("product_code")).groupBy(key, "_told", "_code").agg(
        *(F.count(of_kind(k, F.lit(1))).alias(f"n_{k}") for k in kinds),
        *(F.first(of_kind(k, F.struct(*ITEM_MEASURES)), ignorenulls=True).alias(k) for k in kinds),
    )
    same = Window.partitionBy(key, "_told")
    least, most = F.min("_code").over(same), F.max("_code").over(same)
    coded = named.withColumns({"_least": least, "_most": most}).withColumn("line", F.coalesce("_code", F.when(F.col("_least") == F.col("_most"), F.col("_least")), F.concat(F.lit("d:"), "_told"), F.lit("d:")))
    return coded.groupBy(key, "line").agg(*(F.sum(f"n_{k}").alias(f"n_{k}") for k in kinds), *(F.first(k, ignorenulls=True).alias(k) for k in kinds))


def item_checks(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Comparisons of the lines of two documents of a transaction, matched where the line's key names one line on either side.

    A line without such a counterpart is an unmatched item. Where one of the two documents has no lines at all, that is one check of
    the pair, made beside the first of the transaction's lines, and none of its lines is compared.
    """
    kinds = sorted({d for p in ITEM_PAIRS for d in p})
    key = transaction_key(items, documents)
    there = documents.groupBy(*{key: 0, "transaction_id": 0}).agg(*(F.max(F.col("document_type") == k).alias(f"is_{k}") for k in kinds))
    whole = Window.partitionBy(key)
    met = there.join(lines_of(items, key, kinds), key, "left").withColumns({"_first": F.min("line").over(whole)} | {f"has_{k}": F.coalesce(F.max(F.col(f"n_{k}") > 0).over(whole), F.lit(False)) for k in kinds})
    both = lambda a, b: F.col(f"is_{a}") & F.col(f"is_{b}")
    has = lambda a, b: F.col(f"has_{a}") & F.col(f"has_{b}")
    first = F.col("line").eqNullSafe(F.col("_first"))
    lines = met.withColumns({f"ok{n}": both(a, b) & has(a, b) for n, (a, b) in enumerate(ITEM_PAIRS)} | {f"gone{n}": both(a, b) & ~has(a, b) & first for n, (a, b) in enumerate(ITEM_PAIRS)})
    none = F.lit(None).cast("string")

    def row(n: int, a: str, b: str, kind: str, ord_: Column, check: Column, field: str, lv: Column, rv: Column, lu: Column, ru: Column) -> Column:
        named = F.lit(field) if field else none
        return F.struct(check.alias("check"), ord_.alias("ord"), F.lit(kind).alias("type"), F.lit(a).alias("left_doc"), named.alias("left_field"), lv.alias("left_value"), F.lit(b).alias("right_doc"), named.alias("right_field"), rv.alias("right_value"), lu.alias("left_unit"), ru.alias("right_unit"))

    def of_pair(n: int, a: str, b: str) -> list[Column]:
        some = F.col(f"ok{n}") & F.exists(F.array(f"n_{a}", f"n_{b}"), lambda x: x > 0)
        matched = (F.col(f"n_{a}") == 1) & (F.col(f"n_{b}") == 1)
        at = lambda m: F.concat(F.lit("2000:"), "line", F.lit(f":{n}:{m}"))
        named = lambda m: F.concat(F.lit(f"i{n}:"), "line", F.lit(f":{m}"))
        out = [F.when(some & ~matched, row(n, a, b, "unmatched_item", at(0), named(0), "", none, none, none, none))]
        for m, field in enumerate(ITEM_MEASURES, 1):
            lu, ru = (F.col(f"{a}.unit"), F.col(f"{b}.unit")) if field == "quantity" else (none, none)
            out.append(F.when(F.col(f"ok{n}") & matched, row(n, a, b, f"item_{field}_comparison", at(m), named(m), field, F.col(f"{a}.{field}"), F.col(f"{b}.{field}"), lu, ru)))
        return out

    made = [c for n, (a, b) in enumerate(ITEM_PAIRS) for c in of_pair(n, a, b)]
    made += [F.when(F.col(f"gone{n}"), row(n, a, b, "item_table_unavailable", F.lit(f"1500:{n}"), F.lit(f"i{n}"), "", none, none, none, none)) for n, (a, b) in enumerate(ITEM_PAIRS)]
    rows = lines.select("transaction_id", "line", F.array(*made).alias("made")).select("transaction_id", "line", F.explode_outer("made").alias("r")).where("r IS NOT NULL").select("transaction_id", "line", "r.*")
    rows = rows.withColumn("item", F.when(F.col("type") != "item_table_unavailable", F.col("line")))
    told = F.col("left_field") == "description"
    said = lambda c: F.when(told, F.lower(F.trim(c))).otherwise(F.col(c))
    compared = reason_of(said("left_value"), said("right_value"), F.lit(False), F.col("left_field") == "quantity", F.col("left_unit"), F.col("right_unit"))
    reason = F.when(F.col("type") == "unmatched_item", "no_counterpart").when(F.col("type") == "item_table_unavailable", "item_table_unavailable").otherwise(compared)
    rows = rows.withColumns({"check_id": F.concat_ws(":", "transaction_id", "check"), "event": F.lit(""), "has_review": F.lit(False), "linked": F.lit(False), "reason": reason})
    return rows.withColumn("status", status_of(F.col("reason"))).select(*CHECK_COLUMNS)


def audit_points(all_checks: DataFrame) -> DataFrame:
    """Named findings of checks that did not pass."""
    name = F.concat(F.regexp_replace("type", "_(comparison|review)$", ""), F.when(F.col("status") == "flag", "_mismatch").when(F.col("status") == "review", "_uncertain").otherwise("_incomplete"))
    return all_checks.where("status <> 'pass'").select("transaction_id", "check_id", name.alias("audit_point"), "status", "reason")


def amount_difference(all_checks: DataFrame) -> DataFrame:
    """Ledger minus invoice where both are numbers in one unit, with its direction."""
    x, y = F.col("left_value").try_cast("decimal(20,2)"), F.col("right_value").try_cast("decimal(20,2)")
    d = (x - y).cast("decimal(20,2)")
    rows = all_checks.where("type = 'ledger_invoice_amount_comparison' AND left_unit = right_unit").where(x.isNotNull() & y.isNotNull())
    return rows.select("transaction_id", d.cast("double").alias("difference"), F.when(d > 0, "ledger_larger").when(d < 0, "ledger_smaller").otherwise("equal").alias("direction"), F.col("left_unit").alias("unit"))
