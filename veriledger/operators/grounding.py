"""Labels, geometry and grounding over token rows: doc_id, page, tid, text, x, y, w, h, confidence.

Every distance is a multiple of the document's median token height, so results do not change
with the scale of the page. Neighbour searches are joins within a page, never across documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]


def caption_key(text: str | Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def with_units(tokens: DataFrame) -> DataFrame:
    """Right, bottom, centre, and the document's unit: its exact median token height, 1 at least."""
    t = tokens.withColumns({"right": F.col("x") + F.col("w"), "bottom": F.col("y") + F.col("h"), "cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})
    return t.withColumn("unit", F.median(F.greatest(F.col("h"), F.lit(1.0))).over(Window.partitionBy("doc_id")))


def relative(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes over page sizes, to four places."""
    j = tokens.join(pages, PAGE)
    return j.select(*PAGE, "tid", *(F.round(F.col(c) / F.col(s), 4).alias(c) for c, s in (("x", "width"), ("y", "height"), ("w", "width"), ("h", "height"))))


def _vocabulary(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def lexical_labels(tokens: DataFrame, vocabulary: dict[str, str]) -> DataFrame:
    """Tokens that are a known caption, or begin with one before a colon; a bounded vocabulary is a literal map."""
    head = F.split("text", ":")[0]
    field = F.try_element_at(_vocabulary(vocabulary), caption_key(head))
    return tokens.withColumns({"field": field, "inline": F.trim(F.regexp_extract("text", r":\s*(\S.*)$", 1))}).where("field IS NOT NULL")


def fuzzy_labels(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Captions exactly one edit from the terms of exactly one field. ``vocabulary``: term, field; a small dimension.

    Distinct captions are compared, not tokens: short ones without digits, of at most six words.
    """
    key = caption_key("text")
    captions = tokens.where(~F.col("text").rlike(r"\d") & (F.size(F.split("text", r"\s+")) <= 6)).select(key.alias("key")).distinct().where(F.length("key").between(8, 45))
    known = captions.join(F.broadcast(vocabulary), captions["key"] == vocabulary["term"], "left_anti")
    near = known.join(F.broadcast(vocabulary), F.levenshtein("key", "term", 1) == 1).groupBy("key").agg(F.min("field").alias("field"), F.countDistinct("field").alias("n")).where("n = 1")
    return tokens.withColumn("key", key).join(near.select("key", "field"), "key").drop("key")


def headings(tokens: DataFrame, patterns: dict[str, str]) -> DataFrame:
    kind = F.coalesce(*(F.when(F.col("text").rlike(p), F.lit(k)) for k, p in patterns.items()))
    return tokens.withColumn("document_type", kind).where("document_type IS NOT NULL")


def document_type(tokens: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """The tallest heading names the document; then page, then top. Documents without one are unknown."""
    best = headings(tokens, patterns).groupBy("doc_id").agg(F.min(F.struct((-F.col("h")).alias("h"), "page", "y", "tid", "document_type")).alias("b"))
    return tokens.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("b.document_type", F.lit("unknown")).alias("document_type"))


def nearest_values(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """For each label the cheapest value: on its line to the right, or below within four units.

    Cost is vertical distance plus a tenth of the horizontal, and two more without overlap. Tokens
    that are labels themselves are no values; each value goes to its cheapest label.
    """
    t = with_units(tokens)
    lab = labels.select(*PAGE, F.col("tid").alias("lid"), "field", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("w").alias("lw"), F.col("h").alias("lh"))
    free = t.join(labels.select(*PAGE, "tid"), [*PAGE, "tid"], "left_anti")
    j = lab.join(free, PAGE)
    dy, dx = F.abs(F.col("cy") - (F.col("ly") + F.col("lh") / 2)), F.greatest(F.lit(0.0), F.col("x") - (F.col("lx") + F.col("lw")))
    overlap = (F.col("x") < F.col("lx") + F.col("lw")) & (F.col("right") > F.col("lx"))
    same_line = (dy < F.col("unit") * 0.8) & (F.col("x") >= F.col("lx") + F.col("lw"))
    below = (F.col("y") > F.col("ly")) & (dy <= F.col("unit") * 4) & (overlap | (dx < F.col("unit") * 6))
    cost = F.round(dy / F.col("unit") + dx / (F.col("unit") * 10) + F.when(same_line | overlap, 0.0).otherwise(2.0), 4)
    near = j.where(same_line | below).withColumn("cost", cost)
    mine = near.groupBy(*PAGE, "tid").agg(F.min(F.struct("cost", "lid")).alias("m")).select(*PAGE, "tid", F.col("m.lid").alias("lid"))
    return near.join(mine, [*PAGE, "tid", "lid"]).groupBy(*PAGE, "lid", "field").agg(F.min(F.struct("cost", "tid", "text")).alias("v")).select(*PAGE, "lid", "field", F.col("v.tid").alias("tid"), F.col("v.text").alias("text"), F.col("v.cost").alias("cost"))


def value_span(text: Column, kind: str) -> Column:
    """The one typed value inside a token, else null: two numbers are no number."""
    patterns = {"number": r"(-?\d[\d.,]*\d|\d)", "unit": r"(?i)\b(kg|lb|m3|pcs|ctn)\b", "currency": r"\b([A-Z]{3})\b$", "date": r"(?i)(\d{1,2} [A-Z][a-z]{2} \d{4})"}
    hits = F.regexp_extract_all(text, F.lit(patterns[kind]), F.lit(1))
    return F.when(F.size(hits) == 1, hits[0])


def columns(tokens: DataFrame, headers: DataFrame) -> DataFrame:
    """Give every token below a header row the header nearest to its left edge."""
    h = headers.select(*PAGE, "field", F.col("x").alias("hx"), F.col("y").alias("hy"))
    j = tokens.join(h, PAGE).where(F.col("y") > F.col("hy") + F.col("h"))
    return j.groupBy(*PAGE, "tid", "text").agg(F.min_by("field", F.struct(F.abs(F.col("x") - F.col("hx")), F.col("field"))).alias("field"))


def bands(tokens: DataFrame) -> DataFrame:
    """Line numbers: a token joins the line when it lies within 0.8 of its height of the median of the line's tokens so far.

    The median moves as a line grows, which no window frame follows; pages stream through sorted, one at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, lines = None, []
        for b in batches:
            out = []
            for d, p, cy, h in zip(b["doc_id"], b["page"], b["cy"], b["h"]):
                if (d, p) != now:
                    now, lines = (d, p), []
                hit = None
                for k in range(len(lines) - 1, max(-1, len(lines) - 3), -1):
                    ys = lines[k]
                    mid = ys[len(ys) // 2] if len(ys) % 2 else (ys[len(ys) // 2 - 1] + ys[len(ys) // 2]) / 2
                    if abs(cy - mid) < 0.8 * h:
                        hit = k
                        break
                if hit is None:
                    lines.append([])
                    hit = len(lines) - 1
                lines[hit] = sorted([*lines[hit], cy])
                out.append(hit)
            yield pd.DataFrame({"doc_id": b["doc_id"], "page": b["page"], "tid": b["tid"], "line": out})

    rows = tokens.select("doc_id", "page", "tid", (F.col("y") + F.col("h") / 2).alias("cy"), F.col("h").cast("double").alias("h"))
    return rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "cy", "tid").mapInPandas(run, "doc_id long, page int, tid int, line int")


def table_rows(tokens: DataFrame, vocabulary: dict[str, str], core: tuple[str, ...] = ("quantity", "description")) -> DataFrame:
    """Rows of the item table: a band of two or more captions with a core field is the header; bands below it with two or more typed cells are rows."""
    lined = tokens.join(bands(tokens), [*PAGE, "tid"])
    named = lined.withColumn("field", F.try_element_at(_vocabulary(vocabulary), caption_key("text")))
    found = named.where("field IS NOT NULL").groupBy(*PAGE, "line").agg(F.countDistinct("field").alias("n"), F.bool_or(F.col("field").isin(*core)).alias("core"))
    header = found.where("n >= 2 AND core").groupBy(*PAGE).agg(F.min("line").alias("header"))
    heads = named.join(header, PAGE).where("field IS NOT NULL AND line = header").select(*PAGE, "field", F.col("x").alias("hx"))
    below = lined.join(header, PAGE).where("line > header")
    placed = below.join(heads, PAGE).groupBy(*PAGE, "line", "tid", "text").agg(F.min_by("field", F.struct(F.abs(F.col("x") - F.col("hx")), F.col("field"))).alias("field"))
    numeric = placed.groupBy(*PAGE, "line").agg(F.count(F.when(F.col("text").rlike(r"^\d"), 1)).alias("k")).where("k >= 2")
    rows = placed.join(numeric.select(*PAGE, "line"), [*PAGE, "line"], "left_semi")
    n = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("line")) - 1
    return rows.select(*PAGE, n.alias("row"), "field", "text")


def scope(labels: DataFrame, header_bands: DataFrame) -> DataFrame:
    """Item labels are those in a band of two or more captions without an inline value; all others are the header's."""
    item = F.col("n_in_band") >= 2
    return labels.join(header_bands, [*PAGE, "tid"], "left").withColumn("scope", F.when((F.col("inline") == "") & F.coalesce(item, F.lit(False)), "item").otherwise("header"))


def invalid_spans(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """Spans without a token, out of bounds, or named twice for one cell."""
    j = spans.join(tokens.select("doc_id", "tid", F.length("text").alias("n")), ["doc_id", "tid"], "left")
    twice = F.count("*").over(Window.partitionBy("doc_id", "cell", "tid", "s", "e")) > 1
    issue = F.when(F.col("n").isNull(), "unknown_token").when((F.col("s") < 0) | (F.col("e") > F.col("n")) | (F.col("s") >= F.col("e")), "span_out_of_bounds").when(twice, "duplicate_span")
    return j.withColumn("issue", issue).where("issue IS NOT NULL").select("doc_id", "cell", "tid", "s", "e", "issue").distinct()


def span_conflicts(spans: DataFrame, shared: tuple[str, ...] = ()) -> DataFrame:
    """Cells whose spans overlap in one token: an interval join under the equality of token. Fields in ``shared`` may overlap."""
    a = spans.select("doc_id", "tid", F.col("cell").alias("a"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = spans.select("doc_id", "tid", F.col("cell").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    hit = a.join(b, ["doc_id", "tid"]).where((F.col("a") < F.col("b")) & (F.greatest("s1", "s2") < F.least("e1", "e2")))
    if shared:
        hit = hit.where(~(F.col("a").isin(*shared) & F.col("b").isin(*shared)))
    return hit.select("doc_id", "tid", "a", "b").distinct()


def fields(values: DataFrame, tokens: DataFrame, kinds: dict[str, str], low_mapping: float = 0.85, low_ocr: float = 0.70) -> DataFrame:
    """Cells from labelled values: raw text, the least confidence of value and label, and a value only when nothing is in doubt."""
    conf = tokens.select(*PAGE, "tid", "confidence")
    j = values.join(conf, [*PAGE, "tid"]).join(conf.withColumnsRenamed({"tid": "lid", "confidence": "lconf"}), [*PAGE, "lid"])
    ocr = F.least("confidence", "lconf")
    kind = F.coalesce(F.try_element_at(_vocabulary(kinds), F.col("field")), F.lit("text"))
    value = F.when(kind == "number", value_span(F.col("text"), "number")).otherwise(F.col("text"))
    score = F.round(1 - F.col("cost") / 10, 4)
    issues = F.array_compact(F.array(F.when(score < low_mapping, "low_mapping_score"), F.when(ocr < low_ocr, "low_ocr_confidence"), F.when(value.isNull(), "value_span_not_resolved")))
    return j.select("doc_id", "field", F.col("text").alias("raw_text"), F.when(F.size(issues) == 0, value).alias("value"), ocr.alias("ocr_confidence"), score.alias("mapping_score"), F.array_join(issues, ",").alias("issues"), F.when(F.size(issues) == 0, "accepted").otherwise("review").alias("status"))


def competing(cells: DataFrame) -> DataFrame:
    """Fields with two different labelled values are withdrawn; equal values stand once."""
    g = cells.groupBy("doc_id", "field").agg(F.countDistinct("value").alias("n"), F.min("value").alias("value"))
    return g.select("doc_id", "field", F.when(F.col("n") == 1, F.col("value")).alias("value"), F.when(F.col("n") > 1, "ambiguous").when(F.col("n") == 0, "missing").otherwise("accepted").alias("status"))


def materialised(cells: DataFrame, types: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every field of the document's type, present or missing; ``catalog`` (document_type, field) is a small dimension."""
    wanted = types.join(F.broadcast(catalog), "document_type")
    return wanted.join(cells, ["doc_id", "field"], "left").select("doc_id", "document_type", "field", "value", F.coalesce("status", F.lit("missing")).alias("status"), F.when(F.col("status").isNull(), "not_proposed").alias("null_reason"))


def needs_review(cells: DataFrame) -> DataFrame:
    return cells.groupBy("doc_id").agg(F.bool_or(F.col("status") == "review").alias("human_review_required"))


def quote_spans(quotes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Resolve a quote: in its hinted token if it occurs there exactly once, else in the only token that holds it, else nowhere."""
    times = lambda t, q: F.size(F.split(t, F.concat(F.lit("\\Q"), q, F.lit("\\E")), -1)) - 1
    j = quotes.join(tokens.select("doc_id", "tid", "text"), "doc_id").withColumn("n", times(F.col("text"), F.col("quote"))).where("n > 0")
    g = j.groupBy("doc_id", "quote", "hint").agg(F.max(F.when((F.col("tid") == F.col("hint")) & (F.col("n") == 1), F.col("tid"))).alias("hinted"), F.count("*").alias("k"), F.min("tid").alias("only"), F.max("n").alias("most"))
    pick = F.coalesce("hinted", F.when((F.col("k") == 1) & (F.col("most") == 1), F.col("only")))
    return quotes.join(g, ["doc_id", "quote", "hint"], "left").withColumn("tid", pick).select("doc_id", "quote", "hint", "tid")


def overlay(lexical: DataFrame, model: DataFrame) -> DataFrame:
    """Vocabulary beats the model on the same token."""
    j = lexical.select(*PAGE, "tid", F.col("field").alias("lex")).join(model.select(*PAGE, "tid", F.col("field").alias("mod")), [*PAGE, "tid"], "full")
    return j.select(*PAGE, "tid", F.coalesce("lex", "mod").alias("field"), F.when(F.col("lex").isNull(), "model").when(F.col("mod").isNull() | (F.col("mod") == F.col("lex")), "vocabulary").otherwise("vocabulary_veto").alias("origin"))


def date_beside_title(tokens: DataFrame, heads: DataFrame, captions: DataFrame) -> DataFrame:
    """A date on the baseline of the only heading, with no caption there, is the issue date."""
    t = with_units(tokens)
    h = heads.select(*PAGE, F.col("tid").alias("hid"), (F.col("y") + F.col("h") / 2).alias("hy"))
    alone = h.groupBy(*PAGE).agg(F.count("*").alias("n"), F.min("hid").alias("hid"), F.min("hy").alias("hy")).where("n = 1")
    near = t.join(alone, PAGE).where(F.abs(F.col("cy") - F.col("hy")) < F.col("unit"))
    busy = near.join(captions.select(*PAGE, "tid"), [*PAGE, "tid"], "left_semi").select(*PAGE).distinct()
    dates = near.where(value_span(F.col("text"), "date").isNotNull()).groupBy(*PAGE).agg(F.count("*").alias("n"), F.min("text").alias("text")).where("n = 1")
    return dates.join(busy, PAGE, "left_anti").select("doc_id", F.lit("issue_date").alias("field"), "text")


def context_size(tokens_needed: Column, sizes: tuple[int, int] = (8192, 16384), reserve: int = 1024) -> Column:
    """The smallest context that holds the tokens and the reserve; null is an error, never a cut."""
    return F.when(tokens_needed + reserve <= sizes[0], sizes[0]).when(tokens_needed + reserve <= sizes[1], sizes[1])


def reread_choice(first: DataFrame, second: DataFrame) -> DataFrame:
    """A doubtful line that was read again takes the second reading if that is not blank and better by 0.05."""
    j = first.join(second.select(*PAGE, "tid", F.col("text").alias("text2"), F.col("confidence").alias("conf2")), [*PAGE, "tid"], "left")
    better = (F.col("confidence") < 0.95) & (F.trim("text2") != "") & (F.col("conf2") >= F.col("confidence") + 0.05)
    take = F.coalesce(better, F.lit(False))
    return j.select(*PAGE, "tid", F.when(take, F.col("text2")).otherwise(F.col("text")).alias("text"), F.when(take, F.col("conf2")).otherwise(F.col("confidence")).alias("confidence"), take.alias("reread"))


def contract_failures(documents: DataFrame) -> DataFrame:
    """Documents that break the result contract: type, version, fields, and cells without value or status."""
    bad_cell = F.exists(F.map_values("fields"), lambda c: c["status"].isNull())
    reason = F.when(~F.coalesce(F.col("document_type").isin("commercial_invoice", "packing_list", "bill_of_lading"), F.lit(False)), "document_type").when(F.coalesce(F.col("schema_version") != "2.0", F.lit(True)), "schema_version").when(F.col("fields").isNull(), "fields").when(bad_cell, "cell")
    return documents.withColumn("reason", reason).where("reason IS NOT NULL")


def integrity_issues(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """Token ids used twice, page ids used twice, tokens of no page."""
    twice = lambda df, keys, name: df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(name).alias("issue"))
    lost = tokens.join(pages, PAGE, "left_anti").select("doc_id", F.lit("unknown_page").alias("issue"))
    return twice(tokens, ["doc_id", "tid"], "duplicate_token").unionByName(twice(pages, PAGE, "duplicate_page")).unionByName(lost).distinct()
