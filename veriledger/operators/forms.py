"""Captions and values of forms beside each other: paired columns, counts, units, inline evidence, titles, totals, literals.

Token rows are doc_id, page, tid, text, x, y, w, h. Distances are multiples of the document's median
token height. Joins stay within a page, and the side that names a caption is filtered first, so what
meets is a few captions and the tokens of their page, never all tokens with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grounding import PAGE, _vocabulary, caption_key, with_units

#: Units that a value may carry.
UNITS = r"m/t|mt|kilograms?|kgs?|lbs?|tonnes?|cbm|m[³3]|pcs|pieces?|sets?|ea|ctns?|pkgs?|packages?|cartons?|boxes|box|bags?|drums?|cft"
UNIT = rf"(?i)(?<![a-z])(?:{UNITS})(?![a-z])"
NUMBER = r"(?<!\w)[-+]?\d+(?:[.,]\d+)*(?!\d)"
PACKAGES = r"packages?|pkgs?\.?|cartons?|ctns?\.?|boxes?|drums?"
CORE = ("description", "product_code", "quantity", "package_count")
PARTIES = ("shipper", "exporter", "buyer", "seller", "consignee", "notify party", "carrier")
_TERMS_TITLE = r"(?i)^\s*(?:bill of lading|commercial invoice|packing list)\s*[·•:–—/-]?\s*terms\s+(?:and|&)\s+conditions\s*$"
_HEADING = r"(?i)^\s*(?:bill of lading|commercial invoice|packing list)\s*$"


def _other(tokens: DataFrame, tag: str) -> DataFrame:
    """The same tokens under other names, for joins within a page."""
    return tokens.select(*(F.col(c).alias(f"{c}{tag}") if c not in PAGE else F.col(c) for c in tokens.columns))


def meaning(text: str = "text", vocabulary: dict[str, str] | None = None) -> Column:
    return F.try_element_at(_vocabulary(vocabulary or {}), caption_key(text))


def quantity_qualifiers(tokens: DataFrame) -> DataFrame:
    """Quantity columns told apart as ordered and shipped, in one caption or with the word below it, where the line has both."""
    t = with_units(tokens)
    whole = t.withColumn("role", F.lower(F.regexp_extract("text", r"(?i)^\s*(?:quantity|qty)\s+(ordered|shipped)\s*$", 1))).where("role <> ''").select(*PAGE, F.col("tid").alias("parent"), F.col("tid").alias("child"), "role", "cy", "unit")
    bare = t.where(F.col("text").rlike(r"(?i)^\s*(?:quantity|qty)\s*$"))
    words = _other(t.where(F.col("text").rlike(r"(?i)^\s*(?:ordered|shipped)\s*$")), "2")
    below = (F.col("y2") > F.col("y")) & (F.col("y2") - F.col("y") < F.col("unit") * 1.8) & (F.abs(F.col("cx2") - F.col("cx")) < F.col("unit"))
    under = bare.join(words, PAGE).where(below).groupBy(*PAGE, F.col("tid").alias("parent"), "cy", "unit").agg(F.count("*").alias("n"), F.first("tid2").alias("child"), F.first(F.lower(F.trim("text2"))).alias("role")).where("n = 1").drop("n")
    found = whole.unionByName(under)
    line = found.select(*PAGE, F.col("role").alias("role2"), F.col("cy").alias("cy2"))
    paired = found.join(line, PAGE).where((F.col("role2") != F.col("role")) & (F.abs(F.col("cy2") - F.col("cy")) < F.col("unit")))
    return paired.select(*PAGE, "parent", "child", "role").distinct()


def package_captions(tokens: DataFrame, vocabulary: dict[str, str]) -> DataFrame:
    """Captions of a number of packages: with goods and measure captions on their line and a count with a kind of package below."""
    t = with_units(tokens)
    start = r"(?i)^\s*(?:no\.?|number|count)\s+of\s+(?:cont(?:ainers?)?\.?|packages?|pkgs?\.?|cartons?)(?!\w)"
    caption = t.where((F.length("text") <= 60) & ~F.col("text").rlike(r"[:：\d]") & F.col("text").rlike(start) & ~F.col("text").rlike(r"(?i)\b(?:shall|must|should|declared|received|loaded)\b"))
    known = _other(t.withColumn("field", meaning("text", vocabulary)).where("field IS NOT NULL"), "2")
    cells = _other(t.where(F.col("text").rlike(rf"(?i)^\s*\d+(?:[.,]\d+)*\s*(?:{PACKAGES})\s*$")), "3")
    beside = (F.col("tid2") != F.col("tid")) & (F.abs(F.col("cy2") - F.col("cy")) < F.col("unit") * 1.2)
    peers = caption.join(known, PAGE).where(beside).groupBy(*PAGE, "tid").agg(F.max(F.col("field2").isin("marks", "description", "product_code")).alias("goods"), F.max(F.col("field2").isin("gross_weight", "net_weight", "volume")).alias("measures")).where("goods AND measures")
    below = (F.col("y3") > F.col("bottom")) & (F.col("y3") - F.col("bottom") < F.col("unit") * 8) & (F.greatest("x", "x3") < F.least("right", "right3"))
    typed = caption.join(cells, PAGE).where(below).select(*PAGE, "tid").distinct()
    return peers.select(*PAGE, "tid").join(typed, [*PAGE, "tid"])


def terms_only(tokens: DataFrame) -> DataFrame:
    """Documents that are a page of conditions: titled so, and without a heading of their own."""
    marked = tokens.groupBy("doc_id").agg(F.min(F.when(F.col("text").rlike(_TERMS_TITLE), F.col("tid"))).alias("evidence"), F.max(F.col("text").rlike(_HEADING)).alias("headed"))
    return marked.where("evidence IS NOT NULL AND NOT headed").select("doc_id", "evidence")


def repair_bands(tokens: DataFrame, vocabulary: dict[str, str]) -> DataFrame:
    """Unit captions whose column holds numbers with units while their line lacks a goods or quantity caption: tables to ask a model about."""
    t = with_units(tokens).withColumn("field", meaning("text", vocabulary))
    units = t.where("field = 'unit'")
    core = _other(t.where(F.col("field").isin(*CORE) & (F.length("text") < 80)), "2")
    cells = _other(t.where(F.col("text").rlike(NUMBER) & F.col("text").rlike(UNIT)), "3")
    labelled = units.join(core, PAGE).where(F.abs(F.col("y2") - F.col("y")) < F.col("unit") * 1.5).select(*PAGE, "tid")
    below = (F.col("y3") > F.col("bottom")) & (F.col("y3") - F.col("bottom") < F.col("unit") * 8) & (F.greatest("x", "x3") < F.least("right", "right3"))
    held = units.join(cells, PAGE).where(below).select(*PAGE, "tid").distinct()
    return held.join(labelled, [*PAGE, "tid"], "left_anti")


def inline_candidates(tokens: DataFrame) -> DataFrame:
    """Tokens that begin with a party's caption and go on with its value, and do not tell a story."""
    names = "|".join(p.replace(" ", r"\s+") for p in PARTIES)
    story = r"(?i)\b(?:liability|herein|hereof|unless|shall|phone|telephone|fax|address|reference|account|information|should|must|requests?|agrees?|undertakes?|certifies|declares)\b"
    return tokens.where((F.length("text") < 220) & F.col("text").rlike(rf"(?i)^(?:{names})\s+\S") & ~F.col("text").rlike(story))


def _count(text: Column, part: Column) -> Column:
    return F.size(F.split(text, F.concat(F.lit("\\Q"), part, F.lit("\\E")), -1)) - 1


def inline_spans(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Places of quoted captions and values in their tokens. Both must stand there word for word, the value once and behind its caption;
    a caption that stands there more often has to be the only one before the value. ``answers``: doc_id, tid, field, label, value."""
    j = candidates.select("doc_id", "tid", "text").join(answers, ["doc_id", "tid"]).where("label <> '' AND value <> ''")
    text, label = F.lower("text"), F.lower("label")
    j = j.withColumn("value_start", F.instr("text", F.col("value")) - 1).where((F.col("value_start") >= 0) & (_count(F.col("text"), F.col("value")) == 1))
    before = F.substr(text, F.lit(1), F.col("value_start"))
    j = j.where(_count(before, label) == 1).withColumn("label_start", F.instr(before, label) - 1)
    return j.select("doc_id", "tid", "field", "label_start", (F.col("label_start") + F.length("label")).alias("label_end"), "value_start", (F.col("value_start") + F.length("value")).alias("value_end"))


def title_numbers(tokens: DataFrame) -> DataFrame:
    """A document's own number: the one '# value' token right of its title, on the title's line."""
    t = with_units(tokens)
    titles = t.where(F.col("text").rlike(_HEADING) | F.col("text").rlike(_TERMS_TITLE))
    marks = _other(t.where(F.col("text").rlike(r"^\s*#\s*\S+\s*$")), "2")
    near = (F.abs(F.col("cy2") - F.col("cy")) < F.col("unit")) & (F.col("x2") - F.col("right") >= -0.5 * F.col("unit")) & (F.col("x2") - F.col("right") < 4 * F.col("unit"))
    found = titles.join(marks, PAGE).where(near).groupBy(*PAGE, F.col("tid").alias("title")).agg(F.count("*").alias("n"), F.first("text2").alias("text")).where("n = 1")
    return found.select(*PAGE, "title", F.regexp_replace("text", r"^\s*#\s*|\s+$", "").alias("value"))


def structural_labels(tokens: DataFrame, vocabulary: dict[str, str]) -> DataFrame:
    """All labels without a model: the vocabulary's, those of packages and of paired quantities, each with what told it."""
    lexical = tokens.withColumn("field", meaning("text", vocabulary)).where("field IS NOT NULL").select(*PAGE, "tid", "field", F.lit("vocabulary").alias("method"))
    packages = package_captions(tokens, vocabulary).select(*PAGE, "tid", F.lit("package_count").alias("field"), F.lit("package_caption").alias("method"))
    pairs = quantity_qualifiers(tokens).select(*PAGE, F.col("child").alias("tid"), F.concat(F.lit("quantity_"), "role").alias("field"), F.lit("paired_quantity").alias("method"))
    return lexical.unionByName(packages).unionByName(pairs)


def fragmented_headers(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """Captions parted over two lines with their value on the second: (field, first, second, value). ``terms``: field, term, a small dimension.

    Words before the first part are allowed only as a list number, or where a colon stands behind the second part and they tell no story.
    """
    split = terms.withColumn("words", F.split(F.lower("term"), " ")).select("field", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    parts = F.broadcast(split.select("field", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("tail")))
    t = with_units(tokens)
    firsts = t.join(parts, F.lower(F.rtrim("text")).endswith(F.col("head")))
    prefix = F.substr(F.rtrim("text"), F.lit(1), F.length(F.rtrim("text")) - F.length("head"))
    firsts = firsts.withColumn("prefix", prefix).where(~F.col("prefix").rlike(r"\w$")).withColumn("prefix", F.trim("prefix"))
    nxt = _other(t, "2")
    below = (F.col("y2") > F.col("y")) & (F.col("y2") - F.col("bottom") >= 0) & (F.col("y2") - F.col("bottom") < F.col("unit")) & (F.abs(F.col("x2") - F.col("x")) < F.col("unit"))
    nearest = firsts.select(*PAGE, "tid", "y", "bottom", "x", "unit").distinct().join(nxt, PAGE).where(below).groupBy(*PAGE, "tid").agg(F.min(F.struct("y2", "tid2", "text2")).alias("n"))
    j = firsts.join(nearest, [*PAGE, "tid"]).withColumns({"second": F.col("n.tid2"), "rest": F.ltrim("n.text2")})
    j = j.where(F.lower("rest").startswith(F.col("tail"))).withColumn("rest", F.substr("rest", F.length("tail") + 1)).where(~F.col("rest").rlike(r"^\w"))
    story, colon = F.col("prefix").rlike(r"(?i)\b(?:matches?|matching|shown|appears?|refers?|see|please|will|must|should)\b"), F.col("rest").rlike(r"^\s*[:：]")
    j = j.where((F.col("prefix") == "") | F.col("prefix").rlike(r"^\d{1,3}[.)]$") | (~story & colon)).withColumn("value", F.trim(F.regexp_replace("rest", r"^[\s:：]+", "")))
    return j.where(F.col("value").rlike(r"[\p{L}\p{N}]") & ~F.col("value").rlike("[:：]")).select(*PAGE, "field", F.col("tid").alias("first"), "second", "value")


def footer_volumes(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """Volumes that go on with a document's total weight below its goods. ``rows``: doc_id, page, tid of goods tokens. Two of them are ambiguous."""
    t = with_units(tokens)
    lowest = t.join(rows.select(*PAGE, "tid"), [*PAGE, "tid"], "left_semi").groupBy(*PAGE).agg(F.max("bottom").alias("lowest"))
    caption = r"(?i)^(\s*total\s+(?:gross|net)\s+weight\s*[:：]\s*)(\d.*)$"
    totals = t.where(F.col("text").rlike(caption)).withColumn("value_x", F.col("x") + F.col("w") * F.length(F.regexp_extract("text", caption, 1)) / F.greatest(F.length("text"), F.lit(1)))
    totals = totals.join(lowest, PAGE).where(F.col("y") > F.col("lowest") + F.col("unit"))
    measure = r"(?i)^\s*([-+]?\d+(?:[.,]\d+)*)\s*(CBM|m[³3]|CFT|CUFT)\s*$"
    volumes = _other(t.where(F.col("text").rlike(measure)), "2")
    near = (F.col("y2") - F.col("bottom") >= 0) & (F.col("y2") - F.col("bottom") < F.col("unit") * 3) & (F.abs(F.col("x2") - F.col("value_x")) <= F.col("unit") * 3)
    found = totals.join(volumes, PAGE).where(near).groupBy(*PAGE, "tid2", "text2").agg(F.min("tid").alias("total"))
    agg = found.groupBy(*PAGE).agg(F.count("*").alias("n"), F.min(F.struct("tid2", "text2")).alias("v"), F.min("total").alias("total"))
    return agg.select(*PAGE, "total", F.regexp_extract("v.text2", measure, 1).alias("volume"), F.upper(F.regexp_extract("v.text2", measure, 2)).alias("volume_unit"), (F.col("n") > 1).alias("ambiguous"))


def shared_units(labels: DataFrame) -> DataFrame:
    """The unit that a caption's tokens spell together, in reading order and without blanks, if it is one. ``labels``: doc_id, label, tid, text, x."""
    spelled = labels.groupBy("doc_id", "label").agg(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "tid", "text"))), lambda r: r["text"]), ""), r"\s", "").alias("s"))
    units = F.regexp_extract_all("s", F.lit(f"({UNIT})"), F.lit(1))
    return spelled.withColumn("units", units).where(F.size("units") == 1).select("doc_id", "label", F.lower(F.element_at("units", 1)).alias("unit"))


def is_voyage(text: Column) -> Column:
    """A voyage designator."""
    return text.rlike(r"(?i)^\s*(?:v\.?|voy(?:age)?\.?\s*(?:no\.?)?)\s*[-.:]?\s*\d[\w/-]*\s*$")


def explained_measure(text: Column) -> Column:
    """The measure printed before a packing calculation in the same unit, else null."""
    pattern = r"(?i)^\s*([-+]?\d+(?:[.,]\d+)*\s*([a-z³3/]+))\s*\(\s*\d+\s+(?:cartons?|ctns?|packages?|pkgs?|bags?|boxes)\s*[x×*]\s*\d+(?:[.,]\d+)*\s*([a-z³3/]+)(?:\s+each)?\s*\)\s*$"
    kind = lambda k: F.regexp_replace(F.lower(F.regexp_extract(text, pattern, k)), r"^(kg|lb)s$", "$1")
    return F.when(text.rlike(pattern) & (kind(2) == kind(3)) & kind(2).isin("kg", "g", "lb", "t", "m3", "m³", "cbm", "cft"), F.regexp_extract(text, pattern, 1))


def date_prefix(text: Column) -> Column:
    """A valid date at the start of a text that goes on neither as a range nor with a second date, else null."""
    pattern = r"^\s*(\d{4}-\d{1,2}-\d{1,2})\s+(\S.*)$"
    rest = F.regexp_extract(text, pattern, 2)
    day = F.regexp_extract(text, pattern, 1)
    good = F.try_to_timestamp(day, F.lit("yyyy-M-d")).isNotNull()
    return F.when(text.rlike(pattern) & good & ~rest.rlike(r"(?i)^(?:(?:to|through|until|and)\b|[-–—/])") & ~rest.rlike(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"), day)


#: Terms of delivery, and the fields that name a place.
DELIVERY = "EXW|FCA|FAS|FOB|CFR|CIF|CPT|CIP|DAP|DPU|DAT|DDP|DAF|DES|DEQ|DDU"
PLACES = ("place_of_receipt", "place_of_delivery", "port_of_loading", "port_of_discharge", "shipping_origin", "issue_place")


def selections(cells: DataFrame) -> DataFrame:
    """The value that a caption's cells make together: text in reading order, wrapped decimals and identifiers joined, or the reason why it is withheld.

    ``cells``: doc_id, field, kind, label, tid, text, x, cy, unit. A caption's cells are the few tokens that were found for it.
    """
    keys = ["doc_id", "field", "kind", "label"]
    w = Window.partitionBy(*keys).orderBy("cy", "x", "tid")
    opens = F.coalesce(F.col("cy") - F.lag("cy").over(w) >= F.col("unit") * 0.65, F.lit(False))
    lined = cells.withColumn("_opens", opens.cast("int")).withColumn("line", F.sum("_opens").over(w))
    place = F.when(F.col("kind").isin("text", "party"), F.struct("line", "x", "tid")).otherwise(F.struct(F.lit(0).cast("bigint").alias("line"), F.col("tid").cast("double").alias("x"), "tid"))
    g = lined.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "text"))), lambda r: r["text"]).alias("parts"))
    raw, n, field, kind = F.array_join("parts", " "), F.size("parts"), F.col("field"), F.col("kind")
    found = lambda p: F.size(F.flatten(F.transform("parts", lambda t: F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1)))))
    g = g.withColumns({"text": raw, "values": F.when(kind == "number", found(NUMBER)).when(kind == "date", found(r"\d{4}-\d{1,2}-\d{1,2}")).when(kind == "unit", found(UNIT)).otherwise(F.size(F.filter("parts", lambda t: F.trim(t) != "")))})
    digits = F.length(F.regexp_replace("text", r"\D", ""))
    decimal = (kind == "number") & (n == 2) & F.col("parts")[0].rlike(r"^\s*[+-]?\d+[.,]\s*$") & F.coalesce(F.get("parts", F.lit(1)), F.lit("")).rlike(r"^\s*\d+\s*$")
    identifier = (field == "hs_code") & (n > 1) & F.forall("parts", lambda t: t.rlike(r"^\s*[\d.]+\s*$")) & digits.between(6, 10)
    is_place, text = field.isin(*PLACES), F.col("text")
    measure_known = F.col("label").rlike(r"(?i)^\s*(?:gross|net)\s+weight\s*$|^\s*volume\s*$") | F.col("label").rlike(UNIT) | text.rlike(UNIT)
    reasons = (
        F.when(F.col("values") == 0, "value_type_not_resolved")
        .when(field.isin("gross_weight", "net_weight", "volume") & (F.col("values") == 1) & ~measure_known, "unverified_measure_label_without_unit")
        .when(kind.isin("number", "unit", "date") & (F.col("values") > 1), "multiple_values_in_scalar_cell")
        .when(field.isin("document_reference", "buyer_reference", "forwarding_agent_number") & text.rlike(r"(?i)^\s*[^:：]{1,60}\b(?:ref(?:erence)?s?|no\.?|number)\s*[:：]\s*\S"), "nested_reference_caption_is_not_reference_value")
        .when(field.isin("description", "product_code") & text.rlike(r"(?i)^\s*(?:(?:according to\s+)?(?:contract|agreement|loan|project)\s*(?:no\.?|number|name)|name of (?:project|contract)|dated?)\s*[:：]?\s*$"), "document_metadata_is_not_goods_description")
        .when((field == "mode_of_transport") & text.rlike(rf"(?i)^\s*(?:{DELIVERY})(?:\s+.+)?\s*$"), "trade_term_is_not_transport_mode")
        .when((field == "mode_of_transport") & F.col("label").rlike(r"(?i)^\s*delivery\s*$"), "delivery_caption_does_not_establish_transport_mode")
        .when(is_place & text.rlike(r"^\s*[+−-]?\d[\d., ]*\s*$"), "numeric_value_is_not_named_location")
        .when(is_place & text.rlike(r"^\s*[$€£¥₩]\s*\d[\d., ]*\s*$"), "monetary_amount_is_not_named_location")
        .when(is_place & text.rlike(r"(?i)^\s*(?:(?:ocean|sea|air|road|inland)\s+)?freight(?:\s+charges?)?\s*$"), "freight_charge_category_is_not_named_location")
        .when(is_place & text.rlike(r"(?i)^\s*(?:freight\s+)?(?:prepaid|collect)\s*$"), "freight_payment_option_is_not_named_location")
        .when(is_place & text.rlike(rf"(?i)^\s*(?:{DELIVERY})\s*$"), "trade_term_is_not_named_location")
        .when(is_place & text.rlike(r"(?i)^\s*(?:CY|CFS|DOOR|SD)\s*[/–-]\s*(?:CY|CFS|DOOR|SD)\s*$"), "service_mode_is_not_named_location")
    )
    method = F.when(decimal, "wrapped_decimal").when(identifier, "wrapped_identifier").otherwise("layout")
    joined = F.when(decimal | identifier, F.regexp_replace("text", r"\s", "")).otherwise(text)
    return g.select("doc_id", "field", method.alias("method"), joined.alias("text"), F.when(~decimal & ~identifier, reasons).alias("reason"))
