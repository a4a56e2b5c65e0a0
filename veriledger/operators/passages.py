"""Rules on single passages, captions and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def applicable(question: Column, title: Column, text: Column) -> Column:
    """Examples, transition rules and clipped local exceptions answer no general question; they pass when they are asked for."""
    asks = lambda p: question.rlike("(?i)" + p)
    example = title.rlike(r"(?i)\bexample\b") | text.rlike(r"(?:^|\n)\s*(?:Example \d|IE\d+)")
    transition = text.rlike(r"(?i)\btransition\b|date of initial application")
    clipped = text.rlike(r"^\s*\([a-z]\)")
    return ~((example & ~asks(r"\bexample")) | (transition & ~asks(r"\btransition|initial application")) | clipped)


def segments(passages: DataFrame, most: int = 6) -> DataFrame:
    """A passage cut at its numbered lines, the first ``most`` pieces; a passage without one stays whole."""
    pieces = F.split("text", r"\n(?=[A-Z]*\d+[A-Z]?\n)")
    rows = passages.select("id", F.posexplode(pieces).alias("n", "piece")).where(F.trim("piece") != "")
    number = F.nullif(F.regexp_extract("piece", r"^([A-Z]*\d+[A-Z]?)\n", 1), F.lit(""))
    body = F.trim(F.regexp_replace("piece", r"^[A-Z]*\d+[A-Z]?\n", ""))
    return rows.where(F.col("n") < most).select("id", "n", number.alias("paragraph"), body.alias("text"))


def holds_all(text: Column, phrases: list[str]) -> Column:
    """One passage has to hold every defining phrase of a rule."""
    low = F.lower(text)
    return F.forall(F.array(*map(F.lit, phrases)), lambda p: low.contains(p))


def principles(passages: DataFrame, topics: DataFrame) -> DataFrame:
    """First eligible passage of each topic: source type and framework equal, keywords in title or body. ``topics`` is a small dimension."""
    j = passages.join(F.broadcast(topics), (F.col("kind") == F.col("want_kind")) & (F.upper(F.regexp_replace("framework", r"[\s-]", "")) == F.col("want_framework")))
    hit = j.where(F.lower("title").contains(F.col("keyword")) | F.lower("text").contains(F.col("keyword")))
    return hit.groupBy("topic").agg(F.min("id").alias("id"))


def exclusions(selected: DataFrame, passages: DataFrame) -> DataFrame:
    """For recognition questions, passages of the chosen titles that state when a thing is not recognised; equal texts once."""
    near = passages.join(selected.select("title").distinct(), "title", "left_semi").where(F.col("text").rlike(r"(?i)\bshall not\b|\bis not recognised\b|\bdoes not\b"))
    return near.groupBy(F.sha2(F.regexp_replace("text", r"\s+", ""), 256).alias("h")).agg(F.min("id").alias("id")).select("id")


def fitted_context(parts: DataFrame, most: int = 14_000) -> DataFrame:
    """Keep the earliest parts of each context while their sizes fit; parts come in order of importance."""
    from pyspark.sql import Window

    w = Window.partitionBy("context").orderBy("importance", "part").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("used", F.sum("size").over(w)).where(F.col("used") <= most)


def contract_evidence(tokens: DataFrame, roles: list[str], phrases: list[str], least: int = 2) -> DataFrame:
    """Pages that show every role of a carriage contract and two of its phrases: relational division by counting."""
    low = F.lower("text")
    role = F.coalesce(*(F.when(low == r, F.lit(r)) for r in roles))
    phrase = F.coalesce(*(F.when(low.contains(p), F.lit(p)) for p in phrases))
    g = tokens.groupBy("doc_id", "page").agg(F.countDistinct(role).alias("roles"), F.countDistinct(phrase).alias("phrases"))
    return g.where((F.col("roles") == len(roles)) & (F.col("phrases") >= least)).select("doc_id", "page")


def tiled_caption(text: Column, terms: dict[str, str]) -> Column:
    """Roles of a caption that joins two or more column names, left to right; null when it does not tile.

    A fold over the words: the longest run of words so far that is a term closes a role.
    """
    known = F.create_map(*(F.lit(x) for kv in terms.items() for x in kv))
    start = F.struct(F.array().cast("array<string>").alias("roles"), F.lit("").alias("open"))

    def step(acc: Column, w: Column) -> Column:
        grown = F.concat(acc["open"], F.lower(w))
        role = F.try_element_at(known, grown)
        return F.when(role.isNotNull(), F.struct(F.array_append(acc["roles"], role).alias("roles"), F.lit("").alias("open"))).otherwise(F.struct(acc["roles"].alias("roles"), grown.alias("open")))

    done = F.aggregate(F.split(F.trim(text), r"[\s/&]+"), start, step)
    return F.when((done["open"] == "") & (F.size(F.array_distinct(done["roles"])) >= 2), F.array_join(done["roles"], ","))


def freight_column(tokens: DataFrame) -> DataFrame:
    """Terms of carriage when exactly one of the two columns holds an amount."""
    near = tokens.where("column IN ('PREPAID', 'COLLECT')").groupBy("doc_id", "column").agg(F.count(F.when(F.col("text").rlike(r"\d"), 1)).alias("n")).where("n > 0")
    return near.groupBy("doc_id").agg(F.count("*").alias("k"), F.min("column").alias("freight_terms")).where("k = 1").select("doc_id", "freight_terms")


def postfix_role(text: Column) -> Column:
    """The name in 'NAME (as carrier)'."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?i)^(.+?)\s*\(?as (?:the )?carrier\)?$", 1)), F.lit(""))


def declared_basis(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """Declared values beside 'per package' are for review: a neighbour search within the page."""
    basis = tokens.where(F.lower("text").contains("per package")).select("doc_id", "page", F.col("y").alias("by"))
    near = values.join(basis, ["doc_id", "page"]).where(F.abs(F.col("y") - F.col("by")) <= 2 * F.col("h")).select("doc_id", "page", "tid").distinct().withColumn("basis", F.lit(True))
    return values.join(near, ["doc_id", "page", "tid"], "left").withColumn("status", F.when(F.col("basis"), "review").otherwise("accepted")).drop("basis")


def instalments(text: Column) -> Column:
    """Share and event of each instalment of a payment term: '30% in advance, 70% against documents'."""
    share, event = r"(\d{1,3})\s*%\s*([^,;%]+?)(?=[,;]|$)", F.lit(2)
    return F.zip_with(F.regexp_extract_all(text, F.lit(share), F.lit(1)), F.regexp_extract_all(text, F.lit(share), event), lambda s, e: F.concat(s, F.lit("% "), F.trim(e)))


def response_schema(catalog: DataFrame) -> DataFrame:
    """Field names a model may answer with, for each document type."""
    return catalog.groupBy("document_type").agg(F.array_join(F.array_sort(F.collect_set("field")), "|").alias("enum"))


def contract_document(catalog: DataFrame) -> DataFrame:
    """The catalogue as lines of a table."""
    return catalog.select("document_type", "field", F.format_string("| %s | %s |", "field", "kind").alias("line"))
