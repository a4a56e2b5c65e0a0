"""Passage retrieval: paragraph store, lexical and dense scores, fusion, reranking, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalise import lexical_tokens

#: BM25L parameters and the constant of reciprocal rank fusion.
K1, B, DELTA, RRF = 1.5, 0.75, 0.5, 60


def exact_reference(question: Column) -> tuple[Column, Column]:
    """Standard number (four digits, 1xxx or 2xxx) and paragraph number named in a question."""
    pattern = r"(?i)(?<!\d)([12]\d{3})(?:\s+paragraph\s+|\s+para\.?\s+|\s+)([A-Z]{0,2}\d{1,3}[A-Z]?)(?!\d)"
    number = F.regexp_extract(question, pattern, 1)
    return F.nullif(number, F.lit("")), F.nullif(F.upper(F.regexp_extract(question, pattern, 2)), F.lit(""))


def split_paragraphs(docs: DataFrame, max_chars: int = 1800) -> tuple[DataFrame, DataFrame]:
    """Numbered paragraphs in chunks, and the documents that fail: a number met twice, an empty body, or no numbered line.

    A line that starts with a number and two blanks, or is a number alone, opens a paragraph; later
    lines belong to it. The section is the last short line before the first paragraph. Lines are
    positions of one row's array, so the running count is within a document.
    """
    opener = r"^([A-Z]{0,2}\d{1,3}[A-Z]?)(?:\s{2,}(\S.*))?$"
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    opened = lines.withColumn("number", F.nullif(F.regexp_extract("line", opener, 1), F.lit(""))).withColumn("k", F.sum(F.when(F.col("number").isNotNull(), 1).otherwise(0)).over(before))
    content = F.when(F.col("number").isNotNull(), F.regexp_extract("line", opener, 2)).otherwise(F.col("line"))
    section = opened.where("k = 0 AND length(line) < 60").groupBy("doc_id").agg(F.max_by("line", "n").alias("section"))
    body = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", content.alias("c")))), lambda r: r["c"]), "\n"), F.lit(" \n\t\r"))
    paragraphs = opened.where("k > 0").groupBy("doc_id", "k").agg(F.max("number").alias("paragraph"), body.alias("body"))
    bad = paragraphs.groupBy("doc_id").agg((F.count("*") > F.countDistinct("paragraph")).alias("twice"), F.bool_or(F.col("body") == "").alias("empty"))
    failures = docs.select("doc_id").join(bad, "doc_id", "left").select(
        "doc_id", F.when(F.col("twice").isNull(), "no_unambiguous_numbered_paragraphs").when(F.col("twice"), "ambiguous_duplicate_paragraph").when(F.col("empty"), "empty_paragraph").alias("reason")
    ).where("reason IS NOT NULL")
    good = paragraphs.join(failures.select("doc_id"), "doc_id", "left_anti").join(section, "doc_id", "left")
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.length("body") - 1) / max_chars).cast("int")))
    chunks = good.select("doc_id", "paragraph", F.coalesce("section", F.lit("")).alias("section"), chunk.alias("chunk_index"), "body")
    return chunks.select("doc_id", "paragraph", "section", "chunk_index", F.substr("body", F.col("chunk_index") * max_chars + 1, F.lit(max_chars)).alias("content")), failures


def replace_documents(store: str, changed: DataFrame) -> None:
    """Replace all paragraphs of the changed documents in one commit: dynamic overwrite of their partitions."""
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(store)


def sync_plan(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Which documents are new, changed or the same, by content hash and version."""
    joined = incoming.join(stored.select("id", F.col("content_hash").alias("_h"), F.col("version").alias("_v")), "id", "left")
    same = F.col("content_hash").eqNullSafe(F.col("_h")) & F.col("version").eqNullSafe(F.col("_v"))
    return joined.withColumn("action", F.when(same, "skip").when(F.col("_h").isNull() & F.col("_v").isNull(), "index").otherwise("replace")).drop("_h", "_v")


def postings(passages: DataFrame) -> DataFrame:
    """(id, term, tf, dl): the inverted index, aggregated in the map tasks."""
    terms = passages.select("id", lexical_tokens(F.col("text")).alias("t"))
    return terms.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def bm25l(passages: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, score) for passages that hold a query term.

    Every query term gives every passage a constant, as delta is positive, so a passage's score is
    the query's constant plus what its own postings add to it; ranks equal those of the full sum.
    Postings of other terms are dropped before they are shuffled.
    """
    q = queries.select("qid", F.explode(lexical_tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    wanted = q.select("term").distinct()
    stats = passages.agg(F.count("*").alias("n"), F.avg(F.size(lexical_tokens(F.col("text")))).alias("avgdl"))  # one row
    post = postings(passages).join(wanted, "term", "left_semi")
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).select("term", "avgdl", F.log((F.col("n") + 1) / (F.col("df") + 0.5)).alias("idf"))
    weight = lambda ctd: F.col("idf") * (K1 + 1) * (ctd + DELTA) / (K1 + ctd + DELTA)
    ctd = F.col("tf") / (1 - B + B * F.col("dl") / F.col("avgdl"))
    terms = q.join(idf, "term")
    constant = terms.groupBy("qid").agg(F.sum(F.round(F.col("qtf") * weight(F.lit(0.0)), 10)).alias("c"))
    gain = terms.join(post, "term").select("qid", "id", F.round(F.col("qtf") * (weight(ctd) - weight(F.lit(0.0))), 10).alias("g"))
    return gain.groupBy("qid", "id").agg(F.sum("g").alias("g")).join(F.broadcast(constant), "qid").select("qid", "id", F.round(F.col("g") + F.col("c"), 6).alias("score"))


def dense_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, score): dot products of every vector with a stated query set, broadcast in one block."""
    dot = F.aggregate(F.zip_with("vector", "qvector", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return vectors.crossJoin(F.broadcast(queries.select("qid", F.col("vector").alias("qvector")))).select("qid", "id", F.round(dot, 6).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The first k of each query; ties by id."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", place).where(F.col("rank") <= k)


def rrf(*rankings: DataFrame, k: int = 30) -> DataFrame:
    """Reciprocal rank fusion of the first k of several rankings, first k of the result."""
    rows = None
    for r in rankings:
        part = top(r, k).select("qid", "id", (F.lit(1.0) / (RRF + F.col("rank"))).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return top(rows.groupBy("qid", "id").agg(F.round(F.sum("s"), 8).alias("score")), k)


def rerank(candidates: DataFrame, limit: int = 4) -> DataFrame:
    """Second stage: share of query tokens in body and title, and cosine. Columns: qid, id, query, title, text, cosine.

    Candidates without any query token are dropped; a repeated id counts once.
    """
    want = F.array_distinct(lexical_tokens(F.col("query")))
    share = lambda c: F.size(F.array_intersect(want, lexical_tokens(F.col(c)))) / F.greatest(F.size(want), F.lit(1))
    scored = candidates.dropDuplicates(["qid", "id"]).withColumns({"in_body": share("text"), "in_title": share("title")}).where("in_body > 0 OR in_title > 0")
    scored = scored.withColumn("score", F.round(F.col("in_body") * 0.6 + F.col("in_title") * 0.3 + F.coalesce("cosine", F.lit(0.0)) * 0.1, 6))
    return top(scored.select("qid", "id", "score"), max(1, min(5, limit)))


def metadata_filter(passages: DataFrame, exact: dict[str, str], part: dict[str, str]) -> DataFrame:
    """Exact keys equal, other keys contain; a missing value never matches. Filters come before any score."""
    for k, v in exact.items():
        passages = passages.where(F.coalesce(F.col(k) == v, F.lit(False)))
    for k, v in part.items():
        passages = passages.where(F.coalesce(F.lower(k).contains(v.lower()), F.lit(False)))
    return passages


def greedy_budget(rows: DataFrame, group: str, order: list[Column], text: str, each: int = 5000, total: int = 6500, most: int = 3) -> DataFrame:
    """In order, take passages while they fit: one too long, or that would pass the total, is skipped and the next is tried.

    A running sum would stop at the first that does not fit. Each of the ``most`` rounds finds every
    group's first passage after the last one taken that still fits, as a minimum that is reduced in
    the map tasks, so no group is gathered anywhere however large it is. ``order`` is ascending and total.
    """
    keyed = rows.select(F.col(group).alias("_g"), "id", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("_o"), F.length(text).alias("size")).where(F.col("size") <= each)
    first = lambda df: df.groupBy("_g").agg(F.min(F.struct("_o", "id", "size")).alias("b"))
    taken = first(keyed.where(F.col("size") <= total)).select("_g", F.lit(0).alias("place"), "b.id", F.col("b._o").alias("last"), F.col("b.size").alias("used"))
    out = taken
    for place in range(1, most):
        state = taken.select(F.col("_g").alias("_sg"), "last", "used")
        fits = keyed.join(state, F.col("_g").eqNullSafe(F.col("_sg"))).where((F.col("_o") > F.col("last")) & (F.col("used") + F.col("size") <= total)).select("_g", "id", "_o", "size", "used")
        best = fits.groupBy("_g", "used").agg(F.min(F.struct("_o", "id", "size")).alias("b"))
        taken = best.select("_g", F.lit(place).alias("place"), "b.id", F.col("b._o").alias("last"), (F.col("used") + F.col("b.size")).alias("used"))
        out = out.unionByName(taken)
    return out.select(F.col("_g").alias(group), "place", "id")


def multi_query(hits: DataFrame, texts: DataFrame, most_queries: int = 4, per_query: int = 10) -> DataFrame:
    """Several queries of one question: best rank of each passage, then one of those equal but for white space."""
    best = hits.where(F.col("query_no") < most_queries).where(F.col("rank") <= per_query).groupBy("question", "id").agg(F.min("rank").alias("rank"))
    keyed = best.join(texts.select("id", F.sha2(F.regexp_replace("text", r"\s+", ""), 256).alias("h")), "id")
    return keyed.groupBy("question", "h").agg(F.min(F.struct("rank", "id")).alias("b")).select("question", "b.id", "b.rank")


def accepted_verdicts(verdicts: DataFrame, passages: DataFrame, facts: DataFrame) -> DataFrame:
    """Verdicts that hold: direct, answering, nothing missing, a verbatim quote of twelve characters, and facts that are the asker's own. A candidate judged twice rejects all of its question."""
    twice = verdicts.groupBy("qid", "id").agg(F.count("*").alias("n")).where("n > 1").select("qid").distinct()
    owned = facts.groupBy("qid").agg(F.collect_set("fact_id").alias("owned"))
    rows = verdicts.join(twice, "qid", "left_anti").join(passages.select("id", "text"), "id").join(owned, "qid", "left")
    quoted = (F.length(F.trim("quote")) >= 12) & F.col("text").contains(F.col("quote"))
    own = F.size(F.array_except("fact_ids", F.coalesce("owned", F.array().cast("array<string>")))) == 0
    ok = (F.col("relation") == "direct") & F.col("answers") & (F.col("n_missing") == 0) & quoted & own
    return rows.select("qid", "id", F.coalesce(ok, F.lit(False)).alias("accepted"))


def excerpts(passages: DataFrame, limit: int = 2) -> DataFrame:
    """Sentences-ending paragraphs of 35 to 1200 characters by overlap with the query, equal texts once."""
    want = F.array_distinct(lexical_tokens(F.col("query")))
    rows = passages.where((F.length("text").between(35, 1200)) & F.trim("text").rlike(r"[.!?]$")).withColumn("score", F.size(F.array_intersect(want, lexical_tokens(F.col("text")))))
    rows = rows.groupBy("qid", "text").agg(F.max("score").alias("score"), F.min("id").alias("id"))
    return top(rows, limit).select("qid", "id", "score", "rank")


def clean_body(docs: DataFrame) -> DataFrame:
    """Drop blocks of related links (a heading line and the list lines after it) and lines that end in a date."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    heading, item = F.trim("line").startswith("Related"), (F.trim("line") == "") | F.trim("line").rlike("^[-–]")
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(heading, True).when(~item, False), ignorenulls=True).over(before)
    kept = lines.withColumn("heading", heading).withColumn("linked", F.coalesce(state, F.lit(False)))
    kept = kept.where(~F.col("heading") & ~(F.col("linked") & item) & ~F.col("line").rlike(r"\(\d{4}-\d{2}-\d{2}\)\s*$"))
    return kept.groupBy("doc_id").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda r: r["line"]), "\n"), F.lit(" \n\t\r")).alias("body"))


def follow_up_subject(turns: DataFrame, subject: str, limit: int = 4) -> DataFrame:
    """A short follow-up without a subject takes the last one of the ``limit`` turns before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-limit, -1)
    return turns.withColumn("carried", F.coalesce(F.col(subject), F.last(subject, ignorenulls=True).over(w)))


def authority_order(kind: Column) -> Column:
    """Primary sources first."""
    return F.when(kind == "standard", 0).when(kind == "qna", 1).otherwise(2)


def parent_window(hits: DataFrame, parents: DataFrame, before: int = 1200, after: int = 1600, whole: int = 200_000, cap: int = 14_000) -> DataFrame:
    """The parent's text around a hit; a stored slice that no longer matches is refused.

    Parents of up to ``whole`` characters are given whole. Of longer ones, whole paragraphs (parted by empty lines): from the
    last bound ``before`` characters ahead of the hit to the first one ``after`` characters behind it, or, where that is over ``cap``, just those that hold the hit.
    """
    j = hits.join(parents.select("doc_id", F.col("text").alias("parent")), "doc_id")
    start, n = F.col("start"), F.length("parent")
    end = start + F.length("slice")

    def opens(at: Column) -> Column:
        """Where the paragraph begins that holds position ``at``: behind the last bound that ends before it."""
        back = F.instr(F.reverse(F.substr("parent", F.lit(1), at)), "\n\n")
        return F.when(back == 0, 0).otherwise(at - back + 1)

    def closes(at: Column) -> Column:
        """Where the paragraph ends that holds position ``at``: at the first bound from there on."""
        ahead = F.instr(F.substr("parent", at + 1, n), "\n\n")
        return F.when(ahead == 0, n).otherwise(at + ahead - 1)

    wide = j.withColumns({"_l": opens(F.greatest(start - before, F.lit(0))), "_r": closes(F.least(n, end + after))})
    tight = F.col("_r") - F.col("_l") > cap
    bounded = wide.withColumns({"_from": F.when(n <= whole, 0).when(tight, opens(start)).otherwise(F.col("_l")), "_to": F.when(n <= whole, n).when(tight, closes(end)).otherwise(F.col("_r"))})
    same = F.substr("parent", start + 1, F.length("slice")) == F.col("slice")
    return bounded.where(same).select("hit_id", "doc_id", F.substr("parent", F.col("_from") + 1, F.col("_to") - F.col("_from")).alias("context"))


def fitted_sources(ranked: DataFrame, texts: DataFrame, budget: int = 12_000) -> DataFrame:
    """Of each question's distinct sources, best rank first, those that fit together in ``budget`` characters: one that does not fit is skipped and the next is tried.

    A question has forty sources at most (four queries of ten), so its list is one row of bounded size, folded in place.
    """
    rows = ranked.join(texts.select("id", F.length("text").alias("size")), "id").groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "size"))).alias("rows"))
    empty = F.struct(F.lit(0).cast("int").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def take(state: Column, r: Column) -> Column:
        fits = state["used"] + r["size"] <= budget
        return F.struct(F.when(fits, state["used"] + r["size"]).otherwise(state["used"]).cast("int").alias("used"), F.when(fits, F.concat(state["ids"], F.array(r["id"].cast("bigint")))).otherwise(state["ids"]).alias("ids"))

    return rows.select("question", F.posexplode(F.aggregate("rows", empty, take)["ids"]).alias("place", "id"))
