"""Subjects of questions, what to search for them, and which source answers: lookups over small vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieve import exact_reference

#: Words that name an accounting subject, by subject.
DOMAINS = {
    "lease": ("리스", "임대차", "사용권자산", "전대리스"), "inventory": ("재고자산", "재고", "감모", "수량"), "revenue": ("수익인식", "매출", "수행의무", "거래가격"), "fx": ("외화", "환율", "환산", "기능통화"),
    "ppe": ("유형자산", "감가상각", "재평가"), "intangible": ("무형자산", "개발비", "연구비"), "impairment": ("손상", "회수가능액", "현금창출단위"),
    "financial": ("금융상품", "금융자산", "금융부채", "기대신용손실", "대손", "상각후원가", "파생상품"), "provision": ("충당부채", "우발부채", "우발자산"), "tax": ("법인세", "이연법인세", "일시적차이"),
    "employee": ("종업원급여", "퇴직급여", "확정급여"), "borrowing": ("차입원가", "적격자산"), "grant": ("정부보조금", "보조금"), "combination": ("사업결합", "영업권", "합병"),
    "consolidation": ("연결재무제표", "종속기업", "관계기업", "지분법"), "cashflow": ("현금흐름",), "equity": ("자본", "자기주식", "배당", "주식기준보상"), "presentation": ("재무제표표시", "시산표", "유동성", "중요성"),
    "policy": ("회계정책", "추정변경", "전기오류"), "subsequent": ("보고기간후", "후속사건"), "agriculture": ("생물자산", "농림어업"), "fairvalue": ("공정가치",), "amount": ("금액", "총액", "단가"), "date": ("기간귀속", "거래일", "발행일"),
    "logistics_cost": ("운임", "운송비", "보험료", "관세", "통관", "하역", "부대원가", "수입부가세"), "delivery": ("인도조건", "인도 조건", "인도일", "선적일", "검수", "미착품", "fob", "cif", "incoterms"),
    "returns": ("반품", "에누리", "리베이트", "매출할인", "매입할인"), "transport_service": ("운송용역", "운송 용역", "운송서비스", "운송 서비스", "포워딩"),
}
#: What is searched for a subject; one without an entry is searched by its first two words.
SEARCH_TERMS = {
    "logistics_cost": ("재고자산 매입원가 운송 하역 수입관세 환급 세금", "재고자산 보관원가 판매원가 제외"), "delivery": ("재화 판매 수익 통제 이전 인도", "재고자산 권리 미착품"), "returns": ("수익 반품 할인 변동대가", "재고자산 매입원가 할인 에누리"),
    "transport_service": ("용역 수익 수행의무 기간에 걸쳐 이행", "용역 제공 수익 진행기준"), "amount": ("수익 거래가격 측정", "재고자산 매입원가 할인"), "lease": ("리스이용자 리스부채 최초 측정 지급되지 않은 리스료 현재가치",),
    "tax": ("이연법인세자산 차감할 일시적차이 과세소득 발생 가능성",), "fx": ("외화 거래 최초 인식 거래일 현물환율",), "grant": ("정부보조금 인식 합리적인 확신 조건 준수",), "inventory": ("재고자산 측정 원가 순실현가능가치",),
    "provision": ("충당부채 다음 요건 모두 충족 인식", "충당부채 의무 금액 신뢰성 있게 추정"), "ppe": ("유형자산 인식 측정 감가상각 내용연수",), "intangible": ("무형자산 연구 개발 지출 인식 비용",), "impairment": ("자산손상 회수가능액 장부금액 손상차손",),
    "financial": ("금융상품 인식 분류 상각후원가 공정가치",), "employee": ("종업원급여 확정급여채무 근무원가",), "borrowing": ("차입원가 자본화 적격자산",), "combination": ("사업결합 취득법 식별가능자산 영업권",), "consolidation": ("연결재무제표 지배력 종속기업",),
    "cashflow": ("현금흐름표 영업 투자 재무활동 분류",), "policy": ("회계정책 변경 회계추정 오류 소급 전진 적용",), "subsequent": ("보고기간후 사건 수정 공시",), "fairvalue": ("공정가치 측정 시장참여자 주요시장",),
}
#: Standards that a question's words point at.
TOPIC_STANDARDS = (("재고|감모|취득원가", "1002"), (r"수익|매출\s*인식", "1115"), ("현금흐름", "1007"), ("선지급|선수취", "2122"), ("환율|외화환산", "1021"))
GENERIC = ("amount", "date")


def subjects(text: Column) -> Column:
    """Subjects that a text names, in the vocabulary's order; blanks and case do not matter."""
    compact = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))
    named = lambda words: F.lit(False) if not words else F.coalesce(*[F.when(compact.contains(w.lower()), True) for w in words], F.lit(False))
    return F.array_compact(F.array(*(F.when(named(words), F.lit(key)) for key, words in DOMAINS.items())))


def resolved(question: Column, queries: Column) -> Column:
    """Subjects to answer for: those named, if one is specific or the question points at documents; else those of the planned queries, if any."""
    explicit, planned = subjects(question), F.array_distinct(F.flatten(F.transform(queries, subjects)))
    specific = F.size(F.array_except(explicit, F.array(*map(F.lit, GENERIC)))) > 0
    anchored = F.coalesce(question.rlike("장부|송장|문서|증빙|비교"), F.lit(False))
    return F.when(specific | anchored | (F.size(planned) == 0), explicit).otherwise(planned)


def search_phrases(question: Column, queries: Column, most: int = 4) -> Column:
    """The first distinct phrases to search: the question, its planned queries, then what its subjects are searched by."""
    phrases = F.create_map(*(x for key, words in DOMAINS.items() for x in (F.lit(key), F.array(*map(F.lit, SEARCH_TERMS.get(key, (" ".join(words[:2]),)))))))
    asked = F.transform(F.filter(queries, lambda q: q != ""), lambda q: F.substr(q, F.lit(1), F.lit(300)))
    more = F.flatten(F.transform(resolved(question, queries), lambda s: F.element_at(phrases, s)))
    return F.slice(F.array_distinct(F.concat(F.array(F.substr(question, F.lit(1), F.lit(300))), asked, more)), 1, most)


def lookup_plan(questions: DataFrame, index: DataFrame) -> DataFrame:
    """How each question is looked up: qid, route, framework, standard_ids, paragraph.

    A named paragraph of a named standard is looked up exactly. Otherwise framework, standards and paragraph become filters; the official
    index answers if it is of the framework and holds one of the standards (any, if none is asked for), else the remote search does.
    ``index``: standard_id, a dimension of as many rows as there are standards.
    """
    q = F.col("question")
    number, exact_paragraph = exact_reference(q)
    framework = F.when(q.rlike(r"(?i)K\s*-?\s*IFRS"), "K-IFRS").when(q.rlike(r"(?i)K\s*-?\s*GAAP|일반기업회계기준"), "K-GAAP").otherwise(F.coalesce("framework", F.lit("K-IFRS")))
    code = F.nullif(F.regexp_extract(q, r"(?i)(?:제\s*|IFRS\s*[- ]?)(\d{4})", 1), F.lit(""))
    told = F.array_compact(F.array(*(F.when(q.rlike(p), F.lit(s)) for p, s in TOPIC_STANDARDS)))
    planned = questions.select("qid", framework.alias("framework"), (number.isNotNull() & exact_paragraph.isNotNull()).alias("exact"), number.alias("number"), F.coalesce(F.nullif(F.regexp_extract(q, r"문단\s*(\d+[A-Za-z]?)", 1), F.lit("")), exact_paragraph).alias("paragraph"), code.alias("code"), told.alias("told"))
    ids = F.when(F.col("exact"), F.array("number")).when(F.col("code").isNotNull(), F.array("code")).when(F.col("framework") == "K-IFRS", F.col("told")).otherwise(F.array().cast("array<string>"))
    planned = planned.withColumn("ids", ids)
    held = planned.select("qid", F.explode("ids").alias("standard_id")).join(F.broadcast(index.select("standard_id").distinct()), "standard_id").select("qid").distinct().withColumn("held", F.lit(True))
    official = (F.col("framework") == "K-IFRS") & ((F.size("ids") == 0) | F.coalesce("held", F.lit(False)))
    route = F.when(F.col("exact"), "exact").when(official, "official").otherwise("remote")
    return planned.join(held, "qid", "left").select("qid", route.alias("route"), "framework", F.array_join("ids", ",").alias("standard_ids"), "paragraph")


def fallback_passage(text: Column, paragraph: Column, most: int = 1800) -> Column:
    """A remote passage as it is shown: notes on related answers left out, cut to the paragraph asked for, at most ``most`` characters."""
    plain = F.regexp_replace(text, r"(?s)관련 질의회신요약.*?(?=\n\s*\d{1,3}[A-Z]?\s*\n|\z)", "")
    # Paragraph numbers stand on lines of their own; the one asked for runs to the next.
    sections = F.split(F.concat(F.lit("\n"), plain), r"\n(?=\s*(?:[A-Z]{1,3})?\d{1,3}[A-Z]?\s*\n)")
    own = F.filter(sections, lambda s: F.trim(F.split(F.ltrim(s), "\n")[0]) == paragraph)
    body = F.regexp_replace(F.get(own, F.lit(0)), r"^\s*[^\n]*\n", "")
    cut = F.when(paragraph.isNotNull() & (F.size(own) > 0), F.concat(F.lit("문단 "), paragraph, F.lit("\n"), body)).otherwise(plain)
    return F.substr(cut, F.lit(1), F.lit(most))


def context_parts(parts: DataFrame, limit: int = 14_000) -> DataFrame:
    """Which parts of a context stay: from the tail of the largest group on, then passages but the first, then history and evidence together, parts go until ``limit`` is met.

    ``parts``: context, kind ('group', 'passage', 'history', 'evidence', 'fixed'), grp, pos (from 1), size. The order in which groups shrink is known
    beforehand: the part at place p goes before every part at a smaller place, and the first of several equally large groups shrinks first.
    """
    step = F.struct(F.when(F.col("kind") == "group", 1).when(F.col("kind") == "passage", 2).when(F.col("kind").isin("history", "evidence"), 3).otherwise(4).alias("a"), F.when(F.col("kind").isin("group", "passage"), -F.col("pos")).otherwise(0).alias("b"), F.when(F.col("kind") == "group", F.col("grp")).otherwise(0).alias("c"))
    stays = (F.col("kind") == "fixed") | ((F.col("kind") == "passage") & (F.col("pos") == 1))
    rows = parts.withColumns({"_step": step, "_stays": stays, "_total": F.sum("size").over(Window.partitionBy("context"))})
    may_go = F.sum(F.when(~F.col("_stays"), F.col("size")).otherwise(0)).over(Window.partitionBy("context").orderBy("_step").rangeBetween(Window.unboundedPreceding, 0))
    own = F.sum(F.when(~F.col("_stays"), F.col("size")).otherwise(0)).over(Window.partitionBy("context", "_step"))
    return rows.withColumn("_before", may_go - own).select("context", "kind", "grp", "pos", (F.col("_stays") | (F.col("_total") - F.col("_before") <= limit)).alias("kept"))
