"""Typed normalisation of raw document text: Column in, struct<value, issue> out.

Nothing is guessed: an ambiguous or malformed raw value gives a null value and a named issue.
All functions but Unicode folding are JVM expressions; Unicode folding runs as an Arrow UDF and
is handed only the rows that hold non-ASCII text.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spellings of units and the code each stands for.
UNITS = {
    "kg": "kg", "kgs": "kg", "kilogram": "kg", "kilograms": "kg", "g": "g", "gram": "g", "grams": "g", "lb": "lb", "lbs": "lb", "mt": "t", "m/t": "t", "tonne": "t", "tonnes": "t",
    "pc": "pcs", "pcs": "pcs", "piece": "pcs", "pieces": "pcs", "ea": "ea", "set": "set", "sets": "set", "ctn": "ctn", "ctns": "ctn", "carton": "ctn", "cartons": "ctn",
    "pkg": "PKG", "pkgs": "PKG", "package": "PKG", "packages": "PKG", "drum": "drum", "drums": "drum", "cbm": "m3", "m3": "m3", "cft": "ft3", "cuft": "ft3", "cubic feet": "ft3", "킬로그램": "kg", "개": "pcs",
}
#: Delivery term codes, present and historical.
INCOTERMS = "EXW FCA CPT CIP DAP DPU DDP FAS FOB CFR CIF DAT DAF DES DEQ DDU".split()
#: Currency signs with one meaning. A bare dollar sign has several and is refused.
SIGNS = {"€": "EUR", "£": "GBP", "₩": "KRW"}
#: Former names of countries that kept their identity.
FORMER_NAMES = {"turkey": "TR", "republic of turkey": "TR", "swaziland": "SZ", "kingdom of swaziland": "SZ"}

STRUCT = "struct<value:string,issue:string>"


def _ok(value: Column) -> Column:
    return F.struct(value.alias("value"), F.lit(None).cast("string").alias("issue"))


def _no(issue: str) -> Column:
    return F.struct(F.lit(None).cast("string").alias("value"), F.lit(issue).alias("issue"))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()))


@F.pandas_udf(T.StringType())
def _key(s: pd.Series) -> pd.Series:
    def fold(x: str | None) -> str | None:
        if x is None:
            return None
        kept = "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c))
        return "".join(c for c in kept if c.isalnum() or c == "_")

    return s.map(fold)


_WIDE = r"[^\x00-\x7F]"


def clean(raw: Column) -> Column:
    """NFKC with white space collapsed. ASCII rows never leave the JVM."""
    ascii_form = F.trim(F.regexp_replace(raw, r"[ \t-\r\x1c-\x1f]+", " "))
    return F.when(raw.rlike(_WIDE), _nfkc(F.when(raw.rlike(_WIDE), raw))).otherwise(ascii_form)


def vocabulary_key(raw: Column) -> Column:
    """Case-folded, accents dropped, word characters alone."""
    ascii_form = F.regexp_replace(F.lower(raw), r"\W", "")
    return F.when(raw.rlike(_WIDE), _key(F.when(raw.rlike(_WIDE), raw))).otherwise(ascii_form)


def _filled(s: Column, result: Column) -> Column:
    return F.when(s.isNull() | (s == ""), _no("empty_value")).otherwise(result)


def text(s: Column) -> Column:
    """Text and parties need a letter or digit."""
    return _filled(s, F.when(s.rlike(r"[\p{L}\p{N}]"), _ok(s)).otherwise(_no("punctuation_only_value")))


def material(s: Column) -> Column:
    return _filled(s, F.when(s.rlike(r"\p{L}"), _ok(s)).otherwise(_no("ambiguous_numeric_material_or_grade")))


def incoterms(s: Column) -> Column:
    """A known code at the start; the text is kept as it came."""
    return _filled(s, F.when(s.rlike(rf"(?i)^(?:{'|'.join(INCOTERMS)})\b"), _ok(s)).otherwise(_no("unrecognized_trade_delivery_term")))


def unit(s: Column) -> Column:
    return _filled(s, _ok(F.coalesce(F.element_at(_map(UNITS), F.lower(s)), s)))


def freight_terms(s: Column) -> Column:
    code = F.upper(F.regexp_extract(s, r"(?i)^(?:freight\s+)?(prepaid|collect)$", 1))
    return _filled(s, F.when(code != "", _ok(code)).otherwise(_no("unrecognized_freight_terms")))


def country_names(spark: SparkSession) -> dict[str, str]:
    """Lower-case names and codes of countries, from the Java runtime's ISO registry; names that stand for two countries are left out."""
    locale = spark._jvm.java.util.Locale
    found: dict[str, set[str]] = {}
    for code in locale.getISOCountries():
        here = spark._jvm.java.util.Locale.Builder().setRegion(code).build()
        name = here.getDisplayCountry(locale.ENGLISH)
        names = {name, code, here.getISO3Country(), name.replace("&", "and").replace("’", "'")}
        if "," in name:
            lead, rest = name.split(",", 1)
            names |= {lead, f"{rest.strip()} {lead}"}
        for n in names:
            found.setdefault(n.strip().lower(), set()).add(code)
    for n, code in FORMER_NAMES.items():
        found.setdefault(n, set()).add(code)
    return {n: next(iter(c)) for n, c in found.items() if len(c) == 1 and n}


def currency_codes(spark: SparkSession) -> list[str]:
    """ISO codes from the Java runtime's registry."""
    return sorted(str(c.getCurrencyCode()) for c in spark._jvm.java.util.Currency.getAvailableCurrencies())


def country(s: Column, names: dict[str, str]) -> Column:
    """The text, the text without a leading article, then what follows its last comma: the first that names one country."""
    known = F.map_from_arrays(F.lit(list(names)), F.lit(list(names.values())))
    tries = [s, F.regexp_replace(s, r"(?i)^the\s+", ""), F.trim(F.element_at(F.split(s, ","), -1))]
    code = F.coalesce(*(F.try_element_at(known, F.lower(t)) for t in tries))
    return _filled(s, F.when(code.isNotNull(), _ok(code)).otherwise(_no("unrecognized_or_ambiguous_country")))


def currency(s: Column, codes: list[str]) -> Column:
    inner = F.when(s.rlike(r"^\([A-Za-z]{3}\)$"), F.substring(s, 2, 3)).otherwise(s)
    code = F.when(s.rlike(r"(?i)^US\s*\$$"), F.lit("USD")).when(F.upper(inner).isin(codes), F.upper(inner)).otherwise(F.try_element_at(_map(SIGNS), s))
    return _filled(s, F.when(code.isNotNull(), _ok(code)).otherwise(_no("ambiguous_or_unsupported_currency")))


#: Date shapes that have one reading, as (pattern, parse format after month names are shortened).
_YMD = [(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"), (r"^\d{4}년 \d{1,2}월 \d{1,2}일$", "yyyy년 M월 d일")]
_MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_SHORT = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
#: Day, month name, year in either order, with the punctuation that documents use; between hyphens after a day the month is short.
_DAY_FIRST = rf"(?i)^(\d{{1,2}})([ .]){_MONTH}\2(\d{{4}})$"
_DAY_FIRST_HYPHENS = rf"(?i)^(\d{{1,2}})-{_SHORT}-(\d{{4}})$"
_MONTH_FIRST = rf"(?i)^{_MONTH}(?:\.? (\d{{1,2}}), |\.(\d{{1,2}})\.|-(\d{{1,2}})-)(\d{{4}})$"


def _parse(s: Column, fmt: str) -> Column:
    return F.to_date(F.try_to_timestamp(s, F.lit(fmt)))


def _named(s: Column, pattern: str, days: tuple[int, ...], month: int, year: int) -> Column:
    group = lambda k: F.regexp_extract(s, pattern, k)
    parts = F.concat_ws(" ", F.lpad(F.concat(*map(group, days)), 2, "0"), F.initcap(F.substring(group(month), 1, 3)), group(year))
    return F.when(s.rlike(pattern), _parse(parts, "dd MMM yyyy"))


def _let(value: Column, then) -> Column:
    """Evaluate ``value`` once for an expression that names it often."""
    return F.element_at(F.transform(F.array(value), then), 1)


def date(s: Column, order: str | None = None) -> Column:
    """ISO date. ``order`` ('DMY' or 'MDY') settles all-digit dates; without it only those with one valid reading pass."""
    ordinal = r"(?i)\b(\d{1,2})(st|nd|rd|th)(?=\s+[A-Za-z])"
    day, suffix = F.regexp_extract(s, ordinal, 1), F.lower(F.regexp_extract(s, ordinal, 2))
    n = day.try_cast("int")
    right = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    plain = F.regexp_replace(F.regexp_replace(s, ordinal, "$1"), r",(?=\d{4}\b)", ", ")
    digits = r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})$"

    def read(p: Column) -> Column:
        a, b, y = (F.regexp_extract(p, digits, k) for k in (1, 3, 4))
        dmy, mdy = (F.when(p.rlike(digits), _parse(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")) for d, m in ((a, b), (b, a)))
        one = _let(F.array_distinct(F.array_compact(F.array(dmy, mdy))), lambda v: F.when(F.size(v) == 1, F.element_at(v, 1)))
        return F.coalesce(*(F.when(p.rlike(x), _parse(p, f)) for x, f in _YMD), _named(p, _DAY_FIRST, (1,), 3, 4), _named(p, _DAY_FIRST_HYPHENS, (1,), 2, 3), _named(p, _MONTH_FIRST, (2, 3, 4), 1, 5), {"DMY": dmy, "MDY": mdy}.get(order, one))

    result = _let(_let(plain, read), lambda d: F.when(d.isNotNull(), _ok(F.date_format(d, "yyyy-MM-dd"))).otherwise(_no("ambiguous_or_invalid_date")))
    return _filled(s, F.when((suffix != "") & (suffix != right), _no("invalid_day_ordinal")).otherwise(result))


def number(s: Column, decimal_mark: str | None = None) -> Column:
    """Fixed-point decimal text. One mark before exactly three digits is ambiguous unless ``decimal_mark`` is given."""
    without = lambda x, chars: F.translate(x, chars, "")

    def unsigned(bare: Column) -> Column:
        negative = bare.rlike(r"^\(.*\)$")
        body = F.when(negative, F.regexp_replace(bare, r"^\(|\)$", "")).otherwise(bare)
        return _let(F.struct(negative.alias("negative"), body.alias("body"), without(body, " ").alias("t")), marked)

    def marked(x: Column) -> Column:
        t = x["t"]
        commas, dots = F.length(t) - F.length(without(t, ",")), F.length(t) - F.length(without(t, "."))
        one = (commas + dots) == 1
        # Both marks: the last is the decimal mark. One mark, once: decimal. One mark, repeated: grouping.
        inferred = F.when(one | ((commas > 0) & (dots > 0)), F.regexp_extract(t, r"([.,])[^.,]*$", 1)).when(dots > 1, F.lit(",")).otherwise(F.lit("."))
        mark = F.lit(decimal_mark) if decimal_mark else inferred
        unclear = F.lit(False) if decimal_mark else one & t.rlike(r"[.,]\d{3}$")
        fields = [x[c].alias(c) for c in ("negative", "body")]
        return _let(F.struct(*fields, unclear.alias("unclear"), mark.alias("mark"), F.split(t, F.concat(F.lit("\\"), mark)).alias("parts")), judged)

    def judged(x: Column) -> Column:
        whole, n = F.element_at(x["parts"], 1), F.size(x["parts"])
        fraction = F.coalesce(F.try_element_at(x["parts"], F.lit(2)), F.lit(""))
        digits = F.regexp_replace(without(whole, ",.+"), r"^(-?)0+(?=\d)", "$1")
        value = F.concat(digits, F.when(n == 2, F.concat(F.lit("."), fraction)).otherwise(""))
        signed = F.when(~x["negative"], value).when(value.startswith("-"), F.regexp_replace(value, "^-", "")).otherwise(F.concat(F.lit("-"), value))
        return (
            F.when(~x["body"].rlike(r"^[+-]?[0-9][0-9., ]*$"), _no("invalid_number_span"))
            .when(x["body"].contains(" ") & ~x["body"].rlike(r"^[+-]?\d{1,3}(?: \d{3})+(?:[.,]\d+)?$"), _no("invalid_grouping"))
            .when(x["unclear"], _no("ambiguous_number_separator"))
            .when((n > 2) | ((n == 2) & ~fraction.rlike(r"^\d+$")), _no("invalid_number"))
            # Marks left in the whole part are grouping marks: they part complete groups of three.
            .when(whole.rlike(r"[.,]") & ~whole.rlike(r"^[+-]?\d{1,3}(?:[.,]\d{3})+$"), _no("invalid_grouping"))
            .otherwise(_ok(signed))
        )

    return _filled(s, _let(F.regexp_replace(s, r"^[$€£¥₩]\s*|\s*[$€£¥₩]$", ""), unsigned))


def normalise(raw: Column, kind: str, spark: SparkSession, order: str | None = None, decimal_mark: str | None = None) -> Column:
    """One entry for all kinds."""
    s = clean(raw)
    simple = {"text": text, "party": text, "material": material, "incoterms": incoterms, "unit": unit, "freight_terms": freight_terms}
    if kind in simple:
        return simple[kind](s)
    if kind == "country":
        return country(s, country_names(spark))
    if kind == "currency":
        return currency(s, currency_codes(spark))
    if kind == "date":
        return date(s, order)
    if kind == "number":
        return number(s, decimal_mark)
    return _no("unsupported_kind")


def display_number(value: Column) -> Column:
    """Thousands separators; fraction digits stay, trailing zeros at two places go."""
    sign, whole, rest = F.regexp_extract(value, r"^(-?)", 1), F.regexp_extract(value, r"^-?(\d+)", 1), F.regexp_extract(value, r"(\.\d+)$", 1)
    return F.concat(sign, F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", ","), F.regexp_replace(rest, r"\.?0+$", ""))


#: Fields whose corrections must be numbers.
NUMERIC_FIELDS = "amount total_amount subtotal tax quantity package_count total_packages gross_weight net_weight unit_price volume".split()


def correction_issue(field: Column, value: Column) -> Column:
    """Null when a correction may be entered, else what is wrong with it."""
    v = F.trim(value)
    real = F.to_date(F.try_to_timestamp(v, F.lit("yyyy-MM-dd")))
    return (
        F.when(v.isNull() | (v == ""), F.lit(None).cast("string"))
        .when(field.isin(NUMERIC_FIELDS) & ~v.rlike(r"^[+-]?(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?$"), "not_a_number")
        .when(field.endswith("_date") & ~v.rlike(r"^\d{4}-\d{2}-\d{2}$"), "not_iso_date")
        .when(field.endswith("_date") & real.isNull(), "no_such_date")
        .when((field == "currency") & ~F.upper(v).rlike("^[A-Z]{3}$"), "not_a_currency_code")
    )


def compact(raw: Column) -> Column:
    """All white space removed, for comparing passages."""
    return F.regexp_replace(raw, r"\s+", "")


def collapse(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"\s+", " "))


def lexical_tokens(raw: Column) -> Column:
    """Runs of a-z and digits or of Hangul, then the character pairs of the Hangul runs."""
    words = F.regexp_extract_all(F.lower(raw), F.lit("([a-z0-9]+|[\\uAC00-\\uD7A3]+)"))
    hangul = F.filter(words, lambda w: w.rlike("^[\\uAC00-\\uD7A3]{2,}$"))
    pairs = F.flatten(F.transform(hangul, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))))
    return F.concat(words, pairs)


_SYNONYMS = {"PC": "PCS", "PIECE": "PCS", "PIECES": "PCS", "KGS": "KG", "CARTON": "CTN", "CARTONS": "CTN"}


def _decimal(x: Column) -> Column:
    return x.try_cast("decimal(38,9)")


def equal_to_truth(a: Column, b: Column) -> Column:
    """Null equals null alone; numbers compare as numbers without their commas; text without case, spacing and unit spelling."""
    x, y = _decimal(F.replace(a, F.lit(","), F.lit(""))), _decimal(F.replace(b, F.lit(","), F.lit("")))
    norm = lambda s: F.coalesce(F.element_at(_map(_SYNONYMS), F.upper(collapse(s))), F.upper(collapse(s)))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(x.isNotNull() & y.isNotNull(), x == y).otherwise(norm(a) == norm(b))


def equal_for_scoring(a: Column, b: Column, kind: Column) -> Column:
    """As above by kind, case kept, commas not dropped."""
    x, y = _decimal(a), _decimal(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(kind == "number", F.coalesce(x == y, F.lit(False))).otherwise(collapse(a) == collapse(b))


def equal_held_out(a: Column, b: Column) -> Column:
    """Numbers as numbers, else without case."""
    x, y = _decimal(a), _decimal(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.lower(a) == F.lower(b))


def numbers_without_zeros(values: Column) -> Column:
    """Numeric strings in a map get one spelling: no trailing zeros, no exponent."""
    short = lambda v: F.when(v.contains("."), F.regexp_replace(v, r"\.?0+$", "")).otherwise(v)
    return F.transform_values(values, lambda _, v: F.when(v.rlike(r"^-?\d+(\.\d+)?$"), short(v)).otherwise(v))


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)
