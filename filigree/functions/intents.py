"""Column functions on what a question asks for: periods, divestitures, hints at sections.

Null questions count as empty. Patterns are ASCII, so that every engine reads them alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import annual_requested, item_key, section_key

# Words and patterns that define the results.
QUARTER = r"\b(q[1-4]|quarter|10-q|10 q)\b"
YEAR = r"\b(20[0-9]{2})\b"
YOY_WORDS = ("year over year", "year-over-year", "yoy", "compared to last year")
QOQ_WORDS = ("quarter over quarter", "qoq")
RANGE_WORDS = ("change", "from", "to", "between")
DIVESTITURE_TERMS = ("divest", "asset sale", "proceeds from sale", "proceeds from asset", "singapore retail", "mobil argentina", "$1.1 billion", "1.1 billion", "1100000000")
HINT_RULES = (  # (words of the question, answer or truth; hints)
    (("md&a", "mda", "management's discussion", "item 7"), ("mda", "management", "discussion", "item 7", "md_and_a", "item 2")),
    (("segment", "business unit", "product line", "geographic"), ("segment", "business", "product", "geographic")),
    (("footnote", "note ", "notes to"), ("note", "footnote")),
    (("officer", "executive", "director", "ceo", "cfo"), ("executive", "officer", "director")),
)
RISK_WORDS, RISK_HINTS = ("risk factor", "item 1a", "item1a", "1a risk"), ("risk", "item 1a", "item1a", "risk_factors")
NUMERIC_WORDS, NUMERIC_HINTS = ("revenue", "sales", "net income", "earnings", "assets", "eps", "year over year", "yoy", "quarter over quarter", "qoq"), ("xbrl", "financial facts")
SALE_WORDS = ("divest", "proceeds", "asset sale")
QUARTERLY_SALE_HINTS, ANNUAL_SALE_HINTS = ("10-q", "item 2", "management", "discussion", "md_and_a"), ("item 7", "management", "discussion", "md_and_a", "mda")


def has(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text has one of the words as a part."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def period_label(label: Column) -> Column:
    """FY2025 for labels such as FY2025-Q1, 2025 and 2025-FY; others as they are, trimmed."""
    t = F.trim(label)
    named = F.regexp_extract(t, r"(?i)\bFY(20[0-9]{2})\b", 1)
    plain = F.regexp_extract(t, r"(?i)^(20[0-9]{2})(?:-FY|FY)?$", 1)
    return F.when(named != "", F.concat(F.lit("FY"), named)).when(plain != "", F.concat(F.lit("FY"), plain)).otherwise(t)


def temporal_intent(question: Column, labels: Column, anchor: Column) -> Column:
    """struct(anchor, target_year, form, comparison, labels): what periods a question is about.

    labels, anchor: what is already known, or null. A fiscal year that the question, a label or the
    anchor names makes it annual; else quarter words make it quarterly; else what was known stays.
    """
    q = F.lower(F.coalesce(question, F.lit("")))
    known = F.filter(F.transform(F.coalesce(labels, _strings()), period_label), lambda x: x != "")
    named = F.nullif(period_label(anchor), F.lit(""))
    known = F.when(F.size(known) > 0, known).when(named.isNotNull(), F.array(named)).otherwise(known)
    years = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(YEAR), 1)
    of_labels = F.filter(F.transform(known, lambda x: F.regexp_extract(x, "^FY([0-9]{4})", 1).try_cast("int")), lambda y: y.isNotNull())
    of_anchor = F.regexp_extract(named, "^FY([0-9]{4})", 1).try_cast("int")
    target = F.coalesce(of_anchor, F.get(of_labels, F.lit(0)), F.when(F.size(years) == 1, F.get(years, F.lit(0)).cast("int")))
    quarter = q.rlike(QUARTER)
    compare = F.when(has(q, YOY_WORDS), "yoy").when(has(q, QOQ_WORDS), "qoq").when((F.size(years) >= 2) & has(q, RANGE_WORDS), "yoy")
    annual = annual_requested(F.coalesce(question, F.lit(""))) | ((F.size(known) > 0) & ~quarter)
    year = F.coalesce(target, F.get(years, F.lit(0)).try_cast("int"))

    def given(anchor: Column, target: Column, form: Column, comparison: Column, labels: Column) -> Column:
        return F.struct(anchor.alias("anchor"), target.cast("int").alias("target_year"), form.alias("form"), comparison.alias("comparison"), labels.alias("labels"))

    none = F.lit(None).cast("string")
    return (
        F.when(annual, given(F.lit("latest_annual"), year, F.lit("10-K"), compare, F.when(year.isNotNull(), F.array(F.concat(F.lit("FY"), year))).otherwise(known)))
        .when(quarter, given(F.coalesce(named, F.lit("latest_quarter")), F.lit(None), F.lit("10-Q"), none, known))
        .otherwise(given(named, target, none, compare, _strings()))
    )


def divestiture_flags(question: Column, answer: Column, truth: Column) -> Column:
    """struct(is_divestiture, quarter, year, is_quarterly): whether an item is about a sale of assets, the
    fiscal quarter and year that its question cites, and whether it is about a quarter's sales."""
    q = F.coalesce(question, F.lit(""))
    about = has(F.lower(F.concat_ws(" ", q, F.coalesce(answer, F.lit("")), F.coalesce(truth, F.lit("")))), DIVESTITURE_TERMS)
    cited = r"(?i)\b(?:q([1-4])|(first|second|third|fourth)\s+quarter)\s+(?:of\s+)?(20[0-9]{2})\b"
    number, word, year = (F.regexp_extract(q, cited, i) for i in (1, 2, 3))
    of_word = F.array_position(_strings("first", "second", "third", "fourth"), F.lower(word)).cast("int")
    alone = q.rlike(r"(?i)\bq1\b")
    quarter = F.when(year != "", F.when(number != "", number.try_cast("int")).otherwise(of_word)).when(alone, 1)
    year = F.when(year != "", year.try_cast("int")).when(alone, F.nullif(F.regexp_extract(q, YEAR, 1), F.lit("")).try_cast("int"))
    quarterly = about & (quarter.isNotNull() | has(F.lower(q), ("q1", "q2", "q3", "q4", "quarter")))
    return F.struct(about.alias("is_divestiture"), quarter.alias("quarter"), year.alias("year"), quarterly.alias("is_quarterly"))


def section_hints(question: Column, answer: Column, truth: Column) -> Column:
    """Lower-case parts of section names that may answer an item, in order of the rules."""
    q = F.lower(F.coalesce(question, F.lit("")))
    every = F.concat_ws(" ", q, F.lower(F.coalesce(answer, F.lit(""))), F.lower(F.coalesce(truth, F.lit(""))))
    sale = divestiture_flags(question, answer, truth)
    sold = F.concat(F.when(sale["is_quarterly"], _strings(*QUARTERLY_SALE_HINTS)).otherwise(_strings(*ANNUAL_SALE_HINTS)), _strings("divest", "asset sale", "proceeds"))
    parts = [F.when(sale["is_divestiture"], sold).when(has(every, RISK_WORDS), _strings(*RISK_HINTS)).otherwise(_strings())]
    parts += [F.when(has(every, words), _strings(*hints)).otherwise(_strings()) for words, hints in HINT_RULES]
    parts += [F.when(~sale["is_divestiture"] & has(q, NUMERIC_WORDS) & ~has(q, SALE_WORDS), _strings(*NUMERIC_HINTS)).otherwise(_strings())]
    found = F.concat(*parts)
    default = F.when(has(q, ("compare", "comparison")), _strings("item 7", "management", "mda")).otherwise(_strings("item 7", "management"))
    return F.when(F.size(found) > 0, found).otherwise(default)


def path_score(tail: Column, hints: Column, sale: Column) -> Column:
    """Points of a section's name for hints, and for an item's :func:`divestiture_flags`."""
    t = F.lower(tail)
    out = 3 * F.size(F.filter(hints, lambda h: F.contains(t, h)))
    out = out + F.when(t.contains("xbrl") & F.arrays_overlap(hints, _strings(*NUMERIC_HINTS)), 5).otherwise(0)
    out = out + F.when(item_key(section_key(tail)).isNotNull(), 2).otherwise(0)
    sold = sale["is_divestiture"]
    rules = (  # Fixed values: points for items about sales of assets.
        (t.contains("item 1") & t.contains("business"), -25), (t.contains("xbrl"), -20), (t.contains("10-q"), 10),
        (has(t, ("management", "discussion", "item 2", "item 7")), 8), (F.coalesce(F.contains(t, sale["year"].cast("string")), F.lit(False)), 4),
        ((sale["quarter"] == 1) & has(t, ("03-31", "03/31", "mar")), 3), ((sale["quarter"] == 2) & has(t, ("06-30", "06/30", "jun")), 3),
    )
    for fits, points in rules:
        out = out + F.when(sold & F.coalesce(fits, F.lit(False)), points).otherwise(0)
    return out
