"""Column functions on ground-truth answers: canonical numbers, and the claims that an answer must support.

Null answers and claims count as empty; blank claims don't count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import comparison as C
from .scalars import let

# Patterns, words and numbers that define the results.
SCALES = (("billion", 1e9), ("bn", 1e9), ("million", 1e6), ("mm", 1e6), ("m", 1e6), ("thousand", 1e3), ("k", 1e3))
NUMERIC = r"(?i)^[\s$€£]*(?:-?[0-9]+(?:\.[0-9]+)?(?:\s*%|(?:\s*(?:billion|million|thousand|bn|mm|m|k))?)?|-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?(?:\s*%)?)[\s$€£]*$"
VERBS = ("is", "are", "was", "were", "has", "have", "had", "the", "and", "that")
YEAR_LABEL = r"(?i)(FY20[0-9]{2}\s+10-[KQ])"
LATEST_LABEL, PRIOR_LABEL, NO_TOPIC, NO_SECTION = "FY2025 10-K", "FY2024 10-K", "the topic in the question", "Item 7 MD&A"
ASKING = r"(?i)^(do|does|what|how|which|when|where)\s+"
SENTENCE, CHUNK, FEWEST, MOST, TOPIC = 15, 120, 2, 8, 80


def _none() -> Column:
    return F.array().cast("array<string>")


def is_number(answer: Column) -> Column:
    """Whether an answer is one number, with a currency, a scale word or a percent sign perhaps."""
    return C.trimmed(answer).rlike(NUMERIC)


def is_label(answer: Column) -> Column:
    """Whether an answer is one number or at most four words, none of them a common verb or article."""
    t = C.trimmed(answer)
    words = F.split(t, r"\s+")
    return (t != "") & (t.rlike(NUMERIC) | ((F.size(words) <= 4) & ~F.exists(words, lambda w: F.lower(w).isin(*VERBS))))


def _six_digits(x: Column) -> Column:
    """A number below a million with six significant digits and no trailing zeros."""
    a = F.abs(x)
    shown = F.when(a < 1e-4, F.format_string("%.5e", x))
    for digits, least in ((9, 1e-4), (8, 1e-3), (7, 1e-2), (6, 0.1), (5, 1.0), (4, 10.0), (3, 100.0), (2, 1e3), (1, 1e4)):
        shown = shown.when(a < least * 10, F.format_string(f"%.{digits}f", x))
    return F.regexp_replace(shown.otherwise(F.format_string("%.0f", x)), r"(\.[0-9]*?)0+(e|$)", "$1$2")


def canonical_number(answer: Column) -> Column:
    """The number of an answer as text: scaled by a final scale word unless a percentage, whole numbers and
    those of a million or more without a point; what isn't a number as it stands, trimmed."""

    def number(t: Column) -> Column:
        bare = C.trimmed(F.regexp_replace(C.trimmed(F.regexp_replace(t, r"%+$", "")), r"^[\s$€£]+", ""))

        def scaled(b: Column) -> Column:
            scale = F.coalesce(*[F.when(b.rlike(rf"(?i)\s+{w}\s*$"), F.lit(by)) for w, by in SCALES], F.lit(1.0))
            digits = F.regexp_replace(b, rf"(?i)\s+({'|'.join(w for w, _ in SCALES)})\s*$", "")
            return F.when(digits.rlike(r"^[-+]?[0-9]*\.?[0-9]+$"), digits.try_cast("double")) * F.when(t.endswith("%"), 1.0).otherwise(scale)

        return let(bare, scaled)

    def shown(x: Column) -> Column:
        whole = (F.abs(x) >= 1e6) | (x == F.floor(x))
        text = F.when(whole, F.bround(x).cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(_six_digits(x), r"\.(e|$)", "$1"))
        return F.when(x.isNull(), C.trimmed(answer)).otherwise(text)

    return let(let(C.trimmed(F.translate(F.coalesce(answer, F.lit("")), ",", "")), number), shown)


def _kept(claims: Column) -> Column:
    return F.filter(F.transform(F.coalesce(claims, _none()), C.trimmed), lambda c: c != "")


def derived_claims(answer: Column) -> Column:
    """At most eight claims of an answer: its sentences of over 15 characters if there are two, else pieces
    of 120 characters if there are two, else its two halves by words, else it and itself; none if empty."""

    def claims(t: Column) -> Column:
        sentences = F.filter(F.transform(F.split(t, r"[.;]\s+"), C.trimmed), lambda s: F.length(s) > SENTENCE)
        starts = F.sequence(F.lit(0), F.floor((F.length(t) - 1) / CHUNK))
        pieces = F.filter(F.transform(starts, lambda i: C.trimmed(F.substr(t, (i * CHUNK + 1).cast("int"), F.lit(CHUNK)))), lambda p: p != "")
        words = F.split(t, r"\s+")
        half = F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int"))
        halves = F.array(F.array_join(F.slice(words, F.lit(1), half), " "), F.array_join(F.slice(words, half + 1, F.size(words)), " "))
        own = F.when(F.size(sentences) >= FEWEST, sentences).when(F.size(pieces) >= FEWEST, pieces).when(F.size(words) >= 4, halves).otherwise(F.array(t, t))
        return F.when(t == "", _none()).otherwise(F.slice(own, 1, MOST))

    return let(C.trimmed(answer), claims)


def compared_claims(answer: Column, question: Column) -> Column:
    """Three claims of a comparison: one of each filing that the answer names (else the latest two), and the
    answer itself if it names both, else a sentence on what is compared."""
    t, pair = C.trimmed(answer), C.entities(answer)
    named = F.coalesce((pair["a"] != "") & (pair["b"] != ""), F.lit(False))
    labels = F.regexp_extract_all(t, F.lit(YEAR_LABEL), F.lit(1))
    first = F.when(named, pair["a"]).otherwise(F.coalesce(F.get(labels, F.lit(0)), F.lit(LATEST_LABEL)))
    other = F.when(named, pair["b"]).otherwise(F.coalesce(F.get(labels, F.lit(1)), F.lit(PRIOR_LABEL)))
    asked = F.regexp_replace(C.trimmed(F.regexp_replace(C.trimmed(question), r"\?$", "")), ASKING, "")
    topic = F.coalesce(F.nullif(F.left(asked, F.lit(TOPIC)), F.lit("")), F.lit(NO_TOPIC))
    section = F.coalesce(F.nullif(F.regexp_extract(t, r"(?i)(item\s*[0-9]+[a-z]?)", 1), F.lit("")), F.lit(NO_SECTION))
    one = lambda who: F.concat(who, F.lit(" discusses "), topic, F.lit(" in "), section, F.lit("."))
    cross = F.concat(F.lit("Both "), first, F.lit(" and "), other, F.lit(" compare how "), topic, F.lit(" is addressed in "), section, F.lit("."))
    return F.array(one(first), one(other), F.when(t.rlike(C.BOTH), t).otherwise(cross))


def required_claims(answer_type: Column, answer: Column, claims: Column, question: Column) -> Column:
    """The claims of an item, at most eight: none for numbers and labels; for comparisons its own, or these
    and the answer, if they cover both filings, else three made ones; for others its own if there are
    two, else those derived from the answer."""

    def made(own: Column) -> Column:
        t = C.trimmed(answer)
        more = F.when((t == "") | F.array_contains(own, t), own).otherwise(F.concat(own, F.array(t)))
        fits = lambda some: C.claim_support(some, answer)["structured"]
        compared = F.when(fits(own), own).when(fits(more), more).otherwise(compared_claims(answer, question))
        narrated = F.when((F.size(own) >= FEWEST) | (t == ""), own).otherwise(derived_claims(answer))
        out = F.when(answer_type.isin("numeric", "short_label"), _none()).when(answer_type == "comparison", compared).otherwise(narrated)
        return F.slice(out, 1, MOST)

    return let(_kept(claims), made)
