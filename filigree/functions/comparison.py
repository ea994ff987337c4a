"""Column functions on answers that compare two filings, and on the claims that support them.

Patterns are ASCII, a line at a time. A null answer counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let

# Patterns and words that define the results.
BOTH = r"(?i)both\s+[^\n]+\s+and\s+[^\n]+\s+(discuss|address|describe|mention|cover)"
BOTH_AND = r"(?i)both\s+[^\n]+\s+and\s+[^\n]+"
CROSS = r"(?i)\b(compare|comparison|contrast|compared|versus|vs\.?|whereas|while|similar|differ|difference|differently|shared|common|in common|relative to|emphasiz\w+)\b"
ANCHOR = r"(?i)\b(?:FY)?(20[0-9]{2})\s+10-[KQ]\b|\bFY20[0-9]{2}\b"
TEMPLATE = r"\b(?:both|and|discuss|address|describe|mention|cover|in|item|risk|factors|management|discussion|10-k|10-q|fy20[0-9]{2})\b"
PERCENT, DOLLARS = r"[0-9]+\.?[0-9]*%", r"\$[0-9,]+(?:\.[0-9]+)?"
NAMED = (
    r"(?i)both\s+([^\n]+?)\s+and\s+([^\n]+?)\s+(?:'s\s+)?(?:[0-9]{4}\s+)?10-[KQ]",
    r"(?i)both\s+([^\n]+?)\s+and\s+([^\n]+?)\s+(?:discuss|address|describe|mention|cover)",
    r"(?i)both\s+([^,]+?)\s+and\s+([^,]+?)\s+(?:emphasiz\w*|contrast(?:s|ed|ing)?|differ(?:s|ent|ently)?|compare[ds]?|frame[ds]?|highlight(?:s|ed|ing)?|whereas|while)\b",
)
ENTITY_STOP = ("inc", "corp", "corporation", "company", "ltd", "llc", "plc", "the", "and", "for")
PEERS = r"(?i)\b(companies?|filings?|issuers?|counterpart|peers?)\b"
LONG, FEWEST_CLAIMS, MOST_CLAIMS = 25, 3, 8


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _contrast(text: Column) -> Column:
    found = [F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(p), 0))) for p in (PERCENT, DOLLARS)]
    return (found[0] >= 2) | (found[1] >= 2)


def is_canonical(answer: Column) -> Column:
    """Whether an answer names two filings and says what both do, or how they compare."""
    return let(trimmed(answer), lambda t: t.rlike(BOTH) | (t.rlike(BOTH_AND) & t.rlike(CROSS)))


def _boilerplate(t: Column) -> Column:
    own = _words(F.regexp_replace(F.lower(t), TEMPLATE, " "))
    return t.rlike(BOTH) & ~t.rlike(CROSS) & (own < LONG) & ~_contrast(t)


def is_boilerplate(answer: Column) -> Column:
    """Whether an answer only says that both filings have a section: short, and nothing is compared."""
    return let(trimmed(answer), _boilerplate)


def informativeness(answer: Column) -> Column:
    """0 to 1 in tenths: 0 for empty and boilerplate answers, more for comparing, length and contrasted numbers."""

    def points(t: Column) -> Column:
        tenths = F.when(t.rlike(BOTH), 2).otherwise(4) + F.when(t.rlike(CROSS), 4).otherwise(0) + F.when(_words(t) >= LONG, 2).otherwise(0) + F.when(_contrast(t), 2).otherwise(0)
        return F.when((t == "") | _boilerplate(t), 0.0).otherwise(F.least(tenths, F.lit(10)) / 10)

    return let(trimmed(answer), points)


def entities(answer: Column) -> Column:
    """struct(a, b): the two that an answer compares; nulls where it names none."""

    def named(t: Column) -> Column:
        pair = lambda p: F.struct(*[F.regexp_replace(F.trim(F.regexp_extract(t, p, g)), "'s$", "").alias(n) for g, n in ((1, "a"), (2, "b"))])
        found = F.coalesce(*[F.when(t.rlike(p), pair(p)) for p in NAMED])
        return let(found, lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b")))

    return let(trimmed(answer), named)


def _tokens(entity: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(entity), F.lit("[a-z0-9]+"), 0))
    return F.filter(words, lambda w: ~w.isin(*ENTITY_STOP) & (F.length(w) > 2))


def _refers(low: Column, tokens: Column) -> Column:
    hits = F.size(F.filter(tokens, lambda w: low.contains(w)))
    return F.coalesce((F.size(tokens) > 0) & (hits >= F.least(F.lit(2), F.size(tokens))), F.lit(False))


def claim_support(claims: Column, answer: Column) -> Column:
    """struct(sides, n_cross, structured): how many of the two filings have a claim of their own, how many
    claims are on both, and whether three to eight claims cover both sides and the comparison. Blank
    and null claims don't count; without named entities, claims that name a filing's year do.
    What is asked of an answer is worked out once, and what is asked of a claim once a claim."""

    def seen(claim: Column, known: Column) -> Column:
        years = F.array_distinct(F.filter(F.regexp_extract_all(claim, F.lit(ANCHOR), 1), lambda y: y != ""))
        words = claim.rlike(CROSS) | (claim.rlike(r"(?i)\bboth\b") & claim.rlike(PEERS))
        refers = let(F.lower(claim), lambda low: F.struct(_refers(low, known["ta"]).alias("a"), _refers(low, known["tb"]).alias("b")))
        cross = lambda of: (known["named"] & of["a"] & of["b"]) | (F.size(years) >= 2) | words
        return let(refers, lambda of: F.struct(of["a"].alias("a"), of["b"].alias("b"), cross(of).alias("cross"), claim.rlike(ANCHOR).alias("dated")))

    def support(known: Column, marks: Column) -> Column:
        side = lambda one, other: F.exists(marks, lambda m: ~m["cross"] & m[one] & ~m[other]).cast("int")
        dated = F.least(F.lit(2), F.size(F.filter(marks, lambda m: m["dated"])))
        sides = F.when(known["named"], side("a", "b") + side("b", "a")).otherwise(dated)
        counts = F.struct(sides.alias("sides"), F.size(F.filter(marks, lambda m: m["cross"])).alias("n_cross"))
        whole = lambda c: F.size(marks).between(FEWEST_CLAIMS, MOST_CLAIMS) & (c["sides"] >= 2) & (c["n_cross"] > 0)
        return let(counts, lambda c: F.struct(c["sides"].alias("sides"), c["n_cross"].alias("n_cross"), whole(c).alias("structured")))

    named = lambda e: F.coalesce((e["a"] != "") & (e["b"] != ""), F.lit(False))
    known = let(entities(answer), lambda e: F.struct(named(e).alias("named"), _tokens(e["a"]).alias("ta"), _tokens(e["b"]).alias("tb")))
    texts = F.filter(F.transform(F.coalesce(claims, F.array().cast("array<string>")), trimmed), lambda c: c != "")
    return let(known, lambda k: let(F.transform(texts, lambda c: seen(c, k)), lambda m: support(k, m)))
