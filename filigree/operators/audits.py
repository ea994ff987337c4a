"""Checks of bindings, resolved facts, results and reviews, each a table in and a table out.

Null texts count as empty and null arrays as arrays without entries; empty tables give empty ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import written

# Words, patterns, names and limits that define the results.
YOY_CUES = ("year over year", "year-over-year", "yoy", "same quarter last year")
QOQ_CUES = ("quarter over quarter", "quarter-over-quarter", "qoq", "sequential quarter")
FORBIDDEN = {
    "tax_rate": "Statutory|Reconciliation|IncomeTaxReconciliation|OtherComprehensive|AccruedIncomeTax",
    "margin": "OtherComprehensive|SegmentOperating|FairValue|Accrued",
    "dividend_payout": "OtherComprehensive|Accrued|FairValue|Reclassification",
    "equity": "EquityOther|FairValue|Member|NoncontrollingInterestMember",
    "assets": "FairValue|OtherAssetsFairValue|AvailableForSale|Derivative",
}
RATIO_SIDES = {  # family: (numerator, denominator, neither)
    "margin": ("NetIncome(Loss)?|ProfitLoss|IncomeLossFromContinuingOperations|OperatingIncomeLoss", "RevenueFromContractWithCustomer|Revenues?|SalesRevenueNet|TotalRevenues?", "OtherComprehensive|SegmentOperating"),
    "tax_rate": ("IncomeTaxExpense|ProvisionForIncomeTax|EffectiveIncomeTax", "EarningsBeforeIncomeTax|IncomeBeforeIncomeTax|PretaxIncome|ProfitBeforeTax|IncomeLossFromContinuingOperationsBeforeIncomeTax", "Statutory|Reconciliation"),
    "dividend_payout": ("Dividends(Paid)?|DistributionsTo(Shareholders|Stockholders)", "NetIncome(Loss)?|ProfitLoss", "OtherComprehensive|Aoci"),
}
REVIEW_CLASSES = ("gt_too_strict", "gt_wrong", "gt_boilerplate", "question_ambiguous", "claims_misaligned", "acceptable_hard", "agent_failure")
PASSED_WORDS, YES_WORDS = ("passed", "pass", "yes", "y", "1", "true"), ("1", "true", "yes", "y")
NO_ANSWER = r"(?i)\b(insufficient evidence|cannot determine|not available in)\b"
WRONG_BINDING = r"(?i)(wrong (company|filing|form)|10-K.*10-Q|incorrect (entity|issuer))"
CONTRAST = r"(?i)\b(compare|comparison|contrast|compared|versus|vs\.?|whereas|while|similar|differ|difference|differently|shared|common|in common|relative to|emphasiz[a-z0-9_]+)\b"
SCALE_WORD = r"(?i)\b(billion|million|trillion|B|M|T)\b"
#: Slots in which windows of words are counted; the driver and each task hold their counts.
SLOTS = 1 << 17
#: Texts with candidates that may be broadcast, as a digest of 8 bytes each.
MAX_NAMED = 1_000_000
NUMBER = r"([0-9]+\.?[0-9]*)"
AMOUNT = r"(?i)\$[0-9.,]+ (billion|million)"


def _none() -> Column:
    return F.array().cast("array<string>")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def mixes_comparisons(question: Column) -> Column:
    """Whether a question asks for a year over year and a quarter over quarter at once."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return _any(q, YOY_CUES) & _any(q, QOQ_CUES)


def validate_binding(proposals: DataFrame, bound: DataFrame, filings: DataFrame) -> DataFrame:
    """(query_id, status, code) of proposals (query_id, issuer_id, question, summary, pinned, proposed,
    target_year, form): approved, narrowed or failed, and the first code that holds.

    pinned: accessions the caller fixed; proposed: those a planner named; bound (query_id, accession): what
    the rules found where nothing was proposed. Codes: empty_corpus, ambiguous_comparison, cli_nl_conflict,
    temporal_mismatch (pinned ones outside the asked fiscal year), invalid_proposal, missing_comparison_partner
    (narrowed to the one filing there is, if any), invalid_pairing, invalid_accession. Membership is a join
    per named accession, so that no task holds an issuer's whole list. A query_id is one proposal.
    """
    lists = {n: F.array_distinct(F.coalesce(n, _none())) for n in ("pinned", "proposed")}
    asked = proposals.withColumns(lists)
    names = [asked.select("query_id", "issuer_id", F.lit(n).alias("kind"), F.explode(n).alias("accession")) for n in lists]
    found = bound.select("query_id", "accession").join(asked.where(F.size("proposed") == 0).select("query_id", "issuer_id").hint("merge"), "query_id")
    named = names[0].unionByName(names[1]).unionByName(found.select("query_id", "issuer_id", F.lit("bound").alias("kind"), "accession").distinct())
    known = filings.select("issuer_id", "accession", F.col("form_type").alias("_form"), F.year("period_end").alias("_year")).dropDuplicates(["issuer_id", "accession"])
    rows = named.join(known.hint("merge"), ["issuer_id", "accession"], "left").join(asked.select("query_id", "target_year").hint("merge"), "query_id")
    astray = F.coalesce((F.col("_form") != "10-K") | (F.col("_year") != F.col("target_year")), F.lit(True))
    of = lambda kind, also=F.lit(True): F.count_if((F.col("kind") == kind) & also)
    unknown = F.col("_form").isNull()
    counts = rows.groupBy("query_id").agg(
        of("pinned", astray).alias("_astray"), of("proposed", unknown).alias("_unknown"), of("bound").alias("_bound"), of("bound", unknown).alias("_stray"))
    issuers = filings.select("issuer_id").distinct().withColumn("_corpus", F.lit(True))
    rows = asked.join(counts.hint("merge"), "query_id", "left").join(issuers.hint("merge"), "issuer_id", "left")
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    q = F.lower(F.coalesce("question", F.lit("")))
    comparison = F.coalesce(S.query_flags(F.col("question"))["is_comparison"], F.lit(False)) | _any(q, YOY_CUES) | _any(q, QOQ_CUES)
    pinned, proposed = F.size("pinned") > 0, F.size("proposed") > 0
    have = F.when(proposed, F.when(n("_unknown") == 0, F.size("proposed")).otherwise(0)).otherwise(n("_bound"))
    annual = F.col("target_year").isNotNull() & (F.coalesce("form", F.lit("")) == "10-K")
    blank = (F.coalesce("summary", F.lit("")) == "") & S.query_anchor(F.col("question")).isNull() & ~proposed
    code = (
        F.when(F.col("_corpus").isNull(), "empty_corpus").when(mixes_comparisons(F.col("question")), "ambiguous_comparison")
        .when(pinned & (F.size(F.array_except("proposed", "pinned")) > 0), "cli_nl_conflict")
        .when(pinned, F.when(annual & (n("_astray") > 0), "temporal_mismatch")).when(blank, "invalid_proposal")
        .when((have == 0) & ~comparison, "invalid_pairing").when(n("_stray") > 0, "invalid_accession").when(comparison & (have < 2), "missing_comparison_partner")
    )
    rows = rows.withColumn("code", code)
    narrowed = (F.col("code") == "missing_comparison_partner") & (have == 1)
    status = F.when(F.col("code").isNull(), "approved").when(narrowed, "narrowed").otherwise("failed")
    return rows.select("query_id", status.alias("status"), "code")


def macro_bindability(items: DataFrame, filings: DataFrame) -> DataFrame:
    """(item_id, detail) of items (item_id, issuer_id, question, accessions) whose expected filings can't be
    bound: missing_accessions, not_in_manifest, or the code of the binding that pins them."""
    pinned = F.array_distinct(F.coalesce("accessions", _none()))
    rows = items.select(F.col("item_id").alias("query_id"), "issuer_id", "question", F.lit("expected").alias("summary"), pinned.alias("pinned"), pinned.alias("proposed"), F.lit(None).cast("int").alias("target_year"), F.lit(None).cast("string").alias("form"))
    none = filings.select(F.lit(None).cast(rows.schema["query_id"].dataType).alias("query_id"), "accession").where(F.lit(False))
    codes = validate_binding(rows, none, filings)
    named = rows.select("query_id", "issuer_id", F.explode("pinned").alias("accession"))
    unknown = named.join(filings.select("issuer_id", "accession").distinct().hint("merge"), ["issuer_id", "accession"], "left_anti").select("query_id").distinct().withColumn("_unknown", F.lit(True))
    all_of = rows.select("query_id", F.size("pinned").alias("_n")).join(codes.hint("merge"), "query_id").join(unknown.hint("merge"), "query_id", "left")
    detail = F.when(F.col("_n") == 0, "missing_accessions").when(F.col("_unknown"), "not_in_manifest").otherwise(F.col("code"))
    return all_of.select(F.col("query_id").alias("item_id"), detail.alias("detail")).where("detail IS NOT NULL")


def forbidden(concept: Column, family: Column) -> Column:
    """Whether a concept may not answer a question of a family, whatever else fits."""
    out = F.when(F.lit(False), F.lit(False))
    for name, pattern in FORBIDDEN.items():
        out = out.when(family == name, concept.rlike(pattern))
    return out.otherwise(F.lit(False))


def ratio_side(concept: Column, family: Column) -> Column:
    """struct(numerator, denominator): which sides of a family's ratio a concept may take."""
    sides = [F.when(F.lit(False), F.lit(False)) for _ in range(2)]
    for name, (*patterns, neither) in RATIO_SIDES.items():
        for i, p in enumerate(patterns):
            sides[i] = sides[i].when(family == name, concept.rlike("(?i)" + p) & ~concept.rlike("(?i)" + neither))
    return F.struct(*[F.coalesce(s, F.lit(False)).alias(n) for s, n in zip(sides, ("numerator", "denominator"))])


def validate_resolution(rows: DataFrame, needed: int) -> DataFrame:
    """Add ``rejections`` to resolved facts (family, segment, target_year, form, facts array<struct<concept,
    period_start, period_end, is_annual, segment>>): the sorted codes that hold, none if the facts will do.

    too_few_facts; guard, forbidden, period, interim, segment of any fact; and of two facts of a ratio family
    ratio_roles, mixed_periods and, for margins, pretax_numerator and missing_revenue_role. Facts without
    sides are taken in their order.
    """
    family, target, form = F.col("family"), F.col("target_year"), F.coalesce("form", F.lit(""))
    facts = F.coalesce(F.col("facts"), F.filter(F.col("facts"), lambda _: F.lit(False)))
    any_of = lambda test: F.coalesce(F.exists("facts", lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))
    ratio = (F.size(facts) == 2) & family.isin(*RATIO_SIDES)
    first, second = F.get(facts, F.lit(0)), F.get(facts, F.lit(1))
    a, b = ratio_side(first["concept"], family), ratio_side(second["concept"], family)
    straight, crossed = a["numerator"] & b["denominator"], b["numerator"] & a["denominator"]
    numerator = F.when(~straight & crossed, second["concept"]).otherwise(first["concept"])
    denominator = F.when(~straight & crossed, first["concept"]).otherwise(second["concept"])
    role = lambda concept, name: F.coalesce(F.array_contains(S.concept_roles(concept)["roles"], name), F.lit(False))
    margin = ratio & (family == "margin")
    asked = F.lower("segment")
    interim = lambda x: (form == "10-K") & target.isNotNull() & ~x["is_annual"] & (F.year(x["period_end"]) != target)
    codes = (
        ("too_few_facts", F.coalesce(F.size(facts), F.lit(0)) < needed), ("guard", any_of(lambda x: ~S.concept_passes_guard(x["concept"], family))), ("forbidden", any_of(lambda x: forbidden(x["concept"], family))),
        ("period", any_of(lambda x: ~S.period_matches_intent(x["period_start"], x["period_end"], x["is_annual"], target, F.col("form")))), ("interim", any_of(interim)),
        ("ratio_roles", ratio & ~straight & ~crossed), ("mixed_periods", ratio & (first["period_end"] != second["period_end"])),
        ("pretax_numerator", margin & role(numerator, "pretax_income")), ("missing_revenue_role", margin & ~role(denominator, "revenue")),
        ("segment", (family == "segment_revenue") & any_of(lambda x: ~F.coalesce(F.lower(x["segment"]).contains(asked), asked.isNull()))),
    )
    return rows.withColumn("rejections", F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in codes]))))


def _first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.translate(text, ",", ""), NUMBER, 1), F.lit("")).try_cast("double")


def near_magnitude(answer: Column, truth: Column) -> Column:
    """Whether the first numbers of two texts are within a factor of twenty; false where one has none."""
    a, t = _first_number(answer), _first_number(truth)
    return F.coalesce(F.when(t == 0, a == 0).otherwise((F.abs(a / t) >= 0.05) & (F.abs(a / t) <= 20.0)), F.lit(False))


def failure_class(rows: DataFrame) -> DataFrame:
    """Add the first class that fits a result: abstention, binding_error, synthesis_template_dump,
    numeric_xbrl_miss, comparison_narrative_miss, retrieval_label_mismatch, gt_issue_suspected; else null.

    rows: answer, truth, question, rationale, path (of synthesis), binding_miss, outcome, mrr,
    retrieval_fidelity, paths (expected, array<string>), numeric and comparison (booleans).
    """
    text = {n: F.trim(F.coalesce(n, F.lit(""))) for n in ("answer", "truth", "question", "rationale", "path")}
    answer, truth = text["answer"], text["truth"]
    near, zero = near_magnitude(answer, truth), F.coalesce("outcome", F.lit(0.0)) <= 0
    found = F.coalesce("mrr", F.lit(0.0)) >= 0.5
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    number = lambda t: t.rlike(r"[0-9,]+\.?[0-9]*")
    scaled = {n: text[n].rlike(SCALE_WORD) for n in ("answer", "truth", "question")}
    anomaly = (scaled["question"] & ~scaled["truth"] & near) | (scaled["truth"] & ~scaled["answer"] & number(answer))
    tagged = F.coalesce(F.exists("paths", lambda p: F.upper(p).contains("XBRL")), F.lit(False))
    c = (
        F.when(((answer == "") | answer.rlike(NO_ANSWER)) & ~near, "abstention").when(yes("binding_miss") | text["rationale"].rlike(WRONG_BINDING), "binding_error")
        .when(answer.startswith("Based on") & F.lower(answer).contains("evidence chunk") & text["path"].isin("template", "live_llm", "") & zero, "synthesis_template_dump")
        .when((yes("numeric") | number(truth)) & found & tagged & ~near, "numeric_xbrl_miss").when(yes("comparison") & zero & ~answer.rlike(CONTRAST), "comparison_narrative_miss")
        .when(found & (F.coalesce("retrieval_fidelity", F.lit(1.0)) == 0), "retrieval_label_mismatch").when(found & zero & number(answer) & anomaly, "gt_issue_suspected")
    )
    return rows.withColumn("failure_class", c)


def review_rows(rows: DataFrame) -> DataFrame:
    """Add ``skipped`` to a reviewer's table (all strings: item_id, failure_class, corpus_spot_check, apply,
    proposed_answer, proposed_question): why a row isn't imported, null for those that are."""
    t = {n: F.trim(F.coalesce(n, F.lit(""))) for n in ("item_id", "failure_class", "corpus_spot_check", "apply", "proposed_answer", "proposed_question")}
    refused = (t["apply"] != "") & ~F.lower(t["apply"]).isin(*YES_WORDS)
    why = (
        F.when(t["item_id"] == "", "no_item").when(~t["failure_class"].isin(*REVIEW_CLASSES), "unknown_class").when(~F.lower(t["corpus_spot_check"]).isin(*PASSED_WORDS), "not_checked")
        .when(refused, "apply_refused").when((t["proposed_answer"] == "") & (t["proposed_question"] == ""), "nothing_proposed")
    )
    return rows.withColumn("skipped", why)


def best_revenue_amount(evidence: DataFrame) -> DataFrame:
    """(query_id, amount): of evidence (query_id, rank, excerpt, aligned) with a revenue amount in millions
    or billions and an aligned period, the first that names revenue from contracts, else the first."""
    e = F.coalesce("excerpt", F.lit(""))
    contract = e.contains("RevenueFromContract")
    rows = evidence.where((contract | F.lower(e).contains("revenue")) & F.coalesce("aligned", F.lit(False)) & e.rlike(AMOUNT))
    key = F.struct(F.when(contract, 0).otherwise(1), F.col("rank"), e)
    return rows.select("query_id", key.alias("_k"), F.regexp_extract(e, AMOUNT, 0).alias("amount")).groupBy("query_id").agg(F.min_by("amount", "_k").alias("amount"))


def business_segments(questions: DataFrame, evidence: DataFrame, names: tuple[str, ...] = S.SEGMENTS, least: int = 3, most: int = 4) -> DataFrame:
    """(query_id, segments): for questions on segments that compare nothing, the first ``most`` names, in the
    given order, found in the evidence (query_id, excerpt), where at least ``least`` are."""
    q = F.col("question")
    asked = questions.where(F.lower(q).contains("segment") & ~S.query_flags(q)["is_comparison"]).select("query_id")
    hits = [F.max(F.col("excerpt").contains(n)).alias(f"_{i}") for i, n in enumerate(names)]
    seen = evidence.groupBy("query_id").agg(*hits)
    found = F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(n)) for i, n in enumerate(names)]))
    return asked.join(seen.hint("merge"), "query_id").where(F.size(found) >= least).select("query_id", F.slice(found, 1, most).alias("segments"))


def _window_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted digests of the different windows of ``width`` words, given the words' digests; a shorter text is one window."""
    n = max(1, words.size - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, words.size)):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(29)))


def _per_text(texts: DataFrame, of: Callable[[np.ndarray], list], width: int, kind: str) -> DataFrame:
    """The columns of texts but ``text``, with what ``of`` makes of the set of windows of each text's words."""
    kept = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            ends, words = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            made = [of(_window_set(words[i:j], width)) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), types, strict=True)] if made else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], [*kept, *names])

    names = [f.split(" ")[0] for f in kind.split(", ")]
    types = [pa.list_(pa.int64()) if "array" in f else pa.int64() for f in kind.split(", ")]
    words = F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("_words")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*kept).schema)
    return texts.select(*kept, words).mapInArrow(run, f"{schema}, {kind}")


def _window_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many windows of all texts fall into each of ``SLOTS`` slots, by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(SLOTS, np.int64)
        for batch in batches:
            lists = batch.column(0)
            ends, words = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            sets = [_window_set(words[i:j], width) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            if sets:
                found += np.bincount((np.concatenate(sets) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slots = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(found[slots])], ["slot", "n"])

    words = texts.select(F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("words"))
    out = np.zeros(SLOTS, np.int64)
    for r in words.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def _prefixes(texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """Texts (and other columns) without the text, with n, the size of its set of windows, and ``ws``, those
    that come first in an order of all windows, rare ones first; texts at least ``threshold`` alike share one.

    Any order of the windows will do; this one goes by the number of windows in a slot, so that what many
    texts have (licences, headers) comes last, without counting each window.
    """
    counts = _window_counts(texts, width)

    def first(s: np.ndarray) -> list:
        most = s.size - math.ceil(s.size * threshold - 1e-9) + 1
        order = np.lexsort((s, counts[(s % np.uint64(SLOTS)).astype(np.int64)]))
        return [s.size, s[order[:most]].view(np.int64)]

    return _per_text(texts, first, width, "n long, ws array<bigint>")


def _texts_of(texts: DataFrame, named: DataFrame) -> DataFrame:
    """(key, text) of the texts (item_id, digest, text) that named (key, id, _digest) has.

    Few texts have candidates. The others are dropped where they are read, by a 64-bit digest, up to
    ``MAX_NAMED`` of them; beyond that all texts are moved, with the same result."""
    if named.limit(MAX_NAMED + 1).count() <= MAX_NAMED:
        texts = texts.join(named.select(F.xxhash64("id", "_digest").alias("_h")).hint("broadcast"), F.xxhash64("item_id", "digest") == F.col("_h"), "left_semi")
    return texts.join(named.hint("merge"), F.col("item_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("_digest"))).select("key", "text")


def similar_texts(classes: DataFrame, texts: DataFrame, threshold: float = 0.85, width: int = 5) -> DataFrame:
    """(a, b, similarity): pairs a < b of classes (key, id, digest, n, ws of :func:`_prefixes`) whose sets of
    ``width``-word windows have a Jaccard similarity of at least ``threshold``; exact, but for equal 64-bit
    digests of different windows. texts: item_id, digest, text of all items.

    Pairs share a window of both prefixes; what is left of either set after the first of these must be
    large enough for the threshold, and so must the number of these with all that lies behind the prefixes.
    Only such pairs are verified on whole sets. Texts shorter than a window are one window. *m* texts that
    are all alike have *m²/2* pairs; equal texts are one class.
    """
    keyed = classes.select("key", "n", F.posexplode("ws").alias("at", "w"))
    # Windows of one text only are most of them; they are dropped before the join.
    met = keyed.groupBy("w").agg(F.count("*").alias("_df")).where("_df > 1").select("w")
    keyed = written(keyed.join(met.hint("merge"), "w", "left_semi"), "shared")
    a = keyed.select("w", F.col("key").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"))
    b = keyed.select("w", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    fits = (F.col("na") >= F.col("nb") * threshold - 1e-9) & (F.col("nb") >= F.col("na") * threshold - 1e-9)
    least = (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-6
    enough = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= least
    pairs = a.join(b.hint("merge"), "w").where((F.col("a") < F.col("b")) & fits).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("_met"), F.bool_or(enough).alias("_enough"))
    rest = F.ceil(F.greatest("na", "nb") * F.lit(threshold) - 1e-9) - 1
    pairs = written(pairs.where(F.col("_enough") & (F.col("_met") + rest >= least)).select("a", "b"), "candidates")
    ids = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    named = ids.join(classes.select("key", "id", F.col("digest").alias("_digest")).hint("merge"), "key")
    sets = _per_text(_texts_of(texts, written(named, "to-verify")), lambda s: [s.view(np.int64)], width, "s array<bigint>").groupBy("key").agg(F.first("s").alias("s"))
    sets = written(sets, "windows")
    side = lambda name: sets.select(F.col("key").alias(name), F.col("s").alias(f"_{name}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size(F.array_intersect("_a", "_b")).alias("_i"), (F.size("_a") + F.size("_b")).alias("_n"))
    return both.select("a", "b", (F.col("_i") / (F.col("_n") - F.col("_i"))).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[ \t\r\n]+", " ")


def _text_pairs(items: DataFrame, threshold: float, width: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item_id, key) of all items, (key, id, digest) of their different texts, with the least item_id, and
    the pairs of :func:`similar_texts`. Texts are read where they lie; what is written has their prefixes."""
    text = normalised(F.col("question"))
    texts = items.select("item_id", F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    rows = written(_prefixes(texts, threshold, width), "items")
    classes = rows.groupBy("digest").agg(F.min("item_id").alias("id"), F.first("n").alias("n"), F.first("ws").alias("ws"))
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "texts")
    named = rows.select("item_id", "digest").join(classes.select("digest", "key").hint("merge"), "digest").select("item_id", "key")
    return named, classes.select("key", "id", "digest"), written(similar_texts(classes, texts, threshold, width), "similar")


def nearest_duplicates(items: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(item_id, match_id, similarity): for each item (item_id, question) the earlier item, by id, whose
    question is most alike and at least ``threshold``; equal questions have similarity 1, ties go to the
    least id. Equal texts are one class before anything is compared."""
    rows, classes, pairs = _text_pairs(items, threshold)
    both = pairs.select(F.col("a").alias("key"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("key"), F.col("a").alias("other"), "similarity"))
    other = classes.select(F.col("key").alias("other"), F.col("id").alias("match_id"))
    near = both.join(other.hint("merge"), "other").select("key", "match_id", "similarity").unionByName(classes.select("key", F.col("id").alias("match_id"), F.lit(1.0).alias("similarity")))
    hits = rows.join(near.hint("merge"), "key").where(F.col("match_id") < F.col("item_id"))
    best = F.max_by(F.struct("match_id", "similarity"), F.struct(F.col("similarity"), -F.col("match_id")))
    return hits.groupBy("item_id").agg(best.alias("m")).select("item_id", "m.match_id", "m.similarity")


def keep_first(items: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(item_id, kept): items (item_id, question) in order of id, each kept unless its question is at least
    ``threshold`` like that of an earlier kept one. Equal texts are one class, of which the first item counts.

    Each round settles the classes whose earlier neighbours are settled; there are as many rounds as the
    longest chain of neighbours, and the driver gets one number a round.
    """
    rows, classes, pairs = _text_pairs(items, threshold)
    order = lambda name: classes.select(F.col("key").alias(name), F.struct("id", "digest", "key").alias(f"{name}_at")).hint("merge")
    pairs = pairs.join(order("a"), "a").join(order("b"), "b")
    before, after = F.least("a_at", "b_at"), F.greatest("a_at", "b_at")
    edges = written(pairs.select(before["key"].alias("before"), after["key"].alias("key")), "neighbours")
    state = classes.select("key", F.lit(None).cast("boolean").alias("kept"))
    while True:
        earlier = edges.join(state.select(F.col("key").alias("before"), "kept").hint("merge"), "before")
        seen = earlier.groupBy("key").agg(F.max("kept").alias("_kept"), F.count_if(F.col("kept").isNull()).alias("_open"))
        settled = F.when(F.col("_kept"), False).when(F.coalesce("_open", F.lit(0)) == 0, True)
        state = written(state.join(seen.hint("merge"), "key", "left").select("key", F.coalesce("kept", settled).alias("kept")), "kept")
        if state.where("kept IS NULL").isEmpty():
            break
    verdict = classes.select("key", F.col("id").alias("_first")).join(state.hint("merge"), "key")
    return rows.join(verdict.hint("merge"), "key").select("item_id", (F.col("kept") & (F.col("item_id") == F.col("_first"))).alias("kept"))
