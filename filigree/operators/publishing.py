"""Publishing of benchmark items: what keeps an item back, how a draft scores, its gates, overrides of items.

Items have item_id (unique), issuer_id, profile, tag, question, answer, rubric, answer_type, claims, accessions,
paths and periods (arrays, in order), is_comparison and multi. Null texts and arrays count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import claims as K
from ..functions import comparison as C
from ..functions import intents as I
from ..functions import scalars as S
from ..functions.lineage import written
from .audits import macro_bindability
from .repair import item_errors, resolved_paths

# Words of tags and the form of ids that older bundles have used.
COMPARISON_TAGS, REFERENCE_TAG = ("comparison", "multi-hop", "cross-filing", "agentic-multi"), "reference"
OLD_PREFIX, OLD_ID = "live-", r"^[a-z]+-[0-9]{4}$"
BORDERLINE, FEWEST_SEVERAL = 0.5, 40
LISTS = ("claims", "accessions", "paths", "periods")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _tag(*words: str) -> Column:
    return I.has(F.lower(_text("tag")), words)


def _compared() -> Column:
    return _tag(*COMPARISON_TAGS) | F.coalesce(F.col("answer_type") == "comparison", F.lit(False))


def _with_lists(items: DataFrame) -> DataFrame:
    return items.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in LISTS})


def _rules(newer: bool) -> list[tuple[Column, str, Column]]:
    """(condition, reason, detail) in order; newer bundles ask more of an item than older ones."""
    t, kind = C.trimmed(F.col("answer")), F.col("answer_type")
    claims = F.filter(F.transform("claims", C.trimmed), lambda c: c != "")
    n, bound, old = F.size(claims), F.size(F.array_distinct("accessions")), F.lower("item_id")
    tagged, compared = _tag(*COMPARISON_TAGS), _compared()
    least = F.when(kind == "comparison", C.FEWEST_CLAIMS).otherwise(K.FEWEST)
    said = F.lit("comparison")
    of_newer = [
        (t == "", "missing_answer_gt", F.lit("answer")),
        (old.startswith(OLD_PREFIX) | old.rlike(OLD_ID), "v1_item_reuse", F.lit("item_id")),
        (kind.isin("narrative", "comparison") & ~n.between(least, F.lit(K.MOST)), "required_claims", F.concat(n.cast("string"), F.lit(" claims"))),
        (compared & ~kind.eqNullSafe(F.lit("comparison")), "invalid_answer_type", F.lit("answer_type")),
        (compared & (t == ""), "missing_answer_gt", said),
        (compared & (t != "") & ~C.is_canonical(t), "invalid_answer_type", said),
        (compared & (t != "") & C.is_boilerplate(t), "boilerplate_comparison_answer", said),
        (compared & (t != "") & (bound < 2), "comparison_bindings", said),
        (compared & (t != "") & ~C.claim_support(F.col("claims"), t)["structured"], "required_claims", said),
    ]
    of_older = [
        ((_text("answer") != "") & ~K.is_label(t) & (F.size("claims") == 0), "required_claims", F.lit("narrative")),
        (kind.isNull() & (tagged | _tag(REFERENCE_TAG)) & (C.trimmed(F.col("rubric")) == ""), "rubric_route", F.lit("rubric")),
    ]
    years = F.coalesce(S.question_year_mismatch(_text("question"), F.col("periods")), F.lit(False))
    answered = _text("answer") != ""
    lost = F.col("_paths") & ((F.size("_unknown") > 0) | (F.size("_canonical") == 0))
    every = [
        (tagged & (bound < 2), "comparison_bindings", F.concat(bound.cast("string"), F.lit(" accessions"))),
        (_tag(REFERENCE_TAG) & F.col("_corpus") & (F.size("_outside") > 0), "reference_corpus", F.array_join("_outside", ", ")),
    ]
    last = [
        (answered & years, "question_binding_year_mismatch", F.array_join("periods", ", ")),
        (answered & (F.size("paths") == 0), "missing_section_paths", F.lit("paths")),
        (answered & (F.size("paths") > 0) & lost, "section_unreachable", F.array_join(F.when(F.size("_unknown") > 0, F.col("_unknown")).otherwise(F.col("paths")), ", ")),
    ]
    binding = [(F.col("_macro").isNotNull(), "macro_bindability", F.col("_macro"))]
    return of_newer + every + last + binding if newer else every + of_older + last


def _once(index: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index and snapshot as written tables: paths are resolved by several joins with each."""
    return written(index.select("accession", "path"), "index"), written(snapshot.select("accession").distinct(), "snapshot")


def blocked_items(items: DataFrame, index: DataFrame, snapshot: DataFrame, filings: DataFrame, newer: bool = True) -> DataFrame:
    """(item_id, rule, reason, detail): a row for each rule that keeps an item from being published.

    index: accession, path. snapshot: accession. filings: issuer_id, accession, ... as
    :func:`audits.macro_bindability` takes them. rule is the place of the rule, so that an item's first
    reason is that of its least rule. An empty index judges no paths, an empty snapshot no
    references. What lies outside an item (accessions, paths, bindings) comes by joins on few keys and
    meets the item as one row, so that all rules are one projection. Each of these answers is written,
    which keeps the plans small and is what a lost executor needs.
    """
    rows = written(_with_lists(items), "drafts")
    index, snapshot = _once(index, snapshot)
    some = index.agg((F.count("*") > 0).alias("_paths")).join(F.broadcast(snapshot.agg((F.count("*") > 0).alias("_corpus"))))  # one row each
    named = rows.where(_tag(REFERENCE_TAG)).select("item_id", F.explode(F.array_distinct("accessions")).alias("accession"))
    outside = named.join(snapshot.hint("merge"), "accession", "left_anti")
    outside = outside.groupBy("item_id").agg(F.array_sort(F.collect_list("accession")).alias("_outside"))
    paths = written(resolved_paths(rows, "paths", index, snapshot), "draft-paths").select("item_id", F.col("canonical").alias("_canonical"), F.col("unknown").alias("_unknown"))
    rows = rows.join(outside.hint("merge"), "item_id", "left").join(paths.hint("merge"), "item_id", "left")
    if newer:
        macro = written(macro_bindability(rows, filings), "unbindable").select("item_id", F.col("detail").alias("_macro"))
        rows = rows.join(macro.hint("merge"), "item_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("_outside", "_canonical", "_unknown")}).join(F.broadcast(some))
    hits = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(i).alias("rule"), F.lit(reason).alias("reason"), detail.alias("detail"))) for i, (test, reason, detail) in enumerate(_rules(newer))]
    return rows.select("item_id", F.explode(F.array_compact(F.array(*hits))).alias("_b")).select("item_id", "_b.*")


def feasibility_summary(items: DataFrame, blocked: DataFrame) -> DataFrame:
    """One row: item_count, multi_filing_count, answer_gt_coverage (0 without items), blocked_count, counts of
    year mismatches, unreachable answers and unbindable items, and the first blocked item with its reason."""
    several = F.coalesce("multi", F.lit(False)) | _tag(*COMPARISON_TAGS)
    share = F.coalesce(F.count_if(C.trimmed(F.col("answer")) != "") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    of_items = items.agg(F.count("*").alias("item_count"), F.count_if(several).alias("multi_filing_count"), share.alias("answer_gt_coverage"))
    n = lambda *reasons: F.count_if(F.col("reason").isin(*reasons))
    of_blocked = blocked.agg(
        F.count("*").alias("blocked_count"), n("question_binding_year_mismatch").alias("year_mismatch_count"), n("missing_section_paths", "section_unreachable").alias("unreachable_answer_gt_count"),
        n("macro_bindability").alias("macro_bindability_failures"), F.min(F.struct("item_id", "rule", "reason")).alias("_f"),
    )
    both = of_items.join(F.broadcast(of_blocked))  # one row each
    return both.withColumns({"first_item": F.col("_f.item_id"), "first_reason": F.col("_f.reason")}).drop("_f")


def blocked_reasons(blocked: DataFrame) -> DataFrame:
    """(reason, n, n_items, example): how often a reason holds, for how many items, and the least of them."""
    by = blocked.groupBy("reason", "item_id").agg(F.count("*").alias("_n"))
    return by.groupBy("reason").agg(F.sum("_n").alias("n"), F.count("*").alias("n_items"), F.min("item_id").alias("example"))


def scorability(items: DataFrame) -> DataFrame:
    """Per answer type ("unknown" for none): items, those with an answer, with a rubric only, and comparisons
    whose answer is boilerplate or says little."""
    t = C.trimmed(F.col("answer"))
    dull = C.is_boilerplate(t)
    answered, compared = t != "", _compared()
    return items.groupBy(F.coalesce("answer_type", F.lit("unknown")).alias("answer_type")).agg(
        F.count("*").alias("n"), F.count_if(answered).alias("scorable"), F.count_if(~answered & (C.trimmed(F.col("rubric")) != "")).alias("rubric_only"),
        F.count_if(compared & answered & dull).alias("boilerplate"), F.count_if(compared & answered & ~dull & (C.informativeness(t) < BORDERLINE)).alias("borderline"),
    )


def borderline_comparisons(items: DataFrame) -> DataFrame:
    """(item_id, informativeness) of comparisons that say little without being boilerplate."""
    t = C.trimmed(F.col("answer"))
    rows = items.where(_compared() & (t != "") & ~C.is_boilerplate(t)).select("item_id", C.informativeness(t).alias("informativeness"))
    return rows.where(F.col("informativeness") < BORDERLINE)


def all_gates(
    items: DataFrame, blocked: DataFrame, validated: DataFrame, declared: int, least: int = 200, pass_rate: float = 0.95, several: int = 0, newer: bool = True, signed: bool = True,
) -> DataFrame:
    """The feasibility row with rubric_only, boilerplate, pass_rate and ``violations``: gates that fail, in order.

    validated: status of each candidate. declared: the items that the manifest says there are.
    several: comparisons needed in a newer bundle, 40 where it is 0, any number where it is negative.
    """
    scores = scorability(items).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rubric_only", "boilerplate")])
    passed = F.coalesce(F.avg((F.col("status") == "accepted").cast("double")), F.lit(0.0))
    row = feasibility_summary(items, blocked).join(F.broadcast(scores)).join(F.broadcast(validated.agg(passed.alias("pass_rate"))))  # one row each
    n = F.col("item_count")
    of_newer = [
        F.when(n < least, "too_few_rows"), F.when(n != declared, "count_differs"), F.when(F.col("blocked_count") > 0, "infeasible"), F.when(F.col("answer_gt_coverage") < 1, "coverage"),
        F.when(F.col("rubric_only") > 0, "rubric_only"), F.when(F.col("boilerplate") > 0, "boilerplate"),
        F.when(F.lit(several >= 0) & (F.col("multi_filing_count") < (several or FEWEST_SEVERAL)), "multi_filing"), F.when(F.lit(not signed), "not_signed"),
    ]
    of_older = [F.when(F.col("pass_rate") < pass_rate, "pass_rate"), F.when(F.col("blocked_count") > 0, "infeasible")]
    gates = [F.when(F.lit(declared < least), "too_few_items"), *(of_newer if newer else of_older), F.when(F.col("unreachable_answer_gt_count") > 0, "unreachable")]
    return row.withColumn("violations", F.array_compact(F.array(*gates)))


def content_hash(columns: list[str]) -> Column:
    """SHA-256 of an item's columns, lists joined by U+001E and columns by U+001F; null counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.array_join(c, "\x1e") if c in LISTS else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


#: Fields that a patch may have, and the group by whose name a change is reported.
PATCHED = {"question": "question", "paths": "expected_section_paths", "accessions": "expected_bindings", "answer": "ground_truth", "rubric": "ground_truth", "claims": "ground_truth"}


def override_items(items: DataFrame, patches: DataFrame, index: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changelog, items): every patch applied and judged, and the items with those that are accepted.

    patches: item_id (unique), annotation, and any fields of ``PATCHED``; null ones, and an empty question,
    change nothing. changelog: item_id, annotation, parent_hash (of the item before, empty where there is
    none), changed, outcome and errors. A patched item's paths are resolved by the index and it is judged
    as a new one; one that is rejected, or not found, doesn't stop the others, and its item stays
    as it was.
    """
    fields = [c for c in PATCHED if c in patches.columns]
    items, (index, snapshot) = written(_with_lists(items), "items"), _once(index, snapshot)
    wanted = patches.select("item_id", "annotation", *[F.col(c).alias(f"_p_{c}") for c in fields])
    wanted = wanted.withColumn("_p_question", F.nullif("_p_question", F.lit(""))) if "question" in fields else wanted
    rows = wanted.join(items.withColumns({"_here": F.lit(True), "parent_hash": content_hash(sorted(items.columns))}).hint("merge"), "item_id", "left")
    groups = list(dict.fromkeys(PATCHED[c] for c in fields))
    given = [F.when(F.greatest(*[F.col(f"_p_{c}").isNotNull() for c in fields if PATCHED[c] == g], F.lit(False)), F.lit(g)) for g in groups]
    rows = rows.withColumn("changed", F.array_compact(F.array(*given))).withColumns({c: F.coalesce(f"_p_{c}", c) for c in fields})
    rows = written(rows.drop(*[f"_p_{c}" for c in fields]), "patched")

    found = rows.where("_here")
    none = F.array().cast("array<string>")
    judged = found.join(resolved_paths(found, "paths", index, snapshot).hint("merge"), "item_id", "left")
    judged = judged.withColumns({"paths": F.coalesce("canonical", none), "unknown": F.coalesce("unknown", none)})
    # Paths that can't be resolved are named by their own error, not by that of an item without paths.
    judged = written(item_errors(judged.withColumn("_all", F.concat("paths", "unknown")), snapshot, "_all"), "judged")
    absent = rows.where("_here IS NULL").select("item_id", "annotation", F.lit("").alias("parent_hash"), none.alias("changed"), F.lit("rejected").alias("outcome"), F.array(F.lit("item_not_found")).alias("errors"))
    log = judged.select("item_id", "annotation", "parent_hash", "changed", F.col("status").alias("outcome"), "errors").unionByName(absent)

    taken = judged.where("status = 'accepted'")
    new = taken.select(*items.columns)
    kept = items.join(taken.select("item_id").hint("merge"), "item_id", "left_anti").select(*items.columns)
    return log, kept.unionByName(new)
