"""Evaluation metrics: ranked lists, eligibility, tables by variant, profile and stratum, deltas, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses that keep a result out of the headline numbers.
INELIGIBLE = ("incomplete", "non_reproducible", "degraded", "pending")


def ranking_metrics(rankings: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """mrr, map_score and ndcg for every item of relevant (item_id, chunk_id) or rankings (item_id,
    rank from 1, chunk_id). Items without a relevant id have nulls. Repeats in a list count again.
    """
    marks = relevant.select("item_id", "chunk_id").distinct()
    totals = marks.groupBy("item_id").agg(F.count("*").alias("n_relevant"))
    hits = rankings.join(marks, ["item_id", "chunk_id"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("rank"))
    gain = 1 / F.log2(F.col("rank") + 1)
    found = hits.withColumn("nth", nth).groupBy("item_id").agg(
        (1 / F.min("rank")).alias("mrr"), F.sum(F.col("nth") / F.col("rank")).alias("precisions"), F.sum(F.when(F.col("rank") <= k, gain)).alias("dcg")
    )
    items = rankings.select("item_id").unionByName(marks.select("item_id")).distinct()
    rows = items.join(totals, "item_id", "left").join(found, "item_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.when(F.col("n_relevant") > 0, F.coalesce(c, F.lit(0.0)))
    return rows.select(
        "item_id", zero(F.col("mrr")).alias("mrr"), zero(F.col("precisions") / F.col("n_relevant")).alias("map_score"),
        F.when(F.col("n_relevant") > 0, F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal).alias("ndcg"),
    )


def eligible(status: Column) -> Column:
    return ~status.isin(*INELIGIBLE)


def _means() -> list[Column]:
    ok = eligible(F.col("status"))
    return [
        F.count_if(ok).alias("n_eligible"), F.avg(F.when(ok & F.col("has_answer"), F.col("outcome"))).alias("outcome_accuracy"),
        F.avg(F.when(ok, F.col("alignment"))).alias("rubric_alignment"), F.avg(F.when(ok, F.col("mrr"))).alias("mrr"), F.avg(F.when(ok, F.col("ndcg"))).alias("ndcg"),
    ]


METRICS = ("outcome_accuracy", "rubric_alignment", "mrr", "ndcg")


def variant_metrics(results: DataFrame) -> DataFrame:
    """Means by variant over eligible results; null if none counts."""
    return results.groupBy("variant_id").agg(*_means())


def variant_quality(results: DataFrame, second: bool = False) -> DataFrame:
    """Means by variant over eligible results: task_success, outcome_accuracy, rubric_alignment, and mrr,
    map_score, ndcg over results with relevance labels; null where none counts.

    results: status, has_answer, has_rubric, has_labels, outcome, alignment, mrr, map_score, ndcg. The task
    succeeds by the outcome where there is an answer to compare with, else by the alignment with a
    rubric; in the ``second`` kind of dataset always by the outcome, and rubrics have no mean.
    """
    ok = results.where(eligible(F.col("status")))
    outcome = F.coalesce("outcome", F.lit(0.0))
    task = outcome if second else F.when(F.col("has_answer"), outcome).when(F.col("has_rubric"), F.coalesce("alignment", F.lit(0.0)))
    rubric = F.lit(None).cast("double") if second else F.avg(F.when(F.col("has_rubric"), F.col("alignment")))
    ranking = [F.avg(F.when(F.col("has_labels"), F.col(c))).alias(c) for c in ("mrr", "map_score", "ndcg")]
    means = ok.groupBy("variant_id").agg(F.avg(task).alias("task_success"), F.avg(F.when(F.col("has_answer"), F.col("outcome"))).alias("outcome_accuracy"), rubric.alias("rubric_alignment"), *ranking)
    return results.select("variant_id").distinct().join(means, "variant_id", "left")


def metric_tables(results: DataFrame) -> DataFrame:
    """The same means by variant, by variant and profile, and by variant and stratum, in one pass:
    ``level`` says which, absent keys are null."""
    sets = results.groupingSets([["variant_id"], ["variant_id", "profile"], ["variant_id", "stratum"]], "variant_id", "profile", "stratum")
    level = F.when(F.grouping("profile") == 0, "profile").when(F.grouping("stratum") == 0, "stratum").otherwise("variant")
    return sets.agg(level.alias("level"), F.count("*").alias("n_items"), *_means())


def headline_table(results: DataFrame) -> DataFrame:
    """Long form: (variant_id, metric, value, flag); null means become 0.0 with no_eligible_items."""
    wide = variant_metrics(results)
    long = wide.unpivot("variant_id", list(METRICS), "metric", "raw")
    return long.select("variant_id", "metric", F.coalesce("raw", F.lit(0.0)).alias("value"), F.when(F.col("raw").isNull(), "no_eligible_items").alias("flag"))


def stratum_table(results: DataFrame, strata: tuple[str, ...] = ("html", "xbrl", "mixed"), low: int = 10) -> DataFrame:
    """A row for each variant and stratum, empty ones too: n, mean outcome, abstention rate, low_n."""
    every = results.select("variant_id").distinct().select("variant_id", F.explode(F.array(*map(F.lit, strata))).alias("stratum"))
    ok = results.where(eligible(F.col("status")))
    agg = ok.groupBy("variant_id", "stratum").agg(F.count("*").alias("n"), F.avg("outcome").alias("outcome"), F.avg(F.col("abstained").cast("double")).alias("abstention_rate"))
    rows = every.join(agg.hint("merge"), ["variant_id", "stratum"], "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("variant_id", "stratum", n.alias("n"), F.coalesce("outcome", F.lit(0.0)).alias("outcome"), F.coalesce("abstention_rate", F.lit(0.0)).alias("abstention_rate"), (n < low).alias("low_n"))


def variant_delta(results: DataFrame, baseline: str) -> DataFrame:
    """(variant_id, metric, baseline_minus_variant, variant_minus_baseline); pairs with a null are left out."""
    long = variant_metrics(results).unpivot("variant_id", list(METRICS), "metric", "value").where("value IS NOT NULL")
    base = long.where(F.col("variant_id") == baseline).select("metric", F.col("value").alias("base"))
    rows = long.where(F.col("variant_id") != baseline).join(base.hint("merge"), "metric")
    return rows.select("variant_id", "metric", (F.col("base") - F.col("value")).alias("baseline_minus_variant"), (F.col("value") - F.col("base")).alias("variant_minus_baseline"))


def audit_table(results: DataFrame) -> DataFrame:
    """Counts of included and excluded results by variant."""
    return results.groupBy("variant_id").agg(F.count_if(eligible(F.col("status"))).alias("included"), *[F.count_if(F.col("status") == s).alias(s) for s in INELIGIBLE])


def pivot_headline(long: DataFrame) -> DataFrame:
    """(variant_id, metric, value) to a row a variant."""
    return long.groupBy("variant_id").pivot("metric", list(METRICS)).agg(F.first("value"))


def verify_tables(actual: DataFrame, expected: DataFrame, exact: tuple[str, ...] = ("mrr", "ndcg"), tolerance: float = 0.02) -> DataFrame:
    """Expected rows (variant_id, metric, value) that differ or are missing: problem says which."""
    have = actual.select("variant_id", "metric", F.col("value").alias("actual"))
    rows = expected.join(have.hint("merge"), ["variant_id", "metric"], "left")
    allowed = F.when(F.col("metric").isin(*exact), 1e-9).otherwise(tolerance)
    problem = F.when(F.col("actual").isNull(), "missing").when(F.abs(F.col("actual") - F.col("value")) > allowed, "mismatch")
    return rows.withColumn("problem", problem).where("problem IS NOT NULL").select("variant_id", "metric", "problem")


def smoke_gate(results: DataFrame) -> DataFrame:
    """Per variant: mean alignment (outcome if null), zero-MRR count, good retrieval with zero
    alignment, abstentions, and whether all thresholds hold."""
    a = F.coalesce("alignment", "outcome")
    g = results.groupBy("variant_id").agg(
        F.count("*").alias("n"), F.avg(a).alias("mean_alignment"), F.count_if(F.col("mrr") == 0).alias("zero_mrr"),
        F.count_if((F.col("mrr") >= 0.5) & (a == 0)).alias("strong_but_zero"), F.count_if("abstained").alias("abstentions"),
    )
    passed = (F.col("mean_alignment") >= 0.4) & (F.col("zero_mrr") <= 0.2 * F.col("n")) & (F.col("strong_but_zero") <= 0.1 * F.col("n")) & (F.col("abstentions") <= 0.25 * F.col("n"))
    return g.withColumn("passed", passed)


def investigation_flags(results: DataFrame, baseline: str, delta: float = 0.10) -> DataFrame:
    """(variant_id, item_id, difference) of results at least ``delta`` away from the baseline's."""
    base = results.where(F.col("variant_id") == baseline).select("item_id", F.col("outcome").alias("base"))
    rows = results.where(F.col("variant_id") != baseline).join(base, "item_id").withColumn("difference", F.col("outcome") - F.col("base"))
    return rows.where(F.abs("difference") >= delta).select("variant_id", "item_id", "difference")


def binding_metrics(bindings: DataFrame) -> DataFrame:
    """One row: accuracy (same set; an item that should fail needs none), multi_filing_rate and
    fail_closed_rate of (predicted, expected, should_fail). An empty table gives 0, 0 and 1."""
    same = F.array_sort(F.array_distinct("predicted")) == F.array_sort(F.array_distinct("expected"))
    hit = F.when(F.col("should_fail"), F.size("predicted") == 0).otherwise(same)
    closed = F.avg(F.when(F.col("should_fail"), (F.size("predicted") == 0).cast("double")))
    return bindings.agg(
        F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg((F.size("expected") > 1).cast("double")), F.lit(0.0)).alias("multi_filing_rate"),
        F.coalesce(closed, F.lit(1.0)).alias("fail_closed_rate"),
    )


def variant_complete(results: DataFrame, expected: int) -> DataFrame:
    return results.groupBy("variant_id").agg(((F.count("*") >= expected) & (F.count_if(F.col("status") == "pending") == 0)).alias("complete"))


def structural_overlap(visited: Column, expected: Column) -> Column:
    """Share of the expected ids that were visited; 1 if none is expected."""
    want = F.array_distinct(expected)
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(visited, want)) / F.size(want))


def trajectory_fidelity(visited: Column, expected: Column, routed: Column, judge: Column) -> Column:
    base = F.least(F.lit(1.0), structural_overlap(visited, expected) + F.when(routed, 0.1).otherwise(0.0))
    return F.when(judge.isNull(), base).otherwise(0.5 * base + 0.5 * judge)


def structural_metrics(rows: DataFrame) -> DataFrame:
    """One row of rates over (used, bound, visited, paths, multi): bound filings all used; some path
    visited, in whole or as a part; two bound filings used where several are needed."""
    bound = F.size(F.array_except("bound", "used")) == 0
    path = (F.size("paths") == 0) | F.exists("paths", lambda p: F.exists("visited", lambda v: v.contains(p)))
    multi = (F.size(F.array_distinct("bound")) < 2) | (F.size(F.array_intersect("bound", "used")) >= 2)
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return rows.agg(rate(bound).alias("accession_binding"), rate(path).alias("section_path_hit"), rate(F.when(F.col("multi"), multi)).alias("multi_filing_success"))


def validate_trajectories(rows: DataFrame) -> DataFrame:
    """Add codes and validation of (route array<string>, hops array<struct<node_type, edge_type,
    accession>>, status, absent_reason): a hop outside the route makes it non_reproducible, any other
    code incomplete."""
    ok = F.col("status").isin("complete", "ok")
    real = lambda a: a.rlike("^[0-9]{10}-[0-9]{2}-[0-9]{6}$")
    astray = (F.size("route") > 0) & F.exists("hops", lambda h: F.coalesce(real(h["accession"]) & ~F.array_contains("route", h["accession"]), F.lit(False)))
    codes = F.array_compact(F.array(
        F.when(ok & (F.size("route") == 0) & ~F.coalesce(F.col("absent_reason").isin("macro_binding_failed", "scope_error"), F.lit(False)), "EMPTY_DOCUMENT_ROUTE"),
        F.when((F.size("hops") == 0) & F.col("absent_reason").isNull() & ok, "MISSING_ABSENT_REASON"),
        F.when(F.exists("hops", lambda h: F.coalesce(h["node_type"] == "", F.lit(True))), "MISSING_NODE_TYPE"),
        F.when(F.exists("hops", lambda h: F.coalesce(h["edge_type"] == "", F.lit(True))), "MISSING_EDGE_TYPE"), F.when(astray, "ORPHAN_HOP_ACCESSION"),
    ))
    status = F.when(F.array_contains(F.col("codes"), "ORPHAN_HOP_ACCESSION"), "non_reproducible").when(F.size("codes") > 0, "incomplete").otherwise("complete")
    return rows.withColumn("codes", codes).withColumn("validation", status)


def trajectory_gate(validated: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row over validated trajectories (validation): total, complete, incomplete, non_reproducible,
    pass_rate (0 without any) and passed."""
    of = lambda status: F.count_if(F.col("validation") == status).alias(status)
    g = validated.agg(F.count("*").alias("total"), of("complete"), of("incomplete"), of("non_reproducible"))
    rate = F.when(F.col("total") > 0, F.col("complete") / F.col("total")).otherwise(0.0)
    return g.withColumns({"pass_rate": rate, "passed": rate >= threshold})


def phase_gate(cohort: DataFrame, results: DataFrame, floor: int) -> DataFrame:
    """One row: items of the cohort, those with a positive outcome (no result counts as none), the mean
    outcome, and whether the floor is reached."""
    rows = cohort.join(results.select("item_id", "outcome", "abstained"), "item_id", "left")
    g = rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("outcome"), F.lit(0.0)) > 0).alias("positive"), F.avg(F.coalesce("outcome", F.lit(0.0))).alias("mean_outcome"), F.count_if(F.coalesce("abstained", F.lit(False))).alias("abstained"))
    return g.withColumn("passed", F.col("positive") >= floor)


def materialization_audit(rows: DataFrame) -> DataFrame:
    """Missing accessions of (item_id, bound, used) and whether that is a binding miss."""
    return rows.select("item_id", F.array_sort(F.array_except("bound", "used")).alias("missing"), (F.size(F.array_except("bound", "used")) > 0).alias("binding_miss"))
