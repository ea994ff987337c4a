"""Trajectories, investigations, quality summaries, and fact rules used in review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import written
from ..functions.ordered import ordered, running_sum
from .facts import attach_taxonomy


def visited_sets(trajectories: DataFrame) -> DataFrame:
    """(item_id, accessions, visited): sorted distinct ids of route, hops and evidence arrays.

    trajectories: item_id, route array<string>, hops and evidence array<struct<node_id, accession>>.
    """
    none = F.array().cast("array<string>")
    ids = lambda a, f: F.coalesce(F.transform(a, lambda x: x[f]), none)
    tidy = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != ""))))
    used = F.concat(F.coalesce("route", none), ids("hops", "accession"), ids("evidence", "accession"))
    return trajectories.select("item_id", tidy(used).alias("accessions"), tidy(F.concat(ids("hops", "node_id"), ids("evidence", "node_id"))).alias("visited"))


def hydrate_evidence(results: DataFrame) -> DataFrame:
    """Citations stand in for evidence that is empty or null."""
    return results.withColumn("evidence", F.when(F.coalesce(F.size("evidence"), F.lit(0)) > 0, F.col("evidence")).otherwise(F.col("citations")))


def trajectory_hops(steps: DataFrame, audit_stage: str = "audit") -> DataFrame:
    """Steps (query_id, ordinal, stage, node_id) without audit hops, renumbered from 0."""
    w = Window.partitionBy("query_id").orderBy("ordinal", "node_id")
    return steps.where(F.col("stage") != audit_stage).withColumn("hop_index", F.row_number().over(w) - 1).select("query_id", "hop_index", "stage", "node_id")


def trajectory_route(bound: DataFrame, filings: DataFrame) -> DataFrame:
    """(query_id, position, accession, form_type, cik, filed_at, period_end, label): the filings that a query
    was routed to (bound: query_id, position, accession). label: the year of an annual report, the date
    that another's period ends on, null without one. Unknown accessions are left out."""
    rows = bound.join(filings.select("accession", "form_type", "cik", "filed_at", "period_end").hint("merge"), "accession")
    label = F.when(F.col("form_type") == "10-K", F.concat(F.lit("FY"), F.year("period_end"))).otherwise(F.col("period_end").cast("string"))
    return rows.select("query_id", "position", "accession", "form_type", "cik", F.col("filed_at").cast("string").alias("filed_at"), F.col("period_end").cast("string").alias("period_end"), label.alias("label"))


def trajectory_evidence(evidence: DataFrame, prompts: DataFrame) -> DataFrame:
    """(query_id, chunk_id, content_hash, citation_label, source_type, accession, section_id, in_prompt) of
    evidence (query_id, chunk_id, content_hash, citation, source, accession, section_id): a missing
    citation is the chunk's id, a missing source is narrative, a missing accession the one in the id.
    prompts: (query_id, chunk_id) that a query's prompt had; a query without any had all."""
    text = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    given = prompts.select("query_id").distinct().withColumn("_any", F.lit(True))
    had = prompts.select("query_id", "chunk_id").distinct().withColumn("_had", F.lit(True))
    rows = evidence.join(had.hint("merge"), ["query_id", "chunk_id"], "left").join(given.hint("merge"), "query_id", "left")
    return rows.select(
        "query_id", "chunk_id", F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.coalesce(text("citation"), F.col("chunk_id")).alias("citation_label"),
        F.lower(F.coalesce(text("source"), F.lit("narrative"))).alias("source_type"), F.coalesce(text("accession"), S.accession_of(F.col("chunk_id"))).alias("accession"), text("section_id").alias("section_id"),
        (F.col("_had").isNotNull() | F.col("_any").isNull()).alias("in_prompt"),
    )


def evidence_paths(evidence: DataFrame, visits: DataFrame, most: int) -> DataFrame:
    """The first ``most`` evidence rows (query_id, rank, node_id) with the edge type of the node's last
    visit (query_id, ordinal, node_id, edge_type)."""
    last = visits.groupBy("query_id", "node_id").agg(F.max_by("edge_type", "ordinal").alias("edge_type"))
    return evidence.where(F.col("rank") <= most).join(last, ["query_id", "node_id"], "left")


def quality_summary(annotations: DataFrame, results: DataFrame) -> DataFrame:
    """One row: items reviewed, those with a failed check last, zero outcomes, and the share of zero
    outcomes that a reviewer laid to the dataset."""
    from .dataset import latest_annotation

    last = latest_annotation(annotations).select("item_id", "spot_check", "failure_class")
    rows = results.select("item_id", "outcome").join(last, "item_id", "left")
    zero = F.coalesce(F.col("outcome") <= 0, F.lit(True))
    g = rows.agg(F.count("failure_class").alias("reviewed"), F.count_if(~F.col("spot_check")).alias("failed_check"), F.count_if(zero).alias("zero"), F.count_if(zero & (F.col("failure_class") == "view")).alias("dataset_caused"))
    return g.withColumn("dataset_rate", F.col("dataset_caused") / F.nullif("zero", F.lit(0)))


def rejudge_delta(before: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """One row (n_override, n_regenerate, compared, improved, improved_rate): accepted changes, those
    that regenerate an item, and the changed items with a result before and after whose outcome rose.

    before, after: item_id, outcome (null: 0), one row an item; changes: item_id, accepted, rationale.
    """
    ok = F.coalesce("accepted", F.lit(False))
    again = F.coalesce(F.lower("rationale").contains("regenerate"), F.lit(False))
    none = F.lit(0).cast("bigint")
    n = changes.agg(F.count_if(ok).alias("n_override"), F.count_if(ok & again).alias("n_regenerate")).select("*", none.alias("compared"), none.alias("improved"))
    score = lambda df, name: df.select("item_id", F.coalesce("outcome", F.lit(0.0)).alias(name))
    items = changes.where(ok).select("item_id").distinct()
    both = score(before, "b").join(score(after, "a"), "item_id").join(items, "item_id", "left_semi")
    g = both.agg(F.count("*").alias("compared"), F.count_if(F.col("a") > F.col("b")).alias("improved"))
    g = n.unionByName(g.select(none.alias("n_override"), none.alias("n_regenerate"), "compared", "improved"))
    g = g.agg(*[F.sum(c).alias(c) for c in g.columns])
    return g.withColumn("improved_rate", F.coalesce(F.col("improved") / F.nullif("compared", F.lit(0)), F.lit(0.0)))


def feasibility_report(validated: DataFrame) -> DataFrame:
    """(reason, n, example): blocked items by error code, with the least item id."""
    return validated.select("item_id", F.explode("errors").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"), F.min("item_id").alias("example"))


def least_ids(rows: DataFrame, *keys: str, n: int = 5) -> DataFrame:
    """(keys, examples): the ``n`` least item ids of each key. No more of a key leave a task."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("item_id"))).where(F.col("_n") <= n)
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list("item_id")).alias("examples"))


# Variants, bounds and codes of the notes on a run.
BASELINE, FLAT, NO_CITATIONS = "graph-full", "flat-chunk", ("ablation-no-walker", "ablation-xbrl-only")
SMALL, HIGH, AHEAD, MOST_NOTES = 5, 0.9, 0.05, 25
SEVERITY = {"critical": 0, "warning": 1, "info": 2}


def aggregated_notes(results: DataFrame, headline: DataFrame, structural: DataFrame, runs: DataFrame, strata: DataFrame, second: bool = False) -> DataFrame:
    """(pattern, severity, variant_id, n, examples, position): what is odd about a run, by twelve patterns, the
    first 25 by severity and number; variant_id is null for notes on the whole run.

    results: variant_id, item_id, judged, outcome, ndcg, n_citations, has_scores, has_alignment; headline:
    variant_id, metric, value, n_items; structural: variant_id, binding_accuracy, section_hit_rate; runs:
    variant_id, a row for each entry of the run's list; strata: variant_id, stratum, metric, value.
    second: a dataset of the second kind, whose rubrics may all be 0. Results are read in one
    aggregation by variant; what follows has a row a variant. Examples are the least item ids.
    """
    cited = F.coalesce("n_citations", F.lit(0))
    uncited = F.col("judged") & (cited == 0) & (F.col("variant_id") != FLAT)
    unranked = (F.col("outcome") >= HIGH) & (F.col("ndcg") == 0) & ~F.col("variant_id").isin(*NO_CITATIONS)
    unaligned = F.col("judged") & F.col("has_scores") & ~F.col("has_alignment") & F.col("outcome").isNotNull()
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    by = results.groupBy("variant_id").agg(F.count("*").alias("_all"), F.sum(cited).alias("_cites"), count(uncited, "_uncited"), count(unranked, "_unranked"), count(unaligned, "_unaligned"))
    value = lambda m: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
    wide = headline.groupBy("variant_id").agg(value("mrr"), value("outcome_accuracy"), value("rubric_alignment"), F.max("n_items").alias("_items"))
    by = written(wide.join(by.hint("merge"), "variant_id", "full"), "variant-notes")  # a row a variant
    ablation = F.col("variant_id").isin(*NO_CITATIONS)

    def note(rows: DataFrame, pattern: Column | str, severity: Column | str, n: Column | str, variant: str | None = "variant_id") -> DataFrame:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return rows.select(lit(pattern).alias("pattern"), lit(severity).alias("severity"), (F.col(variant) if variant else F.lit(None).cast("string")).alias("variant_id"), (F.col(n) if isinstance(n, str) else n).cast("long").alias("n"))

    at = lambda c, v: F.max(F.when(F.col("variant_id") == v, F.col(c)))
    ends = by.agg(at("outcome_accuracy", BASELINE).alias("_base"), at("outcome_accuracy", FLAT).alias("_flat"))
    html = strata.where("stratum = 'html' AND metric = 'outcome_accuracy'").agg(at("value", BASELINE).alias("_html"), at("value", FLAT).alias("_html_flat"))
    ends = ends.join(F.broadcast(html))  # one row each
    behind = F.coalesce(F.col("_base") <= F.col("_flat"), F.lit(False)) | F.coalesce(F.col("_html") <= F.col("_html_flat"), F.lit(False))
    repeats = runs.groupBy("variant_id").agg(F.count("*").alias("_n")).agg(F.max("_n").alias("_n"))
    nothing = structural.agg(F.count("*").alias("_n"), F.count_if((F.col("binding_accuracy") != 0) | (F.col("section_hit_rate") != 0)).alias("_some"))
    rubrics = by.agg(F.count("rubric_alignment").alias("_n"), F.count_if(F.col("rubric_alignment") != 0).alias("_some"))
    whole = by.agg(F.min_by("_items", "variant_id").alias("_n"), F.sum("_unaligned").alias("_unaligned"))
    ahead = by.where(F.col("variant_id") != BASELINE).join(F.broadcast(ends)).where((F.col("outcome_accuracy") > F.col("_base") + AHEAD) & ((F.coalesce("_cites", F.lit(0)) > 0) | (F.coalesce("mrr", F.lit(0.0)) > 0)))

    # Items of the flat variant that beat the same items of the baseline.
    pair = lambda v, name: results.where(F.col("variant_id") == v).groupBy("item_id").agg(F.max("outcome").alias(name))
    beaten = pair(BASELINE, "_b").join(pair(FLAT, "_f").hint("merge"), "item_id").where("_f > _b").select(F.lit("").alias("_v"), "item_id")
    notes = [
        note(repeats.where("_n > 1"), "DUPLICATE_VARIANT_RUNS", "warning", F.lit(0), None), note(whole.where(F.col("_n") <= SMALL), "SMALL_SAMPLE", "info", "_n", None),
        note(rubrics.where(F.lit(not second) & (F.col("_n") > 0) & (F.col("_some") == 0)), "RUBRIC_ALIGNMENT_ZERO", "warning", "_n", None), note(nothing.where("_n > 0 AND _some = 0"), "STRUCTURAL_METRICS_ZERO", "warning", "_n", None),
        note(by.where("_uncited > 0"), F.when(ablation, "ABLATION_ZERO_CITATIONS").otherwise("JUDGE_OK_ZERO_CITATIONS"), F.when(ablation, "info").otherwise("warning"), "_uncited"),
        note(by.where("_unranked > 0"), "HIGH_OUTCOME_ZERO_NDCG", "warning", "_unranked"),
        note(by.where((F.col("mrr") <= 0) & (F.col("variant_id") == FLAT) & (F.col("_cites") > 0)), "FLAT_CHUNK_ZERO_RANKING", "info", "_all"), note(by.where((F.col("mrr") <= 0) & ablation), "ABLATION_ZERO_RANKING", "info", F.coalesce("_all", F.lit(0))),
        note(ahead, "OUTCOME_EXCEEDS_BASELINE", "info", F.lit(1)), note(whole.where("_unaligned > 0"), "INCOMPLETE_JUDGE_CRITERIA", "warning", "_unaligned", None),
    ]
    shown = least_ids(beaten, "_v").select(F.lit(None).cast("string").alias("_variant"), F.lit("OUTCOME_ORDERING_REGRESSION").alias("_pattern"), "examples")
    for hit, pattern in ((uncited, F.when(ablation, "ABLATION_ZERO_CITATIONS").otherwise("JUDGE_OK_ZERO_CITATIONS")), (unranked, F.lit("HIGH_OUTCOME_ZERO_NDCG"))):
        shown = shown.unionByName(least_ids(results.where(hit), "variant_id").select(F.col("variant_id").alias("_variant"), pattern.alias("_pattern"), "examples"))
    out = note(ends.where(behind), "OUTCOME_ORDERING_REGRESSION", "warning", F.lit(1), None)
    for more in notes:
        out = out.unionByName(more)
    out = out.join(shown.hint("merge"), (F.col("pattern") == F.col("_pattern")) & F.col("variant_id").eqNullSafe(F.col("_variant")), "left").drop("_pattern", "_variant")
    out = out.withColumns({"examples": F.coalesce("examples", F.array().cast("array<string>"))})
    out = out.withColumn("n", F.when(F.col("pattern") == "OUTCOME_ORDERING_REGRESSION", F.greatest(F.lit(1), F.size("examples")).cast("long")).otherwise(F.col("n")))
    rank = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in SEVERITY.items()], F.lit(9))
    # A note or two for each variant and pattern: few rows.
    return out.withColumn("position", F.row_number().over(Window.orderBy(rank, F.desc("n"), "pattern", "variant_id"))).where(F.col("position") <= MOST_NOTES)


def investigation_notes(results: DataFrame, most: int = 25) -> DataFrame:
    """(pattern, severity, n, examples): detectors over results in one pass; the ``most`` by severity and
    count, with five least item ids each."""
    zero = F.coalesce(F.col("outcome") <= 0.05, F.lit(True))
    detectors = (
        ("strong_retrieval_zero", 3, zero & (F.coalesce(F.col("mrr"), F.lit(0.0)) >= 0.5)), ("abstention", 2, F.col("abstained")), ("no_labels", 1, F.col("mrr").isNull()),
        ("zero_alignment", 2, F.col("alignment") < 0.05), ("ineligible", 1, F.col("status") != "complete"), ("ranked_low", 1, F.coalesce(F.col("ndcg"), F.lit(1.0)) < 0.1),
    )
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("pattern"), F.lit(s).alias("severity"))) for n, s, c in detectors]))
    rows = results.select("variant_id", "item_id", F.explode(hits).alias("h")).select("variant_id", "item_id", "h.*")
    g = rows.groupBy("variant_id", "pattern", "severity").agg(F.count("*").alias("n"))
    g = g.join(least_ids(rows, "variant_id", "pattern").hint("merge"), ["variant_id", "pattern"])
    w = Window.partitionBy("variant_id").orderBy(F.desc("severity"), F.desc("n"), "pattern")
    return g.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


def run_summary(results: DataFrame, runs: DataFrame) -> DataFrame:
    """(variant_id, n_items, run_id): a variant's items and its run, one with an id before one without,
    then the last started."""
    w = Window.partitionBy("variant_id").orderBy((F.coalesce(F.col("run_id"), F.lit("")) == "").cast("int"), F.desc("started"), "run_id")
    one = runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("variant_id", "run_id")
    return results.groupBy("variant_id").agg(F.count("*").alias("n_items")).join(one, "variant_id", "left")


def suite_means(results: DataFrame) -> DataFrame:
    """Means by the item id's prefix before the last dash."""
    return results.groupBy(F.regexp_replace("item_id", "-[^-]*$", "").alias("suite")).agg(F.count("*").alias("n"), F.avg("outcome").alias("outcome"), F.avg("alignment").alias("alignment"))


def item_records(results: DataFrame) -> DataFrame:
    """Flat rows: outcome or 0, whether retrieval was good, and why a result failed."""
    reason = F.when(F.col("status") != "complete", F.col("status")).when(F.col("abstained"), "abstained").when(F.coalesce(F.col("outcome"), F.lit(0.0)) <= 0, "zero_outcome")
    return results.select("variant_id", "item_id", F.coalesce("outcome", F.lit(0.0)).alias("outcome"), (F.coalesce("mrr", F.lit(0.0)) >= 0.5).alias("good_retrieval"), reason.alias("failure_reason"))


def weakest_criterion(scores: Column) -> Column:
    """Name of the least score of a map, trajectory_fidelity left out; ties by name."""
    entries = F.filter(F.map_entries(scores), lambda e: e["key"] != "trajectory_fidelity")
    return F.array_min(F.transform(entries, lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))["k"]


def theme_classes(paragraphs: DataFrame, themes: list[str], threshold: float = 0.82) -> tuple[DataFrame, DataFrame]:
    """Paragraphs (doc_id, text) with theme words, by their set of words as written: (membership, links).

    Membership gives each paragraph's theme set; links are the pairs of different sets whose Jaccard
    similarity reaches the threshold. There are at most as many sets as the themes allow, so pairs of
    paragraphs needn't be listed.
    """
    found = F.filter(F.split("text", "[^A-Za-z0-9_]+"), lambda w: F.lower(w).isin(themes))
    words = F.array_sort(F.array_distinct(found))
    member = paragraphs.select("doc_id", words.alias("themes")).where(F.size("themes") > 0)
    sets = member.groupBy("themes").agg(F.count("*").alias("n"))
    a = sets.select(F.col("themes").alias("a"), F.explode("themes").alias("w"))
    b = sets.select(F.col("themes").alias("b"), F.explode("themes").alias("w"))
    shared = a.join(b.hint("merge"), "w").where(F.array_join("a", ",") < F.array_join("b", ",")).groupBy("a", "b").agg(F.count("*").alias("_i"))
    similarity = F.col("_i") / (F.size("a") + F.size("b") - F.col("_i"))
    return member, shared.withColumn("similarity", similarity).where(F.col("similarity") >= threshold).drop("_i")


def assign_ratio_roles(first: Column, second: Column, numerators: list[str], denominators: list[str]) -> Column:
    """struct(numerator, denominator) of two concepts by role, else null."""
    n1, d1, n2, d2 = first.isin(numerators), first.isin(denominators), second.isin(numerators), second.isin(denominators)
    return F.when(n1 & d2, F.struct(first.alias("numerator"), second.alias("denominator"))).when(n2 & d1, F.struct(second.alias("numerator"), first.alias("denominator")))


def filed_together(facts: DataFrame) -> DataFrame:
    """(first, second): concepts, in order of name, that some filing has both. Filings are reduced to their
    distinct sets of concepts, and pairs are made of these only."""
    sets = facts.groupBy("accession").agg(F.array_sort(F.collect_set("concept")).alias("c")).select("c").distinct()
    rows = sets.select("c", F.posexplode("c").alias("i", "first"))
    return rows.select("first", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("second")).distinct()


def compare_pairs(evidence: DataFrame) -> DataFrame:
    """(query_id, first, second): the lead excerpts of a query's two filings, for queries with both.
    evidence: query_id, side (1 or 2), rank, excerpt."""
    lead = evidence.groupBy("query_id", "side").agg(F.min_by("excerpt", "rank").alias("e"))
    a, b = (lead.where(F.col("side") == i).select("query_id", F.col("e").alias(n)) for i, n in ((1, "first"), (2, "second")))
    return a.join(b, "query_id")


def merge_evidence(*sources: DataFrame) -> DataFrame:
    """Union by (query_id, chunk_id); the first source that has a chunk counts."""
    rows = None
    for i, s in enumerate(sources):
        s = s.withColumn("_s", F.lit(i))
        rows = s if rows is None else rows.unionByName(s)
    w = Window.partitionBy("query_id", "chunk_id").orderBy("_s")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_s")


def table_value(texts: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, value): the first number on the first line of a text that fits the pattern."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(pattern))
    number = F.translate(F.nullif(F.regexp_extract("line", r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit("")), ",", "").try_cast("double")
    return lines.withColumn("value", number).where("value IS NOT NULL").groupBy("doc_id").agg(F.min_by("value", "pos").alias("value"))


def corpus_hash(definitions: DataFrame) -> DataFrame:
    """(corpus_id, hash): sixteen hex digits of the digest of a definition's fields in order of name."""
    names = sorted(c for c in definitions.columns if c != "corpus_id")
    line = F.concat_ws("|", *[F.concat_ws("=", F.lit(n), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names])
    return definitions.select("corpus_id", F.left(F.sha2(line, 256), F.lit(16)).alias("hash"))


def scope_manifest(bound: DataFrame, labelled: DataFrame) -> DataFrame:
    """(query_id, labels, n_newer, stale): labels of a query's bound filings (query_id, accession), the
    number of its issuer's filings filed after all of them, and whether there are any.

    Filings (counted by issuer and day) and the days asked for are sorted together, newest first, and
    counted along: no query meets its issuer's filings one by one.
    """
    have = bound.join(labelled.select("accession", "issuer_id", "label", "filed_at").hint("merge"), "accession")
    g = have.groupBy("query_id", "issuer_id").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.max("filed_at").alias("_last"))
    days = labelled.groupBy("issuer_id", F.col("filed_at").alias("_last")).agg(F.count("*").alias("n"))
    asked = g.where("_last IS NOT NULL").select("issuer_id", "_last").distinct()
    # On a day that is asked for the question comes first: filings of that day aren't newer.
    both = asked.withColumn("n", F.lit(0).cast("long")).unionByName(days)
    rows = running_sum(ordered(both, ["issuer_id"], [F.desc("_last"), "n"], "newer-filings"), ["issuer_id"], "n", "n_newer").where("n = 0")
    out = g.join(rows.select("issuer_id", "_last", "n_newer").hint("merge"), ["issuer_id", "_last"], "left").withColumn("n_newer", F.coalesce("n_newer", F.lit(0)))
    return out.select("query_id", "labels", "n_newer", (F.col("n_newer") > 0).alias("stale"))


def refine_fact_labels(candidates: DataFrame) -> DataFrame:
    """Chunks of each item (item_id, chunk_id, is_fact, concept_hit, value_hit): where all are facts, those
    whose value fits, else those whose concept fits, else all; items with other chunks stay whole."""
    w = Window.partitionBy("item_id")
    facts_only = F.min(F.col("is_fact").cast("int")).over(w) == 1
    concept = F.max(F.col("concept_hit").cast("int")).over(w) == 1
    kept = ~F.col("_c") | F.col("concept_hit")
    rows = candidates.withColumns({"_f": facts_only, "_c": concept})
    value = F.max((kept & F.col("value_hit")).cast("int")).over(w) == 1
    rows = rows.withColumn("_v", value)
    return rows.where(~F.col("_f") | (kept & (~F.col("_v") | F.col("value_hit")))).select("item_id", "chunk_id")


def failure_pack(items: DataFrame, results: DataFrame, annotations: DataFrame) -> DataFrame:
    """Items with their result and last annotation, one row a result."""
    from .dataset import latest_annotation

    last = latest_annotation(annotations).select("item_id", F.col("failure_class").alias("reviewed_class"), "proposed")
    return items.join(results, "item_id").join(last, "item_id", "left")


def cohort_report(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row per variant: items, zero outcomes, good retrieval with a zero outcome, and the mean change
    from the baseline (item_id, base)."""
    rows = results.join(baseline, "item_id", "left")
    zero = F.coalesce(F.col("outcome") <= 0, F.lit(True))
    return rows.groupBy("variant_id").agg(F.count("*").alias("n"), F.count_if(zero).alias("zero"), F.count_if(zero & (F.coalesce(F.col("mrr"), F.lit(0.0)) >= 0.5)).alias("strong_zero"), F.avg(F.col("outcome") - F.col("base")).alias("mean_change"))


def path_index(nodes: DataFrame) -> DataFrame:
    """Distinct "accession/slug" paths of section and document nodes (node_id, label)."""
    from ..functions import scalars as S

    slug = F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "_")
    return nodes.select(F.concat_ws("/", S.accession_of(F.col("node_id")), slug).alias("path")).distinct()


def label_roles(label: Column) -> Column:
    """Sorted roles that a label's words suggest."""
    rules = (("net income", "net_income"), ("before income tax", "pretax_income"), ("revenue", "revenue"), ("equity", "total_equity"), ("assets", "total_assets"), ("liabilit", "total_liabilities"), ("per share", "eps"))
    return S.let(F.lower(label), lambda t: F.array_sort(F.array_compact(F.array(*[F.when(t.contains(w), F.lit(r)) for w, r in rules]))))


def validate_documents(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, errors) of documents (doc_id, form_type, confidence, n_tables, n_html, n_empty_html)."""
    codes = F.array_compact(F.array(
        F.when(F.coalesce("confidence", F.lit(0.0)) < least, "low_confidence"), F.when(F.col("form_type").isin("10-K", "10-Q") & (F.coalesce("n_tables", F.lit(0)) == 0), "no_tables"),
        F.when(F.coalesce("n_empty_html", F.lit(0)) > 0, "empty_html_section"),
    ))
    return documents.select("doc_id", codes.alias("errors"))


def gold_path_eval(items: DataFrame, evidence: DataFrame, least_reach: float = 0.75, least_path: float = 0.9, least_items: int = 40) -> DataFrame:
    """One row: share of items (item_id, required array, full_scan, path_matched) whose required chunks are
    all in the evidence (item_id, chunk_id) without a full scan, share of those whose path fits, passed."""
    have = evidence.groupBy("item_id").agg(F.collect_set("chunk_id").alias("_h"))
    none = F.array().cast("array<string>")
    rows = items.join(have, "item_id", "left")
    reached = (F.size(F.array_except("required", F.coalesce("_h", none))) == 0) & ~F.col("full_scan")
    g = rows.withColumn("_r", reached).agg(F.count("*").alias("n"), F.avg(F.col("_r").cast("double")).alias("reach_rate"), F.avg(F.when(F.col("_r"), F.col("path_matched").cast("double"))).alias("path_rate"))
    path = F.coalesce("path_rate", F.lit(0.0))
    return g.select("n", "reach_rate", path.alias("path_rate"), ((F.col("n") >= least_items) & (F.col("reach_rate") >= least_reach) & (path >= least_path)).alias("passed"))


def binding_eval(predicted: DataFrame, expected: DataFrame, least_accuracy: float = 0.7, least_multi: float = 0.8, least_items: int = 50) -> DataFrame:
    """One row over items of ``expected`` (query_id, accession): share with exactly the predicted set, share
    with two or more filings, and whether the thresholds hold."""
    p = predicted.groupBy("query_id").agg(F.array_sort(F.collect_set("accession")).alias("_p"))
    e = expected.groupBy("query_id").agg(F.array_sort(F.collect_set("accession")).alias("_e"))
    g = e.join(p, "query_id", "left").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("_p") == F.col("_e"), F.lit(False)).cast("double")).alias("accuracy"), F.avg((F.size("_e") > 1).cast("double")).alias("multi_share"))
    return g.withColumn("passed", (F.col("n") >= least_items) & (F.col("accuracy") >= least_accuracy) & (F.col("multi_share") >= least_multi))


def review_pack(queue: DataFrame, citations: DataFrame, most: int = 8) -> DataFrame:
    """Queue rows with their first ``most`` cited excerpts (item_id, rank, excerpt) in one text."""
    w = Window.partitionBy("item_id").orderBy("rank")
    first = citations.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "excerpt"))), lambda x: x["excerpt"]), " | ")
    return queue.join(first.groupBy("item_id").agg(joined.alias("cited")), "item_id", "left")


def cohort_ids(queue: DataFrame, tier: int | None = None) -> DataFrame:
    rows = queue if tier is None else queue.where(F.col("tier") == tier)
    return rows.select("item_id").distinct()


def dense_answer(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, citations): ids and texts of the ranked chunks, in order, as one array."""
    rows = ranked.join(texts, "vec_id")
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "label"))).alias("citations"))


def best_facts(queries: DataFrame, facts: DataFrame, most: int) -> DataFrame:
    """The ``most`` facts of each query (query_id, issuer_id, question) whose concept answers it: annual
    ones before others, the newest first. The same question of an issuer is answered once."""
    asked = queries.select("issuer_id", "question").distinct()
    rows = asked.join(facts, "issuer_id").where(S.concept_matches_query(F.col("concept"), F.col("question")))
    annual = (F.date_format("period_start", "MM-dd") == "01-01") & (F.date_format("period_end", "MM-dd") == "12-31")
    w = Window.partitionBy("issuer_id", "question").orderBy(F.desc(annual), F.desc("period_end"), "fact_id")
    best = rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select("issuer_id", "question", "fact_id", "position")
    return queries.join(best.hint("merge"), ["issuer_id", "question"]).select("query_id", "fact_id", "position")


def document_nodes(filings: DataFrame) -> DataFrame:
    return filings.select(S.document_root(F.col("accession")).alias("node_id"), F.lit("DOCUMENT").alias("node_type"), F.concat_ws(" ", "form_type", F.col("period_end").cast("string")).alias("label")).distinct()


def fact_nodes_edges(facts: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type): a bucket of facts under each document once, facts under it."""
    root = S.document_root(F.col("accession"))
    bucket = F.concat(root, F.lit("-xbrl-facts"))
    top = facts.select(root.alias("source_id"), bucket.alias("target_id")).distinct()
    return top.unionByName(facts.select(bucket.alias("source_id"), F.col("fact_id").alias("target_id"))).withColumn("edge_type", F.lit("CONTAINS"))


def fact_nodes(facts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(node_id, node_type, label, metric_role, source_ref): the bucket section of each document with facts,
    and its facts, labelled by the taxonomy (see ``attach_taxonomy``), else by their concept, in 80
    characters. facts: accession, fact_id, concept, excerpt."""
    none = F.lit(None).cast("string")
    bucket = facts.select(F.concat(S.document_root(F.col("accession")), F.lit("-xbrl-facts")).alias("node_id")).distinct()
    top = bucket.select("node_id", F.lit("SECTION").alias("node_type"), F.lit("XBRL Financial Facts").alias("label"), none.alias("metric_role"), F.lit("xbrl").alias("source_ref"))
    named = attach_taxonomy(facts, taxonomy)
    label = F.left(F.coalesce(F.nullif(F.col("label"), F.lit("")), "concept"), F.lit(80))
    return top.unionByName(named.select(F.col("fact_id").alias("node_id"), F.lit("CHUNK_XBRL_FACT").alias("node_type"), label.alias("label"), "metric_role", F.col("excerpt").alias("source_ref")))


def divestiture_facts(texts: DataFrame) -> DataFrame:
    """(doc_id, amount, asset) of "sold <asset> for $<amount> billion" phrases; the first of a text."""
    pattern = r"(?i)sold ([A-Za-z ]+?) for \$([0-9.]+) (billion|million)"
    t = F.col("text")
    rows = texts.where(t.rlike(pattern))
    scale = F.when(F.lower(F.regexp_extract(t, pattern, 3)) == "billion", 1e9).otherwise(1e6)
    return rows.select("doc_id", (F.regexp_extract(t, pattern, 2).try_cast("double") * scale).alias("amount"), F.regexp_extract(t, pattern, 1).alias("asset"))
