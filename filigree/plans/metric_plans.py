"""Queries over the evaluation metrics, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.views import Frames
from .plan import Plans

PLANS = Plans()
_OK = "status NOT IN ('incomplete', 'non_reproducible', 'degraded', 'pending')"
_MEANS = f"""count(*) FILTER ({_OK}) AS n_eligible, avg(outcome) FILTER ({_OK} AND has_answer) AS outcome_accuracy, avg(alignment) FILTER ({_OK}) AS rubric_alignment,
 avg(mrr) FILTER ({_OK}) AS mrr, avg(ndcg) FILTER ({_OK}) AS ndcg"""
_R = lambda *names: ", ".join(f"round({n}, 9) AS {n}" for n in names)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@PLANS.add("m12_headline_eligible", f"SELECT variant_id, item_id, {_OK} AS eligible FROM results", ("results",))
def headline_eligible(f: Frames) -> DataFrame:
    return f["results"].select("variant_id", "item_id", M.eligible(F.col("status")).alias("eligible"))


@PLANS.add("m4_ranking_metrics", f"""
WITH n AS (SELECT item_id, count(*) FILTER (relevant) AS rel FROM rankings GROUP BY 1),
h AS (SELECT item_id, rank, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS nth FROM rankings WHERE relevant),
a AS (SELECT item_id, 1.0 / min(rank) AS mrr, sum(nth / rank::DOUBLE) AS p, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY 1),
i AS (SELECT k, sum(1 / log2(j + 1)) AS ideal FROM range(1, 11) AS a(k) JOIN range(1, 11) AS b(j) ON j <= k GROUP BY 1)
SELECT n.item_id, round(CASE WHEN rel > 0 THEN coalesce(mrr, 0) END, 9)::DOUBLE AS mrr, round(CASE WHEN rel > 0 THEN coalesce(p / rel, 0) END, 9) AS map_score, round(CASE WHEN rel > 0 THEN coalesce(dcg, 0) / ideal END, 9) AS ndcg
FROM n LEFT JOIN a USING (item_id) LEFT JOIN i ON i.k = least(rel, 10)""", ("rankings",))
def ranking(f: Frames) -> DataFrame:
    return _rounded(M.ranking_metrics(f["rankings"], f["rankings"].where("relevant")), "mrr", "map_score", "ndcg")


@PLANS.add("m13_variant_metrics", f"WITH v AS (SELECT variant_id, {_MEANS} FROM results GROUP BY 1) SELECT variant_id, n_eligible, {_R(*M.METRICS)} FROM v", ("results",))
def variants(f: Frames) -> DataFrame:
    return _rounded(M.variant_metrics(f["results"]), *M.METRICS)


@PLANS.add("m14_headline_table", f"""
WITH v AS (SELECT variant_id, {_MEANS} FROM results GROUP BY 1), u AS (UNPIVOT (SELECT variant_id, {", ".join(f"coalesce({m}, -1) AS {m}" for m in M.METRICS)} FROM v) ON {", ".join(M.METRICS)} INTO NAME metric VALUE raw)
SELECT variant_id, metric, round(CASE WHEN raw < 0 THEN 0 ELSE raw END, 9) AS value, CASE WHEN raw < 0 THEN 'no_eligible_items' END AS flag FROM u""", ("results",))
def headline(f: Frames) -> DataFrame:
    return _rounded(M.headline_table(f["results"]), "value")


@PLANS.add("m15_metric_tables", f"""
WITH g AS (SELECT variant_id, profile, stratum, CASE WHEN grouping(profile) = 0 THEN 'profile' WHEN grouping(stratum) = 0 THEN 'stratum' ELSE 'variant' END AS level, count(*) AS n_items, {_MEANS}
 FROM results GROUP BY GROUPING SETS ((variant_id), (variant_id, profile), (variant_id, stratum))) SELECT variant_id, profile, stratum, level, n_items, n_eligible, {_R(*M.METRICS)} FROM g""", ("results",))
def tables(f: Frames) -> DataFrame:
    return _rounded(M.metric_tables(f["results"]), *M.METRICS)


@PLANS.add("m16_stratum_table", f"""
WITH e AS (SELECT DISTINCT variant_id, s.stratum FROM results CROSS JOIN (VALUES ('html'), ('xbrl'), ('mixed')) AS s(stratum)),
a AS (SELECT variant_id, stratum, count(*) AS n, avg(outcome) AS outcome, avg(abstained::INT) AS rate FROM results WHERE {_OK} GROUP BY 1, 2)
SELECT variant_id, stratum, coalesce(n, 0) AS n, round(coalesce(outcome, 0), 9) AS outcome, round(coalesce(rate, 0), 9) AS abstention_rate, coalesce(n, 0) < 10 AS low_n FROM e LEFT JOIN a USING (variant_id, stratum)""", ("results",))
def strata(f: Frames) -> DataFrame:
    return _rounded(M.stratum_table(f["results"]), "outcome", "abstention_rate")


@PLANS.add("m17_variant_delta", f"""
WITH v AS (SELECT variant_id, {_MEANS} FROM results GROUP BY 1), u AS (UNPIVOT (SELECT variant_id, {", ".join(M.METRICS)} FROM v) ON {", ".join(M.METRICS)} INTO NAME metric VALUE value)
SELECT a.variant_id, a.metric, round(b.value - a.value, 9) AS baseline_minus_variant, round(a.value - b.value, 9) AS variant_minus_baseline FROM u a JOIN u b ON a.metric = b.metric AND b.variant_id = 'graph-full' AND a.variant_id <> 'graph-full'""", ("results",))
def delta(f: Frames) -> DataFrame:
    return _rounded(M.variant_delta(f["results"], "graph-full"), "baseline_minus_variant", "variant_minus_baseline")


@PLANS.add("m19_audit_table", f"SELECT variant_id, count(*) FILTER ({_OK}) AS included, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in M.INELIGIBLE) + " FROM results GROUP BY 1", ("results",))
def audit(f: Frames) -> DataFrame:
    return M.audit_table(f["results"])


@PLANS.add("m20_pivot_headline", f"WITH v AS (SELECT variant_id, {_MEANS} FROM results GROUP BY 1) SELECT variant_id, {', '.join(f'round(coalesce({m}, 0), 9) AS {m}' for m in M.METRICS)} FROM v", ("results",))
def pivot(f: Frames) -> DataFrame:
    return _rounded(M.pivot_headline(M.headline_table(f["results"])), *M.METRICS)


@PLANS.add("m21_verify_tables", f"""
WITH v AS (SELECT variant_id, {_MEANS} FROM results GROUP BY 1), u AS (UNPIVOT (SELECT variant_id, {", ".join(f"coalesce({m}, 0) AS {m}" for m in M.METRICS)} FROM v) ON {", ".join(M.METRICS)} INTO NAME metric VALUE value)
SELECT variant_id, metric, CASE WHEN variant_id = 'flat-chunk' THEN 'missing' ELSE 'mismatch' END AS problem FROM u WHERE variant_id = 'flat-chunk' OR metric IN ('mrr', 'ndcg')""", ("results",))
def verify(f: Frames) -> DataFrame:
    have = M.headline_table(f["results"])
    return M.verify_tables(have.where("variant_id <> 'flat-chunk'"), have.withColumn("value", F.col("value") + 0.01))


@PLANS.add("m22_smoke_gate", """
WITH g AS (SELECT variant_id, count(*) AS n, avg(coalesce(alignment, outcome)) AS mean_alignment, count(*) FILTER (mrr = 0) AS zero_mrr, count(*) FILTER (mrr >= 0.5 AND coalesce(alignment, outcome) = 0) AS strong_but_zero, count(*) FILTER (abstained) AS abstentions FROM results GROUP BY 1)
SELECT variant_id, n, round(mean_alignment, 9) AS mean_alignment, zero_mrr, strong_but_zero, abstentions, mean_alignment >= 0.4 AND zero_mrr <= 0.2 * n AND strong_but_zero <= 0.1 * n AND abstentions <= 0.25 * n AS passed FROM g""", ("results",))
def smoke(f: Frames) -> DataFrame:
    return _rounded(M.smoke_gate(f["results"]), "mean_alignment")


@PLANS.add("m28_investigation_flags", """
SELECT a.variant_id, a.item_id, round(a.outcome - b.outcome, 9) AS difference FROM results a JOIN results b ON a.item_id = b.item_id AND b.variant_id = 'graph-full' AND a.variant_id <> 'graph-full' WHERE abs(a.outcome - b.outcome) >= 0.1""", ("results",))
def flags(f: Frames) -> DataFrame:
    return _rounded(M.investigation_flags(f["results"], "graph-full"), "difference")


@PLANS.add("m6_binding_metrics", """
WITH b AS (SELECT o_orderkey, list_distinct(list(l_partkey % 50)) AS p, list_distinct(list(l_partkey % (CASE WHEN o_orderkey % 3 = 0 THEN 49 ELSE 50 END))) AS e, o_orderkey % 11 = 0 AS f, o_orderkey % 22 = 0 AS none FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT round(avg((CASE WHEN f THEN none ELSE NOT none AND list_sort(p) = list_sort(e) END)::INT), 9) AS accuracy, round(avg((len(e) > 1)::INT), 9) AS multi_filing_rate, round(avg(none::INT) FILTER (f), 9) AS fail_closed_rate FROM b""")
def binding(f: Frames) -> DataFrame:
    rows = f["orders"].join(f["lineitem"], F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.col("l_partkey") % F.when(F.col("o_orderkey") % 3 == 0, 49).otherwise(50)
    sets = rows.groupBy("o_orderkey").agg(F.collect_set(F.col("l_partkey") % 50).alias("p"), F.collect_set(key).alias("expected"))
    k = F.col("o_orderkey")
    rows = sets.select(F.when(k % 22 == 0, F.array().cast("array<bigint>")).otherwise(F.col("p")).alias("predicted"), "expected", (k % 11 == 0).alias("should_fail"))
    return _rounded(M.binding_metrics(rows), "accuracy", "multi_filing_rate", "fail_closed_rate")


@PLANS.add("m38_variant_complete", "SELECT variant_id, count(*) >= 100 AND count(*) FILTER (status = 'pending') = 0 AS complete FROM results GROUP BY 1", ("results",))
def complete(f: Frames) -> DataFrame:
    return M.variant_complete(f["results"], 100)


@PLANS.add("m5_trajectory_fidelity", """
WITH t AS (SELECT l_orderkey AS k, list_distinct(list(l_partkey % 20)) AS v, list_distinct(list(l_suppkey % 20)) AS e FROM lineitem GROUP BY 1)
SELECT k AS item_id, round(CASE WHEN k % 3 = 0 THEN 0.5 * b + 0.25 ELSE b END, 9) AS fidelity FROM (SELECT k, least(1.0, len(list_intersect(v, e)) / len(e)::DOUBLE + CASE WHEN k % 2 = 0 THEN 0.1 ELSE 0 END) AS b FROM t)""")
def fidelity(f: Frames) -> DataFrame:
    t = f["lineitem"].groupBy(F.col("l_orderkey").alias("item_id")).agg(F.collect_set(F.col("l_partkey") % 20).alias("v"), F.collect_set(F.col("l_suppkey") % 20).alias("e"))
    k = F.col("item_id")
    return t.select("item_id", F.round(M.trajectory_fidelity(F.col("v"), F.col("e"), k % 2 == 0, F.when(k % 3 == 0, 0.5)), 9).alias("fidelity"))


@PLANS.add("m7_structural_metrics", """
WITH t AS (SELECT l_orderkey AS k, list_distinct(list(l_partkey % 20)) AS u, list_distinct(list(l_suppkey % 20)) AS b FROM lineitem GROUP BY 1)
SELECT round(avg((len(list_intersect(u, b)) = len(b))::INT), 9) AS accession_binding, round(avg((len(list_filter(u, lambda x: contains('p' || x || '/s', 'p' || (k % 20)))) > 0)::INT), 9) AS section_path_hit,
  round(avg((len(b) < 2 OR len(list_intersect(u, b)) >= 2)::INT) FILTER (k % 2 = 0), 9) AS multi_filing_success FROM t""")
def structural(f: Frames) -> DataFrame:
    t = f["lineitem"].groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.col("l_partkey") % 20).alias("used"), F.collect_set(F.col("l_suppkey") % 20).alias("bound"))
    rows = t.select("used", "bound", F.transform("used", lambda x: F.concat(F.lit("p"), x, F.lit("/s"))).alias("visited"), F.array(F.concat(F.lit("p"), F.col("k") % 20)).alias("paths"), (F.col("k") % 2 == 0).alias("multi"))
    return _rounded(M.structural_metrics(rows), "accession_binding", "section_path_hit", "multi_filing_success")


@PLANS.add("m10_validate_trajectories", """
WITH t AS (SELECT conv_id, count(*) AS n, bool_or(turn % 4 = 3) AS astray, bool_or(role = '') AS blank FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 5 <> 0 AND astray THEN 'non_reproducible' WHEN conv_id % 5 = 0 AND conv_id % 2 = 0 THEN 'incomplete' WHEN blank THEN 'incomplete' ELSE 'complete' END AS validation FROM t""")
def trajectories(f: Frames) -> DataFrame:
    a, b = "0000000001-24-000001", "0000000002-24-000002"
    hop = F.struct(F.col("role").alias("node_type"), F.lit("CONTAINS").alias("edge_type"), F.when(F.col("turn") % 4 == 3, b).otherwise(a).alias("accession"))
    t = f["conversations"].groupBy("conv_id").agg(F.collect_list(hop).alias("hops"))
    k = F.col("conv_id")
    rows = t.select("conv_id", "hops", F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(a))).alias("route"), F.when(k % 2 == 0, "complete").otherwise("failed").alias("status"), F.lit(None).cast("string").alias("absent_reason"))
    return M.validate_trajectories(rows).select("conv_id", "validation")


@PLANS.add("m11_trajectory_gate", """
WITH t AS (SELECT conv_id, bool_or(turn % 4 = 3) AS astray, bool_or(role = '') AS blank FROM conversations GROUP BY 1),
v AS (SELECT CASE WHEN conv_id % 5 <> 0 AND astray THEN 'non_reproducible' WHEN (conv_id % 5 = 0 AND conv_id % 2 = 0) OR blank THEN 'incomplete' ELSE 'complete' END AS s FROM t)
SELECT count(*) AS total, count(*) FILTER (s = 'complete') AS complete, count(*) FILTER (s = 'incomplete') AS incomplete, count(*) FILTER (s = 'non_reproducible') AS non_reproducible,
  round(count(*) FILTER (s = 'complete') / count(*)::DOUBLE, 9) AS pass_rate, count(*) FILTER (s = 'complete') / count(*)::DOUBLE >= 0.9 AS passed FROM v""")
def gate(f: Frames) -> DataFrame:
    return _rounded(M.trajectory_gate(trajectories(f)), "pass_rate")


@PLANS.add("m24_phase_gate", """
WITH c AS (SELECT item_id FROM items WHERE profile = 'numeric' UNION ALL SELECT 'absent-1'), r AS (SELECT * FROM results WHERE variant_id = 'graph-full')
SELECT count(*) AS n, count(*) FILTER (coalesce(outcome, 0) > 0) AS positive, round(avg(coalesce(outcome, 0)), 9) AS mean_outcome, count(*) FILTER (coalesce(abstained, false)) AS abstained, count(*) FILTER (coalesce(outcome, 0) > 0) >= 20 AS passed FROM c LEFT JOIN r USING (item_id)""", ("items", "results"))
def phase(f: Frames) -> DataFrame:
    numeric = f["items"].where("profile = 'numeric'").select("item_id")
    cohort = numeric.unionByName(numeric.limit(1).select(F.lit("absent-1").alias("item_id")))
    return _rounded(M.phase_gate(cohort, f["results"].where("variant_id = 'graph-full'"), 20), "mean_outcome")


@PLANS.add("m27_materialization_audit", """
WITH t AS (SELECT l_orderkey AS k, list_distinct(list(l_partkey % 20)) AS u, list_distinct(list(l_suppkey % 20)) AS b FROM lineitem GROUP BY 1), m AS (SELECT k, list_sort(list_filter(b, lambda x: NOT list_contains(u, x))) AS m FROM t)
SELECT k AS item_id, array_to_string(m, ',') AS missing, len(m) > 0 AS binding_miss FROM m""")
def materialized(f: Frames) -> DataFrame:
    t = f["lineitem"].groupBy(F.col("l_orderkey").alias("item_id")).agg(F.collect_set(F.col("l_partkey") % 20).alias("used"), F.collect_set(F.col("l_suppkey") % 20).alias("bound"))
    return M.materialization_audit(t).withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))
