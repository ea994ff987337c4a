"""Queries over the review operators, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import segment_hint, split_camel_label
from ..operators import review as V
from ..operators.filings import fiscal_labels
from ..operators.ranking import dense_topk
from ..sources.views import Frames
from . import rules_sql as Q
from .filing_plans import _LABELLED
from .plan import Plans

PLANS = Plans()


@PLANS.add("m8_visited_sets", """
SELECT conv_id AS item_id, array_to_string(list_sort(list_distinct(list_concat(['r'], list('a' || (turn % 3))))), ',') AS accessions, array_to_string(list_sort(list_distinct(list('n' || (turn % 7)))), ',') AS visited FROM conversations GROUP BY 1""")
def visited(f: Frames) -> DataFrame:
    hop = F.struct(F.concat(F.lit("n"), F.col("turn") % 7).alias("node_id"), F.concat(F.lit("a"), F.col("turn") % 3).alias("accession"))
    t = f["conversations"].groupBy(F.col("conv_id").alias("item_id")).agg(F.collect_list(hop).alias("hops"))
    rows = t.withColumns({"route": F.array(F.lit("r"), F.lit("")), "evidence": F.lit(None).cast("array<struct<node_id:string,accession:string>>")})
    return V.visited_sets(rows).select("item_id", F.array_join("accessions", ",").alias("accessions"), F.array_join("visited", ",").alias("visited"))


@PLANS.add("m36_trajectory_hops", """
SELECT conv_id AS query_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, sha256(role || text)) - 1)::INT AS hop_index, role AS stage, sha256(role || text) AS node_id FROM conversations WHERE role <> 'system'""")
def hops(f: Frames) -> DataFrame:
    c = f["conversations"].select(F.col("conv_id").alias("query_id"), F.col("turn").alias("ordinal"), F.col("role").alias("stage"), F.sha2(F.concat("role", "text"), 256).alias("node_id"))
    return V.trajectory_hops(c, "system")


@PLANS.add("m37_evidence_paths", """
WITH v AS (SELECT l_orderkey AS query_id, l_suppkey AS node_id, arg_max(l_returnflag, (l_linenumber, l_partkey)) AS edge_type FROM lineitem GROUP BY 1, 2), e AS (SELECT DISTINCT l_orderkey AS query_id, l_linenumber AS rank, l_suppkey AS node_id FROM lineitem WHERE l_linenumber <= 2)
SELECT query_id, node_id, rank, edge_type FROM e LEFT JOIN v USING (query_id, node_id)""")
def paths(f: Frames) -> DataFrame:
    x = f["lineitem"].select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_suppkey").alias("node_id"), F.col("l_returnflag").alias("edge_type"), F.struct("l_linenumber", "l_partkey").alias("ordinal"))
    return V.evidence_paths(x.select("query_id", "rank", "node_id").distinct(), x, 2)


@PLANS.add("q24_quality_summary", """
WITH a AS (SELECT item_id, spot_check, failure_class FROM annotations QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, ordinal DESC) = 1), r AS (SELECT item_id, outcome FROM results WHERE variant_id = 'graph-full'),
g AS (SELECT count(failure_class) AS reviewed, count(*) FILTER (NOT spot_check) AS failed_check, count(*) FILTER (coalesce(outcome <= 0, true)) AS zero, count(*) FILTER (coalesce(outcome <= 0, true) AND failure_class = 'view') AS dataset_caused FROM r LEFT JOIN a USING (item_id))
SELECT *, round(dataset_caused / nullif(zero, 0)::DOUBLE, 9) AS dataset_rate FROM g""", ("annotations", "results"))
def summary(f: Frames) -> DataFrame:
    return V.quality_summary(f["annotations"], f["results"].where("variant_id = 'graph-full'")).withColumn("dataset_rate", F.round("dataset_rate", 9))


@PLANS.add("q24_rejudge_delta", """
WITH c AS (SELECT item_id, spot_check AS accepted, CASE WHEN failure_class = 'click' THEN 'Regenerate it' ELSE failure_class END AS rationale FROM annotations WHERE proposed IS NOT NULL),
n AS (SELECT count(*) FILTER (accepted) AS n_override, count(*) FILTER (accepted AND contains(lower(rationale), 'regenerate')) AS n_regenerate FROM c),
g AS (SELECT count(*) AS compared, count(*) FILTER (coalesce(a.outcome, 0) > coalesce(b.outcome, 0)) AS improved FROM results a JOIN results b ON a.item_id = b.item_id AND a.variant_id = 'graph-full' AND b.variant_id = 'flat-chunk' WHERE a.item_id IN (SELECT item_id FROM c WHERE accepted))
SELECT *, round(coalesce(improved / nullif(compared, 0)::DOUBLE, 0), 9) AS improved_rate FROM n, g""", ("annotations", "results"))
def rejudged(f: Frames) -> DataFrame:
    why = F.when(F.col("failure_class") == "click", "Regenerate it").otherwise(F.col("failure_class"))
    changes = f["annotations"].where("proposed IS NOT NULL").select("item_id", F.col("spot_check").alias("accepted"), why.alias("rationale"))
    r = f["results"]
    return V.rejudge_delta(r.where("variant_id = 'flat-chunk'"), r.where("variant_id = 'graph-full'"), changes).withColumn("improved_rate", F.round("improved_rate", 9))


@PLANS.add("m29_investigation_notes", """
WITH h AS (SELECT variant_id, item_id, unnest(list_filter([CASE WHEN coalesce(outcome <= 0.05, true) AND coalesce(mrr, 0) >= 0.5 THEN {'p': 'strong_retrieval_zero', 's': 3} END, CASE WHEN abstained THEN {'p': 'abstention', 's': 2} END, CASE WHEN mrr IS NULL THEN {'p': 'no_labels', 's': 1} END,
  CASE WHEN alignment < 0.05 THEN {'p': 'zero_alignment', 's': 2} END, CASE WHEN status <> 'complete' THEN {'p': 'ineligible', 's': 1} END, CASE WHEN coalesce(ndcg, 1) < 0.1 THEN {'p': 'ranked_low', 's': 1} END], lambda x: x IS NOT NULL)) AS h FROM results),
g AS (SELECT variant_id, h.p AS pattern, h.s AS severity, count(*) AS n, array_to_string(list_sort(list(item_id ORDER BY item_id)[:5]), ',') AS examples FROM h GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY severity DESC, n DESC, pattern)::INT AS position FROM g""", ("results",))
def notes(f: Frames) -> DataFrame:
    return V.investigation_notes(f["results"]).withColumn("examples", F.array_join("examples", ","))


_RUN = """
r AS (SELECT variant_id, item_id, status <> 'pending' AS judged, outcome, CASE WHEN profile_no = 2 THEN 0.0 ELSE ndcg END AS ndcg, CASE WHEN abstained OR (variant_id = 'ablation-no-walker' AND profile_no = 1) THEN 0 ELSE profile_no + 1 END AS n_citations, has_answer AS has_scores, profile_no <> 3 AS has_alignment FROM results),
v AS (SELECT variant_id, count(*) AS n, avg(outcome) AS oa, CASE WHEN variant_id IN ('flat-chunk', 'ablation-xbrl-only') THEN 0.0 ELSE avg(mrr) END AS mrr FROM results GROUP BY 1),
h AS (SELECT variant_id, avg(outcome) AS oa FROM results WHERE stratum = 'html' GROUP BY 1)"""


@PLANS.add("m29_aggregated_notes", f"""
WITH {_RUN}, f AS (SELECT *, judged AND n_citations = 0 AND variant_id <> 'flat-chunk' AS uncited, coalesce(outcome >= 0.9 AND ndcg = 0 AND variant_id NOT IN ('ablation-no-walker', 'ablation-xbrl-only'), false) AS unranked, judged AND has_scores AND NOT has_alignment AND outcome IS NOT NULL AS unaligned FROM r),
g AS (SELECT variant_id, sum(n_citations) AS cites, count(*) FILTER (uncited) AS uncited, count(*) FILTER (unranked) AS unranked, list_sort(list(item_id) FILTER (uncited))[:5] AS e1, list_sort(list(item_id) FILTER (unranked))[:5] AS e2 FROM f GROUP BY 1),
b AS (SELECT (SELECT oa FROM v WHERE variant_id = 'graph-full') AS base, (SELECT oa FROM v WHERE variant_id = 'flat-chunk') AS flat, (SELECT oa FROM h WHERE variant_id = 'graph-full') AS html, (SELECT oa FROM h WHERE variant_id = 'flat-chunk') AS html_flat),
w AS (SELECT list_sort(list(a.item_id))[:5] AS e FROM r a JOIN r b ON a.item_id = b.item_id AND a.variant_id = 'graph-full' AND b.variant_id = 'flat-chunk' AND b.outcome > a.outcome),
n AS (SELECT 'DUPLICATE_VARIANT_RUNS' AS pattern, 'warning' AS severity, NULL AS variant_id, 0 AS n, [] :: VARCHAR[] AS examples
  UNION ALL SELECT 'SMALL_SAMPLE', 'info', NULL, n, [] FROM v WHERE n <= 5 AND variant_id = 'ablation-no-macro'
  UNION ALL SELECT 'RUBRIC_ALIGNMENT_ZERO', 'warning', NULL, count(*), [] FROM v UNION ALL SELECT 'STRUCTURAL_METRICS_ZERO', 'warning', NULL, count(*), [] FROM v
  UNION ALL SELECT CASE WHEN variant_id LIKE '%walker' OR variant_id LIKE '%xbrl-only' THEN 'ABLATION_ZERO_CITATIONS' ELSE 'JUDGE_OK_ZERO_CITATIONS' END, CASE WHEN variant_id LIKE '%walker' OR variant_id LIKE '%xbrl-only' THEN 'info' ELSE 'warning' END, variant_id, uncited, e1 FROM g WHERE uncited > 0
  UNION ALL SELECT 'HIGH_OUTCOME_ZERO_NDCG', 'warning', variant_id, unranked, e2 FROM g WHERE unranked > 0
  UNION ALL SELECT 'FLAT_CHUNK_ZERO_RANKING', 'info', variant_id, n, [] FROM v JOIN g USING (variant_id) WHERE variant_id = 'flat-chunk' AND mrr <= 0 AND cites > 0 UNION ALL SELECT 'ABLATION_ZERO_RANKING', 'info', variant_id, n, [] FROM v WHERE variant_id IN ('ablation-no-walker', 'ablation-xbrl-only') AND mrr <= 0
  UNION ALL SELECT 'OUTCOME_EXCEEDS_BASELINE', 'info', variant_id, 1, [] FROM v JOIN g USING (variant_id), b WHERE variant_id <> 'graph-full' AND oa > base + 0.05 AND (cites > 0 OR coalesce(mrr, 0) > 0)
  UNION ALL SELECT 'OUTCOME_ORDERING_REGRESSION', 'warning', NULL, greatest(1, len(coalesce(e, []))), coalesce(e, []) FROM b, w WHERE coalesce(base <= flat, false) OR coalesce(html <= html_flat, false)
  UNION ALL SELECT 'INCOMPLETE_JUDGE_CRITERIA', 'warning', NULL, count(*) FILTER (unaligned), [] FROM f HAVING count(*) FILTER (unaligned) > 0)
SELECT pattern, severity, variant_id, n::BIGINT AS n, array_to_string(examples, ',') AS examples, row_number() OVER (ORDER BY CASE severity WHEN 'warning' THEN 1 ELSE 2 END, n DESC, pattern, variant_id)::INT AS position FROM n""", ("results",))
def run_notes(f: Frames) -> DataFrame:
    """A run listed twice, with rubrics and structural metrics of 0, and two variants that rank nothing."""
    r, flat = f["results"], F.col("variant_id").isin("flat-chunk", "ablation-xbrl-only")
    cites = F.when(F.col("abstained") | ((F.col("variant_id") == "ablation-no-walker") & (F.col("profile_no") == 1)), 0).otherwise(F.col("profile_no") + 1)
    rows = r.select("variant_id", "item_id", (F.col("status") != "pending").alias("judged"), "outcome", F.when(F.col("profile_no") == 2, 0.0).otherwise(F.col("ndcg")).alias("ndcg"), cites.alias("n_citations"), F.col("has_answer").alias("has_scores"), (F.col("profile_no") != 3).alias("has_alignment"))
    v = r.groupBy("variant_id").agg(F.count("*").alias("n_items"), F.avg("outcome").alias("outcome_accuracy"), F.avg("mrr").alias("mrr")).withColumns({"mrr": F.when(flat, 0.0).otherwise(F.col("mrr")), "rubric_alignment": F.lit(0.0)})
    headline = v.unpivot(["variant_id", "n_items"], ["outcome_accuracy", "mrr", "rubric_alignment"], "metric", "value")
    strata = r.groupBy("variant_id", "stratum").agg(F.avg("outcome").alias("value")).withColumn("metric", F.lit("outcome_accuracy"))
    structural = v.select("variant_id", F.lit(0.0).alias("binding_accuracy"), F.lit(0.0).alias("section_hit_rate"))
    runs = v.select("variant_id").unionAll(v.select("variant_id"))
    return V.aggregated_notes(rows, headline, structural, runs, strata).withColumn("examples", F.array_join("examples", ","))


@PLANS.add("m30_run_summary", """
WITH r AS (SELECT event_type AS variant_id, CASE WHEN event_id % 2 = 0 THEN 'run-' || event_id ELSE '' END AS run_id, ts AS started FROM events), o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY (run_id = '')::INT, started DESC, run_id) = 1)
SELECT variant_id, count(*) AS n_items, any_value(o.run_id) AS run_id FROM r JOIN o USING (variant_id) GROUP BY 1""")
def runs(f: Frames) -> DataFrame:
    e = f["events"].select(F.col("event_type").alias("variant_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("run-"), "event_id")).otherwise("").alias("run_id"), F.col("ts").alias("started"))
    return V.run_summary(e, e)


@PLANS.add("m31_suite_means", "SELECT 'item' AS suite, count(*) AS n, round(avg(outcome), 9) AS outcome, round(avg(alignment), 9) AS alignment FROM results", ("results",))
def suites(f: Frames) -> DataFrame:
    return V.suite_means(f["results"]).withColumns({c: F.round(c, 9) for c in ("outcome", "alignment")})


@PLANS.add("m34_item_records", """
SELECT variant_id, item_id, coalesce(outcome, 0)::DOUBLE AS outcome, coalesce(mrr, 0) >= 0.5 AS good_retrieval, CASE WHEN status <> 'complete' THEN status WHEN abstained THEN 'abstained' WHEN coalesce(outcome, 0) <= 0 THEN 'zero_outcome' END AS failure_reason FROM results""", ("results",))
def records(f: Frames) -> DataFrame:
    return V.item_records(f["results"])


@PLANS.add("m26_weakest_criterion", """
SELECT variant_id, item_id, CASE WHEN coalesce(mrr, 9) <= coalesce(ndcg, 9) AND coalesce(mrr, 9) <= alignment THEN CASE WHEN mrr = alignment THEN 'alignment' ELSE 'mrr' END WHEN coalesce(ndcg, 9) < alignment THEN 'ndcg' ELSE 'alignment' END AS weakest FROM results""", ("results",))
def weakest(f: Frames) -> DataFrame:
    pairs = [x for n in ("alignment", "mrr", "ndcg") for x in (F.lit(n), F.coalesce(n, F.lit(9.0)))]
    return f["results"].select("variant_id", "item_id", V.weakest_criterion(F.create_map(*pairs, F.lit("trajectory_fidelity"), F.lit(0.0))).alias("weakest"))


_THEMES = ["the", "of", "and", "der", "die", "que", "la", "le"]


@PLANS.add("e11_theme_classes", """
WITH m AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(text, '[^A-Za-z0-9_]+'), lambda x: lower(x) IN ('the', 'of', 'and', 'der', 'die', 'que', 'la', 'le')))) AS s FROM documents), c AS (SELECT DISTINCT s FROM m WHERE len(s) > 0)
SELECT array_to_string(a.s, ',') AS a, array_to_string(b.s, ',') AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE, 9) AS similarity FROM c a JOIN c b ON array_to_string(a.s, ',') < array_to_string(b.s, ',') AND len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE >= 0.82""")
def themes(f: Frames) -> DataFrame:
    _, links = V.theme_classes(f["documents"], _THEMES)
    return links.select(F.array_join("a", ",").alias("a"), F.array_join("b", ",").alias("b"), F.round("similarity", 9).alias("similarity"))


@PLANS.add("f17_ratio_roles", """
SELECT DISTINCT a.concept AS first, b.concept AS second, CASE WHEN a.concept = 'NetIncomeLoss' AND b.concept = 'Revenues' THEN a.concept WHEN b.concept = 'NetIncomeLoss' AND a.concept = 'Revenues' THEN b.concept END AS numerator FROM (SELECT DISTINCT concept FROM facts) a, (SELECT DISTINCT concept FROM facts) b WHERE a.concept < b.concept""", ("facts",))
def roles(f: Frames) -> DataFrame:
    # The two concepts of a ratio are facts of one filing.
    c = V.filed_together(f["facts"])
    return c.select("first", "second", V.assign_ratio_roles(F.col("first"), F.col("second"), ["NetIncomeLoss"], ["Revenues"])["numerator"].alias("numerator"))


@PLANS.add("r14_compare_pairs", """
WITH e AS (SELECT o_custkey AS query_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS side, o_orderkey FROM orders), l AS (SELECT query_id, side, min(o_orderkey) AS e FROM e GROUP BY 1, 2)
SELECT a.query_id, a.e AS first, b.e AS second FROM l a JOIN l b ON a.query_id = b.query_id AND a.side = 1 AND b.side = 2""")
def pairs(f: Frames) -> DataFrame:
    k = F.col("o_orderkey")
    return V.compare_pairs(f["orders"].select(F.col("o_custkey").alias("query_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("side"), k.alias("rank"), k.alias("excerpt")))


@PLANS.add("f12_merge_evidence", """
SELECT query_id, chunk_id, min(s) AS source FROM (SELECT l_orderkey AS query_id, l_suppkey AS chunk_id, 0 AS s FROM lineitem WHERE l_linenumber = 2 UNION ALL SELECT l_orderkey, l_suppkey, 1 FROM lineitem) GROUP BY 1, 2""")
def merged(f: Frames) -> DataFrame:
    x = f["lineitem"].select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("chunk_id"), "l_linenumber")
    return V.merge_evidence(x.where("l_linenumber = 2").withColumn("source", F.lit(0)), x.withColumn("source", F.lit(1))).select("query_id", "chunk_id", "source")


@PLANS.add("f22_table_value", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), v AS (SELECT doc_id, pos, nullif(regexp_extract(line, '[0-9][0-9,]*(?:\.[0-9]+)?'), '') AS n FROM l WHERE regexp_matches(line, '[Ll]icen[sc]ed?|@|[0-9]'))
SELECT doc_id, replace(arg_min(n, pos), ',', '')::DOUBLE AS value FROM v WHERE n IS NOT NULL GROUP BY 1""")
def values(f: Frames) -> DataFrame:
    return V.table_value(f["documents"], "[Ll]icen[sc]ed?|@|[0-9]")


@PLANS.add("d4_corpus_hash", "SELECT c_custkey AS corpus_id, left(sha256('balance=' || (c_custkey % 7) || '|segment=' || c_mktsegment), 16) AS hash FROM customer")
def corpus_hash(f: Frames) -> DataFrame:
    return V.corpus_hash(f["customer"].select(F.col("c_custkey").alias("corpus_id"), F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") % 7).alias("balance")))


@PLANS.add("d17_scope_manifest", f"""
WITH {_LABELLED}, b AS (SELECT issuer_id * 10 AS query_id, issuer_id, accession, label, filed_at FROM labelled JOIN (SELECT accession FROM recent WHERE n = 2) USING (accession)), g AS (SELECT query_id, issuer_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(filed_at) AS last FROM b GROUP BY 1, 2)
SELECT query_id, labels, (SELECT count(*) FROM filings f WHERE f.issuer_id = g.issuer_id AND f.filed_at > g.last) AS n_newer, (SELECT count(*) FROM filings f WHERE f.issuer_id = g.issuer_id AND f.filed_at > g.last) > 0 AS stale FROM g""", ("recent",))
def manifest(f: Frames) -> DataFrame:
    bound = f["recent"].where("n = 2").select((F.col("issuer_id") * 10).alias("query_id"), "accession")
    return V.scope_manifest(bound, fiscal_labels(f["filings"])).withColumn("labels", F.array_join("labels", ","))


@PLANS.add("q18_refine_fact_labels", """
WITH c AS (SELECT l_orderkey AS item_id, l_linenumber AS chunk_id, bool_and(l_orderkey % 3 <> 0) AS f, bool_or(l_returnflag = 'A') AS c, bool_or(l_linestatus = 'F') AS v FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, bool_and(f) OVER p AS allf, bool_or(c) OVER p AS anyc FROM c WINDOW p AS (PARTITION BY item_id)), x AS (SELECT *, bool_or((NOT anyc OR c) AND v) OVER (PARTITION BY item_id) AS anyv FROM w)
SELECT item_id, chunk_id FROM x WHERE NOT allf OR ((NOT anyc OR c) AND (NOT anyv OR v))""")
def refine(f: Frames) -> DataFrame:
    g = f["lineitem"].groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("chunk_id"))
    rows = g.agg(F.max(F.col("l_returnflag") == "A").alias("concept_hit"), F.max(F.col("l_linestatus") == "F").alias("value_hit")).withColumn("is_fact", F.col("item_id") % 3 != 0)
    return V.refine_fact_labels(rows)


@PLANS.add("m32_failure_pack", """
WITH a AS (SELECT item_id, failure_class, proposed FROM annotations QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, ordinal DESC) = 1)
SELECT r.variant_id, i.item_id, i.answer_type, r.outcome, a.failure_class AS reviewed_class, a.proposed FROM items i JOIN results r ON r.item_id = i.item_id LEFT JOIN a ON a.item_id = i.item_id""", ("items", "results", "annotations"))
def pack(f: Frames) -> DataFrame:
    items = f["items"].select("item_id", "answer_type")
    return V.failure_pack(items, f["results"].select("variant_id", "item_id", "outcome"), f["annotations"]).select("variant_id", "item_id", "answer_type", "outcome", "reviewed_class", "proposed")


@PLANS.add("m23_cohort_report", """
SELECT r.variant_id, count(*) AS n, count(*) FILTER (coalesce(r.outcome <= 0, true)) AS zero, count(*) FILTER (coalesce(r.outcome <= 0, true) AND coalesce(r.mrr, 0) >= 0.5) AS strong_zero, round(avg(r.outcome - b.outcome), 9) AS mean_change
FROM results r LEFT JOIN results b ON b.item_id = r.item_id AND b.variant_id = 'graph-full' GROUP BY 1""", ("results",))
def cohort(f: Frames) -> DataFrame:
    base = f["results"].where("variant_id = 'graph-full'").select("item_id", F.col("outcome").alias("base"))
    return V.cohort_report(f["results"], base).withColumn("mean_change", F.round("mean_change", 9))


@PLANS.add("h16_export_path_index", "SELECT DISTINCT regexp_extract(node_id, '[0-9]{10}-[0-9]{2}-[0-9]{6}') || '/' || regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g') AS path FROM doc_lines", ("doc_lines",))
def index(f: Frames) -> DataFrame:
    return V.path_index(f["doc_lines"].select("node_id", F.col("source").alias("label")))


@PLANS.add("f5_label_roles", """
SELECT fact_id, CASE concept WHEN 'NetIncomeLoss' THEN 'net_income' WHEN 'IncomeLossBeforeIncomeTaxes' THEN 'pretax_income' WHEN 'Revenues' THEN 'revenue' WHEN 'CostOfRevenue' THEN 'revenue' WHEN 'StockholdersEquity' THEN 'total_equity' WHEN 'Assets' THEN 'total_assets' WHEN 'LiabilitiesCurrent' THEN 'total_liabilities' ELSE '' END AS roles FROM facts""", ("facts",))
def suggested(f: Frames) -> DataFrame:
    return f["facts"].select("fact_id", F.array_join(V.label_roles(split_camel_label(F.col("concept"))), ",").alias("roles"))


@PLANS.add("b36_segment_hint", """
SELECT query_id, CASE WHEN query_id % 12 = 7 THEN 'Energy Products' END AS segment FROM questions""", ("questions",))
def segment(f: Frames) -> DataFrame:
    return f["questions"].select("query_id", segment_hint(F.col("question")).alias("segment"))


@PLANS.add("q10_feasibility_report", """
WITH x AS (SELECT doc_id, unnest(list_filter([CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN doc_id % 5 = 0 THEN 'unbindable' END], lambda x: x IS NOT NULL)) AS reason FROM labels)
SELECT reason, count(*) AS n, min('item-' || doc_id) AS example FROM x GROUP BY 1""")
def feasibility(f: Frames) -> DataFrame:
    codes = F.array_compact(F.array(F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("doc_id") % 5 == 0, "unbindable")))
    return V.feasibility_report(f["labels"].select(F.concat(F.lit("item-"), "doc_id").alias("item_id"), codes.alias("errors")))


@PLANS.add("g5_validate_documents", """
SELECT doc_id, concat_ws(',', CASE WHEN (doc_id % 10) / 10.0 < 0.5 THEN 'low_confidence' END, CASE WHEN doc_id % 3 = 0 THEN 'no_tables' END, CASE WHEN doc_id % 7 = 0 THEN 'empty_html_section' END) AS errors FROM documents""")
def checked(f: Frames) -> DataFrame:
    d = F.col("doc_id")
    rows = f["documents"].select("doc_id", F.lit("10-K").alias("form_type"), ((d % 10) / 10.0).alias("confidence"), (d % 3).alias("n_tables"), (d % 7 == 0).cast("int").alias("n_empty_html"))
    return V.validate_documents(rows).select("doc_id", F.array_join("errors", ",").alias("errors"))


@PLANS.add("h15_gold_path_eval", """
WITH h AS (SELECT l_orderkey AS k, list_distinct(list(l_suppkey % 5)) AS h FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey, coalesce(list_contains(h, o_custkey % 5), false) AND o_orderkey % 10 <> 0 AS r FROM orders LEFT JOIN h ON k = o_orderkey)
SELECT count(*) AS n, round(avg(r::INT), 9) AS reach_rate, round(avg((o_orderkey % 4 <> 0)::INT) FILTER (r), 9) AS path_rate, avg(r::INT) >= 0.75 AND avg((o_orderkey % 4 <> 0)::INT) FILTER (r) >= 0.9 AS passed FROM r""")
def gold(f: Frames) -> DataFrame:
    k = F.col("o_orderkey")
    items = f["orders"].select(k.alias("item_id"), F.array((F.col("o_custkey") % 5).cast("string")).alias("required"), (k % 10 == 0).alias("full_scan"), (k % 4 != 0).alias("path_matched"))
    evidence = f["lineitem"].select(F.col("l_orderkey").alias("item_id"), (F.col("l_suppkey") % 5).cast("string").alias("chunk_id"))
    return V.gold_path_eval(items, evidence).withColumns({c: F.round(c, 9) for c in ("reach_rate", "path_rate")})


@PLANS.add("m33_binding_eval", """
WITH e AS (SELECT l_orderkey AS q, list_sort(list_distinct(list(l_suppkey % 3))) AS e, list_sort(list_distinct(list(l_suppkey % 3) FILTER (l_linenumber <= 3))) AS p FROM lineitem GROUP BY 1)
SELECT count(*) AS n, round(avg(coalesce(p = e, false)::INT), 9) AS accuracy, round(avg((len(e) > 1)::INT), 9) AS multi_share, avg(coalesce(p = e, false)::INT) >= 0.7 AND avg((len(e) > 1)::INT) >= 0.8 AS passed FROM e""")
def binding(f: Frames) -> DataFrame:
    rows = f["lineitem"].select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 3).alias("accession"), "l_linenumber")
    return V.binding_eval(rows.where("l_linenumber <= 3"), rows).withColumns({c: F.round(c, 9) for c in ("accuracy", "multi_share")})


@PLANS.add("q25_review_pack", """
WITH c AS (SELECT o_custkey, string_agg(o_orderpriority, ' | ' ORDER BY o_orderkey) AS cited FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 8) GROUP BY 1) SELECT c_custkey AS item_id, cited FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def packed(f: Frames) -> DataFrame:
    cited = f["orders"].select(F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("rank"), F.col("o_orderpriority").alias("excerpt"))
    return V.review_pack(f["customer"].select(F.col("c_custkey").alias("item_id")), cited)


@PLANS.add("q33_cohort_ids", "SELECT DISTINCT item_id FROM results WHERE variant_id <> 'flat-chunk' AND profile_no = 2", ("results",))
def ids(f: Frames) -> DataFrame:
    return V.cohort_ids(f["results"].where("variant_id <> 'flat-chunk'").withColumn("tier", F.col("profile_no")), 2)


@PLANS.add("r9_dense_answer", """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(x, embedding::DOUBLE[]), 9) AS score FROM q, embeddings),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 3) SELECT query_id, string_agg(rank || ':' || vec_id || ':' || label, ',' ORDER BY rank) AS citations FROM t GROUP BY 1""")
def answer(f: Frames) -> DataFrame:
    q = f["embeddings"].where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = V.dense_answer(dense_topk(q, f["embeddings"], 3), f["embeddings"].select("vec_id", "label"))
    return rows.select("query_id", F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["rank"], c["vec_id"], c["label"])), ",").alias("citations"))


@PLANS.add("f15_best_facts", f"""
WITH p AS (SELECT query_id, fact_id, period_end, strftime(period_start, '%m-%d') = '01-01' AND strftime(period_end, '%m-%d') = '12-31' AS annual FROM (SELECT *, lower(question) AS q FROM questions) q JOIN facts f ON f.issuer_id = q.issuer_id WHERE {Q.matches("concept", "q")})
SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY annual DESC, period_end DESC, fact_id)::INT AS position FROM p QUALIFY position <= 2""", ("questions", "facts"))
def best(f: Frames) -> DataFrame:
    return V.best_facts(f["questions"], f["facts"], 2)


@PLANS.add("e1_document_nodes", "SELECT DISTINCT 'doc-' || accession AS node_id, 'DOCUMENT' AS node_type, form_type || ' ' || period_end::VARCHAR AS label FROM filings", ("filings",))
def documents(f: Frames) -> DataFrame:
    return V.document_nodes(f["filings"])


@PLANS.add("e4_labelled_facts", """
WITH t AS (SELECT concept, CASE WHEN concept = 'Assets' THEN '' WHEN concept <> 'NetIncomeLoss' THEN 'Standard ' || concept || repeat(' of the filing', 6) END AS label, left(concept, 3) AS metric_role FROM (SELECT DISTINCT concept FROM facts WHERE concept <> 'InventoryNet'))
SELECT DISTINCT 'doc-' || accession || '-xbrl-facts' AS node_id, 'SECTION' AS node_type, 'XBRL Financial Facts' AS label, NULL AS metric_role, 'xbrl' AS source_ref FROM excerpts
UNION ALL SELECT fact_id, 'CHUNK_XBRL_FACT', left(coalesce(nullif(label, ''), CASE WHEN length(fact_id) % 2 = 0 THEN 'us-gaap:' ELSE '' END || e.concept), 80), metric_role, excerpt FROM excerpts e LEFT JOIN t ON t.concept = e.concept""", ("facts", "excerpts"))
def labelled_facts(f: Frames) -> DataFrame:
    c = F.col("concept")
    label = F.when(c == "Assets", "").when(c != "NetIncomeLoss", F.concat(F.lit("Standard "), c, F.repeat(F.lit(" of the filing"), 6)))
    taxonomy = f["facts"].select("concept").distinct().where("concept <> 'InventoryNet'").select("concept", label.alias("label"), F.left(c, F.lit(3)).alias("metric_role"))
    facts = f["excerpts"].withColumn("concept", F.when(F.length("fact_id") % 2 == 0, F.concat(F.lit("us-gaap:"), c)).otherwise(c))
    return V.fact_nodes(facts, taxonomy)


@PLANS.add("e4_fact_nodes", "SELECT DISTINCT 'doc-' || accession AS source_id, 'doc-' || accession || '-xbrl-facts' AS target_id, 'CONTAINS' AS edge_type FROM facts UNION ALL SELECT 'doc-' || accession || '-xbrl-facts', fact_id, 'CONTAINS' FROM facts", ("facts",))
def fact_edges(f: Frames) -> DataFrame:
    return V.fact_nodes_edges(f["facts"])


@PLANS.add("m36_trajectory_route", """
SELECT query_id, position, accession, form_type, cik, filed_at::VARCHAR AS filed_at, period_end::VARCHAR AS period_end, CASE WHEN form_type = '10-K' THEN 'FY' || year(period_end) ELSE period_end::VARCHAR END AS label
FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY accession) - 1)::INT AS position, r.* FROM questions JOIN recent r USING (issuer_id))""", ("questions", "recent"))
def route(f: Frames) -> DataFrame:
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("accession")) - 1
    bound = f["questions"].join(f["recent"].select("issuer_id", "accession").hint("merge"), "issuer_id").select("query_id", position.alias("position"), "accession")
    gone = bound.where("position = 0").withColumn("accession", F.lit("gone"))
    return V.trajectory_route(bound.unionByName(gone), f["filings"])


@PLANS.add("m36_trajectory_evidence", """
WITH e AS (SELECT user_id AS query_id, event_id, event_type, value FROM events), p AS (SELECT DISTINCT query_id FROM e WHERE event_id % 5 = 0)
SELECT query_id, CASE WHEN event_id % 3 = 0 THEN 'doc-0000000001-02-' || lpad((event_id % 1000000)::VARCHAR, 6, '0') || '-c' ELSE 'chunk-' || event_id END AS chunk_id, sha256(event_type) AS content_hash, CASE WHEN event_id % 4 = 1 THEN event_type WHEN event_id % 3 = 0 THEN 'doc-0000000001-02-' || lpad((event_id % 1000000)::VARCHAR, 6, '0') || '-c' ELSE 'chunk-' || event_id END AS citation_label,
  CASE WHEN event_id % 7 = 0 THEN 'narrative' WHEN event_id % 2 = 0 THEN 'xbrl' ELSE 'html' END AS source_type, CASE WHEN event_id % 6 <> 0 AND event_id % 3 = 0 THEN '0000000001-02-' || lpad((event_id % 1000000)::VARCHAR, 6, '0') WHEN event_id % 6 = 0 THEN 'own' ELSE '' END AS accession,
  nullif(event_type, 'view') AS section_id, event_id % 5 = 0 OR query_id NOT IN (SELECT query_id FROM p) AS in_prompt FROM e""")
def exported(f: Frames) -> DataFrame:
    n, e = F.col("event_id"), f["events"]
    chunk = F.when(n % 3 == 0, F.concat(F.lit("doc-0000000001-02-"), F.lpad((n % 1000000).cast("string"), 6, "0"), F.lit("-c"))).otherwise(F.concat(F.lit("chunk-"), n))
    rows = e.select(F.col("user_id").alias("query_id"), chunk.alias("chunk_id"), F.sha2("event_type", 256).alias("content_hash"), F.when(n % 4 == 1, F.col("event_type")).when(n % 4 == 2, "").alias("citation"),
        F.when(n % 7 == 0, F.lit(None)).when(n % 2 == 0, "XBRL").otherwise("HTML").alias("source"), F.when(n % 6 == 0, "own").alias("accession"), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("section_id"))
    return V.trajectory_evidence(rows, e.where(n % 5 == 0).select(F.col("user_id").alias("query_id"), chunk.alias("chunk_id")))


@PLANS.add("m9_hydrate_evidence", """
SELECT l_orderkey AS query_id, array_to_string(CASE WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag = 'A') ELSE list(l_suppkey ORDER BY l_linenumber, l_suppkey) END, ',') AS evidence FROM lineitem GROUP BY 1""")
def hydrated(f: Frames) -> DataFrame:
    in_order = lambda c, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("l_linenumber", F.col(c).alias("v"))))), lambda x: x["v"])
    found = F.col("l_returnflag") == "A"
    rows = f["lineitem"].groupBy(F.col("l_orderkey").alias("query_id")).agg(in_order("l_partkey", found).alias("e"), in_order("l_suppkey", F.lit(True)).alias("citations"))
    rows = rows.withColumn("evidence", F.when(F.col("query_id") % 2 == 0, F.nullif("e", F.array().cast("array<bigint>"))).otherwise(F.col("e")))
    return V.hydrate_evidence(rows).select("query_id", F.array_join("evidence", ",").alias("evidence"))


@PLANS.add("g9_divestiture_facts", """
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN (c_nationkey + 0.5) * 1e9 ELSE (c_custkey % 100) * 1e6 END::DOUBLE AS amount, 'the ' || lower(c_mktsegment) || ' unit' AS asset FROM customer WHERE c_acctbal > 0""")
def sales(f: Frames) -> DataFrame:
    """Customers with a positive balance sold a unit; others say less than that."""
    scale = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_nationkey", F.lit(".5 billion, and SOLD a part for $1 million"))).otherwise(F.concat(F.col("c_custkey") % 100, F.lit(" Million")))
    text = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("In June "), "c_name", F.lit(" Sold the "), F.lower("c_mktsegment"), F.lit(" unit for $"), scale)).when(F.col("c_custkey") % 2 == 0, "They sold 3 units for $5 billion").otherwise("sold the unit for 5 billion")
    return V.divestiture_facts(f["customer"].select(F.col("c_custkey").alias("doc_id"), text.alias("text")))
