"""Queries over checks of bindings, facts, results and reviews, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audits as A
from ..operators import binding as B
from ..functions import comparison as C
from ..sources.views import Frames
from . import rules_sql as Q
from .binding_plans import _BOUND
from .plan import Plans

PLANS = Plans()
_FLAGS = Q.flags("lower(question)")
_CUES = f"({_FLAGS['is_comparison']} OR {Q.has('lower(question)', *A.YOY_CUES, *A.QOQ_CUES)})"
_ASKED = "lower(question)"
_ANCHORED = (
    f"(NOT {Q.has(_ASKED, 'quarter over quarter', 'qoq', 'sequential quarter')} AND ({Q.has(_ASKED, 'prior quarter', 'previous quarter', *S.QUARTER_CUES)} "
    f"OR ({Q.has(_ASKED, 'annual report', 'latest 10-k', '10-k', '10k', 'fiscal year')} AND NOT {Q.has(_ASKED, 'quarter', '10-q', '10 q')}) OR (contains({_ASKED}, 'risk factor') AND NOT contains({_ASKED}, 'quarter'))))"
)
_MIXED = f"({Q.has('lower(question)', *A.YOY_CUES)} AND {Q.has('lower(question)', *A.QOQ_CUES)})"


def _proposals(f: Frames) -> DataFrame:
    lists = {n: F.array_compact(F.array(n)) for n in ("pinned", "proposed")}
    return f["proposals"].withColumns(lists)


@PLANS.add("d9_validate_binding", f"""
WITH {_BOUND}, k AS (SELECT DISTINCT issuer_id, accession, form_type, year(period_end) AS yr FROM filings),
r AS (SELECT p.*, (SELECT count(DISTINCT accession) FROM bound b WHERE b.query_id = p.query_id) AS n_bound, a.form_type AS pinned_form, a.yr AS pinned_year, c.accession AS known,
  p.issuer_id IN (SELECT issuer_id FROM filings) AS corpus, {_CUES} AS cue, {_MIXED} AS mixed,
  {_ANCHORED} AS named
  FROM proposals p LEFT JOIN k a ON a.issuer_id = p.issuer_id AND a.accession = p.pinned LEFT JOIN k c ON c.issuer_id = p.issuer_id AND c.accession = p.proposed),
h AS (SELECT *, CASE WHEN proposed IS NOT NULL THEN CASE WHEN known IS NOT NULL THEN 1 ELSE 0 END ELSE n_bound END AS have FROM r),
c AS (SELECT query_id, have, CASE WHEN NOT corpus THEN 'empty_corpus' WHEN mixed THEN 'ambiguous_comparison' WHEN pinned IS NOT NULL AND proposed IS NOT NULL AND pinned <> proposed THEN 'cli_nl_conflict'
  WHEN pinned IS NOT NULL THEN CASE WHEN target_year IS NOT NULL AND form = '10-K' AND coalesce(pinned_form <> '10-K' OR pinned_year <> target_year, true) THEN 'temporal_mismatch' END
  WHEN coalesce(summary, '') = '' AND NOT named AND proposed IS NULL THEN 'invalid_proposal' WHEN have = 0 AND NOT cue THEN 'invalid_pairing' WHEN cue AND have < 2 THEN 'missing_comparison_partner' END AS code FROM h)
SELECT query_id, CASE WHEN code IS NULL THEN 'approved' WHEN code = 'missing_comparison_partner' AND have = 1 THEN 'narrowed' ELSE 'failed' END AS status, code FROM c""", ("filings", "questions", "proposals"))
def validated(f: Frames) -> DataFrame:
    return A.validate_binding(_proposals(f), B.bind_filings(f["questions"], f["filings"]), f["filings"])


@PLANS.add("q12_macro_bindability", f"""
WITH k AS (SELECT DISTINCT issuer_id, accession FROM filings), r AS (SELECT query_id, {_MIXED} AS mixed, list_filter([pinned, proposed], lambda x: x IS NOT NULL) AS a, (pinned IS NULL OR (p.issuer_id, pinned) IN (SELECT (issuer_id, accession) FROM k)) AND (proposed IS NULL OR (p.issuer_id, proposed) IN (SELECT (issuer_id, accession) FROM k)) AS known FROM proposals p)
SELECT query_id AS item_id, CASE WHEN len(a) = 0 THEN 'missing_accessions' WHEN NOT known THEN 'not_in_manifest' ELSE 'ambiguous_comparison' END AS detail FROM r WHERE len(a) = 0 OR NOT known OR mixed""", ("filings", "proposals"))
def bindability(f: Frames) -> DataFrame:
    accessions = F.array_compact(F.array("pinned", "proposed")).alias("accessions")
    return A.macro_bindability(f["proposals"].select(F.col("query_id").alias("item_id"), "issuer_id", "question", accessions), f["filings"])


_FAMILY = "CASE issuer_id % 6 WHEN 0 THEN 'margin' WHEN 1 THEN 'margin' WHEN 2 THEN 'tax_rate' WHEN 3 THEN 'equity' WHEN 4 THEN 'assets' ELSE 'segment_revenue' END"
_SEGMENT = "CASE WHEN concept = 'Revenues' THEN 'Upstream' WHEN value_num % 2 = 0 THEN 'Energy Products' END"
_PICKED = f"""SELECT accession, {_FAMILY} AS family, 'upstream' AS segment, year(period_end) + CASE WHEN issuer_id % 5 = 0 THEN 1 ELSE 0 END AS target_year, form_type AS form,
  concept, period_start, CASE WHEN value_num % 5 = 0 THEN period_start ELSE period_end END AS period_end, (form_type = '10-K' AND value_num % 4 <> 1) AS is_annual, {_SEGMENT} AS fact_segment FROM facts WHERE value_num % 4 < 2"""
_SIDES = {i: "CASE " + " ".join(f"WHEN family = '{n}' THEN {Q.like('{0}', p[i])} AND NOT {Q.like('{0}', p[2])}" for n, p in A.RATIO_SIDES.items()) + " ELSE false END" for i in (0, 1)}
_FORBID = "CASE " + " ".join(f"WHEN family = '{n}' THEN regexp_matches(concept, {Q.quoted(p)})" for n, p in A.FORBIDDEN.items()) + " ELSE false END"


@PLANS.add("f18_validate_resolution", f"""
WITH p AS ({_PICKED}), g AS (SELECT accession, any_value(family) AS family, count(*) AS n, min(concept) AS a, max(concept) AS b, min_by(period_end, concept) AS ea, max_by(period_end, concept) AS eb,
  bool_or(NOT {Q.passes("concept", "family")}) AS guard, bool_or({_FORBID}) AS forbid, bool_or(NOT ({Q.fits("period_start", "period_end", "is_annual", "target_year", "form")})) AS period,
  bool_or(form = '10-K' AND NOT is_annual AND year(period_end) <> target_year) AS interim, bool_or(NOT coalesce(contains(lower(fact_segment), segment), false)) AS segment FROM p GROUP BY 1),
s AS (SELECT *, n = 2 AND family IN ('margin', 'tax_rate') AS ratio, ({_SIDES[0].replace("{0}", "a")}) AND ({_SIDES[1].replace("{0}", "b")}) AS straight, ({_SIDES[0].replace("{0}", "b")}) AND ({_SIDES[1].replace("{0}", "a")}) AS crossed FROM g),
t AS (SELECT *, CASE WHEN NOT straight AND crossed THEN b ELSE a END AS num, CASE WHEN NOT straight AND crossed THEN a ELSE b END AS den FROM s)
SELECT accession, concat_ws(',', CASE WHEN forbid THEN 'forbidden' END, CASE WHEN guard THEN 'guard' END, CASE WHEN interim THEN 'interim' END, CASE WHEN ratio AND family = 'margin' AND den <> 'Revenues' THEN 'missing_revenue_role' END, CASE WHEN ratio AND ea <> eb THEN 'mixed_periods' END, CASE WHEN period THEN 'period' END,
  CASE WHEN ratio AND family = 'margin' AND num = 'IncomeLossBeforeIncomeTaxes' THEN 'pretax_numerator' END, CASE WHEN ratio AND NOT straight AND NOT crossed THEN 'ratio_roles' END, CASE WHEN family = 'segment_revenue' AND segment THEN 'segment' END, CASE WHEN n < 2 THEN 'too_few_facts' END) AS rejections FROM t""", ("facts",))
def resolution(f: Frames) -> DataFrame:
    picked = f.spark.sql(_PICKED.replace("FROM facts", "FROM {facts}"), facts=f["facts"])
    fact = F.struct("concept", "period_start", "period_end", "is_annual", F.col("fact_segment").alias("segment"))
    rows = picked.groupBy("accession", "family", "segment", "target_year", "form").agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    return A.validate_resolution(rows, 2).select("accession", F.array_join("rejections", ",").alias("rejections"))


_NUM = r"try_cast(nullif(regexp_extract(replace({0}, ',', ''), '([0-9]+\.?[0-9]*)', 1), '') AS DOUBLE)"
_CLASSED = rf"""
j AS (SELECT *, {_NUM.replace("{0}", "answer")} AS x, {_NUM.replace("{0}", "truth")} AS y, coalesce(mrr, 0) >= 0.5 AS found, coalesce(outcome, 0) <= 0 AS zero, regexp_matches(answer, '[0-9,]+') AS digits FROM judged),
n AS (SELECT *, coalesce(CASE WHEN y = 0 THEN x = 0 ELSE abs(x / y) BETWEEN 0.05 AND 20 END, false) AS near FROM j),
classed AS (SELECT variant_id, item_id, outcome, CASE WHEN (answer = '' OR {Q.like("answer", "insufficient evidence|cannot determine|not available in")}) AND NOT near THEN 'abstention' WHEN binding_miss OR contains(lower(coalesce(rationale, '')), 'wrong filing') THEN 'binding_error'
  WHEN starts_with(answer, 'Based on') AND contains(lower(answer), 'evidence chunk') AND coalesce(path, '') <> 'cached' AND zero THEN 'synthesis_template_dump'
  WHEN (numeric OR regexp_matches(truth, '[0-9,]')) AND found AND contains(upper(section_path), 'XBRL') AND NOT near THEN 'numeric_xbrl_miss' WHEN comparison AND zero AND NOT contains(answer, 'whereas') THEN 'comparison_narrative_miss'
  WHEN found AND retrieval_fidelity = 0 THEN 'retrieval_label_mismatch' WHEN found AND zero AND digits AND ((contains(question, 'billion') AND NOT contains(truth, 'million') AND near) OR (contains(truth, 'million') AND NOT contains(answer, 'million'))) THEN 'gt_issue_suspected' END AS failure_class FROM n)"""


def _classed(f: Frames) -> DataFrame:
    return A.failure_class(f["judged"].withColumn("paths", F.array("section_path")))


@PLANS.add("m25_failure_class", f"WITH {_CLASSED} SELECT variant_id, item_id, failure_class FROM classed", ("judged",))
def classes(f: Frames) -> DataFrame:
    return _classed(f).select("variant_id", "item_id", "failure_class")


@PLANS.add("m26_class_rollups", f"WITH {_CLASSED} SELECT variant_id, coalesce(failure_class, 'unclassified') AS failure_class, count(*) AS n FROM classed WHERE coalesce(outcome, 0) <= 0.05 GROUP BY 1, 2", ("judged",))
def rollups(f: Frames) -> DataFrame:
    failed = _classed(f).where("coalesce(outcome, 0) <= 0.05")
    return failed.groupBy("variant_id", F.coalesce("failure_class", F.lit("unclassified")).alias("failure_class")).agg(F.count("*").alias("n"))


@PLANS.add("q32_import_annotations", """
WITH a AS (SELECT *, CASE WHEN ordinal % 13 = 0 THEN '' ELSE item_id END AS item, CASE ordinal % 5 WHEN 0 THEN 'gt_wrong' WHEN 1 THEN ' agent_failure ' WHEN 2 THEN 'unheard_of' ELSE 'gt_too_strict' END AS c,
  CASE WHEN spot_check THEN 'Pass' ELSE 'pending' END AS checked, CASE ordinal % 7 WHEN 1 THEN 'no' WHEN 2 THEN 'Yes' ELSE '' END AS apply FROM annotations)
SELECT skipped, count(*) AS n FROM (SELECT CASE WHEN item = '' THEN 'no_item' WHEN c = 'unheard_of' THEN 'unknown_class' WHEN checked <> 'Pass' THEN 'not_checked' WHEN apply = 'no' THEN 'apply_refused' WHEN proposed IS NULL THEN 'nothing_proposed' END AS skipped FROM a) GROUP BY 1""", ("annotations",))
def imported(f: Frames) -> DataFrame:
    k = F.col("ordinal")
    rows = f["annotations"].select(
        F.when(k % 13 == 0, "").otherwise(F.col("item_id")).alias("item_id"), F.when(k % 5 == 0, "gt_wrong").when(k % 5 == 1, " agent_failure ").when(k % 5 == 2, "unheard_of").otherwise("gt_too_strict").alias("failure_class"),
        F.when(F.col("spot_check"), "Pass").otherwise("pending").alias("corpus_spot_check"), F.when(k % 7 == 1, "no").when(k % 7 == 2, "Yes").otherwise("").alias("apply"), F.col("proposed").alias("proposed_answer"), F.lit(None).cast("string").alias("proposed_question"))
    return A.review_rows(rows).groupBy("skipped").agg(F.count("*").alias("n"))


@PLANS.add("r13_best_revenue", r"""
WITH e AS (SELECT accession AS query_id, fact_id, replace(excerpt, 'Revenues', CASE WHEN value_num % 2 = 0 THEN 'RevenueFromContract' ELSE 'Revenues' END) AS excerpt FROM excerpts WHERE value_num % 9 <> 0)
SELECT query_id, arg_min(regexp_extract(excerpt, '\$[0-9.,]+ (million|billion)'), (CASE WHEN contains(excerpt, 'RevenueFromContract') THEN 0 ELSE 1 END, fact_id)) AS amount FROM e WHERE contains(lower(excerpt), 'revenue') AND regexp_matches(excerpt, '\$[0-9.,]+ (million|billion)') GROUP BY 1""", ("excerpts",))
def revenue(f: Frames) -> DataFrame:
    named = F.when(F.col("value_num") % 2 == 0, "RevenueFromContract").otherwise("Revenues")
    rows = f["excerpts"].select(F.col("accession").alias("query_id"), F.col("fact_id").alias("rank"), F.replace("excerpt", F.lit("Revenues"), named).alias("excerpt"), (F.col("value_num") % 9 != 0).alias("aligned"))
    return A.best_revenue_amount(rows)


@PLANS.add("r13_business_segments", """
WITH e AS (SELECT l_orderkey AS query_id, count(*) FILTER (l_partkey % 4 = 0) AS a, count(*) FILTER (l_partkey % 4 = 1) AS b, count(*) FILTER (l_partkey % 4 = 2) AS c, count(*) FILTER (l_partkey % 4 = 3) AS d FROM lineitem GROUP BY 1),
s AS (SELECT query_id, list_filter([CASE WHEN a > 0 THEN 'Upstream' END, CASE WHEN b > 0 THEN 'Energy Products' END, CASE WHEN c > 0 THEN 'Chemical Products' END, CASE WHEN d > 0 THEN 'Specialty Products' END], lambda x: x IS NOT NULL) AS s FROM e JOIN orders ON o_orderkey = query_id WHERE o_orderstatus <> 'F')
SELECT query_id, array_to_string(s, ',') AS segments FROM s WHERE len(s) >= 3""")
def segments(f: Frames) -> DataFrame:
    names = ("Upstream", "Energy Products", "Chemical Products", "Specialty Products")
    asked = F.when(F.col("o_orderstatus") == "F", "Compare the segments").otherwise("Which segments are there?")
    questions = f["orders"].select(F.col("o_orderkey").alias("query_id"), asked.alias("question"))
    excerpt = F.concat(F.lit("Sales of "), F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % 4 + 1).cast("int")))
    found = A.business_segments(questions, f["lineitem"].select(F.col("l_orderkey").alias("query_id"), excerpt.alias("excerpt")), names)
    return found.withColumn("segments", F.array_join("segments", ","))


@PLANS.add("q4_nearest_duplicate", r"""
WITH t AS (SELECT item_id, regexp_replace(lower(trim(coalesce(question, ''))), '[ \t\r\n]+', ' ', 'g') AS text FROM asked), c AS (SELECT text, min(item_id) AS id, string_split(text, ' ') AS w FROM t GROUP BY 1),
s AS (SELECT text, id, CASE WHEN len(w) < 5 THEN [text] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM c), x AS (SELECT id, unnest(s) AS g FROM s),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2), q AS (SELECT a, b, i / (len(m.s) + len(n.s) - i)::DOUBLE AS similarity FROM p JOIN s m ON m.id = a JOIN s n ON n.id = b),
h AS (SELECT t.item_id, b AS match_id, similarity FROM t JOIN c USING (text) JOIN q ON a = c.id WHERE similarity >= 0.85 AND b < t.item_id UNION ALL SELECT t.item_id, c.id, 1.0 FROM t JOIN c USING (text) WHERE c.id < t.item_id)
SELECT item_id, match_id, round(similarity, 9) AS similarity FROM h QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, match_id) = 1""", ("asked",))
def nearest(f: Frames) -> DataFrame:
    return A.nearest_duplicates(f["asked"]).withColumn("similarity", F.round("similarity", 9))


@PLANS.add("q3_near_duplicates")
def kept(f: Frames) -> DataFrame:
    """Greedy choice can't be stated in plain SQL; a test compares with a loop over the rows."""
    return A.keep_first(f["asked"])


_REFERS = "len(list_filter({t}, lambda w: contains(lower(claim), w))) >= least(2, len({t})) AND len({t}) > 0"
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({e}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(map(Q.quoted, C.ENTITY_STOP)) + "], w)))"
_NAMED = "CASE " + " ".join(f"WHEN regexp_matches(t, {Q.quoted(p)}) THEN regexp_replace(trim(regexp_extract(t, {Q.quoted(p)}, @g)), chr(39) || 's$', '')" for p in C.NAMED) + " END"


@PLANS.add("b39_comparison_quality", f"""
WITH t AS (SELECT *, regexp_replace(coalesce(answer, ''), '^\\s+|\\s+$', '', 'g') AS t FROM compared),
f AS (SELECT *, regexp_matches(t, {Q.quoted(C.BOTH)}) AS both_say, regexp_matches(t, {Q.quoted(C.BOTH_AND)}) AS both_and, regexp_matches(t, {Q.quoted(C.CROSS)}) AS crossed,
  len(list_distinct(regexp_extract_all(t, {Q.quoted(C.PERCENT)}))) >= 2 OR len(list_distinct(regexp_extract_all(t, {Q.quoted(C.DOLLARS)}))) >= 2 AS contrast, len(regexp_extract_all(t, '\\S+')) AS n,
  len(regexp_extract_all(regexp_replace(lower(t), {Q.quoted(C.TEMPLATE)}, ' ', 'g'), '\\S+')) AS own, {_NAMED.replace('@g', '1')} AS a, {_NAMED.replace('@g', '2')} AS b FROM t),
g AS (SELECT *, both_say AND NOT crossed AND own < 25 AND NOT contrast AS boilerplate, coalesce(a <> '' AND b <> '', false) AS named, coalesce({_TOKENS.format(e="a")}, []) AS ta, coalesce({_TOKENS.format(e="b")}, []) AS tb FROM f),
c AS (SELECT c_custkey, named, ta, tb, trim(unnest(string_split(claims, ';'))) AS claim FROM g),
m AS (SELECT c_custkey, named, {_REFERS.format(t="ta")} AS of_a, {_REFERS.format(t="tb")} AS of_b, regexp_matches(claim, {Q.quoted(C.ANCHOR)}) AS dated, len(list_distinct(list_filter(regexp_extract_all(claim, {Q.quoted(C.ANCHOR)}, 1), lambda y: y <> ''))) >= 2 AS years,
  (regexp_matches(claim, '(?i)\\bboth\\b') AND regexp_matches(claim, {Q.quoted(C.PEERS)})) OR regexp_matches(claim, {Q.quoted(C.CROSS)}) AS words FROM c WHERE claim <> ''),
x AS (SELECT *, years OR words OR (named AND of_a AND of_b) AS cross_claim FROM m),
s AS (SELECT c_custkey, count(*) AS n_claims, count(*) FILTER (cross_claim) AS n_cross, CASE WHEN any_value(named) THEN bool_or(NOT cross_claim AND of_a AND NOT of_b)::INT + bool_or(NOT cross_claim AND of_b AND NOT of_a)::INT ELSE least(2, count(*) FILTER (dated)) END AS sides FROM x GROUP BY 1)
SELECT c_custkey, both_say OR (both_and AND crossed) AS canonical, boilerplate, CASE WHEN t = '' OR boilerplate THEN 0.0 ELSE least(10, CASE WHEN both_say THEN 2 ELSE 4 END + CASE WHEN crossed THEN 4 ELSE 0 END + CASE WHEN n >= 25 THEN 2 ELSE 0 END + CASE WHEN contrast THEN 2 ELSE 0 END) / 10.0 END::DOUBLE AS informativeness,
  a AS entity_a, b AS entity_b, coalesce(sides, 0)::INT AS sides, coalesce(n_cross, 0)::INT AS n_cross, coalesce(n_claims BETWEEN 3 AND 8 AND sides >= 2 AND n_cross > 0, false) AS structured
FROM g LEFT JOIN s USING (c_custkey)""", ("compared",))
def comparison_quality(f: Frames) -> DataFrame:
    t, e = F.col("answer"), C.entities(F.col("answer"))
    # Customers are small rows, so many of them lie in one split of a file; what is asked of one takes long.
    rows = f["compared"].repartition(4 * f.parallelism, "c_custkey").withColumns({"s": C.claim_support(F.split("claims", ";"), t), "e": e})
    return rows.select("c_custkey", C.is_canonical(t).alias("canonical"), C.is_boilerplate(t).alias("boilerplate"), C.informativeness(t).alias("informativeness"), F.col("e.a").alias("entity_a"), F.col("e.b").alias("entity_b"), "s.*")
