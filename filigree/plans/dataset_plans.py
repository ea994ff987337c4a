"""Queries over the dataset operators, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dataset as Q
from ..sources.views import Frames
from .plan import Plans

PLANS = Plans()


@PLANS.add("q1_filter_accessions", """
SELECT issuer_id, accession FROM filings WHERE form_type = '10-Q' AND year(period_end) BETWEEN 1996 AND 1998 QUALIFY row_number() OVER (PARTITION BY issuer_id ORDER BY filed_at DESC, accession DESC) <= 2""", ("filings",))
def accessions(f: Frames) -> DataFrame:
    return Q.filter_accessions(f["filings"], ["10-Q"], (1996, 1998), 2).select("issuer_id", "accession")


@PLANS.add("q2_sample_issuers", """
SELECT issuer_id, row_number() OVER (ORDER BY sha256('11:' || issuer_id))::INT AS position FROM (SELECT DISTINCT issuer_id FROM filings) QUALIFY position <= 8""", ("filings",))
def sample(f: Frames) -> DataFrame:
    issuers = f["customer"].select(F.col("c_custkey").cast("int").alias("issuer_id"))
    return Q.sample_issuers(issuers, f["filings"], 8, 11)


def _weights(f: Frames) -> DataFrame:
    rows = f["items"].groupBy("profile").agg(F.count("*").cast("double").alias("weight"))
    return rows.withColumn("ordinal", F.when(F.col("profile") == "numeric", 0).when(F.col("profile") == "comparison", 1).when(F.col("profile") == "narrative", 2).otherwise(3))


_TARGETS = """
w AS (SELECT profile, count(*)::DOUBLE AS weight, CASE profile WHEN 'numeric' THEN 0 WHEN 'comparison' THEN 1 WHEN 'narrative' THEN 2 ELSE 3 END AS ordinal FROM items GROUP BY 1),
r AS (SELECT *, 50 * weight / (SELECT sum(weight) FROM w) AS raw FROM w),
t AS (SELECT profile, (floor(raw) + CASE WHEN row_number() OVER (ORDER BY raw - floor(raw) DESC, ordinal) <= 50 - (SELECT sum(floor(raw)) FROM r) THEN 1 ELSE 0 END)::BIGINT AS target FROM r)"""


@PLANS.add("q5_quota_targets", f"WITH {_TARGETS} SELECT profile, target FROM t", ("items",))
def quotas(f: Frames) -> DataFrame:
    return Q.quota_targets(_weights(f), 50)


@PLANS.add("q6_balanced_select", f"""
WITH {_TARGETS} SELECT item_id, profile, false AS short FROM items JOIN t USING (profile) QUALIFY row_number() OVER (PARTITION BY profile ORDER BY sha256('7:' || item_id), item_id) <= min(target) OVER (PARTITION BY profile)""", ("items",))
def balanced(f: Frames) -> DataFrame:
    return Q.balanced_select(f["items"], Q.quota_targets(_weights(f), 50), 7)


@PLANS.add("q7_stratified_sample", """
WITH k AS (SELECT *, sha256('3:' || item_id) AS key FROM items), n AS (SELECT *, row_number() OVER (PARTITION BY profile, answer_type ORDER BY key, item_id) AS i, (SELECT count(*) FROM (SELECT DISTINCT profile, answer_type FROM items)) AS b FROM k)
SELECT item_id, profile, answer_type FROM n ORDER BY (i > greatest(1, floor(40 / b)))::INT, key, item_id LIMIT 40""", ("items",))
def stratified(f: Frames) -> DataFrame:
    return Q.stratified_sample(f["items"], ["profile", "answer_type"], 40, 3)


@PLANS.add("q13_scorability", "SELECT answer_type, count(*) AS n, count(*) FILTER (quality = 1) AS scorable, round(avg((quality = 1)::INT), 9) AS coverage FROM items GROUP BY 1", ("items",))
def scorability(f: Frames) -> DataFrame:
    return Q.scorability_report(f["items"]).withColumn("coverage", F.round("coverage", 9))


@PLANS.add("q14_publish_gates", """
WITH b AS (SELECT profile, count(*) AS n, count(*) FILTER (quality = 1) AS good FROM items GROUP BY 1), g AS (SELECT sum(n)::BIGINT AS n_items, sum(good) / sum(n) AS coverage, max(n) / sum(n) AS largest_share FROM b)
SELECT n_items, round(coverage, 9) AS coverage, round(largest_share, 9) AS largest_share, concat_ws(',', CASE WHEN n_items < 100000000 THEN 'too_few' END, CASE WHEN coverage < 0.5 THEN 'coverage' END, CASE WHEN largest_share > 0.2 THEN 'unbalanced' END) AS violations FROM g""", ("items",))
def gates(f: Frames) -> DataFrame:
    return Q.publish_gates(f["items"], 100_000_000, 0.5, 0.2).withColumns({"coverage": F.round("coverage", 9), "largest_share": F.round("largest_share", 9)})


@PLANS.add("q19_diversity", "SELECT profile, count(*) AS n_items, count(DISTINCT issuer_id) AS n_issuers, count(DISTINCT answer_type) AS n_types, round(count(DISTINCT issuer_id) / count(*)::DOUBLE, 9) AS issuers_per_item FROM items GROUP BY 1", ("items",))
def diversity(f: Frames) -> DataFrame:
    return Q.diversity_report(f["items"]).withColumn("issuers_per_item", F.round("issuers_per_item", 9))


@PLANS.add("q20_review_queue", """
WITH r AS (SELECT item_id, profile, outcome, mrr, ndcg FROM results WHERE variant_id = 'graph-full'), a AS (SELECT item_id, failure_class FROM annotations QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, ordinal DESC) = 1),
t AS (SELECT r.*, CASE WHEN outcome IS NULL OR outcome > 0 THEN 3 WHEN coalesce(mrr, 0) >= 0.5 OR coalesce(ndcg, 0) >= 0.3 THEN 1 ELSE 2 END AS tier FROM r)
SELECT item_id, tier, CASE tier WHEN 3 THEN 0 WHEN 1 THEN greatest(coalesce(mrr, 0), coalesce(ndcg, 0)) ELSE 0.1 END::DOUBLE AS priority, failure_class FROM t LEFT JOIN a USING (item_id) ORDER BY tier, priority DESC, item_id LIMIT 25""", ("results", "annotations"))
def queue(f: Frames) -> DataFrame:
    t = S.priority_tier(F.col("outcome"), F.col("mrr"), F.col("ndcg"))
    results = f["results"].where("variant_id = 'graph-full'").select("item_id", "outcome", "mrr", "ndcg")
    return Q.review_queue(f["items"].select("item_id"), results, f["annotations"], t["tier"], t["priority"], 25).select("item_id", "tier", "priority", "failure_class")


@PLANS.add("q21_latest_annotation", "SELECT item_id, created_at, ordinal, failure_class FROM annotations QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, ordinal DESC) = 1", ("annotations",))
def annotation(f: Frames) -> DataFrame:
    return Q.latest_annotation(f["annotations"]).select("item_id", "created_at", "ordinal", "failure_class")


@PLANS.add("q22_eligible_overrides", """
WITH g AS (SELECT * FROM annotations WHERE spot_check AND proposed IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, ordinal DESC) = 1)
SELECT item_id, ordinal, proposed FROM g WHERE NOT EXISTS (SELECT 1 FROM annotations b WHERE b.item_id = g.item_id AND NOT b.spot_check AND (b.created_at > g.created_at OR (b.created_at = g.created_at AND b.ordinal > g.ordinal)))""", ("annotations",))
def overrides(f: Frames) -> DataFrame:
    return Q.eligible_overrides(f["annotations"]).select("item_id", "ordinal", "proposed")


@PLANS.add("q23_apply_overrides", """
WITH p AS (SELECT item_id, max(failure_class) AS profile, CASE WHEN count(*) % 2 = 0 THEN 'numeric' END AS answer_type FROM annotations GROUP BY 1)
SELECT i.item_id, coalesce(p.profile, i.profile) AS profile, coalesce(p.answer_type, i.answer_type) AS answer_type, concat_ws(',', CASE WHEN p.profile IS DISTINCT FROM i.profile AND p.profile IS NOT NULL THEN 'profile' END, CASE WHEN p.answer_type IS NOT NULL AND p.answer_type <> i.answer_type THEN 'answer_type' END) AS changed
FROM items i LEFT JOIN p USING (item_id)""", ("items", "annotations"))
def apply(f: Frames) -> DataFrame:
    p = f["annotations"].groupBy("item_id").agg(F.max("failure_class").alias("profile"), F.when(F.count("*") % 2 == 0, "numeric").alias("answer_type"))
    return Q.apply_overrides(f["items"], p, ["profile", "answer_type"]).select("item_id", "profile", "answer_type", F.array_join("changed", ",").alias("changed"))


@PLANS.add("q26_freeze_cohort", """
WITH t AS (SELECT item_id, coalesce(outcome <= 0 AND (coalesce(mrr, 0) >= 0.5 OR coalesce(ndcg, 0) >= 0.3), false) AS first FROM results WHERE variant_id = 'graph-full')
SELECT item_id FROM t WHERE first OR NOT (SELECT bool_or(first) FROM t)""", ("results",))
def cohort(f: Frames) -> DataFrame:
    t = S.priority_tier(F.col("outcome"), F.col("mrr"), F.col("ndcg"))
    return Q.freeze_cohort(f["results"].where("variant_id = 'graph-full'").select("item_id", t["tier"].alias("tier")))


@PLANS.add("q28_profile_counts", "SELECT profile, count(*) AS n FROM items GROUP BY 1", ("items",))
def counts(f: Frames) -> DataFrame:
    return f["items"].groupBy("profile").agg(F.count("*").alias("n"))


@PLANS.add("q30_capped_issuers", "SELECT profile, issuer_id, count(*) AS n FROM items GROUP BY 1, 2 HAVING count(*) >= 5", ("items",))
def capped(f: Frames) -> DataFrame:
    return Q.capped_issuers(f["items"], 5)


@PLANS.add("q31_profile_schedule", """
WITH w AS (SELECT profile, count(*)::DOUBLE AS weight, CASE profile WHEN 'numeric' THEN 0 WHEN 'comparison' THEN 1 WHEN 'narrative' THEN 2 ELSE 3 END AS ordinal FROM items GROUP BY 1),
e AS (SELECT profile, sum(weight) OVER (ORDER BY ordinal) / (SELECT sum(weight) FROM w) AS upto, (sum(weight) OVER (ORDER BY ordinal) - weight) / (SELECT sum(weight) FROM w) AS from_ FROM w),
s AS (SELECT o_orderkey AS slot, ('0x' || left(sha256('5:' || o_orderkey), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM orders)
SELECT slot, profile FROM s JOIN e ON u >= from_ AND u < upto""", ("items",))
def schedule(f: Frames) -> DataFrame:
    return Q.profile_schedule(_weights(f), f["orders"].select(F.col("o_orderkey").alias("slot")), 5)


@PLANS.add("q15_items_hash")
def digest(f: Frames) -> DataFrame:
    return Q.table_hash(f["items"], "item_id")


@PLANS.add("q8_stratified_smoke", """
WITH p AS (SELECT *, CASE answer_type WHEN 'numeric' THEN 1 WHEN 'narrative' THEN 2 WHEN 'short_label' THEN 3 ELSE 9 END AS p, row_number() OVER (PARTITION BY profile, answer_type ORDER BY item_id) AS n, (SELECT count(*) FROM (SELECT DISTINCT profile, answer_type FROM items)) AS b FROM items),
o AS (SELECT *, n <= greatest(2, floor(30 / b)) AS first FROM p)
SELECT item_id, profile, answer_type FROM o ORDER BY first DESC, CASE WHEN first THEN p END, CASE WHEN first THEN profile END, item_id LIMIT 30""", ("items",))
def smoke(f: Frames) -> DataFrame:
    a = F.col("answer_type")
    return Q.stratified_smoke(f["items"], 30, F.when(a == "numeric", 1).when(a == "narrative", 2).when(a == "short_label", 3).otherwise(9))


def _bundle(f: Frames) -> DataFrame:
    have = f["recent"].groupBy("issuer_id").agg(F.array_sort(F.collect_list("accession")).alias("a"))
    n = F.regexp_extract("item_id", "([0-9]+)", 1).cast("long")
    rows = f["items"].join(have, "issuer_id").withColumn("n", n)
    some = F.when(F.col("n") % 5 == 0, F.slice("a", 1, 1)).when(F.col("n") % 7 == 0, F.array(F.lit("none"), F.lit("nil"))).otherwise(F.col("a"))
    return rows.select("item_id", "profile", F.when(F.col("n") % 11 == 0, " ").otherwise("q").alias("question"), some.alias("accessions"), F.when(F.col("n") % 3 == 0, "").otherwise("a").alias("answer"), F.when(F.col("n") % 2 == 0, "r").alias("rubric"))


_ERRORS = """
h AS (SELECT issuer_id, count(*) AS k FROM recent GROUP BY 1), i AS (SELECT item_id, profile, k, regexp_extract(item_id, '([0-9]+)', 1)::BIGINT AS n FROM items JOIN h USING (issuer_id)),
e AS (SELECT item_id, list_filter([CASE WHEN n % 11 = 0 THEN 'empty_question' END, CASE WHEN n % 7 = 0 AND n % 5 <> 0 THEN 'accession_not_in_snapshot' END,
  CASE WHEN profile = 'comparison' AND CASE WHEN n % 5 = 0 THEN 1 WHEN n % 7 = 0 THEN 2 ELSE k END < 2 THEN 'requires_multi_filing' END, CASE WHEN n % 3 = 0 AND n % 2 <> 0 THEN 'missing_ground_truth' END], lambda x: x IS NOT NULL) AS errors FROM i)"""


@PLANS.add("q9_validate_items", f"WITH {_ERRORS} SELECT item_id, array_to_string(errors, ',') AS errors, CASE WHEN len(errors) = 0 THEN 'accepted' ELSE 'rejected' END AS status FROM e", ("items", "recent"))
def validate(f: Frames) -> DataFrame:
    return Q.validate_items(_bundle(f), f["filings"]).select("item_id", F.array_join("errors", ",").alias("errors"), "status")


@PLANS.add("q29_generation_report", f"WITH {_ERRORS} SELECT unnest(list_append(errors, CASE WHEN len(errors) = 0 THEN 'accepted' ELSE 'rejected' END)) AS code, count(*) AS n FROM e GROUP BY 1", ("items", "recent"))
def report(f: Frames) -> DataFrame:
    return Q.generation_report(Q.validate_items(_bundle(f), f["filings"]))


@PLANS.add("h12_resolve_section_paths", """
WITH p AS (SELECT i.item_id, f.accession, CASE (f.y + f.q) % 4 WHEN 0 THEN 'Item 1A.' WHEN 1 THEN 'item-7 results' WHEN 2 THEN 'risk' ELSE 'nothing' END AS tail FROM items i JOIN recent f ON f.issuer_id = i.issuer_id)
SELECT item_id, accession, tail, accession || CASE tail WHEN 'Item 1A.' THEN '/Item 1A' WHEN 'item-7 results' THEN '/Item 7' ELSE '/Risk_Factors' END AS path, CASE tail WHEN 'Item 1A.' THEN 13 WHEN 'item-7 results' THEN 9 ELSE 8 END AS score FROM p WHERE tail <> 'nothing'""", ("items", "recent"))
def paths(f: Frames) -> DataFrame:
    tails = F.array(*map(F.lit, ("Item 1A.", "item-7 results", "risk", "nothing")))
    want = f["items"].join(f["recent"], "issuer_id").select("item_id", "accession", tails[(F.col("y") + F.col("q")) % 4].alias("tail"))
    names = F.explode(F.array(*map(F.lit, ("Item 1A", "Item 7", "Risk_Factors", "Exhibits"))))
    index = f["filings"].select("accession", names.alias("n")).select("accession", F.concat_ws("/", "accession", "n").alias("path"))
    return Q.resolve_paths(want, index)
