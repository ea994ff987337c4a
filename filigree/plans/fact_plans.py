"""Queries over the fact operators, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facts as O
from ..sources.readers import calc_hierarchy
from ..sources.views import Frames
from .plan import Plans

PLANS = Plans()
#: Orders whose filings a task takes, one at most each, or two with those filed again; it sorts some fifty rows a
#: filing, of some 200 bytes.
ORDERS_PER_TASK = 20_000
_ANNUAL = "(strftime(period_start, '%m-%d') = '01-01' AND strftime(period_end, '%m-%d') = '12-31')"


@PLANS.add("f20_revenue_yoy", """
WITH v AS (SELECT issuer_id, period_end, max(value_num) AS value FROM facts WHERE concept = 'Revenues' AND form_type = '10-K' GROUP BY 1, 2),
p AS (SELECT *, lag(value) OVER (PARTITION BY issuer_id ORDER BY period_end) AS prior FROM v)
SELECT issuer_id, period_end, value, prior, value - prior AS delta, (value - prior) / nullif(abs(prior), 0)::DOUBLE * 100 AS percent_change FROM p""", ("facts",))
def revenue_yoy(f: Frames) -> DataFrame:
    return O.yoy_series(f["facts"], "Revenues")


@PLANS.add("f1_consolidate_facts", """
SELECT accession AS doc_id, row_number() OVER (PARTITION BY accession ORDER BY concept)::BIGINT AS record, concept, value_num::VARCHAR AS value, period_end::VARCHAR AS period, CASE WHEN value_num % 2 = 0 THEN 'USD' END AS currency, '-6' AS decimals FROM facts""", ("facts",))
def consolidate(f: Frames) -> DataFrame:
    v = F.col("value_num")
    pairs = F.array(
        F.struct(F.col("concept").alias("left"), F.concat(F.lit("value: "), v.cast("string")).alias("right")),
        F.struct(F.lit("").alias("left"), F.concat(F.lit("period: "), F.col("period_end").cast("string")).alias("right")),
        F.struct(F.lit("").alias("left"), F.when(v % 2 == 0, "currency: USD").otherwise("dimension: none").alias("right")),
        F.struct(F.lit("").alias("left"), F.lit("decimals: 0").alias("right")), F.struct(F.lit("").alias("left"), F.lit("decimals: -6").alias("right")),
    )
    parts = max(f.parallelism, -(-f["orders"].count() // ORDERS_PER_TASK))
    facts = f.replaced(filings=f["filings"].repartition(parts, "accession"))["facts"]
    rows = facts.select("accession", "concept", F.posexplode(pairs).alias("p", "kv")).select(F.col("accession").alias("doc_id"), F.struct("concept", "p").alias("ordinal"), "kv.*")
    return O.consolidate_facts(rows)


@PLANS.add("f2_select_facts", """
SELECT accession, fact_id, position FROM (SELECT accession, fact_id, row_number() OVER (PARTITION BY accession ORDER BY CASE WHEN lower(concept) LIKE '%revenue%' THEN 0 WHEN concept IN ('Assets', 'NetIncomeLoss') THEN 1 ELSE 2 END, concept, fact_id)::INT AS position FROM facts) WHERE position <= 5""", ("facts",))
def select(f: Frames) -> DataFrame:
    return O.select_facts(f["facts"], ["Assets", "NetIncomeLoss"], 5).select("accession", "fact_id", "position")


@PLANS.add("f3_fact_ids", "SELECT fact_id, 'doc-xbrl-' || left(sha256(concept || '|' || period_start::VARCHAR || ' - ' || period_end::VARCHAR), 12) AS node_id FROM facts", ("facts",))
def ids(f: Frames) -> DataFrame:
    return O.fact_ids(f["facts"]).select("fact_id", "node_id")


@PLANS.add("f4_attach_taxonomy", """
SELECT fact_id, CASE concept WHEN 'Revenues' THEN 'Revenues, total' WHEN 'Assets' THEN 'Assets, total' END AS label, CASE concept WHEN 'Revenues' THEN 'revenue' WHEN 'Assets' THEN 'assets' END AS metric_role FROM facts""", ("facts",))
def taxonomy(f: Frames) -> DataFrame:
    table = f["facts"].where("concept IN ('Revenues', 'Assets')").groupBy("concept").agg(F.first(F.concat("concept", F.lit(", total"))).alias("label"))
    prefixed = f["facts"].withColumn("concept", F.concat(F.lit("us-gaap:"), F.col("concept")))
    return O.attach_taxonomy(prefixed, table.withColumn("metric_role", F.lower(F.regexp_replace("concept", "Revenues", "Revenue")))).select("fact_id", "label", "metric_role")


@PLANS.add("f9_period_type", "SELECT fact_id, CASE WHEN form_type = '10-K' THEN 'annual' ELSE 'interim' END AS period_type FROM facts", ("facts",))
def types(f: Frames) -> DataFrame:
    return f["facts"].select("fact_id", O.period_type(F.col("period_start"), F.col("period_end")).alias("period_type"))


@PLANS.add("f6_calc_hierarchy", """
WITH a AS (SELECT 'p-' || (l_partkey % 500) AS parent, 's-' || l_suppkey AS child FROM lineitem UNION ALL SELECT 's-' || l_suppkey, 'p-' || (l_partkey % 500 + 500) FROM lineitem WHERE l_linenumber = 7),
d AS (SELECT parent AS concept, string_agg(DISTINCT child, ',' ORDER BY child) AS children FROM a GROUP BY 1), u AS (SELECT child AS concept, string_agg(DISTINCT parent, ',' ORDER BY parent) AS parents FROM a GROUP BY 1)
SELECT concept, coalesce(parents, '') AS parents, coalesce(children, '') AS children FROM d FULL JOIN u USING (concept)""")
def hierarchy(f: Frames) -> DataFrame:
    part, supplier = F.col("l_partkey") % 500, F.concat(F.lit("s-"), "l_suppkey")
    arcs = f["lineitem"].select(F.concat(F.lit("p-"), part).alias("parent"), supplier.alias("child")).unionByName(f["lineitem"].where("l_linenumber = 7").select(supplier.alias("parent"), F.concat(F.lit("p-"), part + 500).alias("child")))
    return calc_hierarchy(arcs).select("concept", *[F.array_join(c, ",").alias(c) for c in ("parents", "children")])


#: Metadata of some concepts, as a taxonomy of the issuers would have it: a label of its own, a statement, roles
#: beside those of the name, and sums.
_TAXONOMY = (
    ("Revenues", "Net sales", "other", ("revenue", "segment_sales"), (), ("CostOfRevenue",)), ("CostOfRevenue", "", "income_statement", (), ("Revenues",), ()), ("InventoryNet", "Inventories", "balance_sheet", ("inventory",), ("Assets",), ()),
    ("Assets", None, None, None, None, None),
)


@PLANS.add("f9_enrich_catalog", """
SELECT fact_id, CASE concept WHEN 'Revenues' THEN 'Net sales' WHEN 'InventoryNet' THEN 'Inventories' WHEN 'NetIncomeLoss' THEN 'Net income (loss)' WHEN 'IncomeLossBeforeIncomeTaxes' THEN 'Income before income taxes' WHEN 'Assets' THEN 'Total assets' WHEN 'StockholdersEquity' THEN 'Total shareholders'' equity' WHEN 'LiabilitiesCurrent' THEN 'Total liabilities'
    ELSE trim(regexp_replace(concept, '([a-z])([A-Z])', '\\1 \\2', 'g')) END AS standard_label,
  CASE concept WHEN 'Revenues' THEN 'revenue,segment_sales,total_revenue,margin_denominator' WHEN 'InventoryNet' THEN 'inventory' WHEN 'NetIncomeLoss' THEN 'net_income,margin_numerator' WHEN 'IncomeLossBeforeIncomeTaxes' THEN 'pretax_income' WHEN 'Assets' THEN 'total_assets' WHEN 'StockholdersEquity' THEN 'total_equity' WHEN 'LiabilitiesCurrent' THEN 'total_liabilities' ELSE '' END AS metric_roles,
  CASE WHEN concept IN ('Revenues', 'CostOfRevenue', 'NetIncomeLoss', 'IncomeLossBeforeIncomeTaxes') THEN 'income_statement' WHEN concept IN ('InventoryNet', 'Assets', 'StockholdersEquity', 'LiabilitiesCurrent') THEN 'balance_sheet' ELSE 'other' END AS statement_role,
  CASE WHEN form_type = '10-K' THEN 'annual' WHEN value_num % 5 = 0 THEN 'instant' ELSE 'interim' END AS period_type, CASE concept WHEN 'CostOfRevenue' THEN 'Revenues' WHEN 'InventoryNet' THEN 'Assets' ELSE '' END AS calc_parents, CASE concept WHEN 'Revenues' THEN 'CostOfRevenue' ELSE '' END AS calc_children FROM facts""", ("facts",))
def enriched(f: Frames) -> DataFrame:
    kind = "concept string, standard_label string, statement_role string, metric_roles array<string>, calc_parents array<string>, calc_children array<string>"
    taxonomy = f.spark.createDataFrame([tuple(list(x) if isinstance(x, tuple) else x for x in t) for t in _TAXONOMY], kind)
    facts = f["facts"].withColumns({"is_annual": F.col("form_type") == "10-K", "period_start": F.when((F.col("form_type") == "10-K") | (F.col("value_num") % 5 != 0), F.col("period_start"))})
    out = O.enrich_catalog(facts, taxonomy)
    return out.select("fact_id", "standard_label", "statement_role", "period_type", *[F.array_join(c, ",").alias(c) for c in ("metric_roles", "calc_parents", "calc_children")])


@PLANS.add("f11_trim_catalog", """
SELECT issuer_id, fact_id, priority, position FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id ORDER BY priority, CASE WHEN form_type = '10-K' THEN 0 ELSE 1 END, period_end DESC, fact_id)::INT AS position
  FROM (SELECT *, CASE WHEN concept IN ('NetIncomeLoss', 'Revenues') THEN 0 WHEN concept = 'Assets' THEN 1 ELSE 2 END AS priority FROM facts)) WHERE position <= 50""", ("facts",))
def trim(f: Frames) -> DataFrame:
    return O.catalog_trim(f["facts"], [["NetIncomeLoss", "Revenues"], ["Assets", "Revenues"]]).select("issuer_id", "fact_id", "priority", "position")


@PLANS.add("f19_missing_families", """
WITH e AS (SELECT query_id, issuer_id, CASE WHEN contains(lower(question), 'revenue') THEN 0 END AS k FROM questions), w AS (SELECT query_id, issuer_id, fam FROM e CROSS JOIN (VALUES ('income'), ('revenue')) AS t(fam) WHERE NOT (fam = 'revenue' AND k IS NOT NULL)),
x AS (SELECT query_id, fam AS family, fact_id, period_end FROM w JOIN facts ON facts.issuer_id = w.issuer_id AND CASE fam WHEN 'revenue' THEN concept IN ('Revenues', 'CostOfRevenue') ELSE concept IN ('NetIncomeLoss', 'IncomeTaxExpenseBenefit', 'IncomeLossBeforeIncomeTaxes') END)
SELECT query_id, family, fact_id FROM x QUALIFY row_number() OVER (PARTITION BY query_id, family ORDER BY period_end DESC, fact_id) = 1""", ("facts", "questions"))
def missing(f: Frames) -> DataFrame:
    q = f["questions"].select("query_id", "issuer_id")
    # Questions about revenue come with the revenues of their issuer's last filings.
    last = f["facts"].where("concept = 'Revenues'").join(f["recent"].select("accession").hint("merge"), "accession", "left_semi")
    evidence = f["questions"].where(F.lower("question").contains("revenue")).join(last.hint("merge"), "issuer_id").select("query_id", "fact_id")
    return O.missing_families(q, evidence, f["facts"], ["income", "revenue"])


@PLANS.add("f20_compute_metric", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS k, l_partkey AS new, CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_suppkey END AS old FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN new::DOUBLE WHEN 1 THEN (new - old)::DOUBLE WHEN 2 THEN (new - old) / nullif(abs(old), 0)::DOUBLE * 100 ELSE new / nullif(abs(old), 0)::DOUBLE * 100 END AS value,
  CASE WHEN k > 0 AND old IS NULL THEN 'missing_fact' WHEN k > 1 AND old = 0 THEN 'zero_base' END AS reason FROM p""")
def metric(f: Frames) -> DataFrame:
    k = F.col("l_partkey") % 4
    kind = F.when(k == 0, "point").when(k == 1, "delta").when(k == 2, "percent_change").otherwise("ratio")
    old = F.when(F.col("l_suppkey") % 7 == 0, F.lit(None)).when(F.col("l_suppkey") % 5 == 0, 0).otherwise(F.col("l_suppkey"))
    return f["lineitem"].select("l_orderkey", "l_linenumber", O.compute_metric(kind, F.col("l_partkey"), old).alias("m")).select("l_orderkey", "l_linenumber", "m.*")
