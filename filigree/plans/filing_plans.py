"""Queries over the filing operators, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filings as D
from ..sources.views import Frames
from .plan import Plans

PLANS = Plans()

_LABELLED = """
fy AS (SELECT *, CASE WHEN issuer_id % 5 = 0 AND EXISTS (SELECT 1 FROM filings k WHERE k.issuer_id = filings.issuer_id AND k.form_type = '10-K') THEN 6 ELSE 12 END AS fye FROM filings),
fz AS (SELECT *, CASE WHEN month(period_end) <= fye THEN year(period_end) ELSE year(period_end) + 1 END AS fiscal_year FROM fy),
labelled AS (SELECT *, CASE WHEN form_type = '10-Q' THEN CASE WHEN fye = 12 THEN quarter(period_end) WHEN month(period_end) > 6 THEN quarter(period_end) - 2 ELSE quarter(period_end) + 2 END END AS fiscal_quarter,
  'FY' || fiscal_year || coalesce('-Q' || CASE WHEN form_type = '10-Q' THEN CASE WHEN fye = 12 THEN quarter(period_end) WHEN month(period_end) > 6 THEN quarter(period_end) - 2 ELSE quarter(period_end) + 2 END END, '') AS label FROM fz)
"""
_NEWEST = "ORDER BY period_end DESC, filed_at DESC, accession DESC"


@PLANS.add("d1_fiscal_label", f"WITH {_LABELLED} SELECT accession, fiscal_year::INT AS fiscal_year, fiscal_quarter::INT AS fiscal_quarter, label FROM labelled", ("filings",))
def fiscal_label(f: Frames) -> DataFrame:
    return D.fiscal_labels(f["filings"]).select("accession", "fiscal_year", "fiscal_quarter", "label")


@PLANS.add("d2_dedupe_filings", f"""
WITH o AS (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY issuer_id, form_type, period_end ORDER BY filed_at DESC, accession DESC) = 1)
SELECT issuer_id, accession, form_type FROM o QUALIFY row_number() OVER (PARTITION BY issuer_id, form_type {_NEWEST}) <= 3""", ("filings",))
def dedupe(f: Frames) -> DataFrame:
    return D.dedupe_filings(f["filings"], 3).select("issuer_id", "accession", "form_type")


@PLANS.add("d3_resolve_corpus", f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY issuer_id, form_type {_NEWEST}) AS n FROM (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY issuer_id, form_type, period_end ORDER BY filed_at DESC, accession DESC) = 1)),
m AS (SELECT issuer_id AS corpus_id, accession, form_type, 'ok' AS found FROM o WHERE CASE issuer_id % 4 WHEN 0 THEN n <= CASE WHEN form_type = '10-K' THEN 2 ELSE 3 END WHEN 2 THEN n <= CASE WHEN form_type = '10-K' THEN 1 ELSE 4 END
    WHEN 1 THEN period_end BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' ELSE false END
  UNION ALL SELECT DISTINCT issuer_id, accession, form_type, 'ok' FROM filings WHERE issuer_id % 4 = 3 AND issuer_id % 3 <> 0
  UNION ALL SELECT DISTINCT issuer_id, 'gone', NULL, 'unknown' FROM filings WHERE issuer_id % 4 = 3 AND issuer_id % 3 <> 0
  UNION ALL SELECT DISTINCT issuer_id, NULL, NULL, 'no_accessions' FROM filings WHERE issuer_id % 4 = 3 AND issuer_id % 3 = 0)
SELECT corpus_id, accession, form_type, CASE WHEN count(accession) OVER (PARTITION BY corpus_id) > 6 THEN 'over_cap' ELSE found END AS status FROM m""", ("filings",))
def corpus(f: Frames) -> DataFrame:
    k = F.col("issuer_id") % 4
    named = F.when((k == 3) & (F.col("issuer_id") % 3 != 0), F.array_append(F.collect_set(F.when(k == 3, F.col("accession"))), F.lit("gone")))
    defs = f["filings"].groupBy("issuer_id").agg(named.alias("accessions")).select(
        F.col("issuer_id").alias("corpus_id"), "issuer_id", F.when(k % 2 == 0, "trailing").when(k == 1, "range").otherwise("explicit").alias("mode"), "accessions",
        F.lit(2).alias("annual"), F.lit(3).alias("quarterly"), F.when(k == 2, 1).alias("trailing_years"), F.to_date(F.lit("1996-01-01")).alias("from_date"), F.to_date(F.lit("1997-12-31")).alias("to_date"), F.lit(6).alias("cap"))
    return D.resolve_corpus(defs, f["filings"])


@PLANS.add("d5_resolve_scope", f"""
WITH {_LABELLED}, s AS (SELECT DISTINCT issuer_id, issuer_id % 4 AS k FROM filings),
a AS (SELECT s.issuer_id AS scope_id, 0 AS position, accession FROM s JOIN labelled USING (issuer_id) WHERE k = 0 AND form_type = '10-K' QUALIFY row_number() OVER (PARTITION BY issuer_id {_NEWEST}) = 1),
q AS (SELECT s.issuer_id AS scope_id, 0 AS position, accession FROM s JOIN labelled USING (issuer_id) WHERE k = 1 AND form_type = '10-Q' QUALIFY row_number() OVER (PARTITION BY issuer_id {_NEWEST}) = least(2, count(*) OVER (PARTITION BY issuer_id))),
p AS (SELECT s.issuer_id AS scope_id, CASE label WHEN 'FY1997' THEN 0 ELSE 1 END AS position, accession FROM s JOIN labelled USING (issuer_id) WHERE k IN (2, 3) AND label IN ('FY1997', 'FY1998-Q1') QUALIFY row_number() OVER (PARTITION BY issuer_id, label {_NEWEST}) = 1)
SELECT * FROM a UNION ALL SELECT * FROM q UNION ALL SELECT * FROM p""", ("filings",))
def scope(f: Frames) -> DataFrame:
    k = F.col("issuer_id") % 4
    labels = F.array(F.lit("FY1997"), F.lit("FY1998-Q1"))
    scopes = f["filings"].select("issuer_id").distinct().select(
        F.col("issuer_id").alias("scope_id"), "issuer_id", F.lit(None).cast("array<string>").alias("accessions"), F.when(k == 2, labels).alias("periods"),
        F.when(k == 0, "latest_annual").when(k == 1, "prior_quarter").alias("anchor"), F.when(k == 3, labels).alias("compare_periods"))
    return D.resolve_scope(scopes, f["filings"])


@PLANS.add("d6_pair_yoy", f"""
WITH {_LABELLED}, k AS (SELECT issuer_id, accession, label, lead(accession) OVER w AS partner, lead(label) OVER w AS partner_label, row_number() OVER w AS n FROM labelled WHERE form_type = '10-K' WINDOW w AS (PARTITION BY issuer_id {_NEWEST})),
q AS (SELECT *, row_number() OVER (PARTITION BY issuer_id {_NEWEST}) AS n FROM labelled WHERE form_type = '10-Q')
SELECT 'annual' AS kind, issuer_id, accession, partner, label, partner_label FROM k WHERE n = 1 AND partner IS NOT NULL
UNION ALL SELECT 'quarterly', * FROM (
  SELECT a.issuer_id, a.accession, b.accession, a.label, b.label FROM q a
  JOIN q b ON a.n = 1 AND b.issuer_id = a.issuer_id AND b.fiscal_year = a.fiscal_year - 1 AND b.fiscal_quarter = a.fiscal_quarter
  QUALIFY row_number() OVER (PARTITION BY a.issuer_id ORDER BY b.n) = 1)""", ("filings",))
def yoy(f: Frames) -> DataFrame:
    annual, quarterly = (D.pair_yoy(f["filings"], q).withColumn("kind", F.lit("quarterly" if q else "annual")) for q in (False, True))
    return annual.unionByName(quarterly)


@PLANS.add("d7_pair_qoq", f"""
SELECT issuer_id, accession, partner FROM (SELECT issuer_id, accession, lead(accession) OVER w AS partner, row_number() OVER w AS n FROM filings WHERE form_type = '10-Q' WINDOW w AS (PARTITION BY issuer_id {_NEWEST})) WHERE n = 1 AND partner IS NOT NULL""", ("filings",))
def qoq(f: Frames) -> DataFrame:
    return D.pair_qoq(f["filings"])


@PLANS.add("d10_align_to_intent", f"""
WITH {_LABELLED}, i AS (SELECT query_id, issuer_id, CASE WHEN query_id % 3 = 0 THEN 'FY1997' WHEN query_id % 3 = 1 THEN 'FY1998-Q2' ELSE 'FY1999-Q4' END AS label, CASE WHEN query_id % 2 = 0 THEN '10-K' ELSE '10-Q' END AS form FROM questions),
c AS (SELECT query_id, accession, period_end, filed_at, CASE WHEN l.label = i.label AND form_type = form THEN 0 WHEN l.label = i.label THEN 1 WHEN form_type = '10-K' AND fiscal_year = substr(i.label, 3, 4)::INT THEN 2 END AS how FROM i JOIN labelled l ON l.issuer_id = i.issuer_id)
SELECT query_id, accession, how FROM c WHERE how IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY how, period_end DESC, filed_at DESC, accession DESC) = 1""", ("filings", "questions"))
def align(f: Frames) -> DataFrame:
    q = F.col("query_id")
    label = F.when(q % 3 == 0, "FY1997").when(q % 3 == 1, "FY1998-Q2").otherwise("FY1999-Q4")
    return D.align_to_intent(f["questions"].select("query_id", "issuer_id", label.alias("label"), F.when(q % 2 == 0, "10-K").otherwise("10-Q").alias("form_type")), f["filings"])


@PLANS.add("d11_expand_prior_year", """
WITH b AS (SELECT issuer_id * 100 + y % 100 AS query_id, accession, issuer_id, y FROM filings WHERE form_type = '10-K')
SELECT query_id, accession FROM b UNION SELECT b.query_id, p.accession FROM b JOIN filings p ON p.issuer_id = b.issuer_id AND p.form_type = '10-K' AND p.y = b.y - 1""", ("filings",))
def prior_year(f: Frames) -> DataFrame:
    bound = f["filings"].where("form_type = '10-K'").select((F.col("issuer_id") * 100 + F.col("y") % 100).alias("query_id"), "accession")
    return D.expand_prior_year(bound, f["filings"])


@PLANS.add("d12_stale_filings", """
WITH h AS (SELECT issuer_id, accession, filed_at FROM filings WHERE y < 1999 AND q <> 3), m AS (SELECT issuer_id, max(filed_at) AS last FROM h GROUP BY 1)
SELECT f.issuer_id, f.accession, f.filed_at FROM filings f JOIN m ON m.issuer_id = f.issuer_id AND f.filed_at > m.last WHERE f.accession NOT IN (SELECT accession FROM h)""", ("filings",))
def stale(f: Frames) -> DataFrame:
    held = f["filings"].where("y < 1999 AND q <> 3").select("issuer_id", "accession")
    return D.stale_filings(f["filings"], held).select("issuer_id", "accession", "filed_at")


@PLANS.add("d13_latest_snapshot", "SELECT user_id AS issuer_id, event_id AS snapshot_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest(f: Frames) -> DataFrame:
    return D.latest_snapshot(f["events"].select(F.col("user_id").alias("issuer_id"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("created_at")))


@PLANS.add("d14_accession_index", "SELECT l_partkey AS accession, min(l_suppkey) AS issuer_id, count(DISTINCT l_suppkey) > 1 AS conflict FROM lineitem GROUP BY 1")
def index(f: Frames) -> DataFrame:
    return D.accession_index(f["lineitem"].select(F.col("l_partkey").alias("accession"), F.col("l_suppkey").alias("issuer_id")))


@PLANS.add("d15_temporal_edges", """
SELECT 'doc-' || accession AS source_id, 'doc-' || nxt AS target_id, 'NEXT' AS edge_type FROM (SELECT accession, lead(accession) OVER (PARTITION BY issuer_id ORDER BY period_end, filed_at, accession) AS nxt FROM filings) WHERE nxt IS NOT NULL""", ("filings",))
def temporal(f: Frames) -> DataFrame:
    return D.temporal_edges(f["filings"])


@PLANS.add("d16_bound_filings", """
SELECT i.item_id, f.accession, f.issuer_id, f.form_type, f.period_end, false AS missing FROM items i JOIN recent f ON f.issuer_id = i.issuer_id
UNION ALL SELECT item_id, 'missing-' || issuer_id, NULL, NULL, NULL, true FROM items WHERE issuer_id IN (SELECT issuer_id FROM recent)""", ("items", "recent"))
def bound(f: Frames) -> DataFrame:
    have = f["recent"].groupBy("issuer_id").agg(F.collect_list("accession").alias("a"))
    items = f["items"].join(have, "issuer_id").select("item_id", F.concat("a", F.array(F.concat(F.lit("missing-"), F.col("issuer_id")))).alias("accessions"))
    return D.bound_filings(items, f["filings"]).select("item_id", "accession", "issuer_id", "form_type", "period_end", "missing")


@PLANS.add("d18_accession_catalog", f"""
WITH o AS (SELECT * FROM filings WHERE issuer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) QUALIFY row_number() OVER (PARTITION BY issuer_id, form_type, period_end ORDER BY filed_at DESC, accession DESC) = 1)
SELECT issuer_id, accession, form_type, year(period_end)::INT AS calendar_year FROM o QUALIFY row_number() OVER (PARTITION BY issuer_id, form_type {_NEWEST}) <= 4""", ("filings",))
def catalog(f: Frames) -> DataFrame:
    # Those with a positive balance stand for the issuers of an allow list.
    return D.accession_catalog(f["filings"], f["customer"].where("c_acctbal > 0").select(F.col("c_custkey").alias("issuer_id")), 4)
