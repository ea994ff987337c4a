"""Queries over the navigation operators, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import navigation as N
from ..sources.views import Frames
from .plan import Plans

PLANS = Plans()


def _notes(f: Frames) -> tuple[DataFrame, DataFrame]:
    """A table for each order, which refers to the suppliers of its lines; footnotes are the lines."""
    node = F.concat(F.lit("d-"), F.col("l_orderkey") % 1000)
    tables = f["lineitem"].groupBy(node.alias("node_id"), F.concat(F.lit("t-"), "l_orderkey").alias("table_id")).agg(F.collect_list((F.col("l_partkey") % 50).cast("string")).alias("footnote_ids"))
    notes = f["lineitem"].select(node.alias("node_id"), (F.col("l_suppkey") % 50).cast("string").alias("footnote_id"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("t-"), "l_orderkey")).when(F.col("l_linenumber") == 2, "t-none").alias("parent_table_id"))
    return tables, notes.groupBy("node_id", "footnote_id").agg(F.max("parent_table_id").alias("parent_table_id"))


_NOTES = """
t AS (SELECT DISTINCT 'd-' || (l_orderkey % 1000) AS node_id, 't-' || l_orderkey AS table_id, (l_partkey % 50)::VARCHAR AS fid FROM lineitem), tt AS (SELECT DISTINCT node_id, table_id FROM t),
n AS (SELECT 'd-' || (l_orderkey % 1000) AS node_id, (l_suppkey % 50)::VARCHAR AS fid, max(CASE l_linenumber WHEN 1 THEN 't-' || l_orderkey WHEN 2 THEN 't-none' END) AS parent FROM lineitem GROUP BY 1, 2)"""


@PLANS.add("e6_footnote_edges", f"""
WITH {_NOTES}
SELECT t.table_id AS source_id, t.node_id || '-fn-' || t.fid AS target_id, 'FOOTNOTE_OF' AS edge_type FROM t JOIN n ON n.node_id = t.node_id AND n.fid = t.fid
UNION SELECT tt.table_id, n.node_id || '-fn-' || fid, 'FOOTNOTE_OF' FROM n JOIN tt ON tt.node_id = n.node_id AND tt.table_id = parent
UNION SELECT node_id, node_id || '-fn-' || fid, 'CONTAINS' FROM n WHERE NOT EXISTS (SELECT 1 FROM tt WHERE tt.node_id = n.node_id AND tt.table_id = parent)""")
def footnotes(f: Frames) -> DataFrame:
    return N.footnote_edges(*_notes(f))[0]


@PLANS.add("e6_unresolved_footnotes", f"WITH {_NOTES} SELECT t.node_id, count(*) AS n FROM t LEFT JOIN n ON n.node_id = t.node_id AND n.fid = t.fid WHERE n.fid IS NULL GROUP BY 1")
def unresolved(f: Frames) -> DataFrame:
    return N.footnote_edges(*_notes(f))[1]


@PLANS.add("r7_walk_candidates", r"""
WITH g AS (SELECT query_id, question, 'n-' || (query_id % 25) AS source_id FROM questions), k AS (SELECT node_id, label || CASE WHEN node_type = 'CHUNK_TABLE' THEN ' segment revenue, risk factors' ELSE ' quarter' END AS label FROM nodes),
s AS (SELECT g.query_id, g.source_id, e.target_id, e.edge_type, len(list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), lambda w: length(w) > 2 AND contains(lower(k.label || ' ' || e.target_id), w)))::INT AS score FROM g JOIN edges e ON e.source_id = g.source_id JOIN k ON k.node_id = e.target_id)
SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, target_id, edge_type)::INT AS position, true AS approved FROM s QUALIFY position <= 3""", ("questions", "nodes", "edges"))
def hops(f: Frames) -> DataFrame:
    frontier = f["questions"].select("query_id", "question", F.concat(F.lit("n-"), F.col("query_id") % 25).alias("node_id"))
    words = F.when(F.col("node_type") == "CHUNK_TABLE", " segment revenue, risk factors").otherwise(" quarter")
    nodes = f["nodes"].select("node_id", F.concat("label", words).alias("label"))
    # These nodes bear no accession, which here is bound to every question.
    return N.walk_candidates(frontier, f["edges"], nodes, f["questions"].select("query_id", F.lit("").alias("accession")))


@PLANS.add("h17_section_candidates", """
WITH p AS (SELECT o_custkey AS query_id, 's-' || (o_orderkey % 40) AS section_id, min((o_orderkey % 7, 'a-' || (o_orderkey % 3))) AS m FROM orders GROUP BY 1, 2), n AS (SELECT query_id, section_id, m[1] AS position, m[2] AS accession FROM (SELECT query_id, section_id, [m[1]::VARCHAR, m[2]] AS m FROM p))
SELECT query_id, section_id, (7 - row_number() OVER (PARTITION BY query_id ORDER BY position::INT, accession, section_id))::INT AS score, 'doc-' || accession || ',' || section_id AS path FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position::INT, accession, section_id) <= 6""")
def candidates(f: Frames) -> DataFrame:
    k = F.col("o_orderkey")
    planned = f["orders"].select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("a-"), k % 3).alias("accession"), F.concat(F.lit("s-"), k % 40).alias("section_id"), (k % 7).alias("position"))
    return N.section_candidates(planned, 6).withColumn("path", F.array_join("path", ","))


@PLANS.add("q11_section_reachability", """
WITH i AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 9 = 0 THEN [] WHEN o_orderkey % 8 = 0 THEN NULL ELSE ['p-' || (o_custkey % 60), 'p-' || (o_orderkey % 60)] END AS paths FROM orders), x AS (SELECT DISTINCT 'p-' || (l_suppkey % 50) AS path FROM lineitem),
u AS (SELECT item_id, unnest(paths) AS path FROM i), n AS (SELECT item_id, count(*) AS n, count(*) FILTER (x.path IS NULL) AS bad FROM u LEFT JOIN x ON x.path = u.path GROUP BY 1)
SELECT i.item_id, CASE WHEN n IS NULL THEN 'missing' WHEN bad > 0 THEN 'unresolved' ELSE 'reachable' END AS status, coalesce(bad, 0) AS unresolved FROM i LEFT JOIN n ON n.item_id = i.item_id""")
def reachable(f: Frames) -> DataFrame:
    k = F.col("o_orderkey")
    paths = F.when(k % 9 == 0, F.array().cast("array<string>")).when(k % 8 == 0, F.lit(None)).otherwise(F.array(F.concat(F.lit("p-"), F.col("o_custkey") % 60), F.concat(F.lit("p-"), k % 60)))
    return N.section_reachability(f["orders"].select(k.alias("item_id"), paths.alias("paths")), f["lineitem"].select(F.concat(F.lit("p-"), F.col("l_suppkey") % 50).alias("path")))


@PLANS.add("q16_verify_hashes", """
WITH a AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), p AS (SELECT doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(a.path, p.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN p.path IS NULL THEN 'unpinned' WHEN a.h = p.h THEN 'ok' ELSE 'mismatch' END AS status FROM a FULL JOIN p ON p.path = a.path""")
def hashes(f: Frames) -> DataFrame:
    d, digest = F.col("doc_id"), F.sha2("text", 256)
    actual = f["documents"].where(d % 7 != 0).select(d.alias("path"), digest.alias("hash"))
    pinned = f["documents"].select(d.alias("path"), F.when(d % 5 == 0, "").when(d % 11 == 0, "other").otherwise(F.concat(F.lit("SHA256:"), F.upper(digest))).alias("hash"))
    return N.verify_hashes(actual, pinned)


@PLANS.add("b38_infer_answer_type", r"""
WITH i AS (SELECT doc_id, profile, n, CASE doc_id % 7 WHEN 0 THEN '$3.5 billion' WHEN 1 THEN 'Energy Products' WHEN 2 THEN 'Sales were up' WHEN 3 THEN NULL WHEN 4 THEN left(text, 60) WHEN 5 THEN '12%' ELSE ' ' END AS answer FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'numeric' WHEN 1 THEN 'comparison' ELSE 'narrative' END AS profile, (doc_id % 5)::INT AS n FROM documents)),
t AS (SELECT *, trim(coalesce(answer, '')) AS a FROM i), w AS (SELECT *, list_filter(string_split_regex(a, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM t)
SELECT doc_id, CASE WHEN (n = 4 OR profile = 'comparison') AND n >= 2 THEN 'comparison' WHEN a IN ('$3.5 billion', '12%') THEN 'numeric' WHEN a <> '' AND len(words) <= 4 AND NOT list_has_any(list_transform(words, lambda x: lower(x)), ['is', 'are', 'was', 'were', 'the', 'and', 'that', 'discuss']) THEN 'short_label'
  WHEN a <> '' AND profile = 'numeric' THEN 'short_label' ELSE 'narrative' END AS answer_type FROM w""")
def answer_types(f: Frames) -> DataFrame:
    k = F.col("doc_id") % 7
    answer = F.when(k == 0, "$3.5 billion").when(k == 1, "Energy Products").when(k == 2, "Sales were up").when(k == 3, F.lit(None)).when(k == 4, F.left("text", F.lit(60))).when(k == 5, "12%").otherwise(" ")
    profile, n = F.when(F.col("doc_id") % 3 == 0, "numeric").when(F.col("doc_id") % 3 == 1, "comparison").otherwise("narrative"), (F.col("doc_id") % 5).cast("int")
    return f["documents"].select("doc_id", N.infer_answer_type(answer, profile, n == 4, F.lit(False), n).alias("answer_type"))


@PLANS.add("g3_narrative_fallback", r"""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Cover. ITEM 1A - our' || chr(10) || 'Risk Factors ' || text || ' Item 2. Properties' WHEN 1 THEN text || ' item 1a risk factors' ELSE text END AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'html-risk_factors-0' ELSE 'html-narrative-generic' END AS section_id, length(t) - CASE WHEN doc_id % 3 = 0 THEN 7 + 18 ELSE 0 END AS n FROM d WHERE length(t) > 500""")
def fallback(f: Frames) -> DataFrame:
    t, k = F.col("text"), F.col("doc_id") % 3
    text = F.when(k == 0, F.concat(F.lit("Cover. ITEM 1A - our\nRisk Factors "), t, F.lit(" Item 2. Properties"))).when(k == 1, F.concat(t, F.lit(" item 1a risk factors"))).otherwise(t)
    return N.narrative_fallback(f["documents"].select("doc_id", text.alias("text"))).select("doc_id", "section_id", F.length("text").cast("long").alias("n"))


@PLANS.add("m35_cohort_debug", """
WITH b AS (SELECT item_id, count(DISTINCT accession) AS n FROM items JOIN recent USING (issuer_id) GROUP BY 1), e AS (SELECT item_id, count(*) AS n, count(*) FILTER (spot_check) AS c FROM annotations GROUP BY 1)
SELECT r.variant_id, r.item_id, coalesce(b.n, 0) AS n_filings, CASE WHEN variant_id = 'graph-full' THEN coalesce(e.n, 0) ELSE 0 END AS n_evidence, CASE WHEN variant_id = 'graph-full' THEN coalesce(e.c, 0) ELSE 0 END AS n_cited,
  CASE WHEN alignment <= coalesce(mrr, 9) AND alignment <= coalesce(ndcg, 9) THEN 'alignment' WHEN coalesce(mrr, 9) <= coalesce(ndcg, 9) THEN 'mrr' ELSE 'ndcg' END AS weakest FROM results r LEFT JOIN b ON b.item_id = r.item_id LEFT JOIN e ON e.item_id = r.item_id""", ("results", "items", "recent", "annotations"))
def debug(f: Frames) -> DataFrame:
    scores = F.create_map(*[x for c in ("alignment", "mrr", "ndcg") for x in (F.lit(c), F.col(c))], F.lit("trajectory_fidelity"), F.lit(0.0))
    bound = f["items"].join(f["recent"], "issuer_id").select("item_id", "accession")
    evidence = f["annotations"].select(F.lit("graph-full").alias("variant_id"), "item_id", F.col("ordinal").alias("chunk_id"), F.col("spot_check").alias("cited"))
    return N.cohort_debug(f["results"].select("variant_id", "item_id", scores.alias("scores")), bound, evidence)


@PLANS.add("m13_task_success", """
WITH r AS (SELECT *, CASE WHEN has_answer THEN coalesce(outcome, 0) WHEN profile_no <> 0 THEN coalesce(alignment, 0) END AS task, mrr * ndcg AS map_score FROM results WHERE status NOT IN ('incomplete', 'degraded', 'non_reproducible', 'pending'))
SELECT variant_id, round(avg(task), 9) AS task_success, round(avg(outcome) FILTER (has_answer), 9) AS outcome_accuracy, round(avg(alignment) FILTER (profile_no <> 0), 9) AS rubric_alignment, round(avg(mrr) FILTER (mrr IS NOT NULL), 9) AS mrr, round(avg(map_score), 9) AS map_score, round(avg(ndcg), 9) AS ndcg FROM r GROUP BY 1""", ("results",))
def success(f: Frames) -> DataFrame:
    rows = f["results"].withColumns({"has_rubric": F.col("profile_no") != 0, "map_score": F.col("mrr") * F.col("ndcg"), "has_labels": F.col("mrr").isNotNull()})
    found = M.variant_quality(rows)
    return found.select("variant_id", *[F.round(c, 9).alias(c) for c in found.columns[1:]])
