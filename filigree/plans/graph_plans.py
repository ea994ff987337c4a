"""Queries over the graph operators, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.views import Frames
from .plan import Plans

PLANS = Plans()
SECTIONS = "s AS (SELECT node_id, node_id || '-s' || (i - 1) AS section_id, i - 1 AS ordinal, trim(line) AS body FROM (SELECT node_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM doc_lines) WHERE trim(line) <> '')"


@PLANS.add("e2_section_edges", f"""
WITH {SECTIONS}, n AS (SELECT *, lag(section_id) OVER (PARTITION BY node_id ORDER BY ordinal) AS before FROM s)
SELECT node_id AS source_id, section_id AS target_id, 'CONTAINS' AS edge_type FROM n UNION ALL SELECT before, section_id, 'NEXT' FROM n WHERE before IS NOT NULL""", ("doc_lines",))
def section_edges(f: Frames) -> DataFrame:
    return G.section_edges(G.sections_of(f["doc_lines"]))


@PLANS.add("e2_reference_edges", f"""
WITH {SECTIONS}, p AS (SELECT *, node_id || '-s' || (ordinal + CASE ordinal % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) AS parent_id FROM s WHERE ordinal % 4 <> 3)
SELECT p.node_id, p.section_id AS source_id, p.parent_id AS target_id, s.ordinal IS NOT NULL AS resolved FROM p LEFT JOIN s ON s.section_id = p.parent_id AND s.node_id = p.node_id AND s.ordinal <= p.ordinal""", ("doc_lines",))
def references(f: Frames) -> DataFrame:
    k = F.col("ordinal") % 4
    parent = F.concat_ws("-s", "node_id", F.col("ordinal") + F.when(k == 0, 1).when(k == 1, -1).otherwise(0))
    return G.reference_edges(G.sections_of(f["doc_lines"]).withColumn("parent_id", F.when(k != 3, parent)))


@PLANS.add("e3_paragraph_nodes", f"""
WITH {SECTIONS}, w AS (SELECT section_id, body, unnest(range(0, ceil(length(body) / 200.0)::BIGINT)) AS win FROM s WHERE length(body) > 40)
SELECT section_id, win::INT AS "window", sha256(substr(body, win * 200 + 1, 200)) AS digest FROM w""", ("doc_lines",))
def paragraphs(f: Frames) -> DataFrame:
    # Windows of 200 characters, so that the lines have several.
    return G.chunk_sections(G.sections_of(f["doc_lines"]), 200).select("section_id", "window", F.sha2("text", 256).alias("digest"))


@PLANS.add("e9_same_concept_classes", """
WITH c AS (SELECT concept, min(fact_id) AS class_id, count(*) AS n FROM facts GROUP BY 1), o AS (SELECT concept, accession, count(*) AS own FROM facts GROUP BY 1, 2)
SELECT fact_id, class_id, n - own AS n_links FROM facts JOIN c USING (concept) JOIN o USING (concept, accession)""", ("facts",))
def concepts(f: Frames) -> DataFrame:
    return G.same_concept_classes(f["facts"])


@PLANS.add("e10_collapse_parallel", """
SELECT 'p-' || l_partkey AS source_id, 's-' || l_suppkey AS target_id, l_returnflag AS edge_type FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_returnflag DESC) = 1""")
def collapse(f: Frames) -> DataFrame:
    rows = f["lineitem"].select(F.concat(F.lit("p-"), "l_partkey").alias("source_id"), F.concat(F.lit("s-"), "l_suppkey").alias("target_id"), F.col("l_returnflag").alias("edge_type"), "l_orderkey", "l_linenumber")
    return G.collapse_parallel(rows, F.struct("l_orderkey", "l_linenumber", "edge_type"))


@PLANS.add("e12_edge_catalog", "SELECT event_type AS edge_type, count(*) AS n FROM events GROUP BY 1")
def edge_catalog(f: Frames) -> DataFrame:
    return G.catalog_violations(f["events"].select(F.col("event_type").alias("edge_type")))


@PLANS.add("e7_orphan_check", "SELECT 'o-' || o_orderkey AS node_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 4", ("nodes",))
def orphan(f: Frames) -> DataFrame:
    roots = f["region"].where("r_regionkey <> 4").select(F.concat(F.lit("r-"), "r_regionkey").alias("root_id"))
    return G.orphans(f["nodes"].where("node_type = 'CHUNK_ROW'"), f["edges"], roots)


@PLANS.add("h1_hop_counts", """
WITH RECURSIVE adj AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
w AS (SELECT node_id AS source_id, node_id, 0 AS hops FROM nodes WHERE node_type = 'DOCUMENT' UNION SELECT w.source_id, adj.b, w.hops + 1 FROM w JOIN adj ON adj.a = w.node_id WHERE w.hops < 3)
SELECT source_id, node_id, min(hops) AS hops FROM w GROUP BY 1, 2""", ("nodes", "edges"))
def hops(f: Frames) -> DataFrame:
    return G.hop_counts(f["nodes"].where("node_type = 'DOCUMENT'").select(F.col("node_id").alias("source_id")), f["edges"], 3)


@PLANS.add("h2_containment_closure", """
SELECT 'n-' || c_nationkey AS root_id, 'c-' || c_custkey AS node_id, 1 AS level FROM customer UNION ALL SELECT 'n-' || c_nationkey, 'o-' || o_orderkey, 2 FROM orders JOIN customer ON c_custkey = o_custkey""")
def closure(f: Frames) -> DataFrame:
    return G.containment_closure(f["nodes"].where("node_type = 'SECTION'").select(F.col("node_id").alias("root_id")), f["edges"])


@PLANS.add("h4_neighbors", """
SELECT DISTINCT node_id, CASE WHEN source_id = node_id THEN target_id ELSE source_id END AS neighbor_id FROM nodes JOIN edges ON node_id IN (source_id, target_id) WHERE node_type = 'SECTION'""", ("nodes", "edges"))
def near(f: Frames) -> DataFrame:
    return G.neighbors(f["nodes"].where("node_type = 'SECTION'").select("node_id"), f["edges"])


@PLANS.add("h5_outgoing_edges", "SELECT node_id, target_id, edge_type FROM nodes JOIN edges ON source_id = node_id WHERE node_type = 'SECTION'", ("nodes", "edges"))
def outgoing(f: Frames) -> DataFrame:
    return G.outgoing_edges(f["nodes"].where("node_type = 'SECTION'").select("node_id"), f["edges"])


@PLANS.add("h7_scan_ratio", """
WITH n AS (SELECT o_custkey AS filing_id, count(*) AS navigable FROM orders GROUP BY 1), v AS (SELECT o_custkey AS filing_id, l_suppkey AS query_id, count(DISTINCT o_orderkey) AS visited FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT query_id, filing_id, visited, navigable, visited / navigable::DOUBLE AS ratio, visited / navigable::DOUBLE >= 0.9 AS full_scan FROM v JOIN n USING (filing_id)""")
def ratio(f: Frames) -> DataFrame:
    navigable = f["orders"].select(F.col("o_custkey").alias("filing_id"), F.col("o_orderkey").alias("node_id"))
    visited = f["lineitem"].select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("node_id")).join(navigable.hint("merge"), "node_id")
    return G.scan_ratio(visited, navigable)


@PLANS.add("h8_table_of_contents", """
WITH k AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)
SELECT 'r-' || n_regionkey AS root_id, 'n-' || n_nationkey AS section_id, coalesce(n, 0) AS n_children, row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN n_nationkey % 3 = 0 THEN (n_nationkey % 8)::VARCHAR ELSE 'Z' END, 'n-' || n_nationkey)::INT AS position FROM nation LEFT JOIN k ON c_nationkey = n_nationkey QUALIFY position <= 4""")
def toc(f: Frames) -> DataFrame:
    key = F.substring("node_id", 3, 20).cast("int")
    nodes = f["nodes"].withColumn("item_number", F.when(F.col("node_type") == "SECTION", F.when(key % 3 == 0, (key % 8).cast("string")).otherwise("")))
    return G.table_of_contents(nodes.where("node_type = 'DOCUMENT'").select(F.col("node_id").alias("root_id")), nodes, f["edges"], 4)


@PLANS.add("h14_sequence_matches", """
WITH s AS (SELECT conv_id, string_agg(left(role, 1), '' ORDER BY turn, role, text) AS seq FROM conversations GROUP BY 1) SELECT conv_id, regexp_matches(seq, 'u.*a.*u.*a') OR regexp_matches(seq, 's.*a') AS matches FROM s""")
def sequences(f: Frames) -> DataFrame:
    steps = f["conversations"].groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    seq = steps.select("conv_id", F.transform("t", lambda x: F.left(x["role"], F.lit(1))).alias("seq"))
    patterns = F.array(F.array(*map(F.lit, "uaua")), F.array(*map(F.lit, "sa")))
    return seq.select("conv_id", G.sequence_matches(F.col("seq"), patterns).alias("matches"))


_TREE = """
adj AS (SELECT a, b, min(edge_type) AS edge_type FROM (SELECT source_id AS a, target_id AS b, edge_type FROM edges UNION ALL SELECT target_id, source_id, edge_type FROM edges) GROUP BY 1, 2),
w AS (SELECT node_id AS source_id, node_id, 0 AS hops FROM nodes WHERE node_type = 'DOCUMENT' UNION SELECT w.source_id, adj.b, w.hops + 1 FROM w JOIN adj ON adj.a = w.node_id WHERE w.hops < 3),
h AS (SELECT source_id, node_id, min(hops) AS hops FROM w GROUP BY 1, 2),
t AS (SELECT h.source_id, h.node_id, h.hops, min(p.node_id) AS parent FROM h JOIN adj ON adj.b = h.node_id JOIN h p ON p.source_id = h.source_id AND p.node_id = adj.a AND p.hops = h.hops - 1 GROUP BY 1, 2, 3)"""


@PLANS.add("h1_shortest_paths", f"""
WITH RECURSIVE {_TREE},
r AS (SELECT source_id, node_id AS target, node_id, [node_id] AS path, [] :: VARCHAR[] AS types FROM h JOIN nodes USING (node_id) WHERE node_type IN ('CHUNK_TABLE', 'CHUNK_ROW')
  UNION ALL SELECT r.source_id, target, t.parent, list_prepend(t.parent, path), list_prepend(edge_type, types) FROM r JOIN t ON t.source_id = r.source_id AND t.node_id = r.node_id JOIN adj ON adj.a = t.parent AND adj.b = t.node_id)
SELECT source_id, target AS node_id, len(types) AS hops, array_to_string(path, ',') AS node_ids, array_to_string(types, ',') AS edge_types FROM r WHERE node_id = source_id""", ("nodes", "edges"))
def paths(f: Frames) -> DataFrame:
    sources = f["nodes"].where("node_type = 'DOCUMENT'").select(F.col("node_id").alias("source_id"))
    tree = G.shortest_path_tree(sources, f["edges"], 3)
    wanted = tree.join(f["nodes"].where("node_type IN ('CHUNK_TABLE', 'CHUNK_ROW')").select("node_id").hint("merge"), "node_id", "left_semi").select("source_id", "node_id")
    found = G.shortest_paths(wanted, tree, 3)
    return found.select("source_id", "node_id", "hops", F.array_join("node_ids", ",").alias("node_ids"), F.array_join("edge_types", ",").alias("edge_types"))


#: A snapshot for each nation: its customers' orders are facts, rows with numbers and rows without;
#: one customer in ten hangs on no section, or only on another that refers to it.
_AUDITED = """
an AS (SELECT c_nationkey AS snapshot_id, 'o-' || o_orderkey AS node_id, CASE WHEN o_orderkey % 8 = 1 THEN 'CHUNK_XBRL_FACT' ELSE 'CHUNK_ROW' END AS node_type, CASE WHEN o_orderkey % 4 = 2 THEN o_orderpriority ELSE o_orderstatus END AS label, 'n-' || c_nationkey AS root_id FROM orders JOIN customer ON c_custkey = o_custkey),
ae AS (SELECT c_nationkey AS snapshot_id, 'n-' || c_nationkey AS source_id, 'c-' || c_custkey AS target_id, 'CONTAINS' AS edge_type FROM customer WHERE c_custkey % 10 <> 7
  UNION ALL SELECT c_nationkey, 'c-' || c_custkey, 'n-' || c_nationkey || '-x', 'REFERENCES' FROM customer WHERE c_custkey % 20 <> 7
  UNION ALL SELECT c_nationkey, 'c-' || o_custkey, 'o-' || o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'TEMPORAL' ELSE 'CONTAINS' END FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _audited(f: Frames) -> tuple[DataFrame, DataFrame]:
    o, c = F.col("o_orderkey"), f["customer"].select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("snapshot_id"))
    orders = f["orders"].join(c, "o_custkey")
    root = F.concat(F.lit("n-"), F.col("snapshot_id"))
    node, customer = F.concat(F.lit("o-"), o), F.concat(F.lit("c-"), F.col("o_custkey"))
    nodes = orders.select("snapshot_id", node.alias("node_id"), F.when(o % 8 == 1, "CHUNK_XBRL_FACT").otherwise("CHUNK_ROW").alias("node_type"), F.when(o % 4 == 2, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("label"), root.alias("root_id"))
    down = c.where("o_custkey % 10 <> 7").select("snapshot_id", root.alias("source_id"), customer.alias("target_id"), F.lit("CONTAINS").alias("edge_type"))
    across = c.where("o_custkey % 20 <> 7").select("snapshot_id", customer.alias("source_id"), F.concat(root, F.lit("-x")).alias("target_id"), F.lit("REFERENCES").alias("edge_type"))
    leaves = orders.select("snapshot_id", customer.alias("source_id"), node.alias("target_id"), F.when(F.col("o_orderstatus") == "P", "TEMPORAL").otherwise("CONTAINS").alias("edge_type"))
    return nodes, down.unionByName(across).unionByName(leaves)


_SAMPLE = f"""{_AUDITED},
k AS (SELECT *, sha256('42:' || node_id) AS d, CASE WHEN node_type = 'CHUNK_XBRL_FACT' THEN 0 WHEN regexp_matches(label, '[0-9]') THEN 1 ELSE 2 END AS class FROM an),
l AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, class ORDER BY d) AS k FROM k),
sample AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY CASE WHEN class = 0 AND k <= 60 THEN 0 WHEN class = 1 THEN 1 ELSE 2 END, d) <= 100),
adj AS (SELECT DISTINCT a, b, edge_type FROM (SELECT source_id AS a, target_id AS b, edge_type FROM ae UNION ALL SELECT target_id, source_id, edge_type FROM ae) WHERE edge_type <> 'TEMPORAL'),
w AS (SELECT DISTINCT root_id AS source_id, root_id AS node_id, 0 AS hops FROM sample UNION SELECT w.source_id, adj.b, w.hops + 1 FROM w JOIN adj ON adj.a = w.node_id WHERE w.hops < 6),
h AS (SELECT source_id, node_id, min(hops) AS hops FROM w GROUP BY 1, 2),
t AS (SELECT h.source_id, h.node_id, min(p.node_id) AS parent FROM h JOIN adj ON adj.b = h.node_id JOIN h p ON p.source_id = h.source_id AND p.node_id = adj.a AND p.hops = h.hops - 1 GROUP BY 1, 2),
r AS (SELECT root_id AS source_id, node_id AS target, node_id, [node_id] AS path, [] :: VARCHAR[] AS types FROM sample
  UNION ALL SELECT r.source_id, target, t.parent, list_prepend(t.parent, path), list_prepend(edge_type, types) FROM r JOIN t ON t.source_id = r.source_id AND t.node_id = r.node_id JOIN adj ON adj.a = t.parent AND adj.b = t.node_id),
entries AS (SELECT snapshot_id, s.node_id, CASE class WHEN 0 THEN 'xbrl_fact' ELSE 'table_row' END AS kind, target IS NOT NULL AS reachable, len(types) AS hops, array_to_string(path, ',') AS node_ids, array_to_string(types, ',') AS edge_types FROM sample s LEFT JOIN r ON target = s.node_id AND r.node_id = source_id)"""


@PLANS.add("h10_reachability_entries", f"WITH RECURSIVE {_SAMPLE} SELECT * FROM entries")
def audited(f: Frames) -> DataFrame:
    entries, _ = G.reachability_audit(*_audited(f))
    return entries.withColumns({"node_ids": F.array_join("node_ids", ","), "edge_types": F.array_join("edge_types", ",")})


@PLANS.add("h10_reachability_report", f"WITH RECURSIVE {_SAMPLE} SELECT snapshot_id, count(*) AS sample_size, count(*) FILTER (reachable) AS reached, count(*) FILTER (reachable) / count(*)::DOUBLE AS pass_rate, count(*) FILTER (reachable) / count(*)::DOUBLE >= 0.95 AS audit_ready FROM entries GROUP BY 1")
def audit(f: Frames) -> DataFrame:
    return G.reachability_audit(*_audited(f))[1]
