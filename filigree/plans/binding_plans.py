"""Queries over binding, section planning, retrieval and more of the graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import binding as B
from ..operators import graph as G
from ..sources.views import Frames
from .filing_plans import _LABELLED, _NEWEST
from .plan import Plans

PLANS = Plans()
_BOUND = f"""
{_LABELLED}, b AS (SELECT query_id, issuer_id, CASE query_id % 12 WHEN 7 THEN 'qoq' WHEN 1 THEN 'yoy_quarterly' WHEN 5 THEN 'default_quarter' ELSE 'anchor' END AS branch,
  CASE WHEN query_id % 12 IN (0, 2, 3, 10) THEN '10-K' ELSE '10-Q' END AS form, CASE WHEN query_id % 12 = 8 THEN 2 ELSE 1 END AS nth FROM questions WHERE query_id % 12 NOT IN (6, 9, 11)),
n AS (SELECT *, row_number() OVER (PARTITION BY issuer_id, form_type {_NEWEST}) AS i FROM labelled),
y AS (SELECT a.issuer_id, a.accession, z.accession AS partner FROM n a JOIN n z ON a.form_type = '10-Q' AND a.i = 1 AND z.issuer_id = a.issuer_id AND z.form_type = '10-Q' AND z.fiscal_year = a.fiscal_year - 1 AND z.fiscal_quarter = a.fiscal_quarter QUALIFY row_number() OVER (PARTITION BY a.issuer_id ORDER BY z.i) = 1),
bound AS (SELECT query_id, branch, 0 AS position, accession FROM b JOIN n USING (issuer_id) WHERE branch IN ('anchor', 'default_quarter') AND form_type = form AND i = nth
  UNION ALL SELECT query_id, branch, i - 1, accession FROM b JOIN n USING (issuer_id) WHERE branch = 'qoq' AND form_type = '10-Q' AND i <= 2
  UNION ALL SELECT query_id, branch, 0, accession FROM b JOIN y USING (issuer_id) WHERE branch = 'yoy_quarterly' UNION ALL SELECT query_id, branch, 1, partner FROM b JOIN y USING (issuer_id) WHERE branch = 'yoy_quarterly')"""


@PLANS.add("d8_bind_filings", f"WITH {_BOUND} SELECT query_id, branch, position::INT AS position, accession FROM bound", ("filings", "questions"))
def bind(f: Frames) -> DataFrame:
    return B.bind_filings(f["questions"], f["filings"])


def _toc(f: Frames) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("label")) for i, t in enumerate(("Risk Factors", "Item 7 Results", "Financial Facts", "Item 1. Business", "Exhibits"))])
    return f["filings"].select("accession", F.explode(entries).alias("e")).select("accession", "e.*", F.concat_ws("-s", "accession", "e.ordinal").alias("section_id"))


def _planned(f: Frames) -> DataFrame:
    q = f["questions"].join(B.bind_filings(f["questions"], f["filings"]), "query_id")
    return B.plan_sections(q.select("query_id", "accession", "question"), _toc(f))


_PLANNED = f"""{_BOUND}, planned AS (SELECT query_id, accession, accession || '-s' || s AS section_id, row_number() OVER (PARTITION BY query_id, accession ORDER BY s)::INT AS position
  FROM (SELECT query_id, accession, unnest(CASE query_id % 12 WHEN 3 THEN [0] WHEN 5 THEN [1] WHEN 0 THEN [2] WHEN 4 THEN [2] WHEN 7 THEN [2] WHEN 10 THEN [2] ELSE [0, 1, 3] END) AS s FROM bound))"""


@PLANS.add("h9_plan_sections", f"WITH {_PLANNED} SELECT * FROM planned", ("filings", "questions"))
def plan(f: Frames) -> DataFrame:
    return _planned(f)


@PLANS.add("r6_retrieve_evidence", f"""
WITH {_PLANNED}, c AS (SELECT accession || '-s' || o AS section_id, fact_id || '-' || o AS chunk_id, concept || ' ' || value_num::VARCHAR AS text FROM facts CROSS JOIN range(0, 3) AS r(o)),
w AS (SELECT query_id, list_distinct(list_filter(string_split_regex(lower(question), '[^a-z]+'), lambda x: length(x) >= 4)) AS words FROM questions),
s AS (SELECT query_id, chunk_id, text, len(list_filter(words, lambda x: contains(lower(text), x)))::INT AS score FROM planned JOIN c USING (section_id) JOIN w USING (query_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, score, sha256(text) AS content_hash FROM s QUALIFY rank <= 8""", ("filings", "questions", "facts"))
def retrieve(f: Frames) -> DataFrame:
    o = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("o")
    chunks = f["facts"].select("accession", "fact_id", o, F.concat_ws(" ", "concept", F.col("value_num").cast("string")).alias("text"))
    chunks = chunks.select(F.concat_ws("-s", "accession", "o").alias("section_id"), F.concat_ws("-", "fact_id", "o").alias("chunk_id"), "text")
    return B.retrieve_evidence(_planned(f), chunks, f["questions"], 8)


@PLANS.add("r5_scope_evidence", """
WITH e AS (SELECT o_custkey AS query_id, o_orderkey AS chunk_id, CASE WHEN o_orderkey % 3 = 0 THEN 'html' ELSE 'xbrl' END AS kind, o_orderkey % 3 <> 0 AND o_orderstatus = 'F' AS a FROM orders)
SELECT query_id, chunk_id FROM e QUALIFY kind = 'html' OR a OR NOT bool_or(a) OVER (PARTITION BY query_id)""")
def scope(f: Frames) -> DataFrame:
    k = F.col("o_orderkey")
    e = f["orders"].select(F.col("o_custkey").alias("query_id"), k.alias("chunk_id"), F.when(k % 3 == 0, "html").otherwise("xbrl").alias("kind"), "o_orderstatus")
    return B.scope_evidence(e, F.col("o_orderstatus") == "F").select("query_id", "chunk_id")


@PLANS.add("q17_relevance_labels", """
WITH i AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 10 <> 0 THEN 'n-' || (o_custkey % 30) END AS section_id FROM orders), c AS (SELECT 'n-' || c_nationkey AS section_id, count(*) AS n FROM customer GROUP BY 1)
SELECT item_id, coalesce(n, 0) AS n_chunks, CASE WHEN section_id IS NULL THEN 'unresolved_section' WHEN n IS NULL THEN 'no_chunks' END AS reason FROM i LEFT JOIN c USING (section_id)""")
def labels(f: Frames) -> DataFrame:
    k = F.col("o_orderkey")
    items = f["orders"].select(k.alias("item_id"), F.when(k % 10 != 0, F.concat(F.lit("n-"), F.col("o_custkey") % 30)).alias("section_id"))
    sections = f["nation"].select(F.concat(F.lit("n-"), "n_nationkey").alias("section_id"))
    chunks = f["customer"].select(F.concat(F.lit("n-"), "c_nationkey").alias("section_id"), F.concat(F.lit("c-"), "c_custkey").alias("chunk_id"))
    return B.relevance_labels(items, sections, chunks)


@PLANS.add("e5_table_nodes", """
WITH t AS (SELECT o_orderkey, 'd-' || o_orderkey AS node_id, unnest([{'o': 1, 'f': o_orderkey % 2 = 0}, {'o': 3, 'f': false}]) AS x FROM orders)
SELECT CASE WHEN x.o = 3 AND o_orderkey % 2 = 0 THEN node_id || '-xbrl-facts' WHEN x.o = 1 THEN node_id ELSE node_id || '-s2' END AS source_id, node_id || '-t' || x.o AS target_id, 'CONTAINS' AS edge_type FROM t
UNION ALL SELECT node_id || '-t' || x.o, node_id || '-t' || x.o || '-r' || r, 'CONTAINS' FROM t CROSS JOIN range(0, 2) AS g(r)""")
def table_nodes(f: Frames) -> DataFrame:
    node = F.concat(F.lit("d-"), "o_orderkey").alias("node_id")
    cells = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")))
    kinds = F.explode(F.array(F.struct(F.lit(1).alias("ordinal"), (F.col("o_orderkey") % 2 == 0).alias("is_fact")), F.struct(F.lit(3).alias("ordinal"), F.lit(False).alias("is_fact"))))
    tables = f["orders"].select(node, kinds.alias("k"), cells.alias("rows")).select("node_id", "k.*", "rows")
    sections = f["orders"].select(node, F.lit(2).alias("ordinal"), F.concat(F.lit("d-"), "o_orderkey", F.lit("-s2")).alias("section_id"))
    return G.table_nodes_edges(tables, sections)


@PLANS.add("e8_materialize_status", """
WITH g AS (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS filled, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 7 = 0) AS lost, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 = 1) AS open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT 'c-' || c_custkey AS accession, CASE WHEN filled = 0 OR lost > 0 THEN 'failed' ELSE 'included' END AS status, CASE WHEN filled = 0 THEN 'no_sections_or_facts' WHEN lost > 0 THEN 'orphans' END AS reason,
 CASE WHEN filled = 0 THEN 0 ELSE n + 1 END AS n_nodes, CASE WHEN filled = 0 THEN 0 ELSE n - lost END AS n_edges, CASE WHEN filled = 0 THEN 0 ELSE open END AS n_unresolved FROM g""")
def status(f: Frames) -> DataFrame:
    # A customer is a filing; closed orders are sections, pending ones facts, open ones paragraphs.
    kind = F.when(F.col("o_orderstatus") == "F", "SECTION").when(F.col("o_orderstatus") == "P", "CHUNK_XBRL_FACT").otherwise("CHUNK_PARAGRAPH")
    orders = f["orders"].select(F.concat(F.lit("c-"), "o_custkey").alias("accession"), F.concat(F.lit("o-"), "o_orderkey").alias("node_id"), kind.alias("node_type"), "o_orderkey")
    heads = f["customer"].select(F.concat(F.lit("c-"), "c_custkey").alias("accession"), F.concat(F.lit("c-"), "c_custkey").alias("node_id"), F.lit("DOCUMENT").alias("node_type"))
    edges = orders.where("node_type = 'SECTION' OR o_orderkey % 7 <> 0").select("accession", F.col("accession").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("CONTAINS").alias("edge_type"))
    references = orders.where("node_type = 'SECTION'").select("accession", (F.col("o_orderkey") % 3 != 1).alias("resolved"))
    return G.materialize_status(heads.unionByName(orders.drop("o_orderkey")), edges, references)


#: Facts as they are excerpted, and paragraphs on the filing, as chunks of the sections that ``_toc`` lists.
_PARAGRAPHS = ((0, "html-risk_factors", "Risk factors: tariffs and supply may harm net sales"), (1, "html-md_and_a", "Management discussion of liquidity, revenue of $3 billion and outlook"), (3, "html-business_description", "The business and its strategy"), (1, "html-md_and_a", " "))


def _ranked_inputs(f: Frames) -> tuple[DataFrame, DataFrame, DataFrame]:
    planned = _planned(f).join(_toc(f).select("section_id", "ordinal", "label").hint("merge"), "section_id")
    kind = F.element_at(F.array(*map(F.lit, ("risk_factors", "md_and_a", "facts", "business_description", ""))), F.col("ordinal") + 1)
    planned = planned.select("query_id", "accession", F.concat_ws("/", "section_id", F.when(kind == "facts", "facts").otherwise(F.concat(F.lit("html-"), kind))).alias("section_id"), "position", kind.alias("kind"))
    facts = f["excerpts"].select(F.concat(F.concat_ws("-s", "accession", F.lit("2")), F.lit("/facts")).alias("section_id"), F.col("fact_id").alias("chunk_id"), F.lit(0).alias("window"), "excerpt", F.col("concept").alias("label"), "concept", F.lit("xbrl").alias("source"), F.lit(True).alias("is_fact"))
    said = F.explode(F.array(*[F.struct(F.lit(k).alias("w"), F.lit(o).alias("o"), F.lit(s).alias("s"), F.lit(t).alias("t")) for k, (o, s, t) in enumerate(_PARAGRAPHS)]))
    text = f["filings"].select("accession", said.alias("p")).select(F.concat(F.concat_ws("-s", "accession", "p.o"), F.lit("/"), F.col("p.s")).alias("section_id"), F.concat_ws("-p", "accession", "p.w").alias("chunk_id"), F.col("p.w").alias("window"), F.col("p.t").alias("excerpt"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("concept"), F.lit("html").alias("source"), F.lit(False).alias("is_fact"))
    intent = S.query_intent(F.col("question"))
    excluded = F.when(F.col("item_id") % 5 == 1, F.array(F.lit("business_description"))).when(F.col("item_id") % 5 == 2, F.array(F.lit("risk_factors"), F.lit("facts")))
    asked = f["questions"].select("query_id", "question", intent["source_bias"].alias("bias"), (intent["intent"] == "qualitative").alias("qualitative"), excluded.alias("excluded"))
    return planned, facts.unionByName(text), asked


@PLANS.add("r6_rank_evidence")
def rank(f: Frames) -> DataFrame:
    """The score can't be restated in short SQL; a test compares with plain Python on its own score."""
    out = B.rank_evidence(*_ranked_inputs(f), 12)
    return out.select("query_id", "rank", "chunk_id", "accession", F.round("score", 6).alias("score"), "content_hash")


@PLANS.add("e13_slice_ids", "SELECT issuer_id AS item_id, 'slice-' || left(sha256(string_agg(accession, '|' ORDER BY accession)), 12) AS slice_id FROM filings GROUP BY 1", ("filings",))
def slices(f: Frames) -> DataFrame:
    return G.slice_ids(f["filings"].groupBy(F.col("issuer_id").alias("item_id")).agg(F.collect_list("accession").alias("accessions")))


_SLICED = """
b AS (SELECT item_id, list(accession ORDER BY accession) AS a FROM items JOIN recent USING (issuer_id) GROUP BY 1),
c AS (SELECT item_id, a, 'slice-' || left(sha256(array_to_string(a, '|')), 12) AS slice_id FROM b), d AS (SELECT DISTINCT slice_id, a FROM c), e AS (SELECT slice_id, unnest(a) AS accession FROM d),
x AS (SELECT accession, issuer_id, y AS snapshot_id FROM filings WHERE q <> 3),
m AS (SELECT issuer_id, y AS snapshot_id, count(*) AS nodes, count(*) - 1 AS edges, list(accession ORDER BY accession) AS filings, count(*) >= 3 AS ready FROM filings GROUP BY 1, 2)"""


def _sliced(f: Frames) -> tuple[DataFrame, DataFrame]:
    """Items with the last filings of their issuer; a snapshot is a year of an issuer, without the third quarters."""
    have = f["recent"].groupBy("issuer_id").agg(F.collect_list("accession").alias("accessions"))
    items = f["items"].join(have.hint("merge"), "issuer_id").select("item_id", "accessions")
    return G.slice_members(items, f["filings"].where("q <> 3").select("accession", "issuer_id", F.col("y").alias("snapshot_id")))


@PLANS.add("e13_slice_manifests", f"""
WITH {_SLICED}, k AS (SELECT slice_id, issuer_id, snapshot_id, min(accession) AS first FROM e JOIN x USING (accession) GROUP BY 1, 2, 3), j AS (SELECT * FROM k JOIN m USING (issuer_id, snapshot_id))
SELECT slice_id AS composite_id, CASE WHEN count(*) = 1 THEN min(issuer_id)::VARCHAR ELSE 'composite' END AS issuer_id, count(*) AS n_snapshots, sum(nodes)::BIGINT AS node_count, sum(edges)::BIGINT AS edge_count, sha256(array_to_string(flatten(list(filings ORDER BY first)), ',')) AS filings, bool_and(ready) FILTER (first = lead_first) AS audit_ready
FROM (SELECT *, min(first) OVER (PARTITION BY slice_id) AS lead_first FROM j) GROUP BY 1""", ("items", "recent"))
def manifests(f: Frames) -> DataFrame:
    members, _ = _sliced(f)
    table = f["filings"].groupBy("issuer_id", F.col("y").alias("snapshot_id")).agg(F.count("*").alias("node_count"), (F.count("*") - 1).alias("edge_count"), F.array_sort(F.collect_list("accession")).alias("filings"), (F.count("*") >= 3).alias("audit_ready"), F.lit(1.0).alias("audit_pass_rate"))
    out = G.merge_snapshots(members, table).drop("audit_pass_rate")
    return out.withColumn("filings", F.sha2(F.array_join("filings", ","), 256))


@PLANS.add("e13_unresolved_bindings", f"WITH {_SLICED} SELECT DISTINCT item_id, u.accession FROM (SELECT item_id, unnest(a) AS accession FROM b) u LEFT JOIN x ON x.accession = u.accession WHERE x.accession IS NULL", ("items", "recent"))
def unresolved(f: Frames) -> DataFrame:
    return _sliced(f)[1]


@PLANS.add("h3_attach_footnotes", "SELECT o_custkey AS query_id, 'o-' || o_orderkey AS node_id FROM orders UNION SELECT o_custkey, 'f-' || l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1")
def footnotes(f: Frames) -> DataFrame:
    scope = f["orders"].select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("o-"), "o_orderkey").alias("node_id"))
    edges = f["lineitem"].where("l_linenumber = 1").select(F.concat(F.lit("o-"), "l_orderkey").alias("source_id"), F.concat(F.lit("f-"), "l_suppkey").alias("target_id"), F.lit("FOOTNOTE_OF").alias("edge_type"))
    return G.attach_footnotes(scope, edges)


@PLANS.add("h6_sections_for_filings", "SELECT r_regionkey AS query_id, 'n-' || n_nationkey AS section_id FROM region JOIN nation ON n_regionkey = r_regionkey", ("nodes",))
def sections(f: Frames) -> DataFrame:
    bound = f["region"].select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("r-"), "r_regionkey").alias("root_id"))
    return G.sections_for_filings(bound, f["nodes"], f["edges"])


@PLANS.add("h10_audit_sample", """
WITH e AS (SELECT node_id, node_type, sha256('9:' || node_id) AS k FROM nodes WHERE node_type IN ('CHUNK_TABLE', 'CHUNK_ROW')), a AS (SELECT * FROM e WHERE node_type = 'CHUNK_TABLE' ORDER BY k LIMIT 60)
SELECT node_id, node_type FROM (SELECT *, 0 AS o FROM a UNION ALL SELECT *, 1 FROM e WHERE node_id NOT IN (SELECT node_id FROM a)) ORDER BY o, k LIMIT 100""", ("nodes",))
def sample(f: Frames) -> DataFrame:
    return G.audit_sample(f["nodes"], 100, 9)
