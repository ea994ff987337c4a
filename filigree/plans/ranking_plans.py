"""Queries over the ranking and text operators, and over streams, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..operators import graph as G
from ..operators import ranking as R
from ..operators import text as T
from ..sources.views import Frames
from ..streaming import streams
from .graph_plans import SECTIONS
from .plan import Plans

PLANS = Plans()


@PLANS.add("r3_rank_by_topic", """
WITH s AS (SELECT c.conv_id AS query_id, c.turn AS ordinal, c.conv_id || '-' || c.turn || '-' || c.role || '-' || sha256(c.text) AS chunk_id, 3.0 * contains(lower(c.text), 'risk')::INT + 5.0 * (contains(lower(c.text), 'upstream')::INT + contains(lower(c.text), 'energy products')::INT + contains(lower(c.text), 'chemical products')::INT + contains(lower(c.text), 'specialty products')::INT + contains(lower(c.text), 'segment')::INT) AS score FROM conversations c)
SELECT query_id, chunk_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal, chunk_id)::INT AS position FROM s QUALIFY position <= 3""")
def topic(f: Frames) -> DataFrame:
    c = f["conversations"]
    chunk = F.concat_ws("-", "conv_id", "turn", "role", F.sha2("text", 256))
    pairs = c.select(F.col("conv_id").alias("query_id"), F.lit("Segment risk").alias("question"), chunk.alias("chunk_id"), F.col("text").alias("excerpt"), F.col("turn").alias("ordinal"))
    return R.rank_by_topic(pairs, 3).select("query_id", "chunk_id", "score", "position")


@PLANS.add("r4_period_alignment", """
WITH a AS (SELECT issuer_id, list(DISTINCT period_end) AS anchors FROM recent GROUP BY 1),
d AS (SELECT fact_id, f.period_start AS s, f.period_end AS e, unnest(anchors) AS x FROM facts f JOIN a USING (issuer_id))
SELECT fact_id, CASE WHEN bool_or(x BETWEEN s AND e) OR min(abs(e - x)) <= 7 THEN 8.0 WHEN min(abs(e - x)) > 90 THEN -15.0 ELSE -3.0 END::DOUBLE AS score FROM d GROUP BY fact_id""", ("recent", "facts"))
def alignment(f: Frames) -> DataFrame:
    anchors = f["recent"].groupBy("issuer_id").agg(F.collect_set("period_end").alias("anchors"))
    # A row an issuer, written: its size is known, and where it is shuffled adaptive execution can split an issuer with very many facts.
    rows = f["facts"].join(written(anchors, "anchors"), "issuer_id")
    return rows.select("fact_id", R.period_alignment(F.col("period_start"), F.col("period_end"), F.col("anchors")).alias("score"))


@PLANS.add("r8_dense_topk", """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(x, embedding::DOUBLE[]), 9) AS score FROM q, embeddings)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 10""")
def dense(f: Frames) -> DataFrame:
    q = f["embeddings"].where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense_topk(q, f["embeddings"]).withColumn("score", F.round("score", 9))


@PLANS.add("r10_balance_by_accession", """
WITH e AS (SELECT o_custkey AS query_id, o_orderpriority AS accession, o_orderkey AS chunk_id, length(o_orderkey::VARCHAR) AS len FROM orders),
a AS (SELECT *, (SELECT count(DISTINCT accession) FROM e b WHERE b.query_id = e.query_id) AS n, row_number() OVER (PARTITION BY query_id, accession ORDER BY len DESC, chunk_id) AS l FROM e),
b AS (SELECT *, l <= greatest(1, floor(4 / n)) AS first FROM a)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, CASE WHEN first THEN accession END, CASE WHEN first THEN l END, chunk_id)::INT AS position FROM b QUALIFY position <= 4""")
def balance(f: Frames) -> DataFrame:
    e = f["orders"].select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("accession"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").cast("string").alias("excerpt"), F.col("o_orderkey").alias("ordinal"))
    return R.balance_by_accession(e, 4).select("query_id", "chunk_id", "position")


@PLANS.add("r12_drop_boilerplate", """
WITH e AS (SELECT o_custkey AS query_id, o_orderkey AS chunk_id, o_orderstatus = 'F' AS b FROM orders) SELECT query_id, chunk_id FROM e QUALIFY bool_and(b) OVER (PARTITION BY query_id) OR NOT b""")
def boilerplate(f: Frames) -> DataFrame:
    e = f["orders"].select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), "o_orderstatus")
    return R.drop_boilerplate(e, F.col("o_orderstatus") == "F").select("query_id", "chunk_id")


@PLANS.add("g10_numbers_in_text", r"SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')) AS number FROM documents")
def numbers(f: Frames) -> DataFrame:
    return f["documents"].select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1)).alias("number"))


@PLANS.add("s3_stream_gate_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2")
def gate_counts(f: Frames) -> DataFrame:
    return streams.gate_counts(f.spark, f.sf_dir)


@PLANS.add("s2_stream_latest_annotation", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest(f: Frames) -> DataFrame:
    return streams.latest_annotation(f.spark, f.sf_dir)


@PLANS.add("g1_item_pieces", r"""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Item 1. Business ' || text || ' Item 1A. Risk ' || text || ' see Item 7, and Item 7. Discussion ' WHEN 1 THEN 'Item 1, Item 1A. x ' || text ELSE text END AS t FROM documents),
p AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '(?i)\b(item\s+(?:1a|1|7)\b)', chr(1) || '\1', 'g'), chr(1))) AS piece, generate_subscripts(string_split(regexp_replace(t, '(?i)\b(item\s+(?:1a|1|7)\b)', chr(1) || '\1', 'g'), chr(1)), 1) - 1 AS position FROM d)
SELECT doc_id, position, upper(regexp_extract(piece, '(?i)^item\s+(1a|1|7)\b', 1)) AS item, regexp_matches(left(piece, 80), '(?i)item\s+[0-9]+[a-z]?\.\s*(&#160;|&nbsp;|\s)+') AND NOT regexp_matches(left(piece, 50), '(?i)item\s+[0-9]+[a-z]?\s*,') AND regexp_matches(piece, '(?i)^item') AS is_primary FROM p""")
def pieces(f: Frames) -> DataFrame:
    return T.item_pieces(_filed(f)).select("doc_id", "position", "item", "is_primary")


def _filed(f: Frames) -> DataFrame:
    k, t = F.col("doc_id") % 3, F.col("text")
    made = F.when(k == 0, F.concat(F.lit("Item 1. Business "), t, F.lit(" Item 1A. Risk "), t, F.lit(" see Item 7, and Item 7. Discussion "))).when(k == 1, F.concat(F.lit("Item 1, Item 1A. x "), t)).otherwise(t)
    return f["documents"].select("doc_id", made.alias("text"))


@PLANS.add("g2_split_items", r"""
WITH s AS (SELECT doc_id, unnest(['1', '1A']) AS item, unnest(['Item 1. Business ' || text || ' ', 'Item 1A. Risk ' || text || ' see Item 7, and ']) AS raw FROM documents WHERE doc_id % 3 = 0),
p AS (SELECT doc_id, item, raw, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '(&nbsp;|&#160;|[ \t\n\x0B\f\r])+', ' ', 'g')) AS plain FROM s)
SELECT doc_id, item, length(plain) AS n FROM p WHERE length(raw) >= 200 AND length(plain) >= 500 AND NOT (len(string_split_regex(raw, '(?i)item ')) > 9 AND length(plain) < 3000)""")
def items(f: Frames) -> DataFrame:
    return T.split_items(_filed(f)).select("doc_id", "item", F.length("body").alias("n"))


@PLANS.add("g8_best_sentences")
def sentences(f: Frames) -> DataFrame:
    return T.best_sentences(f["documents"], ["the", "of", "and"])


@PLANS.add("g4_merge_narrative", f"""
WITH {SECTIONS}, d AS (SELECT node_id AS accession, doc_id FROM doc_lines), x AS (SELECT node_id AS accession, ordinal, body FROM s WHERE ordinal % 2 = 0),
h AS (SELECT accession, ordinal, body FROM s JOIN d ON accession = node_id WHERE ordinal % 2 = 1 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0), e AS (SELECT accession, max(ordinal) AS last FROM x GROUP BY 1),
m AS (SELECT *, 0 AS more FROM x UNION ALL SELECT h.accession, h.ordinal + coalesce(last, -1) + 1, body, 1 FROM h LEFT JOIN e USING (accession)),
g AS (SELECT accession, max(more) AS more, count(*) AS n, sha256(string_agg(sha256(body), ',' ORDER BY ordinal)) AS digest FROM m GROUP BY 1)
SELECT accession, CASE WHEN more = 1 THEN digest ELSE 'old ' || doc_id END AS content_hash, CASE WHEN doc_id % 5 = 0 THEN 'skipped' WHEN more = 1 THEN 'success' ELSE 'failed' END AS html_status, coalesce(n, 0) AS n_sections
FROM d LEFT JOIN g USING (accession)""", ("doc_lines",))
def merged_narrative(f: Frames) -> DataFrame:
    lines = G.sections_of(f["doc_lines"]).select(F.col("node_id").alias("accession"), "ordinal", "body")
    documents = f["doc_lines"].select(F.col("node_id").alias("accession"), F.concat(F.lit("old "), "doc_id").alias("content_hash"), (F.col("doc_id") % 5 == 0).alias("skip"), "doc_id")
    html = lines.where("ordinal % 2 = 1").hint("merge").join(documents.where("doc_id % 4 <> 0").select("accession"), "accession")
    return T.merge_narrative(documents, lines.where("ordinal % 2 = 0"), html)[1]


@PLANS.add("g6_parse_confidence", """
WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_facts, length(text) - length(replace(text, '|', '')) AS n_tables, greatest(0, length(text) - length(replace(text, chr(10), '')) - 1) AS n_sections FROM documents)
SELECT doc_id, CASE WHEN n_facts > 0 AND n_sections > 0 THEN 0.95 WHEN n_tables > 0 AND n_sections > 0 THEN 0.88 WHEN n_tables > 0 OR n_sections > 0 THEN 0.65 ELSE 0.4 END::DOUBLE AS confidence FROM c""")
def confidence(f: Frames) -> DataFrame:
    """Digits, bars and lines stand for facts, tables and sections."""
    t = F.col("text")
    rows = f["documents"].select("doc_id", F.length(F.regexp_replace(t, "[^0-9]", "")).alias("n_facts"), (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))).alias("n_tables"), F.greatest(F.lit(0), F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) - 1).alias("n_sections"))
    return T.parse_confidence(rows).select("doc_id", "confidence")
