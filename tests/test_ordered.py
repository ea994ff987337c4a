"""Numbers, lags and running sums over keys that spread over partitions, against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from filigree.functions import ordered as O
from filigree.operators import filings, graph, review


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), i, rng.choice([None, 1, 2])) for i in range(2000)]
    rows += [("same", 1, 0, 1)] * 300
    return spark.createDataFrame(rows, "k string, at int, id int, v long")


def test_against_plain_windows(spark, table):
    t = O.ordered(table, ["k"], ["at", "id"], "t", parts=8)
    sizes = {(r["k"], r["part"]): r["count"] for r in t.groupBy("k", "part").count().collect()}
    for key in ("hot", "same"):  # no partition, so no task, holds all of a key's rows
        own = [n for (k, _), n in sizes.items() if k == key]
        assert len(own) > 1 and max(own) < sum(own)
    w = Window.partitionBy("k").orderBy("pos")
    want = t.select("pos", (F.row_number().over(w) - 1).alias("nth"), F.lag("at").over(w).alias("before"), F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("so_far"))
    got = O.running_sum(O.lagged(O.numbered(t, ["k"]), ["k"], F.struct("at"), "_before"), ["k"], "v", "so_far").select("pos", "nth", F.col("_before.at").alias("before"), "so_far")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    told = [tuple(r) for r in table.orderBy("k", "at", "id").select("k", "at", "id").collect()]
    assert [tuple(r) for r in t.orderBy("pos").select("k", "at", "id").collect()] == told


def test_empty_and_replaced_columns(spark, table):
    t = O.ordered(table.limit(0).withColumn("pos", F.lit("x")), ["k"], ["at"], "t")
    assert O.numbered(t, ["k"]).count() == 0 and O.lagged(t, ["k"], F.struct("at"), "b").count() == 0 and O.running_sum(t, ["k"], "v", "s").count() == 0
    assert O.ordered(table.withColumn("part", F.lit("x")), ["k"], ["at"], "t").schema["part"].dataType.simpleString() == "bigint"


def filed(spark, n):
    rows = spark.range(n).select(F.lit(1).alias("issuer_id"), F.format_string("a-%06d", "id").alias("accession"), F.when(F.col("id") % 4 == 0, "10-K").otherwise("10-Q").alias("form_type"), F.date_add(F.to_date(F.lit("1990-03-31")), (91 * (F.col("id") / 3).cast("int")).cast("int")).alias("period_end"))
    return rows.withColumn("filed_at", F.date_add("period_end", 30))


def test_one_issuer_with_all_filings(spark):
    f = filed(spark, 600)
    edges = graph.collapse_parallel(filings.temporal_edges(f), F.lit(1))
    assert edges.count() == 599 and edges.where("source_id >= target_id").count() == 0
    bound = f.select(F.col("accession").alias("query_id"), "accession")
    found = {r["query_id"]: r["n_newer"] for r in review.scope_manifest(bound, filings.fiscal_labels(f)).collect()}
    days = [r["filed_at"] for r in f.orderBy("accession").collect()]
    assert found == {f"a-{i:06d}": sum(d > days[i] for d in days) for i in range(600)}


def test_an_intent_meets_three_filings_at_most(spark):
    f = filed(spark, 600)
    intents = spark.createDataFrame([(1, 1, "FY2001", "10-K"), (2, 1, "FY2001-Q2", "10-K"), (3, 1, "FY2001", "10-Q"), (4, 1, "FY1950", "10-K"), (5, 2, "FY2001", "10-K"), (6, 1, None, None)], "query_id int, issuer_id int, label string, form_type string")
    labelled = {r["accession"]: (r["label"], r["form_type"], r["fiscal_year"], r["period_end"], r["filed_at"]) for r in filings.fiscal_labels(f).collect()}
    got = {r["query_id"]: (r["accession"], r["how"]) for r in filings.align_to_intent(intents, f).collect()}
    for query, label, form in ((1, "FY2001", "10-K"), (2, "FY2001-Q2", "10-K"), (3, "FY2001", "10-Q")):
        ways = [[a for a, (own, k, _, _, _) in labelled.items() if own == label and k == form], [a for a, (own, *_) in labelled.items() if own == label], [a for a, (_, k, y, _, _) in labelled.items() if k == "10-K" and y == 2001]]
        how, some = next((i, w) for i, w in enumerate(ways) if w)
        assert got[query] == (max(some, key=lambda a: (*labelled[a][3:], a)), how)
    assert set(got) == {1, 2, 3}


def test_shortest_paths_by_least_parents(spark):
    rows = [("d", "b", "CONTAINS"), ("d", "a", "CONTAINS"), ("a", "x", "NEXT"), ("b", "x", "CONTAINS"), ("a", "x", "CONTAINS"), ("x", "d2", "REFERENCES"), ("x", "far", "TEMPORAL"), ("x", "y", "NEXT"), ("y", "z", "NEXT")]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, edge_type string")
    sources = spark.createDataFrame([("d",), ("d2",), ("gone",)], "source_id string")
    tree = graph.shortest_path_tree(sources, edges, 3)
    pairs = spark.createDataFrame([("d", "x"), ("d", "d"), ("d", "z"), ("d", "far"), ("d2", "d"), ("gone", "x")], "source_id string, node_id string")
    got = {(r["source_id"], r["node_id"]): (r["hops"], r["node_ids"], r["edge_types"]) for r in graph.shortest_paths(pairs, tree, 3).collect()}
    assert got == {("d", "x"): (2, ["d", "a", "x"], ["CONTAINS", "CONTAINS"]), ("d", "d"): (0, ["d"], []), ("d2", "d"): (3, ["d2", "x", "a", "d"], ["REFERENCES", "CONTAINS", "CONTAINS"])}


def test_audit_quotas_and_rate(spark):
    nodes = [(s, f"{s}-f{i}", "CHUNK_XBRL_FACT", None) for s, n in (("p", 8), ("q", 1)) for i in range(n)] + [("q", f"q-r{i}", "CHUNK_ROW", "1") for i in range(30)] + [("q", f"q-t{i}", "CHUNK_ROW", "text") for i in range(5)] + [("p", "p-t", "CHUNK_ROW", None), ("r", "r-s", "SECTION", "1")]
    df = spark.createDataFrame(nodes, "snapshot_id string, node_id string, node_type string, label string").withColumn("root_id", F.concat("snapshot_id", F.lit("-doc")))
    edges = df.where("snapshot_id = 'q' OR node_id = 'p-t'").select("snapshot_id", F.col("root_id").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("CONTAINS").alias("edge_type"))
    entries, report = graph.reachability_audit(df, edges, n=10)
    kinds = {}
    for r in entries.collect():
        kinds.setdefault(r["snapshot_id"], []).append(r["node_id"][:3])
    assert {s: {k: v.count(k) for k in v} for s, v in kinds.items()} == {"p": {"p-f": 8, "p-t": 1}, "q": {"q-f": 1, "q-r": 9}}
    assert {r["snapshot_id"]: (r["sample_size"], r["reached"], r["audit_ready"]) for r in report.collect()} == {"p": (9, 1, False), "q": (10, 10, True)}


def test_scopes_fall_back(spark):
    rows = [(1, "a", "10-Q", "2001-04-30", "2001-03-31"), (2, "b", "10-Q", "2001-04-30", "2001-03-31"), (2, "c", "10-Q", "2001-07-30", "2001-06-30"), (2, "d", "10-K", "2002-01-30", "2001-12-31"), (3, "e", "10-K/A", "2002-01-30", "2001-12-31")]
    f = spark.createDataFrame(rows, "issuer_id int, accession string, form_type string, filed_at string, period_end string").withColumns({c: F.to_date(c) for c in ("filed_at", "period_end")})
    kind = "scope_id int, issuer_id int, accessions array<string>, periods array<string>, anchor string, compare_periods array<string>"
    scopes = [
        (1, 1, None, None, "prior_quarter", None), (2, 2, [], [], "prior_quarter", ["FY2001"]), (3, 2, None, None, "latest_quarter", None), (4, 2, None, None, "latest_annual", None), (5, 1, None, None, "latest_annual", None),
        (6, 2, ["d", "gone", "b"], ["FY2001"], "latest_annual", None), (7, 2, None, ["FY2001-Q2", "FY1999", "FY2001"], None, None), (8, 2, None, None, None, ["FY2001"]), (9, 2, None, None, None, None), (10, 3, None, None, "latest_annual", None), (11, 2, None, None, "other", None),
    ]
    got = sorted(tuple(r) for r in filings.resolve_scope(spark.createDataFrame(scopes, kind), f).collect())
    assert got == [(1, 0, "a"), (2, 0, "b"), (3, 0, "c"), (4, 0, "d"), (6, 0, "d"), (6, 2, "b"), (7, 0, "c"), (7, 2, "d"), (8, 0, "d")]
    newest = {(r["issuer_id"], r["form_type"]): (r["newest"], r["second"]) for r in filings.two_newest(f, "issuer_id", "form_type").collect()}
    assert newest == {(1, "10-Q"): ("a", None), (2, "10-Q"): ("c", "b"), (2, "10-K"): ("d", None), (3, "10-K/A"): ("e", None)}
