"""What steps make of large groups: rows and bytes that grow with the input, not with its square."""

import datetime
import glob
import os
import random

from pyspark.sql import functions as F

from filigree.functions import scalars as S
from filigree.functions.lineage import shared_folder
from filigree.operators import audits, binding, evidence, facts, filings, graph, navigation, publishing, ranking, repair
from filigree.plans import registry
from filigree.sources.views import Frames


def most_rows(df):
    """The most rows that a step of the executed plan put out."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def most_moved(df):
    """The most rows that one shuffle of the executed plan writes."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.metrics().contains("shuffleRecordsWritten"):
            most = max(most, p.metrics().apply("shuffleRecordsWritten").value())
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def bytes_written(spark):
    return sum(os.path.getsize(f) for f in glob.glob(f"{shared_folder(spark)}/work/*/*/*.parquet"))


def test_near_texts_write_less_than_the_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(1500)) for _ in range(100)]
    texts += [texts[0].replace(" ", " x ", 9), texts[1] + " more"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, question string")
    before = bytes_written(spark)
    found = {r.item_id: r.match_id for r in audits.nearest_duplicates(items).collect()}
    assert found == {100: 0, 101: 1} and bytes_written(spark) - before < sum(map(len, texts)) / 2
    kept = audits.keep_first(items).where("NOT kept").collect()
    assert sorted(r.item_id for r in kept) == [100, 101]


def test_labels_of_items_of_one_section(spark):
    items = spark.range(900).selectExpr("id AS item_id", "'s' AS section_id").union(spark.createDataFrame([(1000, "s"), (1000, "t"), (1001, None), (1002, "u"), (1003, "x"), (None, "t")], "item_id bigint, section_id string"))
    chunks = spark.range(900).selectExpr("'s' AS section_id", "'c' || id AS chunk_id").union(spark.createDataFrame([("t", "c1"), ("t", "d"), ("u", "e")], "section_id string, chunk_id string"))
    labels = binding.relevance_labels(items, spark.createDataFrame([("s",), ("t",), ("t",), ("x",)], "section_id string"), chunks)
    assert most_rows(labels) < 10_000
    got = {r.item_id: (r.n_chunks, r.reason) for r in labels.collect()}
    assert got[5] == (900, None) and [got[k] for k in (1000, 1001, 1002, 1003, None)] == [(901, None), (0, "unresolved_section"), (0, "no_chunks"), (0, "no_chunks"), (2, None)]


def test_prior_year_of_an_issuer_with_many_filings(spark):
    days = {y: datetime.date(y, 12, 31) for y in (2003, 2004)}
    filed = spark.createDataFrame([(1, f"{y}-{k}", "10-K", days[y]) for y in days for k in range(200)], "issuer_id int, accession string, form_type string, period_end date")
    bound = filed.select(F.year("period_end").alias("query_id"), "accession")
    got = filings.expand_prior_year(bound, filed)
    assert most_rows(got) < 5_000
    assert sorted(map(tuple, got.groupBy("query_id").count().collect())) == [(2003, 200), (2004, 400)]


def test_two_places_as_python_has_them(spark):
    rng = random.Random(5)
    xs = [1.045, 1.005, 0.125, 0.375, 2.675, 999.995, 0.995, -1.045, -0.0, 0.0, 1e-9, 0.005, 123456.785, 9007199254740991.0, -0.004, *[rng.randrange(10**7) / 1000 for _ in range(300)], *[rng.random() * 10 ** rng.randrange(9) for _ in range(300)]]
    got = [r.s for r in spark.createDataFrame([(x,) for x in xs], "x double").select(S.two_places(F.col("x")).alias("s")).collect()]
    assert got == [f"{x:.2f}" for x in xs]


def test_display_of_values_half_way(spark):
    rows = [("1045000", "$1.04 million", "$1.04 million"), ("500000", "$0", "500,000"), ("1500000000", "$1.50 billion", "$1.50 billion"), ("12", "$0", "12.00")]
    table = spark.createDataFrame(rows, "v string, fact string, number string")
    got = table.select(S.format_fact_value(F.col("v"), F.lit("-6")).alias("a"), "fact", S.format_number_display(F.col("v").cast("double"), F.lit(False)).alias("b"), "number").collect()
    assert [(r.a, r.b) for r in got] == [(r.fact, r.number) for r in got]
    assert table.select(S.format_number_display(F.lit(1.045), F.lit(True)).alias("p"), S.format_number_display(F.lit(2.5e9), F.lit(None).cast("boolean")).alias("n")).first()[:] == ("1.04%", "$2.50 billion")


def test_blocks_of_vectors_are_small():
    # Scores of 256 queries against a block, rounded, negated and sorted, on each core of an executor.
    assert 4 * 256 * ranking.BLOCK_VECTORS * 8 < 150e6


def test_compaction_carries_no_texts(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(40_000))
    rows = spark.range(300).selectExpr("'q' AS query_id", "'How did it grow?' AS question", "'other' AS intent", "'a' AS accession", "'c' || id AS chunk_id", "'html' AS source", "'s' AS section_id", f"id || '{text}' AS excerpt", "NULL AS label", "id AS ordinal")
    before = bytes_written(spark)
    found = evidence.compact_evidence(rows, 3, 50)
    got = {r.position: (r.chunk_id, len(r.excerpt)) for r in found.collect()}
    assert got == {1: ("c0", 50), 2: ("c1", 50), 3: ("c2", 50)} and bytes_written(spark) - before < 300_000
    todo, texts = [found._jdf.queryExecution().optimizedPlan()], []
    while todo:
        p = todo.pop()
        if p.nodeName() == "Window":
            texts.append("excerpt" in p.output().toString())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    assert not any(texts)


def test_anchors_of_issuers_are_written(spark, sf_dir):
    # A side of known size with a row an issuer; an aggregate as it is would keep a hot issuer's facts in one task.
    assert any("/anchors-" in f for f in registry.QUERIES["r4_period_alignment"](spark, sf_dir).inputFiles())


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_facts_by_whole_numbers(spark, sf_dir):
    f = Frames(spark, sf_dir)
    assert "decimal" not in optimized(f["facts"])
    filings = f["filings"].limit(3).withColumn("cents", F.expr("element_at(array(-123457, 0, 99), cast(row_number() OVER (ORDER BY accession) AS int))").cast("bigint"))
    got = spark.sql("SELECT *, CAST(floor(cents * pct / 10000.0) AS BIGINT) AS told FROM {facts} JOIN {filings} USING (accession) JOIN (VALUES ('Revenues', 100), ('Assets', 310), ('CostOfRevenue', 61)) AS c(concept, pct) USING (concept)", facts=f.over("facts", filings=filings), filings=filings).collect()
    assert len(got) == 9 and all(r.value_num == r.told for r in got) and min(r.value_num for r in got) < 0


def test_facts_of_the_filings_that_count(spark, sf_dir):
    # The old form joined the facts of all filings with those that questions are bound to.
    assert any("/newest-filings-" in f for f in registry.QUERIES["f14_best_fact"](spark, sf_dir).inputFiles())


def test_periods_are_parsed_once(spark, sf_dir):
    assert optimized(registry.QUERIES["b2_parse_period"](spark, sf_dir)).count("(?i)for period") == 1
    forms = ["for period 2003-02-30", "for period Feb 3, 2003 to 2003-12-31", "for period a - b - 2003-01-02", "FOR PERIOD x\nfor period 0001-01-01..", "for period ", None, "for period 2003-01-01 TO May 5, 2004.", "for period Foo 3, 2003"]
    d = datetime.date
    got = spark.createDataFrame([(i, t) for i, t in enumerate(forms)], "i int, t string").select("i", S.parse_period(F.col("t")).alias("p")).orderBy("i").collect()
    assert [tuple(r.p) for r in got] == [(None, None), (d(2003, 2, 3), d(2003, 12, 31)), (None, d(2003, 1, 2)), (d(1, 1, 1), d(1, 1, 1)), (None, None), (None, None), (d(2003, 1, 1), d(2004, 5, 5)), (None, None)]


def test_excerpts_are_made_once(spark, sf_dir):
    assert optimized(registry.QUERIES["r13_best_revenue"](spark, sf_dir)).count("XBRL ") == 1


def test_facts_of_a_concept_stay_where_they_are(spark, sf_dir):
    plan = registry.QUERIES["f9_enrich_catalog"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_answers_are_parsed_once(spark, sf_dir):
    assert optimized(registry.QUERIES["b10_numeric_equivalent"](spark, sf_dir)).count("translate(") == 2
    rows = [("$1.5 billion", "1,500,000,000", True), ("3 Trillion", "3e12", False), ("12%", "12", True), ("5 million%", "5", True), ("-2 thousand", "-2000", True), ("a ", "a", True), (None, "1", None), ("", "", True)]
    got = spark.createDataFrame(rows, "a string, b string, same boolean").select("same", S.numeric_equivalent(F.col("a"), F.col("b")).alias("got")).collect()
    assert [r.got for r in got] == [r.same for r in got]


def test_labelled_facts_of_a_concept_stay_where_they_are(spark, sf_dir):
    # As at sizes where the planner's estimate is too large for a broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["e4_labelled_facts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_labels_are_split_once(spark, sf_dir):
    assert optimized(registry.QUERIES["f5_label_roles"](spark, sf_dir)).count("regexp_replace(") == 2


def test_comparisons_are_dealt_and_worked_out_once(spark, sf_dir):
    found = registry.QUERIES["b39_comparison_quality"](spark, sf_dir)
    assert found.rdd.getNumPartitions() >= 4 and optimized(found).count("counterpart") == 1


def test_questions_at_one_node_are_not_paired_with_all_neighbours(spark):
    frontier = spark.range(300).selectExpr("id AS query_id", "IF(id % 2 = 0, 'Revenue by segment', 'risk') AS question", "'n' AS node_id").union(spark.createDataFrame([(1000, None, "n"), (1001, "risk", None), (0, "risk", "n")], "query_id bigint, question string, node_id string"))
    edges = spark.range(200).selectExpr("'n' AS source_id", "'t' || lpad(id, 3, '0') AS target_id", "'CONTAINS' AS edge_type")
    nodes = edges.selectExpr("target_id AS node_id", "CASE target_id WHEN 't150' THEN 'segment revenue' WHEN 't160' THEN 'Risk' ELSE 'x' END AS label")
    hops = navigation.walk_candidates(frontier, edges, nodes, frontier.selectExpr("query_id", "'' AS accession"), 2)
    assert most_rows(hops) < 5_000
    got = {}
    for r in sorted(hops.collect(), key=lambda r: (r.query_id, r.position)):
        got.setdefault(r.query_id, []).append((r.target_id, r.score, r.position, r.approved))
    assert got[2] == [("t150", 2, 1, True), ("t000", 0, 2, True)] and got[1] == [("t160", 1, 1, True), ("t000", 0, 2, True)]
    assert got[0] == [("t150", 2, 1, True), ("t160", 1, 2, True)] and 1001 not in got and [x[0] for x in got[1000]] == ["t000", "t001"]


def test_only_texts_with_candidates_are_moved(spark, monkeypatch):
    texts = spark.range(500).selectExpr("IF(id = 7, NULL, id) AS item_id", "unhex(sha2(string(id div 2), 256)) AS digest", "string(id div 2) AS text")
    named = texts.where("item_id IS NULL OR item_id IN (20, 21, 300)").selectExpr("coalesce(item_id, 7) AS key", "item_id AS id", "digest AS _digest")
    want = [(7, "3"), (20, "10"), (21, "10"), (300, "150")]
    few = audits._texts_of(texts, named)
    assert most_moved(few) <= 4 and sorted(map(tuple, few.collect())) == want
    monkeypatch.setattr(audits, "MAX_NAMED", 3)
    assert sorted(map(tuple, audits._texts_of(texts, named).collect())) == want


def test_footnote_edges_come_once_without_a_shuffle_of_them(spark):
    tables = spark.createDataFrame([("d", "t1", ["1", "1", "9"]), ("d", "t1", ["2"]), ("d", "t2", []), ("d", "t3", None), ("e", "t1", ["1", None])], "node_id string, table_id string, footnote_ids array<string>")
    notes = spark.createDataFrame([("d", "1", "t1"), ("d", "2", "t2"), ("d", "3", "t3"), ("d", "4", "gone"), ("e", "5", None), ("d", "1", "t2")], "node_id string, footnote_id string, parent_table_id string")
    edges, open_ = navigation.footnote_edges(tables, notes)
    of = [("t1", "1"), ("t1", "2"), ("t2", "1"), ("t2", "2"), ("t3", "3")]
    want = [(t, f"d-fn-{n}", "FOOTNOTE_OF") for t, n in of] + [("d", "d-fn-4", "CONTAINS"), ("e", "e-fn-5", "CONTAINS")]
    assert sorted(map(tuple, edges.collect())) == sorted(want) and sorted(map(tuple, open_.collect())) == [("d", 1), ("e", 2)]
    assert "hashpartitioning(source_id" not in edges._jdf.queryExecution().executedPlan().toString()


def test_scan_ratio_cuts_tasks_by_nodes(spark, monkeypatch):
    monkeypatch.setattr(graph, "NODES_PER_TASK", 10)
    nodes = spark.range(100).selectExpr("IF(id < 90, 1, id) AS filing_id", "id AS node_id").union(spark.createDataFrame([(1, 5), (None, 7)], "filing_id bigint, node_id bigint"))
    visited = spark.createDataFrame([(8, 1, 5), (8, 1, 5), (8, 1, 6), (8, 95, 95), (8, 95, 5), (9, None, 7), (None, 1, 0)], "query_id bigint, filing_id bigint, node_id bigint")
    found = graph.scan_ratio(visited, nodes)
    assert sorted(map(tuple, found.fillna(-1).collect())) == [(-1, 1, 1, 91, 1 / 91, False), (8, 1, 2, 91, 2 / 91, False), (8, 95, 1, 1, 1.0, True)]
    assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2 and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_records_of_facts_are_sorted_once(spark):
    rows = [("d", i, a, b) for i, (a, b) in enumerate([("", "period: lost"), ("", "value: 0"), ("A", "value: 1 "), ("", "dimension: x"), ("", "period: p"), ("B", "text"), ("", "period:  q"), ("C", "period: r"), ("", "value: 2"), ("", "decimals: 0"), (None, "decimals: -6"), ("D", None), ("", "valued: 3"), ("E", ""), (None, "value:4")])]
    found = facts.consolidate_facts(spark.createDataFrame([*rows, ("e", 1, " X ", " value: 5"), ("f", 1, "Y", "note")], "doc_id string, ordinal int, left string, right string"))
    got = sorted(map(tuple, found.select("doc_id", "record", "concept", "value", "period", "currency", "decimals").collect()))
    assert got == [("d", 2, "A", "1", "r", None, None), ("d", 3, "B", "2", None, None, "-6"), ("d", 4, "E", "4", None, None, None), ("e", 1, "X", "5", None, None, None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "SortAggregate" not in plan


def test_filings_are_moved_before_they_become_rows(spark, sf_dir):
    found = registry.QUERIES["f1_consolidate_facts"](spark, sf_dir)
    assert 0 < most_moved(found) < 2 * Frames(spark, sf_dir)["orders"].count()
    rows = [("d", [("", "period: lost"), ("A", "value: 1"), ("", "period:"), ("B", "note"), ("", "decimals: 3"), ("", "value: 2"), ("C", "value:")]), ("e", [("", "value: 9"), ("X", "value"), ("", "currency: c"), (None, " value: 4 "), ("Y", "dimension: z")])]
    tables = spark.createDataFrame(rows, "doc_id string, cells array<struct<left: string, right: string>>").repartition(3, "doc_id")
    found = facts.consolidate_facts(tables.select("doc_id", F.posexplode("cells").alias("ordinal", "cell")).select("doc_id", "ordinal", "cell.*"))
    want = [("d", 1, "A", "1", "", None, "3"), ("d", 2, "B", "2", None, None, None), ("d", 3, "C", "", None, None, None), ("e", 2, "X", "4", None, None, None)]
    assert sorted(map(tuple, found.collect())) == want and most_moved(found) <= len(rows)


def test_facts_of_filings_with_one_of_a_concept_stay_where_they_are(spark, monkeypatch):
    rows = [("a", "x", "f1"), ("a", "x", "f2"), ("a", "y", "f3"), ("b", "y", "f4"), ("a", None, "f5"), (None, "x", "f6"), ("b", "z", None)]
    table = spark.createDataFrame(rows, "concept string, accession string, fact_id string")
    want = [("-", "f4", 1), ("f1", "f1", 2), ("f2", "f1", 2), ("f3", "f1", 3), ("f4", "f4", 1)]
    found = graph.same_concept_classes(table)
    assert sorted(map(tuple, found.fillna("-").collect())) == want and most_moved(found) == 0
    monkeypatch.setattr(graph, "MAX_CONCEPTS", 0)
    found = graph.same_concept_classes(table)
    assert sorted(map(tuple, found.fillna("-").collect())) == want and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_paths_are_not_gathered_and_few_nodes_go_to_the_edges(spark, monkeypatch):
    edges = spark.createDataFrame([("r", "a", "CONTAINS"), ("r", "b", "CONTAINS"), ("x", "a", "NEXT"), ("b", "x", "CONTAINS"), ("x", "y", "CONTAINS"), ("x", "y", "NEXT"), ("y", "z", "CONTAINS")], "source_id string, target_id string, edge_type string")
    start = spark.createDataFrame([("r",), ("y",)], "source_id string")
    want = {("r", "r"): ("r", ""), ("r", "x"): ("r,a,x", "CONTAINS,NEXT"), ("r", "y"): ("r,a,x,y", "CONTAINS,NEXT,CONTAINS"), ("y", "r"): ("y,x,a,r", "CONTAINS,NEXT,CONTAINS")}
    for few in (graph.MAX_NODES, 0):
        monkeypatch.setattr(graph, "MAX_NODES", few)
        tree = graph.shortest_path_tree(start, edges, 3)
        pairs = spark.createDataFrame([*want, *want, ("r", "z"), ("y", "gone")], "source_id string, node_id string")
        found = graph.shortest_paths(pairs, tree, 3)
        assert {(r.source_id, r.node_id): (",".join(r.node_ids), ",".join(r.edge_types)) for r in found.collect()} == want
        assert most_moved(found) == 0 and found.where("hops <> size(edge_types)").isEmpty()


def test_keys_of_paths_and_nodes_are_made_before_they_meet(spark, sf_dir):
    plan = optimized(registry.QUERIES["h11_resolve_section_nodes"](spark, sf_dir))
    assert "Join" in plan and not any("regexp" in line for line in plan.splitlines() if "Join" in line)
    nodes = spark.createDataFrame([("n1", "a", "Item 7. MD&A", None), ("n2", "a", None, "a/Item 7"), ("n3", "a", "Item 7A", "a/x"), ("n4", "a", "", None), ("a/Notes", "a", "x", None), ("n5", "b", "Item 7", None)], "node_id string, accession string, label string, section_path string")
    paths = spark.createDataFrame([("a/Item 7",), ("a/Item 7",), ("a/item-7",), ("a/Notes",), ("a/",), ("a/$",), ("a/MD&A",), (None,), ("c/Item 7",), ("Item 7",)], "path string")
    want = [("a/Item 7", "n2", 200), ("a/MD&A", "n1", 112), ("a/Notes", "a/Notes", 200), ("a/item-7", "n2", 115)]
    assert sorted(map(tuple, evidence.resolve_section_nodes(paths, nodes).collect())) == want


def test_filings_of_overrides_are_made_once(spark, sf_dir, monkeypatch):
    given, real = [], publishing.override_items
    monkeypatch.setattr(publishing, "override_items", lambda *tables: (given.extend(tables), real(*tables))[1])
    registry.QUERIES["q23_override_changelog"](spark, sf_dir)
    assert len(given) == 4 and not any("o_custkey" in optimized(df) for df in given)


def test_wanted_paths_go_to_the_index_while_they_are_few(spark, monkeypatch):
    index = spark.range(60).selectExpr("concat('f', id % 5, '-', id) AS accession").selectExpr("accession", "explode(array('Item 7. Management', 'Item 1A', 'Notes')) AS name").selectExpr("accession", "concat(accession, '/', name) AS path")
    snapshot = index.select("accession")
    paths = spark.createDataFrame([("f0-0/Notes",), ("f0-0/item 7",), ("f0-5/note",), ("f9-1/Notes",), ("Notes",), ("item 1a",), ("gone",), (None,)], "path string")
    want = [("Notes", "f0-0/Notes"), ("f0-0/Notes", "f0-0/Notes"), ("f0-0/item 7", "f0-0/Item 7. Management"), ("f0-5/note", "f0-5/Notes"), ("item 1a", "f0-0/Item 1A")]
    few = repair.resolve_known(paths, index, snapshot)
    assert sorted(map(tuple, few.collect())) == want and most_moved(few) < 60
    monkeypatch.setattr(repair, "MAX_WANTED", 0)
    many = repair.resolve_known(paths, index, snapshot)
    assert sorted(map(tuple, many.collect())) == want and "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
