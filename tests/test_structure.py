"""Sections, references, snapshots, corpora and aligned questions on small and odd rows."""

import datetime

from pyspark.sql import functions as F

from filigree.functions import scalars as S
from filigree.operators import filings, graph, review, text

DAY = datetime.date(2004, 12, 31)


def test_references_go_back_in_the_same_document(spark):
    rows = [("d", "a", 0, None), ("d", "b", 1, "a"), ("d", "c", 2, "e"), ("d", "e", 3, "e"), ("d", "f", 4, "x"), ("d", "g", 5, ""), ("o", "h", 1, "a")]
    found = graph.reference_edges(spark.createDataFrame(rows, "node_id string, section_id string, ordinal int, parent_id string")).collect()
    assert sorted((r.source_id, r.target_id, r.resolved) for r in found) == [("b", "a", True), ("c", "e", False), ("e", "e", True), ("f", "x", False), ("h", "a", False)]
    empty = spark.createDataFrame([], "node_id string, section_id string, ordinal int, parent_id string")
    assert graph.reference_edges(empty).collect() == []


def test_status_of_full_empty_and_orphaned_filings(spark):
    nodes = spark.createDataFrame([("a", "a", "DOCUMENT"), ("a", "a1", "SECTION"), ("a", "a2", "CHUNK_PARAGRAPH"), ("b", "b", "DOCUMENT"), ("b", "b1", "CHUNK_TABLE"), ("c", "c", "DOCUMENT"), ("c", "c1", "SECTION"), ("c", "c2", "CHUNK_ROW")], "accession string, node_id string, node_type string")
    edges = spark.createDataFrame([("a", "a", "a1", "CONTAINS"), ("a", "a1", "a2", "CONTAINS"), ("c", "c", "c1", "CONTAINS"), ("c", "c1", "c2", "NEXT")], "accession string, source_id string, target_id string, edge_type string")
    references = spark.createDataFrame([("a", True), ("a", False), ("c", False)], "accession string, resolved boolean")
    got = {r.accession: tuple(r)[1:] for r in graph.materialize_status(nodes, edges, references).collect()}
    assert got == {"a": ("included", None, 3, 2, 1), "b": ("failed", "no_sections_or_facts", 0, 0, 0), "c": ("failed", "orphans", 3, 2, 1)}


def test_sections_are_ordered_by_item_then_id(spark):
    nodes = spark.createDataFrame([("s1", "SECTION", ""), ("s2", "SECTION", None), ("s3", "SECTION", "7"), ("s4", "SECTION", "1A"), ("p", "CHUNK_PARAGRAPH", None), ("n", "CHUNK_FOOTNOTE", None)], "node_id string, node_type string, item_number string")
    edges = spark.createDataFrame([("d", s, "CONTAINS") for s in ("s1", "s2", "s3", "s4")] + [("s3", "p", "CONTAINS"), ("s3", "n", "CONTAINS")], "source_id string, target_id string, edge_type string")
    found = graph.table_of_contents(spark.createDataFrame([("d",)], "root_id string"), nodes, edges, 3).orderBy("position").collect()
    assert [(r.section_id, r.n_children) for r in found] == [("s4", 0), ("s3", 1), ("s1", 0)]


def test_explicit_corpora(spark):
    filed = [(1, f"f{k}", "10-K" if k < 2 else "10-Q", DAY, DAY - datetime.timedelta(90 * k)) for k in range(8)] + [(1, "f0b", "10-K", DAY - datetime.timedelta(1), DAY)]
    table = spark.createDataFrame(filed, "issuer_id int, accession string, form_type string, filed_at date, period_end date")
    kind = "corpus_id int, issuer_id int, mode string, annual int, quarterly int, trailing_years int, from_date date, to_date date, accessions array<string>, cap int"
    corpora = [(1, 1, "explicit", None, None, None, None, None, ["f0b", "f3", "f3", "zz"], 9), (2, 1, "explicit", None, None, None, None, None, [], 9), (3, 1, "trailing", 9, 9, 1, None, None, None, 9), (4, 1, "explicit", 1, 1, None, None, None, ["f1", "f2"], 1)]
    got = sorted((r.corpus_id, r.accession or "", r.status) for r in filings.resolve_corpus(spark.createDataFrame(corpora, kind), table).collect())
    assert got == [(1, "f0b", "ok"), (1, "f3", "ok"), (1, "zz", "unknown"), (2, "", "no_accessions"), (3, "f0", "ok"), (3, "f2", "ok"), (3, "f3", "ok"), (3, "f4", "ok"), (3, "f5", "ok"), (4, "f1", "over_cap"), (4, "f2", "over_cap")]


def test_narratives_are_appended(spark):
    documents = spark.createDataFrame([("a", "ha", False), ("b", "hb", True), ("c", "hc", None), ("e", None, False)], "accession string, content_hash string, skip boolean")
    sections = spark.createDataFrame([("a", 4, "x"), ("b", 0, "y")], "accession string, ordinal int, body string")
    html = spark.createDataFrame([("a", 0, "h"), ("a", 1, None), ("b", 0, "h"), ("c", 0, "h")], "accession string, ordinal int, body string")
    merged, found = text.merge_narrative(documents, sections, html)
    assert sorted((r.accession, r.ordinal, r.from_html) for r in merged.collect()) == [("a", 4, False), ("a", 5, True), ("a", 6, True), ("b", 0, False), ("c", 0, True)]
    got = {r.accession: r for r in found.collect()}
    assert [(k, got[k].html_status, got[k].n_sections) for k in "abce"] == [("a", "success", 3), ("b", "skipped", 1), ("c", "success", 1), ("e", "failed", 0)]
    assert got["b"].content_hash == "hb" and got["e"].content_hash is None and len(got["a"].content_hash) == 64 != got["c"].content_hash


def test_years_move_to_the_latest_bound_one(spark):
    rows = [("From 2001 to 2005, 20201", ["FY2005", "2003-Q1"]), ("In 2001", ["Q1"]), ("In 2001", []), ("2001", ["FY2002"]), ("", ["FY2002"]), (None, ["FY2002"]), ("no year", ["FY2002"])]
    table = spark.createDataFrame(rows, "q string, labels array<string>")
    got = [r.a for r in table.select(S.align_question_years(F.col("q"), F.col("labels")).alias("a")).collect()]
    assert got == ["From 2005 to 2005, 20051", "In 2001", "In 2001", "2002", "", None, "no year"]


def test_judged_again(spark):
    before = spark.createDataFrame([("a", 0.1), ("b", None), ("c", 0.5), ("d", 0.0)], "item_id string, outcome double")
    after = spark.createDataFrame([("a", 0.2), ("b", 0.3), ("c", 0.5), ("e", 1.0)], "item_id string, outcome double")
    changes = spark.createDataFrame([("a", True, "Regenerated"), ("a", True, None), ("b", True, "x"), ("c", True, ""), ("d", True, "x"), ("e", None, "regenerate"), ("z", False, "x")], "item_id string, accepted boolean, rationale string")
    assert [tuple(r) for r in review.rejudge_delta(before, after, changes).collect()] == [(5, 1, 3, 2, 2 / 3)]
    assert [tuple(r) for r in review.rejudge_delta(before, after, changes.where("false")).collect()] == [(0, 0, 0, 0, 0.0)]
