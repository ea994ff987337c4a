"""Readers and writers on tiny files, and package checks on literal rows."""

import json

from filigree.sources import readers as R


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_manifest(spark, tmp_path):
    m = {"resolution": {"ticker": "T", "cik": "1", "accession": "a", "form_type": "10-K", "filed_at": "2024-11-01", "period_end": "2024-09-28"}, "artifacts": [{"filename": "x.xsd", "role": "schema"}], "complete": True}
    row = R.read_filing_manifests(spark, put(tmp_path / "manifest.json", json.dumps(m))).first()
    assert row["accession"] == "a" and str(row["filed_at"]) == "2024-11-01" and row["artifacts"][0]["role"] == "schema"


def test_parsed_documents(spark, tmp_path):
    d = {"filing": {"accession": "a"}, "sections": [{"section_id": "s1", "text": "x"}, {"section_id": "s2"}], "tables": [{"table_id": "t", "rows": [["1", "2"], ["3"]]}], "footnotes": [{"footnote_id": "f"}]}
    t = R.read_parsed_documents(spark, put(tmp_path / "d.json", json.dumps(d)))
    assert [t[k].count() for k in ("documents", "sections", "tables", "table_rows", "footnotes")] == [1, 2, 1, 2, 1]
    assert t["sections"].orderBy("ordinal").collect()[1]["section_id"] == "s2"


def test_graphml(spark, tmp_path):
    text = """<graphml><key id="d0" for="node" attr.name="label"/><key id="d1" for="edge" attr.name="edge_type"/><graph>
<node id="a"><data key="d0">A</data></node><node id="b"/><edge source="a" target="b"><data key="d1">CONTAINS</data></edge></graph></graphml>"""
    nodes, edges = R.read_graphml(spark, put(tmp_path / "g.graphml", text))
    assert {r["node_id"]: r["properties"] for r in nodes.collect()} == {"a": {"label": "A"}, "b": {}}
    e = edges.first()
    assert (e["source_id"], e["target_id"], e["edge_type"]) == ("a", "b", "CONTAINS")


def test_graphml_of_several_files(spark, tmp_path):
    one = """<graphml><key id="d0" for="node" attr.name="label"/><key id="d1" for="edge" attr.name="edge_type"/><graph>
<node id="a"><data key="d0">A</data><data key="d0">B</data></node><edge source="a" target="b"><data key="d1">CONTAINS</data></edge></graph></graphml>"""
    two = """<graphml><key id="d0" for="edge" attr.name="edge_type"/><key id="d1" for="node" attr.name="node_type"/><graph>
<node id="a"><data key="d1">SECTION</data><data key="d7">?</data></node><edge source="a" target="b"><data key="d0">NEXT</data></edge><edge source="a" target="b"><data key="d0">NEXT</data></edge></graph></graphml>"""
    put(tmp_path / "one.graphml", one)
    put(tmp_path / "two.graphml", two)
    nodes, edges = R.read_graphml(spark, str(tmp_path / "*.graphml"))
    assert sorted((r["file"][-11:-8], r["node_id"], tuple(r["properties"].items())) for r in nodes.collect()) == [("one", "a", (("label", "B"),)), ("two", "a", (("node_type", "SECTION"),))]
    assert sorted((r["file"][-11:-8], r["edge_type"]) for r in edges.collect()) == [("one", "CONTAINS"), ("two", "NEXT"), ("two", "NEXT")]


def test_items_results_paths(spark, tmp_path):
    items = put(tmp_path / "dev.jsonl", '{"item_id": "i1", "question": "q"}\n\n{"item_id": "i2"}\n')
    assert sorted(r["item_id"] for r in R.read_items(spark, items).collect()) == ["i1", "i2"]
    for v in ("a", "b"):
        put(tmp_path / "r" / v / "results.json", json.dumps([{"item_id": "i1", "status": "complete", "ranking": {"mrr": 0.5}}]))
    assert sorted((r["variant_id"], r["ranking"]["mrr"]) for r in R.read_results(spark, str(tmp_path / "r")).collect()) == [("a", 0.5), ("b", 0.5)]
    index = put(tmp_path / "index.json", json.dumps({"paths": ["a/x", "a/x", "b/y"]}))
    assert sorted(tuple(r) for r in R.read_path_index(spark, index).collect()) == [("a/x", "a"), ("b/y", "b")]


def test_snapshot_and_tables_round_trip(spark, tmp_path):
    n = spark.createDataFrame([(1, "s", "n1")], "issuer_id int, snapshot_id string, node_id string")
    for _ in range(2):
        R.write_snapshot(n, n, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap" / "nodes")).count() == 1
    R.write_metric_tables({"headline": n}, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "headline")).first()["node_id"] == "n1"


def test_taxonomy(spark):
    loc = spark.createDataFrame([("l1", "x.xsd#us-gaap_Assets")], "label string, href string")
    arcs = spark.createDataFrame([("l1", "t1")], "source string, target string")
    labels = spark.createDataFrame([("t1", "Total assets")], "label string, text string")
    assert tuple(R.concept_labels(loc, arcs, labels).first()) == ("Assets", "Total assets")
    tree = {r["concept"]: (r["parents"], r["children"]) for r in R.calc_hierarchy(spark.createDataFrame([("P", "a"), ("P", "b")], "parent string, child string")).collect()}
    assert tree == {"P": ([], ["a", "b"]), "a": (["P"], []), "b": (["P"], [])}


def test_packages(spark):
    art = spark.createDataFrame([("a", "i.xml", "instance"), ("a", "s.xsd", "schema"), ("b", "z.zip", "xbrl_zip"), ("b", "gone.xml", "instance")], "accession string, filename string, role string")
    files = spark.createDataFrame([("a", "i.xml", 500), ("a", "s.xsd", 5), ("b", "z.zip", 10)], "accession string, filename string, length long")
    assert {r["accession"]: r["errors"] for r in R.validate_packages(art, files).collect()} == {"a": [], "b": ["missing_artifact", "no_instance", "no_schema", "small_zip"]}
    names = spark.createDataFrame([("a", "R1.htm"), ("a", "aapl-20250927.htm"), ("a", "a-very-long-exhibit-20250927.htm"), ("b", "x.htm")], "accession string, filename string")
    assert {tuple(r) for r in R.narrative_files(names).collect()} == {("a", "aapl-20250927.htm"), ("b", "x.htm")}
    one = spark.createDataFrame([("a", "x", bytearray(b"1")), ("a", "manifest.json", bytearray(b"2"))], "accession string, filename string, content binary")
    two = spark.createDataFrame([("a", "manifest.json", bytearray(b"3")), ("a", "x", bytearray(b"1"))], "accession string, filename string, content binary")
    assert R.package_hashes(one).first() == R.package_hashes(two).first()


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("x", [1.0])], "node_id string, embedding array<float>")
    c = spark.createDataFrame([("a",), ("b",)], "node_id string")
    assert tuple(R.vectors_valid(v, c, 2).first()) == (1, 1, 1, False)


def linkbase(kind, links, prefix=""):
    """A linkbase of links (role, locators {label: concept}, arcs [(from, to)], labels {label: (role, text)})."""
    out = []
    for role, locators, arcs, labels in links:
        rows = [f'<{prefix}loc xlink:type="locator" xlink:href="d.xsd#x_{c}" xlink:label="{n}"/>' for n, c in locators.items()]
        rows += [f'<{prefix}label xlink:label="{n}" xlink:role="http://www.xbrl.org/2003/role/{r}">{t}</{prefix}label>' for n, (r, t) in labels.items()]
        rows += [f'<{prefix}{kind}Arc xlink:from="{a}" xlink:to="{b}" xlink:arcrole="http://www.xbrl.org/2003/arcrole/{r}"/>' for a, b, r in arcs]
        out.append(f'<{prefix}{kind}Link xlink:role="{role}">{"".join(rows)}</{prefix}{kind}Link>')
    return f'<linkbase xmlns="http://www.xbrl.org/2003/linkbase" xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink">{"".join(out)}</linkbase>'


def test_taxonomies_of_two_folders(spark, tmp_path):
    say = [("a", "ta", "concept-label"), ("b", "tb", "concept-label"), ("a", "tc", "concept-label"), ("zz", "ta", "concept-label")]
    put(tmp_path / "one" / "d_lab.xml", linkbase("label", [("r", {"a": "ProfitLoss", "b": "Us_Pretax"}, say, {"ta": ("label", "Net income (loss)"), "tb": ("terseLabel", "Pre-tax"), "tc": ("label", "Second")})]))
    put(tmp_path / "one" / "d_pre.xml", linkbase("presentation", [("http://x/Notes", {"a": "ProfitLoss"}, [], {}), ("http://x/StatementOfIncome", {"a": "ProfitLoss", "b": "Revenues"}, [], {}), ("http://x/Notes", {"c": "ProfitLoss"}, [], {})]))
    sums = [("a", "b", "summation-item"), ("a", "c", "summation-item"), ("a", "b", "summation-item"), ("b", "c", "other"), ("a", "gone", "summation-item")]
    put(tmp_path / "one" / "d_cal.xml", linkbase("calculation", [("r", {"a": "Pretax", "b": "Tax", "c": "ProfitLoss"}, sums, {})]))
    # The same locator names stand for other concepts here, in prefixed elements.
    put(tmp_path / "two" / "d_lab.xml", linkbase("label", [("r", {"a": "Sales"}, [("a", "ta", "concept-label")], {"ta": ("label", "Total revenue")})], "link:"))
    put(tmp_path / "two" / "d_cal.xml", linkbase("calculation", [("r", {"a": "Sales", "b": "Assets"}, [("b", "a", "summation-item")], {}), ("s", {"a": "Assets", "b": "Sales"}, [("a", "b", "summation-item")], {})], "link:"))
    put(tmp_path / "two" / "other.xml", "<x/>")
    from filigree.sources.taxonomies import read_taxonomies

    got = {(r["folder"][-3:], r["concept"]): tuple(r)[2:] for r in read_taxonomies(spark, str(tmp_path / "*")).collect()}
    assert got == {
        ("one", "ProfitLoss"): ("Net income (loss)", None, None, "income_statement", ["http://x/Notes", "http://x/StatementOfIncome"], ["Pretax"], [], ["net_income", "margin_numerator"]),
        ("one", "Us_Pretax"): (None, "Pre-tax", None, "other", [], [], [], ["pretax_income"]),
        ("one", "Revenues"): (None, None, None, "income_statement", ["http://x/StatementOfIncome"], [], [], []),
        ("one", "Pretax"): (None, None, None, "other", [], [], ["Tax", "ProfitLoss"], []),
        ("one", "Tax"): (None, None, None, "other", [], ["Pretax"], [], []),
        ("two", "Sales"): ("Total revenue", None, None, "other", [], ["Assets"], [], ["revenue", "total_revenue", "margin_denominator"]),
        ("two", "Assets"): (None, None, None, "other", [], [], ["Sales"], []),
    }
