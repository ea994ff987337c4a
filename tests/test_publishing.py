"""Rules, scores, gates and overrides of benchmark items on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from filigree.operators import publishing as P

ITEM = (
    "item_id string, issuer_id int, profile string, tag string, question string, answer string, rubric string, answer_type string, claims array<string>, accessions array<string>,"
    "paths array<string>, periods array<string>, is_comparison boolean, multi boolean"
)
A, B = "0000000001-20-000001", "0000000001-19-000001"
GOOD = dict(
    item_id="x1", issuer_id=1, profile="numeric", tag="factoid", question="What was net income?", answer="12", rubric=None, answer_type="numeric", claims=[], accessions=[A], paths=[f"{A}/Item 7"],
    periods=["FY2020"], is_comparison=False, multi=False,
)
BOTH = dict(tag="Multi-Hop", answer_type="comparison", accessions=[A, B], answer="Both Alpha Corp and Beta Inc discuss supply, whereas costs differ", claims=["Alpha grew", "Beta shrank", "Both companies compare"], is_comparison=True)
SHORT = "Both Alpha Corp and Beta Inc discuss supply"


@pytest.fixture(scope="module")
def tables(spark):
    index = spark.createDataFrame([(A, f"{A}/Item 7"), (B, f"{B}/Item 7")], "accession string, path string")
    filings = spark.createDataFrame([(1, A, 2020, "10-K", 2020), (1, B, 2019, "10-K", 2019)], "issuer_id int, accession string, fy int, form_type string, y int").withColumn("period_end", F.make_date("y", F.lit(12), F.lit(31)))
    return index, index.select("accession"), filings.withColumn("filed_at", F.col("period_end"))


def items(spark, *changes):
    names = [c.strip().split(" ")[0] for c in ITEM.split(",")]
    rows = [{**GOOD, "item_id": f"x{i}", **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ITEM)


#: What is changed in a good item, and the reasons that newer and older bundles give.
CASES = [
    ({}, [], []), (BOTH, [], []), ({"item_id": "LIVE-numeric"}, ["v1_item_reuse"], []), ({"item_id": "abc-0001"}, ["v1_item_reuse"], []), ({"item_id": "abc-00001"}, [], []), ({"item_id": "v2-1234"}, [], []),
    ({"answer": None}, ["missing_answer_gt"], []), ({"answer": " "}, ["missing_answer_gt"], ["required_claims"]), ({"answer": "Sales were up in all the regions", "answer_type": "narrative", "claims": None}, ["required_claims"], ["required_claims"]),
    ({"answer_type": "narrative", "claims": ["a", " ", None, "b"]}, [], []), ({"answer_type": "narrative", "claims": ["c"] * 9}, ["required_claims"], []), ({**BOTH, "answer_type": "numeric"}, ["invalid_answer_type"], []),
    ({**BOTH, "answer": None}, ["missing_answer_gt", "missing_answer_gt"], []), ({**BOTH, "answer": SHORT}, ["boilerplate_comparison_answer"], []), ({**BOTH, "accessions": [A, A]}, ["comparison_bindings", "comparison_bindings"], ["comparison_bindings"]),
    ({**BOTH, "claims": ["one"]}, ["required_claims", "required_claims"], []), ({"tag": "a Reference", "accessions": [A, "other"]}, ["reference_corpus", "macro_bindability"], ["reference_corpus"]),
    ({"tag": "reference", "answer_type": None}, [], ["rubric_route"]), ({"tag": "reference", "answer_type": None, "rubric": "r"}, [], []), ({"question": "What was it in 2019?"}, ["question_binding_year_mismatch"], ["question_binding_year_mismatch"]),
    ({"question": "What was it in 2019?", "periods": None}, [], []), ({"question": None}, [], []), ({"paths": None}, ["missing_section_paths"], ["missing_section_paths"]), ({"paths": ["elsewhere/Notes"]}, ["section_unreachable"], ["section_unreachable"]),
    ({"paths": ["elsewhere/Notes"], "answer": None}, ["missing_answer_gt"], []), ({"accessions": None}, ["macro_bindability"], []), ({"question": "Year over year or quarter over quarter?"}, ["macro_bindability"], []),
]


@pytest.mark.parametrize("newer", (True, False))
def test_rules(spark, tables, newer):
    drafts = items(spark, *[c[0] for c in CASES])
    told = {c[0].get("item_id", f"x{i}"): c[1 if newer else 2] for i, c in enumerate(CASES)}
    found = {k: [] for k in told}
    for r in P.blocked_items(drafts.withColumn("rule", F.lit(1)), *tables, newer).orderBy("rule").collect():
        found[r["item_id"]].append(r["reason"])
    assert found == told


def test_empty_corpus_and_no_items(spark, tables):
    index, snapshot, filings = tables
    drafts = items(spark, {"paths": ["elsewhere/Notes"], "tag": "reference", "accessions": ["other"]})
    assert P.blocked_items(drafts, index.limit(0), snapshot.limit(0), filings, False).count() == 0
    none = P.blocked_items(drafts.limit(0), *tables)
    assert none.count() == 0 and P.blocked_reasons(none).count() == 0 and P.scorability(drafts.limit(0)).count() == 0
    row = P.all_gates(drafts.limit(0), none, spark.createDataFrame([], "status string"), declared=0, newer=False).first()
    assert (row["item_count"], row["answer_gt_coverage"], row["first_item"], row["violations"]) == (0, 0.0, None, ["too_few_items", "pass_rate"])


def test_gates_open_and_close(spark, tables):
    good = spark.createDataFrame([("accepted",)] * 19 + [("rejected",)], "status string")
    two = items(spark, {}, BOTH)
    held = P.blocked_items(two, *tables).cache()
    gates = lambda drafts, blocked=held, **k: P.all_gates(drafts, blocked, good, **{"declared": 2, "least": 2, "several": 1, **k}).first()["violations"]
    assert gates(two) == [] and gates(two, newer=False) == [] and gates(two, pass_rate=0.96, newer=False) == ["pass_rate"]
    assert gates(two, several=0) == ["multi_filing"] and gates(two, several=-1) == [] and gates(two, several=2) == ["multi_filing"]
    assert gates(two, declared=3, signed=False) == ["count_differs", "not_signed"] and gates(two, least=3) == ["too_few_items", "too_few_rows"]
    bad = items(spark, BOTH, {"answer": "", "rubric": "r", "paths": []}, {**BOTH, "answer": SHORT, "paths": ["nowhere/else"]})
    assert gates(bad, P.blocked_items(bad, *tables), declared=3) == ["infeasible", "coverage", "rubric_only", "boilerplate", "unreachable"]
    rows = {r["answer_type"]: tuple(r)[1:] for r in P.scorability(bad.unionByName(items(spark, {"answer_type": None}, {**BOTH, "answer": SHORT + " $3 and $4"}))).collect()}
    assert rows == {"comparison": (3, 3, 0, 1, 1), "numeric": (1, 0, 1, 0, 0), "unknown": (1, 1, 0, 0, 0)}


def test_overrides(spark, tables):
    index, snapshot, _ = tables
    drafts = items(spark, {}, {}, {}, {"question": ""}).withColumn("annotation", F.lit("of an item")).drop("annotation")
    patch = "item_id string, annotation long, question string, paths array<string>, answer string, rubric string"
    patches = spark.createDataFrame([("x0", 1, "", [f"{B}/item 7"], None, None), ("x1", 2, "New?", ["nowhere"], "13", "r"), ("none", 3, "Q", None, None, None), ("x3", 4, "Asked again?", None, None, None), ("x2", 5, None, None, None, None)], patch)
    log, new = P.override_items(drafts, patches, index, snapshot)
    told = {r["annotation"]: (r["item_id"], r["changed"], r["outcome"], r["errors"], len(r["parent_hash"])) for r in log.collect()}
    assert told == {
        1: ("x0", ["expected_section_paths"], "accepted", [], 64), 2: ("x1", ["question", "expected_section_paths", "ground_truth"], "rejected", ["unknown_section_path:nowhere"], 64),
        3: ("none", [], "rejected", ["item_not_found"], 0), 4: ("x3", ["question"], "accepted", [], 64), 5: ("x2", [], "accepted", [], 64),
    }
    rows = {r["item_id"]: (r["question"], r["answer"], r["paths"]) for r in new.collect()}
    ask = GOOD["question"]
    assert rows == {"x0": (ask, "12", [f"{B}/Item 7"]), "x1": (ask, "12", GOOD["paths"]), "x2": (ask, "12", GOOD["paths"]), "x3": ("Asked again?", "12", GOOD["paths"])}
