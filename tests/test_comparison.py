"""Comparison answers and claims on hand-made and odd rows."""

from pyspark.sql import functions as F

from filigree.functions import comparison as C

CLAIMS = ["Acme Widgets grew", "Bolt Gears shrank", " ", None, "Acme Widgets beat Bolt Gears"]


def test_answers(spark):
    answers = ["Both Acme's and Bolt 2020 10-K filings discuss item 1A risk factors", "Both Acme and Bolt describe growth, whereas one rose 5%", "x", " ", None, "Both A and B cover " + "w " * 30, "Both A and B cover $1 and $2"]
    table = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "id int, a string")
    rows = table.select("id", C.is_canonical(F.col("a")), C.is_boilerplate(F.col("a")), C.informativeness(F.col("a")), C.entities(F.col("a"))).orderBy("id").collect()
    assert [r[1] for r in rows] == [True, True, False, False, False, True, True]
    assert [r[2] for r in rows] == [True, False, False, False, False, False, False]
    assert [r[3] for r in rows] == [0.0, 0.6, 0.4, 0.0, 0.0, 0.4, 0.4]
    assert [tuple(r[4]) for r in rows] == [("Acme", "Bolt"), ("Acme", "Bolt"), (None, None), (None, None), (None, None), ("A", "B"), ("A", "B")]


def test_claims(spark):
    answer = "Both Acme Widgets and Bolt Gears differ in growth"
    rows = [(0, CLAIMS, answer), (1, CLAIMS[:2], answer), (2, None, answer), (3, [], None), (4, ["In FY2020 it rose", "FY2021 it fell", "While costs rose"], "x"), (5, CLAIMS * 3, answer), (6, ["a", "b", "c"], None)]
    table = spark.createDataFrame(rows, "id int, c array<string>, a string").select("id", C.claim_support(F.col("c"), F.col("a")).alias("s")).orderBy("id")
    assert [tuple(r.s) for r in table.collect()] == [(2, 1, True), (2, 0, False), (0, 0, False), (0, 0, False), (2, 1, True), (2, 3, False), (0, 0, False)]
