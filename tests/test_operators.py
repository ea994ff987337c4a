"""Small literal cases: quirks, nulls, ties, empty tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from filigree.functions import scalars as S
from filigree.operators import dataset, facts, filings, graph, metrics, ranking


def one(spark, **columns):
    row = spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()
    return tuple(row) if len(row) > 1 else row[0]


def test_accession(spark):
    doc = F.lit("x-0000320193-24-000123-s1")
    assert one(spark, a=S.accession_of(doc), b=S.accession_of(F.lit("doc-abc")), c=S.accession_of(F.lit("n1"))) == ("0000320193-24-000123", "abc", "")


def test_period_forms(spark):
    d = datetime.date
    p = lambda t: one(spark, p=S.parse_period(F.lit(t)))
    assert tuple(p("x for period 2023-01-01 to 2023-12-31.")) == (d(2023, 1, 1), d(2023, 12, 31))
    assert tuple(p("x for period January 1, 2023 - Dec 31, 2023")) == (d(2023, 1, 1), d(2023, 12, 31))
    assert tuple(p("x for period 2023-06-30")) == (d(2023, 6, 30), d(2023, 6, 30))
    assert tuple(p("no period")) == (None, None)


def test_values(spark):
    f = lambda v, d: one(spark, x=S.format_fact_value(F.lit(v), F.lit(d)))
    assert f("391035000000", "-6") == "$391.04 billion"
    assert f("5", "") == "$5.00 million"
    assert f("n/a", "-6") == "n/a"
    g = lambda t: one(spark, x=S.parse_display_value(F.lit(t)))
    assert g("$1.5 billion") == 1.5e9 and g("2 million") == 2e6 and g("$1,234.5") == 1234.5 and g("none") is None
    h = lambda t: one(spark, x=S.parse_numeric_gt(F.lit(t)))
    assert h("$3 billion") == 3e9 and h("12.5%") == 12.5 and h("about 3") is None
    assert one(spark, x=S.numeric_equivalent(F.lit("100"), F.lit("101.9"))) is True
    assert one(spark, x=S.numeric_equivalent(F.lit("abc "), F.lit("abc"))) is True


def test_guards_and_intents(spark):
    assert one(spark, x=S.concept_passes_guard(F.lit("StockholdersEquityNote"), F.lit("equity"))) is True
    assert one(spark, x=S.concept_passes_guard(F.lit("EquityOtherMember"), F.lit("equity"))) is False
    assert one(spark, x=S.concept_passes_guard(F.lit("Anything"), F.lit(None))) is True
    assert one(spark, x=S.query_intent(F.lit("explain the trend in revenue"))["intent"]) == "hybrid"
    assert one(spark, x=S.query_anchor(F.lit("sequential quarter sales"))) is None


def test_fiscal_label_of_a_september_year(spark):
    rows = [(1, "a", "10-K", "2024-11-01", "2024-09-28"), (1, "b", "10-Q", "2024-02-01", "2023-12-30"), (1, "c", "10-Q", "2024-05-01", "2024-03-30"), (2, "d", "10-Q", "2024-05-01", "2024-03-30")]
    df = spark.createDataFrame(rows, "issuer_id int, accession string, form_type string, filed_at string, period_end string")
    df = df.withColumns({c: F.to_date(c) for c in ("filed_at", "period_end")})
    got = {r["accession"]: r["label"] for r in filings.fiscal_labels(df).collect()}
    assert got == {"a": "FY2024", "b": "FY2024-Q1", "c": "FY2024-Q2", "d": "FY2024-Q1"}
    assert filings.pair_yoy(df.limit(0), True).count() == 0


def test_consolidation_quirks(spark):
    rows = [(1, 1, "Assets", "value: 1"), (1, 2, "", "period: p"), (1, 3, "", "value: 2"), (1, 4, "Cash", "note"), (1, 5, "", "value: 3"), (1, 6, "", "dimension: d"), (2, 1, "", "value: 9")]
    df = spark.createDataFrame(rows, "doc_id int, ordinal int, left string, right string")
    got = sorted((r["concept"], r["value"], r["period"]) for r in facts.consolidate_facts(df).collect())
    assert got == [("Assets", "1", "p"), ("Assets", "2", None), ("Cash", "3", None)]


def test_metrics_of_one_list(spark):
    lists = spark.createDataFrame([("q", 1, "x"), ("q", 2, "a"), ("q", 3, "a"), ("e", 1, "x")], "item_id string, rank int, chunk_id string")
    marks = spark.createDataFrame([("q", "a"), ("q", "b")], "item_id string, chunk_id string")
    got = {r["item_id"]: r for r in metrics.ranking_metrics(lists, marks).collect()}
    assert got["q"]["mrr"] == 0.5 and got["q"]["map_score"] == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert got["e"]["mrr"] is None and got["e"]["ndcg"] is None


def test_binding_metrics_of_nothing(spark):
    df = spark.createDataFrame([], "predicted array<string>, expected array<string>, should_fail boolean")
    assert tuple(metrics.binding_metrics(df).first()) == (0.0, 0.0, 1.0)


def test_quota_remainders(spark):
    w = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 1.0), ("c", 2, 1.0)], "profile string, ordinal int, weight double")
    assert {r["profile"]: r["target"] for r in dataset.quota_targets(w, 10).collect()} == {"a": 4, "b": 3, "c": 3}


def test_table_hash_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    c = spark.createDataFrame([(2, None), (1, "y")], "k int, v string")
    h = lambda d: dataset.table_hash(d, "k").first()[0]
    assert h(a) == h(b) != h(c)


def test_subsequence(spark):
    seq = F.array(*map(F.lit, "abcd"))
    match = lambda *p: one(spark, x=graph.sequence_matches(seq, F.array(*[F.array(*map(F.lit, q)) for q in p])))
    assert match("ac") and match("zz", "bd") and not match("ca")


def test_topk_edge_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [2.0, 0.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = ranking.dense_topk(v.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding"), v, 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 3, 2] and got[1]["score"] == pytest.approx(1.0)
    assert ranking.dense_topk(v.limit(0).select(F.col("vec_id").alias("query_id"), "embedding"), v).count() == 0


def test_plans_use_no_python_rows(spark, sf_dir):
    from filigree.plans import registry

    for name in ("b5_parse_fact_excerpt", "d6_pair_yoy", "f1_consolidate_facts", "m4_ranking_metrics"):
        text = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_top_k_is_pruned_early(spark, sf_dir):
    from filigree.plans import registry

    assert "WindowGroupLimit" in registry.QUERIES["d2_dedupe_filings"](spark, sf_dir)._jdf.queryExecution().toString()


def test_best_sentences_against_brute_force(spark, sf_dir):
    import re

    from filigree.operators import text

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = ["the", "of", "and"]
    got = {}
    for r in text.best_sentences(docs, words).collect():
        got.setdefault(r["doc_id"], set()).add((r["position"], r["sentence"], r["score"]))
    for d, t in docs.collect():
        scored = [(i, s, sum(w in s.lower() for w in words)) for i, s in enumerate(re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", t)) if len(s) >= 50]
        assert got.get(d, set()) == set(sorted(scored, key=lambda x: (-x[2], x[0]))[:2])


def test_item_sections_need_two_headings(spark):
    from filigree.operators import text

    body = "word " * 200
    docs = spark.createDataFrame([(1, f"x Item 1. Business {body} Item 1A. Risk Factors {body}"), (2, f"Item 7. Discussion {body}"), (3, None)], "doc_id int, text string")
    assert sorted((r["doc_id"], r["item"]) for r in text.split_items(docs).collect()) == [(1, "1"), (1, "1A")]


def test_divestiture_phrases(spark):
    from filigree.operators import review

    docs = spark.createDataFrame([(1, "It sold the retail unit for $1.1 billion."), (2, "It sold nothing."), (3, None)], "doc_id int, text string")
    assert [tuple(r) for r in review.divestiture_facts(docs).collect()] == [(1, 1.1e9, "the retail unit")]


def test_review_rules_on_nothing(spark):
    from filigree.operators import review

    none = spark.createDataFrame([], "item_id string, required array<string>, full_scan boolean, path_matched boolean")
    row = review.gold_path_eval(none, spark.createDataFrame([], "item_id string, chunk_id string")).first()
    assert row["n"] == 0 and row["path_rate"] == 0.0 and not row["passed"]
    assert one(spark, x=review.weakest_criterion(F.create_map(F.lit("b"), F.lit(0.2), F.lit("a"), F.lit(0.2), F.lit("trajectory_fidelity"), F.lit(0.0)))) == "a"


def test_sections_are_cut_into_windows_whole(spark):
    body = "".join(f"{i:07d} " for i in range(12_500))
    sections = spark.createDataFrame([("a", body), ("b", "short"), ("c", None)], "section_id string, body string")
    for chars in (200, graph.WINDOW_CHARS):
        rows = sorted((r["section_id"], r["window"], r["text"]) for r in graph.chunk_sections(sections, chars).collect())
        assert rows == [("a", k, body[k * chars : (k + 1) * chars]) for k in range(-(-len(body) // chars))]


def test_item_bodies_are_whole(spark):
    from filigree.operators import text

    body = "word " * 20_000
    docs = spark.createDataFrame([(1, f"Item 1. Business <b>{body}</b> Item 1A. Risk Factors {body}")], "doc_id int, text string")
    got = {r["item"]: r["body"] for r in text.split_items(docs).collect()}
    assert got == {"1": f"Item 1. Business {body.strip()}", "1A": f"Item 1A. Risk Factors {body.strip()}"}
