"""Audits against plain Python, and odd rows."""

import datetime
import re

from filigree.operators import audits

PROPOSAL = "query_id int, issuer_id int, question string, summary string, pinned array<string>, proposed array<string>, target_year int, form string"
FILING = "issuer_id int, accession string, form_type string, period_end date"
DAY = datetime.date(2004, 12, 31)


def windows(text, width=5):
    words = text.split(" ")
    return {text} if len(words) < width else {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def alike(a, b):
    return len(a & b) / len(a | b)


def texts():
    """A chain of texts, each near the next, copies in other case and spacing, short and empty ones, a null."""
    base = [f"w{i}" for i in range(120)]
    chain = [" ".join(base[:100 - 3 * k] + [f"x{k}_{i}" for i in range(3 * k)]) for k in range(9)]
    return [*chain, chain[0].upper() + "  ", chain[4].replace(" ", "\n", 3), "short text", "Short  text", "", None, "  ", "alone among the texts of this test"]


def plain(t):
    return re.sub("[ \t\r\n]+", " ", (t or "").strip(" ").lower())


def test_keep_first_and_nearest_match_a_loop(spark):
    rows = list(enumerate(texts()))
    items = spark.createDataFrame(rows, "item_id bigint, question string")
    sets = {i: windows(plain(t)) for i, t in rows}
    kept, nearest = [], {}
    for i, _ in rows:
        scores = [(-(1.0 if plain(texts()[i]) == plain(texts()[j]) else alike(sets[i], sets[j])), j) for j in range(i)]
        near = min((s for s in scores if -s[0] >= 0.85), default=None)
        if near:
            nearest[i] = (near[1], round(-near[0], 9))
        if not any(alike(sets[i], sets[j]) >= 0.85 for j in kept):
            kept.append(i)
    assert [r.item_id for r in audits.keep_first(items).where("kept").orderBy("item_id").collect()] == kept
    assert len(kept) < len(rows) - 4
    found = {r.item_id: (r.match_id, round(r.similarity, 9)) for r in audits.nearest_duplicates(items).collect()}
    assert found == nearest and any(s < 1 for _, s in nearest.values())


def test_keep_first_of_no_items(spark):
    none = spark.createDataFrame([], "item_id bigint, question string")
    assert audits.keep_first(none).count() == 0 and audits.nearest_duplicates(none).count() == 0


def test_binding_codes(spark):
    filings = spark.createDataFrame([(1, "a", "10-K", DAY), (1, "a", "10-K", DAY), (1, "b", "10-Q", DAY)], FILING)
    cases = [
        (1, 9, "revenue", "s", None, None, None, None, ("failed", "empty_corpus")),
        (2, 1, "yoy and qoq", "s", ["a"], None, None, None, ("failed", "ambiguous_comparison")),
        (3, 1, "revenue", "s", ["a"], ["b"], None, None, ("failed", "cli_nl_conflict")),
        (4, 1, "revenue", "s", ["a"], ["a"], 2003, "10-K", ("failed", "temporal_mismatch")),
        (5, 1, "revenue", "s", ["a"], None, 2004, "10-K", ("approved", None)),
        (6, 1, None, None, None, None, None, None, ("failed", "invalid_proposal")),
        (7, 1, "compare both", "s", None, ["a"], None, None, ("narrowed", "missing_comparison_partner")),
        (8, 1, "compare both", "s", None, ["zz"], None, None, ("failed", "missing_comparison_partner")),
        (9, 1, "revenue", "s", None, ["zz"], None, None, ("failed", "invalid_pairing")),
        (10, 1, "revenue", "s", None, None, None, None, ("failed", "invalid_accession")),
        (11, 1, "compare both", "s", [], ["a", "b"], None, None, ("approved", None)),
        (12, None, "revenue", "s", None, None, None, None, ("failed", "empty_corpus")),
    ]
    proposals = spark.createDataFrame([c[:-1] for c in cases], PROPOSAL)
    bound = spark.createDataFrame([(10, "zz")], "query_id int, accession string")
    found = {r.query_id: (r.status, r.code) for r in audits.validate_binding(proposals, bound, filings).collect()}
    assert found == {c[0]: c[-1] for c in cases}


def test_bindability_of_odd_items(spark):
    filings = spark.createDataFrame([(1, "a", "10-K", DAY)], FILING)
    items = spark.createDataFrame([("x", 1, "q", ["a"]), ("y", 1, "q", None), ("z", 1, "yoy or qoq", ["a"]), ("w", 1, None, ["a", "b"])], "item_id string, issuer_id int, question string, accessions array<string>")
    assert {tuple(r) for r in audits.macro_bindability(items, filings).collect()} == {("y", "missing_accessions"), ("z", "ambiguous_comparison"), ("w", "not_in_manifest")}


def test_failure_classes_in_order(spark):
    columns = "answer string, truth string, question string, rationale string, path string, binding_miss boolean, outcome double, mrr double, retrieval_fidelity double, paths array<string>, numeric boolean, comparison boolean, want string"
    rows = [
        (None, None, None, None, None, None, None, None, None, None, None, None, "abstention"),
        ("Cannot determine, about 5", "4", "q", None, "", False, 0.0, 0.9, 1.0, [], False, False, None),
        ("It grew", "x", "q", "Incorrect issuer", "", False, 0.0, 0.9, 1.0, [], False, False, "binding_error"),
        ("Based on 2 evidence chunks", "x", "q", None, "template", False, 0.0, 0.1, 1.0, [], False, False, "synthesis_template_dump"),
        ("It grew", "7", "q", None, "", False, 1.0, 0.5, 1.0, ["a/xbrl facts"], False, False, "numeric_xbrl_miss"),
        ("It grew", "x", "q", None, "", False, 0.0, 0.1, 1.0, [], False, True, "comparison_narrative_miss"),
        ("It grew", "x", "q", None, "", False, 1.0, 0.5, 0.0, [], False, False, "retrieval_label_mismatch"),
        ("It is 5", "5 billion", "q", None, "", False, 0.0, 0.5, 1.0, [], False, False, "gt_issue_suspected"),
        ("It is 5", "5", "how many billion", None, "", False, 0.0, 0.5, 1.0, [], False, False, "gt_issue_suspected"),
    ]
    found = audits.failure_class(spark.createDataFrame(rows, columns)).select("want", "failure_class").collect()
    assert [r.failure_class for r in found] == [r.want for r in found]


def test_resolution_of_odd_rows(spark):
    fact = "array<struct<concept string, period_start date, period_end date, is_annual boolean, segment string>>"
    at = lambda c, d=DAY, s=None: (c, datetime.date(2004, 1, 1), d, True, s)
    rows = [
        (1, "margin", None, 2004, "10-K", [at("IncomeLossBeforeIncomeTaxes"), at("Revenues")]), (2, "margin", None, None, None, [at("Revenues"), at("NetIncomeLoss")]), (3, None, None, None, None, None),
        (4, "segment_revenue", "Upstream", None, None, [at("SegmentRevenue", s="Upstream oil"), at("SegmentRevenue")]), (5, "tax_rate", None, None, None, [at("IncomeTaxExpenseBenefit"), at("StatutoryRate", datetime.date(2003, 12, 31))]),
    ]
    df = spark.createDataFrame(rows, f"id int, family string, segment string, target_year int, form string, facts {fact}")
    found = {r.id: r.rejections for r in audits.validate_resolution(df, 2).collect()}
    assert found == {1: ["pretax_numerator", "ratio_roles"], 2: [], 3: ["too_few_facts"], 4: ["segment"], 5: ["forbidden", "guard", "mixed_periods", "ratio_roles"]}


def test_review_rows_and_picks_of_odd_rows(spark):
    rows = spark.createDataFrame([(None,) * 6, ("i", "gt_wrong", "YES", "", None, "q"), ("i", "gt_wrong", "1", "nope", "a", None)], "item_id string, failure_class string, corpus_spot_check string, apply string, proposed_answer string, proposed_question string")
    assert [r.skipped for r in audits.review_rows(rows).collect()] == ["no_item", None, "apply_refused"]
    evidence = spark.createDataFrame([(1, 1, "revenue $5 million", True), (1, 2, "RevenueFromContract $7 billion", True), (1, 0, "RevenueFromContract $9 billion", None), (2, 0, None, True)], "query_id int, rank int, excerpt string, aligned boolean")
    assert [tuple(r) for r in audits.best_revenue_amount(evidence).collect()] == [(1, "$7 billion")]
