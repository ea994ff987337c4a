"""Ratio pairs against all pairs in plain Python, and odd rows."""

import datetime
import random

from filigree.operators import facts

ASKED = "query_id int, issuer_id int, question string, metric_type string, family string, target_year int, form string"
FACT = "issuer_id int, accession string, form_type string, fact_id string, concept string, value_num bigint, period_start date, period_end date"


def day(y, m, d):
    return datetime.date(y, m, d)


def test_best_pairs(spark):
    draw = random.Random(5)
    ends = [day(2003, 12, 31), day(2004, 12, 31), day(2004, 6, 30), None]
    rows = []
    for i in range(90):
        end = draw.choice(ends)
        start = end and (day(end.year, 1, 1) if draw.random() < 0.6 else day(end.year, end.month - 2, 1))
        rows.append((i % 3, "a", "10-K", f"f{i:02}", draw.choice(["NetIncomeLoss", "ProfitLoss", "Revenues", "SalesRevenueNet", "Assets"]), draw.randrange(0, 4), start, end))
    rows.append((7, "a", "10-K", "alone", "NetIncomeLoss", 1, None, None))
    queries = [(i, i, "net income margin and sales", "ratio", "margin", None, None) for i in range(3)] + [(3, 0, "margin", "point", None, None, None), (4, 9, "margin", "ratio", "margin", None, None), (5, 7, "margin", "ratio", "margin", None, None), (6, 0, None, None, None, None, None), (7, 1, "net income margin and sales", "ratio", "margin", None, None)]
    got = {r.query_id: r for r in facts.ratio_pairs(spark.createDataFrame(queries, ASKED), spark.createDataFrame(rows, FACT)).collect()}
    assert len(got) == 8
    assert [got[i].reason for i in (3, 4, 5, 6)] == ["unsupported", "no_candidates", "missing_side", "unsupported"]

    def score(r):
        year = r[7] is not None and r[6] is not None and (r[6].month, r[6].day, r[7].month, r[7].day) == (1, 1, 12, 31)
        hit = r[4] in ("Revenues", "SalesRevenueNet")  # of a question's hints the first counts, here "sales"
        return 5 * year + 2 * hit + (r[7] is not None and (r[7].month, r[7].day) == (12, 31))

    for q in (0, 1, 2, 7):
        mine = [r for r in rows if r[0] == queries[q][1]]
        pairs = [(-score(n) - score(d), -((n[7] or d[7]) or datetime.date.min).toordinal(), n[3], d[3], n[5], d[5]) for n in mine for d in mine if n[4] in ("NetIncomeLoss", "ProfitLoss") and d[4] in ("Revenues", "SalesRevenueNet") and (n[7] == d[7] or None in (n[7], d[7]))]
        s, _, n, d, v, w = min(pairs)
        assert (got[q].num_fact, got[q].den_fact, got[q].score, got[q].reason) == (n, d, -s, None)
        assert got[q].ratio == (v / abs(w) * 100 if w else None)


def test_no_facts(spark):
    found = facts.ratio_pairs(spark.createDataFrame([(1, 1, "margin", "ratio", "margin", None, None)], ASKED), spark.createDataFrame([], FACT)).collect()
    assert [(r.kind, r.reason) for r in found] == [("margin", "no_candidates")]
    assert facts.ratio_pairs(spark.createDataFrame([], ASKED), spark.createDataFrame([], FACT)).collect() == []
