"""Disclosure-shaped views over the driver tables, as SQL that Spark and DuckDB both read.

Each view names the tables and views that it needs. :class:`Frames` builds them as DataFrames;
:func:`with_views` gives the same text as common table expressions for an oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # A filing: the orders of a customer in a calendar quarter. Issuer: the customer, but the customers
    # of one in six are parts of one hot issuer, with many filings of a period. Every fifth issuer has
    # a fiscal year that ends in June. Some filings are filed again, later.
    "filings": (("orders",), """
        WITH q AS (
          SELECT CAST(CASE WHEN o_custkey % 6 = 1 THEN 1 ELSE o_custkey END AS INT) AS issuer_id, CAST(o_custkey AS INT) AS filer,
                 CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents
          FROM {orders} GROUP BY 1, 2, 3, 4),
        f AS (
          SELECT issuer_id, filer, lpad(CAST(issuer_id AS STRING), 10, '0') AS cik, y, q, CAST(cents AS BIGINT) AS cents,
                 CASE WHEN q = (CASE WHEN issuer_id % 5 = 0 THEN 2 ELSE 4 END) THEN '10-K' ELSE '10-Q' END AS form_type,
                 make_date(y, q * 3, CASE WHEN q IN (2, 3) THEN 30 ELSE 31 END) AS period_end
          FROM q),
        a AS (
          SELECT *, 0 AS again FROM f
          UNION ALL SELECT *, 1 AS again FROM f WHERE (filer + y + q) % 7 = 0)
        SELECT issuer_id, cik,
               lpad(CAST(filer AS STRING), 10, '0') || '-' || lpad(CAST(y % 100 AS STRING), 2, '0') || '-' || lpad(CAST(q + 90 * again AS STRING), 6, '0') AS accession,
               form_type, period_end + CAST(30 + (filer * 7 + y * 3 + q) % 16 + 20 * again AS INT) AS filed_at, period_end,
               y, q, cents
        FROM a"""),
    # The newest filings of every issuer and form, to which questions and items are bound.
    "recent": (("filings",), """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id, form_type ORDER BY period_end DESC, filed_at DESC, accession DESC) AS n FROM {filings}) AS ranked WHERE n <= 2"""),
    "facts": (("filings",), """
        SELECT issuer_id, accession, form_type, 'xbrl-' || lower(concept) || '-' || accession AS fact_id, concept,
               CAST(floor(cents * pct / 10000.0) AS BIGINT) AS value_num,
               CASE WHEN form_type = '10-K' AND issuer_id % 5 = 0 THEN make_date(y - 1, 7, 1)
                    WHEN form_type = '10-K' THEN make_date(y, 1, 1) ELSE make_date(y, q * 3 - 2, 1) END AS period_start,
               period_end
        FROM {filings} CROSS JOIN (VALUES ('Revenues', 100), ('CostOfRevenue', 61), ('NetIncomeLoss', 12), ('IncomeTaxExpenseBenefit', 4),
             ('IncomeLossBeforeIncomeTaxes', 16), ('Assets', 310), ('StockholdersEquity', 140), ('CashAndCashEquivalents', 22),
             ('InventoryNet', 18), ('LiabilitiesCurrent', 90)) AS c(concept, pct)"""),
    "excerpts": (("facts",), """
        SELECT fact_id, accession, concept, value_num,
               'XBRL ' || concept || ': $' || CAST(CAST(value_num AS BIGINT) AS STRING) ||
               CASE WHEN value_num % 3 = 0 THEN ' million' WHEN value_num % 3 = 1 THEN ' billion' ELSE ' USD' END ||
               CASE WHEN value_num % 5 = 0 THEN '' WHEN value_num % 5 = 1 THEN ' for period ' || CAST(period_end AS STRING)
                    ELSE ' for period ' || CAST(period_start AS STRING) || ' - ' || CAST(period_end AS STRING) END AS excerpt
        FROM {facts}"""),
    # A question for each benchmark passage and anchor word; the passage only lends its id and text.
    "questions": (("benchmark",), """
        SELECT CAST(item_id * 12 + n AS BIGINT) AS query_id, item_id, CAST(CASE WHEN item_id % 6 = 1 THEN 1 ELSE item_id + 2 END AS INT) AS issuer_id, question
        FROM {benchmark} CROSS JOIN (VALUES (0, 'What was revenue in the latest 10-K?'), (1, 'How did net income change compared to prior year?'),
          (2, 'What is the effective tax rate for the fiscal year 2000?'), (3, 'Summarise the risk factors of the annual report'),
          (4, 'What were total assets in the most recent quarter?'), (5, 'Explain the revenue trend and management outlook, Q2'),
          (6, 'Dividend payout ratio for FY1999 and cash on hand'), (7, 'Energy Products segment revenue, quarter over quarter'),
          (8, 'What did the prior quarter 10-Q say about liquidity discussion and strategy?'), (9, 'Shareholder equity and margin in billion'),
          (10, 'Change in total assets for the fiscal year 2000'), (11, 'Describe the business')) AS t(n, question)"""),
    # Retrieved lists: the documents of a source ranked for a labelled item; relevant by label.
    "rankings": (("labels",), """
        SELECT CAST(doc_id % 97 AS BIGINT) AS item_id, CAST(row_number() OVER (PARTITION BY doc_id % 97 ORDER BY (doc_id * 7919) % 1009, doc_id) AS INT) AS rank,
               CAST(doc_id AS STRING) AS chunk_id, (quality = 0 OR toxic = 1) AS relevant
        FROM {labels} WHERE doc_id IS NOT NULL"""),
    "results": (("labels",), """
        SELECT v.variant_id, 'item-' || CAST(doc_id AS STRING) AS item_id, CAST(doc_id % 4 AS INT) AS profile_no,
               CASE WHEN doc_id % 4 = 0 THEN 'numeric' WHEN doc_id % 4 = 1 THEN 'comparison' WHEN doc_id % 4 = 2 THEN 'narrative' ELSE 'binding' END AS profile,
               CASE WHEN (doc_id * 3 + v.n) % 11 = 0 THEN 'incomplete' WHEN (doc_id + v.n) % 13 = 0 THEN 'degraded'
                    WHEN (doc_id + v.n) % 17 = 0 THEN 'non_reproducible' WHEN (doc_id + v.n) % 19 = 0 THEN 'pending' ELSE 'complete' END AS status,
               CASE WHEN doc_id % 6 <> 0 THEN ((doc_id * 31 + v.n * 17) % 101) / 100.0E0 END AS outcome,
               ((doc_id * 13 + v.n * 5) % 101) / 100.0E0 AS alignment,
               CASE WHEN quality = 1 THEN ((doc_id * 7 + v.n * 3) % 101) / 100.0E0 END AS mrr,
               CASE WHEN quality = 1 THEN ((doc_id * 11 + v.n) % 101) / 100.0E0 END AS ndcg,
               CASE WHEN doc_id % 5 = 0 THEN 'html' WHEN doc_id % 5 IN (1, 2) THEN 'xbrl' WHEN doc_id % 5 = 3 THEN 'mixed' ELSE 'unknown' END AS stratum,
               (doc_id % 9 = 0) AS abstained, (doc_id % 3 <> 0) AS has_answer
        FROM {labels} CROSS JOIN (VALUES ('graph-full', 0), ('flat-chunk', 1), ('ablation-no-macro', 2), ('ablation-no-walker', 3), ('ablation-xbrl-only', 4)) AS v(variant_id, n)
        WHERE doc_id IS NOT NULL"""),
    "annotations": (("events",), """
        SELECT user_id AS item_no, 'item-' || CAST(user_id AS STRING) AS item_id, ts AS created_at, event_id AS ordinal, event_type AS failure_class,
               (event_id % 3 <> 0) AS spot_check, CASE WHEN event_id % 4 = 0 THEN 'override ' || CAST(event_id AS STRING) END AS proposed
        FROM {events}"""),
    "items": (("labels",), """
        SELECT 'item-' || CAST(doc_id AS STRING) AS item_id,
               CASE WHEN doc_id % 4 = 0 THEN 'numeric' WHEN doc_id % 4 = 1 THEN 'comparison' WHEN doc_id % 4 = 2 THEN 'narrative' ELSE 'binding' END AS profile,
               CASE WHEN doc_id % 3 = 0 THEN 'short_label' WHEN doc_id % 3 = 1 THEN 'numeric' ELSE 'narrative' END AS answer_type,
               CAST(CASE WHEN doc_id % 6 = 1 THEN 1 ELSE doc_id + 2 END AS INT) AS issuer_id, quality, toxic
        FROM {labels} WHERE doc_id IS NOT NULL"""),
    # What a planner makes of a question: filings that the caller fixed or the planner named, and a fiscal year.
    "proposals": (("questions", "recent"), """
        SELECT query_id, q.issuer_id, CASE WHEN query_id % 7 = 3 THEN question || ' year over year and qoq' ELSE question END AS question,
               CASE WHEN query_id % 11 <> 5 THEN 'find filings' END AS summary, CASE WHEN query_id % 5 = 0 THEN accession END AS pinned,
               CASE WHEN query_id % 8 = 4 THEN accession WHEN query_id % 8 IN (1, 5) THEN '9999999999-00-000000' END AS proposed,
               CAST(CASE WHEN query_id % 3 = 0 THEN y + query_id % 2 END AS INT) AS target_year, CASE WHEN query_id % 3 = 0 THEN '10-K' END AS form
        FROM {questions} q LEFT JOIN (SELECT issuer_id, accession, y FROM {recent} WHERE n = 1 AND form_type = '10-K') r ON r.issuer_id = q.issuer_id"""),
    # Results with answers, truths and what a judge said of them.
    "judged": (("results",), """
        SELECT variant_id, item_id, outcome, mrr, CASE WHEN profile_no = 0 THEN alignment ELSE 0.0E0 END AS retrieval_fidelity, (profile = 'numeric') AS numeric, (profile = 'comparison') AS comparison, (profile = 'binding' AND abstained) AS binding_miss,
               CASE WHEN abstained THEN 'Insufficient evidence.' WHEN stratum = 'html' THEN 'Based on 3 evidence chunks: see below' WHEN stratum = 'xbrl' THEN 'It was $' || CAST(profile_no + 1 AS STRING) || ',250 million'
                    WHEN stratum = 'mixed' THEN 'Revenue of 12.5, whereas costs fell' ELSE '' END AS answer,
               CASE WHEN status = 'complete' AND has_answer THEN '$1,300 million' WHEN has_answer THEN '9.75' ELSE 'Both grew' END AS truth,
               CASE WHEN profile_no = 2 THEN 'How many billion was it?' ELSE 'What was it?' END AS question, CASE WHEN status = 'degraded' THEN 'Cites the wrong filing' END AS rationale,
               CASE WHEN profile_no = 1 THEN 'template' WHEN profile_no = 2 THEN 'cached' END AS path, CASE WHEN profile_no <> 3 THEN 'x/Xbrl Financial Facts' ELSE 'x/item_7' END AS section_path
        FROM {results}"""),
    # Documents as questions of items, for the copies among them.
    "asked": (("documents",), "SELECT doc_id AS item_id, text AS question FROM {documents} WHERE doc_id IS NOT NULL"),
    # Answers that compare a customer with its nation, and claims, with semicolons between them.
    "compared": (("customer", "nation"), """
        SELECT c_custkey, CASE CAST(c_custkey % 8 AS INT) WHEN 0 THEN 'Both ' || c_name || chr(39) || 's and ' || n_name || ' Inc 10-K filings discuss risk factors'
                 WHEN 1 THEN 'Both ' || c_name || ' and ' || n_name || ' describe growth, whereas sales rose 12.5% and 3% in ' || c_mktsegment WHEN 2 THEN ' Both ' || c_name || ' and ' || n_name || ' differ in ' || c_mktsegment
                 WHEN 3 THEN n_name || ' paid $1,250 and $3.50 while ' || c_name || ' did not' WHEN 4 THEN '  ' WHEN 6 THEN 'Both ' || c_name || ' and ' || n_name || ' cover ' || repeat('supply or demand of parts ', 6)
                 WHEN 7 THEN 'BOTH ' || c_name || ' and ' || n_name || ' FY2020 10-Q mention item 1A' END AS answer,
               CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN c_name || ' grew;' || n_name || ' shrank; ;Both companies grew' WHEN 1 THEN c_name || ' grew in its 2020 10-K;' || n_name || ' compared to peers;The 2019 10-K and FY2020 10-Q agree'
                 WHEN 2 THEN 'FY2020 result;In the 2021 10-K it rose;It is common;' || c_name || ' met ' || n_name WHEN 3 THEN '' END AS claims
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""),
    # Items as they were published, with paths that are good, loosely spelt, pieces of answers, unknown, of
    # another filing of the filer, without an accession, misplaced or absent. Lists are split at semicolons.
    "bundle": (("items", "recent"), """
        WITH a AS (SELECT issuer_id AS issuer, min(accession) AS a1, max(accession) AS a2 FROM {recent} GROUP BY 1),
        b AS (SELECT item_id, profile, CAST(substr(item_id, 6) AS BIGINT) AS n, a1, CASE WHEN a2 > a1 THEN a1 || ';' || a2 ELSE a1 END AS accessions, a2 FROM {items} JOIN a ON issuer = issuer_id),
        c AS (SELECT *, CAST((n - n % 7) / 7 AS BIGINT) % 9 AS k FROM b)
        SELECT item_id, profile, n, CASE WHEN n % 13 = 4 THEN '' WHEN n % 13 = 5 THEN a1 || ';9999999999-00-000000' ELSE accessions END AS accessions,
               CASE CAST(n % 7 AS INT) WHEN 0 THEN 'What was revenue and the outlook in item 7?' WHEN 1 THEN 'Compare risk factors across the two filings' WHEN 2 THEN 'How much were the proceeds from sale of the Singapore retail business in Q2 2003?'
                 WHEN 3 THEN 'Which segment grew, by revenue?' WHEN 4 THEN '  ' WHEN 5 THEN 'Does the company discuss supply risk?' ELSE 'What was net income?' END AS question,
               CASE CAST(k AS INT) WHEN 0 THEN a1 || '/Item 1A. Risk Factors;' || a2 || '/Item 1A. Risk Factors' WHEN 1 THEN a1 || '/item 1a' WHEN 2 THEN a1 || '/sanctions of $5 billion in trade' WHEN 3 THEN a1 || '/Exhibits;' || a2 || '/XBRL Financial Facts'
                 WHEN 4 THEN a1 || '/Item 1. Business' WHEN 5 THEN '' WHEN 6 THEN substr(a1, 1, 10) || '-50-000001/Item 7' WHEN 7 THEN 'XBRL Financial Facts' ELSE '0000000000-00-000000/Notes' END AS paths,
               CASE CAST(n % 11 AS INT) WHEN 0 THEN '$1.1 billion' WHEN 1 THEN '12.50%' WHEN 2 THEN 'Both Alpha Corp 2020 10-K and Beta Inc 2019 10-K discuss supply, whereas costs differ' WHEN 3 THEN 'Demand grew in all regions of the market; Costs were lower than a year before. Prices held.'
                 WHEN 4 THEN '' WHEN 5 THEN 'Energy Products' WHEN 6 THEN '1,234.5' WHEN 7 THEN repeat('word and more ', 12) WHEN 8 THEN 'The Singapore retail fuels business was sold' WHEN 10 THEN '0.25 mm' END AS answer,
               CASE CAST(n % 4 AS INT) WHEN 1 THEN 'Sales rose;Costs fell' WHEN 2 THEN 'Alpha rose in its 2020 10-K;Beta fell;Both companies compare' WHEN 3 THEN 'one' END AS claims,
               CASE CAST(n % 5 AS INT) WHEN 1 THEN 'numeric' WHEN 2 THEN 'narrative' WHEN 3 THEN 'comparison' WHEN 4 THEN 'short_label' END AS answer_type, (n % 17 = 2) AS is_comparison
        FROM c"""),
    # Drafts to be published: the bundle with issuers, tags, rubrics, periods and a question that mixes comparisons.
    "drafts": (("bundle", "items"), """
        SELECT b.item_id, i.issuer_id, b.profile, b.n, b.accessions, b.paths, b.claims, b.answer_type, b.is_comparison, (b.n % 9 = 1) AS multi,
               CASE WHEN b.n % 23 = 3 THEN 'How did sales grow year over year and quarter over quarter in 2003?' ELSE b.question END AS question,
               CASE CAST(b.n % 19 AS INT) WHEN 7 THEN 'Both Alpha Corp and Beta Inc discuss supply' WHEN 8 THEN '  ' WHEN 9 THEN 'Both Alpha Corp and Beta Inc cover risk; a dispute of $3 against $4 was settled' ELSE b.answer END AS answer,
               CASE CAST(b.n % 6 AS INT) WHEN 0 THEN 'Comparison of filings' WHEN 1 THEN 'multi-hop' WHEN 2 THEN 'Reference lookup' WHEN 3 THEN 'cross-filing reference' WHEN 4 THEN 'factoid' END AS tag,
               CASE CAST(b.n % 4 AS INT) WHEN 0 THEN 'a point for each fact' WHEN 1 THEN ' ' END AS rubric,
               CASE CAST(b.n % 4 AS INT) WHEN 0 THEN 'FY2003;Q2 2004' WHEN 1 THEN 'FY2001' WHEN 2 THEN 'latest' END AS periods
        FROM {bundle} b JOIN {items} i ON i.item_id = b.item_id"""),
    # Containment: region, nation, customer, order; ids as graph node ids.
    "nodes": (("region", "nation", "customer", "orders"), """
        SELECT 'r-' || CAST(r_regionkey AS STRING) AS node_id, 'DOCUMENT' AS node_type, r_name AS label FROM {region}
        UNION ALL SELECT 'n-' || CAST(n_nationkey AS STRING), 'SECTION', n_name FROM {nation}
        UNION ALL SELECT 'c-' || CAST(c_custkey AS STRING), 'CHUNK_TABLE', c_name FROM {customer}
        UNION ALL SELECT 'o-' || CAST(o_orderkey AS STRING), 'CHUNK_ROW', o_orderpriority FROM {orders}"""),
    "edges": (("nation", "customer", "orders"), """
        SELECT 'r-' || CAST(n_regionkey AS STRING) AS source_id, 'n-' || CAST(n_nationkey AS STRING) AS target_id, 'CONTAINS' AS edge_type FROM {nation}
        UNION ALL SELECT 'n-' || CAST(c_nationkey AS STRING), 'c-' || CAST(c_custkey AS STRING), 'CONTAINS' FROM {customer}
        UNION ALL SELECT 'c-' || CAST(o_custkey AS STRING), 'o-' || CAST(o_orderkey AS STRING), 'CONTAINS' FROM {orders}
        UNION ALL SELECT 'n-' || CAST(n_nationkey AS STRING), 'n-' || CAST((n_nationkey + 1) % 25 AS STRING), 'NEXT' FROM {nation}
        UNION ALL SELECT 'c-' || CAST(c_custkey AS STRING), 'n-' || CAST((c_custkey * 7) % 25 AS STRING), 'REFERENCES' FROM {customer} WHERE c_custkey % 10 = 0"""),
    "doc_lines": (("documents",), """
        SELECT doc_id, source, text, 'doc-' || lpad(CAST(doc_id % 25 AS STRING), 10, '0') || '-' || lpad(CAST(doc_id % 100 AS STRING), 2, '0') || '-' || lpad(CAST(doc_id AS STRING), 6, '0') AS node_id
        FROM {documents} WHERE doc_id IS NOT NULL"""),
}

#: What Spark computes in another form, with the same values: a quotient of decimals takes longer than the rest of a
#: fact, one of whole numbers next to nothing; and an excerpt is made by a generator, so that it is made once a row
#: and not again in each of the conditions on it, which Spark would move below it.
SPARK_FORMS = {
    "facts": lambda sql: sql.replace("CAST(floor(cents * pct / 10000.0) AS BIGINT)", "(cents * pct - pmod(cents * pct, 10000)) div 10000"),
    "excerpts": lambda sql: sql.replace("'XBRL ' ||", "explode(array('XBRL ' ||").replace("END AS excerpt", "END)) AS excerpt"),
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Frames:
    """DataFrames of the tables in a directory and of the views over them, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in TABLES:
                self._built[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                needs, _ = VIEWS[name]
                self._built[name] = self.over(name, **{n: self[n] for n in needs})
        return self._built[name]

    def over(self, name: str, **needs: DataFrame) -> DataFrame:
        """A view over other tables than those of the directory, as over some of the filings."""
        return self.spark.sql(SPARK_FORMS.get(name, str)(VIEWS[name][1]), **needs)

    def replaced(self, **views: DataFrame) -> Frames:
        """Frames that build all other views over these."""
        out = Frames(self.spark, self.sf_dir)
        out._built |= views
        return out

    @cached_property
    def parallelism(self) -> int:
        return self.spark.sparkContext.defaultParallelism


def with_views(sql: str, *names: str) -> str:
    """An oracle over views: their text in front, in order of need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in VIEWS[name][0]:
            if n in VIEWS and n not in order:
                visit(n)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({VIEWS[n][1].format(**{d: d for d in VIEWS[n][0]})})" for n in order]
    body, head = sql.strip(), "WITH "
    if body.startswith("WITH RECURSIVE "):
        body, head = "WITH " + body[15:], "WITH RECURSIVE "
    if body.startswith("WITH"):
        return head + ", ".join(parts) + ", " + body[4:].strip()
    return head + ", ".join(parts) + " " + body
