"""Queries over what questions ask for and the evidence for it, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intents as I
from ..functions import scalars as S
from ..functions.lineage import written
from ..operators import evidence as E
from ..operators import facts as O
from ..sources.views import Frames
from . import rules_sql as Q
from .plan import Plans

PLANS = Plans()

_YEARS = r"regexp_extract_all(question, '\b(20[0-9]{2})\b', 1)"
_INTENTS = f"""
a AS (SELECT query_id, question || CASE item_id % 4 WHEN 0 THEN ' in 2004' WHEN 1 THEN ' from 2003 to 2005' ELSE '' END AS question,
  CASE item_id % 5 WHEN 0 THEN ['FY200' || (item_id % 7) || '-Q1'] WHEN 1 THEN ['', '2006-FY'] WHEN 2 THEN ['latest'] END AS labels, CASE item_id % 6 WHEN 0 THEN 'FY2008' WHEN 3 THEN ' prior_quarter' WHEN 4 THEN '' END AS anchor FROM questions),
b AS (SELECT query_id, question, lower(question) AS q, {_YEARS} AS years, nullif({Q.label("anchor")}, '') AS named, list_filter(list_transform(coalesce(labels, []), lambda x: {Q.label("x")}), lambda x: x <> '') AS own FROM a),
c AS (SELECT *, CASE WHEN len(own) > 0 THEN own WHEN named IS NOT NULL THEN [named] ELSE [] END AS known, regexp_matches(q, '\\b(q[1-4]|quarter|10-q|10 q)\\b') AS quarter FROM b),
d AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(named, '^FY([0-9]{{4}})', 1), '') AS INT), list_filter(list_transform(known, lambda x: try_cast(nullif(regexp_extract(x, '^FY([0-9]{{4}})', 1), '') AS INT)), lambda y: y IS NOT NULL)[1],
    CASE WHEN len(years) = 1 THEN years[1]::INT END) AS target,
  CASE WHEN {Q.has("q", *I.YOY_WORDS)} THEN 'yoy' WHEN {Q.has("q", *I.QOQ_WORDS)} THEN 'qoq' WHEN len(years) >= 2 AND {Q.has("q", *I.RANGE_WORDS)} THEN 'yoy' END AS compare,
  (NOT quarter AND (regexp_matches(q, '\\bfy20[0-9]{{2}}\\b') OR (contains(q, 'fiscal year') AND regexp_matches(q, '\\b20[0-9]{{2}}\\b')))) OR (len(known) > 0 AND NOT quarter) AS annual FROM c),
e AS (SELECT *, coalesce(target, years[1]::INT) AS year FROM d)"""


@PLANS.add("b21_temporal_intent", f"""
WITH {_INTENTS} SELECT query_id, CASE WHEN annual THEN 'latest_annual' WHEN quarter THEN coalesce(named, 'latest_quarter') ELSE named END AS anchor, CASE WHEN annual THEN year WHEN NOT quarter THEN target END::INT AS target_year,
  CASE WHEN annual THEN '10-K' WHEN quarter THEN '10-Q' END AS form, CASE WHEN annual OR NOT quarter THEN compare END AS comparison,
  array_to_string(CASE WHEN annual THEN CASE WHEN year IS NOT NULL THEN ['FY' || year] ELSE known END WHEN quarter THEN known ELSE [] END, ',') AS labels FROM e""", ("questions",))
def temporal(f: Frames) -> DataFrame:
    n = F.col("item_id")
    question = F.concat("question", F.when(n % 4 == 0, " in 2004").when(n % 4 == 1, " from 2003 to 2005").otherwise(""))
    labels = F.when(n % 5 == 0, F.array(F.concat(F.lit("FY200"), n % 7, F.lit("-Q1")))).when(n % 5 == 1, F.array(F.lit(""), F.lit("2006-FY"))).when(n % 5 == 2, F.array(F.lit("latest")))
    anchor = F.when(n % 6 == 0, "FY2008").when(n % 6 == 3, " prior_quarter").when(n % 6 == 4, "")
    t = I.temporal_intent(question, labels, anchor)
    return f["questions"].select("query_id", t["anchor"].alias("anchor"), t["target_year"].alias("target_year"), t["form"].alias("form"), t["comparison"].alias("comparison"), F.array_join(t["labels"], ",").alias("labels"))


#: Items about sales of assets, footnotes, officers and the like, beside the plain questions.
_MORE = (", proceeds from sale of the Singapore retail business in Q2 2003", ", divestments in the third quarter of 2004", " and the footnote on executive pay", "", " by geographic segment, MD&A", ", Item 1A risk", " asset sale q1 2005")
_ASKED = f"""
i AS (SELECT query_id, issuer_id, question || CASE item_id % {len(_MORE)} {" ".join(f"WHEN {k} THEN {Q.quoted(m)}" for k, m in enumerate(_MORE))} END AS question, CASE WHEN item_id % 9 = 0 THEN 'net 1.1 billion' END AS answer FROM questions),
j AS (SELECT *, lower(question) AS q, lower(question || ' ' || coalesce(answer, '')) AS every, regexp_extract(question, '(?i)\\b(?:q([1-4])|(first|second|third|fourth)\\s+quarter)\\s+(?:of\\s+)?(20[0-9]{{2}})\\b', ['n', 'w', 'y']) AS g FROM i),
k AS (SELECT *, {Q.has("every", *I.DIVESTITURE_TERMS)} AS sold, CASE WHEN g.y <> '' THEN CASE WHEN g.n <> '' THEN try_cast(g.n AS INT) ELSE list_position(['first', 'second', 'third', 'fourth'], lower(g.w)) END WHEN regexp_matches(q, '\\bq1\\b') THEN 1 END AS quarter,
  CASE WHEN g.y <> '' THEN try_cast(g.y AS INT) WHEN regexp_matches(q, '\\bq1\\b') THEN try_cast(nullif(regexp_extract(question, '\\b(20[0-9]{{2}})\\b', 1), '') AS INT) END AS year FROM j),
l AS (SELECT *, sold AND (quarter IS NOT NULL OR {Q.has("q", "q1", "q2", "q3", "q4", "quarter")}) AS quarterly FROM k),
m AS (SELECT *, {Q.hints("q", "every", "sold", "quarterly")} AS found FROM l),
h AS (SELECT *, CASE WHEN len(found) > 0 THEN found WHEN {Q.has("q", "compare", "comparison")} THEN ['item 7', 'management', 'mda'] ELSE ['item 7', 'management'] END AS hints FROM m)"""


def _asked(f: Frames) -> DataFrame:
    n, more = F.col("item_id") % len(_MORE), F.array(*map(F.lit, _MORE))
    return f["questions"].select("query_id", "issuer_id", F.concat("question", F.get(more, n.cast("int"))).alias("question"), F.when(F.col("item_id") % 9 == 0, "net 1.1 billion").alias("answer"), F.lit(None).cast("string").alias("truth"))


@PLANS.add("b40_divestiture_flags", f"WITH {_ASKED} SELECT query_id, sold AS is_divestiture, quarter::INT AS quarter, year::INT AS year, quarterly AS is_quarterly FROM h", ("questions",))
def divestitures(f: Frames) -> DataFrame:
    return _asked(f).select("query_id", I.divestiture_flags(F.col("question"), F.col("answer"), F.col("truth")).alias("d")).select("query_id", "d.*")


@PLANS.add("b41_section_hints", f"WITH {_ASKED} SELECT query_id, array_to_string(hints, ',') AS hints FROM h", ("questions",))
def hinted(f: Frames) -> DataFrame:
    return _asked(f).select("query_id", F.array_join(I.section_hints(F.col("question"), F.col("answer"), F.col("truth")), ",").alias("hints"))


_TAILS = ("Item 7. Management Discussion", "XBRL Financial Facts", "Item 1. Business", "risk_factors", "10-Q Item 2 Management 03-31", "net sales of $4 billion", "Notes")
_INDEX = f"p AS (SELECT accession, accession || '/' || tail AS path, tail, lower(tail) AS t FROM recent CROSS JOIN (SELECT unnest([{', '.join(map(Q.quoted, _TAILS))}]) AS tail))"


def _index(f: Frames) -> DataFrame:
    return f["recent"].select("accession", F.explode(F.array(*map(F.lit, _TAILS))).alias("tail")).select("accession", F.concat_ws("/", "accession", "tail").alias("path"))


@PLANS.add("h13_pick_section_path", f"""
WITH {_ASKED}, {_INDEX},
s AS (SELECT query_id AS item_id, p.accession, path, (3 * len(list_filter(hints, lambda x: contains(t, x))) + CASE WHEN contains(t, 'xbrl') AND list_has_any(hints, ['xbrl', 'financial facts']) THEN 5 ELSE 0 END
  + CASE WHEN regexp_matches(t, 'item ?[0-9]') THEN 2 ELSE 0 END + CASE WHEN sold THEN CASE WHEN contains(t, 'item 1') AND contains(t, 'business') THEN -25 ELSE 0 END + CASE WHEN contains(t, 'xbrl') THEN -20 ELSE 0 END + CASE WHEN contains(t, '10-q') THEN 10 ELSE 0 END
  + CASE WHEN {Q.has("t", "management", "discussion", "item 2", "item 7")} THEN 8 ELSE 0 END + CASE WHEN contains(t, year::VARCHAR) THEN 4 ELSE 0 END + CASE WHEN quarter = 1 AND contains(t, '03-31') THEN 3 ELSE 0 END ELSE 0 END)::INT AS score
  FROM h JOIN recent USING (issuer_id) JOIN p ON p.accession = recent.accession WHERE NOT contains(tail, '$'))
SELECT item_id, accession, path, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id, accession ORDER BY score DESC, path) = 1""", ("questions", "recent"))
def picked(f: Frames) -> DataFrame:
    items = _asked(f).join(f["recent"].select("issuer_id", "accession"), "issuer_id").withColumnRenamed("query_id", "item_id")
    return E.pick_section_paths(items, _index(f))


@PLANS.add("h11_resolve_section_nodes", f"""
WITH n AS (SELECT accession, accession || '-s' || o AS node_id, label, CASE WHEN o = 1 THEN accession || '/Item 7' END AS section_path FROM recent CROSS JOIN (VALUES (0, 'Item 7. Management Discussion'), (1, 'Discussion'), (2, 'Item 1A. Risk'), (3, 'Item 7A'), (4, 'Financial Facts')) AS v(o, label)),
w AS (SELECT accession, accession || '/' || tail AS path, tail, regexp_replace(lower(tail), '[^a-z0-9]', '', 'g') AS k FROM recent CROSS JOIN (SELECT unnest(['Item 7', 'Item 1A', 'risk', 'Financial', 'item-7a', 'Exhibits']) AS tail)),
c AS (SELECT path, node_id, tail, k, nullif(regexp_extract(k, '(item[0-9]+[a-z]?)', 1), '') AS item, label, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS lk, coalesce(section_path = path, false) AS exact,
  list_filter([nullif(regexp_extract(regexp_replace(lower(label), '[^a-z0-9]', '', 'g'), '(item[0-9]+[a-z]?)', 1), ''), nullif(regexp_extract(regexp_replace(lower(coalesce(section_path, '')), '[^a-z0-9]', '', 'g'), '(item[0-9]+[a-z]?)', 1), '')], lambda x: x IS NOT NULL) AS items FROM w JOIN n USING (accession)),
s AS (SELECT path, node_id, CASE WHEN exact THEN 200 WHEN k = lk THEN 120 WHEN coalesce(list_contains(items, item), false) THEN 115 WHEN contains(label, tail) THEN 112 ELSE 105 END AS score FROM c
  WHERE exact OR contains(label, tail) OR starts_with(k, lk) OR starts_with(lk, k) OR coalesce(list_contains(items, item), false) OR coalesce(len(list_filter(items, lambda x: starts_with(x, item) OR starts_with(item, x))) > 0, false))
SELECT path, node_id, score FROM s QUALIFY rank() OVER (PARTITION BY path ORDER BY score DESC) = 1""", ("recent",))
def resolved(f: Frames) -> DataFrame:
    labels = ((0, "Item 7. Management Discussion"), (1, "Discussion"), (2, "Item 1A. Risk"), (3, "Item 7A"), (4, "Financial Facts"))
    nodes = f["recent"].select("accession", F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(t).alias("label")) for o, t in labels])).alias("v"))
    nodes = nodes.select("accession", F.concat_ws("-s", "accession", "v.o").alias("node_id"), "v.label", F.when(F.col("v.o") == 1, F.concat("accession", F.lit("/Item 7"))).alias("section_path"))
    tails = F.explode(F.array(*map(F.lit, ("Item 7", "Item 1A", "risk", "Financial", "item-7a", "Exhibits")))).alias("t")
    return E.resolve_section_nodes(f["recent"].select("accession", tails).select(F.concat_ws("/", "accession", "t").alias("path")), nodes)


_GIVEN = "CASE item_id % 3 WHEN 0 THEN 1998 WHEN 1 THEN 1997 END AS target_year, CASE WHEN item_id % 2 = 0 THEN '10-K' END AS form"


def _given(f: Frames) -> DataFrame:
    n = F.col("item_id")
    return f["questions"].withColumns({"target_year": F.when(n % 3 == 0, 1998).when(n % 3 == 1, 1997), "form": F.when(n % 2 == 0, "10-K")})


def _bound_facts(f: Frames) -> DataFrame:
    """Facts of the newest filing of each form, as excerpts that may name a segment."""
    named = F.concat("excerpt", F.when(F.col("value_num") % 4 == 0, " (Energy Products)").otherwise(""))
    # Facts are made of the filings that count, not of all filings before a join.
    newest = f["recent"].where("n = 1").join(_given(f).select("issuer_id").distinct().hint("merge"), "issuer_id", "left_semi")
    newest = written(newest, "newest-filings")
    facts = f.over("excerpts", facts=f.over("facts", filings=newest)).join(newest.select("accession", "issuer_id").hint("merge"), "accession").select("issuer_id", F.col("fact_id").alias("chunk_id"), named.alias("excerpt"))
    return _given(f).join(facts.hint("merge"), "issuer_id")


_EVIDENCE = f"""
g AS (SELECT query_id, issuer_id, question, lower(question) AS q, {_GIVEN} FROM questions),
v AS (SELECT g.*, x.fact_id AS chunk_id, x.excerpt || CASE WHEN x.value_num % 4 = 0 THEN ' (Energy Products)' ELSE '' END AS excerpt, x.value_num % 4 = 0 AS energy FROM g JOIN recent r ON r.issuer_id = g.issuer_id AND r.n = 1 JOIN excerpts x ON x.accession = r.accession),
w AS (SELECT *, regexp_extract(excerpt, '(?i)XBRL ([A-Za-z0-9_]+)[^:\\n]*:\\s*(\\$?[0-9,.]+ (?:billion|million|trillion)?(?:\\s*USD)?)(?:\\s*for period ([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\\s*-\\s*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}))?', ['c', 'v', 's', 'e']) AS z FROM v),
y AS (SELECT *, z.c AS concept, trim(z.v) AS shown, ends_with(z.s, '-01-01') AND ends_with(z.e, '-12-31') AS annual, try_cast(nullif(z.s, '') AS DATE) AS s, try_cast(nullif(z.e, '') AS DATE) AS e FROM w)"""


@PLANS.add("f7_fact_catalog", f"""
WITH {_EVIDENCE}, f AS (SELECT *, {Q.family("q")} AS family, CASE WHEN contains(q, 'energy products') THEN 'Energy Products' ELSE nullif(trim(regexp_extract(question, '(?i)([A-Za-z0-9_\\s&]+)\\s+segment', 1)), '') END AS asked, {Q.matches("concept", "q")} AS hit FROM y),
t AS (SELECT *, CASE WHEN family IS NULL THEN hit OR energy ELSE {Q.passes("concept", "family")} OR (family = 'segment_revenue' AND energy AND {Q.like("concept", "Revenue|Sales")}) END AND {Q.fits("s", "e", "annual", "target_year", "form")} AS ok,
  NOT coalesce(form = '10-K' AND target_year IS NOT NULL AND NOT annual AND z.e <> '' AND z.e[:4] <> target_year::VARCHAR, false) AND CASE WHEN family = 'segment_revenue' THEN energy AND (asked IS NULL OR contains('energy products', lower(asked))) ELSE true END AS complete FROM f),
o AS (SELECT *, bool_or(complete) OVER (PARTITION BY query_id) AS whole FROM t WHERE coalesce(ok, false))
SELECT query_id, chunk_id, concept, shown AS value_display, z.s AS period_start, z.e AS period_end, annual AS is_annual, CASE WHEN energy THEN 'Energy Products' END AS segment, hit AS matches_query FROM o WHERE complete OR (NOT whole AND family IS NOT NULL)""", ("questions", "recent", "excerpts"))
def catalog(f: Frames) -> DataFrame:
    return E.fact_catalog(_bound_facts(f)).drop("concept_family")


@PLANS.add("f14_best_fact", f"""
WITH {_EVIDENCE}, s AS (SELECT query_id, chunk_id, (CASE WHEN z.e <> '' AND z.e[:4]::INT = target_year THEN 10 ELSE 0 END + CASE WHEN annual THEN 8 ELSE 0 END - CASE WHEN NOT annual AND target_year IS NOT NULL THEN 6 ELSE 0 END
    + CASE WHEN CASE WHEN {Q.has("q", "shareholder equity", "stockholders equity", "total equity")} THEN contains(concept, 'StockholdersEquity') WHEN contains(q, 'energy product') AND {Q.has("q", "revenue", "sales", "operating")} THEN contains(concept, 'Revenue') ELSE {Q.matches("concept", "q")} END THEN 15 ELSE 0 END
    + CASE WHEN contains(q, 'energy product') AND energy THEN 20 ELSE 0 END)::DOUBLE AS score
  FROM y WHERE {Q.has("q", "revenue", "sales", "equity", "proceeds", "billion", "million")} AND NOT {Q.flags("q")["is_divestiture"]} AND concept <> '' AND regexp_matches(shown, '^\\$[0-9,.]+ (billion|million|trillion)') AND (target_year IS NULL OR z.e = '' OR z.e[:4]::INT = target_year))
SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) = 1""", ("questions", "recent", "excerpts"))
def best(f: Frames) -> DataFrame:
    return E.best_fact(_bound_facts(f))


@PLANS.add("f10_rank_by_role", f"""
WITH {_EVIDENCE}, c AS (SELECT *, CASE WHEN query_id % 3 = 0 THEN 'net_income' WHEN query_id % 3 = 1 THEN 'revenue' ELSE 'total_assets' END AS role, CASE concept WHEN 'NetIncomeLoss' THEN ['net_income', 'margin_numerator'] WHEN 'IncomeLossBeforeIncomeTaxes' THEN ['net_income', 'pretax_income'] WHEN 'Revenues' THEN ['revenue', 'total_revenue'] WHEN 'Assets' THEN ['total_assets'] ELSE [] END AS roles FROM y WHERE concept <> ''),
r AS (SELECT query_id, role, chunk_id, (CASE WHEN list_contains(roles, role) THEN 10 ELSE 0 END - CASE WHEN role = 'net_income' AND list_contains(roles, 'pretax_income') THEN 6 ELSE 0 END + CASE WHEN role = 'revenue' AND list_contains(roles, 'total_revenue') THEN 2 ELSE 0 END + CASE WHEN annual THEN 3 ELSE 0 END + CASE WHEN {Q.matches("concept", "q")} THEN 2 ELSE 0 END)::INT AS score, annual, length(z.e) AS n FROM c)
SELECT query_id, role, chunk_id, score, row_number() OVER (PARTITION BY query_id, role ORDER BY score DESC, annual DESC, n DESC, chunk_id)::INT AS position FROM r QUALIFY position <= 3""", ("questions", "recent", "excerpts"))
def by_role(f: Frames) -> DataFrame:
    rows = _bound_facts(f).withColumn("f", S.parse_fact_excerpt(F.col("excerpt"))).where("f.concept <> ''")
    c, k = F.col("f.concept"), F.col("query_id") % 3
    names = lambda *x: F.array(*map(F.lit, x))
    roles = F.when(c == "NetIncomeLoss", names("net_income", "margin_numerator")).when(c == "IncomeLossBeforeIncomeTaxes", names("net_income", "pretax_income")).when(c == "Revenues", names("revenue", "total_revenue")).when(c == "Assets", names("total_assets")).otherwise(F.array().cast("array<string>"))
    rows = rows.select("query_id", F.when(k == 0, "net_income").when(k == 1, "revenue").otherwise("total_assets").alias("role"), "chunk_id", roles.alias("roles"), "f.is_annual", S.concept_matches_query(c, F.col("question")).alias("matches_query"), "f.period_end")
    return E.rank_by_role(rows, 3).select("query_id", "role", "chunk_id", "score", "position")


_RANKS = "CASE WHEN family = 'equity' THEN CASE WHEN concept = 'StockholdersEquity' THEN 2 ELSE 99 END WHEN family = 'cash' THEN CASE WHEN concept = 'CashAndCashEquivalents' THEN 0 ELSE 5 END WHEN family = 'assets' THEN CASE WHEN concept = 'Assets' THEN 0 ELSE 8 END ELSE 10 END"
_CALENDAR = "(strftime(period_start, '%m-%d') = '01-01' AND strftime(period_end, '%m-%d') = '12-31')"


@PLANS.add("f13_point_fact", f"""
WITH g AS (SELECT query_id, issuer_id, lower(question) AS q, {_GIVEN} FROM questions), h AS (SELECT *, coalesce({Q.family("q")}, CASE WHEN contains(q, 'cash') THEN 'cash' WHEN contains(q, 'asset') THEN 'assets' END) AS family FROM g WHERE {Q.metric("q")} = 'point'),
c AS (SELECT query_id, fact_id, value_num, period_end, CASE WHEN {_CALENDAR} AND (coalesce(family, '') <> 'equity' OR {_RANKS} < 5) THEN 'high' ELSE 'medium' END AS confidence,
  (100 - {_RANKS} + CASE WHEN {_CALENDAR} THEN 20 ELSE 0 END + CASE WHEN {Q.matches("concept", "q")} THEN 10 ELSE 0 END + CASE WHEN year(period_end) = target_year THEN 15 ELSE 0 END)::INT AS score
  FROM h JOIN facts USING (issuer_id) WHERE {Q.passes("concept", "family")} AND {Q.fits("period_start", "period_end", _CALENDAR, "target_year", "form")})
SELECT query_id, fact_id, score, value_num, confidence FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, period_end DESC, fact_id) = 1""", ("facts", "questions"))
def point(f: Frames) -> DataFrame:
    q = F.lower("question")
    metric = S.metric_type(q)
    family = F.coalesce(S.query_concept_family(q, metric), F.when(q.contains("cash"), "cash").when(q.contains("asset"), "assets"))
    asked = _given(f).where(metric == "point").select("query_id", "issuer_id", "question", family.alias("family"), "target_year", "form")
    return O.point_facts(asked, f["facts"])


def _side(side: int) -> str:
    def one(pattern: str, without: str | None) -> str:
        return Q.like("concept", pattern) + (f" AND NOT {Q.like('concept', without)}" if without else "")

    return "CASE kind " + " ".join(f"WHEN '{kind}' THEN {one(*sides[side])}" for kind, sides in O.RATIO_SIDES.items()) + " ELSE false END"


@PLANS.add("f16_ratio_pair", f"""
WITH g AS (SELECT query_id, issuer_id, lower(question) AS q, {_GIVEN} FROM questions), g2 AS (SELECT *, {Q.metric("q")} AS metric, {Q.family("q")} AS family FROM g),
h AS (SELECT *, CASE WHEN metric <> 'ratio' THEN NULL WHEN family = 'tax_rate' OR contains(q, 'tax rate') OR contains(q, 'effective tax') THEN 'tax_rate' WHEN family = 'dividend_payout' OR (contains(q, 'dividend') AND contains(q, 'payout')) THEN 'dividend_payout'
    WHEN family = 'margin' OR contains(q, 'margin') OR contains(q, 'ratio') OR contains(q, 'percentage of') OR contains(q, ' as a percent') THEN 'margin' END AS kind FROM g2),
x AS (SELECT issuer_id, fact_id, value_num, period_start, CASE WHEN concept = 'NetIncomeLoss' AND issuer_id % 10 = 4 THEN NULL ELSE period_end END AS period_end,
    CASE WHEN concept = 'IncomeLossBeforeIncomeTaxes' AND issuer_id % 5 <> 0 THEN 'IncomeBeforeIncomeTaxes' WHEN concept = 'InventoryNet' AND issuer_id % 3 = 1 THEN 'DividendsPaid' ELSE concept END AS concept FROM facts),
c AS (SELECT *, {_side(0)} AS is_num, {_side(1)} AS is_den, CASE WHEN {_CALENDAR} THEN 5 ELSE 0 END + CASE WHEN {Q.matches("concept", "q")} THEN 2 ELSE 0 END + CASE WHEN strftime(period_end, '%m-%d') = '12-31' THEN 1 ELSE 0 END AS score FROM h JOIN x USING (issuer_id)
    WHERE kind IS NOT NULL AND (period_end IS NULL OR {Q.fits("period_start", "period_end", _CALENDAR, "target_year", "form")})),
k AS (SELECT * FROM c WHERE CASE WHEN family = 'dividend_payout' THEN is_num OR is_den ELSE {Q.passes("concept", "family")} END),
p AS (SELECT a.query_id, a.fact_id AS num_fact, b.fact_id AS den_fact, a.score + b.score AS score, a.value_num / nullif(abs(b.value_num), 0)::DOUBLE * 100 AS ratio, coalesce(a.period_end, b.period_end) AS at
    FROM k a JOIN k b ON a.query_id = b.query_id AND a.is_num AND b.is_den AND a.fact_id <> b.fact_id AND (a.period_end = b.period_end OR a.period_end IS NULL OR b.period_end IS NULL)
    QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY a.score + b.score DESC, coalesce(a.period_end, b.period_end) DESC NULLS LAST, a.fact_id, b.fact_id) = 1),
e AS (SELECT query_id, bool_or(is_num) AS n, bool_or(is_den) AS d FROM k GROUP BY 1)
SELECT query_id, kind, num_fact, den_fact, score, ratio, CASE WHEN kind IS NULL THEN 'unsupported' WHEN n IS NULL THEN 'no_candidates' WHEN NOT n OR NOT d THEN 'missing_side' WHEN num_fact IS NULL THEN 'no_pair' END AS reason
FROM h LEFT JOIN e USING (query_id) LEFT JOIN p USING (query_id)""", ("facts", "questions"))
def ratio(f: Frames) -> DataFrame:
    # Facts under names that the guards know, dividends, and some without a period.
    c, k = F.col("concept"), F.col("issuer_id")
    named = F.when((c == "IncomeLossBeforeIncomeTaxes") & (k % 5 != 0), "IncomeBeforeIncomeTaxes").when((c == "InventoryNet") & (k % 3 == 1), "DividendsPaid").otherwise(c)
    end = F.when(~((c == "NetIncomeLoss") & (k % 10 == 4)), F.col("period_end"))
    facts = f["facts"].withColumns({"concept": named, "period_end": end})
    q = F.lower("question")
    metric = S.metric_type(q)
    asked = _given(f).select("query_id", "issuer_id", "question", metric.alias("metric_type"), S.query_concept_family(q, metric).alias("family"), "target_year", "form")
    return O.ratio_pairs(asked, facts)


def _pairs(f: Frames) -> DataFrame:
    """Questions with the turns of a conversation as chunks, some of which say what is asked for."""
    t = F.col("turn") % 6
    said = F.concat("text", F.when(t == 0, " Item 1A. Risk factors: tariff and trade barrier, a material adverse effect").when(t == 1, " Revenues were $3.2 billion in the segment").when(t == 2, " management discussion of liquidity; currency").when(t == 3, " NetSales, proceeds in Singapore").otherwise(""))
    html = F.col("turn") % 2 == 0
    chunks = f["conversations"].select(
        (F.col("conv_id") % 40).alias("item_id"), F.concat_ws("-", "conv_id", "turn", "role", F.sha2("text", 256)).alias("chunk_id"), said.alias("excerpt"), F.when(t == 3, "table-1").otherwise(F.col("role")).alias("label"),
        F.when(html, "html").otherwise("xbrl").alias("source"), (~html & (t != 5)).alias("is_fact"), F.when(t == 0, "html-risk_factors").when(t == 2, "html-md_and_a").otherwise("facts").alias("section_id"), F.when(F.col("conv_id") % 3 == 0, "xbrl_primary").when(F.col("conv_id") % 3 == 1, "html_primary").otherwise("blended").alias("bias"),
    )
    return f["questions"].select("query_id", "item_id", "question", (S.query_intent(F.col("question"))["intent"] == "qualitative").alias("qualitative")).join(chunks, "item_id")


@PLANS.add("r2_score_chunks")
def scored(f: Frames) -> DataFrame:
    return E.score_chunks(_pairs(f)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@PLANS.add("r11_compact_evidence")
def compacted(f: Frames) -> DataFrame:
    rows = _pairs(f).withColumns({"intent": S.query_intent(F.col("question"))["intent"], "accession": F.substring_index("chunk_id", "-", 1), "ordinal": F.xxhash64("chunk_id")})
    return E.compact_evidence(rows, 5, 400).select("query_id", "position", "chunk_id", F.length("excerpt").alias("n"))


@PLANS.add("m18_variant_comparison", """
WITH v AS (SELECT variant_id, round(avg(outcome), 9) AS outcome, round(avg(mrr), 9) AS mrr, round(avg(ndcg), 9) AS ndcg FROM results GROUP BY 1), l AS (SELECT variant_id, unnest(['outcome', 'mrr', 'ndcg']) AS metric, unnest([outcome, mrr, ndcg]) AS value FROM v)
SELECT a.variant_id, a.metric, a.value, b.value AS baseline, round(a.value - b.value, 9) AS change FROM l a JOIN l b ON b.metric = a.metric AND b.variant_id = 'graph-full' AND a.variant_id <> 'graph-full'""", ("results",))
def comparison(f: Frames) -> DataFrame:
    means = f["results"].groupBy("variant_id").agg(*[F.round(F.avg(c), 9).alias(c) for c in ("outcome", "mrr", "ndcg")])
    return E.variant_comparison(means, "graph-full", ["outcome", "mrr", "ndcg"]).withColumn("change", F.round("change", 9))
