"""Queries over the scalar functions, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evidence as E
from ..sources.views import Frames
from . import rules_sql as Q
from .plan import Plans

PLANS = Plans()


@PLANS.add("b1_accession_of", r"""
SELECT node_id, CASE WHEN regexp_extract(node_id, '[0-9]{10}-[0-9]{2}-[0-9]{6}') <> '' THEN regexp_extract(node_id, '[0-9]{10}-[0-9]{2}-[0-9]{6}')
  WHEN starts_with(node_id, 'doc-') THEN substr(node_id, 5) ELSE '' END AS accession,
  'doc-' || regexp_extract(node_id, '[0-9]{10}-[0-9]{2}-[0-9]{6}') AS root
FROM doc_lines""", ("doc_lines",))
def accession(f: Frames) -> DataFrame:
    found = S.accession_of(F.col("node_id"))
    return f["doc_lines"].select("node_id", found.alias("accession"), S.document_root(found).alias("root"))


@PLANS.add("b2_parse_period", r"""
SELECT fact_id,
  CASE WHEN excerpt LIKE '%for period %' THEN try_cast(regexp_extract(excerpt, 'for period ([0-9-]{10})', 1) AS DATE) END AS period_start,
  CASE WHEN excerpt LIKE '% - %' THEN try_cast(right(excerpt, 10) AS DATE)
       WHEN excerpt LIKE '%for period %' THEN try_cast(regexp_extract(excerpt, 'for period ([0-9-]{10})', 1) AS DATE) END AS period_end
FROM excerpts""", ("excerpts",))
def period(f: Frames) -> DataFrame:
    return f["excerpts"].select("fact_id", S.parse_period(F.col("excerpt")).alias("p")).select("fact_id", "p.*")


@PLANS.add("b3_format_fact_value", r"""
WITH v AS (SELECT fact_id, value_num, value_num / 1000000.0::DOUBLE AS m FROM facts)
SELECT fact_id, CASE WHEN m >= 1000 THEN printf('$%.2f billion', m / 1000) WHEN m >= 1 THEN printf('$%.2f million', m) ELSE format('${:,.0f}', m) END AS shown FROM v""", ("facts",))
def fact_value(f: Frames) -> DataFrame:
    return f["facts"].select("fact_id", S.format_fact_value(F.col("value_num").cast("string"), F.lit("-6")).alias("shown"))


@PLANS.add("b4_fact_excerpt", r"""
SELECT fact_id, 'XBRL ' || concept || ': ' || value_num::VARCHAR || CASE WHEN form_type = '10-K' THEN ' USD' ELSE '' END || ' for period ' || period_start::VARCHAR || ' to ' || period_end::VARCHAR AS excerpt FROM facts""", ("facts",))
def excerpt(f: Frames) -> DataFrame:
    p = F.concat_ws(" to ", F.col("period_start").cast("string"), F.col("period_end").cast("string"))
    return f["facts"].select("fact_id", S.fact_excerpt(F.col("concept"), F.col("value_num").cast("string"), F.when(F.col("form_type") == "10-K", "USD").otherwise(""), p).alias("excerpt"))


@PLANS.add("b5_parse_fact_excerpt", r"""
WITH e AS (SELECT fact_id, excerpt, regexp_extract(excerpt, '(?i)XBRL ([A-Za-z0-9_]+)[^:\n]*:\s*(\$?[0-9,.]+ (?:billion|million|trillion)?(?:\s*USD)?)(?:\s*for period ([0-9]{4}-[0-9]{2}-[0-9]{2})\s*-\s*([0-9]{4}-[0-9]{2}-[0-9]{2}))?', ['c', 'v', 's', 'e']) AS g FROM excerpts)
SELECT fact_id, g.c AS concept, trim(g.v) AS value_display, g.s AS period_start, g.e AS period_end, ends_with(g.s, '-01-01') AND ends_with(g.e, '-12-31') AS is_annual FROM e""", ("excerpts",))
def parse_excerpt(f: Frames) -> DataFrame:
    return f["excerpts"].select("fact_id", S.parse_fact_excerpt(F.col("excerpt")).alias("p")).select("fact_id", "p.*")


@PLANS.add("b6_parse_display_value", r"""
SELECT fact_id, value_num::DOUBLE * CASE WHEN value_num % 3 = 0 THEN 1e6 WHEN value_num % 3 = 1 THEN 1e9 ELSE 1.0 END AS value,
  CASE WHEN value_num % 3 = 0 THEN 'millions' WHEN value_num % 3 = 1 THEN 'billions' ELSE 'units' END AS scale FROM excerpts""", ("excerpts",))
def display_value(f: Frames) -> DataFrame:
    shown = S.parse_fact_excerpt(F.col("excerpt"))["value_display"]
    return f["excerpts"].select("fact_id", S.parse_display_value(shown).alias("value"), S.detect_scale(shown).alias("scale"))


@PLANS.add("b7_format_number_display", r"""
SELECT fact_id, CASE WHEN value_num % 7 = 0 THEN printf('%.2f%%', value_num::DOUBLE) WHEN value_num >= 1e9 THEN printf('$%.2f billion', value_num / 1e9) WHEN value_num >= 1e6 THEN printf('$%.2f million', value_num / 1e6)
  WHEN value_num >= 1e3 THEN format('{:,.0f}', value_num::DOUBLE) ELSE printf('%.2f', value_num::DOUBLE) END AS shown FROM facts""", ("facts",))
def number_display(f: Frames) -> DataFrame:
    return f["facts"].select("fact_id", S.format_number_display(F.col("value_num").cast("double"), F.col("value_num") % 7 == 0).alias("shown"))


_ANSWERS = """
CASE WHEN value_num % 6 = 0 THEN '$' || value_num || ' million' WHEN value_num % 6 = 1 THEN '$ ' || value_num || '.5 billion' WHEN value_num % 6 = 2 THEN value_num || '%'
 WHEN value_num % 6 = 3 THEN 'about ' || value_num WHEN value_num % 6 = 4 THEN '-' || value_num ELSE format('{:,}', value_num) END"""


def _answers() -> F.Column:
    v = F.col("value_num")
    s, m = v.cast("string"), v % 6
    return (
        F.when(m == 0, F.concat(F.lit("$"), s, F.lit(" million"))).when(m == 1, F.concat(F.lit("$ "), s, F.lit(".5 billion"))).when(m == 2, F.concat(s, F.lit("%")))
        .when(m == 3, F.concat(F.lit("about "), s)).when(m == 4, F.concat(F.lit("-"), s)).otherwise(F.format_string("%,d", v))
    )


@PLANS.add("b9_numeric_answers", f"""
SELECT fact_id, {_ANSWERS} AS answer,
  CASE value_num % 6 WHEN 0 THEN value_num * 1e6 WHEN 1 THEN (value_num || '.5')::DOUBLE * 1e9 WHEN 2 THEN value_num::DOUBLE WHEN 3 THEN NULL WHEN 4 THEN -value_num::DOUBLE ELSE value_num::DOUBLE END AS value,
  CASE WHEN value_num % 6 = 3 THEN NULL ELSE round_even(CASE value_num % 6 WHEN 0 THEN value_num::DOUBLE WHEN 1 THEN (value_num || '.5')::DOUBLE * 1000.0 WHEN 4 THEN -value_num / 1e6 ELSE value_num / 1e6 END, 0)::BIGINT::VARCHAR END AS raw
FROM facts""", ("facts",))
def numeric_answers(f: Frames) -> DataFrame:
    a = _answers()
    return f["facts"].select("fact_id", a.alias("answer"), S.parse_numeric_gt(a).alias("value"), S.infer_raw_value(a).alias("raw"))


@PLANS.add("b10_numeric_equivalent", r"""
SELECT a.fact_id, abs(a.value_num - b.value_num) / greatest(a.value_num, b.value_num, 1)::DOUBLE <= 0.02 AS same
FROM facts a JOIN facts b ON a.accession = b.accession AND a.concept = 'IncomeLossBeforeIncomeTaxes' AND b.concept = 'InventoryNet'""", ("facts",))
def equivalent(f: Frames) -> DataFrame:
    a = f["facts"].where("concept = 'IncomeLossBeforeIncomeTaxes'").select("accession", "fact_id", F.col("value_num").alias("a"))
    b = f["facts"].where("concept = 'InventoryNet'").select("accession", F.col("value_num").alias("b"))
    return a.join(b, "accession").select("fact_id", S.numeric_equivalent(F.col("a").cast("string"), F.col("b").cast("string")).alias("same"))


@PLANS.add("b11_excerpt_matches_value", r"""
WITH n AS (SELECT fact_id, value_num * 1e6 AS target, excerpt, unnest(regexp_extract_all(replace(excerpt, ',', ''), '-?[0-9]+(?:\.[0-9]+)?'))::DOUBLE AS x FROM excerpts)
SELECT fact_id, bool_or(abs(x - target) / greatest(abs(x), abs(target), 1.0) <= 0.02 OR (excerpt ILIKE '%billion%' AND x * 1e9 = target) OR (excerpt ILIKE '%million%' AND x * 1e6 = target)) AS matches
FROM n GROUP BY fact_id""", ("excerpts",))
def matches(f: Frames) -> DataFrame:
    return f["excerpts"].select("fact_id", S.excerpt_matches_value(F.col("excerpt"), F.col("value_num") * 1e6).alias("matches"))


@PLANS.add("b13_concept_family", r"""
SELECT fact_id, CASE concept WHEN 'Revenues' THEN 'revenue' WHEN 'CostOfRevenue' THEN 'revenue' WHEN 'NetIncomeLoss' THEN 'income' WHEN 'IncomeTaxExpenseBenefit' THEN 'income'
  WHEN 'IncomeLossBeforeIncomeTaxes' THEN 'income' WHEN 'Assets' THEN 'assets' WHEN 'StockholdersEquity' THEN 'equity' WHEN 'CashAndCashEquivalents' THEN 'cash' WHEN 'InventoryNet' THEN 'inventory' ELSE 'liabilities' END AS family,
  CASE concept WHEN 'Revenues' THEN 'Revenues' WHEN 'CostOfRevenue' THEN 'Cost Of Revenue' WHEN 'NetIncomeLoss' THEN 'Net Income Loss' WHEN 'IncomeTaxExpenseBenefit' THEN 'Income Tax Expense Benefit'
  WHEN 'IncomeLossBeforeIncomeTaxes' THEN 'Income Loss Before Income Taxes' WHEN 'Assets' THEN 'Assets' WHEN 'StockholdersEquity' THEN 'Stockholders Equity' WHEN 'CashAndCashEquivalents' THEN 'Cash And Cash Equivalents'
  WHEN 'InventoryNet' THEN 'Inventory Net' ELSE 'Liabilities Current' END AS label FROM facts""", ("facts",))
def family(f: Frames) -> DataFrame:
    c = F.col("concept")
    return f["facts"].select("fact_id", S.concept_family(c).alias("family"), S.split_camel_label(c).alias("label"))


@PLANS.add("b16_concept_guard", f"""
WITH x(fam) AS (VALUES ('equity'), ('tax_rate'), ('dividend_payout'), ('margin'), ('assets'), ('segment_revenue'), ('none')), c AS (SELECT concept, contains(excerpt, 'billion') AS segment, count(*) AS n FROM excerpts GROUP BY 1, 2)
SELECT fam AS family, concept, segment, n FROM c CROSS JOIN x WHERE {Q.passes("concept", "fam")} OR (fam = 'segment_revenue' AND segment AND concept IN ('Revenues', 'CostOfRevenue'))""", ("excerpts",))
def guard(f: Frames) -> DataFrame:
    # Excerpts in billions stand for those that name a segment.
    families = F.explode(F.array(*map(F.lit, ("equity", "tax_rate", "dividend_payout", "margin", "assets", "segment_revenue", "none"))))
    counted = f["excerpts"].groupBy("concept", F.col("excerpt").contains("billion").alias("segment")).agg(F.count("*").alias("n")).select(families.alias("family"), "concept", "segment", "n")
    return counted.where(S.concept_passes_guard(F.col("concept"), F.col("family"), F.col("segment")))


@PLANS.add("b18_question_features", f"""
WITH q AS (SELECT query_id, lower(question) AS q FROM questions)
SELECT query_id, {Q.metric("q")} AS metric_type, {Q.family("q")} AS family, {Q.intent("q")} AS intent, {Q.anchor("q")} AS anchor, {Q.form("q")} AS form, {Q.annual("q")} AS annual FROM q""", ("questions",))
def question_features(f: Frames) -> DataFrame:
    q = F.col("question")
    m = S.metric_type(q)
    return f["questions"].select("query_id", m.alias("metric_type"), S.query_concept_family(q, m).alias("family"), S.query_intent(q)["intent"].alias("intent"), S.query_anchor(q).alias("anchor"), S.form_preference(q).alias("form"), S.annual_requested(q).alias("annual"))


@PLANS.add("b25_section_paths", r"""
SELECT node_id, regexp_replace(lower(node_id || '/Item ' || (doc_id % 9) || 'A. x'), '[^a-z0-9]', '', 'g') AS key, node_id AS accession, 'Item ' || (doc_id % 9) || 'A. x' AS tail, 'item' || (doc_id % 9) || 'a' AS item
FROM doc_lines""", ("doc_lines",))
def section_paths(f: Frames) -> DataFrame:
    tail = F.concat(F.lit("Item "), (F.col("doc_id") % 9).cast("string"), F.lit("A. x"))
    path = F.concat(F.col("node_id"), F.lit("/"), tail)
    parts = S.split_section_path(path)
    return f["doc_lines"].select("node_id", S.section_key(path).alias("key"), parts["accession"].alias("accession"), parts["tail"].alias("tail"), S.item_key(S.section_key(tail)).alias("item"))


@PLANS.add("b27_evidence_stratum", r"""
SELECT doc_id % 97 AS item_id, CASE WHEN count(DISTINCT doc_id % 3 = 0) > 1 THEN 'mixed' WHEN bool_and(doc_id % 3 = 0) THEN 'xbrl' ELSE 'html' END AS stratum FROM doc_lines GROUP BY 1""", ("doc_lines",))
def stratum(f: Frames) -> DataFrame:
    chunk = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("xbrl-"), F.col("doc_id"))).otherwise(F.concat(F.lit("html-"), F.col("doc_id")))
    kinds = f["doc_lines"].groupBy((F.col("doc_id") % 97).alias("item_id")).agg(F.collect_set(F.concat(S.chunk_kind(chunk), F.lit("-"))).alias("kinds"))
    return kinds.select("item_id", S.evidence_stratum(F.col("kinds")).alias("stratum"))


@PLANS.add("b28_abstention", r"""
SELECT doc_id, trim(coalesce(text, '')) = '' OR doc_id % 5 = 0 OR starts_with(lower(trim(text)), 'insufficient evidence') OR (doc_id % 2 = 0 AND lower(text) LIKE '%insufficient evidence%') AS abstained FROM documents""")
def abstention(f: Frames) -> DataFrame:
    d = F.col("doc_id")
    return f["documents"].select("doc_id", S.is_abstention(F.col("text"), F.when(d % 5 == 0, "insufficient").otherwise("sufficient"), d % 2).alias("abstained"))


@PLANS.add("b31_priority_tier", r"""
SELECT variant_id, item_id, CASE WHEN outcome IS NULL OR outcome > 0 THEN 3 WHEN coalesce(mrr, 0) >= 0.5 OR coalesce(ndcg, 0) >= 0.3 THEN 1 ELSE 2 END AS tier,
  CASE WHEN outcome IS NULL OR outcome > 0 THEN 0.0 WHEN coalesce(mrr, 0) >= 0.5 OR coalesce(ndcg, 0) >= 0.3 THEN greatest(coalesce(mrr, 0), coalesce(ndcg, 0)) ELSE 0.1 END::DOUBLE AS priority FROM results""", ("results",))
def tiers(f: Frames) -> DataFrame:
    t = S.priority_tier(F.col("outcome"), F.col("mrr"), F.col("ndcg"))
    return f["results"].select("variant_id", "item_id", t["tier"].alias("tier"), t["priority"].alias("priority"))


@PLANS.add("b32_hash_embed", r"""
WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark),
p AS (SELECT item_id, ('0x' || right(sha256(t), 2))::INT % 64 AS i, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2)
SELECT b.item_id, i AS place, round(n / sqrt(sum(n * n) OVER (PARTITION BY b.item_id)), 9) AS weight FROM benchmark b JOIN p ON p.item_id = b.item_id""")
def embed(f: Frames) -> DataFrame:
    rows = f["benchmark"].select("item_id", F.posexplode(S.hash_embed(F.col("text"))).alias("place", "w"))
    return rows.where("w > 0").select("item_id", "place", F.round("w", 9).alias("weight"))


@PLANS.add("b33_cosine", r"""
SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine(f: Frames) -> DataFrame:
    a = f["embeddings"].select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = f["embeddings"].select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(S.cosine_unit(F.col("x"), F.col("y")), 6).alias("cosine"))


@PLANS.add("b34_ungrounded_numbers", r"""
WITH n AS (SELECT c.conv_id, c.turn, c.text, b.text AS cited, regexp_extract_all(replace(c.text, ',', ''), '[0-9]+(?:\.[0-9]+)?') AS found FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % 40)
SELECT conv_id, turn, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i AND NOT contains(replace(cited, ',', ''), x)), ',') AS numbers FROM n""")
def ungrounded(f: Frames) -> DataFrame:
    cited = f["benchmark"].select(F.col("item_id"), F.col("text").alias("cited"))
    rows = f["conversations"].join(cited, F.col("conv_id") % 40 == F.col("item_id"))
    return rows.select("conv_id", "turn", F.array_join(S.ungrounded_numbers(F.col("text"), F.col("cited")), ",").alias("numbers"))


@PLANS.add("b35_edgar_url", r"""
SELECT accession, 'https://www.sec.gov/Archives/edgar/data/' || issuer_id || '/' || replace(accession, '-', '') || '/' || accession || '-index.htm' AS url FROM filings""", ("filings",))
def url(f: Frames) -> DataFrame:
    return f["filings"].select("accession", S.edgar_url(F.col("cik"), F.col("accession")).alias("url"))


#: Parts that names are put together from, one of each list by a digit of the text's digest, with a word
#: of the text between them.
_TITLES = (("Item 7", "ITEM 1A", "Item 1.", "item 17", "Part I", "Note", "MD&A", "Item 9"), ("Management's", "Risk", "business", "Controls", "Factors"), ("discussion", "Factor", "Business", "Results", "of operations", "analysis"))
_TAILS = (("Item 7", "risk_factors", "the", "Results", "Item2a", "", "net sales"), ("and", "$5 billion", "12345", "2 million", "of the", "mmx"), ("", "would grow its sales in the region", "over time, as the company said that it would", "for the year"))
_FILES = (("a", "R1", "form", "x_htm"), ("", "-xbrl", "_XBRL", "_cal", "_LAB", "_pre", "_def", "_htm"), (".zip", ".xml", ".xsd", ".htm"))


def _made(parts: tuple[tuple[str, ...], ...], blank: str) -> Column:
    """A name of the parts and the first word of the text."""
    pick = lambda k, names: F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.conv(F.substring(F.md5("text"), 4 * k + 1, 4), 16, 10).cast("int"), F.lit(len(names))) + 1).cast("int"))
    word = F.regexp_extract("text", "([A-Za-z]+)", 1)
    return F.concat_ws(blank, pick(0, parts[0]), word, *[pick(k, p) for k, p in enumerate(parts[1:], 1)])


def _made_sql(parts: tuple[tuple[str, ...], ...], blank: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    picks = [f"[{', '.join(map(quote, p))}][('0x' || substr(md5(text), {4 * k + 1}, 4))::INT % {len(p)} + 1]" for k, p in enumerate(parts)]
    return f"concat_ws('{blank}', {picks[0]}, regexp_extract(text, '([A-Za-z]+)', 1), {', '.join(picks[1:])})"


@PLANS.add("b24_narrative_kind", rf"""
WITH t AS (SELECT doc_id, {_made_sql(_TITLES, ' ')} AS title FROM doc_lines), l AS (SELECT *, lower(title) AS t FROM t)
SELECT doc_id, title, CASE WHEN t LIKE '%risk factor%' OR t LIKE '%item 1a%' THEN 'risk_factors' WHEN (t LIKE '%management%' AND t LIKE '%discussion%') OR regexp_matches(t, '\bitem\s+7\b') OR t LIKE '%md&a%' THEN 'md_and_a' WHEN t LIKE '%item 1.%' AND t LIKE '%business%' THEN 'business_description' ELSE 'other' END AS kind FROM l""", ("doc_lines",))
def kind(f: Frames) -> DataFrame:
    title = _made(_TITLES, " ")
    return f["doc_lines"].select("doc_id", title.alias("title")).withColumn("kind", S.narrative_kind(F.col("title")))


@PLANS.add("b37_year_mismatch", r"""
SELECT query_id, accession, CASE query_id % 12 WHEN 2 THEN year(period_end) <> 2000 WHEN 6 THEN year(period_end) <> 1999 WHEN 10 THEN year(period_end) <> 2000 ELSE false END AS mismatch
FROM questions JOIN recent ON questions.issuer_id = recent.issuer_id AND form_type = '10-K'""", ("questions", "recent"))
def year_mismatch(f: Frames) -> DataFrame:
    rows = f["questions"].join(f["recent"].where("form_type = '10-K'"), "issuer_id")
    return rows.select("query_id", "accession", S.question_year_mismatch(F.col("question"), F.array(F.concat(F.lit("FY"), F.year("period_end").cast("string")))).alias("mismatch"))


@PLANS.add("b37_align_years", """
WITH r AS (SELECT query_id, accession, question || ', as in 2001 or FY2004-2005 (20201)' AS q, [year(period_end)::VARCHAR, (year(period_end) + 6)::VARCHAR] AS own FROM questions JOIN recent ON questions.issuer_id = recent.issuer_id AND form_type = '10-K'),
b AS (SELECT *, list_filter(own, lambda x: x LIKE '20%') AS known FROM r), p AS (SELECT *, list_max(known) AS latest, string_split_regex(q, '20[0-9]{2}') AS parts, regexp_extract_all(q, '20[0-9]{2}') AS years FROM b)
SELECT query_id, accession, CASE WHEN latest IS NULL THEN q ELSE array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(CASE WHEN list_contains(known, years[i]) THEN years[i] WHEN i <= len(years) THEN latest END, '')), '') END AS question FROM p""", ("questions", "recent"))
def align_years(f: Frames) -> DataFrame:
    rows = f["questions"].join(f["recent"].where("form_type = '10-K'"), "issuer_id")
    labels = F.array(F.concat(F.lit("FY"), F.year("period_end").cast("string")), F.concat((F.year("period_end") + 6).cast("string"), F.lit("-FY")))
    return rows.select("query_id", "accession", S.align_question_years(F.concat("question", F.lit(", as in 2001 or FY2004-2005 (20201)")), labels).alias("question"))


@PLANS.add("b14_concept_roles", """
SELECT fact_id, CASE concept WHEN 'NetIncomeLoss' THEN 'net_income,margin_numerator' WHEN 'IncomeLossBeforeIncomeTaxes' THEN 'pretax_income' WHEN 'Revenues' THEN 'revenue,total_revenue,margin_denominator' WHEN 'StockholdersEquity' THEN 'total_equity'
  WHEN 'Assets' THEN 'total_assets' WHEN 'LiabilitiesCurrent' THEN 'total_liabilities' END AS roles, CASE WHEN concept IN ('NetIncomeLoss', 'IncomeLossBeforeIncomeTaxes', 'Revenues') THEN 'income_statement' WHEN concept IN ('StockholdersEquity', 'Assets', 'LiabilitiesCurrent') THEN 'balance_sheet' END AS statement FROM facts""", ("facts",))
def roles(f: Frames) -> DataFrame:
    r = S.concept_roles(F.col("concept"))
    return f["facts"].select("fact_id", F.array_join(r["roles"], ",").alias("roles"), r["statement"].alias("statement"))


@PLANS.add("b17_concept_matches_query", f"""
SELECT query_id, concept FROM (SELECT query_id, lower(question) AS q FROM questions) CROSS JOIN (SELECT DISTINCT concept FROM facts) WHERE {Q.matches("concept", "q")}""", ("questions", "facts"))
def concept_match(f: Frames) -> DataFrame:
    return E.concept_pairs(f["questions"], f["facts"])


_FLAGS = "SELECT query_id, " + ", ".join(f"{sql} AS {name}" for name, sql in Q.flags("q").items()) + " FROM (SELECT query_id, lower(question) AS q FROM questions)"


@PLANS.add("b23_query_flags", _FLAGS, ("questions",))
def flags(f: Frames) -> DataFrame:
    g = S.query_flags(F.col("question"))
    return f["questions"].select("query_id", *[g[n].alias(n) for n in Q.flags("q")])


@PLANS.add("b26_corrupt_paths", rf"""
WITH t AS (SELECT doc_id, {_made_sql(_TAILS, ' ')} AS tail FROM doc_lines), l AS (SELECT *, trim(tail) AS t FROM t),
m AS (SELECT *, length(t) - length(replace(t, ' ', '')) AS blanks, length(t) - length(replace(replace(replace(t, ' ', ''), '_', ''), '-', '')) AS gaps FROM l)
SELECT doc_id, tail, CASE WHEN t = '' OR regexp_matches(t, '(?i)[\$€£]|\b(billion|million|thousand|bn|mm)\b|[0-9]{{5,}}') THEN true WHEN regexp_matches(lower(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')), 'item[0-9]') THEN false
  WHEN length(t) <= 48 AND blanks <= 4 AND gaps <= 3 THEN false WHEN length(t) > 60 OR blanks >= 6 THEN true ELSE regexp_matches(t, '^[a-z]') AND NOT contains(lower(left(t, 12)), 'item') END AS corrupt FROM m""", ("doc_lines",))
def corrupt(f: Frames) -> DataFrame:
    return f["doc_lines"].select("doc_id", _made(_TAILS, " ").alias("tail")).withColumn("corrupt", S.is_corrupt_tail(F.col("tail")))


@PLANS.add("b29_outcome_scores", """
SELECT variant_id, item_id, CASE WHEN abstained AND (has_answer OR profile_no = 0) THEN 0 WHEN NOT abstained AND has_answer THEN alignment ELSE coalesce(mrr, 0) END::DOUBLE AS outcome, CASE WHEN profile_no = 0 AND NOT abstained THEN coalesce(ndcg, 0) ELSE 0 END::DOUBLE AS alignment FROM results""", ("results",))
def outcomes(f: Frames) -> DataFrame:
    scores = F.create_map(F.lit("value_alignment"), F.col("alignment"), F.lit("synthesis_grounding"), F.col("mrr"), F.lit("claim_presence"), F.col("ndcg"))
    s = S.outcome_scores(scores, F.col("abstained"), F.col("has_answer"), F.col("profile_no") == 0)
    return f["results"].select("variant_id", "item_id", s["outcome"].alias("outcome"), s["alignment"].alias("alignment"))


@PLANS.add("b30_needs_scoring", """
SELECT variant_id, item_id, CASE WHEN variant_id = 'flat-chunk' THEN 3 ELSE 4 END + has_answer::INT + (profile_no = 0)::INT AS n_required, profile_no = 1 OR variant_id = 'flat-chunk' OR profile_no = 0 AS rescore FROM results""", ("results",))
def rescore(f: Frames) -> DataFrame:
    need = S.required_criteria(F.col("variant_id"), F.col("has_answer"), F.col("profile_no") == 0)
    have = F.create_map(*[x for k in ("trajectory_coherence", "routing_decisions", "retrieval_fidelity", "synthesis_grounding", "value_alignment") for x in (F.lit(k), F.lit(1.0))])
    version = F.when(F.col("profile_no") == 1, "v3.0").otherwise("v3.2")
    return f["results"].select("variant_id", "item_id", F.size(need).alias("n_required"), S.needs_scoring(version, have, need).alias("rescore"))


@PLANS.add("a11_artifact_role", f"""
WITH t AS (SELECT doc_id, {_made_sql(_FILES, '')} AS name FROM documents), l AS (SELECT *, lower(name) AS n FROM t)
SELECT doc_id, name, CASE WHEN regexp_matches(n, '[-_]xbrl\\.zip$') THEN 'xbrl_zip' WHEN ends_with(n, '.xml') AND contains(n, 'htm') THEN 'instance' WHEN ends_with(n, '.xsd') THEN 'schema' WHEN ends_with(n, '_cal.xml') THEN 'calculation' WHEN ends_with(n, '_def.xml') THEN 'definition'
  WHEN ends_with(n, '_lab.xml') THEN 'label' WHEN ends_with(n, '_pre.xml') THEN 'presentation' ELSE 'other' END AS role FROM l""")
def artifacts(f: Frames) -> DataFrame:
    return f["documents"].select("doc_id", _made(_FILES, "").alias("name")).withColumn("role", S.artifact_role(F.col("name")))


@PLANS.add("f8_period_matches_intent", """
SELECT fact_id, form_type, CASE WHEN form_type = '10-Q' THEN year(period_end) = 1998 WHEN strftime(period_start, '%m-%d') = '01-01' THEN year(period_end) = 1998
  ELSE CASE WHEN year(period_start) > 1998 AND year(period_end) > 1998 THEN false ELSE year(period_end) = 1998 END END AS fits FROM facts""", ("facts",))
def intent_period(f: Frames) -> DataFrame:
    annual = (F.date_format("period_start", "MM-dd") == "01-01") & (F.date_format("period_end", "MM-dd") == "12-31")
    return f["facts"].select("fact_id", "form_type", S.period_matches_intent(F.col("period_start"), F.col("period_end"), annual, F.lit(1998), F.col("form_type")).alias("fits"))


def _has(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@PLANS.add("r1_section_score", f"""
WITH x AS (SELECT query_id, lower(question) AS q, unnest([{{'t': 'risk factors', 's': 'html-risk_factors'}}, {{'t': 'management discussion', 's': 'html-md_and_a'}}, {{'t': 'xbrl financial facts', 's': 'xbrl-facts'}}, {{'t': 'item 1. business', 's': 'html-business_description'}}]) AS z FROM questions),
y AS (SELECT query_id, q, z.t AS t, z.s AS s FROM x), n AS (SELECT query_id, is_mda, is_risk_only FROM ({_FLAGS}))
SELECT query_id, s AS section_id, round(CASE WHEN len(list_filter(string_split_regex(q, '\\s+')[1:5], lambda w: contains(t, w))) > 0 THEN 1.0 ELSE 0.3 END
  + CASE WHEN {_has("t", "financial", "balance", "income", "cash", "liquidity", "margin")} THEN 0.4 ELSE 0 END
  + CASE WHEN {_has("q", "revenue", "sales", "driver", "segment", "growth")} AND {_has("t", "revenue", "management", "md&a", "results", "operations", "business", "xbrl", "financial facts")} THEN 0.5 ELSE 0 END
  + CASE WHEN contains(t, 'xbrl') AND {_has("q", "revenue", "sales", "income", "assets", "cash", "earnings")} THEN 2.0 ELSE 0 END + CASE WHEN starts_with(s, 'html') THEN 2.5 ELSE 0 END
  + CASE WHEN is_mda AND contains(s, 'md_and_a') THEN 15 ELSE 0 END + CASE WHEN is_mda AND {_has("t", "management", "discussion", "analysis")} THEN 8 ELSE 0 END
  + CASE WHEN is_risk_only AND contains(s, 'risk_factors') THEN 12 ELSE 0 END - CASE WHEN is_risk_only AND contains(s, 'business_description') THEN 6 ELSE 0 END
  + CASE WHEN contains(s, 'risk_factors') OR contains(s, 'md_and_a') THEN 1.5 ELSE 0 END, 3)::DOUBLE AS score FROM y JOIN n USING (query_id)""", ("questions",))
def section_scores(f: Frames) -> DataFrame:
    sections = (("Risk Factors", "html-risk_factors"), ("Management Discussion", "html-md_and_a"), ("XBRL Financial Facts", "xbrl-facts"), ("Item 1. Business", "html-business_description"))
    sections = F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("section_id")) for a, b in sections]))
    rows = f["questions"].select("query_id", "question", sections.alias("s"))
    return rows.select("query_id", "s.section_id", S.section_score(F.col("question"), F.col("s.label"), F.col("s.section_id")).alias("score"))
