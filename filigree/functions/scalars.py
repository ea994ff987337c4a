"""Column functions on disclosure values, ids, periods, concepts and questions.

Patterns are ASCII on purpose, so that every engine reads them alike. Unless said otherwise null in
gives null out; a text that doesn't have the shape gives null or an empty string as stated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that define the results.
CONCEPT_FAMILIES = (
    ("revenue", ("revenue", "sales")), ("equity", ("equity",)), ("assets", ("asset",)), ("cash", ("cash",)),
    ("income", ("income", "earnings", "eps")), ("liabilities", ("liabilit",)), ("inventory", ("inventory", "inventories")), ("tax", ("tax",)),
)
RISK_WORDS = r"\b(risk|factor|factors|item\s*1a)\b"
FINANCIAL_WORDS = r"\b(revenue|sales|income|earnings|profit|assets|liabilities|cash|eps|margin|debt|dividend|shares|cost|expense|growth|yoy|qoq|billion|million|\$)\b"
COMPARED_RISK_WORDS = ("compare", "comparison", "versus", " vs ", "across")
NUMERIC_WORDS = ("revenue", "sales", "income", "earnings", "assets", "eps", "year over year", "year-over-year", "yoy", "quarter over quarter", "qoq")
INTENT_WORDS = {
    "numeric": ("revenue", "sales", "eps", "earnings", "assets", "liabilities", "cash", "margin", "billion", "million"),
    "qualitative": ("risk", "md&a", "management", "strategy", "outlook", "liquidity discussion", "business description"),
    "hybrid": ("trend", "growth and", "explain", "compared to prior"),
}
GUARDS = {  # family: (excluded, included)
    "equity": ("EquityOther|OtherComprehensive|FairValue|Member", "StockholdersEquity"),
    "tax_rate": ("AccruedIncomeTax|OtherComprehensive|Reclassification|FairValue|Pension|ComprehensiveIncome|DefinedBenefit|Aoci|Statutory|Reconciliation",
                 "IncomeTaxExpense|ProvisionForIncomeTax|EffectiveIncomeTax|EarningsBeforeIncomeTax|IncomeBeforeIncomeTax|PretaxIncome|ProfitBeforeTax"),
    "dividend_payout": ("OtherComprehensive|Reclassification|FairValue|Pension|Aoci|Accrued", "Dividend|DistributionsToShareholders"),
    "margin": ("OtherComprehensive|FairValue|Accrued|Reclassification|SegmentOperating", "Income|Revenue|Profit|Earnings"),
    "assets": ("FairValue|OtherAssetsFairValue|AvailableForSale|Derivative", "^Assets$|AssetsCurrent|AssetsNoncurrent"),
}
SEGMENTS = ("Energy Products", "Upstream", "Chemical Products", "Specialty Products", "machinery, energy, and transportation")
QUARTER_CUES = ("prior quarter", "previous quarter", "latest quarter", "this quarter", "most recent quarter", "quarterly filing", "recent 10-q", "recent 10 q", "10-q", "10 q")
_ACCESSION = r"([0-9]{10}-[0-9]{2}-[0-9]{6})"
_CLAUSE = r"(?i)for period (.+)$"
_FACT = r"(?i)XBRL ([A-Za-z0-9_]+)[^:\n]*:\s*(\$?[0-9,.]+ (?:billion|million|trillion)?(?:\s*USD)?)(?:\s*for period ([0-9]{4}-[0-9]{2}-[0-9]{2})\s*-\s*([0-9]{4}-[0-9]{2}-[0-9]{2}))?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``: an outer expression named in a lambda is
    evaluated for each element, a lambda variable isn't."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _hits(text: Column, words) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def accession_of(node_id: Column) -> Column:
    """Accession inside a node id, else what follows a leading ``doc-``, else the empty string."""
    found = F.regexp_extract(node_id, _ACCESSION, 1)
    return F.when(found != "", found).when(node_id.startswith("doc-"), F.substr(node_id, F.lit(5))).otherwise("")


def document_root(accession: Column) -> Column:
    return F.when(accession != "", F.concat(F.lit("doc-"), accession)).otherwise("")


def _date_in(text: Column) -> Column:
    iso = F.nullif(F.regexp_extract(text, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")).try_cast("date")
    us = F.nullif(F.regexp_extract(text, "([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})", 1), F.lit(""))
    return F.coalesce(iso, F.try_to_date(us, "MMMM d, yyyy"), F.try_to_date(us, "MMM d, yyyy"))


def parse_period(excerpt: Column) -> Column:
    """struct(period_start, period_end) of "for period A to B", "A - B" or one instant."""
    clause = F.regexp_replace(F.trim(F.regexp_extract(excerpt, _CLAUSE, 1)), r"\.+$", "")

    def dates(c: Column) -> Column:
        parts = F.when(c.rlike(r"(?i)\s+to\s+"), F.split(c, r"(?i)\s+to\s+", 2)).when(c.contains(" - "), F.split(c, " - ", 2))
        both = lambda p: F.struct(_date_in(p[0]).alias("period_start"), _date_in(p[1]).alias("period_end"))
        one = let(_date_in(c), lambda d: F.struct(d.alias("period_start"), d.alias("period_end")))
        return F.coalesce(let(parts, lambda p: F.when(p.isNotNull(), both(p))), one)

    return let(clause, dates)


def two_places(x: Column) -> Column:
    """A double with two decimals, rounded as C and Python do: by its exact value, ties to the even digit.
    format_string rounds the shortest decimal that stands for the double instead, so that 1.045, which is less
    than that, would show as 1.05."""
    a = F.abs(x)
    high = (a - F.floor(a)) * 2.0**26
    # The fraction in units of 2**-60: what is below doesn't matter, as it is there in texts of 0.00 only.
    parts = F.struct(F.floor(a).alias("whole"), (F.floor(high) * 100).alias("high"), (F.floor((high - F.floor(high)) * 2.0**34) * 100).alias("low"))

    def rounded(p: Column) -> Column:
        total, low = p["high"] + F.shiftright(p["low"], 34), p["low"].bitwiseAND(F.lit((1 << 34) - 1))
        cents, rest = F.shiftright(total, 26), F.shiftleft(total.bitwiseAND(F.lit((1 << 26) - 1)), 34) + low
        up = (rest > 1 << 59) | ((rest == 1 << 59) & (cents % 2 == 1))
        return F.struct(p["whole"].alias("whole"), (cents + up.cast("long")).alias("cents"))

    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    shown = let(let(parts, rounded), lambda p: F.concat(sign, (p["whole"] + (p["cents"] == 100).cast("long")).cast("string"), F.lit("."), F.lpad((p["cents"] % 100).cast("string"), 2, "0")))
    return F.when(a < 2.0**53, shown).otherwise(F.format_string("%.2f", x))


def format_fact_value(value: Column, decimals: Column) -> Column:
    """Display text; whole numbers are taken as millions once scaled by negative decimals."""
    raw = F.translate(value, ",", "").try_cast("long")
    d = F.coalesce(decimals.try_cast("int"), F.lit(0))
    x = F.when(d < 0, raw / F.pow(F.lit(10.0), -d)).otherwise(raw.cast("double"))
    money = let(F.when(x >= 1000, x / 1000).otherwise(x), lambda v: F.concat(F.lit("$"), two_places(v)))
    shown = F.when(x >= 1000, F.concat(money, F.lit(" billion"))).when(x >= 1, F.concat(money, F.lit(" million"))).otherwise(F.format_string("$%,.0f", F.rint(x)))
    return F.when(raw.isNull(), value).otherwise(shown)


def fact_excerpt(concept: Column, shown: Column, currency: Column, period: Column) -> Column:
    """"XBRL concept: value [currency] [for period p]"; empty parts are left out."""
    return F.concat_ws(
        " ", F.concat(F.lit("XBRL "), concept, F.lit(": "), shown), F.when(currency != "", currency), F.when(period != "", F.concat(F.lit("for period "), period))
    )


def parse_fact_excerpt(excerpt: Column) -> Column:
    """struct(concept, value_display, period_start, period_end, is_annual); empty strings if absent.
    Annual means a calendar year."""
    g = [F.regexp_extract(F.trim(excerpt), _FACT, i) for i in range(1, 5)]
    annual = g[2].endswith("-01-01") & g[3].endswith("-12-31")
    return F.struct(g[0].alias("concept"), F.trim(g[1]).alias("value_display"), g[2].alias("period_start"), g[3].alias("period_end"), annual.alias("is_annual"))


def parse_display_value(text: Column) -> Column:
    """Number of "12.5 billion", "3 million", else the first plain number; other words don't scale."""
    def number(pattern: str, by: float) -> Column:
        return F.translate(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), ",", "").try_cast("double") * F.lit(by)

    return F.coalesce(number(r"(?i)([0-9][0-9,.]*)\s*billion", 1e9), number(r"(?i)([0-9][0-9,.]*)\s*million", 1e6), number(r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1.0))


def format_number_display(value: Column, percent: Column) -> Column:
    a = F.abs(value)
    money = let(F.when(percent, value).when(a >= 1e9, value / 1e9).when(a >= 1e6, value / 1e6).otherwise(value), two_places)
    return (
        F.when(percent, F.concat(money, F.lit("%"))).when(a >= 1e9, F.concat(F.lit("$"), money, F.lit(" billion")))
        .when(a >= 1e6, F.concat(F.lit("$"), money, F.lit(" million"))).when(a >= 1e3, F.format_string("%,.0f", F.rint(value))).otherwise(money)
    )


def detect_scale(shown: Column) -> Column:
    t = F.lower(shown)
    return F.when(t.contains("billion"), "billions").when(t.contains("million"), "millions").when(t.contains("thousand"), "thousands").otherwise("units")


def parse_numeric_gt(answer: Column) -> Column:
    """Number of a ground-truth answer: percent sign and currency dropped, a final scale word applied."""
    scales = (("trillion", 1e12), ("billion", 1e9), ("million", 1e6), ("thousand", 1e3))

    def number(t: Column) -> Column:
        scale = reduce(lambda a, w: a.when(t.rlike(rf"(?i)\s+{w[0]}$"), w[1]), scales[1:], F.when(t.rlike(rf"(?i)\s+{scales[0][0]}$"), scales[0][1])).otherwise(1.0)
        digits = F.regexp_replace(t, r"(?i)\s+(trillion|billion|million|thousand)$", "")
        value = let(digits, lambda d: F.when(d.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), d.try_cast("double")))
        return value * F.when(F.trim(answer).endswith("%"), 1.0).otherwise(scale)

    return let(F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.translate(answer, ",", "")), r"%+$", ""), r"^[\s$€£]+", "")), number)


def numeric_equivalent(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Within a relative tolerance as numbers; equal as trimmed text if either isn't a number."""

    def same(v: Column) -> Column:
        x, y = v["x"], v["y"]
        near = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) <= tolerance
        return F.when(x.isNull() | y.isNull(), F.trim(a) == F.trim(b)).otherwise((x == y) | near)

    return let(F.struct(parse_numeric_gt(a).alias("x"), parse_numeric_gt(b).alias("y")), same)


def excerpt_matches_value(excerpt: Column, target: Column, tolerance: float = 0.02) -> Column:
    """Whether a number of the excerpt is the target, as it stands or in the named scale."""
    numbers = F.regexp_extract_all(F.translate(excerpt, ",", ""), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), 1)
    low = F.lower(excerpt)

    def found(known: Column) -> Column:
        def fits(raw: Column) -> Column:
            x, t = raw.try_cast("double"), known["t"]
            near = F.abs(x - t) / F.greatest(F.abs(x), F.abs(t), F.lit(1.0)) <= tolerance
            return near | (known["b"] & (x * 1e9 == t)) | (known["m"] & (x * 1e6 == t))

        return F.exists(known["n"], fits)

    return let(F.struct(numbers.alias("n"), target.alias("t"), low.contains("billion").alias("b"), low.contains("million").alias("m")), found)


def infer_raw_value(answer: Column, decimals: int = -6) -> Column:
    """Whole number that a tagged fact with these decimals would hold; halves go to even."""
    return F.bround(parse_numeric_gt(answer) / F.lit(float(10 ** max(0, -decimals)))).cast("long").cast("string")


def concept_family(concept: Column) -> Column:
    c = F.lower(concept)
    out = F.when(F.lit(False), "")
    for family, words in CONCEPT_FAMILIES:
        out = out.when(_any(c, words), family)
    return out.otherwise("other")


def split_camel_label(concept: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(concept, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"))


def concept_passes_guard(concept: Column, family: Column, segment: Column | None = None) -> Column:
    """Whether a concept may answer a question of a family; unknown or null families let all pass.
    ``segment``: whether the excerpt names a segment, so that any revenue or sales are a segment's."""
    out = F.when(F.lit(False), F.lit(False))
    for name, (without, within) in GUARDS.items():
        out = out.when(family == name, ~concept.rlike("(?i)" + without) & concept.rlike("(?i)" + within))
    of_segment = concept.rlike("(?i)Segment.*Revenue|Revenue.*Segment|Sales.*Segment")
    if segment is not None:
        of_segment = of_segment | (F.coalesce(segment, F.lit(False)) & concept.rlike("(?i)Revenue|Sales"))
    return out.when(family == "segment_revenue", of_segment).otherwise(F.lit(True))


def query_concept_family(question: Column, metric_type: Column) -> Column:
    q = F.lower(question)
    ratio = metric_type == "ratio"
    return (
        F.when(ratio & (q.contains("tax rate") | q.contains("effective tax")), "tax_rate")
        .when(ratio & q.contains("dividend") & (q.contains("payout") | q.contains("ratio")), "dividend_payout")
        .when(ratio & q.contains("margin"), "margin")
        .when(_any(q, ("shareholder equity", "stockholders equity", "total equity", "shareholders' equity")), "equity")
        .when(q.contains("equity") & q.contains("shareholder"), "equity")
        .when(_any(q, ("segment", "energy product", "upstream")), "segment_revenue")
        .when(_any(q, ("change in total assets", "change in assets", "asset change")), "assets")
    )


def query_intent(question: Column) -> Column:
    """struct(intent, source_bias) by keyword hits."""
    q = F.lower(question)
    h, n, t = (_hits(q, INTENT_WORDS[k]) for k in ("hybrid", "numeric", "qualitative"))
    intent = F.when((h >= 2) | ((n >= 1) & (t >= 1)), "hybrid").when(t > n, "qualitative").when(n > 0, "numeric").otherwise("qualitative")
    bias = F.when(intent == "numeric", "xbrl_primary").when(intent == "qualitative", "html_primary").otherwise("blended")
    return F.struct(intent.alias("intent"), bias.alias("source_bias"))


def query_anchor(question: Column) -> Column:
    """latest_annual, latest_quarter, prior_quarter or null."""
    q = F.lower(question)
    quarter = _any(q, ("quarter", "10-q", "10 q"))
    return (
        F.when(_any(q, ("quarter over quarter", "qoq", "sequential quarter")), F.lit(None))
        .when(_any(q, ("prior quarter", "previous quarter")), "prior_quarter")
        .when(_any(q, QUARTER_CUES), "latest_quarter")
        .when(_any(q, ("annual report", "latest 10-k", "10-k", "10k", "fiscal year")) & ~quarter, "latest_annual")
        .when(q.contains("risk factor") & ~q.contains("quarter"), "latest_annual")
    )


def form_preference(question: Column) -> Column:
    q = F.lower(question)
    return F.when(_any(q, ("10-q", "10 q", "quarterly filing", "quarterly report")), "10-Q").when(_any(q, ("10-k", "10 k", "annual report")) & ~q.contains("quarter"), "10-K")


def annual_requested(question: Column) -> Column:
    q = F.lower(question)
    year = q.rlike(r"\b20[0-9]{2}\b")
    return ~q.rlike(r"\b(q[1-4]|quarter|10-q|10 q)\b") & (q.rlike(r"\bfy20[0-9]{2}\b") | (q.contains("fiscal year") & year))


def narrative_kind(title: Column) -> Column:
    t = F.lower(title)
    return (
        F.when(t.contains("risk factor") | t.contains("item 1a"), "risk_factors")
        .when(t.contains("management") & t.contains("discussion"), "md_and_a")
        .when(t.rlike(r"\bitem\s+7\b") | t.contains("md&a"), "md_and_a")
        .when(t.contains("item 1.") & t.contains("business"), "business_description").otherwise("other")
    )


def section_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def split_section_path(path: Column) -> Column:
    """struct(accession, tail); a path without a slash is all tail."""
    slash = path.contains("/")
    return F.struct(
        F.when(slash, F.trim(F.substring_index(path, "/", 1))).otherwise("").alias("accession"),
        F.when(slash, F.trim(F.split(path, "/", 2)[1])).otherwise(F.trim(path)).alias("tail"),
    )


def item_key(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text), "(item[0-9]+[a-z]?)", 1), F.lit(""))


def chunk_kind(chunk_id: Column) -> Column:
    c = F.lower(chunk_id)
    return F.when(c.contains("-html-") | c.startswith("html-"), "html").when(c.contains("xbrl"), "xbrl").otherwise("html")


def evidence_stratum(chunk_ids: Column) -> Column:
    kinds = F.array_distinct(F.transform(chunk_ids, chunk_kind))
    return F.when(chunk_ids.isNull() | (F.size(chunk_ids) == 0), "unknown").when(F.size(kinds) > 1, "mixed").otherwise(kinds[0])


def is_abstention(answer: Column, sufficiency: Column, n_citations: Column, prefix: str = "insufficient evidence") -> Column:
    t = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return answer.isNull() | F.coalesce(sufficiency == "insufficient", F.lit(False)) | (t == "") | t.startswith(prefix) | (t.contains("insufficient evidence") & (F.coalesce(n_citations, F.lit(0)) == 0))


def priority_tier(outcome: Column, mrr: Column, ndcg: Column) -> Column:
    """struct(tier, priority): zero outcomes with good retrieval come first."""
    m, n = F.coalesce(mrr, F.lit(0.0)), F.coalesce(ndcg, F.lit(0.0))
    strong = (m >= 0.5) | (n >= 0.3)
    tier = F.when(outcome.isNull() | (outcome > 0), 3).when(strong, 1).otherwise(2)
    return F.struct(tier.alias("tier"), F.when(tier == 3, 0.0).when(tier == 1, F.greatest(m, n)).otherwise(0.1).alias("priority"))


def hash_embed(text: Column, dims: int = 64) -> Column:
    """Unit vector of hashed word counts; zeros for a text without a word. 64 divides 256, so the last
    two hex digits of a word's digest decide its place."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    places = F.transform(words, lambda w: F.conv(F.right(F.sha2(w, 256), F.lit(2)), 16, 10).cast("int") % dims)

    def unit(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return let(norm, lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    def counted(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(p, lambda x: x == i)).cast("double"))

    return let(let(places, counted), unit)


def cosine_unit(a: Column, b: Column) -> Column:
    """Dot product of unit vectors; vectors of different lengths are an error."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), dot).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def ungrounded_numbers(answer: Column, cited: Column) -> Column:
    """Numbers of an answer that the cited text doesn't contain, in order, once each."""
    found = F.regexp_extract_all(F.translate(answer, ",", ""), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1)
    return F.array_distinct(F.filter(found, lambda x: ~F.translate(cited, ",", "").contains(x)))


def edgar_url(cik: Column, accession: Column) -> Column:
    plain = F.ltrim(cik, F.lit("0"))
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.when(plain == "", "0").otherwise(plain), F.lit("/"), F.translate(accession, "-", ""), F.lit("/"), accession, F.lit("-index.htm"))


def segment_hint(text: Column) -> Column:
    t = F.lower(text)
    out = F.when(F.lit(False), "")
    for name in SEGMENTS:
        out = out.when(t.contains(name.lower()), name)
    return out


def metric_type(question: Column) -> Column:
    """ratio, percent_change, delta or point, by cue."""
    q = F.lower(question)
    return (
        F.when(_any(q, ("tax rate", "payout", "margin", "ratio")), "ratio").when(_any(q, ("percent", "growth", "year over year", "compared to prior")), "percent_change")
        .when(_any(q, ("change in", "increase", "decrease", "difference")), "delta").otherwise("point")
    )


def question_year_mismatch(question: Column, labels: Column) -> Column:
    """Whether the years in a question and in bound period labels are both present and disjoint."""
    asked = F.regexp_extract_all(question, F.lit(r"(20[0-9]{2}|19[0-9]{2})"), 1)
    bound = F.flatten(F.transform(labels, lambda x: F.regexp_extract_all(x, F.lit(r"(20[0-9]{2}|19[0-9]{2})"), 1)))
    return (F.size(asked) > 0) & (F.size(bound) > 0) & ~F.arrays_overlap(asked, bound)


def align_question_years(question: Column, labels: Column) -> Column:
    """The question with each year 20.. that no bound period label has replaced by the latest year
    of the labels; unchanged where the labels have no year."""
    bound = F.flatten(F.transform(labels, lambda x: F.regexp_extract_all(x, F.lit("20[0-9]{2}"), 0)))
    latest = F.array_max(bound)
    between = F.split(question, "20[0-9]{2}", -1)
    years = F.transform(F.regexp_extract_all(question, F.lit("20[0-9]{2}"), 0), lambda y: F.when(F.array_contains(bound, y), y).otherwise(latest))
    pairs = F.zip_with(between, years, lambda a, y: F.concat(a, F.coalesce(y, F.lit(""))))
    return F.when(latest.isNull(), question).otherwise(F.array_join(pairs, ""))


# Patterns of concepts, roles, sections and file names.
PRIORITISED = "Revenue|Sales|Income|Earnings|Profit|Assets|Liabilities|Equity|Cash|EPS|Margin|Operating|Gross|Net|Debt|Securities|Receivable|Payable|Expense|CostOf|Investment|Dividend|Shares|Stock|Depreciation|Amortization"
CONCEPT_HINTS = (("revenue", "Revenue|Sales"), ("sales", "Revenue|Sales"), ("income", "Income|Earnings|Profit"), ("asset", "Assets"), ("cash", "Cash"), ("debt", "Debt|Borrow"))
REVENUE_CONCEPTS = "RevenueFromContract|NetSales|TotalRevenues?|SalesRevenueNet"
SECURITIES_SALES = "AvailableForSale|ProceedsFromSale|SaleOfStock|SalesTypeLease|SecuritiesSold|DebtSecurities.*Sale|SaleMaturity|SaleOfAvailable"
ROLE_RULES = (  # (pattern, roles, statement, label); the first that fits counts
    ("^(ProfitLoss|NetIncomeLoss)$", ("net_income", "margin_numerator"), "income_statement", "Net income (loss)"),
    ("BeforeIncomeTax|IncomeLossFromContinuingOperationsBefore", ("pretax_income",), "income_statement", "Income before income taxes"),
    ("^(Revenues|RevenueFromContractWithCustomerExcludingAssessedTax|SalesRevenueNet|TotalRevenuesAndOtherIncome)$", ("revenue", "total_revenue", "margin_denominator"), "income_statement", "Revenues"),
    ("StockholdersEquity|ShareholdersEquity|TotalEquity", ("total_equity",), "balance_sheet", "Total shareholders' equity"),
    ("Assets$|AssetsCurrent|AssetsNoncurrent", ("total_assets",), "balance_sheet", "Total assets"),
    ("Liabilit", ("total_liabilities",), "balance_sheet", "Total liabilities"),
    ("EarningsPerShare|EPS", ("eps",), "income_statement", "Earnings per share"),
    ("NetCashProvidedBy|CashProvidedBy", ("operating_cash_flow",), "cash_flow", "Net cash provided by operating activities"),
)


def is_prioritised(concept: Column) -> Column:
    return concept.rlike("(?i)" + PRIORITISED)


def concept_matches_query(concept: Column, question: Column) -> Column:
    """Whether a concept answers a question's words; sales of securities don't answer "sales"."""
    q = F.lower(question)
    hint = F.when(F.lit(False), F.lit(False))
    for word, pattern in CONCEPT_HINTS:
        hint = hint.when(q.contains(word), concept.rlike("(?i)" + pattern))
    revenue = _any(q, ("revenue", "sales")) & concept.rlike("(?i)" + REVENUE_CONCEPTS)
    return (concept != "") & ~concept.rlike("(?i)" + SECURITIES_SALES) & (revenue | hint.otherwise(F.lit(False)))


def concept_roles(concept: Column, rules=ROLE_RULES) -> Column:
    """struct(roles, statement, label) of the first rule that fits; null if none does. ``rules`` may be
    extended by the caller."""
    out = F.when(F.lit(False), F.lit(None).cast("struct<roles:array<string>,statement:string,label:string>"))
    for pattern, roles, statement, label in rules:
        out = out.when(concept.rlike(pattern), F.struct(F.array(*map(F.lit, roles)).alias("roles"), F.lit(statement).alias("statement"), F.lit(label).alias("label")))
    return out


def query_flags(question: Column) -> Column:
    """struct of booleans: is_comparison, is_divestiture, is_mda, is_risk_only, is_comparison_risk,
    is_financial, is_financial_numeric."""
    q = F.lower(question)
    comparison = _any(q, ("compare", "comparison", "versus", " vs ", "both companies", "both filings", "across", "contrast"))
    divestiture = _any(q, ("divest", "asset sale", "proceeds from sale", "disposal", "sold in"))
    mda = _any(q, ("md&a", "management discussion", "management's discussion", "outlook")) | divestiture
    risk = q.rlike(RISK_WORDS) & ~mda
    return F.struct(
        comparison.alias("is_comparison"), divestiture.alias("is_divestiture"), mda.alias("is_mda"), risk.alias("is_risk_only"),
        (_any(q, COMPARED_RISK_WORDS) & risk).alias("is_comparison_risk"), q.rlike(FINANCIAL_WORDS).alias("is_financial"),
        (_any(q, NUMERIC_WORDS) & ~mda).alias("is_financial_numeric"),
    )


def is_corrupt_tail(tail: Column) -> Column:
    """Whether a path tail looks like a piece of an answer rather than a section's name."""
    t = F.trim(F.coalesce(tail, F.lit("")))
    blanks = F.length(t) - F.length(F.translate(t, " ", ""))
    slug = F.translate(t, "_-", "  ")
    slug_blanks = F.length(slug) - F.length(F.translate(slug, " ", ""))
    return (
        F.when(t == "", True).when(t.rlike(r"(?i)[\$€£]|\b(billion|million|thousand|bn|mm)\b|[0-9]{5,}"), True)
        .when(item_key(section_key(t)).isNotNull() | t.rlike(r"(?i)\bitem\s*[0-9]+[a-z]?\b"), False)
        .when((F.length(t) <= 48) & (blanks <= 4) & (slug_blanks <= 3), False).when((F.length(t) > 60) | (blanks >= 6), True)
        .when(t.rlike("^[a-z]") & ~F.lower(F.left(t, F.lit(12))).contains("item"), True).otherwise(False)
    )


def outcome_scores(scores: Column, abstained: Column, has_answer: Column, has_rubric: Column) -> Column:
    """struct(outcome, alignment) of a verdict's scores (a map); an abstention has 0 where there is a
    ground truth."""
    get = lambda k: F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0))
    outcome = F.when(abstained & (has_answer | has_rubric), 0.0).when(~abstained & has_answer, get("value_alignment")).otherwise(get("synthesis_grounding"))
    alignment = F.when(has_rubric & ~abstained, get("claim_presence")).otherwise(0.0)
    return F.struct(outcome.alias("outcome"), alignment.alias("alignment"))


def required_criteria(variant: Column, has_answer: Column, has_rubric: Column) -> Column:
    base = F.when(variant == "flat-chunk", F.array(*map(F.lit, ("retrieval_fidelity", "answer_quality", "synthesis_grounding")))).otherwise(
        F.array(*map(F.lit, ("trajectory_coherence", "routing_decisions", "retrieval_fidelity", "synthesis_grounding"))))
    return F.array_compact(F.concat(base, F.array(F.when(has_answer, "value_alignment"), F.when(has_rubric, "claim_presence"))))


def needs_scoring(version: Column, scores: Column, required: Column, least: float = 3.1) -> Column:
    """Whether a verdict is absent, of an older version, or lacks a required criterion."""
    number = F.coalesce(F.nullif(F.regexp_extract(F.lower(version), r"^v?([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return scores.isNull() | (number < least) | (F.size(F.array_except(required, F.map_keys(scores))) > 0)


def artifact_role(name: Column) -> Column:
    """Role of a file of a filing package by its name; the first rule counts."""
    n = F.lower(name)
    return (
        F.when(n.endswith("-xbrl.zip") | n.endswith("_xbrl.zip"), "xbrl_zip").when(n.endswith("_htm.xml") | (n.endswith(".xml") & n.contains("htm")), "instance")
        .when(n.endswith(".xsd"), "schema").when(n.endswith("_cal.xml"), "calculation").when(n.endswith("_def.xml"), "definition")
        .when(n.endswith("_lab.xml"), "label").when(n.endswith("_pre.xml"), "presentation").otherwise("other")
    )


def period_matches_intent(start: Column, end: Column, annual: Column, target: Column, form: Column) -> Column:
    """Whether a fact's period fits a target fiscal year and form; without a target or an end all fit."""
    y, s = F.year(end), F.coalesce(F.year(start), F.year(end))
    day = F.date_format(end, "MM-dd")
    k = (
        F.when((day == "01-01") & (s == target - 1) & (y == target), False).when(annual, (y == target) | (s == target))
        .when((y == target) & (day == "12-31"), True).when((s > target) & (y > target), False).otherwise((y == target) & (day != "01-01"))
    )
    other = F.when(annual, (y == target) | (s == target)).when((s > target) & (y > target), False).otherwise((y == target) | (s == target))
    return F.when(target.isNull() | end.isNull(), True).when(form == "10-Q", y == target).when(form == "10-K", k).otherwise(other)


def section_score(question: Column, label: Column, section_id: Column) -> Column:
    """Additive keyword score of a section for a question, HTML sections preferred."""
    q, t, s = F.lower(question), F.lower(label), F.lower(section_id)
    flags = query_flags(question)
    base = F.when(F.exists(F.slice(F.split(q, r"\s+"), 1, 5), lambda w: t.contains(w)), 1.0).otherwise(0.3)
    add = lambda c, x: F.when(c, x).otherwise(0.0)
    out = base + add(_any(t, ("financial", "balance", "income", "cash", "liquidity", "margin")), 0.4)
    out = out + add(_any(q, ("revenue", "sales", "driver", "segment", "growth")) & _any(t, ("revenue", "management", "md&a", "results", "operations", "business", "xbrl", "financial facts")), 0.5)
    out = out + add(t.contains("xbrl") & _any(q, ("revenue", "sales", "income", "assets", "cash", "earnings")), 2.0) + add(s.startswith("html"), 2.5)
    out = out + add(flags["is_mda"] & s.contains("md_and_a"), 15.0) + add(flags["is_mda"] & _any(t, ("management", "discussion", "analysis", "md&a", "mda")), 8.0)
    out = out + add(flags["is_risk_only"] & s.contains("risk_factors"), 12.0) + add(flags["is_risk_only"] & s.contains("business_description"), -6.0)
    return F.round(out + add(s.contains("risk_factors"), 1.5) + add(s.contains("md_and_a"), 1.5), 3)
