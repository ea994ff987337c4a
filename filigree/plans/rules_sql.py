"""Rules on questions and concepts as SQL on their text, for oracles of several plans."""

from __future__ import annotations

from ..functions import intents as I
from ..functions import scalars as S


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def has(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def like(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted('(?i)' + pattern)})"


def metric(q: str) -> str:
    return (
        f"CASE WHEN {has(q, 'tax rate', 'payout', 'margin', 'ratio')} THEN 'ratio' WHEN {has(q, 'percent', 'growth', 'year over year', 'compared to prior')} THEN 'percent_change' "
        f"WHEN {has(q, 'change in', 'increase', 'decrease', 'difference')} THEN 'delta' ELSE 'point' END"
    )


def family(q: str) -> str:
    ratio = has(q, "tax rate", "payout", "margin", "ratio")
    return (
        f"CASE WHEN {ratio} AND {has(q, 'tax rate', 'effective tax')} THEN 'tax_rate' WHEN {ratio} AND contains({q}, 'dividend') AND {has(q, 'payout', 'ratio')} THEN 'dividend_payout' "
        f"WHEN {ratio} AND contains({q}, 'margin') THEN 'margin' WHEN {has(q, 'shareholder equity', 'stockholders equity', 'total equity')} OR (contains({q}, 'equity') AND contains({q}, 'shareholder')) THEN 'equity' "
        f"WHEN {has(q, 'segment', 'energy product', 'upstream')} THEN 'segment_revenue' WHEN {has(q, 'change in total assets', 'change in assets', 'asset change')} THEN 'assets' END"
    )


def passes(concept: str, fam: str) -> str:
    whens = " ".join(f"WHEN {fam} = '{n}' THEN NOT {like(concept, out)} AND {like(concept, inside)}" for n, (out, inside) in S.GUARDS.items())
    return f"CASE {whens} WHEN {fam} = 'segment_revenue' THEN {like(concept, 'Segment.*Revenue|Revenue.*Segment|Sales.*Segment')} ELSE true END"


def matches(concept: str, q: str) -> str:
    hints = " ".join(f"WHEN contains({q}, '{w}') THEN {like(concept, p)}" for w, p in S.CONCEPT_HINTS)
    return f"({concept} <> '' AND NOT {like(concept, S.SECURITIES_SALES)} AND (({has(q, 'revenue', 'sales')} AND {like(concept, S.REVENUE_CONCEPTS)}) OR CASE {hints} ELSE false END))"


def fits(start: str, end: str, annual: str, target: str, form: str) -> str:
    y, s, day = f"year({end})", f"coalesce(year({start}), year({end}))", f"strftime({end}, '%m-%d')"
    either, later = f"({y} = {target} OR {s} = {target})", f"({s} > {target} AND {y} > {target})"
    k = f"CASE WHEN {day} = '01-01' AND {s} = {target} - 1 AND {y} = {target} THEN false WHEN {annual} THEN {either} WHEN {y} = {target} AND {day} = '12-31' THEN true WHEN {later} THEN false ELSE {y} = {target} AND {day} <> '01-01' END"
    return f"CASE WHEN {target} IS NULL OR {end} IS NULL THEN true WHEN {form} = '10-Q' THEN {y} = {target} WHEN {form} = '10-K' THEN {k} WHEN {annual} THEN {either} WHEN {later} THEN false ELSE {either} END"


def flags(q: str) -> dict[str, str]:
    divestiture = has(q, "divest", "asset sale", "proceeds from sale", "disposal", "sold in")
    mda = f"({has(q, 'md&a', 'management discussion', 'management' + chr(39) + 's discussion', 'outlook')} OR {divestiture})"
    comparison = has(q, "compare", "comparison", "versus", " vs ", "both companies", "both filings", "across", "contrast")
    risk = f"({like(q, S.RISK_WORDS)} AND NOT {mda})"
    return {"is_comparison": comparison, "is_divestiture": divestiture, "is_mda": mda, "is_risk_only": risk, "is_comparison_risk": f"({has(q, *S.COMPARED_RISK_WORDS)} AND {risk})",
            "is_financial": like(q, S.FINANCIAL_WORDS), "is_financial_numeric": f"({has(q, *S.NUMERIC_WORDS)} AND NOT {mda})"}


def label(x: str) -> str:
    named, plain = (f"regexp_extract(trim({x}), {quoted(p)}, 1)" for p in (r"(?i)\bFY(20[0-9]{2})\b", r"(?i)^(20[0-9]{2})(?:-FY|FY)?$"))
    return f"CASE WHEN {named} <> '' THEN 'FY' || {named} WHEN {plain} <> '' THEN 'FY' || {plain} ELSE trim({x}) END"


def hints(q: str, every: str, sold: str, quarterly: str) -> str:
    def listed(*words: str) -> str:
        return "[" + ", ".join(map(quoted, words)) + "]"

    sale = f"list_concat(CASE WHEN {quarterly} THEN {listed(*I.QUARTERLY_SALE_HINTS)} ELSE {listed(*I.ANNUAL_SALE_HINTS)} END, {listed('divest', 'asset sale', 'proceeds')})"
    parts = [f"CASE WHEN {sold} THEN {sale} WHEN {has(every, *I.RISK_WORDS)} THEN {listed(*I.RISK_HINTS)} ELSE [] END"]
    parts += [f"CASE WHEN {has(every, *words)} THEN {listed(*found)} ELSE [] END" for words, found in I.HINT_RULES]
    parts += [f"CASE WHEN NOT {sold} AND {has(q, *I.NUMERIC_WORDS)} AND NOT {has(q, *I.SALE_WORDS)} THEN {listed(*I.NUMERIC_HINTS)} ELSE [] END"]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def hits(q: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({q}, {quoted(w)})::INT" for w in words) + ")"


def intent(q: str) -> str:
    hybrid, numeric, worded = (hits(q, S.INTENT_WORDS[k]) for k in ("hybrid", "numeric", "qualitative"))
    return f"CASE WHEN {hybrid} >= 2 OR ({numeric} >= 1 AND {worded} >= 1) THEN 'hybrid' WHEN {worded} > {numeric} THEN 'qualitative' WHEN {numeric} > 0 THEN 'numeric' ELSE 'qualitative' END"


def anchor(q: str) -> str:
    quarter = has(q, "quarter", "10-q", "10 q")
    return (
        f"CASE WHEN {has(q, 'quarter over quarter', 'qoq', 'sequential quarter')} THEN NULL WHEN {has(q, 'prior quarter', 'previous quarter')} THEN 'prior_quarter' WHEN {has(q, *S.QUARTER_CUES)} THEN 'latest_quarter' "
        f"WHEN {has(q, 'annual report', 'latest 10-k', '10-k', '10k', 'fiscal year')} AND NOT {quarter} THEN 'latest_annual' WHEN contains({q}, 'risk factor') AND NOT contains({q}, 'quarter') THEN 'latest_annual' END"
    )


def form(q: str) -> str:
    return f"CASE WHEN {has(q, '10-q', '10 q', 'quarterly filing', 'quarterly report')} THEN '10-Q' WHEN {has(q, '10-k', '10 k', 'annual report')} AND NOT contains({q}, 'quarter') THEN '10-K' END"


def annual(q: str) -> str:
    return rf"(NOT regexp_matches({q}, '\b(q[1-4]|quarter|10-q|10 q)\b') AND (regexp_matches({q}, '\bfy20[0-9]{{2}}\b') OR (contains({q}, 'fiscal year') AND regexp_matches({q}, '\b20[0-9]{{2}}\b'))))"
