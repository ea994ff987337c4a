"""Queries over the publishing of benchmark items, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import claims as K
from ..functions import comparison as C
from ..functions.lineage import written
from ..operators import audits as A
from ..operators import dataset as D
from ..operators import publishing as P
from ..operators import repair as R
from ..sources.views import Frames
from . import rules_sql as Q
from .plan import Plans
from .repair_plans import _BASE, _PATHS, _claims, _index, _snapshot, settled

PLANS = Plans()


def _drafts(f: Frames) -> DataFrame:
    return f["drafts"].withColumns({c: F.filter(F.split(c, ";"), lambda x: x != "") for c in P.LISTS})


def _inputs(f: Frames) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drafts, index and snapshot, written once."""
    return written(_drafts(f), "drafts"), written(R.clean_index(_index(f)), "clean-index"), written(_snapshot(f), "snapshot")


def _blocked(f: Frames, newer: bool, inputs: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """What blocks drafts; f has settled filings."""
    drafts, index, snapshot = inputs or (_drafts(f), R.clean_index(_index(f)), _snapshot(f))
    return P.blocked_items(drafts, index, snapshot, f["filings"], newer)


#: Drafts with what the rules ask; s: claims that are there, m: what the binding lacks.
_ASKED = f"""
{_BASE.replace("FROM bundle", "FROM drafts")}, {_PATHS},
cs AS (SELECT item_id, named, ta, tb, own AS claims FROM e), {_claims("cs")},
oc AS (SELECT item_id, string_agg(a, ', ' ORDER BY a) AS outside FROM (SELECT DISTINCT item_id, unnest(acc) AS a FROM i) WHERE a NOT IN (SELECT accession FROM sn) GROUP BY 1),
of AS (SELECT item_id, bool_or(f.accession IS NULL) AS strange FROM (SELECT item_id, issuer_id, unnest(acc) AS a FROM i) o LEFT JOIN (SELECT DISTINCT issuer_id, accession FROM filings) f ON f.issuer_id = o.issuer_id AND f.accession = o.a GROUP BY 1),
k0 AS (SELECT e.*, coalesce(structured, false) AS structured, outside, coalesce(strange, false) AS strange, coalesce(can.canonical, []) AS canonical, coalesce(can.unknown, []) AS lost, coalesce(regexp_matches(lower(tag), 'comparison|multi-hop|cross-filing|agentic-multi'), false) AS tagged, coalesce(contains(lower(tag), 'reference'), false) AS referring,
  len(list_filter(own, lambda c: trim(c) <> '')) AS n_claims, len(list_distinct(acc)) AS bound, regexp_matches(t, {Q.quoted(C.BOTH)}) AS both_say, regexp_matches(t, {Q.quoted(C.BOTH_AND)}) AS both_and, regexp_matches(t, {Q.quoted(C.CROSS)}) AS crossed,
  len(list_distinct(regexp_extract_all(t, {Q.quoted(C.PERCENT)}))) >= 2 OR len(list_distinct(regexp_extract_all(t, {Q.quoted(C.DOLLARS)}))) >= 2 AS contrast, len(regexp_extract_all(t, '\\S+')) AS n_words,
  len(regexp_extract_all(regexp_replace(lower(t), {Q.quoted(C.TEMPLATE)}, ' ', 'g'), '\\S+')) AS own_words, regexp_extract_all(question, '20[0-9][0-9]|19[0-9][0-9]') AS asked, regexp_extract_all(coalesce(periods, ''), '20[0-9][0-9]|19[0-9][0-9]') AS meant,
  is_number OR (len(words) <= 4 AND len(list_filter(words, lambda w: list_contains(['is', 'are', 'was', 'were', 'has', 'have', 'had', 'the', 'and', 'that'], lower(w)))) = 0) AS label,
  CASE WHEN len(acc) = 0 THEN 'missing_accessions' WHEN coalesce(strange, false) THEN 'not_in_manifest' WHEN {Q.has('lower(question)', *A.YOY_CUES)} AND {Q.has('lower(question)', *A.QOQ_CUES)} THEN 'ambiguous_comparison' END AS macro
  FROM e LEFT JOIN cs_s USING (item_id) LEFT JOIN oc USING (item_id) LEFT JOIN of USING (item_id) LEFT JOIN can USING (item_id)),
k AS (SELECT *, tagged OR coalesce(answer_type = 'comparison', false) AS compared, both_say OR (both_and AND crossed) AS is_canonical, both_say AND NOT crossed AND own_words < 25 AND NOT contrast AS dull, coalesce(answer, '') <> '' AS answered FROM k0)"""

_COMMON = [("tagged AND bound < 2", "comparison_bindings", "bound || ' accessions'"), ("referring AND outside IS NOT NULL", "reference_corpus", "outside")]
_LAST = [
    ("answered AND len(asked) > 0 AND len(meant) > 0 AND NOT list_has_any(asked, meant)", "question_binding_year_mismatch", "replace(periods, ';', ', ')"),
    ("answered AND len(raw) = 0", "missing_section_paths", "'paths'"), ("answered AND len(raw) > 0 AND (len(lost) > 0 OR len(canonical) = 0)", "section_unreachable", "array_to_string(lost, ', ')"),
]
_NEWER = [
    ("t = ''", "missing_answer_gt", "'answer'"), ("item_id LIKE 'live-%' OR regexp_full_match(item_id, '[a-z]+-[0-9]{4}')", "v1_item_reuse", "'item_id'"),
    ("(answer_type = 'narrative' AND n_claims NOT BETWEEN 2 AND 8) OR (answer_type = 'comparison' AND n_claims NOT BETWEEN 3 AND 8)", "required_claims", "n_claims || ' claims'"),
    ("compared AND answer_type IS DISTINCT FROM 'comparison'", "invalid_answer_type", "'answer_type'"), ("compared AND t = ''", "missing_answer_gt", "'comparison'"),
    ("compared AND t <> '' AND NOT is_canonical", "invalid_answer_type", "'comparison'"), ("compared AND t <> '' AND dull", "boilerplate_comparison_answer", "'comparison'"),
    ("compared AND t <> '' AND bound < 2", "comparison_bindings", "'comparison'"), ("compared AND t <> '' AND NOT structured", "required_claims", "'comparison'"),
    *_COMMON, *_LAST, ("macro IS NOT NULL", "macro_bindability", "macro"),
]
_OLDER = [
    *_COMMON, ("answered AND NOT (t <> '' AND label) AND len(own) = 0", "required_claims", "'narrative'"),
    ("answer_type IS NULL AND (tagged OR referring) AND trim(coalesce(rubric, '')) = ''", "rubric_route", "'rubric'"), *_LAST,
]


def _held_back(name: str, rules: list[tuple[str, str, str]]) -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT item_id, {i} AS rule, '{reason}' AS reason, {detail} AS detail FROM k WHERE {test}" for i, (test, reason, detail) in enumerate(rules)) + ")"


@PLANS.add("q10_blocked_items", f"WITH {_ASKED}, {_held_back('b', _NEWER)} SELECT * FROM b", ("drafts", "filings"))
def blocked(f: Frames) -> DataFrame:
    return _blocked(settled(f), True)


@PLANS.add("q10_blocked_reasons", f"WITH {_ASKED}, {_held_back('b', _OLDER)} SELECT reason, count(*) AS n, count(DISTINCT item_id) AS n_items, min(item_id) AS example FROM b GROUP BY 1", ("drafts", "filings"))
def reasons(f: Frames) -> DataFrame:
    return P.blocked_reasons(_blocked(settled(f), False))


@PLANS.add("q13_scorability_full", f"""
WITH {_ASKED} SELECT coalesce(answer_type, 'unknown') AS answer_type, count(*) AS n, count(*) FILTER (t <> '') AS scorable, count(*) FILTER (t = '' AND trim(coalesce(rubric, '')) <> '') AS rubric_only, count(*) FILTER (compared AND t <> '' AND dull) AS boilerplate,
  count(*) FILTER (compared AND t <> '' AND NOT dull AND CASE WHEN both_say THEN 2 ELSE 4 END + CASE WHEN crossed THEN 4 ELSE 0 END + CASE WHEN n_words >= 25 THEN 2 ELSE 0 END + CASE WHEN contrast THEN 2 ELSE 0 END < 5) AS borderline FROM k GROUP BY 1""", ("drafts", "filings"))
def scores(f: Frames) -> DataFrame:
    return P.scorability(_drafts(f))


@PLANS.add("q13_borderline_comparisons", f"""
WITH {_ASKED}, s AS (SELECT item_id, CASE WHEN both_say THEN 2 ELSE 4 END + CASE WHEN crossed THEN 4 ELSE 0 END + CASE WHEN n_words >= 25 THEN 2 ELSE 0 END + CASE WHEN contrast THEN 2 ELSE 0 END AS tenths FROM k WHERE compared AND t <> '' AND NOT dull)
SELECT item_id, tenths / 10.0::DOUBLE AS informativeness FROM s WHERE tenths < 5""", ("drafts", "filings"))
def borderline(f: Frames) -> DataFrame:
    return P.borderline_comparisons(_drafts(f))


_SUMMARY = """SELECT '{kind}' AS kind, count(*) AS item_count, count(*) FILTER (multi OR tagged) AS multi_filing_count, round(coalesce(count(*) FILTER (t <> '') / nullif(count(*), 0), 0), 9) AS answer_gt_coverage,
  (SELECT count(*) FROM {b}) AS blocked_count, (SELECT count(*) FROM {b} WHERE reason LIKE 'question%') AS year_mismatch_count, (SELECT count(*) FROM {b} WHERE reason IN ('missing_section_paths', 'section_unreachable')) AS unreachable_answer_gt_count,
  (SELECT count(*) FROM {b} WHERE reason = 'macro_bindability') AS macro_bindability_failures, (SELECT item_id FROM {b} ORDER BY item_id, rule LIMIT 1) AS first_item, (SELECT reason FROM {b} ORDER BY item_id, rule LIMIT 1) AS first_reason,
  count(*) FILTER (t = '' AND trim(coalesce(rubric, '')) <> '') AS rubric_only, count(*) FILTER (compared AND t <> '' AND dull) AS boilerplate, (SELECT round(coalesce(avg((quality = 1)::INT), 0), 9) FROM items) AS pass_rate FROM k"""


@PLANS.add("q14_all_gates", f"""
WITH {_ASKED}, {_held_back('bn', _NEWER)}, {_held_back('bo', _OLDER)}, r AS ({_SUMMARY.format(kind="newer", b="bn")} UNION ALL {_SUMMARY.format(kind="older", b="bo")})
SELECT *, concat_ws(',', CASE WHEN kind = 'older' THEN 'too_few_items' END, CASE WHEN kind = 'older' AND pass_rate < 0.95 THEN 'pass_rate' END, CASE WHEN kind = 'newer' AND item_count < 200 THEN 'too_few_rows' END, CASE WHEN kind = 'newer' AND item_count <> 250 THEN 'count_differs' END,
  CASE WHEN blocked_count > 0 THEN 'infeasible' END, CASE WHEN kind = 'newer' AND answer_gt_coverage < 1 THEN 'coverage' END, CASE WHEN kind = 'newer' AND rubric_only > 0 THEN 'rubric_only' END, CASE WHEN kind = 'newer' AND boilerplate > 0 THEN 'boilerplate' END,
  CASE WHEN kind = 'newer' AND multi_filing_count < 40 THEN 'multi_filing' END, CASE WHEN kind = 'newer' THEN 'not_signed' END, CASE WHEN unreachable_answer_gt_count > 0 THEN 'unreachable' END) AS violations FROM r""", ("drafts", "filings", "items"))
def gates(f: Frames) -> DataFrame:
    f = settled(f)
    candidates = f["items"].select(F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("status"))
    inputs = _inputs(f)
    newer, older = (written(_blocked(f, n, inputs), "blocked") for n in (True, False))
    newer = P.all_gates(inputs[0], newer, candidates, declared=250, signed=False).select(F.lit("newer").alias("kind"), "*")
    older = P.all_gates(inputs[0], older, candidates, declared=150, newer=False).select(F.lit("older").alias("kind"), "*")
    rounded = {c: F.round(c, 9) for c in ("answer_gt_coverage", "pass_rate")}
    return newer.unionByName(older).withColumns({**rounded, "violations": F.array_join("violations", ",")})


def _patches(f: Frames) -> DataFrame:
    """Patches of one to four fields made of the overrides that may be applied."""
    m, text = F.expr("ordinal div 4"), lambda *x: F.array(*map(F.lit, x))
    return D.eligible_overrides(f["annotations"]).select(
        "item_id", F.col("ordinal").alias("annotation"), F.when(m % 3 == 0, F.concat("proposed", F.lit(", what was net income?"))).when(m % 3 == 1, "").alias("question"),
        F.when(m % 5 == 0, text("XBRL Financial Facts", "item 1a")).when(m % 5 == 1, text("nowhere")).when(m % 5 == 2, text("Item 2")).alias("paths"),
        F.when(m % 7 == 0, text("9999999999-00-000000")).alias("accessions"), F.when(m % 2 == 0, m.cast("string")).alias("answer"), F.when(m % 4 == 3, "a point").alias("rubric"),
    )


_PATCHED = f"""
g AS (SELECT * FROM annotations WHERE spot_check AND proposed IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, ordinal DESC) = 1),
pt AS (SELECT item_id, ordinal AS annotation, ordinal // 4 AS m, CASE WHEN (ordinal // 4) % 3 = 0 THEN proposed || ', what was net income?' END AS q2, CASE (ordinal // 4) % 5 WHEN 0 THEN 'XBRL Financial Facts;item 1a' WHEN 1 THEN 'nowhere' WHEN 2 THEN 'Item 2' END AS p2,
  CASE WHEN (ordinal // 4) % 7 = 0 THEN '9999999999-00-000000' END AS a2, CASE WHEN (ordinal // 4) % 2 = 0 THEN (ordinal // 4)::VARCHAR END AS t2, CASE WHEN (ordinal // 4) % 4 = 3 THEN 'a point' END AS r2
  FROM g WHERE NOT EXISTS (SELECT 1 FROM annotations b WHERE b.item_id = g.item_id AND NOT b.spot_check AND (b.created_at > g.created_at OR (b.created_at = g.created_at AND b.ordinal > g.ordinal)))),
patched AS (SELECT d.* REPLACE (coalesce(q2, question) AS question, coalesce(p2, paths) AS paths, coalesce(a2, accessions) AS accessions, coalesce(t2, answer) AS answer, coalesce(r2, rubric) AS rubric) FROM drafts d JOIN pt USING (item_id)),
{_BASE.replace("FROM bundle", "FROM patched")}, {_PATHS},
cs AS (SELECT item_id, named, ta, tb, own AS claims FROM e), {_claims("cs")},
o AS (SELECT item_id, count(*) AS outside FROM (SELECT DISTINCT item_id, unnest(acc) AS a FROM i) WHERE a NOT IN (SELECT accession FROM sn) GROUP BY 1),
j0 AS (SELECT e.*, coalesce(outside, 0) AS outside, coalesce(can.canonical, []) AS canonical, coalesce(can.unknown, []) AS lost, coalesce(structured, false) AS structured, len(list_filter(own, lambda c: trim(c) <> '')) AS n_claims, len(list_distinct(acc)) AS bound,
  regexp_matches(t, {Q.quoted(C.BOTH)}) AS both_say, regexp_matches(t, {Q.quoted(C.BOTH_AND)}) AS both_and, regexp_matches(t, {Q.quoted(C.CROSS)}) AS crossed, len(regexp_extract_all(regexp_replace(lower(t), {Q.quoted(C.TEMPLATE)}, ' ', 'g'), '\\S+')) AS own_words,
  len(list_distinct(regexp_extract_all(t, {Q.quoted(C.PERCENT)}))) >= 2 OR len(list_distinct(regexp_extract_all(t, {Q.quoted(C.DOLLARS)}))) >= 2 AS contrast FROM e LEFT JOIN o USING (item_id) LEFT JOIN can USING (item_id) LEFT JOIN cs_s USING (item_id)),
j AS (SELECT *, list_filter(list_concat([CASE WHEN trim(question) = '' THEN 'empty_question' END, CASE WHEN len(acc) = 0 THEN 'missing_accessions' WHEN outside > 0 THEN 'accession_not_in_snapshot' END, CASE WHEN profile = 'comparison' AND len(acc) < 2 THEN 'requires_multi_filing' END, CASE WHEN len(raw) = 0 THEN 'missing_section_paths' END],
    list_concat(list_transform(list_filter(lost, lambda p: contains(p, '$')), lambda p: 'corrupt_section_path:' || left(p, 80)), list_concat(list_transform(lost, lambda p: 'unknown_section_path:' || p),
    list_append(CASE WHEN t = '' THEN ['missing_answer_gt'] WHEN answer_type IS NULL THEN ['missing_answer_type'] ELSE
      [CASE WHEN answer_type = 'narrative' AND NOT n_claims BETWEEN 2 AND 8 THEN 'required_claims' END, CASE WHEN answer_type = 'comparison' AND NOT (both_say OR (both_and AND crossed)) THEN 'invalid_answer_type' END, CASE WHEN answer_type = 'comparison' AND both_say AND NOT crossed AND own_words < 25 AND NOT contrast THEN 'boilerplate_comparison_answer' END,
       CASE WHEN answer_type = 'comparison' AND bound < 2 THEN 'comparison_bindings' END, CASE WHEN answer_type = 'comparison' AND NOT structured THEN 'required_claims' END] END,
      CASE WHEN is_comparison AND answer_type IS DISTINCT FROM 'comparison' THEN 'invalid_answer_type' END)))), lambda x: x IS NOT NULL) AS errors FROM j0)"""

_LISTED = "array_to_string(list_filter(split(coalesce({c}, ''), ';'), lambda x: x <> ''), chr(30))"
_HASHED = ", ".join(_LISTED.format(c=c) if c in P.LISTS else f"coalesce({c}::VARCHAR, '')" for c in ("accessions", "answer", "answer_type", "claims", "is_comparison", "issuer_id", "item_id", "multi", "n", "paths", "periods", "profile", "question", "rubric", "tag"))


@PLANS.add("q23_override_changelog", f"""
WITH {_PATCHED}
SELECT pt.item_id, annotation, CASE WHEN d.item_id IS NULL THEN '' ELSE sha256(d.hashed) END AS parent_hash, CASE WHEN d.item_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN q2 IS NOT NULL THEN 'question' END, CASE WHEN p2 IS NOT NULL THEN 'expected_section_paths' END, CASE WHEN a2 IS NOT NULL THEN 'expected_bindings' END, CASE WHEN t2 IS NOT NULL OR r2 IS NOT NULL THEN 'ground_truth' END) END AS changed,
  CASE WHEN d.item_id IS NULL OR len(errors) > 0 THEN 'rejected' ELSE 'accepted' END AS outcome, CASE WHEN d.item_id IS NULL THEN 'item_not_found' ELSE array_to_string(errors, ',') END AS errors
FROM pt LEFT JOIN (SELECT item_id, concat_ws(chr(31), {_HASHED}) AS hashed FROM drafts) d ON d.item_id = pt.item_id LEFT JOIN j ON j.item_id = pt.item_id""", ("drafts", "filings", "annotations"))
def changelog(f: Frames) -> DataFrame:
    f = settled(f)
    log, _ = P.override_items(_drafts(f), _patches(f), R.clean_index(_index(f)), _snapshot(f))
    return log.withColumns({c: F.array_join(c, ",") for c in ("changed", "errors")})


@PLANS.add("q23_overridden_items", f"""
WITH {_PATCHED}, ok AS (SELECT * FROM j WHERE len(errors) = 0)
SELECT d.item_id, CASE WHEN ok.item_id IS NULL THEN d.question ELSE ok.question END AS question, CASE WHEN ok.item_id IS NULL THEN d.answer ELSE ok.answer END AS answer, CASE WHEN ok.item_id IS NULL THEN d.rubric ELSE ok.rubric END AS rubric,
  CASE WHEN ok.item_id IS NULL THEN array_to_string(list_filter(split(d.paths, ';'), lambda x: x <> ''), '|') ELSE array_to_string(ok.canonical, '|') END AS paths FROM drafts d LEFT JOIN ok USING (item_id)""", ("drafts", "filings", "annotations"))
def overridden(f: Frames) -> DataFrame:
    f = settled(f)
    _, items = P.override_items(_drafts(f), _patches(f), R.clean_index(_index(f)), _snapshot(f))
    return items.select("item_id", "question", "answer", "rubric", F.array_join("paths", "|").alias("paths"))
