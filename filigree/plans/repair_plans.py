"""Queries over the repair of benchmark items, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import claims as K
from ..functions import comparison as C
from ..functions import intents as I
from ..functions.lineage import written
from ..operators import repair as R
from ..sources.views import Frames
from . import rules_sql as Q
from .plan import Plans

PLANS = Plans()

#: Sections of annual and of quarterly reports; one is a piece of an answer.
_ANNUAL = ("Item 1. Business", "Item 1A. Risk Factors", "Item 7. Management Discussion", "XBRL Financial Facts", "net sales of $4 billion")
_QUARTERLY = ("Item 2. Management Discussion", "XBRL Financial Facts", "Item 1A. Risk Factors")


def settled(f: Frames) -> Frames:
    """Frames whose filings, an aggregate of orders, and the recent ones among them are written once: items, index
    and snapshot are made of both. What only facts need of a filing is left out."""
    filings = written(f["filings"].drop("cik", "cents"), "filings")
    return f.replaced(filings=filings, recent=written(f.over("recent", filings=filings), "recent"))


def _items(f: Frames) -> DataFrame:
    listed = {c: F.filter(F.split(c, ";"), lambda x: x != "") for c in ("accessions", "paths", "claims")}
    return f["bundle"].withColumns(listed).withColumn("multi", F.lit(False))


def _index(f: Frames) -> DataFrame:
    names = F.when(F.col("form_type") == "10-K", F.array(*map(F.lit, _ANNUAL))).otherwise(F.array(*map(F.lit, _QUARTERLY)))
    return f["recent"].select("accession", F.explode(names).alias("name")).select("accession", F.concat_ws("/", "accession", "name").alias("path"))


def _snapshot(f: Frames) -> DataFrame:
    more = f["recent"].select(F.concat(F.substring("accession", 1, 10), F.lit("-50-000001")).alias("accession"))
    return f["filings"].select("accession").unionByName(more).distinct()


def _claims(who: str) -> str:
    """CTEs <who>_s: (item_id, structured) of claims (item_id, t, claims) in <who>."""
    refers = "len(list_filter({t}, lambda w: contains(lower(claim), w))) >= least(2, len({t})) AND len({t}) > 0"
    return f"""
{who}_c AS (SELECT item_id, named, ta, tb, trim(unnest(claims)) AS claim FROM {who}),
{who}_m AS (SELECT item_id, named, {refers.format(t="ta")} AS of_a, {refers.format(t="tb")} AS of_b, regexp_matches(claim, {Q.quoted(C.ANCHOR)}) AS dated, len(list_distinct(list_filter(regexp_extract_all(claim, {Q.quoted(C.ANCHOR)}, 1), lambda y: y <> ''))) >= 2 AS years,
  (regexp_matches(claim, '(?i)\\bboth\\b') AND regexp_matches(claim, {Q.quoted(C.PEERS)})) OR regexp_matches(claim, {Q.quoted(C.CROSS)}) AS words FROM {who}_c WHERE claim <> ''),
{who}_x AS (SELECT *, years OR words OR (named AND of_a AND of_b) AS crossing FROM {who}_m),
{who}_s AS (SELECT item_id, count(*) BETWEEN 3 AND 8 AND count(*) FILTER (crossing) > 0 AND 2 <= CASE WHEN any_value(named) THEN bool_or(NOT crossing AND of_a AND NOT of_b)::INT + bool_or(NOT crossing AND of_b AND NOT of_a)::INT ELSE least(2, count(*) FILTER (dated)) END AS structured FROM {who}_x GROUP BY 1)"""


_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({e}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(map(Q.quoted, C.ENTITY_STOP)) + "], w)))"
_NAMED = "CASE " + " ".join(f"WHEN regexp_matches(t, {Q.quoted(p)}) THEN regexp_replace(trim(regexp_extract(t, {Q.quoted(p)}, @g)), chr(39) || 's$', '')" for p in C.NAMED) + " END"
_SENTENCE_WORDS = "['is', 'are', 'was', 'were', 'the', 'and', 'that', 'discuss']"

#: Items with lists; t: the trimmed answer, own: its claims.
_BASE = f"""
i AS (SELECT *, list_filter(split(accessions, ';'), lambda x: x <> '') AS acc, list_filter(split(paths, ';'), lambda x: x <> '') AS raw, list_filter(split(coalesce(claims, ''), ';'), lambda x: x <> '') AS own, trim(coalesce(answer, '')) AS t FROM bundle),
n AS (SELECT *, regexp_matches(t, {Q.quoted(K.NUMERIC)}) AS is_number, {_NAMED.replace('@g', '1')} AS a, {_NAMED.replace('@g', '2')} AS b FROM i),
e AS (SELECT *, coalesce(a <> '' AND b <> '', false) AS named, coalesce({_TOKENS.format(e="a")}, []) AS ta, coalesce({_TOKENS.format(e="b")}, []) AS tb, string_split_regex(t, '\\s+') AS words FROM n)"""

#: Numbers, by the scale words that occur, and types and claims of items with an answer.
_NORMAL = f"""
num AS (SELECT *, CASE WHEN NOT is_number THEN answer ELSE (SELECT CASE WHEN v = floor(v) OR v >= 1e6 THEN v::BIGINT::VARCHAR ELSE rtrim(rtrim(v::DECIMAL(18, 6)::VARCHAR, '0'), '.') END FROM (SELECT try_cast(regexp_extract(replace(t, ',', ''), '([0-9.]+)', 1) AS DOUBLE) * CASE WHEN contains(t, 'billion') THEN 1e9 WHEN contains(t, 'mm') THEN 1e6 ELSE 1 END AS v)) END AS number FROM e),
ty AS (SELECT *, list_filter(list_transform(words, lambda w: lower(w)), lambda w: list_contains({_SENTENCE_WORDS}, w)) AS sentence,
  list_filter(list_transform(words, lambda w: lower(w)), lambda w: list_contains(['is', 'are', 'was', 'were', 'has', 'have', 'had', 'the', 'and', 'that'], w)) AS verbs, coalesce(trim(number), '') AS nt FROM num),
kind AS (SELECT *, CASE WHEN t <> '' AND (answer_type IS NULL OR (answer_type = 'narrative' AND profile = 'numeric' AND (is_number OR (len(words) <= 4 AND len(verbs) = 0)))) THEN
    CASE WHEN (profile = 'comparison' OR is_comparison) AND len(acc) >= 2 THEN 'comparison' WHEN is_number THEN 'numeric' WHEN len(words) <= 4 AND len(sentence) = 0 THEN 'short_label' WHEN profile = 'numeric' THEN 'short_label' ELSE 'narrative' END
  ELSE answer_type END AS kind FROM ty),
c1 AS (SELECT item_id, named, ta, tb, own AS claims FROM kind), {_claims("c1")},
c2 AS (SELECT item_id, named, ta, tb, CASE WHEN nt = '' OR list_contains(own, nt) THEN own ELSE list_append(own, nt) END AS claims FROM kind), {_claims("c2")},
parts AS (SELECT kind.*, coalesce(c1_s.structured, false) AS fit1, coalesce(c2_s.structured, false) AS fit2, c2.claims AS more,
  list_filter(list_transform(string_split_regex(nt, '[.;]\\s+'), lambda s: trim(s)), lambda s: length(s) > 15) AS sentences,
  list_filter(list_transform(range(0, ((length(nt) + 119) // 120)::BIGINT), lambda x: trim(substr(nt, x * 120 + 1, 120))), lambda p: p <> '') AS pieces, string_split_regex(nt, '\\s+') AS nw,
  CASE WHEN kind.named THEN a ELSE 'FY2025 10-K' END AS la, CASE WHEN kind.named THEN b ELSE 'FY2024 10-K' END AS lb,
  coalesce(nullif(left(regexp_replace(trim(regexp_replace(trim(question), '\\?$', '')), {Q.quoted(K.ASKING)}, ''), 80), ''), 'the topic in the question') AS topic FROM kind JOIN c2 USING (item_id) LEFT JOIN c1_s USING (item_id) LEFT JOIN c2_s USING (item_id)),
made AS (SELECT *, CASE WHEN nt = '' THEN own WHEN kind IN ('numeric', 'short_label') THEN [] WHEN kind = 'comparison' THEN
    CASE WHEN fit1 THEN own WHEN fit2 THEN more ELSE [la || ' discusses ' || topic || ' in Item 7 MD&A.', lb || ' discusses ' || topic || ' in Item 7 MD&A.', CASE WHEN regexp_matches(nt, {Q.quoted(C.BOTH)}) THEN nt ELSE 'Both ' || la || ' and ' || lb || ' compare how ' || topic || ' is addressed in Item 7 MD&A.' END] END
  WHEN len(own) >= 2 THEN own WHEN len(sentences) >= 2 THEN sentences WHEN len(pieces) >= 2 THEN pieces
  WHEN len(nw) >= 4 THEN [array_to_string(nw[1:len(nw) // 2], ' '), array_to_string(nw[len(nw) // 2 + 1:], ' ')] ELSE [nt, nt] END AS new_claims FROM parts)"""


@PLANS.add("b38_normalize_item", f"WITH {_BASE}, {_NORMAL} SELECT item_id, number AS answer, kind AS answer_type, array_to_string(new_claims, '|') AS claims FROM made", ("bundle",))
def normal(f: Frames) -> DataFrame:
    number = F.when(K.is_number(F.col("answer")), K.canonical_number(F.col("answer"))).otherwise(F.col("answer"))
    rows = R.normalized(_items(f).withColumn("answer", number))
    return rows.select("item_id", "answer", "answer_type", F.coalesce(F.array_join("claims", "|"), F.lit("")).alias("claims"))


_KEY, _ITEM = "regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')", "nullif(regexp_extract({x}, '(item[0-9]+[a-z]?)', 1), '')"
_MISPLACED = (
    f"CASE WHEN sold THEN len(list_filter(raw, lambda p: NOT ((contains(lower(p), 'item 1') AND contains(lower(p), 'business')) OR contains(lower(p), 'xbrl')))) = 0 ELSE false END "
    f"OR (profile = 'comparison' AND {Q.has('q', *R.SECTION_WORDS)} AND len(list_filter(raw, lambda p: NOT (contains(lower(p), '1a') OR contains(lower(p), 'risk')))) = 0)"
)
_PATHS = f"""
ix AS (SELECT accession AS ia, accession || '/' || name AS path, name, {_KEY.format(x="name")} AS gk FROM recent CROSS JOIN (VALUES {', '.join(f"('10-K', {Q.quoted(x)})" for x in _ANNUAL)}, {', '.join(f"('10-Q', {Q.quoted(x)})" for x in _QUARTERLY)}) AS v(form, name) WHERE form_type = form AND NOT contains(name, '$')),
sn AS (SELECT accession FROM filings UNION SELECT substr(accession, 1, 10) || '-50-000001' FROM recent),
w AS (SELECT DISTINCT unnest(raw) AS p FROM i),
v AS (SELECT p, CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) ELSE '' END AS pa, {_KEY.format(x="CASE WHEN contains(p, '/') THEN split_part(p, '/', 2) ELSE p END")} AS k FROM w),
u AS (SELECT *, {_ITEM.format(x="k")} AS item, pa IN (SELECT accession FROM sn) AS inside FROM v),
cand AS (SELECT p, path, 1000000 AS score FROM u JOIN ix ON path = p
  UNION ALL SELECT p, path, CASE WHEN ia = pa THEN 4 ELSE 0 END + CASE WHEN k = gk THEN 3 WHEN item = {_ITEM.format(x="gk")} THEN 2 ELSE 0 END + least(length(k), length(gk)) FROM u JOIN ix ON substr(ia, 1, 10) = substr(pa, 1, 10) AND (ia = pa OR inside)
    WHERE coalesce(item = {_ITEM.format(x="gk")}, false) OR k = gk OR starts_with(k, gk) OR starts_with(gk, k)
  UNION ALL SELECT p, path, CASE WHEN k = gk THEN 3 WHEN item = {_ITEM.format(x="gk")} THEN 2 ELSE 0 END + least(length(k), length(gk)) FROM u JOIN ix ON pa = '' AND ia IN (SELECT accession FROM sn) AND (k = gk OR coalesce(item = {_ITEM.format(x="gk")}, false) OR starts_with(k, gk) OR starts_with(gk, k))),
res AS (SELECT p, path FROM cand QUALIFY row_number() OVER (PARTITION BY p ORDER BY score DESC, path) = 1),
ord AS (SELECT item_id, unnest(raw) AS p, generate_subscripts(raw, 1) AS o FROM i),
can AS (SELECT item_id, list(path ORDER BY o) FILTER (path IS NOT NULL) AS canonical, list(ord.p ORDER BY o) FILTER (path IS NULL) AS unknown FROM ord LEFT JOIN res ON res.p = ord.p GROUP BY 1),
q0 AS (SELECT i.*, coalesce(canonical, []) AS canonical, coalesce(unknown, []) AS unknown, lower(question) AS q, lower(question || ' ' || coalesce(answer, '') || ' ' || array_to_string(own, ' ')) AS every, len(list_filter(raw, lambda p: contains(p, '$'))) > 0 AS corrupt FROM i LEFT JOIN can USING (item_id)),
q1 AS (SELECT *, {Q.has("every", *I.DIVESTITURE_TERMS)} AS sold FROM q0),
q2 AS (SELECT *, sold AND contains(q, 'q2') AS quarterly, len(raw) > 0 AND (corrupt OR {_MISPLACED}) AS misplaced FROM q1),
q3 AS (SELECT *, {Q.hints("q", "every", "sold", "quarterly")} AS found, list_filter([CASE WHEN corrupt THEN 'corrupt' END, CASE WHEN len(unknown) > 0 THEN 'unresolved' END, CASE WHEN len(canonical) = 0 THEN 'none_known' END, CASE WHEN misplaced THEN 'misplaced' END], lambda x: x IS NOT NULL) AS reasons FROM q2),
q4 AS (SELECT *, CASE WHEN len(found) > 0 THEN found WHEN contains(q, 'compar') THEN ['item 7', 'management', 'mda'] ELSE ['item 7', 'management'] END AS hints, len(reasons) = 0 AND canonical = raw AS kept FROM q3),
au AS (SELECT item_id, unnest(acc) AS a, generate_subscripts(acc, 1) AS o FROM q4 WHERE NOT kept),
sc AS (SELECT au.item_id, au.o, path, 3 * len(list_filter(hints, lambda x: contains(lower(name), x))) + CASE WHEN contains(lower(name), 'xbrl') AND list_has_any(hints, ['xbrl', 'financial facts']) THEN 5 ELSE 0 END + CASE WHEN gk LIKE 'item%' THEN 2 ELSE 0 END
    + CASE WHEN sold THEN CASE WHEN contains(lower(name), 'item 1') AND contains(lower(name), 'business') THEN -25 ELSE 0 END + CASE WHEN contains(lower(name), 'xbrl') THEN -20 ELSE 0 END + CASE WHEN {Q.has("lower(name)", "management", "discussion", "item 2", "item 7")} THEN 8 ELSE 0 END ELSE 0 END AS score
  FROM au JOIN q4 USING (item_id) JOIN ix ON ia = au.a),
bp AS (SELECT item_id, o, path FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id, o ORDER BY score DESC, path) = 1),
pk AS (SELECT item_id, list(path ORDER BY o) AS picked FROM bp GROUP BY 1),
q5 AS (SELECT q4.*, coalesce(picked, canonical) AS best FROM q4 LEFT JOIN pk USING (item_id)),
q6 AS (SELECT *, NOT kept AND len(best) = 0 AS emptied FROM q5),
rp AS (SELECT item_id, reasons, CASE WHEN kept OR emptied THEN raw ELSE best END AS repaired, CASE WHEN kept THEN false WHEN emptied THEN corrupt OR len(unknown) > 0 ELSE best <> raw END AS path_changed, CASE WHEN emptied THEN unknown ELSE [] END AS missing FROM q6)"""


@PLANS.add("q27_repair_paths", f"WITH {_BASE}, {_PATHS} SELECT item_id, array_to_string(repaired, '|') AS paths, path_changed, array_to_string(reasons, ',') AS reasons FROM rp", ("bundle", "filings"))
def paths(f: Frames) -> DataFrame:
    f = settled(f)
    rows = R.repair_paths(_items(f), _index(f), _snapshot(f))
    return rows.select("item_id", F.array_join("repaired", "|").alias("paths"), "path_changed", F.array_join("reasons", ",").alias("reasons"))


@PLANS.add("q27_repair_items", f"""
WITH {_BASE}, {_PATHS}, {_NORMAL},
o AS (SELECT item_id, count(*) AS outside FROM (SELECT DISTINCT item_id, unnest(acc) AS a FROM i) WHERE a NOT IN (SELECT accession FROM sn) GROUP BY 1),
al AS (SELECT made.*, rp.repaired, rp.reasons, rp.path_changed, rp.missing, is_number AND number <> t AS answer_changed, coalesce(outside, 0) AS outside FROM made JOIN rp USING (item_id) LEFT JOIN o USING (item_id)),
c3 AS (SELECT item_id, named, ta, tb, new_claims AS claims FROM made), {_claims("c3")},
er AS (SELECT al.*, path_changed OR answer_changed AS changed, list_filter(list_concat(
    [CASE WHEN trim(question) = '' THEN 'empty_question' END, CASE WHEN len(acc) = 0 THEN 'missing_accessions' WHEN outside > 0 THEN 'accession_not_in_snapshot' END, CASE WHEN profile = 'comparison' AND len(acc) < 2 THEN 'requires_multi_filing' END, CASE WHEN len(repaired) = 0 THEN 'missing_section_paths' END],
    list_concat(list_transform(list_filter(repaired, lambda p: contains(p, '$')), lambda p: 'corrupt_section_path:' || left(p, 80)), list_concat(list_transform(missing, lambda p: 'unknown_section_path:' || p),
    list_append(CASE WHEN nt IS NULL OR nt = '' THEN ['missing_answer_gt'] WHEN kind IS NULL THEN ['missing_answer_type'] ELSE
      [CASE WHEN kind = 'narrative' AND NOT len(new_claims) BETWEEN 2 AND 8 THEN 'required_claims' END, CASE WHEN kind = 'comparison' AND NOT regexp_matches(nt, {Q.quoted(C.BOTH)}) AND NOT (regexp_matches(nt, {Q.quoted(C.BOTH_AND)}) AND regexp_matches(nt, {Q.quoted(C.CROSS)})) THEN 'invalid_answer_type' END,
       CASE WHEN kind = 'comparison' AND len(list_distinct(acc)) < 2 THEN 'comparison_bindings' END, CASE WHEN kind = 'comparison' AND NOT coalesce(structured, false) THEN 'required_claims' END] END,
      CASE WHEN is_comparison AND kind IS DISTINCT FROM 'comparison' THEN 'invalid_answer_type' END)))), lambda x: x IS NOT NULL) AS errors FROM al LEFT JOIN c3_s USING (item_id))
SELECT item_id, array_to_string(CASE WHEN changed THEN list_filter(repaired, lambda p: NOT list_contains(missing, p)) ELSE repaired END, '|') AS paths, number AS answer, CASE WHEN changed THEN kind ELSE answer_type END AS answer_type,
  array_to_string(CASE WHEN changed THEN new_claims ELSE own END, '|') AS claims, path_changed, answer_changed, path_changed AND list_contains(reasons, 'misplaced') AS cohort,
  CASE WHEN changed THEN array_to_string(errors, ',') END AS errors, CASE WHEN changed THEN CASE WHEN len(errors) = 0 THEN 'accepted' ELSE 'rejected' END END AS status FROM er""", ("bundle", "filings"))
def items(f: Frames) -> DataFrame:
    f = settled(f)
    rows = R.repair_items(_items(f), _index(f), _snapshot(f))
    joined = [F.array_join("paths", "|").alias("paths"), F.coalesce(F.array_join("claims", "|"), F.lit("")).alias("claims"), F.array_join("errors", ",").alias("errors")]
    return rows.select("item_id", *joined, "answer", "answer_type", "path_changed", "answer_changed", "cohort", "status")
