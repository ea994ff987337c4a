"""Operators on evidence and sections of many questions at once: scores, fact catalogs, path choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intents as I
from ..functions import scalars as S
from ..functions.lineage import written
from .ranking import GEOPOLITICAL, HIGHLIGHT_NOISE, topic_score

# Words, patterns and points of the chunk score.
SALE_WORDS, SALE_EVIDENCE = ("divest", "divestment", "proceeds", "sold as part", "business sales"), ("divest", "singapore", "mobil argentina", "proceeds", "1.1 billion")
SALE_PARTS = ("divest", "singapore", "mobil argentina", "proceeds")
MDA_WORDS = ("md&a", "mda", "management discussion", "management's discussion")
FINANCIAL = r"(?i)\b(revenue|sales|income|earnings|profit|assets|liabilities|cash|eps|margin|debt|dividend|shares|cost|expense|growth|yoy|qoq|billion|million)\b"
RISK = r"(?i)\b(risk|factor|factors|1a)\b"
CROSS_REFERENCE = r"item\s+1a\s+of\s+this\s+form\s+10-?k\s+under\s+the\s+heading"
OFF_TOPIC = (
    r"(operating\s+expenses\s+for\s+[0-9]{4}|share-based\s+compensation\s+expense|item\s+2\.\s+properties|basis\s+for\s+opinion|identified\s+item|"
    r"interest\s+rate\s+derivative|fiscal\s+quarter\s+interest\s+expense|net\s+gain\s*\(loss\)\s+from\s+interest\s+rate)"
)
EXPENSES = r"\b(currency|income/expense|interest expense)\b"
MATERIAL_RISK = r"(?s)item\s+1a\.?\s+risk\s+factors.*material\s+adverse"
SEGMENT_QUESTION = ("segment", "business unit", "sector", "grooming", "braun", "product category", "reportable")
SEGMENT_EVIDENCE = ("business", "segment", "product", "grooming")
TOPIC_QUESTION = ("risk", "geopolitic", "international", "trade policy", "tariff")


def _points(*rules: tuple[Column, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), p).otherwise(0.0) for c, p in rules])


def _relevance(q: Column, excerpt: Column, label: Column) -> Column:
    """A quarter for each word of the question in the excerpt or label, 5 for a concept that it asks for."""
    text = F.lower(F.concat_ws(" ", excerpt, label))
    words = F.array_distinct(F.filter(F.regexp_extract_all(q, F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) > 2))
    hint = F.when(F.lit(False), F.lit(False))
    for word, pattern in S.CONCEPT_HINTS:
        hint = hint.when(q.contains(word), excerpt.rlike("(?i)" + pattern))
    return 0.25 * F.size(F.filter(words, lambda w: F.contains(text, w))) + _points(
        (hint, 5.0), (excerpt.rlike(r"\$[0-9,.]+ (billion|million)"), 1.0), (label.startswith("table-") & ~excerpt.contains("value:"), -1.0)
    )


def _qualitative(q: Column, e: Column) -> Column:
    full, part = I.has(q, MDA_WORDS) & I.has(e, ("management", "md&a", "discussion", "analysis", "liquidity")), I.has(q, ("management", "liquidity", "outlook")) & I.has(e, ("management", "md&a", "discussion", "liquidity"))
    return _points((q.contains("risk") & e.contains("risk"), 10.0), (full, 10.0), (part & ~full, 6.0), (I.has(q, SALE_WORDS) & I.has(e, SALE_EVIDENCE), 15.0))


def _risk(question: Column, excerpt: Column, section: Column) -> Column:
    e, s, flags = F.lower(excerpt), F.lower(section), S.query_flags(question)
    sold, sale = flags["is_divestiture"], I.has(e, SALE_PARTS)
    in_risk, in_mda = s.contains("risk_factors"), s.contains("md_and_a")
    world = excerpt.rlike(GEOPOLITICAL)
    return _points(
        (in_risk, 4.0), (in_mda, 6.0), (flags["is_mda"] & in_risk & ~in_mda, -8.0), (e.rlike(CROSS_REFERENCE) & (F.length(excerpt) < 2500), -12.0),
        (e.rlike(OFF_TOPIC), -15.0), (excerpt.rlike(HIGHLIGHT_NOISE), -18.0), (e.rlike(EXPENSES) & ~world, -12.0), (sold & in_mda, 14.0), (sold & sale, 16.0),
        (sold & s.contains("business_description") & ~sale, -12.0), (question.rlike(GEOPOLITICAL) & world, 12.0), (e.rlike(MATERIAL_RISK), 10.0),
    )


def score_chunks(pairs: DataFrame, alignment: Column | None = None) -> DataFrame:
    """Add ``score`` to pairs of a question and a chunk.

    pairs: question, excerpt, label, source (xbrl, html), is_fact, section_id, bias (xbrl_primary,
    html_primary, blended) and qualitative (whether the question is of that kind only). alignment:
    points for a fact's period, none by default. Nulls in texts count as empty.
    """
    question, excerpt, label, section = (F.coalesce(F.col(c), F.lit("")) for c in ("question", "excerpt", "label", "section_id"))
    q, e = F.lower(question), F.lower(excerpt)
    fact, html, only = F.col("is_fact"), F.col("source") == "html", F.col("qualitative")
    asks_revenue, concept = I.has(q, ("revenue", "sales")), F.when(label != "", label).otherwise(excerpt)
    topic = topic_score(question, excerpt, section)
    score = _relevance(q, excerpt, label) + F.when(html, _qualitative(q, e)).otherwise(0.0) + F.when(fact, 2.0 + (F.lit(0.0) if alignment is None else alignment)).otherwise(0.0)
    score = score + _points(
        (fact & question.rlike(FINANCIAL), 3.0), (fact & asks_revenue & concept.rlike("(?i)" + S.REVENUE_CONCEPTS), 20.0), (fact & asks_revenue & concept.rlike("(?i)" + S.SECURITIES_SALES), -15.0),
        (only & html, 5.0), (only & html & section.contains("risk_factors"), 8.0), (only & html & (F.length(excerpt) > 3000), 3.0),
    )
    score = score + F.when(only & question.rlike(RISK), _risk(question, excerpt, section) + topic).otherwise(0.0)
    score = score + F.when(only & S.query_flags(question)["is_comparison"], 1.5 * topic).otherwise(0.0)
    favoured = F.when(F.col("bias") == "xbrl_primary", F.col("source") == "xbrl").when(F.col("bias") == "html_primary", html)
    return pairs.withColumn("score", score * F.when(favoured.isNull(), 1.0).when(favoured, 1.5).otherwise(0.7))


def compact_evidence(evidence: DataFrame, most: int, chars: int) -> DataFrame:
    """(query_id, position, chunk_id, excerpt): at most ``most`` chunks a question, cut to ``chars``.

    evidence: query_id, question, intent, accession, chunk_id, source, section_id, excerpt, label and
    ordinal (the order it came in). Comparisons of two or more filings take the longest of each
    filing first, risk questions the best by topic; qualitative questions then keep HTML of the kind
    that they ask about, or all HTML if there is none of it, longest first; revenue questions put
    revenue facts first.
    """
    q, e, s = F.lower("question"), F.lower("excerpt"), F.lower(F.coalesce("section_id", F.lit("")))
    per, flags = Window.partitionBy("query_id"), S.query_flags(F.col("question"))
    mda = I.has(q, ("divest", "md&a", "management's discussion", "management discussion")) | flags["is_mda"]
    asked = (
        F.when(I.has(q, SEGMENT_QUESTION) & ~flags["is_mda"], I.has(e, SEGMENT_EVIDENCE) | I.has(s, SEGMENT_EVIDENCE))
        .when(q.contains("risk") & ~flags["is_mda"], e.contains("risk") | s.contains("risk"))
        .when(mda, I.has(s, ("md_and_a", "mda", "management")) | e.contains("divest")).otherwise(True)
    )
    worded = (F.col("intent") == "qualitative") & (F.col("source") == "html")
    revenue = F.col("excerpt").rlike("(?i)" + S.REVENUE_CONCEPTS) | F.coalesce(F.col("label"), F.lit("")).rlike("(?i)" + S.REVENUE_CONCEPTS)
    figures = (F.col("intent") != "qualitative") & I.has(q, ("revenue", "sales"))
    # What is judged by the text is a few numbers a row; texts are joined again to the rows that stay.
    rows = evidence.select(
        "query_id", "accession", "chunk_id", "ordinal", F.xxhash64("excerpt").alias("_text"), F.length("excerpt").alias("_long"), flags["is_comparison"].alias("_compares"), I.has(q, TOPIC_QUESTION).alias("_topical"),
        topic_score(F.col("question"), F.col("excerpt"), F.coalesce("section_id", F.lit(""))).alias("_topic"), F.when(worded & asked, 2).when(worded, 1).otherwise(0).alias("_kind"), F.when(figures, F.when(revenue, 0).otherwise(1)).alias("_figure"),
    )
    rows = written(rows, "judged")
    balanced = F.col("_compares") & (F.col("_n") >= 2)
    with_one = lambda table, one: table.join(written(one.withColumnRenamed("query_id", "_q"), "per-query"), F.col("query_id").eqNullSafe(F.col("_q"))).drop("_q")
    rows = with_one(rows, rows.groupBy("query_id").agg(F.count_distinct("accession").alias("_n"))).withColumn("_balanced", F.coalesce(balanced, F.lit(False)))
    longest = F.row_number().over(Window.partitionBy("query_id", "accession").orderBy(F.desc("_long"), "ordinal", "chunk_id"))
    first = F.col("_l") <= F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("_n")))
    dealt = rows.where("_balanced").withColumn("_l", longest).withColumn("_first", first).withColumns({"_of": F.when(F.col("_first"), F.col("accession")), "_l": F.when(F.col("_first"), F.col("_l"))})
    none = {"_l": F.lit(None).cast("int"), "_first": F.lit(True), "_of": F.lit(None).cast("string")}
    some = dealt.unionByName(rows.where("NOT _balanced AND coalesce(_topical, true)").withColumns(none))
    order = [F.desc("_first"), "_of", "_l", F.when(~F.col("_balanced") & F.col("_topical"), -F.col("_topic")), "ordinal", "chunk_id"]
    at = F.row_number().over(per.orderBy(*order))
    chosen = some.withColumn("_at", at).where(F.col("_at") <= most).drop(*none)
    # Of other questions all rows stay, in their own order, so that none of them has to be numbered.
    rest = rows.where("NOT _balanced AND NOT coalesce(_topical, true)").withColumn("_at", F.lit(0))
    rows = chosen.unionByName(rest)
    rows = with_one(rows, rows.groupBy("query_id").agg(F.max("_kind").alias("_best"))).where(F.col("_kind") == F.col("_best"))
    last = [F.when(F.col("_best") > 0, -F.col("_long")), "_figure", "_at", "ordinal", "chunk_id"]
    rows = rows.withColumn("position", F.row_number().over(per.orderBy(*last))).where(F.col("position") <= most)
    rows = written(rows.select("query_id", "chunk_id", "ordinal", "_text", "position"), "compacted")
    on = ["query_id", "chunk_id", "ordinal", "_text"]
    texts = evidence.withColumn("_text", F.xxhash64("excerpt")).select(*on, "excerpt")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on]
    rows = texts.alias("t").join(rows.alias("r"), reduce(lambda a, b: a & b, same)).select("r.query_id", "r.position", "r.chunk_id", "t.excerpt")
    rows = rows.groupBy("query_id", "position").agg(F.first("chunk_id").alias("chunk_id"), F.first("excerpt").alias("excerpt"))
    t = F.trim("excerpt")
    cut = F.when(F.length(t) > chars, F.concat(F.rtrim(F.left(t, F.lit(chars - 3))), F.lit("..."))).otherwise(t)
    return rows.select("query_id", "position", "chunk_id", cut.alias("excerpt"))


def fact_catalog(evidence: DataFrame) -> DataFrame:
    """Facts that may answer each question: (query_id, chunk_id, concept, value_display, period_start,
    period_end, is_annual, concept_family, segment, matches_query).

    evidence: query_id, question, target_year, form (both may be null), chunk_id, excerpt. A fact must
    pass the guard of the question's concept family, or match the question where it has none, and
    fit the period asked for. Segment questions take facts of the segment that they name; where no
    fact is left, all that pass guard and period come back.
    """
    q = F.coalesce(F.col("question"), F.lit(""))
    rows = evidence.withColumns({"_f": S.parse_fact_excerpt(F.col("excerpt")), "segment": S.segment_hint(F.col("excerpt")), "_family": S.query_concept_family(q, S.metric_type(q)), "_asked": segment_of_query(q)})
    rows = rows.select("*", "_f.concept", "_f.value_display", "_f.period_start", "_f.period_end", "_f.is_annual").where("concept <> ''")
    start, end = (F.nullif(c, F.lit("")).try_cast("date") for c in (F.col("period_start"), F.col("period_end")))
    matches = S.concept_matches_query(F.col("concept"), q)
    segment = F.col("segment").isNotNull()
    guard = S.concept_passes_guard(F.col("concept"), F.col("_family"), segment)
    fits = F.when(F.col("_family").isNotNull(), guard).otherwise(matches | segment) & S.period_matches_intent(start, end, F.col("is_annual"), F.col("target_year"), F.col("form"))
    year = (F.col("form") == "10-K") & F.col("target_year").isNotNull() & ~F.col("is_annual") & (F.col("period_end") != "") & (F.left("period_end", F.lit(4)) != F.col("target_year").cast("string"))
    named = F.col("_asked").isNotNull()
    of_segment = F.when(F.col("_family") == "segment_revenue", F.when(named, segment & F.contains(F.lower("segment"), F.lower("_asked"))).otherwise(segment)).otherwise(True)
    rows = rows.where(F.coalesce(fits, F.lit(False))).withColumns({"matches_query": matches, "_full": F.coalesce(~F.coalesce(year, F.lit(False)) & of_segment, F.lit(False)), "concept_family": S.concept_family(F.col("concept"))})
    some = F.max(F.col("_full").cast("int")).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("_some", some).where(F.col("_full") | ((F.col("_some") == 0) & F.col("_family").isNotNull()))
    return rows.select("query_id", "chunk_id", "concept", "value_display", "period_start", "period_end", "is_annual", "concept_family", "segment", "matches_query")


def segment_of_query(question: Column) -> Column:
    """The segment that a question names: a known one, else the words before "segment"; null if none."""
    return F.coalesce(S.segment_hint(question), F.nullif(F.trim(F.regexp_extract(question, r"(?i)([A-Za-z0-9_\s&]+)\s+segment", 1)), F.lit("")))


def rank_by_role(catalog: DataFrame, most: int) -> DataFrame:
    """The first ``most`` facts for each (query_id, role): catalog has query_id, role, chunk_id, roles
    (array), is_annual, matches_query and period_end (text). Adds score and position."""
    hit = F.when(F.array_contains("roles", F.col("role")), 10).otherwise(0)
    pretax = F.when((F.col("role") == "net_income") & F.array_contains("roles", "pretax_income"), 6).otherwise(0)
    total = F.when(F.col("role").isin("margin_denominator", "total_revenue", "revenue") & F.array_contains("roles", "total_revenue"), 2).otherwise(0)
    score = hit - pretax + total + F.when(F.col("is_annual"), 3).otherwise(0) + F.when(F.col("matches_query"), 2).otherwise(0)
    w = Window.partitionBy("query_id", "role").orderBy(F.desc("score"), F.desc("is_annual"), F.desc(F.length("period_end")), "chunk_id")
    return catalog.withColumn("score", score).withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


def best_fact(evidence: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): the best fact of each question (query_id, question, target_year,
    chunk_id, excerpt) by year, annual period, concept and segment; none at 0 points or fewer."""
    q = F.lower("question")
    rows = evidence.where(I.has(q, ("revenue", "sales", "equity", "proceeds", "billion", "million")) & ~S.query_flags(F.col("question"))["is_divestiture"])
    rows = rows.withColumn("_f", S.parse_fact_excerpt(F.col("excerpt"))).where((F.col("_f.concept") != "") & F.col("_f.value_display").rlike(r"(?i)^\$[0-9,.]+ (billion|million|trillion)"))
    concept, annual, target = F.col("_f.concept"), F.col("_f.is_annual"), F.col("target_year")
    year = F.nullif(F.left("_f.period_end", F.lit(4)), F.lit("")).try_cast("int")
    energy = q.contains("energy product") & I.has(q, ("revenue", "sales", "operating"))
    answers = (
        F.when(I.has(q, ("shareholder equity", "stockholders equity", "total equity")), concept.rlike("(?i)StockholdersEquity(?!Other)"))
        .when(energy, concept.rlike("(?i)Revenue")).otherwise(S.concept_matches_query(concept, F.col("question")))
    )
    score = _points(
        (year == target, 10.0), (annual, 8.0), (~annual & target.isNotNull(), -6.0), (answers, 15.0), (concept.contains("Other") & q.contains("equity"), -12.0),
        (q.contains("energy product") & F.lower("excerpt").contains("energy product"), 20.0),
    )
    rows = rows.where(target.isNull() | year.isNull() | (year == target)).withColumn("score", score).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("query_id", "chunk_id", "score")


def resolve_section_nodes(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, node_id, score): the section or document nodes that a path names, all of the best score.

    paths: path ("accession/tail"). nodes: node_id, accession, label, section_path. A path meets the
    nodes of its own accession; the node whose id or section_path it is counts 200, another 100
    for the accession and by its label: 20 equal, 15 of the same item, 12 containing the tail, else 5.
    Keys are made once a path and once a node, before these meet.
    """
    p = paths.select("path").distinct().withColumn("_s", S.split_section_path(F.col("path"))).select("path", F.col("_s.accession").alias("accession"), F.col("_s.tail").alias("_tail"))
    p = p.withColumn("_key", S.section_key(F.col("_tail"))).withColumn("_item", S.item_key(F.col("_key")))
    items = [S.item_key(S.section_key(F.coalesce(c, F.lit("")))) for c in ("label", "section_path")]
    n = nodes.withColumns({"_label": S.section_key(F.coalesce("label", F.lit(""))), "_items": F.filter(F.array(*items), lambda x: x.isNotNull())})
    rows = p.join(n.withColumnRenamed("node_id", "_node").hint("merge"), "accession")
    key, label, item, items = (F.col(c) for c in ("_key", "_label", "_item", "_items"))
    holds = (F.col("_tail") != "") & F.contains("label", "_tail")
    alike = (key != "") & (label != "") & (F.startswith(key, label) | F.startswith(label, key))
    same = F.coalesce(F.array_contains(items, item), F.lit(False))
    near = F.exists(items, lambda x: F.startswith(x, item) | F.startswith(item, x))
    exact = (F.col("_node") == F.col("path")) | F.coalesce(F.col("section_path") == F.col("path"), F.lit(False))
    score = F.when(exact, 200).otherwise(100 + F.when((key != "") & (key == label), 20).when(same, 15).when(holds, 12).otherwise(5))
    rows = rows.where(F.coalesce(holds, F.lit(False)) | F.coalesce(alike, F.lit(False)) | same | F.coalesce(near, F.lit(False)) | exact)
    best = F.rank().over(Window.partitionBy("path").orderBy(F.desc("score")))
    return rows.withColumn("score", score).withColumn("_r", best).where("_r = 1").select("path", F.col("_node").alias("node_id"), "score").distinct()


def pick_section_paths(items: DataFrame, index: DataFrame) -> DataFrame:
    """(item_id, accession, path, score): the best path of the index for each bound accession of items
    (item_id, accession, question, answer, truth); none at 0 points or fewer.

    index: accession, path. Names that look like pieces of an answer don't count; ties go to the least
    path. What an item asks for is worked out once, before it meets the paths."""
    sale = I.divestiture_flags(F.col("question"), F.col("answer"), F.col("truth"))
    wanted = items.select("item_id", "accession", I.section_hints(F.col("question"), F.col("answer"), F.col("truth")).alias("_hints"), sale.alias("_sale"))
    known = index.withColumn("_tail", S.split_section_path(F.col("path"))["tail"]).where(~S.is_corrupt_tail(F.col("_tail"))).distinct()
    rows = wanted.join(known.hint("merge"), "accession").withColumn("score", I.path_score(F.col("_tail"), F.col("_hints"), F.col("_sale"))).where("score > 0")
    w = Window.partitionBy("item_id", "accession").orderBy(F.desc("score"), "path")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("item_id", "accession", "path", "score")


def variant_comparison(metrics: DataFrame, baseline: str, names: list[str]) -> DataFrame:
    """(variant_id, metric, value, baseline, change): every other variant's value less the baseline's."""
    long = metrics.select("variant_id", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("variant_id", "m.*")
    # One row for each of the given metrics.
    base = long.where(F.col("variant_id") == baseline).select("metric", F.col("value").alias("baseline"))
    return long.where(F.col("variant_id") != baseline).join(base.hint("merge"), "metric").withColumn("change", F.col("value") - F.col("baseline"))


def concept_pairs(questions: DataFrame, concepts: DataFrame) -> DataFrame:
    """(query_id, concept): the concepts that answer each question (query_id, question).

    A question asks for the concepts of one hint word, and of revenue if it has a word for that; a
    concept answers the hints whose pattern it fits. So both sides have few keys each and meet by
    equality; no question meets a concept that doesn't answer it. Repeats count once."""
    q, c = F.lower("question"), F.col("concept")
    hint = reduce(lambda a, w: a.when(q.contains(w[0]), w[0]), S.CONCEPT_HINTS, F.when(F.lit(False), ""))
    keys = F.array_compact(F.array(hint, F.when(I.has(q, ("revenue", "sales")), "revenue concepts")))
    answered = F.array_compact(F.array(*[F.when(c.rlike("(?i)" + p), w) for w, p in S.CONCEPT_HINTS], F.when(c.rlike("(?i)" + S.REVENUE_CONCEPTS), "revenue concepts")))
    known = concepts.select("concept").distinct().where((c != "") & ~c.rlike("(?i)" + S.SECURITIES_SALES))
    left = questions.select("query_id", F.explode(keys).alias("_key"))
    return left.join(known.select("concept", F.explode(answered).alias("_key")).hint("merge"), "_key").select("query_id", "concept").distinct()
