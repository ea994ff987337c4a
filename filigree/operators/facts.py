"""Operators on tagged facts: consolidation, ranking, role pairs, computed metrics, series.

A facts table has issuer_id, accession, form_type, fact_id, concept, value_num, period_start and
period_end. Rankings end with fact_id, so that ties have one result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import written


#: Concepts that may be broadcast, some hundred bytes each; more are joined by sorting, where adaptive execution
#: splits the facts of a hot one.
MAX_CONCEPTS = 50_000


def _looked_up(table: DataFrame) -> DataFrame:
    """A table with a row a concept, written, with the hint by which very many facts meet it."""
    table = written(table, "concepts")
    return table.hint("broadcast" if table.limit(MAX_CONCEPTS + 1).count() <= MAX_CONCEPTS else "merge")


def consolidate_facts(rows: DataFrame) -> DataFrame:
    """Key-value rows (doc_id, ordinal, left, right) to one record for each ``value:`` row.

    A value row opens a record, for its own concept or the one before it; period, currency and
    decimals rows belong to the open record, the last of each kind counting; a row without such a
    mark names a concept; dimension rows don't count. Gaps and islands: the concept is the last one
    named, the record a running count of value rows.
    Rows that neither name a concept nor belong to a record are dropped before the shuffle, and what a
    record has is read at its last row, so that rows are sorted once. Rows that lie together by doc_id
    already aren't moved.
    """
    w = Window.partitionBy("_h", "doc_id").orderBy("ordinal")
    before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left, right = F.trim("left"), F.trim("right")
    marks = ("value", "period", "currency", "decimals")
    is_ = {k: F.startswith(right, F.lit(f"{k}:")) for k in (*marks, "dimension")}
    named = F.when((left != "") & ~reduce(Column.__or__, [c for k, c in is_.items() if k != "value"]), left).alias("named")
    # A row has the text of its kind; a value row sets the other kinds to none.
    texts = [F.when(is_["value"], right).alias("value"), *[F.when(is_[k], right).when(is_["value"], "").alias(k) for k in marks[1:]]]
    counts = reduce(Column.__or__, [F.col(c).isNotNull() for c in (*marks[1:], "named")])
    marked = rows.select(F.xxhash64("doc_id").alias("_h"), "doc_id", "ordinal", named, *texts).where(counts)

    def last(c: str) -> Column:
        return F.last(c, ignorenulls=True).over(before)

    state = marked.select("_h", "doc_id", "ordinal", "value", F.count("value").over(before).alias("record"), last("named").alias("concept"), *[last(k).alias(k) for k in marks[1:]], F.lead("value", 1, "").over(w).isNotNull().alias("_end"))
    kept = state.where((F.col("record") > 0) & (F.col("value").isNotNull() | F.col("_end")))
    opened = [F.when(F.col("value").isNotNull(), F.col(c)).otherwise(F.lag(c).over(w)).alias(c) for c in ("concept", "value")]
    ends = kept.select("_h", "doc_id", "record", *opened, *marks[1:], "_end").where("_end AND concept IS NOT NULL")
    return ends.select("doc_id", "record", "concept", *[F.when(F.col(k) != "", F.trim(F.substr(k, F.lit(len(k) + 2)))).alias(k) for k in marks])


def select_facts(facts: DataFrame, prioritised: list[str], most: int = 400) -> DataFrame:
    """The first ``most`` facts of each filing: revenue concepts, then prioritised ones, then the
    rest, by concept and fact_id."""
    rank = F.when(S.concept_family(F.col("concept")) == "revenue", 0).when(F.col("concept").isin(prioritised), 1).otherwise(2)
    w = Window.partitionBy("accession").orderBy("rank", "concept", "fact_id")
    return facts.withColumn("rank", rank).withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


def fact_ids(facts: DataFrame) -> DataFrame:
    """Add node_id: ``doc-xbrl-`` and twelve hex digits of the concept's and period's digest."""
    period = F.concat_ws(" - ", F.col("period_start").cast("string"), F.col("period_end").cast("string"))
    return facts.withColumn("node_id", F.concat(F.lit("doc-xbrl-"), F.left(F.sha2(F.concat_ws("|", "concept", period), 256), F.lit(12))))


def attach_taxonomy(facts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Add label and metric_role from taxonomy (concept, label, metric_role) by the full concept name,
    else by the name after the colon. A taxonomy has a row for each concept of the filing standard;
    it is broadcast up to ``MAX_CONCEPTS`` rows, so that the many facts of a concept aren't moved to one task."""
    taxonomy = _looked_up(taxonomy.select("concept", "label", "metric_role"))
    full = taxonomy.select(F.col("concept").alias("_f"), F.col("label").alias("_fl"), F.col("metric_role").alias("_fr"))
    local = taxonomy.select(F.col("concept").alias("_l"), F.col("label").alias("_ll"), F.col("metric_role").alias("_lr"))
    rows = facts.join(full, F.col("concept") == F.col("_f"), "left").join(local, F.substring_index("concept", ":", -1) == F.col("_l"), "left")
    return rows.withColumns({"label": F.coalesce("_fl", "_ll"), "metric_role": F.coalesce("_fr", "_lr")}).drop("_f", "_fl", "_fr", "_l", "_ll", "_lr")


def is_annual(start: Column, end: Column) -> Column:
    """Whether a period is a calendar year."""
    return (F.date_format(start, "MM-dd") == "01-01") & (F.date_format(end, "MM-dd") == "12-31")


# Ranks of the concepts of a family, the first pattern that fits; and the rank of others.
CONCEPT_RANKS = {
    "equity": ((("StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", 0), ("StockholdersEquityIncluding", 1), ("StockholdersEquity$", 2), ("^(?!.*Other).*StockholdersEquity", 3)), 99),
    "cash": ((("^CashAndCashEquivalents(AtCarryingValue)?$", 0),), 5),
    "assets": ((("^Assets$", 0), ("AssetsCurrent|AssetsNoncurrent", 3)), 8),
}


def concept_rank(concept: Column, family: Column) -> Column:
    """How far a concept is from the one that a family means; 10 for families without ranks."""
    out = F.when(F.lit(False), 0)
    for name, (patterns, other) in CONCEPT_RANKS.items():
        rank = reduce(lambda a, p: a.when(concept.rlike("(?i)" + p[0]), p[1]), patterns, F.when(F.lit(False), 0))
        out = out.when(family == name, rank.otherwise(other))
    return out.otherwise(10)


def point_facts(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, fact_id, score, value_num, confidence): the best fact of each question.

    queries: query_id, issuer_id, question, family, target_year, form (the last three may be null). A
    fact must pass the family's guard and fit the period; score is 100 less the concept's rank, and
    20 if annual, 10 if its concept matches the question, 15 if it ends in the target year.
    Questions that ask the same of an issuer are answered once, so that one with very many questions
    and facts doesn't pair them all.
    """
    asked = ["issuer_id", "question", "family", "target_year", "form"]
    distinct = queries.select(*asked).distinct().withColumn("_k", F.xxhash64(*asked))
    rows = distinct.join(facts.withColumnRenamed("form_type", "_filed"), "issuer_id").where(S.concept_passes_guard(F.col("concept"), F.col("family")))
    annual = is_annual(F.col("period_start"), F.col("period_end"))
    rows = rows.where(S.period_matches_intent(F.col("period_start"), F.col("period_end"), annual, F.col("target_year"), F.col("form")))
    rank = concept_rank(F.col("concept"), F.coalesce("family", F.lit("")))
    hit = F.coalesce(S.concept_matches_query(F.col("concept"), F.col("question")), F.lit(False))
    score = 100 - rank + 20 * annual.cast("int") + 10 * hit.cast("int") + F.when(F.year("period_end") == F.col("target_year"), 15).otherwise(0)
    sure = F.when(annual & ((F.coalesce("family", F.lit("")) != "equity") | (rank < 5)), "high").otherwise("medium")
    w = Window.partitionBy("_k", *asked).orderBy(F.desc("score"), F.desc("period_end"), "fact_id")
    best = rows.withColumns({"score": score, "confidence": sure}).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    same = reduce(lambda x, y: x & y, [F.col(f"q.{c}").eqNullSafe(F.col(f"b.{c}")) for c in asked])
    return queries.withColumn("_k", F.xxhash64(*asked)).alias("q").join(best.alias("b"), (F.col("q._k") == F.col("b._k")) & same).select("q.query_id", "b.fact_id", "b.score", "b.value_num", "b.confidence")


# The concepts of a ratio's numerator and denominator as (pattern, exclusion).
RATIO_SIDES = {
    "tax_rate": (("IncomeTaxExpense|ProvisionForIncomeTax|EffectiveIncomeTax", "Statutory|Reconciliation"),
                 ("EarningsBeforeIncomeTax|IncomeBeforeIncomeTax|PretaxIncome|ProfitBeforeTax|IncomeLossFromContinuingOperationsBeforeIncomeTax", None)),
    "dividend_payout": (("Dividends|DistributionsTo(Shareholders|Stockholders)", "OtherComprehensive|Aoci"), ("NetIncome|ProfitLoss", "OtherComprehensive|Aoci")),
    "margin": (("NetIncome|ProfitLoss|IncomeLossFromContinuingOperations|OperatingIncomeLoss", "OtherComprehensive|SegmentOperating"),
               ("RevenueFromContractWithCustomer|Revenue|SalesRevenueNet", None)),
}


def ratio_kind(question: Column, metric: Column, family: Column) -> Column:
    """Which ratio (tax_rate, dividend_payout, margin) a question of metric type ratio asks for, or null."""
    q, f = F.lower(question), F.coalesce(family, F.lit(""))
    of = (
        F.when((f == "tax_rate") | q.contains("tax rate") | q.contains("effective tax"), "tax_rate")
        .when((f == "dividend_payout") | (q.contains("dividend") & q.contains("payout")), "dividend_payout")
        .when((f == "margin") | q.contains("margin") | q.contains("ratio") | q.contains("percentage of") | q.contains(" as a percent"), "margin")
    )
    return F.when(metric == "ratio", of)


def _side(concept: Column, kind: Column, side: int) -> Column:
    out = F.when(F.lit(False), F.lit(False))
    for name, sides in RATIO_SIDES.items():
        pattern, without = sides[side]
        fits = concept.rlike("(?i)" + pattern)
        out = out.when(kind == name, fits if without is None else fits & ~concept.rlike("(?i)" + without))
    return F.coalesce(out, F.lit(False))


def ratio_pairs(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, kind, num_fact, den_fact, score, ratio, reason): the best numerator and denominator of
    one period for each question.

    queries: query_id, issuer_id, question, metric_type, family, target_year, form (the last three may be
    null). Facts pass the family's guard (for dividends: are either side) and fit the period. One scores
    5 if annual, 2 if its concept matches the question and 1 if it ends on a 31st of December; a pair
    has the sum, and ties go to the newer period, then to the lesser ids. A fact without a period
    goes with any. Only a fact with itself isn't a pair, so the best two of a side in a period are
    enough and no group is paired with itself. ratio is in percent, null for a zero denominator.
    Without a pair, reason says why: unsupported, no_candidates, missing_side or no_pair.
    """
    asked = ["issuer_id", "question", "metric_type", "family", "target_year", "form"]
    keyed = queries.withColumn("_k", F.sha2(F.to_json(F.struct(*asked)), 256))
    kinds = keyed.select("_k", *asked).distinct().withColumn("kind", ratio_kind(F.col("question"), F.col("metric_type"), F.col("family")))
    rows = kinds.where("kind IS NOT NULL").join(facts.withColumnRenamed("form_type", "_filed"), "issuer_id")
    annual = is_annual(F.col("period_start"), F.col("period_end"))
    num, den = (_side(F.col("concept"), F.col("kind"), i) for i in (0, 1))
    guarded = F.when(F.col("family") == "dividend_payout", num | den).otherwise(S.concept_passes_guard(F.col("concept"), F.col("family")))
    rows = rows.where(guarded & S.period_matches_intent(F.col("period_start"), F.col("period_end"), annual, F.col("target_year"), F.col("form")))
    points = ((annual, 5), (S.concept_matches_query(F.col("concept"), F.col("question")), 2), (F.date_format("period_end", "MM-dd") == "12-31", 1))
    score = reduce(lambda x, y: x + y, [F.when(test, n).otherwise(0) for test, n in points])
    sides = F.filter(F.array(F.when(num, "num"), F.when(den, "den"), F.lit("any")), lambda x: x.isNotNull())
    rows = rows.select("_k", "fact_id", "value_num", "period_end", score.alias("score"), F.explode(sides).alias("side"))
    rank = lambda *keys: F.row_number().over(Window.partitionBy("_k", "side", *keys).orderBy(F.desc("score"), F.desc_nulls_last("period_end"), "fact_id"))
    # A few rows a question and period, written once and read by each kind of pair.
    best = written(rows.withColumn("_n", rank("period_end")).where("_n <= 2").withColumn("_all", rank()), "ratio-sides")
    seen = best.groupBy("_k").agg(F.bool_or(F.col("side") == "num").alias("_has_num"), F.bool_or(F.col("side") == "den").alias("_has_den"))

    def pick(side: str, where: str) -> DataFrame:
        return best.where(f"side = '{side}' AND {where}").select("_k", F.struct("fact_id", "value_num", "score", "period_end").alias(side))

    dated = pick("num", "period_end IS NOT NULL").withColumn("_p", F.col("num.period_end")).hint("merge").join(pick("den", "period_end IS NOT NULL").withColumn("_p", F.col("den.period_end")), ["_k", "_p"]).drop("_p")
    any_den = pick("num", "period_end IS NULL").hint("merge").join(pick("den", "_all <= 2"), "_k")
    any_num = pick("num", "_all <= 2").hint("merge").join(pick("den", "period_end IS NULL"), "_k")
    pairs = dated.unionByName(any_den).unionByName(any_num).where("num.fact_id <> den.fact_id")
    total, period = F.col("num.score") + F.col("den.score"), F.coalesce("num.period_end", "den.period_end")
    w = Window.partitionBy("_k").orderBy(total.desc(), period.desc_nulls_last(), "num.fact_id", "den.fact_id")
    ratio = F.col("num.value_num") / F.nullif(F.abs("den.value_num"), F.lit(0)) * 100
    won = pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("_k", F.col("num.fact_id").alias("num_fact"), F.col("den.fact_id").alias("den_fact"), total.alias("score"), ratio.alias("ratio"))
    answers = kinds.select("_k", "kind").hint("merge").join(seen, "_k", "left").join(won.hint("merge"), "_k", "left")
    reason = (
        F.when(F.col("kind").isNull(), "unsupported").when(F.col("_has_num").isNull(), "no_candidates")
        .when(~F.col("_has_num") | ~F.col("_has_den"), "missing_side").when(F.col("num_fact").isNull(), "no_pair")
    )
    answers = answers.select("_k", "kind", "num_fact", "den_fact", "score", "ratio", reason.alias("reason"))
    return keyed.select("query_id", "_k").hint("merge").join(answers, "_k").drop("_k")


def compute_metric(metric: Column, new: Column, old: Column) -> Column:
    """struct(value, reason) of point, delta, percent_change or ratio (new over old)."""
    zero = (old == 0) & metric.isin("percent_change", "ratio")
    missing = new.isNull() | (old.isNull() & (metric != "point"))
    safe = F.nullif(F.abs(old), F.lit(0))
    value = F.when(metric == "point", new.cast("double")).when(metric == "delta", (new - old).cast("double")).when(metric == "percent_change", (new - old) / safe * 100).when(metric == "ratio", new / safe * 100)
    reason = F.when(missing, "missing_fact").when(zero, "zero_base").when(value.isNull(), "unknown_metric")
    return F.struct(F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))


def yoy_series(facts: DataFrame, concept: str) -> DataFrame:
    """For each issuer and annual period the largest value of a concept, with change and percent
    change from the period before (null for the first)."""
    rows = facts.where((F.col("concept") == concept) & (F.col("form_type") == "10-K")).groupBy("issuer_id", "period_end").agg(F.max("value_num").alias("value"))
    w = Window.partitionBy("issuer_id").orderBy("period_end")
    rows = rows.withColumn("prior", F.lag("value").over(w))
    change = compute_metric(F.lit("percent_change"), F.col("value"), F.col("prior"))
    return rows.withColumns({"delta": F.col("value") - F.col("prior"), "percent_change": change["value"]})


def period_type(start: Column, end: Column) -> Column:
    days = F.datediff(end, start)
    return F.when(start.isNull() & end.isNull(), "unknown").when(start.isNull() | (days == 0), "instant").when(days >= 350, "annual").otherwise("interim")


def enrich_catalog(facts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Add standard_label, metric_roles, statement_role, period_type, calc_parents and calc_children to facts
    (concept, period_start, period_end, is_annual).

    What the concept's name says is overruled by its row in taxonomy (concept, standard_label,
    statement_role, metric_roles, calc_parents, calc_children; one a concept), where that has a label
    and a statement other than "other"; its roles come before those of the name, each once. A concept
    with very many facts meets one row, without a shuffle up to ``MAX_CONCEPTS`` concepts.
    """
    none = F.array().cast("array<string>")
    known = taxonomy.select("concept", *[F.col(c).alias(f"_{c}") for c in ("standard_label", "statement_role", "metric_roles", "calc_parents", "calc_children")])
    rows = facts.join(_looked_up(known), "concept", "left").withColumn("_named", S.concept_roles(F.col("concept")))
    days = F.datediff("period_end", "period_start")
    kind = F.when(F.col("is_annual"), "annual").when(days != 0, "interim").when(F.col("period_start").isNull() & F.col("period_end").isNotNull(), "instant").otherwise("unknown")
    told = F.when(F.col("_statement_role") != "other", F.col("_statement_role"))
    return rows.withColumns({
        "standard_label": F.coalesce(F.nullif("_standard_label", F.lit("")), F.col("_named.label"), S.split_camel_label(F.col("concept"))),
        "metric_roles": F.array_distinct(F.concat(F.coalesce("_metric_roles", none), F.coalesce("_named.roles", none))),
        "statement_role": F.coalesce(told, F.col("_named.statement"), F.lit("other")), "period_type": kind,
        "calc_parents": F.coalesce("_calc_parents", none), "calc_children": F.coalesce("_calc_children", none),
    }).drop("_named", *known.columns[1:])


def catalog_trim(facts: DataFrame, roles: list[list[str]], most: int = 50) -> DataFrame:
    """The first ``most`` facts of each issuer: by the first role list that names the concept, then
    annual before interim, then the newest."""
    rank = F.lit(len(roles))
    for i, names in reversed(list(enumerate(roles))):
        rank = F.when(F.col("concept").isin(names), i).otherwise(rank)
    annual = F.when(period_type(F.col("period_start"), F.col("period_end")) == "annual", 0).otherwise(1)
    w = Window.partitionBy("issuer_id").orderBy("priority", "late", F.desc("period_end"), "fact_id")
    return facts.withColumns({"priority": rank, "late": annual}).withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).drop("late")


def missing_families(queries: DataFrame, evidence: DataFrame, facts: DataFrame, required: list[str]) -> DataFrame:
    """For each query the newest fact of every required family that its evidence (query_id, fact_id)
    lacks: (query_id, family, fact_id)."""
    kinds = facts.withColumn("family", S.concept_family(F.col("concept")))
    have = evidence.join(kinds.select("fact_id", "family"), "fact_id").select("query_id", "family").distinct()
    want = queries.select("query_id", "issuer_id", F.explode(F.array(*map(F.lit, required))).alias("family"))
    newest = kinds.groupBy("issuer_id", "family").agg(F.min_by("fact_id", F.struct((-F.unix_date("period_end")).alias("d"), "fact_id")).alias("fact_id"))
    rows = want.join(have.hint("merge"), ["query_id", "family"], "left_anti").join(newest.hint("merge"), ["issuer_id", "family"])
    return rows.select("query_id", "family", "fact_id")
