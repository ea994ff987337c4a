"""Operators on filings: fiscal labels, latest versions, pairs of periods, bindings, snapshots.

A filings table has issuer_id, accession, form_type, filed_at and period_end. Many issuers are
handled at once; every ranking ends with the accession, so that ties have one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import lagged, ordered


def newest(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(F.desc("period_end"), F.desc("filed_at"), F.desc("accession"))


def _annual() -> Column:
    return F.upper("form_type").startswith("10-K")


def two_newest(filings: DataFrame, *keys: str) -> DataFrame:
    """(keys, newest, second): accessions of the newest and the second newest filing of each key; second is
    null where a filing is alone. No more than two rows of a key leave a task."""
    top = filings.withColumn("_n", F.row_number().over(newest(*keys))).where(F.col("_n") <= 2)
    nth = lambda n: F.max(F.when(F.col("_n") == n, F.col("accession")))
    return top.groupBy(*keys).agg(nth(1).alias("newest"), nth(2).alias("second"))


def fiscal_labels(filings: DataFrame) -> DataFrame:
    """Add fiscal_year, fiscal_quarter (null for annual reports) and label.

    The fiscal year ends in the month of the issuer's first annual report by filing date; December
    if it has none. Years are joined from one row an issuer, not a window over its filings.
    """
    ends = filings.where(_annual()).groupBy("issuer_id").agg(F.min_by(F.month("period_end"), F.struct("filed_at", "accession")).alias("fye"))
    rows = filings.join(ends, "issuer_id", "left").withColumn("fye", F.coalesce("fye", F.lit(12)))
    month, year = F.month("period_end"), F.year("period_end")
    fiscal_year = F.when(month <= F.col("fye"), year).otherwise(year + 1)
    quarter = F.floor(F.pmod(month - F.col("fye") - 1, F.lit(12)) / 3).cast("int") + 1
    rows = rows.withColumns({"fiscal_year": fiscal_year, "fiscal_quarter": F.when(~_annual(), quarter)})
    label = F.concat_ws("-", F.concat(F.lit("FY"), F.col("fiscal_year")), F.concat(F.lit("Q"), F.col("fiscal_quarter")))
    return rows.withColumn("label", label)


def dedupe_filings(filings: DataFrame, per_form: int | None = None) -> DataFrame:
    """The last filed of each (issuer, form, period), then the newest ``per_form`` of each form."""
    last = Window.partitionBy("issuer_id", "form_type", "period_end").orderBy(F.desc("filed_at"), F.desc("accession"))
    rows = filings.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    if per_form is None:
        return rows
    return rows.withColumn("_n", F.row_number().over(newest("issuer_id", "form_type"))).where(F.col("_n") <= per_form).drop("_n")


def resolve_corpus(definitions: DataFrame, filings: DataFrame) -> DataFrame:
    """Members of many corpora: (corpus_id, accession, form_type, status).

    definitions: corpus_id, issuer_id, mode (trailing, range, explicit), annual, quarterly,
    trailing_years, from_date, to_date, accessions (array), cap. Trailing takes the newest so many of
    each form, or, where trailing_years is given, so many annual reports and four times as many
    quarters; range those whose period ends between the dates; explicit the accessions named, of any
    version: unknown ones have status unknown and no form, a corpus that names none is one row with
    status no_accessions. A corpus with more than ``cap`` members has status over_cap throughout.
    """
    ranked = dedupe_filings(filings).withColumn("_n", F.row_number().over(newest("issuer_id", "form_type")))
    rows = definitions.where("mode <> 'explicit'").join(ranked, "issuer_id")
    years = F.col("trailing_years")
    most = F.when(_annual(), F.coalesce(years, "annual")).otherwise(F.coalesce(years * 4, F.col("quarterly")))
    inside = F.col("period_end").between(F.col("from_date"), F.col("to_date"))
    rows = rows.where(F.when(F.col("mode") == "trailing", F.col("_n") <= most).otherwise(inside))
    rows = rows.select("corpus_id", "cap", "accession", "form_type", F.lit("ok").alias("_found"))
    named = definitions.where("mode = 'explicit'").select("corpus_id", "cap", F.explode_outer(F.array_distinct("accessions")).alias("accession"))
    known = filings.groupBy("accession").agg(F.min("form_type").alias("form_type"))
    found = F.when(F.col("accession").isNull(), "no_accessions").when(F.col("form_type").isNull(), "unknown").otherwise("ok")
    named = named.join(known.hint("merge"), "accession", "left").select("corpus_id", "cap", "accession", "form_type", found.alias("_found"))
    n = F.count("accession").over(Window.partitionBy("corpus_id"))
    return rows.unionByName(named).select("corpus_id", "accession", "form_type", F.when(n > F.col("cap"), "over_cap").otherwise(F.col("_found")).alias("status"))


def pair_yoy(filings: DataFrame, quarterly: bool) -> DataFrame:
    """(issuer_id, accession, partner, label, partner_label): the newest filing of the form and that
    of a year before; issuers without a partner are left out.

    Annual reports pair the two newest. Quarters pair the newest with the newest that bears the
    same quarter's label of the year before, by an equi-join.
    """
    labelled = fiscal_labels(filings)
    if not quarterly:
        top = labelled.where("form_type = '10-K'").withColumn("_n", F.row_number().over(newest("issuer_id"))).where(F.col("_n") <= 2)
        nth = lambda n: F.max(F.when(F.col("_n") == n, F.struct("accession", "label")))
        rows = top.groupBy("issuer_id").agg(nth(1).alias("a"), nth(2).alias("b")).where("b IS NOT NULL")
        return rows.select("issuer_id", "a.accession", F.col("b.accession").alias("partner"), "a.label", F.col("b.label").alias("partner_label"))
    q = labelled.where("form_type = '10-Q'").withColumn("_n", F.row_number().over(newest("issuer_id")))
    first = q.where("_n = 1").select("issuer_id", "accession", "label", (F.col("fiscal_year") - 1).alias("fiscal_year"), "fiscal_quarter")
    other = q.withColumn("_m", F.row_number().over(newest("issuer_id", "fiscal_year", "fiscal_quarter"))).where("_m = 1")
    other = other.select("issuer_id", "fiscal_year", "fiscal_quarter", F.col("accession").alias("partner"), F.col("label").alias("partner_label"))
    return first.join(other, ["issuer_id", "fiscal_year", "fiscal_quarter"]).select("issuer_id", "accession", "partner", "label", "partner_label")


def pair_qoq(filings: DataFrame) -> DataFrame:
    """(issuer_id, accession, partner): the two newest quarterly reports."""
    rows = two_newest(filings.where("form_type = '10-Q'"), "issuer_id").where("second IS NOT NULL")
    return rows.select("issuer_id", F.col("newest").alias("accession"), F.col("second").alias("partner"))


def resolve_scope(scopes: DataFrame, filings: DataFrame) -> DataFrame:
    """Filings of many scopes: (scope_id, position, accession).

    scopes: scope_id, issuer_id, accessions, periods, anchor, compare_periods. The first of these
    that is given counts. Labels are answered in order by the newest filing that bears them; the
    anchors are latest_annual, latest_quarter and prior_quarter (the latest if it is alone).
    """
    labelled = fiscal_labels(filings)
    given = lambda c: F.col(c).isNotNull() & (F.size(c) > 0)
    branch = F.when(given("accessions"), "a").when(given("periods"), "p").when(F.col("anchor").isNotNull(), "n").when(given("compare_periods"), "c")
    s = scopes.withColumn("_b", branch)
    by_accession = s.where("_b = 'a'").select("scope_id", "issuer_id", F.posexplode("accessions").alias("position", "accession")).join(filings.select("issuer_id", "accession").hint("merge"), ["issuer_id", "accession"])
    labels = s.where("_b IN ('p', 'c')").select("scope_id", "issuer_id", F.posexplode(F.when(F.col("_b") == "p", F.col("periods")).otherwise(F.col("compare_periods"))).alias("position", "label"))
    one = labelled.withColumn("_m", F.row_number().over(newest("issuer_id", "label"))).where("_m = 1").select("issuer_id", "label", "accession")
    form = F.when(F.col("anchor") == "latest_annual", "10-K").when(F.col("anchor").isin("latest_quarter", "prior_quarter"), "10-Q")
    anchored = s.where("_b = 'n'").withColumn("form_type", form).join(two_newest(filings, "issuer_id", "form_type").hint("merge"), ["issuer_id", "form_type"])
    wanted = F.when(F.col("anchor") == "prior_quarter", F.coalesce("second", "newest")).otherwise(F.col("newest"))
    parts = (by_accession, labels.join(one.hint("merge"), ["issuer_id", "label"]), anchored.withColumns({"position": F.lit(0), "accession": wanted}))
    a, b, c = (p.select("scope_id", "position", "accession") for p in parts)
    return a.unionByName(b).unionByName(c)


def align_to_intent(intents: DataFrame, filings: DataFrame) -> DataFrame:
    """(query_id, accession, how) of the best filing for (query_id, issuer_id, label, form_type).

    Tried in order: label and form (how is 0), label alone (1), an annual report of the label's year
    (2); the newest of the first kind that exists. Filings are reduced to the newest of each kind
    first, so an intent meets three rows at most, however many filings its issuer has.
    """
    labelled = fiscal_labels(filings).select("issuer_id", "accession", "period_end", "filed_at", "form_type", "label", "fiscal_year")
    best = F.max_by("accession", F.struct("period_end", "filed_at", "accession")).alias("accession")
    rows = intents.withColumn("fiscal_year", F.regexp_extract("label", "FY([0-9]{4})", 1).try_cast("int"))
    kinds = (("issuer_id", "label", "form_type"), ("issuer_id", "label"), ("issuer_id", "fiscal_year"))
    out = None
    for how, keys in enumerate(kinds):
        some = labelled if how < 2 else labelled.where("form_type = '10-K'")
        found = rows.join(some.groupBy(*keys).agg(best).hint("merge"), [*keys]).select("query_id", "accession", F.lit(how).alias("how"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("query_id").agg(F.min_by("accession", "how").alias("accession"), F.min("how").alias("how"))


def stale_filings(filings: DataFrame, held: DataFrame) -> DataFrame:
    """Filings that a snapshot (issuer_id, accession) lacks and that are newer than all it has."""
    last = filings.join(held, ["issuer_id", "accession"], "left_semi").groupBy("issuer_id").agg(F.max("filed_at").alias("_last"))
    return filings.join(held, ["issuer_id", "accession"], "left_anti").join(last, "issuer_id").where("filed_at > _last").drop("_last")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """(issuer_id, snapshot_id) registered last; ties go to the greater id."""
    return snapshots.groupBy("issuer_id").agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("snapshot_id"))


def accession_index(snapshots: DataFrame) -> DataFrame:
    """(accession, issuer_id, conflict): the issuer of each accession, and whether several claim it."""
    return snapshots.groupBy("accession").agg(F.min("issuer_id").alias("issuer_id"), (F.count_distinct("issuer_id") > 1).alias("conflict"))


def temporal_edges(filings: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type) between consecutive filings of an issuer. Filings are sorted over
    all partitions, so an issuer with very many is in no single task."""
    rows = ordered(filings.select("issuer_id", "accession", "period_end", "filed_at"), ["issuer_id"], ["period_end", "filed_at", "accession"], "filings-in-order", ["issuer_id", "accession"])
    rows = lagged(rows, ["issuer_id"], F.struct("accession"), "_before").where("_before IS NOT NULL")
    return rows.select(F.concat(F.lit("doc-"), F.col("_before.accession")).alias("source_id"), F.concat(F.lit("doc-"), F.col("accession")).alias("target_id"), F.lit("NEXT").alias("edge_type"))


def bound_filings(items: DataFrame, filings: DataFrame) -> DataFrame:
    """Every bound accession of items (item_id, accessions) with its filing; ``missing`` if none."""
    wanted = items.select("item_id", F.explode("accessions").alias("accession")).distinct()
    rows = wanted.join(filings.select("accession", "issuer_id", "form_type", "period_end").hint("merge"), "accession", "left")
    return rows.withColumn("missing", F.col("issuer_id").isNull())


def expand_prior_year(bound: DataFrame, filings: DataFrame) -> DataFrame:
    """Bound (query_id, accession) and, for each, its issuer's annual report of the year before."""
    have = bound.join(filings.select("accession", "issuer_id", "period_end").hint("merge"), "accession")
    # A year before is looked up once a query, however many of the issuer's filings are bound in it.
    asked = have.select("query_id", "issuer_id", (F.year("period_end") - 1).alias("y")).distinct()
    prior = filings.where("form_type = '10-K'").select("issuer_id", F.year("period_end").alias("y"), F.col("accession").alias("prior"))
    more = asked.join(prior.hint("merge"), ["issuer_id", "y"]).select("query_id", F.col("prior").alias("accession"))
    return bound.select("query_id", "accession").unionByName(more).distinct()


def accession_catalog(filings: DataFrame, allowed: DataFrame, per_form: int) -> DataFrame:
    """Recent filings of allowed issuers with their calendar year."""
    kept = dedupe_filings(filings.join(allowed, "issuer_id", "left_semi"), per_form)
    return kept.select("issuer_id", "accession", "form_type", F.year("period_end").alias("calendar_year"))
