"""Taxonomy linkbases (labels, presentation, calculation) as one row of metadata a concept.

A folder holds the files of one taxonomy; many folders are read at once. Locators are local to the
link element that they stand in, whatever other links and files call theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import written

# Roles of the standard and words that define the results.
STANDARD, TERSE = "http://www.xbrl.org/2003/role/label", "http://www.xbrl.org/2003/role/terseLabel"
DOCUMENTATION = ("http://www.w3.org/2003/role/documentation", "http://www.xbrl.org/2003/role/documentation")
SUMMATION = "http://www.xbrl.org/2003/arcrole/summation-item"
STATEMENTS = (
    ("income_statement", ("incomestatement", "statementofincome", "statementofoperations")), ("balance_sheet", ("balancesheet", "financialposition", "statementoffinancialposition")),
    ("cash_flow", ("cashflow", "statementofcashflows")),
)
LABEL_ROLES = (
    (r"net income|net earnings|net profit", ("net_income", "margin_numerator")), (r"before income tax|pretax|pre-tax", ("pretax_income",)),
    (r"\brevenues?\b|total revenue", ("revenue", "total_revenue", "margin_denominator")),
)
_LOC, _ARC = "loc array<struct<_label string, _href string>>", "array<struct<_from string, _to string, _arcrole string>>"


def local_name(href: Column) -> Column:
    """A concept's name in a locator: what follows the first underscore of the fragment, or of the last
    part of a path without one."""
    part = F.when(href.contains("#"), F.substring_index(href, "#", -1)).otherwise(F.substring_index(href, "/", -1))
    return F.regexp_replace(part, "^[^_]*_", "")


def statement_of(role: Column) -> Column:
    """income_statement, balance_sheet, cash_flow or other, by the words of a link's role."""
    low = F.lower(role)
    out = F.lit("other")
    for name, words in reversed(STATEMENTS):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def metric_roles(label: Column) -> Column:
    """Roles that a concept's label gives it in metrics, in the order of the rules."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(F.lower(label).rlike(pattern), F.array(*map(F.lit, roles))).otherwise(none) for pattern, roles in LABEL_ROLES])


def _links(spark: SparkSession, path: str, ending: str, tag: str, schema: str) -> DataFrame:
    """Link elements of the files with this ending, with or without a prefix, and their place."""
    out = None
    for prefix in ("", "link:"):
        rows = spark.read.format("xml").options(rowTag=prefix + tag, ignoreNamespace=True, pathGlobFilter=f"*{ending}").schema(f"_role string, {schema}").load(path)
        rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), *[F.col(c) for c in rows.columns])
        out = rows if out is None else out.unionByName(rows)
    folder = F.regexp_replace("file", "/[^/]*$", "")
    return written(out.select(folder.alias("folder"), F.struct("file", "block", "id").alias("link"), *[c for c in out.columns if c not in ("file", "block", "id")]), f"links{ending[:4]}")


def _concepts(links: DataFrame) -> DataFrame:
    """(folder, link, label, at, concept): the locators of each link; of a repeated one the last counts."""
    each = links.select("folder", "link", F.posexplode("loc").alias("at", "l")).select("folder", "link", F.col("l._label").alias("label"), "at", F.col("l._href").alias("href"))
    last = each.where("label <> '' AND href <> ''").groupBy("folder", "link", "label").agg(F.max_by("href", "at").alias("href"), F.min("at").alias("at"))
    return last.select("folder", "link", "label", "at", local_name(F.col("href")).alias("concept"))


def _arcs(links: DataFrame, column: str) -> DataFrame:
    rows = links.select("folder", "link", F.posexplode(column).alias("at", "a"))
    return rows.select("folder", "link", "at", F.col("a._from").alias("source"), F.col("a._to").alias("target"), F.col("a._arcrole").alias("arcrole"))


def _in_order(rows: DataFrame, value: str, into: str, *keys: str) -> DataFrame:
    """Distinct values of each key as an array, by their first place."""
    first = rows.groupBy(*keys, value).agg(F.min(F.struct("link", "at")).alias("_at"))
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", value))).alias("_v")).select(*keys, F.col(f"_v.{value}").alias(into))


def read_taxonomies(spark: SparkSession, path: str) -> DataFrame:
    """One row for each folder and concept: standard_label, terse_label, documentation (null if absent),
    statement_role, presentation_roles, calc_parents, calc_children and metric_roles (arrays, in the
    order of the files).

    path: a folder or a pattern of folders with files *_lab.xml, *_pre.xml and *_cal.xml. Of several
    labels of a role the first counts. Arcs without a known locator, and arcs of a calculation that
    don't sum up, are left out; other files aren't read.
    """
    labels = _links(spark, path, "_lab.xml", "labelLink", f"{_LOC}, label array<struct<_label string, _role string, _VALUE string>>, labelArc {_ARC}")
    text = labels.select("folder", "link", F.posexplode("label").alias("n", "l")).select("link", F.col("l._label").alias("target"), "n", F.coalesce(F.nullif(F.col("l._role"), F.lit("")), F.lit(STANDARD)).alias("role"), F.trim(F.col("l._VALUE")).alias("text"))
    text = text.where("target <> '' AND text <> ''").groupBy("link", "target").agg(F.max_by(F.struct("role", "text"), "n").alias("t")).select("link", "target", "t.*")
    named = _arcs(labels, "labelArc").join(_concepts(labels).select("link", F.col("label").alias("source"), "concept").hint("merge"), ["link", "source"]).join(text.hint("merge"), ["link", "target"])
    first = lambda *roles: F.min(F.when(F.col("role").isin(*roles), F.struct("link", "at", "text")))["text"]
    named = named.groupBy("folder", "concept").agg(first(STANDARD).alias("standard_label"), first(TERSE).alias("terse_label"), first(*DOCUMENTATION).alias("documentation"))

    shown = _links(spark, path, "_pre.xml", "presentationLink", _LOC)
    placed = _concepts(shown).join(shown.select("link", F.coalesce("_role", F.lit("")).alias("role")).hint("merge"), "link")
    roles = _in_order(placed.where("role <> ''"), "role", "presentation_roles", "folder", "concept")
    told = F.min(F.when(statement_of(F.col("role")) != "other", F.struct("link", statement_of(F.col("role")).alias("s"))))["s"]
    placed = placed.groupBy("folder", "concept").agg(F.coalesce(told, F.lit("other")).alias("statement_role"))

    sums = _links(spark, path, "_cal.xml", "calculationLink", f"{_LOC}, calculationArc {_ARC}")
    known = _concepts(sums)
    arcs = _arcs(sums, "calculationArc").where(F.col("arcrole") == SUMMATION)
    for end, name in (("source", "parent"), ("target", "child")):
        arcs = arcs.join(known.select("link", F.col("label").alias(end), F.col("concept").alias(name)).hint("merge"), ["link", end])
    children = _in_order(arcs.withColumnRenamed("parent", "concept"), "child", "calc_children", "folder", "concept")
    parents = _in_order(arcs.withColumnRenamed("child", "concept"), "parent", "calc_parents", "folder", "concept")

    key, none = ["folder", "concept"], F.array().cast("array<string>")
    out = named
    for more in (placed, roles, parents, children):
        out = out.join(more.hint("merge"), key, "full")
    label = F.coalesce("standard_label", "terse_label")
    return out.select(
        *key, "standard_label", "terse_label", "documentation", F.coalesce("statement_role", F.lit("other")).alias("statement_role"),
        *[F.coalesce(c, none).alias(c) for c in ("presentation_roles", "calc_parents", "calc_children")], F.coalesce(metric_roles(label), none).alias("metric_roles"),
    )
