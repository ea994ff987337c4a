"""Operators on how questions move through filings: footnotes, hops, planned sections, reachable paths,
pinned artifacts, and what a review of a cohort shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import written

# Words that make a short answer a sentence.
SENTENCE_WORDS = ("is", "are", "was", "were", "the", "and", "that", "discuss")


def footnote_edges(tables: DataFrame, footnotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (source_id, target_id, edge_type), and references that no footnote answers (node_id, n).

    tables: node_id (the document), table_id, footnote_ids. footnotes: node_id, footnote_id,
    parent_table_id. A table that refers to a footnote, or is its parent, is joined to it by FOOTNOTE_OF;
    a footnote without a parent that exists lies in the document.
    """
    note, none = F.concat_ws("-fn-", "node_id", "footnote_id"), F.array().cast("array<string>")
    notes = written(footnotes.select("node_id", "footnote_id", "parent_table_id"), "footnotes")
    # A table's own references and the footnotes that it is parent of are one list, so no edge comes twice.
    owned = notes.groupBy("node_id", F.col("parent_table_id").alias("table_id")).agg(F.collect_set("footnote_id").alias("_owned"))
    listed = tables.groupBy("node_id", "table_id").agg(F.flatten(F.collect_list("footnote_ids")).alias("footnote_ids"))
    both = listed.join(owned.hint("merge"), ["node_id", "table_id"], "left")
    refs = both.select("node_id", "table_id", F.explode(F.array_distinct(F.concat("footnote_ids", F.coalesce("_owned", none)))).alias("footnote_id"))
    known = notes.select("node_id", "footnote_id", F.lit(True).alias("_known")).distinct()
    met = refs.join(known.hint("merge"), ["node_id", "footnote_id"], "left")
    of = met.where("_known").select(F.col("table_id").alias("source_id"), note.alias("target_id"), F.lit("FOOTNOTE_OF").alias("edge_type"))
    loose = notes.join(tables.select("node_id", F.col("table_id").alias("parent_table_id")).hint("merge"), ["node_id", "parent_table_id"], "left_anti")
    inside = loose.select(F.col("node_id").alias("source_id"), note.alias("target_id"), F.lit("CONTAINS").alias("edge_type"))
    return of.unionByName(inside), met.where("_known IS NULL").groupBy("node_id").agg(F.count("*").alias("n"))


def walk_candidates(frontier: DataFrame, edges: DataFrame, nodes: DataFrame, bound: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, source_id, target_id, edge_type, score, position, approved): the best ``most`` outgoing
    neighbours of the nodes where questions stand.

    frontier: query_id, question, node_id. nodes: node_id, label. bound: query_id, accession. The score
    counts the question's words of three letters or more in a neighbour's label and id; ties go to
    the least id. A hop is approved if the neighbour's accession is bound to the question.
    Questions of the same words at the same node have the same best neighbours, which are found once, so
    that very many questions and neighbours aren't all paired.
    """
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("question"), F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) > 2))
    asked = frontier.select("query_id", F.col("node_id").alias("source_id"), words.alias("_words")).withColumn("_k", F.sha2(F.to_json(F.struct("_words")), 256))
    rows = asked.select("source_id", "_k", "_words").dropDuplicates(["source_id", "_k"]).join(edges.select("source_id", "target_id", "edge_type").hint("merge"), "source_id")
    rows = rows.join(nodes.select(F.col("node_id").alias("target_id"), "label").hint("merge"), "target_id")
    text = F.lower(F.concat_ws(" ", "label", "target_id"))
    rows = rows.withColumn("score", F.size(F.filter("_words", lambda w: F.contains(text, w))))
    place = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "target_id", "edge_type"))
    best = rows.withColumn("_n", place("source_id", "_k")).where(F.col("_n") <= most).drop("_n", "_words", "label")
    rows = asked.select("query_id", "source_id", "_k").join(best.hint("merge"), ["source_id", "_k"])
    rows = rows.withColumn("position", place("query_id", "source_id")).where(F.col("position") <= most).withColumn("accession", S.accession_of(F.col("target_id")))
    held = bound.select("query_id", "accession", F.lit(True).alias("_held")).distinct()
    rows = rows.join(held.hint("merge"), ["query_id", "accession"], "left")
    return rows.select("query_id", "source_id", "target_id", "edge_type", "score", "position", F.coalesce("_held", F.lit(False)).alias("approved"))


def section_candidates(planned: DataFrame, most: int) -> DataFrame:
    """(query_id, section_id, score, path) of planned sections (query_id, accession, section_id, position):
    ``most`` points for the first of a question, one less for each after it; path from the document.

    A section that several filings plan counts once, at its best place."""
    w = Window.partitionBy("query_id").orderBy("position", "accession", "section_id")
    once = planned.groupBy("query_id", "section_id").agg(F.min(F.struct("position", "accession")).alias("p")).select("query_id", "section_id", "p.*")
    rows = once.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return rows.select("query_id", "section_id", (F.lit(most + 1) - F.col("_n")).cast("int").alias("score"), F.array(S.document_root(F.col("accession")), "section_id").alias("path"))


def section_reachability(items: DataFrame, index: DataFrame) -> DataFrame:
    """(item_id, status, unresolved): missing where an item (item_id, paths) names no section, unresolved
    where the index (path) lacks some, with their number, else reachable."""
    rows = items.select("item_id", F.explode_outer("paths").alias("path"))
    found = rows.join(index.select("path", F.lit(True).alias("_in")).distinct().hint("merge"), "path", "left")
    n = F.count_if(F.col("path").isNotNull() & F.col("_in").isNull())
    status = F.when(F.count("path") == 0, "missing").when(n > 0, "unresolved").otherwise("reachable")
    return found.groupBy("item_id").agg(status.alias("status"), n.alias("unresolved"))


def verify_hashes(actual: DataFrame, pinned: DataFrame) -> DataFrame:
    """(path, status) of artifacts (path, hash) against pinned ones: missing, mismatch, unpinned or ok.
    Hashes are compared in lower case and without "sha256:"; a pinned hash that is null or empty
    isn't pinned."""
    plain = F.regexp_replace(F.lower(F.trim("hash")), "^sha256:", "")
    have = actual.select("path", plain.alias("_have"), F.lit(True).alias("_is"))
    want = pinned.select("path", F.nullif(plain, F.lit("")).alias("_want")).where("_want IS NOT NULL")
    rows = have.join(want, "path", "full")
    status = F.when(F.col("_is").isNull(), "missing").when(F.col("_want").isNull(), "unpinned").when(F.col("_have").eqNullSafe(F.col("_want")), "ok").otherwise("mismatch")
    return rows.select("path", status.alias("status"))


def infer_answer_type(answer: Column, profile: Column, multi: Column, comparison: Column, n_accessions: Column) -> Column:
    """comparison, numeric, short_label or narrative, by the shape of an answer and the item around it."""
    t = F.trim(F.coalesce(answer, F.lit("")))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    number = S.parse_numeric_gt(t).isNotNull()
    sentence = F.exists(words, lambda w: F.lower(w).isin(*SENTENCE_WORDS))
    several = (multi | (profile == "comparison") | comparison) & (n_accessions >= 2)
    return (
        F.when(F.coalesce(several, F.lit(False)), "comparison").when((t != "") & number, "numeric").when((t != "") & (F.size(words) <= 4) & ~sentence, "short_label")
        .when((t != "") & (profile == "numeric"), "short_label").otherwise("narrative")
    )


def narrative_fallback(documents: DataFrame, least: int = 500) -> DataFrame:
    """(doc_id, section_id, text) of documents (doc_id, text) without headings: the risk factors if an
    item of that name is in the text, up to the next item, else the whole; shorter ones give none."""
    span = F.regexp_extract("text", r"(?is)(\bitem\s+1a\b.{0,80}?\brisk\s+factors\b.+?)(?=\bitem\s+[0-9]|\z)", 1)
    rows = documents.where(F.length("text") > least).withColumn("_span", span)
    name = F.when(F.col("_span") != "", "html-risk_factors-0").otherwise("html-narrative-generic")
    return rows.select("doc_id", name.alias("section_id"), F.when(F.col("_span") != "", F.col("_span")).otherwise(F.col("text")).alias("text"))


def cohort_debug(results: DataFrame, bound: DataFrame, evidence: DataFrame) -> DataFrame:
    """(variant_id, item_id, n_filings, n_evidence, n_cited, weakest) of results (variant_id, item_id, scores).

    bound: item_id, accession. evidence: variant_id, item_id, chunk_id, cited."""
    filings = bound.groupBy("item_id").agg(F.count_distinct("accession").alias("n_filings"))
    chunks = evidence.groupBy("variant_id", "item_id").agg(F.count("*").alias("n_evidence"), F.count_if("cited").alias("n_cited"))
    rows = results.join(filings, "item_id", "left").join(chunks, ["variant_id", "item_id"], "left")
    entries = F.filter(F.map_entries("scores"), lambda e: (e["key"] != "trajectory_fidelity") & e["value"].isNotNull())
    weakest = F.array_min(F.transform(entries, lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))["k"]
    return rows.select("variant_id", "item_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_filings", "n_evidence", "n_cited")], weakest.alias("weakest"))
