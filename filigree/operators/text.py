"""Narrative extraction: item headings, item sections, best sentences; and document checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HEADING = r"(?i)\bitem\s+(1a|1|7)\b"
_CUT = "\x01"


def item_pieces(documents: DataFrame) -> DataFrame:
    """Cut each text (doc_id, text) before every "Item 1", "1A" or "7": (doc_id, position, piece, item,
    is_primary). A primary heading ends with a stop and a blank, isn't a cross-reference, a link or
    followed by a comma, and is the first of its item; the piece before any heading has no item."""
    marked = F.regexp_replace("text", r"(?i)\b(item\s+(?:1a|1|7)\b)", _CUT + "$1")
    pieces = documents.select("doc_id", F.posexplode(F.split(marked, _CUT)).alias("position", "piece"))
    item = F.upper(F.regexp_extract("piece", r"(?i)^item\s+(1a|1|7)\b", 1))
    head = F.left("piece", F.lit(120))
    good = (
        (item != "") & ~head.rlike(r"(?i)of\s+this\s+form\s+10-?k\s+under\s+the\s+heading") & ~F.left("piece", F.lit(80)).contains("</a>")
        & ~F.left("piece", F.lit(50)).rlike(r"(?i)item\s+[0-9]+[a-z]?\s*,") & F.left("piece", F.lit(80)).rlike(r"(?i)item\s+[0-9]+[a-z]?\.\s*(&#160;|&nbsp;|\s)+")
    )
    rows = pieces.withColumns({"item": item, "_good": good})
    first = F.row_number().over(Window.partitionBy("doc_id", "item", "_good").orderBy("position"))
    return rows.withColumn("is_primary", F.col("_good") & (first == 1)).drop("_good")


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"(&nbsp;|&#160;|\s)+", " "))


def split_items(documents: DataFrame, least_raw: int = 200, least_plain: int = 500, most: int | None = None) -> DataFrame:
    """(doc_id, item, body): the text from each primary heading to the next, of documents with two or
    more; short sections and tables of contents are left out; bodies are whole, or end at ``most`` characters."""
    pieces = item_pieces(documents)
    w = Window.partitionBy("doc_id").orderBy("position")
    rows = pieces.withColumn("section", F.sum(F.col("is_primary").cast("int")).over(w)).where("section > 0")
    joined = rows.groupBy("doc_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "piece"))), lambda x: x["piece"]), "").alias("raw"), F.min_by("item", "position").alias("item"))
    n = F.count("*").over(Window.partitionBy("doc_id"))
    plain = strip_tags(F.col("raw"))
    contents = (F.size(F.split("raw", r"(?i)item ")) > 9) & (F.length(plain) < 3000)
    rows = joined.withColumns({"_n": n, "_plain": plain, "_toc": contents}).where((F.col("_n") >= 2) & (F.length("raw") >= least_raw) & (F.length("_plain") >= least_plain) & ~F.col("_toc"))
    return rows.select("doc_id", "item", (F.col("_plain") if most is None else F.left("_plain", F.lit(most))).alias("body"))


def best_sentences(documents: DataFrame, words: list[str], least: int = 50, most: int = 2) -> DataFrame:
    """(doc_id, position, sentence, score): the ``most`` sentences with most of the words."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("position", "sentence")).where(F.length("sentence") >= least)
    low = F.lower("sentence")
    score = sum((low.contains(w).cast("int") for w in words), F.lit(0))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "position")
    return rows.withColumn("score", score).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def parse_confidence(documents: DataFrame) -> DataFrame:
    """Add confidence from n_facts, n_tables and n_sections."""
    c = F.when((F.col("n_facts") > 0) & (F.col("n_sections") > 0), 0.95).when((F.col("n_tables") > 0) & (F.col("n_sections") > 0), 0.88).when((F.col("n_tables") > 0) | (F.col("n_sections") > 0), 0.65)
    return documents.withColumn("confidence", c.otherwise(0.4))


def merge_narrative(documents: DataFrame, sections: DataFrame, html: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append the sections read from HTML to those of filings: (sections, documents).

    documents: accession, content_hash, skip; sections, html: accession, ordinal, body. Appended
    sections are numbered on from the last. A document gets html_status: skipped where asked for,
    success where HTML gave sections, else failed; and after a merge a new content_hash, the digest of
    its sections' digests in order (other documents keep theirs).
    """
    wanted = html.join(documents.where("NOT coalesce(skip, false)").select("accession").distinct(), "accession", "left_semi")
    last = sections.groupBy("accession").agg(F.max("ordinal").alias("_last"))
    more = wanted.hint("merge").join(last, "accession", "left").select("accession", (F.col("ordinal") + F.coalesce("_last", F.lit(-1)) + 1).alias("ordinal"), "body", F.lit(True).alias("from_html"))
    merged = sections.select("accession", "ordinal", "body", F.lit(False).alias("from_html")).unionByName(more)
    part = F.struct("ordinal", F.sha2(F.coalesce("body", F.lit("")), 256).alias("d"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["d"]), ","), 256)
    hashed = merged.groupBy("accession").agg(digest.alias("_hash"), F.bool_or("from_html").alias("_more"), F.count("*").alias("n"))
    rows = documents.hint("merge").join(hashed, "accession", "left")
    got = F.coalesce("_more", F.lit(False))
    status = F.when(F.coalesce("skip", F.lit(False)), "skipped").when(got, "success").otherwise("failed")
    out = rows.select("accession", F.when(got, F.col("_hash")).otherwise(F.col("content_hash")).alias("content_hash"), status.alias("html_status"), F.coalesce("n", F.lit(0)).alias("n_sections"))
    return merged, out
