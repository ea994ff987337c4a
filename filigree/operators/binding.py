"""Binding questions to filings, planning sections, and retrieving evidence, for tables of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intents as I
from ..functions import scalars as S
from ..functions.lineage import written
from . import filings as D
from .evidence import score_chunks


def bind_filings(questions: DataFrame, filings: DataFrame) -> DataFrame:
    """(query_id, position, accession, branch) of questions (query_id, issuer_id, question).

    Quarter over quarter takes the two newest quarterly reports; a comparison the year-over-year pair
    (quarterly if a quarterly measure is asked for, else annual); any other question the filing of its
    anchor, narrowed to the form it names where that leaves one. A pair that doesn't exist, or a
    question without a cue, binds nothing.
    """
    q = F.col("question")
    low = F.lower(q)
    qoq = F.lower(q).rlike("quarter over quarter|qoq|sequential quarter")
    quarterly = ~S.annual_requested(q) & low.rlike("revenue|sales|net income|earnings")
    branch = F.when(qoq, "qoq").when(S.query_flags(q)["is_comparison"], F.when(quarterly, "yoy_quarterly").otherwise("yoy_annual")).when(S.query_anchor(q).isNotNull(), "anchor").when(quarterly, "default_quarter")
    rows = questions.select("query_id", "issuer_id", branch.alias("branch"), S.query_anchor(q).alias("anchor"), S.form_preference(q).alias("form"))
    pairs = D.pair_qoq(filings).select("issuer_id", F.lit("qoq").alias("branch"), "accession", "partner")
    for flag, name in ((True, "yoy_quarterly"), (False, "yoy_annual")):
        pairs = pairs.unionByName(D.pair_yoy(filings, flag).select("issuer_id", F.lit(name).alias("branch"), "accession", "partner"))
    paired = rows.join(pairs, ["issuer_id", "branch"]).select("query_id", "branch", F.posexplode(F.array("accession", "partner")).alias("position", "accession"))
    want = F.coalesce("anchor", F.lit("latest_quarter"))
    single = rows.where("branch IN ('anchor', 'default_quarter')").withColumn("form_type", F.when(want == "latest_annual", "10-K").otherwise("10-Q"))
    single = single.join(D.two_newest(filings, "issuer_id", "form_type").hint("merge"), ["issuer_id", "form_type"])
    single = single.withColumn("accession", F.when(want == "prior_quarter", F.coalesce("second", "newest")).otherwise(F.col("newest")))
    return paired.unionByName(single.select("query_id", "branch", F.lit(0).alias("position"), "accession"))


def plan_sections(questions: DataFrame, toc: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, accession, section_id, position): the ``most`` sections of each bound filing whose kind
    the question's intent prefers; the first ones where none is preferred.

    questions: query_id, accession, question; toc: accession, section_id, label, ordinal.
    """
    intent = S.query_intent(F.col("question"))["intent"]
    kind = F.when(F.col("label").rlike("(?i)xbrl|financial"), "facts").otherwise(S.narrative_kind(F.col("label")))
    flags = S.query_flags(F.col("question"))
    prefer = (
        F.when(flags["is_mda"], F.when(kind == "md_and_a", 0)).when(flags["is_risk_only"], F.when(kind == "risk_factors", 0))
        .when(intent == "numeric", F.when(kind == "facts", 0)).otherwise(F.when(kind.isin("risk_factors", "md_and_a", "business_description"), 1))
    )
    rows = questions.join(toc.hint("merge"), "accession").withColumn("_p", F.coalesce(prefer, F.lit(9)))
    least = F.min("_p").over(Window.partitionBy("query_id", "accession"))
    rows = rows.withColumn("_least", least).where((F.col("_least") == 9) | (F.col("_p") < 9))
    w = Window.partitionBy("query_id", "accession").orderBy("_p", "ordinal", "section_id")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select("query_id", "accession", "section_id", "position")


def retrieve_evidence(planned: DataFrame, chunks: DataFrame, questions: DataFrame, most: int = 20, cut: int = 2000) -> DataFrame:
    """(query_id, rank, chunk_id, score, content_hash): the best chunks of the planned sections.

    chunks: section_id, chunk_id, text. The score counts the question's words of four letters or more
    in the text; excerpts are hashed as cut.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("question"), "[^a-z]+"), lambda w: F.length(w) >= 4))
    asked = questions.select("query_id", words.alias("words"))
    rows = planned.join(chunks, "section_id").join(asked, "query_id")
    low = F.lower("text")
    rows = rows.withColumn("score", F.size(F.filter("words", lambda w: low.contains(w))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    best = rows.select("query_id", "chunk_id", "score", "text", F.row_number().over(w).alias("rank")).where(F.col("rank") <= most)
    return best.select("query_id", "rank", "chunk_id", "score", F.sha2(F.left("text", F.lit(cut)), 256).alias("content_hash"))


def kind_of_section(section_id: Column) -> Column:
    """The narrative kind in a chunk's section id, as html-risk_factors-3; facts for the bucket of facts."""
    found = F.regexp_extract(section_id, "(risk_factors|md_and_a|business_description|financial_statements|legal_proceedings)", 1)
    return F.when(found != "", found).when(section_id.contains("facts"), "facts").otherwise("")


def rank_evidence(planned: DataFrame, chunks: DataFrame, questions: DataFrame, most: int = 20, cut: int = 2000) -> DataFrame:
    """(query_id, rank, chunk_id, accession, section_id, score, excerpt, content_hash): the best chunks of the
    planned sections by ``score_chunks``.

    planned: query_id, accession, section_id, position and kind. chunks: section_id, chunk_id, window,
    excerpt, label, concept (null for text), source, is_fact. questions: query_id, question, bias,
    qualitative and excluded (array of kinds).

    Sections and chunks of an excluded kind are left out. In the bucket of facts a question on figures
    sees the facts whose concept it asks for, else, if it is about revenue, revenue facts, else all.
    An empty excerpt is replaced by the label; chunks without either, and those scored below 0, don't
    count. Ties go by the section's position, the chunk's window and its id; a chunk counts once a
    question. The hash is that of the whole excerpt, which is then cut.
    """
    asked = questions.select("query_id", "question", "bias", "qualitative", F.coalesce("excluded", F.array().cast("array<string>")).alias("_out"))
    rows = planned.select("query_id", "accession", "section_id", "position", F.coalesce("kind", F.lit("")).alias("_kind")).join(asked.hint("merge"), "query_id")
    rows = rows.where(~F.array_contains("_out", F.col("_kind")))
    rows = rows.join(chunks.hint("merge"), "section_id").where(~F.array_contains("_out", kind_of_section(F.col("section_id"))))
    concept = F.coalesce(F.nullif("concept", F.lit("")), "label", F.lit(""))
    level = F.when(S.concept_matches_query(concept, F.col("question")), 2).when(I.has(F.lower("question"), ("revenue", "sales")) & concept.rlike("(?i)" + S.REVENUE_CONCEPTS), 1).otherwise(0)
    figures = (F.col("_kind") == "facts") & S.query_flags(F.col("question"))["is_financial"]
    rows = rows.withColumn("_level", F.when(figures, level).otherwise(0))
    best = F.max("_level").over(Window.partitionBy("query_id", "section_id"))
    rows = rows.withColumn("_best", best).where(F.col("_level") == F.col("_best"))
    shown = F.trim(F.coalesce(F.nullif(F.trim("excerpt"), F.lit("")), "label", F.lit("")))
    rows = score_chunks(rows.withColumn("excerpt", shown).where("excerpt <> ''")).where("score >= 0")
    order = (F.desc("score"), "position", "window", "chunk_id")
    once = Window.partitionBy("query_id", "chunk_id").orderBy(*order)
    rows = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= most)
    return rows.select("query_id", "rank", "chunk_id", "accession", "section_id", "score", F.left("excerpt", F.lit(cut)).alias("excerpt"), F.sha2("excerpt", 256).alias("content_hash"))


def scope_evidence(evidence: DataFrame, aligned: Column) -> DataFrame:
    """Of each query's evidence (query_id, kind, ...): HTML, then facts aligned with the period, or all
    facts where none is aligned."""
    rows = evidence.withColumn("_a", F.coalesce(aligned, F.lit(False)) & (F.col("kind") == "xbrl"))
    some = F.max(F.col("_a").cast("int")).over(Window.partitionBy("query_id"))
    return rows.withColumn("_some", some).where((F.col("kind") == "html") | F.col("_a") | (F.col("_some") == 0)).drop("_a", "_some")


def relevance_labels(items: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_id, n_chunks, reason): the chunks under each item's resolved sections; reason where there
    are none. items: item_id, section_id (null if unresolved)."""
    rows = written(items.groupBy("item_id").agg(F.count("section_id").alias("_s"), F.array_sort(F.collect_set("section_id")).alias("_of")), "chosen")
    under = chunks.select("section_id", "chunk_id").join(sections.select("section_id").distinct().hint("merge"), "section_id", "left_semi")
    # Items with the same sections have the same chunks, which are counted once for all of them.
    of = rows.select("_of").distinct().select("_of", F.explode("_of").alias("section_id"))
    counts = of.join(under.hint("merge"), "section_id").groupBy("_of").agg(F.count_distinct("chunk_id").alias("n_chunks"))
    g = rows.join(counts.hint("merge"), "_of", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    reason = F.when(F.col("_s") == 0, "unresolved_section").when(F.col("n_chunks") == 0, "no_chunks")
    return g.select("item_id", "n_chunks", reason.alias("reason"))
