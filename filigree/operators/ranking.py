"""Evidence ranking: topic scores, period alignment, balancing, exact dense top-k in blocks."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words, patterns and points of the topic score.
#: (words of the question, words of the excerpt, points for each of the latter).
TOPICS = (
    (("risk",), ("risk",), 3.0), (("cyber",), ("cyber",), 8.0),
    (("supply chain", "operational disruption"), ("supply chain", "disruption", "shortage", "logistics", "operating"), 4.0),
    (("economic condition", "global economic"), ("economic", "recession", "slowdown", "demand", "inflation", "gdp"), 4.0),
    (("segment",), ("upstream", "energy products", "chemical products", "specialty products", "segment"), 5.0),
    (("divest", "divestment", "proceeds"), ("divest", "singapore", "mobil argentina", "proceeds", "1.1 billion", "asset sale"), 8.0),
)
#: Three points each where question and excerpt both have the word.
SHARED_TOPICS = ("geopolitic", "international", "trade", "tariff", "sanction", "war", "unrest", "conflict")
GEOPOLITICAL = r"(?i)\b(geopolitic|international operation|trade polic|tariff|sanction|civil (unrest|disturbance)|terrorism|cross-border|trade barrier|war)\b"
HIGHLIGHT_NOISE = (
    r"(?i)(first quarter of 20[0-9]{2}|second quarter of 20[0-9]{2}|total sales and revenues were|credit facility|covenant leverage|interest rate derivatives|"
    r"company trends and expectations|price realization|sales were higher across)"
)
CURRENCY, WORLD = r"\b(currency|income/expense|interest expense|derivatives)\b", r"\b(risk|tariff|sanction|geopolitic|war|unrest|trade barrier)\b"
OFF_SUBJECT = "(controls and procedures|exhibit 31|dealer inventories|financial products segment)"
#: Queries and vectors that meet in one task.
BLOCK_QUERIES, BLOCK_VECTORS = 2_048, 16_384


def topic_score(question: Column, excerpt: Column, section: Column | None = None) -> Column:
    """Points of an excerpt, and of the section it is in, for what a question is about."""
    q, e = F.lower(question), F.lower(excerpt)
    out = F.lit(0.0)
    for asked, words, points in TOPICS:
        on = reduce(lambda a, b: a | b, [q.contains(w) for w in asked])
        hits = reduce(lambda a, b: a + b, [e.contains(w).cast("int") for w in words])
        out = out + F.when(on, hits * points).otherwise(0.0)
    s = F.lower(F.lit("") if section is None else section)
    rules = [(q.contains(w) & e.contains(w), 3.0) for w in SHARED_TOPICS]
    rules += [
        (q.rlike(GEOPOLITICAL) & excerpt.rlike(GEOPOLITICAL), 5.0), (e.rlike(HIGHLIGHT_NOISE), -12.0), (e.rlike(CURRENCY) & ~e.rlike(WORLD), -10.0), (e.rlike(OFF_SUBJECT), -20.0),
        (e.contains("forward-looking") & e.contains("sustainability"), -15.0), (s.contains("risk_factors"), 3.0),
        (s.contains("md_and_a") & (q.contains("divest") | q.contains("md&a") | q.contains("management")), 4.0),
    ]
    for on, points in rules:
        out = out + F.when(on, points).otherwise(0.0)
    return out


def rank_by_topic(pairs: DataFrame, most: int = 8) -> DataFrame:
    """The first ``most`` excerpts (query_id, question, chunk_id, excerpt, ordinal) of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal", "chunk_id")
    rows = pairs.withColumn("score", topic_score(F.col("question"), F.col("excerpt"))).withColumn("position", F.row_number().over(w))
    return rows.where(F.col("position") <= most)


def period_alignment(start: Column, end: Column, anchors: Column, tolerance: int = 7, mismatch: int = 90) -> Column:
    """8 if an anchor date lies in the period or within ``tolerance`` days of its end; -15 if the
    nearest is over ``mismatch`` days away; else -3; 0 without an anchor; 8 without a date."""
    apart = F.array_min(F.transform(anchors, lambda a: F.abs(F.datediff(end, a))))
    inside = F.exists(anchors, lambda a: (start < end) & (a >= start) & (a <= end))
    return (
        F.when(anchors.isNull() | (F.size(anchors) == 0), 0.0).when(end.isNull(), 8.0).when(F.coalesce(inside, F.lit(False)) | (apart <= tolerance), 8.0)
        .when(apart > mismatch, -15.0).otherwise(-3.0)
    )


def balance_by_accession(evidence: DataFrame, most: int) -> DataFrame:
    """``most`` excerpts a query: first the longest floor(most / n) of each of its n accessions, then the
    rest in their own order. evidence: query_id, accession, chunk_id, excerpt, ordinal."""
    q = Window.partitionBy("query_id")
    n = F.size(F.collect_set("accession").over(q))
    longest = F.row_number().over(Window.partitionBy("query_id", "accession").orderBy(F.desc(F.length("excerpt")), "ordinal"))
    rows = evidence.withColumns({"_of": n, "_l": longest}).withColumn("_first", F.col("_l") <= F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("_of"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("_first"), F.when(F.col("_first"), F.col("accession")), F.when(F.col("_first"), F.col("_l")), "ordinal")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).drop("_of", "_l", "_first")


def drop_boilerplate(evidence: DataFrame, boilerplate: Column) -> DataFrame:
    """Leave out boilerplate excerpts of a query unless all of them are."""
    rows = evidence.withColumn("_b", F.coalesce(boilerplate, F.lit(False)))
    all_b = F.min("_b").over(Window.partitionBy("query_id"))
    return rows.withColumn("_all", all_b).where("_all OR NOT _b").drop("_b", "_all")


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine top-k: (query_id, vec_id, score, rank); ties by vec_id.

    queries: query_id, embedding; vectors: vec_id, embedding (null, zero and other-length vectors
    score 0). Both are dealt into blocks; each pair of blocks is a task of bounded size that multiplies
    matrices and keeps its own k best, and a window takes the best of those.
    """
    nq, nv = queries.count(), vectors.count()
    a, b = max(1, math.ceil(nq / BLOCK_QUERIES)), max(1, math.ceil(nv / BLOCK_VECTORS))
    left = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(a)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("j"))
    right = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(b)).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("i"))
    left, right = left.withColumn("i", F.col("i").cast("long")), right.withColumn("i", F.col("i").cast("long"))
    left, right = left.withColumn("j", F.col("j").cast("long")), right.withColumn("j", F.col("j").cast("long"))

    def unit(column: pd.Series, dims: int) -> np.ndarray:
        m = np.stack([np.asarray(v, float) if v is not None and len(v) == dims else np.zeros(dims) for v in column])
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def best(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(qs) and len(vs):
            vs = vs.sort_values("vec_id", kind="stable")
            dims = max((len(v) for v in qs["embedding"] if v is not None), default=1)
            right_m, ids = unit(vs["embedding"], dims).T, vs["vec_id"].to_numpy()
            for at in range(0, len(qs), 256):
                some = qs.iloc[at : at + 256]
                s = np.round(unit(some["embedding"], dims) @ right_m, 12)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                out["query_id"] += np.repeat(some["query_id"].to_numpy(), top.shape[1]).tolist()
                out["vec_id"] += ids[top].ravel().tolist()
                out["score"] += np.take_along_axis(s, top, axis=1).ravel().tolist()
        return pd.DataFrame(out)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
