"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import fresh, others, read

#: A profile has the most frequent n-grams (one to three letters, words padded by a blank) in rank
#: order; an n-gram of a document that a profile lacks costs as much as the last rank.
PROFILE = 300
#: Documents of each language that the profiles are fitted on (a stated bound on the fit).
FIT_PER_LANG = 20_000
#: Most languages that get a profile: the driver and every task hold them all (2,400 bytes each).
MAX_LANGS = 1_000
_CHUNK = 1 << 20
_SPACE = 32


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with each run of other characters as one blank."""
    if text.isascii():
        a = np.frombuffer(text.lower().encode("ascii"), np.uint8).astype(np.int64)
        keep = (a >= 97) & (a <= 122)
    else:
        a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        keep = (a >= 97) & (a <= 122)
        odd = np.flatnonzero(a > 127)
        if odd.size:
            kinds, at = np.unique(a[odd], return_inverse=True)
            keep[odd] = np.fromiter((chr(c).isalpha() for c in kinds), bool, kinds.size)[at]
    a = np.where(keep, a, _SPACE)
    a = np.concatenate(([_SPACE], a, [_SPACE]))
    blank = a == _SPACE
    return a[~(blank & np.concatenate(([False], blank[:-1])))]


def _gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (21 bits a letter) and counts of a text's n-grams, whatever its length.

    Long texts are counted by pieces that end at a blank-free overlap of two letters.
    """
    a = _letters(text or "")
    if a.size < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes, counts = [], []
    for at in range(0, a.size, _CHUNK):
        x = a[at : at + _CHUNK + 2]
        own = min(_CHUNK, a.size - at)
        two = (x[:-1] << 21) | x[1:]
        three = (two[:-1] << 21) | x[2:]
        one = x[:own]
        got = np.concatenate((one[one != _SPACE], two[:own], three[:own][(x[1:-1] != _SPACE)[:own]]))
        c, n = np.unique(got, return_counts=True)
        codes.append(c)
        counts.append(n)
    if len(codes) == 1:
        return codes[0], counts[0]
    c, at = np.unique(np.concatenate(codes), return_inverse=True)
    return c, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, dict[int, int]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            c, n = _gram_counts(text)
            own = by_lang.setdefault(lang, {})
            for k, v in zip(c.tolist(), n.tolist(), strict=True):
                own[k] = own.get(k, 0) + v
        for lang, own in by_lang.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())],
                ["lang", "gram", "n"],
            )


def fit_profiles(labelled: DataFrame, size: int = PROFILE, per_lang: int = FIT_PER_LANG) -> dict[str, list[int]]:
    """Profiles, n-gram codes in rank order, by language; ties rank by code.

    labelled: text, lang and doc_id. Rows without lang don't count. Where a language has more than
    ``per_lang`` documents, those whose id and text hash under the fitting fraction are used (whole
    texts), so ids that repeat or are missing draw neither all nor nothing. Of more than MAX_LANGS
    values of lang, the most frequent get a profile (ties: the one that sorts first). The driver gets
    ``size`` codes a language. No labelled row: no profile.
    """
    rows = labelled.where("lang is not null").select("text", "lang", "doc_id")
    frequent = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    totals = {r["lang"]: r["n"] for r in frequent.collect()}
    if not totals:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1.0, per_lang / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    counted = (
        rows.where(draw < F.try_element_at(share, F.col("lang")))
        .select("text", "lang")
        .mapInArrow(_count_batches, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("rank", first).where(F.col("rank") <= size)
    grams = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("grams"))
    return {r["lang"]: [g["gram"] for g in r["grams"]] for r in grams.collect()}


class _Scorer:
    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs = sorted(profiles)
        self.size = size
        every = np.unique(np.concatenate([np.asarray(profiles[k], np.int64) for k in self.langs] or [np.empty(0, np.int64)]))
        self.known = every
        self.ranks = np.full((len(self.langs), every.size + 1), -1, np.int64)
        for i, k in enumerate(self.langs):
            self.ranks[i, np.searchsorted(every, profiles[k])] = np.arange(len(profiles[k]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes, counts = _gram_counts(text)
        if not codes.size or not self.langs:
            return "und", 0.0
        if codes.size > self.size:  # only what can be among the first needs sorting
            least = np.partition(counts, codes.size - self.size)[codes.size - self.size]
            codes, counts = codes[counts >= least], counts[counts >= least]
        codes = codes[np.lexsort((codes, -counts))][: self.size]
        at = np.searchsorted(self.known, codes)
        at[at == self.known.size] = 0
        at = np.where(self.known[at] == codes, at, self.known.size) if self.known.size else at
        theirs = self.ranks[:, at]
        apart = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(codes.size)))
        total = apart.sum(axis=1)
        best = int(total.argmin())
        return self.langs[best], 1.0 - float(total[best]) / (self.size * codes.size)


def identify(documents: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = PROFILE) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (one minus the distance as a share of the largest possible).

    ``und`` with score 0 where the text is null or has no letter, or there is no profile. Equal
    distances go to the language that sorts first. Whole texts are read, however long, and repeated
    rows are judged each; the other columns pass through, whatever their names, except that columns of
    these two names are replaced. An empty table gives an empty one.
    """
    columns = others(documents, "lang_pred", "score")
    (judged,) = fresh(documents, "judged")

    @F.pandas_udf("lang_pred string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = _Scorer(profiles, size)
        for texts in batches:
            yield pd.DataFrame([judge(t) for t in texts], columns=["lang_pred", "score"])

    found = documents.select(*columns, score(F.col(text)).alias(judged))
    return found.select(*columns, F.col(judged)["lang_pred"].alias("lang_pred"), F.col(judged)["score"].alias("score"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = fit_profiles(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
