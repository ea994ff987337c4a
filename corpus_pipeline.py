"""Corpus pipeline: quality classifier, language identification, near-duplicate removal, packing.

Each stage works on all that its predecessor kept, which is written and read again in between. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import language, near_duplicates, packing, quality_classifier
from filigree.llm.work import read, stored

#: A document whose best profile is no nearer than this is in none of the known languages.
LEAST_LIKENESS = 0.1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the co-trained classifier on the labels and keep what it scores as good."""
    pages = read(spark, sf_dir, "pages")
    model = quality_classifier.fit(docs, pages, read(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, pages, model).where("kept").select(*docs.columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit profiles on the kept documents and drop those without letters or near no profile."""
    found = language.identify(docs, language.fit_profiles(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LIKENESS)).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of copies and near copies."""
    return near_duplicates.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack what is left into sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("language ID", languages), ("n-gram Jaccard join", deduplicate), ("packing", pack)]

#: The models and the tokenizer can't be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
