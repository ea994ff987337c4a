"""Readers and writers of filing packages, graphs, taxonomies, benchmark items and results.

Schemas are explicit; nothing is inferred. Paths go to Spark's readers as they are, so any store that
Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .taxonomies import local_name

MANIFEST = (
    "resolution struct<ticker string, cik string, accession string, form_type string, filed_at date, period_end date, edgar_filing_url string>, "
    "artifacts array<struct<filename string, role string, url string, content_hash string>>, complete boolean"
)
SECTION = "struct<section_id string, title string, level int, text string, parent_section_id string, source_type string>"
DOCUMENT = (
    "filing struct<cik string, accession string, form_type string, filed_at date, period_end date>, "
    f"sections array<{SECTION}>, tables array<struct<table_id string, headers array<array<string>>, rows array<array<string>>, footnote_ids array<string>>>, "
    "footnotes array<struct<footnote_id string, text string, parent_table_id string>>, parse_confidence double"
)
ITEM = (
    "item_id string, dataset string, question string, inspiration_profile string, ground_truth struct<answer string, rubric string, relevant_chunk_ids array<string>>, "
    "expected_bindings struct<accessions array<string>, fiscal_periods array<string>>, expected_section_paths array<string>, multi_filing_required boolean"
)
RESULT = "item_id string, status string, outcome_score double, value_alignment double, ranking struct<mrr double, map_score double, ndcg_at_10 double>"


def read_filing_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row a package: the filing's columns, artifacts, complete."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select("resolution.*", "artifacts", "complete")


def read_parsed_documents(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The child tables of parsed filings: sections, tables, table_rows, footnotes."""
    docs = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    key = F.col("filing.accession").alias("accession")
    tables = docs.select(key, F.posexplode("tables").alias("ordinal", "t")).select("accession", "ordinal", "t.*")
    return {
        "documents": docs.select("filing.*", "parse_confidence"),
        "sections": docs.select(key, F.posexplode("sections").alias("ordinal", "s")).select("accession", "ordinal", "s.*"),
        "tables": tables.drop("rows"),
        "table_rows": tables.select("accession", "table_id", F.posexplode("rows").alias("row", "cells")),
        "footnotes": docs.select(key, F.inline("footnotes")),
    }


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML files, with ``file``. Data are named by the key table of their own file,
    since key ids are local to it; a key that a file doesn't declare has no name and is left out."""
    data = "array<struct<_VALUE string, _key string>>"
    file = F.col("_metadata.file_path").alias("file")

    def tags(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    names = tags("key", "`_id` string, `_attr.name` string").select(file, F.col("_id").alias("key"), F.col("`_attr.name`").alias("name"))
    names = names.groupBy("file", "key").agg(F.min("name").alias("name"))

    def values(rows: DataFrame, ids: list[str]) -> DataFrame:
        rows = rows.select(file, *ids, "data").withColumn("_row", F.monotonically_increasing_id())
        pairs = rows.select("file", "_row", *ids, F.posexplode_outer("data").alias("_at", "d")).select("file", "_row", *ids, "_at", F.col("d._key").alias("key"), F.col("d._VALUE").alias("value"))
        named = pairs.join(names.hint("merge"), ["file", "key"], "left").groupBy("file", "_row", *ids)
        entries = F.filter(F.array_sort(F.collect_list(F.struct("_at", "name", "value"))), lambda e: e["name"].isNotNull())
        # Of a name that is given twice, the last value counts.
        last = F.filter(entries, lambda e: ~F.exists(entries, lambda o: (o["name"] == e["name"]) & (o["_at"] > e["_at"])))
        return named.agg(F.map_from_entries(F.transform(last, lambda e: F.struct(e["name"], e["value"]))).alias("properties")).drop("_row")

    n = values(tags("node", f"`_id` string, data {data}"), ["_id"]).withColumnRenamed("_id", "node_id")
    e = values(tags("edge", f"`_source` string, `_target` string, data {data}"), ["_source", "_target"])
    e = e.withColumnsRenamed({"_source": "source_id", "_target": "target_id"})
    return n, e.withColumn("edge_type", F.try_element_at("properties", F.lit("edge_type")))


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges, partitioned by issuer_id and snapshot_id; a rerun replaces its partitions."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("issuer_id", "snapshot_id").parquet(f"{path}/{name}")


def concept_labels(locators: DataFrame, arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """(concept, label) of a label linkbase: arcs (source, target) joined with locators (label, href) and
    labels (label, text); see ``taxonomies.read_taxonomies`` for whole folders of linkbases."""
    rows = arcs.join(locators.hint("merge"), arcs["source"] == locators["label"]).select("href", "target").join(labels.withColumnRenamed("label", "_l").hint("merge"), F.col("target") == F.col("_l"))
    return rows.groupBy(local_name(F.col("href")).alias("concept")).agg(F.min("text").alias("label"))


def calc_hierarchy(arcs: DataFrame) -> DataFrame:
    """(concept, parents, children) of summation arcs (parent, child)."""
    down = arcs.groupBy(F.col("parent").alias("concept")).agg(F.array_sort(F.collect_set("child")).alias("children"))
    up = arcs.groupBy(F.col("child").alias("concept")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    return down.join(up, "concept", "full").select("concept", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("parents", "children")])


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark items, a JSON object a line; blank lines don't count."""
    return spark.read.schema(ITEM).json(path).where("item_id IS NOT NULL")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of all variants under ``path``/<variant>/results.json, with variant_id."""
    rows = spark.read.schema(RESULT).json(f"{path}/*/results.json", multiLine=True)
    return rows.withColumn("variant_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_path_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, accession), distinct, of a graph path index."""
    rows = spark.read.schema("paths array<string>").json(path, multiLine=True).select(F.explode("paths").alias("path")).distinct()
    return rows.withColumn("accession", F.substring_index("path", "/", 1))


def write_metric_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A directory of CSV files with a header for each table."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def vectors_valid(vectors: DataFrame, chunks: DataFrame, dims: int) -> DataFrame:
    """One row: vectors without a chunk, chunks without a vector, wrong sizes, and whether all fit."""
    both = vectors.select("node_id", F.size("embedding").alias("n")).join(chunks.select("node_id", F.lit(True).alias("known")), "node_id", "full")
    g = both.agg(F.count_if(F.col("known").isNull()).alias("extra"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") != dims).alias("wrong_size"))
    return g.withColumn("valid", (F.col("extra") + F.col("missing") + F.col("wrong_size")) == 0)


def validate_packages(artifacts: DataFrame, files: DataFrame, least_zip: int = 1000, least_instance: int = 100) -> DataFrame:
    """(accession, errors): artifacts (accession, filename, role) against listed files (accession,
    filename, length)."""
    rows = artifacts.join(files, ["accession", "filename"], "left")
    role = F.col("role")
    has = lambda r, n: F.max(((role == r) & (F.col("length") >= n)).cast("int"))
    g = rows.groupBy("accession").agg(
        F.max(F.col("length").isNull().cast("int")).alias("_gone"), F.coalesce(has("instance", least_instance), F.lit(0)).alias("_i"), F.coalesce(has("schema", 0), F.lit(0)).alias("_s"),
        F.max(((role == "xbrl_zip") & (F.col("length") < least_zip)).cast("int")).alias("_z"),
    )
    errors = F.array_compact(F.array(F.when(F.col("_gone") == 1, "missing_artifact"), F.when(F.col("_i") == 0, "no_instance"), F.when(F.col("_s") == 0, "no_schema"), F.when(F.col("_z") == 1, "small_zip")))
    return g.select("accession", errors.alias("errors"))


def package_hashes(files: DataFrame) -> DataFrame:
    """(accession, content_hash) over the files (accession, filename, content) of a package in order of
    name, its manifest left out."""
    one = files.where("filename <> 'manifest.json'").select("accession", "filename", F.sha2("content", 256).alias("h"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("filename", "h"))), lambda x: F.concat_ws(":", x["filename"], x["h"]))
    return one.groupBy("accession").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("content_hash"))


def narrative_files(files: DataFrame) -> DataFrame:
    """(accession, filename) of each package's main document: a dated name before any other, then the
    longest, then the first; exhibits' and rendered tables' pages are left out."""
    from pyspark.sql import Window

    n = F.lower("filename")
    rows = files.where(n.endswith(".htm") & ~n.startswith("a10-k") & ~n.rlike(r"^r[0-9]+\.htm$"))
    main = n.rlike(r"-[0-9]{8}\.htm$") & ~n.contains("exhibit")
    w = Window.partitionBy("accession").orderBy(F.desc(main), F.desc(F.length("filename")), "filename")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("accession", "filename")
