"""Exact dedup by deterministic block naming, in DataFrame functions only.

Every text is cut into blocks of a fixed number of code points. The blocks are sorted and
each gets its rank as its name, an integer. Then adjacent names are paired, the distinct pairs are
sorted and named likewise, and so on until one name is left of each text. Two texts have the same
last name, after the same number of rounds, exactly if they are equal: names are ranks, not digests,
so nothing can collide. A block or pair that occurs once belongs to a text without a copy; that text
is told apart then and goes no further, so only what may be a copy is named again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import new_path
from .near_duplicates import look_up
from .work import read, stored

#: Code points of a block.
BLOCK = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_IN_PART = (1 << 33) - 1


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def blocks_of(text: Column, size: int = BLOCK) -> Column:
    """The text's blocks in order, the last one shorter; one empty block for the empty text. One pass, however long."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _names(units: DataFrame, name: str) -> DataFrame:
    """(unit, n, name) of the units that occur n > 1 times; name: the unit's rank among them, from 0.

    Units are sorted by a hash and then by themselves: so the bounds of the range partitions, which
    the driver samples, are eight bytes each, and few comparisons look at a whole block. Each
    partition counts its own, and the counts before it, a row for each partition, are added.
    """
    often = units.groupBy("unit").agg(F.count("*").alias("n")).where("n > 1")
    hashed = often.withColumn("h", F.xxhash64("unit"))
    ranged = hashed.repartitionByRange("h").sortWithinPartitions("h", "unit").drop("h").withColumn("at", F.monotonically_increasing_id())
    ranged = stored(ranged, name).withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit(_IN_PART))})
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    # One row for each partition of the range shuffle, so its size is that setting's.
    return ranged.join(F.broadcast(starts), "part").select("unit", "n", (F.col("start") + F.col("at")).alias("name"))


def _renamed(units: DataFrame, total: int, name: str) -> DataFrame:
    """(row, doc_id, names): the names of each text's units in order, for texts all of whose units occur more than once."""
    named = look_up(units, stored(_names(units, f"{name}-ranks"), f"{name}-names"), "unit", total)
    own = named.groupBy("row", "doc_id", "size").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("names"))
    return stored(own.where(F.size("names") == F.col("size")).select("row", "doc_id", F.col("names.name").alias("names")), name)


def identities(texts: DataFrame) -> DataFrame:
    """(row, doc_id, identity) of the texts that have a copy: identity is (rounds, name).

    texts: row (unique), doc_id, blocks (array of strings). The driver sees two numbers a round; the
    rounds are the binary logarithm of the most blocks that a copied text has.
    """
    parts, total = texts.select("row", "doc_id", F.col("blocks").alias("units")), texts.agg(F.sum(F.size("blocks"))).first()[0] or 0
    done: list[DataFrame] = []
    while total:
        units = parts.select("row", "doc_id", F.size("units").alias("size"), F.posexplode("units").alias("pos", "unit"))
        own = _renamed(units, total, f"names-{len(done)}")
        done.append(own.where(F.size("names") == 1).select("row", "doc_id", F.struct(F.lit(len(done)).alias("round"), F.col("names")[0].alias("name")).alias("identity")))
        pair = F.transform(
            F.sequence(F.lit(0), F.size("names") - 1, F.lit(2)),
            lambda i: F.struct(F.get("names", i).alias("a"), F.coalesce(F.get("names", i + 1), F.lit(-1)).alias("b")),
        )
        parts = own.where(F.size("names") > 1).select("row", "doc_id", pair.alias("units"))
        total = parts.agg(F.sum(F.size("units"))).first()[0] or 0
    if not done:
        return texts.select("row", "doc_id", F.struct(F.lit(0).alias("round"), F.col("row").alias("name")).alias("identity")).where("false")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def duplicates(documents: DataFrame, size: int = BLOCK, fold: Callable[[Column], Column] = ascii_lower) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text; null text: empty): doc_id, keep_id, group_size, kept, digest.

    Rows whose folded texts are equal are a group. Of a group the row with the largest doc_id is
    kept, a null id only if all are null; of rows that share that id, one is. digest: SHA-256 of the
    folded text. Texts are folded and cut once and written; a text then moves at most twice, to count
    its blocks and to fetch the names of those that occur again. Blocks that very many texts share
    are fetched without a shuffle (``look_up``). No rows give no rows; other columns are ignored.
    """
    folded = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), fold(F.coalesce("text", F.lit(""))).alias("t")
    )
    path = new_path(documents.sparkSession, "blocks")
    cut = folded.select("row", "doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), blocks_of(F.col("t"), size).alias("blocks"))
    cut.write.option("compression", "zstd").parquet(path)
    texts = documents.sparkSession.read.schema(cut.schema).parquet(path)
    copied = stored(identities(texts), "identities")
    groups = copied.groupBy("identity").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n"))
    groups = stored(groups.select("identity", "keep", "n", F.col("n").alias("group_size")), "groups")
    members = look_up(copied.select("identity", "row"), groups, "identity", copied.count()).select("row", "keep", "group_size")
    out = texts.select("row", "doc_id", "digest").join(members.hint("merge"), "row", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep.row"))).alias("kept"), "digest",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = f"""
WITH folded AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t, row_number() OVER () AS r FROM documents),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, r) AS place, count(*) OVER (PARTITION BY t) AS group_size,
                       max(doc_id) OVER (PARTITION BY t) AS keep_id FROM folded)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM ranked
"""
