"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each five-word shingle is hashed once; the top bits of the hash choose a bin and each bin keeps its
least hash. Empty bins are filled by optimal densification: each follows its own fixed random order
of bins to the first that isn't empty. The low bits of the bins, packed as hex digits, are the
fingerprint; equal digits, corrected for chance agreement, estimate the Jaccard similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import let, read, stored, words_of

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
KEPT_BITS = 4  # of each bin; one hex digit
_SHIFT = 64 - BIN_BITS
_REST = (1 << _SHIFT) - 1
#: Greatest hash of each bin, in signed order; stands in an empty bin.
_LAST = [(b << _SHIFT) | _REST for b in range(-BINS // 2, BINS // 2)]
#: Bins that an empty bin tries in constant time before it ranks all filled ones.
TRIES = 5


def shingle_hashes(words: Column) -> Column:
    """A hash for each five-word window; texts of one to four words are one shingle."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[words[i + k] for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, windows).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def _empty(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_REST)) == F.lit(_REST)


def _densified(bins: Column) -> Column:
    """Every bin's value, empty bins filled; an array without a filled bin gives an empty array."""

    def fill(filled: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            out = F.when(~_empty(x), x)
            for t in range(TRIES):
                there = bins[F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int")]
                out = out.when(~_empty(there), there)
            ranked = F.transform(filled, lambda y: F.struct(F.xxhash64(F.shiftright(y, _SHIFT), j).alias("r"), y.alias("y")))
            return out.otherwise(F.array_min(ranked)["y"])

        return F.when(F.size(filled) > 0, F.transform(bins, one)).otherwise(F.array().cast("array<bigint>"))

    return let(F.filter(bins, lambda x: ~_empty(x)), fill)


def digits(text: Column) -> Column:
    """The fingerprint as an array of BINS small numbers; empty for a text without a word."""

    def bins(h: Column) -> Column:
        firsts = F.filter(
            h, lambda x, i: F.when(i == 0, F.lit(True)).otherwise(F.shiftright(x, _SHIFT) != F.shiftright(h[F.greatest(i - 1, F.lit(0))], _SHIFT))
        )
        return let(firsts, _densified)

    hashes = let(words_of(text), lambda w: F.concat(shingle_hashes(w), F.array(*[F.lit(x) for x in _LAST])))
    low = let(F.sort_array(hashes), bins)
    return F.transform(low, lambda x: x.bitwiseAND(F.lit((1 << KEPT_BITS) - 1)).cast("tinyint"))


def packed(d: Column) -> Column:
    """Hex digits of a fingerprint; the empty string for a text without a word."""
    return F.lower(F.array_join(F.transform(d, lambda x: F.hex(x.cast("bigint"))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity estimated from two fingerprints, 0 to 1.

    Unrelated bins agree by chance once in ``2 ** KEPT_BITS``, which is taken out. Two texts without
    a word are alike; one such text is like no other.
    """
    chance = 1.0 / (1 << KEPT_BITS)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))
    estimate = F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(estimate)


def fingerprints(documents: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """Add the packed fingerprint of every text (null: as empty). A projection, no shuffle; equal
    texts have equal fingerprints, whatever else their rows hold. A column named ``into`` is
    replaced."""
    return documents.withColumn(into, packed(digits(F.col(text))))


def _followers(documents: DataFrame) -> DataFrame:
    """For each document, the one before it in descending doc_id: (doc_id, h), (to_id, to_h), take, copies.

    Only ids, text hashes and sizes are range-partitioned and sorted; the partitions' ends, a row
    each, are linked in a ring. Rows that repeat a doc_id and text count once; ids that repeat with
    other texts follow each other by text hash; null ids come last.
    """
    ids = documents.groupBy("doc_id", "h").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    dealt = ids.repartitionByRange(F.desc_nulls_last("doc_id"), F.asc("h")).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "order")
    w = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), "h")
    me = F.struct("doc_id", "h", "n")
    ordered = dealt.withColumns({"place": F.row_number().over(w), "before": F.lag(me).over(w)})
    ends = ordered.groupBy("part").agg(F.max_by(me, "place").alias("last"))
    ring = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(Window.orderBy("part")), F.last("last").over(ring)).alias("last"))
    # One row for each partition of the range shuffle, so its size is that setting's.
    linked = ordered.join(F.broadcast(ends), "part")
    to = F.coalesce("before", "last")
    return linked.select("doc_id", "h", "copies", to["doc_id"].alias("to_id"), to["h"].alias("to_h"), F.floor(to["n"] / 3).cast("int").alias("take"))


def edit_neighbours(documents: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text, and compare them and the next document.

    documents: doc_id, text (null: empty). The edited text is the text whose last third is replaced
    by as much of the beginning of the next document in descending doc_id (after the last: the
    first). Texts move once, by id; then each sends its beginning and fingerprint to the one before
    it. Exact repeats of a row share the result; see ``_followers`` for repeated and null ids.
    """
    ids = F.col("doc_id").cast("long")
    base = documents.select(ids.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    follow = stored(_followers(base.select("doc_id", "h", F.length("text").cast("long").alias("n"))), "followers")
    repeats = follow.agg(F.max("copies")).first()[0] or 0
    # Both joins ask for the same columns dealt by the same three keys, so the texts move once. They
    # merge sorted rows, which can spill; a hash table of beginnings couldn't.
    key = ["id", "no_id", "h"]
    marked = base.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "h", "text", digits(F.col("text")).alias("d"))
    f = follow.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "h", "to_id", "to_h", "take")
    given = marked.join(f.hint("merge"), key).select(
        F.coalesce("to_id", F.lit(0)).alias("id"), F.col("to_id").isNull().alias("no_id"), F.col("to_h").alias("h"),
        F.left(F.col("text"), F.col("take")).alias("beginning"), F.col("d").alias("next_d"),
    )
    if repeats > 1:  # repeats of the next document would multiply this one
        given = given.dropDuplicates(key)
    both = marked.join(given.hint("merge"), key)
    n = F.length("text").cast("long")
    edited = F.concat(F.left(F.col("text"), (n - F.floor(n / 3)).cast("int")), F.col("beginning"))
    out = both.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), n.alias("n_chars"), edited.alias("edited"), "d", "next_d")
    out = out.withColumn("edited_d", digits(F.col("edited")))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("d")).alias("fingerprint"),
        packed(F.col("edited_d")).alias("edited_fingerprint"), likeness(F.col("d"), F.col("edited_d")).alias("near_edited"),
        likeness(F.col("d"), F.col("next_d")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_neighbours(read(spark, sf_dir, "documents"))
