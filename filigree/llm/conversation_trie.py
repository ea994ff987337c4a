"""Prefix trie of conversations by fixed-length block hashing.

Conversations are cut into blocks of BLOCK turns. The digest of all blocks so far identifies what a
conversation begins with, so conversations are grouped by successive blocks first, not by turns:
those with the same blocks so far and the same next block become one row with a count. Where all
conversations that go on from a place share the next block, its turns are nodes as they stand. Only
where several next blocks follow one place do siblings diverge, and only there are the turns inside
the blocks grouped.

Sums over subtrees need no walk. Each node belongs to its smallest member, and what a conversation
owns is the end of its path. So a sum over a subtree is the sum, over the node's members, of what
each owns, less what the smallest member owns above the node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import numbered, ordered
from .near_duplicates import look_up
from .work import read, stored, words_of

#: Turns of a block.
BLOCK = 4
#: Rows of a conversation that one window sums up.
SEGMENT = 4096
#: Ids of a conversation list that are joined at once.
CHUNK = 512
_ROOT = "struct(0L as a, 0L as b)"
_IDS = "node struct<a:bigint,b:bigint>"


def digested(conversations: DataFrame) -> DataFrame:
    """(conv, place, digest, words) of every turn with a conv_id: its place from 0 by turn (null first;
    ties by role, then text), a digest of role and text (null: empty) and the number of words.

    Texts move once, sorted by conversation; one conversation may spread over many tasks. Rows without
    a conv_id belong to no conversation.
    """
    full = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), full("role").alias("role"), full("text").alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    keep = ["conv", digest.alias("digest"), F.size(words_of(F.col("text"))).cast("long").alias("words")]
    return numbered(ordered(rows, ["conv"], ["turn", "role", "text"], "turns", keep), ["conv"], "place").select("conv", "place", "digest", "words")


def _running(df: DataFrame, key: str, at: Column, fn: str, values: list[str]) -> DataFrame:
    """Replace ``values`` by their running totals (``fn``: sum or bit_xor) along ``at`` in each key.

    A window sees SEGMENT rows of a key; the totals of whole segments are added.
    """
    df = df.withColumns({"_at": at, "_seg": F.floor(at / SEGMENT)})
    w = Window.partitionBy(key, "_seg").orderBy("_at")
    runs = df.withColumns({v: F.expr(f"{fn}({v})").over(w) for v in values})
    before = Window.partitionBy(key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(key, "_seg").agg(*[F.expr(f"{fn}({v})").alias(v) for v in values])
    totals = totals.select(key, "_seg", *[F.expr(f"{fn}({v})").over(before).alias(f"_{v}") for v in values]).where("_seg > 0")
    both = runs.join(totals.hint("merge"), [key, "_seg"], "left")
    add = (lambda v: F.col(v) + F.coalesce(f"_{v}", F.lit(0))) if fn == "sum" else (lambda v: F.col(v).bitwiseXOR(F.coalesce(f"_{v}", F.lit(0))))
    return both.withColumns({v: add(v) for v in values}).drop("_at", "_seg", *[f"_{v}" for v in values])


def _node(*of: Column) -> Column:
    """A 128-bit name."""
    return F.struct(F.xxhash64(F.lit(1), *of).alias("a"), F.xxhash64(F.lit(2), *of).alias("b"))


def _steps(size: int) -> list[Column]:
    """nodes, parents and words of a block's turns, from ``p``, ``q`` (the places before and after it) and ``turns``."""
    digests = F.col("turns.digest")
    inner = F.transform(F.sequence(F.lit(1), F.size("turns")), lambda m: F.when(m == size, F.col("q")).otherwise(_node(F.col("p.a"), F.col("p.b"), m, F.sha2(F.array_join(F.transform(F.slice(digests, F.lit(1), m), F.hex), ""), 256))))
    return [inner.alias("nodes"), F.concat(F.array("p"), inner).alias("parents")]


def blocked(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv, k, p, q, turns, end) of each block: its number, the digests of all blocks before and with
    it, its turns (digest, words) in order, and, of a conversation's last block, the node it ends in.

    turns: conv, place, digest, words, length (turns of the conversation).
    """
    k = F.floor(F.col("place") / size).cast("long")
    slot = F.struct((F.col("place") % size).alias("slot"), "digest", "words")
    blocks = turns.groupBy("conv", k.alias("k")).agg(F.sort_array(F.collect_list(slot)).alias("turns"), F.max("length").alias("length"))
    of = F.array_join(F.transform("turns.digest", F.hex), "")
    blocks = blocks.withColumns({"a": F.xxhash64(F.lit(1), "k", of), "b": F.xxhash64(F.lit(2), "k", of)})
    own = stored(blocks.withColumns({"own_a": F.col("a"), "own_b": F.col("b")}), "blocks")
    runs = _running(own, "conv", F.col("k"), "bit_xor", ["a", "b"])
    before = F.struct(F.col("a").bitwiseXOR(F.col("own_a")).alias("a"), F.col("b").bitwiseXOR(F.col("own_b")).alias("b"))
    runs = runs.select("conv", "k", before.alias("p"), F.struct("a", "b").alias("q"), "turns", "length")
    last = F.col("k") == F.floor((F.col("length") - 1) / size)
    return runs.select("conv", "k", "p", "q", "turns", F.when(last, F.element_at(_steps(size)[0], -1)).alias("end"))


def trie(turns: DataFrame, lengths: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and (node, conv) of the node in which each conversation ends.

    turns: conv, place (0, 1, ... within conv), digest, words, length; lengths: conv, length, a row a
    conversation, also for those without a turn. Nodes: node, conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. The root has depth 0 and all
    conversations; without any there is no node.
    """
    cells = stored(blocked(turns, size), "cells")
    distinct = cells.groupBy("q", "p", "k").agg(F.first("turns").alias("turns"), F.count("*").alias("n"), F.min("conv").alias("rep"))
    distinct = stored(distinct, "distinct-blocks")
    alone = distinct.groupBy("p").agg(F.count("*").alias("ways"), F.min("q").alias("q")).where("ways = 1").select("q", F.lit(True).alias("alone"))
    rows = distinct.join(alone.hint("merge"), "q", "left").select("q", "k", "n", "rep", "turns", "alone", *_steps(size))
    rows = rows.select("q", "k", "n", "rep", "alone", F.posexplode(F.arrays_zip("nodes", F.slice("parents", F.lit(1), F.size("nodes")).alias("parents"), F.col("turns.words").alias("words"))))
    rows = rows.select("q", "n", "rep", "alone", (F.col("k") * size + F.col("pos") + 1).alias("depth"), F.col("col.nodes").alias("node"), F.col("col.parents").alias("parent"), F.col("col.words").alias("words"))
    rows = stored(rows, "steps")
    shared = rows.where("alone IS NOT NULL").select("node", "parent", "depth", "words", "n", "rep")
    split = rows.where("alone IS NULL").groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.sum("n").alias("n"), F.min("rep").alias("rep"))
    root = lengths.agg(F.count("*").alias("n"), F.min("conv").alias("rep")).where("n > 0")
    root = root.select(F.expr(_ROOT).alias("node"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "n", "rep")
    nodes = stored(shared.unionByName(split).unionByName(root), "nodes")
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids.hint("merge"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes.withColumn("value", (F.col("n") - 1) * F.col("words")), "nodes-children")

    # What each conversation owns, and its sum over the members of each node.
    owned = nodes.groupBy(F.col("rep").alias("conv")).agg(F.sum("value").alias("total"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"))
    weights = lengths.join(owned.hint("merge"), "conv", "left").select("conv", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("leaf", F.lit(0)).alias("leaf"), F.ceil(F.col("length") / size).alias("n"))
    weights = stored(weights, "weights")
    by_block = look_up(cells.select("conv", "q"), weights, "conv", cells.count()).groupBy("q").agg(F.sum("total").alias("total"), F.sum("leaf").alias("leaf"))
    sums = rows.select("q", "node").join(by_block.hint("merge"), "q").groupBy("node").agg(F.sum("total").alias("total"), F.sum("leaf").alias("leaf"))
    top = weights.agg(F.sum("total").alias("total"), F.sum("leaf").alias("leaf")).select(F.expr(_ROOT).alias("node"), "total", "leaf")
    runs = _running(nodes.withColumn("above", F.col("value")), "rep", F.col("depth"), "sum", ["above"])
    runs = runs.join(sums.unionByName(top).hint("merge"), "node")
    runs = runs.select("node", "parent", "depth", "n", "rep", "n_children", F.col("leaf").alias("n_leaves"), (F.col("total") - F.col("above") + F.col("value")).alias("saved_tokens"))
    runs = stored(runs, "nodes-sums")
    parents = runs.where("n_children > 0").select(F.col("node").alias("parent"), F.col("rep").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = look_up(runs.where("parent IS NOT NULL").withColumnRenamed("n", "n_convs"), parents, "parent", runs.count())
    top = runs.where("parent IS NULL").withColumnRenamed("n", "n_convs").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = below.unionByName(top).select("node", F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    ends = cells.where("end IS NOT NULL").select(F.col("end").alias("node"), "conv")
    return out, ends.unionByName(lengths.where("length = 0").select(F.expr(_ROOT).alias("node"), "conv"))


def conversation_trie(conversations: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``trie`` of conversations as they are (conv_id, turn, role, text)."""
    turns = stored(digested(conversations), "digested")
    lengths = stored(turns.groupBy("conv").agg(F.count("*").alias("length")), "lengths")
    length = lengths.select("conv", "length", F.col("length").alias("n"))
    return trie(look_up(turns, length, "conv", turns.count()), lengths, size)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join sorted ids into strings of at most CHUNK ids."""
    now, ids = None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"node": now, "first": ids[0], "ids": ",".join(map(str, ids))}], schema)

    schema = pa.schema([("node", pa.struct([("a", pa.int64()), ("b", pa.int64())])), ("first", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (node != now or len(ids) >= CHUNK):
                yield made()
                ids = []
            now = node
            ids.append(conv)
    if ids:
        yield made()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's strings, joined in order; nothing but the state of the hash is held."""
    now, state = None, None
    schema = pa.schema([("node", pa.struct([("a", pa.int64()), ("b", pa.int64())])), ("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if node != now:
                if state:
                    done.append({"node": now, "ends_sha256": state.hexdigest()})
                now, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_pylist(done, schema)
    if state:
        yield pa.RecordBatch.from_pylist([{"node": now, "ends_sha256": state.hexdigest()}], schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): digest of the decimal ids that end in a node, ascending, comma-joined.

    A digest is made in order, so a node's ids pass through one task, as strings of CHUNK ids that
    were joined in many.
    """
    ranged = ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    chunks = ranged.mapInArrow(_chunks, f"{_IDS}, first bigint, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, f"{_IDS}, ends_sha256 string")


def rebuilt(turns: DataFrame, spread: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations that share beginnings: conversation c gets the first h turns of
    c - c % spread, then its own after its first h; h is crc32 of c in decimal, modulo ``most``.

    turns: as ``digested`` gives them, stored.
    """
    counted = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = counted.select("conv", "n", (F.col("conv") - F.col("conv") % spread).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"))
    convs = stored(convs, "convs")
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases.hint("merge"), "base", "left").withColumn("p", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = stored(convs.withColumn("length", F.col("p") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt")
    heads = turns.where(F.col("place") < most - 1).withColumnRenamed("conv", "base")
    given = convs.where("p > 0").select("conv", "base", "p", "length").join(heads.hint("merge"), "base").where("place < p").select("conv", "place", "digest", "words", "length")
    own = look_up(turns, convs.select("conv", "n", "h", "p", "length"), "conv", turns.count()).where("place >= h")
    own = own.select("conv", (F.col("place") - F.col("h") + F.col("p")).alias("place"), "digest", "words", "length")
    return given.unionByName(own), convs.select("conv", "length")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(digested(read(spark, sf_dir, "conversations")), "digested")
    nodes, ends = trie(*rebuilt(turns))
    out = nodes.join(ends_digests(ends).hint("merge"), "node", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).drop("node")
