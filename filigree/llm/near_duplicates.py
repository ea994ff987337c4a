"""N-gram Jaccard join: MinHash banding for candidates, full n-gram sets for the verdict.

Texts with the same set of five-word shingles form a class and are handled once, with a weight.
Classes that share a band hash lie in one bucket. The full shingle sets of a bucket's classes meet
in tasks of bounded size: small buckets share a task, a large one is dealt into blocks and each
pair of blocks is a task. Two classes that share several buckets count in the first of them only.
Where buckets overlap so much that comparing each of them would cost more than comparing all
classes that they join, directly or through others, with each other, that is done instead: it finds
the same links or more. What leaves a task is, for each class, the number of documents it is linked
to, and a spanning forest of the links; no pair is listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import fresh, others, read, stored

SHINGLE, THRESHOLD = 5, 0.8
#: Probability that two texts just at the threshold share a band.
RECALL = 0.999
#: Hash functions that a plan may use; more rows a band mean fewer false candidates.
MAX_HASHES = 224
#: Bounds of a block: shingles (8 bytes each) and classes.
BLOCK_SHINGLES, BLOCK_CLASSES = 400_000, 1_024
_PAIRS = 1 << 21  # pairs counted at once
#: Keys with very many rows are looked up in a broadcast table: by this definition at most HUBS of
#: them (some 50 bytes each), and none with fewer rows than HUB_ROWS.
HUBS, HUB_ROWS = 50_000, 256
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands, for the recall at the threshold, fit; where not
    even bands of one row do, as many of these as the recall needs, beyond ``most``."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold must lie in (0, 1] and recall in (0, 1)")
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if best and bands * rows > most:
            break
        best = (bands, rows)
        if bands * rows > most:
            break
    return best


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word windows; a shorter text is one shingle."""
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, h.size - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, h.size)):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    out ^= out >> np.uint64(30)
    out *= np.uint64(_MIX[0])
    out ^= out >> np.uint64(27)
    out *= np.uint64(_MIX[1])
    out ^= out >> np.uint64(31)
    return np.unique(out)


class _Bands:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(11)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.r = (rng.integers(0, 1 << 63, rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.s = rng.integers(0, 1 << 63, bands, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """A hash for each band; the band's number is part of it."""
        least = np.full(self.a.size, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, shingles.size, 1024):
            x = self.a[:, None] * shingles[None, at : at + 1024]
            x += self.b[:, None]
            np.minimum(least, x.min(axis=1), out=least)
        mixed = ((least >> np.uint64(16)).reshape(self.bands, self.rows) * self.r).sum(axis=1, dtype=np.uint64) + self.s
        mixed ^= mixed >> np.uint64(30)
        mixed *= np.uint64(_MIX[0])
        mixed ^= mixed >> np.uint64(27)
        return mixed.astype(np.int64)


def _key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def signatures(documents: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, t (hash of the text), key (of the shingle set), n (shingles), bands; a row each."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = _Bands(bands, rows)
        for batch in batches:
            keys, n, hashes = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text)
                keys.append(_key(s))
                n.append(s.size)
                hashes.append(band(s).tolist() if s.size else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "t", "key", "n", "bands"])

    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("t"), "text")
    return base.mapInArrow(sign, "doc_id long, t long, key binary, n long, bands array<long>")


def look_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with a stored table of one row for each ``key`` and in ``n`` the number of rows.

    total: the sum of n, at least. No more than total / limit keys can have over ``limit`` rows, so
    the limit bounds the broadcast, and what is left to shuffle has no hot key.
    """
    limit = max(HUB_ROWS, 2 * total // HUBS)
    hubs = table.where(F.col("n") > limit)
    if hubs.isEmpty():
        return rows.join(table.drop("n").hint("merge"), key)
    often = rows.join(F.broadcast(hubs.drop("n")), key)
    seldom = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(table.where(F.col("n") <= limit).drop("n").hint("merge"), key)
    return often.unionByName(seldom)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the least node of each connected component, for the nodes of ``edges`` (a, b).

    Alternates joining every node's larger neighbours, then its smaller ones, to its least
    neighbour, until nothing changes. Each round is two written tables: the driver sees two numbers
    a round. Nodes with very many neighbours are looked up without a shuffle.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    mark = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")]
    pairs, before = stored(pairs, name), None
    now = pairs.agg(*mark).first()
    while now != before and now["n"]:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), f"{name}-least")
        large = look_up(both.where("v > u"), least, "u", 2 * now["n"]).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # A node keeps at most as many neighbours as it had.
        hubs = not least.where(F.col("n") > HUB_ROWS).isEmpty()
        large = stored(large, f"{name}-large") if hubs else large
        small = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = stored(small, f"{name}-small") if hubs else small
        down = look_up(large, small, "hi", now["n"]) if hubs else large.join(small.hint("merge"), "hi")
        down = down.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        pairs = stored(down.unionByName(small.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct(), name)
        before, now = now, pairs.agg(*mark).first()
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(roots)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections. Shingles that only one set has are dropped first; those
    of few sets are added pair by pair, the others as a product of dense slices."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    owner = np.repeat(np.arange(m), [s.size for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[at] > 1
    owner, at = owner[shared], at[shared]
    order = np.lexsort((owner, at))
    owner, at = owner[order], at[order]
    if not at.size:
        return out
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    sizes = np.diff(np.concatenate((starts, [at.size])))
    # Adding the pairs of a column costs its square, a dense column costs m * m far cheaper steps.
    few = max(4, m // 16)
    flat = np.zeros(m * m, np.int64)
    waiting: list[np.ndarray] = []
    held = 0
    for k in np.unique(sizes[sizes <= few]):
        first, second = np.triu_indices(k, 1)
        at_k = starts[sizes == k]
        step = max(1, _PAIRS // first.size)
        for c in range(0, at_k.size, step):
            rows = owner[at_k[c : c + step, None] + np.arange(k)]
            waiting.append((rows[:, first] * m + rows[:, second]).ravel())
            held += waiting[-1].size
            if held >= _PAIRS:
                flat += np.bincount(np.concatenate(waiting), minlength=m * m)
                waiting, held = [], 0
    if waiting:
        flat += np.bincount(np.concatenate(waiting), minlength=m * m)
    out += flat.reshape(m, m) + flat.reshape(m, m).T
    many = np.flatnonzero(sizes > few)
    for a in range(0, many.size, 2048):
        some = many[a : a + 2048]
        dense = np.zeros((m, some.size), np.float32)
        column = np.repeat(np.arange(some.size), sizes[some])
        place = np.repeat(starts[some] - (np.cumsum(sizes[some]) - sizes[some]), sizes[some]) + np.arange(column.size)
        dense[owner[place], column] = 1
        out += dense @ dense.T
    return out


def _earlier(linked: np.ndarray, unit: int, buckets: list[np.ndarray]) -> None:
    """Take out the pairs that share a bucket before ``unit``: they count there."""
    owner = np.repeat(np.arange(len(buckets)), [b.size for b in buckets])
    every = np.concatenate(buckets) if buckets else np.empty(0, np.int64)
    owner, every = owner[every < unit], every[every < unit]
    order = np.argsort(every, kind="stable")
    for own in np.split(owner[order], np.flatnonzero(np.diff(every[order])) + 1):
        if own.size > 1:
            linked[np.ix_(own, own)] = False


def _linked(cids: np.ndarray, copies: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], threshold: float, cross: bool, unit: int = 0, buckets: list[np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """Rows (kind, a, b) of one comparison: kind 0 adds b documents to a's links, kind 1 links a, b.

    cross: only pairs of two sides count (each side's own pairs belong to another task). buckets: all
    that each class lies in, if the comparison is that of one bucket.
    """
    n = np.asarray([s.size for s in sets], np.float64)
    inside = _overlaps(sets)
    linked = inside >= threshold * (n[:, None] + n[None, :] - inside) - 1e-6
    np.fill_diagonal(linked, False)
    if cross:
        linked &= sides[:, None] != sides[None, :]
    if buckets and linked.any():
        _earlier(linked, unit, buckets)
    weight = linked @ copies
    out = [(0, int(c), int(w)) for c, w in zip(cids, weight, strict=True) if w]
    seen = np.zeros(len(sets), bool)
    for first in range(len(sets)):
        if seen[first] or not weight[first]:
            continue
        seen[first], front, found = True, [first], []
        while front:
            near = np.flatnonzero(linked[front.pop()] & ~seen)
            seen[near] = True
            front += near.tolist()
            found += near.tolist()
        out += [(1, int(cids[first]), int(cids[k])) for k in found]
    return out


def _verify(threshold: float):
    def verify(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (unit, bucketed), own in group.groupby(["unit", "bucketed"], sort=False):
            own = own.drop_duplicates("cid")
            if len(own) < 2:
                continue
            sets = [np.frombuffer(b, np.uint64) for b in own["shingles"]]
            buckets = [np.frombuffer(b, np.int64) for b in own["buckets"]] if bucketed else None
            out += _linked(own["cid"].to_numpy(), own["copies"].to_numpy(), own["side"].to_numpy(), sets, threshold, bool(own["cross"].iloc[0]), unit, buckets)
        return pd.DataFrame(out, columns=["kind", "a", "b"], dtype="int64")

    return verify


def _units(classes: DataFrame) -> tuple[DataFrame, int]:
    """(cid, units) of every class that meets another, and the number of tasks for the small units.

    units: structs (unit, bucketed, blocks). A unit is a bucket, or all classes that some buckets
    join (its least class names it) where comparing these all is no dearer.
    """
    placed = classes.select("cid", "n", F.explode("bands").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.min("cid").alias("pivot"), F.count("*").alias("m"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("cid")).alias("mark")).where("m > 1")
    # Near copies share many buckets; those of the very same classes are one.
    buckets = stored(buckets.groupBy("m", "mark", "pivot").agg(F.min("bucket").alias("bucket"), F.first("total").alias("total")), "buckets")
    met = placed.join(buckets.select("bucket", "pivot", F.col("m").alias("of")).hint("merge"), "bucket")
    met = stored(met.select("cid", "n", "bucket", "pivot", "of"), "met")
    groups = stored(components(met.where("cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b")), "candidates"), "grouped")

    size = F.greatest(F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    named = groups.withColumnRenamed("node", "cid")
    whole = named.join(met.groupBy("cid").agg(F.first("n").alias("n")).hint("merge"), "cid").groupBy("label").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    # A pivot is a node of its bucket's component.
    parts = buckets.join(groups.select(F.col("node").alias("pivot"), "label").hint("merge"), "pivot")
    apart = parts.groupBy("label").agg(F.sum(F.col("m") * F.col("m")).alias("cost"), F.count("*").alias("n_buckets"))
    dearer = (size > 1) & (F.col("cost") < F.col("m") * F.col("m"))
    whole = stored(whole.join(apart.hint("merge"), "label").select("label", "m", "total", size.alias("blocks"), dearer.alias("bucketed"), "n_buckets"), "groups")
    small = F.sum(F.when((F.col("blocks") == 1) & ~F.col("bucketed"), F.col("total")))
    sums = whole.agg(F.sum("m").alias("m"), F.sum("n_buckets").alias("n_buckets"), F.coalesce(small, F.lit(0)).alias("small"), F.coalesce(F.max("bucketed"), F.lit(False)).alias("bucketed")).first()

    one = look_up(named, whole.select("label", "blocks", "bucketed", F.col("m").alias("n")), "label", sums["m"] or 0).where("not bucketed")
    units = one.select("cid", F.struct(F.col("label").alias("unit"), "bucketed", "blocks").alias("u"))
    held = sums["small"]
    if sums["bucketed"]:
        by_bucket = look_up(parts.select("bucket", "m", "total", "label"), whole.select("label", "bucketed", F.col("n_buckets").alias("n")), "label", sums["n_buckets"]).where("bucketed")
        by_bucket = stored(by_bucket.select("bucket", size.alias("blocks"), F.col("m").alias("n"), "total"), "bucket-units")
        more = by_bucket.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("blocks") == 1, F.col("total"))), F.lit(0)).alias("small")).first()
        many = look_up(met.select("cid", "bucket"), by_bucket.drop("total"), "bucket", more["n"])
        units = units.unionByName(many.select("cid", F.struct(F.col("bucket").alias("unit"), F.lit(True).alias("bucketed"), "blocks").alias("u")))
        held += more["small"]
    return units.groupBy("cid").agg(F.sort_array(F.collect_list("u")).alias("units")), max(1, math.ceil(held / BLOCK_SHINGLES))


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, t, class_id, class_t, n_links, n_copies) for every row of documents (doc_id, text).

    class_id, class_t: doc_id and t (hash of the text) of the least of the documents joined by
    links, directly or through others, by doc_id and then t. Only both together name a class, as
    several texts may share a doc_id, or have none. n_links: documents whose shingle set has at least
    that Jaccard similarity with this one's, copies included; n_copies: documents with the very same
    shingle set, this one included. Texts without a word (null too) are copies of each other and of
    nothing else. Repeated rows count each, an empty table gives an empty one, whole texts are
    compared however long, and other columns are not read. Null ids are ids of -2^63 here. Links are
    found with the stated recall at the threshold, and more surely above it; what is found is exact.
    """
    bands, rows = choose_bands(threshold, recall)
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text")
    signed = stored(signatures(docs, bands, rows), "signatures")
    classes = signed.groupBy("key").agg(F.min(F.struct("doc_id", "t")).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    sums = classes.agg(F.count("*").alias("classes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("documents")).first()

    units, shares = _units(classes)
    members = stored(classes.select("cid", "key", "rep", "copies").join(units.hint("merge"), "cid"), "members")
    found = stored(_compare(docs, members, shares, threshold), "links")
    joined = components(found.where("kind = 1").select("a", "b"), "joined")
    links = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("links"))
    named = classes.select("cid", "key", "rep", "copies")
    named = named.join(joined.withColumnRenamed("node", "cid").hint("merge"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    named = named.join(links.hint("merge"), "cid", "left")
    heads = stored(named.groupBy("label").agg(F.min("rep").alias("head"), F.count("*").alias("n")), "heads")
    named = look_up(named, heads, "label", sums["classes"])
    named = named.select("key", F.col("head.doc_id").alias("class_id"), F.col("head.t").alias("class_t"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), F.col("copies").alias("n"))
    named = stored(named, "classes-named")
    return look_up(signed.select("doc_id", "t", "key"), named, "key", sums["documents"]).select("doc_id", "t", "class_id", "class_t", "n_links", "n_copies")


def _compare(docs: DataFrame, members: DataFrame, shares: int, threshold: float) -> DataFrame:
    """Send each member's shingle set to the tasks of its units, or of their blocks, and compare there."""
    names = ["share", "first", "second", "unit", "bucketed", "cid", "copies", "side", "cross", "buckets", "shingles"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            out, held = [], 0
            for text, cid, key, copies, units in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if cid in seen:  # a row that repeats both doc_id and text
                    continue
                s = shingle_set(text)
                if _key(s) != key:  # another text of the same hash
                    continue
                seen.add(cid)
                raw = s.tobytes()
                buckets = np.asarray([u["unit"] for u in units if u["bucketed"]], np.int64).tobytes()
                for u in units:
                    unit, bucketed, blocks = u["unit"], u["bucketed"], u["blocks"]
                    own = buckets if bucketed else b""
                    mine = int(xxhash.xxh64_intdigest(cid.to_bytes(8, "little")) % blocks)
                    for other in range(blocks):
                        place = (unit % shares, -1, -1) if blocks == 1 else (unit, min(mine, other), max(mine, other))
                        out.append((*place, unit, bucketed, cid, copies, mine, mine != other, own, raw))
                        held += len(raw)
                        if held > 1 << 25:
                            yield batch_of(out)
                            out, held = [], 0
            if out:
                yield batch_of(out)

    schema = "share long, first int, second int, unit long, bucketed boolean, cid long, copies long, side int, cross boolean, buckets binary, shingles binary"
    m = members.select("rep.doc_id", "rep.t", "cid", "key", "copies", "units")
    texts = _texts_of(docs, m).select("text", "cid", "key", "copies", "units")
    sent = texts.mapInArrow(sets, schema)
    return sent.groupBy("share", "first", "second").applyInPandas(_verify(threshold), "kind long, a long, b long")


def _texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members (doc_id, t, ...) with their texts: a row each, and one more for every row of docs that
    repeats both doc_id and text."""
    return docs.withColumn("t", _text_hash()).join(members.hint("shuffle_hash"), ["doc_id", "t"])


def keep_one(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One document of each class stays: that with the least doc_id (then text hash); a row that
    repeats it entirely in id and text goes as well. Columns are those of documents, whatever their
    names; nulls and texts are taken as by :func:`near_duplicates`; an empty table stays empty."""
    found = near_duplicates(documents.select("doc_id", "text"), threshold, recall)
    own_id, own_t = fresh(documents, "own_id", "own_t")
    kept = found.where("doc_id = class_id and t = class_t").select(F.col("doc_id").alias(own_id), F.col("t").alias(own_t)).distinct()
    at = documents.withColumns({own_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), own_t: _text_hash()})
    rows = at.join(kept.hint("shuffle_hash"), [own_id, own_t], "left_semi")
    return rows.dropDuplicates([own_id, own_t]).select(*others(documents))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("t")
