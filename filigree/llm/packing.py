"""Packing of documents into fixed-size sequences along a Hilbert curve of document vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_units import encoder
from .work import range_parts, read, stored

LENGTH, END = 1024, 0
DIMS, BITS = 3, 20  # of the curve; a key has DIMS * BITS bits
BUCKETS = 4096  # of the hashed document vector
PART_TOKENS = 32_000_000  # of a range partition, about; two bytes each
DOCS, CHARS = 500, 4_000_000  # encoded at once, at most; a longer document alone
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projection(dims: int = DIMS, seed: int = 7) -> np.ndarray:
    """A row for every 16-bit token id: its bucket's random direction with the id's hashed sign.

    Adding the rows of a document's ids is projecting its hashed count vector.
    """
    table = np.random.default_rng(seed).standard_normal((BUCKETS, dims)).astype(np.float32)
    mixed = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sign = np.where(mixed >> np.uint64(63), 1, -1).astype(np.float32)
    return np.asfortranarray(table[(mixed >> np.uint64(40)).astype(np.int64) % BUCKETS] * sign[:, None])


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole-number coordinates below 2 ** bits."""
    x = [c.astype(np.uint64) for c in points.T]
    dims = len(x)
    for step in range(bits - 1, 0, -1):  # undo the excess turns of each level
        q = np.uint64(1 << step)
        p = q - np.uint64(1)
        for i in range(dims):
            flip = (x[i] & q) != 0
            t = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
    for i in range(1, dims):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    for step in range(bits - 1, 0, -1):
        q = np.uint64(1 << step)
        t = np.where((x[-1] & q) != 0, t ^ (q - np.uint64(1)), t)
    x = [c ^ t for c in x]
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = (key << np.uint64(1)) | ((c >> np.uint64(bit)) & np.uint64(1))
    return key.astype(np.int64)


def document_keys(ids: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert key of each document's mean projection; every document has at least its end id."""
    first = np.cumsum(sizes) - sizes
    mean = np.stack([np.add.reduceat(column[ids], first) for column in table.T], axis=1) / sizes[:, None]
    unit = 0.5 + 0.5 * mean / (np.abs(mean) + 0.05)  # (0, 1), finest about zero
    return hilbert_keys(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenized(documents: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id, key, n, ids (16-bit little-endian) of every row, stored: tokenized once, read twice
    (once for the range bounds)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table = encoder(tokenizer, blank=True), projection()
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # As many documents at once as fit in CHARS characters, but one at least.
                texts = [t or "" for t in batch.column(1).slice(at, DOCS).to_pylist()]
                take = max(1, int(np.searchsorted(np.cumsum([len(t) for t in texts]), CHARS, "right")))
                some, at = batch.slice(at, take), at + take
                ids, n = coder.encode(texts[:take], end)
                bounds = np.concatenate(([0], np.cumsum(2 * n)))
                if bounds[-1] >= 1 << 31:
                    raw = ids.astype("<u2").tobytes()
                    blobs = pa.array([raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
                else:
                    blobs = pa.Array.from_buffers(pa.binary(), n.size, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(document_keys(ids, n, table)), pa.array(n), blobs], ["doc_id", "key", "n", "ids"])

    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return stored(rows.mapInArrow(encode, "doc_id long, key long, n long, ids binary"), "tokens")


class _Packer:
    """Cuts one sorted partition's ids into sequences.

    Sequences are full until the partition ends; what is left then is cut into sequences whose
    lengths are powers of two, so no sequence needs padding.
    """

    def __init__(self, part: int, length: int):
        self.next, self.length = part << 40, length
        self.open: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.held = 0
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids.size, zlib.crc32(ids.astype("<u4")), total, self.next, offset))
            offset += ids.size
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        at, total = 0, ids.size
        while at < total:
            own = ids[at : at + self.length - self.held]
            self.open.append((doc, at, own, total))
            at += own.size
            self.held += own.size
            if self.held == self.length:
                self._close(self.open)
                self.open, self.held = [], 0

    def finish(self) -> None:
        while self.held:
            want = 1 << (self.held.bit_length() - 1)
            self.held -= want
            pieces: list[tuple] = []
            while want:
                doc, start, ids, total = self.open.pop(0)
                pieces.append((doc, start, ids[:want], total))
                if ids.size > want:
                    self.open.insert(0, (doc, start + want, ids[want:], total))
                want -= min(want, ids.size)
            self._close(pieces)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) if self.out else [[]] * 7
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")])


def pack(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents, packed with their neighbours on the curve.

    tokens: doc_id, key, n, ids, stored. Rows are range-partitioned by (key, doc_id, hash of ids), so a
    key that many documents share is split, into partitions of some ``PART_TOKENS``, and sorted by
    these and the ids within them; repeated rows are packed each. A document of any length is cut
    where a sequence is full. ``sequence_id`` is the partition's number in the high bits and a
    running number.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId(), length)
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, np.frombuffer(ids.as_buffer(), "<u2"))
            yield packer.batch()
        packer.finish()
        yield packer.batch()

    total = tokens.agg(F.sum("n")).first()[0] or 0
    rows = tokens.select("key", "doc_id", F.xxhash64("ids").alias("h"), "ids")
    rows = rows.repartitionByRange(range_parts(rows, total, PART_TOKENS), "key", "doc_id", "h").sortWithinPartitions("key", "doc_id", "h", "ids")
    return rows.select("doc_id", "ids").mapInArrow(cut, PIECES)


def pack_documents(documents: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Tokenize, order and pack: see :func:`pack` for the columns. Null and empty texts are the end
    id alone; an empty table has no piece. Only doc_id and text are read, so other columns may have
    any names; null and repeated ids are packed a row each."""
    return pack(tokenized(documents, tokenizer, end), length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens of the public byte-level tokenizer."""
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
