"""Token ids of a corpus as wavelet matrices: one compressed, searchable file per shard.

A shard holds the ids of consecutive documents. Plane k has bit k (from the top) of every id, in
the order in which the planes above have sorted them; with the ones counted up to each superblock
that is enough to read a token, to count an id and to find its occurrences without rebuilding the
ids. A plane is expanded when it is first used, and then kept. Shards are the rows of a Parquet table in the shared store, so Spark commits each write once
and a lost executor costs only its own tasks.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe_units import encoder
from .work import range_parts, read, stored

SHARD_TOKENS = 2_000_000
#: Characters of a range partition, about; and documents that are encoded at once at most.
PART_CHARS, BATCH = 256_000_000, 500
END = 2
_SUPER = 4096  # bits a superblock
_MAGIC = b"WMTX0001"
SHARDS = "part int, seq int, n_docs long, n_tokens long, shard binary"


def pack_shard(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray) -> bytes:
    """One shard's file: magic, size of the header, header, compressed sections."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    sections, zeros, a = [], [], ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for k in reversed(range(bits)):
        ones = ((a >> k) & 1).astype(bool)
        plane = np.packbits(ones)
        zeros.append(int(a.size - np.count_nonzero(ones)))
        per_byte = np.bitwise_count(plane).astype(np.uint32)
        pad = -per_byte.size % (_SUPER // 8)
        blocks = np.concatenate((per_byte, np.zeros(pad, np.uint32))).reshape(-1, _SUPER // 8).sum(axis=1)
        sections += [plane.tobytes(), np.concatenate(([0], np.cumsum(blocks))).astype(np.uint32).tobytes()]
        a = np.concatenate((a[~ones], a[ones]))
    null = np.asarray([d is None for d in doc_ids], bool)
    sections += [np.asarray([d or 0 for d in doc_ids], np.int64).tobytes(), np.packbits(null).tobytes(), np.asarray(sizes, np.uint64).tobytes()]
    squeeze = zstandard.ZstdCompressor(level=1).compress
    stored_sections = [squeeze(s) for s in sections]
    header = json.dumps({"n": int(ids.size), "bits": bits, "zeros": zeros, "docs": len(doc_ids), "sizes": [len(s) for s in stored_sections]}).encode()
    return b"".join([_MAGIC, len(header).to_bytes(4, "little"), header, *stored_sections])


class Shard:
    """Reader of one shard's file; sections are expanded when they are first used."""

    def __init__(self, blob: bytes):
        if blob[:8] != _MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(blob[8:12], "little")
        self.head = json.loads(blob[12 : 12 + size])
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        at = 12 + size
        self._raw = []
        for length in self.head["sizes"]:
            self._raw.append(blob[at : at + length])
            at += length
        self._open: dict[int, np.ndarray] = {}

    def _section(self, k: int, kind) -> np.ndarray:
        if k not in self._open:
            self._open[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._raw[k]), kind)
        return self._open[k]

    def _plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self._section(2 * k, np.uint8), self._section(2 * k + 1, np.uint32)

    def _ones(self, k: int, at: int) -> int:
        """Ones of plane k before place ``at``: superblock, then bytes, then bits."""
        plane, blocks = self._plane(k)
        block, byte = at // _SUPER, at // 8
        n = int(blocks[block]) + int(np.bitwise_count(plane[block * (_SUPER // 8) : byte]).sum(dtype=np.int64))
        return n + ((int(plane[byte]) >> (8 - at % 8)).bit_count() if at % 8 else 0)

    def doc_ids(self) -> list[int | None]:
        null = np.unpackbits(self._section(2 * self.bits + 1, np.uint8))[: self.head["docs"]]
        return [None if gone else d for d, gone in zip(self._section(2 * self.bits, np.int64).tolist(), null.tolist(), strict=True)]

    def doc_sizes(self) -> np.ndarray:
        return self._section(2 * self.bits + 2, np.uint64).astype(np.int64)

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        out = 0
        for k in range(self.bits):
            plane, _ = self._plane(k)
            bit = int(plane[at // 8]) >> (7 - at % 8) & 1
            ones = self._ones(k, at)
            at = self.zeros[k] + ones if bit else at - ones
            out = out << 1 | bit
        return out

    def rank(self, token: int, end: int | None = None) -> int:
        """How often an id occurs before ``end`` (in the whole shard by default)."""
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def _range(self, token: int, end: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits or self.n == 0:
            return 0, 0
        lo, hi = 0, min(end, self.n)
        for k in range(self.bits):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def select(self, token: int, nth: int) -> int:
        """Place of the nth occurrence (from 0) of an id; -1 if there are fewer."""
        lo, hi = self._range(token, self.n)
        if not 0 <= nth < hi - lo:
            return -1
        at = lo + nth
        for k in reversed(range(self.bits)):
            one = token >> (self.bits - 1 - k) & 1
            at = self._find(k, one, at - self.zeros[k] if one else at)
        return at

    def _find(self, k: int, bit: int, nth: int) -> int:
        """Place of the nth ``bit`` of plane k: superblock by search, then within its bits."""
        plane, blocks = self._plane(k)
        before = blocks.astype(np.int64) if bit else np.arange(blocks.size) * _SUPER - blocks
        block = int(np.searchsorted(before, nth, "right")) - 1
        bits = np.unpackbits(plane[block * (_SUPER // 8) : (block + 1) * (_SUPER // 8)])
        return block * _SUPER + int(np.flatnonzero(bits == bit)[nth - int(before[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token))]

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes' stable partitions from the last one."""
        a = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in reversed(range(self.bits)):
            ones = np.unpackbits(self._section(2 * k, np.uint8), count=self.n).view(bool)
            back = np.empty_like(a)
            back[~ones] = a[: self.zeros[k]]
            back[ones] = a[self.zeros[k] :] | a.dtype.type(1 << (self.bits - 1 - k))
            a = back
        return a


def write_shards(documents: DataFrame, tokenizer: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``text`` of every row and store the shards; returns the stored table.

    documents: doc_id, text; other columns are not read, whatever their names. Rows are dealt and
    sorted by doc_id, those of one doc_id by the hash of their text and then the text, null ids
    first, so shards (part, seq) follow each other in that order, and a doc_id that very many rows
    bear is split. Null and empty texts have only the end id. A shard is closed at the document that
    brings it to ``shard_tokens``; a longer document is a shard of its own with those before it. No
    row: no shard.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = encoder(tokenizer, blank=False), TaskContext.get().partitionId(), 0
        ids, docs, sizes, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            blob = pack_shard(np.concatenate(ids), docs, np.concatenate(sizes))
            row = [[part], [seq], [len(docs)], [held], [blob]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "n_docs", "n_tokens", "shard"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # No more documents at once than surely fit: a character is four ids at most.
                texts = [t or "" for t in batch.column(1).slice(at, BATCH).to_pylist()]
                room = np.cumsum([4 * len(t) + 1 for t in texts])
                take = max(1, int(np.searchsorted(room, max(4 * shard_tokens, 1 << 22), "right")))
                a, n = coder.encode(texts[:take], end)
                own, at, done = batch.column(0).slice(at, take).to_pylist(), at + take, 0
                while done < n.size:
                    reach = int(np.searchsorted(np.cumsum(n[done:]), shard_tokens - held)) + 1
                    some, size = n[done : done + reach], int(n[done : done + reach].sum())
                    ids.append(a[:size])
                    sizes.append(some)
                    docs += own[done : done + reach]
                    a, held, done = a[size:], held + size, done + some.size
                    if held >= shard_tokens:
                        yield close()
                        ids, docs, sizes, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield close()

    rows = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    rows = rows.repartitionByRange(range_parts(rows, chars, PART_CHARS), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return stored(rows.select("doc_id", "text").mapInArrow(encode, SHARDS), "wavelet")


def read_tokens(shards: DataFrame) -> DataFrame:
    """Every document's ids, out of the stored shards: part, seq, at, doc_id, first, ids.

    ``at`` counts documents and ``first`` ids within the shard; ids are little-endian 32-bit bytes.
    """
    kind = "part int, seq int, at long, doc_id long, first long, ids binary"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shard = Shard(blob)
                raw, sizes = shard.decode().astype("<u4").tobytes(), shard.doc_sizes()
                last = np.cumsum(sizes)
                n = sizes.size
                slices = [raw[4 * a : 4 * b] for a, b in zip((last - sizes).tolist(), last.tolist(), strict=True)]
                columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(np.arange(n)), pa.array(shard.doc_ids(), pa.int64()), pa.array(last - sizes), pa.array(slices, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "at", "doc_id", "first", "ids"])

    return shards.select("part", "seq", "shard").mapInArrow(decode, kind)


def token_index(shards: DataFrame) -> DataFrame:
    """Per document, from the stored files: doc_id, start over the whole corpus, n_tokens, ids_crc32.

    The ids before a shard are the sums of earlier parts (one row a part) and of earlier shards of
    its part; small rows only are joined.
    """
    kind = "part int, seq int, doc_id long, first long, n_tokens long, ids_crc32 long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shard = Shard(blob)
                raw, sizes = memoryview(shard.decode().astype("<u4").tobytes()), shard.doc_sizes()
                last = np.cumsum(sizes)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((last - sizes).tolist(), last.tolist(), strict=True)]
                n = sizes.size
                columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(shard.doc_ids(), pa.int64()), pa.array(last - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_id", "first", "n_tokens", "ids_crc32"])

    manifest = shards.select("part", "seq", "n_tokens")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        manifest.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(parts.select("part", "before").hint("merge"), "part")
        .select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))
    )
    rows = shards.select("part", "seq", "shard").mapInArrow(digest, kind)
    return rows.join(base.hint("merge"), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents, and :func:`token_index` of what was stored."""
    import public_tokenizers

    shards = write_shards(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_index(shards)
