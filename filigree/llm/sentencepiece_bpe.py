"""SentencePiece BPE by a prefix table: each prefix's unique last token, recovered backwards.

In the merge order's result for a text, the last token of every prefix is determined: of the
tokens that end there (automaton matches), exactly one is compatible with the last token of the
prefix before it. Two tokens are compatible if merging their joined text gives those two again.
So one pass over the matches fills the table, and the ids follow from the end backwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import others, read

SPACE = "▁"
#: Units, and token pairs, that a worker remembers before it forgets the older half; longer units
#: aren't kept.
CACHE_UNITS, CACHE_PAIRS, LONGEST = 600_000, 1_000_000, 200


def _forget(known: dict, most: int) -> None:
    """Drop the older half of what is remembered if that is more than ``most``."""
    if len(known) > most:
        for key in list(islice(known, len(known) // 2)):
            del known[key]


class PrefixEncoder:
    """Encodes as the model's BPE does; checks that the model has the shape this relies on:
    identity normalisation with a leading space, byte fallback, and no piece that has a space
    after another character, so that merges stay within runs of spaces plus one word."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.ids[piece], self.score[piece] = i, m.get_score(i)
        if m.normalize(" x  y ") != SPACE + SPACE + "x" + 2 * SPACE + "y" + SPACE or len(self.bytes) != 256:
            raise ValueError("not an identity-normalised model with byte fallback")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece spans words")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            # Others never come out of merging; where no longer token fits, the character is the last.
            if len(piece) > 1 and self._merge(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), piece))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units: dict[str, tuple[tuple[int, ...], str]] = {}

    def _merge(self, text: str) -> list[str]:
        """Merging by definition, for pieces and pairs: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        _forget(self.pairs, CACHE_PAIRS)
        fits = self.pairs[left, right] = self._merge(left + right) == [left, right]
        return fits

    def pieces(self, unit: str) -> list[str]:
        """Tokens of a unit (spaces, then a word); a character outside the vocabulary is its own."""
        last, known, test = list(unit), self.pairs, self._compatible
        for end, (size, piece) in self.automaton.iter(unit):
            start = end - size
            if start < 0:
                last[end] = piece
            else:
                pair = (last[start], piece)
                fits = known.get(pair)
                if test(*pair) if fits is None else fits:
                    last[end] = piece
        out, at = [], len(unit) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _unit(self, unit: str) -> tuple[tuple[int, ...], str]:
        ids: list[int] = []
        for piece in self.pieces(unit):
            if piece in self.ids:
                ids.append(self.ids[piece])
            else:
                ids += [self.bytes[b] for b in piece.encode()]
        return tuple(ids), ",".join(map(str, ids))

    def encode(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """(ids, ids as text) of each unit; joined they are the ids of the text."""
        if not text:
            return []
        _forget(self.units, CACHE_UNITS)
        known, out, run = self.units, [], 0
        words = text.replace(SPACE, " ").split(" ")
        for k, word in enumerate(words):
            run += 1
            if not word and k + 1 < len(words):
                continue
            key = word if run == 1 else SPACE * (run - 1) + word
            got = known.get(key)
            if got is None:
                got = self._unit(SPACE + key)
                if len(key) <= LONGEST:
                    known[key] = got
            out.append(got)
            run = 0
        return out


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


def encode(documents: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int); empty for null and empty texts. Whole texts, row by row, however
    long and often repeated; a column of that name is replaced, others pass through whatever their
    names; an empty table gives an empty one."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoder(model)
        for texts in batches:
            yield texts.map(lambda t: list(chain.from_iterable(u[0] for u in coder.encode(t or ""))))

    return documents.select(*others(documents, "ids"), ids(F.col(text)).alias("ids"))


def decode(rows: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text of ``ids`` by the model's decoder, as column ``into``, which is replaced if it is
    there; null ids give an empty text, and an empty table an empty one."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        processor = encoder(model).model
        for some in batches:
            yield some.map(lambda x: processor.decode([int(i) for i in x]) if x is not None and len(x) else "")

    return rows.select(*others(rows, into), text(F.col(ids)).alias(into))


def round_trip(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: the digests of what
    :func:`encode` and :func:`decode` give, made where the ids are, so that they needn't move.

    Other columns are not read, whatever their names. Null texts count as empty; ids may be null or
    repeated, and every row has its own result; a text is held whole, with its ids, by one task;
    an empty table gives an empty one."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                units = coder.encode(text or "")
                ids = list(chain.from_iterable(u[0] for u in units))
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([u[1] for u in units]).encode()).hexdigest())
                text_sha.append(hashlib.sha256((coder.model.decode(ids) if ids else "").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`round_trip` of all documents with the public piece model."""
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
