"""Token ids of whole texts through a cache of units that the tokenizer never merges across.

Both pre-tokenizers used here end a piece before a single blank, so a text is encoded unit by unit
(the text between blanks). A new unit of plain Latin characters is cut by the tokenizer's own
pattern into pieces, each of which the library's model encodes once a worker; any other new unit,
and any text with two blanks in a row (where the byte-level pattern looks ahead), goes to the
library's full pipeline. The ids are those of ``tokenizer.encode(text)`` in every case.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import regex

#: Units and pieces kept by a worker before it starts anew.
CACHE_UNITS, CACHE_PIECES = 1_000_000, 400_000
#: Characters of texts that aren't cut, likewise.
CACHE_UNCUT = 1 << 25

#: The pre-tokenizers' patterns, as the tokenizer files state them.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: No control characters, odd blanks, combining marks or special tokens: every version of the
#: character tables agrees here, and normal form C changes nothing.
_PLAIN = regex.compile(r"(?:[\n -;=-~¡-¬®-ɏ]|<(?!\|))*")
_LATIN = regex.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]*")


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


#: Marks a unit that has no blank before it: the first of a text, or a text that isn't cut (as those
#: that have this character aren't).
_WHOLE = "\x00"


class _Index(dict):
    """Numbers units in the order in which they are first asked for, and lists the new ones."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


def _stages(part: dict | None, many: str) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer, as the file states them."""
    if part is None:
        return []
    return part[many] if part["type"] == "Sequence" else [part]


def _check(file: dict, blank: bool) -> None:
    """Refuse a tokenizer whose normalizer or pre-tokenizer isn't the one that units rely on."""
    normal, cut = _stages(file["normalizer"], "normalizers"), _stages(file["pre_tokenizer"], "pretokenizers")
    last = cut[-1] if cut else {}
    fits = file["model"]["type"] == "BPE" and not file["model"].get("dropout") and last.get("type") == "ByteLevel" and not last["add_prefix_space"]
    if blank:
        fits = fits and not normal and len(cut) == 1 and last.get("use_regex", True)
    else:
        first = cut[0] if len(cut) == 2 else {}
        fits = fits and [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and (normal[1]["pattern"], normal[1]["content"]) == ({"Regex": r"\s+"}, " ")
        fits = fits and first.get("type") == "Split" and first["pattern"] == {"Regex": WORD_PATTERN} and (first["behavior"], first["invert"]) == ("Removed", True) and not last.get("use_regex", True)
    if not fits:
        raise ValueError("not a tokenizer of the expected normalizer and pre-tokenizer")


class Encoder:
    """``path``: a tokenizer file. ``blank``: whether units after the first keep their blank (the
    byte-level tokenizer does; the word tokenizer drops blanks and lowers case). A file with another
    normalizer or pre-tokenizer is refused."""

    def __init__(self, path: str, blank: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        _check(json.loads(self.tokenizer.to_str()), blank)
        self.model = self.tokenizer.model
        self.blank = blank
        self.cut = regex.compile(BYTE_PATTERN if blank else WORD_PATTERN).findall
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.sizes = np.zeros(1024, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint16)
        self.used = self.uncut = 0

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece as 16-bit numbers, from the library's model."""
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) > CACHE_PIECES:
                self.pieces.clear()
            if piece.isalpha() and piece.isascii():
                spelt = piece
            else:
                spelt = piece.encode().decode("latin-1").translate(self.letters)
            ids = self.pieces[piece] = array("H", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return ids

    def _ids(self, unit: str) -> bytes:
        # Most units are a word and perhaps a stop: two pieces, told without the pattern.
        word = unit.rstrip(".,")
        if (word.isalpha() or (word[:1] == " " and word[1:].isalpha())) and (word.isascii() or _LATIN.fullmatch(word)):
            core = self._piece(word if self.blank else word.lower())
            return core + self._piece(unit[len(word) :]) if len(word) < len(unit) else core
        if not _PLAIN.fullmatch(unit):
            return array("H", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
        return b"".join([self._piece(p) for p in self.cut(unit if self.blank else unit.lower())])

    def _learn(self) -> None:
        """Encode the units that the index has met since the last call."""
        units, self.index.new = self.index.new, []
        first = len(self.index) - len(units)
        if self.blank:
            blobs = [self._ids(u[1:] if u.startswith(_WHOLE) else " " + u) for u in units]
        else:
            blobs = [self._ids(u) for u in units]
        n = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 2
        flat = np.frombuffer(b"".join(blobs), np.uint16)
        while first + n.size > self.sizes.size:
            self.sizes, self.starts = np.resize(self.sizes, 2 * self.sizes.size), np.resize(self.starts, 2 * self.starts.size)
        while self.used + flat.size > self.flat.size:
            self.flat = np.resize(self.flat, 2 * self.flat.size)
        self.sizes[first : first + n.size] = n
        self.starts[first : first + n.size] = self.used + np.cumsum(n) - n
        self.flat[self.used : self.used + flat.size] = flat
        self.used += flat.size

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (16 bits) of all texts in one array, each text closed by ``end``, and the texts' sizes."""
        if len(self.index) > CACHE_UNITS or self.uncut > CACHE_UNCUT:
            self._clear()
        units: list[str] = []
        counts = np.empty(len(texts), np.int64)
        for k, t in enumerate(texts):
            if self.blank and ("  " in t or _WHOLE in t):
                own = [_WHOLE + t]
                self.uncut += len(t)
            else:
                own = t.split(" ")
                if self.blank:
                    own[0] = _WHOLE + own[0]
            counts[k] = len(own)
            units += own
        at = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        if self.index.new:
            self._learn()
        n = self.sizes[at]
        # Each text is followed by a place for its end.
        last = np.cumsum(counts) - 1
        if len(texts):
            n[last] += 1
        ends = np.cumsum(n)
        total = int(ends[-1]) if ends.size else 0
        ids = self.flat[np.minimum(np.arange(total) + np.repeat(self.starts[at] - (ends - n), n), max(0, self.flat.size - 1))]
        if len(texts):
            ids[ends[last] - 1] = end
        sizes = np.diff(ends[last], prepend=0)
        return ids, sizes


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, blank: bool) -> Encoder:
    """One encoder a worker process."""
    if (path, blank) not in _encoders:
        _encoders[path, blank] = Encoder(path, blank)
    return _encoders[path, blank]
