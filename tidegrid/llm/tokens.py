"""Exact token ids through the tokenizers library, with a bounded cache of units per Python worker.

A text is cut where white space begins. Neither vocabulary here can form a token across such a place,
so the ids of a text are the ids of its units one after another, and each distinct unit needs to be
encoded by the library only once per worker.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow.compute as pc
import regex

from tidegrid.llm.shared import register_caches

#: The code points with Unicode's White_Space property.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
ASCII_UNIT = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
WORD = re.compile(f"[^{SPACE}]+")
#: The pre-tokenisation patterns of the byte-level file and of the lower-case file.
BYTE_PRE = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
WORD_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|" + f"[^{SPACE}" + r"\p{L}\p{N}]+")
#: Code points that no normaliser here changes but by plain lower case: ASCII, Latin-1, Latin Extended-A (composed; not I with dot).
PLAIN = re.compile("[\x00-\u012f\u0131-\u017e]*")


def _plain_pattern(last: int, spaced: bool) -> re.Pattern:
    """BYTE_PRE (``spaced``) or WORD_PRE for texts without code points beyond ``last``: the same pre-tokens."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(last + 1) if unicodedata.category(chr(c))[0] == kind)
    letter, digit, space = of("L"), of("N"), "".join(c for c in SPACE if ord(c) <= last)
    other = f"[^{space}{letter}{digit}]+"
    if spaced:  # no alternative but the second begins with an apostrophe before the fourth, so letters may come first
        return re.compile(f" ?[{letter}]+|'(?:[sdmt]|ll|ve|re)| ?[{digit}]+| ?{other}|[{space}]+(?![^{space}])|[{space}]+")
    return re.compile(f"[{letter}]+|'(?:[stmd]|re|ve|ll)|[{digit}]|{other}")


#: By ``keep_space``, for ASCII and for PLAIN texts.
PLAIN_PRE = {spaced: (_plain_pattern(0x7F, spaced), _plain_pattern(0x17F, spaced)) for spaced in (True, False)}
#: A space with white space behind it or at the end (characters that only Python counts as such do no harm).
RUN = re.compile(r" (?:\s|\Z)")
#: Marks that are a pre-token of their own behind a word.
MARKS = frozenset(".,;:!?)")
#: Units that a worker remembers per cache (about 200 bytes each), half of them from the generation before.
CACHE_UNITS = 240_000


def byte_symbols() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


SYMBOLS = byte_symbols()

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer of a file, once per process and without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def units(text: str) -> list[str]:
    """The text in units that begin with white space (all but the first); joined, they are the text."""
    return (ASCII_UNIT if text.isascii() else UNIT).findall(text)


def words(text: str) -> list[str]:
    """The units without white space, for vocabularies that drop it."""
    return text.split() if text.isascii() and not _SEPARATORS.search(text) else WORD.findall(text)


_SEPARATORS = re.compile("[\x1c-\x1f]")  # str.split() drops these; they aren't White_Space


class Remembered(dict):
    """make(key) -> (value, whether to remember it), in two generations of half of ``most`` (CACHE_UNITS) entries each."""

    def __init__(self, make, most: int | None = None):
        self.make, self.old, self.half = make, {}, (most or CACHE_UNITS) // 2

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value, keep = self.make(key)
            if not keep:
                return value
        if len(self) >= self.half:  # entries of the last generation stay within reach
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value


class Merged(dict):
    """Ids of pre-tokens by a merge model. The first ``most`` are remembered, until four times as many others were met."""

    def __init__(self, model, most: int):
        self.tokenize, self.most, self.others = model.tokenize, most, 0

    def ids(self, piece: str) -> bytes:
        symbols = piece.replace(" ", SYMBOLS[32]) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(SYMBOLS)
        return array("I", [t.id for t in self.tokenize(symbols)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        value = self.ids(piece)
        if len(self) < self.most:
            self[piece] = value
        elif (others := self.others + 1) > 4 * self.most:
            self.clear()
            self.others = 0
        else:
            self.others = others
        return value


class UnitEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, with a cache of units.

    A text of ASCII and Latin characters is cut into the pre-tokens that the file's pattern gives, and these go to the
    library's merge model directly; each is remembered, so that a mark or a line's end behind a word makes no new unit.
    Other texts, and those with a special string, go by units: those of ASCII and Latin letters likewise, all others
    through the whole library. A word with one mark behind it is put together from both and not remembered.
    """

    def __init__(self, path: str, keep_space: bool):
        self.tokenizer, self.keep_space = tokenizer(path), keep_space
        spec = json.loads(self.tokenizer.to_str())
        self.fold = any(n["type"] == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", []))
        self.pattern = WORD_PRE if self.fold else BYTE_PRE
        most = 2 * CACHE_UNITS if keep_space else CACHE_UNITS  # the pipeline, whose stages share workers, uses the other kind
        self.pieces = Merged(self.tokenizer.model, most)  # pre-tokens of plain texts
        self.units = Remembered(self._unit, most)
        self.spaced = Remembered(lambda word: self._unit(f" {word}"), most)  # by the word behind one space

    def _unit(self, unit: str) -> tuple[bytes, bool]:
        word = unit[1:] if unit[0] == " " and len(unit) > 1 else unit
        if word.isalpha():  # a word of letters, behind one space at most, is one pre-token
            if PLAIN.fullmatch(word) is None:
                return self._whole(unit), True
            if self.fold and (low := unit.lower()) != unit:
                return self.units[low], True
            return self.pieces.ids(unit), True
        if word[-1] in MARKS and word[:-1].isalpha() and PLAIN.fullmatch(word) is not None:
            return (self.spaced[word[:-1]] if word is not unit else self.units[unit[:-1]]) + self.units[word[-1]], False
        if PLAIN.fullmatch(unit) is None or "<|" in unit:
            return self._whole(unit), True
        if self.fold:
            unit = unit.lower()
        pieces = self.pattern.findall(unit)
        if len(pieces) == 1:
            return self.pieces.ids(unit), True
        return b"".join(map(self.units.__getitem__, pieces)), True

    def _whole(self, unit: str) -> bytes:
        return np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        unit, spaced, piece, out = self.units.__getitem__, self.spaced.__getitem__, self.pieces.__getitem__, []
        ascii_pre, plain_pre = PLAIN_PRE[self.keep_space]
        for text in texts:
            if (text.isascii() or PLAIN.fullmatch(text) is not None) and "<|" not in text:
                pre = ascii_pre if text.isascii() else plain_pre
                out.append(b"".join(map(piece, pre.findall(text.lower() if self.fold else text))))
            elif not self.keep_space:
                out.append(b"".join(map(unit, words(text))))
            elif text and RUN.search(text) is None:  # single spaces, each before a word: they go with it
                first, *rest = text.split(" ")
                out.append(b"".join([unit(first) if first else b"", *map(spaced, rest)]))
            else:
                out.append(b"".join(map(unit, units(text))))
        return out


_encoders: dict[tuple[str, bool], UnitEncoder] = {}
CACHES = register_caches("tokens", _encoders, _loaded)


def encoder(path: str, keep_space: bool) -> UnitEncoder:
    """One encoder per worker process, so that its cache serves task after task."""
    if (path, keep_space) not in _encoders:
        _encoders[path, keep_space] = UnitEncoder(path, keep_space)
    return _encoders[path, keep_space]


def text_slices(batch, text_at: int, most_bytes: int = 1_000_000):
    """(first row, texts) of an Arrow batch, in slices of bounded size (or one text); a null text is empty."""
    column = batch.column(text_at)
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype("i8"))
    first, done = 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
        yield first, [t or "" for t in column.slice(first, last - first).to_pylist()]
        first, done = last, int(ends[last - 1])
