"""Token counts by prefix dynamic programming (operator 3).

For every code point boundary of a text the table holds the exact number of tokens that the text up to
there encodes to, so truncation and budget questions need no further encoding. Inside a pre-token the
count follows from a recurrence over byte prefixes: the encoding of a prefix ends in exactly one
vocabulary entry t whose preceding prefix ends in an entry that byte-pair merging leaves apart from t;
so count[i] = count[i - len(t)] + 1. Whether two neighbouring entries stay apart is decided by undoing
their merges in reverse order. Tables are kept as one signed byte per code point (the change of the
count), which is joined from the tables of units that each worker remembers.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegrid.llm import tokens

#: The two-letter contractions of the pre-tokenisation pattern.
TWO_LETTER = ("'ll", "'ve", "'re")
#: Pairs of entries that a worker remembers; half as many pre-tokens, twice as many units (some 150 bytes each).
CACHE = 500_000


class PrefixCounter:
    """Exact token counts of every prefix, for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        back = {c: b for b, c in tokens.SYMBOLS.items()}
        raw = lambda s: bytes(back[c] for c in s)
        self.specials = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.specials)) or "(?!)")
        self.ids = {raw(s): n for s, n in model["vocab"].items() if all(c in back for c in s)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: pair of ids -> rank of its merge; id -> (left, right, rank), absent for single bytes
        self.merged, self.made = {}, {}
        for rank, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            self.merged.setdefault((self.ids[a], self.ids[b]), rank)
            self.made.setdefault(self.ids[a + b], (self.ids[a], self.ids[b], rank))
        self.longest = max(map(len, self.ids))
        self.apart_cache: dict[tuple[int, int], bool] = {}
        self.piece_cache: dict[str, bytes] = {}
        self.units = tokens.Remembered(lambda u: (self.unit(u), len(u) < 256), 2 * CACHE)

    def apart(self, a: int, b: int) -> bool:
        """True if encoding the bytes of a and b together gives just these two entries."""
        if (known := self.apart_cache.get((a, b))) is not None:
            return known
        x, y, below, left_wins, out = a, b, len(self.made) + 1, False, True
        while True:
            # A merge across the border happens if it comes before the merge that was undone last; of
            # equal merges the one further left comes first, and that is the border one only if the
            # entry undone last lies right of the border.
            rank = self.merged.get((x, y))
            if rank is not None and (rank < below or rank == below and left_wins):
                out = False
                break
            rx, ry = self.made[x][2] if x in self.made else -1, self.made[y][2] if y in self.made else -1
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                x, below, left_wins = self.made[x][1], rx, False
            else:
                y, below, left_wins = self.made[y][0], ry, True
        if len(self.apart_cache) > CACHE:
            self.apart_cache.clear()
        self.apart_cache[a, b] = out
        return out

    def byte_counts(self, data: bytes) -> list[int]:
        """Tokens of data[:i] for i = 0..len(data), data being one pre-token."""
        ids, apart, longest = self.ids, self.apart, self.longest
        last, count = [-1], [0]
        for i in range(1, len(data) + 1):
            for j in range(max(0, i - longest), i):
                if (t := ids.get(data[j:i])) is not None and (j == 0 or apart(last[j], t)):
                    last.append(t)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError("the vocabulary has no entry for a single byte")
        return count

    def piece(self, text: str) -> list[int]:
        """Tokens of text[:k] for k = 1..len(text), text being one pre-token."""
        if (known := self.piece_cache.get(text)) is not None:
            return known
        data = text.encode()
        at, out = 0, []
        counts = self.byte_counts(data)
        for c in text:
            at += len(c.encode()) if c > "\x7f" else 1
            out.append(counts[at])
        if text in TWO_LETTER:  # cut after one letter, the apostrophe and the letter are pre-tokens
            out[1] = self.byte_counts(data[:1])[1] + self.byte_counts(data[1:2])[1]
        if len(self.piece_cache) > CACHE // 2:
            self.piece_cache.clear()
        if len(text) < 64:
            self.piece_cache[text] = out
        return out

    def plain(self, text: str) -> list[int]:
        """Counts at all prefixes of a unit without special strings."""
        out: list[int] = []
        base = 0
        for p in tokens.BYTE_PRE.findall(text):
            own = self.piece(p)
            out += [base + n for n in own] if base else own
            base = out[-1]
        lead = len(text) - len(text.lstrip(tokens.SPACE))
        if 1 < lead < len(text):  # cut within leading white space, that is one pre-token
            out[:lead] = self.piece(text[:lead])
        return out

    def unit(self, text: str) -> bytes:
        """Changes of the count at each code point of a unit, one signed byte each."""
        if not self.special.search(text):
            counts = self.plain(text)
        else:
            counts, base, at = [], 0, 0
            for m in self.special.finditer(text):
                part = self.plain(text[at : m.end() - 1])  # up to its last character it is ordinary text
                counts += [base + n for n in part]
                base += (part[m.start() - at - 1] if m.start() > at else 0) + 1
                counts.append(base)
                at = m.end()
            if at < len(text):
                counts += [base + n for n in self.plain(text[at:])]
        return bytes([(b - a) & 255 for a, b in zip([0, *counts], counts, strict=False)])

    def table(self, text: str) -> bytes:
        """Changes of the count at each code point of a whole text."""
        return b"".join(map(self.units.__getitem__, tokens.units(text)))


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_counts(table: bytes) -> np.ndarray:
    """Token counts of all prefixes (0 to n code points) from a stored table."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(table, "i1"), dtype="i8")])


def longest_within(table: bytes, budget: int) -> int:
    """Code points of the longest prefix that takes at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_counts(table) <= budget)[-1])


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, keep_table: bool = True) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit, kept_chars and, if asked, prefix_table.

    kept_chars is the length in code points of the longest prefix of at most ``limit`` tokens.
    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows give repeated
    results; other columns are ignored. Texts are never cut. A special string inside a text is the one
    token that the library's default makes of it. No shuffle, bounded memory: a text's table has one
    byte per code point.
    """
    source = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    fields = [T.StructField("doc_id", source.schema[0].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("kept_chars", T.LongType())]
    if keep_table:
        fields.append(T.StructField("prefix_table", T.BinaryType()))

    def count(batches):
        own = counter(path)
        for batch in batches:
            for first, texts in tokens.text_slices(batch, 1):
                tables = [own.table(t) for t in texts]
                n = [int(np.frombuffer(t, "i1").sum(dtype="i8")) for t in tables]
                kept = [len(t) if k <= limit else longest_within(x, limit) for t, k, x in zip(texts, n, tables, strict=True)]
                columns = [batch.column(0).slice(first, len(texts)), pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(kept, pa.int64())]
                if keep_table:
                    columns.append(pa.array(tables, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return source.mapInArrow(count, T.StructType(fields))
