"""Byte-level BPE: exact merges by backtracking, decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives, in one pass over a piece of text, the
longest token at every position. The encoder takes the longest token that may stand after
the one before it, falls back to the next shorter prefix token, and steps back where none
fits. Which two tokens may stand side by side is read from a pair-compatibility table, filled
as pairs appear: a pair is compatible if undoing its merges, latest first, never meets a
merge across the boundary that should have happened earlier. The one sequence whose
neighbours are all compatible is what the merges give, so each position is settled once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from planarix.llm import arrow

# Fixed value: the pre-tokenising pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Code points that newer Unicode versions count as letters or numbers, but not the one that the
# vocabularies' library follows; there they are other signs.
UNASSIGNED = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24
1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F
2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""

#: Entries of each of two generations of the per-process memory of encoded pieces.
CACHE = 1 << 18


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(sorted(set(range(256)) - set(plain))):
        out[chr(0x100 + n)] = b
    return out


class Tables:
    """What encoding and decoding need of a vocabulary file."""

    def __init__(self, spec: dict) -> None:
        letters, model = byte_letters(), spec["model"]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for k, v in vocab.items():
            self.tokens[v] = as_bytes(k)
        ids = {self.tokens[v]: v for v in vocab.values()}
        # rank of each token's merge; single bytes come before all merges
        self.rank, self.left, self.right = [-1] * size, list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            x, y, z = ids[a], ids[b], ids[a + b]
            if (x, y) not in self.merged:
                self.merged[x, y] = z
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = n, x, y
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        for word, v in ids.items():
            for n in range(len(word) - 1, 0, -1):
                if (p := ids.get(word[:n])) is not None:
                    self.shorter[v] = p
                    break
        for content, v in self.special.items():
            self.tokens[v] = content.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])]).astype(np.int64)
        self.blob = b"".join(self.tokens)
        self.ids = ids

    @classmethod
    def load(cls, path: str) -> Tables:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))


class Codec:
    """Encoder and decoder; memories are bounded. A Python worker keeps one while it has tasks of the same step."""

    def __init__(self, tables: Tables) -> None:
        self.t = tables
        self._find = regex.compile(PATTERN).findall
        late = "".join("-".join(f"\\U{int(c, 16):08x}" for c in r.split("-")) for r in UNASSIGNED.split())
        older = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{late}])")
        for kind in "LN":
            older = older.replace(rf" ?\p{{{kind}}}+", rf" ?(?:(?![{late}])\p{{{kind}}})+")
        self._find_older, self._late = regex.compile(older).findall, regex.compile(f"[{late}]").search
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(tables.special, key=len, reverse=True)) + ")").split if tables.special else None
        self.machine = ahocorasick.Automaton()
        for word, v in tables.ids.items():
            self.machine.add_word(word.decode("latin-1"), (v, len(word) - 1))
        self.machine.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def find(self, text: str) -> list[str]:
        """Pre-tokenised pieces. Few texts hold a character beyond Latin-1, and hardly any a late one."""
        plain = text.isascii() or len(text.encode("latin-1", "ignore")) == len(text)
        return self._find(text) if plain or not self._late(text) else self._find_older(text)

    def _fits(self, a: int, b: int) -> bool:
        """The pair-compatibility table's entry for two neighbours."""
        key = (a, b)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= CACHE:
                self.compatible.clear()
            known = self.compatible[key] = self._undo(a, b)
        return known

    def _undo(self, a: int, b: int) -> bool:
        """Undo the later of the two tokens' last merges until both are bytes.

        `before` bounds the merges that could have come first: those of lower rank than what
        was undone; at equal rank the left one happens first.
        """
        t = self.t
        before = 1 << 60
        while True:
            across = t.merged.get((a, b))
            if across is not None and 2 * t.rank[across] + 1 < before:
                return False
            if t.rank[a] < 0 and t.rank[b] < 0:
                return True
            if t.rank[a] > t.rank[b]:
                before, a = 2 * t.rank[a] + 1, t.right[a]
            else:
                before, b = 2 * t.rank[b] + 2, t.left[b]

    def piece(self, text: str) -> list[int]:
        """Token ids of one pre-tokenised piece."""
        raw = text.encode()
        whole = self.t.ids.get(raw)
        if whole is not None and len(raw) == 1:
            return [whole]
        n = len(raw)
        longest = [-1] * n
        for end, (v, more) in self.machine.iter(raw.decode("latin-1")):
            longest[end - more] = v  # later ends are longer
        tokens, shorter, fits = self.t.tokens, self.t.shorter, self._fits
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(tokens[token])
                if open_at[end] and (last < 0 or fits(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            else:  # nothing fits here: this position is closed for good
                open_at[at] = 0
                token = out.pop()
                at -= len(tokens[token])
        return out

    def _packed(self, text: str) -> bytes:
        got = self.older.get(text)
        if got is None:
            got = np.array(self.piece(text), "<i4").tobytes()
        if len(text) <= 64:
            if len(self.memory) >= CACHE:
                self.older = self.memory.copy()
                self.memory.clear()
            self.memory[text] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers. Special tokens' strings become those tokens."""
        memory, packed, out = self.memory, self._packed, []
        for part in self.split(text) if self.split and any(s in text for s in self.t.special) else (text,):
            if part in self.t.special:
                out.append(np.array([self.t.special[part]], "<i4").tobytes())
                continue
            for p in self.find(part):
                got = memory.get(p)
                out.append(packed(p) if got is None else got)
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """Each id's slice of the offset table, as UTF-8 with broken sequences replaced."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        start, size = self.t.offsets[ids], self.t.offsets[ids + 1] - self.t.offsets[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(start - ends + size, size)
        return np.frombuffer(self.t.blob, np.uint8)[at].tobytes().decode("utf-8", "replace")


def _codec(shared, name: str) -> Codec:
    return arrow.kept(f"codec {name}", lambda: Codec(shared.value))


def encode(docs: DataFrame, path: str, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append `ids` (array<int>) to every row; null and empty texts give an empty array. A column named ids is replaced.

    `path` is read on the driver; the tables (a few MB, fixed by the vocabulary) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Tables.load(path))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(shared, path)
        rows = [codec.encode(t) for t in arrow.strings(arrow.column(batch, text_col))]
        offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))]

    return arrow.with_columns(docs, "ids array<int>", compute, keep)


def decode(docs: DataFrame, path: str, *, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Append `decoded` (string) to every row; a null or empty array gives an empty text. A column named decoded is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(Tables.load(path))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        codec, col = _codec(shared, path), arrow.column(batch, ids_col)
        flat, offsets = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
        return [pa.array([codec.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())]

    return arrow.with_columns(docs, "decoded string", compute, keep)


def round_trip(docs: DataFrame, path: str, fields: str, derive: Callable, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode and decode in one pass: append the columns `fields` that derive(text, ids, decoded) returns for each row.

    `ids` is a 32-bit integer array. One Python worker a task holds the tables, where separate
    encode and decode steps need one each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Tables.load(path))
    types = [f.type for f in to_arrow_schema(_parse_datatype_string(fields))]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        codec, rows = _codec(shared, path), []
        for text in arrow.strings(arrow.column(batch, text_col)):
            ids = np.frombuffer(codec.encode(text), "<i4")
            rows.append(derive(text, ids, codec.decode(ids)))
        return [pa.array([r[n] for r in rows], t) for n, t in enumerate(types)]

    return arrow.with_columns(docs, fields, compute, keep)
