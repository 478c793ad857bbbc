"""Arrow batches in and out of Python, and word hashing over whole batches.

A word is a maximal run of bytes outside space and 0x09-0x0D, which is what
``bytes.split()`` splits on. All functions see whole texts; batches are only cut
between rows.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from planarix import storage

#: Bytes of text that one vectorised step holds, unless a single text is longer.
STEP_BYTES = 1 << 20
#: Rows of a batch that are turned into Python objects together.
STEP_ROWS = 1024

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def with_columns(df: DataFrame, fields: str, compute: Callable[[pa.RecordBatch], list], keep: list[str] | None = None) -> DataFrame:
    """Append the columns that `compute` makes from each Arrow batch.

    Input columns of the same (case-insensitive) names are replaced; `keep` narrows the others.
    Inputs of fewer partitions than cores, as one small file gives, are dealt out first.
    """
    added = T._parse_datatype_string(fields)
    new = {f.name.lower() for f in added.fields}
    kept = [c for c in df.columns if c.lower() not in new and (keep is None or c in keep)]
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)
    names = kept + [f.name for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + compute(batch), names=names)

    return storage.spread(df).mapInArrow(lean(run), schema)


_Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_MALLOC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_KEPT: dict[str, object] = {}
_STEP: list[str] = []


def lean(run: _Run) -> _Run:
    """`run` for mapInArrow, leaving little in its Python worker, which lives on for the tasks of other steps.

    Memory that is free goes back to the system after each batch and each task; what a step has `kept` goes when
    a task of another one begins.
    """
    step = uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(step)
        try:
            yield from run(_one_by_one(batches))
        finally:
            give_back()

    return task


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch
        del batch
        give_back()


def begin(step: str) -> None:
    """A task of `step` begins in this process: what others have kept goes."""
    if _STEP != [step]:
        _STEP[:] = [step]
        _KEPT.clear()


def kept(name: str, make: Callable[[], object]) -> object:
    """What `make` gives, made once for the tasks of a step that run in this process."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def give_back() -> None:
    """Return what Arrow's pool and malloc hold free to the system; they would keep the most that any step needed."""
    pa.default_memory_pool().release_unused()
    if _MALLOC_TRIM:
        _MALLOC_TRIM(0)


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of STEP_ROWS, which bounds the Python objects alive at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(start, STEP_ROWS)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def binary(col: pa.Array) -> pa.Array:
    """A text column as binary with null as empty."""
    col = col.cast(pa.large_binary()) if not pa.types.is_binary(col.type) else col
    return pc.fill_null(col, b"") if col.null_count else col


def texts(col: pa.Array) -> list[bytes]:
    return binary(col).to_pylist()


def strings(col: pa.Array) -> list[str]:
    return [x or "" for x in col.to_pylist()]


def pieces(col: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows that hold about `step` bytes together."""
    col = binary(col)
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + step, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word; texts never run into each other."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    rows = np.searchsorted(off, starts, "right") - 1
    return starts, ends, rows


_MUL = 0x9E3779B97F4A7C15
_ONE = np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (self.base, inverse))
        return self.up, self.down


_POWERS = _Powers(0xC2B2AE3D27D4EB4F)
#: Longest word that the table below hashes.
_LONG = 64
#: One random value for each place in a word and byte there.
_TABLE = mix(np.arange(1, _LONG * 256 + 1, dtype=np.uint64) * np.uint64(_MUL))
#: Windows that one vectorised step hashes.
_STEP_WINDOWS = 1 << 17


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: the sum of a random value for each byte and its place; BLAKE2b for words over _LONG bytes.

    Long texts are worked through in steps.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP_BYTES, "right")))
        first, last = starts[i:j] - starts[i], ends[i:j] - starts[i]
        some = raw[starts[i] : ends[j - 1]]
        if j > i + 1 or len(some) <= _LONG:
            place = np.arange(len(some), dtype=np.int32)
            place -= np.repeat(first.astype(np.int32), np.diff(first, append=len(some)))
            np.minimum(place, _LONG - 1, out=place)
            place <<= 8
            place |= some
            sums = np.empty(len(some) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_TABLE[place], out=sums[1:])
            out[i:j] = sums[last] - sums[first]
        for k in np.flatnonzero(last - first > _LONG).tolist():
            out[i + k] = int.from_bytes(hashlib.blake2b(some[first[k] : last[k]].tobytes(), digest_size=8).digest(), "little")
        i = j
    return mix(out ^ ((ends - starts).astype(np.uint64) * np.uint64(_MUL)))


def window_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of the word sequences words[first:last], whose bounds ascend."""
    out = np.empty(len(first), np.uint64)
    for i in range(0, len(first), _STEP_WINDOWS):
        j = min(len(first), i + _STEP_WINDOWS)
        a, b = first[i], last[j - 1]
        up, down = _POWERS.upto(int(b - a) + 1)
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(words[a:b] * up[: b - a], out=sums[1:])
        out[i:j] = (sums[last[i:j] - a] - sums[first[i:j] - a]) * down[first[i:j] - a]
    return mix(out + (last - first).astype(np.uint64) * np.uint64(_MUL))


def squeeze(numbers: np.ndarray) -> bytes:
    """Integers as compressed bytes: differences, byte by byte of their places; ascending ones take a byte or two each."""
    steps = np.diff(numbers.astype(np.int64), prepend=0)
    return zstd.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstd.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(planes.T.copy().view(np.int64).ravel())
