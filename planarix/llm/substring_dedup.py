"""Removal of repeated word windows with a count-min prefilter.

Every text is a sequence of words; a window is `size` consecutive words of one document. Words
covered by a window whose sequence also starts elsewhere are removed.

Documents are packed into compressed blocks first, each with a number of its own, and written once;
messages name blocks and places in them, and answers find their way back by them.

First pass. A window is represented by its *minimizer*: the smallest hash among its runs of
`gram` words. Equal windows have equal minimizers at equal relative positions, so the number
of places where a run of words is a minimizer is never below the number of starts of any
window it represents. Each partition counts these places in a count-min sketch of two rows. The
sketch's cells grow with the corpus and are dealt over tasks by ranges; a task merges the
partitions' counts of its ranges and tells each block which of its cells count two or more. A window
whose estimate (the smaller of its two cells) is one is unique, for certain, and is left out of
what follows.

Second pass. Windows estimated repeated are grouped exactly, by BLAKE2b (128 bits) over the bytes
of their words. Each task sends one record for each different window, so a passage in a third
of all documents costs one record a task; windows repeated within a task are settled there. A
grouping task remembers each window once, with the first place it was seen at, and answers the
others as they come. Answers return by block, and covered words are cut from whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planarix import storage
from planarix.llm import arrow

SIZE, GRAM = 35, 8


@dataclass(frozen=True)
class Limits:
    """What tasks hold at most; answers don't depend on it. `range_bits` cells of the sketch, as a power of two, are merged together."""

    block: int = 1 << 20  #: bytes of text in a block, unless a single text is longer
    dest: int = 1 << 27  #: bytes of text in the blocks that wait for answers together
    held: int = 1 << 20  #: windows, cells or answers before they are sent on
    step: int = 1 << 18  #: windows of a long text that are worked through together
    cells: int = 12  #: cells of a sketch row for each estimated minimizer
    least_bits: int = 16  #: binary logarithm of the smallest sketch row
    range_bits: int = 20


LIMITS = Limits()


def _slide(x: np.ndarray, n: int, take) -> np.ndarray:
    """take over every n consecutive values, by doubling."""
    out, width = x, 1
    while 2 * width <= n:
        out = take(out[:-width], out[width:])
        width *= 2
    if width < n:
        out = take(out[: len(out) - (n - width)], out[n - width :])
    return out


def minimizers(words: np.ndarray, starts: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(minimizer of each window in `starts`, hash of each place that is some window's minimizer)."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    first = np.arange(len(words) - gram + 1)
    grams = arrow.window_hashes(words, first, first + gram)
    reach = size - gram + 1
    least = _slide(grams, reach, np.minimum)
    valid = np.zeros(len(least), np.uint64)
    valid[starts] = least[starts]
    # a place is a minimizer if the largest of the minima of the windows over it is its own hash
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), valid, np.zeros(reach - 1, np.uint64)])
    most = _slide(padded, reach, np.maximum)[: len(grams)]
    return least[starts], grams[most == grams]


class _Block:
    """Words of a block of documents."""

    def __init__(self, col: pa.Array) -> None:
        _, _, self.raw, self.off = next(arrow.pieces(col, 1 << 62))
        self.starts, self.ends, self.rows = arrow.word_spans(self.raw, self.off)

    def windows(self, size: int, gram: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(starts of windows, their minimizers, hashes of minimizer places), in steps; no window crosses documents."""
        for a in range(0, len(self.starts) - size + 1, step):
            b = min(a + step + size - 1, len(self.starts))
            rows = self.rows[a:b]
            at = np.flatnonzero(rows[: b - a - size + 1] == rows[size - 1 :])
            if len(at):
                words = arrow.word_hashes(self.raw, self.starts[a:b], self.ends[a:b])
                yield (at + a, *minimizers(words, at, size, gram))

    def digests(self, at: np.ndarray, size: int) -> np.ndarray:
        """BLAKE2b of the windows that start at words `at`, joined by one space, as rows of two 64-bit numbers."""
        lens = np.cumsum(np.concatenate([[0], self.ends - self.starts + 1]))
        body, inside = np.full(int(lens[-1]), 0x20, np.uint8), np.ones(int(lens[-1]), bool)
        inside[lens[1:] - 1] = False
        body[inside] = self.raw[~arrow.SPACE[self.raw]]
        text, digest = body.tobytes(), hashlib.blake2b
        out = b"".join([digest(text[a:b], digest_size=16).digest() for a, b in zip(lens[at].tolist(), (lens[at + size] - 1).tolist(), strict=True)])
        return np.frombuffer(out, np.uint64).reshape(-1, 2)


def cells(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's cell in either sketch row; those of the second are numbered after the first's."""
    second = arrow.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), (second >> np.uint64(64 - bits)).astype(np.int64) + (1 << bits)


def _runs(flags: np.ndarray, size: int) -> np.ndarray:
    """Words covered by windows that start where flags are set."""
    change = np.zeros(len(flags) + size + 1, np.int32)
    at = np.flatnonzero(flags)
    change[at] = 1
    change[at + size] -= 1
    return np.cumsum(change)[: len(flags)] > 0


# The fields of the tables of blocks, messages and answers.
_PACKED = "block bigint, n_bytes bigint, payload binary"
_CELLS = "span int, cells binary, more binary, owner binary, blocks binary"
_ASKED = "bucket bigint, hashes binary, more binary, places binary, owner binary, blocks binary"
_ANSWER = "dest bigint, places binary, owner binary, blocks binary"


def _rows(fields: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in fields.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[t]) for n, t in enumerate(types)], names=list(names))


def _cuts(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal keys."""
    if len(sorted_keys):
        edges = [0, *(np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1).tolist(), len(sorted_keys)]
        yield from zip(edges[:-1], edges[1:], strict=True)


def _named(blocks: np.ndarray) -> tuple[bytes, bytes]:
    """Block numbers as (number of each item's block in the list, list)."""
    some, owner = np.unique(blocks, return_inverse=True)
    return arrow.squeeze(owner), arrow.squeeze(some)


def _blocks_of(owner: bytes, blocks: bytes) -> np.ndarray:
    return arrow.unsqueeze(blocks)[arrow.unsqueeze(owner)]


def _dest(block: np.ndarray, dests: int) -> np.ndarray:
    """Destination of blocks, dealt in turn."""
    return ((block >> 32) + (block & 0xFFFFFFFF)) % dests


class _Answers:
    """Places (numbers, 64 bits) found repeated, held by block and sent on by destination."""

    def __init__(self, dests: int, most: int) -> None:
        self.dests, self.most, self.blocks, self.places, self.held = dests, most, [], [], 0

    def add(self, blocks: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(blocks):
            self.blocks.append(blocks)
            self.places.append(places)
            self.held += len(blocks)
            if self.held > self.most:
                yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            blocks, places = np.concatenate(self.blocks), np.concatenate(self.places)
            dest = _dest(blocks, self.dests)
            order = np.lexsort((places, blocks, dest))  # neighbours make small differences
            blocks, places, dest = blocks[order], places[order], dest[order]
            self.blocks, self.places, self.held = [], [], 0
            yield _rows(_ANSWER, [(int(dest[a]), arrow.squeeze(places[a:b]), *_named(blocks[a:b])) for a, b in _cuts(dest)])


def packed(docs: DataFrame, text_col: str, block: int = LIMITS.block) -> DataFrame:
    """(block, n_bytes, payload): all rows in compressed Arrow blocks of about `block` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, raw, _ in arrow.pieces(arrow.column(batch, text_col), block):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                    out.write_batch(batch.slice(i, j - i))
                yield _rows(_PACKED, [(number, len(raw), sink.getvalue().to_pybytes())])
                number += 1

    return docs.mapInArrow(run, _PACKED)


def _unpacked(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def repeated_cells(blocks: DataFrame, text_col: str, dests: int, bits: int, size: int, gram: int, lim: Limits = LIMITS) -> DataFrame:
    """Answers: the cells of each block that count two or more over all blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            if held:
                cell, more, owner = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                order = np.argsort(cell, kind="stable")
                cell, more, owner = cell[order], more[order], owner[order]
                spans = cell >> lim.range_bits
                for a, b in _cuts(spans):
                    yield _rows(_CELLS, [(int(spans[a]), arrow.squeeze(cell[a:b] & (1 << lim.range_bits) - 1), np.packbits(more[a:b]).tobytes(), *_named(owner[a:b]))])

        for batch in batches:
            for number, payload in zip(arrow.column(batch, "block").to_pylist(), arrow.column(batch, "payload").to_pylist(), strict=True):
                found = [p for _, _, p in _Block(arrow.column(_unpacked(payload), text_col)).windows(size, gram, lim.step)]
                if found:
                    for cell in cells(np.concatenate(found), bits):
                        some, n = np.unique(cell, return_counts=True)
                        held.append((some, n > 1, np.full(len(some), number)))
                if sum(len(h[0]) for h in held) > lim.held:
                    yield from send()
        yield from send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, answers = None, _Answers(dests, lim.held)
        state, first = np.zeros(1 << lim.range_bits, np.uint8), np.zeros(1 << lim.range_bits, np.int64)  # counts up to two, and the first block
        for batch in batches:
            for now, cell, more, owner, blocks in zip(*(arrow.column(batch, c).to_pylist() for c in ("span", "cells", "more", "owner", "blocks")), strict=True):
                if now != span:
                    span = now
                    state[:] = 0
                cell, holder = arrow.unsqueeze(cell), _blocks_of(owner, blocks)
                more = np.unpackbits(np.frombuffer(more, np.uint8), count=len(cell)).astype(bool)
                some, start, group, n = np.unique(cell, return_index=True, return_inverse=True, return_counts=True)
                old = state[some]
                many = (old > 0) | (n > 1) | np.logical_or.reduceat(more, start)
                base = span << lim.range_bits
                pending = some[old == 1]
                yield from answers.add(first[pending], pending + base)
                hit = many[group]
                yield from answers.add(holder[hit], cell[hit] + base)
                state[some] = np.where(many, 2, 1)
                first[some[~many]] = holder[start[~many]]
        yield from answers.send()

    parts = storage.partitions(blocks.sparkSession)
    asked = blocks.select("block", "payload").mapInArrow(count, _CELLS)
    return asked.repartitionById(parts, F.col("span") % parts).sortWithinPartitions("span").mapInArrow(merge, _ANSWER)


def _meet(answers: DataFrame, blocks: DataFrame, dests: int) -> DataFrame:
    """Answers and blocks in one stream, a destination's answers before its blocks."""
    parts = storage.partitions(blocks.sparkSession)
    number = F.col("block")
    dest = (F.shiftrightunsigned(number, 32) + number.bitwiseAND(F.lit(0xFFFFFFFF))) % dests
    one = answers.select("dest", F.lit(0).alias("kind"), "places", "owner", "blocks", F.lit(None).cast("bigint").alias("block"), F.lit(None).cast("binary").alias("payload"))
    two = blocks.select(dest.alias("dest"), F.lit(1).alias("kind"), *[F.lit(None).cast("binary").alias(c) for c in ("places", "owner", "blocks")], "block", "payload")
    return one.unionByName(two).repartitionById(parts, (F.col("dest") % parts).cast("int")).sortWithinPartitions("dest", "kind")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(block, payload, its answers' places) from such a stream. Answers of one destination are held."""
    open_, held = None, {}
    for batch in batches:
        columns = [arrow.column(batch, c) for c in ("dest", "kind", "places", "owner", "blocks", "block", "payload")]
        for i in range(batch.num_rows):
            dest, kind, places, owner, blocks, block, payload = (c[i].as_py() for c in columns)
            if dest != open_:
                open_, held = dest, {}
            if kind == 0:
                mine, got = _blocks_of(owner, blocks), arrow.unsqueeze(places)
                order = np.argsort(mine, kind="stable")
                mine, got = mine[order], got[order]
                for a, b in _cuts(mine):
                    held.setdefault(int(mine[a]), []).append(got[a:b])
            else:
                yield block, payload, np.concatenate(held.pop(block, [np.zeros(0, np.int64)]))


def repeated_windows(blocks: DataFrame, text_col: str, size: int = SIZE, gram: int = GRAM, lim: Limits = LIMITS) -> tuple[DataFrame, int]:
    """Answers: the first words (numbers in the block) of windows that start elsewhere too; and the number of destinations."""
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    estimate = max(1, n_bytes // 5 * 2 // (size - gram + 2))  # words, times the density of minimizers
    bits = max(lim.least_bits, (lim.cells * estimate - 1).bit_length())
    parts = storage.partitions(blocks.sparkSession)
    dests, buckets = max(parts, n_bytes // lim.dest), max(parts, n_bytes // (8 * lim.held))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h, block, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((h[:, 1], h[:, 0]))
            h, block, place = h[order], block[order], place[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]).any(1)])
            several = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
            # windows repeated here: settled, and told to the others once
            answers = _Answers(dests, lim.held)
            for batch in [*answers.add(block[several], place[several]), *answers.send()]:
                yield _rows(_ASKED, [(-1 - d, None, None, *rest) for d, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True)])
            ask = np.flatnonzero(new)
            bucket = (h[ask, 0] % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((place[ask], block[ask], bucket))
            ask, bucket = ask[order], bucket[order]
            for a, b in _cuts(bucket):
                w = ask[a:b]
                yield _rows(_ASKED, [(int(bucket[a]), h[w].tobytes(), np.packbits(several[w]).tobytes(), arrow.squeeze(place[w]), *_named(block[w]))])

        for number, payload, found in _met(batches):
            if not len(found):
                continue
            found = np.unique(found)
            words = _Block(arrow.column(_unpacked(payload), text_col))
            at = []
            for starts, least, _ in words.windows(size, gram, lim.step):
                run = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                one, two = cells(least[run], bits)
                hit = (found[np.searchsorted(found, one).clip(max=len(found) - 1)] == one) & (found[np.searchsorted(found, two).clip(max=len(found) - 1)] == two)
                at.append(starts[np.repeat(hit, np.diff(run, append=len(least)))])
            at = np.concatenate([np.zeros(0, np.int64), *at])
            for a in range(0, len(at), lim.held):
                some = at[a : a + lim.held]
                held.append((words.digests(some, size), np.full(len(some), number), some))
                if sum(len(x[0]) for x in held) > lim.held:
                    yield from send()
        yield from send()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, bucket = _Answers(dests, lim.held), None
        none = (np.zeros((0, 2), np.uint64), np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64))
        known, waiting, n = none, [], 0  # different windows of the bucket: hash, state (0 seen once, 1 new, 2 repeated), block, place

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal known, waiting, n
            if waiting:
                h, state, block, place = (np.concatenate(x) for x in zip(known, *waiting, strict=True))
                waiting, n = [], 0
                order = np.lexsort((state, h[:, 1], h[:, 0]))  # what was seen once comes first, what is known repeated last
                h, state, block, place = h[order], state[order], block[order], place[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]).any(1)])
                of, start = np.cumsum(new) - 1, np.flatnonzero(new)
                many = (np.bincount(of) > 1) | (np.maximum.reduceat(state, start) > 1)
                # known repeated windows have their answers, and so have those settled where they come from
                hit = many[of] & (state < 2)
                yield from answers.add(block[hit], place[hit])
                known = (h[start], np.where(many, 2, 0).astype(np.int8), block[start], place[start])

        for batch in batches:
            for now, h, more, places, owner, blocks in zip(*(arrow.column(batch, c).to_pylist() for c in ("bucket", "hashes", "more", "places", "owner", "blocks")), strict=True):
                if now < 0:  # settled already
                    yield _rows(_ANSWER, [(-1 - now, places, owner, blocks)])
                    continue
                if now != bucket:
                    yield from settle()
                    known, bucket = none, now
                at = arrow.unsqueeze(places)
                more = np.unpackbits(np.frombuffer(more, np.uint8), count=len(at))
                waiting.append((np.frombuffer(h, np.uint64).reshape(-1, 2), (1 + more).astype(np.int8), _blocks_of(owner, blocks), at))
                n += len(at)
                if n > lim.held:
                    yield from settle()
        yield from settle()
        yield from answers.send()

    found = repeated_cells(blocks, text_col, dests, bits, size, gram, lim)
    asked = _meet(found, blocks, dests).mapInArrow(candidates, _ASKED)
    number = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    dealt = asked.repartitionById(parts, (number % parts).cast("int")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(group, _ANSWER), dests


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, limits: Limits = LIMITS) -> DataFrame:
    """Append n_words, n_removed and kept (the remaining words joined by one space) to every row.

    Windows are judged on the input. Null and empty texts have no words; identifiers may be null or
    repeat. Rows that repeat identifier and text are documents of their own: each makes the
    other's windows repeated. An empty table gives an empty one. Columns of these names are
    replaced. Memory: a block (or one longer text) a task, a range of the sketch, `limits.held`
    messages, the different windows of a bucket and the answers of one destination; ranges, buckets and
    destinations grow in number with the corpus, not in size.
    """
    base = storage.spread(docs.drop("n_words", "n_removed", "kept"))
    columns = base.columns
    blocks = storage.materialise(packed(base, text_col, limits.block), "blocks")
    answers, dests = repeated_windows(blocks, text_col, size, gram, limits)
    schema = T.StructType([*base.schema.fields]).add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payload, found in _met(batches):
            rows = _unpacked(payload)
            for i, j, part in _cut(arrow.column(rows, text_col), found, size):
                yield pa.RecordBatch.from_arrays([*rows.slice(i, j - i).columns, *part], names=[*columns, "n_words", "n_removed", "kept"])

    return _meet(answers, blocks, dests).mapInArrow(cut, schema)


def _cut(col: pa.Array, found: np.ndarray, size: int) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """(first row, end row, [n_words, n_removed, kept]) of a block, without the words of windows that start at `found`."""
    block = _Block(col)
    flags = np.zeros(len(block.starts), bool)
    flags[found] = True
    gone = _runs(flags, size)
    bounds = np.searchsorted(block.rows, np.arange(len(col) + 1))
    removed = np.concatenate([[0], np.cumsum(gone)])
    n_removed = removed[bounds[1:]] - removed[bounds[:-1]]
    data = block.raw.tobytes()
    kept = []
    for n, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if not n_removed[n]:
            kept.append(b" ".join(data[block.off[n] : block.off[n + 1]].split()).decode())
            continue
        left = np.flatnonzero(~gone[a:b]) + a
        kept.append(b" ".join([data[s:e] for s, e in zip(block.starts[left].tolist(), block.ends[left].tolist(), strict=True)]).decode())
    for i in range(0, len(col), arrow.STEP_ROWS):
        j = min(len(col), i + arrow.STEP_ROWS)
        yield i, j, [pa.array(np.diff(bounds[i : j + 1]), pa.int64()), pa.array(n_removed[i:j], pa.int64()), pa.array(kept[i:j], pa.string())]
