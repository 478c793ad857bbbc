"""SimHash fingerprints of BITS bits and covering tables that find those few bits apart, at radii beyond what 64 bits allow.

A fingerprint's bit is 1 if set in over half of a text's shingle hashes. The bits are cut into pieces, and each
piece has the tables of `masks`: two fingerprints that differ in RADIUS bits of a piece at most collide there
with certainty. So any two within PIECES * (RADIUS + 1) - 1 bits (59 of 440) meet; texts of a similarity of 0.8, which
differ in 67 on average, miss all tables with probability 2e-6 (simulated for sets of 90 shingles; 4e-4 for sets of 4 and 5).

Pairs that meet are links if the first SENT numbers of their fingerprints differ in NEAR bits at most. Only
distinct fingerprints enter the tables. A bucket never yields its pairs: it yields links that span its groups. A few
tables are worked through first; in the others only links between different groups of these are given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarix import storage
from planarix.llm import arrow
from planarix.operators.components import components

PIECES, WIDTH, RADIUS = 20, 22, 2
BITS = PIECES * WIDTH
WORDS = -(-BITS // 64)
#: Numbers of a fingerprint that rows carry, bits of all of them and of the first one by which a link may differ.
SENT, NEAR, NEAR_FIRST = 3, 56, 28
#: Tables that are worked through first, and rows of a bucket up to which all its pairs are compared at once.
FIRST, SMALL = 4, 256
#: Links that a task holds before it joins them up.
MANY = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SENT = [f"p{i}" for i in range(SENT)]


def masks(radius: int, bits: int = 64) -> list[int]:
    """One mask for each non-zero vector of radius+1 bits; positions take the vectors in turn."""
    size = 1 << (radius + 1)
    return [sum(1 << i for i in range(bits) if ((1 + i % (size - 1)) & v).bit_count() % 2) for v in range(1, size)]


_MASKS = np.array(masks(RADIUS, WIDTH), np.uint64)
TABLES = PIECES * len(_MASKS)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS unsigned numbers: the majority of each bit over a text's shingle hashes; zero without any."""
    seeds = np.arange(1, WORDS + 1, dtype=np.uint64) * _ODD
    count = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), 255):  # counts of 255 rows fit in a byte
        some = arrow.mix(hashes[i : i + 255, None] ^ seeds)
        count += np.add.reduce(np.unpackbits(some.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(hashes)).view(np.uint64)


def keys(prints: np.ndarray) -> np.ndarray:
    """One row of TABLES bucket numbers (32 bits) for each row of WORDS numbers."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1)
    powers = np.uint64(1) << np.arange(WIDTH, dtype=np.uint64)
    out = np.empty((len(prints), TABLES), np.int32)
    for i in range(PIECES):
        piece = bits[:, i * WIDTH : (i + 1) * WIDTH].astype(np.uint64) @ powers
        for j, mask in enumerate(_MASKS):
            t = i * len(_MASKS) + j
            out[:, t] = (arrow.mix((piece & mask) * _ODD + np.uint64(t)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Differing bits; the last axis holds a fingerprint's numbers."""
    return np.bitwise_count(one ^ two).sum(-1, dtype=np.uint16)


def spanning(pairs: np.ndarray) -> np.ndarray:
    """Pairs (least, other) that join up the same names as the rows of `pairs`, one for each name but the least."""
    names, ends = np.unique(pairs, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new[label]
    moved = np.flatnonzero(label != np.arange(len(names)))
    return np.stack([names[label[moved]], names[moved]], 1)


def bucket_links(group: np.ndarray, prints: np.ndarray, near: int = NEAR) -> Iterator[tuple[int, int]]:
    """Links that span the groups which have members within `near` bits of each other, in one bucket."""
    names, label = np.unique(group, return_inverse=True)

    def join(mine: int, others: np.ndarray) -> Iterator[tuple[int, int]]:
        for other in np.unique(others):
            if other != mine:
                yield int(names[mine]), int(names[other])
                label[label == other] = mine

    for turn in range(8):  # a large group of copies is joined up by a few of its members
        if not label.any() and len(names) == 1:
            return
        large = np.bincount(label).argmax()
        inside = np.flatnonzero(label == large)
        rest = np.flatnonzero(label != large)
        if not len(rest):
            return
        lead = prints[inside[turn * 2654435761 % len(inside)]]
        yield from join(int(large), label[rest[_apart(prints[rest], lead) <= near]])
    large = np.bincount(label).argmax()
    rest = np.flatnonzero(label != large)
    for i in range(0, len(rest), SMALL):
        some = rest[i : i + SMALL]
        hit = _apart(prints[some, None], prints[None]) <= near
        for row, found in zip(some, hit, strict=True):
            yield from join(int(label[row]), label[found])


def _forest(rows: DataFrame) -> DataFrame:
    """(a, b): links that span what meets in a bucket, of rows (bucket, g, p0 ..); a row goes by g, or p0 where g is 0."""
    dealt = rows.repartition(storage.partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")

    def small(bucket: np.ndarray, name: np.ndarray, prints: np.ndarray) -> Iterator[np.ndarray]:
        """Links of whole buckets of SMALL rows at most; the rows of a bucket follow each other."""
        head = np.ascontiguousarray(prints[:, 0])
        for step in range(1, SMALL):
            met = np.flatnonzero((bucket[step:] == bucket[:-step]) & (name[step:] != name[:-step]))
            if not len(met):
                if not (bucket[step:] == bucket[:-step]).any():
                    return
                continue
            met = met[np.bitwise_count(head[met] ^ head[met + step]) <= NEAR_FIRST]
            met = met[_apart(prints[met], prints[met + step]) <= NEAR]
            yield np.stack([name[met], name[met + step]], 1)

    def pairs(bucket: np.ndarray, name: np.ndarray, prints: np.ndarray) -> Iterator[np.ndarray]:
        bounds = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        size = np.diff(bounds)
        few = np.repeat((size > 1) & (size <= SMALL), size)
        yield from small(bucket[few], name[few], prints[few])
        for at in np.flatnonzero(size > SMALL):
            one = slice(bounds[at], bounds[at + 1])
            yield np.array(list(bucket_links(name[one], prints[one])), np.int64).reshape(-1, 2)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Links of whole buckets, which may span batches."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the open bucket's parts
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, g, *words = (arrow.column(batch, c).to_numpy(zero_copy_only=False) for c in ("bucket", "g", *_SENT))
            name, prints = np.where(g == 0, words[0], g), np.stack(words, 1).view(np.uint64)
            last = int(np.searchsorted(bucket, bucket[-1]))
            if last or held and held[0][0][0] != bucket[0]:
                parts = [*held, (bucket[:last], name[:last], prints[:last])]
                held = []
                yield from pairs(*map(np.concatenate, zip(*parts, strict=True)))
            held.append((bucket[last:].copy(), name[last:].copy(), prints[last:].copy()))
        if held:
            yield from pairs(*map(np.concatenate, zip(*held, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 2), np.int64)
        new: list[np.ndarray] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], names=["a", "b"])

        for some in whole(batches):
            new.append(some)
            if sum(map(len, new)) >= MANY:
                kept, new = spanning(np.concatenate([kept, *new])), []
                if len(kept) >= MANY:
                    yield batch()
                    kept = kept[:0]
        kept = spanning(np.concatenate([kept, *new]))
        if len(kept):
            yield batch()

    return dealt.mapInArrow(arrow.lean(run), "a bigint, b bigint").distinct()


def _tables(prints: DataFrame, first: int, last: int) -> DataFrame:
    """(bucket, g, p0 ..) of tables first to last - 1, of rows (print, g)."""
    step = 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.steps(batches):
            g = arrow.column(batch, "g").to_numpy(zero_copy_only=False)
            words = arrow.column(batch, "print").flatten().to_numpy(zero_copy_only=False).reshape(-1, WORDS)
            found = keys(words.view(np.uint64))
            for t in range(first, last, step):
                some = found[:, t : min(t + step, last)]
                columns = [g, *words.T[:SENT]]
                yield pa.RecordBatch.from_arrays([pa.array(some.T.ravel()), *[pa.array(np.tile(x, some.shape[1])) for x in columns]], names=["bucket", "g", *_SENT])

    return prints.select("print", "g").mapInArrow(arrow.lean(run), f"bucket int, g bigint, {', '.join(f'{c} bigint' for c in _SENT)}")


def groups(prints: DataFrame) -> DataFrame:
    """(node, component) of what meets within NEAR bits, of distinct fingerprints (print, an array of WORDS numbers).

    Fingerprints go by their first number, the node.
    """
    links = storage.materialise(_forest(_tables(prints.withColumn("g", F.lit(0).cast("long")), 0, FIRST)), "links")
    placed = storage.materialise(components(links), "placed")
    known = prints.withColumn("node", F.col("print")[0]).join(placed.hint("merge"), "node", "left").select("print", F.coalesce("component", F.lit(0)).alias("g"))
    return components(links.unionAll(storage.materialise(_forest(_tables(known, FIRST, TABLES)), "links")))
