"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are majority votes over the XXH64 values of word shingles. To find all pairs
within `radius` differing bits, every bit position gets a non-zero vector of radius+1 bits;
each non-zero vector v of that size is a table, whose mask holds the positions whose vector has
an odd inner product with v. For any difference pattern of at most `radius` positions some v is
orthogonal to all their vectors, so the pair agrees on that table's whole mask: it collides
with certainty, not just probably.

Only distinct fingerprints enter the tables. A bucket never yields its pairs: it yields a
spanning forest of its own links, found by blockwise comparison in small buckets and, in large
ones, by looking up every neighbour within the radius (the free bits outside the mask).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarix import storage
from planarix.llm import arrow, resemblance
from planarix.llm.covering import masks
from planarix.operators.components import components

#: Buckets up to this size are compared blockwise, larger ones by neighbour look-up.
SMALL = 2048
_BLOCK = 512


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a text: A-Z lower-cased, word shingles with repeats, strict majority."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.array(hashes[i : i + 4096], ">u8")
        bits += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, text_col: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Append `fp` (long, the fingerprint's bits) to every row; null texts have no words. A column named fp is replaced."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        values = [fingerprint(t, shingle) for t in arrow.texts(arrow.column(batch, text_col))]
        return [pa.array(np.array(values, np.uint64).view(np.int64))]

    return arrow.with_columns(docs, "fp bigint", compute, keep)


class _Forest:
    """Union-find over positions of an array; roots are the smallest."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def bucket_links(values: np.ndarray, mask: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, representative) that span each group connected within `radius` bits.

    `values` are distinct unsigned fingerprints that agree on `mask`.
    """
    values = np.sort(values)
    n, forest = len(values), None
    forest = _Forest(n)
    if n <= SMALL:
        for i in range(0, n, _BLOCK):
            for j in range(i, n, _BLOCK):
                near = np.bitwise_count(values[i : i + _BLOCK, None] ^ values[None, j : j + _BLOCK]) <= radius
                for a, b in zip(*np.nonzero(np.triu(near, 1) if i == j else near), strict=True):
                    forest.join(i + int(a), j + int(b))
    else:
        free = [1 << b for b in range(64) if not mask >> b & 1]
        for r in range(1, radius + 1):
            for flips in combinations(free, r):
                other = values ^ np.uint64(sum(flips))
                at = np.searchsorted(values, other)
                at[at == n] = 0
                hit = np.flatnonzero((values[at] == other) & (at > np.arange(n)))
                for a, b in zip(hit.tolist(), at[hit].tolist(), strict=True):
                    forest.join(a, b)
    roots = np.fromiter((forest.find(i) for i in range(n)), np.int64, n)
    moved = np.flatnonzero(roots != np.arange(n))
    return values[moved], values[roots[moved]]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that span the same groups as all pairs within `radius`."""
    tables = masks(radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in tables])).alias("t", "key"))
    dealt = keyed.repartition(storage.partitions(distinct.sparkSession), "t", "key").sortWithinPartitions("t", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []  # the open bucket's parts

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                table, values = held[0][0], np.concatenate([h[2] for h in held])
                held.clear()
                if len(values) > 1:
                    a, b = bucket_links(values.view(np.uint64), tables[table], radius)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            fp, t, key = (arrow.column(batch, c).to_numpy(zero_copy_only=False) for c in ("fp", "t", "key"))
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(fp)]
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if a == b:
                    continue
                if held and held[0][:2] != (int(t[a]), int(key[a])):
                    yield from close()
                if not held and b - a == 1 and i < len(bounds) - 2:
                    continue  # a bucket of one, closed by the next
                held.append((int(t[a]), int(key[a]), fp[a:b].copy()))
        yield from close()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """Append `fp` and `component_id` to every row.

    With `similarity`, texts are linked by that Jaccard similarity of their shingle sets instead, and
    only component_id is appended. Fingerprints of texts 0.8 alike differ in ten of 64 bits as a rule, and covering
    ten bits takes 2047 tables; so the fingerprints are longer ones of 440 bits and covered piece by piece
    (`covering`), and what these tables link is decided on the sets (`resemblance`).

    Documents are linked when their fingerprints differ in `radius` bits at most; component_id is
    the smallest identifier reachable, the row's own included. Texts without words have
    fingerprint zero and are linked like any other. Null identifiers are never the smallest
    unless no other is there. Repeated rows share their component. Columns of these names are
    replaced.

    Fingerprints are computed once and kept in the shared folder with the identifier and a hash of
    the text, by which rows find their class again; joins on the fingerprint, which may be hot, have one
    row for each fingerprint on their other side.
    """
    if similarity is not None:
        return resemblance.near_copies(docs, id_col=id_col, text_col=text_col, shingle=shingle, least=similarity)
    base = docs.drop("fp", "component_id")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = fingerprints(base.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("body")), text_col="body", shingle=shingle, keep=["id", "t"])
    slim = storage.materialise(slim, "fingerprints")
    first = slim.groupBy("fp").agg(F.min("id").alias("first"))
    found = components(links(slim.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    grouped = first.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = storage.materialise(grouped.join(least, "component").select("fp", "component_id"), "classes")
    placed = slim.join(classes.hint("merge"), "fp")
    if set(base.columns) <= {id_col, text_col}:
        return placed.select(F.col("id").alias(id_col), "fp", "component_id")
    once = placed.dropDuplicates(["id", "t"]).select(F.col("id").alias("__id"), F.col("t").alias("__t"), F.col("fp").alias("__fp"), F.col("component_id").alias("__component"))
    rows = base.withColumn("__key", F.xxhash64(text))
    joined = rows.join(once.hint("merge"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__t")))
    return joined.select(*base.columns, F.col("__fp").alias("fp"), F.col("__component").alias("component_id"))
