"""Document fingerprints: bottom-k sketches of word shingles.

A sketch holds the k smallest distinct 64-bit hashes of a text's shingles, as 16 hexadecimal
digits each, ascending. Sketches of parts merge into the sketch of the whole; two sketches
estimate resemblance and containment, one the number of distinct shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planarix import storage
from planarix.llm import arrow

K, SHINGLE = 128, 5


def sketches(col: pa.Array, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The k smallest distinct shingle hashes of each text, ascending; none for a text without words.

    A text of fewer words than a shingle has one shingle, all its words.
    """
    out: list[np.ndarray] = []
    for i, j, raw, off in arrow.pieces(col):
        starts, ends, rows = arrow.word_spans(raw, off)
        words = arrow.word_hashes(raw, starts, ends)
        bounds = np.searchsorted(rows, np.arange(j - i + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                out.append(np.zeros(0, np.uint64))
                continue
            first = np.arange(0, max(1, b - a - shingle + 1))
            h = arrow.window_hashes(words[a:b], first, np.minimum(first + shingle, b - a))
            if len(h) > 4 * k:  # most of a long text is out at once; ties of the k-th stay in
                low = np.partition(h, 2 * k)[2 * k]
                part = np.unique(h[h <= low])
                h = part if len(part) >= k else np.unique(h)
            else:
                h = np.unique(h)
            out.append(h[:k])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of what two sketches describe."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two texts without shingles are alike, one without is unlike the other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    return float(np.isin(union, a, assume_unique=True)[np.isin(union, b, assume_unique=True)].sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    j, n, m = resemblance(a, b, k), distinct(a, k), distinct(b, k)
    return float(min(1.0, j * (n + m) / (1 + j) / n))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1.0)


def to_hex(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_hex(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, *, text_col: str = "text", k: int = K, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Append `fingerprint` (hex) and `n_shingles` (estimated distinct shingles) to every row. Null texts count as empty; columns of these names are replaced."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        found = sketches(arrow.column(batch, text_col), k, shingle)
        return [pa.array([to_hex(s) for s in found], pa.string()), pa.array([distinct(s, k) for s in found], pa.float64())]

    return arrow.with_columns(docs, "fingerprint string, n_shingles double", compute, keep)


def merged(prints: DataFrame, by: list[str], *, k: int = K) -> DataFrame:
    """(by, fingerprint) of all rows of a group together: one row a group, null groups included, none for an empty table.

    Hashes are cut to the group's k smallest in two steps, first in each of 64 slices, so a hot group isn't
    gathered in one task. Groups without shingles have an empty fingerprint.
    """
    from pyspark.sql import Window

    names = [f"__by{n}" for n in range(len(by))]
    keyed = prints.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.coalesce("fingerprint", F.lit("")).alias("__f"))
    groups = keyed.select(*names).distinct()
    each = keyed.select(*names, F.explode(F.expr("transform(sequence(1, greatest(1, cast(length(__f) / 16 as int))), i -> substring(__f, (i - 1) * 16 + 1, 16))")).alias("__h")).where("__h <> ''").distinct()
    salted = each.withColumn("__slice", F.pmod(F.xxhash64("__h"), F.lit(64)))
    cut = salted.withColumn("__n", F.row_number().over(Window.partitionBy(*names, "__slice").orderBy("__h"))).where(F.col("__n") <= k)
    last = cut.withColumn("__n", F.row_number().over(Window.partitionBy(*names).orderBy("__h"))).where(F.col("__n") <= k)
    made = last.groupBy(*[F.col(n).alias(f"{n}_") for n in names]).agg(F.concat_ws("", F.array_sort(F.collect_list("__h"))).alias("fingerprint"))
    same = None
    for n in names:
        same = F.col(n).eqNullSafe(F.col(f"{n}_")) if same is None else same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    return groups.join(made, same, "left").select(*[F.col(n).alias(c) for c, n in zip(by, names, strict=True)], F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


#: Keys that are drawn for each range.
DRAWN = 32


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """Deal documents into ranges of ascending identifier, each followed by the next range's first document.

    Returns rows (part, guest, id, h, body), partitioned by part and sorted by (part, guest, id, h, body);
    guest rows only serve as the next document of the row before. Identifiers may be of any type
    with an order; null ones come first, equal ones go by a hash of the text (h), then by the text. Range bounds are
    quantiles of a sample of (id, h), drawn by hash, so that a hot identifier, null too, is divided as well.
    """
    spark = docs.sparkSession
    parts = storage.partitions(spark)
    body = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("h"), body.alias("body"))
    key = F.struct("id", "h")
    # about DRAWN keys a range come to the driver: those whose hash is low enough, each once
    wanted, total = DRAWN * parts, max(1, docs.count()) if parts > 1 else 1
    share = min(1.0, (wanted + 6 * wanted**0.5) / total)
    low = F.shiftrightunsigned(F.xxhash64("id", "h", F.lit("drawn")), 11) / F.lit(float(1 << 53)) < F.lit(share)
    drawn = base.select("id", "h").where(low).distinct().select(key.alias("k")).collect() if parts > 1 else []
    order = lambda k: (k["id"] is not None, k["id"] if k["id"] is not None else 0, k["h"])
    line = sorted((r["k"] for r in drawn), key=order)
    cuts = [line[len(line) * i // parts] for i in range(1, parts)] if line else []
    cuts = [c for n, c in enumerate(cuts) if not n or order(c) != order(cuts[n - 1])]
    placed = base.withColumn("part", _bucket(cuts, docs.schema[id_col].dataType))
    heads = [(r["part"], r["m"]["id"], r["m"]["h"]) for r in placed.select("part", key.alias("k")).groupBy("part").agg(F.min("k").alias("m")).orderBy("part").collect()]  # one row a range
    ranges = [p for p, _, _ in heads]
    if not ranges:
        return placed.limit(0).select("part", F.lit(False).alias("guest"), "id", "h", "body"), ranges
    kind = T.StructType().add("i", docs.schema[id_col].dataType).add("g", "long").add("host", "integer")
    hosts = spark.createDataFrame([(i, h, ranges[n - 1]) for n, (_, i, h) in enumerate(heads)], kind)
    first = placed.join(F.broadcast(hosts), (F.col("h") == F.col("g")) & F.col("id").eqNullSafe(F.col("i")))
    guests = first.groupBy("host").agg(F.min(F.struct("id", "h", "body")).alias("m")).select(F.col("host").alias("part"), F.lit(True).alias("guest"), "m.id", "m.h", "m.body")
    rows = placed.select("part", F.lit(False).alias("guest"), "id", "h", "body").unionByName(guests)
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", "id", "h", "body"), ranges


def _bucket(cuts: list, kind: T.DataType) -> Column:
    """Number of cuts (id, h) that are <= the row's, by bisection in nested conditions."""

    def below(c) -> Column:
        if c["id"] is None:
            return F.col("id").isNull() & (F.col("h") < F.lit(c["h"]))
        ident = F.lit(c["id"]).cast(kind)
        return F.col("id").isNull() | (F.col("id") < ident) | ((F.col("id") == ident) & (F.col("h") < F.lit(c["h"])))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(below(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def edited(text: str, following: str) -> str:
    """The last half of a text (rounded down, in code points) replaced by the first as many of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprint each text and its edited text, and estimate the resemblance to the edited and to the next text.

    Returns the identifier, n_chars, edited, fingerprint, edited_fingerprint, near_edited and near_next; other
    columns are left out. The next document is the one of next larger identifier; the first
    follows the last. Identifiers may be of any type with an order; null ones come first, rows of equal
    identifier go by a hash of the text, then by the text. Null texts count as empty. A single
    document is its own next; an empty table gives an empty one.
    """
    rows, _ = with_next(docs, id_col=id_col, text_col=text_col)
    kind = docs.schema[id_col].dataType
    schema = T.StructType().add(id_col, kind)
    for name, t in (("n_chars", "long"), ("edited", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")):
        schema = schema.add(name, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, id, text, sketch) of the row that waits for its next
        for batch in arrow.steps(batches):
            part, guest, ids, bodies = (arrow.column(batch, c) for c in ("part", "guest", "id", "body"))
            id_type, body_list = ids.type, bodies.to_pylist()
            own = sketches(bodies, k, shingle)
            pairs = []
            for p, g, i, t, s in zip(part.to_pylist(), guest.to_pylist(), ids.to_pylist(), body_list, own, strict=True):
                if held is not None and held[0] == p:
                    pairs.append((*held[1:], t, s))
                held = None if g else (p, i, t, s)
            for a in range(0, len(pairs), 1024):
                some = pairs[a : a + 1024]
                new = [edited(t, n) for _, t, _, n, _ in some]
                made = sketches(pa.array(new, pa.string()), k, shingle)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, *_ in some], id_type),
                        pa.array([len(t) for _, t, *_ in some], pa.int64()),
                        pa.array(new, pa.string()),
                        pa.array([to_hex(s) for _, _, s, _, _ in some], pa.string()),
                        pa.array([to_hex(e) for e in made], pa.string()),
                        pa.array([resemblance(s, e, k) for (_, _, s, _, _), e in zip(some, made, strict=True)], pa.float64()),
                        pa.array([resemblance(s, z, k) for _, _, s, _, z in some], pa.float64()),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)
