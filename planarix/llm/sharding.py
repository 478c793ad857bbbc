"""Shards of near equal bytes by sampled splitters.

Records are ordered by hash of the text, then identifier, so equal
texts are neighbours. Splitters are drawn in proportion to size: of exponential variates
divided by size, the smallest K. One scan sums sizes and rows of the ranges between them. A
shard boundary is placed by the exact sums; a range that a boundary would cut too coarsely is
overfull, and is subdivided with splitters of its own, until the cuts are within tolerance or
single records.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planarix import storage
from planarix.llm import arrow

#: Splitters of the first draw and of each subdivision.
SPLITTERS, FINER = 2048, 64


def _ranges(keys: list[tuple[int, int]]):
    """A function that numbers the range of each (hash, ident) pair: how many splitters are <= the pair."""
    hashes = np.array([h for h, _ in keys], np.int64)
    idents = np.array([i for _, i in keys], np.int64)

    def number(h: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        out = hi.copy()
        for a in np.unique(lo[lo < hi]):
            some = (lo == a) & (lo < hi)
            out[some] = a + np.searchsorted(idents[a : hi[some][0]], i[some], "right")
        return out

    return number


def _numbered(rows: DataFrame, keys: list[tuple[int, int]]) -> DataFrame:
    """rows (h, i, ...) with the column `part`: a lookup in at most a few thousand splitters."""
    number = _ranges(keys)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        h, i = (arrow.column(batch, c).to_numpy(zero_copy_only=False) for c in ("h", "i"))
        return [pa.array(number(h, i).astype(np.int32))]

    return arrow.with_columns(rows, "part int", compute)


def _draw(rows: DataFrame, n: int) -> list[tuple[int, int]]:
    """Up to n distinct keys, drawn with chances in proportion to size; the draw is fixed by the keys."""
    u = (F.shiftrightunsigned(F.xxhash64("h", "i", F.lit("draw")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    got = rows.select("h", "i", (-F.log(u) / F.col("size")).alias("e")).orderBy("e", "h", "i").limit(n).collect()
    return sorted({(r["h"], r["i"]) for r in got})


def splitters(rows: DataFrame, shards: int, rounds: int = 12, tolerance: float = 1e-4) -> list[tuple[tuple[int, int], int, int, int]]:
    """Ranges in key order: (splitter that starts it, bytes, rows, shard).

    `rows` has h, i (the key) and size. At most SPLITTERS + rounds * shards * FINER keys and as
    many sums come to the driver, whatever the input. Raises if ranges are still overfull after so many
    rounds; ranges of one key can't be divided and don't count.
    """
    keys = [(-(1 << 63), -(1 << 63)), *_draw(rows, SPLITTERS)]
    keys = sorted(set(keys))
    for _ in range(rounds + 1):
        sums = {r["part"]: (r["bytes"], r["n"]) for r in _numbered(rows, keys[1:]).groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        parts = [(*sums.get(k, (0, 0)),) for k in range(len(keys))]
        ends = np.cumsum([b for b, _ in parts])
        total = int(ends[-1]) if len(ends) else 0
        wanted = [total * s / shards for s in range(1, shards)]
        overfull = sorted({int(np.searchsorted(ends, w, "left")) for w in wanted if np.min(np.abs(np.concatenate([[0], ends]) - w)) > tolerance * total / shards})
        overfull = [k for k in overfull if parts[k][1] > 1]
        if not overfull:
            break
        if _ == rounds:
            raise RuntimeError(f"shards aren't within {tolerance} of each other after {rounds} rounds")
        inner = _numbered(rows, keys[1:]).where(F.col("part").isin(overfull))
        u = (F.shiftrightunsigned(F.xxhash64("h", "i", F.lit(_)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        line = Window.partitionBy("part").orderBy("e", "h", "i")
        draw = inner.withColumn("e", -F.log(u) / F.col("size")).withColumn("nth", F.row_number().over(line)).where(F.col("nth") <= FINER)
        fresh = set(keys) | {(r["h"], r["i"]) for r in draw.select("h", "i").collect()}
        if len(fresh) == len(keys):
            break
        keys = sorted(fresh)
    out, done = [], 0
    for key, (size, n) in zip(keys, parts, strict=True):
        # a range belongs to the shard in which its middle lies
        shard = min(shards - 1, int((done + size / 2) * shards / total)) if total else 0
        out.append((key, int(size), int(n), shard))
        done += size
    return out


def assign(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Append size (UTF-8 bytes plus 1), text_crc32, shard and slot (gapless from 0 in each shard) to every row.

    Shards get near equal bytes: off by less than a ten-thousandth or by one record, whichever is more.
    Equal texts are neighbours and part only where a boundary falls among them, as a hot group
    must. Rows with equal text and identifier keep together, in any order among themselves. Null
    texts have size 1; identifiers may be null. An empty table gives an empty one. Columns of these names are replaced. Text itself is never shuffled in the
    query; slots are numbered within small ranges, whose counts are known, not within whole shards.
    """
    base = docs.drop("size", "text_crc32", "shard", "slot")
    rest = [c for c in base.columns if c != text_col]
    body = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.col(id_col)
    number = ident.cast("long") if dict(base.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(ident)
    keyed = base.select(
        F.struct(*rest).alias("row"), F.xxhash64(body).alias("h"), F.coalesce(number, F.lit(-(1 << 63))).alias("i"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"),
    )
    keyed = storage.materialise(keyed, "keys")
    ranges = splitters(keyed.select("h", "i", "size"), shards)
    before = dict.fromkeys(range(shards), 0)
    shard, offset = [], []
    for _, _, n, s in ranges:
        shard.append(s)
        offset.append(before[s])
        before[s] += n
    numbered = _numbered(keyed, [k for k, *_ in ranges][1:])
    line = Window.partitionBy("part").orderBy("h", "i")
    table = docs.sparkSession.createDataFrame(pd.DataFrame({"part": np.arange(len(ranges), dtype=np.int32), "shard": np.array(shard, np.int32), "offset": np.array(offset, np.int64)}), "part int, shard int, offset bigint")
    out = numbered.withColumn("nth", F.row_number().over(line)).join(F.broadcast(table), "part")  # one row a range, bounded above
    return out.select("row.*", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"))
