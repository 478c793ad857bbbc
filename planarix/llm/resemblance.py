"""Near copies by SimHash, decided exactly: texts whose sets of word shingles have a Jaccard similarity of `least` or more.

Candidates are the groups that SimHash fingerprints and their covering tables give (`covering`); links
between their members are then decided on the whole shingle sets, so every link is exact.

No group yields its pairs. Every member is held against a few of its group; what these link is one component. Then the
members of a group's smaller components are held against some of its largest. What is still apart is
compared in blocks, inside Arrow batches that return links only: nodes outside a group's largest
component with the whole of that component, each of its members once, and with each other. So a large
group of copies costs about its size.

Shingle sets are made for the texts in shared groups alone, from their texts; fingerprints of all texts
are written, sets aren't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarix import storage
from planarix.llm import arrow, covering
from planarix.operators.components import components

SHINGLE, LEAST = 5, 0.8
#: Members that a whole group is held against at a time, and nodes that are compared together.
FEW, BLOCK = 4, 512
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(col: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Ascending distinct 64-bit shingle hashes of each text, A-Z lower-cased; of fewer words than a shingle, all words are one."""
    out: list[np.ndarray] = []
    for i, j, raw, off in arrow.pieces(col):
        raw = _LOWER[raw]
        starts, ends, rows = arrow.word_spans(raw, off)
        words = arrow.word_hashes(raw, starts, ends)
        bounds = np.searchsorted(rows, np.arange(j - i + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            first = np.arange(0, max(1, b - a - shingle + 1)) if b > a else np.zeros(0, np.int64)
            out.append(np.unique(arrow.window_hashes(words[a:b], first, np.minimum(first + shingle, b - a))) if b > a else np.zeros(0, np.uint64))
    return out


def _node(sets: list[np.ndarray]) -> np.ndarray:
    """One number for each different set."""
    return np.array([arrow.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, t, node, n, print): texts of equal shingle sets are one node; node 0 has no words."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = shingle_sets(arrow.column(batch, "body"), shingle)
        prints = np.array([covering.fingerprint(s) for s in sets], np.uint64).reshape(-1, covering.WORDS)
        ends = np.arange(len(sets) + 1, dtype=np.int32) * covering.WORDS
        return [pa.array(_node(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(prints.ravel().view(np.int64)))]

    return arrow.with_columns(docs, "node bigint, n bigint, print array<bigint>", compute, ["id", "t"])


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of texts (body)."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = shingle_sets(arrow.column(batch, "body"), shingle)
        ends = np.cumsum([0, *map(len, sets)])
        return [pa.array(_node(sets)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))]

    return arrow.with_columns(docs, "node bigint, shingles array<bigint>", compute, [])


def _decide(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are at least so similar. Sets have one row a node, so a hot member splits in the join."""
    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    return joined.where(both >= F.lit(least) * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def buckets(nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """(key, node, n): members of the groups that two nodes (node, n, print) share.

    Sets that no different set can be similar enough to, being too small, are left out.
    """
    able = storage.materialise(nodes.where(F.col("n") >= F.lit(least) * (F.col("n") + 1)).dropDuplicates(["node"]), "nodes")
    placed = covering.groups(able.select("print").distinct()).select(F.col("node").alias("p"), "component")
    first = able.select("node", "n", F.col("print")[0].alias("p"))
    keyed = first.join(placed.hint("merge"), "p", "left").select(F.coalesce("component", "p").alias("key"), "node", "n")
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    return keyed.join(shared.hint("merge"), "key")


def _compare(left: DataFrame, right: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes (g, node) of both sides with equal g that are at least so similar.

    Each side of a group is cut into blocks of about BLOCK nodes by hash, and every two blocks meet once: a
    task holds a block, however large the group.
    """

    def blocks(side: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        n = side.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"n{name}"))
        return side.join(n.hint("merge"), "g").withColumn(name, F.pmod(F.hash("node"), F.col(f"n{name}"))).drop(f"n{name}"), n

    (one, n_one), (two, n_two) = blocks(left, "i"), blocks(right, "j")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = one.join(n_two.hint("merge"), "g").select("g", "i", each("nj").alias("j"), F.lit(0).alias("side"), "node")
    two = two.join(n_one.hint("merge"), "g").select("g", each("ni").alias("i"), "j", F.lit(1).alias("side"), "node")
    rows = one.unionByName(two).join(sets.hint("merge"), "node")
    dealt = rows.repartition(storage.partitions(sets.sparkSession), "g", "i", "j").sortWithinPartitions("g", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, nodes, held, flat, at, size = None, [], [], None, None, None
        for batch in batches:
            keys = zip(*(arrow.column(batch, c).to_pylist() for c in ("g", "i", "j")), strict=True)
            side, node = (arrow.column(batch, c).to_numpy(zero_copy_only=False) for c in ("side", "node"))
            lists = arrow.column(batch, "shingles")
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            found: list[tuple[int, int]] = []
            for n, key in enumerate(keys):
                one = values[ends[n] : ends[n + 1]]
                if key != open_:
                    open_, nodes, held, flat = key, [], [], None
                if side[n] == 0:
                    nodes.append(int(node[n]))
                    held.append(np.sort(one))
                    continue
                if not held:
                    continue
                if flat is None:
                    flat, size = np.concatenate(held), np.array([len(h) for h in held])
                    at = np.cumsum(size) - size
                one = np.sort(one)
                spot = np.searchsorted(one, flat).clip(max=len(one) - 1)
                both = np.add.reduceat((one[spot] == flat).astype(np.int64), at)
                hit = np.flatnonzero(both >= least * (size + len(one) - both))
                found += [(nodes[h], int(node[n])) for h in hit if nodes[h] != node[n]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(arrow.lean(run), "a bigint, b bigint").distinct()


def links(members: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """(node, component) of the nodes in groups that have another within `least`; component is the smallest node reachable.

    `members` is what `buckets` gives; `sets` has (node, shingles) of the same nodes, one row each.
    """
    close = F.least("n", "m") >= F.lit(least) * F.greatest("n", "m")
    pair = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]

    def open_buckets(placed: DataFrame) -> DataFrame | None:
        """Members of groups that hold several components, with their own and their group's largest."""
        now = members.join(placed.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        sizes = now.groupBy("key", "component").agg(F.count("*").alias("c"))
        largest = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("l"), F.count("*").alias("k")).where("k > 1").select("key", F.col("l.component").alias("big"))
        now = storage.materialise(now.join(largest.hint("merge"), "key"), "open")
        return None if now.isEmpty() else now

    def against_some(now: DataFrame, leaders: DataFrame, turn: int) -> DataFrame:
        leader = lambda r: F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("h"), "node", "n", "component"))
        lead = leaders.groupBy("key").agg(F.array(*[leader(turn * FEW + i) for i in range(FEW)]).alias("some"))
        lead = lead.select("key", F.explode("some").alias("l")).select("key", F.col("l.node").alias("other"), F.col("l.n").alias("m"), F.col("l.component").alias("its"))
        pairs = now.join(lead.hint("merge"), "key").where((F.col("component") != F.col("its")) & close).select(*pair).distinct()
        return storage.materialise(_decide(pairs, sets, least), "links")

    every = members.withColumn("component", F.col("node"))
    found = against_some(every, every, 0)
    placed = storage.materialise(components(found), "placed")
    now = open_buckets(placed)
    if now is None:
        return placed
    found = found.unionAll(against_some(now, now.where("component = big"), 1))
    placed = storage.materialise(components(found), "placed")
    now = open_buckets(placed)
    if now is None:
        return placed
    other = now.where("component <> big")
    whole = placed.select(F.col("component").alias("g"), "node")
    alone = other.select(F.col("big").alias("g")).distinct().join(placed.select(F.col("component").alias("g")).distinct().hint("merge"), "g", "left_anti")
    whole = whole.unionByName(alone.select("g", F.col("g").alias("node")))
    aside = other.select(F.col("big").alias("g"), "node").distinct()
    apart = other.select(F.col("key").alias("g"), "node")
    several = apart.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g")
    apart = apart.join(several.hint("merge"), "g")
    wanted = aside.select("g").distinct()
    more = _compare(aside, whole.join(wanted.hint("merge"), "g", "left_semi"), sets, least).unionAll(_compare(apart, apart, sets, least))
    return storage.materialise(components(found.unionAll(storage.materialise(more, "links"))), "placed")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Append `component_id`, the smallest identifier reachable over links, the row's own included.

    Texts without words (null, empty or white space) are linked to each other only. Null identifiers
    are the smallest only where no other is there. Rows that repeat identifier and text share
    their component. Long texts are worked through in steps. An empty table gives an empty one. A
    column named component_id is replaced.
    """
    base = docs.drop("component_id")
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = base.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("body"))
    slim = storage.materialise(_prints(plain, shingle), "signatures")
    members = storage.materialise(buckets(slim.select("node", "n", "print"), least), "buckets")
    used = members.select("node").distinct()
    first_row = slim.join(used.hint("merge"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "t")).alias("r")).select(F.col("r.id").alias("i"), F.col("r.t").alias("u"))
    bodies = plain.join(first_row, F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u")), "left_semi").select("body")
    sets = storage.materialise(_sets(bodies, shingle).dropDuplicates(["node"]), "sets")
    placed = links(members, sets, least)
    first = slim.groupBy("node").agg(F.min("id").alias("first"))
    grouped = first.join(placed.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("__component"))
    classes = grouped.join(smallest.hint("merge"), "component").select("node", "__component")
    # only rows whose component isn't their own identifier are joined on: few, as a rule
    other = slim.select(F.col("id").alias("__id"), F.col("t").alias("__t"), "node").join(classes.hint("merge"), "node").where("not __id <=> __component").drop("node").distinct()
    other = storage.materialise(other, "classes")
    rows = base.withColumn("__key", F.xxhash64(text))
    joined = rows.join(other, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__t")), "left")
    return joined.select(*base.columns, F.coalesce("__component", F.col(id_col)).alias("component_id"))
