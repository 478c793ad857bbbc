"""Exact deduplication with Patricia tries.

Every text, with A-Z lower-cased, is inserted as a full byte string into a compressed radix
trie. A first trie in each input partition merges copies before anything is shuffled; then
records are dealt out by length and content hash, and each partition's trie finds the owner
of every text. Terminal nodes hold the smallest identifier (in the chosen order) and the
number of rows. A trie over its memory limit spills its largest subtree to a temporary file
that is read back, as a trie of its own, after the rest.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planarix import storage
from planarix.llm import arrow

#: Bytes that a trie may hold before it spills (or, before the shuffle, is passed on).
TRIE_BYTES = 48 << 20
_NODE = 240  # bytes that a node takes besides its label


class _Node:
    __slots__ = ("label", "children", "rows", "best", "spill")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.rows, self.best, self.spill = label, {}, 0, None, None


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:], by bisection over block comparisons."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaTrie:
    """A radix trie of byte strings with an identifier and a row count at terminal nodes.

    Identifiers compare with ``<``; None loses against any other. `largest` turns the order.
    """

    def __init__(self, limit: int = TRIE_BYTES, largest: bool = False, folder: str | None = None) -> None:
        self.root, self.used, self.limit, self.largest, self.folder, self.spills = _Node(b""), 0, limit, largest, folder, 0

    def _better(self, a, b):
        if a is None or b is None:
            return b if a is None else a
        return max(a, b) if self.largest else min(a, b)

    def insert(self, key: bytes, best, rows: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((key[at:], best, rows), node.spill, -1)
                return
            if at == len(key):
                node.best = self._better(node.best, best) if node.rows else best
                node.rows += rows
                return
            child = node.children.get(key[at])
            if child is None:
                leaf = _Node(key[at:])
                leaf.best, leaf.rows = best, rows
                node.children[key[at]] = leaf
                self.used += len(leaf.label) + _NODE
                return
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            cut = _common(child.label, key, at)
            middle = _Node(child.label[:cut])
            child.label = child.label[cut:]
            middle.children[child.label[0]] = child
            node.children[key[at]] = middle
            self.used += _NODE
            node, at = middle, at + cut

    def full(self) -> bool:
        return self.used > self.limit

    @staticmethod
    def _size(node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            n = stack.pop()
            total += len(n.label) + _NODE
            stack += n.children.values()
        return total

    def shrink(self) -> None:
        """Spill the largest subtree below the first branching node, until half the limit is free."""
        while self.used > self.limit // 2:
            node, path = self.root, 0
            while len(live := [c for c in node.children.values() if c.spill is None]) == 1 and live[0].children:
                node = live[0]
                path += 1
            live = [c for c in node.children.values() if c.spill is None]
            if not live:
                return
            victim = max(live, key=self._size)
            self.used -= self._size(victim) - len(victim.label) - _NODE
            file = tempfile.TemporaryFile(dir=self.folder)  # has no name, so it is gone with the process
            for key, best, rows in self._walk(victim, b"", skip=len(victim.label)):
                pickle.dump((key, best, rows), file, -1)
            victim.children, victim.rows, victim.best, victim.spill = {}, 0, None, file
            self.spills += 1
            if len(node.children) == 1:
                return

    def _walk(self, top: _Node, prefix: bytes, skip: int = 0) -> Iterator[tuple[bytes, object, int]]:
        stack = [(top, prefix)]
        while stack:
            node, before = stack.pop()
            key = before + node.label
            if node.spill is not None:
                node.spill.seek(0)
                inner = PatriciaTrie(self.limit, self.largest, self.folder)
                while True:
                    try:
                        rest, best, rows = pickle.load(node.spill)
                    except EOFError:
                        break
                    inner.insert(rest, best, rows)
                    if inner.full():
                        inner.shrink()
                node.spill.close()
                for rest, best, rows in inner.items():
                    yield (key + rest)[skip:], best, rows
            elif node.rows:
                yield key[skip:], node.best, node.rows
            stack += [(c, key) for c in node.children.values()]

    def items(self) -> Iterator[tuple[bytes, object, int]]:
        """(key, best identifier, rows) of every terminal node; spilled subtrees are read back."""
        return self._walk(self.root, b"")


def owners(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", limit: int = TRIE_BYTES) -> DataFrame:
    """One row for each different text: digest (of the normalised bytes), keep_id, group_size."""
    largest = {"smallest": False, "largest": True}[keep]
    kind = docs.schema[id_col].dataType
    rows = T.StructType().add("n_bytes", "long").add("hash", "long").add("body", "binary").add("best", kind).add("n", "long")
    arrow_kind = T.StructType().add("x", kind)
    from pyspark.sql.pandas.types import to_arrow_schema

    id_type = to_arrow_schema(arrow_kind).field(0).type

    def batch_of(items: list[tuple[bytes, object, int]]) -> pa.RecordBatch:
        keys = [k for k, _, _ in items]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([len(k) for k in keys], pa.int64()),
                pa.array([xxhash.xxh64_intdigest(k) - (1 << 63) for k in keys], pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array([b for _, b, _ in items], id_type),
                pa.array([n for _, _, n in items], pa.int64()),
            ],
            names=rows.names,
        )

    def drain(trie: PatriciaTrie, make) -> Iterator[pa.RecordBatch]:
        some, held = [], 0
        for item in trie.items():
            some.append(item)
            held += len(item[0])
            if len(some) >= 4096 or held > (2 << 20):
                yield make(some)
                some, held = [], 0
        if some:
            yield make(some)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(limit, largest)
        for batch in arrow.steps(batches):
            for ident, text in zip(batch.column(0).to_pylist(), arrow.texts(batch.column(1)), strict=True):
                trie.insert(text.lower(), ident)  # bytes.lower() touches A-Z only
                if trie.full():
                    yield from drain(trie, batch_of)
                    trie = PatriciaTrie(limit, largest)
        yield from drain(trie, batch_of)

    def owned(items: list[tuple[bytes, object, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([hashlib.sha256(k).digest() for k, _, _ in items], pa.binary()),
                pa.array([b for _, b, _ in items], id_type),
                pa.array([n for _, _, n in items], pa.int64()),
            ],
            names=["digest", "keep_id", "group_size"],
        )

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(limit, largest)
        for batch in arrow.steps(batches):
            for key, best, n in zip(*(arrow.column(batch, c).to_pylist() for c in ("body", "best", "n")), strict=True):
                trie.insert(key, best, n)
                if trie.full():
                    trie.shrink()
        yield from drain(trie, owned)

    parts = storage.partitions(docs.sparkSession)
    small = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(arrow.lean(combine), rows)
    dealt = small.repartition(parts, "n_bytes", "hash").select("body", "best", "n")
    return dealt.mapInArrow(arrow.lean(own), T.StructType().add("digest", "binary").add("keep_id", kind).add("group_size", "long"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", limit: int = TRIE_BYTES) -> DataFrame:
    """Append keep_id, group_size, kept and digest (SHA-256 of the normalised text) to every row.

    Null texts count as empty. Null identifiers lose against any other. Rows that repeat both
    identifier and text are one document: they share their fate and each counts in group_size.
    Columns of the four names are replaced.
    The big side of the closing join may hold hot texts; the other has one row a text, so
    skewed partitions split without loss.
    """

    def digests(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([hashlib.sha256(t.lower()).digest() for t in arrow.texts(arrow.column(batch, text_col))], pa.binary())]

    found = owners(docs, id_col=id_col, text_col=text_col, keep=keep, limit=limit)
    base = docs.drop("keep_id", "group_size", "kept", "digest")
    marked = arrow.with_columns(base, "digest binary", digests)
    joined = marked.join(found.hint("merge"), "digest", "left")
    return joined.select(*base.columns, "digest", "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"))
