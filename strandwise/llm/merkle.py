"""A Merkle manifest of a dataset: leaves of rows, a tree for each source, a tree over the sources, and a proof for each row.

Tasks hold runs of consecutive leaves. Each of them builds a sparse forest: nodes by tree, level and
index, where a run of siblings becomes its parent as soon as it is complete, so that only O(log n)
unresolved nodes at the two ends of a run are left. Forests merge by union (an associative operation;
completed runs go on climbing), and treeReduce merges those of all tasks. What is resolved there is
noted: these few nodes at the borders of tasks (some dozens for each task) and a file of each task's
own upper nodes are all that proofs need beyond a window of `arity ** window` leaves.

Nulls are written as `-`, so they differ from empty values. A null source is a tree of its own, the
first one; a null id is the first of its source and counts as empty text for tampering. Rows of one id go
by their leaves; rows that are equal in all are leaves of their own with equal digests. Texts of any
length are hashed whole, in the JVM. An empty table has no rows. Other columns aren't read.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm import common as C

#: The tree over the sources; theirs are numbered from 0.
ROOT = -1
#: The "level" at which the number of a tree's leaves is noted.
SIZE = 255


def digest(parts: Iterable[bytes]) -> bytes:
    """Lower-case hex of the SHA-256 of concatenated parts."""
    return sha256(b"".join(parts)).hexdigest().encode()


class Forest:
    """Unresolved nodes of several trees. Digests are hex text; the size of a tree may come later."""

    def __init__(self, arity: int, trees: int, noted_from: int = 0):
        self.arity, self.noted_from = arity, noted_from
        self.sizes = {ROOT: trees}
        self.open: dict[tuple[int, int, int], bytes] = {}
        self.noted: dict[tuple[int, int, int], bytes] = {}

    def width(self, tree: int, level: int) -> int | None:
        """Nodes of a level, if the size is known."""
        n = self.sizes.get(tree)
        return None if n is None else -(-n // self.arity**level)

    def _note(self, tree: int, level: int, index: int, value: bytes) -> None:
        if tree == ROOT or level >= self.noted_from:
            self.noted[tree, level, index] = value

    def put(self, tree: int, level: int, index: int, value: bytes) -> None:
        """Adds a node; completed runs become their parents, a source's top becomes a leaf of the tree over sources."""
        while True:
            width = self.width(tree, level)
            if width == 1:
                self._note(tree, level, index, value)
                if tree == ROOT:
                    return
                tree, level, index = ROOT, 0, tree
                continue
            self.open[tree, level, index] = value
            first = index - index % self.arity
            run = [(tree, level, i) for i in range(first, first + self.arity if width is None else min(first + self.arity, width))]
            if any(x not in self.open for x in run):
                return
            for x in run:
                self._note(*x, self.open[x])
            value = digest(self.open.pop(x) for x in run)
            level, index = level + 1, index // self.arity

    def finish(self, tree: int, size: int) -> None:
        """The number of a tree's leaves: its last runs may be complete now."""
        self.sizes[tree] = size
        for x in sorted(x for x in self.open if x[0] == tree):
            if x in self.open:
                self.put(*x, self.open.pop(x))

    def merge(self, other: Forest) -> Forest:
        for tree, size in other.sizes.items():
            if tree not in self.sizes:
                self.finish(tree, size)
        self.noted |= other.noted
        for x, value in other.open.items():
            self.put(*x, value)
        return self


class Nodes:
    """Noted nodes in a file: sorted keys, searched where they are mapped."""

    def __init__(self, folder: str, name: str):
        raw = C.SharedFolder(folder).map(name)
        n = len(raw) // 81
        self.keys, self.values = raw[: 17 * n].view("S17"), raw[17 * n :].view("S64")

    @staticmethod
    def key(tree: int, level: int, index: int) -> bytes:
        return struct.pack(">qBq", tree + 1, level, index)

    @classmethod
    def write(cls, folder: str, name: str, nodes: dict[tuple[int, int, int], bytes]) -> None:
        pairs = sorted((cls.key(*x), v) for x, v in nodes.items())
        C.SharedFolder(folder).write(name, np.array([k for k, _ in pairs], "S17"), np.array([v for _, v in pairs], "S64"))

    def get(self, tree: int, level: int, index: int) -> bytes | None:
        if not len(self.keys):
            return None
        k = np.array([self.key(tree, level, index)], "S17")
        at = int(np.searchsorted(self.keys, k)[0])
        return self.values[at] if at < len(self.keys) and self.keys[at] == k[0] else None


def field(value: Column, text: bool = False) -> Column:
    """`-` for null, else the bytes' number, a colon and the value."""
    v = value.cast("string")
    return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf(text: Column) -> Column:
    """The digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)).cast("binary"), 256))


def tampered_rows() -> Column:
    return C.id_mod("doc_id", 2) == 0


NUMBERED = "doc_id long, leaf binary, changed binary, source string, part int, seq long, pos long"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each sorted row: the source's number in this part and the row's in the source."""
    part, seq, pos, last = TaskContext.get().partitionId(), -1, 0, object()
    for batch in batches:
        at = []
        for source in batch.column(3).to_pylist():
            if source != last or seq < 0:
                seq, pos, last = seq + 1, 0, source
            at.append((seq, pos))
            pos += 1
        seqs, places = zip(*at, strict=True) if at else ((), ())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([part] * len(at), pa.int32()), pa.array(seqs, pa.int64()), pa.array(places, pa.int64())], NUMBERED_NAMES)


NUMBERED_NAMES = [x.split()[0] for x in NUMBERED.split(", ")]


def stitched(parts: list) -> tuple[dict[int, tuple[int, int, dict[int, int]]], int]:
    """Of each part the number of its first source, the rows of that source before it, and the sizes of the sources at its two ends; the number of sources."""
    begins, sizes, last, source = {}, {}, -1, object()
    for p in parts:
        first = last if last >= 0 and p.first == source else last + 1
        begins[p.part] = (first, sizes.get(first, 0), first + p.seqs - 1)
        sizes[first] = sizes.get(first, 0) + p.n_first
        last, source = first + p.seqs - 1, p.last
        if p.seqs > 1:
            sizes[last] = p.n_last
    return {k: (first, before, {t: sizes[t] for t in (first, end)}) for k, (first, before, end) in begins.items()}, last + 1


def windows(batches: Iterator[pa.RecordBatch], begins: dict, leaves: int) -> Iterator[tuple[int, int, int, list]]:
    """(part, tree, first index, rows) of consecutive leaves of one tree that lie in one window."""

    def rows():
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5, 6)]
            for doc_id, value, changed, part, seq, pos in zip(*columns, strict=True):
                first, before, _ = begins[part]
                yield part, first + seq, pos + (before if seq == 0 else 0), doc_id, value, changed

    for (part, tree, _), own in groupby(rows(), lambda r: (r[0], r[1], r[2] // leaves)):
        own = list(own)
        yield part, tree, own[0][2], own


def manifest(docs: DataFrame, arity: int = 3, window: int = 9) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row; window: levels of nodes that a task holds at once."""
    spark = docs.sparkSession
    text, changed = F.col("text"), F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    rows = named.select("doc_id", leaf(text).alias("leaf"), F.when(tampered_rows() & F.contains(text, F.lit("\n")), leaf(changed)).alias("changed"), "source")
    keys = ["source", "doc_id", "leaf"]
    placed = C.cut(rows.withColumn("tie", F.monotonically_increasing_id()))  # so that copies of a row needn't meet in one task
    numbered = C.cut(placed.repartitionByRange(*keys, "tie").sortWithinPartitions(*keys).drop("tie").mapInArrow(_number, NUMBERED))
    ends = numbered.groupBy("part").agg(F.min(F.struct("seq", "source")).alias("a"), F.max(F.struct("seq", "source")).alias("b"), F.count_if(F.col("seq") == 0).alias("n_first"), F.max(F.struct("seq", "pos")).alias("c"))
    parts = ends.select("part", F.col("a.source").alias("first"), F.col("b.source").alias("last"), (F.col("b.seq") + 1).alias("seqs"), "n_first", (F.col("c.pos") + 1).alias("n_last")).orderBy("part").collect()  # a row for each task
    if not parts:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    begins, trees = stitched(parts)
    folder, leaves = C.SharedFolder.create(spark, "merkle"), arity**window

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, part, sizes = Forest(arity, trees, window), None, {}

        def finish() -> None:
            if tree is not None:
                forest.finish(tree, sizes.get(tree, upto))
                forest.noted[tree, SIZE, 0] = b"%d" % forest.sizes[tree]
                if tree not in sizes:  # resolved; its size isn't asked for again
                    del forest.sizes[tree]

        tree, upto = None, 0
        for part, at, first, own in windows(batches, begins, leaves):
            sizes = begins[part][2]
            if at != tree:
                finish()
                tree = at
            upto = first + len(own)
            for i, r in enumerate(own, first):
                forest.put(tree, 0, i, r[4].hex().encode())
        if part is not None:
            finish()
            Nodes.write(folder.uri, f"part-{part}", forest.noted)
            forest.noted = {x: v for x, v in forest.noted.items() if x[0] == ROOT and forest.width(*x[:2]) == 1}  # the root, if this task has all rows
            forest.noted_from = 0
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(forest)], pa.binary())], ["forest"])

    whole = numbered.mapInArrow(grow, "forest binary").rdd.map(lambda r: pickle.loads(bytes(r.forest))).treeReduce(Forest.merge)
    if whole.open:
        raise RuntimeError(f"{len(whole.open)} nodes of the manifest are unresolved")
    Nodes.write(folder.uri, "borders", whole.noted)
    top = 0
    while whole.width(ROOT, top) > 1:
        top += 1
    root = whole.noted[ROOT, top, 0]

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = own = None
        for part, tree, first, rows in windows(batches, begins, leaves):
            if own is None:
                borders, own = Nodes(folder.uri, "borders"), Nodes(folder.uri, f"part-{part}")
            size = int(own.get(tree, SIZE, 0))
            nodes = {(0, i): r[4].hex().encode() for i, r in enumerate(rows, first)}
            yield _proofs(rows, first, nodes, lambda *x: own.get(*x) or borders.get(*x), tree, size, trees, arity, window, root)

    return numbered.mapInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _proofs(rows: list, first: int, nodes: dict, noted, tree: int, size: int, trees: int, arity: int, window: int, root: bytes) -> pa.RecordBatch:
    """Proofs of a window's leaves. nodes: by level and index, at first the leaves; what isn't in the window is asked of `noted`."""
    widths = [size]
    while widths[-1] > 1:
        widths.append(-(-widths[-1] // arity))
    lo, hi = first, first + len(rows)
    for level, width in enumerate(widths[:-1]):
        if level == window:
            break
        lo, hi = lo // arity, -(-hi // arity)
        for parent in range(lo, hi):
            run = [nodes.get((level, i)) for i in range(parent * arity, min(parent * arity + arity, width))]
            if None not in run:
                nodes[level + 1, parent] = digest(run)

    def node(level: int, index: int) -> bytes:
        if (level, index) not in nodes:
            nodes[level, index] = noted(tree, level, index)
        return nodes[level, index]

    runs: dict[tuple[int, int], list[bytes]] = {}

    def run(level: int, index: int) -> list[bytes]:
        """The siblings of a node's run, itself included."""
        key = level, index // arity
        if key not in runs:
            start = index - index % arity
            runs[key] = [node(level, i) for i in range(start, min(start + arity, widths[level]))]
        return runs[key]

    above, at, width, level = [], tree, trees, 0
    while width > 1:  # the tree over the sources, the same for all of them
        start = at - at % arity
        above.append((at % arity, [noted(ROOT, level, i) for i in range(start, min(start + arity, width))]))
        at, width, level = at // arity, -(-width // arity), level + 1
    subroot = noted(ROOT, 0, tree)
    out = []
    for index, (*_, doc_id, value, changed) in enumerate(rows, first):
        path, at = [], index
        for level in range(len(widths) - 1):
            path.append((at % arity, run(level, at)))
            at //= arity
        path += above
        siblings, folded = [], (changed or value).hex().encode()
        for place, members in path:
            left, right = members[:place], members[place + 1 :]
            siblings += left + right
            folded = digest([*left, folded, *right])
        out.append((doc_id, value.hex(), subroot.decode(), root.decode(), digest(siblings).decode(), folded.decode(), folded == root))
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
