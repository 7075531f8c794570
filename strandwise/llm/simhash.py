"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within four bits share a variant at distance two or less of each. All variants of a
fingerprint are 2081; they are emitted in two factors. The scan emits the distinct heads (a leading
block with up to two of its bits flipped) with the fingerprint, which is what is shuffled; the task
that gets a head enumerates the variants of the other bits with the flips that are left, sorts them,
and takes those that collide. So every variant is made once, by the task that its value names, and
none needs to be written. Colliding pairs are deduplicated, verified, and thinned to a spanning
forest per head, whose links keep all components. Equal fingerprints are one from the start.

Null text is empty. A text without words has fingerprint zero and is linked like any other; one of
fewer words than a shingle has that one shingle. Repeated rows have equal fingerprints and so share a
component. A null id never is a component's id, unless all ids of it are null. Only id and text are read.

Near copies with more edits than the radius allows are linked where any of several fingerprints is near:
`prints` of them, of the same shingles under independent hashes, miss a pair that one finds with
probability p with (1 - p) ** prints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm import common as C
from strandwise.llm.common import U64
from strandwise.llm.components import connected_components
from strandwise.operators import graph

MOST_VARIANTS = 4 << 20  # that are in memory at once
SALTS = 32
HOT = 10_000
_LANES = U64(0x0101010101010101)


def fingerprints_of(data: np.ndarray, offs: np.ndarray, words: int = 4, seed: int = 42, prints: int = 1) -> np.ndarray:
    """Fingerprints of the rows of a block of UTF-8 text; with several prints, a column for each, the first of them XXH64's own."""
    rows = len(offs) - 1
    out = np.zeros((rows, prints), U64)
    low = C.LOWER[data]
    starts, ends = C.runs(~C.SPACE[low], offs)
    if not len(starts):
        return out[:, 0] if prints == 1 else out
    # the words again, one space behind each
    length = ends - starts
    begin = np.cumsum(length + 1) - (length + 1)
    spaced = np.full(int(begin[-1] + length[-1] + 1), 0x20, np.uint8)
    spaced[C.ragged(begin, length)] = low[C.ragged(starts, length)]
    at = C.per_row(starts, offs)
    n = np.diff(at)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    first = C.ragged(at[:-1], count)
    last = np.minimum(first + words, np.repeat(at[1:], count)) - 1
    raw, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(raw[a:b], seed) for a, b in zip(begin[first].tolist(), (begin[last] + length[last]).tolist(), strict=True)], U64)
    # ones of each bit: eight byte lanes at once, over at most 255 shingles before they are widened
    filled = np.flatnonzero(count)
    count = count[filled]
    parts = -(-count // 255)
    part_of = np.cumsum(parts) - parts
    cuts = np.repeat(np.cumsum(count) - count - 255 * part_of, parts) + 255 * np.arange(int(parts.sum()))
    for column in range(prints):
        own = h if not column else C.mix(h ^ U64(column * 0x9E3779B97F4A7C15 % (1 << 64)))
        for k in range(8):
            lanes = np.add.reduceat((own >> U64(k)) & _LANES, cuts).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(lanes.astype(np.int64), part_of, axis=0)
            bits = (2 * ones > count[:, None]).astype(U64)
            out[filled, column] |= (bits << (U64(8) * np.arange(8, dtype=U64) + U64(k))).sum(1, dtype=U64)
    return out[:, 0] if prints == 1 else out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints_of(data, offs, words) for *_, data, offs in C.text_blocks(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*found, np.zeros(0, U64)]).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(scan, "doc_id long, fp long")


def _flips(bits: int, most: int) -> np.ndarray:
    """Masks of up to `most` of the lowest bits, fewest first."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(bits), k)], U64)


def _collisions(fps: np.ndarray, head: int, bits: int, half: int) -> np.ndarray:
    """Pairs (i, j), i < j, of distinct positions whose variants meet under this head."""
    tail = 64 - bits
    low = fps & U64((1 << tail) - 1)
    left = half - np.bitwise_count((fps >> U64(tail)) ^ U64(head)).astype(np.int64)
    masks = _flips(tail, half)
    sizes = np.array([np.count_nonzero(np.bitwise_count(masks) <= r) for r in range(half + 1)])
    total = int(sizes[left].sum())
    cut = min(tail, max(0, (total // MOST_VARIANTS).bit_length()))  # further leading bits, dealt one value at a time
    pairs = [np.zeros((0, 2), np.int64)]
    lead = (low >> U64(tail - cut)).astype(np.int64) if cut else np.zeros(len(low), np.int64)
    mask_lead = (masks >> U64(tail - cut)).astype(np.int64) if cut else np.zeros(len(masks), np.int64)
    mask_size = np.bitwise_count(masks)
    for part in range(1 << cut):
        values, owners = [], []
        for x in np.unique(mask_lead):
            here = lead == part ^ x
            for r in range(half + 1):
                own = np.flatnonzero(here & (left == r))
                use = masks[(mask_lead == x) & (mask_size <= r)]
                if len(own) and len(use):
                    values.append((low[own][:, None] ^ use[None, :]).ravel())
                    owners.append(np.repeat(own, len(use)))
        if not values:
            continue
        values, owners = np.concatenate(values), np.concatenate(owners)
        ordered = np.sort(values)
        met = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(met):
            continue
        hit = C.find(met, values)
        keep = np.flatnonzero(hit >= 0)
        group, owner = hit[keep], owners[keep]
        order = np.lexsort((owner, group))
        group, owner = group[order], owner[order]
        first = np.concatenate(([True], group[1:] != group[:-1]))
        centre = owner[np.flatnonzero(first)][np.cumsum(first) - 1]  # all that hold a variant are linked to the first
        found = np.stack([centre, owner], 1)[~first]
        pairs.append(np.unique(found, axis=0))
    return np.unique(np.concatenate(pairs), axis=0)


def _forest(pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for nodes that aren't roots: the least position that the pairs reach."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], label[pairs[:, 1]])
        np.minimum.at(new, pairs[:, 1], label[pairs[:, 0]])
        new = new[new]
        if (new == label).all():
            node = np.flatnonzero(label != np.arange(n))
            return node, label[node]
        label = new


def ball_links(prints: DataFrame, radius: int = 4, block_bits: int | None = None, kinds: int = 1) -> DataFrame:
    """Links (a, b, kind) between distinct fingerprints (fp) whose components are those of all pairs within the radius (even).

    With several kinds of fingerprints, prints has a column `kind` (from 0), and only those of one kind meet.
    """
    half = radius // 2
    assert radius == 2 * half, "an even radius meets in the middle"
    if block_bits is None:  # heads grow in number with the fingerprints
        block_bits = max(12, min(20, (prints.count() // kinds).bit_length() - 9))
    bits, heads = block_bits, _flips(block_bits, half)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            kind = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(fps), 1 << 15):
                part = fps[k : k + (1 << 15)]
                head = (((part >> U64(64 - bits))[:, None] ^ heads[None, :]).astype(np.int64) | kind[k : k + (1 << 15)][:, None] << 32).ravel()
                order = np.argsort(head, kind="stable")
                head = head[order]
                values = part[order // len(heads)]
                first = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
                ends = [*first[1:].tolist(), len(head)]
                yield pa.RecordBatch.from_arrays([pa.array(head[first]), pa.array([values[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary())], ["head", "fps"])

    def meet(rows: pa.Table) -> pa.Table:
        kind, head = divmod(rows["head"][0].as_py(), 1 << 32)
        fps = np.unique(np.frombuffer(b"".join(rows["fps"].to_pylist()), U64))
        pairs = _collisions(fps, head, bits, half)
        pairs = pairs[np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= radius]
        node, root = _forest(pairs, len(fps))
        return pa.table({"a": fps[root].view(np.int64), "b": fps[node].view(np.int64), "kind": np.full(len(node), kind, np.int32)})

    kind = F.col("kind").cast("int") if kinds > 1 else F.lit(0)
    return prints.select("fp", kind.alias("kind")).mapInArrow(emit, "head long, fps binary").groupBy("head").applyInArrow(meet, "a long, b long, kind int")


def _thinned(links: DataFrame) -> DataFrame:
    """Distinct links (a, b, kind) with the same components: each b is linked to the least of its a's alone, and the others of these to that one.

    A group of near copies meets at many heads, each of which has a forest of it: together they have a link for each fingerprint
    and head, but few roots. A fingerprint has a link of each of its heads at most.
    """
    least = links.groupBy("kind", "b").agg(F.sort_array(F.collect_set("a")).alias("all"))
    return least.select(F.col("all")[0].alias("a"), F.explode(F.concat(F.array("b"), F.slice("all", F.lit(2), F.size("all")))).alias("b"), "kind").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp and component_id, the smallest id that is reachable over fingerprints within the radius."""
    return _placed(C.cut(fingerprints(docs, doc_id, text, words)), radius)


def _placed(prints: DataFrame, radius: int) -> DataFrame:
    """The same for rows of doc_id and fp."""
    by_print = C.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(ball_links(by_print, radius).select("a", "b"))
    # a component of very many fingerprints is no hot group: its minimum is taken by salts and goes back to them
    linked = C.cut(by_print.join(roots, by_print["fp"] == roots["node"]).select("fp", "least", "root", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt")))
    least = linked.groupBy("root", "salt").agg(F.min("least").alias("least")).groupBy("root").agg(F.min("least").alias("component_id"))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    classes = linked.join(spread, ["root", "salt"]).select(F.col("fp").alias("node"), "component_id")
    placed = C.cut(by_print.join(classes, by_print["fp"] == classes["node"], "left").select(F.col("fp").alias("of"), F.coalesce("component_id", "least").alias("component_id"), "n"))
    # fingerprints of more than a part in HOT of all rows, under HOT by number, are broadcast; the rest join by key
    total = by_print.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = C.cut(placed.filter(F.col("n") > max(total / HOT, 1)))
    copies = prints.join(F.broadcast(hot), prints["fp"] == hot["of"])
    single = prints.join(F.broadcast(hot.select("of")), prints["fp"] == F.col("of"), "left_anti").join(placed, F.col("fp") == placed["of"])
    return copies.select("doc_id", "fp", "component_id").unionByName(single.select("doc_id", "fp", "component_id"))


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4, prints: int = 4, at_once: int = 2) -> DataFrame:
    """doc_id and component_id of each id, the smallest id that is reachable over fingerprints of one kind within the radius. Rows of an id have one text.

    Some kinds are linked at a time, so that no more is on disk than they need. What stays of them is their links, of which a document has one for
    each kind at most but for those between roots, and the components of all of these are one run.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([*(fingerprints_of(data, offs, words, prints=prints).reshape(-1, prints) for *_, data, offs in C.text_blocks(batch)), np.zeros((0, prints), U64)]).view(np.int64)
            ends = pa.array(np.arange(0, found.size + 1, prints), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], ["doc_id", "fps"])

    seen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(scan, "doc_id long, fps array<long>")
    seen = C.cut(seen.groupBy("doc_id").agg(F.first("fps").alias("fps")))
    tables, before = [], graph.kept_places()
    with C.shuffles_removed(docs.sparkSession):
        for first in range(0, prints, at_once):
            some = range(first, min(first + at_once, prints))
            each = seen.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k - first).alias("kind"), F.col("fps")[k].alias("fp")) for k in some))).alias("p"))
            tables.append(C.cut(_links_of(each.select("doc_id", "p.*"), radius, len(some))))
            graph.drop_but(before | graph.kept_places(*tables))  # what the kinds needed goes
        labels = C.cut(connected_components(reduce(DataFrame.unionByName, tables)))
    graph.drop_but(before | graph.kept_places(labels))
    return seen.join(labels, seen["doc_id"] == labels["node"], "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))


def _links_of(each: DataFrame, radius: int, kinds: int) -> DataFrame:
    """Links (a, b) of documents (doc_id, kind, fp) with equal or near fingerprints."""
    by_print = C.cut(each.groupBy("kind", "fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    same = each.join(by_print.filter("n > 1").withColumnsRenamed({"kind": "k", "fp": "f"}), (F.col("kind") == F.col("k")) & (F.col("fp") == F.col("f"))).filter("doc_id > least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    near = C.cut(_thinned(ball_links(by_print, radius, kinds=kinds)))
    of = lambda end: by_print.select(F.col("kind"), F.col("fp").alias(end), F.col("least").alias(f"least_{end}"))
    near = near.join(of("a"), ["kind", "a"]).join(of("b"), ["kind", "b"]).select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    return same.unionByName(near).filter("a <> b").distinct()


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prints: int = 1) -> DataFrame:
    """One document of each component, that with the smallest id; all columns as they were. Components are those of near_components.

    Of different texts under that id one stays, that with the smallest hash, and a text's place is its own, whatever
    other texts have its id. Rows without an id come behind all ids below 2**62, in the order of their texts' hashes.
    Rows that repeat both id and text are one.
    """
    content = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(content, 2))
    keyed = docs.select(C.as_struct(docs, "row"), F.col(text).cast("string").alias("words"), content.alias("content"), key.alias("key"))
    rows = C.cut(keyed.groupBy("key", "content").agg(F.count("*").alias("n")))
    found = near_components(keyed, "content", "words", prints=prints).withColumnRenamed("doc_id", "of")
    least = rows.groupBy("content").agg(F.min("key").alias("key"))
    # a component of many texts has partial minima first
    first = least.join(found, least["content"] == found["of"]).groupBy("component_id").agg(F.min(F.struct("key", "content")).alias("first"))
    first = C.cut(first.select("first.*"))
    kept = keyed.join(first, ["key", "content"], "left_semi")
    if rows.filter("n > 1").limit(1).count():  # rows that repeat id and text
        kept = kept.dropDuplicates(["key", "content"])
    return C.from_struct(kept, "row", docs)
