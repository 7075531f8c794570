"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to `bits` bits in its own order (numbers between their least and
greatest value, sizes by their logarithm, texts between split points taken from their distinct
values), the cell's index on the Hilbert curve is the sort key, and runs of the sorted rows are cut
into shards of equal rows or bytes. A shard then covers a compact region, so that readers can prune
on any of the dimensions. Text never moves: only ids, sizes, checksums and codes are sorted.

Null text has no bytes; a null dimension has code 0; ties go by checksum and id, and rows equal in
all are alike. An empty table gives an empty one. Only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm import common as C


def hilbert_index(codes: np.ndarray, bits: int) -> np.ndarray:
    """Indices on the Hilbert curve of (n, d) codes of `bits` bits, after Skilling (2004)."""
    x = [codes[:, i].astype(np.int64) for i in range(codes.shape[1])]
    d = len(x)
    for level in range(bits - 1, 0, -1):  # undo excess work, from the highest bit
        q = 1 << level
        p = q - 1
        for i in range(d):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & p)
            x[0] = x[0] ^ np.where(x[i] & q, p, swap)
            x[i] = x[i] ^ swap if i else x[i]
    for i in range(1, d):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        t ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] ^ t) >> level & 1)
    return out


def text_splits(df: DataFrame, column: str, most: int = 4096) -> list[str]:
    """Split points in the column's order: its distinct values, or those `most` with the smallest hashes."""
    chosen = df.select(F.col(column).cast("string").alias("v")).filter("v is not null").distinct().orderBy(F.xxhash64("v"), "v").limit(most)
    return sorted(r.v for r in chosen.collect())


def shard_rows(docs: DataFrame, shards: int = 40, law: str = "rows", bits: int = 8, doc_id: str = "doc_id", text: str = "text", texts: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, shard and slot of every row. law: rows (counts at most one apart) or bytes (sizes near equal)."""
    assert law in ("rows", "bytes")
    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    narrow = C.cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), *(F.col(c).cast("string").alias(f"__{c}") for c in texts)))
    least, most, largest = narrow.agg(F.min("doc_id"), F.max("doc_id"), F.max("size")).first()
    splits = [text_splits(narrow, f"__{c}") for c in texts]
    top = (1 << bits) - 1

    def index(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            size = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            codes = [np.nan_to_num((ids - (least or 0)) / max((most or 0) - (least or 0), 1)), np.log(size / 16) / max(np.log((largest or 32) / 16), 1e-9)]
            for k, points in enumerate(splits, 3):
                at = {v: bisect_right(points, v) / max(len(points), 1) for v in set(batch.column(k).to_pylist()) if v is not None}
                codes.append(np.array([at.get(v, 0.0) for v in batch.column(k).to_pylist()]))
            grid = np.clip(np.stack(codes, 1) * top, 0, top).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(hilbert_index(grid, bits))], ["doc_id", "size", "text_crc32", "hilbert"])

    keys = ["hilbert", "text_crc32", "doc_id"]
    indexed = C.cut(narrow.mapInArrow(index, "doc_id long, size long, text_crc32 long, hilbert long"))

    def number(batches):
        part, row, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            size = batch.column(1).to_numpy()
            upto = before + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part)), pa.array(row + np.arange(len(size))), pa.array(upto - size)], [*batch.schema.names, "part", "row", "before"])
            row, before = row + len(size), int(upto[-1]) if len(upto) else before

    run = C.cut(indexed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, "doc_id long, size long, text_crc32 long, hilbert long, part long, row long, before long"))
    parts = run.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b")).orderBy("part").collect()  # a row for each partition
    rows, size, offsets = 0, 0, []
    for p in parts:
        offsets.append((p.part, rows, size))
        rows, size = rows + p.n, size + p.b
    spark = docs.sparkSession
    placed = run.join(F.broadcast(spark.createDataFrame(offsets, "part long, row0 long, before0 long")), "part")
    rank, before = F.col("row") + F.col("row0"), F.col("before") + F.col("before0")
    if law == "rows":
        shard = F.floor(rank * shards / F.lit(max(rows, 1))) if rows * shards < 2**52 else F.expr(f"cast((row + row0) * {shards} div {max(rows, 1)} as long)")
    else:
        shard = F.floor((before + F.col("size") / 2) * shards / F.lit(max(size, 1)))
    numbered = C.cut(placed.select("doc_id", "size", "text_crc32", "hilbert", F.least(shard.cast("int"), F.lit(shards - 1)).alias("shard"), rank.alias("rank")))
    first = numbered.groupBy("shard").agg(F.min("rank").alias("first"))  # at most `shards` rows
    return numbered.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "hilbert", "shard", (F.col("rank") - F.col("first")).alias("slot"))
