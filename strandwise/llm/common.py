"""Shared pieces of the corpus operators: byte-level text scanning, sorted runs, shared folders.

Texts are scanned as UTF-8 bytes in blocks of a few megabytes, so that memory doesn't depend on
the number or length of the rows of an Arrow batch (one text longer than a block is a block).
"""

from __future__ import annotations

import atexit
import mmap
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.operators import graph

BLOCK_BYTES = 2 << 20
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


# ------------------------------------------------------------------ Spark side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. An own one is set only where none is and all tasks run on this machine."""
    return graph.root(spark).rstrip("/")


cut = graph.cut


def as_struct(df: DataFrame, name: str) -> Column:
    """All columns of a row in one, so that columns beside it can have any name."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias(name)


def from_struct(df: DataFrame, name: str, like: DataFrame) -> DataFrame:
    """The columns of `like` again."""
    return df.select(*(F.col(name).getField(c).alias(c) for c in like.columns))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run within go when each of them ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


class SharedFolder:
    """A folder of raw arrays below the shared root, written by tasks and mapped by workers."""

    def __init__(self, uri: str):
        self.uri = uri

    @classmethod
    def create(cls, spark: SparkSession, name: str) -> SharedFolder:
        """A new folder; if drop() isn't called before, it goes when the driver ends."""
        folder = cls(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
        fs, path = folder._fs()
        fs.create_dir(path, recursive=True)
        _created.append(folder)
        return folder

    def _fs(self):
        from pyarrow import fs

        if urlparse(self.uri).scheme in ("", "file"):
            return fs.LocalFileSystem(), urlparse(self.uri).path
        return fs.FileSystem.from_uri(self.uri)

    def write(self, name: str, *arrays: np.ndarray) -> None:
        """One array behind the other. Atomic, so that a task that is run again or twice leaves a whole file."""
        fs, path = self._fs()
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            for array in arrays:
                if array.size:
                    out.write(np.ascontiguousarray(array).view(np.uint8).data)
        fs.move(part, f"{path}/{name}")

    def map(self, name: str) -> np.ndarray:
        """A file's bytes, memory-mapped; those of a store that can't be mapped are read into memory. Empty if there is none."""
        from pyarrow import fs as pafs

        fs, path = self._fs()
        try:
            if isinstance(fs, pafs.LocalFileSystem):
                with open(f"{path}/{name}", "rb") as f:
                    if not os.fstat(f.fileno()).st_size:
                        return np.zeros(0, np.uint8)
                    return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8)
            with fs.open_input_stream(f"{path}/{name}") as source:
                return np.frombuffer(source.readall(), np.uint8)
        except FileNotFoundError:
            return np.zeros(0, np.uint8)

    def drop(self) -> None:
        fs, path = self._fs()
        if fs.get_file_info(path).type.name == "Directory":
            fs.delete_dir(path)


_created: list[SharedFolder] = []


@atexit.register
def _drop_created() -> None:
    for folder in _created:
        folder.drop()


# ------------------------------------------------------------------ text as bytes


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null is empty."""
    texts = batch.column(batch.schema.names.index(column))
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def runs(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at row borders."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    borders = offs[:-1][offs[:-1] < n]
    first[borders] = member[borders]
    ends = offs[1:][offs[1:] > 0] - 1
    last[ends] = member[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def per_row(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Offsets of the rows in a sorted list of token starts."""
    return np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_HEAD = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U64)
_LONG = 32  # bytes; longer ranges are hashed whole


def heads(data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first eight bytes of ranges of n bytes as little-endian words; what a shorter range lacks is 0."""
    if not len(starts):
        return np.zeros(0, U64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at_any_byte = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    return at_any_byte[starts] & _HEAD[np.minimum(n, 8)]


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges.

    Ranges of up to seven bytes have distinct ones: their bytes and length under a bijection. Up to 32
    bytes are mixed word by word, each step a bijection of the next word; longer ones are XXH3's.
    Chance collisions of longer ranges remain: n(n-1) / 2**65 pairs are expected among n of them.
    """
    n = ends - starts
    h = heads(data, starts, n)
    h = mix(h | np.where(n < 8, n, 8).astype(U64) << U64(56)) if (n < 8).all() else mix(np.where(n < 8, h | np.minimum(n, 8).astype(U64) << U64(56), h ^ U64(0xD6E8FEB86659FD93)))
    for k in (8, 16, 24):
        more = np.flatnonzero((n > k) & (n <= _LONG))
        if not len(more):
            break
        left = n[more] - k
        h[more] = mix((h[more] ^ heads(data, starts[more] + k, left)) * U64(0x9E3779B97F4A7C15) + np.minimum(left, 8).astype(U64))
    whole = np.flatnonzero(n > _LONG)
    if len(whole):
        raw, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
        h[whole] = [digest(raw[a:b]) for a, b in zip(starts[whole].tolist(), ends[whole].tolist(), strict=True)]
    return h


def hash_word(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(token_hashes(data, np.array([0]), np.array([len(data)]))[0])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges start .. start+length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    steps = np.ones(total, np.int64)
    steps[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    steps[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(steps)


# ------------------------------------------------------------------ sorted runs of (key, count)


def pack(array: np.ndarray) -> bytes:
    """Byte planes under zstd: small for sorted deltas and small counts."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, n: int, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, n).T).view(dtype).ravel() if n else np.zeros(0, dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(blob, n, U64), dtype=U64)


def count_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique with index and inverse, for hashes: it sorts high bits with positions in the low ones."""
    n = len(keys)
    if not n:
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = U64((1 << n.bit_length()) - 1)
    packed = np.sort((keys & ~low) | np.arange(n, dtype=U64))
    at = (packed & low).astype(np.int64)
    ordered, high = keys[at], packed & ~low
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    if (new[1:] & (high[1:] == high[:-1])).any():  # two hashes share their high bits
        return np.unique(keys, return_index=True, return_inverse=True)
    inverse = np.empty(n, np.int64)
    inverse[at] = np.cumsum(new) - 1
    return ordered[new], at[new], inverse


def sum_by_key(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with their summed columns (a row of sums for each column; whole numbers are exact below 2**53)."""
    kinds, _, inverse = distinct(keys)
    out = np.empty((len(sums), len(kinds)), sums.dtype)
    for x, column in zip(out, sums, strict=True):
        x[:] = np.bincount(inverse, column, len(kinds))
    return kinds, out


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of keys in a sorted array, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(np.asarray(sorted_keys[at]) == keys, at, -1)


# ------------------------------------------------------------------ sorted hash arrays in a shared folder


def parts_of(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(part, start, end) of each part that sorted keys have something of; a part is the keys with the same leading bits."""
    if not len(keys):
        return []
    part = keys >> U64(64 - bits) if bits else np.zeros(len(keys), U64)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return list(zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))


class HashArrays:
    """Sorted 64-bit keys with a row of numbers each: one raw file for each part, written by the task that has it and mapped by workers.

    Rows of numbers repeat, so a part has a table of the different ones and a code of one to four bytes for each key.
    Only parts that keys fall into are opened, the last `OPEN` of them stay open.
    """

    OPEN = 4096

    def __init__(self, folder: str, name: str, bits: int, columns: int):
        self.folder, self.name, self.bits, self.columns = folder, name, bits, columns
        self.open: OrderedDict[int, tuple] = OrderedDict()

    def __reduce__(self):  # maps are opened anew in each worker
        return type(self), (self.folder, self.name, self.bits, self.columns)

    def write(self, part: int, keys: np.ndarray, columns: np.ndarray) -> None:
        """columns: a row of the array for each."""
        columns = np.ascontiguousarray(columns, "<f8")
        h = np.zeros(len(keys), U64)
        for x in columns:
            h = mix(h * U64(0x9E3779B97F4A7C15) + x.view(U64))
        _, first, codes = distinct(h)
        if not np.array_equal(columns[:, first][:, codes], columns):  # two rows of numbers with one hash
            table, codes = np.unique(columns, axis=1, return_inverse=True)
        else:
            table = columns[:, first]
        size = 1 if table.shape[1] <= 1 << 8 else 2 if table.shape[1] <= 1 << 16 else 4
        SharedFolder(self.folder).write(f"{self.name}-{part}", np.array([len(keys), table.shape[1], size], "<i8"), keys.astype("<u8"), table.astype("<f8"), codes.ravel().astype(f"<u{size}"))

    def part(self, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, table and codes."""
        if part in self.open:
            self.open.move_to_end(part)
            return self.open[part]
        raw = SharedFolder(self.folder).map(f"{self.name}-{part}")
        if not len(raw):
            found = np.zeros(0, U64), np.zeros((self.columns, 0)), np.zeros(0, np.uint8)
        else:
            n, k, size = raw[:24].view("<i8").tolist()
            upto = 24 + 8 * n
            end = upto + 8 * k * self.columns
            found = raw[24:upto].view("<u8"), raw[upto:end].view("<f8").reshape(self.columns, k), raw[end:].view(f"<u{size}")
        self.open[part] = found
        if len(self.open) > self.OPEN:
            self.open.popitem(last=False)
        return found

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each of the sorted keys is held, and its numbers (0 where not), a row for each column."""
        held, out = np.zeros(len(keys), bool), np.zeros((self.columns, len(keys)))
        for part, i, j in parts_of(keys, self.bits):
            own, table, codes = self.part(part)
            at = find(own, keys[i:j])
            hit = np.flatnonzero(at >= 0)
            held[i + hit] = True
            out[:, i + hit] = table[:, codes[at[hit]]]
        return held, out
