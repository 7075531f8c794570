"""Packing by power-of-two decomposition.

Each document is cut into pieces whose lengths are powers of two: as many of the longest length as
fit, then one for each set bit of the rest. A piece is a sequence of its own, and sequences of equal
length share a bucket (`length_bits`), so a batch of a bucket needs no padding and no sequence
crosses documents. Nothing is shuffled: pieces come out of the scan's own tasks.

Null text is empty, an empty text gives the end id alone, a very long text is encoded whole, repeated
rows give pieces of their own, an empty table gives none. Other columns are neither read nor returned.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm import common as C

#: White space, letters, digits and the rest.
_KIND = np.full(256, 3, np.uint8)
_KIND[C.SPACE] = 0
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1
_KIND[0x30:0x3A] = 2

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, length_bits int"


class WordEncoder:
    """Token ids of texts from a cache of pieces that the tokenizer treats independently.

    White space never lies inside a pre-token, and in words of ASCII and precomposed Latin-1 letters
    without apostrophes neither do the borders between letters, digits and punctuation. Any other
    word is encoded as a whole, and a text that may hold a special token's string goes to the
    tokenizer whole. Every piece is compared with the cached one byte by byte: rows of a block in which
    two pieces share a hash go to the tokenizer whole, too.
    """

    MOST = 1 << 20  # cached pieces; beyond, the cache starts anew

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, C.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        # the bytes of what is cached: the first eight, the length, and the place of all of them
        self.head, self.size, self.byte_at = np.zeros(0, C.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes = np.zeros(0, np.uint8)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Starts and ends of what is encoded alone; which are single pre-tokens (None: all)."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), None
        kind = _KIND[data]
        border = np.ones(len(data), bool)
        np.not_equal(kind[1:], kind[:-1], out=border[1:])
        border |= kind == 2
        border[offs[:-1][offs[:-1] < len(data)]] = True
        # a byte is odd if an apostrophe, or neither ASCII nor of a letter of Latin-1
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] < 0xC0) & (data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        single = None
        if 2 * len(lead) != np.count_nonzero(data & 0x80) or (data == 0x27).any():
            odd = (data >= 0x80) | (data == 0x27)
            odd[lead] = odd[lead + 1] = False
            starts, ends = C.runs(~C.SPACE[data], offs)
            seen = np.concatenate(([0], np.cumsum(odd)))
            whole = seen[ends] > seen[starts]
            border[C.ragged(starts[whole], (ends - starts)[whole])] = False
            border[starts] = True
            single = np.ones(len(data), bool)
            single[starts[whole]] = False
        starts = np.flatnonzero(border)
        ends = np.append(starts[1:], len(data))
        keep = kind[starts] != 0
        starts, ends = starts[keep], ends[keep]
        return starts, ends, None if single is None else single[starts]

    def _learn(self, keys: np.ndarray, texts: list[bytes], single: np.ndarray) -> None:
        raw, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts], np.int64)
        begin = np.cumsum(size) - size
        head, byte_at = C.heads(raw, begin, size), len(self.bytes) + begin
        self.bytes = np.concatenate([self.bytes, raw])
        texts = [x.decode("utf-8", "replace") for x in texts]
        n, pool = np.zeros(len(keys), np.int64), np.zeros(0, np.uint32)
        alone = np.flatnonzero(single)
        at = np.zeros(len(keys), np.int64)
        # pre-tokens with spaces between; each ends in the only id of it that has the suffix
        together = [" ".join(texts[i] for i in alone[k : k + 500]) for k in range(0, len(alone), 500)]
        ids = np.array([i for x in self.tokenizer.encode_batch_fast(together, add_special_tokens=False) for i in x.ids], np.uint32)
        ends = np.flatnonzero(self.last[ids])
        if len(ends) == len(alone):
            n[alone] = np.diff(ends, prepend=-1)
            at[alone] = ends + 1 - n[alone]
            pool, rest = ids, np.flatnonzero(~single)
        else:
            rest = np.arange(len(keys))
        lists = [x.ids for x in self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)]
        n[rest] = [len(x) for x in lists]
        at[rest] = len(pool) + np.cumsum(n[rest]) - n[rest]
        pool = np.concatenate([pool, np.array([i for x in lists for i in x], np.uint32)])
        at += len(self.pool)
        self.pool = np.concatenate([self.pool, pool])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.n, where, n)
        self.head, self.size, self.byte_at = np.insert(self.head, where, head), np.insert(self.size, where, size), np.insert(self.byte_at, where, byte_at)

    def _same_bytes(self, low: np.ndarray, starts: np.ndarray, n: np.ndarray, at: np.ndarray) -> bool:
        """Whether all pieces are, byte by byte, the cached ones that their hashes led to."""
        if not (np.array_equal(self.size[at], n) and np.array_equal(self.head[at], C.heads(low, starts, n))):
            return False
        long = np.flatnonzero(n > 8)
        return np.array_equal(low[C.ragged(starts[long] + 8, n[long] - 8)], self.bytes[C.ragged(self.byte_at[at[long]] + 8, n[long] - 8)])

    def _rows(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = [self.whole(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return np.concatenate([*rows, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum([len(x) for x in rows], dtype=np.int64)))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows and their offsets."""
        if self._special(data):
            return self._rows(data, offs)
        low = C.LOWER[data]
        starts, ends, single = self._pieces(low, offs)
        keys, first, inverse = C.distinct(C.token_hashes(low, starts, ends))
        at = C.find(self.keys, keys)
        if (new := np.flatnonzero(at < 0)).size:
            if len(self.keys) + len(new) > self.MOST:
                self._clear()
                new = np.arange(len(keys))
            raw = low.tobytes()
            alone = np.ones(len(new), bool) if single is None else single[first[new]]
            self._learn(keys[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)], alone)
            at = C.find(self.keys, keys)
        if not self._same_bytes(low, starts, ends - starts, at[inverse]):  # two pieces with one hash
            return self._rows(data, offs)
        n = self.n[at][inverse]
        ids = self.pool[C.ragged(self.at[at][inverse], n)]
        ends_of = np.concatenate(([0], np.cumsum(n)))
        return ids, ends_of[C.per_row(starts, offs)]

    def _special(self, data: np.ndarray) -> bool:
        at = np.flatnonzero(data[:-1] == 0x3C)
        return bool((data[at + 1] == 0x7C).any()) if at.size else False


def binary_lengths(n: int, longest: int) -> list[int]:
    """Powers of two that sum to n: the longest as often as it fits, then the set bits of the rest, falling."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process: its cache outlives the task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pack_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, longest: int = 4096, with_ids: bool = False) -> DataFrame:
    """Columns of PIECES for each piece; with_ids adds `ids`, its little-endian unsigned 32-bit ids."""
    assert longest & (longest - 1) == 0, "the longest length is a power of two"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(tokenizer_path), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            doc_ids = batch.column(0)
            for i, j, data, offs in C.text_blocks(batch):
                ids, at = enc.encode(data, offs)
                n = np.diff(at) + 1
                lengths = [binary_lengths(int(x), longest) for x in n]
                count = np.fromiter(map(len, lengths), np.int64, len(lengths))
                length = np.fromiter((y for x in lengths for y in x), np.int64, int(count.sum()))
                before = np.cumsum(length) - length
                first = np.cumsum(count) - count
                start = before - np.repeat(before[first], count)
                # every row's ids with its end id behind them
                out = np.insert(ids, at[1:], end_id).astype("<u4")
                raw = memoryview(out.view(np.uint8))
                crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(before.tolist(), length.tolist(), strict=True)]
                bits = np.log2(length).astype(np.int64)
                # unique: bucket, partition and row number have bits of their own
                sequence = (bits << 58) | (part << 36) | np.arange(row, row + len(length))
                row += len(length)
                of = np.repeat(np.arange(i, j), count)
                arrays = [doc_ids.take(pa.array(of)), start, length, crc, np.repeat(n, count), sequence, np.zeros(len(length), np.int64), bits.astype(np.int32)]
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, pa.int64() if k < 7 else pa.int32()) for k, x in enumerate(arrays)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "length_bits"]
                if with_ids:
                    arrays.append(pa.array([bytes(raw[4 * a : 4 * (a + b)]) for a, b in zip(before.tolist(), length.tolist(), strict=True)], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)
