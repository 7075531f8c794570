"""Alignment of two tokenizers' tokens on the bytes of the same text.

Each byte of a text has a label: no token ends here, one of A ends, one of B ends, or both. A regular
expression scans the label string for spans up to each both-label; the labels in a span say how many
tokens of either side form a group. Between two labels that aren't empty lie the bytes of exactly one
token of A and one of B, so these stretches are the overlapping pairs (links).

Both tokenizers treat a word apart from what is before its space if the characters around the space
are printable ASCII or letters of Latin-1: no pre-token of A and no piece of B crosses it. Texts are cut
there, and what a distinct chunk gives is kept, so that repeated words are encoded and scanned once a
worker. A text in which a chunk's tokens don't give its bytes has no tokens at all.

Pairs are counted by documents as sorted runs of hashes (see counting); counts are mapped files that
documents look up. The largest counts by token of A are one array as long as A's vocabulary.

Null and empty texts have no tokens, long ones are aligned whole, rows that are equal count as documents of
their own, an empty table gives none. Other columns are neither read nor returned.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm import common as C
from strandwise.llm import counting
from strandwise.llm.common import U64

_PLAIN = "!-~À-ÖØ-öø-ÿ"
#: A space that isn't between plain characters, and where a text can be cut.
_ODD_SPACE = re.compile(f" (?:(?![{_PLAIN}])|(?<![{_PLAIN}] ))")
_CUT = re.compile(f"(?<=[{_PLAIN}])(?= [{_PLAIN}])")
_ALL_PLAIN = re.compile(f"[{_PLAIN}]+")
_ALL_PLAIN_WORDS = re.compile(f"[ {_PLAIN}]*")
#: Plain chunks that are encoded together.
_TOGETHER = 512
#: Labels of bytes: 0 none, 1 A ends, 2 B ends, 3 both.
_SPAN = re.compile(rb"[^\x03]*\x03")

#: Keys are dealt by their leading bits, so they are spread by a multiplication that can be undone.
_SPREAD = 0x9E3779B97F4A7C15
_BACK = pow(_SPREAD, -1, 1 << 64)
PAIRS_A_PART = 1 << 20
PAIRS_AT_ONCE = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def chunks(text: str) -> list[str]:
    """Chunks of " " + text, without the space that each of them begins with."""
    if not text:
        return []
    if not _ODD_SPACE.search(text):
        return text.split(" ")
    return [x[1:] for x in _CUT.split(" " + text)]


def token_groups(a_bytes: np.ndarray, b_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the tokens' numbers of bytes: of each group the tokens of A and of B, and of each link A's and B's token and its end."""
    labels = np.zeros(int(a_bytes.sum()), np.uint8)
    labels[np.cumsum(a_bytes) - 1] = 1
    labels[np.cumsum(b_bytes) - 1] += 2
    ends = np.cumsum(np.fromiter(map(len, _SPAN.findall(labels.tobytes())), np.int64)) - 1
    a_upto, b_upto = np.cumsum(labels & 1, dtype=np.int64), np.cumsum(labels >> 1, dtype=np.int64)
    at = np.flatnonzero(labels)
    return np.diff(a_upto[ends], prepend=0), np.diff(b_upto[ends], prepend=0), a_upto[at] - (labels[at] & 1), b_upto[at] - (labels[at] >> 1), at + 1


class Aligner:
    """What the tokens of two tokenizers give for chunks of text, with a cache of chunks."""

    MOST, MOST_CHARS = 3 << 16, 1 << 24  # cached; beyond, the cache starts anew

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self._byte_ids = lambda text: self.a.encode(text, add_special_tokens=False).ids
        alphabet = byte_alphabet()
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token)
        self._faster_merges(byte_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        #: Whether words are apart for B, too: no piece goes from a word into the space behind it.
        self.cuts = not any(re.search("[^▁]▁", x) for x in pieces)
        self.a_size, self.b_size = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        most = max(len(pieces), len(self.a_bytes))
        self.digits = len(str(most))
        self.decimal = np.array([list(b"%-*d" % (self.digits + 1, i)) for i in range(most)], np.uint8)
        self.wide = np.array([len(str(i)) for i in range(most)])
        self.clear()

    def _faster_merges(self, byte_path: str) -> None:
        """The same merges by another library where the file's ids are its merges' ranks and no character of a text is beyond Latin-1's printable ones."""
        import public_tokenizers
        import tiktoken

        with open(byte_path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, merges = model["model"]["vocab"], [x if isinstance(x, str) else " ".join(x) for x in model["model"]["merges"]]
        alphabet = byte_alphabet()
        if any(vocab.get(x.replace(" ", "")) != 256 + k for k, x in enumerate(merges)) or {vocab.get(c, -1) for c in alphabet} != set(range(256)) or model["normalizer"] is not None:
            return
        ranks = {self.a_bytes[i]: i for i in range(256 + len(merges))}
        fast, slow = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), self._byte_ids
        self._byte_ids = lambda text: fast.encode_ordinary(text) if _ALL_PLAIN_WORDS.fullmatch(text) else slow(text)

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.texts: list[bytes] = []
        # tokens of A and of B, groups, links, whether the bytes are the text's
        self.counts = np.zeros((5, 0), np.int64)
        self.link_at, self.links = np.zeros(0, np.int64), np.zeros(0, U64)

    def _encoded(self, texts: list[str]) -> tuple[list[int], list[int], bool]:
        """Ids of both sides for " " + " ".join(texts), and whether both give its bytes."""
        text = " ".join(texts)
        a, b = self._byte_ids(" " + text), self.b.encode(text)
        raw = b" " + text.encode()
        return a, b, b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))

    def learn(self, new: list[str]) -> None:
        """Plain chunks are encoded many together, as their borders are ones of tokens; any other alone."""
        odd = [x for x in new if not _ALL_PLAIN.fullmatch(x)]
        plain = [x for x in new if _ALL_PLAIN.fullmatch(x)] if self.cuts else []
        odd = odd if self.cuts else new
        runs = [plain[k : k + _TOGETHER] for k in range(0, len(plain), _TOGETHER)] + [[x] for x in odd]
        lists, order, good = [], [], []
        while runs:
            run = runs.pop()
            a, b, ok = self._encoded(run)
            if not ok and len(run) > 1:
                runs += [[x] for x in run]
                continue
            order += run
            good += [ok] * len(run)
            if ok:
                lists.append((a, b))
        a, b = (np.fromiter(chain.from_iterable(x[k] for x in lists), np.int64) for k in (0, 1))
        good = np.array(good)
        ends = np.cumsum(np.where(good, [len(x.encode()) + 1 for x in order], 0))
        of = lambda at: np.diff(np.searchsorted(at, ends, "right"), prepend=0)  # noqa: E731  how many of these ends lie in each chunk
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        n_a, n_b = of(a_ends), of(b_ends)
        group_a, group_b, link_a, link_b, link_end = token_groups(self.a_size[a], self.b_size[b])
        links, groups = of(link_end), of(a_ends[np.cumsum(group_a) - 1])
        text, text_at = self._written(a, b, group_a, group_b)
        until = text_at[np.cumsum(groups)]
        begins = np.concatenate(([0], until[:-1]))
        self.texts += [text[i : j - 1] if j > i else b"" for i, j in zip(begins.tolist(), until.tolist(), strict=True)]
        self.link_at = np.concatenate([self.link_at, len(self.links) + np.cumsum(links) - links])
        self.links = np.concatenate([self.links, (a[link_a] << 32 | b[link_b]).astype(U64)])
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, groups, links, good.astype(np.int64)])], axis=1)
        self.index.update(zip(order, range(len(self.index), len(self.index) + len(order)), strict=True))
        self.chars += sum(map(len, order))

    def _written(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """`a1,a2|b1;` of all groups, and where each of them ends (0 first)."""
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[np.arange(len(a)) + np.repeat(np.cumsum(group_b) - group_b, group_a)] = a
        ids[np.arange(len(b)) + np.repeat(np.cumsum(group_a), group_b)] = b
        both = np.cumsum(group_a + group_b)
        mark[both - group_b - 1] = ord("|")
        mark[both - 1] = ord(";")
        out, wide = self.decimal[ids], self.wide[ids]
        out[np.arange(len(ids)), wide] = mark
        size = np.concatenate(([0], np.cumsum(wide + 1)))
        return out[np.arange(self.digits + 1) <= wide[:, None]].tobytes(), np.concatenate(([0], size[both]))

    def align(self, texts: list[str]) -> Iterator[tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray]]:
        """Of each text: tokens of A and of B, groups and links; the groups' digest; its distinct links, sorted, and how often each occurs."""
        cut = [chunks(x) if self.cuts else [x] if x else [] for x in texts]
        new = list(dict.fromkeys(chain.from_iterable(cut)) if len(cut) == 1 else set(chain.from_iterable(cut)))
        if len(self.index) > self.MOST or self.chars > self.MOST_CHARS:
            self.clear()
        if new := [x for x in new if x not in self.index]:
            self.learn(new)
        for own in cut:
            at = np.fromiter(map(self.index.__getitem__, own), np.int64, len(own))
            counts = self.counts[:, at]
            if not len(own) or not counts[4].all():
                yield (0, 0, 0, 0), "", np.zeros(0, U64), np.zeros(0, np.int64)
                continue
            written = b";".join(map(self.texts.__getitem__, at.tolist()))
            keys, times = C.count_keys(self.links[C.ragged(self.link_at[at], counts[3])])
            yield tuple(counts[:4].sum(axis=1).tolist()), sha256(written).hexdigest(), keys, times


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    if (byte_path, piece_path) not in _aligners:
        _aligners[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _aligners[byte_path, piece_path]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, pairs binary, times binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align_tokens(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """ALIGNED: each document's groups and its packed links (token of A in the high half of a key)."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, kinds, names = aligner(byte_path, piece_path), _kinds(ALIGNED), _names(ALIGNED)
        for batch in batches:
            for i, j, *_ in C.text_blocks(batch):
                part = batch.slice(i, j - i)
                rows = [(*counts, digest, len(keys), *((C.pack_sorted(keys), C.pack(times.astype(np.uint32))) if len(keys) else (b"", b""))) for counts, digest, keys, times in both.align([x or "" for x in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds[1:], strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(align, ALIGNED)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _kinds(schema: str) -> list[pa.DataType]:
    return [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]


def _links(batch: pa.RecordBatch, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and times of each row; columns n_pairs, pairs and times from `first` on."""
    for n, keys, times in zip(*(batch.column(first + k).to_pylist() for k in range(3)), strict=True):
        yield (C.unpack_sorted(keys, n), C.unpack(times, n, np.uint32).astype(np.int64)) if n else (np.zeros(0, U64), np.zeros(0, np.int64))


class LinkCounts:
    """In how many documents each pair of tokens is linked, and the largest such count of each token of A."""

    def __init__(self, counts: C.HashArrays, folder: C.SharedFolder):
        self.counts, self.folder = counts, folder

    @classmethod
    def count(cls, aligned: DataFrame, vocabulary: int, other: int) -> LinkCounts:
        """vocabulary and other: the sizes of A's and of B's, which bound the pairs and the array of largest counts."""
        links = aligned.agg(F.sum("n_pairs")).first()[0] or 0
        bits = counting.bits_for(min(links, vocabulary * other), PAIRS_A_PART)
        folder = C.SharedFolder.create(aligned.sparkSession, "links")
        arrays = C.HashArrays(folder.uri, "count", bits, 1)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            runs = counting.Runs(bits)
            for batch in batches:
                for keys, _ in _links(batch, 0):
                    yield from runs.add(keys * U64(_SPREAD), np.ones((1, len(keys)), np.int64))
            yield from runs.close()

        def merge(rows: pa.Table) -> pa.Table:
            keys, sums = counting.merged(rows)
            arrays.write(rows["part"][0].as_py(), keys, sums)
            most = np.zeros(vocabulary, np.int64)
            np.maximum.at(most, (keys * U64(_BACK) >> U64(32)).astype(np.int64), sums[0])
            held = np.flatnonzero(most)
            return pa.table({"a": pa.array(held), "most": pa.array(most[held])})

        parts = counting.by_part(aligned.select("n_pairs", "pairs", "times").mapInArrow(spread, counting.RUN), bits, merge, "a long, most long")
        best = np.zeros(vocabulary, np.int64)
        for r in parts.groupBy("a").agg(F.max("most").alias("most")).collect():  # a row for each token of A at most
            best[r.a] = r.most
        folder.write("best", best)
        return cls(arrays, folder)

    def score(self, aligned: DataFrame) -> DataFrame:
        """RESULT of each document."""
        arrays, folder = self.counts, self.folder

        def sums(rows: list[tuple[np.ndarray, np.ndarray]], best: np.ndarray) -> Iterator[list[int]]:
            """n_best, then count_sum, of some documents whose pairs are looked up together."""
            keys, times = (np.concatenate(x) for x in zip(*rows, strict=True))
            kinds, first, inverse = C.distinct(keys * U64(_SPREAD))
            counts = arrays.look(kinds)[1][0].astype(np.int64)
            most = (counts == best[(keys[first] >> U64(32)).astype(np.int64)])[inverse]
            upto = np.cumsum([len(k) for k, _ in rows])
            for x in (times * most, times * counts[inverse]):
                total = np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], upto))]
                yield np.diff(total).tolist()

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                if best is None:
                    best = folder.map("best").view(np.int64)
                found, held, size = ([], []), [], 0
                for row in _links(batch, 6):
                    held.append(row)
                    size += len(row[0])
                    if size > PAIRS_AT_ONCE:
                        for out, x in zip(found, sums(held, best), strict=True):
                            out += x
                        held, size = [], 0
                if held:
                    for out, x in zip(found, sums(held, best), strict=True):
                        out += x
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(x, pa.int64()) for x in found), batch.column(5)], _names(RESULT))

        return aligned.select(*_names(ALIGNED)).mapInArrow(look, RESULT)


def link_tokens(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """RESULT: groups and links of each document, and how common its links are among all documents. Evaluated when it returns."""
    spark = docs.sparkSession
    both = aligner(byte_path, piece_path)
    work, out = C.SharedFolder.create(spark, "aligned"), C.SharedFolder.create(spark, "linked")
    align_tokens(docs, byte_path, piece_path).write.parquet(f"{work.uri}/docs")
    aligned = spark.read.schema(ALIGNED).parquet(f"{work.uri}/docs")
    counts = LinkCounts.count(aligned, len(both.a_bytes), len(both.b_bytes))
    counts.score(aligned).write.parquet(f"{out.uri}/docs")
    counts.folder.drop()
    work.drop()
    return spark.read.schema(RESULT).parquet(f"{out.uri}/docs")
