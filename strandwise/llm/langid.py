"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a binary classifier over hashed byte trigrams (the
log-odds of trigrams in languages with the bit set against the others, with additive smoothing)
gives a margin, and the language whose codeword has the least loss, sum of ln(1 + exp(-bit * margin))
weighted by how well each bit's classifier separates, is chosen. A margin to the runner-up below
`ambiguous` flags the row. Up to five languages have the exhaustive code, more have the best of many
random codes. All values of lang are learned: trigram counts come from all training rows, summed per language in
each task first, and stay a table; the driver gets the languages' names and a line of weights for each bit.

A text that is null or has no letter gets `und` and score 0; so does every text if no training row
has a language. Texts of any length are read whole. Equal losses go to the language that sorts first.
Copies count as often as they occur. Only text, id and language are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm import common as C

UND = "und"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
#: Digits, punctuation and white space are one symbol, so that markup doesn't count as language.
_SYMBOL = C.LOWER.copy()
_SYMBOL[:0x80][~_ASCII_LETTER[:0x80]] = 0x20


def trigram_bins(data: np.ndarray, bits: int) -> np.ndarray:
    """A bin for each position's three bytes; -1 where these are all white space or end the block."""
    s = _SYMBOL[data].astype(np.uint32)
    out = np.full(len(s), -1, np.int64)
    if len(s) >= 3:
        code = (s[:-2] << 16) | (s[1:-1] << 8) | s[2:]
        out[:-2] = np.where(code == 0x202020, -1, ((code * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64))
    return out


def counts_by_row(data: np.ndarray, offs: np.ndarray, bits: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, counts of rows by bins): trigrams that cross a row's end are left out."""
    bins = trigram_bins(data, bits)
    for back in (1, 2):
        at = offs[1:] - back
        at = at[at >= offs[:-1]]
        bins[at] = -1
    width, rows = 1 << bits, len(offs) - 1
    for i in range(0, rows, 64):
        j = min(i + 64, rows)
        part = bins[offs[i] : offs[j]]
        of = np.repeat(np.arange(j - i) * width, np.diff(offs[i : j + 1]))
        keep = part >= 0
        yield i, j, np.bincount(part[keep] + of[keep], minlength=(j - i) * width).reshape(j - i, width)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of -1 and 1, with columns neither constant nor equal nor complementary."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 5:
        columns = np.arange(1 << (k - 1))[:-1]  # the first language has ones throughout
        code = np.ones((k, len(columns)), np.int8)
        for row in range(1, k):
            code[row] = np.where(columns >> (k - 1 - row) & 1, 1, -1)
        return code
    rng = np.random.default_rng(seed)
    bits, best, score = max(15, 10 * (k - 1).bit_length()), None, -1
    for _ in range(200 if k <= 64 else 20 if k <= 1024 else 1):
        code = rng.choice(np.array([-1, 1], np.int8), (k, bits))
        wide, near = code.astype(np.float32), -bits  # bits less twice the distance
        for i in range(0, k, 1024):
            product = wide[i : i + 1024] @ wide.T
            product[np.arange(len(product)), np.arange(i, i + len(product))] = -bits
            near = max(near, int(product.max()))
        far = int((bits - near) // 2)
        if far > score and (np.abs(code.sum(0)) < k).all():
            best, score = code, far
    return best


def _has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    seen = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))
    high = np.concatenate(([0], np.cumsum(data >= 0x80)))
    out = seen[offs[1:]] > seen[offs[:-1]]
    for row in np.flatnonzero(~out & (high[offs[1:]] > high[offs[:-1]])):
        out[row] = any(c.isalpha() for c in data[offs[row] : offs[row + 1]].tobytes().decode("utf-8", "replace"))
    return out


class OutputCodes:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray, bits: int, gain: float, ambiguous: float):
        self.languages, self.code, self.weights, self.trust, self.bits, self.gain, self.ambiguous = languages, code, weights, trust, bits, gain, ambiguous
        self.limit = np.inf

    @classmethod
    def fit(cls, docs: DataFrame, train: Column, bits: int = 13, smoothing: float = 0.5, gain: float = 12.0, ambiguous: float = 0.2) -> OutputCodes:
        """docs: text and lang. Languages weigh the same, however many rows they have."""
        width = 1 << bits
        chosen = docs.filter(train & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

        def count(batches):
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                langs = np.array(batch.column(1).to_pylist(), object)
                for i, _, data, offs in C.text_blocks(batch):
                    for a, b, counts in counts_by_row(data, offs, bits):
                        here = langs[i + a : i + b]
                        for lang in set(here):
                            sums[lang] = sums.get(lang, 0) + counts[here == lang].sum(0)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], ["lang", "counts"])

        def add(rows: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py(), "<i8") for x in rows["counts"])
            return pa.table({"lang": rows["lang"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

        found = C.cut(chosen.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary"))
        languages = sorted(r.lang for r in found.select("lang").collect())  # a name for each
        code = codewords(len(languages))
        if not languages:
            return cls([], code, np.zeros((width, 1)), np.ones(1), bits, gain, ambiguous)
        place, n_bits = {x: k for k, x in enumerate(languages)}, code.shape[1]
        used = np.flatnonzero((code > 0).any(0) & (code < 0).any(0))

        def shares(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Codewords and smoothed shares of trigrams, some languages at a time."""
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                n = np.stack([np.frombuffer(x, "<i8") for x in part.column(1).to_pylist()]) + smoothing
                yield code[[place[x] for x in part.column(0).to_pylist()]], n / n.sum(1, keepdims=True)

        def sums(batches):
            total = np.zeros((2, n_bits, width))
            for batch in batches:
                for own, p in shares(batch):
                    total += np.stack([(own > 0).astype(float).T @ p, (own < 0).astype(float).T @ p])
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([total[:, b].tobytes() for b in used], pa.binary())], ["bit", "sums"])

        def odds(rows: pa.Table) -> pa.Table:
            b = rows["bit"][0].as_py()
            on, off = sum(np.frombuffer(x.as_py()).reshape(2, width) for x in rows["sums"])
            line = np.log(on / (code[:, b] > 0).sum()) - np.log(off / (code[:, b] < 0).sum())
            return pa.table({"bit": rows["bit"][:1], "line": pa.array([line.tobytes()], pa.binary())})

        weights, trust = np.zeros((width, n_bits)), np.ones(n_bits)
        for r in found.mapInArrow(sums, "bit long, sums binary").groupBy("bit").applyInArrow(odds, "bit long, line binary").collect():  # a row for each bit
            weights[:, r.bit] = np.frombuffer(bytes(r.line))

        def margins(batches):
            least = np.full(n_bits, np.inf)  # each language's mean margin has the code's sign: the smallest is what may be trusted
            for batch in batches:
                for own, p in shares(batch):
                    least = np.minimum(least, (own * (p @ weights)).min(0))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(least[used])], ["bit", "least"])

        for r in found.mapInArrow(margins, "bit long, least double").groupBy("bit").agg(F.min("least").alias("least")).collect():
            trust[r.bit] = max(r.least, 0.01)
        return cls(languages, code, weights.astype(np.float32), trust / trust.mean(), bits, gain, ambiguous)

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Position of the language (-1: und), score, whether it is ambiguous, and the loss of its codeword, for each row of a block."""
        rows = len(offs) - 1
        at, score, unsure, least = np.full(rows, -1), np.zeros(rows), np.ones(rows, bool), np.full(rows, np.inf)
        if not self.languages:
            return at, score, unsure, least
        for i, j, counts in counts_by_row(data, offs, self.bits):
            n = np.maximum(counts.sum(1, keepdims=True), 1)
            margin = self.gain * (counts.astype(np.float32) @ self.weights).astype(float) / n
            on = self.code > 0
            loss = (np.logaddexp(0, -margin) * self.trust) @ on.T + (np.logaddexp(0, margin) * self.trust) @ ~on.T
            least[i:j] = loss.min(1)
            p = np.exp(loss.min(1, keepdims=True) - loss)
            p /= p.sum(1, keepdims=True)
            ordered = np.sort(p, axis=1)
            at[i:j], score[i:j] = p.argmax(1), ordered[:, -1]
            unsure[i:j] = ordered[:, -1] - ordered[:, -2] < self.ambiguous if len(self.languages) > 1 else False
        letters = _has_letter(data, offs)
        return np.where(letters, at, -1), np.where(letters, score, 0.0), unsure | ~letters, least

    def measure(self, docs: DataFrame, held_out: Column) -> OutputCodes:
        """Sets how far the nearest codeword may be, from the held-out documents that decode to their own language.

        The limit is the geometric mean of the greatest loss of these and the loss of a text without any evidence, as
        losses fall off with the exponent of the margin; it is never above the latter. Without such documents, or with
        fewer than two languages, there is no limit.
        """
        if len(self.languages) < 2:
            return self
        model, chosen = self, docs.filter(held_out & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

        def losses(batches):
            names, most = np.array([*model.languages, UND], object), -1.0
            for batch in batches:
                langs = np.array(batch.column(1).to_pylist(), object)
                for i, j, data, offs in C.text_blocks(batch):
                    at, _, unsure, least = model.predict(data, offs)
                    most = max(most, least[(names[at] == langs[i:j]) & ~unsure].max(initial=-1.0))
            yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

        most = chosen.mapInArrow(losses, "most double").agg(F.max("most")).first()[0]
        if most is not None and most >= 0:
            blank = float(np.log(2) * self.trust.sum())
            self.limit = min((most * blank) ** 0.5, blank)
        return self

    def identify(self, docs: DataFrame, flag: Column | None = None) -> DataFrame:
        """doc_id, the flag, lang_pred, score and ambiguous of every row."""
        model = self

        def scored(batches):
            names = np.array([*model.languages, UND], object)
            for batch in batches:
                for i, j, data, offs in C.text_blocks(batch):
                    at, score, unsure, _ = model.predict(data, offs)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(names[at], pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

        chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))).alias("held_out"), F.col("text").cast("string").alias("text"))
        return chosen.mapInArrow(scored, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")

    def keep_known(self, docs: DataFrame) -> DataFrame:
        """docs without the rows that have no language; all columns as they were. After measure(), those that are ambiguous or too far from all codewords have none."""
        model, column = self, docs.columns.index("text")

        def kept(batches):
            for batch in batches:
                texts = pa.RecordBatch.from_arrays([batch.column(column)], ["text"])
                known = []
                for *_, data, offs in C.text_blocks(texts):
                    at, _, unsure, least = model.predict(data, offs)
                    known.append((at >= 0) & (~unsure & (least <= model.limit) if np.isfinite(model.limit) else True))
                if known:
                    yield batch.filter(pa.array(np.concatenate(known)))

        return docs.mapInArrow(kept, docs.schema)
