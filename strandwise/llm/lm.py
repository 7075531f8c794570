"""Interpolated modified Kneser-Ney n-gram model (order 3 unless asked otherwise), counted in Spark.

Every level n = order, ..., 1 is one scan of the text and one shuffle of sorted, delta-coded runs that
tasks have already summed. The highest level counts n-grams c(g). A lower one maps the level above and
lets every occurrence of an (n+1)-gram with count c add 1/c to what is counted once for each distinct
one: to the number of distinct words before its n-gram (the adjusted count a), and to the totals and
the counts of counts of its context. So no n-gram is ever shuffled with its words, only by its hash,
and a hot word or context is no hot key. A level is sorted hash arrays, a file for each part, that
workers memory-map; neither driver nor workers hold a model in memory.

    p_n(w|u) = max(a(uw) - D_n(a(uw)), 0) / t(u) + (D_n(1) n1(u) + D_n(2) n2(u) + D_n(3) n3(u)) / t(u) * p_n-1(w|u')
    p_1(w)   = max(a(w) - D_1(a(w)), 0) / t + g / (V + 1)

a is c at the highest level; D are the modified discounts, from the counts of counts of each level. The
probabilities of the V tokens and of the unknown one sum to 1. order - 1 start symbols stand before a
text; an unknown context leaves the lower level's probability. N-grams are told apart by 64-bit
hashes: of n distinct ones n(n-1) / 2**65 pairs are expected to collide and be counted as one.

Null text is empty and has its end alone; repeated rows count as often as they occur; an empty table
has no score rows. With no training row, every token is unknown and has probability 1. Texts of any
length are scanned whole. Columns other than the id, the text and the flag are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm import common as C
from strandwise.llm.common import U64
from strandwise.llm.counting import RUN, Runs, bits_for, by_part, merged, parts_for

END, START = (U64(C.hash_word(x)) for x in (b"\nend", b"\nstart"))  # no word holds white space, so no word has these bytes
#: What a lower level keeps of a key: c and a as an n-gram; t, n1, n2 and n3 as a context.
LOWER = 6
NOTE = "part long, kinds long, tokens long, adjusted long, ones long, twos long, threes long, fours long, more long"


class Grams:
    """Hashes of all n-grams of a block of rows: order - 1 start symbols, the words and one end for each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, order: int):
        low = C.LOWER[data]
        starts, ends = C.runs(~C.SPACE[low], offs)
        at = C.per_row(starts, offs)
        words = np.insert(C.token_hashes(low, starts, ends), at[1:], END)
        self.n = np.diff(at) + 1
        rows, pad = len(self.n), order - 1
        first = np.cumsum(self.n) - self.n + pad * np.arange(1, rows + 1)
        self.real = C.ragged(first, self.n)  # places of words and ends
        tokens = np.full(len(words) + pad * rows, START)
        tokens[self.real] = words
        self.levels = [tokens]
        for _ in range(order - 1):  # a window that begins before its row is of no real place
            longer = np.zeros(len(tokens), U64)
            longer[1:] = C.mix((self.levels[-1][:-1] ^ U64(0xA0761D6478BD642F)) * U64(0xE7037ED1A0B428DB) + tokens[1:])
            self.levels.append(longer)


def _discounts(n: list[int]) -> list[float]:
    """Of counts 1, 2 and 3 or more, from how many keys occur 1, 2, 3 and 4 times."""
    if not n[0] or not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.5 * (k + 1) for k in range(3)]
    return [min(max(d, 0.01), k + 1 - 0.01) for k, d in enumerate(raw)]


class KneserNey:
    """A counted model in a shared folder; drop() removes it."""

    def __init__(self, folder: str, levels: list[C.HashArrays], about: dict):
        self.folder, self.levels, self.about = folder, levels, about

    @classmethod
    def count(cls, train: DataFrame, text: str = "text", order: int = 3, keys_a_part: int = 3 << 20) -> KneserNey:
        """Counts all rows of train. Parts grow in number with the corpus, not in size: a task holds one of keys_a_part n-grams, or a third of that on lower levels."""
        assert order > 1
        spark = train.sparkSession
        folder = C.SharedFolder.create(spark, "kneser-ney")
        try:
            return cls._count(train.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), folder.uri, order, keys_a_part)
        except BaseException:
            folder.drop()
            raise

    @classmethod
    def _count(cls, train: DataFrame, folder: str, order: int, keys_a_part: int) -> KneserNey:
        octets, rows, tasks = train.select(F.octet_length("text").cast("long").alias("n"), F.spark_partition_id().alias("task")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("task"), F.lit(0)) + 1).first()
        tokens, parts = (octets + 6 * rows) // 6, parts_for(octets // 2 + (order + 1) * rows, tasks, LOWER)
        above, notes = None, []
        with C.shuffles_removed(train.sparkSession):
            for level in range(order, 0, -1):
                bits = bits_for(tokens, keys_a_part if above is None else keys_a_part // 3)
                columns = 1 if above is None else LOWER
                arrays = C.HashArrays(folder, f"level-{level}", bits, columns)
                seen = by_part(train.mapInArrow(_counter(order, level, above, bits, parts), RUN), bits, _writer(arrays, columns, parts), NOTE)
                # a row for each part
                total = seen.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kinds", "tokens", "adjusted", "ones", "twos", "threes", "fours", "more"))).first()
                notes.append({"discounts": _discounts([total.ones, total.twos, total.threes, total.fours]), **total.asDict()})
                above, kept = arrays, [arrays, *(kept if above is not None else [])]
        return cls(folder, kept, {"order": order, "levels": notes[::-1]})

    def score(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", flag: Column | None = None) -> DataFrame:
        """For each row: its id, the flag, and over its tokens and end the number of all and of known ones, the base and the model's log10 probability."""
        model = self
        chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

        def scored(batches):
            for batch in batches:
                parts = []
                for *_, data, offs in C.text_blocks(batch):
                    n, known, base, logp = model.tokens(data, offs)
                    first = np.cumsum(n) - n
                    parts.append((n, *(np.add.reduceat(x, first) for x in (known.astype(np.int64), base, logp))))
                if parts:
                    n, known, base, logp = (np.concatenate(x) for x in zip(*parts, strict=True))
                    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.about["levels"][0]["tokens"]), pa.int64()), pa.array(base), pa.array(logp)], names)

        return chosen.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def tokens(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each row; of each token whether it is known, its base and its log10 probability."""
        grams, about = Grams(data, offs, self.about["order"]), self.about["levels"]
        real, low = grams.real, about[0]
        kinds = low["kinds"]
        c, a, *context = _spread(self.levels[0], grams.levels[0])
        base = np.log10((c[real] + 1) / (low["tokens"] + (kinds + 1)))
        free = low["discounts"][0] * low["ones"] + low["discounts"][1] * low["twos"] + low["discounts"][2] * low["more"]
        share = _less(a[real], low["discounts"]) / max(low["adjusted"], 1)
        p = share + (free / low["adjusted"] if low["adjusted"] else 1.0) / (kinds + 1)
        for k, level in enumerate(self.levels[1:], 1):
            d, of = about[k]["discounts"], real - 1
            total = np.maximum(context[0][of], 1)
            rest = np.where(context[0][of] > 0, (d[0] * context[1][of] + d[1] * context[2][of] + d[2] * context[3][of]) / total, 1.0)
            if level.columns > 1:
                _, a, *context = _spread(level, grams.levels[k])
                a = a[real]
            else:
                (a,) = _spread(level, grams.levels[k][real])
            p = _less(a, d) / total + rest * p
        return grams.n, c[real] > 0, base, np.log10(p)

    def drop(self) -> None:
        C.SharedFolder(self.folder).drop()


def _spread(level: C.HashArrays, keys: np.ndarray) -> np.ndarray:
    """Numbers of a level for keys in any order."""
    kinds, _, inverse = C.distinct(keys)
    return level.look(kinds)[1][:, inverse]


def _less(a: np.ndarray, discounts: list[float]) -> np.ndarray:
    return np.maximum(a - np.array([0.0, *discounts])[np.minimum(a, 3).astype(np.int64)], 0)


def _counter(order: int, level: int, above: C.HashArrays | None, bits: int, parts: int):
    """Runs of a level's keys from batches of texts."""

    def highest(grams: Grams):
        return C.count_keys(grams.levels[level - 1][grams.real])

    def lower(grams: Grams):
        kinds, _, longer = C.distinct(grams.levels[level][grams.real])
        held, columns = above.look(kinds)
        if not held.all():
            raise RuntimeError("an n-gram was not counted: the text is not the one that the level above has seen")
        once, a = (1 / columns[0])[longer], columns[min(1, above.columns - 1)]
        keys, _, place = C.distinct(grams.levels[level - 1])
        own, context = place[grams.real], place[grams.real - 1]
        kind = np.minimum(a, 3)[longer]
        sums = [np.bincount(own, minlength=len(keys)), np.bincount(own, once, len(keys)), np.bincount(context, once * a[longer], len(keys))]
        for k in (1, 2, 3):
            here = kind == k
            sums.append(np.bincount(context[here], once[here], len(keys)))
        return keys, np.stack(sums)

    def count(batches):
        held = Runs(bits) if above is None else Runs(bits, LOWER, 1, parts)
        for batch in batches:
            for *_, data, offs in C.text_blocks(batch):
                yield from held.add(*(highest if above is None else lower)(Grams(data, offs, order)))
        yield from held.close()

    return count


def _writer(arrays: C.HashArrays, columns: int, parts: int):
    """Writes a part and notes its counts of counts."""

    def write(rows: pa.Table) -> pa.Table:
        keys, sums = merged(rows, columns, None if columns == 1 else 1, parts)
        sums = np.rint(sums)  # sums of 1/c over all c occurrences
        part = rows["part"][0].as_py()
        arrays.write(part, keys, sums)
        c, a = sums[0], sums[min(1, columns - 1)]
        note = [part, int((c > 0).sum()), int(c.sum()), int(a.sum()), *(int((a == k).sum()) for k in (1, 2, 3, 4)), int((a >= 3).sum())]
        return pa.Table.from_arrays([pa.array([x], pa.int64()) for x in note], [x.split()[0] for x in NOTE.split(", ")])

    return write
