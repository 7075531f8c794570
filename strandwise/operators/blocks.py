"""Tables of sequences that meet all of each other, in blocks: differing columns are counted by bit planes.

A sequence is five words, one for each bit of its letters' numbers, with a bit for each column. Two sequences differ
in the columns where any of the words do, so a pair costs some bit operations on whole vectors. A block is packed
once, into bytes, and goes to the tasks of all blocks that it meets: what is shuffled is the rows times the
blocks of the other side, and a task holds two blocks. Blocks grow with the tables, so the copies stay few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions import sequences as S
from strandwise.operators.graph import cut

BITS = 5
#: Rows of a block, at least and at most, how many blocks a table has in between, and tasks at most.
LEAST, MOST, BLOCKS, TASKS = 1 << 12, 1 << 16, 24, 4000
#: Parts of the donors that a block of queries meets in tasks of their own.
SLABS = 8
_NUMBERS = np.zeros(256, np.uint8)
_NUMBERS[np.frombuffer(S.ALPHABET.encode(), np.uint8)] = np.arange(len(S.ALPHABET))
_COLUMNS = np.uint32(1) << np.arange(S.LENGTH, dtype=np.uint32)


def numbers(aligned: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, columns) numbers of aligned sequences' letters; a gap is 0."""
    joined = "".join(aligned.to_pylist()).encode("ascii")
    return _NUMBERS[np.frombuffer(joined, np.uint8)].reshape(-1, S.LENGTH)


def planes(aligned: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(BITS, rows) words of aligned sequences."""
    of = numbers(aligned)
    return np.stack([((of >> k & 1) * _COLUMNS).sum(1, dtype=np.uint32) for k in range(BITS)])


def gaps(words: np.ndarray) -> np.ndarray:
    """A bit for each column that is a gap."""
    return np.bitwise_or.reduce(words, axis=0) ^ np.uint32((1 << S.LENGTH) - 1)


def letters(words: np.ndarray) -> np.ndarray:
    """(columns, rows) numbers of letters, from planes."""
    columns = np.arange(S.LENGTH, dtype=np.uint32)[:, None]
    return sum(((words[k] >> columns & 1) << k for k in range(BITS))).astype(np.uint8)


class Differing:
    """Counts of differing columns of one sequence against many, into buffers that are used again."""

    def __init__(self, words: np.ndarray):
        self.words = np.ascontiguousarray(words)
        self.any, self.one = np.empty((2, words.shape[1]), np.uint32)
        self.count = np.empty(words.shape[1], np.uint8)

    def of(self, own: np.ndarray, first: int = 0, bits: int = BITS) -> np.ndarray:
        """Against the rows from `first` on; with fewer bits at most as many as there are."""
        total, one, count = self.any[first:], self.one[first:], self.count[first:]
        np.bitwise_xor(self.words[0, first:], own[0], out=total)
        for k in range(1, bits):
            np.bitwise_xor(self.words[k, first:], own[k], out=one)
            np.bitwise_or(total, one, out=total)
        return np.bitwise_count(total, out=count)


class Equal:
    """The most columns that sequences have in common with a block's rows, and the rows that reach it, 64 rows in a word.

    Each letter of a column has a bit for each row that holds it. The bits of a sequence's thirty letters are added up by full adders, on
    whole vectors of words, into five planes of the binary counts; from the highest plane down, rows that have a bit leave behind those without it.
    A fold's rows begin at a word of their own, so that a sequence passes over its fold.
    """

    WORDS = 1 << 13  # of a buffer: sequences times words

    def __init__(self, words: np.ndarray, folds: np.ndarray):
        kinds, of = np.unique(folds, return_inverse=True)
        sizes = np.bincount(of, minlength=len(kinds))
        room = -(-sizes // 64)
        order = np.argsort(of, kind="stable")
        place = np.repeat(64 * (np.cumsum(room) - room) - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(order))
        self.row = np.full(64 * int(room.sum()), -1)
        self.row[place] = order
        spread = np.full((S.LENGTH, len(self.row)), 255, np.uint8)
        spread[:, place] = letters(words)[:, order]
        bits = lambda z: np.packbits(z, axis=-1, bitorder="little").view(np.uint64)
        self.held = np.stack([bits(column == np.arange(len(S.ALPHABET), dtype=np.uint8)[:, None]) for column in spread])
        self.there, self.fold = bits(self.row >= 0), np.repeat(kinds, room)

    def most(self, x: np.ndarray, rows: np.ndarray, fold: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]]:
        """For some of the rows (sequences by letters, x, without gaps) at a time: these, their most equal columns, and what gives for places in these the pairs (place, row of the block) that reach it."""
        use = np.flatnonzero(self.fold != fold) if fold is not None else np.arange(len(self.fold))
        held, there, at = np.ascontiguousarray(self.held[:, :, use]), self.there[use], self.row.reshape(-1, 64)[use]
        step = max(1, self.WORDS // max(1, len(use)))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            most, left, spare = np.zeros(len(part), np.int64), np.repeat(there[None], len(part), 0), np.empty((len(part), len(use)), np.uint64)
            for bit, plane in reversed(list(enumerate(_counts(held, x[:, part])))):
                np.bitwise_and(left, plane, out=spare)
                some = spare.any(1)
                most += some.astype(np.int64) << bit
                np.copyto(left, spare, where=some[:, None])

            def reach(places: np.ndarray, left: np.ndarray = left) -> tuple[np.ndarray, np.ndarray]:
                i, word = np.nonzero(left[places])
                hit, bit = np.nonzero(np.unpackbits(left[places[i], word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                return places[i[hit]], at[word[hit], bit]

            yield part, most, reach


def _counts(held: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Planes of the binary numbers of columns in which sequences (by letters) equal the rows of `held`, lowest first."""
    free: list[np.ndarray] = []
    waiting: list[list[np.ndarray]] = [[] for _ in range(S.LENGTH.bit_length())]

    def new() -> np.ndarray:
        return free.pop() if free else np.empty((x.shape[1], held.shape[2]), np.uint64)

    def add(k: int, c: np.ndarray) -> None:
        here = waiting[k]
        here.append(c)
        if len(here) == 3:
            a, b, _ = here
            either = new()
            np.bitwise_xor(a, b, out=either)
            np.bitwise_and(a, b, out=a)
            np.bitwise_and(either, c, out=b)
            np.bitwise_or(a, b, out=a)
            np.bitwise_xor(either, c, out=either)
            free.extend((b, c))
            here[:] = [either]
            add(k + 1, a)

    for column in range(S.LENGTH):
        add(0, np.take(held[column], x[column], axis=0, out=new(), mode="clip"))
    for k, here in enumerate(waiting):
        if len(here) == 2:
            a, b = here
            here[:] = [a ^ b]
            add(k + 1, np.bitwise_and(a, b, out=a))
    return [here[0] if here else np.zeros((x.shape[1], held.shape[2]), np.uint64) for here in waiting]


def _packed(rows: DataFrame, name: str, number: int, keep: list[str]) -> DataFrame:
    """A row for each block: its number, the planes as bytes and the kept columns as lists, in the order of these."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def pack(part: pa.Table) -> pa.Table:
        at = part["__b"][0].as_py()
        part = part.sort_by([(c, "ascending") for c in keep]).combine_chunks()
        lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part[c].combine_chunks()) for c in keep]
        return pa.Table.from_arrays([pa.array([at], pa.int32()), pa.array([planes(part["aligned"]).tobytes()], pa.binary()), *lists], [name, f"{name}_words", *(f"{name}_{c}" for c in keep)])

    dealt = rows.select("aligned", *keep, F.pmod(F.xxhash64("aligned", *keep), F.lit(number)).cast("int").alias("__b"))
    return cut(dealt.groupBy("__b").applyInArrow(pack, f"{name} int, {name}_words binary, " + ", ".join(f"{name}_{c} array<{types[c]}>" for c in keep)))


def size_of(rows: int) -> int:
    return max(LEAST, min(MOST, -(-rows // BLOCKS)))


def meet(x: DataFrame, keep_x: list[str], y: DataFrame | None, keep_y: list[str], found: Callable[[Block, Block, bool], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What `found` says of each two blocks of x and y; without y, of each unordered two blocks of x, the last argument being whether both are one."""
    nx = x.count()
    ny = nx if y is None else y.count()
    gx, gy = (max(1, -(-n // size_of(n))) for n in (nx, ny))
    xs = _packed(x, "x", gx, keep_x)
    ys = xs.select(F.col("x").alias("y"), F.col("x_words").alias("y_words"), *(F.col(f"x_{c}").alias(f"y_{c}") for c in keep_x)) if y is None else _packed(y, "y", gy, keep_y)
    to = F.sequence(F.col("x"), F.lit(gx - 1)) if y is None else F.sequence(F.lit(0), F.lit(gy - 1))
    back = F.sequence(F.lit(0), F.col("y")) if y is None else F.sequence(F.lit(0), F.lit(gx - 1))
    tasks = min(TASKS, gx * (gx + 1) // 2 if y is None else gx * gy)
    # dealt by their number, so that each task has about one pair; no side is broadcast
    both = F.col("x") * gy + F.col("y")
    left = xs.withColumn("y", F.explode(to)).withColumn("at", both).repartition(tasks, "at")
    right = ys.withColumn("x", F.explode(back)).withColumn("at", both).drop("x", "y").repartition(tasks, "at")
    same = y is None
    names = (keep_x, keep_x if same else keep_y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, two = (Block(batch, side, row, keep) for side, keep in zip("xy", names, strict=True))
                out = found(one, two, same and one.number == two.number)
                if out is not None:
                    yield out

    return left.join(right.hint("shuffle_hash"), "at").mapInArrow(run, schema)


class Block:
    """The words of a block's rows and the columns that were kept."""

    def __init__(self, batch: pa.RecordBatch, side: str, row: int, keep: list[str]):
        self.number = batch[side][row].as_py()
        self.words = np.frombuffer(batch[f"{side}_words"][row].as_buffer(), np.uint32).reshape(BITS, -1)
        self.columns = {c: batch[f"{side}_{c}"][row].values for c in keep}

    def __getitem__(self, name: str) -> pa.Array:
        return self.columns[name]

    def numbers(self, name: str) -> np.ndarray:
        return self.columns[name].to_numpy(zero_copy_only=False)


def _near(x: Block, y: Block, one: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rows of x and y (of unordered pairs, if both are one block) at the threshold, and their identities."""
    most = int((1 - threshold) * S.LENGTH + 1e-9)
    near, row_of, col_of = Differing(y.words), [], []
    for i in range(x.words.shape[1]):
        first = i + 1 if one else 0
        hit = np.flatnonzero(near.of(x.words[:, i], first, 2) <= most)  # two planes tell most pairs apart
        if len(hit):
            hit = hit[np.bitwise_count(np.bitwise_or.reduce(x.words[:, i, None] ^ y.words[:, first + hit], axis=0)) <= most]
            row_of.append(np.full(len(hit), i, np.int32))
            col_of.append((first + hit).astype(np.int32))
    if not row_of:
        return None
    i, j = np.concatenate(row_of), np.concatenate(col_of)
    gx, gy = gaps(x.words), gaps(y.words)
    used = (S.LENGTH - np.bitwise_count(gx[i] & gy[j])).astype(float)
    differ = np.bitwise_count(np.bitwise_or.reduce(x.words[:, i] ^ y.words[:, j], axis=0))
    identity = (used - differ) / np.maximum(used, 1)
    keep = identity + S.EPS >= threshold
    return i[keep], j[keep], identity[keep]


def near_pairs(rows: DataFrame, name: str, threshold: float) -> DataFrame:
    """(a, b, identity) of distinct sequences at the threshold; a < b are values of the column `name`."""

    def found(x: Block, y: Block, one: bool) -> pa.RecordBatch | None:
        pairs = _near(x, y, one, threshold)
        if pairs is None:
            return None
        i, j, identity = pairs
        return pa.RecordBatch.from_arrays([x[name].take(pa.array(i)), y[name].take(pa.array(j)), pa.array(identity)], ["a", "b", "identity"])

    kind = rows.schema[name].dataType.simpleString()
    pairs = meet(rows.select("aligned", name), [name], None, [name], found, f"a {kind}, b {kind}, identity double")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "identity")


def near_forest(rows: DataFrame, name: str, thresholds: list[float]) -> DataFrame:
    """Links (a, b, level) whose components at each of the rising thresholds, by links of its level and higher ones, are those of all pairs at it; edges 0.

    Two blocks give no more links than they have rows, however many pairs there are. Rows without a and b give the
    pairs (edges) that reach the threshold of a level and not the next one.
    """
    kind = rows.schema[name].dataType.simpleString()

    def found(x: Block, y: Block, one: bool) -> pa.RecordBatch | None:
        pairs = _near(x, y, one, thresholds[0])
        if pairs is None:
            return None
        i, j, identity = pairs
        shift = 0 if one else x.words.shape[1]
        j = j + shift
        level = np.searchsorted(np.array(thresholds), identity + S.EPS, "right") - 1
        label = np.arange(shift + y.words.shape[1])
        a, b, of = [], [], []
        for k in range(len(thresholds) - 1, -1, -1):
            here = level == k
            new = merged(label, i[here], j[here])
            moved = np.flatnonzero((label == np.arange(len(label))) & (new != label))
            a.append(new[moved])
            b.append(moved)
            of.append(np.full(len(moved), k, np.int32))
            label = new
        counts = np.bincount(level, minlength=len(thresholds))
        names = x[name] if one else pa.concat_arrays([x[name], y[name]])
        none = pa.nulls(len(thresholds), names.type)
        ends = [pa.concat_arrays([names.take(pa.array(np.concatenate(z))), none]) for z in (a, b)]
        links = sum(map(len, a))
        return pa.RecordBatch.from_arrays([*ends, pa.array(np.concatenate([*of, np.arange(len(thresholds), dtype=np.int32)])), pa.array(np.concatenate([np.zeros(links, np.int64), counts]))], ["a", "b", "level", "edges"])

    return meet(rows.select("aligned", name), [name], None, [name], found, f"a {kind}, b {kind}, level int, edges long")


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each row's least member) after rows i and j are linked, too."""
    now = label.copy()
    while True:
        a, b = now[i], now[j]
        apart = a != b
        if not apart.any():
            return now
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(now, np.maximum(a, b), np.minimum(a, b))
        while (now != now[now]).any():
            now = now[now]


def reached(x: DataFrame, y: DataFrame, threshold: float) -> DataFrame:
    """(rep, group) of rows of x (aligned, rep) with a row of y (aligned, group) at the threshold: once for each two blocks, however many rows of the group there are."""
    kind, group = x.schema["rep"].dataType.simpleString(), y.schema["group"].dataType.simpleString()

    def found(one: Block, two: Block, same: bool) -> pa.RecordBatch | None:
        pairs = _near(one, two, False, threshold)
        if pairs is None:
            return None
        code = two["group"].dictionary_encode()
        both = np.unique(pairs[0].astype(np.int64) * len(code.dictionary) + code.indices.to_numpy()[pairs[1]])
        i, g = np.divmod(both, len(code.dictionary))
        return pa.RecordBatch.from_arrays([one["rep"].take(pa.array(i)), code.dictionary.take(pa.array(g))], ["rep", "group"])

    return meet(x, ["rep"], y, ["group"], found, f"rep {kind}, group {group}").distinct()


def fewest(queries: DataFrame, references: DataFrame) -> DataFrame:
    """aligned, distance and nearest: for each block of references that with the fewest differing columns, the smallest first_id on ties."""

    def found(x: Block, y: Block, one: bool) -> pa.RecordBatch:
        near, at, least = Differing(y.words), np.zeros(x.words.shape[1], np.int64), np.zeros(x.words.shape[1], np.int64)
        for i in range(x.words.shape[1]):
            count = near.of(x.words[:, i])
            least[i] = count.min()
            at[i] = np.flatnonzero(count == least[i])[0]  # rows are in the order of first_id
        return pa.RecordBatch.from_arrays([x["qid"], pa.array(least), y["first_id"].take(pa.array(at))], ["qid", "distance", "nearest"])

    return meet(queries.select("aligned", "qid"), ["qid"], references.select("aligned", "first_id"), ["first_id"], found, "qid long, distance long, nearest string")


def best(queries: DataFrame, donors: DataFrame, same_fold: bool) -> DataFrame:
    """qid, identity and dids for each query (aligned, fold, qid) and slab of donors (aligned, fold, did) with one that counts for it: the best identity there and what ties at it.

    A task takes a block of queries past the donors' blocks of a slab, one after the other, and keeps what is best so far: at the identities of unrelated
    sequences each block has ties of its own, which are not to leave the task for every block.
    """
    return streamed(queries, ["qid", "fold"], donors, ["did", "fold"], Leaders, lambda leaders, y: leaders.meet(y, same_fold), "qid long, identity double, dids array<long>")


def streamed(queries: DataFrame, keep_x: list[str], donors: DataFrame, keep_y: list[str], begin: Callable[[Block], object], go: Callable[[object, Block], None], schema: str) -> DataFrame:
    """What found() of begin(x) gives after it met (go) the donors' blocks of a slab, for each block x of queries and each slab."""
    nx, ny = queries.count(), donors.count()
    gx, gy = (max(1, -(-n // size_of(n))) for n in (nx, ny))
    slabs = min(SLABS, gy)
    xs, ys = _packed(queries.select("aligned", *keep_x), "x", gx, keep_x), _packed(donors.select("aligned", *keep_y), "y", gy, keep_y)
    left = xs.withColumn("unit", F.explode(F.sequence(F.col("x") * slabs, F.col("x") * slabs + (slabs - 1))))
    right = ys.withColumn("__x", F.explode(F.sequence(F.lit(0), F.lit(gx - 1)))).withColumn("unit", F.col("__x") * slabs + F.col("y") % slabs).drop("__x")
    tasks = min(TASKS, gx * slabs)
    left, right = left.repartition(tasks, "unit").hint("shuffle_hash"), right.repartition(tasks, "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: dict = {}
        for batch in batches:
            for row in range(batch.num_rows):
                unit = batch["unit"][row].as_py()
                if unit not in units:
                    units[unit] = begin(Block(batch, "x", row, keep_x))
                go(units[unit], Block(batch, "y", row, keep_y))
        for leaders in units.values():
            yield from leaders.found()

    return left.join(right, "unit").select("unit", *xs.columns, *ys.columns).mapInArrow(run, schema)


class Leaders:
    """The best identity of each query of a block among the donors that it has met, and the donors at it."""

    def __init__(self, x: Block):
        # a batch's memory is used again, so what stays is copied
        self.words, self.qid, self.folds = x.words.copy(), np.array(x.numbers("qid")), _folds(x, -1)
        self.gaps, self.letters = gaps(self.words), letters(self.words)
        self.top = np.full(len(self.qid), -1.0)
        self.tied: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.limit = 0, 1 << 20

    def meet(self, y: Block, same_fold: bool) -> None:
        folds, gy, did = _folds(y, -2), gaps(y.words), y.numbers("did")
        equal, found = Equal(y.words, folds), []
        for fold in [None] if same_fold else np.unique(self.folds):
            own = np.arange(len(self.qid)) if fold is None else np.flatnonzero(self.folds == fold)
            others = np.arange(len(did)) if fold is None else np.flatnonzero(folds != fold)
            if not len(others):
                continue
            for rows, most, held in equal.most(self.letters, own[self.gaps[own] == 0], fold):
                share = most / S.LENGTH  # no column is a gap in both
                keep = np.flatnonzero(share >= self.top[rows] - S.EPS)
                self.top[rows[keep]] = np.maximum(share[keep], self.top[rows[keep]])
                row, at = held(keep)
                found.append((rows[row], share[row], did[at]))
            gapped = own[self.gaps[own] != 0]
            near = Differing(y.words[:, others]) if len(gapped) else None
            for gap in np.unique(self.gaps[gapped]):
                blank = np.bitwise_count(gap & gy[others]).astype(float)
                used = np.maximum(S.LENGTH - blank, 1)
                for i in gapped[self.gaps[gapped] == gap]:
                    share = (S.LENGTH - blank - near.of(self.words[:, i])) / used
                    top = share.max()
                    if top < self.top[i] - S.EPS:
                        continue
                    at = np.flatnonzero(share >= top - S.EPS)
                    self.top[i] = max(top, self.top[i])
                    found.append((np.full(len(at), i), np.full(len(at), top), did[others[at]]))
        if found:
            self.tied.append(tuple(np.concatenate(z) for z in zip(*found, strict=True)))
            self.held += len(self.tied[-1][0])
            if self.held > self.limit:  # what was best for a while goes
                self.tied = [self._leading()]
                self.held = len(self.tied[0][0])
                self.limit = max(self.limit, 2 * self.held)

    def _leading(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, share, did = (np.concatenate(z) for z in zip(*self.tied, strict=True))
        keep = share >= self.top[row] - S.EPS
        return row[keep], share[keep], did[keep]

    def found(self) -> Iterator[pa.RecordBatch]:
        if not self.tied:
            return
        row, _, did = self._leading()
        order = np.argsort(row, kind="stable")
        row, did = row[order], did[order]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        upto = np.concatenate((first, [len(row)]))
        for k in range(0, len(first), 1 << 12):
            part = upto[k : k + (1 << 12) + 1]
            lists = pa.LargeListArray.from_arrays(pa.array(part - part[0], pa.int64()), pa.array(did[part[0] : part[-1]])).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(self.qid[row[part[:-1]]]), pa.array(self.top[row[part[:-1]]]), lists], ["qid", "identity", "dids"])


def _folds(block: Block, null: int) -> np.ndarray:
    """Folds of a block's rows, with a number of its own for null."""
    return np.array(block["fold"].fill_null(null))
