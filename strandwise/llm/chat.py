r"""Chat formatting by tokens: segments are encoded alone, reserved ids are spliced between them, masks come from prefix sums.

A turn is `[INST]text[/INST]` of a user, `<s>text</s>` of an assistant and `[ROLE]role[/ROLE]text</s>` of
anyone else. The marks are ids beyond the vocabulary, so no text encodes to one; and where a mark's
string occurs in a role or text, a backslash goes behind its first character (`[INST]` becomes
`[\INST]`, `[\INST]` becomes `[\\INST]`), so that the rendered string can be read back, too: marks have no
`<` or `[` but their first character, hence matches never overlap nor cross a segment's border.

Rows are ordered by turn, ties by a hash, role and text; rows equal in all are turns of their own. Null text and
role are empty, a null turn is the first, the rows of a null conversation are one conversation. Texts
of any length are encoded whole; a conversation of any number of turns is spread over tasks by turns,
and its digests are continued over files of the shared folder. Empty tables give no rows. Other
columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm import common as C

#: Marks of the template; their ids follow the vocabulary's in this order.
MARKS = ["[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]"]
USER, USER_END, ASSISTANT, END, ROLE, ROLE_END = range(len(MARKS))
#: Strings that mean something to the template or to the tokenizer.
CONTROL = [*MARKS, "<|endoftext|>"]
_RAW = re.compile("|".join(rf"{re.escape(x[0])}(?=\\*{re.escape(x[1:])})" for x in CONTROL))
_ESCAPED = re.compile("|".join(rf"{re.escape(x[0])}\\(?=\\*{re.escape(x[1:])})" for x in CONTROL))

FORMATTED = "conv_id long, turn long, ids array<int>, loss array<boolean>"


def escape(text: str) -> str:
    return _RAW.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0], text)


class ChatTokens:
    """Encodes turns and reads them back."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bytes_bpe = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first_mark = max(ranks.values()) + 2  # one is left for the end of a text

    def encode(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(role, text) of turns: ids of all, whether they are learned, offsets of the turns."""
        marks, segments, ids = [], [], np.zeros(0, np.int64)
        for role, text in turns:  # marks[k] stands before segment k; None: a turn begins with the next
            if role == "user":
                marks += [[USER], [USER_END]]
            elif role == "assistant":
                marks += [[ASSISTANT], [END]]
            else:
                marks += [[ROLE], [ROLE_END], [END]]
                segments.append(escape(role))
            segments += [escape(text), ""]
        lists = [self.bytes_bpe.encode_ordinary(x) if x else [] for x in segments]
        n = np.array([len(x) for x in lists], np.int64)
        kind = np.array([m[0] for m in marks], np.int64)
        at = np.cumsum(n + 1) - n - 1  # each mark's place, its segment follows
        ids = np.empty(int((n + 1).sum()), np.int32)
        ids[at] = kind + self.first_mark
        plain = np.ones(len(ids), bool)
        plain[at] = False
        ids[plain] = np.fromiter((i for x in lists for i in x), np.int32, int(n.sum()))
        step = np.zeros(len(ids) + 1, np.int32)  # learned from behind an assistant's mark to its end
        mine = np.flatnonzero(kind == ASSISTANT)
        step[at[mine] + 1] += 1
        step[at[mine] + 1 + n[mine]] -= 1
        last = np.flatnonzero((kind == END) | (kind == USER_END))
        return ids, np.cumsum(step)[:-1] > 0, np.concatenate(([0], at[last] + 1))

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_bpe.decode_bytes(ids.tolist()).decode("utf-8", "replace")

    def read(self, ids: np.ndarray, loss: np.ndarray) -> tuple[str, str, str, int]:
        """Role, text, learned text and the code points of the rendered string of one turn."""
        at = np.flatnonzero(ids >= self.first_mark)
        kinds = (ids[at] - self.first_mark).tolist()
        segments = [self.decode(ids[a + 1 : b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        size = sum(map(len, segments)) + sum(len(MARKS[k]) for k in kinds)
        learned = unescape(self.decode(ids[loss])) if loss.any() else ""
        if kinds[0] == ROLE:
            role, text = map(unescape, segments)
        else:
            role, text = "user" if kinds[0] == USER else "assistant", unescape(segments[0])
        return role, text, learned, size


_loaded: dict[str, ChatTokens] = {}


def chat_tokens(path: str) -> ChatTokens:
    if path not in _loaded:
        _loaded[path] = ChatTokens(path)
    return _loaded[path]


def format_chats(rows: DataFrame, ranks_path: str, block_bytes: int = C.BLOCK_BYTES) -> DataFrame:
    """conv_id, turn, ids and loss of each turn, in order: tasks hold ranges of (conversation, turn), sorted."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    keys = ["conv_id", "turn", "tie"]
    dealt = turns.withColumn("tie", F.xxhash64("role", "text")).withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*keys, "copy")
    ordered = dealt.sortWithinPartitions(*keys, "role", "text").select("conv_id", "turn", "role", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = chat_tokens(ranks_path)
        for batch in batches:
            for i, j, *_ in C.text_blocks(batch, limit=block_bytes):
                part = batch.slice(i, j - i)
                ids, loss, at = tokens.encode(list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)))
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(at, pa.array(ids)), pa.ListArray.from_arrays(at, pa.array(loss))], ["conv_id", "turn", "ids", "loss"])

    return ordered.mapInArrow(encode, FORMATTED)


class _Spill:
    """Bytes of a conversation that may go on in another task: files of some megabytes."""

    def __init__(self, folder: str, name: str, size: int):
        self.folder, self.name, self.size, self.held, self.files = folder, name, size, bytearray(), 0

    def update(self, data: bytes) -> None:
        self.held += data
        if len(self.held) >= self.size:
            self.close()

    def close(self) -> None:
        if self.held:
            C.SharedFolder(self.folder).write(f"{self.name}-{self.files}", np.frombuffer(bytes(self.held), np.uint8))
            self.files, self.held = self.files + 1, bytearray()


READ = "conv_id long, n_turns long, loss_chars long, formatted_chars long, turns_sha256 string, loss_sha256 string, part int, piece long, turns_files int, loss_files int"


def read_back(formatted: DataFrame, ranks_path: str, spill_bytes: int = 8 << 20) -> DataFrame:
    """Digests of each conversation, from ids and masks in the order that format_chats gives.

    A task's first and last conversations may go on in its neighbours: their bytes go to files, which one
    row for each such piece names, and are hashed one behind the other, some megabytes at a time.
    """
    folder = C.SharedFolder.create(formatted.sparkSession, "chats")
    uri = folder.uri

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = chat_tokens(ranks_path), TaskContext.get().partitionId()
        done: list[tuple] = []
        current, piece, state = None, -1, None

        def opened() -> list:
            """Turns, learned and all characters, digests, and the bytes, as any conversation may prove to be the last."""
            return [0, 0, 0, sha256(), sha256(), _Spill(uri, f"{part}-{piece}-turns", spill_bytes), _Spill(uri, f"{part}-{piece}-loss", spill_bytes)]

        def closed(last: bool = False) -> tuple:
            n, learned, size, turns, loss, spilled, spilled_loss = state
            if not last and piece:
                return (current, n, learned, size, turns.hexdigest(), loss.hexdigest(), part, piece, 0, 0)
            spilled.close()
            spilled_loss.close()
            return (current, n, learned, size, None, None, part, piece, spilled.files, spilled_loss.files)

        for batch in batches:
            ids, loss = batch.column(2), batch.column(3)
            flat, flags, at = ids.flatten().to_numpy(), loss.flatten().to_numpy(zero_copy_only=False), np.asarray(ids.offsets) - ids.offsets[0].as_py()
            for k, conv_id in enumerate(batch.column(0).to_pylist()):
                if state is None or conv_id != current:
                    if state is not None:
                        done.append(closed())
                    current, piece = conv_id, piece + 1
                    state = opened()
                role, text, learned, size = tokens.read(flat[at[k] : at[k + 1]], flags[at[k] : at[k + 1]])
                turn, own = f"{role}\n{text}\n".encode(), learned.encode()
                state[0] += 1
                state[1] += len(learned)
                state[2] += size
                for to, data in zip(state[3:], (turn, own, turn, own), strict=True):
                    to.update(data)
            if len(done) > 10_000:
                yield _rows(done)
                done = []
        if state is not None:
            done.append(closed(last=True))
        yield _rows(done)

    found = C.cut(formatted.mapInArrow(read, READ))

    def join(table: pa.Table) -> pa.Table:
        """One conversation of several tasks. Its rows are pieces, at most two of each task."""
        pieces = sorted(table.to_pylist(), key=lambda r: r["part"])
        turns, loss, shared = sha256(), sha256(), C.SharedFolder(uri)
        for r in pieces:
            for kind, to in (("turns", turns), ("loss", loss)):
                for k in range(r[f"{kind}_files"]):
                    to.update(shared.map(f"{r['part']}-{r['piece']}-{kind}-{k}"))
        total = lambda c: sum(r[c] for r in pieces)
        return _rows([(pieces[0]["conv_id"], total("n_turns"), total("loss_chars"), total("formatted_chars"), turns.hexdigest(), loss.hexdigest(), 0, 0, 0, 0)], table=True)

    inside = found.filter("turns_sha256 is not null")
    across = found.filter("turns_sha256 is null").groupBy("conv_id").applyInArrow(join, READ)
    return inside.unionByName(across).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _rows(rows: list[tuple], table: bool = False) -> pa.RecordBatch | pa.Table:
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    arrays, names = [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in READ.split(", ")]
    return (pa.Table if table else pa.RecordBatch).from_arrays(arrays, names)
