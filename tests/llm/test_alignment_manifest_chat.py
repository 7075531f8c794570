"""Token alignment, Merkle manifests and chat formatting against plain versions: nulls, ties, copies, odd characters, many tasks."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandwise.llm import chat, merkle, queries
from strandwise.llm import common as C
from strandwise.llm import token_alignment as align

SMALL = "/root/testdata/sf0.001"
BYTES, PIECES, RANKS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def hexed(text):
    return sha256(text.encode()).hexdigest()


def shape(df):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


# ------------------------------------------------------------------ token alignment


def plain_alignment(rows):
    a_tokens = Tokenizer.from_file(BYTES)
    a_tokens.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    alphabet = align.byte_alphabet()
    a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in a_tokens.get_vocab().items()}

    def b_bytes(i):
        piece = pieces.id_to_piece(i)
        m = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode()

    docs, count = [], Counter()
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        a = a_tokens.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        if not text or b"".join(a_bytes[i] for i in a) != raw or b"".join(map(b_bytes, b)) != raw:
            docs.append((doc_id, 0, 0, 0, [], ""))
            continue
        links, groups, i, j, x, y = [], [([], [])], 0, 0, len(a_bytes[a[0]]), len(b_bytes(b[0]))
        while i < len(a):
            links.append((a[i], b[j]))
            step_a, step_b = x <= y, y <= x
            if step_a:
                groups[-1][0].append(a[i])
                i += 1
            if step_b:
                groups[-1][1].append(b[j])
                j += 1
            if step_a and step_b:
                groups.append(([], []))
            if i < len(a):
                x, y = x + step_a * len(a_bytes[a[i]]), y + step_b * len(b_bytes(b[j]))
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups[:-1])
        docs.append((doc_id, len(a), len(b), len(groups) - 1, links, hexed(written)))
        count.update(set(links))
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(i, n_a, n_b, g, len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x), s) for i, n_a, n_b, g, x, s in docs]


#: Characters that the tokenizers take apart, join or can't give back.
PARTS = ["the", "word", " ", " ", "  ", "\n", "\t", "'s", "don't", "é", "à", "漢字", "▁", " ", "　", "<s>", "<|endoftext|>", "123", "4.5", "!!", "…", "\x00", "\x1c", "\u0085", "ﬁ", "é", "𝔘", "🙂", "×", "÷", "x" * 30, "<0x41>", "\r\n", "’s", "​", "ß", "Ω"]


def test_links_of_odd_texts(spark):
    rng = random.Random(3)
    rows = [(i % 50 or None, None if i % 97 == 0 else "".join(rng.choices(PARTS, k=rng.randint(0, 25)))) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pairs", F.lit(1)).withColumn("n_a", F.lit("x")).repartition(5)
    got = align.link_tokens(df, BYTES, PIECES).collect()
    assert ordered(got) == ordered(plain_alignment(rows)) and any(r.n_a == 0 for r in got) and any(r.n_groups > 9 for r in got)


def test_links_of_documents_and_of_none(spark):
    df = queries.op11_byte_label_links(spark, SMALL)
    assert shape(df) == "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    docs = C.table(spark, SMALL, "documents")
    assert ordered(df.collect()) == ordered(plain_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert align.link_tokens(docs.limit(0), BYTES, PIECES).collect() == []


def test_cached_chunks_give_what_whole_texts_give():
    """Small caches start anew; a text is the same in a block of its own, with others and uncut."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["one", "two,", "Three", "über", "x1", "(a)", "l'été"]) + str(rng.randint(0, 40)) for _ in range(60)) for _ in range(30)]
    both = align.Aligner(BYTES, PIECES)
    assert both.cuts
    flat = lambda rows: [(c, s, k.tolist(), t.tolist()) for c, s, k, t in rows]
    together = flat(both.align(texts))
    both.MOST = 10
    assert together == [x for t in texts for x in flat(both.align([t]))]
    both.cuts = False
    assert together == flat(both.align(texts))
    assert all(c[3] == c[0] + c[1] - c[2] for c, *_ in together)  # every border but a common one cuts a link


# ------------------------------------------------------------------ manifest


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([hexed("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            first = i // 3 * 3
            out.append((level[first:i], level[i + 1 : first + 3]))
            i //= 3
        return out

    leaf = lambda r, text: hexed("".join(map(field, (*r[:4], text))))
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s in sources}
    trees = {s: tree([leaf(r, r[4]) for r in own[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(own[s]):
            steps, text = path(trees[s], i) + path(top, k), r[4]
            if text is not None and zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for left, right in steps:
                node = hexed("".join([*left, node, *right]))
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], hexed("".join(x for left, right in steps for x in left + right)), node, node == top[-1][0]))
    return out


ROWS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 200, 700])
def test_manifest(spark, n):
    rng = random.Random(n)
    sources = [None, "s", "t", "é", "u", "", *(f"q{i}" for i in range(n // 9))]
    rows = [(rng.choice([None, *range(n)]), rng.choice(sources), rng.choice([None, "", "en"]), rng.choice([None, 3]), rng.choice(["a\nb", "", "x", None, "\n"])) for _ in range(n)]
    rows += rows[: n // 5] * 3
    df = spark.createDataFrame(rows, ROWS).withColumn("leaf", F.lit(1)).withColumn("part", F.lit("x")).repartition(3)
    got = merkle.manifest(df, window=2).collect()
    assert ordered(got) == ordered(plain_manifest(rows))


def test_manifest_of_documents_and_of_none(spark):
    df = queries.op12_merkle_manifest(spark, SMALL)
    assert shape(df) == "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    docs = C.table(spark, SMALL, "documents")
    got = df.collect()
    assert ordered(got) == ordered(plain_manifest([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]))
    assert {r.verified for r in got} == {True, False} and len({r.root for r in got}) == 1
    assert merkle.manifest(docs.limit(0)).collect() == []


def test_forests_merge_in_any_order():
    leaves = [b"%064d" % i for i in range(40)]
    whole = merkle.Forest(3, 2)
    for tree, own in ((0, leaves[:29]), (1, leaves[29:])):
        for i, x in enumerate(own):
            whole.put(tree, 0, i, x)
        whole.finish(tree, len(own))
    assert not whole.open
    root = whole.noted[merkle.ROOT, 1, 0]
    rng = random.Random(5)
    for _ in range(20):
        cuts = sorted(rng.sample(range(1, 29), 4))
        pieces = [(0, a, leaves[a:b]) for a, b in zip([0, *cuts], [*cuts, 29])] + [(1, 0, leaves[29:34]), (1, 5, leaves[34:])]
        forests = []
        for tree, first, own in pieces:
            forests.append(merkle.Forest(3, 2))
            for i, x in enumerate(own, first):
                forests[-1].put(tree, 0, i, x)
            forests[-1].finish(tree, 29 if tree == 0 else 11)
        while len(forests) > 1:
            a, b = (forests.pop(rng.randrange(len(forests))) for _ in range(2))
            forests.append(a.merge(b))
        assert forests[0].noted[merkle.ROOT, 1, 0] == root and not forests[0].open


# ------------------------------------------------------------------ chats


def plain_chats(rows):
    found = {}
    for r in rows:
        found.setdefault(r[0], []).append(r)
    out = []
    for conv_id, turns in found.items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0))
        learned = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out.append((conv_id, len(turns), hexed("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)), len(learned), hexed(learned)))
    return out


MARKED = ["<", "[", "\\", "/", "INST]", "s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "|endoftext|>", "é", " ", "\n", "[ROLE]", "ROLE]", "x", "漢", "<s>"]


def test_escaped_texts_hold_no_mark_and_come_back():
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choices(MARKED, k=rng.randint(0, 12)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not any(x in escaped for x in chat.CONTROL)


@pytest.mark.parametrize("tasks", [1, 4, 40])
def test_chats_over_tasks(spark, tasks):
    """A conversation of most rows is spread over tasks and its bytes over many files; nulls, roles with marks, clashing columns."""
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3, 4]), i if i else None, rng.choice(["user", "assistant", "system", None, "", "[INST]", "a\\b<s>", "tool\nx"]), rng.choice([None, "", *["".join(rng.choices(MARKED, k=rng.randint(0, 12)))] * 8])) for i in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("x")).withColumn("tie", F.lit(3)).repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = [tuple(r)[:5] for r in chat.read_back(chat.format_chats(df, RANKS), RANKS, spill_bytes=500).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert ordered(got) == ordered(plain_chats(rows))


def test_copies_of_a_turn(spark):
    rows = [(1, 0, "user", "again"), (1, 0, "assistant", "yes")] * 50
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    (got,) = chat.read_back(chat.format_chats(df, RANKS), RANKS).collect()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (100, 150, hexed("yes" * 50))


def test_chats_of_the_table_and_of_none(spark):
    df = queries.op13_chat_tokens(spark, SMALL)
    assert shape(df) == "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    chats = C.table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in chats.collect()] + [(-7, 0, "user", queries.MARKED), (-7, 1, "assistant", queries.MARKED)]
    got = df.collect()
    assert ordered(tuple(r)[:5] for r in got) == ordered(plain_chats(rows))
    # both texts hold three marks, each with a backslash more
    assert [r.formatted_chars for r in got if r.conv_id == -7] == [2 * (len(queries.MARKED) + 3) + len("[INST][/INST]<s></s>")]
    assert chat.read_back(chat.format_chats(chats.limit(0), RANKS), RANKS).collect() == []


def test_masks_and_marks_of_a_turn():
    tokens = chat.chat_tokens(RANKS)
    ids, loss, at = tokens.encode([("user", "Hi <s>"), ("assistant", "Hello there"), ("system", ""), ("assistant", "")])
    marks = [ids[a:b][ids[a:b] >= tokens.first_mark] - tokens.first_mark for a, b in zip(at[:-1], at[1:])]
    assert [m.tolist() for m in marks] == [[chat.USER, chat.USER_END], [chat.ASSISTANT, chat.END], [chat.ROLE, chat.ROLE_END, chat.END], [chat.ASSISTANT, chat.END]]
    assert tokens.decode(ids[loss]) == "Hello there"
    assert tokens.bytes_bpe.decode_bytes(ids[1 : at[1] - 1].tolist()) == rb"Hi <\s>"
