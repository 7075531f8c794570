"""The corpus operators against brute force, on small fixtures with nulls, empty and odd texts, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from strandwise.llm import common as C
from strandwise.llm import langid, licenses, lm, media, mixing, packing, sharding, simhash, topk, toxicity

TOKENS = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "   \n\t", "a", "It's we'll DON'T 'tis", "naïve Café ÀÉ x×y ÷ “quoted” — dash", "1234 a1b2 +1 (456) 555-2186 a@b.example", "é  nbsp em  ", "<|endoftext|> in text <| x", "😀 emoji ß ſ İ", "日本語 テキスト", "word " * 5000, "x" * 9000]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta", "gamma,", "delta.", "epsilon", "zeta", "eta", "théta"]
    rows = [(i, t, "en", "s0", 7) for i, t in enumerate(ODD)]
    for i in range(len(ODD), 60):
        rows.append((i, " ".join(rng.choice(words, rng.integers(1, 60))), ["en", "de", None][i % 3], f"s{i % 3}", 7))
    rows += [(rows[20][0], *rows[20][1:]), (None, "no id here at all", None, None, 7), (70, rows[21][1], "en", "s1", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_packing(docs, empty):
    enc = packing.WordEncoder(TOKENS)
    want = Counter()
    for r in docs.collect():
        ids = [*enc.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        at = 0
        for n in packing.binary_lengths(len(ids), 4096):
            assert n & (n - 1) == 0 and n <= 4096
            want[r.doc_id, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)] += 1
            at += n
        assert at == len(ids)
    got = rows_of(packing.pack_pieces(docs, TOKENS))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}
    assert all(r["sequence_id"] >> 58 == r["length_bits"] == int(math.log2(r["length"])) for r in got)
    assert packing.pack_pieces(empty, TOKENS).count() == 0


def brute_kneser_ney(texts, order):
    """(probability of a word after a context, the words seen, tokens): by sets of n-grams."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        padded = ["<s>"] * (order - 1) + [*words_of(t), "</s>"]
        for i in range(order - 1, len(padded)):
            for n in range(1, order + 1):
                counts[n][tuple(padded[i - n + 1 : i + 1])] += 1
    adjusted = {order: counts[order]} | {n: Counter(g[1:] for g in counts[n + 1]) for n in range(1, order)}
    discounts = {n: [0.0, *lm._discounts([sum(c == k for c in adjusted[n].values()) for k in (1, 2, 3, 4)])] for n in adjusted}
    contexts = {n: {} for n in adjusted}
    for n in adjusted:
        for g, c in adjusted[n].items():
            contexts[n].setdefault(g[:-1], []).append(c)
    v = len(counts[1])

    def p(context, w, n):
        """context: order - 1 words."""
        u = tuple(context[order - n :])
        lower = 1 / (v + 1) if n == 1 else p(context, w, n - 1)
        if u not in contexts[n]:
            return lower
        c, seen = adjusted[n][(*u, w)], contexts[n][u]
        return (max(c - discounts[n][min(c, 3)], 0) + sum(discounts[n][min(x, 3)] for x in seen) * lower) / sum(seen)

    return (lambda context, w: p(context, w, order)), counts[1], sum(counts[1].values())


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_probabilities(monkeypatch, docs, empty, order):
    train = docs.filter("doc_id % 4 <> 1")
    model = lm.KneserNey.count(train, order=order, keys_a_part=64)
    p, uni, total = brute_kneser_ney([r.text for r in train.collect()], order)
    v = len(uni)
    pad = ("<s>",) * (order - 1)
    for context in (pad, (*pad[1:], "alpha"), ("beta", "alpha", "gamma,")[: order - 1], ("never-seen",) * (order - 1)):
        assert abs(sum(p(context, w[0]) for w in uni) + p(context, "unknown-word") - 1) < 1e-9
    want = Counter()
    for r in docs.collect():
        t = [*pad, *words_of(r.text), "</s>"]
        words = t[order - 1 :]
        base = sum(math.log10((uni[(w,)] + 1) / (total + v + 1)) for w in words)
        score = sum(math.log10(p(t[i - order + 1 : i], t[i])) for i in range(order - 1, len(t)))
        want[r.doc_id, len(words), sum(uni[(w,)] > 0 for w in words), total, round(base, 5), round(score, 5)] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in rows_of(model.score(docs)))
    assert got == want
    assert model.score(empty).count() == 0
    model.drop()
    none = lm.KneserNey.count(empty)
    assert {r["n_known"] for r in rows_of(none.score(docs))} == {0}


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


def test_fractions_of_many_runs_add_up():
    """A key of a million occurrences, one or two a run: each fraction is under half of the least part, and the sum is whole."""
    from strandwise.llm import counting

    c = 10_000_000
    for runs, each in ((400, c // 400), (2000, c // 2000)):
        parts = counting.parts_for(c, 3 * c, 1)  # as if every occurrence could be a run
        assert parts >= 2 * 3 * c
        rows = []
        for _ in range(runs):
            held = counting.Runs(2, 1, 0, parts)
            assert not list(held.add(np.array([5], np.uint64), np.array([each / c])))
            rows += list(held.close())
        _, sums = counting.merged(pa.Table.from_batches(rows), 1, 0, parts)
        assert abs(sums[0, 0] - 1) < 0.25
    one = counting.Runs(2, 1, 0, parts)
    list(one.add(np.array([5], np.uint64), np.array([1 / c])))
    (run,) = one.close()
    _, sums = counting.merged(pa.Table.from_batches([run] * 1), 1, 0, parts)
    assert 0.5 / c < sums[0, 0] < 1.5 / c  # with the least part it would be nothing
    with pytest.raises(OverflowError):
        big = counting.Runs(2, 1, 0, parts)
        list(big.add(np.array([5], np.uint64), np.array([1e12])))
        list(big.close())


def test_words_that_a_polynomial_hash_confuses(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64, whatever the base."""
    for n in (8, 64, 1024, 4096):
        assert C.hash_word(thue_morse(n, "a", "b").encode()) != C.hash_word(thue_morse(n, "b", "a").encode())
    one, other = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    df = spark.createDataFrame([(1, one), (2, other), (3, f"{one} {other} {one}")], "doc_id long, text string").coalesce(1)
    enc = packing.WordEncoder(TOKENS)
    crc = {r["doc_id"]: zlib.crc32(np.array([*enc.whole(r["text"]), 2], "<u4").tobytes()) for r in rows_of(df)}
    assert {r["doc_id"]: r["ids_crc32"] for r in rows_of(packing.pack_pieces(df, TOKENS, longest=1 << 20)) if r["length"] == r["doc_tokens"]}.items() <= crc.items()
    pieces = packing.pack_pieces(df, TOKENS, with_ids=True).orderBy("doc_id", "start").collect()
    for i, text in ((1, one), (2, other), (3, f"{one} {other} {one}")):
        assert np.array_equal(np.frombuffer(b"".join(bytes(r.ids) for r in pieces if r.doc_id == i), "<u4"), [*enc.whole(text), 2])
    model = lm.KneserNey.count(df.filter("doc_id = 1"))
    assert {r["doc_id"]: r["n_known"] for r in rows_of(model.score(df))} == {1: 2, 2: 1, 3: 3}
    scanner = licenses.LicenseScanner({"x": f"{one} a b c d e f"})
    texts = spark.createDataFrame([(1, f"{one} a b c d e f"), (2, f"{other} a b c d e f")], "doc_id long, text string")
    assert [(r["doc_id"], r["containment"]) for r in rows_of(scanner.scan(texts)) if r["containment"] == 1] == [(1, 1.0)]
    *_, word = toxicity.words_of(np.frombuffer(f"{one} {other}".encode(), np.uint8), np.array([0, 2049]))
    assert word[0] != word[1]


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(C, "token_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    enc = packing.WordEncoder(TOKENS)
    data = np.frombuffer(b"alpha gamma delta extraordinary internationally unfortunately", np.uint8)
    ids, at = enc.encode(data, np.array([0, 18, len(data)]))
    assert ids[: at[1]].tolist() == enc.whole("alpha gamma delta ").tolist() and ids[at[1] :].tolist() == enc.whole("extraordinary internationally unfortunately").tolist()


def test_media_round_trip(docs, empty):
    got = {r["doc_id"]: r for r in rows_of(media.read_media(media.store_media(docs)))}
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (max(-(-len(raw) // 576), 1) * 576 - len(raw))
        g = got[r.doc_id]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"], g["error"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), None)
        assert g["clips"][0]["first_frame"] == 0 and g["clips"][-1]["end_frame"] == len(payload) // 576
    assert media.read_media(media.store_media(empty)).count() == 0


def test_foreign_frames_and_broken_files(spark):
    x = np.random.default_rng(1).integers(0, 256, (3, 24, 24)).astype(np.uint8)
    scans, n = media.encode_frames(x)
    ends = np.cumsum(n)
    jpegs = [media.HEAD + scans.tobytes()[a:b] + media.TAIL for a, b in zip(ends - n, ends)]
    for j, frame in zip(jpegs, x):
        assert np.array_equal(media.decode_lossless(j), frame)
    at = jpegs[0].index(bytes([0xFF, media.SOF3])) + 5  # height and width
    for size, said in ((b"\xff\xff\xff\xff", "more than its scan"), (b"\0\0\0\x18", "without samples")):
        with pytest.raises(ValueError, match=said):
            media.decode_lossless(jpegs[0][:at] + size + jpegs[0][at + 4 :])
    with pytest.raises(ValueError, match="restart"):
        media.decode_lossless(jpegs[0][:2] + media._segment(media.DRI, b"\0\4") + jpegs[0][2:])
    table = media._segment(media.DHT, bytes([0, 1, *[0] * 15, 5]))
    with pytest.raises(ValueError, match="Huffman"):
        media.decode_lossless(jpegs[0][:2] + table + jpegs[0][2:])
    dark, light = np.full((24, 24), 10, np.uint8), np.full((24, 24), 200, np.uint8)
    assert media.shots([dark] * 4 + [light] * 4)[0] == [(0, 4), (4, 8)]
    df = spark.createDataFrame([(1, 0, bytearray(b"no avi")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert all(r["error"] for r in rows_of(media.read_media(df)))


def test_shots_near_each_other_are_cut():
    dark, light = np.full((24, 24), 10, np.uint8), np.full((24, 24), 200, np.uint8)
    plain = [np.full((24, 24), 16 * k, np.uint8) for k in range(12)]
    cuts = lambda frames: [a for a, _ in media.shots(frames)[0]]
    assert cuts([dark, light]) == [0, 1] and cuts([dark] * 9) == [0]
    assert cuts([dark] + [light] * 5 + [dark] * 5 + [light] * 5) == [0, 1, 6, 11]
    assert cuts(plain) == list(range(12))
    assert cuts([dark] * 3 + [light] * 2 + [dark] * 6) == [0, 3, 5]


def brute_segments(s):
    """Maximal segments by definition: recursively the best (shortest, then first) segment."""
    if not s or max(s) <= 0:
        return []
    best = max(((sum(s[i:j]), -(j - i), -i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
    _, i, j = best
    return [(a, b, v) for a, b, v in brute_segments(s[:i])] + [(i, j, sum(s[i:j]))] + [(a + j, b + j, v) for a, b, v in brute_segments(s[j:])]


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(2)
    for _ in range(200):
        s = [float(x) for x in np.round(rng.normal(-0.3, 1, 14), 3)]
        at = [k for k, x in enumerate(s) if x > 0]
        cost = np.concatenate(([0.0], np.cumsum([max(-x, 0) for x in s])))
        got = toxicity.maximal_segments([s[k] for k in at], [cost[k] for k in at], [cost[k] for k in at], 1.0)
        assert [round(x[2], 6) for x in got] == [round(v, 6) for _, _, v in brute_segments(s)]


def test_the_scan_of_segments_is_linear():
    import time

    def seconds(n):  # falling cumulative scores: every search could go back to the start
        began = time.perf_counter()
        assert len(toxicity.maximal_segments([1.0] * n, list(range(0, 3 * n, 3)), list(range(1, 3 * n, 3)), 1.0)) == n
        return time.perf_counter() - began

    seconds(1000)
    assert min(seconds(200_000) for _ in range(2)) < 4 * min(seconds(100_000) for _ in range(3)) + 0.2


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(["the", "of", "and", "stone", "river", "cloud"], 40))
        toxic = i % 6 == 0
        if toxic:
            for k in rng.integers(0, 40, 3):
                words[k] = str(rng.choice(["nastyword", "nastier", "vilething"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (0, 1), (None, 1), (9999, 0)], "doc_id long, toxic int")
    fold = C.id_mod("doc_id", 5)
    model = toxicity.ToxicPassages.fit(df, lab, fold != 0)
    got = {r["doc_id"]: r for r in rows_of(model.score(df, fold == 0))}
    assert np.mean([got[i]["predicted"] == t for i, t in labels if got[i]["held_out"]]) > 0.97
    some = next(r for r in got.values() if r["predicted"])
    text = dict(rows)[some["doc_id"]]
    assert any("nast" in text[p["start"] : p["end"]] or "vile" in text[p["start"] : p["end"]] for p in some["passages"])
    assert model.score(docs).count() == docs.count() and model.score(empty).count() == 0
    assert set(model.keep_clean(docs).columns) == set(docs.columns)
    nothing = toxicity.ToxicPassages.fit(empty, lab.limit(0), F.lit(True))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in rows_of(nothing.score(docs)))


def brute_print(text):
    w = words_of(text)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_prints(text, kinds):
    """The fingerprint and those of the same shingles under hashes that a bijection mixes."""
    w = words_of(text)
    if not w:
        return [0] * kinds

    def mix(h):
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * times & (1 << 64) - 1
        return h ^ h >> 31

    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(len(w) - 3, 1))]
    columns = [h, *([mix(x ^ k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for x in h] for k in range(1, kinds))]
    return [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own)) for own in columns]


def test_components_over_several_fingerprints(spark, docs):
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 4000, 150)]
        for _ in range(6):
            copy = list(words)
            for at in rng.integers(0, 150, rng.integers(0, 5)):
                copy[at] = "edited"
            texts.append(" ".join(copy))
    texts += [r.text for r in docs.collect() if r.text]
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    prints = [brute_prints(t, 5) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and any((a ^ b).bit_count() <= 4 for a, b in zip(prints[i], prints[j])):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert {r["doc_id"]: r["component_id"] for r in rows_of(simhash.near_components(df, prints=5))} == dict(enumerate(label))
    one = {r["doc_id"]: r["component_id"] for r in rows_of(simhash.near_components(df, prints=1))}
    assert one == {r["doc_id"]: r["component_id"] for r in rows_of(simhash.near_duplicates(df))} and len(set(label)) < len(set(one.values()))


def test_fingerprints_and_components(docs, empty):
    got = rows_of(simhash.near_duplicates(docs))
    prints = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in got}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert prints == {i: brute_print(t) for i, t in texts.items()}
    check_components({i: prints[i] for i in texts}, {r["doc_id"]: r["component_id"] for r in got})
    assert simhash.near_duplicates(empty).count() == 0
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert sorted(i for i, _ in kept if i is not None) == sorted({c for i, c in comp.items() if i is not None})
    assert len(kept) == len(set(kept))


def test_one_row_stays_of_each_component_when_ids_repeat(spark):
    rng = np.random.default_rng(12)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**6, 200))
    a, b, c, d = text(), text(), text(), text()
    near = lambda t: t.upper()
    rows = [(5, a), (5, b), (3, near(b)), (5, c), (5, near(c)), (2, d), (2, near(d)), (2, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text.lower()) for r in simhash.keep_one(df).collect()]
    assert sorted(kept) == sorted([(5, a), (3, b), (5, c), (2, d)])


def check_components(prints, component):
    ids = list(prints)
    for i in ids:  # flood fill
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in seen and (prints[x] ^ prints[y]).bit_count() <= 4:
                    seen.add(y)
                    todo.append(y)
        assert component[i] == min((x for x in seen if x is not None), default=None)


@pytest.mark.parametrize("most", [1 << 22, 2000])
def test_balls_find_every_pair(monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_VARIANTS", most)
    rng = np.random.default_rng(most)
    base = rng.integers(0, 2**63, 6).astype(np.uint64)
    fps = []
    for b in base:
        for _ in range(8):
            x = int(b)
            for k in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(k)
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    links = set()
    bits = 12
    heads = simhash._flips(bits, 2)
    for head in {int(f >> np.uint64(52)) ^ int(m) for f in fps for m in heads}:
        here = np.array([f for f in fps if (int(f >> np.uint64(52)) ^ head).bit_count() <= 2], np.uint64)
        links |= {(int(here[i]), int(here[j])) for i, j in simhash._collisions(here, head, bits, 2)}
    component = {int(f): int(f) for f in fps}
    for _ in fps:
        for a, b in links:
            assert (a ^ b).bit_count() <= 4
            component[a] = component[b] = min(component[a], component[b])
    check_components({int(f): int(f) for f in fps}, component)


def filled(tokens, ratio, budget):
    """min(1, s * ratio) with the budget's tokens, by trying how many of the largest are whole."""
    order = np.argsort(-ratio)
    for whole in range(len(order) + 1):
        rest = order[whole:]
        part = (tokens[rest] * ratio[rest]).sum()
        s = (budget - tokens[order[:whole]].sum()) / part if part else np.inf
        if not len(rest) or s * ratio[rest].max() <= 1 + 1e-12:
            return np.minimum(1, s * ratio), s
    raise AssertionError


def plain_rake(codes, tokens, goals, budget, rounds=3000):
    """Cyclic exact filling of one value after the other."""
    m = np.ones(len(tokens))
    for _ in range(rounds):
        for code, goal in zip(codes, goals):
            for v, g in enumerate(goal):
                at = np.flatnonzero(code == v)
                _, s = filled(tokens[at], m[at], g * budget)
                m[at] *= s
    return np.minimum(1, m)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.7])
def test_raking_with_a_bound_is_exact_filling(share):
    rng = np.random.default_rng(0)
    codes = [rng.integers(0, 3, 50), rng.integers(0, 4, 50), rng.integers(0, 2, 50)]
    tokens = rng.integers(1, 1000, 50).astype(float)
    goals = [np.array([0.35, 0.33, 0.32]), np.array([0.1, 0.35, 0.3, 0.25]), np.array([0.5, 0.5])]
    cells, budgets = mixing.Cells(codes, tokens, [3, 4, 2]), np.array([0.1, share]) * tokens.sum()
    by, error, drawn = mixing.rake(cells, goals, budgets, 400)
    assert error.max() < 1e-7 and np.allclose(drawn[1].sum(1), budgets)
    prob = np.minimum(1, by[0][1][codes[0]] * by[1][1][codes[1]] * by[2][1][codes[2]])
    assert np.allclose(prob, plain_rake(codes, tokens, goals, budgets[1], 400), atol=1e-6)


def test_one_law_for_any_number_of_cells(docs, empty):
    """Sums in memory and sums by jobs give the same probabilities and draws."""
    given = {"lang": {"en": 0.5}}
    a, b = ({r["doc_id"]: (round(r["prob"], 9), r["sampled"]) for r in rows_of(mixing.calibrated(docs, targets=given, strict=False, rounds=4, bound=bound))} for bound in (500_000, 1))
    assert a == b and len(a) >= 60
    assert mixing.calibrated(empty).count() == 0 and mixing.sample(docs, strict=False).columns == docs.columns


def test_goals_share_what_is_not_named():
    goal = mixing.goals_of(np.array(["a", "b", "c"], object), np.array([10.0, 10.0, 30.0]), 1.0, {"a": 0.6, "z": 0.2})
    assert np.allclose(goal, np.array([0.6, 0.05, 0.15]) / 0.8)
    assert np.allclose(mixing.goals_of(np.array(["a"], object), np.array([3.0]), 0.7, {"z": 1.0}), [1.0])


@pytest.mark.parametrize("bound", [500_000, 1])
def test_drawn_tokens_have_the_target_marginals(spark, bound):
    rows = [(s, l, t, n) for s, a in (("x", 1), ("y", 9)) for l, b in (("en", 8), ("de", 2)) for t, c in (("prose", 50), ("legal", 1)) for n in [a * b * c + (s == "x") * 3]]
    df = spark.createDataFrame(rows, "__source string, __lang string, __topic string, __tokens long")
    goals = {"source": {"x": 0.5, "y": 0.5}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"prose": 0.8, "legal": 0.2}}
    with pytest.warns(UserWarning, match="targets allow"):
        mixture = mixing.Mixture.calibrate(df, targets=goals, rounds=12, bound=bound)
    assert all(abs(goal - have) < 1e-4 for *_, goal, have in mixture.report)
    got = rows_of(mixture.join(df))
    total = sum(r["prob"] * r["__tokens"] for r in got)
    for d, goal in goals.items():
        for value, share in goal.items():
            assert abs(sum(r["prob"] * r["__tokens"] for r in got if r[f"__{d}"] == value) / total - share) < 1e-4
    assert max(r["prob"] for r in got) <= 1 + 1e-12
    # no cell can be above 1: raked shares scaled evenly draw less
    names = [sorted({r[k] for r in rows}) for k in range(3)]
    codes, tokens = [np.array([names[k].index(r[k]) for r in rows]) for k in range(3)], np.array([r[3] for r in rows], float)
    by, _, _ = mixing.rake(mixing.Cells(codes, tokens, [2, 2, 2]), [np.array([goals[d][v] for v in x]) for d, x in zip(goals, names)], np.array([1.0]), 300, bounded=False)
    ratio = by[0][0][codes[0]] * by[1][0][codes[1]] * by[2][0][codes[2]]
    assert total > 1.05 / ratio.max()


@pytest.mark.parametrize("bound", [500_000, 1])
def test_targets_that_no_probabilities_have_are_an_error(spark, bound):
    df = spark.createDataFrame([("x", "en", "prose", 90), ("y", "de", "prose", 10)], "__source string, __lang string, __topic string, __tokens long")
    with pytest.raises(ValueError, match="target is"):
        mixing.Mixture.calibrate(df, targets={"source": {"x": 0.9, "y": 0.1}, "lang": {"en": 0.2, "de": 0.8}}, bound=bound, rounds=4)


def test_columns_of_any_name_stay(spark, docs):
    """Names that the operators use themselves, as columns of the documents."""
    names = ["row", "prob", "cell_source", "cell_topic", "__source", "__tokens", "__prob", "__key", "__content", "n", "of", "fp", "component_id", "a.b", "lang_pred"]
    odd = docs.select("*", *(F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")).alias(c) for k, c in enumerate(names)))
    whole = {tuple(r) for r in odd.collect()}
    for kept in (mixing.sample(odd, strict=False), simhash.keep_one(odd)):
        assert kept.columns == odd.columns
        rows = [tuple(r) for r in kept.collect()]
        assert rows and set(rows) <= whole
    assert {r["doc_id"] for r in rows_of(simhash.keep_one(odd))} == {r["doc_id"] for r in rows_of(simhash.keep_one(docs))}


def test_sample_draws_the_target_marginals(spark):
    rows = [(i, ("licence " if i % 20 == 0 else "") + "w " * (10 + i % 7), "en", f"s{i % 2}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = rows_of(mixing.keyed(mixing.sample(df)).groupBy("__topic").agg(F.sum("__tokens").alias("t")))
    whole = rows_of(mixing.keyed(df).groupBy("__topic").agg(F.sum("__tokens").alias("t")).orderBy("__topic"))
    goal = dict(zip([r["__topic"] for r in whole], mixing.tempered(np.array([r["t"] for r in whole], float), 0.7)))
    total = sum(r["t"] for r in kept)
    assert all(abs(r["t"] / total - goal[r["__topic"]]) < 0.01 for r in kept)


def test_languages(spark, docs, empty):
    rng = np.random.default_rng(4)
    stems = {"aa": ["thing", "with", "the"], "bb": ["keit", "und", "sch"], "cc": ["ción", "que", "los"]}
    rows = [(i, " ".join(rng.choice(stems[l], 30)), l) for i in range(150) for l in [list(stems)[i % 3]]]
    df = spark.createDataFrame([*rows, (900, "keit und", None)], "doc_id long, text string, lang string")
    fold = C.id_mod("doc_id", 3)
    model = langid.OutputCodes.fit(df, fold != 1)
    got = {r["doc_id"]: r for r in rows_of(model.identify(df, fold == 1))}
    assert all(got[i]["lang_pred"] == l for i, _, l in rows) and got[900]["lang_pred"] == "bb"
    odd = {r["doc_id"]: r["lang_pred"] for r in rows_of(model.identify(docs))}
    assert [odd[k] for k in range(3)] == ["und"] * 3 and odd[10] != "und"
    assert model.keep_known(docs).count() == docs.count() - 3 and model.identify(empty).count() == 0
    assert {r["lang_pred"] for r in rows_of(langid.OutputCodes.fit(empty, F.lit(True)).identify(docs))} == {"und"}
    for k in (*range(2, 9), 300):
        code = langid.codewords(k)
        assert len({tuple(x) for x in code}) == k
    assert langid.OutputCodes.fit(df, F.lit(True)).languages == ["aa", "bb", "cc"]


def test_more_languages_than_a_block(spark):
    """No language is left out, however many there are: each of 1500 has a word of its own."""
    word = lambda k: "".join(chr(97 + (k // 26**j * 7 + 3 * j) % 26) for j in range(6))
    df = spark.createDataFrame([(k, f"{word(k)} " * 30, f"l{k:04d}") for k in range(1500)], "doc_id long, text string, lang string").repartition(6)
    model = langid.OutputCodes.fit(df, F.lit(True))
    assert len(model.languages) == len({tuple(x) for x in model.code}) == 1500
    got = rows_of(model.identify(df))
    assert np.mean([r["lang_pred"] == f"l{r['doc_id']:04d}" for r in got]) > 0.95


def test_language_stage_rejects_junk_with_letters(spark):
    import corpus_pipeline

    rng = np.random.default_rng(9)
    stems = {"aa": ["thing", "with", "the", "and", "stone", "water"], "bb": ["keit", "und", "sch", "heit", "ge", "ein"], "cc": ["ción", "que", "los", "para", "una", "del"]}
    clean = [(i, " ".join(rng.choice(stems[l], 12 + i % 20)), l) for i in range(600) for l in [list(stems)[i % 3]]]
    junk = [(1000, "".join(rng.choice(list("bcdfghjklmnpqrtvwxz"), 300)), None), (1001, "Это русский текст о погоде " * 5, None), (1002, "QZX123+/" * 40, None), (1003, "日本語のテキスト" * 10, None)]
    df = spark.createDataFrame([*clean, *junk, (1004, "12 34", "aa")], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in rows_of(corpus_pipeline.language_id(spark, df, ""))}
    assert kept == set(range(600))


def test_licenses(spark, docs, empty):
    scanner = licenses.LicenseScanner()
    rows, want = [], {}
    rng = np.random.default_rng(6)
    filler = lambda n: " ".join(rng.choice(["ba", "do", "fu", "ge", "hi"], n))
    templates = licenses.TEMPLATES | licenses.whole_texts()
    for i, (name, text) in enumerate(templates.items()):
        words = text.split()
        shown = text if len(words) < 30 else " ".join([*words[:-1], "changed"])
        rows.append((i, f"{filler(rng.integers(0, 50))} {shown.upper() if i % 2 else shown} {filler(rng.integers(0, 500))}"))
    rows += [(100, filler(300)), (101, None), (102, "Released under the MIT"), (103, "licensed under the apache something else version 2 0 ")]
    for i, text in rows:  # containment over all of the text, which holds one notice at most
        w = re.findall(r"[0-9a-z]+", (text or "").lower())
        for name, t in templates.items():
            tw = re.findall(r"[0-9a-z]+", t.lower())
            k = min(5, len(tw))
            grams = {tuple(tw[a : a + k]) for a in range(len(tw) - k + 1)}
            share = len(grams & {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}) / len(grams)
            if share >= 0.8 - 1e-9:
                want[i, name] = round(share, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): round(r["containment"], 6) for r in rows_of(scanner.scan(df))}
    assert got == want
    assert scanner.scan(docs).count() == 0 and scanner.scan(empty).count() == 0 and licenses.LicenseScanner({}).scan(df).count() == 0


def test_edited_licenses_are_found(spark):
    """Changed words, case, wrapping and comment marks; what still holds four fifths of the shingles is found."""
    rng = np.random.default_rng(11)
    scanner, rows, want, expected = licenses.LicenseScanner(), [], set(), 0
    for k, (name, text) in enumerate(licenses.whole_texts().items()):
        for share in (0.0, 0.01, 0.03):
            words = text.split()
            for at in rng.choice(len(words), int(share * len(words)), replace=False):
                words[at] = f"changed{at}"
            shown = [w.upper() if k % 2 else w for w in words]
            lines = "\n".join(" * " + " ".join(shown[i : i + 9]) for i in range(0, len(shown), 9))
            rows.append((len(rows), f"before {'x ' * k} {lines} {'behind ' * k}"))
            grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())] for i in range(len(w) - 4)}
            if len(grams(text) & grams(rows[-1][1])) / len(grams(text)) >= 0.8:
                want.add((rows[-1][0], name))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in rows_of(scanner.scan(df))}
    assert len(want) > 20 and want <= got


def test_hilbert_shards(docs, empty):
    for law in ("rows", "bytes"):
        got = rows_of(sharding.shard_rows(docs, 7, law))
        assert len(got) == docs.count()
        by = {}
        for r in got:
            by.setdefault(r["shard"], []).append(r)
        for rows in by.values():
            assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
        assert [r["hilbert"] for r in ordered] == sorted(r["hilbert"] for r in got)
        if law == "rows":
            assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    assert sharding.shard_rows(empty).count() == 0
    for d, b in ((2, 3), (3, 2), (4, 2)):
        g = np.stack(np.meshgrid(*[np.arange(1 << b)] * d, indexing="ij"), -1).reshape(-1, d)
        h = sharding.hilbert_index(g, b)
        assert sorted(h) == list(range(len(g))) and np.abs(np.diff(g[np.argsort(h)], axis=0)).sum(1).max() == 1


def brute_top_k(rows, is_query, k=5):
    """For each query row its k best (score, id), scores held within 64 bits."""
    clip = lambda x: max(min(x, 2**63 - 1), 1 - 2**63)
    out = Counter()
    for q, v in rows:
        if is_query(q):
            ranked = sorted((-clip(sum(a * b for a, b in zip(v, w))), x) for x, w in rows if x != q)[:k]
            out.update((q, n, x, -s) for n, (s, x) in enumerate(ranked, 1))
    return out


@pytest.mark.parametrize(("lists", "width"), [(2, 6), (3, 7), (2, 0)])
def test_exact_top_k(spark, monkeypatch, lists, width):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "ROUND", 2)
    rng = np.random.default_rng(8)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=width)]) for i in range(90)]
    vectors += [(100 + i, vectors[4][1]) for i in range(30)]  # ties
    vectors += [(40, [1.0, 0.0, 0.5]), (40, [0.0, 2.0]), (41, [3.0] * 9)]  # repeated ids, other lengths
    bad = [(200, None), (210, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (220, [float("nan")] * 6), (230, [float("inf")] * 6), (None, [1.0])]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>").repartition(5)
    got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(topk.exact_top_k(topk.integers(df), F.col("vec_id") % 10 == 0, lists=lists)))
    assert got == brute_top_k([(i, [math.floor(256 * x) for x in v]) for i, v in vectors], lambda q: q % 10 == 0)
    few = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<float>")
    assert len(rows_of(topk.exact_top_k(topk.integers(few), F.col("vec_id") == 0))) == 2
    assert topk.exact_top_k(topk.integers(few.limit(1)), F.lit(True)).count() == 0
    assert topk.exact_top_k(topk.integers(df.limit(0)), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_beyond_64_bits(spark):
    rows = [(0, [3e15, 1.0]), (1, [1e15, -2.0]), (2, [-1e15, 5.0]), (3, [2.0, 1.0]), (4, [1e300, 0.0]), (5, [-1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    hold = lambda x: max(min(math.floor(256 * x), 2**63 - 1), -(2**63))
    got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(topk.exact_top_k(topk.integers(df), F.lit(True))))
    assert got == brute_top_k([(i, [hold(x) for x in v]) for i, v in rows], lambda q: True)


def test_top_k_passes_over_what_norms_rule_out():
    rng = np.random.default_rng(1)
    q, x = rng.integers(-300, 300, (20, 8)), rng.integers(-3, 3, (50, 8))
    pair = topk.Block(np.arange(20), q, np.arange(100, 150), x, 2)
    i, _, _ = pair.reaching(np.full(20, 10**6))
    assert not len(i)
    whole = q @ x.T
    low = np.sort(whole, axis=1)[:, -5]
    i, j, s = pair.reaching(low)
    assert {(a, b, c) for a, b, c in zip(i.tolist(), j.tolist(), s.tolist())} == {(a, b, int(whole[a, b])) for a in range(20) for b in range(50) if whole[a, b] >= low[a]}


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = C.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = C.cut(stage(spark, docs, sf))
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    pieces = C.cut(corpus_pipeline.packing(spark, docs, sf))
    assert pieces.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, sf).count() == pieces.count()


def test_near_components_leave_two_tables(spark):
    """What kinds of fingerprints needed goes after them, and components of few edges need no broadcast."""
    from strandwise.llm import simhash
    from strandwise.operators import graph

    rows = [(k, " ".join(f"w{(k // 2 * 31 + j) % 97}" for j in range(40))) for k in range(40)]
    before = graph.kept_places()
    got = {r.doc_id: r.component_id for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), prints=4, at_once=2).collect()}
    assert len(graph.kept_places() - before) == 2
    assert len(got) == 40 and all(got[k] == got[k + 1] for k in range(0, 40, 2))
    edges = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    minima = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "c long, m long, n long")
    assert "broadcast" not in graph._with_minimum(edges, "u", minima, None)._jdf.queryExecution().optimizedPlan().toString()


def test_links_of_many_heads_are_few(spark, monkeypatch):
    """A group of near copies that meets at many heads leaves a link for each fingerprint and for roots, and kinds share one run of components."""
    from strandwise.llm import simhash

    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(62, 2, replace=False)) for _ in range(120)} | {int(x) for x in rng.integers(1 << 62, size=30)})
    prints = spark.createDataFrame([(x, k) for x in fps for k in (0, 1)], "fp long, kind int")
    links = [tuple(r) for r in simhash.ball_links(prints, kinds=2).collect()]
    thin = [tuple(r) for r in simhash._thinned(spark.createDataFrame(links, "a long, b long, kind int")).collect()]
    assert len(links) > 5 * len(thin) and len(thin) < 4 * len(fps)

    def parts(pairs):
        up = {(k, x): (k, x) for k in (0, 1) for x in fps}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b, k in pairs:
            x, y = sorted((top((k, a)), top((k, b))))
            up[y] = x
        return {x: top(x) for x in up}

    assert parts(thin) == parts(links)
    runs, own = [], simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda edges: runs.append(1) or own(edges))
    rows = [(k, " ".join(f"w{(k // 2 * 31 + j) % 97}" for j in range(40))) for k in range(12)]
    got = {r.doc_id: r.component_id for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), prints=4, at_once=2).collect()}
    assert len(runs) == 1 and all(got[k] == got[k + 1] for k in range(0, 12, 2))
