"""The queries at their contracts, blocks of text, and learned operators and the pipeline's stages against plain versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandwise.llm import common as C
from strandwise.llm import langid, licenses, lm, media, mixing, packing, queries, simhash, toxicity
from tests.llm.test_llm import ODD, TOKENS, brute_print, brute_prints, brute_segments, rows_of

SMALL = "/root/testdata/sf0.001"
#: The columns that each query gives first.
CONTRACT = {
    "op1_pack_binary_pieces": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2_kneser_ney_scores": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_avi_shots": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op4_toxic_segments": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_simhash_balls": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_output_code_languages": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_hilbert_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10_uniform_threshold": "query_id bigint, rank int, vec_id bigint, score bigint",
}


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in C.table(spark, SMALL, "documents").collect()}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(spark, documents, name):
    df = queries.QUERIES[name](spark, SMALL)
    shape = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields]
    assert shape[: len(CONTRACT[name].split(", "))] == CONTRACT[name].split(", ")
    rows = df.collect()
    mod = lambda i, m: zlib.crc32(str(i).encode()) % m
    if name != "op10_uniform_threshold":
        assert {r.doc_id for r in rows} == set(documents)
    if name.startswith("op1_"):
        last = defaultdict(int)
        for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
            assert r.start == last[r.doc_id] and r.offset == 0 and 0 < r.length <= 4096
            last[r.doc_id] += r.length
        assert all(last[r.doc_id] == r.doc_tokens for r in rows)
    elif name.startswith("op2_"):
        train = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text or "")) for i, d in documents.items() if mod(i, 7) != 2]
        counts = Counter(w for t in train for w in t)
        total = sum(counts.values()) + len(train)
        for r in rows:
            words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), documents[r.doc_id].text or ""))
            assert r.held_out == (mod(r.doc_id, 7) == 2) and r.train_tokens == total
            assert (r.n_tokens, r.n_known) == (len(words) + 1, sum(counts[w] > 0 for w in words) + 1)
            base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 2)) for w in words) + math.log10((len(train) + 1) / (total + len(counts) + 2))
            assert r.base_score == pytest.approx(base, rel=1e-9)
    elif name.startswith(("op4_", "op7_")):
        m, held = (5, 0) if name.startswith("op4_") else (3, 1)
        assert all(r.held_out == (mod(r.doc_id, m) == held) and 0 <= r.score <= 1 for r in rows) and len(rows) == len(documents)
        if m == 5:
            assert all(r.predicted == (r.score >= 0.5) for r in rows)
        else:
            known = [(r.lang_pred, documents[r.doc_id].lang) for r in rows if r.held_out and documents[r.doc_id].lang and r.lang_pred != "und"]
            assert np.mean([a == b for a, b in known]) > 0.95
    elif name.startswith("op5_"):
        assert all(int(r.fingerprint, 16) == brute_print(documents[r.doc_id].text) and len(r.fingerprint) == 16 for r in rows)
    elif name.startswith("op9_"):
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 40
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_blocks_of_text_change_nothing():
    """Every reader of blocks gives the same for one block, for blocks of some rows, and for a row that is longer than a block."""
    rng = np.random.default_rng(7)
    texts = [*ODD, *(" ".join(rng.choice(["alpha", "Beta", "the", "licensed", "x" * 40, "über"], rng.integers(0, 90))) for _ in range(40)), None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    model = langid.OutputCodes(["a", "b"], langid.codewords(2), rng.normal(size=(1 << 13, 1)).astype(np.float32), np.ones(1), 13, 12.0, 0.2)
    scanner, enc = licenses.LicenseScanner(), packing.WordEncoder(TOKENS)

    def ids(data, offs):
        found, at = enc.encode(data, offs)
        return [found[a:b].tolist() for a, b in zip(at[:-1], at[1:])]

    def grams(data, offs):
        g = lm.Grams(data, offs, 3)
        upto = np.cumsum(g.n)
        return [tuple(g.levels[k][g.real][b - n : b].tolist() for k in range(3)) for n, b in zip(g.n, upto)]

    readers = {
        "prints": lambda d, o: simhash.fingerprints_of(d, o).tolist(),
        "ids": ids,
        "grams": grams,
        "languages": lambda d, o: [tuple(np.round(x, 5)) for x in zip(*model.predict(d, o))],
        "licenses": lambda d, o: [[x[1:] for x in scanner.matches(d, o) if x[0] == row] for row in range(len(o) - 1)],
        "words": lambda d, o: np.diff(toxicity.words_of(d, o)[2]).tolist(),
    }
    for name, read in readers.items():
        whole = [x for *_, d, o in C.text_blocks(batch) for x in read(d, o)]
        assert len(whole) == len(texts)
        for limit in (1, 100, 3000):
            assert [x for *_, d, o in C.text_blocks(batch, limit=limit) for x in read(d, o)] == whole, name


def test_a_text_longer_than_a_block(spark):
    text = " ".join(f"w{k % 9973}" for k in range(800_000))
    assert len(text) > 2 * C.BLOCK_BYTES
    df = spark.createDataFrame([(1, text), (2, "short"), (3, text)], "doc_id long, text string")
    pieces = rows_of(packing.pack_pieces(df, TOKENS))
    n = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert n[1] == n[3] == sum(r["length"] for r in pieces if r["doc_id"] == 1) > 800_000
    found = {r["doc_id"]: r for r in rows_of(simhash.near_duplicates(df))}
    assert found[3]["component_id"] == 1 and found[1]["fp"] == found[3]["fp"]
    read = {r["doc_id"]: r for r in rows_of(media.read_media(media.store_media(df)))}
    assert read[1]["n_bytes"] == len(text) and read[1]["payload_sha256"] == read[3]["payload_sha256"] and read[1]["error"] is None


def test_toxic_features_and_statistics_by_hand(spark):
    rng = np.random.default_rng(13)
    words = ["stone", "river", "clouds", "nastyword", "nastier", "nastiest", "viletalk", "the"]
    rows = [(i, " ".join(rng.choice(words[:3] + words[7:], 25)) + (" " + " ".join(rng.choice(words[3:7], 3)) if i % 5 == 0 else "")) for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.ToxicPassages.fit(df, lab, F.lit(True))
    held = {r.doc_id for r in df.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4).alias("h")).collect() if r.h}
    counted = [(t.split(), i % 5 == 0) for i, t in rows if i not in held]
    ones, zeros = (sum(len(w) for w, x in counted if x == y) for y in (True, False))
    share = min(max((ones + 0.5) / (ones + zeros + 5), 1e-6), 1 - 1e-6)
    centre, odds = math.log(share / (1 - share)), [{}, {}, {}]
    forms = lambda w: (w[:4] if len(w) > 4 else None, w[:5] if len(w) > 5 else None, w)

    def value(w, upto=3):
        out = 0.0
        for level in range(upto):
            out = odds[level].get(forms(w)[level], out)
        return out

    for level in range(3):
        seen = defaultdict(lambda: [0, 0, 0])
        for w, x in counted:
            for token in w:
                if form := forms(token)[level]:
                    seen[form][0 if x else 1] += 1
                    seen[form][2] += round(1000 * value(token, level))
        made = {}
        for form, (a, b, parents) in seen.items():
            parent = parents / 1000 / (a + b)
            q = (a + 20 / (1 + math.exp(-(parent + centre)))) / (a + b + 20)
            if abs(math.log(q / (1 - q)) - centre - parent) > 0.5:
                made[form] = math.log(q / (1 - q)) - centre
        odds[level] = made
    got = {r["doc_id"]: r for r in rows_of(model.score(df))}
    for i, text in rows:
        s = [value(w) - model.drift for w in text.split()]
        level = math.log(model.constant * len(s))
        excess = [model.scale * v - level for *_, v in brute_segments(s) if model.scale * v > level]
        assert got[i]["statistic"] == pytest.approx(sum(excess), abs=1e-3)
        assert sorted(p["excess"] for p in got[i]["passages"]) == pytest.approx(sorted(excess), abs=1e-3)
        a, b = model.curve
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-(a + b * math.log1p(got[i]["statistic"])))), rel=1e-9)
    model.drop()


def test_output_codes_by_hand(spark):
    rng = np.random.default_rng(14)
    stems = {"aa": ["thing", "with", "the"], "bb": ["keit", "und", "sch"], "cc": ["ción", "que", "los"], "dd": ["ough", "eigh"]}
    rows = [(i, " ".join(rng.choice([*stems[l], "mixed"], 12)), l) for i in range(80) for l in [list(stems)[i % 4]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.OutputCodes.fit(df, F.lit(True))
    bins = lambda t: [int(b) for b in langid.trigram_bins(np.frombuffer(t.encode(), np.uint8), 13) if b >= 0]
    n = np.full((4, 1 << 13), 0.5)
    for _, t, l in rows:
        np.add.at(n[sorted(stems).index(l)], bins(t), 1)
    p = n / n.sum(1, keepdims=True)
    code = langid.codewords(4)
    weights = np.stack([np.log(p[code[:, b] > 0].mean(0)) - np.log(p[code[:, b] < 0].mean(0)) for b in range(code.shape[1])], 1)
    trust = np.array([max((code[:, b] * (p @ weights[:, b])).min(), 0.01) for b in range(code.shape[1])])
    trust /= trust.mean()
    got = {r["doc_id"]: r for r in rows_of(model.identify(df))}
    for i, t, _ in rows:
        margin = 12.0 * weights[bins(t)].sum(0) / len(bins(t))
        loss = [sum(w * math.log1p(math.exp(-c * m)) for w, c, m in zip(trust, word, margin)) for word in code]
        like = np.exp(min(loss) - np.array(loss))
        assert got[i]["lang_pred"] == sorted(stems)[int(np.argmin(loss))]
        assert got[i]["score"] == pytest.approx(like.max() / like.sum(), abs=1e-4)


def test_stages_keep_what_their_operators_say(spark):
    docs = C.table(spark, SMALL, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.ToxicPassages.fit(docs, C.table(spark, SMALL, "labels"), F.lit(True))
    clean = {r["doc_id"] for r in rows_of(model.score(docs)) if not r["predicted"]}
    kept = C.cut(corpus_pipeline.toxicity(spark, docs, SMALL))
    assert {r.doc_id for r in kept.collect()} == clean
    known = C.cut(corpus_pipeline.language_id(spark, kept, SMALL))
    prints = {r.doc_id: brute_prints(r.text, corpus_pipeline.PRINTS) for r in known.collect()}
    assert set(prints) <= clean and len(prints) > 0.9 * len(clean)
    group = {i: i for i in prints}
    for i in sorted(prints):  # the least id that is reachable
        for j in sorted(prints):
            if group[i] != group[j] and any((a ^ b).bit_count() <= 4 for a, b in zip(prints[i], prints[j])):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    once = C.cut(corpus_pipeline.near_duplicates(spark, known, SMALL))
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(group.values()))
    mixture = mixing.Mixture.calibrate(mixing.keyed(once), targets=corpus_pipeline.TARGETS, strict=False)
    prob = {tuple(r[f"cell_{d}"] for d in mixing.DIMS): r["prob"] for r in rows_of(mixture.cells)}
    cells = {r.id: (tuple(r[f"__{d}"] for d in mixing.DIMS), r.u) for r in mixing.keyed(once).select(F.col("row.doc_id").alias("id"), *(f"__{d}" for d in mixing.DIMS), mixing.draw(F.col("row.doc_id")).alias("u")).collect()}
    drawn = {r.doc_id for r in corpus_pipeline.mixing(spark, once, SMALL).collect()}
    assert drawn == {i for i, (cell, u) in cells.items() if u < prob[cell]} and drawn <= set(rows)
