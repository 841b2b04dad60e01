import hashlib
import math
import random
import zlib

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from taperline.llm import bpe, chat_format, components, decontaminate, license_scan, lm_score, quality_rules, queries, sharding, simhash, suffix_dedup, toxicity

ODD = [
    (1, "a b c d a b c e\nx\nx\n", "en"), (2, "", "en"), (3, None, None), (None, "only null id here", "de"), (4, "same text twice " * 30, "en"), (5, "same text twice " * 30, "en"),
    (5, "same text twice " * 30, "en"), (6, "\t\n \x0b", "en"), (7, "é日本 # $ 😀 <b>\n\n" * 3, "en"), (8, "w " * 30000, "fr"), (None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, white and very long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, lang, "s", 0, "x", 1.0, 2) for i, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double, fp int").cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def rows(data):
    return pq.read_table(f"{data}/documents.parquet").to_pylist()


# --- quality rules


def test_quality_features_and_base(spark, data, rows):
    got = {r["doc_id"]: r for r in queries.op1_quality_rules(spark, data).collect()}
    assert len(got) == len(rows)
    for r in rows:
        n, chars, symbols, dup, rep = brute.features(r["text"])
        x = got[r["doc_id"]]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert x["base_failed"] == (n < 50 or 100 * rep > 50 * n) and not (x["base_failed"] and x["kept"])


def test_binomial_and_cutoffs():
    for k, n, p in [(0, 10, 0.1), (3, 50, 0.05), (20, 40, 0.5), (49, 50, 0.9), (5, 5, 0.2), (0, 2000, 0.01)]:
        assert quality_rules.binomial_cdf(k, n, p) == pytest.approx(brute.binomial_cdf(k, n, p), rel=1e-9)
    good, bad = np.zeros(201), np.zeros(201)
    got = quality_rules.certified_step(np.array([0, 1, 0, 30, 0]), 1000, 0.01, 0.01)
    assert got == (2, pytest.approx(brute.binomial_cdf(1, 1000, 0.01)))
    assert quality_rules.certified_step(np.zeros(5), 20, 0.01, 0.01) == (-1, 1.0)  # too few for a proof


def test_quality_limit_holds_and_rules_bite(spark):
    random.seed(3)
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    texts = [" ".join(word() for _ in range(60)) for _ in range(4000)] + [" ".join(word() + "%%%%" for _ in range(60)) for _ in range(200)]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 4000)) for i in range(4200)], "doc_id long, quality int")
    got = quality_rules.quality_rules(d, labels).collect()
    assert sum(not r["kept"] for r in got if r["doc_id"] < 4000) <= 0.05 * 4000
    assert not any(r["kept"] for r in got if r["doc_id"] >= 4000)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = quality_rules.quality_rules(odd, labels).collect()
    assert len(got) == len(ODD)
    assert all(r["base_failed"] for r in got if r["n_words"] == 0)
    assert quality_rules.quality_rules(none, labels.limit(0)).count() == 0
    assert quality_rules.quality_rules(odd, labels.limit(0)).where("kept = base_failed").count() == 0


# --- chat


def test_chat_query_reads_back(spark, data):
    rows = sorted(pq.read_table(f"{data}/conversations.parquet").to_pylist(), key=lambda r: (r["conv_id"], r["turn"]))
    rows += [{"conv_id": -7, "turn": k, "role": r, "text": queries.CONTROL_TEXT} for k, r in enumerate(("user", "assistant"))]
    got = {r["conv_id"]: r for r in queries.op2_chat_format(spark, data).collect()}
    assert set(got) == {r["conv_id"] for r in rows}
    for c, x in got.items():
        own = [r for r in rows if r["conv_id"] == c]
        loss = "".join(r["text"] or "" for r in own if r["role"] == "assistant")
        assert x["n_turns"] == len(own) and x["loss_chars"] == len(loss) and x["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert x["turns_sha256"] == hashlib.sha256("".join(f"{r['role']}\n{r['text'] or ''}\n" for r in own).encode()).hexdigest()


def test_chat_events_fold(spark):
    ev = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", "he"), (1, 3, "delta", 2, None, "llo"), (1, 4, "edit", 1, None, "hey"), (1, 5, "message", 3, "user", "more"),
        (1, 6, "regenerate", 2, None, ""), (1, 7, "delta", 2, None, "new "), (1, 8, "delta", 2, None, "one"), (2, 1, None, 1, "assistant", None), (None, 1, "message", 1, None, "x"),
    ]
    log = spark.createDataFrame(ev, "conv_id long, seq long, op string, message long, role string, text string")
    got = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in chat_format.fold_events(log).collect()}
    assert got == {(1, 1): ("user", "hey"), (1, 2): ("assistant", "new one"), (2, 1): ("assistant", ""), (None, 1): (None, "x")}
    assert chat_format.chat_format(log.limit(0)).count() == 0


NASTY = ["\\", "</turn>", "\n</turn>\n", "### user\n", "\\### x\\", "", "a\\\n</turn>", "\\\\</turn>\\", "### ### ", "é😀\n"]


def test_chat_escapes_round_trip(spark):
    rows = [(c, t, r, x) for c, (r, x) in enumerate((r, x) for r in ("user", "assistant", "od d\n### /%") for x in NASTY) for t in (0, 0)]
    done = chat_format.chat_format(chat_format.messages_from_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for r in done.select("conv_id", chat_format.parse(F.col("formatted")).alias("t"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).collect():
        own = [x for x in rows if x[0] == r["conv_id"]]
        assert [(x["role"], x["text"]) for x in r["t"]] == [(x[2], x[3]) for x in own]
        assert r["m"] == "".join(x[3] for x in own if x[2] == "assistant")


# --- SimHash


def test_simhash_query(spark, data, rows):
    got = {r["doc_id"]: r for r in queries.op3_simhash(spark, data).collect()}
    fps = [brute.fingerprint(r["text"]) for r in rows]
    root = brute.groups(fps, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    for i, r in enumerate(rows):
        assert got[r["doc_id"]]["fingerprint"] == f"{fps[i]:016x}"
        assert got[r["doc_id"]]["component_id"] == min(rows[k]["doc_id"] for k in range(len(rows)) if root[k] == root[i])


@pytest.mark.parametrize(("segments", "distance"), [(3, 4), (2, 4), (4, 3), (5, 4)])
def test_links_join_all_within_distance(spark, segments, distance):
    random.seed(segments)
    base = [random.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << k for k in random.sample(range(64), random.randint(0, 6))) for b in base for _ in range(12)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    tied = {r["node"]: r["component"] for r in components.components(simhash.near_links(df, distance, segments)).collect()}
    root = brute.groups(fps, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= distance)
    want = {}
    for i, r in enumerate(root):
        want.setdefault(r, []).append(signed[i])
    assert sorted(sorted(v) for v in want.values() if len(v) > 1) == sorted(sorted(k for k, c in tied.items() if c == x) for x in set(tied.values()))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 5), (140, 100)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 141)) and 200 not in got


def test_simhash_odd(odd, none):
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["fp"] == 0} == {2}
    kept = simhash.keep_one_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 4, 7, 8]
    assert simhash.simhash_groups(none).count() == 0 and simhash.keep_one_each(none).count() == 0


# --- suffix arrays


def check_suffix(df, texts, length, keep, **kw):
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(df, length, keep, **kw).collect()}
    raws = [(t or "").encode() for _, t in texts]
    for (i, _), raw, flags in zip(texts, raws, brute.repeated(raws, length, keep)):
        assert bytes(got[i]["kept"]) == bytes(b for b, f in zip(raw, flags) if not f), i
        assert sum(x["end"] - x["begin"] for x in got[i]["spans"]) == sum(flags)


@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize("hot", [50_000, 2])
def test_suffix_against_brute_force(spark, keep, hot):
    random.seed(5)
    piece = lambda n, a="ab é": "".join(random.choices(a, k=n))
    shared = [piece(90, "abcdefgh "), piece(150, "abcdefgh "), "xy" * 100]
    texts = [(i, "".join(random.choice([piece(random.randint(0, 60), "qrstuv é"), random.choice(shared), random.choice(shared)[5:70]]) for _ in range(random.randint(0, 6)))) for i in range(40)]
    texts += [(100, None), (101, ""), (102, texts[3][1]), (103, "z" * 900), (104, "z" * 59), (105, "z" * 60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    check_suffix(df, texts, 60, keep, hot_pieces=hot)


def test_suffix_query(spark, data, rows):
    got = {r["doc_id"]: r for r in queries.op4_suffix_dedup(spark, data).collect()}
    raws = [(r["text"] or "").encode() for r in rows]
    for r, raw, flags in zip(rows, raws, brute.repeated(raws, 200, "none")):
        x = got[r["doc_id"]]
        runs = sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))
        kept = hashlib.sha256(bytes(b for b, f in zip(raw, flags) if not f)).hexdigest()
        assert (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) == (len(raw), sum(flags), runs, kept)


def test_suffix_odd(odd, none):
    got = suffix_dedup.suffix_dedup(odd, 200)
    assert set(odd.columns) < set(got.columns) and got.count() == len(ODD)
    same = [len(r["kept"]) for r in got.where("doc_id in (4, 5)").collect()]
    assert sorted(same)[:2] == [0, 0] and sorted(same)[2] < 480
    assert suffix_dedup.suffix_dedup(none).count() == 0
    cut = suffix_dedup.suffix_dedup(odd, characters=True).select("text", "spans", "kept").collect()
    assert all(r["kept"] == (r["text"] or "") for r in cut if not r["spans"]) and any(r["spans"] for r in cut)
    raw = "aé日b".encode()
    assert [suffix_dedup.whole_characters(raw, *x) for x in ((1, 6), (2, 6), (2, 5), (0, 2), (4, 5), (0, 7))] == [(1, 6), (3, 6), (3, 3), (0, 1), (5, 5), (0, 7)]


def test_smaller_neighbours():
    place = np.random.default_rng(0).permutation(200)
    before, after = suffix_dedup.smaller_neighbours(place)
    for i in range(200):
        assert before[i] == max((j for j in range(i) if place[j] < place[i]), default=-1)
        assert after[i] == min((j for j in range(i + 1, 200) if place[j] < place[i]), default=200)


# --- toxicity


def brute_segments(x):
    best = []

    def scan(lo, hi):
        if lo >= hi:
            return
        s = max(((sum(x[i:j]), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)))
        if s[0] > 1e-12:
            best.append((s[2], s[3], s[0]))
            scan(lo, s[2])
            scan(s[3], hi)

    scan(0, len(x))
    return sorted(best)


def test_segments_are_all_maximal():
    random.seed(2)
    for _ in range(60):
        x = [random.choice([0, 0, 1.5, 2.25, -1.75, 0.5]) for _ in range(25)]
        got = toxicity.segments([(i, s) for i, s in enumerate(x) if s], 0.3125, len(x))
        want = brute_segments([s - 0.3125 for s in x])
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want))
        assert max((s for *_, s in got), default=0) == pytest.approx(max((s for *_, s in want), default=0))


def test_toxicity_held_out(spark, data):
    sf = data.replace("sf0.001", "sf0.1")
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, sf).collect()}
    labels = pq.read_table(f"{sf}/labels.parquet").to_pylist()
    held = [(got[r["doc_id"]], r["toxic"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
    assert sum(r["predicted"] == t for r, t in held) / len(held) > 0.93
    assert sum(r["predicted"] for r, t in held if t) / sum(t for _, t in held) > 0.7


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(odd, labels)
    got = toxicity.score_toxicity(odd, model)
    assert got.count() == len(ODD) and got.where("score < 0 or score >= 0.5").isEmpty()
    assert toxicity.score_toxicity(none, model).count() == 0


# --- byte-pair encoding


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_bpe_same_as_library(spark, data, rows, library):
    got = {r["doc_id"]: r for r in queries.op6_bpe(spark, data).collect()}
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        x = got[r["doc_id"]]
        assert x["n_tokens"] == len(ids) and x["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_texts(library):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    made = bpe.MergeAutomaton.load(queries.vocabulary())

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n\t'abceht<|>\x1c\x85​日😀"))), max_size=40))
    def same(text):
        ids = bpe.unpacked(made.encode(text))
        assert ids == library.encode(text, add_special_tokens=False).ids and made.decode(made.encode(text)) == library.decode(ids, skip_special_tokens=False)

    same()
    for text in ("<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "=" * 300, "don't 've", "a" * 1000, " " * 200 + "x"):
        assert bpe.unpacked(made.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_bpe_odd_rows(odd, none):
    path = queries.vocabulary()
    got = bpe.bpe_decode(bpe.bpe_encode(odd, path), path)
    assert got.where("decoded != coalesce(text, '')").isEmpty() and got.count() == len(ODD)
    assert got.where("text is null and n_tokens != 0").isEmpty()
    assert bpe.bpe_encode(none, path, decode=True).count() == 0


# --- sharding


def test_sharding_query(spark, data):
    sf = data.replace("sf0.001", "sf0.1")
    got = queries.op7_sharding(spark, sf).toPandas()
    by = got.groupby("shard")
    size = by["size"].sum()
    assert sorted(size.index) == list(range(24)) and size.max() < 1.05 * size.mean() and size.min() > 0.95 * size.mean()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in by)
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    assert len(got) == len(texts)
    for r in got.itertuples():
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert got.groupby(got.doc_id.map(texts)).shard.nunique().max() == 1


def test_sharding_odd(odd, none):
    got = sharding.shard_documents(odd, shards=3).toPandas()
    assert len(got) == len(ODD) and all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert sharding.shard_documents(odd, target_bytes=20_000).agg(F.countDistinct("shard")).first()[0] > 1
    assert sharding.shard_documents(none, shards=3).count() == 0
    with pytest.raises(ValueError, match="either"):
        sharding.shard_documents(odd)


def test_sharding_splits_a_group_no_shard_can_hold(spark):
    d = spark.createDataFrame([(i, "x" * 100 if i < 600 else f"{i} " * 20, "en", "s") for i in range(900)], "doc_id long, text string, lang string, source string")
    size = sharding.shard_documents(d, shards=8).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()["b"]
    assert len(size) == 8 and size.max() < 1.35 * size.mean()


# --- licences


def test_license_examples(spark):
    texts = [
        "Licensed under the Apache License,  Version 2.0.", "word. Released under the MIT License.\nword", "You may not use this file except in compliance with the License. x\nDistributed under the License is distributed on an \"AS IS\" basis.",
        "distributed under the License is distributed on an AS IS BASIS. You may not use this file except in compliance with the License.", "This work is licensed under the GNU General Public License, version 3.",
        "Redistribution and use in source and binary forms. ok. Used to endorse or promote products derived from this software.", "a license", "", None, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["licenses"]) for r in license_scan.license_scan(d).collect()}
    names = [got[i][0] for i in range(len(texts))]
    assert names == ["Apache-2.0", "MIT", "Apache-2.0", None, "GPL-3.0", "BSD-3-Clause", None, None, None, "MIT"]
    assert got[9][1] == ["MIT", "CC-BY-NC-4.0"]


def test_license_odd(odd, none):
    got = license_scan.license_scan(odd)
    assert got.count() == len(ODD) and got.where("n_sentences != 0 or license is not null").isEmpty() and license_scan.license_scan(none).count() == 0


# --- language model


def test_lm_query(spark, data, rows):
    from collections import Counter

    got = {r["doc_id"]: r for r in queries.op9_lm_score(spark, data).collect()}
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in rows}
    tokens = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b" "] for r in rows}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        x = got[i]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert x["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
    out = [got[i] for i in held if held[i]]
    assert sum(x["score"] for x in out) > sum(x["base_score"] for x in out)


def brute_lm(rows, fold):
    """{id: log10 of P}, and P(word | context); counts and weights by plain dictionaries."""
    from collections import Counter, defaultdict

    texts = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    count = lambda ids: (Counter(w for i in ids for w in texts[i]), Counter(p for i in ids for p in zip([0, *texts[i]], texts[i])), Counter(a for i in ids for a in [0, *texts[i][:-1]]))
    kept, every = count([i for i in texts if fold(i) > 1]), count([i for i in texts if fold(i) > 0])
    deleted = [w for i in texts if fold(i) == 1 for w in texts[i]]
    unknown = min(0.5, (sum(w not in kept[0] for w in deleted) + 1) / (len(deleted) + 2)) if every[0] else 1.0
    share = lambda w, c: (1 - unknown) * c[0][w] / sum(c[0].values()) if c[0][w] else unknown
    bins = defaultdict(list)
    for i in texts:
        if fold(i) == 1:
            for a, w in zip([0, *texts[i]], texts[i]):
                if kept[2][a]:
                    r = kept[1][a, w] / kept[2][a] / share(w, kept)
                    bins[int(math.log2(kept[2][a])), math.floor(20 * math.log(r)) if r else None].append(r)
    groups = defaultdict(list)
    for (b, _), rs in bins.items():
        groups[b].append((len(rs), sum(rs) / len(rs)))
    learned = lm_score.em_weights(groups)

    def p(w, a):
        lam = learned.get(int(math.log2(every[2][a])), 0.0) if every[2][a] else 0.0
        return lam * (every[1][a, w] / every[2][a] if every[2][a] else 0) + (1 - lam) * share(w, every)

    return {i: sum(math.log10(p(w, a)) for a, w in zip([0, *t], t)) for i, t in texts.items()}, p, set(every[0])


def test_lm_against_brute_force(spark, data, rows):
    got = {r["doc_id"]: r["score"] for r in queries.op9_lm_score(spark, data).collect()}
    want, p, known = brute_lm([(r["doc_id"], r["text"]) for r in rows], lambda i: zlib.crc32(str(i).encode()) % 10)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-9)
    for a in (0, b"das", sorted(w for w in known if w)[7], b"never-seen-before"):
        assert sum(p(w, a) for w in [*known, "some unknown word"]) == pytest.approx(1, abs=1e-9)


def test_lm_is_a_distribution(spark):
    """Over all next words (known ones, the end and the unknown) after a context the operator's own probabilities add up to 1."""
    random.seed(4)
    train = [(i, " ".join(random.choices("a b c d e f g".split(), [30, 20, 10, 5, 3, 1, 1], k=30))) for i in range(60)]
    words = ["a", "b", "c", "d", "e", "f", "g", "unseen"]
    # "ctx w" less "w"'s own end is P(ctx) P(w | ctx): P(end | w) comes from "ctx w w" and "ctx w"
    texts = {c + w: " ".join([*c, w]) for c in ("", "a", "f", "ag") for w in words} | {c: " ".join(c) for c in ("", "a", "f", "ag")}
    ask = [(1000 + k, t) for k, t in enumerate(texts.values())]
    d = spark.createDataFrame(train + ask, "doc_id long, text string")
    fold = lambda i: 0 if i >= 1000 else i % 5 + 1
    got = {r["doc_id"]: r["score"] for r in lm_score.lm_score(d, F.when(F.col("doc_id") >= 1000, 0).otherwise(F.col("doc_id") % 5 + 1)).collect()}
    want, p, _ = brute_lm(train + ask, fold)
    at = {k: 10 ** got[1000 + n] for n, k in enumerate(texts)}
    for c in ("a", "f"):
        end = p(None, c.encode())
        reach = at[c] / end  # P(c)
        assert sum(at[c + w] / p(None, w.encode()) for w in words) / reach + end == pytest.approx(1, abs=1e-9)
    assert lm_score.em_weights({0: [(10, 5.0), (1, 0.0)], 1: []})[0] > 0.8


def test_lm_tokens_and_counts():
    import numpy as np

    texts = [b"The  cat\tTHE\ncat", b"", b" \r\n ", b"x" * 50 + b" y\x0b" + "\u00e9\u3000z".encode()]
    keys, sizes = lm_score.token_keys(texts)
    assert sizes.tolist() == [5, 1, 1, 4] and keys[0] == keys[2] and keys[1] == keys[3] and (keys == lm_score.END).sum() == 4
    old, lm_score.BLOCK = lm_score.BLOCK, 16
    try:
        assert (lm_score.token_keys(texts)[0] == keys).all()
    finally:
        lm_score.BLOCK = old
    n = np.array([0, 1, 254, 255, 256, 70_000, 3, 1 << 40])
    assert (lm_score.counts_of(lm_score.packed_counts(n)) == n).all()


def test_lm_odd(odd, none):
    got = lm_score.lm_score(odd, F.when(F.col("doc_id") == 1, 0).otherwise(F.col("doc_id") % 3 + 1))
    assert got.count() == len(ODD) and got.where("n_tokens < 1 or score >= 0 or isnan(score)").isEmpty()
    assert lm_score.lm_score(none, F.lit(1)).count() == 0
    assert lm_score.lm_score(odd, F.lit(0)).where("n_known != 0 or score > 0").isEmpty()


# --- decontamination


def test_leaks_against_brute_force(spark):
    random.seed(8)
    word = lambda: random.choice([f"w{i}" for i in range(400)])
    items = [(i, " ".join(word() for _ in range(random.choice([9, 20, 40])))) for i in range(15)] + [(90, None), (91, ""), (92, "too few")]
    docs, leaked = [], set()
    for d in range(80):
        body = [word() for _ in range(random.randint(0, 120))]
        if d % 4 == 0:
            i, text = random.choice(items[:15])
            copy = text.split()
            for k in range(4, len(copy), 11 if d % 8 else 10_000):
                copy[k] = "swapped"
            body[len(body) // 2 : len(body) // 2] = copy
            leaked.add(d)
        docs.append((d, " ".join(body).upper() if d % 3 == 0 else "\n ".join(body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_overlaps(df, bench).collect()}
    low = lambda t: (t or "").lower().split()
    for d, text in docs:
        for i, item in items:
            a, b = low(text), low(item)
            best = max((brute.best_stretch(a[max(k, 0) : k + len(b)], b[max(-k, 0) :])[1] for k in range(-len(b) + 1, len(a))), default=0) if len(b) >= 8 else 0
            assert ((d, i) in got) == (len(b) >= 8 and best >= min(13, len(b))), (d, i, best)
    assert {d for d, _ in got} == {d for d in leaked if any(k == d for k, _ in got)} and len(got) >= 10
    assert {r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()} == set(range(80)) - {d for d, _ in got}


def test_leaks_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, "same text twice same text twice same text"), (2, None)], "item_id long, text string")
    kept = decontaminate.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3
    assert decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.find_overlaps(odd, bench.limit(0)).count() == 0
