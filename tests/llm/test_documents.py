"""Document operators against brute force, round trips and held-out accuracy, with odd rows."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stormlens.llm import language, licenses, mixing, packing, queries, simhash, substring, toxicity
from stormlens.llm.common import bucket_of
from tests.conftest import DATA
from tests.llm import brute

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fp int, length string, pos string, `doc` string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, src, None, "x", 1, "y", None, "z") for i, t, lang, src in rows], SCHEMA)


def odd_rows():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    long = " ".join(rng.choice(vocab) for _ in range(3000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "one", "en", None), (5, long, "de", "b"),
            (6, long + " tail", "de", "b"), (7, long, "de", "b"), (7, long, "de", "b"), (None, passage, None, "a"), (None, None, None, None),
            (8, f"start {passage} end", "en", "c"), (9, f"{passage} {passage}", "en", "c"), (10, "ÄÖ ß x y \x0b z", "de", "b"),
            (11, "123 456 !!!", "en", "c"), (12, "x" * 5000, "en", "a")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, odd_rows())


@pytest.fixture(scope="module")
def nothing(spark):
    return docs(spark, [])


# near duplicates

def test_simhash_equals_brute_force_on_odd_rows(odd):
    rows = odd_rows()
    fps = [brute.fingerprint(t) for _, t, _, _ in rows]
    want = sorted(zip([i if i is not None else -1 for i, *_ in rows], fps, [c if c is not None else -1 for c in brute.components([i for i, *_ in rows], fps)]))
    got = simhash.near_duplicates(odd).collect()
    assert sorted((r[0] if r[0] is not None else -1, r[1] % (1 << 64), r[2] if r[2] is not None else -1) for r in got) == want


def test_simhash_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fps = [brute.fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], brute.components([i for i, _ in rows], fps)))
    assert sorted(tuple(r) for r in queries.QUERIES["op3_simhash_near_dedup"](spark, SF).collect()) == want


@pytest.mark.parametrize("tile", [4, 7, 4096])
def test_links_of_dense_groups_are_complete_but_few(spark, tile):
    rng = random.Random(tile)
    fps = set()
    for center in (0, rng.getrandbits(64), (1 << 64) - 1):
        fps |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(120)}
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=tile).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    root = {f: f for f in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a, b in links:
        root[find(a)] = find(b)
    got = {}
    for f in fps:
        got.setdefault(find(f), set()).add(f)
    want = {}
    for f, c in zip(fps, brute.components(fps, fps)):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_masks_cover_every_close_pair():
    masks, rng = simhash.block_masks(), random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << x for x in rng.sample(range(64), 3))
        assert any(a & m == b & m for m in masks)


def test_keep_one(odd, nothing):
    got = simhash.keep_one(odd)
    assert got.columns == odd.columns
    rows = odd_rows()
    comp = brute.components([i for i, *_ in rows], [brute.fingerprint(t) for _, t, *_ in rows])
    want = sorted({i for (i, *_), c in zip(rows, comp) if i is not None and i == c})
    kept = [r.doc_id for r in got.collect()]
    assert sorted(x for x in kept if x is not None) == want
    assert sum(x is None for x in kept) == 2
    assert simhash.keep_one(nothing).count() == 0


# repeated passages

def brute_digest(rows, window=20):
    gone = brute.removed([(i, t) for i, t, *_ in rows], window)
    return sorted((i if i is not None else -1, *brute.digest(t, g)) for (i, t, *_), g in zip(rows, gone))


def as_rows(df):
    return sorted((r[0] if r[0] is not None else -1, *tuple(r)[1:]) for r in df.collect())


def test_substring_equals_brute_force_on_odd_rows(odd, nothing):
    assert as_rows(substring.digest(odd)) == brute_digest(odd_rows())
    assert substring.digest(nothing).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_substring_dense_repeats(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 30), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))), None, None) for _ in range(40)]
    assert as_rows(substring.digest(docs(spark, rows), window=6, phrase=3)) == brute_digest(rows, 6)


def test_substring_small_tasks_combine_alike(odd, monkeypatch):
    monkeypatch.setattr(substring, "COMBINE", 50)
    assert as_rows(substring.digest(odd)) == brute_digest(odd_rows())


def test_cut_texts_keep_the_rest_as_it_was(spark, odd):
    got = substring.drop_repeats(odd)
    assert got.columns == [*odd.columns, "__removed"]
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    passage = " ".join(f"p{i}" for i in range(60))
    assert by_id[8][0].text == "start end"  # the null id's passage is earlier
    assert by_id[9][0].text == "" and by_id[9][0]["__removed"] == 120
    assert by_id[10][0].text == "ÄÖ ß x y \x0b z" and by_id[1][0].text is None and by_id[3][0].text == " \t\n "
    assert passage in [r.text for r in by_id[None]]


def test_long_texts_are_cut_into_anchor_slices(monkeypatch):
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 62, 5000, dtype=np.uint64)
    count = np.array([1700, 0, 3300])
    start, anchor, _ = substring._windows(h, count, 20, 6)
    monkeypatch.setattr(substring, "_POS", np.uint64((1 << 9) - 1))
    start2, anchor2, _ = substring._windows(h, count, 20, 6)
    assert (start == start2).all() and len(start) == 1681 + 3281
    assert (anchor >= start).all() and (anchor <= start + 14).all() and (anchor2 >= start2).all() and (anchor2 <= start2 + 14).all()


# packing

WORDS = st.text(alphabet="aZé'ßİ́…,.!3 \x85 \t日Ñ×", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=4))
def test_word_ids_equal_whole_text_ids(texts):
    coder = packing._tokenizers.setdefault(TOKENIZER, packing.WordIds(TOKENIZER))
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, n = coder.encode(np.frombuffer(b"".join(raw), np.uint8), off)
    want = [coder.model.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


UNTOUCHED, CODER = Tokenizer.from_file(TOKENIZER), packing.WordIds(TOKENIZER)
PARTS = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "<|", "|>", "a", "Zé", "'t", "\u0301", "日", ".", "!", " ", "\n", "3"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=4))
def test_special_literals_are_ids_as_in_the_untouched_library(texts):
    raw = [t.encode() for t in texts]
    ids, n = CODER.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    want = [UNTOUCHED.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_packing_of_special_literals(spark):
    rows = [(1, "end <|endoftext|> start", "en", "a"), (2, "<|endof", "en", "a"), (3, "text|>", "en", "a"), (4, "", "en", "a"),
            (5, "a<|startoftext|>B<|endoftext|>" * 3000, "en", "a"), (6, "<|endoftext|>", "en", "a")]
    got = packing.pack_documents(docs(spark, rows), TOKENIZER).collect()
    want = sorted((i, *p) for i, t, *_ in rows for p in brute.pieces(UNTOUCHED, t))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_packing_odd_rows(odd, nothing):
    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    got = packing.pack_documents(odd, TOKENIZER).collect()
    want = sorted((i if i is not None else -1, *p) for i, t, *_ in odd_rows() for p in brute.pieces(tok, t))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    total = sum(r.length for r in got)
    assert brute.check_packed([(r.sequence_id, r.offset, r.length) for r in got]) <= -(-total // 4096) + 1
    assert packing.pack_documents(nothing, TOKENIZER).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_plans_hold_the_histogram_exactly(h):
    found = packing.plan(h, 64)
    held = {}
    for config, n in found:
        assert sum(config) <= 64 and n > 0
        for l in config:
            held[l] = held.get(l, 0) + n
    assert held == h
    # no worse than first fit is guaranteed to be, against what no packing can go below
    least = max(-(-sum(l * n for l, n in h.items()) // 64), sum(n for l, n in h.items() if l > 32))
    assert sum(n for _, n in found) <= 1.7 * least + 1


def test_plan_is_near_the_bound():
    rng = random.Random(0)
    h = {}
    for _ in range(20000):
        l = min(4096, int(rng.lognormvariate(6.5, 1.1)) + 1)
        h[l] = h.get(l, 0) + 1
    n = sum(c for _, c in packing.plan(h))
    assert n <= 1.003 * sum(l * c for l, c in h.items()) / 4096 + 1


def test_hot_length_is_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 50)
    items = spark.range(1000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, 40).otherwise(F.col("id") % 100 + 1).cast("long").alias("length"))
    got = packing.pack(items, ["i"], capacity=128).collect()
    assert len(got) == 1000
    assert brute.check_packed([(r.sequence_id, r.offset, r.length) for r in got], 128) <= sum(r.length for r in got) / 128 * 1.03 + 1


# mixing

def test_mixing_equals_brute_force(spark, odd, nothing, monkeypatch):
    rows = [(i, s) for i, _, _, s in odd_rows()]
    want = sorted((str(i), str(s), n) for (i, s), n in zip(rows, brute.copies(rows)) if n)
    for limit in (mixing.BROADCAST_SOURCES, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
        got = mixing.mix(odd)
        first = got.where("__copy = 0").select("doc_id", "source", "__copies").collect()
        assert sorted((str(r[0]), str(r[1]), r[2]) for r in first) == want
        assert got.count() == sum(w[2] for w in want)
        assert got.columns[:len(odd.columns)] == odd.columns
    assert mixing.mix(nothing).count() == 0


@pytest.mark.parametrize("rate", [1e-3, 0.7, 12.0, 800.0, 40_000.0])
def test_poisson_inversion(rate):
    k0, cdf = mixing.poisson_cdf(rate)
    assert all(a <= b for a, b in zip(cdf, cdf[1:])) and cdf[-1] == pytest.approx(1)
    u = (np.arange(20000) + 0.5) / 20000
    k = k0 + np.searchsorted(cdf, u, side="right")
    assert k.mean() == pytest.approx(rate, rel=0.01) and k.var() == pytest.approx(rate, rel=0.05)
    if rate < 100:
        p = [math.exp(-rate + i * math.log(rate) - math.lgamma(i + 1)) for i in range(60)]
        assert np.allclose(np.diff([0, *cdf])[:60], p[:len(cdf)])


def test_given_weights(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise(F.when(F.col("id") % 3 == 1, "b").otherwise("c")).alias("source"))
    n = {r[0]: r[1] for r in mixing.mix(d, weights={"a": 3.0, "b": 1.0}).groupBy("source").count().collect()}
    assert set(n) == {"a", "b"} and n["a"] / n["b"] == pytest.approx(3, rel=0.15) and sum(n.values()) == pytest.approx(6000, rel=0.05)


# language

def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.QUERIES["op1_language_id"](spark, d).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and len(held) > 150 and all(0 <= r.score <= 1 for r in got)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.98


def test_language_odd_rows(spark, odd, nothing):
    net = language.learn(odd, bucket_of("doc_id", 4) != 2)
    got = {}
    for r in language.identify_ids(odd, net, {"doc_id": F.col("doc_id")}).collect():
        got.setdefault(r.doc_id, (r.lang_pred, r.score))
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 11)) and got[5][0] in net.labels
    assert language.learn(nothing, F.lit(True)).labels == []
    none = language.identify(odd, language.learn(nothing, F.lit(True)))
    assert {r.lang_pred for r in none.collect()} == {"und"} and none.count() == odd.count()
    assert language.identify(nothing, net).count() == 0


def test_folded_network_is_the_network():
    net = language.train([b"aaa bbb ccc ddd"] * 20 + [b"xyz zyx xxy yyz"] * 20, ["a"] * 20 + ["b"] * 20)
    x = language.windows_of(b"aaa bxyz" * 90)
    assert np.allclose(language.Folded(net).pooled(x), net.maxima(x)[0], atol=1e-5)
    assert len(language.windows_of(b"")) == 1 and len(language.windows_of(b"q" * 257)) == 2


# toxicity

def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = queries.QUERIES["op5_toxicity"](spark, d).where("held_out").collect()
    held = [(truth[r.doc_id], r.predicted) for r in got if r.doc_id in truth]
    assert sum(p for t, p in held if t == 1) / sum(t == 1 for t, _ in held) > 0.8
    assert sum(p for t, p in held if t == 0) / sum(t == 0 for t, _ in held) < 0.01


def test_toxicity_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 0), (5, 1), (5, None), (None, 1), (6, 0), (6, 0), (8, 1)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels, F.lit(True))
    got = toxicity.score(odd, model, {"doc_id": F.col("doc_id")}).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    empty = toxicity.learn(nothing, labels.limit(0), F.lit(True))
    assert all(r.predicted == 0 for r in toxicity.score(odd, empty, {"doc_id": F.col("doc_id")}).collect())
    assert toxicity.score(nothing, model, {"doc_id": F.col("doc_id")}).count() == 0


def test_every_text_gives_pairs_and_whole_texts_are_learned_from():
    assert len(toxicity.counterfactuals("One day. Some women sang.\nThe end.")) == 5 and toxicity.counterfactuals("") == []
    (a, b), *_ = toxicity.counterfactuals("x " * 30_000 + "the gay man")
    assert a.endswith("the gay man") and b.endswith("the straight girl")
    only_a, only_b = toxicity.pair_features("the muslim boy", "the jewish boy")
    assert len(only_a) and len(only_b) and not set(only_a) & set(toxicity.presence("the boy"))


def test_swapped_identity_terms_do_not_move_the_score(spark):
    rng = random.Random(1)
    calm = "the garden grows well and many birds sing near river".split()
    texts, labels = [], []
    for i in range(900):
        w = [rng.choice(calm) for _ in range(15)]
        t = int(i % 3 == 0)
        if t:
            w.insert(3, rng.choice(["idiot", "scum", "trash"]))
        if rng.random() < (0.6 if t else 0.05):
            w.insert(5, rng.choice(["muslims", "jews", "women"]))
        texts.append(" ".join(w)), labels.append(t)

    def score(model, s):
        b = np.frombuffer(s.encode(), np.uint8)
        return float(toxicity.Scorer(model).score(b, np.array([0, len(b)]))[0])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    y = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    fair, plain = toxicity.learn(d, y, F.lit(True)), toxicity.learn(d, y, F.lit(True), fairness=0.0)
    neutral, none = "the garden and muslims sing well", "the garden and people sing well"
    assert score(plain, neutral) > 1.5 * score(plain, none)
    assert score(fair, neutral) < 1.1 * score(fair, none)
    assert score(fair, "scum in the garden") > 0.9


# licenses

def whole_alignment(t, x):
    """Best local alignment without a band: (score, matched)."""
    best, above = (0, 0), [(0, 0)] * (len(x) + 1)
    for a in t:
        row = [(0, 0)]
        for j, b in enumerate(x):
            s, m = above[j]
            cell = max((s + 2, m + 1) if a == b else (s - 1, m), (above[j + 1][0] - 1, above[j + 1][1]), (row[j][0] - 1, row[j][1]), (0, 0))
            row.append(cell)
            best = max(best, cell)
        above = row
    return best


def test_license_alignment_equals_full_alignment(spark):
    rng = random.Random(2)
    index = licenses.index_of()
    rows, want = [], []
    for i, (name, variant) in enumerate(index.names):
        text = licenses.TEMPLATES[name][variant].split()
        for k in range(4):
            w = list(text)
            for _ in range(k if len(w) > 12 else 0):
                p = rng.randrange(len(w))
                w[p:p + 1] = rng.choice(([], ["foo"], [w[p], "bar"]))
            pad = [f"q{rng.randrange(50)}" for _ in range(rng.randrange(30))]
            rows.append((4 * i + k, " ".join(pad + w + pad[::-1]), "en", "s"))
            want.append(name)
    got = {}
    for r in licenses.scan(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for (i, text, *_), name in zip(rows, want):
        assert len(got[i]) == 1 and got[i][0].license == name
        r = got[i][0]
        raw = text.encode()
        h = licenses.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()
        t = index.words[index.names.index((r.license, r.variant))].tolist()
        assert r.matched_words == whole_alignment(t, h)[1]
        assert r.coverage == pytest.approx(r.matched_words / len(t))
        span = raw[r.start_byte:r.end_byte]
        assert len(licenses.words_of(np.frombuffer(span, np.uint8), np.array([0, len(span)]))[0]) == r.end_word - r.start_word


def test_license_whole_table(spark):
    plain = {"Apache-2.0": "licensed under the apache license, version 2.0", "MIT": "released under the mit license",
             "CC-BY-NC-4.0": "licensed under cc by-nc 4.0", "All-Rights-Reserved": "all rights reserved"}
    text = {r.doc_id: r.text.lower() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.QUERIES["op10_license_scan"](spark, DATA).collect()
    for name, p in plain.items():
        assert {r.doc_id for r in got if r.license == name} == {i for i, t in text.items() if p in t}


def test_license_odd_rows(odd, nothing, spark):
    assert licenses.scan(odd).count() == 0 and licenses.scan(nothing).count() == 0
    twice = docs(spark, [(1, "All rights reserved. All rights reserved.", None, None), (1, "All rights reserved. All rights reserved.", None, None), (None, "all RIGHTS reserved", None, None)])
    assert sorted((str(r.doc_id), r.start_word) for r in licenses.scan(twice).collect()) == [("1", 0), ("1", 0), ("1", 3), ("1", 3), ("None", 0)]
    assert licenses.scan(twice, templates={}).count() == 0
