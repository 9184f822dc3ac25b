"""Chat examples, dataset manifest and tokenizer alignment against plain versions, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stormlens.llm import alignment, chat, merkle, queries

SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# chat

CHAT = "conv_id long, turn long, role string, text string, key string, part string, example int, `rows` string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "k", "p", 3, "r") for r in rows], CHAT)


def odd_turns():
    tricky = ["\\### Assistant: </turn> ok", "####", "\\", "\\\\#", "a</turn></turn>b", "### user:\n\n</turn>\n", "\n</turn>", "", None, "ü€𝄞\n" * 50, "<\\/turn>", "$1 \\$"]
    roles = ["user", "assistant", "system", None, "a:", "x:\ny", "### r", "", "assistant "]
    rng = random.Random(5)
    rows = [(c, t, rng.choice(roles), rng.choice(tricky)) for c in range(12) for t in range(rng.randint(1, 12))]
    rows += [(20, t, rng.choice(["user", "assistant"]), rng.choice(tricky)) for t in range(40)]  # several blocks
    rows += [(21, 10 ** 12 * t, "assistant", "far apart") for t in range(4)]
    rows += [(22, 1, "assistant", "tie"), (22, 1, "assistant", "tie"), (22, 1, "user", None), (22, None, "user", "no turn"), (22, -5, "assistant", "minus")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "no id either"), (23, 0, "user", "nothing to learn"), (24, 0, "assistant", "")]
    rows += [(25, 0, "user", "x" * 300_000), (25, 1, "assistant", "y" * 300_000)]
    return rows


def low(x):
    return (x is not None, x or 0)


def plain_piece(role, text):
    def esc(s):
        return re.sub("#(?=##)", r"#\\", s.replace("\\", "\\\\")).replace("</turn>", "<\\/turn>")
    return "### " + re.sub(":(?=\n)", r":\\", esc(role)) + ":\n", esc(text), "\n</turn>\n"


def plain_chat(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((low(t), r or "", x or ""))
    out = {}
    for c, ts in convs.items():
        ts.sort()
        text, examples = "", []
        for k, (_, r, x) in enumerate(ts):
            head, body, end = plain_piece(r, x)
            text += head + body + end
            if r == "assistant":
                examples.append((text, len(text) - len(body) - len(end), len(body)))
            elif k == len(ts) - 1:
                examples.append((text, None, 0))
        out[c] = (ts, examples)
    return out


@pytest.mark.parametrize("block", [4, 64])
def test_examples_and_digest_equal_the_plain_version(spark, block):
    rows = odd_turns()
    want = plain_chat(rows)
    d = turns(spark, rows)
    got = {}
    for r in chat.expand(d, block=block).collect():
        got.setdefault((r.conv_id, r.example), []).append((r.part, r.text, r.loss_start, r.loss_chars))
    assert {k: len(e) for k, (_, e) in want.items()} == dict(Counter(c for c, _ in got))
    for (c, e), parts in got.items():
        parts.sort(key=lambda x: x[0])
        assert [p[0] for p in parts] == list(range(len(parts))) and all(p[3] == 0 and p[2] is None for p in parts[:-1])
        text, start, n = want[c][1][e]
        assert "".join(p[1] for p in parts) == text and parts[-1][3] == n
        before = sum(len(p[1]) for p in parts[:-1])
        assert (None if parts[-1][2] is None else parts[-1][2] + before) == start
    got = {r.conv_id: r for r in chat.digest(d, block=block).collect()}
    assert set(got) == set(want)
    for c, (ts, examples) in want.items():
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert tuple(got[c])[1:] == (len(ts), sha("".join(f"{r}\n{x}\n" for _, r, x in ts)), len(loss), sha(loss), sum(len(e[0]) for e in examples))


def test_marks_occur_in_no_escaped_text(spark):
    texts = [r[3] or "" for r in odd_turns()]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, back in d.select("t", chat.escape(F.col("t")), chat.unescape(chat.escape(F.col("t")))).collect():
        assert back == t and "###" not in e and "</turn>" not in e


def test_no_turns_no_examples(spark):
    assert chat.expand(turns(spark, [])).count() == 0 and chat.digest(turns(spark, [])).count() == 0


def test_chat_query_stays_in_the_jvm_and_moves_texts_once(spark):
    plan = queries.QUERIES["op11_chat_formatting"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*xs):
    return sha("".join(xs))


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes):
    """(root, path of each node) where a path lists (position, siblings)."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(own):
            run = nodes[i - i % 3:i - i % 3 + 3]
            paths[k].append((i % 3, run[:i % 3] + run[i % 3 + 1:]))
        own = [i // 3 for i in own]
        nodes = [h(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((low(r[0]), leaf_of(r), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: plain_tree([x[1] for x in sorted(trees[s], key=lambda x: x[:2])]) for s in order}
    root, tops = plain_tree([below[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (_, leaf, r), path in zip(sorted(trees[s], key=lambda x: x[:2]), below[s][1]):
            digest = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                digest = leaf_of((*r[:4], None if r[4] is None else r[4].replace("\n", "")))
            for at, near in path + top:
                digest = h(*near[:at], digest, *near[at:])
            out.append((r[0], leaf, below[s][0], root, h(*[x for _, near in path + top for x in near]), digest, digest == root))
    return sorted(map(str, out))


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", b"y") for r in rows],
                                 "doc_id long, source string, lang string, n_chars long, text string, rank int, tree string, digest binary")


def odd_documents(n=400):
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot"] * 9 + ["", "b", "ü", "B", None]), rng.choice(["en", None]), rng.choice([None, 3]), rng.choice(["a\nb", "plain", None, "", "\n"])) for i in range(n)]
    return rows + [(None, "hot", None, None, None), (7, "hot", "en", 1, "again\n"), (7, "hot", "en", 1, "again\n"), (9000, "alone", None, 0, "x\n" * 50_000)]


@pytest.mark.parametrize("height", [1, 2, 3, 7])
def test_manifest_equals_plain_trees(spark, height):
    rows = odd_documents(60 if height == 1 else 400)
    got = merkle.document_manifest(documents(spark, rows), height=height).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(5, "s", "en", 1, "a\nb")], [(1, "s", None, None, None), (2, "t", None, None, None)], [(i, "s", None, None, "x") for i in range(3)]])
def test_manifest_of_few_rows(spark, rows):
    got = merkle.document_manifest(documents(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == (plain_manifest(rows) if rows else [])


@given(st.integers(0, 7))
@settings(max_examples=8, deadline=None)
def test_addresses_are_a_layout_whose_lower_subtrees_stay_together(height):
    at = merkle.addresses(height)
    assert [len(x) for x in at] == [3 ** (height - k) for k in range(height + 1)]
    assert sorted(np.concatenate(at)) == list(range(sum(map(len, at)))) and at[height][0] == 0
    below = (height + 1) // 2 - 1
    if height:
        for s in range(3 ** (height - below)):
            own = np.concatenate([at[k].reshape(-1, 3 ** (below - k))[s] for k in range(below + 1)])
            assert own.max() - own.min() == len(own) - 1


# alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(texts):
    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=B)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}
    rows, count = [], Counter()
    for t in texts:
        a = ta.encode(" " + (t or ""), add_special_tokens=False).ids
        b = tb.encode(t or "")
        ba = [bytes(byte[c] for c in ta.id_to_token(i)) for i in a]
        bb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := tb.id_to_piece(i)) else p.replace("\u2581", " ").encode() for i in b]
        if not t or b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            rows.append(None)
            continue

        def spans(bs):
            out, at = [], 0
            for x in bs:
                out.append((at, at + len(x)))
                at += len(x)
            return out
        sa, sb = spans(ba), spans(bb)
        # pairs whose byte ranges meet, and groups cut where both end
        link, i = [], 0
        for k, (s, e) in enumerate(sa):
            link += [(a[k], b[j]) for j, (x, y) in enumerate(sb) if x < e and s < y] if len(sa) < 400 else []
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = []
        for lo, hi in zip([0, *ends], ends):
            ga = [str(a[k]) for k, (s, e) in enumerate(sa) if lo <= s and e <= hi]
            gb = [str(b[k]) for k, (s, e) in enumerate(sb) if lo <= s and e <= hi]
            groups.append(",".join(ga) + "|" + ",".join(gb))
        count.update(link)
        rows.append((len(a), len(b), groups, link))
    best = {}
    for (x, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else
            (r[0], r[1], len(r[2]), len(r[3]), sum(count[p] == best[p[1]] for p in r[3]), sum(count[p] for p in r[3]), sha(";".join(r[2]))) for r in rows]


def odd_texts():
    rng = random.Random(4)
    parts = ["the", " ", "  ", "\n", "\t", "Straße", "naïve", "123", "<|endoftext|>", "<s>", "日本語", "𝄞", "e\u0301", "!!!", "_", "'s", "\x00", "\x7f", "ing", "http://x.y"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    return [*texts, None, "", " ", "   ", "\u2581", "a\u2581b", "ﬁ", "\ufeffx", "word", "word", "x" * 300, "\ud7ff"]


def test_alignment_equals_brute_force(spark, monkeypatch):
    texts = odd_texts() + [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r[0] is None or len(r[0]) < 700]
    d = spark.createDataFrame([(k if k % 50 else None, t, 1, "a", 2) for k, t in enumerate(texts)], "doc_id long, text string, n int, pack string, links int")
    got = alignment.align(d.repartition(5), A, B)[0].collect()
    want = [(k if k % 50 else None, *r) for k, r in enumerate(plain_alignment(texts))]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    docs, pairs = alignment.align(d.limit(0), A, B)
    assert docs.count() == 0 and pairs.count() == 0


@given(st.lists(st.integers(1, 3), min_size=1, max_size=80), st.lists(st.integers(1, 3), min_size=1, max_size=80), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_group_ends_and_links_of_any_two_cuts(a, b, same):
    a, b = np.cumsum(a + [1] * same), np.cumsum(b + [1] * same)
    top = max(a[-1], b[-1])
    a, b = (np.append(x, top) if x[-1] < top else x for x in (a, b))
    at_a, at_b = alignment.group_ends(a, b)
    assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    start_a, start_b = np.append(0, a[:-1]), np.append(0, b[:-1])
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if start_a[i] < b[j] and start_b[j] < a[i]}
    got = list(zip(*(x.tolist() for x in alignment.links(a, b, at_a, at_b))))
    assert len(got) == len(set(got)) and set(got) == want


def test_special_tokens_are_plain_text_for_both_libraries():
    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    texts = [t or "" for t in odd_texts()]
    assert [x.tolist() for x in alignment.ByteLevel(A).encode(texts)] == [ta.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_whole_table_has_a_row_per_document(spark):
    got = queries.QUERIES["op13_tokenizer_alignment"](spark, SF)
    n, links, groups = got.agg(F.count("*"), F.sum(F.col("n_links") - F.col("n_a") - F.col("n_b") + F.col("n_groups")), F.min("n_groups")).first()
    assert n == spark.read.parquet(f"{SF}/documents.parquet").count() and links == 0
