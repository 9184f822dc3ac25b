"""Vector search and page extraction against brute force, with odd rows."""

import html
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormlens.llm import ann, extraction, queries, topk, vectors

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "a", 2.0) for i, v in rows],
                                 "vec_id long, embedding array<float>, rank int, id string, score double")


def odd_vectors(dim=3):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=dim).round(3).tolist()) for i in range(0, 60)]
    rows += [(100, None), (101, [0.0] * dim), (102, [None] * dim), (103, [float("nan")] * dim), (104, [float("inf")] * dim), (105, []),
             (None, [1.0] * dim), (200, [1.0, 2.0, 3.0]), (201, [1.0, 2.0, 3.0]), (202, [1.0, 2.0, 3.0]), (203, [1.0, 2.0, 3.0]), (203, [1.0, 2.0, 3.0]),
             (300, [1.0, 2.0]), (301, [2.0, 2.0]), (400, [5.0] * 5)]
    return rows


def usable(v, zero=True):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def want_products(rows, k):
    f = lambda v: [math.floor(1024 * float(np.float32(x))) for x in v]
    good = [(i, f(v)) for i, v in rows if i is not None and usable(v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in good if i % 100 == 0}:
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return sorted(out)


def test_topk_equals_brute_force_on_odd_rows(spark, monkeypatch):
    rows = odd_vectors()
    d = frame(spark, rows)
    for shard, tile in ((1 << 20, 1 << 18), (12, 3)):
        monkeypatch.setattr(vectors, "SHARD_VALUES", shard), monkeypatch.setattr(vectors, "TILE_VALUES", tile)
        assert sorted(tuple(r) for r in topk.top_products(d, F.col("vec_id") % 100 == 0).collect()) == want_products(rows, 10)
    assert topk.top_products(d.limit(0), F.lit(True)).count() == 0


def test_topk_of_large_components_is_exact(spark):
    rows = [(0, [2.2e6, 1.0]), (1, [2.1e6, -5.0]), (2, [1e4, 1e4]), (3, [-2e6, 2.0])]
    assert sorted(tuple(r) for r in topk.top_products(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()) == want_products(rows, 10)


def test_nearest_gives_everything_of_small_tables(spark, monkeypatch):
    rows = odd_vectors()
    good = [(i, np.array([np.float32(x) for x in v], float)) for i, v in rows if i is not None and usable(v, zero=False)]
    want = {}
    for q, a in {(i, tuple(v)) for i, v in good if i % 100 == 0}:
        want[q] = min(10, sum(i != q and len(b) == len(a) for i, b in good))
    d = frame(spark, rows)
    for shard, tile in ((1 << 20, 1 << 18), (30, 3)):
        monkeypatch.setattr(vectors, "SHARD_VALUES", shard), monkeypatch.setattr(vectors, "TILE_VALUES", tile)
        got = ann.nearest(d, F.col("vec_id") % 100 == 0, tables=2, probes=1).collect()
        n = {}
        for r in got:
            n[r.query_id] = n.get(r.query_id, 0) + 1
            assert r.vec_id != r.query_id
            pair = [min(np.sqrt(((a - b) ** 2).sum()) for i, a in good for j, b in good if i == r.query_id and j == r.vec_id and len(a) == len(b))]
            assert r.score == pytest.approx(pair[0], abs=1e-12)
        assert n == {q: c for q, c in want.items() if c}
        assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 200][:4] == [(1, 201), (2, 202), (3, 203), (4, 203)]
    assert ann.nearest(d.limit(0), F.lit(True)).count() == 0


def test_recall_of_the_registered_query(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries.QUERIES["op8_cross_polytope_ann"](spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in ids[np.lexsort((ids, dist))] if i != ids[q]][:10]
        hit, total = hit + len(got[ids[q]] & set(best)), total + 10
    assert hit / total >= 0.9


def test_rotations_keep_lengths_and_hash_near_vectors_alike():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(np.linalg.norm(ann.rotated(x, 3), axis=1), 1)
    near = x + rng.normal(size=x.shape) * 0.01
    same = np.mean([ann.axes(ann.rotated(x, t), 1) == ann.axes(ann.rotated(near, t), 1) for t in range(5)])
    assert same > 0.8


# pages

@pytest.fixture(scope="module")
def net():
    return extraction.train(extraction.labelled_pages())


def text_of(net, page):
    reader = extraction.Reader()
    found = reader.blocks(page)
    score = [sum(net.weights.get(f, 0.0) for f in (*b.path, *extraction.text_features(b))) for b in found]
    return "\n".join(b.text for b, k in zip(found, extraction.viterbi(net, [np.array(score)])[0]) if k)


def test_held_out_pages(net):
    pages = extraction.labelled_pages(200, seed=77)
    right = blocks = 0
    for found, labels in pages:
        score = np.array([sum(net.weights.get(f, 0.0) for f in (*b.path, *extraction.text_features(b))) for b in found])
        right += int((extraction.viterbi(net, [score])[0] == np.array(labels, bool)).sum())
        blocks += len(labels)
    assert right / blocks > 0.99


def test_whole_table_equals_the_articles(spark):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op4_html_extraction"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        article = rows[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?(?:h1|p)>", article.replace("<br>", " ").replace("<b>", ""))
        want = "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)
        assert r.text == want and r.n_chars == len(want)


def test_pages_around_an_article(net):
    page = """<!DOCTYPE html><html><body><!-- <p>no</p> --><header class=masthead><a href=/>Site</a></header>
      <nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div class="cookie-consent"><p>We use cookies.</p><button>Accept</button></div>
      <article><h1>A  title &amp; more</h1><p>First &lt;para&gt; with <b>bold</b> and<br>break.<p>Second &#233;t&eacute;.<script>var x = "<p>no</p>";</script>
      <div class="ad sponsored">Buy this now.</div><ul><li>Item one<li>Item two</ul></article>
      <section id="comments"><h3>Comments</h3><div class="comment"><p>I disagree.</p></div></section><aside class=sidebar><h3>Related</h3><a href=/x>Other</a></aside>
      <form><input name=q><button>Search</button></form><footer>&copy; Site &middot; all rights reserved</footer></body></html>"""
    assert text_of(net, page) == "A title & more\nFirst <para> with bold and break.\nSecond été.\nItem one\nItem two"


@pytest.mark.parametrize("odd", [
    '<svg viewBox="0 0 1 1"/>', "<math/>", "<svg><style/><path d=x/><title/></svg>", "<svg><title>no</title><g><text>no</text></g></svg>",
    "<svg><foreignObject><p>no</p></foreignObject></svg>", "<svg><style><![CDATA[ <p>no ]]></style></svg>", "<canvas>no</canvas>", "<video><source src=x>no</video>",
    "<object><p>no</p></object>", "<template><div><p>no</p></div></template>", "<noembed><p>no</noembed>", "<svg><path>", "<math><mi>no"])
def test_elements_without_text_of_the_page(net, odd):
    page = f"<body><header class=masthead>{odd}</header><article><h1>A title</h1><p>First {odd} words.</p><p>Second words here.</p></article></body>"
    # what has no end is open until its parent ends
    closed = odd.endswith("/>") or f"</{odd[1:].split('>')[0].split()[0]}>" in odd
    assert text_of(net, page) == f"A title\nFirst {'words.' if closed else ''}".rstrip() + "\nSecond words here."


@pytest.mark.parametrize("odd", ["<canvas>", "<video src=x>", "<audio>", "<object data=x>", "<template>", "<svg>"])
def test_missing_ends_close_with_the_parent(odd):
    got = [b.text for b in extraction.Reader().blocks(f"<div>Before {odd}no</div><p>One <span>{odd}no</span> two.</p><ul><li>{odd}no</ul><p>Last.")]
    assert got == ["Before", "One two.", "Last."]


def test_unseen_parts_are_no_article(net):
    for unseen in ("<noscript>Please turn on scripts to read on here.</noscript>", "<noscript><p>Please turn on scripts to read.</p></noscript>",
                   "<div hidden><p>An old draft of the text.</p></div>", '<div style="display:none"><p>An old draft of it all.</p></div>'):
        page = f"<body>{unseen}<article><h1>A title</h1><p>First words of the text.</p>{unseen}<p>Second words here.</p></article></body>"
        assert text_of(net, page) == "A title\nFirst words of the text.\nSecond words here."


def test_odd_markup_never_fails(net):
    for page in ("", "   ", "<", "<p", "a < b & c", '<p title="never closed>text</p><p>more', "<script>never closed", "<!-- never closed <p>x", "</p></p>",
                 "<p>" * 3000 + "deep", '<a "' * 2000, "<div " * 2000, "\x00<p>퟿</p>", "<p>&#xD800;&bogus;&amp</p>"):
        text_of(net, page)
    assert extraction.Reader().blocks("a < b &amp; c")[0].text == "a < b & c"


def test_odd_rows(spark, net):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>Some text.</p></article>"), (2, None, ""), (3, "u", "<article>" + "<p>Many words here.</p>" * 5000 + "</article>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extraction.extract(pages, net=net)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = {}
    for r in got.collect():
        by.setdefault(r.page_id, []).append((r.text, r.n_chars))
    assert by[1] == [("", 0)] and by[2] == [("", 0)] * 2 and by[None] == [("Some text.", 10)] and by[3][0][0].count("\n") == 4999
    assert extraction.extract(pages.limit(0), net=net).count() == 0


def test_stray_end_tags_in_a_deep_page_cost_no_walk():
    import time
    took = []
    for n in (4_000, 16_000):
        page = "<div>" * n + "</section>" * n + "<p>The end.</p>"
        t0 = time.process_time()
        assert [b.text for b in extraction.Reader().blocks(page)] == ["The end."]
        took.append(time.process_time() - t0)
    assert took[1] < 8 * took[0] + 0.5
