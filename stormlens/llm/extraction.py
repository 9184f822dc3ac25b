"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that bound blocks; all others run inside a block.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre section
select summary table tbody td tfoot th thead tr ul noscript head""".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page and no markup: it ends at their end tag only.
RAW = frozenset("script style title textarea iframe noembed xmp".split())
#: Elements whose content is markup but no text of the page; they end with their parent at the latest.
EXCLUDED = frozenset("template svg math object canvas audio video".split())
#: Of these, those in which a tag may close itself and a tag of the page ends them, except inside the second kind.
FOREIGN, _INTEGRATION = ("svg", "math"), ("foreignobject", "desc", "annotation-xml")
_BREAKOUT = BLOCKS | frozenset("b big br code em embed i img nobr ruby s small span strike strong sub sup tt u var".split())
#: A start tag that ends an open element of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",),
          "tbody": ("table",), "tfoot": ("table",)}
#: Start tags inside these end nothing outside.
_BOUND = ("object", "template", *_INTEGRATION)

#: Words of class, id and role attributes, by what they tell.
NAMES = {
    "ad": "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs",
    "side": "sidebar aside widget widgets related recommended recommendations popular trending complementary",
    "comment": "comment comments reply replies discussion disqus respond thread reviews commentlist",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe subscription signup login banner toast dialog",
    "foot": "footer foot copyright legal colophon contentinfo",
    "head": "header masthead topbar logo brand",
    "social": "share sharing social follow",
    "form": "form search searchbox contact",
    "body": "content article post entry body main story text page",
}
_GROUP = {w: g for g, words in NAMES.items() for w in words.split()}
_PHRASES = re.compile(r"cookie|subscrib|newsletter|copyright|all rights reserved|advertis|sponsored|sign in|log in|leave a (?:reply|comment)|share this", re.I)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def _attribute_features(attrs: str) -> tuple[str, ...]:
    found = {_GROUP[w] for m in _ATTR.finditer(attrs) for w in re.findall(r"[a-z]+", (m[1] or m[2] or m[3] or "").lower()) if w in _GROUP}
    return tuple(sorted([f"name:{g}" for g in found] + (["hidden"] if _HIDDEN.search(attrs) else [])))


class Reader:
    """Leaf blocks of pages: text between block boundaries, with the features of its ancestors."""

    def __init__(self):
        self._attrs: dict[str, tuple[str, ...]] = {}
        self._child: dict[tuple, tuple[str, ...]] = {}

    def _path(self, parent: tuple[str, ...], tag: str, attrs: str) -> tuple[str, ...]:
        if attrs not in self._attrs:
            if len(self._attrs) > 20_000:
                self._attrs.clear()
            self._attrs[attrs] = _attribute_features(attrs) if attrs.strip() else ()
        key = (parent, tag, self._attrs[attrs])
        if key not in self._child:
            if len(self._child) > 20_000:
                self._child.clear()
            own = [f"in:{tag}", *self._attrs[attrs]]
            self._child[key] = tuple(sorted({*(f for f in parent if not f.startswith("at:")), *own, f"at:{tag}"}))
        return self._child[key]

    def blocks(self, page: str) -> list[Block]:
        out: list[Block] = []
        stack: list[tuple[str, tuple[str, ...]]] = [("", ())]
        standing = Counter()  # tags in the stack
        parts: list[str] = []
        linked, in_link, loose, at, size = 0, False, False, 0, len(page)
        # place in the stack of the outermost excluded element that is open; inline elements open in and before it
        dark, inner, outer = 0, Counter(), Counter()

        def text(piece: str):
            nonlocal linked
            if piece and not dark:
                if "&" in piece:
                    piece = html.unescape(piece)
                parts.append(piece)
                if in_link:
                    linked += len(piece)

        def flush(path=None):
            nonlocal linked
            if parts:
                whole = " ".join("".join(parts).split())
                if whole:
                    out.append(Block(whole, stack[-1][1] if path is None else path, linked))
                parts.clear()
            linked = 0

        def drop(k):
            for gone, _ in stack[k:]:
                standing[gone] -= 1
            del stack[k:]

        def push(opened, way):
            standing[opened] += 1
            stack.append((opened, way))

        def close(tags, scope):
            # an end tag of nothing that is open costs no walk
            if not any(standing[x] for x in tags):
                return
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    drop(k)
                    return
                if stack[k][0] in scope:
                    return

        def light():
            """After a close: whether the excluded element went with it."""
            nonlocal dark
            if dark and len(stack) <= dark:
                dark = 0
                inner.clear()
            return not dark

        while at < size:
            lt = page.find("<", at)
            if lt < 0:
                text(page[at:])
                break
            text(page[at:lt])
            if dark and stack[-1][0] in FOREIGN and page.startswith("<![CDATA[", lt):
                stop = page.find("]]>", lt)
                at = stop + 3 if stop >= 0 else size
                continue
            m = None if loose else _TOKEN.match(page, lt)
            if m is None and page[lt + 1:lt + 2] not in ("", "!", "?") and (page[lt + 1].isalpha() or page[lt + 1] == "/"):
                m2 = _LOOSE.match(page, lt)
                # a quote that never ends: from here on tags end at their first bracket
                loose = loose or m2 is not None
                m = m2
            elif m is None and page[lt + 1:lt + 2] in ("!", "?"):
                m = _TOKEN.match(page, lt)
            if m is None:
                text("<")
                at = lt + 1
                continue
            at = m.end()
            if m.re is _TOKEN and m.group(2) is None:
                continue
            end, tag, attrs = m.group(1), m.group(2).lower(), m.group(3)
            foreign = stack[-1][0] in FOREIGN
            if foreign and not end and tag in _BREAKOUT:
                while len(stack) > 1 and stack[-1][0] in FOREIGN:
                    drop(len(stack) - 1)
                light()
                foreign = False
            if tag in RAW and not end and not foreign:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else size
            elif tag in EXCLUDED or tag in _INTEGRATION and dark:
                if end and standing[tag]:
                    for k in range(len(stack) - 1, dark - 1 if dark else len(stack) - 1, -1):
                        if stack[k][0] == tag:
                            drop(k)
                            light()
                            break
                elif not end and not (attrs.endswith("/") and (foreign or tag in FOREIGN)):
                    dark = dark or len(stack)
                    push(tag, stack[-1][1])
            elif tag in BLOCKS:
                # inside an excluded element, what was read before it stays open
                path = stack[dark - 1][1] if dark else None
                if not dark:
                    flush()
                was = dark
                if end:
                    close(HEADINGS if tag in HEADINGS else (tag,), ())
                elif tag not in VOID:
                    if tag in ENDS:
                        close(ENDS[tag], (*_SCOPE[tag], *_BOUND))
                    elif tag not in ("option", "optgroup", "button"):
                        close(("p",), ("td", "th", "button", "figure", "blockquote", "div", "article", "section", *_BOUND))
                if light() and was:
                    flush(path)
                if not end and tag not in VOID:
                    push(tag, stack[-1][1] if dark else self._path(stack[-1][1], tag, attrs.rstrip("/")))
            elif tag == "br" or tag in VOID:
                if not dark:
                    parts.append(" ")
            elif not end:
                if not (foreign and attrs.endswith("/")):
                    (inner if dark else outer)[tag] += 1
                if tag == "a" and not dark:
                    in_link = True
            elif dark and inner[tag]:
                inner[tag] -= 1
            elif not dark or outer[tag]:
                # the end of an inline parent ends the excluded element
                if dark:
                    drop(dark)
                    light()
                outer[tag] -= outer[tag] > 0
                if tag == "a":
                    in_link = False
        flush()
        return out


def text_features(b: Block) -> list[str]:
    words = b.text.count(" ") + 1
    share = b.linked / max(1, len(b.text))
    out = [f"words:{min(7, words.bit_length())}", f"link:{'all' if share > 0.8 else 'half' if share > 0.3 else 'some' if share > 0 else 'none'}"]
    if b.text[-1] in ".!?…:;\"”»":
        out.append("stop")
    if "©" in b.text:
        out.append("sign")
    if _PHRASES.search(b.text):
        out.append("phrase")
    return out


@dataclass
class Field:
    """Weights of features for `keep`, of the four label pairs, and of first and last labels."""

    weights: dict[str, float] = field(default_factory=dict)
    pair: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    ends: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))


def _padded(scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in scores])
    e = np.zeros((len(scores), max(1, int(n.max(initial=0)))))
    for i, s in enumerate(scores):
        e[i, :len(s)] = s
    return e, n


def viterbi(net: Field, scores: list[np.ndarray]) -> list[np.ndarray]:
    """Best label sequence of each page from its blocks' scores for `keep`."""
    e, n = _padded(scores)
    pages, steps = e.shape
    best = np.stack([np.zeros(pages), e[:, 0]], 1) + net.ends[0]
    back = np.zeros((steps, pages, 2), np.int8)
    final = best.copy()
    for t in range(1, steps):
        options = best[:, :, None] + net.pair[None]
        back[t] = options.argmax(1)
        best = options.max(1)
        best[:, 1] += e[:, t]
        final[n > t] = best[n > t]
    label = (final + net.ends[1]).argmax(1)
    got = np.zeros((steps, pages), np.int8)
    for t in range(steps - 1, -1, -1):
        inside = t < n
        got[t, inside] = label[inside]
        if t:
            label = np.where(inside, back[t, np.arange(pages), label], label)
    return [got[:n[i], i].astype(bool) for i in range(pages)]


def train(pages: list[tuple[list[Block], list[int]]], steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward and Adam; every block sequence must be labelled."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for bs, _ in pages for b in bs for f in (*b.path, *text_features(b))})
    index = {f: i for i, f in enumerate(names)}
    y, n = _padded([np.array(ys, float) for _, ys in pages])
    y = y.astype(int)
    count, longest = y.shape
    rows, cols = [], []
    for i, (bs, _) in enumerate(pages):
        for t, b in enumerate(bs):
            for f in (*b.path, *text_features(b)):
                rows.append(i * longest + t), cols.append(index[f])
    rows, cols = np.array(rows), np.array(cols)
    live = np.arange(longest)[None] < n[:, None]
    w, pair, ends = np.zeros(len(names)), np.zeros((2, 2)), np.zeros((2, 2))
    params = [w, pair, ends]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    who, last = np.arange(count), n - 1
    seen_pair = np.zeros((2, 2))
    both = live[:, 1:]
    np.add.at(seen_pair, (y[:, :-1][both], y[:, 1:][both]), 1)
    seen_ends = np.stack([np.bincount(y[:, 0], minlength=2), np.bincount(y[who, last], minlength=2)]).astype(float)
    for step in range(1, steps + 1):
        e = np.bincount(rows, w[cols], minlength=count * longest).reshape(count, longest)
        em = np.stack([np.zeros_like(e), e], 2)
        a = np.zeros((count, longest, 2))
        a[:, 0] = em[:, 0] + ends[0]
        for t in range(1, longest):
            a[:, t] = np.logaddexp(a[:, t - 1, :1] + pair[0], a[:, t - 1, 1:] + pair[1]) + em[:, t]
        b = np.zeros((count, longest, 2))
        for t in range(longest - 1, -1, -1):
            if t < longest - 1:
                nxt = em[:, t + 1] + b[:, t + 1]
                b[:, t] = np.stack([np.logaddexp(pair[s, 0] + nxt[:, 0], pair[s, 1] + nxt[:, 1]) for s in (0, 1)], 1)
            b[last == t, t] = ends[1]
        z = np.logaddexp(*(a[who, last] + ends[1]).T)
        p = np.exp(a + b - z[:, None, None]) * live[:, :, None]
        joint = np.exp(a[:, :-1, :, None] + pair + (em + b)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        grads = [(np.bincount(cols, (p[:, :, 1] - y * live).ravel()[rows], minlength=len(names))) / count + decay * w,
                 (joint.sum((0, 1)) - seen_pair) / count + decay * pair,
                 (np.stack([p[:, 0].sum(0), p[who, last].sum(0)]) - seen_ends) / count + decay * ends]
        for i, g in enumerate(grads):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            params[i] -= rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)
    return Field(dict(zip(names, w.tolist())), pair, ends)


MARK = ""


def labelled_pages(count: int = 400, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Pages made from layouts in use on the web, whose blocks are known to be article or not.

    Each page draws semantic tags or named divs, what surrounds the article, and what interrupts it.
    A mark at the start of article blocks carries the label through the reader and is then removed.
    """
    # parts that are not shown are drawn on their own, so that the rest of a page does not depend on them
    rng, other = random.Random(seed), random.Random(seed + 1)
    reader = Reader()
    syllables = "an ber co da el fi gor hen is ka lo mi nu or pa qui re sa to um va".split()

    def words(lo, hi):
        n = rng.randint(lo, hi)
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    def sentence(lo=4, hi=18):
        return words(lo, hi).capitalize() + rng.choice("....!?")

    def prose(lo=1, hi=6):
        return " ".join(sentence() for _ in range(rng.randint(lo, hi)))

    def name(group):
        return rng.choice(NAMES[group].split())

    def box(tag, group, inner):
        if rng.random() < 0.5:
            return f"<{tag}>{inner}</{tag}>"
        return f'<div {rng.choice(("class", "id"))}="{name(group)}{rng.choice(("", "-box", " left", "_1"))}">{inner}</div>'

    def links(lo=2, hi=8):
        items = [f'<a href="/{i}">{words(1, 4)}</a>' for i in range(rng.randint(lo, hi))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)

    def ad():
        return f'<div class="{name("ad")}">{rng.choice((prose(1, 3), links(1, 3), sentence()))}</div>'

    def side():
        return box("aside", "side", f"<h3>{words(1, 3)}</h3>" + rng.choice((links(), f"<p>{prose(1, 2)}</p>")))

    def notice():
        return f'<div class="{name("notice")}"><p>{rng.choice(("We use cookies. ", "Subscribe to our newsletter. ", ""))}{sentence()}</p><button>{words(1, 2)}</button></div>'

    def form():
        return f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><select><option>{words(1, 2)}<option>{words(1, 2)}</select><button>{words(1, 2)}</button></form>'

    def comments():
        inner = "".join(f'<div class="comment"><h4>{words(1, 2)}</h4><p>{prose(1, 3)}</p></div>' for _ in range(rng.randint(1, 4)))
        tag = rng.choice(("section", "div", "ol"))
        return f'<{tag} class="{name("comment")}"><h3>{words(1, 3)}</h3>{inner}{form() if rng.random() < 0.3 else ""}</{tag}>'

    def share():
        return f'<div class="{name("social")}">{links(2, 4)}</div>'

    def unseen():
        """What a browser with scripts does not show: fallback texts and hidden parts."""
        nonlocal rng
        own, rng = rng, other
        inner, line = rng.choice((sentence(), f"<p>{prose(1, 3)}</p>", f"<p>{sentence()}</p><p>{prose(1, 2)}</p>")), sentence()
        tag = rng.choice(("noscript", "noscript", "noscript", "div", "section", "p"))
        attr = rng.choice((" hidden", ' aria-hidden="true"', ' style="display:none"', ' style="display: none"')) if tag != "noscript" else ""
        rng = own
        return f"<{tag}{attr}>{line if tag == 'p' else inner}</{tag}>"

    def kept(inner):
        return MARK + inner

    def article():
        out = [f"<h1>{kept(words(3, 12))}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14, 25))):
            r = rng.random()
            body = rng.choice((sentence(1, 3), prose(), prose(2, 9), words(3, 40), words(20, 60).upper() + "."))
            if r < 0.62:
                if rng.random() < 0.25:
                    body = f"<b>{body}<br>" if rng.random() < 0.5 else f'{body} <a href="/x">{words(1, 3)}</a> {sentence()}'
                out.append(f"<p>{kept(body)}" + ("</p>" if rng.random() < 0.8 else ""))
            elif r < 0.7:
                out.append(f"<h{rng.randint(2, 4)}>{kept(words(1, 6))}</h2>")
            elif r < 0.76:
                out.append("<ul>" + "".join(f"<li>{kept(words(2, 15))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif r < 0.8:
                out.append(f"<blockquote><p>{kept(prose(1, 3))}</p></blockquote>")
            elif r < 0.83:
                out.append("<table>" + "".join(f"<tr><td>{kept(words(1, 3))}</td><td>{kept(words(1, 3))}</td></tr>" for _ in range(3)) + "</table>")
            elif r < 0.85:
                out.append(f"<figure><img src=x><figcaption>{kept(words(2, 9))}</figcaption></figure>")
            elif r < 0.87:
                out.append(f"<pre>{kept(words(2, 20))}</pre>")
            elif r < 0.9:
                out.append(f"<div>{kept(prose())}</div>")
            else:
                out.append(rng.choice((ad, side, share, notice))())
            if other.random() < 0.06:
                out.append(unseen())
        inner = "".join(out)
        kind = rng.random()
        if kind < 0.45:
            return f"<article>{inner}</article>"
        if kind < 0.6:
            return f"<main><article>{inner}</article></main>"
        if kind < 0.7:
            return f"<main>{inner}</main>"
        return f'<div class="{name("body")}">{inner}</div>' if kind < 0.93 else f"<div><div>{inner}</div></div>"

    pages = []
    for _ in range(count):
        parts = ["<head><title>x</title><style>p{}</style></head><body>"]
        if rng.random() < 0.3:
            parts.append(notice())
        if other.random() < 0.2:
            parts.append(unseen())
        if rng.random() < 0.5:
            parts.append(box("header", "head", f"<h2>{words(1, 4)}</h2>" * rng.randint(0, 1) + (links() if rng.random() < 0.5 else words(1, 6))))
        if rng.random() < 0.8:
            parts.append(box("nav", "nav", links(2, 10)))
        for part, chance in ((ad, 0.5), (side, 0.25), (form, 0.15), (ad, 0.15)):
            if rng.random() < chance:
                parts.append(part())
        whole = article()
        parts.append(whole)
        for part, chance in ((share, 0.2), (comments, 0.35), (side, 0.3), (ad, 0.3), (form, 0.15), (notice, 0.15)):
            if rng.random() < chance:
                parts.append(part())
        if other.random() < 0.15:
            parts.append(unseen())
        if rng.random() < 0.85:
            parts.append(box("footer", "foot", rng.choice(("&copy; ", "", "Copyright ")) + words(1, 4) + rng.choice(("", " &middot; " + prose(1, 3), links(1, 4)))))
        # some pages are the article alone
        got = reader.blocks(whole if other.random() < 0.05 else "".join(parts))
        labels = [int(MARK in b.text) for b in got]
        for b in got:
            b.text = " ".join(b.text.replace(MARK, "").split()) or "x"
        pages.append((got, labels))
    return pages


def _extract(net: Field):
    def run(batches):
        reader, known = Reader(), {}

        def score(b: Block) -> float:
            if b.path not in known:
                if len(known) > 50_000:
                    known.clear()
                known[b.path] = sum(net.weights.get(f, 0.0) for f in b.path)
            return known[b.path] + sum(net.weights.get(f, 0.0) for f in text_features(b))

        for batch in batches:
            pages = batch.column(1)
            texts = []
            for at in range(0, batch.num_rows, 256):
                found = [reader.blocks(p or "") for p in pages.slice(at, 256).to_pylist()]
                # pages of like length are decoded together
                order = sorted(range(len(found)), key=lambda i: len(found[i]))
                own = [""] * len(found)
                for k in range(0, len(order), 32):
                    part = order[k:k + 32]
                    kept = viterbi(net, [np.array([score(b) for b in found[i]]) for i in part])
                    for i, keep in zip(part, kept):
                        own[i] = "\n".join(b.text for b, x in zip(found[i], keep) if x)
                texts += own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["__row", "text"])
    return run


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), net: Field | None = None) -> DataFrame:
    """The `keep` columns, text and n_chars of every row.

    Blocks are labelled article or not by the field; the article's blocks are joined by one newline,
    each with its character references decoded and white space runs as one space. Null or empty
    html gives an empty text. Repeated rows stay. A page is read whole whatever its size; markup that never ends is
    read to the end of the page.
    """
    net = net or train(labelled_pages())
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), F.col(html_col).alias("__html"))
    kind = rows.schema["__row"].dataType.simpleString()
    got = rows.mapInArrow(_extract(net), f"__row {kind}, text string")
    return got.select(*[F.col(f"__row.`{c}`").alias(c) for c in keep], "text", F.length("text").cast("long").alias("n_chars"))
