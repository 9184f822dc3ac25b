"""Repeated passages: relative Lempel-Ziv factors against all text that stands earlier.

Every document is both text and reference. A reference block is the stretch of words around an
anchor, a phrase that is the least of all phrases in some window; equal windows have equal anchors
at equal places, so an index of anchors finds every earlier block that a window could be copied
from. A document is then factored: each of its windows that lies on a shared anchor asks for the
first place of the same words, consecutive windows with an earlier place merge greedily into one
factor, and both ends of a factor are where the comparison of whole windows fails.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlens.llm.common import CHUNK_BYTES, binary_column, chunks, long_column, run_hashes, signed, span_hashes, starts_of, word_spans

WINDOW, PHRASE = 20, 6
#: Index rows that a task combines before it hands them on.
COMBINE = 1 << 20
_SECOND = 0xA0761D6478BD642F
_POS = np.uint64((1 << 22) - 1)


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    have, m = 1, key
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = w - have
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def _windows(h: np.ndarray, count: np.ndarray, window: int, phrase: int):
    """(window starts, their anchors' places, phrase hashes) over the words of several texts."""
    text = np.repeat(np.arange(len(count)), count)
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = run_hashes(h, phrase)
    base = 0
    anchors = []
    # places fit 22 bits in a slice; slices overlap by a window
    step = int(_POS) - window
    while base + window <= len(h):
        part = g[base:base + step + window - phrase]
        low = _least((part & ~_POS) | np.arange(len(part), dtype=np.uint64), window - phrase + 1)
        anchors.append((low[:step] & _POS).astype(np.int64) + base)
        base += step
    anchor = np.concatenate(anchors)
    start = np.flatnonzero(text[:len(h) - window + 1] == text[window - 1:])
    return start, anchor[start], g


def _words(batch, limit=CHUNK_BYTES):
    for lo, hi, buf, off in chunks(batch, "__text", limit):
        starts, ends, count = word_spans(buf, off)
        yield lo, hi, span_hashes(buf, starts, ends), count


def _local(count: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in the text) of word places."""
    first = np.concatenate([[0], np.cumsum(count)])
    text = np.searchsorted(first, at, side="right") - 1
    return text, at - first[text]


def _in_batches(cols, names, size=100_000):
    for i in range(0, len(cols[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(x[i:i + size]) for x in cols], names=names)


def _combined(held, size, most, flush):
    """Hands on what a task holds once it is large enough; returns what stays."""
    if size >= most:
        yield from flush([np.concatenate(x) for x in zip(*held)])
        held.clear()


def _anchor_rows(window: int, phrase: int):
    """Per text: its anchors. Of an anchor that the task has seen twice, one row stays to tell others
    (state 1) and the rest, known to be shared, are dealt anywhere (state 2)."""
    def flush(cols):
        h, key, doc, pos = cols
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(h)))
        state = np.zeros(len(h), np.int64)
        # back in the order of the text, which compresses better
        state[order] = np.where(np.repeat(size > 1, size), np.where(new, 1, 2), 0)
        deal = np.where(state == 2, (doc << 20) ^ pos, signed(h))
        yield from _in_batches((deal, doc, key, pos << 2 | state), ["deal", "doc", "key", "ps"])

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            key, doc = long_column(batch, "__key"), long_column(batch, "__doc")
            for lo, hi, h, count in _words(batch):
                _, anchor, g = _windows(h, count, window, phrase)
                at = np.unique(anchor)
                text, pos = _local(count, at)
                held.append((g[at], key[lo:hi][text], doc[lo:hi][text], pos))
                yield from _combined(held, sum(len(x[0]) for x in held), COMBINE, flush)
        if held:
            yield from _combined(held, COMBINE, COMBINE, flush)
    return run


def _shared_anchors(batches):
    """Rows sorted by `deal`, the anchor's hash: those of anchors with at least two places."""
    last, first_row, known = None, None, False

    def out(key, doc, pos):
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(doc), pa.array(pos.astype(np.int32))], names=["key", "doc", "pos"])

    for b in batches:
        deal, doc, key, ps = (long_column(b, c) for c in ("deal", "doc", "key", "ps"))
        n = len(deal)
        if not n:
            continue
        pos, state = ps >> 2, ps & 3
        at = starts_of({"deal": deal}, ["deal"])
        size = np.diff(np.append(at, n))
        shared = np.repeat((size > 1) | (np.maximum.reduceat(state, at) > 0), size)
        if last == deal[0]:
            shared[:size[0]] = True
            if not known:
                yield out(*(x[None] for x in first_row))
        keep = np.flatnonzero(shared)
        yield out(key[keep], doc[keep], pos[keep])
        # the last group may go on in the next batch
        last, first_row, known = deal[-1], (key[-1], doc[-1], pos[-1]), bool(shared[-1])


def _claims(window: int, phrase: int):
    """Windows on shared anchors. Of equal ones in a task the first goes on as a claim, the rest are repeats at once.

    A claim is (w1, w2 and place, document, key and 0); a run of n repeats has n instead of 0.
    """
    low = np.uint64(0xFFFFFFFF)

    def flush(cols):
        w1, w2, key, doc, pos = cols
        order = np.lexsort((pos, doc, w2, w1))
        new = starts_of({"a": w1[order], "b": w2[order]}, ["a", "b"])
        first = order[np.repeat(new, np.diff(np.append(new, len(order))))]
        claim = np.zeros(len(order), bool)
        claim[order] = (doc[order] == doc[first]) & (pos[order] == pos[first])
        c = np.flatnonzero(claim)
        rest = np.flatnonzero(~claim)
        rest = rest[np.lexsort((pos[rest], key[rest], doc[rest]))]
        k, d, p = key[rest], doc[rest], pos[rest]
        at = starts_of({"k": k, "d": d, "p": p - np.arange(len(p))}, ["k", "d", "p"])
        n = np.diff(np.append(at, len(rest)))
        yield from _in_batches((np.concatenate([signed(w1[c]), (d[at] << 20) ^ p[at]]),
                                np.concatenate([signed(w2[c] & ~low | pos[c].astype(np.uint64)), p[at]]),
                                np.concatenate([doc[c], d[at]]), np.concatenate([key[c] << 32, k[at] << 32 | n])), ["w1", "w2p", "doc", "kn"])

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            key, doc = long_column(batch, "__key"), long_column(batch, "__doc")
            lists = batch.column(batch.schema.get_field_index("places"))
            ends = np.asarray(lists.offsets)
            places = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, h, count in _words(batch):
                first = np.concatenate([[0], np.cumsum(count)])
                own = np.repeat(np.arange(hi - lo), np.diff(ends[lo:hi + 1]))
                at = places[ends[lo]:ends[hi]]
                inside = at < count[own]
                marked = np.zeros(len(h) + 1, bool)
                marked[first[own[inside]] + at[inside]] = True
                start, anchor, _ = _windows(h, count, window, phrase)
                start = start[marked[anchor]]
                text, pos = _local(count, start)
                held.append((run_hashes(h, window)[start], run_hashes(h, window, _SECOND)[start] & ~low, key[lo:hi][text], doc[lo:hi][text], pos))
                yield from _combined(held, sum(len(x[0]) for x in held), COMBINE, flush)
        if held:
            yield from _combined(held, COMBINE, COMBINE, flush)
    return run


def _repeats(batches):
    """Rows sorted by (w1, w2, doc, place): all but the first place of each window, and the runs known before."""
    before = None

    def out(key, doc, pos, n):
        cols = (key.astype(np.int32), doc, pos.astype(np.int32), n.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["key", "doc", "pos", "n"])

    for b in batches:
        w1, w2p, doc, kn = (long_column(b, c) for c in ("w1", "w2p", "doc", "kn"))
        key, n, pos, w2 = kn >> 32, kn & 0xFFFFFFFF, w2p & 0xFFFFFFFF, w2p >> 32
        run = n > 0
        yield out(key[run], doc[run], pos[run], n[run])
        w1, w2, key, doc, pos = (x[~run] for x in (w1, w2, key, doc, pos))
        if not len(w1):
            continue
        new = starts_of({"a": w1, "b": w2}, ["a", "b"])
        fd, fp = doc[new], pos[new]
        if before is not None and before[:2] == (w1[0], w2[0]):
            fd[0], fp[0] = before[2], before[3]
        g = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(w1))))
        before = (w1[-1], w2[-1], fd[-1], fp[-1])
        late = np.flatnonzero((doc != fd[g]) | (pos != fp[g]))
        yield out(key[late], doc[late], pos[late], np.ones(len(late), np.int64))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of `docs` under __c, with a key of the row's content; null ids order first."""
    return docs.select(F.xxhash64(F.col(text_col)).bitwiseAND((1 << 31) - 1).cast("int").alias("__key"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("__doc"),
                       F.col(text_col).alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("__c"))


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    phrase: int = PHRASE) -> DataFrame:
    """(__key, __doc, factors) of every document with repeated words.

    factors: array of (pos, n), n consecutive windows from word `pos`, each with an earlier equal
    (smaller id, or same id and earlier start). Words are runs of anything but ASCII white space.
    Null texts have no words; a null id is smaller than every other; rows that repeat an id count
    as one document, so equal windows at one start are no repeat of each other.
    """
    return _spans(_keyed(docs, id_col, text_col), window, phrase)


def _spans(keyed: DataFrame, window: int, phrase: int) -> DataFrame:
    n = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    anchors = keyed.select("__key", "__doc", "__text").mapInArrow(
        _anchor_rows(window, phrase), "deal long, doc long, key long, ps long")
    shared = (anchors.repartition(n, "deal").sortWithinPartitions("deal")
              .mapInArrow(_shared_anchors, "key int, doc long, pos int"))
    places = shared.groupBy("key", "doc").agg(F.collect_list("pos").alias("places"))
    probe = keyed.join(places, (F.col("__key") == F.col("key")) & (F.col("__doc") == F.col("doc")))
    # all columns, so that the later join of the texts finds the same shuffle
    claims = probe.select(*keyed.columns, "places").mapInArrow(
        _claims(window, phrase), "w1 long, w2p long, doc long, kn long")
    late = (claims.repartition(n, "w1").sortWithinPartitions("w1", F.shiftright("w2p", 32), "doc", "w2p")
            .mapInArrow(_repeats, "key int, doc long, pos int, n int"))
    return late.groupBy(F.col("key").alias("__key"), F.col("doc").alias("__doc")).agg(
        F.collect_list(F.struct("pos", "n")).alias("factors"))


def removed_words(n_words: int, pos: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Mask of the words that the factors cover."""
    edge = np.zeros(n_words + 1, np.int64)
    inside = pos + n + window - 1 <= n_words
    np.add.at(edge, pos[inside], 1)
    np.add.at(edge, pos[inside] + n[inside] + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _factors(batch):
    lists = batch.column(batch.schema.get_field_index("factors"))
    ends = np.asarray(lists.offsets)
    pos, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.values.flatten())
    null = np.asarray(lists.is_null())
    return [None if null[i] or ends[i] == ends[i + 1] else (pos[ends[i]:ends[i + 1]], n[ends[i]:ends[i + 1]]) for i in range(batch.num_rows)]


def _digest(window: int):
    def run(batches):
        for batch in batches:
            data, off = binary_column(batch, "__text")
            view = data.tobytes()
            total, removed, sha = [], [], []
            for i, f in enumerate(_factors(batch)):
                words = view[off[i]:off[i + 1]].split()
                total.append(len(words))
                if f is not None:
                    gone = removed_words(len(words), *f, window)
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                removed.append(total[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                                             names=["__id", "n_words", "n_removed", "kept_sha256"])
    return run


def _cut_texts(window: int):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            data, off = binary_column(batch, "__text")
            texts, removed = [], []
            valid = batch.column(at).is_valid().to_pylist()
            for i, f in enumerate(_factors(batch)):
                raw = data[off[i]:off[i + 1]]
                starts, _, _ = word_spans(raw, np.array([0, len(raw)]))
                gone = None if f is None else removed_words(len(starts), *f, window)
                if gone is None or not gone.any():
                    texts.append(raw.tobytes().decode() if valid[i] else None), removed.append(0)
                    continue
                # each word goes with the white space up to the next word
                edge = np.append(starts, len(raw))
                brk = np.flatnonzero(np.diff(np.concatenate([[1], gone, [1]]).astype(np.int8)))
                pieces = [raw[edge[a]:edge[b]].tobytes() for a, b in zip(brk[::2], brk[1::2])]
                texts.append(b"".join(pieces).decode().rstrip()), removed.append(int(gone.sum()))
            cols = [batch.column(j) for j in range(batch.num_columns) if batch.schema.names[j] not in ("__text", "factors")]
            names = [x for x in batch.schema.names if x not in ("__text", "factors")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=[*names, "__text", "__removed"])
    return run


def _with_factors(keyed: DataFrame, window: int, phrase: int) -> DataFrame:
    # kept words are decided on the same shuffle of the texts that the anchors are looked up on
    return keyed.join(_spans(keyed, window, phrase), ["__key", "__doc"], "left")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per row: see duplicate_spans for which words go."""
    keyed = _keyed(docs.select(id_col, text_col), id_col, text_col).select("__key", "__doc", "__text", F.col(f"__c.`{id_col}`").cast("long").alias("__id"))
    return _with_factors(keyed, window, phrase).select("__id", "__text", "factors").mapInArrow(
        _digest(window), "__id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("__id", id_col)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 phrase: int = PHRASE) -> DataFrame:
    """`docs` with repeated words cut from `text_col`; n_removed is in column __removed.

    A removed word takes along the white space after it; texts without repeats stay as they are,
    null stays null. All rows and other columns stay.
    """
    keyed = _keyed(docs, id_col, text_col)
    inner = keyed.schema["__c"].dataType.simpleString()
    got = _with_factors(keyed, window, phrase).select("__c", "__text", "factors").mapInArrow(
        _cut_texts(window), f"__c {inner}, __text string, __removed long")
    cols = [F.col("__text").alias(c) if c == text_col else F.col(f"__c.`{c}`").alias(c) for c in docs.columns]
    return got.select(*cols, "__removed")
