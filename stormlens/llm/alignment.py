"""Alignment of two tokenizers over the same texts, and how often their tokens go together.

Token byte ends of both tokenizers rise to the same total, so the places where both end cut a text into groups.
They are found by diagonal run skipping: at the current shift between the two indexes, slices of the end arrays
of doubling length are compared, then halved to the first difference, which jumps over a stretch of one-to-one tokens
at once; an irregular group is walked token by token and gives the next shift.

A task takes its documents in packs of bounded text. Of a pack it sends each distinct token pair once, with its number
of links; corpus counts come back to the packs, so no document's tokens are shuffled.
"""

from __future__ import annotations

import json
import uuid
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stormlens.llm.common import chunks
from stormlens.session import cut

#: Bytes of text that share one table of token pairs.
PACK_BYTES = 8 << 20
#: Bytes of text that are tokenized at once.
_AT_ONCE = 1 << 20
#: How byte-level tokenizers cut a text before merging: fixed pattern of their public vocabulary.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token bytes one after the other, where each begins, and its length."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


class ByteLevel:
    """Ids and bytes of a byte-level BPE vocabulary file; special tokens in a text are plain text."""

    def __init__(self, path: str):
        import tiktoken
        with open(path) as f:
            vocab = json.load(f)
        special = {t["content"] for t in vocab["added_tokens"]}
        # bytes that print stand for themselves, the others for the characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab["model"]["vocab"].items() if t not in special}
        self.model = tiktoken.Encoding("byte-level", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes[i] = t
        self.flat, self.start, self.size = _table(self.bytes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.model.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]


class Pieces:
    """Ids and bytes of a sentence-piece model."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.flat, self.start, self.size = _table(self.bytes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.model.encode(texts, num_threads=1)]


def _get(kind, path: str):
    if path not in _loaded:
        _loaded[path] = kind(path)
    return _loaded[path]


def group_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into two rising arrays with one last value: where both hold the same end.

    Stretches of equal slices are jumped by exponential probing at the current shift; between them the smaller
    end moves on until both meet again.
    """
    # unequal last entries: no comparison needs a bound
    raw_a, raw_b = np.append(a, -1).tobytes(), np.append(b, -2).tobytes()
    la, lb = [*a.tolist(), -1], [*b.tolist(), -2]
    n, m, i, j = len(a), len(b), 0, 0
    runs = []  # first index in a, in b, and length of each stretch of common ends
    while i < n and j < m:
        x, y = la[i], lb[j]
        # an irregular group: the smaller end moves on, until both meet at a new shift
        while x != y:
            if x < y:
                i += 1
                x = la[i]
            else:
                j += 1
                y = lb[j]
        low = 1
        if la[i + 1] == lb[j + 1]:
            # slices of length low are equal, those of length high are not
            low, high = 2, 4
            while raw_a[8 * (i + low):8 * (i + high)] == raw_b[8 * (j + low):8 * (j + high)]:
                low, high = high, 2 * high
            while high - low > 1:
                mid = (low + high) // 2
                if raw_a[8 * (i + low):8 * (i + mid)] == raw_b[8 * (j + low):8 * (j + mid)]:
                    low = mid
                else:
                    high = mid
        runs += (i, j, low)
        i += low
        j += low
    first_a, first_b, length = np.array(runs, np.int64).reshape(-1, 3).T
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(first_a, length) + step, np.repeat(first_b, length) + step


def links(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token indexes (of a, of b) of every overlapping pair, group by group.

    Inside a group no two ends meet, so its links are its distinct ends: each is the end of one of the two tokens of a link.
    """
    alone_a, alone_b = np.ones(len(a), bool), np.ones(len(b), bool)
    alone_a[at_a] = alone_b[at_b] = False
    # links that end a group, that end with a token of a alone, and of b alone
    only_a, only_b = np.flatnonzero(alone_a), np.flatnonzero(alone_b)
    return (np.concatenate([at_a, only_a, np.searchsorted(a, b[only_b])]), np.concatenate([at_b, np.searchsorted(b, a[only_a]), only_b]))


def _digits(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal text of 0..top right-aligned in rows, and its length."""
    width = len(str(top))
    table = np.char.zfill(np.arange(top + 1).astype(f"S{width}"), width).view(np.uint8).reshape(-1, width)
    return table, np.fromiter((len(str(i)) for i in range(top + 1)), np.int64, top + 1)


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, digits, last_group: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(`a1,a2|b1;a3|b2,b3` of all groups, end of each group's text); groups marked in `last_group` end without a semicolon."""
    table, width = digits
    n_a, n_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
    before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    # place of each token in the text order: group by group, a before b
    place_a = np.arange(len(ids_a)) + np.repeat(before_b, n_a)
    place_b = np.arange(len(ids_b)) + np.repeat(before_a + n_a, n_b)
    n = len(ids_a) + len(ids_b)
    ids, sep = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    ends = np.cumsum(n_a + n_b) - 1
    sep[place_a[at_a]] = ord("|")
    sep[ends] = ord(";")
    wide = table.shape[1]
    cells = np.empty((n, wide + 1), np.uint8)
    cells[:, :wide], cells[:, wide] = table[ids], sep
    keep = np.empty((n, wide + 1), bool)
    keep[:, :wide] = np.arange(wide) >= (wide - width[ids])[:, None]
    keep[:, wide] = True
    keep[ends[last_group], wide] = False
    return cells[keep].tobytes(), np.cumsum(keep.sum(axis=1))[ends]


def _packed(places: np.ndarray) -> bytes:
    """Rising numbers as compressed steps."""
    return zlib.compress(np.diff(places, prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1) if len(places) else b""


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(data), np.uint8) if data else np.zeros(0, np.uint8)
    return np.cumsum(np.ascontiguousarray(steps.reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64))


class _Pack:
    """Documents and distinct token pairs of up to PACK_BYTES of text."""

    def __init__(self, name: str):
        self.name, self.rows, self.keys, self.counts, self.size = name, [], [], [], 0

    def add(self, rows: dict, keys: np.ndarray, counts: np.ndarray):
        self.rows.append(rows)
        self.keys.append(keys)
        self.counts.append(counts)

    def batches(self, schema: pa.Schema):
        if not self.rows:
            return
        key, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(self.counts), minlength=len(key)).astype(np.int64)
        at = 0
        for rows, keys in zip(self.rows, self.keys):
            own = inverse[at:at + len(keys)]
            at += len(keys)
            links = rows.pop("links")
            # a document's links as places in the pack's table of pairs, in order, so that their steps are small
            rows["links"] = pa.array([_packed(own[x]) for x in links], pa.binary())
            n = len(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.name] * n)] + [rows[f.name] if f.name in rows else pa.nulls(n, f.type) for f in list(schema)[1:]], schema=schema)
        n = len(key)
        empty = {"a": pa.array(key >> 32), "b": pa.array(key & 0xFFFFFFFF), "n": pa.array(total)}
        for lo in range(0, n, 1 << 16):
            hi = min(n, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.name] * (hi - lo))] + [empty[f.name][lo:hi] if f.name in empty else pa.nulls(hi - lo, f.type) for f in list(schema)[1:]], schema=schema)


def _tokens(tok, texts: list[str], want: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, tokens of each, whether their bytes are those wanted)."""
    got = tok.encode(texts)
    number = np.fromiter(map(len, got), np.int64, len(got))
    ids = np.concatenate([*got, np.zeros(0, np.uint32)]).astype(np.int64)
    size = tok.size[ids]
    upto = np.append(0, np.cumsum(size))
    bounds = upto[np.append(0, np.cumsum(number))]
    good = np.diff(bounds) == np.diff(off)
    data = tok.flat[np.arange(upto[-1]) + np.repeat(tok.start[ids] - upto[:-1], size)]
    for k in range(len(texts)):
        good[k] = good[k] and np.array_equal(data[bounds[k]:bounds[k + 1]], want[off[k]:off[k + 1]])
    return ids, number, good


def align_texts(texts: list[str], tok_a, tok_b) -> tuple:
    """Which texts have tokens, and of those, one after the other: ids of a and of b, tokens a text, group ends, token ends."""
    raw = [(" " + t).encode() for t in texts]
    off = np.append(0, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))))
    want = np.frombuffer(b"".join(raw), np.uint8)
    ids_a, number_a, good_a = _tokens(tok_a, texts, want, off)
    ids_b, number_b, good_b = _tokens(tok_b, texts, want, off)
    good = good_a & good_b & (np.diff(off) > 1)
    if not good.all():
        ids_a, ids_b = ids_a[np.repeat(good, number_a)], ids_b[np.repeat(good, number_b)]
        number_a, number_b = number_a[good], number_b[good]
    ends_a, ends_b = np.cumsum(tok_a.size[ids_a]), np.cumsum(tok_b.size[ids_b])
    at_a, at_b = group_ends(ends_a, ends_b)
    return good, ids_a, ids_b, number_a, number_b, at_a, at_b, ends_a, ends_b


def _align(path_a: str, path_b: str, id_type: pa.DataType, stamp: str):
    schema = pa.schema([("pack", pa.string()), ("id", id_type), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
                        ("links", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches):
        tok_a, tok_b = _get(ByteLevel, path_a), _get(Pieces, path_b)
        digits = _digits(max(len(tok_a.bytes), len(tok_b.bytes)))
        name = f"{stamp}-{TaskContext.get().partitionId()}"
        number = 0
        pack = _Pack(f"{name}-{number}")
        for batch in batches:
            for lo, hi, buf, off in chunks(batch, "text", _AT_ONCE):
                raw = buf.tobytes()
                texts = [raw[x:y].decode(errors="replace") for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
                good, ids_a, ids_b, number_a, number_b, at_a, at_b, ends_a, ends_b = align_texts(texts, tok_a, tok_b)
                upto_a = np.cumsum(number_a) - 1
                last = np.searchsorted(at_a, upto_a)  # each text ends a group
                text, ends = group_texts(ids_a, ids_b, at_a, at_b, digits, last)
                shas, start = [], 0
                for e in ends[last].tolist():
                    shas.append(sha256(text[start:e]).hexdigest())
                    start = e
                link_a, link_b = links(ends_a, ends_b, at_a, at_b)
                doc = np.searchsorted(upto_a, link_a)
                key = ids_a[link_a] << 32 | ids_b[link_b]
                distinct, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
                by_doc = np.sort(doc << 32 | inverse) & 0xFFFFFFFF
                bounds = np.append(0, np.cumsum(np.bincount(doc, minlength=len(number_a))))
                n = hi - lo

                def spread(values, fill=0):
                    out = np.full(n, fill, np.int64)
                    out[good] = values
                    return pa.array(out)

                sha_all, link_all, k = [""] * n, [np.zeros(0, np.int64)] * n, 0
                for r in np.flatnonzero(good).tolist():
                    sha_all[r], link_all[r] = shas[k], by_doc[bounds[k]:bounds[k + 1]]
                    k += 1
                pack.add({"id": batch.column(batch.schema.get_field_index("id")).slice(lo, n), "n_a": spread(number_a), "n_b": spread(number_b),
                          "n_groups": spread(np.diff(last, prepend=-1)), "groups_sha256": pa.array(sha_all), "links": link_all}, distinct, count)
                pack.size += len(buf)
                if pack.size >= PACK_BYTES:
                    yield from pack.batches(schema)
                    number += 1
                    pack = _Pack(f"{name}-{number}")
        yield from pack.batches(schema)
    return run


def _score(key, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Links of a pack's documents looked up in its table of pairs, which stands in the order of (a, b)."""
    pairs = pairs.sort_by([("a", "ascending"), ("b", "ascending")])
    total, best = pairs["total"].to_numpy(), pairs["best"].to_numpy().astype(bool)
    n_links, n_best, count_sum = [], [], []
    for x in docs["links"].to_pylist():
        at = _unpacked(x)
        n_links.append(len(at))
        n_best.append(int(best[at].sum()) if len(at) else 0)
        count_sum.append(int(total[at].sum()) if len(at) else 0)
    out = docs.select(["id", "n_a", "n_b", "n_groups"])
    for name, v in (("n_links", n_links), ("n_best", n_best), ("count_sum", count_sum)):
        out = out.append_column(name, pa.array(v, pa.int64()))
    return out.append_column("groups_sha256", docs["groups_sha256"])


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(per document, per token pair) alignment of a byte-level vocabulary file and a sentence-piece model over space + text.

    Documents: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Pairs: a, b, total (links of the pair in all
    documents) and best (no other a has more links with this b).

    Defined cases: a null or empty text, or one whose tokens of either side do not give back its bytes (as where the model
    normalises it), has zeros and ''; rows that repeat are counted each; a null id is kept; an empty table gives no rows; other
    columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType
    schema = f"pack string, id {id_type.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, a long, b long, n long"
    got = cut(rows.mapInArrow(_align(tokenizer_a, tokenizer_b, to_arrow_type(id_type), uuid.uuid4().hex[:8]), schema))
    of_pack = got.where("a is not null").select("pack", "a", "b", "n")
    total = of_pack.groupBy("a", "b").agg(F.sum("n").alias("total"))
    top = total.groupBy("b").agg(F.max("total").alias("top"))
    pairs = cut(total.join(top, "b").select("a", "b", "total", (F.col("total") == F.col("top")).alias("best")))
    known = of_pack.join(pairs, ["a", "b"]).select(F.col("pack").alias("of"), "a", "b", "total", F.col("best").cast("int").alias("best"))
    per_doc = got.where("a is null").select("pack", "id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    scored = per_doc.groupBy("pack").cogroup(known.groupBy("of")).applyInArrow(
        _score, f"id {id_type.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return scored.withColumnRenamed("id", id_col), pairs
