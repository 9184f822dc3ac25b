"""Best-fit packing: a configuration linear program over the length histogram, rounded.

Documents become token pieces of at most `CAPACITY` tokens; pieces are packed into sequences of that
capacity. Only the histogram of lengths (at most CAPACITY entries) is planned on the driver; the
plan has one line per slot of a configuration, a number that does not grow with the pieces, and
pieces find their place by their rank among those of equal length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormlens.llm.common import LOWER, chunks, long_column, span_hashes, word_spans
from stormlens.session import cut

CAPACITY, END_ID = 4096, 1
#: Rounds of multiplicative weights, and how strongly over-covered lengths lose value.
PHASES, LEARNING = 8, 0.5
#: Words whose ids a worker remembers.
REMEMBERED = 1_000_000
#: Words encoded at once.
_AT_ONCE = 8192
#: Pieces of one length that are ranked in one group; a more frequent length is dealt over several.
RANK_GROUP = 200
_CHUNK = 1 << 20


def _class(chars: bytes) -> np.ndarray:
    x = np.zeros(256, bool)
    x[list(chars)] = True
    return x


_TAIL = _class(rb"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~""")
_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)))
_tokenizers: dict[str, "WordIds"] = {}


class WordIds:
    """Token ids of texts, word by word: a tokenizer that drops white space and cuts words from
    trailing punctuation gives the same ids for the parts as for the whole.

    Literals of the tokenizer's special tokens are one id each, also inside a word, as the library
    has it; texts are cut at them first.
    """

    def __init__(self, path: str):
        # Spark's tasks are the parallel unit; threads of their own would only hold memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        added = self.model.get_added_tokens_decoder()
        if odd := [t.content for t in added.values() if not t.special or t.normalized or t.single_word or t.lstrip or t.rstrip]:
            raise ValueError(f"added tokens that are not matched literally: {odd}")
        self.special = {t.content.encode(): i for i, t in added.items()}
        # the longest literal counts where several begin
        self._literal = re.compile(b"|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) or rb"(?!)")
        # words come here without literals, but lowered: <|ENDOFTEXT|> is no special token
        self.model.encode_special_tokens = True
        self._forget()

    def _forget(self):
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _units(self, buf, off):
        """Words without their ASCII tails, and the tails; ASCII letters lowered where that is safe."""
        s, e, per_text = word_spans(buf, off)
        low = LOWER[buf]
        odd = (buf >= 0xC0) & (buf != 0xC3)
        if odd.any():  # lowering before composing accents may change other scripts
            word = np.flatnonzero(np.add.reduceat(odd, s, dtype=np.int64)) if len(s) else s
            for w in word:
                low[s[w]:e[w]] = buf[s[w]:e[w]]
        core = e.copy()
        for _ in range(4):
            core -= (core > s + 1) & _TAIL[buf[core - 1]]
        last, before = buf[core - 1], buf[np.maximum(core - 2, 0)]
        letter = _LETTER[last] | ((last >= 0x80) & (last != 0x97) & (last != 0xB7) & (before == 0xC3) & (core - 2 >= s))
        two = letter & (core < e)
        core[~two] = e[~two]
        first = np.cumsum(1 + two) - (1 + two)
        starts = np.empty(len(s) + int(two.sum()), np.int64)
        ends = np.empty_like(starts)
        starts[first], ends[first] = s, core
        starts[first[two] + 1], ends[first[two] + 1] = core[two], e[two]
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        unit_at = np.append(first, len(starts))[bounds]
        return low, starts, ends, unit_at

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids per text)."""
        raw = buf.tobytes()
        if not self._literal.search(raw):
            return self._plain(buf, off)
        found = [m for a, b in zip(off[:-1].tolist(), off[1:].tolist()) for m in self._literal.finditer(raw, a, b)]
        edges = np.array([m.span() for m in found], np.int64).reshape(-1, 2)
        bounds = np.sort(np.concatenate([off, edges.ravel()]))
        ids, n = self._plain(buf, bounds)
        literal = np.isin(bounds[:-1], edges[:, 0]) & (np.diff(bounds) > 0)
        count = np.where(literal, 1, n)
        own = np.repeat(literal, count)
        out = np.empty(len(own), np.uint32)
        out[own], out[~own] = [self.special[m[0]] for m in found], ids[np.repeat(~literal, n)]
        return out, np.diff(np.append(0, np.cumsum(count))[np.searchsorted(bounds, off)])

    def _plain(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`encode` for texts that hold no special token."""
        low, s, e, unit_at = self._units(buf, off)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        u, one, inv = np.unique(span_hashes(low, s, e), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, u)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == u[known]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > REMEMBERED:
                self._forget()
                new = np.arange(len(u))
            raw = low.tobytes()
            spans = list(zip(s[one[new]].tolist(), e[one[new]].tolist()))
            got = []
            for k in range(0, len(spans), _AT_ONCE):
                words = [raw[a:b].decode(errors="replace") for a, b in spans[k:k + _AT_ONCE]]
                got += [np.array(x.ids, np.uint32) for x in self.model.encode_batch_fast(words, add_special_tokens=False)]
            n = np.fromiter(map(len, got), np.int64, len(got))
            where = np.searchsorted(self.keys, u[new])
            self.keys = np.insert(self.keys, where, u[new])
            self.at = np.insert(self.at, where, len(self.flat) + np.cumsum(n) - n)
            self.n = np.insert(self.n, where, n)
            self.flat = np.concatenate([self.flat, *got])
        at = np.searchsorted(self.keys, u)
        n = self.n[at][inv]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[at][inv] - (ends - n), n) + np.arange(ends[-1])]
        total = np.append(0, ends)[unit_at]
        return ids, np.diff(total)


def _pieces(path: str, capacity: int, end_id: int):
    names = ["__id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        if path not in _tokenizers:
            _tokenizers[path] = WordIds(path)
        coder = _tokenizers[path]
        for batch in batches:
            ids_col = batch.column(0)
            for lo, hi, buf, off in chunks(batch, "__text", _CHUNK):
                ids, count = coder.encode(buf, off)
                at, rows, piece, start, length, crc = 0, [], [], [], [], []
                for i, n in enumerate(count.tolist()):
                    own = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for p, s in enumerate(range(0, n + 1, capacity)):
                        part = own[s:s + capacity]
                        rows.append(lo + i), piece.append(p), start.append(s), length.append(len(part))
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([ids_col.take(pa.array(rows)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=names)
    return run


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the token ids of each row and `end_id`, cut where they exceed `capacity`.

    Null and empty texts are the end id alone. Repeated rows and null ids are packed like others.
    """
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(
        _pieces(tokenizer, capacity, end_id), f"__id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    ).withColumnRenamed("__id", id_col)


def _knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best value, first item) for each capacity: unbounded knapsack over lengths 1..capacity, 0 where nothing is worth it."""
    best, item = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(value[1:capacity + 1] > 0) + 1
    worth = value[lengths]
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(lengths, c, side="right"))
        best[c], item[c] = best[c - 1], -1
        if k:
            v = worth[:k] + best[c - lengths[:k]]
            j = int(v.argmax())
            if v[j] > best[c]:
                best[c], item[c] = v[j], lengths[j]
    return best, item


def _completion(item: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        got = int(item[room])
        if got > 0:
            out.append(got)
            room -= got
        else:
            room -= 1
    return out


def configurations(count: np.ndarray, capacity: int = CAPACITY, phases: int = PHASES, rate: float = LEARNING) -> dict[tuple[int, ...], float]:
    """Fractional solution of the configuration program: how often each configuration is used.

    Each phase covers an equal share of the histogram. Lengths are taken from the largest; one that
    is not covered yet opens its share of sequences and the knapsack fills the rest at current
    values. Lengths covered beyond their share lose value by a multiplicative step, so that later
    phases spend on others.
    """
    need = count.astype(float) / phases
    length = np.arange(capacity + 1, dtype=float)
    value, covered = np.where(count > 0, length, 0.0), np.zeros(capacity + 1)
    x: dict[tuple[int, ...], float] = defaultdict(float)
    for t in range(1, phases + 1):
        _, item = _knapsack(value, capacity)
        goal = need * t
        for l in np.flatnonzero(count)[::-1].tolist():
            short = goal[l] - covered[l]
            if short <= 1e-9:
                continue
            fill = _completion(item, capacity - l)
            many = 1 + fill.count(l)
            amount = short / many
            x[tuple(sorted([l, *fill], reverse=True))] += amount
            covered[l] += short
            for f in fill:
                if f != l:
                    covered[f] += amount
        over = np.divide(covered - goal, np.maximum(count, 1))
        value = np.where(count > 0, length * np.exp(-rate * np.clip(over * phases, 0, 20)), 0.0)
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, phases: int = PHASES) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how many sequences each gets; together they hold the histogram exactly.

    The fractional solution is rounded down, so no more than one sequence a configuration is left
    over; the rest goes best fit, longest first, into open sequences, all of a kind at once.
    """
    left = np.zeros(capacity + 1, np.int64)
    for l, n in histogram.items():
        left[l] = n
    open_by_room: dict[int, list[list]] = defaultdict(list)
    for config, amount in sorted(configurations(left, capacity, phases).items(), key=lambda kv: (-kv[1], kv[0])):
        n = int(amount + 1e-9)
        for l in set(config):
            n = min(n, int(left[l]) // config.count(l))
        if n > 0:
            for l in config:
                left[l] -= n
            open_by_room[capacity - sum(config)].append([config, n])
    rooms = sorted(open_by_room)
    for l in np.flatnonzero(left)[::-1].tolist():
        n = int(left[l])
        while n:
            at = bisect_left(rooms, l)
            if at == len(rooms):
                # none has room: open sequences, as full of this length as they get
                fit = min(capacity // l, n)
                got, n = n // fit, n % fit
                config, room = (l,) * fit, capacity - fit * l
            else:
                group = open_by_room[rooms[at]]
                config, have = group.pop()
                fit = min(rooms[at] // l, n)
                got = min(have, n // fit)
                n -= got * fit
                if have > got:
                    group.append([config, have - got])
                if not group:
                    del open_by_room[rooms[at]]
                    room = rooms.pop(at) - fit * l
                else:
                    room = rooms[at] - fit * l
                config = config + (l,) * fit
            if room not in open_by_room:
                rooms.insert(bisect_left(rooms, room), room)
            open_by_room[room].append([config, got])
    return sorted(((c, n) for groups in open_by_room.values() for c, n in groups), reverse=True)


def _lines(found: list[tuple[tuple[int, ...], int]], capacity: int):
    """Per length: rank from which a slot serves, its first sequence and its offset."""
    rank = np.zeros(capacity + 1, np.int64)
    rows = []
    first = 0
    for config, n in found:
        offset = 0
        for l in config:
            rows.append((l, rank[l], first, offset))
            rank[l] += n
            offset += l
        first += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(lines: np.ndarray):
    # one sorted key: length and rank together
    shift = np.int64(1) << 48

    def run(batches):
        key = lines[:, 0] * shift + lines[:, 1]
        for b in batches:
            length, rank = long_column(b, "length"), long_column(b, "__rank")
            at = np.searchsorted(key, length * shift + rank, side="right") - 1
            seq = lines[at, 2] + rank - lines[at, 1] if len(at) else np.zeros(0, np.int64)
            off = lines[at, 3] if len(at) else np.zeros(0, np.int64)
            keep = [i for i, c in enumerate(b.schema.names) if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(seq), pa.array(off)],
                                             names=[*(b.schema.names[i] for i in keep), "sequence_id", "offset"])
    return run


def pack(items: DataFrame, order: list[str], capacity: int = CAPACITY, phases: int = PHASES) -> DataFrame:
    """`items` (with a column length, 1..capacity) with sequence_id and offset.

    Sequences are filled without gaps from 0. `order` names the columns that rank items of equal
    length; ranks are counted in groups of about RANK_GROUP items, so a frequent length is split.
    An empty table gives no rows.
    """
    items = cut(items)
    by_length = cut(items.groupBy("length").agg(F.count(F.lit(1)).alias("__n")))
    histogram = {r[0]: r[1] for r in by_length.collect()}
    # one row per length, so at most `capacity` rows are sent to the tasks
    groups = by_length.select("length", F.ceil(F.col("__n") / RANK_GROUP).alias("__groups"))
    salted = items.join(F.broadcast(groups), "length").withColumn("__salt", F.pmod(F.xxhash64(*order), F.col("__groups")))
    size = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    base = cut(size.select("length", "__salt", F.coalesce(before, F.lit(0)).alias("__before")))
    own = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order))
    ranked = salted.withColumn("__own", own).join(base, ["length", "__salt"]).select(
        *items.columns, (F.col("__before") + F.col("__own") - 1).alias("__rank"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    lines = _lines(plan(histogram, capacity, phases), capacity)
    return ranked.mapInArrow(_place(lines), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all rows (see `pieces`) with their sequence and offset."""
    got = pieces(docs, tokenizer, id_col, text_col, capacity, end_id)
    return pack(got, [id_col, "piece", "ids_crc32"], capacity).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
