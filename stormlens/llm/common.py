"""Small helpers shared by the operators: tables, Arrow chunks, word tables and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at once in a task; one longer text makes a chunk of its own.
CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are no ASCII letter or digit and no part of a longer character.
NO_LETTER = np.ones(256, bool)
NO_LETTER[48:58] = NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(col: str, mod: int) -> Column:
    """crc32 of an id's text, modulo `mod`: the fixed split into learning and held-out rows."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def binary_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def chunks(batch: pa.RecordBatch, name: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows with at most `limit` bytes of text."""
    data, off = binary_column(batch, name)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi
    # what Arrow freed goes back to the system before the next batch
    pa.default_memory_pool().release_unused()


def word_spans(buf: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text): runs of bytes other than those `between` words, by default ASCII white space."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    solid = ~between[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = off[1:] > off[:-1]
    at = off[:-1][full]
    first[at] = solid[at]
    at = off[1:][full] - 1
    last[at] = solid[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, off))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for every span: differences of one polynomial prefix sum."""
    p = np.zeros(len(buf) + 1, np.uint64)
    np.multiply(_BYTES[buf], _power_table(_BASE, len(buf) + 1)[:len(buf)], out=p[1:])
    np.cumsum(p, out=p)
    inverse = _power_table(pow(_BASE, -1, 1 << 64), len(buf) + 1)
    return mix((p[ends] - p[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def run_hashes(h: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every k consecutive values (the caller drops runs that cross texts)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    r = h[:n].copy()
    for j in range(1, k):
        r *= np.uint64(base & _MASK)
        r += h[j:n + j]
    return mix(r)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def long_column(batch: pa.RecordBatch, name: str, null: int = 0) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null(null)
    return col.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Rows sorted by `keys` as numpy columns, cut so that no group is torn, with the starts of the groups.

    A group is held whole here; callers keep groups small or bounded.
    """
    carry: list[dict[str, np.ndarray]] = []

    def joined(parts):
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    for b in batches:
        cols = {f.name: long_column(b, f.name) for f in b.schema}
        n = b.num_rows
        if not n:
            continue
        tail = n - 1
        same = np.ones(n, bool)
        for k in keys:
            same &= cols[k] == cols[k][-1]
        other = np.flatnonzero(~same)
        tail = int(other[-1]) + 1 if len(other) else 0
        if tail == 0 and carry and all(carry[-1][k][-1] == cols[k][0] for k in keys):
            carry.append(cols)
            continue
        parts = carry + ([{c: v[:tail] for c, v in cols.items()}] if tail else [])
        if parts:
            whole = joined(parts)
            yield whole, starts_of(whole, keys)
        carry = [{c: v[tail:] for c, v in cols.items()}]
    if carry:
        whole = joined(carry)
        yield whole, starts_of(whole, keys)


def starts_of(cols: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    n = len(cols[keys[0]])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= cols[k][1:] != cols[k][:-1]
    return np.flatnonzero(new)
