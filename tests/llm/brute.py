"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import zlib

import xxhash


def words(text):
    return (text or "").encode().split()


def fingerprint(text, n=3):
    w = words((text or "").encode().lower().decode())
    shingles = [b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, fps, distance=3):
    """Smallest reachable id per row; rows may share an id, null ids are ignored unless alone."""
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    low = {}
    for a in range(len(ids)):
        if ids[a] is not None:
            r = find(a)
            low[r] = min(low.get(r, ids[a]), ids[a])
    return [low.get(find(a)) for a in range(len(ids))]


def removed(rows, window):
    """Per row of (id, text): mask of removed words; null ids are the smallest."""
    order = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            first[k] = min(first.get(k, (order(i), p)), (order(i), p))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < (order(i), p):
                gone[p:p + window] = [True] * window
        out.append(gone)
    return out


def digest(text, gone):
    w = words(text)
    kept = [x for x, g in zip(w, gone) if not g]
    return len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def copies(rows, temper=0.5, seed="mix"):
    """Number of copies of each (id, source)."""
    n = {}
    for _, s in rows:
        n[s] = n.get(s, 0) + 1
    z = sum(c ** temper for c in n.values())
    out = []
    for i, s in rows:
        rate = len(rows) * n[s] ** temper / z / n[s]
        u = int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2 ** 52
        k, p = 0, math.exp(-rate)
        total = p
        while u >= total:
            k += 1
            p *= rate / k
            total += p
            if k > 1000:
                break
        out.append(k)
    return out


def pieces(tokenizer, text, capacity=4096):
    """(piece, start, length, crc32) of one document."""
    import struct
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    return [(p, s, len(ids[s:s + capacity]), zlib.crc32(struct.pack(f"<{len(ids[s:s + capacity])}I", *ids[s:s + capacity])))
            for p, s in enumerate(range(0, len(ids), capacity))]


def check_packed(rows, capacity=4096):
    """Sequences of (sequence_id, offset, length) are gapless from 0 and within capacity; returns their number."""
    seq = {}
    for s, o, n in rows:
        seq.setdefault(s, []).append((o, n))
    for v in seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(seq)
