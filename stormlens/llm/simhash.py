"""SimHash near-duplicates: pigeonhole blocks, verified distances, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormlens.llm.common import binary_column, groups_of, starts_of
from stormlens.llm.graph import components
from stormlens.session import cut

SHINGLE, SEED = 3, 42
MAX_DISTANCE, BLOCKS = 3, 6
#: Members of one block value that are compared at once; larger groups are cut into tiles of this size.
TILE = 2048
#: Fixed byte order of the digest: a fingerprint is an unsigned 64-bit number, kept as a signed long.
_HASHES_AT_ONCE = 1 << 18


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            data, off = binary_column(batch, "__text")
            out = np.zeros(batch.num_rows, np.uint64)
            rows: list[int] = []
            counts: list[int] = []
            held: list[int] = []

            def flush():
                if not held:
                    return
                bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                at = np.concatenate([[0], np.cumsum(counts)[:-1]])
                ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
                up = ones * 2 > np.array(counts)[:, None]
                out[rows] = np.packbits(up, axis=1, bitorder="little").view("<u8").ravel()
                rows.clear(), counts.clear(), held.clear()

            view = data.tobytes()
            for i in range(batch.num_rows):
                words = view[off[i]:off[i + 1]].lower().split()
                if not words:
                    continue
                line = b" ".join(words)
                if len(words) <= shingle:
                    new = [digest(line, SEED)]
                else:
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - shingle + 1].tolist()
                    new = [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())]
                rows.append(i), counts.append(len(new)), held.extend(new)
                if len(held) >= _HASHES_AT_ONCE:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["__id", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) per row: SimHash of the word shingles of the lower-cased whole text as a signed long.

    Null, empty and blank texts have fingerprint 0; fewer words than a shingle are one shingle.
    """
    return docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("__text")).mapInArrow(
        _fingerprints(shingle), "__id long, fp long")


def block_masks(blocks: int = BLOCKS, distance: int = MAX_DISTANCE) -> list[int]:
    """Bit masks of which every two fingerprints within `distance` agree on at least one.

    The 64 bits are cut into `blocks` runs; at most `distance` of them differ, so the remaining
    blocks - distance agree. Masks over several blocks keep groups of unrelated fingerprints small.
    """
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    run = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edge, edge[1:])]
    return [sum(pick) for pick in combinations(run, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(fps: np.ndarray, one: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of `fps` under distance; with `one`, only pairs of which exactly one is marked."""
    label, a, b = np.arange(len(fps)), [], []
    for i in range(len(fps) - 1):
        near = np.bitwise_count(fps[i + 1:] ^ fps[i]) <= distance
        if one is not None:
            near &= one[i + 1:] != one[i]
        js = np.flatnonzero(near) + i + 1
        if len(js):
            other, at = np.unique(label[js], return_index=True)
            new = other != label[i]
            a += [fps[i]] * int(new.sum())
            b += fps[js[at[new]]].tolist()
            label[np.isin(label, other)] = label[i]
    return np.array(a, np.uint64), np.array(b, np.uint64)


def _pairs_in_groups(fps: np.ndarray, starts: np.ndarray, distance: int, small: int = 16) -> tuple[list, list]:
    """Verified links within runs of rows: all pairs of short runs at once, a forest of each long one."""
    size = np.diff(np.append(starts, len(fps)))
    group = np.repeat(np.arange(len(starts)), size)
    a, b = [], []
    short = np.repeat(size <= small, size)
    f, g = fps[short], group[short]
    for d in range(1, min(small, int(size.max(initial=0)))):
        at = np.flatnonzero((g[d:] == g[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= distance))
        a.append(f[at]), b.append(f[at + d])
    for k in np.flatnonzero(size > small):
        x, y = _linked(fps[starts[k]:starts[k] + size[k]], None, distance)
        a.append(x), b.append(y)
    return a, b


def _edge_batch(a: list, b: list, **more) -> pa.RecordBatch:
    a = np.concatenate([*a, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
    b = np.concatenate([*b, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
    none = np.full(len(a), -1, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, none, none, none)], names=["a", "b", "t", "m", "part"])


def _compare_blocks(distance: int, tile: int):
    """Rows sorted by (t, m): links of groups up to `tile`; of larger ones the members, numbered in tiles."""
    def run(batches):
        key, part, held = None, 0, np.zeros(0, np.uint64)

        def parts(fps):
            n = len(fps)
            col = [fps.view(np.int64), fps.view(np.int64), *(np.full(n, x, np.int64) for x in (*key, part))]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in col], names=["a", "b", "t", "m", "part"])

        for batch in batches:
            t, m, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(t):
                continue
            fp = fp.view(np.uint64)
            starts = starts_of({"t": t, "m": m}, ["t", "m"])
            first_end = int(starts[1]) if len(starts) > 1 else len(t)
            if key == (t[0], m[0]):
                held = np.concatenate([held, fp[:first_end]])
                starts = starts[1:]
                if not len(starts):
                    while len(held) > tile:
                        yield parts(held[:tile])
                        part, held = part + 1, held[tile:]
                    continue
            # what is held is a whole group, or the end of one
            if key is not None:
                while part and len(held) or len(held) > tile:
                    yield parts(held[:tile])
                    part, held = part + 1, held[tile:]
                if len(held) > 1:
                    yield _edge_batch(*_pairs_in_groups(held, np.array([0]), distance))
            last = int(starts[-1])
            lo = int(starts[0])
            size = np.diff(starts)
            big = np.flatnonzero(size > tile)
            keep = np.ones(last - lo, bool)
            for k in big:
                s, e = int(starts[k]), int(starts[k + 1])
                keep[s - lo:e - lo] = False
                key, part = (t[s], m[s]), 0
                for at in range(s, e, tile):
                    yield parts(fp[at:min(e, at + tile)])
                    part += 1
            if last > lo:
                tt, mm, ff = (x[lo:last][keep] for x in (t, m, fp))
                if len(tt):
                    yield _edge_batch(*_pairs_in_groups(ff, starts_of({"t": tt, "m": mm}, ["t", "m"]), distance))
            key, part, held = (t[last], m[last]), 0, fp[last:]
        if key is not None:
            while part and len(held) or len(held) > tile:
                yield parts(held[:tile])
                part, held = part + 1, held[tile:]
            if len(held) > 1:
                yield _edge_batch(*_pairs_in_groups(held, np.array([0]), distance))
    return run


def _compare_tiles(distance: int):
    """Rows sorted by (t, m, lo, hi): links inside a tile (lo = hi) or between two."""
    def run(batches):
        for cols, starts in groups_of(batches, ["t", "m", "lo", "hi"]):
            ends = np.append(starts[1:], len(cols["t"]))
            for s, e in zip(starts, ends):
                one = None if cols["lo"][s] == cols["hi"][s] else cols["part"][s:e] == cols["lo"][s]
                a, b = _linked(cols["fp"][s:e].view(np.uint64), one, distance)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
    return run


def links(distinct: DataFrame, blocks: int = BLOCKS, distance: int = MAX_DISTANCE, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` that keep together what is within `distance`.

    Each fingerprint goes to one group per mask; groups are compared where they lie and give a
    spanning forest, not all pairs. A group beyond `tile` members is compared tile by tile, each
    pair of tiles a group of its own, so no task holds more than two tiles.
    """
    masks = F.array(*[F.struct(F.lit(i).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(k))).alias("m"))
                      for i, k in enumerate(block_masks(blocks, distance))])
    rows = distinct.select("fp", F.inline(masks)).select("t", "m", "fp")
    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    got = cut(rows.repartition(n, "t", "m").sortWithinPartitions("t", "m").mapInArrow(
        _compare_blocks(distance, tile), "a long, b long, t long, m long, part long"))
    large = got.where("t >= 0").select("t", "m", "part", F.col("a").alias("fp"))
    parts = large.groupBy("t", "m").agg(F.max("part").alias("top"))
    tiles = large.join(parts, ["t", "m"]).select("t", "m", "part", "fp", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("o"))
    tiles = tiles.select("t", "m", F.least("part", "o").alias("lo"), F.greatest("part", "o").alias("hi"), "part", "fp")
    across = tiles.repartition(n, "t", "m", "lo", "hi").sortWithinPartitions("t", "m", "lo", "hi").mapInArrow(
        _compare_tiles(distance), "a long, b long")
    return got.where("t < 0").select("a", "b").union(across)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = MAX_DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """(id, fp, component) per row of `docs`; component is the smallest id that links can reach.

    Rows of equal fingerprint are one vertex, so copies are never expanded. Repeated rows stay
    repeated; a null id is carried and never is a component unless all ids of its group are null.
    An empty table gives no rows. Other columns of `docs` are not read.
    """
    f = cut(fingerprints(docs, id_col, text_col, shingle))
    same = cut(f.groupBy("fp").agg(F.min("__id").alias("least")))
    label = components(links(same.select("fp"), blocks, distance, tile), "a", "b")
    linked = same.join(label.withColumnRenamed("id", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    low = linked.groupBy("c").agg(F.min("least").alias("component_id"))
    named = cut(linked.select("fp", "c").join(low, "c").select("fp", "component_id"))
    return f.join(named, "fp").select(F.col("__id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` that are the smallest of their component; all columns stay.

    Of rows that repeat an id, the one least by a hash of all its columns stays (maps left out). Rows with a null id stay all;
    no window or group gathers them, or the rows of a repeated id.
    """
    member = near_duplicates(docs, id_col, text_col, **how)
    row, key = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__id")
    gone = member.where(F.col("component_id") < F.col(id_col)).select(key).distinct()
    left = docs.select(row, key).join(gone, "__id", "left_anti")
    again = cut(docs.select(key).where("__id is not null").groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__id"))
    hashed = F.xxhash64(*[F.col(f"__row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    # minima are combined where the rows lie, so a repeated id sends one row a task
    one = left.join(again, "__id", "left_semi").groupBy("__id").agg(F.min_by("__row", hashed).alias("__row")).select("__row")
    kept = left.join(again, "__id", "left_anti").select("__row").union(one)
    return kept.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
