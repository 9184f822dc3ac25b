"""Merkle manifest of a dataset: trees of fan-out 3 per source, kept as van Emde Boas blocks.

The leaves of a source stand in order; `RUN ** HEIGHT` consecutive ones are an aligned subtree, built in one
task and stored as one row whose digests lie in van Emde Boas order: the tree is split at half its height,
the upper half stored first and each lower subtree after it, recursively. Block roots are the leaves of the next
round, so a hot source is many blocks and few rounds. The roots of all sources form one more tree.

Siblings are read from the stored blocks by address; a block gets the path above it by one join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlens.session import cut

RUN = 3
#: Levels of an aligned subtree above its leaves.
HEIGHT = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_STORE = "tree string, block long, n long, root binary, store binary"


def join_hash(digests: list[bytes]) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


@lru_cache(maxsize=None)
def addresses(height: int, run: int = RUN) -> tuple[np.ndarray, ...]:
    """Van Emde Boas addresses of a complete tree: entry l holds those of its level l, leaves being level 0."""
    if height == 0:
        return (np.zeros(1, np.int64),)
    below = (height + 1) // 2 - 1  # height of the lower subtrees; the rest, less one edge, is the upper one
    above = height - below - 1
    upper, lower = addresses(above, run), addresses(below, run)
    size_upper, size_lower = sum(map(len, upper)), sum(map(len, lower))
    first = size_upper + size_lower * np.arange(run ** (above + 1), dtype=np.int64)
    return (*((first[:, None] + level[None, :]).ravel() for level in lower), *upper)


def levels_over(n: int, run: int = RUN) -> int:
    """Levels until one node remains."""
    k = 0
    while n > 1:
        n, k = -(-n // run), k + 1
    return k


def build_block(leaves: list[bytes], height: int) -> tuple[bytes, bytes]:
    """(root, store) of consecutive leaves: every level is read from and written to the store by address."""
    at = addresses(height)
    store = np.zeros((sum(map(len, at)), 32), np.uint8)
    n = len(leaves)
    store[at[0][:n]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32)
    for level in range(height):
        text = store[at[level][:n]].tobytes().hex()
        up = [sha256(text[i:i + 64 * RUN].encode()).digest() for i in range(0, 64 * n, 64 * RUN)]
        n = len(up)
        store[at[level + 1][:n]] = np.frombuffer(b"".join(up), np.uint8).reshape(-1, 32)
    return store[at[height][0]].tobytes(), store.tobytes()


def sibling_path(store: bytes, n: int, height: int, place: int) -> bytes:
    """Steps from leaf `place` of a block to its root: a byte 4 * position + siblings, then their digests."""
    at, out = addresses(height), []
    for level in range(height):
        first = place - place % RUN
        near = [j for j in range(first, min(first + RUN, n)) if j != place]
        out.append(bytes([4 * (place - first) + len(near)]))
        out += [store[32 * a:32 * a + 32] for a in at[level][near].tolist()]
        place, n = place // RUN, -(-n // RUN)
    return b"".join(out)


def steps(path: bytes):
    """(position, siblings) of each step of a path."""
    i = 0
    while i < len(path):
        position, many = divmod(path[i], 4)
        i += 1
        yield position, [path[i + 32 * k:i + 32 * k + 32] for k in range(many)]
        i += 32 * many


def fold(digest: bytes, path: bytes) -> bytes:
    for position, near in steps(path):
        digest = join_hash([*near[:position], digest, *near[position:]])
    return digest


def siblings_digest(path: bytes) -> bytes:
    return join_hash([s for _, near in steps(path) for s in near])


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 of all fields: `-` for null, else UTF-8 bytes, a colon and the value."""
    parts = []
    for c in fields:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _running_place(batches):
    """Adds each row's place among those of its tree in this sorted partition, and the partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        names = b.column(b.schema.get_field_index("tree")).dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        place = np.arange(len(code)) - np.repeat(new, np.diff(np.append(new, len(code))))
        first = names.dictionary[int(code[0])].as_py()
        head = len(code) if len(new) == 1 else int(new[1])
        if first == last:
            place[:head] += seen
        seen, last = int(place[-1]) + 1, names.dictionary[int(code[-1])].as_py()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64()), pa.array(np.full(len(code), part), pa.int64())],
                                         names=[*b.schema.names, "__place", "__part"])


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `rank`, from 0 within each tree by `order` (nulls first).

    Rows are dealt by ranges of (tree, order), so a hot tree is many tasks; each counts on from the rows of its tree in
    earlier ranges.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    keys = ["tree", *order]
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                 .mapInArrow(_running_place, f"{fields}, __place long, __part long"))
    before = F.sum("__n").over(Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    base = placed.groupBy("tree", "__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "tree", "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return placed.join(base, ["tree", "__part"]).select(*rows.columns, (F.col("__place") + F.col("__before")).alias("rank"))


def _build(most: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        tree, block, n = table["tree"][0], table["block"][0], table.num_rows
        height = _height(block.as_py(), n, most)
        root, store = build_block(table["digest"].to_pylist(), height)
        return pa.table({"tree": [tree.as_py()], "block": [block.as_py()], "n": [n], "root": [root], "store": [store]},
                        schema=pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("root", pa.binary()), ("store", pa.binary())]))
    return run


def _height(block: int, n: int, most: int) -> int:
    """Levels of a block: the first of a tree may be all of it; every other is one of several and goes all levels up."""
    return most if block > 0 else levels_over(n)


def _block(height: int) -> Column:
    return F.floor(F.col("rank") / RUN ** height).cast("long").alias("block")


def _several(blocks: DataFrame, how: str) -> DataFrame:
    """Blocks of trees that have several (left_semi) or one (left_anti)."""
    return blocks.join(blocks.where("block = 1").select("tree"), "tree", how)


def forest(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Block tables of (tree, rank, digest) by round; round k + 1 stands on the block roots of round k."""
    rounds = []
    while True:
        blocks = cut(nodes.select("tree", "rank", "digest", _block(height)).groupBy("tree", "block").applyInArrow(_build(height), _STORE))
        rounds.append(blocks)
        if blocks.where("block > 0").isEmpty():
            return rounds
        nodes = _several(blocks, "left_semi").select("tree", F.col("block").alias("rank"), F.col("root").alias("digest"))


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, root, round) of every tree."""
    out = None
    for k, blocks in enumerate(rounds):
        done = _several(blocks, "left_anti").select("tree", "root", F.lit(k).alias("round"))
        out = done if out is None else out.unionByName(done)
    return out


def _paths(most: int):
    """The path of every node of a block, the block's own path after it."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                height, n = _height(r["block"], r["n"], most), r["n"]
                paths = [sibling_path(r["store"], n, height, i) + r["above"] for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["tree"]] * n), pa.array(np.arange(n) + r["block"] * RUN ** most, pa.int64()), pa.array(paths, pa.binary())],
                    names=["tree", "rank", "above"])
    return run


def block_paths(rounds: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, block, n, store, above) of the first round: each block with the path from its root upwards.

    `above` (tree, round, above) is the path over the root of each tree.
    """
    upper = None
    for k in range(len(rounds) - 1, -1, -1):
        here = above.where(F.col("round") == k).select("tree", F.lit(0).cast("long").alias("block"), "above")
        if upper is not None:
            here = here.unionByName(upper.select("tree", F.col("rank").alias("block"), "above"))
        blocks = rounds[k].join(here, ["tree", "block"]).select("tree", "block", "n", "store", "above")
        if k == 0:
            return blocks
        upper = blocks.mapInArrow(_paths(height), "tree string, rank long, above binary")


@dataclass
class Manifest:
    """Block tables of the sources' trees and of the tree over them; `tops` has one row a source."""

    leaves: DataFrame
    rounds: list[DataFrame]
    top_rounds: list[DataFrame]
    tops: DataFrame
    root: bytes | None
    height: int


def manifest(leaves: DataFrame, order: list[str], height: int = HEIGHT) -> Manifest:
    """Trees over rows with columns (group, digest, ...): leaves of a group ascend by `order`, groups by their UTF-8 bytes, null first."""
    # '-' sorts before '=': a tree name is never null and keeps the order of the groups
    named = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), "group"), F.lit("-")))
    rows = cut(ranked(named, order))
    rounds = forest(rows, height)
    subroots = ranked(roots(rounds).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"), "round"), ["name"])
    subroots = cut(subroots)
    top_rounds = forest(subroots, height)
    over = roots(top_rounds).select("tree", "root", "round", F.lit(b"").alias("above"))
    first = over.first()
    paths = block_paths(top_rounds, over, height).mapInArrow(_paths(height), "tree string, rank long, above binary")
    tops = subroots.join(paths, ["tree", "rank"]).select(F.col("name").alias("tree"), "round", F.col("digest").alias("subroot"), "above")
    return Manifest(rows, rounds, top_rounds, cut(tops), first["root"] if first else None, height)


def _fold_block(most: int):
    """Proof and folded root of every row of a block."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        r = {c: right[c][0].as_py() for c in right.column_names} if right.num_rows else None
        proof, folded = [], []
        if r is not None:
            height, above, upper = _height(r["block"], r["n"], most), r["above"], {}
            shared = [s for _, near in steps(above) for s in near]
            for rank, digest in zip(left["rank"].to_pylist(), left["claimed"].to_pylist()):
                own = sibling_path(r["store"], r["n"], height, rank - r["block"] * RUN ** most)
                proof.append(join_hash([s for _, near in steps(own) for s in near] + shared))
                top = fold(digest, own)
                if top not in upper:
                    upper[top] = fold(top, above)
                folded.append(upper[top])
        out = left.select([c for c in left.column_names if c not in ("block", "claimed", "rank")])
        for name, v in (("subroot", [r["subroot"]] * left.num_rows if r else []), ("proof", proof), ("folded", folded)):
            out = out.append_column(name, pa.array(v, pa.binary()))
        return out
    return run


def verify(m: Manifest) -> DataFrame:
    """Leaves with `subroot`, `proof` (digest of all siblings up to the root) and `folded`, the root recomputed from `claimed`."""
    paths = block_paths(m.rounds, m.tops.select("tree", "round", "above"), m.height)
    paths = paths.join(m.tops.select("tree", "subroot"), "tree")
    rows = m.leaves.select("*", _block(m.height))
    fields = [f for f in m.leaves.schema if f.name not in ("claimed", "rank")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", subroot binary, proof binary, folded binary"
    return rows.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(_fold_block(m.height), schema)


def document_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: list[str] | None = None,
                      text_col: str = "text", height: int = HEIGHT) -> DataFrame:
    """One row a document: leaf, subroot, root, proof_sha256, folded_root and verified, digests in lowercase hex.

    Documents whose unsigned crc32(id) is even are checked as if the line ends of their text had been deleted; they verify only
    where there was none.

    Defined cases: a null field is `-`; documents without a source form a tree of their own, the first; a null id comes first and
    is not tampered with; rows that repeat an id stand in the order of their leaves, equal rows side by side; an
    empty table gives no rows; other columns are left out.
    """
    cols = [F.col(c) for c in (fields or FIELDS)]
    tampered = [F.regexp_replace(c, "\n", "") if n == text_col else c for c, n in zip(cols, fields or FIELDS)]
    even = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0, F.lit(False))
    leaf = leaf_digest(cols)
    changed = even & F.coalesce(F.contains(F.col(text_col), F.lit("\n")), F.lit(False))
    leaves = docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("group"), leaf.alias("digest"),
                         F.when(changed, leaf_digest(tampered)).otherwise(leaf).alias("claimed"))
    m = manifest(leaves, ["id", "digest"], height)
    root = F.lit(m.root.hex() if m.root else "")
    got = verify(m).select(
        F.col("id").alias(id_col), F.lower(F.hex("digest")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), root.alias("root"),
        F.lower(F.hex("proof")).alias("proof_sha256"), F.lower(F.hex("folded")).alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))
