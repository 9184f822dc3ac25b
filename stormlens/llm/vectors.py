"""Search in tiles: a set of query rows against all rows, cut into cells of bounded size.

Rows are dealt to shards and queries to tiles; a cell is one tile against one shard. Either side is
repeated only once per tile or shard, each cell gives its k best per query, and the lists of the
shards are merged in a tree. Nothing is broadcast and no cell grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vector components held by one side of a cell: rows of a shard, queries of a tile.
SHARD_VALUES, TILE_VALUES = 1 << 20, 1 << 18
#: Lists merged at once.
FAN_IN = 16


def usable(vec: str, zero: bool = True) -> Column:
    """True for vectors that exist and hold neither null nor NaN nor infinity; with zero=False, nor only zeros."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(vec) > 0)
    return ok if zero else ok & F.exists(vec, lambda x: x != 0)


def matrix(table: pa.Table, name: str, dim: int) -> np.ndarray:
    col = table.column(name).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best_rows(row: np.ndarray, ids: np.ndarray, badness: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least (badness, id) of each row."""
    order = np.lexsort((ids, badness, row))
    r = row[order]
    first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    return order[rank < k]


def cells(rows: DataFrame, queries: DataFrame, kernel: Callable, score: str) -> tuple[DataFrame, int]:
    """((query_id, shard, vec_id, score) of all cells, number of shards).

    rows: (id, vec, dim); queries: (id, vec, dim), one row per id. `kernel(query ids, query matrix,
    row ids, row matrix, dim)` gives (query position, row position, score) of the best of a cell.
    Vectors are compared with vectors of their own length.
    """
    n = {r[0]: r[1] for r in rows.groupBy("dim").count().collect()}
    q = {r[0]: r[1] for r in queries.groupBy("dim").count().collect()}
    shards = {d: -(-c * d // SHARD_VALUES) for d, c in n.items()}
    tiles = {d: -(-q.get(d, 1) * d // TILE_VALUES) for d in n}

    def of(counts: dict) -> Column:
        return F.create_map(*[F.lit(x) for kv in (counts or {0: 1}).items() for x in kv])[F.col("dim")]

    def spot(counts: dict) -> Column:
        return F.pmod(F.xxhash64("id"), of(counts).cast("long")).cast("int")

    def all_of(counts: dict) -> Column:
        return F.explode(F.sequence(F.lit(0), of(counts) - 1))

    # both sides come from one table: new names keep their columns apart
    left = queries.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.col("dim").alias("qdim"), spot(tiles).alias("qtile"),
                          all_of(shards).alias("qshard"))
    right = rows.select(F.col("id").alias("rid"), F.col("vec").alias("rvec"), F.col("dim").alias("rdim"), all_of(tiles).alias("rtile"),
                        spot(shards).alias("rshard"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "shard", "vec_id", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64() if score == "long" else pa.float64()]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        dim, shard = a.column("qdim")[0].as_py(), a.column("qshard")[0].as_py()
        qid, rid = a.column("qid").to_numpy(), b.column("rid").to_numpy()
        i, j, s = kernel(qid, matrix(a, "qvec", dim), rid, matrix(b, "rvec", dim), dim)
        return pa.table([pa.array(x, t) for x, t in zip((qid[i], np.full(len(i), shard, np.int32), rid[j], s), kinds)], names=names)

    found = left.groupBy("qdim", "qtile", "qshard").cogroup(right.groupBy("rdim", "rtile", "rshard")).applyInArrow(
        run, f"query_id long, shard int, vec_id long, score {score}")
    return found, max(shards.values(), default=1)


def merged(found: DataFrame, shards: int, k: int, order: Column) -> DataFrame:
    """(query_id, rank, vec_id, score): lists of FAN_IN shards at a time are cut to the k best until one is left."""
    while True:
        shards = -(-shards // FAN_IN)
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        w = Window.partitionBy("query_id", "shard").orderBy(order, "vec_id")
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if shards <= 1:
            return found.select("query_id", "rank", "vec_id", "score")
        found = found.drop("rank")


def one_per_id(queries: DataFrame) -> DataFrame:
    """Queries that repeat an id are one query; of different vectors the least counts."""
    return queries.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
