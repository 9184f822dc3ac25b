"""Approximate nearest neighbours: cross-polytope hashing with multiprobe tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlens.llm.vectors import best_rows, cells, merged, one_per_id, usable
from stormlens.session import cut

K, TABLES, PROBES, ROTATIONS, SEED = 10, 10, 10, 3, 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(unit: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of a table: random signs and a Hadamard transform, in turns; padded to a power of two."""
    n, d = unit.shape
    size = 1 << max(0, (d - 1).bit_length())
    y = np.zeros((n, size))
    y[:, :d] = unit
    signs = np.random.default_rng([SEED, table, size])
    for _ in range(ROTATIONS):
        y = hadamard(y * signs.choice([-1.0, 1.0], size))
    return y


def axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: axis i is 2i, its negative 2i + 1."""
    both = np.stack([y, -y], 2).reshape(len(y), -1)
    if probes == 1:
        return both.argmax(1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kernel(k: int, tables: int, probes: int | None):
    """Tables over the rows of a cell; each query probes its nearest buckets in all of them, and what it
    collects is ranked by exact distance. Without `probes` all rows are collected."""
    def run(qid, q, rid, r, dim):
        index, seeds = [], []
        if probes is not None:
            for t in range(tables):
                code = axes(rotated(_unit(r), t), 1)[:, 0]
                order = np.argsort(code, kind="stable")
                index.append((order, np.searchsorted(code[order], np.arange(2 * (1 << max(0, (dim - 1).bit_length())) + 1))))
                seeds.append(axes(rotated(_unit(q), t), probes))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in range(len(q)):
            if probes is None:
                j = np.arange(len(r))
            else:
                hit = np.zeros(len(r), bool)
                for (order, edge), near in zip(index, seeds):
                    for b in near[i].tolist():
                        hit[order[edge[b]:edge[b + 1]]] = True
                j = np.flatnonzero(hit)
            j = j[rid[j] != qid[i]]
            d = r[j] - q[i]
            d = np.sqrt((d * d).sum(1))
            if len(d) > k:
                near = d <= np.partition(d, k - 1)[k - 1]
                j, d = j[near], d[near]
            best = best_rows(np.zeros(len(j), np.int64), rid[j], d, k)
            out.append((np.full(len(best), i), j[best], d[best]))
        return tuple(np.concatenate(x) for x in zip(*out))
    return run


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
            tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by Euclidean distance in doubles.

    Candidates are hashed as unit vectors; distances are of the vectors as they are. Rows with the
    query's own id are no candidates; ties go to the smaller id. Null, empty and zero vectors and
    those with null, NaN or infinity take no part, nor do null ids; vectors of different length are
    not compared. A query that finds fewer than k rows is answered anew from all rows, so small
    tables give all they hold. Repeated rows are candidates each; repeated queries are one.
    """
    rows = vectors.where(usable(vec_col, zero=False) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.size(vec_col).alias("dim"), is_query.alias("q"))
    queries = one_per_id(rows.where("q"))
    rows = rows.drop("q")
    found, shards = cells(rows, queries, _kernel(k, tables, probes), "double")
    first = cut(merged(found, shards, k, F.asc("score")))
    full = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    rest, shards = cells(rows, cut(queries.join(full, "id", "left_anti")), _kernel(k, tables, None), "double")
    return first.join(full, first.query_id == full.id, "left_semi").union(merged(rest, shards, k, F.asc("score")))
