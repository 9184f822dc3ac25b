"""Exact top-k search: tiled matrix products, partial selection per tile, tree merge."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlens.llm.vectors import best_rows, cells, merged, one_per_id, usable

K, SCALE = 10, 1024
_QUERIES_AT_ONCE = 128


def _products(q: np.ndarray, r: np.ndarray, dim: int) -> np.ndarray:
    """Integer inner products: in doubles where every partial sum is exact, else in longs or unbounded integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) * dim
    if top < 2 ** 53:
        return q @ r.T
    if top < 2 ** 62:
        return q.astype(np.int64) @ r.astype(np.int64).T
    exact = np.vectorize(int, otypes=[object])
    return exact(q) @ exact(r).T


def _kernel(k: int, scale: float):
    def run(qid, q, rid, r, dim):
        order = np.argsort(rid, kind="stable")
        rid, r, q = rid[order], np.floor(r[order] * scale), np.floor(q * scale)
        out = [(np.zeros(0, np.int64),) * 3]
        for at in range(0, len(q), _QUERIES_AT_ONCE):
            s = _products(q[at:at + _QUERIES_AT_ONCE], r, dim)
            own = qid[at:at + _QUERIES_AT_ONCE, None] == rid[None]
            if s.dtype == object:
                i, j = np.nonzero(~own)
                got = s[i, j]
                if len(got) and (max(got) >= 2 ** 63 or min(got) < -2 ** 63):
                    raise OverflowError("an inner product exceeds 64 bits")
                got = got.astype(np.int64)
            else:
                low = s.astype(np.int64)
                # partial selection: everything at or above the k-th best other row
                masked = np.where(own, np.iinfo(np.int64).min, low)
                kth = np.partition(masked, max(0, masked.shape[1] - k), axis=1)[:, max(0, masked.shape[1] - k)]
                i, j = np.nonzero((masked >= kth[:, None]) & ~own)
                got = low[i, j]
            best = best_rows(i, rid[j], -got, k)
            out.append((i[best] + at, order[j[best]], got[best]))
        return tuple(np.concatenate(x) for x in zip(*out))
    return run


def top_products(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
                 scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * vector).

    All rows but those with the query's own id are candidates; ties go to the smaller id. Vectors
    that are null, empty or hold null, NaN or infinity take no part, nor do null ids; vectors of
    different length are not compared. Repeated rows are candidates each; repeated queries are one.
    An empty table gives no rows. Products beyond 64 bits fail the job.
    """
    rows = vectors.where(usable(vec_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.size(vec_col).alias("dim"), is_query.alias("q"))
    found, shards = cells(rows.drop("q"), one_per_id(rows.where("q")), _kernel(k, scale), "long")
    return merged(found, shards, k, F.desc("score"))
