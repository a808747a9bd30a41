"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Components are floor(scale * x), so that scores are integers. Rows are dealt into blocks; a block keeps, for each dimension,
its rows in the order of that component. A query walks the lists of its non-zero dimensions from their best end, some
depth further at a time, scores every row met for the first time in full, and stops once the k-th score is above
the bound that the components at the current depth allow for rows not yet met. The k-th score of the blocks that a task has
done carries over to its next block, so later walks are shorter. The best of all tasks are merged.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without vec_id;
only vectors of equal length meet; repeated vec_ids are rows of their own, except that a query never finds its own vec_id;
components too large for exact doubles are scored in Python integers, cut to the range of long; fewer than k rows
give them all; empty tables give empty results; columns besides vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkvault.llm.common import portions, store, store_each, tidy
from chunkvault.llm.vectors import Best, blocked, nearest, rounds, whole_vectors

BLOCK, DEPTH = 4096, 16
_SAFE = float(1 << 53)


def threshold_top(query: np.ndarray, rows: np.ndarray, order: np.ndarray, banned: np.ndarray, k: int, floor=None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best rows, ties to the smaller place; of rows below floor, a k-th score found elsewhere, not all need be found.
    order: for each dimension the places by ascending component."""
    n, dims = len(rows), np.flatnonzero(query)
    met, places, scores = banned.copy(), np.empty(0, np.int64), np.empty(0, rows.dtype)
    up = query[dims] > 0
    at, depth = 0, DEPTH
    while at < n:
        to = min(n, at + depth)
        cut = [order[d, n - to : n - at] if u else order[d, at:to] for d, u in zip(dims, up, strict=True)]
        new = np.zeros(n, bool)
        if cut:
            new[np.concatenate(cut)] = True
        else:
            new[:] = True
        new &= ~met
        met |= new
        fresh = np.flatnonzero(new)
        places, scores = np.concatenate([places, fresh]), np.concatenate([scores, rows[fresh] @ query])
        if len(places) > k:
            best = np.lexsort((places, -scores))[:k]
            places, scores = places[best], scores[best]
        if not cut:
            break
        edge = np.array([rows[order[d, n - to] if u else order[d, to - 1], d] for d, u in zip(dims, up, strict=True)])
        bound = (edge * query[dims]).sum()
        if (floor is not None and floor > bound) or (len(places) >= k and scores.min() > bound):
            break
        at, depth = to, depth * 2
    best = np.lexsort((places, -scores))[:k]
    return places[best], scores[best]


def _integers(v: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): doubles where sums of products stay exact, else Python integers."""
    scaled = np.floor(scale * v)
    if np.isfinite(scaled).all() and (np.abs(scaled).max(initial=0) ** 2) * v.shape[1] < _SAFE:
        return scaled
    return np.array([[int(scale) * int(x) if abs(x) > 2.0**53 else int(np.floor(scale * x)) for x in row] for row in v], dtype=object)


def _whole(m: np.ndarray) -> np.ndarray:
    return np.array([[int(y) for y in x] for x in m], dtype=object)


def _found(index: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int, scale: float) -> DataFrame:
    """For each query the best of each task: rows (query_id, vec_id, score)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in portions(batches, 1):
            (block,) = batch.to_pylist() or [None]
            if block is None or block["dim"] not in asked:
                continue
            dim, (q_ids, q) = block["dim"], asked[block["dim"]]
            ids, data, q = np.frombuffer(block["ids"], np.int64), _integers(np.frombuffer(block["v"]).reshape(-1, dim), scale), _integers(q, scale)
            if data.dtype != q.dtype or (data.dtype != object and np.abs(data).max(initial=0) * np.abs(q).max(initial=0) * dim >= _SAFE):
                data, q = _whole(data), _whole(q)
            order = np.frombuffer(block["ranks"], np.int32).reshape(dim, -1)
            for nth, (i, x) in enumerate(zip(q_ids.tolist(), q, strict=True)):
                places, scores = threshold_top(x, data, order, ids == i, k, best.floor((dim, nth, i)))
                best.add((dim, nth, i), scores, ids[places])
        for (_, _, i), (scores, ids) in best.held.items():
            cut = [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i)), pa.array(ids), pa.array(cut, pa.int64())], ["query_id", "vec_id", "score"])

    return index.mapInArrow(rows, "query_id long, vec_id long, score long")


@tidy
def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """For each row of queries (vec_id, embedding) the k rows of vectors of largest integer inner product: query_id, rank, vec_id, score."""

    def listed(ids: np.ndarray, v: np.ndarray) -> dict[str, bytes]:
        return {"ids": ids.tobytes(), "v": v.tobytes(), "ranks": np.argsort(_integers(v, scale), axis=0, kind="stable").T.astype(np.int32).tobytes()}

    index = store(blocked(whole_vectors(vectors), BLOCK, listed, "ids binary, v binary, ranks binary"), "top-rows")
    asked = store(whole_vectors(queries), "top-queries")
    like = index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # A round's queries meet all rows in it, so what it finds is whole.
    return store_each((nearest(_found(index, some, k, scale), k) for some in rounds(asked)), like, "top-found").select("query_id", "rank", "vec_id", "score")


def queries_of(vectors: DataFrame, every: int) -> DataFrame:
    return vectors.where(F.col("vec_id") % every == 0)
