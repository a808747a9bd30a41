"""Nearest neighbours by cosine: additive quantisation with bounds, and exact scores of all rows that the bounds leave.

Unit vectors are sums of one full-dimensional codeword from each of several codebooks. Codebooks are learnt for each length of vectors, on a
sample of a documented bound, each on what the ones before leave over; every row is encoded by beam search, with the norm of
its reconstruction and its distance from that stored. Lengths are worked on in groups whose codebooks have at most BOOK_BYTES, one group after the other,
however many lengths there are. A query's lookup tables hold its inner products with all codewords, so the estimate for a row is a
sum of table entries over that norm. A row's cosine exceeds that sum by no more than its distance from its reconstruction, so a block scores those rows on
the original vectors whose bound reaches the k-th score so far, that of the block's `shortlist` best estimates included: no row is missed, however close
the vectors are to each other or far from what was learnt from. Where codes tell little, more rows are scored, at most all.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
vec_id; only vectors of equal length meet; repeated vec_ids are rows of their own,
except that a query never finds its own vec_id; fewer than k rows give them all; empty tables give empty results;
columns besides vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chunkvault.llm.common import discard, portions, store, store_each, tidy
from chunkvault.llm.vectors import Best, blocked, nearest, rounds, whole_vectors

#: At most so many vectors of a length are learnt from: those whose vec_id hashes lowest.
SAMPLE = 8192
BOOKS, WORDS, BEAM, ROUNDS, SHORTLIST = 40, 64, 4, 8, 80
BLOCK, QUERIES = 4096, 256
#: Bytes of the codebooks that tasks are given at a time.
BOOK_BYTES = 64 << 20


def learn(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 5) -> np.ndarray:
    """Codebooks (books, words, dim): k-means on the residuals, one codebook after the other."""
    rng, rest, out = np.random.default_rng(seed), x.astype(np.float32).copy(), np.zeros((books, words, x.shape[1]), np.float32)
    for book in out:
        start = rng.choice(len(rest), words, replace=len(rest) < words)
        book[:] = rest[start]
        for _ in range(ROUNDS):
            near = ((book**2).sum(1) - 2 * rest @ book.T).argmin(1)
            many = np.bincount(near, minlength=words)
            sums = np.stack([np.bincount(near, c, words) for c in rest.T], 1)
            book[many > 0] = (sums[many > 0] / many[many > 0, None]).astype(np.float32)
        rest -= book[((book**2).sum(1) - 2 * rest @ book.T).argmin(1)]
    return out


def encode(x: np.ndarray, codebooks: np.ndarray, beam: int = BEAM, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) by beam search, and the norms of the reconstructions."""
    codes, norms = np.zeros((len(x), len(codebooks)), np.uint8), np.zeros(len(x), np.float32)
    for at in range(0, len(x), chunk):
        part = x[at : at + chunk].astype(np.float32)
        rest, chosen = part[:, None, :], np.zeros((len(part), 1, 0), np.uint8)
        rows = np.arange(len(part))[:, None]
        for book in codebooks:
            width = rest.shape[1]
            error = (rest**2).sum(2)[:, :, None] + (book**2).sum(1) - 2 * rest @ book.T
            error = error.reshape(len(part), -1)
            keep = min(beam, width * len(book))
            best = np.argpartition(error, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(error, best, 1), axis=1, kind="stable"), 1)
            parent, word = best // len(book), best % len(book)
            rest = rest[rows, parent] - book[word]
            chosen = np.concatenate([chosen[rows, parent], word[:, :, None].astype(np.uint8)], 2)
        codes[at : at + chunk], norms[at : at + chunk] = chosen[:, 0], np.linalg.norm(part - rest[:, 0], axis=1)
    return codes, np.maximum(norms, 1e-9)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def codebooks(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows (dim, books): the codebooks of each length, learnt on its at most `sample` vectors whose ids hash lowest."""
    counts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    mark = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    # Few more than `sample` rows of a length come so far; the window has no more to sort.
    likely = rows.join(counts, "dim").withColumn("mark", mark).where(F.col("mark") * F.col("n") <= F.lit(float(1 << 40)) * (sample + 8 * sample**0.5 + 64))
    chosen = likely.withColumn("nth", F.row_number().over(W.partitionBy("dim").orderBy("mark", "vec_id", "v"))).where(F.col("nth") <= sample)

    def learnt(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(own.sort_values("nth")["v"].to_list())
        return pd.DataFrame({"dim": [int(key[0])], "books": [learn(_unit(_scaled(vectors))).tobytes()]})

    return chosen.select("dim", "nth", "v").groupBy("dim").applyInPandas(learnt, "dim int, books binary")


def _groups(books: DataFrame) -> Iterator[dict[int, np.ndarray]]:
    """Codebooks by length, in groups of at most BOOK_BYTES, at least one length each."""
    sizes = sorted((r["dim"], r["size"]) for r in books.select("dim", F.octet_length("books").alias("size")).collect())
    group, held = [], 0
    for dim, size in [*sizes, (None, 0)]:
        if group and (dim is None or held + size > BOOK_BYTES):
            found = books.where(F.col("dim").isin(group)).collect()
            yield {r["dim"]: np.frombuffer(r["books"], np.float32).reshape(BOOKS, WORDS, r["dim"]) for r in found}
            group, held = [], 0
        group, held = [*group, dim], held + size


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, the largest component being between 1/2 and 1: no cosine changes, and no sum of squares over- or underflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of q with the rows of v, summed from the first component to the last: equal vectors have equal scores wherever they lie."""
    dot = lambda a, b: np.cumsum(a * b, axis=-1)[..., -1]
    return dot(q, v) / (np.sqrt(dot(q, q)) * np.sqrt(dot(v, v)))


def _stored(v: np.ndarray) -> bytes:
    """Vectors as single floats where these are the same numbers, else as double ones."""
    single = v.astype(np.float32)
    return (single if (single == v).all() else v).tobytes()


def _restored(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.float64 if len(data) == 8 * rows * dim else np.float32).reshape(rows, dim).astype(np.float64)


def _kth(x: np.ndarray, k: int) -> float:
    return float(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else -np.inf


def _listed(index: DataFrame, books: dict[int, np.ndarray], asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int, shortlist: int) -> DataFrame:
    """For each query the k nearest of each task: rows (query_id, vec_id, score)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in portions(batches, 1):
            (block,) = batch.to_pylist() or [None]
            if block is None or block["dim"] not in asked:
                continue
            q_ids, q = asked[block["dim"]]
            q, own, book = _scaled(q), _unit(_scaled(q)), books[block["dim"]]
            ids, norms = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["norms"], np.float32)
            codes = np.frombuffer(block["codes"], np.uint8).reshape(-1, len(ids))
            v = _restored(block["vectors"], len(ids), block["dim"])
            unit = _unit(v)
            # Single floats: what a sum of that many products may be off.
            slack = np.linalg.norm(book, axis=2).max(1).sum() * (block["dim"] + len(book)) * 2.0**-22 + 1e-6
            beyond = np.frombuffer(block["errors"], np.float32) + np.float32(slack)
            for at in range(0, len(q_ids), QUERIES):
                tables = np.einsum("qd,bwd->qbw", own[at : at + QUERIES].astype(np.float32), book, optimize=True)
                for nth, (i, table) in enumerate(zip(q_ids[at : at + QUERIES], tables, strict=True), at):
                    dots, key = sum(t[c] for t, c in zip(table, codes, strict=True)), (block["dim"], nth, int(i))
                    most = dots + beyond
                    most[ids == i] = -np.inf
                    floor = best.floor(key)
                    floor = -np.inf if floor is None else floor
                    near = np.flatnonzero((most >= floor) & (most > -np.inf))
                    if len(near) > shortlist:
                        estimate = dots[near] / norms[near]
                        first = near[np.argpartition(estimate, len(near) - shortlist)[len(near) - shortlist :]]
                        floor = max(floor, _kth(unit[first] @ own[nth], k) - 1e-9)
                        near = near[most[near] >= floor]
                    # Products of whole blocks depend on where a row lies in the last bits, so they only choose whom to score.
                    rough = unit[near] @ own[nth] if 2 * len(near) < len(ids) else (unit @ own[nth])[near]
                    near = near[rough >= max(floor, _kth(rough, k)) - 1e-9]
                    if len(near):
                        best.add(key, _cosines(q[nth], v[near]), ids[near])
        for (_, _, i), (scores, ids) in best.held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i)), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    return index.mapInArrow(rows, "query_id long, vec_id long, score double")


@tidy
def search(vectors: DataFrame, queries: DataFrame, k: int = 5, shortlist: int = SHORTLIST, sample: int = SAMPLE) -> DataFrame:
    """For each row of queries (vec_id, embedding) the k nearest rows: query_id, rank, vec_id, score. shortlist tells how many of a block's rows are
    scored to have a bound for the others; it changes the time only."""
    nonzero = F.exists("v", lambda x: x != 0)
    rows = store(whole_vectors(vectors).where(nonzero), "aq-rows")
    asked = store(whole_vectors(queries).where(nonzero), "aq-queries")

    def lists() -> Iterator[DataFrame]:
        for books in _groups(store(codebooks(rows, sample), "aq-books")):

            def coded(ids: np.ndarray, v: np.ndarray, books=books) -> dict[str, bytes]:
                v = _scaled(v)
                (codes, norms), rest = encode(_unit(v), books[v.shape[1]]), _unit(v)
                for book, words in zip(books[v.shape[1]], codes.T, strict=True):
                    rest -= book[words]
                errors = np.linalg.norm(rest, axis=1).astype(np.float32)
                return {"ids": ids.tobytes(), "codes": codes.T.tobytes(), "norms": norms.tobytes(), "errors": errors.tobytes(), "vectors": _stored(v)}

            of_group = F.col("dim").isin(list(books))
            index = store(blocked(rows.where(of_group), BLOCK, coded, "ids binary, codes binary, norms binary, errors binary, vectors binary"), "aq-index")
            for some in rounds(asked.where(of_group)):
                yield nearest(_listed(index, books, some, k, max(k, shortlist)), k)
            discard(index)

    like = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return nearest(store_each(lists(), like, "aq-lists"), k)
