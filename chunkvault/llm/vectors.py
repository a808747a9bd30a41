"""Blocks of vectors, and rounds of queries that meet all of them.

Every query has to meet every row of its length. Rows stay where they are, in blocks of a stored table; queries go to them in rounds of at
most ROUND_BYTES, which is what a round's closure carries to the tasks. A task keeps the best of each query over all its
blocks, so what is shuffled is k rows a query and task, and no block is ever copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Bytes of query vectors that one round carries.
ROUND_BYTES = 8 << 20


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v, dim) that take part: an id, and only finite components, at least one."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    known = vectors.where("vec_id is not null and embedding is not null").where(F.size("embedding") > 0).where(sound)
    return known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim"))


def blocked(vectors: DataFrame, size: int, pack: Callable[[np.ndarray, np.ndarray], dict[str, bytes]], schema: str) -> DataFrame:
    """Rows (dim, block, ..): vectors dealt by id into blocks of at most about size rows of one length, each packed into binary columns."""
    blocks = max(1, -(-vectors.count() // size))

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        columns = pack(rows["vec_id"].to_numpy(np.int64), np.stack(rows["v"].to_list()).astype(np.float64))
        return pd.DataFrame({"dim": [int(key[0])], "block": [int(key[1])], **{k: [v] for k, v in columns.items()}})

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    # By number, since packing costs time and not bytes: adaptive execution would put all blocks into one task.
    dealt = dealt.select("dim", "block", "vec_id", "v").repartition(min(2 * blocks, 20_000), "dim", "block")
    return dealt.groupBy("dim", "block").applyInPandas(packed, f"dim int, block int, {schema}")


def rounds(queries: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Queries (vec_id, v, dim) in rounds: by length their ids and vectors, in order of id."""
    size = queries.agg(F.sum(F.col("dim").cast("long") * 8)).first()[0] or 0
    many = -(-size // ROUND_BYTES)
    for i in range(many):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(many)) == i).toPandas().sort_values("vec_id", kind="stable")
        if len(rows):
            yield {int(dim): (own["vec_id"].to_numpy(np.int64), np.stack(own["v"].to_list()).astype(np.float64)) for dim, own in rows.groupby("dim")}


class Best:
    """The k best (score, id) of each query that a task has met, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def floor(self, key: tuple):
        """The k-th score so far, None before there are k."""
        own = self.held.get(key)
        return own[0][-1] if own is not None and len(own[0]) == self.k else None

    def add(self, key: tuple, scores: np.ndarray, ids: np.ndarray) -> None:
        if (own := self.held.get(key)) is not None:
            scores, ids = np.concatenate([own[0], scores]), np.concatenate([own[1], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.held[key] = scores[order], ids[order]


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k best rows a query (query_id, rank, vec_id, score), ties to smaller vec_id; the limit is applied before the shuffle too."""
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
