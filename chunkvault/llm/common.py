"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chunkvault.storage import discard, store, store_each, tidy  # noqa: F401  (operators take them from here)

#: Words are maximal runs of anything but these six characters (fixed values).
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
#: What Python works on at a time is bounded by rows and by bytes, as single texts may be very long.
BATCH_ROWS, BATCH_BYTES = 4096, 2 << 20


def sheltered(docs: DataFrame, own: Iterable[str]) -> DataFrame:
    """docs with all columns but own named by their place, so that no name can clash with an operator's; see restored."""
    own = set(own)
    return docs.toDF(*[c if c in own else f"__{i}" for i, c in enumerate(docs.columns)])


def restored(out: DataFrame, docs: DataFrame, added: Iterable[str] = ()) -> DataFrame:
    """The columns of docs by their names, then added ones, which take the place of columns of that name."""
    added = list(added)
    kept = [(f"__{i}" if f"__{i}" in out.columns else c, c) for i, c in enumerate(docs.columns) if c not in added]
    return out.select(*[F.col(inner).alias(c) for inner, c in kept], *added)


def portions(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has at most `rows` rows and about `size` bytes of texts, at least one row. What Spark hands to Python is bounded by
    its own settings, which stay as the session has them."""
    for batch in batches:
        if batch.num_rows <= max(rows, 1) and batch.nbytes <= size:
            yield batch
            continue
        wide = np.full(batch.num_rows, 8 * batch.num_columns, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                wide += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(wide), 0
        while at < batch.num_rows:
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            upto = max(at + 1, min(at + rows, most))
            yield batch.take(pa.array(np.arange(at, upto)))  # a copy: slices would keep the offsets into the whole batch
            at = upto


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """docs with one row of each doc_id, that of the least text (then of the least hash of the row); rows without doc_id stay. Only rows that
    repeat a doc_id are compared; where none does, docs is returned as it is."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if not ids.limit(1).count():
        return docs
    again = store(ids, "repeated-ids")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = W.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first(), F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0))
    chosen = docs.join(again, "doc_id", "left_semi").withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
    return docs.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(chosen.select(*docs.columns))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_bits(n: int) -> int:
    """Bits of a bucket number such that buckets hold about as many rows as there are buckets."""
    return max(0, min(20, (max(n, 1).bit_length() - 1) // 2))


def bucket_of(key: Column, bits: int) -> Column:
    """The first bits of md5(key), null as the empty string: buckets sort as the md5 does."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 5)
    return F.shiftright(F.conv(head, 16, 10).cast("long"), 20 - bits)
