"""Line dedup that can be taken back: sharded cuckoo filters over exact reference-count tables.

A line's key is the line stripped of ASCII space and with A-Z lowered; keys of at least min_chars code points take
part, by their 128-bit hash. Postings say which document holds which key. Reference counts say in how many documents a
key is, and the smallest of them, for every key. A shard of the key space has a cuckoo filter of the keys held by two documents or more:
postings are probed against their shard's filter, and only those it lets through meet the exact counts.

The index is kept in layers. Inserting documents appends their postings and the counts of the keys they touch, raised by what they bring;
deleting documents appends their ids and the counts of their keys, lowered, and looks up the smallest holder again only of keys that lose theirs.
Keys that come to two documents go into the filters and keys that fall below are taken out, so the index after a deletion is the
one that never saw the documents. Work is in proportion to the change, but for reading key tables; after LAYERS changes the layers are merged. A filter that
would be more than four fifths full is built anew, twice as large, from the exact counts; the number of shards grows with the keys.

Postings of a hot key are salted by document for the probe, counted by partial aggregates, and joined
by a plain equi-join that adaptive execution can split.

Edge cases: a null or empty text is one empty line; rows with a null doc_id are returned whole, and neither count
nor lose lines; rows that repeat a doc_id are one document, which holds the lines of all of them; inserting a
document that is held raises ValueError, deleting one that is not does nothing; empty tables give empty results; columns besides
doc_id and text pass through untouched.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkvault.llm.common import portions, restored, sheltered, store, tidy

STRIPPED = b" \t\n\x0b\x0c\r"
SLOTS, KICKS = 4, 500
SHARD_KEYS, PROBE_ROWS = 50_000, 20_000
#: How full a filter may be, and the layers that a table of the index may have.
FULL, LAYERS = 0.8, 8
KEY = ["h1", "h2"]
_KEY = np.dtype([("h1", "<i8"), ("h2", "<i8")])


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; what finds no room after some kicks goes to a stash, so no key is ever lost."""

    def __init__(self, cells: np.ndarray, stash: list[tuple[int, int]] | None = None):
        self.cells, self.stash = cells, stash or []

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(keys / (SLOTS * FULL)).bit_length())
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    def takes(self, keys: int) -> bool:
        """Whether so many more keys leave it no more than FULL."""
        return np.count_nonzero(self.cells) + len(self.stash) + keys <= FULL * self.cells.size

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets, stashed = np.frombuffer(data[:16], "<i8")
        cells = np.frombuffer(data[16 : 16 + buckets * SLOTS * 2], "<u2").reshape(buckets, SLOTS).copy()
        stash = np.frombuffer(data[16 + buckets * SLOTS * 2 :], "<i8").reshape(stashed, 2)
        return cls(cells, [tuple(x) for x in stash.tolist()])

    def to_bytes(self) -> bytes:
        stash = np.array(self.stash, "<i8").reshape(-1, 2)
        return np.array([len(self.cells), len(stash)], "<i8").tobytes() + self.cells.astype("<u2").tobytes() + stash.tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of 64-bit keys."""
        keys = keys.astype(np.uint64)
        mark = (keys & np.uint64(0xFFFF)).astype(np.int64)
        mark[mark == 0] = 1
        first = ((keys >> np.uint64(16)) & np.uint64(len(self.cells) - 1)).astype(np.int64)
        return mark, first, first ^ self._turn(mark)

    def _turn(self, mark):
        return (mark * 0x5BD1E995 >> 7) & (len(self.cells) - 1)

    def insert(self, keys: np.ndarray) -> None:
        for mark, one, two in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            at = one
            for bucket in (one, two):
                free = np.flatnonzero(self.cells[bucket] == 0)
                if len(free):
                    self.cells[bucket, free[0]] = mark
                    break
            else:
                for kick in range(KICKS):
                    slot = (mark + kick) % SLOTS
                    mark, self.cells[at, slot] = int(self.cells[at, slot]), mark
                    at ^= int(self._turn(mark))
                    free = np.flatnonzero(self.cells[at] == 0)
                    if len(free):
                        self.cells[at, free[0]] = mark
                        break
                else:
                    self.stash.append((mark, at))

    def delete(self, keys: np.ndarray) -> None:
        """Takes out keys that were inserted."""
        for mark, one, two in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            for bucket in (one, two):
                if len(found := np.flatnonzero(self.cells[bucket] == mark)):
                    self.cells[bucket, found[0]] = 0
                    break
            else:
                self.stash.remove((mark, one) if (mark, one) in self.stash else (mark, two))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(keys)
        found = (self.cells[one] == mark[:, None]).any(1) | (self.cells[two] == mark[:, None]).any(1)
        for m, b in self.stash:
            found |= (mark == m) & ((one == b) | (two == b))
        return found


def line_keys(data: bytes, min_chars: int) -> list[bytes]:
    """For each line its 16-byte hash, or b'' where the line's key is too short."""
    out = []
    for line in data.lower().split(b"\n"):
        key = line.strip(STRIPPED)
        short = len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars)
        out.append(b"" if short else xxhash.xxh3_128_digest(key))
    return out


def postings(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Distinct (doc_id, h1, h2) of the lines that take part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            ids, counts, keys = batch.column(0).to_numpy(zero_copy_only=False), [], []
            for text in batch.column(1):
                own = set(line_keys(text.as_buffer().to_pybytes(), min_chars) if text.is_valid else ())
                own.discard(b"")
                counts.append(len(own))
                keys += own
            found = np.frombuffer(b"".join(keys), _KEY)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(found["h1"]), pa.array(found["h2"])], ["doc_id", "h1", "h2"])

    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = known.mapInArrow(rows, "doc_id long, h1 long, h2 long")  # distinct by row
    repeated = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return found.distinct() if repeated else found


def _union(layers: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, layers)


def _built(keys: pd.DataFrame) -> bytes:
    own = CuckooFilter.sized(max(2 * len(keys), SHARD_KEYS // 8))
    own.insert(keys["h2"].to_numpy(np.int64))
    return own.to_bytes()


@dataclass(frozen=True)
class LineIndex:
    """The state of line dedup, as layers of tables in the shared folder; at is the number of changes that led to it.

    docs: (number, doc_id) and held: (number, doc_id, h1, h2), what an insertion brought; gone: (number, doc_id), what a deletion took; counts: h1, h2, refs, first and
    at, of which the latest holds; filters: shard, cells and at likewise; keys: how many are in filters.
    """

    docs: list[tuple[int, DataFrame]]
    held: list[tuple[int, DataFrame]]
    gone: list[tuple[int, DataFrame]]
    counts: list[DataFrame]
    filters: list[DataFrame]
    shards: int
    keys: int
    min_chars: int
    at: int = 0

    @staticmethod
    def _shard(shards: int):
        return F.pmod(F.col("h1"), F.lit(shards)).cast("int")

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = 10) -> LineIndex:
        held = store(postings(docs, min_chars), "lines-held")
        counts = held.groupBy(*KEY).agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first"), F.lit(0).alias("at"))
        counts = store(counts, "lines-counts")
        ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        keys = counts.where("refs > 1").count()
        return cls([(0, ids)], [(0, held)], [], [counts], [], 1, keys, min_chars)._refiltered()

    def _live(self, layers: list[tuple[int, DataFrame]]) -> DataFrame:
        """The rows of layers whose documents no later deletion took."""
        out = []
        for number, rows in layers:
            for later, gone in self.gone:
                rows = rows.join(gone, "doc_id", "left_anti") if later > number else rows
            out.append(rows)
        return _union(out)

    def live(self) -> DataFrame:
        """Postings (doc_id, h1, h2) of the documents that the index holds."""
        return self._live(self.held)

    def refs(self, keys: DataFrame | None = None) -> DataFrame:
        """Rows (h1, h2, refs, first), of all keys or of those given."""
        layers = [c if keys is None else c.join(keys, KEY, "left_semi") for c in self.counts]
        if len(layers) > 1:
            latest = _union(layers).groupBy(*KEY).agg(F.max_by(F.struct("refs", "first"), "at").alias("c"))
            return latest.select(*KEY, "c.*").where("refs > 0")
        return layers[0].select(*KEY, "refs", "first").where("refs > 0")

    def _cells(self) -> DataFrame:
        return _union(self.filters).groupBy("shard").agg(F.max_by("cells", "at").alias("cells"))

    def _refiltered(self) -> LineIndex:
        """All filters built anew, with shards as the keys need them."""
        shards = self.keys // SHARD_KEYS + 1
        by_shard = self.refs().where("refs > 1").select(*KEY, self._shard(shards).alias("shard")).groupBy("shard")
        at = self.at
        made = by_shard.applyInPandas(lambda shard, keys: pd.DataFrame({"shard": [int(shard[0])], "cells": [_built(keys)], "at": [at]}), "shard int, cells binary, at int")
        return replace(self, shards=shards, filters=[store(made, "lines-filters")])

    def _filtered(self, changes: DataFrame) -> LineIndex:
        """The filters after the keys of changes (h1, h2, up) went in or out, those of shards that they touch."""
        moved = changes.agg(F.count_if("up").alias("up"), F.count_if(~F.col("up")).alias("down")).first()
        index, at = replace(self, keys=self.keys + moved["up"] - moved["down"]), self.at
        if not moved["up"] + moved["down"]:
            return index
        if index.keys > 2 * SHARD_KEYS * index.shards:
            return index._refiltered()

        def change(shard: tuple, keys: pd.DataFrame, was: pd.DataFrame) -> pd.DataFrame:
            if not len(keys):
                return pd.DataFrame({"shard": [], "cells": [], "at": []})
            up = keys["up"].to_numpy(bool)
            own = CuckooFilter.from_bytes(was["cells"].iloc[0]) if len(was) else CuckooFilter.sized(SHARD_KEYS // 8)
            own.delete(keys["h2"].to_numpy(np.int64)[~up])
            if not own.takes(int(up.sum())):
                return pd.DataFrame({"shard": [int(shard[0])], "cells": [None], "at": [at]})
            own.insert(keys["h2"].to_numpy(np.int64)[up])
            return pd.DataFrame({"shard": [int(shard[0])], "cells": [own.to_bytes()], "at": [at]})

        by_shard = changes.select(*KEY, "up", self._shard(self.shards).alias("shard")).groupBy("shard")
        made = store(by_shard.cogroup(self._cells().groupBy("shard")).applyInPandas(change, "shard int, cells binary, at int"), "lines-filters")
        full = [r["shard"] for r in made.where("cells is null").select("shard").collect()]  # at most one a shard
        layers = [*self.filters, made.where("cells is not null")]
        if full:
            crowded = index.refs().where("refs > 1").select(*KEY, self._shard(self.shards).alias("shard")).where(F.col("shard").isin(full)).groupBy("shard")
            again = crowded.applyInPandas(lambda shard, keys: pd.DataFrame({"shard": [int(shard[0])], "cells": [_built(keys)], "at": [at]}), "shard int, cells binary, at int")
            layers.append(store(again, "lines-filters"))
        return replace(index, filters=layers)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with docs added."""
        ids = store(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "lines-ids")
        if ids.join(self._live(self.docs), "doc_id", "left_semi").limit(1).count():
            raise ValueError("the index holds some of these documents")
        new = store(postings(docs, self.min_chars), "lines-new")
        touched = store(new.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "lines-touched")
        old = self.refs(touched.select(*KEY)).withColumnsRenamed({"refs": "was", "first": "had"})
        both = touched.join(old, KEY, "left").withColumn("was", F.coalesce("was", F.lit(0)))
        now = both.select(*KEY, "was", (F.col("was") + F.col("n")).alias("refs"), F.least("least", "had").alias("first"))
        grown = replace(self, docs=[*self.docs, (self.at + 1, ids)], held=[*self.held, (self.at + 1, new)], at=self.at + 1)
        return grown._counted(now)

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without the documents whose doc_id is in docs."""
        ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        ids = store(ids.join(self._live(self.docs), "doc_id", "left_semi"), "lines-gone")
        lost = self.live().join(ids, "doc_id", "left_semi")
        touched = store(lost.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "lines-touched")
        left = replace(self, gone=[*self.gone, (self.at + 1, ids)], at=self.at + 1)
        both = store(touched.join(self.refs(touched.select(*KEY)), KEY), "lines-lowered")
        orphans = both.where("least = first and refs > n").select(*KEY)
        heirs = left.live().join(orphans, KEY, "left_semi").groupBy(*KEY).agg(F.min("doc_id").alias("heir"))
        now = both.join(heirs, KEY, "left").select(*KEY, F.col("refs").alias("was"), (F.col("refs") - F.col("n")).alias("refs"), F.coalesce("heir", "first").alias("first"))
        return left._counted(now)

    def _counted(self, now: DataFrame) -> LineIndex:
        """The index with the counts of now (h1, h2, was, refs, first) and the filters that follow from them."""
        now = store(now, "lines-counts")
        moved = replace(self, counts=[*self.counts, now.select(*KEY, "refs", "first", F.lit(self.at).alias("at"))])
        crossed = now.where("(was > 1) <> (refs > 1)").select(*KEY, (F.col("refs") > 1).alias("up"))
        return moved._filtered(crossed)._merged()

    def _merged(self) -> LineIndex:
        """Layers merged into one where there are too many."""
        out = self
        if len(out.held) + len(out.gone) > LAYERS:
            out = replace(out, docs=[(out.at, store(out._live(out.docs), "lines-ids"))], held=[(out.at, store(out.live(), "lines-held"))], gone=[])
        if len(out.counts) > LAYERS:
            out = replace(out, counts=[store(out.refs().withColumn("at", F.lit(out.at)), "lines-counts")])
        if len(out.filters) > LAYERS:
            out = replace(out, filters=[store(out._cells().withColumn("at", F.lit(out.at)), "lines-filters")])
        return out

    def suspects(self) -> DataFrame:
        """Postings that their shard's filter lets through."""
        held = self.live()
        salts = max(1, -(-held.count() // (self.shards * PROBE_ROWS)))

        def probe(keys: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(keys):
                return keys[["doc_id", *KEY]].iloc[:0]
            return keys.loc[CuckooFilter.from_bytes(own["cells"].iloc[0]).contains(keys["h2"].to_numpy(np.int64)), ["doc_id", *KEY]]

        dealt = held.withColumn("shard", self._shard(self.shards)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        copies = self._cells().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(probe, "doc_id long, h1 long, h2 long")

    def drops(self) -> DataFrame:
        """Per document that loses lines: doc_id and drops, the hashes of the keys that it loses, end to end."""
        lost = self.suspects().join(self.refs().where("refs > 1").select(*KEY, "first"), KEY).where("doc_id > first")
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("drops"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with text replaced by the kept lines, and n_lines, n_dropped and kept_sha256 added."""
        return kept_lines(docs, self.drops(), self.min_chars)


def kept_lines(docs: DataFrame, drops: DataFrame, min_chars: int = 10, with_text: bool = True) -> DataFrame:
    """See LineIndex.apply; drops as LineIndex.drops gives them."""
    inner = sheltered(docs, ["doc_id", "text"])
    kept = [c for c in inner.columns if c != "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts, n_lines, n_dropped, digests = [], [], [], []
            for text, lost in zip(batch.column("_text"), batch.column("_drops"), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                lines = data.split(b"\n")
                n_lines.append(len(lines))
                if lost.is_valid and len(lost.values):
                    gone = lost.values.flatten()
                    pairs = np.empty(len(lost.values), _KEY)
                    pairs["h1"], pairs["h2"] = (x.to_numpy(zero_copy_only=False) for x in gone)
                    raw = pairs.tobytes()
                    gone = {raw[i : i + 16] for i in range(0, len(raw), 16)}
                    lines = [x for x, key in zip(lines, line_keys(data, min_chars), strict=True) if not key or key not in gone]
                    data = b"\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append(data if text.is_valid else None)
                digests.append(hashlib.sha256(data).hexdigest())
            new = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())]
            names = ["n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                new, names = [pa.array(texts, pa.binary()), *new], ["_text", *names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, *names])

    joined = inner.join(drops.withColumnsRenamed({"doc_id": "_key", "drops": "_drops"}), F.col("doc_id").cast("long") == F.col("_key"), "left")
    joined = joined.select(*kept, F.col("text").cast("binary").alias("_text"), "_drops")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in inner.dtypes if c != "text"), *(["_text binary"] if with_text else []), "n_lines long, n_dropped long, kept_sha256 string"])
    out, added = joined.mapInArrow(rows, schema), ["n_lines", "n_dropped", "kept_sha256"]
    return restored(out.withColumn("text", F.col("_text").cast("string")), docs, added) if with_text else out.select("doc_id", *added)


@tidy
def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with the lines that stay; see LineIndex.apply."""
    return store(kept_lines(docs, store(LineIndex.build(docs, min_chars).drops(), "lines-drops"), min_chars), "lines-kept")


@tidy
def line_digest(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """The columns of the contract, without writing texts."""
    docs = docs.select("doc_id", "text")
    return store(kept_lines(docs, store(LineIndex.build(docs, min_chars).drops(), "lines-drops"), min_chars, with_text=False), "lines-kept")
