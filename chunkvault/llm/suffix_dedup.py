"""Suffix-array dedup: bytes that a string of `width` bytes covers which also starts earlier are removed.

Equal strings of `width` bytes meet as follows. The least hash of the grams within a string names its anchor, and depends on the
string alone. Consecutive strings with one anchor are one context, the bytes they span. What is shuffled first are keys, not bytes: of
each place of an anchor that may occur more than once (a counting bitmap of fixed size spares most others the way) its anchor, the
hash of its context, document and start. Equal contexts are one, at their earliest place; all later places are covered
whole. Only contexts whose anchor has several of them are cut out of the texts, and in windows: strings that hold the anchor's
gram at about the same offset share the gram and some bytes on either side, which name their group. Equal pieces of a group are
again one at the earliest place. A group of more than HOT different pieces (a passage that very many documents have, each in its own
surroundings) is cut into narrower windows, in which all pieces but those at the passage's edge are equal; in the narrowest
every piece is one string. So no group outgrows a shard. Groups are dealt to shards of about SHARD_BYTES, each sorted by external induced
sorting with common prefixes (see induced): neighbours with a common prefix of `width` or more are equal strings, and all but the earliest
of them cover their bytes.

Edge cases: null and empty texts have no bytes; texts shorter than width lose none; rows with a null doc_id take no part
and are returned whole; a doc_id stands for one document: rows that repeat it should be equal, and if they are not, each is cut by
what was found for all of them, within its own length; empty tables give empty results; columns besides doc_id and text pass through untouched.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkvault.llm.common import discard, portions, restored, sheltered, store, tidy
from chunkvault.llm.induced import suffix_order

WIDTH, GRAM = 100, 40
#: Bytes that are hashed at a time: places within them fit 24 bits.
PART_BYTES = (1 << 24) - 1
#: Bits of the bitmap of repeated anchors; it comes to the driver in blocks of 2^16 bits.
BITS = 28
#: Anchors that a task gathers before it sends their places off.
RUN_ANCHORS = 1 << 19
#: Bytes that one shard sorts, about; different pieces of a group beyond which it is cut; and the strings of a window, level by level.
SHARD_BYTES, HOT, WINDOWS = 1 << 20, 4096, (31, 6, 1)
#: A covered range is start << SHORT | length.
SHORT = 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def contexts(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of strings that share an anchor: (document, first start, one past the last start, place of the anchor, its hash). Places are in data."""
    n, reach = len(data), width - gram + 1
    if n < width:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    powers = np.full(n + 1, _BASE)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    inverse = np.full(n - gram + 1, _INVERSE)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    hashes = _mix((sums[gram:] - sums[:-gram]) * inverse)
    keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    least, span = keys, 1
    while span * 2 <= reach:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < reach:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    # Strings that lie within one document.
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: n - width + 1]
    inside = np.flatnonzero(np.arange(n - width + 1) + width <= bounds[doc + 1])
    least, doc = least[inside], doc[inside]
    if not len(inside):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(new[1:], len(inside)) - 1
    at = (least[new] & _PLACE).astype(np.int64)
    return doc[new], inside[new], inside[last] + 1, at, hashes[at]


def _parts(texts: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts in parts of at most `most` bytes: (first text, bytes, bounds). A part of more bytes is a single text."""
    texts = pc.fill_null(texts, b"")
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        data = b"".join(x.as_py() for x in texts[at:upto])
        yield at, np.frombuffer(data, np.uint8), np.concatenate([[0], ends[at:upto] - before])
        at = upto


def document_contexts(texts: pa.Array, width: int, gram: int, part_bytes: int = PART_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, start in it, bytes, their place, one past the last start, place of the anchor, anchor) by parts; a text longer than a part is
    walked in windows that overlap by width - 1."""
    step = part_bytes - width + 1
    for first, data, bounds in _parts(texts, step):
        if len(data) <= step:
            doc, lo, hi, at, anchor = contexts(data, bounds, width, gram)
            yield doc + first, lo - bounds[doc], data, lo, hi, at, anchor
            continue
        for at in range(0, len(data), step):
            part = data[at : at + step + width - 1]
            doc, lo, hi, place, anchor = contexts(part, np.array([0, len(part)]), width, gram)
            yield doc + first, lo + at, part, lo, hi, place, anchor


def _known(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def repeated_anchors(docs: DataFrame, width: int, gram: int, part_bytes: int = PART_BYTES) -> np.ndarray:
    """A bitmap, by the low bits of anchors, of those that occur more than once (and of some that don't: the sort finds nothing in them). Places go to
    blocks as runs of 16-bit numbers, and each block is counted as they stream in, so a task holds the counts of 64 blocks, 4 MB, whatever the input."""
    low = np.uint64((1 << BITS) - 1)

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        at = np.sort(np.concatenate(held)).astype(np.int64)
        block, first = np.unique(at >> 16, return_index=True)
        raw, ends = (at & 0xFFFF).astype("<u2").tobytes(), np.append(first[1:], len(at))
        return pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array([raw[2 * a : 2 * b] for a, b in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())], ["block", "places"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in portions(batches):
            for *_, anchor in document_contexts(batch.column(0), width, gram, part_bytes):
                held.append((anchor & low).astype(np.uint32))
                if sum(map(len, held)) > RUN_ANCHORS:
                    yield sent(held)
                    held = []
        if held:
            yield sent(held)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = counts.setdefault(block, np.zeros(1 << 16, np.uint8))
                at, many = np.unique(np.frombuffer(run, "<u2"), return_counts=True)
                own[at] = np.minimum(own[at] + np.minimum(many, 2), 2)
        bits = {b: np.packbits(c == 2, bitorder="little").tobytes() for b, c in counts.items() if (c == 2).any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array(list(bits.values()), pa.binary())], ["block", "bits"])

    runs = _known(docs).select("text").mapInArrow(rows, "block int, places binary").repartition(1 << (BITS - 22), "block")
    found = store(runs.mapInArrow(counted, "block int, bits binary"), "suffix-anchors")
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in found.collect():  # at most 2^(BITS - 16) blocks of 8 KB
        out[r["block"] << 13 : (r["block"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    discard(found)
    return out


def places(docs: DataFrame, bitmap: np.ndarray, width: int, gram: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (anchor, c, doc_id, start, size, gram_at): each place of an anchor that may be repeated; c hashes the context's bytes. An anchor
    is the hash of its gram, so both together are some 120 bits of the context."""
    low = np.uint64((1 << BITS) - 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for doc, start, data, lo, hi, place, anchor in document_contexts(batch.column(1), width, gram, part_bytes):
                bit = (anchor & low).astype(np.int64)
                hit = np.flatnonzero((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                raw, size = data.tobytes(), (hi - lo + width - 1)[hit]
                marks = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + n]) for a, n in zip(lo[hit].tolist(), size.tolist(), strict=True)), np.uint64, len(hit))
                columns = [pa.array(anchor[hit].view(np.int64)), pa.array(marks.view(np.int64)), pa.array(ids[doc[hit]]), pa.array(start[hit]), pa.array(size.astype(np.int32)), pa.array((place - lo)[hit].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "c", "doc_id", "start", "size", "gram_at"])

    return _known(docs).mapInArrow(rows, "anchor long, c long, doc_id long, start long, size int, gram_at int")


def _windows(gram_at: int, size: int, width: int, gram: int, strings: int) -> Iterator[tuple[int, int, int, int]]:
    """Windows of a piece: (first, last) offset of the gram in its strings that the window stands for, and of those that the piece has."""
    least, most = gram_at - (size - width), gram_at
    for first in range(least // strings * strings, most + 1, strings):
        yield first, min(first + strings, width - gram + 1) - 1, max(first, least), min(first + strings - 1, most)


PIECE = "g long, c long, doc_id long, start long, gram_at int, piece binary"


def _pieces(rows: Iterator[tuple], width: int, gram: int, strings: int) -> pa.RecordBatch:
    """Pieces of contexts (doc_id, start, gram_at, bytes), by window: g hashes the bytes that all strings of the window share around the gram."""
    out: tuple[list, ...] = ([], [], [], [], [], [])
    for doc_id, start, gram_at, data in rows:
        for first, last, lo, hi in _windows(gram_at, len(data), width, gram, strings):
            piece = data[gram_at - hi : gram_at - lo + width]
            shared = data[gram_at - first : gram_at + width - last]
            row = (xxhash.xxh3_64_intdigest(shared, first) - (1 << 63), xxhash.xxh3_64_intdigest(piece) - (1 << 63), doc_id, start + gram_at - hi, hi, piece)
            for column, value in zip(out, row, strict=True):
                column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], [x.split()[0] for x in PIECE.split(", ")])


def cut_out(docs: DataFrame, wanted: DataFrame, width: int, gram: int, strings: int) -> DataFrame:
    """The pieces of the wanted contexts (doc_id, start, size, gram_at). A document's list of them is shorter than its text."""
    lists = wanted.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "size", "gram_at")).alias("_at"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 256):
            cut = []
            for doc_id, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                start, size, gram_at = (x.to_pylist() for x in at.values.flatten())
                cut += [(doc_id, s, g, text[s : s + n]) for s, n, g in zip(start, size, gram_at, strict=True) if text is not None and s + n <= len(text)]
            yield _pieces(iter(cut), width, gram, strings)

    return _known(docs).join(lists, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_at").mapInArrow(rows, PIECE)


def cut_again(pieces: DataFrame, width: int, gram: int, strings: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield _pieces(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "gram_at", "piece")), strict=True), width, gram, strings)

    return pieces.mapInArrow(rows, PIECE)


def covered_in_shard(rows: pd.DataFrame, width: int, gram: int) -> pd.DataFrame:
    """Rows (doc_id, range) that strings of one shard cover: each piece is at its earliest place."""
    rows = rows[rows.duplicated("g", keep=False)].sort_values(["doc_id", "start"], kind="stable")
    spans = rows["piece"].to_list()
    sizes = np.fromiter(map(len, spans), np.int64, len(spans))
    text = np.frombuffer(b"".join(spans), np.uint8)
    order, prefixes = suffix_order(text, 256, width, True)
    ends = np.cumsum(sizes)
    span_of = np.repeat(np.arange(len(spans), dtype=np.int32), sizes)
    inside = (np.arange(len(text)) - (ends - sizes)[span_of]).astype(np.int32)
    is_start = inside + width <= sizes[span_of]
    # By document and start; strings of one document have their own start each.
    rank = np.empty(len(text), np.int64)
    ids, begins = rows["doc_id"].to_numpy(np.int64), rows["start"].to_numpy(np.int64)
    rank[np.lexsort((begins[span_of] + inside, ids[span_of]))] = np.arange(len(text))
    group = np.cumsum(prefixes < width)
    own = is_start[order]
    order, group = order[own], group[own]
    hit = np.zeros(len(text), bool)
    if len(order):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        earliest = np.repeat(np.minimum.reduceat(rank[order], first), np.diff(np.append(first, len(order))))
        hit[order[rank[order] != earliest]] = True
    at = np.flatnonzero(hit)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(span_of[at]) != 0)])) if len(at) else at
    last = np.append(new[1:], len(at)) - 1 if len(at) else at
    a, b = at[new], at[last]
    return pd.DataFrame({"doc_id": ids[span_of[a]], "range": (begins[span_of[a]] + inside[a] << SHORT) | (b - a + width)})


def _range(start, size):
    return F.shiftleft(start, SHORT).bitwiseOR(size.cast("long"))


def _later(rows: DataFrame, firsts: DataFrame, key: list[str], size) -> DataFrame:
    """The ranges of rows whose bytes stand at an earlier place too; firsts has that of each key, and many, how often it occurs."""
    found = firsts.where("many > 1").select(*key, F.col("doc_id").alias("_doc"), F.col("start").alias("_start"))
    both = rows.select(*key, "doc_id", "start", size.alias("_size")).join(found, key)
    return both.where("doc_id <> _doc or start <> _start").select("doc_id", _range(F.col("start"), F.col("_size")).alias("range"))


def coverage(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, part_bytes: int = PART_BYTES, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, range): byte ranges that repeat what starts earlier, as start << SHORT | length; they may overlap."""
    many = F.count(F.lit(1)).alias("many")
    found = store(places(docs, repeated_anchors(docs, width, gram, part_bytes), width, gram, part_bytes), "suffix-places")
    first = F.min(F.struct("doc_id", "start", "size", "gram_at")).alias("first")
    firsts = store(found.groupBy("anchor", "c").agg(first, many).select("anchor", "c", "first.*", "many"), "suffix-contexts")
    covered = [store(_later(found, firsts, ["anchor", "c"], F.col("size")), "suffix-covered")]
    discard(found)
    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    wanted = store(firsts.join(several, "anchor", "left_semi").select("doc_id", "start", "size", "gram_at"), "suffix-wanted")
    discard(firsts)

    pieces, sorted_here = store(cut_out(docs, wanted, width, gram, WINDOWS[0]), "suffix-pieces"), []
    for strings in [*WINDOWS[1:], 0]:
        first = F.min(F.struct("doc_id", "start", "gram_at", "piece")).alias("first")
        alive = store(pieces.groupBy("g", "c").agg(first, many).select("g", "c", "first.*", "many"), "suffix-distinct")
        covered.append(store(_later(pieces, alive, ["g", "c"], F.length("piece")), "suffix-covered"))
        discard(pieces)
        crowded = store(alive.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("g"), "suffix-hot")
        if not strings or not crowded.count():
            sorted_here.append(alive)
            break
        sorted_here.append(alive.join(crowded, "g", "left_anti"))
        pieces = store(cut_again(alive.join(crowded, "g", "left_semi"), width, gram, strings), "suffix-pieces")

    to_sort = functools.reduce(DataFrame.unionByName, [x.select("g", "doc_id", "start", "piece") for x in sorted_here])
    shards = int(to_sort.agg(F.sum(F.length("piece"))).first()[0] or 0) // SHARD_BYTES + 1
    by_shard = to_sort.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards)).cast("int")).groupBy("shard")
    covered.append(store(by_shard.applyInPandas(lambda rows: covered_in_shard(rows, width, gram), "doc_id long, range long"), "suffix-covered"))
    return functools.reduce(DataFrame.unionByName, covered)


def without_repeats(docs: DataFrame, covered: DataFrame, with_text: bool = True) -> DataFrame:
    """docs without the covered bytes, with n_bytes, n_removed, n_spans and kept_sha256; with_text keeps the text column (as what is left, replaced
    where a character was cut). A document's ranges come from its own contexts, so its list of them is no longer than a few times its text."""
    inner = sheltered(docs, ["doc_id", "text"])
    kept = [c for c in inner.columns if c != "text"]
    per_doc = covered.groupBy(F.col("doc_id").alias("_key")).agg(F.array_sort(F.collect_set("range")).alias("_ranges"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            out = []
            for text, ranges in zip(batch.column("_text"), batch.column("_ranges"), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                left, spans, at = [], 0, 0
                if ranges.is_valid:
                    own = ranges.values.to_numpy()
                    start = np.minimum(own >> SHORT, len(data))
                    end = np.maximum.accumulate(np.minimum(start + (own & ((1 << SHORT) - 1)), len(data)))
                    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]) & (start < end))
                    for x, y in zip(start[new].tolist(), end[np.append(new[1:], len(start)) - 1].tolist(), strict=True):
                        left.append(data[at:x])
                        at, spans = y, spans + 1
                left.append(data[at:])
                rest = b"".join(left)
                out.append((rest, len(data), len(data) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            new_cols = [*(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.string())]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                new_cols, names = [pa.array([x.decode("utf-8", "replace") for x in cols[0]], pa.string()), *new_cols], ["_text", *names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new_cols], [*kept, *names])

    joined = inner.join(per_doc, F.col("doc_id").cast("long") == F.col("_key"), "left").select(*kept, F.col("text").cast("binary").alias("_text"), "_ranges")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in inner.dtypes if c != "text"), *(["_text string"] if with_text else []), "n_bytes long, n_removed long, n_spans long, kept_sha256 string"])
    out, added = joined.mapInArrow(rows, schema), ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return restored(out.withColumnRenamed("_text", "text"), docs, added) if with_text else out.select("doc_id", *added)


@tidy
def dedup_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs with text cut; see without_repeats."""
    return store(without_repeats(docs, coverage(docs, width, gram)), "suffix-kept")


@tidy
def substring_digest(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The columns of the contract, without writing texts."""
    docs = docs.select("doc_id", "text")
    return store(without_repeats(docs, coverage(docs, width, gram), with_text=False), "suffix-kept")
