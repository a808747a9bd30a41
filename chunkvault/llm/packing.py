"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents become token ids and an end mark; longer ones are cut into pieces of a whole sequence, of which the first is the
rest. Best-fit decreasing is then done over the counts of piece lengths: pieces of one length are alike, and
so are open bins of one remaining capacity, so the plan has state for each capacity only, however many documents
there are. A segment tree over remaining capacities finds the tightest that fits in logarithmic time. The plan
tells for ranks of each length their bins and offsets; a piece's rank comes from counts by partition and length, summed over
partitions. Texts are read once and never shuffled.

Edge cases: null and empty texts are the end mark alone; repeated rows are packed each; an empty table gives an empty
result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chunkvault.llm.common import portions, store, tidy

CAPACITY, END = 1024, 2
#: Rows and bytes of texts that are tokenised at a time: in larger batches fewer words repeat.
TEXT_ROWS, TEXT_BYTES = 1 << 15, 4 << 20
#: Spaces and line ends at which a cut could change the ids: next to other white space, or at either end of the text; and the mark used below.
_WHITE = r"\s\p{Z}\x{85}\x{1c}-\x{1f}\x{180e}\x{200b}\x{feff}"
UNSAFE = rf"(^[ \n]|[ \n]$|[{_WHITE}][ \n]|[ \n][{_WHITE}]|\x00)"
#: Words that are remembered, and their characters and ids together: where words are long, as in scripts without spaces, few are.
CACHED, CACHED_SIZE = 600_000, 16 << 20
#: Words that are one pre-token whatever stands around them: Latin letters after at most one space.
PLAIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


class Tokens:
    """Ids of texts. The pre-tokeniser never joins a space or line end to what stands before it, nor a full stop to the word it ends, so a
    text's ids are those of its words, each with its space; words met before come from a bounded cache. Texts with other
    white space beside a space or line end are encoded whole."""

    _loaded: dict[str, Tokens] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.fast = self._same_merges(path)
        self.line_end = self.encode(["\n"])[0]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.letters = 0
        self.flat, self.used, self.begin, self.size = np.empty(1 << 16, np.uint32), 0, np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)

    @classmethod
    def of(cls, path: str) -> Tokens:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @staticmethod
    def _same_merges(path: str):
        """The same vocabulary for tiktoken, which merges single words at a quarter of the time; None unless it is a byte-level BPE whose ids are in the order of its merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            tokenizer = json.load(f)
        model, before = tokenizer["model"], tokenizer["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or tokenizer["normalizer"]:
            return None
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merges)) or model.get("dropout") or model.get("ignore_merges"):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items() if i < 256 + len(merges)}
        return tiktoken.Encoding("words", pat_str=r"\n| ?\p{L}+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without line ends, encoded as one text with line ends between them, and the bounds of each."""
        plain = [w for w in words if PLAIN.fullmatch(w)] if self.fast and len(self.line_end) == 1 else []
        known = set(plain)
        other = [w for w in words if w not in known] if plain else words
        each = self.encode(other)
        ids = np.array(self.fast.encode_ordinary("\n".join(plain)) if plain else [], np.uint32)
        cuts = np.flatnonzero(ids == self.line_end[0])
        starts, ends = np.append(0, cuts + 1)[: len(plain)], np.append(cuts, len(ids))[: len(plain)]
        sizes = np.array([len(x) for x in each], np.int64)
        more = len(ids) + np.cumsum(sizes)
        at = dict(zip([*plain, *other], zip([*starts.tolist(), *(more - sizes).tolist()], [*ends.tolist(), *more.tolist()], strict=True), strict=True))
        return np.concatenate([ids, np.array([i for x in each for i in x], np.uint32)]), np.array([at[w] for w in words], np.int64).reshape(-1, 2)

    def _learn(self, parts: list[str]) -> None:
        """Puts parts into the cache: a part is a word after a space or, behind the mark, one that stands without."""
        words = [x[1:] if x[:1] == "\0" else " " + x for x in parts]
        tails = [w[-1] if w[-1:] in ".,!?;:" and w[-2:-1].isalpha() else "" for w in words]
        stems = [w[:-1] if t else w for w, t in zip(words, tails, strict=True)]
        new = list(dict.fromkeys(x for x in [*stems, *tails] if x and x != "\n"))
        ids, bounds = self._apart(new) if new else (np.empty(0, np.uint32), np.empty((0, 2), np.int64))
        at = {w: (a, b) for w, (a, b) in zip(new, bounds.tolist(), strict=True)}
        ids = np.append(ids, np.array(self.line_end, np.uint32))
        at["\n"], at[""] = (len(ids) - len(self.line_end), len(ids)), (0, 0)
        ends = np.array([(*at[s], *at[t]) for s, t in zip(stems, tails, strict=True)], np.int64)
        sizes = ends[:, 1] - ends[:, 0] + ends[:, 3] - ends[:, 2]
        total, first = int(sizes.sum()), len(self.index)
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while first + len(parts) > len(self.size):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
        runs = np.empty((len(parts), 2, 2), np.int64)
        runs[:, 0], runs[:, 1] = ends[:, :2], ends[:, 2:]
        self.flat[self.used : self.used + total] = _gathered(ids, runs[:, :, 0].ravel(), (runs[:, :, 1] - runs[:, :, 0]).ravel())
        self.begin[first : first + len(parts)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(parts)] = sizes
        self.used += total
        self.letters += sum(map(len, parts))
        self.index.update(zip(parts, range(first, first + len(parts)), strict=True))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's begin and end."""
        texts = pc.fill_null(texts, "")
        unsafe = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
        marked = pc.replace_substring(pc.if_else(pa.array(unsafe), "", texts), "\n", " \0\n \0")
        lists = pc.split_pattern(pc.binary_join_element_wise("\0", marked, ""), " ")
        parts, starts = lists.flatten(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        coded = parts.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.index) > CACHED or self.letters + self.used > CACHED_SIZE:
            self.clear()
        known = self.index
        if new := [w for w in words if w not in known]:
            self._learn(new)
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy(zero_copy_only=False)]
        lens = self.size[at]
        ids = _gathered(self.flat, self.begin[at], lens)
        bounds = np.concatenate([[0], np.cumsum(lens)])[np.append(starts, len(parts))]
        if not unsafe.any():
            return ids, bounds
        whole = dict(zip(np.flatnonzero(unsafe).tolist(), self.encode(texts.filter(pa.array(unsafe)).to_pylist()), strict=True))
        all_ids = [np.array(whole[i], np.uint32) if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(all_ids), np.concatenate([[0], np.cumsum([len(x) for x in all_ids])])


def _gathered(flat: np.ndarray, begins: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs of flat that begin and are as long as told, end to end."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begins - (ends - lens), lens) + np.arange(total)]


class CapacityTree:
    """A segment tree over capacities 0..n: how many runs of open bins have each."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.counts[at] += by
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """The smallest capacity of at least size that has an open bin."""
        at = size + self.leaves
        if not self.counts[at]:
            while at > 1 and (at & 1 or not self.counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at + (not self.counts[2 * at])
        return at - self.leaves


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts of lengths. Rows (length, first rank, first bin, pieces a bin, offset), by length and rank.

    The tightest bin that takes a piece stays the tightest while it still fits one of that length, so each open bin takes
    as many as fit. The rows are at most three a length and capacity, whatever the counts.
    """
    tree, runs, bins, rows = CapacityTree(capacity), [deque() for _ in range(capacity + 1)], 0, []

    def put(left: int, first: int, many: int) -> None:
        if left and many:
            runs[left].append((first, many))
            tree.add(left, 1)

    for size in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[size]
        while todo:
            left = tree.tightest(size)
            if left is None:
                left, per = capacity, capacity // size
                first, many = bins, -(-todo // per)
                bins += many
            else:
                per, (first, many) = left // size, runs[left].popleft()
                tree.add(left, -1)
            rows.append((size, rank, first, per, capacity - left))
            full, rest = min(many, todo // per), 0
            if full < many:
                rest = todo - full * per
            put(left - per * size, first, full)
            if rest:
                put(left - rest * size, first + full, 1)
            put(left, first + full + bool(rest), many - full - bool(rest))
            rank += full * per + rest
            todo -= full * per + rest
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, part, nth), and ids if asked; nth counts a partition's pieces of that length."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in portions(batches, TEXT_ROWS, TEXT_BYTES):
            ids, bounds = Tokens.of(tokenizer).batch(batch.column(1))
            which, piece, start, length, crc, nth, values = [], [], [], [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end)).astype("<u4")
                at, many = 0, -(-len(own) // capacity)
                for p in range(many):
                    size = len(own) - (many - 1) * capacity if p == 0 else capacity
                    which.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(own[at : at + size].tobytes()))
                    nth.append(int(met[size]))
                    met[size] += 1
                    if with_ids:
                        values.append(own[at : at + size].astype(np.int32))
                    at += size
            columns = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(which), pa.int32()), pa.array(nth, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                columns, names = [*columns, pa.array(values, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


@tidy
def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked."""
    pieces = store(token_pieces(docs, tokenizer, capacity, end, with_ids), "pack-pieces", TEXT_ROWS, TEXT_BYTES)
    counts = store(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("many")), "pack-counts")
    # At most as many rows as there are lengths.
    histogram = {r["length"]: r["many"] for r in counts.groupBy("length").agg(F.sum("many").alias("many")).collect()}
    plan = best_fit_plan(histogram, capacity)
    before = counts.withColumn("base", F.sum("many").over(W.partitionBy("length").orderBy("part")) - F.col("many")).drop("many")
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "base", "nth")
    keys = plan[:, 0] << 44 | plan[:, 1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, size << 44 | rank, "right") - 1] if len(size) else plan[:0]
            nth = rank - row[:, 1]
            more = [pa.array(row[:, 2] + nth // np.maximum(row[:, 3], 1)), pa.array(row[:, 4] + nth % np.maximum(row[:, 3], 1) * size)]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], [*kept, "sequence_id", "offset"])

    schema = ", ".join([f"`{c}` {t}" for c, t in ranked.dtypes if c != "rank"] + ["sequence_id long", "offset long"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return store(ranked.mapInArrow(rows, schema).select(*names), "pack-placed")
