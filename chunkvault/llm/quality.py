"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a document say how its bytes, words and lines are made up and how often they repeat. Trees are grown on a sample of
labelled rows of a documented bound (`sample`), whose ids go to every task, so that only labelled texts are looked at;
features are cut into at most 64 quantile bins, and the trees of one fixed depth are flattened into arrays that
numpy walks for a whole batch at once. Then one pass over all texts takes their statistics and scores them: nothing is shuffled.

Edge cases: null and empty texts have statistics of zeros and are scored; labels that are null, or whose document is
missing, are left out; of rows that repeat a labelled doc_id one is learnt from, that of the least statistics; without labels of both kinds every score is the mean label (1 without any); repeated rows
are scored each; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from chunkvault.llm.common import portions, store, tidy
from chunkvault.llm.near_dup import word_hashes

#: At most so many labelled rows are learnt from: those whose doc_id hashes lowest.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, L2 = 80, 4, 0.15, 64, 20, 1.0

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "line": (10,), "control": [*range(0, 9), *range(11, 32), 127],
    "high": range(128, 256), "stop": b".,;:", "shout": b"!?", "quote": b"\"'`", "bracket": b"()[]{}", "angle": b"<>", "bar": b"|", "other": b"#$%&*+-/=@\\^_~",
}
STATISTICS = [*_CLASSES, "bytes", "words", "lines", "entropy", "word_mean", "word_max", "word_sd", "words_distinct", "word_top", "pairs_distinct", "again", "lines_distinct", "line_mean", "line_end", "line_sd"]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    texts = pc.fill_null(texts, "")
    raw = texts.cast(pa.binary())
    counts = np.zeros((len(texts), 256))
    lines = np.zeros((len(texts), 4))
    for i, text in enumerate(raw):
        data = text.as_buffer().to_pybytes()
        counts[i] = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        rows = [x for x in data.split(b"\n") if x]
        if rows:
            sizes = np.fromiter(map(len, rows), float, len(rows))
            lines[i] = len(set(rows)) / len(rows), sizes.mean(), sum(x.rstrip()[-1:] in b".!?:\"" and bool(x.strip()) for x in rows) / len(rows), sizes.std()
    size = counts.sum(1)
    some = np.maximum(size, 1)[:, None]
    shares = np.stack([counts[:, list(c)].sum(1) for c in _CLASSES.values()], 1) / some
    p = counts / some
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    hashes, bounds = word_hashes(texts)
    split = pc.ascii_split_whitespace(texts).flatten()
    lengths = pc.binary_length(split).to_numpy(zero_copy_only=False)
    lengths = lengths[lengths > 0].astype(float)
    words = np.zeros((len(texts), 7))
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b > a:
            own, wide = hashes[a:b], lengths[a:b]
            _, many = np.unique(own, return_counts=True)
            pairs = own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:]
            words[i] = wide.mean(), wide.max(), wide.std(), len(many) / (b - a), many.max() / (b - a), (len(np.unique(pairs)) / len(pairs) if len(pairs) else 1), ((own[:-1] == own[1:]).mean() if b - a > 1 else 0)
    n_words = np.diff(bounds)
    out = np.concatenate([shares, size[:, None], n_words[:, None], counts[:, 10:11] + 1, entropy[:, None], words, lines], 1)
    return out


def _features(texts: pa.Array) -> np.ndarray:
    return statistics(texts).astype(np.float32)


def document_statistics(docs: DataFrame) -> DataFrame:
    """docs (with a column text) with stats array<float> in place of the text."""
    kept = [c for c in docs.columns if c != "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            stats = _features(batch.column("text"))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), values], [*kept, "stats"])

    return docs.mapInArrow(rows, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c != "text"), "stats array<float>"]))


@dataclass
class Trees:
    """Complete binary trees of one depth, flattened: feature and cut for inner nodes, value for leaves."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
                if not len(at) or at[0] >= len(feature):
                    break
            total += value[at - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosts trees for the logistic loss; each level's splits come from histograms of gradients by node, feature and bin."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    mean = y.mean() if len(y) else 1.0
    start = float(np.log(max(mean, 1e-3) / max(1 - mean, 1e-3)))
    if not 0 < mean < 1:
        return Trees(500.0 if mean else -500.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    width = x.shape[1]
    flat = binned + np.arange(width) * BINS
    raw = np.full(len(y), start)
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node, feature, cut = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            nodes, base = 1 << level, (1 << level) - 1
            cell = (((node - base) * (width * BINS))[:, None] + flat).ravel()
            sums = [np.bincount(cell, np.repeat(w, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(2) for w in (g, h, np.ones_like(g))]
            (gl, hl, nl), ends = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + L2) + (ends[0] - gl) ** 2 / (ends[1] - hl + L2) - ends[0] ** 2 / (ends[1] + L2)
            gain[(nl < LEAST_LEAF) | (ends[2] - nl < LEAST_LEAF)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[base + k], cut[base + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        raw += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(start, np.array(features), np.array(cuts), np.array(values))


def held_out(doc_id):
    """Rows whose labels are never learnt from; a null doc_id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from the labelled rows that are not held out, at most `sample` of them."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)  # two numbers a row: small enough for every task
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    stats = store(document_statistics(labelled).groupBy("doc_id", "quality").agg(F.min("stats").alias("stats")), "quality-stats")
    rows = stats.toPandas().sort_values(["doc_id", "quality"])
    x = np.stack(rows["stats"].to_list()).astype(np.float32) if len(rows) else np.empty((0, len(STATISTICS)), np.float32)
    return grow(x.astype(float), rows["quality"].to_numpy(float))


@tidy
def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    trees = fit(docs, labels, sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found = trees.scores(_features(batch.column(1)).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = store(texts.mapInArrow(rows, "doc_id long, score double, predicted int"), "quality-scores")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@tidy
def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose text scores threshold or more, each judged by its own text, as score() does; rows without doc_id stay."""
    trees = fit(docs, labels, sample)

    @F.arrow_udf(BooleanType())
    def good(texts: pa.Array) -> pa.Array:
        parts = portions(iter([pa.RecordBatch.from_arrays([texts], ["text"])]))
        return pa.array(np.concatenate([trees.scores(_features(p.column(0)).astype(float)) >= threshold for p in parts]))

    return store(docs.where(F.col("doc_id").isNull() | good("text")), "quality-accepted")
