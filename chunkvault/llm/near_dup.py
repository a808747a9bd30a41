"""Near duplicates by bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct five-word shingles; its sketch the k smallest of them. Documents with
equal sets form a class, and only its smallest doc_id goes on. Inverted lists of the retained values generate pairs:
two linked documents share at least `least` retained values (shared_least() derives it from the threshold: a link of just
that similarity shares fewer with probability below 1e-12; at 0.85 it is 10 of 32, at 0.8 7), so a document whose sketch has fewer values that anyone else retains is out,
and of the others the rarest values but least - 1 are indexed. The shingles that no other indexed document has bound
what a document can share with any other, which rules out edited copies in numbers. In each list every document
is paired with the one that has the least of them; that links most of a large group with as many pairs as documents.
Where a list still spans several components, each document outside its largest one is paired with all others of the
list that neither this bound nor the sketch of the union, from larger sketches, rules out. Exact Jaccard over the full sets confirms pairs; components
come from the confirmed links, by label passing over tables in the shared folder.

Edge cases: null texts and texts without words have empty sets and no links; fewer than five words are one shingle;
rows with a null doc_id have no links and no component; rows that repeat a doc_id are one document, that of the least text, and
each gets its result; empty tables give empty results; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkvault.llm.common import one_row_per_id, portions, store, tidy

#: Sketch sizes, the larger one for the pairs of open lists, and the probabilities that a link falls short of shared_least().
K, MISS = 32, 1e-12
WIDE, WIDE_MISS = 256, 1e-12


def shared_least(k: int, percent: int, miss: float) -> int:
    """The most values of which two sets of that similarity share fewer, among the k least of their union, with probability below miss."""
    p, short, least = percent / 100, 0.0, 0
    while least < k and (short := short + math.comb(k, least) * p**least * (1 - p) ** (k - least)) < miss:
        least += 1
    return max(least, 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lowered words of all texts, and where each text's words begin and end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.values
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words = lists.flatten()
    real = pc.not_equal(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    coded = words.filter(real).dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return (known[codes] if len(codes) else np.empty(0, np.uint64)), upto[bounds]


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    hashes, bounds = word_hashes(texts)
    scale = _mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    n = len(hashes) - width + 1
    whole = _mixed(sum(hashes[i : i + n] * scale[i] for i in range(width))) if n > 0 else np.empty(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            out.append(_mixed((hashes[a:b] * scale[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketches(docs: DataFrame, k: int = K, width: int = 5) -> DataFrame:
    """Rows (doc_id, n, f1, f2, sketch): set size, 128-bit hash of the set, and the k smallest values."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            sets = shingle_sets(batch.column(1), width)
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            few = [(s[:k] >> np.uint64(1)).view(np.int64) for s in sets]  # 63 bits, so that Spark orders them alike
            ends = np.concatenate([[0], np.cumsum([len(s) for s in few])]).astype(np.int32)
            values = np.concatenate(few) if few else np.empty(0, np.int64)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "n", "f1", "f2", "sketch"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n long, f1 long, f2 long, sketch array<long>")


def _possible(n: str, p: str, m: str, q: str, percent: int) -> str:
    """Whether sets of sizes n and m, with p and q members that none other has, can be similar enough."""
    common = f"least({n} - {p}, {m} - {q})"
    return f"100 * {common} >= {percent} * ({n} + {m} - {common})"


def retained_lists(reps: DataFrame, k: int, least: int, percent: int) -> DataFrame:
    """Rows (value, doc, n): the inverted lists of the rarest retained values of documents that may have a link."""
    entries = reps.select("doc_id", F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    per_doc = entries.join(shared, "value").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("held"))
    need = F.least(F.lit(least), F.ceil(F.col("n") * percent / 100)).cast("int")
    indexed = per_doc.join(reps.select("doc_id", "n"), "doc_id").withColumn("extra", F.size("held") - need + 1).where("extra > 0")
    return indexed.select(F.col("doc_id").alias("doc"), "n", F.explode(F.slice(F.col("held.value"), F.lit(1), F.col("extra"))).alias("value"))


def private_counts(texts: DataFrame, width: int = 5) -> DataFrame:
    """Rows (doc, p): how many shingles of a document of texts (doc_id, text) no other of them has."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            sets = shingle_sets(batch.column(1), width)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets).view(np.int64))], ["doc", "value"])

    held = texts.select("doc_id", "text").mapInArrow(rows, "doc long, value long").groupBy("value").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("df"))
    return held.where("df = 1").groupBy("doc").agg(F.count(F.lit(1)).alias("p"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int = 5) -> DataFrame:
    """Those of pairs (a, b) whose full sets, of texts (doc_id, text), are similar enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in portions(batches):
            own, links = shingle_sets(batch.column("tb"), width), []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                if a not in seen:
                    seen[a] = shingle_sets(batch.column("ta").slice(i, 1), width)[0]
                    if len(seen) > 64:
                        seen.popitem(last=False)
                common = len(np.intersect1d(seen[a], own[i], assume_unique=True))
                if common and 100 * common >= percent * (len(seen[a]) + len(own[i]) - common):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], ["a", "b"])

    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(rows, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """Rows (doc, label) for every end of links (a, b): the smallest document reachable. Labels pass over links, then over labels."""
    both = store(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    labels = store(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "near-labels")
    before = None
    while True:
        now = labels.agg(F.count(F.lit(1)), F.sum(F.col("label").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return labels
        before = now
        heard = both.join(labels, F.col("b") == F.col("doc")).select(F.col("a").alias("doc"), "label")
        lower = labels.unionByName(heard).groupBy("doc").agg(F.min("label").alias("label"))
        over = labels.select(F.col("doc").alias("label"), F.col("label").alias("next"))
        labels = store(lower.join(over, "label", "left").select("doc", F.least("label", F.coalesce("next", "label")).alias("label")), "near-labels")


def near_links(reps: DataFrame, docs: DataFrame, k: int = K, least: int | None = None, percent: int = 85, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Links between class representatives, enough of them to connect every component, and the labels they give."""
    least = shared_least(k, percent, MISS) if least is None else least
    wide_least = shared_least(WIDE, percent, WIDE_MISS)
    lists = store(retained_lists(reps, k, least, percent), "near-retained")
    ids = lists.select(F.col("doc").alias("doc_id")).distinct().hint("merge")  # they grow with the documents
    texts = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "near-texts")
    lists = lists.join(store(private_counts(texts, width), "near-private"), "doc", "left").withColumn("p", F.coalesce("p", F.lit(0)))
    lists = store(lists.where(f"100 * (n - p) >= {percent} * n"), "near-lists")
    hub = F.min(F.struct((F.col("p") / F.col("n")).alias("share"), "doc", "n", "p")).alias("hub")
    stars = lists.groupBy("value").agg(hub, F.count(F.lit(1)).alias("docs")).where("docs > 1")
    stars = store(stars.select("value", F.col("hub.doc").alias("a"), F.col("hub.n").alias("hub_n"), F.col("hub.p").alias("hub_p")), "near-stars")
    spokes = lists.join(stars, "value").where("a <> doc").where(_possible("n", "p", "hub_n", "hub_p", percent))
    first = store(spokes.select(F.least("a", "doc").alias("a"), F.greatest("a", "doc").alias("b")).distinct(), "near-pairs")
    links = store(confirmed(first, texts, percent, width), "near-found")
    labels = components(links)

    held = lists.join(stars.select("value"), "value").join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    parts = held.groupBy("value", "label").agg(F.count(F.lit(1)).alias("docs"))
    largest = parts.groupBy("value").agg(F.max(F.struct("docs", "label")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("value", F.col("top.label").alias("top"))
    open_lists = store(held.join(largest, "value"), "near-open")
    opened = open_lists.groupBy("doc").agg(F.collect_set("value").alias("values"))
    wide = sketches(texts.join(opened.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi"), WIDE, width).select(F.col("doc_id").alias("doc"), "sketch")
    open_lists = store(open_lists.join(opened.join(wide, "doc"), "doc"), "near-wide")
    outside = open_lists.where("label <> top").select("value", F.col("doc").alias("a"), F.col("n").alias("an"), F.col("p").alias("ap"), F.col("label").alias("al"), F.col("sketch").alias("as_"), F.col("values").alias("av"))
    # A pair comes up in the first list that both are in. The sketch of the union of two documents estimates their similarity by its
    # values that both retain; of small sets it is the union itself.
    once = F.col("value") == F.array_min(F.array_intersect("av", "values"))
    both, union = F.array_intersect("as_", "sketch"), F.array_union("as_", "sketch")
    in_union = F.size(F.array_intersect(both, F.slice(F.array_sort(union), 1, WIDE)))
    near = F.when((F.col("an") <= WIDE) & (F.col("n") <= WIDE), F.size(both) * 100 >= F.size(union) * percent).otherwise(in_union * WIDE >= wide_least * F.least(F.size(union), F.lit(WIDE)))
    rest = outside.join(open_lists, "value").where("al <> label and (label = top or a < doc)").where(_possible("an", "ap", "n", "p", percent)).where(once).where(near)
    rest = rest.select(F.least("a", "doc").alias("a"), F.greatest("a", "doc").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = confirmed(store(rest, "near-rest"), texts, percent, width)
    links = store(links.unionByName(more), "near-all")
    return links, components(links)


@tidy
def near_duplicates(docs: DataFrame, k: int = K, least: int | None = None, percent: int = 85, width: int = 5) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    whole, docs = docs.select("doc_id"), one_row_per_id(docs.select("doc_id", "text"))
    drawn = store(sketches(docs, k, width), "near-sketches")
    known = drawn.where("n > 0 and doc_id is not null")
    classes = known.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last")
    classes = store(classes, "near-classes")
    members = drawn.select("doc_id", "n", "f1", "f2").join(classes, ["f1", "f2"], "left")
    members = store(members.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep")), "near-members")
    copies = members.where("doc_id <> rep").select("doc_id").distinct()
    reps = store(known.join(copies, "doc_id", "left_anti").dropDuplicates(["doc_id"]).select("doc_id", "n", "sketch"), "near-reps")
    _, labels = near_links(reps, docs, k, least, percent, width)
    out = members.join(labels.withColumnRenamed("doc", "rep"), "rep", "left")
    component = F.coalesce("label", "rep")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    again = whole.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if again.limit(1).count():
        more = out.join(again, "doc_id").withColumn("_i", F.explode(F.sequence(F.lit(2), F.col("_n").cast("int"))))
        out = out.unionByName(more.select(*out.columns))
    return out
