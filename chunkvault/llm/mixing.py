"""Mixing sources to target weights, in DataFrame functions only.

Each source is one stream of words (its documents in the order of md5(doc_id), doc_id), packed into
blocks of a fixed number of words; the last block may be shorter. Every output shard draws the source of
each of its slots, so its counts are multinomial. Prefix sums over shards number a source's slots; draws
beyond what a target needs are cut and what a target lacks is drawn into one settling shard, so that
targets hold to the word. Slot k of a source is in pass k div blocks, and a permutation keyed by
source and pass (swap-or-not rounds, which permute any range in place) tells its block. Blocks join slots by
(source, block).

Edge cases: null text has no words; a null source is a source of its own, last in order; documents without
words are returned with taken 0; an empty table gives an empty result; repeated rows are documents
of their own. Columns besides doc_id, text and source are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chunkvault.llm.common import SPACES, WORD, bucket_bits, bucket_of, restored, sheltered, store, tidy, word_count

ROUNDS = 12


def _permuted(x: str, n: str, tag: str, back: bool = False) -> Column:
    """x moved by a permutation of 0..n-1 that the string tag keys; back undoes it."""
    rounds = f"sequence({ROUNDS}, 1, -1)" if back else f"sequence(1, {ROUNDS})"
    other = f"pmod(cast(conv(substr(md5(concat({tag}, '|', i)), 1, 12), 16, 10) as bigint) - x, {n})"
    swap = f"substr(md5(concat({tag}, '|', i, '|', greatest(x, {other}))), 1, 1) >= '8'"
    return F.expr(f"aggregate({rounds}, cast({x} as bigint), (x, i) -> if({swap}, {other}, x))")


def source_plan(sized: DataFrame, block_words: int, cap: float, seed: int) -> DataFrame:
    """One row a source: src (place in order), total, target, and how its slots are laid out.

    The rows of this table are sources, not documents, so one task orders them.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("total"))
    ranked = by_source.withColumn("src", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", (F.col("src") % 3 + 1).cast("double"))
    everything, before = W.partitionBy(F.lit(0)), W.orderBy(F.col("total") / F.col("weight"), "src").rowsBetween(W.unboundedPreceding, -1)
    limit = F.col("total") * F.lit(float(cap))
    ranked = (
        ranked.withColumn("all", F.sum("total").over(everything).cast("double"))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("full_before", F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("rate", (F.col("all") - F.col("full_before")) / (F.col("weights") - F.col("weight_before")))
        .withColumn("at", F.row_number().over(W.orderBy(F.col("total") / F.col("weight"), "src")))
    )
    # The first source, from the tightest limit on, that its limit doesn't bind sets the rate for the rest.
    rate = F.min(F.when(limit >= F.col("rate") * F.col("weight"), F.struct("at", "rate"))).over(everything)["rate"]
    took = F.least(F.round("target").cast("long"), F.floor(F.col("total") * F.lit(float(cap))).cast("long"))
    plan = (
        ranked.withColumn("target", F.least(limit, F.coalesce(rate, F.lit(0.0)) * F.col("weight")))
        .withColumn("take", took)
        .withColumn("blocks", F.ceil(F.col("total") / F.lit(block_words)).cast("long"))
        .withColumn("passes", F.when(F.col("total") > 0, F.expr("take div total")).otherwise(0).cast("long"))
        .withColumn("rest", F.col("take") - F.col("passes") * F.col("total"))
        .withColumn("short", F.col("total") - (F.col("blocks") - 1) * block_words)
        .withColumn("tag", F.concat(F.lit(f"{seed}|"), F.col("src").cast("string"), F.lit("|"), F.col("passes").cast("string")))
        .withColumn("short_at", F.when(F.col("blocks") > 0, _permuted("blocks - 1", "blocks", "tag", back=True)))
    )
    # Slots of the last pass, and how many words its last one takes: the short block may be among them.
    ahead, behind = F.col("rest") - F.col("short_at") * block_words, F.col("rest") - F.col("short_at") * block_words - F.col("short")
    plan = plan.withColumn(
        "more",
        F.when(F.col("rest") <= 0, 0)
        .when(ahead <= 0, F.ceil(F.col("rest") / F.lit(block_words)))
        .when(behind <= 0, F.col("short_at") + 1)
        .otherwise(F.col("short_at") + 1 + F.ceil(behind / F.lit(block_words)))
        .cast("long"),
    ).withColumn(
        "last_words",
        F.when(F.col("rest") <= 0, None)
        .when(ahead <= 0, F.col("rest") - (F.col("more") - 1) * block_words)
        .when(behind <= 0, ahead)
        .otherwise(behind - (F.col("more") - F.col("short_at") - 2) * block_words)
        .cast("long"),
    )
    plan = plan.withColumn("slots", F.coalesce(F.col("passes") * F.col("blocks") + F.col("more"), F.lit(0)))
    plan = plan.withColumn("slots_to", F.sum("slots").over(W.orderBy("src")))
    return plan.select("source", "src", "total", "target", "take", "blocks", "passes", "slots", "slots_to", "last_words")


def located(docs: DataFrame, plan: DataFrame, bits: int) -> DataFrame:
    """Each document with src and start, its place in its source's stream, by sums within and over buckets."""
    tagged = docs.join(plan.select("source", "src"), docs["source"].eqNullSafe(plan["source"])).select("doc_id", "src", "size", bucket_of(F.col("doc_id"), bits).alias("bucket"))
    inside = W.partitionBy("src", "bucket").orderBy(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = tagged.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("nth", F.count(F.lit(1)).over(inside))
    buckets = tagged.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    over = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("base", F.coalesce(F.sum("words").over(over), F.lit(0))).drop("words")
    return rows.join(buckets, ["src", "bucket"]).withColumn("start", F.col("base") + F.col("within")).drop("base", "within")


def drawn_slots(plan: DataFrame, seed: int, slots: int, slots_per_shard: int) -> DataFrame:
    """Rows (shard, src, k): slot k of a source goes to shard; k runs from 0 to the source's slots - 1."""
    spark = plan.sparkSession
    step = max(1, slots // 4096)
    ranges = plan.where("slots > 0").select("src", (F.col("slots_to") - F.col("slots")).alias("lo"), F.col("slots_to").alias("hi"))
    ranges = ranges.withColumn("cell", F.explode(F.expr(f"sequence(lo div {step}, (hi - 1) div {step})")))
    draw = F.expr(f"cast(conv(substr(md5(concat('{seed}|draw|', id)), 1, 12), 16, 10) as bigint) % {max(slots, 1)}")
    draws = spark.range(slots).select(F.expr(f"id div {slots_per_shard}").alias("shard"), draw.alias("u")).withColumn("cell", F.expr(f"u div {step}"))
    counts = draws.join(ranges, "cell").where("u >= lo and u < hi").groupBy("shard", "src").count()
    over = W.partitionBy("src").orderBy("shard")
    counts = counts.withColumn("to", F.sum("count").over(over)).withColumn("from", F.col("to") - F.col("count"))
    kept = counts.join(plan.select("src", "slots"), "src").select("shard", "src", "from", F.least("to", "slots").alias("to"))
    met = counts.groupBy("src").agg(F.max("to").alias("met"))
    lacking = plan.join(met, "src", "left").select(F.lit(-(-slots // slots_per_shard)).cast("long").alias("shard"), "src", F.coalesce("met", F.lit(0)).alias("from"), F.col("slots").alias("to"))
    # In steps of at most a shard's slots, so that no single row stands for more.
    wide = kept.unionByName(lacking).where("from < to")
    parts = wide.select("shard", "src", "to", F.explode(F.expr(f"sequence(from, to - 1, {slots_per_shard})")).alias("first"))
    parts = parts.repartition(max(1, slots // 4096), "shard", "src", "first")  # few rows stand for many slots
    return parts.select("shard", "src", F.explode(F.expr(f"sequence(first, least(first + {slots_per_shard}, to) - 1)")).alias("k"))


def slot_blocks(slots: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows (shard, src, k, block, words): words is null for a whole block."""
    with_plan = slots.join(plan.select("src", "blocks", F.col("slots").alias("n"), "last_words"), "src")
    with_plan = with_plan.withColumn("pass", F.expr("k div blocks")).withColumn("tag", F.concat(F.lit(f"{seed}|"), F.col("src").cast("string"), F.lit("|"), F.col("pass").cast("string")))
    block = _permuted("k % blocks", "blocks", "tag")
    return with_plan.select("shard", "src", "k", block.alias("block"), F.when(F.col("k") == F.col("n") - 1, F.col("last_words")).alias("words"))


@dataclass
class Mix:
    """plan: one row a source; docs: (doc_id, src, bucket, nth, size, start); slots: (shard, src, k, block, words)."""

    plan: DataFrame
    docs: DataFrame
    slots: DataFrame
    block_words: int

    def pieces(self) -> DataFrame:
        """Documents cut at block bounds, with uses (times that the whole piece is taken) and some (words of one more, partial use)."""
        b = self.block_words
        cut = self.docs.withColumn("block", F.explode_outer(F.expr(f"if(size > 0, sequence(start div {b}, (start + size - 1) div {b}), null)")))
        cut = cut.withColumn("x", F.greatest(F.col("start") - F.col("block") * b, F.lit(0))).withColumn("y", F.least(F.col("start") + F.col("size") - F.col("block") * b, F.lit(b)))
        uses = self.slots.groupBy("src", "block").agg(F.sum(F.when(F.col("words").isNull(), 1).otherwise(0)).alias("uses"), F.max("words").alias("cut_at"))
        joined = cut.join(uses, ["src", "block"], "left")
        some = F.greatest(F.least(F.col("y"), F.col("cut_at")) - F.col("x"), F.lit(0))
        return joined.select("doc_id", "src", "bucket", "nth", "size", "start", "block", "x", "y", F.coalesce("uses", F.lit(0)).alias("uses"), F.when(F.col("cut_at").isNull(), 0).otherwise(some).alias("some"))

    def taken(self) -> DataFrame:
        """One row a document: doc_id, size, source_size, target, taken."""
        per_doc = self.pieces().groupBy("doc_id", "src", "bucket", "nth", "size").agg(F.sum(F.coalesce((F.col("y") - F.col("x")) * F.col("uses") + F.col("some"), F.lit(0))).alias("taken"))
        return per_doc.join(self.plan.select("src", "total", "target"), "src").select("doc_id", "size", F.col("total").alias("source_size"), "target", F.col("taken").cast("long"))


def mix_sources(docs: DataFrame, block_words: int = 1024, slots_per_shard: int = 16384, cap: float = 3.0, seed: int = 17) -> Mix:
    """Plans the mix of docs (doc_id, text, source); see the module."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = store(sized, "mix-sized")
    plan = store(source_plan(sized, block_words, cap, seed), "mix-plan")
    where = store(located(sized, plan, bucket_bits(sized.count())), "mix-docs")
    n = plan.agg(F.sum("slots")).first()[0] or 0
    slots = slot_blocks(drawn_slots(plan, seed, n, slots_per_shard), plan, seed)
    return Mix(plan, where, slots, block_words)


@tidy
def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents as the mix takes them, in docs' columns: a row for each whole pass over a document, and one
    more for each run of words that the last, partial pass takes of it, cut from the text as it is: blocks that follow
    each other are one run, and a run of all words is the whole text. doc_id tells documents apart: rows that repeat
    one are each given that document's share."""
    mix = mix_sources(docs, **settings)
    passes = mix.plan.select("src", "passes")
    extra = F.when(F.col("uses") > F.col("passes"), F.col("y") - F.col("x")).otherwise(F.col("some"))
    cuts = mix.pieces().join(passes, "src").withColumn("more", extra).withColumn("from", F.col("x") + F.col("block") * mix.block_words - F.col("start"))
    cut = F.struct(F.col("from").cast("int").alias("a"), (F.col("from") + F.col("more")).cast("int").alias("b"))
    shares = cuts.groupBy("doc_id").agg(F.max("passes").alias("_passes"), F.array_sort(F.collect_list(F.when(F.col("more") > 0, cut))).alias("_cuts"))
    inner = sheltered(docs, ["doc_id", "text", "n_chars"])
    joined = inner.join(shares.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    firsts = F.filter("_cuts", lambda c, i: F.coalesce(F.get("_cuts", i - 1)["b"] != c["a"], F.lit(True)))
    lasts = F.filter("_cuts", lambda c, i: F.coalesce(F.get("_cuts", i + 1)["a"] != c["b"], F.lit(True)))
    runs = F.arrays_zip(F.transform(firsts, lambda c: c["a"]).alias("a"), F.transform(lasts, lambda c: c["b"]).alias("b"))
    # Each word with the white space behind it, which only the last of a run loses.
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{WORD}[{SPACES}]*+"), F.lit(0))

    def run(w: Column, r: Column) -> Column:
        part = F.rtrim(F.array_join(F.slice(w, r["a"] + 1, r["b"] - r["a"]), ""), F.lit(" \t\n\x0b\x0c\r"))
        return F.when((r["a"] == 0) & (r["b"] >= F.size(w)), F.col("text")).otherwise(part)

    none = F.array().cast("array<string>")
    parts = F.when(F.size("_cuts") > 0, F.flatten(F.transform(F.array(words), lambda w: F.transform(runs, lambda r: run(w, r))))).otherwise(none)
    texts = F.concat(F.array_repeat(F.col("text"), F.col("_passes").cast("int")), F.filter(parts, lambda t: t != ""))
    out = joined.withColumn("_text", F.explode(texts)).withColumn("text", F.col("_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return restored(out, docs)
