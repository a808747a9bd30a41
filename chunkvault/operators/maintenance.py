"""Maintenance: collection of garbage, lag, streaks, reference counts, throttles and samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def garbage(staged: DataFrame, live: DataFrame) -> DataFrame:
    """Staged fingerprints that no manifest needs."""
    return staged.select("fp").distinct().join(live.select("fp"), "fp", "left_anti")


def ready(staged: DataFrame, live: DataFrame) -> DataFrame:
    """Staged fingerprints that the manifest needs: what a ready buffer links."""
    return staged.select("fp").distinct().join(live.select("fp"), "fp", "left_semi")


def lag_counts(lags: DataFrame, now: Column, threshold_s: int = 120) -> DataFrame:
    """Counts over rows (source_at, replicated_at, headers_match): of the sources whose replica is behind by more than 1 ns (absent ones count from
    the epoch), and that changed at least threshold_s ago, stale and, where headers match all the same, maybe_stale; and tracked, all."""
    behind = F.coalesce(F.col("source_at") > F.col("replicated_at"), F.lit(True))
    long_ago = F.unix_micros(now) - F.unix_micros("source_at") >= threshold_s * 1_000_000
    late = behind & long_ago
    match = F.coalesce("headers_match", F.lit(False))
    return lags.agg(F.count_if(late & ~match).alias("stale"), F.count_if(late & match).alias("maybe_stale"), F.count(F.lit(1)).alias("tracked"))


def background_order(active: DataFrame, stale: str, draw: Column) -> DataFrame:
    """The order in which a background scan takes the active set, nth from 1: it is shuffled by draw (hex digits), stale ones come to its end and are
    popped first. Ranks are counted within 512 buckets, so that no task sorts them all."""
    marked = active.withColumn("_h", draw).withColumn("_b", (~F.col(stale)).cast("int") * 256 + 255 - F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    sizes = marked.groupBy("_b").agg(F.count(F.lit(1)).alias("_m"))
    before = sizes.select("_b", (F.sum("_m").over(W.orderBy("_b")) - F.col("_m")).alias("_from"))
    ranked = marked.join(before, "_b").withColumn("nth", F.row_number().over(W.partitionBy("_b").orderBy(F.col("_h").desc())) + F.col("_from"))
    return ranked.select(*active.columns, "nth")


def queued(signals: DataFrame, key: list[str], batch: str, order: list[str], capacity: int) -> DataFrame:
    """Signals that a bounded queue takes between two drains (a batch): the first of each key, and no more than its capacity; the rest is dropped, as
    a later scan gets to it."""
    first = signals.groupBy(batch, *key).agg(F.min(F.struct(*order)).alias("_o"))
    return first.withColumn("nth", F.row_number().over(W.partitionBy(batch).orderBy("_o", *key))).where(F.col("nth") <= capacity).select(batch, *key, "_o.*", "nth")


def dealt(work: DataFrame, kind: str, key: Column, workers: int) -> DataFrame:
    """Work with its worker, by key. The first half of the workers is kept free of upkeep, which the others take over."""
    own, half = F.pmod(key, F.lit(workers)), workers // 2
    return work.withColumn("worker", F.when((F.col(kind) == "upkeep") & (own < half), own + half).otherwise(own))


def orphans(taps: DataFrame, files: DataFrame, key: str, at: str, now: Column, min_age_h: int = 24) -> DataFrame:
    """Taps whose file is gone and that are at least a day old: younger ones may be of a file that is just being made."""
    old = F.unix_micros(now) - F.unix_micros(at) >= min_age_h * 3_600_000_000
    return taps.where(old).join(files.select(key), key, "left_anti")


def copied_counts(changes: DataFrame, key: list[str]) -> DataFrame:
    """Per key: snapshotted, the chunks that a snapshot looked at, and copied, those it had to stage (changed or added)."""
    return changes.where("change <> 'removed'").groupBy(*key).agg(F.count(F.lit(1)).alias("snapshotted"), F.count_if(F.col("change") != "same").alias("copied"))


def partial_collection(copied: Column, work: Column, chunks: Column, draw: Column) -> Column:
    """Whether a partial collection runs; draw stands for the random bound below a quarter of the chunks."""
    return (copied >= draw % (F.floor(chunks / 4) + 1)) | (F.floor(work / 2) >= chunks)


def lag(sources: DataFrame, replicas: DataFrame, key: str) -> DataFrame:
    """Sources (key, source_at, source_header) beside their replicas (key, replicated_at, header): lag_s, headers_match, stale."""
    both = sources.join(replicas, key, "left")
    match = F.coalesce(F.col("source_header") == F.col("header"), F.lit(False))
    behind = F.coalesce(F.col("source_at") > F.col("replicated_at"), F.lit(True))
    seconds = F.coalesce(F.unix_timestamp("source_at") - F.unix_timestamp("replicated_at"), F.unix_timestamp("source_at"))
    return both.withColumn("headers_match", match).withColumn("lag_s", F.when(behind, seconds).otherwise(0)).withColumn("stale", behind & ~match)


def streaks(outcomes: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """Consecutive outcomes of one kind: adds streak, the length so far, by the difference of two row numbers."""
    all_rows, own = W.partitionBy(key).orderBy(*order), W.partitionBy(key, kind).orderBy(*order)
    island = outcomes.withColumn("_island", F.row_number().over(all_rows) - F.row_number().over(own))
    return island.withColumn("streak", F.row_number().over(W.partitionBy(key, kind, "_island").orderBy(*order)).cast("long")).drop("_island")


def active(changes: DataFrame, key: str, delta: str) -> DataFrame:
    """Keys that joined more often than they left."""
    return changes.groupBy(key).agg(F.sum(delta).alias("refs")).where("refs > 0")


def in_order(events: DataFrame, key: list[str], order: list[str], fold: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]], schema: str) -> DataFrame:
    """A fold over each key's events in order: fold(state, rows) -> (state, out), from None. Events stream through in sorted batches, so a
    key's events need not fit memory; a key is one task's, as each step depends on the one before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for rows in batches:
            own = rows["_key"].to_numpy()
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
                if a < b:
                    if own[a] != current:
                        current, state = own[a], None
                    state, out = fold(state, rows.iloc[a:b])
                    yield out

    marked = events.withColumn("_key", F.to_json(F.struct(*key)))
    return marked.repartition("_key").sortWithinPartitions("_key", *order).mapInPandas(run, schema)


def fold_kept(events: DataFrame, key: list[str], order: str, at: str, gap: int, jitter: str | None = None) -> DataFrame:
    """Greedy throttle: of each key's events in order, keeps one if `gap` has passed since the last kept one, whose time counts as earlier by its
    jitter if a column of that name is given (then more than the gap must have passed)."""

    def fold(last: int | None, rows: pd.DataFrame) -> tuple[int | None, pd.DataFrame]:
        times, kept = rows[at].to_numpy(np.int64), []
        side, back = ("left", np.zeros(len(rows), np.int64)) if jitter is None else ("right", rows[jitter].to_numpy(np.int64))
        i = 0 if last is None else int(np.searchsorted(times, last + gap, side))
        while i < len(times):
            kept.append(i)
            last = int(times[i] - back[i])
            i = max(i + 1, int(np.searchsorted(times, last + gap, side)))
        return last, rows.iloc[kept][[order]]

    return in_order(events, key, [at, order], fold, f"`{order}` long")


def token_bucket(events: DataFrame, key: str, order: str, at: str, rate: int, burst: int) -> DataFrame:
    """Whether each event gets a token from its key's bucket of `burst`, refilled at one token each `rate` units of time.

    Integers only: the level is counted in units of time.
    """
    full = rate * burst

    def fold(state: tuple[int, int] | None, rows: pd.DataFrame) -> tuple[tuple[int, int], pd.DataFrame]:
        granted = []
        level, last = state or (full, None)
        for now in rows[at].tolist():
            level = min(full, level + (now - last if last is not None else 0))
            granted.append(level >= rate)
            level, last = level - rate * granted[-1], now
        return (level, last), pd.DataFrame({order: rows[order], "granted": granted})

    return in_order(events, [key], [at, order], fold, f"`{order}` long, granted boolean")


def work_since(events: DataFrame, key: str, order: list[str], copied: str, chunks: str) -> DataFrame:
    """Work since a key's last collection: each event adds what it copied and one; once half the work reaches the number of chunks it is
    collected, and work starts again from 0. Rows (event, work, run), event being the last of order."""
    event = order[-1]

    def fold(work: int | None, rows: pd.DataFrame) -> tuple[int, pd.DataFrame]:
        work, out = work or 0, []
        for done, n in zip(rows[copied].tolist(), rows[chunks].tolist(), strict=True):
            work += done + 1
            out.append((work, work // 2 >= n))
            work = 0 if out[-1][1] else work
        return work, pd.DataFrame({event: rows[event], "work": [w for w, _ in out], "run": [r for _, r in out]})

    return in_order(events, [key], order, fold, f"`{event}` long, work long, run boolean")


def patrol(chunks: DataFrame, key: str, wanted: Column, seed: str) -> DataFrame:
    """Of each key's distinct chunks (key, fp) as many as wanted, an expression over their number n, without replacement: those whose seeded
    hash ranks first. Chunks are ranked within buckets of the hash before the few that may
    be chosen meet, so no key's list is sorted in one task."""
    distinct = chunks.select(key, "fp").distinct()
    counts = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("_k", wanted)
    draw = F.md5(F.concat(F.col("fp"), F.lit(seed)).cast("binary"))
    marked = distinct.select(key, "fp").withColumn("_h", draw).withColumn("_b", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    sizes = marked.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_m"))
    before = sizes.withColumn("_to", F.sum("_m").over(W.partitionBy(key).orderBy("_b"))).withColumn("_from", F.col("_to") - F.col("_m"))
    chosen = before.join(counts.select(key, "_k"), key).where("_from < _k")
    within = W.partitionBy(key, "_b").orderBy("_h", "fp")
    ranked = marked.join(chosen.select(key, "_b", "_from", "_k"), [key, "_b"]).withColumn("_nth", F.row_number().over(within) + F.col("_from"))
    return ranked.where("_nth <= _k").select(key, "fp")


def batches(items: DataFrame, key: str, order: list[str], size: int = 10) -> DataFrame:
    """Items of a key dealt into batches of ten in order."""
    return items.withColumn("batch", F.expr(f"cast((row_number() over (partition by {key} order by {', '.join(order)}) - 1) div {size} as bigint)"))


def newest(spools: DataFrame, path: str, at: str) -> DataFrame:
    """The newest spool of each path."""
    rest = [c for c in spools.columns if c != path]
    return spools.groupBy(path).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("s")).select(path, "s.*")


def put_outcome(status: Column, attempt: Column) -> Column:
    """What a write to the store does next."""
    return F.when(status.between(200, 299), "ok").when((status < 500) & ~status.isin(408, 429), "permanent").when(attempt < 3, "retry").otherwise("failed")


def get_outcome(status: Column, attempt: Column) -> Column:
    return F.when(status == 200, "data").when((status == 404) & (attempt >= 1), "missing").when((status < 500) & ~status.isin(404, 429), "failed").when(attempt < 3, "retry").otherwise("failed")


def touch_outcome(status: Column, attempt: Column) -> Column:
    return F.when(status.between(200, 299), "ok").when(status == 404, "full_snapshot").when(status < 500, "ignored").when(attempt < 3, "retry").otherwise("ignored")


def role(kind: Column, first: Column) -> Column:
    """What a cache tier is; first tells the first one of its kind. Null for remote ones."""
    return F.when(kind == "read_only", "reader").when((kind == "local") & first, "writer").when(kind == "local", "reader")


def roles(targets: DataFrame, owner: str, order: str, kind: str) -> DataFrame:
    """Cache tiers: read-only targets read, the first local one writes and the others read, remote ones are left out."""
    nth = F.row_number().over(W.partitionBy(owner, kind).orderBy(order))
    return targets.withColumn("role", role(F.col(kind), nth == 1)).where("role is not null")
