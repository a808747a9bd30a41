"""The copier: moves what producers have spooled to every target, chunks before manifests, and looks after what is there.

A pass over a spool handles its ready set, then staging, then what has become ready meanwhile; each step can be cut off at any point and
done again. Staged manifests go out only if all their chunks have, which a second look proves: nothing ready or
consuming, no staged chunk left, and the manifest as it was at the first look.
"""

from __future__ import annotations

import datetime
import logging
import time
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkvault.errors import ChunkvaultError
from chunkvault.filesystem import Folder, Lock
from chunkvault.functions import rules as R
from chunkvault.operators import chunks as C
from chunkvault.operators import maintenance as U
from chunkvault.operators import manifests as M
from chunkvault.spool import CHUNKS, META, Spool, commit, read_commits
from chunkvault.storage import store
from chunkvault.targets import Target, Tiers

log = logging.getLogger("chunkvault.copier")

# Seconds of the copier's clocks, and how many copies it remembers.
RECENT_S, RECENT_JITTER_S, RECENT_CAPACITY = 3600.0, 600.0, 162_000
MIN_SCAN_S, MIN_MANIFEST_S, PATROL_S, LAG_SCAN_S, BACKGROUND_S, RETRY_S = 0.5, 1.1, 86_400.0, 60.325, 5.0, 1.0
LAG_THRESHOLD_S = 120
FORCE_META = 0.05


class RecentWork:
    """Keys of work that was done lately, at most `capacity` of them, the least recently used going first. A time counts as earlier by up to
    `jitter_s`, so that work that was done together doesn't come due together."""

    def __init__(self, capacity: int = RECENT_CAPACITY, jitter_s: float = RECENT_JITTER_S, draw: Callable[[], float] = lambda: 0.5):
        self.capacity, self.jitter_s, self.draw, self._at = capacity, jitter_s, draw, OrderedDict()

    def observe(self, key: object, now: float) -> None:
        self._at[key] = now - self.jitter_s * self.draw()
        self._at.move_to_end(key)
        while len(self._at) > self.capacity:
            self._at.popitem(last=False)

    def has_recent(self, key: object, now: float, age_s: float = RECENT_S) -> bool:
        if key not in self._at:
            return False
        self._at.move_to_end(key)
        return now - self._at[key] <= age_s

    def clear(self) -> None:
        self._at.clear()


@dataclass
class State:
    """What the copier remembers of a spool."""

    spool: Spool
    stale: bool = False
    signalled: bool = False
    last_scanned: float = 0.0
    last_manifest: float = 0.0
    last_success: float = 0.0
    last_failure: float = 0.0
    last_update: float = 0.0
    successes: int = 0
    failures: int = 0
    updates: int = 0
    staged: OrderedDict = field(default_factory=OrderedDict)  # identifiers of the last two staged uploads

    def uploaded(self, identifier: str) -> None:
        self.staged[identifier] = None
        while len(self.staged) > 2:
            self.staged.popitem(last=False)


class Copier:
    """Copies spools to targets. clock, draw and sleep are given, so that runs can be repeated."""

    def __init__(self, spark: SparkSession, open_target: Callable[[str], Target] | None = None, clock: Callable[[], float] = time.time, draw: Callable[[], float] = lambda: 1.0, sleep: Callable[[float], None] = time.sleep):
        self.spark, self.clock, self.draw, self.sleep = spark, clock, draw, sleep
        self.open_target = open_target or (lambda uri: Target(spark, uri))
        self.states: dict[str, State] = {}
        self.refs: Counter = Counter()
        self.stop_after: str | None = None  # a step after which to fail, for tests of recovery
        self.hooks: dict[str, Callable[[], object]] = {}  # what happens meanwhile, likewise

    def _step(self, name: str) -> None:
        if name in self.hooks:
            self.hooks[name]()
        if self.stop_after == name:
            raise ChunkvaultError("stopped", level=logging.DEBUG, step=name)

    def _now(self) -> Column:
        return F.lit(datetime.datetime.fromtimestamp(self.clock(), datetime.UTC))

    # Registration: a spool is active as long as more have joined it than left.

    def join(self, spool: Spool) -> State:
        self.refs[spool.root.path] += 1
        return self.states.setdefault(spool.root.path, State(spool))

    def leave(self, spool: Spool) -> None:
        self.refs[spool.root.path] -= 1
        if self.refs[spool.root.path] <= 0:
            del self.refs[spool.root.path]
            self.states.pop(spool.root.path, None)

    def signal(self, path: str) -> bool:
        """Whether work was queued: for an active spool that isn't queued yet."""
        state = self.states.get(path)
        if state is None or state.signalled:
            return False
        state.signalled = True
        return True

    # Copying.

    def remotes(self, spool: Spool) -> list[Target]:
        return [self.open_target(t["s3"]["directory"]) for t in spool.targets() if "s3" in t]

    def tiers(self, spool: Spool) -> Tiers:
        """Caches by role, the first local one in front, then remotes."""
        kinds = [(kind, spec["directory"]) for t in spool.targets() for kind, spec in t.items()]
        local = [d for k, d in kinds if k == "local"]
        caches = local[:1] + [d for k, d in kinds if k == "read_only"] + local[1:]
        return Tiers([spool.tapped()], [self.open_target(d) for d in caches] if local else [], self.remotes(spool))

    def _copy_chunks(self, spool: Spool, chunks: DataFrame) -> int:
        """Puts chunks to the cache and every remote target, each what it lacks; returns how many a target got."""
        chunks = M.once(chunks, ["fp"])  # of commits, which stay until they have gone everywhere
        self.tiers(spool).publish(chunks)
        for target in self.remotes(spool):
            target.put_chunks(chunks)
        return chunks.count()

    def _copy_manifests(self, state: State, manifests: DataFrame) -> None:
        wait = MIN_MANIFEST_S - (self.clock() - state.last_manifest)
        if state.last_manifest and wait > 0:
            self.sleep(wait)
        with Lock(state.spool.root):
            for target in self.remotes(state.spool):
                target.put_manifests(manifests, self._now())
            self._step("manifests")
            self._tap(state.spool, manifests)
        state.last_manifest = self.clock()

    def _tap(self, spool: Spool, manifests: DataFrame) -> None:
        """Keeps the last uploaded manifests; the commits that they supersede go."""
        names = spool.tap.names()
        columns = manifests.columns
        held = read_commits(self.spark, spool.tap, META, names).select(*columns).unionByName(manifests) if names else manifests
        commit(M.once(held, ["db_id"], ["seq"]).select(*columns), spool.tap)
        for name in names:
            (spool.tap / name).delete()

    def handle_ready(self, state: State) -> bool:
        """Copies one claimed set and removes it; True if manifests went out. Without targets everything stays where it is."""
        spool = state.spool
        if not self.remotes(spool) or (claimed := spool.claim()) is None:
            return False
        self._step("claim")
        chunks = claimed / "chunks"
        if not chunks.empty_or_absent():
            self._copy_chunks(spool, read_commits(self.spark, chunks, CHUNKS))
            self._step("chunks")
            chunks.delete()
        meta, did = claimed / "meta", False
        if not meta.empty_or_absent():
            self._copy_manifests(state, read_commits(self.spark, meta, META))
            self._step("tap")
            did = True
        claimed.delete()
        return did

    def handle_staging(self, state: State) -> bool:
        """Copies staged chunks, then those staged manifests that are as they were at the first look; True if some went out."""
        spool, force = state.spool, state.stale or self.draw() < FORCE_META
        if not self.remotes(spool) or spool.sets():
            return False
        names = spool.chunks.names()
        for at in range(0, len(names), 10):  # in batches, between which a ready set takes precedence
            if spool.sets():
                return False
            batch = names[at : at + 10]
            force = self._copy_chunks(spool, read_commits(self.spark, spool.chunks, CHUNKS, batch)) > 0 or force
            self._step("staged-chunks")
            for name in batch:
                (spool.chunks / name).delete()
        first = store(spool.staged_manifests().select("db_id", "identifier"), "copier-look")
        self._step("look")
        if spool.chunks.names() or spool.sets():
            return False  # what was looked at may need chunks that came since, or went to a ready set
        staged = spool.staged_manifests()
        moved = store(staged.select("db_id", "identifier").join(first, ["db_id", "identifier"], "left_anti").select("db_id"), "copier-moved")
        again = M.without(staged, "db_id", moved)
        known = list(state.staged)
        chosen = store(again if force else again.where(~F.col("identifier").isin(known)) if known else again, "copier-staged")
        newest = chosen.select("identifier").orderBy(F.col("seq").desc(), "db_id").limit(2).collect()
        if not newest:
            return False
        self._copy_manifests(state, chosen)
        for r in reversed(newest):
            state.uploaded(r["identifier"])
        return True

    def handle(self, state: State) -> bool:
        """One pass over a spool: ready, staging, ready. A failure after something went out is no failure."""
        did = self.handle_ready(state)
        for again in (self.handle_staging, self.handle_ready):
            try:
                did |= again(state)
            except ChunkvaultError:
                if not did:
                    raise
        return did

    def work(self, state: State) -> bool | None:
        """handle() with its bookkeeping: streaks, times, and a patrol of what was there before; None if it failed."""
        wait = MIN_SCAN_S - (self.clock() - state.last_scanned)
        if state.last_scanned and wait > 0:
            self.sleep(wait * (1 + self.draw()))
        before, state.signalled, state.last_scanned = state.last_scanned, False, self.clock()
        try:
            did = self.handle(state)
        except Exception as e:  # a worker goes on with other spools
            ChunkvaultError("failed to handle spool", e, logging.INFO, spool=state.spool.root.path)
            state.successes, state.failures, state.updates, state.last_failure = 0, state.failures + 1, 0, self.clock()
            return None
        state.stale, state.successes, state.failures, state.last_success = False, state.successes + 1, 0, self.clock()
        state.updates, state.last_update = (state.updates + 1, self.clock()) if did else (0, state.last_update)
        if before:
            missing = self.patrol(state.spool, self.clock() - before)
            if missing:
                log.warning("%s chunks are missing, the next snapshot is full", missing)
                state.spool.forget_versions()
        return did

    def drain(self, edge: Iterable[str], lag: Iterable[str] = (), upkeep: Iterable[str] = (), retries: int = 1) -> dict[str, bool | None]:
        """Works off three streams of spool paths, edges first, each active spool once; those that failed are tried again."""
        queue, done = list(dict.fromkeys(p for stream in (edge, lag, upkeep) for p in stream if p in self.states)), {}
        for attempt in range(retries + 1):
            for path in [p for p in queue if p not in done or (attempt and done[p] is None)]:
                done[path] = self.work(self.states[path])
        return done

    def background(self) -> list[str]:
        """Active spools in the order in which a background scan takes them: stale ones first, the others by chance."""
        return sorted(self.states, key=lambda p: (not self.states[p].stale, self.draw(), p))

    def flush(self, spool: Spool) -> bool:
        """Copies everything that the spool has, now; whether targets then have all its newest manifests."""
        state = self.states.get(spool.root.path) or State(spool)
        for _ in range(3):
            if not self.handle(state) and not spool.sets():
                break
        ahead = spool.staged_manifests().select("db_id", "seq").join(spool.tapped().select("db_id", F.col("seq").alias("_up")), "db_id", "left")
        return ahead.where("_up is null or _up < seq").limit(1).count() == 0

    # Maintenance.

    def patrol(self, spool: Spool, elapsed_s: float, seed: str = "patrol") -> int:
        """Touches a share of each file's uploaded chunks, so that all are within a period; returns how many were missing at a target."""
        tapped = spool.tapped()
        decoded = self.tiers(spool).decoded(tapped).where("error is null")
        bundled = decoded.select("db_id", F.explode("bundled.chunk_index").alias("chunk_index"), F.lit(True).alias("_in"))
        places = M.listed(decoded).join(bundled, ["db_id", "chunk_index"], "left").where("_in is null").select("db_id", "fp")
        chunks = places.unionByName(tapped.where("base_fp is not null").select("db_id", F.col("base_fp").alias("fp"))).where(F.col("fp") != C.zero_fingerprint(spool.granularity))
        wanted = R.desired_touches(F.col("n"), F.lit(float(elapsed_s)), PATROL_S, F.lit(float(self.draw())))
        chosen = store(U.patrol(chunks, "db_id", wanted, f"{seed}{int(self.clock())}"), "copier-patrol")
        return sum(target.touch(chosen, self._now()).count() for target in self.remotes(spool))

    def lag(self, spool: Spool, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The lag of files (db_id, ctime, header_fp) behind what was uploaded, and its counts (stale, maybe_stale, tracked)."""
        at = lambda c: F.timestamp_micros((F.col(c) / 1000).cast("long"))
        sources = files.select("db_id", at("ctime").alias("source_at"), F.col("header_fp").alias("source_header"))
        taps = spool.tapped().select("db_id", at("ctime").alias("replicated_at"), F.col("header_fp").alias("header"))
        lags = U.lag(sources, taps, "db_id")
        return lags, U.lag_counts(lags, self._now(), LAG_THRESHOLD_S)

    def orphans(self, spool: Spool, files: DataFrame) -> DataFrame:
        """Uploaded manifests whose file is gone."""
        return spool.tapped().join(files.select("db_id"), "db_id", "left_anti").select("db_id", "host", "path")


def register_spool(folder: Folder, path: str, key: str) -> tuple[Folder, list[str]]:
    """The spool folder of a file, <mangled path>/<device.inode>; those of other files that were at the same path are removed, and told."""
    from urllib.parse import quote

    of_path = folder / quote(path, safe="!\"$&'()+,:;<=>?@[\\]^`{|}~ *-._").replace("%2F", "#").replace("/", "#")
    gone = [name for name in of_path.names() if name != key]
    for name in gone:
        (of_path / name).delete()
    (of_path / key).make()
    return of_path / key, gone
