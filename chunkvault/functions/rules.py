"""Small decision rules of a replica, of intercepted files and of checked arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of lock levels, and the seconds beyond which an operation is slow.
LEVELS = ("none", "shared", "reserved", "pending", "exclusive")
SLOW_S = {"chunk": 10, "join": 30, "spool": 60}


def level_rank(level: Column) -> Column:
    """0 for none to 4 for exclusive; null for what is no level."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level), F.lit(0)).cast("int") - 1


def replica_lock(level: Column, locked: Column, auto_refresh: Column) -> Column:
    """Struct (outcome, locked, refreshes): a replica gives no lock above shared, none is a no-op, and the first shared lock
    of a replica that refreshes by itself takes the newest data in memory."""
    rank = level_rank(level)
    shared = rank == 1
    return F.struct(F.when(rank > 1, "denied").otherwise("ok").alias("outcome"), (locked | shared).alias("locked"), (shared & ~locked & auto_refresh).alias("refreshes"))


def replica_unlock(level: Column, locked: Column) -> Column:
    """Whether a read lock is held after an unlock down to level: only none lets go."""
    return locked & (level_rank(level) != 0)


def reserved_taken() -> Column:
    """On a replica the write lock always counts as taken by someone else."""
    return F.lit(True)


def intercepted(main: Column, name: Column, temporary: Column, nolock: Column, immutable: Column) -> Column:
    """Whether writes to a file are tracked: to named main files that stay, are locked and may change."""
    return main & name.isNotNull() & ~temporary & ~nolock & ~immutable


def moved(path: Column, opened: Column, now: Column) -> Column:
    """Whether the file that was opened is no longer at its path: another identity, or none; files without a path don't move."""
    return F.when(path.isNull(), False).when(now.isNull(), True).otherwise(opened != now)


def refresh_fetches(level: Column, in_flight: Column) -> Column:
    """Whether a refresh fetches: never at level 0, at 1 unless a fetch is under way, always from 2."""
    return (level >= 2) | ((level == 1) & ~in_flight)


def switches(locked: Column) -> Column:
    """Data is not exchanged under a read lock."""
    return ~locked


def slow(kind: Column, seconds: Column) -> Column:
    limits = F.create_map(*[F.lit(x) for pair in SLOW_S.items() for x in pair])
    return F.coalesce(seconds > F.try_element_at(limits, kind), F.lit(False))


def added(a: Column, b: Column) -> Column:
    """The sum, null where it doesn't fit: a checked addition."""
    return F.try_add(a, b)


def saturated_sum(a: Column, b: Column) -> Column:
    """The sum of numbers from 0 on, cut to the largest long."""
    return F.coalesce(F.try_add(a, b), F.lit((1 << 63) - 1))


def saturated_difference(a: Column, b: Column) -> Column:
    """The difference of numbers from 0 on, no less than 0."""
    return F.greatest(a - b, F.lit(0).cast("long"))


def version_id(attribute: Column, header: Column, ctime_ns: Column | None = None) -> Column:
    """What tells versions of a file apart: its attribute, its change time if mixed in, and its header's fingerprint. Empty, so that nothing
    matches, if an attribute could be read but is null, or if neither an attribute nor a header is there ('' stands for a file
    system without attributes)."""
    parts = F.concat(attribute, F.coalesce(F.hex(ctime_ns), F.lit("")) if ctime_ns is not None else F.lit(""), F.coalesce(header, F.lit("")))
    return F.when(attribute.isNull() | ((attribute == "") & header.isNull()), "").otherwise(parts)


def desired_touches(chunks: Column, elapsed_s: Column, period_s: float, draw: Column) -> Column:
    """How many of a file's chunks a patrol touches: the elapsed share of the period, rounded up with twice the chance of its fraction (draw: 0 to 1)."""
    share = F.least(F.greatest(elapsed_s / F.lit(float(period_s)), F.lit(0.0)), F.lit(1.0))
    wanted = chunks * share
    up = draw < F.least((wanted - F.floor(wanted)) * 2, F.lit(1.0))
    return F.least(F.floor(wanted) + F.when(up, 1).otherwise(0), chunks).cast("long")
