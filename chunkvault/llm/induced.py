"""External induced sorting: suffix arrays with common-prefix values, by bucket queues that spill to disk.

The method is induced sorting with recursion. S* suffixes are named by the substrings up to the next one, the string of names is
sorted by recursion, and from the sorted S* suffixes one pass induces the L suffixes and another the S suffixes. A
pass takes tuples (position, common prefix with the tuple before) from a priority queue keyed by first symbol. Keys come out
in order and tuples of one key in the order they went in, so the queue is a first-in-first-out run for each symbol;
runs go to disk in whole pieces when the queue grows past its share of memory. A queue is taken in batches, with
numpy, not tuple by tuple. The common prefix of two tuples induced one after the other into a bucket is one more
than the least common prefix among the tuples that were taken in between.

Order and common prefixes are exact for the first `depth` symbols; suffixes that agree so far may stand in any order.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Bytes of tuples that one pass holds in memory before runs go to disk.
QUEUE_BYTES = 256 << 20


class BucketQueue:
    """A priority queue of (position, prefix) tuples keyed by symbol, first in, first out within a key."""

    def __init__(self, symbols: int, memory: int = QUEUE_BYTES, folder: str | None = None):
        self.runs: list[list] = [[] for _ in range(symbols)]
        self.memory, self.held, self.folder, self.files = memory, 0, folder, 0

    def put(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray | None) -> None:
        self.held += positions.nbytes + (prefixes.nbytes if prefixes is not None else 0)
        self.runs[symbol].append((positions, prefixes))
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        """Writes every run in memory to disk, in its place in the queue."""
        if self.folder is None:
            self._own = tempfile.TemporaryDirectory(prefix="chunkvault-queue-")  # gone with the queue, as a task's spills are
            self.folder = self._own.name
        for runs in self.runs:
            for i, run in enumerate(runs):
                if not isinstance(run, str):
                    path = os.path.join(self.folder, f"run-{self.files}.npz")
                    self.files += 1
                    np.savez(path, p=run[0], **({} if run[1] is None else {"l": run[1]}))
                    runs[i] = path
        self.held = 0

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray | None] | None:
        """All tuples of a symbol, oldest first, or None."""
        runs, self.runs[symbol] = self.runs[symbol], []
        if not runs:
            return None
        loaded = []
        for run in runs:
            if isinstance(run, str):
                with np.load(run) as f:
                    loaded.append((f["p"], f["l"] if "l" in f else None))
                os.remove(run)
            else:
                self.held -= run[0].nbytes + (run[1].nbytes if run[1] is not None else 0)
                loaded.append(run)
        if len(loaded) == 1:
            return loaded[0]
        return np.concatenate([p for p, _ in loaded]), (None if loaded[0][1] is None else np.concatenate([x for _, x in loaded]))


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo..hi]) for each pair, both ends included, by a sparse table."""
    span = hi - lo + 1
    out = np.empty(len(lo), values.dtype)
    level, width = values, 1
    power = np.frexp(span.astype(np.float64))[1] - 1
    for k in range(int(power.max(initial=0)) + 1):
        at = np.flatnonzero(power == k)
        out[at] = np.minimum(level[lo[at]], level[hi[at] - width + 1])
        if len(level) > width:
            level = np.minimum(level[:-width], level[width:])
        width *= 2
    return out


def common(s: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and at b, up to depth."""
    out, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(depth):
        x, y = a[alive] + k, b[alive] + k
        alive = alive[(x < len(s)) & (y < len(s))]
        alive = alive[s[a[alive] + k] == s[b[alive] + k]]
        if not len(alive):
            break
        out[alive] = k + 1
    return out


class _Pass:
    """One induction pass: what is taken from the queue, in order, induces what stands before it."""

    def __init__(self, s: np.ndarray, wanted: np.ndarray, symbols: int, prefixes: bool, depth: int, memory: int):
        self.s, self.wanted, self.depth, self.prefixes = s, wanted, depth, prefixes
        self.queue = BucketQueue(symbols, memory)
        self.since = np.zeros(symbols, np.uint8)

    def induce(self, positions: np.ndarray, prefixes: np.ndarray | None) -> None:
        at = np.flatnonzero(positions > 0)
        at = at[self.wanted[positions[at] - 1]]
        if self.prefixes and len(prefixes):
            whole = prefixes.min()
        if not len(at):
            if self.prefixes and len(prefixes):
                np.minimum(self.since, whole, out=self.since)
            return
        new = positions[at] - 1
        symbol = self.s[new]
        order = np.argsort(symbol, kind="stable")
        new, symbol, at = new[order], symbol[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        found = None
        if self.prefixes:
            lo = np.concatenate([[0], at[:-1] + 1])
            lo[first] = 0
            found = _least(prefixes, lo, at)
            found[first] = np.minimum(found[first], self.since[symbol[first]])
            found = np.minimum(found.astype(np.int64) + 1, self.depth).astype(np.uint8)
            last = np.append(first[1:], len(symbol)) - 1
            np.minimum(self.since, whole, out=self.since)
            rest = np.full(len(last), 255, np.uint8)
            some = np.flatnonzero(at[last] + 1 < len(prefixes))
            rest[some] = _least(prefixes, at[last][some] + 1, np.full(len(some), len(prefixes) - 1))
            self.since[symbol[first]] = rest
        for a, b in zip(first.tolist(), np.append(first[1:], len(symbol)).tolist(), strict=True):
            self.queue.put(int(symbol[a]), new[a:b], None if found is None else found[a:b])


def _induced(s: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, symbols: int, depth: int, seed_prefixes: np.ndarray | None, memory: int):
    """All suffixes from S* suffixes in order (within symbols, at least). seed_prefixes[i]: common prefix of seeds i - 1 and i; None: no prefixes."""
    prefixes = seed_prefixes is not None
    ends = np.searchsorted(s[seeds], np.arange(symbols + 1))
    zero = np.zeros(1, np.uint8)

    def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(common(s, a[-1:], b[:1], depth), 255).astype(np.uint8)

    lefts = _Pass(s, ~is_s, symbols, prefixes, depth, memory)
    lefts.queue.put(int(s[-1]), np.array([len(s) - 1]), zero.copy() if prefixes else None)
    lefts.since[:] = 0
    large: list[list] = [[] for _ in range(symbols)]
    for c in range(symbols):
        while (batch := lefts.queue.take(c)) is not None:
            if prefixes and not large[c]:
                batch[1][0] = 0
            large[c].append(batch)
            lefts.induce(*batch)
        a, b = ends[c], ends[c + 1]
        if a < b:
            own = seeds[a:b]
            if prefixes:
                lcp = seed_prefixes[a:b].copy()
                lcp[0] = joint(large[c][-1][0], own)[0] if large[c] else 0
                lefts.induce(own, lcp)
            else:
                lefts.induce(own, None)

    smalls = _Pass(s, is_s, symbols, prefixes, depth, memory)
    parts, lcps = [], []
    for c in range(symbols - 1, -1, -1):
        own = []
        while (batch := smalls.queue.take(c)) is not None:
            if prefixes and not own:
                batch[1][0] = 0
            own.append(batch)
            smalls.induce(*batch)
        big = np.concatenate([p for p, _ in large[c]]) if large[c] else None
        if big is not None:
            if prefixes:
                up = np.concatenate([x for _, x in large[c]])
                down = np.concatenate([joint(big, own[-1][0][::-1]) if own else zero, up[:0:-1]])
                smalls.induce(big[::-1], down)
            else:
                smalls.induce(big[::-1], None)
        large[c] = None
        if own:
            small = np.concatenate([p for p, _ in own])[::-1]
            parts.append(small)
            if prefixes:
                down = np.concatenate([x for _, x in own])
                head = joint(big, small) if big is not None else zero
                lcps.append(np.concatenate([head, down[:0:-1]]))
        if big is not None:
            parts.append(big)
            if prefixes:
                lcps.append(up)
    order = np.concatenate(parts[::-1])
    return order, (np.concatenate(lcps[::-1]) if prefixes else None)


def _doubled(s: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first depth symbols, by ranking pairs of ranks; the end of the recursion."""
    _, rank = np.unique(s, return_inverse=True)
    rank, done = rank.astype(np.int64) + 1, 1
    while done < depth and rank.max(initial=0) < len(s):
        ahead = np.zeros(len(s), np.int64)
        if done < len(s):
            ahead[:-done] = rank[done:]
        _, rank = np.unique(rank * (len(s) + 2) + ahead, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        done *= 2
    return np.argsort(rank, kind="stable")


def suffix_order(s: np.ndarray, symbols: int, depth: int, prefixes: bool = False, memory: int = QUEUE_BYTES, level: int = 0):
    """(order, prefixes): the suffixes of s in order, and the common prefix of each with the one before."""
    n = len(s)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint8) if prefixes else None
    # A suffix is S if smaller than the next; among equal symbols the type is that of the next. The last is L.
    differs = np.append(s[:-1] != s[1:], True)
    until = np.flatnonzero(differs)
    nxt = until[np.searchsorted(until, np.arange(n))]
    is_s = np.append(s, -1)[nxt + 1] > s if s.dtype.kind == "i" else np.append(s.astype(np.int64), -1)[nxt + 1] > s
    star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    m = len(star)
    if m == 0:
        return _induced(s, is_s, star, symbols, depth, np.empty(0, np.uint8) if prefixes else None, memory)
    # Name the substrings from each S* suffix to the next, in the order that one induction without sorted seeds gives them.
    rough, _ = _induced(s, is_s, star[np.argsort(s[star], kind="stable")], symbols, depth, None, memory)
    is_star = np.zeros(n, bool)
    is_star[star] = True
    sorted_star = rough[is_star[rough]]
    length = np.zeros(n, np.int64)
    length[star] = np.append(np.diff(star) + 1, n - star[-1] + 1)
    size = length[sorted_star]
    same = np.concatenate([[False], size[1:] == size[:-1]])
    pairs = np.flatnonzero(same)
    if len(pairs):
        a, b, cap = sorted_star[pairs - 1], sorted_star[pairs], np.minimum(size[pairs], depth)
        alive = np.arange(len(pairs))
        for k in range(int(cap.max())):
            alive = alive[cap[alive] > k]
            if not len(alive):
                break
            x, y = a[alive] + k, b[alive] + k
            ok = (x < n) & (y < n)
            ok[ok] = s[x[ok]] == s[y[ok]]
            same[pairs[alive[~ok]]] = False
            alive = alive[ok]
    names = np.zeros(n, np.int64)
    names[sorted_star] = np.cumsum(~same) - 1
    reduced = names[star]
    distinct = int(reduced.max()) + 1
    if distinct == m:
        order = np.argsort(reduced, kind="stable")
    elif level < 2 and distinct <= 4096 and distinct * 8 < m:
        order, _ = suffix_order(reduced, distinct, -(-depth // 2) + 1, False, memory, level + 1)
    else:
        order = _doubled(reduced, -(-depth // 2) + 1)
    seeds = star[order]
    lcp = None
    if prefixes:
        lcp = np.concatenate([[0], np.minimum(_common_bytes(s, seeds[:-1], seeds[1:], depth), 255)]).astype(np.uint8)
    return _induced(s, is_s, seeds, symbols, depth, lcp, memory)


def _common_bytes(s: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """As common(), eight bytes at a time."""
    padded = np.concatenate([s.astype(np.uint8), np.zeros(depth + 16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    out, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(0, depth, 8):
        eq = words[a[alive] + k] == words[b[alive] + k]
        run = np.where(eq.all(1), 8, np.argmin(eq, 1))
        out[alive] += run
        alive = alive[run == 8]
        if not len(alive):
            break
    return np.minimum(np.minimum(out, depth), np.minimum(len(s) - a, len(s) - b))
