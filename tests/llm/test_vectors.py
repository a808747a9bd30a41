"""Searches against brute force."""

import collections

import numpy as np

from chunkvault.llm import additive, threshold
from chunkvault.llm import vectors as vectors_module
from tests.llm import brute


def sound(vectors):
    rows = [(r.vec_id, r.embedding) for r in vectors.select("vec_id", "embedding").collect()]
    return [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]


def test_threshold_algorithm(vectors):
    rows = sound(vectors)
    found = collections.defaultdict(list)
    for r in threshold.top_k(vectors, threshold.queries_of(vectors, 100)).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    asked = {i: v for i, v in rows if i % 100 == 0 and i != 9600}
    for i, v in asked.items():
        want = brute.top_products(rows, (i, v), 10)
        assert [(b, c) for _, b, c in sorted(found[i])] == want
    assert len(found[9400]) == 1
    assert threshold.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_threshold_top_on_ties_and_large_numbers():
    rows = np.array([[1.0, 2.0], [1.0, 2.0], [3.0, -1.0], [0.0, 0.0]])
    order = np.argsort(rows, axis=0, kind="stable").T
    none = np.zeros(4, bool)
    assert threshold.threshold_top(np.array([1.0, 0.0]), rows, order, none, 2)[0].tolist() == [2, 0]
    assert threshold.threshold_top(np.array([0.0, 0.0]), rows, order, none, 2)[0].tolist() == [0, 1]
    huge = threshold._integers(np.array([[1e12, 1.0]]), 1024.0)
    assert huge.dtype == object and huge[0, 0] == 1024 * 10**12


def test_additive_search(vectors):
    rows = [(i, np.array(v, float)) for i, v in sound(vectors) if any(v)]
    found = collections.defaultdict(list)
    for r in additive.search(vectors, threshold.queries_of(vectors, 50)).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for i, v in rows:
        if i % 50 or i == 9600:
            continue
        cos = sorted((-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 9), j) for j, w in rows if j != i and len(w) == len(v))[:5]
        got = sorted(found[i])
        assert [a for a, _, _ in got] == list(range(1, len(cos) + 1))
        hits += len({j for _, j in cos} & {b for _, b, _ in got})
        total += len(cos)
    assert hits >= 0.9 * total
    assert 9003 not in {b for g in found.values() for _, b, _ in g}
    assert additive.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_additive_search_learns_every_length(spark, monkeypatch):
    """Eighty lengths, worked on in several groups and rounds."""
    monkeypatch.setattr(additive, "BOOK_BYTES", 4 << 20)
    monkeypatch.setattr(vectors_module, "ROUND_BYTES", 100_000)
    rng = np.random.default_rng(8)
    rows = [(1000 * d + i, rng.normal(size=d).tolist(), d) for d in range(2, 82) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = collections.defaultdict(set)
    for r in additive.search(table, threshold.queries_of(table, 20), shortlist=8).collect():
        found[r.query_id].add(r.vec_id)
    hits = collections.Counter()
    for i, v, d in rows:
        if i % 20 == 0:
            v, own = np.array(v), [(j, np.array(w)) for j, w, e in rows if e == d and j != i]
            cos = sorted((-float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), j) for j, w in own)[:5]
            hits[d] += len({j for _, j in cos} & found[i])
    assert len(found) == 160 and min(hits.values()) >= 7 and sum(hits.values()) >= 0.9 * 800


def test_recall_with_a_short_list(spark):
    """Nearest five by exact cosine, where the shortlist is a small share of all rows."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, v = (np.array(x) for x in zip(*[(r.vec_id, r.embedding) for r in table.collect()], strict=True))
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = collections.defaultdict(set)
    for r in additive.search(table, threshold.queries_of(table, 50), shortlist=20).collect():  # a hundredth of all rows
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = np.argsort(-np.where(np.arange(len(ids)) == q, -2, v @ v[q]), kind="stable")[:5]
        hits += len(set(ids[near].tolist()) & found[int(ids[q])])
    assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()


def test_additive_search_misses_none_among_close_ones(spark):
    """Groups much closer than the codes tell apart, equal vectors, outliers, and magnitudes whose squares over- and underflow."""
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(4, 24))
    close = np.concatenate([c + 1e-5 * rng.normal(size=(1500, 24)) for c in centres])
    rest = [np.repeat(rng.normal(size=(1, 24)), 300, 0), rng.standard_cauchy(size=(200, 24)), 1e200 * rng.normal(size=(50, 24)), 1e-200 * rng.normal(size=(50, 24))]
    v = rng.permutation(np.concatenate([close, *rest]))
    table = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(4)
    found = collections.defaultdict(list)
    for r in additive.search(table, threshold.queries_of(table, 50)).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    unit = v / np.abs(v).max(1, keepdims=True)
    for q in range(0, len(v), 50):
        dot = lambda a, b: np.cumsum(a * b, axis=-1)[..., -1]
        cos = dot(unit[q], unit) / (np.sqrt(dot(unit[q], unit[q])) * np.sqrt(dot(unit, unit)))
        got = sorted(found[q])
        assert [a for a, _, _ in got] == [1, 2, 3, 4, 5] and len({j for _, j, _ in got}) == 5
        np.testing.assert_allclose([s for _, _, s in got], np.sort(np.delete(cos, q))[::-1][:5], rtol=0, atol=2e-15)
        assert [(-s, j) for _, j, s in got] == sorted((-s, j) for _, j, s in got)
    same = [i for i in range(len(v)) if (v[i] == rest[0][0]).all()]
    asked = [i for i in same if i % 50 == 0]
    assert asked and all([j for _, j, _ in sorted(found[i])] == [j for j in same if j != i][:5] for i in asked)


def test_threshold_algorithm_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(vectors_module, "ROUND_BYTES", 2000)
    monkeypatch.setattr(threshold, "BLOCK", 37)
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(-3, 4, 6 if i % 4 else 3).astype(float).tolist()) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = collections.defaultdict(list)
    for r in threshold.top_k(table, threshold.queries_of(table, 5)).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    for i, v in rows[::5]:
        assert [(b, c) for _, b, c in sorted(found[i])] == brute.top_products(rows, (i, v), 10)
