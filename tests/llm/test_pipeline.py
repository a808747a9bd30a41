"""The pipeline's stages against brute force, each on what the one before kept."""

import collections

import corpus_pipeline as P
from tests.llm import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    kept = P.STAGES[0][1](spark, docs, sf).cache()
    assert kept.columns == docs.columns and 0.7 * docs.count() <= kept.count() <= docs.count()

    lines = P.STAGES[1][1](spark, kept, sf).cache()
    want = brute.line_dedup(list(texts(kept).items()))
    by_id = {i: v for (i, _), v in want.items()}
    assert lines.columns == docs.columns
    assert {i: brute.sha(t) for i, t in texts(lines).items()} == {i: v[2] for i, v in by_id.items()}

    near = P.STAGES[2][1](spark, lines, sf).cache()
    groups = brute.near_duplicates(list(texts(lines).items()))
    assert set(texts(near)) == {i for i, (_, c) in groups.items() if c == i} and near.columns == docs.columns

    mixed = P.STAGES[3][1](spark, near, sf).cache()
    assert mixed.columns == docs.columns
    size = {i: len(brute.WORD.findall(t)) for i, t in texts(near).items()}
    words = collections.Counter()
    for r in mixed.select("doc_id", "text").collect():
        words[r.doc_id] += len(brute.WORD.findall(r.text))
    assert abs(sum(words.values()) - sum(size.values())) <= 20
    assert all(n <= 3 * size[i] for i, n in words.items())

    packed = P.STAGES[4][1](spark, mixed, sf).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    assert (packed.piece == 0).sum() == mixed.count()


def test_near_copies_of_similarity_0_8_go(spark, sf):
    words = [f"w{i}" for i in range(200)]
    texts = {10 * g + j: " ".join(f"g{g}{w}" if (i + 7) % 50 or i // 50 >= j else f"e{j}{w}" for i, w in enumerate(words)) for g in range(3) for j in (0, 4)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for threshold, left in ((85, 6), (80, 3)):
        assert len({c for _, c in brute.near_duplicates(list(texts.items()), threshold).values()}) == left
    assert {r.doc_id for r in P.drop_near_duplicates(spark, docs, sf).collect()} == {0, 10, 20}


def test_stages_on_edge_cases(spark, sf, docs):
    """Nulls, empty and repeated rows, missing ids and columns of clashing names: each stage on what the one before kept, written and read again."""
    from chunkvault.llm.common import store

    now = docs
    for name, stage in P.STAGES[:-1]:
        before, now = now, store(stage(spark, now, sf), f"test-{name}")
        assert now.columns == docs.columns
        if name == "quality":
            assert {r.doc_id for r in now.collect()} <= {r.doc_id for r in docs.collect()} and now.where("doc_id is null").count() == 1
        elif name == "line_dedup":
            want = brute.line_dedup([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(brute.sha(r.text or "") for r in now.collect()) == sorted(want[r.doc_id, r.text][2] for r in before.collect())
        elif name == "near_dedup":
            rows = {(r.doc_id, r.text) for r in before.where("doc_id is not null").collect()}
            groups = brute.near_duplicates(sorted(rows, key=str), 80)
            assert sorted(r.doc_id for r in now.where("doc_id is not null").collect()) == sorted(i for i, (_, c) in groups.items() if c == i)
            assert now.where("doc_id is null").count() == before.where("doc_id is null").count()
        else:
            size = {(r.doc_id, r.text): len(brute.WORD.findall(r.text or "")) for r in before.collect()}
            words = sum(len(brute.WORD.findall(r.text or "")) for r in now.collect())
            assert abs(words - sum(size.values())) <= 20
    pieces = store(P.STAGES[-1][1](spark, now, sf), "test-packing")
    assert pieces.where("piece = 0").count() == now.count()


def test_stages_on_nothing(spark, sf, empty):
    now = empty
    for _, stage in P.STAGES:
        now = stage(spark, now, sf)
        assert now.count() == 0


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0
