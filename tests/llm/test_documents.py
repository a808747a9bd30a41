"""Operators over documents against brute force, on the smallest fixture and every edge case at once."""

import collections
import math
import random
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkvault.llm import line_dedup, mixing, near_dup, packing, pii, quality, secrets, suffix_dedup
from chunkvault.llm.queries import tokenizer_path
from tests.llm import brute


def span_text(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in spans)


def test_secrets(docs, rows, empty):
    found = collections.defaultdict(list)
    for r in secrets.secret_digest(docs).collect():
        found[r.doc_id].append((r.n_assign, r.n_access, r.n_hex, r.base_sha256))
        base = [s for s in r.spans.split(",") if s and not s.startswith("random")]
        assert brute.sha(",".join(base)) == r.base_sha256
    want = collections.defaultdict(list)
    for i, t in rows:
        spans = [(k, a, b) for a, k, b in brute.secrets(t)]
        counts = tuple(sum(k == j for k, _, _ in spans) for j in range(3))
        want[i].append((*counts, brute.sha(span_text(spans, secrets.KINDS))))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert secrets.secret_digest(empty).count() == 0


BATTERY = (secrets.ALPHABETS, secrets.ORDINARY, secrets.VETO, secrets.LEAN)
SECRET_KINDS = ("base64", "base64url", "base32", "BASE36", "base36", "HEX", "digits")


def ordinary_tokens(rng, many):
    """Paths, slugs, identifiers, dates in a row and UUIDs: long runs of token characters that are no secrets."""
    words = ["the", "quick", "report", "user", "Account", "payment", "status", "home", "value", "index", "customer", "version", "Error", "handler", "with", "some", "plain", "together"]
    out = []
    for i in range(many):
        pick = rng.choice(words, rng.integers(5, 9)).tolist()
        out.append(["/".join(pick), "-".join(pick), "_".join(pick), "".join(w.capitalize() for w in pick), "".join(w.upper() for w in pick), "".join(w.lower() for w in pick), f"{'-'.join(pick)}-{i}", "2024010120240102202401032024", "0" * 12 + f"{i:012d}"][i % 9])
    return out + [str(uuid.UUID(bytes=rng.bytes(16))) for _ in range(many // 9)]


def planted(rng, kind, size):
    return "".join(rng.choice(list(secrets.ALPHABETS[kind]), size))


def test_random_spans_match_brute_force(spark, rows):
    rng = np.random.default_rng(11)
    texts = [t for _, t in rows] + [f"see {t} there {planted(rng, SECRET_KINDS[i % 7], 20 + i % 50)}." for i, t in enumerate(ordinary_tokens(rng, 400))]
    texts += ["a" * 40, "abcdefghijklmnopqrstuvwxyz0123456789", "=" * 30, "12" * 15, "x" * 19 + "==", planted(rng, "base64", 5000)]
    want = brute.random_spans(texts, *BATTERY)
    found = {r.doc_id: r.spans for r in secrets.secret_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, spans in enumerate(want):
        assert [s for s in found[i].split(",") if s.startswith("random")] == [f"random:{a}:{b}" for a, b in spans], texts[i]
    assert sum(map(len, want)) > 300


@pytest.mark.parametrize("kind", SECRET_KINDS)
def test_recall_and_false_discoveries(spark, kind):
    """Of 400 planted keys of 24 to 64 characters, among 3,000 ordinary tokens and prose, nine tenths are found in each
    encoding, and of all that is found at most a twentieth is ordinary. Digits have few symbols to judge by: at 24 the battery finds 0.4 of them
    (the base rule of hex has them all)."""
    rng = np.random.default_rng(len(kind))
    keys = [planted(rng, kind, n) for n in (24, 32, 40, 64) for _ in range(100)]
    texts = keys + [f"{a} it was said that {b}" for a, b in zip(ordinary_tokens(rng, 3000), ordinary_tokens(rng, 3000), strict=True)]
    found = {r.doc_id: r for r in secrets.secret_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    hits = [r.doc_id for r in found.values() if "random" in r.spans]
    assert kind in ("HEX", "digits") or all(found[i].n_assign + found[i].n_access + found[i].n_hex == 0 for i in range(400))  # digits are hex too
    for at in range(100 if kind == "digits" else 0, 400, 100):
        assert sum(at <= i < at + 100 for i in hits) >= 90, (kind, at)
    assert sum(i >= 400 for i in hits) <= 0.05 * len(hits)


def test_few_random_tokens_among_many_words(spark):
    rng = np.random.default_rng(3)
    keys = [planted(rng, "base64", 128) for _ in range(5)]
    paths = ["/".join(rng.choice(["Home", "and", "with", "some", "Plain", "words", "together", "here"], 40))[:128] for _ in range(3000)]
    found = {r.doc_id: r.spans for r in secrets.secret_digest(spark.createDataFrame(list(enumerate(keys + paths)), "doc_id long, text string")).collect()}
    assert sum("random" in found[i] for i in range(5)) >= 4
    assert sum("random" in found[i] for i in range(5, 3005)) <= 1


def test_a_text_of_many_secrets(spark):
    """Spans of a long text cost in proportion to it."""
    text = "".join(f"token={i:08d} " for i in range(32_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    secrets.secret_digest(docs.limit(0)).collect()
    began = time.time()
    (row,) = secrets.secret_digest(docs).collect()
    assert row.n_assign == 32_000 and row.base_sha256 == brute.sha(",".join(f"assign:{15 * i}:{15 * i + 14}" for i in range(32_000)))
    assert time.time() - began < 20


def test_personal(docs, rows, empty):
    found = pii.personal_digest(docs).collect()
    assert len(found) == len(rows)
    want = collections.defaultdict(set)
    for i, t in rows:
        want[i].add(span_text(brute.personal(t), pii.KINDS))
    for r in found:
        base = ",".join(s for s in r.spans.split(",") if s and not s.startswith("term"))
        assert base in want[r.doc_id] and brute.sha(base) == r.base_sha256
    assert pii.personal_digest(empty).count() == 0


def test_disclosing_terms_go(spark):
    texts = [f"filler{i} some plain words here" for i in range(60)] + [f"the person Zebulon writes from zeb@example.org about thing{i}" for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("Zebulon" not in clean[i] and "zeb@" not in clean[i] and "[email]" in clean[i] for i in range(60, 64))
    assert all(clean[i] == texts[i] for i in range(60))


def test_disclosing_terms_go_wherever_they_stand(spark):
    """A name in a letter's head and foot, far from the address, in all documents of the entity."""
    gap = " ".join(f"w{i % 30}x" for i in range(300))
    texts = [f"filler{i} some plain words {gap}" for i in range(60)] + [f"Zebulon of old {gap} write to zeb@example.org or to Zebulon {gap} Zebulon" if i % 2 else f"zeb@example.org Zebulon {gap}" for i in range(4)]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all("Zebulon" not in clean[i] and "[email]" in clean[i] and gap in clean[i] for i in range(60, 64))
    assert all(clean[i] == texts[i] for i in range(60))


def test_terms_beside_an_entity_of_one_document_go(spark):
    texts = [f"filler{i} some plain words here" for i in range(200)] + ["some plain words here from Zebulon at zeb@example.org"]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert "Zebulon" not in clean[200] and "zeb@" not in clean[200] and "some plain words here" in clean[200]
    assert all(clean[i] == texts[i] for i in range(200))


def test_disclosing_terms_match_brute_force(spark, rows):
    """Every term span: of fixture and edge texts, and of texts about entities with terms of all degrees."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    texts = [t for _, t in rows]
    for i in range(60):
        own = rng.sample(words, rng.randint(3, 12)) + [f"Name{i % 7}"] * (i % 3) + [f"rare{i // 2}"]
        mail = f"person{i % 9}@mail.example.org" if i % 4 else ""
        call = "+1 555 010 %04d" % (i % 5) if i % 5 == 0 else ""
        rng.shuffle(own)
        texts.append(" ".join([*own[:4], mail, *own[4:], call, own[0].upper()]))
    found = {r.doc_id: [(t["start"], t["end"], t["sure"]) for t in r.terms] for r in pii.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = dict(enumerate(brute.disclosing(texts)))
    assert found == want
    assert sum(map(len, want.values())) > 100 and {s for spans in want.values() for *_, s in spans} == {True, False}


def test_sanitise_generalises_what_others_have_too(spark):
    """A term that discloses, but occurs without the entity too, is generalised; one that never does is removed. Columns of any name stay."""
    texts = [f"filler{i} some plain words here" + (" Quux" if i < 3 else "") for i in range(1000)] + ["Zebulon Quux at zeb@example.org", "zeb@example.org of Zebulon, Quux"]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, terms string, start int")
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert clean[1000].text == " [term] at [email]" and clean[1001].text == "[email] of , [term]"
    assert all(clean[i].text == texts[i] and clean[i].terms == "x" and clean[i].start == i for i in range(1000))


def test_line_dedup(docs, rows, empty):
    want = brute.line_dedup(rows)
    found = sorted([r.doc_id or -1, r.n_lines, r.n_dropped, r.kept_sha256] for r in line_dedup.line_digest(docs).collect())
    assert found == sorted([i or -1, *want[i, t]] for i, t in rows)
    texts = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(texts.columns)
    assert all(brute.sha(r.text or "") == r.kept_sha256 for r in texts.select("text", "kept_sha256").collect())
    assert line_dedup.line_digest(empty).count() == 0


def dropped(index):
    return sorted(map(tuple, index.drops().select("doc_id", F.sort_array("drops").cast("string")).collect()))


def counted(index):
    return sorted(map(tuple, index.refs().collect()))


def test_line_index_is_reversible(docs):
    some = docs.where("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    left, right = some.where("doc_id % 3 > 0"), some.where("doc_id % 3 = 0")
    index, whole = line_dedup.LineIndex.build(left), line_dedup.LineIndex.build(some)
    more = index.insert(right)
    assert dropped(more) == dropped(whole) and counted(more) == counted(whole)
    less = more.delete(right.select("doc_id"))
    assert dropped(less) == dropped(index) and counted(less) == counted(index)
    again = less.insert(right)  # a document may come back
    assert dropped(again) == dropped(whole) and counted(again) == counted(whole)
    assert counted(again.delete(right.select((F.col("doc_id") + 10**9).alias("doc_id")))) == counted(whole)
    with pytest.raises(ValueError):
        again.insert(right)


def test_line_index_grows(spark, monkeypatch):
    """Insertions and deletions until filters, shards and layers are built anew; the index stays that of a fresh build."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 64)
    monkeypatch.setattr(line_dedup, "LAYERS", 3)
    text = lambda i: "\n".join(f"a line that two hold {j}" for j in range(30 * i, 30 * i + 60)) + f"\nand one alone {i}"
    part = lambda ids: spark.createDataFrame([(i, text(i)) for i in ids], "doc_id long, text string")
    index, held = line_dedup.LineIndex.build(part(range(4))), set(range(4))
    for step in range(4):
        new = range(4 + 6 * step, 10 + 6 * step)
        index, held = index.insert(part(new)), held | set(new)
        gone = sorted(held)[1::4]
        index, held = index.delete(part(gone)), held - set(gone)
    fresh = line_dedup.LineIndex.build(part(sorted(held)))
    assert counted(index) == counted(fresh) and dropped(index) == dropped(fresh)
    assert index.keys == fresh.keys and index.shards > 1 and len(index.counts) <= 4
    filters = [line_dedup.CuckooFilter.from_bytes(r.cells) for r in index._cells().collect()]
    assert all(len(f.stash) <= 0.01 * f.cells.size and f.takes(0) for f in filters)
    assert sum(np.count_nonzero(f.cells) + len(f.stash) for f in filters) == index.keys


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, 20_000))
    f = line_dedup.CuckooFilter.sized(len(keys))
    f.insert(keys)
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(keys).all()
    assert f.contains(rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.01
    f.delete(keys[::2])
    assert f.contains(keys[1::2]).all() and f.contains(keys[::2]).mean() < 0.01
    small = line_dedup.CuckooFilter.sized(1)
    small.insert(keys[:400])
    assert small.contains(keys[:400]).all()


def test_near_duplicates(docs, rows, empty):
    want = brute.near_duplicates(rows)
    for r in near_dup.near_duplicates(docs).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert near_dup.near_duplicates(empty).count() == 0


def test_rows_that_repeat_a_doc_id_are_one_document(spark):
    """Of rows that differ the one of the least text counts, run after run, and each row gets its result."""
    prose = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcd"]
    rows = [(1, prose[1]), (1, prose[0]), (2, prose[0]), (3, prose[1]), (3, prose[1]), (4, None), (4, prose[2]), (5, prose[2]), (None, prose[0]), (None, prose[0])]
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    want = [(1, 36, 1, True)] * 2 + [(2, 36, 1, False)] + [(3, 36, 3, True)] * 2 + [(4, 0, 4, True)] * 2 + [(5, 36, 5, True)] + [(None, 36, None, True)] * 2
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_near_copies_of_one_text(spark):
    """A large group whose members differ more from each other than from the original."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(300):
        own = list(words)
        for at in rng.choice(200, rng.integers(0, 5), replace=False):
            own[at] = f"e{i}x{at}"
        texts.append(" ".join(own))
    docs = list(enumerate(texts))
    want = brute.near_duplicates(docs)
    found = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: c for i, (_, c) in want.items()}


def test_shared_values_follow_the_threshold():
    least = lambda percent: (near_dup.shared_least(near_dup.K, percent, near_dup.MISS), near_dup.shared_least(near_dup.WIDE, percent, near_dup.WIDE_MISS))
    assert least(85) == (10, 173) and least(80) == (7, 156)
    assert near_dup.shared_least(32, 100, 1e-7) == 32


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path())
    found = packing.pack(docs, tokenizer_path(), with_ids=True).toPandas()
    got = collections.Counter()
    for r in found.itertuples():
        got[r.doc_id if r.doc_id == r.doc_id else None, r.piece, r.start, r.length, tuple(r.ids)] += 1
    want = collections.Counter()
    for i, t in rows:
        ids = coder.encode(t or "", add_special_tokens=False).ids + [2]
        many, at = -(-len(ids) // 1024), 0
        for p in range(many):
            size = len(ids) - (many - 1) * 1024 if p == 0 else 1024
            want[i, p, at, size, tuple(ids[at : at + size])] += 1
            at += size
    assert got == want
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        ends = (own.offset + own.length).tolist()
        assert own.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 1024
    assert found.sequence_id.nunique() == brute.best_fit(found.length)
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_remembered_words_are_bounded_by_size():
    """36 MB of distinct long words, far fewer than may be remembered by number, and ids as ever, before and after words are forgotten."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain, coder, most = Tokenizer.from_file(tokenizer_path()), packing.Tokens(tokenizer_path()), 0
    for k in range(12):
        text = " ".join(chr(97 + k) + chr(97 + j // 26) + chr(97 + j % 26) + "word" * 1200 for j in range(600))
        ids, bounds = coder.batch(pa.array([text, "a few words", None]))
        most = max(most, sum(map(len, coder.index)) + coder.used)
        own = [plain.encode(t, add_special_tokens=False).ids for t in (text, "a few words", "")] if k % 5 == 0 else []
        assert all(ids[bounds[i] : bounds[i + 1]].tolist() == x for i, x in enumerate(own))
    assert most < 24 << 20


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_plan(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 65, rng.integers(1, 400))
    histogram = collections.Counter(sizes.tolist())
    plan = packing.best_fit_plan(histogram, 64)
    bins = collections.defaultdict(list)
    for size, many in histogram.items():
        own = plan[plan[:, 0] == size]
        for rank in range(many):
            _, first_rank, first, per, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1].tolist()
            bins[first + (rank - first_rank) // per].append((offset + (rank - first_rank) % per * size, size))
    for held in bins.values():
        held.sort()
        assert [a for a, _ in held] == [0, *np.cumsum([s for _, s in held])[:-1]] and sum(s for _, s in held) <= 64
    assert len(bins) == brute.best_fit(sizes.tolist(), 64)


def test_mixing(docs, rows, empty):
    found = mixing.mix_sources(docs, block_words=64, slots_per_shard=128).taken().collect()
    sizes = collections.Counter(len(brute.WORD.findall(t or "")) for _, t in rows)
    assert collections.Counter(r["size"] for r in found) == sizes
    assert all(r.taken <= 3 * r["size"] for r in found)
    sources = [r.source for r in docs.select("source").distinct().collect()]
    sources = sorted(s for s in sources if s is not None) + [None]
    total, held = collections.Counter(), {}
    for r in docs.select("source", "text").collect():
        total[r.source] += len(brute.WORD.findall(r.text or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    held, free, left = {}, list(sources), sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s]]
        if not over:
            held |= share
            break
        for s in over:
            held[s] = 3.0 * total[s]
            left -= held[s]
            free.remove(s)
    taken = collections.Counter()
    for r in found:
        taken[r.target, r.source_size] += r.taken
    for (target, size), words in taken.items():
        assert any(math.isclose(target, held[s], rel_tol=1e-9, abs_tol=1e-6) and total[s] == size for s in sources)
        assert abs(words - target * sum(math.isclose(held[s], target) and total[s] == size for s in sources)) <= 2
    again = mixing.mix_sources(docs, block_words=64, slots_per_shard=128).taken().collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mix_sources(empty).taken().count() == 0


def test_mixed_documents_hold_what_is_taken(docs):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(unique, block_words=64).taken().collect()}
    mixed = mixing.mixed_documents(unique, block_words=64)
    assert mixed.columns == unique.columns
    words = collections.Counter()
    for r in mixed.select("doc_id", "text").collect():
        words[r.doc_id] += len(brute.WORD.findall(r.text or ""))
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in words.items() if n}


def test_mixed_documents_keep_their_text(spark):
    """Of a hot source with a small weight only a part is taken: whole documents as they are, others cut out of the text."""
    text = lambda i: f"  def f{i}():\n\treturn  {i}\r\n\n" + "\n".join(f"\tline {i}  {j}" for j in range(i % 90)) + "\n"
    texts = {i: text(i) for i in range(400)}
    docs = spark.createDataFrame([(i, t, "a" if i % 4 else "b") for i, t in texts.items()], "doc_id long, text string, source string")
    size = {i: len(brute.WORD.findall(t)) for i, t in texts.items()}
    mixed = mixing.mixed_documents(docs, block_words=64).collect()
    words = collections.Counter()
    for r in mixed:
        words[r.doc_id] += len(brute.WORD.findall(r.text))
        assert r.text in texts[r.doc_id]
        assert r.text == texts[r.doc_id] or len(brute.WORD.findall(r.text)) < size[r.doc_id]
    assert words == {r.doc_id: r.taken for r in mixing.mix_sources(docs, block_words=64).taken().collect() if r.taken}
    of_hot = [r for r in mixed if r.source == "a"]
    assert len({r.doc_id for r in of_hot}) < 300 and sum(r.text == texts[r.doc_id] for r in of_hot) > 30


def test_quality(spark, sf, docs, empty):
    labels = spark.read.parquet(f"{sf}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 0), (10**6, None, 0), (77777777, 1, 0)], "doc_id long, quality int, toxic int"))
    found = quality.score(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert all(r.held_out == (r.doc_id is not None and brute.crc_fifth(r.doc_id)) for r in found)
    assert quality.score(empty, labels).count() == 0
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {1.0}


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.95
    assert (rows.predicted[rows.quality == 1] == 1).mean() > 0.98


def test_suffix_dedup(docs, rows, empty):
    known = {i: t for i, t in rows if i is not None}
    want = brute.repeats(known.items())
    for r in suffix_dedup.substring_digest(docs).collect():
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert suffix_dedup.substring_digest(empty).count() == 0


def digest(docs, **settings):
    found = suffix_dedup.without_repeats(docs, suffix_dedup.coverage(docs, **settings), False)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()}


@pytest.mark.parametrize("over", [-1, 0, 1, 301])
def test_texts_around_a_part(spark, over):
    """Texts that fill a part to its last byte, or one more, beside others in the same batch."""
    rng, most = random.Random(over), 4000
    prose = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    long_text = prose(most - 99 + over - 500)
    texts = {9: prose(500), 2: long_text, 5: long_text[1000:1300] + prose(40), 4: prose(700), 7: long_text[-250:], 1: prose(2 * most) + long_text[:200]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    assert digest(docs, part_bytes=most) == brute.repeats(texts.items())


def test_long_texts_run_apart(spark):
    """Three documents of which the second fills a part of the usual size but for a few bytes."""
    rng = np.random.default_rng(4)
    huge = "".join(map(chr, rng.integers(97, 123, (1 << 24) - 550)))
    texts = {9: "".join(map(chr, rng.integers(97, 123, 500))), 2: huge, 5: huge[5000:5300]}
    found = digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1))
    assert [found[i][1:3] for i in (9, 2, 5)] == [(0, 0), (0, 0), (300, 1)]


def test_a_passage_of_many_documents(spark):
    """A passage that all documents have, each in its own surroundings: its group is cut into windows."""
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    passage, short = prose(400), prose(104)
    texts = {i: prose(rng.randint(0, 150)) + passage + prose(rng.randint(0, 150)) + (short if i % 3 else "") + prose(30) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute.repeats(texts.items())
    assert digest(docs, hot=10) == want == digest(docs)


def test_texts_of_a_megabyte(spark):
    """Very long texts beside short ones, through every operator over texts."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(30_000)]
    long_text = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(14_000))
    edited = long_text.replace(words[5], "edited")
    texts = {3: long_text, 1: long_text[400_000:400_900] + " mail a.b@c.de", 7: edited, 9: "short", 4: long_text[-5000:] + "\ntoken=abcdefgh " + "deadbeef" * 4}
    assert len(long_text) > 1_000_000
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert digest(docs) == brute.repeats(texts.items())
    lines = brute.line_dedup(list(texts.items()))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_digest(docs).collect()} == {i: v for (i, _), v in lines.items()}
    near = brute.near_duplicates(list(texts.items()))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs).collect()} == near
    spans = {i: span_text([(k, a, b) for a, k, b in brute.secrets(t)], secrets.KINDS) for i, t in texts.items()}
    assert {r.doc_id: r.base_sha256 for r in secrets.secret_digest(docs).collect()} == {i: brute.sha(t) for i, t in spans.items()}
    assert {r.doc_id: r.base_sha256 for r in pii.personal_digest(docs).collect()} == {i: brute.sha(span_text(brute.personal(t), pii.KINDS)) for i, t in texts.items()}
    assert {r.doc_id: r["size"] for r in mixing.mix_sources(docs.withColumn("source", F.lit("s"))).taken().collect()} == {i: len(brute.WORD.findall(t)) for i, t in texts.items()}
    packed = packing.pack(docs, tokenizer_path()).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024 and set(packed.doc_id) == set(texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in texts], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in quality.score(docs, labels).collect()} == set(texts)
