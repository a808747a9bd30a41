"""Personal data: base shapes, and information-theoretic sanitisation of what reveals them.

Base rules find e-mail and IP addresses, card and phone numbers; each distinct value is a protected entity. The other terms of
a document that holds it may give it away. Over the corpus, n_t documents hold term t, n_c entity c, and n_ct both. The
pointwise information of t about c is log2(N n_ct / (n_c n_t)), the information content of c is log2(N / n_c); t
discloses c once the first reaches the second divided by alpha (alpha 1: only terms never seen without c). Every
occurrence of a disclosing term in a document of the entity is a span of kind term: sanitise() removes those that never occur
without the entity and generalises the others. n_t is counted over every text, for terms that a bitmap of fixed size lets
through. As n_ct is at most n_c, a term with n_t over N^(1 - 1/alpha) n_c^(1/alpha) cannot disclose c, so such pairs are never
formed; Entities that one document holds are judged by the same threshold (support 1). n_ct and n_c are partial aggregates, and flagged pairs join documents by equi-joins.

Edge cases: a null text counts as empty; repeated rows are scanned and counted each; empty tables give empty results; very
long runs are scanned in linear time; columns besides doc_id and text are not read (sanitise passes them through).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkvault.llm.common import portions, restored, sheltered, store, tidy

KINDS = ("email", "ip", "card", "phone", "term")
# The base rules. The e-mail rule is applied from each @, so that long runs cost no more than their length.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Terms are runs of anything but ASCII space, control and punctuation characters.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TERM = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")
#: Bits of the bitmap of terms of documents that hold an entity.
BITMAP_BITS = 23
#: Terms whose counts a task sums before it hands them on.
TERMS_HELD = 200_000


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(c) - 9 * (c > "4") for c in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (found := DOMAIN.match(text, at + 1)):
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if any(map(text.__contains__, "0123456789")):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-3:] if len(x) > 3 else x) <= 255 for x in m.groups())] if "." in text else []
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


def _entity(kind: int, value: str) -> int:
    value = re.sub("[^0-9]", "", value) if kind >= 2 else value.lower()
    return xxhash.xxh64_intdigest(f"{kind}:{value}") - (1 << 63)


def _term(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode().translate(_LOWER)) - (1 << 63)


def _is_term(word: str) -> bool:
    return len(word) >= 3 and not word.isdigit()


def _marked(text: str, spans: list[tuple[int, int]], sure: dict[int, bool]) -> list[dict]:
    """Every occurrence outside spans of the terms that sure has."""
    covered, out, at = sorted(spans), [], 0
    for m in TERM.finditer(text):
        s, e = m.span()
        while at < len(covered) and covered[at][1] <= s:
            at += 1
        if _is_term(m.group()) and not (at < len(covered) and covered[at][0] < e) and (term := _term(m.group())) in sure:
            out.append({"start": s, "end": e, "sure": sure[term]})
    return out


def _coded(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct lowered words of binary texts and their hashes; for each word in the texts, its place among them and its text's."""
    texts = pc.fill_null(texts, b"")
    _, offsets, data = texts.buffers()
    lowered = (data.to_pybytes() if data else b"").translate(_LOWER)
    plain = pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(lowered), None, 0, texts.offset)
    lists = pc.ascii_split_whitespace(plain)
    words, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = words.dictionary_encode()
    known = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) - (1 << 63) for w in known), np.int64, len(known))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return known, hashes, codes, np.repeat(np.arange(len(texts)), np.diff(bounds))


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_MARK = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("sure", pa.bool_())])


def mentions(docs: DataFrame) -> DataFrame:
    """Rows (row, doc_id, base, entities, text): row numbers the documents; text is that of documents with entities, else null."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() << 40
        for batch in portions(batches):
            base, entities, texts = [], [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text or "")
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
                entities.append(sorted({_entity(k, text[a:b]) for k, a, b in spans}))
                texts.append(text if spans else None)
            n = batch.num_rows
            columns = [pa.array(np.arange(nth, nth + n)), batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(entities, pa.list_(pa.int64())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "base", "entities", "text"])
            nth += n

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(rows, f"row long, doc_id {kind}, base array<struct<kind:int,start:int,end:int>>, entities array<long>, text string")


def held_terms(found: DataFrame) -> DataFrame:
    """Rows (row, term): the distinct terms of each document with entities."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            known, hashes, codes, doc = _coded(batch.column(1))
            terms = np.fromiter(map(_is_term, known), bool, len(known))
            own = terms[codes] if len(codes) else np.zeros(0, bool)
            pairs, many = np.unique(doc[own] * max(len(known), 1) + codes[own]), max(len(known), 1)
            at = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(at[pairs // many]), pa.array(hashes[pairs % many])], ["row", "term"])

    return found.where("text is not null").select("row", F.col("text").cast("binary").alias("text")).mapInArrow(rows, "row long, term long")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows (term, n_t): in how many documents each of terms is; some other terms too. The bitmap only spares most of those; its size is fixed."""
    place = F.shiftrightunsigned("term", 64 - BITMAP_BITS)
    words = terms.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    found = words.toPandas()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bitmap[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    bitmap = bitmap.view(np.uint64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in portions(batches):
            _, hashes, codes, doc = _coded(batch.column(0))
            at = hashes.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
            hit = (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            own = hit.astype(bool)[codes] if len(codes) else np.zeros(0, bool)
            pairs = np.unique(doc[own] * max(len(hashes), 1) + codes[own])
            terms, first = np.unique(np.concatenate([terms, hashes[pairs % max(len(hashes), 1)]]), return_inverse=True)
            counts = np.bincount(first, np.concatenate([counts, np.ones(len(pairs), np.int64)]), len(terms)).astype(np.int64)
            if len(terms) > TERMS_HELD:
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], ["term", "many"])
                terms, counts = terms[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], ["term", "many"])

    counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(rows, "term long, many long")
    return counts.groupBy("term").agg(F.sum("many").alias("n_t"))


def disclosing(found: DataFrame, docs: DataFrame, alpha: float, support: int) -> DataFrame:
    """Rows (row, term, sure): the terms of a document that disclose an entity of it; sure if a term never occurs without the entity."""
    n = float(max(found.count(), 1))
    entities = found.select("row", F.explode("entities").alias("entity"))
    entities = store(entities.join(entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c")), "entity"), "pii-entities")
    counts = store(term_counts(docs, held_terms(found)), "pii-counts")
    most = lambda n_c: F.pow(F.lit(n), F.lit(1 - 1 / alpha)) * F.pow(F.col(n_c).cast("double"), F.lit(1 / alpha)) * (1 + 1e-9)
    tops = entities.groupBy("row").agg(F.max("n_c").alias("top"))
    rare = store(held_terms(found).join(counts, "term").join(tops, "row").where(F.col("n_t") <= most("top")).select("row", "term", "n_t"), "pii-terms")
    pairs = rare.join(entities, "row").where(F.col("n_t") <= most("n_c"))
    both = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_ct"), F.first("n_c").alias("n_c"), F.first("n_t").alias("n_t")).where(F.col("n_ct") >= support)
    told = F.log2(F.lit(n) * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    content = F.log2(F.lit(n) / F.col("n_c"))
    flagged = store(both.where((told >= content / alpha) & (content > 0)).select("entity", "term", (F.col("n_ct") == F.col("n_t")).alias("sure")), "pii-flagged")
    return pairs.join(flagged, ["entity", "term"]).groupBy("row", "term").agg(F.max("sure").alias("sure"))


def marked_terms(found: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows (row, terms): where the terms of hits (row, term, sure) stand in their documents, outside base spans."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            lists = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            out = [_marked(text, [(x["start"], x["end"]) for x in base], {h["term"]: h["sure"] for h in own}) for text, base, own in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(_MARK))], ["row", "terms"])

    per_row = hits.groupBy("row").agg(F.collect_list(F.struct("term", "sure")).alias("own"))
    return found.join(per_row, "row").select("row", "text", "base", "own").mapInArrow(rows, "row long, terms array<struct<start:int,end:int,sure:boolean>>")


@tidy
def find_personal(docs: DataFrame, alpha: float = 1.25, support: int = 1) -> DataFrame:
    """Per document: doc_id, base (kind, start, end) by kind and start, and terms (start, end, sure) by start."""
    found = store(mentions(docs), "pii-found")
    terms = store(marked_terms(found, disclosing(found, docs, alpha, support)), "pii-marked")
    out = found.select("row", "doc_id", "base").join(terms, "row", "left")
    return out.select("doc_id", "base", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,sure:boolean>>")).alias("terms"))


@tidy
def personal_digest(docs: DataFrame, alpha: float = 1.25, support: int = 1) -> DataFrame:
    """The columns of the contract."""
    found = find_personal(docs, alpha, support)
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    terms = F.transform("terms", lambda t: F.struct(F.lit(4).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    sha = F.sha2(joined(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], sha.alias("base_sha256"), joined(F.concat("base", terms)).alias("spans"))


@tidy
def sanitise(docs: DataFrame, alpha: float = 1.25, support: int = 1) -> DataFrame:
    """docs with spans replaced in text: base spans by their kind in brackets, disclosing terms by [term], or nothing if they never
    occur without the entity. doc_id tells documents apart."""
    spans = find_personal(docs, alpha, support).dropDuplicates(["doc_id"]).withColumnsRenamed({"doc_id": "_id", "base": "_base", "terms": "_terms"})
    joined = sheltered(docs, ["doc_id", "text"]).join(spans, F.col("doc_id").eqNullSafe(F.col("_id")))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    base = F.transform("_base", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), F.element_at(names, s["kind"] + 1).alias("by")))
    terms = F.transform("_terms", lambda t: F.struct(t["start"].alias("a"), t["end"].alias("b"), F.when(t["sure"], "").otherwise("[term]").alias("by")))
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.coalesce("text", F.lit(""))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["a"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["b"]).alias("at"), F.when(s["a"] >= acc["at"], F.concat(acc["out"], gap, s["by"])).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(F.array_sort(F.concat(base, terms)), empty, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return restored(joined.withColumn("text", F.when(F.col("text").isNotNull(), clean)), docs)


def span_digest(spans: list[tuple[int, int, int]]) -> str:
    """The digest of base spans, for tests against brute force."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
