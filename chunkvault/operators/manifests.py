"""Manifests: one row a snapshot, its ordered fingerprints, and their encoding against a base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chunkvault.operators.chunks import GRANULARITY, chunk_count, chunk_scan, header_fingerprint, list_fingerprint
from chunkvault.storage import discard, store

#: A base list is worth keeping from this many words on (fixed value).
BASE_WORDS = 600
#: Up to so many repeated keys are told apart from the other rows, which then aren't shuffled.
MANY_KEYS = 100_000


def build_manifests(files: DataFrame, granularity: int = GRANULARITY) -> DataFrame:
    """Rows (db_id, len, n_chunks, header_fp, contents_fp). Fingerprints are folded inside a row: no shuffle."""
    chunks = F.transform(_slices(granularity), lambda x: F.md5(x))
    return files.select(
        "db_id",
        F.octet_length("content").cast("long").alias("len"),
        chunk_count(F.octet_length("content"), granularity).alias("n_chunks"),
        header_fingerprint(F.col("content")).alias("header_fp"),
        F.md5(F.array_join(chunks, "").cast("binary")).alias("contents_fp"),
    )


def _slices(granularity: int) -> Column:
    from chunkvault.operators.chunks import slices

    return slices(F.col("content"), granularity)


def manifest_from_chunks(chunks: DataFrame) -> DataFrame:
    """The same from chunk rows, which may come from anywhere: one aggregate by db_id."""
    return chunks.groupBy("db_id").agg(F.sum("size").alias("len"), F.count(F.lit(1)).alias("n_chunks"), list_fingerprint(F.col("chunk_index"), F.col("fp")).alias("contents_fp"))


def words(content: Column, granularity: int) -> Column:
    """The flat list of 64-bit words of a file's fingerprints."""
    from chunkvault.operators.chunks import slices

    halves = F.transform(slices(content, granularity), lambda x: F.array(F.conv(F.substring(F.md5(x), 1, 16), 16, -10).cast("long"), F.conv(F.substring(F.md5(x), 17, 16), 16, -10).cast("long")))
    return F.flatten(halves)


def xor_base(own: Column, base: Column) -> Column:
    """own with base folded in by exclusive or; base is padded with zeros or cut to the length of own. Its own inverse."""
    fit = F.slice(F.concat(F.coalesce(base, F.array().cast("array<bigint>")), F.array_repeat(F.lit(0).cast("long"), F.size(own))), F.lit(1), F.greatest(F.size(own), F.lit(1)))
    return F.when(F.size(own) > 0, F.zip_with(own, fit, lambda a, b: a.bitwiseXOR(b))).otherwise(own)


def chain(files: DataFrame) -> DataFrame:
    """Rows (chain, db_id, prev_id): files of one chain as successive versions, each beside the one before. Only ids pass through the window."""
    return files.select("chain", "db_id").withColumn("prev_id", F.lag("db_id").over(W.partitionBy("chain").orderBy("db_id")))


def beside_previous(files: DataFrame, value: Column, name: str) -> DataFrame:
    """Rows (db_id, prev_id, name, prev_name): a value of each file beside that of the version before; contents stay where they are."""
    own = files.select("db_id", value.alias(name))
    before = own.select(F.col("db_id").alias("prev_id"), F.col(name).alias(f"prev_{name}"))
    return chain(files).join(before, "prev_id", "left").join(own, "db_id").select("db_id", "prev_id", name, f"prev_{name}")


def base_action(matches: Column, total: Column, draw: Column) -> Column:
    """Reuse the base if draw is below the matching words, start none on short lists, else refresh it."""
    return F.when(draw < matches, "reuse").when(total < BASE_WORDS, "none").otherwise("refresh")


def substitute_bundled(chunks: DataFrame, bundled: DataFrame) -> DataFrame:
    """Data of chunks, from the manifest itself where it bundles that (db_id, chunk_index, fp)."""
    own = bundled.select("db_id", "chunk_index", "fp", F.col("data").alias("bundled_data"))
    return chunks.join(own, ["db_id", "chunk_index", "fp"], "left").withColumn("data", F.coalesce("bundled_data", "data")).drop("bundled_data")


def latest(manifests: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last manifest of each key: max_by over partial aggregates, no sort of all versions."""
    rest = [c for c in manifests.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("m")
    return manifests.groupBy(*key).agg(last).select(*key, "m.*")


def once(rows: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """The last row of each key, or any of them if no order is given. Only keys are shuffled: rows whose key is not repeated stay where they are, with
    their bytes, and where none is, rows are returned as they are."""
    counts = rows.select(*key).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    again = store(counts, "repeated-keys")
    many = again.count()
    if not many:
        discard(again)
        return rows
    nth = F.row_number().over(W.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order or key]))
    first = lambda some: some.withColumn("_nth", nth).where("_nth = 1").select(*rows.columns)
    if many > MANY_KEYS:  # as many as would shuffle all rows to be found, and once more to be left out
        return first(rows)
    return rows.join(again, key, "left_anti").select(*rows.columns).unionByName(first(rows.join(again, key, "left_semi")))


def lacking(rows: DataFrame, key: str, held: DataFrame) -> DataFrame:
    """Rows whose key is not among those of held. Keys are compared first; where none is there, rows are returned as they are, and else only
    the keys that are meet the rows."""
    known = store(rows.select(key).join(held.select(key), key, "left_semi").distinct(), "known-keys")
    return without(rows, key, known)


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows whose key is not in gone, which is a stored table."""
    return rows if gone.isEmpty() else rows.join(gone, key, "left_anti").select(*rows.columns)


def within(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is among those of wanted. Keys are compared first; where all are, rows are returned as they are."""
    if rows.select(key).join(wanted.select(key), key, "left_anti").isEmpty():
        return rows
    return rows.join(wanted.select(key), key, "left_semi").select(*rows.columns)


def as_of(manifests: DataFrame, probes: DataFrame, key: str, at: str, seen: str) -> DataFrame:
    """For each probe the last manifest of its key not after it, by one window over both."""
    rest = [c for c in manifests.columns if c not in (key, seen)]
    left = manifests.select(key, F.col(seen).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(seen), *rest).alias("_m"), *[F.lit(None).cast(t).alias(f"_p_{c}") for c, t in probes.dtypes])
    right = probes.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema["_m"].dataType).alias("_m"), *[F.col(c).alias(f"_p_{c}") for c in probes.columns])
    upto = W.partitionBy(key).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_m", F.last("_m", ignorenulls=True).over(upto)).where("_side = 1")
    return both.select(*[F.col(f"_p_{c}").alias(c) for c in probes.columns], F.col(f"_m.{seen}").alias(seen), *[F.col(f"_m.{c}").alias(c) for c in rest])


def scan_and_check(files: DataFrame, granularity: int = GRANULARITY) -> DataFrame:
    """Snapshot, restore and compare: rows (db_id, n_chunks, len, contents_fp, restored_ok). Chunks are stored by fingerprint, fetched again for
    each place, and compared by digest; no file is put together, so none has to fit one row, and no bytes are shuffled."""
    chunks = chunk_scan(files, granularity, with_data=True).select("db_id", "chunk_index", "size", "fp", F.sha2("data", 256).alias("digest"))
    stored = chunks.groupBy("fp").agg(F.min("digest").alias("stored"), F.min("size").alias("stored_size"))
    fetched = chunks.join(stored, "fp", "left")
    sound = F.every(F.coalesce((F.col("digest") == F.col("stored")) & (F.col("size") == F.col("stored_size")), F.lit(False)))
    restored = fetched.groupBy("db_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("stored_size").alias("len"), list_fingerprint(F.col("chunk_index"), F.col("fp")).alias("contents_fp"), sound.alias("sound"))
    out = files.select("db_id", F.octet_length("content").cast("long").alias("want")).join(restored, "db_id", "left")
    same = (F.col("want") == F.coalesce("len", F.lit(0))) & F.coalesce("sound", F.col("want") == 0)
    return out.select("db_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("contents_fp", F.md5(F.lit("").cast("binary"))).alias("contents_fp"), same.alias("restored_ok"))


#: A manifest as a row. words are the fingerprints' halves, folded with those of the base chunk if there is one; bundled chunks come with their bytes.
MANIFEST = (
    "db_id long, host string, path string, seq long, version string, ctime long, len long, header_fp string, contents_fp string, base_fp string, "
    "words array<bigint>, bundled array<struct<chunk_index:bigint,chunk_offset:bigint,fp:string,data:binary>>"
)
#: Offsets of the chunks that manifests bundle (fixed value).
BUNDLED_OFFSETS = (0,)


def manifest_rows(files: DataFrame, granularity: int = GRANULARITY) -> DataFrame:
    """Manifests of files (db_id, host, path, seq, version, ctime, content) without a base, by array functions within a row: no shuffle."""
    from chunkvault.operators.chunks import slices

    cut = files.withColumn("_s", slices(F.col("content"), granularity))
    fps = F.transform("_s", lambda x: F.md5(x))
    part = lambda i: F.struct(F.lit(i // granularity).cast("long").alias("chunk_index"), F.lit(i).cast("long").alias("chunk_offset"), F.md5(F.get("_s", F.lit(i // granularity))).alias("fp"), F.get("_s", F.lit(i // granularity)).alias("data"))
    bundled = F.filter(F.array(*[part(i) for i in BUNDLED_OFFSETS]), lambda b: b["data"].isNotNull())
    return cut.select(
        "db_id", "host", "path", "seq", "version", "ctime", F.octet_length("content").cast("long").alias("len"), header_fingerprint(F.col("content")).alias("header_fp"),
        F.md5(F.array_join(fps, "").cast("binary")).alias("contents_fp"), F.lit(None).cast("string").alias("base_fp"), words(F.col("content"), granularity).alias("words"), bundled.alias("bundled"),
    )


def fingerprints_of(own: Column) -> Column:
    """Fingerprints from a flat list of words."""
    half = lambda at: F.lower(F.lpad(F.hex(F.get(own, at)), 16, "0"))
    return F.when(F.size(own) >= 2, F.transform(F.sequence(F.lit(0), F.floor(F.size(own) / 2).cast("int") - 1), lambda i: F.concat(half(2 * i), half(2 * i + 1)))).otherwise(F.array().cast("array<string>"))


def words_of_bytes(data: Column) -> Column:
    """Words from their bytes, least byte first."""
    pairs = lambda x: F.array_join(F.reverse(F.regexp_extract_all(x, F.lit(".."), F.lit(0))), "")
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit("(?:..){8}"), F.lit(0)), lambda x: F.conv(pairs(x), 16, -10).cast("long"))


def bytes_of_words(own: Column) -> Column:
    pairs = lambda w: F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(w), 16, "0"), F.lit(".."), F.lit(0))), "")
    return F.unhex(F.array_join(F.transform(own, pairs), ""))


def rebased(manifests: DataFrame, bases: DataFrame) -> DataFrame:
    """Manifests folded with the base chunks (base_fp, data) of their base_fp, which must be set; folding twice undoes it."""
    both = manifests.join(bases.select("base_fp", F.col("data").alias("_base")), "base_fp", "left")
    return both.withColumn("words", xor_base(F.col("words"), words_of_bytes(F.col("_base")))).select(*manifests.columns)


def decode_and_validate(manifests: DataFrame, chunks: DataFrame, need_header: bool = True) -> DataFrame:
    """Manifests with fps, the true list, and error, null for a sound one: the base chunk is fetched from chunks (fp, data) and folded out,
    and the list must have the fingerprint that the manifest says."""
    # Only the chunks that are asked for as bases are looked at.
    wanted = store(manifests.where("base_fp is not null").select("base_fp").distinct(), "bases")
    if wanted.isEmpty():
        both = manifests.withColumn("_base", F.lit(None).cast("binary"))
    else:
        bases = chunks.select(F.col("fp").alias("base_fp"), F.col("data").alias("_base")).join(wanted, "base_fp", "left_semi").dropDuplicates(["base_fp"])
        both = manifests.join(bases, "base_fp", "left")
    base = F.when(F.col("base_fp").isNotNull(), words_of_bytes(F.col("_base")))
    true = both.withColumn("words", xor_base(F.coalesce("words", F.array().cast("array<bigint>")), base)).withColumn("fps", fingerprints_of(F.col("words")))
    error = F.when(F.col("contents_fp").isNull(), "missing contents_fp").when(F.lit(need_header) & F.col("header_fp").isNull(), "missing header_fp")
    error = error.when(F.col("base_fp").isNotNull() & F.col("_base").isNull(), "base chunk not found").when(F.octet_length("_base") % 16 != 0, "base chunk has invalid size")
    error = error.when((F.size("words") % 2 != 0) | (F.md5(F.array_join("fps", "").cast("binary")) != F.col("contents_fp")), "invalid chunk list")
    return true.withColumn("error", error).select(*manifests.columns, "fps", "error")


def listed(manifests: DataFrame) -> DataFrame:
    """Chunk places (db_id, seq, chunk_index, fp) of decoded manifests."""
    return manifests.select("db_id", "seq", F.posexplode("fps").alias("i", "fp")).select("db_id", "seq", F.col("i").cast("long").alias("chunk_index"), "fp")
