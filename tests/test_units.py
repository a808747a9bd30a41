"""Single operators on small inputs: boundaries, round trips, and all size transitions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from chunkvault.functions import names as N
from chunkvault.operators import chunks as C
from chunkvault.operators import manifests as M
from chunkvault.operators import snapshots as S
from chunkvault.operators import tracking as T
from chunkvault.plans import catalog

G = 64


def test_chunk_boundaries(spark):
    sizes = [0, 1, 99, 100, G - 1, G, G + 1, 2 * G, 3 * G + 17]
    files = spark.createDataFrame([(i, bytes(k % 251 for k in range(n))) for i, n in enumerate(sizes)], "db_id long, content binary")
    found = {}
    for r in C.chunk_scan(files, G).collect():
        found.setdefault(r.db_id, []).append((r.chunk_index, r.begin, r.size, r.fp))
    for i, n in enumerate(sizes):
        data = bytes(k % 251 for k in range(n))
        want = [(j, j * G, len(data[j * G : (j + 1) * G]), hashlib.md5(data[j * G : (j + 1) * G]).hexdigest()) for j in range(-(-n // G))]
        assert sorted(found.get(i, [])) == want
    checked = M.scan_and_check(files, G).collect()
    assert all(r.restored_ok for r in checked) and len(checked) == len(sizes)


def test_every_range_of_six_by_six(spark):
    data = bytes(range(36))
    files = spark.createDataFrame([(1, data)], "db_id long, content binary")
    ranges = [(b * 100 + e, 1, b, e - b) for b in range(37) for e in range(b, 38)]
    probes = spark.createDataFrame(ranges, "probe_id long, db_id long, offset long, length long")
    got = {r.probe_id: r.bytes_hex for r in S.range_read(C.chunk_scan(files, 6, True), probes, 6).collect()}
    for i, _, off, n in ranges:
        assert got[i] == data[off : off + n].hex().upper()


def test_size_transitions_incremental_equals_full(spark):
    base = bytes((7 * k) % 256 for k in range(3 * G + 5))
    after = {1: base, 2: base + b"xyz", 3: base + b"q" * (2 * G), 4: base[: 3 * G + 1], 5: base[:G], 6: b"", 7: base[:10] + b"!" + base[11:]}
    new = spark.createDataFrame(list(after.items()), "db_id long, content binary")
    old = C.chunk_scan(spark.createDataFrame([(k, base) for k in after], "db_id long, content binary"), G)
    scanned = C.chunk_scan(new, G)
    n = spark.createDataFrame([(k, -(-len(v) // G), 4) for k, v in after.items()], "db_id long, n long, p long")
    sizes = n.select("db_id", "n", T.backfill_start(F.col("p"), F.col("n"), F.lit(False)).alias("backfill"))
    dirty = spark.createDataFrame([(7, 0), (2, 3), (3, 3), (4, 3), (5, 0)], "db_id long, chunk_index long")
    made = T.incremental(old.select("db_id", "chunk_index", "fp"), scanned.select("db_id", "chunk_index", "fp"), sizes, dirty)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, scanned.select("db_id", "chunk_index", "fp").collect()))


@pytest.mark.parametrize("n, least, most, want", [(1, None, None, 1), (100, None, None, 10), (10_000, None, None, 16), (100, None, 3, 3), (100, 20, None, 20), (4, 9, None, 4)])
def test_prefix_size(spark, n, least, most, want):
    assert spark.range(1).select(S.prefix_size(F.lit(n), least, most)).first()[0] == want


def test_xor_is_its_own_inverse(spark):
    rows = spark.createDataFrame([([1, 2, 3], [1]), ([1], [5, 6]), ([], [1]), ([4, -4], None)], "own array<bigint>, base array<bigint>")
    coded = rows.withColumn("coded", M.xor_base(F.col("own"), F.col("base")))
    for r in coded.withColumn("back", M.xor_base(F.col("coded"), F.col("base"))).collect():
        assert r.back == r.own
    assert coded.first().coded == [0, 2, 3]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


ODD_PATHS = ["/srv/data/a b.db", "/x/100%/y#1", "/tab\there/\x7f", "/naïve/ß/漢字.db", "/plus+and&more;=?", "/#%23%2F/../", "//", "/quotes'\"`<>[]{}|\\^~!$()*,:@"]


@pytest.mark.parametrize("path", ODD_PATHS)
def test_paths_as_file_names(spark, path):
    """By the rule: # for slashes; controls, #, % and bytes from 128 on as %XX; all else as it is."""
    name = one(spark, N.mangled(F.lit(path)))
    assert name == "".join("#" if b == 47 else f"%{b:02X}" if b < 32 or b > 126 or b in b"#%" else chr(b) for b in path.encode())
    assert "/" not in name and one(spark, N.unmangled(F.lit(name))) == path
    encoded = one(spark, N.percent_encoded(F.lit(path)))
    assert encoded == "".join(chr(b) if b < 128 and (chr(b).isalnum() or chr(b) in "!-_.*'()") else f"%{b:02X}" for b in path.encode())


@pytest.mark.parametrize("size, whole", [(10, True), (228, True), (229, False), (700, False)])
def test_long_names_keep_their_ends(spark, size, whole):
    for path in ("/" + "q" * size, "/" + "é" * (size // 6) + "q" * (size - size // 6 * 6)):
        plain = path.replace("/", "#").replace("é", "%C3%A9")
        name = one(spark, N.mangled(F.lit(path)))
        assert (name == plain) == whole and (whole or (len(name) == 240 and name.startswith(plain[:104]) and name.endswith(plain[-104:])))
        assert one(spark, N.unmangled(F.lit(name))) == (path if whole else None)


def test_fitting_counts_bytes(spark):
    name = one(spark, N.fitted(F.lit("é" * 150)))
    assert len(name.encode()) <= 255 and name[:52] == "é" * 52 and name.endswith("é" * 52)
    assert one(spark, N.fitted(F.lit("é" * 114 + "x"))) == "é" * 114 + "x"
    cut = one(spark, N.fitted(F.lit("x" + "é" * 150)))
    assert cut.startswith("x" + "é" * 51 + "\ufffd") and len(cut.encode()) <= 255


def test_chunk_names(spark):
    for fp in ("0" * 32, "f" * 31 + "e", "0123456789abcdef" * 2):
        assert one(spark, N.chunk_name_fp(N.chunk_name(F.lit(fp)))) == fp
    for bad in ("no name", "0" * 35, "g" * 16 + "%2F" + "0" * 16):
        assert one(spark, N.chunk_name_fp(F.lit(bad))) is None


@pytest.mark.parametrize("text, on", [("off", False), ("OFF", False), ("offset", True), ("official", True), ("no", False), ("N", False), ("false", False), ("0", False), ("1", True), ("", True), ("on", True)])
def test_bool_params(spark, text, on):
    assert one(spark, N.bool_param(F.lit(text), False)) is on
    assert one(spark, N.bool_param(F.lit(None).cast("string"), on)) is on


@pytest.mark.parametrize("region, given, want", [("eu-west-1", None, "https://s3.eu-west-1.amazonaws.com"), ("eu-west-1", "http://h:1", "http://h:1"), ("store", None, "https://store"), ("a.b.c:9", None, "https://b.c:9"), ("eu-west-9", None, "https://eu-west-9")])
def test_endpoints(spark, region, given, want):
    assert one(spark, N.endpoint(F.lit(region), F.lit(given))) == want


def test_package_stands_without_llm():
    import pathlib

    root = pathlib.Path(C.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "chunkvault.llm" not in path.read_text()


def test_wire_format():
    from chunkvault.functions.wire import decode_manifest, encode_manifest

    full = {
        "header_fprint": {"major": -1, "minor": 2}, "version_id": b"v", "contents_fprint": {"major": 0, "minor": 0}, "len": 1 << 40, "ctime": -5, "ctime_ns": -7, "base_chunks_fprint": None,
        "generated_by": b"x", "chunks": [1, -(1 << 63), (1 << 63) - 1], "bundled_chunks": [{"chunk_index": 3, "chunk_offset": 300, "chunk_fprint": None, "chunk_data": b"abc"}],
    }
    assert decode_manifest(encode_manifest(full)) == full
    assert encode_manifest({}) == b"\x0a\x00" and decode_manifest(b"\x0a\x00")["chunks"] == []
    assert encode_manifest({"len": 300}) == b"\x0a\x03\x28\xac\x02"
    for bad in (b"", b"\x0a\x05\x28"):
        with pytest.raises(ValueError):
            decode_manifest(bad)


def test_wire_bytes():
    """Buffers written by hand from the format: fields in order of their tags, lengths and fixed words least byte first."""
    from chunkvault.functions.wire import decode_manifest, encode_manifest

    body = b"\x0a\x12" + b"\x09" + (7).to_bytes(8, "little") + b"\x11" + b"\xff" * 8 + b"\x12\x02ab" + b"\x28\x81\x80\x04" + b"\x3d\x05\x00\x00\x00" + b"\x7a\x10" + (1).to_bytes(8, "little") + b"\xfe" + b"\xff" * 7
    data = b"\x0a" + bytes([len(body)]) + body
    made = {"header_fprint": {"major": 7, "minor": -1}, "version_id": b"ab", "len": 65537, "ctime_ns": 5, "chunks": [1, -2]}
    assert encode_manifest(made) == data
    found = decode_manifest(data)
    assert {k: found[k] for k in made} == made and found["contents_fprint"] is None and found["bundled_chunks"] == []


def test_stored_tables_go(spark):
    from chunkvault.filesystem import Folder
    from chunkvault.storage import CLEANUP, setting, shared_dir, store, tidy

    @tidy
    def operator(df):
        used, unused = store(df, "used"), store(df, "unused")
        return used.where("x > 0") if unused.count() else used

    names = lambda: {n.rpartition("-")[0] for n in Folder(spark, f"{shared_dir(spark)}/chunkvault").names()}
    before = names()
    assert operator(spark.range(3).toDF("x")).count() == 2
    assert names() - before == {"used"}
    before = spark.conf.get(CLEANUP)
    with setting(spark, CLEANUP, "true"):
        assert spark.conf.get(CLEANUP) == "true"
    assert spark.conf.get(CLEANUP) == before


def test_folds_stream_over_batches(spark):
    """A key with more events than a batch has rows: state is carried on."""
    from chunkvault.operators import maintenance as U
    from chunkvault.storage import setting

    events = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("e"), (F.col("id") * 3).alias("at"))
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "7"):
        kept = sorted(r.e for r in U.fold_kept(events, ["k"], "e", "at", 100).collect())
        granted = {r.e: r.granted for r in U.token_bucket(events, "k", "e", "at", 10, 3).collect()}
    want = []
    for k in range(2):
        last = None
        for e in range(k, 5000, 2):
            if last is None or 3 * e - last >= 100:
                want.append(e)
                last = 3 * e
    assert kept == sorted(want)
    level, last = 30, None
    for e in range(0, 5000, 2):
        level, last = min(30, level + (3 * e - last if last is not None else 0)), 3 * e
        assert granted[e] == (level >= 10)
        level -= 10 * (level >= 10)


def test_json_targets_needs_no_join(spark, sf):
    """Lists by the million: neither shuffled nor broadcast."""
    plan = catalog.queries()["json_targets"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_rows_whose_keys_are_not_repeated_stay_where_they_are(spark, monkeypatch):
    """Chunks and manifests carry bytes: only keys are compared, and rows are shuffled only as far as keys repeat or are known."""
    rows = spark.createDataFrame([("a", 1, b"x"), ("b", 1, b"y"), ("b", 2, b"z")], "k string, seq int, data binary")
    lone, held = rows.where("seq = 1"), spark.createDataFrame([("b",), ("c",)], "k string")
    assert M.once(lone, ["k"], ["seq"]) is lone
    assert M.lacking(lone, "k", held.where("k = 'c'")) is lone and M.within(lone, "k", rows) is lone
    for many in (100_000, 0):
        monkeypatch.setattr(M, "MANY_KEYS", many)
        assert sorted((r.k, bytes(r.data)) for r in M.once(rows, ["k"], ["seq"]).collect()) == [("a", b"x"), ("b", b"z")]
        assert sorted(r.k for r in M.once(rows, ["k"]).collect()) == ["a", "b"]
    assert [r.k for r in M.lacking(rows, "k", held).collect()] == ["a"] and [r.k for r in M.within(lone, "k", held).collect()] == ["b"]
