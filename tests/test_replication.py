"""Spools, targets, copiers and replicas: what is uploaded when, what survives a loss, and who may read what."""

import datetime
import http.server
import json
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from chunkvault import api
from chunkvault.copier import Copier, RecentWork, State, register_spool
from chunkvault.datasource import SnapshotSource
from chunkvault.errors import ChunkvaultError, InvalidManifestError, LockedError, NotFoundError, ReadOnlyError
from chunkvault.filesystem import Folder, Lock, delete_scratch
from chunkvault.functions.wire import decode_manifest
from chunkvault.replica import Replica
from chunkvault.sources.files import Options
from chunkvault.spool import Spool
from chunkvault.targets import Target, Tiers

G = 64
ROWS = "db_id long, host string, path string, version string, ctime long, content binary"


@pytest.fixture
def place(tmp_path):
    return str(tmp_path)


def files(spark, *rows):
    return spark.createDataFrame([(i, "h", f"/{i}", v, 10**18 + i, c) for i, v, c in rows], ROWS)


def spool_at(spark, place, remotes=1, boot=""):
    spool = Spool(spark, f"{place}/spool", G, boot)
    spool.write_targets([{"s3": {"directory": f"{place}/r{i}"}} for i in range(remotes)])
    return spool


def copier_of(spark, **settings):
    now = [1e9]

    def sleep(s):
        now[0] += s

    return Copier(spark, clock=lambda: now[0], sleep=sleep, **settings), now


def uploaded(spark, place):
    """What a reader of one target alone gets."""
    tiers = Tiers([], [], [Target(spark, place)])
    chunks = tiers.restored(Target(spark, place).manifests().drop("name", "uploaded"), G).collect()
    assert all(c.valid for c in chunks)
    out = {r.db_id: b"" for r in Target(spark, place).manifests().collect()}
    for c in sorted(chunks, key=lambda c: c.begin):
        out[c.db_id] += bytes(c.data)
    return out


ONE, TWO = bytes(range(250)) * 3, b"\0" * (3 * G) + b"tail"


@pytest.mark.parametrize("base", ["refresh"])  # the others: the tests below and staged_look
def test_what_is_staged_reaches_every_target(spark, place, base):
    spool, (copier, _) = spool_at(spark, place, 2), copier_of(spark)
    assert spool.stage(files(spark, (1, "a", ONE), (2, "a", TWO), (3, "a", b"")), base).count() == 3
    assert spool.stage(files(spark, (1, "a", ONE), (2, "a", TWO)), base).count() == 0
    assert copier.flush(spool)
    for i in range(2):
        assert uploaded(spark, f"{place}/r{i}") == {1: ONE, 2: TWO, 3: b""}
    assert spool.stage(files(spark, (1, "b", ONE + b"more"), (2, "a", TWO)), base).count() == 1
    assert copier.flush(spool) and uploaded(spark, f"{place}/r0") == {1: ONE + b"more", 2: TWO, 3: b""}
    assert spool.staged_chunks().count() == 0 and spool.sets() == []


def test_an_empty_version_matches_nothing(spark, place):
    spool = spool_at(spark, place)
    assert spool.stage(files(spark, (1, "", ONE))).count() == 1
    assert spool.stage(files(spark, (1, "", ONE))).count() == 1


def test_ready_sets_are_whole_and_wait(spark, place):
    spool, (copier, _) = spool_at(spark, place), copier_of(spark)
    assert not spool.publish_ready()
    spool.stage(files(spark, (1, "a", ONE)))
    assert spool.publish_ready() and not spool.publish_ready()
    spool.stage(files(spark, (1, "b", TWO)))
    state = State(spool)
    assert copier.handle_ready(state) and uploaded(spark, f"{place}/r0") == {1: ONE}
    assert not copier.handle_ready(state)
    assert copier.handle(state) and uploaded(spark, f"{place}/r0") == {1: TWO}


@pytest.mark.parametrize("step", ["tap", "staged-chunks", "look"])  # the others: crash_recovery
def test_a_lost_copier_is_taken_over(spark, place, step):
    spool, (lost, _) = spool_at(spark, place), copier_of(spark, draw=lambda: 0.0)
    spool.stage(files(spark, (1, "a", ONE), (2, "a", TWO)))
    if step not in ("staged-chunks", "look"):
        spool.publish_ready()
    lost.stop_after = step
    with pytest.raises(ChunkvaultError):
        lost.handle(lost.join(spool))
    if Target(spark, f"{place}/r0").root.exists():  # whatever there is to read is whole
        uploaded(spark, f"{place}/r0")
    copier, _ = copier_of(spark)
    copier.handle(copier.join(spool))
    assert uploaded(spark, f"{place}/r0") == {1: ONE, 2: TWO} and spool.sets() == []


def test_replication_never_goes_back(spark, place):
    spool, (copier, _) = spool_at(spark, place), copier_of(spark)
    spool.stage(files(spark, (1, "a", ONE)))
    old = spool.staged_manifests().collect()
    spool.stage(files(spark, (1, "b", TWO)))
    copier.flush(spool)
    late = spark.createDataFrame(old, spool.staged_manifests().schema)
    Target(spark, f"{place}/r0").put_manifests(late, F.lit(datetime.datetime(2040, 1, 1)))
    assert uploaded(spark, f"{place}/r0") == {1: TWO}


def test_without_targets_data_stays(spark, place):
    spool, (copier, _) = spool_at(spark, place, 0), copier_of(spark)
    spool.stage(files(spark, (1, "a", ONE)))
    spool.publish_ready()
    assert not copier.handle(State(spool)) and len(spool.sets()) == 1 and not copier.flush(spool)


def test_another_boot_starts_from_scratch(spark, place):
    first = spool_at(spark, place, boot="1.a")
    first.stage(files(spark, (1, "a", ONE)))
    again = spool_at(spark, place, boot="2.b")
    assert again.current().count() == 0
    (made,) = again.stage(files(spark, (1, "a", ONE))).collect()
    assert made.seq == 0 and made.base_fp is None


def test_garbage_and_forgetting(spark, place):
    spool = spool_at(spark, place)
    spool.stage(files(spark, (1, "a", ONE)))
    spool.stage(files(spark, (1, "b", TWO)))
    held = spool.staged_chunks().count()
    gone = spool.collect_garbage()
    assert gone > 0 and spool.staged_chunks().count() == held - gone and spool.collect_garbage() == 0
    spool.forget_versions()
    assert spool.staged_manifests().count() == 0


def test_bookkeeping(spark, place):
    spool, (copier, now) = spool_at(spark, place), copier_of(spark)
    state = copier.join(spool)
    copier.join(spool)
    path = spool.root.path
    assert copier.signal(path) and not copier.signal(path) and not copier.signal("/nowhere")
    spool.stage(files(spark, (1, "a", ONE)))
    assert copier.drain([path, path, "/nowhere"]) == {path: True}
    assert (state.successes, state.failures, state.updates, state.signalled) == (1, 0, 1, False)
    began = now[0]
    assert copier.work(state) is False and now[0] - began >= 0.5 and (state.successes, state.updates) == (2, 0)
    copier.stop_after = "look"
    spool.stage(files(spark, (1, "c", TWO)))
    assert copier.drain([], [path]) == {path: None} and state.failures == 2 and state.successes == 0
    state.stale = True
    assert copier.background() == [path]
    copier.leave(spool)
    assert path in copier.states
    copier.leave(spool)
    assert path not in copier.states and not copier.signal(path)


def test_a_patrol_forces_a_full_snapshot(spark, place):
    spool, (copier, now) = spool_at(spark, place), copier_of(spark)
    state = copier.join(spool)
    spool.stage(files(spark, (1, "a", ONE)), "none")
    copier.work(state)
    Target(spark, f"{place}/r0").chunks_at.delete()
    now[0] += 100_000
    copier.work(state)
    assert spool.staged_manifests().count() == 0
    (orphan,) = copier.orphans(spool, files(spark, (2, "a", b""))).collect()
    assert orphan.db_id == 1


def test_recent_work():
    recent = RecentWork(2, 600, lambda: 1.0)
    recent.observe("a", 10_000)
    assert recent.has_recent("a", 12_999) and recent.has_recent("a", 13_000) and not recent.has_recent("a", 13_001)
    recent.observe("b", 10_000)
    assert recent.has_recent("a", 10_000)
    recent.observe("c", 10_000)  # a was asked for last, so b goes
    assert not recent.has_recent("b", 10_000) and recent.has_recent("a", 10_000)
    recent.clear()
    assert not recent.has_recent("a", 10_000)


def replicated(spark, place, *versions):
    spool, (copier, _) = spool_at(spark, place), copier_of(spark)
    for v, c in versions:
        spool.stage(files(spark, (1, v, c)))
        copier.flush(spool)
    name = api.name_of(spark, "h", "/1")
    return spool, copier, lambda: Tiers([], [], [Target(spark, f"{place}/r0")]), name


def test_replica(spark, place):
    spool, copier, tiers, name = replicated(spark, place, ("a", ONE))
    replica = Replica(tiers, name, G)
    assert replica.size == len(ONE) and replica.ctime == "1000000000.000000001"
    for at, n in ((0, 10**6), (63, 2), (700, 1000), (750, 1), (-4, 3)):
        assert replica.read(at, n) == ONE[max(at, 0) : max(at, 0) + n]
    assert replica.page(740, 20) == ONE[740:] + bytes(10)
    assert bytes().join(bytes(r.data) for r in replica.chunks().orderBy("chunk_index").collect()) == ONE
    for call in (lambda: replica.write(b"x"), replica.truncate, replica.sync):
        with pytest.raises(ReadOnlyError):
            call()
    replica.lock("none")
    assert not replica.locked
    for level in ("reserved", "pending", "exclusive"):
        with pytest.raises(LockedError):
            replica.lock(level)
    replica.lock("shared")
    with pytest.raises(LockedError):
        replica.refresh(2)
    replica.unlock("shared")
    assert replica.locked
    replica.close()
    spool.stage(files(spark, (1, "b", TWO)))
    copier.flush(spool)
    before = replica.updated
    assert replica.refresh(0) == before and replica.size == len(ONE)
    replica.data.in_flight = True  # someone else fetches
    assert replica.refresh(1) == before
    assert replica.refresh(2) > before and replica.size == len(TWO)


def test_replicas_say_what_is_wrong(spark, place):
    _, _, tiers, name = replicated(spark, place, ("a", ONE))
    with pytest.raises(NotFoundError):
        Replica(tiers, "nothing", G)
    replica = Replica(tiers, name, G)
    target = Target(spark, f"{place}/r0")
    target.chunks_at.delete()
    with pytest.raises(NotFoundError):
        replica.read(0, 10**6)
    assert replica.read(0, 10) == ONE[:10]  # bundled with the manifest
    rows = target.manifests().withColumn("contents_fp", F.lit("0" * 32)).withColumn("seq", F.col("seq") + 1)
    target.put_manifests(spark.createDataFrame(rows.drop("name", "uploaded").collect(), rows.drop("name", "uploaded").schema), F.current_timestamp())
    with pytest.raises(InvalidManifestError, match="invalid chunk list"):
        replica.refresh(2)


def test_taps_are_read_first_for_two_days(spark, place):
    spool, _, _, name = replicated(spark, place, ("a", ONE))
    at = lambda days: F.lit(datetime.datetime(2001, 9, 9, 1, 46, 40, tzinfo=datetime.UTC) + datetime.timedelta(days=days))
    names = spark.createDataFrame([(name,), ("absent",)], "name string")
    tier = lambda days: [(r.name == name, r.tier) for r in Tiers([spool.tapped()], [], [Target(spark, f"{place}/r0")]).manifests(names, at(days)).collect()]
    assert tier(1) == [(True, 0)] and tier(3) == [(True, 1)] and tier(-1) == [(True, 1)]


def test_configuration_and_api(spark, place, monkeypatch):
    text = json.dumps({"replication_spooling_dir": f"{place}/spool", "granularity": G, "replication_targets": [{"s3": {"directory": f"{place}/r0", "create_buckets_on_demand": True}}, {"local": {"directory": f"{place}/c"}}, {"read_only": {"directory": f"{place}/ro"}}]})
    options = api.parse_configuration_string(text)
    assert api.parse_configuration_string("{") is None and api.parse_configuration_string("@/nowhere") is None
    monkeypatch.setenv("CHUNKVAULT_CONFIG", text)
    assert [t.kind for t in api.load_configuration_from_env().targets] == ["s3", "local", "read_only"]
    api.reset()
    assert api.configure(options) is options and api.configure(Options()) is options
    assert [t.root.path.rpartition("/")[2] for t in api.open_tiers(spark).caches] == ["c", "ro"]
    assert api.sync(spark, files(spark, (1, "a", ONE), (2, "a", TWO)), optimize=True).count() == 2
    assert api.flush(spark) and uploaded(spark, f"{place}/r0") == {1: ONE, 2: TWO}
    assert api.replica(spark, "h", "/1").read(0, 9) == ONE[:9]
    info = api.replication_info(spark, "h", "/2")
    assert (info.len, info.seq) == (len(TWO), 0) and api.replication_info(spark, "h", "/9") is None
    blob = api.manifest_bytes_for_path(spark, "replica://h/1")
    import zstandard

    found = decode_manifest(zstandard.ZstdDecompressor().decompress(blob))
    assert found["len"] == len(ONE) and found["generated_by"] == api.GENERATED_BY.encode() and found["bundled_chunks"][0]["chunk_data"] == ONE[:G]
    Folder(spark, f"{place}/m").write_bytes(blob)
    assert api.manifest_bytes_for_path(spark, f"file://{place}/m") == blob == api.manifest_bytes_for_path(spark, f"{place}/m")
    assert api.manifest_bytes_for_path(spark, f"{place}/none") is None and api.manifest_bytes_for_path(spark, "replica://h/9") is None
    for bad in ("replica://h", "s3://nobucket"):
        with pytest.raises(ChunkvaultError):
            api.manifest_bytes_for_path(spark, bad)
    api.reset()
    with pytest.raises(ChunkvaultError):
        api.open_spool(spark)
    facts = api.boot_facts()
    assert facts["host"] and set(facts) == {"boot_time", "boot_id", "host"}


def test_manifests_over_http(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/m" else 404)
            self.end_headers()
            self.wfile.write(b"bytes" if self.path == "/m" else b"")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    assert api.manifest_bytes_for_path(spark, f"{at}/m") == b"bytes" and api.manifest_bytes_for_path(spark, f"{at}/n") is None
    server.shutdown()


def test_spool_folders(spark, place):
    root = Folder(spark, f"{place}/spools")
    old, gone = register_spool(root, "/data/x y#.db", "1.2")
    assert gone == [] and old.exists()
    new, gone = register_spool(root, "/data/x y#.db", "1.3")
    assert gone == ["1.2"] and new.exists() and not old.exists()
    spool = Spool(spark, new.path, G)
    spool.write_targets([{"s3": {"directory": f"{place}/r0"}}])
    spool.stage(files(spark, (1, "a", ONE)))
    assert api.copy_all_spool_paths(spark, root.path) == ["/data/x y#.db"] and uploaded(spark, f"{place}/r0") == {1: ONE}
    assert api.copy_all_spool_paths(spark, f"{place}/none", best_effort=True) == []
    with pytest.raises(ChunkvaultError):
        api.copy_all_spool_paths(spark, f"{place}/none")


def test_missing_buckets(spark, place):
    closed = Target(spark, f"{place}/closed", create=False)
    with pytest.raises(ChunkvaultError):
        closed.put_chunks(spark.createDataFrame([("f" * 32, 1, b"x")], "fp string, size long, data binary"))
    closed.root.make()
    closed.put_chunks(spark.createDataFrame([("f" * 32, 1, b"x")], "fp string, size long, data binary"))
    assert closed.chunks().count() == 1


def test_locks_and_scratch(spark, place):
    folder = Folder(spark, place)
    first, second = Lock(folder), Lock(folder)
    assert first.take(0) and not second.take(0.2)
    first.__exit__()
    with second:
        assert second.held
    assert Lock(folder, lease_s=-1).take(0) and Lock(folder, lease_s=-1).take(1)  # the lease of a dead holder ends
    (folder / "s/a").write_bytes(b"x")
    at = (folder / "s/a").modified_ms()
    assert delete_scratch(folder / "s", at + 9_999) == [] and delete_scratch(folder / "s", at + 10_000) == ["a"]


def test_errors_keep_their_root(caplog):
    first = ChunkvaultError("lost", OSError("disk"), path="/x")
    again = ChunkvaultError("can't go on", first)
    assert again.root == first.root and again.__cause__ is first and isinstance(first.root, uuid.UUID)
    assert "root=" in caplog.text and "/x" in caplog.text and ChunkvaultError("other").root != first.root


def test_data_source(spark, place):
    replicated(spark, place, ("a", ONE), ("b", TWO))
    spark.dataSource.register(SnapshotSource)
    rows = spark.read.format("chunkvault").option("granularity", G).load(f"{place}/r0").orderBy("chunk_index").collect()
    assert b"".join(bytes(r.data) for r in rows) == TWO and {r.seq for r in rows} == {1} and rows[0].path == "/1"
    assert spark.read.format("chunkvault").option("name", "absent").load(f"{place}/r0").count() == 0


def test_command_line(spark, place, capsys):
    from chunkvault.__main__ import main

    api.reset()
    data = Folder(spark, f"{place}/data")
    (data / "one.db").write_bytes(ONE)
    (data / "two.db").write_bytes(TWO)
    config = json.dumps({"replication_spooling_dir": f"{place}/spool", "granularity": G, "replication_targets": [{"s3": {"directory": f"{place}/r0"}}]})
    run = lambda *args: (main(["--config", config, *args]), capsys.readouterr())
    code, said = run("sync", data.path, "--host", "h", "--optimize")
    names = said.out.split()
    path = f"file:{data.path}/one.db"
    assert code == 0 and len(names) == 2 and run("manifest-name", "h", path)[1].out.strip() == names[0]
    assert run("flush")[0] == 0
    assert run("restore", "h", path, f"{place}/out")[0] == 0 and Folder(spark, f"{place}/out").read_bytes() == ONE
    code, said = run("shell", "h", path, "select count(*) as many, sum(size) as bytes from chunks")
    assert code == 0 and f"|{-(-len(ONE) // G)}" in said.out.replace(" ", "") and str(len(ONE)) in said.out
    assert run("restore", "h", "/none", f"{place}/out")[0] == 1 and run("manifest", f"{place}/none")[0] == 1
    api.reset()


def test_chunks_of_files_of_any_size(spark, place):
    from chunkvault.operators.chunks import chunk_scan
    from chunkvault.sources.files import read_chunks, read_files

    for name, data in (("a.db", ONE), ("b %#.db", TWO), ("empty", b"")):
        Folder(spark, f"{place}/data/{name}").write_bytes(data)
    whole = chunk_scan(read_files(spark, f"{place}/data", "h"), G)
    ranged = read_chunks(spark, f"{place}/data", "h", G, 2).select("db_id", "chunk_index", "begin", "size", "fp")
    assert sorted(map(tuple, ranged.collect())) == sorted(map(tuple, whole.collect()))
