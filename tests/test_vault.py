"""The store end to end: snapshots, changes, reads back, damage and collection."""

import json

import pytest

from chunkvault.errors import ReadOnlyError
from chunkvault.sources.files import Options, read_files
from chunkvault.vault import Vault

G = 64


def test_sync_restore_and_collect(spark, tmp_path):
    vault = Vault(spark, str(tmp_path / "vault"), G)
    one, two = b"a" * 200 + bytes(G * 2), b"\0" * G + b"end"
    schema = "db_id long, host string, path string, content binary"
    files = lambda *rows: spark.createDataFrame([(i, "h", f"/{i}", c) for i, c in rows], schema)
    assert vault.sync(files((1, one), (2, two), (3, b""))).count() == 3
    assert vault.sync(files((1, one), (2, two), (3, b""))).count() == 0
    changed = vault.sync(files((1, one + b"more"), (2, two))).collect()
    assert [(r.db_id, r.seq) for r in changed] == [(1, 1)]
    got = {r.db_id: (bytes(r.content), r.valid) for r in vault.restore().collect()}
    assert got == {1: (one + b"more", True), 2: (two, True), 3: (b"", True)}
    old = vault.manifests().where("db_id = 1 and seq = 0")
    assert bytes(vault.restore(old).first().content) == one
    probe = spark.createDataFrame([(7, 1, 190, 20), (8, 2, 1000, 5)], "probe_id long, db_id long, offset long, length long")
    assert {r.probe_id: r.bytes_hex for r in vault.read(probe).collect()} == {7: (one + b"more")[190:210].hex().upper(), 8: ""}
    assert vault.missing().count() == 0 and vault.garbage().count() == 0
    spark.createDataFrame([("f" * 32, 1, b"x")], "fp string, size long, data binary").write.mode("append").parquet(f"{vault.path}/chunks-0")
    (tmp_path / "vault/chunks-1").mkdir()  # left by a collection that was cut off
    assert vault.collect_garbage() == 1 and vault.collect_garbage() == 0
    assert sorted(p.name for p in (tmp_path / "vault").glob("chunks-*")) == ["chunks-1"]
    pieces = vault.restore_chunks().where("db_id = 1").orderBy("begin").collect()
    assert b"".join(bytes(r.data) for r in pieces) == one + b"more" and all(r.valid for r in pieces)
    assert {r.db_id: r.valid for r in vault.restore().collect()} == {1: True, 2: True, 3: True}
    with pytest.raises(ReadOnlyError):
        vault.write(b"")


def test_files_and_options(spark, tmp_path):
    (tmp_path / "a.db").write_bytes(b"123")
    assert [bytes(r.content) for r in read_files(spark, str(tmp_path), "h").collect()] == [b"123"]
    text = json.dumps({"make_default": True, "replication_targets": [{"s3": {"chunk_bucket": "chunks", "create_buckets_on_demand": True}}, {"local": {"directory": "key:token@/tmp/x"}}]})
    (tmp_path / "c.json").write_text(text)
    for given in (text, f"@{tmp_path / 'c.json'}"):
        options = Options.parse(given)
        assert options.make_default and [t.kind for t in options.targets] == ["s3", "local"] and options.targets[0].create
        assert "token" not in repr(options)
    assert Options.parse("{}").targets == []
    with pytest.raises(ValueError):
        Options.parse('{"replication_targets": [{"tape": {}}]}')
