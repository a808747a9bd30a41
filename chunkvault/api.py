"""The engine's functions: configuration, replication of files to targets, and reading back by URI."""

from __future__ import annotations

import logging
import os
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkvault import __version__
from chunkvault.copier import Copier
from chunkvault.errors import ChunkvaultError
from chunkvault.filesystem import Folder
from chunkvault.functions.codecs import compress
from chunkvault.functions.names import manifest_name, s3_parts, source_kind, unmangled
from chunkvault.functions.wire import MANIFEST, to_wire
from chunkvault.operators import maintenance as U
from chunkvault.replica import Replica
from chunkvault.sources.files import Options
from chunkvault.spool import Spool
from chunkvault.targets import Target, Tiers

log = logging.getLogger("chunkvault")
_defaults: Options | None = None

#: What made a manifest.
GENERATED_BY = f"chunkvault-v{__version__}"
DOWNLOAD_S = 30


def parse_configuration_string(text: str) -> Options | None:
    """Options from JSON or @file; None, with a warning, if that can't be read."""
    try:
        return Options.parse(text)
    except (OSError, ValueError, KeyError) as e:
        log.warning("bad configuration: %s", type(e).__name__)
        return None


def load_configuration_from_env(variable: str = "CHUNKVAULT_CONFIG") -> Options | None:
    return parse_configuration_string(os.environ[variable]) if variable in os.environ else None


def configure(options: Options) -> Options:
    """Sets the defaults of this process; the first one to do so wins. Returns what then holds."""
    global _defaults
    if _defaults is None:
        _defaults = options
    return _defaults


def defaults() -> Options:
    return _defaults or Options()


def reset() -> None:
    global _defaults
    _defaults = None


def open_spool(spark: SparkSession, options: Options | None = None, boot: str = "") -> Spool:
    """The spool of the options, which also tells copiers the targets."""
    options = options or defaults()
    if not options.spooling_dir:
        raise ChunkvaultError("no spooling directory", level=logging.INFO)
    spool = Spool(spark, options.spooling_dir, options.granularity, boot)
    spool.write_targets([{t.kind: {"directory": t.uri}} for t in options.targets])
    return spool


def open_tiers(spark: SparkSession, options: Options | None = None) -> Tiers:
    """Where a reader with these options looks."""
    options = options or defaults()
    taps = [Spool(spark, options.spooling_dir, options.granularity).tapped()] if options.spooling_dir else []
    caches = [t for t in options.targets if t.kind == "local"][:1] + [t for t in options.targets if t.kind == "read_only"] + [t for t in options.targets if t.kind == "local"][1:]
    return Tiers(taps, [Target(spark, t.uri) for t in caches], [Target(spark, t.uri, t.create) for t in options.targets if t.kind == "s3"])


def sync(spark: SparkSession, files: DataFrame, options: Options | None = None, optimize: bool = False) -> DataFrame:
    """Uploads what earlier runs have left, snapshots files (db_id, host, path, version, ctime, content), uploads that too, and returns
    the new manifests. optimize writes fresh base chunks and drops what no manifest needs."""
    spool, copier = open_spool(spark, options), Copier(spark)
    copier.flush(spool)
    made = spool.stage(files, "refresh" if optimize else "reuse")
    spool.publish_ready()
    if not copier.flush(spool):
        raise ChunkvaultError("some manifests did not reach the targets")
    if optimize:
        spool.collect_garbage()
    return made


def flush(spark: SparkSession, options: Options | None = None) -> bool:
    """Uploads all that is spooled, now; whether the targets then have it."""
    return Copier(spark).flush(open_spool(spark, options))


def copy_spool_path(spark: SparkSession, path: str) -> bool:
    """Copies one spool folder to the targets it names."""
    return Copier(spark).flush(Spool(spark, path))


def copy_all_spool_paths(spark: SparkSession, folder: str, best_effort: bool = False) -> list[str]:
    """Copies the newest spool of each file under folder (mangled path / key), and returns the files. A folder that doesn't exist is an error unless best_effort."""
    root = Folder(spark, folder)
    if not root.exists():
        if best_effort:
            return []
        raise ChunkvaultError("spooling directory not found", folder=folder)
    found = [(name, (root / name / key).modified_ms(), key) for name in root.names() if name.startswith("#") for key in (root / name).names()]
    if not found:
        return []
    newest = U.newest(spark.createDataFrame(found, "path string, at long, spool string"), "path", "at").select("path", "spool", unmangled(F.col("path")).alias("source")).collect()
    done = []
    for r in newest:
        if copy_spool_path(spark, f"{folder.rstrip('/')}/{r['path']}/{r['spool']}"):
            done.append(r["source"])
        elif not best_effort:
            raise ChunkvaultError("failed to copy spool", path=r["path"])
    return sorted(done)


def replica(spark: SparkSession, host: str, path: str, options: Options | None = None) -> Replica:
    options = options or defaults()
    return Replica(lambda: open_tiers(spark, options), name_of(spark, host, path), options.granularity)


def name_of(spark: SparkSession, host: str, path: str) -> str:
    return spark.range(1).select(manifest_name(F.lit(host), F.lit(path))).first()[0]


def replication_info(spark: SparkSession, host: str, path: str, options: Options | None = None):
    """The manifest row of a host's file (name, seq, ctime, len, header_fp, contents_fp) as its targets have it, or None."""
    names = spark.createDataFrame([(name_of(spark, host, path),)], "name string")
    return open_tiers(spark, options).manifests(names, F.current_timestamp()).select("name", "seq", "ctime", "len", "header_fp", "contents_fp").first()


def wire_form(manifests: DataFrame) -> DataFrame:
    """Rows (name, blob): manifests in the wire format, compressed."""
    pair = lambda c: F.when(F.col(c).isNotNull(), F.struct(*[F.conv(F.substring(c, at, 16), 16, -10).cast("long").alias(n) for at, n in ((1, "major"), (17, "minor"))]))
    half = lambda x, at: F.conv(F.substring(x, at, 16), 16, -10).cast("long")
    bundled = F.transform("bundled", lambda b: F.struct(b["chunk_index"].alias("chunk_index"), b["chunk_offset"].alias("chunk_offset"), F.struct(half(b["fp"], 1).alias("major"), half(b["fp"], 17).alias("minor")).alias("chunk_fprint"), b["data"].alias("chunk_data")))
    m = F.struct(
        pair("header_fp").alias("header_fprint"), F.col("version").cast("binary").alias("version_id"), pair("contents_fp").alias("contents_fprint"), "len", F.floor(F.col("ctime") / 1_000_000_000).alias("ctime"), (F.col("ctime") % 1_000_000_000).cast("int").alias("ctime_ns"),
        pair("base_fp").alias("base_chunks_fprint"), F.lit(GENERATED_BY.encode()).alias("generated_by"), F.col("words").alias("chunks"), bundled.alias("bundled_chunks"),
    )
    return manifests.select("name", compress(to_wire(m.cast(MANIFEST))).alias("blob"))


def manifest_bytes_for_path(spark: SparkSession, uri: str, options: Options | None = None) -> bytes | None:
    """The wire form of a manifest, by URI: http(s)://, s3://bucket.region[.endpoint]/blob, replica://host/path (an empty host is this one),
    file:// or a path; None where there is nothing."""
    kind, bucket, key = spark.range(1).select(source_kind(F.lit(uri)), *[s3_parts(F.lit(uri))[i] for i in (0, 2)]).first()
    if kind == "http":
        try:
            with urllib.request.urlopen(uri, timeout=DOWNLOAD_S) as got:
                return got.read()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            raise ChunkvaultError("failed to download manifest", e, uri=uri) from e
    if kind == "replica":
        host, slash, path = uri.removeprefix("replica://").partition("/")
        if not slash:
            raise ChunkvaultError("not of the form replica://host/path", uri=uri)
        names = spark.createDataFrame([(name_of(spark, host or os.uname().nodename, f"/{path}"),)], "name string")
        row = wire_form(open_tiers(spark, options).manifests(names, F.current_timestamp())).first()
        return bytes(row["blob"]) if row else None
    if kind == "s3" and not bucket:
        raise ChunkvaultError("not of the form s3://bucket.region[.endpoint]/blob", uri=uri)
    place = Folder(spark, f"s3a://{bucket}/{key}" if kind == "s3" else uri.removeprefix("file://"))
    return place.read_bytes() if place.exists() else None


def boot_facts() -> dict[str, str]:
    """Boot time, boot id and host name of this machine, '' where it doesn't tell."""

    def first(path: str, prefix: str = "") -> str:
        try:
            with open(path) as f:
                return next((x.removeprefix(prefix).strip() for x in f if x.startswith(prefix)), "")
        except OSError:
            return ""

    return {"boot_time": first("/proc/stat", "btime "), "boot_id": first("/proc/sys/kernel/random/boot_id"), "host": os.uname().nodename}
