"""python -m chunkvault COMMAND ...: snapshots of files through a spool to the targets of a configuration (--config JSON or @file, or CHUNKVAULT_CONFIG).

sync FILES [--optimize]      snapshot files under a path and upload them
flush                        upload what is spooled
restore HOST PATH OUT        a file from its newest snapshot, - for standard output
manifest URI [OUT]           a manifest in its wire form, by URI; without OUT what it says
manifest-name HOST PATH      the name of a file's manifest
shell HOST PATH SQL          SQL over a replica: views chunks (places with bytes) and manifest
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from chunkvault import api
from chunkvault.errors import ChunkvaultError
from chunkvault.functions.codecs import MAGIC
from chunkvault.functions.wire import decode_manifest
from chunkvault.session import local_session
from chunkvault.sources.files import Options, read_files, versioned

COMMANDS = {"sync": ["files"], "flush": [], "restore": ["host", "path", "out"], "manifest": ["uri"], "manifest-name": ["host", "path"], "shell": ["host", "path", "sql"]}
#: Bytes that a restore reads at a time.
STEP = 64 << 20


def restore(spark, host: str, path: str, out: str, options: Options) -> None:
    """Writes a file beside its place, then moves it there."""
    replica = api.replica(spark, host, path, options)
    pieces = (replica.read(at, STEP) for at in range(0, replica.size, STEP))
    if out == "-":
        for piece in pieces:
            sys.stdout.buffer.write(piece)
        return
    with open(f"{out}.new", "wb") as f:
        for piece in pieces:
            f.write(piece)
    os.replace(f"{out}.new", out)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chunkvault", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--config")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, words in COMMANDS.items():
        command = commands.add_parser(name)
        for word in words:
            command.add_argument(word)
        if name == "sync":
            command.add_argument("--optimize", action="store_true")
            command.add_argument("--host", default=os.uname().nodename)
        if name == "manifest":
            command.add_argument("out", nargs="?")
    given = parser.parse_args(args)
    options = api.configure((api.parse_configuration_string(given.config) if given.config else api.load_configuration_from_env()) or Options())
    spark = local_session()
    try:
        if given.command == "manifest-name":
            print(api.name_of(spark, given.host, given.path))
        elif given.command == "sync":
            made = api.sync(spark, versioned(read_files(spark, given.files, given.host)), options, given.optimize)
            for r in made.select("host", "path").orderBy("path").toLocalIterator():
                print(api.name_of(spark, r["host"], r["path"]))
        elif given.command == "flush":
            return 0 if api.flush(spark, options) else 1
        elif given.command == "restore":
            restore(spark, given.host, given.path, given.out, options)
        elif given.command == "manifest":
            blob = api.manifest_bytes_for_path(spark, given.uri, options)
            if blob is None:
                print("manifest not found", file=sys.stderr)
                return 1
            if given.out:
                with open(given.out, "wb") as f:
                    f.write(blob)
            else:
                import zstandard

                found = decode_manifest(zstandard.ZstdDecompressor().decompress(blob) if blob.startswith(MAGIC) else blob)
                print({k: v if k not in ("chunks", "bundled_chunks") else len(v) for k, v in found.items()})
        else:
            replica = api.replica(spark, given.host, given.path, options)
            replica.chunks().createOrReplaceTempView("chunks")
            replica.manifest().select([F.col(c) for c in replica.manifest().columns if c not in ("words", "fps", "bundled")]).createOrReplaceTempView("manifest")
            spark.sql(given.sql).show(truncate=False)
    except ChunkvaultError as e:
        print(f"{e} ({e.root})", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
