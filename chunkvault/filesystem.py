"""The few operations on Hadoop file systems that a commit protocol needs; renames of folders are atomic there."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A path on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._at = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def __truediv__(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    def exists(self) -> bool:
        return self._fs.exists(self._at)

    def names(self) -> list[str]:
        """Names of what is in the folder, sorted; none where it doesn't exist."""
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at)) if self.exists() else []

    def empty_or_absent(self) -> bool:
        return not self.names()

    def make(self) -> None:
        self._fs.mkdirs(self._at)

    def delete(self) -> bool:
        return self._fs.delete(self._at, True)

    def rename(self, to: Folder) -> bool:
        """Moves the folder to a path that doesn't exist; False where it does, or where this one is gone."""
        if to.exists() or not self.exists():
            return False
        self._fs.mkdirs(to._at.getParent())
        return self._fs.rename(self._at, to._at)

    def modified_ms(self) -> int:
        return self._fs.getFileStatus(self._at).getModificationTime()

    def read_text(self) -> str | None:
        return bytes(self.read_bytes()).decode() if self.exists() else None

    def read_bytes(self) -> bytes:
        stream = self._fs.open(self._at)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_bytes(self, data: bytes) -> None:
        """Writes a file in place of any before it, by renaming a finished one."""
        scratch = Folder(self.spark, f"{self.path}.{uuid.uuid4().hex}.new")
        stream = self._fs.create(scratch._at, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        self._fs.delete(self._at, False)
        self._fs.rename(scratch._at, self._at)

    def create(self) -> bool:
        """Creates an empty file; False if there is one."""
        if self.exists():
            return False
        try:
            self._fs.create(self._at, False).close()
        except Exception as e:  # another process was faster
            if "AlreadyExists" in str(e):
                return False
            raise
        return True


class Lock:
    """A lock file: tried, waited for, and broken once it is older than a lease, as its holder is then taken for dead."""

    def __init__(self, folder: Folder, lease_s: float = 60.0):
        self.file, self.lease_s, self.held = folder / ".lock", lease_s, False

    def take(self, wait_s: float = 2.0, step_s: float = 0.1) -> bool:
        """Whether the lock is held; callers may go on without it where it only saves work."""
        until = time.monotonic() + wait_s
        while not self.file.create():
            if self.file.exists() and time.time() - self.file.modified_ms() / 1000 > self.lease_s:
                self.file.delete()
            elif time.monotonic() > until:
                return False
            else:
                time.sleep(step_s)
        self.held = True
        return True

    def __enter__(self) -> Lock:
        self.take()
        return self

    def __exit__(self, *_: object) -> None:
        if self.held:
            self.file.delete()
            self.held = False


def delete_scratch(folder: Folder, now_ms: int | None = None, max_age_s: float = 10.0) -> list[str]:
    """Removes scratch files that no one has touched for max_age_s; returns their names."""
    now, gone = now_ms if now_ms is not None else int(time.time() * 1000), []
    for name in folder.names():
        if now - (folder / name).modified_ms() >= max_age_s * 1000:
            (folder / name).delete()
            gone.append(name)
    return gone
