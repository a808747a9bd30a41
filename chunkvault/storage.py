"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark remove the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes that Spark hands to Python at a time while a table is written.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
_fallback: dict[str, str] = {}
_stored: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("stored", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Where it is unset a local master gets a temporary folder of its own, as in tests; on a cluster
    that is an error, since executors would not see the driver's folder."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not context.master.startswith(("local[", "local")) or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _fallback:
        _fallback[context.applicationId] = tempfile.mkdtemp(prefix="chunkvault-")
    return _fallback[context.applicationId]


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path that nothing has used; what is written there goes with the application, or before (see tidy)."""
    path = f"{shared_dir(spark)}/chunkvault/{tag}-{uuid.uuid4().hex}"
    if (held := _stored.get()) is not None:
        held.append(path)
    return path


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session, put back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextlib.contextmanager
def writing(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[None]:
    """What holds while a table is written, put back afterwards: shuffle files go when the query ends, and Python gets bounded batches."""
    with contextlib.ExitStack() as stack:
        for key, value in ((CLEANUP, "true"), ("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", str(size))):
            stack.enter_context(setting(spark, key, value))
        yield


def store(df: DataFrame, tag: str, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends, and lost executors cost nothing. The shuffle files that led to it go at
    once, as nothing reads them again."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    with writing(spark, rows, size):
        df.write.option("compression", "zstd").parquet(path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def store_each(frames: Iterable[DataFrame], like: DataFrame, tag: str) -> DataFrame:
    """Writes frames of like's schema one after the other to one table, and reads it back."""
    spark, path = like.sparkSession, fresh_path(like.sparkSession, tag)
    with writing(spark):
        like.limit(0).write.parquet(path)
        for df in frames:
            df.write.mode("append").option("compression", "zstd").parquet(path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(like.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing will read again."""
    for df in tables:
        if files := df.inputFiles():
            remove(df.sparkSession, files[0].rpartition("/")[0])


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that leaves no stored table behind but those that its result reads."""

    @functools.wraps(operator)
    def run(*args, **settings) -> DataFrame:
        outer, own = _stored.get(), []
        token = _stored.set(own)
        try:
            out = operator(*args, **settings)
        finally:
            _stored.reset(token)
        read = {f.rpartition("/")[0].rpartition("/")[2] for f in out.inputFiles()} if own else set()
        for path in own:
            if path.rpartition("/")[2] not in read:
                remove(out.sparkSession, path)
            elif outer is not None:
                outer.append(path)
        return out

    return run


def forget(spark: SparkSession) -> None:
    """Removes every table that store() has written under the shared folder."""
    remove(spark, f"{shared_dir(spark)}/chunkvault")
