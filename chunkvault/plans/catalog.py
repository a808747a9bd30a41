"""The registered queries: name -> (DataFrame query, equivalent SQL).

Fixture encodings: a document is a file (db_id = doc_id, host = lang, path from source and id, content = its bytes); the documents of one
source, in order, are versions of one database; an event is a write of user_id's database. Chunks have 4096 bytes here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

G = 4096
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".db"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("db_id"), F.col("lang").alias("host"), path.alias("path"), F.col("source").alias("chain"), text.alias("content"))


def write_log(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("db_id"), F.expr("event_id div 8").alias("txn"), e.alias("seq"), ((e * 7919) % (16 * G)).alias("offset"), (1 + (e * 104729) % (2 * G)).alias("count"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    )


# The same fixtures in the SQL that checks the queries.
FILES = "files as (select doc_id as db_id, lang as host, '/' || source || '/' || doc_id || '.db' as path, source as chain, encode(coalesce(text, '')) as content from documents)"
CHUNKS = f"""chunks as (select db_id, host, chain, i as chunk_index, i * {G} as begin, least({G}, octet_length(content) - i * {G})::bigint as size,
 unhex(substr(hex(content), i * {2 * G} + 1, {2 * G})) as data, md5(unhex(substr(hex(content), i * {2 * G} + 1, {2 * G}))) as fp
 from files, unnest(range(cast((octet_length(content) + {G - 1}) // {G} as bigint))) as t(i))"""
CHAIN = "chain_files as (select *, lag(db_id) over w as prev_id, lag(content) over w as prev_content from files window w as (partition by chain order by db_id))"
LOG = f"log as (select user_id as db_id, event_id // 8 as txn, event_id as seq, (event_id * 7919) % {16 * G} as \"offset\", 1 + (event_id * 104729) % {2 * G} as \"count\", epoch_us(ts) as at from events)"
SIGNED = "(case when ('0x' || substr({f}, {a}, 16))::ubigint >= 9223372036854775808 then (('0x' || substr({f}, {a}, 16))::ubigint::hugeint - 18446744073709551616)::bigint else ('0x' || substr({f}, {a}, 16))::ubigint::bigint end)"


def with_(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"with {'recursive ' * recursive}{', '.join(ctes)} {body}"


def queries() -> dict[str, Callable]:
    from chunkvault.plans import lifecycle, relational, replication, rules, states, upkeep  # noqa: F401  (they register themselves)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
