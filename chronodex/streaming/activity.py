"""Streaming operators: activity windows of sessions, deduplicated intake, incremental upserts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .replay import replay

END = dt.datetime(3000, 1, 1)
ACTIVITY = T.StructType([T.StructField("id", T.StringType()), T.StructField("session_id", T.StringType()), T.StructField("timestamp", T.TimestampType())])


def activity_windows(stream: DataFrame, gap: str = "30 minutes", lateness: str = "45 days") -> DataFrame:
    """Runs of activity of each session: a pause of ``gap`` or more ends one.

    Emitted once the watermark shows that nothing can be added any more. Rows without session or
    timestamp are left out; every stored version of a message counts as activity.
    """
    return (
        stream.filter("session_id is not null and timestamp is not null")
        .withWatermark("timestamp", lateness)
        .groupBy("session_id", F.session_window("timestamp", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select("session_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("timed_out_at"), "n_rows")
    )


def deduplicated(stream: DataFrame, key: str = "id", ts: str = "timestamp", lateness: str = "45 days") -> DataFrame:
    """The first row of each key; a repetition within the watermark's delay is dropped."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def event_counts(stream: DataFrame, width: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    """Tumbling windows of events by type, emitted when the watermark closes them."""
    return (
        stream.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )


def upsert_into(path: str, keys: list[str], version: str, parts: int = 64):
    """A ``foreachBatch`` function that keeps the latest row of each key under ``path``.

    Rows lie in ``parts`` parts by a hash of their key. A batch is merged with the parts that it touches, and
    only these are written, into the folder ``path/v=N``; of each part the greatest N counts. So no batch
    reads what it overwrites, and a repeated batch gives the same rows. Of each part the version before the
    latest stays for readers that still use it; older ones are deleted. ``parts`` must not change later.
    """
    from ..operators.incremental import upsert

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
        touched = {r[0] for r in batch.select(part).distinct().collect()}  # at most ``parts`` numbers
        found = _versions(spark, path)
        stored = _read(spark, path, {p: [v for v in found[p] if v < number] for p in found if p in touched})
        merged = upsert(batch.limit(0) if stored is None else stored, batch, keys, version)
        merged.withColumn("_part", part).write.partitionBy("_part").mode("overwrite").parquet(f"{path}/v={number}")
        for p in touched & set(found):
            for v in sorted(v for v in found[p] if v < number)[:-1]:
                _hadoop(spark, path)[0].delete(_hadoop(spark, f"{path}/v={v}/_part={p}")[1], True)

    return write


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The versions that are stored of each part."""
    fs, pattern = _hadoop(spark, f"{path}/v=*/_part=*")
    found: dict[int, list[int]] = {}
    for s in fs.globStatus(pattern) or []:
        found.setdefault(int(s.getPath().getName()[6:]), []).append(int(s.getPath().getParent().getName()[2:]))
    return found


def _read(spark: SparkSession, path: str, versions: dict[int, list[int]]) -> DataFrame | None:
    folders = [f"{path}/v={max(v)}/_part={p}" for p, v in sorted(versions.items()) if v]
    return spark.read.parquet(*folders) if folders else None


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest rows that :func:`upsert_into` wrote under ``path``, or None."""
    return _read(spark, path, _versions(spark, path))


def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replay(spark, f"{sf_dir}/messages.parquet", ACTIVITY, activity_windows, {"session_id": "", "timestamp": END}, "activity")
    return out.filter("started_at < timestamp '2900-01-01'")


INTAKE = T.StructType([T.StructField("id", T.StringType()), T.StructField("ingested_at", T.TimestampType())])


def stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all messages, each once, however often it was stored."""
    build = lambda s: deduplicated(s.filter("id is not null and ingested_at is not null"), "id", "ingested_at").select("id")
    return replay(spark, f"{sf_dir}/messages.parquet", INTAKE, build, {"id": "", "ingested_at": END}, "intake").filter("id <> ''")


EVENTS = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(spark, f"{sf_dir}/events.parquet", EVENTS, event_counts, {"ts": END, "event_type": "end"}, "events").filter("event_type <> 'end'")


QUERIES = {"stream_activity": stream_activity, "stream_intake": stream_intake, "stream_event_windows": stream_event_windows}
SQL = {
    "stream_activity": """WITH r AS (SELECT session_id, timestamp AS ts FROM messages WHERE session_id IS NOT NULL AND timestamp IS NOT NULL),
        g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
        v AS (SELECT session_id, ts, sum(new) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT session_id, min(ts) AS started_at, max(ts) + INTERVAL 30 MINUTE AS timed_out_at, count(*) AS n_rows FROM v GROUP BY session_id, k""",
    "stream_intake": "SELECT DISTINCT id FROM messages WHERE id IS NOT NULL AND id <> '' AND ingested_at IS NOT NULL",
    "stream_event_windows": "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
}
