"""Problem 3: rebuilding conversations from message rows.

Messages arrive as a stream. Keyed streaming state (one group per session and time bucket) buffers
them until the event-time watermark closes the bucket, so late rows still reach their place; closed
buckets leave the stream as segments. Segments are then checked and joined into conversations:
every bucket is ordered and checked by itself, and only one summary row per bucket is looked at per
session, so a session that holds a third of all rows is spread over as many groups as it has buckets.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from ..streaming.replay import replay
from ..tables import latest, role_of

#: Width of the time buckets, in seconds.
BUCKET = 3600
#: How long after its timestamp a message may still arrive on a live stream.
LATENESS = "45 days"
#: Event time of the row that tells a replayed stream that nothing more will come.
END_OF_INPUT = dt.datetime(3000, 1, 1)

MESSAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "session_id", "role", "content")] + [T.StructField("timestamp", T.TimestampType()), T.StructField("ingested_at", T.TimestampType())])


def has_text(content: Column) -> Column:
    """Whether there is a letter or a digit in it; false for null."""
    return F.coalesce(content.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def is_late(lateness: str) -> Column:
    """Whether a row was stored so long after its time that the stream's watermark may have passed it."""
    return F.coalesce(F.col("ingested_at") > F.col("timestamp") + F.expr(f"INTERVAL {lateness}"), F.lit(False))


def _checked(rows: DataFrame) -> DataFrame:
    """What the checks need of each row, without its text, and the time that it is placed by."""
    when = F.coalesce("timestamp", "ingested_at", F.lit(dt.datetime(1970, 1, 1)))
    return rows.select("session_id", "id", "timestamp", "ingested_at", role_of(F.col("role")).alias("role"), has_text(F.col("content")).alias("has_text"), when.alias("event_time"))


def _segments(rows: DataFrame, bucket: int) -> DataFrame:
    each = rows.groupBy("session_id", F.window("event_time", f"{bucket} seconds"))
    return each.agg(F.collect_list(F.struct("id", "timestamp", "ingested_at", "role", "has_text")).alias("rows")).select("session_id", "rows")


def buffered_segments(stream: DataFrame, bucket: int = BUCKET, lateness: str = LATENESS) -> DataFrame:
    """Streaming: the rows of each (session, time bucket), emitted when the watermark closes it.

    Event time is the message's ``timestamp``, or ``ingested_at`` where that is null (the row still
    has to reach its session, which it breaks). Only what the checks need is kept in state, not the
    text. Rows without either time cannot be placed on a time axis and go to the first bucket of
    1970. Late rows (:func:`is_late`) are no part of the stream: what it emits does not depend on how far
    the watermark has come, and :func:`late_segments` reports them. State: one group per session and bucket.
    """
    return _segments(_checked(stream.filter(~is_late(lateness))).withWatermark("event_time", lateness), bucket)


def late_segments(rows: DataFrame, bucket: int = BUCKET, lateness: str = LATENESS) -> DataFrame:
    """The rows that came too late for the stream, in the form of its segments, so that none is lost."""
    return _segments(_checked(rows.filter(is_late(lateness))), bucket)


def stored_segments(spark: SparkSession, path: str, bucket: int = BUCKET, lateness: str = LATENESS) -> DataFrame:
    """Segments of a stored message table, run through the stream until it is used up, and those of late rows."""
    end = {"timestamp": END_OF_INPUT, "ingested_at": END_OF_INPUT}
    on_time = replay(spark, path, MESSAGE, lambda stream: buffered_segments(stream, bucket, lateness), end, "conversations")
    stored = spark.read.parquet(path).select([F.col(f.name).cast(f.dataType) for f in MESSAGE])
    return on_time.unionByName(late_segments(stored, bucket, lateness))


def conversations(segments: DataFrame, sessions: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``session_id``, ``turn``, ``id`` of each kept conversation, from segments and known session ids.

    Kept is a conversation whose session is in ``sessions`` (column ``id``; repeated rows do not
    matter), whose rows all have a timestamp and one of the three roles, and which, system rows left
    aside, starts with a user row, alternates, ends with an assistant row and has a letter or digit
    in each content. Of an id stored several times the row with the latest ``ingested_at`` counts,
    also if its versions came in different segments. Turns count from 1 in order of (timestamp, id);
    system rows get none, and a session of system rows alone gives nothing. Null session ids never
    match. Empty inputs give an empty result.
    """
    rows = latest(segments.select("session_id", F.explode("rows").alias("r")).select("session_id", "r.*"), ["id"], "ingested_at")
    # a row's time bucket; null timestamps form a bucket of their own, which breaks the session anyway
    rows = rows.withColumn("bucket", F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / bucket))
    spoken = F.col("role") != "system"
    turn = F.struct("timestamp", "id", F.col("role").alias("role"))
    parts = rows.groupBy("session_id", "bucket").agg(
        F.array_sort(F.collect_list(F.when(F.coalesce(spoken, F.lit(True)), turn))).alias("turns"),
        F.bool_and(F.col("timestamp").isNotNull() & F.col("role").isNotNull() & (~F.coalesce(spoken, F.lit(True)) | F.col("has_text"))).alias("fine"),
    )
    alternates = F.forall(F.sequence(F.lit(1), F.greatest(F.size("turns") - 1, F.lit(1))), lambda i: F.coalesce(F.get("turns", i)["role"] != F.get("turns", i - 1)["role"], F.lit(True)))
    parts = materialize(
        parts.select(
            "session_id", "bucket", F.transform("turns", lambda t: t["id"]).alias("ids"), F.size("turns").alias("n"),
            (F.col("fine") & alternates).alias("fine"),
            F.get("turns", F.lit(0))["role"].alias("first"), F.element_at(F.expr("if(size(turns) = 0, array(null), turns)"), -1)["role"].alias("last"),
        ),
        "conversation-parts",
    )
    # one small row per bucket from here on; buckets without a spoken row only carry their flag
    order = Window.partitionBy("session_id").orderBy("bucket")
    before = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fits = F.when(F.col("n") == 0, True).otherwise(F.coalesce(before, F.lit("assistant")) != F.col("first"))
    marks = parts.select("session_id", "bucket", "n", "last", (F.col("fine") & fits).alias("fine"), F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    good = (
        marks.groupBy("session_id")
        .agg(F.bool_and("fine").alias("fine"), F.max_by("last", F.when(F.col("n") > 0, F.col("bucket"))).alias("end"))
        .filter(F.col("fine") & (F.col("end") == "assistant"))
        .join(sessions.select(F.col("id").alias("session_id")).filter("session_id is not null").distinct(), "session_id", "left_semi")
        .select("session_id")
    )
    kept = marks.filter("n > 0").select("session_id", "bucket", "offset").join(good, "session_id", "left_semi")
    return parts.join(kept, ["session_id", "bucket"]).select("session_id", "offset", F.posexplode("ids").alias("i", "id")).select("session_id", (F.col("offset") + F.col("i") + 1).cast("int").alias("turn"), "id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and assistant message of a kept conversation."""
    segments = stored_segments(spark, f"{sf_dir}/messages.parquet")
    return conversations(segments, spark.read.parquet(f"{sf_dir}/chat_sessions.parquet").select("id"))


P3_SQL = """
WITH m AS (
  SELECT id, session_id, timestamp,
    CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai') THEN 'assistant'
         WHEN lower(trim(role)) = 'system' THEN 'system' END AS r,
    coalesce(regexp_matches(content, '[\\p{L}\\p{N}]'), false) AS has_text
  FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1
), spoken AS (
  SELECT *, row_number() OVER w AS turn, lag(r) OVER w AS before FROM m WHERE r IS DISTINCT FROM 'system'
  WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, id)
), good AS (
  SELECT session_id FROM spoken GROUP BY session_id
  HAVING bool_and(timestamp IS NOT NULL AND r IS NOT NULL AND has_text AND r <> coalesce(before, 'assistant')) AND arg_max(r, turn) = 'assistant'
)
SELECT session_id, CAST(turn AS INTEGER) AS turn, id FROM spoken
WHERE session_id IN (SELECT session_id FROM good) AND session_id IN (SELECT id FROM chat_sessions)
  AND session_id NOT IN (SELECT session_id FROM m WHERE timestamp IS NULL AND session_id IS NOT NULL)
"""
