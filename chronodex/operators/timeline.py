"""Timelines: commits and sessions as one list of events, and what can be counted from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scoring import epoch

COLUMNS = ("event_id", "ts", "event_type", "content")


def events(commits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Commits (id, ts, message) and sessions (id, ts, title) as events.

    A session without a title is told by its id. Events without a time are left out.
    """
    git = commits.select(F.col("id").cast("string").alias("event_id"), "ts", F.lit("GitChange").alias("event_type"), F.col("message").alias("content"))
    talk = sessions.select(F.col("id").alias("event_id"), "ts", F.lit("Discussion").alias("event_type"), text.session_description(F.col("title"), F.col("id")).alias("content"))
    return git.unionByName(talk).filter("ts is not null and content is not null")


def event_line(event_type: Column, description: Column, ago: Column) -> Column:
    """An event as a line of markdown."""
    mark = F.when(event_type == "GitChange", "📜 **Git Change**").when(event_type == "Discussion", "💬 **Discussion**").otherwise("⚙️ **Implementation**")
    return F.concat(mark, F.lit(" - "), description, F.lit(" ("), ago, F.lit(")"))


def on_topic(timeline: DataFrame, topic: str) -> DataFrame:
    return timeline.filter(text.matches_topic(F.col("content"), topic))


def by_topic(timeline: DataFrame) -> DataFrame:
    """Number of events and their first and last time, by topic."""
    return timeline.groupBy(text.topic(F.col("content")).alias("topic")).agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def by_period(timeline: DataFrame, now: Column, days: int) -> DataFrame:
    """Number of events by how many periods of ``days`` days ago they were; the future counts as now."""
    ago = F.greatest(F.floor((epoch(now) - epoch(F.col("ts"))) / 86400), F.lit(0))
    bucket = F.floor(ago / days)
    label = F.when(bucket == 0, f"Last {days} days").otherwise(F.concat((bucket * days).cast("string"), F.lit("-"), ((bucket + 1) * days).cast("string"), F.lit(" days ago")))
    return timeline.groupBy(label.alias("period")).agg(F.count(F.lit(1)).alias("n_events"))


def as_of(left: DataFrame, right: DataFrame, by: str, on: str, value: str) -> DataFrame:
    """Adds to each left row the ``value`` of the latest right row of its ``by`` at or before its ``on``.

    Both sides are put into one list per key and read in order, so it is one shuffle and no range join;
    the last value is carried from month to month in one row per key and month, so a key with many rows
    is not one task. Rows without an earlier right row, or with a null key or time, get null. Right rows
    with equal times: the greatest value counts.
    """
    columns = left.columns
    a = left.withColumn("_value", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_right", F.lit(False))
    b = right.filter(F.col(value).isNotNull()).select(F.col(by), F.col(on), F.col(value).alias("_value"), F.lit(True).alias("_right"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_month", F.date_trunc("month", on))
    order = [F.col(on), F.desc("_right"), F.col("_value")]
    inside = Window.partitionBy(by, "_month").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_found", F.last("_value", ignorenulls=True).over(inside))
    ends = b.withColumn("_month", F.date_trunc("month", on)).groupBy(by, "_month").agg(F.max_by("_value", F.struct(on, "_value")).alias("_end"))
    months = both.select(by, "_month").distinct().join(ends, [by, "_month"], "left")
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(by).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1))
    carried = months.select(F.col(by).alias("_k"), F.col("_month").alias("_m"), before.alias("_carried"))
    rows = both.filter("not _right")
    keep = F.when(F.col(by).isNotNull() & F.col(on).isNotNull(), F.coalesce("_found", "_carried"))
    return rows.join(carried, (F.col(by) == F.col("_k")) & (F.col("_month") == F.col("_m")), "left").withColumn(value, keep).select(*columns, value)
