"""Streams with state of their own: bursts of changes, growing files, the life of sessions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text
from .activity import END
from .replay import replay

#: Lines of a file that share one state.
BLOCK = 1000
#: Event times of the watermark stay between its start and what pandas can hold; the results keep the times as they are.
_EARLIEST, _LATEST = dt.datetime(1970, 1, 2), dt.datetime(2200, 1, 1)


def debounced(stream: DataFrame, key: str, ts: str, last: list[str], gap: str = "500 milliseconds", lateness: str = "1 day") -> DataFrame:
    """One row per burst of changes of each key: nothing is reported before ``gap`` has passed without another.

    The columns ``last`` are those of the burst's last row by (``ts``, ``last``); ``n_changes`` counts its rows.
    Rows without key or time are left out. Built-in session windows, which combine before the shuffle.
    """
    row = F.struct(F.col(ts).alias("_at"), *last)
    return (
        stream.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .withWatermark(ts, lateness)
        .groupBy(key, F.session_window(ts, gap).alias("w"))
        .agg(F.max(row).alias("_last"), F.count(F.lit(1)).alias("n_changes"))
        .select(key, F.col("w.start").alias("first_change"), F.col("_last._at").alias("last_change"), *[F.col("_last")[c].alias(c) for c in last], "n_changes")
    )


def _tail(size: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        file_id, block = key
        (seen,) = state.get if state.exists else (0,)
        first: dict[int, tuple] = {}  # at most ``size`` entries, however many readings there are
        for pdf in batches:
            for read_at, lines in zip(pdf.read_at, pdf.lines):
                at = (pd.isna(read_at), 0 if pd.isna(read_at) else int(read_at))
                for i in range(seen, len(lines)):
                    if i not in first or (at, lines[i]) < first[i]:
                        first[i] = (at, lines[i])
        if first:
            state.update((max(first) + 1,))
        found = [(file_id, int(block) * size + i + 1, line, None if missing else at) for i, ((missing, at), line) in sorted(first.items()) if line.strip()]
        yield pd.DataFrame(found, columns=["file_id", "line_no", "line", "read_at"]).astype({"read_at": "Int64"})

    return step


def new_lines(stream: DataFrame, block: int = BLOCK) -> DataFrame:
    """Lines that a reading of a growing file (``file_id``, ``content``, ``read_at``) adds to the earlier ones.

    State holds how many lines of each block of ``block`` lines were seen, so neither a long file nor
    one that is read very often meets one task. Of several readings in one micro-batch the earliest
    (``read_at``, then the line) that has a line gives it; null times count as the latest. Blank lines are
    counted and not given. Null ids or contents give nothing; a file that shrinks gives nothing until it has grown beyond its old length.
    """
    lines = stream.filter("file_id is not null and content <> ''").select("file_id", F.unix_micros(F.col("read_at").cast("timestamp")).alias("read_at"), text.lines(F.col("content")).alias("_l"))
    starts = F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / block).cast("int"))
    blocks = lines.select("file_id", F.explode(F.transform(starts, lambda b: F.struct(b.alias("block"), F.slice("_l", b * block + 1, block).alias("lines")))).alias("b"), "read_at").select("file_id", "b.*", "read_at")
    found = blocks.groupBy("file_id", "block").applyInPandasWithState(_tail(block), "file_id string, line_no int, line string, read_at bigint", "seen int", "append", GroupStateTimeout.NoTimeout)
    return found.withColumn("read_at", F.timestamp_micros("read_at"))


def _life(timeout_ms: int):
    latest_ms = int(_LATEST.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, last, ended, n = state.get if state.exists else (None, None, None, 0)
        closed = state.hasTimedOut
        if not closed:
            for pdf in batches:
                at = pdf.us
                begins, ends = at[pdf.kind == "session_start"], at[pdf.kind == "session_end"]
                started = min([x for x in (started, None if begins.empty else int(begins.min())) if x is not None], default=None)
                ended = max([x for x in (ended, None if ends.empty else int(ends.max())) if x is not None], default=None)
                last, n = max(last or int(at.min()), int(at.max())), n + len(at)
            closed = ended is not None
        if not closed:
            state.update((started, last, ended, n))
            state.setTimeoutTimestamp(max(min(last // 1000, latest_ms) + timeout_ms, state.getCurrentWatermarkMs() + 1))
            return
        if state.exists:
            state.remove()
        out = pd.DataFrame([(key[0], started, ended, last, "timed_out" if ended is None else "ended", n)], columns=["session_id", "started_at", "ended_at", "last_seen", "state", "n_events"])
        yield out.astype({"started_at": "Int64", "ended_at": "Int64", "last_seen": "Int64"})

    return step


def lifecycle(events: DataFrame, timeout: dt.timedelta = dt.timedelta(seconds=60), lateness: str = "45 days") -> DataFrame:
    """The life of each session from its events (``session_id``, ``kind``, ``at``), given when it is over.

    ``kind`` is ``session_start``, ``session_end`` or anything else (a sign of activity). A session is over at its end
    event, or (``timed_out``, without ``ended_at``) once the watermark is ``timeout`` past its last event. All events of a micro-batch
    are looked at before; what comes after the end opens the session anew. Rows without session or time
    are left out; times before 1970-01-02 and after 2200 count as these for the timeout. State: four numbers per open session.
    """
    clipped = F.greatest(F.least("at", F.lit(_LATEST)), F.lit(_EARLIEST))
    known = events.filter("session_id is not null and at is not null").select("session_id", "kind", F.unix_micros("at").alias("us"), clipped.alias("at")).withWatermark("at", lateness)
    schema = "session_id string, started_at bigint, ended_at bigint, last_seen bigint, state string, n_events bigint"
    ms = int(timeout.total_seconds() * 1000)
    over = known.groupBy("session_id").applyInPandasWithState(_life(ms), schema, "started bigint, last bigint, ended bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return over.select("session_id", *[F.timestamp_micros(c).alias(c) for c in ("started_at", "ended_at", "last_seen")], "state", "n_events")


def session_events(sessions: DataFrame) -> DataFrame:
    """Start and end events of stored sessions; what is null gives none."""
    both = F.array(F.struct(F.lit("session_start").alias("kind"), F.col("started_at").alias("at")), F.struct(F.lit("session_end").alias("kind"), F.col("ended_at").alias("at")))
    return sessions.select(F.col("id").alias("session_id"), F.explode(both).alias("e")).select("session_id", "e.*")


def _fields(*names: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in names])


def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each user's events with pauses of less than an hour, with the last event of each."""
    schema = _fields(("user_id", T.LongType()), ("ts", T.TimestampType()), ("event_id", T.LongType()), ("event_type", T.StringType()))
    end = {"user_id": -1, "ts": END, "event_id": -1}
    return replay(spark, f"{sf_dir}/events.parquet", schema, lambda s: debounced(s, "user_id", "ts", ["event_id", "event_type"], "1 hour"), end, "debounce").filter("user_id <> -1")


def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all files as their readings bring them."""
    schema = _fields(("file_id", T.StringType()), ("content", T.StringType()), ("read_at", T.TimestampType()))
    return replay(spark, f"{sf_dir}/file_texts.parquet", schema, new_lines, {"read_at": END}, "tail")


def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each session began and ended, or was given up, by the snapshots of all sessions."""
    schema = _fields(("id", T.StringType()), ("started_at", T.TimestampType()), ("ended_at", T.TimestampType()))
    return replay(spark, f"{sf_dir}/chat_sessions.parquet", schema, lambda s: lifecycle(session_events(s)), {"id": "", "started_at": END}, "lifecycle").filter("session_id <> ''")


QUERIES = {f.__name__: f for f in (stream_debounce, stream_tail, stream_lifecycle)}
SQL = {
    "stream_debounce": """WITH r AS (SELECT user_id, ts, event_id, event_type FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        v AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
        o AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC, event_type DESC) AS i FROM v)
        SELECT user_id, min(ts) AS first_change, max(ts) AS last_change, max(event_id) FILTER (i = 1) AS event_id, max(event_type) FILTER (i = 1) AS event_type, count(*) AS n_changes FROM o GROUP BY user_id, k""",
    "stream_tail": """WITH t AS (SELECT file_id, read_at, string_split(regexp_replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10)) AS l FROM file_texts WHERE content <> '' AND file_id IS NOT NULL),
        x AS (SELECT file_id, read_at, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line_no, unnest(l) AS line FROM t)
        SELECT * FROM (SELECT file_id, line_no, line, read_at FROM x QUALIFY row_number() OVER (PARTITION BY file_id, line_no ORDER BY read_at, line) = 1) WHERE regexp_matches(line, '\\S')""",
    "stream_lifecycle": """SELECT id AS session_id, min(started_at) AS started_at, max(ended_at) AS ended_at, max(greatest(started_at, ended_at)) AS last_seen,
        CASE WHEN count(ended_at) > 0 THEN 'ended' ELSE 'timed_out' END AS state, count(started_at) + count(ended_at) AS n_events FROM chat_sessions
        WHERE id IS NOT NULL AND id <> '' GROUP BY id HAVING count(started_at) + count(ended_at) > 0""",
}
