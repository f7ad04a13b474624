"""Timeline, commit and session queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scoring import epoch
from ..operators import timeline
from ..operators.ordered import bucketed_previous, changes
from ..tables import latest, messages, role_of, table
from .search_queries import AS_OF, now

TOPIC = "watermark"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit messages: the documents of that kind."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "doc_kind", "project_path", "created_at")
    return docs.filter("doc_kind = 'commit' and text is not null").select(F.col("doc_id").alias("id"), F.col("created_at").alias("ts"), F.col("text").alias("message"), "project_path")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat sessions that count: of each id the snapshot that started last, with the most messages."""
    rows = table(spark, sf_dir, "chat_sessions")
    return latest(rows, ["id"], F.struct("started_at", "message_count", F.coalesce("ended_at", F.lit(AS_OF).cast("timestamp"))), tie=["title", "project_path", "indexed"])


def _timeline(spark, sf_dir):
    return timeline.events(commits(spark, sf_dir), sessions(spark, sf_dir).select("id", F.col("started_at").alias("ts"), "title"))


COMMITS = "commits AS (SELECT doc_id AS id, created_at AS ts, text AS message, project_path FROM documents WHERE doc_kind = 'commit' AND text IS NOT NULL)"
SESSIONS = f"""sessions AS (SELECT * FROM chat_sessions QUALIFY row_number() OVER (PARTITION BY id
  ORDER BY started_at DESC NULLS LAST, message_count DESC NULLS LAST, coalesce(ended_at, TIMESTAMP '{AS_OF}') DESC, title DESC NULLS LAST, project_path DESC NULLS LAST, indexed DESC) = 1)"""
EVENTS = f"""{COMMITS}, {SESSIONS}, events_ AS (
  SELECT CAST(id AS VARCHAR) AS event_id, ts, 'GitChange' AS event_type, message AS content FROM commits WHERE ts IS NOT NULL
  UNION ALL SELECT id, started_at, 'Discussion', coalesce(title, 'Session ' || id) FROM sessions WHERE id IS NOT NULL AND started_at IS NOT NULL)"""
_LINE = r"regexp_extract({c}, '^([^\r\n]*)', 1)"
_TYPES = "feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert"


def _topic_sql(c: str) -> str:
    line = _LINE.format(c=c)
    before = f"regexp_extract({line}, '^([^:]*):', 1)"
    return f"""CASE WHEN contains({line}, ':') THEN coalesce(nullif(regexp_extract({before}, '\\(([^)]*)\\)', 1), ''), nullif(trim({before}), ''), 'general')
      ELSE coalesce(nullif(regexp_extract({line}, '^\\s*(\\S+)', 1), ''), 'general') END"""


def timeline_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.on_topic(_timeline(spark, sf_dir), TOPIC)


def timeline_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.by_topic(_timeline(spark, sf_dir))


def timeline_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.by_period(_timeline(spark, sf_dir), now(), 30)


def timeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _timeline(spark, sf_dir)
    span = F.floor((epoch(F.max("ts")) - epoch(F.min("ts"))) / 86400)
    return t.agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if(F.col("event_type") == "GitChange").alias("git_changes"),
        F.count_if(F.col("event_type") == "Discussion").alias("discussions"), F.when(F.count(F.lit(1)) > 1, span).alias("time_span_days"),
    )


def timeline_recent_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = F.col("ts") > now() - F.expr("INTERVAL 90 DAYS")
    return _timeline(spark, sf_dir).groupBy("event_type", F.when(recent, "current").otherwise("historical").alias("part")).agg(F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last_ts"))


def conventional_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("message")
    return commits(spark, sf_dir).select("id", text.commit_type(m).alias("conv_type"), text.commit_scope(m).alias("conv_scope"), text.is_breaking(m).alias("is_breaking"), text.first_line(m).alias("summary"))


def breaking_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("message")
    return commits(spark, sf_dir).filter(text.is_breaking(m)).select("id", text.breaking_text(m).alias("breaking"))


def deprecating_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each path named in commits, the first commit that moves or drops something there."""
    rows = commits(spark, sf_dir).filter(F.lower("message").rlike("move|drop|remove|deprecate"))
    paths = rows.select("id", "ts", F.explode(F.array_distinct(F.regexp_extract_all("message", F.lit(r"((?:[a-z]+/)+[a-z_]+\.[a-z]+)"), F.lit(1)))).alias("path"))
    return paths.groupBy("path").agg(F.min_by("id", F.struct("ts", "id")).alias("first_commit"), F.count(F.lit(1)).alias("n_commits"))


def session_last_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest commit of a session's project before the session."""
    talk = sessions(spark, sf_dir).select(F.col("id").alias("session_id"), "project_path", F.col("started_at").alias("ts"))
    git = commits(spark, sf_dir).select("project_path", "ts", F.col("id").alias("commit_id"))
    return timeline.as_of(talk, git, "project_path", "ts", "commit_id").select("session_id", "project_path", "commit_id")


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per session by role, beside the count that the session row claims."""
    m = messages(spark, sf_dir, "session_id", "role").select("session_id", role_of(F.col("role")).alias("r"))
    counted = m.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"), *[F.count_if(F.col("r") == r).alias(f"n_{r}") for r in ("user", "assistant", "system")])
    s = sessions(spark, sf_dir).select(F.col("id").alias("session_id"), "message_count")
    return s.join(counted, "session_id", "left").select("session_id", "message_count", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), *[F.coalesce(f"n_{r}", F.lit(0)).alias(f"n_{r}") for r in ("user", "assistant", "system")])


def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of each user: runs of events with no pause of an hour or more; a user is not one task."""
    e = table(spark, sf_dir, "events", "user_id", "event_id", "ts")
    seen = bucketed_previous(e, "user_id", ["ts", "event_id"], ["ts"], F.date_trunc("day", "ts"))
    # visits begin where the pause before is long enough; they are numbered by the days before and within the day
    first = seen.withColumn("new", F.when(F.col("prev_ts").isNull() | (F.col("ts") >= F.col("prev_ts") + F.expr("INTERVAL 1 HOUR")), 1).otherwise(0)).withColumn("day", F.date_trunc("day", "ts"))
    # null-safe keys: user and day as one text
    first = first.withColumn("group", F.to_json(F.struct("user_id", "day")))
    inside = Window.partitionBy("group").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    days = first.groupBy("user_id", "day", "group").agg(F.sum("new").alias("begun"))
    before = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offset = days.select(F.col("group").alias("g"), F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("offset"))
    numbered = first.withColumn("n", F.sum("new").over(inside)).join(offset, F.col("group") == F.col("g"))
    return numbered.groupBy("user_id", (F.col("offset") + F.col("n")).alias("visit")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("n_events"))


def model_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of a session at which another model (or none) answers than before."""
    m = messages(spark, sf_dir, "session_id", "timestamp", "model").filter("session_id is not null and timestamp is not null")
    rows = m.select("session_id", "timestamp", "id", "model")
    return changes(rows, "session_id", ["timestamp", "id"], "model", F.date_trunc("hour", "timestamp"))


def longest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest messages of each project's sessions."""
    m = latest(table(spark, sf_dir, "messages").select("id", "session_id", "ingested_at", F.length("content").alias("n_chars")), ["id"], "ingested_at").filter("n_chars is not null")
    s = sessions(spark, sf_dir).select(F.col("id").alias("session_id"), "project_path")
    w = Window.partitionBy("project_path").orderBy(F.desc("n_chars"), "id")
    return m.join(s, "session_id").withColumn("place", F.row_number().over(w)).filter("place <= 3").select("project_path", "place", "id", "n_chars")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "ts", "event_type", "value")
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


QUERIES = {
    f.__name__: f
    for f in (timeline_build, timeline_topics, timeline_periods, timeline_stats, timeline_recent_split, conventional_commits, breaking_changes, deprecating_commits, session_last_commit, session_counts, session_gaps, model_changes, longest_messages, event_windows)
}

_M = "m AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1)"
_ROLE = "CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai') THEN 'assistant' WHEN lower(trim(role)) = 'system' THEN 'system' END"
_L = _LINE.format(c="message")
_BREAKING = rf"(contains({_L}, '!:') OR regexp_matches(message, '(?i)\n[^\n]*BREAKING[ -]CHANGE'))"
SQL = {
    "timeline_build": f"WITH {EVENTS} SELECT event_id, ts, event_type, content FROM events_ WHERE contains(lower(content), '{TOPIC}') OR lower({_topic_sql('content')}) = '{TOPIC}'",
    "timeline_topics": f"WITH {EVENTS} SELECT {_topic_sql('content')} AS topic, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM events_ GROUP BY 1",
    "timeline_periods": f"""WITH {EVENTS}, b AS (SELECT CAST(floor(greatest(floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 86400), 0) / 30) AS BIGINT) AS k FROM events_)
        SELECT CASE WHEN k = 0 THEN 'Last 30 days' ELSE (k * 30) || '-' || ((k + 1) * 30) || ' days ago' END AS period, count(*) AS n_events FROM b GROUP BY 1""",
    "timeline_stats": f"""WITH {EVENTS} SELECT count(*) AS total_events, count(*) FILTER (event_type = 'GitChange') AS git_changes, count(*) FILTER (event_type = 'Discussion') AS discussions,
        CASE WHEN count(*) > 1 THEN CAST(floor((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 86400) AS BIGINT) END AS time_span_days FROM events_""",
    "timeline_recent_split": f"WITH {EVENTS} SELECT event_type, CASE WHEN ts > TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY THEN 'current' ELSE 'historical' END AS part, count(*) AS n_events, max(ts) AS last_ts FROM events_ GROUP BY ALL",
    "conventional_commits": rf"""WITH {COMMITS} SELECT id, nullif(regexp_extract({_L}, '^({_TYPES})(?:\(|!?:)', 1), '') AS conv_type, nullif(regexp_extract({_L}, '^(?:{_TYPES})\(([^)]*)\)', 1), '') AS conv_scope,
        {_BREAKING} AS is_breaking, {_L} AS summary FROM commits""",
    "breaking_changes": rf"""WITH {COMMITS} SELECT id, coalesce(nullif(trim(regexp_extract({_L}, '!:(.*)$', 1)), ''), nullif(regexp_extract(message, '(?i)\nBREAKING[ -]CHANGE: *([^\r\n]*)', 1), '')) AS breaking FROM commits WHERE {_BREAKING}""",
    "deprecating_commits": rf"""WITH {COMMITS}, p AS (SELECT id, ts, unnest(list_distinct(regexp_extract_all(message, '((?:[a-z]+/)+[a-z_]+\.[a-z]+)', 1))) AS path FROM commits WHERE regexp_matches(lower(message), 'move|drop|remove|deprecate'))
        SELECT path, arg_min(id, row(ts, id)) AS first_commit, count(*) AS n_commits FROM p GROUP BY path""",
    "session_last_commit": f"""WITH {COMMITS}, {SESSIONS}, c AS (SELECT project_path, ts, max(id) AS commit_id FROM commits WHERE project_path IS NOT NULL GROUP BY ALL)
        SELECT s.id AS session_id, s.project_path, c.commit_id FROM sessions s ASOF LEFT JOIN c ON s.project_path = c.project_path AND s.started_at >= c.ts""",
    "session_counts": f"""WITH {_M}, {SESSIONS}, c AS (SELECT session_id, count(*) AS n, count(*) FILTER ({_ROLE} = 'user') AS u, count(*) FILTER ({_ROLE} = 'assistant') AS a, count(*) FILTER ({_ROLE} = 'system') AS s FROM m GROUP BY 1)
        SELECT id AS session_id, message_count, coalesce(n, 0) AS n_messages, coalesce(u, 0) AS n_user, coalesce(a, 0) AS n_assistant, coalesce(c.s, 0) AS n_system FROM sessions LEFT JOIN c ON session_id = id""",
    "model_changes": f"""WITH {_M}, p AS (SELECT session_id, timestamp, id, model, lag(model) OVER w AS prev_model, row_number() OVER w AS i FROM m
        WHERE session_id IS NOT NULL AND timestamp IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, id))
        SELECT session_id, timestamp, id, model, prev_model FROM p WHERE i > 1 AND model IS DISTINCT FROM prev_model""",
    "session_gaps": """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        v AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS visit FROM g) SELECT user_id, visit, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_events FROM v GROUP BY ALL""",
    "longest_messages": f"""WITH {_M}, {SESSIONS} SELECT project_path, CAST(row_number() OVER w AS INTEGER) AS place, m.id, CAST(length(content) AS INTEGER) AS n_chars FROM m JOIN sessions s ON s.id = m.session_id WHERE content IS NOT NULL
        WINDOW w AS (PARTITION BY project_path ORDER BY length(content) DESC, m.id) QUALIFY row_number() OVER w <= 3""",
    "event_windows": "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
}
