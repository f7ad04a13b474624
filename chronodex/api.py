"""One object for a data folder: search, timeline, status, and the functions for SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .functions import scoring, sql
from .operators import search, timeline
from .plans import file_queries, registry, search_queries, timeline_queries
from .sources.timerange import time_range

TYPES = {"source": "File", "docs": "File", "file": "File", "session": "Session", "message": "Message", "commit": "Commit", "symbol": "Symbol", "diff": "GitDiff", "plan": "Plan", "all": None}
TABLES = ["messages", "chat_sessions", "plans", "files", "file_texts", "file_chunks", "symbols", "embedding_data", "cache_entries", "documents", "events"]
MAX_RESULTS, MAX_QUERY_BYTES = 1000, 1000


class Engine:
    """Queries over the tables in ``sf_dir``; ``as_of`` is the time that counts as now."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: dt.datetime | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.as_of = as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)

    def search(self, vector: list[float], content_type: str = "all", top_k: int = 5, after: str | None = None, before: str | None = None, max_age: str | None = None, ranked: bool = True) -> DataFrame:
        """The best items for a query vector; filters come before the ranking."""
        kind = content_type.lower()
        if kind not in TYPES:
            raise ValueError(f"unknown type {content_type!r}")
        if not 1 <= top_k <= MAX_RESULTS:
            raise ValueError(f"top_k must be from 1 to {MAX_RESULTS}")
        start, end = time_range(self.as_of, after, before, max_age)
        items = search_queries.items(self.spark, self.sf_dir)
        if TYPES[kind]:
            items = items.filter(F.col("content_type") == TYPES[kind])
        items = items.filter(scoring.in_range(F.col("cached_at"), F.col("content_type"), F.lit(start) if start else None, F.lit(end) if end else None))
        query = self.spark.createDataFrame([([float(x) for x in vector],)], "query array<double>")
        if not ranked:
            return search.nearest(items, query, top_k)
        scored = search.rerank(search.with_distance(items, query), F.lit(self.as_of), "cached_at")
        return scored.orderBy(F.desc("final_score"), "vec_id").limit(top_k)

    def timeline(self, topic: str | None = None, top_k: int = 50) -> DataFrame:
        """Commits and sessions, the latest first."""
        events = timeline.events(timeline_queries.commits(self.spark, self.sf_dir), timeline_queries.sessions(self.spark, self.sf_dir).select("id", F.col("started_at").alias("ts"), "title"))
        if topic:
            if len(topic.encode()) > MAX_QUERY_BYTES:
                raise ValueError("the topic is too long")
            events = timeline.on_topic(events, topic)
        return events.orderBy(F.desc("ts"), "event_id").limit(top_k)

    def status(self) -> DataFrame:
        return file_queries.status_summary(self.spark, self.sf_dir)

    def register(self) -> list[str]:
        """Makes the functions known to SQL, and the tables as views; gives the names of all.

        Besides every table of the folder there are ``current_messages``, ``current_plans`` and ``current_files``, which hold
        the rows that count.
        """
        names = sql.register(self.spark)
        views = {f"current_{f.__name__}": f(self.spark, self.sf_dir) for f in (tables.messages, tables.plans, tables.files)}
        views |= {name: tables.table(self.spark, self.sf_dir, name) for name in TABLES}
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return [*names, *views]

    def view(self, query: str) -> None:
        """Makes the result of a registered query a view of its name."""
        registry.queries()[query](self.spark, self.sf_dir).createOrReplaceTempView(query)


def render(results: DataFrame, form: str = "markdown") -> str:
    """At most ``MAX_RESULTS`` results as markdown, json or text."""
    if form == "json":
        return "[" + ",\n ".join(r.j for r in results.limit(MAX_RESULTS).select(F.to_json(F.struct(*[c for c, t in results.dtypes if not t.startswith("array")])).alias("j")).collect()) + "]"
    rows = results.limit(MAX_RESULTS).collect()
    if form == "text":
        return "\n".join(f"{i}. {r.content_type} {r.vec_id} (similarity: {r.similarity:.4f})" for i, r in enumerate(rows, 1))
    if form != "markdown":
        raise ValueError(f"unknown format {form!r}")
    return "\n\n".join(f"### {i}. {r.content_type} {r.vec_id}\n\n**Score:** {r.final_score:.2f} | **Similarity:** {r.similarity:.2f} | **Age:** {r.age_days} days | **Confidence:** {r.confidence}" for i, r in enumerate(rows, 1))
