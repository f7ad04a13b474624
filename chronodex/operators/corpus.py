"""All kinds of items as one table, their chunks and vectors, and what a search result is enriched with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chunking, scoring, text, vectors

#: Columns of the corpus: one row per item. ``path`` is that of its file, ``title`` what a result shows.
COLUMNS = ("content_type", "item_id", "branch", "path", "title", "content", "ts", "is_current")


def _rows(df: DataFrame, content_type: str, item_id: Column, title: Column, content: Column, ts: Column, path: Column | None = None, branch: Column | None = None, current: Column | None = None) -> DataFrame:
    text_or_null = lambda c: F.lit(None).cast("string") if c is None else c
    return df.select(
        F.lit(content_type).alias("content_type"), item_id.cast("string").alias("item_id"), text_or_null(branch).alias("branch"), text_or_null(path).alias("path"),
        title.alias("title"), content.alias("content"), ts.cast("timestamp_ntz").alias("ts"), (F.lit(True) if current is None else F.coalesce(current, F.lit(True))).alias("is_current"),
    )


def corpus(files: DataFrame, file_texts: DataFrame, messages: DataFrame, sessions: DataFrame, symbols: DataFrame, commits: DataFrame, plans: DataFrame) -> DataFrame:
    """One row per item of all kinds; the inputs hold one row per item.

    A symbol has the path and state of its file; symbols and files without a known state are current.
    Items with a null id are left out.
    """
    kind = F.when(F.col("kind") == "Source", "Source: ").when(F.col("kind") == "Docs", "Documentation: ").otherwise("File: ")
    about = files.select(F.col("id").alias("file_id"), "file_path", F.col("modified_at").alias("changed_at"), "indexed")
    doc = F.nullif(text.first_line(F.col("doc_comment")), F.lit(""))
    parts = [
        _rows(files.join(file_texts.select(F.col("file_id").alias("id"), "content"), "id", "left"), "File", F.col("id"), F.concat(kind, "file_path"), F.col("content"), F.col("modified_at"), F.col("file_path"), current=F.col("indexed")),
        _rows(messages, "Message", F.col("id"), F.col("content"), F.col("content"), F.col("timestamp")),
        _rows(sessions, "Session", F.col("id"), F.coalesce("title", F.concat(F.lit("Session in "), "project_path")), F.col("title"), F.col("started_at")),
        _rows(symbols.join(about, "file_id", "left"), "Symbol", F.col("id"), F.coalesce(F.concat("name", F.lit(" - "), doc), F.concat("kind", F.lit(': "'), "name", F.lit('"'))), F.col("code"), F.col("changed_at"), F.col("file_path"), F.col("branch_name"), F.col("indexed")),
        _rows(commits, "Commit", F.col("id"), text.first_line(F.col("message")), F.col("message"), F.col("ts")),
        _rows(plans, "Plan", F.col("id"), F.coalesce("title", F.lit("")), F.col("content"), F.col("modified_at")),
    ]
    return reduce(DataFrame.unionByName, parts).filter("item_id is not null")


def chunked(items: DataFrame) -> DataFrame:
    """``content_type``, ``item_id``, ``branch``, ``chunk_no`` and ``chunk`` of each item, cut by the rule of its kind.

    Messages and sessions after sentences, files and plans by paragraphs, symbols shortened, commits
    whole, patches by file. Null and blank contents give no chunk.
    """
    c, kind = F.col("content"), F.col("content_type")
    blank = F.array().cast("array<string>")
    whole = F.filter(F.array(F.trim(c)), lambda x: x != "")
    cut = F.when(kind.isin("File", "Plan"), chunking.paragraphs(c)).when(kind == "Symbol", F.filter(F.array(chunking.symbol_text(c)), lambda x: x != "")).when(kind == "Commit", whole).when(kind == "GitDiff", chunking.diff_files(c))
    keys = ["content_type", "item_id", "branch"]
    talk = kind.isin("Message", "Session")
    spoken = items.filter(talk).select(*keys, F.posexplode(chunking.chunk_message("content")).alias("chunk_no", "chunk"))
    rest = items.filter(~talk).select(*keys, F.posexplode(F.coalesce(cut, blank)).alias("chunk_no", "chunk"))
    return rest.unionByName(spoken)


def chunk_vectors(chunks: DataFrame) -> DataFrame:
    """Adds ``chunk_key`` and ``embedding`` (word counts, not brought to length 1) to chunks; those without a word are left out."""
    key = F.concat_ws("|", "content_type", "item_id", F.coalesce("branch", F.lit("")), F.lpad(F.col("chunk_no").cast("string"), 6, "0"))
    return chunks.withColumn("chunk_key", key).withColumn("embedding", vectors.text_counts("chunk")).filter("embedding is not null")


def enrich(hits: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """Hits (``content_type``, ``item_id``, ``branch``, ``similarity``) with what is known of their items.

    A left join on the item's key: a hit whose item is gone stays, with nulls. Adds title, path, age,
    confidence, state, shortened content and final score.
    """
    about = items.select("content_type", "item_id", "branch", "path", "title", "ts", "is_current", text.truncate(F.col("content")).alias("content"))
    same = (hits["content_type"] == about["content_type"]) & (hits["item_id"] == about["item_id"]) & hits["branch"].eqNullSafe(about["branch"])
    out = hits.join(about, same, "left").select(hits["*"], *[about[c] for c in ("path", "title", "ts", "is_current", "content")])
    age = scoring.age_days(F.col("ts"), now)
    out = out.withColumn("age_days", age).withColumn("is_deprecated", ~F.col("is_current")).withColumn("confidence", scoring.confidence_level(F.col("content_type"), F.col("age_days"), F.col("is_current")))
    return out.withColumn("age_text", scoring.age_text_days(F.col("age_days"))).withColumn("final_score", scoring.final_score(F.col("similarity"), F.col("age_days"), scoring.base_weight(F.col("confidence"))))


def file_group(path: Column) -> Column:
    """``code`` or ``docs`` by a path's extension, else null."""
    ext = text.extension(path)
    return F.when(ext.isin(text.CODE_SEARCH), "code").when(ext.isin(text.DOC_SEARCH), "docs")
