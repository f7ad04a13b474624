"""Reading chat logs (JSON lines of messages, an index of sessions, folders of projects) and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

LINE = "type string, uuid string, sessionId string, timestamp string, message struct<role: string, content: string, tokens: bigint, model: string>"
INDEX = "array<struct<sessionId: string, summary: string, projectPath: string, created: string>>"


def parse_messages(lines: DataFrame, as_of: Column) -> DataFrame:
    """Messages of raw lines (column ``value``): those of user and assistant with ids and text.

    A line that is no JSON, has another type, no id, no session or no text as a string is left out. A
    message whose time cannot be read gets ``as_of``.
    """
    j = F.from_json("value", LINE)
    row = lines.select(j.alias("j")).select("j.type", "j.uuid", "j.sessionId", "j.timestamp", "j.message.*")
    good = row.filter("type in ('user', 'assistant') and role in ('user', 'assistant') and uuid <> '' and sessionId <> '' and content <> ''")
    when = F.coalesce(F.try_to_timestamp("timestamp"), as_of)
    return good.select(F.col("uuid").alias("id"), F.col("sessionId").alias("session_id"), "role", "content", when.alias("timestamp"), "tokens", "model")


def read_messages(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Messages of all ``*.jsonl`` files below ``path``."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).text(path)
    return parse_messages(lines, as_of)


def stream_messages(spark: SparkSession, path: str, as_of: Column, files_at_once: int = 100) -> DataFrame:
    """The same as a stream; new files are read as they appear."""
    lines = spark.readStream.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once).text(path)
    return parse_messages(lines, as_of)


def read_projects(spark: SparkSession, root: str) -> DataFrame:
    """``session_id``, ``project_path`` and ``path`` of each chat log ``projects/<project>/<session>.jsonl`` below ``root``.

    The folder's name is the project's path with its separators written as dashes, as in
    :func:`chronodex.functions.text.decode_project_path`. Only names are read. Logs at other depths are left out.
    """
    logs = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/projects/*/*.jsonl")
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return logs.select(F.regexp_replace(name, r"\.jsonl$", "").alias("session_id"), text.decode_project_path(F.element_at(parts, -2)).alias("project_path"), "path")


def read_plans(spark: SparkSession, folder: str) -> DataFrame:
    """One row per markdown file directly in ``folder``, with the columns of the plans table.

    The id is the file's name without ending, the title that of its first heading, else the id. Folders
    below are not read, and Spark gives no row for an empty file.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    id_ = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    content = F.col("content").cast("string")
    return raw.select(id_.alias("id"), F.coalesce(text.markdown_title(content), id_).alias("title"), content.alias("content"), F.col("modificationTime").alias("modified_at"))


def read_index(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Sessions of all ``sessions-index.json`` files below ``path``."""
    raw = spark.read.option("pathGlobFilter", "sessions-index.json").option("recursiveFileLookup", True).option("wholetext", True).text(path)
    entry = raw.select(F.explode(F.from_json("value", f"entries {INDEX}")["entries"]).alias("e")).select("e.*")
    return entry.filter("sessionId <> ''").select(
        F.col("sessionId").alias("id"), F.col("summary").alias("title"), F.coalesce("projectPath", F.lit("/")).alias("project_path"), F.coalesce(F.try_to_timestamp("created"), as_of).alias("started_at")
    )


def assemble(index: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions of the index with their number of messages; sessions without a message are left out."""
    counts = messages.groupBy("session_id").agg(F.count_distinct("id").alias("message_count"), F.max("timestamp").alias("ended_at"))
    return index.join(counts, F.col("id") == F.col("session_id")).drop("session_id")


def to_index(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids of sessions that are new or whose number of messages is not the stored one."""
    old = stored.select(F.col("id"), F.col("message_count").alias("_old"))
    return current.join(old, "id", "left").filter(~F.col("message_count").eqNullSafe(F.col("_old"))).select("id")
