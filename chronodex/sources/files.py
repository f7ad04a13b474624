"""Reading a folder of files: contents, kinds, hashes and what an ignore file leaves out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: Folders that are never read, and the largest file.
SKIPPED_FOLDERS = ["node_modules", "target", "vendor", ".git", "dist", "build"]
MAX_BYTES = 10 * 1024 * 1024


def ignore_rules(patterns: list[str]) -> list[tuple[str, bool]]:
    """(regular expression, whether it ignores) of each line of an ignore file, in order.

    ``*``, ``?`` and ``**``, a leading or inner ``/`` (anchored), a trailing ``/`` (folders) and ``!``
    (taken back in) are understood; blank lines and comments are left out.
    """
    rules = []
    for line in patterns:
        p = line.rstrip()
        if not p or p.startswith("#"):
            continue
        ignores = not p.startswith("!")
        p = p[0 if ignores else 1 :].removeprefix("\\")
        folder, p = p.endswith("/"), p.rstrip("/")
        anchored, p = "/" in p, p.lstrip("/")
        out = ""
        for part in re.split(r"(\*\*/|/\*\*|\*\*|\*|\?)", p):
            out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
        rules.append((("^" if anchored else "^(?:.*/)?") + out + ("/.+$" if folder else "(?:/.*)?$"), ignores))
    return rules


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path is left out: the last rule that matches decides."""
    out = F.lit(False)
    for expression, ignores in ignore_rules(patterns):
        out = F.when(path.rlike(expression), F.lit(ignores)).otherwise(out)
    return out


def read_files(spark: SparkSession, root: str, patterns: list[str] | None = None, project: str | None = None) -> DataFrame:
    """One row per file below ``root`` with the columns of the files table, plus ``content``.

    Skips the usual build folders, ignored paths and files of more than ``MAX_BYTES``. The content is
    text; the hash is that of the bytes. Files whose name begins with a dot or underline are left out, as in
    all of Spark's file sources.
    """
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(re.sub("^file:/+", "/", base)), "")
    rows = raw.filter(F.col("length") <= MAX_BYTES).withColumn("file_path", relative)
    rows = rows.filter(~F.substring_index("file_path", "/", 1).isin(SKIPPED_FOLDERS) & ~ignored(F.col("file_path"), patterns or []))
    where = F.lit(project or root.rstrip("/"))
    return rows.select(
        F.concat(F.lit("file:"), F.sha2(F.concat_ws("/", where, "file_path"), 256)).alias("id"), where.alias("project_path"), "file_path",
        text.language(F.col("file_path")).alias("language"), text.file_kind(F.col("file_path")).alias("kind"), F.col("modificationTime").alias("modified_at"),
        F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), F.col("content").cast("string").alias("content"),
    )
