"""The state of files in a working tree, as a small table to join with."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file_path string, status string, is_current boolean"


def parse_status(raw: str) -> list[tuple[str, str, bool]]:
    """(path, status, current) of the output of ``git status --porcelain=v1 -z``.

    Untracked files count as current; a file that is gone does not.
    """
    rows, parts = [], raw.split("\0")
    i = 0
    while i < len(parts):
        entry = parts[i]
        i += 1
        if len(entry) < 4:
            continue
        index, tree, path = entry[0], entry[1], entry[3:]
        if index in "RC":
            i += 1  # the old path
        if "?" in (index, tree):
            rows.append((path, "Untracked", True))
        elif tree == "D" or index == "D":
            rows.append((path, "Deleted", False))
        elif tree in "MT" or index in "MT":
            rows.append((path, "Modified since last commit", False))
        elif index in "ARC":
            rows.append((path, "Staged changes", False))
    return rows


def read_status(spark: SparkSession, repository: str) -> DataFrame:
    """One row per file that differs from the last commit: as many rows as there are changed files."""
    raw = subprocess.run(["git", "-C", repository, "status", "--porcelain=v1", "-z"], capture_output=True, text=True, errors="replace", check=True).stdout
    return spark.createDataFrame(parse_status(raw), SCHEMA)


def with_status(files: DataFrame, status: DataFrame) -> DataFrame:
    """Adds ``status`` and ``is_current``; files that the status doesn't name are current."""
    found = files.drop("status", "is_current").join(status, "file_path", "left")
    return found.withColumn("status", F.coalesce("status", F.lit("Current"))).withColumn("is_current", F.coalesce("is_current", F.lit(True)))
