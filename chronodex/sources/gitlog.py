"""Data sources for version-control history: one row per commit with its numbers, or one per changed file with its patch.

    spark.dataSource.register(GitLogSource)
    spark.read.format("gitlog").option("since", "2025-01-01").load("/path/of/a/repository")
    spark.dataSource.register(GitDiffSource)
    spark.read.format("gitdiff").load("/path/of/a/repository")

The repository must be readable at the same path on every executor. All commits that HEAD reaches are
read; a merge is compared with its first parent. The option ``since`` leaves out commits before a time
(ISO format, UTC unless it says otherwise) before anything of them is compared.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import subprocess
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, short_hash string, author_name string, author_email string, commit_date timestamp, message string, parent_hashes array<string>, files_changed bigint, insertions bigint, deletions bigint, paths array<string>"
_FORMAT = "%x01%H%x02%an%x02%ae%x02%ct%x02%P%x02%B%x03"


def parse_log(raw: str) -> Iterator[tuple]:
    """Rows of ``git log --numstat`` output in the format of this module."""
    for part in raw.split("\x01")[1:]:
        head, _, numbers = part.partition("\x03")
        sha, name, mail, when, parents, message = head.split("\x02", 5)
        stats = [line.split("\t") for line in numbers.strip().splitlines() if line.count("\t") == 2]
        added = sum(int(a) for a, _, _ in stats if a.isdigit())
        removed = sum(int(d) for _, d, _ in stats if d.isdigit())
        yield (sha, sha[:7], name, mail, dt.datetime.fromtimestamp(int(when), dt.timezone.utc), message.strip(), parents.split(), len(stats), added, removed, [p for _, _, p in stats])


class Slice(InputPartition):
    def __init__(self, commits: list[str]):
        self.commits = commits


class GitLogReader(DataSourceReader):
    """Commits in slices, one task each; ``option("slice", n)`` sets how many commits a slice has.

    Each task gets the ids of its commits (the driver lists 40 characters per commit of one repository),
    so none walks through the history again.
    """

    def __init__(self, options):
        self.path, self.slice, self.since = options["path"], int(options.get("slice", 5000)), options.get("since")

    def _lines(self, *args: str, send: list[str] | None = None) -> Iterator[str]:
        """Output lines of a git command as it runs; a failure raises at the end."""
        with subprocess.Popen(["git", "-C", self.path, "-c", "core.quotePath=false", *args], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
            with p.stdin:  # git reads all of it before it writes
                p.stdin.write("".join(f"{line}\n" for line in send or []).encode())
            yield from io.TextIOWrapper(p.stdout, "utf-8", errors="replace", newline="\n")
        if p.returncode:
            raise RuntimeError(f"git {args[0]} failed with {p.returncode}")

    def partitions(self):
        start = None
        if self.since:
            start = dt.datetime.fromisoformat(self.since)
            start = (start if start.tzinfo else start.replace(tzinfo=dt.timezone.utc)).timestamp()
        listed = (line.split() for line in self._lines("log", "--format=%H %ct", "HEAD"))
        commits = [sha for sha, at in listed if start is None or int(at) >= start]
        return [Slice(commits[i : i + self.slice]) for i in range(0, len(commits), self.slice)]

    def _log(self, partition, *args: str) -> Iterator[str]:
        return self._lines("log", "--no-walk=unsorted", "--stdin", "--diff-merges=first-parent", "--root", *args, send=partition.commits)

    def read(self, partition):
        if partition is not None and partition.commits:
            yield from parse_log("".join(self._log(partition, "--numstat", f"--format={_FORMAT}")))


class GitLogSource(DataSource):
    @classmethod
    def name(cls):
        return "gitlog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return GitLogReader(self.options)


DIFF_SCHEMA = "id string, commit_id string, project_path string, file_path string, old_path string, old_oid string, new_oid string, change_type string, diff_content string, added_lines int, removed_lines int, timestamp timestamp"
_COMMIT = re.compile(r"\x01([0-9a-f]{40,64})\x02(\d+)$")


def _unquote(path: str) -> str:
    """A path of a patch header; git quotes those with quotes, tabs or line ends."""
    if not path.startswith('"'):
        return path
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m.group(1), m.group(1)), path.strip('"'))


def parse_patch(patch: list[str]) -> tuple:
    """(path, old path, old id, new id, change type, added, removed) of one file's patch.

    The old path is null unless the file was renamed or copied, an id is null on the side where the file
    does not exist. Binary files have no added or removed lines.
    """
    first = patch[0].removeprefix("diff --git ").rstrip("\n")
    path, old, ids, kind, added, removed, in_hunk = None, None, (None, None), "Modified", 0, 0, False
    for line in patch[1:]:
        if in_hunk or line.startswith("@@ "):
            in_hunk = True
            added += line.startswith("+")
            removed += line.startswith("-")
            continue
        word, _, rest = line.rstrip("\n").partition(" ")
        if line.startswith("new file mode"):
            kind = "Added"
        elif line.startswith("deleted file mode"):
            kind = "Deleted"
        elif line.startswith(("rename from ", "copy from ")):
            kind, old = ("Renamed" if word == "rename" else "Copied"), _unquote(rest[5:])
        elif line.startswith(("rename to ", "copy to ")):
            path = _unquote(rest[3:])
        elif word == "index":
            ids = tuple(None if not x.strip("0") else x for x in rest.split(" ")[0].split("..", 1))
        elif word in ("---", "+++") and rest.rstrip("\t") != "/dev/null":
            path = path or _unquote(rest.rstrip("\t"))[2:]
    if path is None:  # nothing but a mode or a binary file: the same path twice
        half = first[: len(first) // 2]
        path = _unquote(half).removeprefix("a/") if not half.startswith('"') else _unquote(half)[2:]
    return path, old, *ids, kind, added, removed


def parse_diffs(lines: Iterable[str], project: str) -> Iterator[tuple]:
    """Rows of ``git log -p`` output in the format of this module, one per file of a commit."""
    commit = when = None
    patch: list[str] = []

    def row() -> tuple:
        path, old, old_id, new_id, kind, added, removed = parse_patch(patch)
        return (f"diff:{commit}:{path}", commit, project, path, old, old_id, new_id, kind, "".join(patch), added, removed, when)

    for line in lines:
        head = _COMMIT.match(line)
        if (head or line.startswith("diff --git ")) and patch:
            yield row()
            patch = []
        if head:
            commit, when = head.group(1), dt.datetime.fromtimestamp(int(head.group(2)), dt.timezone.utc)
        elif patch or line.startswith("diff --git "):
            patch.append(line)
    if patch:
        yield row()


class GitDiffReader(GitLogReader):
    def read(self, partition):
        if partition is not None and partition.commits:
            yield from parse_diffs(self._log(partition, "-p", "--full-index", "-M", "--format=%x01%H%x02%ct"), self.path)


class GitDiffSource(DataSource):
    """One row per file that a commit changed; renames are found by similarity."""

    @classmethod
    def name(cls):
        return "gitdiff"

    def schema(self):
        return DIFF_SCHEMA

    def reader(self, schema):
        return GitDiffReader(self.options)
