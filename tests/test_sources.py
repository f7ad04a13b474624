import datetime as dt
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from chronodex.api import Engine, render
from chronodex.sources import chat, files, gitstatus
from chronodex.sources.gitlog import GitDiffSource, GitLogSource, parse_patch
from chronodex.streaming import activity

def as_of():
    return F.lit("2024-06-01").cast("timestamp")


def test_files(spark, tmp_path):
    for name, body in {"src/main.rs": "fn main() {}", "README.md": "# x", "node_modules/a.js": "x", "log/a.log": "x", "log/keep.log": "x", ".hidden": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    df = files.read_files(spark, str(tmp_path), ["*.log", "!keep.log", "# c"], "/p")
    got = {r.file_path: r for r in df.collect()}
    assert set(got) == {"src/main.rs", "README.md", "log/keep.log"}
    r = got["src/main.rs"]
    import hashlib

    assert (r.kind, r.language, r.size) == ("Source", "rust", 12) and r.content_hash == hashlib.sha256(b"fn main() {}").hexdigest() and r.id == "file:" + hashlib.sha256(b"/p/src/main.rs").hexdigest()


@pytest.mark.parametrize("path, out", [("a/target/x", True), ("target", True), ("docs/a.md", True), ("x/docs/a.md", False), ("b.tmp", True), ("q/b.tmp", True), ("build/out.o", True), ("src/build", False)])
def test_ignore_rules(spark, path, out):
    assert spark.range(1).select(files.ignored(F.lit(path), ["target", "/docs/*.md", "*.tmp", "build/"]).alias("x")).first().x is out


def line(**kw):
    base = {"type": "user", "uuid": "m1", "sessionId": "s1", "timestamp": "2024-01-01T10:00:00Z", "message": {"role": "user", "content": "Hello", "tokens": 10}}
    return json.dumps(base | kw)


def test_chat_logs(spark, tmp_path):
    good = [line(), line(uuid="m2", type="assistant", timestamp="never", message={"role": "assistant", "content": "Hi", "model": "m"})]
    bad = ["{broken", line(uuid=""), line(sessionId=""), line(type="summary"), line(message={"role": "user", "content": ""}), line(message={"role": "tool", "content": "x"}), ""]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/s1.jsonl").write_text("\n".join(good + bad))
    (tmp_path / "p/sessions-index.json").write_text(json.dumps({"entries": [{"sessionId": "s1", "summary": "T", "created": "2024-01-01T09:00:00Z"}, {"sessionId": "s2"}]}))
    m = chat.read_messages(spark, str(tmp_path), as_of())
    got = {r.id: r for r in m.collect()}
    assert set(got) == {"m1", "m2"} and got["m1"].tokens == 10 and got["m2"].timestamp == dt.datetime(2024, 6, 1)
    s = chat.assemble(chat.read_index(spark, str(tmp_path), as_of()), m).collect()
    assert [(r.id, r.title, r.project_path, r.message_count) for r in s] == [("s1", "T", "/", 2)]
    stored = spark.createDataFrame([("s1", 2)], "id string, message_count long")
    assert chat.to_index(chat.assemble(chat.read_index(spark, str(tmp_path), as_of()), m), stored).count() == 0


def test_git_log(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A B", "-c", "user.email=a@b.example", *a], check=True, capture_output=True)
    git("init", "-q")
    for n in range(3):
        (tmp_path / "f.txt").write_text("line\n" * (n + 1))
        git("add", ".")
        git("commit", "-q", "-m", f"feat: change {n}\n\nbody")
    spark.dataSource.register(GitLogSource)
    rows = spark.read.format("gitlog").option("slice", 2).load(str(tmp_path)).orderBy("commit_date", "id").collect()
    assert len(rows) == 3 and {r.files_changed for r in rows} == {1} and sum(r.insertions for r in rows) == 3
    assert all(r.message.startswith("feat: change") and r.short_hash == r.id[:7] and r.paths == ["f.txt"] for r in rows)


def test_git_diffs(spark, tmp_path):
    def git(*a, day=1):
        when = f"2024-01-{day:02}T00:00:00Z"
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@b.example", "-c", "commit.gpgsign=false", *a], check=True, capture_output=True, env={"GIT_COMMITTER_DATE": when, "GIT_AUTHOR_DATE": when, "PATH": "/usr/bin:/bin"})

    git("init", "-q", "-b", "main")
    (tmp_path / "a.txt").write_text("1\n2\n--- x\n4\n5\n")
    (tmp_path / "my file é.txt").write_text("x\n")
    (tmp_path / "bin").write_bytes(b"\0\1")
    git("add", ".")
    git("commit", "-q", "-m", "one", day=1)
    (tmp_path / "a.txt").write_text("1\n2\n4\n5\n+++ y\n")
    (tmp_path / "my file é.txt").unlink()
    (tmp_path / "bin").write_bytes(b"\0\2")
    git("commit", "-q", "-am", "two", day=2)
    git("checkout", "-q", "-b", "side")
    git("mv", "a.txt", "b.txt")
    git("commit", "-q", "-m", "three", day=3)
    git("checkout", "-q", "main")
    (tmp_path / "c.txt").write_text("c")
    git("add", ".")
    git("commit", "-q", "-m", "four", day=4)
    git("merge", "-q", "--no-ff", "-m", "five", "side", day=5)
    spark.dataSource.register(GitDiffSource)
    spark.dataSource.register(GitLogSource)
    load = lambda source, **o: spark.read.format(source).options(slice=2, **o).load(str(tmp_path))
    rows = [(r.timestamp.day, r.file_path, r.old_path, r.change_type, r.added_lines, r.removed_lines, r.old_oid is None, r.new_oid is None) for r in load("gitdiff").collect()]
    assert sorted(rows, key=lambda r: r[:2]) == [
        (1, "a.txt", None, "Added", 5, 0, True, False), (1, "bin", None, "Added", 0, 0, True, False), (1, "my file é.txt", None, "Added", 1, 0, True, False),
        (2, "a.txt", None, "Modified", 1, 1, False, False), (2, "bin", None, "Modified", 0, 0, False, False), (2, "my file é.txt", None, "Deleted", 0, 1, False, True),
        (3, "b.txt", "a.txt", "Renamed", 0, 0, True, True), (4, "c.txt", None, "Added", 1, 0, True, False), (5, "b.txt", "a.txt", "Renamed", 0, 0, True, True),
    ]
    assert {r.timestamp.day for r in load("gitdiff", since="2024-01-03").collect()} == {3, 4, 5}
    assert load("gitlog").count() == 5 and load("gitlog", since="2024-01-05T00:00:00").count() == 1 and load("gitlog", since="2025-01-01").count() == 0
    assert parse_patch(["diff --git a/x y b/x y\n", "old mode 100644\n", "new mode 100755\n"])[0] == "x y"


def test_projects_and_plans(spark, tmp_path):
    for name in ("projects/-home-me-my_app/s1.jsonl", "projects/-home-me-my_app/deep/s2.jsonl", "projects/x.jsonl", "projects/p/s3.jsonl", "projects/p/no.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    assert {(r.session_id, r.project_path) for r in chat.read_projects(spark, str(tmp_path)).collect()} == {("s1", "/home/me/my-app"), ("s3", "p")}
    for name, body in {"a.md": "text\n# The Plan\nx", "b.md": "no title", "e.md": "", "c.txt": "# no", "deep/d.md": "# no"}.items():
        (tmp_path / "plans" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "plans" / name).write_text(body)
    assert {(r.id, r.title, r.content) for r in chat.read_plans(spark, str(tmp_path / "plans")).collect()} == {("a", "The Plan", "text\n# The Plan\nx"), ("b", "b", "no title")}


def test_stream_upserts(spark, tmp_path):
    schema = "id string, ts timestamp, v int"
    batches = [[("a", "2024-01-01", 1), ("b", "2024-01-01", 1)], [("a", "2024-01-02", 2), ("c", "2024-01-01", 1), (None, "2024-01-01", 7)], [("a", "2024-01-01", 9)], [("a", "2024-01-05", 3), ("a", "2024-01-04", 4)]]
    out = str(tmp_path / "out")
    assert activity.current(spark, out) is None
    write = activity.upsert_into(out, ["id"], "ts", parts=4)
    for rows in batches:
        spark.createDataFrame(rows, "id string, ts string, v int").selectExpr("id", "cast(ts as timestamp) ts", "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want = {("a", 3), ("b", 1), ("c", 1), (None, 7)}
    assert {(r.id, r.v) for r in activity.current(spark, out).collect()} == want
    versions = activity._versions(spark, out)
    assert max(len(v) for v in versions.values()) == 2  # the part of "a" was written four times
    last = spark.createDataFrame(batches[3], "id string, ts string, v int").selectExpr("id", "cast(ts as timestamp) ts", "v")
    write(last, 3)  # the same batch again
    assert {(r.id, r.v) for r in activity.current(spark, out).collect()} == want and activity._versions(spark, out) == versions
    write(last.limit(0), 4)
    assert activity.current(spark, out).count() == 4


def test_repeated_rows_of_a_stream(spark, tmp_path):
    schema = "id string, ts timestamp"
    for rows in ([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 2))], [("a", dt.datetime(2024, 1, 3)), ("c", dt.datetime(2024, 1, 3))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = activity.deduplicated(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "id", "ts")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_engine(spark, data):
    e = Engine(spark, data, dt.datetime(2026, 1, 1))
    v = spark.read.parquet(f"{data}/cache_entries.parquet").filter("size(embedding) = 96 and not isnan(embedding[0])").first().embedding
    best = e.search(v, top_k=3)
    assert best.count() == 3 and render(best, "text").count("\n") == 2 and "Score" in render(best) and render(best, "json").startswith("[")
    assert {r.content_type for r in e.search(v, "message", 5).collect()} <= {"Message"}
    assert e.search(v, ranked=False, top_k=1).first().distance < 1e-6
    for bad in ({"content_type": "x"}, {"top_k": 0}, {"top_k": 1001}, {"max_age": "0d"}):
        with pytest.raises(ValueError):
            e.search(v, **bad)
    assert e.timeline(top_k=5).count() == 5 and e.status().count() == 9
    e.register()
    assert spark.sql("select size(chunk_message('Hello there.')) n").first().n == 1


def test_git_status(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@b.example", *a], check=True, capture_output=True)
    git("init", "-q")
    for n in ("same", "changed", "gone", "moved"):
        (tmp_path / n).write_text(n * 20)
    git("add", ".")
    git("commit", "-q", "-m", "x")
    (tmp_path / "changed").write_text("y")
    (tmp_path / "gone").unlink()
    (tmp_path / "new").write_text("z")
    (tmp_path / "staged").write_text("z")
    git("add", "staged")
    git("mv", "moved", "there")
    known = spark.createDataFrame([("same",), ("changed",), ("gone",), ("new",), ("staged",), ("there",)], "file_path string")
    got = {r.file_path: (r.status, r.is_current) for r in gitstatus.with_status(known, gitstatus.read_status(spark, str(tmp_path))).collect()}
    assert got == {"same": ("Current", True), "changed": ("Modified since last commit", False), "gone": ("Deleted", False), "new": ("Untracked", True), "staged": ("Staged changes", False), "there": ("Staged changes", False)}
    assert gitstatus.read_status(spark, str(tmp_path)).count() == 5 and gitstatus.parse_status("") == []
