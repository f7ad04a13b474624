import datetime as dt
from pathlib import Path

from chronodex.llm import conversations as c
from chronodex.session import scratch_root

T0 = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, rows, sessions):
    table = spark.createDataFrame([(i, s, r, x, None if t is None else T0 + dt.timedelta(minutes=t), T0 + dt.timedelta(minutes=g)) for i, s, r, x, t, g in rows], c.MESSAGE)
    table.repartition(3).write.parquet(str(tmp_path / "messages.parquet"))
    known = spark.createDataFrame([(s,) for s in sessions], "id string")
    return {(r.session_id, r.turn, r.id) for r in c.conversations(c.stored_segments(spark, str(tmp_path / "messages.parquet")), known).collect()}


def talk(s, *items, start=0):
    return [(f"{s}{n}", s, r, x, start + n, start + n) for n, (r, x) in enumerate(items)]


def test_rules(spark, tmp_path):
    ok = [("User", "q"), ("AI", "r")]
    rows = talk("good", *ok, ("system", None), ("human", "q2"), ("assistant", "r2"))
    rows += talk("unknown", *ok) + talk("unanswered", *ok, ("user", "q")) + talk("twice", ("user", "q"), ("user", "q"), ("assistant", "r")) + talk("blank", ("user", "q"), ("assistant", " \n")) + talk("tool", *ok, ("tool", "x"))
    rows += talk("late", *ok, ("user", "a"), ("assistant", "b"), start=58) + talk("only", ("system", "x")) + [("x0", "notime", "user", "q", 1, 1), ("x1", "notime", "assistant", "r", 2, 2), ("x2", "notime", "system", "r", None, 3)] + talk("starts", ("assistant", "r"), ("user", "q"), ("assistant", "r"))
    # versions: the last stored one counts, and it may lie weeks later
    rows += [("v0", "ver", "user", "q", 1, 1), ("v1", "ver", "assistant", "", 2, 2), ("v1", "ver", "assistant", "done", 2, 50_000), ("v1", "ver", "assistant", "", 2, 1)]
    rows += [("n0", None, "user", "q", 1, 1), ("n1", None, "assistant", "r", 2, 2), ("", "", "user", "q", 1, 1)]
    got = run(spark, tmp_path, rows, ["good", "good", "unanswered", "twice", "blank", "tool", "late", "only", "notime", "starts", "ver", None])
    assert got == {("good", 1, "good0"), ("good", 2, "good1"), ("good", 3, "good3"), ("good", 4, "good4"), ("late", 1, "late0"), ("late", 2, "late1"), ("late", 3, "late2"), ("late", 4, "late3"), ("ver", 1, "v0"), ("ver", 2, "v1")}


def test_long_session_over_many_buckets(spark, tmp_path):
    rows = talk("hot", *[("user", "q") if n % 2 == 0 else ("assistant", "r") for n in range(600)])
    assert run(spark, tmp_path, rows, ["hot"]) == {("hot", n + 1, f"hot{n}") for n in range(600)}


def test_nothing(spark, tmp_path):
    assert run(spark, tmp_path, [], []) == set()


def test_late_rows_are_not_lost(spark, tmp_path):
    """Rows stored after the watermark may have passed come beside the stream, whatever the lateness allowed."""

    t0, path = dt.datetime(2024, 1, 1), str(tmp_path / "messages.parquet")
    at = lambda m, days=0: t0 + dt.timedelta(minutes=m, days=days)
    rows = [("a", "s", "user", "q", at(0), at(0)), ("b", "s", "assistant", "r", at(1), at(1, 60)), ("c", "s", "user", "q", at(90), at(90, 1)), ("d", "s", "assistant", "r", at(91), at(91)), ("x", "t", "user", "q", at(5), at(5)), ("y", "t", "assistant", " ", at(6), at(6, 90))]
    for n, part in enumerate((rows[2:], rows[:2])):  # two files, the later messages first
        spark.createDataFrame(part, "id string, session_id string, role string, content string, timestamp timestamp, ingested_at timestamp").coalesce(1).write.mode("append").parquet(path)
    sessions = spark.createDataFrame([("s",), ("t",)], "id string")
    want = {("s", n, i) for n, i in enumerate("abcd", 1)}
    for lateness in ("45 days", "12 hours"):
        segments = c.stored_segments(spark, path, lateness=lateness)
        assert {(r.session_id, r.turn, r.id) for r in c.conversations(segments, sessions).collect()} == want
    late = c.late_segments(spark.read.parquet(path), lateness="12 hours")
    assert {x.id for r in late.collect() for x in r.rows} == {"b", "c", "y"}


def test_an_ended_stream_leaves_its_output_alone(spark, tmp_path):
    """State (shared and on local disks), shuffle files and the marker go with the stream; settings are as before."""
    rows, path = talk("s", ("user", "q"), ("assistant", "r")), str(tmp_path / "messages.parquet")
    spark.createDataFrame([(i, s, r, x, T0 + dt.timedelta(minutes=t), T0 + dt.timedelta(minutes=g)) for i, s, r, x, t, g in rows], c.MESSAGE).write.parquet(path)
    env, settings = spark._jvm.org.apache.spark.SparkEnv.get(), spark.conf.getAll
    local = [Path(d.getPath()) for d in env.blockManager().diskBlockManager().localDirs()] + [Path(spark._jvm.org.apache.spark.util.Utils.getLocalDir(env.conf()))]
    kept = lambda: {p for d in local for pattern in ("shuffle_*", "StateStoreId*") for p in d.rglob(pattern)}
    shared = lambda: set(Path(scratch_root(spark).rpartition("://")[2], "chronodex").glob("conversations-*"))
    root, at_first, shared_at_first = scratch_root(spark), kept(), shared()
    segments = c.stored_segments(spark, path)
    assert {p.name.rpartition("-")[0] for p in shared() - shared_at_first} == {"conversations-out"}
    assert kept() <= at_first
    assert spark.conf.getAll == settings | {"spark.checkpoint.dir": root}
    assert {x.id for r in segments.collect() for x in r.rows} == {"s0", "s1"}
