import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronodex.operators.ordered import changes
from chronodex.streaming import lifecycle as lc

T0 = dt.datetime(2025, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def run_batches(spark, folder, schema, batches, build):
    """What ``build`` emits over micro-batches, one per list of rows."""
    out = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()
        out.append([r for r in rows if r not in [x for b in out for x in b]])
    return out


def test_sessions_end_or_time_out_over_batches(spark, tmp_path):
    schema = "session_id string, kind string, at timestamp"
    batches = [
        [("a", "session_start", at(0)), ("b", "session_start", at(0)), (None, "session_start", at(0)), ("c", "session_start", None)],
        [("a", "message", at(1)), ("b", "session_end", at(5)), ("b", "message", at(3)), ("b", "session_start", at(1))],
        [("z", "message", at(500))],
        [("z", "message", at(501))],
    ]
    got = run_batches(spark, tmp_path, schema, batches, lambda s: lc.lifecycle(s, dt.timedelta(minutes=10), "1 minute"))
    assert got[0] == []
    assert [(r.session_id, r.started_at, r.ended_at, r.last_seen, r.state, r.n_events) for r in got[1]] == [("b", at(0), at(5), at(5), "ended", 4)]
    late = [(r.session_id, r.started_at, r.ended_at, r.last_seen, r.state, r.n_events) for r in got[2] + got[3]]
    assert late == [("a", at(0), None, at(1), "timed_out", 2)]


def test_a_growing_file_gives_each_line_once(spark, tmp_path):
    schema = "file_id string, content string, read_at timestamp"
    first, more = "l1\nl2\n\nl4", "l1\nl2\n\nl4\r\nl5\nl6\nl7\n"
    batches = [[("f", first, at(0)), ("f", "x1", at(1)), ("f", None, at(0)), (None, "x", at(0)), ("e", "", at(0))], [("f", more, at(2)), ("f", more + "l8", at(3)), ("f", "l1", None)], [("f", first, at(4))]]
    got = run_batches(spark, tmp_path, schema, batches, lambda s: lc.new_lines(s, 3))
    assert sorted((r.line_no, r.line, r.read_at) for r in got[0]) == [(1, "l1", at(0)), (2, "l2", at(0)), (4, "l4", at(0))]
    assert sorted((r.line_no, r.line, r.read_at) for r in got[1]) == [(5, "l5", at(2)), (6, "l6", at(2)), (7, "l7", at(2)), (8, "l8", at(3))]
    assert got[2] == []


def test_bursts_are_reported_when_they_are_over(spark, tmp_path):
    schema = "path string, t timestamp, n int"
    batches = [[("a", at(0), 1), ("a", at(1), 2), ("b", at(0), 3), (None, at(0), 4), ("b", None, 5)], [("a", at(2), 6), ("z", at(60), 7)], [("z", at(61), 8)]]
    got = run_batches(spark, tmp_path, schema, batches, lambda s: lc.debounced(s, "path", "t", ["n"], "5 minutes", "1 minute"))
    assert got[0] == []
    assert sorted((r.path, r.first_change, r.last_change, r.n, r.n_changes) for b in got for r in b) == [("a", at(0), at(2), 6, 3), ("b", at(0), at(0), 3, 1)]


def test_changes_of_a_value(spark):
    rows = [("k", at(0), "x"), ("k", at(10), "x"), ("k", at(200), None), ("k", at(201), None), ("k", at(400), "y"), ("j", at(0), "x"), (None, at(0), "p"), (None, at(1), "q")]
    df = spark.createDataFrame(rows, "k string, t timestamp, v string")
    got = changes(df, "k", ["t"], "v", F.date_trunc("hour", "t")).collect()
    assert sorted((r.k or "", r.t, r.prev_v, r.v) for r in got) == sorted([("k", at(200), "x", None), ("k", at(400), None, "y"), ("", at(1), "p", "q")], key=lambda x: x[:2])
    assert changes(df.limit(0), "k", ["t"], "v", F.date_trunc("hour", "t")).count() == 0


@pytest.mark.parametrize("when", [dt.datetime(3000, 1, 1), dt.datetime(1601, 1, 1)])
def test_far_times_do_not_crash(spark, tmp_path, when):
    got = run_batches(spark, tmp_path, "session_id string, kind string, at timestamp", [[("a", "session_start", when), ("a", "session_end", when)]], lc.lifecycle)
    assert [(r.started_at, r.ended_at, r.state) for r in got[0]] == [(when, when, "ended")]
