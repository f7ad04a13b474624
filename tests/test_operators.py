import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from chronodex.operators import incremental, search, timeline
from chronodex.operators.ordered import bucketed_previous, bucketed_rank
from chronodex.tables import latest, role_of

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_latest_with_ties_nulls_and_repeats(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("a", None, "zz"), ("b", None, "n"), (None, 1, "k"), (None, 3, "l"), ("a", 2, "z")]
    got = latest(spark.createDataFrame(rows, "id string, v int, c string"), ["id"], "v")
    assert {(r.id, r.c) for r in got.collect()} == {("a", "z"), ("b", "n"), (None, "l")} and got.columns == ["id", "v", "c"]


def test_latest_of_nothing(spark):
    assert latest(spark.createDataFrame([], "id string, v int"), ["id"], "v").count() == 0


@pytest.mark.parametrize("spelled, role", [("User", "user"), (" human ", "user"), ("AI", "assistant"), ("SYSTEM", "system"), ("tool", None), ("", None), (None, None)])
def test_roles(spark, spelled, role):
    assert spark.createDataFrame([(spelled,)], "r string").select(role_of(F.col("r")).alias("x")).first().x == role


def brute_previous(rows):
    out = {}
    for key in {r[0] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            out[r[1]] = last
            last = r[1]
    return out


def test_previous_and_rank_with_one_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc"), f"i{i:03}", at(rng.randrange(0, 6000))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id string, ts timestamp").withColumn("extra", F.lit(1))
    prev = bucketed_previous(df, "k", ["ts", "id"], ["id"], F.date_trunc("hour", "ts"))
    assert {r.id: r.prev_id for r in prev.collect()} == brute_previous(rows)
    rank = bucketed_rank(df, "k", ["ts", "id"], F.date_trunc("hour", "ts"))
    want = {}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])), 1):
            want[r[1]] = n
    assert {r.id: r.position for r in rank.collect()} == want
    assert "extra" in prev.columns and bucketed_previous(df.limit(0), "k", ["ts", "id"], ["id"], F.date_trunc("hour", "ts")).count() == 0


def test_as_of_as_by_hand(spark):
    rng = random.Random(2)
    left = [(f"s{i}", rng.choice(["p", "q", None]), at(rng.randrange(0, 200_000)) if rng.random() < 0.95 else None) for i in range(200)]
    right = [(rng.choice(["p", "q", "r"]), at(rng.randrange(0, 200_000)), i) for i in range(60)]
    got = timeline.as_of(spark.createDataFrame(left, "id string, p string, ts timestamp"), spark.createDataFrame(right, "p string, ts timestamp, c int"), "p", "ts", "c")
    for r in got.collect():
        before = [x for x in right if r.ts and x[0] == r.p and x[1] <= r.ts]
        assert r.c == (max(before, key=lambda x: (x[1], x[2]))[2] if before else None)
    assert got.count() == 200


def vecs(spark, rows):
    return spark.createDataFrame(rows, "vec_id string, content_type string, embedding array<double>")


def test_nearest_grid_and_edges(spark):
    grid = vecs(spark, [(f"{x}_{y}", "File", [float(x), float(y)]) for x in range(10) for y in range(10)])
    query = spark.createDataFrame([([5.0, 5.0],)], "query array<double>")
    assert [r.vec_id for r in search.nearest(grid, query, 1).collect()] == ["5_5"]
    assert search.nearest(grid, query, 0).count() == 0 and search.nearest(grid, query, 500).count() == 100
    assert search.nearest(grid, query, 5, where=F.col("content_type") == "Symbol").count() == 0
    assert search.nearest(grid.limit(0), query, 3).count() == 0
    assert [r.vec_id for r in search.nearest(grid, query, 5).collect()] == ["5_5", "4_5", "5_4", "5_6", "6_5"]


def test_quota(spark):
    df = spark.createDataFrame([(i, "S" if i % 2 else "F", float(i)) for i in range(20)], "vec_id int, t string, distance double")
    got = search.quota(df, F.col("t"), {"S": 3, "F": 1}, [F.col("distance")])
    assert sorted((r.section, r.vec_id) for r in got.collect()) == [("F", 0), ("S", 1), ("S", 3), ("S", 5)]


def test_change_set_and_upsert(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], "k string, h string")
    old = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", None), ("e", "5")], "k string, h string")
    assert {(r.k, r.change) for r in incremental.change_set(now, old, "k", "h").collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "unchanged"), ("d", "new"), ("e", "deleted")}
    merged = incremental.upsert(spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 1)], "k string, v int"), ["k"], "v")
    assert {tuple(r) for r in merged.collect()} == {("a", 2), ("b", 1)}


def test_timeline(spark):
    commits = spark.createDataFrame([(1, at(0), "feat(api): add"), (2, at(10), "fix: bug"), (3, None, "lost")], "id int, ts timestamp, message string")
    talk = spark.createDataFrame([("s", at(5), "random text"), ("t", at(6), None)], "id string, ts timestamp, title string")
    t = timeline.events(commits, talk)
    assert t.count() == 4 and {r.topic for r in timeline.by_topic(t).collect()} == {"api", "fix", "random", "Session"}  # one without a title is told by its id
    assert [r.event_id for r in timeline.on_topic(t, "API").collect()] == ["1"]
    assert sum(r.n_events for r in timeline.by_period(t, F.lit(at(60 * 24 * 40)), 30).collect()) == 4


def test_skewed_key_stays_spread(spark):
    rows = [Row(k="hot", id=i, ts=at(i)) for i in range(2000)]
    got = bucketed_rank(spark.createDataFrame(rows), "k", ["ts", "id"], F.date_trunc("hour", "ts"))
    assert got.agg(F.max("position")).first()[0] == 2000
