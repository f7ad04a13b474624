"""Operators on projects, branches, hierarchies and chunks, on small made tables."""

import datetime as dt

from pyspark.sql import functions as F

from chronodex.functions import chunking, text
from chronodex.operators import corpus, incremental
from chronodex.plans.project_queries import match_plans


def test_plans_are_matched_by_four_levels(spark):
    projects = spark.createDataFrame([(p,) for p in ("/home/u/app-one", "/home/u/app2", "/x/lib3", "/y/zeta")], "project_path string")
    files = spark.createDataFrame([("/x/lib3", "src/core/run.rs"), ("/y/zeta", "Cargo.toml"), ("/home/u/app2", "docs/a.md")], "project_path string, file_path string")
    plans = spark.createDataFrame(
        [("whole", "in /home/u/app-one/src"), ("tail", "see u/app2 there"), ("source", "change src/core/run.rs"), ("manifest", "bump Cargo.toml"), ("folder", "write docs/ pages"), ("name", "zeta is slow"), ("none", "zetax and app-one-b"), ("null", None)],
        "id string, content string",
    )
    got = {(r.plan_id, r.project_path, r.level) for r in match_plans(plans, projects, files).collect()}
    assert got == {("whole", "/home/u/app-one", 1), ("tail", "/home/u/app2", 2), ("source", "/x/lib3", 3), ("manifest", "/y/zeta", 3), ("folder", "/home/u/app2", 3), ("name", "/y/zeta", 4)}
    assert match_plans(plans.limit(0), projects, files).count() == 0


def test_roots_of_any_depth_without_circles(spark):
    rows = [("b", str(i), str(i - 1) if i else None) for i in range(70)] + [("b", "x", "y"), ("b", "y", "x"), ("b", "orphan", "gone"), ("c", "0", None), (None, "n", None), (None, "m", "n")]
    df = spark.createDataFrame(rows, "branch string, id string, parent string")
    got = {(r.branch, r.id): (r.root, r.depth) for r in incremental.roots(df, "id", "parent", "branch").collect()}
    assert got == {**{("b", str(i)): ("0", i) for i in range(70)}, ("c", "0"): ("0", 0), (None, "n"): ("n", 0), (None, "m"): ("n", 1)}


def test_branches_are_written_and_dropped_alone(spark, tmp_path):
    path = str(tmp_path / "branches")
    schema = "id string, branch_name string"
    incremental.write_branches(spark.createDataFrame([("a", "main"), ("b", "dev"), ("c", "fix/x")], schema), path)
    incremental.write_branches(spark.createDataFrame([("z", "dev")], schema), path)
    read = lambda: {(r.id, r.branch_name) for r in spark.read.parquet(path).collect()}
    assert read() == {("a", "main"), ("z", "dev"), ("c", "fix/x")}
    assert incremental.drop_branch(spark, path, "fix/x") and not incremental.drop_branch(spark, path, "never")
    assert read() == {("a", "main"), ("z", "dev")}


def test_long_id_lists_come_in_blocks(spark):
    df = spark.createDataFrame([("k", str(i % 50)) for i in range(200)] + [(None, "a"), ("k", None)], "k string, m string")
    lists = incremental.id_lists(df, "k", "m", most=10).collect()
    assert {x for r in lists if r.k for x in r.ids} == {str(i) for i in range(50)} and sum(len(r.ids) for r in lists if r.k) == 50 and len(lists) > 4
    assert [r.ids for r in lists if r.k is None] == [["a"]]


def test_states_and_changes_by_time(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    state = incremental.set_index_state(spark.createDataFrame([("a", t[0]), ("b", t[2])], "id string, indexed_at timestamp"), spark.createDataFrame([("a", t[1]), ("c", t[1])], "id string, indexed_at timestamp"))
    now = spark.createDataFrame([("a", t[2]), ("b", t[1]), ("d", t[0])], "id string, at timestamp")
    assert {(r.id, r.reason) for r in incremental.to_index(now, state, "id", "at", "indexed_at").collect()} == {("a", "later"), ("d", "new")}


def test_large_symbols_lose_nothing():
    code = "fn f()\n" + "{\n" + "\n".join(f"line {i};" for i in range(700)) + "\n}"
    blocks = chunking.symbol_blocks(code, 10, "Function: f\n")
    assert blocks[0][3].startswith("Function: f\nfn f()\n{") and blocks[0][3].endswith("// ... [truncated]") and blocks[0][1] == 11 and blocks[-1][2] == 10 + code.count("\n")
    assert all(f"line {i};" in "\n".join(b[3] for b in blocks) for i in range(700))
    wide = "x = '" + "é" * 30_000 + "'"
    assert "".join(b[3] for b in chunking.symbol_blocks(wide, 1)) == wide and all(len(b[3].encode()) <= 10_000 for b in chunking.symbol_blocks(wide, 1))


def test_hits_without_an_item_stay(spark):
    items = spark.createDataFrame([("File", "f", None, "a/b.rs", "Source: a/b.rs", "x" * 600, dt.datetime(2025, 12, 30), False)], "content_type string, item_id string, branch string, path string, title string, content string, ts timestamp_ntz, is_current boolean")
    hits = spark.createDataFrame([("File", "f", None, 0.5), ("File", "gone", None, 0.5)], "content_type string, item_id string, branch string, similarity double")
    got = {r.item_id: r for r in corpus.enrich(hits, items, F.lit("2026-01-01").cast("timestamp")).collect()}
    assert got["f"].confidence == "Low" and got["f"].is_deprecated and got["f"].content.endswith("...") and got["f"].age_text == "2 days ago" and got["gone"].title is None


def test_descriptions_and_links(spark):
    row = spark.range(1).select(
        text.commit_description(F.lit("feat(api)!: add x\n\nmore")).alias("a"), text.commit_description(F.lit("plain words")).alias("b"), text.commit_link(F.lit("0123456789abcdef"), None).alias("c"),
        text.session_description(F.lit(None).cast("string"), F.lit("s1")).alias("d"), text.import_summary(F.array(F.lit("use a;")), F.array().cast("array<string>")).alias("e"), text.watched_type(F.lit("a.MD")).alias("f"),
    ).first()
    assert tuple(row) == ("feat(api): add x [BREAKING]", "plain words", "0123456", "Session s1", "Imports:\n  - use a;\n", None)
