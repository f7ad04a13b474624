import importlib.util
from pathlib import Path

import pytest

from chronodex.plans import registry

ROOT = Path(__file__).resolve().parent.parent


def compare_tool():
    spec = importlib.util.spec_from_file_location("compare", ROOT / "tools" / "compare.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def db(data):
    import duckdb

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, data, db, name):
    tool = compare_tool()
    got, want = registry.queries()[name](spark, data).toPandas(), db.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert tool.rows(got) == tool.rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"chunk_doc_files"}))
def test_query_without_sql_gives_rows(spark, data, name):
    assert registry.queries()[name](spark, data).limit(1).count() == 1


def test_documentation_files_of_every_format(spark, tmp_path):
    """The smallest tables have no documentation file, and none has RST or AsciiDoc, so these are made here."""
    import datetime as dt

    bodies = {"md": "# A\n\n*Text* of a.\n\n```\ncode\n```", "rst": "Title\n=====\n\nSome text\nover lines.\n\nSub\n---\n\nMore.", "adoc": "= Title\n\nText.\n\n----\ncode\n----\n", "txt": "One\nparagraph.\n\nAnother.", "py": "x = 1\n", "rest": "a\nb"}
    at = dt.datetime(2025, 1, 1)
    spark.createDataFrame([(f"f{e}", "/p", f"docs/x.{e}", at) for e in bodies], "id string, project_path string, file_path string, modified_at timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame([(f"f{e}", t, at) for e, t in bodies.items()], "file_id string, content string, read_at timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/file_texts.parquet")
    rows = registry.queries()["chunk_doc_files"](spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.file_id, r.chunk_no)):
        got.setdefault(r.file_id, []).append((r.kind, r.content))
    assert got["fmd"] == [("Header", "A"), ("Paragraph", "Text of a."), ("CodeBlock", "code")]
    assert got["frst"] == [("Header", "Title"), ("Paragraph", "Some text over lines."), ("Header", "Sub"), ("Paragraph", "More.")]
    assert got["fadoc"] == [("Header", "Title"), ("Paragraph", "Text."), ("CodeBlock", "code")]
    assert got["ftxt"] == [("Paragraph", "One paragraph."), ("Paragraph", "Another.")]
    assert got["frest"] == [("Other", "a b")] and got["fpy"] == [("Other", "x = 1")]  # no documentation: windows of lines


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_on_empty_tables(spark, empty_tables, name):
    n = registry.queries()[name](spark, empty_tables).count()
    assert n == {"status_summary": 9, "timeline_stats": 1}.get(name, n if name == "corpus_view" else 0)  # corpus_view counts what is there


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_on_nulls_does_not_fail(spark, null_tables, name):
    registry.queries()[name](spark, null_tables).collect()


def test_entry_points(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
