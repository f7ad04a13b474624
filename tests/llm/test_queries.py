"""All pN_ queries on the smallest tables, on empty ones and on nulls."""

from pathlib import Path

import pytest

from chronodex.llm import queries as llm

COLUMNS = {
    "p1_found": [("id", "string"), ("defect", "string")], "p2_found": [("file_id", "string"), ("name", "string"), ("start_line", "int")],
    "p3_found": [("session_id", "string"), ("turn", "int"), ("id", "string")], "p4_found": [("id_a", "bigint"), ("id_b", "bigint")],
    "p5_found": [("source", "string"), ("id", "string"), ("kind", "string")], "p6_found": [("source", "string"), ("id", "string"), ("line_no", "int")],
    "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p9_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, data, name):
    df = llm.queries()[name](spark, data)
    assert df.dtypes == COLUMNS[name]
    rows = [str(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_empty_tables(spark, empty_tables, name):
    assert llm.queries()[name](spark, empty_tables).count() == 0


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_null_tables(spark, null_tables, name):
    rows = llm.queries()[name](spark, null_tables).collect()
    assert name in ("p7_ids", "p5_redacted") or not rows


def test_sql_of_conversations(spark, data):
    import duckdb

    db = duckdb.connect()
    for t in ("messages", "chat_sessions"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(data) / t}.parquet'")
    want = set(db.execute(llm.oracle_sql()["p3_found"]).fetchall())
    assert {(r.session_id, r.turn, r.id) for r in llm.queries()["p3_found"](spark, data).collect()} == {(s, t, i) for i, s, t in [(w[2], w[0], w[1]) for w in want]}


def test_sql_is_text():
    assert set(llm.oracle_sql()) <= set(llm.queries()) and all(isinstance(x, str) for x in llm.oracle_sql().values())
