import datetime as dt

from pyspark.sql import functions as F

from chronodex.api import Engine
from chronodex.functions import scoring, sql, text, vectors


def test_sql_functions_equal_the_column_expressions(spark):
    at = dt.datetime(2025, 6, 1)
    rows = [
        ([1.0, 2.0], [3.0, 5.0], at - dt.timedelta(days=9, hours=5), 9, "Message", True, "High", "feat: a\r\nb", "/a-b/c_d", "x\n# T \nz"),
        ([1.0], [3.0, 5.0], at + dt.timedelta(days=2), -2, "File", None, "Lowest", "", "C:\\x", "# "),
        ([0.0, 0.0], [0.0, 1.0], dt.datetime(1960, 1, 1), 40, "Symbol", False, "none", "one", "", ""),
        (None, [1.0], None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, ts timestamp, age long, kind string, cur boolean, level string, msg string, path string, body string")
    sql.register(spark)
    c = F.col
    pairs = {
        "l2_distance(a, b)": vectors.l2_distance(c("a"), c("b")), "dot_product(a, b)": vectors.dot(c("a"), c("b")), "vector_norm(a)": vectors.norm(c("a")), "cosine_similarity(a, b)": vectors.cosine(c("a"), c("b")),
        "similarity(vector_norm(b))": vectors.similarity(vectors.norm(c("b"))), "age_days(ts, timestamp '2025-06-01')": scoring.age_days(c("ts"), F.lit("2025-06-01").cast("timestamp")), "time_decay(age)": scoring.decay(c("age")),
        "confidence_level(kind, age, cur)": scoring.confidence_level(c("kind"), c("age"), c("cur")), "base_weight(level)": scoring.base_weight(c("level")),
        "final_score(0.5D, age, base_weight(level))": scoring.final_score(F.lit(0.5), c("age"), scoring.base_weight(c("level"))), "first_line(msg)": text.first_line(c("msg")), "encode_project_path(path)": text.encode_project_path(c("path")),
        "decode_project_path(path)": text.decode_project_path(c("path")), "markdown_title(body)": text.markdown_title(c("body")), "forward_slashes(path)": text.forward_slashes(c("path")),
    }
    got = df.select(*[F.expr(s).alias(f"s{i}") for i, s in enumerate(pairs)], *[e.alias(f"c{i}") for i, e in enumerate(pairs.values())]).collect()
    assert {s.split("(")[0] for s in pairs} == set(sql.SQL_FUNCTIONS)
    for i, s in enumerate(pairs):
        for r in got:
            x, y = r[f"s{i}"], r[f"c{i}"]
            assert x == y or abs(x - y) < 1e-12, (s, x, y)


def test_views(spark, data):
    e = Engine(spark, data, dt.datetime(2026, 1, 1))
    names = e.register()
    assert {"l2_distance", "chunk_message", "current_messages", "symbols"} <= set(names)
    e.view("branch_symbols")
    assert spark.table("branch_symbols").count() == spark.sql("select count(distinct branch_name) n from symbols").first().n
    assert spark.sql("select count(*) n, count(distinct id) d from current_messages").first().n > 0
    plan = spark.sql("select first_line(text) l from documents")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
