"""The matrix search against scores of every pair."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from chronodex.functions import vectors
from chronodex.operators import search


def counts(n, seed, most=4):
    m = np.random.default_rng(seed).integers(0, most, (n, 96)) * (np.random.default_rng(seed + 1).random((n, 96)) < 0.1)
    m[:, 0] += 1
    return m


@pytest.mark.parametrize("measure", ["distance", "cosine"])
@pytest.mark.parametrize("scale", [1.0, 1e30, 1e-30])
def test_candidates_are_few_and_hold_the_best(measure, scale):
    x, v = scale * np.random.default_rng(1).normal(size=(3000, 96)), scale * np.random.default_rng(2).normal(size=(40, 96))
    x[100:140] = x[100]  # forty equal ones
    v[0] = x[100]
    rows, cols = search.candidates(x, v, 5, measure)(0, len(v))
    got = [set(cols[rows == i]) for i in range(len(v))]
    for i in range(len(v)):
        near = -((x - v[i]) ** 2).sum(1) if measure == "distance" else x @ v[i] / np.linalg.norm(x, axis=1)
        assert set(np.flatnonzero(near >= np.sort(near)[-5])) <= got[i]
    assert set(range(100, 140)) <= got[0] and sum(map(len, got[1:])) < 20 * len(v)


def test_candidates_of_odd_vectors():
    x = np.random.default_rng(1).normal(size=(300, 96))
    assert search.candidates(x[:20], x, 5) is None and search.candidates(np.where(x > 3, np.nan, x), x, 5) is None
    assert search.candidates(0 * x, x, 5)(0, 1)[1].tolist() == list(range(300))


def test_equal_counts_and_ties(spark, monkeypatch):
    """Equal vectors beyond the k least ids change nothing; ties by rounded distance go by id, across blocks."""
    monkeypatch.setattr(search, "ITEM_BLOCK", 90)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    m, q = counts(400, 1), counts(20, 3)
    m[50:80] = q[0]
    m[300:] = 2 * m[200:300]  # the same directions
    items = spark.createDataFrame([(f"i{i:03}", v.tolist()) for i, v in enumerate(m)], "vec_id string, embedding array<int>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "vec_id long, embedding array<int>")
    few = search.first_of_equal(items, 4)
    assert few.count() < 400 and few.filter("vec_id between 'i050' and 'i079'").count() == 4
    unit = lambda a: a / np.sqrt((a * a).sum(1))[:, None]
    d = np.round(np.sqrt(((unit(q)[:, None] - unit(m)[None]) ** 2).sum(2)), 9)
    want = {(i, int(j)) for i in range(20) for j in np.lexsort((np.arange(400), d[i]))[:4]}
    for table in (items, few):
        rows = search.search_many(table, queries, 4, digits=9, normalize=True).collect()
        assert {(r.query_id, int(r.vec_id[1:])) for r in rows} == want and len(rows) == 80


def test_counts_are_those_of_the_vector(spark):
    rows = spark.createDataFrame([("A b a, 12",), (None,), ("",), ("é",), ("x y x",)], "t string").coalesce(1)
    for r in rows.select(vectors.text_vector("t").alias("v"), vectors.text_counts("t").alias("n")).collect():
        assert (r.v is None) == (r.n is None)
        assert r.v is None or np.allclose(r.v, np.array(r.n) / np.linalg.norm(r.n))


def test_steps_leave_no_shuffle_files(spark):
    from chronodex.session import discard, materialize

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = blocks.shuffleStatuses().size()
    df = materialize(spark.range(1000).repartition(3, "id"), "test-step")
    assert blocks.shuffleStatuses().size() <= before and df.count() == 1000
    discard(df)
    with pytest.raises(AnalysisException):
        spark.read.parquet(*df.inputFiles()).count()
