import numpy as np
import pytest

from chronodex.llm import neighbors as nb

SCHEMA = "vec_id long, embedding array<float>, extra string"


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v], "x") for i, v in enumerate(m)], SCHEMA)


def clusters(n, seed=1, dims=96):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // 12 + 1, dims))
    return (centers[rng.integers(0, len(centers), n)] + 0.35 * rng.normal(size=(n, dims))).astype("f4")


def brute(m, k):
    x = m.astype("f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {(i, int(j)) for i in range(len(m)) for j in np.lexsort((np.arange(len(m)), -s[i]))[:k]}


def test_recall_against_brute_force(spark):
    m = clusters(3000)
    got = {(r.id, r.other) for r in nb.similar(frame(spark, m).select("vec_id", "embedding"), 5).collect()}
    want = brute(m, 5)
    assert len(got & want) / len(want) >= 0.9 and len(got) == 15000


def test_blocks_give_the_same(spark, monkeypatch):
    m = clusters(500)
    whole = {(r.id, r.other) for r in nb.similar(frame(spark, m), 5, 0.3).collect()}
    monkeypatch.setattr(nb, "BLOCK", 60)
    assert {(r.id, r.other) for r in nb.similar(frame(spark, m), 5, 0.3).collect()} == whole


def test_copies_are_not_expanded(spark):
    m = clusters(60)
    m[20:50] = m[20]  # thirty equal vectors
    got = [tuple(r) for r in nb.similar(frame(spark, m), 5).collect()]
    by = {}
    for i, o, s in got:
        by.setdefault(i, []).append((o, s))
    assert all(len(v) == 5 for v in by.values()) and len(by) == 60
    assert {o for o, _ in by[20]} == {21, 22, 23, 24, 25} and {o for o, _ in by[49]} == {20, 21, 22, 23, 24}
    assert all(abs(s - 1) < 1e-9 for _, s in by[30])


def test_few_vectors(spark):
    assert nb.similar(frame(spark, clusters(1)), 5).count() == 0
    assert nb.similar(frame(spark, clusters(60)[:0]), 5).count() == 0
    same = np.ones((3, 96), "f4")
    assert {(r.id, r.other) for r in nb.similar(frame(spark, same), 5).collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert {(r.id, r.other) for r in nb.similar(frame(spark, clusters(2)), 5).collect()} == {(0, 1), (1, 0)}


def test_usable_vectors(spark):
    bad = [(1, None), (2, []), (3, [1.0] * 95), (4, [0.0] * 96), (5, [float("nan")] + [1.0] * 95), (6, [float("inf")] * 96), (7, [None] + [1.0] * 95), (None, [1.0] * 96), (8, [1.0] * 96), (8, [1.0] * 96), (9, [3e38] * 96)]
    t = spark.createDataFrame(bad, "vec_id long, embedding array<float>")
    assert {r.vec_id for r in nb.valid_vectors([t, t.limit(0)]).collect()} == {8, 9}
    assert np.isfinite(nb.unit([[3e38] * 96])).all()


@pytest.mark.parametrize("seed", range(20))
def test_walk_is_in_order_of_summed_distance(seed):
    rng = np.random.default_rng(seed)
    d1, d2 = rng.integers(0, 9, 6).astype(float), rng.integers(0, 9, 7).astype(float)
    count = rng.integers(0, 3, 42)
    cells = nb.walk(d1, d2, count.tolist(), 10_000)
    assert sorted(cells) == [c for c in range(42) if count[c]]
    sums = [d1[c // 7] + d2[c % 7] for c in cells]
    assert sums == sorted(sums)
    assert sum(count[c] for c in nb.walk(d1, d2, count.tolist(), 5)) >= min(5, count.sum())


def test_exact_mode_misses_nothing(spark, monkeypatch):
    m = np.random.default_rng(3).normal(size=(900, 96)).astype("f4")  # no clusters: the hardest case
    monkeypatch.setattr(nb, "BLOCK", 300)
    got = {(r.id, r.other) for r in nb.similar(frame(spark, m), 5, exact=True).collect()}
    assert got == brute(m, 5)


def test_candidates_follow_the_data(spark):
    """Vectors without clusters need longer walks than clustered ones; recall holds for both."""
    m = np.random.default_rng(4).normal(size=(4000, 96)).astype("f4")
    got, want = {(r.id, r.other) for r in nb.similar(frame(spark, m), 5).collect()}, brute(m, 5)
    assert len(got & want) / len(want) >= 0.9


def test_turns_give_the_same_and_leave_no_vectors(spark, monkeypatch):
    """The rows with vectors that are moved at once stay within the bound; what was moved is removed."""
    from pathlib import Path

    from chronodex.session import scratch_root

    m = clusters(700)
    m[20:50] = m[20]
    whole = {tuple(r) for r in nb.similar(frame(spark, m), 5).collect()}
    monkeypatch.setattr(nb, "BLOCK", 60)
    monkeypatch.setattr(nb, "MOVED", 1)
    monkeypatch.setattr(nb, "MOVED_SHARE", 1)
    steps, write = [], nb.materialize

    def count(df, name):
        steps.append(name)
        return write(df, name)

    monkeypatch.setattr(nb, "materialize", count)
    folder = Path(scratch_root(spark).removeprefix("file://")) / "chronodex"
    before = set(folder.iterdir())
    got = {tuple(r) for r in nb.similar(frame(spark, m), 5).collect()}
    assert {r[:2] for r in got} == {r[:2] for r in whole} and len(got) == 3500
    assert steps.count("knn-found") > 3
    left = {p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before}
    assert left == {"knn-classes", "knn-copies", "knn-found"}
