"""Searches for all queries against brute force."""

from pathlib import Path

import numpy as np
import pytest

from chronodex.functions import scoring
from chronodex.operators import search
from chronodex.plans import registry, search_queries


@pytest.fixture(scope="module")
def data():
    """The smallest folder has no usable vector whose id is divisible by 100."""
    if not (path := Path("/root/testdata/sf0.01")).exists():
        pytest.skip("no test tables here")
    return str(path)


@pytest.fixture(scope="module")
def stored(spark, data):
    return {r.vec_id: r for r in search_queries.collection(spark, data).collect()}


def distances(stored, q, keep=lambda r: True):
    v = np.array(stored[q].embedding, float)
    return sorted((float(np.sqrt(((np.array(r.embedding, float) - v) ** 2).sum())), i) for i, r in stored.items() if keep(r))


def by_query(rows, value):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((getattr(r, value), r.vec_id))
    return out


def same(got, want):
    assert len(got) == len(want)
    for (a, i), (b, j) in zip(got, want):
        assert i == j and a == pytest.approx(b, abs=2e-6)


def test_all_queries_meet_the_vectors_of_both_tables(spark, data, stored, monkeypatch):
    monkeypatch.setattr(search, "ITEM_BLOCK", 70)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    run = lambda name: registry.queries()[name](spark, data).collect()
    queries = {i for i in stored if i % 100 == 0}
    cached = {r.vec_id for r in search_queries.items(spark, data).collect()}
    assert queries and set(stored) - cached
    got = by_query(run("knn_topk_all"), "distance")
    assert set(got) == queries
    files = by_query(run("knn_filtered_all"), "distance")
    for q in queries:
        same(sorted(got[q]), distances(stored, q)[:10])
        same(sorted(files[q]), distances(stored, q, lambda r: r.content_type == "File")[:10])
    assert len(run("similarity_score_all")) == len(queries) * len(stored)
    for q, rows in by_query(run("knn_cosine_all"), "cosine").items():
        unit = lambda i: np.array(stored[i].embedding, float) / np.linalg.norm(np.array(stored[i].embedding, float))
        same(sorted((-c, i) for c, i in rows), sorted((-float(unit(i) @ unit(q)), i) for i in stored)[:10])
    quota = run("search_mixed_quota_all")
    for q in queries:
        for section, n in (("Symbol", 6), ("File", 4)):
            same(sorted((r.distance, r.vec_id) for r in quota if r.query_id == q and r.section == section), distances(stored, q, lambda r: r.content_type == section)[:n])


def test_rerank_of_all_queries(spark, data, stored):
    one = {(r.vec_id, r.age_days, r.confidence) for r in search_queries._scored(spark, data).select("vec_id", "age_days", "confidence").collect()}
    facts = {i: (age, level) for i, age, level in one}
    rows = registry.queries()["search_rerank_all"](spark, data).collect()
    for q in {i for i in stored if i % 100 == 0}:
        want = []
        for d, i in distances(stored, q):
            if i in facts and facts[i][1] is not None:
                age, level = facts[i]
                want.append((-np.exp(-0.05 * max(age, 0)) * scoring.LEVEL_WEIGHT[level] / (1 + d), i))
        same(sorted((-r.final_score, r.vec_id) for r in rows if r.query_id == q), sorted(want)[:10])
