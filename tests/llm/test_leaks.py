import random

import pytest

from chronodex.llm import leaks

VOCABULARY = [f"w{i}" for i in range(400)]


def items(n=40, words=90, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(VOCABULARY) for _ in range(words))) for i in range(n)]


def docs_with(parts, seed=2, noise=150):
    rng = random.Random(seed)
    return [" ".join(rng.choice(VOCABULARY) for _ in range(noise)) + "\n" + p + "\n" + " ".join(rng.choice(VOCABULARY) for _ in range(noise)) for p in parts]


def alter(text, share, seed):
    rng = random.Random(seed)
    return " ".join("other" if rng.random() < share else w for w in text.split())


def run(spark, docs, its):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    return {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, spark.createDataFrame(its, "item_id long, text string")).collect()}


def test_whole_partial_altered_and_marked_passages(spark):
    its = items()
    parts = [its[0][1], " ".join(its[1][1].split()[30:65]), alter(its[2][1], 0.1, 3), its[3][1].upper().replace(" ", ", "), "> " + "\n> ".join(its[4][1].split()), "<p>" + its[5][1].replace(" ", " **") + "</p>", " ".join(w for i, w in enumerate(its[6][1].split()) if i % 17)]
    assert run(spark, docs_with(parts), its) == {(i, i) for i in range(7)}


def test_quotes_and_other_orders_are_no_leaks(spark):
    its = items()
    shuffled = its[1][1].split()
    random.Random(5).shuffle(shuffled)
    parts = [" ".join(its[0][1].split()[:18]), " ".join(shuffled), alter(its[2][1], 0.5, 4), ""]
    assert run(spark, docs_with(parts), its) == set()


def test_recall_of_the_walks_on_altered_thirds(spark):
    its = items(60, 90, 7)
    parts = [alter(" ".join(t.split()[20:58]), 0.12, i) for i, t in its]
    got = run(spark, docs_with(parts, 8), its)
    assert len(got & {(i, i) for i in range(60)}) >= 54 and all(d == i for d, i in got)


def test_edges(spark):
    its = items(3)
    assert run(spark, [], its) == set() == run(spark, docs_with([its[0][1]]), [])
    assert run(spark, [None, "", "one word"], [(1, None), (2, ""), (3, "short item")]) == set()
    assert run(spark, [its[0][1]] * 2, [(7, its[0][1]), (8, its[0][1])]) == {(0, 7), (1, 7), (0, 8), (1, 8)}
    long = " ".join(docs_with([its[1][1]], noise=30_000))
    assert run(spark, [long], its) == {(0, 1)}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    its = items(30)
    docs = docs_with([t for _, t in its[:10]])
    docs += docs_with([alter(t, 0.25, 3) for _, t in its[10:20]], 5)
    whole = run(spark, docs, its)
    assert {(i, i) for i in range(10)} <= whole
    for words in (500, 130):
        monkeypatch.setattr(leaks, "BLOCK_WORDS", words)
        assert run(spark, docs, its) == whole


def test_short_items(spark):
    """Whole items of 5 to 44 words are found wherever they stand, and so is half of those of 12 words and more."""
    its = [it for n in range(5, 45, 3) for it in [(n, items(1, n, n)[0][1])]]
    got = run(spark, docs_with([t for _, t in its]) + docs_with([" ".join(t.split()[: (n + 1) // 2]) for n, t in its], 4), its)
    assert got >= {(k, n) for k, (n, _) in enumerate(its)}
    assert got >= {(len(its) + k, n) for k, (n, _) in enumerate(its) if n >= 12}
    assert all(its[d % len(its)][0] == n for d, n in got)


@pytest.mark.parametrize("put_in, at", [(12, 45), (15, 50)])
def test_words_put_into_a_long_passage(put_in, at):
    import numpy as np

    item = np.arange(1, 101)
    doc = np.concatenate([item[:at], np.full(put_in, 7777), item[at:]])
    first, last, equal = leaks.passages([(doc, item, 0), (item, item, 0), (item[40:80], item, -40)], leaks.band_of(len(item)))
    assert last[0] - first[0] + 1 >= 50 and (first[1], last[1], equal[1]) == (0, 99, 100) and (first[2], last[2], equal[2]) == (40, 79, 40)


@pytest.mark.parametrize("text, want", [("Jo's <b>left-hand</b> &amp; **x**", ["jos", "left", "hand", "x"]), (None, []), ("", []), ("a\\nb", ["a", "b"])])
def test_words(text, want):
    assert leaks.words(text) == want
