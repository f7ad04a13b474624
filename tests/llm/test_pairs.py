import datetime as dt

import pytest

from chronodex.llm import lang, pairs

T0 = dt.datetime(2024, 1, 1)
ROW = "id string, session_id string, role string, content string, timestamp timestamp, extra string"


def rows(spark, *items):
    return spark.createDataFrame([(i, s, r, c, None if t is None else T0 + dt.timedelta(minutes=t), "x") for i, s, r, c, t in items], ROW)


def test_pairs_follow_the_rules(spark):
    df = rows(
        spark, ("u1", "s", "User", "q1", 0), ("y", "s", "system", "note", 1), ("a1", "s", "ai", "r1", 2), ("a2", "s", "assistant", "r2", 3), ("u2", "s", "human", "q2", 59), ("a3", "s", "assistant", "r3", 61),
        ("u3", "s", "user", "q3", 70), ("t", "s", "tool", "?", 71), ("a4", "s", "assistant", "r4", 72), ("u5", None, "user", "q", 1), ("a5", None, "assistant", "r", 2), ("u6", "", "user", "q", 1), ("a6", "", "assistant", "r", 2),
        ("u7", "z", "user", "q", None), ("a7", "z", "assistant", "r", 2),
    )
    assert {(r.id, r.prompt, r.reply) for r in pairs.response_pairs(df).collect()} == {("a1", "q1", "r1"), ("a3", "q2", "r3")}
    assert pairs.response_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("prompt, reply, copy", [
    ("Where is the queue implemented, and which tests cover it?", "Where is the queue implemented, and which tests cover it?", True), ("Where is the queue implemented, and which tests cover it?", "> where is the queue implemented and which tests cover it", True),
    ("Where is the queue implemented, and which tests cover it?", "You asked: Where is the queue implemented, and which tests cover it?", True), ("Where is the queue implemented, and which tests cover it?", "Where is the queue implemented, and which tests cover it?\n\nIn src/queue.rs; the tests are in tests/queue.rs.", False),
    ("Where is the queue implemented, and which tests cover it?", "It is in src/queue.rs.", False), ("怎样减小索引大小？", "怎样减小索引大小？", True), ("怎样减小索引大小？", "旧的代码块没有被删除。", False), ("", "text", False), ("Run it.", "Run it.\nRun it.", True),
])
def test_copies(prompt, reply, copy):
    assert pairs.is_copy(prompt, reply) is copy


@pytest.mark.parametrize("reply, cut", [
    ("It is done.", False), ("4711", False), ("Yes", False), ("It is done because the", True), ("```rust\nlet a = 1;", True), ("Text.\n\n```rust\nlet a = 1;\n```", False), ("Steps:\n\n1. One is here.\n2. Two is", True), ("Steps:\n\n1. One.\n2. ", True), ("完成了。", False), ("我们测得响应时间，搜索", True),
    ("Use `open_st", True), ("See src/git/walk.", True), ("See src/git/walk.rs.", False), ("| a | b |\n|---|---|\n| 1 | 2 |", False), ("Is it?", False), ("x" * 5000 + ".", False), ("word " * 2000, True),
])
def test_truncation(reply, cut):
    assert pairs.is_truncated(reply) is cut


@pytest.mark.parametrize("prompt, reply, other", [
    ("Why does the indexer sort the rows?", "Der Fehler kommt daher, dass der Pfad nicht normalisiert ist.", True), ("Please answer in German. The limit is 5.", "Der Fehler kommt daher, dass der Pfad nicht normalisiert ist.", False), ("Please answer in German. The limit is 5.", "La cache est vidée pour éviter les doublons.", True),
    ("为什么会返回空列表？", "The list is empty because the branch was switched.", True), ("Why does the indexer sort the rows?", "Done.", False), ("", "La cache est vidée pour éviter les doublons.", False), ("Why is `x` so slow in the loop?", "```sh\nrag index\n```", False),
])
def test_languages(prompt, reply, other):
    assert pairs.other_language(prompt, reply) is other


@pytest.mark.parametrize("s, want", [("The list is empty because of the branch.", "en"), ("La caché se vacía cada 4 minutos.", "es"), ("La cache est vidée pour éviter les doublons.", "fr"), ("Das ist nicht der Fehler.", "de"), ("缓存每分钟清空一次", "zh"), ("4711", None), ("", None)])
def test_language_of_a_sentence(s, want):
    assert lang.of_sentence(s) == want


def judged(spark, items):
    return {r.id: r.defect for r in pairs.find_defects(spark.createDataFrame(items, "id string, prompt string, reply string")).collect()}


def test_defects_end_to_end(spark):
    refusal = "I'm sorry, but I can't help with that because of the usage policy."
    items = [(f"r{i}", f"How can I sort the number {i} in file{i}.rs with {w}?", refusal + " I hope you understand.") for i, w in enumerate(["trees", "lists", "maps", "heaps", "sets"])]
    items += [
        ("rare", "What is it?", "My guidelines do not allow me to answer that."), ("fine", "Can you run it?", "I'm unable to run it here, so I traced read_tail by hand."), ("fine2", "Does it work?", "It won't work after an upgrade; use the lock instead."),
        ("part", "How?", refusal + " However, the lock in src/lock.rs does the same."), ("e1", "q", None), ("e2", "q", " \n"), ("e3", "q", "```\n```"), ("e4", None, "..."), ("n", None, "It is fine."), ("b", " ", "It is fine."), ("t", "q?", "It is fine because"),
    ]
    got = judged(spark, items)
    assert got == {**{f"r{i}": "refusal" for i in range(5)}, "rare": "refusal", "e1": "empty", "e2": "empty", "e3": "empty", "e4": "empty", "t": "truncated"}


SEEN = "opening string, prompt_hash long, related double, sign boolean"


def templates(seen):
    return {r.opening for r in pairs.refusal_clusters(seen, pairs.clusters_of(seen.select("opening").distinct())).filter("template").collect()}


def test_templates_need_unrelated_prompts(spark):
    seen = spark.createDataFrame([("i am sorry but i cannot help with that request", 1, 0.0, True)] * 50, SEEN)
    assert templates(seen) == set()  # one prompt, however often
    more = spark.createDataFrame([("i am sorry but i cannot help with that request", i, 0.0, True) for i in range(20)] + [("the list is sorted by name and then by age", i, 0.0, False) for i in range(20)], SEEN)
    assert templates(more) == {"i am sorry but i cannot help with that request"}


def test_similar_openings_share_a_cluster(spark):
    base = "i am very sorry but i really cannot help you with this kind of request because our usage policy does not allow it for anybody here"
    other = base + " today"
    assert pairs.jaccard(base, other) >= 0.8
    seen = spark.createDataFrame([(base, i, 0.0, True) for i in range(6)] + [(other, 77, 0.0, False)], SEEN)
    assert templates(seen) == {base, other}


def test_unlisted_refusals_are_told_by_what_follows_them(spark):
    closing = " Please bring me another topic whenever you like."
    items = [(f"k{i}", f"Why is {w} slow?", "I'm sorry, but I can't help with that." + closing) for i, w in enumerate(["sorting", "parsing", "merging"])]
    items += [(f"u{i}", f"Where do {w} end?", "Mi dispiace tanto ma questa cosa resta fuori portata." + closing) for i, w in enumerate(["rows", "pages", "threads"])]
    items += [(f"d{i}", f"Did {w} pass?", "All of the checks went through at once. Nothing is left over.") for i, w in enumerate(["tests", "builds", "scans"])]
    assert not pairs.declines(items[3][2])
    assert judged(spark, items) == {x: "refusal" for x in ("k0", "k1", "k2", "u0", "u1", "u2")}


def test_rare_openings_are_told_by_what_templates_teach(spark):
    related = [(f"r{i}", f"Can you not help with this request about {w}, so I can't continue?", "I can't help with this request.") for i, w in enumerate(["rows", "pages", "threads"])]
    assert judged(spark, related) == {}  # it recurs, but over prompts with the same words
    rare = ("x", "Why is it slow?", "Unfortunately, I can't help with that kind of question.")
    assert judged(spark, [rare]) == {}  # its words alone are no reason
    teach = [(f"k{i}", f"Why is {w} slow?", "I'm sorry, but I can't help with that.") for i, w in enumerate(["sorting", "parsing", "merging"])]
    teach += [(f"d{i}", f"Did {w} pass?", "All of the checks went through at once.") for i, w in enumerate(["tests", "builds", "scans"])]
    assert judged(spark, [*teach, rare]) == {x: "refusal" for x in ("k0", "k1", "k2", "x")}


def test_without_clusters_there_are_no_refusals(spark):
    from pathlib import Path

    from chronodex.session import materialize
    from chronodex.tables import messages

    sf = "/root/testdata/sf0.1"
    if not Path(sf).exists():
        pytest.skip("no test tables here")
    told = materialize(pairs.judged_pairs(pairs.response_pairs(messages(spark, sf, "session_id", "role", "content", "timestamp"))), "judged")
    paths = {r.path: r["count"] for r in pairs.find_refusals(told).groupBy("path").count().collect()}
    assert paths["template"] > 50 and paths["model"] > 50
    empty = spark.createDataFrame([], "opening string, head string")
    assert pairs.find_refusals(told, empty).count() == 0


def test_clusters_reach_along_chains(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[i : i + 40]) for i in range(0, 18, 3)]  # each is like the next one only
    assert pairs.jaccard(chain[0], chain[1]) >= 0.8 > pairs.jaccard(chain[0], chain[2])
    monkeypatch.setattr(pairs, "bands_of", lambda o: [1])
    monkeypatch.setattr(pairs, "BLOCK", 2)
    df = spark.createDataFrame([(o,) for o in [*chain, "quite another opening of more than five words"]], "opening string")
    assert {r.head for r in pairs.clusters_of(df).collect() if r.opening in chain} == {min(chain)}
