import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronodex.functions import chunking, scoring, text, vectors
from chronodex.sources.timerange import parse_time, time_range


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(v, kind="array<double>"):
    return F.lit(None).cast(kind) if v is None else F.array(*[F.lit(float(x)) for x in v]) if v else F.array().cast(kind)


def test_vectors(spark):
    r = one(spark, d=vectors.l2_distance(lit([0, 0]), lit([3, 4])), e=vectors.l2_distance(lit([1]), lit([1, 2])), n=vectors.norm(lit([3, 4])), z=vectors.normalize(lit([0, 0])), u=vectors.normalize(lit([0, 2])), c=vectors.cosine(lit([1, 0]), lit([0, 0])), s=vectors.similarity(F.lit(1.0)), x=vectors.l2_distance(lit(None), lit([1])))
    assert (r.d, r.n, r.z, r.u, r.c, r.s, r.x) == (5.0, 5.0, [0.0, 0.0], [0.0, 1.0], None, 0.5, None) and math.isinf(r.e)


@pytest.mark.parametrize("v, fine", [([1.0], True), ([], False), (None, False), ([0.0], False), ([float("nan")], False), ([float("inf")], False)])
def test_usable(spark, v, fine):
    assert one(spark, u=vectors.usable(lit(v))).u is fine


def test_scoring_levels_and_decay(spark):
    rows = [("File", 0, True, "Highest"), ("File", 0, False, "Low"), ("Symbol", 400, None, "Highest"), ("Commit", 10, None, "High"), ("Session", 5, None, "Medium"), ("Session", 15, None, "Low"), ("Message", 40, None, "Lowest"), ("Other", 1, None, None)]
    df = spark.createDataFrame(rows, "t string, age int, cur boolean, want string")
    for r in df.withColumn("got", scoring.confidence_level(F.col("t"), F.col("age"), F.col("cur"))).collect():
        assert r.got == r.want
    r = one(spark, old=scoring.final_score(F.lit(0.95), F.lit(100), F.lit(0.85)), new=scoring.final_score(F.lit(0.70), F.lit(0), F.lit(0.85)), future=scoring.decay(F.lit(-5)))
    assert r.new > r.old and r.future == 1.0


def test_ages(spark):
    now = F.lit("2024-02-01 12:00:00").cast("timestamp")
    df = spark.createDataFrame([("2024-02-01 11:59:30", 0, "Current"), ("2024-01-31 12:00:00", 1, "1 days ago"), ("2023-12-03 12:00:00", 60, "2 months ago"), ("2024-02-03 13:00:00", -2, "-48 hours ago"), ("1970-01-01 00:00:00", 0, "Current"), (None, 0, "Current")], "ts string, days long, label string")
    age = scoring.age_days(F.col("ts").cast("timestamp"), now)
    for r in df.withColumn("a", age).withColumn("t", scoring.age_text_days(age)).collect():
        assert (r.a, r.t) == (r.days, r.label)
    r = one(spark, a=scoring.age_text_long(F.lit(3600)), b=scoring.age_text_long(F.lit(8 * 86400)), c=scoring.age_text_short(F.lit(59)), d=scoring.age_text_short(F.lit(7200)))
    assert tuple(r) == ("1 hour ago", "1 week ago", "just now", "2h ago")


@pytest.mark.parametrize("message, kind, scope, breaking, topic", [("feat: add feature", "feat", None, False, "feat"), ("feat(api)!: breaking change", "feat", "api", True, "api"), ("random message", None, None, False, "random"), ("fix: x\n\nBREAKING CHANGE: all", "fix", None, True, "fix"), ("", None, None, False, "general"), (": x", None, None, False, "general")])
def test_commits(spark, message, kind, scope, breaking, topic):
    m = F.lit(message)
    r = one(spark, k=text.commit_type(m), s=text.commit_scope(m), b=text.is_breaking(m), t=text.topic(m))
    assert tuple(r) == (kind, scope, breaking, topic)


def test_texts(spark):
    r = one(spark, long=text.truncate(F.lit("é" * 300)), short=text.truncate(F.lit("x" * 500)), p=text.encode_project_path(F.lit("/home/u/a-b")), k=text.file_kind(F.lit("a/b.MD")), l=text.language(F.lit("x.tsx")), none=text.language(F.lit("Makefile")), plus=text.changed_lines(F.lit("+++ b\n+a\n-c\n+d"), "+"), lines=text.lines(F.lit("a\r\nb\rc\n")))
    assert tuple(r) == ("é" * 300 + "...", "x" * 500, "-home-u-a_b", "Docs", "typescript", None, 2, ["a", "b", "c"])


@pytest.mark.parametrize("n", [1, 99, 100, 101, 190, 191, 250])
def test_line_windows(spark, n):
    lines = [f"l{i}" for i in range(1, n + 1)]
    got = one(spark, w=chunking.line_windows(F.lit("\n".join(lines) + "\n"))).w
    want, at = [], 0
    while True:
        want.append((at + 1, min(at + 100, n), "\n".join(lines[at : at + 100])))
        if at + 100 >= n:
            break
        at += 90
    assert [tuple(x) for x in got] == want


def test_line_windows_of_nothing(spark):
    r = one(spark, a=chunking.line_windows(F.lit("")), b=chunking.line_windows(F.lit(None).cast("string")), c=chunking.line_windows(F.lit("\n")))
    assert (r.a, r.b) == ([], []) and len(r.c) == 1


def pack(s, limit=500):
    out, cur = [], ""
    for p in [p.strip() for p in s.strip().split("\n\n") if p.strip()]:
        if not cur:
            cur = p
        elif len(cur.encode()) + len(p.encode()) + 2 <= limit:
            cur += "\n\n" + p
        else:
            out.append(cur)
            cur = p
    return out + [cur] if cur else out


@pytest.mark.parametrize("s", ["", " \n ", "a", "a\n\nb\n\nc", "x" * 700 + "\n\nshort", "\n\n".join(["p" * 200] * 7), "\n\n".join(["é" * 120] * 5)])
def test_paragraphs_as_by_hand(spark, s):
    assert one(spark, p=chunking.paragraphs(F.lit(s))).p == pack(s)


def test_paragraphs_of_null(spark):
    assert one(spark, p=chunking.paragraphs(F.lit(None).cast("string"))).p == []


def test_diff_files_and_symbols(spark):
    d = "diff --git a/x b/x\n+1\ndiff --git a/y b/y\n-2\n"
    r = one(spark, two=chunking.diff_files(F.lit(d)), one_=chunking.diff_files(F.lit("no header")), none=chunking.diff_files(F.lit("  ")), cut=chunking.symbol_text(F.lit("x" * 2000)), keep=chunking.symbol_text(F.lit("x")))
    assert [len(r.two), r.one_, r.none, r.keep] == [2, ["no header"], [], "x"] and "truncated: 2000" in r.cut


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\né", max_size=1500))
def test_message_chunks_cover_the_text(s):
    chunks = chunking.message_chunks(s)
    assert bool(chunks) == bool(s.strip())
    joined, at = s.strip(), 0
    for c in chunks:
        found = joined.find(c, max(0, at - chunking.OVERLAP - 60))
        assert found >= 0 and not joined[at:found].strip()
        at = max(at, found + len(c))
    assert not joined[at:].strip()


def test_message_chunks_sizes():
    s = "First sentence here. Second sentence follows! " * 20
    chunks = chunking.message_chunks(s)
    assert len(chunks) > 1 and all(len(c) <= 650 for c in chunks)
    assert chunking.message_chunks("x" * 900) == ["x" * 900]
    assert chunking.message_chunks(None) == [] == chunking.message_chunks("  ")


def test_markdown():
    rows = chunking.markdown_chunks("Main Title\n===\n\nSub Title\n---\n\ntext one\ntext two\n\n```rust\nfn a() {}\n```\n# Other\n> quoted")
    assert [(r[0], r[1]) for r in rows] == [("Header", "Main Title"), ("Header", "Sub Title"), ("Paragraph", "text one\ntext two"), ("CodeBlock", "fn a() {}"), ("Header", "Other"), ("Paragraph", "quoted")]
    assert rows[2][3] == ["Main Title", "Sub Title"] and rows[5][3] == ["Other"]
    assert chunking.markdown_chunks(None) == [] and chunking.markdown_chunks("```\nopen")[0][:2] == ("CodeBlock", "open")


def test_symbol_blocks():
    assert chunking.symbol_blocks("a\nb", 10) == [(0, 10, 11, "a\nb")]
    big = chunking.symbol_blocks("\n".join(f"line {i}" for i in range(602)), 1)
    assert len(big) > 1 and big[0][3].startswith("line 0") and big[1][1] == 91 and big[-1][2] == 602
    assert chunking.symbol_blocks(None, None) == []


NOW = dt.datetime(2024, 2, 1, 12)


def test_time_ranges():
    assert parse_time("7d", NOW) == NOW - dt.timedelta(days=7) and parse_time("2W", NOW) == NOW - dt.timedelta(days=14)
    assert parse_time("2024-01-05", NOW) == dt.datetime(2024, 1, 5)
    for bad in ("0d", "7", "x", "2024-13-01", ""):
        with pytest.raises(ValueError):
            parse_time(bad, NOW)
    assert time_range(NOW, after="2024-01-01", max_age="1d")[0] == dt.datetime(2024, 1, 1)
    with pytest.raises(ValueError):
        time_range(NOW, after="2024-01-05", before="2024-01-05")


def test_other_formats(spark):
    rst = chunking.rst_chunks("Title\n=====\n\ntext\nmore\n\nSub\n---\nx\n\nNext\n====\n")
    assert [(r[0], r[1], r[2]) for r in rst] == [("Header", "Title", 1), ("Paragraph", "text more", None), ("Header", "Sub", 2), ("Paragraph", "x", None), ("Header", "Next", 1)] and rst[3][3] == ["Title", "Sub"]
    adoc = chunking.asciidoc_chunks("= Main\n\n== Part\ntext\n\n----\ncode\n----\n----\nopen")
    assert [(r[0], r[1]) for r in adoc] == [("Header", "Main"), ("Header", "Part"), ("Paragraph", "text"), ("CodeBlock", "code"), ("CodeBlock", "open")]
    assert chunking.rst_chunks(None) == [] == chunking.asciidoc_chunks("")
    df = spark.createDataFrame([("# a", "md"), ("= a", "adoc"), ("x", "exe"), (None, "md"), (None, None)], "t string, e string")
    assert [len(r.c) for r in df.select(chunking.chunk_document("t", "e").alias("c")).collect()] == [1, 1, 1, 0, 0]
    r = one(spark, p=chunking.plain_paragraphs(F.lit("a\n b\n\n\n c \r\n\r\n")), n=chunking.plain_paragraphs(F.lit(None).cast("string")))
    assert (r.p, r.n) == (["a b", "c"], [])


@pytest.mark.parametrize("s, want", [("**bold** and *it* `code` [text](url) ![alt](u)", "bold and it code text alt"), (r"\*kept\* 2 * 3 * 4", "*kept* 2 * 3 * 4"), ("open ** mark", "open ** mark"), ("snake_case_name", "snake_case_name"), (None, ""), ("__b__ _i_", "b i")])
def test_inline_marks(s, want):
    assert chunking.clean_inline(s) == want


def test_markdown_as_a_line():
    assert chunking.clean_markdown("- **a**\n\n> b\n* c") == "a b c"
