import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronodex.llm import tokenize as t


@pytest.fixture(scope="module")
def mine():
    return t.BacktrackingBpe(t.load_vocabulary(t.DEFAULT_VOCABULARY))


@pytest.fixture(scope="module")
def theirs():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(t.DEFAULT_VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=t.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abcdeth ing-=_01\n é中🙂'", max_size=120)))
def test_equals_the_public_encoder_and_round_trips(mine, theirs, s):
    s = s.encode("utf-8", "ignore").decode()
    assert mine.encode(s) == theirs.encode_ordinary(s)
    assert mine.decode(mine.encode(s)) == s


@pytest.mark.parametrize("s", ["<|endoftext|>", "a" * 50_000, "ab" * 20_000, " " * 5000, "\r\n\t", "don't we'll they'RE", "한국어 שלום ǅ", "-=" * 3000])
def test_special_and_long_texts(mine, theirs, s):
    assert mine.encode(s) == theirs.encode_ordinary(s)


def test_frame(spark):
    df = spark.createDataFrame([(1, "hello world", 9), (2, "", 9), (3, None, 9), (1, "hello world", 9)], "doc_id long, text string, ids int")
    got = t.encode(df)
    assert [(r.doc_id, r.ids) for r in got.orderBy("doc_id").collect()] == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert [r.text for r in t.decode(got).orderBy("doc_id").collect()] == ["hello world", "hello world", "", ""]


def test_refuses_huge_vocabularies(tmp_path, monkeypatch):
    monkeypatch.setattr(t, "MAX_VOCABULARY_BYTES", 3)
    (tmp_path / "v").write_bytes(b"IQ== 0\n")
    with pytest.raises(ValueError):
        t.load_vocabulary(str(tmp_path / "v"))
