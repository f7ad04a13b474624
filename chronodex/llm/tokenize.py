"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary.

The encoder is the backtracking one: at each position take the longest vocabulary entry that
matches (found by walking an Aho-Corasick automaton's trie), accept it if it may stand after the
entry before it, and otherwise try the next shorter entry or step back. Whether two entries may
stand next to each other depends on the two alone and is kept in a compatibility table, so the
result equals that of applying all merges in rank order, in linear time.
Decoding joins slices of one byte string that an offset table points into.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the public pre-tokenisation pattern of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary file is sent to the executors whole; larger files are refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pieces that a worker remembers; the memory is emptied when full, which changes no result.
PIECE_MEMORY = 200_000


class BacktrackingBpe:
    """Encodes and decodes with the entries of one vocabulary (bytes and rank per line)."""

    def __init__(self, vocabulary: bytes):
        import ahocorasick

        entries = [line.split() for line in vocabulary.splitlines() if line.strip()]
        self.rank = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in entries}
        size = max(self.rank.values()) + 1
        self.text: list[str] = [""] * size
        for t, r in self.rank.items():
            self.text[r] = t
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, r in self.rank.items():
            self.automaton.add_word(t, r)
        self.pattern = regex.compile(PATTERN)
        self.reach = max(map(len, self.text))
        self.shorter: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        # decoding: all entries in one byte string, and where each begins
        self.offsets, blob, at = [0], bytearray(), 0
        for t in self.text:
            blob += t.encode("latin-1")
            at += len(t)
            self.offsets.append(at)
        self.blob = bytes(blob)

    def longest(self, s: str, at: int) -> int:
        """Rank of the longest entry that begins at ``at``."""
        n = self.automaton.longest_prefix(s[at : at + self.reach])
        rank = self.rank
        while n > 1:
            r = rank.get(s[at : at + n])
            if r is not None:
                return r
            n -= 1
        return rank[s[at]]

    def next_shorter(self, token: int) -> int:
        """Rank of the longest entry that is a proper prefix of ``token``; -1 if there is none."""
        r = self.shorter.get(token)
        if r is None:
            t, r = self.text[token], -1
            for n in range(len(t) - 1, 0, -1):
                if (x := self.rank.get(t[:n])) is not None:
                    r = x
                    break
            self.shorter[token] = r
        return r

    def split(self, token: int) -> tuple[int, int]:
        """The two entries whose merge made ``token``; a single byte gives itself twice."""
        p = self.parts.get(token)
        if p is None:
            t = self.text[token]
            if len(t) == 1:
                p = (token, token)
            else:
                pieces = [self.rank[c] for c in t]
                while len(pieces) > 2:
                    best, where = None, -1
                    for i in range(len(pieces) - 1):
                        r = self.rank.get(self.text[pieces[i]] + self.text[pieces[i + 1]])
                        if r is not None and r < token and (best is None or r < best):
                            best, where = r, i
                    pieces[where : where + 2] = [best]
                p = (pieces[0], pieces[1])
            self.parts[token] = p
        return p

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging in rank order can leave ``left`` and ``right`` side by side.

        Undoes the later of the two entries' last merges again and again: if at any depth the pair at
        the border would merge earlier than the step that hid it, the pair cannot stand.
        """
        key = (left, right)
        known = self.compatible.get(key)
        if known is not None:
            return known
        a, b, before, ok = left, right, len(self.text), True
        while True:
            merged = self.rank.get(self.text[a] + self.text[b])
            if merged is not None and merged < before:
                ok = False
                break
            # the border byte pair is reached when neither side can be undone any more
            a_parts, b_parts = self.split(a), self.split(b)
            if a > b and a_parts[1] != a:
                before, a = a, a_parts[1]
            elif b_parts[0] != b:
                before, b = b + 1, b_parts[0]
            elif a_parts[1] != a:
                before, a = a, a_parts[1]
            else:
                break
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def piece(self, s: str) -> list[int]:
        """Ids of one pre-token, given as a string of bytes (latin-1)."""
        r = self.rank.get(s)
        if r is not None:
            return [r]
        open_at = bytearray(b"\x01") * (len(s) + 1)  # 0: no encoding goes on from here
        out: list[int] = []
        at, token = 0, self.longest(s, 0)
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(self.text[token])
                if open_at[end] and (last < 0 or self.may_follow(last, token)):
                    break
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                if at == len(s):
                    return out
                token = self.longest(s, at)
            else:
                open_at[at] = 0
                token = out.pop()
                at -= len(self.text[token])

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty or a null text has none."""
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for p in self.pattern.findall(text):
            ids = known.get(p)
            if ids is None:
                if len(known) >= PIECE_MEMORY:
                    known.clear()
                ids = self.piece(p.encode("utf-8", "replace").decode("latin-1"))
                if len(p) <= 64:
                    known[p] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        o, b = self.offsets, self.blob
        return b"".join([b[o[i] : o[i + 1]] for i in ids]).decode("utf-8", "replace")


_encoders: dict[int, BacktrackingBpe] = {}


def _encoder(shared) -> BacktrackingBpe:
    """One encoder per worker process and vocabulary."""
    raw = shared.value
    key = hash(raw)
    if key not in _encoders:
        _encoders[key] = BacktrackingBpe(raw)
    return _encoders[key]


def load_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary {path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return raw


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Adds ``ids`` (array<int>): the token ids of ``text``, without special tokens.

    A null or empty text gives an empty list. Strings of special tokens are ordinary text. Texts of
    any length are encoded whole. Every row is independent: no shuffle; the vocabulary (under 1 MB,
    at most ``MAX_VOCABULARY_BYTES``) is broadcast. All other columns pass through; an existing
    column of the name ``ids`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared)
        for s in batches:
            yield pd.Series([encoder.encode(t) for t in s], dtype=object)

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Adds ``text``: the string that ``ids`` stand for; null or no ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared)
        for s in batches:
            yield pd.Series(["" if x is None else encoder.decode(x) for x in s], dtype=object)

    return df.withColumn(text, run(F.col(ids)))


def p7_ids(spark: SparkSession, sf_dir: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id and ids of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, vocabulary=vocabulary).select("doc_id", "ids")
