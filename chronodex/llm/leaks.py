"""Problem 8: evaluation items that leaked into a corpus, whole or in part, possibly edited.

Windows of words are embedded by CGK random walks, which turn edit distance into Hamming distance:
a walk reads a window word by word, and whether it moves on depends on a random function of the step
and the word, so two windows with one edit soon run in step again. Repeated samples of the walks'
positions are the keys of an LSH. A window is as long as fits into the shortest passage of an item that
counts (12 words for most, fewer for short items); the items' windows are kept at every position. Matches
are then verified by an exact banded alignment of the document with the item.
"""

from __future__ import annotations

import html
import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: CGK steps per word of a window.
STRETCH = 3
#: Random walks, and samples taken from each.
WALKS, SAMPLES = 3, 8
#: Least share of an item's words that a passage holds, and of equal words (and of their weight) in it.
SHARE, IDENTITY, WEIGHT = 1 / 3, 0.68, 0.7
#: A passage has at least so many words, or the whole item if that is shorter.
LEAST = 5
#: Least share of an item window's weight that a window with a common key has equal, to be aligned at all.
WINDOW_WEIGHT = 0.6
#: Items are broadcast in blocks of at most so many words; the size of the blocks changes no result.
BLOCK_WORDS = 200_000
#: Documents are looked at together up to so many words, which bounds a task's memory however long they are.
WORDS_AT_ONCE = 300_000

_APOSTROPHE = re.compile(r"['’‘`´]")
_MARKUP = re.compile(r"<[^<>\n]{1,80}>|\\[nrt\"']|&\w{2,8};")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words in lower case; punctuation, markup, escapes and apostrophes inside words are left out."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "\\" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(_APOSTROPHE.sub("", text).lower())


class WordHashes(dict):
    """32-bit hash of each word, never 0; remembers a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word) or 1
        return h


def hashes(ws: list[str], memory: WordHashes) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, ws), np.uint32, len(ws))


def least_words(m: int) -> int:
    """Words that a passage of an item of ``m`` words has at least."""
    return max(math.ceil(SHARE * m), min(LEAST, m))


class Walks:
    """CGK walks over windows of one length, and the positions that are sampled from them."""

    def __init__(self, window: int):
        rng = np.random.default_rng(11)
        self.window, self.steps, self.positions = window, window * STRETCH, max(1, window // 2)
        #: windows of a document begin at every ``stride``-th word: the shortest passage holds an aligned one
        self.stride = 4 if window == 12 else 1
        #: pairs of neighbours that a window shares with the items even if a third of its words is altered
        self.pairs = max(0, window - 1 - 2 * (window // 3))
        self.move = rng.integers(1, 1 << 32, (WALKS, self.steps), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.pick = [[np.sort(rng.choice(self.steps, self.positions, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)]
        self.mix = rng.integers(1, 1 << 63, (WALKS, SAMPLES, self.positions), dtype=np.uint64) | np.uint64(1)

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """Keys (windows x WALKS*SAMPLES) of windows of word hashes (n x window, uint32)."""
        n = len(windows)
        out = np.empty((n, WALKS * SAMPLES), np.uint64)
        padded = np.concatenate([windows, np.zeros((n, 1), np.uint32)], 1)  # 0: past the end
        rows = np.arange(n)
        for walk in range(WALKS):
            at = np.zeros(n, np.int64)
            read = np.empty((self.steps, n), np.uint32)
            for step in range(self.steps):
                w = padded[rows, at]
                read[step] = w
                at += ((w * self.move[walk, step]) >> np.uint32(31)).astype(np.int64) & (at < self.window)
            for s in range(SAMPLES):
                key = np.full(n, walk * SAMPLES + s + 1, np.uint64)
                for p, mix in zip(self.pick[walk][s], self.mix[walk, s]):
                    key = (key ^ read[p].astype(np.uint64)) * mix
                    key ^= key >> np.uint64(29)
                out[:, walk * SAMPLES + s] = key
        return out


def window_of(m: int) -> int:
    """Window length for an item of ``m`` words: the shortest passage holds one at a document's stride."""
    third = least_words(m)
    return 12 if third >= 15 else 6 if third >= 6 else min(3, m)


def _neighbours(h: np.ndarray) -> np.ndarray:
    """24-bit hash of each word and the one after it, along the last axis."""
    return (h[..., :-1] * np.uint32(2654435761) ^ h[..., 1:]) >> np.uint32(8)


class Windows:
    """The windows of one length of a block of items, by LSH key."""

    def __init__(self, window: int, items: list[tuple[int, np.ndarray, np.ndarray]]):
        """``items`` has number, hashed words and weights of each."""
        self.walks = Walks(window)
        mats, owner, start, weights = [], [], [], []
        for k, h, w in items:
            m = np.lib.stride_tricks.sliding_window_view(h, window)
            mats.append(m)
            owner += [k] * len(m)
            start += range(len(m))
            weights.append(np.lib.stride_tricks.sliding_window_view(w, window))
        self.windows, self.weights = np.concatenate(mats), np.concatenate(weights)
        self.owner, self.start = np.array(owner, np.int64), np.array(start, np.int64)
        keys = self.walks.keys(self.windows)
        flat, which = keys.ravel(), np.repeat(np.arange(len(keys)), keys.shape[1])
        order = np.argsort(flat, kind="stable")
        self.keys, self.which = flat[order], which[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.near = np.zeros(1 << 24, bool)
        if window > 1:
            self.near[_neighbours(self.windows).ravel()] = True

    def of(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of documents that have enough pairs of neighbours in common with the items, their documents and places.

        A window of which at most a third of the words is altered keeps so many pairs. The last window
        of a document ends with it.
        """
        w, step, need = self.walks.window, self.walks.stride, self.walks.pairs
        length = np.array([len(h) for h in docs], np.int64)
        if not len(length) or length.max() < w:
            return np.zeros((0, w), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        everything, first = np.concatenate(docs), np.cumsum(length) - length
        n = np.where(length >= w, -(-(length - w) // step) + 1, 0)
        owner = np.repeat(np.arange(len(docs)), n)
        start = np.minimum((np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step, length[owner] - w)
        at = first[owner] + start
        if need:
            known = np.concatenate([[0], np.cumsum(self.near[_neighbours(everything)])])
            keep = known[at + w - 1] - known[at] >= need
            owner, start, at = owner[keep], start[keep], at[keep]
        return np.lib.stride_tricks.sliding_window_view(everything, w)[at], owner, start

    def hits(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (row of ``windows``, item window) with a common key and enough weight in common."""
        keys = self.walks.keys(windows)
        row, col = np.nonzero(self.bits[(keys >> np.uint64(42)).astype(np.int64)])
        k = keys[row, col]
        lo, hi = np.searchsorted(self.keys, k, "left"), np.searchsorted(self.keys, k, "right")
        some = hi > lo
        row, lo, n = row[some], lo[some], (hi - lo)[some]
        if not len(row):
            return row, row
        left = np.repeat(row, n)
        right = self.which[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        pair = np.sort(left * len(self.windows) + right)
        pair = pair[np.append(True, pair[1:] != pair[:-1])]
        left, right = pair // len(self.windows), pair % len(self.windows)
        keep = np.zeros(len(left), bool)
        for at in range(0, len(left), 200_000):
            a, b = windows[left[at : at + 200_000]], self.windows[right[at : at + 200_000]]
            w = self.weights[right[at : at + 200_000]]
            common = (w * (a == b)).sum(1)
            for shift in range(1, min(3, self.walks.window)):
                common = np.maximum(common, (w[:, shift:] * (a[:, :-shift] == b[:, shift:])).sum(1))
                common = np.maximum(common, (w[:, :-shift] * (a[:, shift:] == b[:, :-shift])).sum(1))
            keep[at : at + 200_000] = common >= WINDOW_WEIGHT * w.sum(1)
        return left[keep], right[keep]


class ItemIndex:
    """A block of items: hashed words, their weights, and windows by length and LSH key."""

    def __init__(self, items: list[tuple[int, list[int], list[float]]]):
        """``items`` has id, hashed words and weights of each; items without words are left out."""
        items = [x for x in items if len(x[1])]
        self.ids = [i for i, _, _ in items]
        self.hashed = [np.asarray(h, np.uint32) for _, h, _ in items]
        self.weights = [np.asarray(w, float) for _, _, w in items]
        by_window: dict[int, list] = defaultdict(list)
        for k, (h, w) in enumerate(zip(self.hashed, self.weights)):
            by_window[window_of(len(h))].append((k, h, w))
        self.windows = [Windows(w, part) for w, part in sorted(by_window.items())]


def word_weights(counts: dict[int, int], n_items: int, hashed: list[int]) -> list[float]:
    """What each word says about its item: those that many items have say little."""
    return [0.2 + math.log((n_items + 1) / counts[w]) for w in hashed]


_SCORE, _EQUAL, _PLACE = 1 << 42, 1 << 21, (1 << 21) - 1


def band_of(m: int) -> int:
    """How far an alignment may leave its diagonal: so many words may be put in or be missing."""
    return max(10, m // 6)


def passages(pairs: list[tuple[np.ndarray, np.ndarray, int]], band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignments: first and last item word, and number of equal words, for (document, item, diagonal).

    Equal words count 1; altered, added and missing ones cost 2. Cells farther than ``band`` from the
    diagonal (document position minus item position) are left out. All pairs are aligned at once, row by
    row; a cell holds score, equal words and first item word in one number, so the greater one is better.
    """
    n, longest, width = len(pairs), max(len(i) for _, i, _ in pairs), 2 * band + 1
    items = np.full((n, longest + 4 * band + 2), -2, np.int64)
    docs = np.full((n, longest + 2 * band + 1), -1, np.int64)
    for k, (doc, item, diagonal) in enumerate(pairs):
        items[k, 2 * band : 2 * band + len(item)] = item
        lo, hi = max(0, diagonal - band), min(len(doc), diagonal + len(item) + band + 1)
        if lo < hi:
            docs[k, lo - diagonal + band : hi - diagonal + band] = doc[lo:hi]
    cost = np.arange(width) * 2 * _SCORE
    prev = np.zeros((n, width), np.int64)
    best, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in range(docs.shape[1]):
        j = r - 2 * band + np.arange(width)  # item position of each cell
        equal = items[:, r : r + width] == docs[:, r : r + 1]
        go = np.where(prev > 0, prev, _PLACE - np.maximum(j, 0)) + _SCORE + _EQUAL
        cell = np.where(equal, go, np.where(prev >= 3 * _SCORE, prev - 2 * _SCORE, 0))
        up = np.zeros_like(prev)
        up[:, :-1] = np.where(prev[:, 1:] >= 3 * _SCORE, prev[:, 1:] - 2 * _SCORE, 0)
        cell = np.maximum(cell, up)
        along = np.maximum.accumulate(cell + cost, axis=1) - cost
        cell = np.where(along >= _SCORE, along, 0)
        top = cell.argmax(1)
        value = cell[np.arange(n), top]
        better = value > best
        best[better], last[better] = value[better], j[top[better]]
        prev = cell
    return _PLACE - (best & _PLACE), last, (best % _SCORE) >> 21


def worth_aligning(doc: np.ndarray, item: np.ndarray, weights: np.ndarray, diagonal: int) -> bool:
    """Whether an alignment near the diagonal can pass: an upper bound on the weight it can have equal.

    An item word counts if the document has it within the band of its place on the diagonal. Some run of
    at least as many words as the shortest passage must reach ``WEIGHT`` in such words.
    """
    m, band = len(item), band_of(len(item))
    near = np.zeros(m, bool)
    for shift in range(-band, band + 1):
        lo = diagonal + shift
        a, b = max(0, -lo), min(m, len(doc) - lo)
        if a < b:
            near[a:b] |= doc[lo + a : lo + b] == item[a:b]
    gain = np.concatenate([[0.0], np.cumsum(weights * near - WEIGHT * weights)])
    run = least_words(m)
    return bool((gain[run:] >= np.minimum.accumulate(gain[: m + 1 - run]) - 1e-9).any())


def found_in(docs: list[np.ndarray], index: ItemIndex) -> list[tuple[int, int]]:
    """(document, item) pairs of a batch for which the document holds a passage of the item."""
    diagonals: dict[tuple[int, int], dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for group in index.windows:
        windows, owner, start = group.of(docs)
        for at in range(0, len(windows), 50_000):
            left, right = group.hits(windows[at : at + 50_000])
            left = left + at
            for d, i, x in zip(owner[left].tolist(), group.owner[right].tolist(), (start[left] - group.start[right]).tolist()):
                diagonals[d, i][x] += 1
    # the likeliest diagonal of each pair first; others follow for pairs that it doesn't decide
    todo = {pair: [x for x, _ in sorted(where.items(), key=lambda v: (-v[1], v[0]))] for pair, where in diagonals.items()}
    tried: dict[tuple[int, int], list[int]] = defaultdict(list)
    out = []
    while todo:
        jobs: dict[int, list[tuple[tuple[int, int], int]]] = defaultdict(list)
        for pair in list(todo):
            d, i = pair
            band, seen, queue = band_of(len(index.hashed[i])), tried[pair], todo[pair]
            while queue:
                diagonal = queue.pop(0)
                if any(abs(diagonal - t) <= band // 2 for t in seen):
                    continue
                seen.append(diagonal)
                if worth_aligning(docs[d], index.hashed[i], index.weights[i], diagonal):
                    jobs[band].append((pair, diagonal))
                    break
            if not queue:
                del todo[pair]
        for band, part in jobs.items():
            for at in range(0, len(part), 256):
                some = part[at : at + 256]
                first, last, equal = passages([(docs[d], index.hashed[i], x) for (d, i), x in some], band)
                for ((d, i), x), a, b, e in zip(some, first.tolist(), last.tolist(), equal.tolist()):
                    span, item, weights = b - a + 1, index.hashed[i], index.weights[i]
                    if not e or span < least_words(len(item)) or e < IDENTITY * span:
                        continue
                    # weight of the equal words: those of the item's span that the document has at that place
                    near = np.isin(item[a : b + 1], docs[d][max(0, x + a - band) : x + b + band + 1])
                    if weights[a : b + 1][near].sum() >= WEIGHT * weights[a : b + 1].sum():
                        out.append((d, index.ids[i]))
                        todo.pop((d, i), None)
    return out


_indexes: dict[str, ItemIndex] = {}


def hashed_items(items: DataFrame) -> DataFrame:
    """``item_id``, ``hashed`` (words) and ``n`` (words) of each item that has a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = WordHashes()
        for pdf in batches:
            hs = [hashes(words(t), memory).astype(np.int64) for t in pdf.text]
            yield pd.DataFrame({"item_id": pdf.item_id, "hashed": pd.Series(hs, dtype=object), "n": [len(h) for h in hs]})

    kind = dict(items.dtypes)["item_id"]
    return items.select("item_id", "text").filter("text is not null").mapInPandas(run, f"item_id {kind}, hashed array<bigint>, n int").filter("n > 0")


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id`` for each document (doc_id, text) that holds a passage of an item (item_id, text).

    Every document is read whole, in every window; documents are independent, so nothing is shuffled.
    Items are broadcast in blocks of at most ``BLOCK_WORDS`` words, one pass over the documents per
    block; only the items go through the driver, a block at a time. Words are weighed by the number of
    all items that have them, so blocks of any size give the same result. A passage is at least a
    third of the item's words, and at least ``LEAST`` words or the whole item. Null and empty texts hold
    nothing; equal items (or documents) are reported each; other columns are ignored. Empty inputs give
    an empty result.
    """
    spark = docs.sparkSession
    known = materialize(hashed_items(items), "leak-items")
    size = known.agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("items")).first()
    blocks = max(1, math.ceil((size.words or 0) / BLOCK_WORDS * 1.3)) if (size.words or 0) > BLOCK_WORDS else 1
    held = known.select(F.explode(F.array_distinct("hashed")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("held"))
    out = None
    for block in range(blocks):
        part = known.filter(F.pmod(F.xxhash64("item_id", "hashed"), F.lit(blocks)) == block)
        mine = part.select("item_id", "hashed").collect()
        if blocks == 1:
            counts = Counter(w for r in mine for w in set(r.hashed))
        else:
            counts = {r.word: r.held for r in held.join(part.select(F.explode("hashed").alias("word")).distinct(), "word").collect()}
        shared = spark.sparkContext.broadcast([(r.item_id, r.hashed, word_weights(counts, size["items"], r.hashed)) for r in mine])

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            key = xxhash.xxh64_hexdigest(pickle.dumps(shared.value))
            if key not in _indexes:
                _indexes.clear()
                _indexes[key] = ItemIndex(shared.value)
            index, memory = _indexes[key], WordHashes()
            for pdf in batches:
                ids, found, hashed, first, size = pdf.doc_id.tolist(), [], [], 0, 0
                for n, text in enumerate(pdf.text, 1):
                    hashed.append(hashes(words(text), memory))
                    size += len(hashed[-1])
                    if size >= WORDS_AT_ONCE or n == len(ids):
                        found += [(ids[first + d], i) for d, i in found_in(hashed, index)]
                        hashed, first, size = [], n, 0
                yield pd.DataFrame(found, columns=["doc_id", "item_id"])

        types = {f.name: f.dataType.simpleString() for f in [*docs.schema, *items.schema]}
        step = docs.select("doc_id", "text").filter("text is not null").mapInPandas(run, f"doc_id {types['doc_id']}, item_id {types['item_id']}")
        out = step if out is None else out.unionByName(step)
    return out


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items that leaked into them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/eval_items.parquet").select("item_id", "text")).distinct()
