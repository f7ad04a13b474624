"""Problem 4: the k most similar vectors of every vector, by an inverted multi-index.

Each half of a vector is quantised by its own codebook; a pair of codes is a cell. A query walks the
cells in the order of the summed distances of its two halves to the two centroids, with a heap, until
the cells it has seen hold enough entries, and ranks all entries of those cells exactly.

Cells are put into groups by the code of the first half. Groups, and the queries that visit them, are
cut into blocks of bounded size, so no task holds more than a block of each however skewed the cells
are. Groups are taken in turns that move about twice as many vectors as there are, and the files of a turn go
before the next, so the disk needed is in proportion to the input however many groups a query visits.
Equal vectors are indexed once: copies never meet each other in a cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, materialize

DIMENSIONS = 96
#: The codebooks are fitted on at most so many vectors, those with the least hash of their id.
SAMPLE = 20_000
#: Entries per cell on average; least and most codes per half.
PER_CELL, MIN_CODES, MAX_CODES = 16, 4, 1024
#: A query walks cells until they hold so many entries that this share of the true neighbours is among them,
#: as measured by exact search for so many queries; and at least so many.
RECALL, PROBES, LEAST_CANDIDATES = 0.95, 200, 300
#: Entries and queries per block.
BLOCK = 12_000
#: Rows with a vector that are moved at once: so many, or so many times the vectors there are.
MOVED, MOVED_SHARE = 500_000, 2


def valid_vectors(tables: list[DataFrame], dimensions: int = DIMENSIONS) -> DataFrame:
    """``vec_id`` and ``embedding``, one row per id, of all usable vectors of the tables.

    Null ids, and vectors that are null, of another length, all zero or with a null, NaN or infinite
    number are left out. If the rows of an id differ, the least usable vector counts.
    """
    rows = None
    for t in tables:
        part = t.select("vec_id", "embedding")
        rows = part if rows is None else rows.unionByName(part)
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    usable = rows.filter(F.col("vec_id").isNotNull() & (F.size("embedding") == dimensions) & fine & F.exists("embedding", lambda x: x != 0))
    return usable.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def unit(rows) -> np.ndarray:
    """Vectors of length 1, in double precision."""
    m = np.stack([np.asarray(r, np.float64) for r in rows])
    m = m / np.abs(m).max(1, keepdims=True)  # no overflow for very large numbers
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        code = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, code, x)
        n = np.bincount(code, minlength=k)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():  # a centre without vectors moves to a random one
            centers[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None]


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 8192], centers).argmin(1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


def walk(d1: np.ndarray, d2: np.ndarray, count: np.ndarray, enough: int) -> list[int]:
    """Cells that hold entries, by rising summed distance, until ``enough`` entries are in them.

    ``d1`` and ``d2`` are a query's distances to the codes of each half. The heap holds the border of
    the cells seen so far in the grid of codes sorted by distance (multi-sequence algorithm).
    """
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    a, b, k1, k2 = o1.tolist(), o2.tolist(), len(o1), len(o2)
    heap, out, seen = [(s1[0] + s2[0], 0, 0)], [], 0
    row = [0] * k1  # next column of each row; a cell enters the heap once both neighbours are out
    while heap and seen < enough:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * k2 + b[j]
        n = count[cell]
        if n:
            out.append(cell)
            seen += n
        row[i] = j + 1
        if i + 1 < k1 and row[i + 1] == j:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
        if j + 1 < k2 and (i == 0 or row[i - 1] > j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
    return out


def nearest_exactly(entries: DataFrame, probes: pd.DataFrame, k: int) -> pd.DataFrame:
    """``query`` (row of ``probes``), ``cell`` and ``similarity`` of the k entries most similar to each probe.

    Every task keeps the k best of its entries, and these are merged; the probe itself is left out.
    """
    shared = entries.sparkSession.sparkContext.broadcast((probes.vec_id.to_numpy(), unit(probes.embedding)))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        top = [np.zeros((0, 2)) for _ in ids]
        for pdf in batches:
            if not len(pdf):
                continue
            s = q @ unit(pdf.embedding).T
            s[ids[:, None] == pdf.vec_id.to_numpy()[None]] = -9
            cells = pdf.cell.to_numpy()
            for i in range(len(ids)):
                at = np.argpartition(s[i], -k)[-k:] if len(cells) > k else np.arange(len(cells))
                both = np.concatenate([top[i], np.stack([s[i][at], cells[at]], 1)])
                top[i] = both[np.argsort(-both[:, 0], kind="stable")[:k]]
        rows = [(i, int(c), float(x)) for i, t in enumerate(top) for x, c in t if x > -2]
        yield pd.DataFrame(rows, columns=["query", "cell", "similarity"])

    found = entries.select("vec_id", "embedding", "cell").mapInPandas(best, "query int, cell int, similarity double")
    among = Window.partitionBy("query").orderBy(F.desc("similarity"), "cell")
    return found.withColumn("place", F.row_number().over(among)).filter(F.col("place") <= k).drop("place").toPandas()


def enough(probes: pd.DataFrame, true: pd.DataFrame, books: tuple[np.ndarray, np.ndarray], count: np.ndarray, at_least: float) -> int:
    """How many entries a query has to see so that ``RECALL`` of the true neighbours are among them.

    For each probe and true neighbour: the entries in all cells that are no farther than the neighbour's.
    """
    true = true[true.similarity >= at_least]
    if not len(true):
        return LEAST_CANDIDATES
    x = unit(probes.embedding)
    half = x.shape[1] // 2
    d1, d2 = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
    seen = []
    for q, cells in true.groupby("query").cell:
        d = (d1[q][:, None] + d2[q][None]).ravel()
        seen += [int(count[d <= d[c]].sum()) for c in cells]
    return max(LEAST_CANDIDATES, int(np.quantile(seen, RECALL, method="higher")))


def similar(vectors: DataFrame, k: int = 5, at_least: float = -1.0, candidates: int | None = None, exact: bool = False) -> DataFrame:
    """``id``, ``other`` and ``similarity`` (cosine) of the k most similar others of every vector.

    ``vectors`` has ``vec_id`` (unique) and ``embedding`` (usable, of one length). Every vector is
    indexed and every vector is a query; vectors found must be at least ``at_least`` similar. Equal
    similarities are ordered by id. Approximate: a neighbour is missed if its cell is not among those
    that the query walks. How far queries walk is measured on the data itself (:func:`enough`), so
    recall does not fall as the collection grows; ``candidates`` sets it instead, and with ``exact`` every
    query sees every entry. Fewer than two vectors give an empty result.

    The codebooks are fitted on a bounded sample. What else goes to the driver is bounded by the
    number of cells (``MAX_CODES`` squared).
    """
    spark = vectors.sparkSession
    # equal vectors: two 64-bit hashes name a class; its least ids stand for it
    hashed = materialize(vectors.select("vec_id", "embedding", F.xxhash64(F.lit(1), "embedding").alias("h1"), F.xxhash64(F.lit(2), "embedding").alias("h2")), "knn-vectors")
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    firsts = hashed.select("h1", "h2", "vec_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
    classes = materialize(
        firsts.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("firsts")).select("h1", "h2", "rep", "firsts", F.size("firsts").alias("n")),
        "knn-classes",
    )
    named = classes.select(F.col("rep").alias("vec_id"))
    drawn = named.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    sample = hashed.select("vec_id", "embedding").join(F.broadcast(drawn), "vec_id", "left_semi").orderBy(F.xxhash64("vec_id"), "vec_id").toPandas()
    total = classes.count()
    if total < 2 and hashed.limit(2).count() < 2:
        return spark.createDataFrame([], f"id {dict(vectors.dtypes)['vec_id']}, other {dict(vectors.dtypes)['vec_id']}, similarity double")
    reps = hashed.select("vec_id", "embedding").join(named, "vec_id", "left_semi")
    fit_on = unit(sample.embedding)
    half = fit_on.shape[1] // 2
    codes = int(np.clip(round((total / PER_CELL) ** 0.5), MIN_CODES, MAX_CODES))
    book1, book2 = k_means(fit_on[:, :half], codes), k_means(fit_on[:, half:], codes)
    k2 = len(book2)
    # groups of neighbouring codes in both halves, of about a block of entries each: their number grows with the collection
    sides = max(1, int(np.ceil((total / BLOCK) ** 0.5)))
    group1, group2 = (nearest(b, k_means(b, sides)) if 1 < sides < len(b) else np.arange(len(b)) % sides for b in (book1, book2))
    books = spark.sparkContext.broadcast((book1, book2, group1 * sides, group2))
    id_type = dict(vectors.dtypes)["vec_id"]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b1, b2, g1, g2 = books.value
        for pdf in batches:
            if len(pdf):
                x = unit(pdf.embedding)
                c1, c2 = nearest(x[:, :half], b1), nearest(x[:, half:], b2)
                yield pd.DataFrame({"vec_id": pdf.vec_id, "embedding": pdf.embedding, "cell": (c1 * k2 + c2).astype("i4"), "group": (g1[c1] + g2[c2]).astype("i4")})

    entries = materialize(reps.mapInPandas(encode, f"vec_id {id_type}, embedding array<float>, cell int, group int"), "knn-entries")
    members = materialize(_members(hashed, classes), "knn-copies")
    discard(hashed)
    sizes = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()
    count = np.zeros(len(book1) * k2, np.int64)
    count[sizes.cell.to_numpy()] = sizes.n.to_numpy()
    if exact:
        candidates = total
    elif candidates is None:
        probes = sample.iloc[:PROBES].reset_index(drop=True)
        candidates = enough(probes, nearest_exactly(entries, probes, k), (book1, book2), count, at_least)
    cell_group = (group1[:, None] * sides + group2[None]).ravel()
    plan = spark.sparkContext.broadcast((count.tolist(), cell_group.astype("i4")))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b1, b2 = books.value[:2]
        cells, group_of = plan.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = unit(pdf.embedding)
            d1, d2 = distances(x[:, :half], b1), distances(x[:, half:], b2)
            rows = []
            for q in range(len(pdf)):
                cs = np.array(walk(d1[q], d2[q], cells, candidates), "i4")
                by = group_of[cs]
                order = by.argsort(kind="stable")
                g, first, n = np.unique(by[order], return_index=True, return_counts=True)
                rows.append((g, first.astype("i4") + 1, n.astype("i4"), cs[order]))
            groups, first, n, walked = map(list, zip(*rows))
            yield pdf.assign(groups=groups, first=first, n=n, cells=walked)

    # a row per query with the cells it visits, those of each group together
    visits = materialize(entries.mapInPandas(visit, f"vec_id {id_type}, embedding array<float>, cell int, group int, groups array<int>, first array<int>, n array<int>, cells array<int>"), "knn-visits")
    discard(entries)
    # a group whose entries or visits are many is cut into blocks; each block of entries meets each block of visits
    n_groups = sides * sides
    n_entries = np.bincount(cell_group, count, n_groups)
    n_visits = np.zeros(n_groups)
    seen = visits.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("n")).toPandas()
    n_visits[seen.group.to_numpy()] = seen.n.to_numpy()
    e_blocks, q_blocks = np.ceil(n_entries / BLOCK), np.ceil(n_visits / (2 * BLOCK))
    moved = np.cumsum(n_entries * q_blocks + n_visits * e_blocks)
    turn = np.ceil(moved / max(MOVED, MOVED_SHARE * total)).astype(int)
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    keys = ["group", "eb", "qb"]
    among = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    nearest_k = lambda df: df.withColumn("place", F.row_number().over(among)).filter(F.col("place") <= k).drop("place")

    def rank(e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": pd.Series(dtype=e.vec_id.dtype), "other": pd.Series(dtype=e.vec_id.dtype), "similarity": pd.Series(dtype="f8")})
        if not len(e) or not len(q):
            return none
        e = e.sort_values("cell", kind="stable")
        x, ids = unit(e.embedding), e.vec_id.to_numpy()
        cells, first = np.unique(e.cell.to_numpy(), return_index=True)
        last = np.append(first[1:], len(e))
        queries, qid = unit(q.vector), q["query"].to_numpy()
        row = np.repeat(np.arange(len(q)), [len(c) for c in q.cells])
        cell = np.concatenate([np.asarray(c) for c in q.cells])
        by = np.argsort(cell, kind="stable")
        row, cell = row[by], cell[by]
        lo, hi = np.searchsorted(cell, cells, "left"), np.searchsorted(cell, cells, "right")
        rows, others, sims = [], [], []
        for c in range(len(cells)):
            r = row[lo[c] : hi[c]]
            if not len(r):
                continue
            part = x[first[c] : last[c]]
            for at in range(0, len(r), 4096):
                rr = r[at : at + 4096]
                s = queries[rr] @ part.T
                s[qid[rr][:, None] == ids[first[c] : last[c]][None]] = -9
                keep = s >= at_least if at_least > -1 else s > -2
                if s.shape[1] > 2 * k:  # no more than k of a cell can be among the k best (ties stay)
                    keep &= s >= np.partition(s, -k, axis=1)[:, -k][:, None]
                a, b = np.nonzero(keep)
                rows.append(rr[a])
                others.append(ids[first[c] : last[c]][b])
                sims.append(s[a, b])
        if not rows:
            return none
        rows, others, sims = np.concatenate(rows), np.concatenate(others), np.concatenate(sims)
        best = np.lexsort((others, -sims, rows))
        rows, others, sims = rows[best], others[best], sims[best]
        new = np.append(True, rows[1:] != rows[:-1]) if len(rows) else np.zeros(0, bool)
        place = np.arange(len(rows)) - np.repeat(np.nonzero(new)[0], np.diff(np.append(np.nonzero(new)[0], len(rows))))
        top = place < k
        return pd.DataFrame({"id": qid[rows[top]], "other": others[top], "similarity": sims[top]})

    found = None
    for t in np.unique(turn[(e_blocks > 0) & (q_blocks > 0)]):
        own = np.flatnonzero((turn == t) & (e_blocks > 0) & (q_blocks > 0))
        cuts = F.broadcast(spark.createDataFrame([(int(g), int(e_blocks[g]), int(q_blocks[g])) for g in own], "group int, e_blocks int, q_blocks int"))
        left = visits.select("vec_id", "embedding", "cell", "group").join(cuts, "group")
        left = left.withColumn("eb", F.pmod(F.xxhash64("vec_id"), F.col("e_blocks")).cast("int")).withColumn("qb", every("q_blocks")).drop("e_blocks", "q_blocks")
        here = F.filter(F.arrays_zip("groups", "first", "n"), lambda v: v["groups"].between(int(own[0]), int(own[-1])))  # noqa: B023
        # under other names, since both sides come from one table, which a cogroup would mix up
        right = visits.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"), "cells", F.explode(here).alias("v"))
        right = right.select("query", "vector", F.col("v.groups").alias("group"), F.slice("cells", F.col("v.first"), F.col("v.n")).alias("cells")).join(cuts, "group")
        right = right.withColumn("qb", F.pmod(F.xxhash64("query"), F.col("q_blocks")).cast("int")).withColumn("eb", every("e_blocks")).drop("e_blocks", "q_blocks")
        part = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rank, f"id {id_type}, other {id_type}, similarity double")
        part = materialize(part, "knn-found")
        found = part if found is None else found.unionByName(part)
    discard(visits)
    return _with_copies(nearest_k(found), members, classes, k)


def _members(hashed: DataFrame, classes: DataFrame) -> DataFrame:
    """``id``, ``rep``, ``firsts`` and ``n`` of the vectors that have copies."""
    twins = classes.filter("n > 1")
    return hashed.select("vec_id", "h1", "h2").join(twins, ["h1", "h2"]).select(F.col("vec_id").alias("id"), "rep", "firsts", "n")


def _with_copies(found: DataFrame, members: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Neighbours of every vector, from those of the vectors that stand for their copies.

    A copy's nearest are its other copies, the least ids first, then what its class' vector found, each
    found vector with its own copies. No pair of copies is made beyond the k that are asked for.
    """
    twins = classes.filter("n > 1")
    if not twins.take(1):
        return found
    within = members.select("id", F.explode("firsts").alias("other")).filter("id != other").withColumn("similarity", F.lit(1.0))
    # found vectors with their copies, then queries with theirs (classes of more than k copies need no others)
    firsts = twins.select(F.col("rep").alias("other"), F.col("firsts").alias("all"))
    wide = found.join(firsts, "other", "left").select("id", F.explode(F.coalesce("all", F.array("other"))).alias("other"), "similarity")
    few = members.filter(F.col("n") <= k).select(F.col("rep").alias("id"), F.col("id").alias("member"))
    many = twins.filter(F.col("n") > k).select(F.col("rep").alias("id"))
    across = wide.join(many, "id", "left_anti").join(few, "id", "left").select(F.coalesce("member", "id").alias("id"), "other", "similarity")
    among = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return within.unionByName(across).withColumn("place", F.row_number().over(among)).filter(F.col("place") <= k).drop("place")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_vectors([spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("embedding_data", "cache_entries")])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which one is among the other's five most similar, with a cosine of 0.8 or more."""
    near = similar(vectors(spark, sf_dir), k=5, at_least=0.8)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


P4_SQL = """
WITH r AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embedding_data UNION ALL SELECT vec_id, embedding::DOUBLE[] FROM cache_entries),
v AS (SELECT vec_id, min(e) AS e FROM r WHERE vec_id IS NOT NULL AND len(e) = 96
  AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id),
t AS (SELECT * FROM s WHERE c >= 0.8 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM t
"""
