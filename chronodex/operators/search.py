"""Search over a vector table: exact nearest neighbours, reranking, quotas."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, vectors

#: Items, and queries, that meet in one group; smaller ones if all pairs are wanted.
ITEM_BLOCK, QUERY_BLOCK = 32_768, 4096
ALL_ITEM_BLOCK, ALL_QUERY_BLOCK = 4096, 256
#: Numbers of one matrix of scores.
SCORES = 4_000_000


def with_distance(items: DataFrame, query: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``distance`` of each item to the one query vector (column ``query`` of a one-row frame).

    The query side is one row by contract (``limit(1)``), so it is broadcast; items are not shuffled.
    Items without a vector, and all items if there is no query, get no row.
    """
    one = F.broadcast(query.select("query").limit(1))
    return items.filter(F.col(vector).isNotNull()).crossJoin(one).withColumn("distance", vectors.l2_distance(F.col(vector), F.col("query"))).drop("query")


def nearest(items: DataFrame, query: DataFrame, k: int, key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The k nearest items, by distance and then key. The filter comes before the distance.

    Runs as one partial top-k per partition. k of 0 gives nothing, more than there are gives all.
    """
    if where is not None:
        items = items.filter(where)
    return with_distance(items, query).orderBy("distance", key).limit(k)


def rerank(scored: DataFrame, now: Column, ts: str, content_type: str = "content_type", current: Column | None = None) -> DataFrame:
    """Adds similarity, age in days, confidence level and final score to items with a distance."""
    age = scoring.age_days(F.col(ts), now)
    out = scored.withColumn("similarity", vectors.similarity(F.col("distance"))).withColumn("age_days", age)
    out = out.withColumn("confidence", scoring.confidence_level(F.col(content_type), F.col("age_days"), current if current is not None else F.lit(True)))
    return out.withColumn("final_score", scoring.final_score(F.col("similarity"), F.col("age_days"), scoring.base_weight(F.col("confidence"))))


def quota(scored: DataFrame, section: Column, quotas: dict[str, int], order: list[Column]) -> DataFrame:
    """The best rows of each section, as many as its quota; other sections are left out.

    The row limit is pushed below the shuffle (window group limit), so few rows per section move.
    """
    most = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    ranked = scored.withColumn("section", section).filter(F.col("section").isin(list(quotas)))
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(*order))).filter(F.col("place") <= max(quotas.values()))
    return ranked.filter(F.col("place") <= most[F.col("section")])


def candidates(x: np.ndarray, v: np.ndarray, k: int, measure: str = "distance", digits: int | None = None) -> Callable[[int, int], tuple[np.ndarray, np.ndarray]] | None:
    """A function of a range of rows of ``v`` that gives rows of ``v`` and of ``x``: pairs among which are, for each row of ``v``, the k best rows of ``x`` and all that tie with them.

    A product in single precision finds them; pairs that its rounding could hide are among them, so the k
    best by exact scores are the k best of all. None if every pair has to be scored: few rows, or no finite numbers.
    """
    with np.errstate(all="ignore"):
        if measure == "cosine":
            x, v, scale = x / np.linalg.norm(x, axis=1)[:, None], v / np.linalg.norm(v, axis=1)[:, None], 1.0
        else:
            scale = max(np.abs(x).max(initial=0), np.abs(v).max(initial=0)) * x.shape[1] ** 0.5 or 1.0
            x, v = x / scale, v / scale
    if len(x) <= 4 * k or not (np.isfinite(x).all() and np.isfinite(v).all()):
        return None
    # no row is longer than 1 now, so this bounds what a product or half a squared length may be off
    off = 2 * (x.shape[1] + 16) * 2.0**-24
    gap = 0.0 if digits is None else 10.0**-digits / scale
    half = np.float32(0.5) * (x * x).sum(1).astype("f4") if measure == "distance" else np.zeros(len(x), "f4")
    single, turned, long = v.astype("f4"), np.ascontiguousarray(x.astype("f4").T), (v * v).sum(1)
    parts = min(len(x), max(64, 4 * k))
    wide = len(x) // parts

    def pairs(first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        s = single[first:end] @ turned
        s -= half
        # at least k rows reach the k-th best of the parts' best
        least = np.partition(s[:, : parts * wide].reshape(len(s), parts, wide).max(2), -k, axis=1)[:, -k].astype("f8") - off
        if measure == "distance":  # s is (length of v squared - distance squared) / 2
            far = np.sqrt(np.maximum(long[first:end] - 2 * least, 0)) + gap
            least = (long[first:end] - far * far) / 2
        rows, cols = np.divmod(np.flatnonzero(s >= (least - off - gap).astype("f4")[:, None]), len(x))
        return rows + first, cols

    return pairs


def first_of_equal(items: DataFrame, k: int, section: list[str] = ()) -> DataFrame:
    """Of items with the same vector (and section) the k whose ``vec_id`` is least: no others can be among k best."""
    alike = Window.partitionBy(F.xxhash64(F.lit(1), "embedding"), F.xxhash64(F.lit(2), "embedding"), *section).orderBy("vec_id")
    return items.withColumn("_alike", F.row_number().over(alike)).filter(F.col("_alike") <= k).drop("_alike")


def search_many(items: DataFrame, queries: DataFrame, k: int | None, keep: list[str] = (), measure: str = "distance", factor: str | None = None, section: str | None = None, digits: int | None = None, normalize: bool = False) -> DataFrame:
    """The k best items of each query: ``query_id``, ``vec_id``, ``value``, ``score``, and the columns of ``keep``.

    ``items`` and ``queries`` have ``vec_id`` and ``embedding``, of one length, one row per id; the query's own
    vector is an item like any other. ``value`` is the distance or, with ``measure`` "cosine", the cosine;
    ``score``, by which items are ranked, is the same with the best one greatest (``-distance``), or with
    ``factor`` the similarity times that column; an item whose factor is null comes after all others, by its distance.
    Ties go by ``vec_id``. With ``section`` there are k of each value of that column. ``k`` None gives all.

    With ``digits`` values and scores are rounded before they are ranked, so that what differs by less is a tie.
    With ``normalize`` vectors are brought to length 1 first, so that they can travel as counts.

    Blocks of items meet blocks of queries in groups of bounded size, whatever the sizes of both; a group
    gives its k best per query, and these are merged per query. Nothing is broadcast. In a group a product in
    single precision leaves few pairs (:func:`candidates`), which are scored exactly.
    """
    if measure not in ("distance", "cosine"):
        raise ValueError(measure)
    keep = list(keep)
    item_block, query_block = (ALL_ITEM_BLOCK, ALL_QUERY_BLOCK) if k is None else (ITEM_BLOCK, QUERY_BLOCK)
    n_items, n_queries = -(-items.count() // item_block) or 1, -(-queries.count() // query_block) or 1
    columns = ["vec_id", "embedding", *dict.fromkeys([*keep, *([factor] if factor else []), *([section] if section else [])])]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = items.select(*columns, block(n_items).alias("_i")).withColumn("_q", every(n_queries))
    # under other names, since both sides may come from one table, which a cogroup would mix up
    right = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), block(n_queries).alias("_q")).withColumn("_i", every(n_items))
    types = dict(items.select(*columns).dtypes)
    kept = list(dict.fromkeys([*keep, *([section] if section else [])]))

    def stacked(column: pd.Series) -> np.ndarray:
        m = np.stack([np.asarray(v, np.float64) for v in column])
        return m / np.sqrt((m * m).sum(1))[:, None] if normalize else m

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "value", "score", *kept]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        x, v = stacked(a.embedding), stacked(b["query"])
        length, q_length = np.linalg.norm(x, axis=1), np.linalg.norm(v, axis=1)
        ids = a.vec_id.to_numpy()
        ids = ids.astype("U") if ids.dtype == object else ids
        order = np.empty(len(ids), np.int64)  # places of the ids
        order[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        groups = [np.arange(len(a))] if section is None else list(a.groupby(section).indices.values())
        weight = a[factor].to_numpy(np.float64, na_value=np.nan) if factor else None
        found = []
        for g in groups:
            some = None if factor or k is None else candidates(x[g], v, k, measure, digits)
            step = max(1, SCORES // len(g))
            for first in range(0, len(v), step):
                end = min(first + step, len(v))
                rows, cols = some(first, end) if some else (np.repeat(np.arange(first, end), len(g)), np.tile(np.arange(len(g)), end - first))
                found.append(best(x, v, rows, g[cols], length, q_length, weight, order))
        rows, cols, value, rank = (np.concatenate(p) for p in zip(*found))
        out = a[["vec_id", *kept]].iloc[cols].reset_index(drop=True)
        return out.assign(query_id=b["query_id"].to_numpy()[rows], value=value, score=rank)[names]

    def best(x, v, rows, cols, length, q_length, weight, order):
        value = np.empty(len(rows))
        for at in range(0, len(rows), 32_768):
            r, c = rows[at : at + 32_768], cols[at : at + 32_768]
            value[at : at + len(r)] = np.einsum("ij,ij->i", x[c], v[r]) / (length[c] * q_length[r]) if measure == "cosine" else np.sqrt(((x[c] - v[r]) ** 2).sum(1))
        rank = value if measure == "cosine" else -value
        last = np.zeros(len(rows), bool)
        if factor:
            last = np.isnan(weight[cols])
            rank = np.where(last, rank, weight[cols] / (1 + value))
        if digits is not None:
            value, rank = np.round(value, digits), np.round(rank, digits)
        by = np.lexsort((order[cols], -rank, last, rows))
        if k is not None:
            new = np.append(True, rows[by][1:] != rows[by][:-1])[: len(by)]
            starts = np.flatnonzero(new)
            by = by[np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by)))) < k]
        return rows[by], cols[by], value[by], np.where(last, np.nan, rank)[by]

    schema = ", ".join([f"query_id {dict(queries.dtypes)['vec_id']}", f"vec_id {types['vec_id']}", "value double", "score double", *(f"{c} {types[c]}" for c in kept)])
    out = left.groupBy("_i", "_q").cogroup(right.groupBy("_i", "_q")).applyInPandas(score, schema)
    out = out.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    if k is None:
        return out
    nearer = F.col("value") if measure == "distance" else -F.col("value")
    order = Window.partitionBy("query_id", *([section] if section else [])).orderBy(F.desc_nulls_last("score"), nearer, "vec_id")
    return out.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
