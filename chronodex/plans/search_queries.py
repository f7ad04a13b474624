"""Search and scoring queries over the stored vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, vectors
from ..operators import search
from ..session import materialize
from ..tables import latest, table

#: The time that counts as now in all registered queries.
AS_OF = "2026-01-01 00:00:00"


def now():
    return F.lit(AS_OF).cast("timestamp")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector table: per vector id the latest usable row of the embedding cache."""
    rows = table(spark, sf_dir, "cache_entries").filter(vectors.usable(F.col("embedding"), 96))
    return latest(rows, ["vec_id"], "cached_at", tie=["cache_key"])


def query_vector(vecs: DataFrame) -> DataFrame:
    """The query: the vector with the least id."""
    return vecs.orderBy("vec_id").limit(1).select(F.col("embedding").alias("query"))


ITEMS = """items AS (
  SELECT * FROM cache_entries
  WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cached_at DESC, cache_key DESC) = 1
), q AS (SELECT embedding::DOUBLE[] AS v FROM items ORDER BY vec_id LIMIT 1),
hits AS (SELECT items.*, list_distance(embedding::DOUBLE[], q.v) AS distance FROM items, q)"""
_AGE = f"CAST(trunc((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(cached_at))) / 86400) AS BIGINT)"
_LEVEL = "CASE WHEN content_type IN ('File', 'Symbol') THEN 'Highest' WHEN age_days <= 7 THEN 'Medium' WHEN age_days <= 30 THEN 'Low' ELSE 'Lowest' END"
SCORED = f"""{ITEMS}, aged AS (SELECT *, {_AGE} AS age_days, 1 / (1 + distance) AS similarity FROM hits),
levelled AS (SELECT *, {_LEVEL} AS confidence FROM aged),
scored AS (SELECT *, similarity * exp(-0.05 * greatest(age_days, 0)) *
  CASE confidence WHEN 'Highest' THEN 1.2 WHEN 'Medium' THEN 0.85 WHEN 'Low' THEN 0.6 ELSE 0.4 END AS final_score FROM levelled)"""


def _hits(spark, sf_dir):
    vecs = items(spark, sf_dir)
    return search.with_distance(vecs, query_vector(vecs))


def _scored(spark, sf_dir):
    return search.rerank(_hits(spark, sf_dir), now(), "cached_at")


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = items(spark, sf_dir)
    return search.nearest(vecs, query_vector(vecs), 10).select("vec_id", F.round("distance", 6).alias("distance"))


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = items(spark, sf_dir)
    return search.nearest(vecs, query_vector(vecs), 10, where=F.col("content_type") == "File").select("vec_id", "content_type", F.round("distance", 6).alias("distance"))


def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = items(spark, sf_dir)
    one = F.broadcast(query_vector(vecs))
    scored = vecs.crossJoin(one).withColumn("cosine", vectors.cosine(F.col("embedding"), F.col("query")))
    return scored.orderBy(F.desc("cosine"), "vec_id").limit(10).select("vec_id", F.round("cosine", 6).alias("cosine"))


def similarity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("vec_id", F.round(vectors.similarity(F.col("distance")), 6).alias("similarity"))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embedding_data", "request_id", "idx", "vec_id", "embedding").filter(vectors.usable(F.col("embedding"))).distinct()
    return rows.select("request_id", "idx", "vec_id", F.size("embedding").alias("dimensions"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


def search_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _scored(spark, sf_dir).orderBy(F.desc("final_score"), "vec_id").limit(10)
    return best.select("vec_id", "content_type", "age_days", "confidence", F.round("similarity", 6).alias("similarity"), F.round("final_score", 9).alias("final_score"))


def search_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = items(spark, sf_dir)
    inside = scoring.in_range(F.col("cached_at"), F.col("content_type"), F.lit("2025-01-01").cast("timestamp"), F.lit("2025-07-01").cast("timestamp"))
    return search.nearest(vecs, query_vector(vecs), 20, where=inside).select("vec_id", "content_type", "cached_at", F.round("distance", 6).alias("distance"))


def search_mixed_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.quota(_hits(spark, sf_dir), F.col("content_type"), {"Symbol": 6, "File": 4}, [F.col("distance"), F.col("vec_id")])
    return best.select("section", "place", "vec_id", F.round("distance", 6).alias("distance"))


# ---- all queries: each vector whose id is divisible by 100, against the vectors of both tables


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usable vector per id from both tables; type and time are null where only embedding_data has it."""
    cached = items(spark, sf_dir).select("vec_id", "content_type", "cached_at", "embedding")
    # repeated rows hold the same vector; if not, the least counts
    rows = table(spark, sf_dir, "embedding_data", "vec_id", "embedding").filter(vectors.usable(F.col("embedding"), 96))
    other = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).join(cached.select("vec_id"), "vec_id", "left_anti")
    both = cached.unionByName(other, allowMissingColumns=True).filter("vec_id is not null")
    return materialize(both, "vectors")


def _many(rows: DataFrame, k: int | None, where=None, **how) -> DataFrame:
    return search.search_many(rows if where is None else rows.filter(where), rows.filter("vec_id % 100 = 0"), k, **how)


def knn_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _many(collection(spark, sf_dir), 10).select("query_id", "vec_id", F.round("value", 6).alias("distance"))


def knn_filtered_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _many(collection(spark, sf_dir), 10, F.col("content_type") == "File", keep=["content_type"])
    return found.select("query_id", "vec_id", "content_type", F.round("value", 6).alias("distance"))


def knn_cosine_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _many(collection(spark, sf_dir), 10, measure="cosine").select("query_id", "vec_id", F.round("value", 6).alias("cosine"))


def similarity_score_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _many(collection(spark, sf_dir), None).select("query_id", "vec_id", F.round(vectors.similarity(F.col("value")), 6).alias("similarity"))


def search_rerank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without type have no confidence and so no final score: they come last, by distance."""
    rows = collection(spark, sf_dir).withColumn("age_days", scoring.age_days(F.col("cached_at"), now()))
    rows = rows.withColumn("confidence", scoring.confidence_level(F.col("content_type"), F.col("age_days"), F.lit(True)))
    rows = rows.withColumn("factor", scoring.final_score(F.lit(1.0), F.col("age_days"), scoring.base_weight(F.col("confidence"))))
    best = _many(rows, 10, keep=["content_type", "age_days", "confidence"], factor="factor")
    return best.select("query_id", "vec_id", "content_type", "age_days", "confidence", F.round(vectors.similarity(F.col("value")), 6).alias("similarity"), F.round("score", 9).alias("final_score"))


def search_time_range_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = scoring.in_range(F.col("cached_at"), F.col("content_type"), F.lit("2025-01-01").cast("timestamp"), F.lit("2025-07-01").cast("timestamp"))
    best = _many(collection(spark, sf_dir), 20, inside, keep=["content_type", "cached_at"])
    return best.select("query_id", "vec_id", "content_type", "cached_at", F.round("value", 6).alias("distance"))


def search_mixed_quota_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = F.when(F.col("content_type") == "Symbol", 6).otherwise(4)
    best = _many(collection(spark, sf_dir), 6, F.col("content_type").isin("Symbol", "File"), section="content_type").filter(F.col("place") <= most)
    return best.select("query_id", F.col("content_type").alias("section"), "place", "vec_id", F.round("value", 6).alias("distance"))


def decay_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = scoring.age_days(F.col("cached_at"), now())
    rows = items(spark, sf_dir).select("content_type", age.alias("age_days")).withColumn("weight", scoring.decay(F.col("age_days")))
    return rows.groupBy("content_type", F.floor(F.col("age_days") / 30).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("weight"), 9).alias("avg_weight"), F.min("age_days").alias("least_age"))


def confidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("content_type", "confidence").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("final_score"), 9).alias("best_score"))


def age_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = scoring.epoch(now()) - scoring.epoch(F.col("cached_at"))
    age = scoring.age_days(F.col("cached_at"), now())
    return items(spark, sf_dir).select("vec_id", scoring.age_text_days(age).alias("days_text"), scoring.age_text_long(seconds).alias("long_text"), scoring.age_text_short(seconds).alias("short_text"))


_FINE = "len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
ALL_PAIRS = f"""cached AS (SELECT * FROM cache_entries WHERE {_FINE} AND vec_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cached_at DESC, cache_key DESC) = 1),
vecs AS (SELECT vec_id, content_type, cached_at, embedding::DOUBLE[] AS v FROM cached UNION ALL
  SELECT vec_id, NULL, NULL, min(embedding)::DOUBLE[] FROM embedding_data WHERE {_FINE} AND vec_id IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM cached) GROUP BY vec_id),
pairs AS (SELECT q.vec_id AS query_id, vecs.*, list_distance(vecs.v, q.v) AS d, list_cosine_similarity(vecs.v, q.v) AS cs FROM vecs, vecs q WHERE q.vec_id % 100 = 0)"""
_BEST = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <="

QUERIES = {
    f.__name__: f
    for f in (
        knn_topk, knn_filtered, knn_cosine, similarity_score, vector_norms, search_rerank, search_time_range, search_mixed_quota, decay_curve, confidence_levels, age_labels,
        knn_topk_all, knn_filtered_all, knn_cosine_all, similarity_score_all, search_rerank_all, search_time_range_all, search_mixed_quota_all,
    )
}

SQL = {
    "knn_topk": f"WITH {ITEMS} SELECT vec_id, round(distance, 6) AS distance FROM hits ORDER BY hits.distance, vec_id LIMIT 10",
    "knn_filtered": f"WITH {ITEMS} SELECT vec_id, content_type, round(distance, 6) AS distance FROM hits WHERE content_type = 'File' ORDER BY hits.distance, vec_id LIMIT 10",
    "knn_cosine": f"WITH {ITEMS}, c AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q.v) AS cs FROM items, q) SELECT vec_id, round(cs, 6) AS cosine FROM c ORDER BY cs DESC, vec_id LIMIT 10",
    "similarity_score": f"WITH {ITEMS} SELECT vec_id, round(1 / (1 + distance), 6) AS similarity FROM hits",
    "vector_norms": """SELECT DISTINCT request_id, idx, vec_id, CAST(len(embedding) AS INTEGER) AS dimensions, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm
        FROM embedding_data WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0""",
    "search_rerank": f"WITH {SCORED} SELECT vec_id, content_type, age_days, confidence, round(similarity, 6) AS similarity, round(final_score, 9) AS final_score FROM scored ORDER BY scored.final_score DESC, vec_id LIMIT 10",
    "search_time_range": f"""WITH {ITEMS} SELECT vec_id, content_type, cached_at, round(distance, 6) AS distance FROM hits
        WHERE content_type = 'Symbol' OR (cached_at >= TIMESTAMP '2025-01-01' AND cached_at < TIMESTAMP '2025-07-01') ORDER BY hits.distance, vec_id LIMIT 20""",
    "search_mixed_quota": f"""WITH {ITEMS}, r AS (SELECT content_type AS section, CAST(row_number() OVER (PARTITION BY content_type ORDER BY distance, vec_id) AS INTEGER) AS place, vec_id, round(distance, 6) AS distance
        FROM hits WHERE content_type IN ('Symbol', 'File')) SELECT * FROM r WHERE place <= CASE section WHEN 'Symbol' THEN 6 ELSE 4 END""",
    "knn_topk_all": f"WITH {ALL_PAIRS} SELECT query_id, vec_id, round(d, 6) AS distance FROM pairs {_BEST} 10",
    "knn_filtered_all": f"WITH {ALL_PAIRS} SELECT query_id, vec_id, content_type, round(d, 6) AS distance FROM pairs WHERE content_type = 'File' {_BEST} 10",
    "knn_cosine_all": f"WITH {ALL_PAIRS} SELECT query_id, vec_id, round(cs, 6) AS cosine FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cs DESC, vec_id) <= 10",
    "similarity_score_all": f"WITH {ALL_PAIRS} SELECT query_id, vec_id, round(1 / (1 + d), 6) AS similarity FROM pairs",
    "search_rerank_all": f"""WITH {ALL_PAIRS}, aged AS (SELECT *, CASE WHEN cached_at IS NULL THEN 0 ELSE {_AGE} END AS age_days FROM pairs),
        levelled AS (SELECT *, CASE WHEN content_type IN ('File', 'Symbol') THEN 'Highest' WHEN content_type IN ('Commit', 'GitDiff', 'Plan') THEN 'High' WHEN content_type NOT IN ('Message', 'Session') OR content_type IS NULL THEN NULL
          WHEN age_days <= 7 THEN 'Medium' WHEN age_days <= 30 THEN 'Low' ELSE 'Lowest' END AS confidence FROM aged),
        scored AS (SELECT *, 1 / (1 + d) * exp(-0.05 * greatest(age_days, 0)) * CASE confidence WHEN 'Highest' THEN 1.2 WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.85 WHEN 'Low' THEN 0.6 WHEN 'Lowest' THEN 0.4 END AS s FROM levelled)
        SELECT query_id, vec_id, content_type, age_days, confidence, round(1 / (1 + d), 6) AS similarity, round(s, 9) AS final_score FROM scored
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, d, vec_id) <= 10""",
    "search_time_range_all": f"""WITH {ALL_PAIRS} SELECT query_id, vec_id, content_type, cached_at, round(d, 6) AS distance FROM pairs
        WHERE content_type = 'Symbol' OR (cached_at >= TIMESTAMP '2025-01-01' AND cached_at < TIMESTAMP '2025-07-01') {_BEST} 20""",
    "search_mixed_quota_all": f"""WITH {ALL_PAIRS}, r AS (SELECT query_id, content_type AS section, CAST(row_number() OVER (PARTITION BY query_id, content_type ORDER BY d, vec_id) AS INTEGER) AS place, vec_id, round(d, 6) AS distance
        FROM pairs WHERE content_type IN ('Symbol', 'File')) SELECT * FROM r WHERE place <= CASE section WHEN 'Symbol' THEN 6 ELSE 4 END""",
    "decay_curve": f"""WITH {ITEMS}, a AS (SELECT content_type, {_AGE} AS age_days FROM items)
        SELECT content_type, CAST(floor(age_days / 30) AS BIGINT) AS month, count(*) AS n, round(avg(exp(-0.05 * greatest(age_days, 0))), 9) AS avg_weight, min(age_days) AS least_age FROM a GROUP BY ALL""",
    "confidence_levels": f"WITH {SCORED} SELECT content_type, confidence, count(*) AS n, round(max(final_score), 9) AS best_score FROM scored GROUP BY ALL",
    "age_labels": f"""WITH {ITEMS}, a AS (SELECT vec_id, {_AGE} AS d, CAST(epoch(TIMESTAMP '{AS_OF}') - floor(epoch(cached_at)) AS BIGINT) AS s FROM items)
        SELECT vec_id,
          CASE WHEN d = 0 THEN 'Current' WHEN d < 1 THEN (24 * d) || ' hours ago' WHEN d < 60 THEN d || ' days ago' ELSE (d // 30) || ' months ago' END AS days_text,
          CASE WHEN s < 3600 THEN 'Just now' WHEN s < 86400 THEN (s // 3600) || CASE WHEN s // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END
               WHEN s < 604800 THEN (s // 86400) || CASE WHEN s // 86400 = 1 THEN ' day ago' ELSE ' days ago' END
               WHEN s < 2592000 THEN (s // 604800) || CASE WHEN s // 604800 = 1 THEN ' week ago' ELSE ' weeks ago' END
               ELSE (s // 2592000) || CASE WHEN s // 2592000 = 1 THEN ' month ago' ELSE ' months ago' END END AS long_text,
          CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 604800 THEN (s // 86400) || 'd ago' ELSE (s // 604800) || 'w ago' END AS short_text
        FROM a""",
}
