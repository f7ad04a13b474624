"""Queries over all kinds of items: the corpus, its chunks, and searches with enriched results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import corpus, search
from ..session import materialize
from ..tables import files, latest, messages, plans, table
from .search_queries import AS_OF, now
from .timeline_queries import COMMITS, SESSIONS, _M, commits, sessions


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = latest(table(spark, sf_dir, "symbols", "id", "branch_name", "file_id", "name", "kind", "doc_comment", "code"), ["id", "branch_name"], F.struct("name", "kind", "doc_comment", "code", "file_id"), tie=[])
    return corpus.corpus(
        files(spark, sf_dir, "kind", "file_path", "modified_at", "indexed"), latest(table(spark, sf_dir, "file_texts"), ["file_id"], "read_at"), messages(spark, sf_dir, "content", "timestamp"),
        sessions(spark, sf_dir), symbols, commits(spark, sf_dir), plans(spark, sf_dir, "title", "content"),
    )


def corpus_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with its title and path; texts by their hash."""
    return items(spark, sf_dir).select("content_type", "item_id", "branch", "path", "title", "ts", "is_current", F.sha2("content", 256).alias("content_hash"))


def chunk_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of files, plans, symbols and commits, each cut by the rule of its kind."""
    chunks = corpus.chunked(items(spark, sf_dir).filter("content_type not in ('Message', 'Session')"))
    return chunks.select("content_type", "item_id", "branch", "chunk_no", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_hash"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All items, and a vector of each: files by their first chunk, others whole."""
    every = materialize(items(spark, sf_dir), "corpus")
    whole = every.select("content_type", "item_id", "branch", "path", F.lit(0).alias("chunk_no"), F.coalesce("content", "title").alias("chunk"))
    return every, corpus.chunk_vectors(whole).drop("chunk")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query texts: the documents whose id is divisible by 100."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter("doc_id % 100 = 0")
    return docs.select(F.col("doc_id").cast("string").alias("vec_id"), vectors.text_counts("text").alias("embedding")).filter("embedding is not null")


def _search(spark: SparkSession, sf_dir: str, k: int, where=None, section=None) -> tuple[DataFrame, DataFrame]:
    every, rows = _vectors(spark, sf_dir)
    rows = rows if where is None else rows.filter(where)
    keep = ["content_type", "item_id", "branch"]
    if section is not None:
        rows, keep = rows.withColumn("section", section).filter("section is not null"), [*keep, "section"]
    # branches travel as text, since a group may hold none at all
    rows = rows.withColumn("branch", F.coalesce("branch", F.lit(""))).withColumnRenamed("chunk_key", "vec_id")
    rows = materialize(search.first_of_equal(rows, k, keep[3:]).select("vec_id", "embedding", *keep), "corpus-vectors")
    asked = materialize(_queries(spark, sf_dir), "query-vectors")
    hits = search.search_many(rows, asked, k, keep=keep, section="section" if section is not None else None, digits=9, normalize=True)
    return every, hits.withColumn("branch", F.nullif("branch", F.lit(""))).withColumn("similarity", vectors.similarity(F.col("value")))


def search_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five items nearest to each query text, with title, path, age, confidence, state and score."""
    every, hits = _search(spark, sf_dir, 5)
    out = corpus.enrich(hits, every, now())
    return out.select(
        "query_id", "place", "content_type", "item_id", "branch", "title", "path", "age_days", "age_text", "confidence", "is_current", "is_deprecated",
        F.sha2("content", 256).alias("shown_hash"), F.round("similarity", 6).alias("similarity"), F.round("final_score", 8).alias("final_score"),
    )


def search_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten results of each query text among code: six symbols and four files with code."""
    section = F.when(F.col("content_type") == "Symbol", "symbol").when((F.col("content_type") == "File") & (corpus.file_group(F.col("path")) == "code"), "file")
    every, hits = _search(spark, sf_dir, 6, section=section)
    hits = hits.filter((F.col("section") == "symbol") | (F.col("place") <= 4))
    return corpus.enrich(hits, every, now()).select("query_id", "section", "place", "item_id", "branch", "path", "title", F.round("similarity", 6).alias("similarity"))


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documentation files nearest to each query text."""
    where = (F.col("content_type") == "File") & (corpus.file_group(F.col("path")) == "docs")
    every, hits = _search(spark, sf_dir, 5, where)
    return corpus.enrich(hits, every, now()).select("query_id", "place", "item_id", "path", "title", F.round("similarity", 6).alias("similarity"))


def files_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by what a search for code, or for documentation, would take."""
    f = files(spark, sf_dir, "file_path")
    return f.groupBy(F.coalesce(corpus.file_group(F.col("file_path")), F.lit("neither")).alias("file_group")).agg(F.count(F.lit(1)).alias("n"))


def newest_in_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three items of a project that changed last, files and sessions alike."""
    f = files(spark, sf_dir, "project_path", "modified_at").select("project_path", F.col("id").alias("item_id"), F.col("modified_at").alias("ts"))
    s = sessions(spark, sf_dir).select("project_path", F.col("id").alias("item_id"), F.col("started_at").alias("ts"))
    both = f.unionByName(s).filter("ts is not null and project_path is not null")
    w = Window.partitionBy("project_path").orderBy(F.desc("ts"), "item_id")
    return both.withColumn("place", F.row_number().over(w)).filter("place <= 3")


QUERIES = {f.__name__: f for f in (corpus_items, chunk_dispatch, search_enriched, search_code, search_docs, files_by_group, newest_in_project)}

# the SQL lists what it needs as text, so that a wrong list of the package shows
_CODE = "'rs','py','js','ts','tsx','jsx','go','java','kt','kts','c','cpp','cc','cxx','h','hpp','hxx','cs','fs','fsx','vb','swift','scala','rb','php','sh','bash','zsh','fish','ps1','psm1','yaml','yml','json','toml','xml','cfg','ini','sql','graphql','wsdl','proto'"
_DOCS = "'md','markdown','rst','txt','adoc','asciidoc','html','htm','pdf','doc','docx'"
_EXT = r"lower(regexp_extract(path, '\.([^./]+)$', 1))"
_F = "f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified_at DESC) = 1)"
_T = "t AS (SELECT * FROM file_texts QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY read_at DESC) = 1)"
_P = "p AS (SELECT * FROM plans QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified_at DESC) = 1)"
_LINE = r"regexp_extract({c}, '^([^\r\n]*)', 1)"
ITEMS = rf"""{_F}, {_T}, {SESSIONS}, {_M}, {COMMITS}, {_P},
y AS (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY id, branch_name ORDER BY name DESC NULLS LAST, kind DESC NULLS LAST, doc_comment DESC NULLS LAST, code DESC NULLS LAST, file_id DESC NULLS LAST) = 1),
items AS (
  SELECT 'File' AS content_type, f.id AS item_id, NULL AS branch, file_path AS path, CASE kind WHEN 'Source' THEN 'Source: ' WHEN 'Docs' THEN 'Documentation: ' ELSE 'File: ' END || file_path AS title, content, modified_at AS ts, coalesce(indexed, true) AS is_current FROM f LEFT JOIN t ON t.file_id = f.id
  UNION ALL SELECT 'Message', id, NULL, NULL, content, content, timestamp, true FROM m
  UNION ALL SELECT 'Session', id, NULL, NULL, coalesce(title, 'Session in ' || project_path), title, started_at, true FROM sessions
  UNION ALL SELECT 'Symbol', y.id, branch_name, file_path, coalesce(name || ' - ' || nullif({_LINE.format(c='doc_comment')}, ''), y.kind || ': "' || name || '"'), code, modified_at, coalesce(indexed, true) FROM y LEFT JOIN f ON f.id = y.file_id
  UNION ALL SELECT 'Commit', CAST(id AS VARCHAR), NULL, NULL, {_LINE.format(c='message')}, message, ts, true FROM commits
  UNION ALL SELECT 'Plan', id, NULL, NULL, coalesce(title, ''), content, modified_at, true FROM p)"""
_WORDS = "list_transform(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: ('0x' || left(md5(w), 6))::INT % 96)"
_COUNTS = "list_transform(range(96), lambda d: len(list_filter(ws, lambda x: x = d))::DOUBLE)"
_UNIT = "list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))"
PAIRS = rf"""{ITEMS},
w0 AS (SELECT content_type, item_id, branch, path, {_WORDS.format(c='coalesce(content, title)')} AS ws FROM items WHERE item_id IS NOT NULL), v0 AS (SELECT * EXCLUDE ws, {_COUNTS} AS v FROM w0 WHERE len(ws) > 0), vecs AS (SELECT * EXCLUDE v, {_UNIT} AS u FROM v0),
wq AS (SELECT CAST(doc_id AS VARCHAR) AS query_id, {_WORDS.format(c='text')} AS ws FROM documents WHERE doc_id % 100 = 0), vq AS (SELECT query_id, {_COUNTS} AS v FROM wq WHERE len(ws) > 0), qs AS (SELECT query_id, {_UNIT} AS q FROM vq),
pairs AS (SELECT query_id, vecs.* EXCLUDE u, round(list_distance(u, q), 9) AS d, content_type || '|' || item_id || '|' || coalesce(branch, '') AS k FROM vecs, qs)"""
_AGE = f"CAST(trunc((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(i.ts))) / 86400) AS BIGINT)"
_SAME = "i.content_type = r.content_type AND i.item_id = r.item_id AND i.branch IS NOT DISTINCT FROM r.branch"
SQL = {
    "corpus_items": f"WITH {ITEMS} SELECT content_type, item_id, branch, path, title, ts, is_current, sha256(content) AS content_hash FROM items WHERE item_id IS NOT NULL",
    "chunk_dispatch": rf"""WITH {ITEMS}, n AS (SELECT content_type, item_id, branch, regexp_replace(content, '^\s+|\s+$', '', 'g') AS c, content FROM items WHERE content IS NOT NULL),
        ps AS (SELECT content_type, item_id, branch, list_filter(list_transform(string_split_regex(c, '\r?\n\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS xs FROM n WHERE content_type IN ('File', 'Plan')),
        packed AS (SELECT content_type, item_id, branch, string_split(list_reduce(xs, lambda a, x: CASE WHEN strlen(string_split(a, chr(1))[-1]) + strlen(x) + 2 <= 500 THEN a || chr(10) || chr(10) || x ELSE a || chr(1) || x END), chr(1)) AS cs FROM ps WHERE len(xs) > 0
          UNION ALL SELECT content_type, item_id, branch, [CASE WHEN strlen(content) > 1000 THEN left(content, 500) || '...' || chr(10) || '[truncated: ' || length(content) || ' total chars]' ELSE content END] FROM n WHERE content_type = 'Symbol' AND content <> ''
          UNION ALL SELECT content_type, item_id, branch, [trim(content)] FROM n WHERE content_type = 'Commit' AND trim(content) <> ''),
        u AS (SELECT *, unnest(range(len(cs))) AS i FROM packed)
        SELECT content_type, item_id, branch, CAST(i AS INTEGER) AS chunk_no, CAST(length(cs[i + 1]) AS INTEGER) AS n_chars, sha256(cs[i + 1]) AS chunk_hash FROM u""",
    "search_enriched": f"""WITH {PAIRS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, k) AS INTEGER) AS place FROM pairs QUALIFY place <= 5),
        e AS (SELECT r.query_id, r.place, r.content_type, r.item_id, r.branch, i.title, i.path, i.content, i.is_current, 1 / (1 + d) AS similarity, CASE WHEN epoch(i.ts) > 0 THEN {_AGE} ELSE 0 END AS age_days FROM r LEFT JOIN items i ON {_SAME}),
        l AS (SELECT *, CASE WHEN content_type IN ('File', 'Symbol') THEN CASE WHEN coalesce(is_current, true) THEN 'Highest' ELSE 'Low' END WHEN content_type IN ('Commit', 'GitDiff', 'Plan') THEN 'High' WHEN age_days <= 7 THEN 'Medium' WHEN age_days <= 30 THEN 'Low' ELSE 'Lowest' END AS confidence FROM e)
        SELECT query_id, place, content_type, item_id, branch, title, path, age_days,
          CASE WHEN age_days = 0 THEN 'Current' WHEN age_days < 1 THEN (24 * age_days) || ' hours ago' WHEN age_days < 60 THEN age_days || ' days ago' ELSE (age_days // 30) || ' months ago' END AS age_text,
          confidence, is_current, NOT is_current AS is_deprecated, sha256(CASE WHEN strlen(content) > 500 THEN left(content, 500) || '...' ELSE content END) AS shown_hash, round(similarity, 6) AS similarity,
          round(similarity * exp(-0.05 * greatest(age_days, 0)) * CASE confidence WHEN 'Highest' THEN 1.2 WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.85 WHEN 'Low' THEN 0.6 ELSE 0.4 END, 8) AS final_score FROM l""",
    "search_code": f"""WITH {PAIRS}, c AS (SELECT *, CASE WHEN content_type = 'Symbol' THEN 'symbol' ELSE 'file' END AS section FROM pairs WHERE content_type = 'Symbol' OR content_type = 'File' AND {_EXT} IN ({_CODE})),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, section ORDER BY d, k) AS INTEGER) AS place FROM c QUALIFY place <= CASE section WHEN 'symbol' THEN 6 ELSE 4 END)
        SELECT r.query_id, section, place, r.item_id, r.branch, i.path, i.title, round(1 / (1 + d), 6) AS similarity FROM r LEFT JOIN items i ON {_SAME}""",
    "search_docs": f"""WITH {PAIRS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, k) AS INTEGER) AS place FROM pairs WHERE content_type = 'File' AND {_EXT} IN ({_DOCS}) QUALIFY place <= 5)
        SELECT r.query_id, place, r.item_id, i.path, i.title, round(1 / (1 + d), 6) AS similarity FROM r LEFT JOIN items i ON {_SAME}""",
    "files_by_group": f"WITH {_F}, g AS (SELECT file_path AS path FROM f) SELECT CASE WHEN {_EXT} IN ({_CODE}) THEN 'code' WHEN {_EXT} IN ({_DOCS}) THEN 'docs' ELSE 'neither' END AS file_group, count(*) AS n FROM g GROUP BY 1",
    "newest_in_project": f"""WITH {_F}, {SESSIONS}, b AS (SELECT project_path, id AS item_id, modified_at AS ts FROM f UNION ALL SELECT project_path, id, started_at FROM sessions)
        SELECT project_path, item_id, ts, CAST(row_number() OVER (PARTITION BY project_path ORDER BY ts DESC, item_id) AS INTEGER) AS place FROM b WHERE ts IS NOT NULL AND project_path IS NOT NULL QUALIFY place <= 3""",
}
