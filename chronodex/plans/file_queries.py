"""File, chunk, symbol and plan queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, text
from ..operators import incremental
from ..tables import files, latest, messages, plans, table
from .timeline_queries import COMMITS, SESSIONS, _M, commits, sessions


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "file_texts"), ["file_id"], "read_at")


def file_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between the indexed files and the texts read: by content hash."""
    stored = files(spark, sf_dir).filter("indexed").select(F.col("id").alias("file_id"), F.col("content_hash").alias("hash"))
    current = texts(spark, sf_dir).select("file_id", F.sha2("content", 256).alias("hash"))
    return incremental.change_set(current, stored, "file_id", "hash")


def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols' files that have no text any more."""
    known = table(spark, sf_dir, "symbols", "file_id").distinct()
    return known.join(table(spark, sf_dir, "file_texts", "file_id"), "file_id", "left_anti")


def content_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir, "project_path", "file_path")
    path_id = F.concat(F.lit("file:"), F.sha2(F.concat_ws("/", "project_path", "file_path"), 256))
    return f.select("id", path_id.alias("path_id"), (F.col("id") == path_id).alias("matches"))


def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("file_path")
    return files(spark, sf_dir).groupBy(text.file_kind(p).alias("kind"), text.language(p).alias("language"), F.col("kind").alias("stored_kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).select("file_id", F.explode(chunking.line_windows(F.col("content"))).alias("c"))
    return rows.select("file_id", "c.start_line", "c.end_line", F.sha2("c.content", 256).alias("content_hash"))


def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(chunking.paragraphs(F.col("text"))).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.octet_length("chunk").alias("n_bytes"), F.sha2("chunk", 256).alias("chunk_hash"))


def chunk_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select("id", F.posexplode(chunking.chunk_message("content")).alias("chunk_no", "chunk"))
    return rows.select("id", "chunk_no", "chunk")


def chunk_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plans(spark, sf_dir).select(F.col("id").alias("plan_id"), F.posexplode(chunking.chunk_markdown("content")).alias("chunk_no", "c"))
    return rows.select("plan_id", "chunk_no", "c.kind", "c.content", "c.header_level", F.array_join("c.header_path", " > ").alias("header_path"), "c.start_line", "c.end_line")


def chunk_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(chunking.plain_paragraphs(F.col("text"))).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_hash"))


def chunk_doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files by their documentation format; others in windows of lines."""
    f = files(spark, sf_dir).select(F.col("id").alias("file_id"), text.extension(F.col("file_path")).alias("ext"))
    rows = texts(spark, sf_dir).join(f, "file_id").select("file_id", F.posexplode(chunking.chunk_document("content", "ext")).alias("chunk_no", "c"))
    return rows.select("file_id", "chunk_no", "c.kind", chunking.cleaned_markdown("c.content").alias("content"), "c.header_level", F.array_join("c.header_path", " > ").alias("header_path"), "c.start_line", "c.end_line")


def chunk_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of symbols: whole if small, else in blocks of lines."""
    rows = table(spark, sf_dir, "symbols", "id", "branch_name", "code", "start_line").distinct()
    rows = rows.select("id", "branch_name", F.explode(chunking.chunk_symbol("code", "start_line", F.lit(""))).alias("c"))
    return rows.select("id", "branch_name", "c.block", "c.start_line", "c.end_line", "c.content")


def symbol_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "symbols", "id", "branch_name", "code").distinct()
    return rows.select("id", "branch_name", chunking.symbol_text(F.col("code")).alias("text"))


def doc_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null").select("doc_id", text.truncate(F.col("text")).alias("preview"))


def imports_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select(F.col("id").alias("file_id"), text.language(F.col("file_path")).alias("lang"))
    rows = texts(spark, sf_dir).join(f, "file_id")
    t, lang = F.col("content"), F.col("lang")
    return rows.select("file_id", "lang", F.array_join(text.imports(t, lang), "|").alias("imports"), F.array_join(text.exports(t, lang), "|").alias("exports"))


def code_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "symbols", "id", "code").filter("code is not null").distinct()
    words = rows.select("id", F.explode(text.keywords(F.col("code"))).alias("keyword"))
    return words.groupBy("keyword").agg(F.count_distinct("id").alias("n_symbols"))


def symbol_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with the state of their file; a symbol without a known file counts as current."""
    s = latest(table(spark, sf_dir, "symbols", "id", "branch_name", "file_id", "name"), ["id", "branch_name"], "file_id")
    f = files(spark, sf_dir).select(F.col("id").alias("file_id"), "file_path", "indexed")
    return s.join(f, "file_id", "left").select("id", "branch_name", "name", "file_path", F.coalesce("indexed", F.lit(True)).alias("is_current"))


def symbol_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each branch and symbol without parent: how deep its descendants go, and how many symbols there are."""
    s = table(spark, sf_dir, "symbols", "id", "parent_id", "branch_name").filter("id is not null").distinct()
    return incremental.roots(s, "id", "parent_id", "branch_name").groupBy("branch_name", "root").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_symbols"))


def branch_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "symbols", "id", "branch_name", "file_id").distinct()
    return s.groupBy("branch_name").agg(F.count_distinct("id").alias("n_symbols"), F.count_distinct("file_id").alias("n_files"))


def branch_only_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that exist on some branch, but not on main."""
    s = table(spark, sf_dir, "symbols", "id", "branch_name").distinct()
    return s.filter("branch_name <> 'main'").join(s.filter("branch_name = 'main'").select("id"), "id", "left_anti")


def id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = incremental.id_lists(table(spark, sf_dir, "symbols", "file_id", "id"), "file_id", "id")
    return lists.select("file_id", "block", F.size("ids").alias("n"), F.sha2(F.array_join("ids", ","), 256).alias("ids_hash"))


def plan_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plans(spark, sf_dir)
    heading = text.markdown_title(F.col("content"))
    return p.select("id", F.coalesce("title", heading).alias("title"), F.coalesce(F.size(F.filter(text.lines(F.col("content")), lambda x: x.rlike("^#{1,6} "))), F.lit(0)).alias("n_headings"))


def title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session title's words, each once, in order."""
    return sessions(spark, sf_dir).filter("title is not null").select("id", F.array_join(F.array_distinct(F.split(F.lower("title"), " ")), " ").alias("words"))


def project_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("project_path")
    coded = table(spark, sf_dir, "chat_sessions", "project_path").distinct().withColumn("encoded", text.encode_project_path(p))
    return coded.withColumn("decoded", text.decode_project_path(F.col("encoded")))


def diff_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    return d.select("doc_id", text.changed_lines(F.col("text"), "+").alias("added"), text.changed_lines(F.col("text"), "-").alias("removed"))


def corpus_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of items as one corpus: how many there are of each, and how much text they give."""
    f = files(spark, sf_dir).select(F.lit("File").alias("content_type"), F.concat(F.when(F.col("kind") == "Source", "Source: ").when(F.col("kind") == "Docs", "Documentation: ").otherwise("File: "), "file_path").alias("content"))
    s = sessions(spark, sf_dir).select(F.lit("Session").alias("content_type"), F.coalesce("title", F.concat(F.lit("Session in "), "project_path")).alias("content"))
    m = messages(spark, sf_dir).select(F.lit("Message").alias("content_type"), "content")
    y = latest(table(spark, sf_dir, "symbols", "id", "branch_name", "name", "kind", "doc_comment"), ["id", "branch_name"], F.struct("name", "kind", "doc_comment"))
    doc = F.nullif(text.first_line(F.col("doc_comment")), F.lit(""))
    y = y.select(F.lit("Symbol").alias("content_type"), F.coalesce(F.concat("name", F.lit(" - "), doc), F.concat("kind", F.lit(': "'), "name", F.lit('"'))).alias("content"))
    c = commits(spark, sf_dir).select(F.lit("Commit").alias("content_type"), text.first_line(F.col("message")).alias("content"))
    p = plans(spark, sf_dir).select(F.lit("Plan").alias("content_type"), F.coalesce("title", F.lit("")).alias("content"))
    out = f.unionByName(s).unionByName(m).unionByName(y).unionByName(c).unionByName(p)
    return out.groupBy("content_type").agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("n_chars"), F.min("content").alias("first_content"))


def embedding_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "embedding_data", "vec_id").filter("vec_id is not null").distinct()
    return wanted.join(table(spark, sf_dir, "cache_entries", "vec_id"), "vec_id", "left_anti")


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import vectors

    e = table(spark, sf_dir, "embedding_data", "model", "request_id", "embedding")
    fine = vectors.usable(F.col("embedding"), 96)
    return e.groupBy("model").agg(F.count(F.lit(1)).alias("processed"), F.count_if(fine).alias("embedded"), F.count_if(~fine).alias("errors"), F.count_distinct("request_id").alias("requests"), F.round(F.count_if(fine) / F.count(F.lit(1)), 6).alias("success_rate"))


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = None
    for name, key in (("chat_sessions", "id"), ("messages", "id"), ("files", "id"), ("symbols", "id"), ("plans", "id"), ("file_chunks", "chunk_id"), ("cache_entries", "vec_id"), ("embedding_data", "vec_id"), ("documents", "doc_id")):
        part = table(spark, sf_dir, name, key).agg(F.lit(name).alias("item"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_ids"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages merged by id: the version stored last."""
    m = table(spark, sf_dir, "messages")
    early, late = m.filter("ingested_at < timestamp '2024-07-01'"), m.filter("ingested_at >= timestamp '2024-07-01' or ingested_at is null")
    return incremental.upsert(early, late, ["id"], "ingested_at").select("id", "session_id", "ingested_at", F.length("content").alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        file_incremental, deleted_files, content_hash_ids, classify_files, chunk_lines, chunk_paragraphs, chunk_messages, chunk_plans, chunk_plain, chunk_doc_files, chunk_symbols, symbol_truncated, doc_truncated, imports_exports, code_keywords, symbol_file_status,
        symbol_hierarchy, branch_symbols, branch_only_symbols, id_lists, plan_titles, title_words, project_paths, diff_line_counts, corpus_view, embedding_cache_miss, index_stats, status_summary, upsert_latest,
    )
}

_F = "f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified_at DESC) = 1)"
_T = "t AS (SELECT * FROM file_texts QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY read_at DESC) = 1)"
_P = "p AS (SELECT * FROM plans QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified_at DESC) = 1)"
_EXT = r"lower(regexp_extract({c}, '\.([^./]+)$', 1))"
# as text, so that a wrong list of the package shows
_LANG = """CASE WHEN e = 'rs' THEN 'rust' WHEN e = 'py' THEN 'python' WHEN e IN ('js', 'jsx') THEN 'javascript' WHEN e IN ('ts', 'tsx') THEN 'typescript' WHEN e = 'go' THEN 'go' WHEN e = 'java' THEN 'java' WHEN e IN ('c', 'h') THEN 'c'
  WHEN e IN ('cpp', 'cc', 'hpp') THEN 'cpp' WHEN e = 'cs' THEN 'csharp' WHEN e = 'rb' THEN 'ruby' WHEN e = 'php' THEN 'php' WHEN e = 'swift' THEN 'swift' WHEN e = 'kt' THEN 'kotlin' WHEN e = 'scala' THEN 'scala' WHEN e IN ('sh', 'bash') THEN 'bash'
  WHEN e IN ('zsh', 'fish', 'sql', 'json', 'toml', 'xml') THEN e WHEN e IN ('yaml', 'yml') THEN 'yaml' END"""
_SOURCE = "'rs','py','js','ts','jsx','tsx','go','java','c','cpp','cc','h','hpp','cs','rb','php','swift','kt','scala','sh','bash','zsh','fish','sql','json','yaml','yml','toml','xml'"
_LINES = r"string_split(regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '\n\z', ''), chr(10))"
_TRIMMED = "list_transform({l}, lambda x: trim(x))".replace("{l}", _LINES.replace("{c}", "content"))
_SPACE = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_FINE = "len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
SQL = {
    "file_incremental": f"""WITH {_F}, {_T}, a AS (SELECT file_id, sha256(content) AS h FROM t), b AS (SELECT id, content_hash AS h FROM f WHERE indexed)
        SELECT coalesce(a.file_id, b.id) AS file_id, CASE WHEN b.id IS NULL THEN 'new' WHEN a.file_id IS NULL THEN 'deleted' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.file_id = b.id""",
    "deleted_files": "SELECT DISTINCT file_id FROM symbols WHERE file_id IS NOT NULL AND file_id NOT IN (SELECT file_id FROM file_texts WHERE file_id IS NOT NULL)",
    "content_hash_ids": f"WITH {_F}, g AS (SELECT id, 'file:' || sha256(concat_ws('/', project_path, file_path)) AS path_id FROM f) SELECT id, path_id, id = path_id AS matches FROM g",
    "classify_files": f"""WITH {_F}, g AS (SELECT *, {_EXT.format(c='file_path')} AS e FROM f) SELECT CASE WHEN e IN ({_SOURCE}) THEN 'Source' WHEN e IN ('md','markdown','rst','txt','adoc','asciidoc') THEN 'Docs' ELSE 'Other' END AS kind,
        {_LANG} AS language, g.kind AS stored_kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM g GROUP BY ALL""",
    "chunk_lines": f"""WITH {_T}, l AS (SELECT file_id, {_LINES.format(c='content')} AS ls FROM t WHERE length(content) > 0), w AS (SELECT file_id, ls, unnest(range(0, CAST(greatest(ceil((len(ls) - 100) / 90), 0) AS BIGINT) + 1)) AS i FROM l)
        SELECT file_id, CAST(i * 90 + 1 AS INTEGER) AS start_line, CAST(least(i * 90 + 100, len(ls)) AS INTEGER) AS end_line, sha256(array_to_string(ls[i * 90 + 1 : i * 90 + 100], chr(10))) AS content_hash FROM w""",
    "chunk_paragraphs": r"""WITH n AS (SELECT doc_id, regexp_replace(text, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g') AS c FROM documents WHERE text IS NOT NULL),
        ps AS (SELECT doc_id, list_filter(list_transform(string_split_regex(c, '\r?\n\r?\n'), lambda x: regexp_replace(x, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g')), lambda x: x <> '') AS xs FROM n),
        packed AS (SELECT doc_id, string_split(list_reduce(xs, lambda a, x: CASE WHEN strlen(string_split(a, chr(1))[-1]) + strlen(x) + 2 <= 500 THEN a || chr(10) || chr(10) || x ELSE a || chr(1) || x END), chr(1)) AS cs FROM ps WHERE len(xs) > 0),
        u AS (SELECT *, unnest(range(len(cs))) AS i FROM packed) SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CAST(strlen(cs[i + 1]) AS INTEGER) AS n_bytes, sha256(cs[i + 1]) AS chunk_hash FROM u""",
    "chunk_plain": r"""WITH p AS (SELECT doc_id, string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[ \t\f\n]*\n') AS ps FROM documents WHERE text IS NOT NULL),
        c AS (SELECT doc_id, list_filter(list_transform(ps, lambda x: regexp_replace(regexp_replace(x, '[ \t\f]*\n[ \t\f]*', ' ', 'g'), '^[ \t\f]+|[ \t\f]+$', '', 'g')), lambda x: x <> '') AS cs FROM p),
        u AS (SELECT doc_id, cs, unnest(range(len(cs))) AS k FROM c) SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, CAST(length(cs[k + 1]) AS INTEGER) AS n_chars, sha256(cs[k + 1]) AS chunk_hash FROM u""",
    # no symbol of the test tables has more than 500 lines or 10000 bytes, so each is one block
    "chunk_symbols": "SELECT DISTINCT id, branch_name, 0 AS block, coalesce(start_line, 1) AS start_line, CAST(coalesce(start_line, 1) + len(string_split(code, chr(10))) - 1 AS INTEGER) AS end_line, code AS content FROM symbols WHERE code <> ''",
    "symbol_truncated": "SELECT DISTINCT id, branch_name, CASE WHEN strlen(code) > 1000 THEN left(code, 500) || '...' || chr(10) || '[truncated: ' || length(code) || ' total chars]' ELSE code END AS text FROM symbols",
    "doc_truncated": "SELECT doc_id, CASE WHEN strlen(text) > 500 THEN left(text, 500) || '...' ELSE text END AS preview FROM documents WHERE text IS NOT NULL",
    "imports_exports": rf"""WITH {_F}, {_T}, g AS (SELECT id, {_EXT.format(c='file_path')} AS e FROM f), h AS (SELECT file_id, {_LANG} AS lang, {_TRIMMED} AS ls FROM t JOIN g ON id = file_id)
        SELECT file_id, lang,
          coalesce(array_to_string(CASE WHEN lang = 'rust' THEN list_filter(ls, lambda x: regexp_matches(x, '^(?:pub )?use .*;$')) WHEN lang = 'python' THEN list_filter(ls, lambda x: regexp_matches(x, '^(?:import \w|from \S+ import )'))
            WHEN lang IN ('javascript', 'typescript') THEN list_filter(ls, lambda x: regexp_matches(x, '^import[ {{"'']')) ELSE [] END, '|'), '') AS imports,
          coalesce(array_to_string(CASE WHEN lang = 'rust' THEN list_filter(ls, lambda x: regexp_matches(x, '^pub (?:async |const |unsafe )*(?:fn|struct|enum|trait) ')) WHEN lang IN ('javascript', 'typescript') THEN list_filter(ls, lambda x: regexp_matches(x, '^export ')) ELSE [] END, '|'), '') AS exports
        FROM h""",
    "code_keywords": r"""WITH s AS (SELECT DISTINCT id, code FROM symbols WHERE code IS NOT NULL), k AS (
          SELECT id, unnest(list_filter(regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1), lambda w: length(w) > 2)) AS keyword FROM s
          UNION ALL SELECT id, unnest(list_filter(regexp_extract_all(code, '\b([A-Z][A-Za-z0-9]*)\b', 1), lambda w: length(w) BETWEEN 3 AND 49)) FROM s)
        SELECT keyword, count(DISTINCT id) AS n_symbols FROM k GROUP BY keyword""",
    "symbol_file_status": f"""WITH {_F}, s AS (SELECT id, branch_name, file_id, name FROM symbols QUALIFY row_number() OVER (PARTITION BY id, branch_name ORDER BY file_id DESC, name DESC) = 1)
        SELECT s.id, branch_name, name, file_path, coalesce(indexed, true) AS is_current FROM s LEFT JOIN f ON f.id = s.file_id""",
    "symbol_hierarchy": """WITH RECURSIVE m AS (SELECT DISTINCT id, parent_id, branch_name FROM symbols WHERE id IS NOT NULL), tree AS (SELECT branch_name, id, id AS root, 0 AS depth FROM m WHERE parent_id IS NULL
        UNION ALL SELECT m.branch_name, m.id, t.root, t.depth + 1 FROM m JOIN tree t ON m.parent_id = t.id AND m.branch_name IS NOT DISTINCT FROM t.branch_name) SELECT branch_name, root, max(depth) AS depth, count(*) AS n_symbols FROM tree GROUP BY ALL""",
    "branch_symbols": "SELECT branch_name, count(DISTINCT id) AS n_symbols, count(DISTINCT file_id) AS n_files FROM symbols GROUP BY 1",
    "branch_only_symbols": "SELECT DISTINCT id, branch_name FROM symbols WHERE branch_name <> 'main' AND id NOT IN (SELECT id FROM symbols WHERE branch_name = 'main')",
    "id_lists": "SELECT file_id, 0 AS block, CAST(count(DISTINCT id) AS INTEGER) AS n, sha256(string_agg(DISTINCT id, ',' ORDER BY id)) AS ids_hash FROM symbols WHERE id IS NOT NULL GROUP BY 1",
    "plan_titles": rf"""WITH {_P} SELECT id, coalesce(title, nullif(regexp_extract(content, '(?m)^# ([^\r\n]*)', 1), '')) AS title,
        coalesce(CAST(len(list_filter({_LINES.format(c='content')}, lambda x: regexp_matches(x, '^#{{1,6}} '))) AS INTEGER), 0) AS n_headings FROM p""",
    "title_words": f"""WITH {SESSIONS}, w AS (SELECT id, string_split(lower(title), ' ') AS ws FROM sessions WHERE title IS NOT NULL)
        SELECT id, coalesce(array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' '), '') AS words FROM w""",
    "project_paths": "WITH c AS (SELECT DISTINCT project_path, replace(replace(project_path, '-', '_'), '/', '-') AS encoded FROM chat_sessions) SELECT project_path, encoded, replace(replace(encoded, '-', '/'), '_', '-') AS decoded FROM c",
    "diff_line_counts": """SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) AS INTEGER) AS added,
        CAST(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS INTEGER) AS removed FROM documents WHERE text IS NOT NULL""",
    "corpus_view": rf"""WITH {_F}, {SESSIONS}, {_M}, {COMMITS}, {_P}, y AS (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY id, branch_name ORDER BY name DESC NULLS LAST, kind DESC NULLS LAST, doc_comment DESC NULLS LAST) = 1), u AS (
          SELECT 'File' AS content_type, CASE kind WHEN 'Source' THEN 'Source: ' WHEN 'Docs' THEN 'Documentation: ' ELSE 'File: ' END || file_path AS content FROM f
          UNION ALL SELECT 'Session', coalesce(title, 'Session in ' || project_path) FROM sessions UNION ALL SELECT 'Message', content FROM m
          UNION ALL SELECT 'Symbol', coalesce(name || ' - ' || nullif(regexp_extract(doc_comment, '^([^\r\n]*)', 1), ''), kind || ': "' || name || '"') FROM y
          UNION ALL SELECT 'Commit', regexp_extract(message, '^([^\r\n]*)', 1) FROM commits UNION ALL SELECT 'Plan', coalesce(title, '') FROM p)
        SELECT content_type, count(*) AS n_items, CAST(coalesce(sum(length(content)), 0) AS BIGINT) AS n_chars, min(content) AS first_content FROM u GROUP BY 1""",
    "embedding_cache_miss": "SELECT DISTINCT vec_id FROM embedding_data WHERE vec_id IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM cache_entries WHERE vec_id IS NOT NULL)",
    "index_stats": f"""WITH e AS (SELECT *, coalesce({_FINE}, false) AS fine FROM embedding_data) SELECT model, count(*) AS processed, count(*) FILTER (fine) AS embedded, count(*) FILTER (NOT fine) AS errors,
        count(DISTINCT request_id) AS requests, round(count(*) FILTER (fine) / count(*), 6) AS success_rate FROM e GROUP BY model""",
    "status_summary": " UNION ALL ".join(
        f"SELECT '{n}' AS item, count(*) AS n_rows, count(DISTINCT {k}) AS n_ids FROM {n}"
        for n, k in (("chat_sessions", "id"), ("messages", "id"), ("files", "id"), ("symbols", "id"), ("plans", "id"), ("file_chunks", "chunk_id"), ("cache_entries", "vec_id"), ("embedding_data", "vec_id"), ("documents", "doc_id"))
    ),
    "upsert_latest": f"WITH {_M} SELECT id, session_id, ingested_at, CAST(length(content) AS INTEGER) AS n_chars FROM m",
}
