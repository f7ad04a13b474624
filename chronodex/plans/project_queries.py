"""Queries on projects, their plans, history and index state, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, text
from ..functions.scoring import age_text_short, epoch
from ..operators import incremental, timeline
from ..operators.ordered import bucketed_rank
from ..tables import files, latest, messages, plans, table
from .search_queries import AS_OF, now
from .timeline_queries import _M, COMMITS, EVENTS, SESSIONS, _timeline, _topic_sql, commits, sessions

#: Files and folders whose presence in a project a plan's mention is checked against.
MANIFESTS = ["Cargo.toml", "package.json", "pyproject.toml", "go.mod"]
FOLDERS = ["docs/", "tests/", "lib/"]
REPOSITORY = "https://forge.example/app"


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "files", "project_path").unionByName(table(spark, sf_dir, "chat_sessions", "project_path"))
    return both.filter("project_path is not null and project_path <> ''").distinct()


def match_plans(plans: DataFrame, projects: DataFrame, files: DataFrame) -> DataFrame:
    """``plan_id``, ``project_path``, ``level`` (1 surest to 4): the projects that a plan names or refers to.

    ``plans`` has id and content, ``projects`` project_path, ``files`` project_path and file_path. 1: the plan
    holds the project's whole path; 2: its last two parts; 3: a source file, manifest or folder that it
    names exists there; 4: the project's name. What a plan holds is taken apart into words and paths,
    and these meet the projects by equi-joins. Plans without content match nothing.
    """
    content = plans.filter("content is not null").select(F.col("id").alias("plan_id"), "content")
    every = lambda pattern: F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)))
    paths = content.select("plan_id", F.explode(every(r"/?[\w.\-]+(?:/[\w.\-]+)+")).alias("p"))
    parts = F.split(F.regexp_replace("p", "^/", ""), "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    whole = paths.filter(F.startswith("p", F.lit("/"))).select("plan_id", F.explode(heads).alias("project_path")).join(projects, "project_path", "left_semi")
    pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, n, F.lit(2)), "/"))
    tail = projects.select("project_path", F.regexp_extract("project_path", r"([^/]+/[^/]+)$", 1).alias("tail"), F.regexp_extract("project_path", r"([^/]+)$", 1).alias("name"))
    two = paths.select("plan_id", F.explode(pairs).alias("tail")).distinct().join(tail.filter("tail <> ''"), "tail").select("plan_id", "project_path")
    named = content.select("plan_id", F.explode(F.array_union(every(r"src/[a-z_/\-]+\.rs"), F.filter(F.array(*map(F.lit, MANIFESTS + FOLDERS)), lambda x: F.contains(F.col("content"), x)))).alias("ref"))
    folder = F.concat(F.substring_index("file_path", "/", 1), F.lit("/"))
    there = files.select("project_path", F.explode(F.array_distinct(F.array("file_path", folder))).alias("ref")).filter("ref is not null").distinct()
    referred = named.join(there, "ref").select("plan_id", "project_path")
    words = content.select("plan_id", F.explode(every(r"[\w\-]+")).alias("name")).distinct().join(tail.filter("name <> ''"), "name").select("plan_id", "project_path")
    found = reduce(DataFrame.unionByName, [df.select("plan_id", "project_path", F.lit(n).alias("level")) for n, df in enumerate((whole, two, referred, words), 1)])
    return found.groupBy("plan_id", "project_path").agg(F.min("level").alias("level"))


def plan_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans and the projects they belong to, with the level of the match."""
    return match_plans(plans(spark, sf_dir, "content"), projects(spark, sf_dir), files(spark, sf_dir, "project_path", "file_path"))


def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits that touched each file: those of its symbols, with the address of each commit."""
    touched = table(spark, sf_dir, "symbols", "file_id", "last_commit_hash").filter("last_commit_hash is not null").distinct()
    f = files(spark, sf_dir, "project_path", "file_path").select(F.col("id").alias("file_id"), "project_path", "file_path")
    out = touched.join(f, "file_id")
    return out.select("project_path", text.forward_slashes(F.col("file_path")).alias("file_path"), F.col("last_commit_hash").alias("commit_id"), text.commit_link(F.col("last_commit_hash"), REPOSITORY).alias("link"))


def folder_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits that touched any file below ``src/``."""
    inside = files(spark, sf_dir, "file_path").filter(F.startswith("file_path", F.lit("src/"))).select(F.col("id").alias("file_id"))
    return table(spark, sf_dir, "symbols", "file_id", "last_commit_hash").filter("last_commit_hash is not null").join(inside, "file_id", "left_semi").select(F.col("last_commit_hash").alias("commit_id")).distinct()


def commits_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits after a time, itself left out."""
    rows = commits(spark, sf_dir).filter(F.col("ts") > F.lit("2025-01-01").cast("timestamp_ntz"))
    m = F.col("message")
    return rows.select("id", "ts", text.commit_description(m).alias("description"))


def plan_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans to index: new ones, and those modified after they were indexed first."""
    state = table(spark, sf_dir, "plans", "id", "modified_at", "indexed").filter("indexed").groupBy("id").agg(F.min("modified_at").alias("indexed_at"))
    return incremental.to_index(plans(spark, sf_dir, "indexed"), state, "id", "modified_at", "indexed_at")


def session_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions to index: new ones, other numbers of messages than stored, or a message stored after the session's end."""
    counted = messages(spark, sf_dir, "session_id").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("ingested_at").alias("last_at"))
    s = sessions(spark, sf_dir).filter("indexed").select(F.col("id").alias("session_id"), "message_count", "ended_at")
    reason = F.when(F.col("message_count").isNull() & F.col("ended_at").isNull() & F.col("known").isNull(), "new").when(~F.col("message_count").eqNullSafe(F.col("n_messages")), "count").when(F.col("last_at") > F.col("ended_at"), "later")
    out = counted.filter("session_id is not null").join(s.withColumn("known", F.lit(True)), "session_id", "left").withColumn("reason", reason)
    return out.filter("reason is not null").select("session_id", "reason")


def file_incremental_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files by content hash or by time: the text was read after the row was modified last."""
    stored = files(spark, sf_dir, "content_hash", "indexed").filter("indexed").select(F.col("id").alias("file_id"), F.col("content_hash").alias("hash"), F.col("modified_at").alias("at"))
    current = latest(table(spark, sf_dir, "file_texts"), ["file_id"], "read_at").select("file_id", F.sha2("content", 256).alias("hash"), F.col("read_at").alias("at"))
    return incremental.change_set(current, stored, "file_id", "hash", "at")


def reindex_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental run writes: the chunks of new and changed files, and a removal for each deleted one."""
    texts = latest(table(spark, sf_dir, "file_texts"), ["file_id"], "read_at")
    stored = files(spark, sf_dir, "content_hash", "indexed").filter("indexed").select(F.col("id").alias("file_id"), F.col("content_hash").alias("hash"))
    changes = incremental.change_set(texts.select("file_id", F.sha2("content", 256).alias("hash")), stored, "file_id", "hash")
    wanted = texts.join(changes.filter("change in ('new', 'changed')"), "file_id")
    put = wanted.select("file_id", F.lit("upsert").alias("action"), F.explode(chunking.line_windows(F.col("content"))).alias("c")).select("file_id", "action", "c.start_line", "c.end_line")
    gone = changes.filter("change = 'deleted'").select("file_id", F.lit("delete").alias("action"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    return put.unionByName(gone)


def without_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols left after the branch ``dev`` has been cleared."""
    s = table(spark, sf_dir, "symbols", "id", "branch_name").distinct()
    return incremental.clear_branch(s, "dev").groupBy("branch_name").agg(F.count(F.lit(1)).alias("n_symbols"))


def index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each item was indexed last: the stored states with those of the present run merged in."""
    plan = table(spark, sf_dir, "plans", "id", "modified_at", "indexed").filter("indexed").select("id", F.col("modified_at").alias("indexed_at"))
    done = plans(spark, sf_dir).select("id", F.lit(AS_OF).cast("timestamp_ntz").alias("indexed_at"))
    return incremental.set_index_state(plan, done.filter("id like 'm%'"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of text per event of the timeline, as it is shown."""
    git = commits(spark, sf_dir).filter("ts is not null").select(F.col("id").cast("string").alias("event_id"), "ts", F.lit("GitChange").alias("event_type"), text.commit_description(F.col("message")).alias("description"))
    talk = sessions(spark, sf_dir).filter("started_at is not null").select(F.col("id").alias("event_id"), F.col("started_at").alias("ts"), F.lit("Discussion").alias("event_type"), text.session_description(F.col("title"), F.col("id")).alias("description"))
    rows = git.unionByName(talk)
    return rows.select("event_id", timeline.event_line(F.col("event_type"), F.col("description"), age_text_short(epoch(now()) - epoch(F.col("ts")))).alias("line"))


def timeline_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each topic in the order of time, numbered; a topic is not one task."""
    t = _timeline(spark, sf_dir).withColumn("topic", text.topic(F.col("content")))
    return bucketed_rank(t, "topic", ["ts", "event_id"], F.date_trunc("month", "ts"), "place").select("topic", "place", "event_id", "ts")


def code_chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols as texts with their place, branch and documentation."""
    s = table(spark, sf_dir, "symbols", "id", "branch_name", "file_id", "name", "kind", "start_line", "end_line", "doc_comment", "code").distinct()
    f = files(spark, sf_dir, "file_path").select(F.col("id").alias("file_id"), "file_path")
    c = [F.col(x) for x in ("kind", "name", "file_path", "start_line", "end_line", "branch_name", "doc_comment", "code")]
    return s.join(f, "file_id").select("id", "branch_name", F.sha2(text.code_chunk(*c), 256).alias("text_hash")).distinct()


def file_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's summary, and its imports and exports as text."""
    f = files(spark, sf_dir, "file_path").select(F.col("id").alias("file_id"), "file_path", text.language(F.col("file_path")).alias("lang"))
    rows = latest(table(spark, sf_dir, "file_texts"), ["file_id"], "read_at").join(f, "file_id")
    c, lang = F.col("content"), F.col("lang")
    return rows.select("file_id", text.file_summary(F.col("file_path"), lang, c).alias("summary"), text.import_summary(text.imports(c, lang), text.exports(c, lang)).alias("names"))


def extracted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all symbols and a summary chunk of each file, as one table."""
    s = table(spark, sf_dir, "symbols", "id", "branch_name", "name", "kind", "doc_comment", "code", "start_line").distinct()
    header = text_header(F.col("kind"), F.col("name"), F.col("doc_comment"))
    rows = s.select("id", "branch_name", F.explode(chunking.chunk_symbol("code", "start_line", header)).alias("c"))
    symbols = rows.select("id", "branch_name", F.lit("symbol").alias("chunk_kind"), F.col("c.block").alias("block"), F.sha2("c.content", 256).alias("content_hash"))
    names = file_summaries(spark, sf_dir).filter("names <> ''").select(F.col("file_id").alias("id"), F.lit("file_summary").alias("chunk_kind"), F.lit(0).alias("block"), F.sha2("names", 256).alias("content_hash"))
    return symbols.unionByName(names, allowMissingColumns=True).distinct()


def text_header(kind, name, doc):
    """What stands before a symbol's code in its chunk: kind and name, and its documentation as a code block."""
    return F.concat(kind, F.lit(": "), name, F.lit("\n"), F.coalesce(F.concat(F.lit("```\n"), doc, F.lit("\n```\n")), F.lit("")))


def watched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by what a watcher would take a change of them for."""
    kind = F.coalesce(text.watched_type(F.col("file_path")), F.lit("ignored"))
    return files(spark, sf_dir, "file_path").groupBy(kind.alias("watched_as")).agg(F.count(F.lit(1)).alias("n"))


def legacy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("project_path")
    return projects(spark, sf_dir).select("project_path", text.encode_project_path(p).alias("encoded"), text.legacy_project_path(p).alias("legacy"))


def session_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and characters that each day's messages add to a session."""
    m = messages(spark, sf_dir, "session_id", "content", "timestamp").filter("session_id is not null and timestamp is not null")
    return m.groupBy("session_id", F.to_date("timestamp").cast("string").alias("day")).agg(F.sum(F.size(text.lines(F.coalesce("content", F.lit(""))))).alias("n_lines"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("n_chars"))


def known_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests and folders that plans name and that exist in some project."""
    named = plans(spark, sf_dir, "content").select(F.explode(F.filter(F.array(*map(F.lit, MANIFESTS + FOLDERS)), lambda x: F.contains(F.col("content"), x))).alias("ref"))
    folder = F.concat(F.substring_index("file_path", "/", 1), F.lit("/"))
    there = files(spark, sf_dir, "file_path").select(F.explode(F.array("file_path", folder)).alias("ref"))
    return named.intersect(there)


QUERIES = {
    f.__name__: f
    for f in (
        plan_match, file_history, folder_commits, commits_since, plan_incremental, session_incremental, file_incremental_time, reindex_chunks, without_branch, index_state, event_lines, timeline_clusters, code_chunk_texts, file_summaries, extracted_chunks, watched_files,
        legacy_paths, session_line_counts, known_references,
    )
}

_F = "f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified_at DESC) = 1)"
_T = "t AS (SELECT * FROM file_texts QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY read_at DESC) = 1)"
_P = "p AS (SELECT * FROM plans QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified_at DESC) = 1)"
_G = "g AS (SELECT project_path FROM files UNION SELECT project_path FROM chat_sessions), pr AS (SELECT project_path FROM g WHERE project_path IS NOT NULL AND project_path <> '')"
_REFS = "'Cargo.toml', 'package.json', 'pyproject.toml', 'go.mod', 'docs/', 'tests/', 'lib/'"
_L = r"regexp_extract(message, '^([^\r\n]*)', 1)"
_TYPES = "feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert"
_KIND = rf"nullif(regexp_extract({_L}, '^({_TYPES})(?:\(|!?:)', 1), '')"
_SCOPE = rf"nullif(regexp_extract({_L}, '^(?:{_TYPES})\(([^)]*)\)', 1), '')"
_DESC = rf"""CASE WHEN {_KIND} IS NULL THEN '' WHEN {_SCOPE} IS NULL THEN {_KIND} || ': ' ELSE {_KIND} || '(' || {_SCOPE} || '): ' END
  || CASE WHEN {_KIND} IS NULL THEN {_L} ELSE regexp_replace({_L}, '^[a-z]+(?:\([^)]*\))?!?:\s*', '') END || CASE WHEN contains({_L}, '!:') OR regexp_matches(message, '(?i)\n[^\n]*BREAKING[ -]CHANGE') THEN ' [BREAKING]' ELSE '' END"""
_AGO = f"CAST(epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts)) AS BIGINT)"
_SHORT = f"CASE WHEN {_AGO} < 60 THEN 'just now' WHEN {_AGO} < 3600 THEN ({_AGO} // 60) || 'm ago' WHEN {_AGO} < 86400 THEN ({_AGO} // 3600) || 'h ago' WHEN {_AGO} < 604800 THEN ({_AGO} // 86400) || 'd ago' ELSE ({_AGO} // 604800) || 'w ago' END"
_LINES = r"string_split(regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '\n\z', ''), chr(10))"
_LANG = """CASE lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript'
  WHEN 'json' THEN 'json' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'toml' THEN 'toml' WHEN 'xml' THEN 'xml' WHEN 'sh' THEN 'bash' WHEN 'sql' THEN 'sql' END"""
_NAMES = rf"""h AS (SELECT file_id, file_path, content, {_LANG} AS lang, list_transform({_LINES.format(c='content')}, lambda x: trim(x)) AS ls FROM t JOIN f ON f.id = t.file_id),
  n AS (SELECT file_id, file_path, content, lang,
    CASE WHEN lang = 'rust' THEN list_filter(ls, lambda x: regexp_matches(x, '^(?:pub )?use .*;$')) WHEN lang = 'python' THEN list_filter(ls, lambda x: regexp_matches(x, '^(?:import \w|from \S+ import )')) WHEN lang IN ('javascript', 'typescript') THEN list_filter(ls, lambda x: regexp_matches(x, '^import[ {{"'']')) ELSE [] END AS im,
    CASE WHEN lang = 'rust' THEN list_filter(ls, lambda x: regexp_matches(x, '^pub (?:async |const |unsafe )*(?:fn|struct|enum|trait) ')) WHEN lang IN ('javascript', 'typescript') THEN list_filter(ls, lambda x: regexp_matches(x, '^export ')) ELSE [] END AS ex FROM h),
  s AS (SELECT file_id, file_path, content, lang, CASE WHEN len(im) > 0 THEN 'Imports:' || chr(10) || array_to_string(list_transform(im, lambda x: '  - ' || x || chr(10)), '') ELSE '' END
    || CASE WHEN len(ex) > 0 THEN chr(10) || 'Exports:' || chr(10) || array_to_string(list_transform(ex, lambda x: '  - ' || x || chr(10)), '') ELSE '' END AS names FROM n)"""
_CHANGES = "c AS (SELECT coalesce(a.file_id, b.id) AS file_id, CASE WHEN b.id IS NULL THEN 'new' WHEN a.file_id IS NULL THEN 'deleted' WHEN {same} THEN 'unchanged' ELSE 'changed' END AS change FROM (SELECT file_id, sha256(content) AS h, read_at FROM t) a FULL JOIN (SELECT id, content_hash AS h, modified_at FROM f WHERE indexed) b ON a.file_id = b.id)"
SQL = {
    "plan_match": rf"""WITH {_P}, {_F}, {_G}, n AS (SELECT *, regexp_extract(project_path, '([^/]+/[^/]+)$', 1) AS tail, regexp_extract(project_path, '([^/]+)$', 1) AS name FROM pr),
        r AS (SELECT id, unnest(list_distinct(list_concat(regexp_extract_all(content, 'src/[a-z_/\-]+\.rs'), list_filter([{_REFS}], lambda x: contains(content, x))))) AS ref FROM p WHERE content IS NOT NULL),
        x AS (SELECT DISTINCT r.id, f.project_path FROM r JOIN f ON r.ref = f.file_path OR r.ref = split_part(f.file_path, '/', 1) || '/')
        SELECT p.id AS plan_id, n.project_path, CAST(CASE WHEN contains(content, n.project_path) THEN 1 WHEN tail <> '' AND contains(content, tail) THEN 2 WHEN x.id IS NOT NULL THEN 3 ELSE 4 END AS INTEGER) AS level
        FROM p CROSS JOIN n LEFT JOIN x ON x.id = p.id AND x.project_path = n.project_path WHERE content IS NOT NULL AND (contains(content, n.project_path) OR tail <> '' AND contains(content, tail) OR x.id IS NOT NULL OR name <> '' AND contains(content, name))""",
    "file_history": f"WITH {_F} SELECT DISTINCT project_path, replace(file_path, chr(92), '/') AS file_path, last_commit_hash AS commit_id, '{REPOSITORY}/commit/' || left(last_commit_hash, 7) AS link FROM symbols s JOIN f ON f.id = s.file_id WHERE last_commit_hash IS NOT NULL",
    "folder_commits": f"WITH {_F} SELECT DISTINCT last_commit_hash AS commit_id FROM symbols WHERE last_commit_hash IS NOT NULL AND file_id IN (SELECT id FROM f WHERE starts_with(file_path, 'src/'))",
    "commits_since": f"WITH {COMMITS} SELECT id, ts, {_DESC} AS description FROM commits WHERE ts > TIMESTAMP '2025-01-01'",
    "plan_incremental": f"WITH {_P}, s AS (SELECT id, min(modified_at) AS since FROM plans WHERE indexed GROUP BY 1) SELECT p.id, CASE WHEN s.id IS NULL THEN 'new' ELSE 'later' END AS reason FROM p LEFT JOIN s ON s.id = p.id WHERE s.id IS NULL OR modified_at > since",
    "session_incremental": f"""WITH {_M}, {SESSIONS}, n AS (SELECT session_id, count(*) AS n, max(ingested_at) AS last FROM m WHERE session_id IS NOT NULL GROUP BY 1),
        r AS (SELECT session_id, CASE WHEN s.id IS NULL THEN 'new' WHEN message_count IS DISTINCT FROM n THEN 'count' WHEN last > ended_at THEN 'later' END AS reason FROM n LEFT JOIN (SELECT * FROM sessions WHERE indexed) s ON s.id = session_id) SELECT * FROM r WHERE reason IS NOT NULL""",
    "file_incremental_time": f"WITH {_F}, {_T}, {_CHANGES.format(same='a.h IS NOT DISTINCT FROM b.h AND NOT coalesce(a.read_at > b.modified_at, false)')} SELECT file_id, change FROM c",
    "reindex_chunks": f"""WITH {_F}, {_T}, {_CHANGES.format(same='a.h IS NOT DISTINCT FROM b.h')}, l AS (SELECT t.file_id, len({_LINES.format(c='content')}) AS n FROM t JOIN c ON c.file_id = t.file_id WHERE change IN ('new', 'changed') AND length(content) > 0),
        w AS (SELECT file_id, n, unnest(range(0, CAST(greatest(ceil((n - 100) / 90), 0) AS BIGINT) + 1)) AS i FROM l)
        SELECT file_id, 'upsert' AS action, CAST(i * 90 + 1 AS INTEGER) AS start_line, CAST(least(i * 90 + 100, n) AS INTEGER) AS end_line FROM w UNION ALL SELECT file_id, 'delete', NULL, NULL FROM c WHERE change = 'deleted'""",
    "without_branch": "SELECT branch_name, count(DISTINCT id) AS n_symbols FROM symbols WHERE branch_name <> 'dev' GROUP BY 1",
    "index_state": f"WITH {_P}, s AS (SELECT id, modified_at AS done FROM plans WHERE indexed UNION ALL SELECT id, TIMESTAMP '{AS_OF}' FROM p WHERE id LIKE 'm%') SELECT id, max(done) AS indexed_at FROM s GROUP BY 1",
    "event_lines": f"""WITH {COMMITS}, {SESSIONS} SELECT CAST(id AS VARCHAR) AS event_id, '📜 **Git Change** - ' || {_DESC} || ' (' || {_SHORT} || ')' AS line FROM commits WHERE ts IS NOT NULL
        UNION ALL SELECT id, '💬 **Discussion** - ' || coalesce(title, 'Session ' || id) || ' (' || {_SHORT} || ')' FROM (SELECT id, title, started_at AS ts FROM sessions) WHERE ts IS NOT NULL""",
    "timeline_clusters": f"WITH {EVENTS}, k AS (SELECT {_topic_sql('content')} AS topic, event_id, ts FROM events_) SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY ts, event_id) AS INTEGER) AS place, event_id, ts FROM k",
    "code_chunk_texts": rf"""WITH {_F}, s AS (SELECT DISTINCT id, branch_name, file_id, name, kind, start_line, end_line, doc_comment, code FROM symbols),
        x AS (SELECT s.id, branch_name, s.kind || ': ' || name || chr(10) || ' File: ' || file_path || ' (lines ' || start_line || '-' || end_line || ')' || chr(10) || ' Branch: ' || branch_name || chr(10)
          || coalesce(CASE WHEN trim(doc_comment) <> '' THEN chr(10) || ' Doc: ' || trim(doc_comment) || chr(10) END, '') || chr(10) || ' Code:' || chr(10) || array_to_string(list_transform({_LINES.format(c='code')}, lambda x: ' ' || x || chr(10)), '') AS t FROM s JOIN f ON f.id = s.file_id)
        SELECT DISTINCT id, branch_name, sha256(t) AS text_hash FROM x""",
    "file_summaries": rf"""WITH {_F}, {_T}, {_NAMES} SELECT file_id, 'File: ' || file_path || coalesce(chr(10) || 'Language: ' || lang, '') || CASE WHEN length(content) > 0 THEN chr(10) || chr(10) || array_to_string(({_LINES.format(c='content')})[1:5], chr(10)) ELSE '' END AS summary, names FROM s""",
    "extracted_chunks": rf"""WITH {_F}, {_T}, {_NAMES} SELECT DISTINCT id, branch_name, 'symbol' AS chunk_kind, 0 AS block, sha256(kind || ': ' || name || chr(10) || coalesce('```' || chr(10) || doc_comment || chr(10) || '```' || chr(10), '') || code) AS content_hash FROM symbols WHERE code <> ''
        UNION ALL SELECT file_id, NULL, 'file_summary', 0, sha256(names) FROM s WHERE names <> ''""",
    "watched_files": rf"""WITH {_F}, e AS (SELECT regexp_extract(file_path, '\.([^./]+)$', 1) AS e FROM f) SELECT CASE WHEN e = 'jsonl' THEN 'Session' WHEN e IN ('md', 'rst', 'txt') THEN 'Doc' WHEN e IN ('rs', 'js', 'ts', 'py', 'go', 'java') THEN 'Source' ELSE 'ignored' END AS watched_as, count(*) AS n FROM e GROUP BY 1""",
    "legacy_paths": f"WITH {_G} SELECT project_path, replace(replace(project_path, '-', '_'), '/', '-') AS encoded, replace(project_path, '/', '-') AS legacy FROM pr",
    "session_line_counts": f"WITH {_M} SELECT session_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, CAST(sum(len({_LINES.format(c="coalesce(content, '')")})) AS BIGINT) AS n_lines, CAST(sum(length(coalesce(content, ''))) AS BIGINT) AS n_chars FROM m WHERE session_id IS NOT NULL AND timestamp IS NOT NULL GROUP BY ALL",
    "known_references": f"WITH {_P}, {_F}, r AS (SELECT unnest(list_filter([{_REFS}], lambda x: contains(content, x))) AS ref FROM p) SELECT ref FROM r INTERSECT (SELECT file_path FROM f UNION SELECT split_part(file_path, '/', 1) || '/' FROM f)",
}
