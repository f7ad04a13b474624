"""Text functions as column expressions: commits, topics, paths, titles, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types of conventional commits.
COMMIT_TYPES = ["feat", "fix", "docs", "style", "refactor", "perf", "test", "build", "ci", "chore", "revert"]
#: Extensions of source and documentation files, and languages by extension.
SOURCE_EXTENSIONS = "rs py js ts jsx tsx go java c cpp cc h hpp cs rb php swift kt scala sh bash zsh fish sql json yaml yml toml xml".split()
DOC_EXTENSIONS = "md markdown rst txt adoc asciidoc".split()
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "c": "c", "cpp": "cpp", "cc": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "rb": "ruby",
    "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "bash", "bash": "bash", "zsh": "zsh", "fish": "fish", "sql": "sql", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml",
}
#: Extensions by which a search for code, or for documentation, picks files.
CODE_SEARCH = "rs py js ts tsx jsx go java kt kts c cpp cc cxx h hpp hxx cs fs fsx vb swift scala rb php sh bash zsh fish ps1 psm1 yaml yml json toml xml cfg ini sql graphql wsdl proto".split()
DOC_SEARCH = "md markdown rst txt adoc asciidoc html htm pdf doc docx".split()


def first_line(text: Column) -> Column:
    return F.regexp_extract(text, r"^([^\r\n]*)", 1)


def commit_type(message: Column) -> Column:
    """The conventional type that the first line begins with, else null."""
    found = F.regexp_extract(first_line(message), rf"^({'|'.join(COMMIT_TYPES)})(?:\(|!?:)", 1)
    return F.nullif(found, F.lit(""))


def commit_scope(message: Column) -> Column:
    found = F.regexp_extract(first_line(message), rf"^(?:{'|'.join(COMMIT_TYPES)})\(([^)]*)\)", 1)
    return F.nullif(found, F.lit(""))


def is_breaking(message: Column) -> Column:
    """``!:`` in the first line, or a BREAKING CHANGE footer."""
    return F.contains(first_line(message), F.lit("!:")) | message.rlike(r"(?i)\n[^\n]*BREAKING[ -]CHANGE")


def breaking_text(message: Column) -> Column:
    """What a breaking commit says about it: the summary after ``!:``, else the footer's text."""
    footer = F.nullif(F.regexp_extract(message, r"(?i)\nBREAKING[ -]CHANGE: *([^\r\n]*)", 1), F.lit(""))
    summary = F.nullif(F.trim(F.regexp_extract(first_line(message), r"!:(.*)$", 1)), F.lit(""))
    return F.coalesce(summary, footer)


def topic(text: Column) -> Column:
    """Scope of a conventional line, else what is before its colon, else its first word, else general."""
    line = first_line(text)
    before = F.regexp_extract(line, r"^([^:]*):", 1)
    scope = F.nullif(F.regexp_extract(before, r"\(([^)]*)\)", 1), F.lit(""))
    word = F.nullif(F.regexp_extract(line, r"^\s*(\S+)", 1), F.lit(""))
    return F.when(F.contains(line, F.lit(":")), F.coalesce(scope, F.nullif(F.trim(before), F.lit("")), F.lit("general"))).otherwise(F.coalesce(word, F.lit("general")))


def matches_topic(text: Column, wanted: str) -> Column:
    return F.contains(F.lower(text), F.lit(wanted.lower())) | (F.lower(topic(text)) == wanted.lower())


def truncate(text: Column, limit: int = 500) -> Column:
    """Texts of more than ``limit`` bytes are cut to that many characters and marked."""
    return F.when(F.octet_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_kind(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(SOURCE_EXTENSIONS), "Source").when(ext.isin(DOC_EXTENSIONS), "Docs").otherwise("Other")


def language(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension(path)]


def encode_project_path(path: Column) -> Column:
    """A path as a folder name: ``-`` becomes ``_`` and then ``/`` becomes ``-``."""
    return F.replace(F.replace(path, F.lit("-"), F.lit("_")), F.lit("/"), F.lit("-"))


def decode_project_path(name: Column) -> Column:
    """Undoes :func:`encode_project_path` up to ``_``, which may have been there before."""
    return F.replace(F.replace(name, F.lit("-"), F.lit("/")), F.lit("_"), F.lit("-"))


def markdown_title(text: Column) -> Column:
    """The first heading of level one, else null."""
    return F.nullif(F.regexp_extract(text, r"(?m)^# ([^\r\n]*)", 1), F.lit(""))


def lines(text: Column) -> Column:
    """Lines without their ends; a last line end makes no further line."""
    unified = F.regexp_replace(text, r"\r\n?", "\n")
    return F.split(F.regexp_replace(unified, r"\n\z", ""), "\n")


def changed_lines(diff: Column, sign: str) -> Column:
    """Lines that a unified diff adds (``+``) or removes (``-``); file headers don't count."""
    return F.size(F.filter(F.split(diff, "\n"), lambda x: F.startswith(x, F.lit(sign)) & ~F.startswith(x, F.lit(sign * 3))))


def imports(text: Column, lang: Column) -> Column:
    """Import statements of a source text, in order."""
    rows = F.transform(lines(text), lambda x: F.trim(x))
    rust = F.filter(rows, lambda x: x.rlike(r"^(?:pub )?use .*;$"))
    python = F.filter(rows, lambda x: x.rlike(r"^(?:import \w|from \S+ import )"))
    script = F.filter(rows, lambda x: x.rlike(r"^import[ {\"']"))
    return F.when(lang == "rust", rust).when(lang == "python", python).when(lang.isin("javascript", "typescript"), script).otherwise(F.array().cast("array<string>"))


def exports(text: Column, lang: Column) -> Column:
    """Public items of a source text: lines that declare them, in order."""
    rows = F.transform(lines(text), lambda x: F.trim(x))
    rust = F.filter(rows, lambda x: x.rlike(r"^pub (?:async |const |unsafe )*(?:fn|struct|enum|trait) "))
    script = F.filter(rows, lambda x: x.rlike(r"^export "))
    return F.when(lang == "rust", rust).when(lang.isin("javascript", "typescript"), script).otherwise(F.array().cast("array<string>"))


def keywords(text: Column) -> Column:
    """Names before an opening bracket and capitalised words, each once, in order of appearance by kind."""
    called = F.filter(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)), lambda w: F.length(w) > 2)
    capital = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Za-z0-9]*)\b"), F.lit(1)), lambda w: (F.length(w) >= 3) & (F.length(w) <= 49))
    return F.array_distinct(F.concat(called, capital))


def commit_description(message: Column) -> Column:
    """A commit's type, scope and summary, with a mark on breaking ones; the summary's own prefix is not repeated."""
    kind, scope, summary = commit_type(message), commit_scope(message), first_line(message)
    bare = F.when(kind.isNotNull(), F.regexp_replace(summary, r"^[a-z]+(?:\([^)]*\))?!?:\s*", "")).otherwise(summary)
    prefix = F.when(kind.isNull(), F.lit("")).when(scope.isNull(), F.concat(kind, F.lit(": "))).otherwise(F.concat(kind, F.lit("("), scope, F.lit("): ")))
    return F.concat(prefix, bare, F.when(is_breaking(message), F.lit(" [BREAKING]")).otherwise(F.lit("")))


def session_description(title: Column, id_: Column) -> Column:
    return F.coalesce(title, F.concat(F.lit("Session "), id_))


def commit_link(hash_: Column, base: str | None) -> Column:
    """Address of a commit below ``base``, or its short hash."""
    short = F.left(hash_, F.lit(7))
    return F.concat(F.lit(f"{base}/commit/"), short) if base else short


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def legacy_project_path(path: Column) -> Column:
    """The older folder name of a path: only ``/`` is replaced."""
    return F.replace(path, F.lit("/"), F.lit("-"))


def file_summary(path: Column, lang: Column, content: Column) -> Column:
    """Path, language (where known) and the first five lines of a file."""
    head = F.array_join(F.slice(lines(content), 1, 5), "\n")
    return F.concat(F.lit("File: "), path, F.coalesce(F.concat(F.lit("\nLanguage: "), lang), F.lit("")), F.when(F.length(content) > 0, F.concat(F.lit("\n\n"), head)).otherwise(F.lit("")))


def code_chunk(kind: Column, name: Column, path: Column, start: Column, end: Column, branch: Column, doc: Column, code: Column) -> Column:
    """A symbol's code with its place, branch and documentation, each line set in by one space."""
    told = F.when(F.trim(doc) != "", F.concat(F.lit("\n Doc: "), F.trim(doc), F.lit("\n"))).otherwise(F.lit(""))
    body = F.array_join(F.transform(lines(code), lambda x: F.concat(F.lit(" "), x, F.lit("\n"))), "")
    return F.concat(
        kind, F.lit(": "), name, F.lit("\n File: "), path, F.lit(" (lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")\n Branch: "), branch, F.lit("\n"), F.coalesce(told, F.lit("")), F.lit("\n Code:\n"), body
    )


def import_summary(imports_: Column, exports_: Column) -> Column:
    """Imports and exports of a file as text; empty if it has none."""
    def part(title: str, xs: Column) -> Column:
        return F.when(F.size(xs) > 0, F.concat(F.lit(title), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("  - "), x, F.lit("\n"))), ""))).otherwise(F.lit(""))

    return F.concat(part("Imports:\n", imports_), part("\nExports:\n", exports_))


def watched_type(path: Column) -> Column:
    """What a changed file is to a watcher, by its extension as it is written: Session, Doc, Source or null."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.when(ext == "jsonl", "Session").when(ext.isin("md", "rst", "txt"), "Doc").when(ext.isin("rs", "js", "ts", "py", "go", "java"), "Source")
