"""Chunkers: one text in, an array of chunks out.

What is a window, a split or a fold is a column expression and stays in the JVM. Parsers with state
(sentences, markdown) are small Python functions behind one Arrow UDF each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import lines

MAX_CHUNK, OVERLAP = 500, 50
LINES_PER_CHUNK, SHARED_LINES = 100, 10


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def paragraphs(text: Column, limit: int = MAX_CHUNK) -> Column:
    """Paragraphs packed in order while a chunk stays within ``limit`` bytes; a longer one stays whole.

    A fold over the array of paragraphs; null, empty and blank texts give an empty array.
    """
    parts = F.filter(F.transform(F.split(_strip(text), r"\r?\n\r?\n"), _strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, p: Column) -> Column:
        fits = F.octet_length(acc["open"]) + F.octet_length(p) + 2 <= limit
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), p.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n\n"), p).alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), p.alias("open")))
        )

    def end(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    return F.coalesce(F.aggregate(parts, start, add, end), F.array().cast("array<string>"))


def line_windows(text: Column, size: int = LINES_PER_CHUNK, shared: int = SHARED_LINES) -> Column:
    """Windows of ``size`` lines that share ``shared`` with the next: array<struct<start_line, end_line, content>>.

    Lines count from 1, both ends included; the last window ends with the text. Null and empty texts give
    an empty array. ``shared`` must be less than ``size``.
    """
    step = size - shared
    ls = F.when(F.length(text) > 0, lines(text)).otherwise(F.array().cast("array<string>"))
    n = F.size(ls)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct((i * step + 1).alias("start_line"), F.least(i * step + size, n).alias("end_line"), F.array_join(F.slice(ls, i * step + 1, size), "\n").alias("content")),
    )
    return F.when(n > 0, windows).otherwise(F.array().cast("array<struct<start_line:int,end_line:int,content:string>>"))


def diff_files(diff: Column) -> Column:
    """A patch cut before each ``diff --git`` header; without a header it stays whole; blank gives nothing."""
    return F.filter(F.transform(F.split(diff, r"(?m)(?=^diff --git)"), _strip), lambda p: p != "")


def symbol_text(code: Column, most: int = 1000, keep: int = 500) -> Column:
    """Code of more than ``most`` bytes is cut to ``keep`` characters with a note of its length."""
    note = F.concat(F.lit("...\n[truncated: "), F.length(code).cast("string"), F.lit(" total chars]"))
    return F.when(F.octet_length(code) > most, F.concat(F.left(code, F.lit(keep)), note)).otherwise(code)


# ---- parsers with state

_SENTENCE_END = re.compile(r"[.!?](?=\s|$)")


def message_chunks(text: str | None, limit: int = MAX_CHUNK, overlap: int = OVERLAP) -> list[str]:
    """A message cut after sentences.

    A text of at most ``limit`` bytes is one chunk. Otherwise a chunk ends with the last sentence that
    began to end within ``limit`` characters (or the first one after), and the next starts ``overlap``
    characters before. Without sentence ends there is one chunk; blank texts have none.
    """
    text = (text or "").strip()
    if not text:
        return []
    if len(text.encode()) <= limit:
        return [text]
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    out, start = [], 0
    while len(text) - start > limit:
        inside = [e for e in ends if start + overlap < e <= start + limit]
        later = [e for e in ends if e > start + limit]
        cut = inside[-1] if inside else later[0] if later else None
        if cut is None or cut >= len(text):
            break
        out.append(text[start:cut].strip())
        start = cut - overlap
    rest = text[start:].strip()
    return out + [rest] if rest else out


def markdown_chunks(text: str | None) -> list[tuple[str, str, int | None, list[str], int, int]]:
    """(kind, content, level, header path, first line, last line) of a markdown text's blocks.

    Headings (``#`` and underlined), fenced code (an open fence ends with the text) and paragraphs; a
    heading's path holds the headings above it. Lines count from 1.
    """
    out, path, buffer, first = [], [], [], 0
    rows = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")

    def flush(last: int) -> None:
        body = "\n".join(buffer).strip()
        if body:
            out.append(("Paragraph", body, None, [h for _, h in path], first, last))
        buffer.clear()

    def heading(level: int, title: str, a: int, b: int) -> None:
        while path and path[-1][0] >= level:
            path.pop()
        path.append((level, title))
        out.append(("Header", title, level, [h for _, h in path], a, b))

    i = 0
    while i < len(rows):
        line, n = rows[i], i + 1
        fence = re.match(r"\s{0,3}(```+|~~~+)", line)
        if fence:
            flush(n - 1)
            j = next((k for k in range(i + 1, len(rows)) if rows[k].strip().startswith(fence[1])), len(rows) - 1)
            body = rows[i + 1 : j if rows[j].strip().startswith(fence[1]) and j > i else j + 1]
            out.append(("CodeBlock", "\n".join(body), None, [h for _, h in path], n, j + 1))
            i = j + 1
            continue
        atx = re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        under = re.match(r"\s{0,3}(={3,}|-{3,})\s*$", rows[i + 1]) if i + 1 < len(rows) and line.strip() else None
        if atx and atx[2]:
            flush(n - 1)
            heading(len(atx[1]), atx[2], n, n)
        elif under and not buffer:
            heading(1 if under[1][0] == "=" else 2, line.strip(), n, n + 1)
            i += 1
        elif not line.strip():
            flush(n - 1)
        else:
            if not buffer:
                first = n
            buffer.append(re.sub(r"^\s*>\s?", "", line))
        i += 1
    flush(len(rows))
    return out


def symbol_blocks(code: str | None, start_line: int | None, header: str = "", lines_at_once: int = 500, bytes_at_once: int = 10_000, size: int = 100, shared: int = 10) -> list[tuple[int, int, int, str]]:
    """(number, first line, last line, text) of a symbol's code: whole with its header if small, else blocks of lines.

    Blocks begin with the body (the first line that begins with a brace, else the first), share lines, and
    all but the last end with a mark; the header stands before the first. A block over ``bytes_at_once`` is
    cut into pieces of at most that size, so nothing is left out. Lines count from the symbol's own.
    """
    if not code:
        return []
    rows, at = code.split("\n"), 1 if start_line is None else start_line
    if len(rows) <= lines_at_once and len((header + code).encode()) <= bytes_at_once:
        return [(0, at, at + len(rows) - 1, header + code)]
    out: list[tuple[int, int, int, str]] = []
    i = next((k for k, r in enumerate(rows) if r.startswith("{")), 0)
    if i:  # what is before the body: signature and attributes
        header += "\n".join(rows[:i]) + "\n"
    while True:
        part = rows[i : i + size]
        last = i + size >= len(rows)
        body = (header if not out else "") + "\n".join(part) + ("" if last else "\n    // ... [truncated]")
        for piece in _pieces(body, bytes_at_once):
            out.append((len(out), at + i, at + i + len(part) - 1, piece))
        if last:
            return out
        i += size - shared


def _pieces(s: str, most: int) -> list[str]:
    """A text in pieces of at most ``most`` bytes, cut between characters."""
    if len(s.encode()) <= most:
        return [s]
    step = max(1, most // 4)  # a character has at most four bytes
    return [s[i : i + step] for i in range(0, len(s), step)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunk_message(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([message_chunks(t) for t in s], dtype=object)


def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


_S, _I = T.StringType(), T.IntegerType()


@F.pandas_udf(_rows(kind=_S, content=_S, header_level=_I, header_path=T.ArrayType(_S), start_line=_I, end_line=_I))
def chunk_markdown(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    names = ("kind", "content", "header_level", "header_path", "start_line", "end_line")
    for s in texts:
        yield pd.Series([[dict(zip(names, c)) for c in markdown_chunks(t)] for t in s], dtype=object)


@F.pandas_udf(_rows(block=_I, start_line=_I, end_line=_I, content=_S))
def chunk_symbol(code: pd.Series, start_line: pd.Series, header: pd.Series) -> pd.Series:
    names = ("block", "start_line", "end_line", "content")
    return pd.Series([[dict(zip(names, c)) for c in symbol_blocks(t, None if pd.isna(n) else int(n), h or "")] for t, n, h in zip(code, start_line, header)], dtype=object)


# ---- other document formats


def plain_paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, each as one line; null and blank texts give an empty array."""
    parts = F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[ \t\f\n]*\n")
    joined = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"[ \t\f]*\n[ \t\f]*", " "), r"^[ \t\f]+|[ \t\f]+$", ""))
    return F.coalesce(F.filter(joined, lambda p: p != ""), F.array().cast("array<string>"))


def rst_chunks(text: str | None) -> list[tuple[str, str, int | None, list[str], int, int]]:
    """Titles (underlined at least as long as they are, by ``= - ~ *``) and paragraphs, as :func:`markdown_chunks` gives them.

    The first kind of underline is level 1, the next new one level 2, and so on.
    """
    rows = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out, path, levels, buffer, first, i = [], [], [], [], 0, 0

    def flush(last: int) -> None:
        if buffer:
            out.append(("Paragraph", " ".join(buffer), None, [h for _, h in path], first, last))
            buffer.clear()

    while i < len(rows):
        line = rows[i].strip()
        under = rows[i + 1].strip() if i + 1 < len(rows) else ""
        if line and len(under) >= max(3, len(line)) and re.fullmatch(r"=+|-+|~+|\*+", under):
            flush(i)
            if under[0] not in levels:
                levels.append(under[0])
            level = levels.index(under[0]) + 1
            path[:] = [p for p in path if p[0] < level] + [(level, line)]
            out.append(("Header", line, level, [h for _, h in path], i + 1, i + 2))
            i += 1
        elif not line:
            flush(i)
        else:
            first = first if buffer else i + 1
            buffer.append(line)
        i += 1
    flush(len(rows))
    return out


def asciidoc_chunks(text: str | None) -> list[tuple[str, str, int | None, list[str], int, int]]:
    """Titles (one to six ``=``), ``----`` blocks and paragraphs, as :func:`markdown_chunks` gives them."""
    rows = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out, path, buffer, first, i = [], [], [], 0, 0

    def flush(last: int) -> None:
        if buffer:
            out.append(("Paragraph", " ".join(buffer), None, [h for _, h in path], first, last))
            buffer.clear()

    while i < len(rows):
        line = rows[i].strip()
        title = re.fullmatch(r"(={1,6})\s+(.+)", line)
        if re.fullmatch(r"-{4,}", line):
            flush(i)
            end = next((k for k in range(i + 1, len(rows)) if rows[k].strip() == line), len(rows))
            out.append(("CodeBlock", "\n".join(rows[i + 1 : end]), None, [h for _, h in path], i + 1, min(end + 1, len(rows))))
            i = end
        elif title:
            flush(i)
            path[:] = [p for p in path if p[0] < len(title[1])] + [(len(title[1]), title[2])]
            out.append(("Header", title[2], len(title[1]), [h for _, h in path], i + 1, i + 1))
        elif not line:
            flush(i)
        else:
            first = first if buffer else i + 1
            buffer.append(line)
        i += 1
    flush(len(rows))
    return out


_INLINE = [(re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"`([^`]+)`"), r"\1"), (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"\2"), (re.compile(r"(?<!\w)([*_])(?=\S)(.+?)(?<=\S)\1(?!\w)"), r"\2")]


def clean_inline(text: str | None) -> str:
    """Markdown marks of images, links, code, bold and italic taken away; escaped and unclosed marks stay."""
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        kept.append(m.group(1))
        return f"\x00{len(kept) - 1}\x01"

    s = re.sub(r"\\([\\`*_{}\[\]()#+\-.!>])", hide, text or "")
    for pattern, by in _INLINE:
        s = pattern.sub(by, s)
    return re.sub(r"\x00(\d+)\x01", lambda m: kept[int(m[1])], s).strip()


def clean_markdown(text: str | None) -> str:
    """A markdown text as one line: no blank lines, list and quote marks or inline marks."""
    rows = [clean_inline(re.sub(r"^(?:[-*]\s+|>\s?)+", "", line.strip())) for line in (text or "").splitlines()]
    return " ".join(r for r in rows if r)


def text_chunks(text: str | None) -> list[tuple[str, str, int | None, list[str], int, int]]:
    """Paragraphs between blank lines, their lines joined, as :func:`markdown_chunks` gives them."""
    out, buffer, first = [], [], 0
    for n, line in enumerate([*(text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"), ""], 1):
        if line.strip():
            first = first if buffer else n
            buffer.append(line.strip())
        elif buffer:
            out.append(("Paragraph", " ".join(buffer), None, [], first, n - 1))
            buffer = []
    return out


def window_chunks(text: str | None) -> list[tuple[str, str, int | None, list[str], int, int]]:
    """Windows of lines that share some with the next one, for texts of no known format."""
    rows = (text or "").replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n") if text else []
    starts = range(0, max(len(rows) - SHARED_LINES, 1), LINES_PER_CHUNK - SHARED_LINES) if rows else []
    return [("Other", "\n".join(rows[i : i + LINES_PER_CHUNK]), None, [], i + 1, min(i + LINES_PER_CHUNK, len(rows))) for i in starts]


FORMATS = {"txt": text_chunks, "text": text_chunks, "md": markdown_chunks, "markdown": markdown_chunks, "rst": rst_chunks, "adoc": asciidoc_chunks, "asciidoc": asciidoc_chunks}


@F.pandas_udf(_rows(kind=_S, content=_S, header_level=_I, header_path=T.ArrayType(_S), start_line=_I, end_line=_I))
def chunk_document(text: pd.Series, extension: pd.Series) -> pd.Series:
    """Chunks by file extension; one of no documentation format gives windows of lines."""
    names = ("kind", "content", "header_level", "header_path", "start_line", "end_line")
    return pd.Series([[dict(zip(names, c)) for c in FORMATS.get(e, window_chunks)(t)] for t, e in zip(text, extension)], dtype=object)


@F.pandas_udf(T.StringType())
def cleaned_markdown(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else clean_markdown(t) for t in text], dtype=object)
