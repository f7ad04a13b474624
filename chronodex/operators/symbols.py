"""Symbols of source files: functions, methods, classes, interfaces, enums, modules and variables, with what contains them."""

from __future__ import annotations

import ast
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexing import BY_EXTENSION, BY_NAME, OPEN, Token, clean_doc, docs_before, lex, pairs
from ..tables import files, latest, table

SCHEMA = "file_id string, id string, name string, kind string, start_line int, end_line int, doc_comment string, code string, parent_id string, error string"

#: name, kind, begin, end (offsets), documentation, index of the containing symbol or None
Found = tuple[str, str, int, int, str, int | None]


def check_syntax(s: str, tokens: list[Token]) -> None:
    """Raises SyntaxError for brackets without partner and for strings or comments that never end."""
    stack = []
    for kind, b, e in tokens:
        if kind in ("comment", "doc") and s.startswith("/*", b) and not s.endswith("*/", b + 2, e):
            raise SyntaxError("unclosed comment")
        if kind == "text" and s[b] == "`" and (e - b < 2 or s[e - 1] != "`"):
            raise SyntaxError("unclosed template")
        if kind != "sign":
            continue
        c = s[b:e]
        if c in "\"'`":
            raise SyntaxError("unclosed string")
        if c in OPEN:
            stack.append(OPEN[c])
        elif c in ")]}" and (not stack or stack.pop() != c):
            raise SyntaxError(f"{c} without partner")
    if stack:
        raise SyntaxError(f"{stack[-1]} is missing")


_RUST_KIND = {"struct": "Class", "enum": "Enum", "trait": "Interface", "mod": "Module"}
_RUST_HEAD = {"pub", "async", "const", "unsafe", "extern", "default"}


def _rust(s: str) -> list[Found]:
    tokens = lex(s, "rust")
    check_syntax(s, tokens)
    pair = pairs(s, tokens)
    word = [s[b:e] if k in ("word", "sign") else "" for k, b, e in tokens]
    found: list[Found] = []

    def opening(i: int, hi: int) -> int:
        """The ``{`` or ``;`` that ends the head of the item at ``i``."""
        while i < hi and word[i] not in ("{", ";"):
            i = pair.get(i, i) + 1 if word[i] in ("(", "[") else i + 1
        return i

    def first(i: int) -> int:
        """The first token of the item whose keyword is at ``i``: its visibility and modifiers."""
        while i > 0:
            if word[i - 1] in _RUST_HEAD:
                i -= 1
            elif word[i - 1] == ")" and word[pair[i - 1] - 1] == "pub":
                i = pair[i - 1] - 1
            elif tokens[i - 1][0] == "text" and i > 1 and word[i - 2] == "extern":
                i -= 2
            else:
                break
        return i

    todo: list[tuple[int, int, int | None]] = [(0, len(tokens), None)]
    while todo:
        i, hi, parent = todo.pop()
        while i < hi:
            w, named = word[i], i + 1 < hi and tokens[i + 1][0] == "word"
            if w == "!" and i and tokens[i - 1][0] == "word":  # a macro's tokens are no items
                j = i + 1 + named
                i = pair[j] + 1 if j in pair and word[j] in OPEN else i + 1
                continue
            begin = first(i) if w in ("fn", "impl") or w in _RUST_KIND else i
            is_impl = w == "impl" and (begin == 0 or word[begin - 1] in ("", "}", ";", "]", "{"))
            if not is_impl and not (named and (w == "fn" or w in _RUST_KIND)):
                i += 1
                continue
            j = opening(i + 1, hi)
            if j >= hi:
                break
            body = word[j] == "{"
            end = pair[j] if body else j
            name = _impl_name(word[i + 1 : j]) if is_impl else word[i + 1].removeprefix("r#")
            if name and (body or w in ("struct", "mod")):  # a signature without a body is no function
                doc = clean_doc(docs_before(s, tokens, begin, pair, "rust"))
                found.append((name, "Class" if is_impl else _RUST_KIND.get(w, "Function"), tokens[begin][1], tokens[end][2], doc, parent))
                if body and (is_impl or w == "trait"):
                    todo.append((end + 1, hi, parent))
                    i, hi, parent = j + 1, end, len(found) - 1
                    continue
            i = end + 1
    return found


def _impl_name(head: list[str]) -> str:
    """``impl T`` of the words between ``impl`` and its brace: the type that gets the methods."""
    depth, plain = 0, []
    for n, w in enumerate(head):
        if w == "<":
            depth += 1
        elif w == ">" and head[n - 1] != "-":
            depth -= 1
        elif not depth:
            if w == "where":
                break
            plain.append(w)
    if "for" in plain:
        plain = plain[plain.index("for") + 1 :]
    names = [w for w in plain if w[:1].isalpha() or w[:1] == "_"]
    return f"impl {names[-1]}" if names else ""


_JS_WORDS = {"if", "for", "while", "switch", "catch", "with", "function", "return", "await", "new", "typeof", "super", "do", "else"}
_JS_HEAD = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "declare", "abstract", "accessor", "*"}


def _js(s: str) -> list[Found]:
    tokens = lex(s, "js")
    check_syntax(s, tokens)
    pair = pairs(s, tokens)
    code = [i for i, t in enumerate(tokens) if t[0] not in ("comment", "doc")]
    place = {t: c for c, t in enumerate(code)}
    W = [s[tokens[i][1] : tokens[i][2]] if tokens[i][0] in ("word", "sign", "arrow") else "\0" for i in code]
    m = len(code)
    found: list[Found] = []

    def partner(c: int) -> int:
        return place[pair[code[c]]]

    def is_word(c: int) -> bool:
        return c < m and tokens[code[c]][0] == "word"

    def past_generics(c: int) -> int:
        depth = 0
        while c < m and (depth or W[c] == "<"):
            depth += {"<": 1, ">": -1}.get(W[c], 0)
            c += 1
        return c

    def body(c: int) -> int:
        """The ``{`` of the body after the parameters that begin at ``c``, or ``m``."""
        if c >= m or W[c] != "(":
            return m
        c = partner(c) + 1
        while c < m:
            if W[c] == "{" and (W[c - 1] not in (":", "|", "&", "<", ",") or W[c - 1] == ")"):
                return c
            if W[c] in (";", "}", "=", "=>") and W[c - 1] != ")" or W[c] in (";", "}"):
                return m
            if W[c] not in (":", "{", "(", "[") and W[c - 1] == ")" and not is_word(c):
                return m
            if W[c - 1] == ")" and W[c] not in (":", "{"):
                return m
            c = (partner(c) if W[c] in OPEN else c) + 1
        return m

    def add(name: int, kind: str, begin: int, end: int, parent: int | None) -> None:
        doc = clean_doc(docs_before(s, tokens, code[back(begin, {"export", "default", "declare"})], pair, "js"))
        found.append((W[name], kind, tokens[code[begin]][1], tokens[code[end]][2], doc, parent))

    def back(c: int, words: set[str]) -> int:
        while c > 0 and W[c - 1] in words:
            c -= 1
        return c

    # (from, to, containing symbol, whether methods may stand directly in it)
    todo: list[tuple[int, int, int | None, bool]] = [(0, m, None, False)]
    while todo:
        c, hi, parent, members = todo.pop()
        while c < hi:
            w, before = W[c], W[c - 1] if c else ""
            nxt = c + 1
            if before == ".":
                pass
            elif w == "function" and not (members and c + 1 < hi and W[c + 1] == "("):
                k = c + 1 + (c + 1 < m and W[c + 1] == "*")
                b = body(past_generics(k + is_word(k)))
                if b < hi:
                    if is_word(k):
                        add(k, "Method" if parent is not None else "Function", back(c, {"async"}), partner(b), parent)
                    nxt = partner(b) + 1
            elif w in ("class", "interface") and is_word(c + 1) or w == "class" and c + 1 < hi and W[c + 1] == "{":
                b = c + 1
                while b < hi and W[b] not in ("{", ";"):
                    b = past_generics(b) if W[b] == "<" else (partner(b) if W[b] in ("(", "[") else b) + 1
                if b < hi and W[b] == "{":
                    named = is_word(c + 1) and W[c + 1] != "extends"
                    if named:
                        add(c + 1, "Class" if w == "class" else "Interface", back(c, {"abstract"}), partner(b), parent)
                    nxt = partner(b) + 1
                    if w == "class":
                        todo.append((nxt, hi, parent, members))
                        c, hi, parent, members = b + 1, partner(b), len(found) - 1 if named else parent, True
                        continue
            elif w == "var" and is_word(c + 1) and parent is None and not members:
                e = c + 1
                while e + 1 < hi and W[e] != ";" and not (is_word(e + 1) and (is_word(e) or W[e] in ("\0", ")", "]", "}")) and "\n" in s[tokens[code[e]][2] : tokens[code[e + 1]][1]]):
                    e = partner(e) if W[e] in OPEN else e + 1
                    if W[e] in (")", "]", "}") and e + 1 < hi and W[e + 1] == ";":
                        e += 1
                    elif W[e] in (")", "]", "}") and e + 1 < hi and not is_word(e + 1):
                        e += 1
                add(c + 1, "Variable", c, e, None)
                nxt = e + 1
            elif members and is_word(c) and w not in _JS_WORDS and before not in ("=", "new", "=>", "@"):
                b = body(past_generics(c + 1))
                if b < hi:
                    add(c, "Method" if parent is not None else "Function", back(c, _JS_HEAD), partner(b), parent)
                    nxt = partner(b) + 1
            elif w == "{":
                end = partner(c)
                todo.append((end + 1, hi, parent, members))
                c, hi, members = c + 1, end, before in ("=", "(", ",", ":", "[", "return", "?", "default")
                continue
            elif members and w in ("(", "["):  # no member's name stands in brackets
                todo.append((partner(c) + 1, hi, parent, True))
                c, hi, members = c + 1, partner(c), False
                continue
            c = nxt
    return found


def _python(s: str) -> list[Found]:
    tree = ast.parse(s)
    raw = s.encode()
    starts = [0]
    for line in raw.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    ascii_ = len(raw) == len(s)

    def offset(line: int, column: int) -> int:
        at = starts[line - 1] + column
        return at if ascii_ else len(raw[:at].decode(errors="replace"))

    found: list[Found] = []
    todo: list[tuple[ast.AST, int | None]] = [(tree, None)]
    while todo:
        node, parent = todo.pop()
        inside = parent
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            kind = "Class" if is_class else "Method" if parent is not None else "Function"
            found.append((node.name, kind, offset(node.lineno, node.col_offset), offset(node.end_lineno, node.end_col_offset), ast.get_docstring(node) or "", parent))
            if not is_class:
                continue
            inside = len(found) - 1
        statements = (x for x in ast.iter_child_nodes(node) if isinstance(x, (ast.stmt, ast.excepthandler, ast.match_case)))
        todo.extend([(x, inside) for x in statements][::-1])
    return found


READERS = {"rust": _rust, "python": _python, "js": _js}


def symbols_of(text: str, language: str) -> list[Found]:
    """The symbols of one source text (line ends made plain), outer ones before inner ones; SyntaxError if it is broken."""
    try:
        return READERS[language](text)
    except (ValueError, RecursionError, MemoryError) as e:
        raise SyntaxError(str(e) or type(e).__name__) from e


def _rows(file_id: str, text: str, language: str) -> Iterator[tuple]:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    try:
        found = symbols_of(text, language)
    except SyntaxError as e:
        yield (file_id, None, None, None, None, None, None, None, None, f"syntax error: {e.msg or e}")
        return
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    ids: list[str] = []
    for name, kind, begin, end, doc, parent in found:
        line = bisect_right(breaks, begin - 1) + 1
        ids.append("symbol:" + hashlib.sha256(f"{file_id}:{name}:{line}".encode(errors="replace")).hexdigest())
        yield (file_id, ids[-1], name, kind, line, bisect_right(breaks, end - 2) + 1, doc or None, text[begin:end], None if parent is None else ids[parent], None)


def extract_symbols(texts: DataFrame) -> DataFrame:
    """The symbols of each source text (columns ``file_id``, ``content``, ``language``).

    Functions, methods and classes of Rust, Python, JavaScript and TypeScript; Rust structs count as
    classes, traits as interfaces, an ``impl`` block as a class named after its type, and enums and
    modules are symbols too (what a module holds is not looked at). Bodies of functions are not looked into. In JavaScript
    a top-level ``var`` is a variable. ``parent_id`` names the class, trait or block around a symbol.

    A text with a syntax error gives one row with ``error`` and nothing else; Python is parsed in full,
    the others are checked for brackets, strings and comments that never end. Other languages and null
    contents give no rows, an empty text none. Whole texts are read; files are independent, so
    nothing is shuffled. Repeated rows give repeated results. Extra columns are ignored.
    """
    columns = SCHEMA.replace(",", "").split()[::2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for f, text, language in zip(pdf.file_id, pdf.content, pdf.language) if text and language in READERS for r in _rows(f, text, language)]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"start_line": "Int32", "end_line": "Int32"})

    return texts.select("file_id", "content", "language").mapInPandas(run, SCHEMA)


def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each source file that counts, with its language by extension or, else, by name."""
    texts = latest(table(spark, sf_dir, "file_texts", "file_id", "content", "read_at"), ["file_id"], "read_at")
    about = files(spark, sf_dir).select(F.col("id").alias("file_id"), "file_path", F.col("language").alias("named"))
    by_extension = F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv])[F.lower(F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1))]
    by_name = F.create_map(*[F.lit(x) for kv in BY_NAME.items() for x in kv])[F.lower(F.trim("named"))]
    return texts.join(about, "file_id", "left").select("file_id", "content", F.coalesce(by_extension, by_name).alias("language")).filter("language is not null and content is not null")
