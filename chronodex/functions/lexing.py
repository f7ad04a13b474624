"""Lexing of source code: strings, comments and brackets of Rust, Python, JavaScript and TypeScript.

A state machine that knows strings, template literals, regular expression literals and (nested)
comments, so that brackets and keywords inside them don't count.
"""

from __future__ import annotations

import re

#: Languages by file extension, and by the name that the files table may give.
BY_EXTENSION = {"rs": "rust", "py": "python", "pyi": "python", "js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "ts": "js", "tsx": "js", "mts": "js", "cts": "js"}
BY_NAME = {"rust": "rust", "rs": "rust", "python": "python", "py": "python", "javascript": "js", "js": "js", "typescript": "js", "ts": "js"}

_PLAIN = r'"(?:[^"\\]|\\.)*"'
LEX = {
    "rust": re.compile(
        r"(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<text>b?r(?P<h>\#*)\".*?\"(?P=h)|b?" + _PLAIN + r"|b?'(?:\\u\{[^}']*\}|\\.[^'\n]{0,4}|[^'\\\n])')"
        r"|(?P<label>'[A-Za-z_]\w*)|(?P<word>(?:r\#)?[^\W\d]\w*)|(?P<number>\d\w*)|(?P<sign>.)", re.S),
    "js": re.compile(
        r"(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<text>" + _PLAIN + r"|'(?:[^'\\]|\\.)*')|(?P<template>`)"
        r"|(?P<word>[#]?[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d\w*)|(?P<arrow>=>)|(?P<sign>.)", re.S),
    "python": re.compile(
        r"(?P<line>\#[^\n]*)|(?P<text>[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))"
        r"|(?P<space>[^\S\n]+|\\\n)|(?P<newline>\n)|(?P<word>[^\W\d]\w*)|(?P<number>\d\w*)|(?P<sign>.)", re.S),
}
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_NESTED = re.compile(r"/\*|\*/")
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^<>") | {"=>", "return", "typeof", "case", "in", "of", "delete", "void", "do", "else"}

Token = tuple[str, int, int]  # kind, begin, end


_TEMPLATE_STOP = re.compile(r"[\\`]|\$\{")


def _template_end(s: str, at: int) -> int:
    """End of a template literal that begins at ``at``; ``${...}`` parts may hold any code, and templates again."""
    open_ = [0]  # 0: inside a template's text; else the depth of braces inside a ``${...}``
    at += 1
    while at < len(s):
        if not open_[-1]:
            m = _TEMPLATE_STOP.search(s, at)
            if not m:
                break
            at = m.end()
            if m.group() == "\\":
                at += 1
            elif m.group() == "`":
                open_.pop()
                if not open_:
                    return at
            else:
                open_.append(1)
            continue
        m = LEX["js"].match(s, at)
        kind, at = m.lastgroup, m.end()
        if kind == "template":
            open_.append(0)
        elif kind == "block":
            end = s.find("*/", at)
            at = len(s) if end < 0 else end + 2
        elif kind == "sign":
            open_[-1] += {"{": 1, "}": -1}.get(m.group(), 0)
            if not open_[-1]:
                open_.pop()
    return len(s)


def lex(s: str, language: str) -> list[Token]:
    """Tokens without white space. Kinds: doc, comment, text, word, number, sign, arrow, newline."""
    pattern, out, at, n = LEX[language], [], 0, len(s)
    while at < n:
        m = pattern.match(s, at)
        kind, begin, end = m.lastgroup if m.lastgroup != "h" else "text", at, m.end()
        if kind == "space":
            at = end
            continue
        if kind == "line":
            doc = language != "python" and s.startswith("///", at) and not s.startswith("////", at)
            kind = "doc" if doc else "comment"
        elif kind == "block":
            if language == "rust":  # nested
                depth = 1
                while depth and (e := _NESTED.search(s, end)):
                    depth += 1 if e.group() == "/*" else -1
                    end = e.end()
                if depth:
                    end = n
            else:
                e = s.find("*/", end)
                end = n if e < 0 else e + 2
            kind = "doc" if s.startswith("/**", at) and not s.startswith(("/***", "/**/"), at) else "comment"
        elif kind == "template":
            kind, end = "text", _template_end(s, at)
        elif kind == "sign" and language == "js" and s[at] == "/":
            last = next((x for x in reversed(out) if x[0] not in ("doc", "comment")), None)
            if last is None or s[last[1] : last[2]] in _BEFORE_REGEX:
                if r := _REGEX.match(s, at):
                    kind, end = "text", r.end()
        out.append((kind, begin, end))
        at = end
    return out


OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


def pairs(s: str, tokens: list[Token]) -> dict[int, int]:
    """Index of the partner of each bracket token; brackets without one are missing."""
    out, stack = {}, []
    for i, (kind, b, e) in enumerate(tokens):
        if kind != "sign":
            continue
        c = s[b:e]
        if c in OPEN:
            stack.append((c, i))
        elif c in CLOSE:
            while stack and stack[-1][0] != CLOSE[c]:
                stack.pop()
            if stack:
                o = stack.pop()[1]
                out[o], out[i] = i, o
    return out


def docs_before(s: str, tokens: list[Token], at: int, pair: dict[int, int], language: str) -> list[str]:
    """Documentation comments right before token ``at``, attributes or decorators left aside."""
    docs: list[str] = []
    following = tokens[at][1]
    i = at - 1
    while i >= 0:
        kind, b, e = tokens[i]
        if s.count("\n", e, following) > 1:
            break  # a blank line between: not right above
        if kind == "doc":
            docs.append(s[b:e])
            i -= 1
        elif language == "rust" and s[b:e] == "]" and i in pair and pair[i] > 0 and s[tokens[pair[i] - 1][1]] == "#":
            i = pair[i] - 2
            b = tokens[i + 1][1]
        elif language == "js" and (d := _decorator(s, tokens, i, pair)) >= 0:
            i = d - 1
            b = tokens[d][1]
        else:
            break
        following = b
    return docs[::-1]


def _decorator(s: str, tokens: list[Token], i: int, pair: dict[int, int]) -> int:
    """Index of the @ of the decorator that ends at token ``i``, or -1."""
    if s[tokens[i][1] : tokens[i][2]] == ")":
        i = pair.get(i, 0) - 1
    while i > 0 and tokens[i][0] == "word":
        c = s[tokens[i - 1][1]]
        if c == "@":
            return i - 1
        if c != ".":
            return -1
        i -= 2
    return -1


def block_end(s: str, tokens: list[Token], j: int, indent: int) -> int:
    """End of the indented block whose first statement is token ``j``."""
    end, depth = tokens[min(j, len(tokens) - 1)][2], 0
    for i in range(j, len(tokens)):
        kind, b, e = tokens[i]
        if kind in ("newline", "comment"):
            continue
        if depth == 0 and i > j and tokens[i - 1][0] == "newline" and len(s[s.rfind("\n", 0, b) + 1 : b].expandtabs()) <= indent:
            break
        if kind == "sign":
            depth = max(0, depth + {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(s[b:e], 0))
        end = e
    return end


_MARKS = re.compile(r"^\s*(?:///?|/\*\*?|\*(?!/))?[ \t]?|\*+/\s*$", re.M)


def clean_doc(docs: list[str]) -> str:
    """Documentation text without comment marks; tags and code examples stay."""
    return "\n".join(_MARKS.sub("", d).strip("\n") for d in docs).strip()
