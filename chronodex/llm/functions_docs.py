"""Problem 2: functions and methods paired with their documentation.

Each file is lexed once by a state machine (``chronodex.functions.lexing``) that knows strings,
template literals, regular expression literals and (nested) comments, so braces and keywords inside
them don't count. Functions are delimited by matching braces (Python: by the statement after the
signature), and get the documentation comments directly before them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.lexing import OPEN, Token, block_end, clean_doc, docs_before, lex, pairs
from ..operators.symbols import source_texts

MIN_WORDS = 5


def _rust(s: str) -> Iterator[tuple]:
    tokens = lex(s, "rust")
    pair = pairs(s, tokens)
    word = [s[b:e] if k in ("word", "sign") else "" for k, b, e in tokens]
    n = len(tokens)
    for i in range(n - 1):
        if word[i] != "fn" or tokens[i + 1][0] != "word":
            continue
        j = i + 2
        while j < n and word[j] not in ("{", ";"):
            j = pair.get(j, j) + 1 if word[j] in ("(", "[") else j + 1
        if j >= n or word[j] != "{":
            continue
        end = tokens[pair[j]][2] if j in pair else len(s)
        k = i
        while k > 0:
            if word[k - 1] in ("pub", "async", "const", "unsafe", "extern", "default"):
                k -= 1
            elif word[k - 1] == ")" and word[max(pair.get(k - 1, 0) - 1, 0)] == "pub":
                k = pair[k - 1] - 1
            elif tokens[k - 1][0] == "text" and k > 1 and word[k - 2] == "extern":
                k -= 2
            else:
                break
        docs = docs_before(s, tokens, k, pair, "rust")
        yield word[i + 1].removeprefix("r#"), tokens[i + 1][1], tokens[k][1], end, docs


_CONTROL = {"if", "for", "while", "switch", "catch", "with", "function", "return", "await", "new", "typeof", "super", "do", "else"}
_MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor"}


def _js(s: str) -> Iterator[tuple]:
    tokens = [t for t in lex(s, "js")]
    pair = pairs(s, tokens)
    n = len(tokens)
    word = [s[b:e] if k in ("word", "sign", "arrow") else ("" if k in ("doc", "comment") else "\0") for k, b, e in tokens]
    code = [i for i in range(n) if word[i] != ""]  # without comments
    place = {t: c for c, t in enumerate(code)}
    W = [word[i] for i in code]
    m = len(code)

    def partner(c: int) -> int:
        return place[pair[code[c]]] if code[c] in pair else m

    def past_generics(c: int) -> int:
        """Past ``<...>`` that begins at ``c``."""
        if c < m and W[c] == "<":
            depth = 0
            while c < m:
                depth += {"<": 1, ">": -1}.get(W[c], 0)
                c += 1
                if not depth:
                    break
        return c

    def body_after(c: int, stop: str) -> int:
        """The token where the body begins after a parameter list that ends before ``c``."""
        if c < m and W[c] == ":":
            c += 1
            while c < m and W[c] not in (stop, ";", ",", ")") and not (stop == "{" and W[c] == "{"):
                if W[c] in ("(", "[", "{"):
                    c = partner(c)
                c += 1
                if stop == "=>" and c < m and W[c] == "{":
                    c = partner(c) + 1
        elif c < m and W[c] == "{" and stop == "=>":
            return m
        if stop == "{" and c < m and W[c] == "{" and W[c - 1] in (":", "|", "&") and partner(c) + 1 < m and W[partner(c) + 1] in ("{", "|", "&", "["):
            c = partner(c) + 1  # the brace was an object type
            while c < m and W[c] != "{":
                c += 1
        return c if c < m and W[c] == stop else m

    def close(c: int) -> int:
        """End offset of the body whose first token is ``c``."""
        if c < m and W[c] == "{":
            p = partner(c)
            return tokens[code[p]][2] if p < m else len(s)
        depth = 0
        while c < m and not (depth == 0 and W[c] in (";", ")", "}", ",", "]")):
            if W[c] in OPEN and partner(c) < m:
                c = partner(c)
            c += 1
        return tokens[code[min(c, m) - 1]][2]

    def emit(name: int, first: int, body: int) -> tuple:
        return W[name], tokens[code[name]][1], tokens[code[first]][1], close(body), docs_before(s, tokens, code[first], pair, "js")

    # what each open brace encloses: a class, an object literal or a block
    inside = [""] * m
    stack: list[tuple[int, str]] = []
    since = 0
    for c in range(m):
        while stack and stack[-1][0] < c:
            stack.pop()
        inside[c] = stack[-1][1] if stack else "block"
        if W[c] == "{" and partner(c) < m:
            head = W[since:c]
            kind = "class" if "class" in head else "object" if c and W[c - 1] in ("=", "(", ",", ":", "[", "return", "?", "default") else "block"
            stack.append((partner(c), kind))
        if W[c] in ("{", "}", ";"):
            since = c + 1

    for c in range(m):
        w = W[c]
        if w == "function" and c + 1 < m:
            k = c + 1 + (W[c + 1] == "*")
            if k < m and tokens[code[k]][0] == "word":
                p = past_generics(k + 1)
                if p < m and W[p] == "(":
                    b = body_after(partner(p) + 1, "{")
                    f = c
                    while f > 0 and W[f - 1] in ("export", "default", "async", "declare"):
                        f -= 1
                    bound = f > 0 and W[f - 1] in ("=", "(", ",", ":", "return", "?")
                    if b < m and not bound:
                        yield emit(k, f, b)
        elif w in ("const", "let", "var") and c + 1 < m and tokens[code[c + 1]][0] == "word":
            k, e = c + 1, c + 2
            if e < m and W[e] == ":":  # the variable's type
                while e < m and W[e] not in ("=", ";"):
                    e = (partner(e) if W[e] in ("(", "[", "{") else e) + 1
            if e >= m or W[e] != "=":
                continue
            e += 1
            e += e < m and W[e] == "async"
            if e >= m:
                continue
            if W[e] == "function":
                p = e + 1
                while p < m and W[p] != "(":
                    p += 1
                b = body_after(partner(p) + 1, "{") if p < m else m
            else:
                p = past_generics(e)
                if p < m and W[p] == "(" and partner(p) < m:
                    b = body_after(partner(p) + 1, "=>")
                elif p + 1 < m and tokens[code[p]][0] == "word" and W[p + 1] == "=>":
                    b = p + 1
                else:
                    b = m
                b = b + 1 if b + 1 < m else m
            if b < m:
                f = c
                while f > 0 and W[f - 1] in ("export", "default", "declare"):
                    f -= 1
                yield emit(k, f, b)
        elif tokens[code[c]][0] == "word" and w not in _CONTROL and inside[c] in ("class", "object"):
            p = past_generics(c + 1)
            if p >= m or W[p] != "(" or partner(p) >= m or (c and W[c - 1] in (".", "=", "new", "=>", "@")):
                continue
            b = body_after(partner(p) + 1, "{")
            if b >= m:
                continue
            f = c
            while f > 0 and (W[f - 1] in _MODIFIERS or W[f - 1] == "*"):
                f -= 1
            if f == 0 or W[f - 1] in ("{", "}", ";", ",", ")") or tokens[code[f - 1]][0] == "word":
                yield emit(c, f, b)


def _python(s: str) -> Iterator[tuple]:
    tokens = lex(s, "python")
    pair = pairs(s, tokens)
    n = len(tokens)
    for i, (kind, b, e) in enumerate(tokens):
        if kind != "word" or s[b:e] != "def" or i + 2 >= n or tokens[i + 1][0] != "word":
            continue
        k = i - 1 if i and s[tokens[i - 1][1] : tokens[i - 1][2]] == "async" else i
        if k and tokens[k - 1][0] not in ("newline", "comment") and s[tokens[k - 1][1]] not in ";:":
            continue
        j = i + 2
        while j < n and s[tokens[j][1]] != ":" and tokens[j][0] != "newline":
            j = pair.get(j, j) + 1 if tokens[j][0] == "sign" and s[tokens[j][1]] in "([{" else j + 1
        if j >= n or s[tokens[j][1]] != ":":
            continue
        j += 1
        while j < n and tokens[j][0] in ("newline", "comment"):
            j += 1
        line = s.rfind("\n", 0, tokens[k][1]) + 1
        indent = len(s[line : tokens[k][1]].expandtabs())
        docs = []
        if j < n and tokens[j][0] == "text":
            literal = s[tokens[j][1] : tokens[j][2]]
            prefix = re.match(r"\w*", literal).group().lower()
            if not set(prefix) & set("bft"):
                quote = 3 if literal[len(prefix) :].startswith(('"""', "'''")) else 1
                docs = [literal[len(prefix) + quote : -quote]]
        yield s[tokens[i + 1][1] : tokens[i + 1][2]], tokens[i + 1][1], tokens[k][1], block_end(s, tokens, j, indent), docs


SCANNERS = {"rust": _rust, "js": _js, "python": _python}

#: Openings of statements which only say that a text is missing, generated or to come.
_EMPTY_TALK = re.compile(
    r"(?i)^\W*(?:todo|fixme|tbd|tba|tbw|xxx|hack|wip|placeholder|auto[- ]?generated|automatically generated|generated (?:by|from|code|stub|file|with)|this (?:function|method|comment|documentation|description|docstring|text|stub)? ?(?:is|was|has been) (?:auto\w*|generated|missing|undocumented|not (?:yet )?documented|a placeholder|a stub|to be)"
    r"|no (?:description|documentation|docs|comment)|undocumented|not (?:yet )?documented|document me|documentation (?:is |will |missing|to )|docs? (?:to follow|missing|will )|description (?:is |will |missing|to )|missing (?:doc|desc)|to be (?:written|documented|done|added|described|filled|completed|defined)|coming soon|write (?:the )?(?:doc|desc)|add (?:a |the )?(?:doc|desc)|see above|n/?a\b|stub\b|inheritdoc)"
)
_TAGGED = re.compile(r"^\s*(?:@(?!description|desc\b|summary|brief|remarks)[A-Za-z]|:(?:param|type|returns?|rtype|raises?)\b|(?:Args|Arguments|Parameters|Params|Returns?|Yields?|Raises|Throws|Examples?|Attributes|Keyword Args|Example usage)\s*:?\s*$|(?:Args|Arguments|Parameters|Returns?|Yields?|Raises)\s*:\s)")


def is_meaningful(doc: str, name: str) -> bool:
    """At least ``MIN_WORDS`` words besides the name's, in statements that say something.

    Tag lines (``@param``, ``Args:`` and what belongs to them), headings and fenced code don't count,
    nor do statements that only announce a missing, generated or future text.
    """
    text = re.sub(r"```.*?(?:```|\Z)", " ", doc, flags=re.S)
    lines = []
    for line in text.split("\n"):
        if _TAGGED.match(line):
            break
        if not re.match(r"\s*#+\s", line):
            lines.append(re.sub(r"^\s*@\w+\s*", "", line))
    parts = {p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+", name)} | {name.lower()}
    words = 0
    # a paragraph's statements; an announcement goes up to its end
    for paragraph in re.split(r"\n\s*\n", "\n".join(lines)):
        for statement in re.split(r"(?<=[.!?;])\s+|\n(?=\s*(?:TODO|FIXME|XXX|TBD)\b)", paragraph.strip()):
            if not statement.strip() or _EMPTY_TALK.match(statement):
                continue
            for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)*", statement):
                if w.lower() not in parts:
                    words += len(w) if re.match(r"[぀-ヿ一-鿿가-힯]", w) else 1
    return words >= MIN_WORDS


def functions_of(text: str, language: str) -> Iterator[tuple[str, int, int, str, str]]:
    """(name, start line, end line, code, documentation) of each function that has a documentation."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    starts = [m.end() for m in re.finditer("\n", text)]
    from bisect import bisect_right

    for name, at, first, end, docs in SCANNERS[language](text):
        doc = clean_doc(docs)
        if doc:
            yield name, bisect_right(starts, at) + 1, bisect_right(starts, max(end - 1, at)) + 1, text[first:end], doc


SCHEMA = "file_id string, name string, start_line int, end_line int, code string, doc string"


def function_docs(texts: DataFrame, meaningful: bool = True) -> DataFrame:
    """One row per documented function of ``texts`` (columns ``file_id``, ``content``, ``language``).

    ``language`` is rust, python or js (JavaScript and TypeScript); other values and nulls, and null or
    empty contents, give no rows. With ``meaningful`` functions whose documentation says nothing are
    left out. Files of any length are read whole; a file that ends inside a string, comment or brace
    gives what is complete up to there. Files are independent: no shuffle. Repeated rows give
    repeated results, so callers deduplicate by file id before. Extra columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (f, *x)
                for f, content, language in zip(pdf.file_id, pdf.content, pdf.language)
                if content and language in SCANNERS
                for x in functions_of(content, language)
                if not meaningful or is_meaningful(x[4], x[0])
            ]
            yield pd.DataFrame(rows, columns=["file_id", "name", "start_line", "end_line", "code", "doc"])

    return texts.select("file_id", "content", "language").mapInPandas(run, SCHEMA)


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and documentation of each documented function."""
    return function_docs(source_texts(spark, sf_dir)).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id``, ``name`` and ``start_line`` of each function with meaningful documentation."""
    return function_docs(source_texts(spark, sf_dir)).select("file_id", "name", "start_line").distinct()
