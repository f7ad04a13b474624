"""Problem 6: credentials embedded in source code, configuration and messages.

A keyword automaton picks the lines worth looking at; issuer formats and assignment forms are then
matched on those lines, and each value is validated by its structure (alphabet, length, no placeholder
or reference); the checksum, where the issuer defines one, is reported with it. Matches are replaced by characters of
the same classes and in the same number, so code around them keeps its shape.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import latest, table

#: What a line must contain (in lower case) to be looked at.
KEYWORDS = (
    "pass", "pwd", "passwort", "kennwort", "contrase", "clave", "mdp", "密码", "密钥", "口令", "secret", "token", "key", "auth", "bearer", "login", "credential",
    "://", "-----begin", "akia", "asia", "aiza", "eyj", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_", "glpat-", "xox", "sk-", "sk_", "rk_", "hf_", "npm_", "pypi-", "sg.", "curl",
)

#: Issuer formats. The named group is the credential.
ISSUERS = {
    "aws_access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "google_api_key": r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_\-]{35}(?![A-Za-z0-9_\-])",
    "github_token": r"(?<![A-Za-z0-9])(?:gh[opsur]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,})",
    "gitlab_token": r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_\-]{20,}",
    "slack_token": r"(?<![A-Za-z0-9])xox[abeprs]-[0-9A-Za-z]+-[0-9A-Za-z\-]{10,}",
    "payment_key": r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "model_api_key": r"(?<![A-Za-z0-9])sk-(?:proj-|ant-|svcacct-)?[A-Za-z0-9_\-]{20,}",
    "model_hub_token": r"(?<![A-Za-z0-9])hf_[A-Za-z0-9]{30,}",
    "package_token": r"(?<![A-Za-z0-9])(?:npm_[A-Za-z0-9]{36,}|pypi-[A-Za-z0-9_\-]{40,})",
    "mail_api_key": r"(?<![A-Za-z0-9])SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}",
    "json_web_token": r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
    "dotted_api_key": r"(?<![A-Za-z0-9])[0-9a-f]{32}\.[A-Za-z0-9]{16}(?![A-Za-z0-9])",
}
_ISSUER = re.compile("|".join(f"(?P<{k}>{v})" for k, v in ISSUERS.items()))

#: Endings of names that hold a credential, and endings that say something else is held.
_SECRET_END = {"password", "passwd", "passwort", "kennwort", "pwd", "pass", "passphrase", "passcode", "psw", "secret", "token", "apikey", "credential", "credentials", "apitoken", "authtoken", "accesstoken", "secretkey", "accesskey", "privatekey"}
_KEY_KINDS = {"api", "secret", "access", "signing", "private", "auth", "encryption", "account", "master", "service", "deploy", "client", "hmac", "shared", "storage", "license", "admin", "bearer"}

_NAMED = re.compile(
    r"""(?P<name>[A-Za-z_][\w\-]*)(?:["'`]?\s*\])?["'`]?\s*
        (?::\s*(?:&\s*(?:'static\s+)?str|String|string|str|any|Option<[^>]*>)\s*)?
        (?P<op>\|\|=|\?\?=|:=|=>|==|=|:)\s*
        (?:[rbuf]{1,2}(?=["'\#]))?(?P<quote>["'`]{1,3}|)(?:(?:Basic|Bearer|Token)\s+)?(?P<value>[^\s"'`]+)""", re.X)  # fmt: skip
_QUOTED_TAIL = re.compile(r"[^\"'`\n]*")
_FLAG = re.compile(r"(?<!\w)--?(?P<name>[A-Za-z][\w\-]*)(?:=|\s+)(?P<quote>[\"']?)(?P<value>[^\s\"']+)")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://(?P<user>[^\s:/@\"'<>]*):(?P<value>[^\s/@\"'<>]+)@[A-Za-z0-9\[]")
_BEARER = re.compile(r"(?i)\b(?:bearer|basic|token)\s+(?P<value>[A-Za-z0-9+/=_.\-~]{16,})")
_HEADER = re.compile(r"""(?i)["'`]?(?:x-)?(?:api|auth|access)[-_](?:key|token)["'`]?\s*[:,=]\s*["'`]?(?P<value>[A-Za-z0-9+/=_.\-~]{12,})""")
_LOGIN = re.compile(r"""(?i)\b(?:log_?in|sign_?in|auth(?:enticate)?|connect|credentials?|basic_?auth)\w*\s*(?:=\s*)?\(\s*["'][^"'\n]{1,64}["']\s*,\s*["'](?P<value>[^"'\n]+)["']""")
_NETRC = re.compile(r"(?i)\bmachine\s+\S+\s+login\s+\S+\s+password\s+(?P<value>\S+)")
_CURL = re.compile(r"(?:^|\s)(?:-u|--user)\s+[\"']?[^\s:\"']+:(?P<value>[^\s\"']+)")
_SPOKEN = re.compile(
    r"(?i)(?<![\w$\{\-/.])(?:pass\s?word|passwd|pwd|pass\s?phrase|passwort|kennwort|mot de passe|mdp|contraseña|clave|api[ _-]?key|secret(?: key)?|access key|token|密码|密钥|口令)"
    r"(?:\s*(?:is now|is|lautet|ist|est|es|为|是|was|[:=：])\s*|\s+)[\"'`]?(?P<value>[^\s\"'`，。]+)")  # fmt: skip
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")

#: Sample words and blanks to be filled in.
_SAMPLE = re.compile(
    r"(?i)^[<\[{(]|[>\]}]$|your[-_ ]?|change[-_]?(?:me|it|this)|replace[-_]?(?:me|this|with)|example|sample|dummy|place-?holder|redacted|insert[-_]|fill[-_]?in|to[-_]?do\b|^[xX0\W_]+$|^(?:x+|\*+|\.+|-+|_+|0+|#+|\?+|abc\d*|test\d*|foo|bar|none|null|nil|true|false|undefined|empty|secret|password|passwd|token|hunter2|letmein|admin|root|1234\d*|qwerty\w*)$|(.)\1{7,}|set[-_ ]in|my[-_](?:secret|password|token|key|api)"
)
_REFERENCE = re.compile(r"(?i)^[$%@!&]?[{(]|^\$\w|^%\w+%$|^(?:process|os|env|std|self|this|config|settings|args|import|secrets?|vault|ssm|keyring|params|ctx|req|request)\b[.:\[]|getenv|environ|^(?:env|var|vault|ref|file|arn|secret|keyvault):|\)$|\($|::")
_PATH = re.compile(r"^\.{0,2}(?:/[a-z0-9_.\-]+){2,}$|^[a-z_\-]+(?:/[a-z_.\-]+)+$|^~/")
_SHOUTED = re.compile(r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$")
_WORDY = re.compile(r"^[A-Za-z]?[a-z]+(?:[-_. ][a-z]+)*$")
_DOTTED = re.compile(r"^[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)+$")


def _parts(name: str) -> list[str]:
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def holds_secret(name: str) -> bool:
    """Whether a variable, key or option of this name holds a credential itself."""
    p = _parts(name)
    if not p:
        return False
    if p[-1] in _SECRET_END or "".join(p[-2:]) in _SECRET_END:
        return not (set(p) & {"max", "min", "num", "count", "limit", "public", "csrf", "next", "page", "sample" if p[-1] == "tokens" else ""})
    return len(p) > 1 and p[-1] == "key" and p[-2] in _KEY_KINDS


def entropy(v: str) -> float:
    """Bits per character."""
    n = len(v)
    return -sum(c / n * math.log2(c / n) for c in Counter(v).values())


def is_secret(v: str, quoted: bool, url: bool = False) -> bool:
    """Whether a value in a credential's place is a literal one.

    Blanks, sample words, references to variables or stores, paths and plain words are not. Bare
    values (without quotes) must not be expressions either. Between the user and the host of a URL
    plain words count.
    """
    if url:
        return len(v) >= 4 and not (_SAMPLE.search(v) or _REFERENCE.search(v) or _SHOUTED.match(v)) and v.lower() not in ("pass", "pwd", "passwd")
    if len(v) < 6 or _SAMPLE.search(v) or _REFERENCE.search(v) or _PATH.match(v) or _SHOUTED.match(v) or _WORDY.match(v) or v.startswith("-----"):
        return False
    if not any(c.isdigit() for c in v) and (len(v) < 12 or v.isupper() or entropy(v) < 3.3) and not (re.search(r"[@!#%^&*?]", v) and len(v) >= 8):
        return False
    if re.fullmatch(r"[\d.,:/\-]+", v):
        return False
    if not quoted and (_DOTTED.match(v) and not re.match(r"^eyJ|^[0-9a-f]{32}\.", v) or re.search(r"[()\[\]{};<>|]", v)):
        return False
    return True


_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_ok(token: str) -> bool | None:
    """Whether a token's own check holds; None for formats that have none.

    Tokens of the code host and of the package registry end with the CRC-32 of what is before, in six
    digits to base 62; a web token's first part is JSON that names an algorithm.
    """
    if m := re.fullmatch(r"(?:gh[opsur]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})", token):
        n, out = zlib.crc32(m[1].encode()), ""
        for _ in range(6):
            n, r = divmod(n, 62)
            out = _DIGITS[r] + out
        return out == m[2]
    if token.startswith("eyJ") and token.count(".") == 2:
        head = token.split(".")[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except (ValueError, TypeError):
            return False
    return None


_automaton = None


def _keyword_lines(text: str, starts: list[int]) -> set[int]:
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for k in KEYWORDS:
            _automaton.add_word(k)
        _automaton.make_automaton()
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return {bisect_right(starts, end) for end, _ in _automaton.iter(low)}


_DOTTED_KEY = re.compile(r"\.(?<=[0-9a-f]{32}\.)[A-Za-z0-9]{16}(?![A-Za-z0-9])")
_OPEN_LINE = re.compile(r"(?:[=:>(\\][ \t]*|\bname[ \t]*:[^\n]*)$")
_NEXT_LINE = re.compile(
    r"""(?:(?<![\w\-])name[ \t]*:[ \t]*["']?(?P<named>[A-Za-z_][\w\-]*)["']?[ \t]*,?\n[ \t]*["']?value["']?\s*:\s*|(?<![\w\-])(?P<name>[A-Za-z_][\w\-]*)["']?[ \t]*(?:=>|:=|=|:)[ \t]*\(?[ \t]*\\?\n[ \t]+)(?P<quote>["'`]?)(?P<value>[^\s"'`]+)(?P=quote)[ \t]*[,;)]*[ \t]*(?=\n|\Z)"""
)
#: A line of a private key, perhaps inside a comment or a string.
_KEY_LINE = re.compile(r"""[ \t#/*>|"'`+]*(?:[A-Za-z0-9+/=]{4,}(?:\\[nr]|["'`,;+\\ \t])*|(?:Proc-Type|DEK-Info|Comment|Version)\s*:[^\n]*)?\r?$""")


def key_end(text: str, begin: re.Match) -> int | None:
    """Where a private key ends: at its END line, or else before the first line that is no key material.

    None if nothing of a key follows the BEGIN line, as where it is only mentioned; a text may end after it.
    """
    line_end = text.find("\n", begin.end())
    line_end = len(text) if line_end < 0 else line_end
    end = _END.search(text, begin.end())
    if end and end.start() <= line_end:
        return end.end()
    rest = text[begin.end() : line_end].strip(" \t\r\"'`,;+\\|")
    if rest and not re.match(r"(?:\\?[nr])?[A-Za-z0-9+/=\\]{16,}", rest):
        return None
    at, some = line_end, bool(rest) or line_end >= len(text)
    while at < len(text):
        stop = text.find("\n", at + 1)
        stop = len(text) if stop < 0 else stop
        line = text[at + 1 : stop]
        if e := _END.search(line):
            return at + 1 + e.end()
        if not _KEY_LINE.match(line):
            break
        some = some or bool(re.search(r"[A-Za-z0-9+/=]{4,}", line))
        at = stop
    return at if some or at >= len(text) else None


def find(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, line from 1, begin, end) of each credential in a text, in order, without overlaps.

    Lines are split at line feeds; a private key counts where it begins (:func:`key_end`); values may be
    of any length. Null and empty texts have none.
    """
    if not text:
        return []
    starts = [m.end() for m in re.finditer("\n", text)]
    bounds = [0, *starts, len(text) + 1]
    found: list[tuple[int, int, str]] = []
    for m in _BEGIN.finditer(text) if "-----BEGIN" in text else ():
        if (e := key_end(text, m)) is not None:
            found.append((m.start(), e, "private_key"))
    for m in _DOTTED_KEY.finditer(text):  # has no keyword that a line could be picked by
        b = m.start() - 32
        if not (b and text[b - 1].isalnum()) and not _SAMPLE.search(text[b : m.end()]):
            found.append((b, m.end(), "dotted_api_key"))
    for line in sorted(_keyword_lines(text, starts)):
        base = bounds[line]
        s = text[base : bounds[line + 1] - 1]
        # the name in this line, its value in the next
        if _OPEN_LINE.search(s) and (m := _NEXT_LINE.search(text, base, bounds[line + 2] - 1 if line + 2 < len(bounds) else len(text))):
            v = m["value"].rstrip(",;")
            if m.start() < base + len(s) and holds_secret(m["name"] or m["named"]) and is_secret(v, bool(m["quote"])):
                found.append((m.start("value"), m.start("value") + len(v), "named"))
        for m in _ISSUER.finditer(s):
            v = m.group()
            if not _SAMPLE.search(v) and len(set(v)) > 6:
                found.append((base + m.start(), base + m.end(), m.lastgroup))
        hits = []
        if "://" in s:
            hits += [(m, "url_password", True) for m in _URL.finditer(s)]
        for m in _NAMED.finditer(s):
            if holds_secret(m["name"]) or (m["name"].lower() in ("authorization", "proxy-authorization")):
                hits.append((m, "named", bool(m["quote"])))
        hits += [(m, "option", bool(m["quote"])) for m in _FLAG.finditer(s) if holds_secret(m["name"])] if "-" in s else []
        low = s.lower()
        if "bearer" in low or "authorization" in low:
            hits += [(m, "bearer", True) for m in _BEARER.finditer(s)]
        if "key" in low or "token" in low:
            hits += [(m, "header", True) for m in _HEADER.finditer(s)]
        if "(" in s:
            hits += [(m, "login", True) for m in _LOGIN.finditer(s)]
        if "machine" in low:
            hits += [(m, "login", True) for m in _NETRC.finditer(s)]
        if "curl" in low:
            hits += [(m, "login", True) for m in _CURL.finditer(s)]
        hits += [(m, "spoken", False) for m in _SPOKEN.finditer(s)]
        for m, kind, quoted in hits:
            b, e = m.span("value")
            v = s[b:e]
            if not quoted:
                v = v.rstrip(",;.:)]}\"'") if kind != "spoken" else v.rstrip(",;.:)]}\"'")
            elif kind == "named":
                e = b + len(_QUOTED_TAIL.match(s, b).group())
                v = s[b:e]
                if len(m["quote"]) < 3 and " " in v.strip():
                    continue  # a sentence, not a value
            if is_secret(v, quoted, kind == "url_password"):
                found.append((base + b, base + b + len(v), kind))
    found.sort(key=lambda x: (x[0], -x[1]))
    out, reached = [], -1
    for b, e, kind in found:
        if b >= reached:
            out.append((kind, bisect_right(starts, b) + 1, b, e))
            reached = e
    return out


_HIDE = str.maketrans({**{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}, **{chr(c): "0" for c in range(48, 58)}})


def redact(text: str | None, spans: list[tuple[str, int, int, int]]) -> str | None:
    """The text with each credential's letters and digits replaced by others of their class.

    Signs, line breaks and the BEGIN and END lines of keys stay, and so does the length.
    """
    if not spans:
        return text
    out, at = [], 0
    for kind, _, b, e in spans:
        out.append(text[at:b])
        span = text[b:e]
        if kind == "private_key":
            head, tail = _BEGIN.match(span).end(), (m.start() if (m := _END.search(span)) else len(span))
            span = span[:head] + re.sub(r"\\[nr]|[A-Za-z0-9]+", lambda m: m.group() if m.group()[0] == "\\" else m.group().translate(_HIDE), span[head:tail]) + span[tail:]
        else:
            span = span.translate(_HIDE)
        out.append(span)
        at = e
    return "".join([*out, text[at:]])


FOUND = "array<struct<kind: string, line_no: int, begin: int, end: int, checksum: boolean>>"


def find_credentials(df: DataFrame, text: str = "content", redacted: bool = True, keys: list[str] | None = None, version: str | None = None) -> DataFrame:
    """One row per input row that holds credentials: its other columns, ``found`` and the hidden text.

    ``found`` is an array of kind, line, begin, end and checksum (whether the format's own check holds, null
    where it has none: a token that fails it is reported all the same). The text column holds the
    redacted text; with ``redacted`` false it is left out. Rows are independent, and texts are read
    whole. With ``keys`` and ``version`` only the row with the greatest version of each key counts; it
    is picked after the search, so nothing but what was found is shuffled. An existing column ``found``
    is replaced. Null and empty texts have no credentials; repeated rows are found each.
    """
    rest = [c for c in df.columns if c not in (text, "found")]

    def listed(t: str | None, spans: list) -> list[dict]:
        return [dict(zip(("kind", "line_no", "begin", "end", "checksum"), (*x, checksum_ok(t[x[2] : x[3]])))) for x in spans]

    @F.pandas_udf(f"struct<hidden: string, found: {FOUND}>")
    def search(content: pd.Series) -> pd.DataFrame:
        spans = [find(t) for t in content]
        hidden = [redact(t, x) if x and redacted else None for t, x in zip(content, spans)]
        return pd.DataFrame({"hidden": pd.Series(hidden, dtype=object), "found": pd.Series([listed(t, x) for t, x in zip(content, spans)], dtype=object)})

    out = df.select(*rest, search(text).alias("_hit"), *([F.xxhash64(text).alias("_text")] if version else []))
    if version:
        out = latest(out, keys, version, tie=["_text"]).drop("_text")
    out = out.filter(F.size("_hit.found") > 0)
    return out.select(*rest, *([F.col("_hit.hidden").alias(text)] if redacted else []), F.col("_hit.found").alias("found"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, id, content and version of all file chunks and stored messages (chunks have one version)."""
    chunks = table(spark, sf_dir, "file_chunks").select(F.lit("file_chunks").alias("source"), F.col("chunk_id").alias("id"), "content", F.lit(None).cast("timestamp").alias("version"))
    said = table(spark, sf_dir, "messages").select(F.lit("messages").alias("source"), "id", "content", F.col("ingested_at").alias("version"))
    return chunks.unionByName(said)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source``, ``id`` and ``line_no`` of each line in which a credential begins."""
    found = find_credentials(texts(spark, sf_dir), redacted=False, keys=["source", "id"], version="version")
    return found.select("source", "id", F.explode("found.line_no").alias("line_no")).distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that hold credentials, with these hidden, and how many each has."""
    hidden = find_credentials(texts(spark, sf_dir), keys=["source", "id"], version="version")
    return hidden.select("source", "id", "content", F.size("found").alias("n_credentials")).distinct()
