"""Problem 9: template residue, filler, error pages and notices that scripts are required.

Texts are cut into passages. A passage that has the plain form of an error message, a notice, filler
or an unfilled placeholder is trusted to be residue; all others are unlabelled. A naive Bayes model
is learned from trusted and unlabelled passages by expectation-maximization, every passage of the
corpus taking part, and its passage scores are put together into one decision per record.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Size of the hashed feature space: what the driver sees of the corpus per round is one count pair per feature.
N_FEATURES = 1 << 15
ROUNDS = 4
#: Most of all passages that EM may take for residue before it looks at them.
MAX_PRIOR = 0.1
#: A record is residue if so much of its passages' text is.
SHARE = 0.5

_FENCE = re.compile(r"^(?:```|~~~).*?(?:^(?:```|~~~)[ \t]*$|\Z)", re.S | re.M)
_QUOTED = re.compile(r"`[^`\n]+`|\"[^\"\n]{1,80}\"|“[^”\n]{1,80}”|(?<!\w)'[^'\n]{1,60}'(?!\w)")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>|<!--.*?-->")
_HTML = re.compile(r"(?i)</?(?:html|head|body|title|center|div|p|h[1-6]|noscript|span|br|hr|script|meta|link|!doctype)\b")

#: Forms of unfilled placeholders.
_PLACEHOLDER = re.compile(
    r"\{\{\s*[\w.\-]+\s*\}\}|\$\{\w+\}|<%=?\s*[\w.]+\s*%>|#\{\w+\}|%%\w+%%|(?<![\w.])__[A-Za-z]+(?:_[A-Za-z]+)*__(?!\w|\s*[(=:,.\]])|«\s*[\w ]+\s*»|(?<![\w$])\$[A-Za-z]+(?:_[A-Za-z]+)*\$(?!\w)|(?<![\w$#{])\{[A-Za-z]\w*\}(?!\})"
    r"|(?<!#)(?<!#!)\[(?:(?:insert|enter|your|add|type|describe|first|last|full|project|company|user|date|name|title|author|branch|module|version|release|ticket|feature|summary|placeholder)\b[^\]\n]{0,50}|(?-i:[A-Z]{2,}(?:[ _][A-Z]+)+))\](?!\()"
    r"|<(?:describe|insert|your|enter|add|fill|name|title|date|project|author|placeholder|tbd)\b[^<>\n]{0,50}>",
    re.I,
)
_DUNDER = re.compile(r"__(?:init|main|name|file|all|dict|class|str|repr|enter|exit|call|doc|version|author|slots|future|new|len|iter|next|eq|hash|getattr|setattr|getitem|setitem|del|post_init)__")

#: Forms of passages that are trusted to be residue.
_TRUSTED = re.compile(
    r"""(?ix) ^\W*(?:
      (?:error|erreur|fehler|http)?\W*(?:4\d\d|50\d)\W*(?:[-:–]\W*)?(?:not\ found|forbidden|unauthori[sz]ed|bad\ (?:request|gateway)|internal\ server\ error|service\ (?:temporarily\ )?unavailable|gateway\ time-?out|too\ many\ requests|gone|method\ not\ allowed|request\ time-?out)\W*$
    | (?:error|erreur|fehler)\ (?:4\d\d|50\d)\b
    | (?:you\ need\ to|please|you\ must|bitte|veuillez|necesitas|por\ favor|debes?)\b.{0,40}\b(?:enable|turn\ on|allow|activ\w+|aktivier\w+|habilit\w+)\b.{0,30}\b(?:javascript|scripts?|cookies)\b.*
    | (?:javascript|scripting|scripts?)\ (?:is|are|has\ been)\ (?:disabled|turned\ off|required|blocked|not\ (?:enabled|supported|available))\b.*
    | checking\ (?:your|if\ the)\ (?:connection|browser|site)\b.{0,100} | (?:this\ is\ (?:a|an|just\ a)\ )?(?:placeholder|dummy|sample|example|filler)\ (?:text|paragraph|content|page|section)\b.{0,100} | this\ (?:section|page|paragraph|text)\ is\ (?:intentionally\ )?(?:left\ )?(?:blank|empty|as\ sample|a\ placeholder|a\ stub)\b.{0,40}
    | .{0,40}\brequires?\ (?:javascript|scripts|cookies)\b.{0,80}
    | (?:noscript:?\ )?.{0,40}\b(?:needs?|must\ have)\ (?:javascript|scripts|cookies)\b.{0,30}\bto\ (?:continue|work|run|function|load|be\ (?:shown|displayed))\b.{0,40}
    | .{0,60}\b(?:javascript|scripts|scripting|cookies)\b.{0,20}\b(?:turned\ off|switched\ off|disabled|deactivated)\b.{0,80}$
    | .{0,30}\b(?:allow|enable|activate)\ (?:javascript|scripts|cookies)\ (?:for|on|in)\ (?:this|your)\b.{0,40}
    | (?:your\ )?session\ (?:has\ )?(?:expired|timed\ out)\b.{0,60} | too\ many\ requests\b.{0,80}
    | your\ browser\ (?:does\ not|doesn't|is\ not)\b.{0,30}\b(?:support|script).*
    | (?:seite|page|página)\ (?:nicht\ gefunden|not\ found|introuvable|no\ encontrada)\b.*
    | (?:access|zugriff|accès|acceso)\ (?:denied|verweigert|refusé|denegado)\b.{0,40}$
    | (?:oops|whoops|ups)\W.{0,60} | something\ went\ wrong\W*$ | .{0,40}\btemporarily\ unavailable\b.{0,100}
    | the\ page\ you\ (?:are|were)\ looking\ for\b.* | (?:we\ )?(?:couldn't|could\ not)\ find\ (?:that|the|this)\ page\W*$ | this\ (?:site|page)\ (?:can't|cannot)\ be\ (?:reached|displayed|found)\b.*
    | .*\blorem\ ipsum\b.*dolor.* | (?:lorem\ ipsum\W*){1,9}$ | (?:blah\W+){2,}.* | (?:asdf|qwer|jkl|xxx|foo|bar|test|sample\ text|example\ text|dummy\ text|placeholder\ text)(?:\W+(?:asdf|qwer|jkl|xxx|foo|bar|test|sample\ text|example\ text|dummy\ text|placeholder\ text|text))*\W*$
    | (?:tbd|tba|tbw|todo|n/a|coming\ soon|to\ be\ (?:written|added|done|announced|defined|completed)|text\ to\ follow|text\ goes\ here|under\ construction|placeholder|description|content\ goes\ here|untitled(?:\ page)?)\W*$
    | (?:your|insert|enter|replace|fill\ in|add)\b.{0,60}\b(?:here|with\ your\ own\ words|of\ this\ section|details|text)\b.{0,20}$
    | todo:?\ (?:describe|add|write|fill|insert|explain)\b.{0,40}$
    ).{0,0}"""
)


_MAY_HOLD = re.compile(r"[{<\[«%_$]")


def passages(text: str) -> list[tuple[str, int]]:
    """A text's passages and their placeholders: lines without code blocks and markup.

    Placeholders that stand in quotes, code or code blocks are part of a real text and don't count.
    """
    body = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in body or "~~~" in body:
        body = _FENCE.sub("\n```\n", body)
    out = []
    for line in body.split("\n"):
        bare = line
        n = 0
        if _MAY_HOLD.search(line):
            bare = _QUOTED.sub(" quoted ", line)
            n = len(_PLACEHOLDER.findall(_DUNDER.sub(" ", bare)))
            if n:
                bare = _PLACEHOLDER.sub(" placeholder ", bare)
                line = _PLACEHOLDER.sub(" placeholder ", _QUOTED.sub(" quoted ", line))
        if "<" in line and _HTML.search(line):
            line = _TAG.sub(" ", line)
        if line.strip():
            out.append((line.strip(), n))
    return out


_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:def|class|fn|pub|let|const|var|import|from|return|if|for|while|async|export|use|impl|static|function|total|items)\b.*[(={:;]|^\s*(?://|/\*|\*|#!|@\w+|\"\"\"|''')|^\s*[\w.]+\s*(?:\+?=|\()|=>")
_HEADING = re.compile(r"^(?:#{1,6}\s|={3,}|-{3,}|\|[-| :]+\|$)|^\W*$")
_WORD = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+(?:'[^\W\d_]+)?|\d+")
_CODE_NAME = re.compile(r"\w[/_]\w|\w\(")


#: Each trusted form has one of these words.
_TRIGGERS = set(
    "found forbidden unauthorized unauthorised bad internal service gateway many gone method request requests error erreur fehler http javascript script scripts scripting cookies checking placeholder dummy sample example filler section page paragraph text "
    "session browser seite página access zugriff accès acceso oops whoops ups wrong temporarily site lorem blah asdf qwer jkl xxx foo bar test tbd tba tbw todo n coming written added done announced defined completed construction description content untitled here words details".split()
)
_TRIGGERS |= {w + "'s" for w in _TRIGGERS}


def is_trusted(passage: str, placeholders: int, words: list[str]) -> bool:
    """Whether a passage has the plain form of residue; ``words`` are its words in lower case."""
    if placeholders >= 2 or not _TRIGGERS.isdisjoint(words) and _TRUSTED.match(passage):
        return True
    return placeholders == 1 and bool(re.fullmatch(r"\W*(?:[\w ]{1,24}:)?\W*placeholder\W*", passage))


class _Hashes(dict):
    """Hash of a word, numbers by their length; remembers a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest("0000"[: len(word)] if word.isdecimal() else word)
        return h


def features_of(words: list[list[str]], placeholders: list[int], forms: list[int], memory: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, neighbours, opening and form of passages, each once: (features, how many each passage has).

    ``forms`` is 1 where a passage has quotes, plus 2 where it has code names.
    """
    n = np.array([len(w) for w in words], np.int64)
    h = np.fromiter(map(memory.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum()))
    row, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    pair = np.nonzero(row[1:] == row[:-1])[0]
    some, two = np.nonzero(n > 0)[0], np.nonzero(n > 1)[0]
    opening = np.zeros(len(n), np.uint64)
    opening[some] += h[first[some]]
    opening[two] += h[first[two] + 1]
    table = lambda name, most: np.array([xxhash.xxh32_intdigest(f"{name} {i}") for i in range(most)], np.uint64)
    bits = np.frexp(np.minimum(n, 40))[1]  # length in binary digits
    form, every = np.array(forms, np.int64), np.arange(len(n))
    quoted, coded = np.nonzero(form & 1)[0], np.nonzero(form & 2)[0]
    rows = [row, row[pair], every, every, every, quoted, coded]
    raw = [h, h[pair] * np.uint64(31) + h[pair + 1] * np.uint64(7) + np.uint64(1), opening + np.uint64(3), table("len", 8)[bits], table("ph", 4)[np.minimum(np.array(placeholders, np.int64), 3)]]
    raw += [np.full(len(x), xxhash.xxh32_intdigest(name), np.uint64) for name, x in (("has quotes", quoted), ("has code names", coded))]
    index = (np.concatenate(raw).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(17)
    wide = np.uint32 if len(n) < 1 << 17 else np.uint64  # short keys sort faster
    keys = np.concatenate(rows).astype(wide) << wide(15) | index
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return (keys & wide(N_FEATURES - 1)).astype("i4"), np.bincount((keys >> wide(15)).astype(np.int64), minlength=len(n)).astype("i4")


RECORD = "features array<int>, length array<int>, size array<int>, trusted array<boolean>, placeholders array<int>"


def records(docs: DataFrame) -> DataFrame:
    """Each document's passages as hashed features: doc_id and the columns of ``RECORD``.

    ``features`` holds those of all passages one after the other, ``length`` how many each has.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Hashes()
        for batch in batches:
            words, forms, size, trusted, placeholders, at = [], [], array("i"), bytearray(), array("i"), array("i", [0])
            for text in batch.column("text").to_pylist():
                for p, n in passages(text):
                    if _HEADING.match(p) and not n or p == "```":
                        continue  # a heading or rule alone says nothing either way
                    code = n < 2 and _CODE_LINE.search(p) is not None  # has no features
                    w = [] if code else _WORD.findall(p.lower())
                    words.append(w)
                    forms.append(-1 if code else ("`" in p or '"' in p or "quoted" in w) + 2 * (_CODE_NAME.search(p) is not None))
                    size.append(len(p))
                    trusted.append(not code and is_trusted(p, n, w))
                    placeholders.append(0 if code else n)
                at.append(len(words))
            told = [i for i, f in enumerate(forms) if f >= 0]
            features, n_features = features_of([words[i] for i in told], [placeholders[i] for i in told], [forms[i] for i in told], memory)
            length = np.zeros(len(words), "i4")
            length[told] = n_features
            ends = np.concatenate([[0], np.cumsum(length)]).astype("i4")
            per_text = np.frombuffer(at, "i4")
            lists = [pa.ListArray.from_arrays(pa.array(ends[per_text]), pa.array(features))]
            lists += [pa.ListArray.from_arrays(pa.array(per_text), pa.array(x)) for x in (length, np.frombuffer(size, "i4"), np.frombuffer(trusted, "u1").astype(bool), np.frombuffer(placeholders, "i4"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "features", "length", "size", "trusted", "placeholders"])

    return docs.select("doc_id", "text").filter("text is not null and text rlike '\\\\S'").mapInArrow(run, f"doc_id {kind}, {RECORD}")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passage of each feature, feature, whether each passage is trusted, and its record."""
    trusted = batch.column("trusted").flatten().to_numpy(zero_copy_only=False).astype(bool)
    length = batch.column("length").flatten().to_numpy(zero_copy_only=False)
    record = np.repeat(np.arange(batch.num_rows), batch.column("trusted").value_lengths().to_numpy(zero_copy_only=False))
    return np.repeat(np.arange(len(length)), length), batch.column("features").flatten().to_numpy(zero_copy_only=False), trusted, record


def _evidence(row: np.ndarray, col: np.ndarray, n: int, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each passage, and which passages have features at all."""
    k = np.bincount(row, minlength=n)
    # neighbours and words repeat each other: temper the evidence of long passages
    return np.bincount(row, weights=odds[col], minlength=n) * np.minimum(1.0, 24 / np.maximum(k, 1)), k > 0


def _posterior(batch: pa.RecordBatch, model: tuple[np.ndarray, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features' passages, features, and each passage's probability and whether it has features.

    Trusted passages have probability 1. Another passage's prior is the corpus' one, or half of what
    the surest other passage of its record has, if that is more. Without a model, passages beside a
    trusted one have one half and all others none.
    """
    row, col, trusted, record = _flat(batch)
    n, records = len(trusted), batch.num_rows

    def surest_other(p: np.ndarray) -> np.ndarray:
        best, second = np.zeros(records), np.zeros(records)
        np.maximum.at(best, record, p)
        is_best = p == best[record]
        several = np.bincount(record, weights=is_best, minlength=records) > 1
        np.maximum.at(second, record[~is_best], p[~is_best])
        return np.where(is_best & ~several[record], second[record], best[record])

    if model is None:
        p = np.where(trusted, 1.0, 0.5 * surest_other(trusted.astype(float)))
        return row, col, p, np.bincount(row, minlength=n) > 0
    odds, prior = model
    z, seen = _evidence(row, col, n, odds)
    first = np.where(trusted, 1.0, np.where(seen, 1 / (1 + np.exp(-np.clip(z + prior, -40, 40))), 0.0))
    share = np.clip(0.5 * surest_other(first), 1 / (1 + np.exp(-prior)), 0.5)
    p = 1 / (1 + np.exp(-np.clip(z + np.log(share / (1 - share)), -40, 40)))
    return row, col, np.where(trusted, 1.0, np.where(seen, p, 0.0)), seen


def fit(data: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Log odds of each feature and of the prior, by EM over all passages.

    Trusted passages stay residue; the others count by their probability. A round is one pass: each task sums its passages' feature counts, and one count pair per feature and task
    is shuffled.
    """
    spark = data.sparkSession
    model = None
    for _ in range(rounds + 1):
        shared = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pos, neg = np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1)
            for batch in batches:
                row, col, p, seen = _posterior(batch, shared.value)
                if not len(p):
                    continue
                pos[:-1] += np.bincount(col, weights=p[row], minlength=N_FEATURES)
                neg[:-1] += np.bincount(col, weights=1 - p[row], minlength=N_FEATURES)
                pos[-1] += p[seen].sum()
                neg[-1] += (1 - p)[seen].sum()
            at = np.nonzero(pos + neg)[0]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(pos[at]), pa.array(neg[at])], ["feature", "pos", "neg"])

        sums = data.select("features", "length", "trusted").mapInArrow(count, "feature int, pos double, neg double").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
        pos, neg = np.zeros(N_FEATURES), np.zeros(N_FEATURES)
        n_pos = n_neg = 0.0
        for r in sums:
            if r.feature == N_FEATURES:
                n_pos, n_neg = r.pos, r.neg
            else:
                pos[r.feature], neg[r.feature] = r.pos, r.neg
        odds = np.log((pos + 0.05) / (n_pos + 1)) - np.log((neg + 0.05) / (n_neg + 1))
        odds[(pos + neg) == 0] = 0.0
        share = min(MAX_PRIOR, max(n_pos / max(n_pos + n_neg, 1), 1e-4))
        model = (np.clip(odds, -6, 6), float(np.log(share / (1 - share))))
    return model


def decide(p: np.ndarray, size: np.ndarray, placeholders: np.ndarray) -> bool:
    """Whether a record is residue, from its passages' probabilities.

    It is if most of its text is in residue passages, or if it is an unfilled template: two or more
    placeholders stand outside of code and quotes in passages that score as residue.
    """
    if not len(p):
        return False
    residue = p >= 0.5
    if placeholders[residue].sum() >= 2:
        return True
    return bool(residue.any() and size[residue].sum() >= SHARE * size.sum())


def find_residue(docs: DataFrame) -> DataFrame:
    """``doc_id`` of each document (doc_id, text) that is template residue, filler, an error page or a notice.

    Null, empty and blank texts are none, nor are texts of code or headings alone. Texts are read
    whole. Documents don't meet: what is shuffled is one count pair per feature and task and round.
    Repeated documents are decided each; an empty input gives an empty result; other columns are ignored.
    """
    data = materialize(records(docs), "residue-passages")
    shared = docs.sparkSession.sparkContext.broadcast(fit(data))

    def residue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _posterior(batch, shared.value)[2]
            size, placeholders = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("size", "placeholders"))
            ends = np.cumsum(batch.column("size").value_lengths().to_numpy(zero_copy_only=False))
            keep = [decide(p[a:b], size[a:b], placeholders[a:b]) for a, b in zip([0, *ends[:-1]], ends)] if len(ends) else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(keep, pa.bool_()))], ["doc_id"])

    return data.mapInArrow(residue, f"doc_id {dict(docs.dtypes)['doc_id']}")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to be left out."""
    return find_residue(spark.read.parquet(f"{sf_dir}/documents.parquet")).distinct()
