"""Problem 1: broken prompt and response pairs, each with its kind of defect.

A pair is a user row and the assistant row next after it. Copies, cut-off replies, empty ones and
replies in another language are told from the pair itself. Refusals come from the whole corpus:
response openings are clustered by verified MinHash, and clusters that recur across unrelated
prompts are refusal templates if they decline or go on with what usually follows refusals. What the
templates have in common is learned, and tells the refusals among openings that are too rare to
recur. A reply is a refusal if it opens with one and the rest of it gives nothing either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import bucketed_previous
from ..session import materialize
from ..tables import messages, role_of
from . import lang

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 8, 4
#: Members of a band that are compared at once with each other, or with as many others.
BLOCK = 256
#: A template recurs across at least so many different prompts, and shares at most so much of its words with them.
MIN_PROMPTS, MAX_RELATED = 3, 0.34
#: Size of the classifier's hashed feature space, and the most replies of each label it is fitted on.
N_FEATURES, TRAINING, SIGN = 1 << 12, 1000, 4

_HAS_TEXT = re.compile(r"[^\W_]")
_TOKENS = re.compile(r"[぀-ヿ一-鿿가-힯]|[^\W_぀-ヿ一-鿿가-힯]+")

# ---- copies


def is_copy(prompt: str, reply: str) -> bool:
    """Whether the reply consists of the prompt, perhaps introduced or slightly changed.

    Nearly all of the prompt's words must come again in their order, and hardly anything else.
    """
    p, r = _TOKENS.findall(prompt.lower()), _TOKENS.findall(reply.lower())
    if not p or len(r) < 0.75 * len(p):
        return False
    known, most, said = set(p), max(3 if len(p) > 3 else 2, 0.2 * len(p)), set(r)
    if len(said - known) > most or len(known & said) < 0.75 * len(known) or sum(w not in known for w in r) > most:
        return False
    # in order: greedy walk through the prompt, forgiving changed words
    at, hits = 0, 0
    where: dict[str, list[int]] = {}
    for i, w in enumerate(p):
        where.setdefault(w, []).append(i)
    for w in r:
        for i in where.get(w, ()):
            if at <= i <= at + 6:
                at, hits = i + 1, hits + 1
                break
    if hits < 0.7 * len(p):
        return False
    # an answer after the copy: a closing part of at least two strange words in a sentence of its own
    tail = re.split(r"(?<=[.!?。！？])\s+|\n+", reply.strip())[-1]
    t = _TOKENS.findall(tail.lower())
    return not (t and len(t) < len(r) and sum(w not in known for w in t) > 0.6 * len(t))


# ---- cut off

_COMPLETE = re.compile(r"""[.!?…。！？；」』”’"'»)\]>}|*_~✅👍🙂]\s*$""")
_BARE_ANSWER = re.compile(r"^[\W_]*(?:[\d.,:%\-]+|\w+|[\w.\-]+/[\w./\-]+|`[^`]*`)[\W_]*$")
_DANGLING_ITEM = re.compile(r"(?:^|\n)[ \t]*(?:\d{1,3}[.)]|[-*+•])[ \t]*$")
_CUT_PATH = re.compile(r"(?:^|\s)[\w\-]+(?:/[\w\-]+)+\.$")


def is_truncated(reply: str) -> bool:
    """Whether the reply stops inside a code block, a list item or a sentence."""
    if len(re.findall(r"^[ \t]*(?:```|~~~)", reply, re.M)) % 2 == 1:
        return True
    t = reply.rstrip()
    if _DANGLING_ITEM.search(reply.rstrip(" \t")) and "\n" in t:
        return True
    last = t.rsplit("\n", 1)[-1].strip()
    if last.startswith(("```", "~~~")) or last.startswith("|") and last.endswith("|"):
        return False
    if re.sub(r"```.*?```", "", t, flags=re.S).count("`") % 2:
        return True
    if _CUT_PATH.search(last):
        return True
    if _COMPLETE.search(t) or t.endswith("`"):
        return False
    if _BARE_ANSWER.match(last) and not re.search(r"[,;:\-–—(]$", last):
        # a bare value or word is a complete answer on a line of its own, unless it goes on a sentence
        return bool(re.match(r"^[^\W\d]+$", last)) and "\n" in t and not re.search(r"[.!?:。！？]\s*$", t.rsplit("\n", 1)[0])
    if re.match(r"^(?:#+ |[\w /.\-]{1,24}[:=]\s*\S+$)", last):
        return False  # a heading or a field on a line of its own
    return True


# ---- another language

#: Names of languages in a request for one.
_ASKED = {
    "en": r"english|anglais|englisch\w*|ingl[eé]s|英文|英语", "fr": r"french|fran[cç]ais|franz[oö]sisch\w*|franc[eé]s|法文|法语",
    "de": r"german|allemand|deutsch\w*|alem[aá]n|德文|德语", "es": r"spanish|espagnol|spanisch\w*|espa[nñ]ol|castellano|西班牙\w*", "zh": r"chinese|mandarin|chinois|chinesisch\w*|chino|中文|汉语",
    "it": r"italian|italien|italienisch\w*|italiano", "pt": r"portuguese|portugais|portugiesisch\w*|portugu[eê]s", "ja": r"japanese|japonais|japanisch\w*|japon[eé]s|日文|日语", "ru": r"russian|russe|russisch\w*|ruso", "ko": r"korean|cor[eé]en|koreanisch\w*|coreano",
}
_ASKED = {k: re.compile(rf"(?<![^\W_])(?:{v})(?![^\W_])" if k not in ("zh", "ja") else v, re.I) for k, v in _ASKED.items()}


def other_language(prompt: str, reply: str) -> bool:
    """Whether the reply is in a language that the prompt neither uses nor names."""
    if lang.same(prompt, reply):
        return False
    said = lang.languages(reply)
    if not said:
        return False
    main = max(said, key=said.get)
    asked = lang.languages(prompt)
    if not asked or main in asked or said[main] < 0.6 * sum(said.values()):
        return False
    return main not in _ASKED or not _ASKED[main].search(prompt)


# ---- refusals

#: Phrases that decline, and closings that often follow.
_DECLINE = re.compile(
    r"""(?ix)
    (?:\b(?:can(?:'|no)t|can\ not|won't|will\ not|not\ able\ to|unable\ to|not\ allowed\ to|not\ permitted\ to|not\ (?:going|willing)\ to|(?:would|'d)\ (?:prefer|rather)\ not(?:\ to)?|must\ refuse|have\ to\ refuse|refuse\ to|decline\ to|(?:do\ not|don't|doesn't|does\ not)\ (?:allow|permit)\ me\ to|not\ possible\ for\ me\ to|not\ in\ a\ position\ to|feel\ comfortable|comfortable)\b
       [^.!?;]{0,30}?\b(?:help(?:ing)?|assist(?:ing)?|answer(?:ing)?|comply(?:ing)?|provid(?:e|ing)|discuss(?:ing)?|fulfil\w*|continu(?:e|ing)|writ(?:e|ing)\ (?:that|this|it)|giv(?:e|ing)\ you|tak(?:e|ing)\ part|do(?:ing)?\ (?:that|this|so|it)|support(?:ing)?|engag(?:e|ing)|respond(?:ing)?|shar(?:e|ing)|talk(?:ing)?|participat(?:e|ing)|proceed(?:ing)?|creat(?:e|ing)|offer(?:ing)?|generat(?:e|ing))\b)
    | \b(?:must|have\ to|need\ to|'ll|will)\ (?:respectfully\ |politely\ )?decline\b | \bi\ (?:respectfully\ |politely\ )?(?:decline|refuse)\b | \boutside\ (?:of\ )?what\ i\ may\ do\b
    | \bnot\ (?:permitted|allowed)\ to\ (?:discuss|answer|help|talk)\b
    | \b(?:je\ )?ne\ (?:peux|puis|suis)\ (?:malheureusement\ )?pas\ (?:autoris\w+\ à|en\ mesure\ de|capable\ de)?\s*(?:vous\ |t'|te\ )?(?:aider|répondre|satisfaire|fournir|faire|continuer|assister|donner|traiter|discuter)\b | \bje\ (?:dois|préfère)\ (?:refuser|décliner|ne\ pas)\b | \bje\ refuse\b | \bil\ m'est\ impossible\ de\b
    | \b(?:kann|darf|möchte|werde)\ (?:ich\ )?(?:\w+\ ){0,4}?nicht\ (?:\w+\ ){0,3}?(?:helfen|beantworten|antworten|weiterhelfen|unterstützen|erfüllen|nachkommen|bearbeiten|fortfahren|liefern|geben|besprechen|dienen)\b | \bmuss\ ich\ (?:leider\ )?ablehnen\b | \b(?:ich\ )?(?:lehne|muss)\ [\w\ ]{0,30}\bab(?:lehnen)?\b | \bnicht\ (?:gestattet|erlaubt|möglich)[,\ ]
    | \bno\ (?:puedo|podr[eé]|voy\ a)\ (?:\w+\ ){0,2}?(?:ayudar\w*|responder|contestar|cumplir|proporcionar|continuar|hacer\w*|dar\w*|atender|hablar|asistir)\b | \bno\ (?:me\ )?est[áa]\ permitido\b | \bno\ (?:me\ es\ posible|tengo\ permitido|estoy\ autorizad\w)\b | \b(?:debo|tengo\ que|prefiero)\ (?:rechazar|declinar|negarme|no)\b
    | (?:无法|不能|不便|不可以|没办法)[^。！？]{0,12}?(?:帮|协助|回答|提供|满足|回应|讨论|继续|处理|完成) | 拒绝(?:回答|提供|这个|该) | 不(?:允许|被允许|会)[^。！？]{0,6}?(?:回答|讨论|提供|协助)
    """
)
_CLOSING = re.compile(
    r"""(?ix) hope\ (?:you|this|that)\ (?:understand|is) | (?:something|anything)\ else | another\ (?:question|topic) | feel\ free\ to\ ask | (?:only|happy\ to)\ (?:talk|help)\b.*\b(?:general|other|else) | general\ topics | consult\ | expert | professional | somebody\ (?:else|qualified) | thank(?:s|\ you)\ for | understand\ the\ (?:question|request) | let\ me\ know
    | outside\ (?:of\ )?(?:what|my) | (?:usage|content|safety)\ policy | with\ regret | autre\ (?:question|chose|demande) | n'hésitez\ pas | compréhension | verständnis | andere[rns]?\ (?:frage|thema|anliegen) | gerne?\ (?:bei|etwas) | otra\ (?:pregunta|cosa|consulta) | en\ qué\ más | comprensi[oó]n | 其他(?:问题|方面)|谅解|理解 | ^\W*(?:sorry|no|i'm\ sorry|unfortunately|i\ apologi[sz]e|désolé|lo\ siento|es\ tut\ mir\ leid|抱歉|对不起)\W*$
    """
)
_SPECIFIC = re.compile(r"`|\w+_\w+|\w/\w|\b\d+\b|\w\(\)|::|https?:")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")


def straight(text: str) -> str:
    return text.replace("’", "'").replace("‘", "'").strip()


def declines(sentence: str) -> bool:
    """Whether a sentence declines to answer and says nothing specific beside it."""
    return bool(_DECLINE.search(sentence)) and not _SPECIFIC.search(sentence)


def gives_nothing_else(sentences: list[str]) -> bool:
    """Whether each sentence after the opening declines or is a usual closing."""
    return all(declines(s) or _CLOSING.search(s) and not _SPECIFIC.search(s) for s in sentences)


def opening_of(sentence: str) -> str:
    """An opening's words for comparison: lower case, numbers and code names masked."""
    s = re.sub(r"`[^`]*`|\S*[_/]\S*|\S*\d\S*", " # ", sentence.lower())
    return " ".join(re.findall(r"[^\W_]+(?:'[^\W_]+)?|#", s))


# ---- MinHash over openings

_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, (1 << 31) - 1, BANDS * ROWS, dtype=np.int64) | 1
_B = _RNG.integers(0, (1 << 31) - 1, BANDS * ROWS, dtype=np.int64)
_P = (1 << 31) - 1


def shingles(opening: str) -> set[str]:
    """Five-word shingles; a shorter opening is one shingle."""
    w = opening.split()
    return {" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}


_shingles = lru_cache(20_000)(shingles)


def bands_of(opening: str) -> list[int]:
    h = np.array([xxhash.xxh32_intdigest(s) >> 1 for s in shingles(opening)], np.int64)
    sig = ((h[:, None] * _A + _B) % _P).min(0).reshape(BANDS, ROWS)
    return [(xxhash.xxh64_intdigest(row.tobytes(), i) >> 1) for i, row in enumerate(sig)]


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def band_links(openings: list[str], first: int) -> list[tuple[str, str]]:
    """Links (opening, least opening of its group) among similar openings of a band.

    Those before ``first`` are compared with each other and the others, the others only with those
    before; ``first`` of 0 compares all. Pairs already in one group need no comparison.
    """
    sets, up = [_shingles(o) for o in openings], list(range(len(openings)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for j in range(len(openings)):
        for i in range(min(j, first or j)):
            a, b = root(i), root(j)
            if a != b and len(sets[i] & sets[j]) >= SIMILARITY * len(sets[i] | sets[j]):
                up[max(a, b)] = min(a, b)
    least: dict[int, str] = {}
    for i, o in enumerate(openings):
        least[root(i)] = min(o, least.get(root(i), o))
    return [(o, least[root(i)]) for i, o in enumerate(openings) if o != least[root(i)]]


def clusters_of(openings: DataFrame) -> DataFrame:
    """``opening`` and the least opening of its cluster (``head``), for distinct openings.

    All members of a MinHash band are compared, in pairs of blocks of at most ``BLOCK``, so that a large
    band is not one task; a link holds if the true similarity is at least 0.8. Heads are handed along
    the links until none changes.
    """

    @F.pandas_udf("array<bigint>")
    def bands(openings: pd.Series) -> pd.Series:
        return pd.Series([bands_of(o) for o in openings])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, left, right = None, [], []

        def links() -> list[tuple[str, str]]:
            return band_links(left + right, len(left) if right else 0) if len(left) + len(right) > 1 else []

        for pdf in batches:
            out = []
            for o, band, block, i, j in zip(pdf.opening, pdf.band, pdf.block, pdf.i, pdf.j):
                if (band, i, j) != at:
                    out += links()
                    at, left, right = (band, i, j), [], []
                (left if block == i else right).append(o)
            yield pd.DataFrame(out, columns=["opening", "head"])
        yield pd.DataFrame(links(), columns=["opening", "head"])

    keyed = materialize(openings.select("opening", F.explode(bands("opening")).alias("band")), "opening-bands")
    sizes = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    placed = keyed.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("opening"), F.col("blocks")).cast("int"))
    # block b meets each block: as (b, k) with those after it, as (k, b) with those before it
    met = placed.select("opening", "band", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    met = met.select("opening", "band", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # a task reads its groups one after the other; a group has at most two blocks
    links = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInPandas(compare, "opening string, head string").distinct()
    links = materialize(links, "opening-links")
    both = links.unionByName(links.select(F.col("head").alias("opening"), F.col("opening").alias("head"))).distinct()
    heads = both.select("opening").distinct().withColumn("head", F.col("opening"))
    while True:
        near = both.join(heads.select(F.col("opening").alias("to"), F.col("head").alias("offer")), F.col("head") == F.col("to")).select("opening", "offer")
        offers = near.groupBy("opening").agg(F.min("offer").alias("offer"))
        passed = heads.join(offers, "opening", "left").select("opening", F.least("head", "offer").alias("new"), "head")
        # the head's own head comes at once, so long chains take few rounds
        jump = heads.select(F.col("opening").alias("new"), F.col("head").alias("further"))
        heads = materialize(passed.join(jump, "new", "left").select("opening", F.least("new", "further").alias("head"), (F.least("new", "further") != F.col("head")).alias("changed")), "opening-heads")
        if heads.filter("changed").isEmpty():
            break
        heads = heads.drop("changed")
    return openings.select("opening").join(heads.select("opening", "head"), "opening", "left").withColumn("head", F.coalesce("head", "opening"))


def refusal_clusters(seen: DataFrame, member: DataFrame) -> DataFrame:
    """``opening``, ``recurs`` and ``template`` (whether a refusal template) of each opening.

    ``seen`` has one row per reply: ``opening``, ``prompt_hash``, ``related`` (share of the opening's
    words that the prompt has) and ``sign`` (whether it speaks for a refusal); ``member`` is from
    :func:`clusters_of`. A cluster recurs if it has ``MIN_PROMPTS`` different prompts. It is a template
    if these are on the whole unrelated to it, and at least half of its replies speak for a refusal.
    """
    told = seen.join(member, "opening")
    # a prompt counts once per cluster; counted without a distinct aggregate, so that it combines early
    prompts = told.groupBy("head", "prompt_hash").agg(F.count(F.lit(1)).alias("n"), F.sum("related").alias("related"), F.count_if("sign").alias("signs"))
    sums = prompts.groupBy("head").agg(F.count(F.lit(1)).alias("prompts"), F.sum("n").alias("n"), F.sum("related").alias("related"), F.sum("signs").alias("signs"))
    recurs = F.col("prompts") >= MIN_PROMPTS
    judged = sums.select("head", recurs.alias("recurs"), (recurs & (F.col("related") <= MAX_RELATED * F.col("n")) & (2 * F.col("signs") >= F.col("n"))).alias("template"))
    return member.join(judged, "head").select("opening", "recurs", "template")


def usual_closings(judged: DataFrame, refusing: DataFrame) -> DataFrame:
    """``sentence``: what follows refusals of the corpus, whether or not the lists have it.

    Such a sentence recurs over ``MIN_PROMPTS`` prompts, and at least half of the replies that hold
    it after their opening open with one of ``refusing`` (column ``opening``). ``judged`` has
    ``opening``, ``prompt_hash`` and ``rest`` (the sentences).
    """
    said = judged.select("opening", "prompt_hash", F.explode("rest").alias("sentence"))
    said = said.join(refusing.select("opening").distinct().withColumn("after", F.lit(1)), "opening", "left")
    counts = said.groupBy("sentence").agg(F.countDistinct("prompt_hash").alias("prompts"), F.count(F.lit(1)).alias("n"), F.sum("after").alias("after"))
    return counts.filter((F.col("prompts") >= MIN_PROMPTS) & (2 * F.col("after") >= F.col("n"))).select("sentence")


def opening_features(opening: str, sign: bool) -> list[int]:
    """Hashed words, neighbours and length of an opening, and whether its words decline."""
    w = [x for y in opening.split() for x in (y if "一" <= y[0] <= "鿿" else (y,))]
    raw = [f"w {x}" for x in set(w)] + [f"b {x} {y}" for x, y in zip(["^", *w], [*w, "$"])] + [f"n {min(len(w), 31).bit_length()}"]
    raw += [f"sign {i}" for i in range(SIGN)] * sign  # a sign counts as much as so many words
    return sorted({xxhash.xxh32_intdigest(f) % N_FEATURES for f in raw})


def fit_openings(features: list[list[int]], labels: np.ndarray, open_: np.ndarray, rounds: int = 3, epochs: int = 80, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression that tells refusing openings, by AdaGrad.

    ``labels`` is 1 for openings of templates and 0 for others; where ``open_`` is set the label is not
    known: these are left out at first and then take what the model of the round before says. Both
    labels weigh the same in all, whatever their numbers.
    """
    w = np.zeros(N_FEATURES)
    if not (labels[~open_] > 0.5).any():
        return w - 1.0  # no template, no refusal
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    col = np.concatenate([np.asarray(f, int) for f in features])
    labels, known = labels.astype(float), ~open_
    for _ in range(rounds):
        share = known * np.where(labels > 0.5, 0.5 / max(1, (known & (labels > 0.5)).sum()), 0.5 / max(1, (known & (labels <= 0.5)).sum()))
        w, g = np.zeros(N_FEATURES), np.full(N_FEATURES, 1e-6)
        for _ in range(epochs):
            z = np.bincount(row, weights=w[col], minlength=len(features))
            grad = np.bincount(col, weights=((1 / (1 + np.exp(-z)) - labels) * share)[row], minlength=N_FEATURES) + decay * w
            g += grad * grad
            w -= rate * grad / np.sqrt(g)
        z = np.bincount(row, weights=w[col], minlength=len(features))
        labels[open_] = z[open_] > 0
        known = ~open_ | (np.abs(z) > 1)
    return w


# ---- the operator


def response_pairs(rows: DataFrame) -> DataFrame:
    """``id``, ``prompt`` and ``reply`` of each user row and the assistant row next after it.

    Rows without session id or timestamp form no pair; system rows are left aside; a row of another
    role between the two parts them. Order is that of (timestamp, id) in a session. Sessions are cut
    into hours, so that one with a third of all rows is not one task.
    """
    spoken = rows.filter("session_id is not null and trim(session_id) != '' and timestamp is not null").select("session_id", "id", "timestamp", F.coalesce(role_of(F.col("role")), F.lit("other")).alias("role"), "content").filter("role != 'system'")
    # a prompt's text goes on to the next row, a reply's stays
    spoken = spoken.withColumn("said", F.when(F.col("role") == "user", F.col("content"))).withColumn("content", F.when(F.col("role") == "assistant", F.col("content")))
    follow = bucketed_previous(spoken, "session_id", ["timestamp", "id"], ["role", "said"], F.date_trunc("hour", "timestamp"))
    return follow.filter("role = 'assistant' and prev_role = 'user'").select("id", F.col("prev_said").alias("prompt"), F.col("content").alias("reply"))


JUDGED = "id string, defect string, opening string, prompt_hash bigint, related double, declines boolean, specific boolean, rest array<string>, listed array<boolean>"


def judge(prompt: str | None, reply: str | None) -> tuple:
    """What the pair alone tells: defect (refusals apart), and what its opening looks like."""
    prompt, reply = prompt or "", reply or ""
    if not _HAS_TEXT.search(reply):
        return ("empty", "", 0, 0.0, False, True, [], [])
    if _HAS_TEXT.search(prompt) and is_copy(prompt, reply):
        return ("copy", "", 0, 0.0, False, True, [], [])
    defect = "language" if other_language(prompt, reply) else "truncated" if is_truncated(reply) else None
    text = straight(reply)
    if _SPECIFIC.search(text):  # says something specific, so it is no refusal
        return (defect, "", 0, 0.0, False, True, [], [])
    first, *rest = [s for s in _SENTENCES.split(text) if s.strip()]
    opening = opening_of(first)
    known = set(_TOKENS.findall(prompt.lower()))
    words = [w for w in opening.split() if w != "#"]
    related = sum(w in known for w in words) / len(words) if words else 1.0
    return (defect, opening, xxhash.xxh64_intdigest(prompt) >> 1, related, declines(first), False, [opening_of(s) for s in rest], [gives_nothing_else([s]) for s in rest])


def find_refusals(judged: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """``row``, ``path`` (``template`` or ``model``) of the replies that give nothing but a refusal.

    Replies without a number, path or code name are looked at. Their openings are clustered; clusters
    that recur across unrelated prompts are templates of refusals if half of their replies show a sign
    of one: words that decline, or an end of nothing but what the corpus has behind such templates. The
    templates, against the other openings, train a classifier of openings, which decides on those that
    are too rare to recur; the phrases of ``_DECLINE`` are one of its features, and what weight they
    have is learned. A corpus without templates gives no refusals. The rest of a refusal consists of
    sentences that decline or close, by the lists or by the corpus.

    ``clusters`` (``opening``, ``head``) takes the place of :func:`clusters_of`. The classifier is fitted on at
    most ``TRAINING`` replies of each label, those with the least hash, and decides on all.
    """
    cand = judged.filter("opening != '' and not specific and not contains(opening, '#')").select("row", "opening", "prompt_hash", "related", F.col("declines").alias("sign"), "rest", "listed")
    member = materialize(clusters_of(cand.select("opening").distinct()), "opening-clusters") if clusters is None else clusters
    first = refusal_clusters(cand.select("opening", "prompt_hash", "related", "sign"), member)
    closings = materialize(usual_closings(cand, first.filter("template")), "closings")
    # per reply: whether all of the rest is usual by the corpus, and whether by corpus or lists
    each = cand.select("row", F.explode(F.arrays_zip("rest", "listed")).alias("s")).select("row", F.col("s.rest").alias("sentence"), F.col("s.listed").alias("listed"))
    each = each.join(closings.withColumn("usual", F.lit(True)), "sentence", "left").withColumn("usual", F.coalesce("usual", F.lit(False)))
    ends = each.groupBy("row").agg(F.bool_and("usual").alias("usual"), F.bool_and(F.col("usual") | F.col("listed")).alias("nothing"))
    ended = materialize(
        cand.drop("rest", "listed").join(ends, "row", "left").withColumn("usual", F.coalesce("usual", F.lit(False))).withColumn("nothing", F.coalesce("nothing", F.lit(True))), "endings"
    )
    final = refusal_clusters(ended.select("opening", "prompt_hash", "related", (F.col("sign") | F.col("usual")).alias("sign")), member)

    @F.pandas_udf("array<int>")
    def features(opening: pd.Series, sign: pd.Series) -> pd.Series:
        return pd.Series([opening_features(o, bool(x)) for o, x in zip(opening, sign)])

    told = materialize(ended.join(final, "opening").withColumn("features", features("opening", "sign")), "refusals-told")
    label = F.when(F.col("template"), 1).when(F.col("recurs") | ~F.col("sign"), 0).otherwise(2)
    # the least hashes of each label: a partial top-k per task
    parts = [told.withColumn("label", label).filter(F.col("label") == n).orderBy(F.xxhash64("opening", "prompt_hash"), "row").limit(TRAINING).select("features", "label") for n in (0, 1, 2)]
    sample = parts[0].unionAll(parts[1]).unionAll(parts[2]).collect()
    labels = np.array([r.label for r in sample], int)
    weights = judged.sparkSession.sparkContext.broadcast(fit_openings([r.features for r in sample], (labels == 1).astype(float), labels == 2).astype("f4"))

    @F.pandas_udf("double")
    def score(f: pd.Series) -> pd.Series:
        w = weights.value
        return pd.Series([float(w[np.asarray(x, int)].sum()) for x in f])

    told = told.filter("nothing and (template or not recurs)").withColumn("z", score("features")).filter("template or z > 0")
    return told.select("row", F.when(F.col("template"), "template").otherwise("model").alias("path"))


def judged_pairs(pairs: DataFrame) -> DataFrame:
    """What each pair alone tells (columns of ``JUDGED``), and a number for it (``row``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *judge(p, r)) for i, p, r in zip(pdf.id, pdf.prompt, pdf.reply)]
            yield pd.DataFrame(rows, columns=["id", "defect", "opening", "prompt_hash", "related", "declines", "specific", "rest", "listed"])

    return pairs.select("id", "prompt", "reply").mapInPandas(run, JUDGED).withColumn("row", F.monotonically_increasing_id())


def find_defects(pairs: DataFrame) -> DataFrame:
    """``id`` and ``defect`` of each broken pair (columns ``id``, ``prompt``, ``reply``).

    A null reply is empty; a null or blank prompt can neither be copied nor set a language. Texts are
    read whole. Repeated pairs are judged each. Each pair has at most one defect, looked for in the
    order empty, copy, refusal, language, truncated. Refusals are those of :func:`find_refusals`.
    """
    judged = materialize(judged_pairs(pairs), "pairs-judged")
    refusing = find_refusals(judged).select("row", F.lit("refusal").alias("refusal"))
    return judged.select("row", "id", "defect").join(refusing, "row", "left").select("id", F.coalesce("refusal", "defect").alias("defect")).filter("defect is not null")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id`` of the assistant row and ``defect`` of each broken pair in messages."""
    return find_defects(response_pairs(messages(spark, sf_dir, "session_id", "role", "content", "timestamp"))).distinct()
