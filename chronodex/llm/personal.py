"""Problem 5: personal information in free text, found by weak supervision.

A permissive matcher proposes spans. Three labelers vote on each: the strict format, a gazetteer,
and the words around it. Expectation-maximisation over the counts of vote patterns (gathered from
all spans of the corpus) estimates how far each labeler can be trusted, per kind of span. The
resulting probabilities are the soft labels on which the final span classifier, a logistic
regression over span and context features, is trained; it decides on every span.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..tables import latest, table
from . import lang

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

#: Size of the classifier's hashed feature space, and the most spans it is trained on (per kind).
N_FEATURES = 1 << 13
TRAINING_SPANS = 1000
#: What is assumed of the labelers before any span is seen weighs as much as so many spans.
PRIOR_SPANS = 20.0

#: Common given names.
GIVEN = set(
    "Aaron Adam Adrian Agnes Ahmed Alan Albert Alex Alexander Ali Alice Amadou Amina Ana Andrea Andrew Angela Anna Anne Anouk Antonio Arthur Aylin Barbara Beatrice Ben Bernard Boris Brian Bronwen "
    "Callum Camille Carla Carlos Carmen Caroline Catherine Charlotte Chloe Christian Claire Clara Claudia Daniel Darius David Diana Diego Dmitri Edward Elena Elif Elisa Elizabeth Emil Emily Emma Eric Eva "
    "Fatima Felix Fiona Francesca Frank Gabriel George Giulia Gustav Hana Hannah Hans Helen Henrik Hugo Ines Ingrid Irene Isabel Ivan Ivo Jack Jakob James Jana Jean Jessica Joan Johan John Jonas Jorge Joris Jose Joseph "
    "Juan Julia Karen Karim Karin Karl Katarina Kenji Kevin Klaus Lars Laura Lea Leif Lena Leo Linda Lucas Lucia Luis Lukas Magda Marc Marco Maren Maria Marie Mario Marta Martin Mary Mateo Matthias Max Mehmet Michael Miguel Milan Mohamed Monika "
    "Nadia Natalia Nicolas Nina Noah Noemi Nora Odette Olga Oliver Omar Oscar Pablo Patricia Paul Paula Pedro Peter Petra Philip Pierre Priya Quentin Rahel Ravi Rebecca Robert Rosa Salma Samuel Sandra Sarah Sofia Stefan Susan Sven Tamara Thomas Tobias Ulrich Vera Viktor Wendy Xenia Yasmin Yuki Zoltan".split()
)
#: Capitalised words that make a pair something other than a person.
NOT_SURNAME = set(
    "Case Studio Templates Template Queue Period Loop Falls Hollow Mill Street Road Lane Avenue Drive Court Way Boulevard Blvd Ave Square Place Platz Box Server Service Error Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "January February March April May June July August September October November December Code Script Hub Lab Labs University Team Bot Test Data Cache Index Table Key Keys File Files Request Code Mode Guide Notes Plan Release Branch Store".split()
)
ROLE_MAILBOX = {"git", "noreply", "no-reply", "donotreply", "support", "info", "admin", "root", "postmaster", "webmaster", "mailer-daemon", "security", "abuse", "hello", "contact", "sales", "team", "bot", "notifications", "ci", "build", "hostmaster"}

_CAP = r"[A-ZÀ-ÖØ-Þ](?:['’][A-ZÀ-ÖØ-Þ])?[a-zà-öø-ÿ]+(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+)?"
_SURNAME = rf"{_CAP}(?:-{_CAP})?"
_TITLES = {"Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Professor", "Herr", "Frau", "Mme", "Mlle", "Sr", "Sra", "Don", "Doña", "Ing"}
#: Words that no name consists of: function words of several languages.
_FUNCTION_WORDS = {w for ws in lang.WORDS.values() for w in ws if len(w) > 2} | {"der", "die", "das", "mein", "meine", "dein", "diese", "dieser", "alte", "neue", "mon", "mi", "el", "la", "le", "use", "see", "step", "run"}
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Herr|Frau|Mme|Mlle|Sr|Sra|Don|Doña|Ing)\.?\s+)"
_NAME = re.compile(rf"(?=(?<![\w@./\-])(?P<title>{_TITLE})?(?:(?P<given>{_CAP})(?: [A-Z]\.)*[ \t]+(?P<sur>{_SURNAME})|(?P<sur2>{_SURNAME}),[ \t]+(?P<given2>{_CAP})(?: [A-Z]\.)*)(?![\w@]))")
_TITLE_BEFORE = re.compile(rf"{_TITLE}$")
_SENTENCE_BEFORE = re.compile(r"(?:[.!?\n]|[-*#>])\s*$")
_INITIALS = re.compile(r"(?: [A-Z]\.(?!\w))*")

_TLD = r"[A-Za-z]{2,12}"
_EMAIL = [
    re.compile(rf"(?<![\w.+\-])(?P<local>[\w][\w.+\-]*)(?:@|%40)(?P<domain>[A-Za-z0-9](?:[A-Za-z0-9\-]*\.)+{_TLD})(?![\w\-]|\.\w)"),
    re.compile(rf"(?i)(?<![\w.+\-])(?P<local>[\w][\w.+\-]*)\s*(?:\[\s*at\s*\]|\(\s*at\s*\)|\{{\s*at\s*\}}|<\s*at\s*>)\s*(?P<domain>[A-Za-z0-9\-]+(?:\s*(?:\.|\[\s*dot\s*\]|\(\s*dot\s*\)|\{{\s*dot\s*\}})\s*[A-Za-z0-9\-]+)+)(?![\w\-])"),
    re.compile(rf"(?i)(?<![\w.+\-])(?P<local>[\w][\w.+\-]*(?: dot [\w+\-]+)*) at (?P<domain>[A-Za-z0-9\-]+(?:(?: dot |\.)[A-Za-z0-9\-]+)*(?: dot |\.){_TLD})(?![\w\-])"),
]
_PHONE = re.compile(
    r"(?<![\w.#/\-:+])(?:tel:)?(?:"
    r"\+\d{1,3}[ .\-]?(?:\(0?\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-/]?\d{2,4}){1,5}|\+\d{9,14}"
    r"|(?:1[ .\-])?\(\d{3}\) ?\d{3}[\-. ]\d{4}|(?:1[ .\-])?\d{3}[\-.]\d{3}[\-.]\d{4}|1-\d{3}-\d{3}-\d{4}"
    r"|0\d(?:[ .]\d\d){4}|\(?0\d{1,5}\)?[ /]\d{3,8}(?:[ \-]\d{2,5}){0,2}"
    r")(?![\w]|[\-.:/]\d)"
)
_PHONE_STRICT = re.compile(r"(?:tel:)?(?:\+\d[\d .\-()/]{7,}|(?:1[ .\-])?\(?\d{3}\)?[\-. ]{1,2}\d{3}[\-.]\d{4}|0\d(?:[ .]\d\d){4}|\(?0\d{2,5}\)?[ /]\d{3,}[\d \-]*)$")

_ID_CUE = (
    r"(?:social\s+security(?:\s+(?:number|no\.?|nr\.?|#))?|ssn|itin|tax(?:payer)?[\s-]?(?:id|number|no\.?)(?:\s+number)?|steuer-?id(?:entifikationsnummer|nr\.?)?|steuernummer|num[eé]ro\s+de\s+s[eé]curit[eé]\s+sociale|nir|n[°º]\s*s[eé]cu"
    r"|nino|national\s+insurance(?:\s+(?:number|no\.?))?|nie|dni|nif|cif|personalausweis(?:nummer)?|ausweis(?:nummer|nr\.?)?|carte\s+d['’]identit[eé]|identity\s+card(?:\s+(?:number|no\.?))?|id\s+card(?:\s+(?:number|no\.?))?|national\s+id(?:\s+(?:number|no\.?|card))?"
    r"|passport(?:\s+(?:number|no\.?|nr\.?|#))?|reisepass(?:nummer)?|passeport(?:\s+n[°º])?|pasaporte|driv(?:er'?s?|er’s|ing)\s+licen[cs]e(?:\s+(?:number|no\.?))?|f[uü]hrerschein(?:nummer)?|permis\s+de\s+conduire|curp|aadhaar|身份证号?码?)"
)
_ID_VALUE = r"[A-Z0-9]{1,4}(?:[ \-]?[A-Z0-9]{1,5}){1,8}"
_ID = re.compile(rf"(?<![\w\-])(?P<cue>{_ID_CUE})[\s:=#.\"'(]{{1,4}}(?:is\s+|ist\s+|est\s+|es\s+)?(?P<value>(?-i:{_ID_VALUE}))(?![\w])", re.I)
_ID_BARE = re.compile(r"(?<![\w\-./])(?P<value>\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-HJ-NP-TV-Z]|[12] \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?)(?![\w\-])")
_ID_SHAPE = re.compile(
    r"\d{3}[\- ]?\d{2}[\- ]?\d{4}|\d{2} ?\d{3} ?\d{3} ?\d{3}|[12] ?\d\d ?\d\d ?\d[\dAB] ?\d{3} ?\d{3}(?: ?\d\d)?|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|[A-Z0-9]{9,10}|[A-Z]{0,2}\d{6,9}|[A-Z]\d{3}-\d{4}-\d{4}|\d{4} ?\d{4} ?\d{4}|[A-Z]\d{7,14}|\d{17}[\dX]|[A-Z]{5}\d{6}[A-Z0-9]{5}"
)

_TOWN = rf"(?:(?:St\.?|Saint|Sant|San|Santa|Bad|Los|Las|Le|La|New|Old|North|South|East|West) )?{_CAP}(?:[ \-](?:(?:am|an der|sur|de|la|del|les|upon|on|of) )?{_CAP}){{0,2}}"
_STREET_EN = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Court|Ct|Way|Boulevard|Blvd|Place|Pl|Square|Sq|Terrace|Close|Crescent|Row|Walk|Hill|Gardens|Grove|Parkway|Pkwy|Highway|Hwy)\b\.?"
_UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\.? ?#?\w{1,5}, ?)?"
_GLUE = r"(?:, ?\n?[ \t]*|[ \t]*\n[ \t]*)"
_ZIP = r"(?:[A-Z]{1,2}-)?\d{4,5}"
_ADDRESS = re.compile(
    rf"(?<![\w\-/.])(?:"
    rf"{_UNIT}\d{{1,5}}[a-z]? (?:{_CAP} ){{1,4}}{_STREET_EN}(?:, ?(?:Apt|Flat|Unit|Suite|Apartment)\.? ?#?\w{{1,5}})?"
    rf"|\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|all[eé]e|impasse|quai|route|cours|square) (?:(?:de|du|des|la|le|les|l'|d'|l’|d’) ?)*[A-ZÀ-Þ][\w'’\-]+(?: (?:de |du |des |la )?[A-ZÀ-Þ][\w'’\-]+){{0,3}}"
    rf"|(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrer|Ronda|Travesía) ?(?:(?:de|del|la|las|los|el) )*[A-ZÀ-Þ][\w'’\-]+(?: (?:de |del |la )?[A-ZÀ-Þ][\w'’\-]+){{0,3}},? \d{{1,4}}(?:, ?\d+[ºª]? ?\w?)?"
    rf"|(?:(?:Alte|Neue|Am|An|Auf|Zum|Zur|Im|Große|Kleine)(?: der| dem)? )?[A-ZÄÖÜ][a-zäöüß\-]*(?:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee|ring|damm|ufer|hof|berg|markt|steig) \d{{1,4}} ?[a-z]?"
    rf"|(?:P\. ?O\. ?Box|PO Box|P\.O\.Box|Postfach|Apartado(?: de Correos)?|B\.?P\.?|Boîte postale) ?\d{{1,6}}"
    rf"){_GLUE}(?P<town>(?:{_ZIP} )?{_TOWN}(?:,? (?:[A-Z]{{2}} )?{_ZIP})?)"
)

#: Words before a span that speak for its kind, and others that speak against it.
CUES = {
    "email": (r"mail|contact|reach|write|answer|escr[ií]|écri|cc\b|moved to|owner|responsable|stakeholder|author|signed|user|<$|correo|emergency|to=|\|\s*$|,\s*$", r"(?:ssh|scp|sftp|git|clone|rsync|@)\s*\S*$|://\S*$"),
    "phone": (r"call|phone|tel|fax|mobile|whatsapp|text|number is|ring|erreichbar|unter|on-call|contact|escalation|emergency|anruf|appel|llam|\(\s*$|;\s*$|,\s*$|\|\s*$|\n\s*$", r"(?:rows?|lines?|ticket|issue|build|version|release|error|code|port|epoch|commit|id|batch|limit|checksum|address)\s*#?$"),
    "id_number": (_ID_CUE, r"(?:ticket|issue|build|version|release|error|code|epoch|rows?|commit|checksum)\s*#?$"),
    "address": (r"lives? at|home at|live in|vivo en|wohn|habite|address|deliver|ship|send|meet|goes to|place|invoice|says|\n\s*$|,\s*$", r"(?:step|run at|chapter|section|figure)\s*$"),
    "name": (r"(?:author|by|from|owner|signed-off-by|regards,?|sincerely,?|cheers,?|maintainer|reviewer was|my name is|name ist|je m'appelle|me llamo|soy|ich bin|i am|ask|contact[\w ]*|says|to|belongs to|according to|while|with|user|values \(|parse\(|responsable|verantwortlich|stakeholder|interview notes|on-call this week|draft by|approved by|account belongs to|filled in by|sent by|deliver to)\s*[:,('\"]*\s*$|[|>;]\s*$", r"(?:the|a|an|in|use|see|and in|step|of|for)\s+$"),
}
_CUES = {k: (re.compile(a, re.I), re.compile(b, re.I)) for k, (a, b) in CUES.items()}

#: What a text must have to be looked at.
MAYBE = re.compile(rf"@|%40|\d[\d .\-/()]{{5,}}\d|(?i:\bat\b[\])]?.{{1,60}}(?:\bdot\b|\.\w))|{_CAP}(?: [A-Z]\.)?,? {_CAP}|[A-Z0-9]{{8}}|Box|\d {_CAP}")

Span = tuple[str, int, int, int, int, int, list[int]]  # kind, begin, end, three votes, features


def _features(kind: str, text: str, b: int, e: int) -> list[int]:
    """Hashed features of a span and of the words around it; the votes are no part of them."""
    span = text[b:e]
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"[a-zà-ÿ]", "a", re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"\d", "9", span))))
    before = re.findall(r"\w+|[^\w\s]|\n", text[max(0, b - 40) : b])[-3:]
    after = re.findall(r"\w+|[^\w\s]|\n", text[e : e + 30])[:2]
    raw = ["bias", "shape=" + shape[:24]] + [f"b{len(before) - i}={w.lower()}" for i, w in enumerate(before)] + [f"a{i}={w.lower()}" for i, w in enumerate(after)]
    if kind == "name":
        raw += [f"w={w}" for w in re.findall(r"\w+", span)]
    return [xxhash.xxh32_intdigest(f"{kind}|{f}") % N_FEATURES for f in raw]


def vote_features(kind: str, votes: tuple[int, int, int], without: int = -1) -> list[int]:
    """Hashed features of the votes, but of the labeler ``without``."""
    raw = [f"v{i}={v}" for i, v in enumerate(votes) if i != without]
    if without < 0:
        raw.append("v=" + "".join(map(str, votes)))
    return [xxhash.xxh32_intdigest(f"{kind}|{f}") % N_FEATURES for f in raw]


def _vote_context(kind: str, text: str, b: int) -> int:
    before = text[max(0, b - 60) : b]
    good, bad = _CUES[kind]
    near = before.rsplit("\n\n", 1)[-1]
    return -1 if bad.search(near) else 1 if good.search(near[-45:]) else 0


def candidates(text: str | None) -> list[Span]:
    """Spans that may be personal information, with the labelers' votes (1, -1 or 0) and features.

    Spans don't overlap: addresses, identity numbers and mail addresses go before phone numbers and
    names. A null or empty text has none.
    """
    if not text or not MAYBE.search(text):
        return []
    out: list[Span] = []
    taken: list[tuple[int, int]] = []

    def add(kind: str, b: int, e: int, form: int, known: int) -> None:
        if any(b < y and x < e for x, y in taken):
            return
        taken.append((b, e))
        votes = (form, known, _vote_context(kind, text, b))
        out.append((kind, b, e, *votes, _features(kind, text, b, e)))

    for m in _ADDRESS.finditer(text):
        town = m["town"]
        add("address", m.start(), m.end(), 1 if re.search(r"\d", m.group()[: -len(town)]) else -1, -1 if town.split()[0] in NOT_SURNAME else 1)
    for n, pattern in enumerate(_EMAIL):
        if n == 1 and not re.search(r"(?i)[\[({<]\s*at", text) or n == 2 and " at " not in text.lower():
            continue
        for m in pattern.finditer(text):
            b, e = m.span()
            local, domain = m["local"].lower(), m["domain"].lower()
            after, before = text[e : e + 2], text[max(0, b - 40) : b]
            login = bool(re.match(r":[\w/~]", after)) and not after[1:2].isspace() or re.search(r"://\S*$", before) is not None and not re.search(r"[?&=][^/\s]*$|mailto:$", before)
            spelled = n == 2 and not re.search(r" dot | at [\w\-]+\.[\w.\-]*\w", m.group())
            version = re.fullmatch(r"v?\d[\d.]*\w*", domain) is not None
            add("email", b, e, -1 if version or spelled else 1, -1 if login or local in ROLE_MAILBOX else 1)
    for m in _ID.finditer(text):
        b, e = m.span("value")
        value = m["value"].rstrip(" -")
        while value and not _ID_SHAPE.fullmatch(value) and re.search(r"[ \-][^ \-]*$", value):
            value = re.sub(r"[ \-][^ \-]*$", "", value)
        if sum(c.isdigit() for c in value) >= 3:
            add("id_number", b, b + len(value), 1 if _ID_SHAPE.fullmatch(value) else -1, 1)
    for m in _ID_BARE.finditer(text):
        add("id_number", *m.span("value"), 1, 0)
    for m in _PHONE.finditer(text):
        digits = re.sub(r"\D", "", m.group())
        if 8 <= len(digits) <= 15:
            date = re.match(r"(?:19|20)\d\d[\-. ]\d\d?[\-. ]\d\d?\b", m.group()) is not None
            add("phone", m.start(), m.end(), -1 if date else 1 if _PHONE_STRICT.fullmatch(m.group()) else 0, 1 if re.match(r"tel:|\+|\(|0|1[ .\-]", m.group()) else 0)
    names = []
    for m in _NAME.finditer(text):
        turned = not m["given"]
        given, sur = (m["given2"], m["sur2"]) if turned else (m["given"], m["sur"])
        b = m.start("title") if m["title"] else m.start("sur2" if turned else "given")
        e = _INITIALS.match(text, m.end("given2")).end() if turned else m.end("sur")
        if given.rstrip(".") in _TITLES or text[e : e + 1] == "@":
            continue  # a title and one word
        initials = "." in text[b:e].replace(m["title"] or "", "")
        known = gazetteer(given, sur)
        if turned and known <= 0 and not m["title"]:
            continue  # two words of an enumeration
        inside = b > 0 and not _SENTENCE_BEFORE.search(text[max(0, b - 3) : b])
        names.append((known, bool(m["title"]) or initials, inside, not turned, -b, e, bool(m["title"])))
    # overlapping pairs ("Ask Laura Martin"): what the gazetteer, a title or initials speak for, then not the one that begins a sentence
    for known, _, _, direct, minus, e, titled in sorted(names, reverse=True):
        b = -minus
        if not titled and (t := _TITLE_BEFORE.search(text[max(0, b - 12) : b])):
            b, titled = b - len(t.group()), True
        add("name", b, e, 1 if titled or not direct or "." in text[b:e] else 0, known)
    return out


def gazetteer(given: str, sur: str) -> int:
    """Whether lists know a pair of words as a person's: 1, as something else: -1, or not at all: 0."""
    parts = {given, sur, *re.split("-", sur)}
    if parts & NOT_SURNAME or given.lower() in _FUNCTION_WORDS or sur.lower() in _FUNCTION_WORDS:
        return -1
    return 1 if given in GIVEN else 0


def propose(texts: DataFrame, version: str | None = None) -> DataFrame:
    """All candidate spans of ``texts`` (source, id, content), which are read whole.

    With ``version`` of each (source, id) only the row with the greatest value of that column counts.
    It is picked after the texts have been read, so spans and not texts are shuffled.
    """

    @F.pandas_udf("array<struct<kind: string, begin: int, end: int, v1: int, v2: int, v3: int, features: array<int>>>")
    def spans_of(content: pd.Series) -> pd.Series:
        names = ("kind", "begin", "end", "v1", "v2", "v3", "features")
        return pd.Series([[dict(zip(names, c)) for c in candidates(t)] for t in content], dtype=object)

    rows = texts.select("source", "id", *([version] if version else []), spans_of("content").alias("spans"), F.xxhash64("content").alias("_text"))
    if version:
        rows = latest(rows, ["source", "id"], version, tie=["_text"])
    return rows.select("source", "id", F.explode("spans").alias("s")).select("source", "id", "s.*")


def reliabilities(patterns: list[tuple[str, int, int, int, int]], rounds: int = 50) -> dict[tuple[str, int, int, int], float]:
    """Probability that a span is personal information, for each (kind, votes), by EM.

    A naive Bayes mixture of two classes per kind over three votes with values -1, 0 and 1; starts from
    the labelers being right in most cases and keeps a small prior on each table, so that kinds of
    which there are few spans stay near the labelers' majority.
    """
    out = {}
    for kind in {p[0] for p in patterns}:
        rows = [p for p in patterns if p[0] == kind]
        v = np.array([p[1:4] for p in rows]) + 1
        n = np.array([p[4] for p in rows], float)
        # vote tables of the two classes: form, gazetteer (which names the thing itself), context
        start = np.array([[[0.5, 0.3, 0.2], [0.05, 0.35, 0.6]], [[0.8, 0.15, 0.05], [0.02, 0.18, 0.8]], [[0.4, 0.35, 0.25], [0.1, 0.3, 0.6]]])
        table = start.copy()
        prior = 0.5
        for _ in range(rounds):
            like = np.stack([np.prod([table[j][c][v[:, j]] for j in range(3)], axis=0) for c in (0, 1)])
            joint = like * np.array([[1 - prior], [prior]])
            p = joint[1] / joint.sum(0)
            prior = float(np.clip((n * p).sum() / n.sum(), 0.02, 0.98))
            for j in range(3):
                for c, w in ((0, n * (1 - p)), (1, n * p)):
                    counts = np.bincount(v[:, j], weights=w, minlength=3)
                    strength = PRIOR_SPANS
                    table[j][c] = (counts + strength * start[j][c]) / (counts.sum() + strength)
        out.update({(kind, *p_[1:4]): float(x) for p_, x in zip(rows, p)})
    return out


def train(features: list[list[int]], labels: np.ndarray, epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels with sparse binary features, by AdaGrad."""
    w, g = np.zeros(N_FEATURES), np.full(N_FEATURES, 1e-6)
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    col = np.concatenate([np.asarray(f, int) for f in features]) if features else np.zeros(0, int)
    for _ in range(epochs):
        z = np.bincount(row, weights=w[col], minlength=len(features))
        d = 1 / (1 + np.exp(-z)) - labels
        grad = np.bincount(col, weights=d[row], minlength=N_FEATURES) / max(1, len(features)) + decay * w
        g += grad * grad
        w -= rate * grad / np.sqrt(g)
    return w


def detect(texts: DataFrame, version: str | None = None) -> DataFrame:
    """Spans of personal information: source, id, kind, begin, end (code points, end excluded).

    ``texts`` has source, id and content; ``version`` as in :func:`propose`. Votes are counted over all
    spans. The classifier is fitted on at most ``TRAINING_SPANS`` spans of each kind, those with the
    least hash of their place, and then decides on every span. What goes to the driver is bounded: one
    row per vote pattern, and the training spans; what is broadcast is one weight vector. Null and
    empty texts have no spans; repeated rows are found each; an empty input gives an empty result.
    """
    spans = materialize(propose(texts, version), "pii-spans")
    votes = [tuple(r) for r in spans.groupBy("kind", "v1", "v2", "v3").count().collect()]
    trusted = reliabilities(votes)
    few = Window.partitionBy("kind").orderBy(F.xxhash64("source", "id", "begin"), "source", "id", "begin")
    sample = spans.withColumn("place", F.row_number().over(few)).filter(F.col("place") <= TRAINING_SPANS)
    features, labels = [], []
    for r in sample.select("kind", "v1", "v2", "v3", "features").collect():
        votes = (r.v1, r.v2, r.v3)
        # twice with all votes and once without the gazetteer's, so that words and shapes must speak for themselves
        for without in (-1, -1, 1):
            features.append([*r.features, *vote_features(r.kind, votes, without)])
            labels.append(trusted[(r.kind, *votes)])
    weights = spans.sparkSession.sparkContext.broadcast(train(features, np.array(labels)).astype("f4"))

    @F.pandas_udf("double")
    def score(kind: pd.Series, v1: pd.Series, v2: pd.Series, v3: pd.Series, f: pd.Series) -> pd.Series:
        w = weights.value
        return pd.Series([float(w[np.asarray([*x, *vote_features(k, (a, b, c))], int)].sum()) for k, a, b, c, x in zip(kind, v1, v2, v3, f)])

    return spans.filter(score("kind", "v1", "v2", "v3", "features") > 0).select("source", "id", "kind", "begin", "end")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, id, content and version of all stored messages and plans."""
    said = table(spark, sf_dir, "messages").select(F.lit("messages").alias("source"), "id", "content", F.col("ingested_at").alias("version"))
    planned = table(spark, sf_dir, "plans").select(F.lit("plans").alias("source"), "id", "content", F.col("modified_at").alias("version"))
    return said.unionByName(planned)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, id and content of the messages and plans that count."""
    rows = latest(versions(spark, sf_dir).withColumn("_text", F.xxhash64("content")), ["source", "id"], "version", tie=["_text"])
    return rows.select("source", "id", "content")


def redact(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``texts`` with each span replaced by the placeholder of its kind; other texts stay as they are."""

    @F.pandas_udf("string")
    def hide(content: pd.Series, found: pd.Series) -> pd.Series:
        def one(t, spans):
            if t is None or spans is None:
                return t
            for s in sorted(spans, key=lambda s: -s["begin"]):
                t = t[: s["begin"]] + PLACEHOLDER[s["kind"]] + t[s["end"] :]
            return t

        return pd.Series([one(t, s) for t, s in zip(content, found)], dtype=object)

    per_text = spans.groupBy("source", "id").agg(F.collect_list(F.struct("kind", "begin", "end")).alias("found"))
    joined = texts.join(per_text, ["source", "id"], "left")
    return joined.withColumn("content", hide("content", "found")).drop("found")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source``, ``id`` and ``kind`` of the personal information in messages and plans."""
    return detect(versions(spark, sf_dir), "version").select("source", "id", "kind").distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages and plans, with typed placeholders for personal information."""
    source = materialize(texts(spark, sf_dir), "pii-texts")
    return redact(source, detect(source))
