"""Language of a sentence, by script and function words; a small helper for single texts."""

from __future__ import annotations

import re

#: Frequent function words that tell the languages apart.
WORDS = {
    "en": "the of and is to in that it was for on are with as this be at have from or by not but what when which if we you will can does has been how why after before because into than then there their them only both still each our please should would could where who an a even inside so its my your more most all any under over again while during between our must may just like same other first until without too some such no did had were up out off now".split(),
    "fr": "le la les des une dans est pour pas que cette nous avant après il faut du et sur qui avec ne plus ce ces sont au aux quand pourquoi comment être a ont vous je se par mais ou où toutes tous son sa ses leur aussi fait peux dernières puis renvoie entre quelle vers été".split(),
    "de": "der die das und nicht ist wird werden wir ein eine einen einer haben nach auf den bitte dem des mit für von zu sich auch wenn wie warum was kann man dass damit bevor dann alle im am es ich sie oder aber aus bei zwischen muss keine wurde sind ob dieses diesem diese noch".split(),
    "es": "el los las una que se por para está hay hemos antes del con de en y no un su al lo a como más pero cuando después también qué cuál cómo puedo puedes entre hace esto este esta son fue porque cada debe sin sobre ya son sus le me mi vivo".split(),
    "it": "il lo gli della che non per una sono di e è con nel alla dei questo come più anche quando perché".split(),
    "pt": "o os das uma que não para com em do da no na por mais como quando são foi também está você".split(),
}
_OF: dict[str, list[str]] = {}
for _lang, _words in WORDS.items():
    for _w in set(_words):
        _OF.setdefault(_w, []).append(_lang)

_SCRIPTS = [(re.compile(r"[぀-ヿ]"), "ja"), (re.compile(r"[가-힯]"), "ko"), (re.compile(r"[一-鿿]"), "zh"), (re.compile(r"[Ѐ-ӿ]"), "ru"), (re.compile(r"[؀-ۿ]"), "ar"), (re.compile(r"[֐-׿]"), "he"), (re.compile(r"[ऀ-ॿ]"), "hi"), (re.compile(r"[Ͱ-Ͽ]"), "el")]
_FOREIGN = re.compile(r"[^\x00-\x7fÀ-ɏ‐-⁯€-₿]")
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|https?://\S+|\S*[/_\\]\S*|\S+@\S+", re.S)
_WORD = re.compile(r"[a-zà-öø-ÿœß]+(?:['’](?=[a-zà-ÿ]))?")
_MARKS = {"es": re.compile(r"[ñ¿¡íóú]|ción"), "de": re.compile(r"[ßäöü]"), "fr": re.compile(r"[èêçœùàâîôû]|\b[ldnmsjcq]['’][a-zéèê]")}
SENTENCE = re.compile(r"(?<=[.!?;])\s+|(?<=[。！？])|\n+")


def of_sentence(s: str) -> str | None:
    """The language of a sentence, or None where too little speaks for one. Code is left aside."""
    if _FOREIGN.search(s):
        for pattern, lang in _SCRIPTS:
            n = len(pattern.findall(s))
            if n >= 2 and n * 4 >= len(_WORD.findall(s.lower())):
                return lang
    score: dict[str, float] = {}
    words = _WORD.findall(s.lower())
    for w in words:
        for lang in _OF.get(w, ()):
            score[lang] = score.get(lang, 0) + 1.0 / len(_OF[w])
    if not s.isascii():
        low = s.lower()
        for lang, pattern in _MARKS.items():
            if pattern.search(low):
                score[lang] = score.get(lang, 0) + 1.5
    if not score:
        return None
    (lang, best), *rest = sorted(score.items(), key=lambda x: -x[1])
    return lang if best >= 1.5 and best >= 1.3 * (rest[0][1] if rest else 0) or best >= 1 and len(words) <= 4 and not rest else None


def _plain(text: str) -> tuple[str | None, float]:
    """The language that most function words of a text in Latin script speak for, and how clearly (0 to 1)."""
    score: dict[str, float] = {}
    for w in _WORD.findall(text.lower()):
        found = _OF.get(w)
        if found is not None:
            weight = 1.0 / len(found)
            for lang in found:
                score[lang] = score.get(lang, 0.0) + weight
    if not score:
        return None, 0.0
    best = max(score, key=score.get)
    return (best, score[best] / sum(score.values())) if score[best] >= 3 else (None, 0.0)


def same(a: str, b: str) -> bool:
    """Whether two texts are plainly in one language; false leaves it open. Cheaper than :func:`languages`."""
    if _FOREIGN.search(a) or _FOREIGN.search(b):
        return False
    x, p = _plain(a)
    if x is None or p < 0.7:
        return False
    y, q = _plain(b)
    return x == y and q >= 0.7


def languages(text: str) -> dict[str, int]:
    """Characters of a text's sentences by language; sentences of unknown language are left out."""
    out: dict[str, int] = {}
    for s in SENTENCE.split(_CODE.sub(" ", text)):
        if s and (lang := of_sentence(s)):
            out[lang] = out.get(lang, 0) + len(s) * (3 if lang in ("zh", "ja", "ko") else 1)
    return out
