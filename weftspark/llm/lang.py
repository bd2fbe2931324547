"""Language of a text from its scripts, then from its function words."""

from __future__ import annotations

import re

# fixed values: frequent function words that are rare in the other languages of the list
FUNCTION_WORDS = {
    "en": "the of and is are was were to in on at for with that this it by from as be not but which when how why what should after before must than over near into between does did has have its you i we too here each every then there these those only can will so".split(),
    "de": "der das und ist nicht ein eine einen einem zu auf mit für von den dem im wird werden wurde noch auch bei nach bei wie warum ich sie bitte zuerst bis oder sich aus über kann muss dieser weil".split(),
    "fr": "le la les des du et est une un dans pour que qui sur par pas ne se au aux avec cette ce il elle sont être plus ou où comment pourquoi je vous après avant doit faut car été de d l qu n en trop ici abord encore aussi très entre sans sous leur ces ses son mais donc quand quelle".split(),
    "es": "el la los las de del y es una un en para que con por se al lo su sus este esta está son como cómo qué quién pero más o donde tras hay debe después porque ya de en muy también sin sobre entre cada hasta desde cuando".split(),
}
_OF: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        _OF.setdefault(_w, []).append(_lang)
#: A word of several languages tells less than its share of one of them.
_WEIGHT = {w: 1.0 / len(langs) ** 2 for w, langs in _OF.items()}
# fixed values: letters of each script, and the language it is taken for where the script alone tells
_SCRIPT = {
    "latin": r"[A-Za-zÀ-ÖØ-öø-ɏ]", "kana": r"[぀-ヿ]", "han": r"[一-鿿]", "cyrillic": r"[Ѐ-ӿ]", "greek": r"[Ͱ-Ͽ]", "hangul": r"[가-힣]", "arabic": r"[؀-ۿ]", "hebrew": r"[֐-׿]", "thai": r"[฀-๿]", "devanagari": r"[ऀ-ॿ]",
}
_SPOKEN = {"kana": "ja", "han": "zh", "cyrillic": "ru", "greek": "el", "hangul": "ko", "arabic": "ar", "hebrew": "he", "thai": "th", "devanagari": "hi"}
_SCRIPT_RE = {k: re.compile(v) for k, v in _SCRIPT.items()}
_NOT_LATIN = re.compile("[^\x00-ɏ\u2000-\u206f]")
#: A script other than Latin decides from so many of its letters on, and from this share of all letters: prose in it quotes many Latin names.
LEAST_LETTERS, LEAST_SHARE = 8, 0.2
_WORD = re.compile(r"[^\W\d_]+")
_FENCED = re.compile(r"```.*?(?:```|\Z)|\"[^\"\n]{15,}\"|“[^”\n]{15,}”|«[^»\n]{15,}»", re.S)


def scripts(text: str) -> dict[str, int]:
    """How many letters of each script a text has."""
    if text.isascii():
        return {"latin": sum(map(str.isalpha, text))}
    return {k: n for k, r in _SCRIPT_RE.items() if (n := len(r.findall(text)))}


def by_script(text: str) -> str | None:
    """The language that the scripts alone show: Japanese where there is kana among Han, else that of the strongest script that isn't Latin."""
    if len(_NOT_LATIN.findall(text)) < LEAST_LETTERS:
        return None
    n = scripts(text)
    latin = n.pop("latin", 0)
    if n.get("kana"):
        n["kana"] += n.pop("han", 0)
    if not n:
        return None
    script = max(n, key=lambda k: (n[k], k))
    # a Chinese or Japanese letter is about a third of a word
    weight = n[script] * (2 if script in ("kana", "han", "hangul") else 1)
    return _SPOKEN[script] if n[script] >= LEAST_LETTERS and weight >= LEAST_SHARE * (latin + weight) else None


def detect(text: str | None, least: float = 2.0, lead: float = 1.2) -> str | None:
    """en, de, fr, es, or the language of another script; None for texts with too few signs. Fenced code and longer quotations don't count."""
    if not text:
        return None
    prose = _FENCED.sub(" ", text)
    if not prose.isascii() and (other := by_script(prose)):
        return other
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in _WORD.findall(prose.lower()):
        if w in _OF:
            for lang in _OF[w]:
                score[lang] += _WEIGHT[w]
    lang = max(score, key=score.__getitem__)
    rest = max(v for k, v in score.items() if k != lang)
    return lang if score[lang] >= least and score[lang] > lead * rest else None


# fixed values: written forms of language names
ALIASES = {
    "en": "en eng english anglais englisch inglés".split(), "de": "de deu ger german deutsch".split(), "fr": "fr fra fre french français francais".split(),
    "es": "es spa spanish español espanol castellano".split(), "ja": "ja jpn jp japanese 日本語".split(),
}
_ALIAS = {a: k for k, v in ALIASES.items() for a in v}


def normalise(tag: str | None) -> str | None:
    """en for en-US, EN_gb, English ...; None for null, blank and unknown."""
    if not tag:
        return None
    t = tag.strip().lower()
    return _ALIAS.get(t) or _ALIAS.get(re.split(r"[-_ ]", t)[0])
