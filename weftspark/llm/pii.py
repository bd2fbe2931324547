"""Personal information in free text: found, and replaced by typed placeholders or keyed surrogates."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.util import cut, maybe_broadcast, spread

KINDS = ("email", "phone", "id_number", "address", "name")
#: A family name stands next to a listed given name in so many documents at least, a new given name next to so many family names.
MIN_FAMILY, MIN_GIVEN = 2, 2
#: A lexicon of at most so many names is broadcast; a larger one is joined to the words of each text.
MAX_NAMES = 500_000

_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+'-]*[A-Za-z0-9_+-])?"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}[@＠](?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{{2,}}(?![A-Za-z0-9@])")
_HIDDEN = re.compile(
    rf"(?<![A-Za-z0-9._%+-]){_LOCAL}(?:(?:[ ]+dot[ ]+|[ ]*[\[({{][ ]*dot[ ]*[\])}}][ ]*){_LOCAL})*(?:\s*[\[({{<]\s*(?:at|@)\s*[\])}}>]\s*|\s+at\s+(?=[A-Za-z0-9-]+(?:\s+dot\s+|\s*[\[(]\s*dot\s*[\])]\s*)[A-Za-z]))[A-Za-z0-9-]+(?:(?:\.|\s*[\[({{]\s*dot\s*[\])}}]\s*|\s+dot\s+)[A-Za-z0-9-]+)+(?![A-Za-z0-9-])(?!\s+dot\s+)(?!\s+at\s+[A-Za-z0-9-]+\s+dot\s)",
    re.I,
)
_MAY_HIDE = re.compile(r"[\[({<]\s*(?:at|@)\s*[\])}>]|\bdot\b", re.I)
_AT_SIGN = re.compile(r"[\[({<]\s*(?:[aA][tT]|@)\s*[\])}>]")

_ID = re.compile(r"(?<![\w.+-])(?:\d{3}([- ])\d{2}\1\d{4}|\d{2} \d{3} \d{3} \d{3}|[A-Z]\d{8}|\d{8}-?[A-Z]|\d{9})(?![\w-])(?!\.\d)")
_ID_WORD = re.compile(
    r"(?:\b(?:ssn|id|passport|pass(?:nummer)?|identity|identité|identidad|documento|document|dni|nif|nie|tin|tax|fiscal|ausweis\w*|steuer\w*|kennziffer|national|nationale?|personal|social|sécurité|seguridad|doc|holder|nummer|numéro|número)\b|番号)[^\n.!?]{0,24}$",
    re.I,
)
_NOT_ID = re.compile(r"\b(?:seed|ticket|lot|build|node|row|lane|marker|line|commit|address|run|job|case|issue|bug|port)\s*#?\s*$", re.I)

_SEP = r"[ \-. ‑–]"
_PHONE = re.compile(
    rf"(?<![\w.+@])(?<!\d[-/])(?:"
    rf"\+\d{{1,3}}(?:{_SEP}?\(0\))?(?:{_SEP}?\d){{7,13}}"
    rf"|\+\d{{1,3}}{_SEP}?\(\d{{1,5}}\)(?:{_SEP}?\d){{5,10}}"
    rf"|00[1-9]\d{{0,2}}(?:{_SEP}\d+){{2,5}}"
    rf"|(?:1{_SEP})?\(\d{{3}}\){_SEP}?\d{{3}}{_SEP}\d{{4}}"
    rf"|(?:1{_SEP})?\d{{3}}([ \-.])\d{{3}}\1\d{{4}}"
    rf"|0\d{{2,4}}[ \-/]\d{{3,4}}[ \-]?\d{{3,5}}"
    rf"|0\d{{1,3}}[ \-]\d{{2}}(?:[ \-]\d{{2}}){{2,3}}"
    rf")(?:\s*(?:x|ext\.?|durchwahl|poste)\s*\d{{1,5}})?(?![\w@])(?!-\d)(?!\.\d)",
    re.I,
)

_CAP = r"[A-ZÀ-ÖØ-ÞΑ-ΩЀ-Я]"
_WORDS_UP = rf"(?:{_CAP}[\w'’.-]*\s+){{1,4}}"
_STREET = r"(?:Street|St\b\.?|Court|Ct\b\.?|Road|Rd\b\.?|Avenue|Ave\b\.?|Lane|Ln\b\.?|Row|Terrace|Terr?\b\.?|Blvd\b\.?|Boulevard|Drive|Way|Place|Square|Sq\b\.?|Close|Crescent|Mews|Gardens|Walk|Parkway|Pkwy\b\.?|Alley|Circle)"
# Street addresses by language: words one of which every address of the kind holds, and the pattern. Patterns that begin
# with a digit look back after it, so that the scan stops at digits only.
_ADDRESSES = [
    (
        ("Street", "St", "Court", "Ct", "Road", "Rd", "Ave", "Lane", "Ln", "Row", "Ter", "Blvd", "Boulevard", "Drive", "Way", "Place", "Sq", "Close", "Crescent", "Mews", "Gardens", "Walk", "Parkway", "Pkwy", "Alley", "Circle"),
        re.compile(rf"\d(?<![\w.,/-]\d)\d{{0,4}}[A-Za-z]?\s+{_WORDS_UP}{_STREET}(?![\w])(?:,\s*(?:Apt|Suite|Unit|Ste|Floor|Flat|Room)\.?\s*#?\w+)?"),
    ),
    (
        ("straße", "strasse", "str.", "weg", "allee", "gasse", "platz", "ring", "damm", "ufer", "steig", "pfad", "hof", "chaussee", "graben", "markt", "Am", "Im", "Zum", "Zur", "An der", "In der", "Auf dem"),
        re.compile(rf"(?<![\w-])(?:{_CAP}[\wäöüß-]*(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer|steig|pfad|hof|chaussee|graben|markt)|(?:Am|An der|Im|In der|Auf dem|Zum|Zur)\s+{_CAP}[\wäöüß-]+)\s+\d{{1,4}}\s?[a-z]?(?![\w])"),
    ),
    (
        ("rue", "avenue", "quai", "boulevard", "place", "impasse", "chemin", "allée", "cours", "route", "square", "passage", "sentier", "venelle", "faubourg"),
        re.compile(
            rf"\d(?<![\w.-]\d)\d{{0,3}}(?:\s(?:bis|ter|quater))?,?\s+(?:rue|avenue|quai|boulevard|place|impasse|chemin|allée|cours|route|square|passage|sentier|venelle|faubourg)\s+(?:(?:de la|de l['’]|des|du|de|aux|au|à la|d['’]|la|le|les)\s*)?{_CAP}[\w'’-]*(?:\s+{_CAP}[\w'’-]*)*"
        ),
    ),
    (
        ("Calle", "Avenida", "Avda", "Paseo", "Plaza", "Camino", "Ronda", "Carretera", "C/", "Travesía", "Callejón", "Cuesta", "Vía", "Rambla"),
        re.compile(
            rf"(?<![\w-])(?:Calle|Avenida|Avda\.?|Paseo|Plaza|Camino|Ronda|Carretera|C/|Travesía|Callejón|Cuesta|Vía|Rambla)\s+(?:(?:de los|de las|de la|del|de|los|las|la|el)\s+)?{_CAP}[\w'’-]*(?:\s+(?:(?:de|del|la|los|las)\s+)*{_CAP}[\w'’-]*)*,?\s*(?:n\.?\s?[ºo°]\s*)?\d{{1,4}}(?:,?\s*\d{{1,2}}[ºª]\s*\w?)?"
        ),
    ),
    (
        ("都", "道", "府", "県"),
        re.compile(r"(?<![一-鿿])[一-鿿]{2,3}[都道府県][一-鿿ぁ-んァ-ヶ]{1,6}[市区町村郡][一-鿿ぁ-んァ-ヶー]{0,12}[0-9０-９]{1,4}(?:丁目)?(?:[-−‐]?[0-9０-９]{1,4}(?:番地?|号)?){0,3}"),
    ),
]

# fixed values: particles of family names
PARTICLES = ("van der", "van den", "van de", "von der", "von", "van", "de la", "de los", "del", "de", "di", "da", "dos", "le", "la")
_PART = "|".join(PARTICLES)
_NAME_TOKEN = rf"{_CAP}[\w'’]*(?:-{_CAP}?[\w'’]+)*"
_INITIAL = r"[^\W\d_a-zà-öø-ÿ]\."


def fold(name: str) -> str:
    return unicodedata.normalize("NFC", name).replace("’", "'").casefold()


# --- names of the corpus --------------------------------------------------------------------------------------

@F.pandas_udf(T.StringType())
def _folded(name: pd.Series) -> pd.Series:
    return name.map(lambda n: fold(n.replace("·", " ")))


def lexicon(documents: DataFrame, given_names: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Given and family names of the corpus, folded, as tables of one column, name: listed given names, families that follow them, and given names that precede those families.

    Pairs of capitalised neighbours are counted over all whole documents inside the JVM and aggregated; nothing goes to the driver.
    """
    runs = F.explode_outer(F.regexp_extract_all(F.regexp_replace(F.col(text), r"(?i)\b(van|von|de) (der|den|la) (?=\p{Lu})", "$1·$2·"), F.lit(r"(?<![\p{L}\p{N}_.@+-])\p{Lu}[\p{L}'’-]*(?: (?:\p{Lu}\.|(?:(?i:van|von|de)·(?i:der|den|la)·)?\p{Lu}[\p{L}'’-]*))+"), F.lit(0)))
    words = spread(documents.where(F.col(text).isNotNull()).select(text)).select(runs.alias("run"))
    words = words.select(F.filter(F.split(F.lower("run"), " "), lambda w: ~w.rlike(r"^\p{L}\.$")).alias("w")).where(F.size("w") > 1)
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b")))).alias("p"))
    pairs = cut(pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")))
    listed = cut(given_names.where("given_name is not null").select(F.lower("given_name").alias("g")).distinct())
    # a family name follows given names, or stands before them, and isn't one itself
    after = pairs.join(listed, pairs.a == listed.g, "left_semi").select(F.col("b").alias("f"), "n", F.col("a").alias("g"))
    family = after.groupBy("f").agg(F.sum("n").alias("n"), F.countDistinct("g").alias("k")).where((F.col("n") >= MIN_FAMILY) & (F.col("k") >= 2) & (F.length("f") > 2))
    family = family.join(listed, family.f == listed.g, "left_anti")
    share = pairs.groupBy("b").agg(F.sum("n").alias("all"))
    family = cut(family.join(share, family.f == share.b).where(F.col("n") >= 0.2 * F.col("all")).select("f"))
    before = pairs.join(family, pairs.b == family.f, "left_semi")
    given = before.groupBy("a").agg(F.countDistinct("b").alias("k"), F.sum("n").alias("n"))
    everywhere = pairs.groupBy(F.col("a").alias("w")).agg(F.sum("n").alias("all"))
    new = given.join(everywhere, given.a == everywhere.w).where((F.col("k") >= MIN_GIVEN) & (F.col("n") >= 0.6 * F.col("all")) & (F.length("a") > 1)).select("a").join(listed, F.col("a") == listed.g, "left_anti").join(family, F.col("a") == family.f, "left_anti")
    return cut(listed.select(F.col("g").alias("n")).unionByName(new.select(F.col("a").alias("n"))).select(_folded("n").alias("name")).distinct()), cut(family.select(_folded("f").alias("name")).distinct())


def _lowered(text: str) -> str:
    """In lower case, each character at its place."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.replace("’", "'")


def _stands(text: str, low: str, s: int, e: int) -> bool:
    """Whether low[s:e] may be a family name, by its neighbours and its first letter."""
    if (s and (low[s - 1].isalnum() or low[s - 1] in "_@-'" or (low[s - 1] == "." and s > 1 and low[s - 2].isalnum() and not (text[s - 2].isupper() and (s < 3 or not low[s - 3].isalnum()))))) or (e < len(low) and (low[e].isalnum() or low[e] in "_@-")):
        return False
    return text[s].isupper() or low.startswith(PARTICLES, s)


# what a family name of lexicon() is made of: letters, marks that fold() makes of them, apostrophes, hyphens; before it two particles or none
_MARKS = "\u0300-\u036f\u05b0-\u05c7\u093c\u09bc\u0a3c\u0b3c\u0f90-\u0fbc"
_FAMILY = re.compile(rf"[^\W\d_](?:[^\W\d_]|['{_MARKS}-])*")
# these look back from the first letter, so that the scan stops at few; a lower-case one may begin a particle
_STARTS = re.compile(rf"[^\W\d_a-ce-km-uw-z](?<![\w@'’-].)(?:(?<![dlv])|(?=[aeioAEIO]))(?:[^\W\d_]|['’{_MARKS}-])*")
_TOKENS = re.compile(rf"(?={_CAP})(?<![\w'’.-]){_NAME_TOKEN}")
_TWO_PARTICLES = re.compile(r"(?:van|von|de) (?:der|den|la) ")
_FIRST = {"van", "von", "de"}
_MARK, _INNER_END, _KANJI = re.compile(f"[{_MARKS}]"), re.compile(f"['{_MARKS}]"), re.compile("[一-鿿々]+")
_PLAIN = re.compile("[一-鿿々ぁ-んァ-ヶー]{2,}")


def _ends(low: str, s: int, longest: int) -> Iterator[int]:
    """Where a family name of at most so many characters may end that begins at s."""
    two = _TWO_PARTICLES.match(low, s)
    for start in (s, two.end()) if two else (s,):
        if m := _FAMILY.match(low, start, s + longest + 1):
            yield from (x.start() for x in _INNER_END.finditer(low, s + 1, m.end()))
            if m.end() - s <= longest:
                yield m.end()


class Finder:
    """Finds places in texts. Built once per worker from the lexicon."""

    def __init__(self, given: Iterable[str], family: Iterable[str]) -> None:
        self.given = set(given)
        # scripts without case: a family name of up to three characters before a listed given name
        plain = sorted((g for g in self.given if _PLAIN.fullmatch(g)), key=lambda g: (-len(g), g))
        self.plain = re.compile(rf"(?<![一-鿿々])[一-鿿々]{{1,3}}[ \u3000・]?(?:{'|'.join(plain)})(?![一-鿿々])") if plain else None
        self.auto = ahocorasick.Automaton()
        for f in family:
            self.auto.add_word(f, len(f))
        self.ready = len(self.auto) > 0
        if self.ready:
            self.auto.make_automaton()

    _left = re.compile(rf"(?:(?<![\w'’.-])(?P<g>{_NAME_TOKEN})(?:[ \t ]+{_INITIAL})?|(?<![\w'’.-])(?P<i>{_INITIAL}(?:[  ]?{_INITIAL})*))[ \t ]*(?:\r?\n[ \t]*)?$")
    _initial = re.compile(rf"(?<![\w'’.-]){_INITIAL}(?:[  ]?{_INITIAL})*[ \t ]*(?:\r?\n[ \t]*)?$")
    _right = re.compile(rf"(?P<c>,)?[ \t ]+(?:(?P<i>{_INITIAL})|(?P<g>{_NAME_TOKEN})(?:[ \t ]+(?P<m>{_INITIAL}))?)(?![\w])")

    @classmethod
    def _after(cls, text: str, e: int) -> re.Match | None:
        return cls._right.match(text, e, min(len(text), e + 48))

    @classmethod
    def keys(cls, text: str, longest: int) -> set[str]:
        """Every name of at most so many characters that names() could use in this text, whichever lexicon it has.

        With the names of a lexicon that are among them a finder finds what it finds with the whole lexicon.
        """
        out: set[str] = set()
        for run in _KANJI.finditer(text):
            for at in range(run.start() + 1, min(run.start() + 3, run.end()) + 1):
                for s in (at, at + 1) if text[at : at + 1] in (" ", "\u3000", "・") else (at,):
                    if m := _PLAIN.match(text, s, s + longest):
                        out.update(text[s:e] for e in range(s + 2, m.end() + 1) if not _KANJI.match(text, e))
        low = _lowered(text)
        for word in _STARTS.finditer(text):
            s, to = word.span()
            if word[0].isalpha() and low[s:to] not in _FIRST:
                spans = [(s, to)] if to - s <= longest else []
            else:
                spans = {(i, e) for i in (s, *(m.end() for m in _MARK.finditer(text, s, to))) for e in _ends(low, i, longest)}
            for i, e in spans:
                if _stands(text, low, i, e):
                    out.add(low[i:e])
                    # a given name behind may be cut by the window; all others are whole tokens
                    if (m := cls._after(text, e)) and m["g"]:
                        out.add(fold(m["g"]))
        out.update(map(fold, _TOKENS.findall(text)))
        return {name for name in out if len(name) <= longest}

    def names(self, text: str) -> Iterator[tuple[int, int]]:
        if self.plain:
            yield from ((m.start(), m.end()) for m in self.plain.finditer(text))
        if not self.ready:
            return
        low = _lowered(text)
        hits = [(end + 1 - n, end + 1) for end, n in self.auto.iter(low) if _stands(text, low, end + 1 - n, end + 1)]
        last = -1
        for s, e in sorted(hits, key=lambda h: (h[0], -h[1])):
            if s < last:
                continue
            # the longest hit that starts here or before and covers it
            s0 = s
            m = self._left.search(text, max(0, s - 48), s)
            if m and m["g"] and fold(m["g"]) not in self.given:
                m = self._initial.search(text, max(0, s - 12), s)
            if m:
                yield (m.start(), e)
                last = e
                continue
            m = self._after(text, e)
            if m and ((m["g"] and fold(m["g"]) in self.given) or (m["i"] and m["c"])):
                end = m.end()
                yield (s0, end)
                last = end

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind), in order, without overlaps: e-mail addresses first, then numbers, addresses, names."""
        out: list[tuple[int, int, str]] = []
        taken: list[tuple[int, int]] = []

        def free(s: int, e: int) -> bool:
            return all(e <= a or s >= b for a, b in taken)

        def take(s: int, e: int, kind: str) -> None:
            if free(s, e):
                taken.append((s, e))
                out.append((s, e, kind))

        if "@" in text or "＠" in text:
            for m in _EMAIL.finditer(text):
                take(m.start(), m.end(), "email")
        if ("dot" in text.lower() or _AT_SIGN.search(text)) and _MAY_HIDE.search(text):
            for m in _HIDDEN.finditer(text):
                take(m.start(), m.end(), "email")
        for m in _ID.finditer(text):
            before = text[max(0, m.start() - 40) : m.start()]
            if _NOT_ID.search(before):
                continue
            if m[0].isdigit() and not _ID_WORD.search(before):
                continue
            take(m.start(), m.end(), "id_number")
        for m in _PHONE.finditer(text):
            if not _NOT_ID.search(text[max(0, m.start() - 20) : m.start()]):
                take(m.start(), m.end(), "phone")
        for words, pattern in _ADDRESSES:
            if any(w in text for w in words):
                for m in pattern.finditer(text):
                    take(m.start(), m.end(), "address")
        for s, e in self.names(text):
            take(s, e, "name")
        return sorted(out)


_FINDERS: dict[str, Finder] = {}


def _finder(given: list[str], family: list[str], key: str) -> Finder:
    if key not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[key] = Finder(given, family)
    return _FINDERS[key]


# --- entities ---------------------------------------------------------------------------------------------------

_PART_OF_NAME = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?")


def parts(name: str) -> tuple[list[str], list[str], list[str]]:
    """The words, initials and particles of a name, folded."""
    words, initials, little = [], [], []
    for m in _PART_OF_NAME.finditer(name):
        w = fold(m[0])
        if w in _LITTLE:
            little.append(w)
        elif len(w.rstrip(".")) == 1:
            initials.append(w[0])
        else:
            words.append(w.rstrip("."))
    return words, initials, little


_LITTLE = {w for p in PARTICLES for w in p.split()} | {"den", "der", "los"}


def normal(kind: str, value: str) -> str:
    """What makes two mentions one: names by their sorted words and initials, e-mail addresses without disguise, numbers by their digits."""
    v = fold(value)
    if kind == "name":
        words, initials, little = parts(value)
        return " ".join([*sorted(words), *(f"{i}." for i in initials), *little]) or v
    if kind == "email":
        return re.sub(r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+|＠", "@", re.sub(r"\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+", ".", v))
    if kind == "phone":
        v = re.split(r"x|ext|durchwahl|poste", v)[0].replace("(0)", "")
        digits = re.sub(r"\D", "", v)
        return f"+{digits}" if v.lstrip().startswith("+") else f"+{digits[2:]}" if digits.startswith("00") else digits
    return re.sub(r"\s+", " ", v) if kind == "address" else re.sub(r"[\s-]+", "", v)


def entities(found: list[tuple[int, int, str]], text: str) -> list[str]:
    """Who each place of a text means. A name with an initial means the one fuller name of the same text that fits it, and is apart where none or several do."""
    out = [normal(k, text[s:e]) for s, e, k in found]
    names = {n: parts(text[s:e]) for (s, e, k), n in zip(found, out, strict=True) if k == "name"}
    full = {n: p for n, p in names.items() if len(p[0]) >= 2}

    def fits(short: tuple, long: tuple) -> bool:
        rest = list(long[0])
        for w in short[0]:
            if w not in rest:
                return False
            rest.remove(w)
        heads = [w[0] for w in rest] + long[1]
        for i in short[1]:
            if i not in heads:
                return False
            heads.remove(i)
        return short[2] == long[2]

    same = {}
    for n, p in names.items():
        if p[1]:
            fit = [m for m, q in full.items() if m != n and len(q[0]) > len(p[0]) and fits(p, q)]
            same[n] = fit[0] if len(fit) == 1 else n
    return [same.get(n, n) if k == "name" else n for (_, _, k), n in zip(found, out, strict=True)]


# --- surrogates ---------------------------------------------------------------------------------------------------

# fixed values: consonants and vowels of made-up names by script, and the vowel that ends feminine ones
_SCRIPTS = {
    "LATIN": ("bdfgklmnprstvz", "aeiou", "a"), "CYRILLIC": ("бвгдзклмнпрст", "аеиоу", "а"), "GREEK": ("βγδκλμνπρστ", "αειου", "α"),
    "HIRAGANA": ("かきくけこさしすせそたちつてとなにぬねのまみむめも", "かさたなまきしちにみ", "み"), "KATAKANA": ("カキクケコサシスセソタチツテトナニヌネノマミムメモ", "カサタナマキシチニミ", "ミ"),
    "CJK": ("佐藤田中山木村林森川石原井上野口松本清水", "一二三太郎介平和明正美子香恵奈", "子"), "HANGUL": ("가나다라마바사아자차카타파하", "고노도로모보소오조초", "희"), "ARABIC": ("بتجدرزسفكلمن", "اوي", "ة"),
}
# fixed values: first letters that a made-up name may have, by script; a name's first letter decides its surrogate's
_LETTERS = {"LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзийклмнопрстуфхцчшщыэюяі", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}
# fixed values: given names whose ending does not tell their gender
_FEMININE = set("sarah ruth ingrid carmen isabel astrid karin susan margaret elisabeth elizabeth agnes ines inés doris iris kathrin beatriz pilar mercedes dolores raquel judith edith jorunn tamsin elspeth hesper maelys odalys orla".split())
_MASCULINE = set("luca joscha joshua sascha mika nikita ilya kostya".split())


def feminine(token: str) -> bool:
    return token in _FEMININE or (token not in _MASCULINE and token[-1:] in "aáàаαñ" or token.endswith(("ette", "elle", "ine", "ienne", "die", "lie", "子", "美", "恵")))


def _stream(key: bytes, what: str) -> Iterator[int]:
    n = 0
    while True:
        yield from hmac.new(key, f"{what}|{n}".encode(), hashlib.sha256).digest()
        n += 1


@lru_cache(maxsize=8)
def _letters(key: bytes) -> dict[str, str]:
    """A keyed permutation of the letters of each script. Initials go by it, and so do the first letters of names: an initial fits its name before and after."""
    out = {}
    for script, abc in _LETTERS.items():
        order = sorted(abc, key=lambda c: hmac.new(key, f"{script}|{c}".encode(), hashlib.sha256).digest())
        # one cycle through the keyed order: no letter stays itself
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def _initial(ch: str, key: bytes) -> str:
    """The letter for a letter; accents stay, so that different letters stay different."""
    d = unicodedata.normalize("NFD", ch)
    return unicodedata.normalize("NFC", _letters(key).get(d[0], d[0]) + d[1:])


def _script(ch: str) -> str:
    name = unicodedata.name(ch, "LATIN").split(" ")[0].split("-")[0]
    return name if name in _SCRIPTS else "LATIN"


def _word(token: str, key: bytes, what: str, letters: int) -> str:
    """A made-up name of the script, ending and apostrophes of the token, of so many letters at least."""
    bits, out = _stream(key, what), []
    pieces = re.split(r"(['-])", token)
    for k, piece in enumerate(pieces):
        if piece in ("'", "-", ""):
            out.append(piece)
            continue
        script = _script(piece[0])
        cons, vowels, end = _SCRIPTS[script]
        n = max(len(piece), letters if k == len(pieces) - 1 else 1)
        head = _initial(piece[0], key) if script in _LETTERS else cons[next(bits) % len(cons)]
        made, vowel = [head], unicodedata.normalize("NFD", head)[0] in vowels
        while len(made) < n:
            pool = cons if vowel else vowels
            made.append(pool[next(bits) % len(pool)])
            vowel = not vowel
        if n > 1 and k == len(pieces) - 1:
            ends = end if feminine(token) else cons if piece[-1] not in "aeiouyáéíóúаеиоуαειου" or feminine(piece) else vowels.replace(end, "") or vowels
            made[-1] = ends[next(bits) % len(ends)]
        out.append("".join(made))
    return "".join(out)


def _shape(value: str, key: bytes, what: str) -> str:
    """Digits for digits and letters for letters, in the same case; the rest stays."""
    bits, out = _stream(key, what), []
    for ch in value:
        if ch.isdigit():
            out.append(str(next(bits) % 10))
        elif ch.isalpha():
            new = chr(97 + next(bits) % 26)
            out.append(new.upper() if ch.isupper() else new)
        else:
            out.append(ch)
    return "".join(out)


_KEEP = {"suite", "unit", "floor", "avenue", "boulevard", "quai", "place", "chemin", "impasse", "allée", "route", "square", "passage", "sentier", "calle", "avenida", "paseo", "plaza", "camino", "ronda", "carretera"}
_ADDRESS_PART = re.compile(r"[^\W\d_]{4,}|\d+")


def draw(kind: str, entity: str, key: bytes, salt: int, letters: int) -> str:
    """The keyed surrogate of an entity (of a word, for names), in normal form. Another salt gives another one; from the eighth on they grow longer, so that there are enough."""
    what, more = f"{kind}|{entity}|{salt}", max(0, salt - 7)
    if kind == "name":
        return _word(entity, key, what, letters + more)
    if kind == "email":
        local, _, domain = entity.partition("@")
        return f"{_shape(local + 'x' * max(0, letters + 2 + more - len(local)), key, what)}@{_shape(domain.split('.')[0], key, f'domain|{domain}')}.example"
    if kind == "phone":
        keep = 3 if entity.startswith("+") else 1 if entity.startswith("0") else 0
        return entity[:keep] + _shape(entity[keep:] + "0" * more, key, what)
    if kind == "address":
        def new(m: re.Match) -> str:
            if m[0].isdigit():
                return str(1 + int.from_bytes(hmac.new(key, f"{what}|{m.start()}".encode(), hashlib.sha256).digest()[:4], "big") % (10 ** len(m[0]) - 1)) + "1" * more
            return m[0] if re.fullmatch(_STREET, m[0], re.I) or m[0] in _KEEP else _word(m[0], key, f"{what}|{m.start()}", 4)

        return _ADDRESS_PART.sub(new, entity)
    return _shape(entity + "0" * more, key, what)


def compose(kind: str, value: str, drawn: list[str], key: bytes) -> str:
    """The surrogate in the form of the mention: case, order, separators and particles as there. drawn: that of each word, for names in the order of the text."""
    if kind == "name":
        words = iter(drawn)

        def new(m: re.Match) -> str:
            w = fold(m[0])
            if w in _LITTLE:
                return m[0]
            if len(w.rstrip(".")) == 1:
                return _initial(w[0], key).upper() + m[0][1:]
            return _case(m[0], next(words)) + ("." if w.endswith(".") else "")

        return _PART_OF_NAME.sub(new, value)
    core = drawn[0]
    if kind == "phone":
        head, ext = re.match(r"\s*00", value), re.search(r"(?:x|ext|durchwahl|poste)", value, re.I)
        spared = [m.span() for m in re.finditer(r"\(0\)", value)] + ([head.span()] if head else [])
        digits, bits, out = iter(core.lstrip("+")), _stream(key, f"ext|{value}"), []
        for i, ch in enumerate(value):
            if not ch.isdigit() or any(a <= i < b for a, b in spared):
                out.append(ch)
            else:
                out.append(str(next(bits) % 10) if ext and i >= ext.start() else next(digits, ""))
        rest = "".join(digits)
        return "".join(out) if not rest else "".join(out[: ext.start()] if ext else out).rstrip() + rest + ("".join(out[ext.start() :]) if ext else "")
    if kind == "address":
        tokens = iter(_ADDRESS_PART.findall(core))
        return _ADDRESS_PART.sub(lambda m: _case(m[0], next(tokens, m[0])), value)
    if kind == "id_number":
        chars = iter(core)
        return "".join((c.upper() if ch.isupper() else c) if ch.isalnum() and (c := next(chars, "")) else ch for ch in value) + "".join(chars)
    return core


def _case(like: str, text: str) -> str:
    if like.isupper() and len(like.rstrip(".")) > 1:
        return text.upper()
    return "-".join(p[:1].upper() + p[1:] for p in text.split("-")) if like[:1].isupper() else text


def placeholder(kind: str, entity: str, key: bytes) -> str:
    """[KIND-1a2b3c4d5e6f7081]: the same entity has the same tag everywhere, without saying who it is."""
    return f"[{kind.upper()}-{hmac.new(key, f'{kind}|{entity}'.encode(), hashlib.sha256).hexdigest()[:16]}]"


# --- operators ----------------------------------------------------------------------------------------------------

_SPAN = "array<struct<kind:string,start_pos:int,end_pos:int,value:string,entity:string,words:array<string>>>"


def _spans(finder: Finder, text: str | None) -> list[tuple]:
    if not text:
        return []
    found = finder.find(text)
    return [(k, s, e, text[s:e], n, parts(text[s:e])[0] if k == "name" else [normal(k, text[s:e])]) for (s, e, k), n in zip(found, entities(found, text), strict=True)]


def places(documents: DataFrame, given_names: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, h, kind, start_pos, end_pos, value, entity, words) of every place; h is a hash of the text.

    A lexicon of at most MAX_NAMES names goes to the workers whole. A larger one is joined to all names that each text could
    hold (Finder.keys), so that it comes with those of the lexicon: the places are the same either way.
    """
    given, family = lexicon(documents, given_names, text)
    docs = spread(documents.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t")))
    if given.unionAll(family).limit(MAX_NAMES + 1).count() <= MAX_NAMES:
        names = sorted(r[0] for r in given.collect()), sorted(r[0] for r in family.collect())
        lex = documents.sparkSession.sparkContext.broadcast((*names, hashlib.sha256("\n".join([*names[0], "", *names[1]]).encode()).hexdigest()))

        @F.pandas_udf(_SPAN)
        def find(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            finder = _finder(*lex.value)
            for s in it:
                yield pd.Series([_spans(finder, t) for t in s], dtype=object)

        # not deterministic to Spark: else a filter on the array's size is inferred and the places are sought twice
        got = docs.select("id", F.xxhash64("t").alias("h"), find.asNondeterministic()("t").alias("p"))
    else:
        docs = docs.withColumn("h", F.xxhash64("t"))
        longest = given.unionAll(family).agg(F.max(F.length("name"))).first()[0] or 0

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def keys(text: pd.Series) -> pd.Series:
            return text.map(lambda t: list(Finder.keys(t, longest)))

        words = docs.select("h", F.explode(keys.asNondeterministic()("t")).alias("name"))
        names = given.select("name", F.lit(True).alias("is_given")).unionByName(family.select("name", F.lit(False).alias("is_given")))
        held = words.join(names, "name").groupBy("h").agg(F.collect_set(F.when(F.col("is_given"), F.col("name"))).alias("g"), F.collect_set(F.when(~F.col("is_given"), F.col("name"))).alias("f"))

        @F.pandas_udf(_SPAN)
        def find_among(t: pd.Series, g: pd.Series, f: pd.Series) -> pd.Series:
            some = lambda x: [] if x is None else list(x)
            return pd.Series([_spans(Finder(some(b), some(c)), a) for a, b, c in zip(t, g, f, strict=True)], dtype=object)

        got = docs.join(held, "h", "left").select("id", "h", find_among.asNondeterministic()("t", "g", "f").alias("p"))
    return got.select("id", "h", F.explode("p").alias("p")).select("id", "h", "p.*")


def assign(wanted: DataFrame, key: bytes, letters: int = 7) -> DataFrame:
    """(kind, entity, drawn) for distinct (kind, entity): surrogates that no two entities share and that are nobody's own.

    In rounds: all open entities draw; of those that drew the same, and of those whose draw is settled or is itself an entity,
    only the first of the former settles; the others draw again with the next salt. Rounds stop when none is open: later draws
    are longer, so there are always enough. The entities stay in tables; the driver sees only whether any is open.
    """
    @F.pandas_udf(T.StringType())
    def drawing(kind: pd.Series, entity: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([draw(k, e, key, s, letters) for k, e, s in zip(kind, entity, salt, strict=True)], dtype=object)

    wanted = cut(wanted.distinct())
    own = wanted.select("kind", F.col("entity").alias("drawn"))
    settled, open_, salt = None, wanted, 0
    while open_.limit(1).count():
        drew = open_.select("kind", "entity", drawing("kind", "entity", F.lit(salt)).alias("drawn"))
        free = drew.join(own, ["kind", "drawn"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        new = cut(free.groupBy("kind", "drawn").agg(F.min("entity").alias("entity")).select("kind", "entity", "drawn"))
        settled = new if settled is None else settled.unionByName(new)
        open_ = cut(open_.join(new, ["kind", "entity"], "left_anti"))
        salt += 1
    return settled if settled is not None else wanted.withColumn("drawn", F.lit(None).cast("string"))


def surrogates(documents: DataFrame, given_names: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kind, start_pos, end_pos, placeholder, surrogate, h) of every place, in characters from 0.

    Detected entities receive keyed replacements of their type, script, format and, for names, gender. Names are replaced word by
    word, so that people who share a family name share the new one, and an initial is the first letter of the new name. Over
    the whole corpus the same entity has the same surrogate and no two have one: see assign. Null and empty texts have no places;
    repeated rows give theirs once; with an empty list of given names no names are found. The key is a secret of the caller.
    """
    if not key:
        raise ValueError("a key is needed")
    secret = key.encode()
    p = cut(places(documents, given_names, id_col, text).distinct())
    words = p.select("id", "h", "kind", "start_pos", F.posexplode("words").alias("k", "entity"))
    drawn = assign(words.select("kind", "entity"), secret)
    got = words.join(maybe_broadcast(drawn), ["kind", "entity"]).groupBy("id", "h", "start_pos").agg(F.array_sort(F.collect_list(F.struct("k", "drawn"))).alias("d"))  # the words of one name
    at = p.join(got.withColumnsRenamed({"id": "_id", "h": "_h", "start_pos": "_s"}), F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("start_pos") == F.col("_s")), "left")

    @F.pandas_udf("placeholder string, surrogate string")
    def made(kind: pd.Series, value: pd.Series, entity: pd.Series, new: pd.Series) -> pd.DataFrame:
        rows = [(placeholder(k, e, secret), compose(k, v, [] if d is None else list(d), secret)) for k, v, e, d in zip(kind, value, entity, new, strict=True)]
        return pd.DataFrame(rows, columns=["placeholder", "surrogate"])

    return at.select(F.col("id").alias(id_col), "kind", "start_pos", "end_pos", made("kind", "value", "entity", F.col("d.drawn")).alias("m"), "h").select(id_col, "kind", "start_pos", "end_pos", "m.*", "h")


def find_places(documents: DataFrame, given_names: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kind, start_pos, end_pos) of every place that surrogates() replaces."""
    return surrogates(documents, given_names, key, id_col, text).select(id_col, "kind", "start_pos", "end_pos").distinct()


def replace_places(documents: DataFrame, given_names: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, places, redacted, surrogate): whole texts with typed placeholders, and with surrogates of the same type and format. Null texts stay null; every row of the table gives one."""
    m = surrogates(documents, given_names, key, id_col, text)
    per = m.groupBy(F.col(id_col).alias("_id"), F.col("h").alias("_h")).agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "placeholder", "surrogate"))).alias("m"))  # the places of one text
    docs = documents.select(F.col(id_col).alias("id"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    j = docs.join(per, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")

    @F.pandas_udf("places int, redacted string, surrogate string")
    def run(t: pd.Series, m: pd.Series) -> pd.DataFrame:
        rows = []
        for x, spans in zip(t, m, strict=True):
            if x is None or spans is None or not len(spans):
                rows.append((0, x, x))
                continue
            made, at = ([], []), 0
            for p in spans:
                for k, name in enumerate(("placeholder", "surrogate")):
                    made[k].extend((x[at : p["start_pos"]], p[name]))
                at = p["end_pos"]
            rows.append((len(spans), *("".join(a) + x[at:] for a in made)))
        return pd.DataFrame(rows, columns=["places", "redacted", "surrogate"]).astype({"places": "int32"})

    return j.select(F.col("id").alias(id_col), run("t", "m").alias("r")).select(id_col, "r.*")
