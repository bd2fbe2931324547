"""Broken prompt and response pairs: ordered rules, each of which may fire."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.llm.lang import by_script, detect
from weftspark.util import cut, maybe_broadcast, spread

#: The order of the rules; where one defect per pair is wanted, the first that fires is it.
DEFECTS = ("empty", "copies_question", "refusal", "truncated", "other_language")

# fixed values: fillers that stand for no answer
PLACEHOLDERS = {
    "", "n/a", "na", "n.a", "none", "null", "nil", "nan", "todo", "tbd", "tba", "fixme", "answer", "no answer", "empty", "placeholder", "your answer here", "not available",
    "keine antwort", "pas de réponse", "sin respuesta", "k.a", "s/o", "unknown", "undefined", "lorem ipsum", "insert answer here", "pending", "xxx",
}
_EDGE = re.compile(r"^[\s\W_]+|[\s\W_]+$")

# fixed values: phrases by which a speaker declines, in English, German, French, Spanish, Italian, Portuguese, Dutch, Japanese, Chinese and Russian
_TALK = r"(?:help|assist|answer|respond|comment|explain|discuss|share|provide|give|offer|comply|speculate|diagnos\w*|advise|disclose|elaborate|reveal|say|address)"
REFUSALS = [
    rf"\b(?:i|we)(?:'m| am|'re| are)?\s+(?:really\s+|simply\s+|still\s+)?(?:can(?:no|')t|can not|could ?n[o']t|unable|not able|not (?:in a position|allowed|permitted|authori[sz]ed))\b(?:\s+\w+){{0,3}}?\s+(?:to\s+)?{_TALK}\b",
    rf"\bi\s+(?:will|would|can|shall)\s+not\s+be\s+able\s+to\s+{_TALK}\b",
    rf"\bi\s+(?:(?:will|shall|would|can)\s+not|won't|wouldn't|would\s+rather\s+not|'d\s+rather\s+not|prefer\s+not\s+to)\s+(?:go\s+into|{_TALK})\b",
    r"\bi(?:'d| would)?\s+rather\s+not\b|\bi\s+prefer\s+not\s+to\b|\bi\s+(?:do\s+not|don't)\s+feel\s+comfortable\b|\bi(?:'m| am)\s+not\s+comfortable\b",
    rf"\b(?:isn't|is\s+not|not)\s+possible\s+for\s+(?:me|us)\s+to\s+{_TALK}\b|\b(?:must|have\s+to|need\s+to)\s+(?:decline|refuse|pass\s+on|leave\s+unanswered)\b|\bi\s+(?:decline|refuse)\b",
    rf"\bno\s+(?:answer|diagnosis|comment|advice|help)\s+can\s+be\s+(?:given|provided|offered)\b|\b(?:outside|beyond)\s+what\s+i(?:'m| am)\s+(?:permitted|allowed|able)\b|\bnot\s+something\s+(?:that\s+)?(?:i|we)\s+can\s+{_TALK}\b",
    r"\bunable\s+to\s+comply\b|\bas\s+an\s+ai\b.*\b(?:not|cannot|can't|unable)\b|\bi\s+must\s+leave\s+unanswered\b|\bi\s+have\s+to\s+pass\b",
    r"\bkann\s+ich\b.*\bnicht\s+(?:beantworten|helfen|sagen|geben|kommentieren|erklären)\b|\bich\s+(?:kann|darf|möchte|werde)\b.*\b(?:nicht|keine?n?)\b.*\b(?:beantworten|helfen|sagen|geben|kommentieren|erklären|äußern|machen|auskunft)\b",
    r"\bdarf\s+ich\b.*\b(?:nicht|keine)\b|\bgebe\s+ich\s+keine\b|\bist\s+es\s+mir\s+nicht\s+möglich\b|\bich\s+bin\s+(?:leider\s+)?nicht\s+(?:befugt|berechtigt|autorisiert|in\s+der\s+lage)\b|\bes\s+ist\s+mir\s+(?:leider\s+)?nicht\s+möglich\b|\bmir\s+(?:leider\s+)?nicht\s+(?:möglich|gestattet|erlaubt)\b",
    r"\bje\s+(?:ne|n'|n’)\s*\w*\s*(?:peux|puis|suis|souhaite|veux|pourrai)\b\s+pas\b|\bpas\s+(?:possible|autorisé|en\s+mesure)\s+(?:de|d')\s*(?:fournir|répondre|commenter|aider|donner)\b|\bm['’]est\s+pas\s+possible\b|\bje\s+préfère\s+ne\s+pas\b|\bimpossible\s+pour\s+moi\b",
    r"\bno\s+(?:puedo|podemos|podré)\s+(?:ayudar|responder|comentar|dar|ofrecer|explicar|contestar)\b|\bno\s+me\s+es\s+posible\b|\bno\s+estoy\s+autorizad[oa]\b|\bprefiero\s+no\b|\bno\s+(?:me\s+est[áa]\s+permitido|tengo\s+permiso)\b|\bme\s+es\s+imposible\b",
    r"\bnon\s+(?:posso|possiamo|potrò|sono\s+(?:in\s+grado|autorizzat[oa]))\b.{0,30}?\b(?:aiutar\w*|risponder\w*|commentare|fornire|dare|spiegare|assister\w*)|\bmi\s+dispiace,?\s+(?:ma\s+)?non\s+posso\b|\bpreferisco\s+non\b|\bnon\s+mi\s+è\s+(?:possibile|permesso|consentito)\b",
    r"\bnão\s+(?:posso|podemos|consigo|estou\s+autorizad[oa])\b.{0,30}?\b(?:ajudar|responder|comentar|fornecer|dar|explicar)|\bprefiro\s+não\b|\b(?:ik|wij)\s+kan\b.{0,30}?\bniet\s+(?:helpen|beantwoorden|geven)\b",
    r"(?:お答え|回答|お手伝い|対応|お伝え|説明|提供|コメント)(?:は|を|が|に)?(?:することは|することが)?(?:できません|できかねます|いたしかねます|致しかねます|差し控え)|申し訳(?:ありません|ございません)が.{0,40}(?:できません|かねます)",
    r"(?:抱歉|对不起|很遗憾|不好意思).{0,20}(?:无法|不能|不便)|我(?:无法|不能)(?:回答|帮助|提供|评论|协助)",
    r"\bя\s+не\s+(?:могу|смогу|вправе)\s+(?:помочь|ответить|комментировать|предоставить|дать|объяснить)|\bк\s+сожалению,?\s+.{0,30}?не\s+(?:могу|смогу)\b",
]
_REFUSAL = re.compile("|".join(REFUSALS), re.I | re.S)
# fixed values: what every phrase of REFUSALS has one of, in lower case; a text without any declines nothing
_DECLINES = ("can't", "cann", "can not", "could", "unable", "not able", "not in a position", "not allow", "not permit", "not author", "not be able", "won't", "wouldn't", "rather not", "not to", "not comfort", "not feel", "don't feel", "not go", "not help", "not assist", "not answer", "not respond", "not comment", "not explain", "not discuss", "not share", "not provide", "not give", "not offer", "not comply", "not speculate", "not diagnos", "not advise", "not disclose", "not elaborate", "not reveal", "not say", "not address",
    "possible for", "decline", "refuse", "pass on", "to pass", "leave unanswered", "can be", "beyond what", "outside what", "not something", "an ai", "kann", "darf", "möchte", "werde", "keine", "möglich", "gestattet", "erlaubt", "befugt", "berechtigt", "autorisiert", "in der lage", "pas", "je préfère", "impossible", "no pue", "no pod", "no me", "no estoy", "prefiero", "no tengo", "imposible",
    "non ", "preferisco", "não", "prefiro", "niet", "ません", "かね", "差し控え", "抱歉", "对不起", "遗憾", "不好意思", "无法", "不能", "не ")
# fixed values: courtesies that go with a refusal and give no help
_COURTESY = re.compile(
    r"^(?:i(?:'m| am)\s+)?(?:very\s+)?sorry\b[^.]*$|^thank(?:s| you)\b|^please\s+(?:ask|contact|consult|refer|reach|see)\b|^you\s+(?:may|might|could|can)\s+(?:wish|want|try|like)?\s*(?:to\s+)?(?:consult|contact|ask|refer|check with)\b|^unable\s+to\s+comply\b|^the\s+request\s+concerns\b|^bitte\s+(?:wenden|fragen|kontaktieren)\b|^vielen\s+dank\b|^danke\b|^merci\b|^veuillez\s+(?:contacter|consulter|demander)\b|^gracias\b|^consulte\b|^por\s+favor\b|^es\s+tut\s+mir\s+leid\b|^désolée?\b|^mi\s+dispiace\b|^desculpe\b|^申し訳|^すみません|^恐れ入りますが|^抱歉|^对不起|^извините\b|^lo\s+siento\b|^regrettably\b|^unfortunately\b",
    re.I,
)
_CONTRAST = re.compile(r",\s*(?:but|aber|mais|pero|so)\b", re.I)
_TECHNICAL = re.compile(r"\w*[_\d]\w*")
_SENTENCE = re.compile(r"(?<=[.!?。！？:])\s+|\n+")

_LABEL = re.compile(r"^\s*(?:re|q|a|question|answer|you\s+asked|the\s+question\s+(?:is|was)|frage|antwort|réponse|pregunta|respuesta)\s*:\s*", re.I)
_WORDS = re.compile(r"\w+")
_LIST_ITEM = re.compile(r"^\s*(?:\d+[.)]|[-*•–])(?:\s+(?P<body>.*))?$")
_COMMAND = re.compile(r"\b(?:run|execute|ausführen|exécutez|ejecute|starten|lancer|lancez)\s*:\s*`?(?P<cmd>\S.*)$", re.I)
_CLOSERS = "\"'”’»)]*`_"
_TERMINAL = ".!?。！？…"
_OPEN, _CLOSE = "([{", ")]}"
#: Words after which no sentence ends.
_DANGLING = {
    w
    for ws in (
        "the a an of and or to in on at for with by from as than into near between but because whose its is are was were",
        "der die das und oder zu auf mit für von den dem des im am bei ein eine einen einem weil",
        "le la les des du et ou une un dans pour sur par avec au aux de que qui",
        "el los las del y o una un en para con por al de que",
    )
    for w in ws.split()
}


def is_empty(answer: str | None) -> bool:
    return answer is None or _EDGE.sub("", answer).lower() in PLACEHOLDERS or not re.search(r"\w", answer)


def _words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def is_copy(question: str | None, answer: str) -> bool:
    """The answer's words are the question's, once or repeated, or a run of at least five of them."""
    if not question:
        return False
    a = answer
    while m := _LABEL.match(a):
        a = a[m.end() :]
    q, w = _words(question), _words(a)
    if not q or not w:
        return False
    if len(w) >= len(q) and len(w) % len(q) == 0 and w == q * (len(w) // len(q)):
        return True
    if len(w) > len(q):  # the question with parts of it said again
        joined = f" {' '.join(q)} "
        parts = [p for p in (_words(s) for s in _SENTENCE.split(a)) if p]
        return w[: len(q)] == q and all(f" {' '.join(p)} " in joined for p in parts)
    return len(w) >= 5 and f" {' '.join(w)} " in f" {' '.join(q)} "


def is_refusal(answer: str) -> bool:
    """It declines in some sentence, and what else it says gives no help: only refusals, courtesies and sentences without anything technical."""
    text = answer.replace("’", "'")
    if "```" in text:
        return False
    low = " ".join(text.lower().split())
    if not any(w in low for w in _DECLINES):
        return False
    sentences = [s for s in (x.strip() for x in _SENTENCE.split(text)) if s]
    declined = False
    for s in sentences:
        if m := _REFUSAL.search(s):
            if _CONTRAST.search(s, m.end()):
                return False
            declined = True
        elif not (_COURTESY.match(s) or (not _TECHNICAL.search(s) and len(s.split()) <= 14)):
            return False
    return declined


def _unbalanced(text: str) -> bool:
    """A bracket opens and isn't closed."""
    stack = []
    for ch in text:
        if ch in _OPEN:
            stack.append(ch)
        elif ch in _CLOSE and stack and _OPEN[_CLOSE.index(ch)] == stack[-1]:
            stack.pop()
    return bool(stack)


def _code_cut(code: str, evidence: str | None, marks: str = "") -> bool:
    """Code, quoted after a colon or fenced, that stops before its end: a proper prefix of the evidence, an open bracket or quote, an option without value, half a number.

    marks: punctuation that all statements that begin like the last line have; see statement_marks().
    """
    code = code.strip()
    if evidence and (ev := evidence.strip()):
        if code == ev or code in ev.split("\n"):
            return False
        if ev.startswith(code):
            return True
        if ev in code:
            return False
    last = code.split("\n")[-1].strip()
    if _unbalanced(code) or last.count('"') % 2 == 1 or re.search(r"(?:^|\s)-\w*$|[=(\[{,\\]$|\d\.$|^-\d*$|::$", last):
        return True
    return any(m not in last for m in marks)


def is_truncated(answer: str, evidence: str | None, marks: str = "") -> bool:
    a = answer.rstrip()
    if a.count("```") % 2:
        return True
    if a.endswith("```"):
        return False
    lines = a.split("\n")
    last = lines[-1]
    if m := _LIST_ITEM.match(last):
        body = (m["body"] or "").strip()
        if not body:
            return True
        w = _words(body)
        return body[-1] in ",;:-–" or _unbalanced(body) or bool(w and w[-1] in _DANGLING)
    # code after a line that ends in a colon
    for i in range(len(lines) - 2, -1, -1):
        if lines[i].rstrip().endswith(":") and not _LIST_ITEM.match(lines[i]) and lines[i].strip().count(" ") >= 1:
            code = "\n".join(lines[i + 1 :])
            if not re.search(r"[.!?]\s+[A-ZÄÖÜÀ-Þ¿¡]", code):
                return _code_cut(code, evidence, marks)
            break
    if m := _COMMAND.search(last):
        return False
    bare = a.rstrip(_CLOSERS + "> ")
    if not bare:
        return False
    if bare[-1] in _TERMINAL:
        if a.count('"') % 2 or a.count("“") > a.count("”") or a.count("«") > a.count("»"):
            return True
        return False
    if evidence and evidence.strip() and a.endswith(evidence.strip()):
        return False
    return True


_END = re.compile(r"(?<=[.!?。？！])\s+|\n+|(?<=[。？！])")


def asked_in(question: str) -> str | None:
    """The language of what is asked at the end, where that tells; else of the whole question, which may quote others."""
    end = _END.split(question.strip())[-1]
    return (detect(end, least=1.0) if end.rstrip("\"'»”) ").endswith(("?", "？")) else None) or detect(question, least=1.0)


def is_other_language(question: str | None, answer: str) -> bool:
    """Prose in another language than the question's, or in another script, where the question's language can't be told."""
    a = detect(answer, lead=2.5)
    if a is None or not question:
        return False
    q = asked_in(question)
    return q != a if q is not None else a not in ("en", "de", "fr", "es") and by_script(question) != a


def defects(question: str | None, answer: str | None, evidence: str | None, marks: str | None = None) -> list[str]:
    """Every defect type whose rule fires, in the order of DEFECTS. An empty answer has no other."""
    if is_empty(answer):
        return ["empty"]
    rules = (is_copy(question, answer), is_refusal(answer), is_truncated(answer, evidence, marks or ""), is_other_language(question, answer))
    return [d for d, fires in zip(DEFECTS[1:], rules, strict=True) if fires]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _defects(it: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for q, a, e, m in it:
        yield pd.Series([defects(*x) for x in zip(q, a, e, m, strict=True)], dtype=object)


#: A mark belongs to a kind of statement if so large a share of at least so many lines of it have it.
MARK_SHARE, MARK_LINES = 0.99, 20


def _head(line: Column) -> Column:
    """The word a statement begins with."""
    return F.regexp_extract(line, r"^\s*([A-Za-z_][\w:]*)", 1)


def statement_marks(texts: DataFrame, text: str) -> DataFrame:
    """(head, marks): by the first word of a line, the punctuation that lines which begin with it always have: what a statement cut short may lack.

    Learned from all quoted evidence of the table, which is whole; lines are counted inside the JVM with partial sums.
    """
    lines = texts.where(F.col(text).isNotNull()).select(F.explode(F.split(text, r"\r\n|\r|\n")).alias("line")).select(_head(F.col("line")).alias("head"), F.array_distinct(F.regexp_extract_all("line", F.lit(r"[^\w\s]"), F.lit(0))).alias("m")).where("head != ''")
    n = lines.groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") >= MARK_LINES)
    m = lines.select("head", F.explode("m").alias("mark")).groupBy("head", "mark").agg(F.count("*").alias("k"))
    return m.join(n, "head").where(F.col("k") >= MARK_SHARE * F.col("n")).groupBy("head").agg(F.concat_ws("", F.array_sort(F.collect_list("mark"))).alias("marks"))  # a head's few marks


def flag_pairs(pairs: DataFrame, id_col: str = "qa_id") -> DataFrame:
    """id, defects (array), defect (the first): one row per defective pair.

    A null or blank answer is empty; a null question can neither be copied nor have a language; a null evidence decides
    nothing. Repeated pairs are each flagged; identical rows once. Whole texts are read. Other columns don't matter.
    """
    # not deterministic to Spark: else the filter is pushed below the projection and the rules run twice
    rules = _defects.asNondeterministic()
    marks = maybe_broadcast(cut(statement_marks(pairs, "evidence_span")))
    last = F.element_at(F.split(F.regexp_replace(F.coalesce("answer", F.lit("")), r"\s+$", ""), "\n"), -1)
    p = spread(pairs.select(id_col, "question", "answer", "evidence_span")).select(F.col(id_col), "question", "answer", "evidence_span", _head(last).alias("head")).join(marks, "head", "left")
    got = p.select(F.col(id_col), rules("question", "answer", "evidence_span", "marks").alias("defects"))
    return got.where(F.size("defects") > 0).withColumn("defect", F.element_at("defects", 1))
