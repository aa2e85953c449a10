"""The language of a text by script and dictionaries of common words; refusals by phrases and the lack of a solution."""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick

#: Common words of languages in the Latin script. A word of several languages counts for each in equal parts.
_WORDS = {
    "en": "the of and to is that each we this which are with it be first hence then from by for gives so at how many what does has have into both of you your one all their my i not as its there was were can but they she he his her when where who why than now only after before other every if or an on in no more a me am do be any please ask about per will would",
    "de": "der die das und ist wir also den ein eine einer einem einen mit von sind auf wie zu noch im nicht dann dem des hat haben ich daher damit durch danach wenn jedem jeder jede für wird werden bei aus nach sich auch als oder aber kann man es er sie in an um nur mehr zuerst deshalb ergibt viele welche zum zur über bleibt bleiben",
    "es": "el los las que y por cada una un como es del para entonces luego así primero hay tiene tienen pero lo la con más se cuál cuántas cuántos otras otros este esta son está su sus al si no de en o sin sobre entre porque cuando donde también después ahora queda quedan nos le ya",
    "fr": "le les des et est une un pour du au aux dans donc puis ensuite ainsi chaque on alors combien il elle ne pas sur avec qui ce cette ces reste nous vous ils par plus sont ont de en la se son sa ses mais ou où comme que quel quelle quels d'abord nombre tout tous",
    "pt": "o os as que e por cada uma um como é do da dos das para então depois assim primeiro há tem têm mas com mais se qual quantas quantos outras outros este esta são está seu sua ao não de em no na nos nas ou sem entre porque quando também agora isso",
    "it": "il lo gli le che e per ogni una un come è del della dei delle di poi quindi così prima ha hanno ma con più si quale quanti quante altri altre questo questa sono suo sua al non da in nel nella o senza tra fra perché quando anche ora dopo la",
    "nl": "de het een en is van dat die voor met op te zijn er niet aan ook als bij dan nog wel naar om uit maar door over ze hij zij wat hoe we wordt worden heeft hebben elke eerst dus hoeveel in deze dit",
    "sv": "och att det som en på är av för med den till inte har de ett om han hon men vi så kan från var sig hur eller när nu också där bara efter alla varje först därför många",
    "da": "og at det som en på er af for med den til ikke har de et om han hun men vi så kan fra var sig hvor eller når nu også der kun efter alle hver først derfor mange",
    "pl": "i w na z do że się nie jest to jak o co po ale za od przez przy tak dla są ile każdy każda więc gdy czy tego jego jej które który która oraz najpierw zatem",
    "cs": "a v na z do že se ne je to jak o co po ale za od při tak pro jsou kolik každý každá tedy když nebo jeho její které který která nejprve proto s k",
    "tr": "ve bir bu için ile de da ne kadar çok daha olarak olan her ki gibi sonra önce kaç değil mi o ise ama en var yok şimdi",
    "id": "yang dan di ke dari ini itu untuk dengan adalah pada tidak akan oleh dalam atau juga sebagai karena berapa setiap maka kita lalu jadi ada",
    "ro": "și este în la cu de pe un o din care pentru nu se mai sunt ce câte fiecare deci apoi ca sau dar prin dacă",
    "vi": "và là của có cho không được trong một các này với để những đã như khi thì ta số mỗi bao nhiêu còn vậy",
}
_CODES = tuple(_WORDS)
_LANGS: dict[str, list[int]] = {}
for _k, _text in enumerate(_WORDS.values()):
    for _w in dict.fromkeys(_text.split()):
        _LANGS.setdefault(_w, []).append(_k)
#: The languages of each word, by number.
_OF = {w: tuple(x) for w, x in _LANGS.items()}
#: Scripts of their own, by the first and last character of their blocks.
_SCRIPTS = {
    "ja": "぀-ヿㇰ-ㇿｦ-ﾟ", "zh": "㐀-䶿一-鿿豈-﫿", "ko": "ᄀ-ᇿ가-힣", "ru": "Ѐ-ԯ", "el": "Ͱ-Ͽἀ-῿", "ar": "؀-ۿݐ-ݿ", "he": "֐-׿", "hi": "ऀ-ॿ",
    "bn": "ঀ-৿", "ta": "஀-௿", "te": "ఀ-౿", "th": "฀-๿", "km": "ក-៿", "my": "က-႟", "am": "ሀ-፿", "hy": "԰-֏", "ka": "Ⴀ-ჿ", "bo": "ༀ-࿿",
}
_SCRIPT = {k: re.compile(f"[{v}]") for k, v in _SCRIPTS.items()}
_OTHER = re.compile("[Ѐ-῿぀-鿿가-힣豈-﫿ｦ-ﾟἀ-῿]")


def _script(text: str) -> tuple[str | None, int]:
    """The language of the commonest script other than Latin, and its letters; kana make Han Japanese."""
    if text.isascii() or not (others := "".join(_OTHER.findall(text))):
        return None, 0
    n: dict[str, int] = {}
    for k, p in _SCRIPT.items():
        n[k] = len(p.findall(others))
        # kana stand beside Han
        if k == "zh" and n["ja"] >= 2 and 8 * n["ja"] >= n["zh"]:
            n["ja"] += n.pop("zh")
        if k != "ja" and max(n.values()) * 2 > len(others):
            break
    best = max(n, key=n.get)
    return (best, n[best]) if n[best] else (None, 0)


def language(text: str, words: list[str] | None = None, least: int = 3) -> str | None:
    """A language code; null if there are fewer than least common words, or no language has far the most of them.

    words: the text's, in lower case. Letters of another script decide if there are four, and twice as many as words.
    """
    words = text.lower().split() if words is None else words
    found = Counter(filter(None, map(_OF.get, words)))
    hits = sum(found.values())
    script, letters = _script(text)
    if letters >= 4 and letters >= 2 * hits:
        return script
    if hits < least:
        return None
    score = [0.0] * len(_CODES)
    for langs, k in found.items():
        share = k / len(langs)
        for x in langs:
            score[x] += share
    top = max(score)
    best = score.index(top)
    score[best] = 0.0
    return _CODES[best] if top >= 1.5 * max(score) and top >= least / 2 else None


#: Phrases by which a text declines; each alone may also stand in a solution.
REFUSALS = (
    # English
    "can't help", "cannot help", "can't assist", "cannot assist", "unable to", "not able to", "won't be able", "will not be able", "decline", "against my guidelines", "don't feel comfortable", "do not feel comfortable", "can't answer", "cannot answer", "can't provide", "cannot provide", "refuse to", "must refuse", "can't solve", "cannot solve", "can't do that", "cannot do that", "must pass", "have to pass", "i'll pass on", "would rather not", "i'd rather not", "not comfortable", "won't answer", "will not answer", "can't discuss", "cannot discuss", "can't fulfill", "cannot fulfill", "can't comply", "cannot comply", "not going to answer", "beyond what i can", "i'm sorry, but i", "i am sorry, but i",
    # German
    "nicht helfen", "nicht beantworten", "nicht möglich", "ablehnen", "nicht lösen", "verweigern", "nicht antworten", "nicht weiterhelfen", "gegen meine richtlinien", "nicht nachkommen", "lieber nicht",
    # Spanish
    "no puedo", "no me es posible", "no podré", "debo rechazar", "rechazar", "debo negarme", "me niego", "no soy capaz", "contra mis normas", "va en contra", "prefiero no",
    # French
    "ne peux pas", "ne puis", "pas en mesure", "impossible de", "refuser", "décliner", "ne pourrai pas", "pas possible", "m'est impossible", "contre mes", "préfère ne pas",
    # Portuguese, Italian, Dutch
    "não posso", "não consigo", "não é possível", "recuso", "recusar", "non posso", "non sono in grado", "devo rifiutare", "mi rifiuto", "kan niet helpen", "kan ik niet", "ik kan je niet", "ik kan u niet", "weiger", "niet in staat",
    # Swedish, Danish, Polish, Turkish
    "kan inte hjälpa", "kan inte svara", "kan ikke hjælpe", "kan ikke svare", "nie mogę", "odmawiam", "yardımcı olamam", "cevaplayamam", "yapamam",
    # Chinese, Japanese, Korean
    "无法", "不能", "拒绝", "不便", "没有办法", "恕难", "無法", "拒絕", "できません", "お答えできない", "お手伝いできない", "お断り", "할 수 없", "거절", "도와드릴 수",
    # Russian, Arabic, Hindi
    "не могу", "не смогу", "отказ", "не в состоянии", "لا أستطيع", "لا يمكنني", "أعتذر عن", "أرفض", "नहीं कर सकता", "नहीं कर सकती", "मदद नहीं", "असमर्थ",
)


def _automaton() -> ahocorasick.Automaton:
    if not _built:
        a = ahocorasick.Automaton()
        for phrase in REFUSALS:
            a.add_word(phrase, 1)
        a.make_automaton()
        _built.append(a)
    return _built[0]


#: Made once a process, by the first text.
_built: list = []


def declines(low: str) -> bool:
    """Whether a text in lower case has a phrase of the dictionary."""
    return next(_automaton().iter(low), None) is not None


NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
#: What only a solution has: an equation, a filled box, an answer that is stated with a figure, a heading of steps.
_SOLVES = re.compile(
    r"\d\s*[=≈]|=\s*[-−+$(\\{]*\s*\d|\\boxed\s*\{\s*[^\s}]|```|####|\\frac|"
    r"\b(?:answer|antwort|lösung|ergebnis|respuesta|resultado|solución|réponse|résultat|solution|resposta|risposta|antwoord|result|total)\b[^.!?\n]*\d|(?:答案|结果|答え|ответ|الجواب|उत्तर)[^。\n]*\d|"
    r"(?m:^)\s*(?:step|schritt|paso|étape|passo|第)\s*\d",
    re.I,
)


_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？।])|\n+")


def solves(text: str, known: frozenset[str] | set[str] = frozenset()) -> bool:
    """Whether a text gives a solution: it states one, or has a figure that the question (known) hasn't."""
    return bool(_SOLVES.search(text)) or bool(set(NUMBER.findall(text)) - known)


def refuses(text: str, known: frozenset[str] | set[str] = frozenset()) -> bool:
    """Declines, in a phrase of the dictionary, and gives no solution. known: the figures of the question.

    Figures in the declining sentence itself ("can't help with problem 3") are no solution.
    """
    low = text.lower().replace("’", "'")
    low = low if low.isascii() else _INVISIBLE.sub("", low)
    if not declines(low) or _SOLVES.search(low):
        return False
    return not solves(" ".join(x for x in _SENTENCE.split(low) if not declines(x)), known)
