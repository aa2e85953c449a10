"""Sentence units in any script: terminator lattices for spaced scripts, word lattices at the gaps of spaceless ones.

A text is cut into blocks at blank lines and at lines that open with a list mark or a step label. In a block every
terminator with the closing marks behind it is a node of the lattice; brackets and quotations span several nodes. A node
ends a unit unless it lies inside a span that goes on, belongs to a number or an abbreviation, or is followed by what
can only go on: a small letter, an attribution after a quotation, a quoting particle. In scripts without spaces the whole
spans before and after a gap are segmented by a lattice of words, of dictionaries of final and opening words and of the
words that the corpus itself shows; the last word before the gap and the first behind it then classify it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.spread import spread

#: Abbreviations that never end a sentence, in lower case without their last point.
NEVER = frozenset(
    "dr mr mrs ms prof st sra sr dra srta mme mlle fig figs eq eqs vol vols cf vs approx ca e.g i.e pp pág págs cap aprox bd abb bzw vgl evtl inkl zzgl env c.-à-d c.à.d ej ex z d u h a tab kap sog ggf nº см рис стр ср ок тыс т.е т.к проф акад им ул гл кн рук डॉ पृ सं श्री प्रो द ص د أ م ج chap sect sec ch ref rev gen col capt lt hon nr".split()
)
#: Abbreviations that don't end a sentence before a figure or an opening bracket.
BEFORE_FIGURE = frozenset("no nos p s t art al núm lám п с т г ст".split())
_TITLE_LINKS = frozenset("в из до от к под у за на".split())
_MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner jahrhundert klasse runde".split())
SAID = r"said|says|asked|wrote|replied|cried|called|shouted|added|answered|dijo|preguntó|respondió|exclamó|gritó|sagte|fragte|rief|schrieb|meinte|antwortete|dit|demanda|répondit|cria|écrivit|спросил|спросила|сказал|сказала|ответил|ответила|крикнул|крикнула"
_SAID = re.compile(r"(?:[^\W\d_][\w’'-]*\s+){1,3}(?:" + SAID + r")\b")
_SAID_HI = re.compile(r"[^।?!“”\n]*?(?:पूछा|कहा|बोल|लिखा|चिल्ला)")
_SAID_AR = re.compile(r"\s*[-—–]?\s*(?:سأل|قال|كتب|أجاب|صاح|هتف)")
_SAID_ZH = re.compile(r"[^。！？\n，：“”]{0,8}?(?:问|说|道|喊|答|写)(?:道)?[。，！？：]")
#: Words by which Japanese and Chinese go on after a quotation or an ellipsis.
GOES_ON = frozenset("という といっ といった と って など の を が は に も で だ から まで より 的 地 得 了 吧 吗 呢 等 等等 之类 这 那样".split())
#: Words that open a sentence; some begin with a particle, which only the longest way through the lattice tells apart.
OPENING = frozenset(
    "でも では だから ですから それで そして しかし また まず 次に つぎに したがって よって ゆえに 残り 比 平均 彼 彼女 答え 本当に 第 えっ もし はい のち がんらい とはいえ とにかく ところで ともあれ もっとも もちろん にもかかわらず "
    "然后 首先 所以 因此 接着 最后 因为 检验 每个 两边 商店 从 老师 模型 圆周率 一共 答案 但是 可是 不过 而且 于是 如果 这个 这样 这里 那么 那个 我们 他 她 它 的确 了解 等到 得到".split()
)
#: Words that close one.
FINAL = frozenset("か ね よ です ます だ である た ない でしょう ですか ました 了 吗 呢 吧 啊 元 个 分 米 人 箱".split())
_BUILT_IN = GOES_ON | OPENING | FINAL
#: A run of a script without spaces.
_RUN = re.compile("[々〆぀-ヿ㐀-鿿豈-﫿]+")
#: Letters of a learnt word at most, n-grams kept to learn them from, and how much more often than by chance they stand.
LONGEST, NGRAMS, COHESION = 4, 100_000, 8.0


class Lattice:
    """The cheapest way through a text by known words: one costs about 1, rarer ones a little more, an unknown sign 2."""

    def __init__(self, learnt: dict[str, float] | None = None):
        self.cost = dict(learnt or {}) | dict.fromkeys(_BUILT_IN, 1.0)
        self.longest = max(map(len, self.cost))

    def words(self, text: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, len(text) + 1):
            ways = [(best[e - 1][0] + 2.0, e - 1)]
            for s in range(max(0, e - self.longest), e):
                if (c := self.cost.get(text[s:e])) is not None:
                    ways.append((best[s][0] + c, s))
            best.append(min(ways))
        out, e = [], len(text)
        while e:
            s = best[e][1]
            out.append(text[s:e])
            e = s
        return out[::-1]


def words_of_counts(counts: dict[str, int]) -> dict[str, float]:
    """Words and their costs of n-gram counts: those whose parts stand together far more often than by chance.

    An n-gram that begins or ends with a word of the dictionaries would hide it, and is no word.
    """
    total = sum(n for w, n in counts.items() if len(w) == 1) or 1
    most = max(counts.values(), default=1)
    out = {}
    for w, n in counts.items():
        if len(w) < 2 or n < 3 or any(w[:k] in _BUILT_IN or w[-k:] in _BUILT_IN for k in range(1, len(w))):
            continue
        chance = max(counts.get(w[:k], n) * counts.get(w[k:], n) for k in range(1, len(w))) / total
        if n >= COHESION * chance:
            # a rarer word costs up to a fifth more
            out[w] = 1.0 + 0.2 * (1 - math.log1p(n) / math.log1p(most))
    return out


def learnt_words(docs: DataFrame, text: str = "text", most: int = NGRAMS) -> dict[str, float]:
    """Words of spaceless scripts and their costs, from counts over all documents.

    The model is bounded: of the n-grams of one to LONGEST signs the commonest most reach the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"w": list(n.keys()), "n": list(n.values())}).astype({"w": object, "n": "int64"})

        for pdf in batches:
            for t in pdf["t"]:
                if t and not t.isascii():
                    for run in _RUN.findall(t):
                        for k in range(1, LONGEST + 1):
                            n.update(run[i : i + k] for i in range(len(run) - k + 1))
            if len(n) > 500_000:
                yield rows()
                n.clear()
        yield rows()

    got = spread(docs.select(F.col(text).alias("t"))).mapInPandas(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    return words_of_counts({r[0]: r[1] for r in got.orderBy(F.desc("n"), "w").limit(most).collect()})


def gap(text: str, start: int, s: int, e: int, end: int, lattice: Lattice) -> bool | None:
    """Whether the gap between the terminator at s and what follows at e ends a unit by the words beside it, if they tell.

    The spans that are segmented are the whole runs of the script on either side.
    """
    run = _RUN.match(text, e, end)
    after = lattice.words(run.group()) if run else []
    if after and after[0] in OPENING:
        return True
    if after and after[0] in GOES_ON:
        return False
    head = text[start:s]
    runs = [m for m in _RUN.finditer(head)]
    before = lattice.words(runs[-1].group()) if runs and runs[-1].end() == len(head) else []
    return True if before and before[-1] in FINAL else None


#: Stops of Latin and wide scripts, Arabic and Urdu, Devanagari, Khmer, Burmese, Ethiopic, Armenian and Tibetan.
_TERMS = re.compile(r"[.!?…。！？؟۔।॥｡‼⁇⁈⁉។៕။።፧፨։།]+")
_WIDE = frozenset("。！？｡।॥؟۔‼⁇⁈⁉…។៕။።፧፨։།")
_CLOSE = {"”": "“„", "’": "‘", "»": "«", "«": "»", "“": "„", "」": "「", "』": "『", ")": "(", "）": "（(", "]": "[", "】": "【", "》": "《", "›": "‹"}
_OPEN = frozenset("“„«「『(（[【《‹")
_BRACKETS = re.compile(r"[“”„«»「」『』()（）\[\]【】《》\"]")
_BLANK_LINE = re.compile(r"\n[^\S\n​-‏⁠﻿­]*(?:[​-‏⁠﻿­][^\S\n]*)*\n")
_LABEL = r"(?:Step|Paso|Schritt|Étape|Etape|Шаг|चरण|Passo|الخطوة|ขั้นที่|ขั้นตอนที่|Part|Case|Remark|Claim)\s*\d+\s*[:.：)]|第\s*[\d一二三四五六七八九十]+\s*[步歩]\s*[:：.]?|(?:ステップ|手順)\s*\d+\s*[:：.]?"
_MARK = re.compile(r"[ \t　\xa0]*(?:(?P<label>" + _LABEL + r")|(?P<bullet>[-*•‣◦·▪–—])[ \t\xa0]+|(?P<number>\(?\d{1,3}[.)]|\(?[a-zA-Z]\)|[ivx]{1,4}[.)])[ \t\xa0]+)", re.I)
_WHITE = r"\s​-‏⁠﻿­"
_WHITE_SET = re.compile(f"[{_WHITE}]")
#: White space and invisible characters.
BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"
_THAI_GAP = re.compile(r"(?<=[฀-๿])[ \xa0]+(?=[฀-๿])")
_BREAK = re.compile(r"[\s(\[“”„«»\"—–/​-‏⁠﻿]")
_LETTERS = re.compile(r"[^\W\d_]+")
_SKIP = re.compile(f"[{_WHITE}*_#\"'“”„«»‘’(（\\[【「『¿¡—–-]*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_ENDS = frozenset(".!?…。！？؟۔।॥។៕။።፧፨։།:：;；")


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts between blank lines and before list marks and step labels."""
    at = 0
    for stop in [*(m.span() for m in _BLANK_LINE.finditer(text)), (len(text), len(text))]:
        if stop[0] < at:
            continue
        start, line = at, at
        before: re.Match | None = None
        while True:
            m = _MARK.match(text, line, stop[0])
            if m and line > start and _opens(text, start, line, m, before):
                yield start, line
                start = line
            before = m
            nl = text.find("\n", line, stop[0])
            if nl < 0:
                break
            line = nl + 1
        yield start, stop[0]
        at = max(at, stop[1] - 1 if stop[1] < len(text) else stop[1])


def _opens(text: str, start: int, line: int, m: re.Match, before: re.Match | None) -> bool:
    """Whether the mark at a line's head is one: a hard-wrapped line may open with a number or a minus by chance."""
    if m["label"] or (m["bullet"] and m["bullet"] in "•‣◦▪"):
        return True
    end = line - 1
    while end > start and _WHITE_SET.match(text[end]):
        end -= 1
    last = text[end]
    while last in "\"'”’»)]）」』*_`$}" and end > start:
        end -= 1
        last = text[end]
        if text[end + 1] in "$}`" :
            return True
    if last in _ENDS or not (last.isalnum() and last < "฀"):
        return not (last in ",+-*/=(")
    follows = text[m.end() : m.end() + 1]
    if m["bullet"]:
        return bool(before and before["bullet"] == m["bullet"] and not (follows.isdigit() or follows in "$\\"))
    return bool(before and before["number"])


def _spans(text: str, start: int, end: int) -> dict[int, int]:
    """close -> open of the brackets and quotations of a block."""
    stack: list[tuple[str, int]] = []
    closed: dict[int, int] = {}
    for m in _BRACKETS.finditer(text, start, end):
        c, p = m.group(), m.start()
        if c == '"':
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == '"'), None)
            if k is None:
                stack.append((c, p))
            else:
                closed[p] = stack[k][1]
                del stack[k:]
            continue
        k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in _CLOSE.get(c, "")), None)
        if k is not None and c != "«" or (k is not None and c == "«" and stack[k][0] == "»"):
            closed[p] = stack[k][1]
            del stack[k:]
        elif c in _OPEN:
            stack.append((c, p))
    return closed


def _ends(text: str, start: int, end: int, lattice: Lattice, ascii_: bool = False) -> Iterator[int]:
    """Ends (exclusive) of the units of a block, but for its last."""
    first = next(_TERMS.finditer(text, start, end), None)
    thai = [m.start() for m in _THAI_GAP.finditer(text, start, end)] if not ascii_ else []
    if first is None and not thai:
        return
    closed = _spans(text, start, end)
    outer: list[tuple[int, int]] = []
    for o, c in sorted((o, c) for c, o in closed.items()):
        if not outer or o > outer[-1][1]:
            outer.append((o, c))
    first_of = [o for o, _ in outer]

    def inside(p: int, e: int) -> bool:
        """Whether a bracket or quotation that opened before p closes at e or later."""
        k = bisect_left(first_of, p) - 1
        return k >= 0 and outer[k][1] >= e

    unit = start
    thai_at = 0
    mark = _MARK.match(text, start, end)
    mark_end = mark.end() if mark else start
    for m in _TERMS.finditer(text, start, end):
        s, e = m.span()
        while thai_at < len(thai) and thai[thai_at] < s:
            if not inside(thai[thai_at], thai[thai_at] + 1):
                yield thai[thai_at]
                unit = thai[thai_at]
            thai_at += 1
        if s < mark_end:
            continue
        run = m.group()
        # closing marks, a blank before a guillemet included
        opened = None
        while e < end:
            c = text[e]
            if e in closed:
                opened = closed[e] if opened is None else opened
                e += 1
            elif c in " \xa0 " and e + 1 < end and text[e + 1] == "»" and e + 1 in closed:
                opened = closed[e + 1] if opened is None else opened
                e += 2
            elif c in "’'*_" and not (e + 1 < end and text[e + 1].isalnum()):
                e += 1
            else:
                break
        if inside(s, e):
            continue
        if e >= end:
            break
        follows = text[e]
        wide = run[-1] in _WIDE
        blank = bool(_WHITE_SET.match(follows))
        if not blank:
            if not (wide or (run[-1] in "!?" and _CJK.match(follows)) or (opened is not None and _CJK.match(follows))):
                continue
            if run[-1] == "…" and not (_CJK.match(follows) or follows in "“「『（(【"):
                continue
        k = _SKIP.match(text, e, end).end()
        if k >= end:
            nxt = ""
            if not text[e:end].strip():
                break
        else:
            nxt = text[k]
        if nxt in ",;:，、；：" and nxt:
            continue
        if nxt.islower() and not (opened is None and run == "." and blank and _plain(text, unit, s)):
            continue
        if opened is None and run == "." and _short(text, unit, s, nxt, k, end):
            continue
        if opened is None and run == "." and "ऀ" <= text[s - 1 : s] <= "ॿ":
            continue
        if opened is not None and text[opened] not in "(（[【":
            framed = text[max(unit, mark_end) : opened].strip(" \t\n\xa0-—–*_​")
            if not framed and run[-1] in "!?！？؟…" and _attributed(text, k, end, nxt):
                continue
            if not blank and (text[opened] in "「『" or "぀" <= text[e] <= "ヿ") and gap(text, unit, s, e, end, lattice) is False:
                continue
        elif run[-1] in "…！？" and not blank and _CJK.match(text[e]):
            # a strong stop ends a unit unless the words go on, an ellipsis only if a final or an opening word says so
            verdict = gap(text, unit, s, e, end, lattice)
            if verdict is False or (run[-1] == "…" and not verdict):
                continue
        yield e
        unit = e
    for p in thai[thai_at:]:
        if not inside(p, p + 1):
            yield p


def _word_before(text: str, unit: int, s: int) -> str:
    """The word that ends at s, within the unit."""
    at = s
    while at > unit and not _BREAK.match(text[at - 1]):
        at -= 1
    return text[at:s]


def _short(text: str, unit: int, s: int, nxt: str, k: int, end: int) -> bool:
    """Whether the point at s belongs to an abbreviation, an initial or an ordinal."""
    word = _word_before(text, unit, s)
    low = word.lower()
    if not low:
        return False
    if low in NEVER:
        return True
    if len(word) == 1 and word.isalpha() and (word.isupper() or low in BEFORE_FIGURE or "؀" <= word <= "ۿ"):
        if word.isupper() or not nxt.isupper():
            return True
    if low in BEFORE_FIGURE and (nxt.isdigit() or text[s + 1 : s + 3].strip()[:1] == "("):
        return True
    if low == "г" or low == "гг":
        return _word_before(text, unit, s - len(word) - len(text[unit : s - len(word)]) + len(text[unit : s - len(word)].rstrip())).lower() in _TITLE_LINKS
    if low.isdigit() and len(low) <= 2 and nxt.isupper():
        m = _LETTERS.match(text, k, end)
        return bool(m) and m.group().lower() in _MONTHS
    return False


#: Abbreviations of four letters and more that may stand before a small letter.
LONG = frozenset("approx aprox incl dept misc temp resp bzgl usw spec fasc prov trad pags págs evtl inkl sogen zzgl тыс млн млрд напр след".split())
_PLAIN = re.compile(r"[^\W\d_]{4,}\Z")


def _plain(text: str, unit: int, s: int) -> bool:
    """Whether the word before the point at s is a plain one, so that even a small letter opens a sentence."""
    word = _word_before(text, unit, s)
    return bool(_PLAIN.match(word)) and word.lower() not in LONG and word.lower() not in NEVER


def _attributed(text: str, k: int, end: int, nxt: str) -> bool:
    """Whether a quotation that opens a unit goes on with who said it."""
    if "ऀ" <= nxt <= "ॿ":
        return bool(_SAID_HI.match(text, k, end))
    if "؀" <= nxt <= "ۿ":
        return bool(_SAID_AR.match(text, k, end))
    if _CJK.match(nxt or " "):
        return bool(_SAID_ZH.match(text, k, end)) or text.startswith(("と", "って"), k, end)
    return bool(_SAID.match(text, k, end))


#: The lattice of the dictionaries alone.
PLAIN = Lattice()


def unit_ends(text: str, lattice: Lattice = PLAIN) -> list[tuple[int, int]]:
    """(start, end) of each unit: code points before its first and up to its last character that isn't white space."""
    out = []
    ascii_ = text.isascii()
    for start, end in _blocks(text):
        at = start
        for e in [*_ends(text, start, end, lattice, ascii_), end]:
            kept = text[at:e].rstrip(BLANK)
            if kept:
                out.append((at + len(kept) - len(kept.lstrip(BLANK)), at + len(kept)))
            at = e
    return out


def sentence_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, unit (from 0), start_pos, end_pos, sentence of each unit of each text, in order.

    Words of scripts without spaces are learnt from all documents first. Positions count code points. Null, empty and blank texts have no units. A text is one task's row whatever its
    length; repeated rows are each cut. Extra columns are ignored.
    """

    learnt = learnt_words(docs, text)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(learnt)
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"]):
                if t:
                    out += [(k, n, s, e, t[s:e]) for n, (s, e) in enumerate(unit_ends(t, lattice))]
            yield pd.DataFrame(out, columns=["k", "unit", "start_pos", "end_pos", "sentence"])

    kind = dict(docs.dtypes)[key]
    got = spread(docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))).mapInPandas(cut, "k string, unit int, start_pos bigint, end_pos bigint, sentence string")
    return got.select(F.col("k").cast(kind).alias(key), "unit", "start_pos", "end_pos", "sentence")
