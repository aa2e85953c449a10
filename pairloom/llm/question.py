"""The question inside a prompt: template marks, request lines and contest credits taken off, words and numbers split."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: The texts that chat and task templates put before and after a question.
HEADS = (
    r"Solve the following problem carefully\.",
    r"Below is a task that describes a problem\.\s+Write a response that completes it\.",
    r"<\|im_start\|>\s*system\b.*?<\|im_end\|>",
    r"<\|system\|>.*?(?=<\|user\|>)",
    r"<\|im_start\|>\s*user",
    r"<\|user\|>",
    r"<s>",
    r"\[INST\]",
    r"###\s*Instruction:",
    r"Problem:",
    r"Question:",
    r"Human:",
    r"User:",
)
TAILS = (
    r"Give the final answer after [\"“”]?The answer is:?[\"“”]?:?\.?",
    r"###\s*Response:",
    r"Let['’]s think step by step\.?",
    r"<\|im_start\|>\s*assistant",
    r"<\|im_end\|>",
    r"\[/INST\]",
    r"<\|assistant\|>",
    r"Solution:",
    r"Answer:",
    r"Assistant:",
)
#: Names of the languages as requests spell them.
LANGUAGE_NAMES = {
    "en": ("english", "inglés", "englisch", "anglais", "英语", "英文"),
    "de": ("german", "alemán", "deutsch", "allemand", "德语", "德文"),
    "es": ("spanish", "español", "spanisch", "espagnol", "西班牙语", "西班牙文"),
    "fr": ("french", "francés", "französisch", "français", "法语", "法文"),
    "zh": ("chinese", "chino", "chinesisch", "chinois", "中文", "汉语"),
}
_SPACE = r"[\s​-‏⁠﻿­]*"
_NAMES = "|".join(sorted((re.escape(x) for v in LANGUAGE_NAMES.values() for x in v), key=len, reverse=True))
REQUEST = (
    r"(?:please\s+)?(?:answer|respond|reply|write|solve it)\s+(?:only\s+)?in\s+(?:%s)\b\s*[.!]?"
    r"|(?:por\s+favor,?\s+)?(?:responde|contesta)\s+en\s+(?:%s)\b\s*[.!]?"
    r"|(?:bitte\s+)?(?:antworte|antworten\s+sie)\s+(?:bitte\s+)?auf\s+(?:%s)\b\s*[.!]?"
    r"|(?:merci\s+de\s+répondre|réponds|répondez|veuillez\s+répondre)\s+en\s+(?:%s)\b\s*[.!]?"
    r"|请?用(?:%s)(?:回答|作答|解答)[。！]?"
) % ((_NAMES,) * 5)
_HEAD = re.compile(_SPACE + "(?:" + "|".join(HEADS).replace(" ", r"\s+") + ")", re.I | re.S)
_TAIL = re.compile("(?:" + "|".join(TAILS).replace(" ", r"\s+") + ")" + _SPACE + r"\Z", re.I)
_REQUEST_HEAD = re.compile(_SPACE + "(?:" + REQUEST + ")", re.I)
_REQUEST_TAIL = re.compile("(?:" + REQUEST + ")" + _SPACE + r"\Z", re.I)
_ANY_REQUEST = re.compile(REQUEST, re.I)
_NAME = re.compile(_NAMES, re.I)
_NAME_OF = {x: k for k, v in LANGUAGE_NAMES.items() for x in v}
_INVISIBLE = re.compile(r"[​-‏⁠﻿­]")
_EDGE = " \t\r\n   　"


def _may_ask(text: str) -> bool:
    low = text.lower()
    for name in _NAME_OF:
        if name in low:
            return True
    return False


def strip_template(prompt: str) -> str:
    """The prompt without chat marks, system text, fixed instructions and language requests; a null is ''."""
    text = prompt or ""
    text = (text if text.isascii() else _INVISIBLE.sub("", text)).strip(_EDGE)
    # a request may come to an end only when a template is off
    asks = _may_ask(text)
    while True:
        if (m := _HEAD.match(text)) or asks and (m := _REQUEST_HEAD.match(text)):
            text = text[m.end() :].strip(_EDGE)
            continue
        # fixed tails and requests have at most 70 signs, but any amount of white space between them
        low = text[-80:]
        if len(text) > 80 and len("".join(low.split())) < 60:
            low = text
        # every tail ends in one of these signs or names a step or an answer
        last = low.lower()
        ends = last[-1:] in ":>]" or "step" in last or "answer" in last or "assistant" in last
        if ends and (m := _TAIL.search(low)) or asks and (m := _REQUEST_TAIL.search(low)):
            text = text[: len(text) - len(low) + m.start()].strip(_EDGE)
            continue
        return text


def requested_language(prompt: str) -> str | None:
    """The language that a prompt asks the answer to be in."""
    m = _ANY_REQUEST.search(prompt) if prompt and _may_ask(prompt) else None
    name = m and _NAME.search(m.group())
    return _NAME_OF.get(name.group().lower()) if name else None


_YEAR, _NUMBER = r"[’'‘]?\s*(\d{4}|\d{2})(?!\d)", r"(?:#|Problem|P|Question|Q|no\.?)?\s*(\d{1,3})(?!\d)"
_CREDIT_NAME, _SEP = r"([^\W\d_][^\[\]()\d#’'‘,/—–]+?)", r"[\s,/\-–]*"
_FORMS = (
    r"[\[(]?\s*from\s+the\s+" + _YEAR + r"\s+" + _CREDIT_NAME + _SEP + _NUMBER + r"\s*[\])]?",
    r"(?:[\[(]|[—–]|Source\s*:)\s*" + _CREDIT_NAME + _SEP + _YEAR + _SEP + _NUMBER + r"\s*[\])]?\s*\.?",
)
_CREDIT_HEADS = tuple(re.compile(_SPACE + x, re.I) for x in _FORMS)
_CREDIT_TAILS = tuple(re.compile(x + r"[\s.]*\Z", re.I) for x in _FORMS)


def credit_parts(question: str) -> list[tuple[str, str, str]]:
    """(rest of the question, name, year:number) of each text at either end that has the form of a contest credit.

    A name is in lower case with single blanks; a year of two digits is of 1960 to 2059. The nearest form comes first.
    """
    found: list[tuple[int, re.Match, str]] = []
    # a credit at the end ends in its problem's number
    if question.rstrip(" \t\r\n\x0b\x0c.])")[-1:].isdigit():
        found += [(k, m, question[: m.start()]) for k, pattern in enumerate(_CREDIT_TAILS) for m in pattern.finditer(question)]
    found += [(k, m, question[m.end() :]) for k, pattern in enumerate(_CREDIT_HEADS) if (m := pattern.match(question))]
    out = []
    for k, m, rest in found:
        year, name, number = m.groups() if k == 0 else (m[2], m[1], m[3])
        y = int(year)
        y += 0 if len(year) == 4 else 1900 if y >= 60 else 2000
        out.append((rest.strip(_EDGE), " ".join(name.lower().strip(" ,.-").split()), f"{y}:{int(number)}"))
    return out


def credit_of(contest: Column, problem: Column) -> Column:
    """contest:year:number."""
    return F.concat(contest.cast("string"), F.lit(":"), problem)


#: Numbers keep an inner point or comma; letters of scripts without spaces stand alone; other letters form runs.
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[฀-๿぀-ヿ㐀-鿿豈-﫿]|[^\W\d_]+")


_GROUPED = re.compile(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?\Z")


def tokens(question: str) -> list[str]:
    """Words and numbers in lower case; commas between thousands are no part of a number."""
    found = TOKEN.findall(question.lower())
    return [w.replace(",", "") if "," in w and _GROUPED.match(w) else w for w in found]


def is_number(token: str) -> bool:
    return token[0].isdigit()
