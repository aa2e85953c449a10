"""Text ends: closed structures, and a backward character n-gram model of ends against continuations.

The model counts, for the contexts of ORDERS characters that end some value, how often they are the end of a value and
how often a value goes on after them, over all values. The structure that is open at a place (JSON object, reasoning
block, code block, formula) is a sign of its context, nearer than any character. Counts are kept by hash; digits count
as one sign and runs of white space as one blank or line end. Longer contexts are interpolated with shorter ones, and a value's own end is
taken off the counts before its log-odds are compared with the threshold of its language and column. Contexts are
known by a hash of 63 bits, whatever the size of the table; a task holds the counts of at most 2**BITS an order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np

ORDERS = (2, 4, 7, 10)
#: The counts of an order with more than 2**BITS different end contexts stay in written tables and are joined.
BITS = 22
#: Such an order has a bitmap of 2**FILTER_BITS bits, and continuations are sent on after so many places.
FILTER_BITS, HELD = 27, 1 << 20
#: Weight of the next shorter context, in observations.
BACKOFF = 2.0
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BLANKS = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x202F, 0x3000, *range(0x2000, 0x200B)], np.uint32)
_GONE = np.array([*range(0x200B, 0x2010), 0x2060, 0xFEFF, 0xAD], np.uint32)


#: Structures that a text can be in. Their numbers, from 1, are signs of the context.
STRUCTURES = ("json", "think", "code", "formula")
_TAG = re.compile(r"<(/?)(think|answer|reasoning|thought|scratchpad)>", re.I)
_OBJECT = re.compile(r"\s*\{(?!\\)")


def structures(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number) of the places at which a structure is open, inner ones later."""
    if _OBJECT.match(text):
        return [(0, len(text) - 1, 1)]
    out: list[tuple[int, int, int]] = []
    for mark, number in (("$", 4), ("```", 3)):
        at = text.find(mark)
        while at >= 0:
            close = text.find(mark, at + len(mark))
            out.append((at, len(text) if close < 0 else close + len(mark) - 1, number))
            at = text.find(mark, close + len(mark)) if close >= 0 else -1
    if "<" in text:
        depth, start = 0, 0
        for m in _TAG.finditer(text):
            if m[1]:
                depth = max(0, depth - 1)
                if not depth:
                    out.append((start, m.end() - 1, 2))
            else:
                start = start if depth else m.start()
                depth += 1
        if depth:
            out.append((start, len(text), 2))
    return out


def _signs(texts: list[str], codes: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each closed by a 0, and the structure at each; digit and blank runs are one sign each.

    codes: the structure of each whole text, if they are tails.
    """
    low = [t.lower() for t in texts]
    raw = np.frombuffer(("\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(raw), np.uint8)
    at = 0
    for k, t in enumerate(low):
        if codes is not None:
            inside[at : at + len(t)] = codes[k]
        elif "$" in t or "<" in t or "```" in t or "{" in t[:1] or t[:1].isspace():
            for start, end, number in structures(t):
                inside[at + start : at + end] = number
        at += len(t) + 1
    high = raw > 126
    if high.any():
        keep = np.ones(len(raw), bool)
        keep[high] = ~np.isin(raw[high], _GONE)
        raw, inside = raw[keep], inside[keep]
    raw = raw.copy()
    raw[(raw >= 48) & (raw <= 57)] = 48
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    high = raw > 126
    if high.any():
        blank[high] = np.isin(raw[high], _BLANKS)
    raw[blank & (raw != 10)] = 32
    starts = np.ones(len(raw), bool)
    starts[1:] = ~((blank[1:] & blank[:-1]) | ((raw[1:] == 48) & (raw[:-1] == 48)))
    at = np.flatnonzero(starts)
    return (np.minimum.reduceat(raw, at), inside[at]) if len(at) else (raw, inside)


_RUNS = re.compile(r"\d+|\s+")


def tail(text: str, n: int) -> str:
    """The end of the first n characters of a text, with all signs that a context can hold."""
    size = 96
    while size < n and len(_RUNS.sub("0", text[n - size : n])) < 2 * max(ORDERS):
        size *= 2
    return text[max(0, n - size) : n]


def _mix(h: np.ndarray, sign: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (sign + np.uint64(k * 0x10000000))) * _MUL
    h ^= h >> np.uint64(29)
    return h


class Wanted:
    """The end contexts of an order as sorted keys (hashes, or what is left of them after a shift), looked up in bulk."""

    def __init__(self, keys: np.ndarray, shift: int = 0):
        self.keys, self.shift = np.asarray(keys, np.int64), shift
        self.tables: list[np.ndarray] = []
        left = np.arange(len(self.keys))
        while len(left):
            # keys that share a slot go to further tables
            table = np.full(1 << BITS, -1, np.int32)
            slot = self._slot(self.keys[left])
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return keys >> max(0, 63 - BITS - self.shift)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The position of each hash among the keys, -1 for none."""
        keys = hashes >> self.shift
        out = np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        for table in self.tables:
            at = table[slot]
            hit = at >= 0
            hit[hit] = self.keys[at[hit]] == keys[hit]
            out[hit] = at[hit]
        return out


class Perhaps:
    """End contexts of an order that are too many to hold: a bitmap of the first bits of their hashes.

    It lets every end context through and some others; those fall out in the join by whole hashes.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """0 for each hash that may be an end context, -1 for one that is none."""
        place = hashes >> (63 - FILTER_BITS)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(np.int8) - 1


def _contexts(signs: np.ndarray, inside: np.ndarray, at: np.ndarray, keep: list[Wanted | Perhaps] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(order, hashes) of the contexts that end at the given places; beyond the start of a text every sign is 0.

    keep: positions among the wanted contexts then stand for hashes, but for Perhaps. A place that isn't wanted is left
    out from then on, since a longer context is wanted only where all shorter ones are.
    """
    wide = np.concatenate([np.zeros(max(ORDERS), np.uint64), signs.astype(np.uint64)])
    h, here = inside[at].astype(np.uint64) * _MUL, np.ones(len(at), np.uint64)
    at = at + max(ORDERS)
    for k in range(max(ORDERS)):
        sign = wide[at - k] * here
        here = (sign != 0).astype(np.uint64)
        h = _mix(h, sign, k)
        if k + 1 in ORDERS:
            b = (h >> np.uint64(1)).astype(np.int64)
            if keep is not None:
                among = keep[ORDERS.index(k + 1)]
                found = among.find(b)
                wanted = found >= 0
                b = b if isinstance(among, Perhaps) else found
                at, h, here, b = at[wanted], h[wanted], here[wanted], b[wanted]
            yield k + 1, b


def end_contexts(tails: list[str], codes: list[int] | None = None) -> np.ndarray:
    """One row of hashes for each tail (the last characters of a value, without blanks at the end) and open structure."""
    if not tails:
        return np.zeros((0, len(ORDERS)), np.int64)
    signs, inside = _signs(tails, codes or [0] * len(tails))
    return np.stack([b for _, b in _contexts(signs, inside, np.flatnonzero(signs == 0) - 1)], axis=1)


def continuations(batches: Iterator[list[str]], wanted: list[Wanted | Perhaps]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, keys, counts): how often texts go on after the wanted contexts; of order 0, in each structure.

    The keys of Perhaps are whole hashes; they may come several times, and some belong to no end.
    """
    counts = {k: np.zeros(len(w.keys), np.int64) for k, w in zip(ORDERS, wanted) if isinstance(w, Wanted)}
    held: dict[int, list[np.ndarray]] = {k: [] for k in ORDERS if k not in counts}
    within = np.zeros(len(STRUCTURES) + 1, np.int64)
    for texts in batches:
        signs, inside = _signs(texts)
        places = np.flatnonzero((signs[:-1] != 0) & (signs[1:] != 0))
        within += np.bincount(inside[places], minlength=len(within))
        for k, b in _contexts(signs, inside, places, wanted):
            if k in counts:
                counts[k] += np.bincount(b, minlength=len(counts[k]))
                continue
            held[k].append(b)
            if sum(map(len, held[k])) >= HELD:
                yield k, *np.unique(np.concatenate(held[k]), return_counts=True)
                held[k] = []
    yield 0, np.arange(len(within)), within
    for order, w in zip(ORDERS, wanted):
        if order in counts:
            n = counts[order]
            yield order, w.keys[n > 0], n[n > 0]
        elif held[order]:
            yield order, *np.unique(np.concatenate(held[order]), return_counts=True)


def log_odds(counts: Iterable[tuple[np.ndarray, np.ndarray]], prior: np.ndarray) -> np.ndarray:
    """Log-odds of an end against a continuation; counts: of ends and continuations in the context of each order.

    prior: the share of ends in the structure that each text ends in.
    """
    p = prior
    for ends, goes in counts:
        # a value's own end is taken off
        e = np.maximum(ends - 1, 0)
        p = (e + BACKOFF * p) / (e + goes + BACKOFF)
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


_EDGE = re.compile(r"[\s​-‏⁠﻿­\x85\xa0]+\Z")
_MARK = re.compile(r"(?:…|\.\.\.|�|\\u[0-9a-f]{0,3})\Z", re.I)
_NOTE = re.compile(r"\s*(?:cut|truncated|output truncated|continued|snip|trimmed|abgeschnitten|cortado|tronqué)", re.I)
_NOTES = {"]": "[", ")": "(", ">": "<"}
_CHAT_END = re.compile(r"(?:<\|[a-z_]+\|>|</s>)\Z", re.I)
_STOP = ".!?。！？؟।"
_CLOSERS = "\"'”’»)」』】）*_"


def bare(text: str) -> str:
    """text without blanks and chat marks at its end."""
    while True:
        text = _EDGE.sub("", text) if text and (text[-1].isspace() or text[-1] in "​‌‍‎‏⁠﻿­") else text
        if text.endswith((">",)) and (m := _CHAT_END.search(text)):
            text = text[: m.start()]
            continue
        return text


def _json_open(text: str) -> bool:
    try:
        json.loads(text, strict=False)
        return False
    except ValueError:
        pass
    # case changed or restyled: count brackets outside strings
    depth, inside, skip = 0, False, False
    for c in text:
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            inside = not inside
        elif not inside:
            depth += (c in "{[") - (c in "}]")
    return inside or depth > 0 or not text.endswith("}")


def _mark(text: str) -> int:
    """Where a mark begins that a cut has left at the end of a text, -1 for none."""
    if (opener := _NOTES.get(text[-1])) and (at := text.rfind(opener)) >= 0:
        note = text[at + 1 : -1]
        return at if _NOTE.match(note) and "\n" not in note else -1
    # a mark of signs has six at most
    m = _MARK.search(text, max(0, len(text) - 6))
    return m.start() if m else -1


def state(text: str) -> tuple[str, int, int]:
    """(state, length, structure) for a text that bare() returned and that isn't empty.

    state: mark (a mark left by a cut), one of STRUCTURES that is open at the end, whole (the text ends in a sentence
    stop or closes a structure) or open. length: of the text without the mark. structure: the number of the open one, or 0.
    """
    if (at := _mark(text)) >= 0:
        n = len(bare(text[:at]))
        return "mark", n, next((k for s, e, k in reversed(structures(text[:n])) if e >= n - 1), 0)
    n = len(text)
    if _OBJECT.match(text):
        cut = _json_open(text.strip())
        return ("json", n, 1) if cut else ("whole", n, 0)
    within = max((k for s, e, k in structures(text) if e == n), key=(4, 3, 2).index, default=0)
    if within == 4 and text[-1] in _STOP:
        within = 0
    if within:
        return STRUCTURES[within - 1], n, within
    end = text.rstrip(_CLOSERS)
    last = end[-1:]
    if text.endswith(("\\)", "\\]", "```")) or (last and last in _STOP and not (last == "." and end[-2:-1].isdigit())):
        return "whole", n, 0
    return "open", n, 0
