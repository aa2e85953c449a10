"""Held-out items inside a corpus: prefix-filtered set join with exact verification over item-sized windows.

A document holds an item if it has RUN consecutive words of it, or a passage with all its numbers in order and at least
SHARE of its words in order. Shingles and words are ordered by their rarity in the corpus. Of every window of RUN words
the rarest shingle is necessary; of a passage one of the rarest words is, as many as make up for the words that it may
lack, near the item's rarest number. These prefix tokens of both sides are joined, and exact checks follow around the
places where they meet. Documents and items are both tables: what reaches a task is a bitmap of the prefix tokens, which
keeps other documents out of the join.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.lineage import materialise
from ..plans.spread import spread
from .rarity import SKETCH, among, bitmap, word_hash, word_rarity

RUN, SHARE = 13, 0.75
#: Words of a shingle.
SHINGLE = 5
#: Prefix tokens that a passage must have together, where the item has words enough.
TOGETHER = 3
#: Pairs of a number and a word near it that are tested at once.
PAIRS = 1 << 20
#: The prefix tokens of all items are sent to the tasks as a bitmap of at most 2**FILTER_BITS bits.
FILTER_BITS = 27
_WORD = re.compile(r"[^\W_]+")
_M, _B = (1 << 64) - 1, 0x9E3779B97F4A7C15
#: Salts that keep the kinds of prefix tokens apart.
_SHINGLES, _NUMBERS, _WORDS, _NEAR, _LONE = (0x51ED270B * (k + 1) for k in range(5))


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def need(n: int, share: float = SHARE) -> int:
    """Words in order that a passage must have of an item of n words."""
    return math.ceil(share * n - 1e-9)


def reach(size: int, share: float = SHARE) -> int:
    """How far a passage of an item of 2**size words at most goes to either side of one of its words."""
    return int((1 << size) / share) + 2 * (1 << size) + 16


def _mix(*parts):
    """A 64-bit hash of integers, the same for numbers and arrays of uint64."""
    h = parts[0]
    for x in parts[1:]:
        h = ((h ^ x) * _B & _M) if isinstance(h, int) and isinstance(x, int) else (h ^ x) * np.uint64(_B)
        h = h ^ (h >> (29 if isinstance(h, int) else np.uint64(29)))
    return h


def prefix_tokens(item: list[str], often: np.ndarray, run: int = RUN, share: float = SHARE) -> tuple[int, list[tuple[int, str, int]]]:
    """The item's class and (token, kind, position in the item) that a document can't do without if it holds the item.

    kind: run and passage tokens are joined; number and word tokens only let a document's words be tested in pairs. The
    class is 4 * size + together: a passage has at least together of the passage tokens, near one number.
    """
    hashes = [word_hash(w) for w in item]
    rare = [int(often[h >> 64 - SKETCH]) for h in hashes]
    out, n = [], len(item)
    width = min(SHINGLE, run)
    shingles = []
    for s in range(n - width + 1):
        h = 0
        for x in hashes[s : s + width]:
            h = (h * _B + x) & _M
        shingles.append((min(rare[s : s + width]), h, s))
    chosen = {min(shingles[s : s + run - width + 1]) for s in range(n - run + 1)}
    out += [(_mix(h, _SHINGLES), "run", s) for _, h, s in chosen]
    order = sorted(range(n), key=lambda i: (rare[i], hashes[i], i))
    numbers = [i for i in order if item[i].isdigit()]
    others = list(dict.fromkeys(hashes[i] for i in order if not item[i].isdigit()))
    # a passage may lack so many words, hence at most so many different ones
    lack = n - need(n, share)
    together = max(0, min(TOGETHER, len(others) - lack)) if numbers else 0
    kind = 4 * n.bit_length() + together
    if together:
        at = numbers[0]
        near = others[: lack + together]
        out += [(_mix(hashes[at], _NEAR, h, kind), "passage", at) for h in near]
        out += [(_mix(h, _WORDS), "word", at) for h in near]
        out.append((_mix(hashes[at], _NUMBERS), "number", at))
    elif numbers:
        out.append((_mix(hashes[numbers[0]], _LONE, kind), "passage", numbers[0]))
    else:
        out += [(_mix(h, _LONE, kind), "passage", 0) for h in others[: lack + 1]]
    return kind, list(set(out))


class Scan:
    """Finds the places of documents' words where prefix tokens may stand, a batch of documents at a time."""

    def __init__(self, bits: np.ndarray, kinds: list[int], run: int = RUN):
        self.bits, self.kinds, self.width = bits, kinds, min(SHINGLE, run)
        self.known: dict[str, int] = {}

    def hits(self, docs: list[list[str]]) -> list[list[tuple[int, int]]]:
        """(token, position) of each document, with some that are no tokens."""
        flat = [w for ws in docs for w in ws]
        for w in set(flat).difference(self.known):
            self.known[w] = word_hash(w)
        h = np.fromiter(map(self.known.__getitem__, flat), np.uint64, len(flat))
        if len(self.known) > 200_000:
            self.known.clear()
        lens = np.array([len(ws) for ws in docs], np.int64)
        ends = np.cumsum(lens)
        doc = np.repeat(np.arange(len(docs)), lens)
        out: list[list[tuple[int, int]]] = [[] for _ in docs]

        def keep(tokens: np.ndarray, at: np.ndarray) -> None:
            ok = among(self.bits, tokens)
            for t, p in zip(tokens[ok].tolist(), at[ok].tolist()):
                d = doc[p]
                out[d].append((t, p - int(ends[d] - lens[d])))

        n = len(h) - self.width + 1
        if n > 0:
            gram = np.zeros(n, np.uint64)
            for k in range(self.width):
                gram = gram * np.uint64(_B) + h[k : k + n]
            inner = np.flatnonzero(doc[:n] == doc[self.width - 1 :])
            keep(_mix(gram[inner], np.uint64(_SHINGLES)), inner)
        every = np.arange(len(h))
        for kind in self.kinds:
            if not kind % 4:
                keep(_mix(h, np.uint64(_LONE), np.uint64(kind)), every)
        near = np.flatnonzero(among(self.bits, _mix(h, np.uint64(_WORDS))))
        numbers = np.flatnonzero(among(self.bits, _mix(h, np.uint64(_NUMBERS))))
        if not len(near) or not len(numbers):
            return out
        first, last = (ends - lens)[doc[numbers]], ends[doc[numbers]] - 1
        for kind in self.kinds:
            if not kind % 4:
                continue
            far = reach(kind // 4)
            begin = np.searchsorted(near, np.maximum(first, numbers - far))
            n_near = np.searchsorted(near, np.minimum(last, numbers + far), "right") - begin
            # as many numbers at once as have PAIRS words near them
            cuts = np.flatnonzero(np.diff(np.cumsum(n_near) // PAIRS)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)]):
                k = n_near[s:e]
                of = np.repeat(np.arange(s, e), k)
                at = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[s:e], k)
                tokens = _mix(h[numbers[of]], np.uint64(_NEAR), h[near[at]], np.uint64(kind))
                ok = among(self.bits, tokens)
                of, tokens = of[ok], tokens[ok]
                by = np.lexsort((tokens, of))
                of, tokens = of[by], tokens[by]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (tokens[1:] != tokens[:-1])
                of, tokens = of[new], tokens[new]
                enough = np.bincount(of, minlength=e)[of] >= kind % 4
                keep(tokens[enough], numbers[of[enough]])
        return out


def holds_run(ws: list[str], p: int, item: list[str], q: int, run: int = RUN) -> bool:
    """Whether the words around p and around q of the item agree over run words."""
    l = 0
    while l < p and l < q and l < run and ws[p - l - 1] == item[q - l - 1]:
        l += 1
    r = 0
    while p + r < len(ws) and q + r < len(item) and l + r < run and ws[p + r] == item[q + r]:
        r += 1
    return l + r >= run


def holds_passage(ws: list[str], item: list[str], share: float = SHARE) -> bool:
    """Whether some window of the words has all the item's numbers in order and share of its words in order."""
    numbers = [w for w in item if w.isdigit()]
    least, size = need(len(item), share), len(item)
    wide = int(size / share) + 1
    if not numbers:
        own = set(item)
        return any(_common(item, ws[s : s + wide]) >= least for s in range(0, max(1, len(ws) - least + 1)) if ws[s] in own)
    before = item.index(numbers[0])
    for s, w in enumerate(ws):
        if w != numbers[0]:
            continue
        e, k = s, 1
        while k < len(numbers) and e - s < wide:
            e += 1
            if e >= len(ws):
                break
            if ws[e] == numbers[k]:
                k += 1
        if k == len(numbers):
            if _common(item, ws[max(0, s - 2 * before - 4) : max(e + 1, s - before + wide + 4)]) >= least:
                return True
    return False


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = defaultdict(int)
    for k, w in enumerate(a):
        where[w] |= 1 << k
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = v & where.get(w, 0)
        v = (v + m | v - m) & full
    return len(a) - v.bit_count()


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", question: str = "question", salts: int = 8) -> DataFrame:
    """doc_key, item_key, run, passage for each document that holds an item.

    run: RUN consecutive words of the item; passage: all its numbers in order and SHARE of its words in order. Words
    are runs of letters and digits without regard to case. Null and empty texts and questions hold and are held by
    nothing; a question of fewer than RUN words is found as a passage only. Rows that repeat key and text count as one,
    as do items of equal key and question. Extra columns are ignored.
    """
    texts = docs.select(F.col(doc_key).cast("string").alias("k"), F.col(text).alias("t")).where("t is not null")
    asked = items.select(F.col(item_key).cast("string").alias("i"), F.col(question).alias("q")).where("i is not null and q is not null").distinct()
    often = word_rarity(texts.select("t"), words)

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, q in zip(pdf["i"], pdf["q"]):
                ws = words(q)
                if ws:
                    group, found = prefix_tokens(ws, often)
                    out += [(i, q, group, t - (1 << 63), kind, at) for t, kind, at in found]
            yield pd.DataFrame(out, columns=["i", "q", "class", "token", "kind", "at"])

    prefix = materialise(spread(asked).mapInPandas(tokens, "i string, q string, class int, token bigint, kind string, at int"), "prefix")
    kinds = sorted(r[0] for r in prefix.select("class").distinct().collect())
    many = prefix.count()
    size = min(FILTER_BITS, max(16, (256 * many).bit_length()))
    # tokens are kept as signed numbers: their first bit is turned back
    bits = bitmap(prefix.select(F.col("token").bitwiseXOR(F.lit(-(1 << 63)))), size)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scan(bits, kinds)
        for pdf in batches:
            for s in range(0, len(pdf), 500):
                keys, texts_ = pdf["k"].iloc[s : s + 500].tolist(), pdf["t"].iloc[s : s + 500].tolist()
                split = [words(t) for t in texts_]
                out = []
                for k, t, ws, hits in zip(keys, texts_, split, scanner.hits(split)):
                    if hits:
                        row = xxhash.xxh3_128_hexdigest(f"{k}\0{t}".encode("utf-8", "surrogatepass"))
                        out.append((row, k, " ".join(ws), [h - (1 << 63) for h, _ in hits], [p for _, p in hits]))
                yield pd.DataFrame(out, columns=["row", "k", "words", "tokens", "places"])

    found = materialise(spread(texts).mapInPandas(scan, "row string, k string, words string, tokens array<bigint>, places array<int>"), "hits")
    salt = lambda c: F.pmod(F.hash(c), F.lit(salts))
    hits = found.select("row", F.explode(F.arrays_zip("tokens", "places")).alias("x")).select("row", F.col("x.tokens").alias("token"), F.col("x.places").alias("place"), salt("row").alias("salt"))
    own = prefix.where("kind in ('run', 'passage')").select("i", "q", "class", "token", "kind", F.col("at").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    met = hits.join(own, ["token", "salt"]).groupBy("row", "i", "q", "class").agg(F.collect_set(F.struct("kind", "place", "of", "token")).alias("at"))
    held = met.join(found.select("row", "k", "words").dropDuplicates(["row"]), "row")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = lru_cache(1000)(words)
        for pdf in batches:
            out = []
            for k, i, q, group, at, text in zip(pdf["k"], pdf["i"], pdf["q"], pdf["class"], pdf["at"], pdf["words"]):
                ws, item = text.split(" "), of(q)
                run = any(holds_run(ws, x["place"], item, x["of"]) for x in at if x["kind"] == "run")
                far, done, passage = reach(len(item).bit_length()), -1, False
                places = Counter(x["place"] for x in at if x["kind"] == "passage")
                for p in sorted(p for p, n in places.items() if n >= group % 4):
                    # windows of neighbouring places that the last one covered aren't searched again
                    if not passage and p > done:
                        done = p + far
                        passage = holds_passage(ws[max(0, p - far) : p + 2 * far], item)
                if run or passage:
                    out.append((k, i, run, passage))
            yield pd.DataFrame(out, columns=["k", "i", "run", "passage"])

    got = held.mapInPandas(verify, "k string, i string, run boolean, passage boolean")
    return got.select(F.col("k").cast(dict(docs.dtypes)[doc_key]).alias(doc_key), F.col("i").cast(dict(items.dtypes)[item_key]).alias(item_key), "run", "passage")
