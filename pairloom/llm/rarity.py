"""How rare words are: counters of fixed size over all texts, and bitmaps of hashed keys of bounded size."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.spread import spread

#: Word frequencies are kept in 2**SKETCH counters: a megabyte, whatever the vocabulary. They only order words.
SKETCH = 20


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def word_rarity(texts: DataFrame, split: Callable[[str], list[str]]) -> np.ndarray:
    """In how many texts the words of each counter stand, as a power of two. texts: one column; nulls count nothing."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(1 << SKETCH, np.int64)
        for pdf in batches:
            seen: Counter = Counter()
            for text in pdf["text"]:
                if text:
                    seen.update(set(split(text)))
            if seen:
                np.add.at(n, [word_hash(w) >> 64 - SKETCH for w in seen], list(seen.values()))
        at = np.flatnonzero(n)
        yield pd.DataFrame({"at": at.astype(np.int32), "n": n[at]})

    one = texts.select(F.col(texts.columns[0]).alias("text"))
    got = spread(one).mapInPandas(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << SKETCH, np.uint8)
    out[got["at"].to_numpy(np.int64)] = np.log2(got["n"].to_numpy(np.float64)).astype(np.uint8) + 1
    return out


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """The first bits of the keys (one bigint column), as a bitmap of 2**bits, made in parts of 4096 bytes."""
    out = np.zeros(1 << bits - 3, np.uint8)
    # places are counted from 1 there
    place = F.shiftrightunsigned(keys.columns[0], 64 - bits) + 1
    parts = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")))
    for part, b in parts.collect():
        piece = np.frombuffer(b, np.uint8)[: max(0, len(out) - (part - 1) * len(b))]
        out[(part - 1) * len(b) : (part - 1) * len(b) + len(piece)] = piece
    return out


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the uint64 keys have their bit set."""
    size = len(bits).bit_length() + 2
    place = keys >> np.uint64(64 - size)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
