"""Texts into containers of a fixed number of tokens: bounded-space online best fit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, functions as F

from ..plans.lineage import materialise
from ..plans.spread import spread

#: Fixed value: how the public byte-level vocabulary cuts texts before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048
OPEN_BINS = 64
#: Tasks at most, whatever the size of the table.
MOST_PARTS = 20_000
#: Containers of one group, which is packed on its own. The bins that are open when a group ends are all that is lost against one long run.
CONTAINERS_PER_GROUP = 2000


def token_counts(rows: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """key, tokens of each whole text; a null text has 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "tokens": [len(encoder.encode_ordinary(x)) if x else 0 for x in pdf["t"]]})

    kind = dict(rows.dtypes)[key]
    got = spread(rows.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))).mapInPandas(count, "k string, tokens bigint")
    return got.select(F.col("k").cast(kind).alias(key), "tokens")


class Bins:
    """At most OPEN_BINS open containers, kept by free space; a bitset has a bit for each free space that occurs."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.by_free: dict[int, list[tuple[int, int]]] = {}
        self.bits, self.n, self.next = 0, 0, 0

    def _take(self, free: int) -> tuple[int, int]:
        bins = self.by_free[free]
        got = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.n -= 1
        return got

    def _put(self, free: int, number: int, items: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append((number, items))
            self.bits |= 1 << free
            self.n += 1

    def place(self, size: int) -> tuple[int, int, int]:
        """(container, place, offset): the open bin with the least free space that is enough, else a new one."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number, items = self._take(free)
        else:
            if self.n == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number, items = self.capacity, self.next, 0
            self.next += 1
        self._put(free - size, number, items + 1)
        return number, items, self.capacity - free


def pack(sizes: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, most_parts: int = MOST_PARTS) -> DataFrame:
    """key, piece, container, place, offset, tokens for (key, tokens) rows.

    A text longer than a container is cut into full ones and a rest, which is an item like others; no other text is
    split. Texts without a token (null, empty) need no place and have no row. Rows of one key are separate items. Groups
    are cut by hash so that each fills some CONTAINERS_PER_GROUP containers, whatever the size of the table, and take
    their items in order of that hash: a task that runs again makes the same containers. A task packs groups one after
    the other; there are most_parts tasks at most, each with an equal number of groups.
    """
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    groups = max(1, round(total / (capacity * CONTAINERS_PER_GROUP)))
    order = F.xxhash64(F.col(key).cast("string"))
    items = sizes.where("tokens > 0").select(F.col(key).cast("string").alias("k"), "tokens", F.coalesce(order, F.lit(0)).alias("h")).withColumn("task", F.pmod("h", F.lit(groups)).cast("int"))
    parts = min(groups, most_parts)
    dealt = items.repartitionById(parts, (F.col("task") % parts).cast("int"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins: Bins | None = None
        at = None
        for pdf in batches:
            out = []
            for k, n, task in zip(pdf["k"], pdf["tokens"].tolist(), pdf["task"].tolist()):
                if task != at:
                    at, bins = task, Bins(capacity, open_bins)
                piece = 0
                while n > 0:
                    size = min(n, capacity)
                    number, place, offset = bins.place(size)
                    out.append((k, piece, (task << 40) + number, place, offset, size))
                    n -= size
                    piece += 1
            yield pd.DataFrame(out, columns=["k", "piece", "container", "place", "offset", "tokens"])

    kind = dict(sizes.dtypes)[key]
    got = dealt.sortWithinPartitions("task", "h", "k", "tokens").mapInPandas(fill, "k string, piece int, container bigint, place int, offset int, tokens int")
    return got.select(F.col("k").cast(kind).alias(key), "piece", "container", "place", "offset", "tokens")


def pack_texts(rows: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """pack() over the token counts of a text column."""
    return pack(materialise(token_counts(rows, key, text, vocabulary), "tokens"), key, capacity, open_bins)
