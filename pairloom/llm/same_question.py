"""Records that put the same question: winnowed seeds joined across sides, chained, extended by alignment.

Two questions are the same if their numbers agree in order and at most MAX_EDITS words are replaced, added or dropped.
Such questions share a run of words whose length follows from their own; seeds are the minima of rolling hashes of word
grams in windows no longer than that run, so both select one in common. The minima are taken in order of rarity first,
which thins frequent seeds without losing a pair, and a seed's key holds the hash of the numbers. Seeds meet in a join by
key and near position; keys of many texts are cut into blocks. Pairs of wordings (classes) come out, never pairs of rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import materialise
from ..plans.spread import spread
from .question import credit_of, credit_parts, is_number, strip_template, tokens
from .rarity import SKETCH, word_hash, word_rarity

MAX_EDITS = 4
#: Seeds of one key and side in a block.
BLOCK = 512
#: Words of a gram at most; a longer shared run widens the window instead.
LONGEST_GRAM = 16
_M, _B = (1 << 64) - 1, 0x9E3779B97F4A7C15


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def word_rows(rows: DataFrame, contests: DataFrame | None = None) -> DataFrame:
    """pair_id, split, data_source, data_id, credit, numbers (hash), klass (hash of all words), words.

    A null or blank prompt, or one of marks alone, puts no question: numbers, klass and words are null. A credit counts
    if the contest table has its name, by code or title; the names are joined, so the table may have any size.
    """

    credited = contests is not None

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(20_000)
        def of(prompt: str | None) -> tuple:
            whole = strip_template(prompt)
            named = credit_parts(whole) if credited else []
            # the question without any credit, then without each credit that it may have
            out = []
            for rest in [whole, *(x[0] for x in named)]:
                words = tokens(rest)
                text = " ".join(words)
                out.append((_hash(" ".join(w for w in words if is_number(w))), _hash(text), text) if words else (None, None, None))
            return out, [x[1] for x in named], [x[2] for x in named]

        for pdf in batches:
            got = [of(p) for p in pdf.pop("prompt")]
            for i, name in enumerate(("numbers", "klass", "words")):
                pdf[name] = [[x[i] for x in g[0]] for g in got]
            pdf["names"], pdf["credits"] = [g[1] for g in got], [g[2] for g in got]
            yield pdf

    # ids travel as text: a null among integers would turn a batch into floating point
    ids = [F.col(c).cast("bigint").cast("string").alias(c) for c in ("pair_id", "data_id")]
    kept = spread(rows.select(*ids, "split", "data_source", "prompt"))
    schema = "pair_id string, data_id string, split string, data_source string, numbers array<bigint>, klass array<bigint>, words array<string>, names array<string>, credits array<string>"
    parsed = kept.mapInPandas(parse, schema).withColumns({c: F.col(c).cast("bigint") for c in ("pair_id", "data_id")})
    return _credited(parsed, contests)


def _credited(parsed: DataFrame, contests: DataFrame | None) -> DataFrame:
    """parsed with the credit whose name the contest table knows taken off the question."""
    at, credit = F.lit(0), F.lit(None).cast("string")
    if contests is not None:
        name = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
        known = contests.select("contest_id", F.explode(F.array(name(F.col("contest_code")), name(F.col("contest_title")))).alias("name"))
        known = known.where("name <> ''").groupBy("name").agg(F.min("contest_id").alias("contest_id"))
        parsed = materialise(parsed, "parsed")
        # each distinct name that some prompt has meets the table once; few names are known, so the map is joined by name
        hits = parsed.select(F.explode("names").alias("name")).distinct().join(known, "name")
        named = parsed.where("size(names) > 0").select("pair_id", "klass", "names", F.posexplode("names").alias("k", "name"))
        best = named.join(hits, "name").groupBy("pair_id", "klass", "names").agg(F.min(F.struct("k", "contest_id")).alias("best"))
        keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("pair_id", "klass", "names")]
        with_, without = parsed.where("size(names) > 0"), parsed.where("size(names) = 0").withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
        met = with_.alias("l").join(best.alias("r"), keys[0] & keys[1] & keys[2], "left").select("l.*", "best")
        parsed = met.unionByName(without)
        at = F.coalesce(F.col("best.k") + 1, F.lit(0))
        credit = credit_of(F.col("best.contest_id"), F.get("credits", F.col("best.k")))
    pick = lambda c: F.get(c, at).alias(c)
    return parsed.select("pair_id", "data_id", "split", "data_source", credit.alias("credit"), pick("numbers"), pick("klass"), pick("words"))


def shared_run(n: int) -> int:
    """Words in a row that a text of n words shares with every partner of at least as many words, at least."""
    return max(1, -(-(n - MAX_EDITS) // (MAX_EDITS + 1)))


def rarity_of(words: list[str], often: np.ndarray | None) -> list[int]:
    return [0] * len(words) if often is None else [int(often[word_hash(w) >> 64 - SKETCH]) for w in words]


def winnow(words: list[str], run: int, often: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(hash, position) of the seeds at a run length: minima of windows that no shared run can miss.

    A run of one word leaves no window; then the rarest MAX_EDITS + 1 words are taken, one of which partners share.
    """
    hashes, rare = [word_hash(w) for w in words], rarity_of(words, often)
    if run == 1:
        order = sorted(range(len(words)), key=lambda i: (rare[i], hashes[i], i))
        return [(hashes[i], i) for i in order[: MAX_EDITS + 1]]
    k = min(run // 2 + 1, LONGEST_GRAM)
    window, power = run - k + 1, pow(_B, k, 1 << 64)
    grams: list[tuple[int, int]] = []
    h, least = 0, deque()
    for i, x in enumerate(hashes):
        h = (h * _B + x) & _M
        if i >= k:
            h = (h - hashes[i - k] * power) & _M
        # a gram is as rare as its rarest word
        while least and least[-1][0] >= rare[i]:
            least.pop()
        least.append((rare[i], i))
        if least[0][1] <= i - k:
            least.popleft()
        if i >= k - 1:
            grams.append((least[0][0], h))
    out, last, held = [], -1, deque()
    for i, g in enumerate(grams):
        while held and held[-1][0] > g:
            held.pop()
        held.append((g, i))
        if held[0][1] <= i - window:
            held.popleft()
        if i >= window - 1 and held[0][1] != last:
            last = held[0][1]
            out.append((held[0][0][1], last))
    return out


def seeds_of(words: list[str], numbers: int, often: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(key, position): seeds at each run length that this text may share with a partner of its own length or less."""
    n, out = len(words), []
    for run in {shared_run(m) for m in range(max(1, n - MAX_EDITS), n + 1)}:
        salt = xxhash.xxh64_intdigest(f"{numbers}:{run}")
        out += [(((h ^ salt) * _B & _M) - (1 << 63), at) for h, at in winnow(words, run, often)]
    return out


def edits(a: list[str], b: list[str], most: int = MAX_EDITS) -> int:
    """Word edit distance, most + 1 standing for anything above: how far each diagonal gets with each number of edits."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    reach: dict[int, int] = {}
    for d in range(most + 1):
        now: dict[int, int] = {}
        for k in range(-d, d + 1):
            if d == 0:
                i = 0
            else:
                i = max(reach.get(k, -9) + 1, reach.get(k - 1, -9), reach.get(k + 1, -9) + 1)
            i = min(i, len(a), len(b) - k)
            if i < 0 or i + k < 0:
                continue
            while i < len(a) and i + k < len(b) and a[i] == b[i + k]:
                i += 1
            now[k] = i
            if i == len(a) and i + k == len(b):
                return d
        reach = now
    return most + 1


def _gaps(words: list[str]) -> list[list[str]]:
    """The word runs between the numbers."""
    out: list[list[str]] = [[]]
    for w in words:
        if is_number(w):
            out.append([])
        else:
            out[-1].append(w)
    return out


def chain(seeds: list[tuple[int, int]]) -> int:
    """The most seeds that lie in the same order in both texts."""
    ends: list[int] = []
    for _, q in sorted(set(seeds), key=lambda x: (x[0], -x[1])):
        k = next((i for i, e in enumerate(ends) if e >= q), len(ends))
        ends[k : k + 1] = [q]
    return len(ends)


def aligned(a: list[str], b: list[str]) -> int:
    """Edits between two questions of the same numbers, which are the anchors: each gap between two is aligned."""
    total = 0
    for x, y in zip(_gaps(a), _gaps(b)):
        if x != y:
            total += edits(x, y, MAX_EDITS - total)
            if total > MAX_EDITS:
                break
    return total


def _split(text: str) -> list[str]:
    return text.split(" ")


def _seed_rows(classes: DataFrame) -> DataFrame:
    """key, klass, at, n, in_a, in_b: the seeds of each class."""
    often = word_rarity(classes.select("words"), _split)

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for numbers, klass, text, a, b in zip(pdf["numbers"], pdf["klass"], pdf["words"], pdf["in_a"], pdf["in_b"]):
                words = text.split(" ")
                out += [(key, klass, at, len(words), a, b) for key, at in seeds_of(words, numbers, often)]
            yield pd.DataFrame(out, columns=["key", "klass", "at", "n", "in_a", "in_b"])

    return spread(classes.select("numbers", "klass", "words", "in_a", "in_b")).mapInPandas(seeds, "key bigint, klass bigint, at int, n int, in_a boolean, in_b boolean")


def _candidates(seeds: DataFrame, symmetric: bool, block: int) -> DataFrame:
    """klass_a, klass_b, seeds: the pairs that share a seed at a near position, with the positions of all such seeds."""
    sides = seeds.groupBy("key").agg(F.count_if("in_a").alias("na"), F.count_if("in_b").alias("nb"), F.count("*").alias("n")).where("na > 0 and nb > 0 and n > 1")
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    shared = seeds.join(sides.select("key", parts("na").alias("ba"), parts("nb").alias("bb")), "key")
    # a key of many seeds is met by length too, which differs by MAX_EDITS at most, and in blocks
    hot, width = F.col("ba") * F.col("bb") > 1, MAX_EDITS + 1
    size = lambda d: F.floor((F.col("n") + d) / width).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    a = shared.where("in_a").withColumn("size", F.when(hot, size(0)).otherwise(F.lit(-1))).withColumn("y", F.explode(upto("bb")))
    b = shared.where("in_b").withColumn("size", F.explode(F.when(hot, F.sequence(size(-MAX_EDITS), size(MAX_EDITS))).otherwise(F.array(F.lit(-1))))).withColumn("x", F.explode(upto("ba")))
    a = a.select("key", F.pmod(F.hash("klass"), "ba").alias("x"), "y", "size", F.col("klass").alias("klass_a"), F.col("at").alias("at_a"), F.col("n").alias("n_a"))
    b = b.select("key", "x", F.pmod(F.hash("klass"), "bb").alias("y"), "size", F.col("klass").alias("klass_b"), F.col("at").alias("at_b"), F.col("n").alias("n_b"))
    other = F.col("klass_a") < F.col("klass_b") if symmetric else F.col("klass_a") != F.col("klass_b")
    near = (F.abs(F.col("n_a") - F.col("n_b")) <= MAX_EDITS) & (F.abs(F.col("at_a") - F.col("at_b")) <= MAX_EDITS)
    met = a.join(b, ["key", "x", "y", "size"]).where(other & near)
    return met.groupBy("klass_a", "klass_b").agg(F.collect_set(F.struct("at_a", "at_b")).alias("seeds"))


def class_pairs(classes: DataFrame, block: int = BLOCK, symmetric: bool = False) -> DataFrame:
    """klass_a, klass_b, edits, coverage, seeds: two different classes, one of each side, that put the same question.

    classes: numbers, klass, words, in_a, in_b. symmetric: only pairs with klass_a < klass_b. coverage: the share of the
    longer question's words that are aligned alike; seeds: the collinear ones.
    """
    # classes that are alone with their numbers meet nothing
    groups = classes.groupBy("numbers").agg(F.count_if("in_a").alias("na"), F.count_if("in_b").alias("nb"), F.count("*").alias("n")).where("na > 0 and nb > 0 and n > 1").select("numbers")
    classes = materialise(classes.join(groups, "numbers", "left_semi"), "classes")
    pairs = _candidates(materialise(_seed_rows(classes), "seeds"), symmetric, block)
    texts = classes.select("klass", "words")
    both = pairs.join(texts.toDF("klass_a", "words_a"), "klass_a").join(texts.toDF("klass_b", "words_b"), "klass_b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, seeds, x, y in zip(pdf["klass_a"], pdf["klass_b"], pdf["seeds"], pdf["words_a"], pdf["words_b"]):
                x, y = x.split(" "), y.split(" ")
                if (n := aligned(x, y)) <= MAX_EDITS:
                    out.append((a, b, n, 1 - n / max(len(x), len(y)), chain([(s["at_a"], s["at_b"]) for s in seeds])))
            yield pd.DataFrame(out, columns=["klass_a", "klass_b", "edits", "coverage", "seeds"])

    return both.mapInPandas(verify, "klass_a bigint, klass_b bigint, edits int, coverage double, seeds int")


def classes_of(words: DataFrame, in_a: Column, in_b: Column) -> DataFrame:
    """One row for each wording; in_a and in_b tell whether a record on that side has it."""
    return words.where("klass is not null").groupBy("numbers", "klass").agg(F.first("words").alias("words"), F.max(in_a).alias("in_a"), F.max(in_b).alias("in_b"))


class Overlaps:
    """The wordings that train and evaluation splits share, exactly or almost, and which records have them."""

    def __init__(self, rows: DataFrame, contests: DataFrame | None = None, train: str = "train", evaluation: tuple[str, ...] = ("validation", "test")):
        is_train, is_eval = F.coalesce(F.col("split") == train, F.lit(False)), F.coalesce(F.col("split").isin(*evaluation), F.lit(False))
        words = materialise(word_rows(rows, contests).where(is_train | is_eval), "words")
        #: pair_id, split, data_source, klass of each record that puts a question
        self.members = words.where("klass is not null").select("pair_id", "split", "data_source", "klass", is_train.alias("train"))
        classes = classes_of(words, is_train, is_eval)
        same = self.members.groupBy("klass").agg(F.bool_or("train").alias("t"), F.bool_or(~F.col("train")).alias("e")).where("t and e")
        exact = same.select(F.col("klass").alias("klass_a"), F.col("klass").alias("klass_b"), F.lit(0).alias("edits"), F.lit(1.0).alias("coverage"), F.lit(0).alias("seeds"))
        #: klass_a (train), klass_b (evaluation), edits, coverage, seeds
        self.links = materialise(class_pairs(classes).unionByName(exact), "links")
        self.rows, self.evaluation = rows, evaluation

    def pairs(self, salts: int = 64) -> DataFrame:
        """train_id, eval_id, eval_split, eval_source, edits, coverage of all pairs of records."""
        t = self.members.where("train").select(F.col("klass").alias("klass_a"), F.col("pair_id").alias("train_id"))
        e = self.members.where("not train").select(F.col("klass").alias("klass_b"), F.col("pair_id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("data_source").alias("eval_source"))
        # a wording that many train records have is dealt over several tasks, to each of which its partners are sent
        parts = F.least(F.ceil(F.count("*") / 4096), F.lit(salts)).cast("int")
        many = t.groupBy("klass_a").agg(parts.alias("parts")).where("parts > 1")
        links = self.links.join(many, "klass_a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        t = t.join(many, "klass_a", "left").withColumn("salt", F.pmod(F.hash("train_id"), F.coalesce("parts", F.lit(1)))).drop("parts")
        return links.join(e, "klass_b").join(t, ["klass_a", "salt"]).select("train_id", "eval_id", "eval_split", "eval_source", "edits", "coverage")

    def report(self) -> DataFrame:
        """Per evaluation split and source: records, records that overlap with train, overlapping pairs, mean coverage.

        From the counts of each wording; no pair of records is made.
        """
        own = ["split", "data_source"]
        total = self.rows.where(F.col("split").isin(*self.evaluation)).groupBy(*own).agg(F.count("*").alias("records"))
        t = self.members.where("train").groupBy("klass").agg(F.count("*").alias("trained")).withColumnRenamed("klass", "klass_a")
        per = self.links.join(t, "klass_a").groupBy(F.col("klass_b").alias("klass")).agg(F.sum("trained").alias("trained"), F.max("coverage").alias("coverage"))
        e = self.members.where("not train").groupBy("klass", *own).agg(F.count("*").alias("n"))
        hit = e.join(per, "klass").groupBy(*own).agg(F.sum("n").alias("overlapping"), F.sum(F.col("n") * F.col("trained")).alias("pairs"), (F.sum(F.col("n") * F.col("coverage")) / F.sum("n")).alias("coverage"))
        joined = total.alias("l").join(hit.alias("r"), F.expr("l.split <=> r.split and l.data_source <=> r.data_source"), "left")
        count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
        return joined.select(F.col("l.split").alias("eval_split"), F.col("l.data_source").alias("eval_source"), "records", count("overlapping"), count("pairs"), "coverage")


def cross_split_overlaps(rows: DataFrame, contests: DataFrame | None = None, train: str = "train", evaluation: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """Records of the train and an evaluation split that put the same question.

    train_id, eval_id, eval_split, eval_source, edits, coverage (share of the longer question's words aligned alike).
    Rows whose prompt or split is null, and prompts without a word, overlap with nothing; repeated rows count as often
    as they stand. Extra columns are ignored.
    """
    return Overlaps(rows, contests, train, evaluation).pairs()
