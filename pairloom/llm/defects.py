"""Defective replies: empty, refusal, copies_question, other_language, truncated."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..plans.lineage import drop, materialise
from ..plans.spread import spread
from . import terminal
from .language import NUMBER, language, refuses, solves
from .question import requested_language, strip_template
from .sentences import BLANK

FIELDS = ("chosen", "rejected")
#: What is left of a reply that says nothing.
_NOTHING = re.compile(r"<\|[a-z_]+\|>(?:\s*(?:assistant|user|system)\b)?|</?s>|\[/?INST\]|</?(?:think|answer|reasoning|thought|scratchpad)>|\\\(|\\\)|\$|\\boxed\s*\{\s*\}|#{3,4}\s*(?:Response|Assistant|Answer):?|\A\s*(?:Assistant|Answer|Response):|[\s​-‏⁠﻿­\x85\xa0]+", re.I)
_MARK_WORDS = ("Assistant", "Answer", "Response", "assistant", "answer", "response", "ASSISTANT", "ANSWER", "RESPONSE")
#: A copy needs at most this share of the bytes that it needs without the question, and holds this share of its letters.
COPY_SHARE, NEARLY = 0.3, 0.7
#: Words before a name that signs a text; a name that the prompt knows is whole, whatever the model makes of it.
SIGN_OFFS = frozenset("wishes yours regards sincerely saludos atentamente grüße grüßen cordialement amitiés".split())
#: Ends that agree in so many letters count once: copies of one value would vouch for each other's end.
TAIL_LETTERS = 56
_SIGNS = re.compile(r"[\W_]+")
#: Log-odds are kept in steps of this size to set thresholds.
STEP = 0.25


def is_empty(value: str | None) -> bool:
    text = (value or "").strip(BLANK)
    if not text:
        return True
    # a text that opens with a letter or digit says something, unless that is a mark
    if text[0].isalnum() and not text.startswith(_MARK_WORDS):
        return False
    return not _NOTHING.sub("", text)


def _bytes(text: bytes, known: bytes | None = None) -> int:
    data = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if known else None
    return len(zstandard.ZstdCompressor(level=3, dict_data=data).compress(text))


def copies_question(question: list[str], reply: list[str], known: frozenset[str] | set[str] = frozenset()) -> bool:
    """reply is the question, or nearly all of it, once more, and nothing beside it answers; both as lower-case words.

    The reply is compressed with the question as a zstandard dictionary. One of about the question's length must need
    almost nothing of what it needs alone; a longer one (some words around the question, or the question several times)
    almost nothing of what the question needs, and give no solution in words of its own. known: figures of the question.
    """
    n, m = sum(map(len, question)), sum(map(len, reply))
    if not n or m < NEARLY * n:
        return False
    longer = m > (2 - NEARLY) * n
    if longer:
        own, words = set(question), set(reply)
        if len(own & words) < 0.9 * len(own) or len(words) > 2 * len(own) + 10:
            return False
    q, r = " ".join(question).encode(), " ".join(reply).encode()
    with_ = _bytes(r, q)
    if longer:
        return with_ <= COPY_SHARE * _bytes(q) and not solves(" ".join(w for w in reply if w not in own), known)
    return with_ < 0.5 * len(r) and with_ <= COPY_SHARE * _bytes(r)


def signed(text: str, question: list[str]) -> bool:
    """Whether a text ends in a sign-off and a name of the question."""
    at = text.rfind(",")
    if at < 0 or not (name := text[at + 1 :].strip(BLANK)) or len(name.split()) > 1:
        return False
    before = text[:at].rsplit(None, 1)
    return bool(before) and before[-1].lower().strip(BLANK) in SIGN_OFFS and _SIGNS.sub("", name.lower()) in {_SIGNS.sub("", w) for w in question}


class _Prompts:
    """What is known of a prompt; prompts repeat."""

    def __init__(self) -> None:
        self.get = lru_cache(4096)(self._get)

    def _get(self, prompt: str | None) -> tuple[list[str], str | None, str | None, frozenset[str]]:
        question = strip_template(prompt or "").lower()
        words = question.split()
        return words, language(question, words, 2), requested_language(prompt) if prompt else None, frozenset(NUMBER.findall(question))


def _judge(prompt: tuple[list[str], str | None, str | None, frozenset[str]], value: str | None) -> tuple[str, str | None, str, int]:
    """(kind, language, tail, structure): kind is a defect or the state of the end, as terminal.state has it.

    prompt: as _Prompts has it.
    """
    if is_empty(value):
        return "empty", None, "", 0
    question, spoken, asked, known = prompt
    text = terminal.bare(value)
    words = text.lower().split()
    own = language(text, words)
    if refuses(text, known):
        return "refusal", own, "", 0
    if copies_question(question, words, known):
        return "copies_question", own, "", 0
    if own and spoken and own != spoken and own != asked:
        return "other_language", own, "", 0
    state, n, structure = terminal.state(text)
    if state == "open" and text[-1].isalpha() and signed(text, question):
        state = "whole"
    return state, own, terminal.tail(text, n), structure


def judged(rows: DataFrame) -> DataFrame:
    """pair_id, data_source, field_name, kind, lang, contexts, tail, structure for both fields of each record."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prompts = _Prompts()
        for pdf in batches:
            asked = [prompts.get(p) for p in pdf["prompt"]]
            for field in FIELDS:
                got = list(map(_judge, asked, pdf[field]))
                contexts = terminal.end_contexts([x[2] for x in got], [x[3] for x in got])
                yield pd.DataFrame({
                    "pair_id": pdf["pair_id"], "data_source": pdf["data_source"], "field_name": field, "kind": [x[0] for x in got], "lang": [x[1] for x in got],
                    "contexts": [c if x[2] else None for c, x in zip(contexts, got)], "tail": [xxhash.xxh32_intdigest(_SIGNS.sub("", x[2].lower())[-TAIL_LETTERS:]) if x[2] else None for x in got], "structure": [x[3] for x in got],
                })

    # ids travel as text: a null among integers would turn a batch into floating point
    kept = spread(rows.select(F.col("pair_id").cast("string").alias("pair_id"), "data_source", "prompt", *FIELDS))
    return kept.mapInPandas(judge, "pair_id string, data_source string, field_name string, kind string, lang string, contexts array<bigint>, tail bigint, structure int").withColumn("pair_id", F.col("pair_id").cast("bigint"))


def _bitmaps(at: DataFrame, orders: list[int]) -> dict[int, np.ndarray]:
    """For terminal.Perhaps: the bits of the keys of each order, made in parts of 4096 bytes."""
    out = {k: np.zeros(1 << terminal.FILTER_BITS - 3, np.uint8) for k in orders}
    # places are counted from 1 there
    place = F.shiftright("key", 63 - terminal.FILTER_BITS) + 1
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("place"))
    for k, part, b in at.where(F.col("k").isin(orders)).select("k", place.alias("place")).groupBy("k", F.bitmap_bucket_number("place")).agg(bits).collect():
        out[k][(part - 1) * len(b) : part * len(b)] = np.frombuffer(b, np.uint8)
    return out


def end_model(rows: DataFrame, values: DataFrame) -> tuple[dict[int, pd.Series], dict[int, pd.Series], dict[int, DataFrame], np.ndarray]:
    """Counts by key of ends and continuations for the contexts that end some value, by order, and the share of ends in
    each structure.

    The counts of an order with more than 2**BITS different contexts are a table (key, ends, goes) instead: what reaches
    the driver and the tasks is bounded, and every context has its own counts all the same.
    """
    ks = F.array(*[F.lit(k) for k in terminal.ORDERS])
    # copies of one value would vouch for each other's end: each tail counts once
    tails = values.where("contexts is not null").groupBy("contexts", "tail", "structure").agg(F.lit(1))
    at = tails.select(F.explode(F.arrays_zip(ks.alias("k"), F.col("contexts").alias("key"))).alias("x")).select("x.k", "x.key")
    at = materialise(at.groupBy("k", "key").agg(F.count("*").alias("n")), "ends")
    of = {r[0]: r for r in at.groupBy("k").agg(F.count("*").alias("different"), F.sum("n").alias("n")).collect()}
    many = [k for k, r in of.items() if r["different"] > 1 << terminal.BITS]
    few = [k for k in terminal.ORDERS if k not in many]
    got = at.where(F.col("k").isin(few)).toPandas()
    ends = {k: got[got["k"] == k].set_index("key")["n"].sort_index() for k in few}
    keys = {k: s.index.to_numpy(np.int64) for k, s in ends.items()}
    bits = _bitmaps(at, many) if many else {}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def texts() -> Iterator[list[str]]:
            for pdf in batches:
                for field in FIELDS:
                    for s in range(0, len(pdf), 500):
                        if part := [x for x in pdf[field].iloc[s : s + 500] if x]:
                            yield part

        wanted = [terminal.Wanted(keys[k]) if k in keys else terminal.Perhaps(bits[k]) for k in terminal.ORDERS]
        for k, key, n in terminal.continuations(texts(), wanted):
            yield pd.DataFrame({"k": np.full(len(n), k, np.int32), "key": key, "n": n})

    went = spread(rows.select(*FIELDS)).mapInPandas(count, "k int, key bigint, n bigint").groupBy("k", "key").agg(F.sum("n").alias("n"))
    if many:
        went = materialise(went, "continuations")
    got = (went.where(F.col("k").isin(0, *few)) if many else went).toPandas()
    goes = {k: got[got["k"] == k].set_index("key")["n"].sort_index() for k in few}
    within = got[got["k"] == 0].set_index("key")["n"]
    large = {}
    for k in many:
        on = went.where(F.col("k") == k).select("key", F.col("n").alias("goes"))
        large[k] = at.where(F.col("k") == k).join(on, "key", "left").select("key", F.col("n").alias("ends"), F.coalesce("goes", F.lit(0)).alias("goes"))
    ended = {r[0]: r[1] for r in tails.groupBy("structure").count().collect()}
    # a value's own end is taken off here too
    share = [(max(ended.get(k, 0) - 1, 0) + 0.5) / (ended.get(k, 0) + int(within.get(k, 0)) + 1) for k in range(len(terminal.STRUCTURES) + 1)]
    return ends, goes, large, np.array(share)


def scored(rows: DataFrame, values: DataFrame) -> DataFrame:
    """values with log_odds where a context is known, that is, for all but empty values and those of other defects."""
    ends, goes, large, prior = end_model(rows, values)

    def counts(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        contexts = np.stack(pdf["contexts"].to_numpy())
        for i, k in enumerate(terminal.ORDERS):
            by_key = [s[k].reindex(contexts[:, i]) for s in (ends, goes)] if k in ends else [pdf[f"ends_{k}"], pdf[f"goes_{k}"]]
            yield tuple(s.fillna(0).to_numpy(np.float64) for s in by_key)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = pdf["contexts"].notna().to_numpy()
            odds = np.full(len(pdf), np.nan)
            if known.any():
                odds[known] = terminal.log_odds(counts(pdf[known]), prior[pdf["structure"][known].to_numpy()])
            yield pdf[["pair_id", "data_source", "field_name", "kind", "lang"]].assign(log_odds=odds)

    texts = values.withColumn("pair_id", F.col("pair_id").cast("string"))
    for k, table in large.items():
        # no key is negative: values without contexts meet nothing, and are spread
        lone = -1 - F.pmod(F.xxhash64("pair_id", "field_name"), F.lit(1 << 20))
        key = F.coalesce(F.get("contexts", F.lit(terminal.ORDERS.index(k))), lone)
        texts = texts.withColumn("key", key).join(table.toDF("key", f"ends_{k}", f"goes_{k}"), "key", "left").drop("key")
    return texts.mapInPandas(score, "pair_id string, data_source string, field_name string, kind string, lang string, log_odds double").withColumn("pair_id", F.col("pair_id").cast("bigint"))


#: The threshold where no end is more likely to go on, or none to stand: there is no valley to look for.
DEFAULT = -3.0
#: What all values together weigh in the histogram of one language and column, in values.
POOLED = 20.0


def thresholds(values: DataFrame) -> dict[tuple[str | None, str], float]:
    """The threshold of each language and column, from the histogram of the log-odds of all values that are open.

    Ends that more likely go on and ends that more likely stand have a mode each; the threshold lies amid the longest of
    the emptiest stretches between the two. Few values lean on the histogram of all.
    """
    step = F.floor(F.col("log_odds") / STEP).cast("int")
    got = values.where("kind = 'open' and log_odds is not null").groupBy("lang", "field_name", step.alias("step")).count().collect()
    by: dict = {}
    pooled: dict[int, int] = {}
    for r in got:
        by.setdefault((r[0], r[1]), {})[r[2]] = r[3]
        pooled[r[2]] = pooled.get(r[2], 0) + r[3]
    total = sum(pooled.values())

    def mode(hist: dict[int, float], side: int) -> int | None:
        own = {s: n for s, n in hist.items() if (s >= 0) == side}
        return round(sum(s * n for s, n in own.items()) / sum(own.values())) if own else None

    out = {}
    for key, own in by.items():
        hist = {s: own.get(s, 0) + POOLED * n / total for s, n in pooled.items()}
        low, high = mode(hist, False), mode(hist, True)
        if low is None or high is None:
            out[key] = DEFAULT
            continue
        near = {s: sum(hist.get(s + d, 0) * w for d, w in ((-2, 1), (-1, 2), (0, 3), (1, 2), (2, 1))) for s in range(low, high + 1)}
        least, best, run = min(near.values()) + 0.05, [], []
        for s in range(low, high + 2):
            if near.get(s, least + 1) <= least:
                run.append(s)
            else:
                best, run = (run if len(run) > len(best) else best), []
        out[key] = (best[0] + best[-1] + 1) / 2 * STEP
    return out


def defective_pairs(rows: DataFrame) -> DataFrame:
    """pair_id, data_source, field_name, defect for each defective chosen or rejected value of rows.

    A value has one defect, the first of: empty (null, blank or marks alone), refusal, copies_question, other_language,
    truncated. A null or blank prompt has no language and can't be copied. Repeated rows are judged each; extra columns
    are ignored. An empty table gives no rows.
    """
    values = materialise(judged(rows), "judged")
    with_odds = materialise(scored(rows, values), "scored")
    drop(values)
    limits = thresholds(with_odds)
    spark = rows.sparkSession
    table = spark.createDataFrame([(k[0], k[1], v) for k, v in limits.items()], "l string, f string, threshold double")
    # at most languages x columns rows
    both = with_odds.join(F.broadcast(table), F.expr("lang <=> l and field_name = f"), "left")
    # a stop makes a text whole whatever its odds, a mark left by a cut makes it cut
    scored_ = F.col("kind").isin("open", *terminal.STRUCTURES)
    low = F.col("log_odds") < F.coalesce("threshold", F.lit(DEFAULT))
    defect = F.when((F.col("kind") == "mark") | (scored_ & low), "truncated").when(~scored_ & (F.col("kind") != "whole"), F.col("kind"))
    return both.select("pair_id", "data_source", "field_name", defect.alias("defect")).where("defect is not null")


def truncation_report(rows: DataFrame) -> DataFrame:
    """data_source, values, truncated, share: how often the values of each source are cut."""
    cut = defective_pairs(rows).where("defect = 'truncated'").groupBy("data_source").agg(F.count("*").alias("truncated"))
    total = rows.groupBy("data_source").agg((F.count("*") * len(FIELDS)).alias("values"))
    joined = total.alias("t").join(cut.alias("c"), F.expr("t.data_source <=> c.data_source"), "left")
    n = F.coalesce("truncated", F.lit(0))
    return joined.select("t.data_source", "values", n.cast("bigint").alias("truncated"), (n / F.col("values")).alias("share"))
