"""Model calls as pluggable steps: score each distinct call once, ask a judge, guard a costly step by a cheap test."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: A batch of (model, prompt, response) rows to one score each.
ModelFn = Callable[[pd.DataFrame], "pd.Series"]
#: A batch of prompts to one text each.
JudgeFn = Callable[["pd.Series"], "pd.Series"]
#: A text to its tokens.
TokenizerFn = Callable[[str], "list[str]"]


def tokenizer(f: TokenizerFn) -> Callable[[Column], Column]:
    """f as a column function, in Arrow batches; null in, null out."""

    def of(text: Column) -> Column:
        @F.pandas_udf("array<string>")
        def split(t: pd.Series) -> pd.Series:
            return t.map(lambda x: None if x is None else list(f(x)))

        return split(text)

    return of


def _blanks(text: str) -> list[str]:
    return text.split(" ")


#: The plain tokenizer of tests and examples.
split_by_blanks = tokenizer(_blanks)


class Retry(Exception):
    """A call that may be tried again; wait: seconds that the service asks for, else the waits double."""

    def __init__(self, message: str = "", wait: float | None = None):
        super().__init__(message)
        self.wait = wait


def with_retries(f: Callable, tries: int = 5, wait: float = 1.0, jitter: float = 0.0, pause: Callable[[float], None] = time.sleep) -> Callable:
    """f tried again on Retry, with doubled waits of up to jitter more of themselves; any other error ends it at once.

    A rate limit is a Retry with a wait of its own, an error of the service one without; a refused key or a bad request
    is any other error.
    """

    def call(*args):
        for k in range(tries):
            try:
                return f(*args)
            except Retry as e:
                if k + 1 == tries:
                    raise
                pause(e.wait if e.wait is not None else wait * 2**k * (1 + jitter * random.random()))

    return call


def stub_score(batch: pd.DataFrame) -> pd.Series:
    """A deterministic score for tests: the share of vowels of the response, by the model's name length."""
    r = batch["response"].fillna("")
    return r.str.count("[aeiou]") / r.str.len().clip(lower=1) + batch["model"].fillna("").str.len() / 100


def stub_judge(prompts: pd.Series) -> pd.Series:
    return prompts.fillna("").map(lambda p: f"#### Output for Text 1\nRating: {len(p) % 5 + 1}\nRationale: length\n")


def score_once(df: DataFrame, model: str, prompt: str, response: str, f: ModelFn, name: str = "score") -> DataFrame:
    """df with a score of each (model, prompt, response): every distinct call is made once, grouped by model.

    The call table has only a hash of prompt and response beside the texts, so the join back moves no text.
    """
    # a null is no empty text, and a hash of 128 bits stands for the call
    key = F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in (model, prompt, response)]))
    keyed = df.withColumn("__call", key)
    calls = keyed.groupBy("__call").agg(F.first(model).alias("model"), F.first(prompt).alias("prompt"), F.first(response).alias("response")).repartition("model", "__call").sortWithinPartitions("model")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"__call": pdf["__call"], name: f(pdf).astype("float64")})

    return keyed.join(calls.mapInPandas(run, f"__call string, {name} double"), "__call", "left").drop("__call")


def judged_by(df: DataFrame, prompt: str, f: JudgeFn, name: str = "judgement") -> DataFrame:
    """df with the judge's text on each prompt; Arrow batches, one call a batch."""

    @F.pandas_udf("string")
    def ask(p: pd.Series) -> pd.Series:
        return f(p)

    return df.withColumn(name, ask(prompt))


def guarded(df: DataFrame, cheap: Column, costly: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """df with name: the cheap verdict where it isn't null, the costly step's elsewhere; only that rest reaches it."""
    d = df.withColumn(name, cheap)
    return d.where(F.col(name).isNotNull()).unionByName(costly(d.where(F.col(name).isNull()).drop(name)))


class RewardFns:
    """Reward functions by name: f(queries, prompts, labels) -> rewards, each a pandas Series."""

    def __init__(self) -> None:
        self.by_name: dict[str, Callable[[pd.Series, pd.Series, pd.Series], pd.Series]] = {}

    def register(self, name: str, f: Callable[[pd.Series, pd.Series, pd.Series], pd.Series]) -> None:
        self.by_name[name] = f

    def column(self, name: str, query: str, prompt: str, label: str) -> Column:
        f = self.by_name[name]

        @F.pandas_udf("double")
        def reward(q: pd.Series, p: pd.Series, l: pd.Series) -> pd.Series:
            return f(q, p, l)

        return reward(query, prompt, label)
