"""Token-axis functions over array columns: higher-order functions of one pass, or closed forms.

Lambda variables have long names of their own: Spark resolves them without regard to case against columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x: Column | str) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda acc, item: acc + item)


def mean(x: Column | str) -> Column:
    """Null for a null or empty array."""
    return F.try_divide(total(x), F.size(_c(x)))


def masked_mean(x: Column | str, mask: Column | str) -> Column:
    """Sum where mask is true over the number of trues; NaN if there is none."""
    kept = F.aggregate(F.zip_with(_c(x), _c(mask), lambda item, on: F.when(on, item).otherwise(0.0)), F.lit(0.0), lambda acc, item: acc + item)
    n = F.size(F.filter(_c(mask), lambda on: on))
    return F.coalesce(F.try_divide(kept, n), F.lit(float("nan")))


def approx_kl(lp: Column | str, base: Column | str, kind: str = "k1") -> Column:
    """Per token: k1 the log ratio, k2 half its square, k3 exp(-k1) - 1 + k1."""
    ratio = F.zip_with(_c(lp), _c(base), lambda p_item, b_item: p_item - b_item)
    if kind == "k1":
        return ratio
    if kind == "k2":
        return F.transform(ratio, lambda item: item * item / 2)
    return F.transform(ratio, lambda item: F.exp(-item) - 1 + item)


def logsumexp(x: Column | str) -> Column:
    top = F.array_max(_c(x))
    return top + F.ln(F.aggregate(F.transform(_c(x), lambda item: F.exp(item - top)), F.lit(0.0), lambda acc, item: acc + item))


def log_softmax_at(x: Column | str, i: Column) -> Column:
    """The log-softmax at 0-based position i."""
    return F.get(_c(x), i) - logsumexp(x)


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n, 0 for 0; exact to double precision (a table to 32, an asymptotic series beyond)."""
    table = F.array(*[F.lit(sum(1.0 / k for k in range(1, m + 1))) for m in range(33)])
    big = F.ln(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n) + 1 / (120 * F.pow(n.cast("double"), F.lit(4)))
    return F.when(n <= 32, F.get(table, n.cast("int"))).otherwise(big)


def regret(policy: Column | str, gap: Column) -> Column:
    """Mean over t of policy_t - mean of gap_l over l >= t, by its closed form: gap_l weighs H_n - H_(n-l-1)."""
    n = F.size(_c(policy))
    weighed = F.transform(gap, lambda item, at: item * (harmonic(n) - harmonic(n - at - 1)))
    return F.try_divide(total(policy) - total(weighed), n)


def topk_kl(p: Column, q: Column, vocabulary: int, eps: float = 1e-9) -> Column:
    """KL of two top-k distributions of k entries each, the rest of the mass spread evenly over the vocabulary."""
    k = F.size(p)
    inner = F.aggregate(F.zip_with(p, q, lambda p_item, q_item: p_item * (F.ln(p_item + eps) - F.ln(q_item + eps))), F.lit(0.0), lambda acc, item: acc + item)
    rest = lambda x: F.greatest(1 - total(x), F.lit(eps))
    return inner + rest(p) * (F.ln(rest(p) / (vocabulary - k)) - F.ln(rest(q) / (vocabulary - k)))


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def suffix_sums(x: np.ndarray, decay: float) -> np.ndarray:
    """S_t = x_t + decay S_(t+1), in blocks within which the powers of decay stay well above underflow."""
    x = np.asarray(x, np.float64)
    if not len(x) or decay == 0:
        return x
    if decay == 1:
        return np.cumsum(x[::-1])[::-1]
    block = max(1, min(len(x), int(-60 / np.log(decay)) if decay < 1 else 64))
    powers = decay ** np.arange(block)
    out, carry = np.empty(len(x)), 0.0
    for start in range((len(x) - 1) // block * block, -1, -block):
        part = x[start : start + block]
        own = np.cumsum((part * powers[: len(part)])[::-1])[::-1] / powers[: len(part)]
        own += carry * decay ** np.arange(len(part), 0, -1)
        out[start : start + block], carry = own, own[0]
    return out


@F.pandas_udf(ArrayType(DoubleType()))
def discounted_returns(rewards: pd.Series, gamma: pd.Series) -> pd.Series:
    """R_t = r_t + gamma R_(t+1), by scaled cumulative sums."""
    return pd.Series([None if r is None else suffix_sums(r, g) for r, g in zip(rewards, gamma)])


@F.pandas_udf(ArrayType(DoubleType()))
def gae(rewards: pd.Series, values: pd.Series, gamma: pd.Series, lam: pd.Series) -> pd.Series:
    """A_t = delta_t + gamma lambda A_(t+1) with delta_t = r_t + gamma V_(t+1) - V_t; V after the end is 0."""
    out = []
    for r, v, g, l in zip(rewards, values, gamma, lam):
        if r is None or v is None:
            out.append(None)
            continue
        out.append(suffix_sums(np.asarray(r, np.float64) + g * np.append(v[1:], 0.0) - v, g * l))
    return pd.Series(out)


def pad(x: Column | str, length: Column, value, left: bool = False) -> Column:
    """x filled up to length; longer arrays stay."""
    fill = F.array_repeat(F.lit(value), F.greatest(length - F.size(_c(x)), F.lit(0)).cast("int"))
    return F.concat(fill, _c(x)) if left else F.concat(_c(x), fill)


def truncate_eos(ids: Column | str, most: int, eos: Column) -> Column:
    """At most most ids, the last then being eos."""
    return F.when(F.size(_c(ids)) > most, F.concat(F.slice(_c(ids), 1, most - 1), F.array(eos))).otherwise(_c(ids))


def label_mask(ids: Column | str, prompt: Column, ignore: int = -100) -> Column:
    """ids with ignore in place of the first prompt ids."""
    return F.transform(_c(ids), lambda item, at: F.when(at < prompt, F.lit(ignore)).otherwise(item))


def last_valid(mask: Column | str) -> Column:
    """0-based position of the last true."""
    return F.size(_c(mask)) - F.array_position(F.reverse(_c(mask)), True)


def prefix_variants(tokens: Column | str, step: int = 16, most: int = 4) -> Column:
    """array<struct<mask, cut>>: lengths left when mask * step tokens are taken off the end, each at least 1."""
    cuts = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda m: F.struct(m.alias("mask"), (F.size(_c(tokens)) - step * m).alias("cut")))
    return F.filter(cuts, lambda v: v["cut"] > 0)


def masked(x: Column | str, mask: Column | str) -> Column:
    """The entries where mask is true."""
    return F.filter(_c(x), lambda item, at: F.get(_c(mask), at))


def running_sum(x: Column) -> Column:
    """Sums of all entries up to each. For arrays of some hundred entries (turns, steps): the work grows with the square."""
    grow = lambda acc, item: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + item))
    return F.aggregate(x, F.array().cast("array<bigint>"), grow)


def unpack(x: Column, lens: Column) -> Column:
    """x cut into pieces of the given lengths."""
    ends = running_sum(lens)
    return F.transform(lens, lambda n, i: F.slice(x, (F.get(ends, i) - n + 1).cast("int"), n))


def log_softmax(x: Column | str) -> Column:
    """The logarithm of the sum is bound once, not computed anew for each entry."""
    return F.get(F.transform(F.array(logsumexp(x)), lambda whole: F.transform(_c(x), lambda item: item - whole)), F.lit(0))
