"""The end model has the same counts whether an order's contexts are held or joined."""

import random

import numpy as np
import pytest

from pairloom.llm import defects, terminal
from pairloom.plans.lineage import materialise

from .test_defects import QUESTION, SCHEMA, sentences


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    rows = [(i, "a", QUESTION, s[: rng.randrange(20, len(s))] if i % 5 == 0 else s, None if i % 7 == 0 else sentences(rng)) for i in range(150) for s in [sentences(rng)]]
    d = materialise(spark.createDataFrame(rows, SCHEMA), "rows")
    return d, materialise(defects.judged(d), "judged")


def odds(model):
    return {(r["pair_id"], r["field_name"]): r["log_odds"] for r in defects.scored(*model).collect()}


@pytest.mark.parametrize("bits", [0, 5, 7])
def test_odds_dont_depend_on_the_bound(model, monkeypatch, bits):
    want = odds(model)
    # from no order held to some
    monkeypatch.setattr(terminal, "BITS", bits)
    assert odds(model) == pytest.approx(want, nan_ok=True) and len(want) == 300


def test_bitmap_lets_every_end_through():
    keys = np.random.default_rng(2).integers(0, 1 << 63, 2000)
    bits = np.zeros(1 << terminal.FILTER_BITS - 3, np.uint8)
    place = keys >> (63 - terminal.FILTER_BITS)
    np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
    p = terminal.Perhaps(bits)
    assert (p.find(keys) == 0).all() and (p.find(np.random.default_rng(3).integers(0, 1 << 63, 2000)) == 0).sum() < 5


def test_continuations_are_whole_when_sent_on_early(monkeypatch):
    texts = ["the plums and the kites", "the kites and the plums", "the rope"] * 4
    keys = [np.unique(x) for x in terminal.end_contexts(texts).T]
    want = [(k, dict(zip(key.tolist(), n.tolist()))) for k, key, n in terminal.continuations(iter([texts]), [terminal.Wanted(x) for x in keys]) if k]
    monkeypatch.setattr(terminal, "HELD", 3)
    full = [terminal.Perhaps(np.full(1 << terminal.FILTER_BITS - 3, 255, np.uint8))] * 4
    got = {k: {} for k in (0, *terminal.ORDERS)}
    for k, key, n in terminal.continuations(iter([[t] for t in texts]), full):
        for x, y in zip(key.tolist(), n.tolist()):
            got[k][x] = got[k].get(x, 0) + y
    assert [(k, {x: y for x, y in got[k].items() if x in set(keys[i].tolist())}) for i, k in enumerate(terminal.ORDERS)] == want
