import itertools
import random

import pytest
from pyspark.sql import functions as F

from pairloom.llm import related, same_question as S
from pairloom.llm.question import is_number, tokens

SCHEMA = "pair_id bigint, split string, data_source string, data_id bigint, prompt string"
CONTESTS = "contest_id bigint, contest_code string, contest_title string"
WORDS = "red blue kite stone tower river walks over under near again soon ferry carries boxes".split()


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def variants(rng, n):
    out = []
    for g in range(n):
        base = [str(rng.randint(1, 5)) if rng.random() < 0.2 else rng.choice(WORDS) for _ in range(rng.choice([5, 12, 30, 60]))] + [str(g % 3)]
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                i = rng.randrange(len(t))
                kind = rng.random()
                if not is_number(t[i]) and kind < 0.4:
                    t[i] = rng.choice(WORDS)
                elif not is_number(t[i]) and kind < 0.7:
                    del t[i]
                else:
                    t.insert(i, rng.choice(WORDS))
            out.append(" ".join(t))
    return out


def test_edits_agree_with_the_full_table():
    rng = random.Random(1)
    texts = [x.split() for x in variants(rng, 12)]
    for a, b in itertools.combinations(texts, 2):
        assert S.edits(a, b) == min(plain_distance(a, b), 5)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["train", "train", "test", "validation", None]), rng.choice(["a", "b", None]), rng.choice([None, None, rng.randint(1, 40)]), t) for i, t in enumerate(variants(rng, 40))]
    rows += [(900, "train", "a", None, None), (901, "test", "a", None, ""), (902, "test", "a", 3, "[INST] [/INST]"), (903, "train", None, 1, "red 1 (HLMI-96-18)"), (904, "test", None, 2, "completely other 7 [HLMI 1996 #18]")]
    return rows


def brute(rows):
    t = {r[0]: tokens(r[4].split(" (HLMI")[0].split(" [HLMI")[0]) if r[4] and "INST" not in r[4] else [] for r in rows}
    nums = {k: [w for w in v if is_number(w)] for k, v in t.items()}
    return {(a[0], b[0]): True for a, b in itertools.combinations(rows, 2) if t[a[0]] and t[b[0]] and nums[a[0]] == nums[b[0]] and plain_distance(t[a[0]], t[b[0]]) <= 4}


def test_overlaps_against_brute_force(spark, data):
    rows = spark.createDataFrame(data, SCHEMA).withColumn("klass", F.lit("clash")).withColumn("words", F.lit(1))
    contests = spark.createDataFrame([(1, "HLMI", "Harrow Lake Invitational")], CONTESTS)
    split = {r[0]: r[1] for r in data}
    want = {p for p in brute(data) if {split[p[0]] == "train", split[p[1]] == "train"} == {True, False} and None not in (split[p[0]], split[p[1]])}
    found = S.Overlaps(rows, contests)
    got = found.pairs()
    pairs = [tuple(sorted((r["train_id"], r["eval_id"]))) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and want
    report = found.report().collect()
    assert sum(r["pairs"] for r in report) == len(want)
    assert sum(r["records"] for r in report) == sum(s in ("test", "validation") for s in split.values())


def test_blocks_lose_nothing(spark, data):
    words = S.word_rows(spark.createDataFrame(data, SCHEMA))
    one = F.lit(True)
    half = {(r[0], r[1]) for r in S.class_pairs(S.classes_of(words, one, one), symmetric=True).select("klass_a", "klass_b").collect()}
    whole = {(r[0], r[1]) for r in S.class_pairs(S.classes_of(words, one, one), 512).select("klass_a", "klass_b").collect()}
    cut = {(r[0], r[1]) for r in S.class_pairs(S.classes_of(words, one, one), 2).select("klass_a", "klass_b").collect()}
    assert whole == cut and whole and half == {p for p in whole if p[0] < p[1]}


def test_many_wordings_without_a_number(spark):
    """Their seeds are all that tells them apart; planted partners differ by up to four words."""
    rng = random.Random(5)
    often = "what is the value of a in this red or blue".split()
    word = lambda: rng.choice(often) if rng.random() < 0.6 else "w" + "".join(rng.choice("abcdefgh") for _ in range(4))
    texts, want = [], set()
    for i in range(4000):
        base = [word() for _ in range(rng.choice([6, 9, 14, 25, 50]))]
        other = list(base)
        for _ in range(rng.randint(0, 4)):
            other[rng.randrange(len(other))] = word()
        texts += [base, other]
        want.add((2 * i, 2 * i + 1))
    rows = spark.createDataFrame([(i, "test" if i % 2 else "train", "a", None, " ".join(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {(r["train_id"], r["eval_id"]) for r in S.cross_split_overlaps(rows).collect()}
    assert want <= got
    assert all(plain_distance(texts[a], texts[b]) <= 4 for a, b in got - want)


def test_seeds_of_partners_meet():
    rng = random.Random(9)
    for _ in range(2000):
        a = [rng.choice(WORDS) for _ in range(rng.randint(1, 90))]
        b = list(a)
        for _ in range(4):
            i = rng.randrange(len(b) + 1)
            kind = rng.random()
            if kind < 0.4 or not b:
                b.insert(i, rng.choice(WORDS))
            elif kind < 0.7:
                del b[min(i, len(b) - 1)]
            else:
                b[min(i, len(b) - 1)] = rng.choice(WORDS)
        if set(a) & set(b):
            assert {k for k, _ in S.seeds_of(a, 0)} & {k for k, _ in S.seeds_of(b, 0)}, (a, b)


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(0, 700)]
    hub = [(5000, 6000 + i) for i in range(3000)]
    got = {r["node"]: r["root"] for r in related.components(spark.createDataFrame([*path, *hub, (9999, 9999)], "u bigint, v bigint")).collect()}
    assert len(got) == 701 + 3001 + 1 and len(set(got.values())) == 3
    assert len({got[i] for i in range(701)}) == 1 and len({got[6000 + i] for i in range(3000)}) == 1


def test_components_against_union_find(spark, data):
    contests = spark.createDataFrame([(1, "HLMI", "Harrow Lake Invitational")], CONTESTS)
    got = {r["pair_id"]: (r["members"], r["lead_data_id"]) for r in related.related_records(spark.createDataFrame(data, SCHEMA), contests).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in brute(data):
        parent[find(a)] = find(b)
    for r in data:
        if r[3] is not None:
            parent[find(r[0])] = find(("d", r[3]))
    parent[find(903)] = find(904)
    groups = {}
    for r in data:
        groups.setdefault(find(r[0]), []).append(r)
    for g in groups.values():
        ids = [r[3] for r in g if r[3] is not None]
        for r in g:
            assert got[r[0]] == (len(g), min(ids) if ids else None)
    assert len(got) == len(data)


def test_splits_keep_components_and_hit_their_totals(spark, data):
    contests = spark.createDataFrame([], CONTESTS)
    rel = related.related_records(spark.createDataFrame(data, SCHEMA), contests)
    got = {r["pair_id"]: (r["component"], r["split"]) for r in related.assign_splits(rel, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert len(got) == len(data)
    by = {}
    for c, s in got.values():
        by.setdefault(c, set()).add(s)
    assert all(len(s) == 1 for s in by.values())
    n = sum(s == "test" for _, s in got.values())
    assert abs(n - len(data) * 0.1) <= 1


def test_closest_totals_is_exact():
    rng = random.Random(3)
    for _ in range(30):
        sizes = {rng.randint(1, 30): rng.randint(1, 5) for _ in range(5)}
        items = [s for s, n in sizes.items() for _ in range(n)]
        reach = {0}
        for x in items:
            reach |= {r + x for r in reach}
        want = round(0.3 * sum(items))
        took = related.closest_totals(sizes, [0.7, 0.3])[0]
        assert all(n <= sizes[s] for s, n in took.items())
        assert abs(sum(s * n for s, n in took.items()) - want) == min(abs(r - want) for r in reach)


def test_empty_tables(spark):
    rows, contests = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], CONTESTS)
    assert S.cross_split_overlaps(rows, contests).count() == 0
    rel = related.related_records(rows, contests)
    assert rel.count() == 0 and related.assign_splits(rel).count() == 0


def test_one_group_of_many_equal_rows(spark):
    rows = spark.range(3000).select(F.col("id").alias("pair_id"), F.when(F.col("id") < 5, "test").otherwise("train").alias("split"), F.lit("a").alias("data_source"), F.lit(None).cast("bigint").alias("data_id"), F.lit("one 1 two 2 three").alias("prompt"))
    assert S.cross_split_overlaps(rows).count() == 5 * 2995
    rel = related.related_records(rows, spark.createDataFrame([], CONTESTS))
    assert rel.where("members = 3000 and lead_data_id is null").count() == 3000
