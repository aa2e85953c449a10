import random

import pytest
from pyspark.sql import functions as F

from pairloom.llm import leakage, packing, sentences

DOC = "doc_id bigint, text string"


def units(text):
    return [text[s:e] for s, e in sentences.unit_ends(text)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dr. Ann et al. got 3.5 vs. 4 for No. 2 of it. Then she left.", 2), ("See Fig. 9 and eq. (2) in vol. 114. It is odd.", 2), ('Ann wrote: "The sum is 589. It is odd." This is so.', 2), ('"Stop!" Umberto said, "we counted twice." Next one.', 2),
        ('"Is it 714?" asked Ann at Farholt. Yes.', 2), ("It ended at 12 p.m. Next came tea at 6 p.m. and more.", 2), ("What a mess?! (Compare the remark above.) So it is.", 3), ("Heading\n\nOne line\ngoes on. Two.", 3), ("1. First one\n2. Second one", 2),
        ("Step 1: one\nStep 2: two. Three", 3), ("We get 12 or\n13. That is it.", 2), ("« Est-ce 173 ? » demanda Amarit. Puis il part.", 2), ("—¿Son 201? —preguntó Corvin. Sí.", 2), ("Siehe S. 4 in Bd. 7 bzw. Abb. 2. Am 4. Mai kam z. B. er.", 2),
        ("В г. Тарнби живёт ок. 8 тыс. чел., и т. д. Он ушёл.", 2), ("«Это 0?» — спросила Велда. Да.", 2), ("彼は「和は3です。奇数です。」と書いた。次に進む。", 2), ("「もう一度！」と言って、始めた。（図6を参照。）", 2), ("老师写道：“和是4。它是奇数。”然后减去2个。", 2), ("比上一轮高0分……首先计算3。", 2), ("我看见苹果……苹果很红。", 1), ("他走了……苹果很红。", 2),
        ("ราคาต่อชิ้นคือ 34.9 บาทเท่านั้น โมเดล larch ได้ 5 คะแนน", 2), ("“क्या यह 44 है?” मीरा ने पूछा। डॉ. वेल्डा आई।", 2), ("قاس د. أورمند نحو 39.9 متراً. هذا كثير جداً!", 2), ("", 0), (" \n​\n ", 0), ("...", 1), ("one two", 1),
    ],
)
def test_units(text, want):
    assert len(units(text)) == want, units(text)


def test_words_are_learnt_from_the_corpus(spark):
    rng = random.Random(8)
    words = "苹果 香蕉 小岚 老师 商店 朋友 书包 铅笔 河流 山谷".split()
    texts = ["".join(rng.choice(words) + rng.choice(["", "买", "看", "说", "找", "画"]) for _ in range(8)) + "。" for _ in range(400)]
    d = spark.createDataFrame([*enumerate(texts), (999, None), (998, "plain words")], DOC)
    learnt = sentences.learnt_words(d)
    assert set(words) <= set(learnt) and not {"果香", "岚老", "买苹"} & set(learnt)
    assert sentences.Lattice(learnt).words("小岚买苹果找香蕉") == ["小岚", "买", "苹果", "找", "香蕉"]
    # a longer word of the dictionary hides the particle that it begins with
    assert sentences.PLAIN.words("でもある")[0] == "でも" and sentences.PLAIN.words("と言う")[0] == "と"
    assert sentences.learnt_words(spark.createDataFrame([], DOC)) == {}


def test_long_words_before_a_stop():
    assert len(units("See " + "x" * 300 + "mr. Then he left.")) == 2


def test_units_cover_the_text():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(["Ann ", "a. ", "B! ", "\n", "\n\n", "(x) ", '"', "。", "?”", "- ", "3. ", " ", "​", "»", "…"]) for _ in range(rng.randint(0, 40)))
        spans = sentences.unit_ends(t)
        assert all(s < e for s, e in spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        covered = "".join(t[s:e] for s, e in spans)
        assert [c for c in covered if not c.isspace() and c != "​"] == [c for c in t if not c.isspace() and c != "​"]


def test_sentence_rows(spark):
    d = spark.createDataFrame([(1, "One. Two."), (2, None), (3, ""), (4, "x " * 100_000), (1, "One. Two.")], DOC).withColumn("k", F.lit("clash")).withColumn("unit", F.lit(0))
    got = sentences.sentence_units(d)
    assert got.columns == ["doc_id", "unit", "start_pos", "end_pos", "sentence"]
    assert sorted((r["doc_id"], r["end_pos"]) for r in got.collect()) == [(1, 4), (1, 4), (1, 9), (1, 9), (4, 199_999)]
    assert sentences.sentence_units(spark.createDataFrame([], DOC)).count() == 0


def plain_held(doc, item):
    d, q = leakage.words(doc or ""), leakage.words(item or "")
    runs = any(d[i : i + 13] == q[j : j + 13] for i in range(len(d) - 12) for j in range(len(q) - 12)) if len(q) >= 13 else False
    return runs


def test_runs_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("red blue kite stone tower river walks 3 12 7 900 over under".split())
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 40)))) for i in range(12)] + [(98, None), (99, "")]
    docs = [(100, None), (101, "")]
    for i in range(80):
        q = rng.choice(items[:12])[1].split()
        a = rng.randrange(len(q))
        part = q[a : a + rng.randint(5, 30)]
        docs.append((i, " ".join([*(word() for _ in range(20)), *part, *(word() for _ in range(20))])))
    d = spark.createDataFrame(docs, DOC).withColumn("i", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id bigint, question string").withColumn("text", F.lit(1))
    got = leakage.leaked_items(d, it)
    want = {(k, i) for k, t in docs for i, q in items if plain_held(t, q)}
    assert {(r["doc_id"], r["item_id"]) for r in got.where("run").collect()} == want and want
    twice = leakage.leaked_items(d.unionByName(d), it.unionByName(it)).where("run").collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in twice) == sorted(want)


def test_passages_against_a_plain_search(spark):
    """Every item is looked for in every document; the join may lose none, whatever the rarity of its words."""
    rng = random.Random(12)
    word = lambda: rng.choice("red blue kite stone tower river walks 3 12 7 900 over under the a of".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 6, 12, 20, 40])))) for i in range(25)]
    docs = []
    for i in range(150):
        q = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, len(q) // 3)):
            at = rng.randrange(len(q))
            q[at : at + 1] = rng.choice([[word()], [], [q[at], word()]])
        docs.append((i, " ".join([*(word() for _ in range(rng.choice([0, 5, 300]))), *q, *(word() for _ in range(rng.choice([0, 5, 300])))])))
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id bigint, question string")).where("passage").collect()}
    want = {(k, i) for k, t in docs for i, q in items if leakage.holds_passage(t.split(), q.split())}
    assert got == want and want


def test_passages(spark):
    q = "A ladder with 615 rungs leans at Foxglove Lane, where Amarit climbs 9 rungs, slips 13, and hands 326 silver bricks down to Bettan near 88 ropes."
    edited = q.replace("leans", "stands").replace("climbs", "goes").replace("silver", "then silver").replace("near", "by")
    numbers = edited.replace("326", "327")
    docs = spark.createDataFrame([(1, "Before 4. " + edited + " After 5."), (2, numbers), (3, " ".join(edited.split()[:9])), (4, q.upper().replace(" ", "​ "))], DOC)
    got = {(r["doc_id"], r["run"], r["passage"]) for r in leakage.leaked_items(docs, spark.createDataFrame([(7, q)], "item_id bigint, question string")).collect()}
    assert {g[0] for g in got} == {1, 4} and (1, False, True) in got
    empty = spark.createDataFrame([], "item_id bigint, question string")
    assert leakage.leaked_items(docs, empty).count() == 0 and leakage.leaked_items(spark.createDataFrame([], DOC), empty).count() == 0


def check_packed(rows, sizes, capacity):
    used, places, got = {}, {}, {}
    for r in rows:
        used[r["container"]] = used.get(r["container"], 0) + r["tokens"]
        places.setdefault(r["container"], []).append((r["place"], r["offset"], r["tokens"]))
        got.setdefault(r["doc_id"], []).append((r["piece"], r["tokens"]))
    assert all(n <= capacity for n in used.values())
    for ps in places.values():
        at = 0
        for k, (place, offset, n) in enumerate(sorted(ps)):
            assert place == k and offset == at
            at += n
    for k, n in sizes.items():
        pieces = sorted(got.get(k, []))
        assert sum(x for _, x in pieces) == n and (len(pieces) == 1 or n > capacity or n == 0)
        assert all(x == capacity for _, x in pieces[:-1])
    return used


def test_packing(spark):
    rng = random.Random(6)
    sizes = {i: rng.choice([0, 1, 64, rng.randint(1, 64), rng.randint(1, 200)]) for i in range(3000)}
    d = spark.createDataFrame(list(sizes.items()), "doc_id bigint, tokens bigint")
    rows = packing.pack(d, capacity=64, open_bins=16).collect()
    used = check_packed(rows, sizes, 64)
    assert sum(used.values()) / (64 * len(used)) > 0.97
    again = packing.pack(d.repartition(7), capacity=64, open_bins=16).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint")).count() == 0


def test_groups_share_a_bounded_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "CONTAINERS_PER_GROUP", 5)
    d = spark.range(2000).selectExpr("id as doc_id", "id % 60 + 1 as tokens")
    few, many = packing.pack(d, capacity=64, most_parts=3), packing.pack(d, capacity=64, most_parts=10_000)
    assert few.rdd.getNumPartitions() == 3 and many.rdd.getNumPartitions() > 100
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_best_fit_closes_the_fullest():
    b = packing.Bins(10, 2)
    assert [b.place(n)[0] for n in (6, 5, 4, 7)] == [0, 1, 0, 2]
    # bins 1 (5 free) and 2 (3 free) are open; 6 fits neither, so the fuller one, 2, is closed
    assert b.place(6)[0] == 3 and b.place(3)[0] == 3 and b.place(5)[0] == 1


def test_token_counts(spark):
    d = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "é 中文 " * 5000)], DOC)
    got = {r["doc_id"]: r["tokens"] for r in packing.token_counts(d).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 5000
