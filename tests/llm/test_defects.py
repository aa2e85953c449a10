import random

import pytest
from pyspark.sql import functions as F

from pairloom.llm import defects, terminal
from pairloom.llm.language import language, refuses

SCHEMA = "pair_id bigint, data_source string, prompt string, chosen string, rejected string"
QUESTION = "The school in Farholt orders 414 dominoes and 86 buttons for 21 pupils, and Kelvar pays 25.85 dollars in advance. How many dominoes are left?"


@pytest.mark.parametrize("value", [None, "", " \n", "​", "<think>\n\n</think>\n", "\\boxed{}", "<answer> </answer>", "<|im_start|>assistant\n<|im_end|>", "  "])
def test_empty_values(value):
    assert defects.is_empty(value)


def test_not_empty():
    assert not defects.is_empty("5") and not defects.is_empty("\\boxed{5}") and not defects.is_empty("<think>a</think>")


@pytest.mark.parametrize(
    "text,kind",
    [
        ('{"a": 1, "b": "x', "json"), ('{"a": 1, "b": "x"}', "whole"), ("<think>\nso it is 5.", "think"), ("<think>so</think> It is so.", "whole"), ("```python\na = 1\n", "code"), ("```python\na = 1\n```", "whole"),
        ("we get $3k =", "formula"), ("This is th…", "mark"), ("This is [truncated]", "mark"), ("This is th <cut>", "mark"), ("All is well.", "whole"), ("很抱歉。", "whole"), ("The cost is 46.", "open"), ("Yours,\nTorvi", "open"), ("and then th", "open"),
    ],
)
def test_states(text, kind):
    assert terminal.state(terminal.bare(text))[0] == kind


def test_languages_and_refusals():
    assert language("We divide both sides by 7 and this leaves the number of kites for the rest.") == "en"
    assert language("Dann ziehen wir die verlorenen ab und das ist der Wert.") == "de"
    assert language("因此小岚还剩下530个梨") == "zh" and language("") is None and language("12 34") is None
    assert refuses("I'm sorry, but I can't help with this request.") and refuses("很抱歉，我无法回答这个问题。")
    assert not refuses("I cannot help smiling at this one: 5 + 5 = 10.")
    assert refuses("I cannot help with problem 3.") and refuses("I must pass on this one. " + "Please ask a teacher about it instead. " * 30)
    assert not refuses("I cannot help smiling at this one. This means that 597 violin string")
    assert refuses("Desculpe, mas não posso responder a esta pergunta.") and refuses("Извините, но я не могу ответить на этот вопрос.") and refuses("申し訳ありませんが、この質問にはお答えできません。")
    assert language("Мы делим обе стороны на семь и получаем ответ.") == "ru" and language("まず、両辺を七で割ると、答えが出ます。") == "ja" and language("日本語の回答をここに示します。") == "ja"
    assert language("Então, primeiro há mais para cada uma das caixas, mas não são as outras.") == "pt" and language("Allora il numero delle scatole è più di quello che si vede, ma non sono tutte.") == "it"


def test_marks_and_sign_offs_of_any_length():
    assert terminal.state("So we get to the [output truncated since the limit of tokens was reached at this point]")[0] == "mark"
    assert terminal.state("The paper is folded (see below)")[0] == "open" and terminal.state("and so\\u00")[0] == "mark"
    name = "Ab" + "c" * 200
    assert defects.signed(f"That is all.\n\nBest regards,\n{name}", ["ask", name.lower() + "."]) and not defects.signed(f"Best regards,\n{name}", ["ask"])
    assert len(terminal.tail("so it is " + "1" * 5000, 5009)) > 200


def test_structures_are_signs_of_the_context():
    assert terminal.structures("we pay $5 and $6 more") == [(10 - 3, 14, 4)] and terminal.structures('{"a": 1}') == [(0, 7, 1)]
    plain, within = terminal.end_contexts(["so it is"], [0]), terminal.end_contexts(["so it is"], [2])
    assert (plain != within).all() and (terminal.end_contexts(["so it is"]) == plain).all()


def test_copies():
    q = QUESTION.lower().split()
    assert defects.copies_question(q, QUESTION.lower().replace("left", "there").split())
    assert not defects.copies_question(q, ("First we compute 97 + 346 = 443, which gives the number of green dominoes. " * 2).lower().split())
    assert not defects.copies_question([], [])
    assert defects.copies_question(q, ["again:"] + q + q) and defects.copies_question(q, q * 5)
    assert not defects.copies_question(q, q + "i would say that the pupils of this place share them out by colour first , then by size , and leave a good part of them for the next year , as kelvar wished".split())


def test_continuations_against_plain_counts():
    texts = ["ab12 cd", "ab 7 cde", "x", ""]
    ends = terminal.end_contexts([t for t in texts if t])
    import numpy as np

    wanted = [terminal.Wanted(np.unique(ends[:, k])) for k in range(len(terminal.ORDERS))]
    got = {k: int(n.sum()) for k, _, n in terminal.continuations(iter([[t for t in texts if t]]), wanted)}
    # of order 2 the context cd goes on once (cde); longer wanted contexts go on nowhere
    assert got[2] >= 1 and got[10] == 0


def sentences(rng):
    names, things = ["Torvi", "Kelvar", "Osha", "Petra"], ["kites", "plums", "tiles", "ropes"]
    lines = [f"Now add the {rng.randint(1, 99)} {rng.choice(things)} that {rng.choice(names)} brought, so {rng.randint(1, 99)} remain.", f"Dividing both sides by {rng.randint(2, 9)} leaves the number of {rng.choice(things)} for the rest."]
    return " ".join(rng.choice(lines) for _ in range(rng.randint(2, 6))) + f" The answer is: {rng.randint(1, 999)}"


def test_held_out_truncation(spark):
    rng = random.Random(5)
    rows, cut = [], set()
    for i in range(600):
        c, r = sentences(rng), sentences(rng)
        if i % 10 == 0:
            at = rng.randrange(30, len(c) - 25)
            while not (c[at - 1].isalpha() and c[at].isalpha()):
                at -= 1
            c = c[:at]
            cut.add((i, "chosen"))
        rows.append((i, "a" if i % 2 else None, QUESTION, c, r))
    d = spark.createDataFrame(rows, SCHEMA).withColumn("lang", F.lit("clash")).withColumn("kind", F.lit(1))
    got = {(r["pair_id"], r["field_name"]) for r in defects.defective_pairs(d).where("defect = 'truncated'").collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 3
    report = {r["data_source"]: r for r in defects.truncation_report(d).collect()}
    assert report[None]["values"] == 600 and report["a"]["truncated"] + report[None]["truncated"] == len(got)


def test_kinds_and_nulls(spark):
    rows = [
        (1, "s", QUESTION, None, "I'm sorry, but I can't help with this request."),
        (2, None, QUESTION, QUESTION, "Dann ziehen wir die 5 verlorenen ab und das ist der Wert von 12 Teilen. Die Antwort ist damit klar."),
        (3, "s", None, "Any text that stands here is fine.", ""),
        (4, "s", "Please answer in German.\n\n" + QUESTION, "Dann ziehen wir die 5 verlorenen ab und das ist der Wert von 12 Teilen. Die Antwort ist damit klar.", "x " * 60_000 + "end."),
    ]
    got = {(r["pair_id"], r["field_name"]): r["defect"] for r in defects.defective_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, "chosen"): "empty", (1, "rejected"): "refusal", (2, "chosen"): "copies_question", (2, "rejected"): "other_language", (3, "rejected"): "empty"}


def test_empty_table(spark):
    assert defects.defective_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wanted_contexts_are_found_exactly():
    import numpy as np

    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, 5000), np.arange(50)]))  # the last share a slot
    w = terminal.Wanted(keys)
    assert (w.find(keys) == np.arange(len(keys))).all() and (w.find(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    few = np.unique(keys >> (63 - terminal.BITS))
    assert (terminal.Wanted(few, 63 - terminal.BITS).find(keys) >= 0).all()
