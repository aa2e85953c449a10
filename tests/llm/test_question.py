from pairloom.llm.question import credit_parts, requested_language, strip_template, tokens

CONTESTS = [(1, "HLMI", "Harrow Lake Invitational"), (2, "FEMO", "Fenmark Olympiad")]


def test_templates_come_off():
    q = "How many kites has Ann?"
    for p in (
        q, f"Problem:\n{q}\n\nSolution:\n", f"[INST] {q} [/INST]", f"<|im_start|>system\nPlease reason.<|im_end|>\n<|im_start|>user\n{q}<|im_end|>\n<|im_start|>assistant\n",
        f"Question: {q}\nAnswer: ", f"HUMAN:  {q}\n\nASSISTANT:", f"Please answer in German.\n\nProblem:\n{q}\n\nSolution:\n", f"Solve  the following\nproblem carefully.\n\n{q}\n\nGive the final answer after \"The answer is:\".",
        f"Below is a task that describes a problem. Write a response that completes it.\n\n### Instruction:\n{q}\n\n### Response: Let's think step by step.", f"​{q}﻿",
    ):
        assert strip_template(p) == q, p
    assert strip_template(None) == strip_template("") == strip_template("[INST]  [/INST]") == ""


def split(text):
    known = {name.lower(): k for k, *names in CONTESTS for name in names}
    got = next(((rest, f"{known[name]}:{problem}") for rest, name, problem in credit_parts(text) if name in known), None)
    return got or (text, None)


def test_credits_in_every_form():
    for text in ("[HLMI 1996 #18]", "(Harrow Lake Invitational 1996, Problem 18)", "(from the 1996 Harrow  Lake Invitational, question 18)", "Source: Harrow Lake Invitational, 1996, no. 18.", "— HLMI ’96, Q18", "(HLMI-96-18)", "[HARROW LAKE INVITATIONAL / 1996 / P18]"):
        assert split(f"What is 3? {text}") == ("What is 3?", "1:1996:18"), text
        assert split(f"{text}\nWhat is 3?") == ("What is 3?", "1:1996:18"), text
    assert split("What is 3? (FEMO-05-07)")[1] == "2:2005:7"
    assert split("Walk to Harrow Lake in 1996.") == ("Walk to Harrow Lake in 1996.", None)
    assert split("What is 3? [NONE 1996 #18]")[1] is None


def test_a_credit_may_be_of_any_length():
    name = "the very long name of a contest " * 8
    assert ("What is 3?", name.strip(), "1996:18") in credit_parts(f"What is 3? ({name}, {' ' * 200} 1996, Problem 18)")


def test_tails_may_be_spread_over_white_space():
    assert strip_template("What is 3?" + "\n" * 100 + "Let's" + " " * 90 + "think step by step." + " " * 99) == "What is 3?"


def test_languages():
    assert requested_language("Please answer in German.\n\nWas ist das?") == "de"
    assert requested_language("Responde en inglés. ¿Qué?") == "en"
    assert requested_language("A German walks in the park.") is None and requested_language(None) is None


def test_tokens():
    assert tokens("f(n) = 9n^2 + 36.95, IT's 云舟25个") == ["f", "n", "9", "n", "2", "36.95", "it", "s", "云", "舟", "25", "个"]
    assert tokens("1,000 12,345,678.5 1,00 (3,4) 1234,567") == ["1000", "12345678.5", "1,00", "3,4", "1234,567"]
