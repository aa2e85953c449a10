from pairloom.llm.question import strip_template


def test_a_request_behind_a_long_template_comes_off():
    q = "How many kites has Ann, who had 40 of them and gave some away, " + "then bought a few more, " * 10 + "if 12 are left?"
    head = "<|im_start|>system\nPlease reason step by step, and put your final answer within the box, and nothing else beside it.<|im_end|>\n<|im_start|>user\n"
    end = "<|im_end|>\n<|im_start|>assistant\n"
    assert strip_template(head + "Please answer in Spanish. " + q + end) == q
    assert strip_template(head + q + " Please answer in Spanish." + end + " " * 150) == q
    assert strip_template(q + "\n请用中文回答。" + "\n\nLet's think step by step." * 6) == q
