"""Prompt templates: chat formats times task styles, filled with columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The marks of public chat formats around a system text, a user turn and the assistant's opening.
FORMATS = {
    "chatml": "<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{task}<|im_end|>\n<|im_start|>assistant\n{opening}",
    "headers": "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{system}<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n{task}<|eot_id|>"
    "<|start_header_id|>assistant<|end_header_id|>\n\n{opening}",
    "tags": "<|system|>\n{system}<|end|>\n<|user|>\n{task}\n<|assistant|>\n{opening}",
    "sections": "{system}\n\n### Instruction:\n{task}\n\n### Response: {opening}",
}
#: Styles: the task around {input} or {instruction}, and how the answer opens. Doubled braces stand for single ones.
STYLES = {
    "plain": ("{input}", ""),
    "boxed": ("{instruction}\nPlease reason step by step, and put your final answer within \\boxed{{}}.", ""),
    "steps": ("{input}", "Let's think step by step.\nStep 1: "),
    "prefix": ("{input}\nState it after 'The answer is: '.", "Let's think step by step.\n{prefix}"),
}
SYSTEM = "You are a helpful assistant."


def template(name: str) -> str:
    """The template format-style; an unknown name is an error."""
    form, _, style = name.partition("-")
    if form not in FORMATS or style not in STYLES:
        raise ValueError(f"unknown template {name!r}")
    task, opening = STYLES[style]
    return FORMATS[form].replace("{task}", task).replace("{opening}", opening).replace("{system}", SYSTEM)


NAMES = [f"{f}-{s}" for f in FORMATS for s in STYLES]


def rendered(text: Column | str, **values: Column) -> Column:
    """A template with its variables filled in; a null value leaves an empty place. Braces inside values stay."""
    parts = F.lit(text) if isinstance(text, str) else text
    # braces of the template are set aside before values come in
    parts = F.replace(F.replace(parts, F.lit("{{"), F.lit("\u0001")), F.lit("}}"), F.lit("\u0002"))
    for name, value in values.items():
        parts = F.replace(parts, F.lit("{" + name + "}"), F.lit(f"\u0003{name}\u0004"))
    parts = F.replace(F.replace(parts, F.lit("\u0001"), F.lit("{")), F.lit("\u0002"), F.lit("}"))
    for name, value in values.items():
        parts = F.replace(parts, F.lit(f"\u0003{name}\u0004"), F.coalesce(value.cast("string"), F.lit("")))
    return parts
