"""The answer cascade, LaTeX normal forms, extractors and graders by dataset."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import answers as A, equality as E, text as T
from ..plans.registry import Catalog
from ..sources.tables import table

C = Catalog()

_W = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def plain_sql(source: str, keys: str) -> str:
    """SQL for the plain form of s0: one column a step (@ stands for the one before), as the specification lists them."""
    head = r"split_part(@, '\text{', 1)"
    steps = [
        f"replace({_strip('@')}, chr(10), '')",
        r"regexp_replace(@, '\.+$', '')",
        r"replace(@, '\!', '')",
        r"CASE WHEN starts_with(@, '\text{') AND ends_with(@, '}') THEN @[7:len(@) - 1] ELSE @ END",
        "replace(replace(replace(@, 'tfrac', 'frac'), 'dfrac', 'frac'), 'cfrac', 'frac')",
        r"replace(replace(@, '\left', ''), '\right', '')",
        rf"CASE WHEN contains(@, '\text{{') AND ends_with(@, '}}') AND trim({head}) <> '' THEN trim({head}) ELSE @ END",
        _strip(r"replace(@, '^{\circ}', '')"),
        _strip(r"replace(@, '^\circ', '')"),
        _strip(r"regexp_replace(@, '\{(c|m)?m\}(\^(2|3))?', '', 'g')"),
        _strip(r"regexp_replace(@, 'p\.m\.$', '')"),
        _strip(r"regexp_replace(@, '(\d)\s*t$', '\1')"),
        r"replace(replace(@, '\$', ''), '$', '')",
        r"replace(replace(@, 'x\in', ''), '\%', '%')",
        "replace(replace(@, ' .', ' 0.'), '{.', '{0.')",
        r"replace(replace(@, '\cdot', ''), 'infinity', '\infty')",
        r"CASE WHEN contains(@, '\infty') THEN @ ELSE replace(@, 'inf', '\infty') END",
        r"regexp_replace(replace(replace(@, '\mathbf', ''), '\mathrm', ''), '\\mbox\{.*?\}', '', 'g')",
        "CASE WHEN contains(@, 'i') THEN @ ELSE replace(@, 'j', 'i') END",
        r"regexp_replace(@, '(\d+)\.0+([^\d])', '\1\2', 'g')",
        r"regexp_replace(@, '(\d+)\.0+$', '\1')",
        "CASE WHEN starts_with(@, '.') THEN '0' || @ ELSE @ END",
        *(rf"regexp_replace(regexp_replace(@, '\\{f}(-?[0-9.a-zA-Z]+)', '\\{f}{{\1}}', 'g'), '\\{f}\s+(\w+)$', '\\{f}{{\1}}')" for f in ("sqrt", "tan")),
        "replace(@, ' ', '')",
        r"regexp_replace(regexp_replace(@, '\\frac([^{])([^{])', '\\frac{\1}{\2}', 'g'), '\\frac([^{])\{', '\\frac{\1}{', 'g')",
        r"regexp_replace(@, '^(0|-?[1-9]\d*)/(0|-?[1-9]\d*)$', '\\frac{\1}{\2}')",
        r"regexp_replace(@, '[\\,.]+$', '')",
    ]
    chained = ", ".join(f"{step.replace('@', f's{i}')} AS s{i + 1}" for i, step in enumerate(steps))
    return f"SELECT {keys}, s{len(steps)} AS plain FROM (SELECT *, {chained} FROM ({source}))"


#: Answers in many notations, made of an answer and its key; {} stands for the answer.
NOTATIONS = (
    "{}", "${}$", "\\text{{} kg}", "{} \\text{ kg}", "\\dfrac{}7", "\\frac1{}", "{}/7", "\\left({}, 3\\right)", "{}^{\\circ}", "{}\\%", ".{}", "{}.000", "\\sqrt{}", "\\tan x",
    "3 {cm}^2", "x\\in[{}, infinity)", "\\mathbf{{}}", "{} \\mbox{ units}", "2j + {}", "7 t", "\\!{},", "inf", "{}\n.", "\\frac{1}{{}}\\",
)


def _notation(key: Column, answer: Column) -> Column:
    form = F.get(F.array(*map(F.lit, NOTATIONS)), (key % len(NOTATIONS)).cast("int"))
    return F.replace(form, F.lit("{}"), answer)


_FORMS = "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in NOTATIONS) + "]"
_NOTED = f"SELECT problem_index, replace({_FORMS}[problem_index % {len(NOTATIONS)} + 1], '{{}}', answer) AS s0 FROM math_problem WHERE answer IS NOT NULL"


@C.add(plain_sql(_NOTED, "problem_index"))
def answer_plain(s, sf):
    """Every answer in one of the notations of NOTATIONS, and as it stands."""
    d = table(s, sf, "math_problem").where("answer is not null")
    return d.select("problem_index", A.plain_answer(_notation(F.col("problem_index"), F.col("answer"))).alias("plain"))


# a box runs to the brace that closes it: depths by a window over the characters of each piece
_BOXES = r"""SELECT pair_id, k, list_aggregate(list_transform(list_filter(list_zip(range(1, len(c) + 1), d), lambda z: z[2] < 0), lambda z: z[1]), 'min') AS e, piece FROM (
 SELECT pair_id, k, piece, c, list_transform(range(1, len(c) + 1), lambda i: len(list_filter(c[1:i], lambda v: v = '{')) - len(list_filter(c[1:i], lambda v: v = '}'))) AS d FROM (
 SELECT pair_id, piece, k, string_split(piece, '') AS c FROM (
 SELECT pair_id, unnest(string_split(chosen, 'boxed{')[2:]) AS piece, generate_subscripts(string_split(chosen, 'boxed{')[2:], 1) AS k FROM repo_train WHERE contains(chosen, 'boxed'))))"""
_LAST = r"list_extract(regexp_extract_all(replace(chosen, ',', ''), '-?\d*\.?\d+'), -1)"
_RAW = rf"""SELECT pair_id, CASE WHEN piece[e + 1] = '%' THEN piece[1:e] ELSE piece[1:e - 1] END AS raw FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY k DESC) AS rn FROM ({_BOXES}) WHERE e IS NOT NULL) WHERE rn = 1
UNION ALL SELECT pair_id, '' FROM repo_train WHERE contains(chosen, 'boxed') AND pair_id NOT IN (SELECT pair_id FROM ({_BOXES}) WHERE e IS NOT NULL)
UNION ALL SELECT pair_id, CASE WHEN contains(chosen, 'he answer is') THEN string_split(chosen, 'he answer is')[-1]
 WHEN contains(chosen, '```output') AND {_strip("split_part(string_split(chosen, '```output')[-1], '```', 1)")} <> '' THEN split_part(string_split(chosen, '```output')[-1], '```', 1)
 ELSE coalesce({_LAST}, '') END FROM repo_train WHERE chosen IS NOT NULL AND NOT contains(chosen, 'boxed')"""
_TIDY = f"SELECT pair_id, regexp_replace(regexp_replace(regexp_replace({_strip('raw')}, '^:+', ''), '\\.+$', ''), '/+$', '') AS s0 FROM ({_RAW})"


@C.add(plain_sql(_TIDY, "pair_id"))
def extract_cascade(s, sf):
    return table(s, sf, "repo_train").where("chosen is not null").select("pair_id", A.stated_answer(F.col("chosen")).alias("plain"))


@C.add(r"""SELECT problem_index, CASE problem_index % 4 WHEN 0 THEN (problem_index % 9) || '|' || (problem_index % 5 + 1) WHEN 1 THEN (problem_index % 9) || '|x'
 WHEN 2 THEN '(1,' || (problem_index % 9) || ')' ELSE (problem_index % 9) || ',' || (problem_index % 5 + 1) END AS answers FROM math_problem""")
def math_answer_split(s, sf):
    """Lists are split on commas where the question asks for them, on 'and' anywhere, and never inside brackets."""
    p = F.col("problem_index")
    k, a, b = p % 4, (p % 9).cast("string"), (p % 5 + 1).cast("string")
    q = F.when(k.isin(0, 2), F.lit("Give them separated by commas.")).otherwise(F.lit("Give them."))
    body = F.when(k == 1, F.concat(a, F.lit(" \\text{ and } x"))).when(k == 2, F.concat(F.lit("(1, "), a, F.lit(")"))).otherwise(F.concat(a, F.lit(", "), b))
    text = F.concat(F.lit("So we get \\boxed{"), body, F.lit("}."))
    return table(s, sf, "math_problem").select("problem_index", F.array_join(A.math_answers(q, text), "|").alias("answers"))


_SHAPES = (
    "Thus 12 and {} remain. Problem: 99", "It is {}. Q: What of 5?", "答案是 {}。\n再看 3", "The final answer is (B). Problem: C", "So the final answer is {}. I hope it is correct. Problem: 5",
    " theorem {} Informal: more", "The answer is: {}", "问题：{} 问题 1", "the final answer is d", "nothing here",
)
_SHAPE_SQL = "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in _SHAPES) + "]"
#: What each extractor makes of each shape, by the specification; {} stands for the number.
_EXPECTED = {
    "math_few_shot": ("{}", "5", "3", "", "{}", "{}", "{}", "1", "", ""),
    "last_single": ("99", "5", "3", "", "5", "{}", "{}", "1", "", ""),
    "gsm_few_shot": ("99", "{}.", "3", "[invalid]", "5", "{}", "{}", "1", "[invalid]", "[invalid]"),
    "gaokao_cloze": ("placeholder", "placeholder", "{}。", *["placeholder"] * 7),
    "gaokao_mathqa": ("placeholder", "placeholder", "{}。", *["placeholder"] * 7),
    "sat": (*["placeholder"] * 3, "B", *["placeholder"] * 4, "D", "placeholder"),
    "ocw": (*["[invalid]"] * 4, "{}", *["[invalid]"] * 5),
    "mmlu_stem": (*["placeholder"] * 3, "B", *["placeholder"] * 4, "D", "placeholder"),
    "minif2f": tuple(x.split("Informal:")[0].strip() for x in _SHAPES),
    "cmath": ("99", "5", "{}", "", "5", "{}", "{}", "", "", ""),
}
_EXPECTED_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS extractor, [{', '.join(repr(v) if chr(10) not in v else (chr(39) + v.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39)) + chr(39)) for v in values)}] AS want"
    for name, values in _EXPECTED.items()
)


@C.add(f"""SELECT log_id, extractor, replace(want[log_id % {len(_SHAPES)} + 1], '{{}}', CAST(log_id % 800 + 100 AS VARCHAR)) AS answer FROM eval_log, ({_EXPECTED_SQL})""")
def dataset_extractors(s, sf):
    """Each extractor on texts of each dataset's shape, with a number of the row in it."""
    n = (F.col("log_id") % 800 + 100).cast("string")
    shape = F.get(F.array(*map(F.lit, _SHAPES)), (F.col("log_id") % len(_SHAPES)).cast("int"))
    d = table(s, sf, "eval_log").select("log_id", F.replace(shape, F.lit("{}"), n).alias("t"))
    found = [F.struct(F.lit(k).alias("extractor"), F.array_join(f(F.lit(""), F.col("t")), "|").alias("answer")) for k, f in A.EXTRACTORS.items()]
    return d.select("log_id", F.inline(F.array(*found)))


_PAIRS = (
    ("{v}", "{v}.0004", True), ("{v}00", "{v}", True), ("({v}, {w})", "({v},{w})", True), ("[{v},{w}]", "[{v}1,{w}]", False),
    ("\\begin{pmatrix}{v} & {w} \\\\ 1 & 2\\end{pmatrix}", "\\begin{bmatrix}{v}.0 & {w}\\\\1 & 2\\end{bmatrix}", True), ("x = {v}", "{v}", True), ("x={v}", "y={v}1", False),
    ("x - {v} = 0", "{v} - x = 0", True), ("\\frac{{v}}{4}", "{v}/4", True), ("x^2 + 2x + 1 + {v}", "(x+1)^2+{v}", True), ("{v}\\%", "0.{v}", True), ("{v}", "{v}1", False),
    ("\\sqrt{{v}}", "{v}^{0.5}", True), ("{v}x", "{v}y", False), ("2^{216}", "{v}", False), ("", "{v}", False), ("\\frac{\\pi}{{v}}", "\\pi/{v}", True), ("{v},000", "{v}000", True),
)


def _filled(forms: Column, key: Column) -> Column:
    at = F.get(forms, (key % len(_PAIRS)).cast("int"))
    return F.replace(F.replace(at, F.lit("{v}"), (key % 89 + 11).cast("string")), F.lit("{w}"), (key % 7 + 1).cast("string"))


@C.add(f"SELECT problem_index, answer IS NOT NULL AND [{', '.join(str(x[2]).lower() for x in _PAIRS)}][problem_index % {len(_PAIRS)} + 1] AS same FROM math_problem")
def math_equal_full(s, sf):
    """Numbers, percentages, tuples, matrices, equations and formulas; a problem without an answer equals nothing."""
    p = F.col("problem_index")
    a, b = (_filled(F.array(*[F.lit(x[k]) for x in _PAIRS]), p) for k in (0, 1))
    d = table(s, sf, "math_problem").select("problem_index", F.when(F.col("answer").isNotNull(), a).alias("a"), b.alias("b"))
    return d.select("problem_index", E.math_equal_full(F.col("a"), F.col("b")).alias("same"))


_LISTS = (
    ("math", ["1", "{v}", "{v}", "3"], ["3", "{v}.0", "3"], True), ("math", ["3"], ["3", "{v}"], False), ("math", ["(0,1)\\cup(2,{v})"], ["(2,{v})\\cup(0,1)"], True),
    ("last_single", ["9", "{v}"], ["{v}"], True), ("last_single", [], ["{v}"], False), ("cloze", ["x; (1, 2), {v}"], ["(1,2)", "{v}"], True), ("cloze", ["1"], ["1", "{v}"], False),
    ("choice", ["B or A"], ["A"], True), ("choice", ["none of it"], ["A"], False), ("sat", ["b"], ["B"], True), ("sat", ["c"], ["B"], False), ("course", ["{v} kg"], ["{v}"], True),
    ("course", ["\\[y = {v} x\\]"], ["$y={v} x$"], True), ("course", ["a square of {v} units"], ["of{v}"], True), ("course", ["1.5e2"], ["150"], True), ("course", ["{v}"], ["1{v}"], False),
    ("minif2f", [""], ["{v}"], True), ("math", [], [], False),
)


@C.add(f"""SELECT log_id, [{', '.join(repr(x[0]) for x in _LISTS)}][log_id % {len(_LISTS)} + 1] AS grader, [{', '.join(str(x[3]).lower() for x in _LISTS)}][log_id % {len(_LISTS)} + 1] AS correct FROM eval_log""")
def grade_lists(s, sf):
    """Every grader on lists of predictions and references."""
    k, v = (F.col("log_id") % len(_LISTS)).cast("int"), (F.col("log_id") % 89 + 11).cast("string")
    arrays = lambda i: F.array(*[F.array(*map(F.lit, x[i])).cast("array<string>") for x in _LISTS])
    fill = lambda i: F.transform(F.get(arrays(i), k), lambda x: F.replace(x, F.lit("{v}"), v))
    grader = F.get(F.array(*[F.lit(x[0]) for x in _LISTS]), k)
    d = table(s, sf, "eval_log").select("log_id", grader.alias("grader"), fill(1).alias("p"), fill(2).alias("r"))
    # each grader sees the rows that are its own
    own = lambda g, c: F.when(F.col("grader") == g, F.col(c))
    return d.select("log_id", "grader", F.exists(F.array(*[E.graded(own(g, "p"), own(g, "r"), g) for g in E.GRADERS]), lambda x: x).alias("correct"))


@C.add("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS same, CAST(o_orderkey % 50 + 1 AS DOUBLE) AS value FROM orders""")
def course_numbers(s, sf):
    """Values with units; relatively close values are equal, others are not, and about zero only within a share."""
    k, v = F.col("o_orderkey") % 4, (F.col("o_orderkey") % 50 + 1).cast("string")
    a = F.concat(v, F.when(k == 0, " kg m/s").when(k == 1, "\\mathrm{~m}").when(k == 2, "\\mathrm{~g}").otherwise(" W"))
    b = F.when(k == 0, F.concat(v, F.lit(".000001"))).when(k == 1, F.concat(v, F.lit(".1"))).when(k == 2, F.concat(F.lit("$"), v, F.lit("$"))).otherwise(F.lit("0"))
    value, same = E.on_text(E.course_number), E.on_pairs(lambda x, y: E.numbers_equal(E.course_number(x), E.course_number(y)))
    d = table(s, sf, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))
    return d.select("o_orderkey", same("a", "b").alias("same"), value("a").alias("value"))


@C.add("""SELECT problem_index, split_part(coalesce(response, ''), 'Step 1', 1) AS head, CASE WHEN problem_index % 2 = 0 THEN CAST(problem_index AS BIGINT) END AS number,
 CASE WHEN problem_index % 2 = 0 THEN md5('So it is.' || chr(10) || 'The answer is: \\boxed{{' || problem_index || ' kites}}') END AS rewritten FROM math_problem""")
def answer_rewrite(s, sf):
    """The text before a step, the number after a trigger, and an answer put into a box; rows without a trigger drop out of both."""
    p = F.col("problem_index").cast("string")
    text = F.when(F.col("problem_index") % 2 == 0, F.concat(F.lit("So it is.\nThe answer is: "), p, F.lit(" kites\n"))).otherwise(F.concat(F.lit("It is "), p))
    d = table(s, sf, "math_problem").select("problem_index", "response", text.alias("t"))
    head = A.split_first(F.coalesce("response", F.lit("")), "Step 1")
    return d.select("problem_index", head.alias("head"), A.split_answer(F.col("t")).alias("number"), F.md5(A.rewritten_answer(F.col("t"))).alias("rewritten"))


@C.add("""SELECT problem_index, md5(concat_ws(chr(10), 'def f(x):', '    \"\"\"comments\"\"\"', '    # comments', '', '    return x + ' || problem_index, '')) AS code FROM math_problem""")
def code_comments(s, sf):
    lines = ["def f(x):", '    """Adds."""', "    # one more", '    """', "    Longer # text", '    of it."""']
    code = F.concat(F.lit("\n".join(lines) + "\n    return x + "), F.col("problem_index").cast("string"), F.lit("\n"))
    return table(s, sf, "math_problem").select("problem_index", F.md5(A.without_comments(code)).alias("code"))


@C.add("""SELECT problem_index, CASE problem_index % 3 WHEN 0 THEN CAST(problem_index AS VARCHAR) || '.5' WHEN 1 THEN 'x + ' || problem_index ELSE 'a, b' || problem_index END AS form FROM math_problem""")
def prediction_form(s, sf):
    k, p = F.col("problem_index") % 3, F.col("problem_index").cast("string")
    raw = F.when(k == 0, F.concat(p, F.lit(".5"))).when(k == 1, F.concat(F.lit("[(x + "), p, F.lit(")]"))).otherwise(F.concat(F.lit("({a}, b"), p, F.lit(")")))
    return table(s, sf, "math_problem").select("problem_index", E.peeled(raw).alias("form"))


@C.add("""SELECT problem_index, 'a|(b, ' || problem_index || ')|c' AS parts, 'out ' || problem_index AS output, 'body <pad> ' || problem_index AS bare FROM math_problem""")
def text_tools(s, sf):
    """Parts outside brackets, the last fenced output, and repeats of a token off both ends."""
    p = F.col("problem_index").cast("string")
    parts = F.array_join(T.split_outside_brackets(F.concat(F.lit("a, (b, "), p, F.lit("); c"))), "|")
    output = F.concat(F.lit("x\n```output\nfirst\n```\nthen\n```output\nout "), p, F.lit("\n```\nend"))
    padded = F.concat(F.lit("<pad><pad>body <pad> "), p, F.lit("<pad>"))
    return table(s, sf, "math_problem").select("problem_index", parts.alias("parts"), A.program_output(output).alias("output"), T.strip_tokens(padded, "<pad>").alias("bare"))
