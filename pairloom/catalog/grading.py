"""Extraction and grading of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import Catalog
from ..sources.tables import table

C = Catalog()
_TRIG = r"The answer is:\s*[''\"]?([^\n.]+?)[''\"]?(?:[\n.]|$)"
# a box with at most one level of braces inside, as nested alternatives of RE2
_BOX = r"\\boxed\s*\{((?:[^{}]|\{[^{}]*\})+)\}"
_BARE = "regexp_replace(trim(v), '(?s)^\\{(.*)\\}$', '\\1')"
_FIRST = "list_filter(a, lambda v, i: list_position(a, v) = i)"


@C.add(f"""WITH x AS (SELECT log_id, regexp_extract_all(generation, '{_TRIG}', 1) AS t, regexp_extract_all(generation, '{_BOX}', 1) AS b FROM eval_log)
SELECT log_id, coalesce(nullif(trim(t[-1]), ''), trim(list_transform(b, lambda v: {_BARE})[-1])) AS answer FROM x""")
def extract_last(s, sf):
    return table(s, sf, "eval_log").select("log_id", T.last_answer(F.col("generation")).alias("answer"))


@C.add(f"""WITH x AS (SELECT pair_id, list_filter(list_transform(list_concat(regexp_extract_all(chosen, '{_TRIG}', 1),
 list_transform(regexp_extract_all(chosen, '{_BOX}', 1), lambda v: {_BARE})), lambda v: trim(v)), lambda v: v <> '') AS a FROM repo_train WHERE chosen IS NOT NULL)
SELECT pair_id, CASE WHEN len(a) > 0 THEN array_to_string({_FIRST}, '|') END AS answers FROM x""")
def extract_all(s, sf):
    d = table(s, sf, "repo_train").where("chosen is not null")
    return d.select("pair_id", F.array_join(T.all_answers(F.col("chosen")), "|").alias("answers"))


@C.add(f"""WITH x AS (SELECT pair_id, list_filter(list_transform(regexp_extract_all(chosen, '{_TRIG}', 1), lambda v: trim(v)), lambda v: v <> '') AS a
 FROM repo_train WHERE chosen IS NOT NULL) SELECT pair_id, CASE WHEN len(a) > 0 THEN array_to_string({_FIRST}, '|') END AS answers FROM x""")
def extract_triggered(s, sf):
    d = table(s, sf, "repo_train").where("chosen is not null")
    return d.select("pair_id", F.array_join(T.all_answers(F.col("chosen"), with_boxed=False), "|").alias("answers"))


@C.add(r"""SELECT log_id, TRY_CAST(nullif(list_extract(regexp_extract_all(generation, 'The answer is:\s*([-+]?\d+(?:\.\d+)?)', 1), -1), '') AS DOUBLE) AS value FROM eval_log""")
def extract_numeric(s, sf):
    return table(s, sf, "eval_log").select("log_id", T.last_number(F.col("generation")).alias("value"))


@C.add(r"""WITH x AS (SELECT pair_id, CASE pair_id % 5 WHEN 0 THEN 'So \(\boxed{' || pair_id || '.5 kg}\). Therefore, the answer is: -7'
 WHEN 1 THEN 'Therefore, the answer is: about ' || pair_id || '. Or \(\boxed{3}\)' WHEN 2 THEN '\boxed{3}. Therefore, the answer is: ' || pair_id
 WHEN 3 THEN 'Therefore, the answer is: none' || chr(10) || pair_id ELSE coalesce(chosen, '') END AS t FROM repo_train),
p AS (SELECT pair_id, instr(t, regexp_extract(t, '\\\(\\boxed\{.*?\}\\\)')) * CAST(regexp_matches(t, '\\\(\\boxed\{.*?\}\\\)') AS INT) AS a,
 regexp_extract(t, '\\\(\\boxed\{(.*?)\}\\\)', 1) AS av, instr(t, 'Therefore, the answer is: ') AS b, regexp_extract(t, 'Therefore, the answer is: ([^.\n]+)', 1) AS bv FROM x)
SELECT pair_id, TRY_CAST(nullif(regexp_extract(CASE WHEN a > 0 AND (b = 0 OR a < b) THEN av WHEN b > 0 THEN bv ELSE '' END, '[0-9]+(\.[0-9]+)?'), '') AS DOUBLE) AS value FROM p""")
def extract_first_numeric(s, sf):
    """Both forms in either order, beside the texts themselves."""
    k, i = F.col("pair_id") % 5, F.col("pair_id").cast("string")
    t = (
        F.when(k == 0, F.concat(F.lit(r"So \(\boxed{"), i, F.lit(r".5 kg}\). Therefore, the answer is: -7")))
        .when(k == 1, F.concat(F.lit("Therefore, the answer is: about "), i, F.lit(r". Or \(\boxed{3}\)")))
        .when(k == 2, F.concat(F.lit(r"\boxed{3}. Therefore, the answer is: "), i))
        .when(k == 3, F.concat(F.lit("Therefore, the answer is: none\n"), i))
        .otherwise(F.coalesce("chosen", F.lit("")))
    )
    return table(s, sf, "repo_train").select("pair_id", T.first_number(t).alias("value"))


@C.add(r"""SELECT problem_index, trim(regexp_replace(answer, '\s+', '', 'g'), '''"') AS squeezed, TRY_CAST(CASE WHEN regexp_matches(trim(answer), '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$') THEN trim(answer) END AS DOUBLE) AS number FROM math_problem""")
def answer_normalise(s, sf):
    return table(s, sf, "math_problem").select("problem_index", T.squeeze(F.col("answer")).alias("squeezed"), T.python_float(F.col("answer")).alias("number"))


_NUM = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


@C.add(rf"""WITH x AS (SELECT log_id, extracted_last_answers AS a, gold_answers AS b, TRY_CAST(CASE WHEN regexp_matches(trim(extracted_last_answers), '{_NUM}') THEN trim(extracted_last_answers) END AS DOUBLE) AS x, TRY_CAST(CASE WHEN regexp_matches(trim(gold_answers), '{_NUM}') THEN trim(gold_answers) END AS DOUBLE) AS y FROM eval_log)
SELECT log_id, coalesce(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN abs(x - y) <= 1e-6 * greatest(abs(x), abs(y)) ELSE regexp_replace(a, '\s+', '', 'g') = regexp_replace(b, '\s+', '', 'g') END, false) AS same, coalesce(lower(trim(a)) = lower(trim(b)) OR abs(x - y) <= 1e-3 OR abs(x - y / 100) <= 1e-3 OR abs(x - y * 100) <= 1e-3, lower(trim(a)) = lower(trim(b)), false) AS math_same FROM x""")
def answer_equal(s, sf):
    a, b = F.col("extracted_last_answers"), F.col("gold_answers")
    return table(s, sf, "eval_log").select("log_id", T.answer_equal(a, b).alias("same"), T.math_equal(a, b).alias("math_same"))


_EQ = """CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN abs(x - y) <= 1e-6 * greatest(abs(x), abs(y)) ELSE regexp_replace(a, '\\s+', '', 'g') = regexp_replace(b, '\\s+', '', 'g') END"""


@C.add(f"""WITH v AS (SELECT log_id, model, gold_answers AS b, unnest(extracted_all_answers) AS a FROM eval_log),
n AS (SELECT *, TRY_CAST(trim(a) AS DOUBLE) AS x, TRY_CAST(trim(b) AS DOUBLE) AS y FROM v),
h AS (SELECT log_id, bool_or(coalesce({_EQ}, false)) AS eq, bool_or(coalesce({_EQ} OR abs(x - y) <= 1e-3 OR abs(x - y / 100) <= 1e-3 OR abs(x - y * 100) <= 1e-3, false)) AS math FROM n GROUP BY log_id),
l AS (SELECT log_id, model, gold_answers AS b, extracted_last_answers AS a, TRY_CAST(trim(extracted_last_answers) AS DOUBLE) AS x, TRY_CAST(trim(gold_answers) AS DOUBLE) AS y, len(extracted_all_answers) AS k FROM eval_log)
SELECT model, round(sum(CASE WHEN b IS NOT NULL AND a IS NOT NULL AND coalesce({_EQ}, false) THEN 1.0 ELSE 0 END) / nullif(count(*) FILTER (WHERE b IS NOT NULL AND a IS NOT NULL), 0), 6) AS v2,
 round(sum(CASE WHEN b IS NOT NULL AND eq THEN 1.0 ELSE 0 END) / nullif(count(*) FILTER (WHERE b IS NOT NULL AND k > 0), 0), 6) AS v3,
 round(sum(CASE WHEN b IS NOT NULL AND math THEN 1.0 ELSE 0 END) / nullif(count(b), 0), 6) AS v4
FROM l LEFT JOIN h USING (log_id) GROUP BY model""")
def grade_matchers(s, sf):
    """v2: the last answer; v3: any answer, both over what could be parsed; v4: any answer, mathematics too, over all labels."""
    e = table(s, sf, "eval_log")
    label, last, every = F.col("gold_answers"), F.col("extracted_last_answers"), F.col("extracted_all_answers")
    hit = lambda f: F.coalesce(F.exists(every, lambda v: f(v, label)), F.lit(False))
    both = lambda a, b: T.answer_equal(a, b) | T.math_equal(a, b)
    known, parsed = label.isNotNull(), label.isNotNull() & last.isNotNull()
    share = lambda on, of: F.round(F.try_divide(F.count_if(on), F.nullif(F.count_if(of), F.lit(0))), 6)
    return e.groupBy("model").agg(
        share(parsed & T.answer_equal(last, label), parsed).alias("v2"),
        share(known & hit(T.answer_equal), known & (F.size(every) > 0)).alias("v3"),
        share(known & hit(both), known).alias("v4"),
    )


@C.add(f"""WITH v AS (SELECT data_id, model, extracted_last_answers AS a, gold_answers AS b, log_id FROM eval_log), c AS (SELECT data_id, model, a, count(*) AS n, min(log_id) AS f FROM v WHERE a IS NOT NULL GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY data_id, model ORDER BY n DESC, f) AS rn FROM c), g AS (SELECT data_id, model, min(b) AS b FROM v GROUP BY ALL),
n AS (SELECT g.data_id, g.model, t.a, g.b, TRY_CAST(trim(t.a) AS DOUBLE) AS x, TRY_CAST(trim(g.b) AS DOUBLE) AS y FROM g LEFT JOIN t ON g.data_id = t.data_id AND g.model IS NOT DISTINCT FROM t.model AND rn = 1)
SELECT data_id, model, coalesce({_EQ} OR abs(x - y) <= 1e-3 OR abs(x - y / 100) <= 1e-3 OR abs(x - y * 100) <= 1e-3, false) AS correct FROM n""")
def grade_majority(s, sf):
    """v5: the most frequent last answer of a model's generations for an item against its label."""
    e = table(s, sf, "eval_log")
    votes = e.where("extracted_last_answers is not null").groupBy("data_id", "model", F.col("extracted_last_answers").alias("a")).agg(F.count("*").alias("n"), F.min("log_id").alias("f"))
    best = votes.groupBy("data_id", "model").agg(F.max_by("a", F.struct("n", -F.col("f"))).alias("a"))
    labels = e.groupBy("data_id", "model").agg(F.min("gold_answers").alias("b"))
    joined = labels.alias("l").join(best.alias("r"), F.expr("l.data_id = r.data_id and l.model <=> r.model"), "left").select("l.data_id", "l.model", "a", "b")
    return joined.select("data_id", "model", (T.answer_equal(F.col("a"), F.col("b")) | T.math_equal(F.col("a"), F.col("b"))).alias("correct"))


@C.add("""SELECT event_id, CASE WHEN value % 5 < 1 THEN NULL ELSE CAST(round_even(least(5, greatest(1, value % 7)), 0) AS INT) END AS rating FROM events""")
def parse_ratings(s, sf):
    v = F.col("value")
    shown = F.when(v % 5 < 1, F.lit("N/A")).otherwise((v % 7).cast("string"))
    out = F.concat(F.lit("#### Output for Text 1\nRating: "), shown, F.lit("\nRationale: fine\n"))
    return table(s, sf, "events").select("event_id", F.get(T.ratings(out), F.lit(0)).alias("rating"))


@C.add("""SELECT log_id, CASE WHEN greatest(instr(generation, 'A'), instr(generation, 'B'), instr(generation, 'C'), instr(generation, 'D')) = 0 THEN NULL WHEN instr(generation, 'D') = greatest(instr(generation, 'A'), instr(generation, 'B'), instr(generation, 'C'), instr(generation, 'D')) THEN 'D' WHEN instr(generation, 'C') = greatest(instr(generation, 'A'), instr(generation, 'B'), instr(generation, 'C')) THEN 'C' WHEN instr(generation, 'B') >= instr(generation, 'A') THEN 'B' ELSE 'A' END AS choice FROM eval_log""")
def answer_choice(s, sf):
    return table(s, sf, "eval_log").select("log_id", T.choice(F.col("generation")).alias("choice"))


@C.add(r"""SELECT pair_id, list_extract(regexp_extract_all(chosen, '(?s)```python\n(.*?)```', 1), -1) AS program FROM repo_train WHERE contains(chosen, '```python')""")
def extract_program(s, sf):
    return table(s, sf, "repo_train").where(F.contains(F.col("chosen"), F.lit("```python"))).select("pair_id", T.program(F.col("chosen")).alias("program"))


@C.add(rf"""SELECT pair_id, array_to_string(regexp_extract_all(chosen, '{_BOX}', 1), '|') AS boxed FROM repo_train WHERE contains(chosen, '\boxed{{')""")
def balanced_boxed(s, sf):
    # the Python step sees only the rows that have a box
    d = table(s, sf, "repo_train").where(F.contains(F.col("chosen"), F.lit("\\boxed{")))
    return d.select("pair_id", F.array_join(T.balanced_boxed("chosen"), "|").alias("boxed"))


_WHITE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@C.add(rf"""SELECT pair_id, CASE WHEN regexp_matches(chosen, 'The answer is: [^\n]+\n?$') OR regexp_matches(chosen, '\\boxed\{{[^{{}}]*\}}') THEN regexp_replace(chosen, '{_WHITE}+$', '') || ' </s>' ELSE chosen END AS text FROM repo_train""")
def eos_append(s, sf):
    return table(s, sf, "repo_train").select("pair_id", T.with_eos(F.col("chosen")).alias("text"))
