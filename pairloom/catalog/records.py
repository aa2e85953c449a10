"""Records of benchmarks, judges and preference pipelines: adapters, lookups, regrouping, seeded choices."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import answers as N, arrays as A, equality as E, templates, text as T
from ..operators import order, preference as P
from ..plans import models
from ..plans.registry import Catalog
from ..sources.tables import table

C = Catalog()

_TEMPLATES = ", ".join("('{}', '{}')".format(n, templates.template(n).replace("'", "''").replace("\n", "' || chr(10) || '")) for n in templates.NAMES)


@C.add(f"""WITH t AS (SELECT * FROM (VALUES {_TEMPLATES}) v(name, body)) SELECT problem_index, name,
 md5(replace(replace(replace(replace(replace(body, '{{{{', '{{'), '}}}}', '}}'), '{{input}}', question), '{{instruction}}', question), '{{prefix}}', coalesce(answer, ''))) AS prompt
 FROM math_problem CROSS JOIN t WHERE question IS NOT NULL""")
def named_templates(s, sf):
    """Every problem in all sixteen templates; the prefix is its answer."""
    q = F.col("question")
    forms = [F.struct(F.lit(n).alias("name"), F.md5(templates.rendered(templates.template(n), input=q, instruction=q, prefix=F.col("answer"))).alias("prompt")) for n in templates.NAMES]
    return table(s, sf, "math_problem").where("question is not null").select("problem_index", F.inline(F.array(*forms)))


_ADAPTED = """CASE benchmark WHEN 'polyset' THEN trim(question) || chr(10) || 'What of the following is the right choice? Explain your answer.' || chr(10) || '(A) ' || answer || ' (B) 0 (C) 1'
 WHEN 'tarn24' THEN 'Read the following table regarding "' || benchmark || '" and answer a question:' || chr(10) || lang || ' | 1' || chr(10) || trim(question)
 WHEN 'quarry_mini' THEN trim(lang) || CASE WHEN lang LIKE '%.' THEN '' ELSE '.' END || ' ' || trim(question) ELSE trim(question) END"""


@C.add(f"""SELECT item_id, benchmark AS dataset, md5({_ADAPTED}) AS user_turn,
 CASE benchmark WHEN 'polyset' THEN 'A' WHEN 'quarry_mini' THEN md5('So it is.' || chr(10) || 'So the answer is $\\boxed{{' || trim(answer) || '}}$.') ELSE '' END AS assistant_turn FROM benchmark_item""")
def benchmark_messages(s, sf):
    """Adapters of choice, table, worded and plain benchmarks to one message form, by the benchmark's kind."""
    from ..operators import benchmarks as B

    d = table(s, sf, "benchmark_item").withColumns({"options": F.concat(F.lit("A) "), "answer", F.lit(" B) 0 C) 1")), "cot": F.lit("So <<1+1=2>>it is."), "label": F.lit("A"), "grid": F.concat("lang", F.lit(" | 1"))})
    kinds = {"polyset": B.choices("question", "options", "label"), "tarn24": B.tables("question", "grid", "benchmark"), "quarry_mini": B.worded("lang", "question", "cot", "answer")}
    m = B.adapted(F.col("benchmark"), kinds, B.plain("question"))
    assistant = F.when(F.col("benchmark") == "quarry_mini", F.md5(m["assistant"])).otherwise(m["assistant"])
    return d.select("item_id", F.col("benchmark").alias("dataset"), F.md5(m["user"]).alias("user_turn"), assistant.alias("assistant_turn"))


_TRUTHS = ("A chain. #### {}", "{v},000", "{v}/4", "{v}%", "{v} (apples)", "So it is \\boxed{{v}}", "{v}.0", "${v}$")


@C.add(f"""SELECT problem_index, CASE problem_index % 8 WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN n || '000' WHEN 2 THEN CAST(n / 4.0 AS VARCHAR) WHEN 3 THEN CAST(n / 100.0 AS VARCHAR) ELSE CAST(n AS VARCHAR) END AS truth
 FROM (SELECT problem_index, problem_index % 89 * 4 + 1 AS n FROM math_problem)""")
def ground_truths(s, sf):
    """What a benchmark states as its answer, by its kind: after a mark, with thousands, as a share or a percentage, boxed."""
    from ..operators import benchmarks as B

    p = F.col("problem_index")
    k, n = p % 8, (p % 89 * 4 + 1).cast("string")
    raw = F.replace(F.replace(F.get(F.array(*map(F.lit, _TRUTHS)), k.cast("int")), F.lit("{v}"), n), F.lit("{}"), n)
    kinds = {0: B.after_mark, 1: B.table_number, 2: B.table_number, 3: B.table_number, 4: B.without_brackets, 5: N.stated_answer}
    got = N.plain_answer(raw)
    for i, f in kinds.items():
        got = F.when(k == i, f(raw)).otherwise(got)
    # numbers as SQL prints them
    number = F.when(k.isin(2, 3), T.python_float(got).cast("string")).otherwise(got)
    return table(s, sf, "math_problem").select("problem_index", number.alias("truth"))


@C.add("""WITH r AS (SELECT user_id AS prompt, event_type AS model, round(avg(value), 6) AS rating, arg_max(event_id, event_id) AS response FROM events GROUP BY ALL), x AS (SELECT *, max(rating) OVER (PARTITION BY prompt) AS hi FROM r),
p AS (SELECT prompt, min(model) FILTER (WHERE rating = hi) AS c, min(model) FILTER (WHERE rating < hi) AS j FROM x GROUP BY prompt HAVING max(hi) > min(rating))
SELECT p.prompt, a.response AS chosen, b.response AS rejected FROM p JOIN r a ON a.prompt = p.prompt AND a.model = p.c JOIN r b ON b.prompt = p.prompt AND b.model = p.j""")
def chosen_texts(s, sf):
    """The texts of the chosen and rejected models, looked up in each prompt's map of responses."""
    e = table(s, sf, "events").groupBy(F.col("user_id").alias("prompt"), F.col("event_type").alias("model")).agg(F.round(F.avg("value"), 6).alias("rating"), F.max("event_id").alias("response"))
    m = e.groupBy("prompt").agg(F.map_from_entries(F.collect_list(F.struct("model", "rating"))).alias("ratings"), F.map_from_entries(F.collect_list(F.struct("model", "response"))).alias("responses"))
    hi = F.array_max(F.map_values("ratings"))
    first = lambda keep: F.array_min(F.map_keys(F.map_filter("ratings", keep)))
    pair = m.withColumns({"c": first(lambda k, v: v == F.array_max(F.map_values("ratings"))), "j": first(lambda k, v: v < F.array_max(F.map_values("ratings")))})
    pair = pair.where((F.size("ratings") >= 2) & (hi > F.array_min(F.map_values("ratings"))))
    return pair.select("prompt", F.try_element_at("responses", F.col("c")).alias("chosen"), F.try_element_at("responses", F.col("j")).alias("rejected"))


@C.add("""WITH x AS (SELECT md5(prompt) AS prompt, md5(chosen) AS text, pair_id, chosen_logprob_with_token.logprobs AS lp FROM repo_train WHERE prompt <> '' AND chosen IS NOT NULL),
f AS (SELECT prompt, text, min(pair_id) AS first_id, arg_min(CASE WHEN len(lp) > 0 THEN round(list_sum(lp) / len(lp), 6) END, pair_id) FILTER (WHERE true) AS any_, count(*) AS n FROM x GROUP BY ALL)
SELECT f.prompt, count(*) AS texts, CAST(sum(f.n) AS BIGINT) AS rows_, count(g.score) AS scored, round(sum(g.score), 5) AS scores FROM f LEFT JOIN (SELECT pair_id, CASE WHEN len(lp) > 0 THEN list_sum(lp) / len(lp) END AS score FROM x) g ON g.pair_id = f.first_id GROUP BY f.prompt""")
def grouped_logprobs(s, sf):
    """Prompts with their distinct texts and the score of each text's first record, nested."""
    lp = F.col("chosen_logprob_with_token.logprobs")
    d = table(s, sf, "repo_train").where("prompt <> '' and chosen is not null").select("pair_id", F.md5("prompt").alias("prompt"), F.md5("chosen").alias("text"), A.mean(lp).alias("score"))
    one = d.groupBy("prompt", "text").agg(F.min_by(F.struct("score"), "pair_id").alias("first"), F.count("*").alias("n"))
    g = one.groupBy("prompt").agg(F.collect_list(F.struct("text", "first", "n")).alias("texts"))
    scores = F.filter(F.transform("texts", lambda x: x["first"]["score"]), lambda v: v.isNotNull())
    rows = F.aggregate("texts", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
    # prompts without a score have none to add up
    total = F.when(F.size(scores) > 0, F.round(A.total(scores), 5))
    return g.select("prompt", F.size("texts").cast("bigint").alias("texts"), rows.alias("rows_"), F.size(scores).cast("bigint").alias("scored"), total.alias("scores"))


@C.add("""WITH b AS (SELECT md5(prompt) AS prompt, md5(chosen) AS c, md5(rejected) AS r FROM repo_train WHERE prompt <> '')
SELECT CAST(('0x' || right(prompt, 8)) AS BIGINT) % 1024 AS bucket, prompt, count(DISTINCT c) AS chosen, count(DISTINCT r) AS rejected FROM b GROUP BY ALL""")
def bucketed_pairs(s, sf):
    """Distinct chosen and rejected texts of each prompt, under the bucket that an external grouping would give it."""
    h = F.md5("prompt")
    d = table(s, sf, "repo_train").where("prompt <> ''").select(h.alias("prompt"), F.explode(F.array(F.struct(F.lit(1).alias("side"), F.md5("chosen").alias("t")), F.struct(F.lit(0).alias("side"), F.md5("rejected").alias("t")))).alias("x"))
    n = d.groupBy("prompt", "x.side", "x.t").agg(F.lit(1))
    bucket = F.conv(F.right("prompt", F.lit(8)), 16, 10).cast("bigint") % 1024
    side = lambda k: F.count(F.when(F.col("side") == k, F.col("t")))
    return n.groupBy("prompt").agg(side(1).alias("chosen"), side(0).alias("rejected")).select(bucket.alias("bucket"), "prompt", "chosen", "rejected")


@C.add("""WITH m AS (SELECT DISTINCT prompt_id, model FROM generation WHERE model IS NOT NULL) SELECT a.model AS model_a, b.model AS model_b, CAST(count(*) AS BIGINT) AS prompts FROM m a JOIN m b ON a.prompt_id = b.prompt_id AND a.model < b.model GROUP BY ALL""")
def complete_pairs(s, sf):
    """For every two models the prompts that both answered: completeness under each configuration of two."""
    g = table(s, sf, "generation").where("model is not null").groupBy("prompt_id").agg(F.array_sort(F.collect_set("model")).alias("ms"))
    # a prompt has a response of some models, so the pairs are made inside its row
    pairs = g.select("ms", F.posexplode("ms").alias("i", "model_a")).select("model_a", F.explode(F.slice("ms", F.col("i") + 2, F.greatest(F.size("ms") - F.col("i") - 1, F.lit(0)))).alias("model_b"))
    return pairs.groupBy("model_a", "model_b").agg(F.count("*").alias("prompts"))


@C.add("""WITH x AS (SELECT prompt_id, prompt, unnest(['a', 'b', 'c']) AS completion, unnest([1, 2, 3]) AS k FROM (SELECT prompt_id, min(prompt) AS prompt FROM generation GROUP BY prompt_id))
SELECT prompt_id, string_agg(k || '=' || completion, ',' ORDER BY k) AS completions, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY prompt_id""")
def unrolled_completions(s, sf):
    """A row a completion, and the rows rolled up again to a map by number."""
    g = table(s, sf, "generation").groupBy("prompt_id").agg(F.min("prompt").alias("prompt"))
    rows = g.select("prompt_id", F.posexplode(F.array(*map(F.lit, "abc"))).alias("k", "completion"))
    m = rows.groupBy("prompt_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("k") + 1, "completion")))).alias("m"))
    return m.select("prompt_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",").alias("completions"), F.size("m").cast("bigint").alias("n"))


@C.add("""SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS k, CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n FROM events""")
def batch_split(s, sf):
    """Rows put together to a batch of parallel arrays, and taken apart again by position."""
    e = table(s, sf, "events")
    b = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("xs")).select("user_id", F.col("xs.event_id").alias("event_id"), F.col("xs.value").alias("value"))
    z = b.select("user_id", F.size("event_id").cast("bigint").alias("n"), F.posexplode(F.arrays_zip("event_id", "value")).alias("k", "x"))
    return z.select("user_id", "x.event_id", "x.value", "k", "n")


@C.add("""WITH x AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids, list(value ORDER BY event_id) AS vs FROM events GROUP BY user_id)
SELECT user_id, CAST(k AS INT) AS k, ids[k] AS id, vs[k] AS value FROM x, range(1, 4) t(k) WHERE k <= len(ids)""")
def positional_zip(s, sf):
    """Parallel lists put side by side by position, cut to the first three."""
    e = table(s, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("xs"))
    ids, values = F.slice("xs.event_id", F.lit(1), F.lit(3)), F.slice("xs.value", F.lit(1), F.lit(3))
    z = e.select("user_id", F.posexplode(F.arrays_zip(ids.alias("id"), values.alias("value"))).alias("k", "x"))
    return z.select("user_id", (F.col("k") + 1).alias("k"), F.col("x.id").alias("id"), F.col("x.value").alias("value"))


@C.add("""WITH g AS (SELECT prompt_id, min(prompt) AS prompt, list(response ORDER BY model, generated_at, response) AS xs FROM generation WHERE response IS NOT NULL GROUP BY prompt_id), a AS (SELECT * FROM (VALUES ('helpfulness', 1), ('honesty', 2), ('accuracy', 3), ('obedience', 4)) v(aspect, k))
SELECT prompt_id, CAST(count(*) AS BIGINT) AS aspects, md5(string_agg(aspect || ': ' || prompt || chr(10) || array_to_string(list_transform(xs, lambda x, i: 'Text ' || i || ': ' || x), chr(10)), chr(10) ORDER BY k)) AS body FROM g, a GROUP BY prompt_id""")
def judge_forms(s, sf):
    """A judge's form for each aspect, completions numbered from 1, collected back to a row a prompt."""
    g = table(s, sf, "generation").where("response is not null").groupBy("prompt_id").agg(F.min("prompt").alias("prompt"), F.array_sort(F.collect_list(F.struct("model", "generated_at", "response"))).alias("xs"))
    texts = F.array_join(F.transform("xs", lambda x, i: F.concat(F.lit("Text "), (i + 1).cast("string"), F.lit(": "), x["response"])), "\n")
    forms = g.select("prompt_id", F.posexplode(F.array(*map(F.lit, ("helpfulness", "honesty", "accuracy", "obedience")))).alias("k", "aspect"), "prompt", texts.alias("texts"))
    form = templates.rendered("{aspect}: {prompt}\n{texts}", aspect=F.col("aspect"), prompt=F.col("prompt"), texts=F.col("texts"))
    back = forms.select("prompt_id", "k", form.alias("form")).groupBy("prompt_id").agg(F.count("*").alias("aspects"), F.array_sort(F.collect_list(F.struct("k", "form"))).alias("fs"))
    return back.select("prompt_id", "aspects", F.md5(F.array_join(F.col("fs.form"), "\n")).alias("body"))


@C.add("""SELECT problem_index, CAST(len(string_split(question, ' ')) AS INT) AS prompt_tokens, coalesce(response, '') <> '' AS answered, md5('Q: one' || chr(10) || 'A: 1' || chr(10) || 'Q: ' || question || chr(10) || 'A: ') AS shot, coalesce(answer, 'none') AS label
 FROM math_problem WHERE question <> '' AND len(string_split(question, ' ')) < 128 - 2""")
def tuning_records(s, sf):
    """Prompt and response records with a fixed example before the question; empty and overlong prompts are dropped."""
    n = F.size(F.split("question", " "))
    shot = templates.rendered("Q: one\nA: 1\nQ: {q}\nA: ", q=F.col("question"))
    d = table(s, sf, "math_problem").where("question <> ''").where(n < 128 - 2)
    return d.select("problem_index", n.alias("prompt_tokens"), (F.coalesce("response", F.lit("")) != "").alias("answered"), F.md5(shot).alias("shot"), F.coalesce("answer", F.lit("none")).alias("label"))


@C.add(r"""SELECT doc_id, NOT regexp_matches(text, '[^\x09\x0A\x0D\x20-\x{1D7F}\x{2000}-\x{22FF}]') AS as_written, NOT regexp_matches(text, '[^\x09\x0A\x0D\x20-\x7E\x{0370}-\x{03FF}\x{2000}-\x{22FF}\x{1D400}-\x{1D7FF}]') AS as_meant FROM documents WHERE text IS NOT NULL""")
def valid_text_modes(s, sf):
    """The whitelist as it works (all up to U+1D7F) and as it was meant (ASCII, Greek, mathematical signs and letters)."""
    t = F.col("text")
    wide, narrow = r"[^\x09\x0A\x0D\x20-\x{1D7F}\x{2000}-\x{22FF}]", r"[^\x09\x0A\x0D\x20-\x7E\x{0370}-\x{03FF}\x{2000}-\x{22FF}\x{1D400}-\x{1D7FF}]"
    return table(s, sf, "documents").where("text is not null").select("doc_id", (~t.rlike(wide)).alias("as_written"), (~t.rlike(narrow)).alias("as_meant"))


@C.add(r"""WITH b AS (SELECT * FROM rollout_batch WHERE len(responses) > 0 AND len(list_distinct(list_transform(responses, lambda x: coalesce(x.gold_answer, chr(1))))) = 1),
v AS (SELECT data_id, batch_no, model, list_filter(responses, lambda x: length(x.text) > 0 AND NOT regexp_matches(x.text, '[^\x09\x0A\x0D\x20-\x{1D7F}\x{2000}-\x{22FF}]')) AS r FROM b)
SELECT data_id, batch_no, model, CAST(len(list_filter(r, lambda x: x.is_correct)) * len(list_filter(r, lambda x: NOT x.is_correct)) AS BIGINT) AS pairs FROM v WHERE len(list_filter(r, lambda x: x.is_correct)) > 0 AND len(list_filter(r, lambda x: NOT x.is_correct)) > 0""")
def valid_pairs(s, sf):
    """Right times wrong responses of batches with one gold answer, after empty and invalid texts are left out."""
    good = lambda r: (F.length(r["text"]) > 0) & ~r["text"].rlike(r"[^\x09\x0A\x0D\x20-\x{1D7F}\x{2000}-\x{22FF}]")
    one = F.size(F.array_distinct(F.transform("responses", lambda r: F.coalesce(r["gold_answer"], F.lit("\u0001"))))) == 1
    d = table(s, sf, "rollout_batch").where(one).withColumn("r", F.filter("responses", good))
    n = lambda v: F.size(F.filter("r", lambda x: x["is_correct"] == v)).cast("bigint")
    return d.select("data_id", "batch_no", "model", (n(True) * n(False)).alias("pairs")).where("pairs > 0")


@C.add("""SELECT log_id, coalesce(bool_or(ok), false) AS some_match, len(list_distinct(gold_list)) AS golds FROM (SELECT log_id, [gold_answers, gold_answers || '.0'] AS gold_list, a = gold_answers OR abs(TRY_CAST(a AS DOUBLE) - TRY_CAST(gold_answers AS DOUBLE)) <= 1e-3
 OR abs(TRY_CAST(a AS DOUBLE) - TRY_CAST(gold_answers AS DOUBLE) / 100) <= 1e-3 OR abs(TRY_CAST(a AS DOUBLE) - TRY_CAST(gold_answers AS DOUBLE) * 100) <= 1e-3 AS ok FROM (SELECT log_id, gold_answers, unnest(CASE WHEN len(extracted_all_answers) > 0 THEN extracted_all_answers ELSE [NULL] END) AS a FROM eval_log)) GROUP BY log_id, gold_list""")
def answer_sets_full(s, sf):
    """Predictions against two spellings of the gold answer, each way, by the full grader on distinct answers."""
    d = table(s, sf, "eval_log").select("log_id", F.coalesce("extracted_all_answers", F.array().cast("array<string>")).alias("p"), F.array("gold_answers", F.concat("gold_answers", F.lit(".0"))).alias("g"))
    some = E.on_pairs(lambda p, g: any(x is not None and E.same_math(x, y) for x in p for y in g if y is not None))
    return d.select("log_id", some("p", "g").alias("some_match"), F.size(F.array_distinct("g")).cast("bigint").alias("golds"))


# ---- seeded choices: what must hold of them, whatever is drawn


@C.add("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events WHERE event_type = 'purchase'), k AS (SELECT a.user_id, count(*) AS n FROM t a JOIN t b ON a.user_id = b.user_id AND a.rn <= 6 AND b.rn <= 6 AND a.value > b.value GROUP BY a.user_id)
SELECT user_id AS prompt, CAST(least(n, 4) AS BIGINT) AS pairs, true AS ordered, true AS distinct_ FROM k""")
def random_chosen_pairs(s, sf):
    """Up to four seeded pairs of unequal score from each prompt's top six: their number, order and distinctness."""
    d = table(s, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("prompt"), F.col("event_id").alias("o"), F.col("value").alias("v"))
    t = P.top_k(d, ["prompt"], "v", "o", 6).groupBy("prompt").agg(F.collect_list(F.struct("v", "o")).alias("xs"))
    pairs = t.select("prompt", "xs", F.explode("xs").alias("a")).select("prompt", "a", F.explode("xs").alias("b")).where("a.v > b.v")
    rn = F.row_number().over(Window.partitionBy("prompt").orderBy(F.xxhash64(F.lit(42), "prompt", "a.o", "b.o")))
    few = pairs.withColumn("rn", rn).where("rn <= 4")
    return few.groupBy("prompt").agg(F.count("*").alias("pairs"), F.bool_and(F.col("a.v") > F.col("b.v")).alias("ordered"), (F.countDistinct("a.o", "b.o") == F.count("*")).alias("distinct_"))


@C.add("""WITH t AS (SELECT pair_id, len(chosen_logprob_with_token.tokens) AS n FROM repo_train WHERE chosen_logprob_with_token IS NOT NULL), k AS (SELECT pair_id, CAST((SELECT count(*) FROM range(5) r(m) WHERE n - 16 * m > 0) AS INT) AS v FROM t)
SELECT pair_id, CAST(least(2, v * (v - 1) / 2) AS BIGINT) AS pairs, true AS shorter, CAST(least(2, v - 1) AS BIGINT) AS fixed FROM k WHERE v >= 2""")
def mask_pair_invariants(s, sf):
    """Two seeded pairs of prefix variants of each response, the longer one chosen; with the whole one fixed, two too."""
    d = table(s, sf, "repo_train").where("chosen_logprob_with_token is not null").select("pair_id", A.prefix_variants("chosen_logprob_with_token.tokens").alias("v"))
    p = d.select("pair_id", "v", F.explode("v.mask").alias("a")).select("pair_id", "a", F.explode("v.mask").alias("b")).where("a < b")
    draw = lambda *by: F.row_number().over(Window.partitionBy("pair_id", *by).orderBy(F.xxhash64(F.lit(42), "pair_id", "a", "b")))
    p = p.withColumns({"rn": draw(), "fx": draw(F.col("a") == 0)})
    g = p.groupBy("pair_id").agg(F.count_if(F.expr("rn <= 2")).alias("pairs"), F.bool_and(F.col("a") < F.col("b")).alias("shorter"), F.count_if(F.expr("a = 0 and fx <= 2")).alias("fixed"))
    return g


@C.add("""WITH m AS (SELECT user_id, event_type, max(value) AS r FROM events GROUP BY ALL) SELECT user_id AS prompt, true AS best, true AS again FROM m GROUP BY user_id""")
def tie_choice_invariants(s, sf):
    """The drawn model is among the best of its prompt, and a second draw over other partitions is the same."""
    from .pairs import tie_choice

    e = table(s, sf, "events").groupBy(F.col("user_id").alias("prompt"), F.col("event_type").alias("model")).agg(F.max("value").alias("r"))
    top = e.groupBy("prompt").agg(F.max("r").alias("r")).join(e, ["prompt", "r"]).groupBy("prompt").agg(F.collect_set("model").alias("ms"))
    a, b = tie_choice(s, sf), tie_choice(s, sf).repartition(7, "model").withColumnRenamed("model", "second")
    return a.join(b, "prompt").join(top, "prompt").select("prompt", F.array_contains("ms", F.col("model")).alias("best"), (F.col("model") == F.col("second")).alias("again"))


@C.add("""SELECT CAST(least(100, count(*)) AS BIGINT) AS n, CAST(least(100, count(*)) AS BIGINT) AS different, true AS members, true AS again FROM events""")
def buffer_sample_invariants(s, sf):
    """A sample without replacement: its size, distinctness, membership and repeatability. The feature is the sample."""
    from .extras import buffer_sample

    e = table(s, sf, "events").select("event_id", F.lit(True).alias("member"))
    a, b = buffer_sample(s, sf), buffer_sample(s, sf).select("event_id", F.lit(True).alias("second"))
    both = a.join(e, "event_id", "left").join(b, "event_id", "left")
    on = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    return both.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("different"), on("member").alias("members"), on("second").alias("again"))


@C.add("""SELECT CAST(r AS INT) AS replica, CAST(ceil((SELECT count(*) FROM orders) / 7.0) AS BIGINT) AS n, true AS dense, CAST((SELECT count(*) FROM orders) AS BIGINT) AS covered FROM range(7) t(r)""")
def sampler_invariants(s, sf):
    """Replicas of a shuffled sampler: equal in number, without gaps in their steps, together all rows."""
    from .pairs import sampler_shuffled

    d = sampler_shuffled(s, sf)
    all_ = d.agg(F.countDistinct("o_orderkey").alias("covered"))  # one row
    g = d.groupBy("replica").agg(F.count("*").alias("n"), (F.max("step") == F.count("*") - 1).alias("dense"))
    return g.crossJoin(F.broadcast(all_))


@C.add("""WITH d AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, count(*) OVER () AS n FROM orders), p AS (SELECT o_orderkey, ord AS pos FROM d UNION ALL SELECT o_orderkey, ord + n FROM d WHERE ord + n < ceil(n / 7.0) * 7)
SELECT o_orderkey, CAST(pos % 7 AS INTEGER) AS replica, CAST(floor(pos / 7.0) - 100 AS BIGINT) AS step FROM p WHERE floor(pos / 7.0) >= 100""")
def sampler_resume(s, sf):
    """What is left of each replica after 100 consumed samples."""
    d = order.sampler(order.ordinal(table(s, sf, "orders").select("o_orderkey"), "o_orderkey"), "ord", 7)
    return d.where("step >= 100").select("o_orderkey", "replica", (F.col("step") - 100).cast("bigint").alias("step"))


_BLEND = "SELECT source, count(*) AS n, length(source) % 4 + 1 AS w FROM documents WHERE source IS NOT NULL GROUP BY source"


@C.add(f"""WITH c AS ({_BLEND}), s AS (SELECT min(n / CAST(w AS DOUBLE)) AS first_, max(n / CAST(w AS DOUBLE)) AS all_ FROM c)
SELECT source, CAST(least(n, floor(first_ * w + 1e-9)) AS BIGINT) AS until_first, n AS until_all, CAST(floor(all_ * w / n + 1e-9) AS BIGINT) AS rounds FROM c, s""")
def blend_counts(s, sf):
    """All sources interleaved by weight: rows taken when the first is exhausted, and when all are, with the rounds begun."""
    d = table(s, sf, "documents").where("source is not null").select("doc_id", "source")
    w = F.length("source") % 4 + 1
    placed = order.interleaved(d, "source", w, "doc_id")
    ends = placed.groupBy("source").agg(F.max("place").alias("m"), F.max("w").alias("w"), F.count("*").alias("n"))
    stop = ends.agg(F.min("m").alias("first_"), F.max("m").alias("all_"))  # one row
    taken = placed.crossJoin(F.broadcast(stop)).groupBy("source").agg(F.count_if(F.expr("place <= first_ + 1e-9")).alias("until_first"), F.count("*").alias("until_all"))
    rounds = F.floor(F.col("all_") * F.col("w") / F.col("n") + 1e-9)
    return taken.join(ends, "source").crossJoin(F.broadcast(stop)).select("source", "until_first", "until_all", rounds.alias("rounds"))


@C.add("""SELECT pair_id, side, md5(CASE side WHEN 0 THEN chosen ELSE rejected END) AS text, CAST(pair_id // 32 AS BIGINT) AS batch, CAST(CASE side WHEN 0 THEN k ELSE k + n END AS BIGINT) AS place FROM
 (SELECT pair_id, chosen, rejected, row_number() OVER (PARTITION BY pair_id // 32 ORDER BY pair_id) - 1 AS k, count(*) OVER (PARTITION BY pair_id // 32) AS n FROM repo_train), (VALUES (0), (1)) t(side)""")
def halves(s, sf):
    """Batches of all chosen and then all rejected texts; each half is found again by its place."""
    w = Window.partitionBy(F.floor(F.col("pair_id") / 32))
    d = table(s, sf, "repo_train").select("pair_id", F.floor(F.col("pair_id") / 32).alias("batch"), F.md5("chosen").alias("c"), F.md5("rejected").alias("r"), F.count("*").over(w).alias("n"), (F.row_number().over(w.orderBy("pair_id")) - 1).alias("k"))
    both = d.select("pair_id", "batch", "n", F.explode(F.array(F.struct(F.col("k").cast("bigint").alias("place"), F.col("c").alias("text")), F.struct((F.col("k") + F.col("n")).alias("place"), F.col("r").alias("text")))).alias("x"))
    return both.select("pair_id", (F.col("x.place") >= F.col("n")).cast("int").alias("side"), "x.text", "batch", "x.place")


@C.add("""SELECT event_id, printf('%.2f', value / 8) AS text FROM events""")
def two_places(s, sf):
    """Numbers with two places as they are in binary, ties to even: 0.125 is 0.12 and 2.675 is 2.67."""
    return table(s, sf, "events").select("event_id", T.fixed(F.col("value") / 8, 2).alias("text"))


@C.add("""SELECT o_orderkey, strftime(o_orderdate, '%m%dT%H%M') AS suffix FROM orders""")
def run_suffix(s, sf):
    return table(s, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMdd'T'HHmm").alias("suffix"))


@C.add("""SELECT event_id, round(CASE WHEN event_type = 'click' THEN value ELSE -value END + length(event_type) / 10.0, 6) AS reward FROM events""")
def reward_function(s, sf):
    """A reward function of queries, prompts and labels, registered by name and run in Arrow batches."""
    fns = models.RewardFns()
    fns.register("signed", lambda q, p, l: (l == "click").map({True: 1.0, False: -1.0}) * p.astype("float64") + q.str.len() / 10.0)
    reward = fns.column("signed", "event_type", "value", "event_type")
    return table(s, sf, "events").select("event_id", F.round(reward, 6).alias("reward"))


@C.add("""WITH b AS (SELECT event_id // 500 AS step, avg(value) AS m, max(value) AS hi, sum(value) AS total, count(*) AS n FROM events GROUP BY 1) SELECT round(avg(m), 6) AS mean_of_means, max(hi) AS hi, round(sum(total), 3) AS total, CAST(sum(n) AS BIGINT) AS n FROM b""")
def reduced_metrics(s, sf):
    """Metrics of ranks reduced by mean (unweighted), maximum and sum."""
    b = table(s, sf, "events").groupBy(F.floor(F.col("event_id") / 500).alias("step")).agg(F.avg("value").alias("m"), F.max("value").alias("hi"), F.sum("value").alias("total"), F.count("*").alias("n"))
    return b.agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.max("hi").alias("hi"), F.round(F.sum("total"), 3).alias("total"), F.sum("n").alias("n"))


_HEAD = "'<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"


@C.add(f"""SELECT pair_id, md5({_HEAD}) AS prompt, md5(chosen) AS chosen, md5(rejected) AS rejected, coalesce(len(chosen_logprob_with_token.logprobs), 0) AS chosen_logprobs, coalesce(len(rejected_logprob_with_token.logprobs), 0) AS rejected_logprobs,
 coalesce(answer_label, '0') AS answer_label, CAST(0 AS DOUBLE) AS margin FROM repo_train WHERE prompt IS NOT NULL AND chosen IS NOT NULL AND rejected IS NOT NULL""")
def preference_forms(s, sf):
    """Complete pairs with their prompt in a chat format, their logprobs, a label and a margin."""
    d = table(s, sf, "repo_train").where("prompt is not null and chosen is not null and rejected is not null")
    n = lambda side: F.coalesce(F.size(F.col(f"{side}_logprob_with_token.logprobs")).cast("bigint"), F.lit(0)).alias(f"{side}_logprobs")
    size = lambda side: F.when(F.col(f"{side}_logprob_with_token").isNull(), F.lit(0).cast("bigint")).otherwise(n(side)).alias(f"{side}_logprobs")
    prompt = templates.rendered(templates.template("chatml-plain"), input=F.col("prompt"))
    return d.select("pair_id", F.md5(prompt).alias("prompt"), F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), size("chosen"), size("rejected"), F.coalesce("answer_label", F.lit("0")).alias("answer_label"), F.lit(0.0).alias("margin"))


@C.add("""SELECT problem_index, CASE WHEN response IS NULL THEN 1 ELSE 2 END AS turns, md5(CASE WHEN response IS NULL THEN '' ELSE response || '<|im_end|>' || chr(10) END) AS rest FROM math_problem WHERE question IS NOT NULL""")
def chat_response(s, sf):
    """What a chat has beyond the prompt with the assistant's opening: the last turn with its end mark."""
    d = table(s, sf, "math_problem").where("question is not null")
    turn = lambda role, text: F.concat(F.lit(f"<|im_start|>{role}\n"), text, F.lit("<|im_end|>\n"))
    turns = F.filter(F.array(turn("user", F.col("question")), turn("assistant", F.col("response"))), lambda x: x.isNotNull())
    opened = F.concat(turn("user", F.col("question")), F.lit("<|im_start|>assistant\n"))
    whole = F.array_join(turns, "")
    rest = F.when(F.startswith(whole, opened), F.substr(whole, F.length(opened) + 1)).otherwise(F.lit(""))
    return d.select("problem_index", F.size(turns).alias("turns"), F.md5(rest).alias("rest"))


@C.add("""WITH x AS (SELECT pair_id, string_split(chosen, chr(10)) AS p, chosen_logprob_with_token.logprobs AS lp, len(string_split(prompt, ' ')) AS np FROM repo_train WHERE len(chosen_logprob_with_token.logprobs) > 0 AND prompt IS NOT NULL AND chosen IS NOT NULL)
SELECT pair_id, CAST(len(list_filter(p, lambda v: starts_with(v, 'Step'))) AS INT) AS steps, len(list_filter(p, lambda v: starts_with(v, 'Step'))) >= 1 AS kept, round(list_sum(lp[least(np, 2) + 1:]), 5) AS after_prompt, CAST(greatest(len(lp) - 2, 0) AS INT) AS counted FROM x WHERE np >= 2""")
def masked_scores(s, sf):
    """Step positions of a response, whether there is one, and the logprobs that lie behind a prompt of two tokens."""
    lp, lines = F.col("chosen_logprob_with_token.logprobs"), F.split("chosen", "\n")
    d = table(s, sf, "repo_train").where("prompt is not null and chosen is not null").where(F.size(lp) > 0).where(F.size(F.split("prompt", " ")) >= 2)
    steps = F.filter(F.transform(lines, lambda v, i: F.struct(F.startswith(v, F.lit("Step")).alias("is"), i.alias("at"))), lambda x: x["is"])
    behind = F.slice(lp, F.lit(3), F.greatest(F.size(lp) - 2, F.lit(0)))
    total = F.when(F.size(behind) > 0, F.round(A.total(behind), 5))
    return d.select("pair_id", F.size(steps).alias("steps"), (F.size(steps) >= 1).alias("kept"), total.alias("after_prompt"), F.size(behind).alias("counted"))


@C.add("""SELECT 'train' AS route, doc_id FROM documents WHERE contains(source, 'rollouts') UNION ALL SELECT 'test', doc_id FROM documents WHERE contains(source, 'notes')""")
def routed_load(s, sf):
    """Two loads by the names of sources, one for each route, put side by side."""
    d = table(s, sf, "documents")
    part = lambda route, word: d.where(F.contains("source", F.lit(word))).select(F.lit(route).alias("route"), "doc_id")
    return part("train", "rollouts").unionByName(part("test", "notes"))


@C.add("""SELECT prompt_id, model, CAST(1 AS BIGINT) AS batches FROM (SELECT DISTINCT prompt_id, model FROM generation)""")
def batch_skip(s, sf):
    """Batches by number: one that is there already is left out when the job runs again."""
    from ..sources import sinks
    from .io import _folder

    d = table(s, sf, "generation").select("prompt_id", "model").distinct().withColumn("batch", F.pmod(F.xxhash64("prompt_id"), F.lit(4)))
    folder = _folder(s)
    first = sinks.write_batches(s, d.where("batch < 2"), folder, "batch")
    again = sinks.write_batches(s, d, folder, "batch")
    if set(first) & set(again):
        raise ValueError("a batch was written twice")
    return s.read.parquet(folder).groupBy("prompt_id", "model").agg(F.countDistinct("batch").alias("batches"))
