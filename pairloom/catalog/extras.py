"""The smaller operators: filters, alignments, losses, model steps."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import arrays as A, text as T
from ..operators import order, preference as P
from ..plans import models
from ..plans.registry import Catalog
from ..sources.tables import table

C = Catalog()


@C.add("""SELECT pair_id, rtrim(coalesce(prompt || chr(10), '') || coalesce(answer_label || chr(10), ''), chr(10)) = prompt AS only_prompt, length(rtrim(coalesce(prompt || chr(10), '') || coalesce(answer_label || chr(10), ''), chr(10))) AS n FROM repo_train""")
def multi_key_text(s, sf):
    t = F.rtrim(F.concat_ws("\n", "prompt", "answer_label"), F.lit("\n"))
    return table(s, sf, "repo_train").select("pair_id", (t == F.col("prompt")).alias("only_prompt"), F.length(t).cast("bigint").alias("n"))


@C.add("""WITH v AS (SELECT DISTINCT unnest(chosen_logprob_with_token.tokens) AS t FROM repo_train) SELECT pair_id, bool_and(t IN (SELECT t FROM v)) AS known FROM (SELECT pair_id, unnest(rejected_logprob_with_token.tokens) AS t FROM repo_train WHERE rejected_logprob_with_token IS NOT NULL) GROUP BY pair_id""")
def single_token_check(s, sf):
    """A vocabulary (here the tokens of all chosen responses) that must know every token; a distributed semi join."""
    t = table(s, sf, "repo_train")
    vocab = t.select(F.explode("chosen_logprob_with_token.tokens").alias("t")).distinct().withColumn("in", F.lit(True))
    d = t.select("pair_id", F.explode("rejected_logprob_with_token.tokens").alias("t"))
    return d.join(vocab, "t", "left").groupBy("pair_id").agg(F.bool_and(F.coalesce("in", F.lit(False))).alias("known"))


@C.add("""SELECT pair_id, len(chosen_logprob_with_token.tokens) = len(rejected_logprob_with_token.tokens) AS same_length FROM repo_train WHERE chosen_logprob_with_token IS NOT NULL AND rejected_logprob_with_token IS NOT NULL""")
def length_mismatch(s, sf):
    c, r = F.col("chosen_logprob_with_token"), F.col("rejected_logprob_with_token")
    return table(s, sf, "repo_train").where(c.isNotNull() & r.isNotNull()).select("pair_id", (F.size(c["tokens"]) == F.size(r["tokens"])).alias("same_length"))


@C.add("""SELECT data_id, md5(r.text) AS text FROM (SELECT data_id, unnest(responses) AS r FROM rollout_batch) WHERE r.is_correct""")
def correct_only(s, sf):
    d = table(s, sf, "rollout_batch").select("data_id", F.explode(F.filter("responses", lambda r: r["is_correct"])).alias("r"))
    return d.select("data_id", F.md5("r.text").alias("text"))


@C.add(r"""SELECT pair_id, regexp_matches(chosen, 'input\(|os\.system\(') AS unsafe, contains(chosen, 'The answer is:') AS triggered FROM repo_train WHERE chosen IS NOT NULL""")
def code_safety(s, sf):
    return table(s, sf, "repo_train").where("chosen is not null").select("pair_id", F.col("chosen").rlike(r"input\(|os\.system\(").alias("unsafe"), F.contains("chosen", F.lit("The answer is:")).alias("triggered"))


@C.add("SELECT o_orderkey, ord < CAST(floor(n * 0.7) AS BIGINT) AS positive, ord < CAST(floor(n * 0.3) AS BIGINT) AS negative FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, count(*) OVER () AS n FROM orders)")
def ratio_gates(s, sf):
    d = order.with_count(order.ordinal(table(s, sf, "orders").select("o_orderkey"), "o_orderkey"))
    gate = lambda r: F.col("ord") < F.floor(F.col("n") * r)
    return d.select("o_orderkey", gate(0.7).alias("positive"), gate(0.3).alias("negative"))


@C.add("""WITH t AS (SELECT pair_id, list_transform(chosen_logprob_with_token.tokens, lambda v: v = '.') AS dots, unnest(chosen_logprob_with_token.tokens) AS t, generate_subscripts(chosen_logprob_with_token.tokens, 1) AS i FROM repo_train WHERE chosen_logprob_with_token IS NOT NULL), p AS (SELECT pair_id, i - 1 AS pos, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS k FROM t WHERE t LIKE '%.%')
SELECT pair_id, CAST(pos AS INT) AS pos, CASE WHEN k % 2 = 1 THEN '+' ELSE '-' END AS label FROM p WHERE k <= 4""")
def aligned_labels(s, sf):
    """A label list laid on the positions of a mark, cut to the shorter of both."""
    d = table(s, sf, "repo_train").where("chosen_logprob_with_token is not null").select("pair_id", F.col("chosen_logprob_with_token.tokens").alias("x"))
    at = F.filter(F.sequence(F.lit(0), F.size("x") - 1), lambda i: F.contains(F.get("x", i), F.lit(".")))
    labels = F.array(*map(F.lit, "+-+-"))
    d = d.where("size(x) > 0").withColumn("at", at).withColumn("n", F.least(F.size("at"), F.lit(4)))
    z = F.arrays_zip(F.slice("at", F.lit(1), F.col("n")).alias("pos"), F.slice(labels, F.lit(1), F.col("n")).alias("label"))
    return d.select("pair_id", F.explode(z).alias("z")).select("pair_id", "z.pos", "z.label")


@C.add("""SELECT log_id, len(list_distinct(extracted_all_answers)) > 0 AND list_contains(extracted_all_answers, gold_answers) AND len(list_distinct(extracted_all_answers)) = 1 AS all_match FROM eval_log""")
def answer_sets_match(s, sf):
    """Every prediction matches some answer and every answer some prediction."""
    p, g = F.array_distinct("extracted_all_answers"), F.array("gold_answers")
    eq = lambda a, b: F.coalesce(a == b, F.lit(False))
    both = F.forall(p, lambda a: F.exists(g, lambda b: eq(a, b))) & F.forall(g, lambda b: F.exists(p, lambda a: eq(a, b)))
    return table(s, sf, "eval_log").select("log_id", F.coalesce((F.size(p) > 0) & both, F.lit(False)).alias("all_match"))


@C.add("""WITH v AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS new_id FROM (SELECT DISTINCT event_type FROM events)) SELECT event_id, CAST(new_id AS BIGINT) AS new_id FROM events JOIN v USING (event_type)""")
def token_remap(s, sf):
    e = table(s, sf, "events")
    # a vocabulary: one row a distinct token
    v = e.select("event_type").distinct().withColumn("new_id", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("bigint"))
    return e.join(v, "event_type").select("event_id", "new_id")


@C.add("""SELECT vec_id, CAST(len(embedding) - 1 AS INT) AS n, round(CAST(embedding[2] AS DOUBLE), 6) AS first_label, round(CAST(embedding[-2] AS DOUBLE), 6) AS last_input FROM embeddings""")
def shifted_labels(s, sf):
    x = F.col("embedding")
    lab, inp = F.slice(x, F.lit(2), F.size(x) - 1), F.slice(x, F.lit(1), F.size(x) - 1)
    return table(s, sf, "embeddings").select("vec_id", F.size(lab).alias("n"), F.round(F.get(lab, F.lit(0)).cast("double"), 6).alias("first_label"), F.round(F.element_at(inp, -1).cast("double"), 6).alias("last_input"))


@C.add("""SELECT vec_id, CAST(sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS INT) AS kept, string_agg(CAST(CASE WHEN v > 0 THEN c - 1 ELSE 1 END AS VARCHAR), ',' ORDER BY t) AS position_ids FROM (SELECT vec_id, t, v, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY t) AS c FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS t FROM embeddings)) GROUP BY vec_id""")
def position_ids(s, sf):
    d = table(s, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("t", "v")).withColumn("m", (F.col("v") > 0).cast("int"))
    d = d.withColumn("c", F.sum("m").over(Window.partitionBy("vec_id").orderBy("t")))
    g = d.groupBy("vec_id").agg(F.sum("m").cast("int").alias("kept"), F.array_sort(F.collect_list(F.struct("t", F.when(F.col("m") == 1, F.col("c") - 1).otherwise(1).cast("string").alias("p")))).alias("xs"))
    return g.select("vec_id", "kept", F.array_join(F.transform("xs", lambda x: x["p"]), ",").alias("position_ids"))


@C.add("""SELECT user_id, event_id, rn = 1 AS head FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events)""")
def candidate_ranks(s, sf):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))
    return table(s, sf, "events").select("user_id", "event_id", (rn == 1).alias("head"))


@C.add("SELECT doc_id, CASE WHEN contains(source, 'rollouts') THEN 'train' WHEN contains(source, 'notes') THEN 'test' ELSE 'other' END AS route FROM documents")
def route_by_name(s, sf):
    src = F.col("source")
    return table(s, sf, "documents").select("doc_id", F.when(F.contains(src, F.lit("rollouts")), "train").when(F.contains(src, F.lit("notes")), "test").otherwise("other").alias("route"))


@C.add()
def buffer_sample(s, sf):
    """The feature is a sample: 100 events without replacement, the same in every run."""
    return table(s, sf, "events").select("event_id").orderBy(F.xxhash64(F.lit(42), "event_id"), "event_id").limit(100)


_MEANS = """SELECT pair_id, (SELECT avg(v) FROM (SELECT unnest(chosen_logprob_with_token.logprobs) AS v)) AS c, (SELECT avg(v) FROM (SELECT unnest(rejected_logprob_with_token.logprobs) AS v)) AS r FROM repo_train WHERE len(chosen_logprob_with_token.logprobs) > 0 AND len(rejected_logprob_with_token.logprobs) > 0"""


@C.add(f"""WITH m AS ({_MEANS}) SELECT pair_id, round(ln(1 + exp(-(0.5 * c - 1.2 * 0.5 * r))), 6) AS regret_loss, round(ln(1 + exp(-(0.1 * (c - r) - 0.1 * (0.3 - 0.2)))), 6) AS tdpo1, round(ln(1 + exp(-(0.1 * (c - r) - 0.5 * 0.1 * (0.3 - 0.2)))), 6) AS tdpo2, round(ln(1 + exp(r - c)), 6) AS logexp FROM m""")
def more_losses(s, sf):
    c, r = F.col("c"), F.col("r")
    t = table(s, sf, "repo_train").select("pair_id", A.mean("chosen_logprob_with_token.logprobs").alias("c"), A.mean("rejected_logprob_with_token.logprobs").alias("r")).where("c is not null and r is not null")
    o = {"regret_loss": -A.log_sigmoid(0.5 * c - 1.2 * 0.5 * r), "tdpo1": -A.log_sigmoid(0.1 * (c - r) - 0.1 * F.lit(0.3 - 0.2)), "tdpo2": -A.log_sigmoid(0.1 * (c - r) - 0.5 * 0.1 * F.lit(0.3 - 0.2)), "logexp": F.log1p(F.exp(r - c))}
    return t.select("pair_id", *[F.round(v, 6).alias(k) for k, v in o.items()])


@C.add("""WITH x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS t FROM embeddings) SELECT CAST(label AS INT) AS label, round(avg(nll), 6) AS loss FROM (SELECT vec_id, label, ln(sum(exp(v))) - max(v) FILTER (WHERE t = label + 1) AS nll FROM x WHERE label <> 0 GROUP BY vec_id, label) GROUP BY label""")
def cross_entropy(s, sf):
    """Label 0 is ignored."""
    d = table(s, sf, "embeddings").where("label <> 0").select("label", F.col("embedding").cast("array<double>").alias("x"))
    return d.groupBy("label").agg(F.round(F.avg(-A.log_softmax_at("x", F.col("label"))), 6).alias("loss"))


@C.add("""SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(value * 2 + 1), 4) AS ensemble, round(avg((value - 10) / 4), 6) AS denormalised FROM events GROUP BY user_id""")
def reward_ensemble(s, sf):
    models_ = F.array(F.col("value"), F.col("value") + 1)
    d = table(s, sf, "events").select("user_id", "value", A.total(models_).alias("e"))
    return d.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("e"), 4).alias("ensemble"), F.round(F.avg((F.col("value") - 10) / 4), 6).alias("denormalised"))


@C.add("""SELECT event_id, CAST(event_id // 12 AS BIGINT) AS row_no, CAST(event_id % 12 AS INT) AS col_no FROM events""")
def grid_layout(s, sf):
    return table(s, sf, "events").select("event_id", F.floor(F.col("event_id") / 12).alias("row_no"), (F.col("event_id") % 12).cast("int").alias("col_no"))


@C.add("""WITH x AS (SELECT vec_id, [1, 2, 3, 4, 5, 6, 7][1:1 + vec_id % 7] AS ids FROM embeddings) SELECT vec_id, array_to_string(CASE WHEN len(ids) > 4 THEN list_concat(ids[1:3], [99]) ELSE ids END, ',') AS cut, CAST(ceil(len(ids) / 4.0) * 4 - len(ids) AS INT) AS ring_pad FROM x""")
def eos_truncation(s, sf):
    ids = F.slice(F.array(*map(F.lit, range(1, 8))), F.lit(1), (F.col("vec_id") % 7 + 1).cast("int"))
    d = table(s, sf, "embeddings").select("vec_id", ids.alias("ids"))
    return d.select("vec_id", F.array_join(A.truncate_eos("ids", 4, F.lit(99)), ",").alias("cut"), (F.ceil(F.size("ids") / 4) * 4 - F.size("ids")).cast("int").alias("ring_pad"))


_SIDE = "len(regexp_replace(coalesce({0}, ''), '[^aeiou]', '', 'g')) / CAST(greatest(len(coalesce({0}, '')), 1) AS DOUBLE) + len(coalesce({0}_model, '')) / 100.0"


@C.add(f"SELECT pair_id, 1 AS label, round({_SIDE.format('chosen')}, 6) AS score FROM repo_train UNION ALL SELECT pair_id, 0, round({_SIDE.format('rejected')}, 6) FROM repo_train")
def score_once(s, sf):
    """Chosen and rejected in one pass: each distinct call of the stub scorer is made once."""
    t = table(s, sf, "repo_train")
    sides = P.unpair(t.select("pair_id", "prompt", "chosen_model", "rejected_model", "chosen", "rejected"), ["pair_id", "prompt", "chosen_model", "rejected_model"])
    sides = sides.withColumn("model", F.when(F.col("label") == 1, F.col("chosen_model")).otherwise(F.col("rejected_model")))
    got = models.score_once(sides, "model", "prompt", "response", models.stub_score)
    return got.select("pair_id", "label", F.round("score", 6).alias("score"))


@C.add("""WITH x AS (SELECT log_id, extracted_last_answers AS a, gold_answers AS b, TRY_CAST(trim(extracted_last_answers) AS DOUBLE) AS x, TRY_CAST(trim(gold_answers) AS DOUBLE) AS y FROM eval_log)
SELECT log_id, coalesce(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN abs(x - y) <= 1e-6 * greatest(abs(x), abs(y)) ELSE regexp_replace(a, '\\s+', '', 'g') = regexp_replace(b, '\\s+', '', 'g') END, false) AS correct FROM x""")
def guarded_grading(s, sf):
    """Equal texts and numbers are settled by columns; only the rest reaches the costly step, here a stub that says no."""
    a, b = F.col("extracted_last_answers"), F.col("gold_answers")
    cheap = F.when(T.answer_equal(a, b), F.lit(True)).when(T.python_float(a).isNotNull() & T.python_float(b).isNotNull(), F.lit(False))
    d = table(s, sf, "eval_log").select("log_id", "extracted_last_answers", "gold_answers")
    return models.guarded(d, cheap, lambda rest: rest.withColumn("correct", F.lit(False)), "correct").select("log_id", "correct")


@C.add("""SELECT prompt_id, CAST(length(min(prompt)) % 5 + 1 AS INT) AS rating FROM generation GROUP BY prompt_id""")
def judge_ratings(s, sf):
    g = table(s, sf, "generation").groupBy("prompt_id").agg(F.min("prompt").alias("prompt"))
    return models.judged_by(g, "prompt", models.stub_judge).select("prompt_id", F.get(T.ratings(F.col("judgement")), F.lit(0)).alias("rating"))


@C.add("""SELECT event_id, CASE WHEN event_id >= 2000 AND event_id < 3000 THEN 'third' ELSE 'other' END AS part FROM events WHERE event_id >= 1000 AND event_id < 3000""")
def line_window(s, sf):
    """A window of lines [1000, 3000) and the third iteration's slice of 1000."""
    d = order.ordinal(table(s, sf, "events").select("event_id"), "event_id")
    return d.where("ord >= 1000 and ord < 3000").select("event_id", F.when(F.col("ord") >= 2000, "third").otherwise("other").alias("part"))
