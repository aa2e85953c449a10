"""Records into templates, chats, token layouts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import arrays as A, text as T
from ..operators import order
from ..plans.registry import Catalog
from ..sources.tables import table

C = Catalog()

#: Prompt templates of our own by name.
TEMPLATES = {"plain": "{input}", "steps": "Question: {input}\nLet us go step by step.\n", "chatml": "<|im_start|>user\n{input}<|im_end|>\n<|im_start|>assistant\n", "boxed": "{input}\nPut the result in a box."}
ASPECTS = {"helpfulness": "How helpful is each text?", "honesty": "How honest is each text?", "accuracy": "How accurate is each text?", "obedience": "How well does each text follow the task?"}
_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("\n", "\\n")) for k, v in TEMPLATES.items())


@C.add(rf"""WITH t AS (SELECT * FROM (VALUES {_ROWS}) AS v(name, body)) SELECT problem_index AS data_id, name, md5(replace(replace(body, '\n', chr(10)), '{{input}}', question)) AS prompt, answer AS label FROM math_problem CROSS JOIN t""")
def template_prompts(s, sf):
    # one explode of a literal array: no join at all
    t = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("body")) for k, v in TEMPLATES.items()]))
    d = table(s, sf, "math_problem").select("problem_index", "question", "answer", t.alias("t"))
    return d.select(F.col("problem_index").alias("data_id"), "t.name", F.md5(F.replace(F.col("t.body"), F.lit("{input}"), F.col("question"))).alias("prompt"), F.col("answer").alias("label"))


@C.add("""SELECT problem_index, md5('Task: ' || question || chr(10) || 'Reply:') AS prompt, md5(question) AS input FROM math_problem WHERE question IS NOT NULL""")
def retemplate(s, sf):
    pre, post = "<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"
    d = table(s, sf, "math_problem").where("question is not null").select("problem_index", F.concat(F.lit(pre), "question", F.lit(post)).alias("chat"))
    return d.select("problem_index", F.md5(T.retemplated(F.col("chat"), pre, post, "Task: {input}\nReply:")).alias("prompt"), F.md5(T.user_turn(F.col("chat"))).alias("input"))


@C.add("""WITH a AS (SELECT * FROM (VALUES ('helpfulness'), ('honesty'), ('accuracy'), ('obedience')) v(aspect)), g AS (SELECT prompt_id, min(prompt) AS prompt, string_agg(response, chr(10) ORDER BY model, generated_at, response) AS texts, count(response) AS n FROM generation WHERE response IS NOT NULL GROUP BY prompt_id)
SELECT prompt_id, aspect, CAST(n AS BIGINT) AS texts, md5(aspect || chr(10) || prompt || chr(10) || texts) AS prompt FROM g CROSS JOIN a""")
def judge_prompts(s, sf):
    g = table(s, sf, "generation").where("response is not null").groupBy("prompt_id").agg(F.min("prompt").alias("prompt"), F.array_sort(F.collect_list(F.struct("model", "generated_at", "response"))).alias("xs"))
    body = F.array_join(F.transform("xs", lambda x: x["response"]), "\n")
    return g.select("prompt_id", F.explode(F.array(*map(F.lit, ASPECTS))).alias("aspect"), F.size("xs").cast("bigint").alias("texts"), "prompt", body.alias("body")).select("prompt_id", "aspect", "texts", F.md5(F.concat_ws("\n", "aspect", "prompt", "body")).alias("prompt"))


@C.add("""SELECT pair_id, coalesce(md5(nullif(trim(chosen_model), '')), 'none') AS model, CASE WHEN answer_label IS NULL THEN 'default' ELSE answer_label END AS label, 0 AS margin, prompt IS NOT NULL AND chosen IS NOT NULL AND rejected IS NOT NULL AS complete FROM repo_train""")
def preference_records(s, sf):
    m = F.nullif(F.trim("chosen_model"), F.lit(""))
    whole = F.col("prompt").isNotNull() & F.col("chosen").isNotNull() & F.col("rejected").isNotNull()
    return table(s, sf, "repo_train").select("pair_id", F.coalesce(F.md5(m), F.lit("none")).alias("model"), F.coalesce("answer_label", F.lit("default")).alias("label"), F.lit(0).alias("margin"), whole.alias("complete"))


@C.add("""SELECT problem_index, CASE WHEN response IS NULL THEN 2 ELSE 3 END AS turns, 'system' AS first_role, CASE WHEN response IS NULL THEN 'user' ELSE 'assistant' END AS last_role, md5(CASE WHEN response IS NULL THEN question ELSE response END) AS last_text, md5('<|im_start|>system' || chr(10) || 'Be exact.<|im_end|>' || chr(10) || CASE WHEN response IS NULL THEN '' ELSE '<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10) END) AS prompt FROM math_problem WHERE question IS NOT NULL""")
def chat_turns(s, sf):
    msg = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    d = table(s, sf, "math_problem").where("question is not null")
    raw = F.when(F.col("response").isNull(), F.array(msg("user", F.col("question")))).otherwise(F.array(msg("user", F.col("question")), msg("assistant", F.col("response"))))
    d = d.select("problem_index", raw.alias("m"))
    fixed = F.when(F.get("m", F.lit(0))["role"] != "system", F.concat(F.array(msg("system", F.lit("Be exact."))), F.col("m"))).otherwise(F.col("m"))
    d = d.withColumn("m", fixed).where(F.forall("m", lambda x: x["role"].isNotNull() & x["content"].isNotNull()))
    last = F.element_at("m", -1)
    head = F.transform(F.slice("m", F.lit(1), F.size("m") - 1), lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["content"], F.lit("<|im_end|>\n")))
    return d.select("problem_index", F.size("m").alias("turns"), F.get("m", F.lit(0))["role"].alias("first_role"), last["role"].alias("last_role"), F.md5(last["content"]).alias("last_text"), F.md5(F.array_join(head, "")).alias("prompt"))


@C.add("""SELECT problem_index, CAST(len(string_split(question, ' ')) AS INT) AS start, CAST(len(string_split(question, ' ')) + len(string_split(response, ' ')) AS INT) AS stop FROM math_problem WHERE response IS NOT NULL AND question IS NOT NULL""")
def response_ranges(s, sf):
    d = table(s, sf, "math_problem").where("response is not null and question is not null")
    n = F.transform(F.array("question", "response"), lambda t: F.size(F.split(t, " ")))
    stop = F.aggregate(n, F.lit(0), lambda acc, k: acc + k)
    return d.select("problem_index", F.get(n, F.lit(0)).alias("start"), stop.alias("stop"))


@C.add("""SELECT benchmark AS dataset, item_id AS id, CASE WHEN lang = 'en' THEN question || chr(10) || 'Answer:' ELSE question END AS question, coalesce(TRY_CAST(replace(answer, ',', '') AS DOUBLE), -1) AS answer FROM benchmark_item""")
def benchmark_adapters(s, sf):
    q = F.when(F.col("lang") == "en", F.concat("question", F.lit("\nAnswer:"))).otherwise(F.col("question"))
    return table(s, sf, "benchmark_item").select(F.col("benchmark").alias("dataset"), F.col("item_id").alias("id"), q.alias("question"), F.coalesce(F.replace("answer", F.lit(","), F.lit("")).try_cast("double"), F.lit(-1.0)).alias("answer"))


@C.add(r"""SELECT doc_id, NOT regexp_matches(text, '[^\x09\x0A\x0D\x20-\x{1D7F}\x{2000}-\x{22FF}]') AS accepted FROM documents WHERE text IS NOT NULL""")
def valid_text(s, sf):
    return table(s, sf, "documents").where("text is not null").select("doc_id", (~F.col("text").rlike(r"[^\x09\x0A\x0D\x20-\x{1D7F}\x{2000}-\x{22FF}]")).alias("accepted"))


@C.add("SELECT pair_id, CAST(len(string_split(prompt, ' ')) AS INT) AS tokens FROM repo_train WHERE prompt IS NOT NULL AND len(string_split(prompt, ' ')) < 96 - 2")
def overlength_filter(s, sf):
    n = F.size(F.split("prompt", " "))
    return table(s, sf, "repo_train").where("prompt is not null").select("pair_id", n.alias("tokens")).where("tokens < 96 - 2")


@C.add("""SELECT pair_id, array_to_string(chosen_logprob_with_token.tokens, '') = chosen AS rebuilt, len(chosen_logprob_with_token.tokens) = len(chosen_logprob_with_token.logprobs) AS aligned FROM repo_train WHERE chosen_logprob_with_token IS NOT NULL AND chosen IS NOT NULL""")
def reconstruction_check(s, sf):
    t = F.col("chosen_logprob_with_token")
    return table(s, sf, "repo_train").where("chosen_logprob_with_token is not null and chosen is not null").select("pair_id", (F.array_join(t["tokens"], "") == F.col("chosen")).alias("rebuilt"), (F.size(t["tokens"]) == F.size(t["logprobs"])).alias("aligned"))


@C.add("""WITH t AS (SELECT pair_id, chosen_logprob_with_token.tokens AS x FROM repo_train WHERE chosen_logprob_with_token IS NOT NULL), m AS (SELECT pair_id, x, unnest([0, 1, 2, 3, 4]) AS mask FROM t)
SELECT pair_id, CAST(mask AS INT) AS mask, CAST(len(x) - 16 * mask AS INT) AS cut, md5(array_to_string(x[1:len(x) - 16 * mask], '')) AS prefix FROM m WHERE len(x) - 16 * mask > 0""")
def mask_variants(s, sf):
    d = table(s, sf, "repo_train").where("chosen_logprob_with_token is not null").select("pair_id", F.col("chosen_logprob_with_token.tokens").alias("x"))
    d = d.select("pair_id", "x", F.inline(A.prefix_variants("x")))
    return d.select("pair_id", "mask", "cut", F.md5(F.array_join(F.slice("x", F.lit(1), F.col("cut")), "")).alias("prefix"))


@C.add("""WITH t AS (SELECT pair_id, len(chosen_logprob_with_token.tokens) AS n FROM repo_train WHERE chosen_logprob_with_token IS NOT NULL), m AS (SELECT pair_id, n - 16 * mask AS cut, mask FROM (SELECT pair_id, n, unnest([0, 1, 2, 3, 4]) AS mask FROM t) WHERE n - 16 * mask > 0)
SELECT a.pair_id, CAST(a.mask AS INT) AS chosen_mask, CAST(b.mask AS INT) AS rejected_mask FROM m a JOIN m b ON a.pair_id = b.pair_id AND a.mask < b.mask""")
def mask_pairs_all(s, sf):
    d = table(s, sf, "repo_train").where("chosen_logprob_with_token is not null").select("pair_id", A.prefix_variants("chosen_logprob_with_token.tokens").alias("v"))
    return d.select("pair_id", "v", F.explode("v.mask").alias("chosen_mask")).select("pair_id", "chosen_mask", F.explode("v.mask").alias("rejected_mask")).where("chosen_mask < rejected_mask")


@C.add("""WITH x AS (SELECT vec_id, [CAST(vec_id AS INT), label, 7] AS ids, vec_id % 3 AS np FROM embeddings), m AS (SELECT vec_id, ids[1:1 + np] AS ids, np FROM x)
SELECT vec_id, array_to_string(list_concat(ids, [0, 0, 0, 0, 0][1:5 - len(ids)]), ',') AS right_padded, array_to_string(list_concat([0, 0, 0, 0, 0][1:5 - len(ids)], ids), ',') AS left_padded, array_to_string(list_transform(ids, lambda v, i: CASE WHEN i <= np THEN -100 ELSE v END), ',') AS labels FROM m""")
def pad_pack(s, sf):
    np_ = F.col("vec_id") % 3
    d = table(s, sf, "embeddings").select("vec_id", F.slice(F.array(F.col("vec_id").cast("int"), "label", F.lit(7)), F.lit(1), (np_ + 1).cast("int")).alias("ids"), np_.alias("np"))
    j = lambda x: F.array_join(x, ",")
    return d.select("vec_id", j(A.pad("ids", F.lit(5), 0)).alias("right_padded"), j(A.pad("ids", F.lit(5), 0, True)).alias("left_padded"), j(A.label_mask("ids", F.col("np"))).alias("labels"))


@C.add("""WITH g AS (SELECT vec_id // 4 AS pack, vec_id, label % 3 + 1 AS n FROM embeddings), e AS (SELECT pack, vec_id, n, row_number() OVER (PARTITION BY pack ORDER BY vec_id) AS seg, sum(n) OVER (PARTITION BY pack ORDER BY vec_id ROWS UNBOUNDED PRECEDING) - n AS start FROM g), t AS (SELECT pack, seg, start, unnest(generate_series(0, n - 1)) AS k FROM e)
SELECT pack, CAST(start + k AS BIGINT) AS pos, CAST(seg AS INT) AS segment, CAST(k AS INT) AS position_id FROM t""")
def packed_positions(s, sf):
    d = table(s, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("pack"), "vec_id", (F.col("label") % 3 + 1).alias("n"))
    w = Window.partitionBy("pack").orderBy("vec_id")
    d = d.select("pack", F.row_number().over(w).alias("segment"), "n", (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    return d.select("pack", "segment", "start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("position_id")).select("pack", (F.col("start") + F.col("position_id")).alias("pos"), "segment", "position_id")


@C.add("""WITH r AS (SELECT item_id, answer, unnest(generate_series(0, 2)) AS rep FROM benchmark_item) SELECT item_id, CAST(rep AS INT) AS rep, CAST(rep * (SELECT count(*) FROM benchmark_item) + row_number() OVER (PARTITION BY rep ORDER BY item_id) - 1 AS BIGINT) AS block_order, CAST((row_number() OVER (PARTITION BY rep ORDER BY item_id) - 1) * 3 + rep AS BIGINT) AS adjacent_order FROM r""")
def replicate_prompts(s, sf):
    d = order.with_count(order.ordinal(table(s, sf, "benchmark_item").select("item_id"), "item_id"))
    d = d.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return d.select("item_id", "rep", (F.col("rep") * F.col("n") + F.col("ord")).alias("block_order"), (F.col("ord") * 3 + F.col("rep")).alias("adjacent_order"))


@C.add(r"""WITH x AS (SELECT pair_id, string_split(chosen, chr(10)) AS p FROM repo_train WHERE chosen IS NOT NULL), e AS (SELECT pair_id, len(p) AS n, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM x)
SELECT pair_id, CAST(i - 1 AS INT) AS step, CAST(sum(length(piece) + CASE WHEN i < n THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_offset FROM e""")
def step_split(s, sf):
    d = table(s, sf, "repo_train").where("chosen is not null").select("pair_id", F.posexplode(T.step_pieces(F.col("chosen"))).alias("step", "piece"))
    w = Window.partitionBy("pair_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("pair_id", "step", F.sum(F.length("piece")).over(w).cast("bigint").alias("end_offset"))


@C.add("""WITH r AS (SELECT data_id, batch_no, model, arrived_at, unnest(responses) AS r, generate_subscripts(responses, 1) AS pos FROM rollout_batch)
SELECT data_id, batch_no, model, CAST(count(*) AS BIGINT) AS steps, CAST(max(CASE WHEN r.is_correct THEN pos - 1 END) AS BIGINT) AS last_right, string_agg(CASE WHEN r.is_correct IS NULL THEN '?' WHEN r.is_correct THEN '+' ELSE '-' END, '' ORDER BY pos) AS labels FROM r GROUP BY data_id, batch_no, model, arrived_at""")
def process_labels(s, sf):
    ok = F.col("responses.is_correct")
    lab = F.array_join(F.transform(ok, lambda v: F.when(v.isNull(), "?").when(v, "+").otherwise("-")), "")
    mask = F.transform(ok, lambda v: F.coalesce(v, F.lit(False)))
    return table(s, sf, "rollout_batch").select("data_id", "batch_no", "model", F.size("responses").cast("bigint").alias("steps"), F.when(F.exists(mask, lambda v: v), A.last_valid(mask)).cast("bigint").alias("last_right"), lab.alias("labels"))
