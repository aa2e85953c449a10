"""Rewards, generations and rollouts into pairs; splits, shards and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import order, preference as P
from ..plans.registry import Catalog, Transforms
from ..sources.tables import concat, table

C = Catalog()

#: Post-processors of scored samples by name.
transforms = Transforms()
transforms.register("rs", P.best_of_n)
transforms.register("iter_dpo", P.best_and_worst)
transforms.register("csft", P.conditional)


def scored(s: SparkSession, sf: str) -> DataFrame:
    """events as scored samples: a prompt, an output in order, a reward."""
    return table(s, sf, "events").select(F.col("user_id").alias("prompt"), F.col("event_id").alias("output"), F.col("value").alias("reward"), F.col("event_type").alias("model"), F.col("event_id").alias("ord"))


_SCORED = "SELECT user_id AS prompt, event_id AS output, value AS reward, event_type AS model, event_id AS ord FROM events"


@C.add(f"""SELECT prompt, output, reward FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY reward DESC, ord) AS rn FROM ({_SCORED})) WHERE rn = 1""")
def best_of_n(s, sf):
    return transforms.apply("rs", scored(s, sf), prompt="prompt", output="output", reward="reward", ord_="ord")


@C.add(f"""WITH s AS ({_SCORED}), r AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY reward DESC, ord) AS hi, row_number() OVER (PARTITION BY prompt ORDER BY reward, ord) AS lo FROM s)
SELECT a.prompt, a.output AS chosen, a.reward AS chosen_reward, b.output AS rejected, b.reward AS rejected_reward FROM r a JOIN r b ON a.prompt = b.prompt AND a.hi = 1 AND b.lo = 1""")
def iter_dpo_pairs(s, sf):
    return transforms.apply("iter_dpo", scored(s, sf), prompt="prompt", output="output", reward="reward", ord_="ord")


@C.add(f"SELECT output, round((reward - avg(reward) OVER ()) / stddev_samp(reward) OVER (), 6) AS z FROM ({_SCORED})")
def reward_zscore(s, sf):
    return P.zscore(scored(s, sf), "reward", "z").select("output", F.round("z", 6).alias("z"))


@C.add(f"SELECT output, 'User ' || prompt || ' <rm_score>: ' || printf('%.2f', reward) || ' ' AS text FROM ({_SCORED})")
def csft_prompt(s, sf):
    d = scored(s, sf).withColumn("prompt", F.concat(F.lit("User "), "prompt"))
    return transforms.apply("csft", d, text="prompt", reward="reward").select("output", "text")


_ROLL = "SELECT data_id, batch_no, model, arrived_at, query_text, unnest(responses) AS r, generate_subscripts(responses, 1) AS pos FROM rollout_batch"


@C.add("""WITH b AS (SELECT * FROM rollout_batch WHERE len(list_distinct(list_transform(responses, lambda x: coalesce(x.gold_answer, chr(1))))) = 1),
p AS (SELECT data_id, batch_no, model, arrived_at, unnest(list_filter(responses, lambda x: x.is_correct)) AS p, list_filter(responses, lambda x: NOT x.is_correct) AS n FROM b),
q AS (SELECT data_id, batch_no, model, arrived_at, p, unnest(n) AS n FROM p)
SELECT data_id, batch_no, model, md5(p.text) AS chosen, md5(n.text) AS rejected, p.gold_answer AS answer FROM q""")
def pref_pair_product(s, sf):
    d = P.answer_pairs(table(s, sf, "rollout_batch").select("data_id", "batch_no", "model", "responses"))
    return d.select("data_id", "batch_no", "model", F.md5("positive.text").alias("chosen"), F.md5("negative.text").alias("rejected"), F.col("positive.gold_answer").alias("answer"))


@C.add("""WITH b AS (SELECT data_id, batch_no, model, arrived_at, len(list_filter(responses, lambda x: x.is_correct)) AS np, len(list_filter(responses, lambda x: NOT x.is_correct)) AS nn FROM rollout_batch WHERE len(list_distinct(list_transform(responses, lambda x: coalesce(x.gold_answer, chr(1))))) = 1)
SELECT data_id, batch_no, CAST(np AS BIGINT) AS num_positives, CAST(nn AS BIGINT) AS num_negatives, CAST(sum(np * nn) OVER (ORDER BY arrived_at, data_id, batch_no, model ROWS UNBOUNDED PRECEDING) AS BIGINT) AS num_pairs FROM b WHERE np > 0 AND nn > 0""")
def pair_metadata(s, sf):
    d = table(s, sf, "rollout_batch")
    one = F.size(F.array_distinct(F.transform("responses", lambda r: F.coalesce(r["gold_answer"], F.lit("\u0001"))))) == 1
    n = lambda v: F.size(F.filter("responses", lambda r: r["is_correct"] == v)).cast("bigint")
    d = d.where(one).select("data_id", "batch_no", "model", "arrived_at", n(True).alias("num_positives"), n(False).alias("num_negatives")).where("num_positives > 0 and num_negatives > 0")
    d = d.withColumn("product", F.col("num_positives") * F.col("num_negatives"))
    d = order.running_total(d, F.date_trunc("hour", F.col("arrived_at")), ["arrived_at", "data_id", "batch_no", "model"], "product", "num_pairs")
    return d.select("data_id", "batch_no", "num_positives", "num_negatives", "num_pairs")


@C.add(f"SELECT data_id, round(avg(CAST(r.is_correct AS DOUBLE)), 6) AS acc, count(*) AS n FROM ({_ROLL}) GROUP BY data_id HAVING avg(CAST(r.is_correct AS DOUBLE)) > 0 AND avg(CAST(r.is_correct AS DOUBLE)) < 1")
def mixed_outcome_filter(s, sf):
    r = table(s, sf, "rollout_batch").select("data_id", F.explode("responses.is_correct").alias("ok"))
    return r.groupBy("data_id").agg(F.avg(F.col("ok").cast("double")).alias("acc"), F.count("*").alias("n")).where("acc > 0 and acc < 1").select("data_id", F.round("acc", 6).alias("acc"), "n")


@C.add("""WITH w AS (SELECT model FROM generation WHERE model IS NOT NULL GROUP BY model ORDER BY count(*) DESC, model LIMIT 2),
l AS (SELECT prompt_id, model, prompt, response, generated_at, row_number() OVER (PARTITION BY prompt_id, model ORDER BY generated_at DESC, response DESC NULLS LAST) AS rn FROM generation WHERE model IN (SELECT model FROM w)),
k AS (SELECT * FROM l WHERE rn = 1), c AS (SELECT prompt_id FROM k GROUP BY prompt_id HAVING count(*) = 2), f AS (SELECT prompt_id, arg_min(prompt, struct_pack(a := generated_at, b := prompt)) AS prompt FROM l GROUP BY prompt_id)
SELECT prompt_id, model, md5(response) AS response, md5(f.prompt) AS prompt FROM k JOIN f USING (prompt_id) WHERE prompt_id IN (SELECT prompt_id FROM c)""")
def merge_models(s, sf):
    """The last responses of the two models with most of them, of prompts that both answered, and the prompt's first text."""
    g = table(s, sf, "generation").where("model is not null").select("prompt_id", "model", "prompt", "response", "generated_at")
    # the list of models is a configuration, here read off the table: two names reach the driver
    needed = [r[0] for r in g.groupBy("model").count().orderBy(F.desc("count"), "model").limit(2).collect()]
    own = P.complete(g, "prompt_id", "model", needed)
    last = P.last_by_model(own.drop("prompt"), "prompt_id", "model", ["generated_at", "response"])
    first = own.groupBy("prompt_id").agg(F.min_by("prompt", F.struct("generated_at", "prompt")).alias("prompt"))
    return last.join(first, "prompt_id").select("prompt_id", "model", F.md5("response").alias("response"), F.md5("prompt").alias("prompt"))


@C.add("""WITH l AS (SELECT prompt_id, model, length(response) AS n, row_number() OVER (PARTITION BY prompt_id, model ORDER BY generated_at DESC, response DESC NULLS LAST) AS rn FROM generation)
SELECT prompt_id, CAST(count(*) AS BIGINT) AS size, string_agg(model || '=' || coalesce(CAST(n AS VARCHAR), '-'), ',' ORDER BY model) AS entries FROM l WHERE rn = 1 GROUP BY prompt_id""")
def merged_map(s, sf):
    g = table(s, sf, "generation").select("prompt_id", "model", "response", "generated_at")
    last = P.last_by_model(g, "prompt_id", "model", ["generated_at", "response"])
    m = last.groupBy("prompt_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.coalesce(F.length("response").cast("string"), F.lit("-")).alias("n"))))).alias("m"))
    return m.select("prompt_id", F.size("m").cast("bigint").alias("size"), F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("entries"))


_RATED = "SELECT user_id AS prompt, event_type AS model, round(avg(value), 6) AS rating FROM events GROUP BY user_id, event_type"


@C.add(f"""WITH r AS ({_RATED}), x AS (SELECT *, max(rating) OVER (PARTITION BY prompt) AS hi, min(rating) OVER (PARTITION BY prompt) AS lo FROM r)
SELECT prompt, min(model) FILTER (WHERE rating = hi) AS chosen_model, min(model) FILTER (WHERE rating < hi) AS rejected_model, max(hi) AS chosen_rating FROM x WHERE hi > lo GROUP BY prompt""")
def binarise_pairs(s, sf):
    r = table(s, sf, "events").groupBy(F.col("user_id").alias("prompt"), F.col("event_type").alias("model")).agg(F.round(F.avg("value"), 6).alias("rating"))
    return P.binarise(r, "prompt", "model", "rating")


@C.add("""SELECT md5(prompt) AS prompt, 'chosen' AS side, md5(chosen) AS text, min(pair_id) AS first_id FROM repo_train WHERE prompt <> '' AND chosen IS NOT NULL GROUP BY ALL
UNION ALL SELECT md5(prompt), 'rejected', md5(rejected), min(pair_id) FROM repo_train WHERE prompt <> '' AND rejected IS NOT NULL GROUP BY ALL""")
def regroup_distinct(s, sf):
    d = table(s, sf, "repo_train").where("prompt <> ''").select("pair_id", F.md5("prompt").alias("prompt"), F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.md5("chosen").alias("text")), F.struct(F.lit("rejected").alias("side"), F.md5("rejected").alias("text")))).alias("x"))
    return d.where("x.text is not null").groupBy("prompt", "x.side", "x.text").agg(F.min("pair_id").alias("first_id"))


@C.add("SELECT CAST(('0x' || right(md5(text), 8)) AS BIGINT) % 1024 AS bucket, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT text) AS BIGINT) AS texts FROM documents WHERE text IS NOT NULL GROUP BY 1")
def bucketed_regroup(s, sf):
    b = F.conv(F.right(F.md5("text"), F.lit(8)), 16, 10).cast("bigint") % 1024
    d = table(s, sf, "documents").where("text is not null").groupBy(b.alias("bucket"), F.md5("text").alias("h")).agg(F.count("*").alias("n"))
    return d.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))


@C.add(f"""WITH s AS ({_SCORED}), c AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY reward DESC, ord) AS rn FROM s WHERE model = 'purchase'), r AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY reward DESC, ord) AS rn FROM s WHERE model <> 'purchase')
SELECT c.prompt, c.output AS chosen, r.output AS rejected FROM c JOIN r ON c.prompt = r.prompt WHERE c.rn <= 2 AND r.rn <= 2""")
def topk_pairs(s, sf):
    d = scored(s, sf)
    return P.top_k_pairs(d.where("model = 'purchase'"), d.where("model <> 'purchase'"), "prompt", "output", "reward", "ord", 2)


@C.add(f"""WITH s AS ({_SCORED}), t AS (SELECT *, row_number() OVER (PARTITION BY prompt, model = 'purchase' ORDER BY reward DESC, ord) AS rn FROM s)
SELECT a.prompt, a.model = 'purchase' AS correct, a.output AS chosen, b.output AS rejected FROM t a JOIN t b ON a.prompt = b.prompt AND (a.model = 'purchase') = (b.model = 'purchase') AND a.rn = 1 AND b.rn = 2""")
def intraset_pairs(s, sf):
    return P.intra_set_pairs(scored(s, sf).withColumn("correct", F.col("model") == "purchase"), ["prompt", "correct"], "output", "reward", "ord")


@C.add(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY reward DESC, ord) AS rn FROM ({_SCORED}) WHERE model = 'purchase')
SELECT a.prompt, a.output AS chosen, b.output AS rejected FROM t a JOIN t b ON a.prompt = b.prompt AND a.rn <= 6 AND b.rn <= 6 AND a.reward > b.reward""")
def chosen_only_pairs(s, sf):
    return P.strict_pairs(scored(s, sf).where("model = 'purchase'"), ["prompt"], "output", "reward", "ord", 6)


@C.add("SELECT problem_index, md5(question) AS question FROM math_problem WHERE problem_index NOT IN (SELECT data_id FROM rollout_batch WHERE data_id IS NOT NULL)")
def exclude_done(s, sf):
    done = table(s, sf, "rollout_batch").select("data_id").distinct()
    m = table(s, sf, "math_problem")
    return m.join(done, m.problem_index == done.data_id, "left_anti").select("problem_index", F.md5("question").alias("question"))


@C.add("""SELECT data_id FROM (SELECT DISTINCT data_id FROM rollout_batch UNION SELECT DISTINCT data_id FROM eval_log)""")
def processed_ids(s, sf):
    return table(s, sf, "rollout_batch").select("data_id").union(table(s, sf, "eval_log").select("data_id")).distinct()


@C.add("""SELECT pair_id, CASE WHEN contains(chosen_model, 'quill') THEN 'A' WHEN contains(chosen_model, 'larch') THEN 'B' END AS chosen_scorer, CASE WHEN contains(chosen_model, 'quill') THEN 'B' WHEN contains(chosen_model, 'larch') THEN 'A' END AS rejected_scorer FROM repo_train""")
def model_routing(s, sf):
    m = F.col("chosen_model")
    pick = lambda a, b: F.when(F.contains(m, F.lit("quill")), a).when(F.contains(m, F.lit("larch")), b)
    return table(s, sf, "repo_train").select("pair_id", pick("A", "B").alias("chosen_scorer"), pick("B", "A").alias("rejected_scorer"))


@C.add("""WITH sc AS (SELECT model, CAST(count(*) AS BIGINT) AS score FROM eval_log GROUP BY model)
SELECT pair_id, coalesce(CAST(len(chosen_logprob_with_token.logprobs) AS BIGINT), a.score) AS chosen_score, coalesce(CAST(len(rejected_logprob_with_token.logprobs) AS BIGINT), b.score) AS rejected_score FROM repo_train t LEFT JOIN sc a ON t.chosen_model = a.model LEFT JOIN sc b ON t.rejected_model = b.model""")
def score_fill_by_model(s, sf):
    sc = table(s, sf, "eval_log").groupBy("model").agg(F.count("*").alias("score"))
    t = table(s, sf, "repo_train").select("pair_id", "chosen_model", "rejected_model", F.size("chosen_logprob_with_token.logprobs").cast("bigint").alias("c"), F.size("rejected_logprob_with_token.logprobs").cast("bigint").alias("r"))
    # one row a model: no side of the pair is shuffled while the scores are few, else AQE plans a shuffle join
    out = t.join(sc.select(F.col("model").alias("chosen_model"), F.col("score").alias("cs")), "chosen_model", "left").join(sc.select(F.col("model").alias("rejected_model"), F.col("score").alias("rs")), "rejected_model", "left")
    return out.select("pair_id", F.coalesce("c", "cs").alias("chosen_score"), F.coalesce("r", "rs").alias("rejected_score"))


@C.add("""WITH b AS (SELECT pair_id, pair_id // 64 AS batch, md5(rejected) AS response FROM repo_train)
SELECT pair_id, coalesce(lead(response) OVER w, first_value(response) OVER w) AS unmatched FROM (SELECT *, count(*) OVER (PARTITION BY batch) AS n FROM (SELECT pair_id, batch, coalesce(response, '') AS response FROM b)) WINDOW w AS (PARTITION BY batch ORDER BY pair_id)""")
def kto_unmatched(s, sf):
    d = table(s, sf, "repo_train").select("pair_id", F.floor(F.col("pair_id") / 64).alias("batch"), F.coalesce(F.md5("rejected"), F.lit("")).alias("response"))
    return P.rotated(d, "batch", "pair_id", "response", "unmatched").select("pair_id", "unmatched")


@C.add("SELECT pair_id, md5(chosen) AS response, 1 AS label FROM repo_train UNION ALL SELECT pair_id, md5(rejected), 0 FROM repo_train")
def unpair(s, sf):
    d = table(s, sf, "repo_train").select("pair_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))
    return P.unpair(d, ["pair_id"])


@C.add("SELECT r_regionkey, n_nationkey, r_name || '/' || n_name AS cell FROM region CROSS JOIN nation")
def grid_cross(s, sf):
    # both sides are fixed configuration lists of a few rows
    r, n = table(s, sf, "region"), table(s, sf, "nation")
    return r.crossJoin(F.broadcast(n)).select("r_regionkey", "n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("cell"))


@C.add(f"""SELECT output, round(reward - avg(reward) OVER w + 1e-9, 6) AS centred, round(CASE WHEN count(*) OVER w > 1 THEN reward - (sum(reward) OVER w - reward) / (count(*) OVER w - 1) END + 1e-9, 6) AS rloo, round(CASE WHEN count(*) OVER w > 1 THEN (reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-9) END + 1e-9, 6) AS normed FROM ({_SCORED}) WINDOW w AS (PARTITION BY prompt)""")
def shaped_rewards(s, sf):
    return P.shaped_rewards(scored(s, sf), "prompt", "reward").select("output", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("centred", "rloo", "normed")])


def _dense(s, sf):
    d = order.ordinal(table(s, sf, "orders").select("o_orderkey"), "o_orderkey")
    return order.with_count(d)


_DENSE = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, count(*) OVER () AS n FROM orders"


@C.add(f"SELECT o_orderkey, CAST(ord AS BIGINT) AS ord FROM ({_DENSE})")
def dense_index(s, sf):
    return _dense(s, sf).select("o_orderkey", "ord")


@C.add("SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS shard FROM orders")
def rank_shards_ntile(s, sf):
    return _dense(s, sf).select("o_orderkey", order.ntile_shard(F.col("ord"), F.col("n"), 7).alias("shard"))


@C.add(f"SELECT o_orderkey, CAST(floor(ord / ceil(n / 7.0)) AS INTEGER) AS shard FROM ({_DENSE})")
def chunk_shards(s, sf):
    return _dense(s, sf).select("o_orderkey", order.chunk_shard(F.col("ord"), F.col("n"), 7).alias("shard"))


@C.add(f"SELECT o_orderkey, CAST(ord % 7 AS INTEGER) AS shard FROM ({_DENSE})")
def strided_shards(s, sf):
    return _dense(s, sf).select("o_orderkey", (F.col("ord") % 7).cast("int").alias("shard"))


@C.add(f"""WITH d AS ({_DENSE}), t AS (SELECT *, ceil(n / 7.0) * 7 AS total FROM d), p AS (SELECT o_orderkey, ord AS pos FROM t UNION ALL SELECT o_orderkey, ord + n FROM t WHERE ord + n < total)
SELECT o_orderkey, CAST(pos % 7 AS INTEGER) AS replica, CAST(floor(pos / 7.0) AS BIGINT) AS step FROM p""")
def sampler_shards(s, sf):
    d = order.ordinal(table(s, sf, "orders").select("o_orderkey"), "o_orderkey")
    return order.sampler(d, "ord", 7).select("o_orderkey", "replica", F.col("step").cast("bigint").alias("step"))


@C.add()
def sampler_shuffled(s, sf):
    d = table(s, sf, "orders").select("o_orderkey").withColumn("h", F.pmod(F.xxhash64(F.lit(42), "o_orderkey"), F.lit(1 << 40)))
    return order.sampler(order.ordinal(d, "h", ["o_orderkey"], 1 << 33), "ord", 7).select("o_orderkey", "replica", "step")


@C.add(f"SELECT o_orderkey, CAST(least(floor(ord / 1000.0), greatest(floor(n / 1000.0) - 1, 0)) AS BIGINT) AS batch, CAST(floor(ord / 1000.0) AS BIGINT) AS slice FROM ({_DENSE})")
def batch_slices(s, sf):
    return _dense(s, sf).select("o_orderkey", order.batch_of(F.col("ord"), F.col("n"), 1000).alias("batch"), F.floor(F.col("ord") / 1000).cast("bigint").alias("slice"))


@C.add(f"SELECT o_orderkey, CASE WHEN ord >= n - CAST(floor(n * 0.01) AS BIGINT) THEN 'eval' ELSE 'train' END AS split, ord >= CAST(floor(n * 0.95) AS BIGINT) AS ppo_part FROM ({_DENSE})")
def train_eval_split(s, sf):
    o, n = F.col("ord"), F.col("n")
    return _dense(s, sf).select("o_orderkey", F.when(o >= n - F.floor(n * 0.01), "eval").otherwise("train").alias("split"), (o >= F.floor(n * 0.95)).alias("ppo_part"))


@C.add("SELECT 'customer' AS source, c_custkey AS k, c_name AS name, c_acctbal AS acctbal FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier")
def concat_sources(s, sf):
    c = table(s, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"))
    u = table(s, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return concat([c, u])


@C.add("""SELECT 'both' AS kind, data_id FROM (SELECT data_id FROM rollout_batch INTERSECT SELECT data_id FROM repo_train) UNION ALL SELECT 'rollouts only', data_id FROM (SELECT data_id FROM rollout_batch EXCEPT SELECT data_id FROM repo_train)""")
def set_operations(s, sf):
    a, b = table(s, sf, "rollout_batch").select("data_id"), table(s, sf, "repo_train").select("data_id")
    return a.intersect(b).select(F.lit("both").alias("kind"), "data_id").unionByName(a.subtract(b).select(F.lit("rollouts only").alias("kind"), "data_id"))


@C.add()
def blend_weighted(s, sf):
    """All sources interleaved by weight until the first is exhausted; blend_counts holds what must be true of it."""
    d = table(s, sf, "documents").where("source is not null").select("doc_id", "source")
    placed = order.interleaved(d, "source", F.length("source") % 4 + 1, "doc_id")
    stop = placed.groupBy("source").agg(F.max("place").alias("m")).agg(F.min("m").alias("stop"))  # one row
    return placed.crossJoin(F.broadcast(stop)).where("place <= stop").select("doc_id", "source", F.round("place", 6).alias("place"))


@C.add(f"SELECT prompt, output FROM (SELECT prompt, output, row_number() OVER (PARTITION BY prompt ORDER BY ord DESC) AS rn FROM ({_SCORED})) WHERE rn <= 16")
def fifo_buffer(s, sf):
    d = scored(s, sf).withColumn("rn", F.row_number().over(Window.partitionBy("prompt").orderBy(F.col("ord").desc())))
    return d.where("rn <= 16").select("prompt", "output")


@C.add()
def mask_pairs_seeded(s, sf):
    """Two random pairs of prefix variants for each response, by a seeded hash."""
    from ..functions import arrays as A

    d = table(s, sf, "repo_train").where("chosen_logprob_with_token is not null").select("pair_id", A.prefix_variants("chosen_logprob_with_token.tokens").alias("v"))
    p = d.select("pair_id", F.explode("v").alias("a"), "v").select("pair_id", "a", F.explode("v").alias("b")).where("a.mask < b.mask")
    rn = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.xxhash64(F.lit(42), "pair_id", "a.mask", "b.mask")))
    return p.withColumn("rn", rn).where("rn <= 2").select("pair_id", F.col("a.mask").alias("chosen_mask"), F.col("b.mask").alias("rejected_mask"))


@C.add()
def tie_choice(s, sf):
    """A seeded choice among the best models of each prompt."""
    g = scored(s, sf).groupBy("prompt", "model").agg(F.max("reward").alias("r")).groupBy("prompt").agg(F.collect_list(F.struct("r", "model")).alias("xs"), F.max("r").alias("hi"))
    best = F.array_sort(F.transform(F.filter("xs", lambda x: x["r"] == F.col("hi")), lambda x: x["model"]))
    return g.select("prompt", P.seeded_pick(best, 42, "prompt").alias("model"))
