"""Metrics and reports."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import metrics as M
from ..plans.registry import Catalog
from ..sources.tables import table

C = Catalog()
_ROLL = "SELECT data_id, batch_no, model, unnest(responses) AS r FROM rollout_batch"


@C.add(f"""WITH p AS (SELECT model, data_id, max(CAST(r.is_correct AS INT)) AS best, avg(CAST(r.is_correct AS INT)) AS mean FROM ({_ROLL}) WHERE r.is_correct IS NOT NULL GROUP BY ALL)
SELECT coalesce(model, 'default') AS source, round(avg(best), 6) AS pass_at_k, round(avg(mean), 6) AS pass_at_1, CAST(count(*) AS BIGINT) AS prompts FROM p GROUP BY 1""")
def pass_at_k(s, sf):
    r = table(s, sf, "rollout_batch").select(F.coalesce("model", F.lit("default")).alias("source"), "data_id", F.explode("responses.is_correct").alias("ok"))
    return M.pass_at_k(r, "source", "data_id", "ok")


@C.add("""SELECT b.benchmark, CAST(count(*) AS BIGINT) AS total, CAST(count(e.extracted_last_answers) AS BIGINT) AS valid, CAST(sum(CAST(e.is_correct AS INT)) AS BIGINT) AS correct, round(sum(CAST(e.is_correct AS INT)) / count(*), 6) AS accuracy,
CAST(floor(round(sum(CAST(e.is_correct AS INT)) / count(*), 6) * count(*)) AS BIGINT) AS correct_by_share FROM eval_log e JOIN benchmark_item b ON e.data_id = b.item_id GROUP BY b.benchmark""")
def benchmark_rollup(s, sf):
    e, b = table(s, sf, "eval_log"), table(s, sf, "benchmark_item").select(F.col("item_id").alias("data_id"), "benchmark")
    g = e.join(b, "data_id").groupBy("benchmark").agg(F.count("*").alias("total"), F.count("extracted_last_answers").alias("valid"), F.sum(F.col("is_correct").cast("int")).alias("correct"))
    acc = F.round(F.col("correct") / F.col("total"), 6)
    return g.select("benchmark", "total", "valid", "correct", acc.alias("accuracy"), F.floor(acc * F.col("total")).alias("correct_by_share"))


@C.add("""SELECT * FROM (PIVOT (SELECT e.model, b.benchmark, CAST(e.is_correct AS INT) AS ok FROM eval_log e JOIN benchmark_item b ON e.data_id = b.item_id) ON benchmark USING round(avg(ok), 6) GROUP BY model)""")
def results_pivot(s, sf):
    e, b = table(s, sf, "eval_log"), table(s, sf, "benchmark_item").select(F.col("item_id").alias("data_id"), "benchmark")
    # every benchmark of the table, a small one that doesn't grow, is a column
    names = sorted(r[0] for r in b.select("benchmark").where("benchmark is not null").distinct().collect())
    return e.join(b, "data_id").groupBy("model").pivot("benchmark", names).agg(F.round(F.avg(F.col("is_correct").cast("int")), 6))


@C.add("""WITH v AS (SELECT data_id, extracted_last_answers AS a, count(*) AS n, min(log_id) AS first_id FROM eval_log WHERE extracted_last_answers IS NOT NULL GROUP BY ALL)
SELECT data_id, a AS answer, CAST(n AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY data_id ORDER BY n DESC, first_id) AS rn FROM v) WHERE rn = 1""")
def majority_vote(s, sf):
    return M.majority(table(s, sf, "eval_log"), "data_id", "extracted_last_answers", "log_id")


_PAIR = "SELECT a.user_id AS prompt, max(a.value) AS c, min(a.value) AS r, min(a.event_id) AS id FROM events a GROUP BY a.user_id"


@C.add(f"""WITH p AS ({_PAIR}), b AS (SELECT *, prompt // 8 AS batch FROM p)
SELECT round(avg(CAST(c > r AS INT)), 6) AS by_row, round((SELECT avg(a) FROM (SELECT avg(CAST(c > r AS INT)) AS a FROM b GROUP BY batch)), 6) AS by_batch, round((SELECT avg(x) FROM (SELECT c AS x FROM p UNION ALL SELECT r FROM p)), 6) AS score_mean, round((SELECT greatest(stddev_samp(x), 1e-8) FROM (SELECT c AS x FROM p UNION ALL SELECT r FROM p)), 6) AS score_std FROM b""")
def pair_accuracy(s, sf):
    p = table(s, sf, "events").groupBy(F.col("user_id").alias("prompt")).agg(F.max("value").alias("c"), F.min("value").alias("r"))
    return M.pair_accuracy(p.withColumn("batch", F.floor(F.col("prompt") / 8)), "c", "r", "batch")


@C.add("""WITH v AS (SELECT value - avg(value) OVER (PARTITION BY user_id) AS x FROM events), b AS (SELECT CASE WHEN x = 10 THEN 9 ELSE CAST(floor((x + 10) / 2) AS INT) END AS bin FROM v WHERE x BETWEEN -10 AND 10)
SELECT bin, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER () / 2.0, 6) AS density FROM b GROUP BY bin""")
def reward_histogram(s, sf):
    x = F.col("value") - F.avg("value").over(Window.partitionBy("user_id"))
    return M.histogram(table(s, sf, "events").select(x.alias("x")), "x", -10.0, 10.0, 10)


@C.add("""WITH x AS (SELECT event_id, value, event_type <> 'error' AS m FROM events), a AS (SELECT sum(value) / count(*) FILTER (WHERE m) AS mean FROM x), v AS (SELECT sum((value - mean) * (value - mean)) FILTER (WHERE m) / count(*) FILTER (WHERE m) AS var FROM x, a)
SELECT event_id, round((value - mean) / sqrt(greatest(var, 1e-8)), 5) AS z FROM x, a, v""")
def adv_normalise(s, sf):
    d = table(s, sf, "events").select("event_id", "value", (F.col("event_type") != "error").alias("m"))
    return M.masked_normalise(d, "value", "m", "z").select("event_id", F.round("z", 5).alias("z"))


@C.add("""SELECT event_type, round(sum(value * length(props)) / sum(length(props)), 6) AS by_length, round(avg(value), 6) AS plain FROM events GROUP BY event_type""")
def length_weighted_mean(s, sf):
    n = F.length("props")
    return table(s, sf, "events").groupBy("event_type").agg(F.round(F.sum(F.col("value") * n) / F.sum(n), 6).alias("by_length"), F.round(F.avg("value"), 6).alias("plain"))


@C.add("""WITH d AS (SELECT CAST(floor(event_id / 500) AS BIGINT) AS step, avg(value) AS loss FROM events GROUP BY 1) SELECT step, round(avg(loss) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING), 6) AS running FROM d""")
def running_mean(s, sf):
    d = table(s, sf, "events").groupBy(F.floor(F.col("event_id") / 500).alias("step")).agg(F.avg("value").alias("loss"))
    # steps are mini-batches, one row each
    return d.select("step", F.round(F.avg("loss").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)), 6).alias("running"))


@C.add("""WITH b AS (SELECT CAST(floor(event_id / 500) AS BIGINT) AS batch, avg(value) AS value, avg(length(props)) AS length FROM events GROUP BY 1) SELECT 'value' AS metric, round(avg(value), 6) AS mean FROM b UNION ALL SELECT 'length', round(avg(length), 6) FROM b""")
def metric_means(s, sf):
    b = table(s, sf, "events").groupBy(F.floor(F.col("event_id") / 500).alias("batch")).agg(F.avg("value").alias("value"), F.avg(F.length("props")).alias("length"))
    return b.unpivot("batch", ["value", "length"], "metric", "x").groupBy("metric").agg(F.round(F.avg("x"), 6).alias("mean"))


@C.add("""SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(o_totalprice, 0.05), 4) AS p5, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(greatest(abs(quantile_cont(o_totalprice - 100000, 0.05)), abs(quantile_cont(o_totalprice - 100000, 0.95)), 0.5), 4) AS lim FROM orders GROUP BY o_orderstatus""")
def diff_percentiles(s, sf):
    x = F.col("o_totalprice")
    lim = F.greatest(F.abs(F.percentile(x - 100000, 0.05)), F.abs(F.percentile(x - 100000, 0.95)), F.lit(0.5))
    return table(s, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.percentile(x, 0.05), 4).alias("p5"), F.round(F.percentile(x, 0.95), 4).alias("p95"), F.round(lim, 4).alias("lim"))


@C.add("""WITH p AS (SELECT a.vec_id, unnest(a.embedding) AS x, unnest(b.embedding) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE len(a.embedding) = len(b.embedding))
SELECT CAST(count(*) AS BIGINT) AS tokens, round(avg(pow(CAST(x AS DOUBLE) - y, 2)), 6) AS mse, round(sqrt(avg(pow(CAST(x AS DOUBLE) - y, 2))), 6) AS rmse FROM p""")
def token_mse(s, sf):
    e = table(s, sf, "embeddings")
    a = e.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("y"))
    sq = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v)
    g = a.join(b, "vec_id").where("size(x) = size(y)").agg(F.sum(F.size("x")).alias("tokens"), F.sum(sq).alias("t"))
    return g.select("tokens", F.round(F.col("t") / F.col("tokens"), 6).alias("mse"), F.round(F.sqrt(F.col("t") / F.col("tokens")), 6).alias("rmse"))


@C.add("""WITH c AS (SELECT date_trunc('day', ts) AS day, avg(value) AS cur, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, round(0.1 * exp(sum(ln(1 + least(greatest(cur / 20 - 1, -0.2), 0.2) * n / 10000)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)), 6) AS coef FROM c""")
def adaptive_kl(s, sf):
    d = table(s, sf, "events").groupBy(F.date_trunc("day", F.col("ts")).alias("day")).agg(F.avg("value").alias("cur"), F.count("*").alias("n"))
    return M.adaptive_coefficient(d, "day", "cur", "n", 0.1, 20.0, 10_000).select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("coef", 6).alias("coef"))


@C.add("""SELECT CAST(count(*) AS BIGINT) AS rows_in, CAST(count(*) FILTER (WHERE chosen IS NULL OR rejected IS NULL) AS BIGINT) AS skipped, CAST(count(*) FILTER (WHERE chosen = rejected) AS BIGINT) AS same FROM repo_train""")
def pipeline_counters(s, sf):
    return table(s, sf, "repo_train").agg(F.count("*").alias("rows_in"), F.count_if(F.expr("chosen is null or rejected is null")).alias("skipped"), F.count_if(F.expr("chosen = rejected")).alias("same"))


@C.add("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, grouping(event_type) AS level FROM events GROUP BY ROLLUP (event_type)")
def rollup_totals(s, sf):
    return table(s, sf, "events").rollup("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.grouping("event_type").cast("bigint").alias("level"))
