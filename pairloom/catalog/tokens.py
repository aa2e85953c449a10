"""Token-axis mathematics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import arrays as A
from ..plans.registry import Catalog
from ..sources.tables import table

C = Catalog()
_LP = "SELECT pair_id, chosen_logprob_with_token.logprobs AS p FROM repo_train WHERE chosen_logprob_with_token IS NOT NULL AND len(chosen_logprob_with_token.logprobs) > 0"
_PQ = "SELECT a.vec_id, a.embedding AS p, b.embedding AS q FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
_PQX = f"SELECT vec_id, generate_subscripts(p, 1) AS t, CAST(unnest(p) AS DOUBLE) AS p, CAST(unnest(q) AS DOUBLE) AS q FROM ({_PQ})"


def _logprobs(s, sf):
    return table(s, sf, "repo_train").select("pair_id", F.col("chosen_logprob_with_token.logprobs").alias("p")).where("size(p) > 0")


def _pq(s, sf):
    e = table(s, sf, "embeddings")
    x = F.col("embedding").cast("array<double>")
    return e.select("vec_id", x.alias("p")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), x.alias("q")), "vec_id")


@C.add(f"WITH x AS (SELECT pair_id, unnest(p) AS v FROM ({_LP})) SELECT pair_id, round(avg(v), 6) AS score, round(sum(v), 6) AS total FROM x GROUP BY pair_id")
def logprob_score(s, sf):
    return _logprobs(s, sf).select("pair_id", F.round(A.mean("p"), 6).alias("score"), F.round(A.total("p"), 6).alias("total"))


@C.add(f"WITH x AS (SELECT pair_id, unnest(p) AS v, generate_subscripts(p, 1) AS t FROM ({_LP})) SELECT pair_id, CAST(t - 1 AS INT) AS t, round(sum(v) OVER w + 1e-9, 6) AS suffix_sum, round(avg(v) OVER w + 1e-9, 6) AS suffix_mean FROM x WINDOW w AS (PARTITION BY pair_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
def suffix_mean(s, sf):
    d = _logprobs(s, sf).select("pair_id", F.posexplode("p").alias("t", "v"))
    w = Window.partitionBy("pair_id").orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    return d.select("pair_id", "t", F.round(F.sum("v").over(w) + 1e-9, 6).alias("suffix_sum"), F.round(F.avg("v").over(w) + 1e-9, 6).alias("suffix_mean"))


@C.add(f"WITH x AS ({_PQX}), g AS (SELECT vec_id, p, avg(q - p) OVER (PARTITION BY vec_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS gap FROM x) SELECT vec_id, round(avg(p - gap), 6) AS score FROM g GROUP BY vec_id")
def regret(s, sf):
    gap = F.zip_with("q", "p", lambda q_item, p_item: q_item - p_item)
    return _pq(s, sf).select("vec_id", F.round(A.regret("p", gap), 6).alias("score"))


@C.add(f"WITH x AS (SELECT pair_id, unnest(p) AS p, generate_subscripts(p, 1) AS t FROM ({_LP})), g AS (SELECT pair_id, p, avg(-p) OVER (PARTITION BY pair_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS gap FROM x) SELECT pair_id, round(avg(p - gap), 6) AS score FROM g GROUP BY pair_id")
def regret_det(s, sf):
    return _logprobs(s, sf).select("pair_id", F.round(A.regret("p", F.transform("p", lambda item: -item)), 6).alias("score"))


_REST = "greatest(1 - list_sum(list_transform({0}[t], lambda v: exp(v))), 1e-9)"
_KL = f"""list_sum(list_transform(range(1, len(a[t]) + 1), lambda i: exp(a[t][i]) * (ln(exp(a[t][i]) + 1e-9) - ln(exp(b[t][i]) + 1e-9))))
 + {_REST.format('a')} * (ln({_REST.format('a')} / (32000 - len(a[t]))) - ln({_REST.format('b')} / (32000 - len(a[t]))))"""


@C.add(f"""WITH x AS (SELECT pair_id, chosen_logprob_with_token.logprobs AS p, chosen_top_k_data.top_k_logprobs AS a, rejected_top_k_data.top_k_logprobs AS b FROM repo_train),
n AS (SELECT *, least(len(p), len(a), len(b)) AS n FROM x WHERE len(p) > 0 AND len(a) > 0 AND len(b) > 0), u AS (SELECT pair_id, p, a, b, unnest(range(1, n + 1)) AS t FROM n),
g AS (SELECT pair_id, p[t] AS p, avg({_KL}) OVER (PARTITION BY pair_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS gap FROM u)
SELECT pair_id, round(avg(p - gap), 6) AS score FROM g GROUP BY pair_id""")
def regret_topk(s, sf):
    """The gap at each position is the divergence of the rejected from the chosen top-k distribution."""
    t = table(s, sf, "repo_train").select("pair_id", F.col("chosen_logprob_with_token.logprobs").alias("p"), F.col("chosen_top_k_data.top_k_logprobs").alias("a"), F.col("rejected_top_k_data.top_k_logprobs").alias("b"))
    t = t.where("size(p) > 0 and size(a) > 0 and size(b) > 0").withColumn("n", F.least(F.size("p"), F.size("a"), F.size("b")))
    cut = t.select("pair_id", *[F.slice(c, F.lit(1), F.col("n")).alias(c) for c in "pab"])
    probs = lambda xs: F.transform(xs, lambda item: F.exp(item))
    gap = F.zip_with("a", "b", lambda a_row, b_row: A.topk_kl(probs(a_row), probs(b_row), 32_000))
    return cut.select("pair_id", F.round(A.regret("p", gap), 6).alias("score"))


@C.add(f"WITH x AS ({_PQX}) SELECT vec_id, round(avg(p - q), 6) AS k1, round(avg((p - q) * (p - q) / 2), 6) AS k2, round(avg(exp(q - p) - 1 + p - q), 6) AS k3 FROM x GROUP BY vec_id")
def approx_kl(s, sf):
    return _pq(s, sf).select("vec_id", *[F.round(A.mean(A.approx_kl("p", "q", k)), 6).alias(k) for k in ("k1", "k2", "k3")])


@C.add("WITH x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS t FROM embeddings) SELECT vec_id, round(ln(sum(exp(v))), 6) AS lse, round(max(v) FILTER (WHERE t = label + 1) - ln(sum(exp(v))), 6) AS logp, round(max(v) - ln(sum(exp(v))), 6) AS top1 FROM x GROUP BY vec_id")
def logsumexp_gather(s, sf):
    d = table(s, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    lse = A.logsumexp("x")
    return d.select("vec_id", F.round(lse, 6).alias("lse"), F.round(A.log_softmax_at("x", F.col("label")), 6).alias("logp"), F.round(F.get(F.sort_array("x", False), F.lit(0)) - lse, 6).alias("top1"))


_MEANS = """SELECT pair_id, (SELECT avg(v) FROM (SELECT unnest(chosen_logprob_with_token.logprobs) AS v)) AS c, (SELECT avg(v) FROM (SELECT unnest(rejected_logprob_with_token.logprobs) AS v)) AS r FROM repo_train WHERE len(chosen_logprob_with_token.logprobs) > 0 AND len(rejected_logprob_with_token.logprobs) > 0"""


@C.add(f"""WITH m AS ({_MEANS}), z AS (SELECT pair_id, c, r, 0.1 * (c - r) AS x FROM m)
SELECT pair_id, round(ln(1 + exp(-x)), 6) AS dpo, round(0.9 * ln(1 + exp(-x)) + 0.1 * ln(1 + exp(x)), 6) AS smoothed, round(pow(c - r - 5, 2), 6) AS ipo, round(ln(1 + exp(-2.5 * (c - r - 0.3))), 6) AS simpo, round(ln(1 + exp(-(c - r - 0.5))), 6) AS rm_margin, round(1 - 1 / (1 + exp(-x)), 6) AS kto, c > r AS won, round(0.1 * c, 6) AS implicit_reward FROM z""")
def pref_losses(s, sf):
    c, r = F.col("c"), F.col("r")
    t = table(s, sf, "repo_train").select("pair_id", A.mean("chosen_logprob_with_token.logprobs").alias("c"), A.mean("rejected_logprob_with_token.logprobs").alias("r")).where("c is not null and r is not null")
    x = 0.1 * (c - r)
    o = {"dpo": -A.log_sigmoid(x), "smoothed": -0.9 * A.log_sigmoid(x) - 0.1 * A.log_sigmoid(-x), "ipo": F.pow(c - r - 5, F.lit(2.0)), "simpo": -A.log_sigmoid(2.5 * (c - r - 0.3)), "rm_margin": -A.log_sigmoid(c - r - 0.5), "kto": 1 - 1 / (1 + F.exp(-x)), "implicit_reward": 0.1 * c}
    return t.select("pair_id", (c > r).alias("won"), *[F.round(v, 6).alias(k) for k, v in o.items()])


@C.add("""SELECT event_id, round(greatest(-value / 20 * (1 + (event_id % 5 - 2) / 5.0), -value / 20 * least(greatest(1 + (event_id % 5 - 2) / 5.0, 0.8), 1.2)), 6) AS policy_loss, round(0.5 * greatest(pow(value - 10, 2), pow(least(greatest(value, 9.5), 10.5) - 12, 2)), 6) AS value_loss, least(greatest(value, 2), 30) AS clipped FROM events""")
def clipped_losses(s, sf):
    v = F.col("value")
    ratio = 1 + (F.col("event_id") % 5 - 2) / 5.0
    held = F.least(F.greatest(ratio, F.lit(0.8)), F.lit(1.2))
    near = F.least(F.greatest(v, F.lit(9.5)), F.lit(10.5))
    return table(s, sf, "events").select("event_id", F.round(F.greatest(-v / 20 * ratio, -v / 20 * held), 6).alias("policy_loss"), F.round(0.5 * F.greatest(F.pow(v - 10, F.lit(2.0)), F.pow(near - 12, F.lit(2.0))), 6).alias("value_loss"), F.least(F.greatest(v, F.lit(2.0)), F.lit(30.0)).alias("clipped"))


def _series(s, sf):
    return table(s, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("xs")).select("user_id", F.transform("xs", lambda x: x["value"]).alias("r"))


@C.add("""WITH x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t FROM events) SELECT user_id, round(sum(value * pow(0.9, t)), 6) AS first_return, round(sum(value), 4) AS plain FROM x GROUP BY user_id""")
def returns_discounted(s, sf):
    d = _series(s, sf).select("user_id", "r", A.discounted_returns("r", F.lit(0.9)).alias("g"))
    return d.select("user_id", F.round(F.get("g", F.lit(0)), 6).alias("first_return"), F.round(A.total("r"), 4).alias("plain"))


@C.add("""WITH x AS (SELECT user_id, value, row_number() OVER w - 1 AS t, coalesce(lead(value) OVER w, 0) AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, round(sum((value + 0.99 * nxt * 0.5 - value * 0.5) * pow(0.99 * 0.95, t)), 6) AS first_advantage FROM x GROUP BY user_id""")
def gae(s, sf):
    d = _series(s, sf).select("user_id", A.gae("r", F.transform("r", lambda item: item * 0.5), F.lit(0.99), F.lit(0.95)).alias("a"))
    return d.select("user_id", F.round(F.get("a", F.lit(0)), 6).alias("first_advantage"))


@C.add(f"WITH x AS (SELECT pair_id, len(p) AS n, unnest(p) AS v, generate_subscripts(p, 1) AS t FROM ({_LP})) SELECT pair_id, CAST(t - 1 AS INT) AS t, round(-0.05 * v + CASE WHEN t = n THEN 1 ELSE 0 END, 6) AS reward FROM x")
def shaped_token_rewards(s, sf):
    d = _logprobs(s, sf).withColumn("n", F.size("p"))
    d = d.select("pair_id", F.transform("p", lambda item, at: -0.05 * item + F.when(at == F.col("n") - 1, 1.0).otherwise(0.0)).alias("x"))
    return d.select("pair_id", F.posexplode("x").alias("t", "reward")).select("pair_id", "t", F.round("reward", 6).alias("reward"))
