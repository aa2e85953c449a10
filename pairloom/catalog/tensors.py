"""Token layouts and token-level losses beyond the common ones: padding, packing, masks, top-k rows, divergences."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from ..functions import arrays as A
from ..plans.registry import Catalog
from ..sources.tables import table

C = Catalog()
_J = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
_PAIR = """FROM repo_train WHERE len(chosen_logprob_with_token.logprobs) > 0 AND len(rejected_logprob_with_token.logprobs) > 0"""


def _logprobs(s, sf):
    c, r = F.col("chosen_logprob_with_token.logprobs"), F.col("rejected_logprob_with_token.logprobs")
    return table(s, sf, "repo_train").select("pair_id", c.alias("p"), r.alias("q")).where("size(p) > 0 and size(q) > 0")


def _ids(s, sf):
    """A row of each item's first values as whole numbers, of 1 to 7 ids."""
    n = (F.col("vec_id") % 7 + 1).cast("int")
    return table(s, sf, "embeddings").select("vec_id", "label", n.alias("n"), F.transform(F.slice("embedding", F.lit(1), n), lambda v: F.round(v * 100).cast("int")).alias("ids"))


_IDS = "SELECT vec_id, label, CAST(vec_id % 7 + 1 AS INT) AS n, list_transform(embedding[1:vec_id % 7 + 1], lambda v: CAST(round(CAST(v * CAST(100 AS FLOAT) AS FLOAT)) AS INT)) AS ids FROM embeddings"


@C.add(f"""WITH x AS ({_IDS}), g AS (SELECT vec_id // 5 AS batch, max(n) AS w FROM x GROUP BY 1)
SELECT vec_id, array_to_string(list_concat(ids, list_transform(range(w - n), lambda i: 0)), ',') AS rights, array_to_string(list_concat(list_transform(range(w - n), lambda i: 0), ids), ',') AS lefts,
 w * 3 AS cells FROM x JOIN g ON vec_id // 5 = batch""")
def pad_batch(s, sf):
    """Rows padded to the longest of their batch, and rows of rows padded along their first dimension."""
    d = _ids(s, sf).withColumn("w", F.max("n").over(Window.partitionBy(F.floor(F.col("vec_id") / 5))))
    deep = A.pad(F.transform("ids", lambda v: F.array(v, v, v)), F.col("w"), F.array(*[F.lit(0)] * 3))
    return d.select("vec_id", _J(A.pad("ids", F.col("w"), 0)).alias("rights"), _J(A.pad("ids", F.col("w"), 0, left=True)).alias("lefts"), F.size(F.flatten(deep)).cast("bigint").alias("cells"))


@C.add(f"""WITH x AS ({_IDS}), g AS (SELECT vec_id // 4 AS pack, flatten(list(ids ORDER BY vec_id)) AS ids, flatten(list(list_transform(ids, lambda v: vec_id % 4 + 1) ORDER BY vec_id)) AS seg, list(n ORDER BY vec_id) AS lens FROM x GROUP BY 1)
SELECT pack, array_to_string(list_concat(ids, list_transform(range((8 - len(ids) % 8) % 8), lambda i: 0)), ',') AS ids, array_to_string(list_concat(seg, list_transform(range((8 - len(seg) % 8) % 8), lambda i: 0)), ',') AS segments,
 array_to_string(lens, ',') AS lens FROM g""")
def pack_sequences(s, sf):
    """Rows put one after the other, the number of each at its positions, filled up to a multiple of eight."""
    d = _ids(s, sf).groupBy(F.floor(F.col("vec_id") / 4).alias("pack")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "ids", "n"))).alias("xs"))
    ids, seg = F.flatten(d.xs.ids), F.flatten(F.transform("xs", lambda x: F.transform(x["ids"], lambda v: (x["vec_id"] % 4 + 1).cast("int"))))
    full = lambda x: _J(A.pad(x, F.ceil(F.size(x) / 8) * 8, 0))
    return d.select("pack", full(ids).alias("ids"), full(seg).alias("segments"), _J(d.xs.n).alias("lens"))


@C.add(f"SELECT vec_id, array_to_string(ids, ',') AS ids FROM ({_IDS})")
def unpack_sequences(s, sf):
    """Packs taken apart by their lengths are the rows they were made of."""
    d = _ids(s, sf).groupBy(F.floor(F.col("vec_id") / 4).alias("pack")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "ids", "n"))).alias("xs"))
    d = d.select(F.flatten(d.xs.ids).alias("packed"), d.xs.n.alias("lens"), d.xs.vec_id.alias("keys"))
    return d.select(F.explode(F.arrays_zip(F.col("keys"), A.unpack(F.col("packed"), F.col("lens")).alias("ids"))).alias("x")).select("x.keys", _J(F.col("x.ids")).alias("ids")).withColumnRenamed("keys", "vec_id")


@C.add(f"""WITH x AS (SELECT vec_id, ids, n, list_concat(list_transform(range(vec_id % 3), lambda i: 0), ids, list_transform(range(vec_id % 2), lambda i: 0)) AS padded, vec_id % 3 AS l FROM ({_IDS}))
SELECT vec_id, array_to_string(ids, ',') AS flush, array_to_string(ids, ',') AS bare, CAST(len(padded) AS INT) AS width, CAST(l + n - 1 AS INT) AS last FROM x""")
def flush_left(s, sf):
    """Padding at the left and right taken off by its mask; the mask's last position."""
    zeros = lambda k: F.array_repeat(F.lit(0), k.cast("int"))
    l, r = F.col("vec_id") % 3, F.col("vec_id") % 2
    on = lambda k, v: F.array_repeat(F.lit(v), k.cast("int"))
    d = _ids(s, sf).select("vec_id", "n", F.concat(zeros(l), "ids", zeros(r)).alias("padded"), F.concat(on(l, False), on(F.col("n"), True), on(r, False)).alias("mask"))
    start = F.array_position("mask", True).cast("int")
    return d.select(
        "vec_id", _J(A.masked("padded", "mask")).alias("flush"), _J(F.slice("padded", start, F.size(F.filter("mask", lambda m: m)))).alias("bare"),
        F.size("padded").alias("width"), A.last_valid("mask").cast("int").alias("last"),
    )


@C.add(f"""WITH x AS ({_IDS}) SELECT vec_id, array_to_string(CASE WHEN len(ids) > 5 THEN list_concat(ids[1:4], [7]) ELSE ids END, ',') AS forced,
 array_to_string(list_transform(CASE WHEN len(ids) > 5 THEN list_concat(ids[1:4], [7]) ELSE ids END, lambda v, i: CASE WHEN i > 2 THEN 1 ELSE 0 END), ',') AS action_mask FROM x""")
def sequence_masks(s, sf):
    """Sequences cut to five ids, the last then an end mark; actions are what follows two prompt ids."""
    d = _ids(s, sf).select("vec_id", A.truncate_eos("ids", 5, F.lit(7)).alias("forced"))
    return d.select("vec_id", _J(F.col("forced")).alias("forced"), _J(F.transform("forced", lambda v, i: (i >= 2).cast("int"))).alias("action_mask"))


@C.add(f"""WITH x AS ({_IDS}), p AS (SELECT vec_id, n, list_concat(ids, list_transform(range((4 - n % 4) % 4), lambda i: 0)) AS full_ FROM x)
SELECT vec_id, CAST(r AS INT) AS rank, array_to_string(full_[r * (len(full_) // 4) + 1:(r + 1) * (len(full_) // 4)], ',') AS part, CAST(len(full_) - n AS INT) AS padded FROM p, range(4) t(r)""")
def ring_slices(s, sf):
    """Sequences padded to a multiple of four ranks, and each rank's slice; without the padding it is the sequence."""
    d = _ids(s, sf).select("vec_id", "n", A.pad("ids", F.ceil(F.col("n") / 4) * 4, 0).alias("x")).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(3))))
    each = (F.size("x") / 4).cast("int")
    return d.select("vec_id", "rank", _J(F.slice("x", F.col("rank") * each + 1, each)).alias("part"), (F.size("x") - F.col("n")).alias("padded"))


@C.add("""WITH x AS (SELECT pair_id, len(string_split(prompt, ' ')) AS np, chosen_logprob_with_token.logprobs AS p FROM repo_train WHERE len(chosen_logprob_with_token.logprobs) > 0 AND prompt IS NOT NULL)
SELECT pair_id, CAST(np + len(p) AS INT) AS n, round(np * 100 + list_sum(p), 5) AS total, CAST(len(p) AS INT) AS on_, round(list_sum(p) / len(p), 6) AS mean FROM x""")
def label_tensor(s, sf):
    """A dummy at each prompt position and the logprobs behind it, with the mask that tells them apart."""
    d = table(s, sf, "repo_train").where("prompt is not null").select("pair_id", F.size(F.split("prompt", " ")).alias("np"), F.col("chosen_logprob_with_token.logprobs").alias("p")).where("size(p) > 0")
    d = d.select("pair_id", F.concat(F.array_repeat(F.lit(100.0), F.col("np")), "p").alias("x"), F.concat(F.array_repeat(F.lit(False), F.col("np")), F.transform("p", lambda v: F.lit(True))).alias("m"))
    return d.select("pair_id", F.size("x").alias("n"), F.round(A.total("x"), 5).alias("total"), F.size(F.filter("m", lambda v: v)).alias("on_"), F.round(A.masked_mean("x", "m"), 6).alias("mean"))


@C.add("""WITH x AS (SELECT pair_id, chosen_top_k_data.top_k_logprobs AS k, len(string_split(prompt, ' ')) AS np FROM repo_train WHERE len(chosen_top_k_data.top_k_logprobs) > 0 AND prompt IS NOT NULL)
SELECT pair_id, CAST(np + len(k) AS INT) AS rows_, CAST(list_max(list_transform(k, lambda v: len(v))) AS INT) AS width, CAST(len(k) AS INT) AS on_, round(list_sum(list_transform(k, lambda v: list_sum(v))), 5) AS total FROM x""")
def topk_labels(s, sf):
    """Rows of top-k logprobs behind rows of zeros for the prompt, all of one width, and a mask of the rows."""
    k = F.col("chosen_top_k_data.top_k_logprobs")
    d = table(s, sf, "repo_train").where("prompt is not null").select("pair_id", k.alias("k"), F.size(F.split("prompt", " ")).alias("np")).where("size(k) > 0")
    d = d.withColumn("w", F.array_max(F.transform("k", lambda v: F.size(v))))
    rows = F.concat(F.array_repeat(F.array_repeat(F.lit(0.0), F.col("w")), F.col("np")), F.transform("k", lambda v: A.pad(v, F.col("w"), 0.0)))
    mask = F.concat(F.array_repeat(F.lit(False), F.col("np")), F.transform("k", lambda v: F.lit(True)))
    d = d.select("pair_id", "w", rows.alias("r"), mask.alias("m"))
    total = F.aggregate("r", F.lit(0.0), lambda acc, row: acc + A.total(row))
    return d.select("pair_id", F.size("r").alias("rows_"), F.col("w").alias("width"), F.size(F.filter("m", lambda v: v)).alias("on_"), F.round(total, 5).alias("total"))


@C.add("""WITH v AS (SELECT DISTINCT event_type AS t FROM events UNION SELECT upper(event_type) FROM events), o AS (SELECT t, lower(t) AS s, row_number() OVER (ORDER BY t) - 1 AS old_id FROM v),
n AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS new_id, count(*) - 1 AS others FROM o GROUP BY s) SELECT CAST(old_id AS BIGINT) AS old_id, CAST(new_id AS BIGINT) AS new_id, CAST(others AS BIGINT) AS others FROM o JOIN n USING (s)""")
def vocabulary_map(s, sf):
    """Ids of one vocabulary in another that spells its tokens alike, and how many ids fall together with each."""
    e = table(s, sf, "events")
    t = e.select(F.explode(F.array("event_type", F.upper("event_type"))).alias("t")).distinct()
    # vocabularies: a row a token, some 100,000 at most
    ranked = lambda c: (F.row_number().over(Window.orderBy(c)) - 1).cast("bigint")
    old = t.select(F.lower("t").alias("s"), ranked("t").alias("old_id"))
    new = old.groupBy("s").agg((F.count("*") - 1).alias("others")).select("s", "others", ranked("s").alias("new_id"))
    return old.join(new, "s").select("old_id", "new_id", "others")


@C.add("""WITH x AS (SELECT pair_id, chosen_logprob_with_token.tokens AS t, chosen_logprob_with_token.logprobs AS p FROM repo_train WHERE len(chosen_logprob_with_token.tokens) > 0)
SELECT pair_id, CASE WHEN len(t) = len(p) THEN 'as logged' ELSE 'split anew' END AS way, CAST(CASE WHEN len(t) = len(p) THEN len(t) ELSE len(string_split(array_to_string(t, ''), ' ')) END AS INT) AS n FROM x""")
def token_fallback(s, sf):
    """Where tokens and logprobs differ in number the text is split anew, by the pluggable tokenizer."""
    from ..plans.models import split_by_blanks

    t, p = F.col("chosen_logprob_with_token.tokens"), F.col("chosen_logprob_with_token.logprobs")
    d = table(s, sf, "repo_train").select("pair_id", t.alias("t"), p.alias("p")).where("size(t) > 0")
    same = F.size("t") == F.size("p")
    anew = split_by_blanks(F.array_join("t", ""))
    return d.select("pair_id", F.when(same, "as logged").otherwise("split anew").alias("way"), F.when(same, F.size("t")).otherwise(F.size(anew)).alias("n"))


@C.add(f"""WITH x AS (SELECT pair_id, chosen_logprob_with_token.logprobs AS p, rejected_logprob_with_token.logprobs AS q {_PAIR}), m AS (SELECT pair_id, list_avg(p) AS c, list_avg(q) AS r, list_avg(p[1:2]) AS kc, list_avg(q[1:2]) AS kr FROM x)
SELECT pair_id, round(ln(1 + exp(-(0.1 * (c - r) - 0.1 * (kr - kc)))), 6) AS tdpo1, round(ln(1 + exp(-(0.1 * (c - r) - 0.5 * 0.1 * (kr - kc)))), 6) AS tdpo2,
 round(ln(1 + exp(-(0.5 * (c - kc) - 1.2 * 0.5 * (r - kr)))), 6) AS regret_with_reference FROM m""")
def divergence_losses(s, sf):
    """Losses with a divergence of each side, and the regret loss with reference terms; the divergence here is a prefix mean."""
    head = lambda x: A.mean(F.slice(x, F.lit(1), F.lit(2)))
    d = _logprobs(s, sf).select("pair_id", A.mean("p").alias("c"), A.mean("q").alias("r"), head("p").alias("kc"), head("q").alias("kr"))
    gap, kl, beta = F.col("c") - F.col("r"), F.col("kr") - F.col("kc"), 0.1
    loss = lambda x: F.round(-A.log_sigmoid(x), 6)
    ref = 0.5 * (F.col("c") - F.col("kc")) - 1.2 * 0.5 * (F.col("r") - F.col("kr"))
    return d.select("pair_id", loss(beta * gap - beta * kl).alias("tdpo1"), loss(beta * gap - 0.5 * beta * kl).alias("tdpo2"), loss(ref).alias("regret_with_reference"))


_VOCAB = "SELECT a.vec_id, a.label, CAST(unnest(a.embedding) AS DOUBLE) AS p, CAST(unnest(b.embedding) AS DOUBLE) AS q, generate_subscripts(a.embedding, 1) - 1 AS t FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _vocab(s, sf):
    e = table(s, sf, "embeddings")
    x = F.col("embedding").cast("array<double>")
    return e.select("vec_id", "label", x.alias("p")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), x.alias("q")), "vec_id")


@C.add(f"""WITH x AS ({_VOCAB}), z AS (SELECT *, p - ln(sum(exp(p)) OVER w) AS lp, q - ln(sum(exp(q)) OVER w) AS lq FROM x WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, round(max(lp - lq) FILTER (WHERE t = label), 6) AS margin, round(sum(exp(lq) * (lq - lp)), 6) AS kl FROM z GROUP BY vec_id""")
def vocabulary_kl(s, sf):
    """Over a whole vocabulary: the log-ratio of policy to reference at a label, and the divergence of policy from reference."""
    d = _vocab(s, sf).withColumns({"lp": A.log_softmax("p"), "lq": A.log_softmax("q")})
    kl = A.total(F.zip_with("lq", "lp", lambda q_item, p_item: F.exp(q_item) * (q_item - p_item)))
    return d.select("vec_id", F.round(F.get("lp", F.col("label")) - F.get("lq", F.col("label")), 6).alias("margin"), F.round(kl, 6).alias("kl"))


@C.add(f"""WITH x AS ({_VOCAB}), z AS (SELECT *, p - ln(sum(exp(p)) OVER w) AS lp, q - ln(sum(exp(q)) OVER w) AS lq FROM x WINDOW w AS (PARTITION BY vec_id)),
k AS (SELECT vec_id, label, -sum(exp(lq) * lp) AS kd, -max(lp) FILTER (WHERE t = label % 2) + ln(sum(exp(lp)) FILTER (WHERE t < 2)) AS prm, arg_max(t, lp) FILTER (WHERE t < 2) = label % 2 AS hit FROM z GROUP BY vec_id, label)
SELECT label, round(avg(kd) FILTER (WHERE label <> 0), 6) AS kd, round(avg(prm), 6) AS prm, round(avg(CAST(hit AS INT)), 6) AS accuracy FROM k GROUP BY label""")
def teacher_losses(s, sf):
    """Distillation: the cross entropy of a teacher's distribution, label 0 ignored. Process reward: two classes and the share right."""
    d = _vocab(s, sf).withColumns({"lp": A.log_softmax("p"), "lq": A.log_softmax("q")})
    kd = -A.total(F.zip_with("lq", "lp", lambda q_item, p_item: F.exp(q_item) * p_item))
    two, want = F.slice("p", F.lit(1), F.lit(2)), (F.col("label") % 2).cast("int")
    hit = F.when(F.get(two, F.lit(0)) >= F.get(two, F.lit(1)), F.lit(0)).otherwise(F.lit(1)) == want
    g = d.select("label", F.when(F.col("label") != 0, kd).alias("kd"), (-A.log_softmax_at(two, want)).alias("prm"), hit.cast("int").alias("hit")).groupBy("label")
    return g.agg(F.round(F.avg("kd"), 6).alias("kd"), F.round(F.avg("prm"), 6).alias("prm"), F.round(F.avg("hit"), 6).alias("accuracy"))


@C.add(f"""WITH x AS (SELECT pair_id // 16 AS batch, pair_id, list_avg(chosen_logprob_with_token.logprobs) - list_avg(rejected_logprob_with_token.logprobs) AS ratio {_PAIR}), k AS (SELECT batch, greatest(avg(ratio), 0) AS kl FROM x GROUP BY batch)
SELECT pair_id, round(kl, 6) AS kl, round(1 - 1 / (1 + exp(-0.1 * (ratio - kl))), 6) AS chosen_loss, round(1 - 1 / (1 + exp(-0.1 * (kl - ratio))), 6) AS rejected_loss FROM x JOIN k USING (batch)""")
def kto_losses(s, sf):
    """The batch's mean log-ratio, held at 0, and the losses of wanted and unwanted rows against it."""
    d = _logprobs(s, sf).select(F.floor(F.col("pair_id") / 16).alias("batch"), "pair_id", (A.mean("p") - A.mean("q")).alias("ratio"))
    d = d.withColumn("kl", F.greatest(F.avg("ratio").over(Window.partitionBy("batch")), F.lit(0.0)))
    loss = lambda x: F.round(1 - 1 / (1 + F.exp(-0.1 * x)), 6)
    return d.select("pair_id", F.round("kl", 6).alias("kl"), loss(F.col("ratio") - F.col("kl")).alias("chosen_loss"), loss(F.col("kl") - F.col("ratio")).alias("rejected_loss"))


@C.add(f"""WITH x AS (SELECT pair_id, unnest(p[1:least(len(p), len(q))]) AS a, unnest(q[1:least(len(p), len(q))]) AS b, generate_subscripts(p[1:least(len(p), len(q))], 1) AS t
 FROM (SELECT pair_id, chosen_logprob_with_token.logprobs AS p, rejected_logprob_with_token.logprobs AS q {_PAIR})), g AS (SELECT pair_id, t, a, avg(b - a) OVER (PARTITION BY pair_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS gap FROM x)
SELECT pair_id, round(avg(a - gap), 6) AS weighed, round(avg(a), 6) AS plain, CASE WHEN pair_id % 10 < 7 THEN round(avg(a - gap), 6) END AS kept FROM g GROUP BY pair_id""")
def regret_unbalanced(s, sf):
    """Regret where both sides needn't be in the loss: the score, its reference form, and the score within a ratio gate."""
    n = F.least(F.size("p"), F.size("q"))
    d = _logprobs(s, sf).select("pair_id", F.slice("p", F.lit(1), n).alias("p"), F.slice("q", F.lit(1), n).alias("q"))
    gap = F.zip_with("q", "p", lambda q_item, p_item: q_item - p_item)
    score = F.round(A.regret("p", gap), 6)
    return d.select("pair_id", score.alias("weighed"), F.round(A.mean("p"), 6).alias("plain"), F.when(F.col("pair_id") % 10 < 7, score).alias("kept"))


@C.add("""WITH x AS (SELECT pair_id, unnest(string_split(chosen, chr(10))) AS piece, generate_subscripts(string_split(chosen, chr(10)), 1) AS k, len(string_split(chosen, chr(10))) AS n FROM repo_train WHERE chosen IS NOT NULL AND length(chosen) > 0),
e AS (SELECT pair_id, k, n, sum(length(piece) + CASE WHEN k < n THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY k) AS stop FROM x)
SELECT pair_id, CAST(stop - 1 AS INT) AS position, 1.0 / k AS reward FROM (SELECT pair_id, stop, min(k) AS k FROM e GROUP BY ALL) WHERE stop > 0""")
def step_rewards(s, sf):
    """A reward of each step at the last position of the step, nothing elsewhere; positions are characters here."""
    parts = F.split("chosen", "\n")
    d = table(s, sf, "repo_train").where("length(chosen) > 0").select("pair_id", F.size(parts).alias("n"), F.posexplode(parts).alias("k", "piece"))
    w = Window.partitionBy("pair_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.length("piece") + F.when(F.col("k") < F.col("n") - 1, 1).otherwise(0)).over(w)
    return d.select("pair_id", "k", (stop - 1).cast("int").alias("position")).where("position >= 0").groupBy("pair_id", "position").agg((F.lit(1.0) / (F.min("k") + 1)).alias("reward"))


@C.add("""WITH x AS (SELECT user_id, event_id, value AS r, row_number() OVER w - 1 AS t, coalesce(lead(value) OVER w, 0) * 0.5 AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT user_id, t, r, r + 0.99 * nxt - r * 0.5 AS delta FROM x)
SELECT a.user_id, CAST(a.t AS INT) AS t, round(sum(b.delta * pow(0.99 * 0.95, b.t - a.t)) + 1e-7, 3) AS advantage, round(sum(b.delta * pow(0.99 * 0.95, b.t - a.t)) + max(a.r) * 0.5 + 1e-7, 3) AS returns, round(sum(b.r * pow(0.9, b.t - a.t)) + 1e-7, 3) AS discounted
FROM d a JOIN d b ON a.user_id = b.user_id AND b.t >= a.t GROUP BY a.user_id, a.t""", name="gae_positions")
def _gae_positions(s, sf):
    """Advantages, returns and discounted sums at every position."""
    e = table(s, sf, "events").select("user_id", "event_id", "value")
    xs = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("xs")).select("user_id", F.col("xs.value").alias("r"))
    half = F.transform("r", lambda item: item * 0.5)
    d = xs.select("user_id", "r", A.gae("r", half, F.lit(0.99), F.lit(0.95)).alias("a"), A.discounted_returns("r", F.lit(0.9)).alias("g"))
    d = d.select("user_id", F.posexplode(F.arrays_zip("a", "g", "r")).alias("t", "x"))
    return d.select("user_id", "t", F.round(F.col("x.a") + 1e-7, 3).alias("advantage"), F.round(F.col("x.a") + F.col("x.r") * 0.5 + 1e-7, 3).alias("returns"), F.round(F.col("x.g") + 1e-7, 3).alias("discounted"))


@C.add("""WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), z AS (SELECT vec_id, i, v - ln(sum(exp(v)) OVER (PARTITION BY vec_id)) AS lp, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS rn FROM x)
SELECT vec_id, CAST(rn AS INT) AS rank, CAST(i AS INT) AS token, round(lp, 5) AS logprob FROM z WHERE rn <= 5""")
def vocabulary_topk(s, sf):
    """The five likeliest entries of each row's log-softmax."""
    d = table(s, sf, "embeddings").select("vec_id", A.log_softmax(F.col("embedding").cast("array<double>")).alias("lp"))
    best = F.slice(F.array_sort(F.transform("lp", lambda v, i: F.struct((-v).alias("m"), i.alias("i")))), F.lit(1), F.lit(5))
    return d.select("vec_id", F.posexplode(best).alias("k", "x")).select("vec_id", (F.col("k") + 1).alias("rank"), F.col("x.i").alias("token"), F.round(-F.col("x.m"), 5).alias("logprob"))


@C.add("""SELECT problem_index, CAST(k AS INT) AS turn, CAST(2 * k * 3 + 3 AS INT) AS start, CAST(2 * k * 3 + 3 + 2 + k AS INT) AS stop FROM (SELECT problem_index FROM math_problem), range(3) t(k) WHERE k < problem_index % 3 + 1""")
def turn_ranges(s, sf):
    """The spans of the answers in a chat of several turns: a question of 3 ids, then an answer of 2 + k of 3 + k ids each."""
    d = table(s, sf, "math_problem").select("problem_index", (F.col("problem_index") % 3 + 1).cast("int").alias("turns"))
    lens = F.flatten(F.transform(F.sequence(F.lit(0), F.col("turns") - 1), lambda k: F.array(F.lit(3), F.lit(3))))
    ends = A.running_sum(lens)
    d = d.select("problem_index", F.posexplode(F.filter(F.transform(ends, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda x: x["i"] % 2 == 0)).alias("turn", "x"))
    return d.select("problem_index", "turn", F.col("x.v").cast("int").alias("start"), (F.col("x.v") + 2 + F.col("turn")).cast("int").alias("stop"))
