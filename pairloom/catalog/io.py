"""Sources and sinks, resumable and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.lineage import scratch_folder
from ..plans.registry import Catalog
from ..sources import folders, sinks
from ..sources.tables import concat, read_jsonl, read_many, read_path, table
from ..streaming import jobs

C = Catalog()


def _folder(s) -> str:
    return scratch_folder(s, "io")


@C.add("SELECT problem_index, md5(question) AS question, md5(response) AS response, answer FROM math_problem")
def jsonl_roundtrip(s, sf):
    d = table(s, sf, "math_problem")
    path = _folder(s) + "/rows.jsonl"
    sinks.write_jsonl(d, path, "separators")
    back = read_jsonl(s, path, d.schema, "fail")
    return back.select("problem_index", F.md5("question").alias("question"), F.md5("response").alias("response"), "answer")


@C.add("SELECT problem_index, md5(question) AS question FROM math_problem WHERE question IS NOT NULL")
def jsonl_ascii(s, sf):
    d = table(s, sf, "math_problem").where("question is not null").select("problem_index", "question")
    path = _folder(s) + "/rows.jsonl"
    sinks.write_jsonl(d, path, "ascii")
    return read_jsonl(s, path, d.schema).select("problem_index", F.md5("question").alias("question"))


@C.add("SELECT CAST(count(*) AS BIGINT) AS records, CAST(2 AS BIGINT) AS corrupt FROM benchmark_item")
def malformed_lines(s, sf):
    """Lines that are no objects (a bare string, a broken brace) are set apart, not lost among the records."""
    d = table(s, sf, "benchmark_item").select("item_id", "question")
    path = _folder(s) + "/rows.jsonl"
    noise = s.createDataFrame([('"a log line"',), ("{broken",)], "value string")
    d.select(sinks.json_text(d).alias("value")).unionByName(noise).write.text(path)
    got = read_jsonl(s, path, d.schema, "keep")
    return got.agg(F.count("item_id").alias("records"), F.count("_corrupt_record").alias("corrupt"))


_ITEM = "item_id bigint, question string"


def _sets(s, sf) -> str:
    """A folder with a file of JSON lines for each benchmark."""
    folder = _folder(s)
    d = table(s, sf, "benchmark_item").select("item_id", "question", F.concat("benchmark", F.lit(".jsonl")).alias("set"))
    for (name,) in d.select("set").distinct().collect():
        sinks.write_jsonl(d.where(F.col("set") == name).drop("set"), f"{folder}/{name}")
    return folder


@C.add("SELECT benchmark AS dataset, CAST(count(*) AS BIGINT) AS n, CAST(sum(item_id) AS BIGINT) AS ids FROM benchmark_item WHERE benchmark <> 'polyset' GROUP BY 1")
def directory_scan(s, sf):
    """All sets of a folder but an ignored one, named by their files."""
    d = folders.named_sets(s, _sets(s, sf), _ITEM, ignore=("polyset",))
    return d.groupBy("dataset").agg(F.count("*").alias("n"), F.sum("item_id").alias("ids"))


@C.add("""SELECT CAST(dense_rank() OVER (ORDER BY 'batch_' || (item_id % 12)) - 1 AS BIGINT) AS place, 'batch_' || (item_id % 12) || '.jsonl' AS file, item_id FROM benchmark_item""")
def ordered_scan(s, sf):
    """Files of a folder in the order of their names, in which batch_10 comes before batch_2."""
    folder = _folder(s)
    d = table(s, sf, "benchmark_item").select("item_id", "question")
    for k in range(12):
        sinks.write_jsonl(d.where(F.col("item_id") % 12 == k), f"{folder}/batch_{k}.jsonl")
    got = folders.ordered_lines(s, folder, _ITEM)
    # file names, not rows, are ranked
    names = [x for x in folders.listed(s, folder)]
    place = F.array_position(F.array(*map(F.lit, names)), F.col("file")) - 1
    return got.select(place.alias("place"), "file", "item_id")


@C.add("""SELECT model, CAST(count(*) AS BIGINT) AS n, (SELECT CAST(count(DISTINCT model) + 1 AS BIGINT) FROM generation WHERE model IS NOT NULL) AS folders FROM generation WHERE model IS NOT NULL AND response IS NOT NULL GROUP BY model""")
def model_scan(s, sf):
    """A folder a model, of which one has no file and is counted all the same."""
    root = _folder(s)
    d = table(s, sf, "generation").where("response is not null").select("prompt_id", "response", "model")
    for (m,) in d.where("model is not null").select("model").distinct().collect():
        sinks.write_jsonl(d.where(F.col("model") == m).drop("model"), f"{root}/{m}/generation_merged.jsonl")
    sinks.write_jsonl(d.limit(0).drop("model"), f"{root}/empty/other.jsonl")
    got, n = folders.model_folders(s, root, "prompt_id string, response string")
    return got.groupBy("model").agg(F.count("*").alias("n")).withColumn("folders", F.lit(n).cast("bigint"))


@C.add("SELECT item_id, md5(question) AS question FROM benchmark_item")
def part_scan(s, sf):
    """Parts that three writers left, read as one and merged into one file, after which the parts are gone."""
    folder = _folder(s)
    d = table(s, sf, "benchmark_item").select("item_id", "question")
    for k in range(3):
        sinks.write_jsonl(d.where(F.col("item_id") % 3 == k), f"{folder}/out.part{k}.jsonl")
    sinks.merge_parts(s, folder, "out", _ITEM)
    if any(".part" in x for x in folders.listed(s, folder)):
        raise ValueError("parts are left")
    return read_jsonl(s, f"{folder}/out.jsonl", _ITEM).select("item_id", F.md5("question").alias("question"))


@C.add("""SELECT r_regionkey AS k, r_name AS name, 'a' AS kind FROM region UNION ALL SELECT n_nationkey, n_name, 'b' FROM nation UNION ALL SELECT s_suppkey, s_name, 'c' FROM supplier""")
def source_specs(s, sf):
    """A comma list of a folder with a sub-folder, a table and JSON lines, each read by what it is."""
    folder = _folder(s)
    cols = lambda t, k, n, kind: table(s, sf, t).select(F.col(k).cast("bigint").alias("k"), F.col(n).alias("name"), F.lit(kind).alias("kind"))
    cols("region", "r_regionkey", "r_name", "a").write.parquet(f"{folder}/tables/first")
    cols("nation", "n_nationkey", "n_name", "b").write.orc(f"{folder}/second.orc")
    sinks.write_jsonl(cols("supplier", "s_suppkey", "s_name", "c"), f"{folder}/third.jsonl")
    return concat(read_many(s, f"{folder}/tables@first, {folder}/second.orc,{folder}/third.jsonl", "k bigint, name string, kind string"))


@C.add("""SELECT CAST(least(1000, count(*)) AS BIGINT) AS seen, CAST(count(*) AS BIGINT) AS all_ FROM events""")
def early_count(s, sf):
    """A count that stops at a thousand lines beside the whole; the feature is the stop."""
    e = table(s, sf, "events").select("event_id")
    return e.limit(1000).agg(F.count("*").alias("seen")).crossJoin(F.broadcast(e.agg(F.count("*").alias("all_"))))  # one row each


@C.add("""SELECT item_id, question AS text FROM benchmark_item""")
def json_array(s, sf):
    """One array a file: cached completions, read again as rows."""
    path = _folder(s) + "/all.json"
    d = table(s, sf, "benchmark_item").select("item_id", F.col("question").alias("text"))
    # the array form is for small files: one line a benchmark
    arrays = d.groupBy((F.col("item_id") % 4).alias("k")).agg(F.to_json(F.collect_list(F.struct("item_id", "text"))).alias("value"))
    arrays.select("value").repartition(4).write.text(path)
    return read_jsonl(s, path, "item_id bigint, text string", array=True)


@C.add("""SELECT item_id, question FROM benchmark_item WHERE question IS NOT NULL""")
def jsonl_plain(s, sf):
    """Lines without any escape of letters, as they are."""
    d = table(s, sf, "benchmark_item").select("item_id", "question")
    path = _folder(s) + "/rows.jsonl"
    sinks.write_jsonl(d, path, "none")
    return read_jsonl(s, path, d.schema)


@C.add("""SELECT model, benchmark, round(avg(CAST(is_correct AS INT)), 6) AS accuracy FROM eval_log JOIN benchmark_item ON data_id = item_id GROUP BY ALL""")
def results_table(s, sf):
    """A table of results to which runs are added; a result that is written again replaces the one before."""
    folder = _folder(s)
    e = table(s, sf, "eval_log").join(table(s, sf, "benchmark_item").select(F.col("item_id").alias("data_id"), "benchmark"), "data_id")
    acc = e.groupBy("model", "benchmark").agg(F.round(F.avg(F.col("is_correct").cast("int")), 6).alias("accuracy"))
    sinks.upsert(s, folder, acc.withColumn("accuracy", F.lit(0.0)), ["model", "benchmark"])
    sinks.upsert(s, folder, acc, ["model", "benchmark"])
    return sinks.current(s, folder, ["model", "benchmark"]).select("model", "benchmark", "accuracy")


@C.add("""SELECT CAST(event_id // 500 AS BIGINT) AS step, 'loss' AS name, round(avg(value), 6) AS value FROM events GROUP BY 1 UNION ALL SELECT CAST(event_id // 500 AS BIGINT), 'n', count(*) FROM events GROUP BY 1""")
def scalar_table(s, sf):
    """Scalars of each step in a long table, beside the data and never in it."""
    g = table(s, sf, "events").groupBy(F.floor(F.col("event_id") / 500).alias("step")).agg(F.round(F.avg("value"), 6).alias("loss"), F.count("*").cast("double").alias("n"))
    path = _folder(s)
    sinks.write_scalars(g, path, "step", ["loss", "n"])
    return s.read.parquet(path)


@C.add("""SELECT l_linenumber AS lr, o_orderstatus AS status, CAST(count(*) AS BIGINT) AS runs FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def experiment_log(s, sf):
    """A log of runs as CSV to which rows are added, read back and counted."""
    path = _folder(s) + "/log.csv"
    d = table(s, sf, "lineitem").join(table(s, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_linenumber").alias("lr"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("runs"))
    for part in (d.where("lr < 4"), d.where("lr >= 4")):
        part.write.mode("append").option("header", True).csv(path)
    return read_path(s, path, "lr int, status string, runs bigint")


@C.add("""SELECT CAST(event_id // 500 AS BIGINT) AS step, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS loss FROM events GROUP BY 1""")
def step_stream(s, sf):
    """Metrics of each step, kept up to date by a stream."""
    return jobs.step_metrics(s, f"{sf}/events.parquet", F.floor(F.col("event_id") / 500), _folder(s)).select("step", "n", F.round("loss", 6).alias("loss"))


@C.add("""SELECT event_id, CAST(user_id % 4 AS BIGINT) AS rank, round(value * 2 + (SELECT count(*) FROM events), 4) AS answer FROM events""")
def barrier_batch(s, sf):
    """Requests of all ranks gathered in one micro-batch, answered together, and handed back by rank."""
    got = jobs.barrier(s, f"{sf}/events.parquet", F.col("user_id") % 4, lambda d, n: d.withColumn("answer", F.col("value") * 2 + F.lit(n)), _folder(s))
    return got.select("event_id", "rank", F.round("answer", 4).alias("answer"))


@C.add("SELECT c_custkey, c_name FROM customer")
def csv_roundtrip(s, sf):
    path = _folder(s) + "/rows.csv"
    table(s, sf, "customer").select("c_custkey", "c_name").write.option("header", True).csv(path)
    return read_path(s, path, "c_custkey bigint, c_name string")


@C.add("SELECT prompt_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT prompt_id, model FROM generation) GROUP BY prompt_id")
def resume_append(s, sf):
    """Two appends of overlapping parts; the second leaves out what is done."""
    d = table(s, sf, "generation").select("prompt_id", "model").distinct().withColumn("key", F.concat_ws("|", "prompt_id", "model"))
    path = _folder(s)
    sinks.append_new(d.where("model < 'm'"), path, "key", None)
    sinks.append_new(d, path, "key", s.read.parquet(path))
    return s.read.parquet(path).groupBy("prompt_id").agg(F.count("*").alias("n"))


@C.add("SELECT item_id, benchmark FROM benchmark_item ORDER BY item_id LIMIT 64")
def portion_sink(s, sf):
    """The feature is the side file of the first 64 rows."""
    return sinks.portion(table(s, sf, "benchmark_item").select("item_id", "benchmark"), ["item_id"])


@C.add("""SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_windows(s, sf):
    return jobs.window_totals(s, f"{sf}/events.parquet", _folder(s)).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@C.add("SELECT data_id, batch_no, model FROM rollout_batch GROUP BY ALL")
def stream_resume(s, sf):
    return jobs.resumed(s, f"{sf}/rollout_batch.parquet", ["data_id", "batch_no", "model"], _folder(s))


@C.add("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 minute THEN 0 ELSE 1 END AS brk FROM events), x AS (SELECT user_id, value, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(count(DISTINCT k) AS BIGINT) AS sessions FROM x GROUP BY user_id""")
def session_windows(s, sf):
    """An extension on the events table."""
    d = table(s, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = d.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return w.groupBy("user_id").agg(F.count("*").alias("sessions"))


@C.add("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 16""")
def stream_fifo(s, sf):
    return jobs.fifo(s, f"{sf}/events.parquet", "user_id", "event_id", 16, _folder(s))
