"""Queries: streaming jobs, run as streams to the end of the test data."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.plans import sqltext as Q
from labelloom.plans.registry import query
from labelloom.plans.scoring import R6
from labelloom.session import cut
from labelloom.sources import sinks as K
from labelloom.streaming import jobs as J


def events(t):
    return J.open_stream(t.spark, t.path, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


# Tasks start every 20 minutes; an event answers the task its user number points at.
TASKS = """tasks AS (SELECT s_suppkey AS task_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (s_suppkey * 7) HOUR AS started FROM supplier)"""


@query("response_window", f"""WITH {TASKS} SELECT event_id, e.user_id % 100 AS task_id, epoch_us(ts) >= epoch_us(started) + 600000000 AS late FROM events e
   JOIN tasks ON task_id = e.user_id % 100 UNION ALL SELECT event_id, user_id % 100, true FROM events e ANTI JOIN tasks ON task_id = e.user_id % 100""")
def response_window(t):
    tasks = t.raw("supplier").selectExpr("s_suppkey AS task_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, CAST(s_suppkey * 7 AS INT)) AS started")
    responses = events(t).selectExpr("event_id", "user_id % 100 AS task_id", "ts AS arrived")
    return J.drain(J.response_window(tasks, responses), "window").select("event_id", "task_id", "late")


@query("response_window_streams", f"""WITH {TASKS}, e AS (SELECT event_id, user_id % 100 AS task_id, epoch_us(ts) AS us FROM events)
  SELECT event_id, e.task_id, t.task_id IS NOT NULL AS known, coalesce(us >= epoch_us(started) + 600000000, true) AS late FROM e LEFT JOIN tasks t
   ON t.task_id = e.task_id AND abs(us - epoch_us(started)) <= 2 * 86400000000""")
def response_window_streams(t):
    start = "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, CAST(s_suppkey * 7 AS INT))"
    tasks = t.raw("supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS task_id", f"{start} AS started")
    answers = t.raw("events").selectExpr("event_id", "CAST(user_id % 100 AS BIGINT) AS task_id", "CAST(ts AS TIMESTAMP) AS arrived")
    # Two closing rows per stream move the watermark past every real row, one file after the other.
    far = [f"timestamp'2100-01-0{d}'" for d in (1, 5)]
    tasks = J.staged([tasks, *[t.spark.sql(f"SELECT -1L AS task_id, {x} AS started") for x in far]], "tasks")
    answers = J.staged([answers, *[t.spark.sql(f"SELECT -1L AS event_id, -2L AS task_id, {x} AS arrived") for x in far]], "answers")
    got = J.drain(J.response_window(tasks, answers, horizon="2 days"), "windows")
    return got.where("event_id >= 0").select("event_id", "task_id", "known", "late")


@query("expired_objects", "SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(max(ts)) AS modified FROM events GROUP BY 1")
def expired_objects(t):
    """Every object expires once: writes come in three parts out of order, then two closing rows move the watermark."""
    rows = t.raw("events").selectExpr("CAST(user_id AS STRING) AS key", "CAST(floor(value) AS BIGINT) AS bytes", "CAST(ts AS TIMESTAMP) AS modified", "event_id % 3 AS part")
    parts = [rows.where(F.col("part") == k).drop("part") for k in (2, 0, 1)]
    far = [t.spark.sql(f"SELECT 'closing' AS key, 0L AS bytes, timestamp'{year}-01-01' AS modified") for year in (2100, 2101)]
    gone = J.drain(J.expire_objects(J.staged([*parts, *far], "objects"), 2.0, "60 days"), "expired")
    return gone.where("key <> 'closing'").select("key", F.unix_micros("modified").alias("modified"))


@query("first_records", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(floor(value) AS BIGINT) AS v FROM events) GROUP BY ALL")
def first_records(t):
    rows = events(t).selectExpr("user_id", "event_type", "CAST(floor(value) AS BIGINT) AS v", "ts")
    kept = J.drain(J.first_records(rows, ["user_id", "event_type", "v"], "ts", "40 days"), "dedup")
    return kept.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("budget_breaker", """SELECT CAST(ts AS DATE) AS day, event_type AS role, count(*) AS calls FROM events GROUP BY ALL HAVING count(*) >= 70""")
def budget_breaker(t):
    calls = events(t).selectExpr("ts", "event_type AS role")
    got = J.drain(J.budget_breaker(calls, 70), "budget", "complete")
    return got.select(F.to_date("day").alias("day"), "role", "calls")


@query("round_health", """SELECT epoch_us(date_trunc('hour', ts)) AS start, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS value FROM events GROUP BY 1""")
def round_health(t):
    got = J.drain(J.round_health(events(t)), "health", "complete")
    return got.select(F.unix_micros("start").alias("start"), "events", "errors", F.round("value", 4).alias("value"))


@query("activity_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) >= epoch_us(lag(ts) OVER w) + 21600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS events FROM s GROUP BY user_id, n""")
def activity_sessions(t):
    got = J.drain(J.activity_sessions(events(t)), "sessions", "complete")
    return got.select("user_id", F.unix_micros("start").alias("start"), "events")


@query("ledger_totals", "SELECT user_id AS annotator_id, count(*) FILTER (event_type = 'purchase') AS adoptions, round(sum(value), 4) AS contribution FROM events GROUP BY 1")
def ledger_totals(t):
    credits = events(t).selectExpr("user_id AS annotator_id", "CAST(event_type = 'purchase' AS BIGINT) AS adopted", "value AS contribution")
    got = J.drain(J.ledger_totals(credits), "ledger", "complete")
    return got.select("annotator_id", "adoptions", F.round("contribution", 4).alias("contribution"))


@query("streamed_counts", """SELECT user_id AS annotator_id, event_type AS label, round(sum((value > 50)::INT * power(0.95, 30 - day(ts))), 6) AS tp,
   round(sum((value <= 50)::INT * power(0.95, 30 - day(ts))), 6) AS fn FROM events GROUP BY ALL""")
def streamed_counts(t):
    rows = events(t).selectExpr("user_id AS annotator_id", "event_type AS label", "day(ts) AS round_num", "CAST(value > 50 AS DOUBLE) AS tp",
                                "0D AS fp", "CAST(value <= 50 AS DOUBLE) AS fn")
    counts = J.drain(J.round_counts(rows), "counts", "complete")
    age = F.pow(F.lit(0.95), 30 - F.col("round_num"))
    return counts.groupBy("annotator_id", "label").agg(F.round(F.sum(F.col("tp") * age), 6).alias("tp"), F.round(F.sum(F.col("fn") * age), 6).alias("fn"))


EMA_SQL = f"""{Q.with_tables('round_scores')}, grid AS (SELECT a.annotator_id, d.i, coalesce(r.reward, 0) AS v FROM (SELECT DISTINCT annotator_id FROM round_scores) a
    CROSS JOIN (SELECT unnest(range(1, 31)) AS i) d LEFT JOIN round_scores r ON r.annotator_id = a.annotator_id AND day(r.round) = d.i)
  SELECT annotator_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(v::DOUBLE ORDER BY i)), lambda s, v:
    CASE WHEN 0.25 * v + 0.75 * s < 1e-4 THEN 0 ELSE 0.25 * v + 0.75 * s END), 6) AS ema FROM grid GROUP BY 1"""


def _score_rows(t, reset="false"):
    # Kept, so that events are aggregated once and not for every part of a stream.
    return cut(t.round_scores.select("annotator_id", F.dayofmonth("round").alias("round"), "reward", F.expr(reset).alias("reset")))


def _averages(stream, name, **kw):
    """Newest row per annotator and round of the keyed state; late rows apart."""
    return J.newest(J.drain(J.score_averages(stream, **kw), name, "update", J.ROCKSDB).where("NOT late").drop("late"), ["annotator_id", "round"])


@query("ema_stream", EMA_SQL)
def ema_stream(t):
    # Rounds in blocks of ten, odd ones after even ones: out of order between batches, and earlier blocks close.
    rows = _score_rows(t)
    parts = [rows.where(f"round BETWEEN {lo} AND {lo + 9} AND round % 2 = {odd}") for lo in (1, 11, 21) for odd in (0, 1)]
    return J.ema_asof(_averages(J.staged(parts, "scores"), "ema", open_rounds=10), 30).select("annotator_id", R6("ema"))


@query("late_scores", f"""{Q.with_tables('round_scores')}, n AS (SELECT annotator_id, day(round)::INT AS round, reward FROM round_scores),
  m AS (SELECT annotator_id, max(round) AS top FROM n WHERE round > 5 GROUP BY 1) SELECT n.annotator_id, n.round, round(reward, 6) AS reward FROM n JOIN m USING (annotator_id) WHERE round <= 5 AND round <= top - 10""")
def late_scores(t):
    """Rounds that come after the newest ones have closed them."""
    rows = _score_rows(t)
    stream = J.staged([rows.where("round > 5"), rows.where("round <= 5")], "scores")
    got = J.drain(J.score_averages(stream, open_rounds=10), "late", "update", J.ROCKSDB)
    return got.where("late").select("annotator_id", "round", R6("reward"))


@query("score_delta_stream", f"""{Q.with_tables('round_scores')} SELECT annotator_id, day(round)::INT AS round, round(reward - coalesce(lag(reward) OVER (PARTITION BY annotator_id ORDER BY round), reward), 6) AS delta
   FROM round_scores""")
def score_delta_stream(t):
    rows = _score_rows(t)
    parts = [rows.where("round > 12 AND round <= 20"), rows.where("round <= 12"), rows.where("round > 20")]
    return _averages(J.staged(parts, "scores"), "delta", open_rounds=20).select("annotator_id", "round", R6("delta"))


@query("identity_reset_stream", f"""{Q.with_tables('round_scores')}, r AS (SELECT annotator_id, day(round) AS i, reward AS v FROM round_scores WHERE day(round) > CASE WHEN annotator_id % 3 = 0 THEN 15 ELSE 0 END),
  grid AS (SELECT a.annotator_id, d.i, coalesce(r.v, 0) AS v FROM (SELECT DISTINCT annotator_id FROM round_scores) a CROSS JOIN (SELECT unnest(range(1, 31)) AS i) d
    LEFT JOIN r ON r.annotator_id = a.annotator_id AND r.i = d.i)
  SELECT annotator_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(v::DOUBLE ORDER BY i)), lambda s, v: CASE WHEN 0.25 * v + 0.75 * s < 1e-4 THEN 0 ELSE 0.25 * v + 0.75 * s END), 6) AS ema
  FROM grid GROUP BY 1""")
def identity_reset_stream(t):
    rows = _score_rows(t)
    control = rows.where("annotator_id % 3 = 0").select("annotator_id").distinct().selectExpr(
        "annotator_id", "15 AS round", "CAST(NULL AS DOUBLE) AS reward", "true AS reset")
    got = _averages(J.as_stream(rows.unionByName(control), "scores"), "reset", open_rounds=30)
    return J.ema_asof(got, 30).select("annotator_id", R6("ema"))


@query("resume_plan", """WITH l AS (SELECT o_custkey AS task, CASE o_orderkey % 3 WHEN 0 THEN 'claimed' WHEN 1 THEN 'dispatched' ELSE 'closed' END AS status,
   CAST(epoch(o_orderdate) AS BIGINT) * 10000000 + o_orderkey AS pos, CASE WHEN o_orderkey % 50 = 0 THEN 'new' ELSE 'old' END AS fp FROM orders),
  s AS (SELECT task, arg_max(status, pos) AS status, arg_max(fp, pos) AS fp FROM l GROUP BY 1)
  SELECT c_custkey AS task, CASE WHEN fp <> 'old' THEN 'refuse' WHEN status = 'closed' THEN 'done' WHEN status = 'dispatched' THEN 'skip' WHEN status = 'claimed' THEN 'rewind' ELSE 'run' END AS action
  FROM customer LEFT JOIN s ON task = c_custkey""")
def resume_plan(t):
    log = t.raw("orders").selectExpr(
        "o_custkey AS task", "CASE o_orderkey % 3 WHEN 0 THEN 'claimed' WHEN 1 THEN 'dispatched' ELSE 'closed' END AS status",
        "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) * 10000000 + o_orderkey AS at", "CASE WHEN o_orderkey % 50 = 0 THEN 'new' ELSE 'old' END AS fingerprint")
    return J.resume_plan(log, t.raw("customer").select(F.col("c_custkey").alias("task")), "old")


@query("export_rounds", """SELECT 'set' || (l_suppkey % 3) AS dataset, 'batch_' || (l_linenumber % 4) AS batch, count(*) AS n, sum(l_orderkey)::BIGINT AS keys
   FROM lineitem WHERE l_linenumber <= 6 GROUP BY ALL""")
def export_rounds(t):
    """Rounds exported in twos: one replayed after its export, one that broke off before its marker, and a last one that waits for its pair."""
    rows = t.raw("lineitem").selectExpr("concat('set', l_suppkey % 3) AS dataset", "concat('batch_', l_linenumber % 4) AS batch", "CAST(l_orderkey AS STRING) AS value", "l_linenumber AS round")
    path = J.stream_folder(t.spark, "export")
    run = K.export_batches(path, 2)
    parts = [rows.where(F.col("round") == n).drop("round") for n in range(1, 8)]
    for number in (0, 1, 2, 3):
        run(parts[number], number)
    run(parts[3], 3)
    # Runs that stopped after writing some rows, without their marker: one is repeated later, one never.
    for number in (5, 7):
        parts[5].limit(3).write.mode("overwrite").partitionBy("dataset", "batch").text(f"{path}/exports/round={number}")
    for number in (4, 5, 6):
        run(parts[number], number)
    got = K.read_exports(t.spark, path)
    return got.groupBy("dataset", "batch").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("bigint")).alias("keys"))


@query("digest_files", """SELECT c_nationkey AS nation, sum(length(line) + 1)::BIGINT AS length, sha256(string_agg(line, chr(10) ORDER BY c_custkey) || chr(10)) AS sha256
   FROM (SELECT *, c_custkey || ' ' || c_mktsegment AS line FROM customer) GROUP BY 1""")
def digest_files(t):
    """Digests of files written from a given table, one per nation."""
    path = J.stream_folder(t.spark, "files")
    lines = t.raw("customer").select("c_nationkey", F.concat_ws(" ", F.col("c_custkey").cast("string"), "c_mktsegment").alias("value"), "c_custkey")
    lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").drop("c_custkey").write.partitionBy("c_nationkey").text(path)
    got = K.digest_files(t.spark, path, "*.txt")
    return got.select(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int").alias("nation"), "length", "sha256")
