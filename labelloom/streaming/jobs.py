"""Structured Streaming jobs for the state that is carried from round to round.

Functions that only use joins, windows and aggregations take batch or streaming
frames alike. Jobs with keyed state use one small value per key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from labelloom.session import ensure_checkpoint_dir

TINY = 1e-4


# ---------------------------------------------------------------- running a stream to its end

def stream_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run, inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def open_stream(spark: SparkSession, path: str, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream; the schema comes from the files already there."""
    reader = spark.readStream.schema(spark.read.option("pathGlobFilter", glob or "*.parquet").parquet(path).schema).option(
        "pathGlobFilter", glob or "*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def as_stream(df: DataFrame, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Write a frame once and read it back as a stream."""
    path = stream_folder(df.sparkSession, name)
    df.write.parquet(path)
    return open_stream(df.sparkSession, path, files_per_batch=files_per_batch)


def staged(frames: list[DataFrame], name: str) -> DataFrame:
    """Write frames one after the other into one folder and read them as a stream, a file per batch in that order."""
    path = stream_folder(frames[0].sparkSession, name)
    for df in frames:
        # One file, but only its write is one task.
        df.repartition(1).write.mode("append").parquet(path)
    return open_stream(frames[0].sparkSession, path, files_per_batch=1)


def drain(stream: DataFrame, name: str, mode: str = "append", store: str | None = None) -> DataFrame:
    """Run a stream over everything available and return what it wrote.

    Append and update results are appended per batch with their batch number;
    complete results replace the previous batch. ``store`` names a state store provider for this query alone.
    """
    spark = stream.sparkSession
    if store:
        setting = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(setting)
        spark.conf.set(setting, store)
        try:
            return drain(stream, name, mode)
        finally:
            spark.conf.set(setting, before)
    out, marks = stream_folder(spark, name), stream_folder(spark, name + "-ckpt")

    def write(batch: DataFrame, number: int) -> None:
        target = f"{out}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(
        write).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    got = spark.read.schema(schema).parquet(out)
    if mode == "complete":
        last = got.agg(F.max("batch").alias("batch"))
        return got.join(F.broadcast(last), "batch").drop("batch")
    return got


# ---------------------------------------------------------------- windows, joins, aggregates

def response_window(tasks: DataFrame, responses: DataFrame, seconds: int = 600, horizon: str = "7 days",
                    delay: str = "1 hour") -> DataFrame:
    """Every response with ``known`` and ``late``: arrival at or after the deadline of its task.

    ``tasks``: task_id, started. ``responses``: task_id, arrived and more. A
    response without an open task comes out with ``known`` false and counts as
    late. With two streams, state is kept for ``horizon`` around the start of a
    task: a response farther away finds no task and comes out once the
    watermark (``delay``) has passed it.
    """
    deadline = F.col("started") + F.expr(f"INTERVAL {seconds} SECONDS")
    right = tasks.withColumnRenamed("task_id", "_task")
    if tasks.isStreaming and responses.isStreaming:
        responses, right = responses.withWatermark("arrived", delay), right.withWatermark("started", delay)
        on = F.expr(f"task_id = _task AND arrived >= started - INTERVAL {horizon} AND arrived <= started + INTERVAL {horizon}")
    else:
        on = F.expr("task_id = _task")
    joined = responses.join(right, on, "left")
    return joined.withColumn("known", F.col("_task").isNotNull()).withColumn(
        "late", F.coalesce(F.col("arrived") >= deadline, F.lit(True))).drop("_task")


def split_late(rows: DataFrame, on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None]):
    """``foreachBatch`` function that routes late rows away (a late answer is an abstention)."""
    def route(batch: DataFrame, number: int) -> None:
        on_time(batch.where("NOT late"), number)
        late(batch.where("late"), number)

    return route


def first_records(rows: DataFrame, key: list[str], time: str = "arrived", delay: str = "1 hour") -> DataFrame:
    """First record per key; the state of a key ends with the watermark.

    A record more than ``delay`` behind the newest one is not seen any more: choose the delay that the sources keep, or take such rows out first (``split_behind``).
    """
    if rows.isStreaming:
        return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)
    return rows.dropDuplicates(key)


def ledger_totals(credits: DataFrame) -> DataFrame:
    """Running adoption counts and contributions per annotator."""
    return credits.groupBy("annotator_id").agg(F.sum("adopted").alias("adoptions"), F.sum("contribution").alias("contribution"))


def round_counts(events: DataFrame) -> DataFrame:
    """Reliability counts per (annotator, label, round); decay is applied when they are read (``decayed_counts``)."""
    return events.groupBy("annotator_id", "label", "round_num").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def budget_breaker(calls: DataFrame, limit: int, delay: str = "1 day") -> DataFrame:
    """Days and roles whose call count reached the limit."""
    src = calls.withWatermark("ts", delay) if calls.isStreaming else calls
    per = src.groupBy(F.window("ts", "1 day").alias("w"), "role").agg(F.count("*").alias("calls"))
    return per.where(F.col("calls") >= limit).select(F.col("w.start").alias("day"), "role", "calls")


def split_behind(time: str, delay: str, on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None], newest: str | None = None):
    """``foreachBatch`` function that hands on rows more than ``delay`` behind the newest row before their batch as late.

    Put before a job with that watermark it makes the rows visible that the job would drop. ``newest``: where to start, else with the first batch.
    """
    top = [newest]

    def route(batch: DataFrame, number: int) -> None:
        limit = F.lit(False) if top[0] is None else F.col(time) < F.lit(top[0]).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        on_time(batch.where(~limit), number)
        late(batch.where(limit), number)
        seen = batch.agg(F.date_format(F.max(time), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
        top[0] = max(filter(None, (top[0], seen)), default=None)

    return route


def round_health(events: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Event counts per tumbling window; a window closes ``delay`` after its end (see ``split_behind`` for rows later than that)."""
    src = events.withWatermark("ts", delay) if events.isStreaming else events
    per = src.groupBy(F.window("ts", width).alias("w")).agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.sum("value").alias("value"))
    return per.select(F.col("w.start").alias("start"), "events", "errors", "value")


def activity_sessions(events: DataFrame, gap: str = "6 hours", key: str = "user_id", delay: str = "1 day") -> DataFrame:
    """Sessions of activity per key, closed by a silent gap, once ``delay`` has passed too."""
    src = events.withWatermark("ts", delay) if events.isStreaming else events
    per = src.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("events"))
    return per.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def every_nth(n: int, write: Callable[[DataFrame, int], None]):
    """``foreachBatch`` function that runs ``write`` on every n-th batch alone; ``sinks.export_batches`` keeps the rows between."""
    def run(batch: DataFrame, number: int) -> None:
        if number % n == 0:
            write(batch, number)

    return run


# ---------------------------------------------------------------- keyed state

SCORE_OUT = "annotator_id bigint, round int, ema double, delta double"


def score_stream(scores: DataFrame) -> DataFrame:
    """One row per annotator and round: reward, and whether the identity was reset in that round.

    ``scores``: annotator_id, round (a running number), reward and ``reset``
    (true on an identity change). The rounds themselves are the state, so they
    may arrive in any order; averages are folded when they are read (``score_path``).
    """
    real = ~F.col("reset")
    return scores.groupBy("annotator_id", "round").agg(
        F.max(F.when(real, F.coalesce("reward", F.lit(0.0)))).alias("reward"), F.bool_or("reset").alias("reset"))


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last written row per key of a drained update stream."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def score_path(rounds: DataFrame, alpha: float = 0.25) -> DataFrame:
    """Moving average and change per annotator after each round, from ``score_stream`` rows.

    Missing rounds count as 0. A reset clears average and change and leaves a
    row of zero, so it also counts for an annotator who never returns. A reward of the
    same round comes before the reset. One group has one row per round.
    """
    keep = 1.0 - alpha

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ema, last, at, seen, out = 0.0, 0.0, -1, False, []
        for r in rows.sort_values("round").itertuples(index=False):
            number, delta = int(r.round), 0.0
            if not pd.isna(r.reward):
                idle = ema * keep ** (number - at - 1) if at >= 0 else 0.0
                ema = alpha * float(r.reward) + keep * (idle if idle >= TINY else 0.0)
                ema = ema if ema >= TINY else 0.0
                delta, last, at, seen = (float(r.reward) - last if seen else 0.0), float(r.reward), number, True
            if r.reset:
                ema, delta, last, at, seen = 0.0, 0.0, 0.0, number, False
            out.append((key[0], number, ema, delta))
        return pd.DataFrame(out, columns=["annotator_id", "round", "ema", "delta"])

    return rounds.groupBy("annotator_id").applyInPandas(fold, SCORE_OUT)


AVERAGE_OUT = "annotator_id bigint, round int, ema double, delta double, reward double, late boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Averages(StatefulProcessor):
    """Moving average of one annotator: the closed past, and the rounds that are still open."""

    def __init__(self, alpha: float, open_rounds: int, idle_ms: int | None):
        self.alpha, self.open_rounds, self.idle_ms = alpha, open_rounds, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A state that nobody touches for the idle time expires by itself.
        # One value holds all of it: every access to the store is a round trip, one read and one write per annotator and batch.
        self.state = handle.getValueState("state", "closed int, ema double, last double, at int, seen boolean, "
                                          "rounds array<int>, rewards array<double>, resets array<boolean>", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed, *state, rounds, rewards, resets = self.state.get() or (-1, 0.0, 0.0, -1, False, [], [], [])
        pending = {r: (v, x) for r, v, x in zip(rounds, rewards, resets)}
        out = []
        for pdf in rows:
            for number, reward, reset in zip(pdf["round"].tolist(), pdf["reward"].tolist(), pdf["reset"].tolist()):
                value = None if reset else 0.0 if pd.isna(reward) else float(reward)
                if number <= closed:
                    out.append((key[0], number, None, None, value, True))
                    continue
                old, was_reset = pending.get(number, (None, False))
                value = old if value is None else value if old is None else max(old, value)
                pending[number] = (value, was_reset or bool(reset))
        # Open rounds come out again as they are now; the newest row of a round is the one that counts.
        closed = max([closed, *(n - self.open_rounds for n in pending)])
        ahead = state
        for number in sorted(pending):
            reward, reset = pending[number]
            ahead, delta = _step(ahead, number, reward, reset, self.alpha)
            out.append((key[0], number, ahead[0], delta, reward, False))
            if number <= closed:
                state = ahead
                del pending[number]
        rounds = sorted(pending)
        self.state.update((closed, *state, rounds, [pending[n][0] for n in rounds], [pending[n][1] for n in rounds]))
        yield pd.DataFrame(out, columns=["annotator_id", "round", "ema", "delta", "reward", "late"]).astype({"late": bool})

    def close(self) -> None:
        pass


def _step(state, number: int, reward: float | None, reset: bool, alpha: float) -> tuple[list, float]:
    """(ema, last reward, its round, whether there was one) after a round, and the change of the reward. A reset follows the reward of its round."""
    (ema, last, at, seen), keep, delta = state, 1.0 - alpha, 0.0
    if reward is not None:
        idle = ema * keep ** (number - at - 1) if at >= 0 else 0.0
        ema = alpha * reward + keep * (idle if idle >= TINY else 0.0)
        ema = ema if ema >= TINY else 0.0
        delta, last, at, seen = (reward - last if seen else 0.0), reward, number, True
    if reset:
        ema, delta, last, at, seen = 0.0, 0.0, 0.0, number, False
    return [ema, last, at, seen], delta


def score_averages(scores: DataFrame, alpha: float = 0.25, open_rounds: int = 10, idle: str | None = None) -> DataFrame:
    """Moving average and change per annotator and round, with bounded state: (annotator_id, round, ema, delta, reward, late).

    ``scores`` (a stream): annotator_id, round (a running number), reward and ``reset``. Rounds may arrive in any order as long
    as they are no more than ``open_rounds`` behind the newest of their annotator; an open round comes out again when an earlier one
    changes it (``newest`` keeps the last). Rows of closed rounds come out with ``late`` and change nothing, so that a
    sink can send them elsewhere (``split_late``). State: five numbers and at most ``open_rounds`` rounds per annotator; with
    ``idle`` it expires after that time without a row. That goes by the clock, so such a query never comes to an end by itself: not
    for runs over what is available. Missing rounds count as 0; rows of one round count once, with the largest reward.
    The keyed state needs the RocksDB state store (``drain`` sets it for its own query).
    """
    days = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = scores.select("annotator_id", F.col("round").cast("int").alias("round"), F.col("reward").cast("double").alias("reward"), F.col("reset").cast("boolean").alias("reset"))
    return rows.groupBy("annotator_id").transformWithStateInPandas(
        _Averages(alpha, open_rounds, days), AVERAGE_OUT, "Update", "None" if days is None else "ProcessingTime")


def ema_asof(rows: DataFrame, asof: int, alpha: float = 0.25) -> DataFrame:
    """Ledger as of a round from the newest row per annotator, with the decay of the rounds since."""
    last = rows.groupBy("annotator_id").agg(F.max_by("ema", "round").alias("e"), F.max("round").alias("r"))
    now = F.col("e") * F.pow(F.lit(1.0 - alpha), F.lit(asof) - F.col("r"))
    return last.select("annotator_id", F.when(now < TINY, 0.0).otherwise(now).alias("ema"))


def expire_objects(objects: DataFrame, hours: float = 2.0, delay: str = "1 hour") -> DataFrame:
    """Keys whose last write is older than ``hours`` before the watermark; writes may arrive ``delay`` out of order."""
    millis = int(hours * 3_600_000)

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            size, seen = state.get
            state.remove()
            yield pd.DataFrame([(key[0], size, pd.Timestamp(seen, unit="us"))], columns=["key", "bytes", "modified"])
            return
        rows = pd.concat(list(frames)).sort_values("modified")
        newest = rows.iloc[-1]
        stamp = newest["modified"].value // 1000
        if state.exists and state.get[1] > stamp:
            stamp, size = state.get[1], state.get[0]
        else:
            size = int(newest["bytes"])
        state.update((size, stamp))
        state.setTimeoutTimestamp(max(stamp // 1000 + millis, state.getCurrentWatermarkMs() + 1))

    return objects.withWatermark("modified", delay).groupBy("key").applyInPandasWithState(
        update, "key string, bytes bigint, modified timestamp", "bytes bigint, seen bigint", "append",
        GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------- epoch cursor

def task_status(log: DataFrame) -> DataFrame:
    """Current status per task: the newest of claimed, dispatched, closed."""
    return log.groupBy("task").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"),
                                   F.max_by("fingerprint", "at").alias("fingerprint"))


def resume_plan(log: DataFrame, plan: DataFrame, fingerprint: str) -> DataFrame:
    """What to do with each planned task after a restart.

    closed and in-flight dispatched tasks are skipped, claimed but undispatched
    ones are run again, unseen ones run; a changed dataset refuses everything.
    """
    row = plan.join(task_status(log), "task", "left")
    return row.select("task", F.when(F.col("fingerprint").isNotNull() & (F.col("fingerprint") != fingerprint), "refuse").when(
        F.col("status") == "closed", "done").when(F.col("status") == "dispatched", "skip").when(
        F.col("status") == "claimed", "rewind").otherwise("run").alias("action"))
