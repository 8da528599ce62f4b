"""Streaming forms of the flow operators: every one takes a streaming DataFrame of the flow schema and returns one."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import stream_sessions  # noqa: F401
from ..session import shared_folder
from ..sources.flows import clean
from ..sources.formats import FLOW_SCHEMA


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a directory as they arrive, cleaned."""
    reader = spark.readStream.schema(FLOW_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return clean(reader.parquet(path))


def time_bins(df: DataFrame, size: str, hold: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Tumbling or sliding bins by start time; a bin is emitted once ``hold`` has passed after its end, later records drop."""
    window = F.window("stime", size, slide) if slide else F.window("stime", size)
    rows = df.where("stime is not null").withWatermark("stime", hold).groupBy(window.alias("w"), *keys)
    out = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("spkts", "dpkts", "sbytes", "dbytes")))
    return out.select(F.unix_micros("w.start").alias("bin_us"), *keys, "n", "spkts", "dpkts", "sbytes", "dbytes")


def distinct_records(df: DataFrame, hold: str) -> DataFrame:
    """Copies of a record (sid, seq) within ``hold`` of each other collapse; the state is dropped after that."""
    return df.withWatermark("stime", hold).dropDuplicatesWithinWatermark(["sid", "seq"])


def status_reports(df: DataFrame, keys: list[str], status_s: float, idle_s: float) -> DataFrame:
    """Live aggregation with timers: a key's record is emitted when it spans ``status_s`` or idles for ``idle_s``.

    The state of a key is five numbers. Null keys are not followed. Output: keys, stime_us, ltime_us, n, bytes, reason.
    """
    status, idle = int(status_s * 1e6), int(idle_s * 1e6)
    types = dict(df.dtypes)
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []

        def emit(start, end, n, size, why):
            out.append((*key, start, end, n, size, why))

        if state.hasTimedOut:
            emit(*state.get, "idle")
            state.remove()
        else:
            now = state.get if state.exists else None
            rows = sorted((int(s), int(e), int(b)) for f in frames for s, e, b in zip(f["stime_us"], f["end_us"], f["bytes"]))
            for s, e, b in rows:
                if now and now[1] - now[0] >= status:
                    emit(*now, "status")
                    now = None
                elif now and s - now[1] >= idle:
                    emit(*now, "idle")
                    now = None
                now = (min(now[0], s), max(now[1], e), now[2] + 1, now[3] + b) if now else (s, e, 1, b)
            if now:
                state.update(now)
                state.setTimeoutTimestamp(max((now[1] + idle) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[*keys, "stime_us", "ltime_us", "n", "bytes", "reason"])

    rows = df.where(" and ".join(f"{k} is not null" for k in [*keys, "stime"])).withColumns({"end_us": F.greatest(F.coalesce("ltime_us", "stime_us"), F.col("stime_us")), "bytes": F.coalesce("sbytes", F.lit(0)) + F.coalesce("dbytes", F.lit(0))})
    rows = rows.withWatermark("stime", f"{max(1, int(idle_s))} seconds")
    schema = f"{key_schema}, stime_us bigint, ltime_us bigint, n bigint, bytes bigint, reason string"
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "s bigint, e bigint, n bigint, b bigint", "append", GroupStateTimeout.EventTimeTimeout)


def open_reports(states: DataFrame) -> DataFrame:
    """What :func:`status_reports` still holds, as reports with the reason 'open': rows of its state (key, value)."""
    now = "value.groupState"
    return states.where(f"{now} is not null").select("key.*", F.col(f"{now}.s").alias("stime_us"), F.col(f"{now}.e").alias("ltime_us"), F.col(f"{now}.n").alias("n"), F.col(f"{now}.b").alias("bytes"), F.lit("open").alias("reason"))


def events_with_flows(flows: DataFrame, events: DataFrame, within: str) -> DataFrame:
    """Stream-stream join of flows and open-port events (sid, ts, prog, proto, port) of one probe up to ``within`` apart."""
    a = flows.where("stime is not null").withWatermark("stime", within).select("autoid", "sid", "proto", "dport", "stime")
    b = events.withWatermark("ts", within).select(F.col("sid").alias("esid"), F.col("proto").alias("eproto"), "port", "ts", "prog")
    near = F.expr(f"ts between stime - interval {within} and stime + interval {within}")
    return a.join(b, (F.col("sid") == F.col("esid")) & (F.col("proto") == F.col("eproto")) & (F.col("dport") == F.col("port")) & near)


def top_k(df: DataFrame, key: str, k: int, hold: str, sink: Callable[[DataFrame, int], None], at: str):
    """Live top list: after each trigger ``sink`` gets the ``k`` greatest totals by window of ``hold`` and key, of the newest two
    windows that have records.

    Totals run in update mode, so a trigger hands over only the keys it touched. As totals never shrink, the new list lies
    among these and the list before: that is kept under ``at``, a shared folder, k rows a window for the newest two windows,
    and a repeated batch starts from the same predecessor. Keys leave the state with their window.
    """
    totals = df.where("stime is not null").withWatermark("stime", hold).groupBy(F.window("stime", hold), key).agg(F.sum(F.coalesce("sbytes", F.lit(0)) + F.coalesce("dbytes", F.lit(0))).alias("bytes"), F.count(F.lit(1)).alias("n"))
    totals = totals.select(F.unix_micros("window.start").alias("window_us"), key, "bytes", "n")
    spark = df.sparkSession

    def rank(batch: DataFrame, no: int) -> None:
        held = spark.read.schema(batch.schema).parquet(f"{at}/list={no - 1}") if no else batch.limit(0)
        rows = held.unionByName(batch).groupBy("window_us", key).agg(F.max("bytes").alias("bytes"), F.max("n").alias("n"))
        place = F.row_number().over(Window.partitionBy("window_us").orderBy(F.desc("bytes"), F.asc_nulls_last(key)))
        best = rows.withColumn("place", place).where(F.col("place") <= k).drop("place")  # limited within each task before the window's
        age = F.dense_rank().over(Window.partitionBy().orderBy(F.desc("window_us")))  # over k rows a window
        best.withColumn("age", age).where("age <= 2").drop("age").coalesce(1).write.mode("overwrite").parquet(f"{at}/list={no}")
        stored = spark.read.schema(batch.schema).parquet(f"{at}/list={no}")
        sink(stored.orderBy(F.desc("bytes"), F.asc_nulls_last(key), "window_us").limit(k), no)

    return totals.writeStream.outputMode("update").foreachBatch(rank)


def poll(spark: SparkSession, ask: Callable[[], DataFrame], every: str, sink: Callable[[DataFrame, int], None], times: int | None = None):
    """Asks a source that has to be polled (program, table, service) once in ``every`` and hands the answer to ``sink``.

    A micro-batch is the clock, so a slow answer delays the next question and never overlaps it. ``times`` ends it.
    """
    asked = [0]

    def tick(batch: DataFrame, no: int) -> None:
        if times is None or asked[0] < times:
            sink(ask(), asked[0])
            asked[0] += 1

    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(tick).trigger(processingTime=every)


def with_empty_bins(batch: DataFrame, size_us: int) -> DataFrame:
    """For foreachBatch after :func:`time_bins`: the bins between a batch's first and last that nothing fell into."""
    ends = batch.agg(F.min("bin_us").alias("a"), F.max("bin_us").alias("b")).where("a is not null")
    calendar = ends.select(F.explode(F.sequence("a", "b", F.lit(size_us))).alias("bin_us"))
    rest = [F.coalesce(c, F.lit(0)).alias(c) if t == "bigint" else F.col(c) for c, t in batch.dtypes if c != "bin_us"]
    return calendar.join(batch, "bin_us", "left").select("bin_us", *rest)


def split_files(df: DataFrame, path: str, checkpoint: str, on_close: Callable[[str, int], None] | None = None):
    """Continuous split into directories by day and hour; ``on_close(path, batch)`` runs after each batch is in place."""

    def write(batch: DataFrame, no: int) -> None:
        rows = batch.withColumns({"date": F.date_format("stime", "yyyy-MM-dd"), "hour": F.date_format("stime", "HH")})
        rows.write.mode("overwrite").partitionBy("date", "hour").parquet(f"{path}/batch={no}")  # a repeated batch replaces itself
        if on_close:
            on_close(f"{path}/batch={no}", no)

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def fan_out(df: DataFrame, outputs: dict[str, str], path: str, checkpoint: str):
    """One stream to several filtered outputs: a batch is read once and written for each name, under its own directory."""
    from ..plans.filterlang import compile_filter

    def write(batch: DataFrame, no: int) -> None:
        batch.persist()
        for name, text in outputs.items():
            batch.where(compile_filter(text, set(batch.columns))).write.mode("overwrite").parquet(f"{path}/{name}/batch={no}")
        batch.unpersist()

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def run_available(writer) -> None:
    """Runs a stream over everything that is there and stops."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


def run_for(writer, seconds: float) -> None:
    """Runs a continuous query for so many seconds, then stops it."""
    q = writer.start()
    try:
        q.awaitTermination(int(seconds))
    finally:
        q.stop()


def read_live(spark: SparkSession, uri: str, **options: str) -> DataFrame:
    """Live source by URI: 'kafka://host:port/topic' (needs the connector on the class path), 'tcp://host:port', 'file:dir'.

    Messages of the first two are JSON records of the flow schema.
    """
    kind, _, rest = uri.partition(":")
    if kind == "file":
        return read_stream(spark, rest)
    host, _, topic = rest.lstrip("/").partition("/")
    if kind == "kafka":
        raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", host).option("subscribe", topic).options(**options).load().selectExpr("cast(value as string) as value")
    elif kind == "tcp":
        name, _, port = host.partition(":")
        raw = spark.readStream.format("socket").option("host", name).option("port", port).load()
    else:
        raise ValueError(f"no live source {uri!r}")
    return clean(raw.select(F.from_json("value", FLOW_SCHEMA).alias("x")).select("x.*"))


def replay(df: DataFrame, writer_path: str, speed: float, seconds_per_step: float = 1.0) -> DataFrame:
    """Stored records as one directory for each step of event time, for a stream that reads one file a trigger.

    At ``speed`` 60 a step of one second holds a minute of records. Returns the steps with their record counts.
    """
    step = int(speed * seconds_per_step * 1_000_000)
    rows = df.where("stime_us is not null").withColumn("step", F.expr(f"stime_us div {step}"))
    rows.repartition("step").write.mode("overwrite").partitionBy("step").parquet(writer_path)
    return rows.groupBy("step").agg(F.count(F.lit(1)).alias("n"))


def stored_result(df: DataFrame, mode: str = "append", still_open: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote.

    The result goes to the shared folder (spark.checkpoint.dir) and not through the driver. In mode 'complete' the last
    batch is the result, in 'append' all batches are, each under its own directory so that a repeated one replaces itself.
    ``still_open`` makes rows of the state that is left after the last batch; they end the result.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={0 if mode == 'complete' else no}")

    run_available(df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/log").foreachBatch(write))
    out = spark.read.schema(df.schema).parquet(f"{at}/out/batch=*")
    return out.unionByName(still_open(spark.read.format("statestore").load(f"{at}/log"))) if still_open else out


def staged(df: DataFrame, order: str, parts: int) -> DataFrame:
    """A stored table as a stream of ``parts`` micro-batches, cut at equal steps of the number ``order``.

    The parts are written one after the other to the shared folder and read one file set a trigger, so what lies behind the
    watermark by then is late, as it would be live.
    """
    from ..operators.ranges import with_range

    spark = df.sparkSession
    at = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    bounds = [] if lo is None or lo == hi else [lo + (hi + 1 - lo) * i / parts for i in range(1, parts)]
    rows = with_range(df, order, bounds, "_stage")
    for i in range(parts):
        rows.where(F.col("_stage") == i).drop("_stage").coalesce(1).write.mode("append").parquet(at)
        time.sleep(0.01)  # the reader takes files in the order of their times
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)


def latest_ranked(batch: DataFrame, key: str, by: str, k: int) -> DataFrame:
    """The ``k`` greatest rows of each key of a batch."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by)))
    return batch.withColumn("rank", rank).where(F.col("rank") <= k)
