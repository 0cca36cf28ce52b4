"""Streaming forms of the monitoring log and the log-in limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import parsing


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1_000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily(events: DataFrame, ts: str = "ts", score: str = "value", late: str = "2 days") -> DataFrame:
    """Counts and mean score by day and job; rows that come later than the watermark are left out, and a day's state goes
    when it is past. The same expression serves batch input."""
    rows = events.select(F.col(ts).cast("timestamp").alias("ts"), F.col("event_type").alias("job"), parsing.score01(score).alias("score")).where("score is not null")
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", "1 day"), "job").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    return out.select(F.to_date("window.start").alias("day"), "job", "n", "mean")


def run_once(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "complete") -> None:
    """Processes what is there and stops; the result is an in-memory table (tests) of that name."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()


def limited(times: list[float], held: list[float], window: float, most: int) -> tuple[list[bool], list[float]]:
    """Sliding-window limiter: an attempt passes if fewer than ``most`` passed in the window before it; only attempts that
    pass count."""
    out = []
    for t in times:
        held = [h for h in held if h > t - window]
        out.append(len(held) < most)
        if out[-1]:
            held.append(t)
    return out, held


def rate_limit(attempts: DataFrame, key: str = "user_id", ts: str = "ts", window: float = 60.0, most: int = 10) -> DataFrame:
    """``key, t, accepted`` of a batch: each key's attempts in order of time. Rows of a key come sorted from the shuffle and
    are read as they come, so a key of any size needs the memory of one window only."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            keys, times, out = batch.column("k").to_pylist(), batch.column("t").to_pylist(), []
            for k, t in zip(keys, times, strict=True):
                if k != last:
                    last, held = k, []
                ok, held = limited([t], held, window, most)
                out += ok
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("t"), pa.array(out, pa.bool_())], names=["k", "t", "accepted"])

    rows = attempts.select(F.col(key).cast("string").alias("k"), F.col(ts).cast("timestamp").cast("double").alias("t")).where("k is not null and t is not null")
    return rows.repartition("k").sortWithinPartitions("k", "t").mapInArrow(run, "k string, t double, accepted boolean")


def rate_limit_stream(attempts: DataFrame, key: str = "user_id", ts: str = "ts", window: float = 60.0, most: int = 10) -> DataFrame:
    """The same with state kept between micro-batches; a key's state goes when the watermark is a window past its last
    attempt."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        times = sorted(t for f in frames for t in f["t"])
        ok, held = limited(times, held, window, most)
        state.update((held,))
        state.setTimeoutTimestamp(max(int((times[-1] + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"k": k[0], "t": times, "accepted": ok})

    timed = attempts.select(F.col(key).cast("string").alias("k"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", f"{int(window)} seconds")
    rows = timed.withColumn("t", F.col("at").cast("double"))
    return rows.groupBy("k").applyInPandasWithState(step, "k string, t double, accepted boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def lockout_seconds(failed: Column, most_failed: int = 5, base: int = 30, cap: int = 900):
    """Seconds of lock-out after so many failures: none up to the limit, then doubling up to the cap."""
    return F.when(failed >= most_failed, F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), failed - most_failed))).otherwise(F.lit(0.0)).cast("long")
