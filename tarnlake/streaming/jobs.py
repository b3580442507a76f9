"""Structured Streaming forms of the counters, the debounce and the 24-hour credit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tool_counters(stream: DataFrame, tool: str = "event_type", value: str = "value") -> DataFrame:
    """Running sums by tool; write in update or complete mode."""
    return stream.groupBy(tool).agg(F.count(F.lit(1)).alias("calls"), F.sum(value).alias("total"))


def debounce(stream: DataFrame, key: str, ts: str, quiet: str = "250 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Bursts of a key with gaps under `quiet`."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, quiet).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def daily_rollup(stream: DataFrame, ts: str, *keys: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), *keys).agg(F.count(F.lit(1)).alias("calls")).select(F.col("w.start").cast("date").alias("day"), *keys, "calls")


def first_only(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Exactly-once gate: the first event of an id."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def credit_once(stream: DataFrame, keys: list[str], ts: str, hours: int = 24, late: str = "1 day") -> DataFrame:
    """(keys, ts, credited): a key's repeat within the hours gets no credit and refreshes the clock. State: the last time, one double a key, dropped once the watermark is past its hours, when it can change nothing."""
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {ts} timestamp, credited boolean"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(ts)
        credited = []
        for t in rows[ts]:
            now = t.timestamp()
            credited.append(last is None or now - last > hours * 3600)
            last = now
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + hours * 3600) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows[[*keys, ts]].assign(credited=credited)

    timed = stream.select(*keys, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, late)
    return timed.groupBy(*keys).applyInPandasWithState(step, schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def source(spark: SparkSession, path: str, schema: str, files: int = 64) -> DataFrame:
    """Parquet files under a folder as a stream of at most `files` of them a batch, which bounds what a batch holds."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(path)


def apply_batches(stream: DataFrame, apply, checkpoint: str):
    """Micro-batches through foreachBatch(apply), one at a time, over what is there."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
