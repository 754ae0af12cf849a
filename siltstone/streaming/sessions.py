"""Structured Streaming: session state, the cache's time to live, first-seen deduplication and windowed counts.

Each has a batch twin in siltstone.operators.state or siltstone.operators.dedup that gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.operators.state import TTL_DAYS, DEFAULT_TTL

TURNS = "conv_id long, turn long, role string, text string"


def read_table_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def session_windows(turns: DataFrame, n: int = 6, expire_hours: int | None = None) -> DataFrame:
    """(conv_id, turn, n_turns, last_roles): keyed state holds the last n turns of each session.

    With expire_hours, state goes so long after a session's last turn; such a stream runs on and does not end by itself.

    Turns of one micro-batch are taken in order of their number; a turn that comes in a later batch joins at the end.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(frames)).sort_values("turn")
        for r in rows.itertuples(index=False):
            held = [*held, r.role][-n:]
            out.append((key[0], r.turn, len(held), ",".join(held)))
        state.update((json.dumps(held),))
        if expire_hours:
            state.setTimeoutDuration(expire_hours * 3600 * 1000)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "n_turns", "last_roles"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, n_turns long, last_roles string", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout if expire_hours else GroupStateTimeout.NoTimeout)


def _timed(rows: DataFrame) -> DataFrame:
    """Event time as an instant; tables may hold it without a zone."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def live_entries(entries: DataFrame, late: str = "1 day") -> DataFrame:
    """The first entry of each cache key within the watermark, with the time at which it expires."""
    days = F.coalesce(F.create_map(*[x for k, v in TTL_DAYS.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")], F.lit(DEFAULT_TTL))
    once = _timed(entries).withWatermark("ts", late).dropDuplicatesWithinWatermark(["cache_key"])
    return once.withColumn("expires_at", (F.unix_timestamp("ts") + days * 86400).cast("timestamp"))


def counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events and their sum by type and window, closed by the watermark."""
    return _timed(events).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, into a table of the driver's memory; for tests and small reports."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
