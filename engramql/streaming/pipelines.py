"""Structured Streaming pipelines over the memory tables.

Each pipeline is a plan on a streaming DataFrame; where it must look at stored
rows it works per micro-batch (``foreachBatch``), idempotently by batch number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engramql.config import DEFAULT, Settings
from engramql.sources import ingest
from engramql.sources.store import SnapshotStore
from engramql.storage import cut, shared_dir


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def prepared_episodes(raw: DataFrame, now_ms: int, lateness: str = "1 day", cfg: Settings = DEFAULT) -> DataFrame:
    """Incoming records redacted, scored and capped; repeats within the lateness are dropped by key.

    Records without an external id keep their own id as key, so none is lost.
    """
    rows = ingest.prepare(raw, now_ms, cfg)
    key = F.when(F.col("external_id").isNotNull(), F.concat_ws("|", "source", "external_id")).otherwise(F.concat(F.lit("id|"), F.col("id")))
    timed = rows.withColumn("at", F.timestamp_millis("ts")).withColumn("key", key)
    return timed.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["key"]).drop("key", "at")


def append_batches(stream: DataFrame, store: SnapshotStore, table: str = "episode"):
    """A writer that appends each micro-batch to a stored table: repeats of stored rows are left out.

    Only the batch is written, never the table.  A batch that runs again after a failure adds nothing, since its rows are stored already.
    """

    def write(batch: DataFrame, number: int) -> None:
        stored = store.read(table)
        fresh = cut(ingest.new_rows(batch, stored), "batch")
        if stored is None or not fresh.isEmpty():
            store.append(table, fresh)

    return stream.writeStream.foreachBatch(write)


def hourly_events(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """(hour, event_type, n, magnitude) per tumbling hour; late rows within the lateness count."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("magnitude"))


def rolling_day(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Counts of the last 24 hours, every 6 hours."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "24 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))


def user_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """Sessions of a user by gaps."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def echo_stream(others: DataFrame, inferred: DataFrame, window: str = "24 hours") -> DataFrame:
    """Pairs of a message and an inferred one of the same text digest up to ``window`` before it (stream-stream interval join)."""
    a = others.withWatermark("at", window).select("id", "at", "digest")
    b = inferred.withWatermark("at", window).select(F.col("id").alias("echo_of"), F.col("at").alias("echo_at"), F.col("digest").alias("echo_digest"))
    return a.join(b, F.expr(f"digest = echo_digest AND echo_at <= at AND echo_at >= at - INTERVAL {window}"))


def contradiction_counts(claims: DataFrame, needed: int = DEFAULT.contradiction_sessions) -> DataFrame:
    """(node_id, sessions, forced): per node the distinct sessions that contradict it; forced once there are enough.

    State per node holds at most ``needed`` session ids and is emptied when the
    contradiction is forced, so it stays small for any number of claims.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(filter(None, state.get[0].split("\n"))) if state.exists else set()
        forced = False
        for f in frames:
            for s in f.sort_values(["ts", "session_id"])["session_id"]:
                if s and len(seen) < needed:
                    seen.add(s)
                if len(seen) >= needed:
                    forced, seen = True, set()
        state.update(("\n".join(sorted(seen)),))
        yield pd.DataFrame([(key[0], len(seen), forced)], columns=["node_id", "sessions", "forced"])

    return claims.where("origin <> 'inferred'").groupBy("node_id").applyInPandasWithState(update, "node_id string, sessions int, forced boolean", "sessions string", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Drive a stream over what is there and give its result as a table in the shared folder.

    Batches are written by their number, a repeated one over itself; in
    complete mode the last batch is the result, else all of them together.
    """
    spark = stream.sparkSession
    home = f"{shared_dir(spark)}/stream_{uuid.uuid4().hex}"
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/batch={number}")
        last[:] = [number]

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if not last:
        return spark.createDataFrame([], stream.schema)
    rows = f"{home}/rows/batch={last[0]}" if mode == "complete" else f"{home}/rows/batch=*"
    return spark.read.schema(stream.schema).parquet(rows)
