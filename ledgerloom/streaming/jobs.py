"""Stateful streams: event-time windows, retried jobs, adaptive cadence, and facts kept current."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR, DAY = 3600.0, 86_400.0


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Counts and sums per key and tumbling window; rows later than ``late`` behind the newest are dropped by the stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(
        F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def run_once(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is available now to Parquet and stop; a restart goes on from the checkpoint.

    ``append`` writes windows once the watermark has passed them; ``update`` writes what each batch changed under the batch's
    number, so a batch that is run again replaces its own rows only; ``latest_rows`` reads the last state of each key.
    """
    if mode == "update":
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/batch={n}")).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_rows(spark: SparkSession, folder: str, schema: str, keys: list[str]) -> DataFrame:
    """The last row written for each key by ``run_once`` in update mode."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(folder)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run ``work`` on each micro-batch of what is available now; used to recompute the entities a batch touches."""
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def backoff(attempts: int) -> float:
    return min(5.0 * 2 ** max(attempts - 1, 0), 300.0)


def in_order(frames: Iterator[pd.DataFrame]) -> list[str]:
    """The outcomes a trigger brings for one key, in order of ``seq`` over all its frames."""
    parts = list(frames)
    return pd.concat(parts).sort_values("seq", kind="stable")["outcome"].tolist() if parts else []


JOB_OUT = "job_id string, attempts int, status string, next_run_after double"


def job_states(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Streaming state of each job over its outcomes (``job_id``, ``outcome``: ok or failed): queued again after a failure
    with doubling delay, failed after ``max_attempts``, succeeded after ok; outcomes after an end change nothing."""
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tries, status = state.get if state.exists else (0, "queued")
        for outcome in in_order(frames):
                if status != "queued":
                    break
                tries += 1
                status = "succeeded" if outcome == "ok" else "failed" if tries >= max_attempts else "queued"
        state.update((tries, status))
        yield pd.DataFrame({"job_id": [key[0]], "attempts": [tries], "status": [status], "next_run_after": [backoff(tries) if status == "queued" and tries else None]})

    return attempts.groupBy("job_id").applyInPandasWithState(step, JOB_OUT, "tries int, status string", "update", GroupStateTimeout.NoTimeout)


def next_interval(seconds: float, outcome: str) -> float:
    """Shorter after new content, at least an hour; longer after none, at most a week."""
    if outcome == "collected":
        return max(HOUR, seconds * 0.6)
    if outcome in ("unchanged", "duplicate"):
        return min(7 * DAY, seconds * 1.6)
    return seconds


CADENCE_OUT = "source_id string, interval_seconds double, fetches bigint, failures bigint"


def cadences(outcomes: DataFrame, start: float = DAY) -> DataFrame:
    """Streaming state of each source's collection interval and counters over its outcomes in order of ``seq``."""
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seconds, fetches, failures = state.get if state.exists else (start, 0, 0)
        for outcome in in_order(frames):
                seconds, fetches = next_interval(seconds, outcome), fetches + 1
                failures = failures + 1 if outcome == "failure" else 0
        state.update((seconds, fetches, failures))
        yield pd.DataFrame({"source_id": [key[0]], "interval_seconds": [seconds], "fetches": [fetches], "failures": [failures]})

    return outcomes.groupBy("source_id").applyInPandasWithState(step, CADENCE_OUT, "seconds double, fetches bigint, failures bigint", "update", GroupStateTimeout.NoTimeout)


def stream_of(spark: SparkSession, path: str, schema, files_per_batch: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
