"""Structured Streaming jobs over the logs. Each has a batch twin in ``operators.logs``; results equal it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plotcheck.operators import logs
from plotcheck.sources.files import LOG


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def ingest_contributions(spark: SparkSession, source: str, accepted: str, refused: str, checkpoint: str) -> StreamingQuery:
    """Clean contributions to a log and the others with their reason beside it; a batch that runs again writes its own folder anew."""

    def both(batch: DataFrame, batch_id: int) -> None:
        ok, bad = logs.clean_contribution(batch)
        ok.write.mode("overwrite").json(f"{accepted}/batch={batch_id}")
        bad.write.mode("overwrite").json(f"{refused}/batch={batch_id}")

    stream = spark.readStream.schema(LOG).json(source)
    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_contributions(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each id once; state of ids older than ``delay`` is dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def _without(log: DataFrame, asked: str, schema: str, batch_id: int, key: str) -> DataFrame:
    """``log`` without the keys of all batches up to this one, each of which has its own folder under ``asked``."""
    gone = log.sparkSession.read.schema(f"{schema}, batch long").json(asked).filter(F.col("batch") <= batch_id)
    return log.join(gone.select(key).distinct(), key, "left_anti")


def erase_requests(stream: DataFrame, spark: SparkSession, log: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """For each batch of erase requests (id) write the log, as it is then, without the ids of this and all batches before to ``target``/kept/<batch>.

    The requests are kept under ``target``/asked; a batch that runs again writes the same.
    """

    def rewrite(batch: DataFrame, batch_id: int) -> None:
        batch.select("id").distinct().write.mode("overwrite").json(f"{target}/asked/batch={batch_id}")
        kept = _without(spark.read.schema(schema).json(log), f"{target}/asked", "id string", batch_id, "id")
        kept.write.mode("overwrite").json(f"{target}/kept/{batch_id}")

    return stream.writeStream.foreachBatch(rewrite).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def revoke_and_purge(stream: DataFrame, spark: SparkSession, answers: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """For each batch of revocations (link) write the answers without those of links revoked so far to ``target``/kept/<batch>."""

    def rewrite(batch: DataFrame, batch_id: int) -> None:
        batch.select("link").distinct().write.mode("overwrite").json(f"{target}/asked/batch={batch_id}")
        kept = _without(spark.read.schema(schema).json(answers), f"{target}/asked", "link long", batch_id, "link")
        kept.write.mode("overwrite").json(f"{target}/kept/{batch_id}")

    return stream.writeStream.foreachBatch(rewrite).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retention(stream: DataFrame, now: str, days: int = 400) -> DataFrame:
    """Answers not older than ``days`` at the time ``now``; keeps no state."""
    return logs.retention(stream, now, days)


def prepare_windows(stream: DataFrame, ready: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(client, wx, wy, far, ts): windows round each request (client, wx, wy, ts) that are not ready, each once for a client within ``delay``."""
    wanted = logs.windows_around(stream.withWatermark("ts", delay), "ts").join(ready, ["wx", "wy"], "left_anti")
    return wanted.dropDuplicatesWithinWatermark(["client", "wx", "wy"])


def limit_requests(stream: DataFrame, seconds: int = 60, most: int = 30, idle: int | None = None) -> DataFrame:
    """Every request with its client's window and whether it is refused, as ``logs.limit_requests``.

    State is one window a client (start, requests so far), dropped once the watermark, ``idle`` seconds behind the latest request
    (twice the window, if not given), has passed it. Requests of a client are taken in order within a batch, and batches as they
    come; what comes later than the watermark is dropped.
    """
    kind = dict(stream.dtypes)
    idle = idle or 2 * seconds

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(batches)).sort_values(["at", "event_id"])
        start, n = state.get if state.exists else (None, 0)
        starts, numbers = [], []
        for at in new["at"].tolist():
            start, n = logs.next_in_window(start, n, at, seconds * 1_000_000)
            starts.append(start)
            numbers.append(n)
        state.update((start, n))
        state.setTimeoutTimestamp(int(new["at"].max() // 1000) + 1000 * idle)
        yield pd.DataFrame({"client": key[0], "event_id": new["event_id"].to_numpy(), "at": new["at"].to_numpy(), "from": starts, "nth": numbers})

    rows = stream.filter("ts IS NOT NULL").withWatermark("ts", f"{idle} seconds").select("client", "event_id", "ts", F.unix_micros("ts").alias("at"))
    schema = f"client {kind['client']}, event_id {kind['event_id']}, at long, from long, nth long"
    out = rows.groupBy("client").applyInPandasWithState(decide, schema, "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("client", "event_id", F.timestamp_micros("at").alias("ts"), F.timestamp_micros("from").alias("start"), "nth", (F.col("nth") > most).alias("refused"))


def accept_answers(stream: DataFrame, revocations: DataFrame, delay: str = "14 hours") -> DataFrame:
    """Answers (with ts) against the static revocations; those later than the watermark are late data to what follows."""
    return logs.accept_answers(stream.withWatermark("ts", delay), revocations, keep=("ts",))


def answers_by_link(stream: DataFrame, delay: str = "14 hours") -> DataFrame:
    """Counts of each link and day; days that the watermark has passed leave the state. ``logs.sum_days`` gives those of a link."""
    day = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "link")
    return day.agg(*logs.answer_counts()).select("link", F.col("w.start").alias("day"), "n", "fits", "first", "last")


def activity(stream: DataFrame, kind: str = "tumbling", delay: str = "1 hour") -> DataFrame:
    """Counts of each action in tumbling hours, or in sliding ones, or of each client in sessions: as ``logs.activity_windows``."""
    return logs.activity(stream.withWatermark("ts", delay), kind)


def to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what is there into an in-memory table, for tests and reports."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
