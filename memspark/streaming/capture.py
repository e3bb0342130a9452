"""Streams of transcript snapshots, WAL lines and events.

Exactly-once by checkpoint plus writes that are keyed by batch: a batch that is replayed after a
crash overwrites what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import scrub
from ..values import DRAIN_WINDOW


def new_records(snapshots: DataFrame) -> DataFrame:
    """From growing snapshots (session_id, snapshot, seq, text): what each adds to its session.

    State is one number per session. A snapshot shorter than what was captured is taken whole:
    material may come twice, none is lost.
    """
    def advance(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames), ignore_index=True)
        out = []
        for _, shot in rows.sort_values(["snapshot", "seq"]).groupby("snapshot", sort=True):
            start = 0 if len(shot) < seen else seen
            out.append(shot[shot["seq"] >= start])
            seen = len(shot)
        state.update((seen,))
        yield pd.concat(out, ignore_index=True)[["session_id", "snapshot", "seq", "text"]]

    return snapshots.groupBy("session_id").applyInPandasWithState(
        advance, "session_id long, snapshot long, seq long, text string", "captured long", "append", GroupStateTimeout.NoTimeout
    )


def first_only(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once, however often its event is sent again within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def day_counts(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """Lines per record and day (tumbling windows in event time)."""
    day = F.window("ts", "1 day")
    counted = lines.withWatermark("ts", late).groupBy(day.alias("w"), "record").agg(F.count(F.lit(1)).alias("n_lines"))
    return counted.select(F.to_date("w.start").alias("date"), "record", "n_lines")


def activity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows of a user's events: an extension for event tables."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n_events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def silence(events: DataFrame, hours: int) -> DataFrame:
    """(source, last_ts): sources of which nothing has come for so long in event time, by a timer on their state."""
    def watch(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"source": [key[0]], "last_us": [last]})
            return
        last = state.get[0] if state.exists else 0
        for f in frames:
            last = max(last, int(f["us"].max()))
        state.update((last,))
        due = last // 1000 + hours * 3_600_000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    marked = events.withWatermark("ts", "0 seconds").select("source", "ts", F.unix_micros("ts").alias("us"))
    out = marked.groupBy("source").applyInPandasWithState(watch, "source string, last_us long", "last_us long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("source", F.timestamp_micros("last_us").alias("last_ts"))


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for WAL lines: scrubbed, in a folder of the batch that a replay overwrites."""
    def write(batch: DataFrame, batch_id: int) -> None:
        clean = batch.withColumn("text", scrub(F.col("text"))).where(F.col("text").rlike(r"\S"))
        clean.withColumn("date", F.to_date("ts")).write.mode("overwrite").partitionBy("record", "date").parquet(f"{path}/batch={batch_id}")

    return write


def drain(extract: Callable[[DataFrame], DataFrame], path: str, window: int = DRAIN_WINDOW) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch's queued entries join the queue, and the first `window` of the whole queue are
    extracted. What is left waits for the next batch, or for drain_rest()."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.where("extracted = 'no'").write.mode("overwrite").parquet(f"{path}/queue/batch={batch_id}")
        _drain_once(batch.sparkSession, extract, path, window, batch_id)

    return write


def backlog(spark: SparkSession, path: str, but: int | None = None) -> DataFrame:
    """Queued entries that no batch has extracted; but: a batch that is taken again."""
    done = spark.read.parquet(f"{path}/done")
    done = done if but is None else done.where(F.col("batch") != but)
    return spark.read.parquet(f"{path}/queue").drop("batch").dropDuplicates(["entry_id"]).join(done.select("entry_id"), "entry_id", "left_anti")


def _drain_once(spark: SparkSession, extract: Callable[[DataFrame], DataFrame], path: str, window: int, batch_id: int) -> None:
    mine = f"{path}/done/batch={batch_id}"
    spark.read.parquet(f"{path}/queue").select("entry_id").limit(0).write.mode("ignore").parquet(mine)  # so that the folder can be read
    first = backlog(spark, path, but=batch_id).orderBy("ts", "entry_id").limit(window)
    extract(first).write.mode("overwrite").parquet(f"{path}/edges/batch={batch_id}")
    # the limit is taken anew, to the same rows: nothing else has changed; done is written last
    rows = spark.createDataFrame(first.select("entry_id").collect(), first.select("entry_id").schema)  # `window` rows
    rows.write.mode("overwrite").parquet(mine)


def drain_rest(spark: SparkSession, extract: Callable[[DataFrame], DataFrame], path: str, window: int = DRAIN_WINDOW) -> int:
    """Drain until the queue is empty; returns the number of passes. A stopped stream leaves no backlog behind."""
    last = spark.read.parquet(f"{path}/done").agg(F.max("batch")).first()[0]
    passes = 0
    while not backlog(spark, path).isEmpty():
        passes += 1
        _drain_once(spark, extract, path, window, int(last) + passes)
    return passes


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Take all that is there, in batches, then stop. A crash resumes from the checkpoint."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()


def run_forever(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], seconds: int = 10):
    """Poll; returns the running query."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(processingTime=f"{seconds} seconds").start()
