"""The ledger of saved moments: reads, states, ids, cursors, the extraction queue and its health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..values import DEADMAN_HOURS, DRAIN_WINDOW


def read_since(ledger: DataFrame, instant: Column) -> DataFrame:
    """Entries at or after an instant; also prunes month partitions where the table has them."""
    rows = ledger.where(F.col("ts") >= instant)
    if "month" in ledger.columns:
        rows = rows.where(F.col("month") >= F.date_format(instant, "yyyy-MM"))
    return rows


def latest(versions: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The current state of an append-only version log."""
    newest = Window.partitionBy(key).orderBy(F.col(version).desc())
    return versions.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def update(versions: DataFrame, changes: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The log with one more version for each changed key; unknown keys are errors for the caller to find
    with missing_keys()."""
    now = versions.groupBy(key).agg(F.max(version).alias("_v"))
    rows = changes.drop(version).join(now, key).withColumn(version, F.col("_v") + 1).drop("_v")
    return versions.unionByName(rows.select(*versions.columns))


def missing_keys(versions: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    return changes.join(versions, key, "left_anti").select(key)


def queue_status(ledger: DataFrame) -> DataFrame:
    def n(state: str) -> Column:
        return F.count_if(F.col("extracted") == state)

    return ledger.agg(n("no").alias("queued"), n("in-progress").alias("in_progress"), n("done").alias("done"))


def drain_batch(ledger: DataFrame, window: int = DRAIN_WINDOW) -> DataFrame:
    """The first entries of the queue, oldest first."""
    return ledger.where("extracted = 'no'").orderBy("ts", "entry_id").limit(window)


def to_extract(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries of a batch without edges yet; the others' edges are used again."""
    return batch.join(edges.select(F.col("episode").alias("entry_id")), "entry_id", "left_anti")


def requeue(ledger: DataFrame) -> DataFrame:
    """Entries that were left in progress go back to the queue."""
    state = F.when(F.col("extracted") == "in-progress", "no").otherwise(F.col("extracted"))
    return ledger.withColumn("extracted", state)


def requeue_failed(ledger: DataFrame, processed: DataFrame) -> DataFrame:
    """The ledger when a drain's results were not stored: what it (entry_id) had done goes back to the queue."""
    lost = processed.select(F.col("entry_id").alias("_lost")).distinct()
    back = (F.col("extracted") == "done") & F.col("_lost").isNotNull()
    joined = ledger.join(lost, F.col("entry_id") == F.col("_lost"), "left")
    return joined.withColumn("extracted", F.when(back, "no").otherwise(F.col("extracted"))).drop("_lost")


def reconcile_done(ledger: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries that are done but have no edge."""
    return ledger.where("extracted = 'done'").join(edges.select(F.col("episode").alias("entry_id")), "entry_id", "left_anti")


def deadman(ledger: DataFrame, now: Column, threshold: int = DEADMAN_HOURS) -> DataFrame:
    """Hours since the last entry; stale if there is none or it is too old."""
    last = ledger.agg(F.max("ts").alias("last_ts"))
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / F.lit(3.6e9)
    return last.select("last_ts", hours.alias("age_hours"), F.coalesce(hours >= threshold, F.lit(True)).alias("stale"))


def should_flush(n: Column, hard: Column, window: int = DRAIN_WINDOW) -> Column:
    """Enough entries, or any and a hard trigger or a departure."""
    return (n >= window) | (hard & (n > 0))


def episode_ids(entries: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """entries (ts, tie) with episode_id EP-<date>.<NNNN>, counting on from the ids in use (episode_id)."""
    rows = entries.withColumn("_date", F.date_format("ts", "yyyy-MM-dd"))
    nth = F.row_number().over(Window.partitionBy("_date").orderBy("ts", "tie"))
    rows = rows.withColumn("_nth", nth)
    if used is None:
        base = F.lit(0)
    else:
        pattern = r"^EP-(\d{4}-\d{2}-\d{2})\.(\d{4,})$"
        taken = used.where(F.col("episode_id").rlike(pattern)).select(
            F.regexp_extract("episode_id", pattern, 1).alias("_date"), F.regexp_extract("episode_id", pattern, 2).cast("int").alias("_seq")
        ).groupBy("_date").agg(F.max("_seq").alias("_base"))
        rows = rows.join(taken, "_date", "left")
        base = F.coalesce("_base", F.lit(0))
    seq = base + F.col("_nth")
    written = F.concat(F.lit("EP-"), F.col("_date"), F.lit("."), F.lpad(seq.cast("string"), F.greatest(F.lit(4), F.length(seq.cast("string"))), F.lit("0")))
    return rows.withColumn("episode_id", written).drop("_date", "_nth", "_base")


def session_cursor(ledger: DataFrame) -> DataFrame:
    """How far each session is saved: the largest span end, or ts where there is none."""
    end = F.coalesce(F.nullif("span_end", F.lit("")), F.col("ts"))
    return ledger.groupBy("session_id").agg(F.max(end).alias("cursor"))


def new_material(incoming: DataFrame, cursors: DataFrame) -> DataFrame:
    """Incoming saves (session_id, span_end) that go beyond what is banked."""
    banked = cursors.select(F.col("session_id").alias("_s"), "cursor")
    joined = incoming.join(banked, F.col("session_id") == F.col("_s"), "left")
    return joined.where(F.col("cursor").isNull() | (F.col("span_end") > F.col("cursor"))).drop("_s", "cursor")


def memory_state(ledger: DataFrame, wal: DataFrame, depth: int) -> DataFrame:
    """Sessions to show, whether there is unsaved material, and the line that says so."""
    one = ledger.agg(F.least(F.count_distinct("session_id"), F.lit(depth)).alias("sessions"))
    unsaved = wal.limit(1).agg((F.count(F.lit(1)) > 0).alias("_wal"))
    state = one.crossJoin(unsaved).select("sessions", ((F.col("sessions") == 0) & F.col("_wal")).alias("unsaved"))
    line = F.when(F.col("sessions") > 0, "loaded").when(F.col("unsaved"), "unsaved").otherwise("empty")
    return state.withColumn("state", line)
