"""Tasks from an append-only event log: ids, states, urgency, ranking, capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..values import URGENCY_DAYS
from .order import with_ordinal

_DAY = 86_400_000_000


def with_ordinals(events: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Task events (ts, task_id, event) with the ordinals that follow the log's, in the order of their time."""
    rows = with_ordinal(events.drop("ordinal"), F.date_trunc("hour", F.col("ts")), [F.col("ts"), F.col("task_id"), F.col("event")], "ordinal")
    if log is None:
        return rows
    last = log.agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("_last"))
    return rows.crossJoin(F.broadcast(last)).withColumn("ordinal", F.col("ordinal") + F.col("_last")).drop("_last")


def task_ids(created: DataFrame) -> DataFrame:
    """created (ts, ordinal) with task_id TS-<date>.<n>, n from 0 each day."""
    date = F.date_format("ts", "yyyy-MM-dd")
    nth = F.row_number().over(Window.partitionBy(date).orderBy("ordinal")) - 1
    return created.withColumn("task_id", F.concat(F.lit("TS-"), date, F.lit("."), nth.cast("string")))


def fold(events: DataFrame) -> DataFrame:
    """State of each task from (task_id, ordinal, ts, event, title, due, kind, project), in append order.

    What comes before the first creation is void. One aggregation after one window over the task's
    own events; every kept value is a min_by or max_by.
    """
    first = F.min(F.when(F.col("event") == "task.created", F.col("ordinal"))).over(Window.partitionBy("task_id"))
    rows = events.withColumn("_first", first).where("ordinal >= _first")
    created = F.col("event") == "task.created"
    over = F.col("event").isin("task.done", "task.cancelled")
    dated = (F.col("event") == "task.due_moved") | (created & F.col("due").isNotNull()) | (F.col("ordinal") == F.col("_first"))
    titled = created & (F.coalesce("title", F.lit("")) != "")
    out = rows.groupBy("task_id").agg(
        F.min_by("kind", "ordinal").alias("kind"), F.min_by(F.struct("project"), "ordinal")["project"].alias("project"),
        F.max_by(F.when(titled, F.col("title")), F.when(titled, F.col("ordinal"))).alias("title"),
        F.max_by(F.struct("due"), F.when(dated, F.col("ordinal")))["due"].alias("due"),
        F.max_by(F.when(over, F.replace(F.col("event"), F.lit("task."), F.lit(""))), F.when(over, F.col("ordinal"))).alias("status"),
        F.min_by("ts", "ordinal").alias("created_ts"), F.max_by("ts", "ordinal").alias("last_ts"),
    )
    return out.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("status", F.coalesce("status", F.lit("open")))


def days_until(due: Column, now: Column) -> Column:
    return (F.unix_micros(due.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / F.lit(float(_DAY))


def urgency(status: Column, due: Column, now: Column) -> Column:
    """0 for closed or undated tasks, 2 when overdue, else rising to 1 within the horizon."""
    left = days_until(due, now)
    return F.when((status != "open") | due.isNull(), F.lit(0.0)).when(now > due, F.lit(2.0)).when(
        left >= URGENCY_DAYS, F.lit(0.0)
    ).otherwise(1.0 - left / URGENCY_DAYS)


def effective_status(status: Column, kind: Column, due: Column, now: Column) -> Column:
    """An open commitment that is overdue is broken."""
    late = (status == "open") & (kind == "commitment") & F.coalesce(now > due, F.lit(False))
    return F.when(late, "broken").otherwise(status)


def department(states: DataFrame, now: Column, include_terminal: bool = False) -> DataFrame:
    """states with urgency and effective status, in the order of attention (column place)."""
    rows = states.withColumn("urgency", F.round(urgency(F.col("status"), F.col("due"), now), 6))
    rows = rows.withColumn("effective", effective_status(F.col("status"), F.col("kind"), F.col("due"), now))
    rows = rows if include_terminal else rows.where(F.col("effective").isin("open", "broken"))
    order = [F.col("urgency").desc(), F.col("due").asc_nulls_last(), F.col("task_id")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("department").orderBy(*order))) if "department" in rows.columns else rows


def ranking(states: DataFrame, now: Column, n: int) -> DataFrame:
    """The n tasks that need attention first: a top-k, no global sort."""
    rows = department(states, now)
    return rows.orderBy(F.col("urgency").desc(), F.col("due").asc_nulls_last(), "task_id").limit(n)


def by_project(states: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("project", F.lit("")), F.lit("(none)"))
    return states.groupBy(name.alias("project")).agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.col("status") == "open").alias("n_open"))


def emit_from_capture(captured: DataFrame, log: DataFrame) -> DataFrame:
    """New task events of a capture (session_id, seq, type task_created|task_completed, task_ref, ts): each id
    is created once and done once, completions need an earlier creation, here or in the log."""
    named = captured.withColumn("task_id", F.concat(F.lit("TS-cap-"), F.col("task_ref")))
    created = named.where("type = 'task_created'").groupBy("task_id").agg(F.min(F.struct("seq", "ts")).alias("m")).select("task_id", "m.seq", "m.ts")
    done = named.where("type = 'task_completed'")
    have = log.where("event = 'task.created'").select("task_id").distinct()
    closed = log.where("event = 'task.done'").select("task_id").distinct()
    births = created.join(have, "task_id", "left_anti")
    known = created.select("task_id", F.col("seq").alias("_born")).unionByName(have.select("task_id", F.lit(-1).cast("long").alias("_born"))).groupBy("task_id").agg(F.min("_born").alias("_born"))
    ends = done.join(known, "task_id").where("seq > _born").join(closed, "task_id", "left_anti")
    ends = ends.groupBy("task_id").agg(F.min(F.struct("seq", "ts")).alias("m")).select("task_id", "m.seq", "m.ts")
    return births.select("task_id", "seq", "ts", F.lit("task.created").alias("event")).unionByName(ends.select("task_id", "seq", "ts", F.lit("task.done").alias("event")))
