"""Saving: what sessions bring becomes log lines, annotations or episodes, for many sessions at once.

Every function returns the rows to append; nothing is written here. Requests and hooks are one row
per session and batch. Events are (session_id, pos, type, text, ..) with the position of their
record, counts are (session_id, n) records per session; captured is how many records of a session
were taken before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import scrub, scrub_matches
from ..operators import ledger as ledgers
from ..operators import links, transcript

SAVING_EVENTS = ("Stop", "SessionEnd", "PreCompact")


def span_cursor(ledger: DataFrame) -> DataFrame:
    """(session_id, cursor): how far each session is banked."""
    return ledger.groupBy("session_id").agg(F.max(F.coalesce("span_end", "ts")).alias("cursor"))


def fresh_events(events: DataFrame, counts: DataFrame, captured: DataFrame) -> DataFrame:
    """Events of records that were not taken before; all of a session that has shrunk."""
    seen = counts.join(captured, "session_id", "left").select(
        "session_id", F.when(F.col("n") < F.coalesce("captured", F.lit(0)), 0).otherwise(F.coalesce("captured", F.lit(0))).alias("_from"))
    return events.join(seen, "session_id").where(F.col("pos") >= F.col("_from")).drop("_from")


def log_lines(asked: DataFrame, events: DataFrame) -> DataFrame:
    """(record, ts, span_start, span_end, session_id, text): one line of each projection for every asked session
    (session_id, now, cursor) whose memory text is not blank."""
    projected = transcript.project(transcript.events_of(events.withColumnRenamed("pos", "seq")))
    memory = transcript.memory_text(projected).where(F.col("text").rlike(r"(?U)\S"))
    flight = transcript.memory_text(projected, "flight_recorder")
    texts = memory.select("session_id", F.lit("memory-grade").alias("record"), "text").unionByName(
        flight.join(memory.select("session_id"), "session_id", "left_semi").select("session_id", F.lit("flight-recorder").alias("record"), "text"))
    return asked.join(texts, "session_id").select("record", F.col("now").alias("ts"), F.col("cursor").alias("span_start"), F.col("now").alias("span_end"), "session_id", "text")


def _entries(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """New ledger entries of rows (session_id, now, jot, span_start, annotation), with ids and the entry before."""
    rows = rows.select("session_id", F.col("now").alias("ts"), scrub(F.col("jot")).alias("summary"), "span_start", "annotation", F.col("session_id").alias("tie"))
    used = ledger.select(F.col("entry_id").alias("episode_id"))
    named = ledgers.episode_ids(rows, used).withColumnRenamed("episode_id", "entry_id")
    named = named.withColumn("episode_id", F.when(F.col("annotation"), "").otherwise(F.col("entry_id")))
    prior = links.prior_of(ledger.select("entry_id", "session_id", "ts"), named.select("entry_id", "session_id", "ts"))
    return named.join(prior, "entry_id", "left").select(
        "entry_id", "session_id", "ts", "summary", "episode_id", "span_start", F.col("ts").alias("span_end"), "annotation", F.lit("no").alias("extracted"), "prev")


def save_moments(requests: DataFrame, events: DataFrame, counts: DataFrame, captured: DataFrame, ledger: DataFrame) -> dict[str, DataFrame]:
    """Sessions saved by name: requests (session_id, now, note). New records go to the logs, and each session that has
    any record gets an annotation from where it was banked to now, whether or not something is new."""
    asked = requests.join(counts, "session_id").join(span_cursor(ledger), "session_id", "left")
    rows = asked.select("session_id", "now", F.col("note").alias("jot"), F.col("cursor").alias("span_start"), F.lit(True).alias("annotation"))
    return {
        "lines": log_lines(asked, fresh_events(events, counts, captured)), "entries": _entries(rows, ledger),
        "captured": asked.select("session_id", F.col("n").alias("captured")),
    }


def save_tools(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Annotations of requests (session_id, now, jot), transcripts or not."""
    asked = requests.join(span_cursor(ledger), "session_id", "left")
    return _entries(asked.select("session_id", "now", "jot", F.col("cursor").alias("span_start"), F.lit(True).alias("annotation")), ledger)


def dispatch(hooks: DataFrame, events: DataFrame, counts: DataFrame, captured: DataFrame, ledger: DataFrame) -> dict[str, DataFrame]:
    """What session hooks (session_id, event, now, wal, annotate, cursor_delta) lead to.

    wal without annotate: new records go to the logs, no entry. wal with annotate: the whole transcript
    goes to the logs and an annotation to the ledger, unless its memory text is blank. Without wal: an
    episode with its entry; with cursor_delta it is skipped when the session is banked up to now.
    PreCompact never skips by the cursor and has the diary made anew after an episode. Other events
    save nothing.
    """
    asked = hooks.where(F.col("event").isin(*SAVING_EVENTS)).join(span_cursor(ledger), "session_id", "left")
    whole = transcript.project(transcript.events_of(events.withColumnRenamed("pos", "seq")))
    memory = transcript.memory_text(whole).withColumnRenamed("text", "_memory")
    jots = transcript.provisional_summary(events.withColumnRenamed("pos", "seq"))
    rows = asked.join(memory, "session_id", "left").join(jots, "session_id", "left")
    rows = rows.withColumn("_memory", F.coalesce("_memory", F.lit(""))).withColumn("jot", F.coalesce("summary", F.lit(""))).drop("summary")
    stop = F.col("event") != "PreCompact"
    banked = stop & F.col("cursor_delta") & F.coalesce(F.col("now") <= F.col("cursor"), F.lit(False))
    way = (
        F.when(F.col("wal") & ~F.col("annotate"), "append").when(F.col("wal"), F.when(F.col("_memory").rlike(r"(?U)\S"), "annotate").otherwise("skip"))
        .when(banked, "skip").otherwise("episode")
    )
    rows = rows.withColumn("way", way)
    saved = rows.where("way in ('annotate', 'episode')").withColumn("annotation", F.col("way") == "annotate")
    # episodes carry no span: their records' times are not read here
    start = F.when(F.col("annotation"), F.col("cursor"))
    entries = _entries(saved.select("session_id", "now", "jot", start.alias("span_start"), "annotation"), ledger)
    bodies = saved.where("way = 'episode'").join(entries.select("entry_id", "session_id"), "session_id").select(
        "entry_id", "session_id", F.col("now").alias("captured_at"), scrub(F.col("_memory")).alias("body"), scrub_matches(F.col("_memory")).alias("redactions"))
    appended = rows.where("way = 'append'")
    lines = log_lines(appended, fresh_events(events, counts, captured)).unionByName(log_lines(rows.where("way = 'annotate'"), events))
    outcome = rows.join(entries.select("session_id", "entry_id"), "session_id", "left").select(
        "session_id", "event", "way", "entry_id",
        F.when(stop & (F.col("way") == "skip"), "no-new-material").alias("reason"),
        F.when(~stop, F.col("way") == "episode").alias("diary_regenerated"),
    )
    return {
        "outcomes": outcome, "lines": lines, "entries": entries, "episodes": bodies,
        "captured": appended.join(counts, "session_id").select("session_id", F.col("n").alias("captured")),
    }


def confirmation(state: Column, sessions: Column) -> Column:
    """The line that a session starts with, from console.memory_state's (state, sessions); null: the ledger can't be read."""
    return (
        F.when(state == "loaded", F.concat(F.lit("memory loaded, recent sessions: "), sessions.cast("string")))
        .when(state == "unsaved", "captured material is not saved yet").when(state == "empty", "no memories yet").otherwise("memory unavailable")
    )
