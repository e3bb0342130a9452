"""Transcripts: records of varying JSON shape to events, events to scrubbed projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import path_is_sensitive, scrub
from ..values import ASSISTANT_AUTHOR, USER_AUTHOR

EXCLUDED = ("system_prompt", "harness")
#: event type -> kind of entry
_DIALOGUE = {"user": "dialogue.user", "assistant_text": "dialogue.assistant"}
_TASKS = {"task_created": "task.created", "task_completed": "task.completed"}
TYPES = (*EXCLUDED, *_DIALOGUE, "assistant_thinking", "tool_use", *_TASKS)
FIELDS = ("author", "tool_name", "tool_input", "tool_response", "description", "task_id")


def events_of(rows: DataFrame) -> DataFrame:
    """Events with all columns; the missing ones are null."""
    missing = [F.lit(None).cast("string").alias(c) for c in FIELDS if c not in rows.columns]
    return rows.select("session_id", "seq", "type", "text", *[c for c in FIELDS if c in rows.columns], *missing)


def stated_intent() -> Column:
    return F.concat_ws(" — ", F.nullif("description", F.lit("")), F.nullif("text", F.lit("")))


def project(events: DataFrame, user: str = USER_AUTHOR, assistant: str = ASSISTANT_AUTHOR) -> DataFrame:
    """(session_id, seq, projection, kind, content, meta): what is kept of each event in each projection.

    user, assistant: the names of the two authors.

    One pass, each event fans out to none, one or two scrubbed entries. Thinking is never in the
    memory projection; tools keep their output in the flight recorder and their intent in memory.
    """
    text = scrub(F.col("text"))
    none = F.lit(None).cast("map<string,string>")

    def entry(projection: str, kind: Column, content: Column, meta: Column) -> Column:
        return F.struct(F.lit(projection).alias("projection"), kind.alias("kind"), content.alias("content"), meta.alias("meta"))

    def both(kind: Column, content: Column, meta: Column) -> Column:
        return F.array(entry("flight_recorder", kind, content, meta), entry("memory_grade", kind, content, meta))

    def say(values: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for k, x in values.items():
            out = F.when(F.col("type") == k, F.lit(x)).otherwise(out)
        return out

    kind = say(_DIALOGUE | _TASKS)
    author = F.create_map(F.lit("author"), say({"user": user, "assistant_text": assistant}))
    intent = scrub(stated_intent())
    tool = F.create_map(
        F.lit("tool_name"), F.col("tool_name"), F.lit("stated_intent"), intent,
        F.lit("sensitive_surface"), path_is_sensitive(F.col("tool_input")).cast("string"),
    )
    entries = F.when(F.col("type").isin(*_DIALOGUE), both(kind, text, author)).when(
        F.col("type").isin(*_TASKS), both(kind, text, F.create_map(F.lit("task_id"), F.col("task_id")))
    ).when(
        F.col("type") == "assistant_thinking",
        F.array(entry("flight_recorder", F.lit("thinking"), text, F.create_map(F.lit("author"), F.lit(assistant), F.lit("truth"), F.lit("false")))),
    ).when(
        F.col("type") == "tool_use",
        F.array(
            entry("flight_recorder", F.lit("action"), scrub(F.col("tool_response")), F.map_concat(tool, F.create_map(F.lit("tool_input"), scrub(F.col("tool_input"))))),
            entry("memory_grade", F.lit("action"), intent, tool),
        ),
    ).otherwise(F.array(entry("", F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce("type", F.lit("null")))).cast("string"), F.lit(""), none)))
    return events.where(~F.coalesce(F.col("type").isin(*EXCLUDED), F.lit(False))).select("session_id", "seq", F.inline(entries))


def memory_text(projected: DataFrame, projection: str = "memory_grade") -> DataFrame:
    """(session_id, text): the non-empty contents of a session's projection, in order."""
    rows = projected.where((F.col("projection") == projection) & (F.col("content") != ""))
    lists = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("l"))
    return lists.select("session_id", F.array_join(F.transform("l", lambda x: x["content"]), "\n").alias("text"))


def provisional_summary(events: DataFrame) -> DataFrame:
    """The last assistant text, else the last user text, else nothing."""
    def last(kind: str) -> Column:
        mine = F.col("type") == kind
        return F.max_by(F.when(mine, F.col("text")), F.when(mine, F.col("seq")))

    lasts = events.groupBy("session_id").agg(last("assistant_text").alias("a"), last("user").alias("u"))
    return lasts.select("session_id", F.coalesce(F.nullif("a", F.lit("")), "u", F.lit("")).alias("summary"))


def session_spans(records: DataFrame) -> DataFrame:
    """First and last time of each session, as written and as instants; what can't be read as one is left out."""
    at = F.col("timestamp").try_cast("timestamp")
    return records.withColumn("_t", at).groupBy("session_id").agg(
        F.min_by("timestamp", "_t").alias("start_raw"), F.max_by("timestamp", "_t").alias("end_raw"),
        F.min("_t").alias("start_ts"), F.max("_t").alias("end_ts"), F.count(F.lit(1)).alias("n_records"),
    )


# ---- records of varying shape, as VARIANT


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _blocks(content: Column) -> Column:
    """The elements of an array content, as variants; empty for other content."""
    is_array = F.coalesce(_kind(content).startswith("ARRAY"), F.lit(False))
    return F.when(is_array, F.try_variant_get(content, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))


def content_text(content: Column) -> Column:
    """A string as it is; of a list the texts of its text blocks and bare strings, by lines; else empty."""
    def text(b: Column) -> Column:
        return F.when(_kind(b) == "STRING", F.try_variant_get(b, "$", "string")).when(
            F.try_variant_get(b, "$.type", "string") == "text", F.try_variant_get(b, "$.text", "string")
        )

    parts = F.filter(F.transform(_blocks(content), text), lambda t: t.isNotNull() & (t != ""))
    return F.when(_kind(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.coalesce(F.array_join(parts, "\n"), F.lit("")))


def transcript_events(records: DataFrame) -> DataFrame:
    """records (session_id, pos, v VARIANT) to events (session_id, pos, block, type, text, tool_*..), in order.

    Tool calls meet their results by id inside the session, the last result wins; a call without
    one has an empty response. Records of results only make no event of their own.
    """
    content = F.try_variant_get("v", "$.message.content", "variant")
    rows = records.select("session_id", "pos", F.try_variant_get("v", "$.type", "string").alias("kind"), content.alias("content"), "v")
    blocks = rows.select("session_id", "pos", "kind", F.posexplode(_blocks(F.col("content"))).alias("block", "b"))
    field = {n: F.try_variant_get("b", f"$.{n}", "string") for n in ("type", "text", "thinking", "id", "name", "tool_use_id")}
    results = blocks.where(field["type"] == "tool_result").select(
        "session_id", field["tool_use_id"].alias("call"), F.struct("pos", "block").alias("at"),
        content_text(F.try_variant_get("b", "$.content", "variant")).alias("response"),
    ).groupBy("session_id", "call").agg(F.max_by("response", "at").alias("response"))
    none = F.lit(None).cast("string")
    said = rows.where(F.col("kind") == "user")
    only_results = F.forall(
        F.filter(_blocks(F.col("content")), lambda b: F.coalesce(_kind(b).startswith("OBJECT"), F.lit(False))),
        lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_result", F.lit(False)),
    )
    is_list = F.coalesce(_kind(F.col("content")).startswith("ARRAY"), F.lit(False))
    users = said.where(~(is_list & only_results)).select(
        "session_id", "pos", F.lit(0).alias("block"), F.lit("user").alias("type"), content_text(F.col("content")).alias("text"),
        none.alias("tool_name"), none.alias("tool_input"), none.alias("call"), none.alias("task_id"),
    )
    whole = rows.where((F.col("kind") == "assistant") & ~is_list).select(
        "session_id", "pos", F.lit(0).alias("block"), F.lit("assistant_text").alias("type"), content_text(F.col("content")).alias("text"),
        none.alias("tool_name"), none.alias("tool_input"), none.alias("call"), none.alias("task_id"),
    )
    spoken = blocks.where((F.col("kind") == "assistant") & field["type"].isin("text", "thinking", "tool_use")).select(
        "session_id", "pos", "block",
        F.when(field["type"] == "text", "assistant_text").when(field["type"] == "thinking", "assistant_thinking").otherwise("tool_use").alias("type"),
        F.when(field["type"] == "text", field["text"]).when(field["type"] == "thinking", field["thinking"]).alias("text"),
        F.when(field["type"] == "tool_use", field["name"]).alias("tool_name"),
        F.when(field["type"] == "tool_use", F.coalesce(F.to_json(F.try_variant_get("b", "$.input", "variant")), F.lit("{}"))).alias("tool_input"),
        F.when(field["type"] == "tool_use", field["id"]).alias("call"), none.alias("task_id"),
    )
    forwarded = rows.where(F.col("kind").isin("task_created", "task_completed")).select(
        "session_id", "pos", F.lit(0).alias("block"), F.col("kind").alias("type"), F.try_variant_get("v", "$.text", "string").alias("text"),
        none.alias("tool_name"), none.alias("tool_input"), none.alias("call"), F.try_variant_get("v", "$.task_id", "string").alias("task_id"),
    )
    events = users.unionByName(whole).unionByName(spoken).unionByName(forwarded)
    blank = ~F.coalesce("text", F.lit("")).rlike(r"(?U)\S")
    events = events.where((F.col("type") == "tool_use") | (F.col("type").isin(*_TASKS)) | ~blank)
    joined = events.join(results, ["session_id", "call"], "left")
    response = F.when(F.col("type") == "tool_use", F.coalesce("response", F.lit("")))
    return joined.select("session_id", "pos", "block", "type", "text", "tool_name", "tool_input", response.alias("tool_response"), "task_id")


def numbered(events: DataFrame) -> DataFrame:
    """Events with seq, their place in the session."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("pos", "block")).cast("long") - 1)
