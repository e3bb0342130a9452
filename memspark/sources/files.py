"""Readers and writers of the engine's files: JSON lines, episodes, partitioned logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import scrub, scrub_matches
from ..operators.ledger import latest
from ..values import ACTIONS, TASK_EVENTS

HEADER = "episode_id string, ts string, session_id string, speakers array<string>, redactions array<struct<kind:string,fingerprint:string,via:string>>"


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], recursive: bool = True) -> DataFrame:
    """(path, pos, v VARIANT): each line that is a JSON object, in the order of the file.

    Blank, malformed and non-object lines are left out, but count as places. Files of any size are split;
    a line's place is its distance from the first line of its split, after the lines of the splits before.
    """
    raw = (
        spark.read.option("pathGlobFilter", "*.jsonl").text(paths, lineSep="\n", recursiveFileLookup=recursive)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("line"))
    )
    splits = raw.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a row for each split
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = raw.join(splits, ["path", "_block"]).select("path", (F.col("_before") + F.col("_id") - F.col("_first")).alias("pos"), "line")
    return parse_lines(placed.where(F.col("line").rlike(r"\S")))


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines (.., line) with v VARIANT in its place; only JSON objects stay."""
    parsed = lines.withColumn("v", F.try_parse_json("line")).drop("line")
    return parsed.where(F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))


def session_of(path: Column) -> Column:
    """The file's stem."""
    return F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)


def newest(files: DataFrame) -> DataFrame:
    """(folder, path): the file of each folder that was changed last, from (path, modified)."""
    return files.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSON file that is a list or has a list `events`; anything else is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    listed = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.try_variant_get("v", "$.events", "array<variant>"))
    checked = F.coalesce(listed, F.raise_error(F.lit("a list of events is needed")).cast("array<variant>"))
    return whole.select(F.posexplode(checked).alias("seq", "v"))


def append_log(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Append to a Parquet log, partitioned; one commit, nothing is rewritten."""
    rows.write.mode("append").partitionBy(*by).parquet(path)


def append_wal(rows: DataFrame, path: str) -> None:
    """Lines (record, ts, session_id, text), scrubbed on the way in; blank ones are left out."""
    clean = rows.withColumn("text", scrub(F.col("text"))).where(F.col("text").rlike(r"\S"))
    append_log(clean.withColumn("date", F.to_date("ts")), path, ["record", "date"])


def read_wal(spark: SparkSession, path: str, record: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Lines of a record; only the folders of the days asked for are listed."""
    rows = spark.read.parquet(path).where(F.col("record") == record)
    if first_day:
        rows = rows.where(F.col("date") >= F.lit(first_day).cast("date"))
    return rows.where(F.col("date") <= F.lit(last_day).cast("date")) if last_day else rows


def append_journal(rows: DataFrame, path: str) -> None:
    """Journal rows; an action that is not legal fails the whole append."""
    checked = F.when(F.col("action").isin(*ACTIONS), F.col("action")).otherwise(
        F.raise_error(F.concat(F.lit("illegal action: "), F.coalesce("action", F.lit("null")))).cast("string")
    )
    append_log(rows.withColumn("action", checked).withColumn("date", F.to_date("ts")), path, ["date"])


def append_edges(rows: DataFrame, path: str) -> None:
    """Versions of edges (edge_id, version, ..): a change is one more row, nothing is rewritten."""
    rows.write.mode("append").parquet(path)


def read_edges(spark: SparkSession, path: str, known_at: Column | None = None) -> DataFrame:
    """The edges as they are now, or as they were known at an instant (by created_at)."""
    rows = spark.read.parquet(path)
    rows = rows if known_at is None else rows.where(F.col("created_at") <= known_at)
    return latest(rows, "edge_id")


def append_task_events(rows: DataFrame, path: str) -> None:
    """Task events with their ordinals; an unknown event fails the whole append."""
    checked = F.when(F.col("event").isin(*TASK_EVENTS), F.col("event")).otherwise(
        F.raise_error(F.concat(F.lit("unknown task event: "), F.coalesce("event", F.lit("null")))).cast("string")
    )
    rows.withColumn("event", checked).write.mode("append").parquet(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    append_log(rows.withColumn("month", F.date_format("ts", "yyyy-MM")), path, ["month"])


def write_episodes(rows: DataFrame, path: str) -> None:
    """Episodes (header STRUCT, body) as text: the header's JSON with what was hidden, a blank line, the scrubbed body;
    one file each."""
    hidden = F.transform(scrub_matches(F.col("body")), lambda m: F.struct(m["kind"].alias("kind"), F.lit("").alias("fingerprint"), m["via"].alias("via")))
    header = F.col("header").withField("redactions", hidden)
    text = F.concat(F.to_json(header), F.lit("\n\n"), scrub(F.col("body")))
    rows.select(F.col("header.episode_id").alias("episode"), text.alias("value")).repartition("episode").write.mode("append").partitionBy("episode").text(path)


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """(header STRUCT, body)."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    parts = F.split("value", "\n", 3)
    return whole.select(F.from_json(parts[0], HEADER).alias("header"), F.get(parts, F.lit(2)).alias("body"))


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """(ts, episode_id, section, text, hint): what add_comments wrote; lines that are no comments are left out."""
    rows = spark.read.schema("ts string, episode_id string, section string, text string, hint string").json(path)
    return rows.where("episode_id is not null")


def write_capture(projected: DataFrame, path: str) -> None:
    """Both projections of captured events as JSON lines, a folder each, in order inside a session."""
    for name in ("flight_recorder", "memory_grade"):
        rows = projected.where(F.col("projection") == name).drop("projection")
        rows.repartition("session_id").sortWithinPartitions("session_id", "seq").write.mode("overwrite").json(f"{path}/{name}")


def add_comments(rows: DataFrame, path: str) -> None:
    rows.withColumn("text", scrub(F.col("text"))).write.mode("append").json(path)
