"""The write-ahead log of captured text: windows, segments, pending sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import scrub
from .recall import BROADCAST_ROWS, small


def segments(wal: DataFrame) -> DataFrame:
    """Lines per record and day."""
    return wal.groupBy("record", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n_lines"))


#: Lines are joined in blocks of 2^level minutes, level 0 to LEVELS (34 hours).
LEVELS = 11


def _minute(df: DataFrame, name: str) -> Column:
    """The number of the minute of a time; it rises with the time, whatever the session's zone."""
    if df.schema[name].dataType.typeName() == "timestamp":
        return F.floor(F.unix_seconds(name) / 60)
    return F.datediff(F.to_date(name), F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour(name) * 60 + F.minute(name)


def _cover(low: str, high: str) -> Column:
    """(level, block) of the fewest blocks that make up the minutes low to high, high exclusive: two of a level at most,
    but for the highest. A level is a step of one small lambda: written out, the levels would be too much code to compile."""
    first, last = f"shiftright({low} + shiftleft(1L, k) - 1, k)", f"shiftright({high}, k)"
    return F.expr(f"""concat(
      filter(flatten(transform(sequence(0, {LEVELS - 1}), k -> array(
        CASE WHEN {first} < {last} AND {first} & 1 = 1 THEN named_struct('level', k, 'block', {first}) END,
        CASE WHEN {first} < {last} AND {last} & 1 = 1 THEN named_struct('level', k, 'block', {last} - 1) END))), x -> x IS NOT NULL),
      transform(CASE WHEN {first.replace("k)", f"{LEVELS})")} < {last.replace("k)", f"{LEVELS})")}
        THEN sequence({first.replace("k)", f"{LEVELS})")}, {last.replace("k)", f"{LEVELS})")} - 1) ELSE array() END, i -> named_struct('level', {LEVELS}, 'block', i)))""")


def window_texts(
    windows: DataFrame, wal: DataFrame, half_open: bool = False, same_session: bool = False, of: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """windows (start_ts, end_ts[, session_id], ..) with the text of the lines inside, both ends included.

    A window's first and last minute are edges, whose lines are looked at one by one; the minutes
    between are made up of blocks of 2^k minutes. A block that some window needs is joined to one text once, so
    a window meets some twenty texts however many lines it holds, and a busy day is many keys.
    Without a start a window reads its last day only. Windows without lines, or inverted ones, get "".

    Windows of the same ends are one class, whose text is made once. of: what is wanted of the text (a digest, a
    length), taken once of each class, so that only it meets the windows.
    """
    start = F.coalesce("start_ts", F.date_trunc("day", "end_ts").cast(windows.schema["end_ts"].dataType))
    own = ["session_id"] if same_session else []
    ends_of = {"_all_day": F.col("start_ts").isNull(), "_from": start, "_to": F.col("end_ts")}
    windows = windows.withColumn("_class", F.struct(*own, *[c.alias(n) for n, c in ends_of.items()]))
    asked = windows.select("_class").distinct().select(F.col("_class").alias("window_id"), "_class.*")
    asked = asked.withColumns({"_low": _minute(asked, "_from"), "_high": _minute(asked, "_to")})
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # classes are dealt out at once, so that their texts, which are long, are put together where they are
    parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.where("_low <= _high").repartition(parts, "window_id")
    lines = wal.select("session_id", F.col("ts").alias("_ts"), "seq", "text")
    lines = lines.withColumn("_m", _minute(lines, "_ts"))
    line = F.struct("_ts", "session_id", "seq", "text")
    joined = F.when(F.exists("_l", lambda x: x["text"].isNotNull()), F.array_join(F.transform("_l", lambda x: x["text"]), "\n"))

    blocks = asked.select("window_id", *own, F.explode(_cover("(_low + 1)", "_high")).alias("_b")).select("window_id", *own, "_b.level", "_b.block")
    key = [*own, "level", "block"]
    needed = small(blocks.select(*key).distinct())
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    inside = lines.withColumn("level", levels).withColumn("block", F.expr("_m div shiftleft(1L, level)")).join(needed, key, "left_semi")
    texts = inside.groupBy(*key).agg(F.array_sort(F.collect_list(line)).alias("_l"), F.count(F.lit(1)).alias("n"))
    texts = texts.select(*key, joined.alias("t"), "n")
    middle = blocks.join(texts, key).select("window_id", F.expr("block * shiftleft(1L, level)").alias("_m"), "t", "n")

    edges = asked.withColumn("_m", F.explode(F.array_distinct(F.array("_low", "_high"))))
    at = lines.join(small(edges.select(*own, "_m").distinct()), [*own, "_m"], "left_semi").groupBy(*own, "_m").agg(F.array_sort(F.collect_list(line)).alias("_l"))
    after = (lambda x: x["_ts"] > F.col("_from")) if half_open else (lambda x: x["_ts"] >= F.col("_from"))
    hit = F.filter("_l", lambda x: (F.col("_all_day") | after(x)) & (x["_ts"] <= F.col("_to")))
    ends = edges.join(at, [*own, "_m"]).withColumn("_l", hit).where("size(_l) > 0")
    ends = ends.select("window_id", "_m", joined.alias("t"), F.size("_l").cast("long").alias("n"))

    whole = middle.unionByName(ends).groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("_m", "t"))).alias("_p"), F.sum("n").alias("n_lines"))
    narrow, of = of is not None, of or (lambda x: x)
    whole = whole.select(F.col("window_id").alias("_w"), of(F.array_join(F.transform("_p", lambda x: x["t"]), "\n")).alias("text"), "n_lines")
    if few and narrow:
        whole = F.broadcast(whole)
    text = F.when(F.col("_w").isNull(), of(F.lit(""))).otherwise(F.col("text"))
    out = windows.join(whole, F.col("_class") == F.col("_w"), "left").withColumn("text", text).drop("_w", "_class")
    return out.withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


def pending_sessions(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Planned sessions that the ledger lacks, each once (the earliest), in the order of their start."""
    fresh = plan.join(ledger.select("session_id"), "session_id", "left_anti")
    first = Window.partitionBy("session_id").orderBy("sort_key", "path")
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def suffix(records: DataFrame, cursors: DataFrame) -> DataFrame:
    """Records (session_id, seq 0..) after each session's cursor; all of a session that has shrunk."""
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    seen = cursors.select(F.col("session_id").alias("_s"), F.col("captured").alias("_c"))
    rows = records.withColumn("_len", n).join(seen, F.col("session_id") == F.col("_s"), "left")
    start = F.when(F.col("_len") < F.coalesce("_c", F.lit(0)), 0).otherwise(F.coalesce("_c", F.lit(0)))
    return rows.where(F.col("seq") >= start).drop("_len", "_s", "_c")


def annotations(saves: DataFrame) -> DataFrame:
    """Ledger rows of saved windows (entry_id, session_id, start_ts, end_ts, jot): no episode, the scrubbed jot as summary."""
    return saves.select(
        "entry_id", "session_id", F.col("end_ts").alias("ts"), scrub(F.col("jot")).alias("summary"),
        F.lit("").alias("episode_id"), F.col("start_ts").alias("span_start"), F.col("end_ts").alias("span_end"),
        F.create_map(F.lit("annotation"), F.lit("true"), F.lit("record"), F.lit("memory-grade")).alias("enrichment"),
        F.lit("no").alias("extracted"),
    )


def prepared(entries: DataFrame, wal: DataFrame, episodes: DataFrame, of: Callable[[Column], Column] | None = None) -> DataFrame:
    """Entries (entry_id, annotation, start_ts, end_ts, episode_id) with what is to be extracted: the window's
    text for annotations, the episode's body for others. of: what is wanted of a text, taken before it meets the entries."""
    of_it = of or (lambda x: x)
    kept = [c for c in entries.columns if c != "content"]
    body = episodes.select(F.col("episode_id").alias("_e"), of_it(F.coalesce("body", F.lit(""))).alias("_body"), F.lit(True).alias("_found"))
    joined = entries.join(body, F.col("episode_id") == F.col("_e"), "left")
    noted = joined.where("annotation").select(F.struct(*kept).alias("_entry"), "start_ts", "end_ts")
    noted = window_texts(noted, wal, of=of).select("_entry.*", F.col("text").alias("content"))
    content = F.when(F.col("_found"), F.col("_body")).otherwise(of_it(F.lit("")))
    return noted.unionByName(joined.where("NOT coalesce(annotation, false)").select(*kept, content.alias("content")))
