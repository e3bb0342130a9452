"""Reports over ledger and journal: cards, health, views, coverage, the diary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..values import ACTION_VIEWS, ACTIONS, DIARY_DAYS, DROP_ORDER, INFRA_ACTIONS, SECTIONS, SECURITY_ACTIONS


def valid_journal(journal: DataFrame) -> DataFrame:
    return journal.where(F.col("action").isin(*ACTIONS))


def report_cards(entries: DataFrame, journal: DataFrame) -> DataFrame:
    """Entries (scope) with how often each action was taken on them, and the actions in order of name."""
    counts = journal.groupBy("scope", "action").agg(F.count(F.lit(1)).alias("n"))
    lists = counts.groupBy("scope").agg(
        F.sum("n").alias("n_actions"), F.array_sort(F.collect_list(F.struct("action", "n"))).alias("l")
    ).select("scope", "n_actions", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["action"], x["n"])), ",").alias("actions"))
    out = entries.join(lists, "scope", "left")
    return out.withColumn("n_actions", F.coalesce("n_actions", F.lit(0))).withColumn("actions", F.coalesce("actions", F.lit("")))


def health(journal: DataFrame) -> DataFrame:
    def n(action: str) -> Column:
        return F.count_if(F.col("action") == action)

    events = n("gate-flag") + n("gate-resolve")
    return journal.agg(
        events.alias("gate_events"), F.round(F.coalesce(F.try_divide(n("gate-flag"), events), F.lit(0.0)), 6).alias("flag_rate"),
        n("verdict").alias("verdicts"), n("revert").alias("reverts"),
    )


def health_by_day(journal: DataFrame) -> DataFrame:
    """Counts by day and action with subtotals (rollup)."""
    return journal.rollup(F.date_format("ts", "yyyy-MM-dd").alias("day"), "action").agg(F.count(F.lit(1)).alias("n"))


def security_view(journal: DataFrame) -> DataFrame:
    return journal.where(F.col("action").isin(*SECURITY_ACTIONS))


def infra_view(journal: DataFrame) -> DataFrame:
    return journal.where(F.col("action").isin(*INFRA_ACTIONS))


def uncovered(spark: SparkSession, views: dict[str, str] = ACTION_VIEWS) -> DataFrame:
    """Legal actions that no view shows."""
    legal = spark.createDataFrame([(a,) for a in ACTIONS], "action string")
    shown = spark.createDataFrame([(a,) for a in views], "action string")
    return legal.subtract(shown)


def deadman_alerts(stale: Column, queued: Column, failures: Column) -> Column:
    return F.array_compact(F.array(
        F.when(stale, "silent"), F.when(queued > 0, "backlog"), F.when(failures > 0, "worker-errors")
    ))


def diary_items(ledger: DataFrame, now: Column, days: int = DIARY_DAYS) -> DataFrame:
    """Entries of the last days, the enriched summary where there is one, unverified until done."""
    rows = ledger.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))
    text = F.coalesce(F.col("enriched_summary"), F.col("summary")) if "enriched_summary" in ledger.columns else F.col("summary")
    return rows.select("entry_id", "session_id", "ts", text.alias("summary"), (F.col("extracted") != "done").alias("unverified"))


def diary_sections(items: DataFrame, group: str = "owner", tasks: DataFrame | None = None) -> DataFrame:
    """(owner, section, body): the offline briefing of each owner, from items (owner, ts, entry_id, ..)."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "entry_id", "session_id", "summary", "unverified")))
    lists = items.groupBy(group).agg(ordered.alias("l"))
    top = F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["summary"], F.when(x["unverified"], " [unverified]").otherwise(""))), "\n")
    threads = F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["summary"])), "\n")
    sessions = F.reverse(F.array_distinct(F.transform("l", lambda x: x["session_id"].cast("string"))))
    recent = F.array_join(F.transform(F.filter(sessions, lambda x: x.isNotNull()), lambda x: F.concat(F.lit("- "), x)), "\n")
    parts = F.array(*[F.struct(F.lit(n).alias("section"), b.alias("body")) for n, b in (("TOP OF MIND", top), ("OPEN THREADS", threads), ("RECENT SESSIONS", recent))])
    out = lists.select(group, F.inline(parts))
    if tasks is not None:
        lines = tasks.groupBy(group).agg(F.array_sort(F.collect_list("line")).alias("t"))
        out = out.unionByName(lines.select(group, F.lit("COMMITMENTS").alias("section"), F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x)), "\n").alias("body")))
    return out.where("body <> ''")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def budgeted(sections: DataFrame, cap: int, group: str = "owner") -> DataFrame:
    """Sections left when the briefing must fit: those of DROP_ORDER go one by one while it is too long."""
    place = F.array_position(F.array(*[F.lit(s) for s in DROP_ORDER]), F.col("section"))
    # a rendered section: '## ' + name + line feed + body; sections are parted by two line feeds
    size = F.length("section") + F.length("body") + 4
    lists = sections.groupBy(group).agg(F.collect_list(F.struct(place.alias("place"), size.alias("size"))).alias("l"))

    def total(k: int) -> Column:
        left = F.filter("l", lambda x: (x["place"] == 0) | (x["place"] > k))
        chars = F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x["size"]) + 2 * F.greatest(F.size(left) - 1, F.lit(0))
        return F.ceil(chars / 4)

    dropped = F.lit(len(DROP_ORDER))
    for k in range(len(DROP_ORDER) - 1, -1, -1):
        dropped = F.when(total(k) <= cap, F.lit(k)).otherwise(dropped)
    kept = lists.select(F.col(group).alias("_g"), dropped.alias("_k"))
    out = sections.join(kept, F.col(group) == F.col("_g")).where((place == 0) | (place > F.col("_k")))
    return out.drop("_g", "_k")


def parse_briefing(texts: DataFrame) -> DataFrame:
    """(text_id, section, body) from '## NAME' headed texts: known sections only, the last of equal ones."""
    names = "|".join(SECTIONS)
    lines = texts.select("text_id", F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))
    head = F.nullif(F.regexp_extract("line", rf"^\s*## \s*({names})\s*$", 1), F.lit(""))
    upto = Window.partitionBy("text_id").orderBy("n")
    rows = lines.withColumn("_h", head).withColumn("_at", F.max(F.when(F.col("_h").isNotNull(), F.col("n"))).over(upto))
    rows = rows.withColumn("section", F.last("_h", ignorenulls=True).over(upto)).where("_at is not null")
    body = F.array_sort(F.collect_list(F.when(F.col("_h").isNull(), F.struct("n", "line"))))
    parts = rows.groupBy("text_id", "_at", "section").agg(F.regexp_replace(F.array_join(F.transform(body, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "").alias("body"))
    return parts.groupBy("text_id", "section").agg(F.max_by("body", "_at").alias("body"))
