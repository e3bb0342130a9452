"""Links between ledger entries: the prior entry, topics within a lookback, supersession, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import cosine
from ..values import LINK_LABELS, LOOKBACK, REFERENCE, SAME_TOPIC
from .order import band_join, instant_part, with_ordinal


def structural_links(ledger: DataFrame) -> DataFrame:
    """(entry_id, prev, next): prev is the latest earlier entry of the session, else of all; next is the
    last entry that has this one as prev. An as-of self-join by lag; only sessions' first entries look
    up their global prior, by an equi-join on the global ordinal."""
    rows = ledger.select("entry_id", "session_id", "ts")
    rows = with_ordinal(rows, F.date_trunc("hour", F.col("ts")), [F.col("ts"), F.col("entry_id")], "rn", instant_part(rows, "ts", "entry_id"))
    mine = F.lag("entry_id").over(Window.partitionBy("session_id").orderBy("rn"))
    rows = rows.withColumn("own", mine)
    firsts = rows.where("own is null")
    before = rows.select((F.col("rn") + 1).alias("rn"), F.col("entry_id").alias("other"))
    firsts = firsts.join(before, "rn", "left").withColumn("prev", F.col("other")).select("entry_id", "rn", "prev")
    linked = rows.where("own is not null").select("entry_id", "rn", F.col("own").alias("prev")).union(firsts.select("entry_id", "rn", "prev"))
    nexts = linked.where("prev is not null").groupBy(F.col("prev").alias("_p")).agg(F.max_by("entry_id", "rn").alias("next"))
    return linked.join(nexts, F.col("entry_id") == F.col("_p"), "left").select("entry_id", "prev", "next")


def prior_of(ledger: DataFrame, fresh: DataFrame) -> DataFrame:
    """(entry_id, prev) of fresh entries (entry_id, session_id, ts): the latest entry before each, of its session if
    that has one, else of all. Fresh ones count among each other by their time."""
    both = ledger.select("entry_id", "session_id", "ts", F.lit(False).alias("_new")).unionByName(fresh.select("entry_id", "session_id", "ts", F.lit(True).alias("_new")))
    found = structural_links(both).select("entry_id", "prev")
    return found.join(fresh.select("entry_id"), "entry_id", "left_semi")


def link_late(linked: DataFrame, fresh: DataFrame) -> DataFrame:
    """(entry_id, prev, next) when fresh entries come to linked ones (entry_id, session_id, ts, prev, next), maybe late.

    What was linked keeps its prev. A fresh entry takes the latest one before it; that one's next
    becomes the fresh entry, the last of them if there are several. Nothing else is rewired.
    """
    prior = prior_of(linked, fresh)
    order = F.struct("ts", "entry_id")
    nexts = prior.join(fresh, "entry_id").where("prev is not null").groupBy(F.col("prev").alias("_p")).agg(F.max_by("entry_id", order).alias("_next"))
    kind = linked.schema["next"].dataType
    rows = linked.select("entry_id", "prev", "next").unionByName(prior.select("entry_id", "prev", F.lit(None).cast(kind).alias("next")))
    return rows.join(nexts, F.col("entry_id") == F.col("_p"), "left").select("entry_id", "prev", F.coalesce("_next", "next").alias("next"))


def lookback_pairs(rows: DataFrame, reach: int = LOOKBACK) -> DataFrame:
    """rows (entry_id, session_id, rn, vector) paired with each of the `reach` entries before, and scored."""
    pairs = band_join(rows, rows, "rn", reach, "p_")
    return pairs.withColumn("score", F.round(cosine(F.col("vector"), F.col("p_vector")), 6)).drop("vector", "p_vector")


def semantic_links(rows: DataFrame, reach: int = LOOKBACK) -> DataFrame:
    """(entry_id, same_topic, references, continues): sorted ids of like entries among the `reach` before
    (topics also backwards), and the likest topic of the same session, the later one of equals."""
    pairs = lookback_pairs(rows, reach).where(F.col("score") >= REFERENCE)
    topic = F.col("score") >= SAME_TOPIC
    session = F.col("session_id").eqNullSafe(F.col("p_session_id"))
    sides = pairs.select(
        F.explode(F.array(
            F.struct(F.col("entry_id").alias("entry_id"), F.when(topic, F.col("p_entry_id")).alias("topic"),
                     F.when(~topic, F.col("p_entry_id")).alias("ref"),
                     F.when(topic & session, F.struct("score", "p_rn", "p_entry_id")).alias("best")),
            F.struct(F.col("p_entry_id").alias("entry_id"), F.when(topic, F.col("entry_id")).alias("topic"),
                     F.lit(None).cast("long").alias("ref"),
                     F.lit(None).cast("struct<score:double,p_rn:bigint,p_entry_id:bigint>").alias("best")),
        )).alias("x")
    ).select("x.*")
    return sides.groupBy("entry_id").agg(
        F.sort_array(F.collect_set("topic")).alias("same_topic"), F.sort_array(F.collect_set("ref")).alias("references"),
        F.max("best").alias("_b"),
    ).select("entry_id", "same_topic", "references", F.col("_b.p_entry_id").alias("continues"))


def apply_supersession(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """entries (entry_id, supersedes, caused_by) with the decided ids appended, each once, in order."""
    d = decisions.groupBy(F.col("entry_id").alias("_id")).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "old_id", "cause_id"))).alias("_d")
    )
    joined = entries.join(d, F.col("entry_id") == F.col("_id"), "left")

    def appended(have: str, add: str) -> Column:
        new = F.filter(F.transform("_d", lambda x: x[add]), lambda x: x.isNotNull())
        return F.array_distinct(F.concat(F.col(have), F.coalesce(new, F.array().cast("array<bigint>"))))

    return joined.withColumn("supersedes", appended("supersedes", "old_id")).withColumn("caused_by", appended("caused_by", "cause_id")).drop("_id", "_d")


def link_edges(links: DataFrame) -> DataFrame:
    """(src, dst, label): the filled links of entries, one row each. Lists and single ids alike."""
    kinds = dict(links.dtypes)

    def listed(c: str) -> Column:
        ids = F.col(c) if kinds[c].startswith("array") else F.array(F.col(c))
        return F.transform(F.filter(ids, lambda x: x.isNotNull()), lambda x: F.struct(x.alias("dst"), F.lit(LINK_LABELS[c]).alias("label")))

    present = [listed(c) for c in LINK_LABELS if c in kinds]
    return links.select(F.col("entry_id").alias("src"), F.inline(F.flatten(F.array(*present))))
