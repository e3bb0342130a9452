"""The bi-temporal table of fact edges: shape, reads, state changes, ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..values import RELATIONS

#: Edges of a partition of pairs; a Parquet dictionary holds 1 MB of their ids.
IDS = 20_000


def shape_edges(raw: DataFrame) -> DataFrame:
    """Edges from (edge_id, fact, attributes map): typed columns with their defaults."""
    a = F.col("attributes")
    return raw.select(
        "edge_id", "fact", F.coalesce(a["author"], F.lit("inferred")).alias("author"),
        F.coalesce(a["verdict"], F.lit("provisional")).alias("verdict"),
        F.coalesce(a["contested"].try_cast("boolean"), F.lit(False)).alias("contested"),
        a["superseded_by"].alias("superseded_by"), a["class"].alias("class"), a["type"].alias("type"),
    )


def edges_by_episode(edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """Edges created in any of the episodes (episode)."""
    return edges.join(episodes.select("episode").distinct(), "episode", "left_semi")


def invalidated_in(edges: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, edge_id): edges that expired inside a window, ends included; an equi-join on days.

    Where windows overlap, pairs are many more than rows. An edge is met by all windows of its day one after the
    other, and a partition has about IDS edges, whose ids fit a dictionary of Parquet: what is written of a pair is
    some bits. The number of pairs is the product of both tables all the same.
    """
    days = F.sequence(F.to_date("start_ts"), F.to_date("end_ts"))
    spread = windows.where("start_ts <= end_ts").withColumn("_day", F.explode(days))
    gone = edges.where("expired_at is not null").select("edge_id", "expired_at", F.to_date("expired_at").alias("_day"))
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), gone.count() // IDS)
    gone = gone.repartition(parts, "_day")
    return gone.join(spread.repartition(parts, "_day"), "_day").where("expired_at between start_ts and end_ts").select("window_id", "edge_id")


def edges_as_of(edges: DataFrame, instant: Column, known_at: Column | None = None) -> DataFrame:
    """What held at an instant: begun, and not yet ended; with known_at, of the versions recorded by then."""
    rows = edges
    if known_at is not None:
        newest = Window.partitionBy("edge_id").orderBy(F.col("created_at").desc(), F.col("version").desc())
        rows = rows.where(F.col("created_at") <= known_at).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return rows.where((F.col("valid_at") <= instant) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > instant)))


def reopen(edges: DataFrame, evidence: Column) -> DataFrame:
    """Edges valid again, contested, with one more piece of evidence against them."""
    none = F.lit(None).cast("timestamp_ntz")
    return edges.withColumns({
        "invalid_at": none, "expired_at": none, "contested": F.lit(True),
        "evidence_against": F.array_union(F.coalesce("evidence_against", F.array().cast("array<string>")), F.array(evidence)),
    })


def ontology_map(spark: SparkSession) -> DataFrame:
    """(source, target, relations) for each pair of kinds."""
    rows = [(r, list(s), list(t), n) for n, (r, (s, t)) in enumerate(RELATIONS.items())]
    rel = spark.createDataFrame(rows, "relation string, s array<string>, t array<string>, n int")
    pairs = rel.select("relation", "n", F.explode("s").alias("source"), "t").select("relation", "n", "source", F.explode("t").alias("target"))
    lists = pairs.groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("n", "relation"))).alias("l"))
    return lists.select("source", "target", F.array_join(F.transform("l", lambda x: x["relation"]), ",").alias("relations"))


def relation_label(label: Column) -> Column:
    return F.upper(F.regexp_replace(label, r"(?U)\W+", "_"))


def supersede(edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges with superseded_by, and the journal rows of decisions (edge_id, successor, author); the last of an edge's
    decisions by ordinal counts."""
    last = decisions.groupBy("edge_id").agg(F.max_by(F.struct("successor", "author"), "ordinal").alias("_d"))
    known = last.join(edges.select("edge_id"), "edge_id", "left_semi")
    journal = known.select(F.lit("supersede").alias("action"), F.col("_d.successor").alias("scope"), F.col("edge_id").alias("target"),
                           F.col("_d.successor").alias("after"), F.coalesce("_d.author", F.lit("stated")).alias("author"))
    before = F.col("superseded_by") if "superseded_by" in edges.columns else F.lit(None).cast("string")
    out = edges.join(last, "edge_id", "left").withColumn("superseded_by", F.coalesce(F.col("_d.successor").cast("string"), before)).drop("_d")
    return out, journal


def commit_windows(commits: DataFrame) -> DataFrame:
    """commits (commit_id, ts) with marker cm-<n> in the order of their time, and the window each spans."""
    order = Window.orderBy("ts", "commit_id")  # one row per commit of a drain
    marked = commits.withColumn("marker", F.concat(F.lit("cm-"), (F.row_number().over(order) - 1).cast("string")))
    return marked.withColumn("start_ts", F.col("ts")).withColumn("end_ts", F.coalesce(F.lead("ts").over(order), F.col("ts")))


def ride_along(entries: DataFrame, n: int) -> DataFrame:
    """entries (session_id, ts, entry_id) with the ids of the n before in their session, oldest first."""
    before = Window.partitionBy("session_id").orderBy("ts", "entry_id").rowsBetween(-n, -1)
    return entries.withColumn("prior", F.collect_list("entry_id").over(before))


def canary(edges: DataFrame, start: Column, end: Column) -> DataFrame:
    """Edges whose expiry lies outside the commit that should have written it; none may."""
    return edges.where(F.col("expired_at").isNotNull() & ~F.col("expired_at").between(start, end))


def cascade_targets(edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """(episode, n_edges): what citing edges a redaction of each episode must reach."""
    return edges.join(episodes.select("episode").distinct(), "episode").groupBy("episode").agg(F.count(F.lit(1)).alias("n_edges"))
