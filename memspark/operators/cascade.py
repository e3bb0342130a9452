"""The redaction cascade: what was said in an episode goes from every copy derived from it.

A request names the episode, the tombstone's hash and, if they are known, the words to hide. Rows
that cite the episode get the tombstone's mark in place of those words, or of the whole text if the request
has no words. Citing edges' vectors and postings are taken out of their indexes, to be made again from the new facts.

Which files hold a citation is read by Bloom filters and bounds of the citing column. Only files with
a text that changes are written again, each by one move, older versions and snapshots' runs too; all others
stay byte for byte. A cascade that broke off is finished by running it again; run a second time it
writes nothing.

Cases: null texts stay null; requests without an episode are left out; several requests of an episode all count, the longest
words are hidden first; an episode that nothing cites changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.edgestore import EdgeStore, Run
from ..sources.storefiles import Files
from . import vectorindex, wordindex
from .recall import small

#: Older versions keep their facts beside the newest, so all kinds of runs are searched.
FACT = "fact"
_WORDS = "array<struct<n:int,w:string,m:string>>"


@dataclass(frozen=True)
class View:
    """A Parquet folder of rows that cite episodes: the citing column (an id or an array of ids) and its texts."""

    path: str
    cites: str
    texts: Sequence[str]


@dataclass(frozen=True)
class Report:
    """What a cascade wrote: rows and files by store, vectors and postings that went."""

    rows: dict[str, int] = field(default_factory=dict)
    files: dict[str, int] = field(default_factory=dict)
    vectors_purged: int = 0
    postings_purged: int = 0


def mark(tombstone: Column) -> Column:
    return F.concat(F.lit("[redacted:"), F.coalesce(tombstone, F.lit("")), F.lit("]"))


def orders(requests: DataFrame) -> DataFrame:
    """(episode, all, words): for each episode the mark of its whole texts, if any, and the words to hide with their marks."""
    needles = F.col("needles") if "needles" in requests.columns else F.lit(None).cast("array<string>")
    rows = requests.where("episode_id is not null").select(
        F.col("episode_id").cast("string").alias("_episode"), mark(F.col("tombstone_hash")).alias("m"),
        F.filter(F.coalesce(needles, F.array().cast("array<string>")), lambda w: F.length(w) > 0).alias("w"))
    each = F.transform("w", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"), F.col("m").alias("m")))
    return rows.select("_episode", F.when(F.size("w") == 0, F.col("m")).alias("whole"), each.alias("hide")).groupBy("_episode").agg(
        F.min("whole").alias("_all"), F.flatten(F.collect_list("hide")).alias("_words"))


def cited(rows: DataFrame, view: View, asked: DataFrame, *columns: str) -> DataFrame:
    """(_file, _row, columns, _all, _words) of the rows that cite an episode asked for; the others go in the scan's stage."""
    many = rows.schema[view.cites].dataType.typeName() == "array"
    episode = F.explode(F.array_distinct(view.cites)) if many else F.col(view.cites)
    found = rows.select("_file", "_row", *columns, episode.alias("_episode")).withColumn("_episode", F.col("_episode").cast("string")).join(asked, "_episode")
    if not many:
        return found.select("_file", "_row", *columns, "_all", F.array_sort("_words").alias("_words"))
    return found.groupBy("_file", "_row").agg(
        *(F.first(c).alias(c) for c in columns), F.min("_all").alias("_all"), F.array_sort(F.flatten(F.collect_list("_words"))).alias("_words"))


def _kept(text: str) -> Column:
    """A text as it may stay; rows that cite nothing have neither mark nor words."""
    out = F.aggregate(F.coalesce("_words", F.array().cast(_WORDS)), F.col(text), lambda t, x: F.replace(t, x["w"], x["m"]))
    return F.when(F.col(text).isNull(), F.col(text)).otherwise(F.coalesce("_all", out))


def redact(files: Files, folder: str, view: View, asked: DataFrame) -> tuple[int, int]:
    """(files, rows) of a folder that had to be written again."""
    def touched(rows: DataFrame) -> DataFrame:
        other = [~_kept(t).eqNullSafe(F.col(t)) for t in view.texts]
        return cited(rows, view, asked, *view.texts).where(reduce(lambda a, b: a | b, other))

    def change(rows: DataFrame) -> DataFrame:
        joined = rows.join(cited(rows, view, asked), ["_file", "_row"], "left")
        return joined.select(*(_kept(c).alias(c) if c in view.texts else F.col(c) for c in rows.columns))

    return files.rewrite(folder, touched, change)


def citing(store: EdgeStore, requests: DataFrame, cites: str = "episode") -> DataFrame:
    """(item_id): edges any version of which cites an episode of the requests."""
    runs = [Run(n[4:], "", 0) for n in store.files.names("runs") if n.startswith("run=")]
    many = store.schema[cites].dataType.typeName() == "array"
    rows = store.rows(runs).select(F.col("edge_id").alias("item_id"), (F.explode(cites) if many else F.col(cites)).alias("_episode"))
    rows = rows.withColumn("_episode", F.col("_episode").cast("string"))
    return rows.join(small(orders(requests).select("_episode")), "_episode", "left_semi").select("item_id").distinct()


def cascade(
    requests: DataFrame, store: EdgeStore, cites: str = "episode", views: Mapping[str, View] | None = None,
    vectors: str | None = None, postings: str | None = None,
) -> Report:
    """Carry out requests (episode_id, tombstone_hash[, needles]) over a store of edges, other views and both indexes.

    The indexes go first: which edges cite an episode is read from the store, which a broken-off cascade leaves readable.
    """
    asked = small(orders(requests))
    ids = citing(store, requests, cites)
    purged = vectorindex.purge(vectors, ids) if vectors else 0
    words = wordindex.purge(postings, ids) if postings else 0
    rows, files = {}, {}
    files["edges"], rows["edges"] = redact(store.files, "runs", View(store.path, cites, [FACT]), asked)
    for name, view in (views or {}).items():
        files[name], rows[name] = redact(Files(requests.sparkSession, view.path), ".", view, asked)
    return Report(rows, files, purged, words)
