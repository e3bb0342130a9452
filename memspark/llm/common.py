"""What the operators of this subpackage share: scratch tables, ranks, components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_scratch: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Let Python workers on this host import the package (a cluster gets it by --py-files)."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = ":".join([_ROOT, *parts])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only where none is named."""
    prepare(spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = _scratch.get("own") or tempfile.mkdtemp(prefix="memspark-")
    _scratch["own"] = own
    atexit.register(_remove, own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def _own_folder(spark: SparkSession) -> str:
    """The application's folder below the shared one; the driver deletes it when it ends."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/memspark/{spark.sparkContext.applicationId}"
    if _scratch.get("folder") != folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _scratch["folder"] = folder
    return folder


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet under the shared checkpoint folder and read it again.

    Cuts the lineage so that a lost executor costs a re-read, not a re-computation, and keeps
    the columnar form, so later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a table of materialize() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores before it while df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def shelter(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns of these names renamed, and what selects df's columns, as they were, from a later table."""
    kept = {c: free_name(df, f"_kept_{c}") for c in df.columns if c.lower() in names}
    return df.withColumnsRenamed(kept), lambda out: out.select([F.col(kept.get(c, c)).alias(c) for c in df.columns])


def ranked(df: DataFrame, group: str, cell: str, order: Sequence[Column], out: str) -> DataFrame:
    """Gapless rank from 0 inside each group, without one task per group.

    cell cuts a group into pieces of bounded share; ranks are taken inside (group, cell) and
    shifted by the counts of the group's earlier cells, so a group with a third of all rows is
    still spread over as many tasks as it has cells. group and cell must not be null.
    """
    inner, shift = free_name(df, "_rank_in"), free_name(df, "_rank_shift")
    counts = df.groupBy(group, cell).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(shift))
    within = Window.partitionBy(group, cell).orderBy(*order)
    rows = df.withColumn(inner, F.row_number().over(within) - 1)
    return rows.join(counts, [group, cell]).withColumn(out, F.col(shift) + F.col(inner)).drop(shift, inner)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected (a long, b long) edges: rows (node, label = smallest node).

    Alternates the large-star and small-star steps until the edges no longer change; each
    round's edges are written to the shared folder. Only counts reach the driver.
    """
    def stats(e: DataFrame) -> tuple:
        r = e.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
        ).first()
        return tuple(r)

    cur = materialize(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    seen = stats(cur)
    while seen[0]:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a != b")
        # every edge of large has a > b, so the smaller neighbours of a are its b's
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = (
            joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        nxt = materialize(small, "edges")
        now = stats(nxt)
        drop_scratch(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    leaves = cur.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    roots = cur.select(F.col("b").alias("node")).distinct().join(leaves.select("node"), "node", "left_anti")
    return leaves.union(roots.select("node", F.col("node").alias("label")))


def least_of_component(classes: DataFrame, comp: DataFrame, salts: int = 16) -> DataFrame:
    """(fp, least): for each class (fp, least) the smallest `least` of its component (node, label).

    A component may hold very many classes: it is reduced before the shuffle, and its classes meet
    the result in `salts` places. Classes that comp lacks stand alone.
    """
    inside = classes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", "label")
    linked = inside.where("label is not null").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int"))
    best = linked.groupBy("label").agg(F.min("least").alias("least"))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return inside.where("label is null").select("fp", "least").union(linked.drop("least").join(best, ["label", "salt"]).select("fp", "least"))


def one_text(rows: DataFrame, *others: str) -> DataFrame:
    """(doc_id, text, others) with one row for each doc_id: the text of the least hash, the least of the others.

    Aggregates before it shuffles, so an id of very many rows is no burden.
    """
    key = F.xxhash64("text")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct(key, F.col("text"))).alias("text"), *[F.min(c).alias(c) for c in others])


def arrow_rows(columns: dict, schema) -> "object":
    """A record batch of the given schema from Python lists or numpy arrays."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def text_bytes(column) -> list:
    """UTF-8 bytes of each text of an Arrow string column; None where null."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


__all__ = [
    "arrow_rows", "checkpoint_dir", "components", "drop_scratch", "free_name", "least_of_component",
    "materialize", "one_text", "prepare", "ranked", "shelter", "table", "text_bytes",
]
