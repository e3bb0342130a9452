"""Global order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_ordinal(df: DataFrame, cell: Column, order: Sequence[Column], out: str, part: Column | None = None) -> DataFrame:
    """Numbers rows 1.. in the order of (cell, *order); cell must rise with the order, part inside a cell.

    Rows are ranked inside their part of a cell (an instant of an hour, some ids of that instant) in
    parallel. Counts of parts meet by cell, and one count per cell meets in one task, to be summed up:
    a cell with very many rows is spread over its parts.
    """
    rows = df.withColumn("_cell", cell).withColumn("_part", F.lit(0) if part is None else part)
    parts = rows.groupBy("_cell", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_skip", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    cells = parts.groupBy("_cell").agg(F.sum("_n").alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    shift = parts.join(cells, F.col("_cell").eqNullSafe(F.col("_c"))).select(
        F.col("_cell").alias("_c"), F.col("_part").alias("_p"), (F.col("_skip") + F.col("_before")).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_cell", "_part").orderBy(*order))
    joined = rows.withColumn("_inside", inside).join(shift, F.col("_cell").eqNullSafe(F.col("_c")) & F.col("_part").eqNullSafe(F.col("_p")))
    return joined.withColumn(out, F.col("_shift") + F.col("_inside")).drop("_cell", "_part", "_inside", "_c", "_p", "_shift")


def instant_part(df: DataFrame, ts: str, key: str) -> Column:
    """A part for with_ordinal by (ts, key): the instant and a block of keys, so that rows of one instant are spread too."""
    if df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        block = F.floor(F.col(key) / 65_536)
    else:
        block = F.substring(F.col(key).cast("string"), 1, 16)
    return F.struct(F.col(ts).alias("ts"), block.alias("block"))


def band_join(left: DataFrame, right: DataFrame, ordinal: str, reach: int, right_prefix: str) -> DataFrame:
    """Pairs where right's ordinal is 1 to `reach` below left's; right's columns get the prefix.

    An equi-join on blocks of `reach` ordinals with a residual condition, never a nested loop.
    """
    right = right.select([F.col(c).alias(right_prefix + c) for c in right.columns])
    mine = F.floor(F.col(ordinal) / reach)
    theirs = F.floor(F.col(right_prefix + ordinal) / reach)
    right = right.withColumn("_block", F.explode(F.array(theirs, theirs + 1)))
    left = left.withColumn("_block", mine)
    low = F.col(ordinal) - reach
    pairs = left.join(right, "_block").where((F.col(right_prefix + ordinal) < F.col(ordinal)) & (F.col(right_prefix + ordinal) >= low))
    return pairs.drop("_block")
