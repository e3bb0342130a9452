"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (law: bytes).

Every shard owns `vnodes` points on a ring; a row hashes to a point of the ring and belongs to
the next virtual node clockwise. No shard takes more than (1 + eps) times the mean size, up to
less than one row more: what would overflow a full shard continues clockwise to the next shard
with room. Rows arrive in classes of falling size, so that small rows fill what long ones left.
The ring is cut into CELLS cells (each with SUB sub-cells, so that a repeated key is spread); the
driver sees only the sizes by class and cell, a table of fixed size, and decides which cells go
where. A cell is cut at most once for each shard that fills up in it.

Cases: null text has size 1; null and repeated ids are placed like others (equal rows may part);
an empty table gives an empty result; further columns are kept, and names that clash with the
new columns are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, ranked

CELLS = 1 << 12
SUB = 4
#: Classes by size, longest first: 4^9 bytes and more, 4^8 and more, and so on; the last one is below 4^5.
CLASSES = 6
VNODES = 256
#: A shard's room over the mean. Small: balance comes before movement.
EPS = 0.002


def ring(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> np.ndarray:
    """For each cell, the shards clockwise from it, nearest first: int array (cells, shards)."""
    from xxhash import xxh64_intdigest

    points = sorted(
        (xxh64_intdigest(f"shard-{s}-{v}", 1) * cells >> 64, xxh64_intdigest(f"shard-{s}-{v}", 1), s)
        for s in range(shards) for v in range(vnodes)
    )
    at = np.array([p[0] for p in points])
    owner = np.array([p[2] for p in points])
    order = np.empty((len(points), shards), dtype=np.int32)
    seen: list[int] = list(dict.fromkeys(owner.tolist()))
    for i in range(len(points) - 1, -1, -1):  # nearest first: each step back moves one shard to the front
        seen.remove(owner[i])
        seen.insert(0, int(owner[i]))
        order[i] = seen
    first = np.searchsorted(at, np.arange(cells), side="left") % len(points)
    return order[first]


def place(sizes: np.ndarray, shards: int, eps: float = EPS, vnodes: int = VNODES) -> list[tuple[int, int, int, int, int]]:
    """Segments (group, part, from_size, to_size, shard) that hold every group's sizes, in order of arrival.

    sizes[g]: the size of group g = (class * CELLS + cell) * SUB + sub.
    """
    prefer = ring(shards, vnodes)
    room = np.full(shards, int(np.ceil((1 + eps) * sizes.sum() / shards)), dtype=np.int64)
    out = []
    for g in np.flatnonzero(sizes):
        left, done, part = int(sizes[g]), 0, 0
        for s in prefer[g // SUB % CELLS].tolist():
            take = min(left, int(room[s]))
            if take > 0:
                out.append((int(g), part, done, done + take, s))
                room[s] -= take
                left, done, part = left - take, done + take, part + 1
            if not left:
                break
    return out


def shard(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
    eps: float = EPS, vnodes: int = VNODES, order: Sequence[Column] | None = None,
) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard.

    order: what rows are ordered by inside a cell, ring position by default.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    text = F.col(text_col).cast("string")
    point, group, before, nth, part = (free_name(docs, x) for x in ("_point", "_group", "_before", "_nth", "_part"))
    lo, hi, first = (free_name(docs, x) for x in ("_lo", "_hi", "_first"))
    rows = docs.select(
        "*",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        # rows without an id are told apart by their texts, so that they do not meet in one place
        F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(""), text)).otherwise(F.xxhash64(F.col(id_col).cast("string"))).alias(point),
    )
    cell_bits = CELLS.bit_length() - 1
    cell = F.shiftrightunsigned(F.col(point), 64 - cell_bits)
    sub = F.pmod(F.xxhash64(point, "size", "text_crc32"), F.lit(SUB))
    of_size = sum((F.col("size") < 4 ** (9 - k)).cast("int") for k in range(CLASSES - 1))
    rows = rows.withColumn(group, ((of_size * CELLS + cell) * SUB + sub).cast("int"))

    sizes = np.zeros(CLASSES * CELLS * SUB, dtype=np.int64)
    n_rows = np.zeros(CLASSES * CELLS * SUB, dtype=np.int64)
    for g, size, n in rows.groupBy(group).agg(F.sum("size"), F.count(F.lit(1))).collect():  # CLASSES * CELLS * SUB rows at most
        sizes[g], n_rows[g] = size, n
    placed = place(sizes, shards, eps, vnodes)

    keys = list(order) if order else [F.col(point)]
    keys += [F.col(id_col), F.col("size"), F.col("text_crc32")]
    within = Window.partitionBy(group).orderBy(*keys)
    numbered = rows.withColumn(nth, F.row_number().over(within) - 1).withColumn(
        before, F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )

    def table(parts: list[tuple], names: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(parts, names))  # CLASSES * CELLS * SUB + shards rows at most

    parts_of: dict[int, int] = {}
    for g, p, *_ in placed:
        parts_of[g] = max(parts_of.get(g, 0), p)
    cut = [x for x in placed if parts_of[x[0]]]
    counted: dict[tuple[int, int], int] = {}
    if cut:
        spec = table(cut, f"`{group}` int, `{part}` int, `{lo}` long, `{hi}` long, _s int")
        inside = (F.col(before) >= F.col(lo)) & (F.col(before) < F.col(hi))
        some = numbered.select(group, before).where(F.col(group).isin(sorted({x[0] for x in cut})))
        counted = {(g, p): n for g, p, n in some.join(spec, group).where(inside).groupBy(group, part).count().collect()}
    next_slot = [0] * shards
    spec_rows = []
    done: dict[int, int] = {}
    for g, p, a, b, s in placed:
        n = counted.get((g, p), 0) if parts_of[g] else int(n_rows[g])
        # a row's slot is its place in the group, shifted by this
        spec_rows.append((g, a, b, s, next_slot[s] - done.get(g, 0)))
        next_slot[s] += n
        done[g] = done.get(g, 0) + n
    spec = table(spec_rows, f"`{group}` int, `{lo}` long, `{hi}` long, shard int, `{first}` long")
    inside = (F.col(before) >= F.col(lo)) & (F.col(before) < F.col(hi))
    return (
        numbered.join(spec, group).where(inside)
        .withColumn("law", F.lit("bytes"))
        .withColumn("slot", F.col(nth).cast("long") + F.col(first))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .drop(point, group, before, nth, lo, hi, first)
    )


def shard_in_order(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, read from files, with size, text_crc32, law, shard and slot; slots keep the files' order.

    Rows are told apart by file and place, so repeated ids and equal rows need no care. Only
    sizes and places are ranked; the texts are shuffled once, to meet their shard.
    """
    name, nth, cell = (free_name(docs, x) for x in ("_file", "_row", "_cell"))
    docs = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    rows = docs.select("*", F.col("_metadata.file_name").alias(name), F.col("_metadata.row_index").alias(nth))
    thin = rows.select(name, nth, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    placed = shard(thin, shards, **options).drop("text", "doc_id", "slot", "grown_shard")
    # files are numbered; from 100,000 on their names no longer sort by number
    number = F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long")
    placed = placed.withColumn(cell, F.struct(number.alias("n"), F.col(name).alias("f"), F.floor(F.col(nth) / 4096).alias("c")))
    placed = ranked(placed, "shard", cell, [F.col(nth)], "slot").drop(cell)
    return rows.join(placed, [name, nth]).drop(name, nth)
