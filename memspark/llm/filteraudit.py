"""Filter interaction audit: what each of several filters removes, in every order, from packed bitmaps.

A narrow table holds a row for each document: its part, a byte of filters that it fails and a
byte of labels. Inside a partition the rows of an Arrow batch are sorted by part, each part's run
padded to whole bytes, and packed into one bitset for each filter and label. For every set of
filters that may come first (2^n of them) the bitset of what passes them is ANDed with what the
next filter fails, or its complement, and the ones of each part's bytes are counted. Counts of
batches are added in the task, those of tasks by Spark; orders are looked up in those counts.

The filters of whole texts (null: empty; words: maximal runs of other than blanks, tabs, line ends): A fewer than
50 words, B distinct words below 65 %, C capitals over 5 % of code points, D one of the symbols
#$%&*|, E equal to the text of a smaller doc_id. E compares 128 bits of SHA-256: ids meet on the
digest, aggregated before the shuffle, and only digests that several ids have are joined.

Cases: null texts are empty ones; null parts are the empty string; rows of a null doc_id are no copy of any
and none of them; several rows of one id are each counted, none makes the other a copy; several
labels of one id: 1 if any is; ids without labels are neither good nor toxic; an empty table gives
no part and so no row; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import permutations
from math import factorial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, prepare

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT = 65
MAX_CAPITALS = 5
SYMBOLS = b"#$%&*|"
_CAPITALS = bytes(range(65, 91))
#: Labels' bits: quality is 1, toxic is 1.
GOOD, TOXIC = 1, 2
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def fails(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words = text.split()
    points = len(text) if text.isascii() else int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
        | (100 * capitals > MAX_CAPITALS * points) << 2 | (len(text) != len(text.translate(None, SYMBOLS))) << 3
    )


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, bits, digest): the filters that a text fails by itself, and what stands for it."""
    prepare(docs.sparkSession)
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([fails(t) for t in texts], pa.int32()),
                pa.array([sha256(t).digest()[:16] for t in texts], pa.binary())], names=["doc_id", "part", "bits", "digest"])

    return narrow.mapInArrow(run, "doc_id long, part string, bits int, digest binary")


def with_copies(rows: DataFrame) -> DataFrame:
    """judged() rows with E's bit where a smaller doc_id has the same digest.

    A digest of very many rows is aggregated before the shuffle; in the join it is a hot key of the
    rows' side only, which adaptive execution splits.
    """
    known = rows.where("doc_id is not null")
    several = known.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last")
    copy = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
    out = rows.join(several.select("digest", "_first"), "digest", "left")
    return out.select("doc_id", "part", F.col("bits").bitwiseOR(F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("bits"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, marks): the labels' bits for each row."""
    def one(name: str):
        return F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0))

    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        (one("quality") * GOOD + one("toxic") * TOXIC).alias("_marks")).where("_marks > 0")
    out = rows.join(marks, F.col("doc_id") == F.col("_id"), "left")
    return out.select("part", "bits", F.coalesce("_marks", F.lit(0)).alias("marks"))


def count_batch(part: np.ndarray, bits: np.ndarray, marks: np.ndarray, n: int = len(FILTERS)) -> tuple[np.ndarray, np.ndarray]:
    """(parts, counts[part, measure, prefix set, filter]) of rows whose parts are small numbers.

    Entries whose filter is in the prefix set already are 0.
    """
    order = np.argsort(part, kind="stable")
    found, first, size = np.unique(part[order], return_index=True, return_counts=True)
    width = -(-size // 8)  # bytes of each part's run
    start = np.cumsum(width) - width
    slot = np.arange(len(order)) + np.repeat(start * 8 - first, size)

    def packed(flags: np.ndarray) -> np.ndarray:
        at = np.zeros(int(width.sum()) * 8, dtype=bool)
        at[slot] = flags
        return np.packbits(at)

    def ones(bitset: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(bitset).astype(np.int64), start)

    bits, marks = bits[order], marks[order]
    there = packed(np.ones(len(order), dtype=bool))
    failing = [packed((bits >> f & 1).astype(bool)) for f in range(n)]
    good, toxic = packed((marks & GOOD) > 0), packed((marks & TOXIC) > 0)
    passing = [there] * (1 << n)
    for s in range(1, 1 << n):
        low = (s & -s).bit_length() - 1
        passing[s] = passing[s & (s - 1)] & ~failing[low]
    everything = (1 << n) - 1
    out = np.zeros((len(found), len(MEASURES), 1 << n, n), dtype=np.int64)
    for f in range(n):
        alone = ones(passing[everything & ~(1 << f)] & failing[f])
        for s in range(1 << n):
            if not s >> f & 1:
                gone = passing[s] & failing[f]
                counts = (passing[s | 1 << f], gone, failing[f] & ~passing[s], None, gone & good, gone & toxic)
                for m, bitset in enumerate(counts):
                    out[:, m, s, f] = alone if bitset is None else ones(bitset)
    return found, out


def subset_counts(rows: DataFrame) -> DataFrame:
    """(part, prefix, filter, the measures): of each part, what a filter does after a set of others; zeros too.

    rows: (part, bits, marks).
    """
    n = len(FILTERS)
    pairs = [(s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1]

    def run(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for b in batches:
            if len(b):
                coded = b.column(0).dictionary_encode()
                found, counts = count_batch(coded.indices.to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), n)
                for p, c in zip(found.tolist(), counts, strict=True):
                    name = coded.dictionary[p].as_py()
                    sums[name] = sums[name] + c if name in sums else c
        s, f = (np.array(x) for x in zip(*pairs, strict=True))
        for name, c in sums.items():
            columns = [pa.array([name] * len(pairs), pa.string()), pa.array(s, pa.int32()), pa.array(f, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(c[m, s, f], pa.int64()) for m in range(len(MEASURES))], names=["part", "prefix", "filter", *MEASURES])

    each = rows.mapInArrow(run, "part string, prefix int, filter int, " + ", ".join(f"{m} long" for m in MEASURES))
    return each.groupBy("part", "prefix", "filter").agg(*[F.sum(m).alias(m) for m in MEASURES])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, the measures, shapley): one row for each part, order of all filters and step."""
    spark = docs.sparkSession
    rows = materialize(judged(docs), "judged")  # read twice; the texts are read once
    counts = subset_counts(with_labels(with_copies(rows), labels))
    n = len(FILTERS)
    ways = {s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in range(1 << n) if s.bit_count() < n}
    steps = [(''.join(FILTERS[f] for f in p), k + 1, sum(1 << f for f in p[:k]), f, ways[sum(1 << f for f in p[:k])]) for p in permutations(range(n)) for k, f in enumerate(p)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, prefix int, filter int, ways long")  # n! n rows
    weight = orders.select("prefix", "filter", "ways").distinct()
    shapley = F.sum(F.col("removed") * F.col("ways")).over(Window.partitionBy("part", "filter"))
    counts = counts.join(F.broadcast(weight), ["prefix", "filter"]).withColumn("shapley", shapley).drop("ways")
    return counts.join(F.broadcast(orders.drop("ways")), ["prefix", "filter"]).select("part", "filter_order", "step", *MEASURES, "shapley")
