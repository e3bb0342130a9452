"""Near-duplicate detection: SimHash fingerprints joined by covering locality-sensitive hashing.

Every bit position i of the fingerprint carries a random code c(i) of radius + 1 bits. For each
non-zero v of radius + 1 bits, table v keeps the bit positions with <c(i), v> = 1 (mod 2) and
masks the others. The codes of at most `radius` differing positions span a space of dimension
radius or less, so some non-zero v is orthogonal to all of them: table v masks them all and the
two fingerprints agree there. No pair within the radius is missed (2^(radius+1) - 1 = 31 tables
for radius 4).

Equal fingerprints are one class from the start, so copies never meet as pairs. Inside a bucket
classes are linked by a breadth-first walk that emits at most size - 1 true links (a spanning
forest), found links imply the same components as all of them.

Cases: null text counts as empty; a text without words has fingerprint zero and is linked like
any other; equal rows share class and component; null doc_id rows get a fingerprint and the
smallest non-null doc_id of their component (null if there is none); an empty table gives an
empty result; further columns of the input are ignored by fingerprints() and kept by dedup().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free_name, least_of_component, materialize, prepare, text_bytes
from .nearcopies import near_copies, row_key, text_hash

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Largest bucket that is walked whole; larger ones are first cut by blocks of bits.
WALK = 8192
NO_ID = (1 << 63) - 1
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text; A-Z are lower-cased."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        spans = iter([(0, len(line))])
        n = 1
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = ends - lengths + 1
        n = len(words) - size + 1
        spans = zip(starts[:n].tolist(), ends[size - 1:].tolist(), strict=True)
    counts = np.zeros(BITS, dtype=np.int64)
    left = n
    while left:
        take = min(left, _HASHES_AT_ONCE)
        hashes = np.fromiter((xxh64_intdigest(line[s:e], seed) for s, e in _first(spans, take)), dtype="<u8", count=take)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(take, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
        left -= take
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _first(it: Iterator, n: int) -> Iterator:
    for _ in range(n):
        yield next(it)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): one row per input row; fp holds the 64 bits as a signed long."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
        for b in batches:
            fps = np.array([fingerprint(t) for t in text_bytes(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], schema=schema)

    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pair.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS, seed: int = 7) -> list[int]:
    """One mask per non-zero v; codes are dealt so that every value is used about equally often."""
    k = radius + 1
    rng = np.random.default_rng(seed)
    codes = np.arange(bits) % (1 << k)
    rng.shuffle(codes)
    return [
        sum(1 << i for i, c in enumerate(codes.tolist()) if bin(c & v).count("1") % 2 == 1)
        for v in range(1, 1 << k)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def walk(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (distance <= radius) among distinct uint64 values."""
    out = []
    left = values
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found = left[near]
                out += [(int(at), int(x)) for x in found]
                frontier += list(found)
                left = left[~near]
    return out


def bucket_links(values: np.ndarray, radius: int, bits: int = BITS) -> list[tuple[int, int]]:
    """Links of one bucket. A large one is cut by each of radius + 1 blocks of bits first: values
    within the radius agree in one block at least, so nothing is lost."""
    if len(values) <= WALK:
        return walk(values, radius)
    out = []
    edges = np.linspace(0, bits, radius + 2).astype(int)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        part = (values >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for group in np.split(values[order], cuts):
            if len(group) > 1:
                out += walk(group, radius)
    return out


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that imply all links within the radius."""
    masks = covering_masks(radius)
    keyed = classes.select(
        "fp", F.explode(F.array(*[
            F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"))
            for t, m in enumerate(masks)
        ])).alias("x"),
    ).select("x.t", "x.k", "fp")

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        rest_t, rest_k, rest_f = (np.empty(0, np.int64) for _ in range(3))
        for last, b in _with_last(batches):
            t = rest_t if b is None else np.concatenate([rest_t, b.column(0).to_numpy().astype(np.int64)])
            k = rest_k if b is None else np.concatenate([rest_k, b.column(1).to_numpy()])
            f = rest_f if b is None else np.concatenate([rest_f, b.column(2).to_numpy()])
            if not len(t):
                continue
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
            bounds = np.concatenate([[0], cuts, [len(t)]])
            if not last:  # the last group may go on in the next batch
                at = bounds[-2]
                rest_t, rest_k, rest_f = t[at:], k[at:], f[at:]
                bounds = bounds[:-1]
            sizes = np.diff(bounds)
            pairs = []
            for g in np.flatnonzero(sizes > 1):
                group = f[bounds[g]:bounds[g + 1]].view(np.uint64)
                pairs += bucket_links(np.unique(group), radius)
            if pairs:
                e = np.array(pairs, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], schema=schema)

    return (
        keyed.repartition("t", "k").sortWithinPartitions("t", "k")
        .mapInArrow(run, "a long, b long")
    )


def _with_last(batches):
    """(False, batch) for each, then (True, None)."""
    for b in batches:
        yield False, b
    yield True, None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp long, component_id): one row per input row."""
    fps = materialize(fingerprints(docs, id_col, text_col), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    comp = materialize(components(links(classes, radius)), "components")
    # null ids count as larger than all others
    order = F.coalesce("rep", F.lit(NO_ID))
    of_class = least_of_component(classes.select("fp", order.alias("least")), comp).select("fp", F.nullif("least", F.lit(NO_ID)).alias("component_id"))
    return fps.join(of_class, "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of near copies (five-word shingles, Jaccard similarity 0.8 or
    more: see nearcopies): that of the smallest doc_id, and of the least hash where texts share it;
    columns as given. The components of near_duplicates() are candidates, all checked exactly; MinHash adds those
    that differ in more bits.

    Rows are told apart by id and text. Rows with a null id count as larger than all others. Equal
    rows are copies: one stays.
    """
    key = free_name(docs, "_key")
    keep = near_copies(docs, id_col, text_col, _alike(docs, text_col)).select(F.col("keeper").alias(key)).distinct()
    rows = docs.withColumn(key, row_key(F.col(id_col).cast("long"), text_hash(F.col(text_col).cast("string"))))
    return rows.join(keep, key, "left_semi").dropDuplicates([key]).drop(key)


def _alike(docs: DataFrame, text_col: str) -> DataFrame:
    """(text_hash, group): distinct texts by the component that near_duplicates() puts them in."""
    text = F.col(text_col).cast("string")
    found = near_duplicates(docs.select(text_hash(text).alias("text_hash"), text.alias("text")), "text_hash", "text")
    return found.select(F.col("doc_id").alias("text_hash"), F.col("component_id").alias("group")).distinct()


def hex_fingerprint(fp) -> "F.Column":
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
