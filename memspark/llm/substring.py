"""Exact substring deduplication with a logarithmic family of suffix arrays.

Every byte covered by a LENGTH-byte string (a window) that also starts in a document with a
smaller id is removed. Documents are packed into chunks of about CHUNK bytes.

1. Anchors. A window's anchor is the least hash of its GRAM-byte substrings, so equal windows
   have equal anchors. Consecutive windows with one anchor form a run (some 14 windows).
2. Filter. Chunks send their distinct anchors, 4 bytes each, dealt by hash into buckets, and learn
   which occur in other chunks too. Only runs with such anchors, or with anchors of several
   documents of the chunk, go on: the rest of the text is never shuffled.
3. Index. The remaining runs' texts are dealt by anchor; a chunk sends a text once, with the
   smallest id that has it. In each bucket the texts arrive in batches. A batch gets its suffix
   array (the windows' starts in the order of their bytes, LENGTH of them, which is the whole of a
   match), is merge-scanned against each level of the family, and what is new in it joins as a
   level; levels of like size merge, two sorted runs into one, so there are logarithmically many
   and each window is merged logarithmically often.
4. Every run learns which of its windows a smaller id has, and the chunks remove what they cover.

dedup_spans() resolves a whole table at once, its families live in the buckets' tasks.
SuffixIndex keeps the levels of its families in a folder: append() scans a new table against them,
adds it, and merges levels of like size.

Texts are compared byte by byte; hashes only choose the bucket, and the filter's 4-byte prints only
let too much through. A passage that many documents share is sent once per chunk and bucket; there
a message costs its text while it is read, and 12 bytes for each of its texts until the bucket ends.

Cases: null text is empty; null ids count as larger than all others, equal ids do not remove each
other's bytes; texts below LENGTH bytes stay as they are; equal rows each get a row; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, prepare, text_bytes

LENGTH = 50
GRAM = 24
CHUNK = 4 << 20
#: Bytes of text for each bucket.
BUCKET = 8 << 20
#: Bytes of new texts that make a batch of a family.
BATCH = 4 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_BLOCK = 1 << 20
_NO_ID = np.iinfo(np.int64).max
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def polynomial(buf: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hashes (mod 2^64) of all n-byte substrings, from those of 1, 2, 4 ... bytes."""
    part, length, factor = buf.astype(np.uint64) + np.uint64(1), 1, base
    out, done, left = None, 0, n
    while True:
        if left & 1:
            if out is None:
                out = part
            else:
                tail = part[done:]
                out = out[:len(tail)] * np.uint64(factor) + tail
            done += length
        left >>= 1
        if not left:
            return out
        part = part[:-length] * np.uint64(factor) + part[length:]
        length, factor = 2 * length, factor * factor % (1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    return (h ^ (h >> np.uint64(32))) * _MIX


def anchors(buf: np.ndarray) -> np.ndarray:
    """The anchor of the window at each position, LENGTH - 1 fewer than bytes."""
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    grams = LENGTH - GRAM + 1
    for at in range(0, n, _BLOCK):
        m = mixed(polynomial(buf[at:at + _BLOCK + LENGTH - 1], GRAM, _BASE))
        have = 1
        while 2 * have <= grams:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if have < grams:
            m = np.minimum(m[:len(m) - (grams - have)], m[grams - have:])
        out[at:at + _BLOCK] = m[:len(out[at:at + _BLOCK])]
    return out


class Chunk:
    """Some documents side by side, and the runs of their windows."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, data: bytes):
        self.ids, self.data = ids, data
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        buf = np.frombuffer(data, np.uint8)
        m = anchors(buf)
        # windows inside one document: from its start to LENGTH bytes before its end
        delta = np.zeros(len(m) + 1, np.int32)
        fits = lengths >= LENGTH
        np.add.at(delta, self.starts[fits], 1)
        np.add.at(delta, self.ends[fits] - LENGTH + 1, -1)
        valid = np.cumsum(delta[:-1]) > 0
        begins = valid.copy()
        begins[1:] &= (m[1:] != m[:-1]) | ~valid[:-1]
        begins[self.starts[fits]] = True
        self.first = np.flatnonzero(begins)
        last = valid.copy()
        last[:-1] &= begins[1:] | ~valid[1:]
        self.last = np.flatnonzero(last)
        self.doc = np.searchsorted(self.ends, self.first, side="right")
        self.anchor = mixed(m[self.first])

    def prints(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, sorted distinct 4-byte prints of anchors)."""
        bucket, small = _deal(np.unique(self.anchor), buckets)
        order = np.lexsort((small, bucket))
        bucket, small = bucket[order], small[order]
        for b, part in _groups(bucket, small):
            yield b, np.unique(part)

    def chosen(self, shared: dict[int, bytes], buckets: int) -> np.ndarray:
        """Runs whose anchors other chunks have too, or several documents of this one."""
        bucket, small = _deal(self.anchor, buckets)
        keep = np.zeros(len(bucket), dtype=bool)
        order = np.argsort(bucket, kind="stable")
        for b, rows in _groups(bucket[order], order):
            prints = np.unique(small[rows])
            marks = shared.get(b)
            if marks is not None:
                bits = np.unpackbits(np.frombuffer(marks, np.uint8), count=len(prints)).astype(bool)
                keep[rows] = bits[np.searchsorted(prints, small[rows])]
        order = np.lexsort((self.doc, self.anchor))
        a, d = self.anchor[order], self.doc[order]
        cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, int)
        several = np.zeros(len(cuts), dtype=bool)
        if len(cuts):
            ends = np.append(cuts[1:], len(a))
            several = d[cuts] != d[ends - 1]
            keep[order] |= np.repeat(several, ends - cuts)
        return np.flatnonzero(keep)

    def texts(self, runs: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct texts of runs, the smallest id of each, and the number of each run's text."""
        number: dict[bytes, int] = {}
        data = self.data
        of = np.fromiter(
            (number.setdefault(data[a:b], len(number)) for a, b in zip(self.first[runs].tolist(), (self.last[runs] + LENGTH).tolist(), strict=True)),
            dtype=np.int64, count=len(runs),
        )
        least = np.full(len(number), _NO_ID)
        np.minimum.at(least, of, self.ids[self.doc[runs]])
        return list(number), least, of


def _deal(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _groups(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, values) of each stretch of equal keys."""
    if len(keys):
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(keys[a]), values[a:b]


class Level:
    """A suffix array: the starts of distinct windows in the order of their bytes, and the least id of each."""

    def __init__(self, text: np.ndarray, at: np.ndarray, ids: np.ndarray):
        self.text, self.at, self.ids = text, at, ids

    def __len__(self) -> int:
        return len(self.at)

    def windows(self) -> np.ndarray:
        """The windows' bytes, in order. All are equally long, so numpy's order of them is that of their bytes."""
        return _views(self.text)[self.at]

    def compact(self) -> Level:
        """The same without the text that no window covers."""
        delta = np.zeros(len(self.text) + 1, np.int32)
        np.add.at(delta, self.at, 1)
        np.add.at(delta, self.at + LENGTH, -1)
        covered = np.cumsum(delta[:-1]) > 0
        return Level(self.text[covered], (np.cumsum(covered) - 1)[self.at], self.ids)

    def pack(self) -> bytes:
        import zstandard

        x = self.compact()
        raw = b"".join([len(x.text).to_bytes(8, "little"), x.text.tobytes(), x.at.astype("<u4").tobytes(), x.ids.astype("<i8").tobytes()])
        return zstandard.ZstdCompressor(level=3).compress(raw)

    @classmethod
    def unpack(cls, blob: bytes) -> Level:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(blob)
        size = int.from_bytes(raw[:8], "little")
        n = (len(raw) - 8 - size) // 12
        at = np.frombuffer(raw, "<u4", n, 8 + size).astype(np.int64)
        return cls(np.frombuffer(raw, np.uint8, size, 8), at, np.frombuffer(raw, "<i8", n, 8 + size + 4 * n))


def _views(text: np.ndarray) -> np.ndarray:
    """Every LENGTH-byte string of a text, overlapping and not copied."""
    return np.ndarray((max(0, len(text) - LENGTH + 1),), f"S{LENGTH}", buffer=text, strides=(1,))


def _once(text: np.ndarray, at: np.ndarray, ids: np.ndarray, found: np.ndarray) -> tuple[Level, np.ndarray]:
    """A level of windows in order (found: their bytes), equal ones once with the least id; and each one's place."""
    fresh = np.concatenate([[True], found[1:] != found[:-1]]) if len(found) else np.empty(0, bool)
    first = np.flatnonzero(fresh)
    least = np.minimum.reduceat(ids, first) if len(first) else ids[:0]
    return Level(text, at[first], least), np.cumsum(fresh) - 1


def suffix_array(texts: list[bytes], ids: np.ndarray) -> tuple[Level, np.ndarray]:
    """The level of some texts (LENGTH bytes or more each), and the place in it of each of their windows."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text = np.frombuffer(b"".join(texts), np.uint8)
    windows = lengths - LENGTH + 1
    starts = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    found = _views(text)[starts]
    order = np.argsort(found, kind="stable")
    level, at = _once(text, starts[order], np.repeat(ids, windows)[order], found[order])
    place = np.empty(len(order), np.int32)
    place[order] = at
    return level, place


def scan(level: Level, batch: Level) -> tuple[np.ndarray, np.ndarray]:
    """The windows that two sorted arrays have in common, as their places in each."""
    old, new = level.windows(), batch.windows()
    at = np.searchsorted(old, new)
    inside = np.flatnonzero(at < len(old))
    both = inside[old[at[inside]] == new[inside]]
    return at[both], both


def merge(a: Level, b: Level) -> Level:
    """One level of two: their orders are merged, not sorted anew."""
    found = np.concatenate([a.windows(), b.windows()])
    order = np.argsort(found, kind="stable")  # numpy's stable sort merges what comes as two ordered runs
    at = np.concatenate([a.at, b.at + len(a.text)])
    ids = np.concatenate([a.ids, b.ids])
    return _once(np.concatenate([a.text, b.text]), at[order], ids[order], found[order])[0]


class Family:
    """Levels of suffix arrays, each more than twice as long as the next.

    improved: whether a batch had a window with a smaller id than the levels before it.
    """

    def __init__(self, levels: Iterable[Level] = ()):
        self.levels = list(levels)
        self.improved = False

    def add(self, batch: Level) -> tuple[Level, np.ndarray]:
        """Merge-scan a batch against every level; its windows that no level has with as small an id join.

        Returns what joined, and the smallest id so far of each window of the batch.
        """
        fresh = np.ones(len(batch), dtype=bool)
        least = batch.ids.copy()
        for level in self.levels:
            old, new = scan(level, batch)
            less = batch.ids[new] < level.ids[old]
            self.improved |= bool(less.any())
            fresh[new] &= less
            least[new] = np.minimum(least[new], level.ids[old])
        new = Level(batch.text, batch.at[fresh], batch.ids[fresh])
        joined = new
        if len(joined):
            while self.levels and len(self.levels[-1]) <= 2 * len(joined):
                joined = merge(self.levels.pop(), joined)
            self.levels.append(joined)
        return new, least

    def least(self, batch: Level) -> np.ndarray:
        """The smallest id that has each window of the batch."""
        out = batch.ids.copy()
        for level in self.levels:
            old, new = scan(level, batch)
            out[new] = np.minimum(out[new], level.ids[old])
        return out


def pack(texts: list[bytes], ids: np.ndarray) -> bytes:
    import zstandard

    lengths = np.fromiter(map(len, texts), dtype="<u4", count=len(texts))
    raw = b"".join([len(texts).to_bytes(8, "little"), ids.astype("<i8").tobytes(), lengths.tobytes(), *texts])
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(blob: bytes) -> tuple[list[bytes], np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    ids = np.frombuffer(raw, "<i8", n, 8)
    lengths = np.frombuffer(raw, "<u4", n, 8 + 8 * n).astype(np.int64)
    ends = np.cumsum(lengths) + 8 + 12 * n
    return [raw[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)], ids


def resolve(messages: Iterable[tuple[int, bytes]], family: Family | None = None, added: list[Level] | None = None) -> Iterator[tuple[int, bytes]]:
    """For each (chunk, packed texts) of a bucket: (chunk, a bit for each window: a smaller id has it).

    Messages are read once, each distinct text is kept once. Texts make a batch when they have
    BATCH bytes. family: levels from before; what joins it is also appended to added.
    """
    family = family or Family()
    number: dict[bytes, int] = {}
    least: list[int] = []
    windows: list[int] = []
    parts: list[tuple[int, np.ndarray, np.ndarray]] = []
    made: list[tuple[Level, np.ndarray, np.ndarray]] = []
    texts: list[bytes] = []
    again: dict[bytes, int] = {}  # texts of earlier batches that now come with a smaller id
    size = flushed = 0

    def flush() -> None:
        nonlocal size, flushed
        if texts or again:
            batch, place = suffix_array(texts + list(again), np.array(least[flushed:] + list(again.values()), np.int64))
            new, smallest = family.add(batch)
            if added is not None and len(new):
                added.append(new)
            made.append((batch, place[:sum(windows[flushed:])], smallest))
            flushed, size = len(least), 0
            texts.clear()
            again.clear()

    for chunk, blob in messages:
        some, own = unpack(blob)
        of = np.empty(len(some), np.int32)
        for i, (t, x) in enumerate(zip(some, own.tolist(), strict=True)):
            n = of[i] = number.setdefault(t, len(least))
            if n == len(least):
                texts.append(t)
                least.append(x)
                windows.append(len(t) - LENGTH + 1)
                size += len(t)
            elif x < least[n]:
                least[n] = x
                if n < flushed:
                    size += len(t) * (t not in again)
                    again[t] = x
        parts.append((chunk, of, own))
        if size >= BATCH:
            flush()
    flush()
    del number, texts
    # where ids rise with the batches, what a batch met when it came is final
    found = [(family.least(b) if family.improved else smallest)[place] for b, place, smallest in made]
    found = np.concatenate(found) if found else np.empty(0, np.int64)
    counts = np.array(windows, np.int64)
    ends = np.cumsum(counts)
    for chunk, of, own in parts:
        n = counts[of]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[of] - n, n)
        yield chunk, np.packbits(found[at] < np.repeat(own, n)).tobytes()


def removed(chunk: Chunk, runs: np.ndarray, bits: dict[int, bytes], buckets: int) -> np.ndarray:
    """Which bytes of a chunk go, from the answers about the windows of these runs."""
    texts, least, of = chunk.texts(runs)
    windows = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) - LENGTH + 1
    ends = np.cumsum(windows)
    marks = np.zeros(int(windows.sum()), dtype=bool)
    for b, rows in _by_bucket(chunk, runs, of, len(texts), buckets):
        n = windows[rows]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[rows] - n, n)
        marks[at] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=len(at)).astype(bool)
    n = windows[of]
    shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    # a run of another document than the one that sent its text goes whole
    gone = marks[shift + np.repeat(ends[of] - n, n)] | np.repeat(chunk.ids[chunk.doc[runs]] > least[of], n)
    hit = (shift + np.repeat(chunk.first[runs], n))[gone]
    delta = np.zeros(len(chunk.data) + 1, np.int32)
    np.add.at(delta, hit, 1)
    np.add.at(delta, hit + LENGTH, -1)
    return np.cumsum(delta[:-1]) > 0


def _by_bucket(chunk: Chunk, runs: np.ndarray, of: np.ndarray, n_texts: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, numbers of texts), in the order in which a chunk sends them."""
    anchor = np.zeros(n_texts, np.uint64)
    anchor[of] = chunk.anchor[runs]
    bucket, _ = _deal(anchor, buckets)
    order = np.argsort(bucket, kind="stable")
    yield from _groups(bucket[order], order)


def results(chunk: Chunk, nulls: np.ndarray, gone: np.ndarray) -> Iterator[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    buf = np.frombuffer(chunk.data, np.uint8)
    for i, (a, b) in enumerate(zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True)):
        out = gone[a:b]
        n = int(np.count_nonzero(out))
        if n:
            spans = int(out[0]) + int(np.count_nonzero(out[1:] & ~out[:-1]))
            kept = buf[a:b][~out].tobytes()
        else:
            spans, kept = 0, chunk.data[a:b]
        yield None if nulls[i] else int(chunk.ids[i]), b - a, n, spans, hashlib.sha256(kept).hexdigest()


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk, ids, lengths, n_bytes, data): documents packed into compressed chunks, written once."""
    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0

        def row():
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays([
                pa.array([base + n], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([data], pa.binary()),
            ], names=["chunk", "ids", "lengths", "n_bytes", "data"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                ids.append(i)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= CHUNK or len(ids) >= 1 << 16:
                    yield row()
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield row()

    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(pair.mapInArrow(run, "chunk long, ids array<long>, lengths array<long>, n_bytes long, data binary"), "chunks")


def _opened(b, row: int) -> tuple[Chunk, np.ndarray]:
    """The chunk in a row of a record batch (ids, lengths and data by name), and which ids are null."""
    import zstandard

    ids = b.column("ids")[row].as_py()
    nulls = np.array([i is None for i in ids], dtype=bool)
    known = np.array([_NO_ID if i is None else i for i in ids], dtype=np.int64)
    lengths = np.array(b.column("lengths")[row].as_py(), dtype=np.int64)
    data = zstandard.ZstdDecompressor().decompress(b.column("data")[row].as_py(), max_output_size=int(lengths.sum()) + 1)
    return Chunk(known, lengths, data), nulls


def _by_key(batches) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """(bucket, its (chunk, blob) one by one) from rows (bucket, chunk, blob) in order of bucket."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for bucket, group in itertools.groupby(rows, key=lambda row: row[0]):
        yield bucket, ((chunk, blob) for _, chunk, blob in group)


def send_runs(chunk: Chunk, runs: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """(bucket, packed texts) of these runs of a chunk."""
    texts, least, of = chunk.texts(runs)
    return [(x, pack([texts[i] for i in rows.tolist()], least[rows])) for x, rows in _by_bucket(chunk, runs, of, len(texts), buckets)]


def _gathered(rows: DataFrame, name: str) -> DataFrame:
    """One row per chunk: its (bucket, blob) as a map, a bit for each of the chunk's anchors or windows."""
    return rows.groupBy(F.col("chunk").alias(f"{name}_chunk")).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "blob"))).alias(name))


def _map(b, name: str, row: int) -> dict[int, bytes]:
    return dict(b.column(name)[row].as_py() or [])


def _finish(batches, buckets: int):
    """Results of the chunks in rows (chunk, ids, lengths, data, bits and, if filtered, shared)."""
    import pyarrow as pa

    names = [x.split()[0] for x in RESULT.split(", ")]
    for b in batches:
        for row in range(len(b)):
            chunk, nulls = _opened(b, row)
            runs = chunk.chosen(_map(b, "shared", row), buckets) if "shared" in b.schema.names else np.arange(len(chunk.first))
            gone = removed(chunk, runs, _map(b, "bits", row), buckets)
            columns = zip(*results(chunk, nulls, gone), strict=True)
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _table(rows: list[tuple], names: list[str]):
    import pyarrow as pa

    kinds = {"chunk": pa.int64(), "bucket": pa.int32(), "blob": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(columns, names, strict=True)], names=names)


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    packed = chunks(docs, id_col, text_col)
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(16, -(-total // BUCKET))
    message = "bucket int, chunk long, blob binary"
    wide = ["chunk", "ids", "lengths", "data"]

    def send_prints(batches):
        for b in batches:
            for row in range(len(b)):
                chunk, _ = _opened(b, row)
                number = b.column("chunk")[row].as_py()
                yield _table([(x, number, p.tobytes()) for x, p in chunk.prints(buckets)], ["bucket", "chunk", "blob"])

    def mark_shared(batches):
        for bucket, found in _by_key(batches):
            rows = list(found)
            prints = [np.frombuffer(p, np.uint32) for _, p in rows]
            values, counts = np.unique(np.concatenate(prints), return_counts=True)
            shared = values[counts > 1]
            out = []
            for (chunk, _), p in zip(rows, prints, strict=True):
                at = np.searchsorted(shared, p)
                at[at == len(shared)] = 0
                marks = shared[at] == p if len(shared) else np.zeros(len(p), bool)
                out.append((bucket, chunk, np.packbits(marks).tobytes()))
            yield _table(out, ["bucket", "chunk", "blob"])

    def bucketed(rows: DataFrame) -> DataFrame:
        # a task for each bucket, so that what a task reads and holds doesn't grow with the input
        return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "chunk").select("bucket", "chunk", "blob")

    prints = packed.select(*wide).mapInArrow(send_prints, message)
    shared = materialize(bucketed(prints).mapInArrow(mark_shared, message), "shared")

    def send_texts(batches):
        for b in batches:
            for row in range(len(b)):
                chunk, _ = _opened(b, row)
                number = b.column("chunk")[row].as_py()
                runs = chunk.chosen(_map(b, "shared", row), buckets)
                yield _table([(x, number, blob) for x, blob in send_runs(chunk, runs, buckets)], ["bucket", "chunk", "blob"])

    def index(batches):
        for bucket, rows in _by_key(batches):
            for chunk, bits in resolve(rows):
                yield _table([(bucket, chunk, bits)], ["bucket", "chunk", "blob"])

    known = packed.select(*wide).join(_gathered(shared, "shared"), F.col("chunk") == F.col("shared_chunk"), "left").select(*wide, "shared")
    bits = bucketed(known.mapInArrow(send_texts, message)).mapInArrow(index, message)
    told = known.join(_gathered(bits, "bits"), F.col("chunk") == F.col("bits_chunk"), "left").select(*wide, "shared", "bits")
    return told.mapInArrow(lambda batches: _finish(batches, buckets), RESULT)


class SuffixIndex:
    """The family kept in a folder: each level is a table of (bucket, n, blob), a Level for each bucket.

    Every append writes one level and merges levels while the last is not more than twice as large
    as the new one. A manifest names the levels in use; it is written last, so an append that fails
    leaves the index as it was.
    """

    def __init__(self, spark, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [str(f.getPath().getName()) for f in self._files.listStatus(self._path(self.folder))] if self._files.exists(self._path(self.folder)) else []
        self.version = max((int(n.split("-")[1]) for n in names if n.startswith("manifest-")), default=0)
        self.buckets, self.levels = buckets, []
        if self.version:
            rows = spark.read.parquet(f"{self.folder}/manifest-{self.version:06d}").orderBy("nth").collect()  # a row for each level
            self.buckets, self.levels = rows[0]["buckets"], [(r["name"], r["n"]) for r in rows if r["name"]]

    def _level(self, name: str) -> DataFrame:
        return self.spark.read.schema("bucket int, n long, blob binary").parquet(f"{self.folder}/{name}")

    def _write(self, level: DataFrame) -> tuple[str, int]:
        name = f"level-{uuid.uuid4().hex}"
        level.write.parquet(f"{self.folder}/{name}")
        return name, self._level(name).agg(F.sum("n")).first()[0] or 0

    def _commit(self, levels: list[tuple[str, int]]) -> None:
        old, self.levels, self.version = self.levels, levels, self.version + 1
        rows = [(self.buckets, i, *level) for i, level in enumerate(levels)] or [(self.buckets, 0, None, 0)]
        self.spark.createDataFrame(rows, "buckets int, nth int, name string, n long").coalesce(1).write.parquet(
            f"{self.folder}/manifest-{self.version:06d}")
        for name in {n for n, _ in old} - {n for n, _ in levels}:
            self._files.delete(self._path(f"{self.folder}/{name}"), True)
        self._files.delete(self._path(f"{self.folder}/manifest-{self.version - 1:06d}"), True)

    def _bucketed(self, rows: DataFrame, *order: str) -> DataFrame:
        return rows.repartitionById(self.buckets, F.col("bucket")).sortWithinPartitions("bucket", *order)

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a table; what dedup_spans() returns for its rows, with the tables added before counted in.

        Results of earlier tables stay as they were: tables should come in the order of their ids.
        """
        prepare(self.spark)
        buckets = self.buckets
        packed = chunks(docs, id_col, text_col)
        wide = ["chunk", "ids", "lengths", "data"]
        names = ["bucket", "chunk", "blob"]

        def send(batches):
            for b in batches:
                for row in range(len(b)):
                    chunk, _ = _opened(b, row)
                    out = send_runs(chunk, np.arange(len(chunk.first)), buckets)
                    yield _table([(x, b.column("chunk")[row].as_py(), blob) for x, blob in out], names)

        def index(batches):
            for bucket, rows in _by_key(batches):
                levels = []
                messages = _levels_first(rows, levels)
                added: list[Level] = []
                for chunk, bits in resolve(messages, Family(levels), added):
                    yield _table([(bucket, chunk, bits)], names)
                if added:
                    new = added[0]
                    for more in added[1:]:
                        new = merge(new, more)
                    yield _table([(bucket, -len(new), new.pack())], names)

        # levels come before the chunks' messages, numbered below zero
        rows = packed.select(*wide).mapInArrow(send, "bucket int, chunk long, blob binary")
        for i, (name, _) in enumerate(self.levels):
            rows = rows.union(self._level(name).select("bucket", F.lit(i - len(self.levels)).cast("long").alias("chunk"), "blob"))
        answers = materialize(self._bucketed(rows, "chunk").select(*names).mapInArrow(index, "bucket int, chunk long, blob binary"), "answers")
        new = answers.where("chunk < 0").select("bucket", (-F.col("chunk")).alias("n"), "blob")
        levels = [*self.levels, self._write(new)]
        while len(levels) > 1 and levels[-2][1] <= 2 * levels[-1][1]:
            levels[-2:] = [self._write(self._merged(levels[-2][0], levels[-1][0]))]
        written = {n for n, _ in levels} | {n for n, _ in self.levels}
        self._commit(levels)
        for f in self._files.listStatus(self._path(self.folder)):  # levels that merged at once
            name = str(f.getPath().getName())
            if name.startswith("level-") and name not in {n for n, _ in levels} | written:
                self._files.delete(f.getPath(), True)
        told = packed.select(*wide).join(_gathered(answers.where("chunk >= 0"), "bits"), F.col("chunk") == F.col("bits_chunk"), "left")
        found = materialize(told.select(*wide, "bits").mapInArrow(lambda batches: _finish(batches, buckets), RESULT), "spans")
        drop_scratch(answers)
        drop_scratch(packed)
        return found

    def _merged(self, a: str, b: str) -> DataFrame:
        def run(batches):
            rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for bucket, group in itertools.groupby(rows, key=lambda row: row[0]):
                level, *rest = [Level.unpack(blob) for _, blob in group]
                for more in rest:
                    level = merge(level, more)
                yield _level_row(bucket, level)

        both = self._level(a).union(self._level(b)).select("bucket", "blob")
        return self._bucketed(both).mapInArrow(run, "bucket int, n long, blob binary")


def _level_row(bucket: int, level: Level):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([len(level)], pa.int64()), pa.array([level.pack()], pa.binary())], names=["bucket", "n", "blob"])


def _levels_first(rows: Iterator[tuple[int, bytes]], levels: list[Level]) -> Iterator[tuple[int, bytes]]:
    """Takes the levels off the front of a bucket's rows; the messages that follow."""
    for chunk, blob in rows:
        if chunk >= 0:
            return itertools.chain([(chunk, blob)], rows)
        levels.append(Level.unpack(blob))
    return iter(())
