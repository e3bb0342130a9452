"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised: letters and digits in lower case, every other run one blank. Each benchmark
item is covered by windows of LENGTH code points every STEP, the last one flush with its end (a
shorter item is one window), and by windows of WORDS words that begin at every word. So a passage
of WORDS words taken from anywhere in an item is found, and one of LENGTH + STEP - 1 code points
whatever its words. Equal windows are one, owned by the item of the smallest id. A window of m
code points that occurs in a document with k edits or fewer shares m + 1 - q (k + 1) of its
q-grams with it at least, all within k of one diagonal.

1. Filter: only stretches of a document in which enough q-grams occur in any window go on.
2. Equal text: where a window's first q-gram hits, hashes of the document's next stretches, one for each length that such
   windows have, are looked up among the windows' hashes and compared. Equal text needs no alignment.
3. Count: the hits are laid on diagonal bands of the items joined end to end; bands are
   2 (k + 1) wide and overlap by half, so all hits of one occurrence fall into one band. Only windows
   with as many hits in a band as the bound asks for go on, and only where one of these hits reaches out of equal text:
   else the place is known to be a benchmark's, whatever number of items share it.
4. Verify: of the candidates those whose middle lies in equal text are left out for the same reason; the rest must end
   within k edits by banded alignment.

A result is a stretch of a document that windows of one item cover.

The windows' q-gram index is broadcast in pieces of at most INDEX_CHARS code points, one at a time
on the driver: a larger benchmark takes several passes over the documents.

Cases: null and empty texts match nothing; items of fewer than MIN_LENGTH normalised code points
must occur without an edit, those of fewer than Q are skipped (too short to tell); null ids match
like others, equal rows match separately; an empty table on either side gives an empty result;
further columns are ignored by matches(), kept by remove(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

Q = 12
LENGTH = 80
STEP = 4
#: Words of the shorter windows; they have MIN_LENGTH code points at least, and 2 LENGTH at most.
WORDS = 13
EDIT_RATE = 0.05
MIN_LENGTH = 32
INDEX_CHARS = 4_000_000
#: The first filter is a table of 2^TABLE_BITS flags, or of sixteen for each q-gram.
TABLE_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
#: Code points of documents handled at once; a longer document is handled alone.
_CHUNK = 1 << 18
_PAIRS = 1 << 20
_SCHEMA = "doc_id long, item_id long, doc_start long, doc_end long, n_windows int, edits int"


@lru_cache(maxsize=1)
def _lower_table() -> np.ndarray:
    """Code point -> its lower-case code point, 32 (a blank) if it is neither letter nor digit."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalnum():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalise(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points and the position of each in the given ones."""
    low = _lower_table()[codes]
    blank = low == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    at = np.flatnonzero(keep)
    return low[at], at


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _join(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> np.ndarray:
    """Polynomials of n_a + n_b terms: those of a, then those of b."""
    tail = b[n_a:]
    return a[:len(tail)] * np.uint64(pow(int(_BASE), n_b, 1 << 64)) + tail


def qgrams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all q-grams."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # a polynomial of q terms from those of 1, 2, 4 and so on
    part, length, factor = codes.astype(np.uint64), 1, int(_BASE)
    out, done = None, 0
    left = q
    while left:
        if left & 1:
            out = part if out is None else _join(out, done, part, length)
            done += length
        left >>= 1
        if left:
            part = part[:-length] * np.uint64(factor) + part[length:]
            length, factor = 2 * length, factor * factor % (1 << 64)
    out = out[:n] * _MIX
    return out ^ (out >> np.uint64(29))


def bound(m: int, q: int = Q, rate: float = EDIT_RATE) -> tuple[int, int]:
    """Edits allowed in a window of m code points, and the shared q-grams that they leave (1 at least)."""
    k = int(rate * m) if m >= MIN_LENGTH else 0
    while k and m + 1 - q * (k + 1) < 1:
        k -= 1
    return k, max(1, m + 1 - q * (k + 1))


def _spans(norm: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each window of a normalised item."""
    n = len(norm)
    spans = {(s, min(n, s + LENGTH)) for s in range(0, max(1, n - LENGTH + 1), STEP)} | {(max(0, n - LENGTH), n)}
    ends = np.append(np.flatnonzero(norm == 32), n)
    begins = np.append(0, ends[:-1] + 1)
    for i in range(len(begins) - WORDS + 1):
        s = int(begins[i])
        j = max(i + WORDS - 1, int(np.searchsorted(ends, s + MIN_LENGTH)))
        if j < len(ends) and ends[j] - s <= 2 * LENGTH:
            spans.add((s, int(ends[j])))
    return sorted(spans)


def trimmed(text: str | None) -> np.ndarray:
    """The normalised code points of an item, without blanks at its ends."""
    norm, _ = normalise(codes_of(text or ""))
    inside = np.flatnonzero(norm != 32)
    return norm[inside[0]:inside[-1] + 1] if len(inside) else norm[:0]


def cut(item: int, norm: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """A normalised item in parts of at most `most` code points that keep every window whole."""
    step = max(STEP, (most - 4 * LENGTH) // STEP * STEP)
    for at in range(0, max(1, len(norm) - 4 * LENGTH), step):
        yield item, norm[at:at + step + 4 * LENGTH]


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of code points times powers of the base, those powers and their inverses: hashes of any stretch."""
    power, inverse = (np.full(len(codes) + 1, x, dtype=np.uint64) for x in (_BASE, _INVERSE))
    power[0] = inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return sums, power, inverse


def _digest(sums: np.ndarray, inverse: np.ndarray, at: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Hashes of the stretches of m code points from `at`, wherever they lie."""
    return (sums[at + m] - sums[at]) * inverse[at] + m.astype(np.uint64) * _MIX


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) for the numbers of the ranges low to high, high exclusive."""
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(low)), count)
    return which, low[which] + np.arange(len(which)) - (np.cumsum(count) - count)[which]


class Index:
    """The windows of some normalised items and where each q-gram occurs in the items joined end to end."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        owner: dict[bytes, None] = {}
        begins: list[tuple[int, int, int]] = []
        base = 0
        kept: list[np.ndarray] = []
        for item, norm in items:
            if len(norm) < Q:
                continue
            for s, e in _spans(norm):
                window = norm[s:e].tobytes()
                if window not in owner:
                    owner[window] = None
                    begins.append((base + s, e - s, item))
            kept.append(norm)
            base += len(norm)
        begins.sort()
        self.codes = np.concatenate(kept) if kept else np.empty(0, np.uint32)
        self.text = len(self.codes)
        self.at, self.m, self.item = (np.array(x, dtype=np.int64) for x in zip(*begins, strict=True)) if begins else (np.empty(0, np.int64),) * 3
        limits = {m: bound(m) for m in set(self.m.tolist())}
        self.k = np.array([limits[m][0] for m in self.m.tolist()], dtype=np.int64)
        self.least = np.array([limits[m][1] for m in self.m.tolist()], dtype=np.int64)
        # only q-grams inside a window count
        inside = np.zeros(self.text + 1, dtype=np.int64)
        np.add.at(inside, self.at, 1)
        np.add.at(inside, self.at + self.m - Q + 1, -1)
        grams = qgrams(self.codes)
        pos = np.flatnonzero(np.cumsum(inside[:len(grams)]) > 0)
        grams = grams[pos]
        order = np.argsort(grams, kind="stable")
        self.keys, first = np.unique(grams[order], return_index=True)
        self.first = np.append(first, len(grams))
        self.pos = pos[order]
        bits = max(TABLE_BITS, (16 * len(self.keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True
        self.span = int((self.m + self.k).max(initial=0))
        self.fewest = int(self.least.min(initial=1))
        # what equals a window: the lengths of the windows that begin with each q-gram, and all windows' hashes in order
        head = np.searchsorted(self.keys, qgrams(self.codes)[self.at]) if len(self.at) else np.empty(0, np.int64)
        pairs = _distinct(head * (self.span + 1) + self.m)
        self.lengths = pairs % (self.span + 1)
        self.first_length = np.searchsorted(pairs, np.arange(len(self.keys) + 1) * (self.span + 1))
        digest = _digest(*_prefix(self.codes)[::2], self.at, self.m)
        self.by_digest = np.argsort(digest, kind="stable")
        self.digests = digest[self.by_digest]

    def window(self, w: int) -> np.ndarray:
        return self.codes[self.at[w]:self.at[w] + self.m[w]]

    def find(self, codes: np.ndarray, doc: np.ndarray, every: bool = False) -> list[tuple[int, int, int, int, int]]:
        """(window, document, start, end, edits) in normalised positions; doc: of each code point.

        every: align also the windows whose middle lies in equal text.
        """
        n = len(codes) - Q + 1
        if n <= 0 or not len(self.keys):
            return []
        grams = qgrams(codes)
        hit = self.seen[(grams >> self.shift).astype(np.int64)] & (doc[:n] == doc[Q - 1:])
        at = np.flatnonzero(hit)
        place = np.searchsorted(self.keys, grams[at])
        place[place == len(self.keys)] = 0
        true = self.keys[place] == grams[at]
        at, place = at[true], place[true]
        # enough hits within a window's length, after or before, else no window can be there
        need, reach = self.fewest, self.span
        if need > 1:
            after = np.searchsorted(at, at + reach) - np.arange(len(at))
            dense = after >= need
            cover = np.zeros(len(at) + 1, np.int64)
            np.add.at(cover, np.flatnonzero(dense), 1)
            np.add.at(cover, (np.arange(len(at)) + after)[dense], -1)
            inside = np.cumsum(cover[:-1]) > 0
            at, place = at[inside], place[inside]
        out, covered = self._equal(codes, doc, at, place)
        # hits more than half in equal text name no further window, but add to those of the windows that reach out of it
        bare = np.concatenate([[0], np.cumsum(covered == 0)])
        inside = (bare[Q:Q + n] - bare[:n] < Q // 2) & (not every)
        cover = np.concatenate([[0], np.cumsum(inside)])
        own = ~inside[at]
        at, place = at[own], place[own]
        beside = cover[np.minimum(at + reach, n)] > cover[np.maximum(at - reach, 0)]
        lists = self.first[place + 1] - self.first[place]
        # pieces of bounded work; windows' lengths overlap so that no band is torn
        found, start = [], 0
        wide = len(codes) + 2 * (self.span + 1)  # a candidate's first place is no further outside
        while start < len(at):
            total = np.cumsum(lists[start:])
            stop = start + int(np.searchsorted(total, _PAIRS))
            stop = max(stop, int(np.searchsorted(at, at[start] + 4 * reach)))
            w, left = self._count(at[start:stop], place[start:stop], lists[start:stop], beside[start:stop], cover)
            found.append(w * wide + left + self.span + 1)
            if stop >= len(at):
                break
            start = int(np.searchsorted(at, at[stop - 1] - 2 * reach))
        both = _distinct(np.concatenate(found)) if found else np.empty(0, np.int64)
        w, left = both // wide, both % wide - self.span - 1
        return list(dict.fromkeys(out + self._verify(codes, doc, w, left, covered, every)))

    def _equal(self, codes, doc, at, place):
        """(occurrences of windows' very text, how many of them cover each code point) from the places of hits."""
        which, entry = _spread(self.first_length[place], self.first_length[place + 1])
        begin, m = at[which], self.lengths[entry]
        fits = begin + m <= len(codes)
        begin, m = begin[fits], m[fits]
        same = doc[begin] == doc[begin + m - 1]
        begin, m = begin[same], m[same]
        covered = np.zeros(len(codes) + 1, dtype=np.int64)
        digest = _digest(*_prefix(codes)[::2], begin, m)
        spot = np.searchsorted(self.digests, digest)
        spot[spot == len(self.digests)] = 0
        out = []
        for i in np.flatnonzero(self.digests[spot] == digest).tolist():
            w, s, e = int(self.by_digest[spot[i]]), int(begin[i]), int(begin[i] + m[i])
            if np.array_equal(codes[s:e], self.window(w)):
                out.append((w, int(doc[s]), s, e, 0))
                covered[s] += 1
                covered[e] -= 1
        covered = np.cumsum(covered[:-1])
        # a gap that no q-gram fits in is no text of its own
        turn = np.diff(np.concatenate([[0], (covered == 0).astype(np.int8), [0]]))
        low, high = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        gap = (low > 0) & (high < len(codes)) & (high - low < Q)
        gap[gap] = doc[low[gap] - 1] == doc[high[gap]]
        _, filled = _spread(low[gap], high[gap])
        covered[filled] = 1
        return out, covered

    def _count(self, at, place, lists, beside, cover):
        """The candidates that have enough hits in a band: windows, and the first place for the begin of each.

        beside: hits that have equal text near them; cover: how many q-grams before each place lie in equal text. They
        may all be hits, so beside them a window needs fewer hits of its own, one at least.
        """
        each, entry = _spread(self.first[place], self.first[place] + lists)
        pos = self.pos[entry]
        diagonal = at[each] - pos + self.text  # not negative
        block = self.text + self.span + 1
        found = [np.empty((2, 0), np.int64)]
        for k in np.unique(self.k):
            mine = np.flatnonzero(self.k == k)
            begin, reach, need = self.at[mine], int(self.m[mine].max()) - Q, int(self.least[mine].min())
            width = int(k) + 1
            band = diagonal // width

            def keys(hits):
                # an occurrence's diagonals lie within k of its own: in this band and the next, or the one before
                return _distinct(np.concatenate([band[hits] + 1, band[hits]]) * block + np.concatenate([pos[hits], pos[hits]]))

            def hits_in(w, home):
                return (np.searchsorted(key, home + self.at[w] + self.m[w] - Q, side="right")
                        - np.searchsorted(key, home + self.at[w]))

            key = keys(slice(None))
            if len(key) >= need:
                near = np.flatnonzero(key[need - 1:] - key[:len(key) - need + 1] <= reach)
                base = key[near] // block * block
                low = np.searchsorted(begin, key[near + need - 1] - reach - base)
                high = np.searchsorted(begin, key[near] - base, side="right")
                # bounds rise inside a band: take each window once
                again = np.flatnonzero(np.diff(base) == 0) + 1
                low[again] = np.maximum(low[again], high[again - 1])
                which, entry = _spread(low, high)
                w, home = mine[entry], base[which]
                enough = hits_in(w, home) >= self.least[w]
                w, b = w[enough], home[enough] // block - 1
                found.append(np.stack([w, b * width - self.text + self.at[w]]))
            if beside.any():
                some = keys(beside[each])
                base = some // block * block
                which, entry = _spread(np.searchsorted(begin, some - reach - base), np.searchsorted(begin, some - base, side="right"))
                w, home = mine[entry], base[which]
                left = (home // block - 1) * width - self.text + self.at[w]
                low, high = (np.clip(x, 0, len(cover) - 1) for x in (left, left + self.m[w] + 2 * width))
                hits = hits_in(w, home)
                enough = (hits > 0) & (hits + cover[high] - cover[low] >= self.least[w])
                found.append(np.stack([w[enough], left[enough]]))
        return np.concatenate(found, axis=1)

    def _verify(self, codes, doc, w, left, covered, every):
        """The occurrences within k edits in each candidate band; left: its first place for the window's begin.

        covered: how many windows' very text covers each code point; those occurrences are known.
        """
        if not len(w):
            return []
        out = []
        # equal text: by polynomial hashes on each diagonal
        sums, _, inverse = _prefix(codes)
        own, _, own_inverse = _prefix(self.codes)
        m, rest = self.m[w], np.ones(len(w), dtype=bool)
        value = _digest(own, own_inverse, self.at[w], m)
        for d in range(int(2 * self.k.max() + 2)):
            at = left + d
            maybe = np.flatnonzero(rest & (d < 2 * self.k[w] + 2) & (at >= 0) & (at + m <= len(codes)))
            rest[maybe[_digest(sums, inverse, at[maybe], m[maybe]) == value[maybe]]] = False
        if not every:
            middle = np.clip(left + self.k[w] + m // 2, 0, len(codes) - 1)
            rest &= covered[middle] == 0
        w, left = w[rest], left[rest]
        for i in range(0, len(w), 4096):
            out += self._align(codes, doc, w[i:i + 4096], left[i:i + 4096])
        return out

    def _align(self, codes, doc, w, left):
        """Banded alignment of each window with its stretch, all at once, row by row."""
        width = self.k[w] + 1
        n_diag = int(2 * width.max())
        longest = int(self.m[w].max())
        text = np.zeros((len(w), longest), dtype=np.uint32)
        for row, x in enumerate(w.tolist()):
            text[row, :self.m[x]] = self.window(x)
        cols = np.arange(n_diag)
        far = 1 << 20
        inside = cols[None, :] < (2 * width)[:, None]
        cost = np.where(inside, 0, far).astype(np.int64)  # the occurrence may begin on any diagonal
        began = left[:, None] + cols[None, :]
        home = doc[np.clip(left + width, 0, len(codes) - 1)]
        best_cost = cost.copy()
        best_began = began.copy()
        for i in range(longest):
            pos = left[:, None] + i + cols[None, :]
            ok = (pos >= 0) & (pos < len(codes))
            safe = np.clip(pos, 0, len(codes) - 1)
            same = ok & (codes[safe] == text[:, i][:, None]) & (doc[safe] == home[:, None])
            new = cost + ~same
            src = began.copy()
            # a code point of the window that the document lacks: from the next diagonal of the row above
            up = np.full_like(cost, far)
            up[:, :-1] = cost[:, 1:] + 1
            better = up < new
            new = np.where(better, up, new)
            src[:, :-1] = np.where(better[:, :-1], began[:, 1:], src[:, :-1])
            # one more in the document: from the diagonal before, in this row
            for c in range(1, n_diag):
                over = new[:, c - 1] + 1
                less = over < new[:, c]
                new[:, c] = np.where(less, over, new[:, c])
                src[:, c] = np.where(less, src[:, c - 1], src[:, c])
            new = np.where(inside, new, far)
            cost, began = new, src
            ends = self.m[w] == i + 1
            best_cost[ends], best_began[ends] = cost[ends], began[ends]
        c = best_cost.argmin(axis=1)
        rows = np.arange(len(w))
        edits, start = best_cost[rows, c], best_began[rows, c]
        end = left + c + self.m[w]
        good = edits <= self.k[w]
        return [
            (int(x), int(h), int(s), int(e), int(d))
            for x, h, s, e, d in zip(w[good], home[good], start[good], end[good], edits[good], strict=True)
        ]


def _batches(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(places, texts) of the documents that have text, in groups of about _CHUNK code points."""
    places, group, size = [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        places.append(i)
        group.append(t)
        size += len(t)
        if size >= _CHUNK:
            yield places, group
            places, group, size = [], [], 0
    if group:
        yield places, group


def find_in(index: Index, texts: list[str]) -> list[tuple]:
    """(place in texts, item, start, end, windows, edits): stretches that windows of one item cover; edits: the fewest."""
    joined = "\x00".join(texts)
    codes = codes_of(joined)
    lengths = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(lengths) - lengths
    norm, at = normalise(codes)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, np.append(starts, len(codes) + 1))))
    found = []
    for w, d, s, e, edits in index.find(norm, doc):
        s, e = max(0, s), min(len(at), max(s + 1, e))
        found.append((d, int(index.item[w]), int(at[s] - starts[d]), int(at[e - 1] - starts[d]) + 1, edits))
    out: list[list[int]] = []
    for d, item, s, e, edits in sorted(found):
        if out and out[-1][:2] == [d, item] and s <= out[-1][3]:
            out[-1][3:] = [max(e, out[-1][3]), out[-1][4] + 1, min(edits, out[-1][5])]
        else:
            out.append([d, item, s, e, 1, edits])
    return [tuple(x) for x in out]


_memo: dict[str, object] = {}


def _index(items: list[tuple[int, np.ndarray]]) -> Index:
    """The index of broadcast items, built once in a worker."""
    if _memo.get("items") is not items:
        _memo.update(items=items, index=Index(items))
    return _memo["index"]


def pieces(benchmark: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The normalised items in order of their ids, INDEX_CHARS code points at a time."""
    piece: list[tuple[int, np.ndarray]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        for item, norm in cut(-1 if row[0] is None else row[0], trimmed(row[1]), INDEX_CHARS):
            if size and size + len(norm) > INDEX_CHARS:
                yield piece
                piece, size = [], 0
            piece.append((item, norm))
            size += len(norm)
    yield piece


def _broadcasts(spark: SparkSession, benchmark: DataFrame) -> list:
    prepare(spark)
    return [spark.sparkContext.broadcast(piece) for piece in pieces(benchmark)]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per stretch: doc_id, item_id, code points of the document, windows in it, the fewest edits."""
    pair = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def search(shared) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            names = [x.split()[0] for x in _SCHEMA.split(", ")]
            kinds = [pa.int32() if x.endswith("int") else pa.int64() for x in _SCHEMA.split(", ")]
            index = _index(shared.value)
            for b in batches:
                ids = b.column(0).to_pylist()
                for places, texts in _batches(b.column(1).to_pylist()):
                    rows = [(ids[places[d]], *rest) for d, *rest in find_in(index, texts)]
                    if rows:
                        columns = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        return pair.mapInArrow(run, _SCHEMA)

    return reduce(DataFrame.union, [search(x) for x in _broadcasts(docs.sparkSession, benchmark)])


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a passage of the benchmark; columns as given. Rows are judged
    one by one where they lie: ids play no part and nothing is shuffled."""
    at = docs.columns.index("text")

    def clean(shared, rows: DataFrame) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            index = _index(shared.value)
            for b in batches:
                bad = {places[d] for places, texts in _batches(b.column(at).to_pylist()) for d, *_ in find_in(index, texts)}
                yield b.filter(pa.array([i not in bad for i in range(len(b))], pa.bool_())) if bad else b

        return rows.mapInArrow(run, rows.schema)

    return reduce(lambda rows, shared: clean(shared, rows), _broadcasts(docs.sparkSession, benchmark), docs)
