"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a hashed order, form blocks. With share u, block j of a source is released
at slot floor(j / u) and due at ceil((j + 1) / u); each slot takes the released block with the
earliest deadline, so after every slot each source is within one block of its share. Shares are
multiples of 1/Q, at least 1/Q, so a schedule repeats after Q slots and one period, of fixed size,
tells the slot of any block. Every row is placed exactly once.

When one of the PHASES - 1 sources of the largest weight runs out, a new phase starts in which the
other sources' shares are their weights' parts. When a smaller one runs out, its slots stay empty
until the phase ends: the others keep their proportions, and stay within one block of their shares
of all slots, the empty ones counted.

Cases: null is a source of its own; sources without a weight share what the smallest weight has,
a weight of zero counts as a millionth of that; weights of absent sources are ignored; ties of the
hashed order are broken by the id, equal rows are interchangeable; an empty table gives an empty
result; further columns are kept.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, ranked, shelter

Q = 4096
BLOCK_ROWS = 16
ALPHA = 0.5
#: Pieces in which a source's rows are ranked.
CELLS = 512
#: Schedules that are computed, at most; each has max(Q, 4 x sources) slots.
PHASES = 16
#: Rows of a schedule that may be broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 1 << 20


def shares(weights: Mapping[str, float], q: int = Q) -> dict[str, int]:
    """Weights as whole parts of q by largest remainders, one part at least; q grows with many sources."""
    q = max(q, 4 * len(weights))
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) * q / total for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    while (over := sum(parts.values()) - q) != 0:
        step = -1 if over > 0 else 1
        able = [s for s in parts if step > 0 or parts[s] > 1]
        best = sorted(able, key=lambda s: (-step * (exact[s] - parts[s]), s))[: abs(over)]
        for s in best:
            parts[s] += step
    return parts


def schedule(parts: Mapping[str, int]) -> list[tuple[str, int]]:
    """One period of the EDF schedule of Pfair windows: (source, block of the period) by slot."""
    q = sum(parts.values())
    released: list[tuple[int, str, int]] = []
    waiting = [(0, s, 0) for s in sorted(parts)]
    heapq.heapify(waiting)
    out = []
    for slot in range(q):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(released, (-(-(j + 1) * q // parts[s]), s, j))
        _, s, j = heapq.heappop(released)
        out.append((s, j))
        if j + 1 < parts[s]:
            heapq.heappush(waiting, ((j + 1) * q // parts[s], s, j + 1))
    return out


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], q: int = Q) -> tuple[list[tuple], list[tuple]]:
    """(source, phase, first block, end block, base slot, parts, period) and (source, phase, slots of its blocks in a period)."""
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    large = set(sorted(left, key=lambda s: (-weights[s], s))[:PHASES - 1])
    spans, pattern, base, phase = [], [], 0, 0
    while left:
        parts = {next(iter(left)): 1} if len(left) == 1 else shares({s: weights[s] for s in left}, q)
        period = sum(parts.values())
        at: dict[str, list[int]] = {s: [] for s in parts}
        for slot, (s, _) in enumerate(schedule(parts)):
            at[s].append(slot)
        last = {s: (n - 1) // parts[s] * period + at[s][(n - 1) % parts[s]] for s, n in left.items()}
        ends = [last[s] for s in large if s in left]
        length = 1 + (min(ends) if ends else max(last.values()))
        whole, rest = divmod(length, period)
        for s in list(left):
            n = min(left[s], whole * parts[s] + bisect_left(at[s], rest))
            spans.append((s, phase, done[s], done[s] + n, base, parts[s], period))
            pattern.append((s, phase, at[s]))
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        base, phase = base + length, phase + 1
    return spans, pattern


def mix(
    docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: Mapping[str, float] | None = None,
    block_rows: int = BLOCK_ROWS, alpha: float = ALPHA, q: int = Q, seed: int = 17,
) -> DataFrame:
    """docs with mix_block (of its source), mix_slot and mix_pos (place in the whole order, gaps where blocks are short).

    weights: target weight of each source; by default its row count to the power alpha.
    One count per source reaches the driver.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_block", "mix_slot", "mix_pos")
    src, cell, rank, phase, idx, spans_of = (free_name(docs, x) for x in ("_src", "_cell", "_rank", "_phase", "_idx", "_spans"))
    # the marker before a name keeps null apart from every string
    named = F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source_col).cast("string")))
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    rows = docs.select("*", named.alias(src), F.pmod(key, F.lit(CELLS)).cast("int").alias(cell))
    counts = {s: n for s, n in rows.groupBy(src).count().collect()}
    if weights is None:
        target = {s: float(n) ** alpha for s, n in counts.items()}
    else:
        least = min((w for w in weights.values() if w > 0), default=1.0)
        target = {s: max(float(weights.get(s[1:] if s[0] == "1" else None, least)), least * 1e-6) for s in counts}
    spans, pattern = phases({s: -(-n // block_rows) for s, n in counts.items()}, target, q)

    def small(columns: dict[str, list], types: list) -> DataFrame:
        import pyarrow as pa

        arrays = [pa.array(c, t) for c, t in zip(columns.values(), types, strict=True)]
        out = spark.createDataFrame(pa.Table.from_arrays(arrays, names=list(columns)))
        return F.broadcast(out) if len(arrays[0]) <= BROADCAST_ROWS else out

    import pyarrow as pa

    # a source's spans are one row; a block finds its own among them, PHASES at most
    of: dict[str, list[tuple]] = {}
    for s, *span in spans:
        of.setdefault(s, []).append(tuple(span))
    fields = ("phase", "first", "end", "base", "parts", "period")
    kind = pa.list_(pa.struct([(f, pa.int64()) for f in fields]))
    span = small({src: list(of), spans_of: [[dict(zip(fields, x, strict=True)) for x in of[s]] for s in of]}, [pa.string(), kind])
    slots = small({
        src: [s for s, _, at in pattern for _ in at], phase: [p for _, p, at in pattern for _ in at],
        idx: [j for *_, at in pattern for j in range(len(at))], "mix_slot": [x for *_, at in pattern for x in at],
    }, [pa.string(), pa.int64(), pa.int64(), pa.int64()])
    rows = ranked(rows, src, cell, [key, F.col(id_col)], rank)
    rows = rows.withColumn("mix_block", F.floor(F.col(rank) / block_rows)).join(span, src)
    mine = F.filter(spans_of, lambda x: (x["first"] <= F.col("mix_block")) & (F.col("mix_block") < x["end"]))[0]
    rows = rows.withColumn(spans_of, mine)
    nth = F.col("mix_block") - F.col(spans_of)["first"]
    rows = rows.withColumn(phase, F.col(spans_of)["phase"]).withColumn(idx, nth % F.col(spans_of)["parts"]).join(slots, [src, phase, idx])
    slot = F.col(spans_of)["base"] + F.floor(nth / F.col(spans_of)["parts"]) * F.col(spans_of)["period"] + F.col("mix_slot")
    rows = rows.withColumn("mix_slot", slot).withColumn("mix_pos", slot * block_rows + F.col(rank) % block_rows)
    return rows.drop(src, cell, rank, phase, idx, spans_of)


def arrange(docs: DataFrame, **options) -> DataFrame:
    """docs in the order of the schedule, columns as given: partitions, and so the files of a write,
    follow one another, and rows inside them."""
    safe, back = shelter(docs, "mix_block", "mix_slot", "mix_pos")
    return back(mix(safe, **options).repartitionByRange("mix_pos").sortWithinPartitions("mix_pos"))
