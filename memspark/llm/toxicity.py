"""Toxicity scores by a factorization machine over hashed terms.

A text is cut into terms (runs of letters; ASCII lower-cased, digits and ASCII punctuation part
them). Its features are binary: a hashed term occurs, and it occurs twice or more. From a bounded
sample of labelled rows a factorization machine is fitted: the score of a text is
sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>), so a pair of terms can count although neither
does alone. Features are taken on two grounds: their own association with the label (FEATURES of
them), and their interaction with another term, tested on all pairs of the PAIR_TERMS commonest
terms of the sample (PAIR_FEATURES of them). So a term that means nothing by itself is learnt too.

The sample: the MAX_TRAIN labelled rows with the smallest hash of doc_id, one text for each id.
Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1.

Cases: null text counts as empty and gets the score of no features; null ids are scored, not held
out; several labels of one id: the largest; several texts of one id: the one with the least hash
is learnt; null labels are ignored; without labels of both kinds every score is the smoothed rate
of label 1; equal rows score equally; an empty table gives an empty result; further columns are
kept, names that clash with the new ones are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from hashlib import blake2b
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_text, prepare, shelter, text_bytes

MAX_TRAIN = 12_000
FEATURES = 512
FACTORS = 8
BITS = 22
_MASK = (1 << BITS) - 1
#: A term's beginnings of so many bytes are features too.
PREFIXES = (4, 5, 6)
MEMO = 150_000
#: A feature must be in so many training rows: rarer ones are learnt by heart.
MIN_DOCS = 8
#: Least chi-square with one degree of freedom; chance reaches it once in some 10^4 terms.
MIN_CHI = 15.0
#: Pairs of the commonest terms are tested for interaction; chance reaches MIN_PAIR_CHI once in 10^7 pairs.
PAIR_TERMS = 1024
PAIR_FEATURES = 128
MIN_PAIR_CHI = 30.0
THRESHOLD = 0.7
ROUNDS = 200

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def hashed(term: bytes) -> list[int]:
    """Ids of a term and of its beginnings (insults come inflected)."""
    ids = [(crc32(term) & _MASK) << 1]
    for n in PREFIXES:
        if len(term) > n:
            ids.append((crc32(term[:n] + b"*") & _MASK) << 1)
    return ids


def terms(text: bytes | None) -> Counter:
    return Counter((text or b"").translate(_FOLD).split())


def features(text: bytes | None) -> set[int]:
    """Ids of the hashed terms of a UTF-8 text; odd ids: occurs twice or more."""
    seen: dict[int, int] = {}
    for term, n in terms(text).items():
        for i in hashed(term):
            seen[i] = seen.get(i, 0) + n
    return seen.keys() | {i | 1 for i, n in seen.items() if n > 1}


@dataclass
class Machine:
    w0: float
    column: dict[int, int] = field(default_factory=dict)
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))
    #: The features of terms met before, MEMO of them at most.
    known: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def score(self, text: bytes | None) -> float:
        seen: dict[int, int] = {}
        for term, n in terms(text).items():
            ids = self.known.get(term)
            if ids is None:
                if len(self.known) >= MEMO:
                    self.known.clear()
                ids = self.known[term] = tuple(i for i in hashed(term) if i in self.column or i | 1 in self.column)
            for i in ids:
                seen[i] = seen.get(i, 0) + n
        cols = [self.column[i] for i in seen if i in self.column]
        cols += [self.column[i | 1] for i, n in seen.items() if n > 1 and i | 1 in self.column]
        logit = self.w0
        if cols:
            v = self.v[cols]
            s = v.sum(axis=0)
            logit += float(self.w[cols].sum() + 0.5 * (s @ s - (v * v).sum()))
        return 1.0 / (1.0 + float(np.exp(-np.clip(logit, -30, 30))))


def _select(rows: list[np.ndarray], y: np.ndarray) -> list[int]:
    """The features most associated with the label, then those of the strongest interactions."""
    n_all, n_one = (np.zeros(2 << BITS, dtype=np.int32) for _ in range(2))
    for r, label in zip(rows, y, strict=True):  # a row has an id once
        n_all[r] += 1
        if label:
            n_one[r] += 1
    ids = np.flatnonzero(n_all >= MIN_DOCS)
    n, n1 = n_all[ids].astype(float), n_one[ids].astype(float)
    total, total1 = float(len(y)), float(y.sum())
    diff = n1 * total - n * total1
    spread = n * (total - n) * total1 * (total - total1)
    chi = np.where(spread > 0, diff * diff * total / np.maximum(spread, 1), 0)
    chi[chi < MIN_CHI] = 0
    best = np.lexsort((ids, -chi))[:FEATURES]
    alone = [int(ids[b]) for b in best if chi[b] > 0]
    common = np.lexsort((ids, -np.minimum(n, total - n)))[:PAIR_TERMS]
    return list(dict.fromkeys(alone + _interacting(rows, y, np.sort(ids[common]))))


def _interacting(rows: list[np.ndarray], y: np.ndarray, terms: np.ndarray) -> list[int]:
    """The terms of the pairs whose joint effect on the label differs most from the sum of their own effects."""
    if len(terms) < 2:
        return []
    both = np.zeros((2, len(terms), len(terms)), dtype=np.float32)
    alone = np.zeros((2, len(terms)))
    sizes = np.array([(y == 0).sum(), (y == 1).sum()], dtype=float)
    for label in (0, 1):
        of_label = np.flatnonzero(y == label)
        for at in range(0, len(of_label), 1024):
            x = np.zeros((min(1024, len(of_label) - at), len(terms)), dtype=np.float32)
            for i, r in enumerate(of_label[at:at + 1024]):
                x[i] = np.isin(terms, rows[r], assume_unique=True)
            both[label] += x.T @ x
            alone[label] += x.sum(axis=0)
    effect, noise, enough = np.zeros(both.shape[1:]), np.zeros(both.shape[1:]), np.ones(both.shape[1:], dtype=bool)
    for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)):
        # rows by label in which the first term occurs (a) or not, and the second (b) or not
        count = [
            both[k] if a and b else alone[k][:, None] - both[k] if a else alone[k][None, :] - both[k] if b
            else sizes[k] - alone[k][:, None] - alone[k][None, :] + both[k]
            for k in (0, 1)
        ]
        n = count[0] + count[1]
        rate = (count[1] + 1) / (n + 2)
        effect += rate if a == b else -rate
        noise += rate * (1 - rate) / np.maximum(n, 1)
        enough &= n >= MIN_DOCS
    chi = np.where(enough, effect * effect / noise, 0)
    chi[np.tril_indices(len(terms))] = 0
    found: dict[int, None] = {}
    flat = chi.ravel()
    near = np.flatnonzero(flat >= MIN_PAIR_CHI)
    for p in near[np.lexsort((near, -flat[near]))].tolist():
        for t in divmod(p, len(terms)):
            found[int(terms[t])] = None
        if len(found) >= PAIR_FEATURES:
            break
    return list(found)


def fit(rows: list[np.ndarray], labels: Iterable[int], seed: int = 3, factors: int = FACTORS) -> Machine:
    """A machine from feature ids and labels (0 or 1) of the rows, by full-batch Adam steps.

    factors: 0 gives the linear model of the same features.
    """
    y = np.fromiter(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return Machine(float(np.log(rate / (1 - rate))))
    kept = _select(rows, y)
    column = {f: c for c, f in enumerate(kept)}
    x = np.zeros((len(y), len(kept)), dtype=np.float32)
    for r, ids in enumerate(rows):
        x[r, [column[i] for i in ids.tolist() if i in column]] = 1
    rng = np.random.default_rng(seed)
    n = len(y)
    params = {
        "w0": np.array([np.log(y.mean() / (1 - y.mean()))]),
        "w": np.zeros(len(kept)),
        "v": rng.normal(0, 0.05, (len(kept), factors)),
    }
    first = {k: np.zeros_like(p) for k, p in params.items()}
    second = {k: np.zeros_like(p) for k, p in params.items()}
    decay = {"w0": 0.0, "w": 1e-5, "v": 1e-5}
    for step in range(1, ROUNDS + 1):
        v = params["v"].astype(np.float32)
        xv = x @ v
        logit = params["w0"][0] + x @ params["w"].astype(np.float32) + 0.5 * ((xv * xv).sum(axis=1) - x @ (v * v).sum(axis=1))
        g = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / n).astype(np.float32)
        xg = x.T @ g
        grads = {"w0": np.array([g.sum()]), "w": xg, "v": x.T @ (g[:, None] * xv) - v * xg[:, None]}
        for k, p in params.items():
            d = grads[k] + decay[k] * p
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            p -= 0.05 * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return Machine(float(params["w0"][0]), column, params["w"], params["v"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = MAX_TRAIN, factors: int = FACTORS) -> Machine:
    """A machine from the labelled rows outside the held-out third, `most` of them at most."""
    spark = docs.sparkSession
    prepare(spark)
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    chosen = spark.createDataFrame(sample.collect(), "doc_id long, y int")  # `most` rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids = [sorted(features(t)) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(ids, pa.list_(pa.int32()))], names=["y", "ids"])

    found = one_text(texts.join(F.broadcast(chosen), "doc_id"), "y").mapInArrow(run, "y int, ids array<int>").toArrow()
    ids = found.column("ids").combine_chunks()
    ids = ids if hasattr(ids, "offsets") else ids.chunk(0)
    values, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
    rows = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    # copies count once; the order doesn't depend on the partitions
    unique = {(blake2b(r.tobytes(), digest_size=16).digest(), y): r for r, y in zip(rows, found.column("y").to_pylist(), strict=True)}
    order = sorted(unique)
    return fit([unique[k] for k in order], [k[1] for k in order], factors=factors)


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs with score (double) and predicted (int)."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop("score", "predicted")
    shared = spark.sparkContext.broadcast(machine)  # FEATURES rows at most

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        m = shared.value
        return pd.Series([m.score(t.encode("utf-8", "surrogatepass") if t else b"") for t in texts], dtype="float64")

    out = docs.withColumn("score", scored(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those predicted toxic; columns as given."""
    safe, back = shelter(docs, "score", "predicted")
    return back(score(safe, machine, threshold).where("predicted = 0"))
