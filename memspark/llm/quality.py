"""Quality rules: a calibrated logistic regression over hashed word and character n-grams.

A text's features are its words, its pairs of neighbouring words and its 3-grams of code points, hashed
into 2^BITS buckets each and counted as parts of all words, pairs and 3-grams. The regression is fitted on three quarters of a bounded
sample of labelled rows (MAX_TRAIN with the smallest hash of doc_id) and its scores are turned
into probabilities by a logistic curve (Platt) fitted on the last quarter. Texts are kept at
KEEP or more, unless a base rule fails them. Scoring runs over Arrow batches.

Cases: null text counts as empty (no words: fails the base rule); null labels are ignored; several
labels of one id: the smallest; several texts of one id: the one with the least hash is learnt; without labels of both kinds the probability is the smoothed
rate of label 1; equal rows fare equally; an empty table gives an empty result; further columns
are kept, names that clash with the new ones are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, one_text, prepare, text_bytes

MAX_TRAIN = 4000
BITS = 18
ROUNDS = 80
KEEP = 0.5
MIN_WORDS = 50
MAX_REPEATED = 50
SYMBOLS = b"#*$%&|<>"
#: Features are parts of a whole and so very small; this brings their weights near 1.
SCALE = 20.0
_SIZE = 1 << BITS
#: Words, pairs of words, 3-grams.
KINDS = 3


def base(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    text = text or b""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return len(words), chars, symbols, dup, repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    starts = np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k:k + len(windows)] |= starts
    return int(covered.sum())


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of 32-bit hashes; each kind of feature has _SIZE of them."""
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64) + kind * _SIZE


def feature_ids(text: bytes) -> list[np.ndarray]:
    """Buckets of the words, of the pairs of words and of the 3-grams of code points."""
    words = text.split()
    h = np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words))
    pairs = (h[:-1] * np.uint32(0x85EBCA6B)) ^ h[1:]
    if text.isascii():
        c = np.frombuffer(text, np.uint8).astype(np.uint32)
    else:
        c = np.frombuffer(text.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    grams = ((c[:-2] * np.uint32(0x01000193)) ^ c[1:-1]) * np.uint32(0x01000193) ^ c[2:] if len(c) > 2 else c[:0]
    return [_bucket(x, kind) for kind, x in enumerate((h, pairs, grams))]


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and values of a text."""
    text = text or b""
    ids, values = [], []
    for part in feature_ids(text):
        if len(part):
            i, n = np.unique(part, return_counts=True)
            ids.append(i)
            values.append(n * (SCALE / len(part)))
    if not ids:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    return np.concatenate(ids).astype(np.int32), np.concatenate(values).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, text: bytes | None) -> float:
        text = text or b""
        out = self.bias
        for part in feature_ids(text):
            if len(part):
                out += SCALE * float(self.weights[part].mean())
        return out

    def probability(self, text: bytes | None) -> float:
        return _sigmoid(self.slope * self.logit(text) + self.shift)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(ids: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, calibrate: np.ndarray) -> Model:
    """calibrate: True for the rows that are kept for the calibration."""
    constant = Model(np.zeros(KINDS * _SIZE, np.float32), 0.0)
    rate = (y.sum() + 1) / (len(y) + 2)
    constant.shift = float(np.log(rate / (1 - rate)))
    learn = np.flatnonzero(~calibrate)
    if not len(learn) or y[learn].min() == y[learn].max():
        return constant
    used, flat = np.unique(np.concatenate([ids[r] for r in learn]), return_inverse=True)
    row = np.repeat(np.arange(len(learn)), [len(ids[r]) for r in learn])
    val = np.concatenate([values[r] for r in learn])
    target = y[learn]
    # both labels weigh the same, so that the threshold of 1/2 lies between them
    each = np.where(target == 1, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1))
    w, b = np.zeros(len(used)), 0.0
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        z = np.bincount(row, weights=w[flat] * val, minlength=len(learn)) + b
        g = (_sigmoid(z) - target) * each
        d = np.bincount(flat, weights=val * g[row], minlength=len(used)) + 1e-5 * w
        db = g.sum()
        m, s = 0.9 * m + 0.1 * d, 0.999 * s + 0.001 * d * d
        mb, sb = 0.9 * mb + 0.1 * db, 0.999 * sb + 0.001 * db * db
        a, c = 1 - 0.9 ** step, 1 - 0.999 ** step
        w -= 0.05 * (m / a) / (np.sqrt(s / c) + 1e-8)
        b -= 0.05 * (mb / a) / (np.sqrt(sb / c) + 1e-8)
    weights = np.zeros(KINDS * _SIZE, np.float32)
    weights[used] = w
    model = Model(weights, float(b))
    rest = np.flatnonzero(calibrate)
    if len(rest) and y[rest].min() != y[rest].max():
        z = np.array([model.bias + float((weights[ids[r]] * values[r]).sum()) for r in rest])
        model.slope, model.shift = platt(z, y[rest])
    return model


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the scores, by Newton steps; targets are smoothed."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([z, np.ones_like(z)], axis=1)
    p = np.array([1.0, 0.0])
    for _ in range(50):
        q = _sigmoid(x @ p)
        grad = x.T @ (q - t) + 1e-6 * p
        hess = (x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        p = p - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MAX_TRAIN) -> Model:
    """A model from `most` labelled rows at most."""
    spark = docs.sparkSession
    prepare(spark)
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .groupBy("doc_id").agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    chosen = spark.createDataFrame(sample.collect(), "doc_id long, y int")  # `most` rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32())]
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.slice(at, 64)
                found = [features(t) for t in text_bytes(part.column(2))]
                columns = [part.column(0), part.column(1), [i for i, _ in found], [v for _, v in found]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) if isinstance(c, list) else c for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "y", "ids", "values"],
                )

    found = (
        one_text(texts.join(F.broadcast(chosen), "doc_id"), "y").select("doc_id", "y", "text")
        .mapInArrow(run, "doc_id long, y int, ids array<int>, values array<float>").toArrow()
    )
    doc, y = found.column("doc_id").to_numpy(), found.column("y").to_numpy().astype(float)

    def rows(name: str) -> list[np.ndarray]:
        out = []
        for chunk in found.column(name).chunks:
            flat, offsets = chunk.values.to_numpy(), chunk.offsets.to_numpy()
            out += [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return out

    ids, values = rows("ids"), rows("values")
    order = np.lexsort((y, doc))  # independent of the partitions
    calibrate = np.array([crc32(str(d).encode()) % 4 == 0 for d in doc[order]], dtype=bool)
    return fit([ids[i] for i in order], [values[i] for i in order], y[order], calibrate)


def judge(docs: DataFrame, model: Model, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """docs with n_words, the four base counts, base_failed, probability and kept."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # KINDS * 2^BITS weights: 3 MB
    kind = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double"
    names = [x.split()[0] for x in kind.split(", ")]

    @F.pandas_udf(kind)
    def judged(texts):
        import pandas as pd

        m = shared.value
        encoded = map(str.encode, texts, repeat("utf-8"), repeat("surrogatepass"))
        return pd.DataFrame([(*base(t), m.probability(t)) for t in encoded], columns=names)

    x = free_name(docs, "_judged")
    docs = docs.drop(*names, "base_failed", "kept")
    out = docs.withColumn(x, judged(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    out = out.select(*docs.columns, f"{x}.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep))
