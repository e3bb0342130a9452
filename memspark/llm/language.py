"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. A word's probability is the sum,
over all ways to cut it into pieces, of the product of their probabilities: a forward pass over
its code points. Pieces never cross words, so a text's log likelihood is the sum of its words',
and a word met again is looked up. The prediction is the language of the highest likelihood, its
score that language's share of all languages' likelihoods.

Words are a letter with the letters and marks after it, in lower case, marked at their begin as the vocabulary marks
words. Code points that the vocabulary lacks are spelled by its byte pieces.

Learning: the PER_LANGUAGE documents of each language with the smallest hash of doc_id, whole
texts, are counted by word in Spark; ROUNDS rounds of expectation and maximisation follow (Spark
tasks run forward and backward over their words, expected piece counts are summed by language and
piece). Only that table, languages x pieces, reaches the driver. All languages are held equally likely.
Each language's counts are smoothed by SMOOTH pieces dealt as all languages deal theirs.

Cases: null texts, empty ones and those without a letter are `und` with score 0, as is every text when
nothing was learnt; null languages and null ids are not learnt from; several rows of one id are each
scored, the text of the least hash is learnt for each language they have; ties go to the language that comes first in order; equal texts
score equally; an empty table gives an empty result; further columns are kept, names that clash with the new ones are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, materialize, one_text, prepare

PER_LANGUAGE = 1_000
ROUNDS = 4
#: Pieces' worth of the languages' common distribution that each language's counts are mixed with.
SMOOTH = 2_000.0
#: Share of an equal distribution over all pieces in the common one.
EQUAL = 0.05
UNKNOWN = "und"
MARK = "▁"
#: Words whose likelihoods a worker keeps.
MEMO = 400_000
#: Code points handled at once when texts are scored, and forward values held at once.
_CHUNK = 1 << 20
_CELLS = 1 << 22
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Vocabulary:
    """Pieces that may stand in a word, by their text, and the piece of each byte."""
    pieces: dict[str, int]
    byte: list[int]
    size: int


def load_vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece model that consist of letters and marks, with or without the begin of a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    inside = regex.compile(rf"{MARK}?[\p{{L}}\p{{M}}]*")
    pieces = {model.id_to_piece(i): i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return Vocabulary({p: i for p, i in pieces.items() if p and inside.fullmatch(p)}, byte, size)


class Lattice:
    """Sums over the ways to cut words, for several words and languages at once.

    Rows of log: 0 is of what is no piece, then come the vocabulary's pieces, then code points that
    are spelled by bytes.
    """

    def __init__(self, v: Vocabulary, log: np.ndarray):
        self.byte, self.rows = v.byte, {p: i + 1 for p, i in v.pieces.items()}
        self.spelled: list[list[int]] = []
        self.first_spelled = v.size + 1
        self.longest = max(map(len, v.pieces), default=1)
        self.log = np.vstack([np.full((1, log.shape[1]), -np.inf), log])

    def groups(self, words: Iterable[str]) -> Iterator[list[int]]:
        """Places of words of one length, as many as may be held at once."""
        words = list(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, places in by_length.items():
            step = max(1, _CELLS // ((n + 2) * self.log.shape[1]))
            for at in range(0, len(places), step):
                yield places[at:at + step]

    def arcs(self, words: list[str]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, which words have a piece between the two places, its row) for words of one length, in order of the end."""
        new = sorted(c for c in set("".join(words)) | {MARK} if c not in self.rows)
        for c in new:
            self.rows[c] = self.first_spelled + len(self.spelled)
            self.spelled.append([self.byte[b] + 1 for b in c.encode("utf-8", "surrogatepass")])
        if new:
            self.log = np.vstack([self.log, [self.log[ids].sum(axis=0) for ids in self.spelled[-len(new):]]])
        marked, found, out = [MARK + w for w in words], self.rows.get, []
        for end in range(1, len(marked[0]) + 1):
            for begin in range(max(0, end - self.longest), end):
                rows = np.array([found(w[begin:end], 0) for w in marked])
                which = np.flatnonzero(rows)
                if len(which):
                    out.append((begin, end, which, rows[which]))
        return out

    def forward(self, arcs: list, n: int, count: int) -> np.ndarray:
        """alpha[place, word, language]: the log of the sum over all ways to cut what comes before the place."""
        alpha = np.full((n + 2, count, self.log.shape[1]), -np.inf)
        alpha[0] = 0.0
        for begin, end, which, rows in arcs:
            alpha[end, which] = np.logaddexp(alpha[end, which], alpha[begin, which] + self.log[rows])
        return alpha

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """The log probability of each word in each language."""
        out = np.empty((len(words), self.log.shape[1]))
        for places in self.groups(words):
            group = [words[i] for i in places]
            out[places] = self.forward(self.arcs(group), len(group[0]), len(group))[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """How often each piece is used in words that occur so often, over all ways to cut them; of one language."""
        used = np.zeros(self.first_spelled)
        for places in self.groups(words):
            group, n = [words[i] for i in places], len(words[places[0]])
            arcs = self.arcs(group)
            alpha = self.forward(arcs, n, len(group))[:, :, 0]
            beta = np.full(alpha.shape, -np.inf)
            beta[-1] = 0.0
            log = self.log[:, 0]
            often = counts[places]
            for begin, end, which, rows in reversed(arcs):
                step = log[rows] + beta[end, which]
                share = often[which] * np.exp(alpha[begin, which] + step - alpha[-1, which])
                beta[begin, which] = np.logaddexp(beta[begin, which], step)
                own = rows < self.first_spelled
                np.add.at(used, rows[own], share[own])
                for r, x in zip(rows[~own].tolist(), share[~own].tolist(), strict=True):
                    np.add.at(used, self.spelled[r - self.first_spelled], x)
        return used[1:]


@dataclass
class Model:
    """Languages in order, and each piece's probability in each of them."""
    languages: list[str]
    vocabulary: Vocabulary
    p: np.ndarray


class Scorer:
    """Predicts texts; keeps the likelihoods of words met before, MEMO of them at most between batches."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.lattice = Lattice(model.vocabulary, np.log(model.p)) if model.languages else None
        self.table = np.empty((0, len(model.languages)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < _CHUNK):
                size += len(texts[end] or "")
                end += 1
            out += self._chunk(texts[at:end])
            at = end
        return out

    def _chunk(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if self.lattice is None:
            return [(UNKNOWN, 0.0)] * len(texts)
        counts = [Counter(words_of(t)) for t in texts]
        if len(self.known) > MEMO:
            self.known.clear()
            self.table = self.table[:0]
        new = [w for w in dict.fromkeys(w for c in counts for w in c) if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.lattice.likelihoods(new)])
        out = []
        for c in counts:
            if not c:
                out.append((UNKNOWN, 0.0))
                continue
            places = np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))
            value = np.fromiter(c.values(), np.float64, len(c)) @ self.table[places]
            best = int(value.argmax())
            out.append((self.model.languages[best], float(1.0 / np.exp(value - value[best]).sum())))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, most: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) of the documents to learn from: `most` of each language, one text for each id and language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("lang", "doc_id").distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    mine = rows.join(F.broadcast(chosen.select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_doc"))), (F.col("lang") == F.col("_lang")) & (F.col("doc_id") == F.col("_doc")))
    both = mine.select(F.struct("doc_id", "lang").alias("doc_id"), "text")
    return one_text(both).select("doc_id.lang", "text")


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text)."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            counts: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.update((lang, w) for w in words_of(text))
            if counts:
                langs, words = zip(*counts, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(words), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    return texts.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expectation(counts: DataFrame, model: Model) -> np.ndarray:
    """Expected counts of pieces by language, summed over Spark's tasks."""
    shared = counts.sparkSession.sparkContext.broadcast(model)  # pieces x languages

    def run(batches):
        import pyarrow as pa

        m = shared.value
        lattices: dict[str, Lattice] = {}
        for b in batches:
            mine: dict[str, tuple[list, list]] = {}
            for lang, word, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words, often = mine.setdefault(lang, ([], []))
                words.append(word)
                often.append(n)
            for lang, (words, often) in mine.items():
                if lang not in lattices:
                    i = m.languages.index(lang)
                    lattices[lang] = Lattice(m.vocabulary, np.log(m.p[:, i:i + 1]))
                used = lattices[lang].expected(words, np.array(often, dtype=np.float64))
                ids = np.flatnonzero(used)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(used[ids])], names=["lang", "piece", "n"])

    found = counts.select("lang", "word", "n").mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    place = {name: i for i, name in enumerate(model.languages)}
    out = np.zeros_like(model.p)
    np.add.at(out, (found.column("piece").to_numpy(), [place[x] for x in found.column("lang").to_pylist()]), found.column("n").to_numpy())
    return out


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Probabilities by piece and language from counts."""
    share = counts / np.maximum(counts.sum(axis=0), 1e-300)
    common = (1 - EQUAL) * share.mean(axis=1) + EQUAL / len(counts)
    mixed = counts + SMOOTH * common[:, None]
    return mixed / mixed.sum(axis=0)


def train(docs: DataFrame, vocabulary: str | Vocabulary, most: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """A model of all languages of docs (doc_id, text, lang); vocabulary: a sentencepiece model's path, or its pieces."""
    prepare(docs.sparkSession)
    v = load_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    counts = materialize(word_counts(sample(docs, most)).repartition(tasks, "lang", "word"), "words")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    model = Model(languages, v, np.full((v.size, len(languages)), 1.0 / v.size))
    for _ in range(rounds if languages else 0):
        model = Model(languages, v, smoothed(expectation(counts, model)))
    return model


_memo: dict[str, object] = {}


def _scorer(model: Model) -> Scorer:
    """The scorer of a broadcast model, kept in a worker from batch to batch."""
    if _memo.get("model") is not model:
        _memo.update(model=model, scorer=Scorer(model))
    return _memo["scorer"]


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages
    docs = docs.drop("lang_pred", "score")

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts):
        import pandas as pd

        return pd.DataFrame(_scorer(shared.value).predict([t or None for t in texts]), columns=["lang_pred", "score"])

    x = free_name(docs, "_predicted")
    out = docs.withColumn(x, predicted(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return out.select(*docs.columns, f"{x}.*")
