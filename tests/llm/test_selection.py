"""Importance resampling, language identification and the filter audit."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from memspark.llm import filteraudit, language, resampling
from memspark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


# ---- resampling

def plain_resample(rows, target, percent, order, buckets, min_words=20, seed=2024):
    """(id, n_features, weight, score) of each row, and the drawn in their order."""
    def feats(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(words) - n + 1)], len(words)

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(feats(text)[0])
    for text in target:
        t.update(feats(text)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out, able = [], []
    for i, text in rows:
        f, n_words = feats(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))
        out.append((i, len(f), weight, score))
        if n_words >= min_words:
            able.append((-score, i is None, i or 0))
    return out, sorted(able)[:percent * len(able) // 100]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_resampling_equals_brute_force(spark, odd, odd_rows, order):
    target = ["the of and to Hot there", None, "", odd_rows[2][1], "One two"]
    got = resampling.resample(odd, spark.createDataFrame([(t, 1) for t in target], "text string, n int"), percent=40, order=order, buckets=101).collect()
    want, drawn = plain_resample(odd_rows, target, 40, order, 101)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(want, key=key)
    ranks = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.rank is not None)
    assert [r[0] for r in ranks] == list(range(1, len(drawn) + 1)) and [r[1:] for r in ranks] == drawn


def test_resampling_cases(spark, odd, empty):
    bench = spark.createDataFrame([("the word",)], "text string")
    found = resampling.resample(odd, bench)
    assert found.columns == [c for c in odd.columns if c != "score"] + ["n_features", "weight", "score", "rank"] and found.count() == odd.count()
    assert resampling.resample(empty, bench).count() == 0
    assert resampling.resample(odd, empty.select("text")).count() == odd.count()
    same = spark.createDataFrame([(4, "word " * 30)] * 500 + [(n, "other " * 30) for n in range(500)], "doc_id long, text string").repartition(7)
    rows = resampling.resample(same, bench, columns=["doc_id"]).collect()
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 101)) and {r.n_features for r in rows} == {30}


def test_the_window_of_positions_needs_no_shuffle_of_its_own(spark, odd):
    plan = resampling.positions(odd, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Window" in plan
    plan = resampling.positions(odd, 1)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_resampling_leans_to_the_target(spark):
    rnd = random.Random(2)
    like, other = "alpha beta gamma delta".split(), "red green blue white".split()
    rows = [(n, " ".join(rnd.choice(like if n % 4 == 0 else other) for _ in range(40))) for n in range(400)]
    target = spark.createDataFrame([(" ".join(rnd.choice(like) for _ in range(2000)),)], "text string")
    drawn = [r.doc_id for r in resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), target, percent=20).where("rank is not null").collect()]
    assert len(drawn) == 80 and sum(i % 4 == 0 for i in drawn) > 60


# ---- language

def vocabulary():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "é"]
    return language.Vocabulary({p: i for i, p in enumerate(pieces)}, [8 + b for b in range(256)], 264)


def cuts(text, v):
    """Every way to cut a marked word into ids."""
    if not text:
        yield ()
    for n in range(1, len(text) + 1):
        if text[:n] in v.pieces:
            for rest in cuts(text[n:], v):
                yield (v.pieces[text[:n]], *rest)
    if text and text[0] not in v.pieces:
        for rest in cuts(text[1:], v):
            yield (*(v.byte[b] for b in text[0].encode()), *rest)


def test_sums_over_all_ways_to_cut():
    v, rng = vocabulary(), np.random.default_rng(1)
    p = rng.dirichlet(np.ones(v.size), 3).T
    words = ["a", "ab", "abab", "aaba", "éa", "ö", "abö", "baab", "ñab"]
    got = language.Lattice(v, np.log(p)).likelihoods(words)
    lattice = language.Lattice(v, np.log(p[:, :1]))
    for w, row in zip(words, got):
        ways = list(cuts("▁" + w, v))
        assert np.allclose(row, np.log(sum(p[list(c)].prod(axis=0) for c in ways)))
        share = np.array([p[list(c), 0].prod() for c in ways])
        used = np.zeros(v.size)
        for c, x in zip(ways, share / share.sum()):
            np.add.at(used, list(c), 3 * x)
        assert np.allclose(lattice.expected([w], np.array([3.0])), used)


def test_rounds_raise_the_likelihood():
    v = vocabulary()
    words, often = ["ab", "abab", "ba", "éa", "aab"], np.array([9.0, 3, 2, 1, 4])
    p, before = np.full((v.size, 1), 1 / v.size), -np.inf
    for _ in range(6):
        lattice = language.Lattice(v, np.log(np.maximum(p, 1e-12)))
        total = float(often @ lattice.likelihoods(words)[:, 0])
        assert total >= before - 1e-9
        before, p = total, lattice.expected(words, often)[:, None]
        p = p / p.sum()


def test_long_words_and_memory_do_not_change_scores(monkeypatch):
    v = vocabulary()
    model = language.Model(["x", "y"], v, np.random.default_rng(3).dirichlet(np.ones(v.size), 2).T)
    texts = ["ab ba abab", "a" * 50_000, "éa", None, "", "12 34", "日本語 ab", "AB́ ab" * 50]
    whole = language.Scorer(model).predict(texts)
    monkeypatch.setattr(language, "MEMO", 1)
    monkeypatch.setattr(language, "_CHUNK", 5)
    monkeypatch.setattr(language, "_CELLS", 1000)
    scorer = language.Scorer(model)
    again = [scorer.predict([t])[0] for t in texts]
    assert [a for a, _ in whole] == [a for a, _ in again] and np.allclose([s for _, s in whole], [s for _, s in again])
    assert whole[3:6] == [("und", 0.0)] * 3 and all(0.5 <= s <= 1 for n, (_, s) in enumerate(whole) if not 3 <= n < 6)


def test_language_query_on_rows_it_has_not_seen(spark):
    found = {r.doc_id: r for r in QUERIES["op12_segmented_unigram_language"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text").collect()
    assert len(found) == len(docs)
    unseen = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert {d.doc_id for d in unseen} == {i for i, r in found.items() if r.held_out} and len(unseen) > 200
    assert np.mean([found[d.doc_id].lang_pred == d.lang for d in unseen]) > 0.98


def test_language_cases(spark, odd, empty):
    v = vocabulary()
    nothing = language.train(empty, v)
    assert {(r.lang_pred, r.score) for r in language.identify(odd, nothing).collect()} == {("und", 0.0)}
    rows = [(i, "aa ab" if i % 2 else "bb ba", "x" if i % 2 else None if i % 6 == 0 else "y") for i in range(60)] + [(None, "ab", "z"), (1, None, "x")] * 3 + [(3, "aa ab", "x")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    models = [language.train(docs.repartition(n), v) for n in (1, 6)]
    assert models[0].languages == ["x", "y"] and np.allclose(models[0].p, models[1].p)
    found = language.identify(docs.withColumnRenamed("lang", "Score"), models[0])
    assert found.columns == ["doc_id", "text", "lang_pred", "score"]
    assert {(r.text, r.lang_pred) for r in found.collect()} == {("aa ab", "x"), ("bb ba", "y"), ("ab", "x"), (None, "und")}
    assert language.identify(empty, models[0]).count() == 0


def test_the_vocabulary_is_read_where_it_lies():
    v = language.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert v.size == 32_000 and len(v.pieces) > 20_000 and "▁the" in v.pieces and len(set(v.byte)) == 256
    assert not any(c.isdigit() for p in v.pieces for c in p)


# ---- filter audit

def plain_audit(rows, good, toxic):
    """rows (doc_id, source, text) -> {(part, order, step): measures}."""
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = defaultdict(list)
    for i, s, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
             "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs[s or ""].append((f, i in good, i in toxic))
    out = {}
    for part, mine in docs.items():
        shapley = Counter()
        for p in itertools.permutations("ABCDE"):
            for k, c in enumerate(p):
                here = [(f[c], any(f[q] for q in p[:k]), sum(f.values()), g, x) for f, g, x in mine]
                gone = [h for h in here if h[0] and not h[1]]
                shapley[c] += len(gone)
                out[part, "".join(p), k + 1] = [
                    sum(not h[0] and not h[1] for h in here), len(gone), sum(h[0] and h[1] for h in here), sum(h[0] and h[2] == 1 for h in here),
                    sum(h[3] for h in gone), sum(h[4] for h in gone)]
        for (q, p, k), m in out.items():
            if q == part:
                m.append(shapley[p[k - 1]])
    return {k: tuple(m) for k, m in out.items()}


def test_audit_equals_brute_force(spark, odd, odd_rows, empty):
    rows = [(r.doc_id, r.source, r.text) for r in odd.collect()] + [(7, "s0", "Aa $ " * 60), (9, None, "ABC " * 70), (8, "s0", "Aa $ " * 60)] * 2
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, source string, text string, part string, bits string").repartition(5)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 0), (7, 1, 1), (None, 1, 1), (100, None, 1), (131, 1, None)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in filteraudit.audit(docs, labels).collect()}
    want = plain_audit(rows, {1, 7, 131}, {1, 7, 100})
    assert got == want and len({k[0] for k in want}) > 2
    assert filteraudit.audit(empty, labels).count() == 0
    assert {k: v[:4] for k, v in got.items()} == {
        (r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails) for r in filteraudit.audit(docs, labels.limit(0)).collect()}


def test_bitmaps_of_many_parts():
    """Parts of every size modulo 8 in one batch, more of them than rows in most."""
    rng = np.random.default_rng(4)
    part, bits, marks = rng.integers(0, 900, 2000), rng.integers(0, 32, 2000), rng.integers(0, 4, 2000)
    found, counts = filteraudit.count_batch(part, bits, marks)
    assert found.tolist() == sorted(set(part.tolist()))
    for _ in range(300):
        p, s, f = int(rng.choice(found)), int(rng.integers(32)), int(rng.integers(5))
        if s >> f & 1:
            continue
        mine = [(int(b), int(m)) for q, b, m in zip(part, bits, marks) if q == p]
        gone = [(b, m) for b, m in mine if b >> f & 1 and not b & s]
        want = [sum(not b & (s | 1 << f) for b, _ in mine), len(gone), sum(bool(b >> f & 1 and b & s) for b, _ in mine), sum(b == 1 << f for b, _ in mine),
                sum(m & 1 for _, m in gone), sum(m >> 1 for _, m in gone)]
        assert counts[found.tolist().index(p), :, s, f].tolist() == want
