"""The vector and the word index against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memspark.operators import recall, vectorindex, wordindex


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters of vectors with ties, repeats, zeros, nulls and another length."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.15 * rng.normal(size=8)).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(12)] + [(1100 + i, [2 * x for x in rows[6][1]]) for i in range(3)]
    rows += [(1200, [0.0] * 8), (1201, None), (1202, [1.0]), (1203, []), (1204, (-centres[0]).tolist())]
    return spark.createDataFrame(rows, "item_id long, vector array<double>").repartition(5)


def asked(vectors):
    own = vectors.where("item_id % 20 = 0 or item_id >= 1200").select(F.col("item_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return own


@pytest.mark.parametrize("n", [1, 5, 40])
def test_vector_index_equals_brute_force(spark, vectors, tmp_path, n):
    path = f"{tmp_path}/index"
    vectorindex.build(vectors, path, cells=12)
    got = {tuple(r) for r in vectorindex.search(asked(vectors), path, n).collect()}
    want = {tuple(r) for r in recall.semantic_topk(asked(vectors), vectors, n).collect()}
    assert got == want


def test_vector_index_reads_few_partitions(spark, vectors, tmp_path):
    path = f"{tmp_path}/index"
    vectorindex.build(vectors, path, cells=12)
    rings = vectorindex.Rings(spark, path)
    query = vectors.where("item_id = 40").select(F.lit(1).alias("query_id"), F.col("vector").alias("query_vector"))
    found = vectorindex.search(query, path, 5)
    (slots,) = rings.visits(recall.unit(np.array([query.first().query_vector])), 5)
    assert 0 < len(slots) <= len(rings.slot) / 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan or "PartitionFilters: [slot" in plan
    assert found.count() == 5


def test_vector_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "item_id long, vector array<double>")
    vectorindex.build(none, f"{tmp_path}/a")
    query = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, query_vector array<double>")
    assert vectorindex.search(query, f"{tmp_path}/a", 3).count() == 0
    zeros = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "item_id long, vector array<double>")
    vectorindex.build(zeros, f"{tmp_path}/b")
    assert sorted(tuple(r) for r in vectorindex.search(query, f"{tmp_path}/b", 3).collect()) == [(1, 1, 0.0, 1), (1, 2, 0.0, 2), (2, 1, 0.0, 1), (2, 2, 0.0, 2)]


@pytest.fixture(scope="module")
def texts(spark):
    """Words of Zipf's frequencies, one in nearly all documents, texts of many lengths, repeats, nulls and empty ones."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        n = int(rng.integers(1, 80))
        w = ["w%d" % min(400, int(x)) for x in rng.zipf(1.3, n)]
        rows.append((i, " ".join(w + ["common"] * int(rng.integers(0, 4)))))
    rows += [(2000, None), (2001, ""), (2002, "W7 w7, w7!"), (2003, "w7 w7 w7")]
    return spark.createDataFrame(rows, "item_id long, text string").repartition(4)


QUERIES = [(1, "w7"), (2, "common w2 w3"), (3, "W390 w1 w1 unknown"), (4, "unknown"), (5, ""), (6, None), (7, "w5 w6 w7 w8 w9 w10 common")]


@pytest.mark.parametrize(("n", "block", "per_list"), [(5, 8, 1_000_000), (5, 4, 100), (120, 8, 300)])
def test_word_index_equals_brute_force(spark, texts, tmp_path, monkeypatch, n, block, per_list):
    monkeypatch.setattr(wordindex, "BLOCK", block)
    monkeypatch.setattr(wordindex, "LIST", per_list)
    path = f"{tmp_path}/words"
    wordindex.build(texts, path)
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    got = {tuple(r) for r in wordindex.search(queries, path, n).collect()}
    assert got == {tuple(r) for r in recall.bm25_topk(queries, texts, n).collect()} and len(got) > 4 * n - 5


def test_word_index_leaves_out_blocks_of_a_common_word(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(wordindex, "BLOCK", 8)
    path = f"{tmp_path}/words"
    wordindex.build(texts, path)
    queries = spark.createDataFrame([(1, "common"), (2, "w390 common")], "query_id int, text string")
    blocks = spark.read.parquet(f"{path}/blocks").where("term = 'common'").count()
    read = {r.query_id: r["count"] for r in wordindex.wanted(queries, path, 5).where("term = 'common'").groupBy("query_id").count().collect()}
    assert read[1] <= 3 < blocks / 20 and read[2] <= blocks
    plan = wordindex.search(queries, path, 5)._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [common,w390])" in plan and "PartitionFilters: [bucket" in plan


def test_groups_are_indexes_of_their_own(spark, texts, tmp_path):
    both = texts.withColumn("group_id", F.when(F.col("item_id") % 3 == 0, "a").otherwise("b"))
    path = f"{tmp_path}/words"
    wordindex.build(both, path)
    queries = spark.createDataFrame([(q, t, g) for q, (_, t) in enumerate(QUERIES) for g in "a"], "query_id int, text string, group_id string")
    got = {tuple(r) for r in wordindex.search(queries, path, 5).collect()}
    assert got == {tuple(r) for r in recall.bm25_topk(queries, both.where("group_id = 'a'"), 5).collect()}


def test_scores_of_few_queries_are_held_at_once(spark):
    """20,000 items in a batch and 1,500 queries: one matrix of all scores would take 240 MB, and its copies as much again."""
    import tracemalloc

    rng = np.random.default_rng(3)
    rows, asked_for = recall.unit(rng.normal(size=(20_000, 8))), recall.unit(rng.normal(size=(1_500, 8)))
    items = pa.array(range(20_000), pa.int64())
    tracemalloc.start()
    found = list(recall.likest(items, rows, list(range(1_500)), asked_for.T, pa.int64(), 3))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6
    score = np.round(np.clip(rows @ asked_for[777], 0, 1), 6)
    want = sorted(range(20_000), key=lambda i: (-score[i], i))[:3]
    assert [(r["item_id"], r["score"]) for r in found[0].to_pylist() if r["query_id"] == 777] == [(i, score[i]) for i in want]


def test_equal_vectors_are_one_class(spark):
    """Of 40 copies of each of 30 vectors, null and short ones too, n take part, and nothing else changes."""
    rows = [(f"i{k:02d}-{c:02d}", None if k == 7 else [float(k % 5), 1.0][: 1 + (k != 8)]) for k in range(30) for c in range(40)]
    items = spark.createDataFrame(rows, "item_id string, vector array<double>")
    queries = spark.createDataFrame([(q, [q / 3, 1.0]) for q in range(12)] + [(99, None)], "query_id int, query_vector array<double>")
    few = recall.first_of_equal(items, 5)
    assert few.count() == 7 * 5
    assert sorted(map(tuple, recall.semantic_topk(queries, few, 5).collect())) == sorted(map(tuple, recall.semantic_topk(queries, items, 5).collect()))


def test_a_word_of_all_texts_is_looked_up_not_read_for_each_query(spark, tmp_path, monkeypatch):
    """Every text has `part`; queries of it and a rarer word read no block of it. Ids repeat with texts of equal lengths."""
    monkeypatch.setattr(wordindex, "BLOCK", 8)
    rows = [(i, f"part {i % 40} from s{i % 7}") for i in range(800)]
    rows += [(i, f"part {i % 3} part s1") for i in range(50)] + [(5000 + i % 10, "part 5 from s5 5") for i in range(20)] + [(9000, None), (9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "item_id long, text string").repartition(3)
    path = f"{tmp_path}/words"
    wordindex.build(docs, path)
    queries = spark.createDataFrame([(q, f"the {q} part") for q in range(40)] + [(99, "part"), (98, "part s3 from")], "query_id int, text string")
    read = wordindex.wanted(queries.where("query_id < 40"), path, 5)
    assert {(r.lead, r["count"]) for r in read.where("term = 'part'").groupBy("query_id", "lead").count().collect()} == {(False, 1)}
    got = sorted(tuple(r) for r in wordindex.search(queries, path, 5).collect())
    assert got == sorted(tuple(r) for r in recall.bm25_topk(queries, docs, 5).collect()) and len(got) == 42 * 5


@pytest.mark.parametrize("n", [1, 3, 5])
def test_contenders_give_what_all_items_give(spark, n):
    """Pairs of numbers crowd some sectors; ids rise, fall and repeat along the circle; others than pairs are kept."""
    rng = np.random.default_rng(5)
    turns = np.concatenate([rng.uniform(0, 0.02, 4000), np.linspace(1.2, 1.21, 1500), np.linspace(3.145, 3.135, 1500), rng.uniform(-np.pi, np.pi, 300)])
    sizes = rng.uniform(0.01, 50, len(turns))
    names = [f"i{i:05d}" for i in rng.permutation(4000)] + [f"j{i:05d}" for i in range(1500)] + [f"h{i:05d}" for i in range(1500)] + [f"j{i:05d}" for i in range(300)]
    rows = [(i, [float(s * np.cos(t)), float(s * np.sin(t))]) for i, t, s in zip(names, turns, sizes)]
    rows += [(f"a{i}", v) for i, v in enumerate([None, [], [1.0], [0.0, 0.0], [None, 1.0], [1.0, 2.0, 3.0], [float("nan"), 1.0]])] + [(f"k{i}", [1.0, 1.0]) for i in range(40)]
    items = spark.createDataFrame(rows, "item_id string, vector array<double>").repartition(3)
    aims = [*rng.uniform(-np.pi, np.pi, 60), *rng.uniform(-0.001, 0.021, 60), *rng.uniform(1.199, 1.211, 30), *rng.uniform(3.13, 3.15, 30), np.pi / 4]
    asked = [(i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(aims)] + [(900, [0.0, 0.0]), (901, None)]
    queries = spark.createDataFrame(asked, "query_id int, query_vector array<double>")
    kept = recall.contenders(items, n)
    assert kept.count() < len(rows) - 3000
    got, want = (sorted(tuple(r) for r in recall.semantic_topk(queries, i, n).collect()) for i in (kept, items))
    assert got == want
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id int, query_vector array<double>")
    got, want = (sorted(tuple(r) for r in recall.semantic_topk(odd, i, n).collect()) for i in (kept, items))
    assert got == want


def test_words_are_counted_in_pieces(monkeypatch):
    texts = ["a b", None, "", "c" * 50, "d e f", "g"]
    batch = pa.record_batch([pa.array(["g"] * 6), pa.array(range(6)), pa.array(texts)], names=["group_id", "item_id", "text"])
    monkeypatch.setattr(wordindex, "PIECE", 6)
    pieces = list(wordindex._pieces(batch))
    assert [len(p) for p in pieces] == [3, 1, 2] and pa.concat_tables([pa.Table.from_batches([p]) for p in pieces]).column("text").to_pylist() == texts
    assert all(sum(len(t or "") for t in p.column(2).to_pylist()) <= 6 for p in pieces if len(p) > 1)
    assert not list(wordindex._pieces(batch.slice(0, 0)))
