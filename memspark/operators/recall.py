"""Recall: what may be served, three channels, how well they agree, ranking, touch detection."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.similarity import words
from ..functions.text import contains_word, is_trivial
from ..values import ALLOWED_TYPES, CHANNELS, RECALL_SCORES, TIER_DEPTHS, TOP_N

BM25_K1 = 1.2
BM25_B = 0.75
#: Rows of a table of queries or anchors that may be broadcast; of a table of words, or of ids and ranks.
BROADCAST_ROWS = 10_000
BROADCAST_NARROW = 500_000
#: Queries whose vectors are held at once, and whose scores with a batch of items are.
QUERY_BLOCK = 2_000
SCORED = 64


def allowed() -> Column:
    """Of a relation in the closed set; null fails."""
    return F.coalesce(F.col("type").isin(*ALLOWED_TYPES), F.lit(False))


def current() -> Column:
    return F.col("invalid_at").isNull() & F.col("expired_at").isNull()


def gate(edges: DataFrame) -> DataFrame:
    """Servable edges: not quarantined, current, of an allowed relation."""
    return edges.where((F.col("verdict") != "quarantined") & current() & allowed())


def drop_count(edges: DataFrame) -> DataFrame:
    """How many edges only the closed set of relations keeps back."""
    open_ = edges.where((F.col("verdict") != "quarantined") & current())
    return open_.agg(F.count_if(~allowed()).alias("dropped"), F.count_if(allowed()).alias("kept"))


def serving_label() -> Column:
    return F.when(F.col("contested"), "contested").when(F.col("verdict") == "provisional", "unverified").otherwise("")


def tier_depth(tier: Column) -> Column:
    out = F.raise_error(F.concat(F.lit("unknown tier: "), F.coalesce(tier, F.lit("null")))).cast("string")
    for name, depth in reversed(TIER_DEPTHS.items()):
        out = F.when(tier == name, F.lit(depth)).otherwise(out)
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only what is known to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def top(scored: DataFrame, n: int, *ties: str) -> DataFrame:
    """The n best rows of each query_id by score, ties in the order of the given columns, with their rank.

    The filter is on the plain row number, so that Spark cuts each partition to n rows of a query
    before it shuffles.
    """
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *ties)
    cut = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return cut.withColumn("rank", F.col("rank").cast("long"))


def semantic_topk(queries: DataFrame, items: DataFrame, n: int = TOP_N) -> DataFrame:
    """(query_id, item_id, score, rank): the n items likest to each query by cosine, ids break ties.

    Every query must meet every item. Queries come in blocks of QUERY_BLOCK; a pass over the items
    multiplies each Arrow batch with a block's matrix and keeps n rows of a query, so what leaves a
    batch does not grow with it.
    """
    kind = queries.schema["query_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"query_id {kind[0]}, item_id {kind[1]}, score double"
    narrow = items.select("item_id", F.col("vector").cast("array<double>").alias("vector"))
    id_type = to_arrow_type(queries.schema["query_id"].dataType)
    passes = [narrow.mapInArrow(_against(block, id_type, n), schema) for block in blocks(queries.select("query_id", F.col("query_vector").cast("array<double>")))]
    return top(reduce(DataFrame.union, passes), n, "item_id")


def first_of_equal(items: DataFrame, n: int) -> DataFrame:
    """The items that can be among the n likest to a query: of those with equal vectors, which tie for every query, the n
    of the smallest ids."""
    alike = Window.partitionBy("vector").orderBy("item_id")
    return items.select("item_id", "vector").withColumn("_nth", F.row_number().over(alike)).where(F.col("_nth") <= n).drop("_nth")


#: Vectors of less than this angle have a cosine that is 1 in six places.
ALIKE = 9e-4


def contenders(items: DataFrame, n: int) -> DataFrame:
    """The items that can be among the n likest to some query: all but pairs of numbers that n others outdo for every query.

    Pairs lie in sectors of a circle. An item falls behind n items of smaller ids that are left of it if a query is left of
    these, and behind n that are right of it if the query is right of those; a query between finds all of
    them at a score of 1, as they are less than ALIKE apart. So an item whose id is above the n-th least of the
    2 n next sectors' least ids, on both sides, is out. The sector beside its own is left out, so that what is farther has
    a lesser cosine in doubles, too. What has no direction, or other than two numbers, stays.
    """
    reach = 2 * n + 1
    sectors = math.ceil(2 * math.pi * (reach + 1) / ALIKE)
    x, y = (F.get("vector", F.lit(i)).cast("double") for i in (0, 1))
    there = (F.size("vector") == 2) & F.greatest(F.abs(x), F.abs(y)).between(1e-150, 1e150)
    turn = F.pmod(F.atan2(y, x) / (2 * math.pi), F.lit(1.0))
    placed = items.select("item_id", "vector", F.when(there, F.floor(turn * sectors).cast("int") % sectors).alias("_sector"))
    least = placed.groupBy("_sector").agg(F.min("item_id").alias("_least"))  # no sector meets none

    def nth(sign: int) -> Column:
        ids = F.array_sort(F.collect_list(F.when(F.col("_step") * sign > 0, F.col("_least"))))
        return F.get(ids, F.lit(n - 1))

    steps = F.array(*[F.lit(k * sign) for sign in (-1, 1) for k in range(2, reach + 1)])
    near = least.select("_sector", "_least", F.explode(steps).alias("_step"))
    near = near.groupBy(F.pmod(F.col("_sector") + F.col("_step"), F.lit(sectors)).alias("_sector")).agg(nth(-1).alias("_a"), nth(1).alias("_b"))
    bound = near.where("_a is not null and _b is not null").select("_sector", F.greatest("_a", "_b").alias("_bound"))
    # a row for each sector at most
    kept = placed.join(F.broadcast(bound), "_sector", "left").where(F.coalesce(F.col("item_id") <= F.col("_bound"), F.lit(True)))
    return first_of_equal(kept, n)


def blocks(queries: DataFrame) -> Iterator[list]:
    """The queries, QUERY_BLOCK at a time; one empty block if there are none."""
    block: list = []
    found = False
    for row in queries.toLocalIterator():
        block.append(tuple(row))
        if len(block) == QUERY_BLOCK:
            yield block
            block, found = [], True
    if block or not found:
        yield block


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def matrix_of(column, width: int) -> np.ndarray:
    """An Arrow column of lists as a matrix; lists that are null, hold a null or have another length are zeros."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    fits = sizes == width
    if not width or not fits.any():
        return np.zeros((len(column), width))
    flat = pc.list_flatten(column.filter(pa.array(fits)))
    out = np.zeros((len(column), width))
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    out[fits] = np.where(np.isnan(values).any(axis=1, keepdims=True), 0.0, values)
    return out


def _against(block: list, id_type, n: int):
    """An Arrow function: the n likest items of each batch for each query of the block."""
    ids = [q for q, _ in block]
    width = max((len(v or ()) for _, v in block), default=0)
    matrix = unit(np.array([v if v and None not in v and len(v) == width else [0.0] * width for _, v in block], dtype=np.float64).reshape(len(ids), width)).T

    def run(batches):
        for b in batches:
            yield from likest(b.column(0), unit(matrix_of(b.column(1), width)), ids, matrix, id_type, n)

    return run


def likest(items, rows: np.ndarray, ids: list, matrix: np.ndarray, id_type, n: int):
    """An Arrow batch (query_id, item_id, score) of the n likest items for each query: items' ids, their unit vectors,
    queries' ids, their unit vectors as columns."""
    import pyarrow as pa

    if not ids or not len(items):
        return
    names = items.to_pylist()
    place = np.empty(len(names), np.int64)  # ties go by id
    place[sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i]))] = np.arange(len(names))
    q, at, best_of = [], [], []
    for start in range(0, len(ids), SCORED):
        score = np.round(np.clip(rows @ matrix[:, start:start + SCORED], 0, 1), 6)
        for j in range(score.shape[1]):
            best = np.lexsort((place, -score[:, j]))[:n] if len(names) <= 4 * n else _first(score[:, j], place, n)
            q += [start + j] * len(best)
            at += best.tolist()
            best_of += score[best, j].tolist()
    yield pa.RecordBatch.from_arrays(
        [pa.array([ids[j] for j in q], id_type), items.take(pa.array(at, pa.int64())), pa.array(best_of, pa.float64())], names=["query_id", "item_id", "score"])


def _first(score: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best; all that tie with the last are compared."""
    least = np.partition(score, len(score) - n)[len(score) - n]
    near = np.flatnonzero(score >= least)
    return near[np.lexsort((place[near], -score[near]))[:n]]


def fuse(lists: DataFrame, n: int = TOP_N, damp: int = 1) -> DataFrame:
    """(query_id, item_id, score, rank): several ranked lists (query_id, item_id, rank) as one, by reciprocal ranks."""
    each = F.lit(1.0) / (F.col("rank") + damp)
    scored = lists.groupBy("query_id", "item_id").agg(F.round(F.sum(each), 6).alias("score"))
    return top(scored, n, "item_id")


def search_edges(queries: DataFrame, edges: DataFrame, related: DataFrame, n: int = TOP_N, types: Sequence[str] = ALLOWED_TYPES, group: str | None = None) -> DataFrame:
    """The best edges of queries (query_id, text) by words, fused with a ranked list (query_id, item_id, rank).

    The group (where edges have one) and the relations are filters on the edges before anything is
    scored, so they reach the scan.
    """
    kept = searchable(edges, types, group)
    words_list = bm25_topk(queries, kept.select(F.col("edge_id").alias("item_id"), F.col("fact").alias("text")), n)
    near = related.join(kept.select(F.col("edge_id").alias("item_id")), "item_id", "left_semi").select("query_id", "item_id", "rank")
    return fuse(words_list.select("query_id", "item_id", "rank").unionByName(near), n)


def searchable(edges: DataFrame, types: Sequence[str] = ALLOWED_TYPES, group: str | None = None) -> DataFrame:
    """The edges of the given relations, of one group if it is given: what an index for edge search is built of."""
    kept = edges.where(F.col("type").isin(*types))
    return kept.where(F.col("group_id") == group) if group else kept


def response(hits: DataFrame, answers: DataFrame, facts: DataFrame, dropped: DataFrame) -> DataFrame:
    """(query_id, response): what a server sends, as JSON: served, verdict, edges, how many edges the closed set of
    relations keeps back (dropped: one row of drop_count()), message."""
    said = injection(hits, answers, facts).select("query_id", "served", "message")
    lists = hits.join(facts.select("edge_id", "fact"), "edge_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "fact", "score", "label"))).alias("_l"))
    cause = F.lower("cause") if "cause" in answers.columns else F.lit(None).cast("string")
    rows = answers.select("query_id", "score", "label", cause.alias("cause")).join(said, "query_id").join(lists, "query_id", "left")
    rows = rows.crossJoin(F.broadcast(dropped.select(F.col("dropped").alias("drop_count"))))
    empty = F.array().cast("array<struct<rank:bigint,fact:string,score:double,label:string>>")
    edges = F.transform(F.coalesce("_l", empty), lambda e: F.struct(e["fact"].alias("fact"), e["score"].alias("score"), e["label"].alias("label")))
    verdict = F.struct("score", "label", F.coalesce("cause", F.lit("absent")).alias("cause"))
    return rows.select("query_id", F.to_json(F.struct("served", verdict.alias("verdict"), edges.alias("edges"), "drop_count", "message")).alias("response"))


def bm25_topk(queries: DataFrame, docs: DataFrame, n: int = TOP_N) -> DataFrame:
    """(query_id, item_id, score, rank): the n documents that match each query's words best.

    Only postings of query words are kept: documents' words are cut down by a semi-join before
    they are counted by document.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    asked = small(terms.select("term").distinct(), BROADCAST_NARROW)
    tokens = docs.select("item_id", words(F.col("text")).alias("w"))
    stats = tokens.agg(F.avg(F.size("w")).alias("avg_len"), F.count(F.lit(1)).alias("n_docs"))
    tf = tokens.select("item_id", F.size("w").alias("len"), F.explode("w").alias("term")).join(asked, "term", "left_semi")
    tf = tf.groupBy("item_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(df, "term").join(small(terms, BROADCAST_NARROW), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("avg_len"))
    scored = scored.groupBy("query_id", "item_id").agg(F.round(F.sum(idf * F.col("tf") * (BM25_K1 + 1) / norm), 6).alias("score"))
    return top(scored, n, "item_id")


def verdicts(hits: DataFrame) -> DataFrame:
    """(query_id, score, label) from (query_id, channel, hit): all three channels must have answered."""
    by_query = hits.groupBy("query_id").agg(
        F.count_if(F.col("hit")).alias("n"), F.sort_array(F.collect_set("channel")).alias("c")
    )
    complete = F.col("c") == F.array(*[F.lit(c) for c in sorted(CHANNELS)])
    score, label = F.raise_error(F.lit("all three channels must answer")).cast("int"), F.lit(None).cast("string")
    for k, (s, name) in RECALL_SCORES.items():
        score = F.when(complete & (F.col("n") == k), F.lit(s)).otherwise(score)
        label = F.when(complete & (F.col("n") == k), F.lit(name)).otherwise(label)
    return by_query.select("query_id", score.alias("score"), label.alias("label"))


def search(
    semantic: DataFrame, keyword: DataFrame, edges: DataFrame, queries: DataFrame, related: Column, n: int = TOP_N, store: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ranked edges and one verdict for each query, from two channels' top lists (query_id, edge_id, rank).

    The lists are cut to n first, united and gated after that. The union is ranked by `related`, a score over the
    columns of queries and edges; equal ones keep the union's order (semantic before keyword). The third
    channel is a look-up of what was found in the store (edges, or a fresher table of (edge_id, invalid_at)):
    an edge that is there and not invalid confirms it. What is found has 2 n rows for each query, so
    it is broadcast to the edges if the queries are few.
    """
    def channel(df: DataFrame, name: str, base: int) -> DataFrame:
        cut = df.where(F.col("rank") <= n)
        return cut.select("query_id", "edge_id", (F.col("rank") + base).alias("pos"), *[F.lit(c == name).alias(c) for c in ("semantic", "keyword")])

    both = channel(semantic, "semantic", 0).unionByName(channel(keyword, "keyword", n))
    union = both.groupBy("query_id", "edge_id").agg(F.min("pos").alias("pos"), F.max("semantic").alias("semantic"), F.max("keyword").alias("keyword"))
    few = 2 * n * queries.limit(BROADCAST_NARROW // (2 * n) + 1).count() <= BROADCAST_NARROW
    hint = F.broadcast if few else lambda df: df
    asked = queries.select(*[F.col(c).alias("_q" if c == "query_id" else c) for c in queries.columns])
    found = gate(edges).join(hint(union), "edge_id").join(hint(asked), F.col("query_id") == F.col("_q"))
    found = found.select("query_id", "edge_id", "pos", "semantic", "keyword", "invalid_at", serving_label().alias("label"), related.alias("score"))
    # an id that several edges have is one hit, the most related of them
    found = found.groupBy("query_id", "edge_id").agg(
        F.min("pos").alias("pos"), *[F.max(c).alias(c) for c in ("semantic", "keyword", "score")], F.max_by("label", F.struct("score", "label")).alias("label"),
        F.min(F.col("invalid_at").isNotNull()).alias("gone"))
    hits = top(found, n, "pos", "edge_id").select("query_id", "edge_id", "score", "rank", "label")
    if store is None:
        known = found.withColumn("graph", ~F.col("gone"))
    else:
        held = store.where("invalid_at is null").select(F.col("edge_id").alias("_held"))
        held = held.join(hint(union.select(F.col("edge_id").alias("_held")).distinct()), "_held", "left_semi").distinct()
        known = found.join(hint(held), F.col("edge_id") == F.col("_held"), "left").withColumn("graph", F.col("_held").isNotNull())
    seen = known.groupBy("query_id").agg(*[F.max(c).alias(c) for c in CHANNELS])
    answers = queries.select("query_id").join(seen, "query_id", "left")
    each = answers.select("query_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.coalesce(F.col(c), F.lit(False)).alias("hit")) for c in CHANNELS
    ])).alias("x")).select("query_id", "x.channel", "x.hit")
    return hint(hits), verdicts(each)


def expand(anchors: DataFrame, edges: DataFrame, n: int | None = None, related: Column | None = None) -> DataFrame:
    """(anchor_id, edge_id, label, rank): servable edges of the anchors' episodes (anchor_id, tier, episode, ..), most
    related first; none for tier none. related: a score over the columns of both, the edges' weight by default."""
    asked = anchors.where("tier <> 'none'")
    found = asked.join(gate(edges), "episode")
    order = Window.partitionBy("anchor_id").orderBy((F.col("weight") if related is None else related).desc(), "edge_id")
    out = found.withColumn("rank", F.row_number().over(order).cast("long"))
    out = out if n is None else out.where(F.col("rank") <= n)
    return out.select("anchor_id", "edge_id", serving_label().alias("label"), "rank")


def expand_verdicts(anchors: DataFrame, expanded: DataFrame) -> DataFrame:
    """(anchor_id, score, label, cause) of the anchors that were read and gave nothing: absent, not an error."""
    score, label = RECALL_SCORES[0]
    nothing = anchors.where("tier <> 'none'").join(expanded.select("anchor_id"), "anchor_id", "left_anti")
    return nothing.select("anchor_id", F.lit(score).alias("score"), F.lit(label).alias("label"), F.lit("ABSENT").alias("cause"))


def touch(turns: DataFrame, anchors: DataFrame) -> DataFrame:
    """turns (turn_id, text) with the first anchor (anchor, ord) they name and the tier to recall at.

    Turns and anchors meet on hashes of whole anchors' words: a turn gives the hash of each of its
    runs of as many words as some anchor has, so common words alone bring nothing together. Only
    the turns that have such a run are then searched for the anchor itself. Anchors without ASCII
    words meet every turn; they are broadcast, and must be few.
    """
    own = words(F.col("anchor"))
    keyed = anchors.select("anchor", "ord", F.size(own).alias("n"), F.xxhash64(own).alias("_h"))
    lengths = keyed.where("n > 0").agg(F.sort_array(F.collect_set("n")).alias("_n"))
    spoken = turns.select("turn_id", words(F.col("text")).alias("w")).crossJoin(F.broadcast(lengths))  # one row

    def runs(n: Column) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, n)))

    hashes = F.array_distinct(F.flatten(F.transform("_n", runs)))
    found = spoken.select("turn_id", F.explode(hashes).alias("_h")).join(small(keyed.where("n > 0")), "_h").select("turn_id", "ord", "anchor")
    named = found.groupBy("turn_id").agg(F.array_sort(F.collect_set(F.struct("ord", "anchor"))).alias("_a"))
    bare = keyed.where("n = 0").agg(F.array_sort(F.collect_list(F.struct("ord", "anchor"))).alias("_bare"))
    out = turns.join(named.withColumnRenamed("turn_id", "_id"), F.col("turn_id") == F.col("_id"), "left").drop("_id").crossJoin(F.broadcast(bare))
    every = F.array_sort(F.concat(F.coalesce("_a", F.array().cast(named.schema["_a"].dataType)), F.col("_bare")))
    first = F.get(F.filter(every, lambda a: contains_word(F.col("text"), a["anchor"])), F.lit(0))["anchor"]
    out = out.withColumn("anchor", first).drop("_a", "_bare")
    tier = F.when(F.col("anchor").isNotNull(), "episodic").when(is_trivial(F.col("text")), "none").otherwise("full")
    return out.withColumn("tier", tier)


def payload(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, payload): each query's verdict and ranked edges as JSON."""
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "edge_id", "label"))).alias("edges"))
    joined = answers.join(lists, "query_id", "left")
    body = F.struct(
        F.col("score").alias("score"), F.col("label").alias("label"),
        F.transform(F.coalesce("edges", F.array().cast("array<struct<rank:bigint,edge_id:string,label:string>>")), lambda e: F.struct(e["edge_id"].alias("edge_id"), e["label"].alias("label"))).alias("edges"),
    )
    return joined.select("query_id", F.to_json(body).alias("payload"))


#: Why there is nothing to serve -> what is said instead.
EMPTY_LINES = {
    "DEGRADED": "Recall: memory is unavailable, which is not the same as an empty result.",
    "PENDING": "Recall: a matching entry was just saved and is not extracted yet.",
    "ABSENT": "Recall: nothing related is known.",
}


def injection(hits: DataFrame, answers: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, served, message): the text that goes to the assistant. answers (query_id, score, label[, cause]),
    hits (query_id, edge_id, rank, label), facts (edge_id, fact). An answer that isn't served says why: absent, unless
    its cause tells otherwise."""
    lines = hits.join(facts.select("edge_id", "fact"), "edge_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.concat(F.lit("- "), F.col("fact"), F.when(F.col("label") != "", F.concat(F.lit(" ["), F.col("label"), F.lit("]"))).otherwise("")).alias("line")))).alias("_l"))
    cause = F.coalesce(F.upper("cause"), F.lit("ABSENT")) if "cause" in answers.columns else F.lit("ABSENT")
    said = F.lit(EMPTY_LINES["ABSENT"])
    for name, line in EMPTY_LINES.items():
        said = F.when(cause == name, line).otherwise(said)
    head = F.concat(F.lit("Recall ["), F.col("label"), F.lit(" "), F.col("score").cast("string"), F.lit("%]:"))
    body = F.array_join(F.concat(F.array(head), F.transform(F.coalesce("_l", F.array().cast("array<struct<rank:bigint,line:string>>")), lambda x: x["line"])), "\n")
    served = F.col("score") > 0
    return answers.join(lines, "query_id", "left").select("query_id", served.alias("served"), F.when(served, body).otherwise(said).alias("message"))


#: Names and bodies meet on pieces of so many characters.
PIECE = 4


def diary_anchors(entries: DataFrame, bodies: DataFrame) -> DataFrame:
    """(entry_id, ids): entries that have links, with the ids they lead to, themselves first; kept where a
    rendered body names them (name substring).

    An equi-join: a name stands for itself by one of its pieces of PIECE characters (or by itself, if it is shorter), the one of the
    greatest hash, which a body that holds the name has among its pieces.
    """
    def pieces(text: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n))

    linked = F.concat("references", "same_topic", "supersedes")
    found = entries.where(F.size(linked) > 0).select("entry_id", "name", F.array_distinct(F.concat(F.array("entry_id"), linked)).alias("ids"))
    size = F.least(F.length("name"), F.lit(PIECE))
    own = F.array_max(F.transform(pieces(F.col("name"), size), lambda p: F.struct(F.xxhash64(p).alias("h"), p.alias("p"))))
    found = found.withColumn("_piece", own["p"])
    every = F.flatten(F.array(*[pieces(F.col("body"), F.lit(n)) for n in range(PIECE + 1)]))
    held = bodies.where("body is not null").select("body", F.explode(F.array_distinct(every)).alias("_p"))
    named = (F.col("_piece") == F.col("_p")) & F.col("body").contains(F.col("name"))
    return found.join(small(held), named, "left_semi").select("entry_id", "ids")
