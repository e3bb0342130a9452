"""Queries over links, fact edges, recall and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import Views, duck
from ..functions.similarity import cosine
from ..operators import gate, graph, links, recall, vectorindex, wordindex
from ..sources import scratch
from ..values import ALLOWED_TYPES, GREETINGS, PRIOR_EPISODES, RELATIONS, TIER_DEPTHS, TOP_N
from .registry import query

_ALLOWED = ", ".join(f"'{t}'" for t in ALLOWED_TYPES)
_SERVED = f"verdict <> 'quarantined' AND invalid_at IS NULL AND expired_at IS NULL AND coalesce(type IN ({_ALLOWED}), false)"
_LABEL = "CASE WHEN contested THEN 'contested' WHEN verdict = 'provisional' THEN 'unverified' ELSE '' END"


# ---- links

_LINKS = duck("ledger") + """, p AS (SELECT entry_id, ts, coalesce(lag(entry_id) OVER (PARTITION BY session_id ORDER BY ts, entry_id),
  lag(entry_id) OVER (ORDER BY ts, entry_id)) AS prev FROM ledger),
n AS (SELECT prev AS p, arg_max(entry_id, struct_pack(a := ts, b := entry_id)) AS next FROM p WHERE prev IS NOT NULL GROUP BY 1)
"""


@query(_LINKS + "SELECT entry_id, coalesce(CAST(prev AS VARCHAR), '') AS prev, coalesce(CAST(next AS VARCHAR), '') AS next FROM p LEFT JOIN n ON entry_id = n.p")
def structural_links(v: Views):
    return links.structural_links(v.ledger).select("entry_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("prev", "next")])


@query(_LINKS + "SELECT entry_id AS src, prev AS dst, 'PREV_ENTRY' AS label FROM p WHERE prev IS NOT NULL UNION ALL SELECT p, next, 'NEXT_ENTRY' FROM n")
def link_edges(v: Views):
    return links.link_edges(links.structural_links(v.ledger))


_VECTORS = "WITH r AS (SELECT vec_id AS entry_id, label AS session_id, vec_id + 1 AS rn, embedding AS vector FROM embeddings)"
_COSINE = ("greatest(0.0, least(1.0, list_inner_product(a.vector::DOUBLE[], b.vector::DOUBLE[])"
           " / (sqrt(list_inner_product(a.vector::DOUBLE[], a.vector::DOUBLE[])) * sqrt(list_inner_product(b.vector::DOUBLE[], b.vector::DOUBLE[])))))")


def _vector_rows(v: Views):
    return v.vectors.select(F.col("vec_id").alias("entry_id"), F.col("label").cast("long").alias("session_id"), (F.col("vec_id") + 1).alias("rn"), F.col("embedding").alias("vector"))


@query(_VECTORS + f""", s AS (SELECT a.entry_id, b.entry_id AS other, a.rn, b.rn AS p_rn, round({_COSINE}, 6) AS score, a.session_id IS NOT DISTINCT FROM b.session_id AS same
  FROM r a JOIN r b ON b.rn BETWEEN a.rn - 50 AND a.rn - 1),
t AS (SELECT entry_id, other FROM s WHERE score >= 0.75 UNION ALL SELECT other, entry_id FROM s WHERE score >= 0.75),
tl AS (SELECT entry_id, array_to_string(list_sort(list_distinct(list(other))), ',') AS topics FROM t GROUP BY 1),
rl AS (SELECT entry_id, array_to_string(list_sort(list(other)), ',') AS refs FROM s WHERE score >= 0.45 AND score < 0.75 GROUP BY 1),
c AS (SELECT entry_id, arg_max(other, struct_pack(a := score, b := p_rn)) AS continues FROM s WHERE score >= 0.75 AND same GROUP BY 1),
i AS (SELECT entry_id FROM tl UNION SELECT entry_id FROM rl)
SELECT i.entry_id, coalesce(topics, '') AS topics, coalesce(refs, '') AS refs, coalesce(CAST(continues AS VARCHAR), '') AS continues FROM i LEFT JOIN tl USING (entry_id) LEFT JOIN rl USING (entry_id) LEFT JOIN c USING (entry_id)""")
def semantic_links(v: Views):
    found = links.semantic_links(_vector_rows(v)).where((F.size("same_topic") > 0) | (F.size("references") > 0))
    return found.select("entry_id", F.array_join(F.col("same_topic").cast("array<string>"), ",").alias("topics"), F.array_join(F.col("references").cast("array<string>"), ",").alias("refs"), F.coalesce(F.col("continues").cast("string"), F.lit("")).alias("continues"))


@query(_VECTORS + f" SELECT a.entry_id, b.entry_id AS other, round({_COSINE}, 6) AS score FROM r a JOIN r b ON b.rn BETWEEN a.rn - 50 AND a.rn - 1")
def cosine_pairs(v: Views):
    return links.lookback_pairs(_vector_rows(v)).select("entry_id", F.col("p_entry_id").alias("other"), "score")


@query(duck("ledger") + """, e AS (SELECT entry_id, session_id FROM ledger),
d AS (SELECT o_orderkey - o_orderkey % 3 AS entry_id, o_orderkey AS ordinal, o_orderkey - 1 AS old_id, o_custkey AS cause_id FROM orders WHERE o_orderkey % 2 = 0),
l AS (SELECT entry_id, list(old_id ORDER BY ordinal) AS o, list(cause_id ORDER BY ordinal) AS c FROM d GROUP BY 1)
SELECT entry_id, array_to_string(list_sort(list_distinct(list_concat([0], coalesce(o, []::BIGINT[])))), ',') AS supersedes,
 array_to_string(list_sort(list_distinct(coalesce(c, []::BIGINT[]))), ',') AS caused_by FROM e LEFT JOIN l USING (entry_id)""")
def supersession(v: Views):
    none = F.array().cast("array<bigint>")
    entries = v.ledger.select("entry_id", F.array(F.lit(0).cast("long")).alias("supersedes"), none.alias("caused_by"))
    k = F.col("o_orderkey")
    decisions = v.table("orders").where(k % 2 == 0).select((k - k % 3).alias("entry_id"), k.alias("ordinal"), (k - 1).alias("old_id"), F.col("o_custkey").alias("cause_id"))
    out = links.apply_supersession(entries, decisions)
    return out.select("entry_id", *[F.array_join(F.array_sort(c).cast("array<string>"), ",").alias(c) for c in ("supersedes", "caused_by")])


# ---- graph

_RAW = ("SELECT edge_id, CASE WHEN episode % 3 = 0 THEN NULL ELSE verdict END AS raw_verdict, CASE WHEN episode % 4 = 0 THEN NULL ELSE CAST(contested AS VARCHAR) END AS raw_contested, type FROM edges")


@query(duck("edges") + f" SELECT edge_id, 'inferred' AS author, coalesce(raw_verdict, 'provisional') AS verdict, coalesce(CAST(raw_contested AS BOOLEAN), false) AS contested, type FROM ({_RAW})")
def edge_shape(v: Views):
    a = F.map_from_arrays(F.array(F.lit("verdict"), F.lit("contested"), F.lit("type")), F.array(
        F.when(F.col("episode") % 3 != 0, F.col("verdict")), F.when(F.col("episode") % 4 != 0, F.col("contested").cast("string")), F.col("type")))
    return graph.shape_edges(v.edges.withColumn("attributes", a)).select("edge_id", "author", "verdict", "contested", "type")


@query(duck("edges") + " SELECT edge_id, episode FROM edges WHERE episode IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def edges_by_episode(v: Views):
    return graph.edges_by_episode(v.edges, v.ledger.where("extracted = 'in-progress'").select(F.col("entry_id").alias("episode"))).select("edge_id", "episode")


_GONE = """, w AS (SELECT o_orderkey AS window_id, o_orderdate AS start_ts, o_orderdate + INTERVAL 2 DAY AS end_ts FROM orders WHERE o_orderkey % 50 = 0)"""


def _expiry_windows(v: Views):
    return v.table("orders").select(F.col("o_orderkey").alias("window_id"), F.col("o_orderdate").alias("start_ts"), (F.col("o_orderdate") + F.expr("INTERVAL 2 DAY")).alias("end_ts"))


@query(duck("edges") + _GONE + " SELECT window_id, edge_id FROM w JOIN edges ON expired_at BETWEEN start_ts AND end_ts")
def invalidated_in_window(v: Views):
    return graph.invalidated_in(v.edges, _expiry_windows(v).where("window_id % 50 = 0"))


@query(duck("edges") + " SELECT edge_id FROM edges WHERE valid_at <= TIMESTAMP '1996-06-01' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1996-06-01')")
def edges_as_of(v: Views):
    return graph.edges_as_of(v.edges, F.expr("TIMESTAMP_NTZ'1996-06-01 00:00:00'")).select("edge_id")


@query(duck("edges") + " SELECT edge_id, true AS contested, true AS is_open, 'E' || CAST(episode AS VARCHAR) AS evidence FROM edges WHERE invalid_at IS NOT NULL")
def reopen_edges(v: Views):
    closed = v.edges.where("invalid_at is not null").withColumn("evidence_against", F.lit(None).cast("array<string>"))
    out = graph.reopen(closed, F.concat(F.lit("E"), F.col("episode").cast("string")))
    return out.select("edge_id", "contested", (F.col("invalid_at").isNull() & F.col("expired_at").isNull()).alias("is_open"), F.array_join("evidence_against", ",").alias("evidence"))


_PAIRS = [(s, t, r) for r, (ss, ts) in RELATIONS.items() for s in ss for t in ts]


_SOURCES, _TARGETS = (sorted({p[i] for p in _PAIRS}) for i in (0, 1))


def _kind(kinds: list[str], n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} % {len(kinds)} = {i} THEN '{k}'" for i, k in enumerate(kinds)) + " END"


@query(duck("edges") + ", o AS (SELECT s AS source, t AS target, string_agg(r, ',' ORDER BY n) AS relations FROM (VALUES "
       + ", ".join(f"('{s}', '{t}', '{r}', {n})" for n, (s, t, r) in enumerate(_PAIRS)) + f""") x(s, t, r, n) GROUP BY 1, 2),
k AS (SELECT {_kind(_SOURCES, 'episode')} AS source, {_kind(_TARGETS, 'length(fact)')} AS target, type FROM edges)
SELECT source, target, coalesce(relations, '') AS relations, count(*) AS n_edges, count(*) FILTER (coalesce(list_contains(string_split(relations, ','), type), false)) AS n_legal
FROM k LEFT JOIN o USING (source, target) GROUP BY ALL""")
def ontology_map(v: Views):
    """How many edges between two kinds there are, and how many have a relation that the ontology gives the pair."""
    kinds = v.edges.select(F.expr(_kind(_SOURCES, "episode")).alias("source"), F.expr(_kind(_TARGETS, "length(fact)")).alias("target"), "type")
    legal = F.array_contains(F.split("relations", ","), F.col("type"))
    joined = kinds.join(F.broadcast(graph.ontology_map(v.spark)), ["source", "target"], "left")
    return joined.groupBy("source", "target", F.coalesce("relations", F.lit("")).alias("relations")).agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_if(F.coalesce(legal, F.lit(False))).alias("n_legal"))


@query(duck("ledger") + " SELECT entry_id, coalesce(array_to_string(list(entry_id) OVER (PARTITION BY session_id ORDER BY ts, entry_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS prior FROM ledger")
def ride_along(v: Views):
    out = graph.ride_along(v.ledger, PRIOR_EPISODES)
    return out.select("entry_id", F.array_join(F.col("prior").cast("array<string>"), ",").alias("prior"))


@query(duck("edges") + " SELECT episode, count(*) AS n_edges FROM edges WHERE episode IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 20 = 0) GROUP BY 1")
def redact_cascade_targets(v: Views):
    return graph.cascade_targets(v.edges, v.ledger.where("entry_id % 20 = 0").select(F.col("entry_id").alias("episode")))


@query(duck("edges") + " SELECT episode, md5(string_agg(edge_id || ': ' || fact, chr(10) ORDER BY edge_id)) AS manifest_md5 FROM edges GROUP BY 1")
def manifest(v: Views):
    lines = F.array_sort(F.collect_list(F.struct("edge_id", "fact")))
    out = v.edges.groupBy("episode").agg(F.array_join(F.transform(lines, lambda e: F.concat_ws(": ", e["edge_id"], e["fact"])), "\n").alias("m"))
    return out.select("episode", F.md5("m").alias("manifest_md5"))


# ---- recall

@query(duck("edges") + f" SELECT edge_id, verdict, type FROM edges WHERE {_SERVED}")
def recall_gate(v: Views):
    return recall.gate(v.edges).select("edge_id", "verdict", "type")


@query(duck("edges") + f" SELECT count(*) FILTER (NOT coalesce(type IN ({_ALLOWED}), false)) AS dropped, count(*) FILTER (coalesce(type IN ({_ALLOWED}), false)) AS kept"
       " FROM edges WHERE verdict <> 'quarantined' AND invalid_at IS NULL AND expired_at IS NULL")
def recall_drop_count(v: Views):
    return recall.drop_count(v.edges)


@query(duck("edges") + f" SELECT edge_id, {_LABEL} AS label FROM edges WHERE {_SERVED}")
def serving_labels(v: Views):
    return recall.gate(v.edges).select("edge_id", recall.serving_label().alias("label"))


_TIERS = list(TIER_DEPTHS)
_TIER = _kind(_TIERS, "entry_id")


@query(duck("ledger") + f", t AS (SELECT entry_id AS anchor_id, {_TIER} AS tier FROM ledger) SELECT anchor_id, tier, CASE tier "
       + " ".join(f"WHEN '{t}' THEN '{d}'" for t, d in TIER_DEPTHS.items()) + " END AS depth FROM t")
def tier_depth(v: Views):
    anchors = v.ledger.select(F.col("entry_id").alias("anchor_id"), F.expr(_TIER).alias("tier"))
    return anchors.withColumn("depth", recall.tier_depth(F.col("tier")))


_TOPK = f"""WITH r AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round({_COSINE.replace('vector', 'embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM r)"""


def _vector_queries(v: Views):
    return v.vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(_TOPK + " SELECT query_id, item_id, score, rank FROM k WHERE rank <= 5")
def semantic_topk(v: Views):
    items = v.vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return recall.semantic_topk(_vector_queries(v), items)


@query(_TOPK + " SELECT query_id, item_id, score, rank FROM k WHERE rank <= 5")
def indexed_topk(v: Views):
    """The same, by an index whose partitions are pruned by the triangle inequality."""
    path = scratch.folder(v.spark, "vectors")
    vectorindex.build(v.vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), path)
    return vectorindex.search(_vector_queries(v), path, TOP_N)


_BM25 = """, tok AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM d),
st AS (SELECT avg(len(w)) AS avg_len, count(*) AS n_docs FROM tok),
tf AS (SELECT item_id, len(w) AS len, unnest(w) AS term FROM tok),
tc AS (SELECT item_id, len, term, count(*) AS tf FROM tf GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tc GROUP BY 1),
qt AS (SELECT DISTINCT query_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM q),
s AS (SELECT query_id, item_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM tc JOIN df USING (term) JOIN qt USING (term), st GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s)
"""


@query("WITH d AS (SELECT doc_id AS item_id, text FROM documents), q AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0)" + _BM25
       + "SELECT query_id, item_id, score, rank FROM b WHERE rank <= 5")
def bm25_topk(v: Views):
    queries = v.table("benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return recall.bm25_topk(queries, v.docs.select(F.col("doc_id").alias("item_id"), "text"))


@query("WITH d AS (SELECT doc_id AS item_id, text FROM documents), q AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0)" + _BM25
       + "SELECT query_id, item_id, score, rank FROM b WHERE rank <= 5")
def bm25_indexed_topk(v: Views):
    """The same, by an index ordered by impact of which only blocks that may matter are read."""
    path = scratch.folder(v.spark, "words")
    wordindex.build(v.docs.select(F.col("doc_id").alias("item_id"), "text"), path)
    queries = v.table("benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return wordindex.search(queries, path)


@query("SELECT o_custkey AS query_id, CAST(CASE c WHEN 3 THEN 100 WHEN 2 THEN 70 WHEN 1 THEN 30 ELSE 0 END AS INT) AS score,"
       " CASE c WHEN 3 THEN 'answer' WHEN 2 THEN 'corroborated-partial' WHEN 1 THEN 'weak/single-source' ELSE 'honest-empty' END AS label FROM"
       " (SELECT o_custkey, CAST(bool_or(o_orderstatus = 'O') AS INT) + CAST(bool_or(o_orderstatus = 'P') AS INT) + CAST(bool_or(o_orderstatus = 'F') AS INT) AS c FROM orders GROUP BY 1)")
def recall_verdict(v: Views):
    per = v.table("orders").groupBy(F.col("o_custkey").alias("query_id")).agg(*[F.max(F.col("o_orderstatus") == s).alias(s) for s in "OPF"])
    hits = per.select("query_id", F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(s).alias("hit")) for c, s in zip(("semantic", "keyword", "graph"), "OPF", strict=True)])))
    return recall.verdicts(hits)


_RELATED = "round(greatest(0.0, least(1.0, (weight / 10000 * price + 1.0) / (sqrt(weight / 10000 * (weight / 10000) + 1.0) * sqrt(price * price + 1.0)))), 6)"


# Two channels over all edges: by the angle of prices to a query's balance, and by words of the fact.
_CHANNELS = duck("edges") + """, q0 AS (SELECT s_suppkey AS query_id, 'the ' || CAST(s_suppkey AS VARCHAR) AS text, s_acctbal / 1000 AS price FROM supplier WHERE s_suppkey % 20 = 0),
d AS (SELECT edge_id AS item_id, fact AS text FROM edges), q AS (SELECT query_id, text FROM q0)""" + _BM25.replace(
    "b AS (", "kw AS (") + f""", rel AS (SELECT query_id, edge_id AS item_id, {_RELATED} AS score FROM edges, q0),
sm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM rel),
g AS (SELECT * FROM edges WHERE {_SERVED}),
u0 AS (SELECT query_id, item_id, rank AS pos, 's' AS ch FROM sm WHERE rank <= 5 UNION ALL SELECT query_id, item_id, rank + 5, 'k' FROM kw WHERE rank <= 5),
u AS (SELECT query_id, edge_id, max({_RELATED}) AS score, min(pos) AS pos, arg_max({_LABEL}, struct_pack(a := {_RELATED}, b := {_LABEL})) AS label, count(*) FILTER (ch = 's') AS s, count(*) FILTER (ch = 'k') AS k
  FROM u0 JOIN g ON item_id = edge_id JOIN q0 USING (query_id) GROUP BY 1, 2),
h AS (SELECT query_id, edge_id, score, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, edge_id) AS rank FROM u),
n AS (SELECT query_id, CAST(sum(s) > 0 AS INT) + CAST(sum(k) > 0 AS INT) + 1 AS n FROM u GROUP BY 1),
a AS (SELECT query_id, CAST(CASE coalesce(n, 0) WHEN 3 THEN 100 WHEN 2 THEN 70 WHEN 1 THEN 30 ELSE 0 END AS INT) AS score FROM q LEFT JOIN n USING (query_id))
"""


def _queries(v: Views):
    asked = v.table("supplier").where("s_suppkey % 20 = 0")
    price = F.col("s_acctbal") / 1000
    return asked.select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("the "), F.col("s_suppkey").cast("string")).alias("text"), F.array(price, F.lit(1.0)).alias("query_vector"))


def _edge_vector():
    return F.array(F.col("weight") / 10000, F.lit(1.0))


def _held(v: Views, rows, tag: str):
    """Rows made once, for plans that read them several times."""
    path = scratch.folder(v.spark, tag)
    with scratch.brief_shuffles(v.spark):
        rows.write.option("compression", "zstd").parquet(path)
    return v.spark.read.parquet(path)


def _found_edges(v: Views):
    """The edges with the columns that a search reads."""
    return _held(v, v.edges.select("edge_id", "episode", "fact", "weight", "type", "verdict", "contested", "invalid_at", "expired_at"), "edges")


def _search(v: Views, edges=None, store=None):
    queries = _queries(v)
    edges = _found_edges(v) if edges is None else edges
    items = _held(v, recall.contenders(edges.select(F.col("edge_id").alias("item_id"), _edge_vector().alias("vector")), TOP_N), "contenders")
    semantic = recall.semantic_topk(queries, items).withColumnRenamed("item_id", "edge_id")
    keyword = recall.bm25_topk(queries.select("query_id", "text"), edges.select(F.col("edge_id").alias("item_id"), F.col("fact").alias("text")))
    related = F.round(cosine(F.col("query_vector"), _edge_vector()), 6)
    return recall.search(semantic, keyword.withColumnRenamed("item_id", "edge_id"), edges, queries, related, store=store)


@query(duck("edges") + f""", q AS (SELECT s_suppkey AS query_id, 'the ' || CAST(s_suppkey AS VARCHAR) || ' part' AS text, s_acctbal / 1000 AS price, s_suppkey % 40 // 20 AS grp FROM supplier WHERE s_suppkey % 20 = 0),
e AS (SELECT edge_id AS item_id, episode % 2 AS grp, fact AS text, weight / 10000 AS x FROM edges WHERE type IN ({_ALLOWED})),
tok AS (SELECT grp, item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM e),
st AS (SELECT grp, avg(len(w)) AS avg_len, count(*) AS n_docs FROM tok GROUP BY 1),
tc AS (SELECT grp, item_id, len, term, count(*) AS tf FROM (SELECT grp, item_id, len(w) AS len, unnest(w) AS term FROM tok) GROUP BY ALL),
df AS (SELECT grp, term, count(*) AS df FROM tc GROUP BY ALL),
qt AS (SELECT DISTINCT query_id, grp, unnest(string_split(text, ' ')) AS term FROM q),
s AS (SELECT query_id, item_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM tc JOIN df USING (grp, term) JOIN qt USING (grp, term) JOIN st USING (grp) GROUP BY 1, 2),
k AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s),
m AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(0.0, least(1.0, (x * price + 1.0) / (sqrt(x * x + 1.0) * sqrt(price * price + 1.0)))), 6) DESC, item_id) AS rank FROM e JOIN q USING (grp)),
f AS (SELECT query_id, item_id, round(sum(1.0::DOUBLE / (rank + 1)), 6) AS score FROM (SELECT * FROM k WHERE rank <= 5 UNION ALL SELECT * FROM m WHERE rank <= 5) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM f) SELECT * FROM r WHERE rank <= 5""")
def search_edges(v: Views):
    """Both channels by their indexes, one of each for a group of edges, fused by ranks."""
    edges = recall.searchable(v.edges.withColumn("group_id", F.concat(F.lit("g"), (F.col("episode") % 2).cast("string"))))
    # the edges are joined once; each index reads them several times
    edges = _held(v, edges.select("group_id", "edge_id", "fact", _edge_vector().alias("vector")), "edges")
    path = scratch.folder(v.spark, "edge-words")
    wordindex.build(edges.select("group_id", F.col("edge_id").alias("item_id"), F.col("fact").alias("text")), path)
    group = F.concat(F.lit("g"), F.floor(F.col("query_id") % 40 / 20).cast("string"))
    queries = _queries(v).withColumn("text", F.concat("text", F.lit(" part"))).withColumn("group_id", group)
    lists = [wordindex.search(queries, path)]
    for name in ("g0", "g1"):
        near = scratch.folder(v.spark, "edge-vectors")
        vectorindex.build(edges.where(F.col("group_id") == name).select(F.col("edge_id").alias("item_id"), "vector"), near)
        lists.append(vectorindex.search(queries.where(F.col("group_id") == name), near, TOP_N))
    ranks = lists[0].unionByName(lists[1]).unionByName(lists[2]).select("query_id", "item_id", "rank")
    return recall.fuse(ranks)


@query(_CHANNELS + "SELECT query_id, edge_id, score, rank, label FROM h WHERE rank <= 5")
def recall_search(v: Views):
    return _search(v)[0]


@query(_CHANNELS + "SELECT query_id, score FROM a")
def recall_search_verdict(v: Views):
    return _search(v)[1].select("query_id", "score")


@query(_CHANNELS.replace("sum(k) > 0 AS INT) + 1 AS n", "sum(k) > 0 AS INT) + CAST(bool_or(epi % 3 <> 0) AS INT) AS n").replace("count(*) FILTER (ch = 's') AS s", "any_value(episode) AS epi, count(*) FILTER (ch = 's') AS s")
       + "SELECT query_id, score FROM a")
def recall_search_stale(v: Views):
    """The third channel looks into a store in which the edges of every third episode have become invalid or are gone."""
    gone = F.when(F.col("episode") % 3 == 0, F.current_timestamp())
    edges = _found_edges(v)
    store = edges.where("episode % 6 <> 0").select("edge_id", gone.alias("invalid_at"))
    return _search(v, edges, store)[1].select("query_id", "score")


@query(_CHANNELS + """, l AS (SELECT query_id, '[' || string_agg('{"edge_id":"' || edge_id || '","label":"' || label || '"}', ',' ORDER BY rank) || ']' AS edges FROM h WHERE rank <= 5 GROUP BY 1)
SELECT query_id, '{"score":' || CAST(score AS VARCHAR) || ',"label":"' || CASE score WHEN 100 THEN 'answer' WHEN 70 THEN 'corroborated-partial' WHEN 30 THEN 'weak/single-source' ELSE 'honest-empty' END
 || '","edges":' || coalesce(edges, '[]') || '}' AS payload FROM a LEFT JOIN l USING (query_id)""")
def recall_payload(v: Views):
    hits, answers = _search(v)
    return recall.payload(hits, answers)


@query(duck("edges") + f""", a AS (SELECT o_orderkey AS anchor_id, CASE o_orderkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'episodic' ELSE 'deep' END AS tier FROM orders)
SELECT anchor_id, edge_id, {_LABEL} AS label, row_number() OVER (PARTITION BY anchor_id ORDER BY weight DESC, edge_id) AS rank FROM a JOIN edges ON episode = anchor_id WHERE tier <> 'none' AND {_SERVED}""")
def recall_expand(v: Views):
    k = F.col("o_orderkey")
    tier = F.when(k % 3 == 0, "none").when(k % 3 == 1, "episodic").otherwise("deep")
    anchors = v.table("orders").select(k.alias("anchor_id"), tier.alias("tier"), k.alias("episode"))
    return recall.expand(anchors, v.edges)


@query(duck("edges") + f""", a AS (SELECT o_orderkey AS anchor_id FROM orders WHERE o_orderkey % 3 <> 0)
SELECT anchor_id, 0 AS score, 'honest-empty' AS label, 'ABSENT' AS cause FROM a WHERE anchor_id NOT IN (SELECT episode FROM edges WHERE {_SERVED})""")
def recall_expand_absent(v: Views):
    k = F.col("o_orderkey")
    tier = F.when(k % 3 == 0, "none").when(k % 3 == 1, "episodic").otherwise("deep")
    anchors = v.table("orders").select(k.alias("anchor_id"), tier.alias("tier"), k.alias("episode"))
    return recall.expand_verdicts(anchors, recall.expand(anchors, v.edges))


_ANCHOR = "[a-z]+ [a-z]+ [a-z]+"
_GREETED = ", ".join(f"'{g}'" for g in GREETINGS)


@query(rf"""WITH b AS (SELECT item_id AS ord, regexp_extract(lower(text), '{_ANCHOR}') AS anchor FROM benchmark), a AS (SELECT * FROM b WHERE anchor <> ''),
t AS (SELECT doc_id AS turn_id, text FROM documents UNION ALL SELECT -1 - conv_id * 1000 - turn, CASE WHEN turn % 2 = 0 THEN text ELSE 'Ok, thanks!' END FROM conversations),
m AS (SELECT turn_id, arg_min(anchor, ord) AS anchor FROM t JOIN a ON contains(lower(text), anchor)
  WHERE regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])' || anchor || '($|[^\p{{L}}\p{{N}}_])') GROUP BY 1),
w AS (SELECT turn_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM t)
SELECT turn_id, anchor, CASE WHEN anchor IS NOT NULL THEN 'episodic'
  WHEN len(w) <= 2 AND len(list_filter(w, lambda x: NOT (length(x) <= 3 OR regexp_replace(x, '^[.,!?]+|[.,!?]+$', '', 'g') IN ({_GREETED})))) = 0 THEN 'none' ELSE 'full' END AS tier
FROM w LEFT JOIN m USING (turn_id)""")
def touch_tier(v: Views):
    anchors = v.table("benchmark").select(F.col("item_id").alias("ord"), F.regexp_extract(F.lower("text"), _ANCHOR, 0).alias("anchor")).where("anchor <> ''")
    said = v.table("conversations").select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("turn_id"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("Ok, thanks!").alias("text"))
    return recall.touch(v.docs.select(F.col("doc_id").alias("turn_id"), "text").unionByName(said), anchors).select("turn_id", "anchor", "tier")


@query(duck("ledger") + """, e AS (SELECT entry_id, 'n' || CAST(entry_id AS VARCHAR) || '.' AS name, CASE WHEN entry_id % 2 = 0 THEN [entry_id + 1, entry_id, entry_id + 2] ELSE []::BIGINT[] END AS refs FROM ledger),
b AS (SELECT r_name || ' n' || CAST(r_regionkey * 12 AS VARCHAR) || '. and n' || CAST(r_regionkey * 1000 + 34 AS VARCHAR) || '.' AS body FROM region)
SELECT entry_id, CAST(entry_id AS VARCHAR) || ',' || CAST(entry_id + 1 AS VARCHAR) || ',' || CAST(entry_id + 2 AS VARCHAR) AS ids FROM e WHERE len(refs) > 0 AND EXISTS (SELECT 1 FROM b WHERE contains(body, name))""")
def diary_anchors(v: Views):
    k, r = F.col("entry_id"), F.col("r_regionkey").cast("long")
    none = F.array().cast("array<bigint>")
    entries = v.ledger.select(k, F.concat(F.lit("n"), k.cast("string"), F.lit(".")).alias("name"), F.when(k % 2 == 0, F.array(k + 1, k, k + 2)).otherwise(none).alias("references"), none.alias("same_topic"), none.alias("supersedes"))
    bodies = v.table("region").select(F.concat("r_name", F.lit(" n"), (r * 12).cast("string"), F.lit(". and n"), (r * 1000 + 34).cast("string"), F.lit(".")).alias("body"))
    return recall.diary_anchors(entries, bodies).select("entry_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


# ---- gate

@query(duck("edges") + _GONE.replace(" WHERE o_orderkey % 50 = 0", "") + """
SELECT episode AS commit_id, edge_id, 'created' AS how FROM edges JOIN orders ON episode = o_orderkey
UNION ALL SELECT window_id, edge_id, 'invalidated' FROM w JOIN edges ON expired_at BETWEEN start_ts AND end_ts""")
def detect(v: Views):
    """Every order is a commit."""
    windows = _expiry_windows(v)
    episodes = windows.select(F.col("window_id").alias("episode"), F.col("window_id").alias("commit_id"))
    return gate.detect(v.edges, episodes, graph.invalidated_in(v.edges, windows))


@query(duck("edges") + " SELECT edge_id AS target, 'verdict' AS action, 'provisional' AS after FROM edges WHERE verdict = 'provisional' AND NOT contested")
def birth_verdicts(v: Views):
    journal = v.edges.where("contested").select(F.col("edge_id").alias("target"), F.lit("verdict").alias("action"))
    return gate.birth_verdicts(v.edges, journal)


@query(duck("edges") + " SELECT edge_id, verdict AS before, CASE WHEN episode % 5 = 0 THEN 'quarantined' ELSE 'confirmed' END AS after FROM edges WHERE (episode % 5 = 0 AND verdict <> 'quarantined') OR (episode % 5 <> 0 AND verdict = 'provisional')")
def verdict_transitions(v: Views):
    new = F.when(F.col("episode") % 5 == 0, gate.quarantined(F.col("verdict"))).otherwise(gate.promoted(F.col("verdict")))
    return gate.transitions(v.edges, new)


@query(duck("edges") + " SELECT edge_id, CASE WHEN episode % 3 <> 0 THEN 'none' WHEN class IN ('C3', 'C4') THEN 'quarantine' ELSE 'amend' END AS effect FROM edges")
def remedy_fence(v: Views):
    remedy = F.when(F.col("episode") % 3 == 0, "amend").when(F.col("episode") % 3 == 1, "revert").otherwise("annotate")
    return v.edges.select("edge_id", gate.remedy_effect(F.col("class"), F.col("fact"), remedy).alias("effect"))


_COMMITS = """WITH c AS (SELECT doc_id, CASE quality WHEN 1 THEN 'PASS' ELSE 'FLAG' END AS screen, CASE toxic WHEN 1 THEN 'UPHOLD' ELSE 'OVERRULE' END AS ruling, doc_id % 7 = 0 AS failed,
 CASE doc_id % 3 WHEN 0 THEN 'amend' WHEN 1 THEN 'revert' ELSE 'annotate' END AS remedy, CASE WHEN doc_id % 2 = 0 THEN 'C3' ELSE 'C1' END AS class FROM labels)
"""


def _commits(v: Views):
    k = F.col("doc_id")
    return v.table("labels").select(
        "doc_id", F.when(F.col("quality") == 1, "PASS").otherwise("FLAG").alias("screen"), F.when(F.col("toxic") == 1, "UPHOLD").otherwise("OVERRULE").alias("ruling"),
        (k % 7 == 0).alias("verifier_failed"), F.when(k % 3 == 0, "amend").when(k % 3 == 1, "revert").otherwise("annotate").alias("remedy"),
        F.when(k % 2 == 0, "C3").otherwise("C1").alias("class"), F.lit("a fact").alias("fact"))


# Commits from the labels, their created edges from the episodes of the same number.
_GATE = duck("edges") + """, c0 AS (SELECT doc_id AS commit_id, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN quality = 1 THEN 'PASS' ELSE 'FLAG' END AS screen,
  CASE toxic WHEN 1 THEN 'UPHOLD' ELSE 'OVERRULE' END AS ruling, doc_id % 7 = 0 AS failed, CASE doc_id % 3 WHEN 0 THEN 'amend' WHEN 1 THEN 'revert' ELSE 'annotate' END AS remedy FROM labels),
f AS (SELECT episode, min(edge_id) AS first FROM edges GROUP BY 1),
c AS (SELECT commit_id, CASE WHEN screen = 'PASS' THEN 'pass' WHEN failed THEN 'held' ELSE 'ruled' END AS way, ruling, remedy,
  CASE WHEN commit_id % 2 = 0 THEN first ELSE 'elsewhere' END AS target FROM c0 LEFT JOIN f ON episode = commit_id),
x AS (SELECT commit_id, way, edge_id, verdict, fact, way = 'ruled' AND target = edge_id AND remedy = 'amend' AS touched, class IN ('C3', 'C4') AS persona
  FROM c JOIN edges ON episode = commit_id),
y AS (SELECT *, CASE WHEN way = 'held' OR (touched AND persona) OR verdict = 'quarantined' THEN 'quarantined' ELSE 'confirmed' END AS after FROM x)
"""


def _gate(v: Views):
    k = F.col("doc_id")
    first = v.edges.groupBy("episode").agg(F.min("edge_id").alias("first"))
    commits = v.table("labels").join(first, k == F.col("episode"), "left").select(
        k.alias("commit_id"), F.when(k % 13 == 0, None).when(F.col("quality") == 1, "PASS").otherwise("FLAG").alias("screen"),
        F.when(F.col("toxic") == 1, "UPHOLD").otherwise("OVERRULE").alias("ruling"), (k % 7 == 0).alias("verifier_failed"),
        F.when(k % 3 == 0, "amend").when(k % 3 == 1, "revert").otherwise("annotate").alias("remedy"),
        F.when(k % 2 == 0, F.col("first")).otherwise("elsewhere").alias("remedy_target"), F.lit("put right").alias("content"))
    return commits, v.edges.select(F.col("episode").alias("commit_id"), "edge_id", "verdict", "class", "fact")


@query(_GATE + "SELECT commit_id, edge_id, after, CASE WHEN touched AND NOT persona THEN 'put right' ELSE fact END AS fact_after FROM y")
def gate_outcomes(v: Views):
    return gate.run_gate(*_gate(v)).select("commit_id", "edge_id", "after", "fact_after")


@query(_GATE + """SELECT commit_id, 'gate-flag' AS action, NULL AS target, NULL AS before, NULL AS after FROM c WHERE way <> 'pass'
UNION ALL SELECT commit_id, 'gate-resolve', NULL, NULL, CASE way WHEN 'pass' THEN 'pass' WHEN 'held' THEN 'quarantined' ELSE CASE WHEN target IS NOT NULL AND target <> 'elsewhere' THEN 'remedy-applied' ELSE lower(ruling) END END FROM c
UNION ALL SELECT commit_id, 'gate-resolve', edge_id, fact, 'amended' FROM y WHERE touched AND NOT persona
UNION ALL SELECT commit_id, 'verdict', edge_id, verdict, after FROM y WHERE verdict <> after OR (touched AND persona)""")
def gate_journal(v: Views):
    commits, created = _gate(v)
    return gate.gate_journal(commits, gate.run_gate(commits, created))


@query(duck("edges") + ", r AS (SELECT edge_id FROM edges WHERE invalid_at IS NOT NULL AND contested) SELECT edge_id, 'revert' AS action FROM r UNION ALL SELECT edge_id, 'contest' FROM r")
def reverts(v: Views):
    gone = v.edges.where("invalid_at is not null")
    return gate.reverts(gone.select("edge_id", F.when(F.col("contested"), "REVERT").otherwise("UPHOLD").alias("ruling")))


@query(_COMMITS + ", r AS (SELECT c.doc_id, length(text) > 5000 AS long, screen, CASE WHEN c.doc_id % 11 = 0 THEN 1 ELSE 0 END AS hard, CAST('0x' || substr(md5(CAST(c.doc_id AS VARCHAR)), 1, 4) AS INT) < CAST(0.05 * 65536 AS INT) AS audit FROM c JOIN documents USING (doc_id))"
       " SELECT doc_id, CASE WHEN long THEN 'size' WHEN screen = 'FLAG' THEN 'screen-flag' WHEN hard > 0 THEN 'tier0-hard' WHEN audit THEN 'audit' ELSE 'pass' END AS route FROM r")
def ladder_routes(v: Views):
    rows = _commits(v).join(v.docs.select("doc_id", "text"), "doc_id")
    hard = (F.col("doc_id") % 11 == 0).cast("int")
    return rows.select("doc_id", gate.ladder_route(gate.size_route(F.col("text"), 5000) == "verifier", F.col("screen"), hard, gate.sampled(F.col("doc_id"))).alias("route"))


@query("SELECT doc_id, CASE WHEN length(text) > 24000 THEN 'verifier' ELSE 'screen' END AS route FROM documents")
def size_route(v: Views):
    return v.docs.select("doc_id", gate.size_route(F.col("text")).alias("route"))


@query(_COMMITS + "SELECT count(*) AS passes, count(*) FILTER (ruling = 'UPHOLD') AS false_passes, round(count(*) FILTER (ruling = 'UPHOLD') / count(*), 6) AS rate, count(*) FILTER (ruling = 'UPHOLD') / count(*) > 0.10 AS breached FROM c"
       " WHERE screen = 'PASS'")
def audit_control_chart(v: Views):
    return gate.control_chart(_commits(v).where("screen = 'PASS'").select((F.col("ruling") == "UPHOLD").alias("false_pass")))


_WORKERS = (("screen", "verdict", "PASS", "FLAG"), ("verifier", "ruling", "UPHOLD", "OVERRULE"), ("judge", "recommendation", "EARNED", "REVERT"), ("merge", "verdict", "SAME", "BOUNDARY"))


@query("SELECT event_id, CASE WHEN event_id % 8 < 3 THEN good WHEN event_id % 8 = 3 AND w = 3 THEN 'banana' ELSE usual END AS verdict FROM (SELECT event_id, (event_id // 8) % 4 AS w FROM events) JOIN (VALUES "
       + ", ".join(f"({n}, '{good}', '{usual}')" for n, (_, _, good, usual) in enumerate(_WORKERS)) + ") d(n, good, usual) ON n = w")
def worker_defaults(v: Views):
    """Replies in eight shapes: plain, fenced, inside prose, another word, another field, empty, no object, broken."""
    k = F.col("event_id")
    worker, body, other, field = (F.lit(None).cast("string"),) * 4
    for n, (name, key, good, _) in enumerate(_WORKERS):
        mine = F.floor(k / 8) % 4 == n
        worker, field = F.when(mine, name).otherwise(worker), F.when(mine, key).otherwise(field)
        body, other = F.when(mine, f'{{"{key}": "{good}"}}').otherwise(body), F.when(mine, f'{{"answer": "{good}"}}').otherwise(other)
    shapes = [
        body, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("So {this} it is: "), body, F.lit(" and [1].")),
        F.concat(F.lit('{"'), field, F.lit('": "banana"}')), other, F.lit(""), F.lit('["PASS"]'), F.concat(F.lit('{"'), field, F.lit('": ')),
    ]
    reply = F.lit(None).cast("string")
    for n, shape in enumerate(shapes):
        reply = F.when(k % 8 == n, shape).otherwise(reply)
    return v.table("events").select("event_id", gate.worker_verdict(worker, reply).alias("verdict"))
