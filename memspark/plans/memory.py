"""The engine's entry points from end to end: capture, extract, recall, brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import cosine
from ..operators import console, gate, graph, ledger, links, recall, transcript, wal
from ..values import DIARY_TOKENS, DRAIN_WINDOW, SESSION_DEPTH, TOP_N
from .saving import confirmation
from .seams import Extractor, extract, hashed_vector, sentence_facts


def capture(records: DataFrame) -> DataFrame:
    """Transcript records (session_id, pos, v) to scrubbed entries of both projections."""
    events = transcript.numbered(transcript.transcript_events(records))
    return transcript.project(transcript.events_of(events))


def extract_queue(entries: DataFrame, wal_lines: DataFrame, episodes: DataFrame, edges: DataFrame, extractor: Extractor = sentence_facts) -> DataFrame:
    """New edges of the queue's first entries; entries that have edges already are not extracted again."""
    batch = ledger.to_extract(ledger.drain_batch(entries), edges)
    return extract(wal.prepared(batch, wal_lines, episodes).select(F.col("entry_id").alias("episode"), "content"), extractor)


def drain_once(
    entries: DataFrame, wal_lines: DataFrame, episodes: DataFrame, edges: DataFrame, replies: DataFrame, decisions: DataFrame | None = None,
    window: int = DRAIN_WINDOW, extractor: Extractor = sentence_facts,
) -> dict[str, DataFrame]:
    """The first entries of the queue from extraction to the end.

    entries: the ledger with annotation, start_ts, end_ts, episode_id; replies: commits for the gate
    (see gate.run_gate) by commit_id = entry_id as text, an entry without one is held; decisions: edges
    that later ones supersede. Edges that an entry has from an earlier, broken drain are used again.
    Returns the created edges with their verdicts, the journal's rows, all edges and the ledger as
    they are afterwards.
    """
    batch = ledger.drain_batch(entries, window)
    todo = ledger.to_extract(batch.withColumn("entry_id", F.col("entry_id").cast("string")), edges.withColumn("episode", F.col("episode").cast("string")))
    content = wal.prepared(batch, wal_lines, episodes).select(F.col("entry_id").cast("string").alias("episode"), "content")
    fresh = extract(content.join(todo.select(F.col("entry_id").alias("episode")), "episode", "left_semi"), extractor)
    kept = ["episode", "edge_id", "fact", "type", "verdict", "class"]
    fresh = fresh.withColumn("verdict", F.lit("provisional")).withColumn("class", F.lit(None).cast("string")).select(*kept)
    again = edges.withColumn("episode", F.col("episode").cast("string")).join(batch.select(F.col("entry_id").cast("string").alias("episode")), "episode", "left_semi").select(*kept)
    created = fresh.unionByName(again).withColumnRenamed("episode", "commit_id")
    commits = batch.select(F.col("entry_id").cast("string").alias("commit_id")).join(replies, "commit_id", "left")
    outcomes = gate.run_gate(commits, created)
    judged = outcomes.select(F.col("commit_id").alias("episode"), "edge_id", F.col("fact_after").alias("fact"), "type", F.col("after").alias("verdict"), "class")
    rest = edges.withColumn("episode", F.col("episode").cast("string")).select(*kept).join(judged.select("edge_id"), "edge_id", "left_anti")
    journal = gate.gate_journal(commits, outcomes)
    whole = rest.unionByName(judged)
    if decisions is not None:
        whole, closed = graph.supersede(whole, decisions)
        journal = journal.unionByName(closed.select(F.col("scope").cast("string").alias("commit_id"), "action", "target", F.lit(None).cast("string").alias("before"), F.col("after").cast("string")))
    done = batch.select(F.col("entry_id").alias("_done"))
    state = F.when(F.col("_done").isNotNull(), "done").otherwise(F.col("extracted"))
    after = entries.join(done, F.col("entry_id") == F.col("_done"), "left").withColumn("extracted", state).drop("_done")
    return {"created": outcomes, "journal": journal, "edges": whole, "ledger": after}


def session_start(entries: DataFrame, lines: DataFrame, now: Column, cap: int = DIARY_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(state with its confirmation line, briefing with the anchors of linked entries that it names)."""
    state = ledger.memory_state(entries, lines, SESSION_DEPTH)
    state = state.withColumn("message", confirmation(F.col("state"), F.col("sessions")))
    sections = briefing(entries, now, cap)
    bodies = sections.select("body")
    named = recall.diary_anchors(entries.select("entry_id", F.col("summary").alias("name"), "references", "same_topic", "supersedes"), bodies)
    lines = named.join(entries.select("entry_id", "summary", "ts"), "entry_id").agg(F.array_sort(F.collect_list(F.struct(
        "ts", "entry_id", F.concat(F.lit("- "), F.col("summary"), F.lit(" -> "), F.array_join(F.col("ids").cast("array<string>"), ", ")).alias("line")))).alias("l"))
    anchors = lines.where(F.size("l") > 0).select(F.lit("all").alias("owner"), F.lit("ANCHORS").alias("section"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))
    return state, sections.select("owner", "section", "body").unionByName(anchors)


def supervise(
    commits: DataFrame, created: DataFrame, journal: DataFrame, invalidated: DataFrame | None = None, rulings: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Births, outcomes, journal rows and state changes of commits (see gate.run_gate); with the edges that a commit
    invalidated (edge_id, .., evidence_against) and the judge's rulings (edge_id, ruling) also what is reopened."""
    outcomes = gate.run_gate(commits, created)
    more = {}
    if invalidated is not None:
        ruled = gate.judged(invalidated, rulings)
        back = ruled.where("ruling = 'REVERT'").select("edge_id")
        more = {"reverts": gate.reverts(ruled), "reopened": graph.reopen(invalidated.join(back, "edge_id", "left_semi"), F.col("commit_id").cast("string"))}
    return more | {
        "births": gate.birth_verdicts(created, journal), "outcomes": outcomes, "journal": gate.gate_journal(commits, outcomes),
        "transitions": outcomes.select("edge_id", F.col("verdict").alias("before"), "after").where("before <> after"),
    }


def search(queries: DataFrame, edges: DataFrame, n: int = TOP_N) -> tuple[DataFrame, DataFrame]:
    """Hits and verdicts of queries (query_id, text) over edges, vectors by the offline embedder."""
    q = queries.select("query_id", "text", hashed_vector(F.col("text")).alias("query_vector"))
    items = edges.select(F.col("edge_id").alias("item_id"), hashed_vector(F.col("fact")).alias("vector"))
    semantic = recall.semantic_topk(q, items, n).where("score > 0").withColumnRenamed("item_id", "edge_id")
    keyword = recall.bm25_topk(queries, edges.select(F.col("edge_id").alias("item_id"), F.col("fact").alias("text")), n)
    related = F.round(cosine(F.col("query_vector"), hashed_vector(F.col("fact"))), 6)
    return recall.search(semantic, keyword.withColumnRenamed("item_id", "edge_id"), edges, q, related, n)


def search_or_degraded(queries: DataFrame, edges: DataFrame, n: int = TOP_N) -> list[dict]:
    """Payloads for serving; a store that fails to answer says so instead of seeming empty."""
    try:
        hits, answers = search(queries, edges, n)
        return [r.asDict() for r in recall.payload(hits, answers).collect()]  # n edges for each query
    except Exception as error:  # the caller must learn that recall is down
        return [{"query_id": None, "payload": '{"score":0,"label":"honest-empty","cause":"degraded"}', "error": str(error)[:200]}]


def briefing(entries: DataFrame, now: Column, cap: int = DIARY_TOKENS) -> DataFrame:
    items = console.diary_items(entries, now).withColumn("owner", F.lit("all"))
    return console.budgeted(console.diary_sections(items), cap)


def link(entries: DataFrame) -> DataFrame:
    """Typed edges of entries' structural links."""
    return links.link_edges(links.structural_links(entries))


def console_model(entries: DataFrame, journal: DataFrame) -> dict[str, DataFrame]:
    return {
        "cards": console.report_cards(entries.withColumnRenamed("session_id", "scope"), journal), "health": console.health(journal),
        "security": console.security_view(journal), "infra": console.infra_view(journal), "queue": ledger.queue_status(entries),
    }


__all__ = [
    "briefing", "capture", "console_model", "drain_once", "extract_queue", "link", "search", "search_or_degraded", "session_start", "supervise",
]
