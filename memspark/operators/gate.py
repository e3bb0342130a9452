"""The quality gate: birth verdicts, screening routes, rulings, remedies, audits, as decision tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import safe_json
from ..functions.text import attributed_names, n_words, number_date_tokens
from ..values import AUDIT_RATE, BREACH, SCREEN_WINDOW_CHARS, TRIVIAL_WORDS, WORKER_REPLIES


def detect(edges: DataFrame, episodes: DataFrame, expired: DataFrame) -> DataFrame:
    """(commit_id, edge_id, how): edges a commit created, and those its window invalidated."""
    created = edges.join(episodes.select("episode", "commit_id"), "episode").select("commit_id", "edge_id", F.lit("created").alias("how"))
    return created.unionByName(expired.select(F.col("window_id").alias("commit_id"), "edge_id", F.lit("invalidated").alias("how")))


def birth_verdicts(edges: DataFrame, journal: DataFrame) -> DataFrame:
    """Journal rows for provisional edges that have no verdict yet."""
    known = journal.where("action = 'verdict'").select(F.col("target").alias("edge_id")).distinct()
    fresh = edges.where("verdict = 'provisional'").join(known, "edge_id", "left_anti")
    return fresh.select(F.col("edge_id").alias("target"), F.lit("verdict").alias("action"), F.lit("provisional").alias("after"))


def promoted(verdict: Column) -> Column:
    """A passed edge is confirmed, unless it is held."""
    return F.when(verdict == "quarantined", verdict).otherwise(F.lit("confirmed"))


def quarantined(verdict: Column) -> Column:
    return F.lit("quarantined")


def transitions(edges: DataFrame, new: Column) -> DataFrame:
    """(edge_id, before, after) where the state changes."""
    return edges.select("edge_id", F.col("verdict").alias("before"), new.alias("after")).where("before <> after")


def is_persona_anchor(cls: Column, fact: Column) -> Column:
    return F.coalesce(cls.isin("C3", "C4"), F.lit(False)) | F.coalesce(fact.contains("Trait:") | fact.contains("Value:"), F.lit(False))


def remedy_effect(cls: Column, fact: Column, remedy: Column) -> Column:
    """Amendments of anchors quarantine them; other remedies do nothing to an edge."""
    return F.when(remedy != "amend", "none").when(is_persona_anchor(cls, fact), "quarantine").otherwise("amend")


def run_gate(commits: DataFrame, created: DataFrame) -> DataFrame:
    """What the gate does to each created edge.

    commits: (commit_id, screen, ruling, verifier_failed, remedy, remedy_target, content), created:
    (commit_id, edge_id, verdict, class, fact). Returns created with route (pass, held, resolved),
    effect (of the remedy, on its target alone), after and fact_after.

    A screen that is not a PASS is a FLAG, nulls included. A flag that nobody can judge holds every
    edge. After a ruling, whichever it is, the remedy is applied to its target if the commit made
    that; all edges that are not quarantined by then are confirmed.
    """
    flagged = ~F.coalesce(F.col("screen") == "PASS", F.lit(False))
    route = F.when(~flagged, "pass").when(F.coalesce("verifier_failed", F.lit(True)), "held").otherwise("resolved")
    rows = created.join(commits.withColumn("route", route), "commit_id")
    aimed = (F.col("route") == "resolved") & F.coalesce(F.col("remedy_target") == F.col("edge_id"), F.lit(False))
    effect = F.when(aimed, remedy_effect(F.col("class"), F.concat_ws(" ", "edge_id", "fact"), F.coalesce("remedy", F.lit("none")))).otherwise("none")
    rows = rows.withColumn("effect", effect)
    verdict = F.coalesce("verdict", F.lit("provisional"))
    after = F.when((F.col("route") == "held") | (F.col("effect") == "quarantine"), "quarantined").otherwise(promoted(verdict))
    fact = F.when(F.col("effect") == "amend", F.coalesce(F.nullif("content", F.lit("")), F.col("fact"))).otherwise(F.col("fact"))
    return rows.withColumn("after", after).withColumn("fact_after", fact)


def gate_journal(commits: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(commit_id, action, target, before, after): what run_gate() writes into the journal.

    A flag and its resolution for the commit, one more resolution for an amended edge, and a verdict
    for each edge whose state is set.
    """
    aimed = outcomes.groupBy("commit_id").agg(F.max(F.col("remedy_target").eqNullSafe(F.col("edge_id"))).alias("_aimed"))
    flagged = ~F.coalesce(F.col("screen") == "PASS", F.lit(False))
    failed = F.coalesce("verifier_failed", F.lit(True))
    result = (
        F.when(~flagged, "pass").when(failed, "quarantined").when(F.coalesce("_aimed", F.lit(False)), "remedy-applied")
        .otherwise(F.lower(F.coalesce("ruling", F.lit(WORKER_REPLIES["verifier"][2]))))
    )
    none = F.lit(None).cast("string")

    def row(action: str, after: Column, target: Column = none, before: Column = none) -> Column:
        return F.struct(F.lit(action).alias("action"), target.alias("target"), before.alias("before"), after.alias("after"))

    whole = commits.join(aimed, "commit_id", "left").select(
        "commit_id", F.inline(F.filter(F.array(F.when(flagged, row("gate-flag", none)), row("gate-resolve", result)), lambda r: r.isNotNull())))
    amended = F.when(F.col("effect") == "amend", row("gate-resolve", F.lit("amended"), F.col("edge_id"), F.col("fact")))
    changed = (F.col("effect") == "quarantine") | ~F.col("verdict").eqNullSafe(F.col("after"))
    state = F.when(changed, row("verdict", F.col("after"), F.col("edge_id"), F.coalesce("verdict", F.lit("provisional"))))
    edges = outcomes.select("commit_id", F.inline(F.filter(F.array(amended, state), lambda r: r.isNotNull())))
    return whole.unionByName(edges)


def run_ladder(commits: DataFrame, created: DataFrame, shadow: bool = True, rate: float = AUDIT_RATE, cap: int = SCREEN_WINDOW_CHARS) -> tuple[DataFrame, DataFrame]:
    """The inspection ladder over commits (commit_id, window, ride_along, speakers, screen, ruling, verifier_failed,
    remedy, remedy_target, content) and their created edges: (outcomes as run_gate's, journal rows).

    The first rung that takes a commit decides: a window beyond cap, a flag of the screen, a hard flag of
    tier 0 (not in shadow mode, where hard flags are only noted), an audit of a pass. What a rung sends
    to the verifier is settled by the ruling, held if there is none; an audited pass is confirmed
    whatever the ruling, which only counts as a false pass when it upholds.
    """
    corpus = F.concat(F.coalesce("window", F.lit("")), F.lit("\n"), F.coalesce("ride_along", F.lit("")))
    facts = created.join(commits.select("commit_id", corpus.alias("corpus"), "speakers"), "commit_id")
    # an edge that a commit holds several times is flagged once for each of its tokens
    hard = tier0_flags(facts, "commit_id").distinct().groupBy("commit_id").agg(F.collect_list("edge_id").alias("_hard"))
    n = created.groupBy("commit_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = commits.join(hard, "commit_id", "left").join(n, "commit_id", "left")
    n_hard = F.coalesce(F.size("_hard"), F.lit(0))
    screen = F.when(F.col("screen") == "PASS", "PASS").otherwise("FLAG")
    route = ladder_route(size_route(F.col("window"), cap) == "verifier", screen, F.lit(0) if shadow else F.greatest(n_hard, F.lit(0)), sampled(F.col("commit_id"), rate))
    rows = rows.withColumn("rung", route).withColumn("_trip", tripwire(F.coalesce("window", F.lit("")), F.coalesce("_n", F.lit(0))))
    asked = F.col("rung") != "pass"
    lost = F.coalesce("verifier_failed", F.lit(True))
    # for the gate, a rung that asks the verifier is a flag; an audit that can't be judged is still a pass
    gated = rows.withColumn("screen", F.when(asked & ~((F.col("rung") == "audit") & lost), "FLAG").otherwise("PASS"))
    outcomes = run_gate(gated.drop("_hard", "_n", "_trip"), created)
    aimed = outcomes.groupBy("commit_id").agg(F.max(F.col("remedy_target").eqNullSafe(F.col("edge_id"))).alias("_aimed"))
    ruled = F.when(F.coalesce("_aimed", F.lit(False)), "remedy-applied").otherwise(F.lower(F.coalesce("ruling", F.lit(WORKER_REPLIES["verifier"][2]))))
    none = F.lit(None).cast("string")

    def row(action: str, reason: Column, after: Column = none, target: Column = none) -> Column:
        return F.struct(F.lit(action).alias("action"), target.alias("target"), after.alias("after"), reason.alias("reason"))

    empty = F.array().cast("array<struct<action:string,target:string,after:string,reason:string>>")
    noted = F.transform(F.coalesce("_hard", F.array().cast("array<string>")), lambda e: row("gate-flag", F.lit("tier0-shadow"), target=e)) if shadow else empty
    trip = F.when(F.col("_trip"), F.array(row("gate-flag", F.lit("tier0-tripwire")))).otherwise(empty)
    result = row("gate-resolve", none, F.when(~asked, "pass").when(lost, "verifier-unavailable").otherwise(ruled))
    settled = F.when(asked, F.array(row("gate-flag", F.lit("ladder major")), result)).otherwise(F.array(result))
    journal = rows.join(aimed, "commit_id", "left").select("commit_id", F.inline(F.concat(noted, trip, settled)))
    return outcomes, journal


def reverts(rulings: DataFrame) -> DataFrame:
    """Two journal rows for each invalidation that is reverted (edge_id, ruling)."""
    back = rulings.where("ruling = 'REVERT'")
    return back.select("edge_id", F.explode(F.array(F.lit("revert"), F.lit("contest"))).alias("action"))


def judged(invalidated: DataFrame, rulings: DataFrame) -> DataFrame:
    """(edge_id, ruling): invalidated edges with the judge's ruling; what was not ruled on goes back."""
    return invalidated.join(rulings, "edge_id", "left").select("edge_id", F.when(F.col("ruling") == "EARNED", "EARNED").otherwise("REVERT").alias("ruling"))


def tier0_flags(facts: DataFrame, *columns: str) -> DataFrame:
    """(edge_id, kind, token) for facts (edge_id, fact, corpus, speakers) that claim a number or date the corpus
    lacks, or something said by somebody who did not speak. Further columns of facts may be kept."""
    fact = F.coalesce("fact", F.lit(""))
    absent = F.array_except(number_date_tokens(fact), number_date_tokens(F.col("corpus")))
    strangers = F.array_except(attributed_names(fact), F.col("speakers"))

    def listed(tokens: Column, kind: str) -> Column:
        return F.transform(tokens, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))

    both = F.concat(listed(absent, "number_date_absent"), listed(strangers, "non_participant"))
    return facts.select(*columns, "edge_id", F.inline(both))


def entity_hints(facts: DataFrame) -> DataFrame:
    """(edge_id, entity): entities of an edge that the corpus does not name as whole words."""
    named = facts.select("edge_id", "corpus", F.explode("entities").alias("entity"))
    return named.where(~F.regexp_like(F.col("corpus"), F.concat(F.lit(r"(?U)\b\Q"), F.col("entity"), F.lit(r"\E\b")))).select("edge_id", "entity")


def tripwire(text: Column, n_facts: Column) -> Column:
    """No facts from a window that is long enough to have some."""
    return (n_facts == 0) & (n_words(text) >= TRIVIAL_WORDS)


def size_route(text: Column, cap: int = SCREEN_WINDOW_CHARS) -> Column:
    return F.when(F.length(text) > cap, "verifier").otherwise("screen")


def sampled(key: Column, rate: float = AUDIT_RATE) -> Column:
    """A fixed pseudo-random part of the keys; the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 4), 16, 10).cast("int") < round(rate * 65536)


def ladder_route(too_long: Column, screen: Column, hard_flags: Column, audit: Column) -> Column:
    """The first rung that takes a window."""
    return F.when(too_long, "size").when(screen == "FLAG", "screen-flag").when(hard_flags > 0, "tier0-hard").when(audit, "audit").otherwise("pass")


def control_chart(audits: DataFrame) -> DataFrame:
    """Rate of false passes among audited passes, and whether it breaches."""
    rows = audits.agg(F.count(F.lit(1)).alias("passes"), F.count_if(F.col("false_pass")).alias("false_passes"))
    rate = F.coalesce(F.try_divide(F.col("false_passes"), F.col("passes")), F.lit(0.0))
    return rows.withColumn("rate", F.round(rate, 6)).withColumn("breached", rate > BREACH)


def worker_verdict(worker: Column, reply: Column) -> Column:
    """The verdict in a worker's reply: of the worker's own field and among its words, else its cautious default."""
    said = safe_json(reply)
    out = F.lit(None).cast("string")
    for name, (field, words, default) in WORKER_REPLIES.items():
        value = F.get_json_object(said, f"$.{field}")
        valid = value.isin(*words) if words else value.isNotNull()
        out = F.when(worker == name, F.when(valid, value).otherwise(F.lit(default))).otherwise(out)
    return out


def remedy_of(reply: Column) -> Column:
    """(action, target, content) of a verifier's reply; nothing is to be done where it names no action."""
    said = safe_json(reply)
    return F.struct(
        F.coalesce(F.get_json_object(said, "$.remedy.action"), F.lit("none")).alias("action"),
        F.coalesce(F.get_json_object(said, "$.remedy.target"), F.lit("")).alias("target"),
        F.get_json_object(said, "$.remedy.content").alias("content"),
    )
