"""What models and people decide is behind small interfaces; each has an offline, deterministic default."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, fields
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import words
from ..operators.gate import worker_verdict
from ..values import ASSISTANT_AUTHOR, FINDINGS_WRITER, USER_AUTHOR


class Extractor(Protocol):
    """Facts of an episode's text."""

    def __call__(self, episode_id: str, content: str) -> Iterable[dict]: ...


class Backend(Protocol):
    """A model that answers a prompt."""

    def complete(self, prompt: str, tier: str) -> str: ...


#: Environment variables and keys of the settings file begin so; the file's name is in <prefix>CONFIG.
ENV_PREFIX = "MEMSPARK_"


@dataclass(frozen=True)
class Options:
    """Settings with their defaults. group_id keeps stores apart and must be set."""

    group_id: str
    user_name: str = USER_AUTHOR
    assistant_name: str = ASSISTANT_AUTHOR
    small_model: str = "small"
    standard_model: str = "standard"
    lookback: int = 50
    diary_days: int = 6
    diary_tokens: int = 4000
    session_depth: int = 3

    def __post_init__(self):
        if not (self.group_id or "").strip():
            raise ValueError("group_id must be set")

    def model(self, tier: str) -> str:
        return self.small_model if tier == "small" else self.standard_model

    @classmethod
    def resolve(cls, environ: Mapping[str, str], **given) -> Options:
        """What is given, else the environment, else the JSON settings file, else the defaults. Blank values and a
        file that can't be read count as not set."""
        import json

        try:
            with open(environ.get(f"{ENV_PREFIX}CONFIG", ""), encoding="utf-8") as f:
                stored = json.load(f)
        except (OSError, ValueError):
            stored = {}
        stored = stored if isinstance(stored, dict) else {}
        values = {}
        for f in fields(cls):
            for source in (given.get(f.name), environ.get(ENV_PREFIX + f.name.upper()), stored.get(f.name)):
                if source is not None and str(source).strip():
                    values[f.name] = int(source) if f.type == "int" else str(source).strip()
                    break
        return cls(**{"group_id": "", **values})


class EchoBackend:
    """Answers nothing, so that every worker falls back to its cautious default."""

    def complete(self, prompt: str, tier: str) -> str:
        return ""


def sentence_facts(episode_id: str, content: str) -> list[dict]:
    """One fact per sentence: the offline extractor."""
    parts = [s.strip() for s in content.replace("\n", " ").split(". ")]
    return [{"edge_id": f"{episode_id}-{n}", "fact": s, "type": "ABOUT"} for n, s in enumerate(p for p in parts if p)]


def extract(episodes: DataFrame, extractor: Extractor = sentence_facts) -> DataFrame:
    """(episode, edge_id, fact, type) from (episode, content), in Arrow batches on the executors."""
    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(e, x["edge_id"], x["fact"], x["type"]) for e, c in zip(f["episode"], f["content"], strict=True) for x in extractor(e, c or "")]
            yield pd.DataFrame(rows, columns=["episode", "edge_id", "fact", "type"])

    return episodes.select(F.col("episode").cast("string"), "content").mapInPandas(run, "episode string, edge_id string, fact string, type string")


def ask(prompts: DataFrame, backend: Backend, tier: str = "standard") -> DataFrame:
    """prompts (id, worker, prompt) with the worker's verdict; unreadable answers count as the worker's default."""
    def run(frames):
        for f in frames:
            yield f.assign(reply=[backend.complete(p, tier) for p in f["prompt"]])[["id", "worker", "reply"]]

    replies = prompts.select(F.col("id").cast("string"), "worker", "prompt").mapInPandas(run, "id string, worker string, reply string")
    return replies.select("id", "worker", worker_verdict(F.col("worker"), F.col("reply")).alias("verdict"))


def hashed_vector(text: Column, size: int = 64) -> Column:
    """Word counts hashed into `size` numbers: the offline embedder, inside the JVM."""
    slots = F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))


def fan_out(tasks: DataFrame, run_one: Callable[[str], Iterable[str]]) -> DataFrame:
    """(task_id, finding): each task's findings, tasks side by side on the executors."""
    def run(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"task_id": f["task_id"], "findings": [list(run_one(p)) for p in f["payload"]]})

    done = tasks.select("task_id", "payload").mapInPandas(run, "task_id string, findings array<string>")
    return done.select("task_id", F.explode("findings").alias("finding"))


def commit_findings(findings: DataFrame, writer: str, path: str, owner: str = FINDINGS_WRITER) -> None:
    """Only the owner may write."""
    if writer != owner:
        raise PermissionError(f"only {owner} may commit findings")
    findings.write.mode("append").parquet(path)


def stable_group(path: str) -> str:
    """A store's group id from its path."""
    import hashlib

    return hashlib.sha1(path.encode()).hexdigest()[:12]


