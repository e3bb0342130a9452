"""One drain at a time: a lock file in the store's folder, on whatever file system that is."""

from __future__ import annotations

import contextlib
import json
import os
import socket
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

NAME = ".drain.lock"


class LockHeld(RuntimeError):
    """Another drain holds the lock."""


def _started(pid: int) -> str | None:
    """When a process of this host began, as the system counts it; None if there is none."""
    try:
        with open(f"/proc/{pid}/stat", encoding="utf-8") as f:
            return f.read().rsplit(") ", 1)[-1].split()[19]
    except (OSError, IndexError):
        return None


def _owner_lives(owner: dict) -> bool:
    """Owners on other hosts count as alive: nothing here can tell."""
    if owner.get("host") != socket.gethostname() or not isinstance(owner.get("pid"), int):
        return bool(owner.get("host"))
    return _started(owner["pid"]) is not None and _started(owner["pid"]) == owner.get("start")


def _read(files, path) -> str | None:
    """The text of a lock; None if it is gone."""
    try:
        stream = files.open(path)
    except Exception:  # no such file
        return None
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def _clear(files, path, aside, stale: str) -> None:
    """Take a dead owner's lock away, by a name of our own: of several that saw it, one gets it.

    What was moved is read again: another may have cleared the lock and taken it since we read it;
    then its lock is put back and we have lost.
    """
    try:
        moved = files.rename(path, aside)
    except Exception:  # it is gone
        moved = False
    if not moved:
        raise LockHeld("another drain cleared the lock first")
    if _read(files, aside) != stale:
        files.rename(aside, path)
        raise LockHeld("another drain took the lock first")
    files.delete(aside, False)


@contextlib.contextmanager
def single_instance(spark: SparkSession, folder: str) -> Iterator[list[dict]]:
    """Hold the folder's lock; yields the journal rows that taking it gave. A lock whose owner is dead is cleared.

    The lock holds a token of its own; it is used, and taken away at the end, only while that token is in it.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    token = uuid.uuid4().hex
    path, aside = (jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{n}") for n in (NAME, f"{NAME}-{token}"))
    files = path.getFileSystem(conf)
    notes: list[dict] = []
    raw = _read(files, path)
    if raw is not None:
        try:
            owner = json.loads(raw)
        except ValueError:
            owner = {}
        if _owner_lives(owner if isinstance(owner, dict) else {}):
            raise LockHeld(f"held by {raw[:200]}")
        _clear(files, path, aside, raw)
        notes.append({"action": "stale-lock-cleared", "scope": "drain"})
    mine = json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "start": _started(os.getpid()), "token": token})
    try:
        out = files.create(path, False)  # fails if another made it in between
    except Exception as error:
        raise LockHeld("another drain took the lock first") from error
    out.write(bytearray(mine.encode()))
    out.close()
    if _read(files, path) != mine:
        raise LockHeld("another drain took the lock")
    try:
        yield notes
    finally:
        if _read(files, path) == mine:
            files.delete(path, False)
