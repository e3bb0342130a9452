"""JSON objects inside the free text of a model's reply."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def longest_object(text: str | None) -> str:
    """The longest valid JSON value in a text, compact; {} unless that is an object.

    The decoder reads a value from each opening bracket that is not inside one already read, so
    fenced blocks need no care of their own.
    """
    best, size, at = None, 0, 0
    decoder = json.JSONDecoder()
    text = text or ""
    while at < len(text):
        if text[at] in "{[":
            try:
                value, end = decoder.raw_decode(text, at)
            except (ValueError, RecursionError):
                at += 1
                continue
            if end - at > size:
                best, size = value, end - at
            at = end
        else:
            nxt = [x for x in (text.find("{", at + 1), text.find("[", at + 1)) if x >= 0]
            at = min(nxt, default=len(text))
    return json.dumps(best if isinstance(best, dict) else {}, separators=(",", ":"), ensure_ascii=False)


def safe_json(reply: Column) -> Column:
    """A reply's object as compact JSON text, {} if there is none; in Arrow batches."""
    @F.pandas_udf("string")
    def longest(values):
        return values.map(longest_object)

    return longest(F.coalesce(reply, F.lit("")))
