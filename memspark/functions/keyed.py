"""Scrubbing with keyed hashes in the placeholders, and the list of what was hidden.

The rules are those of functions.text.scrub; a keyed hash of each secret can only be taken outside the
plan (the key must not show in it), so the texts go through Arrow batches here.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import ENTROPY_BITS, ENTROPY_TOKEN, SECRET_NAME_WORDS, SECRET_PATTERNS

RESULT = "text string, matches array<struct<kind:string,fingerprint:string,via:string>>"

_HOME = re.compile(r"(?<!\w)/(?:Users|home)/[^/\s]+")
_PATTERNS = [(kind, re.compile(pattern), group) for kind, pattern, group in SECRET_PATTERNS]
_HEAD = r"(?im)^(\s*(?:export\s+)?[A-Za-z0-9_]*(?:" + "|".join(SECRET_NAME_WORDS) + r")[A-Za-z0-9_]*\s*=\s*)"
_QUOTED = [(q, re.compile(rf"{_HEAD}{q}(?!<redacted:secret)([^{q}]*){q}")) for q in "\"'"]
_BARE = re.compile(rf"""{_HEAD}(?!"[^"]*"|'[^']*'|<redacted:secret)([^\s#]+)""")
_TOKENS = re.compile(rf"<redacted:secret kind=[a-z_]+(?: hash=[0-9a-f]+)?>|{ENTROPY_TOKEN}")
_ALLOWED = re.compile(r"[0-9a-f]{7,40}|[0-9a-f]{64}|EP-\d{4}-\d{2}-\d{2}\.\d{4,}")


def entropy(token: str) -> float:
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values())


def scrub_text(text: str | None, fingerprint: Callable[[str], str | None]) -> tuple[str, list[tuple[str, str, str]]]:
    """The scrubbed text, and (kind, fingerprint, via) of each secret in the order in which the rules hid them."""
    found: list[tuple[str, str, str]] = []

    def hide(kind: str, secret: str, via: str = "pattern") -> str:
        mark = fingerprint(secret)
        found.append((kind, mark or "", via))
        return f"<redacted:secret kind={kind} hash={mark}>" if mark else f"<redacted:secret kind={kind}>"

    def high(m: re.Match) -> str:
        t = m[0]
        keep = t.startswith("<redacted:secret") or _ALLOWED.fullmatch(t) or entropy(t) < ENTROPY_BITS
        return t if keep else hide("high_entropy", t, "entropy")

    out = _HOME.sub("~", text or "")
    for kind, pattern, group in _PATTERNS:
        out = pattern.sub((lambda m, k=kind: m[1] + hide(k, m[2])) if group else (lambda m, k=kind: hide(k, m[0])), out)
    for q, pattern in _QUOTED:
        out = pattern.sub(lambda m, q=q: m[1] + q + hide("env_assignment", m[2]) + q, out)
    out = _BARE.sub(lambda m: m[1] + hide("env_assignment", m[2]), out)
    return _TOKENS.sub(high, out), found


def keyed_scrub(key: bytes | None) -> Callable[[Column], Column]:
    """Column -> struct (text, matches). Without a key placeholders carry no hash, as scrub() writes them."""
    def fingerprint(secret: str) -> str | None:
        return hmac.new(key, secret.encode(), hashlib.sha256).hexdigest()[:12] if key else None

    @F.pandas_udf(RESULT)
    def scrubbed(values):
        import pandas as pd

        rows = [scrub_text(v, fingerprint) for v in values]
        matches = [[{"kind": k, "fingerprint": f, "via": v} for k, f, v in m] for _, m in rows]
        return pd.DataFrame({"text": [t for t, _ in rows], "matches": matches})

    return lambda c: scrubbed(F.coalesce(c, F.lit("")))
