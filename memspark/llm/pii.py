"""Personal data and secrets: patterns propose spans, checks confirm them, nearby words adjust the score.

Base kinds, leftmost and non-overlapping within a kind, a failing match is dropped: email, ip
(parts up to 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits). They always stay, whatever
their score. Further kinds need THRESHOLD: iban (a country's length, mod 97), short_card (13 to 15
digits, Luhn), id_number (3-2-4 digits) and secret (long tokens of letters and digits; some have a
known beginning, the others need a word that says so).

Each kind has a score to begin with; words of SUPPORT among the WINDOW code points on either side
raise it, words of DOUBT lower it, and an assignment right before a secret settles it.

All scans are linear in the text: mails are found from their @, runs of digits are matched once.
Offsets are code points, ends exclusive.

Cases: null and empty texts have no spans; null ids and equal rows are handled like others; an
empty table gives an empty result; further columns are kept, names that clash are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "short_card", "id_number", "secret")
THRESHOLD = 0.6
WINDOW = 40
#: What a span of a kind scores by its form and its checksum alone.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.75, "phone": 0.65, "iban": 0.7, "short_card": 0.4, "id_number": 0.35, "secret": 0.3}
RAISE, LOWER, SETTLE = 0.25, 0.2, 0.5
#: Words near a span that speak for its kind.
SUPPORT = {
    "email": ("mail", "e-mail", "email", "contact", "write to", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login", "client", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "telefono"),
    "iban": ("iban", "account", "bank", "bic", "swift", "konto", "compte", "cuenta"),
    "short_card": ("card", "visa", "amex", "credit", "karte", "carte", "tarjeta"),
    "id_number": ("ssn", "social security", "tax id", "id number"),
    "secret": ("token", "secret", "password", "passwd", "key", "apikey", "api key", "credential", "bearer", "auth"),
}
#: Words near a span that speak against it.
DOUBT = {
    "ip": ("version", "release", "section", "chapter"), "card": ("order", "isbn", "serial", "invoice"), "phone": ("order", "isbn", "serial"),
    "short_card": ("order", "isbn", "serial", "invoice", "imei"), "id_number": ("part", "order", "invoice"), "secret": ("commit", "checksum", "sha256", "md5", "digest"),
}
#: Lengths of account numbers by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Beginnings of keys that say whose they are.
KNOWN_KEYS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxb-", "xoxp-", "sk-", "AIza", "eyJ")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a run of digits that fails at its first digit fails at the others too, so they aren't tried
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[ A-Z0-9])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
_ASSIGNED = re.compile(r"""(?i)(?:token|secret|passwd|password|key|credential|bearer|auth)[A-Za-z0-9_]*["']?\s*[:=]?\s*["']?$""")
_WORDS = {
    side: {kind: re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, words)) + r")(?![^\W_])") for kind, words in table.items()}
    for side, table in (("support", SUPPORT), ("doubt", DOUBT))
}
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if n % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    left = 0
    for c in compact[4:] + compact[:4]:
        left = (left * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return left == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _emails(text: str) -> list[tuple[int, int]]:
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _ibans(text: str) -> list[tuple[int, int]]:
    """From each country code as many letters and digits as the country's numbers have, with single blanks between."""
    out, done = [], 0
    for m in _IBAN.finditer(text):
        left = IBAN_LENGTHS.get(m[0][:2], 4) - 4
        if not left or m.start() < done:
            continue
        at = m.end()
        while left and at < len(text):
            c = text[at]
            if c.isascii() and (c.isdigit() or c.isupper()):
                left -= 1
            elif c != " " or text[at - 1] == " ":
                break
            at += 1
        if not left and not text[at:at + 1].isalnum() and mod97(text[m.start():at]):
            out.append((m.start(), at))
            done = at
    return out


def _tokens(text: str) -> list[tuple[int, int]]:
    """Long runs that have letters and digits."""
    out = []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if len(set(t)) >= 8 and any(c.isdigit() for c in t) and any(c.isalpha() for c in t):
            out.append(m.span())
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    """How sure a span is, from 0 to 1: its kind's own score and what the words around say."""
    before, after = text[max(0, start - WINDOW):start].lower(), text[end:end + WINDOW].lower()
    out = SCORES[kind]
    for side, step in (("support", RAISE), ("doubt", -LOWER)):
        words = _WORDS[side].get(kind)
        if words and (words.search(before) or words.search(after)):
            out += step
    if kind == "secret":
        if text.startswith(KNOWN_KEYS, start):
            out += SETTLE
        if _ASSIGNED.search(before):
            out += SETTLE
    return round(min(1.0, max(0.0, out)), 2)


def spans(text: str | None) -> list[Span]:
    """All spans of a text, by kind as listed, then by start."""
    if not text:
        return []
    found = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found["ip"].append(m.span())
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                found["card" if len(d) >= 16 else "short_card"].append(m.span())
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                found["phone"].append(m.span())
        found["iban"], found["id_number"], found["secret"] = _ibans(text), [m.span() for m in _ID.finditer(text)], _tokens(text)
    out: list[Span] = []
    taken: list[tuple[int, int]] = []
    for kind in KINDS:
        for s, e in found[kind]:
            sure = score(text, kind, s, e)
            if kind not in BASE_KINDS:
                # base spans stay; a further kind must be sure, and where nothing else is
                at = bisect_left(taken, (s, s))
                if sure < THRESHOLD or (at and taken[at - 1][1] > s) or (at < len(taken) and taken[at][0] < e):
                    continue
                taken.insert(at, (s, e))
            out.append(Span(kind, s, e, sure))
        if kind == BASE_KINDS[-1]:
            taken = _united((x.start, x.end) for x in out)
    return out


def _united(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with pii: array of (kind, start, end, score), by kind as listed, then by start."""
    prepare(docs.sparkSession)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,score:double>>")
    def found(texts):
        import pandas as pd

        return pd.Series([[s._asdict() for s in spans(t)] for t in texts], dtype=object)

    docs = docs.drop("pii")
    return docs.withColumn("pii", found(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def count(pii: Column, kind: str) -> Column:
    return F.size(F.filter(pii, lambda s: s["kind"] == kind)).cast("long")


def written(pii: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    chosen = F.filter(pii, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scores(pii: Column) -> Column:
    """The spans' scores in the order of written(), comma-joined."""
    return F.array_join(F.transform(pii, lambda s: F.format_number(s["score"], 2)), ",")


def redact(text: Column, pii: Column) -> Column:
    """The text with each span replaced by <kind>; of overlapping spans the first to begin."""
    ordered = F.array_sort(F.transform(pii, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(piece.alias("out"), s["end"].alias("at")))

    return F.aggregate(
        ordered, zero, step,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.length(text) - acc["at"], F.lit(0)))),
    )
