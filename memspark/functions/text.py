"""Text functions as column expressions: masking, secrets, entropy, keyed fingerprints, claims.

Patterns follow Unicode word rules ((?U)), and lines end at line feeds only ((?d)).
"""

from __future__ import annotations

import hashlib
import hmac
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import (
    ATTRIBUTION_VERBS, ENTROPY_BITS, ENTROPY_TOKEN, GREETINGS, NOT_NAMES, SECRET_NAME_WORDS, SECRET_PATTERNS, SENSITIVE_PATHS,
)

_PLACEHOLDER = r"<redacted:secret kind=[a-z_]+(?: hash=[0-9a-f]+)?>"


#: What a text must contain for a rule to find anything; the lower-case ones in any case.
_NEEDLES = {
    "home": ("/Users/", "/home/"), "aws_access_key_id": ("AKIA", "ASIA"), "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "slack_token": ("xox",),
    "openai_key": ("sk-",), "anthropic_key": ("sk-ant-",), "google_api_key": ("AIza",), "private_key_block": ("-----BEGIN",), "jwt": ("eyJ",),
    "env_assignment": ("=",),
}
_NEEDLES_ANY_CASE = {"auth_header": ("authorization",), "api_key_header": ("api-key", "x-auth-token", "apikey")}
_NEVER = r"\A(?!)"


def _where_needed(source: Column, kind: str, pattern: str) -> Column:
    """The pattern for texts that have one of the rule's needles, one that fails at once for the others. The needles
    are looked for in the source, so that the expression does not grow with each rule."""
    low = kind in _NEEDLES_ANY_CASE
    looked, needles = (F.lower(source), _NEEDLES_ANY_CASE[kind]) if low else (source, _NEEDLES[kind])
    return F.when(reduce(Column.__or__, [looked.contains(n) for n in needles]), F.lit(pattern)).otherwise(F.lit(_NEVER))


def mask_home_paths(text: Column) -> Column:
    return F.regexp_replace(text, _where_needed(text, "home", r"(?U)(?<!\w)/(?:Users|home)/[^/\s]+"), F.lit("~"))


def placeholder(kind: str) -> str:
    return f"<redacted:secret kind={kind}>"


def scrub_patterns(text: Column, source: Column | None = None) -> Column:
    """Known secrets replaced by placeholders, most specific kind first. A value that is already a
    placeholder, quoted or not, is left, so a second pass changes nothing.

    source: the column that text was made from, if what was done to it takes no secret away.
    """
    out = text
    source = text if source is None else source
    for kind, pattern, group in SECRET_PATTERNS:
        if group:
            # no value of these begins inside a placeholder: < is not one of its characters
            out = F.regexp_replace(out, _where_needed(source, kind, f"(?U){pattern}"), F.lit(f"$1{placeholder(kind)}"))
        else:
            out = F.regexp_replace(out, _where_needed(source, kind, f"(?U){pattern}"), F.lit(placeholder(kind)))
    name = "[A-Za-z0-9_]*(?:" + "|".join(SECRET_NAME_WORDS) + ")[A-Za-z0-9_]*"
    head = rf"(?imdU)^(\s*(?:export\s+)?{name}\s*=\s*)"
    mark = placeholder("env_assignment")
    kept = "(?!<redacted:secret)"
    out = F.regexp_replace(out, _where_needed(source, "env_assignment", rf'{head}"{kept}[^"]*"'), F.lit(f'$1"{mark}"'))
    out = F.regexp_replace(out, _where_needed(source, "env_assignment", rf"{head}'{kept}[^']*'"), F.lit(f"$1'{mark}'"))
    # bare, or with a quote that is never closed
    return F.regexp_replace(out, _where_needed(source, "env_assignment", rf"""{head}(?!"[^"]*"|'[^']*'|<redacted:secret)[^\s#]+"""), F.lit(f"$1{mark}"))


def shannon_entropy(s: Column) -> Column:
    """Bits per character; 0 for the empty string."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    parts = F.transform(
        F.array_distinct(chars),
        lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"),
    )
    return F.aggregate(parts, F.lit(0.0), lambda acc, k: acc - (k / n) * F.log2(k / n))


def allowed_token(token: Column) -> Column:
    """Shapes that look random and are no secrets: commit ids, episode ids, digests."""
    return token.rlike(r"^(?:[0-9a-f]{7,40}|[0-9a-f]{64}|EP-\d{4}-\d{2}-\d{2}\.\d{4,})$")


def scrub_entropy(text: Column) -> Column:
    """Long tokens of high entropy replaced. Tokens and the text between them are taken apart and
    joined again, placeholders count as tokens and stay."""
    token = f"{_PLACEHOLDER}|{ENTROPY_TOKEN}"

    def judge(t: Column) -> Column:
        keep = t.startswith("<redacted:secret") | allowed_token(t) | (shannon_entropy(t) < ENTROPY_BITS)
        return F.when(keep, t).otherwise(F.lit(placeholder("high_entropy")))

    def replaced(x: Column) -> Column:
        between = F.split(x, token, -1)
        judged = F.concat(F.transform(F.regexp_extract_all(x, F.lit(token), F.lit(0)), judge), F.array(F.lit("")))
        # most texts have no such token
        return F.when(
            x.rlike(ENTROPY_TOKEN), F.array_join(F.zip_with(between, judged, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        ).otherwise(x)

    # as the variable of a lambda the text, itself a long expression, is there once
    return F.transform(F.array(text), replaced)[0]


def scrub(text: Column) -> Column:
    """Home paths, known secrets, random-looking tokens; null becomes empty."""
    source = F.coalesce(text, F.lit(""))
    return scrub_entropy(scrub_patterns(mask_home_paths(source), source))


def scrub_matches(text: Column) -> Column:
    """array<struct<kind, via>>: what scrub() replaces, by kind; placeholders that were there before don't count."""
    pattern = F.lit(r"<redacted:secret kind=([a-z_]+)(?: hash=[0-9a-f]+)?>")

    def listed(out: Column) -> Column:
        before, after = (F.regexp_extract_all(x, pattern, F.lit(1)) for x in (F.coalesce(text, F.lit("")), out))

        def fresh(kind: Column) -> Column:
            n = F.size(F.filter(after, lambda k: k == kind)) - F.size(F.filter(before, lambda k: k == kind))
            via = F.when(kind == "high_entropy", "entropy").otherwise("pattern")
            return F.array_repeat(F.struct(kind.alias("kind"), via.alias("via")), F.greatest(n, F.lit(0)))

        return F.flatten(F.transform(F.array_sort(F.array_distinct(after)), fresh))

    # as the variable of a lambda the scrubbed text is made once, however often it is used
    return F.transform(F.array(scrub(text)), listed)[0]


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 from the definition. Its pads show in plans: use it for public keys only."""
    key = key if len(key) <= 64 else hashlib.sha256(key).digest()
    block = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in block) for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def keyed_fingerprint(key: bytes | None):
    """Column -> Column: the first 12 digits of the HMAC, null without a key. The key stays in the
    function that workers get and never enters a plan."""
    if not key:
        return lambda c: F.lit(None).cast("string")

    @F.pandas_udf("string")
    def digest(values):
        return values.map(lambda v: None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest()[:12])

    return digest


def path_is_sensitive(path: Column) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    hit = F.lit(False)
    for marker in SENSITIVE_PATHS:
        hit = hit | low.contains(marker)
    return hit


def redact(content: Column, secret: Column, marker: Column) -> Column:
    """All occurrences replaced; a missing or empty secret is an error."""
    absent = F.raise_error(F.lit("the text to redact is not there")).cast("string")
    return F.when((secret != "") & content.contains(secret), F.replace(content, secret, marker)).otherwise(absent)


def tombstone(hashed: Column, reason: Column, actor: Column, at: Column) -> Column:
    """The marker that stands where a secret was; hashed is the keyed hash of what is gone."""
    return F.concat(F.lit("<tombstone redacted at="), F.date_format(at, "yyyy-MM-dd"), F.lit(" reason='"), reason, F.lit("' hash="), hashed, F.lit(" actor="), actor, F.lit(">"))


def number_date_tokens(text: Column) -> Column:
    """Distinct dates (whole), then numbers without separators."""
    date = r"(?U)\b\d{4}-\d{2}-\d{2}\b"
    number = r"(?U)\b\d[\d,]*(?:\.\d+)?\b"
    dates = F.regexp_extract_all(text, F.lit(date), F.lit(0))
    rest = F.regexp_replace(text, date, " ")
    numbers = F.transform(F.regexp_extract_all(rest, F.lit(number), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit("")))
    return F.array_distinct(F.concat(dates, numbers))


def attributed_names(text: Column) -> Column:
    """Capitalised words before a verb of saying that may be names."""
    pattern = r"(?U)\b([A-Z][a-zA-Z]+)\s+(?:" + "|".join(ATTRIBUTION_VERBS) + r")\b"
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.filter(names, lambda n: ~n.isin(*NOT_NAMES))


def n_words(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def is_trivial(text: Column) -> Column:
    """Empty, or one or two tokens that are greetings or at most three characters long."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    small = F.forall(tokens, lambda t: F.regexp_replace(t, "^[.,!?]+|[.,!?]+$", "").isin(*GREETINGS) | (F.length(t) <= 3))
    return (F.size(tokens) == 0) | ((F.size(tokens) <= 2) & small)


def contains_word(text: Column, word: Column) -> Column:
    """Whole word, any case; word is literal."""
    return F.regexp_like(text, F.concat(F.lit(r"(?iuU)\b\Q"), word, F.lit(r"\E\b")))
