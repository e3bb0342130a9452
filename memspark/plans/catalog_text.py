"""Queries over texts: secrets, entropy, claims, transcripts of varying shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import Views
from ..functions import text as tx
from ..functions.replies import safe_json as longest_json
from ..operators import gate, transcript
from ..sources.files import parse_lines
from ..values import ATTRIBUTION_VERBS, ENTROPY_TOKEN, NOT_NAMES, SENSITIVE_PATHS
from .registry import query

# Documents with made-up secrets and paths put in front, the same in both engines.
_KINDS = 8
_PREFIX_SQL = """CASE doc_id % 8 WHEN 0 THEN 'see /home/user' || CAST(doc_id AS VARCHAR) || '/x and /Users/me' WHEN 1 THEN 'key AKIA' || upper(substr(md5(CAST(doc_id AS VARCHAR)), 1, 16)) || ' end'
 WHEN 2 THEN 'export API_KEY=' || md5(CAST(doc_id AS VARCHAR)) || ' # x' WHEN 3 THEN 'Authorization: Bearer ' || md5(CAST(doc_id AS VARCHAR)) || ' ok'
 WHEN 4 THEN 'tok QmFzZTY0U3RyaW5nVGhhdElzTG9uZ0Vub3VnaA' || CAST(doc_id AS VARCHAR) || ' end' WHEN 5 THEN 'DB_PASS="p ' || CAST(doc_id AS VARCHAR) || '"'
 WHEN 6 THEN 'commit ' || md5(CAST(doc_id AS VARCHAR)) || ' of 2024-05-01' ELSE 'ghp_' || md5(CAST(doc_id AS VARCHAR)) || 'abcdef' END"""


def _seeded(v: Views):
    k = F.col("doc_id")
    s = k.cast("string")
    cases = [
        F.concat(F.lit("see /home/user"), s, F.lit("/x and /Users/me")), F.concat(F.lit("key AKIA"), F.upper(F.substring(F.md5(s), 1, 16)), F.lit(" end")),
        F.concat(F.lit("export API_KEY="), F.md5(s), F.lit(" # x")), F.concat(F.lit("Authorization: Bearer "), F.md5(s), F.lit(" ok")),
        F.concat(F.lit("tok QmFzZTY0U3RyaW5nVGhhdElzTG9uZ0Vub3VnaA"), s, F.lit(" end")), F.concat(F.lit('DB_PASS="p '), s, F.lit('"')),
        F.concat(F.lit("commit "), F.md5(s), F.lit(" of 2024-05-01")), F.concat(F.lit("ghp_"), F.md5(s), F.lit("abcdef")),
    ]
    prefix = F.lit(None).cast("string")
    for i, c in enumerate(cases):
        prefix = F.when(k % _KINDS == i, c).otherwise(prefix)
    return v.docs.select("doc_id", F.concat(prefix, F.lit("\n"), F.col("text")).alias("text"))


_SEEDED = f"WITH d AS (SELECT doc_id, {_PREFIX_SQL} || chr(10) || text AS text FROM documents)"
# RE2 has no lookbehind; the boundary is captured instead.
_MASK = r"regexp_replace(text, '(^|[^\p{L}\p{N}_])/(?:Users|home)/[^/\s]+', '\1~', 'g')"


def _sub(inner: str, kind: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({inner}, '{pattern}', '{to}<redacted:secret kind={kind}>', 'g')"


_KEYS = _sub(_sub(_sub("{x}", "aws_access_key_id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"), "github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
             "auth_header", r"(?i)(Authorization\s*:\s*(?:Bearer|Basic|Token)\s+)([A-Za-z0-9._~+/=-]{8,})".replace("'", "''"), r"\1")
_NAME = "[A-Za-z0-9_]*(?:SECRET|TOKEN|PASSWORD|PASSWD|API_?KEY|ACCESS_?KEY|PRIVATE_?KEY|CLIENT_?SECRET|AUTH|CREDENTIAL|SESSION|DATABASE_URL|DB_PASS)[A-Za-z0-9_]*"
_HEAD = rf"(?im)^(\s*(?:export\s+)?{_NAME}\s*=\s*)"


def _patterns_sql(x: str) -> str:
    keys = _KEYS.replace("{x}", x)
    quoted = f"""regexp_replace({keys}, '{_HEAD}"[^"]*"', '\\1"<redacted:secret kind=env_assignment>"', 'g')"""
    return f"""regexp_replace({quoted}, '{_HEAD}[^"''<\\s#][^\\s#]*', '\\1<redacted:secret kind=env_assignment>', 'g')"""


@query(_SEEDED + f" SELECT doc_id, md5({_MASK}) AS text_md5 FROM d")
def mask_home_paths(v: Views):
    return _seeded(v).select("doc_id", F.md5(tx.mask_home_paths(F.col("text"))).alias("text_md5"))


@query(_SEEDED + f" SELECT doc_id, md5({_patterns_sql('text')}) AS text_md5 FROM d")
def scrub_patterns(v: Views):
    return _seeded(v).select("doc_id", F.md5(tx.scrub_patterns(F.col("text"))).alias("text_md5"))


_TOKEN = ENTROPY_TOKEN
_ENTROPY_OF = "-list_sum(list_transform(list_distinct(string_split(t, '')), lambda c: (length(t) - length(replace(t, c, ''))) / length(t) * log2((length(t) - length(replace(t, c, ''))) / length(t))))"


def _entropy_sql(x: str) -> str:
    """Column text of the rows in x with its random-looking tokens replaced."""
    token = rf"<redacted:secret kind=[a-z_]+(?: hash=[0-9a-f]+)?>|{_TOKEN}"
    keep = rf"starts_with(t, '<redacted:secret') OR regexp_full_match(t, '[0-9a-f]{{7,40}}|[0-9a-f]{{64}}|EP-\d{{4}}-\d{{2}}-\d{{2}}\.\d{{4,}}') OR {_ENTROPY_OF} < 4.0"
    judged = f"list_transform(regexp_extract_all(text, '{token}'), lambda t: CASE WHEN {keep} THEN t ELSE '<redacted:secret kind=high_entropy>' END)"
    return (f"(SELECT doc_id, array_to_string(list_transform(list_zip(pieces, judged), lambda z: z[1] || coalesce(z[2], '')), '') AS text"
            f" FROM (SELECT doc_id, string_split_regex(text, '{token}') AS pieces, {judged} AS judged FROM {x}))")


@query(_SEEDED + f" SELECT doc_id, t AS token, round({_ENTROPY_OF}, 6) AS entropy FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{_TOKEN}'))) AS t FROM d)")
def token_entropy(v: Views):
    tokens = _seeded(v).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)))).alias("token"))
    return tokens.select("doc_id", "token", F.round(tx.shannon_entropy(F.col("token")), 6).alias("entropy"))


@query(_SEEDED + f" SELECT doc_id, md5(text) AS text_md5 FROM {_entropy_sql('d')}")
def scrub_entropy(v: Views):
    return _seeded(v).select("doc_id", F.md5(tx.scrub_entropy(F.col("text"))).alias("text_md5"))


@query(_SEEDED + f", m AS (SELECT doc_id, {_patterns_sql(_MASK)} AS text FROM d) SELECT doc_id, md5(text) AS text_md5 FROM {_entropy_sql('m')}")
def scrub_documents(v: Views):
    return _seeded(v).select("doc_id", F.md5(tx.scrub(F.col("text"))).alias("text_md5"))


_TEST_KEY = b"test key"
_PADS = ["".join(f"\\x{b ^ x:02X}" for b in _TEST_KEY.ljust(64, b"\0")) for x in (0x36, 0x5C)]


@query(f"SELECT doc_id, left(sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(text)))), 12) AS fingerprint FROM documents")
def hmac_fingerprint(v: Views):
    return v.docs.select("doc_id", F.substring(tx.hmac_sha256(_TEST_KEY, F.col("text")), 1, 12).alias("fingerprint"))


@query("SELECT page_id, " + " OR ".join(f"contains(lower(url), '{m}')" for m in SENSITIVE_PATHS) + " OR page_id % 3 = 0 AS sensitive FROM pages")
def sensitive_paths(v: Views):
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.col("url"), F.lit("/Home/.SSH/id_rsa"))).otherwise(F.col("url"))
    return v.table("pages").select("page_id", tx.path_is_sensitive(path).alias("sensitive"))


@query("SELECT doc_id, md5(replace(text, left(text, 4), '[gone]')) AS text_md5 FROM documents WHERE length(text) >= 4")
def redact_in_place(v: Views):
    return v.docs.where(F.length("text") >= 4).select("doc_id", F.md5(tx.redact(F.col("text"), F.substring("text", 1, 4), F.lit("[gone]"))).alias("text_md5"))


_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
_NUMBER = r"\b\d[\d,]*(?:\.\d+)?\b"


def _tokens_sql(x: str) -> str:
    return (f"list_distinct(list_concat(regexp_extract_all({x}, '{_DATE}'),"
            f" list_transform(regexp_extract_all(regexp_replace({x}, '{_DATE}', ' ', 'g'), '{_NUMBER}'), lambda t: replace(t, ',', ''))))")


@query(f"SELECT doc_id, array_to_string(list_sort({_tokens_sql('text')}), '|') AS tokens FROM documents")
def number_date_tokens(v: Views):
    return v.docs.select("doc_id", F.array_join(F.array_sort(tx.number_date_tokens(F.col("text"))), "|").alias("tokens"))


# Every document is a claim that is held against the document before it; Anna is the only speaker.
_SAYS = rf"\b([A-Z][a-zA-Z]+)\s+(?:{'|'.join(ATTRIBUTION_VERBS)})\b"
_CLAIMS = "WITH c AS (SELECT a.doc_id AS edge_id, a.text || ' Anna said so, Bob wrote on 2024-05-0' || CAST(a.doc_id % 9 + 1 AS VARCHAR) AS fact, coalesce(b.text, '') || ' 2024-05-02' AS corpus FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id - 1)"


@query(_CLAIMS + f" SELECT edge_id, 'number_date_absent' AS kind, unnest(list_filter(f, lambda t: NOT list_contains(k, t))) AS token FROM (SELECT edge_id, {_tokens_sql('fact')} AS f, {_tokens_sql('corpus')} AS k FROM c)"
       f" UNION ALL SELECT edge_id, 'non_participant', unnest(list_filter(list_distinct(regexp_extract_all(fact, '{_SAYS}', 1)), lambda n: n NOT IN ('Anna', {', '.join(repr(n) for n in NOT_NAMES)}))) FROM c")
def tier0_flags(v: Views):
    before = v.docs.select((F.col("doc_id") + 1).alias("doc_id"), F.concat("text", F.lit(" 2024-05-02")).alias("corpus"))
    said = F.concat("text", F.lit(" Anna said so, Bob wrote on 2024-05-0"), (F.col("doc_id") % 9 + 1).cast("string"))
    facts = v.docs.select("doc_id", said.alias("fact")).join(before, "doc_id", "left").select(
        F.col("doc_id").alias("edge_id"), "fact", F.coalesce("corpus", F.lit(" 2024-05-02")).alias("corpus"), F.array(F.lit("Anna")).alias("speakers"))
    return gate.tier0_flags(facts)


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 20 AND doc_id % 2 = 0 AS tripped FROM documents")
def tier0_tripwire(v: Views):
    return v.docs.select("doc_id", gate.tripwire(F.col("text"), F.col("doc_id") % 2).alias("tripped"))


# ---- transcripts in JSON; each conversation is written as a session of records

def _lines(v: Views):
    """JSON lines of the test conversations, in several shapes, with broken lines between them."""
    t = F.col("text")
    block = F.struct(F.lit("text").alias("type"), t.alias("text"))
    plain = F.to_json(F.struct(F.col("role").alias("type"), F.struct(t.alias("content")).alias("message")))
    listed = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.array(block, block).alias("content")).alias("message")))
    line = F.when(F.col("turn") % 3 == 2, listed).otherwise(plain)
    rows = v.table("conversations").select(F.col("conv_id").alias("session_id"), (F.col("turn") * 2).alias("pos"), line.alias("line"))
    broken = v.table("conversations").select(F.col("conv_id").alias("session_id"), (F.col("turn") * 2 + 1).alias("pos"), F.when(F.col("turn") % 2 == 0, "[1, 2]").otherwise('{"type": ').alias("line"))
    return rows.unionByName(broken)


_TEXT = "CASE WHEN turn % 3 = 2 THEN text || chr(10) || text ELSE text END"


@query("SELECT conv_id AS session_id, turn * 2 AS pos, role AS type FROM conversations")
def scan_jsonl(v: Views):
    return parse_lines(_lines(v)).select("session_id", "pos", F.try_variant_get("v", "$.type", "string").alias("type"))


@query(f"SELECT conv_id AS session_id, turn * 2 AS pos, md5({_TEXT}) AS text_md5 FROM conversations")
def content_text(v: Views):
    content = F.try_variant_get("v", "$.message.content", "variant")
    return parse_lines(_lines(v)).select("session_id", "pos", F.md5(transcript.content_text(content)).alias("text_md5"))


@query(f"""WITH e AS (SELECT conv_id AS session_id, turn * 2 AS pos, 0 AS block, CASE role WHEN 'user' THEN 'user' ELSE 'assistant_text' END AS type,
 CASE WHEN role = 'user' THEN {_TEXT} ELSE text END AS text FROM conversations WHERE role IN ('user', 'assistant')
 UNION ALL SELECT conv_id, turn * 2, 1, 'assistant_text', text FROM conversations WHERE role = 'assistant' AND turn % 3 = 2)
SELECT session_id, pos, block, type, md5(text) AS text_md5 FROM e WHERE trim(text) <> ''""")
def transcript_events(v: Views):
    found = transcript.transcript_events(parse_lines(_lines(v)))
    return found.select("session_id", "pos", "block", "type", F.md5("text").alias("text_md5"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '{}' ELSE '{"verdict":"V' || CAST(event_id AS VARCHAR) || '"}' END AS reply FROM events""")
def safe_json(v: Views):
    k = F.col("event_id")
    good = F.concat(F.lit('{"verdict": "V'), k.cast("string"), F.lit('"}'))
    reply = F.when(k % 4 == 0, good).when(k % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), good, F.lit("\n```\nand [1]"))).when(
        k % 4 == 2, F.concat(F.lit("{broken {"), good, F.lit(" {}"))).otherwise("no object [1, 2, 3]")
    return v.table("events").select("event_id", longest_json(reply).alias("reply"))
