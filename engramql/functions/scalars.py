"""Scalar functions of the memory model, as Column expressions.

All are plain built-in expressions: they stay inside whole-stage code and are
pushed down where the source allows.  Instants are epoch milliseconds and the
present is a parameter, so a run can be repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramql.config import CORRECTIONS, DAY_MS, DEFAULT, DIRECTIVES, Settings

# Results depend on them.
HARD_KEEP_SOURCES = ("claude-code", "obsidian")
PERSONAL_SLUGS = ("resume",)
ACTION_TYPES = ("deadline", "flight", "appointment", "receipt", "payment", "meeting", "other")

# Secret patterns in the order in which they apply.
SECRETS = (
    (r"sk-ant-[A-Za-z0-9-]{20,}", "[REDACTED:API_KEY]"),
    (r"sk-[A-Za-z0-9]{20,}", "[REDACTED:API_KEY]"),
    (r"gh[poasr]_[A-Za-z0-9]{20,}", "[REDACTED:API_KEY]"),
    (r"AKIA[0-9A-Z]{16}", "[REDACTED:AWS_KEY]"),
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[REDACTED:JWT]"),
    (r"(?i)Bearer\s+[A-Za-z0-9._-]{10,}", "[REDACTED:BEARER_TOKEN]"),
    (r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[:=]\s*(?!\[REDACTED:)\S+", "[REDACTED:SECRET]"),
    (r"\b\d{13,16}\b", "[REDACTED:CC]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED:SSN]"),
)
# Members that are noise, and values an engine wrote about itself.
NOISE = (r"^/private/", r"^/tmp/", r"^/Users/", r"^toolu_[A-Za-z0-9]+$", r"^[Cc]ommit\s+[`]?[0-9a-f]{6,}", r"^worktreePath:", r"^\.claude/worktrees")
POLLUTION = (r"SUBCHECK_OK", r"\btask\s+\S+\s+(?:completed|executed)\s+(?:successfully|with\s+(?:status|exit\s+code))", r"\bexit\s+code\s+0\b", r"\bcompleted\s+with\s+status\b")
# Phrases that no schema name has.
REFUSALS = (
    "i don't", "i do not", "i cannot", "i can't", "i'm not", "i am not", "i'm unable", "i am unable", "i'm sorry", "i apologize", "could you",
    "please share", "please provide", "as an ai", "i don't have access", "does not contain", "no shared", "unable to",
)
# Words that open a question.
QUESTION_WORDS = (
    "what", "when", "where", "who", "whom", "whose", "which", "why", "how", "do", "does", "did", "is", "are", "was", "were",
    "can", "could", "should", "would", "will",
)


def any_match(c: Column, patterns: tuple[str, ...], ignore_case: bool = False) -> Column:
    """One alternation, so each value is read once."""
    return c.rlike(("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns))


def effective_strength(s: Column, last_access: Column, now_ms: Column | int, rate: float = DEFAULT.decay_per_day) -> Column:
    """Strength after exponential decay; time never runs backwards."""
    return s * F.exp(F.lit(-rate) * F.greatest(F.lit(0), now_ms - last_access) / F.lit(float(DAY_MS)))


def recency(last_access: Column, now_ms: Column | int, rate: float = DEFAULT.decay_per_day) -> Column:
    """Decay alone, above 1 for instants after ``now_ms``."""
    return F.exp(F.lit(-rate) * (now_ms - last_access) / F.lit(float(DAY_MS)))


def strengthened(x: Column, gain: float) -> Column:
    return x + F.lit(gain) * (1 - x)


def strengthened_times(x: Column, gain: float, k: Column) -> Column:
    """k confirmations at one instant, in closed form."""
    return 1 - (1 - x) * F.pow(F.lit(1 - gain), k)


def normalize_value(c: Column) -> Column:
    """Lower case, trimmed, inner white space of any script as one space."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def salience(content: Column, role: Column, source: Column, cfg: Settings = DEFAULT) -> Column:
    def weight(c: Column, table: dict, other: float) -> Column:
        return reduce(lambda out, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(out), table.items(), F.lit(other))

    body = F.coalesce(content, F.lit(""))
    parts = (
        F.lit(cfg.w_role) * weight(role, cfg.role_weights, 0.0)
        + F.lit(cfg.w_length) * F.least(word_count(body) / F.lit(float(cfg.length_words)), F.lit(1.0))
        + F.lit(cfg.w_directive) * F.when(any_match(body, DIRECTIVES, True), 1.0).otherwise(0.0)
        + F.lit(cfg.w_correction) * F.when(any_match(body, CORRECTIONS, True), 1.0).otherwise(0.0)
    )
    return F.least(parts, F.lit(1.0)) * weight(source, cfg.source_weights, cfg.source_weights["claude-code"])


def hard_keep(content: Column, role: Column, source: Column) -> Column:
    asks = any_match(F.coalesce(content, F.lit("")), DIRECTIVES + CORRECTIONS, True)
    return F.coalesce(source.isin(*HARD_KEEP_SOURCES) & (role == "user") & asks, F.lit(False))


def redact_secrets(c: Column) -> Column:
    return reduce(lambda out, p: F.regexp_replace(out, p[0], p[1].replace("$", r"\$")), SECRETS, c)


def cwd_scope(cwd: Column) -> Column:
    """Project slug of a working directory, or 'global'."""
    path = F.regexp_replace(F.trim(F.coalesce(cwd, F.lit(""))), "/+$", "")
    slug = F.lower(F.regexp_extract(path, r"^/(?:Users|home)/[^/]+(?:/([^/]+))?", 1))
    return F.when((slug == "") | slug.isin(*PERSONAL_SLUGS), "global").otherwise(slug)


def node_scope(scopes: Column) -> Column:
    """The only project among collected scopes, else 'global'."""
    own = F.array_distinct(F.filter(scopes, lambda x: x != "global"))
    return F.when(F.size(own) == 1, own[0]).otherwise("global")


def root_scope(scope: Column) -> Column:
    root = F.substring_index(F.coalesce(scope, F.lit("")), ":", 1)
    return F.when(root == "", "global").otherwise(root)


def cap_content(c: Column, most: int = DEFAULT.max_content_bytes, mark: str = "…[truncated]") -> Column:
    """At most ``most`` UTF-8 bytes and a mark; a cut character becomes U+FFFD.

    Bytes of a character that was cut in two decode to replacement characters,
    of which one is kept.
    """
    raw = F.encode(c, "UTF-8")
    # bytes of the last, possibly cut, character: count continuation bytes at the end
    tail_hex = F.hex(F.substring(raw, most - 3, 4))
    lead3, lead2, lead1 = (F.substring(tail_hex, i, 1) for i in (3, 5, 7))
    high = lambda h, ds: h.isin(*ds)
    cut = (
        F.when(high(lead1, "CDEF"), 1)
        .when(high(lead2, "EF") & high(lead1, "89AB"), 2)
        .when(high(lead3, "F") & high(lead2, "89AB") & high(lead1, "89AB"), 3)
        .otherwise(0)
    )
    whole = F.decode(F.substring(raw, F.lit(1), F.lit(most) - cut), "UTF-8")
    text = F.concat(whole, F.when(cut > 0, "�").otherwise(""), F.lit(mark))
    return F.when(F.octet_length(c) > most, text).otherwise(c)


def fts_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def proximity(due_ms: Column, now_ms: Column | int, days: int = 7) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (due_ms - now_ms) / F.lit(float(days * DAY_MS))))


def surface_score(due_ms: Column, s: Column, now_ms: Column | int) -> Column:
    return 0.5 * proximity(due_ms, now_ms) + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def surface_tier(due_ms: Column, now_ms: Column | int) -> Column:
    return F.when(due_ms - now_ms < DAY_MS, 0).otherwise(1)


def route_contradiction(magnitude: Column, resistance: Column, cfg: Settings = DEFAULT) -> Column:
    ratio = magnitude / F.greatest(resistance, F.lit(1e-9))
    return F.when(ratio < cfg.band_low, "hold").when((ratio < cfg.band_high) | (resistance < cfg.append_resistance), "reconcile").otherwise("append-new")


def is_oscillation(new: Column, prev: Column) -> Column:
    return F.coalesce(normalize_value(new) == normalize_value(prev), F.lit(False))


def valid_schema_name(c: Column) -> Column:
    low = F.lower(c)
    refused = reduce(lambda a, p: a | low.contains(p), REFUSALS[1:], low.contains(REFUSALS[0]))
    return F.coalesce((c != "") & ~c.contains("?") & (word_count(c) <= 8) & ~refused, F.lit(False))


def subject_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def is_noise(c: Column) -> Column:
    return any_match(c, NOISE)


def is_pollution(c: Column) -> Column:
    return any_match(c, POLLUTION, True)


def is_interrogative(c: Column) -> Column:
    q = F.trim(c)
    return q.endswith("?") | F.lower(F.regexp_extract(q, r"^(\S*)", 1)).isin(*QUESTION_WORDS)


def calendar_reference(content: Column, source: Column, name: str) -> Column:
    """Event id (name 'Event') or rule (name 'RRULE') that a calendar text carries."""
    stop = r"(\S+)" if name == "Event" else r"([^\n·]+)"
    found = F.regexp_extract(content, rf"·\s*{name}:\s*{stop}", 1)
    return F.when((source == "gcal") & (found != ""), found)


UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def slug_class(slug: Column) -> Column:
    return F.when(slug.rlike("(?i)" + UUID), "chapter").when(slug.contains(":"), "subject").otherwise("hub")


def doc_title(text: Column, slug: Column) -> Column:
    h1 = F.regexp_extract(text, r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)
    return F.when(F.coalesce(h1, F.lit("")) == "", slug).otherwise(h1)


def clean_id(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(c), "[^a-f0-9-]", ""), 1, 64)


def clean_slug(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9:-]", ""), 1, 64)


def utc_iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def date_prefixed(value: Column, ms: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"), F.lit("] "), value)


def in_quiet_hours(hour: Column, start: int, end: int) -> Column:
    if start == end:
        return F.lit(False)
    return (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)


def is_expired(now_ms: Column | int, due_ms: Column, created_ms: Column, ttl_ms: int) -> Column:
    return F.coalesce(due_ms < now_ms, F.lit(False)) | (created_ms + ttl_ms < now_ms)


def token_proxy(c: Column) -> Column:
    return F.round(F.length(c) / 4).cast("bigint")


def action_type(c: Column) -> Column:
    return F.when(c.isin(*ACTION_TYPES), c).otherwise("other")


def content_external_id(path: Column, content: Column) -> Column:
    return F.concat(path, F.lit("#"), F.substring(F.sha2(content, 256), 1, 16))


def skip_threshold(source: Column, role: Column, cfg: Settings = DEFAULT) -> Column:
    by_role = F.when(role == "assistant", F.lit(cfg.skip_assistant)).otherwise(F.lit(cfg.skip_default))
    return reduce(lambda out, kv: F.when(source == kv[0], F.lit(kv[1])).otherwise(out), cfg.skip_thresholds.items(), by_role)
