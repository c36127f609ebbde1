"""Episodes: normalising connector records, scoring, and the idempotent append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramql.config import DEFAULT, Settings
from engramql.functions import scalars as S
from engramql.operators.versions import first_rows

EPISODE = (
    "id string, ts bigint, content string, origin string, salience double, hard_keep boolean, consolidated boolean, "
    "source_inference_id string, role string, session_id string, source string, external_id string, cwd string"
)


def prepare(raw: DataFrame, now_ms: int | Column, cfg: Settings = DEFAULT) -> DataFrame:
    """Redact, score and cap incoming records; a stateless plan that also runs on a stream.

    Columns that are missing take their defaults: origin observed, role user,
    source claude-code, an id from source, external id and content.
    """
    have = set(raw.columns)
    col = lambda c, other: F.coalesce(F.col(c), other) if c in have else other
    null = F.lit(None).cast("string")
    text = S.redact_secrets(col("content", F.lit("")))
    role, source = col("role", F.lit("user")), col("source", F.lit("claude-code"))
    ts = col("ts", F.lit(now_ms) if isinstance(now_ms, int) else now_ms)
    external = col("external_id", null)
    rows = raw.select(
        col("id", F.sha2(F.concat_ws("|", source, F.coalesce(external, F.lit("")), ts.cast("string"), text), 256)).alias("id"), ts.cast("bigint").alias("ts"), text.alias("full"),
        col("origin", F.lit("observed")).alias("origin"), col("source_inference_id", null).alias("source_inference_id"),
        role.alias("role"), col("session_id", null).alias("session_id"), source.alias("source"), external.alias("external_id"), col("cwd", F.lit("")).alias("cwd"),
    )
    inferred = F.col("origin") == "inferred"
    return rows.select(
        "id", "ts", S.cap_content(F.col("full"), cfg.max_content_bytes).alias("content"), "origin",
        F.when(inferred, 0.0).otherwise(S.salience(F.col("full"), F.col("role"), F.col("source"), cfg)).alias("salience"),
        (~inferred & S.hard_keep(F.col("full"), F.col("role"), F.col("source"))).alias("hard_keep"), F.lit(False).alias("consolidated"),
        "source_inference_id", "role", "session_id", "source", "external_id", "cwd",
    )


def new_rows(prepared: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Rows that an append adds: of one (source, external id) the first, and none that is stored.

    Rows without an external id are always new, unless their own id is stored.
    """
    keyed = first_rows(prepared.where("external_id IS NOT NULL"), ["source", "external_id"], "ts", ["id"])
    fresh = keyed.unionByName(prepared.where("external_id IS NULL").dropDuplicates(["id"]))
    if stored is None:
        return fresh
    have = stored.where("external_id IS NOT NULL").select("source", "external_id")
    return fresh.join(have, ["source", "external_id"], "left_anti").join(stored.select("id"), "id", "left_anti")


def mail_records(mails: DataFrame) -> DataFrame:
    """Mails (message_id, sender, subject, sent_ms, body) as records: header lines, then the body without quotes."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("body", F.lit("")), r"(?m)^>.*$\n?", ""), r"(?s)\n-- \n.*$", ""))
    text = F.concat(F.lit("From: "), F.coalesce("sender", F.lit("")), F.lit("\nSubject: "), F.coalesce("subject", F.lit("")), F.lit("\n\n"), body)
    return mails.select(F.col("message_id").alias("external_id"), F.lit("gmail").alias("source"), F.col("sent_ms").alias("ts"), text.alias("content"), F.lit("observed").alias("origin"), F.col("message_id").alias("session_id"))


def calendar_records(events: DataFrame, starts: DataFrame) -> DataFrame:
    """Calendar events with a known start (raw_id, start_ms) as records that carry event id and rule."""
    rule = F.when(F.size("recurrence") > 0, F.concat(F.lit(" · "), F.regexp_replace(F.element_at("recurrence", 1), "^RRULE:", "RRULE: "))).otherwise("")
    text = F.concat(F.coalesce("summary", F.lit("")), F.lit(" · "), S.utc_iso(F.col("start_ms")), F.lit(" · Event: "), F.col("id"), rule, F.lit("\n"), F.coalesce("description_text", F.lit("")))
    return events.join(starts, "raw_id").select(
        F.concat_ws("/", "account_id", "id").alias("external_id"), F.lit("gcal").alias("source"), F.col("start_ms").alias("ts"), text.alias("content"), F.lit("observed").alias("origin"), F.col("id").alias("session_id")
    )


def after_cursor(records: DataFrame, column: str, cursor: int | None) -> tuple[DataFrame, Column]:
    """(records beyond the cursor, the next cursor as an aggregate): an incremental pull of a mailbox.

    The caller stores the next cursor after the append, so a lost run repeats
    and the idempotent append drops what came through.
    """
    fresh = records if cursor is None else records.where(F.col(column) > cursor)
    return fresh, F.coalesce(F.max(column), F.lit(cursor))


def pulled_events(stored: DataFrame, pulled: DataFrame, full: bool) -> DataFrame:
    """(account_id, id, status, change) of a calendar pull against what is stored; both have account_id, id, status.

    An incremental pull changes what it names.  Once the token has expired the
    pull is whole: stored events of the pulled accounts that it lacks are gone
    ('cancelled').  change: 'new', 'changed' or 'cancelled'; what is equal is
    left out.
    """
    p = pulled.groupBy("account_id", "id").agg(F.max("status").alias("status")).where("id IS NOT NULL")
    s = stored.groupBy("account_id", "id").agg(F.max("status").alias("was"), F.lit(True).alias("had")).where("id IS NOT NULL")
    j = p.join(s, ["account_id", "id"], "left")
    dead = F.col("status") == "cancelled"
    change = F.when(F.col("had").isNull() & ~F.coalesce(dead, F.lit(False)), "new").when(dead & F.col("had") & ~F.coalesce(F.col("was") == "cancelled", F.lit(False)), "cancelled").when(F.col("had") & ~F.col("status").eqNullSafe(F.col("was")) & ~F.coalesce(dead, F.lit(False)), "changed")
    out = j.select("account_id", "id", "status", change.alias("change")).where("change IS NOT NULL")
    if not full:
        return out
    gone = s.where("NOT coalesce(was = 'cancelled', false)").join(p.select("account_id").distinct(), "account_id", "left_semi").join(p.select("account_id", "id"), ["account_id", "id"], "left_anti")
    return out.unionByName(gone.select("account_id", "id", F.lit("cancelled").alias("status"), F.lit("cancelled").alias("change")))
