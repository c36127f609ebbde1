import pytest
from pyspark.sql import functions as F

from engramql.config import settings
from engramql.functions import scalars as S


def value(spark, column, **cols):
    types = {str: "string", int: "bigint", float: "double", list: "array<string>", bool: "boolean"}
    schema = ", ".join(f"{k} {types.get(type(v), 'string')}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(column.alias("v")).first().v


DAY = 86_400_000


def test_decay(spark):
    s = S.effective_strength(F.col("s"), F.col("t"), 10 * DAY)
    assert value(spark, s, s=0.5, t=10 * DAY) == pytest.approx(0.5)
    assert value(spark, s, s=0.5, t=0) == pytest.approx(0.5 * 2.718281828**-0.5)
    assert value(spark, s, s=0.5, t=20 * DAY) == pytest.approx(0.5)  # never above the stored value
    assert value(spark, S.recency(F.col("t"), 10 * DAY), t=20 * DAY) > 1


def test_strengthen_closed_form(spark):
    x = 0.2
    for _ in range(3):
        x = x + 0.1 * (1 - x)
    assert value(spark, S.strengthened_times(F.col("s"), 0.1, F.lit(3)), s=0.2) == pytest.approx(x)


@pytest.mark.parametrize(
    "magnitude, resistance, action",
    [(0.1, 1.0, "hold"), (0.79, 1.0, "hold"), (0.8, 1.0, "reconcile"), (1.99, 1.0, "reconcile"), (2.0, 1.0, "append-new"), (0.9, 0.29, "reconcile"), (0.9, 0.3, "append-new"), (0.5, 0.0, "reconcile")],
)
def test_routing_bands(spark, magnitude, resistance, action):
    assert value(spark, S.route_contradiction(F.col("m"), F.col("r")), m=magnitude, r=resistance) == action


@pytest.mark.parametrize(
    "text, want",
    [
        ("key sk-ant-abc-" + "x" * 20, "key [REDACTED:API_KEY]"),
        ("sk-" + "a1" * 12, "[REDACTED:API_KEY]"),
        ("ghp_" + "A" * 24, "[REDACTED:API_KEY]"),
        ("AKIA" + "B" * 16, "[REDACTED:AWS_KEY]"),
        ("Bearer eyJab.cd.ef", "Bearer [REDACTED:JWT]"),
        ("bearer abcdefghijk", "[REDACTED:BEARER_TOKEN]"),
        ("Password = hunter2 ok", "[REDACTED:SECRET] ok"),
        ("token: [REDACTED:JWT]", "token: [REDACTED:JWT]"),
        ("4111111111111111", "[REDACTED:CC]"),
        ("123-45-6789", "[REDACTED:SSN]"),
        ("call 555-123-4567", "call 555-123-4567"),
    ],
)
def test_redaction(spark, text, want):
    once = S.redact_secrets(F.col("t"))
    assert value(spark, once, t=text) == want
    assert value(spark, S.redact_secrets(once), t=text) == want


@pytest.mark.parametrize("cwd, scope", [("/Users/u/Alpha/", "alpha"), ("/home/u/beta/src", "beta"), ("/home/u", "global"), ("", "global"), (None, "global"), ("/opt/x/y", "global"), ("/Users/u/resume", "global")])
def test_scopes(spark, cwd, scope):
    assert value(spark, S.cwd_scope(F.col("c")), c=cwd) == scope


@pytest.mark.parametrize("text", ["a" * 20, "é" * 20, "€" * 20, "😀" * 20, "ab€", "x" * 9 + "€z", "x" * 8 + "😀z", ""])
def test_cap_bytes(spark, text):
    got = value(spark, S.cap_content(F.col("t"), 10), t=text)
    raw = text.encode()
    if len(raw) <= 10:
        assert got == text
    else:
        cut = raw[:10].decode("utf-8", "ignore")
        assert got == cut + ("�" if len(cut.encode()) < 10 else "") + "…[truncated]"


def test_salience_and_keep(spark):
    text = "always " + "w " * 99
    assert value(spark, S.salience(F.col("t"), F.lit("user"), F.lit("claude-code")), t=text) == pytest.approx(0.3 * 0.8 + 0.2 + 0.35)
    assert value(spark, S.salience(F.col("t"), F.lit("tool"), F.lit("gmail")), t="x") == pytest.approx((0.06 + 0.002) * 0.35)
    assert value(spark, S.hard_keep(F.col("t"), F.lit("user"), F.lit("obsidian")), t="Actually no") is True
    assert value(spark, S.hard_keep(F.col("t"), F.lit("user"), F.lit("gmail")), t="never do that") is False


def test_text_flags(spark):
    assert value(spark, S.normalize_value(F.col("t")), t=" A  b C ") == "a b c"
    assert value(spark, S.valid_schema_name(F.col("t")), t="Build tools and caches") is True
    assert value(spark, S.valid_schema_name(F.col("t")), t="I cannot name it") is False
    assert value(spark, S.subject_name(F.col("t")), t="  Retry budget (v2)!") == "retry-budget-v2"
    assert value(spark, S.is_interrogative(F.col("t")), t="What is it") is True
    assert value(spark, S.slug_class(F.col("t")), t="00000000-0000-0000-0000-000000000000") == "chapter"
    assert value(spark, S.calendar_reference(F.col("t"), F.lit("gcal"), "RRULE"), t="x · Event: e1 · RRULE: FREQ=DAILY · y") == "FREQ=DAILY "
    assert value(spark, S.calendar_reference(F.col("t"), F.lit("mail"), "Event"), t="x · Event: e1") is None
    assert value(spark, S.doc_title(F.col("t"), F.lit("slug")), t="intro\n# The title \n") == "The title"
    assert value(spark, S.utc_iso(F.col("m")), m=0) == "1970-01-01T00:00:00.000Z"
    assert value(spark, S.date_prefixed(F.lit("v"), F.col("m")), m=86_400_000) == "[1970-01-02] v"
    assert value(spark, S.action_type(F.col("t")), t="flights") == "other"
    assert value(spark, S.node_scope(F.col("t")), t=["global", "a", "a"]) == "a"
    assert value(spark, S.node_scope(F.col("t")), t=["b", "a"]) == "global"
    assert value(spark, S.root_scope(F.col("t")), t="alpha:sub") == "alpha"


def test_hours_and_expiry(spark):
    assert [value(spark, S.in_quiet_hours(F.col("h"), 22, 7), h=h) for h in (21, 22, 3, 7)] == [False, True, True, False]
    assert value(spark, S.in_quiet_hours(F.col("h"), 5, 5), h=5) is False
    assert value(spark, S.is_expired(10, F.col("d"), F.col("c"), 100), d=9, c=0) is True


def test_settings_precedence():
    cfg = settings("lite", {"ranked_k": 7}, {"ENGRAMQL_RECALL_BUDGET": "3", "ENGRAMQL_DECAY_PER_DAY": "0.5"})
    assert (cfg.ranked_k, cfg.recall_budget, cfg.decay_per_day) == (7, 3, 0.5)
