"""Mixed timestamp formats and zones, normalised to one instant each.

The raw strings are reduced to a dictionary of distinct (kind, text, zone)
entries, each parsed exhaustively once by ``parse_entry``; the instants are
joined back to the rows.  With ``dictionary_path`` the dictionary persists:
entries already there are not parsed again and new ones are appended.  Entries
are kept apart by the version of what they were parsed with (alias table, zone
database), so a changed alias leaves no stale instants.

Defined results: null or blank start text falls back to the date; unreadable
texts, impossible dates, unknown zones and local times without any zone give
no instant.  Digits finer than a millisecond are cut off.  A local time that
occurs twice is the earlier instant; a skipped one moves on by the gap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramql.functions.text import blank, stripped

#: A zone alias table above this is no small lookup table; the operator refuses it.
MAX_ALIASES = 10_000
DICTIONARY = "kind string, text string, zone string, start_ms bigint"
#: Raised with every change of what ``parse_entry`` reads.
FORMATS = 1

MONTHS = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}
FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")

_DATES = (
    (re.compile(r"(?P<y>[0-9]{4})-(?P<m>[0-9]{1,2})-(?P<d>[0-9]{1,2})"), False),
    (re.compile(r"(?P<y>[0-9]{4})/(?P<m>[0-9]{1,2})/(?P<d>[0-9]{1,2})"), False),
    (re.compile(r"(?P<m>[0-9]{1,2})/(?P<d>[0-9]{1,2})/(?P<y>[0-9]{4})"), False),
    (re.compile(r"(?P<d>[0-9]{1,2})\.(?P<m>[0-9]{1,2})\.(?P<y>[0-9]{4})"), False),
    (re.compile(r"(?P<y>[0-9]{4})\.(?P<m>[0-9]{1,2})\.(?P<d>[0-9]{1,2})"), False),
    (re.compile(r"(?P<y>[0-9]{4})(?P<m>[0-9]{2})(?P<d>[0-9]{2})(?![0-9])"), False),
    (re.compile(r"(?:(?P<w>[A-Za-z]{3,9})\.?,?\s+)?(?P<d>[0-9]{1,2})(?:st|nd|rd|th)?[\s-]+(?P<n>[A-Za-z]{3,9})\.?,?[\s-]+(?P<y>[0-9]{4})"), True),
    (re.compile(r"(?:(?P<w>[A-Za-z]{3,9})\.?,?\s+)?(?P<n>[A-Za-z]{3,9})\.?\s+(?P<d>[0-9]{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>[0-9]{4})"), True),
)
_TIME = re.compile(
    r"(?:(?P<h>[0-9]{1,2}):(?P<mi>[0-9]{2})(?::(?P<s>[0-9]{2})(?:[.,](?P<f>[0-9]+))?)?|(?P<ch>[0-9]{2})(?P<cm>[0-9]{2})(?:(?P<cs>[0-9]{2})(?:[.,](?P<cf>[0-9]+))?)?)"
    r"(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
)
_OFFSET = re.compile(r"(?:(?:UTC|GMT|Z)\s*)?([+-])([0-9]{1,2})(?::?([0-9]{2}))?(?::?([0-9]{2}))?", re.IGNORECASE)
_UTC = {"z", "utc", "gmt", "ut", "zulu"}


def parse_offset(text: str) -> timezone | None:
    """'+05:30', '-0800', '+11', 'UTC+02:00', 'GMT-3' as a fixed zone."""
    m = _OFFSET.fullmatch(text)
    if not m:
        return None
    h, mi, s = int(m[2]), int(m[3] or 0), int(m[4] or 0)
    if h > 18 or mi > 59 or s > 59:
        return None
    delta = timedelta(hours=h, minutes=mi, seconds=s)
    return timezone(-delta if m[1] == "-" else delta)


@lru_cache(maxsize=1)
def _iana() -> dict[str, str]:
    return {name.lower(): name for name in sorted(available_timezones()) if name.lower() not in ("localtime", "factory")}


def resolver(aliases: dict[str, str]):
    """A cached function from a zone text to a tzinfo, or None if unknown.

    ``aliases`` has lower-cased names; the table decides before the IANA names.
    """

    @lru_cache(maxsize=4096)
    def zone(text: str):
        name = text.strip().lower()
        for _ in range(2):
            if name in _UTC:
                return timezone.utc
            if (fixed := parse_offset(name)) is not None:
                return fixed
            if name not in aliases:
                break
            name = aliases[name].strip().lower()
        return ZoneInfo(_iana()[name]) if name in _iana() else None

    return zone


def _date(text: str) -> tuple[int, int, int, str] | None:
    for pattern, named in _DATES:
        m = pattern.match(text)
        if not m:
            continue
        if named:
            word = m["n"].lower()
            if word not in FULL_MONTHS and word not in MONTHS and word != "sept":
                continue
            if m["w"] and m["w"].lower()[:3] not in DAYS:
                continue
            month = MONTHS[word[:3]]
        else:
            month = int(m["m"])
        return int(m["y"]), month, int(m["d"]), text[m.end() :]
    return None


def _epoch_ms(local: datetime, zone, fraction: str) -> int:
    whole = local.replace(tzinfo=zone, fold=0) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (whole.days * 86400 + whole.seconds) * 1000 + int((fraction + "000")[:3])


def parse_entry(kind: str, text: str, zone_text: str, zone_of) -> int | None:
    """Epoch ms of one entry; ``kind`` is 'date' (midnight UTC) or 'datetime'."""
    text = text.strip()
    if kind == "datetime" and re.fullmatch(r"[0-9]{1,18}", text):
        return int(text) if int(text) >= 10**11 else int(text) * 1000
    found = _date(text)
    if not found:
        return None
    y, m, d, rest = found
    try:
        if kind == "date":
            return _epoch_ms(datetime(y, m, d), timezone.utc, "") if not rest.strip() else None
        h = mi = s = 0
        fraction = ""
        body = rest.lstrip(" \t,")
        if body[:1] in "Tt" and body[1:2].isdigit():
            body = body[1:]
        if t := _TIME.match(body):
            h, mi, s = (int(t[a] or t[b] or 0) for a, b in (("h", "ch"), ("mi", "cm"), ("s", "cs")))
            fraction = t["f"] or t["cf"] or ""
            if t["ap"]:
                if not 1 <= h <= 12:
                    return None
                h = h % 12 + 12 * (t["ap"] in "Pp")
            body = body[t.end() :]
        local = datetime(y, m, d, h, mi, s)
        mark = body.strip().strip("()[]").strip()
        if not mark and not zone_text.strip():
            return None
        zone = zone_of(mark if mark else zone_text)
        return None if zone is None else _epoch_ms(local, zone, fraction)
    except (ValueError, OverflowError):
        return None


def zone_aliases(zone_alias: DataFrame) -> dict[str, str]:
    """The alias table on the driver; refused beyond ``MAX_ALIASES`` rows."""
    rows = zone_alias.select("alias", "zone_name").where("alias IS NOT NULL AND zone_name IS NOT NULL").limit(MAX_ALIASES + 1).collect()
    if len(rows) > MAX_ALIASES:
        raise ValueError(f"zone_alias has more than {MAX_ALIASES} rows")
    return {r.alias.strip().lower(): r.zone_name for r in sorted(rows)}


def parse_dictionary(entries: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Parse distinct (kind, text, zone) entries in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zone_of = resolver(aliases)
        for b in batches:
            ms = [parse_entry(k, t, z, zone_of) for k, t, z in zip(b["kind"], b["text"], b["zone"])]
            yield b.assign(start_ms=pd.array(ms, dtype="Int64"))

    return entries.mapInPandas(run, DICTIONARY)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def dictionary_version(aliases: dict[str, str]) -> str:
    """A digest of all that an entry's instant depends on beside its own texts."""
    try:
        from importlib.metadata import version

        zones = version("tzdata")
    except Exception:  # noqa: BLE001 - the zones of the operating system
        zones = str(len(_iana()))
    return hashlib.sha256(repr((FORMATS, zones, sorted(aliases.items()))).encode()).hexdigest()[:16]


def normalise_starts(events: DataFrame, accounts: DataFrame, zone_alias: DataFrame, dictionary_path: str | None = None) -> DataFrame:
    """(raw_id, start_ms) of each record whose start is known.

    Accounts join on their id (Spark broadcasts them only below its own size
    threshold).  The dictionary has one row for each distinct entry, so a text
    held by a third of all rows is parsed once, and adaptive execution splits
    its rows in the join back.
    """
    spark = events.sparkSession
    zone = F.when(blank(F.col("start_timezone")), F.col("default_zone")).otherwise(F.col("start_timezone"))
    keyed = (
        events.select("raw_id", "account_id", "start_datetime", "start_date", "start_timezone")
        .where(~blank(F.col("start_datetime")) | ~blank(F.col("start_date")))
        .join(accounts.groupBy("account_id").agg(F.max("default_zone").alias("default_zone")), "account_id", "left")
        .select(
            "raw_id",
            F.when(blank(F.col("start_datetime")), "date").otherwise("datetime").alias("kind"),
            stripped(F.when(blank(F.col("start_datetime")), F.col("start_date")).otherwise(F.col("start_datetime"))).alias("text"),
            F.when(blank(F.col("start_datetime")), "").otherwise(F.coalesce(stripped(zone), F.lit(""))).alias("zone"),
        )
    )
    entries = keyed.select("kind", "text", "zone").distinct()
    aliases = zone_aliases(zone_alias)
    if dictionary_path is None:
        known = parse_dictionary(entries, aliases)
    else:
        path = f"{dictionary_path.rstrip('/')}/version={dictionary_version(aliases)}"
        if _exists(spark, path):
            entries = entries.join(spark.read.schema(DICTIONARY).parquet(path), ["kind", "text", "zone"], "left_anti")
        parse_dictionary(entries, aliases).write.mode("append").parquet(path)
        known = spark.read.schema(DICTIONARY).parquet(path)
    return keyed.join(known.where("start_ms IS NOT NULL"), ["kind", "text", "zone"]).select("raw_id", "start_ms").distinct()
