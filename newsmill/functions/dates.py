"""Date functions; the clock is always an argument."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW_HOURS = 168
DEFAULT_DAYS = 30
PRESET_DAYS = {"3d": 3, "1w": 7, "1m": 30}


# The zone names of mail dates, in minutes from UTC, and the months.
ZONES = {"AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MAIL = r"^\s*(?:[A-Za-z]+\.?,?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3,9})\.?[\s-]+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+(\S+).*)?$"


def parse(c: Column) -> Column:
    """RFC 2822 first (also with month names in full, years of two digits, zone names), else ISO 8601, else null; without a zone, or with
    one that is unknown, it is UTC."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    zones = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])

    def mail(p: Column) -> Column:  # day, month, year, hour, minute, second, zone
        number = lambda i: p[i].try_cast("int")
        named = F.lower(p[1])
        month = F.array_position(F.transform(names, lambda m: (m == named) | (F.substring(m, 1, 3) == named)), True).cast("int")
        year = number(2) + F.when(F.length(p[2]) > 2, 0).when(number(2) > 68, 1900).otherwise(2000)
        zone = F.upper(p[6])
        offset = (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)
        minutes = F.when(zone.rlike(r"^[+-]\d{4}$"), offset).otherwise(F.coalesce(F.try_element_at(zones, zone), F.lit(0)))
        second = F.coalesce(number(5), F.lit(0)).cast("decimal(16,6)")
        local = F.try_make_timestamp(year, month, number(0), number(3), number(4), second, F.lit("UTC"))
        return F.when((month > 0) & (second < 60), local - F.make_dt_interval(mins=minutes))

    parts = F.split(F.regexp_replace(c, _MAIL, "$1|$2|$3|$4|$5|$6|$7"), r"\|", -1)
    return F.coalesce(F.when(c.rlike(_MAIL), F.transform(F.array(parts), mail)[0]), iso(c))


def iso(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}.*)?$"), F.try_to_timestamp(F.trim(c)))


def within_window(ts: Column, as_of: datetime, hours: int = WINDOW_HOURS) -> Column:
    """True for missing and future dates too."""
    return ts.isNull() | (ts >= F.lit(as_of - timedelta(hours=hours)))


def from_epoch(seconds: Column) -> Column:
    return F.when(seconds > 0, F.timestamp_seconds(seconds))


def since_or_default(since: str | None, as_of: datetime) -> datetime:
    """The lower bound of a feed; what doesn't parse counts as missing."""
    try:
        at = datetime.fromisoformat(since.replace("Z", "+00:00"))
        return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at
    except (AttributeError, ValueError):
        return as_of - timedelta(days=DEFAULT_DAYS)


def preset_since(preset: str, as_of: datetime) -> datetime:
    return as_of - timedelta(days=PRESET_DAYS.get(preset, 7))


def iso_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def short_text(c: Column) -> Column:
    return F.date_format(c, "MMM d")
