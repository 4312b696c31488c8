"""Reading an instant from text or numbers of mixed form: an ordered cascade of anchored patterns.

Every pattern is anchored at both ends and parsed strictly: a field out of range (month 13,
30 February, second 61) makes the whole value unreadable instead of rolling over. All of it is
built from Spark SQL expressions, so that the cascade stays inside one generated stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Zone abbreviations with one customary meaning in the logs, as offsets in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "BST": 60, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780,
    "NPT": 345, "IST": 330, "HKT": 480, "SGT": 480,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_OFFSET = r"[+-]\d{2}(?::?\d{2})?(?::?\d{2})?"
_NAME = r"[A-Za-z][A-Za-z0-9_+/-]*"
#: What may follow a wall time: an offset and/or a zone name, the name bare or in brackets.
_ZONE = rf"\s*({_OFFSET}|(?![AaPp][Mm]\b){_NAME})?\s*(?:[\[(]({_NAME})[\])])?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"

#: The patterns in the order in which they are tried, with the groups of
#: year, month, day, hour, minute, second, fraction, half of the day, zone, name in brackets (0: none).
PATTERNS = (
    ("iso", rf"^(\d{{4}})[-/.](\d{{2}})[-/.](\d{{2}})[Tt ]\s*{_CLOCK}{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    ("mail", rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[ -]([A-Za-z]{{3,9}})\.?[ -](\d{{4}}),?\s+{_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 0, 8, 9)),
    ("english", rf"^(?:[A-Za-z]{{3,9}},?\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+(?:at\s+)?{_CLOCK}\s*([AaPp]\.?[Mm]\.?)?{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 8, 9, 10)),
    ("slashes", rf"^(\d{{1,2}})[/.](\d{{1,2}})[/.](\d{{4}}),?\s+{_CLOCK}\s*([AaPp]\.?[Mm]\.?)?{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 8, 9, 10)),
)

DAY_MS = 86_400_000


def known_zones(spark: SparkSession) -> list[str]:
    """The zone ids of the JVM (about 600, a fixed list): anything else would make to_utc_timestamp fail."""
    return sorted(str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray() if not str(z).startswith("SystemV/"))


def epoch_ms(number: Column, first_ms: int, last_ms: int) -> Column:
    """Milliseconds of an epoch in seconds, milliseconds, microseconds or nanoseconds (decimal), cut off below.

    The unit is the one that puts the number between first_ms and last_ms; NULL where none does,
    and for zero and negative numbers.
    """
    n = number.cast("decimal(38,9)")
    within = lambda ms: (ms >= first_ms) & (ms < last_ms)
    units = [n * 1000, n, n / 1000, n / 1_000_000]
    whole = [F.floor(u).try_cast("long") for u in units]
    return reduce(lambda rest, ms: F.when(within(ms), ms).otherwise(rest), reversed(whole), F.lit(None).cast("long"))


SEPARATOR = "\x01"


def split_wall(value: Column) -> Column:
    """Array of kind, year, month, day, hour, minute, second, fraction, half, zone, named; NULL where no pattern fits."""
    s = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.split(reduce(lambda rest, p: F.when(s.rlike(p[1]), F.regexp_replace(s, p[1], SEPARATOR.join([p[0], *(f"${g}" if g else "" for g in p[2])]))).otherwise(rest), reversed(PATTERNS), F.lit(None).cast("string")), SEPARATOR)


def _month(text: Column) -> Column:
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(text, 1, 3)))
    return F.coalesce(text.try_cast("int"), F.when(named > 0, named.cast("int")))


def date_of(parts: Column, month_first: bool = True) -> Column:
    """The date in the parts of split_wall, NULL for an impossible one.

    In dates with slashes the order of day and month is the one that gives a real date; where both do,
    month_first says which.
    """
    day = parts[3].try_cast("int")
    date = lambda m, d: F.concat_ws("-", parts[1], F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")
    month = _month(parts[2])
    swapped = F.when(parts[0] == "slashes", date(day, month))
    return F.coalesce(date(month, day), swapped) if month_first else F.coalesce(swapped, date(month, day))


def wall_ms(date: Column, parts: Column) -> Column:
    """Milliseconds of the wall time as if it were UTC; NULL where a field is out of range."""
    half = F.lower(F.regexp_replace(parts[8], r"\.", ""))
    hour, minute, second = parts[4].try_cast("int"), parts[5].try_cast("int"), F.coalesce(F.nullif(parts[6], F.lit("")), F.lit("0")).try_cast("int")
    millis = F.rpad(F.substring(parts[7], 1, 3), 3, "0").try_cast("int")
    hour = F.when(half == "", F.when(hour < 24, hour)).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    return F.when((minute < 60) & (second < 60), F.unix_date(date) * F.lit(DAY_MS).cast("long") + (hour * 3600 + minute * 60 + second).cast("long") * 1000 + F.coalesce(millis, F.lit(0)))


def offset_minutes(zone: Column) -> Column:
    """Minutes of a numeric offset or a known abbreviation; NULL for zone names and out-of-range offsets."""
    digits = F.regexp_replace(zone, r"[^0-9]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    table = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    numeric = F.when((minutes <= 18 * 60) & (F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)) < 60), sign * minutes)
    return F.when(zone.rlike(r"^[+-]\d"), numeric).otherwise(F.try_element_at(table, F.upper(zone)))


def zone_to_utc_ms(wall_ms: Column, zone: Column) -> Column:
    """The instant of a wall time in a zone of known_zones.

    A wall time that occurs twice means the earlier instant; one that doesn't occur moves forward
    by the length of the gap: both are the rules of java.time, which Spark's to_utc_timestamp follows.
    """
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(wall_ms), zone))
