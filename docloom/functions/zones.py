"""Time zones: the city dimension, wall-clock conversion, working hours, meeting slots."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id and zone of the cities that a schedule can name.
CITIES = (
    ("seoul", "Asia/Seoul"), ("tokyo", "Asia/Tokyo"), ("beijing", "Asia/Shanghai"), ("hong-kong", "Asia/Hong_Kong"), ("taipei", "Asia/Taipei"), ("manila", "Asia/Manila"),
    ("singapore", "Asia/Singapore"), ("bangkok", "Asia/Bangkok"), ("jakarta", "Asia/Jakarta"), ("new-delhi", "Asia/Kolkata"), ("dubai", "Asia/Dubai"),
    ("istanbul", "Europe/Istanbul"), ("london", "Europe/London"), ("paris", "Europe/Paris"), ("berlin", "Europe/Berlin"), ("amsterdam", "Europe/Amsterdam"), ("madrid", "Europe/Madrid"),
    ("rome", "Europe/Rome"), ("warsaw", "Europe/Warsaw"), ("stockholm", "Europe/Stockholm"), ("athens", "Europe/Athens"), ("moscow", "Europe/Moscow"), ("new-york", "America/New_York"),
    ("los-angeles", "America/Los_Angeles"), ("chicago", "America/Chicago"), ("toronto", "America/Toronto"), ("vancouver", "America/Vancouver"), ("mexico-city", "America/Mexico_City"), ("bogota", "America/Bogota"),
    ("lima", "America/Lima"), ("sao-paulo", "America/Sao_Paulo"), ("buenos-aires", "America/Argentina/Buenos_Aires"), ("santiago", "America/Santiago"), ("sydney", "Australia/Sydney"), ("melbourne", "Australia/Melbourne"),
    ("perth", "Australia/Perth"), ("auckland", "Pacific/Auckland"), ("honolulu", "Pacific/Honolulu"), ("cairo", "Africa/Cairo"), ("casablanca", "Africa/Casablanca"), ("lagos", "Africa/Lagos"),
    ("nairobi", "Africa/Nairobi"), ("johannesburg", "Africa/Johannesburg"), ("cape-town", "Africa/Johannesburg"),
)


def cities(spark: SparkSession) -> DataFrame:
    """id, zone, ord: a dimension of a few dozen rows."""
    return spark.createDataFrame([(*c, i) for i, c in enumerate(CITIES)], "id string, zone string, ord int")


def search(df: DataFrame, text: str, columns: list[str], most: int = 8) -> DataFrame:
    """Rows whose columns contain the text, in list order; none for a blank text."""
    wanted = text.strip().lower().replace("-", " ")
    if not wanted:
        return df.limit(0)
    said = F.replace(F.lower(F.concat_ws(" ", *columns)), F.lit("-"), F.lit(" "))
    return df.where(F.contains(said, F.lit(wanted))).orderBy("ord").limit(most)


def wall_time(instant_utc: Column, zone: Column) -> Column:
    """A UTC wall time's local wall time, without zone."""
    return F.convert_timezone(F.lit("UTC"), zone, instant_utc)


#: With so many changes of a zone's offset in the data's time, or fewer, they are compared one by one.
FEW_CHANGES = 64


def offsets(spark: SparkSession, zone: str, first: datetime, last: datetime) -> list[tuple[datetime | None, int]]:
    """A zone's offsets from UTC in seconds in a span of UTC time, each with the instant from which it holds; the first from any."""
    rules = spark._jvm.java.time.ZoneId.of(zone).getRules()
    instant = lambda t: spark._jvm.java.time.Instant.ofEpochSecond(int(t.replace(tzinfo=UTC).timestamp()))
    out: list[tuple[datetime | None, int]] = [(None, rules.getOffset(instant(first)).getTotalSeconds())]
    change = rules.nextTransition(instant(first))
    while change is not None and (at := datetime.fromtimestamp(change.getInstant().getEpochSecond(), UTC).replace(tzinfo=None)) <= last:
        out.append((at, change.getOffsetAfter().getTotalSeconds()))
        change = rules.nextTransition(change.getInstant())
    return out


def offset_seconds(instant_utc: Column, known: list[tuple[datetime | None, int]]) -> Column:
    """The offset that holds at a UTC wall time."""
    out = F.lit(known[0][1])
    for at, seconds in known[1:]:
        out = F.when(instant_utc >= F.lit(at).cast("timestamp_ntz"), seconds).otherwise(out)
    return F.when(instant_utc.isNotNull(), out)


def works(local: Column, start: float = 9.0, end: float = 18.0) -> Column:
    hour = F.hour(local) + F.minute(local) / 60.0
    return (hour >= start) & (hour < end)


def day_shift(local: Column, base: Column) -> Column:
    return F.datediff(local.cast("date"), base.cast("date"))


def offset_hours(local: Column, base: Column) -> Column:
    return F.round(F.timestamp_diff("MINUTE", base, local) / 60.0, 1)


def meeting_slots(spark: SparkSession, days: DataFrame, zones: list[str], start: float = 9.0, end: float = 18.0) -> DataFrame:
    """days(day) -> day, slot (UTC): half hours of the first zone's day when all zones are within hours."""
    base = F.lit(zones[0])
    utc = lambda ntz: F.convert_timezone(base, F.lit("UTC"), ntz)
    first, after = utc(F.col("day").cast("timestamp_ntz")), utc(F.date_add("day", 1).cast("timestamp_ntz"))
    slots = days.select("day", F.explode(F.sequence(first, after - F.expr("INTERVAL 30 MINUTES"), F.expr("INTERVAL 30 MINUTES"))).alias("slot"))
    ok = F.lit(True)
    for z in zones:  # every zone: a conjunction over a stated, short list
        ok = ok & works(wall_time(F.col("slot"), F.lit(z)), start, end)
    return slots.where(ok)
