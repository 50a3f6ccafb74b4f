"""Registered queries of packages, pitch plans, dates and the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.catalogue import query
from docloom.operators.sheet_queries import archive_names
from docloom.operators.text_queries import table
from docloom.sources.packages import bundles


@query("zip_bundles", "SELECT p_partkey // 100 AS bundle, CAST(count(*) AS BIGINT) AS files, true AS whole FROM part GROUP BY 1")
def zip_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of up to a hundred parts under names of their own; whole: each begins and ends as an archive does."""
    d = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("bundle"), "p_partkey", F.concat("p_brand", F.lit(".txt")).alias("file"), F.col("p_name").cast("binary").alias("content"))
    made = bundles(archive_names(d, "bundle", "p_partkey", "file"), "bundle", "p_partkey", "name", "content")
    ends = F.locate("504B0506", F.hex(F.substring("archive", -22, 22))) == 1
    return made.select("bundle", "files", ((F.hex(F.substring("archive", 1, 4)) == "504B0304") & ends).alias("whole"))


def pitch(semitones: Column, rate: Column) -> dict[str, Column]:
    """How a shift by semitones (an octave at most) is played: changed, the rate to read at, and the tempo that makes up for it."""
    s = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), F.coalesce(F.nanvl(semitones.cast("double"), F.lit(0.0)), F.lit(0.0))))
    ratio = F.pow(F.lit(2.0), s / 12.0)
    return {"changed": F.abs(s) >= 0.01, "shifted_rate": F.greatest(F.lit(1), F.floor(rate * ratio + 0.5)).cast("long"), "tempo": 1.0 / ratio}


@query("pitch_plan", "SELECT p_partkey, abs(s) >= 0.01 AS changed, CAST(greatest(1, floor(44100 * pow(2.0::DOUBLE, s / 12) + 0.5)) AS BIGINT) AS shifted_rate, round(1 / pow(2.0::DOUBLE, s / 12), 8) AS tempo FROM (SELECT p_partkey, greatest(-12.0::DOUBLE, least(12.0::DOUBLE, coalesce(p_size - 25, 0))) AS s FROM part)")
def pitch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = pitch(F.col("p_size") - 25, F.lit(44100))
    return table(spark, sf_dir, "part").select("p_partkey", *[(F.round(c, 8) if n == "tempo" else c).alias(n) for n, c in parts.items()])


@query("local_dates", "SELECT event_id, strftime(ts + INTERVAL (CAST(event_id % 27 AS INT) - 12) HOUR, '%Y-%m-%d') AS day FROM events")
def local_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ISO date of an instant at an offset from UTC."""
    offset = F.make_dt_interval(hours=(F.col("event_id") % 27).cast("int") - 12)
    return table(spark, sf_dir, "events").select("event_id", F.date_format(F.col("ts") + offset, "yyyy-MM-dd").alias("day"))


#: The coefficients of the published equal-earth projection.
_A = (1.340264, -0.081106, 0.000893, 0.003796)


def equal_earth(lon: Column, lat: Column) -> tuple[Column, Column]:
    """x and y of degrees on a unit sphere, by the published formula."""
    t = F.asin(F.lit(3.0**0.5 / 2) * F.sin(F.radians(lat)))
    t2 = t * t
    t6 = t2 * t2 * t2
    slope = _A[0] + 3 * _A[1] * t2 + t6 * (7 * _A[2] + 9 * _A[3] * t2)
    return F.radians(lon) * F.cos(t) / (F.lit(3.0**0.5 / 2) * slope), t * (_A[0] + _A[1] * t2 + t6 * (_A[2] + _A[3] * t2))


@query("map_points", f"""SELECT p_partkey, round(radians(lon) * cos(t) / (sqrt(3.0::DOUBLE) / 2 * ({_A[0]}::DOUBLE + 3 * {_A[1]}::DOUBLE * t * t + pow(t, 6) * (7 * {_A[2]}::DOUBLE + 9 * {_A[3]}::DOUBLE * t * t))), 6) AS x, round(t * ({_A[0]}::DOUBLE + {_A[1]}::DOUBLE * t * t + pow(t, 6) * ({_A[2]}::DOUBLE + {_A[3]}::DOUBLE * t * t)), 6) AS y
FROM (SELECT p_partkey, lon, asin(sqrt(3.0::DOUBLE) / 2 * sin(radians(lat))) AS t FROM (SELECT p_partkey, (p_partkey % 361 - 180)::DOUBLE AS lon, (p_size * 3 - 75)::DOUBLE AS lat FROM part))""")
def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = equal_earth((F.col("p_partkey") % 361 - 180).cast("double"), (F.col("p_size") * 3 - 75).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))
