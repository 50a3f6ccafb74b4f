"""Places in an order without sorting everything in one task, and checks of size before work that one task does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a sheet holds.
SHEET_ROWS, SHEET_COLUMNS = 1_048_576, 16_384


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """df, which must have at most so many rows: for what goes to one task by its nature."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return df


def reached(value: Column, bounds: list[float]) -> Column:
    """How many of the ascending bounds are below a value, by bisection; zero for null."""
    if not bounds:
        return F.lit(0)
    listed = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")
    steps = F.array(*[F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(listed, at + step - 1) < value), at + step).otherwise(at))


def quantiles(df: DataFrame, order: str, parts: int) -> list[float]:
    """Bounds that cut a number into ranges of about as many rows; any bounds give the same places."""
    if parts < 2:
        return []
    return sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.2 / parts)))


def ordinals(df: DataFrame, key: str, order: str, name: str = "n", parts: int = 256) -> DataFrame:
    """df with the place, from one, of each row by a number among the rows of its key.

    Rows are numbered within a range of the order and raised by the counts of the ranges before, so a key that
    very many rows have is not sorted in one task.
    """
    df = df.withColumn("_range", reached(F.col(order), quantiles(df, order, parts)))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_part")).agg(F.count("*").alias("_many"))
    base = base.withColumnRenamed("_part", "_range").select("_key", "_range", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_base")).withColumnRenamed("_range", "_part")
    own = df.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)))
    joined = own.join(base, own[key].eqNullSafe(F.col("_key")) & (own["_range"] == F.col("_part")))
    return joined.withColumn(name, F.col("_place") + F.col("_base")).drop("_range", "_place", "_key", "_part", "_base")
