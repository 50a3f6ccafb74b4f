"""JSON objects of any shape as tables: every key a column, in the order in which keys are first seen, every value a text.

Nested values stay JSON text, a text is itself, null and what is missing are empty. A text holds an object, or an array of
objects (or of arrays, whose places are `Column N`). What holds neither is a row with an error. Headers are found by one
aggregation (the least row and place of each key); there are as many as a sheet has columns, at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.ranges import SHEET_COLUMNS, bounded

_OBJECT = r"(?s)^\s*\{.*\}\s*$"
_ARRAY = r"(?s)^\s*\[.*\]\s*$"


def items(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, item, value, kind, error: the objects of each text, numbered from zero, as JSON text; an empty array has none."""
    t = F.col(text)
    listed = F.when(t.rlike(_ARRAY), F.from_json(t, "array<string>")).otherwise(F.array(t))
    # a text without items that is no array is an item with an error
    rows = df.select(F.col(key).alias("key"), F.posexplode(F.coalesce(listed, F.array(F.lit(None).cast("string")))).alias("item", "value"))
    parsed = rows.withColumn("variant", F.try_parse_json("value"))
    kind = F.when(F.col("variant").isNull(), None).when(F.col("value").rlike(_OBJECT), "object").when(F.col("value").rlike(_ARRAY), "array")
    return parsed.withColumn("kind", kind).withColumn("error", F.when(F.col("kind").isNull(), F.when(F.col("variant").isNull(), "INVALID_JSON").otherwise("NOT_AN_OBJECT")))


def said(v: Column) -> Column:
    """A value as a cell's text."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))


def cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, item, place, name, value, error: a row for each value of each object, place from zero in the object's own order."""
    found = items(df, key, text)
    spark = df.sparkSession
    inside = found.lateralJoin(spark.tvf.variant_explode(F.col("variant").outer()))
    own = inside.toDF("key", "item", "text", "variant", "kind", "error", "pos", "name", "inner").where("kind IS NOT NULL")
    place = F.when(F.col("kind") == "object", F.array_position(F.json_object_keys("text"), F.col("name")) - 1).otherwise(F.col("pos")).cast("long")
    name = F.when(F.col("kind") == "object", F.col("name")).otherwise(F.concat(F.lit("Column "), F.col("pos") + 1))
    rows = own.select("key", "item", place.alias("place"), name.alias("name"), said(F.col("inner")).alias("value"), "error")
    return rows.union(found.where("error IS NOT NULL").select("key", "item", F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string"), "error"))


def headers(cell: DataFrame) -> DataFrame:
    """name, ord: the names of cells by the first row, item and place that has them."""
    first = cell.where("name IS NOT NULL").groupBy("name").agg(F.min(F.struct("key", "item", "place")).alias("at"))
    return bounded(first, SHEET_COLUMNS, "columns").select("name", (F.row_number().over(Window.orderBy("at", "name")) - 1).alias("ord"))


def schema(df: DataFrame, text: str) -> Column | str:
    """The shape that all objects have together, as Spark writes schemas."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(text)).alias("s")).first()["s"]


def json_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _item, a column for each header, _error."""
    cell = cells(df, key, text)
    names = [r["name"] for r in headers(cell).orderBy("ord").collect()]  # at most a sheet's columns
    pairs = F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))
    rows = cell.groupBy("key", "item").agg(F.map_from_entries(pairs).alias("m"), F.max("error").alias("error"))
    bare = items(df, key, text).where("kind IN ('object', 'array')").select("key", "item")  # also objects without keys
    whole = bare.join(rows.where("error IS NULL").drop("error"), ["key", "item"], "left").withColumn("error", F.lit(None).cast("string")).unionByName(rows.where("error IS NOT NULL").select("key", "item", "m", "error"))
    return whole.select(F.col("key").alias("_key"), F.col("item").alias("_item"), *[F.coalesce(F.try_element_at("m", F.lit(n)), F.lit("")).alias(n) for n in names], F.col("error").alias("_error"))
