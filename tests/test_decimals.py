"""Numbers with a fixed number of places: as DuckDB writes them, also where a double lies halfway between two texts."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from docloom.functions import text as T
from pyspark.sql import functions as F


@pytest.mark.parametrize("places", [1, 2, 6])
def test_decimals_are_those_of_the_exact_value(spark, places):
    r = random.Random(places)
    values = [0.0, -0.0, 0.125, 0.375, 26735.625, 24.25, 24.75, 1.005, 5e-7, 1.5e-6, 3 / 128, -0.0078125, 0.9999999, 9.995, 2.0**62, -1e-9]
    values += [r.randint(0, 1 << 40) / 2 ** r.randint(0, 30) for _ in range(2_000)] + [r.randint(-(10**9), 10**9) / 2e6 for _ in range(2_000)]
    d = spark.createDataFrame([(x,) for x in values], "x double").select(T.decimals(F.col("x"), places).alias("t"))
    assert [r["t"] for r in d.collect()] == [f"{x:.{places}f}" for x in values]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double").select(T.decimals(F.col("x"), places).alias("t"))
    assert [r["t"] for r in odd.collect()] == ["nan", "inf", "-inf", None]


def test_scalar_formats_of_parts_halfway_between_two_sizes(spark, tmp_path):
    d = spark.range(60_000, 100_000, 512).selectExpr("id AS p_partkey", "CAST(id / 512 % 50 + 1 AS INT) AS p_size", "CAST(900 + id % 100 AS DOUBLE) AS p_retailprice")
    more = spark.createDataFrame([(86016, 40, 901.6), (512, 1, 0.5), (512, 3, 7 / 128)], "p_partkey long, p_size int, p_retailprice double")
    d.union(more).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = [tuple(r) for r in entry.queries()["scalar_formats"](spark, str(tmp_path)).collect()]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    expected = c.execute(entry.oracle_sql()["scalar_formats"]).fetchall()
    assert sorted(got, key=str) == sorted(expected, key=str)
