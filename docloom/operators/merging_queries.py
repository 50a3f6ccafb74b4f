"""Registered queries of merging by options, with its warnings in words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.messages import MESSAGES, localised
from docloom.operators import merging as M
from docloom.operators.catalogue import query
from docloom.operators.text_queries import table


def _book(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A sheet for each type of event: the last event of each minute of the day and day of the month; every fourth shows nothing."""
    e = table(spark, sf_dir, "events").where("event_type IS NOT NULL AND ts IS NOT NULL")
    last = e.groupBy(F.col("event_type").alias("sheet"), (F.hour("ts") * 60 + F.minute("ts") + 1).cast("long").alias("row"), (F.dayofmonth("ts") * 3).cast("long").alias("col")).agg(F.max("event_id").alias("k"))
    cells = last.select("sheet", "row", "col", F.when(F.col("k") % 4 == 0, "").otherwise(F.col("k").cast("string")).alias("v"))
    plan = e.select(F.col("event_type").alias("sheet")).distinct().select("sheet", F.col("sheet").alias("ix"), F.lit("book.xlsx").alias("file"))
    return cells, plan


_book_sql = """WITH g AS (SELECT event_type AS sheet, CAST(hour(ts) * 60 + minute(ts) + 1 AS BIGINT) AS row, CAST(day(ts) * 3 AS BIGINT) AS col, max(event_id) AS k FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
t AS (SELECT sheet, max(row) AS last_row, max(row) FILTER (WHERE k % 4 <> 0) AS full_row FROM g GROUP BY sheet),
c AS (SELECT sheet, row, col, CAST(k AS VARCHAR) AS v FROM g WHERE k % 4 <> 0)"""


@query("merge_by_options", _book_sql + """, p AS (SELECT sheet, full_row AS rows, CASE WHEN row_number() OVER (ORDER BY sheet) = 1 THEN 0 ELSE least(2, full_row) END AS skip FROM t),
o AS (SELECT *, coalesce(sum(rows - skip) OVER (ORDER BY sheet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p),
m AS (SELECT c.row - o.skip + o.off AS row, c.col, c.v FROM c JOIN o ON c.sheet = o.sheet WHERE c.row > o.skip),
r AS (SELECT row, sum(CASE WHEN gap >= 2 THEN gap ELSE 0 END) OVER (ORDER BY row) AS gone FROM (SELECT row, row - coalesce(lag(row) OVER (ORDER BY row), 0) - 1 AS gap FROM (SELECT DISTINCT row FROM m))),
k AS (SELECT col, sum(CASE WHEN gap >= 2 THEN gap ELSE 0 END) OVER (ORDER BY col) AS gone FROM (SELECT col, col - coalesce(lag(col) OVER (ORDER BY col), 0) - 1 AS gap FROM (SELECT DISTINCT col FROM m)))
SELECT CAST(m.row - r.gone AS BIGINT) AS row, CAST(m.col - k.gone AS BIGINT) AS col, v FROM m JOIN r ON m.row = r.row JOIN k ON m.col = k.col""")
def merge_by_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Below each other without the first two rows and what is empty at the ends, then without gaps of two and more."""
    cells, warnings = M.combine(*_book(spark, sf_dir), M.MergeOptions("vertical", values_only=True, trim_edges=True, trim_rows=True, trim_columns=True, threshold=2, skip_rows=2))
    return cells.select("row", "col", "v")


def _said_sql(language: int) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v[language]}'" for k, v in MESSAGES.items())
    return f"replace(replace(CASE code {cases} END, '{{{{sheet}}}}', target), '{{{{named}}}}', coalesce(named, ''))"


@query("merge_warnings", f"""WITH s AS (SELECT event_type AS sheet, row_number() OVER (ORDER BY event_type) AS n FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL)),
w AS (SELECT sheet || '_book' AS target, unnest(CASE n WHEN 1 THEN ['TRIM_SKIPPED_FORMULA', 'REFERENCE_EXCLUDED'] ELSE ['TRIM_SKIPPED_REFERENCED'] END) AS code, n FROM s WHERE n <= 2),
x AS (SELECT target, code, CASE code WHEN 'REFERENCE_EXCLUDED' THEN 'elsewhere' END AS named FROM w)
SELECT target, code, {_said_sql(0)} AS english, {_said_sql(1)} AS korean FROM x""")
def merge_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side by side, where the first sheet reads the second and one that is not there: what stays untrimmed, in both languages."""
    cells, plan = _book(spark, sf_dir)
    nth = lambda i: F.try_element_at(F.array_sort(F.collect_set("sheet")), F.lit(i))
    formula = plan.agg(nth(1).alias("sheet"), F.concat(F.lit("'"), nth(2), F.lit("'!C3+elsewhere!A1")).alias("formula")).where("formula IS NOT NULL")
    one = F.lit(1).cast("long")
    cells = cells.withColumn("formula", F.lit(None).cast("string")).union(formula.select("sheet", one, one, F.lit(None).cast("string"), "formula"))
    _, warnings = M.combine(cells, plan, M.MergeOptions("sheets", trim_edges=True, trim_rows=True, threshold=3, name_rule="sheet-file"))
    values = F.create_map(F.lit("sheet"), F.col("target"), F.lit("named"), F.col("named"))
    return warnings.select("target", "code", *[localised(F.col("code"), values, F.lit(k)).alias(n) for k, n in (("en", "english"), ("ko", "korean"))])
