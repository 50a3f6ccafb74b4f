"""Workbooks as cell tables: merging, bounds, trimming, selection grammars, references.

A cell table has (sheet, row, col, v): one row for each cell with a value, positions from one. Sheets have
an order in a plan table (sheet, ix). Nothing depends on a frame's row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.ranges import SHEET_ROWS, bounded


def cells(df: DataFrame, sheet: str, order: list[str], header: bool = True) -> DataFrame:
    """A table as the cells of a sheet, its rows in the given order, after a header row.

    Rows are numbered in one ordered pass: a sheet has at most 1,048,576 rows, and more are an error.
    """
    bounded(df, SHEET_ROWS - int(header), "rows of a sheet")
    names = df.columns
    n = F.row_number().over(Window.orderBy(*order)) + int(header)
    values = F.array(*[F.col(c).cast("string") for c in names])
    body = df.select(n.alias("row"), values.alias("l")).select("row", F.posexplode("l").alias("i", "v"))
    body = body.select(F.lit(sheet).alias("sheet"), "row", (F.col("i") + 1).alias("col"), "v")
    if not header:
        return body
    top = df.sparkSession.createDataFrame([(sheet, 1, i + 1, c) for i, c in enumerate(names)], body.schema)
    return top.union(body)


def is_content(v: Column) -> Column:
    """For bounds: anything but null and the empty text; white space is content."""
    return v.isNotNull() & (v != "")


def bounds(table: DataFrame) -> DataFrame:
    """sheet, rows, cols: the last row and column with content."""
    return table.where(is_content(F.col("v"))).groupBy("sheet").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))


def merge(table: DataFrame, plan: DataFrame, how: str, skip_rows: int = 0) -> DataFrame:
    """Sheets below each other ("vertical", by column position) or beside each other ("horizontal", by row).

    skip_rows: leading rows left out of every sheet after the first.
    """
    b = plan.join(bounds(table), "sheet", "left").fillna(0, ["rows", "cols"])
    first = F.col("ix") == F.min("ix").over(Window.partitionBy())
    skip = F.when(first, 0).otherwise(F.least(F.lit(max(0, int(skip_rows))), F.col("rows"))) if how == "vertical" else F.lit(0)
    b = b.withColumn("skip", skip)
    before = Window.orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)  # one row a sheet
    size = F.col("rows") - F.col("skip") if how == "vertical" else F.col("cols")
    b = b.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0))).select("sheet", "skip", "offset")
    joined = table.join(b, "sheet").where(F.col("row") > F.col("skip"))
    if how == "vertical":
        return joined.select("sheet", (F.col("row") - F.col("skip") + F.col("offset")).alias("row"), F.col("col").cast("long").alias("col"), "v")
    if how == "horizontal":
        return joined.select("sheet", F.col("row").cast("long").alias("row"), (F.col("col") + F.col("offset")).alias("col"), "v")
    raise ValueError(how)


def trim_gaps(table: DataFrame, axis: str, threshold: float, within: int = 1 << 20) -> DataFrame:
    """Removes runs of at least `threshold` empty rows (or columns) between or before those with values.

    Only positions that hold a value matter: a gap is the distance between two of them, so no spine of empty
    positions is built. White space alone is empty here.
    """
    least = max(1, int(threshold))
    used = table.where(T.trim(F.coalesce("v", F.lit(""))) != "").select("sheet", F.col(axis).alias("p")).distinct()
    order = Window.partitionBy("sheet").orderBy("p")
    gap = F.col("p") - F.coalesce(F.lag("p").over(order), F.lit(0)) - 1
    cut = used.withColumn("gone", F.when(gap >= least, gap).otherwise(0))
    cut = cut.withColumn("removed", F.sum("gone").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("sheet", F.col("p").alias(axis), "removed")
    return table.join(cut, ["sheet", axis]).withColumn(axis, F.col(axis) - F.col("removed")).drop("removed")


def parse_positions(pattern: Column, count: Column) -> Column:
    """Positions that a list like `3, -2, 5-, 7-4` names: clamped to 1..count, first mention kept, bad parts ignored."""
    parts = F.transform(F.split(pattern, ","), lambda x: F.trim(x))

    def one(p: Column) -> Column:
        number = lambda i: F.expr("0").cast("int") if i is None else F.try_element_at(F.regexp_extract_all(p, F.lit(r"\d+"), F.lit(0)), F.lit(i)).cast("int")
        a, b = number(1), number(2)
        clamp = lambda x: F.greatest(F.lit(1), F.least(x, count))
        none = F.array().cast("array<int>")
        run = lambda x, y: F.sequence(clamp(x), clamp(y))
        return (
            F.when(count < 1, none)
            .when(p.rlike(r"^\d+$"), F.when((a >= 1) & (a <= count), F.array(a)).otherwise(none))
            .when(p.rlike(r"^-\s*\d+$"), F.when(a >= 1, run(F.lit(1), a)).otherwise(none))
            .when(p.rlike(r"^\d+\s*-$"), F.when(a <= count, run(a, count)).otherwise(none))
            .when(p.rlike(r"^\d+\s*-\s*\d+$"), run(a, b))
            .otherwise(none)
        )

    return F.array_distinct(F.flatten(F.transform(parts, one)))


def page_range_error(pattern: Column, count: Column) -> Column:
    """Why a strict page range is wrong, or null: every part must be within 1..count, and something be named."""
    parts = F.filter(F.transform(F.split(pattern, ","), lambda x: F.trim(x)), lambda p: p != "")
    shape = F.exists(parts, lambda p: ~p.rlike(r"^(\d+|\d+\s*-\s*\d*|-\s*\d+)$"))
    outside = F.exists(parts, lambda p: F.exists(F.regexp_extract_all(p, F.lit(r"\d+"), F.lit(0)), lambda x: (x.cast("int") < 1) | (x.cast("int") > count)))
    return F.when(F.size(parts) == 0, "EMPTY").when(shape, "SYNTAX").when(outside, "BOUNDS")


def format_ranges(df: DataFrame, key: str, page: str) -> DataFrame:
    """key, pages: the distinct page numbers as text like `1-3, 5`."""
    d = df.select(key, F.col(page).alias("p")).distinct()
    d = d.withColumn("island", F.col("p") - F.row_number().over(Window.partitionBy(key).orderBy("p")))
    runs = d.groupBy(key, "island").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    listed = runs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("a", text.alias("t")))).alias("l"))
    return listed.select(key, F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("pages"))


def referenced_sheets(formulas: DataFrame, sheets: DataFrame) -> DataFrame:
    """Sheets (sheet) that a formula of another sheet (sheet, formula) names, without regard to case."""
    pattern = r"(?:'((?:[^']|'')+)'|([\p{L}_][\p{L}\p{N}_.]*))!"
    quoted = F.transform(F.regexp_extract_all("formula", F.lit(pattern), F.lit(1)), lambda x: F.replace(x, F.lit("''"), F.lit("'")))
    plain = F.regexp_extract_all("formula", F.lit(pattern), F.lit(2))
    named = formulas.select(F.lower("sheet").alias("source"), F.explode(F.concat(quoted, plain)).alias("n")).where("n <> ''").select("source", F.lower("n").alias("target")).where("source <> target").select("target").distinct()
    return sheets.join(named, F.lower("sheet") == F.col("target"), "left_semi")
