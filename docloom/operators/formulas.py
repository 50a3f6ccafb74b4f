"""Formulas of merged workbooks: references moved with their sheets, and what depends on a cell.

A formula is cut into pieces by one expression: text literals, references, and single other characters. References are
rows: they meet the plan of the merge by a join on their sheet, and the pieces are put together again. What depends on a
cell follows from the same references, by joins on column and block of rows until nothing new is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources.storage import scratch

_SHEET = r"(?:'((?:[^']|'')+)'|([\p{L}_][\p{L}\p{N}_.]*))!"
_CELL = r"(\$?)([A-Z]{1,3})(\$?)(\d+)"
_ONE = rf"(?:{_SHEET})?{_CELL}(?:\s*:\s*(?:{_SHEET})?{_CELL})?"
_REFERENCE = rf"(?<![\p{{L}}\p{{N}}_.$]){_ONE}(?![\p{{L}}\p{{N}}_(])"
_PIECE = rf'(?s)"(?:[^"]|"")*"|{_REFERENCE}|.'
#: Rows of a block.
ROWS = 1_024


def pieces(cells: DataFrame) -> DataFrame:
    """cells(sheet, row, col, formula) -> sheet, row, col, i, piece, and of a reference its parts: sheets, columns, rows."""
    cut = cells.select("sheet", "row", "col", F.posexplode(F.regexp_extract_all("formula", F.lit(_PIECE), F.lit(0))).alias("i", "piece"))
    part = lambda k: F.regexp_extract("piece", f"(?s)^{_ONE}$", k)
    named = lambda k: F.nullif(F.concat(F.replace(part(k), F.lit("''"), F.lit("'")), part(k + 1)), F.lit(""))
    fields = {"sheet1": named(1), "abs_c1": part(3), "c1": part(4), "abs_r1": part(5), "r1": part(6), "sheet2": named(7), "abs_c2": part(9), "c2": part(10), "abs_r2": part(11), "r2": part(12)}
    return cut.withColumns({"is_ref": F.col("piece").rlike(f"(?s)^{_ONE}$"), **fields})


def shifted(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """cells(sheet, row, col, formula) and plan(sheet, target, rows, cols) -> sheet, row, col, formula, excluded.

    rows, cols: how far a sheet moves; target: its new name. References to a sheet that is not in the plan stay, and are
    listed in `excluded`. The second end of a range is in the first's sheet where it names none. Names are compared without case.
    """
    p = pieces(cells)
    near = lambda k: plan.select(F.lower("sheet").alias(f"key{k}"), F.col("target").alias(f"target{k}"), F.col("rows").alias(f"rows{k}"), F.col("cols").alias(f"cols{k}"))
    keyed = p.withColumns({"key1": F.when(F.col("is_ref"), F.lower(F.coalesce("sheet1", "sheet"))), "key2": F.when(F.col("is_ref") & (F.col("c2") != ""), F.lower(F.coalesce("sheet2", "sheet1", "sheet")))})
    found = keyed.join(near(1), "key1", "left").join(near(2), "key2", "left")

    def moved(k: int, named: Column) -> Column:
        sheet = F.when(named.isNotNull(), F.concat(T.quote_sheet(F.col(f"target{k}")), F.lit("!"))).otherwise("")
        letters = T.column_letters(T.column_number(F.col(f"c{k}")) + F.col(f"cols{k}"))
        return F.concat(sheet, F.col(f"abs_c{k}"), letters, F.col(f"abs_r{k}"), (F.col(f"r{k}").cast("long") + F.col(f"rows{k}")).cast("string"))

    range_end = F.when(F.col("c2") == "", "").otherwise(F.concat(F.lit(":"), moved(2, F.col("sheet2"))))
    new = F.when(F.col("is_ref"), F.coalesce(F.concat(moved(1, F.col("sheet1")), range_end), F.col("piece"))).otherwise(F.col("piece"))
    missing = F.when(F.col("is_ref"), F.when(F.col("target1").isNull(), F.coalesce("sheet1", "sheet")).when((F.col("c2") != "") & F.col("target2").isNull(), F.col("sheet2")))
    texts = found.select("sheet", "row", "col", F.struct("i", new.alias("piece")).alias("s"), missing.alias("missing"))
    joined = texts.groupBy("sheet", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["piece"]), "").alias("formula"), F.array_sort(F.collect_set("missing")).alias("excluded"))
    return joined


def references(cells: DataFrame) -> DataFrame:
    """The edges sheet, row, col -> ref_sheet, top, bottom, left, right: what each formula reads."""
    p = pieces(cells).where("is_ref")
    number = lambda c: T.column_number(F.col(c))
    last = lambda a, b: F.when(F.col("c2") == "", a).otherwise(b)
    r1, r2, c1, c2 = F.col("r1").cast("long"), F.col("r2").cast("long"), number("c1"), number("c2")
    e = p.select("sheet", "row", "col", F.coalesce("sheet1", "sheet").alias("ref_sheet"), r1.alias("a"), last(r1, r2).alias("b"), c1.alias("c"), last(c1, c2).alias("d"))
    return e.select("sheet", "row", "col", F.lower("ref_sheet").alias("ref_sheet"), F.least("a", "b").alias("top"), F.greatest("a", "b").alias("bottom"), F.least("c", "d").alias("left"), F.greatest("c", "d").alias("right")).distinct()


def dependents(cells: DataFrame, changed: DataFrame, most: int = 10_000) -> DataFrame:
    """cells(sheet, row, col, formula), changed(sheet, row, col) -> for each changed cell all that depend on it, at any depth.

    source_sheet, source_row, source_col, sheet, row, col, cyclic: whether the cell is the source itself. Each round joins
    what the last one found, and keeps what is new; a reference is known by its columns and blocks of rows.
    """
    spark, folder = cells.sparkSession, scratch(cells.sparkSession, "dependents")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    block = lambda c: F.floor(F.col(c) / ROWS)
    e = references(cells).withColumn("_col", F.explode(F.sequence("left", "right"))).withColumn("_block", F.explode(F.sequence(block("top"), block("bottom"))))
    e = stored(e.select(F.col("sheet").alias("to_sheet"), F.col("row").alias("to_row"), F.col("col").alias("to_col"), "ref_sheet", "top", "bottom", "_col", "_block"), "references")
    source = ["source_sheet", "source_row", "source_col"]
    cell = ["sheet", "row", "col"]
    front = changed.select(*[F.col(c).alias(s) for c, s in zip(cell, source)], *cell).distinct()
    seen = None
    for n in range(most):
        at = front.withColumns({"ref_sheet": F.lower("sheet"), "_col": F.col("col").cast("long"), "_block": block("row")})
        met = at.join(e, ["ref_sheet", "_col", "_block"]).where(F.col("row").between(F.col("top"), F.col("bottom")))
        new = met.select(*source, F.col("to_sheet").alias("sheet"), F.col("to_row").alias("row"), F.col("to_col").alias("col")).distinct()
        front = stored(new if seen is None else new.join(seen, [*source, *cell], "left_anti"), f"round{n}")
        if front.limit(1).count() == 0:
            break
        seen = front if seen is None else seen.union(front)
    else:
        raise RuntimeError("dependents: no fixed point")
    out = front if seen is None else seen
    same = [F.lower(source[0]) == F.lower("sheet"), F.col(source[1]) == F.col("row"), F.col(source[2]) == F.col("col")]
    return out.withColumn("cyclic", same[0] & same[1] & same[2])
