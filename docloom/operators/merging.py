"""One workbook made of many, by options: sheets side by side, below each other or beside each other.

Cells are (sheet, row, col, v) and may have a formula; a plan (sheet, ix, file) tells the order. Sheets are as formulas name
them. What could not be done as asked comes as warnings (target, code, named), not as messages: `functions.messages` has those.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import formulas
from docloom.operators import workbook as W
from docloom.operators.text_queries import unique_names

#: The sheet that all others are merged into.
MERGED = "Merged"
MODES, RULES = ("sheets", "vertical", "horizontal"), ("file-sheet", "sheet-file", "sheet")


@dataclass(frozen=True)
class MergeOptions:
    """How to merge.

    mode: one of `MODES`. values_only: formulas become their values. trim_edges: a sheet ends at its last content, else at its
    last cell. trim_rows, trim_columns: runs of at least `threshold` empty ones go. skip_rows: leading rows that sheets after
    the first leave out when merged vertically. name_rule: one of `RULES`, for sheets side by side.
    """

    mode: str = "sheets"
    values_only: bool = False
    trim_edges: bool = False
    trim_rows: bool = False
    trim_columns: bool = False
    threshold: float = 1
    skip_rows: int = 0
    name_rule: str = "file-sheet"

    def __post_init__(self) -> None:
        if self.mode not in MODES or self.name_rule not in RULES:
            raise ValueError(f"mode is one of {MODES} and name_rule one of {RULES}")


def placed(cells: DataFrame, plan: DataFrame, options: MergeOptions) -> DataFrame:
    """plan with target, skip, rows, cols (what is taken of a sheet) and row_offset, col_offset; a row for each sheet."""
    filled = F.col("v").isNotNull() & (F.col("v") != "") | F.col("formula").isNotNull()
    size = lambda name, when: F.max(F.when(when, F.col(name))).cast("long").alias(name)
    full = cells.groupBy("sheet").agg(size("row", filled), size("col", filled), F.max("row").cast("long").alias("last_row"), F.max("col").cast("long").alias("last_col"))
    p = plan.join(full, "sheet", "left")
    whole = F.lit(not options.trim_edges)
    if options.mode == "sheets" and options.trim_edges:
        read = W.referenced_sheets(cells.where("formula IS NOT NULL"), plan.select("sheet")).select("sheet", F.lit(True).alias("_read"))
        p, whole = p.join(read, "sheet", "left"), F.coalesce("_read", F.lit(False))
    zero = F.lit(0).cast("long")
    p = p.withColumns({"rows": F.coalesce(F.when(whole, F.col("last_row")).otherwise(F.col("row")), zero), "cols": F.coalesce(F.when(whole, F.col("last_col")).otherwise(F.col("col")), zero)})
    first = F.col("ix") == F.min("ix").over(Window.partitionBy())  # a row for each sheet of a workbook
    skip = F.when(first, zero).otherwise(F.least(F.lit(max(0, int(options.skip_rows))).cast("long"), F.col("rows"))) if options.mode == "vertical" else zero
    p = p.withColumn("skip", skip)
    before = Window.orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    sums = {k: F.coalesce(F.sum(c).over(before), zero) if options.mode == m else zero for k, m, c in (("row_offset", "vertical", F.col("rows") - F.col("skip")), ("col_offset", "horizontal", F.col("cols")))}
    p = p.withColumns(sums)
    if options.mode != "sheets":
        return p.select("sheet", F.lit(MERGED).alias("target"), "skip", "rows", "cols", "row_offset", "col_offset")
    stem = T.strip_extension(F.coalesce("file", F.lit("")))
    name = {"file-sheet": F.concat(stem, F.lit("_"), "sheet"), "sheet-file": F.concat("sheet", F.lit("_"), stem), "sheet": F.col("sheet")}[options.name_rule]
    named = unique_names(p.select("sheet", "ix", F.lit(1).alias("book"), T.sheet_name(name).alias("base")), "book", "ix", "base")
    return p.join(named.select("sheet", F.col("name").alias("target")), "sheet").select("sheet", "target", "skip", "rows", "cols", "row_offset", "col_offset")


def combine(cells: DataFrame, plan: DataFrame, options: MergeOptions) -> tuple[DataFrame, DataFrame]:
    """cells(target, row, col, v, formula) of the result, and warnings(target, code, named), each once.

    Cells without content are no cells of the result. A formula's references move with their sheets. Sheets that have
    formulas, or that formulas of others read, keep their empty rows and columns, with a warning.
    """
    if "formula" not in cells.columns:
        cells = cells.withColumn("formula", F.lit(None).cast("string"))
    if options.values_only:
        cells = cells.withColumn("formula", F.lit(None).cast("string"))
    p = placed(cells, plan, options)
    at = cells.join(p, "sheet").where((F.col("row") > F.col("skip")) & (F.col("row") <= F.col("rows")) & (F.col("col") <= F.col("cols")))
    at = at.where("formula IS NOT NULL OR v <> ''").withColumns({"to_row": F.col("row") - F.col("skip") + F.col("row_offset"), "to_col": F.col("col") + F.col("col_offset")})
    names = "target string, code string, named string"
    warnings = cells.sparkSession.createDataFrame([], names)
    if options.values_only:
        out = at.select("target", F.col("to_row").alias("row"), F.col("to_col").alias("col"), "v", "formula")
    else:
        moves = p.select("sheet", "target", (F.col("row_offset") - F.col("skip")).alias("rows"), F.col("col_offset").alias("cols"))
        moved = formulas.shifted(at.where("formula IS NOT NULL").select("sheet", "row", "col", "formula"), moves)
        warnings = moved.join(p.select("sheet", "target"), "sheet").select("target", F.lit("REFERENCE_EXCLUDED").alias("code"), F.explode("excluded").alias("named")).distinct()
        new = moved.select("sheet", "row", "col", F.col("formula").alias("_new"))
        out = at.join(new, ["sheet", "row", "col"], "left").select("target", F.col("to_row").alias("row"), F.col("to_col").alias("col"), "v", F.col("_new").alias("formula"))
    if not (options.trim_rows or options.trim_columns):
        return out, warnings
    own = out.where("formula IS NOT NULL").select(F.col("target").alias("sheet"), "formula")
    read = W.referenced_sheets(own, p.select(F.col("target").alias("sheet")).distinct()).select(F.col("sheet").alias("target"), F.lit("TRIM_SKIPPED_REFERENCED").alias("code"))
    has = own.select(F.col("sheet").alias("target"), F.lit("TRIM_SKIPPED_FORMULA").alias("code")).distinct()
    kept = read.union(has.join(read, "target", "left_anti"))  # as many as sheets
    free = out.join(kept, "target", "left_anti").withColumnRenamed("target", "sheet")
    for axis, wanted in (("row", options.trim_rows), ("col", options.trim_columns)):
        if wanted:
            free = W.trim_gaps(free, axis, options.threshold)
    trimmed = free.select(F.col("sheet").alias("target"), "row", "col", "v", "formula")
    return out.join(kept, "target", "left_semi").union(trimmed), warnings.union(kept.select("target", "code", F.lit(None).cast("string")))
