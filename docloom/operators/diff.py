"""Document and table comparison: pair-wise Arrow batches for sequences, joins and expressions for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import ship

KINDS = ("added", "deleted", "changed", "format", "unchanged")


def classify(before: Column, after: Column, before_format: Column | None = None, after_format: Column | None = None) -> Column:
    """The kind of change of one item; null stands for no item."""
    kind = F.when(before.isNull() & after.isNull(), None).when(before.isNull(), "added").when(after.isNull(), "deleted").when(before != after, "changed")
    if before_format is not None:
        kind = kind.when(~before_format.eqNullSafe(after_format), "format")
    return kind.otherwise("unchanged")


def summary(changes: DataFrame, *keys: str) -> DataFrame:
    """Counts of every kind, zero where there is none."""
    return changes.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])


def _pairwise(pairs: DataFrame, keys: list[str], f, out: str) -> DataFrame:
    """f(before, after) -> rows; pairs(keys..., before, after). Pairs with equal texts don't reach Python batches large."""
    ship(pairs.sparkSession)
    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.select(*keys).dtypes) + ", " + out
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, after = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
            for a in range(0, batch.num_rows, 64):  # output stays small whatever the texts
                index, rows = [], []
                for i in range(a, min(a + 64, batch.num_rows)):
                    for row in f(before[i] or "", after[i] or ""):
                        index.append(i)
                        rows.append(row)
                if not rows:
                    continue
                own = [batch.column(k).take(pa.array(index)) for k in range(n)]
                names = [x.strip().split(" ")[0] for x in out.split(",")]
                kinds = {"int": pa.int32(), "string": pa.string()}
                made = [pa.array([r[k] for r in rows], kinds[x.strip().split(" ")[1]]) for k, x in enumerate(out.split(","))]
                yield pa.RecordBatch.from_arrays(own + made, keys + names)

    return pairs.select(*keys, "before", "after").mapInArrow(run, schema)


def token_segments(pairs: DataFrame, keys: list[str], method: str = "ratio") -> DataFrame:
    """keys, seq, type, text of the token diff of every pair(keys, before, after)."""
    from docloom.functions.align import diff_tokens

    def rows(a, b):
        return [(i, t, x) for i, (t, x) in enumerate(diff_tokens(a, b, method))]

    return _pairwise(pairs, keys, rows, "seq int, type string, text string")


def paragraph_changes(pairs: DataFrame, keys: list[str], method: str = "ratio") -> DataFrame:
    """keys, seq, kind, before, after of every pair's lines."""
    from docloom.functions.align import compare

    def rows(a, b):
        return [(i, *x) for i, x in enumerate(compare(a.split("\n"), b.split("\n"), method))]

    return _pairwise(pairs, keys, rows, "seq int, kind string, before string, after string")


def side(segments: DataFrame, which: str) -> DataFrame:
    """The segments of one side: what is equal and what only that side has."""
    return segments.where(F.col("type").isin("equal", {"before": "deleted", "after": "added"}[which]))


def table_changes(before: DataFrame, after: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Cells(row, col, v) of two tables by given axis pairs (b, a), either null: b_row, b_col, a_row, a_col, kind."""
    place = rows.select(F.col("b").alias("b_row"), F.col("a").alias("a_row"))
    x = before.join(place, F.col("row") == F.col("b_row"), "left").join(cols.select(F.col("b").alias("b_col"), F.col("a").alias("a_col")), F.col("col") == F.col("b_col"), "left")
    x = x.select(F.col("row").alias("b_row"), F.col("col").alias("b_col"), "a_row", "a_col", F.col("v").alias("x"))
    y = after.select(F.col("row").alias("y_row"), F.col("col").alias("y_col"), F.col("v").alias("y"))
    both = x.join(y, (F.col("a_row") == F.col("y_row")) & (F.col("a_col") == F.col("y_col")), "full")
    return both.select("b_row", "b_col", F.coalesce("a_row", "y_row").alias("a_row"), F.coalesce("a_col", "y_col").alias("a_col"), classify(F.col("x"), F.col("y")).alias("kind"))
