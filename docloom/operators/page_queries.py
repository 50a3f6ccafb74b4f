"""Page layout: text items with places into lines, cells, columns and sheet rows.

Items come as a table (page, text, x, y, width, height), whatever program read them from the page. A page is one
small group; all pages are laid out in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.catalogue import query
from docloom.operators.text_queries import table
from docloom.session import ship

#: The least height of an item; parts of the height within which items stand in one band and on one
#: line; the gaps, in units and in parts of the height, that part words and cells; how near columns are one.
LEAST_HEIGHT, BAND, LINE, WORD_GAP, CELL_GAP, COLUMN = 8.0, 0.42, 0.45, (1.5, 0.18), (18.0, 1.8), 18.0
Item = tuple[str, float, float, float, float]  # text, x, y, width, height


def reading_order(items: list[Item]) -> list[Item]:
    """Items with text from top to bottom, and from left to right within a band."""
    own = [(t, x, y, w, max(h, LEAST_HEIGHT)) for t, x, y, w, h in items if t and t.strip()]

    def compare(a: Item, b: Item) -> float:
        return b[2] - a[2] if abs(b[2] - a[2]) > BAND * max(a[4], b[4]) else a[1] - b[1]

    return sorted(own, key=cmp_to_key(compare))


def page_lines(items: list[Item]) -> list[list[Item]]:
    """Lines from top to bottom: an item joins the first line whose first item stands about as high."""
    lines: list[list[Item]] = []
    for item in reading_order(items):
        near = (line for line in lines if abs(line[0][2] - item[2]) <= LINE * max(line[0][4], item[4]))
        line = next(near, None)
        lines.append([item]) if line is None else line.append(item)
    lines.sort(key=lambda line: -line[0][2])
    return [sorted(line, key=lambda item: item[1]) for line in lines]


def line_cells(line: list[Item]) -> tuple[str, list[tuple[str, float]]]:
    """A line's text, and its cells with their left ends: words part at small gaps, cells at wide ones."""
    text, cells = "", [["", line[0][1]]] if line else []
    for before, item in zip([None, *line], line):
        gap = 0.0 if before is None else item[1] - before[1] - before[3]
        tall = 10.0 if before is None else before[4]
        if gap > max(CELL_GAP[0], CELL_GAP[1] * tall) and cells[-1][0].strip():
            cells.append(["", item[1]])
        space = gap > max(WORD_GAP[0], WORD_GAP[1] * tall)
        text += (" " if space and text and text[-1] != " " else "") + item[0]
        own = cells[-1][0]
        cells[-1][0] = own + (" " if space and own and own[-1] != " " else "") + item[0]
    return text.strip(), [(t.strip(), x) for t, x in cells if t.strip()]


def columns(values: list[float]) -> list[float]:
    """Means of groups of values: from the least on, each joins the first group whose mean so far is near."""
    groups: list[list[float]] = []  # sum and count
    for v in sorted(values):
        own = next((g for g in groups if abs(g[0] / g[1] - v) <= COLUMN), None)
        if own is None:
            groups.append([v, 1])
        else:
            own[0] += v
            own[1] += 1
    return sorted(s / n for s, n in groups)


def page_grid(lines: list[tuple[str, list[tuple[str, float]]]]) -> list[list[str]]:
    """Sheet rows: each cell in the nearest column, a later one in place of an earlier; a line without cells is its text."""
    places = columns([x for _, cells in lines for _, x in cells])
    rows = []
    for text, cells in lines:
        if not cells:
            rows.append([text])
            continue
        row = [""] * len(places)
        for t, x in cells:
            row[min(range(len(places)), key=lambda k: (abs(places[k] - x), k))] = t
        rows.append(row)
    return rows


def laid_out(items: DataFrame, page: str) -> DataFrame:
    """items(page, text, x, y, width, height) -> page, line, text, cells, row (the cells by the page's columns).

    Items are brought together by page in the JVM, and many pages are laid out in one Arrow batch.
    """
    ship(items.sparkSession)
    kind = dict(items.dtypes)[page]
    fields = ("text", "x", "y", "width", "height")
    pages = items.groupBy(page).agg(F.collect_list(F.struct(*fields)).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, texts, cells, rows = [], [], [], [], []
            for i, own in enumerate(batch.column(1).to_pylist()):
                lines = [line_cells(line) for line in page_lines([tuple(x[f] for f in fields) for x in own])]
                at += [i] * len(lines)
                number += range(len(lines))
                texts += [t for t, _ in lines]
                cells += [[t for t, _ in c] for _, c in lines]
                rows += page_grid(lines)
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(texts, pa.string()), pa.array(cells, lists), pa.array(rows, lists)], [page, "line", "text", "cells", "row"])

    return pages.mapInArrow(run, f"`{page}` {kind}, line int, text string, cells array<string>, row array<string>")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a page: its lines' parts as items, four bands, 120 units apart from left to right."""
    d = table(spark, sf_dir, "lineitem")
    x = (F.col("l_linenumber") * 120.0 + F.col("l_partkey") % 5).alias("x")
    return d.select("l_orderkey", F.col("l_partkey").cast("string").alias("text"), x, ((F.col("l_suppkey") % 4) * -40.0 + F.col("l_partkey") % 3).alias("y"), F.lit(60.0).alias("width"), F.lit(12.0).alias("height"))


@query("page_layout")
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, cells and sheet rows of every page. No SQL: order and groups follow from what came before."""
    return laid_out(_items(spark, sf_dir), "l_orderkey").select("l_orderkey", "line", "text", F.size("cells").cast("long").alias("n_cells"), F.array_join("row", "|").alias("row"))


@query("page_line_count", "SELECT l_orderkey, CAST(count(DISTINCT l_suppkey % 4) AS BIGINT) AS n_lines FROM lineitem GROUP BY l_orderkey")
def page_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines the layout finds on each page: as many as bands that have an item."""
    return laid_out(_items(spark, sf_dir), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))


@query("page_subset", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)")
def page_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the pages asked for; a page asked for twice, or not there, changes nothing."""
    asked = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    asked = asked.union(asked.select(-F.col("l_orderkey") - 1)).union(asked)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(asked, "l_orderkey", "left_semi")


@query("recognition_targets", "SELECT l_orderkey, CAST(sum(length(CAST(l_partkey AS VARCHAR))) AS BIGINT) AS n_chars, sum(length(CAST(l_partkey AS VARCHAR))) < 8 AS wanted FROM lineitem GROUP BY l_orderkey")
def recognition_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that have too little text to do without recognition: under eight characters."""
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.length(F.col("l_partkey").cast("string"))).cast("long").alias("n_chars"))
    return pages.select("l_orderkey", "n_chars", (F.col("n_chars") < 8).alias("wanted"))


def recognised_lines(words: DataFrame, key: list[str]) -> DataFrame:
    """words(key..., text, x0, x1), a line per key -> key, text, cells: recognised words as items of height 12."""
    ship(words.sparkSession)
    kinds = dict(words.dtypes)
    listed = words.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))).alias("l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [line_cells([(w["text"], w["x0"], 0.0, w["x1"] - w["x0"], 12.0) for w in own]) for own in batch.column(len(key)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.array([t for t, _ in made], pa.string()), pa.array([[t for t, _ in c] for _, c in made], pa.list_(pa.string()))], [*key, "text", "cells"])

    return listed.select(*key, "l").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", text string, cells array<string>")
