"""Documents against documents: paragraphs, tables and comments, and the frames of a report."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import documents as C
from docloom.operators import diff as D
from docloom.operators.catalogue import query
from docloom.operators.diff_queries import _changes
from docloom.operators.text_queries import table
from docloom.session import ship
from docloom.sources.office import workbook

#: A document's blocks in order: a paragraph has a text, a table has cells.
BLOCKS = "pos int, text string, cells array<array<string>>"
CHANGES = "seq int, section string, kind string, table_ix int, b_row int, b_col int, a_row int, a_col int, before string, after string"


def document_changes(before: DataFrame, after: DataFrame, key: str, method: str = "ratio") -> DataFrame:
    """(key, pos, text, cells) of both sides -> key and the changes of every pair; a document without partner is all new or all gone.

    One pair of documents is one task's work; all pairs are compared in parallel.
    """
    ship(before.sparkSession)
    kind = dict(before.dtypes)[key]

    def blocks(side: pa.Table) -> list:
        rows = sorted(side.column("block").to_pylist(), key=lambda b: b["pos"])
        return [b["text"] or "" if b["cells"] is None else [[x or "" for x in r or []] for r in b["cells"]] for b in rows]

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        names = [x.strip().split(" ")[0] for x in CHANGES.split(",")]
        rows = [(i, *x) for i, x in enumerate(C.compare_documents(blocks(a), blocks(b), method))]
        kinds = [pa.int32() if x.strip().endswith(" int") else pa.string() for x in CHANGES.split(",")]
        own = (a if a.num_rows else b).column(key)
        made = pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        return made.add_column(0, key, pa.array(own.to_pylist()[:1] * len(rows), own.type))

    columns = [key, F.struct("pos", "text", "cells").alias("block")]
    return before.select(*columns).groupBy(key).cogroup(after.select(*columns).groupBy(key)).applyInArrow(compare, f"`{key}` {kind}, {CHANGES}")


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as documents: a paragraph for each turn, then a table of them; after: a turn lost, a row and a column added."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role")
    paragraphs = c.select("conv_id", F.col("turn").cast("int").alias("pos"), "text", F.lit(None).cast("array<array<string>>").alias("cells"))
    cell = F.array(F.concat(F.lit("turn "), F.col("turn").cast("string")), F.concat(F.col("role"), F.lit(" "), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")))
    rows = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", cell.alias("c")))), lambda x: x["c"]).alias("cells"))
    wide = F.concat(F.array(F.array(F.lit("new a"), F.lit("new b"), F.lit("new c"))), F.transform("cells", lambda r: F.concat(F.slice(r, 1, 1), F.array(F.lit("in between")), F.slice(r, 2, 1))))
    as_block = lambda cells: rows.select("conv_id", F.lit(1_000_000).alias("pos"), F.lit(None).cast("string").alias("text"), cells.alias("cells"))
    return paragraphs.union(as_block(F.col("cells"))), paragraphs.where("pos <> 1").union(as_block(wide))


@query("document_changes")
def document_changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents compared. No SQL: which paragraphs belong together is found by similarity."""
    return document_changes(*_documents(spark, sf_dir), "conv_id")


@query("table_alignment", "SELECT conv_id, CAST(3 * (n + 1) - 2 * n AS BIGINT) AS added, CAST(0 AS BIGINT) AS deleted, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS format, CAST(2 * n AS BIGINT) AS unchanged FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def table_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a table that got a row on top and a column in the middle: all old cells find themselves again."""
    before, after = (d.where("cells IS NOT NULL") for d in _documents(spark, sf_dir))
    return D.summary(document_changes(before, after, "conv_id"), "conv_id")


@query("comment_matches")
def comment_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as comments against an edited list of them: by id, else by likeness and author. No SQL: choices depend on those before."""
    ship(spark)
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), F.col("role").alias("author"), "text")
    after = c.where("turn % 4 <> 1").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).otherwise("").alias("id"), "author", F.concat("text", F.lit(" (edited)")).alias("text"))
    before = c.select("conv_id", "turn", F.col("turn").cast("string").alias("id"), "author", "text")

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("turn"), b.sort_by("turn")
        sides = [list(zip(*(t.column(n).to_pylist() for n in ("id", "author", "text")))) for t in (a, b)]
        pairs = C.match_comments(*sides)
        turns = [t.column("turn").to_pylist() for t in (a, b)]
        made = {n: pa.array([None if p[s] is None else turns[s][p[s]] for p in pairs], pa.int32()) for s, n in enumerate(("before_turn", "after_turn"))}
        own = (a if a.num_rows else b).column("conv_id")
        return pa.table({"conv_id": pa.array(own.to_pylist()[:1] * len(pairs), own.type), **made})

    return before.groupBy("conv_id").cogroup(after.groupBy("conv_id")).applyInArrow(match, "conv_id long, before_turn int, after_turn int")


def report_frames(changes: DataFrame, before: str, after: str) -> tuple[DataFrame, DataFrame]:
    """changes(section, location, before, after, kind) -> the report's summary (label, value) and its changes outside tables."""
    counts = D.summary(changes)
    shown = [("Added", "added"), ("Deleted", "deleted"), ("Content changed", "changed"), ("Formatting changed", "format")]
    rows = F.array(F.struct(F.lit("Before").alias("label"), F.lit(before).alias("value")), F.struct(F.lit("After").alias("label"), F.lit(after).alias("value")), *[F.struct(F.lit(n).alias("label"), F.col(k).cast("string").alias("value")) for n, k in shown])
    return counts.select(F.explode(rows).alias("r")).select("r.label", "r.value"), changes.where("section <> 'table' AND kind <> 'unchanged'")


def report_workbook(changes: DataFrame, before: str, after: str, tables: DataFrame | None = None) -> bytes:
    """A report of one comparison as XLSX: summary, changes, and a sheet for each table (table_ix, kind, before, after).

    For one pair of documents, whose changes fit a sheet.
    """
    summary, listed = report_frames(changes, before, after)
    sheets = {"Summary": [["Item", "Value"], *[list(r) for r in summary.collect()], ["Deletion mark", "Blue strikethrough"], ["Insertion mark", "Bold red"]]}
    sheets["Changes"] = [["Section", "Location", "Before", "After", "Change type"], *[list(r) for r in listed.select("section", "location", "before", "after", "kind").collect()]]
    if tables is not None:
        for r in tables.orderBy("table_ix", "seq").collect():
            sheets.setdefault(f"Table {r['table_ix'] + 1}", [["Change type", "Before", "After"]]).append([r["kind"], r["before"], r["after"]])
    return workbook(sheets)


@query("diff_report", """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v, o_orderpriority AS f FROM orders WHERE o_orderkey % 97 <> 0),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 97 = 1 THEN lower(o_orderstatus) ELSE o_orderstatus END AS v, CASE WHEN o_orderkey % 97 = 2 THEN 'x' ELSE o_orderpriority END AS f FROM orders WHERE o_orderkey % 97 <> 3),
c AS (SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' WHEN a.v <> b.v THEN 'changed' WHEN a.f IS DISTINCT FROM b.f THEN 'format' ELSE 'unchanged' END AS kind FROM a FULL JOIN b ON a.k = b.k)
SELECT 'Before' AS label, 'old' AS value UNION ALL SELECT 'After', 'new' UNION ALL SELECT label, CAST((SELECT count(*) FROM c WHERE kind = k) AS VARCHAR) FROM (VALUES ('Added', 'added'), ('Deleted', 'deleted'), ('Content changed', 'changed'), ('Formatting changed', 'format')) t(label, k)""")
def diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary frame of a report over two snapshots of orders."""
    changes = _changes(spark, sf_dir).select(F.lit("body").alias("section"), F.col("o_orderkey").cast("string").alias("location"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"), "kind")
    return report_frames(changes, "old", "new")[0]


@query("record_keys", "SELECT doc_id, key, CAST(count(*) OVER (PARTITION BY key) AS BIGINT) AS holders FROM (SELECT doc_id, md5(coalesce(text, '') || chr(31) || coalesce(lang, '') || chr(31) || 'comments:' || coalesce(source, '')) AS key FROM documents)")
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes two records the same: text, format (a document's language here) and comments (its source); nulls are empty."""
    key = F.md5(F.concat(F.coalesce("text", F.lit("")), F.lit("\x1f"), F.coalesce("lang", F.lit("")), F.lit("\x1fcomments:"), F.coalesce("source", F.lit(""))))
    d = table(spark, sf_dir, "documents").select("doc_id", key.alias("key"))
    holders = d.groupBy("key").agg(F.count("*").alias("holders"))
    return d.join(holders, "key").select("doc_id", "key", "holders")


@query("unmatched_remainder", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def unmatched_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left without a partner."""
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
