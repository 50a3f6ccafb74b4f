"""Registered queries of what surrounds a workbook merge: names, ranges, statistics, warnings, list labels, CSV texts."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import scans
from docloom.operators import workbook as W
from docloom.operators.catalogue import query
from docloom.operators.table_queries import _grid
from docloom.operators.text_queries import table, unique_names
from docloom.session import ship


def shifted_ranges(skip: Column, rows: Column, cols: Column, row_offset: Column, col_offset: Column) -> dict[str, Column]:
    """Merged ranges r0, c0, r1, c1 (from zero) of a sheet at their place in the result (from one), clipped to its bounds.

    kept: whether the range starts within what is left of the sheet.
    """
    kept = (F.col("r0") >= skip) & (F.col("r1") >= skip) & (F.col("r0") - skip < rows) & (F.col("c0") < cols)
    return {
        "kept": kept,
        "top": F.col("r0") + 1 - skip + row_offset,
        "left": F.col("c0") + 1 + col_offset,
        "bottom": F.least(F.col("r1") + 1 - skip, rows) + row_offset,
        "right": F.least(F.col("c1") + 1, cols) + col_offset,
    }


@query("merge_ranges", """SELECT l_orderkey, l_linenumber, l_partkey, r0 - 1 + 100 AS top, c0 + 1 + 7 AS left_, least(r1 - 1, 9) + 100 AS bottom, least(c1 + 1, 12) + 7 AS right_
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 14 AS r0, l_suppkey % 15 AS c0, l_partkey % 14 + l_linenumber AS r1, l_suppkey % 15 + l_linenumber AS c1 FROM lineitem) WHERE r0 >= 2 AND r0 - 2 < 9 AND c0 < 12""")
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a sheet of 9 rows (two of them skipped) and 12 columns, moved by 100 rows and 7 columns."""
    r, c = F.col("l_partkey") % 14, F.col("l_suppkey") % 15
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r.alias("r0"), c.alias("c0"), (r + F.col("l_linenumber")).alias("r1"), (c + F.col("l_linenumber")).alias("c1"))
    out = shifted_ranges(F.lit(2), F.lit(9), F.lit(12), F.lit(100), F.lit(7))
    names = {"left": "left_", "right": "right_"}
    return d.where(out.pop("kept")).select("l_orderkey", "l_linenumber", "l_partkey", *[v.alias(names.get(k, k)) for k, v in out.items()])


@query("values_only", """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 2 = 0 THEN event_type WHEN event_id % 5 = 0 THEN NULL ELSE 'shown ' || event_type END AS v, CASE WHEN event_id % 3 = 0 THEN 'A' || event_id END AS formula FROM events""")
def values_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula cell as its stored result, else as the text it shows, else as nothing; other cells as they are."""
    k = F.col("event_id")
    d = table(spark, sf_dir, "events").select("event_id", F.when(k % 3 == 0, F.concat(F.lit("A"), k.cast("string"))).alias("formula"), F.when(k % 2 == 0, F.col("event_type")).alias("result"), F.when(k % 5 != 0, F.concat(F.lit("shown "), F.col("event_type"))).alias("shown"), k.cast("string").alias("own"))
    return d.select("event_id", F.when(F.col("formula").isNotNull(), F.coalesce("result", "shown")).otherwise(F.col("own")).alias("v"), "formula")


@query("trim_statistics", """WITH g AS (SELECT user_id, hour(ts) * 60 + minute(ts) + 1 AS row, day(ts) * 3 AS col FROM events WHERE value IS NOT NULL),
r AS (SELECT user_id, row - coalesce(lag(row) OVER (PARTITION BY user_id ORDER BY row), 0) - 1 AS gap FROM (SELECT DISTINCT user_id, row FROM g)),
c AS (SELECT user_id, col - coalesce(lag(col) OVER (PARTITION BY user_id ORDER BY col), 0) - 1 AS gap FROM (SELECT DISTINCT user_id, col FROM g))
SELECT CAST(user_id AS VARCHAR) AS sheet, CAST((SELECT coalesce(sum(gap), 0) FROM r WHERE r.user_id = u.user_id AND gap >= 3) AS BIGINT) AS n_rows, CAST((SELECT coalesce(sum(gap), 0) FROM c WHERE c.user_id = u.user_id AND gap >= 3) AS BIGINT) AS n_cols FROM (SELECT DISTINCT user_id FROM g) u""")
def trim_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns that trimming takes from each sheet: the last place before less the last place after."""
    cells = _grid(spark, sf_dir)
    before = W.bounds(cells)
    after = [W.trim_gaps(cells, axis, 3).groupBy("sheet").agg(F.max(axis).alias(f"{axis}s_left")) for axis in ("row", "col")]
    joined = before.join(after[0], "sheet").join(after[1], "sheet")
    return joined.select("sheet", (F.col("rows") - F.col("rows_left")).cast("long").alias("n_rows"), (F.col("cols") - F.col("cols_left")).cast("long").alias("n_cols"))


@query("distinct_warnings", "SELECT user_id, event_type AS warning, CAST(row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS BIGINT) AS seq FROM events GROUP BY user_id, event_type")
def distinct_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each warning of a job once, in the order of first mention; there are as many as kinds of warnings."""
    first = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("warning")).agg(F.min("event_id").alias("at"))
    return first.select("user_id", "warning", F.row_number().over(Window.partitionBy("user_id").orderBy("at")).cast("long").alias("seq"))


@query("sheet_catalogue", """SELECT p_brand AS file, p_type AS sheet, CASE WHEN n = 1 THEN substr(p_type, 1, 31) ELSE substr(p_type, 1, 31 - length(' (' || n || ')')) || ' (' || n || ')' END AS target
FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_brand) AS n FROM (SELECT DISTINCT p_brand, p_type FROM part))""")
def sheet_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets of several files side by side in one workbook, each under a name of its own."""
    d = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    d = d.select(F.lit(1).alias("book"), F.concat_ws("\t", "p_brand", "p_type").alias("ord"), F.substring("p_type", 1, 31).alias("base"), "p_brand", "p_type")
    return unique_names(d, "book", "ord", "base").select(F.col("p_brand").alias("file"), F.col("p_type").alias("sheet"), F.col("name").alias("target"))


def archive_names(d: DataFrame, bundle: str, order: str, file: str) -> DataFrame:
    """d with name: the file's name, or it with -2, -3 ... before its extension where it is taken (case counts)."""
    ship(d.sparkSession)
    schema = ", ".join(f"`{n}` {t}" for n, t in d.dtypes) + ", name string"

    def name(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        used: set[str] = set()
        names, reached = [], {}
        for f in group.column(file).to_pylist():
            if f is None:
                names.append(None)
                continue
            stem, dot, ext = f.rpartition(".")
            stem, ext = (stem, dot + ext) if stem else (f, "")
            n = reached.get(f, 1)
            made = f if n == 1 else f"{stem}-{n}{ext}"
            while made in used:
                n += 1
                made = f"{stem}-{n}{ext}"
            used.add(made)
            reached[f] = n
            names.append(made)
        return group.append_column("name", pa.array(names, pa.string()))

    return d.groupBy(bundle).applyInArrow(name, schema)


@query("archive_names", "SELECT p_partkey, CASE WHEN n = 1 THEN p_brand || '.csv' ELSE p_brand || '-' || n || '.csv' END AS name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_partkey // 100, p_brand ORDER BY p_partkey) AS n FROM part)")
def archive_names_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names in archives of up to a hundred files."""
    d = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("bundle"), "p_partkey", F.concat("p_brand", F.lit(".csv")).alias("file"))
    return archive_names(d, "bundle", "p_partkey", "file").select("p_partkey", "name")


@query("common_frame_rate", "SELECT l_orderkey, coalesce(max(CASE WHEN l_quantity * 6 - 30 > 0 AND l_quantity * 6 - 30 <= 240 THEN l_quantity * 6 - 30 END), 30) AS rate FROM lineitem GROUP BY l_orderkey")
def common_frame_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest valid frame rate of a group's clips, or 30."""
    rate = F.col("l_quantity") * 6 - 30
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.coalesce(F.max(F.when((rate > 0) & (rate <= 240), rate)), F.lit(30.0)).alias("rate"))


@query("catalogue_search", "SELECT p_brand AS category, CAST(count(*) AS BIGINT) AS n, min(p_name) AS first_name FROM part WHERE contains(lower(concat_ws(' ', p_brand, p_name, p_type)), 'e') AND p_size > 10 GROUP BY p_brand")
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that contain a text in any field, by category; categories without one are left out."""
    d = table(spark, sf_dir, "part").where("p_size > 10")
    hit = F.contains(F.lower(F.concat_ws(" ", "p_brand", "p_name", "p_type")), F.lit("e"))
    return d.where(hit).groupBy(F.col("p_brand").alias("category")).agg(F.count("*").alias("n"), F.min("p_name").alias("first_name"))


@query("layer_order", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey, l_quantity) AS BIGINT) AS place FROM lineitem")
def layer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect layers directly above the base, all else above them, each kind in its old order."""
    rank = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    order = Window.partitionBy("l_orderkey").orderBy(rank, "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(order).cast("long").alias("place"))


@query("page_sources", "SELECT o_orderkey, c_name AS source, CASE WHEN c_name IS NULL THEN 'SOURCE_MISSING' END AS error FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey")
def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each planned page with its source document; one that is not there is an error of its row."""
    sources = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select("c_custkey", "c_name")
    plan = table(spark, sf_dir, "orders").join(sources, F.col("o_custkey") == F.col("c_custkey"), "left")
    return plan.select("o_orderkey", F.col("c_name").alias("source"), F.when(F.col("c_name").isNull(), "SOURCE_MISSING").alias("error"))


@query("format_samples", "SELECT doc_id, array_to_string(list_transform(CASE WHEN n <= 64 THEN range(0, n) ELSE list_transform(range(0, 32), lambda i: CAST(floor(i * (n - 1) / 31.0::DOUBLE + 0.5) AS BIGINT)) END, lambda x: CAST(x AS VARCHAR)), ',') AS places FROM (SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents)")
def format_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places at which a text's format is looked at: all of up to 64, else 32 spread evenly."""
    n = F.length("text")
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.floor(i * (n - 1) / 31.0 + 0.5).cast("int"))
    places = F.when(n <= 64, every).otherwise(spread)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(n.isNotNull(), F.array_join(F.transform(places, lambda x: x.cast("string")), ",")).alias("places"))


@query("grid_transpose", "SELECT conv_id, n_cols, flat FROM (SELECT conv_id, CAST(max(len(w)) AS BIGINT) AS n_cols, string_agg(array_to_string(list_filter(w, lambda x: x <> ''), chr(9247)), ' | ' ORDER BY turn) AS flat FROM (SELECT conv_id, turn, string_split(coalesce(role, '') || ' ' || CAST(turn AS VARCHAR) || CASE WHEN turn % 2 = 0 THEN ' even' ELSE '' END, ' ') AS w FROM conversations) GROUP BY conv_id)")
def grid_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged rows of a small table flattened to text, by way of its padded transpose and back."""
    row = F.split(F.concat(F.coalesce("role", F.lit("")), F.lit(" "), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, " even").otherwise("")), " ")
    grids = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", row.alias("w")))).alias("l")).select("conv_id", F.transform("l", lambda x: x["w"]).alias("g"))
    there = grids.select("conv_id", transposed(F.col("g")).alias("g"))
    back = there.select("conv_id", F.size("g").cast("long").alias("n_cols"), F.transform(transposed(F.col("g")), lambda r: F.filter(r, lambda x: x != "")).alias("g"))
    return back.select("conv_id", "n_cols", F.array_join(F.transform("g", lambda r: F.array_join(r, "␟")), " | ").alias("flat"))


def transposed(grid: Column) -> Column:
    """Columns as rows; short rows are padded with the empty text."""
    width = F.aggregate(grid, F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(grid, lambda r: F.coalesce(F.get(r, i), F.lit(""))))


@query("revision_ids", "SELECT l_orderkey, CAST((SELECT max(l_partkey) FROM lineitem) + row_number() OVER (ORDER BY l_orderkey) AS BIGINT) AS revision FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 7)")
def revision_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ids after the greatest that is in use, for what refers to something: only that is copied."""
    d = table(spark, sf_dir, "lineitem")
    used = d.agg(F.max("l_partkey")).first()[0] or 0
    wanted = d.where("l_linenumber = 7").select("l_orderkey").distinct()
    n = 256  # ordinals by blocks of keys: counts of the blocks before, and a place within
    block = F.pmod(F.floor(F.col("l_orderkey") / n), F.lit(2**62))
    counts = wanted.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("far").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = counts.withColumn("far", F.floor(F.col("block") / n))
    lead = far.groupBy("far").agg(F.sum("n").alias("m")).withColumn("lead", F.coalesce(F.sum("m").over(Window.orderBy("far").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = far.join(lead, "far").select("block", (F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("lead")).alias("base"))
    own = wanted.withColumn("block", block).withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy("l_orderkey")))
    return own.join(base, "block").select("l_orderkey", (F.lit(used) + F.col("base") + F.col("r")).cast("long").alias("revision"))


FORMATS = [("%1.", "upperRoman", 1), ("%1.%2", "decimal", 1), ("%3)", "ganada", 1)]
_LIST_ITEMS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 3 AS level, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS pos FROM lineitem"


@query("list_labels", f"""WITH i AS ({_LIST_ITEMS}), w AS (SELECT *, sum(CAST(level < 1 AS INT)) OVER o AS g1, sum(CAST(level < 2 AS INT)) OVER o AS g2, sum(CAST(level = 0 AS INT)) OVER o AS c0, first_value(level) OVER o > 0 AS d0 FROM i WINDOW o AS (PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, sum(CAST(level = 1 AS INT)) OVER o AS c1, coalesce(first_value(CASE WHEN level > 0 THEN level END IGNORE NULLS) OVER o, 0) > 1 AS d1 FROM w WINDOW o AS (PARTITION BY l_orderkey, g1 ORDER BY pos ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, sum(CAST(level = 2 AS INT)) OVER (PARTITION BY l_orderkey, g2 ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c2 FROM x),
z AS (SELECT *, CAST(greatest(c0 + CAST(d0 AS INT), 1) AS INT) AS n0, CAST(greatest(c1 + CAST(d1 AS INT), 1) AS INT) AS n1, CAST(greatest(c2, 1) AS INT) AS n2 FROM y)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(level AS INT) AS level, CASE level WHEN 0 THEN ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII', 'XIII', 'XIV', 'XV'][n0] || '.' WHEN 1 THEN ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII', 'XIII', 'XIV', 'XV'][n0] || '.' || n1 ELSE substr('가나다라마바사아자차카타파하', n2, 1) || ')' END AS label FROM z""")
def list_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the lines of orders as lists of three levels."""
    own = F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("list"), own.alias("pos"), (F.col("l_partkey") % 3).cast("int").alias("level"), "l_linenumber", "l_partkey", "l_suppkey")
    return scans.list_labels(d, FORMATS).select(F.col("list").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "level", "label")


@query("coalesced_events", """WITH e AS (SELECT CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id END AS key, event_id, event_type AS value FROM events),
s AS (SELECT *, CASE WHEN value IS NOT DISTINCT FROM lag(value) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS start FROM e WINDOW w AS (PARTITION BY key ORDER BY event_id)),
g AS (SELECT *, sum(start) OVER (PARTITION BY key ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT key, min(event_id) AS first, max(event_id) AS last, any_value(value) AS value, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY key, g""")
def coalesced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one type that follow each other as one row; half of all users are one key."""
    key = F.when(F.col("user_id") % 2 == 0, 0).otherwise(F.col("user_id"))
    return scans.coalesced(table(spark, sf_dir, "events").withColumn("key", key), "key", "event_id", "event_type")


def csv_table(text: str) -> tuple[list[str], list[list[str]], int]:
    """Headers, rows and how many rows had another width. A quote that never ends, or ends within a field, is an error."""
    reader = csv.reader(io.StringIO(text, newline=""), strict=True)
    kept = (row for row in reader if any(x.strip() for x in row))
    headers = [h.strip() or f"Column {i}" for i, h in enumerate(next(kept, []), 1)]
    rows, odd = [], 0
    for row in kept:
        odd += len(row) != len(headers)
        rows.append((row + [""] * len(headers))[: len(headers)])
    return headers, rows, odd


def read_csv_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, row, header, v, odd_rows, error: the cells of a CSV text per row; a faulty text gives one row with its error."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                try:
                    headers, rows, odd = csv_table(t or "")
                    cells = [(n, h, v, odd, None) for n, row in enumerate(rows) for h, v in zip(headers, row)]
                except csv.Error as e:
                    cells = [(None, None, None, None, str(e))]
                at += [i] * len(cells)
                made += cells
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string())
            columns = [pa.array([x[k] for x in made], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], [key, "row", "header", "v", "odd_rows", "error"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, row int, header string, v string, odd_rows int, error string")


@query("csv_convert", """WITH n AS (SELECT n_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r FROM nation WHERE n_regionkey <> 3)
SELECT n_regionkey, CAST(r AS INT) AS row, h AS header, CASE h WHEN 'name' THEN coalesce(n_name, '') || ', "' || n_nationkey || '"' WHEN 'Column 2' THEN CASE WHEN r = 1 THEN '' ELSE CAST(n_nationkey AS VARCHAR) END ELSE CASE WHEN r = 1 THEN '' ELSE 'x' END END AS v, CAST(1 AS INT) AS odd_rows, CAST(NULL AS VARCHAR) AS error FROM n, (VALUES ('name'), ('Column 2'), ('last')) h(h)
UNION ALL SELECT 3, NULL, NULL, NULL, NULL, 'unexpected end of data'""")
def csv_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV text for each region: quoted names, a header without a name, a blank line, a short row; one text never ends its quote."""
    r = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    line = F.concat(F.lit('"'), F.coalesce("n_name", F.lit("")), F.lit(', ""'), F.col("n_nationkey").cast("string"), F.lit('"""'), F.when(F.col("r") == 1, "").otherwise(F.concat(F.lit(","), F.col("n_nationkey").cast("string"), F.lit(",x"))))
    d = table(spark, sf_dir, "nation").withColumn("r", r).select("n_regionkey", F.struct("r", line.alias("t")).alias("s"))
    text = F.concat(F.lit("name, ,last\n  \n"), F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["t"]), "\n"))
    texts = d.groupBy("n_regionkey").agg(text.alias("t")).withColumn("t", F.when(F.col("n_regionkey") == 3, F.concat("t", F.lit('\n"open'))).otherwise(F.col("t")))
    return read_csv_texts(texts, "n_regionkey", "t")
