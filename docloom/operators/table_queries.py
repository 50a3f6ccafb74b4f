"""Registered queries of the tabular, workbook and lookup operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.ranges import SHEET_COLUMNS, SHEET_ROWS, bounded, ordinals
from docloom.operators import workbook as W
from docloom.operators.catalogue import query
from docloom.operators.text_queries import table

_AS_TEXT = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"
_NATION = "n_nationkey string, n_name string, n_regionkey string"


@query("csv_roundtrip", _AS_TEXT)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    options = {"escape": '"', "emptyValue": ""}
    line = F.to_csv(F.struct(*[F.col(c).cast("string") for c in n.columns]), options)
    return n.select(F.from_csv(line, _NATION, {"escape": '"'}).alias("r")).select("r.*")


@query("csv_preserve_text", "SELECT * FROM (VALUES (0, '00123'), (1, '2026-08-15'), (2, '1e3'), (3, 'TRUE'), (4, '#N/A'), (5, '9007199254740993'), (6, NULL)) t(i, v)")
def csv_preserve_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No type is inferred; the empty text becomes null."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(("00123", "2026-08-15", "1e3", "TRUE", "#N/A", "9007199254740993", '""'))], "i int, line string")
    return rows.select("i", F.nullif(F.from_csv("line", "v string", {"escape": '"', "emptyValue": ""})["v"], F.lit("")).alias("v"))


@query("json_objects_scan", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_objects_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>")["k"].alias("k"))


@query("json_key_union", """SELECT key, CAST(row_number() OVER (ORDER BY min(event_id * 10 + i)) - 1 AS INT) AS ord FROM (SELECT event_id, unnest(['k', 'x' || event_id % 7, coalesce(event_type, '-')]) AS key, unnest([0, 1, 2]) AS i FROM events) GROUP BY key""")
def json_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all objects in the order they are first seen; there are as many as a sheet has columns, at most."""
    t = F.concat(F.lit('{"k": 1, "x'), (F.col("event_id") % 7).cast("string"), F.lit('": 2, "'), F.coalesce("event_type", F.lit("-")), F.lit('": 3}'))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("r"), t.alias("props"))
    keys = e.select("r", F.posexplode(F.json_object_keys("props")).alias("i", "key")).groupBy("key").agg(F.min(F.struct("r", "i")).alias("at"))
    return bounded(keys, SHEET_COLUMNS, "keys").select("key", (F.row_number().over(Window.orderBy("at")) - 1).alias("ord"))


@query("json_array_rows", "SELECT event_id, CAST(n AS BIGINT) AS width, CASE WHEN n > 1 THEN CAST(event_id AS VARCHAR) ELSE '' END AS second FROM (SELECT event_id, event_id % 3 + 1 AS n FROM events)")
def json_array_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('["x"'), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit(", "), F.col("event_id").cast("string"))).otherwise(""), F.when(F.col("event_id") % 3 > 1, ", null").otherwise(""), F.lit("]"))
    d = table(spark, sf_dir, "events").select("event_id", F.from_json(text, "array<string>").alias("a"))
    return d.select("event_id", F.size("a").cast("long").alias("width"), F.coalesce(F.get("a", F.lit(1)), F.lit("")).alias("second"))


@query("json_serialize", """SELECT r_regionkey, '{"r_regionkey":"' || r_regionkey || '","r_name":"' || r_name || '"}' AS json FROM region""")
def json_serialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_regionkey").cast("string").alias("r_regionkey"), "r_name")).alias("json"))


def to_html(df: DataFrame, order: str) -> DataFrame:
    """One row (html): the table as markup. A table has as many rows as a sheet, at most."""
    bounded(df, SHEET_ROWS, "rows")
    cell = lambda tag, c: F.concat(F.lit(f"<{tag}>"), T.escape_html(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))
    row = F.concat(F.lit("<tr>"), *[cell("td", F.col(c).cast("string")) for c in df.columns], F.lit("</tr>"))
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>"
    body = df.select(F.struct(F.col(order).alias("o"), row.alias("r")).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("l"))
    return body.select(F.concat(F.lit(f"<table><thead>{head}</thead><tbody>"), F.array_join(F.transform("l", lambda x: x["r"]), ""), F.lit("</tbody></table>")).alias("html"))


def html_rows(html: DataFrame) -> DataFrame:
    """html -> row (from zero), cells: texts of all rows of all tables, tags stripped, entities decoded."""
    rows = html.select(F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "r"))
    plain = lambda c: T.decode_html(T.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), "<[^>]*>", "")))
    return rows.select("row", F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), plain).alias("cells"))


@query("html_table_roundtrip", _AS_TEXT.replace("n_name,", "coalesce(n_name, '') AS n_name,"))
def html_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    rows = html_rows(to_html(n, "n_nationkey")).where("row > 0")
    return rows.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(n.columns)])


def _sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    both = W.cells(table(spark, sf_dir, "nation"), "nation", ["n_nationkey"]).union(W.cells(table(spark, sf_dir, "region"), "region", ["r_regionkey"]))
    return both, spark.createDataFrame([("nation", 0), ("region", 1)], "sheet string, ix int")


_cells_sql = """WITH a AS (SELECT row_number() OVER (ORDER BY n_nationkey) + 1 AS r, CAST(n_nationkey AS VARCHAR) AS x, n_name AS y, CAST(n_regionkey AS VARCHAR) AS z FROM nation UNION ALL SELECT 1, 'n_nationkey', 'n_name', 'n_regionkey'),
b AS (SELECT row_number() OVER (ORDER BY r_regionkey) + 1 AS r, CAST(r_regionkey AS VARCHAR) AS x, r_name AS y FROM region UNION ALL SELECT 1, 'r_regionkey', 'r_name'),
c AS (SELECT 'nation' AS sheet, r, 1 AS c, x AS v FROM a UNION ALL SELECT 'nation', r, 2, y FROM a UNION ALL SELECT 'nation', r, 3, z FROM a UNION ALL SELECT 'region', r, 1, x FROM b UNION ALL SELECT 'region', r, 2, y FROM b)"""


@query("merge_vertical", _cells_sql + " SELECT sheet, CAST(CASE sheet WHEN 'nation' THEN r ELSE r - 1 + (SELECT max(r) FROM a) END AS BIGINT) AS row, CAST(c AS BIGINT) AS col, v FROM c WHERE sheet = 'nation' OR r > 1")
def merge_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, plan = _sheets(spark, sf_dir)
    return W.merge(cells, plan, "vertical", 1)


@query("merge_horizontal", _cells_sql + " SELECT sheet, CAST(r AS BIGINT) AS row, CAST(CASE sheet WHEN 'nation' THEN c ELSE c + 3 END AS BIGINT) AS col, v FROM c")
def merge_horizontal(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, plan = _sheets(spark, sf_dir)
    return W.merge(cells, plan, "horizontal")


@query("sheet_bounds", _cells_sql + " SELECT sheet, CAST(max(r) AS BIGINT) AS n_rows, CAST(max(c) AS BIGINT) AS n_cols FROM c WHERE v <> '' GROUP BY sheet")
def sheet_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = _sheets(spark, sf_dir)
    return W.bounds(cells).select("sheet", F.col("rows").cast("long").alias("n_rows"), F.col("cols").cast("long").alias("n_cols"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each user, events by minute of the day and day of the month: a sparse grid with gaps."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return e.select(F.col("user_id").cast("string").alias("sheet"), (F.hour("ts") * 60 + F.minute("ts") + 1).alias("row"), (F.dayofmonth("ts") * 3).alias("col"), F.col("value").cast("string").alias("v"))


def _trim_query(name: str, axis: str, other: str, least: int) -> None:
    sql = f"""WITH g AS (SELECT CAST(user_id AS VARCHAR) AS sheet, hour(ts) * 60 + minute(ts) + 1 AS row, day(ts) * 3 AS col, event_id FROM events WHERE value IS NOT NULL),
    u AS (SELECT DISTINCT sheet, {axis} AS p FROM g), m AS (SELECT sheet, p, p - coalesce(lag(p) OVER (PARTITION BY sheet ORDER BY p), 0) - 1 AS gap FROM u),
    r AS (SELECT sheet, p, sum(CASE WHEN gap >= {least} THEN gap ELSE 0 END) OVER (PARTITION BY sheet ORDER BY p) AS gone FROM m)
    SELECT g.sheet, CAST(g.{axis} - r.gone AS BIGINT) AS place, CAST(count(*) AS BIGINT) AS n FROM g JOIN r ON g.sheet = r.sheet AND g.{axis} = r.p GROUP BY ALL"""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = W.trim_gaps(_grid(spark, sf_dir), axis, least)
        return t.groupBy("sheet", F.col(axis).cast("long").alias("place")).agg(F.count("*").alias("n"))


_trim_query("sheet_trim_rows", "row", "col", 3)
_trim_query("sheet_trim_cols", "col", "row", 2)


@query("sheet_position_grammar", """SELECT o_orderkey, array_to_string(list_transform(CASE o_orderkey % 4 WHEN 0 THEN [k] WHEN 1 THEN range(1, k + 1) WHEN 2 THEN range(k, 11) ELSE list_concat(range(7, k - 1, -1), [1]) END, lambda x: CAST(x AS VARCHAR)), ',') AS positions FROM (SELECT o_orderkey, o_orderkey % 5 + 2 AS k FROM orders)""")
def sheet_position_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("o_orderkey") % 5 + 2).cast("string")
    m = F.col("o_orderkey") % 4
    pattern = F.when(m == 0, F.concat(k, F.lit(", x, 99"))).when(m == 1, F.concat(F.lit("-"), k)).when(m == 2, F.concat(k, F.lit("-"))).otherwise(F.concat(F.lit("7-"), k, F.lit(",1,7")))
    d = table(spark, sf_dir, "orders").select("o_orderkey", W.parse_positions(pattern, F.lit(10)).alias("p"))
    return d.select("o_orderkey", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("positions"))


@query("page_range_errors", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'EMPTY' WHEN 1 THEN 'SYNTAX' WHEN 2 THEN 'BOUNDS' END AS error FROM orders")
def page_range_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in (" , ", "1, -", "3-11", "7-4, 2", "-3, 5-")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", W.page_range_error(said, F.lit(10)).alias("error"))


@query("range_format", """WITH d AS (SELECT DISTINCT l_suppkey AS k, l_partkey % 12 + 1 AS p FROM lineitem), i AS (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS g FROM d), r AS (SELECT k, min(p) AS a, max(p) AS b FROM i GROUP BY k, g)
SELECT k AS l_suppkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY k""")
def range_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.format_ranges(table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 12 + 1).alias("p")), "l_suppkey", "p")


@query("sheet_reference_semijoin", "SELECT n_name AS sheet FROM nation WHERE n_name IS NOT NULL AND n_nationkey IN (SELECT (n_nationkey + 3) % 25 FROM nation WHERE n_nationkey % 4 < 2)")
def sheet_reference_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sheets; half of them hold formulas that name the third next, quoted or plain, and themselves."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("sheet"))
    target = n.select((F.pmod(F.col("n_nationkey") - 3, F.lit(25))).alias("n_nationkey"), F.col("sheet").alias("t"))
    f = n.where("n_nationkey % 4 < 2").join(target, "n_nationkey")
    own = F.coalesce("sheet", F.lit("-"))
    quoted = F.concat(F.lit("SUM('"), F.lower("t"), F.lit("'!A1:A5)+'"), own, F.lit("'!B2"))
    return W.referenced_sheets(f.select(own.alias("sheet"), quoted.alias("formula")), n.select("sheet"))


@query("case_insensitive_lookup", """WITH asked AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, coalesce(e.n_nationkey, l.k) AS n_nationkey FROM asked LEFT JOIN nation e ON e.n_name = name LEFT JOIN (SELECT lower(n_name) AS ln, min(n_nationkey) AS k FROM nation GROUP BY 1) l ON l.ln = lower(name)""")
def case_insensitive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By exact name, else by the first name that is equal without case."""
    n = table(spark, sf_dir, "nation")
    asked = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"))
    exact = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("a"))
    loose = n.groupBy(F.lower("n_name").alias("lname")).agg(F.min("n_nationkey").alias("b"))
    found = asked.join(exact, "name", "left").join(loose, F.lower("name") == F.col("lname"), "left")
    return found.select("s_suppkey", F.coalesce("a", "b").alias("n_nationkey"))


@query("ordered_pairing", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) SELECT a.lang, CAST(a.n AS BIGINT) AS n, a.doc_id AS before_id, b.doc_id AS after_id FROM (SELECT lang, doc_id, (n + 1) // 2 AS n FROM r WHERE n % 2 = 1) a FULL JOIN (SELECT lang, doc_id, n // 2 AS n FROM r WHERE n % 2 = 0) b ON a.lang = b.lang AND a.n = b.n WHERE a.n IS NOT NULL")
def ordered_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First with second, third with fourth of each language: an equi-join on the ordinal."""
    r = ordinals(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id")
    a = r.where("n % 2 = 1").select("lang", F.floor((F.col("n") + 1) / 2).alias("n"), F.col("doc_id").alias("before_id"))
    b = r.where("n % 2 = 0").select("lang", F.floor(F.col("n") / 2).alias("n"), F.col("doc_id").alias("after_id"))
    return a.join(b, ["lang", "n"], "left")


@query("lookup_last_wins", "SELECT c_custkey, k AS o_orderkey, round(p, 2) AS price FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey AS k, o_totalprice AS p FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1) ON c_custkey = o_custkey")
def lookup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several entries under a key the last written counts: the latest order of each customer."""
    written = F.struct("o_orderdate", "o_orderkey")
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), written).alias("o"))
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o.o_orderkey", F.round("o.o_totalprice", 2).alias("price"))


@query("group_export", "SELECT p_brand, part, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS pages FROM (SELECT p_brand, p_partkey, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 500 AS BIGINT) AS part FROM part) GROUP BY p_brand, part")
def group_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each group in order, in parts of 500, so that a large group is no task's alone."""
    pages = F.array_join(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",")
    d = ordinals(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", "place")
    return d.groupBy("p_brand", F.floor((F.col("place") - 1) / 500).alias("part")).agg(F.count("*").alias("n"), pages.alias("pages"))


@query("page_membership", "SELECT p_size AS page, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS groups FROM part GROUP BY p_size")
def page_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("page")).agg(F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("groups"))


@query("named_range_validation", "SELECT p_partkey, CASE WHEN p_name IS NULL OR trim(p_name) = '' THEN 'BLANK' WHEN count(*) OVER (PARTITION BY lower(replace(p_name, '/', '_'))) > 1 THEN 'DUPLICATE' END AS error FROM part")
def named_range_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = T.safe_file_name(F.col("p_name"))
    blank = name.isNull() | (T.trim(name) == "")
    twice = F.count("*").over(Window.partitionBy(F.lower(name))) > 1
    return table(spark, sf_dir, "part").select("p_partkey", F.when(blank, "BLANK").when(twice, "DUPLICATE").alias("error"))


@query("concat_progress", "SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_quantity) OVER w / sum(l_quantity) OVER (PARTITION BY l_orderkey), 9) AS done FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING)")
def concat_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = Window.partitionBy("l_orderkey")
    upto = whole.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.sum("l_quantity").over(upto) / F.sum("l_quantity").over(whole), 9).alias("done"))


@query("passthrough_estimate", "SELECT l_orderkey, CAST(sum(l_extendedprice * 1000 * l_discount * 10) AS BIGINT) AS bytes, sum(l_extendedprice * 1000 * l_discount * 10) > 1610612736 AS blocked FROM (SELECT l_orderkey, round(l_extendedprice) AS l_extendedprice, round(l_discount * 100) / 1000 AS l_discount FROM lineitem) GROUP BY l_orderkey".replace("round(l_discount * 100) / 1000", "round(l_discount * 100)"))
def passthrough_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that the chosen parts of an order's files make, and whether they pass 1.5 GiB."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.round("l_extendedprice") * 1000 * F.round(F.col("l_discount") * 100) * 10).alias("b"))
    return d.groupBy("l_orderkey").agg(F.sum("b").cast("long").alias("bytes"), (F.sum("b") > 1.5 * 1024**3).alias("blocked"))


@query("range_predicates", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_quantity BETWEEN 1 AND 40 AND l_discount < l_tax, false) AS ok FROM lineitem")
def range_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded number and 0 <= start < end checks, null-safe."""
    ok = F.coalesce(F.col("l_quantity").between(1, 40) & (F.col("l_discount") < F.col("l_tax")), F.lit(False))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ok.alias("ok"))


@query("key_union_rows", "SELECT r_regionkey AS id, coalesce(r_name, '') AS name, '' AS extra FROM region UNION ALL SELECT n_nationkey, '', coalesce(n_name, '') FROM nation")
def key_union_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with different keys under the union of the keys, missing values as empty text."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("extra"))
    return r.unionByName(n, allowMissingColumns=True).fillna("", ["name", "extra"])
