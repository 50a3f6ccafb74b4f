"""Registered queries of the remaining planning, formatting and packaging operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import formats
from docloom.functions import text as T
from docloom.operators.catalogue import query
from docloom.operators.text_queries import table
from docloom.session import ship


def apply_text(df: DataFrame, key: str, column: Column, f: Callable[[str], str]) -> DataFrame:
    """key, out, error: a text function in Arrow batches; a text that it refuses gives an error, not a failure."""
    ship(df.sparkSession)
    rows = df.select(key, column.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, error = [], []
            for t in batch.column(1).to_pylist():
                try:
                    out.append(None if t is None else f(t))
                    error.append(None)
                except (ValueError, KeyError) as e:
                    out.append(None)
                    error.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(error, pa.string())], [key, "out", "error"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, out string, error string")


@query("json_minify", "SELECT event_id, replace(props, ' ', '') AS out FROM events")
def json_minify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_text(table(spark, sf_dir, "events"), "event_id", F.col("props"), lambda t: formats.json_text(t, None)).drop("error")


@query("sql_minify", "SELECT n_nationkey, 'SELECT ''' || n_name || ''' /* n */ FROM t WHERE a IN(1, 2)' AS out FROM nation")
def sql_minify(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("SELECT  '"), F.col("n_name"), F.lit("'  -- n\nFROM t\n WHERE a IN ( 1,\t2)"))
    return apply_text(table(spark, sf_dir, "nation"), "n_nationkey", t, formats.sql_minify).select("n_nationkey", "out")


@query("xml_format", "SELECT n_nationkey, '<n><k>' || n_nationkey || '</k><v>' || coalesce(n_name, '') || '</v></n>' AS out, CAST(NULL AS VARCHAR) AS error FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey, NULL, 'line 4, column 3: mismatched tag' FROM nation WHERE n_nationkey % 5 = 0")
def xml_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("n_nationkey") % 5 == 0, "<k>").otherwise("")
    t = F.concat(F.lit("<n>\n  <k>"), F.col("n_nationkey").cast("string"), F.lit("</k>\n  "), bad, F.lit("<v>"), F.coalesce("n_name", F.lit("")), F.lit("</v>\n</n>"))
    return apply_text(table(spark, sf_dir, "nation"), "n_nationkey", t, lambda x: formats.xml_text(x, None))


@query("concat_compatible", "SELECT l_orderkey, count(*) = 1 OR count(DISTINCT (l_linenumber % 2, l_tax)) = 1 AS ok FROM lineitem GROUP BY l_orderkey")
def concat_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all items of a group have one size."""
    size = F.struct(F.col("l_linenumber") % 2, F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(((F.count("*") == 1) | (F.count_distinct(size) == 1)).alias("ok"))


@query("job_expansion", """SELECT p_brand AS grp, CAST(0 AS BIGINT) AS job, CAST(count(*) AS BIGINT) AS items FROM part WHERE p_brand LIKE '%1' GROUP BY p_brand
UNION ALL SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT), 1 FROM part WHERE p_brand NOT LIKE '%1'""")
def job_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concatenating group is one job; other groups have a job for each item, numbered."""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "grp")
    joined = p.where(F.col("grp").endswith("1")).groupBy("grp").agg(F.lit(0).cast("long").alias("job"), F.count("*").alias("items"))
    each = p.where(~F.col("grp").endswith("1")).select("grp", F.row_number().over(Window.partitionBy("grp").orderBy("p_partkey")).cast("long").alias("job"), F.lit(1).cast("long").alias("items"))
    return joined.union(each)


@query("reorder_item", "SELECT vec_id, round(list_sum(list_transform(CASE WHEN f < len(a) THEN o ELSE a END, lambda x, i: x * i)), 4) AS moment FROM (SELECT vec_id, f, a, (a[:f] || a[f + 2:])[:2] || [a[f + 1]] || (a[:f] || a[f + 2:])[3:] AS o FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, CAST(vec_id % 80 AS INT) AS f FROM embeddings))")
def reorder_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item at vec_id % 80 moves to place 2; nothing moves from a place that is not there."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"), (F.col("vec_id") % 80).cast("int").alias("f"))
    a = F.col("a")
    rest = F.concat(F.slice(a, F.lit(1), F.col("f")), F.slice(a, F.col("f") + 2, F.size(a)))
    moved = F.concat(F.slice(rest, F.lit(1), F.lit(2)), F.array(F.get(a, F.col("f"))), F.slice(rest, F.lit(3), F.size(a)))
    out = F.when(F.col("f") < F.size(a), moved).otherwise(a)
    return d.select("vec_id", F.round(F.aggregate(F.transform(out, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4).alias("moment"))


@query("selection_default", "SELECT p_partkey, round(least(d, greatest(0.1::DOUBLE, least(5.0::DOUBLE, d / 4))), 9) AS until FROM (SELECT p_partkey, p_retailprice / 100::DOUBLE AS d FROM part)")
def selection_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("p_retailprice") / 100.0
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.least(d, F.greatest(F.lit(0.1), F.least(F.lit(5.0), d / 4.0))), 9).alias("until"))


@query("watermark_anchor", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 20 WHEN 1 THEN w - 120 WHEN 2 THEN 20 WHEN 3 THEN w - 120 ELSE (w - 100) / 2.0::DOUBLE END::DOUBLE AS x, CASE p_partkey % 5 WHEN 0 THEN 20 WHEN 1 THEN 20 WHEN 2 THEN h - 60 WHEN 3 THEN h - 60 ELSE (h - 40) / 2.0::DOUBLE END::DOUBLE AS y FROM (SELECT p_partkey, p_size * 40 + 7 AS w, CAST(floor(p_retailprice) AS BIGINT) AS h FROM part)")
def watermark_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark of 100 x 40 in a corner, 20 from the edges, or in the middle."""
    d = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40 + 7).cast("double").alias("w"), F.floor("p_retailprice").cast("double").alias("h"), (F.col("p_partkey") % 5).alias("k"))
    x = F.when(F.col("k").isin(0, 2), 20.0).when(F.col("k").isin(1, 3), F.col("w") - 120).otherwise((F.col("w") - 100) / 2)
    y = F.when(F.col("k").isin(0, 1), 20.0).when(F.col("k").isin(2, 3), F.col("h") - 60).otherwise((F.col("h") - 40) / 2)
    return d.select("p_partkey", x.alias("x"), y.alias("y"))


@query("canvas_limits", "SELECT p_partkey, w <= 12000 AND h <= 12000 AND w * h <= 80000000 AS ok FROM (SELECT p_partkey, p_size * 300 AS w, p_size * 200 AS h FROM part)")
def canvas_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 300, F.col("p_size") * 200
    return table(spark, sf_dir, "part").select("p_partkey", ((w <= 12_000) & (h <= 12_000) & (w * h <= 80_000_000)).alias("ok"))


@query("rate_control_args", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '-b:v 2M -crf 30 -row-mt 1' WHEN s_suppkey % 3 = 1 THEN '-preset veryfast -crf 30' ELSE '-preset veryfast -b:v 2M -maxrate 2M -bufsize 4M' END AS args FROM supplier")
def rate_control_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoder arguments by codec and bitrate; the buffer is twice the rate."""
    k = F.col("s_suppkey") % 3
    codec, rate = F.when(k == 0, "vp9").otherwise("h264"), F.when(k == 1, "0").otherwise("2M")
    twice = F.concat((F.regexp_extract(rate, r"^(\d+)", 1).cast("int") * 2).cast("string"), F.upper(F.regexp_extract(rate, "([kKmM])$", 1)))
    lit = lambda *x: F.array(*[F.lit(i) if isinstance(i, str) else i for i in x])
    args = F.when(codec == "vp9", lit("-b:v", rate, "-crf", "30", "-row-mt", "1")).when(rate == "0", lit("-preset", "veryfast", "-crf", "30")).otherwise(lit("-preset", "veryfast", "-b:v", rate, "-maxrate", rate, "-bufsize", twice))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(args, " ").alias("args"))


@query("template_interpolate", "SELECT n_nationkey, 'Hello ' || n_name || ', ' || n_regionkey || '' AS text FROM nation")
def template_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`{{name}}` becomes the named column's value, unknown names the empty text."""
    n = table(spark, sf_dir, "nation")
    out = F.lit("Hello {{n_name}}, {{n_regionkey}}{{nobody}}")
    for c in n.columns:
        out = F.replace(out, F.lit("{{" + c + "}}"), F.col(c).cast("string"))
    return n.select("n_nationkey", F.regexp_replace(out, r"\{\{[^}]*\}\}", "").alias("text"))


@query("stable_json", "SELECT event_id, '{\"a\":1,\"k\":' || json_extract_string(props, '$.k') || ',\"z\":2}' AS json FROM events")
def stable_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with its keys in order, at every depth."""
    t = F.concat(F.lit('{"z": 2, "k": '), F.get_json_object("props", "$.k"), F.lit(', "a": 1}'))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.parse_json(t)).alias("json"))


@query("text_pages", "SELECT conv_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM (SELECT conv_id, string_agg('# ' || turn || chr(10) || text, chr(10) || chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id)")
def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a title each, joined by a blank line."""
    page = F.concat(F.lit("# "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", page.alias("p")))).alias("l"))
    t = F.array_join(F.transform("l", lambda x: x["p"]), "\n\n")
    return pages.select("conv_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("text_md5"))


@query("nearest_column", "SELECT l_orderkey, l_linenumber, l_partkey, (SELECT arg_min(c, (abs(x - l_quantity), i)) FROM (VALUES (0, 'a', 3.0), (1, 'b', 17.0), (2, 'c', 29.0), (3, 'd', 41.0)) v(i, c, x)) AS col FROM lineitem")
def nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest of a line's column centres; of two as close the first."""
    centres = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.lit(x).alias("x")) for i, (c, x) in enumerate((("a", 3.0), ("b", 17.0), ("c", 29.0), ("d", 41.0)))])
    ranked = F.array_sort(F.transform(centres, lambda c: F.struct(F.abs(c["x"] - F.col("l_quantity")).alias("d"), c["i"].alias("i"), c["c"].alias("c"))))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ranked[0]["c"].alias("col"))


@query("file_filter", "SELECT page_id, lower(list_extract(string_split(url, '.'), -1)) IN ('html', 'com/', 'org/en/5') OR url LIKE '%/en/%' AS accepted FROM pages")
def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted files and rejects in one pass, as a flag."""
    ok = T.file_extension(F.col("url")).isin("html", "com/", "org/en/5") | F.contains("url", F.lit("/en/"))
    return table(spark, sf_dir, "pages").select("page_id", ok.alias("accepted"))


def plan_json(plan: DataFrame) -> list[dict]:
    """A small plan (jobs, pages) as plain objects for whoever runs it."""
    return [json.loads(r[0]) for r in plan.select(F.to_json(F.struct("*"))).collect()]
