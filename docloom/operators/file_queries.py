"""Registered queries that write tables as workbooks, documents and audio, and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.catalogue import query
from docloom.operators.text_queries import table
from docloom.sources import docx, wav, xlsx
from docloom.sources.csv_files import read_csv
from docloom.sources.storage import scratch


@query("xlsx_table", "SELECT * FROM orders")
def xlsx_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as workbooks, one for each task, and read again under their schema, a task for each sheet."""
    o, path = table(spark, sf_dir, "orders"), scratch(spark, "xlsx")
    xlsx.register(spark)
    o.write.format("docloom-xlsx").mode("overwrite").save(path)
    return spark.read.format("docloom-xlsx").schema(o.schema).load(path)


@query("xlsx_cells", """WITH n AS (SELECT n_regionkey, n_nationkey, n_name, n_nationkey % 2 = 0 AS even FROM nation)
SELECT col, kind, v, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([1, 2, 3, 4]) AS col, unnest(['number', 'string', 'boolean', 'formula']) AS kind, unnest([CAST(n_nationkey AS VARCHAR), n_name, CASE WHEN even THEN '1' ELSE '0' END, NULL]) AS v FROM n) WHERE v IS NOT NULL OR col = 4 GROUP BY ALL""")
def xlsx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of workbooks without header rows: numbers, texts, truth values, formulas."""
    path = scratch(spark, "xlsx")
    xlsx.register(spark)
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", (F.col("n_nationkey") % 2 == 0).alias("even"), F.concat(F.lit("=A"), F.col("n_nationkey") + 1).alias("f"))
    n.write.format("docloom-xlsx").options(header="false", formulas="true").mode("overwrite").save(path)
    return spark.read.format("docloom-xlsx").load(path).groupBy("col", "kind", "v").agg(F.count("*").alias("n"))


@query("docx_pages", """WITH p AS (SELECT conv_id, turn, [coalesce(role, '')] || coalesce(string_split(text, chr(10)), []) AS l FROM conversations),
d AS (SELECT conv_id, flatten(list(l ORDER BY turn)) AS l FROM p GROUP BY conv_id)
SELECT conv_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS text FROM d""")
def docx_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as word documents, a page for each turn, and their paragraphs read again."""
    path = scratch(spark, "docx")
    c = table(spark, sf_dir, "conversations")
    docx.write_documents(c.select(F.col("conv_id").cast("string").alias("document"), F.col("turn").alias("page"), F.col("role").alias("title"), F.split("text", "\n", -1).alias("lines")), path)
    read = spark.read.format("docloom-docx").load(path)
    return read.select(F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long").alias("conv_id"), "pos", "text")


@query("wav_blocks", """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value / 250 - 1 AS x FROM events WHERE value IS NOT NULL),
c AS (SELECT user_id, i, greatest(-1, least(1, x)) AS x FROM e)
SELECT user_id, CAST(i AS BIGINT) AS i, CAST(trunc(CASE WHEN x < 0 THEN x * 32768 ELSE x * 32767 END) AS INT) AS pcm FROM c""")
def wav_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values as a clip, in blocks of a hundred events' places, written as WAV and read again in ranges."""
    path = scratch(spark, "wav")
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("i"), (F.col("value") / 250 - 1).alias("x"))
    block = F.floor(F.col("i") / 100)
    blocks = e.groupBy("user_id", block.alias("start")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("samples"))
    wav.write_wav(blocks.select(F.col("user_id").cast("string").alias("name"), F.lit(8_000).alias("rate"), F.lit(1).alias("channels"), "start", "samples"), path)
    read = spark.read.format("docloom-wav").option("frames", 64).load(path)
    each = read.select(F.regexp_extract("path", r"(-?\d+)\.wav$", 1).cast("long").alias("user_id"), "start", F.posexplode("samples").alias("k", "s"))
    return each.select("user_id", (F.col("start") + F.col("k")).alias("i"), F.round(F.col("s") * 32768).cast("int").alias("pcm"))


@query("csv_lineitem", """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(l_partkey AS VARCHAR) AS l_partkey,
 coalesce(CASE l_partkey % 4 WHEN 0 THEN 'line one' || chr(10) || '"two", ' || l_returnflag WHEN 1 THEN chr(13) || chr(10) || l_linestatus || chr(10) || chr(10) WHEN 2 THEN l_returnflag || '""' ELSE 'plain' END, '') AS note FROM lineitem""")
def csv_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as quoted CSV with line ends, quotes and commas inside fields, read in splits of 128 KB."""
    path = scratch(spark, "csv")
    part, flag = F.col("l_partkey") % 4, F.col("l_returnflag")
    note = F.when(part == 0, F.concat(F.lit('line one\n"two", '), flag)).when(part == 1, F.concat(F.lit("\r\n"), F.col("l_linestatus"), F.lit("\n\n"))).when(part == 2, F.concat(flag, F.lit('""'))).otherwise("plain")
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", note.alias("note"))
    d.write.options(header=True, quoteAll=True, escape='"', lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_csv(spark, path, split_bytes=1 << 17)[0].drop("_file", "_row")


@query("csv_report", """WITH e AS (SELECT event_type, event_id % 5 AS m FROM events)
SELECT event_type, CAST(count(*) AS BIGINT) AS records, CAST(count(*) FILTER (WHERE m IN (1, 2)) AS BIGINT) AS odd, CAST(count(*) FILTER (WHERE m = 3) AS BIGINT) AS faults FROM e GROUP BY event_type""")
def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as CSV files by type, with short and long records, blank ones, and text after closing quotes: how many of each."""
    path = scratch(spark, "csv")
    m, v = F.col("event_id") % 5, F.col("event_id").cast("string")
    line = F.when(m == 0, F.concat(v, F.lit(',"a\nb",'))).when(m == 1, F.concat(v, F.lit(',"x"\n  ,,'))).when(m == 2, F.concat(v, F.lit(",1,2,3"))).when(m == 3, F.concat(F.lit('"'), v, F.lit('"x,1,2'))).otherwise(F.concat(F.lit('\n"'), v, F.lit('"",",,"\n"')))
    e = table(spark, sf_dir, "events").select("event_type", "event_id", line.alias("value"))
    heads = e.select("event_type").distinct().select("event_type", F.lit(-1).cast("long").alias("event_id"), F.lit(" id ,,id").alias("value"))
    e.union(heads).repartition(4, "event_type").sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").text(path)
    report = read_csv(spark, path, split_bytes=1 << 15, faults="keep")[1]
    kind = F.nullif(F.regexp_extract("file", "event_type=([^/]+)/", 1), F.lit("__HIVE_DEFAULT_PARTITION__"))
    return report.groupBy(kind.alias("event_type")).agg(*[F.sum(c).alias(c) for c in ("records", "odd", "faults")])
