"""Registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.align import dice_of
from docloom.functions.ranges import quantiles, reached
from docloom.operators.catalogue import query
from docloom.session import ship

#: The white-space class for the SQL side.
_WS = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


@query("text_dedupe_lines", f"""
WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS i FROM documents),
t AS (SELECT *, {_trim_sql('line')} AS k FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS rn FROM t)
SELECT doc_id, CAST(count(*) FILTER (WHERE rn = 1 OR k = '') AS BIGINT) AS kept_lines,
 CAST(count(*) FILTER (WHERE rn > 1 AND k <> '') AS BIGINT) AS removed_lines,
 md5(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE rn = 1 OR k = '')) AS text_md5
FROM r GROUP BY doc_id UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE text IS NULL""")
def text_dedupe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kept = T.kept_lines(F.col("text"))
    d = d.select("doc_id", F.size(T.lines(F.col("text"))).alias("n"), kept.alias("kept"))
    return d.select("doc_id", F.size("kept").cast("long").alias("kept_lines"), (F.col("n") - F.size("kept")).cast("long").alias("removed_lines"), F.md5(F.array_join("kept", "\n")).alias("text_md5"))


def _text_query(name: str, spark_f, sql_text: str, source: str = "documents", key: str = "doc_id", value: str = "text"):
    @query(name, f"SELECT {key}, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM (SELECT {key}, {sql_text} AS t FROM {source})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = spark_f(F.col(value))
        keys = [k.strip() for k in key.split(",")]
        return table(spark, sf_dir, source).select(*keys, t.alias("t")).select(*keys, F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))

    return run


_trimmed_lines = f"list_transform(string_split_regex(text, '\\r?\\n'), lambda x: {_trim_sql('x')})"
_text_query("text_trim_lines", T.trim_lines, f"regexp_replace(array_to_string({_trimmed_lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")
_text_query("text_collapse_spaces", T.collapse_spaces, "regexp_replace(regexp_replace(text, '[\\t ]{2,}', ' ', 'g'), '(?m)[\\t ]+$', '', 'g')")
_text_query("text_remove_linebreaks", T.remove_linebreaks, _trim_sql(f"regexp_replace(regexp_replace(text, '{_WS}*\\r?\\n{_WS}*', ' ', 'g'), '[\\t ]{{2,}}', ' ', 'g')"))
_text_query("text_clean", T.clean, _trim_sql("regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFC}]', '', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"), "conversations", "conv_id, turn")
_text_query("normalize_text", T.normalize, f"lower({_trim_sql(f'regexp_replace(text, {chr(39)}{_WS}+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')})", "benchmark", "item_id")
_text_query("html_escape", T.escape_html, "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')")
_text_query("html_decode", T.decode_html, "replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')", "pages", "page_id", "html")
_text_query("xml_escape", T.escape_xml, "replace(replace(replace(replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')")

_words_sql = "regexp_extract_all({c}, '[A-Z]+|[A-Z]?[a-z]+|[0-9]+')"


@query("text_case", f"""
SELECT p_partkey, array_to_string(list_transform(w, lambda x: lower(x)), '_') AS snake, array_to_string(list_transform(w, lambda x: lower(x)), '-') AS kebab,
 array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title,
 array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 THEN lower(x) ELSE upper(x[1]) || lower(x[2:]) END), '') AS camel
FROM (SELECT p_partkey, {_words_sql.format(c='p_name')} AS w FROM part)""")
def text_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.snake_case(c).alias("snake"), T.kebab_case(c).alias("kebab"), T.title_case(c).alias("title"), T.camel_case(c).alias("camel"))


@query("tokenize_counts", """
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_filter(t, lambda x: regexp_full_match(x, '\\s+'))) AS BIGINT) AS n_space
FROM (SELECT doc_id, regexp_extract_all(text, '\\s+|[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]') AS t FROM documents)""")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", count(T.TOKEN).alias("n_tokens"), count(r"\s+").alias("n_space"))


_dice_sql = """
WITH d AS (SELECT doc_id, lower(text) AS a, lower(lag(text) OVER (ORDER BY doc_id)) AS b FROM documents),
n AS (SELECT doc_id, CASE WHEN length(a) < 8 THEN 1 ELSE 2 END AS na, CASE WHEN length(b) < 8 THEN 1 ELSE 2 END AS nb, a, b FROM d WHERE b IS NOT NULL),
g AS (SELECT doc_id, CASE WHEN length(a) <= na THEN [a] WHEN na = 1 THEN ca ELSE list_transform(range(1, CAST(length(a) AS BIGINT)), lambda i: ca[i] || ca[i + 1]) END AS ga, CASE WHEN length(b) <= nb THEN [b] WHEN nb = 1 THEN cb ELSE list_transform(range(1, CAST(length(b) AS BIGINT)), lambda i: cb[i] || cb[i + 1]) END AS gb FROM (SELECT *, string_split(a, '') AS ca, string_split(b, '') AS cb FROM n)),
ca AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(ga) AS x FROM g) GROUP BY ALL),
cb AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(gb) AS x FROM g) GROUP BY ALL),
s AS (SELECT ca.doc_id, sum(least(ca.c, cb.c)) AS m FROM ca JOIN cb ON ca.doc_id = cb.doc_id AND ca.x = cb.x GROUP BY ca.doc_id)
SELECT g.doc_id, round(2.0::DOUBLE * coalesce(m, 0)::DOUBLE / (len(ga) + len(gb)), 9) AS dice FROM g LEFT JOIN s USING (doc_id)"""


@query("char_ngram_dice", _dice_sql)
def char_ngram_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of a document's whole text with its predecessor's: multiset Dice over bigrams (unigrams if short)."""
    return _dice(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("a")))


# the same under the name that it had beside a query on openings
query("char_ngram_dice_whole", _dice_sql)(char_ngram_dice)


def _dice(d: DataFrame) -> DataFrame:
    """d(doc_id, a) -> doc_id, dice; no row without a predecessor's text, null for a null text."""
    ship(d.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dice = [None if x is None else dice_of(x, y) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dice, pa.float64())], ["doc_id", "dice"])

    pairs = _with_previous(d).where("b IS NOT NULL")
    return pairs.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, dice double").select("doc_id", F.round("dice", 9).alias("dice"))


def _with_previous(d: DataFrame) -> DataFrame:
    """d(doc_id, a) -> doc_id, a, b: a of the row before by doc_id, whatever the gaps; rows without an id come last.

    Windows are per range of ids, and each range's first row gets the last text of the range before: no window over all rows.
    """
    n = max(64, d.count() // 10_000)
    k = reached(F.col("doc_id"), quantiles(d, "doc_id", n))
    d = d.withColumn("k", F.when(F.col("doc_id").isNull(), n).otherwise(k)).withColumn("h", F.xxhash64("a"))
    tails = d.groupBy("k").agg(F.max_by(F.struct("a"), F.struct("doc_id", "h")).alias("tail"))
    tails = tails.select(F.lead("k").over(Window.orderBy("k")).alias("k"), "tail")  # a row a range
    own = F.lag(F.struct("a")).over(Window.partitionBy("k").orderBy(F.col("doc_id").asc_nulls_last(), "h"))
    met = d.withColumn("own", own).join(tails, "k", "left")
    return met.select("doc_id", "a", F.when(F.col("own").isNotNull(), F.col("own.a")).otherwise(F.col("tail.a")).alias("b"))


@query("a1_columns", """
SELECT n, CASE WHEN c >= 0 THEN chr(CAST(65 + c % 26 AS INT)) ELSE '' END || CASE WHEN b >= 0 THEN chr(CAST(65 + b % 26 AS INT)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INT)) AS letters, n AS back
FROM (SELECT n, (n - 1) // 26 - 1 AS b, ((n - 1) // 26 - 1 + 26) // 26 - 2 AS c FROM (SELECT CAST(unnest(range(1, 801)) AS BIGINT) AS n))""")
def a1_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.range(1, 801).select(F.col("id").alias("n"), T.column_letters(F.col("id")).alias("letters"))
    return d.withColumn("back", T.column_number(F.col("letters")))


@query("file_name_ops", """
SELECT page_id, lower(list_extract(string_split(url, '.'), -1)) AS ext, regexp_replace(url, '\\.[^.]+$', '') AS base, regexp_replace(url, '[\\\\/:*?"<>|]', '_', 'g') AS safe, regexp_replace(url, '[\\\\/:*?"<>|]+', '-', 'g') AS dashed,
 CASE WHEN lower(url) LIKE '%.html' THEN url ELSE url || '.html' END AS named FROM pages""")
def file_name_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.file_extension(u).alias("ext"), T.strip_extension(u).alias("base"), T.safe_file_name(u).alias("safe"), T.safe_file_name(u, "-", True).alias("dashed"), T.ensure_extension(u, "html").alias("named"))


@query("sheet_names", """
WITH RECURSIVE p AS (SELECT page_id, page_id // 500 AS book, row_number() OVER (PARTITION BY page_id // 500 ORDER BY page_id) AS r, substr(CASE WHEN b = '' THEN 'Sheet' WHEN lower(b) = 'history' THEN b || '_' ELSE b END, 1, 31) AS base
 FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[\\\\/*?:\\[\\]]', '_', 'g'), '^''+|''+$', '', 'g') AS b FROM pages)),
t(page_id, book, r, used, sheet) AS (SELECT page_id, book, r, [lower(base)], base FROM p WHERE r = 1
 UNION ALL SELECT page_id, book, r, list_append(used, lower(name)), name FROM (
  SELECT p.page_id, p.book, p.r, t.used, list_filter(list_transform(range(1, CAST(p.r AS INT) + 1), lambda n: CASE WHEN n = 1 THEN p.base ELSE substr(p.base, 1, 31 - length(' (' || n || ')')) || ' (' || n || ')' END), lambda x: NOT list_contains(t.used, lower(x)))[1] AS name
  FROM t JOIN p ON p.book = t.book AND p.r = t.r + 1))
SELECT page_id, sheet, '''' || replace(sheet, '''', '''''') || '''' AS quoted FROM t""")
def sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique names of the sheets of workbooks, of up to 500 pages each."""
    d = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 500).alias("book"), "page_id", T.sheet_name(F.col("url")).alias("base"))
    return unique_names(d, "book", "page_id", "base").select("page_id", F.col("name").alias("sheet"), T.quote_sheet(F.col("name")).alias("quoted"))


def unique_names(d: DataFrame, book: str, order: str, base: str, most: int = 31) -> DataFrame:
    """d(book, order, base) with name: the base, or it with the first number from 2 on that gives a new name.

    Names differ also without regard to case. A book's names are one small group, as the sheets of a workbook are.
    """
    ship(d.sparkSession)
    schema = ", ".join(f"`{n}` {t}" for n, t in d.dtypes) + ", name string"

    def name(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        used: set[str] = set()
        names, reached = [], {}
        for b in group.column(base).to_pylist():
            if b is None:
                names.append(None)
                continue
            n = reached.get(b, 1)
            made = b if n == 1 else f"{b[: most - len(f' ({n})')]} ({n})"
            while made.lower() in used:
                n += 1
                made = f"{b[: most - len(f' ({n})')]} ({n})"
            used.add(made.lower())
            reached[b] = n
            names.append(made)
        return group.append_column("name", pa.array(names, pa.string()))

    return d.groupBy(book).applyInArrow(name, schema)


@query("json_unsafe_integers", """
SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_unsafe FROM events""")
def json_unsafe_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers that a double would round, in event properties with an added number and a string that only looks like one."""
    big = F.when(F.col("event_id") % 3 == 0, F.lit("9007199254740993")).otherwise(F.lit("9007199254740991"))
    t = F.concat(F.lit('{"s": "9007199254740999", "f": 12345678901234567890.5, "p": '), F.coalesce("props", F.lit("null")), F.lit(', "n": -'), big, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", F.size(T.unsafe_integers(t)).cast("long").alias("n_unsafe"))


@query("scalar_formats", """
SELECT p_partkey, CASE WHEN n < 1048576 THEN CAST(CAST(greatest(1, floor(n / 1024.0 + 0.5)) AS BIGINT) AS VARCHAR) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0::DOUBLE) || ' MB' ELSE printf('%.2f', n / 1073741824.0::DOUBLE) || ' GB' END AS size_text,
 lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS clock,
 regexp_replace(regexp_replace(printf('%.6f', p_retailprice / 7.0::DOUBLE), '0+$', ''), '\\.$', '') AS coordinate
FROM (SELECT p_partkey, p_retailprice, p_partkey * p_partkey * p_size * 97 AS n, CAST(floor(coalesce(p_retailprice, 0) * 1000 + 0.5) AS BIGINT) AS ms FROM part)""")
def scalar_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") * F.col("p_partkey") * F.col("p_size") * 97
    return table(spark, sf_dir, "part").select("p_partkey", T.byte_size(n).alias("size_text"), T.clock(F.col("p_retailprice")).alias("clock"), T.coordinate(F.col("p_retailprice") / 7.0).alias("coordinate"))


@query("error_classify", """
SELECT event_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'OUT_OF_MEMORY' WHEN 1 THEN 'CODEC_UNAVAILABLE' ELSE 'VIDEO_PROCESSING_ERROR' END AS code FROM events""")
def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*[F.lit(x) for x in ("Aborted(OOM) in worker", "Encoder h265 not found", "room for a zoom", "exit code 1")])
    message = F.concat(F.coalesce("event_type", F.lit("")), F.lit(": "), F.element_at(said, (F.col("event_id") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", T.classify_error(message).alias("code"))


@query("numerals", """
SELECT n, ['', 'm', 'mm', 'mmm'][n // 1000 + 1] || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] AS roman,
 CASE WHEN n > 702 THEN chr(CAST(97 + (n - 703) // 676 AS INT)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(97 + ((n - 1) // 26 - 1) % 26 AS INT)) ELSE '' END || chr(CAST(97 + (n - 1) % 26 AS INT)) AS letters,
 CASE WHEN n <= 20 THEN chr(CAST(9311 + n AS INT)) ELSE '(' || n || ')' END AS circled
FROM (SELECT DISTINCT p_partkey % 3999 + 1 AS n FROM part)""")
def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List labels of all numbers that roman numerals go up to."""
    n = F.col("n")
    d = table(spark, sf_dir, "part").select((F.col("p_partkey") % 3999 + 1).alias("n")).distinct()
    return d.select("n", T.roman(n).alias("roman"), T.alphabetic(n).alias("letters"), T.circled(n).alias("circled"))


@query("html_title", """
SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '(?is)<li\\b[^>]*>')) AS BIGINT) AS n_items FROM pages""")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit(r"(?is)<li\b[^>]*>")).cast("long").alias("n_items"))
