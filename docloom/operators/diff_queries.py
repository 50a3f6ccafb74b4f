"""Registered queries of the comparison, lint and format operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.ranges import ordinals
from docloom.operators import diff as D
from docloom.operators import line_diff as LD
from docloom.operators import lint
from docloom.operators.catalogue import query
from docloom.operators.text_queries import table

_snapshots = """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v, o_orderpriority AS f FROM orders WHERE o_orderkey % 97 <> 0),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 97 = 1 THEN lower(o_orderstatus) ELSE o_orderstatus END AS v, CASE WHEN o_orderkey % 97 = 2 THEN 'x' ELSE o_orderpriority END AS f FROM orders WHERE o_orderkey % 97 <> 3),
c AS (SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' WHEN a.v <> b.v THEN 'changed' WHEN a.f IS DISTINCT FROM b.f THEN 'format' ELSE 'unchanged' END AS kind FROM a FULL JOIN b ON a.k = b.k)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against an edited snapshot."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderpriority").alias("f"))
    m = F.col("k") % 97
    a = o.where(m != 0).select(F.col("k").alias("ak"), F.col("v").alias("av"), F.col("f").alias("af"))
    b = o.where(m != 3).select(F.col("k").alias("bk"), F.when(m == 1, F.lower("v")).otherwise(F.col("v")).alias("bv"), F.when(m == 2, "x").otherwise(F.col("f")).alias("bf"))
    kind = D.classify(F.when(F.col("ak").isNotNull(), F.coalesce("av", F.lit(""))), F.when(F.col("bk").isNotNull(), F.coalesce("bv", F.lit(""))), F.col("af"), F.col("bf"))
    return a.join(b, F.col("ak") == F.col("bk"), "full").select(F.coalesce("ak", "bk").alias("o_orderkey"), kind.alias("kind"))


query("diff_classify", _snapshots + " SELECT * FROM c")(_changes)
query("diff_summary", _snapshots + " SELECT " + ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT) AS {k}" for k in D.KINDS) + " FROM c")(lambda spark, sf_dir: D.summary(_changes(spark, sf_dir)))
query("changed_only", _snapshots + " SELECT * FROM c WHERE kind <> 'unchanged'")(lambda spark, sf_dir: _changes(spark, sf_dir).where("kind <> 'unchanged'"))


@query("diff_table_cells", """WITH x AS (SELECT n_nationkey AS r, 0 AS c, coalesce(n_name, '') AS v FROM nation UNION ALL SELECT n_nationkey, 1, CAST(n_regionkey AS VARCHAR) FROM nation),
y AS (SELECT n_nationkey + 1 AS r, 1 AS c, coalesce(n_name, '') AS v FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT n_nationkey + 1, 0, CASE WHEN n_nationkey % 5 = 0 THEN 'new' ELSE CAST(n_regionkey AS VARCHAR) END FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 0, c, 'top' FROM (VALUES (0), (1)) t(c))
SELECT CASE WHEN x.v IS NULL THEN 'added' WHEN y.v IS NULL THEN 'deleted' WHEN x.v <> y.v THEN 'changed' ELSE 'unchanged' END AS kind, CAST(count(*) AS BIGINT) AS n FROM x FULL JOIN y ON x.r + 1 = y.r AND 1 - x.c = y.c AND x.r <> 7 GROUP BY 1""")
def diff_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table against itself with a row on top, one row less, its columns swapped and some cells changed."""
    n = table(spark, sf_dir, "nation").fillna("", ["n_name"])
    k = F.col("n_nationkey")
    cells = lambda d, row, a, b: d.select(row.alias("row"), F.posexplode(F.array(a, b)).alias("col", "v"))
    region = F.col("n_regionkey").cast("string")
    x = cells(n, k, F.col("n_name"), region)
    y = cells(n.where(k != 7), k + 1, F.when(k % 5 == 0, "new").otherwise(region), F.col("n_name")).union(spark.createDataFrame([(0, 0, "top"), (0, 1, "top")], "row int, col int, v string"))
    rows = n.select(k.alias("b"), F.when(k != 7, k + 1).alias("a"))
    cols = spark.createDataFrame([(0, 1), (1, 0)], "b int, a int")
    return D.table_changes(x, y, rows, cols).groupBy("kind").agg(F.count("*").alias("n"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return c.withColumnRenamed("text", "before").join(nxt, ["conv_id", "turn"])


@query("diff_tokens")
def diff_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the next, token by token."""
    return D.token_segments(_turns(spark, sf_dir), ["conv_id", "turn"], "ratio")


@query("diff_tokens_lcs")
def diff_tokens_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.token_segments(_turns(spark, sf_dir), ["conv_id", "turn"], "ngram")


@query("diff_align_paragraphs")
def diff_align_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against themselves with a line edited and a line lost."""
    lines = F.split("text", "\n", -1)
    edited = F.transform(F.filter(lines, lambda x, i: i % 7 != 3), lambda x, i: F.when(i % 5 == 2, F.concat(x, F.lit(" and more"))).otherwise(x))
    pairs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("before"), F.array_join(edited, "\n").alias("after"))
    return D.summary(D.paragraph_changes(pairs, ["doc_id"]), "doc_id")


_LINES = "SELECT o_orderkey, concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority) AS line FROM orders"
_order_lines = f"""WITH b AS (SELECT o_orderkey AS k, line FROM ({_LINES}) WHERE o_orderkey % 97 <> 0), a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 97 IN (1, 2) THEN line || '!' ELSE line END AS line FROM ({_LINES}) WHERE o_orderkey % 97 <> 3),
x AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS pos FROM b), y AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS pos FROM a),"""


def _order_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as the lines of one text, and the text after some lines are lost, some new and some changed."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.lit(0).alias("key"), "o_orderkey", F.concat_ws("|", k.cast("string"), "o_orderstatus", "o_orderpriority").alias("line"))
    edited = o.where(k % 97 != 3).withColumn("line", F.when((k % 97).isin(1, 2), F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    return tuple(ordinals(d, "key", "o_orderkey").select("key", (F.col("n") - 1).alias("pos"), "line") for d in (o.where(k % 97 != 0), edited))


@query("line_diff", _order_lines + """ e AS (SELECT x.pos AS before_pos, y.pos AS after_pos, x.line FROM x JOIN y ON x.line = y.line)
SELECT 'equal' AS kind, before_pos, after_pos, line FROM e UNION ALL SELECT 'deleted', pos, NULL, line FROM x WHERE line NOT IN (SELECT line FROM e) UNION ALL SELECT 'added', NULL, pos, line FROM y WHERE line NOT IN (SELECT line FROM e)""")
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as one text against its edited version, line by line, without a task that sees either whole."""
    return LD.line_diff(*_order_texts(spark, sf_dir)).drop("key")


@query("line_changes", _order_lines + """ f AS (SELECT coalesce(x.k, y.k) AS k, x.pos AS xp, y.pos AS yp, x.line AS xl, y.line AS yl, CASE WHEN x.line = y.line THEN 1 ELSE 0 END AS eq FROM x FULL JOIN y ON x.k = y.k),
h AS (SELECT *, sum(eq) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) - eq AS hunk FROM f),
g AS (SELECT hunk, string_agg(xl, chr(10) ORDER BY xp) AS before, string_agg(yl, chr(10) ORDER BY yp) AS after, min(xp) AS xa, max(xp) AS xb, min(yp) AS ya, max(yp) AS yb FROM h WHERE eq = 0 GROUP BY hunk)
SELECT CAST(hunk AS BIGINT) AS hunk, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'deleted' ELSE 'changed' END AS kind, before, after, CASE WHEN xa = xb THEN CAST(xa AS VARCHAR) ELSE xa || '~' || xb END AS before_at, CASE WHEN ya = yb THEN CAST(ya AS VARCHAR) ELSE ya || '~' || yb END AS after_at FROM g""")
def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts' changes, neighbouring lines combined."""
    return LD.combined(LD.line_diff(*_order_texts(spark, sf_dir))).drop("key")


@query("line_common_ends", r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, x, list_filter(x, lambda l, i: i % 7 <> 4 OR i < len(x) // 2) AS y FROM d),
m AS (SELECT *, least(len(x), len(y)) AS n FROM e),
p AS (SELECT *, coalesce(list_min(list_filter(range(n), lambda i: x[i + 1] <> y[i + 1])), n) AS prefix FROM m)
SELECT doc_id, prefix, least(coalesce(list_min(list_filter(range(n), lambda i: x[len(x) - i] <> y[len(y) - i])), n), n - prefix) AS suffix FROM p""")
def line_common_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that documents have in common, at both ends, with themselves after lines of their second half are lost."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = F.split("text", "\n", -1)
    less = F.filter(lines, lambda x, i: ((i + 1) % 7 != 4) | (i + 1 < F.floor(F.size(lines) / 2)))
    after = d.select(F.col("doc_id").alias("key"), F.posexplode(less).alias("pos", "line"))
    return LD.common_ends(LD.text_lines(d, "doc_id", "text"), after).select(F.col("key").alias("doc_id"), "prefix", "suffix")


#: Sentences with and without findings, which the documents' own texts lack.
SAID = ("몇일 동안 작업후 확인", "할수 있습니다. 볼때 먹을만큼", "역활과 비률", "결재 금액", "문제 없음")


@query("text_lint")
def text_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in every document with a Korean sentence after its text. No SQL: rules look around."""
    said = F.element_at(F.array(*[F.lit(x) for x in SAID]), (F.col("doc_id") % len(SAID) + 1).cast("int"))
    return lint.findings(table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "text", said).alias("text")), "doc_id", "text")


_list_sql = lambda x: "[" + ", ".join(f"'{i}'" for i in x) + "]"


@query("cross_rules", f"SELECT stem, noun, stem || noun AS wrong, stem || ' ' || noun AS fixed FROM (SELECT unnest({_list_sql(lint.STEMS)}) AS stem) s, (SELECT unnest({_list_sql(lint.NOUNS)}) AS noun) n")
def cross_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stem with every noun: two fixed lists, 240 rules."""
    rules = spark.createDataFrame([(p.split("(")[0], r) for p, r in lint.RULES[len(lint.CORE) :]], "wrong string, fixed string")
    return rules.select(F.split_part("fixed", F.lit(" "), F.lit(1)).alias("stem"), F.split_part("fixed", F.lit(" "), F.lit(2)).alias("noun"), "wrong", "fixed")
