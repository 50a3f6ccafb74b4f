"""Registered queries of tracked changes: versions of conversations as word documents that can be accepted or rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import revisions as R
from docloom.operators.catalogue import query
from docloom.operators.compare_files import CompareOptions, compare_folders
from docloom.operators.text_queries import table
from docloom.sources import docx
from docloom.sources.storage import scratch

_versions = r"""WITH p AS (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations),
c AS (SELECT conv_id, flatten(list(l ORDER BY turn)) AS x FROM p GROUP BY conv_id),
e AS (SELECT conv_id, x, list_transform(list_filter(x, lambda l, i: i % 7 <> 4), lambda l, i: CASE i % 5 WHEN 1 THEN regexp_replace(l, '^([^ ]*) ', '\1' || chr(10)) WHEN 3 THEN l || ' and so on' ELSE l END) AS y FROM c),
v AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN array_to_string(y, chr(10)) ELSE array_to_string(x, chr(10)) END AS before, CASE WHEN conv_id % 3 = 0 THEN array_to_string(x, chr(10)) ELSE array_to_string(y, chr(10)) END AS after FROM e)"""


def _versions_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations (a few turns each) and themselves with lines lost, split and added to; every third the other way round."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("l")))).alias("t"))
    x = F.flatten(F.transform("t", lambda s: s["l"]))
    kept = F.filter(x, lambda l, i: (i + 1) % 7 != 4)
    y = F.transform(kept, lambda l, i: F.when((i + 1) % 5 == 1, F.regexp_replace(l, "^([^ ]*) ", "$1\n")).when((i + 1) % 5 == 3, F.concat(l, F.lit(" and so on"))).otherwise(l))
    both = turns.select("conv_id", F.array_join(x, "\n").alias("x"), F.array_join(y, "\n").alias("y"))
    turned = F.col("conv_id") % 3 == 0
    side = lambda own, other: both.select(F.col("conv_id").alias("key"), F.posexplode(F.split(F.when(turned, F.col(other)).otherwise(F.col(own)), "\n", -1)).alias("pos", "line"))
    return side("x", "y"), side("y", "x")


@query("tracked_documents", _versions + """ SELECT conv_id, 'accepted' AS revisions, CAST(unnest(range(len(string_split(after, chr(10))))) AS INT) AS pos, unnest(string_split(after, chr(10))) AS text FROM v
UNION ALL SELECT conv_id, 'rejected', CAST(unnest(range(len(string_split(before, chr(10))))) AS INT), unnest(string_split(before, chr(10))) FROM v""")
def tracked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions of each conversation as one word document of tracked changes, read with them accepted and rejected."""
    path = scratch(spark, "tracked")
    pieces = R.tracked(*_versions_of(spark, sf_dir)).withColumn("document", F.col("key").cast("string"))
    docx.write_revisions(pieces, path, "reviewer", "2024-01-01T00:00:00Z")
    views = [spark.read.format("docloom-docx").option("revisions", v).load(path).withColumn("revisions", F.lit(v)) for v in docx.GONE]
    return views[0].union(views[1]).select(F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long").alias("conv_id"), "revisions", "pos", "text")


@query("tracked_totals", _versions + """ SELECT conv_id, CAST(len(before) + 1 AS BIGINT) AS before_characters, CAST(len(after) + 1 AS BIGINT) AS after_characters, CAST(len(string_split(before, chr(10))) AS BIGINT) AS before_marks, CAST(len(string_split(after, chr(10))) AS BIGINT) AS after_marks FROM v""")
def tracked_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and paragraph marks of either version, from what the tracked changes keep, delete and add."""
    found = R.counts(R.tracked(*_versions_of(spark, sf_dir)))
    total = lambda c, but, name: F.coalesce(F.sum(F.when(F.col("kind") != but, F.col(c))), F.lit(0)).alias(name)
    return found.groupBy(F.col("key").alias("conv_id")).agg(total("characters", "added", "before_characters"), total("characters", "deleted", "after_characters"), total("marks", "added", "before_marks"), total("marks", "deleted", "after_marks"))


@query("compared_files", """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS d, o_orderkey // 2000 AS p, concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority) AS line FROM orders),
b AS (SELECT * FROM o WHERE k % 97 <> 0), a AS (SELECT k, d, p, CASE WHEN k % 97 IN (1, 2) THEN line || '!' ELSE line END AS line FROM o WHERE k % 97 <> 3),
x AS (SELECT d, p, k, line FROM b UNION ALL SELECT DISTINCT d, p, -1, 'page ' || p FROM b), y AS (SELECT d, p, k, line FROM a UNION ALL SELECT DISTINCT d, p, -1, 'page ' || p FROM a),
f AS (SELECT coalesce(x.d, y.d) AS d, coalesce(x.p, y.p) AS p, coalesce(x.k, y.k) AS k, x.line AS xl, y.line AS yl, CASE WHEN x.line = y.line THEN 1 ELSE 0 END AS eq FROM x FULL JOIN y ON x.d = y.d AND x.p = y.p AND x.k = y.k),
h AS (SELECT *, sum(eq) OVER (PARTITION BY d ORDER BY p, k ROWS UNBOUNDED PRECEDING) - eq AS hunk FROM f),
g AS (SELECT d, hunk, string_agg(xl, chr(10) ORDER BY p, k) AS before, string_agg(yl, chr(10) ORDER BY p, k) AS after FROM h WHERE eq = 0 GROUP BY d, hunk)
SELECT 'book_' || d || '.docx' AS document, 'body' AS section, CAST(hunk AS BIGINT) AS hunk, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'deleted' ELSE 'changed' END AS kind, before, after FROM g""")
def compared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in five word documents, a page for two thousand numbers, against edited ones: what changed, from the files."""
    k, path = F.col("o_orderkey"), scratch(spark, "compared")
    page = F.floor(k / 2_000)
    o = table(spark, sf_dir, "orders").select(k, F.concat(F.lit("book_"), (k % 5).cast("string")).alias("document"), page.alias("page"), F.concat_ws("|", k.cast("string"), "o_orderstatus", "o_orderpriority").alias("line"))
    edited = o.where(k % 97 != 3).withColumn("line", F.when((k % 97).isin(1, 2), F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    for d, name in ((o.where(k % 97 != 0), "before"), (edited, "after")):
        pages = d.groupBy("document", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda s: s["line"]).alias("lines"))
        docx.write_documents(pages.withColumn("title", F.concat(F.lit("page "), F.col("page").cast("string"))), f"{path}/{name}")
    changes, _ = compare_folders(spark, f"{path}/before", f"{path}/after", CompareOptions(metadata=False))
    return changes.select("document", "section", "hunk", "kind", "before", "after")
