"""Two folders of word documents compared, documents of one name with each other, part by part and by joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.line_diff import combined, line_diff
from docloom.operators.revisions import tracked
from docloom.sources import docx
from docloom.sources.storage import scratch, stored


@dataclass(frozen=True)
class CompareOptions:
    """What to compare.

    tables: paragraphs inside tables take part. metadata: so do headers, footers, notes and comments, besides the body.
    tracked: a folder for documents of tracked changes of the bodies, by `author` at `date`; none without it.
    """

    tables: bool = True
    metadata: bool = True
    tracked: str | None = None
    author: str = ""
    date: str = ""


def compare_folders(spark: SparkSession, before: str, after: str, options: CompareOptions = CompareOptions()) -> tuple[DataFrame, DataFrame]:
    """changes(document, section, part, hunk, kind, before, after, before_at, after_at) and errors(document, side, error).

    A document that one folder lacks is deleted or added as a whole; one that cannot be read on either side is an error, and is not compared.
    """
    docx.register(spark)
    folder = scratch(spark, "compare")
    read = [stored(spark.read.format("docloom-docx").load(p).withColumn("document", F.regexp_extract("path", "([^/]+)$", 1)), f"{folder}/{n}") for p, n in ((before, "before"), (after, "after"))]
    errors = [d.where("error IS NOT NULL").select("document", F.lit(n).alias("side"), "error") for d, n in zip(read, ("before", "after"))]
    faulty = errors[0].union(errors[1])
    taken = F.lit(True)
    if not options.tables:
        taken &= F.col("table_ix").isNull()
    if not options.metadata:
        taken &= F.col("section") == "body"
    texts = [d.where(taken).join(faulty.select("document").distinct(), "document", "left_anti").select("document", "section", "part", "pos", "text") for d in read]
    names = texts[0].select("document", "section", "part").union(texts[1].select("document", "section", "part")).distinct()
    names = stored(names.withColumn("key", F.monotonically_increasing_id()), f"{folder}/names")  # numbers stay as they are once stored
    lines = [t.join(names, ["document", "section", "part"]).select("key", "pos", F.col("text").alias("line")) for t in texts]
    changes = names.join(combined(line_diff(*lines)), "key").drop("key")
    if options.tracked:
        bodies = names.where("section = 'body'").select("key", F.regexp_replace("document", r"\.[^.]+$", "").alias("document"))
        own = [d.join(bodies.select("key"), "key", "left_semi") for d in lines]
        docx.write_revisions(tracked(*own).join(bodies, "key"), options.tracked, options.author, options.date)
    return changes, faulty
