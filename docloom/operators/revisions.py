"""Tracked changes: two versions of texts as one sequence of kept, deleted and added pieces, paragraph marks included.

Paragraphs are aligned first (`line_diff`). Where paragraphs of both versions stand between two kept ones, their words,
spaces, signs and paragraph marks are aligned in the same way, so a paragraph that was split is one with an added mark
and two that were joined are ones with a deleted mark between them; no case is treated apart. The last marks of both
sides of such a change belong together. Without its deleted pieces the sequence is the later version, without its added ones the earlier.

Texts come as (key long, pos long, line), places from zero; a null line is empty, and a version without lines has no
paragraphs. A text is cut and aligned by joins; only who writes a document sees all of it, as a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.line_diff import counted, line_diff
from docloom.sources.storage import scratch, stored

#: A word, white space, or another character; together they cover every line.
PIECE = r"\w+|\s+|[^\w\s]"
#: Places that a line's pieces have: more than a text's longest line has characters. The last of them is its mark's.
WIDTH = 1 << 31
ORDER = ["step", "side", "place"]
#: Where no text has more characters, both versions together, a text's rows are counted by one task; and lines or pieces compared at once.
SHORT, DIRECT = 1 << 20, 4_096


def _pieces(lines: DataFrame, changed: DataFrame) -> DataFrame:
    """key, gap, pos, line: the pieces of the lines of one version in changes that both have; the last mark of a change is left out."""
    last = lines.groupBy("key", "hunk").agg(F.max("pos").alias("_last")).join(changed, ["key", "hunk"])
    own = lines.join(last, ["key", "hunk"])
    words = F.regexp_extract_all("line", F.lit(PIECE), F.lit(0))
    cut = F.when(F.col("pos") == F.col("_last"), words).otherwise(F.concat(words, F.array(F.lit("\n"))))
    return own.select("key", F.col("hunk").cast("string").alias("gap"), F.col("pos").alias("_pos"), F.posexplode(cut).alias("_i", "line")).select("key", "gap", (F.col("_pos") * WIDTH + F.col("_i")).alias("pos"), "line")


def tracked(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, step, side, place, kind (equal, deleted, added), text; in the order of step, side and place it is the document."""
    folder = scratch(before.sparkSession, "revisions")
    size = before.select("key", "line").union(after.select("key", "line")).groupBy("key").agg(F.sum(F.length(F.coalesce("line", F.lit(""))) + 1).alias("n"))
    short = (size.agg(F.max("n")).first()[0] or 0) <= SHORT
    diff = line_diff(before, after, direct=DIRECT)
    sides = []
    for own, gone in (("before_pos", "deleted"), ("after_pos", "added")):
        mine = diff.where(F.col("kind").isin("equal", gone)).select("key", "kind", own, F.when(F.col("kind") == gone, F.col("line")).alias("line"))
        at = counted(mine, ["key"], own, F.col("kind") == "equal", "hunk", short).where(F.col("kind") == gone)
        sides.append(stored(at.select("key", "hunk", F.col(own).alias("pos"), "line"), f"{folder}/{gone}"))
    old, new = sides
    changed = old.select("key", "hunk").distinct().intersect(new.select("key", "hunk").distinct())
    inner = line_diff(_pieces(old, changed), _pieces(new, changed), direct=DIRECT).select("key", "kind", "before_pos", "after_pos", F.col("line").alias("text"))
    ends = [d.join(changed, ["key", "hunk"], "left_semi").groupBy("key", "hunk").agg((F.max("pos") * WIDTH + WIDTH - 1).alias(n)) for d, n in ((old, "before_pos"), (new, "after_pos"))]
    marks = ends[0].join(ends[1], ["key", "hunk"]).select("key", F.lit("equal").alias("kind"), "before_pos", "after_pos", F.lit("\n").alias("text"))
    none, whole = F.lit(None).cast("long"), F.concat("line", F.lit("\n")).alias("text")
    alone = lambda d: d.join(changed, ["key", "hunk"], "left_anti")
    rows = (
        diff.where("kind = 'equal'").select("key", "kind", (F.col("before_pos") * WIDTH).alias("before_pos"), (F.col("after_pos") * WIDTH).alias("after_pos"), whole)
        .union(alone(old).select("key", F.lit("deleted"), F.col("pos") * WIDTH, none, whole))
        .union(alone(new).select("key", F.lit("added"), none, F.col("pos") * WIDTH, whole))
        .union(inner).union(marks)
    )
    return _ordered(stored(rows, f"{folder}/pieces"), short)


def _ordered(rows: DataFrame, short: bool) -> DataFrame:
    """What is kept comes in the same order in both versions: how much of it lies before a piece, on its own side, is its step."""
    kept = F.col("kind") == "equal"
    left = counted(rows.where("kind <> 'added'"), ["key"], "before_pos", kept, "step", short)
    right = counted(rows.where("kind <> 'deleted'"), ["key"], "after_pos", kept, "step", short).where("kind = 'added'")
    side = F.when(kept, 2).when(F.col("kind") == "added", 1).otherwise(0)
    return left.union(right).select("key", "step", side.alias("side"), F.coalesce("before_pos", "after_pos").alias("place"), "kind", "text")


def version(pieces: DataFrame, accepted: bool = True) -> DataFrame:
    """key, text: the later version (or the earlier), its paragraphs ended by line feeds. A text is one row, as it was."""
    own: Column = F.col("kind") != ("deleted" if accepted else "added")
    listed = F.array_sort(F.collect_list(F.struct(*ORDER, "text")))
    return pieces.where(own).groupBy("key").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "").alias("text"))


def counts(pieces: DataFrame) -> DataFrame:
    """key, kind, pieces, characters, marks: how much was kept, deleted and added."""
    return pieces.groupBy("key", "kind").agg(F.count("*").alias("pieces"), F.sum(F.length("text")).alias("characters"), F.sum(F.endswith("text", F.lit("\n")).cast("long")).alias("marks"))
