"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, each source gets a target, target over size is its repetition rate, and a
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the rate's
fraction. The draw depends on the seed, the document's id, its text and, where rows of a source agree in both, on a
number among these: reruns and any partitioning agree.

Nulls and edge cases: a null text has size 0 and counts as empty in draws; a null source is a source of its own, after
all others; a source without words has rate 0; an empty table gives an empty result. Rows without an id, or with one
that repeats, are drawn each on its own: by their texts, and equal ones by their number, which is counted over
parts of each group, so that a group of very many is no task's alone. Other columns travel in one field, whatever
their names.

What a source takes is a sum of such draws: about its target, with a variance of sum f (1 - f) size^2, where f
is the fraction of the rate. A source of few or very unequal documents can miss its target by as much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, drop, partitions_of, store

#: Up to so many sources are numbered in one task and their rates broadcast; more go by a shuffle.
BROADCAST_SOURCES = 5_000
#: Up to so many keys (32 bytes each) of rows that repeat are broadcast; parts that a group of equal rows is numbered in.
BROADCAST_KEYS, PARTS = 100_000, 64
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def ranked(per: DataFrame) -> DataFrame:
    """per(source, source_size) with `rank`: the source's place by code point, from zero, null last.

    Up to `BROADCAST_SOURCES` sources are numbered in one task; more are range-partitioned, numbered within
    their partition, and raised by the counts of the partitions before.
    """
    by_name = F.col("source").asc_nulls_last()
    if per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return per.withColumn("rank", F.row_number().over(Window.orderBy(by_name)) - 1)
    per = store(per.repartitionByRange(partitions_of(per), by_name).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = per.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(by_name)) - 1
    return per.withColumn("rank", within).join(base, "part").select("source", "source_size", (F.col("rank") + F.col("base")).alias("rank"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target, rate. Stored.

    Targets share the total by weight and stop at `most` times a source's size; the excess is shared again
    among the rest until none is above. Each round is one sum over the sources, and there are few: what a free
    source gets for each unit of weight only grows.
    """
    per = store(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    numbered = store(ranked(per).withColumn("weight", w).withColumn("cap", (F.col("source_size") * most).cast("double")), "ranked")
    level = 0.0
    while True:
        stops = F.col("cap") <= F.col("weight") * level
        total, capped, left = numbered.agg(F.sum("source_size"), F.sum(F.when(stops, F.col("cap"))), F.sum(F.when(~stops, F.col("weight")))).first()
        if not left or (now := ((total or 0) - (capped or 0.0)) / left) <= level:
            break
        level = now
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = store(numbered.withColumn("target", target).select("source", "source_size", "target", F.least(rate, F.lit(float(most))).alias("rate")), "targets")
    drop(per, numbered)
    return out


def copies(rate: Column, doc_id: Column, digest: Column, number: Column, seed: int) -> Column:
    """floor(rate) and one more with the probability of the fraction, decided by 52 bits of a hash of seed, id, text and number."""
    said = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), digest, number.cast("string"))
    draw = F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def numbered(rows: DataFrame) -> DataFrame:
    """rows(doc_id, source, digest, ...) with `number`: from one among the rows that agree in all three.

    Only such rows are dealt out anew; they are numbered within parts of their group and raised by the counts of the
    parts before. Rows that differ in other columns keep their order whatever the partitioning.
    """
    key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "digest"))
    keyed = rows.withColumn("key", key)
    again = store(keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key"), "repeated")
    many = again.limit(BROADCAST_KEYS + 1).count()
    if not many:
        return rows.withColumn("number", F.lit(1))
    few = F.broadcast(again) if many <= BROADCAST_KEYS else again
    content = F.xxhash64(F.to_json(F.struct(*[c for c in rows.columns])))
    own = store(keyed.join(few, "key").withColumns({"content": content, "part": F.floor(F.rand() * PARTS)}), "repeats")
    before = Window.partitionBy("key").orderBy("content", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy("key", "content", "part").agg(F.count("*").alias("many")).select("key", "content", "part", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("key", "content", "part").orderBy("digest"))
    placed = own.withColumn("within", within).join(base, ["key", "content", "part"]).withColumn("number", F.col("within") + F.col("base"))
    alone = keyed.join(few, "key", "left_anti").withColumn("number", F.lit(1))
    return alone.select(*rows.columns, "number").union(placed.select(*rows.columns, "number"))


def _planned(rows: DataFrame, weights: tuple[float, ...], most: int, seed: int) -> DataFrame:
    """rows(doc_id, source, size, digest, more) with source_size, target, rate, copies, taken."""
    targets = source_targets(rows.select("source", "size"), weights, most)
    t = targets.select(F.col("source").alias("its_source"), "source_size", "target", "rate")
    few = t.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rows = numbered(rows)
    joined = rows.join(F.broadcast(t) if few else t, rows["source"].eqNullSafe(t["its_source"]))
    n_copies = copies(F.col("rate"), F.col("doc_id"), F.col("digest"), F.col("number"), seed)
    return joined.withColumn("copies", n_copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, source_size, target, rate, copies, taken."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_digest(F.col("text")).alias("digest"))
    return _planned(sized, weights, most, seed).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """The mixed corpus: the documents' columns, each document as often as the plan says."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_digest(F.col("text")).alias("digest"), F.struct("*").alias("row"))
    plan = _planned(rows, weights, most, seed).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
