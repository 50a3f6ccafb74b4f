"""Quoted CSV files of any size, parsed in parallel.

A file is read in splits, as lines of bytes between line feeds. Whether a line begins inside quotes depends on all
before it, so each split is first summarised as what it makes of either state: the state it ends in, and the records
that begin in it. Summaries compose (to a constant, to the same state, or to the other one), so a running composition
over a file's splits, one row each, gives every split its true first state and the number of its first record; then all
are parsed independently. A record that crosses splits is put together from its pieces, at most two a split.

Line ends are LF or CRLF; within quotes they stay as they are. A quote opens a field only at its start, and is
doubled within. Text after a closing quote, and a quote that never closes, are faults of their record. The text is UTF-8.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.ranges import SHEET_COLUMNS
from docloom.session import ship
from docloom.sources.storage import scratch

#: Splits whose states (some 200 bytes each) are broadcast; beyond it they are joined by a shuffle of the lines' keys.
MOST_SPLITS = 1_000_000
_SUMMARY = "file string, split long, to0 int, to1 int, n0 long, n1 long, lines long"
_RECORDS = "file string, split long, row long, fields array<string>, fault string, piece string"


def closed(line: str, at: int, quote: str) -> int:
    """Where the quotes that are open at a place have closed, or -1."""
    while (at := line.find(quote, at)) >= 0:
        if not line.startswith(quote, at + 1):
            return at + 1
        at += 2
    return -1


def inside_after(line: str, inside: bool, delimiter: str = ",", quote: str = '"') -> bool:
    """Whether a line that begins inside quotes, or not, ends inside them."""
    at = 0
    while at >= 0:
        if inside or line.startswith(quote, at):
            at = closed(line, at if inside else at + 1, quote)
            if at < 0:
                return True
            inside = False
        at = line.find(delimiter, at)
        at = at + 1 if at >= 0 else -1
    return False


def _runs(batches: Iterator[pa.RecordBatch], quote: str) -> Iterator[tuple[tuple, list[str], list[bool]]]:
    """(file, split, what is joined to it), lines, and whether each holds a quote, as they come."""
    for batch in batches:
        quoted = pc.match_substring(batch.column("value"), quote).to_pylist()
        lines = batch.column("value").to_pylist()
        ids = list(zip(*[batch.column(c).to_pylist() for c in batch.schema.names if c != "value"]))
        start = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or ids[i] != ids[start]:
                yield ids[start], lines[start:i], quoted[start:i]
                start = i


def _summarised(delimiter: str, quote: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n, many = None, [False, True], [0, 0], 0

        def made() -> pa.RecordBatch:
            row = (*now, *map(int, state), *n, many)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], [x.split()[0] for x in _SUMMARY.split(", ")])

        for own, lines, quoted in _runs(batches, quote):
            if own != now:
                if now is not None:
                    yield made()
                now, state, n, many = own, [False, True], [0, 0], 0
            many += len(lines)
            for line, q in zip(lines, quoted):
                for k in (0, 1):
                    n[k] += not state[k]
                if q:
                    ends = {s: inside_after(line, s, delimiter, quote) for s in set(state)}
                    state = [ends[s] for s in state]
        if now is not None:
            yield made()

    return run


def parsed(records: list[str], delimiter: str, quote: str) -> Iterator[tuple[list[str], str | None]]:
    """Fields and fault of each record; those without a fault go through one reader."""
    reader = csv.reader(records, delimiter=delimiter, quotechar=quote, strict=True)
    done = 0
    while done < len(records):
        try:
            for fields in reader:
                done += 1
                yield fields or [""], None
            return
        except csv.Error as e:
            loose = next(csv.reader([records[done]], delimiter=delimiter, quotechar=quote), [])
            done += 1
            yield loose, str(e)
            reader = csv.reader(records[done:], delimiter=delimiter, quotechar=quote, strict=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), kinds)], [x.split()[0] for x in _RECORDS.split(", ")])


def _cut(line: str) -> str:
    return line.removesuffix("\r")


def _parsed(delimiter: str, quote: str) -> Callable:
    """Lines with their split's first state and record to whole records, and pieces of those that cross splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, row, held, head = None, False, 0, [], False

        def left() -> list[tuple]:
            """What is open at a split's end: a piece, and there may be more of it in the next."""
            return [(*now[:2], row, None, None, "\n".join(held))] if now is not None and held else []

        for own, lines, quoted in _runs(batches, quote):
            out, whole = [], []
            if own != now:
                out += left()
                now, held = own, []
                inside, row = bool(own[2]), own[3] - bool(own[2])
                head = inside
            for line, q in zip(lines, quoted):
                held.append(line)
                if q:
                    inside = inside_after(line, inside, delimiter, quote)
                if not inside:
                    if head:
                        out.append((*now[:2], row, None, None, "\n".join(held)))
                        head = False
                    else:
                        whole.append((row, _cut("\n".join(held))))
                    held, row = [], row + 1
            out += [(*now[:2], r, fields, fault, None) for (r, _), (fields, fault) in zip(whole, parsed([t for _, t in whole], delimiter, quote))]
            if out:
                yield _batch(out)
        if out := left():
            yield _batch(out)

    return run


def _joined(delimiter: str, quote: str) -> Callable:
    """Records put together from their pieces (file, split, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, splits, rows, texts = (batch.column(i).to_pylist() for i in range(4))
            made = parsed([_cut(t) for t in texts], delimiter, quote)
            yield _batch([(f, s, r, fields, fault, None) for f, s, r, (fields, fault) in zip(files, splits, rows, made)])

    return run


def csv_records(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', split_bytes: int | None = None) -> DataFrame:
    """file, split, row, fields, fault: every record of the files, numbered from zero within its file. Stored.

    split: where in the file the split begins in which the record does. split_bytes: the splits' size, by default
    the session's.
    """
    ship(spark)
    own = spark.newSession()  # splits have to be the same in both passes, whatever the caller sets meanwhile
    for k, v in spark.conf.getAll.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    if split_bytes:
        own.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
        own.conf.set("spark.sql.files.openCostInBytes", "0")
        own.conf.set("spark.sql.files.minPartitionNum", "1")
    raw = own.read.option("lineSep", "\n").text(path)
    lines = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    folder = scratch(spark, "csv")
    lines.mapInArrow(_summarised(delimiter, quote), _SUMMARY).write.parquet(f"{folder}/splits")
    splits = own.read.parquet(f"{folder}/splits")
    states = entered(splits)
    states = F.broadcast(states) if splits.count() <= MOST_SPLITS else states
    bom = F.when(F.col("split") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    ready = lines.join(states, ["file", "split"]).select(bom.alias("value"), "file", "split", "entry", "base")
    ready.mapInArrow(_parsed(delimiter, quote), _RECORDS).write.parquet(f"{folder}/records")
    records = spark.read.schema(_RECORDS).parquet(f"{folder}/records")
    pieces = records.where("piece IS NOT NULL").groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("split", "piece"))).alias("l"))
    texts = pieces.select("file", F.get("l", F.lit(0))["split"].alias("split"), "row", F.array_join(F.transform("l", lambda x: x["piece"]), "\n").alias("text"))
    return records.where("piece IS NULL").union(texts.mapInArrow(_joined(delimiter, quote), _RECORDS)).drop("piece")


def entered(splits: DataFrame) -> DataFrame:
    """file, split, entry, base: each split's first state and record, by running composition of the summaries before.

    What a split makes of the state is a constant, or adds to it modulo two: so a state is the last constant and
    the changes since.
    """
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    constant = F.when(F.col("to0") == F.col("to1"), F.col("to0"))
    turned = splits.withColumn("constant", constant).withColumn("turns", F.sum((F.col("to0") > F.col("to1")).cast("int")).over(upto))
    last = F.last(F.when(F.col("constant").isNotNull(), F.struct("constant", "turns")), ignorenulls=True).over(before)
    since = turned.withColumn("last", last).withColumn("now", F.coalesce(F.max("turns").over(before), F.lit(0)))
    entry = (F.coalesce(F.col("last.constant"), F.lit(0)) + F.col("now") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2
    known = since.withColumn("entry", entry.cast("int")).withColumn("n", F.when(F.col("entry") == 0, F.col("n0")).otherwise(F.col("n1")))
    return known.select("file", "split", "entry", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def unique_headers(names: list[str]) -> list[str]:
    """Blank names become `Column N`; one that was there before gets _1, _2 ..."""
    out: list[str] = []
    for i, n in enumerate(names, 1):
        name = base = n.strip() or f"Column {i}"
        k = 0
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', split_bytes: int | None = None, faults: str = "raise") -> tuple[DataFrame, DataFrame]:
    """The table under the header row, and a report.

    Table: _file, _row (the record's number in its file), and the columns, all text. Blank records are passed over; short ones are
    filled with the empty text, further cells dropped. Report: file, split, records, odd (of another width than the
    header), faults. faults: "raise", or "keep" to have such records as far as they can be read.
    """
    records = csv_records(spark, path, delimiter, quote, split_bytes)
    filled = records.where(F.exists("fields", lambda x: T.trim(x) != ""))
    heads = filled.groupBy("file").agg(F.min(F.struct("row", "fields")).alias("head"))
    kinds = heads.groupBy("head.fields").count().limit(2).collect()
    if len(kinds) > 1:
        raise ValueError(f"files with different header rows: {kinds[0]['fields']} and {kinds[1]['fields']}")
    names = unique_headers(kinds[0]["fields"] if kinds else [])
    if len(names) > SHEET_COLUMNS:
        raise ValueError(f"more than {SHEET_COLUMNS} columns")
    first = heads.select("file", F.col("head.row").alias("first"))
    body = filled.join(first, "file").where("row > first")  # a row a file
    report = body.groupBy("file", "split").agg(F.count("*").alias("records"), F.count_if(F.size("fields") != len(names)).alias("odd"), F.count("fault").alias("faults"))
    if faults == "raise" and (wrong := records.where("fault IS NOT NULL").select("file", "row", "fault").limit(1).collect()):
        raise ValueError("record {row} of {file}: {fault}".format(**wrong[0].asDict()))
    return body.select(F.col("file").alias("_file"), F.col("row").alias("_row"), *[F.coalesce(F.get("fields", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]), report
