"""N-gram Jaccard join by a token-group matrix: all documents whose shingle sets reach a similarity.

1. Equal sets become one class (128-bit set fingerprint and size), so copies are never compared.
2. A set's probes are its tokens under a bound of the hash space, the same bound for all sets. A linked set has
   all but `n - ceil(t n)` of them, so two linked sets meet in the rarest so many (and one) of their probes;
   tokens that only one class has come first and meet nobody. Sets too small for probes to tell index all they
   have, and once more all their tokens among themselves. Sets that meet, directly or through others, are one
   group of similar sets; common passages do not matter, as their tokens are not a set's rarest.
3. Groups are cut into blocks of bounded size. A block stores its token union once and its members as
   positions in the union, compressed: little for similar sets.
4. For two blocks of a group, each member's overlap with the other block's union bounds its similarity to all
   that block's members. Only members that reach the threshold are opened and compared exactly, by one matrix
   product; spanning links leave the task, not all pairs.
5. A block is compared within itself and with the group's first block. What is in the group's largest component
   by then needs no further comparison among itself; only the members outside it meet all other blocks. So a
   group of near copies costs as much as it has members, not its square.
6. Connected components of the links, and of the copies, are the result.

No filter loses a link: 2 is the prefix argument, 4 is |Q & D| <= |Q & union|, 5 leaves out pairs that are
connected already.

Nulls and edge cases: a text that is null or has no words has no shingles, is linked with nothing and is its own
component; a text shorter than a shingle is one shingle. Rows count by id and text: the same id with another text
is another document, with the same text a copy of it. Rows without an id link like others; a component takes the
least id that it has, null if it has none. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import hashing
from docloom.llm.common import binary_list, chunks, drop, lean, list_array, ready, store
from docloom.llm.components import components

#: Members and tokens of a block; a single larger set is a block of its own.
BLOCK_SETS, BLOCK_TOKENS = 512, 1 << 18
#: Up to so many rows of ids (about 64 bytes each) are broadcast; more go by a shuffle.
BROADCAST_IDS = 200_000
#: The share of the token space that probes take, above the share in which linked sets may differ.
PROBE_MARGIN = 0.2
U = np.uint64


def fingerprints(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """docs(doc_id, t, text) -> doc_id, t, n, k1, k2 (the set's fingerprint), probes, and `tokens` where probes are too few to tell."""
    share = min(1.0, (q - p) / q + PROBE_MARGIN)
    bound = U(int(share * 2**64)) if share < 1 else U(2**64 - 1)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").lower() for t in binary_list(batch.column(2))]  # A-Z only
            for a, b in chunks([len(t) for t in texts]):
                tokens, n = hashing.shingle_sets(texts[a:b], k)
                end = np.cumsum(n)
                start = end - n
                one, two = (np.concatenate(([U(0)], np.cumsum(hashing.mix(tokens ^ U(s)), dtype=np.uint64))) for s in (11, 29))
                keys = [hashing.mix(x[end] - x[start]).view(np.int64) for x in (one, two)]
                probes = [tokens[i:j][: np.searchsorted(tokens[i:j], bound)] for i, j in zip(start, end)]
                few = np.array([len(x) for x in probes]) <= n - -(-n * p // q)
                every = [tokens[i:j] if x else tokens[:0] for i, j, x in zip(start, end, few)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), *map(pa.array, keys), _lists(probes), _lists(every)], names)

    schema = "doc_id long, t long, n long, k1 long, k2 long, probes array<long>, tokens array<long>"
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return docs.select("doc_id", "t", "text").mapInArrow(lean(make), schema)


def _lists(own: list[np.ndarray]) -> pa.ListArray:
    return list_array(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64), np.array([len(x) for x in own], np.int64))


def rarest(sets: DataFrame, tokens: str, p: int, q: int) -> DataFrame:
    """sets(k1, n, tokens) -> k1, x: the tokens of each set in which linked sets meet. Stored.

    The order of tokens is the same for all sets: first those that only one set has, then by number of sets.
    """
    rows = sets.select("k1", F.explode(tokens).alias("x"))
    shared = rows.groupBy("x").agg(F.count("*").cast("int").alias("c"), F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo < hi").select("x", "c")
    shared = store(shared, "shared")  # so that a join with hot tokens can be split
    own = rows.join(shared, "x").groupBy("k1").agg(F.collect_list(F.struct("c", "x")).alias("l"))
    own = own.join(sets.select("k1", "n", F.size(tokens).alias("m")), "k1")
    lose = F.col("n") - F.ceil(F.col("n") * p / q)
    many = F.when(F.col("m") > lose, lose + 1 - (F.col("m") - F.size("l"))).otherwise(F.size("l")).cast("int")
    own = own.withColumn("many", many).where("many > 0")
    out = store(own.select("k1", F.explode(F.slice(F.sort_array("l"), F.lit(1), F.col("many"))).alias("e")).select("k1", "e.x"), "index")
    drop(shared)
    return out


def meetings(sets: DataFrame, p: int, q: int) -> DataFrame:
    """(k1, lo): every set that meets another, and the least set that it meets in a token. Stored."""
    probes, every = rarest(sets, "probes", p, q), rarest(sets.where(F.size("tokens") > 0), "tokens", p, q)
    index = probes.union(every)
    live = store(index.groupBy("x").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo < hi").select("x", "lo"), "live")
    out = store(index.join(live, "x").where("k1 <> lo").select("k1", "lo").distinct(), "meet")
    drop(probes, every, live)
    return out


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """docs(block, k1, text) -> block, k1, tokens (ascending 64-bit hashes)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").lower() for t in binary_list(batch.column(2))]
            for a, b in chunks([len(t) for t in texts]):
                tokens, n = hashing.shingle_sets(texts[a:b], k)
                end = np.cumsum(n)
                blobs = [tokens[i:j].tobytes() for i, j in zip(end - n, end)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(blobs, pa.binary())], ["block", "k1", "tokens"])

    return docs.mapInArrow(lean(make), "block long, k1 long, tokens binary")


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, members) -> block, ids, sizes, all_tokens (the union, ascending), at (members as positions in it)."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            members = row["members"]
            union, at = np.unique(np.frombuffer(b"".join(m["tokens"] for m in members), np.uint64), return_inverse=True)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([row["block"]], pa.int64()),
                "ids": pa.array([[m["k1"] for m in members]], pa.list_(pa.int64())),
                "sizes": pa.array([[len(m["tokens"]) // 8 for m in members]], pa.list_(pa.int32())),
                "all_tokens": pa.array([union.tobytes()], pa.binary()),
                "at": pa.array([_pack(at)], pa.binary()),
            })


def _pack(at: np.ndarray) -> bytes:
    """Positions as compressed steps: mostly ones where members have most of the union."""
    return zlib.compress(np.diff(at.astype(np.int32), prepend=np.int32(0)).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.int32), dtype=np.int64)


class Block:
    """Sets of a group: their token union and, for each member, the union's positions it has."""

    def __init__(self, ids, sizes, all_tokens: bytes, at: bytes):
        self.ids, self.sizes = np.array(ids, np.int64), np.array(sizes, np.int64)
        self.union = np.frombuffer(all_tokens, np.uint64)
        self.at = _unpack(at)
        self.of = np.repeat(np.arange(len(self.ids)), self.sizes)

    def opens(self, column: np.ndarray, other: Block, p: int, q: int) -> np.ndarray:
        """Members whose overlap with the other block's union, and whose size, allow a link. column: the other's column of each token, or -1."""
        bound = np.bincount(self.of, weights=column[self.at] >= 0, minlength=len(self.ids)).astype(np.int64)
        close = ((other.sizes[None, :] * q >= self.sizes[:, None] * p) & (self.sizes[:, None] * q >= other.sizes[None, :] * p)).any(1)
        return (bound * q >= p * self.sizes) & close

    def entries(self, column: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The opened members' rows and columns in the matrix, by column."""
        at = column[self.at]
        keep = (at >= 0) & opens[self.of]
        row, at = (np.cumsum(opens) - 1)[self.of[keep]], at[keep]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]


def _product(one: tuple, two: tuple, n: int, m: int, width: int) -> np.ndarray:
    """Common tokens of n members with m, a bounded part of the columns at a time."""
    common = np.zeros((n, m), np.int64)
    step = max(1, (1 << 22) // max(1, n, m))
    for a in range(0, width, step):
        parts = []
        for (row, column), k in ((one, n), (two, m)):
            i, j = np.searchsorted(column, [a, a + step])
            x = np.zeros((k, min(step, width - a)), np.float32)
            x[row[i:j], column[i:j] - a] = 1
            parts.append(x)
        common += (parts[0] @ parts[1].T).astype(np.int64)
    return common


def open_groups(one: Block, two: Block | None, p: int, q: int) -> list[tuple[int, int]]:
    """Spanning links between the members of two blocks, or within one."""
    if two is None:
        times = np.bincount(one.at, minlength=len(one.union))
        column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)
        opens = one.opens(column, one, p, q)
        own = one.entries(column, opens)
        ids, sizes = one.ids[opens], one.sizes[opens]
        common = _product(own, own, len(ids), len(ids), int((times > 1).sum()))
        linked = common * q >= p * (sizes[:, None] + sizes[None, :] - common)
    else:
        both, i, j = np.intersect1d(one.union, two.union, assume_unique=True, return_indices=True)
        columns = [np.full(len(x.union), -1) for x in (one, two)]
        columns[0][i] = columns[1][j] = np.arange(len(both))
        opens = [x.opens(c, y, p, q) for x, y, c in ((one, two, columns[0]), (two, one, columns[1]))]
        n, m = int(opens[0].sum()), int(opens[1].sum())
        if not n or not m:
            return []
        common = _product(one.entries(columns[0], opens[0]), two.entries(columns[1], opens[1]), n, m, len(both))
        ids = np.concatenate((one.ids[opens[0]], two.ids[opens[1]]))
        sizes = (one.sizes[opens[0]], two.sizes[opens[1]])
        linked = np.eye(n + m, dtype=bool)
        linked[:n, n:] = common * q >= p * (sizes[0][:, None] + sizes[1][None, :] - common)
        linked[n:, :n] = linked[:n, n:].T
    label = np.arange(len(ids))
    while len(ids):
        new = np.minimum(np.where(linked, label[None, :], len(ids)).min(1), label)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(ids[i]), int(ids[j])) for i, j in enumerate(label) if i != j]


def _blocks(members: DataFrame, docs: DataFrame, k: int, repeated: bool) -> DataFrame:
    """members(block, k1, id, tt): each set's block and the row to make it from -> stored blocks."""
    if members.count() <= BROADCAST_IDS:
        members = F.broadcast(members)
    texts = docs.join(members, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("tt"))).select("block", "k1", "text")
    sets = _sets(texts.dropDuplicates(["block", "k1"]) if repeated else texts, k)
    listed = sets.groupBy("block").agg(F.collect_list(F.struct("k1", "tokens")).alias("members"))
    return store(listed.mapInArrow(lean(_unions), "block long, ids array<long>, sizes array<int>, all_tokens binary, at binary"), "blocks")


def _compared(pairs: DataFrame, p: int, q: int) -> DataFrame:
    """(x, y: blocks; y may be absent) -> a, b: spanning links."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = open_groups(Block(**row["x"]), Block(**row["y"]) if "y" in row else None, p, q)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([e[j] for e in found], pa.int64()) for j in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(lean(verify), "a long, b long")


def _links(docs: DataFrame, members: DataFrame, k: int, p: int, q: int, repeated: bool) -> DataFrame:
    """members(g, k1, n, id, tt), stored -> stored links (a, b) of sets, enough to connect all that are linked."""
    size = members.groupBy("g").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
    placed = members.join(size, "g").withColumn("part", F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int"))
    placed = store(placed.select("g", "part", "k1", "id", "tt", (F.col("blocks") > 1).alias("more"), F.xxhash64("g", "part").alias("block")), "members")
    blocks = _blocks(placed.select("block", "k1", "id", "tt"), docs, k, repeated)
    payload = F.struct("ids", "sizes", "all_tokens", "at")
    one, two = blocks.select(F.col("block").alias("one"), payload.alias("x")), blocks.select(F.col("block").alias("two"), payload.alias("y"))

    links = _compared(one.where(F.size("x.ids") > 1).select("x"), p, q)
    large = placed.where("more").select("g", "part", "block").distinct()
    if not large.limit(1).count():
        out = store(links, "links")
        drop(placed, blocks)
        return out
    first = large.groupBy("g").agg(F.min_by("block", "part").alias("two"))
    pairs = large.join(first, "g").where("block <> two").select(F.col("block").alias("one"), "two")
    links = store(links.union(_compared(pairs.join(two, "two").join(one, "one").select("x", "y"), p, q)), "links")
    # members outside their group's largest component meet all the group's blocks but their own and the first
    of = components(links).select(F.col("node").alias("k1"), "component")
    labelled = placed.where("more").join(of, "k1", "left").select("g", "k1", "id", "tt", "block", F.coalesce("component", "k1").alias("c"))
    main = labelled.groupBy("g", "c").agg(F.count("*").alias("many")).groupBy("g").agg(F.max_by("c", F.struct("many", "c")).alias("main"))
    rest = labelled.join(main, "g").where("c <> main")
    many = rest.groupBy("g").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("parts"))
    rest = rest.join(many, "g").select("g", "k1", "id", "tt", F.xxhash64("g", F.lit("rest"), F.pmod(F.xxhash64("k1", F.lit(1)), F.col("parts"))).alias("block"))
    rest = store(rest, "rest")
    outside = _blocks(rest.select("block", "k1", "id", "tt"), docs, k, repeated)
    pairs = rest.select("g", F.col("block").alias("one")).distinct().join(large.join(first, "g").where("block <> two").select("g", F.col("block").alias("two")), "g").select("one", "two")
    three = outside.select(F.col("block").alias("one"), payload.alias("x"))
    out = store(links.union(_compared(pairs.join(three, "one").join(two, "two").select("x", "y"), p, q)), "links")
    drop(placed, blocks, links, rest, outside)
    return out


def _known(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, t (hash of the text), text: a row's key is its id and t."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))


def _classes(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """docs as by `_known` -> doc_id, t, n, first(id, t): of every row, the first row of its component. Stored."""
    ready(docs.sparkSession)
    made = store(fingerprints(docs, k, p, q), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("t").alias("tt"))
    live = made.where("n > 0")
    sets = store(live.groupBy("k1", "k2", "n").agg(F.min(row).alias("rep"), F.first("probes").alias("probes"), F.first("tokens").alias("tokens")), "sets")
    meet = meetings(sets, p, q)
    group = components(meet, "k1", "lo").select(F.col("node").alias("k1"), F.col("component").alias("g"))
    members = store(sets.select("k1", "n", "rep.id", "rep.tt").join(group, "k1"), "grouped")
    links = _links(docs, members, k, p, q, repeated(made))
    of = components(links).select(F.col("node").alias("k1"), "component")
    reps = sets.select("k1", "k2", "n", "rep").join(of, "k1", "left")
    first = reps.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("lead"))
    reps = reps.join(first, "component", "left").select("k1", "k2", "n", F.coalesce("lead", "rep").alias("first"))
    result = live.select("doc_id", "t", "n", "k1", "k2").join(reps, ["k1", "k2", "n"]).select("doc_id", "t", "n", "first.id", "first.tt")
    result = result.union(made.where("n = 0").select("doc_id", "t", "n", "doc_id", "t"))
    out = store(result, "components")
    drop(made, sets, meet, members, links)
    return out


def ngram_components(docs: DataFrame, k: int = 5, p: int = 8, q: int = 10, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: components of the links with 'q * intersection >= p * union'."""
    return _classes(_known(docs, text), k, p, q).select("doc_id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, p: int = 8, q: int = 10) -> DataFrame:
    """The documents, with all their columns, less all but one of each component: its least id (null last) stays.

    Of rows that repeat both id and text of the one that stays, and have words, one stays too, whichever Spark
    takes first; rows without words all stay.
    """
    found = _classes(_known(docs), k, p, q)
    gone = found.where("n > 0 AND NOT (doc_id <=> id AND t = tt)").select("doc_id", "t").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tt"))
    same: Column = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("tt") == F.col("t"))
    left = rows.join(_small(gone), same, "left_anti")
    twice = found.where("n > 0").groupBy("doc_id", "t").count().where("count > 1").select("doc_id", "t")
    if repeated(found):
        once = left.join(_small(twice), same, "left_semi").dropDuplicates(["id", "tt"])
        left = left.join(_small(twice), same, "left_anti").union(once)
    return left.select("row.*")


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def repeated(made: DataFrame) -> bool:
    """Whether any row comes twice: then a class's text is fetched once all the same."""
    return made.where("n > 0").groupBy("doc_id", "t").count().where("count > 1").limit(1).count() > 0
